"""WARC archives of pages, and a globally ordered index of them by external merging.

Writing: every page is one WARC/1.1 record, and every record a gzip member of its own. Of records with equal payloads of
at least ``least`` bytes, that with the largest id is a response; the others are revisits that refer to it and hold no
payload. A file ends after ``per_file`` records or ``per_bytes`` compressed bytes, whatever comes first (a larger record
has a file for itself), and is sorted by URL key, date and id: a locally sorted run of captures.

Spark's text writer writes the files, so they can go to any store that Spark can write, and a lost task is written anew.
It puts a separator after every row, here a zero byte. That is the last byte of a gzip member that holds less than 16 MiB,
so it is left to the writer; behind a larger member it is padding, which gzip readers skip. The writer names the files
``.txt``; they are WARC files compressed by record.

Reading: every file is walked from member to member, and one record at a time is held uncompressed; payload length and
SHA-1 are taken from the payload where there is one, and from the record where it is a revisit. ``offset`` and ``length``
count bytes of the file as it lies in the store: reading just these gives the record (see :func:`record_of`).

Index: captures are dealt by ranges of (URL key, date, id, place) of about ``per_range`` rows, so a hot URL is spread over
many ranges and a task's memory doesn't grow with the table; in each, the runs that its rows come from are merged by a
loser tree. The parts, one after another, are the capture histories of all URLs in global order.

Defined results: a null html is an empty payload; a null url has no target and the empty URL key; line breaks in a url
are percent-encoded; rows whose id repeats or is null are records of their own (a null id is the smallest; rows that
share the largest id of a payload are all responses). Ids that aren't integers raise a TypeError. Further columns are
ignored. No rows give an empty index.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from bendscape.llm.common import cut, shared_folder

LEAST = 1000
PER_FILE = 2048
PER_BYTES = 1 << 25
PER_RANGE = 50_000
#: zlib's window bits for gzip members.
GZIP = 31
END = "\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def url_key(url: Column) -> Column:
    """A sort key: the host's labels in reverse order, then the path, in lower case."""
    rest = F.regexp_extract(url, r"(?s)^[^:]*://(?:www\.)?([^/?#:]*)(?::\d+)?([^#]*)", 0)
    host = F.regexp_extract(url, r"(?s)^[^:]*://(?:www\.)?([^/?#:]*)", 1)
    path = F.regexp_extract(url, r"(?s)^[^:]*://[^/?#]*([^#]*)", 1)
    key = F.lower(F.concat(F.array_join(F.reverse(F.split(host, r"\.")), ","), F.lit(")"), path))
    return F.coalesce(F.when(rest == "", F.lower(url)).otherwise(key), F.lit(""))


def records(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html", least: int = LEAST, epoch: int = 1704067200) -> DataFrame:
    """(urlkey, date, id, record): the text of each record, without its end. Page ``id`` was captured id seconds after ``epoch``."""
    date = F.date_format(F.to_utc_timestamp(F.timestamp_seconds(F.lit(epoch) + F.coalesce(F.col(key), F.lit(0)) % 3153600000), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    if not isinstance(pages.schema[key].dataType, IntegralType):
        raise TypeError(f"{key} must be of an integer type, not {pages.schema[key].dataType.simpleString()}")
    payload = F.coalesce(F.col(html), F.lit(""))
    target = F.replace(F.replace(F.col(url), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    rows = pages.select(F.col(key).cast("long").alias("id"), target.alias("url"), payload.alias("payload"), date.alias("date"))
    rows = rows.withColumns({"bytes": F.octet_length("payload").cast("long"), "sha1": F.sha1(F.encode("payload", "UTF-8"))})
    copies = rows.where(F.col("bytes") >= least).groupBy("sha1", "bytes").agg(F.max("id").alias("first"), F.count("*").alias("n")).where("n > 1")
    rows = rows.join(copies.select("sha1", "bytes", "first"), ["sha1", "bytes"], "left")
    revisit = F.col("first").isNotNull() & ~F.col("id").eqNullSafe(F.col("first"))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=UTF-8\r\nContent-Length: "), F.col("bytes").cast("string"), F.lit(END))
    block = F.when(revisit, http).otherwise(F.concat(http, F.col("payload")))
    line = lambda name, value: F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit("\r\n")), F.lit(""))
    page = lambda c: F.concat(F.lit("<urn:page:"), c.cast("string"), F.lit(">"))
    header = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: "), F.when(revisit, F.lit("revisit")).otherwise(F.lit("response")), F.lit("\r\n"),
        line("WARC-Record-ID", F.coalesce(page(F.col("id")), F.lit("<urn:page:>"))),
        line("WARC-Date", F.col("date")), line("WARC-Target-URI", F.col("url")), line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("sha1"))),
        line("WARC-Profile", F.when(revisit, F.lit(PROFILE))), line("WARC-Refers-To", F.when(revisit, page(F.col("first")))),
        F.lit("Content-Type: application/http; msgtype=response\r\nContent-Length: "), F.octet_length(block).cast("string"), F.lit(END),
    )
    return rows.select(url_key(F.col("url")).alias("urlkey"), "date", "id", F.concat(header, block).alias("record"))


def write(rows: DataFrame, folder: str, per_file: int = PER_FILE, per_bytes: int = PER_BYTES) -> None:
    """Writes records as archive files, each a sorted run."""

    def pack(batches):
        file, place, n, size = 0, 0, 0, 0
        for batch in batches:
            out = [[], [], []]
            for record in batch.column(0):
                record = record.as_py() + END.encode()
                packer = zlib.compressobj(wbits=GZIP)
                member = packer.compress(record) + packer.flush()
                if n and (n == per_file or size + len(member) > per_bytes):
                    file, n, size = file + 1, 0, 0
                n, size, place = n + 1, size + len(member), place + 1
                for column, value in zip(out, (file, place, member.removesuffix(b"\0") if len(record) < 1 << 24 else member), strict=True):
                    column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (pa.int32(), pa.int64(), pa.binary()), strict=True)], names=["file", "place", "member"])

    runs = rows.sortWithinPartitions("urlkey", "date", "id").select(F.col("record").cast("binary")).mapInArrow(pack, "file int, place long, member binary")
    members = runs.sortWithinPartitions("file", "place").select("file", F.col("member").cast("string").alias("member"))
    members.write.partitionBy("file").option("lineSep", "\0").option("compression", "none").text(folder)


def record_of(data: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields and block of an uncompressed record."""
    stop = data.index(END.encode())
    lines = data[:stop].decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("no record begins here")
    fields = dict(x.split(": ", 1) for x in lines[1:])
    end = stop + 4 + int(fields["Content-Length"])
    if data[end:] != END.encode():
        raise ValueError("the record does not end where it says")
    return fields, data[stop + 4 : end]


def walk(data: bytes, step: int = 1 << 14):
    """(offset, length, header fields, block) of each record of an archive; offset and length are those of its member."""
    at, view = 0, memoryview(data)
    while at < len(data):
        if not data[at]:  # padding
            at += 1
            continue
        unpacker, parts, stop = zlib.decompressobj(wbits=GZIP), [], at
        # In steps, as what lies behind the member is copied.
        while not unpacker.eof:
            if stop >= len(data):
                raise ValueError(f"the member at byte {at} has no end")
            parts.append(unpacker.decompress(view[stop : stop + step]))
            stop = min(stop + step, len(data))
        stop -= len(unpacker.unused_data)
        yield at, stop - at, *record_of(b"".join(parts))
        at = stop


def captures(spark, folder: str) -> DataFrame:
    """(run, offset, length, page_id, url, date, record_type, payload_digest, payload_bytes, refers_to) of all records of a folder."""
    text = ("run", "url", "date", "record_type", "payload_digest")
    names = ["run", "offset", "length", "page_id", "url", "date", "record_type", "payload_digest", "payload_bytes", "refers_to"]
    schema = ", ".join(f"{n} {'string' if n in text else 'long'}" for n in names)
    types = [pa.string() if n in text else pa.int64() for n in names]

    def number(x):
        return int(x[10:-1]) if x and x != "<urn:page:>" else None

    def described(path, at, length, head, block):
        http, _, payload = block.partition(END.encode())
        said = head["WARC-Payload-Digest"].removeprefix("sha1:")
        if head["WARC-Type"] == "revisit":
            digest, size = said, int(http.rpartition(b"Content-Length: ")[2])
        else:
            digest, size = hashlib.sha1(payload).hexdigest(), len(payload)
            if digest != said:
                raise ValueError(f"the payload at byte {at} of {path} does not have its digest")
        about = number(head["WARC-Record-ID"]), head.get("WARC-Target-URI"), head["WARC-Date"], head["WARC-Type"]
        return path, at, length, *about, digest, size, number(head.get("WARC-Refers-To"))

    def run(batches):
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                rows = [described(path, *record) for record in walk(content.as_py())]
                columns = zip(*rows, strict=True) if rows else [()] * len(names)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").option("recursiveFileLookup", "true").load(folder)
    return files.select("path", "content").mapInArrow(run, schema)


class LoserTree:
    """Merges sorted runs: each inner node keeps the loser of its match, the overall winner stands at the top."""

    def __init__(self, runs: list[list]):
        self.runs, self.at, k = runs, [0] * len(runs), len(runs)
        self.k, self.tree = k, [-1] * max(1, k)
        for r in range(k):
            self._climb(r, building=True)

    def _key(self, r: int):
        """The next key of a run; runs that have ended lose to all."""
        i = self.at[r]
        return (0, self.runs[r][i], r) if i < len(self.runs[r]) else (1, None, r)

    def _less(self, a: int, b: int) -> bool:
        x, y = self._key(a), self._key(b)
        return x[0] < y[0] if x[0] != y[0] else x[0] == 0 and x[1:] < y[1:]

    def _climb(self, r: int, building: bool = False) -> None:
        node = (r + self.k) // 2
        while node:
            other = self.tree[node]
            if building and other < 0:
                self.tree[node] = r
                return
            if self._less(other, r):
                self.tree[node], r = r, other
            node //= 2
        self.tree[0] = r

    def __iter__(self):
        """(run, place in the run) of all items, in order."""
        if not self.k:
            return
        while True:
            r = self.tree[0]
            if self.at[r] >= len(self.runs[r]):
                return
            yield r, self.at[r]
            self.at[r] += 1
            self._climb(r)


def merge(index: DataFrame, per_range: int = PER_RANGE) -> DataFrame:
    """The captures in global order of (urlkey, date, page_id): its partitions, one after another, are ordered.

    ``index`` is counted first, so that each range has about ``per_range`` rows.
    """
    schema = index.schema

    def run(batches):
        held = [b for b in batches if len(b)]
        if not held:
            return
        table = pa.Table.from_batches(held).combine_chunks()
        name = table.column("run").to_numpy(zero_copy_only=False)
        keys = list(zip(table.column("urlkey").to_pylist(), table.column("date").to_pylist(), [(x is not None, x or 0) for x in table.column("page_id").to_pylist()], strict=True))
        starts = np.append(np.flatnonzero(np.append(True, name[1:] != name[:-1])), len(name)).tolist()
        runs = [keys[a:b] for a, b in zip(starts[:-1], starts[1:], strict=True)]
        order = [starts[r] + i for r, i in LoserTree(runs)]
        yield from table.take(pa.array(order)).to_batches(max_chunksize=10_000)

    ranges = max(1, -(-index.count() // per_range))
    dealt = index.repartitionByRange(ranges, "urlkey", "date", F.col("page_id").asc_nulls_first(), "run", "offset")
    return dealt.sortWithinPartitions("run", "offset").mapInArrow(run, schema)


def archive(pages: DataFrame, folder: str | None = None, per_file: int = PER_FILE, per_bytes: int = PER_BYTES, per_range: int = PER_RANGE, **options) -> DataFrame:
    """Writes all pages as WARC files to ``folder`` (by default a new one in the shared folder) and returns their merged index."""
    spark = pages.sparkSession
    folder = folder or f"{shared_folder(spark)}/warc-{uuid.uuid4().hex}"
    write(records(pages, **options), folder, per_file, per_bytes)
    return merge(cut(captures(spark, folder).withColumn("urlkey", url_key(F.col("url")))), per_range)
