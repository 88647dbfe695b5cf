"""Benchmark decontamination by winnowing.

Words are runs of ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]`` after A-Z is lower-cased. A window is ``length`` consecutive
words of a benchmark item; an item of fewer words, but not none, is one window. In every window of a text the smallest
hash of ``gram`` consecutive words (the leftmost of equal ones) is its fingerprint, so a window that stands in a
document too has the same fingerprint there: no shared span of ``length`` words can be missed. Document fingerprints are
joined to benchmark fingerprints; each hit is extended to the windows that chose it, whose own hashes are joined to the
benchmark's windows. All hashes have 64 bits.

The benchmark is aggregated to distinct windows first, so repeated items cost nothing. Up to ``BOUND`` distinct
benchmark windows the tasks that read the documents get the fingerprints (8 bytes each) and pass on hits only; beyond,
documents' fingerprints are shuffled to meet them. Both ways give the same rows.

Defined results: a null or empty text has no words, is never contaminated and is never a window; an item with a null id
counts for n_hit but is not listed; rows of documents that repeat both id and text give one row; rows with one id and
different texts, or a null id, give a row each. Further columns are ignored. An empty benchmark hits nothing.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bendscape.llm.common import ALNUM, LOWER, between, blocks, byte_values, cut, fresh, listed, prefix, sliding_argmin, spans, texts

LENGTH = 13
GRAM = 5
BOUND = 1 << 20


class Words:
    """Hashes of the words of some texts."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        data = LOWER[data]
        start, end, self.first = spans(data, offsets, ALNUM)
        hashes = between(prefix(byte_values(data)), start, end)
        self.sums = prefix(hashes)
        self.text = np.repeat(np.arange(len(offsets) - 1), np.diff(self.first))
        self.counts = np.diff(self.first)

    def windows(self, length: int, gram: int, wanted: np.ndarray | None, seen: np.ndarray | None):
        """(text, start, fingerprint) of the windows inside texts whose fingerprint is wanted (None: of all)."""
        n = len(self.text) - length + 1
        if n <= 0:
            return (np.zeros(0, np.int64),) * 2 + (np.zeros(0, np.uint64),)
        at = np.arange(len(self.text) - gram + 1)
        grams = between(self.sums, at, at + gram)
        ok = self.text[:n] == self.text[length - 1 :]
        place = sliding_argmin(grams, length - gram + 1)
        if wanted is not None:
            hit = seen[grams & np.uint64(len(seen) - 1)]
            some = np.flatnonzero(hit)
            hit[some] = np.isin(grams[some], wanted)
            ok &= hit[place]
        start = np.flatnonzero(ok)
        return self.text[start], start, grams[place[start]]


def _gram(length: int, gram: int) -> int:
    return min(gram, length)


def fingerprints(rows: DataFrame, lengths: list[int], gram: int = GRAM, wanted: np.ndarray | None = None) -> DataFrame:
    """(id, h, n_words, length, start, fp, windows) of rows (id, h, text).

    A row without a fingerprint for each text, with its n_words; and a row for each fingerprint: the first window that
    chose it and the hashes of the consecutive windows that did.
    """
    schema = T.StructType([rows.schema["id"], rows.schema["h"]])
    for name, kind in (("n_words", "long"), ("length", "integer"), ("start", "integer"), ("fp", "long")):
        schema.add(name, kind)
    schema.add("windows", T.ArrayType(T.LongType(), False))
    names = schema.names
    shared = None
    if wanted is not None:
        seen = np.zeros(1 << max(16, int(4 * len(wanted) + 1).bit_length()), dtype=bool)
        seen[wanted & np.uint64(len(seen) - 1)] = True
        shared = rows.sparkSession.sparkContext.broadcast((wanted, seen))

    def run(batches):
        want, seen = shared.value if shared else (None, None)
        for batch in batches:
            data, offsets = texts(batch.column(2))
            for i, j in blocks(offsets):
                w = Words(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                null = lambda kind, n=j - i: pa.nulls(n, kind)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), batch.column(1).slice(i, j - i), pa.array(w.counts), null(pa.int32()), null(pa.int32()), null(pa.int64()), null(pa.list_(pa.int64()))], names=names)
                for length in lengths:
                    text, start, fp = w.windows(length, _gram(length, gram), want, seen)
                    if not len(text):
                        continue
                    hashes = between(w.sums, start, start + length)
                    new = np.ones(len(text), dtype=bool)
                    new[1:] = (fp[1:] != fp[:-1]) | (start[1:] != start[:-1] + 1) | (text[1:] != text[:-1])
                    at = np.flatnonzero(new)
                    ids = pa.array(text[at] + i)
                    listed = pa.ListArray.from_arrays(pa.array(np.append(at, len(text)).astype(np.int32)), pa.array(hashes.view(np.int64)))
                    place = (start - w.first[text])[at].astype(np.int32)
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(ids), batch.column(1).take(ids), pa.nulls(len(at), pa.int64()), pa.array(np.full(len(at), length, np.int32)), pa.array(place), pa.array(fp[at].view(np.int64)), listed], names=names)

    return rows.select("id", "h", "text").mapInArrow(run, schema)


def _rows(df: DataFrame, key: str, text: str) -> DataFrame:
    return df.select(F.col(key).alias("id"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("h"), F.col(text).alias("text"))


def benchmark_windows(benchmark: DataFrame, length: int = LENGTH, gram: int = GRAM, key: str = "item_id", text: str = "text") -> DataFrame:
    """(window, length, fp, items): the distinct windows of a benchmark, and the sorted ids (as strings) of their items."""
    rows = _rows(benchmark, key, text)
    counted = fingerprints(rows, []).groupBy("id", "h").agg(F.max("n_words").alias("n"))
    whole = rows.join(counted.where(f"n >= {length}").select("id", "h"), on=[rows["id"].eqNullSafe(counted["id"]), rows["h"] == counted["h"]], how="left_semi")
    found = fingerprints(whole, [length], gram).where("fp is not null")
    short = rows.join(counted.where(f"n between 1 and {length - 1}").select("id", "h"), on=[rows["id"].eqNullSafe(counted["id"]), rows["h"] == counted["h"]], how="left_semi")
    found = found.unionByName(fingerprints(short, list(range(1, length)), gram).where("fp is not null").join(counted.select(F.col("id").alias("i2"), F.col("h").alias("h2"), "n"), on=F.col("id").eqNullSafe(F.col("i2")) & (F.col("h") == F.col("h2")) & (F.col("length") == F.col("n")), how="left_semi"))
    flat = found.select("id", "length", "fp", F.explode("windows").alias("window"))
    return flat.groupBy("window", "length").agg(F.first("fp").alias("fp"), F.array_sort(F.collect_set(F.col("id").cast("string"))).alias("items"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, length: int = LENGTH, gram: int = GRAM, percent: int = 5, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text", bound: int = BOUND) -> DataFrame:
    """(key, h, n_words, n_hit, items, contaminated): each document's words inside benchmark windows.

    ``h`` is a hash of the text, which tells rows of one key apart. ``contaminated``: ``n_hit`` is over 0 and at least
    ``percent`` of ``n_words``.
    """
    known = cut(benchmark_windows(benchmark, length, gram, item_key, item_text))
    lengths = [r[0] for r in known.select("length").distinct().collect()]  # at most ``length`` numbers
    prints = known.select("fp").distinct()
    few = np.asarray(prints.limit(bound + 1).toArrow().column(0).combine_chunks(), dtype=np.int64).view(np.uint64) if lengths else np.zeros(0, np.uint64)
    wanted = few if len(few) <= bound else None
    rows = fingerprints(_rows(docs, key, text), lengths, gram, wanted)
    base = rows.where("fp is null").select("id", "h", "n_words")
    hits = rows.where("fp is not null")
    if wanted is None:
        hits = hits.join(prints, "fp", "left_semi")
    flat = hits.select("id", "h", "length", "start", F.posexplode("windows").alias("k", "window"))
    met = flat.join(known.select("window", "length", "items"), ["window", "length"]).select("id", "h", (F.col("start") + F.col("k")).alias("start"), (F.col("start") + F.col("k") + F.col("length")).alias("end"), "items")
    both = base.withColumns({"start": F.lit(None).cast("int"), "end": F.lit(None).cast("int"), "items": F.lit(None).cast("array<string>")}).unionByName(met.withColumn("n_words", F.lit(None).cast("long")))
    grouped = both.groupBy("id", "h").agg(
        F.max("n_words").alias("n_words"),
        F.array_sort(F.collect_list(F.when(F.col("start").isNotNull(), F.struct("start", "end")))).alias("spans"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"),
    )
    zero = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("reach"))
    step = lambda acc, s: F.struct((acc["n"] + F.greatest(F.lit(0), s["end"] - F.greatest(acc["reach"], s["start"]))).alias("n"), F.greatest(acc["reach"], s["end"]).alias("reach"))
    out = grouped.select(F.col("id").alias(key), "h", "n_words", F.aggregate("spans", zero, step, lambda acc: acc["n"]).alias("n_hit"), "items")
    return out.withColumn("contaminated", (F.col("n_hit") > 0) & (100 * F.col("n_hit") >= percent * F.col("n_words")))


def clean(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """``docs`` without the contaminated ones."""
    k, h = fresh(docs.columns, "key", "h")
    bad = listed(decontaminate(docs, benchmark, key=key, text=text, **options).where("contaminated").select(F.col(key).alias(k), F.col("h").alias(h)))
    return docs.join(bad, F.col(key).eqNullSafe(F.col(k)) & (F.xxhash64(F.coalesce(F.col(text), F.lit(""))) == F.col(h)), "left_anti")
