"""Main text of web pages, by differencing each page against the pages with the nearest URLs.

Each page is cut into text lines, one for each block, with the region that it stands in. Pages of a host whose lines are
all equal are one page here. Pages are ordered by (host, path) and held against the up to ``REACH`` pages before and behind
of the same host; the one whose path has most in common from the start is the nearest (then the closer one, then the one
before). Lines are aligned by longest common subsequence with each of the ``VOTERS`` nearest, but for a page that shares more
than half of the text in long lines (over ``LONG`` characters): that is a copy with changes, not a page of the same template.
A line is shared if at least half of these pages have it in the alignment; so one odd page does not decide. If there are
none, nothing is shared.

What goes: where a page marks no article, every shared line. In an ``article`` or ``main`` element, lines at its edges,
before the first and behind the last line of its own, that nearly all of at least ``ENOUGH`` pages share and that are no
sentence (up to ``SHORT`` words and no full stop, exclamation or question mark at the end) and no heading; a shared line
between own lines is a quotation, a shared heading or sentence the article's. And whatever else the difference says: lines
outside of a page's articles, and menus, forms, asides, notices, adverts, reader comments, headers and footers that are
marked as such, since such lines may differ from page to page. A word marks a region if it is a whole name in a class, id
or role, but for words about place and kind around it (``site-footer``, ``comment-list``; not ``with-sidebar``). A region
that the page's first article or main element stands in is no such region, but for elements that are asides by name.

Only hashes of lines are shuffled: by host, then by ranges of (host, path), so that a hot host is spread over many tasks.
Ranks over all ranges then deal the pages into blocks with a border on both sides, so the result does not depend on the
number of partitions. Lines that go are sent back to the pages, in a broadcast if they are few.

Defined results: a null or empty html has an empty text, as has a page of nothing but template; a null or odd url has an
empty host and path; ids may be null or repeat, every row gives a row; an unclosed region ends with the article or page
that it began in; a ``<`` is text if no ``>`` closes it before the next ``<``; a quote in a tag that does not end before a
space, ``/`` or ``>`` is no quote. Pages are read in one pass. Further columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import bisect
import html as references
import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bendscape.llm.common import cut, listed
from bendscape.llm.url_templates import host_of, path_of

#: Pages on each side that a page may be held against; pages in a block.
REACH, BLOCK = 8, 4096
#: Characters over which a line is long; words up to which one may be no sentence.
LONG, SHORT = 80, 6
#: Pages that vote on shared lines at most; how many must vote on an article's lines at least.
VOTERS, ENOUGH = 8, 3

#: Elements whose content is no text.
RAW = ("script", "style", "noscript", "template", "svg", "math", "iframe", "object", "canvas", "head", "title", "textarea", "select", "video", "audio")
#: Elements whose content is not the article's.
ASIDE = frozenset(("nav", "aside", "footer", "form", "menu", "dialog", "button", "fieldset"))
BLOCKS = frozenset(
    "address article aside blockquote body br dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split()
)
HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))
#: Elements that are asides by name, also around an article.
NAMED = ASIDE - {"form", "fieldset"}
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Words that as a whole name in class, id or role mark a region as not the article's, and what may stand around them.
_WORDS = "ads? adverts? advertisement advertising adsense banner breadcrumbs? comments? complementary consent contentinfo cookies? copyright disqus footer gdpr login masthead menu modal nav navbar navigation newsletter notices? pagination popup promo promotion recommended related replies reply respond share sharing sidebar signup site-?header social sponsor sponsored subscribe toolbar widget".split()
_BEFORE = "(?:(?:site|page|main|top|bottom|global|left|right|primary|secondary|cookie|user|reader|post)[-_])?"
_AFTER = "(?:[-_]?(?:list|box|bar|banner|body|area|wrapper|container|block|section|slot|widget|links?|items?|menu|form|thread|[0-9]+))*"
MARKED = re.compile(rf"(?<!\S){_BEFORE}(?:{'|'.join(_WORDS)}){_AFTER}(?!\S)")
REMARK = re.compile(rf"(?<!\S){_BEFORE}(?:comments?|reply|replies){_AFTER}(?!\S)")
_NAME = re.compile(r"(/?)([a-zA-Z][a-zA-Z0-9:-]*)")
#: The rest of a tag, up to its end or to what cannot stand in it.
_REST = re.compile(r"(?:[^<>\"']++|\"[^\"]*+\"(?=[\s/>])|'[^']*+'(?=[\s/>]))*+")
_CLOSING = {name: re.compile(rf"</{name}\s*>", re.IGNORECASE) for name in RAW}
_ATTRIBUTE = re.compile(r"(?:^|\s)(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.IGNORECASE)


def tags(page: str):
    """(start, end, name, whether it closes, attributes) of each tag; raw elements and comments have no attributes (None).

    Every search starts where the last one ended, or is made once: where no quote or ``>`` is left, none is sought again.
    """
    at, n = 0, len(page)
    quotes = True
    while (start := page.find("<", at)) >= 0:
        if page.startswith("<!--", start):
            end = page.find("-->", start + 4)
            at = n if end < 0 else end + 3
            yield start, at, "", False, None
            continue
        if page.startswith(("<!", "<?", "</"), start) and not _NAME.match(page, start + 1):
            end = page.find(">", start)
            if end < 0:
                return
            at = end + 1
            yield start, at, "", False, None
            continue
        m = _NAME.match(page, start + 1)
        if not m:
            at = start + 1
            continue
        end = _REST.match(page, m.end()).end() if quotes else n
        if end < n and page[end] in "\"'" or not quotes:
            quotes = quotes and page.find(page[end], end + 1) >= 0
            end = page.find(">", m.end())
            if end < 0:
                return
        elif end == n or page[end] == "<":
            at = end
            continue
        name, attributes, at = m[2].lower(), page[m.end() : end], end + 1
        if name in _CLOSING and not m[1]:
            if not attributes.endswith("/"):
                close = _CLOSING[name].search(page, at)
                at = close.end() if close else n
            attributes = None
        yield start, at, name, bool(m[1]), attributes


def lines(page: str | None) -> list[tuple[str, bool, bool, bool]]:
    """(text, in an article, in a marked region, a heading) of the blocks of a page, without empty ones."""
    page = page or ""
    out: list[tuple[str, bool, bool, bool]] = []
    held: list[str] = []
    main: list[str] = []  # open article and main elements
    region: str | None = None  # name of the element that opened the marked region
    depth, opened_in = 0, 0
    lifts = seen = heading = False  # an article may lift the region; one was seen outside of regions; in a heading

    def flush() -> None:
        if held:
            text = " ".join(references.unescape("".join(held)).split())
            if text:
                out.append((text, bool(main), region is not None, heading))
            held.clear()

    at = 0
    for start, end, name, closes, attributes in tags(page):
        if start > at:
            held.append(page[at:start])
        at = end
        if attributes is None:
            if name in ("head", "title"):
                flush()
            continue
        if name in BLOCKS:
            flush()
        if name in HEADINGS:
            heading = not closes
        if name in VOID:
            continue
        if closes:
            if name in ("article", "main") and name in main:
                while main.pop() != name:
                    pass
                if region is not None and len(main) < opened_in:
                    region = None
            elif name in ("body", "html"):
                region = None
            if region is not None and name == region:
                depth -= 1
                if not depth:
                    region = None
        elif region is not None and not (lifts and not seen and name in ("article", "main")):
            if name == region:
                depth += 1
            if name in ("article", "main"):
                main.append(name)
        else:
            marked = " ".join(x for g in _ATTRIBUTE.findall(attributes) for x in g if x).lower() if attributes else ""
            if name in ("article", "main"):
                aside = bool(marked) and REMARK.search(marked) is not None
                if region is not None and aside:
                    depth += name == region
                    main.append(name)
                    continue
                region, heading, seen = None, False, seen or not aside
                main.append(name)
            elif name in ("body", "html", "h1"):
                aside = False
            else:
                aside = name in ASIDE or (name == "header" and not main) or bool(marked) and MARKED.search(marked) is not None
            if aside and not attributes.endswith("/"):
                region, depth, opened_in = name, 1, len(main)
                lifts = name not in NAMED and not REMARK.search(marked)
    held.append(page[at:])
    flush()
    return out


def aligned(a: list, b: list) -> set[int]:
    """Places in ``a`` of a longest common subsequence with ``b``."""
    start, end_a, end_b = 0, len(a), len(b)
    while start < min(end_a, end_b) and a[start] == b[start]:
        start += 1
    while start < min(end_a, end_b) and a[end_a - 1] == b[end_b - 1]:
        end_a, end_b = end_a - 1, end_b - 1
    where: dict[object, list[int]] = {}
    for j in range(end_b - 1, start - 1, -1):
        where.setdefault(b[j], []).append(j)
    tails: list[int] = []  # the smallest place in b that ends a common subsequence of each length
    chains: list[tuple] = []
    for i in range(start, end_a):
        for j in where.get(a[i], ()):
            k = bisect.bisect_left(tails, j)
            chain = (i, chains[k - 1] if k else None)
            if k == len(tails):
                tails.append(j)
                chains.append(chain)
            else:
                tails[k], chains[k] = j, chain
    out = {*range(start), *range(end_a, len(a))}
    chain = chains[-1] if chains else None
    while chain:
        out.add(chain[0])
        chain = chain[1]
    return out


def _common(a: str, b: str) -> int:
    n = min(len(a), len(b))
    return next((i for i in range(n) if a[i] != b[i]), n)


#: What is known of a line without its text: it is long; it is in an article; it is in a marked region; it is no sentence; it is a heading.
IS_LONG, IN_ARTICLE, IS_MARKED, NO_SENTENCE, IS_HEADING = 1, 2, 4, 8, 16


def described(page: str | None) -> tuple[list[str], list[int], list[int], list[int]]:
    """Texts, hashes, lengths and kinds of a page's lines."""
    found = lines(page)
    texts = [f[0] for f in found]
    kinds = [IS_LONG * (len(t) > LONG) | IN_ARTICLE * m | IS_MARKED * r | NO_SENTENCE * (t[-1] not in ".!?…" and len(t.split()) <= SHORT) | IS_HEADING * h for t, m, r, h in found]
    return texts, [xxhash.xxh64_intdigest(t) for t in texts], [len(t) for t in texts], kinds


def kept(kinds: list[int]) -> list[int]:
    """Places of the lines that markup leaves."""
    whole = any(k & IN_ARTICLE and not k & IS_MARKED for k in kinds)
    return [i for i, k in enumerate(kinds) if not k & IS_MARKED and (k & IN_ARTICLE or not whole)]


def shared(hashes: list, sizes: list[int], kinds: list[int], others) -> tuple[set[int], set[int]]:
    """Places of the lines that at least half of the nearest other pages (hashes) have too that are no copies; and of those
    that nine tenths of them have, where they are ``ENOUGH``."""
    long = [i for i, k in enumerate(kinds) if k & IS_LONG]
    total = sum(sizes[i] for i in long)
    votes, voters = [0] * len(hashes), 0
    for other in others:
        same = aligned(hashes, other)
        if 2 * sum(sizes[i] for i in long if i in same) <= total and len(same) < len(hashes):
            voters += 1
            for i in same:
                votes[i] += 1
            if voters == VOTERS:
                break
    half = {i for i, v in enumerate(votes) if v and 2 * v >= voters}
    return half, {i for i in half if voters >= ENOUGH and 10 * votes[i] >= 9 * voters}


def gone(kinds: list[int], same: set[int], often: set[int]) -> list[int]:
    """Which of the lines that markup leaves go, by their places among these."""
    left = kept(kinds)
    if not any(kinds[i] & IN_ARTICLE for i in left):
        return [k for k, i in enumerate(left) if i in same]
    own = [k for k, i in enumerate(left) if i not in often or not kinds[i] & NO_SENTENCE or kinds[i] & IS_HEADING]
    return [k for k in range(len(left)) if not own or k < own[0] or k > own[-1]]


def partners(rows: list[tuple], i: int) -> list[int]:
    """Places of the pages that page ``i`` of the ordered ``rows`` (host, path, ...) is held against, the nearest first."""
    host, path = rows[i][:2]
    near = [j for j in range(max(0, i - REACH), min(len(rows), i + REACH + 1)) if j != i and rows[j][0] == host]
    return sorted(near, key=lambda j: (-_common(path, rows[j][1]), abs(j - i), j))


def differences(pages: DataFrame) -> DataFrame:
    """(host, digest, gone): which lines of a page go, where any do, from (host, path, html)."""
    described_as = "host string, path string, digest long, hashes array<long>, sizes array<int>, kinds array<int>"

    def describe(batches):
        for batch in batches:
            found = [described(p) for p in batch.column(2).to_pylist()]
            hashes = [np.array(x[1], dtype=np.uint64).view(np.int64) for x in found]
            columns = [batch.column(0), batch.column(1), pa.array([digest_of(x[1], x[3]) for x in found], pa.int64()), pa.array(hashes, pa.list_(pa.int64())), pa.array([x[2] for x in found], pa.list_(pa.int32())), pa.array([x[3] for x in found], pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays(columns, names=["host", "path", "digest", "hashes", "sizes", "kinds"])

    rows = pages.select("host", "path", "html").mapInArrow(describe, described_as)
    rows = rows.groupBy("host", "digest").agg(F.min("path").alias("path"), *[F.any_value(c).alias(c) for c in ("hashes", "sizes", "kinds")])
    order = ("host", "path", "digest")
    rows = cut(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id()).withColumn("at", F.monotonically_increasing_id() % (1 << 33)))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each partition
    offsets = rows.groupBy("part").agg(F.count("*").alias("n")).select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    ranked = rows.join(F.broadcast(offsets), "part").withColumn("rank", F.col("at") + F.col("offset"))
    block, place = F.floor(F.col("rank") / BLOCK), F.col("rank") % BLOCK
    blocks = F.filter(F.array(block, F.when(place < REACH, block - 1), F.when(place >= BLOCK - REACH, block + 1)), lambda b: b.isNotNull())
    dealt = ranked.select("host", "path", "digest", "hashes", "sizes", "kinds", "rank", F.explode(blocks).alias("block"))
    dealt = dealt.repartition("block").sortWithinPartitions("block", "rank")

    def compare(batches):
        held: list[tuple] = []  # the rows of one block and its borders
        for batch in batches:
            out = []
            for row in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if held and held[-1][7] != row[7]:
                    out += settled(held)
                    held = []
                held.append(row)
            yield record(out)
        yield record(settled(held))

    def settled(rows):
        for i, (host, _, digest, hashes, sizes, kinds, rank, number) in enumerate(rows):
            if rank // BLOCK == number and (going := gone(kinds, *shared(hashes, sizes, kinds, (rows[j][3] for j in partners(rows, i))))):
                yield host, digest, going

    def record(out):
        columns = list(zip(*out, strict=True)) or [(), (), ()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.list_(pa.int32())), strict=True)], names=["host", "digest", "gone"])

    return dealt.mapInArrow(compare, "host string, digest long, gone array<int>")


def digest_of(hashes: list[int], kinds: list[int]) -> int:
    """A signed 64-bit number for the lines of a page."""
    return int(np.uint64(xxhash.xxh64_intdigest(np.array([hashes, kinds], dtype=np.uint64).tobytes())).view(np.int64))


def extract(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """(key, url, text): the main text of each page."""
    rows = pages.select(F.col(key).alias("key"), F.col(url).alias("url"), F.col(html).alias("html"), host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"))
    schema = T.StructType([rows.schema["key"], T.StructField("url", T.StringType()), T.StructField("host", T.StringType()), T.StructField("digest", T.LongType()), T.StructField("left", T.ArrayType(T.StringType()))])

    def run(batches):
        for batch in batches:
            found = [described(p) for p in batch.column(2).to_pylist()]
            left = pa.array([[x[0][i] for i in kept(x[3])] for x in found], pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(3), pa.array([digest_of(x[1], x[3]) for x in found], pa.int64()), left], names=schema.names)

    cleared = rows.select("key", "url", "html", "host").mapInArrow(run, schema)
    met = cleared.join(listed(differences(rows)), ["host", "digest"], "left")
    own = F.when(F.col("gone").isNull(), F.col("left")).otherwise(F.filter("left", lambda x, i: ~F.array_contains("gone", i)))
    return met.select(F.col("key").alias(key), F.col("url").alias(url), F.array_join(own, "\n").alias("text"))
