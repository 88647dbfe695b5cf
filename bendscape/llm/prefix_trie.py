"""The prefix trie of conversations: what each beginning is shared by, and what storing it once would save.

Turns are numbered by a dictionary, so a conversation is a string over integers, kept in blocks of 32. Strings are sorted
by radix, most significant digit first: a bucket of conversations that begin alike is split by its next turn in one
shuffle, after the stretch that all of it shares has been skipped, and its parts are split again until one has at most
65,536 members and turns left. Such a bucket goes to one task, which finishes it by multikey quicksort; each group of equal
digits that the recursion meets is a node. A conversation that is alone in its bucket is a chain of nodes, and needs no
sort. Sums over subtrees go up from round to round.

So no task holds more than a small bucket, however many conversations begin alike: counts, smallest members and common
stretches of a large bucket are combined before the shuffle, and the hash of the members that end at one of its nodes is
made from pieces that were sorted by range.

A null role or text is an empty one. Turns are ordered by ``turn``, null first, and by a digest of role and text where
that ties; repeated rows are turns of their own. Rows without a conversation id belong to none and are left out. Turns are
told apart by SHA-256. An empty table gives no rows. Further columns are not read. Ids are integers; others raise a TypeError.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bendscape.llm.common import cut, listed

#: Turns in a block of a conversation.
BLOCK = 32
#: Members and turns left of a bucket that one task finishes.
LOCAL = 1 << 16
EMPTY = hashlib.sha256(b"").hexdigest()
NODE = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"


def _long(c: Column | int) -> Column:
    return (c if isinstance(c, Column) else F.lit(c)).cast("long")


def ordered(conversations: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(c, pos, id, chars): each turn's place in its conversation, from 0, its number in the dictionary and the code points of its text.

    Rows are sorted by range, so that a conversation with very many turns is spread over tasks; where it is, the turns in
    the ranges before are added.
    """
    if conversations.schema[conv].dataType.typeName() not in ("byte", "short", "integer", "long"):
        raise TypeError(f"{conv} must be an integer column")
    parts = int(conversations.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    said = lambda c: F.coalesce(F.col(c), F.lit(""))
    digest = F.unhex(F.sha2(F.concat(F.octet_length(said(role)).cast("string"), F.lit(":"), said(role), said(text)), 256))
    rows = conversations.where(F.col(conv).isNotNull()).select(_long(F.col(conv)).alias("c"), F.col(turn).alias("turn"), digest.alias("key"), F.length(said(text)).cast("long").alias("chars"))
    order = ("c", F.col("turn").asc_nulls_first(), "key")
    rows = cut(rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).select("c", "key", "chars", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("at")))
    # Of a range only the first and the last conversation may go on in others, so this is short.
    spans = rows.groupBy("c", "part").agg(F.count("*").alias("n"))
    cut_up = spans.join(spans.groupBy("c").agg(F.count("*").alias("parts")).where("parts > 1").select("c"), "c", "left_semi")
    before = cut_up.select("c", "part", (F.sum("n").over(Window.partitionBy("c").orderBy("part")) - F.col("n")).alias("before"))
    place = F.row_number().over(Window.partitionBy("c", "part").orderBy("at")) - 1
    placed = rows.withColumn("place", place).join(F.broadcast(before), ["c", "part"], "left").select("c", (_long(F.col("place")) + F.coalesce("before", _long(0))).alias("pos"), "key", "chars")
    numbers = cut(rows.groupBy("key").agg(F.max("chars").alias("n")).select("key", F.monotonically_increasing_id().alias("id")))
    return placed.join(numbers, "key").select("c", "pos", "id", "chars")


def shared_heads(turns: DataFrame, every: int = 100, most: int = 5) -> tuple[DataFrame, DataFrame]:
    """Conversations rebuilt as (c, pos, id, chars), and (c, len), turnless ones too.

    The first crc32(c) % (most + 1) turns are those of conversation c - c % every (all if it has fewer, none if it isn't
    there), then come its own after as many.
    """
    h = F.crc32(F.col("c").cast("string")) % (most + 1)
    own = cut(turns)
    one = F.struct("pos", "id", "chars")
    heads = own.where((F.col("c") % every == 0) & (F.col("pos") < most)).groupBy(F.col("c").alias("base")).agg(F.sort_array(F.collect_list(one)).alias("head"))
    sizes = own.groupBy("c").agg(F.count("*").alias("n")).withColumn("base", F.col("c") - F.col("c") % every)
    head = F.slice(F.coalesce("head", F.array().cast("array<struct<pos:bigint,id:bigint,chars:bigint>>")), F.lit(1), h.cast("int"))
    convs = sizes.join(heads, "base", "left").select("c", "n", h.alias("h"), head.alias("head"))
    convs = cut(convs.withColumn("k", _long(F.size("head"))).withColumn("len", F.col("k") + F.greatest(F.col("n") - F.col("h"), _long(0))))
    first = convs.select("c", F.explode("head").alias("_t")).select("c", "_t.pos", "_t.id", "_t.chars")
    rest = own.join(convs.select("c", "h", "k"), "c").where("pos >= h").select("c", (F.col("pos") - F.col("h") + F.col("k")).alias("pos"), "id", "chars")
    return first.unionByName(rest), convs.select("c", "len")


def finish(members: list[tuple[int, list[int], list[int]]], depth: int, parent: int | None, chars: int) -> list[list]:
    """The nodes of a bucket whose members (conversation, turns left, their code points) share ``depth`` turns, itself first.

    Multikey quicksort: a group is parted by its next turn into less, equal and more; the equal ones are a node.
    """
    nodes: list[list] = []
    stack = []

    def node(group, depth: int, at: int, up: int | None, chars: int):
        """Adds a node for ``group``, whose members share all up to turn ``at``, and leaves the rest to be split."""
        ends = sorted(m[0] for m in group if len(m[1]) == at)
        low = min(m[0] for m in group)
        if up is not None:
            nodes[up][4] += 1
        nodes.append([low, depth, parent if up is None else nodes[up][0], len(group), 0, 0, (len(group) - 1) * chars, ends, up])
        if len(ends) < len(group):
            stack.append(([m for m in group if len(m[1]) > at], at, len(nodes) - 1))

    node(members, depth, 0, None, chars)
    while stack:
        group, at, up = stack.pop()
        pivot = group[len(group) // 2][1][at]
        less, equal, more = [], [], []
        for m in group:
            digit = m[1][at]
            (equal if digit == pivot else less if digit < pivot else more).append(m)
        stack.extend((part, at, up) for part in (less, more) if part)
        node(equal, nodes[up][1] + 1, at + 1, up, equal[0][2][at])
    for n in reversed(nodes):  # nodes come after their parents
        n[5] = n[5] or 1
        if n[8] is not None:
            nodes[n[8]][5] += n[5]
            nodes[n[8]][6] += n[6]
    return nodes


def _finished(local: DataFrame, blocks: DataFrame) -> DataFrame:
    """The nodes of small buckets (c, b, d, parent, chars); ``top`` marks the bucket's own."""
    near = F.col("l.c").eqNullSafe(F.col("k.c")) & (F.col("k.block") >= F.floor(F.col("l.d") / BLOCK))
    rows = local.alias("l").join(blocks.alias("k"), near, "left").select("l.b", "l.c", "l.d", "l.parent", "l.chars", "k.block", "k.ids", F.col("k.chars").alias("sizes"))
    dealt = rows.repartition("b").sortWithinPartitions("b", "c", "block")

    def run(batches):
        bucket, members, out = None, [], []

        def close():
            b, d, parent, chars = bucket
            for i, n in enumerate(finish(members, d, parent, chars)):
                out.append((*n[:7], hashlib.sha256(",".join(map(str, n[7])).encode()).hexdigest(), i == 0))

        def done():
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=names)

        for batch in batches:
            for b, c, d, parent, chars, block, ids, sizes in zip(*(batch.column(k).to_pylist() for k in range(8)), strict=True):
                if bucket is None or bucket[0] != b:
                    if bucket:
                        close()
                        if len(out) > 1 << 15:
                            yield done()
                            out = []
                    bucket, members = (b, d, parent, chars), []
                if not members or members[-1][0] != c:
                    members.append((c, [], []))
                if ids:
                    skip = max(0, d - block * BLOCK)
                    members[-1][1].extend(ids[skip:])
                    members[-1][2].extend(sizes[skip:])
        if bucket:
            close()
            yield done()

    names = [f.split()[0] for f in NODE.split(", ")] + ["top"]
    kinds = [pa.int64()] * 7 + [pa.string(), pa.bool_()]
    return dealt.mapInArrow(run, NODE + ", top boolean")


def _chains(alone: DataFrame, blocks: DataFrame) -> DataFrame:
    """The nodes from ``depth`` on of conversations (c, depth, parent, len) that share these with no other."""
    near = (F.col("a.c") == F.col("k.c")) & (F.col("k.block") >= F.floor((F.col("a.depth") - 1) / BLOCK))
    rows = alone.alias("a").join(blocks.alias("k"), near).select("a.c", "a.parent", "a.len", F.col("a.depth").alias("first"), F.posexplode("k.ids").alias("i", "id"), "k.block")
    rows = rows.withColumn("depth", _long(F.col("block") * BLOCK + F.col("i") + 1)).where("depth >= first")
    last = F.col("depth") == F.col("len")
    return rows.select(
        F.col("c").alias("conv_id"), "depth", F.when(F.col("depth") == F.col("first"), F.col("parent")).otherwise(F.col("c")).alias("parent_conv_id"), _long(1).alias("n_convs"),
        _long(F.when(last, 0).otherwise(1)).alias("n_children"), _long(1).alias("n_leaves"), _long(0).alias("saved_tokens"), F.when(last, F.sha2(F.col("c").cast("string"), 256)).otherwise(F.lit(EMPTY)).alias("ends_sha256"),
    )


def _ends(ends: DataFrame) -> DataFrame:
    """(b, depth, ends_sha256): the hash over the ascending members c that end at a node, however many they are.

    Members are sorted by range and joined to pieces of text; then each node's pieces are hashed one after the other.
    """
    parts = int(ends.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def pack(batches):
        key, first, held = None, None, []
        rows = []

        def done():
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.string()), strict=True)], names=["b", "depth", "first", "piece"])

        for batch in batches:
            for b, depth, c in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                if held and (key != (b, depth) or len(held) >= 1 << 15):
                    rows.append((*key, first, ",".join(held)))
                    held = []
                    if len(rows) >= 64:
                        yield done()
                        rows = []
                if not held:
                    key, first = (b, depth), c
                held.append(str(c))
        if held:
            rows.append((*key, first, ",".join(held)))
        if rows:
            yield done()

    def digest(batches):
        key, state, rows = None, None, []
        for batch in batches:
            for b, depth, piece in zip(*(batch.column(k).to_pylist() for k in (0, 1, 3)), strict=True):
                if key != (b, depth):
                    if key:
                        rows.append((*key, state.hexdigest()))
                    key, state = (b, depth), hashlib.sha256(piece.encode())
                else:
                    state.update(b"," + piece.encode())
        if key:
            rows.append((*key, state.hexdigest()))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.string()), strict=True)], names=["b", "depth", "ends_sha256"])

    sorted_ = ends.select("b", "depth", "c").repartitionByRange(parts, "b", "depth", "c").sortWithinPartitions("b", "depth", "c")
    pieces = sorted_.mapInArrow(pack, "b long, depth long, first long, piece string")
    return pieces.repartition("b", "depth").sortWithinPartitions("b", "depth", "first").mapInArrow(digest, "b long, depth long, ends_sha256 string")


def _common(a: Column, b: Column) -> Column:
    """How many elements two arrays have in common from the start."""
    n = F.least(F.size(a), F.size(b))
    differ = F.filter(F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>")), lambda i: F.get(a, i - 1) != F.get(b, i - 1))
    return F.coalesce(F.get(differ, F.lit(0)) - 1, n)


def _split(buckets: DataFrame, members: DataFrame, blocks: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """One round over large buckets: what each shares, its children, and its members with their next turn.

    ``buckets`` (b, d, n, chars, parent) come back with ``shared``, how many turns all members have in common next, and
    ``sizes``, these turns' code points.
    """
    here = (F.col("m.c") == F.col("k.c")) & (F.floor(F.col("m.d") / BLOCK) == F.col("k.block"))
    rest = lambda c, kind: F.coalesce(F.slice(F.col(f"k.{c}"), (F.col("m.d") % BLOCK + 1).cast("int"), F.lit(BLOCK)), F.array().cast("array<bigint>")).alias(kind)
    tails = cut(members.alias("m").join(blocks.alias("k"), here, "left").select("m.c", "m.len", "m.b", "m.d", rest("ids", "ids"), rest("chars", "sizes")))
    # The smallest and the largest tail have in common what all have.
    ends = tails.groupBy("b").agg(F.min("ids").alias("low"), F.max(F.struct("ids", "sizes")).alias("high"))
    found = ends.withColumn("shared", _common(F.col("low"), F.col("high.ids")))
    met = buckets.join(found, "b")
    # Whether one ends at the end of a block can't be seen from its tail, so the last turn of a block is always split by.
    full = (F.col("shared") > 0) & (F.col("d") % BLOCK + F.col("shared") == BLOCK)
    met = met.withColumn("shared", F.col("shared") - F.when(full, 1).otherwise(0))
    met = cut(met.select("b", "d", "n", "chars", "parent", "shared", F.slice("high.sizes", F.lit(1), F.col("shared")).alias("sizes")))
    rows = tails.join(listed(met.select("b", "shared")), "b").select("c", "len", "b", (F.col("d") + F.col("shared")).alias("depth"), F.get("ids", F.col("shared")).alias("id"), F.get("sizes", F.col("shared")).alias("chars"))
    left = F.col("len") - F.col("depth")
    children = rows.where("id is not null").groupBy("b", "depth", "id").agg(F.min("c").alias("child"), F.count("*").alias("n"), F.sum(left).alias("size"), F.max("chars").alias("chars"), F.max("len").alias("len"))
    return met, cut(children), rows


def trie(turns: DataFrame, convs: DataFrame, local: int = LOCAL) -> DataFrame:
    """All nodes, as in ``NODE``, of conversations (c, len) and their turns (c, pos, id, chars)."""
    spark = turns.sparkSession
    one = F.sort_array(F.collect_list(F.struct("pos", "id", "chars")))
    blocks = turns.groupBy("c", F.floor(F.col("pos") / BLOCK).alias("block")).agg(one.alias("t"))
    blocks = cut(blocks.select("c", "block", F.col("t.id").alias("ids"), F.col("t.chars").alias("chars")))
    total = convs.agg(F.min("c").alias("b"), F.count("*").alias("n"), F.sum(F.col("len") + 1).alias("size")).first()
    if not total.n:
        return spark.createDataFrame([], NODE)
    none = F.lit(None).cast("long")
    members = convs.select("c", "len", _long(total.b).alias("b"), _long(0).alias("d"), none.alias("parent"), _long(0).alias("chars"))
    rounds: list[tuple[DataFrame, DataFrame]] = []
    small, ended, alone = [], [], []
    if total.size <= local:
        small.append(members)
    else:
        buckets = spark.createDataFrame([(total.b, 0, total.n, 0, None)], "b long, d long, n long, chars long, parent long")
        while True:
            met, children, rows = _split(buckets, members.select("c", "len", "b", "d"), blocks)
            rounds.append((met, children))
            ended.append(rows.where("id is null").select("b", "depth", "c"))
            alone.append(children.where("n = 1").select(F.col("child").alias("c"), (F.col("depth") + 1).alias("depth"), F.col("b").alias("parent"), "len"))
            several = children.where("n > 1").select("b", "id", "child", "size", F.col("chars").alias("own"))
            dealt = rows.where("id is not null").select("b", "id", "c", "len", "depth").join(several, ["b", "id"])
            dealt = cut(dealt.select("c", "len", F.col("child").alias("b"), (F.col("depth") + 1).alias("d"), F.col("b").alias("parent"), F.col("own").alias("chars"), "size"))
            small.append(dealt.where(F.col("size") <= local).drop("size"))
            members = dealt.where(F.col("size") > local).drop("size")
            buckets = children.where((F.col("n") > 1) & (F.col("size") > local)).select(F.col("child").alias("b"), (F.col("depth") + 1).alias("d"), "n", "chars", F.col("b").alias("parent"))
            if buckets.isEmpty():
                break
    finished = cut(_finished(_union(small), blocks))
    out = [finished.drop("top")]
    if rounds:
        out += [_chains(_union(alone), blocks), _large(rounds, finished.where("top").select(F.col("conv_id").alias("child"), (F.col("depth") - 1).alias("depth"), F.col("n_leaves").alias("leaves"), F.col("saved_tokens").alias("saved")), _union(ended))]
    return _union([rows.select(*[f.split()[0] for f in NODE.split(", ")]) for rows in out])


def _union(parts: list[DataFrame]) -> DataFrame:
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    return whole


def _large(rounds: list[tuple[DataFrame, DataFrame]], tops: DataFrame, ended: DataFrame) -> DataFrame:
    """The nodes of large buckets, from the last round to the first: each has what its children's subtrees hold.

    ``tops`` (child, depth of its parent, leaves, saved): the subtrees of small buckets.
    """
    known, parts = tops, []
    for met, children in reversed(rounds):
        inner = children.join(known, ["child", "depth"], "left")  # a conversation of its own is one leaf and saves nothing
        below = inner.groupBy("b").agg(F.count("*").alias("n_children"), F.sum(F.coalesce("leaves", _long(1))).alias("leaves"), F.sum(F.coalesce("saved", _long(0))).alias("saved"))
        sizes = F.concat(F.array("chars"), "sizes")
        rows = met.join(below, "b", "left").select("b", "d", "n", "parent", "shared", sizes.alias("sizes"), F.coalesce("n_children", _long(0)).alias("n_children"), F.coalesce("leaves", _long(1)).alias("leaves"), F.coalesce("saved", _long(0)).alias("saved"))
        rows = cut(rows)
        parts.append(rows)
        saved = F.col("saved") + (F.col("n") - 1) * F.aggregate("sizes", _long(0), lambda acc, x: acc + x)
        known = tops.unionByName(rows.select(F.col("b").alias("child"), (F.col("d") - 1).alias("depth"), "leaves", saved.alias("saved")))
    rows = _union(parts).withColumn("j", F.explode(F.sequence(F.lit(0), F.col("shared"))))
    lower = F.aggregate(F.slice("sizes", F.col("j") + 1, F.col("shared") - F.col("j") + 1), _long(0), lambda acc, x: acc + x)
    rows = rows.select(
        F.col("b").alias("conv_id"), (F.col("d") + F.col("j")).alias("depth"), F.when(F.col("j") == 0, F.col("parent")).otherwise(F.col("b")).alias("parent_conv_id"), F.col("n").alias("n_convs"),
        F.when(F.col("j") < F.col("shared"), _long(1)).otherwise(F.col("n_children")).alias("n_children"), F.col("leaves").alias("n_leaves"), (F.col("saved") + (F.col("n") - 1) * lower).alias("saved_tokens"),
    )
    hashed = _ends(ended).withColumnRenamed("b", "conv_id")
    return rows.join(hashed, ["conv_id", "depth"], "left").withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(EMPTY)))


def prefix_nodes(conversations: DataFrame, local: int = LOCAL, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """The trie's nodes, as in ``NODE``, of conversations that begin with a shared head (see :func:`shared_heads`)."""
    return trie(*shared_heads(ordered(conversations, conv, turn, role, text)), local)
