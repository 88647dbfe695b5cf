"""The prefix trie against plain loops: rounds, skipped stretches, blocks, chains, hot beginnings and odd rows."""

import collections
import hashlib
import random
import zlib

import duckdb
import pytest

from bendscape.llm import prefix_trie, queries

SCHEMA = "conv_id long, turn long, role string, text string, id long, pos string"


def plain(rows, every=100):
    """All nodes, from (conv_id, turn, role, text)."""
    convs = collections.defaultdict(list)
    for c, turn, role, text, *_ in rows:
        if c is not None:
            role, text = role or "", text or ""
            tie = hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).digest()
            convs[c].append(((turn is not None, turn or 0, tie), (role, text)))
    own = {c: [t for _, t in sorted(v)] for c, v in convs.items()}
    built = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 6
        rest = abs(c) % every * (1 if c >= 0 else -1)
        built[c] = own.get(c - rest, [])[:h] + own[c][h:]
    nodes = collections.defaultdict(list)
    for c, s in built.items():
        for d in range(len(s) + 1):
            nodes[tuple(s[:d])].append(c)
    children = collections.Counter(p[:-1] for p in nodes if p)
    out, sums = [], collections.defaultdict(lambda: [0, 0])
    for p, members in nodes.items():
        for d in range(len(p) + 1):
            up = sums[p[:d]]
            up[0] += not children[p]
            up[1] += (len(members) - 1) * (len(p[-1][1]) if p else 0)
    for p, members in nodes.items():
        ends = ",".join(str(c) for c in sorted(c for c in members if len(built[c]) == len(p)))
        out.append((min(members), len(p), min(nodes[p[:-1]]) if p else None, len(members), children[p], *sums[p], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


def table():
    rng = random.Random(6)
    say = lambda k: ("user" if k % 2 else "assistant", f"{'né' * (k % 3)} turn {k}")
    rows = []
    for c in range(140):
        n = rng.randint(1, 9)
        rows += [(c, t, *say(rng.randint(0, 3))) for t in range(n)]
    hot = [(t, *say(7 * t)) for t in range(70)]  # a beginning of more than two blocks that many share, exact copies among them
    for c in range(1000, 1000 + 60 * 100, 100):
        rows += [(c, *t) for t in hot[: 33 if c % 300 == 0 else 64 if c % 700 == 0 else 70]]
        rows += [(c, 99, "user", f"own {c}")] if c % 500 == 0 else []
    rows += [(10_000, t, *say(t)) for t in range(100)] + [(20_000, t, *say(t)) for t in range(99)]  # two long ones
    rows += [(77_777, 0, "user", "its base is not there")]
    rows += [(-5, 3, "user", "below zero"), (-5, None, "user", None), (-5, None, None, "null turn"), (0, 0, None, None), (0, 0, "", ""), (None, 1, "user", "of nobody")]
    rows += [(3, 2, "user", "tie a"), (3, 2, "user", "tie b"), (3, 2, "user", "tie a")]
    rows += [(50_001, 0, "a", "b")]  # may have no turn left
    return [(*r, 1, "x") for r in rows]


@pytest.mark.parametrize("local", [1 << 16, 60])
def test_trie(spark, local):
    """The same nodes whether one task may finish all or small buckets."""
    rows = table()
    got = prefix_trie.prefix_nodes(spark.createDataFrame(rows, SCHEMA).repartition(3), local)
    assert sorted(map(tuple, got.collect()), key=repr) == plain(rows)
    assert got.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def test_trie_without_rows(spark):
    assert prefix_trie.prefix_nodes(spark.createDataFrame([], SCHEMA)).collect() == []
    with pytest.raises(TypeError):
        prefix_trie.prefix_nodes(spark.createDataFrame([("a", 1, "b", "c")], "conv_id string, turn int, role string, text string"))


def test_trie_sql(spark, tmp_path):
    rows = [r for r in table() if r[0] != 3 and not (r[0] == -5 and r[1] is None)]  # ties are ordered otherwise in SQL
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(f"{tmp_path}/conversations.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
    want = con.execute(queries.ORACLES["op11_prefix_trie"])
    columns = [c[0] for c in want.description]
    got = queries.QUERIES["op11_prefix_trie"](spark, str(tmp_path)).select(*columns).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(want.fetchall(), key=repr)
