"""Near copies of the pipeline's second stage against a brute-force version."""

import collections
import os
import random
import sys

import numpy as np
import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

from bendscape.llm import near_copies  # noqa: E402


def plain_set(text):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def plain_firsts(rows):
    """Rows (key, text) of which nothing smaller is linked, of all texts with a key."""
    sets = sorted({plain_set(t) for _, t in rows}, key=sorted)
    parent = list(range(len(sets)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if 9 * both >= 4 * (len(a) + len(sets[j])):
                x, y = find(i), find(j)
                parent[max(x, y)] = min(x, y)
    groups = collections.defaultdict(list)
    for k, t in rows:
        if k is not None:
            groups[find(sets.index(plain_set(t)))].append(k)
    return sorted(min(ks) for ks in groups.values())


def changed(words, n, rng):
    out = list(words)
    for i in rng.sample(range(len(out)), n):
        out[i] = f"new{rng.random()}"
    return out


@pytest.mark.parametrize("tile, at_once", [(1 << 14, 1 << 16), (7, 0)])
def test_near_copies_are_found(spark, tile, at_once, monkeypatch):
    monkeypatch.setattr(near_copies, "AT_ONCE", at_once)
    rng = random.Random(6)
    word = lambda: f"w{rng.randrange(3000)}"
    passage = [word() for _ in range(30)]
    rows = []
    for _ in range(25):  # copies of copies, some within four fifths and some just beyond
        base = [word() for _ in range(rng.randint(20, 200))]
        for n in (0, 1, 2, 3, 5, 8):
            rows.append(" ".join(changed(base, min(n, len(base)), rng)))
        rows.append(" ".join(base[: len(base) * 4 // 5 + 1]).upper())
    hot = [word() for _ in range(120)]
    rows += [" ".join(changed(hot, rng.randint(0, 3), rng)) for _ in range(40)]  # one large group
    rows += [" ".join([word() for _ in range(20)] + passage + [word() for _ in range(20)]) for _ in range(30)]  # and a common passage
    rows += [None, "", " \n", "one", "ONE", "one two", "a b c d e", "a b c d e f"]
    rng.shuffle(rows)
    rows = list(enumerate(rows))
    rows += [(7, "an unlinked text of its own under a number that was given before"), (7, rows[7][1]), (None, rows[3][1]), (None, "x")]
    df = spark.createDataFrame([(k, t, 1) for k, t in rows], "doc_id long, text string, n int")
    out = near_copies.one_of_each(df, tile=tile)
    assert out.columns == df.columns
    got = [r.doc_id for r in out.collect()]
    assert got.count(None) == 2 and sorted(k for k in got if k is not None) == plain_firsts(rows)
    assert near_copies.one_of_each(df.limit(0)).count() == 0


def test_pipeline_drops_near_copies(spark):
    pipeline = pytest.importorskip("corpus_pipeline")
    rng = random.Random(3)
    base = [[f"v{rng.randrange(5000)}" for _ in range(100)] for _ in range(20)]
    rows = [(i, " ".join(b)) for i, b in enumerate(base)] + [(100 + i, " ".join(changed(b, 2, rng))) for i, b in enumerate(base)] + [(200 + i, " ".join(changed(b, 40, rng))) for i, b in enumerate(base)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    stage = dict(pipeline.STAGES)["near_duplicates"]
    assert sorted(r.doc_id for r in stage(spark, df, "").collect()) == plain_firsts(rows) == [*range(20), *range(200, 220)]


def test_what_meets_grows_with_the_texts(spark):
    """Unlike texts of one size meet nothing, whatever their number; a large group meets its smallest set only."""
    rng = random.Random(8)
    unlike = [" ".join(f"u{rng.randrange(10**6)}" for _ in range(60)) for _ in range(400)]
    base = [f"b{i}" for i in range(200)]
    group = [" ".join([*base[:k], f"n{k}", *base[k + 1 :]]) for k in range(0, 200, 2)]
    for tile in (1 << 14, 16):
        counts = []
        for words in (unlike[:200], unlike, unlike[:50] + group):
            rows = spark.createDataFrame(list(enumerate(words)), "key long, text string").selectExpr("key", "xxhash64(text) AS h", "text")
            met, found = near_copies.meetings(near_copies.sketches(rows), rows, tile=tile)
            counts.append((met.count(), found.count()))
        assert counts[:2] == [(0, 0)] * 2
        assert counts[2][0] + counts[2][1] <= 10 * len(group) and (tile > 16 or counts[2][1] > 0.8 * len(group))


def test_sets_at_four_fifths_have_keys_in_common():
    rng = np.random.default_rng(4)
    sets = []
    for n in (5, 45, 450) * 100:
        both, x, y = np.split(rng.integers(0, 1 << 64, n, dtype=np.uint64), [n * 4 // 5, n * 9 // 10])
        sets += [np.sort(np.append(both, x)), np.sort(np.append(both, y))]
    keys = near_copies.band_keys([*sets, np.zeros(0, np.uint64)])[:-1].reshape(300, 2, -1)
    same = (keys[:, 0] == keys[:, 1]).sum(axis=1)
    assert same.min() > 0 and abs(same.mean() / near_copies.BANDS - 0.8**near_copies.HASHES) < 0.05
