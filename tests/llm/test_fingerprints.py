"""Fingerprints of improbable features against plain loops, and the query over documents in order."""

import collections
import hashlib
import math
import random

import numpy as np
import pytest

from bendscape.llm import fingerprints as fp

SCHEMA = "doc_id long, text string, h string, bucket int, fingerprint string"


def prose(rng, n, letters="abcdefghij é"):
    return " ".join("".join(rng.choice(letters) for _ in range(rng.randint(1, 9))) for _ in range(n))


def plain_levels(data):
    share = lambda c: round(16 * c * math.log2(c)) if c else 0
    return [sum(share(c) for c in collections.Counter(data[i : i + 16]).values()) for i in range(len(data) - 15)]


def plain_selected(data, order):
    """Places of the selected features, by loops."""
    rank = [order[v] for v in plain_levels(data)]
    votes = collections.Counter(min(range(i, i + 16), key=lambda k: (rank[k], k)) for i in range(len(rank) - 15))
    return sorted(k for k, v in votes.items() if v >= 4) or [min(range(len(rank)), key=lambda k: (rank[k], k))]


@pytest.mark.parametrize("slice_", [1 << 20, 50])
def test_features(monkeypatch, slice_):
    """Long texts are sliced with overlap: the same features come out."""
    monkeypatch.setattr(fp, "SLICE", slice_)
    rng = random.Random(3)
    for text in [prose(rng, 90), "a" * 400, "ab" * 9, "x" * 16, prose(rng, 4), "abc" * 150 + prose(rng, 40)]:
        data = text.encode()
        counts = collections.Counter(plain_levels(data))
        order = fp.ranks(counts)
        assert fp.levels(np.frombuffer(data, np.uint8)).tolist() == plain_levels(data)
        windows = list(dict.fromkeys(data[k : k + 16] for k in plain_selected(data, order)))
        got = fp.selected(np.frombuffer(data, np.uint8), order)
        want = [fp.selected(np.frombuffer(w, np.uint8), order)[0] for w in windows]
        assert got.tolist() == want


def test_ranks():
    """Rarest first, more entropy first of equally rare ones, dull windows last."""
    order = fp.ranks({0: 5, 40: 2, 80: 9, fp.LEVELS - 1: 1})
    assert order[3] < order[40] < order[0] < order[80] < order[fp.LEVELS - 1]
    assert sorted(order) == list(range(fp.LEVELS))


def test_likeness():
    rng = random.Random(8)
    order = fp.ranks({})
    text = prose(rng, 2000)
    make = lambda t: fp.fingerprint(t.encode(), order)
    whole, other, nothing = make(text), make(prose(rng, 2000)), make("")
    assert len(whole.filters) > 3 and fp.parse(str(whole)).filters.tolist() == whole.filters.tolist()
    assert fp.likeness(whole, make(text)) == fp.likeness(nothing, make("")) == 1 and fp.likeness(whole, nothing) == 0
    assert fp.likeness(whole, other) < 0.05
    moved = make(prose(rng, 40) + text)
    assert fp.likeness(whole, moved) == fp.likeness(moved, whole) > 0.3
    tail = make(text[: len(text) * 3 // 4] + prose(rng, 500))
    assert 0.6 < fp.likeness(whole, tail) < 1
    assert make("short").features == 1 and fp.likeness(make("short"), make("shorn")) == 0


def test_robustness(spark):
    rng = random.Random(4)
    texts = [None, "", "a", "é€x", prose(rng, 30), prose(rng, 400), prose(rng, 400), "z" * 500]
    rows = [(3 * k, t) for k, t in enumerate(texts)] + [(90, texts[5]), (91, texts[5] + " more"), (None, "no key, but words"), (15, "the same key once more"), (15, texts[5]), (15, texts[5])]
    docs = spark.createDataFrame([(k, t, "x", 7, "y") for k, t in rows], SCHEMA).repartition(3)
    order = fp.learned(docs)
    counts = collections.Counter(v for _, t in rows for v in plain_levels((t or "").encode()))
    assert order.tolist() == fp.ranks(counts).tolist()
    hashes = {r.text: r.h for r in docs.selectExpr("coalesce(text, '') as text", "xxhash64(coalesce(text, '')) as h").collect()}
    ordered = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, hashes[r[1] or ""]))
    want = collections.Counter()
    prints = lambda t: fp.fingerprint(t.encode(), order)
    for i, (key, text) in enumerate(ordered):
        text, after = text or "", ordered[(i + 1) % len(ordered)][1] or ""
        cut = len(text) - len(text) // 4
        edited = text[:cut] + after[: len(text) // 4]
        near = [round(fp.likeness(prints(text), prints(t)), 9) for t in (edited, after)]
        want[(key, len(text), hashlib.sha256(edited.encode()).hexdigest(), str(prints(text)), str(prints(edited)), *near)] += 1
    got = fp.robustness(docs)
    assert got.columns == ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    assert collections.Counter((*r[:5], round(r[5], 9), round(r[6], 9)) for r in got.collect()) == want
    assert {(r.doc_id, r.fingerprint) for r in fp.fingerprints(docs, order).collect()} == {(w[0], w[3]) for w in want}


def test_one_and_none(spark):
    one = fp.robustness(spark.createDataFrame([(5, "alone with itself, twenty", "", 0, "")], SCHEMA)).collect()
    assert [(r.doc_id, r.near_next) for r in one] == [(5, 1.0)]
    assert fp.robustness(spark.createDataFrame([], SCHEMA)).collect() == []
    with pytest.raises(TypeError):
        fp.robustness(spark.createDataFrame([("a", "b")], "doc_id string, text string"))
