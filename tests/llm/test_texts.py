"""Near duplicates, repeated strings, language model, pages, archives and the pipeline against plain versions and odd input."""

import collections
import gzip
import hashlib
import itertools
import math
import os
import random
import sys
import zlib
from html.parser import HTMLParser

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

from bendscape.llm import attention_lm, components, html_text, simhash, suffix_dedup, warc  # noqa: E402

RNG = random.Random(8)
VOCABULARY = ["".join(RNG.choice("abcdefghij") for _ in range(RNG.randint(2, 9))) for _ in range(400)]


def prose(n, rng=RNG):
    return " ".join(rng.choice(VOCABULARY) for _ in range(n))


def roots(nodes, links):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    return {n: find(n) for n in nodes}


def test_a_cluster_needs_a_shared_folder():
    from types import SimpleNamespace as Bag

    from bendscape.llm.common import shared_folder

    def session(master, given=None):
        none = Bag(getOrElse=lambda x: x)
        return Bag(sparkContext=Bag(master=master, getConf=lambda: {"spark.checkpoint.dir": given}, _jsc=Bag(sc=lambda: Bag(getCheckpointDir=lambda: none))))

    assert shared_folder(session("local[4]")) and shared_folder(session("spark://x", "hdfs:/c")) == "hdfs:/c"
    for master in ("spark://x", "yarn", "local-cluster[3,2,1000]"):
        with pytest.raises(ValueError):
            shared_folder(session(master))


def test_components(spark):
    links = [(i, i + 1) for i in range(60)] + [(100, i) for i in range(101, 140)] + [(200, 200), (None, 3), (7, 5), (7, 5)] + [(300, 299), (298, 300)]
    df = spark.createDataFrame(links, "a long, b long")
    clean = [(a, b) for a, b in links if a is not None and a != b]
    want = roots({x for p in clean for x in p}, clean)
    assert {r.node: r.component for r in components.components(df).collect()} == want
    assert components.components(df.limit(0)).count() == 0


def plain_fingerprint(text):
    w = (text or "").encode().lower().split()
    h = [xxhash.xxh64_intdigest(b" ".join(w[i : i + 3]), 42) for i in range(max(1, len(w) - 2))] if w else []
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash(spark):
    base = [prose(400) for _ in range(30)]
    rows = [(i, t) for i, t in enumerate(base)] + [(100 + i, t + f" tail{i}") for i, t in enumerate(base)] + [(200 + i, t.upper().replace(" ", "  \n")) for i, t in enumerate(base[:10])]
    rows += [(300, None), (301, ""), (302, " \t\n"), (303, "one"), (304, "ONE"), (305, "one two"), (None, base[0]), (7, base[7]), (306, "é ß " * 3), (307, "w " * 50_000), (None, "alone in null land with no id")]
    df = spark.createDataFrame([(k, t, 1, 2) for k, t in rows], "doc_id long, text string, fp int, component_id int")
    got = simhash.near_duplicates(df, hot=30).collect()  # a fingerprint of three rows or more is hot
    prints = [(k, plain_fingerprint(t)) for k, t in rows]
    places = roots(range(len(rows)), [(i, j) for i in range(len(rows)) for j in range(i) if (prints[i][1] ^ prints[j][1]).bit_count() <= 2])
    least = collections.defaultdict(list)
    for i, (k, _) in enumerate(prints):
        if k is not None:
            least[places[i]].append(k)
    want = collections.Counter((k, f, min(least[places[i]], default=None)) for i, (k, f) in enumerate(prints))
    assert collections.Counter((r.doc_id, r.fp & (1 << 64) - 1, r.component_id) for r in got) == want
    assert simhash.near_duplicates(df.limit(0)).count() == 0


def test_tiles_lose_no_link(spark):
    rng = np.random.Generator(np.random.PCG64(3))
    prints = rng.integers(0, 1 << 63, 300, dtype=np.uint64)
    prints = np.unique(np.concatenate([prints, prints[:150] ^ (np.uint64(1) << rng.integers(0, 63, 150).astype(np.uint64)), prints[:100] ^ np.uint64(3), np.array([0, 1, 3, 7, 2**64 - 1], dtype=np.uint64)]))
    df = spark.createDataFrame([(int(x),) for x in prints.view(np.int64)], "fp long")
    values = [int(x) for x in prints]
    want = roots(values, [(a, b) for a in values for b in values if a < b and (a ^ b).bit_count() <= 2])
    found = [(r.a & (1 << 64) - 1, r.b & (1 << 64) - 1) for r in simhash.links(df, 2, tile=7).collect()]
    assert all((a ^ b).bit_count() <= 64 for a, b in found) and roots(values, found) == want


def test_full_groups_are_dealt_again(spark):
    """Numbers that share all but a few bits, in groups of forty at most, so they are dealt again."""
    rng = np.random.Generator(np.random.PCG64(4))
    high = np.uint64(0x9F3B_0000_0000_0000)
    prints = np.unique(np.concatenate([high + np.arange(0, 600, 3, dtype=np.uint64), high + (np.uint64(1) << np.arange(20, 44, dtype=np.uint64)), rng.integers(0, 1 << 63, 50, dtype=np.uint64)]))
    df = spark.createDataFrame([(int(x),) for x in prints.view(np.int64)], "fp long")
    values = [int(x) for x in prints]
    want = roots(values, [(a, b) for a in values for b in values if a < b and (a ^ b).bit_count() <= 2])
    found = [(r.a & (1 << 64) - 1, r.b & (1 << 64) - 1) for r in simhash.links(df, 2, tile=3, group=40).collect()]
    assert roots(values, found) == want


@pytest.mark.parametrize("radius", [0, 1, 2, 3])
def test_linked_pairs_share_a_deal(radius):
    """Whichever bits differ, one choice of runs leaves all of them free."""
    free = list(range(3, 20))
    for bits in itertools.combinations(free, radius):
        assert any(set(bits) <= set(left) for left in simhash.narrowed(free, radius))
    assert all(len(left) < len(free) for left in simhash.narrowed(free, radius))


def plain_removal(rows, length):
    seen, out = set(), []
    for key, text in rows:
        data = (text or "").encode()
        gone = bytearray(len(data))
        for i in range(len(data) - length + 1):
            s = data[i : i + length]
            if s in seen:
                gone[i : i + length] = b"\x01" * length
            seen.add(s)
        kept = bytes(c for c, g in zip(data, gone, strict=True) if not g)
        out.append((key, len(data), sum(gone), sum(g and (i == 0 or not gone[i - 1]) for i, g in enumerate(gone)), kept))
    return out


@pytest.mark.parametrize("group", [1024, 2])
def test_suffix_dedup(spark, group, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "GROUP", group)
    rng = random.Random(2)
    shared = [prose(40, rng) for _ in range(4)]
    rows = [(i, " ".join([prose(rng.randint(0, 30), rng), rng.choice(shared)[rng.randint(0, 40) :], prose(rng.randint(0, 30), rng)])) for i in range(60)]
    rows += [(100, None), (101, ""), (102, "short"), (103, "a" * 700), (104, "ab" * 300), (105, "a" * 100), (106, rows[3][1]), (107, "é" * 50 + shared[0]), (108, "é" * 50), (109, "x" * 99), (110, shared[1] * 3), (111, " ".join(shared) * 2)]
    df = spark.createDataFrame([(k, t, b"x") for k, t in rows], "doc_id long, text string, kept binary")
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in suffix_dedup.remove_repeats(df.repartition(5)).collect()}
    assert got == {k: tuple(x) for k, *x in plain_removal(rows, 100)}
    assert suffix_dedup.remove_repeats(df.limit(0)).count() == 0
    with pytest.raises(TypeError):
        suffix_dedup.remove_repeats(df.withColumn("doc_id", F.col("doc_id").cast("string")))


def test_suffix_dedup_orders_nulls_and_repeated_keys(spark):
    text = prose(60)
    df = spark.createDataFrame([(5, text), (5, text), (None, text), (5, "other " + text), (4, text)], "doc_id long, text string")
    got = sorted((r.doc_id or -1, r.n_bytes, r.n_removed) for r in suffix_dedup.remove_repeats(df).collect())
    n = len(text)
    assert got == [(-1, n, 0), (4, n, n), (5, n, n), (5, n + 6, n)]


def test_deep_shallow_sorts():
    rng = random.Random(1)
    suffixes = [bytes(rng.choice(b"ab") for _ in range(60)) for _ in range(300)]
    suffixes += [b"a" * 40 + bytes(rng.choice(b"ab") for _ in range(20)) for _ in range(200)] + [b"a" * 60] * 50
    groups = suffix_dedup.deep_shallow(suffixes)
    assert [suffixes[g[0]] for g in groups] == sorted(set(suffixes))
    assert all(len({suffixes[i] for i in g}) == 1 for g in groups) and sorted(i for g in groups for i in g) == list(range(len(suffixes)))
    assert [suffixes[g[0]] for g in suffix_dedup.blind_trie(suffixes, list(range(len(suffixes))))] == sorted(set(suffixes))


def plain_base(rows):
    tokens = [[w.decode() for w in (t or "").encode().lower().split()] + ["\n"] for _, t in rows]
    held = [k is not None and zlib.crc32(str(k).encode()) % 10 == 0 for k, _ in rows]
    c = collections.Counter(w for ts, h in zip(tokens, held, strict=True) if not h for w in ts)
    n, v = sum(c.values()), len(c)
    return {k: (h, len(ts), sum(c[w] > 0 for w in ts), n, sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in ts)) for (k, _), ts, h in zip(rows, tokens, held, strict=True)}


@pytest.mark.parametrize("frequent", [1 << 22, 20])
def test_base_score(spark, frequent):
    rows = [(i, prose(30) + " é x") for i in range(40)] + [(100, None), (101, ""), (102, "Unseen1 UNSEEN2"), (None, "a b"), (103, "z" * 30_000)]
    df = spark.createDataFrame([(k, t, 1) for k, t in rows], "doc_id long, text string, score int")
    got = {r.doc_id: r for r in attention_lm.score(df, frequent=frequent).collect()}
    for k, (held, n, known, total, base) in plain_base(rows).items():
        r = got[k]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held, n, known, total) and r.base_score == pytest.approx(base)
        assert r.score < 0
    assert attention_lm.score(df.limit(0)).count() == 0
    twice = attention_lm.score(df.union(df.where("doc_id < 3")))
    assert twice.count() == len(rows)


def small_model(seed=1, ids=3000):
    rng = np.random.Generator(np.random.PCG64(seed))
    m = attention_lm.Model(rng.integers(0, 50, ids).astype(float))
    m.follow(rng.integers(0, 3, (attention_lm.BEFORE, attention_lm.CELLS)).astype(float))
    for k in m.w:
        m.w[k] += rng.normal(0, 0.3, m.w[k].shape).astype(np.float32)
    return m, rng


def test_batches_do_not_matter():
    m, rng = small_model()
    ids, first = rng.integers(0, 2999, 120), np.array([0, 0, 5, 13, 14, 120])
    whole = m.score(ids, first)
    assert np.allclose(whole, [m.score(ids[a:b], np.array([0, b - a]))[0] for a, b in zip(first[:-1], first[1:], strict=True)], rtol=1e-4)
    assert np.allclose(whole, m.score(ids, first, chunk=3), rtol=1e-4)
    # The states for scoring equal those for training.
    grid, _ = attention_lm.laid_out(ids, first, 2999)
    alive = grid >= 0
    cells = np.where(alive, m.cell[grid], attention_lm.CELLS)
    e = m.w["E"][cells]
    dead = np.where(alive, np.float32(0), np.float32(-1e9))
    slow, _ = m.hidden(e[1:], e[:-1], np.concatenate([dead[:-1], dead[1:]], axis=1))
    assert np.allclose(m.states(e, alive)[alive[1:]], slow[alive[1:]], atol=1e-4)


def test_all_next_ids_together_have_probability_one():
    """Scores of texts of one id are those of the states' own softmax, and this adds up to one over all ids."""
    m, _ = small_model(ids=2500)
    ids = np.arange(2499)
    scores = m.score(ids, np.arange(2500))
    for i in range(0, 2499, 357):
        h = m.states(m.w["E"][np.array([[attention_lm.CELLS] * attention_lm.BLOCK, [m.cell[2499], m.cell[i], *[attention_lm.CELLS] * (attention_lm.BLOCK - 2)]])], np.array([[False] * attention_lm.BLOCK, [True, True, *[False] * (attention_lm.BLOCK - 2)]]))[0]
        log = []
        for at, before, goal in ((0, m.cell[2499], m.cell[i]), (1, m.cell[i], m.cell[2499])):
            y, z = m.logits(h[at][None], np.array([min(before, attention_lm.BEFORE - 1)]), np.array([goal // attention_lm.PLACES]))
            log.append(float(y[0, goal // attention_lm.PLACES] - np.log(np.exp(y[0]).sum()) + z[0, goal % attention_lm.PLACES] - np.log(np.exp(z[0]).sum())))
        assert scores[i] == pytest.approx(sum(log) + m.share[i] + m.share[2499], rel=1e-3)
    h = m.states(m.w["E"][np.array([[attention_lm.CELLS] * attention_lm.BLOCK, [m.cell[2499], *[attention_lm.CELLS] * (attention_lm.BLOCK - 1)]])], np.array([[False] * attention_lm.BLOCK, [True, *[False] * (attention_lm.BLOCK - 1)]]))[0][:1]
    total = 0.0
    for c in range(attention_lm.CLASSES):
        y, z = m.logits(h, np.array([min(m.cell[2499], attention_lm.BEFORE - 1)]), np.array([c]))
        inside = np.exp(z[0]) / np.exp(z[0]).sum()
        members = m.cell // attention_lm.PLACES == c
        total += np.exp(y[0, c]) / np.exp(y[0]).sum() * (inside[m.cell[members] % attention_lm.PLACES] * np.exp(m.share[members])).sum()
    assert total == pytest.approx(1, abs=1e-3)


def test_later_ids_leave_earlier_scores_alone():
    m, rng = small_model()
    ids = rng.integers(0, 2999, 40)
    grid, _ = attention_lm.laid_out(ids, np.array([0, 40]), 2999)
    other = grid.copy()
    other.ravel()[8 + 20 :] = np.where(other.ravel()[8 + 20 :] >= 0, 7, -1)
    states = [m.states(m.w["E"][np.where(g >= 0, m.cell[g], attention_lm.CELLS)], g >= 0).reshape(-1, attention_lm.WIDTH) for g in (grid, other)]
    assert np.allclose(states[0][:20], states[1][:20], atol=1e-6) and not np.allclose(states[0][20:24], states[1][20:24], atol=1e-4)


def test_gradients_match_differences():
    m, rng = small_model()
    m.w = {k: v.astype(np.float64) for k, v in m.w.items()}
    m.of_class, m.of_place = m.of_class.astype(np.float64), m.of_place.astype(np.float64)
    cells = rng.integers(0, attention_lm.CELLS, (6, 2 * attention_lm.BLOCK + 1))
    cells[0, :5] = cells[1, -3:] = attention_lm.CELLS
    _, grad = m.gradients(cells)
    for name, g in grad.items():
        spots = np.argsort(-np.abs(g).ravel())[:3]
        for at in spots:
            i = np.unravel_index(at, g.shape)
            loss = []
            for d in (1e-4, -1e-4):
                m.w[name][i] += d
                loss.append(m.gradients(cells)[0])
                m.w[name][i] -= d
            assert g[i] == pytest.approx((loss[0] - loss[1]) / 2e-4, rel=0.02, abs=1e-5), name


def test_training_learns_the_context(spark):
    rng = random.Random(2)
    cycle = "red green blue white black".split()
    # What follows "and" is what stood before it, which no pair of neighbours tells.
    rows = [(i, " ".join(f"{c} and {c} then" for c in (rng.choice(cycle) for _ in range(30)))) for i in range(900)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    runs = [{r.doc_id: r for r in attention_lm.score(df, share=share).collect()} for share in (0.0, 1.0)]
    held = [[r.score for r in run.values() if r.held_out] for run in runs]
    assert len(held[0]) > 50 and sum(held[1]) > 0.95 * sum(held[0]), "logarithms: nearer to zero than pairs alone"
    again = {r.doc_id: r.score for r in attention_lm.score(df, share=1.0).collect()}
    assert again == {k: r.score for k, r in runs[1].items()}


def test_weights_do_not_depend_on_how_texts_are_dealt(spark):
    """Equal weights, to the last bit, from 1, 4 and 64 tasks, one and many shards, and any size of batches and of means."""
    rng = random.Random(3)
    docs = spark.createDataFrame([(i, prose(rng.randint(0, 60), rng)) for i in range(300)] + [(None, prose(40, rng)), (7, prose(9, rng))], "doc_id long, text string")
    end = attention_lm.encoding(attention_lm.TOKENIZER)[2]
    ids = np.random.Generator(np.random.PCG64(4)).integers(0, 9, end).astype(float)

    def weights(df, shards, fan=attention_lm.FAN, tasks=attention_lm.TASKS):
        m = attention_lm.Model(ids)
        attention_lm.averaged(attention_lm._rows(df, "doc_id", "text"), m, 0.01, shards, batch_size=16, fan=fan, tasks=tasks)
        return m.w

    untrained = attention_lm.Model(ids).w
    first = {shards: weights(docs.repartition(4), shards) for shards in (1, 7)}
    assert any((first[1][k] != untrained[k]).any() for k in untrained) and any((first[1][k] != first[7][k]).any() for k in untrained)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "5")
    try:
        for shards, expected in first.items():
            for tasks in (1, 64):
                other = weights(docs.orderBy("text").repartition(tasks), shards, tasks=3 if tasks == 1 else attention_lm.TASKS)
                assert all((other[k] == expected[k]).all() for k in expected), (shards, tasks)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    # A mean of means, by numbers of windows, is the mean.
    by_twos = weights(docs, 7, fan=2)
    assert all(np.allclose(by_twos[k], first[7][k], atol=1e-6) for k in by_twos)


def test_runs_of_numbers():
    import pyarrow as pa

    assert attention_lm.runs_of(pa.array([4, 4, 2, 9, 9, 9])) == [(4, 0, 2), (2, 2, 3), (9, 3, 6)]
    assert attention_lm.runs_of(pa.array([], pa.int64())) == []


PAGE = """<!DOCTYPE html><html><head><title>no</title><style>p{}</style><script>var t="</p>";</script></head><body class="menu"><header><p>Site</p></header><nav><ul><li>Home</ul></nav>
<!-- no --><div class="ad">Buy</div><article><h1>The &lt;Title&gt;</h1><p>One  two&nbsp;three<br>four<p><b>five</b>six<aside>note</aside><div class="comment-list"><p>first!</p><div>x</div></div><form>f<input></form></article>
<section id="related"><p>More</p></section><footer>&copy; us</footer></body></html>"""


def plain_lcs(a, b):
    """A longest common subsequence's length, from every pair of places on."""
    best = np.zeros((len(a) + 1, len(b) + 1), dtype=int)
    for i in range(len(a) - 1, -1, -1):
        for j in range(len(b) - 1, -1, -1):
            best[i, j] = 1 + best[i + 1, j + 1] if a[i] == b[j] else max(best[i + 1, j], best[i, j + 1])
    return best[0, 0]


def test_alignment_is_a_longest_common_subsequence():
    rng = random.Random(5)
    for _ in range(300):
        a, b = ([rng.choice("abcdef") for _ in range(rng.randint(0, 14))] for _ in range(2))
        got = sorted(html_text.aligned(a, b))
        rest = iter(b)
        assert all(any(x == y for y in rest) for x in (a[i] for i in got)), "the places are a subsequence of both"
        assert len(got) == plain_lcs(a, b)


def text_of(page):
    texts, _, _, kinds = html_text.described(page)
    return "\n".join(texts[i] for i in html_text.kept(kinds))


def test_markup():
    assert text_of(PAGE) == "The <Title>\nOne two three\nfour\nfivesix"
    assert text_of("<article>open<nav>menu</article><p>out") == "open"
    assert text_of('<article><p class="x>Hello</p><p title="a > b" id=\'"\'>World <b>x</b> 3 < 4 <5 a<b c</p></article>') == "Hello\nWorld x 3 < 4 <5 a<b c"
    assert text_of("<p>a<!-- open <p>b") == "a" and text_of("<p>a<script>b<p>c") == "a" and text_of("<p>a<script/><p>c</p") == "a\nc</p"
    assert text_of("") == text_of(None) == "" and text_of("a < b") == "a < b" and text_of("<p>&lt;p&gt; &#233;&nbsp;x") == "<p> é x"


def test_no_article_text_is_lost():
    assert text_of('<div class="with-sidebar"><article><p>main text.</p></article><p>out</p></div>') == "main text."
    for name in ('class="related-work"', 'class="share-price"', 'class="notice-period"', 'id="legal"', 'class="commentary"'):
        assert text_of(f"<article><p>One.</p><div {name}><p>Two.</p></div></article>") == "One.\nTwo.", name
    for name in ('class="x comment-list"', 'id="site-footer"', 'class="ad-slot-3"', 'role="navigation"', 'class="post-comments"', "class=sidebar"):
        assert text_of(f"<article><p>One.</p><div {name}><p>Two.</p></div></article>") == "One.", name
    assert text_of('<form><div class="menu">m</div><main><p>In a form.</p></main></form>') == "In a form."
    assert text_of('<div class="sidebar"><p>s</p><main><p>Inside.</p></main></div>') == "Inside."
    assert text_of('<article><p>One.</p></article><div class="related"><article><p>Teaser</p></article></div>') == "One."
    assert text_of('<div id="comments"><article class="comment-body"><p>Me too</p></article></div><article><p>One.</p></article>') == "One."
    assert text_of("<aside><article><p>Teaser</p></article></aside><article><p>One.</p></article>") == "One."


def test_shared_lines_of_few_pages_stay(spark):
    """Two pages say nothing about a template; headings stay however many pages have them."""
    page = lambda i: f"<article><h1>Summary</h1><p>Introduction</p><p>What number {i} has to say is of its own.</p><p>By the editors</p></article>"
    rows = [(i, f"http://h.example/{i}", page(i)) for i in range(2)] + [(10 + i, f"http://many.example/{i}", page(i)) for i in range(9)]
    got = {r.page_id: r.text for r in html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for i in range(2):
        assert got[i] == f"Summary\nIntroduction\nWhat number {i} has to say is of its own.\nBy the editors"
    for i in range(9):
        assert got[10 + i] == f"Summary\nIntroduction\nWhat number {i} has to say is of its own."


@pytest.mark.parametrize("unit", ["a <b c ", '<p class="x>Hello</p>', '<a "x>" ', "<a ' <b \" ", "<script ", '<a "<a" ', "<!-- ", "</", "<p x='y' "])
def test_odd_markup_takes_linear_time(unit):
    import time

    def took(n):
        t = time.process_time()
        html_text.lines(unit * n)
        return time.process_time() - t

    assert took(60_000) < 40 * max(took(6_000), 0.01)


class Reader(HTMLParser):
    """Lines of a well-formed page of p, div, h1, h2, br and article elements, by the library's own parser: (text, in an article, heading)."""

    def __init__(self, page):
        super().__init__()
        self.out, self.held, self.open = [], "", []
        self.feed(page)
        self.close()
        self.flush()

    def flush(self):
        text = " ".join(self.held.split())
        if text:
            self.out.append((text, "article" in self.open, bool({"h1", "h2"} & set(self.open))))
        self.held = ""

    def handle_starttag(self, tag, attrs):
        self.flush()
        if tag != "br":
            self.open.append(tag)

    def handle_endtag(self, tag):
        self.flush()
        while self.open and self.open.pop() != tag:
            pass

    def handle_data(self, data):
        self.held += data


def plain_places(a, b):
    """Places in a of a longest common subsequence with b, from a full table."""
    best = np.zeros((len(a) + 1, len(b) + 1), dtype=int)
    for i in range(len(a) - 1, -1, -1):
        for j in range(len(b) - 1, -1, -1):
            best[i, j] = 1 + best[i + 1, j + 1] if a[i] == b[j] else max(best[i + 1, j], best[i, j + 1])
    i = j = 0
    out = set()
    while i < len(a) and j < len(b):
        if a[i] == b[j]:
            out.add(i)
            i, j = i + 1, j + 1
        elif best[i + 1, j] >= best[i, j + 1]:
            i += 1
        else:
            j += 1
    return out


def plain_main_texts(pages):
    """(host, path, html) -> text of well-formed pages, by the definition: a parser of its own, a list a host, full tables."""
    groups = {}
    for host, path, html in pages:
        found = tuple(Reader(html).out)
        groups[host, found] = min(path, groups.get((host, found), path))
    out = {}
    for (host, found), path in groups.items():
        rows = sorted((p, digest(f), f) for (h, f), p in groups.items() if h == host)
        i = next(k for k, r in enumerate(rows) if r[2] == found)
        near = sorted((j for j in range(len(rows)) if 0 < abs(i - j) <= 8), key=lambda j: (-len(os.path.commonprefix([path, rows[j][0]])), abs(i - j), j))
        texts = [t for t, _, _ in found]
        long = sum(len(t) for t in texts if len(t) > 80)
        votes, voters = collections.Counter(), 0
        for j in near:
            hit = plain_places(texts, [t for t, _, _ in rows[j][2]])
            if 2 * sum(len(texts[k]) for k in hit if len(texts[k]) > 80) <= long and len(hit) < len(texts) and voters < 8:
                voters += 1
                votes.update(hit)
        if any(a for _, a, _ in found):
            left = [k for k, (_, a, _) in enumerate(found) if a]
            edge = lambda k: voters >= 3 and 10 * votes[k] >= 9 * voters and texts[k][-1] not in ".!?…" and len(texts[k].split()) <= 6 and not found[k][2]  # noqa: E731, B023
            own = [k for k in left if not edge(k)]
            left = [k for k in left if own and own[0] <= k <= own[-1]]
        else:
            left = [k for k in range(len(texts)) if not votes[k] or 2 * votes[k] < voters]
        out[host, found] = "\n".join(texts[k] for k in left)
    return out


def digest(found):
    """What breaks ties of paths in the order of pages."""
    page = "".join(f"{'<article>' if a else ''}<{'h1' if h else 'p'}>{t}</{'h1' if h else 'p'}>{'</article>' if a else ''}" for t, a, h in found)
    _, hashes, _, kinds = html_text.described(page)
    return html_text.digest_of(hashes, kinds)


def test_differencing(spark, monkeypatch):
    monkeypatch.setattr(html_text, "BLOCK", 16)
    rng = random.Random(9)
    menu = "<div>Menu one</div><div>Menu two</div><div>About all of our many pages here</div>"
    sentence = lambda: prose(20, rng).capitalize() + "."
    quote = sentence()
    pages = [(i, f"http://h.example/p/{i}", f"{menu}<p>{sentence()} {i}</p>{f'<p>{quote}</p>' if i % 4 == 0 else ''}<p>{sentence()}</p><div>Imprint</div>") for i in range(40)]
    pages += [(100 + i, f"http://a.example/{i % 3}/{i}", f"<article><p>Share this</p><h1>{prose(4, rng)} {i}</h1><p>{sentence()}</p><p>{quote}</p><p>Note</p><p>{sentence()}</p><p>Read more</p></article>") for i in range(40)]
    pages += [(200 + i, f"http://c.example/{i}", pages[3][2]) for i in range(5)] + [(210 + i, f"http://c.example/{i}x", pages[i][2]) for i in (8, 9)]
    pages += [(220 + i, f"http://d.example/{i}", f"<p>{' '.join(quote.split()[: 15 + i])}</p><p>{quote}</p><p>{quote} more</p>") for i in range(5)]
    pages += [(300, None, None), (301, "x", ""), (302, "http://h.example/p/3", pages[3][2]), (None, "http://z/1", PAGE), (303, "http://big/", "<p>" + "w " * 100_000), (300, None, PAGE)]
    df = spark.createDataFrame([(k, u, h, 1) for k, u, h in pages], "page_id long, url string, html string, text int")
    parts = [(u.partition("://")[2].partition("/")[0], "/" + u.partition("://")[2].partition("/")[2]) if u and "://" in u else ("", "") for _, u, _ in pages]
    texts = plain_main_texts([(h, p, x or "") for (h, p), (_, _, x) in zip(parts, pages, strict=True) if x != PAGE])

    def of(part, html):
        return text_of(html) if html == PAGE else texts[part[0], tuple(Reader(html or "").out)]

    want = collections.Counter((k, of(part, h)) for (k, _, h), part in zip(pages, parts, strict=True))
    for n in (1, 4, 40):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        try:
            assert collections.Counter((r.page_id, r.text) for r in html_text.extract(df.repartition(n)).collect()) == want
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", 4)
    by = {k: t for k, t in want}
    assert not any("Menu" in by[i] or "Imprint" in by[i] for i in range(40)) and all(str(i) in by[i] for i in range(40))
    assert all(by[100 + i].startswith(pages[40 + i][2].split("<h1>")[1].split("<")[0]) and quote in by[100 + i] and "Note" in by[100 + i] and "Read more" not in by[100 + i] for i in range(40))
    assert not any("Menu" in by[200 + i] for i in range(5)) and by[301] == "" and len(by[303]) == 199_999
    assert html_text.extract(df.limit(0)).count() == 0


def test_archives(spark, tmp_path):
    big = "é\r\n\r\nWARC/1.1\r\n" * 100
    pages = [(1, "http://www.a.example/x", big), (9, "http://a.example/x", big), (5, "https://b.example/?q", big), (2, None, None), (3, "u\r\nx", "small"), (4, "http://s/", "small"), (None, "http://n/", big), (9, "http://a.example/x", big), (6, "http://z/", "x" * 999), (7, "http://z/", "x" * 999), (8, "http://z/", "y" * 1000), (10, "http://z/", "y" * 1000)]
    df = spark.createDataFrame([(k, u, h, 1) for k, u, h in pages], "page_id long, url string, html string, record int")
    folder = str(tmp_path / "w")
    got = warc.archive(df, folder, per_file=3)
    rows = got.collect()
    want = []
    for k, _, h in pages:
        data = (h or "").encode()
        ids = [x for x, _, y in pages if y == h]
        first = max((x for x in ids if x is not None), default=None)
        revisit = len(data) >= 1000 and len(ids) > 1 and k != first
        want.append((k, len(data), hashlib.sha1(data).hexdigest(), "revisit" if revisit else "response", first if revisit else None))
    key = lambda r: tuple(str(x) for x in r)
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in rows), key=key) == sorted(want, key=key)
    order = [(r.urlkey, r.date, r.page_id is not None, r.page_id or 0) for r in rows]
    assert order == sorted(order)
    for r in rows:
        with open(r.run.removeprefix("file:"), "rb") as f:
            f.seek(r.offset)
            head, block = warc.record_of(gzip.decompress(f.read(r.length)))
        assert head["WARC-Type"] == r.record_type and head.get("WARC-Target-URI") == r.url
        assert hashlib.sha1(block.partition(b"\r\n\r\n")[2]).hexdigest() == r.payload_digest or r.record_type == "revisit"
    # Each file is a run of three records at most, in order, and a plain gzip reader reads all of it.
    runs = collections.defaultdict(list)
    for r in rows:
        runs[r.run].append((r.offset, r.length, (r.urlkey, r.date, r.page_id is not None, r.page_id or 0)))
    for name, run in runs.items():
        run.sort()
        assert len(run) <= 3 and [k for *_, k in run] == sorted(k for *_, k in run)
        assert all(a + b == c for (a, b, _), (c, *_) in zip(run[:-1], run[1:], strict=True))
        assert gzip.open(name.removeprefix("file:")).read().count(b"WARC-Record-ID") == len(run)
    # However rows are dealt to files and ranges, the order is the same.
    small = warc.archive(df, per_file=2, per_range=2)
    assert small.rdd.getNumPartitions() > 4
    assert [(r.urlkey, r.date, r.page_id) for r in small.collect()] == [(r.urlkey, r.date, r.page_id) for r in rows]
    assert warc.archive(df.limit(0)).count() == 0
    with pytest.raises(TypeError):
        warc.archive(df.withColumn("page_id", F.lit("a")))


def test_archives_of_long_pages(spark, tmp_path):
    # Members of 16 MiB and more end in a byte that is not zero, so padding follows them.
    sizes = {1: 1 << 24, 2: 5, 3: (1 << 24) + 77, 4: 0, 5: 1 << 25, 6: 3000}
    df = spark.range(1, 7).select(F.col("id").alias("page_id"), F.concat(F.lit("http://h/"), "id").alias("url"), F.expr(f"repeat('a', element_at(map({', '.join(f'{k}L, {v}' for k, v in sizes.items())}), id))").alias("html")).coalesce(1)
    got = warc.archive(df, str(tmp_path / "w"), per_bytes=20_000).collect()
    assert {r.page_id: r.payload_bytes for r in got} == sizes and len({r.run for r in got}) > 1
    for r in got:
        with open(r.run.removeprefix("file:"), "rb") as f:
            f.seek(r.offset)
            assert warc.record_of(gzip.decompress(f.read(r.length)))[1].endswith(b"a" * sizes[r.page_id])
    assert all(sum(r.length for r in got if r.run == run) <= 20_000 or sum(r.run == run for r in got) == 1 for run in {r.run for r in got})
    with pytest.raises(ValueError):
        list(warc.walk(gzip.compress(b"WARC/1.1\r\nContent-Length: 1\r\n\r\nxyz\r\n\r\n")))
    with pytest.raises(ValueError):
        list(warc.walk(gzip.compress(b"WARC/1.1\r\nContent-Length: 1\r\n\r\nx\r\n\r\n")[:-3]))


def test_loser_tree():
    runs = [sorted(RNG.choices(range(50), k=RNG.randint(0, 9))) for _ in range(11)]
    assert [runs[r][i] for r, i in warc.LoserTree(runs)] == sorted(x for r in runs for x in r)
    assert list(warc.LoserTree([])) == []


def plain_emitted(rows, offset):
    """How often each (key, text, source) is taken: ranks by (size, key) in each source, and targets filled like water."""
    from test_filters import plain_targets

    sizes, by_source = collections.Counter(), collections.defaultdict(list)
    for k, t, s in rows:
        sizes[s] += len(t.split())
        by_source[s].append((len(t.split()), k))
    targets = plain_targets(dict(sizes))
    out = collections.Counter()
    for s, members in by_source.items():
        rate = targets[s] / sizes[s]
        for i, (_, k) in enumerate(sorted(members)):
            out[k] = math.floor((i + 1) * rate + offset) - math.floor(i * rate + offset)
    return +out


def test_pipeline(spark, tmp_path):
    pipeline = pytest.importorskip("corpus_pipeline")
    sys.path.insert(0, os.path.dirname(__file__))
    from test_filters import plain_contamination, plain_quality, plain_shape
    from test_near_copies import plain_firsts

    from bendscape.llm import mixing

    rng = random.Random(12)
    item = prose(40, rng)
    good = [prose(60, rng) for _ in range(40)]
    near = [" ".join([*t.split()[:-2], "changed", "ending"]) for t in good[10:18]]
    rows = [(i, t, f"s{i % 3}") for i, t in enumerate(good)] + [(100 + i, t, "s0") for i, t in enumerate(good[:8])] + [(150 + i, t, "s1") for i, t in enumerate(near)]
    rows += [(200, None, "s1"), (201, "", "s1"), (202, "few words", "s1"), (203, "a b c d e " * 30, "s1"), (204, item + " " + prose(10, rng), "s2"), (205, prose(30, rng) + " mail bob.x@mail.example.com now", "s2"), (206, prose(30, rng) + " &&& $$$ ###" * 9, None), (207, prose(50, rng), None)]
    docs = [(k, t, "en", s, len(t or "")) for k, t, s in rows]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    out = pipeline.run(spark, str(tmp_path)).collect()
    kept = []
    for k, t, s in rows:
        (n, _, symbols, _, repeat), (alpha, _, _) = plain_quality(t), plain_shape(t)
        if n >= 10 and 100 * repeat <= 20 * n and 10 * symbols <= n and 10 * alpha >= 7 * n:
            kept.append((k, t, s))
    firsts = set(plain_firsts([(k, t) for k, t, _ in kept]))
    assert firsts.isdisjoint({*range(100, 108), *range(150, 158)}) and set(range(40)) <= firsts
    kept = [r for r in kept if r[0] in firsts]
    dirty = {x[0] for x in plain_contamination([(k, t) for k, t, _ in kept], [(1, item)]) if x[4]}
    assert dirty == {204}
    kept = [r for r in kept if r[0] not in dirty]
    assert collections.Counter(r.doc_id for r in out) == plain_emitted(kept, mixing.offset())
    assert all(sorted(r.copy for r in out if r.doc_id == k) == list(range(1, n + 1)) for k, n in collections.Counter(r.doc_id for r in out).items())
    texts = {k: t for k, t, _ in kept}
    assert all(r.text == texts[r.doc_id] and r.n_chars == len(r.text) for r in out if r.doc_id != 205)
    assert not any("bob.x@" in r.text for r in out) and out[0].asDict().keys() == {"doc_id", "text", "lang", "source", "n_chars", "copy"}
    for _, stage in pipeline.STAGES[:4]:
        empty = stage(spark, spark.read.parquet(str(tmp_path / "documents.parquet")).limit(0), str(tmp_path))
        assert empty.columns == ["doc_id", "text", "lang", "source", "n_chars"] and empty.count() == 0
