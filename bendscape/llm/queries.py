"""The queries of this subpackage over the driver's tables, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bendscape.llm import attention_lm, decontamination, filter_audit, fingerprints, html_text, mixing, pii, prefix_trie, quality_rules, simhash, suffix_dedup, url_templates, warc
from bendscape.llm.common import WORD, table


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's measurements, base verdict and verdict under policy v2."""
    rows = quality_rules.ledger(table(spark, sf_dir, "documents"))
    base, policy = (quality_rules.passes(p) for p in (quality_rules.BASE, quality_rules.V2))
    return rows.select("doc_id", *quality_rules.MEASURES, F.col("failed").alias("failed_bits"), (~base).alias("base_failed"), (base & policy).alias("kept"))


def quality_ablations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each rule of each policy rejects, rejects alone, and lets through, from the stored ledger."""
    return quality_rules.ablations(quality_rules.stored(table(spark, sf_dir, "documents")))


_OP2 = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t FROM documents
), w AS (
  SELECT doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws,
    list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls
  FROM d
), grams AS (
  SELECT doc_id, len(ws) AS n, unnest(range(1, len(ws) - 3)) AS i, ws FROM w WHERE len(ws) >= 5
), g AS (
  SELECT doc_id, i, array_to_string(ws[i:i+4], ' ') AS gram FROM grams
), twice AS (
  SELECT doc_id, gram FROM g GROUP BY ALL HAVING count(*) > 1
), hit AS (
  SELECT doc_id, count(DISTINCT p) AS r
  FROM (SELECT doc_id, unnest(range(i, i + 5)) AS p FROM g JOIN twice USING (doc_id, gram))
  GROUP BY doc_id
), m AS (
  SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0)::BIGINT AS word_chars,
    len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols, len(regexp_extract_all(t, '!'))::BIGINT AS n_exclamations,
    len(regexp_extract_all(t, '[A-Z]'))::BIGINT AS n_capitals, len(ls)::BIGINT AS n_lines,
    len(list_filter(ws, lambda x: regexp_matches(x, '[^\x00-\x40\x5B-\x60\x7B-\x7F]')))::BIGINT AS n_alpha_words,
    (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(r, 0)::BIGINT AS n_repeat_words,
    len(list_filter(ls, lambda x: regexp_matches(x, '^[\x20\x09-\x0D]*[-*•]')))::BIGINT AS n_bullet_lines,
    len(list_filter(ls, lambda x: regexp_matches(x, '(?:\.\.\.|…)[\x20\x09-\x0D]*\z')))::BIGINT AS n_cut_lines
  FROM w LEFT JOIN hit USING (doc_id)
), b AS (
  SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
    ((n_words < 10)::INT + (100 * n_repeat_words > 20 * n_words)::INT * 2 + (10 * n_symbols > n_words)::INT * 4
    + (10 * n_exclamations > 3 * n_words)::INT * 8 + (10 * n_capitals > 3 * word_chars)::INT * 16
    + (2 * n_dup_lines > n_lines)::INT * 32
    + (word_chars < 2 * n_words OR word_chars > 15 * n_words)::INT * 64 + (10 * n_alpha_words < 7 * n_words)::INT * 128
    + (10 * n_bullet_lines > 9 * n_lines)::INT * 256 + (10 * n_cut_lines > 3 * n_lines)::INT * 512)::BIGINT AS failed_bits
  FROM m
)
SELECT *, failed_bits = 0 AS kept FROM b
"""

_ABLATIONS = f"""
WITH rows AS ({_OP2}), r(rule, bit) AS (
  VALUES ('few_words', 1), ('repeated_words', 2), ('symbols', 4), ('exclamations', 8), ('capitals', 16), ('repeated_lines', 32),
    ('word_length', 64), ('few_letters', 128), ('bullets', 256), ('cut_off_lines', 512)
), p(policy, mask) AS (
  VALUES ('base', 3), ('v1', 127), ('v1-lenient', 15), ('v2', 1023)
)
SELECT policy, rule, count(*)::BIGINT AS documents, count(*) FILTER (failed_bits & mask = 0)::BIGINT AS kept,
  count(*) FILTER (failed_bits & bit <> 0)::BIGINT AS rejected, count(*) FILTER (failed_bits & mask = bit)::BIGINT AS rejected_alone,
  bit_or(failed_bits & mask)::BIGINT AS bits_seen
FROM rows, p, r WHERE mask & bit <> 0 GROUP BY policy, rule
"""



def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's fingerprint and the smallest document that links of at most two bits reach."""
    rows = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def _xxh64(texts: str) -> str:
    """SQL of (g, h) from a table of distinct strings ``g``: their XXH64 with seed 42, in 128-bit arithmetic.

    Turning by r bits is multiplying by 2**r modulo 2**64 - 1 (but for all ones, which no step here is likely to meet).
    """
    p1, p2, p3, p4, p5 = (f"{p}::UHUGEINT" for p in (11400714785074694791, 14029467366897019727, 1609587929392839161, 9650029242287828579, 2870177450012600261))
    full = f"{1 << 64}::UHUGEINT"
    mul = lambda a, b: f"(({a}) * {b} % {full})"
    turn = lambda a, r: f"(({a}) * {1 << r}::UHUGEINT % {(1 << 64) - 1}::UHUGEINT)"
    lane = lambda a, x: mul(turn(f"({a} + {mul(x, p2)}) % {full}", 31), p1)
    word = lambda at, n: "('0x' || " + " || ".join(f"substr(x, 2 * ({at}) + {2 * k + 1}, 2)" for k in reversed(range(n))) + ")::UBIGINT::UHUGEINT"
    start = [(42 + 11400714785074694791 + 14029467366897019727) % (1 << 64), (42 + 14029467366897019727) % (1 << 64), 42, (42 - 11400714785074694791) % (1 << 64)]
    lanes = ", ".join(f"list_reduce(list_prepend({v}::UHUGEINT, list_transform(range(0, n // 32), lambda i: {word(f'32 * i + {8 * k}', 8)})), lambda a, v: {lane('a', 'v')}) AS v{k}" for k, v in enumerate(start))
    steps = [f"CASE WHEN n < 32 THEN {(42 + 2870177450012600261)}::UHUGEINT ELSE ({turn('v0', 1)} + {turn('v1', 7)} + {turn('v2', 12)} + {turn('v3', 18)}) % {full} END"]
    steps += [f"CASE WHEN n < 32 THEN h ELSE ({mul(f'xor(h, {lane(0, f"v{k}")})', p1)} + {p4}) % {full} END" for k in range(4)]
    steps += [f"(h + n::UHUGEINT) % {full}"]
    steps += [f"list_reduce(list_prepend(h, list_transform(range(n // 32 * 4, n // 8), lambda i: {word('8 * i', 8)})), lambda a, v: ({mul(turn(f'xor(a, {lane(0, "v")})', 27), p1)} + {p4}) % {full})"]
    steps += [f"CASE WHEN n % 8 < 4 THEN h ELSE ({mul(turn(f'xor(h, {mul(word("n // 8 * 8", 4), p1)})', 23), p2)} + {p3}) % {full} END"]
    steps += [f"list_reduce(list_prepend(h, list_transform(range(n // 4 * 4, n), lambda i: {word('i', 1)})), lambda a, v: {mul(turn(f'xor(a, {mul("v", p5)})', 11), p1)})"]
    steps += [mul(f"xor(h, h // {1 << 33}::UHUGEINT)", p2), mul(f"xor(h, h // {1 << 29}::UHUGEINT)", p3), f"xor(h, h // {1 << 32}::UHUGEINT)"]
    sql = f"SELECT g, x, n, {lanes} FROM (SELECT g, hex(encode(g)) AS x, octet_length(encode(g)) AS n FROM {texts})"
    for step in steps:
        columns = "g, x, n, v0, v1, v2, v3"
        sql = f"SELECT {columns}, {step} AS h FROM ({sql})"
    return f"SELECT g, h::UBIGINT AS h FROM ({sql})"


_OP9 = rf"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents
), s AS (
  SELECT doc_id, array_to_string(ws[i:i + 2], ' ') AS g
  FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 1, 2))) AS i FROM w WHERE len(ws) > 0)
), texts AS (
  SELECT DISTINCT g FROM s
), hashed AS MATERIALIZED (
  {_xxh64('texts')}
), bits AS (
  SELECT doc_id, b, sum((h >> b) & 1) AS ones, count(*) AS n
  FROM s JOIN hashed USING (g), (SELECT unnest(range(0, 64))::UBIGINT AS b) GROUP BY doc_id, b
), prints AS MATERIALIZED (
  SELECT doc_id, coalesce(fp, 0)::UBIGINT AS fp
  FROM documents LEFT JOIN (SELECT doc_id, bit_or(CASE WHEN 2 * ones > n THEN 1::UBIGINT << b ELSE 0::UBIGINT END) AS fp FROM bits GROUP BY doc_id) USING (doc_id)
), links AS MATERIALIZED (
  SELECT p.fp AS a, q.fp AS b FROM (SELECT DISTINCT fp FROM prints) p, (SELECT DISTINCT fp FROM prints) q WHERE bit_count(xor(p.fp, q.fp)) <= 2
), reach AS (
  SELECT a, b FROM links UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a
), least AS (
  SELECT a AS fp, min(doc_id) AS component_id FROM reach JOIN prints ON reach.b = prints.fp GROUP BY a
)
SELECT doc_id, lower(lpad(hex(fp), 16, '0')) AS fingerprint, component_id FROM prints JOIN least USING (fp)
"""


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's bytes without those of 100-byte strings that start earlier too."""
    rows = suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


#: Strings of 100 bytes are 200 hexadecimal digits.
_OP10 = r"""
WITH d AS (
  SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents
), w AS (
  SELECT doc_id, s, substr(x, 2 * s + 1, 200) AS g
  FROM (SELECT doc_id, x, unnest(range(0, (len(x) // 2) - 99)) AS s FROM d)
), f AS (
  SELECT doc_id, s, row_number() OVER (PARTITION BY g ORDER BY doc_id, s) AS nth FROM w
), gone AS (
  SELECT doc_id, s, lag(s) OVER (PARTITION BY doc_id ORDER BY s) AS last FROM f WHERE nth > 1
), runs AS (
  SELECT doc_id, s, sum(CASE WHEN last IS NULL OR s > last + 100 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY s) AS run FROM gone
), spans AS (
  SELECT doc_id, run, min(s) AS b, max(s) + 100 AS e FROM runs GROUP BY doc_id, run
), cuts AS (
  SELECT doc_id, b, e, coalesce(lag(e) OVER (PARTITION BY doc_id ORDER BY b), 0) AS a FROM spans
), k AS (
  SELECT doc_id, sum(e - b)::BIGINT AS n_removed, count(*) AS n_spans, max(e) AS last, string_agg(substr(x, 2 * a + 1, 2 * (b - a)), '' ORDER BY b) AS kept
  FROM cuts JOIN d USING (doc_id) GROUP BY doc_id
)
SELECT doc_id, (len(x) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans,
  sha256(unhex(coalesce(kept, '') || substr(x, 2 * coalesce(last, 0) + 1))) AS kept_sha256
FROM d LEFT JOIN k USING (doc_id)
"""


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's words inside 13-word windows of the benchmark, and the items they come from."""
    rows = decontamination.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    digest = F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256")
    return rows.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), digest, "contaminated")


_OP1 = r"""
WITH dw AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents
), bw AS (
  SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark
), bl AS (
  SELECT item_id, ws, least(len(ws), 13) AS k FROM bw WHERE len(ws) > 0
), win AS (
  SELECT DISTINCT item_id, k, array_to_string(ws[i:i + k - 1], ' ') AS g
  FROM (SELECT item_id, ws, k, unnest(range(1, len(ws) - k + 2)) AS i FROM bl)
), ks AS (
  SELECT DISTINCT k FROM win
), pos AS (
  SELECT doc_id, ws, k, unnest(range(1, len(ws) - k + 2)) AS i FROM dw, ks WHERE len(ws) >= k
), occ AS (
  SELECT doc_id, k, i, item_id FROM (SELECT doc_id, k, i, array_to_string(ws[i:i + k - 1], ' ') AS g FROM pos) JOIN win USING (k, g)
), hit AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM (SELECT DISTINCT doc_id, k, i FROM occ)) GROUP BY doc_id
), it AS (
  SELECT doc_id, count(*) AS n_items, sha256(string_agg(x, ',' ORDER BY x)) AS s
  FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS x FROM occ) GROUP BY doc_id
)
SELECT doc_id, coalesce(len(ws), 0)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  coalesce(s, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= coalesce(len(ws), 0) AS contaminated
FROM dw LEFT JOIN hit USING (doc_id) LEFT JOIN it USING (doc_id)
"""

def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a mix of all sources, 150% of their size, takes of every document."""
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


_OP6 = rf"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '{WORD}')), 0)::BIGINT AS size FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1 AS place FROM d GROUP BY source
), w AS (
  SELECT *, [5.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE][place % 3 + 1] AS w, source_size * 2.0::DOUBLE AS most,
    sum(source_size) OVER () * 1.5::DOUBLE AS total FROM s
), h AS (
  SELECT *, (total - coalesce(sum(most) OVER (ORDER BY most / w, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(w) OVER (ORDER BY most / w, place ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS here FROM w
), t AS (
  SELECT source, source_size, least(most, w * (SELECT arg_min(here, most / w) FROM h WHERE most >= here * w)) AS target FROM h
), r AS (
  SELECT d.doc_id, d.size, source_size, target, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate,
    row_number() OVER (PARTITION BY d.source ORDER BY d.size, d.doc_id) AS i
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target,
  ((floor(i * rate + {mixing.offset()!r}::DOUBLE) - floor((i - 1) * rate + {mixing.offset()!r}::DOUBLE)) * size)::BIGINT AS taken
FROM r
"""

def op3_url_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's verdict, by rule or by its template's purity.

    The number in a page's path is that of the document it shows, whose label (bad: low quality or toxic) is the page's.
    """
    pages = table(spark, sf_dir, "pages")
    number = F.regexp_extract("url", r"://[^/?#]*/[^/?#]*/(\d{1,18})(?:\D|$)", 1)
    shown = pages.select("url", number.try_cast("long").alias("doc_id"))
    bad = (F.col("quality") == 0) | (F.col("toxic") == 1)
    labelled = shown.join(table(spark, sf_dir, "labels"), "doc_id").select("url", bad.alias("bad"))
    return url_templates.judge(pages, labelled).select("page_id", "host", "path", "rule", "verdict")


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's record, as read back from the archives and merged into one index."""
    return warc.archive(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


_OP8 = """
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, '')))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages
), m AS (
  SELECT payload_digest, payload_bytes, max(page_id) AS first FROM p WHERE payload_bytes >= 1000 GROUP BY ALL
)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN first <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN first <> page_id THEN first END AS refers_to
FROM p LEFT JOIN m USING (payload_digest, payload_bytes)
"""

#: Only for this query over invented values; a real run brings a secret of its own.
DEMO_KEY = "bendscape-demo-key"


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its private values exchanged for pseudonyms."""
    return pii.pseudonymise(table(spark, sf_dir, "documents"), DEMO_KEY).select("doc_id", "text", "n_private")


def op7_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's main text."""
    rows = html_text.extract(table(spark, sf_dir, "pages"))
    return rows.withColumn("n_chars", F.length("text").cast("long"))


def op5_attention_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's scores by the unigram baseline and by the attention model."""
    return attention_lm.score(table(spark, sf_dir, "documents")).drop("h")


def op13_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's fingerprint, that of an edited text, and its likeness to this and to the next document's."""
    return fingerprints.robustness(table(spark, sf_dir, "documents"))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every node of the prefix trie of rebuilt conversations."""
    return prefix_trie.prefix_nodes(table(spark, sf_dir, "conversations"))


_OP11 = """
WITH bytes AS (
  SELECT i::UBIGINT AS x FROM range(256) r(i)
), crc AS (
  SELECT list(list_reduce(list_prepend(x, list_transform(range(8), lambda k: 0::UBIGINT)),
    lambda a, k: xor(a >> 1, CASE WHEN a & 1 = 1 THEN 3988292384 ELSE 0 END)) ORDER BY x) AS t FROM bytes
), turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS r, coalesce(text, '') AS x FROM conversations WHERE conv_id IS NOT NULL
), coded AS (
  SELECT conv_id, turn, dense_rank() OVER (ORDER BY r, x) AS id, length(x) AS n FROM turns
), convs AS (
  SELECT conv_id, list(id ORDER BY turn NULLS FIRST, id) AS s,
    (SELECT xor(list_reduce(list_prepend(4294967295::UBIGINT, list_transform(string_split(conv_id::VARCHAR, ''), lambda c: ascii(c)::UBIGINT)),
      lambda a, b: xor(a >> 8, t[(xor(a, b) & 255)::INT + 1])), 4294967295::UBIGINT) FROM crc) % 6 AS h
  FROM coded GROUP BY conv_id
), built AS (
  SELECT c.conv_id, list_concat(coalesce(b.s[1:c.h], []), c.s[c.h + 1:]) AS s FROM convs c LEFT JOIN convs b ON b.conv_id = c.conv_id - c.conv_id % 100
), starts AS (
  SELECT conv_id, s[1:d] AS p, d = len(s) AS whole FROM (SELECT conv_id, s, unnest(range(len(s) + 1)) AS d FROM built)
), nodes AS (
  SELECT p, len(p) AS depth, min(conv_id) AS conv_id, count(*) AS n,
    sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (whole), '')) AS ends FROM starts GROUP BY p
), costed AS (
  SELECT nodes.*, coalesce((nodes.n - 1) * c.n, 0) AS own FROM nodes LEFT JOIN (SELECT DISTINCT id, n FROM coded) c ON c.id = p[depth]
), children AS (
  SELECT p[1:depth - 1] AS p, count(*) AS k FROM nodes WHERE depth > 0 GROUP BY 1
), parts AS (
  SELECT p[1:d] AS top, own, k IS NULL AS leaf FROM (SELECT c.p, own, k, unnest(range(depth + 1)) AS d FROM costed c LEFT JOIN children USING (p))
), sums AS (
  SELECT top AS p, sum(own) AS saved, count(*) FILTER (leaf) AS leaves FROM parts GROUP BY top
)
SELECT n.conv_id, n.depth::BIGINT AS depth, u.conv_id AS parent_conv_id, n.n AS n_convs, coalesce(k, 0)::BIGINT AS n_children,
  leaves AS n_leaves, saved::BIGINT AS saved_tokens, n.ends AS ends_sha256
FROM nodes n JOIN sums USING (p) LEFT JOIN children c USING (p) LEFT JOIN nodes u ON n.depth > 0 AND u.p = n.p[1:n.depth - 1]
"""


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each of five filters removes and costs, in every order, for each language."""
    return filter_audit.audit(filter_audit.masks(table(spark, sf_dir, "documents")), table(spark, sf_dir, "labels"))


_OP12 = r"""
WITH w AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents
), l AS (
  SELECT doc_id, coalesce(bool_or(quality = 1), false) AS good, coalesce(bool_or(toxic = 1), false) AS toxic FROM labels GROUP BY doc_id
), d AS (
  SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic, [
    len(ws) < 200, 100 * len(list_distinct(ws)) < 50 * len(ws), 100 * len(regexp_extract_all(t, '[A-Z]')) > 3 * length(t),
    regexp_matches(t, '[#$%&*|]'), coalesce(w.doc_id > min(w.doc_id) OVER (PARTITION BY t), false)] AS f
  FROM w LEFT JOIN l USING (doc_id)
), c AS (
  SELECT part, f, count(*) AS n, count(*) FILTER (good) AS g, count(*) FILTER (toxic) AS x FROM d GROUP BY ALL
), letters(l) AS (
  SELECT unnest(range(1, 6))
), orders AS (
  SELECT [a.l, b.l, c.l, d.l, e.l] AS o FROM letters a, letters b, letters c, letters d, letters e
  WHERE len(list_distinct([a.l, b.l, c.l, d.l, e.l])) = 5
), steps AS (
  SELECT o, s, o[s] AS own, o[1:s - 1] AS before FROM orders, (SELECT unnest(range(1, 6)) AS s)
), r AS (
  SELECT part, o, s, own,
    sum(CASE WHEN NOT f[own] AND len(list_filter(before, lambda k: f[k])) = 0 THEN n ELSE 0 END) AS kept,
    sum(CASE WHEN f[own] AND len(list_filter(before, lambda k: f[k])) = 0 THEN n ELSE 0 END) AS removed,
    sum(CASE WHEN f[own] AND len(list_filter(before, lambda k: f[k])) > 0 THEN n ELSE 0 END) AS redundant,
    sum(CASE WHEN f[own] AND len(list_filter(f, lambda k: k)) = 1 THEN n ELSE 0 END) AS unique_fails,
    sum(CASE WHEN f[own] AND len(list_filter(before, lambda k: f[k])) = 0 THEN g ELSE 0 END) AS good_lost,
    sum(CASE WHEN f[own] AND len(list_filter(before, lambda k: f[k])) = 0 THEN x ELSE 0 END) AS toxic_lost
  FROM c, steps GROUP BY ALL
)
SELECT part, list_aggregate(list_transform(o, lambda k: substr('ABCDE', k, 1)), 'string_agg', '') AS filter_order, s::INT AS step,
  kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant, unique_fails::BIGINT AS unique_fails,
  good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost, (sum(removed) OVER (PARTITION BY part, own))::BIGINT AS shapley
FROM r
"""


QUERIES = {"op11_prefix_trie": op11_prefix_trie, "op13_fingerprints": op13_fingerprints, "op12_filter_audit": op12_filter_audit, "op5_attention_lm": op5_attention_lm, "op7_html_text": op7_html_text, "op4_pii": op4_pii, "op8_warc": op8_warc, "op3_url_templates": op3_url_templates, "op6_mixing": op6_mixing, "op1_decontamination": op1_decontamination, "op10_suffix_dedup": op10_suffix_dedup, "op9_simhash": op9_simhash, "op2_quality_rules": op2_quality_rules, "quality_ablations": quality_ablations}
ORACLES = {"op11_prefix_trie": _OP11, "op12_filter_audit": _OP12, "op8_warc": _OP8, "op6_mixing": _OP6, "op1_decontamination": _OP1, "op2_quality_rules": _OP2, "quality_ablations": _ABLATIONS, "op9_simhash": _OP9, "op10_suffix_dedup": _OP10}
