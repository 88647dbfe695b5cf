"""Quality rules as a bitmask ledger, in DataFrame functions only.

Every rule is evaluated once per document. The ledger keeps what was measured and one bit for each rule that failed;
policies (a version name and the rules that count) are then applied to the stored bits, and an ablation asks, by
bitwise aggregation over the ledger, what each rule of a policy rejects, rejects alone, and would let back in. A policy
only adds rules at its end and a rule keeps its bit, so a stored ledger serves old and new policies.

Defined results: a null or empty text has no words, so it fails ``few_words``; any other column may be null and is
carried along; repeated rows get a ledger row each; an empty table gives an empty ledger. Columns of the input whose
names the ledger uses are not carried into it.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bendscape.llm.common import SPACE, cut, fresh, let, listed, words


@dataclass(frozen=True)
class Rule:
    """A rule fails where ``fails``, given the measurements, is true; ``bit`` is its place in the ledger for good."""

    name: str
    bit: int
    fails: Callable[[Column], Column]


@dataclass(frozen=True)
class Policy:
    version: str
    rules: tuple[str, ...]


RULES = (
    Rule("few_words", 0, lambda m: m["n_words"] < 10),
    Rule("repeated_words", 1, lambda m: 100 * m["n_repeat_words"] > 20 * m["n_words"]),
    Rule("symbols", 2, lambda m: 10 * m["n_symbols"] > m["n_words"]),
    Rule("exclamations", 3, lambda m: 10 * m["n_exclamations"] > 3 * m["n_words"]),
    Rule("capitals", 4, lambda m: 10 * m["n_capitals"] > 3 * m["word_chars"]),
    Rule("repeated_lines", 5, lambda m: 2 * m["n_dup_lines"] > m["n_lines"]),
    Rule("word_length", 6, lambda m: (m["word_chars"] < 2 * m["n_words"]) | (m["word_chars"] > 15 * m["n_words"])),
    Rule("few_letters", 7, lambda m: 10 * m["n_alpha_words"] < 7 * m["n_words"]),
    Rule("bullets", 8, lambda m: 10 * m["n_bullet_lines"] > 9 * m["n_lines"]),
    Rule("cut_off_lines", 9, lambda m: 10 * m["n_cut_lines"] > 3 * m["n_lines"]),
)
BASE = Policy("base", ("few_words", "repeated_words"))
V2 = Policy("v2", tuple(r.name for r in RULES))
POLICIES = (BASE, Policy("v1", tuple(r.name for r in RULES[:7])), Policy("v1-lenient", ("few_words", "repeated_words", "symbols", "exclamations")), V2)
MEASURES = ("n_words", "word_chars", "n_symbols", "n_exclamations", "n_capitals", "n_alpha_words", "n_lines", "n_dup_lines", "n_bullet_lines", "n_cut_lines", "n_repeat_words")
#: Java and RE2 patterns of a word with a letter (or any character beyond ASCII), of a line that begins as an item of a
#: list, and of one that ends in an ellipsis.
LETTER, BULLET, CUT_OFF = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]", r"^[\x20\x09-\x0D]*[-*•]", r"(?:\.\.\.|…)[\x20\x09-\x0D]*\z"


def repeat_words(w: Column, size: int = 5) -> Column:
    """How many words stand in windows of ``size`` words that occur twice or more, the first occurrence included.

    Windows are compared by a 64-bit hash of their words. Only texts with a repeated window are sorted.
    """
    at = F.when(F.size(w) >= size, F.sequence(F.lit(0), F.size(w) - size)).otherwise(F.array().cast("array<int>"))
    hashes = F.transform(at, lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(size)]))

    def covered(h: Column) -> Column:
        ordered = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))

        def count(s: Column) -> Column:
            twin = lambda i, k: F.coalesce(F.get(s, i + k)["h"] == F.get(s, i)["h"], F.lit(False))
            marked = F.transform(s, lambda x, i: F.when(twin(i, -1) | twin(i, 1), x["i"]))
            starts = F.array_sort(F.filter(marked, lambda i: i.isNotNull()))
            start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(-size).alias("last"))
            step = lambda acc, i: F.struct((acc["n"] + F.least(F.lit(size), i - acc["last"])).alias("n"), i.alias("last"))
            return F.aggregate(starts, start, step, lambda acc: acc["n"])

        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(let(ordered, count))

    return let(hashes, covered)


def measured(text: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """All measurements of a text, and ``failed``, a bit for each rule that fails, as one struct.

    It is a single expression in which everything is bound once, so a filter on it measures a text once too.
    """
    t = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(t, "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
    chars = lambda c: F.length(c).cast("long")
    long = lambda c: c.cast("long")

    def counted(w: Column) -> Column:
        return let(lines, lambda x: F.struct(
            long(F.size(w)).alias("n_words"),
            chars(F.translate(t, " \t\n\x0b\x0c\r", "")).alias("word_chars"),
            (chars(t) - chars(F.translate(t, "#*$%&|<>", ""))).alias("n_symbols"),
            (chars(t) - chars(F.translate(t, "!", ""))).alias("n_exclamations"),
            (chars(t) - chars(F.translate(t, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))).alias("n_capitals"),
            long(F.size(F.filter(w, lambda v: v.rlike(LETTER)))).alias("n_alpha_words"),
            long(F.size(x)).alias("n_lines"),
            long(F.size(x) - F.size(F.array_distinct(x))).alias("n_dup_lines"),
            long(F.size(F.filter(x, lambda v: v.rlike(BULLET)))).alias("n_bullet_lines"),
            long(F.size(F.filter(x, lambda v: v.rlike(CUT_OFF)))).alias("n_cut_lines"),
            repeat_words(w).alias("n_repeat_words"),
        ))

    def judged(m: Column) -> Column:
        bits = F.lit(0).cast("long")
        for r in rules:
            bits = bits.bitwiseOR(F.when(r.fails(m), F.lit(1 << r.bit)).otherwise(F.lit(0)).cast("long"))
        return F.struct(*[m[c].alias(c) for c in MEASURES], bits.alias("failed"))

    return let(let(words(text), counted), judged)


def ledger(docs: DataFrame, rules: tuple[Rule, ...] = RULES, key: str = "doc_id", text: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """One row per document: the key, ``carry``, all measurements, and ``failed``, a bit for each failed rule."""
    keep = [c for c in dict.fromkeys((key, *carry)) if c not in (*MEASURES, "failed")]
    return docs.select(*keep, measured(F.col(text), rules).alias("_m")).select(*keep, "_m.*")


def mask(policy: Policy, rules: tuple[Rule, ...] = RULES) -> int:
    """The bits that count under a policy."""
    return sum(1 << r.bit for r in rules if r.name in policy.rules)


def passes(policy: Policy, rules: tuple[Rule, ...] = RULES, failed: Column | None = None) -> Column:
    """True where none of a policy's rules failed."""
    return (F.col("failed") if failed is None else failed).bitwiseAND(F.lit(mask(policy, rules)).cast("long")) == 0


def stored(docs: DataFrame, rules: tuple[Rule, ...] = RULES, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The ledger, written once in the shared folder, with ``h``, a hash of the text, which tells rows of one key apart."""
    (h,) = fresh(docs.columns, "h")
    return cut(ledger(docs.withColumn(h, F.xxhash64(F.coalesce(F.col(text), F.lit("")))), rules, key, text, (h,)).withColumnRenamed(h, "h"))


def kept(docs: DataFrame, policy: Policy, rules: tuple[Rule, ...] = RULES, key: str = "doc_id", text: str = "text", rows: DataFrame | None = None) -> DataFrame:
    """The documents that pass a policy, as they are, by their ledger (``rows``: one stored before)."""
    rows = stored(docs, rules, key, text) if rows is None else rows
    k, h = fresh(docs.columns, "key", "h")
    failed = listed(rows.where(~passes(policy, rules)).select(F.col(key).alias(k), F.col("h").alias(h)).distinct())
    return docs.join(failed, F.col(key).eqNullSafe(F.col(k)) & (F.xxhash64(F.coalesce(F.col(text), F.lit(""))) == F.col(h)), "left_anti")


def ablations(rows: DataFrame, policies: tuple[Policy, ...] = POLICIES, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """For each policy and rule of it: documents, kept, rejected by the rule, and kept if only this rule went.

    The ledger is first counted by its bits (at most two to the power of the rules), then each count is compared.
    """
    counts = rows.groupBy("failed").agg(F.count("*").alias("n"))
    pairs = [F.struct(F.lit(p.version).alias("policy"), F.lit(r.name).alias("rule"), F.lit(mask(p, rules)).cast("long").alias("mask"), F.lit(1 << r.bit).cast("long").alias("bit")) for p in policies for r in rules if r.name in p.rules]
    hit = F.col("failed").bitwiseAND(F.col("p.mask"))
    total = lambda c: F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0)).cast("long")
    return (
        counts.select("failed", "n", F.explode(F.array(*pairs)).alias("p"))
        .groupBy(F.col("p.policy").alias("policy"), F.col("p.rule").alias("rule"))
        .agg(
            F.sum("n").alias("documents"),
            total(hit == 0).alias("kept"),
            total(hit.bitwiseAND(F.col("p.bit")) != 0).alias("rejected"),
            total(hit == F.col("p.bit")).alias("rejected_alone"),
            F.bit_or(hit).alias("bits_seen"),
        )
    )
