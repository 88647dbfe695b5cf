"""URL filters by a path-template tree with labelled purity, after explicit host and path rules.

Each host has a tree of path templates. Segments that spell numbers or hexadecimal ids are wildcards from the start.
Then, level by level from the root: (1) if a branch has more than ``children`` different next segments that repeat less
than ``support`` times on average, they are variable and become one wildcard; (2) branches whose share of bad labelled
pages doesn't differ from that of all their siblings together (a two-sided z test), or that have no labels, are merged
into one branch. A template's purity is its share of good labelled pages, smoothed by ``prior`` pages with the purity
of all labelled pages; a template is rejected if that is below ``least``.

The tree is built over distinct (host, generalised path) rows with their counts, never over pages; it is counted with
aggregates that are combined before the shuffle, so a hot host is no hot task. A path that shares its template so far
with no other is the only branch below it, whatever the level; its remaining segments are merged at once, and levels end
with the last two paths that share one. (``depth``, if given, makes all segments beyond that many levels one last segment.)

Defined results: a null url, or one without ``://``, has an empty host and path, and is judged like any other; ids may
be null or repeat, each row is judged; rows of labels may be missing, null (no label) or repeat (each counts); without
labels everything that no rule blocks is allowed; an empty table gives no rows. Further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bendscape.llm.common import cut

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Host, path and verdict of the default rules.
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_for(host: Column, path: Column, rules: tuple[tuple[str, str, str], ...] = RULES) -> Column:
    """The longest rule that fits, as a struct (rule, verdict); null if none does."""
    out = None
    for at, start, verdict in sorted(rules, key=lambda r: -len(r[0] + r[1])):
        fits = ((host == at) | host.endswith("." + at)) & path.startswith(start)
        value = F.struct(F.lit(at + start).alias("rule"), F.lit(verdict).alias("verdict"))
        out = F.when(fits, value) if out is None else out.when(fits, value)
    return F.lit(None).cast("struct<rule:string,verdict:string>") if out is None else out


def generalised(path: Column, depth: int | None = None) -> Column:
    """A path's segments, with numbers and hexadecimal ids as wildcards, at most ``depth`` of them."""
    segments = F.filter(F.split(path, "/"), lambda s: s != "")
    shown = F.transform(segments, lambda s: F.when(s.rlike(r"^(?=.*[0-9])[0-9a-fA-F-]{8,}$"), F.lit("#")).otherwise(F.regexp_replace(s, "[0-9]+", "#")))
    if depth is None:
        return shown
    return F.when(F.size(shown) <= depth, shown).otherwise(F.concat(F.slice(shown, 1, depth - 1), F.array(F.array_join(F.slice(shown, depth, F.size(shown)), "/"))))


def tree(counts: DataFrame, children: int = 16, support: float = 4.0, z: float = 1.96) -> DataFrame:
    """``counts`` (host, path array, n, labelled, bad; one row for each host and path) with ``template``, the branch that
    each path ends in."""
    rows = cut(counts.withColumns({"template": F.col("path"), "open": F.size("path") > 0}))
    level = 0
    while not rows.where("open").isEmpty():
        level += 1
        above, here = F.slice("template", 1, level - 1), F.get("template", F.lit(level - 1))
        at = rows.where("open").select("host", above.alias("above"), here.alias("segment"), "n", "labelled", "bad")
        branch = at.groupBy("host", "above", "segment").agg(F.count("*").alias("paths"), *[F.sum(c).alias(c) for c in ("n", "labelled", "bad")])
        parent = branch.groupBy("host", "above").agg(F.count("*").alias("kids"), *[F.sum(c).alias(f"all_{c}") for c in ("paths", "n", "labelled", "bad")])
        share = F.col("all_bad") / F.col("all_labelled")
        off = F.abs(F.col("bad") / F.col("labelled") - share)
        differs = (F.col("labelled") > 0) & (off > z * F.sqrt(share * (1 - share) / F.col("labelled")))
        variable = (F.col("kids") > children) & (F.col("kids") * support > F.col("all_n"))
        name = F.when(variable, F.lit("*")).when(F.coalesce(differs, F.lit(False)), F.col("segment")).otherwise(F.lit("~"))
        named = branch.join(parent, ["host", "above"]).select("host", "above", "segment", name.alias("named"), (F.col("all_paths") == 1).alias("alone"))
        # Rows that are done have no segment to join on.
        rows = rows.withColumns({"above": F.when(F.col("open"), above), "segment": here}).join(named, ["host", "above", "segment"], "left")
        size = F.size("template")
        rest = F.when(F.col("alone"), F.array_repeat(F.lit("~"), size - level)).otherwise(F.slice("template", level + 1, size))
        new = F.when(F.col("open"), F.concat("above", F.array("named"), rest)).otherwise(F.col("template"))
        goes_on = F.col("open") & ~F.coalesce("alone", F.lit(True)) & (size > level)
        rows = cut(rows.select(*counts.columns, new.alias("template"), goes_on.alias("open")))
    return rows.drop("open")


def judge(pages: DataFrame, labelled: DataFrame, rules: tuple[tuple[str, str, str], ...] = RULES, key: str = "page_id", url: str = "url", depth: int | None = None, prior: float = 20.0, least: float = 0.5, **options) -> DataFrame:
    """(key, host, path, rule, verdict, template, purity) for each row of ``pages``.

    ``labelled`` has rows (url, bad): the url of a labelled page and whether it is a bad one.
    """
    parts = lambda df, *more: df.select(host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("full"), *more).withColumn("path", generalised(F.col("full"), depth))
    judged = parts(pages, F.col(key))
    zero, one = F.lit(0).cast("long"), F.lit(1).cast("long")
    seen = judged.select("host", "path", one.alias("n"), zero.alias("labelled"), zero.alias("bad"))
    known = parts(labelled.where(F.col("bad").isNotNull()), F.col("bad")).select("host", "path", zero.alias("n"), one.alias("labelled"), F.col("bad").cast("long").alias("bad"))
    counts = seen.unionByName(known).groupBy("host", "path").agg(*[F.sum(c).alias(c) for c in ("n", "labelled", "bad")])
    rows = tree(counts, **options)
    whole = rows.agg(F.sum("labelled"), F.sum("bad")).first()
    mean = 1 - whole[1] / whole[0] if whole[0] else 1.0
    purity = (F.sum("labelled") - F.sum("bad") + F.lit(prior * mean)) / (F.sum("labelled") + F.lit(prior))
    of_template = rows.groupBy("host", "template").agg(purity.alias("purity"))
    of_path = rows.select("host", "path", "template").join(of_template, ["host", "template"])
    rule = rule_for(F.col("host"), F.col("full"), rules)
    out = judged.join(of_path, ["host", "path"], "left").withColumn("rule", rule)
    verdict = F.coalesce(F.col("rule.verdict"), F.when(F.col("purity") < least, F.lit("block")).otherwise(F.lit("allow")))
    return out.select(key, "host", F.col("full").alias("path"), F.col("rule.rule").alias("rule"), verdict.alias("verdict"), F.concat(F.lit("/"), F.array_join("template", "/")).alias("template"), "purity")
