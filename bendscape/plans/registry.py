"""All queries over the driver's tables, each with the SQL that DuckDB answers it with.

The tables hold no DNA, so bases are derived from the documents' texts. Doubles are published with six digits.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bendscape.functions import bases, matrices
from bendscape.operators import calls, curvature, intervals, pieces, symmetry
from bendscape.plans import analysis, functions
from bendscape.sources import bigwig, checked, fasta, fasta_ranges, shared, sinks, store

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None):
    """Registers a query under its function's name."""

    def put(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return put


def sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(seq_id, seq): a sequence for each document, with N at the ends of its lines."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return docs.select(F.col("doc_id").alias("seq_id"), bases.from_text(F.col("text")).alias("seq"))


def all_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.split_by_n(sequences(spark, sf_dir))


def _tasks(spark: SparkSession) -> int:
    """Over how many tasks chunks are dealt: rows of bases are few and short, what is made of them is some thirty times as long."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def _six(c: str) -> Column:
    """``c`` with six digits, halves away from zero. In doubles, as SQL does it; decimals, which take many times as long,
    only where a double has no room for the digits."""
    scaled = F.abs(F.col(c)) * 1e6
    low = F.floor(scaled)
    near = (low + F.when(scaled - low >= 0.5, 1).otherwise(0)) / F.lit(1e6)
    return F.when(F.abs(F.col(c)) < 1e9, F.when(F.col(c) < 0, -near).otherwise(near)).otherwise(F.round(c, 6))


def shown(df: DataFrame, *exact: str) -> DataFrame:
    """Doubles with six digits, and no negative zero."""
    doubles = [f.name for f in df.schema.fields if f.dataType.typeName() == "double" and f.name not in exact]
    return df.withColumns({c: _six(c) + F.lit(0.0) for c in doubles})


# ---------------------------------------------------------------- SQL

_SEQ = r"""seqs AS (
  SELECT doc_id AS seq_id, translate(upper(regexp_replace(coalesce(text, ''), '[^A-Za-z\n]', '', 'g')),
    'BDEFHIJKLMNOPQRSUVWXYZ' || chr(10), 'CGTATCGATCGATCGATCGATCN') AS seq
  FROM documents
)"""
_PIECES = rf"""{_SEQ}, tokens AS (
  SELECT seq_id, t[i] AS tok, i FROM (SELECT seq_id, t, unnest(range(1, len(t) + 1)) AS i
    FROM (SELECT seq_id, regexp_extract_all(seq, 'N+|[^N]+') AS t FROM seqs))
), placed AS (
  SELECT seq_id, tok, i, 1 + coalesce(sum(length(tok)) OVER (PARTITION BY seq_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start
  FROM tokens
), pieces AS (
  SELECT seq_id, (row_number() OVER (PARTITION BY seq_id ORDER BY i) - 1)::INT AS piece, start, start + length(tok) - 1 AS "end", tok AS seq
  FROM placed WHERE tok NOT LIKE 'N%'
)"""
_MATRIX = "matrix(triplet, roll_active, roll_simple, twist, tilt) AS (VALUES " + ", ".join(
    f"('{t}', {a!r}::DOUBLE, {s!r}::DOUBLE, {w!r}::DOUBLE, {x!r}::DOUBLE)"
    for t, a, s, w, x in zip(matrices.TRIPLETS, *[[float(y) for y in v] for v in (matrices.BUILTIN.roll_active, matrices.BUILTIN.roll_simple, matrices.BUILTIN.twist, matrices.BUILTIN.tilt)], strict=True)
) + ")"
_TRIPLETS = rf"""{_PIECES}, {_MATRIX}, trip AS (
  SELECT seq_id, piece, i::INT AS pos, substr(seq, i + 1, 3) AS triplet
  FROM (SELECT seq_id, piece, seq, unnest(range(0, length(seq) - 2)) AS i FROM pieces)
)"""
_STEPS = rf"""{_TRIPLETS}, steps AS (
  SELECT seq_id, piece, pos, roll_active, roll_simple, twist, (pos + 1) * twist AS twist_sum,
    roll_active * sin((pos + 1) * twist) AS dxa, roll_active * cos((pos + 1) * twist) AS dya,
    roll_simple * sin((pos + 1) * twist) AS dxs, roll_simple * cos((pos + 1) * twist) AS dys
  FROM trip JOIN matrix USING (triplet)
)"""
_COORDS = rf"""{_STEPS}, coords AS (
  SELECT seq_id, piece, pos + 1 AS pos, sum(dxa) OVER w AS xa, sum(dya) OVER w AS ya, sum(dxs) OVER w AS xs, sum(dys) OVER w AS ys
  FROM steps WINDOW w AS (PARTITION BY seq_id, piece ORDER BY pos ROWS UNBOUNDED PRECEDING)
)"""
_MEAN = lambda v: f"(sum({v}) OVER m - 0.5 * first_value({v}) OVER m - 0.5 * last_value({v}) OVER m) / 10 AS {v}"
_MEANS = rf"""{_COORDS}, means AS (
  SELECT * FROM (SELECT seq_id, piece, pos, {", ".join(map(_MEAN, ("xa", "ya", "xs", "ys")))}, count(*) OVER m AS k FROM coords
    WINDOW m AS (PARTITION BY seq_id, piece ORDER BY pos ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING)) WHERE k = 11
)"""
_FAR = lambda v: f"(lead({v}, 15) OVER p - lag({v}, 15) OVER p)"
_CURVED = rf"""{_MEANS}, curved AS (
  SELECT * FROM (SELECT seq_id, piece, pos, sqrt({_FAR("xa")} * {_FAR("xa")} + {_FAR("ya")} * {_FAR("ya")}) AS da,
    sqrt({_FAR("xs")} * {_FAR("xs")} + {_FAR("ys")} * {_FAR("ys")}) AS ds
    FROM means WINDOW p AS (PARTITION BY seq_id, piece ORDER BY pos)) WHERE da IS NOT NULL
)"""


def _symmetry(k: str) -> str:
    return f"""frames_{k} AS (
  SELECT * FROM (SELECT seq_id, piece, pos, k, n, lag(k) OVER p AS b, lead(k) OVER p AS a,
    list(k) OVER (PARTITION BY seq_id, piece ORDER BY pos ROWS BETWEEN 50 PRECEDING AND 50 FOLLOWING) AS f
    FROM (SELECT c.seq_id, c.piece, pos, round(0.33335 * d{k}, 9) AS k, length(seq) AS n FROM curved c JOIN pieces USING (seq_id, piece))
    WINDOW p AS (PARTITION BY seq_id, piece ORDER BY pos)) WHERE pos BETWEEN 101 AND n - 123
), sums_{k} AS (
  SELECT seq_id, piece, pos, round(list_sum(list_transform(range(1, 51), lambda j: abs(f[51 + j] - f[51 - j]))), 9) AS s,
    round(b - k, 9) AS b, round(a - k, 9) AS a FROM frames_{k}
), sym_{k} AS (
  SELECT seq_id, piece, pos, s, CASE WHEN low THEN 1.0::DOUBLE / round(b + a, 9) ELSE 0 END AS weight,
    CASE WHEN s > 0 THEN (CASE WHEN low THEN 1.0::DOUBLE / round(b + a, 9) ELSE 0 END) / s WHEN low THEN 100.0 ELSE 0 END AS score
  FROM (SELECT *, b > 0 AND a > 0 AND round(b + a, 9) >= 0.01 AS low FROM sums_{k})
)"""


_ACTIVE, _SIMPLE = f"{_CURVED}, {_symmetry('a')}", f"{_CURVED}, {_symmetry('s')}"
_BOTH = f"{_CURVED}, {_symmetry('a')}, {_symmetry('s')}, sym AS (SELECT a.seq_id, a.piece, a.pos, a.s AS sa, a.weight AS wa, a.score AS ca, s.s AS ss, s.weight AS ws, s.score AS cs FROM sym_a a JOIN sym_s s USING (seq_id, piece, pos))"
_R = lambda v, name: f"round({v}, 6) + 0.0 AS {name}"
_CALLS = lambda k: f"calls AS (SELECT seq_id, piece, pos AS dyad, pos - 73 AS start, pos + 73 AS \"end\", score, least(score, 100.0) AS score_capped FROM sym_{k} WHERE score > 0)"
_GREEDY = """rounds AS (
  SELECT seq_id, piece, dyad, s, first_value(dyad) OVER (PARTITION BY seq_id, piece ORDER BY s DESC, dyad) AS best
  FROM (SELECT *, round(score, 6) AS s FROM calls) WHERE dyad > 177
  UNION ALL
  SELECT seq_id, piece, dyad, s, first_value(dyad) OVER (PARTITION BY seq_id, piece ORDER BY s DESC, dyad) AS best
  FROM rounds WHERE abs(dyad - best) > 177
), kept AS (SELECT c.* FROM calls c JOIN (SELECT DISTINCT seq_id, piece, best AS dyad FROM rounds) USING (seq_id, piece, dyad))"""


# ---------------------------------------------------------------- sources and sequences

@query(r"SELECT doc_id AS seq_id, regexp_replace(translate(regexp_replace(coalesce(text, ''), '[ \t-\r]', '', 'g'), 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ'), '[^ACGT]', 'A', 'g') AS seq FROM documents")
def normalize_seq(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return docs.select(F.col("doc_id").alias("seq_id"), bases.normalize_seq(F.coalesce("text", F.lit(""))).alias("seq"))


def _per_piece(column: Callable[[Column], Column]):
    return lambda spark, sf_dir: all_pieces(spark, sf_dir).select("seq_id", "piece", column(F.col("seq")).alias("seq"))


@query(f"WITH {_PIECES} SELECT seq_id, piece, reverse(translate(seq, 'AGCT', 'TCGA')) AS seq FROM pieces")
def reverse_complement(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _per_piece(bases.reverse_complement)(spark, sf_dir)


@query(f"WITH {_PIECES} SELECT seq_id, piece, translate(seq, 'ATGC', '0123') AS seq FROM pieces")
def encode_bases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _per_piece(bases.encode_bases)(spark, sf_dir)


@query(f"""WITH {_PIECES} SELECT seq_id, piece, start, "end", seq, seq_id || ' ' || start || '-' || "end" AS description FROM pieces""")
def split_by_n(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.label(all_pieces(spark, sf_dir))


@query(f"""WITH {_PIECES} SELECT seq_id, piece, substr(s.seq, start, "end" - start + 1) AS seq FROM pieces JOIN seqs s USING (seq_id)""")
def piece_sequence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.piece_sequence(sequences(spark, sf_dir), all_pieces(spark, sf_dir).drop("seq")).select("seq_id", "piece", "seq")


@query(f"WITH {_SEQ} SELECT seq_id::VARCHAR AS seq_id, 'of the corpus' AS description, seq FROM seqs")
def read_fasta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sequences written as FASTA and read again."""
    rows = sequences(spark, sf_dir).select("seq_id", F.lit("of the corpus").alias("description"), "seq")
    return fasta.read_fasta(spark, fasta.round_trip(rows)).select("seq_id", "description", "seq")


@query(f"WITH {_SEQ} SELECT 'c' || seq_id AS seq_id, seq_id AS \"offset\", CASE WHEN seq_id % 2 = 0 THEN '+' ELSE '-' END AS strand, seq FROM seqs")
def read_fasta_legacy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sequences written with headers of title, offset and strand, and read again."""
    strand = F.when(F.col("seq_id") % 2 == 0, F.lit("+")).otherwise(F.lit("-"))
    rows = sequences(spark, sf_dir).select(F.concat(F.lit("c"), F.col("seq_id").cast("string")).alias("seq_id"), F.col("seq_id").alias("offset"), strand.alias("strand"), "seq")
    return fasta.read_fasta_legacy(spark, fasta.round_trip(rows, legacy=True)).where("problem is null").select("seq_id", "offset", "strand", "seq")


def _as_fasta(spark: SparkSession, sf_dir: str) -> str:
    """A new folder with the sequences as FASTA."""
    return fasta.round_trip(sequences(spark, sf_dir).select("seq_id", F.lit(None).cast("string").alias("description"), "seq"))


def _stored(spark: SparkSession, path: str) -> store.Store:
    """FASTA read by small ranges of bytes, in blocks of two bits a base."""
    parts = fasta_ranges.read_parts(spark, path, 1 << 16)
    return store.pack(parts.select(F.col("seq_id").cast("long").alias("seq_id"), "at", "bases"))


def _kept(spark: SparkSession, sf_dir: str) -> store.Store:
    """Sequences written as FASTA, and kept in blocks; the FASTA is not needed any more then."""
    path = _as_fasta(spark, sf_dir)
    found = _stored(spark, path).kept()
    shared.drop(spark, path)
    return found


@query(f"""WITH {_SEQ} SELECT seq_id, b::INT AS block, length(substr(seq, b * 32768 + 1, 32768))::INT AS n, substr(seq, b * 32768 + 1, 32768) AS seq
FROM (SELECT seq_id, seq, unnest(range(0, (length(seq) + 32767) // 32768)) AS b FROM seqs)""")
def stored_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The bases that the blocks of the store stand for."""
    return _stored(spark, _as_fasta(spark, sf_dir)).text()


@query(f"""WITH {_PIECES} SELECT seq_id, piece, start, "end", seq FROM pieces""")
def stored_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces found in the store, and their bases looked up in it."""
    found = _kept(spark, sf_dir)
    return found.slices(found.pieces())


@query(f"WITH {_CURVED} SELECT seq_id, piece, pos, {_R('0.33335 * da', 'curv_active')}, {_R('0.33335 * ds', 'curv_simple')} FROM curved")
def stored_curvature(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Curvature from the store's blocks and the ends of their neighbours."""
    return shown(curvature.curvature_dual(_kept(spark, sf_dir), spread=_tasks(spark)).drop("shift"))


@query(f"WITH {_SEQ} SELECT count(*) AS n, sum(length(seq))::BIGINT AS bases FROM seqs")
def seq_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequences(spark, sf_dir).agg(F.count("*").alias("n"), F.sum(F.length("seq")).alias("bases"))


@query(f"""WITH {_TRIPLETS} SELECT m.*, count(t.triplet) AS n FROM matrix m LEFT JOIN trip t USING (triplet) GROUP BY ALL""")
def matrix_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The parameters of all triplets, and how often each stands in the sequences."""
    seen = pieces.triplet_windows(all_pieces(spark, sf_dir), spread=_tasks(spark)).groupBy("triplet").agg(F.count("*").alias("n"))
    return matrices.matrix_table(spark).join(seen, "triplet", "left").fillna(0, "n")


_MARKED = r"""WITH r AS (SELECT doc_id AS seq_id, CASE WHEN doc_id % 5 = 0 THEN '.' ELSE '+' END AS strand, regexp_replace(coalesce(text, ''), '[^A-Za-z\n ]', '', 'g') AS t FROM documents),
raw AS (SELECT seq_id, strand, regexp_replace(CASE WHEN seq_id % 3 = 0 THEN t ELSE translate(t, 'EFIJLOPQXZefijlopqxz', '') END, '[ \n]', '', 'g') AS seq FROM r),
found AS (SELECT *, CASE WHEN strand = '.' THEN 'strand is neither + nor -' WHEN regexp_matches(seq, '[^ACGTUNRYSWKMBDHVacgtunryswkmbdhv]')
  THEN 'no base: ' || regexp_extract(seq, '[^ACGTUNRYSWKMBDHVacgtunryswkmbdhv]') END AS problem FROM raw)"""


def _marked(spark: SparkSession, sf_dir: str) -> checked.Checked:
    """Letters of the documents as they are, of two thirds only such as stand for bases, and a fifth without a strand."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    letters = F.regexp_replace(F.coalesce("text", F.lit("")), "[^A-Za-z\n ]", "")
    seq = F.when(F.col("doc_id") % 3 == 0, letters).otherwise(F.translate(letters, "EFIJLOPQXZefijlopqxz", ""))
    strand = F.when(F.col("doc_id") % 5 == 0, F.lit(".")).otherwise(F.lit("+"))
    return checked.checked(docs.select(F.col("doc_id").alias("seq_id"), F.lit(0).cast("long").alias("offset"), strand.alias("strand"), seq.alias("seq")))


@query(_MARKED + """ SELECT seq_id, problem, CASE WHEN problem LIKE 'no base%' THEN length(regexp_extract(seq, '^[ACGTUNRYSWKMBDHVacgtunryswkmbdhv]*')) + 1 END::INT AS place
FROM found WHERE problem IS NOT NULL""")
def quarantine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records that can't be used, with the reason and the place."""
    return _marked(spark, sf_dir).bad.select("seq_id", "problem", "place")


@query(_MARKED + " SELECT count(*) AS records, count(problem) AS bad, (sum(length(seq)) FILTER (problem IS NULL))::BIGINT AS bases FROM found")
def record_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What was observed while the good records were written."""
    found = _marked(spark, sf_dir)
    found.good.write.parquet(shared.new_folder(spark, "good"))
    counts = found.counts()
    return spark.createDataFrame([(counts["records"], counts["bad"], counts["bases"])], "records long, bad long, bases long")


# ---------------------------------------------------------------- triplets and curvature

@query(f"WITH {_TRIPLETS} SELECT * FROM trip")
def triplet_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.triplet_windows(all_pieces(spark, sf_dir), spread=_tasks(spark))


@query(f"WITH {_TRIPLETS} SELECT seq_id, piece, pos, triplet, roll_active, roll_simple FROM trip JOIN matrix USING (triplet)")
def matrix_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = {f"roll_{k}": matrices.matrix_lookup(F.col("triplet"), matrices.BUILTIN.roll(k)) for k in ("active", "simple")}
    return pieces.triplet_windows(all_pieces(spark, sf_dir), spread=_tasks(spark)).withColumns(found)


@query(f"WITH {_STEPS} SELECT seq_id, piece, pos, roll_simple AS roll, twist, {_R('twist_sum', 'twist_sum')}, {_R('dxs', 'dx')}, {_R('dys', 'dy')} FROM steps")
def triplet_params(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(curvature.triplet_params(all_pieces(spark, sf_dir)), "roll", "twist")


@query(f"WITH {_STEPS} SELECT seq_id, piece, pos, {_R('twist_sum', 'twist_sum')} FROM steps")
def twist_cumsum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(curvature.triplet_params(all_pieces(spark, sf_dir)).select("seq_id", "piece", "pos", "twist_sum"))


@query(f"WITH {_COORDS} SELECT seq_id, piece, pos, {_R('xs', 'x')}, {_R('ys', 'y')} FROM coords")
def coords(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(curvature.coords(all_pieces(spark, sf_dir)))


@query(f"WITH {_MEANS} SELECT seq_id, piece, pos, {_R('xs', 'x_bar')}, {_R('ys', 'y_bar')} FROM means")
def roll_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(curvature.roll_mean(all_pieces(spark, sf_dir)))


@query(f"WITH {_CURVED} SELECT seq_id, piece, pos, {_R('ds', 'dist')} FROM curved")
def euc_dist(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(curvature.euc_dist(all_pieces(spark, sf_dir), spread=_tasks(spark)))


@query(f"WITH {_CURVED} SELECT seq_id, piece, pos, {_R('ds', 'dist')}, {_R('0.33335 * ds', 'curv')} FROM curved")
def curvature_simple(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(curvature.curvature(all_pieces(spark, sf_dir), spread=_tasks(spark)))


@query(f"WITH {_CURVED} SELECT seq_id, piece, pos, {_R('0.33335 * da', 'curv_active')}, {_R('0.33335 * ds', 'curv_simple')} FROM curved")
def curvature_dual(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(curvature.curvature_dual(all_pieces(spark, sf_dir), spread=_tasks(spark)))


@query(f"WITH {_CURVED} SELECT seq_id, piece, pos, {_R('0.33335 * da', 'curv_active')}, {_R('0.33335 * ds', 'curv_simple')} FROM curved")
def sql_curvature(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Curvature by a table function of SQL."""
    functions.register(spark)
    all_pieces(spark, sf_dir).createOrReplaceTempView("bendscape_pieces")
    return shown(spark.sql("SELECT * FROM curvature(TABLE(SELECT seq_id, piece, seq FROM bendscape_pieces) PARTITION BY seq_id)"))


# ---------------------------------------------------------------- symmetry and calls

def _scores(spark: SparkSession, sf_dir: str, *rolls: str) -> DataFrame:
    return symmetry.symmetry(all_pieces(spark, sf_dir), rolls or ("active", "simple"), spread=_tasks(spark))


@query(f"WITH {_BOTH} SELECT seq_id, piece, pos, {_R('wa', 'weight_active')}, {_R('ws', 'weight_simple')} FROM sym WHERE wa > 0 OR ws > 0")
def local_minimum(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dyads at local minima, with their weights."""
    return shown(_scores(spark, sf_dir).select("seq_id", "piece", "pos", "weight_active", "weight_simple").where("weight_active > 0 or weight_simple > 0"))


@query(f"WITH {_BOTH} SELECT seq_id, piece, pos, floor(sa * 10000 + 0.5) / 10000 AS sym_sum_active, floor(ss * 10000 + 0.5) / 10000 AS sym_sum_simple FROM sym")
def symmetry_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sums have nine digits, so half of them in six would be a tie often; four are shown."""
    four = lambda k: (F.floor(F.col(f"sym_sum_{k}") * 10000 + 0.5) / 10000).alias(f"sym_sum_{k}")
    return _scores(spark, sf_dir).select("seq_id", "piece", "pos", four("active"), four("simple"))


@query(f"WITH {_BOTH} SELECT seq_id, piece, pos, {_R('ca', 'score_active')}, {_R('cs', 'score_simple')} FROM sym")
def symmetry_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(_scores(spark, sf_dir).select("seq_id", "piece", "pos", "score_active", "score_simple"))


_FILLED = f"""{_BOTH}, places AS (
  SELECT seq_id, piece, start, unnest(range(1, length(seq) - 121))::INT AS pos FROM pieces WHERE length(seq) >= 224
), filled AS (
  SELECT seq_id, piece, start, pos, coalesce(ca, 0) AS ca, coalesce(cs, 0) AS cs FROM places LEFT JOIN sym USING (seq_id, piece, pos)
)"""
_RUNSUMS = f"""{_R('sum(ca) OVER w', 'runsum_active')}, {_R('sum(cs) OVER w', 'runsum_simple')} FROM filled
WINDOW w AS (PARTITION BY seq_id, piece ORDER BY pos ROWS BETWEEN 73 PRECEDING AND 73 FOLLOWING)"""


@query(f"WITH {_FILLED} SELECT seq_id, piece, pos, {_RUNSUMS}")
def symmetry_runsum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(symmetry.symmetry(all_pieces(spark, sf_dir), runsum=True, spread=_tasks(spark)))


@query(f"""WITH {_BOTH}, t AS (SELECT seq_id, piece, sum(ca) AS a, sum(cs) AS s FROM sym GROUP BY ALL)
SELECT seq_id, piece, length(seq)::INT AS n, {_R('a / (length(seq) - 21)', 'avg_active')}, {_R('s / (length(seq) - 21)', 'avg_simple')}
FROM pieces LEFT JOIN t USING (seq_id, piece) WHERE length(seq) > 42""")
def symmetry_avg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(symmetry.symmetry_averages(all_pieces(spark, sf_dir), spread=_tasks(spark)))


_CALL_COLUMNS = f'seq_id, piece, dyad, start, "end", {_R("score", "score")}, {_R("score_capped", "score_capped")}'


def _called(spark: SparkSession, sf_dir: str, roll: str) -> DataFrame:
    return calls.calls_overlapping(_scores(spark, sf_dir, roll), all_pieces(spark, sf_dir), roll)


@query(f"WITH {_ACTIVE}, {_CALLS('a')} SELECT {_CALL_COLUMNS} FROM calls")
def calls_overlapping_nuc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(_called(spark, sf_dir, "active"))


@query(f"WITH {_SIMPLE}, {_CALLS('s')} SELECT {_CALL_COLUMNS} FROM calls")
def calls_overlapping_dnase(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(_called(spark, sf_dir, "simple"))


@query(f"""WITH {_BOTH} SELECT seq_id, piece, pos AS dyad, pos - 73 AS start, pos + 73 AS "end", {_R('cs', 'score')}, {_R('CASE WHEN ca >= 100 THEN 100.0 ELSE cs END', 'score_capped')}
FROM sym WHERE (cs > 0 AND cs < 100) OR ca >= 100""")
def calls_overlapping_dnase_legacy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With the cap of the simple matrix decided by the active one, as older programs did."""
    return shown(calls.calls_overlapping(_scores(spark, sf_dir), all_pieces(spark, sf_dir), "simple", legacy_bug=True))


@query(f"WITH {_ACTIVE}, {_CALLS('a')} SELECT seq_id, piece, dyad, substr(seq, dyad - 72, 147) AS seq FROM calls JOIN pieces USING (seq_id, piece)")
def nuc_sequence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return calls.with_sequence(_called(spark, sf_dir, "active"), all_pieces(spark, sf_dir)).select("seq_id", "piece", "dyad", "seq")


@query(f"WITH RECURSIVE {_ACTIVE}, {_CALLS('a')}, {_GREEDY} SELECT {_CALL_COLUMNS} FROM kept")
def calls_greedy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(calls.calls_greedy(_called(spark, sf_dir, "active")))


@query(f"WITH RECURSIVE {_SIMPLE}, {_CALLS('s')}, {_GREEDY} SELECT {_CALL_COLUMNS} FROM kept")
def calls_greedy_dnase(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(calls.calls_greedy(_called(spark, sf_dir, "simple")))


@query(f"""WITH RECURSIVE {_ACTIVE}, {_CALLS('a')}, {_GREEDY} SELECT seq_id, piece, dyad, concat_ws(chr(9), seq_id::VARCHAR, 'evidence', 'stat_nucleosome', start::VARCHAR,
  "end"::VARCHAR, printf('%.6f', score), '+', '.', substr(seq, dyad - 72, 147)) AS line FROM (SELECT k.*, p.seq FROM kept k JOIN pieces p USING (seq_id, piece))""")
def gff_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = calls.calls_greedy(_called(spark, sf_dir, "active"))
    return calls.gff_lines(calls.with_sequence(kept, all_pieces(spark, sf_dir)), final=True)


_FREELY = _GREEDY.replace(" WHERE dyad > 177", "")


@query(f"WITH RECURSIVE {_ACTIVE}, {_CALLS('a')}, {_FREELY} SELECT {_CALL_COLUMNS} FROM kept")
def calls_greedy_from_start(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Without the call at 0 that rejects all dyads up to 177."""
    return shown(calls.calls_greedy(_called(spark, sf_dir, "active"), sentinel=False))


_CALLED = f"{_BOTH}, a AS (SELECT seq_id, piece, pos AS dyad FROM sym WHERE ca > 0), s AS (SELECT seq_id, piece, pos AS dyad FROM sym WHERE cs > 0)"


def _dyads(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Calls of both matrices as intervals of one place. Of the scores, only those of calls are kept, and only whether they are over 0."""
    over = [F.when(F.col(f"score_{k}") > 0, 1.0).otherwise(0.0).alias(f"score_{k}") for k in ("active", "simple")]
    scores = shared.written(_scores(spark, sf_dir).where("score_active > 0 or score_simple > 0").select("seq_id", "piece", "pos", *over), "dyads")
    one = lambda k: calls.calls_overlapping(scores, scores, k).select("seq_id", "piece", "dyad", F.col("dyad").alias("start"), F.col("dyad").alias("end"))
    return one("active"), one("simple")


@query(f"WITH {_CALLED} SELECT seq_id, piece, a.dyad, s.dyad AS other, abs(a.dyad - s.dyad)::INT AS distance FROM a JOIN s USING (seq_id, piece) WHERE abs(a.dyad - s.dyad) <= 177")
def calls_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls by one matrix and those by the other that would exclude each other."""
    found = intervals.pairs(*_dyads(spark, sf_dir), within=177)
    return found.select("seq_id", "piece", F.col("left.dyad").alias("dyad"), F.col("right.dyad").alias("other"), F.col("distance").cast("int").alias("distance"))


@query(f"WITH {_CALLED} SELECT a.seq_id, a.piece, a.dyad, count(s.dyad) AS n_partners FROM a LEFT JOIN s ON a.seq_id = s.seq_id AND a.piece = s.piece AND abs(a.dyad - s.dyad) <= 177 GROUP BY ALL")
def calls_partners(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many calls by the other matrix each call would exclude."""
    return intervals.partners(*_dyads(spark, sf_dir), within=177).select("seq_id", "piece", "dyad", "n_partners")


@query(f"WITH {_CALLED} SELECT seq_id, piece, dyad FROM a WHERE NOT EXISTS (SELECT 1 FROM s WHERE a.seq_id = s.seq_id AND a.piece = s.piece AND abs(a.dyad - s.dyad) <= 73)")
def calls_apart(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls by one matrix with no call by the other within half a core."""
    return intervals.apart(*_dyads(spark, sf_dir), within=73).select("seq_id", "piece", "dyad")


# ---------------------------------------------------------------- sinks, read back

_POSITION = "(pos + start - 1 + seq_id)::BIGINT AS position"


def _analysed(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, analysis.Analysis]:
    """Sequences whose offset is their number, and their analysis."""
    rows = sequences(spark, sf_dir).select("seq_id", F.col("seq_id").alias("offset"), F.lit("+").alias("strand"), "seq")
    return rows, analysis.analyse(rows)


def _track(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return shown(spark.read.option("sep", "\t").option("quote", "").schema(schema).csv(path))


@query(f"WITH {_CURVED} SELECT seq_id, {_POSITION}, substr(seq, pos + 1, 1) AS base, {_R('0.33335 * da', 'curv_active')}, {_R('0.33335 * ds', 'curv_simple')} FROM curved JOIN pieces USING (seq_id, piece)")
def sink_curvature(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared.new_folder(spark, "curvature")
    sinks.write_curvature(_analysed(spark, sf_dir)[1], path, compression="gzip", form=shown)
    return _track(spark, path, "seq_id long, position long, base string, curv_active double, curv_simple double")


@query(f"WITH {_BOTH} SELECT seq_id, {_POSITION}, {_R('ca', 'score_active')}, {_R('cs', 'score_simple')} FROM sym JOIN pieces USING (seq_id, piece)")
def sink_symmetry(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared.new_folder(spark, "symmetry")
    sinks.write_symmetry(_analysed(spark, sf_dir)[1], path, compression="gzip")
    return _track(spark, path, "seq_id long, position long, score_active double, score_simple double")


@query(f"""WITH {_BOTH}, t AS (SELECT seq_id, piece, sum(ca) AS a, sum(cs) AS s FROM sym GROUP BY ALL)
SELECT concat_ws(':', seq_id::VARCHAR, seq_id::VARCHAR, '+', (length(seq) - 21)::VARCHAR) AS name, {_R('a / (length(seq) - 21)', 'avg_active')}, {_R('s / (length(seq) - 21)', 'avg_simple')}
FROM pieces LEFT JOIN t USING (seq_id, piece) WHERE length(seq) > 42""")
def sink_averages(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared.new_folder(spark, "averages")
    rows, found = _analysed(spark, sf_dir)
    sinks.write_averages(found, rows, path)
    return _track(spark, path, "name string, avg_active double, avg_simple double")


@query(f"WITH {_FILLED} SELECT seq_id, {_POSITION}, {_RUNSUMS}")
def sink_runsums(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared.new_folder(spark, "runsums")
    sinks.write_runsums(_analysed(spark, sf_dir)[1], path, compression="gzip")
    return _track(spark, path, "seq_id long, position long, runsum_active double, runsum_simple double")


@query(f"WITH {_CURVED} SELECT seq_id, {_POSITION}, (pos + start + seq_id)::BIGINT AS \"end\", {_R('0.33335 * ds', 'curv_simple')} FROM curved JOIN pieces USING (seq_id, piece)")
def sink_bedgraph(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared.new_folder(spark, "bedgraph")
    sinks.write_bedgraph(_analysed(spark, sf_dir)[1], path, compression="gzip", form=shown)
    return _track(spark, path, "seq_id long, position long, end long, curv_simple double")


@query(f"""WITH {_CURVED} SELECT seq_id::VARCHAR AS chrom, {_POSITION}, (pos + start + seq_id)::BIGINT AS "end", round((0.33335 * ds)::FLOAT::DOUBLE, 4) + 0.0 AS value
FROM curved JOIN pieces USING (seq_id, piece)""")
def sink_bigwig(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values have single precision in the file."""
    path = shared.new_folder(spark, "track") + ".bw"
    rows, found = _analysed(spark, sf_dir)
    sinks.write_bigwig(found, rows, path)
    back = bigwig.read_bigwig(spark, path)
    return back.select("chrom", F.col("start").alias("position"), "end", (F.round(F.col("value").cast("double"), 4) + F.lit(0.0)).alias("value"))


def _gff(roll: str, final: bool):
    """The query of a GFF file: its lines, read back."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        path = shared.new_folder(spark, "gff")
        sinks.write_gff(_analysed(spark, sf_dir)[1], path, roll, final)
        return spark.read.text(path).select(F.col("value").alias("line"))

    return run


for _roll, _state, _sym, _feature in (("active", "nuc", _ACTIVE, "stat_nucleosome"), ("simple", "dnase", _SIMPLE, "act_nucleosome")):
    for _final, _name in ((False, "init"), (True, "fin")):
        _key = f"sink_gff_{_name}_{_state}"
        QUERIES[_key] = _gff(_roll, _final)
        ORACLES[_key] = f"""WITH {"RECURSIVE " if _final else ""}{_sym}, {_CALLS(_roll[0])}{", " + _GREEDY if _final else ""} SELECT concat_ws(chr(9), seq_id::VARCHAR, 'evidence', '{_feature}',
  (k.start + p.start - 1 + seq_id)::VARCHAR, (k."end" + p.start - 1 + seq_id)::VARCHAR, printf('%.6f', {"score" if _final else "score_capped"}), '+', '.', substr(seq, dyad - 72, 147)) AS line
FROM {"kept" if _final else "calls"} k JOIN pieces p USING (seq_id, piece)"""
