"""Writers of tracks (tab-separated values, bedGraph, bigWig) and calls (GFF).

bigWig is one file. All others write a folder of part files with Spark's writers; the parts, in the order of their names, are the file.
The tracks, some 50 bytes for a base, are compressed with ``compression="gzip"``; such parts make one file too. Values have
all digits of a double, unless ``form`` makes other rows of those that would be written, such as with fewer digits.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bendscape.operators import calls
from bendscape.params import DEFAULT, Params
from bendscape.plans.analysis import Analysis
from bendscape.sources import bigwig


Form = Callable[[DataFrame], DataFrame]


def _tsv(rows: DataFrame, path: str, *columns: Column | str, compression: str = "none", form: Form | None = None) -> None:
    rows = rows.select(*columns)
    out = (form(rows) if form else rows).write.option("sep", "\t").option("quote", "").option("escapeQuotes", "false").option("emptyValue", "")
    out.csv(path, compression=compression)


def write_curvature(found: Analysis, path: str, compression: str = "none", form: Form | None = None) -> None:
    """Title, position, base, curvature by both matrices."""
    _tsv(found.published(found.ordered().curvature), path, "seq_id", "position", "base", "curv_active", "curv_simple", compression=compression, form=form)


def write_symmetry(found: Analysis, path: str, compression: str = "none") -> None:
    """Title, position, score by both matrices."""
    _tsv(found.published(found.ordered().scores), path, "seq_id", "position", "score_active", "score_simple", compression=compression)


def write_averages(found: Analysis, sequences: DataFrame, path: str, params: Params = DEFAULT) -> None:
    """``title:offset:strand:bases`` and the average score by both matrices; bases count up to the last with a curvature."""
    rows = found.averages.join(sequences.select("seq_id", "offset", "strand"), "seq_id")
    name = F.concat_ws(":", F.col("seq_id").cast("string"), F.col("offset").cast("string"), "strand", (F.col("n") - (params.reach + 1)).cast("string"))
    _tsv(rows.orderBy("seq_id", "piece"), path, name, "avg_active", "avg_simple")


def write_runsums(found: Analysis, path: str, compression: str = "none") -> None:
    """Title, position, sums of scores over a core by both matrices."""
    _tsv(found.published(found.ordered().runsums), path, "seq_id", "position", "runsum_active", "runsum_simple", compression=compression)


def write_gff(found: Analysis, path: str, roll: str = "active", final: bool = False, one_based: bool = False) -> None:
    """Calls by one matrix: all of them, or (``final``) those that keep their distance.

    All of them are made in the file's order with the bases of their cores, unless scores are kept; nothing is sorted then.
    """
    if not final and not found.kept:
        lines = calls.gff_lines(found.ordered().cores(roll), roll, final, F.col("shift"), one_based)
        lines.select("line").write.text(path)
        return
    rows = calls.with_sequence((found.final if final else found.initial)[roll], found.pieces)
    lines = calls.gff_lines(rows, roll, final, F.col("shift"), one_based)
    lines.orderBy("seq_id", "piece", "dyad").select("line").write.text(path)


def write_bedgraph(found: Analysis, path: str, value: str = "curv_simple", track: DataFrame | None = None, compression: str = "none", form: Form | None = None) -> None:
    """Title, start, end (from 0, half open) and value of each base of a track, by default curvature.

    A track of one's own is written in the order that it has.
    """
    rows = found.published(found.ordered().curvature if track is None else track)
    _tsv(rows, path, "seq_id", "position", (F.col("position") + 1).alias("end"), value, compression=compression, form=form)


def sizes(sequences: DataFrame) -> DataFrame:
    """(seq_id, size): where each sequence ends, with its offset; ``sequences`` have their bases or their ``size``."""
    if "size" in sequences.columns:
        return sequences.select("seq_id", "size")
    return sequences.select("seq_id", (F.length(F.regexp_replace("seq", r"\s", "")) + F.col("offset")).cast("long").alias("size"))


def write_sizes(sequences: DataFrame, path: str) -> None:
    """Title and size of each sequence, as converters of bedGraph files need them."""
    _tsv(sizes(sequences).orderBy("seq_id"), path, "seq_id", "size")


def write_bigwig(found: Analysis, sequences: DataFrame, path: str, value: str = "curv_simple", track: DataFrame | None = None) -> None:
    """A track, by default curvature, as one bigWig file.

    Curvature of pieces is made in the file's order from chunks of bases that are dealt in it, so only bases are shuffled. A
    track of one's own, or of a store, is sorted row by row.
    """
    ends = sizes(sequences).withColumnRenamed("seq_id", "chrom")
    if track is not None or not isinstance(found.pieces, DataFrame):
        rows = found.published(found.curvature if track is None else track)
        rows = rows.select(F.col("seq_id").alias("chrom"), F.col("position").alias("start"), (F.col("position") + 1).alias("end"), F.col(value).alias("value"))
        bigwig.write_bigwig(rows, ends, path)
        return
    names = bigwig.names(ends)
    last = F.col("shift") + F.length("seq")
    wrong = F.raise_error(F.concat(F.lit("an interval lies outside of sequence "), F.col("name"))).cast("long")
    # The first and the last place with a curvature.
    reach = found.params.reach + 1
    fits = (F.length("seq") <= 2 * reach) | ((last - reach <= F.col("size")) & (last - reach < (1 << 32)) & (F.col("shift") + reach >= 0))
    met = found.pieces.join(names.withColumnRenamed("chrom", "seq_id"), "seq_id")
    pieces = met.select(F.col("id").alias("seq_id"), "piece", "seq", F.when(fits, F.col("shift")).otherwise(wrong).alias("shift"))
    moved = Analysis(pieces, found.params, found.matrices, found.legacy_bug, found._dealt["spread"], True)
    rows = moved.published(moved.curvature)
    bigwig.write_sorted(rows.select(F.col("seq_id").alias("chrom"), F.col("position").alias("start"), (F.col("position") + 1).alias("end"), F.col(value).cast("float").alias("value")), names, path)


def write_all(found: Analysis, sequences: DataFrame, folder: str, params: Params = DEFAULT) -> None:
    """All eight outputs, under their usual names, and the sizes of sequences. Calls share scores that are kept first."""
    found = found.stored()
    write_curvature(found, f"{folder}/out_curv.dat")
    write_symmetry(found, f"{folder}/out_symmetry.dat")
    write_averages(found, sequences, f"{folder}/out_symmetry_aggr.dat", params)
    write_runsums(found, f"{folder}/out_symmetry_avr.dat")
    for final, name in ((False, "init"), (True, "fin")):
        for roll, state in (("active", "nuc"), ("simple", "dnase")):
            write_gff(found, f"{folder}/out_{name}_calls_{state}.gff", roll, final)
    write_sizes(sequences, f"{folder}/out_sizes.dat")
