"""Command line: a FASTA file in, a folder of tracks and calls out."""

from __future__ import annotations

import argparse
import sys

from bendscape.params import Params

VERSION = "0.1.0"


def _count(text: str) -> int:
    if not text.isdigit() or not 1 <= int(text) <= 65535:
        raise argparse.ArgumentTypeError(f"invalid value '{text}': an integer from 1 to 65535 is expected")
    return int(text)


def _scale(text: str) -> float:
    try:
        value = float(text)
    except ValueError:
        value = -1.0
    if not 0 <= value <= 1:
        raise argparse.ArgumentTypeError(f"invalid value '{text}': a number from 0 to 1 is expected")
    return value


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser("bendscape", description="DNA curvature, its symmetry, and nucleosome calls")
    p.add_argument("input", help="FASTA file or folder")
    p.add_argument("output", help="folder for the results")
    p.add_argument("-v", "--verbose", action="store_true", help="show Spark's plans")
    p.add_argument("-m", "--matrices", metavar="PATH", help="YAML or JSON file with parameter matrices")
    p.add_argument("-V", "--version", action="version", version=f"bendscape {VERSION}")
    d = Params()
    for flag, default in (("curve-step", d.curve_step), ("curve-step-one", d.curve_step_one), ("curve-step-two", d.curve_step_two), ("symmetry-win", d.symmetry_win), ("symmetry-step", d.symmetry_step), ("min-linker-size", d.min_linker_size)):
        p.add_argument(f"--{flag}", type=_count, default=default, metavar="N")
    p.add_argument("--curve-scale", type=_scale, default=d.curve_scale, metavar="X")
    p.add_argument("--dialect", choices=("fasta", "legacy"), default="fasta", help="legacy: offset and strand in headers, records end with #")
    p.add_argument("--n-policy", choices=("split", "to_a"), default="split")
    p.add_argument("--blocks", action="store_true", help="read by ranges of bytes and keep sequences in blocks, for such as don't fit into memory; splits them at all that is no base")
    p.add_argument("--bigwig", metavar="PATH", help="write curvature as a bigWig file too")
    p.add_argument("--strict", action="store_true", help="stop at a record that can't be used")
    p.add_argument("--bad", metavar="PATH", help="folder for the records that can't be used, as JSON")
    p.add_argument("--spread", type=_count, help="deal chunks of long sequences over that many partitions")
    return p


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    from pyspark.sql import SparkSession

    from bendscape.functions import matrices
    from bendscape.plans.analysis import analyse, analyse_blocks
    from bendscape.sources import checked, fasta, fasta_ranges, sinks, store
    from bendscape.sources.shared import new_folder

    params = Params(**{k: getattr(args, k) for k in ("curve_step", "curve_scale", "curve_step_one", "curve_step_two", "symmetry_win", "symmetry_step", "min_linker_size")})
    spark = SparkSession.builder.appName("bendscape").getOrCreate()
    known = matrices.read(args.matrices) if args.matrices else matrices.BUILTIN
    with checked.Runtime() as runtime:
        if args.blocks:
            if args.dialect == "legacy" or args.n_policy == "to_a" or args.strict or args.bad:
                raise SystemExit("--blocks goes with the usual dialect, splitting and quarantine only")
            folder = new_folder(spark, "blocks")
            store.pack(fasta_ranges.read_parts(spark, args.input)).blocks.write.parquet(folder)
            kept = store.Store(spark.read.parquet(folder))
            result, rows = analyse_blocks(kept, params, known, spread=args.spread), kept.sequences()
        else:
            read = fasta.read_fasta_legacy(spark, args.input) if args.dialect == "legacy" else fasta.read_fasta(spark, args.input)
            found = checked.checked(read, "strict" if args.strict else "quarantine")
            if args.bad:
                found.bad.write.json(args.bad)
            rows = found.good
            result = analyse(rows, params, known, args.n_policy, spread=args.spread)
        if args.verbose:
            result.curvature.explain("formatted")
        sinks.write_all(result, rows, args.output, params)
        if args.bigwig:
            sinks.write_bigwig(result, rows, args.bigwig)
    counts = "" if args.blocks else "{records} records, {bad} of them bad, {bases} bases, ".format(**found.counts())
    print(f"{counts}{runtime.seconds} seconds", file=sys.stderr)
    return 0


if __name__ == "__main__":
    sys.exit(main())
