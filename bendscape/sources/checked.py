"""Records that can be used and those that can't, with the reason and the place; and counts of both as they go by.

``quarantine`` keeps bad records aside, ``strict`` fails at the first one and names its sequence and place. Counts are
observed while the records are read for something else, so they cost no pass of their own.
"""

from __future__ import annotations

import time
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

#: The letters that stand for a base, or for one of several, in either case.
LETTERS = "ACGTUNRYSWKMBDHVacgtunryswkmbdhv"
MODES = ("quarantine", "strict")


def problem(sequences: DataFrame) -> tuple[Column, Column]:
    """What is wrong with a record, or null; and the place in its sequence, from 1 and without white space, of a sign that is no base."""
    plain = F.regexp_replace("seq", r"\s", "")
    rest = F.regexp_replace(plain, f"^[{LETTERS}]+", "")
    place = F.when(rest != "", F.length(plain) - F.length(rest) + 1)
    known = [F.when(F.col("problem").isNotNull(), F.col("problem"))] if "problem" in sequences.columns else []
    name = F.col("seq_id").cast("string")
    found = F.coalesce(
        *known,
        F.when(name.isNull() | (name == ""), F.lit("no name")),
        F.when(F.col("seq").isNull(), F.lit("no sequence")),
        F.when(F.col("offset").isNull() | (F.col("offset") < 0), F.lit("no offset")),
        F.when(~F.coalesce(F.col("strand").isin("+", "-"), F.lit(False)), F.lit("strand is neither + nor -")),
        F.when(rest != "", F.concat(F.lit("no base: "), F.substring(rest, 1, 1))),
    )
    return found, F.when(found.startswith("no base"), place)


@dataclass
class Checked:
    """``rows`` are all records with ``problem`` and ``place``; ``good`` and ``bad`` those without and with one.

    After an action on any of these, ``counts()`` has what went by (an action that reads all rows: not ``show`` or a limit).
    """

    rows: DataFrame
    columns: list[str]
    observation: Observation = field(repr=False)

    @property
    def good(self) -> DataFrame:
        return self.rows.where("problem is null").select(*self.columns)

    @property
    def bad(self) -> DataFrame:
        return self.rows.where("problem is not null")

    def counts(self) -> dict[str, int]:
        """records, bad and bases (of good records); waits for the first action."""
        return {k: v or 0 for k, v in self.observation.get.items()}


def checked(sequences: DataFrame, mode: str = "quarantine") -> Checked:
    """Checks (seq_id, offset, strand, seq, ...); what a reader says in ``problem`` counts too."""
    if mode not in MODES:
        raise ValueError(f"mode is one of {', '.join(MODES)}, not {mode!r}")
    found, place = problem(sequences)
    columns = [c for c in sequences.columns if c != "problem"]
    rows = sequences.select("*", found.alias("_found"), place.alias("place")).drop("problem").withColumnRenamed("_found", "problem")
    if mode == "strict":
        where = F.coalesce(F.concat(F.lit(", place "), F.col("place").cast("string")), F.lit(""))
        said = F.concat(F.lit("sequence "), F.coalesce(F.col("seq_id").cast("string"), F.lit("without a name")), where, F.lit(": "), F.col("problem"))
        rows = rows.withColumn("problem", F.when(F.col("problem").isNotNull(), F.raise_error(said).cast("string")))
    seen = Observation()
    fine = F.col("problem").isNull()
    size = F.length(F.regexp_replace("seq", r"\s", "")).cast("long")
    rows = rows.observe(seen, F.count(F.lit(1)).alias("records"), F.count(F.when(~fine, 1)).alias("bad"), F.sum(F.when(fine, size)).alias("bases"))
    return Checked(rows, columns, seen)


@dataclass
class Runtime:
    """Whole seconds of a run: ``with Runtime() as t: ...``, then ``t.seconds``."""

    seconds: int | None = None

    def __enter__(self) -> Runtime:
        self._began = time.monotonic()
        return self

    def __exit__(self, *_) -> None:
        self.seconds = int(time.monotonic() - self._began)
