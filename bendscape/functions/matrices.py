"""Roll, twist and tilt of the 64 triplets."""

from __future__ import annotations

import json
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BASES = "ATGC"

# Published structural parameters of DNA triplets. Rows are the first two bases, in the order A, T, G, C;
# the four numbers of a row are for a third base A, T, G, C.
TWIST = 0.598647428
TILT = 0.0
ROLL_ACTIVE = """
AA 0.0633 0.35 4.6709 2.64115
AT 6.2734 0.35 7.7171 4.44325
AG 4.8884 3.9232 5.0523 6.8829
AC 5.4903 3.9232 5.3055 5.3055
TA 4.6709 6.2734 5.00295 5.0673
TT 4.6709 0.0633 4.7618 4.0633
TG 7.7 5.4903 3.05865 6.75525
TC 7.7 4.8884 7.07195 4.9907
GA 4.0633 4.44325 5.9806 5.51645
GT 5.0673 2.64115 6.62555 5.51645
GG 4.9907 5.3055 5.89135 9.0823
GC 6.75525 6.8829 5.89135 9.0823
CA 4.7618 7.7171 6.8996 6.62555
CT 5.00295 4.6709 6.8996 5.9806
CG 7.07195 5.3055 3.869 5.9
CC 3.05865 5.0523 3.869 5.827
"""
ROLL_SIMPLE = """
AA 0.1 0 4.2 1.6
AT 9.7 0 8.7 3.6
AG 6.5 2 4.7 6.3
AC 5.8 2 5.2 5.2
TA 7.3 9.7 7.8 6.4
TT 7.3 0.1 6.2 5.1
TG 10 5.8 0.7 7.5
TC 10 6.5 5.8 6.2
GA 5.1 3.6 6.6 5.6
GT 6.4 1.6 6.8 5.6
GG 6.2 5.2 5.7 8.2
GC 7.5 6.3 4.3 8.2
CA 6.2 8.7 9.6 6.8
CT 7.8 4.2 9.6 6.6
CG 5.8 5.2 3 4.3
CC 0.7 4.7 3 5.7
"""


def _values(table: str) -> np.ndarray:
    return np.array([[float(x) for x in line.split()[1:]] for line in table.strip().splitlines()]).ravel()


class MatrixLookupError(ValueError):
    """A string that is no triplet of the bases A, C, G and T."""

    def __init__(self, details: str):
        super().__init__(f"Error: {details}")
        self.details = details


@dataclass(frozen=True, eq=False)
class Matrices:
    """64 values of each parameter, in the order of ``16 * first + 4 * second + third`` base."""

    roll_active: np.ndarray
    roll_simple: np.ndarray
    twist: np.ndarray
    tilt: np.ndarray

    @property
    def constant_twist(self) -> float | None:
        """The twist of all triplets, if it is the same."""
        return float(self.twist[0]) if (self.twist == self.twist[0]).all() else None

    def roll(self, kind: str) -> np.ndarray:
        """``active`` or ``simple`` roll."""
        if kind not in ("active", "simple"):
            raise ValueError(f"roll is active or simple, not {kind!r}")
        return getattr(self, f"roll_{kind}")


BUILTIN = Matrices(_values(ROLL_ACTIVE), _values(ROLL_SIMPLE), np.full(64, TWIST), np.full(64, TILT))
TRIPLETS = [a + b + c for a in BASES for b in BASES for c in BASES]


def lookup(triplet: str, values: np.ndarray) -> float:
    """The value of one triplet."""
    if len(triplet) != 3 or any(b not in BASES for b in triplet):
        raise MatrixLookupError("triplet must be of length 3")
    return float(values[TRIPLETS.index(triplet)])


def read(path: str) -> Matrices:
    """Matrices from a YAML or JSON file: of each parameter, a number for all triplets or a map from triplets to numbers.

    What the file leaves out is built in.
    """
    with open(path) as f:
        text = f.read()
    try:
        found = json.loads(text)
    except json.JSONDecodeError:
        import yaml

        found = yaml.safe_load(text)
    if not isinstance(found, dict) or set(found) - {"roll_active", "roll_simple", "twist", "tilt"}:
        raise ValueError("a matrices file has the keys roll_active, roll_simple, twist and tilt")
    out = {}
    for name in ("roll_active", "roll_simple", "twist", "tilt"):
        values = getattr(BUILTIN, name).copy()
        given = found.get(name, {})
        if isinstance(given, (int, float)):
            values[:] = given
        else:
            for triplet, value in given.items():
                lookup(triplet, values)
                values[TRIPLETS.index(triplet)] = float(value)
        out[name] = values
    return Matrices(**out)


def matrix_table(spark: SparkSession, matrices: Matrices = BUILTIN) -> DataFrame:
    """(triplet, roll_active, roll_simple, twist, tilt), 64 rows."""
    rows = [(t, *(float(v[i]) for v in (matrices.roll_active, matrices.roll_simple, matrices.twist, matrices.tilt))) for i, t in enumerate(TRIPLETS)]
    return spark.createDataFrame(rows, "triplet string, roll_active double, roll_simple double, twist double, tilt double")


def matrix_lookup(triplet: Column, values: np.ndarray, strict: bool = False) -> Column:
    """The value of a triplet column: null for what is no triplet, or an error if ``strict``."""
    # Bits 1 and 2 of the letters A, C, T and G count from 0 to 3; what is no triplet is not the one found at its place.
    order = [x + y + z for x in "ACTG" for y in "ACTG" for z in "ACTG"]
    digit = lambda k: F.shiftright(F.ascii(F.substring(triplet, k, 1)), 1).bitwiseAND(F.lit(3))
    place = 16 * digit(1) + 4 * digit(2) + digit(3) + 1
    named = F.element_at(F.array(*[F.lit(t) for t in order]), place) == triplet
    found = F.when(named, F.element_at(F.array(*[F.lit(float(values[TRIPLETS.index(t)])) for t in order]), place))
    return F.coalesce(found, F.raise_error(F.lit("Error: triplet must be of length 3")).cast("double")) if strict else found
