"""Column functions over base strings."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Bytes of text that are mapped at once.
STEP = 1 << 22


def _table(**to: str) -> np.ndarray:
    """What each byte of UTF-8 becomes: upper-case ASCII letters as given, lower-case ones like these, all else nothing (0)."""
    out = np.zeros(256, dtype=np.uint8)
    for letters, base in ((v, k) for k, v in to.items()):
        for x in letters:
            out[[ord(x), ord(x.lower())]] = ord(base)
    return out


#: Letters of prose as bases, ends of lines as unknown ones.
_PROSE = _table(A="AFKOSX", C="BCIMQVZ", G="DGJNRW", T="EHLPTUY")
_PROSE[ord("\n")] = ord("N")
#: Bases as they are, white space as nothing, each other character (the first byte of it) as an unknown base.
_BASES = _table(A="A", C="C", G="G", T="T")
_BASES[:128][_BASES[:128] == 0] = _BASES[192:] = ord("N")
_BASES[[9, 10, 11, 12, 13, 32]] = 0


def mapped(text: pa.Array, table: np.ndarray) -> pa.Array:
    """Strings with each byte mapped by ``table``, and without those that it makes 0."""
    whole = text.cast(pa.large_string())
    _, offsets, data = whole.buffers()
    at = np.frombuffer(offsets, dtype=np.int64)[whole.offset : whole.offset + len(whole) + 1]
    parts, ends = [], np.zeros(len(at), dtype=np.int64)
    base = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    done = i = 0
    while i < len(text):
        j = max(i + 1, int(np.searchsorted(at, at[i] + STEP, side="right")) - 1)
        out = table[base[at[i] : at[j]]]
        kept = out != 0
        ends[i + 1 : j + 1] = done + np.append(0, np.cumsum(kept))[at[i + 1 : j + 1] - at[i]]
        parts.append(out[kept])
        done, i = int(ends[j]), j
    found = pa.LargeStringArray.from_buffers(len(text), pa.py_buffer(ends), pa.py_buffer(np.concatenate(parts) if parts else base[:0]))
    return pc.if_else(text.is_valid(), found, pa.scalar(None, pa.large_string())).cast(pa.string())


@F.arrow_udf(StringType())
def _from_text(text: pa.Array) -> pa.Array:
    return mapped(text.fill_null(""), _PROSE)


@F.arrow_udf(StringType())
def _split_ready(seq: pa.Array) -> pa.Array:
    return mapped(seq, _BASES)


def normalize_seq(seq: Column) -> Column:
    """Without white space, in upper case, every other sign than A, C, G and T as A. Only ASCII letters change case."""
    plain = F.regexp_replace(seq, r"\s", "")
    upper = F.translate(plain, "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ")
    return F.regexp_replace(upper, "[^ACGT]", "A")


def reverse_complement(seq: Column) -> Column:
    return F.reverse(F.translate(seq, "AGCT", "TCGA"))


def on_strand(seq: Column, strand: Column) -> Column:
    """The sequence as its strand reads: the reverse complement for ``-``."""
    return F.when(strand == "-", reverse_complement(seq)).otherwise(seq)


def encode_bases(seq: Column) -> Column:
    """A, T, G, C as 0, 1, 2, 3."""
    return F.translate(seq, "ATGC", "0123")


def from_text(text: Column) -> Column:
    """Bases made of prose: letters that are no base stand for one, and the end of a line is an unknown base."""
    return _from_text(text)


def known_or_n(seq: Column) -> Column:
    """Without white space, in upper case, every other sign than A, C, G and T as N. Only ASCII letters change case."""
    return _split_ready(seq)
