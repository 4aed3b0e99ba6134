"""Sequence normalisation, identity and quality control."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
CANONICAL = "ACDEFGHIKLMNPQRSTVWY"
EXTENDED = CANONICAL + "XUZ"
MIN_LENGTH, MAX_LENGTH = 5, 70
MODEL_MIN_LENGTH, MODEL_MAX_LENGTH = 2, 1024
ID_PREFIX = "sha256_"


def normalize_sequence(value: Column) -> Column:
    """Without any Unicode white space, upper-cased; nothing left: null."""
    return F.nullif(F.upper(F.regexp_replace(value, r"(?U)\s+", "")), F.lit(""))


def sequence_id(sequence: Column) -> Column:
    return F.concat(F.lit(ID_PREFIX), F.sha2(sequence, 256))


def is_canonical(sequence: Column, extended: bool = False) -> Column:
    """All letters in the alphabet; false for null and empty."""
    return F.coalesce(sequence.rlike(rf"\A[{EXTENDED if extended else CANONICAL}]+\z"), F.lit(False))


def length_ok(sequence: Column, low: int = MIN_LENGTH, high: int = MAX_LENGTH) -> Column:
    return F.coalesce(F.char_length(sequence).between(low, high), F.lit(False))


def qc_reason(sequence: Column, low: int = MIN_LENGTH, high: int = MAX_LENGTH) -> Column:
    """The first failing check of a normalised sequence, or "pass"."""
    return F.when(sequence.isNull(), "missing").when(~length_ok(sequence, low, high), "length").when(~is_canonical(sequence), "noncanonical").otherwise("pass")


def is_sequence_id(value: Column) -> Column:
    return F.coalesce(value.rlike(r"\Asha256_[0-9a-f]{64}\z"), F.lit(False))


def residue_counts(sequence: Column, residues: str = CANONICAL) -> list[Column]:
    """How often each residue occurs."""
    return [(F.char_length(sequence) - F.char_length(F.replace(sequence, F.lit(r), F.lit("")))).cast("long").alias(f"n_{r}") for r in residues]


def one_hot(sequence: Column, width: int, residues: str = CANONICAL) -> Column:
    """width * len(residues) zeros and ones; positions past the end are all zero, and so are other letters."""
    place = F.transform(F.sequence(F.lit(1), F.lit(width)), lambda i: F.instr(F.lit(residues), F.substring(sequence, i, F.lit(1))) * (i <= F.char_length(sequence)).cast("int"))
    return F.flatten(F.transform(place, lambda p: F.transform(F.sequence(F.lit(1), F.lit(len(residues))), lambda k: (p == k).cast("int"))))


def kmers(sequence: Column, k: int) -> Column:
    return F.when(F.char_length(sequence) >= k, F.transform(F.sequence(F.lit(1), F.char_length(sequence) - (k - 1)), lambda i: F.substring(sequence, i, F.lit(k)))).otherwise(F.array().cast("array<string>"))


def ordinal(sequence: Column, residues: str = CANONICAL) -> Column:
    """Places of the residues in the alphabet from 1; other letters 0."""
    return F.transform(F.filter(F.split(sequence, ""), lambda c: c != ""), lambda c: F.instr(F.lit(residues), c))


# Published scales, fixed values: side-chain pKa (EMBOSS) and Radzicka-Wolfenden transfer energies in kcal/mol.
PKA_POSITIVE = {"K": 10.8, "R": 12.5, "H": 6.5}
PKA_NEGATIVE = {"D": 3.9, "E": 4.1, "C": 8.5, "Y": 10.1}
PKA_N_TERM, PKA_C_TERM = 8.6, 3.6
BOMAN = {"L": 4.92, "I": 4.92, "V": 4.04, "F": 2.98, "M": 2.35, "W": 2.33, "A": 1.81, "C": 1.28, "G": 0.94, "Y": -0.14, "T": -2.57, "S": -3.40, "H": -4.66, "Q": -5.54, "K": -5.55, "N": -6.64, "E": -6.81, "D": -8.72, "R": -14.92, "P": 0.0}


def _count(sequence: Column, r: str) -> Column:
    return F.char_length(sequence) - F.char_length(F.replace(sequence, F.lit(r), F.lit("")))


def net_charge(sequence: Column, ph: float = 7.0) -> Column:
    """Henderson-Hasselbalch sum over termini and side chains."""
    up = lambda pka: 1 / (1 + 10 ** (ph - pka))
    down = lambda pka: -1 / (1 + 10 ** (pka - ph))
    total = F.lit(up(PKA_N_TERM) + down(PKA_C_TERM))
    for table, f in ((PKA_POSITIVE, up), (PKA_NEGATIVE, down)):
        for r, pka in table.items():
            total = total + _count(sequence, r) * F.lit(f(pka))
    return total


def boman_index(sequence: Column) -> Column:
    """Mean of the negated transfer energies."""
    total = F.lit(0.0)
    for r, v in BOMAN.items():
        total = total - _count(sequence, r) * F.lit(v)
    return F.try_divide(total, F.char_length(sequence))


def charged_fraction(sequence: Column) -> Column:
    """Share of D, E, K and R."""
    return F.try_divide(sum((_count(sequence, r) for r in "DEKR"), F.lit(0)).cast("double"), F.char_length(sequence))


def entropy(sequence: Column) -> Column:
    """Shannon entropy of the residues, in bits."""
    total = F.lit(0.0)
    n = F.char_length(sequence)
    for r in CANONICAL:
        p = F.try_divide(_count(sequence, r).cast("double"), n)
        total = total - F.when(p > 0, p * F.log2(p)).otherwise(0.0)
    return total
