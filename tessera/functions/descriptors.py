"""Encodings of sequences by residue scales, and physicochemical descriptors, as column expressions."""

from __future__ import annotations

import math
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .sequences import BOMAN, CANONICAL, PKA_C_TERM, PKA_N_TERM, PKA_NEGATIVE, PKA_POSITIVE

# Published scales, fixed values, by their names in the AAindex; residues as in RESIDUES.
RESIDUES = "ARNDCQEGHILKMFPSTWYV"
SCALES = {
    # Andersen and others 1992, alpha-CH chemical shifts
    "ANDN920101": (4.35, 4.38, 4.75, 4.76, 4.65, 4.37, 4.29, 3.97, 4.63, 3.95, 4.17, 4.36, 4.52, 4.66, 4.44, 4.50, 4.35, 4.70, 4.60, 3.95),
    # Kyte and Doolittle 1982, hydropathy
    "KYTJ820101": (1.8, -4.5, -3.5, -3.5, 2.5, -3.5, -3.5, -0.4, -3.2, 4.5, 3.8, -3.9, 1.9, 2.8, -1.6, -0.8, -0.7, -0.9, -1.3, 4.2),
    # Hopp and Woods 1981, hydrophilicity
    "HOPT810101": (-0.5, 3.0, 0.2, 3.0, -1.0, 0.2, 3.0, 0.0, -0.5, -1.8, -1.8, 3.0, -1.3, -2.5, 0.0, 0.3, -0.4, -3.4, -2.3, -1.5),
}
# Eisenberg's normalised consensus, average residue masses in dalton, and water's.
EISENBERG = dict(zip(RESIDUES, (0.62, -2.53, -0.78, -0.90, 0.29, -0.85, -0.74, 0.48, -0.40, 1.38, 1.06, -1.50, 0.64, 1.19, 0.12, -0.18, -0.05, 0.81, 0.26, 1.08), strict=True))
MASSES = dict(zip(RESIDUES, (71.0788, 156.1875, 114.1038, 115.0886, 103.1388, 128.1307, 129.1155, 57.0519, 137.1411, 113.1594, 113.1594, 128.1741, 131.1926, 147.1766, 97.1167, 87.0782, 101.1051, 186.2132, 163.1760, 99.1326), strict=True))
WATER = 18.01528
# Residue classes of shares, and three classes by hydrophobicity (polar, neutral, hydrophobic).
SHARES = {"aromaticity": "FWY", "helix": "VIYFWL", "turn": "NPGS", "sheet": "EMAL", "tiny": "ACGST", "small": "ABCDGNPSTV", "polar": "DEHKNQRSTZ", "nonpolar": "ACFGILMPVWY", "basic": "HKR", "acidic": "BDEZ", "fcr": "DEKR"}
CLASSES = ("RKEDQN", "GASTPHY", "CLVIMFW")
#: Bends of a helix by residue in degrees, residues of a moment's window, lags of autocorrelation, steps of the search for a pH.
TURN, WINDOW, LAGS, STEPS = 100.0, 11, 5, 40


def scale(name: str) -> dict[str, float]:
    return dict(zip(RESIDUES, SCALES[name], strict=True))


def letters(sequence: Column) -> Column:
    return F.filter(F.split(sequence, ""), lambda c: c != "")


def codes(sequence: Column, values: Mapping[str, float]) -> Column:
    """The value of every residue; other letters have 0."""
    table = F.create_map(*(F.lit(x) for r, v in values.items() for x in (r, float(v))))
    return F.transform(letters(sequence), lambda c: F.coalesce(F.try_element_at(table, c), F.lit(0.0)))


def _total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def frequency(sequence: Column, residues: str = CANONICAL) -> Column:
    """The share of each residue of the alphabet among all letters; null and empty sequences have zeros."""
    n = F.char_length(sequence)
    return F.array(*(F.coalesce(F.try_divide((n - F.char_length(F.replace(sequence, F.lit(r), F.lit("")))).cast("double"), n), F.lit(0.0)) for r in residues))


def physicochemical(sequence: Column, width: int, values: Mapping[str, float]) -> Column:
    """codes() as `width` numbers: zeros past the end, longer sequences are cut there. Null sequences have zeros."""
    x = F.coalesce(codes(sequence, values), F.array().cast("array<double>"))
    return F.slice(F.concat(x, F.array_repeat(F.lit(0.0), width)), 1, width)


def spectrum(sequence: Column, width: int, values: Mapping[str, float]) -> Column:
    """Magnitudes of the discrete Fourier transform of physicochemical() over n points, n the next power of two from width: frequencies 0 to n / 2 - 1.

    cosines and sines are two tables of n numbers, taken at index times place modulo n; only places with letters are summed. The letters' values are bound once,
    as a frequency's expression would work them out again.
    """
    n = 1 << max(1, (width - 1).bit_length())
    waves = [F.array(*(F.lit(f(2 * math.pi * i / n)) for i in range(n))) for f in (math.cos, math.sin)]
    x = F.slice(F.coalesce(codes(sequence, values), F.array().cast("array<double>")), 1, width)
    part = lambda x, wave, k: _total(F.transform(x, lambda v, i: v * F.get(wave, F.pmod(i * k, F.lit(n)))))
    size = lambda x, k: F.sqrt(F.pow(part(x, waves[0], k), F.lit(2.0)) + F.pow(part(x, waves[1], k), F.lit(2.0)))
    return F.get(F.transform(F.array(x), lambda x: F.transform(F.sequence(F.lit(0), F.lit(n // 2 - 1)), lambda k: size(x, k))), F.lit(0))


def _charge(counts: Mapping[str, Column], ph: Column) -> Column:
    up = lambda pka: F.lit(1.0) / (1 + F.pow(F.lit(10.0), ph - pka))
    down = lambda pka: F.lit(1.0) / (1 + F.pow(F.lit(10.0), pka - ph))
    total = up(PKA_N_TERM) - down(PKA_C_TERM)
    for r, pka in PKA_POSITIVE.items():
        total = total + counts[r] * up(pka)
    for r, pka in PKA_NEGATIVE.items():
        total = total - counts[r] * down(pka)
    return total


def isoelectric_point(counts: Mapping[str, Column]) -> Column:
    """The pH between 0 and 14 without net charge, by halving: the charge falls as the pH rises."""
    # the lower end alone is kept, so a step works the charge out once; multiples of 14 / 2^STEPS are exact
    def halved(low: Column, i: Column) -> Column:
        middle = low + F.lit(14.0) / F.pow(F.lit(2.0), i.cast("double"))
        return F.when(_charge(counts, middle) > 0, middle).otherwise(low)

    return F.aggregate(F.sequence(F.lit(1), F.lit(STEPS)), F.lit(0.0), halved, lambda low: low + F.lit(14.0 / 2 ** (STEPS + 1)))


def hydrophobic_moment(hydropathy: Column, window: int = WINDOW, turn: float = TURN) -> Column:
    """The largest mean moment of a window of residues that turn about an axis; a sequence shorter than the window is one."""
    angle = math.radians(turn)
    n = F.size(hydropathy)
    part = lambda f, i: _total(F.transform(F.slice(hydropathy, i, F.least(F.lit(window), n)), lambda v, j: v * f((j + i) * F.lit(angle))))
    size = lambda i: F.sqrt(F.pow(part(F.cos, i), F.lit(2.0)) + F.pow(part(F.sin, i), F.lit(2.0))) / F.least(F.lit(window), n)
    return F.when(n > 0, F.array_max(F.transform(F.sequence(F.lit(1), F.greatest(n - (window - 1), F.lit(1))), size)))


def autocorrelation(values: Column, lag: int) -> Column:
    """The mean product of values `lag` apart; null where there are none."""
    n = F.size(values)
    pairs = F.zip_with(F.slice(values, 1, F.greatest(n - lag, F.lit(0))), F.slice(values, lag + 1, F.greatest(n - lag, F.lit(0))), lambda a, b: a * b)
    return F.when(n > lag, _total(pairs) / (n - lag))


def dipeptide_index(sequence: Column, weights: Mapping[str, float]) -> Column:
    """10 / length times the sum of the weights of neighbouring residues, as instability is defined; pairs without a weight have 0. The published
    weights are a table of 400 numbers and so a parameter."""
    table = F.create_map(*(F.lit(x) for pair, w in weights.items() for x in (pair, float(w))))
    a = letters(sequence)
    pairs = F.zip_with(F.slice(a, 1, F.greatest(F.size(a) - 1, F.lit(0))), F.slice(a, 2, F.greatest(F.size(a) - 1, F.lit(0))), lambda x, y: F.coalesce(F.try_element_at(table, F.concat(x, y)), F.lit(0.0)))
    return F.when(F.size(a) > 0, F.lit(10.0) / F.size(a) * _total(pairs))


def composition_transition_distribution(kinds: Column) -> dict[str, Column]:
    """Of residues in classes 1 to 3 (0: none): shares, changes between two classes by neighbours, and where in hundredths the first, and each quarter, of a class ends."""
    n, out = F.size(kinds), {}
    some = lambda k: F.filter(F.transform(kinds, lambda c, i: F.when(c == k, i + 1)), lambda i: i.isNotNull())
    changes = F.zip_with(F.slice(kinds, 1, F.greatest(n - 1, F.lit(0))), F.slice(kinds, 2, F.greatest(n - 1, F.lit(0))), lambda a, b: F.least(a, b) * 10 + F.greatest(a, b))
    for k in (1, 2, 3):
        out[f"composition_{k}"] = F.try_divide(F.size(some(k)).cast("double"), n)
    between = lambda pair: F.size(F.filter(changes, lambda c: c == pair))
    for pair in (12, 13, 23):
        out[f"transition_{pair}"] = F.when(n > 1, between(pair) / (n - 1))
    for k in (1, 2, 3):
        for q in (0, 25, 50, 75, 100):
            place = F.get(some(k), F.greatest(F.floor(F.size(some(k)) * q / F.lit(100.0)).cast("int"), F.lit(1)) - 1)
            out[f"distribution_{k}_{q}"] = F.when(n > 0, F.coalesce(F.lit(100.0) * place / n, F.lit(0.0)))
    return out


def describe_sequences(df: DataFrame, key: str, sequence: str, ph: float = 7.0, dipeptides: Mapping[str, float] | None = None) -> DataFrame:
    """(key, length, molecular_weight, isoelectric_point ..): scalar descriptors and 21 of composition, transition and distribution for every row.

    Letters that aren't residues count for the length only. Null and empty sequences have a length of 0 and nulls. Counts and codes are columns of one
    projection below, so no expression walks the letters twice for the same reason. With `dipeptides`, dipeptide_index too.
    """
    s = F.coalesce(F.col(sequence), F.lit(""))
    kinds = {r: i for i, members in enumerate(CLASSES, 1) for r in members}
    base = df.select(F.col(key).alias("__key"), s.alias("__s")).select(
        "__key", "__s", F.char_length("__s").alias("n"), *((F.char_length("__s") - F.char_length(F.replace("__s", F.lit(r), F.lit("")))).cast("double").alias(f"n_{r}") for r in RESIDUES),
        codes(F.col("__s"), EISENBERG).alias("moments"), codes(F.col("__s"), scale("KYTJ820101")).alias("hydropathy"), F.transform(codes(F.col("__s"), kinds), lambda c: c.cast("int")).alias("kinds"),
    )
    n, counts = F.col("n"), {r: F.col(f"n_{r}") for r in RESIDUES}
    per = lambda values: F.try_divide(sum((counts[r] * F.lit(float(v)) for r, v in values.items()), F.lit(0.0)), n)
    charge = F.when(n > 0, _charge(counts, F.lit(float(ph))))
    out = {
        "length": n.cast("long"),
        "molecular_weight": F.when(n > 0, sum((counts[r] * F.lit(m) for r, m in MASSES.items()), F.lit(WATER))),
        "isoelectric_point": F.when(n > 0, isoelectric_point(counts)),
        "net_charge_pH": charge,
        "ncpr": charge / n,
        "boman_index": -per(BOMAN),
        "gravy": per(scale("KYTJ820101")),
        "aliphatic_index": per({"A": 100, "V": 290, "I": 390, "L": 390}),
        "extinction": F.when(n > 0, counts["W"] * 5500 + counts["Y"] * 1490 + F.floor(counts["C"] / 2) * 125).cast("long"),
        "aa_entropy": F.when(n > 0, sum((F.when(c > 0, -c / n * F.log2(c / n)).otherwise(0.0) for c in counts.values()), F.lit(0.0))),
        "hydrophobic_moment": hydrophobic_moment(F.col("moments")),
        **{name: per({r: 1.0 for r in members if r in counts}) for name, members in SHARES.items()},
        **{f"autocorrelation_{lag}": autocorrelation(F.col("hydropathy"), lag) for lag in range(1, LAGS + 1)},
        **composition_transition_distribution(F.col("kinds")),
    }
    if dipeptides is not None:
        out["dipeptide_index"] = dipeptide_index(F.col("__s"), dipeptides)
    return base.select(F.col("__key").alias(key), *(c.alias(name) for name, c in out.items()))
