"""Column functions of the engine: intervals, bands, composition, complexity, labels."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def safe_ratio(a: Column, b: Column) -> Column:
    """a / b in double precision, null where b is null or zero."""
    return F.try_divide(a.cast("double"), b.cast("double"))


def overlap_ratio(s1: Column, e1: Column, s2: Column, e2: Column) -> Column:
    """Shared positions of two inclusive intervals, in either order, over the shorter one; 0 for nulls and gaps."""
    a, b, c, d = F.least(s1, e1), F.greatest(s1, e1), F.least(s2, e2), F.greatest(s2, e2)
    shared = F.greatest(F.least(b, d) - F.greatest(a, c) + 1, F.lit(0))
    known = s1.isNotNull() & e1.isNotNull() & s2.isNotNull() & e2.isNotNull()
    return F.when(known, F.coalesce(safe_ratio(shared, F.least(b - a + 1, d - c + 1)), F.lit(0.0))).otherwise(F.lit(0.0))


def coverage_band(coverage: Column) -> Column:
    """Ordered bands of reference coverage; null falls to the lowest."""
    return F.when(coverage >= 1, "100%").when(coverage >= 0.95, ">=95%").when(coverage >= 0.9, ">=90%").when(coverage >= 0.8, ">=80%").otherwise("<80%")


def strata_label(size: Column) -> Column:
    """Bins of stratum sizes."""
    return F.when(size <= 0, "Empty").when(size == 1, "One").when(size < 10, "<10").when(size <= 100, ">10").otherwise(">100")


def normalise_label(label: Column, missing: str = "UNCLASSIFIED") -> Column:
    """Trimmed, without a trailing word 'superfamily'; empty to ``missing``; 'Divergent...' to 'Divergent'; white space to '_'."""
    plain = F.trim(F.regexp_replace(F.coalesce(label, F.lit("")), " superfamily$", ""))
    return F.when(plain == "", missing).when(plain.startswith("Divergent"), "Divergent").otherwise(F.regexp_replace(plain, r"\s+", "_"))


def count_letter(seq: Column, letters: str) -> Column:
    return F.length(seq) - F.length(F.translate(seq, letters, ""))


def letter_entropy(seq: Column, alphabet: str = "ACGT") -> Column:
    """Shannon bits of the letters of ``alphabet``, over the length of the whole sequence."""
    n = F.length(seq)

    def term(letter: str) -> Column:
        p = safe_ratio(count_letter(seq, letter), n)
        return F.when(p > 0, -p * F.log2(p)).otherwise(F.lit(0.0))

    return reduce(lambda a, b: a + b, [term(x) for x in alphabet])


def information_content(seq: Column, alphabet: str = "ACGT") -> Column:
    """Sum of p log2(p / uniform) over the alphabet."""
    n = F.length(seq)

    def term(letter: str) -> Column:
        p = safe_ratio(count_letter(seq, letter), n)
        return F.when(p > 0, p * F.log2(p * len(alphabet))).otherwise(F.lit(0.0))

    return reduce(lambda a, b: a + b, [term(x) for x in alphabet])


def change_complexity(seq: Column) -> Column:
    """Percent of neighbouring positions that differ; null below two letters."""
    letters = F.split(seq, "")
    pairs = F.zip_with(F.slice(letters, 1, F.size(letters) - 1), F.slice(letters, 2, F.size(letters) - 1), lambda a, b: (a != b).cast("int"))
    changed = F.aggregate(pairs, F.lit(0), lambda acc, x: acc + x)
    return F.when(F.length(seq) >= 2, changed * 100.0 / (F.length(seq) - 1))


def sequence_type(nucleotide: Column, amino: Column, total: Column, share: float = 0.8) -> Column:
    """NUCLEOTIDE, AMINO or MIXED by the share of letters in either alphabet."""
    return F.when(safe_ratio(nucleotide, total) >= share, "NUCLEOTIDE").when(safe_ratio(amino, total) >= share, "AMINO").otherwise("MIXED")


def lnrr(x: Column, y: Column) -> Column:
    """Log response ratio; null unless both are positive."""
    return F.when((x > 0) & (y > 0), F.ln(x) - F.ln(y))


def se_lnrr(se_x: Column, se_y: Column, x: Column, y: Column) -> Column:
    return F.sqrt(F.pow(safe_ratio(se_x, x), 2) + F.pow(safe_ratio(se_y, y), 2))


def odds_shift(odds: Column, p: Column) -> Column:
    """A proportion after its odds are multiplied."""
    return safe_ratio(odds * p, 1 - p + odds * p)


def hash_order(seed: int | str, key: Column) -> Column:
    """The same pseudo-random order in every engine."""
    return F.md5(F.concat(F.lit(f"{seed}-"), key.cast("string")))


def hash_unit(seed: int | str, key: Column) -> Column:
    """A number in [0, 1) that follows from seed and key."""
    return F.conv(F.substring(hash_order(seed, key), 1, 13), 16, 10).cast("long") / F.lit(float(1 << 52))
