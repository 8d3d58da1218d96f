"""Column expressions on sequences, qualities and names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Bases, their complements, and IUPAC letters by bit set (A 1, C 2, G 4, T 8).
BASES, COMPLEMENTS = "ACGTRYKMBDHVacgtrykmbdhv", "TGCAYRMKVHDBtgcayrmkvhdb"
IUPAC = "-ACMGRSVTWYHKDBN"
# The standard genetic code, codons in the order TCAG of each base.
AMINO_ACIDS = "FFLLSSSSYY**CC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG"


def reverse_complement(seq: Column) -> Column:
    return F.reverse(F.translate(seq, BASES, COMPLEMENTS))


def base_bits(base: Column) -> Column:
    """Bit of a base, 0 for other characters."""
    return F.when(base == "A", 1).when(base == "C", 2).when(base == "G", 4).when(base == "T", 8).otherwise(0)


def iupac_letter(bits: Column) -> Column:
    return F.substring(F.lit(IUPAC), bits + 1, F.lit(1)) if isinstance(bits, int) else F.substr(F.lit(IUPAC), bits + F.lit(1), F.lit(1))


def codons() -> dict[str, str]:
    return {a + b + c: AMINO_ACIDS[16 * i + 4 * j + k] for i, a in enumerate("TCAG") for j, b in enumerate("TCAG") for k, c in enumerate("TCAG")}


def translate_dna(dna: Column, start: int = 1) -> Column:
    """Protein of whole codons from the 1-based start; gaps are skipped, other codons give X."""
    table = F.create_map(*(F.lit(x) for pair in codons().items() for x in pair))
    clean = F.substr(F.replace(dna, F.lit("*"), F.lit("")), F.lit(start))
    return F.array_join(F.transform(F.regexp_extract_all(clean, F.lit("(?s)..."), F.lit(0)), lambda x: F.coalesce(F.try_element_at(table, x), F.lit("X"))), "")


def error_rate(quality: Column) -> Column:
    """10^(q/10), the inverse of the error probability."""
    return F.pow(F.lit(10.0), quality / 10)


def quality_of(rate: Column) -> Column:
    return F.floor(F.log10(F.least(rate, F.lit(1e9))) * 10 + 0.5).cast("int")


def template_of(name: Column) -> Column:
    """Template of a name split at its last slash; a longer suffix is appended with an underscore."""
    head, tail = F.regexp_extract(name, r"^(.*)/(.)(.*)$", 1), F.regexp_extract(name, r"^(.*)/(.)(.*)$", 3)
    return F.when(~name.contains("/"), name).when(tail == "", head).otherwise(F.concat(head, F.lit("_"), tail))


def segment_of(name: Column) -> Column:
    """1 for the first read of a template, 255 for the second, else 0."""
    code = F.regexp_extract(name, r"^(.*)/(.)(.*)$", 2)
    return F.when(code == "1", 1).when(code == "2", 255).otherwise(0)


def effective_clip(lefts: list[Column], rights: list[Column]) -> tuple[Column, Column]:
    """The innermost of several clips."""
    return F.greatest(*lefts), F.least(*rights)
