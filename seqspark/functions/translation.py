"""Translation of DNA by the numbered genetic codes, with IUPAC codons."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from seqspark.functions import scalar

# Codons that each numbered code reads differently from the standard code (1).
CHANGES = {
    1: {},
    2: {"AGA": "*", "AGG": "*", "ATA": "M", "TGA": "W"},
    3: {"ATA": "M", "CTT": "T", "CTC": "T", "CTA": "T", "CTG": "T", "TGA": "W"},
    4: {"TGA": "W"},
    5: {"AGA": "S", "AGG": "S", "ATA": "M", "TGA": "W"},
    6: {"TAA": "Q", "TAG": "Q"},
    9: {"AAA": "N", "AGA": "S", "AGG": "S", "TGA": "W"},
    10: {"TGA": "C"},
    11: {},
    12: {"CTG": "S"},
    13: {"AGA": "G", "AGG": "G", "ATA": "M", "TGA": "W"},
    14: {"AAA": "N", "AGA": "S", "AGG": "S", "TAA": "Y", "TGA": "W"},
    15: {"TAG": "Q"},
    16: {"TAG": "L"},
    21: {"TGA": "W", "ATA": "M", "AGA": "S", "AGG": "S", "AAA": "N"},
    22: {"TCA": "*", "TAG": "L"},
}
# Codons that may begin a protein.
STARTS = {
    1: ("TTG", "CTG", "ATG"),
    2: ("ATT", "ATC", "ATA", "ATG", "GTG"),
    3: ("ATA", "ATG"),
    4: ("TTA", "TTG", "CTG", "ATT", "ATC", "ATA", "ATG", "GTG"),
    5: ("TTG", "ATT", "ATC", "ATA", "ATG", "GTG"),
    6: ("ATG",),
    9: ("ATG", "GTG"),
    10: ("ATG",),
    11: ("TTG", "CTG", "ATT", "ATC", "ATA", "ATG", "GTG"),
    12: ("CTG", "ATG"),
    13: ("TTG", "ATA", "ATG", "GTG"),
    14: ("ATG",),
    15: ("ATG",),
    16: ("ATG",),
    21: ("ATG", "GTG"),
    22: ("ATG",),
}


def amino_acids(table: int) -> str:
    """Amino acids of the 64 codons in the order TCAG of each base."""
    if table not in CHANGES:
        raise ValueError(f"no genetic code {table}")
    return "".join(CHANGES[table].get(codon, aa) for codon, aa in scalar.codons().items())


def codon_index(codon: Column) -> Column:
    """0 to 63 in the order TCAG; null if a base is none of them."""
    at = [F.call_function("locate", F.substr(codon, F.lit(k), F.lit(1)), F.lit("TCAG")) for k in (1, 2, 3)]
    return F.when((at[0] > 0) & (at[1] > 0) & (at[2] > 0) & (F.length(codon) == 3), at[0] * 16 + at[1] * 4 + at[2] - 21)


def told_by_masks(table: int) -> str:
    """Amino acids of the 4096 codons of IUPAC letters, by 256, 16 and 1 times the letters' bit sets; X where readings differ."""
    bit = {"A": 1, "C": 2, "G": 4, "T": 8}
    told = dict(zip(scalar.codons(), amino_acids(table)))
    out = []
    for index in range(4096):
        masks = index >> 8, index >> 4 & 15, index & 15
        readings = {aa for codon, aa in told.items() if all(bit[c] & m for c, m in zip(codon, masks))}
        out.append(readings.pop() if len(readings) == 1 else "X")
    return "".join(out)


def amino_acid(codon: Column, table: int = 1) -> Column:
    """Amino acid of a codon; an IUPAC codon has one if all its readings do, else X. One look into an array for each codon."""
    up = F.upper(codon)
    masks = [F.call_function("locate", F.substr(up, F.lit(k), F.lit(1)), F.lit(scalar.IUPAC)) - 1 for k in (1, 2, 3)]
    index = F.when(F.least(*masks) >= 0, masks[0] * 256 + masks[1] * 16 + masks[2] + 1)
    return F.coalesce(F.element_at(F.split(F.lit(told_by_masks(table)), ""), index), F.lit("X"))


def translate(dna: Column, table: int = 1, start: int = 1, reverse: bool = False, to_stop: bool = False) -> Column:
    """Protein of the whole codons from the 1-based start (1 to 3), on either strand.

    Gaps (*) are skipped after the start is counted. to_stop ends with the first stop codon, which is included.
    """
    if start not in (1, 2, 3):
        raise ValueError("start is 1, 2 or 3")
    strand = scalar.reverse_complement(dna) if reverse else dna
    clean = F.replace(F.substr(strand, F.lit(start)), F.lit("*"), F.lit(""))
    protein = F.array_join(F.transform(F.regexp_extract_all(clean, F.lit("(?s)..."), F.lit(0)), lambda x: amino_acid(x, table)), "")
    if to_stop:
        protein = F.when(protein.contains("*"), F.concat(F.substring_index(protein, "*", 1), F.lit("*"))).otherwise(protein)
    return protein


#: One letter for each of the 64 codons in the order TCAG.
CODON_LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+-"


def coded(dna: Column) -> Column:
    """A letter of CODON_LETTERS for each whole codon of TCAG, so that several codes are read from one pass over the codons; ? for other codons."""
    return F.array_join(F.transform(F.regexp_extract_all(dna, F.lit("(?s)..."), F.lit(0)), lambda x: F.coalesce(F.substr(F.lit(CODON_LETTERS), codon_index(x) + F.lit(1), F.lit(1)), F.lit("?"))), "")


def told(letters: Column, table: int = 1) -> Column:
    """Protein of coded()."""
    return F.translate(letters, CODON_LETTERS + "?", amino_acids(table) + "X")


def is_start(codon: Column, table: int = 1) -> Column:
    return F.upper(codon).isin(*STARTS[table])


def identity(a: Column, b: Column) -> Column:
    """Percent of equal places over the longer of two proteins, each up to its first stop; 1.0 if both are empty."""
    x, y = (F.split(F.substring_index(p, "*", 1), "") for p in (a, b))
    n, m = (F.length(F.substring_index(p, "*", 1)) for p in (a, b))
    same = F.size(F.filter(F.zip_with(x, y, lambda p, q: (p == q) & (p != "")), lambda t: t))
    return F.when(F.greatest(n, m) == 0, F.lit(1.0)).otherwise(100.0 * same / F.greatest(n, m))


def contained(a: Column, b: Column) -> Column:
    """Whether two IUPAC letters share a base."""
    mask = lambda c: F.call_function("locate", F.upper(c), F.lit(scalar.IUPAC)) - 1
    return F.greatest(mask(a), F.lit(0)).bitwiseAND(F.greatest(mask(b), F.lit(0))) > 0


def bases_of(letter: Column) -> Column:
    """The bases that an IUPAC letter stands for, in the order ACGT."""
    mask = F.call_function("locate", F.upper(letter), F.lit(scalar.IUPAC)) - 1
    return F.array_compact(F.array(*(F.when(mask.bitwiseAND(F.lit(1 << k)) > 0, b) for k, b in enumerate("ACGT"))))
