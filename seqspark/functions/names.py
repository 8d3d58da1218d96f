"""Template names and segments of reads by naming scheme, and codes of placements."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

FIRST, LAST, UNKNOWN = 1, 255, 0
# The letters after the last dot that mark the first and the last segment, by scheme.
SEGMENT_LETTERS = {"sanger": ("PF", "QR"), "fr": ("F", "R"), "sra": ("1", "2"), "stlouis": ("SFXZIB", "RYG")}
# Spellings of segment placements, after arrows and white space are resolved.
PLACEMENTS = {
    "SF": ("SF", "SAMEDIRFORWARD", "FORWARDFORWARD", "1FORWARD2FORWARD", "SAMEDIRECTIONFORWARD", "LEFTIES", "LEFTIE", "LEFTY"),
    "SB": ("SB", "2FORWARD1FORWARD", "SAMEDIRREVERSE", "SAMEDIRECTIONREVERSE", "SAMEDIRBACKWARD", "SAMEDIRECTIONBACKWARD", "RIGHTIES", "RIGHTIE", "RIGHTY"),
    "SU": ("SAMEDIR", "SU", "SAMEDIRECTION", "SAMEDIRUNKNOWN", "SAMEDIRECTIONUNKNOWN"),
    "FR": ("FORWARDREVERSE", "FR", "INNIES", "INNIE", "INNY"),
    "RF": ("REVERSEFORWARD", "RF", "OUTIES", "OUTIE", "OUTY"),
    "UNKNOWN": ("UNKNOWN", ""),
}
DOTTED = r"(?s)^(.*)\.(.?)(.*)$"


def dotted(name: Column, scheme: str) -> tuple[Column, Column]:
    """(template, segment) of a name that is split at its last dot.

    What follows the segment's letter is appended to the template with an underscore. Where nothing is left, and
    in the schemes fr and sra where no letter follows the dot, the template is the whole name.
    """
    first, last = SEGMENT_LETTERS[scheme]
    base, code, rest = (F.regexp_extract(name, DOTTED, k) for k in (1, 2, 3))
    key = code if scheme == "sra" else F.upper(code)
    segment = F.when(key.isin(*first), FIRST).when(key.isin(*last), LAST).otherwise(UNKNOWN)
    template = F.concat(base, F.when(rest == "", "").otherwise(F.concat(F.lit("_"), rest)))
    whole = ~name.contains(".") | (template == "")
    if scheme in ("fr", "sra"):
        whole = whole | (code == "")
    return F.when(whole, name).otherwise(template), F.when(name.contains("."), segment).otherwise(UNKNOWN)


def tigr(name: Column) -> tuple[Column, Column]:
    """(template, segment) by the first TF (first segment), else the first TR (last segment)."""
    mark = F.when(name.contains("TF"), "TF").when(name.contains("TR"), "TR")
    at = F.when(name.contains("TF"), F.instr(name, "TF")).otherwise(F.instr(name, "TR"))
    base, rest = F.substr(name, F.lit(1), at - 1), F.substr(name, at + 2)
    template = F.concat(base, F.when(rest == "", "").otherwise(F.concat(F.lit("_"), rest)))
    segment = F.when(mark == "TF", FIRST).when(mark == "TR", LAST).otherwise(UNKNOWN)
    return F.when(mark.isNull() | (template == ""), name).otherwise(template), segment


def is_sra(name: Column) -> Column:
    """Whether a name is three capitals, six digits, a dot and more."""
    return name.rlike(r"(?s)^[A-Z]{3}[0-9]{6}\..")


def placement(text: Column) -> Column:
    """Placement code of a spelling, null for one that is not known; arrows, case and blanks don't matter."""
    plain = F.upper(F.regexp_replace(text, r"[\s-]", ""))
    for sign, word in ((">", "FORWARD"), ("<", "REVERSE"), ("=", "SAMEDIR"), ("?", "UNKNOWN")):
        plain = F.replace(plain, F.lit(sign), F.lit(word))
    out = F.lit(None).cast("string")
    for code, spellings in PLACEMENTS.items():
        out = F.when(plain.isin(*spellings), code).otherwise(out)
    return out


def renamed(name: Column, prefixes: dict[str, str]) -> Column:
    """The name with the first of the prefixes that it begins with replaced."""
    out = name
    for old, new in reversed(prefixes.items()):
        out = F.when(name.startswith(old), F.concat(F.lit(new), F.substr(name, F.lit(len(old) + 1)))).otherwise(out)
    return out
