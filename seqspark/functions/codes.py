"""Escapes and short forms of text and numbers, and GFF3 attributes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Characters that GFF3 escapes, the percent sign first.
GFF3_ESCAPED = "%" + "".join(map(chr, range(0x20))) + "&,;=\x7f"
# Digits of the short number form; d, l and q are left out.
DIGITS = "0123456789abcefghijkmnoprstuvwxy"


def gff3_encode(text: Column) -> Column:
    for c in GFF3_ESCAPED:
        text = F.replace(text, F.lit(c), F.lit(f"%{ord(c):02X}"))
    return text


def gff3_decode(text: Column) -> Column:
    """Percent decoding that leaves plus signs and invalid escapes alone."""
    valid = F.regexp_replace(F.replace(text, F.lit("\x01"), F.lit("%01")), "%([0-9A-Fa-f]{2})", "\x01$1")
    plain = F.replace(F.replace(valid, F.lit("%"), F.lit("%25")), F.lit("+"), F.lit("%2B"))
    return F.try_url_decode(F.replace(plain, F.lit("\x01"), F.lit("%")))


def gff3_attributes(text: Column) -> Column:
    """Decoded keys and values of a GFF3 attribute column, as a map; of repeated keys the last holds."""
    parts = F.filter(F.split(text, ";"), lambda x: F.trim(x) != "")
    entry = lambda x: F.struct(gff3_decode(F.trim(F.substring_index(x, "=", 1))).alias("key"), F.when(x.contains("="), gff3_decode(F.substr(x, F.instr(x, "=") + 1))).otherwise("").alias("value"))
    pairs = F.transform(parts, entry)
    last = F.filter(pairs, lambda x, i: ~F.exists(F.slice(pairs, i + 2, F.size(pairs)), lambda y: y.key == x.key))
    return F.map_from_entries(last)


def gff3_attribute_text(attributes: Column) -> Column:
    """A map as a GFF3 attribute column, keys in order."""
    pairs = F.array_sort(F.map_entries(attributes))
    return F.array_join(F.transform(pairs, lambda x: F.concat(gff3_encode(x.key), F.lit("="), gff3_encode(x.value))), ";")


def common_name(attributes: Column) -> Column:
    """The name to show for a feature: Name, else gene, locus_tag, ID."""
    return F.coalesce(*(F.try_element_at(attributes, F.lit(k)) for k in ("Name", "gene", "locus_tag", "ID")))


def human_bytes(n: Column) -> Column:
    """Bytes with a binary unit, one decimal from GiB on, halves to even."""
    whole = lambda unit, size: F.concat(F.bround(n / size, 0).cast("long").cast("string"), F.lit(f" {unit}"))
    tenth = lambda unit, size: F.concat(F.format_string("%.1f", F.bround(n / size, 1)), F.lit(f" {unit}"))
    small = F.concat(F.floor(n).cast("long").cast("string"), F.lit(" B"))
    return F.when(n < 1 << 10, small).when(n < 1 << 20, whole("KiB", 1 << 10)).when(n < 1 << 30, whole("MiB", 1 << 20)).when(n < 1 << 40, tenth("GiB", 1 << 30)).otherwise(tenth("TiB", 1 << 40))


def short_number(value: Column, bits: int) -> Column:
    """Digits of a whole number, each of its lowest five bits, moved on by six bits: one bit in six is lost."""
    digits = -(-bits // 5)
    each = F.transform(F.array(*(F.lit(6 * k) for k in reversed(range(digits)))), lambda s: _digit(value, s))
    text = F.ltrim(F.array_join(each, ""), F.lit("0"))
    return F.when(text == "", "0").otherwise(text)


def _digit(value: Column, shift: Column) -> Column:
    low = F.call_function("shiftrightunsigned", value, shift).bitwiseAND(F.lit(31))
    return F.substr(F.lit(DIGITS), (low + 1).cast("int"), F.lit(1))


def comment_value(comment: Column, key: str) -> Column:
    """Value of a line `/key="value"` or `/key=value` of a feature's comment; null where there is none."""
    found = F.regexp_extract(comment, rf'(?m)^\s*/{key}="?([^"\n]*)', 1)
    return F.when(comment.rlike(rf"(?m)^\s*/{key}="), found)


def html_escape(text: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text
