"""Chat formatting with DataFrame functions only.

A finite-state machine over roles validates the order of turns; a declarative template turns each
conversation into text segments with a loss flag each. Texts can't be mistaken for the template's marks:
its control strings are broken up by backslashes where texts hold them, which unescape() takes out again.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Letters that stand for marks of one character, after a backslash.
CODES = "cdefghijklmnopqrstuvwxyzab"


@dataclass(frozen=True)
class Template:
    """Marks around a turn, the roles whose texts carry loss, and the transitions of the role machine.

    A turn is written as head + role + middle + text + tail. Escaped texts hold neither the head nor the tail, and
    escaped roles none of the three (white space around them aside). Marks hold no backslash, the middle
    and the tail are not empty, and the tail is more than one character repeated.
    """

    head: str = "### "
    middle: str = ": "
    tail: str = "</turn>\n"
    loss_roles: tuple[str, ...] = ("assistant",)
    start: str = "start"
    accepting: tuple[str, ...] = ("assistant",)
    transitions: dict[str, tuple[str, ...]] = field(
        default_factory=lambda: {"start": ("system", "user"), "system": ("user",), "user": ("assistant",), "assistant": ("user",)}
    )


def _core(mark: str) -> str:
    """What of a mark is broken up: all but the white space around it, if there is more."""
    return mark.strip() or mark


def _checked(t: Template) -> Template:
    if not t.middle or not t.tail or "\\" in t.head + t.middle + t.tail or (len(t.tail) > 1 and len(set(t.tail)) == 1):
        raise ValueError("the template's marks can't be told apart from texts")
    return t


def _marks(t: Template, role: bool) -> list[str]:
    return list(dict.fromkeys(_core(m) for m in (t.head, t.tail, *[t.middle] * role) if m))


def _codes(marks: list[str]) -> dict[str, str]:
    """Codes of marks of one character. No code follows a backslash that breaks up a longer mark."""
    taken = {m[1] for m in marks if len(m) > 1}
    return dict(zip((m for m in marks if len(m) == 1), (c for c in CODES if c not in taken)))


def _escape(text: Column, marks: list[str]) -> Column:
    r"""Backslash to \\, then a backslash behind the first character of each mark.

    A mark of one character becomes a code, and longer marks with that character can't be left. One that can
    overlap itself is broken up wherever its first two characters stand, so that what is left over of one
    can't make another.
    """
    out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    codes = _codes(marks)
    for m, code in codes.items():
        out = F.replace(out, F.lit(m), F.lit("\\" + code))
    for m in sorted((m for m in marks if len(m) > 1 and not set(m) & set(codes)), key=lambda m: -len(m)):
        overlaps = any(m.startswith(m[k:]) for k in range(1, len(m)))
        found = m[:2] if overlaps else m
        for _ in range(2 if m == 2 * m[0] else 1):
            out = F.replace(out, F.lit(found), F.lit(found[0] + "\\" + found[1:]))
    return out


def _unescape(text: Column, marks: list[str]) -> Column:
    """Undo _escape(). Parts between doubled backslashes are free of them."""
    codes = _codes(marks)

    def part(p: Column) -> Column:
        for m, code in codes.items():
            p = F.replace(p, F.lit("\\" + code), F.lit(m))
        return F.replace(p, F.lit("\\"), F.lit(""))

    return F.array_join(F.transform(F.split(text, r"\\\\", -1), part), "\\")


def escape(text: Column, template: Template | None = None) -> Column:
    t = _checked(template or Template())
    return _escape(text, _marks(t, False))


def escape_role(role: Column, template: Template | None = None) -> Column:
    t = _checked(template or Template())
    return _escape(role, _marks(t, True))


def unescape(text: Column, template: Template | None = None) -> Column:
    """Undo escape()."""
    return _unescape(text, _marks(template or Template(), False))


def unescape_role(role: Column, template: Template | None = None) -> Column:
    """Undo escape_role()."""
    return _unescape(role, _marks(template or Template(), True))


def format_chats(turns: DataFrame, template: Template | None = None) -> DataFrame:
    """One row per conversation: conv_id, n_turns, valid, last_state, segments, formatted.

    turns: conv_id, turn, role, text (other columns are ignored). Turns are ordered by turn, role and text,
    nulls first; ties are kept, as are repeated rows. Null roles and texts count as empty. A null conv_id is
    a conversation of its own. valid: the role machine accepts; an unknown or null role leads to the state
    "error", which stays. segments: array of (kind, role, text, loss), whose texts joined are formatted; all
    rows come back, valid or not. An empty table gives an empty one. A conversation is one row here, as its
    digests and text are of the whole; no other grouping is done.
    """
    t = _checked(template or Template())
    turn = F.struct("turn", F.col("role"), F.col("text"))
    sorted_turns = F.array_sort(F.collect_list(turn))
    step = F.create_map(*(F.lit(x) for a, to in t.transitions.items() for b in to for x in (f"{a}\n{b}", b)))
    chats = turns.groupBy("conv_id").agg(sorted_turns.alias("turns")).withColumn(
        "turns", F.transform("turns", lambda x: F.struct(F.coalesce(x.role, F.lit("")).alias("role"), F.coalesce(x.text, F.lit("")).alias("text")))
    )
    state = F.aggregate("turns", F.lit(t.start), lambda s, x: F.coalesce(F.try_element_at(step, F.concat(s, F.lit("\n"), x.role)), F.lit("error")))

    def segment(kind: str, role: Column, text: Column, loss: Column) -> Column:
        return F.struct(F.lit(kind).alias("kind"), role.alias("role"), text.alias("text"), loss.alias("loss"))

    def segments(x: Column) -> Column:
        no = F.lit(False)
        return F.array(
            segment("open", x.role, F.concat(F.lit(t.head), escape_role(x.role, t), F.lit(t.middle)), no),
            segment("text", x.role, escape(x.text, t), x.role.isin(*t.loss_roles)),
            segment("close", x.role, F.lit(t.tail), no),
        )

    out = chats.select("conv_id", F.size("turns").cast("long").alias("n_turns"), state.alias("last_state"), F.flatten(F.transform("turns", segments)).alias("segments"))
    return out.select(
        "conv_id",
        "n_turns",
        F.col("last_state").isin(*t.accepting).alias("valid"),
        "last_state",
        "segments",
        F.array_join(F.transform("segments", lambda s: s.text), "").alias("formatted"),
    )


def read_back(formatted: Column, template: Template | None = None) -> Column:
    """The turns of a formatted text, as an array of (role, text), unescaped."""
    t = template or Template()
    parts = F.split(formatted, f"\\Q{t.tail}\\E", -1)
    turns = F.slice(parts, F.lit(1), F.size(parts) - 1)

    def parse(x: Column) -> Column:
        rest = F.substr(x, F.lit(len(t.head) + 1))
        role = F.substring_index(rest, t.middle, 1)
        text = F.substr(rest, F.length(role) + 1 + len(t.middle))
        return F.struct(unescape_role(role, t).alias("role"), unescape(text, t).alias("text"))

    return F.transform(turns, parse)


def digests(chats: DataFrame, template: Template | None = None) -> DataFrame:
    """Digests of what format_chats() wrote: conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, valid."""
    t = template or Template()
    back = chats.withColumn("back", read_back(F.col("formatted"), t)).withColumn(
        "lost", F.array_join(F.transform(F.filter("segments", lambda s: s.loss), lambda s: unescape(s.text, t)), "")
    )
    told = F.array_join(F.transform("back", lambda x: F.concat(x.role, F.lit("\n"), x.text, F.lit("\n"))), "")
    return back.select(
        "conv_id",
        F.size("back").cast("long").alias("n_turns"),
        F.sha2(told.cast("binary"), 256).alias("turns_sha256"),
        F.length("lost").cast("long").alias("loss_chars"),
        F.sha2(F.col("lost").cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
        "valid",
    )
