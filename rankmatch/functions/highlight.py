"""Positions for other counts of characters, and marked-up text; native expressions and their plain Python forms."""

from __future__ import annotations

from html import escape

from pyspark.sql import Column
from pyspark.sql import functions as F


def to_utf16(text: Column, indices: Column) -> Column:
    """Code point positions as UTF-16 offsets; positions beyond the text become its whole length."""
    astral = lambda s: F.regexp_count(s, F.lit("[\\x{10000}-\\x{10ffff}]"))
    return F.transform(indices, lambda i: (F.least(i, F.length(text)) + astral(F.substring(text, F.lit(1), i))).cast("int"))


def highlight_html(text: Column, indices: Column, tag: str = "mark") -> Column:
    """``text`` escaped for HTML, with runs of neighbouring positions in one element; ``indices`` are sorted.

    Each position adds the piece since the one before it: the work grows with the text, not with text times positions.
    """
    close, open_ = f"</{tag}>", f"<{tag}>"

    def plain(s: Column, a: Column, b: Column) -> Column:
        return F.array_join(F.slice(s["chars"], a + 1, F.greatest(b - a, F.lit(0))), "")

    def piece(s: Column, i: Column, k: Column) -> Column:
        before = F.coalesce(F.get(s["at"], k - 1), F.lit(-1))
        after = F.coalesce(F.get(s["at"], k + 1), F.lit(-1))
        starts = F.when((k == 0) | (before < i - 1), F.concat(plain(s, before + 1, i), F.lit(open_))).otherwise(F.lit(""))
        ends = F.when(after == i + 1, F.lit("")).otherwise(F.lit(close))
        return F.concat(starts, F.get(s["chars"], i), ends)

    escaped = text
    for char, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        escaped = F.replace(escaped, F.lit(char), F.lit(name))
    chars = F.transform(F.split(text, ""), lambda c: F.when(c.isin("&", "<", ">"), F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))).otherwise(c))
    at = F.filter(indices, lambda i: (i >= 0) & (i < F.length(text)))
    whole = F.transform(
        F.array(F.struct(chars.alias("chars"), at.alias("at"))),
        lambda s: F.concat(F.array_join(F.transform(s["at"], lambda i, k: piece(s, i, k)), ""), plain(s, F.element_at(s["at"], -1) + 1, F.size(s["chars"]))),
    )
    return F.when(F.size(at) == 0, escaped).otherwise(F.get(whole, F.lit(0)))


def html_of(text: str, indices: list[int], tag: str = "mark") -> str:
    out, open_, at = "", False, set(indices)
    for i, c in enumerate(text):
        if (i in at) != open_:
            out, open_ = out + (f"</{tag}>" if open_ else f"<{tag}>"), not open_
        out += escape(c, quote=False)
    return out + f"</{tag}>" * open_
