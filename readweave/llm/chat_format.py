"""Chat formatting with a grammar round trip.

    conversation := "<chat " level ">\\n" turn*
    turn         := "### " role ": " text "</turn>\\n"

Level 0 writes role and text as they are.  A deterministic parser reads the result back; if the recovered
turns are not those of the source, the conversation is written again with the next level, whose escapes
leave none of the grammar's characters in a text: backslash \\b, "<" \\l, "#" \\h, and ":" of a role \\c.
A level that still doesn't give the source back is an error, not a guess.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fixed

_END = "</turn>"
#: Character and escape, in the order of writing; reading goes the other way, so that \b comes last.
_ESCAPES = (("\\", "\\b"), ("<", "\\l"), ("#", "\\h"))


def _escape(value: Column, level: int, role: bool = False) -> Column:
    if level:
        for plain, code in (*_ESCAPES, *[(":", "\\c")] * role):
            value = F.replace(value, F.lit(plain), F.lit(code))
    return value


def _unescape(value: Column, level: Column, role: bool = False) -> Column:
    raw = value
    for plain, code in reversed((*_ESCAPES, *[(":", "\\c")] * role)):
        value = F.replace(value, F.lit(code), F.lit(plain))
    return F.when(level == 0, raw).otherwise(value)


def rendered(turns: Column, level: int) -> Column:
    """turns: array of structs with role and text."""
    each = F.transform(turns, lambda t: F.concat(F.lit("### "), _escape(t["role"], level, True), F.lit(": "), _escape(t["text"], level), F.lit(_END + "\n")))
    return F.concat(F.lit(f"<chat {level}>\n"), F.array_join(each, ""))


def _pieces(formatted: Column) -> Column:
    """The written turns without their end marks, with the place where each text begins; null if the last turn has no end."""
    pieces = F.split(F.substring(formatted, 10, 1 << 30), _END + "\n", -1)
    # A piece that does not begin as a turn, or holds a mark of the grammar in its role or text, has no head.
    clean = lambda p: p.startswith("### ") & (F.instr(p, ": ") > 0) & ~F.substring(p, 5, 1 << 30).contains("###") & ~p.contains(_END)
    each = F.transform(F.slice(pieces, 1, F.size(pieces) - 1), lambda p: F.struct(F.when(clean(p), F.instr(p, ": ") + 1).alias("head"), F.length(p).alias("length"), p.alias("piece")))
    return F.when(F.element_at(pieces, -1) == "", each)


def parsed(formatted: Column) -> Column:
    """Recovered turns: array of role, text, start and end (of the written text, in code points).

    Role and text are null where the grammar fails.
    """
    pieces = _pieces(formatted)
    ends = F.aggregate(pieces, F.array(F.lit(9)), lambda done, p: F.concat(done, F.array(F.element_at(done, -1) + p["length"] + len(_END) + 1)))
    whole = F.struct(pieces.alias("pieces"), ends.alias("ends"), F.substring(formatted, 7, 1).cast("int").alias("level"))

    def turn(w: Column, p: Column, i: Column) -> Column:
        begin = F.get(w["ends"], i)
        return F.struct(
            _unescape(F.substr(p["piece"], F.lit(5), p["head"] - 6), w["level"], True).alias("role"),
            _unescape(F.substr(p["piece"], p["head"] + 1), w["level"]).alias("text"),
            (begin + p["head"]).alias("start"),
            (begin + p["length"]).alias("end"),
        )

    return F.transform(F.array(whole), lambda w: F.transform(w["pieces"], lambda p, i: turn(w, p, i)))[0]


def _same(turns: Column, source: Column) -> Column:
    said = F.transform(turns, lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text")))
    return F.coalesce(said == source, F.lit(False))


def format_chat(conversations: DataFrame, answers: str = "assistant") -> DataFrame:
    """One row per conversation: conv_id, formatted, turns (as parsed back from it), loss_spans.

    Rows of a conversation follow by turn, then role, then text; a null turn comes first, repeated rows all
    stay.  Null roles and texts count as empty; rows of a null conv_id make one conversation.  loss_spans
    are the (start, end) code points of formatted that hold the texts of `answers`, without marks.
    A conversation is one training example and so one row; nothing larger is gathered.
    """
    row = F.struct(F.col("turn"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    grouped = conversations.groupBy("conv_id").agg(F.array_sort(F.collect_list(row)).alias("rows"))
    grouped = grouped.select("conv_id", F.transform("rows", lambda r: F.struct(r["role"].alias("role"), r["text"].alias("text"))).alias("source"))
    for level in (0, 1):
        if level == 0:
            grouped = grouped.withColumn("formatted", rendered(F.col("source"), 0))
        else:
            grouped = grouped.withColumn("formatted", F.when(_same(F.col("turns"), F.col("source")), F.col("formatted")).otherwise(rendered(F.col("source"), level)))
        grouped = fixed(fixed(grouped).withColumn("turns", parsed(F.col("formatted"))))
    lost = F.raise_error(F.concat(F.lit("no level gives this conversation back: "), F.coalesce(F.col("conv_id").cast("string"), F.lit("null"))))
    turns = F.when(_same(F.col("turns"), F.col("source")), F.col("turns")).otherwise(lost)
    grouped = grouped.select("conv_id", "formatted", turns.alias("turns"))
    spans = F.transform(F.filter("turns", lambda t: t["role"] == answers), lambda t: F.struct(t["start"].alias("start"), t["end"].alias("end")))
    return grouped.withColumn("loss_spans", spans)


def under_mask(formatted: Column, spans: Column) -> Column:
    """The unescaped text inside the spans, one span after the other."""
    level = F.substring(formatted, 7, 1).cast("int")
    whole = F.struct(formatted.alias("f"), level.alias("level"))
    texts = F.transform(F.array(whole), lambda w: F.transform(spans, lambda s: _unescape(F.substr(w["f"], s["start"] + 1, s["end"] - s["start"]), w["level"])))[0]
    return F.array_join(texts, "")
