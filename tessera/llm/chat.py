"""Chat formatting by grammar round trip, in DataFrame functions alone.

    conversation := turn*
    turn         := "<|im_start|>" role [" %"] "\\n" text "<|im_end|>\\n"

A rendered turn is reparsed by a deterministic parser and compared with its source. Where they differ the
text holds something that reads as control: it is escaped and its header marked by " %". A conversation
is then rendered, reparsed and compared as a whole; one that still differs is escaped throughout.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, END, CONTROL, MARKED = "<|im_start|>", "<|im_end|>", "<|", " %"
#: Texts: reversible, and no "<|" is left. In this order; undone in the other.
_TEXT = (("&", "&amp;"), (CONTROL, "&lt;|"))
#: Roles: no white space, control string or mark is left.
_ROLE = (("%", "%25"), ("\n", "%0A"), (" ", "%20"), ("<", "%3C"))


def _replaced(value: Column, pairs: tuple[tuple[str, str], ...]) -> Column:
    for old, new in pairs:
        value = F.replace(value, F.lit(old), F.lit(new))
    return value


def escaped(text: Column) -> Column:
    return _replaced(text, _TEXT)


def unescaped(text: Column) -> Column:
    return _replaced(text, tuple((new, old) for old, new in reversed(_TEXT)))


def render(role: Column, text: Column, mark: Column) -> Column:
    """One turn; `mark`: whether its text is escaped."""
    header = F.concat(F.lit(START), _replaced(role, _ROLE), F.when(mark, MARKED).otherwise(""), F.lit("\n"))
    return F.concat(header, F.when(mark, escaped(text)).otherwise(text), F.lit(END + "\n"))


def _literal(control: str) -> str:
    return control.replace("|", r"\|")


def parse(formatted: Column) -> Column:
    """Turns of a formatted string: structs of role, text, body (as it stands there) and marked.

    Every control string cuts, wherever it stands, and a text with a rest of one is null: text that was not
    written by `render` from harmless turns does not come back as it was.
    """
    pieces = F.split(formatted, _literal(END), -1)
    closed = F.slice(pieces, 1, F.size(pieces) - 1)

    def turns_of(piece: Column) -> Column:
        parts = F.split(piece, _literal(START), -1)
        return F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0)))

    def turn(part: Column) -> Column:
        header = F.substring_index(part, "\n", 1)
        body = F.substr(part, F.length(header) + 2)
        marked = F.endswith(header, F.lit(MARKED))
        role = F.when(marked, F.substr(header, F.lit(1), F.length(header) - len(MARKED))).otherwise(header)
        role = _replaced(role, tuple((new, old) for old, new in reversed(_ROLE)))
        text = F.when(F.contains(body, F.lit(CONTROL)), F.lit(None)).when(marked, unescaped(body)).otherwise(body)
        return F.struct(role.alias("role"), text.alias("text"), body.alias("body"), marked.alias("marked"), F.length(header).alias("header_chars"))

    return F.transform(F.flatten(F.transform(closed, turns_of)), turn)


def _source_of(turns: Column) -> Column:
    return F.transform(turns, lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text")))


def format_conversations(conversations: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, formatted, turns, loss_spans, level): one row for each conversation.

    `turns` are read back from `formatted`; `loss_spans` are the assistant's texts in it, as structs of first code
    point and count. level: 0 if nothing was escaped, 1 if single turns, 2 if all. Rows go by turn (null last),
    then role and text; repeated rows are turns of their own. A null text or role is empty. A null conv_id
    is one conversation. A conversation is one value, so its turns meet in one task: it must fit in a string.
    """
    own = conversations.select(
        F.col(conv_id).alias("conv_id"),
        F.col(turn).alias("turn"),
        F.coalesce(F.col(role), F.lit("")).alias("role"),
        F.coalesce(F.col(text), F.lit("")).alias("text"),
    )
    alone = _source_of(parse(render(F.col("role"), F.col("text"), F.lit(False))))
    same = F.coalesce(alone == F.array(F.struct("role", "text")), F.lit(False))
    own = own.withColumn("mark", ~same)
    order = F.struct(F.col("turn").isNull().alias("late"), "turn", "role", "text", "mark")
    grouped = own.groupBy("conv_id").agg(F.array_sort(F.collect_list(order)).alias("source"))
    joined = lambda mark: F.array_join(F.transform("source", lambda t: render(t["role"], t["text"], mark(t))), "")
    first = grouped.withColumn("formatted", joined(lambda t: t["mark"]))
    first = first.withColumn("identical", F.coalesce(_source_of(parse(F.col("formatted"))) == _source_of(F.col("source")), F.lit(False)))
    level = F.when(~F.col("identical"), 2).when(F.exists("source", lambda t: t["mark"]), 1).otherwise(0)
    final = first.select("conv_id", level.alias("level"), F.when(F.col("identical"), F.col("formatted")).otherwise(joined(lambda t: F.lit(True))).alias("formatted"))
    read = final.withColumn("turns", parse(F.col("formatted")))
    nothing = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start:bigint,chars:bigint>>").alias("spans"))

    def advance(state: Column, t: Column) -> Column:
        begin = (state["at"] + F.lit(len(START) + 1) + t["header_chars"]).cast("long")
        chars = F.length(t["body"]).cast("long")
        span = F.array(F.struct(begin.alias("start"), chars.alias("chars")))
        spans = F.when(t["role"] == "assistant", F.concat(state["spans"], span)).otherwise(state["spans"])
        return F.struct((begin + chars + len(END) + 1).alias("at"), spans.alias("spans"))

    spans = F.aggregate("turns", nothing, advance, lambda s: s["spans"])
    return read.select("conv_id", "formatted", F.transform("turns", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"), t["marked"].alias("marked"))).alias("turns"), spans.alias("loss_spans"), "level")


def masked_text(formatted: Column, turns: Column, loss_spans: Column) -> Column:
    """All text under the loss mask, unescaped, in order."""
    assistant = F.filter(turns, lambda t: t["role"] == "assistant")
    cut = F.transform(loss_spans, lambda s: F.substr(formatted, (s["start"] + 1).cast("int"), s["chars"].cast("int")))
    return F.array_join(F.zip_with(cut, assistant, lambda body, t: F.when(t["marked"], unescaped(body)).otherwise(body)), "")
