"""Chat formatting with a grammar round trip, in built-in functions only.

    conversation = turn*
    turn         = START role "\\n" body END "\\n"

Role and body hold no bare control string. A control string inside a text gets one more backslash
after its "<"; reading takes one away, so texts that already look escaped come back too. A turn is
rendered as it is, parsed and compared with its source; what differs is escaped and must then agree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

START, END, BREAK = "<|im_start|>", "<|im_end|>", "<|im_nl|>"
NAMES = "im_start|im_end|im_nl"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, rf"<(\\*)\|({NAMES})\|>", r"<\\$1|$2|>")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, rf"<\\(\\*)\|({NAMES})\|>", r"<$1|$2|>")


def escape_role(role: Column) -> Column:
    """A role also ends its line, so a line break in it becomes a control string of its own."""
    return F.replace(escape(role), F.lit("\n"), F.lit(BREAK))


def parse(rendered: Column) -> Column:
    """Turns of a formatted text as array<struct<role, text>>; null for a turn that breaks the grammar."""

    def turn(part: Column) -> Column:
        role = F.substring_index(part, "\n", 1)
        rest = F.substr(part, F.length(role) + 2)
        body = F.substr(rest, F.lit(1), F.length(rest) - len(END) - 1)
        good = part.contains("\n") & rest.endswith(END + "\n") & ~body.rlike(rf"<\|({NAMES})\|>") & ~F.replace(role, F.lit(BREAK), F.lit("")).rlike(rf"<\|({NAMES})\|>")
        return F.when(good, F.struct(unescape(F.replace(role, F.lit(BREAK), F.lit("\n"))).alias("role"), unescape(body).alias("text")))

    parts = F.split(rendered, r"<\|im_start\|>", -1)
    return F.when(F.element_at(parts, 1) == "", F.transform(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))), turn))


def render(role: Column, text: Column) -> Column:
    return F.concat(F.lit(START), role, F.lit("\n"), text, F.lit(END + "\n"))


def format_chats(turns: DataFrame, id_column: str = "conv_id", turn_column: str = "turn", role_column: str = "role", text_column: str = "text") -> DataFrame:
    """(conv_id, n_source, formatted, turns, loss_mask): one text per conversation and where assistants speak.

    ``loss_mask`` holds (start, length) in code points of ``formatted``, from 0, and ``turns`` where each turn
    begins, with its part of the mask. Null text or role counts as empty; turns are ordered by turn, then role, then text, nulls first,
    and repeated turns all stay. Rows without an id make one conversation with a null id. Other columns are
    ignored. An empty table gives no rows. A turn that no escaping brings back ends the job with an error.
    A conversation of any length is one text, and the work is linear in it.
    """
    rows = turns.select(
        F.col(id_column).alias("conv_id"), F.col(turn_column).alias("turn"), F.coalesce(F.col(role_column).cast("string"), F.lit("")).alias("role"), F.coalesce(F.col(text_column).cast("string"), F.lit("")).alias("text")
    )
    same = lambda rendered: F.coalesce(parse(rendered) == F.array(F.struct("role", "text")), F.lit(False))
    plain, escaped = render(F.col("role"), F.col("text")), render(escape_role(F.col("role")), escape(F.col("text")))
    rows = rows.withColumn("out", F.when(same(plain), plain).when(same(escaped), escaped).otherwise(F.raise_error(F.lit("a turn can't be rendered reversibly"))))
    order = W.partitionBy("conv_id").orderBy("turn", "role", "text")
    before = F.coalesce(F.sum(F.length("out")).over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).cast("long")
    rows = rows.withColumn("before", before).withColumn("place", F.row_number().over(order))
    head = F.length(F.substring_index("out", "\n", 1)) + 1
    span = F.when(F.col("role") == "assistant", F.struct((F.col("before") + head).alias("start"), (F.length("out") - head - len(END) - 1).cast("long").alias("length")))
    rows = rows.select("conv_id", F.struct("place", "out", "before", span.alias("span")).alias("t"))
    out = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("t"))
    return out.select(
        "conv_id",
        F.size("t").cast("long").alias("n_source"),
        F.array_join(F.transform("t", lambda x: x["out"]), "").alias("formatted"),
        F.transform("t", lambda x: F.struct(x["before"].alias("at"), x["span"].alias("span"))).alias("turns"),
        F.filter(F.transform("t", lambda x: x["span"]), lambda x: x.isNotNull()).alias("loss_mask"),
    )


def masked(formatted: Column, turns: Column) -> Column:
    """All text under the mask, unescaped and put together. Each span is read from its own turn, so that none is
    counted off from the beginning of the conversation."""
    parts = F.split(formatted, r"<\|im_start\|>", -1)
    read = lambda part, t: F.substr(part, (t["span"]["start"] - t["at"] - len(START) + 1).cast("int"), t["span"]["length"].cast("int"))
    said = F.zip_with(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))), turns, lambda part, t: F.when(t["span"].isNotNull(), unescape(read(part, t))).otherwise(""))
    return F.array_join(said, "")


def digest(formatted: DataFrame) -> DataFrame:
    """What is read back from the formatted texts and their masks."""
    back = formatted.select("conv_id", "formatted", parse(F.col("formatted")).alias("turns"), masked(F.col("formatted"), F.col("turns")).alias("loss"))
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "").cast("binary"), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
