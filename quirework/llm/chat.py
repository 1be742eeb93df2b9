r"""Chat formatting with a grammar round trip.

A turn is written ``<|im_start|>role\ntext<|im_end|>\n``. Texts may hold the same control
strings, so every turn is reparsed by the deterministic grammar right after rendering. If
the parser does not give back the source, the conflicting content is escaped one level
further: first the text, then also the role. The escape puts one more backslash between
``<`` and ``|`` wherever only backslashes stand between them; in a role, ``%`` and line breaks
become ``%25`` and ``%0A``. The parser undoes both, so level 2 is always identical.

A conversation is one value, as a document is: the grammar reads it from start to end.

Defined results: null role and text count as empty; turns are ordered by turn (null
first), then role and text; repeated rows are separate turns; rows with a null
conversation id form one conversation; further columns are ignored; no rows give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>"
#: Between the marks no ``<|`` may stand: the grammar has one reading at most.
TURN = r"(?s)<\|im_start\|>([^<\n]*+(?:<(?!\|)[^<\n]*+)*+)\n([^<]*+(?:<(?!\|)[^<]*+)*+)<\|im_end\|>\n"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<$1\\|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\\\|", r"<$1|")


def escape_role(role: Column) -> Column:
    return escape(F.replace(F.replace(role, F.lit("%"), F.lit("%25")), F.lit("\n"), F.lit("%0A")))


def unescape_role(role: Column) -> Column:
    return F.replace(F.replace(unescape(role), F.lit("%0A"), F.lit("\n")), F.lit("%25"), F.lit("%"))


def written(role: Column, text: Column) -> Column:
    return F.concat(F.lit(START), role, F.lit("\n"), text, F.lit(END + "\n"))


def parses_to(turn: Column, role: Column, text: Column) -> Column:
    """Does the grammar read the rendered turn as this one turn, to its last character?"""
    found = lambda group: F.regexp_extract(turn, TURN, group)
    return (found(0) == turn) & (unescape_role(found(1)) == role) & (unescape(found(2)) == text)


def rendered(role: Column, text: Column) -> Column:
    """The turn at the lowest escape level that survives the round trip."""
    levels = [written(role, text), written(role, escape(text)), written(escape_role(role), escape(text))]
    return F.when(parses_to(levels[0], role, text), levels[0]).when(
        parses_to(levels[1], role, text), levels[1]
    ).otherwise(levels[2])


def format_turns(turns: DataFrame) -> DataFrame:
    """Turns (conv_id, turn, role, text) to conversations (conv_id, formatted)."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    return (
        turns.select("conv_id", F.struct(F.col("turn"), role.alias("role"), text.alias("text"), rendered(role, text).alias("turn_text")).alias("t"))
        .groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("ts"))
        .select("conv_id", F.array_join(F.col("ts.turn_text"), "").alias("formatted"))
    )


def parse(formatted: Column) -> Column:
    """Array of (role, text, start, length): the turns read back from a formatted text.
    ``start`` (from 0) and ``length`` give the still escaped text's place in code points."""
    whole, roles, texts = (F.regexp_extract_all(formatted, F.lit(TURN), F.lit(g)) for g in (0, 1, 2))
    raw = F.arrays_zip(whole.alias("whole"), roles.alias("role"), texts.alias("text"))
    at = F.struct(F.lit(0).alias("end"), F.array().cast("array<struct<role:string,text:string,start:int,length:int>>").alias("turns"))

    def take(done: Column, t: Column) -> Column:
        start = done["end"] + F.length(F.lit(START)) + F.length(t["role"]) + 1
        turn = F.struct(
            unescape_role(t["role"]).alias("role"), unescape(t["text"]).alias("text"), start.alias("start"),
            F.length(t["text"]).alias("length"),
        )
        return F.struct((done["end"] + F.length(t["whole"])).alias("end"), F.concat(done["turns"], F.array(turn)).alias("turns"))

    return F.aggregate(raw, at, take, lambda done: done["turns"])


def loss_spans(turns: Column, role: str = "assistant") -> Column:
    """The loss mask: (start, length) of every text of ``role`` in the formatted text."""
    return F.transform(F.filter(turns, lambda t: t["role"] == role), lambda t: F.struct(t["start"], t["length"]))


def masked_text(formatted: Column, spans: Column) -> Column:
    """The unescaped text under the mask."""
    return F.array_join(F.transform(spans, lambda s: unescape(F.substring(formatted, s["start"] + 1, s["length"]))), "")


def read_back(conversations: DataFrame) -> DataFrame:
    """Formatted conversations with their turns and loss spans, from the output alone."""
    return conversations.withColumn("turns", parse(F.col("formatted"))).withColumn("loss", loss_spans(F.col("turns")))
