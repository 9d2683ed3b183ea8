"""Operator 10: chat formatting with a grammar round trip (DataFrame functions only).

The template of a conversation is, for each turn in order::

    ### Role: text</turn>\\n

with the role's first letter in upper case in the header only if that is reversible (it is a lower-case a-z letter;
other roles are written between brackets as they are). Texts are first written raw; the rendering of the turn is parsed
again by the same deterministic parser that reads the output, and where the recovered turn differs from its source, or
its text holds an opening mark, the turn is written with its control characters escaped: backslash, ``#`` and ``<`` become ``\\\\s``, ``\\\\h``, ``\\\\l``.
Then the whole conversation is parsed, and if a turn still differs (texts that conflict only together) all its turns are
escaped. Escaped text holds no control string, so that form always returns its source.

Parser: split at ``</turn>\\n``, drop the empty rest, take the role up to the first ``: ``, unescape the rest.

Defined cases: null text and null role are empty; a turn's place is (turn, role, text), null turns first; repeated rows
are turns of their own; a null conv_id is a conversation of its own; an empty table gives an empty table; extra columns
are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import let

OPEN, COLON, CLOSE = "### ", ": ", "</turn>\n"
ESCAPES = (("\\", "\\s"), ("#", "\\h"), ("<", "\\l"))


def escape(text: Column) -> Column:
    for plain, code in ESCAPES:
        text = F.replace(text, F.lit(plain), F.lit(code))
    return text


def unescape(text: Column) -> Column:
    """Every backslash of an escaped text starts a code, so codes of # and < can't arise from others; backslashes go last."""
    for plain, code in reversed(ESCAPES):
        text = F.replace(text, F.lit(code), F.lit(plain))
    return text


def header(role: Column) -> Column:
    shown = F.when(role.rlike("^[a-z][a-z_]*$"), F.concat(F.upper(F.substring(role, 1, 1)), F.substring(role, F.lit(2), F.length(role))))
    return F.concat(F.lit(OPEN), shown.otherwise(F.concat(F.lit("["), F.replace(escape(role), F.lit(":"), F.lit("\\c")), F.lit("]"))), F.lit(COLON))


def _role(shown: Column) -> Column:
    inner = F.substring(shown, F.lit(2), F.length(shown) - 2)
    lower = F.concat(F.lower(F.substring(shown, 1, 1)), F.substring(shown, F.lit(2), F.length(shown)))
    return F.when(shown.startswith("["), unescape(F.replace(inner, F.lit("\\c"), F.lit(":")))).otherwise(lower)


def parse(rendered: Column) -> Column:
    """An array of (role, text) from rendered text; pieces that are no turns give null fields."""
    pieces = F.split(rendered, F.lit("</turn>"), F.lit(-1))

    def turn(part: Column, i: Column) -> Column:
        return let(F.when((i > 0) & part.startswith("\n"), F.substring(part, F.lit(2), F.length(part))).otherwise(part), fields)

    def fields(piece: Column) -> Column:
        at = F.instr(piece, COLON)
        opened = piece.startswith(OPEN) & (at > len(OPEN))
        role = _role(F.substring(piece, F.lit(len(OPEN) + 1), at - (len(OPEN) + 1)))
        text = unescape(F.substring(piece, at + len(COLON), F.length(piece)))
        return F.struct(F.when(opened, role).alias("role"), F.when(opened, text).alias("text"))

    return let(pieces, lambda p: F.transform(F.slice(p, F.lit(1), F.size(p) - 1), turn))


def _turn(role: Column, text: Column) -> Column:
    return F.concat(header(role), text, F.lit(CLOSE))


def render(turns: Column) -> Column:
    """One string from an array of (role, text) without nulls."""

    def shortest(t: Column) -> Column:
        raw = _turn(t["role"], t["text"])
        control = t["text"].contains("\\") | t["text"].contains("<") | t["text"].contains("#")
        # only texts with a control character can fail the turn's own round trip
        same = let(parse(raw), lambda got: (F.size(got) == 1) & F.coalesce((F.get(got, F.lit(0))["role"] == t["role"]) & (F.get(got, F.lit(0))["text"] == t["text"]), F.lit(False)))
        return F.when(~control, raw).when(same & ~t["text"].contains(OPEN), raw).otherwise(_turn(t["role"], escape(t["text"])))

    first = F.concat_ws("", F.transform(turns, shortest))
    safe = F.concat_ws("", F.transform(turns, lambda t: _turn(t["role"], escape(t["text"]))))
    return let(first, lambda r: F.when(parse(r) == turns, r).otherwise(safe))


def format_chats(conversations: DataFrame) -> DataFrame:
    """conv_id and formatted, a row for each conversation."""
    turn = F.struct(F.col("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    turns = conversations.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    plain = F.transform("turns", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text")))
    return turns.select("conv_id", plain.alias("turns")).select("conv_id", render(F.col("turns")).alias("formatted"))


def read_back(formatted: DataFrame) -> DataFrame:
    """The contract's columns, from nothing but the formatted text. The loss mask covers the texts of assistant turns."""
    read = formatted.withColumn("turns", parse(F.col("formatted")))
    said = F.concat_ws("", F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))))
    loss = F.concat_ws("", F.transform(F.filter("turns", lambda t: t["role"] == "assistant"), lambda t: t["text"]))
    return read.select("conv_id", F.size("turns").cast("long").alias("n_turns"), said.alias("said"), loss.alias("loss"), "formatted").select(
        "conv_id", "n_turns", F.sha2(F.col("said"), 256).alias("turns_sha256"), F.length("loss").cast("long").alias("loss_chars"), F.sha2(F.col("loss"), 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars")
    )


def planted(spark: SparkSession) -> DataFrame:
    """Conversation -7, whose texts hold the template's own control strings."""
    said = r"\### Assistant: </turn> ok"
    row = lambda i, role: F.struct(F.lit(-7).cast("long").alias("conv_id"), F.lit(i).cast("long").alias("turn"), F.lit(role).alias("role"), F.lit(said).alias("text"))
    return spark.range(1).select(F.explode(F.array(row(0, "user"), row(1, "assistant"))).alias("r")).select("r.*")
