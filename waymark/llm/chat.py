r"""Chat formatting: heterogeneous records to canonical turns to one marked-up text with a loss mask.

Records are VARIANT values. The nested field paths of a record (types dropped)
are hashed to a fingerprint, which selects one declarative mapping; a record
of unknown layout gets a null mapping and null turns and stays in the output;
by_layout() returns such records apart.

Template, per turn: ``<turn>`` role ``<text>`` text ``</turn>`` newline. In
roles and texts ``\``, ``<`` and ``#`` are written ``\b``, ``\l`` and ``\h``,
so no marker or heading can occur inside them, and reading back is exact.

Everything is built-in column functions. Defined cases: null text or role is
empty; turns with equal numbers are ordered by role, then text; a conversation
without rows does not exist; columns beside those named are not read. The text
of one conversation is one value, so a conversation must fit one row.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import let, table

TURN, TEXT, END = "<turn>", "<text>", "</turn>\n"
ESCAPES = (("\\", "\\b"), ("<", "\\l"), ("#", "\\h"))


@dataclass(frozen=True)
class Mapping:
    """How one layout becomes turns.

    examples: JSON records whose field paths select this mapping.
    list_path, role, text: path of an array of turns and the fields in it; or
    fields: (role, path, ...) for single values; several paths are joined by a blank line.
    roles: names used in the layout, to canonical ones.
    """

    name: str
    examples: Sequence[str]
    list_path: str = ""
    role: str = ""
    text: str = ""
    fields: Sequence[tuple[str, ...]] = ()
    roles: Sequence[tuple[str, str]] = ()


MAPPINGS = (
    Mapping("messages", ('{"messages":[{"role":"","content":""}]}', '{"messages":[]}'), "$.messages", "role", "content"),
    Mapping("conversations", ('{"conversations":[{"from":"","value":""}]}', '{"conversations":[]}'), "$.conversations", "from", "value", roles=(("human", "user"), ("gpt", "assistant"), ("bot", "assistant"))),
    Mapping("instruction", ('{"instruction":"","input":"","output":""}',), fields=(("user", "$.instruction", "$.input"), ("assistant", "$.output"))),
    Mapping("instruction_only", ('{"instruction":"","output":""}',), fields=(("user", "$.instruction"), ("assistant", "$.output"))),
    Mapping("prompt_completion", ('{"prompt":"","completion":""}',), fields=(("user", "$.prompt"), ("assistant", "$.completion"))),
    Mapping("prompt_response", ('{"prompt":"","response":""}', '{"system":"","prompt":"","response":""}'), fields=(("system", "$.system"), ("user", "$.prompt"), ("assistant", "$.response"))),
    Mapping("question_answer", ('{"question":"","answer":""}',), fields=(("user", "$.question"), ("assistant", "$.answer"))),
)


def fingerprint(record: Column) -> Column:
    """Hash of the record's nested field paths; order and types of fields don't matter."""
    paths = F.regexp_replace(F.schema_of_variant(record), r"([:<]) ?[A-Z_]+(?:\([0-9, ]*\))?(?=[,>]|$)", "$1*")
    return F.sha2(paths, 256)


def _turns(record: Column, m: Mapping) -> Column:
    turn = "struct<role:string,text:string>"
    if m.list_path:
        rows = F.try_variant_get(record, m.list_path, f"array<struct<`{m.role}`:string,`{m.text}`:string>>")
        named = F.create_map(*[F.lit(x) for pair in m.roles for x in pair]) if m.roles else None

        def one(x: Column) -> Column:
            role = F.coalesce(x[m.role], F.lit(""))
            return F.struct((F.coalesce(named[role], role) if named is not None else role).alias("role"), F.coalesce(x[m.text], F.lit("")).alias("text"))

        return F.transform(rows, one)
    made = [
        F.struct(F.lit(role).alias("role"), F.concat_ws("\n\n", *[F.when(v != "", v) for v in [F.try_variant_get(record, p, "string") for p in paths]]).alias("text"), F.coalesce(*[F.try_variant_get(record, p, "string") for p in paths]).isNotNull().alias("there"))
        for role, *paths in m.fields
    ]
    return F.transform(F.filter(F.array(*made), lambda x: x["there"]), lambda x: F.struct(x["role"], x["text"])).cast(f"array<{turn}>")


def canonical_turns(df: DataFrame, record_col: str, mappings: Sequence[Mapping] = MAPPINGS) -> DataFrame:
    """df with its columns, ``mapping`` and ``turns`` (array of role, text); columns of these names give way."""
    print_ = fingerprint(F.col(record_col))
    name: Column = F.lit(None).cast("string")
    for m in reversed(mappings):
        known = [fingerprint(F.parse_json(F.lit(x))) for x in m.examples]
        name = F.when(print_.isin(known), F.lit(m.name)).otherwise(name)
    df = df.withColumn("mapping", name)
    turns: Column = F.lit(None).cast("array<struct<role:string,text:string>>")
    for m in mappings:
        turns = F.when(F.col("mapping") == m.name, _turns(F.col(record_col), m)).otherwise(turns)
    return df.withColumn("turns", turns)


def by_layout(df: DataFrame, record_col: str, mappings: Sequence[Mapping] = MAPPINGS) -> tuple[DataFrame, DataFrame]:
    """canonical_turns() of the records of known layouts, and those of unknown ones apart, with their field paths as ``layout``: no record is formatted as nothing."""
    told = canonical_turns(df, record_col, mappings)
    unknown = told.where("mapping IS NULL").drop("mapping", "turns").withColumn("layout", F.schema_of_variant(F.col(record_col)))
    return told.where("mapping IS NOT NULL"), unknown


def escape(text: Column) -> Column:
    for a, b in ESCAPES:
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def unescape(text: Column) -> Column:
    for a, b in reversed(ESCAPES):
        text = F.replace(text, F.lit(b), F.lit(a))
    return text


def format_turns(turns: Column) -> Column:
    """The marked-up text of an array of turns."""
    return F.array_join(F.transform(turns, lambda t: F.concat(F.lit(TURN), escape(t["role"]), F.lit(TEXT), escape(t["text"]), F.lit(END))), "")


def loss_spans(turns: Column, learn: str = "assistant") -> Column:
    """(start, end) in code points of the texts to learn in the formatted text."""
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start:bigint,end:bigint>>").alias("spans"))

    def step(acc: Column, t: Column) -> Column:
        a = (acc["at"] + len(TURN) + len(TEXT) + F.length(escape(t["role"]))).cast("long")
        b = (a + F.length(escape(t["text"]))).cast("long")
        span = F.array(F.struct(a.alias("start"), b.alias("end")))
        return F.struct((b + len(END)).alias("at"), F.when(t["role"] == learn, F.concat(acc["spans"], span)).otherwise(acc["spans"]).alias("spans"))

    return F.aggregate(turns, start, step, lambda acc: acc["spans"])


def read_turns(formatted: Column) -> Column:
    """Turns read back from a formatted text."""
    pieces = F.filter(F.split(formatted, "</turn>\n"), lambda p: p != "")

    def one(p: Column) -> Column:
        return F.struct(
            unescape(F.substring_index(F.substr(p, F.lit(len(TURN) + 1)), TEXT, 1)).alias("role"),
            unescape(F.substring_index(p, TEXT, -1)).alias("text"),
        )

    return F.transform(pieces, one)


def conversation_records(rows: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One VARIANT record for each conversation of a table of turns, in the layout that is usual for its kind.

    A user's text and the assistant's answer are a prompt and a response; longer
    exchanges of these two are a list of who said what; all others, such as
    those with null texts or other roles, are a list of messages.
    """
    turn = F.struct(F.col(f"`{turn_col}`").alias("turn"), F.col(f"`{role_col}`").cast("string").alias("role"), F.col(f"`{text_col}`").cast("string").alias("content"))
    grouped = rows.groupBy(F.col(f"`{id_col}`").alias("conv_id")).agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    messages = F.transform("turns", lambda t: F.struct(t["role"].alias("role"), t["content"].alias("content")))
    said = F.transform("turns", lambda t: F.struct(F.when(t["role"] == "user", "human").otherwise("gpt").alias("from"), t["content"].alias("value")))
    plain = F.forall("turns", lambda t: F.coalesce(t["role"].isin("user", "assistant"), F.lit(False)) & t["content"].isNotNull())
    pair = plain & (F.size("turns") == 2) & (F.get("turns", F.lit(0))["role"] == "user") & (F.get("turns", F.lit(1))["role"] == "assistant")
    asked = F.struct(F.get("turns", F.lit(0))["content"].alias("prompt"), F.get("turns", F.lit(1))["content"].alias("response"))
    record = (
        F.when(pair, F.to_variant_object(asked)).when(plain, F.to_variant_object(F.struct(said.alias("conversations")))).otherwise(F.to_variant_object(F.struct(messages.alias("messages"))))
    )
    return grouped.select("conv_id", record.alias("record"))


def format_chats(records: DataFrame, record_col: str = "record", mappings: Sequence[Mapping] = MAPPINGS) -> DataFrame:
    """records with mapping, turns, the formatted text and the loss mask's spans; columns of these names give way."""
    return canonical_turns(records, record_col, mappings).withColumns({"formatted": format_turns(F.col("turns")), "loss": loss_spans(F.col("turns"))})


#: A conversation that only contains control strings and escapes.
CONTROL_TEXT = "\\### Assistant: </turn> ok"


def op5_format_chats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of every conversation, read back from its formatted text."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(CONTROL_TEXT).alias("text"))
    made = format_chats(conversation_records(rows.unionByName(extra)))
    lost = F.array_join(F.transform("loss", lambda s: unescape(F.substr("formatted", s["start"].cast("int") + 1, (s["end"] - s["start"]).cast("int")))), "")
    read = made.select("conv_id", read_turns(F.col("formatted")).alias("back"), lost.alias("lost"), F.length("formatted").cast("long").alias("formatted_chars"))
    turns = F.array_join(F.transform("back", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id", F.size("back").cast("long").alias("n_turns"), F.sha2(turns, 256).alias("turns_sha256"),
        F.length("lost").cast("long").alias("loss_chars"), F.sha2("lost", 256).alias("loss_sha256"), "formatted_chars",
    )


OP5_SQL = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text, role AS r0, text AS t0 FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok', 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok', 'assistant', '\### Assistant: </turn> ok'),
g AS (
  SELECT conv_id, count(*) AS n_turns,
         string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, r0 NULLS FIRST, t0 NULLS FIRST) AS turns,
         coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, r0 NULLS FIRST, t0 NULLS FIRST) FILTER (WHERE role = 'assistant'), '') AS lost,
         sum(20 + length(replace(replace(replace(role, '\', '\b'), '<', '\l'), '#', '\h')) + length(replace(replace(replace(text, '\', '\b'), '<', '\l'), '#', '\h'))) AS formatted_chars
  FROM c GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(turns) AS turns_sha256, CAST(length(lost) AS BIGINT) AS loss_chars, sha256(lost) AS loss_sha256,
       CAST(formatted_chars AS BIGINT) AS formatted_chars
FROM g
"""
