"""Chat formatting by schema fingerprints (operator 3), DataFrame functions only.

A record's layout is known by the hash of its sorted nested field paths. ``LAYOUTS`` maps each known set of
paths to a declarative mapping, a Column expression that yields canonical turns array<struct<role,text>>.
Struct columns are fingerprinted once by their schema; JSON strings row by row. ``render`` writes turns in
a template whose control strings are escaped inside texts, and keeps the loss mask as the rendered segments
with a flag each. ``read_turns`` and ``read_loss`` invert it.

Defined results: null roles and texts count as empty; null or empty conversations render to an empty
string; JSON of an unknown layout, or none, gives null turns; turns with equal numbers are ordered by role
and text; repeated rows are kept; a null turn number comes first; an empty table gives an empty table; columns named
like those that are added (the turns column of ``canonical``, ``segments`` and ``formatted``) are replaced, and other columns
are passed on."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import read_table

TURNS = "array<struct<role:string,text:string>>"
#: Control strings: a turn opens with OPEN, its role and SEP, and ends with CLOSE and a line feed.
OPEN, SEP, CLOSE = "### ", ": ", "</turn>"
#: A text's own control strings, and the backslash first, by their escapes.
TEXT_ESCAPES = (("\\", "\\b"), ("###", "\\h"), (CLOSE, "\\t"))
ROLE_ESCAPES = (*TEXT_ESCAPES, (":", "\\c"))


def turn(role: Column, text: Column) -> Column:
    return F.struct(F.coalesce(role, F.lit("")).alias("role"), F.coalesce(text, F.lit("")).alias("text"))


def listed(field: str, role: str, text: str) -> Callable[[Column], Column]:
    return lambda c: F.transform(c[field], lambda m: turn(m[role], m[text]))


def fields(*pairs: tuple[str, str]) -> Callable[[Column], Column]:
    """Fixed fields as turns; a null field gives no turn."""
    return lambda c: F.filter(F.array(*[F.when(c[f].isNotNull(), turn(F.lit(role), c[f])) for role, f in pairs]), lambda t: t.isNotNull())


def instruction(c: Column) -> Column:
    asked = F.concat(F.coalesce(c["instruction"], F.lit("")), F.when(F.length(c["input"]) > 0, F.concat(F.lit("\n\n"), c["input"])).otherwise(F.lit("")))
    return F.array(turn(F.lit("user"), asked), turn(F.lit("assistant"), c["output"]))


#: Layout name: its schema and the mapping to canonical turns.
LAYOUTS: dict[str, tuple[str, Callable[[Column], Column]]] = {
    "turns": ("turns array<struct<role string, text string>>", listed("turns", "role", "text")),
    "messages": ("messages array<struct<role string, content string>>", listed("messages", "role", "content")),
    "dialogue": ("conversations array<struct<`from` string, value string>>", listed("conversations", "from", "value")),
    "prompt": ("prompt string, response string", fields(("user", "prompt"), ("assistant", "response"))),
    "completion": ("prompt string, completion string", fields(("user", "prompt"), ("assistant", "completion"))),
    "system prompt": ("system string, prompt string, response string", fields(("system", "system"), ("user", "prompt"), ("assistant", "response"))),
    "instruction": ("instruction string, input string, output string", instruction),
    "question": ("question string, answer string", fields(("user", "question"), ("assistant", "answer"))),
}


def paths(schema: T.DataType, at: str = "") -> list[str]:
    """The nested field paths of a type; ``[]`` marks the elements of an array."""
    if isinstance(schema, T.StructType):
        return sorted(p for f in schema.fields for p in paths(f.dataType, f"{at}.{f.name}" if at else f.name))
    if isinstance(schema, T.ArrayType):
        return paths(schema.elementType, f"{at}[]")
    return [at]


def digest_of(names: list[str]) -> str:
    return hashlib.sha256("\n".join(sorted(names)).encode()).hexdigest()


def schema_of(layout: str) -> T.StructType:
    return T.StructType.fromDDL(LAYOUTS[layout][0])


def fingerprints() -> dict[str, str]:
    """Fingerprint: layout."""
    return {digest_of(paths(schema_of(name))): name for name in LAYOUTS}


def json_fingerprint(text: Column) -> Column:
    """The fingerprint of a JSON object by its keys and those of the first element of each array in it."""
    own = F.json_object_keys(text)
    nested = lambda k: F.json_object_keys(F.call_function("get_json_object", text, F.concat(F.lit("$."), k, F.lit("[0]"))))
    named = F.flatten(F.transform(own, lambda k: F.coalesce(F.transform(nested(k), lambda x: F.concat(k, F.lit("[]."), x)), F.array(k))))
    return F.sha2(F.array_join(F.array_sort(named), "\n"), 256)


def canonical(df: DataFrame, record_col: str, out_col: str = "turns") -> DataFrame:
    """``df`` with ``out_col``: the turns of a struct column (layout by its schema; an unknown one raises)
    or of JSON strings (layout row by row; unknown gives null)."""
    kind, known = df.schema[record_col].dataType, fingerprints()
    record = F.col(f"`{record_col}`")
    if isinstance(kind, T.StructType):
        name = known.get(digest_of(paths(kind)))
        if name is None:
            raise ValueError(f"no layout has the field paths {paths(kind)}")
        return df.withColumn(out_col, LAYOUTS[name][1](record).cast(TURNS))
    mark, chosen = json_fingerprint(record), None
    for code, name in known.items():
        turns = LAYOUTS[name][1](F.from_json(record, schema_of(name))).cast(TURNS)
        chosen = F.when(mark == code, turns) if chosen is None else chosen.when(mark == code, turns)
    return df.withColumn(out_col, chosen)


def escape(text: Column, table: tuple = TEXT_ESCAPES) -> Column:
    for plain, coded in table:
        text = F.replace(text, F.lit(plain), F.lit(coded))
    return text


def unescape(text: Column, table: tuple = TEXT_ESCAPES) -> Column:
    for plain, coded in reversed(table):
        text = F.replace(text, F.lit(coded), F.lit(plain))
    return text


def render(df: DataFrame, turns_col: str = "turns", learn: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """``df`` with ``segments`` array<struct<text,loss>>, pieces of the rendered conversation with the loss
    mask over exactly the texts of the roles in ``learn``, and ``formatted``, the pieces joined."""
    piece = lambda text, loss: F.struct(text.alias("text"), loss.alias("loss"))
    off = F.lit(False)

    def pieces(t: Column) -> Column:
        return F.array(
            piece(F.concat(F.lit(OPEN), escape(F.coalesce(t["role"], F.lit("")), ROLE_ESCAPES), F.lit(SEP)), off),
            piece(escape(F.coalesce(t["text"], F.lit(""))), F.coalesce(t["role"].isin(*learn), off)),
            piece(F.lit(CLOSE + "\n"), off),
        )

    made = df.withColumn("segments", F.coalesce(F.flatten(F.transform(turns_col, pieces)), F.array().cast("array<struct<text:string,loss:boolean>>")))
    return made.withColumn("formatted", F.array_join(F.transform("segments", lambda s: s["text"]), ""))


def read_turns(formatted: Column) -> Column:
    """The canonical turns parsed back from the rendered string."""
    parts = F.split(formatted, CLOSE + "\n", -1)

    def back(p: Column) -> Column:
        body = F.substr(p, F.lit(len(OPEN) + 1))
        cut = F.instr(body, F.lit(SEP))
        return F.struct(unescape(F.substr(body, F.lit(1), cut - 1), ROLE_ESCAPES).alias("role"), unescape(F.substr(body, cut + len(SEP))).alias("text"))

    return F.transform(F.slice(parts, F.lit(1), F.size(parts) - 1), back)


def read_loss(segments: Column) -> Column:
    """All text under the loss mask, unescaped and joined."""
    return F.array_join(F.transform(F.filter(segments, lambda s: s["loss"]), lambda s: unescape(s["text"])), "")


def conversations(rows: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text) as one record a conversation, its turns in order."""
    ordered = F.array_sort(F.collect_list(F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))))
    record = F.struct(F.transform("ordered", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("turns"))
    return rows.groupBy("conv_id").agg(ordered.alias("ordered")).select("conv_id", record.alias("record"))


def summary(rows: DataFrame) -> DataFrame:
    """Format conversations and read everything back from the output."""
    made = render(canonical(conversations(rows), "record")).select("conv_id", "segments", "formatted")
    back = made.withColumn("turns", read_turns(F.col("formatted"))).withColumn("learnt", read_loss(F.col("segments")))
    told = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(told, 256).alias("turns_sha256"),
        F.length("learnt").cast("long").alias("loss_chars"), F.sha2("learnt", 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"),
    )


def op3_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = F.lit("\\### Assistant: </turn> ok")
    own = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), said.alias("text"))
    return summary(rows.unionByName(own))


ORACLE = r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(14 + length(replace(role, '\', '\b')) + length(replace(replace(replace(text, '\', '\b'), '###', '\h'), '</turn>', '\t')))::BIGINT AS formatted_chars
FROM rows GROUP BY conv_id
"""
