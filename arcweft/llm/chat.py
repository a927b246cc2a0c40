"""Chat formatting by schema fingerprints.

Records come in several layouts (message lists, prompt and completion, instruction and output). The nested field paths that
a record fills are hashed; the hash selects a declarative mapping that turns the record into canonical turns
array<struct<role, text>>. A template then writes the turns as one string:

    <turn>ROLE<text>TEXT<end>

`<`, `[` and `&` inside roles and texts become entities, so no text can hold a control string of this template (or of
those that use [INST] or </s>), and reading back undoes it exactly. The loss mask is a list of (start, length) in code
points of the formatted string, one for each assistant text.

A record is read by the first layout all of whose paths it fills (lists first, then layouts of more fields); if there is none, by
the first of which it fills some (lists first, then layouts of fewer fields), the rest counting as empty. Other fields and columns, also those that belong to another layout, are
ignored.

Nulls: null text or role counts as empty; a record that fills no known path has no layout (null) and no turns. Rows without an id
belong to no conversation: each different one is a conversation of its own, with a null id. Empty table: no rows. Rows that tie
in `turn` are ordered by role and text; repeated rows are repeated turns. A conversation is the unit of output, so its turns
meet in one row however long it is.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

TURNS = "array<struct<role:string,text:string>>"
#: The template's control strings and the entities that stand for their first characters inside texts.
TURN, TEXT, END = "<turn>", "<text>", "<end>"
ENTITIES = [("&", "&amp;"), ("<", "&lt;"), ("[", "&lsqb;")]


def empty(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def turn(role: Column, text: Column) -> Column:
    return F.struct(empty(role).alias("role"), empty(text).alias("text"))


def list_of(column: str, role: str, text: str) -> Callable[[], Column]:
    return lambda: F.transform(F.col(column), lambda x: turn(x[role], x[text]))


@dataclass(frozen=True)
class Layout:
    """`paths` are the field paths that a record of this layout fills; `turns` builds its canonical turns."""

    name: str
    paths: tuple[str, ...]
    turns: Callable[[], Column]


def pair(user: str, assistant: str) -> Callable[[], Column]:
    return lambda: F.array(turn(F.lit("user"), F.col(user)), turn(F.lit("assistant"), F.col(assistant)))


LAYOUTS = (
    Layout("messages", ("messages[].role", "messages[].content"), list_of("messages", "role", "content")),
    Layout("conversations", ("conversations[].from", "conversations[].value"), list_of("conversations", "from", "value")),
    Layout("turns", ("turns[].role", "turns[].text"), list_of("turns", "role", "text")),
    Layout("prompt", ("prompt", "completion"), pair("prompt", "completion")),
    Layout("prompt_response", ("prompt", "response"), pair("prompt", "response")),
    Layout("instruction", ("instruction", "output"), pair("instruction", "output")),
    Layout(
        "instruction_input",
        ("instruction", "input", "output"),
        lambda: F.array(turn(F.lit("user"), F.concat_ws("\n\n", "instruction", "input")), turn(F.lit("assistant"), F.col("output"))),
    ),
    Layout("system_prompt", ("system", "prompt", "completion"), lambda: F.array(turn(F.lit("system"), F.col("system")), turn(F.lit("user"), F.col("prompt")), turn(F.lit("assistant"), F.col("completion")))),
)


def paths_of(kind: T.DataType, at: str) -> list[str]:
    """The field paths of a schema; arrays are marked []."""
    if isinstance(kind, T.ArrayType):
        return paths_of(kind.elementType, f"{at}[]")
    if isinstance(kind, T.StructType):
        return [p for f in kind.fields for p in paths_of(f.dataType, f"{at}.{f.name}" if at else f.name)]
    return [at]


def digest(paths: Column) -> Column:
    return F.sha2(F.array_join(F.array_sort(paths), "\n"), 256)


def fills(path: str) -> Column:
    """Whether a record holds a value at a known path: a column, or a field of a list's elements."""
    column, _, field = path.partition("[].")
    return F.coalesce(F.exists(F.col(column), lambda x: x[field].isNotNull()) if field else F.col(column).isNotNull(), F.lit(False))


def canonical(df: DataFrame, keep: list[str]) -> DataFrame:
    """keep + fingerprint (of the paths of a layout that the record fills), layout, turns."""
    have = {p for f in df.schema.fields for p in paths_of(f.dataType, f.name)}
    layouts = sorted((x for x in LAYOUTS if set(x.paths) <= have), key=lambda x: ("[]" not in x.paths[0], -len(x.paths)))
    known = sorted({p for x in layouts for p in x.paths})
    filled = F.filter(F.array(*(F.when(fills(p), F.lit(p)) for p in known)), lambda p: p.isNotNull()) if known else F.array().cast("array<string>")
    df = df.select(*keep, *(c for c in dict.fromkeys(p.split("[")[0] for p in known) if c not in keep), filled.alias("_filled"))
    prints = [digest(F.array_intersect("_filled", F.array(*map(F.lit, x.paths)))) for x in layouts]
    df = df.withColumn("_prints", F.array(*prints) if prints else F.array().cast("array<string>"))
    whole = [F.get("_prints", F.lit(i)) == digest(F.array(*map(F.lit, x.paths))) for i, x in enumerate(layouts)]
    some = [F.get("_prints", F.lit(i)) != digest(F.array().cast("array<string>")) for i in range(len(layouts))]
    few = sorted(range(len(layouts)), key=lambda i: ("[]" not in layouts[i].paths[0], len(layouts[i].paths)))
    which = F.coalesce(*(F.when(test, F.lit(i)) for i, test in enumerate(whole)), *(F.when(some[i], F.lit(i)) for i in few), F.lit(-1))
    df = df.withColumn("_which", which)
    turns, name = F.when(F.col("_which") < 0, F.array().cast(TURNS)), F.lit(None).cast("string")
    for i, layout in enumerate(layouts):
        turns, name = turns.when(F.col("_which") == i, layout.turns().cast(TURNS)), F.when(F.col("_which") == i, layout.name).otherwise(name)
    return df.select(*keep, F.coalesce(F.get("_prints", F.col("_which")), digest(F.array().cast("array<string>"))).alias("fingerprint"), name.alias("layout"), F.coalesce(turns, F.array().cast(TURNS)).alias("turns"))


def escaped(c: Column) -> Column:
    for plain, entity in ENTITIES:
        c = F.replace(c, F.lit(plain), F.lit(entity))
    return c


def unescaped(c: Column) -> Column:
    for plain, entity in reversed(ENTITIES):
        c = F.replace(c, F.lit(entity), F.lit(plain))
    return c


def format_turns(df: DataFrame) -> DataFrame:
    """`turns` becomes `formatted` (the string) and `loss_mask` (array<struct<start, length>>, start from 0)."""
    parts = F.transform("turns", lambda t: F.struct(F.concat(F.lit(TURN), escaped(t["role"]), F.lit(TEXT)).alias("head"), escaped(t["text"]).alias("body"), (t["role"] == "assistant").alias("loss")))
    df = df.withColumn("_parts", parts)
    formatted = F.array_join(F.transform("_parts", lambda p: F.concat(p["head"], p["body"], F.lit(END))), "")
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start:long,length:long>>").alias("spans"))

    def step(s: Column, p: Column) -> Column:
        body = s["at"] + F.char_length(p["head"])
        size = F.char_length(p["body"]).cast("long")
        span = F.array(F.struct(body.alias("start"), size.alias("length")))
        return F.struct((body + size + len(END)).alias("at"), F.when(p["loss"], F.concat(s["spans"], span)).otherwise(s["spans"]).alias("spans"))

    mask = F.aggregate("_parts", start, step)["spans"]
    return df.withColumn("formatted", formatted).withColumn("loss_mask", mask).drop("_parts", "turns")


def read_back(df: DataFrame) -> DataFrame:
    """`turns` from `formatted` alone, and `loss_text`: what the mask covers, unescaped."""
    pieces = F.slice(F.split("formatted", TURN), 2, F.greatest(F.size(F.split("formatted", TURN)) - 1, F.lit(0)))
    turns = F.transform(pieces, lambda p: F.struct(unescaped(F.substring_index(p, TEXT, 1)).alias("role"), unescaped(F.replace(F.substring_index(p, TEXT, -1), F.lit(END), F.lit(""))).alias("text")))
    spans = F.transform("loss_mask", lambda m: unescaped(F.substring(F.col("formatted"), (m["start"] + 1).cast("int"), m["length"].cast("int"))))
    return df.withColumn("turns", turns).withColumn("loss_text", F.array_join(spans, ""))


def conversations(rows: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text) as one record per conversation in the `messages` layout."""
    one = F.struct("turn", empty(F.col("role")).alias("role"), empty(F.col("text")).alias("content"))
    # rows without an id are told apart by what they say, so that they meet in no one task
    own = F.when(F.col("conv_id").isNull(), F.xxhash64("turn", "role", "text"))
    return rows.groupBy("conv_id", own.alias("_own")).agg(F.array_sort(F.collect_list(one)).alias("m")).select("conv_id", F.transform("m", lambda x: F.struct(x["role"].alias("role"), x["content"].alias("content"))).alias("messages"))


def op8_chat_formatting(spark: SparkSession, rows: DataFrame) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    extra = spark.range(1).select(F.lit(-7).cast("long").alias("conv_id"), F.lit(said).alias("prompt"), F.lit(said).alias("completion"))
    records = conversations(rows).unionByName(extra, allowMissingColumns=True)
    out = read_back(format_turns(canonical(records, ["conv_id"])))
    whole = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return out.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(whole, 256).alias("turns_sha256"),
        F.char_length("loss_text").cast("long").alias("loss_chars"),
        F.sha2("loss_text", 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
        "fingerprint",
        "layout",
    )


OP8_SQL = r"""
WITH r AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text, 'messages' AS layout FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]', 'prompt' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]', 'prompt'),
e AS (SELECT *, replace(replace(replace(role, '&', '&amp;'), '<', '&lt;'), '[', '&lsqb;') AS er, replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '[', '&lsqb;') AS et FROM r)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn, role, text), '')) AS loss_sha256,
  CAST(sum(length(er) + length(et) + 17) AS BIGINT) AS formatted_chars,
  sha256(CASE WHEN any_value(layout) = 'messages' THEN 'messages[].content' || chr(10) || 'messages[].role' ELSE 'completion' || chr(10) || 'prompt' END) AS fingerprint,
  any_value(layout) AS layout
FROM e GROUP BY conv_id, CASE WHEN conv_id IS NULL THEN hash(turn, role, text) END
"""
