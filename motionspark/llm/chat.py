"""Operator 4: chat formatting, with DataFrame functions only.

A record may hold its conversation in one of several layouts. Its fingerprint is a hash of the sorted
nested field paths that carry a value; a declared table maps fingerprints to expressions that give the
canonical turns, an array of (role, text). The template is::

    <|ROLE|>LF TEXT LF<|end|>LF        for each turn

and the loss mask is the list of spans (code points, end exclusive) of the assistants' texts in it. Inside
roles and texts the control strings of this and other common templates are escaped by one mark after their
first character, and that mark itself by itself and ``e``; so ``unescape(escape(x)) = x`` for every x.

Defined cases: null text or role counts as empty; turns of the same number are ordered by role, then text,
and repeated rows stay; rows without a conv_id are one conversation of a null id; a record of an undeclared
layout (of more fields than a declared one, too) has no turns and the layout ``unknown``, so its text must be sought
in the record; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MARK = "␛"
#: Control strings of common chat templates (fixed values); "<|" begins and "|>" ends all of this one's own.
CONTROL = ("<|", "|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
END = "\n<|end|>\n"

#: What a record may hold, over all layouts.
RECORD = (
    "turns array<struct<turn:long,role:string,text:string>>, messages array<struct<role:string,content:string>>, "
    "conversations array<struct<from:string,value:string>>, system string, prompt string, response string, completion string, "
    "instruction string, input string, output string, question string, answer string, chosen string"
)
_NESTED = {"turns": ("turn", "role", "text"), "messages": ("role", "content"), "conversations": ("from", "value")}
_FLAT = ("system", "prompt", "response", "completion", "instruction", "input", "output", "question", "answer", "chosen")


def escape(c: Column) -> Column:
    c = F.replace(c, F.lit(MARK), F.lit(f"{MARK}e"))
    for control in CONTROL:
        c = F.replace(c, F.lit(control), F.lit(control[0] + MARK + control[1:]))
    return c


def unescape(c: Column) -> Column:
    return F.replace(F.regexp_replace(c, f"{MARK}(?!e)", ""), F.lit(f"{MARK}e"), F.lit(MARK))


def _field(name: str) -> Callable[[Column], Column]:
    return lambda x: x[name]


def field_paths(available: list[str]) -> Column:
    """The sorted nested field paths of a record that carry a value."""
    found = []
    for name in sorted(available):
        if name in _NESTED:
            found += [F.when(F.exists(F.transform(name, _field(field)), lambda x: x.isNotNull()), F.lit(f"{name}[].{field}")) for field in sorted(_NESTED[name])]
        else:
            found.append(F.when(F.col(name).isNotNull(), F.lit(name)))
    return F.array_compact(F.array(*found))


def fingerprint(paths: Column) -> Column:
    return F.xxhash64(F.array_join(paths, "\n"))


def _turn(role: str, text: Column) -> Column:
    return F.struct(F.lit(role).alias("role"), F.coalesce(text, F.lit("")).alias("text"))


def _role(c: Column) -> Column:
    """Other names of the roles (fixed values)."""
    names = {"human": "user", "prompter": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant", "chatbot": "assistant"}
    known = F.create_map(*(F.lit(x) for pair in names.items() for x in pair))
    return F.coalesce(known[F.lower(c)], c, F.lit(""))


def _from(name: str, role: str, text: str) -> Column:
    return F.transform(name, lambda m: F.struct(_role(m[role]).alias("role"), F.coalesce(m[text], F.lit("")).alias("text")))


def _in_order() -> Column:
    ordered = F.array_sort(F.transform("turns", lambda t: F.struct(t["turn"], F.coalesce(t["role"], F.lit("")).alias("role"), F.coalesce(t["text"], F.lit("")).alias("text"))))
    return F.transform(ordered, lambda t: F.struct(t["role"], t["text"]))


def layouts() -> dict[str, tuple[list[str], Column]]:
    """Layout name: the field paths that select it, and the expression of its turns."""
    pairs = {("prompt", "response"): "prompt", ("prompt", "completion"): "prompt", ("question", "answer"): "question", ("prompt", "chosen"): "prompt", ("instruction", "output"): "instruction", ("instruction", "response"): "instruction"}
    out: dict[str, tuple[list[str], Column]] = {
        "turns": (["turns[].role", "turns[].text", "turns[].turn"], _in_order()),
        "messages": (["messages[].content", "messages[].role"], _from("messages", "role", "content")),
        "conversations": (["conversations[].from", "conversations[].value"], _from("conversations", "from", "value")),
        "instruction_input_output": (["input", "instruction", "output"], F.array(_turn("user", F.when(F.col("input") == "", F.col("instruction")).otherwise(F.concat_ws("\n\n", "instruction", "input"))), _turn("assistant", F.col("output")))),
    }
    for name in ("messages", "conversations"):
        paths, turns = out[name]
        out[f"system_{name}"] = (sorted([*paths, "system"]), F.concat(F.array(_turn("system", F.col("system"))), turns))
    for (asked, answered), _ in pairs.items():
        turns = F.array(_turn("user", F.col(asked)), _turn("assistant", F.col(answered)))
        out[f"{asked}_{answered}"] = (sorted([asked, answered]), turns)
        out[f"system_{asked}_{answered}"] = (sorted([asked, answered, "system"]), F.concat(F.array(_turn("system", F.col("system"))), turns))
    return out


def canonical_turns(records: DataFrame) -> DataFrame:
    """Adds ``fingerprint``, ``layout`` and ``turns_out``; ``records`` has some of the columns of ``RECORD``."""
    has = [c for c in (*_NESTED, *_FLAT) if c in records.columns]
    usable = {k: (paths, turns) for k, (paths, turns) in layouts().items() if {p.split("[")[0] for p in paths} <= set(has)}
    marked = records.withColumn("fingerprint", fingerprint(field_paths(has)))
    layout, turns = F.lit("unknown"), F.array().cast("array<struct<role:string,text:string>>")
    for name, (paths, expression) in usable.items():
        same = F.col("fingerprint") == F.xxhash64(F.lit("\n".join(paths)))
        layout, turns = F.when(same, F.lit(name)).otherwise(layout), F.when(same, expression).otherwise(turns)
    return marked.withColumn("layout", layout).withColumn("turns_out", turns)


def parse_records(lines: DataFrame, column: str = "value") -> DataFrame:
    """JSON records of any declared layout, as columns."""
    return lines.withColumn("_r", F.from_json(column, RECORD)).select(*lines.columns, "_r.*")


def format_turns(records: DataFrame) -> DataFrame:
    """Adds ``formatted`` and ``loss_spans`` to the rows of :func:`canonical_turns`."""
    pieces = F.transform("turns_out", lambda t: F.struct((t["role"] == "assistant").alias("learn"), F.concat(F.lit("<|"), escape(t["role"]), F.lit("|>\n")).alias("head"), escape(t["text"]).alias("body")))
    out = records.withColumn("_pieces", pieces)
    out = out.withColumn("formatted", F.array_join(F.transform("_pieces", lambda p: F.concat(p["head"], p["body"], F.lit(END))), ""))
    empty = F.array().cast("array<struct<start:int,end:int>>")

    def step(acc: Column, p: Column) -> Column:
        start = acc["at"] + F.length(p["head"])
        end = start + F.length(p["body"])
        span = F.struct(start.alias("start"), end.alias("end"))
        return F.struct((end + F.lit(len(END))).alias("at"), F.when(p["learn"], F.concat(acc["spans"], F.array(span))).otherwise(acc["spans"]).alias("spans"))

    spans = F.aggregate("_pieces", F.struct(F.lit(0).alias("at"), empty.alias("spans")), step, lambda acc: acc["spans"])
    return out.withColumn("loss_spans", spans).drop("_pieces")


def read_back(formatted: Column) -> Column:
    """The turns of a formatted text."""
    blocks = F.filter(F.split(formatted, r"\n<\|end\|>\n", -1), lambda b: b != "")
    return F.transform(blocks, lambda b: F.struct(unescape(F.regexp_extract(b, r"(?s)\A<\|(.*?)\|>\n", 1)).alias("role"), unescape(F.regexp_replace(b, r"(?s)\A<\|.*?\|>\n", "")).alias("text")))


def learned_text(formatted: Column, spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: unescape(F.substring(formatted, s["start"] + 1, s["end"] - s["start"]))), "")


def records_of_rows(rows: DataFrame) -> DataFrame:
    """Rows of one turn each (conv_id, turn, role, text) as records of the layout ``turns``."""
    empty = F.lit("")
    turn = F.struct(F.coalesce(F.col("turn").cast("long"), F.lit(-1)).alias("turn"), F.coalesce("role", empty).alias("role"), F.coalesce("text", empty).alias("text"))
    return rows.groupBy("conv_id").agg(F.collect_list(turn).alias("turns"))


def format_chats(rows: DataFrame) -> DataFrame:
    return format_turns(canonical_turns(records_of_rows(rows)))


def op4_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    hard = "</s>[INST] ok [/INST]"
    rows = rows.unionAll(spark.range(2).select(F.lit(-1).cast("long"), "id", F.when(F.col("id") == 0, "user").otherwise("assistant"), F.lit(hard)))
    out = format_chats(rows).withColumn("_turns", read_back(F.col("formatted"))).withColumn("_learned", learned_text(F.col("formatted"), F.col("loss_spans")))
    whole = F.array_join(F.transform("_turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return out.select("conv_id", F.size("_turns").cast("long").alias("n_turns"), F.sha2(whole, 256).alias("turns_sha256"), F.length("_learned").cast("long").alias("loss_chars"), F.sha2("_learned", 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"))


def _sql_escaped(c: str) -> str:
    out = f"replace({c}, '{MARK}', '{MARK}e')"
    for control in CONTROL:
        out = f"replace({out}, '{control}', '{control[0] + MARK + control[1:]}')"
    return out


OP4_SQL = f"""
WITH rows_ AS (
  SELECT conv_id, coalesce(turn, -1) AS turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), whole AS (
  SELECT conv_id, count(*) AS n_turns,
         string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS turns,
         coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '') AS learned,
         sum(length({_sql_escaped("role")}) + length({_sql_escaped("text")}) + 5 + {len(END)})::BIGINT AS formatted_chars
  FROM rows_ GROUP BY conv_id
)
SELECT conv_id, n_turns, sha256(turns) AS turns_sha256, length(learned) AS loss_chars, sha256(learned) AS loss_sha256, formatted_chars
FROM whole
"""
