"""Operator 2: personal data, with DataFrame functions only.

Regular expressions propose spans, checks confirm them (ranges, digit counts, Luhn, mod 97) and words just
before a span raise its score. Spans are in code points, end exclusive. What splitting a text at a pattern
leaves, and the matches themselves, give every match's place by a running sum.

An array can only be appended to by copying it, and a place in a text only be reached from its start. So both
the running sum and the redaction go by blocks: as many blocks of matches as a block has matches, each with the
place where it begins and its own stretch of the text. Their cost grows with matches to the power of 1.5 at
most, not with their square.

The base kinds keep every match that passes its check; ``iban`` needs its mod-97 check, ``ssn`` needs a
context word (score 50 or more). The patterns are written without nested backtracking (possessive, and a
match may begin only where a run of its characters begins or the last match ended), which finds the same
matches in time linear in the text, without deep recursion on long runs.

Defined cases: null text counts as empty and has no spans; repeated rows are reported each; an empty table
gives no rows; further columns are kept out of the result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_LOCAL = "[A-Za-z0-9._%+-]"
#: Kind: pattern, in the order of ties.
PATTERNS = {
    "email": rf"(?:(?<!{_LOCAL})|\G){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"(?<![0-9])[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
}
BASE = ("email", "ip", "card", "phone")
#: Must stand in a text for the pattern to match at all.
NEEDS = {"email": "@", "phone": "+", "ssn": "-"}
#: Words just before a span that raise its score (fixed values).
CONTEXT = {
    "email": "mail|contact|write to|kontakt|correo|courriel",
    "ip": "address|server|host|adresse|from",
    "card": "card|visa|credit|carte|karte|tarjeta",
    "phone": "phone|call|tel|mobile|telefon|anruf",
    "iban": "iban|account|konto|compte|cuenta",
    "ssn": "ssn|social security",
}
CHECKED = {"card", "iban", "ip"}
WINDOW = 40
LEAST = 50


def _ip_ok(v: Column) -> Column:
    def part_ok(p: Column) -> Column:
        digits = F.regexp_replace(p, "^0+", "")
        return (F.length(digits) < 3) | ((F.length(digits) == 3) & (digits <= "255"))

    return F.forall(F.split(v, r"\."), part_ok)


def _digits(v: Column) -> Column:
    return F.regexp_replace(v, "[^0-9]", "")


def _mod97(v: Column) -> Column:
    plain = F.replace(v, F.lit(" "))
    turned = F.concat(F.substring(plain, 5, 40), F.substring(plain, 1, 4))

    def step(acc: Column, c: Column) -> Column:
        code = F.ascii(c)
        return F.when(code >= 65, (acc * 100 + code - 55) % 97).otherwise((acc * 10 + code - 48) % 97)

    return F.length(plain).between(15, 34) & (F.aggregate(F.filter(F.split(turned, ""), lambda c: c != ""), F.lit(0), step) == 1)


_CHECKS = {
    "email": lambda v: F.lit(True),
    "ip": _ip_ok,
    "card": lambda v: F.length(_digits(v)).between(12, 19) & F.call_function("luhn_check", _digits(v)),
    "phone": lambda v: F.length(_digits(v)).between(9, 15),
    "iban": _mod97,
    "ssn": lambda v: ~v.startswith("000") & ~v.startswith("666") & ~v.startswith("9"),
}
_SPANS = "array<struct<start:int,rank:int,end:int,score:int>>"


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once, however often ``body`` names it (also for each item of an array)."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _blocks(items: Column) -> Column:
    """An array (a column or a lambda's variable) cut into about as many arrays as each of them has items."""
    width = F.greatest(F.ceil(F.sqrt(F.size(items))).cast("int"), F.lit(1))
    return _let(width, lambda w: F.transform(F.sequence(F.lit(1), F.greatest(F.size(items), F.lit(1)), w), lambda at: F.slice(items, at, w)))


def _before(blocks: Column, first: Column, step: Callable[[Column, Column], Column]) -> Column:
    """Each block with the value that ``step`` has come to from ``first`` over the blocks before it: structs (block, value)."""
    kept = F.aggregate(blocks, F.array(first), lambda acc, b: F.concat(acc, F.array(step(F.element_at(acc, -1), b))))
    return _let(kept, lambda k: F.zip_with(blocks, F.slice(k, 1, F.size(blocks)), lambda b, v: F.struct(b.alias("block"), v.alias("value"))))


def _matches(text: Column, pattern: str) -> Column:
    """Every match as (start, end, value, before: up to WINDOW characters before it)."""
    pairs = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("hit"))
    nothing = F.struct(F.lit(0).alias("at"), F.lit("").alias("tail"))

    def passed(value: Column, b: Column) -> Column:
        whole = F.array_join(F.transform(b, lambda p: F.concat(p["gap"], F.coalesce(p["hit"], F.lit("")))), "")
        return _let(whole, lambda w: F.struct((value["at"] + F.length(w)).alias("at"), F.right(F.concat(value["tail"], w), F.lit(WINDOW)).alias("tail")))

    def step(acc: Column, p: Column) -> Column:
        start, before = acc["at"] + F.length(p["gap"]), F.right(F.concat(acc["tail"], p["gap"]), F.lit(WINDOW))
        end = start + F.length(p["hit"])
        found = F.struct(start.alias("start"), end.alias("end"), p["hit"].alias("value"), before.alias("before"))
        return F.struct(end.alias("at"), F.right(F.concat(before, p["hit"]), F.lit(WINDOW)).alias("tail"), F.when(p["hit"].isNotNull(), F.concat(acc["out"], F.array(found))).otherwise(acc["out"]).alias("out"))

    empty = F.array().cast("array<struct<start:int,end:int,value:string,before:string>>")
    within = lambda b: F.aggregate(b["block"], F.struct(b["value"]["at"].alias("at"), b["value"]["tail"].alias("tail"), empty.alias("out")), step, lambda acc: acc["out"])
    return _let(pairs, lambda p: _let(_blocks(p), lambda blocks: F.flatten(F.transform(_before(blocks, nothing, passed), within))))


def spans_of(text: Column, kind: str) -> Column:
    rank = list(PATTERNS).index(kind)
    needed = F.contains(text, F.lit(NEEDS[kind])) if kind in NEEDS else F.lit(True)
    some = needed & text.rlike(PATTERNS[kind])
    confirmed = F.filter(_matches(text, PATTERNS[kind]), lambda m: _CHECKS[kind](m["value"]))

    def scored(m: Column) -> Column:
        near = F.lower(m["before"]).rlike(CONTEXT[kind])
        score = F.lit(60 if kind in BASE else 30) + F.lit(20 if kind in CHECKED else 0) + F.when(near, 20).otherwise(0)
        return F.struct(m["start"], F.lit(rank).alias("rank"), m["end"], score.cast("int").alias("score"))

    return F.when(some, F.filter(F.transform(confirmed, scored), lambda m: m["score"] >= LEAST)).otherwise(F.array().cast(_SPANS))


def spans_in(text: Column) -> Column:
    """All spans of a text (null: none), sorted by start, then kind: structs (start, rank of kind, end, score)."""
    text = F.coalesce(text, F.lit(""))
    return F.array_sort(F.concat(*(spans_of(text, kind) for kind in PATTERNS)))


def find_spans(docs: DataFrame, text_col: str = "text", spans_col: str = "pii_spans") -> DataFrame:
    """Adds the column ``spans_col`` (in place of one of that name) of :func:`spans_in`."""
    return docs.withColumn(spans_col, spans_in(F.col(text_col)))


def redacted(text: Column, spans: Column) -> Column:
    """``text`` with each span, overlapping ones joined, replaced by its first kind's name in brackets."""
    kinds = F.array(*(F.lit(f"[{k.upper()}]") for k in PATTERNS))
    furthest = lambda at, b: F.greatest(at, F.array_max(F.transform(b, lambda s: s["end"])))
    blocks = _let(_blocks(spans), lambda b: _before(b, F.lit(0), furthest))
    # each block's stretch of the text: from where the blocks before it end to where it ends
    cut = F.transform(blocks, lambda b: F.struct(b["block"].alias("block"), b["value"].alias("at"), F.substring(text, b["value"] + 1, furthest(b["value"], b["block"]) - b["value"]).alias("text")))

    def replaced(b: Column) -> Column:
        def step(acc: Column, s: Column) -> Column:
            more = F.concat(acc["out"], F.array(F.concat(F.substring(b["text"], acc["at"] - b["at"] + 1, s["start"] - acc["at"]), F.get(kinds, s["rank"]))))
            return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.when(s["start"] < acc["at"], acc["out"]).otherwise(more).alias("out"))

        return F.aggregate(b["block"], F.struct(b["at"].alias("at"), F.array().cast("array<string>").alias("out")), step, lambda acc: F.array_join(acc["out"], ""))

    last = F.array_max(F.transform(spans, lambda s: s["end"]))
    # the rest of the text after the last span; a text has fewer code points than 2^31
    return F.when(F.size(spans) == 0, text).otherwise(F.concat(F.array_join(F.transform(cut, replaced), ""), F.substring(text, last + 1, F.lit(2**31 - 1))))


def redact(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with personal data in the text replaced; columns and their order stay the same, a null text stays null."""
    name = "_spans"
    while name in docs.columns:
        name += "_"
    return find_spans(docs, text_col, name).withColumn(text_col, redacted(F.col(text_col), F.col(name))).drop(name)


def _joined(spans: Column) -> Column:
    names = F.array(*(F.lit(k) for k in PATTERNS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["rank"]), s["start"], s["end"])), ",")


def _is(rank: int) -> Callable[[Column], Column]:
    return lambda s: s["rank"] == rank


def op2_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = find_spans(docs).select("doc_id", "pii_spans")
    spans = F.col("pii_spans")
    counts = [F.size(F.filter(spans, _is(rank))).cast("long").alias(f"n_{kind}") for rank, kind in enumerate(BASE)]
    return found.select("doc_id", *counts, F.sha2(_joined(F.filter(spans, lambda s: s["rank"] < len(BASE))), 256).alias("base_sha256"), _joined(spans).alias("spans"), F.array_join(F.transform(spans, lambda s: s["score"].cast("string")), ",").alias("scores"))


def _sql_kind(kind: str, rank: int, pattern: str, check: str) -> str:
    words = CONTEXT[kind]
    base = (60 if kind in BASE else 30) + (20 if kind in CHECKED else 0)
    return f"""
  SELECT row_, {rank} AS rank, '{kind}' AS kind, s AS start_, s + length(v) AS end_,
         {base} + CASE WHEN regexp_matches(lower(substring(text, greatest(s - {WINDOW}, 0) + 1, s - greatest(s - {WINDOW}, 0))), '{words}') THEN 20 ELSE 0 END AS score
  FROM (SELECT row_, text, unnest(list_transform(hits, lambda h, i: {{'v': h, 's': coalesce(list_sum(list_transform(gaps[1:i], lambda g: length(g))), 0)::BIGINT + coalesce(list_sum(list_transform(hits[1:i - 1], lambda g: length(g))), 0)::BIGINT}}), recursive := true)
        FROM (SELECT row_, text, regexp_extract_all(text, '{pattern}') AS hits, string_split_regex(text, '{pattern}') AS gaps FROM texts WHERE regexp_matches(text, '{pattern}')))
  WHERE {check}"""


_LUHN = "list_sum(list_transform(range(1, length(d) + 1), lambda i: CASE WHEN i % 2 = 1 THEN substring(reverse(d), i, 1)::INT ELSE (substring(reverse(d), i, 1)::INT * 2) % 10 + (substring(reverse(d), i, 1)::INT * 2) // 10 END)) % 10 = 0"
_D = "regexp_replace(v, '[^0-9]', '', 'g')"
_PLAIN = "replace(v, ' ', '')"
_MOD97 = f"list_reduce(list_prepend(0, list_transform(regexp_extract_all(substring({_PLAIN}, 5) || substring({_PLAIN}, 1, 4), '.'), lambda c: CASE WHEN ascii(c) >= 65 THEN ascii(c) - 55 ELSE ascii(c) - 48 END)), lambda a, b: CASE WHEN b >= 10 THEN (a * 100 + b) % 97 ELSE (a * 10 + b) % 97 END) = 1"
_SQL_PARTS = [
    _sql_kind("email", 0, r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", "true"),
    _sql_kind("ip", 1, r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)", "list_bool_and(list_transform(string_split(v, '.'), lambda p: p::HUGEINT <= 255))"),
    _sql_kind("card", 2, r"[0-9](?:[\x20-]?[0-9])+", f"length({_D}) BETWEEN 12 AND 19 AND {_LUHN.replace('(d)', '(' + _D + ')')}"),
    _sql_kind("phone", 3, r"\+[0-9][\x20().0-9-]+[0-9]", f"length({_D}) BETWEEN 9 AND 15"),
    _sql_kind("iban", 4, r"\b[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?\b", f"length({_PLAIN}) BETWEEN 15 AND 34 AND {_MOD97}"),
    _sql_kind("ssn", 5, r"\b[0-9]{3}-[0-9]{2}-[0-9]{4}\b", "NOT (v LIKE '000%' OR v LIKE '666%' OR v LIKE '9%')"),
]
OP2_SQL = f"""
WITH texts AS (SELECT row_number() OVER () AS row_, doc_id, coalesce(text, '') AS text FROM documents),
spans_ AS ({" UNION ALL ".join(_SQL_PARTS)}),
whole AS (
  SELECT row_, count(*) FILTER (kind = 'email') AS n_email, count(*) FILTER (kind = 'ip') AS n_ip, count(*) FILTER (kind = 'card') AS n_card, count(*) FILTER (kind = 'phone') AS n_phone,
         string_agg(kind || ':' || start_ || ':' || end_, ',' ORDER BY start_, rank) FILTER (rank < 4) AS base,
         string_agg(kind || ':' || start_ || ':' || end_, ',' ORDER BY start_, rank) AS spans,
         string_agg(score::VARCHAR, ',' ORDER BY start_, rank) AS scores
  FROM spans_ WHERE score >= 50 GROUP BY row_
)
SELECT doc_id, coalesce(n_email, 0) AS n_email, coalesce(n_ip, 0) AS n_ip, coalesce(n_card, 0) AS n_card, coalesce(n_phone, 0) AS n_phone,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(scores, '') AS scores
FROM texts LEFT JOIN whole USING (row_)
"""
