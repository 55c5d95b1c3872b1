"""Checks and shapes of final entity lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .assertions import DISEASE, DRUG, FAMILY, HISTORICAL, NEGATED, RESULT, SYMPTOM, TEST

KINDS = [SYMPTOM, DISEASE, DRUG, TEST, RESULT]
MOST_CODES = 2


def exact_span(raw: Column, start: Column, end: Column, text: Column) -> Column:
    return (start >= 0) & (start < end) & (end <= F.length(raw)) & (F.substring(raw, start + 1, end - start) == text)


def violations(entities: DataFrame) -> DataFrame:
    """One row for each broken rule: ``record_id, start, end, type, rule``; a valid table gives none.

    Columns ``record_id, raw, text, type, candidates, assertions, start, end`` and
    ``position``, the place in the list, are read.  A null counts as a broken rule.
    """
    codes, marks, kind = F.col("candidates"), F.col("assertions"), F.col("type")
    by_place = W.partitionBy("record_id").orderBy("position")
    key = F.struct("start", "end", "type")
    d = entities.withColumn("_before", F.lag(key).over(by_place)).withColumn("_same", F.count("*").over(W.partitionBy("record_id", "start", "end", "type")))
    rules = {
        "empty_text": F.length("text") == 0, "unknown_type": ~kind.isin(KINDS), "null_field": F.col("text").isNull() | kind.isNull() | codes.isNull() | marks.isNull() | F.col("start").isNull() | F.col("end").isNull(),
        "blank_code": F.exists(codes, lambda c: c.isNull() | (F.trim(c) == "")), "repeated_code": F.size(F.array_distinct(codes)) < F.size(codes),
        "too_many_codes": kind.isin(DRUG, DISEASE) & (F.size(codes) > MOST_CODES), "codes_on_unlinked_type": ~kind.isin(DRUG, DISEASE) & (F.size(codes) > 0),
        "repeated_assertion": F.size(F.array_distinct(marks)) < F.size(marks), "unknown_assertion": F.exists(marks, lambda m: ~F.coalesce(m, F.lit("")).isin(HISTORICAL, NEGATED, FAMILY)),
        "assertion_on_other_type": ~kind.isin(SYMPTOM, DISEASE, DRUG) & (F.size(marks) > 0), "bad_offsets": ~((F.col("start") >= 0) & (F.col("start") < F.col("end"))),
        "repeated_entity": F.col("_same") > 1, "unsorted": F.col("_before") > key, "past_end": F.col("end") > F.length("raw"),
        "text_is_not_slice": F.substring(F.col("raw"), F.col("start") + 1, F.col("end") - F.col("start")) != F.col("text"),
    }
    broken = F.array_compact(F.array(*[F.when(c, name) for name, c in rules.items()]))
    return d.select("record_id", "start", "end", "type", F.explode(broken).alias("rule"))


def normalized_entities(entities: DataFrame) -> DataFrame:
    """Assertions only where the type has them, each once; codes only on linked types, trimmed, each once."""
    marks = F.filter(F.array_distinct(F.coalesce("assertions", F.array().cast("array<string>"))), lambda m: m.isin(HISTORICAL, NEGATED, FAMILY))
    codes = F.filter(F.array_distinct(F.transform(F.coalesce("candidates", F.array().cast("array<string>")), lambda c: F.trim(c))), lambda c: c != "")
    none = F.array().cast("array<string>")
    return entities.withColumn("assertions", F.when(F.col("type").isin(SYMPTOM, DISEASE, DRUG), marks).otherwise(none)).withColumn("candidates", F.when(F.col("type").isin(DRUG, DISEASE), F.slice(codes, 1, MOST_CODES)).otherwise(none))


def record_json(entities: DataFrame) -> DataFrame:
    """``(record_id, json)``: the record's list in order of start, end and type, fields in their fixed order."""
    one = F.struct("text", "type", "candidates", "assertions", F.array("start", "end").alias("position"))
    listed = F.array_sort(F.collect_list(F.struct("start", "end", "type", one.alias("e"))))
    return entities.groupBy("record_id").agg(F.to_json(F.transform(listed, lambda x: x["e"])).alias("json"))


def tolerant_json(text: Column, schema: str) -> Column:
    """The first object in a model's answer: code fences, words around it and commas before a closing bracket are passed over; null if none."""
    bare = F.regexp_replace(text, r"(?s)```(?:json)?", "")
    body = F.regexp_extract(bare, r"(?s)(\{.*\}|\[.*\])", 1)
    return F.from_json(F.when(body != "", F.regexp_replace(body, r",\s*([}\]])", "$1")), schema)
