"""Scores of predicted entities and codes against gold ones, as sums over joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPAN = ["record_id", "start", "end"]


def _ratio(a: str, b: str, none: float = 0.0) -> Column:
    return F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(none)


def entity_report(gold: DataFrame, pred: DataFrame) -> DataFrame:
    """One row: exact precision, recall, F1; type accuracy on equal spans; assertion F1; boundary errors (predictions that only overlap).

    Tables ``(record_id, start, end, type, assertions)``.
    """
    both = lambda d, f: d.select(*SPAN, "type").distinct().withColumn(f, F.lit(1))
    exact = both(gold, "g").join(both(pred, "p"), [*SPAN, "type"], "full").agg(F.count(F.when(F.col("g").isNotNull() & F.col("p").isNotNull(), 1)).alias("tp"), F.count("g").alias("ng"), F.count("p").alias("np"))
    g1 = gold.groupBy(*SPAN).agg(F.max_by(F.struct("type", "assertions"), F.struct("type")).alias("g"))
    none = F.array().cast("array<string>")
    on = pred.join(g1, SPAN, "left")
    ga, pa = F.array_distinct(F.coalesce("g.assertions", none)), F.array_distinct(F.coalesce("assertions", none))
    hit = F.col("g").isNotNull()
    sums = on.agg(
        F.count(F.when(hit, 1)).alias("same_span"), F.count(F.when(hit & (F.col("g.type") == F.col("type")), 1)).alias("same_type"), F.coalesce(F.sum(F.when(hit, F.size(F.array_intersect(ga, pa)))), F.lit(0)).alias("atp"),
        F.coalesce(F.sum(F.when(hit, F.size(pa))), F.lit(0)).alias("anp"), F.coalesce(F.sum(F.when(hit, F.size(ga))), F.lit(0)).alias("ang"),
    )
    rest = pred.join(g1, SPAN, "left_anti").select("record_id", F.col("start").alias("s"), F.col("end").alias("e"), F.monotonically_increasing_id().alias("row"))
    only = rest.join(gold.select("record_id", "start", "end"), "record_id").where("s < end AND e > start").agg(F.count_distinct("row").alias("boundary_errors"))
    d = exact.join(sums).join(only)
    f1 = lambda tp, n, m: F.when(F.col(tp) > 0, 2 * F.col(tp) / (F.col(n) + F.col(m))).otherwise(0.0)
    return d.select(_ratio("tp", "np").alias("precision"), _ratio("tp", "ng").alias("recall"), f1("tp", "np", "ng").alias("f1"), _ratio("same_type", "same_span").alias("type_accuracy"), f1("atp", "anp", "ang").alias("assertion_f1"), "boundary_errors")


def linking_report(rows: DataFrame, k: int) -> DataFrame:
    """One row over ``(gold array, pred array)``: recall at ``k``, pooled Jaccard, shares of false codes and of empty answers, top-1 and exact sets, code recall."""
    g, p = F.array_distinct("gold"), F.array_distinct("pred")
    known = F.size(g) > 0
    s = rows.agg(
        F.count("*").alias("n"), F.count(F.when(known, 1)).alias("n_gold"), F.count(F.when(known & F.arrays_overlap("gold", F.slice("pred", 1, k)), 1)).alias("hits"), F.sum(F.size(F.array_intersect(g, p))).alias("both"), F.sum(F.size(F.array_union(g, p))).alias("every"),
        F.sum(F.size(p)).alias("given"), F.sum(F.size(F.array_except(p, g))).alias("false"), F.count(F.when(F.size(p) == 0, 1)).alias("empty"), F.count(F.when(known & F.array_contains(g, F.get("pred", F.lit(0))), 1)).alias("top"),
        F.count(F.when(F.array_sort(g) == F.array_sort(p), 1)).alias("same"), F.sum(F.size(g)).alias("codes"),
    )
    return s.select(_ratio("hits", "n_gold").alias("recall_at_k"), _ratio("both", "every", 1.0).alias("jaccard"), _ratio("false", "given").alias("false_code_rate"), _ratio("empty", "n").alias("abstention_rate"), _ratio("top", "n_gold").alias("top1"), _ratio("same", "n").alias("exact_set"), _ratio("both", "codes").alias("code_recall"))


def error_class(gold: Column, pred: Column) -> Column:
    """``correct``, ``missing``, ``extra`` or ``missing_and_extra``."""
    lost, more = F.size(F.array_except(gold, pred)) > 0, F.size(F.array_except(pred, gold)) > 0
    return F.when(lost & more, "missing_and_extra").when(lost, "missing").when(more, "extra").otherwise("correct")


def top_codes(candidates: DataFrame, k: int) -> DataFrame:
    """``(mention_id, pred)``: the first ``k`` codes by score, then code."""
    g = candidates.groupBy("mention_id", "code").agg(F.max("score").alias("score"))
    order = F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "code")))
    return g.groupBy("mention_id").agg(F.transform(F.slice(order, 1, k), lambda x: x["code"]).alias("pred"))
