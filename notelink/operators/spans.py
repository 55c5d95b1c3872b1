"""Spans and intervals: as-of, overlap, islands, scheduling, tags."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def asof(left: DataFrame, right: DataFrame, keys: Sequence[str], at: str, carry: Sequence[str]) -> DataFrame:
    """Each left row with the last right row of its key at or before it; one shuffle and one sort, no range join."""
    value = F.struct(F.col(at).alias("block_at"), *carry)
    both = left.withColumn("side", F.lit(1)).withColumn("r", F.lit(None).cast(right.select(value.alias("x")).schema["x"].dataType)).unionByName(right.select(*keys, at, value.alias("r")).withColumn("side", F.lit(0)), allowMissingColumns=True)
    w = W.partitionBy(*keys).orderBy(at, "side").rowsBetween(W.unboundedPreceding, 0)
    return both.withColumn("r", F.last("r", ignorenulls=True).over(w)).where("side = 1").select(*left.columns, "r.*")


def overlaps(a: DataFrame, b: DataFrame, keys: Sequence[str], width: int, start: str = "start", end: str = "end") -> DataFrame:
    """Pairs ``a.start < b.end AND a.end > b.start`` within a key.

    Both sides are dealt into buckets of ``width``, so the join is by equality; a pair
    is kept in the bucket where the later of the two starts.
    """
    bucket = lambda p: F.explode(F.sequence(F.floor(F.col(p + start) / width), F.floor((F.col(p + end) - 1) / width))).alias("bucket")
    left = a.select(*keys, *[F.col(c).alias("a_" + c) for c in a.columns if c not in keys])
    right = b.select(*keys, *[F.col(c).alias("b_" + c) for c in b.columns if c not in keys])
    pairs = left.select("*", bucket("a_")).join(right.select("*", bucket("b_")), [*keys, "bucket"])
    here = F.floor(F.greatest("a_" + start, "b_" + start) / width) == F.col("bucket")
    return pairs.where((F.col("a_" + start) < F.col("b_" + end)) & (F.col("a_" + end) > F.col("b_" + start)) & here).drop("bucket")


def islands(df: DataFrame, keys: Sequence[str], start: str, end: str, gap: int, order: Sequence[str] = ()) -> DataFrame:
    """Adds ``island``: rows whose start is at most ``gap`` after the furthest end before them belong together."""
    w = W.partitionBy(*keys).orderBy(start, end, *order)
    before = F.max(end).over(w.rowsBetween(W.unboundedPreceding, -1))
    new = F.when(before.isNull() | (F.col(start) > before + gap), 1).otherwise(0)
    return df.withColumn("new", new).withColumn("island", F.sum("new").over(w.rowsBetween(W.unboundedPreceding, 0))).drop("new")


def gaps(df: DataFrame, keys: Sequence[str], start: str, end: str, least: int) -> DataFrame:
    """Stretches of at least ``least`` between the furthest end so far and the next start."""
    w = W.partitionBy(*keys).orderBy(start, end)
    before = F.max(end).over(w.rowsBetween(W.unboundedPreceding, -1))
    return df.select(*keys, before.alias("gap_start"), F.col(start).alias("gap_end")).where(F.col("gap_end") - F.col("gap_start") >= least)


def schedule(df: DataFrame, key: str, more_spans: bool = True) -> DataFrame:
    """The set of disjoint spans with the greatest sum of ``score ** 3`` within each key.

    Ties go to more spans, or with ``more_spans`` off to fewer, then to the earlier set.
    Columns ``start, end, score`` are read; rows come back whole.  Spans that no chain
    of overlaps joins never bear on each other, so a record is cut into pieces of 1024
    such stretches; only one unbroken chain of overlaps is held whole.
    """
    def best(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["end", "start", "score"], ascending=[True, True, False], kind="stable").reset_index(drop=True)
        ends = pdf["end"].to_numpy()
        sign = 1 if more_spans else -1
        total: list[tuple[float, int]] = [(0.0, 0)]
        take: list[int] = []
        prev = np.searchsorted(ends, pdf["start"].to_numpy(), side="right")
        for i, s in enumerate(pdf["score"]):
            p = min(int(prev[i]), i)
            with_it = (round(total[p][0] + float(s) ** 3, 12), total[p][1] + sign)
            take.append(p if with_it > total[-1] else -1)
            total.append(max(with_it, total[-1]))
        keep, i = [], len(pdf)
        while i:
            if take[i - 1] >= 0:
                keep.append(i - 1)
                i = take[i - 1]
            else:
                i -= 1
        return pdf.iloc[keep[::-1]]

    apart = islands(df, [key], "start", "end", -1)
    pieces = apart.withColumn("island", F.floor(F.col("island") / 1024))
    return pieces.groupBy(key, "island").applyInPandas(lambda pdf: best(pdf.drop(columns="island")), df.schema)


def bio_tags(words: DataFrame, entities: DataFrame, key: str) -> DataFrame:
    """A tag for each word: ``B-`` for the first word of the entity that overlaps it, ``I-`` for others, ``O`` outside.

    A word that two entities share fails the query.
    """
    e = entities.select(key, F.col("start").alias("es"), F.col("end").alias("ee"), "type")
    hit = words.join(e, key, "left").where("es IS NULL OR (start < ee AND end > es)")
    first = W.partitionBy(key, "es", "ee", "type").orderBy("start")
    tagged = hit.where("es IS NOT NULL").withColumn("tag", F.concat(F.when(F.row_number().over(first) == 1, "B-").otherwise("I-"), "type"))
    one = tagged.groupBy(key, "start", "end").agg(F.when(F.count("*") > 1, F.raise_error(F.lit("two entities share a word"))).otherwise(F.min("tag")).alias("tag"))
    return words.join(one, [key, "start", "end"], "left").withColumn("tag", F.coalesce("tag", F.lit("O")))


def bio_runs(tagged: DataFrame, key: str) -> DataFrame:
    """Entities of tagged words: ``I-`` after another type begins a run, as ``B-`` does."""
    w = W.partitionBy(key).orderBy("start")
    kind = F.regexp_extract("tag", "^[BI]-(.*)$", 1)
    t = tagged.withColumn("type", kind).withColumn("before", F.lag("type").over(w))
    t = t.withColumn("head", (F.col("type") != "") & (F.col("tag").startswith("B-") | F.col("before").isNull() | (F.col("before") != F.col("type"))))
    t = t.withColumn("run", F.sum(F.col("head").cast("int")).over(w.rowsBetween(W.unboundedPreceding, 0))).where("type <> ''")
    return t.groupBy(key, "run", "type").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("run")


def occurrences(text: Column, needle: Column) -> Column:
    """0-based starts of all non-overlapping occurrences."""
    parts = F.split(text, F.regexp_replace(needle, r"[^\p{L}\p{N}\s]", r"\\$0"), -1)
    return F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda i: F.aggregate(F.slice(parts, 1, i), F.lit(0), lambda a, p: a + F.length(p)) + (i - 1) * F.length(needle))
