"""Predictions over chunks of words: cutting, marginals, one winner a word, one entity a span, flags.

Rows are joined and aggregated; what depends on the words before it (a tie between
chunks, greedy choice) runs over one record's array in an Arrow function.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .assertions import FAMILY, HISTORICAL, NEGATED

PRIORITY = [NEGATED, FAMILY, HISTORICAL]
RESCUE, LOW, SHORT, OVERLAP = 0.82, "low_emission_confidence", "short_span_review", "chunk_overlap_review"
EPSILON = 1e-12


def chunks_of(sizes: list[int], most: int, overlap: int) -> list[tuple[int, int]]:
    out, start = [], 0
    ends = np.cumsum(np.maximum(sizes, 1)) if len(sizes) else np.zeros(0)
    while start < len(sizes):
        before = ends[start - 1] if start else 0
        end = max(start + 1, int(np.searchsorted(ends, before + most, side="right")))
        out.append((start, end))
        if end >= len(sizes):
            break
        start = max(start + 1, end - overlap)
    return out


def word_chunks(sizes: Column, most: int = 256, overlap: int = 32) -> Column:
    """``array<struct<start,end>>``: stretches of words of at most ``most`` - 2 pieces that share ``overlap`` words; a longer word stands alone."""
    @F.pandas_udf("array<struct<start:int,end:int>>")
    def of(s: pd.Series) -> pd.Series:
        return s.map(lambda x: None if x is None else [{"start": a, "end": b} for a, b in chunks_of(list(x), most - 2, overlap)])

    return of(sizes)


def marginals(emissions: np.ndarray, moves: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Exact tag probabilities of a linear chain, by sums in log space from both sides."""
    def total(x: np.ndarray, axis: int) -> np.ndarray:
        top = x.max(axis=axis, keepdims=True)
        return (top + np.log(np.exp(x - top).sum(axis=axis, keepdims=True))).squeeze(axis)

    n = len(emissions)
    ahead, back = np.empty_like(emissions), np.empty_like(emissions)
    ahead[0], back[-1] = start + emissions[0], end
    for t in range(1, n):
        ahead[t] = total(ahead[t - 1][:, None] + moves, 0) + emissions[t]
        back[n - 1 - t] = total(moves + (emissions[n - t] + back[n - t])[None, :], 1)
    both = ahead + back
    p = np.exp(both - both.max(axis=1, keepdims=True))
    return p / p.sum(axis=1, keepdims=True)


def chain_marginals(emissions: Column, moves: list[list[float]], start: list[float], end: list[float]) -> Column:
    m, a, b = np.array(moves), np.array(start), np.array(end)

    @F.pandas_udf("array<array<double>>")
    def of(s: pd.Series) -> pd.Series:
        return s.map(lambda x: [] if x is None or not len(x) else marginals(np.array([list(r) for r in x], dtype=float), m, a, b).tolist())

    return of(emissions)


def follows(before: str, tag: str) -> bool:
    """Whether a tag may stand after another: outside and beginnings anywhere, insides after their own type."""
    kind, _, name = tag.partition("-")
    return tag == "O" or (kind == "B" and bool(name)) or (kind == "I" and bool(name) and before[:2] in ("B-", "I-") and before[2:] == name)


def word_winners(predictions: DataFrame) -> DataFrame:
    """``(record_id, word, tag, confidence)`` from ``(record_id, chunk, word, edge, tag, confidence)``.

    Farther from the chunk's edge wins, then confidence, then a tag that may follow the
    word before, then the earlier chunk.  Only the best by the first two are gathered.
    """
    best = W.partitionBy("record_id", "word")
    p = predictions.withColumn("_e", F.max("edge").over(best)).where("edge = _e").withColumn("_c", F.max("confidence").over(best)).where(F.col("confidence") >= F.col("_c") - EPSILON)
    words = p.groupBy("record_id", "word").agg(F.array_sort(F.collect_list(F.struct("chunk", "tag", "confidence"))).alias("o"))
    line = words.groupBy("record_id").agg(F.array_sort(F.collect_list(F.struct("word", "o"))).alias("w"))

    @F.pandas_udf("array<struct<word:int,tag:string,confidence:double>>")
    def walk(s: pd.Series) -> pd.Series:
        def one(ws):
            out, before, last = [], "O", None
            for w in ws:
                before = before if last is not None and w["word"] == last + 1 else "O"
                pick = next((o for o in w["o"] if follows(before, o["tag"])), w["o"][0])
                out.append({"word": w["word"], "tag": pick["tag"], "confidence": pick["confidence"]})
                before, last = pick["tag"], w["word"]
            return out

        return s.map(one)

    return line.select("record_id", F.explode(walk("w")).alias("x")).select("record_id", "x.*")


def entity_scores(entities: DataFrame, words: DataFrame) -> DataFrame:
    """Entities ``(record_id, first, last)`` with the mean confidence of their words, 0 for words without one."""
    hit = entities.join(words.select("record_id", "word", "confidence"), "record_id").where("word >= first AND word <= last")
    sums = hit.groupBy("record_id", "first", "last").agg(F.sum("confidence").alias("_s"))
    return entities.join(sums, ["record_id", "first", "last"], "left").withColumn("score", F.coalesce("_s", F.lit(0.0)) / (F.col("last") - F.col("first") + 1)).drop("_s")


def mean_assertions(votes: DataFrame, thresholds: dict[str, float], default: float = 0.5, single: bool = False) -> DataFrame:
    """``(record_id, first, last, type, assertions)`` from ``(..., label, probability, weight)``: weighted means at their threshold or above; with ``single`` the first by priority."""
    g = votes.groupBy("record_id", "first", "last", "type", "label").agg((F.sum(F.col("weight") * F.col("probability")) / F.sum("weight")).alias("p"))
    least = F.lit(default)
    for label, t in thresholds.items():
        least = F.when(F.col("label") == label, t).otherwise(least)
    said = g.groupBy("record_id", "first", "last", "type").agg(F.collect_set(F.when((F.col("p") >= least) & (F.col("label") != "NONE"), F.col("label"))).alias("s"))
    ordered = F.filter(F.array(*map(F.lit, PRIORITY)), lambda x: F.array_contains("s", x))
    return said.withColumn("assertions", F.slice(ordered, 1, 1) if single else ordered).drop("s")


def best_spans(spans: DataFrame) -> DataFrame:
    """The highest score of each ``(record_id, start, end, type)``."""
    return spans.groupBy("record_id", "start", "end", "type").agg(F.max("score").alias("score"))


def rescued(entities: DataFrame, spans: DataFrame, least: float = RESCUE) -> DataFrame:
    """Entities and, best first, the spans of at least ``least`` that overlap nothing kept."""
    taken = entities.groupBy("record_id").agg(F.collect_list(F.struct("start", "end")).alias("t"))
    s = spans.where(F.col("score") >= least).groupBy("record_id").agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("rank"), "start", "end", "type"))).alias("s")).join(taken, "record_id", "left")
    none = F.array().cast("array<struct<start:int,end:int>>")
    state = F.struct(F.coalesce("t", none).cast("array<struct<start:int,end:int>>").alias("t"), F.array().cast("array<struct<start:int,end:int,type:string,score:double>>").alias("out"))

    def step(a, x):
        free = ~F.exists(a["t"], lambda o: (x["start"] < o["end"]) & (x["end"] > o["start"]))
        span = F.struct(x["start"].cast("int").alias("start"), x["end"].cast("int").alias("end"))
        row = F.struct(span["start"].alias("start"), span["end"].alias("end"), x["type"].alias("type"), (-x["rank"]).cast("double").alias("score"))
        return F.when(free, F.struct(F.array_append(a["t"], span).alias("t"), F.array_append(a["out"], row).alias("out"))).otherwise(a)

    new = s.select("record_id", F.explode(F.aggregate("s", state, step, lambda a: a["out"])).alias("x")).select("record_id", "x.*", F.lit(True).alias("rescued"))
    return entities.select("record_id", "start", "end", "type", "score", F.lit(False).alias("rescued")).unionByName(new)


def score_of(c: Column) -> Column:
    """A score given as text; 0 where it is none."""
    return F.coalesce(c.cast("string").try_cast("double"), F.lit(0.0))


def merged_chunks(entities: DataFrame) -> DataFrame:
    """One row a ``(record_id, start, end, type)``: the best score, all assertions in order, and a flag where another span of the type overlaps.

    ``entities(record_id, chunk, start, end, type, score, assertions)``.  Alternatives
    that overlap all stay.
    """
    g = entities.groupBy("record_id", "start", "end", "type").agg(F.max("score").alias("score"), F.array_distinct(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("chunk", "assertions"))), lambda x: x["assertions"]))).alias("assertions"))
    by = W.partitionBy("record_id", "type").orderBy("start", "end")
    before, after = F.max("end").over(by.rowsBetween(W.unboundedPreceding, -1)), F.lead("start").over(by)
    return g.withColumn("flag", F.when((before > F.col("start")) | (after < F.col("end")), OVERLAP))


def checked_entities(entities: DataFrame, low: float = 0.80) -> DataFrame:
    """Adds ``reason`` (why it goes, or null) and ``flag``; trailing open brackets and dashes are cut off text and end."""
    has = lambda c: c.rlike("[0-9A-Za-zÀ-ỹ]")
    text = F.col("text")
    cut = F.regexp_replace(text, r"\s*[\(\[\{–\-]+\s*$", "")
    new = F.when(has(text) & (cut != ""), cut).otherwise(text)
    d = entities.withColumn("_t", new).withColumn("reason", F.when(~has(text), "punct_only").when((F.col("_t") != text) & ~has(F.col("_t")), "unbalanced_bracket_emptied"))
    d = d.withColumn("end", F.col("end") - (F.length(text) - F.length("_t"))).withColumn("text", F.col("_t")).drop("_t")
    short = F.length(F.regexp_replace("text", r"\s+", "")) <= 2
    return d.withColumn("flag", F.when(F.col("reason").isNull(), F.when(short, SHORT).when(F.coalesce("score", F.lit(1.0)) < low, LOW)))
