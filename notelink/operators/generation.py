"""Schedules and batches around a generating model; the model itself is a function given by the caller."""

from __future__ import annotations

import time
from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T


def schedule(slots: DataFrame, shares: Sequence[tuple[str, int]], seed: int) -> DataFrame:
    """``slots(slot)`` with a ``focus`` each: as many of each as its share says, in the order of a seeded hash; slots beyond the shares go round.

    Slots are numbered from 0, so a slot's focus follows from its number alone: no sort of all slots.
    """
    names = [n for n, k in shares for _ in range(k)]
    order = sorted(range(len(names)), key=lambda i: hash_of(seed, i))
    listed = F.array(*[F.lit(names[i]) for i in order])
    return slots.withColumn("focus", F.element_at(listed, (F.col("slot") % len(names) + 1).cast("int")))


def hash_of(seed: int, i: int) -> int:
    x = (i * 0x9E3779B97F4A7C15 + seed * 0xBF58476D1CE4E5B9 + 1) % 2**64
    return (x ^ x >> 29) * 0x94D049BB133111EB % 2**64


def weighted_choice(key: Column, options: Sequence[tuple[str, float]], seed: int) -> Column:
    """One option by weight and a seeded hash of the key; options without weight are never chosen."""
    options = [(n, w) for n, w in options if w > 0]
    total, below = sum(w for _, w in options), 0.0
    u = F.pmod(F.xxhash64(F.lit(seed), key), F.lit(1_000_000)) / F.lit(1_000_000.0)
    out = F.lit(options[-1][0])
    bounds = []
    for name, w in options:
        below += w / total
        bounds.append((name, below))
    for name, bound in reversed(bounds[:-1]):
        out = F.when(u < bound, name).otherwise(out)
    return out


def budget(length: Column, bounds: Sequence[tuple[int, int]], most: int) -> Column:
    """Tokens to allow: that of the first bound the length is within, else ``most``."""
    out = F.lit(most)
    for upper, tokens in reversed(bounds):
        out = F.when(length <= upper, tokens).otherwise(out)
    return out


def batched(df: DataFrame, order: Sequence[str], size: int, groups: int = 64) -> DataFrame:
    """``batch`` numbers of at most ``size`` rows; rows are dealt into groups by a hash, so no task sees all of them."""
    g = F.pmod(F.xxhash64(*order), F.lit(groups))
    w = W.partitionBy("_g").orderBy(*order)
    return df.withColumn("_g", g).withColumn("batch", F.concat_ws("-", "_g", F.floor((F.row_number().over(w) - 1) / size).cast("string"))).drop("_g")


def within_limit(prompts: DataFrame, tokens: str, limit: int) -> tuple[DataFrame, DataFrame]:
    """Prompts a model can take, and those that are too long."""
    return prompts.where(F.col(tokens) <= limit), prompts.where(F.col(tokens) > limit)


def final_answer(text: Column) -> Column:
    """A continuation without the block in which a model thinks aloud, closed or left open."""
    return F.trim(F.regexp_replace(F.regexp_replace(text, r"(?s)<think>.*?</think>", ""), r"(?s)<think>.*$", ""))


def completed(prompts: DataFrame, model: Callable[[str], str], tries: int = 3, wait: float = 0.0) -> DataFrame:
    """``(key, answer, attempts, error)``: each prompt is tried up to ``tries`` times, waiting twice as long each time; a failure stays with its row."""
    def one(p: str) -> dict:
        error = None
        for k in range(tries):
            try:
                return {"answer": model(p), "attempts": k + 1, "error": None}
            except Exception as e:  # tried again, then carried by the row
                error = str(e)
                time.sleep(wait * 2**k)
        return {"answer": None, "attempts": tries, "error": error}

    @F.pandas_udf(T.StructType().add("answer", "string").add("attempts", "integer").add("error", "string"))
    def of(s: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([one(p) for p in s], columns=["answer", "attempts", "error"])

    return prompts.select("key", of("prompt").alias("r")).select("key", "r.*")


def retried(items: DataFrame, work: Callable[[DataFrame, int], DataFrame], sound: str, rounds: int = 3) -> DataFrame:
    """Rounds of work on what has no sound result yet; ``work`` keeps ``key`` and the rows that never succeed keep their last result."""
    done, left = None, items
    for k in range(rounds):
        out = work(left, k).withColumn("round", F.lit(k))
        good = out.where(sound) if k < rounds - 1 else out
        done = good if done is None else done.unionByName(good)
        left = left.join(good.select("key"), "key", "left_anti")
    return done


def drawn(pool: DataFrame, wanted: Sequence[str], n: int, seed: int) -> DataFrame:
    """``n`` rows of the wanted chapters by a seeded hash; if they are fewer, rows of the other chapters fill up."""
    return pool.orderBy(~F.col("chapter").isin(list(wanted)), F.xxhash64(F.lit(seed), "code"), "code").limit(n)


HOOKS: dict[str, Callable] = {}


def hook(name: str, fn: Callable | None = None) -> Callable:
    """Sets or gets the function for an outside part (``segment``, ``detect``, ``encode``, ``generate``); an unset one is an error."""
    if fn is not None:
        HOOKS[name] = fn
    if name not in HOOKS:
        raise KeyError(f"no function is set for {name}")
    return HOOKS[name]
