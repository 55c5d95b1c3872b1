"""Prompts in batches for models, and answers from a cache first.

A model is a function from a list of texts to a list of answers; nothing here knows
which one.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WIDTHS = [512, 768, 1024, 1536]


def pack_prompts(prompts: DataFrame, key: str, length: str, batch_size: int = 12, output_tokens: int = 0, most_tokens: int | None = 16384, widths: Sequence[int] = WIDTHS) -> DataFrame:
    """``(key, length, batch)``: prompts of like length together, each batch within its rows and padded tokens.

    Prompts are range-partitioned by width and length and packed in one pass over each
    partition, so batches end at partition borders.  A prompt over the limit is a batch
    of its own.
    """
    bucket = F.lit(len(widths))
    for i, w in reversed(list(enumerate(widths))):
        bucket = F.when(F.col(length) <= w, i).otherwise(bucket)
    order = ["_bucket", length, key]
    d = prompts.select(key, length).withColumn("_bucket", bucket).repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id())

    def pack(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = widest = number = 0
        for f in frames:
            out = []
            for n in f[length]:
                n = int(n)
                over = most_tokens is not None and (max(widest, n) + output_tokens) * (rows + 1) > most_tokens
                if rows and (rows == batch_size or over):
                    rows, widest, number = 0, 0, number + 1
                rows, widest = rows + 1, max(widest, n)
                out.append(number)
            yield pd.DataFrame({key: f[key], length: f[length], "batch": [f"{p}-{b}" for p, b in zip(f["_part"], out, strict=True)]})

    return d.mapInPandas(pack, f"`{key}` {d.schema[key].dataType.simpleString()}, `{length}` {d.schema[length].dataType.simpleString()}, batch string")


def answer(requests: DataFrame, cache: DataFrame, model: Callable[[list[str]], list[str]], path: str, valid: str = "answer IS NOT NULL", rows: int = 12) -> tuple[DataFrame, DataFrame]:
    """``(answers, fresh)`` for requests ``(request_id, prompt)`` and a cache ``(request_id, answer)``.

    Only requests without a valid cached answer reach the model, each distinct one once;
    ``fresh`` holds the new valid answers, to be appended to the cache.  They are written
    to ``path`` first, so that using both tables does not ask the model twice.
    """
    known = cache.where(valid).groupBy("request_id").agg(F.max("answer").alias("answer"))
    pending = requests.select("request_id", "prompt").dropDuplicates(["request_id"]).join(known, "request_id", "left_anti")

    def ask(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for lo in range(0, len(f), rows):
                part = f.iloc[lo : lo + rows]
                yield pd.DataFrame({"request_id": part["request_id"], "answer": model(part["prompt"].tolist())})

    schema = f"request_id {requests.schema['request_id'].dataType.simpleString()}, answer string"
    pending.mapInPandas(ask, schema).where(valid).write.mode("overwrite").parquet(path)
    fresh = requests.sparkSession.read.schema(schema).parquet(path)
    return requests.select("request_id").join(known.unionByName(fresh), "request_id", "left"), fresh
