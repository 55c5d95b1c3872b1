"""Shared plumbing of the training-data operators.

Two ideas recur.  A *written table* cuts lineage: it goes to the folder the
cluster names in ``spark.checkpoint.dir``, so a lost executor costs a re-read and
never a recomputation of everything before.  A *block stream* brings bounded side
data to documents: documents are dealt by a hash of id and text into blocks of a few
megabytes, side rows carry the block they are meant for, and one Arrow generator
sees, for every block, first the side rows and then the documents.
"""

from __future__ import annotations

import atexit
import math
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BLOCK = "__nl_block"
KIND = "__nl_kind"
WORD_SPACE = " \t\n\x0b\x0c\r"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from ``spark.checkpoint.dir``.

    Where it is unset a temporary folder serves a local session; on a cluster that would
    be another folder on every machine, so it is an error there.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        path = getattr(spark, "_nl_shared", None)
        if not path:
            if not spark.sparkContext.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            path = tempfile.mkdtemp(prefix="notelink-")
            spark._nl_shared = path
    return path.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and return the table read back."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/nl-{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    atexit.register(_drop, spark, path)
    out = spark.read.schema(df.schema).parquet(path)
    out._nl_path = path
    return out


def discard(df: DataFrame) -> None:
    """Delete a written table that nothing reads any more."""
    _drop(df.sparkSession, df._nl_path)


def _drop(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the session is gone already
        pass


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def numbered(df: DataFrame) -> DataFrame:
    """The same rows under names by place (``c0``, ``c1``, ...), so that no name of the caller's can clash with ours."""
    return df.toDF(*[f"c{i}" for i in range(len(df.columns))])


def place(df: DataFrame, name: str) -> str | None:
    """The name in :func:`numbered` of a column: by exact name, else in any case; None if missing."""
    same = [i for i, c in enumerate(df.columns) if c == name] or [i for i, c in enumerate(df.columns) if c.lower() == name.lower()]
    return f"c{same[0]}" if same else None


def spread(df: DataFrame) -> DataFrame:
    """``df`` over all cores where it comes in fewer files than there are cores; many files are read as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if len(df.inputFiles()) < cores else df


def keyed(df: DataFrame, id_col: str, text_col: str, *more) -> DataFrame:
    """``(id, text)`` of the rows, and ``more`` columns made of :func:`numbered` names, over all cores."""
    d = numbered(df)
    return spread(d.select(F.col(place(df, id_col)).cast("long").alias("id"), F.col(place(df, text_col)).cast("string").alias("text"), *more))


def with_block(df: DataFrame, bytes_per_block: int) -> DataFrame:
    """Add the block number to rows ``(id, text, ...)``: blocks hold about so many bytes of text.

    The number is a hash of id and text, so a hot source, rows without an id and
    different texts of one id all spread evenly.
    """
    total = df.agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + 64)).first()[0] or 0
    k = max(1, math.ceil(total / bytes_per_block))
    return df.withColumn(BLOCK, F.pmod(F.xxhash64("id", "text"), F.lit(k)).cast("int"))


def dealt(df: DataFrame, *keys: str, order: tuple[str, ...] = ()) -> DataFrame:
    """Hash-partition by the first key and sort the partitions by all of them."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(n, keys[0]).sortWithinPartitions(*keys, *order)


def salted_join(left: DataFrame, right: DataFrame, key: str, by: list[str]) -> DataFrame:
    """Left join on ``key``, where one key may hold any share of the left rows.

    Keys with more than a quarter of an even partition are hot: at most four times the
    number of partitions, so their list is broadcast.  A hot key's left rows are dealt
    over as many salts as it fills quarters, and its right rows are copied to each.
    ``by`` names the left columns whose hash deals the rows.
    """
    parts = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    counts = left.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("__n"))
    quarter = max(1000.0, (left.count() or 0) / (4 * parts))
    hot = F.broadcast(counts.where(F.col("__n") > quarter).select(key, F.ceil(F.col("__n") / quarter).cast("int").alias("__salts")))
    a = left.join(hot, key, "left").withColumn("__salt", F.coalesce(F.pmod(F.xxhash64(*by), "__salts"), F.lit(0)).cast("int")).drop("__salts")
    b = right.join(hot, key, "left").withColumn("__salt", F.explode(F.sequence(F.lit(0), F.coalesce("__salts", F.lit(1)) - 1))).drop("__salts")
    return a.join(b, [key, "__salt"], "left").drop("__salt")


def runs(*columns: np.ndarray) -> np.ndarray:
    """Starts of the runs of equal keys, with the end appended."""
    n = len(columns[0])
    if not n:
        return np.zeros(1, dtype=np.int64)
    change = np.zeros(n, dtype=bool)
    change[0] = True
    for c in columns:
        change[1:] |= c[1:] != c[:-1]
    return np.append(np.flatnonzero(change), n)


def sliced(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.RecordBatch]:
    """Batches cut so that each holds rows of one key only; a key may span several."""
    for b in batches:
        cuts = runs(*[b.column(b.schema.get_field_index(k)).to_numpy(zero_copy_only=False) for k in keys])
        for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
            yield b.slice(int(lo), int(hi - lo))


def value(batch: pa.RecordBatch, name: str, row: int = 0):
    return batch.column(batch.schema.get_field_index(name))[row].as_py()


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def components(edges: DataFrame, name: str = "cc") -> DataFrame:
    """Connected components of ``edges(a long, b long)`` as ``(node, root)``, root the smallest node.

    Alternating large-star and small-star steps; a step replaces every edge by one
    edge at most, so a hub of any size costs as many rows as it has edges.  Minima
    are partial aggregates and the joins are splittable by adaptive execution.
    """
    def shape(df: DataFrame) -> DataFrame:
        return df.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()

    def mark(df: DataFrame) -> tuple:
        r = df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        return r[0], r[1]

    e = written(shape(edges.select(F.col("a").cast("long").alias("u"), F.col("b").cast("long").alias("v"))), name)
    before = mark(e)
    while before[0]:
        sym = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = sym.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = shape(sym.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")))
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        was, e = e, written(shape(small.unionByName(least.select("u", F.col("m").alias("v")))), name)
        discard(was)
        after = mark(e)
        if after == before:
            break
        before = after
    roots = e.groupBy("u").agg(F.min("v").alias("root")).select(F.col("u").alias("node"), "root")
    return roots.unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
