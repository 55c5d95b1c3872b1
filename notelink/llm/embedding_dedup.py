"""Embedding near-duplicates by sorted projection passes (operator 9).

Vectors are compared only within one label.  In each pass every vector gets the
signs of ``hash_bits`` random projections, most significant first; rows are sorted
by (label, signs) over a range partitioning, and each row is compared with its next
``window`` neighbours; the first and last ``window`` rows of every partition are
compared once more in order, so partition borders hide none.  The number of passes
grows with the largest label (:func:`passes_for`).

A pass ships one signed byte a component, a quarter of the vector.  Pairs whose cosine
by those bytes is within ``MARGIN`` of the threshold or above it unite candidate groups
over all passes.  Within a candidate group every pair is then verified in double precision
on the vectors themselves, in blocks of bounded size, which gives each vector's links
exactly and the verified pairs that a star contraction unites.  So the window bounds what
is met, never what a dense group counts.

Equal vectors of one label (by a 128-bit digest) are one class with a multiplicity, never
pairs.

Defined cases: a null label or vector, a zero vector, and one with null or
non-finite parts link with nothing; vectors of different lengths do not link; ids
that tie keep a row each; other columns are never read, whatever their names; an empty
table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import column, components, dealt, numbered, place, salted_join, sliced, table, value, written

THRESHOLD, PASSES, WINDOW, HASH_BITS, SEED = 0.93, 12, 48, 62, 20240607
MARGIN = 0.015  # bytes are off by a tenth of this (one deviation)
COUNT_BLOCK, SPREAD_BLOCK, SPREAD = 4096, 128, 8  # rows a verified block at most; smaller groups still go over several tasks
RECALL = 0.99  # expected for an isolated pair at the threshold
ORDER = ["pass", "label", "dim", "code", "node"]


def passes_for(rows: int, threshold: float = THRESHOLD, window: int = WINDOW, recall: float = RECALL) -> int:
    """Passes for ``recall``: a pair must share the leading signs that leave ``window`` of ``rows`` evenly spread rows."""
    same = 1 - math.acos(threshold) / math.pi
    once = same ** max(0.0, math.log2(max(rows, 1) / window))
    return PASSES if once >= 1 else max(PASSES, math.ceil(math.log(1 - recall) / math.log(1 - once)))


def _matrix(b: pa.RecordBatch) -> np.ndarray:
    a = column(b, "vec")
    return a.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(a), -1) if len(a) else np.zeros((0, 1))


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)  # squares neither overflow nor vanish
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _bytes(x: np.ndarray) -> pa.Array:
    """Vectors in signed bytes, by their largest component."""
    q = np.rint(x / np.abs(x).max(axis=1, keepdims=True) * 127).astype(np.int8)
    return pa.array([r.tobytes() for r in q], pa.binary())


def _near(b: pa.RecordBatch) -> np.ndarray:
    """Unit vectors of the bytes."""
    a = column(b, "q")
    x = np.frombuffer(b"".join(a.to_pylist()), dtype=np.int8).reshape(len(a), -1).astype(np.float32)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _codes(passes: int, bits: int, seed: int):
    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes: dict[int, np.ndarray] = {}
        weights = (1 << np.arange(bits - 1, -1, -1, dtype=np.int64))
        for b in batches:
            dims = column(b, "dim").to_numpy()
            for dim in np.unique(dims):
                part = pa.RecordBatch.from_arrays([c.filter(pa.array(dims == dim)) for c in b.columns], schema=b.schema)
                if dim not in planes:
                    planes[dim] = np.random.default_rng(seed + int(dim)).standard_normal((passes, bits, int(dim)))
                x = _matrix(part)
                q = _bytes(x)
                for p in range(passes):
                    code = ((x @ planes[dim][p].T) > 0) @ weights
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), p, dtype=np.int32)), column(part, "label"), column(part, "dim"), pa.array(code), column(part, "node"), q], names=["pass", "label", "dim", "code", "node", "q"])

    return fn


def _windows(window: int, threshold: float, borders: bool):
    """Edges, and with ``borders`` also the first and last ``window`` rows of the partition."""

    def edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, tail, tail_id = None, None, None
        for b in sliced(batches, ["pass", "label", "dim"]):
            now = (value(b, "pass"), value(b, "label"), value(b, "dim"))
            x, ids = _near(b), column(b, "node").to_numpy()
            old = 0
            if now == key:
                old = len(tail)
                x, ids = np.concatenate([tail, x]), np.concatenate([tail_id, ids])
            key, tail, tail_id = now, x[-window:], ids[-window:]
            root = np.arange(len(ids))
            pairs = []
            for off in range(1, min(window, len(ids) - 1) + 1):
                lo = max(0, old - off)
                hit = np.flatnonzero(np.einsum("ij,ij->i", x[lo:-off], x[lo + off :]) >= threshold - MARGIN) + lo
                pairs.append(np.stack([hit, hit + off]))
            if not pairs:
                continue
            a, c = np.concatenate(pairs, axis=1)
            while len(a):  # each row takes the least row it is linked with, until nothing moves
                low = np.minimum(root[a], root[c])
                was = root.copy()
                np.minimum.at(root, a, low)
                np.minimum.at(root, c, low)
                if (root == was).all():
                    break
            own = np.flatnonzero(root != np.arange(len(ids)))
            yield pa.RecordBatch.from_arrays([pa.array(ids[own]), pa.array(ids[root[own]])], names=["a", "b"])

    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head: list[pa.RecordBatch] = []
        last: list[pa.RecordBatch] = []
        empty: dict[str, pa.DataType] = {}

        def seen() -> Iterator[pa.RecordBatch]:
            for b in batches:
                empty.update(zip(b.schema.names, b.schema.types, strict=True))
                room = window - sum(map(len, head))
                if room > 0:
                    head.append(b.slice(0, room))
                last.append(b.slice(min(room, len(b))) if room > 0 else b)
                while sum(map(len, last[1:])) >= window:
                    last.pop(0)
                yield b

        for e in edges(seen()):
            yield pa.RecordBatch.from_arrays([*e.columns, *[pa.nulls(len(e), t) for t in empty.values()]], names=["a", "b", *empty])
        rest = sum(map(len, last)) - window
        for b in [*head, *([last[0].slice(max(rest, 0)), *last[1:]] if last else [])]:
            yield pa.RecordBatch.from_arrays([*[pa.nulls(len(b), pa.int64())] * 2, *b.columns], names=["a", "b", *empty])

    return fn if borders else edges


def _forest(close: np.ndarray, same: bool) -> np.ndarray:
    """Spanning pairs ``(row, column)`` of the links of a block with itself or with another, breadth first."""
    left = [np.ones(len(close), bool), np.ones(close.shape[1], bool)]
    sides = (close, close.T)
    if same:
        left[1] = left[0]
    out = [np.zeros((2, 0), dtype=np.int64)]
    for first in range(len(close)):
        if not left[0][first]:
            continue
        left[0][first], todo = False, [(0, first)]
        while todo:
            side, x = todo.pop()
            near = np.flatnonzero(sides[side][x] & left[1 - side])
            if len(near):
                left[1 - side][near] = False
                pair = np.stack([np.full(len(near), x), near])
                out.append(pair if side == 0 else pair[::-1])
                todo += [(0 if same else 1 - side, y) for y in near.tolist()]
    return np.concatenate(out, axis=1)


def _counts(threshold: float):
    """Rows ``(node, n, b)``: the links counted in a block, and (``n`` null) a verified pair."""
    def count(parts: list[pa.RecordBatch], i: int, j: int) -> pa.RecordBatch:
        t = pa.Table.from_batches(parts).combine_chunks().to_batches()[0]
        x, ids, m, blk = _unit(_matrix(t)), column(t, "node").to_numpy(), column(t, "mult").to_numpy(), column(t, "blk").to_numpy()
        n = np.zeros(len(ids), dtype=np.int64)
        a, c = np.flatnonzero(blk == i), np.flatnonzero(blk == j)
        close = np.empty((len(a), len(c)), dtype=bool)
        for lo in range(0, len(a), 512):
            some = a[lo : lo + 512]
            cos = x[some] @ x[c].T
            # sums in another order may differ in the last place: redo those near the border one by one
            near = np.argwhere(np.abs(cos - threshold) < 1e-9)
            cos[near[:, 0], near[:, 1]] = np.einsum("ij,ij->i", x[some[near[:, 0]]], x[c[near[:, 1]]])
            close[lo : lo + 512] = cos >= threshold
        if i == j:
            np.fill_diagonal(close, False)
            n[a] = close @ m[c]
        else:
            n[a] += close @ m[c]
            n[c] += m[a] @ close
        pair = _forest(close, i == j)
        node, other = np.concatenate([ids, ids[a[pair[0]]]]), ids[c[pair[1]]]
        return pa.RecordBatch.from_arrays([pa.array(node), pa.concat_arrays([pa.array(n), pa.nulls(len(other), pa.int64())]), pa.concat_arrays([pa.nulls(len(ids), pa.int64()), pa.array(other)])], names=["node", "n", "b"])

    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, parts = None, []
        for b in sliced(batches, ["root", "i", "j"]):
            now = (value(b, "root"), value(b, "i"), value(b, "j"))
            if now != key and parts:
                yield count(parts, key[1], key[2])
                parts = []
            key = now
            parts.append(b)
        if parts:
            yield count(parts, key[1], key[2])

    return fn


def embedding_groups(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", threshold: float = THRESHOLD, passes: int | None = None, window: int = WINDOW, hash_bits: int = HASH_BITS, seed: int = SEED) -> DataFrame:
    """``(vec_id, n_links, component_id, kept)``, one row a vector."""
    d = numbered(vectors)
    v = d.select(F.col(place(vectors, id_col)).cast("long").alias("id"), F.col(place(vectors, label_col)).cast("long").alias("label"), F.col(place(vectors, vec_col)).alias("vec"))
    inf = float("inf")
    sound = F.col("label").isNotNull() & F.col("vec").isNotNull() & (F.size("vec") > 0) & F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (x < inf) & (x > -inf)) & F.exists("vec", lambda x: x != 0)
    v = v.withColumn("sound", F.coalesce(sound, F.lit(False))).withColumn("vec", F.when(F.col("sound"), F.transform("vec", lambda x: x + F.lit(0.0).cast("float"))))
    for k in ("h", "g"):
        v = v.withColumn(k, F.when(F.col("sound"), F.xxhash64(F.lit(k), "label", "vec")))
    good = v.where("sound")
    classes = good.groupBy("h", "g").agg(F.count("*").alias("mult"), F.min("id").alias("first"), F.first("label").alias("label"), F.first("vec").alias("vec")).withColumn("dim", F.size("vec"))
    classes = written(classes.withColumn("node", F.monotonically_increasing_id()), "classes")
    if passes is None:
        passes = passes_for(classes.groupBy("label", "dim").count().agg(F.max("count")).first()[0] or 0, threshold, window)
    schema = "pass int, label long, dim int, code long, node long, q binary"
    coded = classes.select("label", "dim", "node", "vec").mapInArrow(_codes(passes, hash_bits, seed), schema)
    n = int(v.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    compared = written(coded.repartitionByRange(n, *ORDER).sortWithinPartitions(*ORDER).mapInArrow(_windows(window, threshold, True), f"a long, b long, {schema}"), "vecwindows")
    border = dealt(compared.where("a IS NULL").select(*coded.columns), *ORDER).mapInArrow(_windows(window, threshold, False), "a long, b long")
    edges = compared.where("a IS NOT NULL").select("a", "b").unionByName(border)
    met = written(components(edges, "veccc"), "vecmet")
    size = F.count("*")
    sizes = met.groupBy("root").agg(F.greatest(F.least(F.lit(SPREAD), F.ceil(size / SPREAD_BLOCK)), F.ceil(size / COUNT_BLOCK)).cast("int").alias("blocks"))
    at = classes.select("node", "mult", "vec").join(met, "node").join(sizes, "root")
    at = at.withColumn("blk", F.pmod(F.xxhash64(F.lit(7), "node"), F.col("blocks")).cast("int")).withColumn("o", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    at = at.select("root", F.least("blk", "o").alias("i"), F.greatest("blk", "o").alias("j"), "blk", "node", "mult", "vec").withColumn("b", F.xxhash64("root", "i", "j"))
    verified = written(dealt(at, "b", "root", "i", "j").drop("b").mapInArrow(_counts(threshold), "node long, n long, b long"), "verified")
    counted = verified.where("n IS NOT NULL").groupBy("node").agg(F.sum("n").alias("n"))
    linked = components(verified.where("n IS NULL").select(F.col("node").alias("a"), "b"), "veclinks")
    of = classes.select("node", "h", "g", "mult", "first").join(linked, "node", "left").join(counted, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = of.groupBy("root").agg(F.min("first").alias("component_id"))
    of = of.join(least, "root").select("h", "g", (F.coalesce("n", F.lit(0)) + F.col("mult") - 1).alias("links"), "component_id")
    rows = salted_join(v.select("id", "h", "g"), of.withColumnRenamed("g", "og"), "h", ["id"])
    same = F.col("g") == F.col("og")
    rows = rows.where(F.col("h").isNull() | same).select("id", F.coalesce("links", F.lit(0).cast("long")).alias("links"), F.when(F.col("h").isNull(), F.col("id")).otherwise(F.col("component_id")).alias("component_id"))
    return rows.select(F.col("id").alias("vec_id"), F.col("links").alias("n_links"), "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))


def op9_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_groups(table(spark, sf_dir, "embeddings"))


ORACLE_SQL = """
WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.e, b.e) >= 0.93),
r(a, b) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
c AS (SELECT a AS vec_id, min(b) AS component_id FROM r GROUP BY a),
n AS (SELECT a AS vec_id, count(*) AS n FROM l GROUP BY a)
SELECT c.vec_id, coalesce(n.n, 0) AS n_links, c.component_id, c.vec_id = c.component_id AS kept FROM c LEFT JOIN n USING (vec_id)
"""
