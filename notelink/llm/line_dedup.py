"""Exact line deduplication by sharded minimal perfect hashes (operator 1).

Every text is split at newlines.  A line's key is the line without white space
``[\\x20\\x09-\\x0D]`` at both ends and with A-Z in lower case.  A key of at least
``min_chars`` code points found in at least ``min_docs`` documents loses all its
lines, except those in the largest document id that holds it.

Keys travel as 128-bit XXH3 digests.  All distinct digests, with the number of
different documents that hold them and the largest id, are dealt into shards.  A shard
builds a minimal perfect hash over its digests, which indexes three plain arrays: a
32-bit fingerprint, the document count and the largest id.  Documents are dealt into
blocks; a block probes the arrays once for each distinct digest it holds, so a line in
a third of all documents is probed once per block.  The count array decides; answers
return to the block.  Probes travel to the shard that holds the arrays: an index of
all lines grows with the corpus, so no task could read the whole of it.

Defined cases: a null or empty text is one empty line; rows that share an id, and rows
without one, count as one document; a null id is smaller than any other; ids tie with
themselves, so every row with the largest id keeps its lines; an empty table gives an
empty result; further columns, whatever their names, pass through untouched.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import BLOCK, KIND, WORD_SPACE, column, dealt, keyed, numbered, place, sliced, table, value, with_block, written

MIN_CHARS, MIN_DOCS = 20, 3
BLOCK_BYTES, KEYS_PER_SHARD, LEAST_SHARDS = 6_000_000, 200_000, 64
NO_ID = -(2**63)
_LOWER = {c: c + 32 for c in range(65, 91)}


def _digests(text: str | None, min_chars: int) -> tuple[list[str], list[bytes | None]]:
    lines = (text or "").split("\n")
    out: list[bytes | None] = []
    for line in lines:
        key = line.strip(WORD_SPACE)
        out.append(xxhash.xxh3_128_digest(key.translate(_LOWER).encode("utf-8", "surrogatepass")) if len(key) >= min_chars else None)
    return lines, out


def _halves(digests: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(digests), dtype="<i8").reshape(-1, 2)


# -- minimal perfect hash -------------------------------------------------


def _mix(h: np.ndarray, level: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = h.view(np.uint64) + np.uint64((level * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) & (2**64 - 1))
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def build_mph(h: np.ndarray, load: float = 2.0) -> list[np.ndarray]:
    """Bit vectors, one a level: a key takes its place at the first level where no other key wants it.

    The keys are distinct; its slot is the number of set bits before it.
    """
    levels, rest = [], h
    while len(rest):
        bits = np.zeros(max(64, int(load * len(rest))), dtype=np.uint8)
        at = (_mix(rest, len(levels)) % np.uint64(len(bits))).astype(np.int64)
        wanted = np.bincount(at, minlength=len(bits))
        bits[wanted == 1] = 1
        levels.append(bits)
        rest = rest[wanted[at] != 1]
    return levels


def probe_mph(levels: list[np.ndarray], h: np.ndarray) -> np.ndarray:
    """Slot of each key; any slot or -1 for keys that were not indexed."""
    slot = np.full(len(h), -1, dtype=np.int64)
    open_, base = np.arange(len(h)), 0
    for k, bits in enumerate(levels):
        if not len(open_):
            break
        rank = np.cumsum(bits, dtype=np.int64)
        at = (_mix(h[open_], k) % np.uint64(len(bits))).astype(np.int64)
        hit = bits[at] == 1
        slot[open_[hit]] = base + rank[at[hit]] - 1
        base += int(rank[-1])
        open_ = open_[~hit]
    return slot


# -- stages ---------------------------------------------------------------


def _keys(min_chars: int):
    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            block, ids, n, found = [], [], [], []
            for k, i, t in zip(column(b, BLOCK).to_pylist(), column(b, "id").to_pylist(), column(b, "text").to_pylist(), strict=True):
                own = {d for d in _digests(t, min_chars)[1] if d}
                found += own
                n.append(len(own))
                block.append(k)
                ids.append(NO_ID if i is None else i)
            both = _halves(found)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.repeat(np.array(block, dtype=np.int32), n)), pa.array(np.repeat(np.array(ids, dtype=np.int64), n)), pa.array(both[:, 0].copy()), pa.array(both[:, 1].copy())],
                names=[BLOCK, "id", "h", "f"],
            )

    return fn


def _build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row a shard: the levels and the arrays in slot order."""
    def made(shard: int, parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(parts)
        h, f, n, last = (t.column(c).to_numpy() for c in ("h", "f", "n", "last"))
        # two distinct 128-bit digests may share their first half: the first has the slot, the others are spare
        order = np.lexsort((f, h))
        h, f, n, last = h[order], f[order], n[order], last[order]
        first = np.ones(len(h), dtype=bool)
        first[1:] = h[1:] != h[:-1]
        twins = np.flatnonzero(~first)
        levels = build_mph(h[first])
        at = probe_mph(levels, h[first])
        fp, cnt, ids = np.zeros(len(at), dtype=np.uint32), np.zeros(len(at), dtype=np.uint32), np.zeros(len(at), dtype=np.int64)
        fp[at], cnt[at], ids[at] = f[first].astype(np.uint32), np.minimum(n[first], 2**32 - 1), last[first]
        spare = np.stack([h[twins], f[twins], n[twins], last[twins]]).astype(np.int64)
        return pa.RecordBatch.from_arrays(
            [pa.array([shard], pa.int32()), pa.array([[np.packbits(x).tobytes() for x in levels]], pa.list_(pa.binary())), pa.array([[len(x) for x in levels]], pa.list_(pa.int64())), pa.array([fp.tobytes()], pa.binary()), pa.array([cnt.tobytes()], pa.binary()), pa.array([ids.tobytes()], pa.binary()), pa.array([spare.tobytes()], pa.binary())],
            names=["shard", "bits", "sizes", "fp", "cnt", "ids", "spare"],
        )

    shard, parts = None, []
    for b in sliced(batches, ["shard"]):
        if value(b, "shard") != shard and parts:
            yield made(shard, parts)
            parts = []
        shard = value(b, "shard")
        parts.append(b)
    if parts:
        yield made(shard, parts)


def _probe(min_docs: int):
    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, index = None, None
        for b in sliced(batches, ["shard", KIND]):
            if value(b, KIND) == 0:
                shard = value(b, "shard")
                levels = [np.unpackbits(np.frombuffer(x, dtype=np.uint8))[:n] for x, n in zip(value(b, "bits"), value(b, "sizes"), strict=True)]
                index = (levels, np.frombuffer(value(b, "fp"), dtype=np.uint32), np.frombuffer(value(b, "cnt"), dtype=np.uint32), np.frombuffer(value(b, "ids"), dtype=np.int64), np.frombuffer(value(b, "spare"), dtype=np.int64).reshape(4, -1))
                continue
            if value(b, "shard") != shard:
                continue  # the shard indexes no key
            block, h, f = (column(b, c).to_numpy(zero_copy_only=False) for c in (BLOCK, "h", "f"))
            levels, fp, cnt, ids, spare = index
            at = probe_mph(levels, h)
            ok = at >= 0
            ok[ok] = (fp[at[ok]] == f[ok].astype(np.uint32)) & (cnt[at[ok]] >= min_docs)
            last = ids[np.where(ok, at, 0)] if len(ids) else np.zeros(len(h), dtype=np.int64)
            for hh, ff, nn, ll in spare.T:
                twin = (h == hh) & (f == ff)
                ok, last = np.where(twin, nn >= min_docs, ok), np.where(twin, ll, last)
            yield pa.RecordBatch.from_arrays([pa.array(block[ok].astype(np.int32)), pa.array(h[ok]), pa.array(f[ok]), pa.array(last[ok])], names=[BLOCK, "h", "f", "last"])

    return fn


def _apply(min_chars: int, digest_only: bool):
    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, last = None, {}
        for b in sliced(batches, [BLOCK, KIND]):
            if value(b, BLOCK) != block:
                block, last = value(b, BLOCK), {}
            if value(b, KIND) == 0:
                both = np.stack([column(b, "h").to_numpy(), column(b, "f").to_numpy()], axis=1).astype("<i8").tobytes()
                last.update(zip((both[i : i + 16] for i in range(0, len(both), 16)), column(b, "last").to_pylist(), strict=True))
                continue
            n, dropped, kept, sha = [], [], [], []
            for i, t in zip(column(b, "id").to_pylist(), column(b, "text").to_pylist(), strict=True):
                lines, keys = _digests(t, min_chars)
                i = NO_ID if i is None else i
                stay = [x for x, k in zip(lines, keys, strict=True) if k is None or last.get(k, i) == i]
                n.append(len(lines))
                dropped.append(len(lines) - len(stay))
                text = "\n".join(stay)
                if digest_only:
                    sha.append(hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest())
                else:
                    kept.append(text)
            yield pa.RecordBatch.from_arrays(
                [column(b, "id"), *([] if digest_only else [column(b, "row")]), pa.array(n, pa.int64()), pa.array(dropped, pa.int64()), pa.array(sha if digest_only else kept, pa.string())],
                names=["id", *([] if digest_only else ["row"]), "n_lines", "n_dropped", "kept_sha256" if digest_only else "kept"],
            )

    return fn


def _run(docs: DataFrame, id_col: str, text_col: str, min_chars: int, min_docs: int, digest_only: bool) -> DataFrame:
    other = [c for c in numbered(docs).columns if c != place(docs, text_col)]
    base = keyed(docs, id_col, text_col, *([] if digest_only else [F.struct(*other).alias("row")]))
    base = with_block(base, BLOCK_BYTES)
    keys = written(base.select(BLOCK, "id", "text").mapInArrow(_keys(min_chars), f"{BLOCK} int, id long, h long, f long"), "linekeys")
    shards = max(LEAST_SHARDS, -(-keys.count() // KEYS_PER_SHARD))
    shard = F.pmod(F.col("h"), F.lit(shards)).cast("int").alias("shard")
    lines = keys.groupBy("h", "f").agg(F.countDistinct("id").alias("n"), F.max("id").alias("last"))
    index = dealt(lines.select(shard, "h", "f", "n", "last"), "shard").mapInArrow(_build, "shard int, bits array<binary>, sizes array<long>, fp binary, cnt binary, ids binary, spare binary")
    asked = keys.select(BLOCK, "h", "f").distinct().select(shard, F.lit(1).alias(KIND), BLOCK, "h", "f")
    both = index.withColumn(KIND, F.lit(0)).unionByName(asked, allowMissingColumns=True)
    hits = dealt(both, "shard", KIND).mapInArrow(_probe(min_docs), f"{BLOCK} int, h long, f long, last long")
    stream = hits.withColumn(KIND, F.lit(0)).unionByName(base.withColumn(KIND, F.lit(1)), allowMissingColumns=True)
    out = T.StructType().add("id", "long")
    if not digest_only:
        out = out.add(base.schema["row"])
    return dealt(stream, BLOCK, KIND).mapInArrow(_apply(min_chars, digest_only), out.add("n_lines", "long").add("n_dropped", "long").add("kept_sha256" if digest_only else "kept", "string"))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """The documents with repeated lines gone from ``text_col``; all other columns as they were."""
    out, text = _run(docs, id_col, text_col, min_chars, min_docs, False), place(docs, text_col)
    return out.select(*[F.col("kept").alias(c) if c == text else F.col(f"row.{c}").alias(c) for c in numbered(docs).columns]).toDF(*docs.columns)


def line_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """``(doc_id, n_lines, n_dropped, kept_sha256)`` of :func:`dedup_lines`."""
    return _run(docs, id_col, text_col, min_chars, min_docs, True).withColumnRenamed("id", "doc_id")


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_report(table(spark, sf_dir, "documents"))


ORACLE_SQL = r"""
WITH l AS (
  SELECT doc_id, i, x AS line, translate(trim(x, chr(32)||chr(9)||chr(10)||chr(11)||chr(12)||chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS x, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i FROM documents)
), often AS (
  SELECT key, max(doc_id) AS last FROM l WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3
)
SELECT l.doc_id, count(*) AS n_lines, count(*) FILTER (WHERE o.key IS NOT NULL AND o.last <> l.doc_id) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE o.key IS NULL OR o.last = l.doc_id), '')) AS kept_sha256
FROM l LEFT JOIN often o ON o.key = l.key GROUP BY l.doc_id
"""
