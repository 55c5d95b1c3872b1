"""Lexical retrieval packing (operator 10).

Documents are tokenized once, with the end id added, into a written table of ids.  Document
frequencies, the number and the mean length of all documents come from that table, so
BM25 weights are those of the corpus.  Documents then get a lexical signature: its terms
are drawn by weighted min-hash over the corpus weights (terms of one document only weigh
nothing), so two documents draw the same term with odds that grow with the weight of the
terms they share.  Rows are sorted by signature over a range partitioning and cut into
shards of at most ``shard_docs`` documents and ``SHARD_IDS`` ids: the inverted index is
sharded by lexical likeness, every shard holds what is most alike in the whole corpus,
and a group of copies of any size is cut like all else.

A window of ``length`` ids starts with a seed document; its shard's index ranks the unused
documents by their BM25 score for the seed, and they fill the window in that order.  The
last one is cut at the window's end, and what is left of it seeds the next window.  A
window left open at a shard's end goes on with the next shard of its partition, so only
a partition's last window has padding.

Ids are those of ``tokenizers`` for ``byte_bpe_50k.json``; the same vocabulary is read
as ranks by ``tiktoken``, whose ids are equal (tested) at a fifth of the time.

Defined cases: a null or empty text is the end id alone; the vocabulary's own special
string is its special id, as ``tokenizers`` has it; a text longer than a window is cut
over several; repeated rows and ids are packed each; ties of signature go by id and a
hash of the ids, ties of score by place in the shard; an empty table gives an empty
result; other columns are never read.
"""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import column, keyed, table, written

LENGTH, END_ID, SHARD_DOCS, SHARD_IDS = 2048, 1, 512, 4_000_000
K1, B = 1.2, 0.75
SIGNATURE, SEED = 4, 20240611
SPECIAL = {"<|endoftext|>": 50256}


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


_ENCODINGS: dict = {}


def encoding(path: str):
    """One a Python worker."""
    if path not in _ENCODINGS:
        import public_tokenizers
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _ENCODINGS[path] = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=SPECIAL)
    return _ENCODINGS[path]


def idf(df: np.ndarray, n: int) -> np.ndarray:
    return np.log1p((n - df + 0.5) / (df + 0.5)).astype(np.float32)


class Index:
    """BM25 postings of one shard, by term; weights are ready to be summed."""

    def __init__(self, docs: list[np.ndarray], weights: np.ndarray, mean: float):
        n = np.array([len(d) for d in docs])
        own = [np.unique(d, return_counts=True) for d in docs]
        self.terms = [t.astype(np.int64) for t, _ in own]
        term = np.concatenate(self.terms)
        doc = np.repeat(np.arange(len(docs)), [len(t) for t in self.terms])
        tf = np.concatenate([c for _, c in own]).astype(np.float32)
        order = np.argsort(term, kind="stable")
        term, self.doc, tf = term[order], doc[order], tf[order]
        self.start = np.searchsorted(term, np.arange(term[-1] + 2))
        norm = (K1 * (1 - B + B * n / mean)).astype(np.float32)
        self.weight = weights[term] * tf * np.float32(K1 + 1) / (tf + norm[self.doc])
        self.n = len(docs)

    def scores(self, seed: int) -> np.ndarray:
        t = self.terms[seed]
        lo, size = self.start[t], self.start[t + 1] - self.start[t]
        ends = np.cumsum(size)
        at = np.repeat(lo - (ends - size), size) + np.arange(ends[-1])
        return np.bincount(self.doc[at], weights=self.weight[at], minlength=self.n)


def fill(docs: list[np.ndarray], length: int, weights: np.ndarray, mean: float, window: int = 0, offset: int = 0) -> tuple[list[tuple[int, int, int, int, int]], int, int]:
    """Pieces ``(doc, start, length, window, offset)``, gapless in windows and documents, and where the last window stands.

    A window that an earlier shard left open goes on with this shard's first document as its seed.
    """
    index, used = Index(docs, weights, mean), np.zeros(len(docs), dtype=bool)
    out: list[tuple[int, int, int, int, int]] = []
    first = 0
    seed: int | None = None
    rank: np.ndarray | None = None
    for _ in range(len(docs)):
        if seed is None:  # a window ended with a document: the next unused one is a seed
            while used[first]:
                first += 1
            pick = seed = first
        else:
            if rank is None:
                rank = index.scores(seed)
                rank[used] = -1.0
            pick = int(rank.argmax())
        used[pick] = True
        if rank is not None:
            rank[pick] = -1.0
        start, size = 0, len(docs[pick])
        while start < size:
            n = min(size - start, length - offset)
            out.append((pick, start, n, window, offset))
            start, offset = start + n, offset + n
            if offset == length:
                window, offset, rank = window + 1, 0, None
                seed = pick if start < size else None
    return out, window, offset


def _tokenize(path: str, end_id: int):
    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoding(path).encode
        for whole in batches:
            for lo in range(0, whole.num_rows, 1000):
                b = whole.slice(lo, 1000)
                ids = []
                for t in column(b, "text"):
                    x = encode(t.as_py() or "", allowed_special="all")
                    x.append(end_id)
                    ids.append(np.array(x, dtype="<u2").tobytes())
                yield pa.RecordBatch.from_arrays([column(b, "id"), pa.array(ids, pa.binary())], names=["id", "ids"])

    return fn


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Document frequency of every id, and under -1 and -2 the numbers of documents and of ids."""
    df, docs, size = np.zeros(1 << 16, dtype=np.int64), 0, 0
    for b in batches:
        for x in column(b, "ids"):
            d = np.frombuffer(x.as_py(), dtype="<u2")
            df[np.unique(d)] += 1
            docs, size = docs + 1, size + len(d)
    at = np.flatnonzero(df)
    yield pa.RecordBatch.from_arrays([pa.array(np.append(at, [-1, -2])), pa.array(np.append(df[at], [docs, size]))], names=["term", "n"])


def priorities(weights: np.ndarray, df: np.ndarray) -> np.ndarray:
    """``SIGNATURE`` exponential draws a term, divided by its weight: the least of a document is its weighted min-hash."""
    w = np.where(df >= 2, weights.astype(np.float64) ** 2, 0.0)
    draws = np.random.default_rng(SEED).exponential(size=(SIGNATURE, len(weights)))
    with np.errstate(divide="ignore"):
        return np.where(w > 0, draws / w, np.inf)


def _sign(weights: np.ndarray, df: np.ndarray):
    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        draws = priorities(weights, df)
        for b in batches:
            own = np.empty((len(b), SIGNATURE), dtype=np.int32)
            for k, x in enumerate(column(b, "ids")):
                d = np.frombuffer(x.as_py(), dtype="<u2")
                own[k] = d[draws[:, d].argmin(axis=1)]
            tie = [zlib.crc32(x.as_py()) for x in column(b, "ids")]
            yield pa.RecordBatch.from_arrays([*(pa.array(own[:, k].copy()) for k in range(SIGNATURE)), pa.array(tie, pa.int64()), *b.columns], names=[*(f"s{k}" for k in range(SIGNATURE)), "tie", *b.schema.names])

    return fn


def _pack(length: int, with_ids: bool, shard_docs: int, weights: np.ndarray, mean: float):
    def done(part: int, ids: list, docs: list[np.ndarray], window: int, offset: int) -> tuple[pa.RecordBatch, int, int]:
        pieces_at, window, offset = fill(docs, length, weights, mean, window, offset)
        rows = np.array(pieces_at, dtype=np.int64).reshape(-1, 5)
        pieces = [docs[d][s : s + n].astype("<u4") for d, s, n, _, _ in rows]
        size = np.array([len(d) for d in docs])
        cols = {
            "doc_id": pa.array([ids[d] for d in rows[:, 0]], pa.int64()), "start": pa.array(rows[:, 1]), "length": pa.array(rows[:, 2]),
            "ids_crc32": pa.array([zlib.crc32(p.tobytes()) for p in pieces], pa.int64()), "doc_tokens": pa.array(size[rows[:, 0]], pa.int64()),
            "sequence_id": pa.array((np.int64(part) << 40) + rows[:, 3]), "offset": pa.array(rows[:, 4]),
        }
        if with_ids:
            cols["ids"] = pa.array([p.tolist() for p in pieces], pa.list_(pa.int32()))
        return pa.RecordBatch.from_pydict(cols), window, offset

    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, ids, docs, held = TaskContext.get().partitionId(), [], [], 0
        window = offset = 0
        for b in batches:
            for i, x in zip(column(b, "id").to_pylist(), column(b, "ids"), strict=True):
                ids.append(i)
                docs.append(np.frombuffer(x.as_py(), dtype="<u2"))
                held += len(docs[-1])
                if len(docs) >= shard_docs or held >= SHARD_IDS:
                    out, window, offset = done(part, ids, docs, window, offset)
                    yield out
                    ids, docs, held = [], [], 0
        if docs:
            yield done(part, ids, docs, window, offset)[0]

    return fn


def statistics(tokenized: DataFrame) -> tuple[np.ndarray, int, float]:
    """Document frequencies (as many as there are ids), number and mean length of all documents."""
    df, n = np.zeros(1 << 16, dtype=np.int64), {-1: 0, -2: 0}
    for r in tokenized.mapInArrow(_frequencies, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect():
        if r.term < 0:
            n[r.term] = r.n
        else:
            df[r.term] = r.n
    return df, n[-1], n[-2] / max(n[-1], 1)


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, end_id: int = END_ID, path: str | None = None, shard_docs: int = SHARD_DOCS, with_ids: bool = True) -> DataFrame:
    """One row a piece, with its ids unless ``with_ids`` is off."""
    tokenized = written(keyed(docs, id_col, text_col).mapInArrow(_tokenize(path or vocabulary_path(), end_id), "id long, ids binary"), "ids")
    df, n, mean = statistics(tokenized)
    weights = idf(df, n)
    order = [*(f"s{k}" for k in range(SIGNATURE)), "id", "tie"]
    signed = tokenized.mapInArrow(_sign(weights, df), ", ".join(f"s{k} int" for k in range(SIGNATURE)) + ", tie long, id long, ids binary")
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    near = signed.repartitionByRange(parts, *order).sortWithinPartitions(*order).select("id", "ids")
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + ", ids array<int>" * with_ids
    return near.mapInArrow(_pack(length, with_ids, shard_docs, weights, mean), schema)


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), with_ids=False)
