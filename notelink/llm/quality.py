"""Quality classifier by co-training two views (operator 4).

The text view sees the words of a document (log-odds of hashed words) and measures of
its text (case, symbols, repetition, lengths, ...); the page-metadata view sees language,
source and stated length, as log-odds of their values.  In every round each view scores
all documents outside the held-out third; what it is surest of (``SURE``) becomes a
pseudo-label from which the other view learns.  A view learns from counts: a round is one
pass in which every task adds up the counts of its pseudo-labelled documents by class, so
all rows take part, none is sampled, and what reaches the driver is bounded by the number
of buckets.  Pseudo-labelled counts of a class weigh at most what its labelled ones do.

Each view combines its inputs by a logistic function of the labelled documents (log-odds
leave the document's own counts out), is calibrated out of fold, and a logistic function
of the two calibrated logits scores all documents.  Views that know nothing get a weight
near zero.

Labelled documents are at most ``SAMPLE``, taken by a hash of their id (a documented
bound); rows with ``crc32(id) mod 3 = 1`` are never learned from.

Defined cases: null and empty texts have zero measures and no words; null metadata is a
value of its own; with no labelled rows, or one class, every score is 1 (nothing is
rejected); labels that repeat count once, low if any says so; repeated rows score
alike and count each; texts of any length are read whole; further columns, whatever their
names, pass through :func:`keep_good`; missing metadata columns count as null; an empty
table gives an empty result.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import column, keyed, numbered, place, spread, table
from .toxicity import held_out, labelled, logistic

SAMPLE, ROUNDS, SURE, REJECT = 4000, 2, 0.95, 0.3
SOURCES, LANGS, LENGTHS, WORDS, KEPT_WORDS = 64, 16, 16, 1 << 15, 300_000
FOLDS, RIDGE = 5, 2.0
_SYMBOLS, _ENDS = b"#$%&*@^~|<>{}[]\\=+_", b".,;:!?"
_MARKED = re.compile(rb"[#$%&*@^~|=+!]+(?=\s|$)")


def measures(text: str | None) -> list[float]:
    """The text view: shares and lengths, each within a small range."""
    t = text or ""
    raw = t.encode("utf-8", "surrogatepass")
    n = max(len(raw), 1)
    c = np.bincount(np.frombuffer(raw, dtype=np.uint8), minlength=256)
    words, lines = raw.split(), t.split("\n")
    nw = max(len(words), 1)
    kinds = Counter(words)
    said = [x for x in lines if len(x) >= 20]
    upper, lower = int(c[65:91].sum()), int(c[97:123].sum())
    return [
        upper / max(upper + lower, 1), c[list(_SYMBOLS)].sum() / n * 5, c[33] / n * 5, c[48:58].sum() / n * 5, c[list(_ENDS)].sum() / n * 5,
        c[124] / nw * 2, c[128:].sum() / n, np.log1p(len(words)) / 8, n / nw / 10, len(kinds) / nw, max(kinds.values(), default=0) / nw * 2,
        len(_MARKED.findall(raw)) / nw, 1 - len(set(said)) / max(len(said), 1), np.log1p(len(lines)) / 6, len(t) / max(len(lines), 1) / 500,
        sum(len(x) for x in words if len(x) > 25) / n, sum(v for v in kinds.values() if v > 1) / nw, raw.count(b"http") / nw * 20, float(len(words) < 5), c[40:42].sum() / n * 10,
    ]


N_TEXT = 20


_BUCKETS: dict[bytes, int] = {}


def word_buckets(text: str | None) -> np.ndarray:
    """The distinct buckets of a text's lower-cased words."""
    if len(_BUCKETS) > KEPT_WORDS:
        _BUCKETS.clear()
    out = set()
    for w in set((text or "").encode("utf-8", "surrogatepass").lower().split()):
        k = _BUCKETS.get(w)
        if k is None:
            k = _BUCKETS[w] = zlib.crc32(w) % WORDS
        out.add(k)
    return np.fromiter(out, dtype=np.int64, count=len(out))


def metadata(lang: str | None, source: str | None, n_chars: float | None) -> np.ndarray:
    """One value each of language, source and length."""
    known = n_chars is not None and n_chars == n_chars
    size = min(LENGTHS - 1, 1 + int(1.5 * np.log1p(max(float(n_chars), 0.0)))) if known else 0
    raw = (zlib.crc32(f"l{lang}".encode("utf-8", "surrogatepass")) % LANGS, zlib.crc32(f"s{source}".encode("utf-8", "surrogatepass")) % SOURCES, size)
    return np.array([raw[0], LANGS + raw[1], LANGS + SOURCES + raw[2]])


class View:
    """Log-odds of values (word buckets, or metadata cells) and, with measures, a logistic function of them."""

    def __init__(self, size: int, single: bool):
        self.size, self.single = size, single  # single: every value is an input of its own

    def learn(self, values: list[np.ndarray], more: np.ndarray, y: np.ndarray, counts: np.ndarray, docs: np.ndarray) -> View:
        """From labelled documents, and pseudo-labelled ``counts[class, value]`` of ``docs[class]`` documents."""
        own, n = np.zeros((2, self.size)), np.array([(y == 0).sum(), (y == 1).sum()], dtype=float)
        for v, label in zip(values, y, strict=True):
            own[int(label), v] += 1
        weight = np.minimum(1.0, n / np.maximum(docs, 1))
        self.c, self.n = own + weight[:, None] * counts, n + weight * docs
        x = self.inputs(values, more, y)
        self.mean, self.sd = x.mean(axis=0), x.std(axis=0) + 1e-3
        self.w, self.held = logistic(self.scaled(x), y, RIDGE), np.zeros(len(y))
        fold = np.arange(len(y)) % FOLDS
        for k in range(FOLDS):
            if len(set(y[fold != k])) == 2:
                self.held[fold == k] = self.scaled(x[fold == k]) @ logistic(self.scaled(x[fold != k]), y[fold != k], RIDGE)
        self.calibration = logistic(np.stack([self.held, np.ones(len(y))], axis=1), y)
        return self

    def inputs(self, values: list[np.ndarray], more: np.ndarray, y: np.ndarray | None = None) -> np.ndarray:
        """With ``y`` the rows' own counts are left out of their log-odds."""
        out = []
        for k, v in enumerate(values):
            c0, c1, n0, n1 = self.c[0, v], self.c[1, v], *self.n
            if y is not None:
                c0, c1, n0, n1 = (c0, c1 - 1, n0, n1 - 1) if y[k] else (c0 - 1, c1, n0 - 1, n1)
            odds = (np.log((c1 + 0.5) / (n1 + 1)) - np.log((c0 + 0.5) / (n0 + 1))) * (c0 + c1) / (c0 + c1 + 2)
            out.append(odds if self.single else [odds.mean(), odds.sum() / len(odds) ** 0.5] if len(odds) else [0.0, 0.0])
        return np.concatenate([np.array(out, dtype=float).reshape(len(values), -1), more], axis=1)

    def scaled(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.sd, -4, 4)
        return np.concatenate([z, z * z / 4, np.ones((len(z), 1))], axis=1)

    def calibrated(self, logit: np.ndarray) -> np.ndarray:
        return np.clip(np.stack([logit, np.ones(len(logit))], axis=1) @ self.calibration, -12, 12)

    def logit(self, values: list[np.ndarray], more: np.ndarray) -> np.ndarray:
        return self.calibrated(self.scaled(self.inputs(values, more)) @ self.w)


class Documents:
    """What both views see of some rows."""

    def __init__(self, texts: list, langs: list, sources: list, sizes: list):
        self.words = [word_buckets(t) for t in texts]
        self.measures = np.array([measures(t) for t in texts]).reshape(-1, N_TEXT)
        self.cells = [metadata(*r) for r in zip(langs, sources, sizes, strict=True)]
        self.none = np.zeros((len(texts), 0))

    def both(self) -> tuple:
        return (self.words, self.measures), (self.cells, self.none)


class Model:
    """Two views and how to combine them; without views every score is 1."""

    views: tuple[View, View] | None = None

    def learn(self, sample: Documents, y: np.ndarray, pseudo: list[tuple[np.ndarray, np.ndarray]]) -> Model:
        """``pseudo`` holds each view's ``(counts, docs)`` of pseudo-labelled documents."""
        y = y.astype(np.float64)
        text, page = sample.both()
        self.views = (View(WORDS, False).learn(*text, y, *pseudo[0]), View(LANGS + SOURCES + LENGTHS, True).learn(*page, y, *pseudo[1]))
        self.top = logistic(np.stack([*(v.calibrated(v.held) for v in self.views), np.ones(len(y))], axis=1), y)
        return self

    def score(self, d: Documents) -> np.ndarray:
        if self.views is None:
            return np.ones(len(d.words))
        both = [v.logit(*x) for v, x in zip(self.views, d.both(), strict=True)]
        return 1 / (1 + np.exp(-np.clip(np.stack([*both, np.ones(len(d.words))], axis=1) @ self.top, -30, 30)))


def rows_of(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``(id, text, lang, source, n)``, missing columns null."""
    def own(name: str, kind: str) -> F.Column:
        at = place(docs, name)
        return (F.col(at) if at else F.lit(None)).cast(kind)

    return keyed(docs, id_col, text_col, own("lang", "string").alias("lang"), own("source", "string").alias("source"), own("n_chars", "double").alias("n"))


def _seen(b: pa.RecordBatch) -> Documents:
    return Documents(*(column(b, c).to_pylist() for c in ("text", "lang", "source", "n")))


def _pieces(batches: Iterator[pa.RecordBatch], rows: int = 2000) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for lo in range(0, b.num_rows, rows):
            yield b.slice(lo, rows)


def _sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in _pieces(batches):
        d = _seen(b)
        yield pa.RecordBatch.from_arrays([column(b, "id"), column(b, "low"), pa.array([x.tolist() for x in d.words], pa.list_(pa.int64())), pa.array(d.measures.tolist(), pa.list_(pa.float64())), pa.array([x.tolist() for x in d.cells], pa.list_(pa.int64()))], names=["id", "y", "words", "measures", "cells"])


def _exchange(model: Model):
    """Counts ``(view, label, value, n)`` for each view of the documents the other view is sure of; value -1 counts documents."""
    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = [np.zeros((2, v.size + 1)) for v in model.views]
        for b in _pieces(batches):
            d = _seen(b)
            inputs = d.both()
            for k, v in enumerate(model.views):
                p = 1 / (1 + np.exp(-v.logit(*inputs[k])))
                other = inputs[1 - k][0]
                for label, sure in ((1, p), (0, 1 - p)):
                    at = np.flatnonzero(sure >= SURE)
                    sums[1 - k][label, -1] += len(at)
                    if len(at):
                        sums[1 - k][label, :-1] += np.bincount(np.concatenate([other[i] for i in at]), minlength=sums[1 - k].shape[1] - 1)
        for view, s in enumerate(sums):
            label, value = np.nonzero(s)
            n = s[label, value]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(n), view), pa.int32()), pa.array(label, pa.int32()), pa.array(np.where(value == s.shape[1] - 1, -1, value), pa.int32()), pa.array(n)], names=["view", "label", "value", "n"])

    return fn


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", rounds: int = ROUNDS) -> Model:
    rows = rows_of(docs, id_col, text_col)
    known = labelled(docs, labels, "quality", SAMPLE).select("id", "low")
    mine = rows.join(F.broadcast(known), "id").dropDuplicates(["id"]).mapInArrow(_sample, "id long, y int, words array<long>, measures array<double>, cells array<long>").collect()
    mine.sort(key=lambda r: r.id)
    y = np.array([r.y for r in mine])
    model = Model()
    if not len(y) or not 0 < y.sum() < len(y):
        return model
    sample = Documents([], [], [], [])
    sample.words, sample.cells = [np.array(r.words, dtype=np.int64) for r in mine], [np.array(r.cells) for r in mine]
    sample.measures, sample.none = np.array([r.measures for r in mine]), np.zeros((len(mine), 0))
    none = [(np.zeros((2, n)), np.zeros(2)) for n in (WORDS, LANGS + SOURCES + LENGTHS)]
    model.learn(sample, y, none)
    free = rows.where(~held_out("id"))
    for _ in range(rounds):
        counts = [(np.zeros_like(c), np.zeros(2)) for c, _ in none]
        for r in free.mapInArrow(_exchange(model), "view int, label int, value int, n double").groupBy("view", "label", "value").agg(F.sum("n").alias("n")).collect():
            if r.value < 0:
                counts[r.view][1][r.label] = r.n
            else:
                counts[r.view][0][r.label, r.value] = r.n
        model = Model().learn(sample, y, counts)
    return model


def scorer(model: Model):
    @F.pandas_udf("double")
    def of(text: pd.Series, lang: pd.Series, source: pd.Series, n: pd.Series) -> pd.Series:
        step = 2000
        out = [model.score(Documents(*(x.iloc[lo : lo + step].tolist() for x in (text, lang, source, n)))) for lo in range(0, len(text), step)]
        return pd.Series(np.concatenate(out) if out else np.zeros(0))

    return of


def scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, held_out, score, kept)``: the probability of good quality of every document."""
    of = scorer(fit(docs, labels, id_col, text_col))
    out = rows_of(docs, id_col, text_col).select(F.col("id").alias("doc_id"), held_out("id").alias("held_out"), of("text", "lang", "source", "n").alias("score"))
    return out.withColumn("kept", F.col("score") > REJECT)


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents that are not rejected, all columns as they were."""
    of = scorer(fit(docs, labels, id_col, text_col))
    at = [place(docs, c) for c in (text_col, "lang", "source", "n_chars")]
    seen = [(F.col(c) if c else F.lit(None)).cast(kind) for c, kind in zip(at, ("string", "string", "string", "double"), strict=True)]
    return spread(numbered(docs)).withColumn("score", of(*seen)).where(F.col("score") > REJECT).drop("score").toDF(*docs.columns)


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
