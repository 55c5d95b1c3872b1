"""Toxicity scores of a bidirectional gated recurrent network (operator 5).

Inputs of a word are its learned word vector and the mean of the learned vectors of its
character n-grams (first 3, 4 and 5 characters, last 3, all trigrams); words and n-grams
of fewer than two training documents share the zero vector.  Two gated recurrent layers
read a window in both directions, attention pools their states, and a linear unit gives
the window's logit.  A document is cut into overlapping windows that cover every word;
its score is a logistic function of its highest window logit and its number of windows.

Training is plain numpy on the driver, through network and vectors alike, on at most
``SAMPLE`` labelled documents taken by a hash of their id (a documented bound); rows with
``crc32(id) mod 3 = 1`` are never used.  A label belongs to a document, not to a window:
the windows learned from are those of the words most frequent in toxic documents at
first, then those the network itself scores highest.  The final logistic function is
fitted on the fifth of the sample the network did not learn from.

Inputs of a score are the text alone.  Defined cases: null and empty texts have one
window without words; a text of any length costs memory for its own windows only; a null
id is held out or not by the hash of the empty string and never labelled; labels that
repeat count once, toxic if any says so; with no labelled rows every score is 0.5;
repeated rows score alike; further columns, whatever their names, pass through
:func:`keep_clean`; an empty table gives an empty result.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import keyed, numbered, place, spread, table

SAMPLE, WINDOW, STRIDE, HIDDEN, ROUNDS, SEED = 2500, 64, 48, 8, 3, 5
FOLDS, HELD_FOLD, THRESHOLD, DECAY = 3, 1, 0.7, 1e-2
LIMIT, INIT, RIDGE = 5.0, 1.0, 0.1
VECTOR, INPUTS, LEAST_DOCS, KEPT_UNITS, DOC_STEP = 8, 16, 2, 400_000, 200
_EDGE = re.compile(r"^[\W\d_]+|[\W\d_]+$")


def held_out(id_col) -> F.Column:
    return F.pmod(F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")), F.lit(FOLDS)) == HELD_FOLD


def parts(unit: str) -> list[str]:
    """The keys of a unit: its word, then its character n-grams."""
    w = _EDGE.sub("", unit)
    if not w:
        return []
    return [f"w{w}", f"a{w[:3]}", f"b{w[:4]}", f"c{w[:5]}", f"z{w[-3:]}", *(f"t{w[i : i + 3]}" for i in range(len(w) - 2))]


class Vectors:
    """Learned vectors by key, 0 for unknown keys; the inputs of units met are kept, up to a bound."""

    def __init__(self, index: dict[str, int], values: np.ndarray):
        self.index, self.values = index, values
        self.forget()

    def forget(self) -> None:
        self.kept: dict[str, int] = {"": 0}
        self.rows = np.zeros((1024, INPUTS), dtype=np.float32)

    def __getstate__(self):
        return {"index": self.index, "values": self.values}

    def __setstate__(self, state):
        self.__init__(**state)

    def at(self, units: list[str]) -> np.ndarray:
        try:
            return np.fromiter(map(self.kept.__getitem__, units), dtype=np.int64, count=len(units))
        except KeyError:
            pass
        get = self.index.get
        new = list(set(units).difference(self.kept))
        first = len(self.kept)
        self.kept.update(zip(new, range(first, first + len(new)), strict=True))
        while first + len(new) > len(self.rows):
            self.rows = np.concatenate([self.rows, np.zeros_like(self.rows)])
        own = [[get(x, 0) for x in parts(u)] or [0, 0] for u in new]
        size = np.array([len(k) for k in own])
        flat = np.array([x for k in own for x in k])
        heads = np.cumsum(size) - size
        values = self.values[flat]
        word = values[heads]
        self.rows[first : first + len(new), :VECTOR] = word
        self.rows[first : first + len(new), VECTOR:] = (np.add.reduceat(values, heads, axis=0) - word) / np.maximum(size - 1, 1)[:, None]
        return np.fromiter(map(self.kept.__getitem__, units), dtype=np.int64, count=len(units))


def units(text: str | None) -> list[str]:
    return (text or "").lower().split()


class Lexicon:
    """Numbers of the training units and of their keys, as flat arrays."""

    def __init__(self, docs: list[list[str]], learn: np.ndarray):
        number = {"": 0}
        self.docs = [np.fromiter((number.setdefault(u, len(number)) for u in d), dtype=np.int64, count=len(d)) for d in docs]
        own = [parts(u) for u in number]
        met: dict[str, int] = {}
        for i in learn:
            for k in {k for u in set(self.docs[i].tolist()) for k in own[u]}:
                met[k] = met.get(k, 0) + 1
        self.index = {k: n + 1 for n, k in enumerate(sorted(k for k, n in met.items() if n >= LEAST_DOCS))}
        self.word = np.array([self.index.get(p[0], 0) if p else 0 for p in own])
        grams = [[self.index.get(k, 0) for k in p[1:]] for p in own]
        self.size = np.array([len(g) for g in grams])
        self.start = np.append(0, np.cumsum(self.size))
        self.gram = np.array([k for g in grams for k in g], dtype=np.int64)

    def odds(self, y: np.ndarray, learn: np.ndarray) -> np.ndarray:
        """Log-odds of each key in toxic against other documents, smaller where documents are few."""
        n = len(self.index) + 1
        c = [np.zeros(n), np.zeros(n)]
        for i in learn:
            u = np.unique(self.docs[i])
            size = self.size[u]
            flat = self.gram[np.repeat(self.start[u] - (np.cumsum(size) - size), size) + np.arange(size.sum())]
            c[int(y[i])][np.unique(np.concatenate([self.word[u], flat]))] += 1
        v = np.log((c[1] + 0.5) / (1 + (y[learn] == 1).sum())) - np.log((c[0] + 0.5) / (1 + (y[learn] == 0).sum()))
        v *= (c[0] + c[1]) / (c[0] + c[1] + 2)
        v[0] = 0
        return np.clip(v, -LIMIT, LIMIT)

    def inputs(self, units: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, tuple]:
        """Input rows of distinct units, and what their gradient needs."""
        n = self.size[units]
        owner = np.repeat(np.arange(len(units)), n)
        flat = self.gram[np.repeat(self.start[units] - (np.cumsum(n) - n), n) + np.arange(n.sum())]
        means = np.zeros((len(units), VECTOR), dtype=np.float32)
        share = (1 / np.maximum(n, 1)).astype(np.float32)
        for k in range(VECTOR):
            means[:, k] = np.bincount(owner, weights=values[flat, k], minlength=len(units)) * share
        return np.concatenate([values[self.word[units]], means], axis=1), (units, owner, flat, share)

    def gradient(self, seen: tuple, g: np.ndarray, n: int) -> np.ndarray:
        units, owner, flat, share = seen
        out = np.empty((n, VECTOR), dtype=np.float32)
        for k in range(VECTOR):
            out[:, k] = np.bincount(self.word[units], weights=g[:, k], minlength=n) + np.bincount(flat, weights=(g[:, VECTOR + k] * share)[owner], minlength=n)
        out[0] = 0
        return out


def starts(n: int) -> np.ndarray:
    """Window starts that cover ``n`` words; the last window ends with the text."""
    if n <= WINDOW:
        return np.zeros(1, dtype=np.int64)
    return np.append(np.arange(0, n - WINDOW, STRIDE), n - WINDOW)


class Network:
    """Parameters, forward pass and gradients; batches are ``(time, window, input)``."""

    def __init__(self, rng: np.random.Generator):
        h, k = HIDDEN, INPUTS
        g = lambda *s: (rng.standard_normal(s) / np.sqrt(s[0])).astype(np.float32)
        self.p = {"a": g(2 * h, h), "ab": np.zeros(h, np.float32), "v": g(h, 1)[:, 0], "o": g(2 * h, 1)[:, 0], "ob": np.float32(-1.0)}
        for d in "fb":
            self.p |= {"x" + d: g(k, 3 * h), "h" + d: g(h, 3 * h), "c" + d: np.zeros(3 * h, np.float32)}

    def _layer(self, x: np.ndarray, mask: np.ndarray, d: str, keep: list | None) -> np.ndarray:
        h, p = HIDDEN, self.p
        state = np.zeros((x.shape[1], h), np.float32)
        out = np.empty((*x.shape[:2], h), np.float32)
        gx = x @ p["x" + d] + p["c" + d]
        whole = mask.all()
        for t in range(len(x)) if d == "f" else range(len(x) - 1, -1, -1):
            gh = state @ p["h" + d]
            zr = np.tanh(0.5 * (gx[t, :, : 2 * h] + gh[:, : 2 * h])) * 0.5 + 0.5
            z, r = zr[:, :h], zr[:, h:]
            n = np.tanh(gx[t, :, 2 * h :] + r * gh[:, 2 * h :])
            new = n + z * (state - n)
            if not whole:
                new = np.where(mask[t][:, None], new, state)
            if keep is not None:
                keep.append((t, state, z, r, n, gh[:, 2 * h :]))
            state = out[t] = new
        return out

    def forward(self, x: np.ndarray, mask: np.ndarray, keep: dict | None = None) -> np.ndarray:
        p = self.p
        both = np.concatenate([self._layer(x, mask, d, None if keep is None else keep.setdefault(d, [])) for d in "fb"], axis=2)
        u = np.tanh(both @ p["a"] + p["ab"])
        e = np.where(mask, u @ p["v"], np.float32(-1e9))
        w = np.exp(e - e.max(axis=0))
        w /= w.sum(axis=0)
        c = np.einsum("tb,tbh->bh", w, both)
        if keep is not None:
            keep |= {"both": both, "u": u, "w": w, "c": c}
        return c @ p["o"] + p["ob"]

    def gradients(self, x: np.ndarray, mask: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, dict, np.ndarray]:
        keep: dict = {}
        h, p = HIDDEN, self.p
        gin = np.zeros_like(x)
        s = self.forward(x, mask, keep)
        prob = 1 / (1 + np.exp(-np.clip(s, -30, 30)))
        ds = ((prob - y) * weight / weight.sum()).astype(np.float32)
        g = {"o": keep["c"].T @ ds, "ob": ds.sum()}
        dc = ds[:, None] * p["o"]
        w, both, u = keep["w"], keep["both"], keep["u"]
        dw = np.einsum("bh,tbh->tb", dc, both)
        de = w * (dw - (w * dw).sum(axis=0))
        g["v"] = np.einsum("tb,tbh->h", de, u)
        du = de[:, :, None] * p["v"] * (1 - u * u)
        g["a"], g["ab"] = np.einsum("tbi,tbj->ij", both, du), du.sum(axis=(0, 1))
        dboth = w[:, :, None] * dc + du @ p["a"].T
        for k, d in enumerate("fb"):
            gx, gh, gc = np.zeros_like(p["x" + d]), np.zeros_like(p["h" + d]), np.zeros_like(p["c" + d])
            carry = np.zeros((x.shape[1], h), np.float32)
            for t, state, z, r, n, ghn in reversed(keep[d]):
                dh = carry + dboth[t, :, k * h : (k + 1) * h]
                m = mask[t][:, None]
                carry = np.where(m, 0, dh).astype(np.float32)
                dh = np.where(m, dh, 0).astype(np.float32)
                dn = dh * (1 - z) * (1 - n * n)
                dz = dh * (state - n) * z * (1 - z)
                dr = dn * ghn * r * (1 - r)
                dx, dg = np.concatenate([dz, dr, dn], axis=1), np.concatenate([dz, dr, dn * r], axis=1)
                gx += x[t].T @ dx
                gin[t] += dx @ p["x" + d].T
                gc += dx.sum(axis=0)
                gh += state.T @ dg
                carry += dh * z + dg @ p["h" + d].T
            g |= {"x" + d: gx, "h" + d: gh, "c" + d: gc}
        loss = float((weight * np.where(y > 0, -np.log(prob + 1e-9), -np.log(1 - prob + 1e-9))).sum() / weight.sum())
        return loss, g, gin


class Adam:
    def __init__(self, rate: float):
        self.rate, self.step, self.m, self.v = rate, 0, {}, {}

    def move(self, p: dict, g: dict, decay: float) -> None:
        self.step += 1
        for k, d in g.items():
            d = d + decay * p[k]
            self.m[k] = 0.9 * self.m.get(k, 0) + 0.1 * d
            self.v[k] = 0.99 * self.v.get(k, 0) + 0.01 * d * d
            p[k] = (p[k] - self.rate * (self.m[k] / (1 - 0.9**self.step)) / (np.sqrt(self.v[k] / (1 - 0.99**self.step)) + 1e-6)).astype(np.float32)


class Model:
    """Vectors, network and the document's logistic function."""

    def __init__(self, vectors: Vectors | None, net: Network | None, top: np.ndarray):
        self.vectors, self.net, self.top = vectors, net, top

    def windows(self, at: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Units ``(time, window)``, mask, and each window's document."""
        owner, firsts, sizes = [], [], []
        flat = np.concatenate([np.zeros(0, dtype=np.int64), *at, np.zeros(WINDOW, dtype=np.int64)])
        base = 0
        for k, a in enumerate(at):
            s = starts(len(a))
            owner.append(np.full(len(s), k))
            firsts.append(base + s)
            sizes.append(np.full(len(s), min(len(a), WINDOW)))
            base += len(a)
        owner, first, size = np.concatenate(owner), np.concatenate(firsts), np.concatenate(sizes)
        mask = np.arange(WINDOW)[:, None] < np.maximum(size, 1)
        rows = np.where(np.arange(WINDOW)[:, None] < size, flat[first + np.arange(WINDOW)[:, None]], 0)
        return rows, mask, owner

    def logits(self, at: list[np.ndarray], rows_of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Highest window logit and number of windows of each document."""
        rows, mask, owner = self.windows(at)
        s = self.each(rows, mask, rows_of)
        cuts = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
        return np.maximum.reduceat(s, cuts), np.diff(np.append(cuts, len(owner)))

    def each(self, rows: np.ndarray, mask: np.ndarray, rows_of: np.ndarray) -> np.ndarray:
        s = np.zeros(rows.shape[1], np.float32)
        whole = mask.all(axis=0)
        for group in (np.flatnonzero(whole), np.flatnonzero(~whole)):
            for lo in range(0, len(group), 2048):
                w = group[lo : lo + 2048]
                s[w] = self.net.forward(rows_of[rows[:, w]], mask[:, w])
        return s

    def score(self, texts: list[str | None]) -> np.ndarray:
        if self.net is None:
            return np.full(len(texts), 0.5)
        out = []
        for lo in range(0, len(texts), DOC_STEP):
            if len(self.vectors.kept) > KEPT_UNITS:
                self.vectors.forget()
            at = [self.vectors.at(units(t)) for t in texts[lo : lo + DOC_STEP]]
            best, n = self.logits(at, self.vectors.rows)
            out.append(1 / (1 + np.exp(-np.clip(np.stack([best, np.log(n), np.ones(len(n))], axis=1) @ self.top, -30, 30))))
        return np.concatenate(out) if out else np.zeros(0)


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, steps: int = 25) -> np.ndarray:
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        w -= np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)), x.T @ (p - y) + ridge * w)
    return w


def loudest(score: np.ndarray, owner: np.ndarray, most: int) -> np.ndarray:
    """Windows of the ``most`` highest scores of each document."""
    order = np.lexsort((-score, owner))
    first = np.flatnonzero(np.append(True, owner[order][1:] != owner[order][:-1]))
    return order[np.arange(len(order)) - np.repeat(first, np.diff(np.append(first, len(order)))) < most]


def train(texts: list[str | None], y: np.ndarray, folds: int = 5, batch: int = 160) -> Model:
    """Fit on labelled texts; see the module's text."""
    y = np.asarray(y, dtype=np.float64)
    if not len(y) or not 0 < y.sum() < len(y):
        return Model(None, None, np.zeros(3))
    rng = np.random.default_rng(SEED)
    learn = np.arange(len(y)) % folds > 0
    if len(set(y[learn])) < 2 or len(set(y[~learn])) < 2:
        learn[:] = True
    words = Lexicon([units(t) for t in texts], np.flatnonzero(learn))
    model = Model(None, Network(rng), np.zeros(3))
    rows, mask, owner = model.windows(words.docs)
    p = {"values": (0.3 * rng.standard_normal((len(words.index) + 1, VECTOR))).astype(np.float32)}
    odds = words.odds(y, np.flatnonzero(learn))
    p["values"][:, 0] = odds * INIT
    p["values"][0] = 0
    opt, opt_net = Adam(0.02), Adam(0.02)
    score = np.where(mask, np.maximum(odds[words.word] - 1, 0)[rows], 0).sum(axis=0) + 1e-6 * rng.random(len(owner))
    everything = np.arange(len(words.word))
    rounds = max(ROUNDS, min(60, -(-20 * batch // max(len(y), 1))))  # small samples pass more often
    for k in range(rounds):
        pick = loudest(score, owner, 2)
        more = np.flatnonzero((rng.random(len(owner)) < 0.15) & (y[owner] == 0))
        pick = np.unique(np.concatenate([pick, more]))
        pick = rng.permutation(pick[learn[owner[pick]]])
        truth = y[owner[pick]]
        weight = np.where(truth > 0, max(1.0, min(4.0, (len(truth) - truth.sum()) / max(1.0, 2 * truth.sum()))), 1.0)
        for lo in range(0, len(pick), batch):
            at = pick[lo : lo + batch]
            met, inv = np.unique(rows[:, at], return_inverse=True)
            inv = inv.reshape(rows.shape[0], len(at))
            inputs, seen = words.inputs(met, p["values"])
            _, g, gin = model.net.gradients(inputs[inv], mask[:, at], truth[lo : lo + batch], weight[lo : lo + batch])
            back = np.stack([np.bincount(inv.reshape(-1), weights=gin[:, :, j].reshape(-1), minlength=len(met)) for j in range(INPUTS)], axis=1)
            opt_net.move(model.net.p, g, 1e-4)
            opt.move(p, {"values": words.gradient(seen, back, len(p["values"]))}, DECAY)
        score = model.each(rows, mask, words.inputs(everything, p["values"])[0])
    model.vectors = Vectors(words.index, p["values"])
    cuts = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
    best, n = np.maximum.reduceat(score, cuts), np.diff(np.append(cuts, len(owner)))
    fit_on = ~learn if not learn.all() else learn
    model.top = logistic(np.stack([best, np.log(n), np.ones(len(n))], axis=1)[fit_on], y[fit_on], RIDGE)
    return model


def labelled(docs: DataFrame, labels: DataFrame, label: str, bound: int) -> DataFrame:
    """``(id, y)`` of at most ``bound`` labelled rows outside the held-out third, taken by a hash of their id."""
    known = numbered(labels).select(F.col(place(labels, "doc_id")).cast("long").alias("id"), F.col(place(labels, label)).cast("int").alias("y")).where("id IS NOT NULL AND y IS NOT NULL")
    return known.where(~held_out("id")).groupBy("id").agg(F.max("y").alias("y"), F.min("y").alias("low")).orderBy(F.xxhash64("id"), "id").limit(bound)


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", bound: int = SAMPLE) -> Model:
    rows = keyed(docs, id_col, text_col).join(F.broadcast(labelled(docs, labels, "toxic", bound)), "id").dropDuplicates(["id"]).select("id", "text", "y").collect()
    rows.sort(key=lambda r: r.id)
    return train([r.text for r in rows], np.array([r.y for r in rows]))


def scorer(model: Model):
    @F.pandas_udf("double")
    def of(text: pd.Series) -> pd.Series:
        return pd.Series(model.score([None if t is None else t for t in text]))

    return of


def scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, held_out, score, predicted)`` of every document."""
    of = scorer(fit(docs, labels, id_col, text_col))
    out = keyed(docs, id_col, text_col).select(F.col("id").alias("doc_id"), held_out("id").alias("held_out"), of("text").alias("score"))
    return out.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def keep_clean(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents with a score below the threshold, all columns as they were."""
    of = scorer(fit(docs, labels, id_col, text_col))
    d = spread(numbered(docs))
    return d.withColumn("score", of(F.col(place(docs, text_col)).cast("string"))).where(F.col("score") < THRESHOLD).drop("score").toDF(*docs.columns)


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def crc_fold(doc_id: int | None, folds: int = FOLDS) -> int:
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % folds
