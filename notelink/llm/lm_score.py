"""Language-model scores over a subword lattice (operator 8).

A text is its words ``[^\\x20\\x09-\\x0D]+`` in ASCII lower case, then one end token.
Every word spans a lattice whose arcs are pieces: those of an existing public
vocabulary, byte pieces where no piece covers a character, and, for a word of the
training texts, the word itself as one piece.  The word's probability is the sum over
all segmentations, by a forward recursion in log space.

All piece weights are estimated by expectation steps over every distinct training word.
The public pieces start from the vocabulary's own scores (the score of a merge
vocabulary is minus its rank, so a piece starts at Zipf's ``1 / (rank + 2)``).  A piece
with expected count ``e`` gets ``exp(digamma(e))``, as unigram vocabularies are trained;
what that leaves of a word's count, the whole of it where the public pieces explain the
word, belongs to the public pieces.  So with N training tokens::

    P(w) = exp(digamma(c(w) own(w))) / N + rest * spelling(w)

where ``own(w)`` is the posterior of the word's own piece (a fixed point of this very
sum), ``rest`` the share of tokens the word pieces leave, and ``spelling`` the sum over
the public pieces.  It sums to one over all words.  As no arc crosses white space, a
document's marginal is the product over its words and its end.

Data flow: documents are dealt into blocks of a few megabytes.  A block lists its
distinct words once; the words meet their global counts in one aggregate, are spelled
once each, and return to the blocks that asked.  Nothing but piece sums (bounded by the
vocabulary) and three totals reaches the driver; the word pieces grow with the corpus
and stay distributed.

Defined cases: null and empty texts are the end token alone; invalid surrogates are
kept as their bytes; a null id hashes as an empty string; repeated rows each count;
with no training rows the public pieces with the vocabulary's own weights score
everything and ``base_score`` is 0-count smoothing; a very long text is read in one
pass and costs memory for its words only; an empty table gives an empty result; other
columns are never read.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BLOCK, KIND, column, dealt, keyed, sliced, table, value, with_block, written

FOLDS, HELD_FOLD, BLOCK_BYTES, WORDS_PER_TASK = 5, 1, 6_000_000, 20_000
EM_STEPS, PRIOR, OWN_STEPS, START_REST, END_SPELLED = 2, 2000.0, 4, 0.1, 1e-3

TINY = -1e30


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class Lattice:
    """Pieces, their natural-log weights, and forward sums over whole arrays of words."""

    def __init__(self, path: str, logw: np.ndarray | None = None):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        self.bytes = np.zeros(256, dtype=np.int64)
        pieces, rank = [], np.full(n, np.inf)
        scores = np.array([sp.get_score(i) for i in range(n)])
        plain = [i for i in range(n) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i) or sp.is_byte(i))]
        rank[plain] = np.argsort(np.argsort(-scores[plain], kind="stable"), kind="stable")
        for i in range(n):
            if sp.is_byte(i):
                self.bytes[int(sp.id_to_piece(i)[3:5], 16)] = i
                rank[i] = len(plain)
        pieces = [(sp.id_to_piece(i), i) for i in plain]
        self.n, self.end = n, n
        prior = np.append(1.0 / (rank + 2.0), 0.0)
        self.prior = prior / prior.sum()
        # ASCII capitals never occur in a lower-cased text; every prefix of a piece has an entry, so a walk ends early
        pieces = [(p, i) for p, i in pieces if not any("A" <= c <= "Z" for c in p)]
        self.longest = max(len(p) for p, _ in pieces)
        at = {_hash(p[:k]): -1 for p, _ in pieces for k in range(1, len(p) + 1)}
        at.update((_hash(p), i) for p, i in pieces)
        self.keys = np.sort(np.array(list(at), dtype=np.uint64))
        self.ids = np.array([at[int(k)] for k in self.keys], dtype=np.int64)
        # open addressing by the hash's low bits, a few rounds of tables for what collides
        self.tables = []
        left = np.arange(len(self.keys))
        while len(left):
            slot = ((self.keys[left] >> np.uint64(8 + 3 * len(self.tables))) & np.uint64(SLOTS - 1)).astype(np.int64)
            t = np.full(SLOTS, -1, dtype=np.int32)
            t[slot[::-1]] = left[::-1]
            self.tables.append(t)
            left = left[t[slot] != left]
        self.logw = np.log(np.maximum(self.prior[:n], 1e-300)) if logw is None else logw

    def find(self, h: np.ndarray) -> np.ndarray:
        """Entry of each hash, -1 for what no piece starts with."""
        out, rest = np.full(len(h), -1, dtype=np.int64), None
        for k, t in enumerate(self.tables):
            x = h if rest is None else h[rest]
            at = t[((x >> np.uint64(8 + 3 * k)) & np.uint64(SLOTS - 1)).astype(np.int64)]
            hit = (at >= 0) & (self.keys[at] == x)
            if rest is None:
                out[hit] = at[hit]
                rest = np.flatnonzero(~hit & (at >= 0))
            else:
                out[rest[hit]] = at[hit]
                rest = rest[~hit & (at >= 0)]
            if not len(rest):
                break
        return out

    def words(self, words: list[str], weight=None, expect: np.ndarray | None = None) -> np.ndarray:
        """Log marginals of the public pieces; with ``weight(rows, marginals)``, expected piece counts are added to ``expect``."""
        out = np.zeros(len(words))
        size = np.array([len(w) + 1 for w in words])
        order = np.argsort(size, kind="stable")
        for rows in np.split(order, np.flatnonzero(np.diff(size[order])) + 1):
            step = max(1, 400_000 // max(1, int(size[rows[0]])))
            for lo in range(0, len(rows), step):
                part = rows[lo : lo + step]
                out[part] = self._same([words[i] for i in part], int(size[part[0]]), None if weight is None else lambda lp, part=part: weight(part, lp), expect)
        return out

    def _same(self, words: list[str], n: int, weight, expect: np.ndarray | None) -> np.ndarray:
        cp = np.frombuffer("".join("▁" + w for w in words).encode("utf-32-le", "surrogatepass"), dtype="<u4").reshape(len(words), n).T.astype(np.uint64)
        acc = np.full((n + 1, len(words)), TINY)
        acc[0] = 0.0
        arcs: list[tuple[int, int, np.ndarray, np.ndarray | None]] = []
        with np.errstate(over="ignore"):
            for i in range(n):
                rows, h = np.arange(len(words)), cp[i] + np.uint64(1) + SALT
                for j in range(i + 1, min(n, i + self.longest) + 1):
                    if j > i + 1:
                        h = h * MULT + cp[j - 1, rows] + np.uint64(1)
                    f = h * FINAL
                    entry = self.find(f ^ (f >> np.uint64(29)))
                    piece = np.where(entry >= 0, self.ids[entry], -1)
                    if j == i + 1 and (piece < 0).any():
                        miss = np.flatnonzero(piece < 0)
                        acc[j, miss] = np.logaddexp(acc[j, miss], acc[i, miss] + self._spelled(cp[i, miss])[0])
                        if expect is not None:
                            arcs.append((i, j, miss, None))
                    ok = piece >= 0
                    hit, ids = rows[ok], piece[ok]
                    acc[j, hit] = np.logaddexp(acc[j, hit], acc[i, hit] + self.logw[ids])
                    if expect is not None:
                        arcs.append((i, j, hit, ids))
                    alive = entry >= 0
                    rows, h = rows[alive], h[alive]
                    if not len(rows):
                        break
        if expect is not None:
            back = np.full((n + 1, len(words)), TINY)
            back[n] = 0.0
            share = weight(acc[n])
            for i, j, hit, ids in reversed(arcs):
                w = self.logw[ids] if ids is not None else self._spelled(cp[i, hit])[0]
                back[i, hit] = np.logaddexp(back[i, hit], w + back[j, hit])
                p = share[hit] * np.exp(np.minimum(acc[i, hit] + w + back[j, hit] - acc[n, hit], 0.0))
                if ids is not None:
                    expect += np.bincount(ids, weights=p, minlength=len(expect))
                else:
                    for row, bs in enumerate(self._spelled(cp[i, hit])[1]):
                        for b in bs:
                            expect[b] += p[row]
        return acc[n]

    def _spelled(self, cps: np.ndarray) -> tuple[np.ndarray, list[list[int]]]:
        """Byte pieces of characters that no piece covers."""
        distinct, inv = np.unique(cps, return_inverse=True)
        ids = [[int(self.bytes[b]) for b in chr(int(c)).encode("utf-8", "surrogatepass")] for c in distinct]
        w = np.array([sum(self.logw[b] for b in x) for x in ids])
        return w[inv], [ids[k] for k in inv]


SLOTS = 2**19
MULT, FINAL, SALT = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x51ED270B)


def _hash(piece: str) -> int:
    m, h = 2**64, 0
    for k, c in enumerate(piece):
        h = (h * int(MULT) + ord(c) + 1) % m if k else (ord(c) + 1 + int(SALT)) % m
    h = h * int(FINAL) % m
    return h ^ (h >> 29)


_LATTICES: dict = {}


def _lattice(path: str, logw: np.ndarray | None = None) -> Lattice:
    """One a Python worker; the weights are put in anew."""
    if path not in _LATTICES:
        _LATTICES[path] = Lattice(path)
    x = _LATTICES[path]
    x.logw = np.log(np.maximum(x.prior[: x.n], 1e-300)) if logw is None else logw
    return x


def tokens(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def _list_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each distinct word of a block with its count in the block's training rows."""
    def out(block: int, train: Counter, held: set) -> Iterator[pa.RecordBatch]:
        words = [*train, *(w for w in held if w not in train)]
        counts = np.zeros(len(words), dtype=np.int64)
        counts[: len(train)] = np.fromiter(train.values(), dtype=np.int64, count=len(train))
        for lo in range(0, len(words), 50_000):
            part = words[lo : lo + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part), block, dtype=np.int32)), pa.array(part, pa.binary()), pa.array(counts[lo : lo + 50_000])], names=[BLOCK, "word", "c"])

    block, train, held = None, Counter(), set()
    for b in sliced(batches, [BLOCK]):
        if value(b, BLOCK) != block:
            if block is not None:
                yield from out(block, train, held)
            block, train, held = value(b, BLOCK), Counter(), set()
        for h, t in zip(column(b, "held_out").to_pylist(), column(b, "text"), strict=True):
            (held if h else train).update(tokens(t.as_py()))
    if block is not None:
        yield from out(block, train, held)


def exp_digamma(x: np.ndarray) -> np.ndarray:
    x = np.maximum(x, 1e-12)
    y = x + 6.0
    return np.exp(np.log(y) - 1 / (2 * y) - 1 / (12 * y**2) + 1 / (120 * y**4) - sum(1 / (x + k) for k in range(6)))


def own_counts(spelling: np.ndarray, c: np.ndarray, total: int, rest: float) -> np.ndarray:
    """``exp(digamma(e))`` of the words' own pieces, ``e`` their expected counts: some steps of the fixed point."""
    own, spelt = np.ones(len(c)), total * rest * np.exp(spelling)
    for _ in range(OWN_STEPS):
        w = np.where(c > 0, exp_digamma(c * own), 0.0)
        own = w / np.maximum(w + spelt, 1e-300)
    return np.where(c > 0, exp_digamma(c * own), 0.0)


def _expect(path: str, logw: np.ndarray | None, total: int, rest: float):
    """Expected counts of the public pieces, and under -1 the count the word pieces take."""
    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        x = _lattice(path, logw)
        sums, taken = np.zeros(x.n), 0.0
        for b in batches:
            words, c = [w.decode("utf-8", "surrogatepass") for w in column(b, "word").to_pylist()], column(b, "c").to_numpy()
            lp = x.words(words, lambda part, lp, c=c: c[part] - own_counts(lp, c[part], total, rest), sums)
            taken += float(own_counts(lp, c, total, rest).sum())
        at = np.flatnonzero(sums > 0)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1)), pa.array(np.append(sums[at], taken))], names=["piece", "n"])

    return fn


def _spell(path: str, logw: np.ndarray | None, total: int, rest: float):
    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        x = _lattice(path, logw)
        for b in batches:
            words = [w.decode("utf-8", "surrogatepass") for w in column(b, "word").to_pylist()]
            c = column(b, "c").to_numpy()
            yield pa.RecordBatch.from_arrays([column(b, "word"), column(b, "c"), pa.array(marginal(x.words(words), c, total, rest))], names=["word", "c", "lp"])

    return fn


def marginal(spelling: np.ndarray, c: np.ndarray, total: int, rest: float) -> np.ndarray:
    """Natural-log probability of words: the arc of their own piece and the sum over the public pieces."""
    if not total:
        return spelling
    own = own_counts(spelling, c, total, rest) / total
    return np.logaddexp(np.where(own > 0, np.log(np.maximum(own, 1e-300)), TINY), np.log(rest) + spelling)


def _score(total: int, distinct: int, ends: int, rest: float):
    floor = total + 0.5 * (distinct + 1)
    end_lp = float(marginal(np.array([np.log(END_SPELLED)]), np.array([ends]), total, rest)[0])

    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, index, c, lp = None, {}, None, None
        held: list[pa.RecordBatch] = []
        for b in sliced(batches, [BLOCK, KIND]):
            if value(b, BLOCK) != block:
                block, index, held = value(b, BLOCK), {}, []
            if value(b, KIND) == 0:
                held.append(b.select(["word", "c", "lp"]))
                continue
            if held:
                t = pa.Table.from_batches(held)
                index.update(zip(t.column("word").to_pylist(), range(t.num_rows), strict=True))
                c, lp, held = t.column("c").to_numpy(), t.column("lp").to_numpy(), []
                base = np.log10((c + 0.5) / floor)
            n, known, base_s, score = [], [], [], []
            for t in column(b, "text"):
                w = tokens(t.as_py())
                at = np.fromiter(map(index.__getitem__, w), dtype=np.int64, count=len(w))
                n.append(len(w) + 1)
                known.append((int((c[at] > 0).sum()) if len(w) else 0) + (ends > 0))
                base_s.append((float(base[at].sum()) if len(w) else 0.0) + float(np.log10((ends + 0.5) / floor)))
                score.append(((float(lp[at].sum()) if len(w) else 0.0) + end_lp) / float(np.log(10)))
            yield pa.RecordBatch.from_arrays([column(b, "id"), column(b, "held_out"), pa.array(n, pa.int64()), pa.array(known, pa.int64()), pa.array(np.full(len(n), total, dtype=np.int64)), pa.array(base_s, pa.float64()), pa.array(score, pa.float64())], names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return fn


def lm_scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, folds: int = FOLDS, held_fold: int = HELD_FOLD, em_steps: int = EM_STEPS) -> DataFrame:
    """One row a document: counts, the add-half base and the lattice model's log10 probability."""
    path = path or vocabulary_path()
    at = F.col("id").cast("string")
    held = F.pmod(F.crc32(F.coalesce(at, F.lit("")).cast("binary")), F.lit(folds)) == held_fold
    base = with_block(keyed(docs, id_col, text_col).withColumn("held_out", held), BLOCK_BYTES)
    asked = written(dealt(base, BLOCK).mapInArrow(_list_words, f"{BLOCK} int, word binary, c long"), "asked")
    words = written(asked.groupBy("word").agg(F.sum("c").alias("c")), "words")
    ends = base.agg(F.count(F.when(~F.col("held_out"), 1))).first()[0]
    rows, n, v = words.agg(F.count("*"), F.coalesce(F.sum("c"), F.lit(0)), F.count(F.when(F.col("c") > 0, 1))).first()
    words = words.repartition(max(1, -(-rows // WORDS_PER_TASK)))
    total, distinct = n + ends, v + (ends > 0)
    logw, rest = None, START_REST
    prior = Lattice(path).prior
    for _ in range(em_steps if v else 0):
        got = words.where("c > 0").mapInArrow(_expect(path, logw, total, rest), "piece long, n double").groupBy("piece").agg(F.sum("n").alias("n")).collect()
        sums, taken = PRIOR * prior[:-1], float(exp_digamma(np.array([float(ends)]))[0])
        for r in got:
            if r.piece < 0:
                taken += r.n
            else:
                sums[r.piece] += r.n
        logw, rest = np.log(np.maximum(sums / sums.sum(), 1e-300)), max(1 - taken / total, 1e-9)
    spelled = words.mapInArrow(_spell(path, logw, total, rest), "word binary, c long, lp double")
    answers = asked.select(BLOCK, "word").join(spelled, "word").withColumn(KIND, F.lit(0))
    stream = answers.unionByName(base.withColumn(KIND, F.lit(1)), allowMissingColumns=True)
    return dealt(stream, BLOCK, KIND).mapInArrow(_score(total, distinct, ends, rest), "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def crc_fold(doc_id: int | None, folds: int) -> int:
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % folds


def op8_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scores(table(spark, sf_dir, "documents"))
