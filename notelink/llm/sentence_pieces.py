"""SentencePiece encoding and decoding by suffix arrays (operator 6).

A batch's texts are cut into units (white space marks, then what follows up to the
next mark; no piece crosses such a border).  The distinct units not met before are
concatenated and indexed by a suffix array sorted to the depth of the longest piece.
Every piece is looked up by binary search and gives the range of suffixes, thus all
places, where it occurs.  These edges are sorted by position and relaxed:

* unigram vocabularies: the best path from left to right over the edges;
* merge vocabularies (whose scores are ranks, not log probabilities): in each unit
  the two neighbours whose joint edge has the best score, leftmost first, become one,
  until no edge joins two neighbours.  A best path over ranks would not give the
  vocabulary's own segmentation, this does.

Characters that no piece covers become byte pieces.  The relaxed units are kept for
later batches, up to a bound: what is indexed of a batch is the concatenation of its
units not met before, since a unit's pieces are the same wherever it stands.  Decoding
concatenates the pieces' bytes.

Defined cases: null and empty texts have no pieces and decode to the empty text; a
text's own mark character decodes to a space, as the library does; long runs without
white space are single units; ids whose bytes are no text decode to U+FFFD in their
places; repeated rows and null ids pass; other columns are never read, whatever their
names; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import heapq
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import column, keyed, table

MARK = "▁"
KEPT_UNITS, LONG_UNIT, BATCH_CHARS = 1_000_000, 48, 700_000
_UNIT = re.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+")


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def model_kind(proto: bytes) -> int:
    """``model_type`` (1 unigram, 2 merges) of a serialized model: field 3 of message field 2; unigram where unset."""
    def fields(buf: bytes):
        at = 0

        def varint() -> int:
            nonlocal at
            shift = out = 0
            while True:
                c = buf[at]
                at += 1
                out |= (c & 127) << shift
                shift += 7
                if c < 128:
                    return out

        while at < len(buf):
            key = varint()
            if key & 7 == 0:
                yield key >> 3, varint()
            elif key & 7 == 2:
                n = varint()
                yield key >> 3, buf[at : at + n]
                at += n
            else:
                n = 8 if key & 7 == 1 else 4
                yield key >> 3, buf[at : at + n]
                at += n

    for number, body in fields(proto):
        if number == 2 and isinstance(body, bytes):
            return next((v for n, v in fields(body) if n == 3), 1)
    return 1


def _ranked(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions in the order of ``v`` (ties by position), and each position's rank from 1 among distinct values."""
    n = len(v)
    bits = max(1, (n - 1).bit_length())
    if int(v.max()).bit_length() + bits < 63:
        both = np.sort((v << bits) | np.arange(n))
        at, v = both & ((1 << bits) - 1), both >> bits
    else:
        at = np.argsort(v, kind="stable")
        v = v[at]
    rank = np.empty(n, dtype=np.int64)
    rank[at] = np.cumsum(np.append(True, v[1:] != v[:-1]))
    return at, rank


class Pieces:
    """A vocabulary: plain pieces with scores, byte pieces, and how to relax."""

    def __init__(self, pieces: dict[str, int], scores: dict[int, float], byte_ids: list[int], merges: bool):
        self.pieces, self.merges = pieces, merges
        self.byte_ids = byte_ids
        n = max([*pieces.values(), *byte_ids]) + 1
        self.score = np.full(n, -np.inf)
        for i, s in scores.items():
            self.score[i] = s
        self.bytes = [b""] * n
        for p, i in pieces.items():
            self.bytes[i] = p.replace(MARK, " ").encode("utf-8", "surrogatepass")
        for b, i in enumerate(byte_ids):
            self.bytes[i] = bytes([b])
        self.longest = max(map(len, pieces))
        by_len = sorted(pieces)
        self.ids = np.array([pieces[p] for p in by_len])
        self.size = np.array([len(p) for p in by_len])
        self.chars = np.zeros((len(by_len), self.longest), dtype=np.uint32)
        for k, p in enumerate(by_len):
            self.chars[k, : len(p)] = [ord(c) for c in p]
        self._forget()

    @classmethod
    def load(cls, path: str) -> Pieces:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        byte_ids, pieces = [0] * 256, {}
        for i in range(sp.get_piece_size()):
            if sp.is_byte(i):
                byte_ids[int(sp.id_to_piece(i)[3:5], 16)] = i
            elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
                pieces[sp.id_to_piece(i)] = i
        return cls(pieces, {i: sp.get_score(i) for i in pieces.values()}, byte_ids, model_kind(sp.serialized_model_proto()) == 2)

    # -- matching -----------------------------------------------------

    def edges(self, cp: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """``(position, length, piece)`` of every occurrence, sorted by position and length."""
        n = len(cp)
        alphabet, rank = np.unique(cp, return_inverse=True)
        padded = np.append(rank.astype(np.int64) + 1, 0)
        depth = 1
        sa, order = _ranked(rank.astype(np.int64))
        while depth < self.longest:  # ranks of the first 1, 2, 4, ... characters
            after = np.zeros(n, dtype=np.int64)
            after[: max(n - depth, 0)] = order[depth:]
            sa, order = _ranked(order * (order.max() + 1) + after)
            depth *= 2
        code = np.searchsorted(alphabet, self.chars)
        code = np.where((code < len(alphabet)) & (alphabet[np.minimum(code, len(alphabet) - 1)] == self.chars), code + 1, -1)
        inside = np.arange(self.longest) < self.size[:, None]
        live = np.flatnonzero(((code > 0) | ~inside).all(axis=1))
        lo, hi = np.zeros(len(live), dtype=np.int64), np.full(len(live), n, dtype=np.int64)
        for d in range(self.longest):
            go = np.flatnonzero((self.size[live] > d) & (hi > lo))
            if not len(go):
                break
            want = code[live[go], d]
            for side in (0, 1):  # first suffix whose d-th character is not below, then the first above
                a, z = lo[go].copy(), hi[go].copy()
                open_ = np.flatnonzero(a < z)
                while len(open_):
                    mid = (a[open_] + z[open_]) >> 1
                    c = padded[np.minimum(sa[mid] + d, n)]
                    below = c < want[open_] + side
                    a[open_] = np.where(below, mid + 1, a[open_])
                    z[open_] = np.where(below, z[open_], mid)
                    open_ = open_[a[open_] < z[open_]]
                if side:
                    hi[go] = a
                else:
                    low = a
            lo[go] = low
        count = np.maximum(hi - lo, 0)
        ends = np.cumsum(count)
        at = sa[np.repeat(lo - (ends - count), count) + np.arange(ends[-1] if len(ends) else 0)]
        size, piece = np.repeat(self.size[live], count), np.repeat(self.ids[live], count)
        key = np.sort((at * (self.longest + 1) + size) * len(self.score) + piece)
        at = key // len(self.score)
        return at // (self.longest + 1), at % (self.longest + 1), key % len(self.score)

    # -- relaxing -----------------------------------------------------

    def encode_units(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and how many each unit has."""
        text = "\0".join(u.replace("\0", "￿") for u in units) + "\0"
        cp = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")
        size = np.array([len(u) for u in units])
        start = np.cumsum(size + 1) - (size + 1)
        at, length, piece = self.edges(cp)
        key = at * (self.longest + 1) + length
        one = np.full(len(cp), -1, dtype=np.int64)
        one[at[length == 1]] = piece[length == 1]
        if self.merges:
            end = self._merge(cp, units, start, size, key, piece)
        else:
            end = self._path(cp, start, size, at, length, piece)
        heads = np.flatnonzero(end > 0)
        spans = end[heads] - heads
        if len(key):
            k = np.minimum(np.searchsorted(key, heads * (self.longest + 1) + spans), len(key) - 1)
            got = np.where((spans <= self.longest) & (key[k] == heads * (self.longest + 1) + spans), piece[k], -1)
        else:
            got = np.full(len(heads), -1)
        count = np.ones(len(heads), dtype=np.int64)
        bare = np.flatnonzero(got < 0)
        if len(bare):
            raw = [text[h].encode("utf-8", "surrogatepass") if text[h] != "\uffff" else None for h in heads[bare]]
            owner = np.searchsorted(start, heads[bare], side="right") - 1
            raw = [x or units[o][h - start[o]].encode("utf-8", "surrogatepass") for x, o, h in zip(raw, owner, heads[bare], strict=True)]
            count[bare] = [len(x) for x in raw]
            got = np.repeat(got, count)
            got[got < 0] = [self.byte_ids[c] for x in raw for c in x]
        return got.astype(np.int32), np.add.reduceat(count, np.searchsorted(heads, start))

    def _merge(self, cp, units, start, size, key, piece) -> np.ndarray:
        """End of the symbol at each head position, 0 elsewhere."""
        base, n = self.longest + 1, len(cp)
        end = np.zeros(n, dtype=np.int64)

        def joint(heads: np.ndarray, ends: np.ndarray) -> np.ndarray:
            span = ends - heads
            want = heads * base + span
            k = np.minimum(np.searchsorted(key, want), len(key) - 1)
            return np.where((span < base) & (key[k] == want), self.score[piece[k]], -np.inf)

        inside = cp != 0
        end[inside] = np.flatnonzero(inside) + 1
        if not len(key):
            return end
        long = size > LONG_UNIT
        for u in np.flatnonzero(long):
            self._merge_one(int(start[u]), int(size[u]), key, piece, end)
        unit = np.repeat(np.flatnonzero(~long), size[~long])
        sym = np.repeat(start[~long] - (np.cumsum(size[~long]) - size[~long]), size[~long]) + np.arange(len(unit))
        nxt = sym + 1
        sc = np.full(len(sym), -np.inf)
        pair = np.flatnonzero(unit[1:] == unit[:-1])
        sc[pair] = joint(sym[pair], nxt[pair + 1])
        while len(sym):
            cuts = np.flatnonzero(np.append(True, unit[1:] != unit[:-1]))
            best = np.maximum.reduceat(sc, cuts)
            reps = np.diff(np.append(cuts, len(unit)))
            ok = np.repeat(best > -np.inf, reps)
            hit = np.flatnonzero(ok & (sc == np.repeat(best, reps)))
            first = hit[np.append(True, unit[hit[1:]] != unit[hit[:-1]])] if len(hit) else hit
            nxt[first] = nxt[first + 1]
            end[sym[first]] = nxt[first]
            end[sym[first + 1]] = 0
            stay = ok
            stay[first + 1] = False
            new = np.cumsum(stay) - 1
            unit, sym, nxt, sc = unit[stay], sym[stay], nxt[stay], sc[stay]
            changed = new[first]
            changed = np.concatenate([changed, changed[changed > 0] - 1])
            sc[changed] = -np.inf
            changed = changed[changed + 1 < len(unit)]
            changed = changed[unit[changed] == unit[changed + 1]]
            sc[changed] = joint(sym[changed], nxt[changed + 1])
        return end

    def _merge_one(self, lo: int, n: int, key, piece, end) -> None:
        """The same for one long unit, with a heap."""
        base, hi = self.longest + 1, lo + n
        k0, k1 = np.searchsorted(key, [lo * base, hi * base])
        score = dict(zip(key[k0:k1].tolist(), self.score[piece[k0:k1]].tolist(), strict=True))
        nxt, prev = {p: p + 1 for p in range(lo, hi)}, {p: p - 1 for p in range(lo, hi)}
        heap: list[tuple[float, int, int]] = []

        def push(p: int) -> None:
            if p >= lo and nxt[p] < hi:
                e = nxt[nxt[p]]
                if e - p < base and (s := score.get(p * base + e - p)) is not None:
                    heapq.heappush(heap, (-s, p, e))

        for p in range(lo, hi):
            push(p)
        while heap:
            _, p, e = heapq.heappop(heap)
            q = nxt.get(p)
            if q is None or q >= hi or nxt.get(q) != e:
                continue
            nxt[p] = e
            del nxt[q]
            if e < hi:
                prev[e] = p
            push(p)
            if p > lo:
                push(prev[p])
        end[lo:hi] = 0
        for p, e in nxt.items():
            end[p] = e

    def _path(self, cp, start, size, at, length, piece) -> np.ndarray:
        """Best paths, all units at once, end by end; a character without a piece costs 10 below the least score."""
        n = len(cp)
        inside = cp != 0
        head = np.zeros(n + 1, dtype=np.int64)
        head[:n] = np.repeat(start, size + 1)
        bare = np.setdiff1d(np.flatnonzero(inside), at[length == 1])
        low = np.min(self.score[np.isfinite(self.score)]) - 10.0
        a = np.concatenate([at, bare])
        z = a + np.concatenate([length, np.ones(len(bare), dtype=np.int64)])
        s = np.concatenate([self.score[piece], np.full(len(bare), low)])
        rel = z - head[a]
        order = np.lexsort((a, rel))
        a, z, s, rel = a[order], z[order], s[order], rel[order]
        best, back = np.full(n + 1, -np.inf), np.full(n + 1, -1, dtype=np.int64)
        best[start] = 0.0
        for lo, hi in zip(c := np.flatnonzero(np.append(True, rel[1:] != rel[:-1])), np.append(c[1:], len(rel)), strict=True):
            total = best[a[lo:hi]] + s[lo:hi]
            by = np.lexsort((-a[lo:hi], total, z[lo:hi]))
            last = by[np.append(z[lo:hi][by][1:] != z[lo:hi][by][:-1], True)]
            best[z[lo:hi][last]], back[z[lo:hi][last]] = total[last], a[lo:hi][last]
        end, now = np.zeros(n, dtype=np.int64), (start + size)[size > 0]
        begin = start[size > 0]
        while len(now):
            was = back[now]
            end[was] = now
            go = was > begin
            now, begin = was[go], begin[go]
        return end

    # -- texts --------------------------------------------------------

    def _forget(self) -> None:
        self.kept: dict[str, int] = {}
        self.flat, self.count = np.zeros(0, dtype=np.int32), np.zeros(0, dtype=np.int64)
        self.start = self.count

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        cut = [_UNIT.findall(MARK + t.replace(" ", MARK)) if t else [] for t in texts]
        if len(self.kept) > KEPT_UNITS:
            self._forget()
        new = {u for units in cut for u in units}.difference(self.kept)
        part, chars = [], 0
        for u in new:
            part.append(u)
            chars += len(u) + 1
            if chars > BATCH_CHARS:
                self._learn(part)
                part, chars = [], 0
        if part:
            self._learn(part)
        out, get = [], self.kept.__getitem__
        for units in cut:
            at = np.fromiter(map(get, units), dtype=np.int64, count=len(units))
            n = self.count[at]
            ends = np.cumsum(n)
            out.append(self.flat[np.repeat(self.start[at] - (ends - n), n) + np.arange(ends[-1] if len(ends) else 0)])
        return out

    def _learn(self, units: list[str]) -> None:
        ids, count = self.encode_units(units)
        self.kept.update(zip(units, range(len(self.kept), len(self.kept) + len(units)), strict=True))
        self.flat, self.count = np.concatenate([self.flat, ids]), np.concatenate([self.count, count])
        self.start = np.cumsum(self.count) - self.count

    def decode(self, ids: np.ndarray) -> str:
        """The text of the pieces' bytes, without the mark that encoding put first; bytes that are no text become U+FFFD."""
        raw = b"".join(map(self.bytes.__getitem__, ids.tolist()))
        raw = raw[1:] if raw[:1] == b" " else raw
        try:
            return raw.decode("utf-8", "surrogatepass")
        except UnicodeDecodeError:
            return raw.decode("utf-8", "replace")


_LOADED: dict[str, Pieces] = {}


def loaded(path: str) -> Pieces:
    """One a Python worker."""
    if path not in _LOADED:
        _LOADED[path] = Pieces.load(path)
    return _LOADED[path]


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, step: int = 2000) -> DataFrame:
    """``(doc_id, ids array<int>)``."""
    path = path or vocabulary_path()

    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, step):
                b = whole.slice(lo, step)
                ids = loaded(path).encode(column(b, "text").to_pylist())
                cuts = np.append(0, np.cumsum([len(x) for x in ids])).astype(np.int32)
                flat = np.concatenate(ids) if ids else np.zeros(0, dtype=np.int32)
                yield pa.RecordBatch.from_arrays([column(b, "id"), pa.ListArray.from_arrays(pa.array(cuts), pa.array(flat, pa.int32()))], names=["doc_id", "ids"])

    return keyed(docs, id_col, text_col).mapInArrow(fn, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """``(doc_id, text)`` of ``(doc_id, ids)``."""
    path = path or vocabulary_path()

    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([column(b, "doc_id"), pa.array([loaded(path).decode(np.array(x.as_py() or [], dtype=np.int32)) for x in column(b, "ids")], pa.string())], names=["doc_id", "text"])

    return encoded.mapInArrow(fn, "doc_id long, text string")


def round_trip(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, step: int = 2000) -> DataFrame:
    """Encoding and decoding in one pass: ``(doc_id, n_pieces, ids_crc32, decoded_sha256, same)``."""
    path = path or vocabulary_path()

    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, step):
                b = whole.slice(lo, step)
                texts, m = column(b, "text").to_pylist(), loaded(path)
                ids = m.encode(texts)
                back = [m.decode(x) for x in ids]
                yield pa.RecordBatch.from_arrays(
                    [column(b, "id"), pa.array([len(x) for x in ids], pa.int64()), pa.array([zlib.crc32(x.astype("<u4").tobytes()) for x in ids], pa.int64()), pa.array([hashlib.sha256(x.encode("utf-8", "surrogatepass")).hexdigest() for x in back], pa.string()), pa.array([x == (t or "") for x, t in zip(back, texts, strict=True)], pa.bool_())],
                    names=["doc_id", "n_pieces", "ids_crc32", "decoded_sha256", "same"],
                )

    return keyed(docs, id_col, text_col).mapInArrow(fn, "doc_id long, n_pieces long, ids_crc32 long, decoded_sha256 string, same boolean")


def op6_sentence_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(table(spark, sf_dir, "documents"))
