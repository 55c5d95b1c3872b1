"""SimHash near-duplicates by the generalised pigeonhole principle (operator 7).

A fingerprint has bit ``b`` set if over half the XXH64 hashes (seed 42) of a text's
word shingles have it.  Fingerprints at ``radius`` or fewer differing bits link.

Equal fingerprints collapse first.  Statistics of all distinct fingerprints (bit
means, bit pairs) group correlated bits into partitions.  If the partitions get
thresholds ``t_i`` with ``sum(t_i + 1) = radius + 1``, every linked pair differs in at
most ``t_i`` bits of some partition (``t_i = -1`` leaves a partition out).  Dynamic
programming picks the thresholds with the least estimated work: the pairs that meet
at threshold 0 are counted over all fingerprints, larger thresholds follow from the
bit means, and probes are charged for.  A fingerprint is filed under its own value
of each chosen partition and, for a threshold above 0, probes the values around it.

A bucket is searched breadth first, each fingerprint against those not yet reached,
and gives a spanning forest instead of its pairs; a large bucket is first cut by the
same principle on its other bits.  A star contraction joins the forests.

Defined cases: a null, empty or white-space text has fingerprint zero and links like
any other; fewer than ``words`` words make one shingle; repeated rows link; a null
id joins its group but never names it; an empty table gives an empty result.

:func:`keep_one`, the stage of the pipeline, takes documents whose sets of word shingles
have a Jaccard similarity of 0.8 or more.  Fingerprints of the sets, linked as above at
``STAGE_RADIUS`` bits, give its candidates.  A pair at 0.8 differs in about ten bits of 64
and may lie beyond any radius that partitions can search, so min-hash bands add the pairs
out of reach (a pair at 0.8 is missed by them with odds of 3 in a million).  The sets
themselves decide.  Other columns pass through, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import column, components, dealt, keyed, numbered, place, runs, sliced, table, value, written

SEED, BITS, RADIUS, WORDS = 42, 64, 3, 3
STAGE_WORDS, SIMILARITY, STAGE_RADIUS = 5, 0.8, 7
BANDS, BAND_ROWS, VERIFY_BLOCK = 32, 5, 1024
LARGE_BUCKET = 2048
ROW_COST, PAIR_COST = 1.0, 0.01  # a filed or probing row against a compared pair


def shingle_hashes(text: str | None, words: int) -> np.ndarray:
    """XXH64 of every word shingle, in order; bytes are split and lower-cased as ASCII only."""
    w = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not w:
        return np.zeros(0, dtype="<u8")
    if len(w) <= words:
        shingles = [b" ".join(w)]
    elif words == 3:
        shingles = [b"%b %b %b" % x for x in zip(w, w[1:], w[2:], strict=False)]
    else:
        shingles = [b" ".join(w[i : i + words]) for i in range(len(w) - words + 1)]
    of = xxhash.xxh64_intdigest
    return np.array([of(s, SEED) for s in shingles], dtype="<u8")


def fingerprint(text: str | None, words: int = WORDS) -> int:
    """The signed 64-bit fingerprint."""
    return majority(shingle_hashes(text, words))


def majority(h: np.ndarray) -> int:
    """The bits that over half the hashes have, signed; zero if there is none."""
    if not len(h):
        return 0
    ones = np.zeros(BITS, dtype=np.int64)
    for lo in range(0, len(h), 1 << 16):
        ones += np.unpackbits(h[lo : lo + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view("<i8")[0])


def _fingerprints(words: int):
    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([column(b, "id"), pa.array([fingerprint(t, words) for t in column(b, "text").to_pylist()], pa.int64())], names=["id", "fp"])

    return fn


def _moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    both = np.zeros((BITS, BITS))
    for b in batches:
        x = np.unpackbits(column(b, "fp").to_numpy().astype("<i8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float32)
        both += x.T @ x
    i, j = np.triu_indices(BITS)
    yield pa.RecordBatch.from_arrays([pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(both[i, j])], names=["i", "j", "n"])


def group_bits(mean: np.ndarray, both: np.ndarray, m: int) -> list[list[int]]:
    """``m`` groups of correlated bits: each starts at the bit with most correlation left and takes its nearest."""
    sd = np.sqrt(np.maximum(mean * (1 - mean), 1e-12))
    corr = np.abs((both - np.outer(mean, mean)) / np.outer(sd, sd))
    np.fill_diagonal(corr, 0)
    left, out = set(range(BITS)), []
    for g in range(m):
        size = len(left) // (m - g)
        rest = sorted(left)
        own = [max(rest, key=lambda b: (corr[b, rest].sum(), -b))]
        left.discard(own[0])
        while len(own) < size:
            nxt = max(sorted(left), key=lambda b: (corr[b, own].mean(), -b))
            own.append(nxt)
            left.discard(nxt)
        out.append(sorted(own))
    return out


def thresholds(costs: list[list[float]], need: int) -> tuple[float, list[int]]:
    """Least total of ``costs[i][t_i + 1]`` with ``sum(t_i + 1) = need``, and the ``t_i``."""
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for own in costs:
        nxt: dict[int, tuple[float, list[int]]] = {}
        for used, (c, ts) in best.items():
            for k, extra in enumerate(own):
                if used + k <= need and (used + k not in nxt or c + extra < nxt[used + k][0]):
                    nxt[used + k] = (c + extra, [*ts, k - 1])
        best = nxt
    return best[need]


def plan(nodes: DataFrame, n: int, radius: int = RADIUS) -> list[tuple[int, int]]:
    """The chosen ``(mask, threshold)`` pairs; reads only aggregates of bounded size."""
    rows = nodes.mapInArrow(_moments, "i int, j int, n double").groupBy("i", "j").agg(F.sum("n").alias("n")).collect()
    both = np.zeros((BITS, BITS))
    for r in rows:
        both[r.i, r.j] = both[r.j, r.i] = r.n / max(n, 1)
    mean = np.diag(both).copy()
    designs = [group_bits(mean, both, m) for m in range(max(2, math.ceil((radius + 1) / 3)), radius + 2)]  # thresholds end at 2
    masks = [sum(1 << b for b in g) for d in designs for g in d]
    signed = [x - (1 << 64) if x >> 63 else x for x in masks]
    value = F.explode(F.array(*[F.struct(F.lit(k).alias("p"), F.col("fp").bitwiseAND(F.lit(x)).alias("v")) for k, x in enumerate(signed)])).alias("x")
    met = nodes.select(value).groupBy("x.p", "x.v").count().groupBy("p").agg(F.sum(F.col("count") * (F.col("count") - 1) / 2).alias("pairs")).collect()
    pairs = {r.p: float(r.pairs) for r in met}
    best, k = None, 0
    same = mean**2 + (1 - mean) ** 2
    for design in designs:
        costs = []
        for g in design:
            odds = ((1 - same) / np.maximum(same, 1e-9))[g]
            ways = [1.0, odds.sum(), (odds.sum() ** 2 - (odds**2).sum()) / 2]
            own, seen = [0.0], 0.0
            floor = n * n / 2 * float(np.prod(same[g]))  # wide groups may show no pair yet
            for t in range(min(radius, 3)):
                seen += max(pairs.get(k, 0.0), floor) * ways[t]
                own.append(ROW_COST * n * sum(math.comb(len(g), i) for i in range(t + 1)) + PAIR_COST * seen)
            costs.append(own)
            k += 1
        cost, ts = thresholds(costs, radius + 1)
        if best is None or cost < best[0]:
            best = (cost, [(sum(1 << b for b in g), t) for g, t in zip(design, ts, strict=True) if t >= 0])
    return best[1]


def _file(chosen: list[tuple[int, int]]):
    flips = []
    for mask, t in chosen:
        bits = [b for b in range(BITS) if mask >> b & 1]
        flips.append(np.array([sum(1 << b for b in c) for k in range(1, t + 1) for c in combinations(bits, k)], dtype=np.uint64))

    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = column(b, "fp").to_numpy().view(np.uint64)
            for p, (mask, _) in enumerate(chosen):
                v = fp & np.uint64(mask)
                for x in (np.uint64(0), *flips[p]):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(v), p, dtype=np.int32)), pa.array((v ^ x).view(np.int64)), pa.array(np.full(len(v), x != 0)), pa.array(fp.view(np.int64))], names=["p", "v", "probe", "fp"])

    return fn


def _forest(own: np.ndarray, probe: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Spanning edges of the links among ``own`` and between ``own`` and ``probe``."""
    out: list[tuple[int, int]] = []
    while len(own):
        todo, own = [(own[0], True)], own[1:]
        while todo and len(own) + len(probe):
            x, filed = todo.pop()
            near = np.bitwise_count(own ^ x) <= radius
            if near.any():
                out += [(int(x), int(y)) for y in own[near]]
                todo += [(y, True) for y in own[near]]
                own = own[~near]
            if not filed:
                continue  # probes meet each other where one of them is filed
            near = np.bitwise_count(probe ^ x) <= radius
            if near.any():
                out += [(int(x), int(y)) for y in probe[near]]
                todo += [(y, False) for y in probe[near]]  # another filed one may link with it only
                probe = probe[~near]
    return out


def _cut(own: np.ndarray, probe: np.ndarray, mask: int, radius: int, width: int = 16) -> list[tuple[int, int]]:
    """Links of a large bucket: its other bits in ``radius + 1`` parts, of which a linked pair shares one."""
    rest = [b for b in range(BITS) if not mask >> b & 1]
    if len(own) + len(probe) <= LARGE_BUCKET or len(rest) < radius + 1:
        return _forest(own, probe, radius)
    out: list[tuple[int, int]] = []
    every = np.concatenate([own, probe])
    real = np.concatenate([np.ones(len(own), bool), np.zeros(len(probe), bool)])
    for k in range(radius + 1):
        part = sum(1 << b for b in rest[k :: radius + 1])
        v = every & np.uint64(part)
        order = np.argsort(v, kind="stable")
        cuts = runs(v[order])
        for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
            at = order[lo:hi]
            if len(at) == len(every):
                out += _cut(every[real], every[~real], mask | part, radius)
                return out  # all share this part: the others can add no pair
            if len(at) > 1 and real[at].any():
                out += _cut(every[at][real[at]], every[at][~real[at]], mask | part, radius)
    return out


def _verify(chosen: list[tuple[int, int]], radius: int):
    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []

        def links(parts: list[tuple[np.ndarray, ...]], closed: bool) -> tuple[pa.RecordBatch, list]:
            p, v, probe, fp = (np.concatenate(c) for c in zip(*parts, strict=True))
            cuts = runs(p, v)
            end = len(cuts) - 1 if closed else len(cuts) - 2
            out: list[tuple[int, int]] = []
            for k in np.flatnonzero(np.diff(cuts)[: max(end, 0)] > 1):
                lo, hi = cuts[k], cuts[k + 1]
                own = ~probe[lo:hi]
                if own.any():
                    out += _cut(fp[lo:hi][own], fp[lo:hi][~own], chosen[p[lo]][0], radius)
            last = cuts[max(end, 0)]
            pairs = np.array(out, dtype=np.uint64).reshape(-1, 2).view(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0].copy()), pa.array(pairs[:, 1].copy())], names=["a", "b"]), [] if closed else [(p[last:], v[last:], probe[last:], fp[last:])]

        for b in batches:
            now = (column(b, "p").to_numpy(), column(b, "v").to_numpy(), column(b, "probe").to_numpy(zero_copy_only=False), column(b, "fp").to_numpy().view(np.uint64))
            if not len(now[0]):
                continue
            held.append(now)
            if held[0][0][0] == now[0][-1] and held[0][1][0] == now[1][-1]:
                continue  # one bucket still
            out, held = links(held, False)
            yield out
        if held:
            yield links(held, True)[0]

    return fn


def near_fingerprints(fps: DataFrame, radius: int = RADIUS) -> DataFrame:
    """``(node, root)`` for the fingerprints (column ``fp``) that link with another."""
    nodes = written(fps.select("fp").distinct(), "fps")
    n = nodes.count()
    chosen = plan(nodes, n, radius)
    filed = nodes.mapInArrow(_file(chosen), "p int, v long, probe boolean, fp long")
    spread = filed.withColumn("b", F.xxhash64("p", "v"))
    edges = dealt(spread, "b", "p", "v").drop("b").mapInArrow(_verify(chosen, radius), "a long, b long")
    return components(edges, "fpcc")


def simhash_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, radius: int = RADIUS) -> DataFrame:
    """``(doc_id, fingerprint, component_id)``, one row for each document."""
    fps = written(keyed(docs, id_col, text_col).mapInArrow(_fingerprints(words), "id long, fp long"), "docfps")
    first = fps.groupBy("fp").agg(F.min("id").alias("first"))
    of = first.join(near_fingerprints(fps, radius).withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = of.groupBy("root").agg(F.min("first").alias("component_id"))
    named = of.join(least, "root").select("fp", "component_id")
    return fps.join(named, "fp").select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def _bands(h: np.ndarray) -> list[int]:
    """One value a band of ``BAND_ROWS`` least hashes; sets of similarity s share one with 1 - (1 - s^5)^32."""
    if not len(h):
        return []
    rng = np.random.default_rng(SEED)
    salt, odd = (rng.integers(0, 1 << 64, BANDS * BAND_ROWS, dtype=np.uint64) for _ in range(2))
    odd |= np.uint64(1)
    least = np.full(len(salt), np.iinfo(np.uint64).max)
    for lo in range(0, len(h), 2048):
        least = np.minimum(least, ((h[lo : lo + 2048, None] ^ salt) * odd).min(axis=0))
    rows = least.astype("<u8").reshape(BANDS, BAND_ROWS)
    return [xxhash.xxh64_intdigest(r.tobytes(), k) - (1 << 63) for k, r in enumerate(rows)]


def _sets(words: int):
    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [np.unique(shingle_hashes(t, words)) for t in column(b, "text").to_pylist()]
            nodes = pa.array([xxhash.xxh64_intdigest(h.tobytes(), SEED) - (1 << 63) for h in sets], pa.int64())
            yield pa.RecordBatch.from_arrays([column(b, "row"), column(b, "id"), column(b, "th"), nodes, pa.array([majority(h) for h in sets], pa.int64()), pa.array([_bands(h) for h in sets], pa.list_(pa.int64()))], names=["row", "id", "th", "node", "fp", "bands"])

    return fn


def similar_forest(sets: list[np.ndarray], similarity: float) -> list[tuple[int, int]]:
    """Spanning edges of the pairs of sets whose Jaccard similarity is ``similarity`` or more."""
    size = np.array([len(h) for h in sets])
    values, term = np.unique(np.concatenate(sets), return_inverse=True)
    doc = np.repeat(np.arange(len(sets)), size)
    order = np.argsort(term, kind="stable")
    posted, start = doc[order], np.searchsorted(term[order], np.arange(len(values) + 1))
    own = np.split(term, np.cumsum(size)[:-1])
    left, out = np.ones(len(sets), dtype=bool), []
    for first in range(len(sets)):
        if not left[first]:
            continue
        left[first], todo = False, [first]
        while todo and left.any():
            x = todo.pop()
            lo, n = start[own[x]], start[own[x] + 1] - start[own[x]]
            if not len(n):
                continue
            ends = np.cumsum(n)
            both = np.bincount(posted[np.repeat(lo - (ends - n), n) + np.arange(ends[-1])], minlength=len(sets))
            near = np.flatnonzero(left & (both >= similarity * (size + size[x] - both) - 1e-9))
            out += [(x, int(y)) for y in near]
            todo += near.tolist()
            left[near] = False
    return out


def _similar(words: int, similarity: float):
    def links(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        nodes = np.concatenate([column(b, "node").to_numpy() for b in parts])
        pairs = similar_forest([np.unique(shingle_hashes(t, words)) for b in parts for t in column(b, "text").to_pylist()], similarity)
        at = np.array(pairs, dtype=np.int64).reshape(-1, 2)
        return pa.RecordBatch.from_arrays([pa.array(nodes[at[:, 0]]), pa.array(nodes[at[:, 1]])], names=["a", "b"])

    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, parts = None, []
        for b in sliced(batches, ["root", "i", "j"]):
            now = (value(b, "root"), value(b, "i"), value(b, "j"))
            if now != key and parts:
                yield links(parts)
                parts = []
            key = now
            parts.append(b)
        if parts:
            yield links(parts)

    return fn


def similar_rows(rows: DataFrame, words: int, similarity: float, radius: int = STAGE_RADIUS) -> DataFrame:
    """``(row, id, th, root)`` for rows ``(row, id, text)``: groups of the pairs at ``similarity`` or more.

    Rows whose fingerprints link, or that share a band, become candidates; star edges join
    them to candidate groups.
    Each pair of such a group is then held against the similarity of the two sets, in
    blocks of bounded size, so nothing is united without that check.
    """
    sets = written(rows.withColumn("th", F.xxhash64("text")).mapInArrow(_sets(words), "row long, id long, th long, node long, fp long, bands array<long>"), "sets")
    classes = written(sets.groupBy("node").agg(F.min_by("bands", "row").alias("bands"), F.min_by("fp", "row").alias("fp"), F.min("row").alias("row")), "setclasses")
    linked = classes.select("node", "fp").join(near_fingerprints(classes, radius).select(F.col("node").alias("fp"), "root"), "fp", "left")
    filed = classes.select("node", F.explode("bands").alias("v")).unionByName(linked.select("node", F.xxhash64(F.lit("fp"), F.coalesce("root", "fp")).alias("v")))
    least = filed.groupBy("v").agg(F.min("node").alias("a"), F.count("*").alias("n")).where("n > 1").drop("n")
    met = written(components(filed.join(least, "v").where("node <> a").select("a", F.col("node").alias("b")), "metcc"), "met")
    sizes = met.groupBy("root").agg(F.ceil(F.count("*") / VERIFY_BLOCK).cast("int").alias("blocks"))
    at = met.join(classes.select("node", "row"), "node").join(sizes, "root").withColumn("blk", F.pmod(F.xxhash64(F.lit(7), "node"), F.col("blocks")).cast("int"))
    at = at.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select("root", F.least("blk", "o").alias("i"), F.greatest("blk", "o").alias("j"), "node", "row")
    at = at.join(rows.select("row", "text"), "row").drop("row").withColumn("b", F.xxhash64("root", "i", "j"))
    edges = dealt(at, "b", "root", "i", "j").drop("b").mapInArrow(_similar(words, similarity), "a long, b long")
    return sets.drop("bands", "fp").join(components(edges, "simcc"), "node", "left").select("row", "id", "th", F.coalesce("root", "node").alias("root"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, similarity: float = SIMILARITY) -> DataFrame:
    """One row of each group at ``similarity`` or more stays: the smallest id (null last), then by its text; each row has its own key."""
    kept = written(numbered(docs).withColumn("row", F.monotonically_increasing_id()), "keyed")
    rows = kept.select("row", F.col(place(docs, id_col)).cast("long").alias("id"), F.col(place(docs, text_col)).cast("string").alias("text"))
    first = similar_rows(rows, words, similarity).groupBy("root").agg(F.min(F.struct(F.col("id").isNull(), "id", "th", "row"))["row"].alias("row"))
    return kept.join(first.select("row"), "row", "left_semi").drop("row").toDF(*docs.columns)


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_groups(table(spark, sf_dir, "documents"))
