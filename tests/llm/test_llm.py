"""The training-data operators against brute force, round trips and held-out accuracy on small fixtures."""

import hashlib
import random
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from notelink.llm import embedding_dedup, line_dedup, lm_score, media, packing, quality, sentence_pieces, simhash_dedup, tool_calls, toxicity

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, __nl_block string, id int"


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and white-space texts, a long one, repeated rows, clashing columns."""
    rng = random.Random(1)
    words = ["".join(rng.choice("abcdéñ") for _ in range(rng.randint(2, 7))) for _ in range(60)]
    same = "a shared line of more than twenty characters"
    texts = [None, "", " \t\n ", "one two", same + "\nown one", " " + same.upper() + "\t\nown two", same, " ".join(rng.choice(words) for _ in range(30000)), "x\n" * 50, "🎉 ﬁ 日本語"]
    texts += [" ".join(rng.choice(words) for _ in range(rng.randint(1, 300))) for _ in range(40)]
    rows = [(i, t, "en" if i % 2 else None, None, None, "clash", i) for i, t in enumerate(texts)]
    return spark.createDataFrame([*rows, rows[5], rows[12], (None, "null id", None, None, None, None, None)], DOCS)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def brute_lines(rows):
    strip = " \t\n\x0b\x0c\r"
    low = {c: c + 32 for c in range(65, 91)}
    key = lambda x: x.strip(strip).translate(low)
    held = {}
    for k, (i, t) in enumerate(rows):
        for x in {key(x) for x in (t or "").split("\n")}:
            held.setdefault(x, []).append(-(2**63) if i is None else i)
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        i = -(2**63) if i is None else i
        stay = [x for x in lines if not (len(key(x)) >= 20 and len(set(held[key(x)])) >= 3 and max(held[key(x)]) != i)]
        out.append((i, len(lines), len(lines) - len(stay), hashlib.sha256("\n".join(stay).encode()).hexdigest()))
    return sorted(out)


def test_lines(odd, none):
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    got = sorted((-(2**63) if r.doc_id is None else r.doc_id, r.n_lines, r.n_dropped, r.kept_sha256) for r in line_dedup.line_report(odd).collect())
    assert got == brute_lines(rows)
    whole = line_dedup.dedup_lines(odd)
    assert whole.columns == odd.columns and whole.count() == odd.count()
    assert line_dedup.line_report(none).count() == 0


def test_lines_ids_and_names(spark):
    """A repeated row is one document; columns of any name pass."""
    same = "one and the same line of text"
    df = spark.createDataFrame([(1, same, "a"), (1, same, "a"), (2, same, "b")], "doc_id long, text string, `my col-x.y` string")
    assert [r.n_dropped for r in line_dedup.line_report(df).collect()] == [0, 0, 0]
    got = line_dedup.dedup_lines(df.union(spark.createDataFrame([(3, same, "c")], df.schema)))
    assert got.columns == df.columns and sorted((r[0], r[1], r[2]) for r in got.collect()) == [(1, "", "a"), (1, "", "a"), (2, "", "b"), (3, same, "c")]


def test_perfect_hash():
    h = np.unique(np.random.default_rng(0).integers(-(2**62), 2**62, 5000))
    at = line_dedup.probe_mph(line_dedup.build_mph(h), h)
    assert sorted(at.tolist()) == list(range(len(h)))


def brute_components(n, linked):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in linked:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def test_simhash(odd, none, spark):
    got = sorted((r.doc_id, r.fingerprint, r.component_id) for r in simhash_dedup.simhash_groups(odd.where("doc_id IS NOT NULL")).collect())
    ids, fp = [r[0] for r in got], [int(r[1], 16) for r in got]
    text = {r.doc_id: r.text for r in odd.collect()}
    assert all(simhash_dedup.fingerprint(text[i]) & (2**64 - 1) == f for i, f in zip(ids, fp, strict=True))
    roots = brute_components(len(fp), [(i, j) for i in range(len(fp)) for j in range(i) if bin(fp[i] ^ fp[j]).count("1") <= 3])
    assert [r[2] for r in got] == [ids[r] for r in roots]
    assert simhash_dedup.simhash_groups(none).count() == 0
    assert simhash_dedup.keep_one(odd).columns == odd.columns


def test_simhash_dense(spark):
    """A group of near fingerprints beyond a large bucket, against all pairs."""
    rng = np.random.default_rng(3)
    base = rng.integers(0, 2**63, 5, dtype=np.uint64)
    fps = np.unique(np.concatenate([b ^ (np.uint64(1) << rng.integers(0, 64, 400, dtype=np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 400, dtype=np.uint64)) for b in base] + [rng.integers(0, 2**63, 500, dtype=np.uint64)]))
    df = spark.createDataFrame([(int(x),) for x in fps.view(np.int64)], "fp long")
    got = {r.node: r.root for r in simhash_dedup.near_fingerprints(df).collect()}
    roots = brute_components(len(fps), [(i, int(j)) for i in range(len(fps)) for j in np.flatnonzero(np.bitwise_count(fps[:i] ^ fps[i]) <= 3)])
    groups = {}
    for k, r in enumerate(roots):
        groups.setdefault(r, set()).add(int(fps.view(np.int64)[k]))
    for g in groups.values():
        assert len({got.get(x, x) for x in g}) == 1
    assert len(set(got.values())) == sum(len(g) > 1 for g in groups.values())


@pytest.mark.parametrize("t", [1, 2])
def test_simhash_probes(spark, monkeypatch, t):
    """A probe linked with two filed fingerprints that are not linked with each other keeps both links."""
    parts = [sum(1 << b for b in range(16 * k, 16 * k + 16)) for k in (0, 2, 3)]
    monkeypatch.setattr(simhash_dedup, "plan", lambda *_: [(m, k) for m, k in zip(parts, [t, *[0] * (3 - t)], strict=False)])
    at = lambda *bits: sum(1 << b for b in bits)
    b, p = 0, at(0, 32, 48)
    fps = [b, p, p ^ at(0, 33, 49), b ^ at(0, 34, 50)]
    rng = np.random.default_rng(t)
    for base in rng.integers(0, 2**62, 40):  # chains of steps of up to three bits
        for _ in range(12):
            base = int(base) ^ at(*map(int, rng.choice(62, rng.integers(1, 4), replace=False)))
            fps.append(base)
    fps = sorted(set(fps))
    roots = brute_components(len(fps), [(i, j) for i in range(len(fps)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 3])
    want = {f: fps[r] for f, r in zip(fps, roots, strict=True)}
    got = {r.node: r.root for r in simhash_dedup.near_fingerprints(spark.createDataFrame([(f,) for f in fps], "fp long")).collect()}
    assert {f: got.get(f, f) for f in fps} == want


def test_simhash_forest():
    """Every filed fingerprint that a probe links with is joined with it, whichever is met first."""
    p = 1 | 1 << 32 | 1 << 48
    filed = [p ^ (1 | 1 << 33 | 1 << 49), 0]
    for own in (filed, filed[::-1]):
        got = simhash_dedup._forest(np.array(own, np.uint64), np.array([p, 1 | 1 << 34 | 1 << 50], np.uint64), 3)
        assert {frozenset(e) for e in got} == {frozenset(e) for e in [(filed[0], p), (0, p), (0, 1 | 1 << 34 | 1 << 50)]}


def test_similar_stage(spark, monkeypatch):
    """The stage against all pairs of shingle sets: short texts, chains, groups over several blocks."""
    import corpus_pipeline

    monkeypatch.setattr(simhash_dedup, "VERIFY_BLOCK", 8)
    rng = random.Random(5)
    word = lambda: f"w{rng.randrange(4000)}"
    texts = ["", None, "a b", "A  b", "a c"]
    for size in [12, 20, 40, 80, 150, 300]:
        for _ in range(4):
            x = [word() for _ in range(size)]
            for _ in range(8):
                texts.append(" ".join(x))
                x = list(x)
                for _ in range(rng.randint(1, max(1, size // 45))):
                    x[rng.randrange(size)] = word()
    sets = [set(simhash_dedup.shingle_hashes(t, 5).tolist()) for t in texts]
    linked = [(i, j) for i in range(len(sets)) for j in range(i) if sets[i] == sets[j] or len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = sorted(r.doc_id for r in corpus_pipeline.near_stage(spark, docs, SF).collect())
    far = [(i, j) for i, j in linked if (simhash_dedup.fingerprint(texts[i], 5) ^ simhash_dedup.fingerprint(texts[j], 5)).bit_count() > 3]
    assert far and got == sorted(set(brute_components(len(texts), linked)))


@pytest.mark.parametrize("radius", [5, 7])
def test_wide_radius(spark, radius):
    """Fingerprints at more bits than two partitions with thresholds up to 2 can hold, against all pairs."""
    rng = np.random.default_rng(radius)
    fps = [int(x) for x in rng.integers(0, 2**62, 60)]
    fps += [f ^ sum(1 << int(b) for b in rng.choice(62, rng.integers(1, 10), replace=False)) for f in fps for _ in range(3)]
    fps = sorted(set(fps))
    want = brute_components(len(fps), [(i, j) for i in range(len(fps)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= radius])
    got = {r.node: r.root for r in simhash_dedup.near_fingerprints(spark.createDataFrame([(f,) for f in fps], "fp long"), radius).collect()}
    assert [got.get(f, f) for f in fps] == [fps[r] for r in want]


def test_stage_takes_fingerprints(spark, monkeypatch):
    """Candidates of the near-duplicate stage come from linked fingerprints, and the sets decide: no band, and still the near copy goes."""
    import corpus_pipeline

    monkeypatch.setattr(simhash_dedup, "_bands", lambda h: [])
    words = [f"w{i}" for i in range(400)]
    near, far = [*words[:200], "x", *words[201:]], [f"v{i}" for i in range(400)]
    sets = [simhash_dedup.shingle_hashes(" ".join(t), 5) for t in (words, near)]
    assert 0 < (simhash_dedup.majority(sets[0]) ^ simhash_dedup.majority(sets[1])).bit_count() <= simhash_dedup.STAGE_RADIUS
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate([words, near, far])] + [(3, "a b c"), (4, "d e f")], "doc_id long, text string")
    assert sorted(r.doc_id for r in corpus_pipeline.near_stage(spark, docs, SF).collect()) == [0, 2, 3, 4]


def test_keep_one_rows(spark):
    """Different texts under a null or shared id all stay; of a group one row stays."""
    x, y, z = ("alpha beta gamma delta", "one two three four", "red green blue black")
    rows = [(None, x), (None, y), (3, z), (3, x + " tail end more"), (4, y), (5, z), (None, z)]
    got = simhash_dedup.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(map(str, got)) == sorted(map(str, [r for r in spark.createDataFrame([rows[0], rows[2], rows[3], rows[4]], "doc_id long, text string").collect()]))


def test_thresholds():
    cost, ts = simhash_dedup.thresholds([[0, 1, 5, 9], [0, 100, 500, 900], [0, 2, 3, 50]], 4)
    assert sum(t + 1 for t in ts) == 4 and cost == 8 and ts == [1, -1, 1]


def test_embeddings(spark):
    rng = np.random.default_rng(2)
    centre = rng.standard_normal((12, 32))
    x = np.concatenate([centre[rng.integers(0, 12, 600)] + 0.25 * rng.standard_normal((600, 32)), np.repeat(centre[:1], 200, axis=0)])
    rows = [(i, [float(v) for v in x[i]], i % 3) for i in range(len(x))]
    rows += [(5000, None, 1), (5001, [0.0] * 32, 1), (5002, [float("nan")] * 32, 1), (5003, [1.0] * 32, None), (5004, [1.0, None], 1)]
    got = {r.vec_id: r for r in embedding_dedup.embedding_groups(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")).collect()}
    assert len(got) == len(rows)
    y = np.array([r[1] for r in rows[: len(x)]], dtype=np.float32).astype(float)
    y /= np.linalg.norm(y, axis=1, keepdims=True)
    close = (y @ y.T >= 0.93) & (np.arange(len(x))[:, None] % 3 == np.arange(len(x)) % 3)
    np.fill_diagonal(close, False)
    want = close.sum(axis=1)
    n = np.array([got[i].n_links for i in range(len(x))])
    assert (n <= want).all() and n.sum() >= 0.9 * want.sum()
    assert all(got[i].n_links == 0 and got[i].component_id == i for i in range(5000, 5005))


def test_embedding_borders(spark):
    """With a window over all rows one pass finds every link, however many partitions the rows fall in."""
    rng = np.random.default_rng(2)
    x = np.repeat(rng.standard_normal((60, 12)), 5, axis=0)
    x = (x + 0.22 * rng.standard_normal(x.shape)).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist(), 1) for i, v in enumerate(x)], "vec_id long, embedding array<float>, label int")
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        got = {r.vec_id: r for r in embedding_dedup.embedding_groups(df, passes=1, window=300).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    u = x.astype(np.float64) / np.linalg.norm(x.astype(np.float64), axis=1, keepdims=True)
    close = u @ u.T >= embedding_dedup.THRESHOLD
    assert [got[i].n_links for i in range(300)] == (close.sum(axis=1) - 1).tolist()


def test_embedding_passes():
    """More rows a label take more passes, for the stated recall of an isolated pair."""
    assert [embedding_dedup.passes_for(n) for n in (0, 48, 10_000)] == [embedding_dedup.PASSES] * 3
    assert embedding_dedup.PASSES < embedding_dedup.passes_for(10**6) < embedding_dedup.passes_for(10**7)


def test_lattice_and_scores(odd, none):
    x = lm_score.Lattice(lm_score.vocabulary_path())
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=lm_score.vocabulary_path())
    w = {sp.id_to_piece(i): x.logw[i] for i in range(sp.get_piece_size())}

    def brute(word):
        s = "▁" + word
        a = [0.0] + [-1e30] * len(s)
        for j in range(1, len(s) + 1):
            for i in range(j):
                if s[i:j] in w:
                    a[j] = np.logaddexp(a[j], a[i] + w[s[i:j]])
                elif j == i + 1:
                    a[j] = np.logaddexp(a[j], a[i] + sum(x.logw[x.bytes[b]] for b in s[i:j].encode()))
        return a[-1]

    words = ["the", "éñab", "z" * 70, "日本語", "ﬁx"]
    assert np.allclose(x.words(words), [brute(v) for v in words])
    rows = [r for r in odd.collect()]
    got = sorted(lm_score.lm_scores(odd).collect(), key=lambda r: (r.doc_id is not None, r.doc_id))
    train = [r for r in rows if zlib.crc32(("" if r.doc_id is None else str(r.doc_id)).encode()) % 5 != 1]
    c = {}
    for r in train:
        for t in [*lm_score.tokens(r.text), None]:
            c[t] = c.get(t, 0) + 1
    n, v = sum(c.values()), len(c)
    score = brute_model(x, {k.decode(): k_n for k, k_n in c.items() if k is not None}, c[None], n)
    for r, g in zip(sorted(rows, key=lambda r: (r.doc_id is not None, r.doc_id)), got, strict=True):
        t = [*lm_score.tokens(r.text), None]
        assert (g.n_tokens, g.n_known, g.train_tokens) == (len(t), sum(k in c for k in t), n)
        assert abs(g.base_score - sum(np.log10((c.get(k, 0) + 0.5) / (n + 0.5 * (v + 1))) for k in t)) < 1e-6 * len(t)
        assert abs(g.score - sum(score(k if k is None else k.decode()) for k in t)) < 1e-6 * len(t)
    assert lm_score.lm_scores(none).count() == 0
    alone = lm_score.lm_scores(odd.where("doc_id = 3"), folds=1, held_fold=0).collect()  # nothing to learn from
    assert alone[0].train_tokens == 0 and alone[0].score < 0


def brute_model(x, counts, ends, n):
    """Expectation steps and marginals by an explicit sum over all segmentations, word by word."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=lm_score.vocabulary_path())
    plain = {sp.id_to_piece(i): i for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i))}
    plain = {p: i for p, i in plain.items() if not any("A" <= k <= "Z" for k in p)}

    def arcs(s):
        for i in range(len(s)):
            for j in range(i + 1, len(s) + 1):
                if s[i:j] in plain:
                    yield i, j, [plain[s[i:j]]]
                elif j == i + 1:
                    yield i, j, [int(x.bytes[b]) for b in s[i:j].encode()]

    def forward(s, w):
        a = np.full(len(s) + 1, -1e30)
        a[0] = 0.0
        for i, j, p in arcs(s):
            a[j] = np.logaddexp(a[j], a[i] + sum(w[k] for k in p))
        return a

    def psi(e):  # exp(digamma) by a numeric derivative of log gamma
        from math import exp, lgamma

        return exp((lgamma(e + 1e-6) - lgamma(e - 1e-6)) / 2e-6) if e > 1e-5 else 0.0

    def own(c, spell, rest):
        o = 1.0
        for _ in range(lm_score.OWN_STEPS):
            w = psi(c * o) if c else 0.0
            o = w / max(w + n * rest * np.exp(spell), 1e-300)
        return psi(c * o) if c else 0.0

    w, rest = np.log(np.maximum(x.prior[:-1], 1e-300)), lm_score.START_REST
    for _ in range(lm_score.EM_STEPS):
        sums, taken = lm_score.PRIOR * x.prior[:-1], psi(ends)
        for word, c in counts.items():
            s = "▁" + word
            a = forward(s, w)
            back = np.full(len(s) + 1, -1e30)
            back[-1] = 0.0
            took = own(c, a[-1], rest)
            taken += took
            for i, j, p in sorted(arcs(s), key=lambda e: -e[0]):
                lp = sum(w[k] for k in p)
                back[i] = np.logaddexp(back[i], lp + back[j])
                for k in p:
                    sums[k] += (c - took) * np.exp(a[i] + lp + back[j] - a[-1])
        w, rest = np.log(np.maximum(sums / sums.sum(), 1e-300)), max(1 - taken / n, 1e-9)

    def score(word):
        spell, c = (np.log(lm_score.END_SPELLED), ends) if word is None else (forward("▁" + word, w)[-1], counts.get(word, 0))
        return np.log10(own(c, spell, rest) / n + rest * np.exp(spell)) if spell > -600 or c else (np.log(rest) + spell) / np.log(10)

    return score


def test_media(odd, none):
    for raw in (b"", b"abc", b"\xff" * 576, b"x" * 5000):
        p = media.padded(raw)
        assert len(p) % 576 == 0 and p and media.decode_png(media.encode_png(p)) == p
    text = {r.doc_id: r.text or "" for r in odd.collect()}
    rows = media.text_media(odd).collect()
    assert len(rows) == odd.count()
    for r in rows:
        raw = text[r.doc_id].encode()
        p = media.padded(raw)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), max(576, -(-len(raw) // 576) * 576), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-32:]))
        stored = media.encode_png(p)
        assert (r.media_bytes, r.media_sha256, r.feature) == (len(stored), hashlib.sha256(stored).hexdigest(), brute_feature(p))
        said = [x for x in (" ".join(x.split()) for x in text[r.doc_id].split("\n")) if x]
        first = bool(text[r.doc_id].split("\n")[0].strip())
        assert (r.position, r.n_items, r.texts_sha256) == (int(first), len(said) + 1, hashlib.sha256("\n".join(said).encode()).hexdigest())
        assert r.caption == f"text of document {'unknown' if r.doc_id is None else r.doc_id}"
    assert media.text_media(none).count() == 0


def brute_feature(p):
    w, n = 576, len(p)
    rows = [p[k : k + w] for k in range(0, n, w)]
    mean = sum(p) / n
    dev = (sum((b - mean) ** 2 for b in p) / n) ** 0.5
    share = [(sum(b // 16 == k for b in p) * 1000 + n // 2) // n for k in range(16)]
    cuts = [k * len(rows) // 8 for k in range(8)]
    bits = ""
    for k in range(8):
        band = rows[min(cuts[k], len(rows) - 1) : max((cuts + [len(rows)])[k + 1], min(cuts[k], len(rows) - 1) + 1)]
        for c in range(8):
            cell = [b for r in band for b in r[c * 72 : (c + 1) * 72]]
            bits += str(int(sum(cell) * n > sum(p) * len(cell)))
    return f"{len(rows)}|{mean:.4f}|{dev:.4f}|{','.join(map(str, share))}|{int(bits, 2):016x}"


@pytest.mark.parametrize(
    "html,want",
    [
        ('<p>one</p><figure><img src="sha256:ab" alt="x"><figcaption>cap</figcaption></figure><script>no</script>two', ["one", ("ab", "cap"), "two"]),
        ("a<figcaption>lone</figcaption>b", ["a", "lone", "b"]),
        ('<figure><figcaption>before</figcaption><img src="sha256:ab"><img src="sha256:cd" alt="x"></figure>z', [("ab", "before"), ("cd", "before"), "z"]),
        ('<figure><img src="sha256:ab"><figcaption>cap<p>rest</p></figure><p>end', [("ab", "cap"), "rest", "end"]),
        ('<figure><img src="sha256:ab"><figcaption>a <b>bold</b><p>cap</p></figcaption></figure>', [("ab", "a bold cap")]),
        ('<img srcset="sha256:ab 1x, sha256:cd 2x" title="t"><img data-src="sha256:ef">', [("ab", "t"), ("ef", None)]),
        ("<noscript>gone<p>all</p>", ["gone", "all"]),
        ("<noscript>gone</noscript>kept<template>x", ["keptx"]),
        ("<figure><figcaption>alone</figcaption></figure>", ["alone"]),
        ("", []),
        (None, []),
        ("<p>a &lt;b&gt; &amp;amp; c", ["a <b> &amp; c"]),
    ],
)
def test_media_sequence(html, want):
    items = media.sequence(html)
    assert [x["position"] for x in items] == list(range(len(items)))
    assert [x["text"] if x["kind"] == "text" else (x["digest"], x["caption"]) for x in items] == want


def test_media_pages(spark):
    """Real pages: the text items hold the page's visible words in order; unknown digests keep their place."""
    import re
    from html import unescape

    pages = spark.read.parquet(f"{SF}/pages.parquet")
    html = {r.page_id: r.html for r in pages.collect()}
    for r in media.sequences(pages).collect():
        bare = re.sub(r"(?is)<!--.*?-->|<(script|style|noscript|template)\b.*?</\1\s*>|<figcaption\b.*?</figcaption\s*>|<!doctype[^>]*>", " ", html[r.id])
        words = unescape(re.sub(r"(?s)<[^>]*>", " ", bare)).split()
        got = " ".join(i.text for i in r["items"] if i.kind == "text").split()
        assert "".join(got) == "".join(words)
    refs = media.references(media.sequences(spark.createDataFrame([(1, '<p>t</p><img src="sha256:00"><img src="x">')], "page_id long, html string")))
    store = spark.createDataFrame([("00", "payload")], "digest string, media string")
    assert sorted((r.position, r.media) for r in media.resolve(refs, store).collect()) == [(1, "payload"), (2, None)]


def test_pieces(odd, none):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=sentence_pieces.vocabulary_path())
    p = sentence_pieces.Pieces.load(sentence_pieces.vocabulary_path())
    texts = [r.text for r in odd.collect()] + ["a" * 300, "  two  spaces ", "\x00nul", "▁mark"]
    assert [x.tolist() for x in p.encode(texts)] == [sp.encode(t or "") for t in texts]
    assert all(r.same for r in sentence_pieces.round_trip(odd).collect())
    assert sentence_pieces.round_trip(none).count() == 0
    lone = [p.byte_ids[b] for b in (0x80, 0xE3, 0x81)]
    assert all(c == "\ufffd" for c in p.decode(np.array(lone[:1]))) and p.decode(np.array([*sp.encode("ab"), lone[0]])) == "ab\ufffd"
    back = sentence_pieces.decode(odd.sparkSession.createDataFrame([(1, sp.encode("two words")), (2, lone), (3, None), (4, [])], "doc_id long, ids array<int>"))
    assert {r.doc_id: r.text for r in back.collect() if r.doc_id != 2} == {1: "two words", 3: "", 4: ""}


def test_pieces_unigram():
    pieces = {"▁": 0, "a": 1, "b": 2, "ab": 3, "▁a": 4, "ba": 5}
    score = {0: -1.0, 1: -2.0, 2: -2.5, 3: -2.2, 4: -1.9, 5: -3.0}
    p = sentence_pieces.Pieces(pieces, score, list(range(6, 262)), merges=False)

    def best(s):
        a = [(0.0, [])] + [None] * len(s)
        for j in range(1, len(s) + 1):
            a[j] = max((a[i][0] + score[pieces[s[i:j]]], [*a[i][1], pieces[s[i:j]]]) for i in range(j) if s[i:j] in pieces)
        return a[-1]

    for t in ("abab", "bba", "a", "abbaab"):
        got = p.encode([t])[0].tolist()
        assert abs(sum(score[i] for i in got) - best("▁" + t)[0]) < 1e-9


def test_packing(odd, none):
    import public_tokenizers
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    special = odd.limit(1).select(*[F.lit(9000 if c == "doc_id" else "a <|endoftext|> b<|endoftext|>").alias(c) if c in ("doc_id", "text") else F.col(c) for c in odd.columns])
    odd = odd.unionByName(special)
    want = sorted([*tok.encode(r.text or "", add_special_tokens=False).ids, 1] for r in odd.collect())
    assert any(50256 in x for x in want)
    rows = packing.pack(odd.dropDuplicates(["doc_id"])).collect()
    got, seq = {}, {}
    for r in sorted(rows, key=lambda r: r.start):
        assert r.start == len(got.setdefault(r.doc_id, []))
        got[r.doc_id] += r.ids
        assert zlib.crc32(np.array(r.ids, dtype="<u4").tobytes()) == r.ids_crc32
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == seq.get(r.sequence_id, 0)
        seq[r.sequence_id] = r.offset + r.length
    assert max(seq.values()) <= 2048 and all(x in want for x in got.values())
    assert packing.pack(none).count() == 0


def test_packing_ranks():
    """BM25 sums by the formula, the choice of the best unused document, and windows that go on over shards."""
    rng = np.random.default_rng(1)
    docs = [rng.integers(2, 40, rng.integers(3, 30)).astype("<u2") for _ in range(30)]
    df = np.bincount(np.concatenate([np.unique(d) for d in docs]), minlength=1 << 16)
    mean = np.mean([len(d) for d in docs])
    weights = packing.idf(df, len(docs))

    def bm25(q, d):
        return sum(np.log1p((30 - df[t] + 0.5) / (df[t] + 0.5)) * (tf := (d == t).sum()) * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(d) / mean)) for t in np.unique(q))

    index = packing.Index(docs, weights, mean)
    assert np.allclose(index.scores(3), [bm25(docs[3], d) for d in docs], rtol=1e-4)
    pieces, window, offset = packing.fill(docs, 50, weights, mean, 7, 20)
    assert pieces[0][3:] == (7, 20) and sorted({p[0] for p in pieces}) == list(range(30))
    assert window == 7 + (20 + sum(map(len, docs))) // 50 and offset == (20 + sum(map(len, docs))) % 50
    used, seed, full = {pieces[0][0]}, pieces[0][0], 20 + pieces[0][2]
    for doc, start, size, w, at in pieces[1:]:
        assert at == full % 50
        if start == 0 and seed is not None and at:
            best = max(bm25(docs[seed], docs[d]) for d in range(30) if d not in used)
            assert bm25(docs[seed], docs[doc]) >= best - 1e-3
        if at == 0:
            seed = doc
        used.add(doc)
        full = at + size


def test_packing_lexical_shards(spark):
    """Likeness beats id order: topics that alternate by id come together in windows."""
    rng = random.Random(2)
    rows = [(i, " ".join(f"{'abcdefghij'[i % 10] * 3}{rng.randrange(60)}x" for _ in range(40))) for i in range(600)]
    by = {}
    for r in packing.pack(spark.createDataFrame(rows, "doc_id long, text string"), shard_docs=64).collect():
        by.setdefault(r.sequence_id, []).append(r.doc_id % 10)
    same = [max(map(x.count, x)) / len(x) for x in by.values() if len(x) > 3]
    assert sum(same) / len(same) > 0.6


def test_tool_calls(spark):
    c = duckdb.connect()
    c.sql(f"create view conversations as select * from '{SF}/conversations.parquet'")
    key = lambda r: (r[0], r[1], r[-1])
    cols = ["conv_id", "turn", "call_id", "name", "status", "level", "position", "n_results", "valid", "errors", "canonical_json"]
    got = sorted((tuple(r) for r in tool_calls.op3_tool_calls(spark, SF).select(cols).collect()), key=key)
    want = sorted(c.sql(f"select {', '.join(cols)} from ({tool_calls.ORACLE_SQL})").fetchall(), key=key)
    assert got == want
    calls = spark.createDataFrame([(1, 1, "a", "t", '{"n": 1}', None), (1, 2, "b", "t", '{"n": "x", "z": 1}', "a"), (1, 3, "c", "t", "oops", "d"), (1, 4, "d", "u", "{}", "c"), (None, 5, None, "t", None, None)], "conv_id long, turn long, call_id string, name string, arguments string, after string")
    results = spark.createDataFrame([(1, 5, "a", "r"), (1, 6, "q", "lost")], "conv_id long, turn long, call_id string, content string")
    schemas = spark.createDataFrame([("t", "n", "BIGINT", True)], "name string, field string, type string, required boolean")
    by = {r.call_id: r for r in tool_calls.link_calls(calls, results, schemas).collect()}
    assert sorted((r.position, r.call_id) for r in by.values() if r.conv_id and r.status != "orphan") == [(0, "a"), (1, "b"), (2, "c"), (3, "d")]
    assert {k: (r.status, r.level, r.errors) for k, r in by.items()} == {"a": ("linked", 0, ""), "b": ("unanswered", 1, "type of n; unknown z"), "c": ("cycle", None, "not an object"), "d": ("cycle", None, "no schema"), "q": ("orphan", None, ""), None: ("unanswered", None, "not an object")}


def test_tool_calls_cases(spark, tmp_path):
    """Null, long, repeated and clashing input: every turn gives a row, and an empty table none."""
    rows = [(1, 0, "user", None, "x"), (1, 1, "assistant", None, "x"), (1, 2, "user", "long " * 30000, "x"), (1, 2, "user", "twice", "x"), (1, 2, "user", "twice", "x"), (None, 3, "user", "t", "x"), (2, None, "assistant", "t", "x"), (3, 7, "other", "t", "x")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, level string")
    for k, d in enumerate((df, df.limit(0))):
        d.write.parquet(f"{tmp_path}/{k}/conversations.parquet")
    got = tool_calls.op3_tool_calls(spark, f"{tmp_path}/0").collect()
    assert sorted((r.conv_id or 0, r.position) for r in got if r.status != "orphan") == [(0, 0), (1, 0), (1, 1), (1, 2), (1, 3)]
    assert [(r.status, r.n_results, r.errors) for r in got if (r.conv_id, r.turn) == (1, 0)] == [("linked", 1, "missing query")]
    assert len(got) == 6 and tool_calls.op3_tool_calls(spark, f"{tmp_path}/1").count() == 0


def auc(score, truth):
    """Share of pairs in the right order."""
    up, down = np.array(score)[np.array(truth) == 1], np.array(score)[np.array(truth) == 0]
    return ((up[:, None] > down).mean() + (up[:, None] == down).mean() / 2) if len(up) and len(down) else 1.0


def test_quality(odd, none, spark):
    docs, labels = spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    got = quality.scores(docs, labels).join(labels, "doc_id").where("held_out").toPandas()
    assert auc(got.score, got.quality) > 0.95
    assert quality.scores(odd, labels.limit(0)).where("kept").count() == odd.count()
    assert quality.scores(none, labels).count() == 0
    assert quality.scores(odd, labels).count() == odd.count()  # no metadata to speak of
    assert quality.scores(docs.select("doc_id", "text").limit(50), labels).count() == 50


def test_quality_exchange(spark):
    """What a view counts of the other's sure documents, against counting them one by one."""
    rng = random.Random(9)
    texts = [" ".join(rng.choice(("good", "fine", "nice") if i % 2 else ("bad", "poor", "junk")) for _ in range(30)) for i in range(200)]
    meta = [("en", "a" if i % 2 else "b", 30.0) for i in range(200)]
    d = quality.Documents(texts, *map(list, zip(*meta, strict=True)))
    y = np.arange(200) % 2
    none = [(np.zeros((2, n)), np.zeros(2)) for n in (quality.WORDS, quality.LANGS + quality.SOURCES + quality.LENGTHS)]
    m = quality.Model().learn(d, y, none)
    rows = spark.createDataFrame([(i, t, *x) for i, (t, x) in enumerate(zip(texts, meta, strict=True))], "id long, text string, lang string, source string, n double")
    got = {}
    for r in rows.repartition(3).mapInArrow(quality._exchange(m), "view int, label int, value int, n double").collect():
        got[r.view, r.label, r.value] = got.get((r.view, r.label, r.value), 0) + r.n
    want = {}
    for k, (v, x) in enumerate(zip(m.views, d.both(), strict=True)):
        for i, p in enumerate(1 / (1 + np.exp(-v.logit(*x)))):
            for label, sure in ((1, p), (0, 1 - p)):
                if sure >= quality.SURE:
                    for value in [*d.both()[1 - k][0][i].tolist(), -1]:
                        want[1 - k, label, value] = want.get((1 - k, label, value), 0) + 1
    assert want and got == want
    taught = quality.Model().learn(d, y, [(np.ones_like(c), n + 1) for c, n in none])
    assert auc(taught.score(d), y) > 0.99


def test_toxicity(odd, none, spark):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    assert toxicity.scores(odd, labels.limit(0)).where("score = 0.5").count() == odd.count()
    assert toxicity.scores(none, labels).count() == 0
    rng = random.Random(4)
    clean = [f"w{rng.randint(0, 80)}" for _ in range(400)]
    texts = [" ".join(rng.choice(clean) for _ in range(rng.randint(5, 150))) + (" vile" * (i % 4 == 0)) for i in range(240)]
    m = toxicity.train(texts[:160], np.array([i % 4 == 0 for i in range(160)]))
    s = m.score([*texts[160:], None, "", "w1 " * 30000, "w1 " * 30000])
    assert auc(s[:80], np.arange(160, 240) % 4 == 0) > 0.95 and ((s >= 0) & (s <= 1)).all() and s[-1] == s[-2]


def test_toxicity_labels(spark):
    """Held-out labelled documents of a larger table."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{x}.parquet") for x in ("documents", "labels"))
    docs = docs.join(labels, "doc_id", "left_semi")
    got = toxicity.scores(docs, labels).where("held_out").join(labels, "doc_id").toPandas()
    assert auc(got.score, got.toxic) > 0.94


def test_toxicity_gradients():
    """Gradients of weights and inputs against differences."""
    rng = np.random.default_rng(0)
    net = toxicity.Network(rng)
    net.p = {k: np.asarray(v, dtype=np.float64) for k, v in net.p.items()}
    x, mask = rng.standard_normal((5, 3, toxicity.INPUTS)).astype(np.float32), np.ones((5, 3), bool)
    mask[3:, 1] = False
    y, w = np.array([1.0, 0.0, 1.0]), np.array([2.0, 1.0, 1.0])
    _, g, gin = net.gradients(x, mask, y, w)
    loss = lambda: net.gradients(x, mask, y, w)[0]
    for k, at in (("xf", (2, 3)), ("hb", (1, 5)), ("a", (3, 2)), ("o", (4,))):
        net.p[k][at] += 1e-2
        up = loss()
        net.p[k][at] -= 2e-2
        down = loss()
        net.p[k][at] += 1e-2
        assert abs((up - down) / 2e-2 - g[k][at]) < 2e-3
    x[1, 0, 4] += 1e-2
    up = loss()
    x[1, 0, 4] -= 2e-2
    assert abs((up - loss()) / 2e-2 - gin[1, 0, 4]) < 2e-3


def test_pipeline(spark, tmp_path, odd):
    """Every stage on all its predecessor kept, with decisions by brute force, other columns kept, and the whole run."""
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    docs = docs.unionByName(spark.createDataFrame([(10**6 + k, t, "en", "src0", 0) for k, t in enumerate([None, "", "", "twice over the very same words here", "twice over the very same words here"])], docs.schema))
    docs = docs.withColumn("score", F.lit(1)).withColumn("my col-x", F.lit("y"))
    (tmp_path / "in").mkdir()
    docs.write.parquet(f"{tmp_path}/in/documents.parquet")
    spark.read.parquet(f"{SF}/labels.parquet").write.parquet(f"{tmp_path}/in/labels.parquet")
    sf = f"{tmp_path}/in"
    now, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    key = lambda d: sorted(map(str, d.collect()))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, now, sf)
        assert out.columns == docs.columns
        out.write.parquet(f"{tmp_path}/{name}")
        out = spark.read.parquet(f"{tmp_path}/{name}")
        rows = [(r.doc_id, r.text) for r in now.collect()]
        if name == "toxicity":
            bad = {r.doc_id for r in toxicity.scores(now, labels).where(f"score >= {toxicity.THRESHOLD}").collect()}
            assert sorted(r.doc_id for r in out.collect()) == sorted(i for i, _ in rows if i not in bad)
        elif name == "quality":
            bad = {r.doc_id for r in quality.scores(now, labels).where("NOT kept").collect()}
            assert sorted(r.doc_id for r in out.collect()) == sorted(i for i, _ in rows if i not in bad)
        elif name == "line_dedup":
            assert sorted((r.doc_id, hashlib.sha256(r.text.encode()).hexdigest()) for r in out.collect()) == [(i, h) for i, _, _, h in brute_lines(rows)]
        else:
            sets = [set(simhash_dedup.shingle_hashes(t, 5).tolist()) for _, t in rows]
            linked = [(i, j) for i in range(len(sets)) for j in range(i) if sets[i] == sets[j] or len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
            root = brute_components(len(rows), linked)
            assert sorted(r.doc_id for r in out.collect()) == sorted(min(rows[i][0] for i in range(len(rows)) if root[i] == k) for k in set(root))
        now = out
    packed = corpus_pipeline.STAGES[-1][1](spark, now, sf)
    assert {r.doc_id for r in packed.collect()} == {r.doc_id for r in now.collect()}
    assert key(corpus_pipeline.run(spark, sf).groupBy("doc_id").agg(F.sum("length"))) == key(packed.groupBy("doc_id").agg(F.sum("length")))
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, odd.where("false"), sf).count() == 0
        if name != "packing":
            assert stage(spark, odd, SF).columns == odd.columns
