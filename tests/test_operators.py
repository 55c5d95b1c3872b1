import itertools
import re

import pytest

from pyspark.sql import functions as F

from notelink.functions import drug as dg
from notelink.functions import similarity as si
from notelink.functions import text as tx
from notelink.operators import assertions as an
from notelink.operators import disease_ranking as di
from notelink.operators import drug_ranking as dr
from notelink.operators import output as ou
from notelink.operators import repairs as re_
from notelink.operators import batching as ba
from notelink.operators import linking as ln
from notelink.operators import corpus as co
from notelink.operators import generation as ge
from notelink.operators import notes as no
from notelink.operators import spans as sp
from notelink.operators import vocabulary as vo
from notelink.sources import sinks
from notelink.sources import tables as src
from notelink.streaming import cache as ca


def test_text(spark):
    df = spark.createDataFrame([("  Amlodipine  10 mg Oral Tablet ", "Viêm (G02.0*) (A17.0†)", "đường Đỏ é")], "a string, b string, c string")
    r = df.select(tx.lexical_text(F.col("a")).alias("a"), tx.without_references(F.col("b")).alias("b"), tx.fold_marks(F.col("c")).alias("c")).first()
    assert (r.a, r.b, r.c) == ("amlodipine 10 MG oral tablet", "Viêm", "duong Do e")


def test_relation_direction(spark, tmp_path):
    (tmp_path / "rel").write_text("329526||CUI|RO|308135||CUI|consists_of|1||RXNORM|||||4096|\n")
    rel = src.read_rrf(spark, str(tmp_path / "rel"), "RXNREL")
    concepts = spark.createDataFrame([("308135", "SCD"), ("329526", "SCDC")], "rxcui string, tty string")
    r = src.relations(rel, concepts).first()
    assert (r["source"], r["rela"], r["target"]) == ("308135", "consists_of", "329526")


def test_generic_inheritance(spark):
    concepts = spark.createDataFrame([("1", "SBDC"), ("2", "SCDC"), ("3", "IN"), ("4", "BN")], "rxcui string, tty string")
    edges = spark.createDataFrame([("1", "has_ingredient", "4", 0), ("1", "tradename_of", "2", 1), ("2", "has_ingredient", "3", 2)], "source string, rela string, target string, line long")
    attrs = spark.createDataFrame([("2", "RXN_STRENGTH", "10 MG", 0)], "rxcui string, atn string, atv string, line long")
    r = vo.components(edges, attrs, concepts).where("rxcui = '1'").first()
    assert (r.ingredient, r.strength) == ("3", "10 MG")


def test_history(spark):
    remaps = spark.createDataFrame([("1", "2", 0), ("3", "", 1)], "old string, current string, line long")
    archive = spark.createDataFrame([("5", "x", "2001", "2003", "ENG", "RXNORM", "IN", "", 0)], "old string, text string, created string, updated string, lat string, sab string, tty string, merged string, line long")
    assert {r.old: r.status for r in vo.history(remaps, archive).collect()} == {"1": "remapped", "3": "retired", "5": "archived"}


def test_intersection_or_union(spark):
    m = spark.createDataFrame([("m", "a"), ("m", "b"), ("n", "a"), ("n", "z")], "m string, part string")
    i = spark.createDataFrame([("a", 1), ("a", 2), ("b", 2)], "part string, code int")
    got = {(r.m, r.code) for r in ln.components_or_union(m, i, "m", "part", "code").collect()}
    assert got == {("m", 2), ("n", 1), ("n", 2)}


def test_covering_by_sets(spark, monkeypatch):
    """Against all pairs: nulls, repeated rows, sets with members in several blocks; the parts are joined by distinct sets."""
    monkeypatch.setattr(ln, "COVER_BLOCK", 4)
    need = [(m, p) for m in range(40) for p in ("abc"[: m % 3 + 1] + "d" * (m == 7))] + [(40, None), (41, "a"), (41, None), (None, "a"), (5, "a"), (5, "a"), (42, "z")]
    have = [(c, p) for c in range(30) for p in ("abcd"[c % 2 : c % 4 + 1])] + [(30, None), (31, "a"), (31, None), (None, "a"), (None, "b")]
    of = lambda rows, k: {p for x, p in rows if x == k}
    want = [(m, c) for m in {m for m, _ in need} - {None} for c in {c for c, _ in have} if None not in of(need, m) and of(need, m) <= of(have, c)]
    df = ln.covering(spark.createDataFrame(need, "m long, p string"), spark.createDataFrame(have, "c long, p string"), "m", "p", "c")
    assert sorted(map(tuple, df.collect()), key=str) == sorted(want, key=str) and df.columns == ["m", "c"]
    assert not re.search(r"Aggregate \[m#\d+L?, c#", df._jdf.queryExecution().optimizedPlan().toString())  # no grouping of all pairs


def test_covering_opens_blocks_in_two_stages(spark):
    """All pairs of 600 and 5000, in several blocks each; one compiled stage for both loops would keep the pairs of two blocks on the heap."""
    need, have = (spark.range(n).selectExpr(f"id as {k}", "'a' as p") for n, k in ((600, "m"), (5000, "c")))
    df = ln.covering(need, have, "m", "p", "c")
    assert len(df.collect()) == len({*map(tuple, df.collect())}) == 600 * 5000
    stages = re.findall(r"\*\((\d+)\) Generate explode\(_[mc]#", df._jdf.queryExecution().executedPlan().toString())
    assert len(stages) == 2 == len({*stages})


def test_schedule_is_best(spark):
    rows = [("r", 0, 5, 0.6), ("r", 4, 9, 0.9), ("r", 8, 12, 0.7), ("r", 5, 8, 0.3), ("r", 12, 13, 0.5)]
    got = sp.schedule(spark.createDataFrame(rows, "k string, start int, end int, score double"), "k").collect()
    best = max((c for n in range(6) for c in itertools.combinations(rows, n) if all(a[2] <= b[1] or b[2] <= a[1] for a, b in itertools.combinations(c, 2))), key=lambda c: sum(x[3] ** 3 for x in c))
    assert abs(sum(r.score**3 for r in got) - sum(x[3] ** 3 for x in best)) < 1e-9


def test_bio(spark):
    w = spark.createDataFrame([("r", 0, 3), ("r", 4, 8), ("r", 9, 12)], "id string, start int, end int")
    e = spark.createDataFrame([("r", 4, 12, "X")], "id string, start int, end int, type string")
    tags = sp.bio_tags(w, e, "id")
    assert [r.tag for r in tags.orderBy("start").collect()] == ["O", "B-X", "I-X"]
    assert [(r.start, r.end) for r in sp.bio_runs(tags, "id").collect()] == [(4, 12)]


def test_occurrences(spark):
    df = spark.createDataFrame([("Không sốt. Hôm qua từng sốt.", "sốt")], "t string, n string")
    assert df.select(sp.occurrences(F.col("t"), F.col("n"))).first()[0] == [6, 24]


def test_drug_parse(spark):
    rows = ["acetaminophen 325-650 mg po q6h:prn", "guaifenesin ml po q6h:prn", "glucose 5%", "Augmentin (amoxicillin) 1 g tiêm tĩnh mạch", "amoxicillin và paracetamol", "kháng sinh", None]
    got = [r.parsed for r in dg.parse_mentions(spark.createDataFrame([(x,) for x in rows], "m string").coalesce(1), "m").collect()]
    assert (got[0].strengths, got[0].strength_role, got[0].route, got[0].interval_hours) == (["325-650 MG"], "range", "PO", 6)
    assert got[1].core == "guaifenesin" and "liquid_form_hint" in [v.source for v in got[1].variants]
    assert got[2].strengths == ["5 PERCENT", "50 MG/ML"]
    assert (got[3].core, got[3].brands, got[3].route) == ("amoxicillin", ["augmentin"], "IV")
    assert got[4].components == ["amoxicillin", "acetaminophen"] and "multi_ingredient_mention" in got[4].warnings
    assert got[5].warnings == ["generic_drug_class"] and got[6].warnings == ["missing_ingredient"]


def test_once_per_text(spark):
    """A text that many mentions share is worked on once, and each of them gets its rows; a null text too."""
    seen = []

    def of(texts):
        seen.append(sorted(r.a or "" for r in texts.collect()))
        return texts.select("mention_id", F.explode(F.array(F.lit(1), F.lit(2))).alias("k"), F.coalesce(F.length("a"), F.lit(-1)).alias("n"))

    rows = [(1, "x"), (2, "yy"), (3, "x"), (3, "x"), (4, None), (5, None)]
    got = sorted(map(tuple, dr.once_per_text(spark.createDataFrame(rows, "mention_id long, a string"), ["a"], of).collect()))
    assert seen == [["", "x", "yy"]]
    assert got == sorted((i, k, len(t) if t else -1) for i, t in rows for k in (1, 2))


def test_terms_in_turn(spark):
    """Replacements that feed each other run in turn; a text that holds none stays as it is."""
    texts = ["senna xr po 5 mg", "adrenalin ngày po 2 lần", "plain 5 mg", "", None]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(dg.normalized(F.col("t"))).collect()]
    assert got == ["sennosides extended release 5 mg", "epinephrine", "plain 5 mg", "", None]


def test_pack_quantity(spark):
    p = spark.createDataFrame([("{24 (drug A Oral Tablet) / 4 (inert Oral Tablet) } Pack", x) for x in ("drug A", "inert", "none")], "n string, i string")
    assert [r[0] for r in p.select(dg.pack_quantity(F.col("n"), F.col("i"))).collect()] == [24.0, 4.0, None]


def test_similarity():
    def lcs(a, b):
        best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
        return best[-1][-1]

    words = ["", "a", "amlodipine", "amlodipin", "amiodarone", "aspirin", "abcabcabc", "cbacba"]
    for a, b in itertools.product(words, words):
        assert abs(si.indel_ratio(a, b) - (2 * lcs(a, b) / (len(a) + len(b)) if a or b else 1.0)) < 1e-12
    assert si.guarded_ratio("vitamin 3b", "vitamin k3") == 0.0 and si.token_set_ratio("b a", "a b c") == 1.0


def test_disease_rank(spark):
    m = "tăng huyết áp vô căn"
    rows = [(1, m, "I10", "Tăng huyết áp vô căn (nguyên phát)", "preferred", 0.9, 3, None), (1, m, "I1", "Tăng huyết áp vô căn", "preferred", 0.8, 1, None), (1, m, "Z03", "khong tang", "alias", 0.7, 1, None)]
    got = di.rank_diseases(spark.createDataFrame(rows, "mention_id long, mention string, code string, term string, term_type string, aggregate_score double, query_variants long, alias_source string")).orderBy("rank").collect()
    assert [(r.code, r.level) for r in got] == [("I1", "exact"), ("I10", "strong"), ("Z03", "rejected")]
    assert got[0].has_descendants and len(got[2].conflicts) == 2


def test_negation(spark):
    cases = [("Không ghi nhận vã mồ hôi, run tay hay choáng váng", ["vã mồ hôi", "run tay", "choáng váng"], ["direct"] * 3), ("phủ nhận sốt nhưng có đau đầu", ["sốt", "đau đầu"], ["direct", "blocked"]), ("không sốt, đau ngực", ["sốt", "đau ngực"], ["direct", "blocked"]), ("sốt", ["sốt"], ["absent"])]
    for raw, texts, want in cases:
        d = spark.createDataFrame([(raw, raw.index(x), raw.index(x) + len(x), x, an.SYMPTOM) for x in texts], "raw string, start int, end int, text string, type string").coalesce(1)
        got = [r[0] for r in d.select(an.negation(F.col("raw"), F.col("start"), F.col("end"), F.col("text"), F.col("type"))).collect()]
        assert got == want, raw


def test_assertions(spark):
    raw = "Mẹ của bệnh nhân bị hen. Trước đây từng viêm phổi. Hiện tại sốt."
    rows = [(raw, raw.index(x), raw.index(x) + len(x), x, k, "unknown", [an.HISTORICAL]) for x, k in [("hen", an.DISEASE), ("viêm phổi", an.DISEASE), ("sốt", an.SYMPTOM), ("sốt", an.TEST)]]
    d = spark.createDataFrame(rows, "raw string, start int, end int, text string, type string, section string, assertions array<string>").coalesce(1)
    assert [r.assertions for r in an.repaired(d).collect()] == [[an.HISTORICAL, an.FAMILY], [an.HISTORICAL], [], []]
    gate = spark.createDataFrame([("viên", an.DRUG), ("500 mg", an.DRUG), ("uống ngày 2 lần", an.DRUG), ("stent mạch vành", an.DISEASE), ("aspirin", an.DRUG)], "t string, k string").coalesce(1)
    assert [r[0] for r in gate.select(an.linkable(F.col("t"), F.col("k"))).collect()] == [False, False, False, False, True]


def test_output(spark):
    schema = "record_id string, raw string, text string, type string, candidates array<string>, assertions array<string>, start int, end int, position int"
    good = [("r", "đau đầu, aspirin", "đau đầu", an.SYMPTOM, [], [an.NEGATED], 0, 7, 0), ("r", "đau đầu, aspirin", "aspirin", an.DRUG, ["1191"], [], 9, 16, 1)]
    assert ou.violations(spark.createDataFrame(good, schema)).count() == 0
    bad = [("r", "abc", "ab", an.TEST, ["1", "1"], ["x"], 0, 3, 0), ("r", "abc", "abcd", an.DRUG, ["1", "2", "3"], [], -1, 4, 1)]
    rules = {r.rule for r in ou.violations(spark.createDataFrame(bad, schema)).collect()}
    assert {"repeated_code", "codes_on_unlinked_type", "unknown_assertion", "assertion_on_other_type", "text_is_not_slice", "too_many_codes", "bad_offsets", "unsorted", "past_end"} <= rules
    assert ou.record_json(spark.createDataFrame(good[::-1], schema)).first().json.startswith('[{"text":"đau đầu","type":"TRIỆU_CHỨNG","candidates":[],"assertions":["isNegated"],"position":[0,7]}')
    j = spark.createDataFrame([('Here:\n```json\n{"a": [1, 2,],}\n```',), ("none",)], "s string").coalesce(1)
    assert [r[0] and r[0].a for r in j.select(ou.tolerant_json(F.col("s"), "a array<int>")).collect()] == [[1, 2], None]


def test_sections(spark):
    a = "Mở đầu\nTiền sử bệnh: hen\n2. Tiền sử bệnh hiện tại\nsốt\nKhám tại bệnh viện: ổn"
    b = "Câu hỏi: tôi đau?\nTrả lời: nghỉ"
    d = spark.createDataFrame([(1, a), (2, b), (3, None), (4, "không có gì")], "id long, t string")
    got = no.sections(d, "id", "t").orderBy("id", "block").collect()
    assert [(r.id, r.section_no) for r in got] == [(1, 0), (1, 1), (1, 2), (1, 3), (2, 4), (3, 0), (4, 0)]
    assert "".join(r.body for r in got if r.id == 1) == a and all(r.body == (a if r.id == 1 else b)[r.start : r.end] for r in got if r.id < 3)


def test_scopes(spark):
    t = "x\nTiền sử bệnh: hen\nLý do vào viện: sốt\nTiền sử gia đình: tim\n1. amlodipine 10 mg po\n2. Lời dặn\n- nên nghỉ"
    got = no.scope_blocks(spark.createDataFrame([(1, t), (2, None)], "id long, t string"), "id", "t").orderBy("id", "start").collect()
    assert [r.kind for r in got] == ["unknown", "historical", "current", "family_history", "general", "general", "unknown"]
    assert "".join(t[r.start : r.end] for r in got if r.id == 1) == t


def test_medication_list(spark):
    t = "Danh sách thuốc trước nhập viện:\n1. amlodipine 10 mg po daily điều trị tăng huyết áp\n2. aspirin 81 mg"
    got = no.medication_list(spark.createDataFrame([(1, t), (2, "1. x"), (3, None)], "id long, t string"), "id", "t").orderBy("start").collect()
    assert [r.text for r in got] == ["amlodipine 10 mg po daily", "aspirin 81 mg"] and all(t[r.start : r.end] == r.text for r in got)


def test_joined_names(spark):
    lex = spark.createDataFrame([("doxycycline", "doxycycline"), ("bactrim", "bactrim"), ("nitro", "nitro"), ("glycerin", "glycerin"), ("nitroglycerin", "nitroglycerin"), ("aspirin", "aspirin")], "compact string, term string")
    m = spark.createDataFrame([(1, "doxycyclinebactrim"), (2, "nitroglycerin"), (3, "aspirin oral"), (4, "zzz")], "id long, n string")
    assert {r.id: r.parts for r in no.split_joined(m, lex, "id", "n").collect()} == {1: ["doxycycline", "bactrim"], 3: ["aspirin"]}


def test_nearest_in_blocks(spark):
    import random

    rnd = random.Random(1)
    rows = [(i, [rnd.random() for _ in range(4)]) for i in range(60)]
    d = spark.createDataFrame(rows, "id long, v array<double>")
    one = {tuple(r) for r in ln.nearest(d.where("id < 20"), d, "id", "id", "v", 3).select("q", "code", "rank").collect()}
    many = {tuple(r) for r in ln.nearest(d.where("id < 20"), d, "id", "id", "v", 3, block=7, shards=3).select("q", "code", "rank").collect()}
    assert one == many and len(one) == 60


def test_prompt_batches(spark):
    d = spark.createDataFrame([(i, 10 + i * 37 % 2000) for i in range(200)], "id long, n int")
    got = ba.pack_prompts(d, "id", "n", batch_size=12, output_tokens=100, most_tokens=8192).collect()
    assert sorted(r.id for r in got) == list(range(200))
    for _, g in itertools.groupby(sorted(got, key=lambda r: r.batch), key=lambda r: r.batch):
        ns = [r.n for r in g]
        assert len(ns) <= 12 and (len(ns) == 1 or (max(ns) + 100) * len(ns) <= 8192)


def test_cached_answers(spark, tmp_path):
    r = spark.createDataFrame([("a", "x"), ("b", "y"), ("b", "y"), ("c", "bad")], "request_id string, prompt string")
    c = spark.createDataFrame([("a", "old"), ("b", None)], "request_id string, answer string")
    out, fresh = ba.answer(r, c, lambda xs: [None if x == "bad" else x.upper() for x in xs], str(tmp_path / "fresh"))
    assert sorted((x.request_id, x.answer or "") for x in out.collect()) == [("a", "old"), ("b", "Y"), ("b", "Y"), ("c", "")]
    assert [x.request_id for x in fresh.collect()] == ["b"]


def test_sinks(spark, tmp_path):
    d = spark.range(10)
    assert sinks.write_json_lines(d, str(tmp_path / "j")) == 10
    keep, drop = sinks.split_rows(d, F.when(F.col("id") > 6, "big"), "keep", "drop", str(tmp_path / "s"))
    assert keep.count() == 7 and sorted((r.id, r.reason) for r in drop.collect()) == [(7, "big"), (8, "big"), (9, "big")]
    assert sinks.report(d, {"even": F.col("id") % 2 == 0}).first().asDict() == {"rows": 10, "even": 5}
    assert all(len(r.sha256) == 64 for r in sinks.manifest(spark, str(tmp_path / "j")).collect())


def test_stream_log(spark, tmp_path):
    spark.createDataFrame([("a", 1, True), ("a", 2, True), ("b", 1, True)], "k string, n long, valid boolean").write.parquet(str(tmp_path / "in"))
    s = spark.readStream.schema("k string, n long, valid boolean").parquet(str(tmp_path / "in"))
    ca.keep_latest(s, str(tmp_path / "log"), str(tmp_path / "cp"), "k", "n").awaitTermination(60)
    got = ca.last_write(spark.read.parquet(str(tmp_path / "log")).drop("batch"), "k", "n").collect()
    assert {r.k: r.n for r in got} == {"a": 2, "b": 1}


def test_repairs(spark):
    S, D, R, T_ = an.SYMPTOM, an.DISEASE, an.RESULT, an.TEST
    cases = [
        ("Công thức máu: WBC:12,5; NEUT% (a):78,2; LYPH% (b):15,3", [("WBC:12,5; NEUT% (a):78,2; LYPH% (b):15,3", R, [])], [("WBC", T_, []), ("12,5", R, []), ("NEUT% (a)", T_, []), ("78,2", R, []), ("LYPH% (b)", T_, []), ("15,3", R, [])]),
        ("phủ nhận sốt nhưng có đau đầu", [("sốt", S, []), ("đau đầu", S, [])], [("sốt", S, [an.NEGATED]), ("đau đầu", S, [])]),
        ("không ho, hen (J45.9)", [("không ho", S, []), ("hen (J45.9)", D, [an.HISTORICAL, an.NEGATED])], [("ho", S, [an.NEGATED]), ("hen", D, [an.NEGATED])]),
        ("thiếu men G6PD, dị ứng thuốc", [("thiếu men G6PD", T_, [an.NEGATED]), ("dị ứng thuốc", S, [])], [("thiếu men G6PD", D, []), ("dị ứng thuốc", D, [])]),
        ("sốt và sốt", [("sốt", S, [])] * 3 + [("ảo", S, [])], [("sốt", S, [])] * 2),
        ("nhịp xoang 80", [("nhịp xoang 80", R, [])], [("nhịp xoang 80", R, [])]),
        ("không có tiền sử lao", [("lao", D, [an.HISTORICAL])], [("lao", D, [an.NEGATED])]),
        ("", [], []),
    ]
    d = spark.createDataFrame([(i, t, es, None) for i, (t, es, _) in enumerate(cases)] + [(98, "x", [("x", "?", [])], None), (99, "hen", [("hen", D, None)], "tien_su")], f"id int, input_text string, entities {re_.ENTITIES}, section string")
    got = {r.id: r for r in re_.repaired_records(d).collect()}
    for i, (_, _, want) in enumerate(cases):
        assert [(e.text, e.type, e.assertions) for e in got[i].entities] == want, i
    assert got[98].reason == "unknown_type" and got[5].log == [] and "split_lab" in got[0].log
    assert got[99].entities[0].assertions == [an.HISTORICAL] and got[99].log == ["history_section"]


def test_type_list():
    assert co.type_list("scd, SBD,scd", [*co.PRIMARY, *co.PACKS]) == ["SCD", "SBD"]
    for wrong in ("", "XX", "SCD,XX"):
        with pytest.raises(ValueError):
            co.type_list(wrong, co.PRIMARY)


def test_hooks():
    assert ge.hook("segment", str.split)("a b") == ["a", "b"] and ge.hook("segment") is str.split
    with pytest.raises(KeyError):
        ge.hook("nothing")
