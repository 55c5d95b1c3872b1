"""Case queries of repairs of training records, of files and of generation schedules."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import answers as an
from ..operators import batching as ba
from ..operators import generation as ge
from ..operators import repairs as rp
from ..operators import spans as sp
from ..operators.assertions import DISEASE, DRUG, FAMILY, HISTORICAL, NEGATED, RESULT, SYMPTOM, TEST
from ..sources import records as sr
from .cases import case_query
from .note_cases import scratch

QUERIES: dict = {}
ORACLE: dict[str, str] = {}

REPAIRED = [
    (("WBC 12", [("WBC", TEST, [NEGATED])], None), (f"WBC/{TEST}/", "strip_lab_assertions", None)),
    (("viêm phổi (J18.9)", [("viêm phổi (J18.9)", DISEASE, [])], None), (f"viêm phổi/{DISEASE}/", "strip_code", None)),
    (("không sốt", [("không sốt", SYMPTOM, [])], None), (f"sốt/{SYMPTOM}/{NEGATED}", "negation_leak", None)),
    (("đau khi đi", [("đau khi", SYMPTOM, [])], None), (f"đau/{SYMPTOM}/", "trim_connector", None)),
    (("Không ghi nhận ho, nôn", [("ho", SYMPTOM, []), ("nôn", SYMPTOM, [])], None), (f"ho/{SYMPTOM}/{NEGATED}|nôn/{SYMPTOM}/{NEGATED}", "negation_scope", None)),
    (("Không ghi nhận ho nhưng nôn", [("ho", SYMPTOM, []), ("nôn", SYMPTOM, [])], None), (f"ho/{SYMPTOM}/{NEGATED}|nôn/{SYMPTOM}/", "negation_scope", None)),
    (("Hb 9 g/dl", [("Hb 9 g/dl", RESULT, [])], None), (f"Hb/{TEST}/|9 g/dl/{RESULT}/", "split_lab", None)),
    (("WBC: 12; CRP: 5", [("WBC: 12; CRP: 5", RESULT, [])], None), (f"WBC/{TEST}/|12/{RESULT}/|CRP/{TEST}/|5/{RESULT}/", "split_lab", None)),
    (("dị ứng thuốc", [("dị ứng thuốc", SYMPTOM, [])], None), (f"dị ứng thuốc/{DISEASE}/", "allergy_is_diagnosis", None)),
    (("thiếu men G6PD", [("thiếu men G6PD", RESULT, [])], None), (f"thiếu men G6PD/{DISEASE}/", "enzyme_disease", None)),
    (("tiền sử hen", [("tiền sử hen", DISEASE, [])], None), (f"hen/{DISEASE}/{HISTORICAL}", "diagnosis_context,marked_history", None)),
    (("không có tiền sử hen", [("hen", DISEASE, [HISTORICAL])], None), (f"hen/{DISEASE}/{NEGATED}", "negation_scope,negated_history", None)),
    (("hen. aspirin", [("hen", DISEASE, []), ("aspirin", DRUG, [])], "tien_su"), (f"hen/{DISEASE}/{HISTORICAL}|aspirin/{DRUG}/{HISTORICAL}", "history_section", None)),
    (("có hen", [("hen", DISEASE, [HISTORICAL, NEGATED])], None), (f"hen/{DISEASE}/{NEGATED}", "one_of_past_and_negated", None)),
    (("ho và ho", [("ho", SYMPTOM, []), ("ho", SYMPTOM, []), ("ho", SYMPTOM, [])], None), (f"ho/{SYMPTOM}/|ho/{SYMPTOM}/", "excess_duplicates", None)),
    (("Kali thấp, kali cao", [("kali", TEST, []), ("kali", TEST, [])], None), (f"Kali/{TEST}/|kali/{TEST}/", "real_case", None)),
    (("aspirin / clopidogrel", [("aspirin / clopidogrel", DRUG, [])], None), (f"aspirin/{DRUG}/|clopidogrel/{DRUG}/", "split_drugs", None)),
    (("CRP tăng cao 64 mg/L", [("tăng cao 64 mg/L", RESULT, [])], None), (f"64 mg/L/{RESULT}/", "bare_result", None)),
    (("sốt cao 39°C hôm nay", [("sốt", SYMPTOM, [])], None), (f"sốt cao 39°C/{SYMPTOM}/", "whole_fever", None)),
    (("sốt 37.8 và sốt", [("sốt", SYMPTOM, [])], None), (f"sốt 37.8/{SYMPTOM}/", "whole_fever", None)),
    (("sốt 3 ngày", [("sốt", SYMPTOM, [])], None), (f"sốt/{SYMPTOM}/", "", None)),
    (("tiền căn hen", [("hen", DISEASE, [])], None), (f"hen/{DISEASE}/{HISTORICAL}", "marked_history", None)),
    (("trẻ Bại não", [("Bại", DISEASE, []), ("não", DISEASE, [])], None), (f"Bại não/{DISEASE}/", "whole_palsy", None)),
    (("mẹ bị hen", [("hen", DISEASE, [FAMILY])], None), (f"hen/{DISEASE}/{FAMILY}", "", None)),
    (("mẹ khỏe. bị hen", [("hen", DISEASE, [FAMILY])], None), (f"hen/{DISEASE}/", "real_family", None)),
    (("sốt", [("ho", SYMPTOM, [])], None), ("", "spans_in_text", None)),
    (("sốt", [("sốt", SYMPTOM, [])], None), (f"sốt/{SYMPTOM}/", "", None)),
    (("sốt", [("sốt", "KHÁC", [])], None), ("sốt/KHÁC/", "", "unknown_type")),
    (("sốt", [("sốt", SYMPTOM, ["x"])], None), (f"sốt/{SYMPTOM}/x", "", "unknown_assertion")),
    (("sốt", [("", SYMPTOM, [])], None), (f"/{SYMPTOM}/", "", "empty_text")),
]


def _repaired(d: DataFrame) -> DataFrame:
    path = scratch(d.sparkSession, "repaired")
    rp.repaired_records(d).select("key", "entities", "log", "reason").write.parquet(path)  # whole entities: see the operator's note
    r = d.sparkSession.read.parquet(path)
    shown = F.transform("entities", lambda e: F.concat_ws("/", e["text"], e["type"], F.array_join(e["assertions"], ",")))
    return r.select("key", F.array_join(shown, "|").alias("entities"), F.array_join("log", ",").alias("log"), "reason")


case_query(QUERIES, ORACLE, "repaired_records", "part", "p_partkey", "input_text string, entities array<struct<text:string,type:string,assertions:array<string>>>, section string", "entities string, log string, reason string", REPAIRED, _repaired, "rules 1, 2, 6, 7, 10, 11, 12, 13, 15, 23, 24, 25, 31, 35, 36, 38, 39, 40, 41, 43; P14, A27, W4, part of P13")


# -- files ----------------------------------------------------------------


def q(oracle: str):
    def keep(fn):
        QUERIES[fn.__name__], ORACLE[fn.__name__] = fn, oracle
        return fn

    return keep


def read(spark, sf, name):
    return spark.read.parquet(f"{sf}/{name}.parquet")


@q("""SELECT 'A' || p_partkey AS code, 'B' || (p_partkey % 5) AS parent, 'Salmonella arthritis ' || p_partkey AS text, 'Salmonella arthritis (M01.3) ' || p_partkey AS raw, 'M01.3' AS refs, CAST(1 AS BIGINT) AS labels FROM part""")
def class_labels(spark, sf):
    """A classification with mixed content and a label of another language."""
    path = scratch(spark, "classes")
    n = F.col("p_partkey").cast("string")
    x = F.concat(F.lit('<Class code="A'), n, F.lit('" kind="category"><SuperClass code="B'), (F.col("p_partkey") % 5).cast("string"), F.lit('"/><Rubric kind="preferred"><Label xml:lang="en"><Fragment type="list">Salmonella:</Fragment> <Fragment type="list">arthritis<Reference>M01.3</Reference></Fragment> '), n, F.lit('</Label><Label xml:lang="de">x</Label></Rubric></Class>'))
    read(spark, sf, "part").select(x).write.text(path)
    c = sr.read_classes(spark, path)
    first = F.get("labels", F.lit(0))
    return c.select("code", "parent", first["text"].alias("text"), first["raw"].alias("raw"), F.array_join(first["references"], ",").alias("refs"), F.size("labels").cast("long").alias("labels"))


@q("SELECT CAST(least(20, (SELECT count(DISTINCT p_name) FROM part)) AS BIGINT) AS pool, true AS again, (SELECT CAST(sum(least(n, 3)) AS BIGINT) FROM (SELECT count(DISTINCT p_name) AS n FROM part GROUP BY p_brand)) AS per_key, CAST(5 AS BIGINT) AS drawn, true AS wanted_first")
def seeded_samples(spark, sf):
    """Samples by a seeded hash."""
    p = read(spark, sf, "part")
    a = sr.sampled(p.select("p_name"), 20, 7)
    same = a.exceptAll(sr.sampled(p.select("p_name").repartition(3), 20, 7)).count() == 0
    k = sr.sampled(p.select("p_brand", "p_name"), 3, 7, "p_brand").count()
    pool = p.select(F.col("p_partkey").alias("code"), F.when(F.col("p_partkey") < 3, "I").otherwise("J").alias("chapter"))
    d = ge.drawn(pool, ["I"], 5, 7).collect()
    n = pool.where("chapter = 'I'").count()
    return spark.createDataFrame([(a.count(), same, k, len(d), sum(r.chapter == "I" for r in d) == min(n, 5))], "pool long, again boolean, per_key long, drawn long, wanted_first boolean")


@q("SELECT p_partkey AS k, p_name || chr(10) || '\"x\", y' AS text FROM part")
def csv_table(spark, sf):
    """Quoted fields with line ends, quotes and commas."""
    path = scratch(spark, "csv")
    read(spark, sf, "part").select(F.col("p_partkey").alias("k"), F.concat("p_name", F.lit('\n"x", y')).alias("text")).write.csv(path, header=True, escape='"', quoteAll=True)
    return sr.read_table(spark, path, "k long, text string")


@q("SELECT CAST(s_suppkey AS BIGINT) AS k, CAST(CASE s_suppkey % 3 WHEN 0 THEN 1 ELSE 2 END AS INTEGER) AS n_ok, CASE s_suppkey % 3 WHEN 0 THEN '2:not an object|3:not valid' ELSE '' END AS errors FROM supplier")
def numbered_json(spark, sf):
    """Lines of files that are objects, with their numbers, and why others are not."""
    d = read(spark, sf, "supplier")
    bad = F.when(F.col("s_suppkey") % 3 == 0, '{"a": 1}\n[2]\n{"a": \n').otherwise('{"a": 1}\n\n{"a": 2}')
    path = scratch(spark, "lines")
    kinds = sorted(r.text for r in d.select(bad.alias("text")).distinct().collect())  # two
    for i, text in enumerate(kinds):
        spark.createDataFrame([(text,)], "value string").coalesce(1).write.text(f"{path}/{i}")
    out = None
    for i, text in enumerate(kinds):
        n = sr.numbered_lines(spark, f"{path}/{i}", "a int")
        g = n.agg(F.count(F.when(F.col("error").isNull(), 1)).cast("int").alias("n_ok"), F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("error").isNotNull(), F.struct("line_no", "error")))), lambda x: F.concat_ws(":", x["line_no"], x["error"])), "|").alias("errors")).withColumn("text", F.lit(text))
        out = g if out is None else out.unionByName(g)
    return d.select(F.col("s_suppkey").cast("long").alias("k"), bad.alias("text")).join(out, "text").select("k", "n_ok", "errors")


@q("SELECT o_orderkey AS record_id, CASE WHEN o_orderkey % 5 = 0 THEN 'missing_note' WHEN o_orderkey % 3 = 0 THEN 'text_moved' END AS error, o_orderkey % 5 <> 0 AND o_orderkey % 2 = 0 AS locked FROM orders")
def saved_entities(spark, sf):
    """Saved spans held against their notes, artifacts locked to the text they were made from."""
    o = read(spark, sf, "orders").select(F.col("o_orderkey").alias("record_id"), F.col("o_orderpriority").alias("text"))
    notes = o.where("record_id % 5 <> 0")
    saved = o.select("record_id", F.lit(0).alias("start"), F.lit(3).alias("end"), F.when(F.col("record_id") % 3 == 0, "???").otherwise(F.substring("text", 1, 3)).alias("text"))
    art = o.select("record_id", F.sha2(F.when(F.col("record_id") % 2 == 0, F.col("text")).otherwise("old").cast("binary"), 256).alias("raw_sha256"))
    ok = sr.locked(art, notes).select("record_id", F.lit(True).alias("locked"))
    return sr.sound_entities(saved, notes).join(ok, "record_id", "left").select("record_id", "error", F.coalesce("locked", F.lit(False)).alias("locked"))


@q("SELECT p_partkey AS vector_id, p_brand AS tty, CASE WHEN p_brand IN ('Brand#11', 'Brand#12') THEN p_name END AS text FROM part")
def index_metadata(spark, sf):
    """Places checked, types that are not allowed blanked."""
    p = read(spark, sf, "part").select(F.col("p_partkey").alias("vector_id"), F.col("p_partkey").alias("place"), F.col("p_brand").alias("tty"), F.col("p_name").alias("text"))
    return sr.index_metadata(p, ["Brand#11", "Brand#12"])


PARTS = [(("a\n1. Đau\nb\n2. Ho",), ("a|1. Đau\nb|2. Ho", "1,2")), (("x\n1. thường",), ("x\n1. thường", "1")), (("",), ("", ""))]
case_query(QUERIES, ORACLE, "numbered_parts", "part", "p_partkey", "text string", "parts string, numbers string", PARTS, lambda d: d.select("key", F.array_join(sr.numbered_parts(F.col("text")), "|").alias("parts"), F.array_join(sr.natural_order(F.col("text"))["numbers"].cast("array<string>"), ",").alias("numbers")), "S18")


@q("SELECT 'note' || s_suppkey || '.txt' AS name, row_number() OVER (ORDER BY s_suppkey) AS place FROM supplier")
def natural_sort(spark, sf):
    """Natural path sort, numeric-id sort: places from a sorted range partitioning are the driver's order of files."""
    n = read(spark, sf, "supplier").select(F.concat(F.lit("note"), "s_suppkey", F.lit(".txt")).alias("name")).orderBy(sr.natural_order(F.col("name")))
    rows = [(r.name, i + 1) for i, r in enumerate(n.collect())]
    return spark.createDataFrame(rows, "name string, place long")


@q("SELECT s_suppkey AS record_id, CASE WHEN s_suppkey % 4 <> 0 THEN upper(s_name) END AS result, CASE WHEN s_suppkey % 4 = 0 THEN 'ValueError: bad note' END AS error FROM supplier")
def isolated_notes(spark, sf):
    """One bad note does not stop the others; its error is kept."""
    def work(t):
        if t.startswith("bad"):
            raise ValueError("bad note")
        return t.upper()

    d = read(spark, sf, "supplier").select(F.col("s_suppkey").alias("record_id"), F.when(F.col("s_suppkey") % 4 == 0, "bad").otherwise(F.col("s_name")).alias("text"))
    return sr.isolated(d, work)


@q("SELECT count(*) AS results, count(*) FILTER (WHERE s_suppkey % 2 = 1) AS second_run, count(*) FILTER (WHERE s_suppkey % 3 = 0) AS audited, count(*) AS written FROM supplier")
def resumed_work(spark, sf):
    """K8, K10, 2.15 checkpoints and loops: a second run makes only what is missing; a repair is audited, then written beside."""
    d = read(spark, sf, "supplier").select(F.col("s_suppkey").alias("key"), F.col("s_name").alias("text"))
    path, made = scratch(spark, "resumed"), []

    def work(x):
        made.append(x.count())
        return x

    sr.resumed(d.where("key % 2 = 0"), path, work, ["key"])
    n = sr.resumed(d, path, work, ["key"]).count()
    fix = lambda x: x.withColumn("text", F.when(F.col("key") % 3 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text")))
    seen = sr.repaired_lines(d, fix, f"{path}-audit", True).count()
    sr.repaired_lines(d, fix, f"{path}-new", False)
    return spark.createDataFrame([(n, made[1], seen, spark.read.json(f"{path}-new").count())], "results long, second_run long, audited long, written long")


@q("SELECT o_orderkey, sha256('{\"a\":' || o_orderkey || ',\"b\":\"' || o_orderstatus || '\",\"c\":null}') AS fp FROM orders")
def fingerprints(spark, sf):
    """M18, JSON, map: canonical JSON digests."""
    return read(spark, sf, "orders").select("o_orderkey", sr.fingerprint({"b": F.col("o_orderstatus"), "a": F.col("o_orderkey"), "c": F.lit(None).cast("string")}).alias("fp"))


# -- generation -----------------------------------------------------------


@q("WITH n AS (SELECT count(*) AS n FROM orders) SELECT focus, CAST(n // 10 * k AS BIGINT) AS least, true AS within FROM n, (VALUES ('a', 5), ('b', 3), ('c', 2)) v(focus, k)")
def focus_schedule(spark, sf):
    """Every ten slots hold each focus as often as its share says."""
    o = read(spark, sf, "orders")
    n = o.count()
    s = ge.schedule(spark.range(n).withColumnRenamed("id", "slot"), [("a", 5), ("b", 3), ("c", 2)], 11).groupBy("focus").agg(F.count("*").alias("n"))
    k = F.when(F.col("focus") == "a", 5).when(F.col("focus") == "b", 3).otherwise(2)
    return s.select("focus", (F.lit(n // 10) * k).cast("long").alias("least"), F.col("n").between(F.lit(n // 10) * k, F.lit(-(-n // 10)) * k).alias("within"))


@q("SELECT true AS near, CAST(0 AS BIGINT) AS never")
def weighted_choices(spark, sf):
    """L1: a weighted choice by a hash comes near its weights and never takes what has none."""
    o = read(spark, sf, "orders").select(ge.weighted_choice(F.col("o_orderkey"), [("a", 3.0), ("b", 1.0), ("z", 0.0)], 5).alias("c"))
    return o.agg((F.abs(F.avg((F.col("c") == "a").cast("double")) - 0.75) < 0.05).alias("near"), F.count(F.when(F.col("c") == "z", 1)).alias("never"))


@q("SELECT max(1) > 0 AS within, count(*) AS rows, CAST(count(*) FILTER (WHERE length(p_name) > 12) AS BIGINT) AS too_long FROM part")
def prompt_batches(spark, sf):
    """Batches of at most 20, prompts over the limit apart."""
    p = read(spark, sf, "part").select("p_partkey", F.length("p_name").alias("n"))
    b = ge.batched(p, ["p_partkey"], 20).groupBy("batch").count()
    ok, out = ge.within_limit(p, "n", 12)
    return b.agg((F.max("count") <= 20).alias("within"), F.sum("count").alias("rows")).withColumn("too_long", F.lit(out.count()).cast("long"))


ANSWERS = [(("<think>a</think> yes", 10), ("yes", 256)), (("no <think>open", 300), ("no", 512)), (("plain", 5000), ("plain", 768))]
case_query(QUERIES, ORACLE, "final_answers", "part", "p_partkey", "text string, n int", "answer string, budget int", ANSWERS, lambda d: d.select("key", ge.final_answer(F.col("text")).alias("answer"), ge.budget(F.col("n"), [(100, 256), (1000, 512)], 768).alias("budget")), "L2, L8")


@q("SELECT s_suppkey AS key, CASE WHEN s_suppkey % 5 <> 0 THEN 'ok' END AS answer, CAST(CASE WHEN s_suppkey % 5 = 0 THEN 3 WHEN s_suppkey % 2 = 0 THEN 2 ELSE 1 END AS INTEGER) AS attempts, CASE WHEN s_suppkey % 5 = 0 THEN 'down' END AS error FROM supplier")
def completions(spark, sf):
    """L4, 2.16 hooks: retries with backoff around a function that was set by name."""
    def model(p):
        kind = int(p)
        model.seen[p] = model.seen.get(p, 0) + 1
        if kind % 5 == 0 or (kind % 2 == 0 and model.seen[p] == 1):
            raise RuntimeError("down")
        return "ok"

    model.seen = {}
    ge.hook("generate", model)
    d = read(spark, sf, "supplier").select(F.col("s_suppkey").alias("key"), F.col("s_suppkey").cast("string").alias("prompt"))
    return ge.completed(d, ge.hook("generate"))


@q('SELECT s_suppkey AS key, CAST(s_suppkey % 4 AS INTEGER) AS value, CAST(least(s_suppkey % 4, 2) AS INTEGER) AS "round" FROM supplier')
def retry_rounds(spark, sf):
    """L5, L6, 2.15 translation loop: only what failed goes into the next round, three at most."""
    d = read(spark, sf, "supplier").select(F.col("s_suppkey").alias("key"), (F.col("s_suppkey") % 4).cast("int").alias("value"))
    return ge.retried(d, lambda x, k: x.withColumn("ok", F.col("value") <= k), "ok").select("key", "value", "round")


@q("SELECT s_suppkey AS request_id, CASE WHEN s_suppkey % 2 = 0 THEN 'cached' WHEN s_suppkey % 7 <> 0 THEN upper(s_name) END AS answer, (SELECT count(*) FROM supplier WHERE s_suppkey % 2 = 1 AND s_suppkey % 7 <> 0) AS fresh FROM supplier")
def cached_answers(spark, sf):
    """Only requests without a valid cached answer reach the model; unsound answers are not kept."""
    d = read(spark, sf, "supplier").select(F.col("s_suppkey").alias("request_id"), F.when(F.col("s_suppkey") % 7 == 0, "bad").otherwise(F.col("s_name")).alias("prompt"))
    cache = d.select("request_id", F.when(F.col("request_id") % 2 == 0, "cached").alias("answer"))
    all_, fresh = ba.answer(d.unionByName(d).select("request_id", "prompt").distinct(), cache, lambda ps: [None if p == "bad" else p.upper() for p in ps], scratch(spark, "answers"))
    return all_.withColumn("fresh", F.lit(fresh.count()).cast("long"))


@q("SELECT count(*) AS prompts, true AS rows_ok, true AS tokens_ok FROM documents")
def packed_prompts(spark, sf):
    """Batches of like length within rows and padded tokens."""
    d = read(spark, sf, "documents").select("doc_id", F.least(F.length(F.coalesce("text", F.lit(""))), F.lit(1400)).alias("n"))
    b = ba.pack_prompts(d, "doc_id", "n").groupBy("batch").agg(F.count("*").alias("rows"), F.max("n").alias("widest"))
    return b.agg(F.sum("rows").alias("prompts"), (F.max("rows") <= 12).alias("rows_ok"), F.bool_and((F.col("rows") == 1) | (F.col("rows") * F.col("widest") <= 16384)).alias("tokens_ok"))


PLACES = [(("a\\Eb a\\Eb", "\\E"), ("1,6",)), (("x.y.z", "."), ("1,3",)), (("ho ho ho", "ho"), ("0,3,6",)), (("ho", "sốt"), ("",)), (("(a)(a)", "(a)"), ("0,3",))]
case_query(QUERIES, ORACLE, "occurrences", "part", "p_partkey", "text string, needle string", "out string", PLACES, lambda d: d.select("key", F.array_join(F.filter(sp.occurrences(F.col("text"), F.col("needle")), lambda x: F.instr("text", F.col("needle")) > 0).cast("array<string>"), ",").alias("out")), "W3")

# -- answers of a model ---------------------------------------------------

VALUES = [
    (('Here:\n```json\n{"b": [1, 2,], "a": "}"}\n```',), ('{"a":"}","b":[1,2]}',)), (("none",), (None,)), (('{broken {"a": 1} tail',), ('{"a":1}',)), (("[1, [2]] {}",), ("[1,[2]]",)), ((None,), (None,)), (('x {"a": "[{"} y',), ('{"a":"[{"}',)), (('{"a": 1} ```\n[2]\n```',), ("[2]",)),
]
case_query(QUERIES, ORACLE, "first_values", "part", "p_partkey", "text string", "value string", VALUES, lambda d: d.select("key", an.first_value("text").alias("value")), "X28, X29")

DECISIONS = [
    (("p", an.ADD, DRUG, [], "HIGH", an.ADD_REASON), (None,)), (("", an.ADD, DRUG, [], "HIGH", an.ADD_REASON), ("no_proposal_id",)), (("p", None, DRUG, [], "HIGH", an.ADD_REASON), ("no_decision",)), (("p", "IGNORE", "X", [], None, None), ("unknown_type",)),
    (("p", "IGNORE", None, ["x"], None, None), ("unknown_assertion",)), (("p", "IGNORE", None, None, "SURE", None), ("unknown_confidence",)), (("p", an.ADD, DRUG, [], "MEDIUM", an.ADD_REASON), ("add_needs_type_confidence_reason",)), (("p", an.ADD, None, [], "HIGH", an.ADD_REASON), ("add_needs_type_confidence_reason",)),
    (("p", an.ADD, DRUG, [], "HIGH", "AMBIGUOUS"), ("add_needs_type_confidence_reason",)), (("p", an.ADD, TEST, [NEGATED], "HIGH", an.ADD_REASON), ("assertions_on_other_type",)), (("p", "IGNORE", None, None, None, None), (None,)),
]
case_query(QUERIES, ORACLE, "decision_errors", "part", "p_partkey", "proposal_id string, decision string, type string, assertions array<string>, confidence string, reason_code string", "error string", DECISIONS, lambda d: d.select("key", an.decision_error(F.struct(*[c for c in d.columns if c != "key"])).alias("error")), "M42, M23")

_p = lambda i, s, e, text, types=(DRUG,), ok=True, bad=False: (i, s, e, text, list(types), ok, bad)
APPLIED = [
    (([], [_p("a", 0, 2, "ho"), _p("b", 0, 2, "ho")], [("a", an.ADD, DRUG), ("b", an.ADD, DRUG), ("a", an.ADD, DRUG), ("z", an.ADD, DRUG)]), ("a:added|b:duplicate|a:unknown_or_repeated|z:unknown_or_repeated",)),
    (([(0, 6, DRUG)], [_p("a", 3, 6, "sốt"), _p("b", 3, 6, "sốt", (SYMPTOM,))], [("a", an.ADD, DRUG), ("b", an.ADD, SYMPTOM)]), ("a:covered|b:unsafe_overlap",)),
    (([], [_p("a", 3, 6, "sốt", (SYMPTOM,)), _p("b", 0, 2, "ho", ok=False, bad=True), _p("c", 0, 2, "hx")], [("a", an.ADD, DRUG), ("b", an.ADD, DRUG), ("c", an.ADD, DRUG)]), ("a:type_not_allowed|b:insufficient_support+structural_negative|c:not_exact",)),
    (([], [_p("a", 0, 2, "ho"), _p("b", 3, 6, "sốt")], [("a", an.UNRESOLVED, None), ("b", "IGNORE", None)]), ("a:unresolved|b:ignored",)),
    (([], [], []), ("",)),
]


def _applied(d: DataFrame) -> DataFrame:
    out = an.applied_decisions(F.lit("ho sốt"), F.col("e"), F.col("p"), F.col("d"))
    return d.select("key", F.array_join(F.transform(out, lambda x: F.concat_ws(":", x["proposal_id"], x["outcome"])), "|").alias("out"))


case_query(QUERIES, ORACLE, "applied_decisions", "part", "p_partkey", f"e {an.SPAN}, p array<struct<proposal_id:string,start:int,end:int,text:string,types:array<string>,supported:boolean,flagged:boolean>>, d array<struct<proposal_id:string,decision:string,type:string>>", "out string", APPLIED, _applied, "X25")
