"""Case queries of the operators over notes, entities and vocabularies."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import drug as dg
from ..functions import similarity as si
from ..functions import text as tx
from ..operators import assertions as an
from ..operators import disease_ranking as ds
from ..operators import linking as ln
from ..operators import notes as no
from ..operators import output as ou
from ..operators import vocabulary as vo
from ..sources import sinks
from ..sources import tables as src
from .cases import case_query

QUERIES: dict = {}
ORACLE: dict[str, str] = {}
SYM, DIS, DRUG, TEST, RES = an.SYMPTOM, an.DISEASE, an.DRUG, an.TEST, an.RESULT


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the folder that driver and executors share."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir")
        base = tempfile.gettempdir()
    return os.path.join(base, f"nl-{name}-{uuid.uuid4().hex}")


# -- similarity and wording -----------------------------------------------

RATIOS = [
    (("amlodipine", "amlodipin"), (18 / 19, 18 / 19, 18 / 19, 18 / 19)),
    (("aspirin 81", "81 aspirin"), (0.7, 1.0, 0.7, 0.0)),
    (("abc", "xyz"), (0.0, 0.0, 0.0, 0.0)),
    (("vitamin b12", "vitamin b6"), (18 / 21, 18 / 21, 18 / 21, 0.0)),
    (("", ""), (1.0, 0.0, 1.0, 0.0)),
    (("kitten", "sitting"), (8 / 13, 8 / 13, 8 / 13, 0.0)),
]


def _ratios(d: DataFrame) -> DataFrame:
    return d.select("key", F.round(si.ratio("a", "b"), 6).alias("indel"), F.round(si.token_set("a", "b"), 6).alias("token_set"), F.round(si.matcher_ratio("a", "b"), 6).alias("matcher"), F.round(F.get(si.best_guarded(F.array("a"), F.array("b")), F.lit(0)), 6).alias("guarded"))


case_query(QUERIES, ORACLE, "string_ratios", "part", "p_partkey", "a string, b string", "indel double, token_set double, matcher double, guarded double", [(i, tuple(round(x, 6) for x in w)) for i, w in RATIOS], _ratios, "G1, G2, G3, G4")

WORDING = [
    (("Bệnh viêm gan do virus ở trẻ em",), ("viem|gan|virus|o|tre|em", False, "", "", "Bệnh viêm gan do virus ở trẻ em|bệnh viêm gan do virus ở trẻ em|viêm gan do virus ở trẻ em|bệnh viêm gan do virus|benh viem gan do virus o tre em")),
    (("THA",), ("tha", True, "tha", "", "THA|tha")),
    (("tan máu (thiếu G6PD)",), ("tan|mau|thieu|g6pd", False, "g6pd", "", "tan máu (thiếu G6PD)|tan máu (thiếu g6pd|tan huyết (thiếu g6pd|thiếu G6PD|tan máu|tan mau (thieu g6pd")),
    (("lao chưa phân loại",), ("lao", False, "", "", "lao chưa phân loại|lao chua phan loai")),
    (("tăng huyết áp",), ("tang|huyet|ap", False, "", "I", "tăng huyết áp|tang huyet ap")),
]


def _wording(d: DataFrame) -> DataFrame:
    d = ds.query_variants(d, "mention").withColumn("akey", ds.alias_key(F.col("mention")))
    chapter = F.when(ds.chapter_support(F.col("akey"), F.lit("I10")), "I").otherwise("")
    return d.select("key", F.array_join(ds.words(F.col("akey")), "|").alias("words"), ds.abbreviation(F.col("mention")).alias("abbreviation"), F.array_join(ds.acronyms(F.col("mention")), "|").alias("acronyms"), chapter.alias("chapter"), F.array_join("variants", "|").alias("variants"))


case_query(QUERIES, ORACLE, "mention_wording", "part", "p_partkey", "mention string", "words string, abbreviation boolean, acronyms string, chapter string, variants string", WORDING, _wording, "F14, F15, F16, F17, F20")

RANKED = [
    (("tăng huyết áp vô căn", [("I10", "Tăng huyết áp vô căn (nguyên phát)", 0.9), ("I1", "Tăng huyết áp vô căn", 0.8), ("Z03", "khong tang", 0.7)]), ("I1:exact;I10:strong;Z03:rejected", "encounter_or_status_code_without_context,negative_qualifier_not_supported_by_mention")),
    (("viêm phổi", [("J18", "Viêm phổi", 0.5), ("P23", "Viêm phổi bẩm sinh", 0.9)]), ("J18:exact;P23:rejected", "perinatal_code_without_neonatal_context")),
    (("gãy xương đùi", [("S72", "Gãy xương cẳng chân", 0.3), ("W19", "Ngã", 0.2)]), ("S72:weak;W19:rejected", "external_cause_code_without_event_context")),
]


def _ranked(d: DataFrame) -> DataFrame:
    c = d.select(F.col("key").alias("mention_id"), "mention", F.explode("codes").alias("c")).select("mention_id", "mention", "c.*", F.lit("preferred").alias("term_type"), F.lit(1).cast("long").alias("query_variants"), F.lit(None).cast("string").alias("alias_source"))
    r = ds.rank_diseases(c)
    g = r.groupBy(F.col("mention_id").alias("key")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "code", "level"))), lambda x: F.concat_ws(":", x["code"], x["level"])), ";").alias("codes"), F.array_join(F.flatten(F.collect_list("conflicts")), ",").alias("conflicts"))
    return d.select("key").join(g, "key")


case_query(QUERIES, ORACLE, "disease_ranking", "supplier", "s_suppkey", "mention string, codes array<struct<code:string,term:string,aggregate_score:double>>", "codes string, conflicts string", RANKED, _ranked, "G11, G13, P15, F19, top-k codes")

# -- assertions -----------------------------------------------------------

GATE = [
    (("viên", DRUG), ("generic", False)), (("1234", DRUG), ("x", False)), (("500 mg", DRUG), ("x", False)), (("uống ngày 2 lần", DRUG), ("x", False)), (("stent mạch vành", DIS), ("x", False)), (("aspirin", DRUG), (None, True)), (("sốt", SYM), (None, False)), (("viêm gan", DIS), (None, True)),
]
case_query(QUERIES, ORACLE, "linkable_mentions", "part", "p_partkey", "text string, type string", "hard boolean, linkable boolean", [(i, (w[0] is not None, w[1])) for i, w in GATE], lambda d: d.select("key", an.no_entity_reason(F.col("text"), F.col("type")).isNotNull().alias("hard"), an.linkable(F.col("text"), F.col("type")).alias("linkable")), "P7, P8")

EVIDENCE = [
    (("Mẹ của bệnh nhân bị ", "hen", DIS, "unknown", [an.HISTORICAL]), ("absent", True, "isHistorical|isFamily")),
    (("Trước đây từng ", "viêm phổi", DIS, "unknown", []), ("absent", False, "isHistorical")),
    (("Hiện tại ", "sốt", SYM, "unknown", [an.HISTORICAL]), ("absent", False, "")),
    (("Bệnh nhân không ", "sốt", SYM, "unknown", []), ("direct", False, "isNegated")),
    (("Phủ nhận đau đầu, nôn và ", "sốt", SYM, "unknown", []), ("direct", False, "isNegated")),
    (("Không đáp ứng điều trị ", "sốt", SYM, "unknown", [an.NEGATED]), ("blocked", False, "")),
    (("", "sốt", TEST, "unknown", [an.NEGATED]), ("absent", False, "")),
    (("", "hen", DIS, "family_history", []), ("absent", True, "isHistorical|isFamily")),
    (("", "hen", DIS, "historical", []), ("absent", False, "isHistorical")),
    (("không sốt. Có ", "ho", SYM, "current", [an.NEGATED]), ("absent", False, "")),
    (("Ngừng uống ", "aspirin", DRUG, "unknown", []), ("direct", False, "isNegated")),
    (("Bệnh nhân đã ngừng ", "aspirin", DRUG, "unknown", []), ("absent", False, "isHistorical")),
]


def _evidence(d: DataFrame) -> DataFrame:
    start = F.length("before")
    d = d.withColumn("raw", F.concat("before", "text")).withColumn("start", start).withColumn("end", start + F.length("text"))
    d = d.withColumn("negation", an.negation(F.col("raw"), F.col("start"), F.col("end"), F.col("text"), F.col("type"))).withColumn("family", an.about_family(F.col("raw"), F.col("start"), F.col("section")))
    return an.repaired(d).select("key", "negation", "family", F.array_join("assertions", "|").alias("assertions"))


case_query(QUERIES, ORACLE, "assertion_evidence", "part", "p_partkey", "before string, text string, type string, section string, assertions array<string>", "negation string, family boolean, assertions string", EVIDENCE, _evidence, "X13, X14, X15, X16")

# -- notes ----------------------------------------------------------------

MEDICATION = [
    (("Danh sách thuốc trước nhập viện:\n1. aspirin 81 mg po daily điều trị đau\n2. amlodipine 10 mg\n",), ("aspirin 81 mg po daily|amlodipine 10 mg", True)),
    (("Thuốc: aspirin\n1. x\n",), ("", True)),
    (("Không có gì",), ("", True)),
]


def _medication(d: DataFrame) -> DataFrame:
    m = no.medication_list(d, "key", "raw").join(d, "key").withColumn("ok", F.expr("substring(raw, start + 1, end - start) = text"))
    g = m.groupBy("key").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("start", "text"))), lambda x: x["text"]), "|").alias("drugs"), F.bool_and("ok").alias("exact"))
    return d.select("key").join(g, "key", "left").select("key", F.coalesce("drugs", F.lit("")).alias("drugs"), F.coalesce("exact", F.lit(True)).alias("exact"))


case_query(QUERIES, ORACLE, "medication_list", "supplier", "s_suppkey", "raw string", "drugs string, exact boolean", MEDICATION, _medication, "X17")

SCOPES = [
    (("Tiền sử bệnh:\n- hen\nBệnh sử:\n- sốt\n",), ("historical:20|current:15",)),
    (("Tiền sử gia đình:\n- mẹ hen\n",), ("family_history:27",)),
    (("không có đề mục",), ("unknown:15",)),
]


def _scopes(d: DataFrame) -> DataFrame:
    b = no.scope_blocks(d, "key", "raw").groupBy("key").agg(F.array_sort(F.collect_list(F.struct("start", "kind", "end"))).alias("b"))
    return b.select("key", F.array_join(F.transform(F.filter("b", lambda x: x["end"] > x["start"]), lambda x: F.concat_ws(":", x["kind"], (x["end"] - x["start"]).cast("string"))), "|").alias("blocks"))


case_query(QUERIES, ORACLE, "scope_blocks", "supplier", "s_suppkey", "raw string", "blocks string", SCOPES, _scopes, "X2, M40")

# -- drugs ----------------------------------------------------------------

PARSED = [
    (("acetaminophen 325-650 mg po q6h:prn",), ("acetaminophen", "325-650 MG", "range", None, "PO", "6", "")),
    (("glucose 5% 500 ml iv",), ("glucose", "5 PERCENT|50 MG/ML", "percent", "500 ML", "IV", "", "")),
    (("Augmentin (amoxicillin) 1 g tiêm tĩnh mạch",), ("amoxicillin", "1 G", "single", None, "IV", "", "")),
    (("kháng sinh",), ("kháng sinh", "", "missing", None, None, "", "generic_drug_class")),
    (("amoxicillin và paracetamol",), ("amoxicillin / acetaminophen", "", "missing", None, None, "", "multi_ingredient_mention")),
    ((None,), ("", "", "missing", None, None, "", "missing_ingredient")),
]


def _parsed(d: DataFrame) -> DataFrame:
    p = F.col("parsed")
    return dg.parse_mentions(d, "mention").select("key", F.coalesce(p["core"], F.lit("")).alias("core"), F.array_join(p["strengths"], "|").alias("strengths"), p["strength_role"].alias("role"), p["quantity"].alias("quantity"), p["route"].alias("route"), F.coalesce(p["interval_hours"].cast("string"), F.lit("")).alias("hours"), F.array_join(p["warnings"], "|").alias("warnings"))


case_query(QUERIES, ORACLE, "drug_mentions", "part", "p_partkey", "mention string", "core string, strengths string, role string, quantity string, route string, hours string, warnings string", PARSED, _parsed, "D3, D4, D6, D7, D8, D9, D10, P16, M38")

PACKS = [(("{24 (drug A Oral Tablet) / 4 (inert Oral Tablet) } Pack", "drug A"), (24.0,)), (("{24 (drug A Oral Tablet) / 4 (inert Oral Tablet) } Pack", "inert"), (4.0,)), (("{24 (drug A Oral Tablet)} Pack", "none"), (None,)), (("{1.5 (x) } Pack", "x"), (1.5,))]
case_query(QUERIES, ORACLE, "pack_quantities", "part", "p_partkey", "name string, item string", "quantity double", PACKS, lambda d: d.select("key", dg.pack_quantity(F.col("name"), F.col("item")).alias("quantity")), "D12")

LEXICAL = [(("  Amlodipine  10 mg Oral Tablet ",), ("amlodipine 10 MG oral tablet",)), (("Ｎａ 5 meq/ml",), ("na 5 MEQ/ML",)), (("2 UNITS per hr, gml",), ("2 UNITS per HR, gml",))]
case_query(QUERIES, ORACLE, "lexical_names", "part", "p_partkey", "name string", "lexical string", LEXICAL, lambda d: d.select("key", tx.lexical_text(F.col("name")).alias("lexical")), "F5, F6")


def _vocabulary(spark, sf):
    """Pipe-delimited files of a vocabulary made of parts: written, then scanned."""
    p = spark.read.parquet(f"{sf}/part.parquet").select(F.col("p_partkey").cast("string").alias("k"), "p_size")
    path = scratch(spark, "vocabulary")
    line = lambda n, at: F.concat(*[F.concat(at.get(i, F.lit("")), F.lit("|")) for i in range(n)])
    k, lit = F.col("k"), F.lit
    atom = lambda tty, name, sup, pref, aui: {0: k, 1: lit("ENG"), 6: lit(pref), 7: F.concat(lit(aui), k), 11: lit("RXNORM"), 12: lit(tty), 14: name, 16: lit(sup), 17: F.when(F.col("p_size") % 2 == 0, "4096").otherwise("")}
    conso = F.array(line(18, atom("SCD", F.concat(lit("name "), k), "N", "Y", "a")), line(18, atom("SY", F.concat(lit("NAME  "), k), "N", "Y", "b")), line(18, atom("PSN", F.concat(lit("shown "), k), "N", "N", "c")), line(18, {**atom("SCD", F.concat(lit("ü "), k), "N", "Y", "d"), 1: lit("GER")}), line(18, atom("SCD", lit(""), "N", "Y", "e")))
    nxt = (k.cast("int") + 1).cast("string")
    rel = F.array(line(16, {0: nxt, 4: k, 7: lit("has_ingredient"), 10: lit("RXNORM")}), line(16, {0: nxt, 4: k, 7: lit("other"), 10: lit("RXNORM")}), line(16, {0: lit("none"), 4: k, 7: lit("has_ingredient"), 10: lit("RXNORM")}))
    sat = F.array(line(13, {0: k, 8: lit("RXN_STRENGTH"), 9: lit("RXNORM"), 10: F.concat(F.col("p_size"), lit(" MG"))}), line(13, {0: k, 8: lit("RXN_STRENGTH"), 9: lit("RXNORM"), 10: lit("9 MG"), 11: lit("O")}), line(13, {0: k, 8: lit("NOTHING"), 9: lit("RXNORM"), 10: lit("x")}))
    for name, lines in (("RXNCONSO", conso), ("RXNREL", rel), ("RXNSAT", sat)):
        p.select(F.explode(lines)).write.text(f"{path}/{name}")
    return {n: src.read_rrf(spark, f"{path}/{n}", n) for n in ("RXNCONSO", "RXNREL", "RXNSAT")}


def vocabulary_concepts(spark, sf):
    """Scans, canonical names and flags."""
    c = vo.canonical_atoms(src.atoms(_vocabulary(spark, sf)["RXNCONSO"]))
    return c.select("rxcui", "tty", "canonical_name", "active", "prescribable", "prescribable_name")


QUERIES["vocabulary_concepts"] = vocabulary_concepts
ORACLE["vocabulary_concepts"] = "SELECT CAST(p_partkey AS VARCHAR) AS rxcui, 'SCD' AS tty, 'name ' || p_partkey AS canonical_name, true AS active, p_size % 2 = 0 AS prescribable, 'shown ' || p_partkey AS prescribable_name FROM part"


def vocabulary_names(spark, sf):
    """Distinct names in order, with their position."""
    a = src.atoms(_vocabulary(spark, sf)["RXNCONSO"])
    return vo.names(a, vo.canonical_atoms(a)).select("rxcui", "position", "text", "kind")


QUERIES["vocabulary_names"] = vocabulary_names
ORACLE["vocabulary_names"] = "SELECT CAST(p_partkey AS VARCHAR) AS rxcui, CAST(0 AS INTEGER) AS position, 'name ' || p_partkey AS text, 'canonical' AS kind FROM part UNION ALL SELECT CAST(p_partkey AS VARCHAR), 1, 'shown ' || p_partkey, 'prescribable' FROM part"


def vocabulary_components(spark, sf):
    """Edges among known concepts, turned, and what they lead to."""
    v = _vocabulary(spark, sf)
    c = vo.canonical_atoms(src.atoms(v["RXNCONSO"])).select("rxcui", "tty")
    return vo.components(src.relations(v["RXNREL"], c), src.attributes(v["RXNSAT"]), c).select("rxcui", "ingredient", "strength")


QUERIES["vocabulary_components"] = vocabulary_components
ORACLE["vocabulary_components"] = "SELECT CAST(p.p_partkey AS VARCHAR) AS rxcui, CAST(n.p_partkey AS VARCHAR) AS ingredient, p.p_size || ' MG' AS strength FROM part p LEFT JOIN part n ON n.p_partkey = p.p_partkey + 1"


def vocabulary_history(spark, sf):
    """Remaps and archive folded to one row an old id."""
    o = spark.read.parquet(f"{sf}/orders.parquet").select(F.col("o_custkey").cast("string").alias("old"), F.col("o_orderkey").cast("string").alias("k"), "o_orderstatus", F.date_format("o_orderdate", "yyyyMMdd").alias("d"), F.col("o_orderkey").alias("line"))
    remaps = o.where("o_orderstatus = 'O'").select("old", F.when(F.col("line") % 2 == 0, F.col("k")).otherwise("").alias("current"), "line")
    archive = o.where("o_orderstatus <> 'O'").select("old", F.concat(F.lit("n"), "k").alias("text"), F.col("d").alias("created"), F.col("d").alias("updated"), F.lit("ENG").alias("lat"), F.lit("RXNORM").alias("sab"), F.lit("IN").alias("tty"), F.when(F.col("line") % 5 == 0, F.col("k")).otherwise("").alias("merged"), "line")
    return vo.history(remaps, archive).select("old", "status", F.size("current").cast("long").alias("n"), F.array_join("current", "|").alias("current"), "first_seen", "last_seen")


QUERIES["vocabulary_history"] = vocabulary_history
ORACLE["vocabulary_history"] = """WITH x AS (SELECT CAST(o_custkey AS VARCHAR) AS old, o_orderkey AS line, CASE WHEN o_orderstatus = 'O' THEN 0 ELSE 1 END AS src,
CASE WHEN (o_orderstatus = 'O' AND o_orderkey % 2 = 0) OR (o_orderstatus <> 'O' AND o_orderkey % 5 = 0) THEN CAST(o_orderkey AS VARCHAR) END AS c, CASE WHEN o_orderstatus <> 'O' THEN strftime(o_orderdate, '%Y%m%d') END AS d FROM orders)
SELECT old, CASE WHEN count(c) FILTER (WHERE c <> old) > 0 THEN 'remapped' WHEN min(src) = 0 THEN 'retired' ELSE 'archived' END AS status, count(c) FILTER (WHERE c <> old) AS n,
coalesce(string_agg(c, '|' ORDER BY src, line) FILTER (WHERE c <> old), '') AS current, min(d) AS first_seen, max(d) AS last_seen FROM x GROUP BY old"""

# -- sources, sinks and output --------------------------------------------


def note_files(spark, sf):
    """Notes written and read back whole; a report, a split, a log and a manifest of them."""
    d = spark.read.parquet(f"{sf}/supplier.parquet").select(F.col("s_suppkey").alias("k"), F.concat(F.col("s_name"), F.lit("\r\nline two\n")).alias("text"))
    path = scratch(spark, "notes")
    n = sinks.write_json_lines(d, f"{path}/json")
    back = src.read_json_lines(spark, f"{path}/json", "k long, text string").where("corrupt IS NULL").drop("corrupt")
    kept, out = sinks.split_rows(back, F.when(F.col("k") % 3 == 0, "third"), "kept", "rejected", f"{path}/split")
    sinks.append_log(out.select("k"), f"{path}/log")
    sinks.append_log(out.select("k"), f"{path}/log")
    logged = spark.read.json(f"{path}/log").count()
    files = sinks.manifest(spark, f"{path}/json").where("bytes > 0").count()
    r = sinks.report(kept, {"even": F.col("k") % 2 == 0, "with_return": F.contains("text", F.lit("\r\n"))})
    return r.select("rows", "even", "with_return", F.lit(n).cast("long").alias("written"), F.lit(logged).cast("long").alias("logged"), F.lit(files > 0).alias("has_files"), F.lit(out.count()).cast("long").alias("rejected"))


QUERIES["note_files"] = note_files
ORACLE["note_files"] = "SELECT count(*) FILTER (WHERE s_suppkey % 3 <> 0) AS rows, count(*) FILTER (WHERE s_suppkey % 3 <> 0 AND s_suppkey % 2 = 0) AS even, count(*) FILTER (WHERE s_suppkey % 3 <> 0) AS with_return, count(*) AS written, 2 * count(*) FILTER (WHERE s_suppkey % 3 = 0) AS logged, true AS has_files, count(*) FILTER (WHERE s_suppkey % 3 = 0) AS rejected FROM supplier"

LISTS = [
    (([("đau", SYM, [], [an.NEGATED, an.NEGATED, "x"], 5, 8), ("aspirin", DRUG, [" 1", "1", "2", "3"], [], 0, 7)],), ('[{"text":"aspirin","type":"THUỐC","candidates":["1","2"],"assertions":[],"position":[0,7]},{"text":"đau","type":"TRIỆU_CHỨNG","candidates":[],"assertions":["isNegated"],"position":[5,8]}]',)),
    (([("WBC", TEST, ["9"], [an.HISTORICAL], 0, 3)],), ('[{"text":"WBC","type":"TÊN_XÉT_NGHIỆM","candidates":[],"assertions":[],"position":[0,3]}]',)),
]


def _lists(d: DataFrame) -> DataFrame:
    e = d.select(F.col("key").alias("record_id"), F.explode("entities").alias("e")).select("record_id", "e.*")
    return ou.record_json(ou.normalized_entities(e)).select(F.col("record_id").alias("key"), "json")


case_query(QUERIES, ORACLE, "record_json", "part", "p_partkey", "entities array<struct<text:string,type:string,candidates:array<string>,assertions:array<string>,start:int,end:int>>", "json string", LISTS, _lists, "P18, K4, M25, entity sort")

SPANS = [(("đau đầu", 0, 3, "đau"), (True,)), (("đau đầu", 0, 3, "đầu"), (False,)), (("đau", 0, 4, "đau"), (False,)), (("đau", 2, 2, ""), (False,)), (("đau", -1, 2, "đa"), (False,))]
case_query(QUERIES, ORACLE, "exact_spans", "part", "p_partkey", "raw string, start int, end int, text string", "ok boolean", SPANS, lambda d: d.select("key", ou.exact_span(F.col("raw"), F.col("start"), F.col("end"), F.col("text")).alias("ok")), "M35, X6")

VECTORS = [(([3.0, 4.0],), ("0.6|0.8",)), (([0.0, -2.0],), ("0.0|-1.0",)), (([1.0],), ("1.0",))]
case_query(QUERIES, ORACLE, "unit_vectors", "part", "p_partkey", "v array<double>", "unit string", VECTORS, lambda d: d.select("key", F.array_join(F.transform(ln.unit(F.col("v")), lambda x: x.cast("string")), "|").alias("unit")), "G22")
