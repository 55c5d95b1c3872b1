"""Case queries of selection, drug and disease retrieval, and corpus building."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import drug as dg
from ..functions import text as tx
from ..operators import corpus as co
from ..operators import disease_ranking as ds
from ..operators import retrieval as rt
from ..operators import selection as se
from ..operators.assertions import DISEASE, DRUG
from .cases import case_query

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def cand(code, level="medium", score=0.5, **more):
    d = dict(code=code, name=None, level=level, score=score, dense=None, exact_source=None, exact_key=None, exact_term=None, quality=None, over_specific=None, conflicts=None, coverage=None, similarity=None, mention_words=None, contained=None, abbreviated=None, technical=None, margin=None, part=None, parts=None, surface=None, terms=None, extra=None)
    return tuple((d | more).values())


SELECTION = [
    (("viêm tai giữa", DISEASE, [cand("H65.9", "exact", 0.9, exact_source="metadata_exact_unique"), cand("H65.0", "strong", 0.8)]), (1, "H65.9", "exact_unique_alias", "H65.9;H65.0", False)),
    (("viêm tai giữa", DISEASE, [cand("H65.9", "exact", 0.9, exact_source="metadata_exact_unique", quality=False), cand("H65.0", "strong", 0.8)]), (1, "", "ambiguous_supported_candidates", "H65.9;H65.0", True)),
    (("gan", DISEASE, [cand("K70", "exact", 0.9, exact_source="configured_exact_alias")]), (1, "", "unsafe_single_token_diagnosis_fragment", "", False)),
    (("áp xe", DISEASE, [cand("L02", "exact", 0.9)]), (1, "", "underspecified_diagnosis_abstain", "", False)),
    (("DA", DISEASE, [cand("L20", "strong", 0.8, exact_key=True)]), (1, "L20", "normalized_exact", "L20", False)),
    (("loét dạ dày và viêm gan", DISEASE, [cand("K25", "strong", 0.80), cand("B19", "strong", 0.79)]), (2, "", "ambiguous_supported_candidates", "K25;B19", True)),
    (("loét dạ dày", DISEASE, [cand("K25", "strong", 0.80, mention_words=3, contained=True), cand("K26", "medium", 0.70)]), (1, "K25", "strong_supported_margin", "K25;K26", False)),
    (("loét dạ dày", DISEASE, [cand("K25", "strong", 0.80, mention_words=3, contained=True), cand("K26", "medium", 0.76)]), (1, "", "ambiguous_supported_candidates", "K25;K26", True)),
    (("loét dạ dày", DISEASE, [cand("K25", "strong", 0.80, mention_words=3, contained=True, over_specific=True)]), (1, "", "ambiguous_supported_candidates", "K25", False)),
    (("loét dạ dày", DISEASE, [cand("K25", "medium", 0.66)]), (1, "", "single_medium_abstain", "K25", False)),
    (("loét dạ dày", DISEASE, [cand("K25", "weak", 0.66), cand("Z01", "exact", 0.99, conflicts=["x"]), cand("K27", "rejected", 0.9)]), (1, "", "no_supported_candidate", "", False)),
    (("loét dạ dày", DISEASE, [cand("K25", "weak", 0.5, dense=0.75, name="loét dạ dày tá tràng"), cand("K26", "weak", 0.5, dense=0.75, name="viêm ruột")]), (1, "", "ambiguous_supported_candidates", "K25", False)),
    (("loét dạ dày", DISEASE, [cand("B", "medium", 0.9), cand("A", "strong", 0.2), cand("A", "weak", 0.9, exact_source="metadata_exact_ambiguous")]), (1, "", "ambiguous_supported_candidates", "A;B", True)),
    (("aspirin", DRUG, [cand("1", "exact", 0.9, exact_term=True), cand("2", "strong", 0.8)]), (1, "1", "exact_unique", "1;2", False)),
    (("aspirin", DRUG, [cand("1", "exact", 0.9), cand("2", "exact", 0.8)]), (1, "", "ambiguous_supported_candidates", "1;2", True)),
    (("aspirin", DRUG, [cand("1", "strong", 0.9, margin=0.06), cand("2", "medium", 0.8)]), (1, "1", "strong_margin", "1;2", False)),
    (("aspirin", DRUG, [cand("1", "strong", 0.9, margin=0.05), cand("2", "medium", 0.8)]), (1, "", "ambiguous_supported_candidates", "1;2", True)),
    (("doxycyclinebactrim", DRUG, [cand("7", "strong", 0.7, part=1, parts=2, surface="bactrim"), cand("3", "exact", 0.6, part=0, parts=2, surface="doxycycline")]), (2, "3;7", "part_union", "3;7", False)),
    (("doxycyclinebactrim", DRUG, [cand("7", "medium", 0.7, part=1, parts=2, surface="bactrim"), cand("3", "exact", 0.6, part=0, parts=2, surface="doxycycline")]), (2, "3", "exact_unique", "3;7", False)),
    (("sốt", "TRIỆU_CHỨNG", [cand("R50", "exact", 0.9)]), (1, "", "no_supported_candidate", "", False)),
    (("loét", DISEASE, None), (1, "", "no_supported_candidate", "", False)),
]


def _selection(d: DataFrame) -> DataFrame:
    p = se.prepare(d.withColumn("context", F.lit("trước đó")))
    return p.select("key", "choice_limit", F.array_join("decided", ";").alias("decided"), "reason", F.array_join("valid_codes", ";").alias("valid"), "ask")


case_query(QUERIES, ORACLE, "candidate_selection", "part", "p_partkey", f"text string, type string, candidates {se.CANDIDATES}", "choice_limit int, decided string, reason string, valid string, ask boolean", SELECTION, _selection, "G16, G17, M1, M3, M34, P11, F19, F20, selector order")

ANSWERS = [
    ((DISEASE, 1, [], ["A00", "A00.1", "B00"], True, "r", '```json\n{"request_id": "r", "chosen_codes": ["B00"],}\n```'), ("B00", "model")),
    ((DISEASE, 2, [], ["A00", "A00.1", "B00"], True, "r", '{"request_id": "r", "chosen_codes": ["A00.1", "A00"]}'), ("A00.1", "model")),
    ((DISEASE, 1, [], ["A00", "B00"], True, "r", '{"request_id": "r", "chosen_codes": ["A00", "B00"]}'), ("", "bad_answer")),
    ((DISEASE, 1, [], ["A00", "B00"], True, "r", '{"request_id": "q", "chosen_codes": ["A00"]}'), ("", "bad_answer")),
    ((DISEASE, 1, [], ["A00", "B00"], True, "r", '{"request_id": "r", "chosen_codes": ["Z99"]}'), ("", "model_abstained")),
    ((DISEASE, 1, [], ["A00", "B00"], True, "r", "no object"), ("", "bad_answer")),
    ((DISEASE, 1, [], ["A00", "B00"], True, "r", None), ("", "not_answered")),
    ((DRUG, 2, ["12", "1"], ["12", "1"], False, "r", None), ("12;1", "deterministic")),
    ((DISEASE, 2, ["I10", "I10.1"], ["I10", "I10.1"], False, "r", None), ("I10", "deterministic")),
    ((DRUG, 1, [], [], False, "", None), ("", "abstained")),
]


def _answers(d: DataFrame) -> DataFrame:
    rid = F.when(F.col("request_id") == "", "").otherwise(F.concat("request_id", F.col("key").cast("string")))
    d = d.withColumn("output", F.replace(F.replace("output", F.lit('"r"'), F.concat(F.lit('"'), rid, F.lit('"'))), F.lit("\u0000"), F.lit(""))).withColumn("request_id", rid)
    f = se.finish(d.drop("output"), d.where("output IS NOT NULL").select("request_id", "output"))
    return f.select("key", F.array_join("chosen", ";").alias("chosen"), "status")


case_query(QUERIES, ORACLE, "selection_answers", "supplier", "s_suppkey", "type string, choice_limit int, decided array<string>, valid_codes array<string>, ask boolean, request_id string, output string", "chosen string, status string", ANSWERS, _answers, "M4, M5, X28, hierarchy guard")


# -- corpus ---------------------------------------------------------------

TEXT_FORMS = [
    (("  Viêm   phổi (J18.9)  ", "VIÊM Phổi", "H65.9†"), ("Viêm phổi (J18.9)", "viêm phổi", "H65.9", "Viêm phổi", "viêm phổi", "viem phoi")),
    (("Strasse\tgroß", "Straße", "g30.-*"), ("Strasse groß", "strasse", "g30.-", "Strasse groß", "strasse", "strasse")),
    (("Lao (A15.0) (A16.1†, B20)", "(Đa niệu).", "A15 "), ("Lao (A15.0) (A16.1†, B20)", "(đa niệu).", "A15", "Lao", "đa niệu", "da nieu")),
    (("?Tăng * huyết áp†", "Tăng-huyết áp;", "I10"), ("?Tăng * huyết áp†", "tăng-huyết áp;", "I10", "Tăng huyết áp", "tăng-huyết áp", "tang-huyet ap")),
]


def _text_forms(d: DataFrame) -> DataFrame:
    return d.select("key", tx.clean_text(F.col("a")).alias("clean"), tx.normalized_key(F.col("b")).alias("nkey"), co.clean_code(F.col("c")).alias("code"), tx.without_references(F.col("a")).alias("bare"), ds.alias_key(F.col("b")).alias("akey"), tx.fold_marks(F.lower(ds.alias_key(F.col("b")))).alias("folded"))


case_query(QUERIES, ORACLE, "text_forms", "orders", "o_orderkey", "a string, b string, c string", "clean string, nkey string, code string, bare string, akey string, folded string", TEXT_FORMS, _text_forms, "F1, F2, F3, F7, F10, F11, F12")

CORPUS_FILTERS = [
    (("U14", "Any condition in A00", "inclusion", "conditions classifiable to A00", "x"), (True, True, False, False, "coding_note")),
    (("U49.1", "Bất kỳ bệnh nào liệt kê ở đây", "inclusion", "Use additional code, if desired", "x"), (True, False, True, False, "coding_note")),
    (("U50", "bất kỳ bệnh nào liệt kê ở đây", "alias", "cough due to cold and fever or chills of any kind", "x"), (False, False, False, False, "review")),
    (("A13", "Conditions listed in B95", "inclusion", "conditions classifiable to and , whether specified as rheumatic or not", "x"), (False, True, True, True, "coding_note")),
    (("u13", "Diseases listed below", "inclusion", "one two three four five six seven eight nine ten eleven twelve thirteen fourteen", "x"), (True, False, True, False, "review")),
    (("B20", "Cholera", "inclusion", "cholera NOS", "các bệnh nêu trong A00"), (False, False, False, False, "coding_note")),
    (("B20", "Cholera", "preferred", "lesion specified in .0", "dùng thêm mã"), (False, False, False, True, "coding_note")),
    (("B20", "Cholera", "preferred", "salt and , pepper", "bệnh tả"), (False, False, False, True, "alias")),
]


def _corpus_filters(d: DataFrame) -> DataFrame:
    k = tx.normalized_key(F.col("note"))
    return d.select("key", co.provisional_code(F.col("code")).alias("provisional"), co.coding_note(k).alias("coding"), co.scope_note(k, F.col("kind")).alias("scope"), co.broken_alias(F.col("en")).alias("broken"), co.alias_class(F.col("en"), F.col("vi")).alias("class"))


case_query(QUERIES, ORACLE, "corpus_filters", "part", "p_partkey", "code string, note string, kind string, en string, vi string", "provisional boolean, coding boolean, scope boolean, broken boolean, class string", CORPUS_FILTERS, _corpus_filters, "P2, P3, P4, P5, P6")

ALIASES = [
    (("Abscess of brain (and liver)(and lung)", "Bệnh tả (A00.1†, B20)"), ("Abscess of brain|Abscess of brain and liver|Abscess of brain and lung|Abscess of brain, liver and lung", "Bệnh tả")),
    (("Fever  (and chills)", "Sốt (nhẹ)"), ("Fever|Fever and chills", "Sốt (nhẹ)")),
    (("Fever", "Sốt (A00-B99)"), ("Fever", "Sốt")),
    (("(and chills)", "(A00)"), ("and chills", "")),
]
case_query(QUERIES, ORACLE, "and_group_aliases", "part", "p_partkey", "en string, vi string", "aliases string, official string", ALIASES, lambda d: d.select("key", F.array_join(co.and_group_aliases(F.col("en")), "|").alias("aliases"), co.official_name(F.col("vi")).alias("official")), "F8, F9")

CHECKED = [
    ((["Cholera", "Lupus vulgaris NOS", "Use additional code"], ["bệnh tả", "sai", "x", "thừa"], "llm_openrouter"), ("Cholera|Lupus vulgaris NOS", "bệnh tả|Lupus vulgaris (lao da dạng lupus)", "x", 1, "llm_translated_alias_needs_spotcheck:Cholera|llm_translated_alias_needs_spotcheck:Lupus vulgaris NOS")),
    ((["Scrofuloderma"], ["đúng"], "official"), ("Scrofuloderma", "Lao tầng (scrofuloderma)", "", 1, "")),
    ((["a or b without c of d e f g h", "plain"], ["dài", "gọn"], "official"), ("plain", "gọn", "dài", 0, "long_or_ambiguous:a or b without c of d e f g h")),
    (([], ["x"], "official"), ("", "", "", 0, "")),
]


def _checked(d: DataFrame) -> DataFrame:
    d = d.withColumn("r", co.checked_aliases(F.col("en"), F.col("vi"), F.col("source")))
    return d.select("key", *[F.array_join(f"r.{a}", "|").alias(b) for a, b in (("aliases_en", "kept_en"), ("aliases_vi", "kept_vi"), ("notes", "notes"), ("flags", "flags"))], F.col("r.corrected").alias("corrected"))


case_query(QUERIES, ORACLE, "checked_aliases", "part", "p_partkey", "en array<string>, vi array<string>, source string", "kept_en string, kept_vi string, notes string, corrected int, flags string", CHECKED, _checked, "F21, F22, J23")


def _records(spark, sf):
    """A classification record a part: aliases repeat, equal the preferred name, or are notes, by its size."""
    p = spark.read.parquet(f"{sf}/part.parquet")
    n, k = F.col("p_partkey").cast("string"), F.col("p_size") % 4
    code = F.when(F.col("p_partkey") % 10 == 7, F.concat(F.lit("U14."), n)).otherwise(F.concat(F.lit("A"), n))
    name = F.concat(F.lit("name "), n)
    en = F.when(k == 0, F.array(name, F.lit("first one"), F.lit("First  One"))).when(k == 1, F.array(F.lit("any condition in A00"), F.lit("conditions listed here"), F.lit("second"))).when(k == 2, F.array(F.lit("x (A00.1)"), F.lit(None).cast("string"), F.lit("y"))).otherwise(F.array().cast("array<string>"))
    vi = F.when(k == 0, F.array(F.lit("một"), F.lit("một"), F.lit("hai"), F.lit("ba"))).otherwise(F.array(F.lit("bốn")))
    return p.select(code.alias("code"), name.alias("preferred_en"), F.concat(F.lit("tên "), n).alias("preferred_vi"), en.alias("aliases_en"), vi.alias("aliases_vi"), "p_partkey")


def corpus_terms(spark, sf):
    """The terms of every record."""
    kept, _ = co.terms(_records(spark, sf))
    return kept


def corpus_skipped(spark, sf):
    """Why aliases were left out, counted."""
    _, out = co.terms(_records(spark, sf))
    return out.groupBy("language", "reason").agg(F.count("*").alias("n"))


_REC = """r AS (SELECT p_partkey AS p, 'A' || p_partkey AS code, p_size % 4 AS k FROM part WHERE p_partkey % 10 <> 7)"""
QUERIES["corpus_terms"] = corpus_terms
ORACLE["corpus_terms"] = f"""WITH {_REC}, v(k, id, text, language, term_type) AS (VALUES
(0, 'en|inclusion|0', 'first one', 'en', 'inclusion'), (1, 'en|inclusion|1', 'second', 'en', 'inclusion'), (2, 'en|inclusion|0', 'x', 'en', 'inclusion'), (2, 'en|inclusion|1', 'y', 'en', 'inclusion'),
(0, 'vi|inclusion|0', 'một', 'vi', 'inclusion'), (0, 'vi|inclusion|1', 'hai', 'vi', 'inclusion'), (0, 'vi|alias|0', 'ba', 'vi', 'alias'), (1, 'vi|inclusion|0', 'bốn', 'vi', 'inclusion'), (2, 'vi|inclusion|0', 'bốn', 'vi', 'inclusion'), (3, 'vi|alias|0', 'bốn', 'vi', 'alias'))
SELECT code || '|' || id AS term_id, code, text, language, term_type FROM r JOIN v USING (k)
UNION ALL SELECT code || '|en|preferred|0', code, 'name ' || p, 'en', 'preferred' FROM r UNION ALL SELECT code || '|vi|preferred|0', code, 'tên ' || p, 'vi', 'preferred' FROM r"""
QUERIES["corpus_skipped"] = corpus_skipped
ORACLE["corpus_skipped"] = f"""WITH {_REC}, v(k, language, reason) AS (VALUES (0, 'en', 'equal_to_preferred'), (0, 'en', 'repeated_within_code'), (1, 'en', 'coding_note'), (1, 'en', 'scope_note'), (2, 'en', 'invalid_alias'), (0, 'vi', 'repeated_within_code'))
SELECT language, reason, count(*) AS n FROM r JOIN v USING (k) GROUP BY ALL"""


def collisions(spark, sf):
    """One Vietnamese alias for two English ones."""
    c = co.translation_collisions(_records(spark, sf))
    return c.select("code", "key_vi", F.array_join("texts_en", "|").alias("texts"))


QUERIES["translation_collisions"] = collisions
ORACLE["translation_collisions"] = "SELECT CASE WHEN p_partkey % 10 = 7 THEN 'U14.' ELSE 'A' END || p_partkey AS code, 'một' AS key_vi, 'name ' || p_partkey || '|first one' AS texts FROM part WHERE p_size % 4 = 0"


def official_join(spark, sf):
    """Official names by cleaned code, missing values filled, lists appended, codes unique."""
    p = spark.read.parquet(f"{sf}/part.parquet")
    rec = p.select(F.concat(F.lit("A"), F.col("p_partkey")).alias("code"), F.lit("cũ").alias("preferred_vi"), F.lit(None).cast("string").alias("preferred_vi_raw"), F.lit("old").alias("preferred_vi_source"), F.when(F.col("p_size") % 2 == 0, F.lit("có")).otherwise(F.lit(" ")).alias("note"), F.array(F.lit("a")).alias("more"))
    names = p.where("p_size > 10").select(F.explode(F.array(F.struct(F.concat(F.lit("A"), F.col("p_partkey"), F.lit("†")).alias("code"), F.lit("đánh dấu").alias("name")), F.struct(F.concat(F.lit("A"), F.col("p_partkey")).alias("code"), F.concat(F.lit("Tên "), F.col("p_partkey"), F.lit(" (B20)")).alias("name")))).alias("x")).select("x.*")
    off = co.official_names(names)
    d = co.joined_names(rec, off)
    more = p.where("p_size > 20").select(F.concat(F.lit("A"), F.col("p_partkey")).alias("code"), F.lit("mới").alias("note"), F.array(F.lit("a"), F.lit("b")).alias("more"))
    d = co.filled(d, more, "code", ["note"], ["more"])
    twice = co.repeated(d, ["code"]).count()
    return d.select("code", "preferred_vi", "preferred_vi_raw", "preferred_vi_source", F.trim(F.coalesce("note", F.lit(""))).alias("note"), F.array_join("more", "|").alias("more"), F.lit(twice).cast("long").alias("repeated"))


QUERIES["official_join"] = official_join
ORACLE["official_join"] = """SELECT 'A' || p_partkey AS code, CASE WHEN p_size > 10 THEN 'Tên ' || p_partkey ELSE 'cũ' END AS preferred_vi, CASE WHEN p_size > 10 THEN 'Tên ' || p_partkey || ' (B20)' END AS preferred_vi_raw,
CASE WHEN p_size > 10 THEN 'official' ELSE 'old' END AS preferred_vi_source, CASE WHEN p_size % 2 = 0 THEN 'có' WHEN p_size > 20 THEN 'mới' ELSE '' END AS note, CASE WHEN p_size > 20 THEN 'a|b' ELSE 'a' END AS more, CAST(0 AS BIGINT) AS repeated FROM part"""

DRUG_RECORDS = [
    (({"RXN_STRENGTH": "10 MG"}, "SCD", True, [("amlodipine", None, "10 MG"), ("amlodipine", "amlodipine besylate", "5 MG")], ["Extended Release Oral Tablet"], None), ("10 MG", "RXNSAT", "product", 0, "amlodipine", "10 MG|5 MG", "extended release", "")),
    (({"RXN_BOSS_STRENGTH_NUM_VALUE": "5", "RXN_AVAILABLE_STRENGTH": "5 MG/ML"}, "BPCK", True, [("x", None, "")], [], "Norvasc"), ("5 MG/ML", "RXNSAT_BOSS", "product", 1, "x", "", "", "Norvasc")),
    (({"OTHER": "1"}, "IN", True, [], ["Oral Tablet", "Oral Tablet"], ""), (None, None, "support", 2, "", "", "", "")),
    (({"RXN_STRENGTH": ""}, "SBD", False, [(None, None, None)], [], "B"), (None, None, "historical", 3, "", "", "", "B")),
    (({}, "DF", False, [], [], None), (None, None, "historical", 99, "", "", "", "")),
    (({}, "DF", True, [], [], None), (None, None, "support", 99, "", "", "", "")),
]


def _drug_records(d: DataFrame) -> DataFrame:
    parts = F.transform("parts", lambda p: F.struct(p["a"].alias("ingredient"), p["b"].alias("precise"), p["c"].alias("strength")))
    flat = co.flat_record(parts, F.transform("forms", lambda f: F.struct(f.alias("name"))), F.col("brand"), dg.RELEASES)
    tier = co.index_tier(F.col("tty"), F.col("active"), [*co.PRIMARY, *co.PACKS])
    s = co.strength_struct(F.col("attrs"))
    d = d.select("key", s.alias("s"), tier.alias("tier"), co.candidate_priority(F.col("tty"), tier).alias("priority"), flat.alias("f"))
    return d.select("key", F.col("s.display").alias("display"), F.col("s.source").alias("source"), "tier", "priority", F.array_join("f.ingredients", "|").alias("ingredients"), F.array_join("f.strengths", "|").alias("strengths"), F.array_join("f.release_types", "|").alias("releases"), F.array_join("f.brands", "|").alias("brands"))


case_query(QUERIES, ORACLE, "drug_records", "part", "p_partkey", "attrs map<string,string>, tty string, active boolean, parts array<struct<a:string,b:string,c:string>>, forms array<string>, brand string", "display string, source string, tier string, priority int, ingredients string, strengths string, releases string, brands string", DRUG_RECORDS, _drug_records, "D13, D14, D15, M38")


def attribute_fold(spark, sf):
    """First values, distinct lists, and names by a left join."""
    x = spark.read.parquet(f"{sf}/lineitem.parquet")
    rows = x.select(F.col("l_orderkey").cast("string").alias("rxcui"), F.col("l_returnflag").alias("atn"), F.col("l_linestatus").alias("atv"), F.col("l_linenumber").alias("line"))
    a = co.attributes(rows, ["N", "R"])
    names = spark.read.parquet(f"{sf}/orders.parquet").where("o_orderkey % 3 = 0").select(F.col("o_orderkey").cast("string").alias("rxcui"), F.col("o_orderstatus").alias("tty"), F.col("o_orderpriority").alias("canonical_name"))
    return co.concept_refs(a, names).select("rxcui", "atn", "value", F.array_join("every", "|").alias("every"), F.col("ref.tty").alias("tty"), F.col("ref.name").alias("name"))


QUERIES["attribute_fold"] = attribute_fold
ORACLE["attribute_fold"] = """WITH v AS (SELECT l_orderkey AS k, l_returnflag AS atn, l_linestatus AS atv, min(l_linenumber) AS line FROM lineitem GROUP BY ALL),
g AS (SELECT k, atn, arg_min(atv, (line, atv)) AS value, string_agg(atv, '|' ORDER BY line, atv) AS every FROM v GROUP BY ALL)
SELECT CAST(k AS VARCHAR) AS rxcui, atn, value, CASE WHEN atn IN ('N', 'R') THEN every END AS every, o_orderstatus AS tty, o_orderpriority AS name FROM g LEFT JOIN orders ON o_orderkey = k AND k % 3 = 0"""


def value_counts(spark, sf):
    """Counters of several columns in one pass."""
    return co.counts_by(spark.read.parquet(f"{sf}/orders.parquet").withColumn("both", F.array("o_orderstatus", "o_orderpriority")), "o_orderstatus", "o_orderpriority", "both")


QUERIES["value_counts"] = value_counts
ORACLE["value_counts"] = """SELECT 'o_orderstatus' AS "column", o_orderstatus AS value, count(*) AS n FROM orders GROUP BY 2 UNION ALL SELECT 'o_orderpriority', o_orderpriority, count(*) FROM orders GROUP BY 2
UNION ALL SELECT 'both', o_orderstatus, count(*) FROM orders GROUP BY 2 UNION ALL SELECT 'both', o_orderpriority, count(*) FROM orders GROUP BY 2"""


# -- retrieval ------------------------------------------------------------

VOCABULARY = [  # rxcui, text, tier, tty, priority, current
    ("1", "amlodipine", "support", "IN", 2, []), ("2", "amlodipine 10 MG Oral Tablet", "product", "SCD", 0, []), ("3", "Norvasc", "support", "BN", 2, []), ("4", "valsartan", "support", "IN", 2, []),
    ("5", "amlodipine / valsartan", "support", "MIN", 2, []), ("6", "amlodipine old", "historical", "SCD", 3, ["2", "9"]), ("9", "amlodipine new", "product", "SCD", 0, []), ("10", "doxycycline", "support", "IN", 2, []), ("11", "bactrim", "support", "BN", 2, []),
]
FLAT = [("1", ["amlodipine"], [], [], [], []), ("2", ["amlodipine"], ["10 MG"], ["Oral Tablet"], [], ["Norvasc"]), ("3", [], [], [], [], ["Norvasc"]), ("4", ["valsartan"], [], [], [], []), ("5", ["amlodipine", "valsartan"], [], [], [], [])]
RETRIEVED = [
    (("amlodipine", ["amlodipine"], [], [], []), ("1:exact_term,exact_ingredient;2:exact_ingredient;5:exact_ingredient",)),
    (("norvasc", [], [], [], ["Norvasc"]), ("2:exact_brand;3:exact_term,exact_brand",)),
    (("amlodipine valsartan", ["amlodipine", "valsartan"], [], [], []), ("5:exact_ingredient,exact_structured",)),
    (("x", ["amlodipine", "unknown"], ["10 MG"], ["Oral Tablet"], []), ("1:exact_ingredient;2:exact_ingredient,exact_structured;5:exact_ingredient",)),
    (("amlodipine old", [], [], [], []), ("2:historical_current_mapping;6:exact_term;9:historical_current_mapping",)),
    (("amlodipine old", ["valsartan", "amlodipine"], ["10 mg"], [], []), ("2:exact_structured,historical_current_mapping;5:exact_ingredient,exact_structured;6:exact_term;9:historical_current_mapping",)),
    (("nothing", [], [], [], []), ("",)),
]


def _terms(spark):
    return spark.createDataFrame(VOCABULARY, "rxcui string, text string, tier string, tty string, priority int, current array<string>")


def _retrieved(d: DataFrame) -> DataFrame:
    spark = d.sparkSession
    table = rt.lookups(spark.createDataFrame(FLAT, "rxcui string, ingredients array<string>, strengths array<string>, dose_forms array<string>, release_types array<string>, brands array<string>"))
    m = d.select(F.col("key").alias("mention_id"), rt.query_key(F.col("text")).alias("normalized"), "components", "strengths", "dose_forms", F.array().cast("array<string>").alias("release_types"), "brands")
    c = rt.retrieve_drugs(m, _terms(spark), table).select(F.col("mention_id").alias("key"), F.struct(F.col("rxcui").cast("int").alias("n"), F.concat_ws(":", "rxcui", F.array_join("sources", ",")).alias("s")).alias("x"))
    g = c.groupBy("key").agg(F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["s"]), ";").alias("found"))
    return d.select("key").join(g, "key", "left").select("key", F.coalesce("found", F.lit("")).alias("found"))


case_query(QUERIES, ORACLE, "drug_retrieval", "supplier", "s_suppkey", "text string, components array<string>, strengths array<string>, dose_forms array<string>, brands array<string>", "found string", RETRIEVED, _retrieved, "J7, J8, J9, J10, J11, A13, M8")

FUSED = [
    (("doxycyclinebactrim",), ("doxycycline|bactrim", "concatenated_components_recovered")),
    (("amlodipinevalsartan",), (None, None)),
    (("valsartandoxycycline",), ("valsartan|doxycycline", "concatenated_components_recovered")),
    (("valsartanoral",), ("valsartan", "attached_administration_suffix_removed")),
    (("amlodipine",), (None, None)),
    (("bactrim",), (None, None)),
    (("unknownvalsartan",), (None, None)),
]


def _fused(d: DataFrame) -> DataFrame:
    r = rt.recovered_components(d.select(F.col("key").alias("mention_id"), F.col("component")), rt.component_lexicon(_terms(d.sparkSession)))
    return d.select("key").join(r.select(F.col("mention_id").alias("key"), F.array_join("components", "|").alias("parts"), "note"), "key", "left")


case_query(QUERIES, ORACLE, "fused_components", "supplier", "s_suppkey", "component string", "parts string, note string", FUSED, _fused, "D11, A28")

UNION = [
    (([(0, "a", "1", "strong", 1, 0.04), (0, "a", "2", "strong", 2, 0.0), (1, "b", "3", "exact", 1, None)],), ("0=1;1=3",)),
    (([(0, "a", "1", "strong", 1, 0.03), (0, "a", "2", "strong", 2, 0.0), (1, "b", "3", "exact", 1, None)],), ("",)),
    (([(0, "a", "1", "strong", 1, None), (1, "b", "1", "exact", 1, None)],), ("",)),
    (([(0, "a", "1", "exact", 1, None), (1, "b", "3", "medium", 1, None)],), ("",)),
    (([(0, "a", "5", "weak", 1, None), (0, "a", "1", "strong", 2, None), (1, "b", "3", "strong", 1, None)],), ("0=1;1=3",)),
]


def _union(d: DataFrame) -> DataFrame:
    c = d.select(F.col("key").alias("mention_id"), F.explode("children").alias("c")).select("mention_id", "c.*")
    u = rt.part_union(c).groupBy(F.col("mention_id").alias("key")).agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws("=", "part", "rxcui"))), ";").alias("chosen"))
    return d.select("key").join(u, "key", "left").select("key", F.coalesce("chosen", F.lit("")).alias("chosen"))


case_query(QUERIES, ORACLE, "part_union", "supplier", "s_suppkey", "children array<struct<part:int,surface:string,rxcui:string,level:string,rank:int,margin:double>>", "chosen string", UNION, _union, "G18")

CERTAIN = [
    (([("A", "exact", 1, 0.9), ("B", "strong", 2, 0.8)],), ("A", "A")),
    (([("A", "exact", 1, 0.9), ("B", "exact", 2, 0.8)],), (None, None)),
    (([("A", "strong", 1, 0.90), ("B", "medium", 2, 0.86)],), ("A", None)),
    (([("A", "strong", 1, 0.90), ("B", "medium", 2, 0.88)],), (None, None)),
    (([("A", "strong", 1, 0.90), ("B", "weak", 2, 0.89)],), ("A", "A")),
    (([("A", "medium", 1, 0.90)],), (None, None)),
]


def _certain(d: DataFrame) -> DataFrame:
    c = d.select(F.col("key").alias("mention_id"), F.explode("ranked").alias("c")).select("mention_id", "c.*")
    out = d.select("key")
    for name, least in (("drug", rt.MARGIN_DRUG), ("disease", ds.MARGIN)):
        out = out.join(rt.certain(c, least).toDF("key", name), "key", "left")
    return out


case_query(QUERIES, ORACLE, "certain_codes", "supplier", "s_suppkey", "ranked array<struct<code:string,level:string,rank:int,score:double>>", "drug string, disease string", CERTAIN, _certain, "G15")

DISEASES = [("A|0", "A00", "viêm phổi", "preferred"), ("B|0", "B00", "viêm phổi thùy", "preferred"), ("C|0", "C00", "Bệnh tăng huyết áp", "preferred"), ("C|1", "C00", "cao huyết áp", "alias"), ("D|0", "D00", "cao huyết áp", "alias"), ("E|0", "E00", "tan máu", "preferred")]
FOUND = [
    (("viêm phổi",), ("A00:metadata_exact_unique", "A00=0.995;B00=0.957")),
    (("Cao huyết áp.",), ("C00:metadata_exact_ambiguous;D00:metadata_exact_ambiguous", "C00=0.995;D00=0.995")),
    (("tan huyết",), ("", "E00=0.995")),
    (("bí mật",), ("Z99:configured_exact_alias", "")),
    (("gãy xương",), ("", "")),
]


def _found(d: DataFrame) -> DataFrame:
    t = d.sparkSession.createDataFrame(DISEASES, "term_id string, code string, text string, term_type string")
    m = d.select(F.col("key").alias("mention_id"), "mention")
    a = rt.exact_aliases(m, t, {"bí mật": "Z99"}).groupBy(F.col("mention_id").alias("key")).agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws(":", "code", "source"))), ";").alias("exact"))
    x = rt.lexical_terms(m, t).groupBy(F.col("mention_id").alias("key")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "code", "score"))), lambda r: F.concat_ws("=", r["code"], F.format_string("%.3f", r["score"]))), ";").alias("lexical"))
    return d.select("key").join(a, "key", "left").join(x, "key", "left").select("key", F.coalesce("exact", F.lit("")).alias("exact"), F.coalesce("lexical", F.lit("")).alias("lexical"))


case_query(QUERIES, ORACLE, "disease_retrieval", "supplier", "s_suppkey", "mention string", "exact string, lexical string", FOUND, _found, "J12, J13, G12, A9, A26, lexical top 96")
