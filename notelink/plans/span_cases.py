"""Case queries of chunks, words, review and evaluation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import chunks as ch
from ..operators import evaluation as ev
from ..operators import review as rv
from ..operators import words as wo
from ..operators.assertions import DISEASE, DRUG, FAMILY, HISTORICAL, NEGATED, SYMPTOM
from .cases import case_query

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def rows_of(d: DataFrame, array: str, key: str = "record_id") -> DataFrame:
    return d.select(F.col("key").alias(key), F.explode(array).alias("x")).select(key, "x.*")


def listed(df: DataFrame, keys: DataFrame, order: list, text, name: str = "out", key: str = "record_id") -> DataFrame:
    """One string a key: the rows in order, joined by bars; empty for keys without rows."""
    g = df.select(F.col(key).alias("key"), F.struct(*order, text.alias("t")).alias("x")).groupBy("key").agg(F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["t"]), "|").alias(name))
    return keys.select("key").join(g, "key", "left").select("key", F.coalesce(name, F.lit("")).alias(name))


def span_text() -> F.Column:
    return F.concat_ws("-", "start", "end")


CHUNKS = [(([1, 1, 1, 1, 1, 1],), ("0-4|2-6",)), (([3, 3, 9, 1],), ("0-1|1-2|2-3|3-4",)), (([],), ("",)), (([0, 2, 2],), ("0-2|1-3",))]
case_query(QUERIES, ORACLE, "word_chunks", "part", "p_partkey", "sizes array<int>", "out string", CHUNKS, lambda d: d.select("key", F.array_join(F.transform(ch.word_chunks(F.col("sizes"), 6, 2), lambda c: F.concat_ws("-", c["start"], c["end"])), "|").alias("out")), "W14")

MARGINALS = [(([[0.0, 0.0]],), ("0.731059,0.268941",)), (([[0.0, 0.0], [0.0, 0.0]],), ("0.880797,0.119203;0.880797,0.119203",)), (([],), ("",))]


def _marginals(d: DataFrame) -> DataFrame:
    m = ch.chain_marginals(F.col("e"), [[1.0, 0.0], [0.0, 0.0]], [1.0, 0.0], [0.0, 0.0])
    return d.select("key", F.array_join(F.transform(m, lambda r: F.array_join(F.transform(r, lambda x: F.format_string("%.6f", x)), ",")), ";").alias("out"))


# with one move of weight e and a start of weight e the paths weigh e^2, e, 1, 1 over both words
_z = 2.718281828459045**2 + 2.718281828459045 + 2
_p = (2.718281828459045**2 + 2.718281828459045) / _z
_q = (2.718281828459045**2 + 1) / _z
MARGINALS[1] = (MARGINALS[1][0], (f"{_p:.6f},{1 - _p:.6f};{_q:.6f},{1 - _q:.6f}",))
case_query(QUERIES, ORACLE, "chain_marginals", "part", "p_partkey", "e array<array<double>>", "out string", MARGINALS, _marginals, "G21")

WINNERS = [
    (([(0, 0, 0, "B-X", 0.9), (0, 1, 1, "I-X", 0.5), (1, 1, 0, "O", 0.9)],), ("B-X I-X",)),
    (([(0, 0, 1, "B-X", 0.4), (1, 0, 1, "O", 0.9)],), ("O",)),
    (([(0, 0, 1, "O", 0.9), (0, 1, 1, "I-X", 0.5), (1, 1, 1, "B-X", 0.5)],), ("O B-X",)),
    (([(0, 0, 1, "B-X", 0.9), (0, 1, 1, "I-X", 0.5), (1, 1, 1, "B-X", 0.5)],), ("B-X I-X",)),
    (([(0, 3, 1, "I-X", 0.5)],), ("I-X",)),
]


def _winners(d: DataFrame) -> DataFrame:
    w = ch.word_winners(rows_of(d, "p"))
    return listed(w, d, [F.col("word")], F.col("tag")).withColumn("out", F.replace("out", F.lit("|"), F.lit(" ")))


case_query(QUERIES, ORACLE, "word_winners", "part", "p_partkey", "p array<struct<chunk:int,word:int,edge:int,tag:string,confidence:double>>", "out string", WINNERS, _winners, "W15, M14")

SCORES = [(([(0, 2), (3, 4)], [(0, 0.5), (1, 1.0), (3, 0.2)]), ("0.7500|0.2000",)), (([(0, 2)], [(0, 1.0)]), ("0.5000",)), (([], []), ("",))]


def _scores(d: DataFrame) -> DataFrame:
    s = ch.entity_scores(rows_of(d, "e").select("record_id", "first", (F.col("last") - 1).alias("last")), rows_of(d, "w"))
    return listed(s, d, [F.col("first")], F.format_string("%.4f", "score"))


case_query(QUERIES, ORACLE, "entity_scores", "part", "p_partkey", "e array<struct<first:int,last:int>>, w array<struct<word:int,confidence:double>>", "out string", SCORES, _scores, "A16")

VOTES = [
    (([(NEGATED, 0.9, 1.0), (NEGATED, 0.0, 1.0), (FAMILY, 0.6, 1.0), ("NONE", 1.0, 1.0)],), (f"{FAMILY}", f"{FAMILY}")),
    (([(NEGATED, 0.9, 3.0), (NEGATED, 0.1, 1.0), (HISTORICAL, 0.8, 1.0)],), (f"{NEGATED}|{HISTORICAL}", NEGATED)),
    (([(HISTORICAL, 0.65, 1.0)],), ("", "")),
]


def _votes(d: DataFrame) -> DataFrame:
    v = rows_of(d, "v").withColumns({"first": F.lit(0), "last": F.lit(1), "type": F.lit("T")})
    many, one = (ch.mean_assertions(v, {HISTORICAL: 0.7}, single=s).select(F.col("record_id").alias("key"), F.array_join("assertions", "|").alias(n)) for s, n in ((False, "many"), (True, "one")))
    return many.join(one, "key")


case_query(QUERIES, ORACLE, "mean_assertions", "part", "p_partkey", "v array<struct<label:string,probability:double,weight:double>>", "many string, one string", VOTES, _votes, "A15, M13")

RESCUE = [
    (([(0, 5)], [(3, 8, "A", 0.99), (6, 9, "B", 0.90), (8, 12, "C", 0.95), (20, 22, "D", 0.5)]), ("0-5|8-12*", "3-8 0.99|6-9 0.90|8-12 0.95|20-22 0.50")),
    (([], [(0, 4, "A", 0.82), (0, 4, "A", 0.9), (4, 6, "B", 0.83)]), ("0-4*|4-6*", "0-4 0.90|4-6 0.83")),
]


def _rescue(d: DataFrame) -> DataFrame:
    e = rows_of(d, "e").withColumns({"type": F.lit("E"), "score": F.lit(1.0)})
    s = ch.best_spans(rows_of(d, "s"))
    r = listed(ch.rescued(e, s), d, [F.col("start")], F.concat(span_text(), F.when(F.col("rescued"), "*").otherwise("")))
    return r.join(listed(s, d, [F.col("start")], F.concat(span_text(), F.format_string(" %.2f", "score")), "spans"), "key")


case_query(QUERIES, ORACLE, "lattice_rescue", "part", "p_partkey", "e array<struct<start:int,end:int>>, s array<struct<start:int,end:int,type:string,score:double>>", "out string, spans string", RESCUE, _rescue, "W13, A17")

MERGED = [
    (([(0, 0, 4, "A", "0.5", [NEGATED]), (1, 0, 4, "A", "0.9", [FAMILY, NEGATED]), (1, 3, 9, "A", "bad", []), (0, 3, 9, "B", None, [])],), (f"0-4 A 0.9 {NEGATED},{FAMILY} !|3-9 A 0.0  !|3-9 B 0.0  ",)),
    (([(0, 0, 4, "A", "1", []), (0, 4, 6, "A", "1", [])],), ("0-4 A 1.0  |4-6 A 1.0  ",)),
    (([(0, 0, 9, "A", "1", []), (0, 2, 3, "A", "1", []), (0, 5, 6, "A", "1", [])],), ("0-9 A 1.0  !|2-3 A 1.0  !|5-6 A 1.0  !",)),
]


def _merged(d: DataFrame) -> DataFrame:
    m = ch.merged_chunks(rows_of(d, "e").withColumn("score", ch.score_of(F.col("score"))))
    return listed(m, d, [F.col("start"), F.col("end"), F.col("type")], F.concat(span_text(), F.lit(" "), F.col("type"), F.lit(" "), F.col("score").cast("string"), F.lit(" "), F.array_join("assertions", ","), F.lit(" "), F.when(F.col("flag").isNotNull(), "!").otherwise("")))


case_query(QUERIES, ORACLE, "merged_chunks", "part", "p_partkey", "e array<struct<chunk:int,start:int,end:int,type:string,score:string,assertions:array<string>>>", "out string", MERGED, _merged, "X27, A14, M37")

CHECKED = [
    (("Trụ niệu (–", 0, 11, 0.9), ("Trụ niệu", 8, None, None)), (("--", 0, 2, 0.9), ("--", 2, "punct_only", None)), (("ho", 4, 6, 0.95), ("ho", 6, None, "short_span_review")),
    (("sốt cao", 4, 11, 0.79), ("sốt cao", 11, None, "low_emission_confidence")), (("đau (ngực)", 0, 10, 0.8), ("đau (ngực)", 10, None, None)), (("đau", 0, 3, None), ("đau", 3, None, None)),
]
case_query(QUERIES, ORACLE, "checked_entities", "part", "p_partkey", "text string, start int, end int, score double", "text string, end int, reason string, flag string", CHECKED, lambda d: ch.checked_entities(d), "P9")

SEGMENTED = [
    (("Đau ngực.Hồi hộp",), ("Đau:0-3 ngực:4-8 .:8-9 Hồi:9-12 hộp:13-16",)), (("WBC:15.2;CRP:64mg/L",), ("WBC:0-3 ::3-4 15.2:4-8 ;:8-9 CRP:9-12 ::12-13 64mg/L:13-19",)), (("sốt 37.8\n5.2 ổn",), ("sốt:0-3 37.8:4-8 5.2:9-12 ổn:13-15",)), (("",), ("",)), (("a,b 1,5",), ("a:0-1 ,:1-2 b:2-3 1,5:4-7",)),
]
show = lambda w: F.array_join(F.transform(w, lambda x: F.concat(x["text"], F.lit(":"), x["start"].cast("string"), F.lit("-"), x["end"].cast("string"))), " ")
case_query(QUERIES, ORACLE, "segmented_words", "part", "p_partkey", "text string", "out string", SEGMENTED, lambda d: d.select("key", show(wo.segmented(F.col("text"))).alias("out")), "X3, X4, X5")

TONES = [(("Hòa bệnh ỐM",), ("hoa bênh ôm",)), (("đường",), ("đương",)), (("abc",), ("abc",))]
case_query(QUERIES, ORACLE, "toneless_text", "part", "p_partkey", "text string", "out string", TONES, lambda d: d.select("key", wo.toneless("text").alias("out")), "F13")

RANGES = [((0, 5), ("0-1", True)), ((2, 9), ("0-3", True)), ((3, 4), ("none", True)), ((7, 20), ("2-4", False))]


def _ranges(d: DataFrame) -> DataFrame:
    w = F.from_json(F.lit('[{"start":0,"end":3},{"start":4,"end":6},{"start":7,"end":9},{"start":10,"end":9}]'), "array<struct<start:int,end:int>>")
    r = d.withColumn("r", F.when((F.col("s") == 0), F.struct(F.lit(0).alias("first"), F.lit(1).alias("last"))).otherwise(wo.word_range(w, F.col("s"), F.col("e"))))
    return r.select("key", F.coalesce(F.concat_ws("-", F.when(F.col("r.first").isNotNull(), F.concat_ws("-", "r.first", "r.last"))), F.lit("")).alias("range"), wo.sound_range(w, F.coalesce("r.first", F.lit(0)), F.coalesce("r.last", F.lit(1))).alias("sound")).withColumn("range", F.when(F.col("range") == "", "none").otherwise(F.col("range")))


RANGES[3] = ((7, 20), ("2-4", False))
case_query(QUERIES, ORACLE, "word_ranges", "part", "p_partkey", "s int, e int", "range string, sound boolean", RANGES, _ranges, "M43, X6")

FREE = [(("buồn nôn, nôn", ["buồn nôn", "nôn", "nôn"]), ("0-8|10-13|none",)), (("nôn", ["x", "", "nôn"]), ("none|none|0-3",)), (("a a", ["a", "a"]), ("0-1|2-3",))]
case_query(QUERIES, ORACLE, "free_spans", "part", "p_partkey", "text string, names array<string>", "out string", FREE, lambda d: d.select("key", F.array_join(F.transform(wo.free_spans("text", "names"), lambda s: F.when(s.isNull(), "none").otherwise(F.concat_ws("-", s["start"], s["end"]))), "|").alias("out")), "X7, W3")

ERRORS = [
    (([("sốt", "S")], [(0, 3, "sốt", "S")]), ("",)), (([("sốt", "S")], None), ("length",)), (([("sốt", "S")], [None]), ("no_span",)), (([("sốt", "S")], [(0, None, None, None)]), ("no_offsets",)), (([("sốt", "S")], [(0, 99, None, None)]), ("out_of_range",)),
    (([("cao", "S"), ("sốt", "S")], [(4, 7, None, None), (0, 3, None, None)]), ("out_of_order",)), (([("cao", "S")], [(0, 3, None, None)]), ("other_text",)), (([("sốt", "S")], [(0, 3, "x", None)]), ("span_text_differs",)), (([("sốt", "S")], [(0, 3, None, "T")]), ("span_type_differs",)),
]
case_query(QUERIES, ORACLE, "span_errors", "part", "p_partkey", "e array<struct<text:string,type:string>>, s array<struct<start:int,end:int,text:string,type:string>>", "out string", ERRORS, lambda d: d.select("key", F.array_join(wo.span_errors(F.lit("sốt cao"), F.col("e"), F.col("s")), "|").alias("out")), "X8")

MATCHED = [(([(0, 5, "A"), (0, 9, "A")], [(0, 4, "A"), (5, 9, "A"), (0, 9, "B")]), ("0|1",)), (([(0, 9, "A"), (0, 2, "A")], [(0, 4, "A"), (5, 9, "B")]), ("0|none",)), (([(0, 8, "A")], [(0, 4, "A"), (4, 8, "A")]), ("0",))]
case_query(QUERIES, ORACLE, "matched_runs", "part", "p_partkey", "e array<struct<start:int,end:int,type:string>>, r array<struct<start:int,end:int,type:string>>", "out string", MATCHED, lambda d: d.select("key", F.array_join(F.transform(wo.matched_runs("e", "r"), lambda i: F.coalesce(i.cast("string"), F.lit("none"))), "|").alias("out")), "J22, X10")

# -- review ---------------------------------------------------------------

BORDERS = [
    (("bị khó thở", 3, 9), ("khó thở", 3, 10)), (("tăng huyết áp", 1, 13), ("tăng huyết áp", 0, 13)), (("có sốt bn", 3, 9), ("sốt", 3, 6)), (("bn vàng da", 0, 10), ("vàng da", 3, 10)), (("Thiếu men G6PD (", 0, 16), ("Thiếu men G6PD", 0, 14)),
    (("chụp chụp ct sọ não", 0, 19), ("chụp ct sọ não", 5, 19)), (("ổn địnhkhi", 0, 7), ("ổn định", 0, 7)), (("ho\nsốt", 0, 6), ("ho", 0, 2)), (("đau ngực", 0, 8), ("đau ngực", 0, 8)),
]
case_query(QUERIES, ORACLE, "repaired_borders", "part", "p_partkey", "raw string, start int, end int", "text string, s int, e int", BORDERS, lambda d: d.withColumn("r", rv.repaired_border("raw", "start", "end")).select("key", F.col("r.text").alias("text"), F.col("r.start").alias("s"), F.col("r.end").alias("e")), "X12")

ONE = [(([(0, 4, "A", 0.9, [NEGATED]), (0, 4, "A", 0.9, [FAMILY, HISTORICAL]), (0, 4, "A", 0.5, ["z"])],), (f"0-4 {FAMILY},{HISTORICAL}", f"0-4 {FAMILY},{HISTORICAL},{NEGATED},z")), (([(0, 4, "A", 0.9, []), (0, 4, "B", 0.1, ["b"])],), ("0-4 |0-4 b", "0-4 |0-4 b"))]


def _one(d: DataFrame) -> DataFrame:
    e = rows_of(d, "e")
    a, b = (listed(rv.one_per_span(e, u), d, [F.col("start"), F.col("type")], F.concat(span_text(), F.lit(" "), F.array_join("assertions", ",")), n) for u, n in ((False, "best"), (True, "both")))
    return a.join(b, "key")


case_query(QUERIES, ORACLE, "one_per_span", "part", "p_partkey", "e array<struct<start:int,end:int,type:string,score:double,assertions:array<string>>>", "best string, both string", ONE, _one, "A14")

WITHIN = [(([(0, 9, "A"), (2, 5, "A"), (2, 5, "B"), (0, 9, "A")],), ("2-5 A", "2-5 A|2-5 B", "0-9 A|0-9 A|2-5 B")), (([(0, 3, "A"), (0, 5, "A"), (4, 5, "A"), (5, 6, "A")],), ("0-3 A|4-5 A", "0-3 A|4-5 A", "0-5 A|5-6 A"))]


def _within(d: DataFrame) -> DataFrame:
    e = rows_of(d, "e")
    out = d.select("key")
    for n, df in (("same", rv.contained(e)), ("any", rv.contained(e, False)), ("rest", rv.without_nested(e, "A"))):
        out = out.join(listed(df, d, [F.col("start"), F.col("end"), F.col("type")], F.concat(span_text(), F.lit(" "), F.col("type")), n), "key")
    return out


case_query(QUERIES, ORACLE, "contained_spans", "part", "p_partkey", "e array<struct<start:int,end:int,type:string>>", "same string, any string, rest string", WITHIN, _within, "J17, M27")

OVER = [(([(0, 5, "A"), (5, 9, "A"), (20, 30, "B")], [(3, 5, "D"), (28, 40, "D")]), ("3-5 D|5-9 A|28-40 D",)), (([(0, 50, "A")], [(10, 12, "D")]), ("10-12 D",)), (([(0, 5, "A")], []), ("0-5 A",))]


def _over(d: DataFrame) -> DataFrame:
    return listed(rv.overridden(rows_of(d, "e"), rows_of(d, "f")), d, [F.col("start")], F.concat(span_text(), F.lit(" "), F.col("type")))


case_query(QUERIES, ORACLE, "overridden_spans", "part", "p_partkey", "e array<struct<start:int,end:int,type:string>>, f array<struct<start:int,end:int,type:string>>", "out string", OVER, _over, "X18, J18")

_long = "x " * 115
REGIONS = [
    (("sốt sốt cao", [(8, 11, "cao", "S", 0.9, None)]), ("0-7 repeated_token_boundary", "0-11 repeated_token_boundary 3.0")),
    (("ho ho. Rồi ho", [(0, 2, "ho", "S", 0.5, None)]), ("0-2 low_confidence|0-5 repeated_token_boundary", "0-13 low_confidence,repeated_token_boundary 3.0")),
    (("đau đầu và đau đầu", [(0, 7, "đau đầu", "S", 0.9, "short")]), ("0-7 short|11-18 repeated_surface_missing_occurrence", "0-18 repeated_surface_missing_occurrence,short 2.8")),
    (("- mục\nsốt", [(6, 9, "sốt", "S", 0.9, None)]), ("0-6 suspicious_empty_region", "0-9 suspicious_empty_region 2.5")),
    (("a b", [(0, 1, "a", "S", 0.9, None), (2, 3, "b", "S", 0.9, None)]), ("0-3 adjacent_entity_boundary", "0-3 adjacent_entity_boundary 2.6")),
    (("y" + _long[1:], []), ("0-230 long_medical_gap|2-229 repeated_token_boundary", "0-230 long_medical_gap,repeated_token_boundary 3.0")),
]
REGIONS[5] = ((" ".join(f"w{i}" for i in range(80)), []), ("0-309 long_medical_gap", "0-309 long_medical_gap 2.2"))


def _regions(d: DataFrame) -> DataFrame:
    notes = d.select(F.col("key").alias("record_id"), "raw")
    hits = rv.suspicions(notes, rows_of(d, "e"))
    a = listed(hits, d, [F.col("start"), F.col("end")], F.concat(span_text(), F.lit(" "), F.col("reason")), "hits")
    w = rv.review_windows(notes, hits)
    return a.join(listed(w, d, [F.col("region")], F.concat(F.concat_ws("-", "left", "right"), F.lit(" "), F.array_join("reasons", ","), F.format_string(" %.1f", "priority")), "windows"), "key")


case_query(QUERIES, ORACLE, "review_regions", "supplier", "s_suppkey", "raw string, e array<struct<start:int,end:int,text:string,type:string,score:double,flag:string>>", "hits string, windows string", REGIONS, _regions, "X19, W7, W9")

CATALOG = [
    (([("crf", 0, 4, "sốt ", "S", 0.5, None), ("span", 0, 4, "sốt ", "S", 0.96, "f"), ("crf", 2, 6, "t ca", "S", 0.5, None), ("crf", 2, 6, "t ca", "D", 0.5, None), ("crf", 12, 15, "abc", "D", 0.5, None)],), ("0-4 S crf,span 0.96 f boundary_disagreement,type_disagreement 2|2-6 D crf 0.50  possible_merge,type_disagreement 3|2-6 S crf 0.50  boundary_disagreement,type_disagreement 2|12-15 D crf 0.50  possible_merge 1",)),
    (([("crf", 0, 4, "a", "S", 0.5, None), ("crf", 13, 15, "b", "S", 0.5, None)],), ("0-4 S crf 0.50   0|13-15 S crf 0.50   0",)),
]


def _catalog(d: DataFrame) -> DataFrame:
    c = rv.catalog(rows_of(d, "e"))
    t = F.concat_ws(" ", span_text(), "type", F.array_join("sources", ","), F.format_string("%.2f", F.array_max(F.map_values("scores"))), F.array_join("flags", ","), F.array_join("relations", ","), F.size("related").cast("string"))
    return listed(c, d, [F.col("start"), F.col("end"), F.col("type")], t)


case_query(QUERIES, ORACLE, "candidate_catalog", "part", "p_partkey", "e array<struct<source:string,start:int,end:int,text:string,type:string,score:double,flag:string>>", "out string", CATALOG, _catalog, "X21, J20, M41")

PROPOSED = [
    (("HA cao; HAX; n n; HA", [(0, 2, "HA", "S", 0.99)]), ("18-20 HA",)), (("bệnh gout, gout", [(0, 9, "bệnh gout", "D", 0.95)]), ("5-9 gout|11-15 gout",)), (("ho, ho", [(0, 2, "ho", "S", 0.99)]), ("",)), (("sốt rét, sốt rét", [(0, 7, "sốt rét", "S", 0.94)]), ("",)),
]


def _proposed(d: DataFrame) -> DataFrame:
    c = rows_of(d, "e").withColumn("scores", F.create_map(F.lit("crf"), F.col("score")))
    return listed(rv.proposals(d.select(F.col("key").alias("record_id"), "raw"), c), d, [F.col("start")], F.concat(span_text(), F.lit(" "), F.col("text")))


case_query(QUERIES, ORACLE, "missing_proposals", "part", "p_partkey", "raw string, e array<struct<start:int,end:int,text:string,type:string,score:double>>", "out string", PROPOSED, _proposed, "X23, F24, proposals by length")

GROUPS = [(([(0, 5), (10, 20), (150, 160), (170, 180)],), ("0|0|1|1",)), (([(0, 100), (150, 300), (310, 400)],), ("0|0|1",)), (([(k * 10, k * 10 + 5) for k in range(8)],), ("0|0|0|0|0|0|1|1",)), (([],), ("",))]
case_query(QUERIES, ORACLE, "grouped_spans", "part", "p_partkey", "s array<struct<start:int,end:int>>", "out string", GROUPS, lambda d: d.select("key", F.array_join(F.transform(rv.grouped_spans(F.col("s")), lambda i: i.cast("string")), "|").alias("out")), "W17, W18")

ACTIONS = [(([(50, ["a"]), (100, ["b", "a"]), (50, ["c"])],), ("1|2",)), (([(1, ["a"]), (1, ["a"])],), ("0",)), (([],), ("",))]
case_query(QUERIES, ORACLE, "packed_actions", "part", "p_partkey", "a array<struct<priority:int,ids:array<string>>>", "out string", ACTIONS, lambda d: d.select("key", F.array_join(F.transform(rv.packed_actions(F.col("a")), lambda i: i.cast("string")), "|").alias("out")), "W12")

LOGS = [(([(0, 5, "A"), (3, 8, "A"), (4, 6, "B"), (20, 22, "A")], [(0, 5, "A"), (20, 22, "A")]), ("3-8 same_type_overlap|4-6 cross_type_overlap",)), (([(0, 5, "A")], [(0, 5, "A")]), ("",))]
case_query(QUERIES, ORACLE, "merge_logs", "part", "p_partkey", "b array<struct<start:int,end:int,type:string>>, k array<struct<start:int,end:int,type:string>>", "out string", LOGS, lambda d: listed(rv.merge_log(rows_of(d, "b"), rows_of(d, "k")), d, [F.col("start")], F.concat(span_text(), F.lit(" "), F.col("reason"))), "M32")


# -- evaluation -----------------------------------------------------------


def entity_metrics(spark, sf):
    """Predicted spans made of orders, off by some keys."""
    o = spark.read.parquet(f"{sf}/orders.parquet").select(F.col("o_custkey").alias("record_id"), (F.col("o_orderkey") * 10).alias("start"), (F.col("o_orderkey") * 10 + 8).alias("end"), F.col("o_orderstatus").alias("type"), F.array("o_orderpriority").alias("assertions"), F.col("o_orderkey").alias("k"))
    p = o.where("k % 7 <> 0").withColumn("end", F.when(F.col("k") % 5 == 0, F.col("end") - 1).otherwise(F.col("end"))).withColumn("type", F.when(F.col("k") % 11 == 0, "Z").otherwise(F.col("type"))).withColumn("assertions", F.when(F.col("k") % 3 == 0, F.array(F.lit("x"))).otherwise(F.col("assertions")))
    r = ev.entity_report(o.drop("k"), p.drop("k"))
    return r.select(*[F.round(c, 9).alias(c) for c in ("precision", "recall", "f1", "type_accuracy", "assertion_f1")], "boundary_errors")


QUERIES["entity_metrics"] = entity_metrics
ORACLE["entity_metrics"] = """WITH s AS (SELECT count(*) AS g, count(*) FILTER (WHERE o_orderkey % 7 <> 0) AS p, count(*) FILTER (WHERE o_orderkey % 7 <> 0 AND o_orderkey % 5 <> 0) AS same,
count(*) FILTER (WHERE o_orderkey % 7 <> 0 AND o_orderkey % 5 <> 0 AND o_orderkey % 11 <> 0) AS tp, count(*) FILTER (WHERE o_orderkey % 7 <> 0 AND o_orderkey % 5 <> 0 AND o_orderkey % 3 <> 0) AS atp FROM orders)
SELECT round(tp / p, 9) AS precision, round(tp / g, 9) AS recall, round(2.0 * tp / (p + g), 9) AS f1, round(tp / same, 9) AS type_accuracy, round(2.0 * atp / (same + same), 9) AS assertion_f1, p - same AS boundary_errors FROM s"""


def linking_metrics(spark, sf):
    """Top codes of each customer's orders against its first ones."""
    o = spark.read.parquet(f"{sf}/orders.parquet").select(F.col("o_custkey").alias("mention_id"), F.col("o_orderpriority").alias("code"), F.col("o_totalprice").alias("score"), F.col("o_orderstatus").alias("s"))
    pred = ev.top_codes(o.where("s <> 'P'"), 3)
    gold = o.where("s = 'F'").groupBy("mention_id").agg(F.collect_set("code").alias("gold"))
    none = F.array().cast("array<string>")
    d = o.select("mention_id").distinct().join(pred, "mention_id", "left").join(gold, "mention_id", "left").select(F.coalesce("gold", none).alias("gold"), F.coalesce("pred", none).alias("pred"))
    r = ev.linking_report(d, 2)
    return r.select(*[F.round(c, 9).alias(c) for c in r.columns])


QUERIES["linking_metrics"] = linking_metrics
ORACLE["linking_metrics"] = """WITH b AS (SELECT o_custkey AS m, o_orderpriority AS code, max(o_totalprice) AS s FROM orders WHERE o_orderstatus <> 'P' GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY m ORDER BY s DESC, code) AS k FROM b),
p AS (SELECT m, list(code ORDER BY k) AS pred FROM r WHERE k <= 3 GROUP BY m), g AS (SELECT o_custkey AS m, list(DISTINCT o_orderpriority) AS gold FROM orders WHERE o_orderstatus = 'F' GROUP BY 1),
d AS (SELECT coalesce(gold, []) AS g, coalesce(pred, []) AS p FROM (SELECT DISTINCT o_custkey AS m FROM orders) LEFT JOIN p USING (m) LEFT JOIN g USING (m)),
x AS (SELECT len(g) AS ng, len(p) AS np, len(list_intersect(g, p)) AS b, len(g) > 0 AND len(list_intersect(g, p[1:2])) > 0 AS hit, len(g) > 0 AND list_contains(g, p[1]) AS top, list_sort(g) = list_sort(p) AS same FROM d)
SELECT round(count(*) FILTER (WHERE hit) / count(*) FILTER (WHERE ng > 0), 9) AS recall_at_k, round(sum(b) / sum(ng + np - b), 9) AS jaccard, round(sum(np - b) / sum(np), 9) AS false_code_rate, round(count(*) FILTER (WHERE np = 0) / count(*), 9) AS abstention_rate,
round(count(*) FILTER (WHERE top) / count(*) FILTER (WHERE ng > 0), 9) AS top1, round(count(*) FILTER (WHERE same) / count(*), 9) AS exact_set, round(sum(b) / sum(ng), 9) AS code_recall FROM x"""

CLASSES = [((["a"], ["a"]), ("correct",)), ((["a", "b"], ["a"]), ("missing",)), ((["a"], ["a", "b"]), ("extra",)), ((["a"], ["b"]), ("missing_and_extra",)), (([], []), ("correct",))]
case_query(QUERIES, ORACLE, "error_classes", "part", "p_partkey", "gold array<string>, pred array<string>", "out string", CLASSES, lambda d: d.select("key", ev.error_class(F.col("gold"), F.col("pred")).alias("out")), "M22")
