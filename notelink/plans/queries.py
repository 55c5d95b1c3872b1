"""Operators applied to the driver's tables, each with its oracle where SQL expresses it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import drug as dg
from ..functions import text as tx
from ..operators import assertions as an
from ..operators import drug_ranking as dr
from ..operators import linking as ln
from ..operators import notes as no
from ..operators import output as ou
from ..operators import spans as sp
from ..operators import vocabulary as vo
from ..streaming import cache as ca

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(oracle: str | None = None):
    def keep(fn):
        QUERIES[fn.__name__] = fn
        if oracle:
            ORACLE[fn.__name__] = oracle
        return fn

    return keep


def t(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


@query("SELECT doc_id, trim(regexp_replace(nfc_normalize(text), '[\\s]+', ' ', 'g')) AS clean, length(text) AS raw_length FROM documents")
def whitespace_clean(spark, sf):
    return t(spark, sf, "documents").select("doc_id", tx.clean_text(F.col("text")).alias("clean"), F.length("text").alias("raw_length").cast("long"))


@query("""WITH x AS (SELECT item_id, unnest(list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+'))) AS token FROM benchmark)
SELECT token, count(*) AS postings, min(item_id) AS first_item FROM x GROUP BY token""")
def token_postings(spark, sf):
    x = t(spark, sf, "benchmark").select("item_id", F.explode(F.array_distinct(tx.tokens(F.col("text")))).alias("token"))
    return x.groupBy("token").agg(F.count("*").alias("postings"), F.min("item_id").alias("first_item"))


@query("SELECT text, min(doc_id) AS doc_id, count(*) AS copies FROM documents GROUP BY text")
def ordered_dedup(spark, sf):
    return ln.first_copies(t(spark, sf, "documents"), ["text"], "doc_id")


@query("""WITH u AS (SELECT p_size AS key, p_name AS name, 0 AS tier, p_partkey AS seq FROM part UNION ALL SELECT s_nationkey, s_name, 1, s_suppkey FROM supplier)
SELECT key, name, tier, seq FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY tier, seq) AS r FROM u) WHERE r = 1""")
def tier_priority_union(spark, sf):
    a = t(spark, sf, "part").select(F.col("p_size").alias("key"), F.col("p_name").alias("name"), F.col("p_partkey").alias("seq"))
    b = t(spark, sf, "supplier").select(F.col("s_nationkey").alias("key"), F.col("s_name").alias("name"), F.col("s_suppkey").alias("seq"))
    return vo.by_priority([a, b], ["key"], "seq").select("key", "name", "tier", "seq")


@query("""SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderstatus <> 'O', o_orderpriority, o_totalprice DESC, o_orderkey) AS r FROM orders) WHERE r = 1""")
def canonical_pick(spark, sf):
    o = t(spark, sf, "orders")
    return vo.pick(o, ["o_custkey"], [F.col("o_orderstatus") != "O", F.col("o_orderpriority"), -F.col("o_totalprice"), F.col("o_orderkey")], ["o_orderkey", "o_totalprice"])


@query("SELECT n_regionkey, array_to_string(list_sort(list(DISTINCT n_name)), ',') AS children FROM nation GROUP BY n_regionkey")
def children_map(spark, sf):
    return vo.children(t(spark, sf, "nation"), "n_regionkey", "n_name").withColumn("children", F.array_join("children", ","))


@query("SELECT p_brand, p_size, array_to_string(list_sort(list(DISTINCT p_type)), ',') AS codes FROM part GROUP BY p_brand, p_size HAVING count(DISTINCT p_type) > 1")
def ambiguity_groups(spark, sf):
    return vo.ambiguous(t(spark, sf, "part"), ["p_brand", "p_size"], "p_type").withColumn("codes", F.array_join("codes", ","))


@query("SELECT p_partkey, p_brand || '|' || p_type || '|' || (row_number() OVER (PARTITION BY p_brand, p_type ORDER BY p_partkey) - 1) AS term_id FROM part")
def term_ids(spark, sf):
    return vo.term_ids(t(spark, sf, "part"), ["p_brand", "p_type"], [F.col("p_partkey")]).select("p_partkey", "term_id")


@query("""WITH need AS (SELECT DISTINCT l_orderkey AS m, l_returnflag || l_linestatus AS part FROM lineitem WHERE l_orderkey % 50 = 0), idx AS (SELECT DISTINCT l_suppkey AS code, l_returnflag || l_linestatus AS part FROM lineitem),
n AS (SELECT m, count(*) AS c FROM need GROUP BY m)
SELECT m, code FROM (SELECT need.m, code, count(*) AS got FROM need JOIN idx USING (part) GROUP BY need.m, code) g JOIN n USING (m) WHERE got = c""")
def set_intersection_components(spark, sf):
    x = t(spark, sf, "lineitem").withColumn("part", F.concat("l_returnflag", "l_linestatus"))
    need = x.where("l_orderkey % 50 = 0").select(F.col("l_orderkey").alias("m"), "part")
    return ln.covering(need, x.select(F.col("l_suppkey").alias("code"), "part"), "m", "part", "code")


@query("""WITH s AS (SELECT user_id, ts, max(event_id) AS section FROM events WHERE event_type = 'signup' GROUP BY user_id, ts)
SELECT e.event_id, coalesce(s.section, -1) AS section FROM (SELECT * FROM events WHERE event_type <> 'signup') e ASOF LEFT JOIN s ON e.user_id = s.user_id AND e.ts >= s.ts""")
def asof_section(spark, sf):
    e = t(spark, sf, "events").select("event_id", "user_id", "ts", "event_type")
    s = e.where("event_type = 'signup'").groupBy("user_id", "ts").agg(F.max("event_id").alias("section"))
    return sp.asof(e.where("event_type <> 'signup'"), s, ["user_id"], "ts", ["section"]).select("event_id", F.coalesce("section", F.lit(-1).cast("long")).alias("section"))


_SPAN = "SELECT event_id, user_id, event_type, CAST(floor(epoch(ts)) AS BIGINT) AS s, CAST(floor(epoch(ts)) AS BIGINT) + 3600 AS e FROM events"


def _spans(spark, sf):
    s = F.unix_timestamp(F.col("ts").cast("timestamp"))
    return t(spark, sf, "events").select("event_id", "user_id", "event_type", s.alias("s"), (s + 3600).alias("e"))


@query(f"WITH v AS ({_SPAN}) SELECT a.event_id AS a_event_id, b.event_id AS b_event_id FROM v a JOIN v b ON a.user_id = b.user_id AND a.s < b.e AND a.e > b.s AND a.event_type = 'error' AND b.event_type = 'purchase'")
def interval_overlap(spark, sf):
    v = _spans(spark, sf).withColumnsRenamed({"s": "start", "e": "end"})
    return sp.overlaps(v.where("event_type = 'error'"), v.where("event_type = 'purchase'"), ["user_id"], 7200).select("a_event_id", "b_event_id")


@query(f"""WITH v AS ({_SPAN}), b AS (SELECT *, max(e) OVER (PARTITION BY user_id ORDER BY s, e, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS p FROM v),
g AS (SELECT *, sum(CASE WHEN p IS NULL OR s > p + 7200 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY s, e, event_id) AS island FROM b)
SELECT user_id, CAST(island AS BIGINT) AS island, min(s) AS s, max(e) AS e, count(*) AS n FROM g GROUP BY user_id, island""")
def gaps_islands(spark, sf):
    v = sp.islands(_spans(spark, sf), ["user_id"], "s", "e", 7200, ["event_id"])
    return v.groupBy("user_id", "island").agg(F.min("s").alias("s"), F.max("e").alias("e"), F.count("*").alias("n"))


@query(f"""WITH v AS ({_SPAN}), b AS (SELECT user_id, max(e) OVER (PARTITION BY user_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS gap_start, s AS gap_end FROM v)
SELECT * FROM b WHERE gap_end - gap_start >= 86400""")
def uncovered_gaps(spark, sf):
    return sp.gaps(_spans(spark, sf), ["user_id"], "s", "e", 86400)


@query("""SELECT l_suppkey, l_orderkey, l_linenumber, rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber) AS INTEGER) AS rank FROM lineitem) WHERE rank <= 10""")
def topk_per_group(spark, sf):
    return ln.ranked(t(spark, sf, "lineitem"), ["l_suppkey"], [F.col("l_extendedprice").desc(), F.col("l_orderkey"), F.col("l_linenumber")], 10).select("l_suppkey", "l_orderkey", "l_linenumber", "rank")


@query("""WITH r AS (SELECT o_custkey, o_orderkey, o_totalprice, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC) AS k FROM orders)
SELECT a.o_custkey, a.o_orderkey AS top_code, a.o_totalprice AS top_score, round(a.o_totalprice - b.o_totalprice, 6) AS lead FROM r a LEFT JOIN r b ON a.o_custkey = b.o_custkey AND b.k = 2 WHERE a.k = 1""")
def margin_top2(spark, sf):
    return ln.margin(t(spark, sf, "orders"), ["o_custkey"], "o_orderkey", "o_totalprice").withColumn("lead", F.round("lead", 6))


@query("""WITH x AS (SELECT l_suppkey AS m, l_partkey % 20 AS code, l_linenumber AS term, l_quantity / 50.0 AS s FROM lineitem), r AS (SELECT *, row_number() OVER (PARTITION BY m, code ORDER BY s DESC) AS k FROM x),
g AS (SELECT m, code, max(s) AS best, avg(s) FILTER (WHERE k <= 3) AS mean_top, count(DISTINCT term) AS terms FROM r GROUP BY m, code)
SELECT m, code, round(best, 6) AS best, round(mean_top, 6) AS mean_top, terms, round(least(1.0, 0.75 * best + 0.25 * mean_top + least(0.06, 0.02 * (terms - 1))), 6) AS aggregate_score FROM g""")
def evidence_aggregate(spark, sf):
    x = t(spark, sf, "lineitem").select(F.col("l_suppkey").alias("m"), (F.col("l_partkey") % 20).alias("code"), F.col("l_linenumber").alias("term"), (F.col("l_quantity") / 50.0).alias("s"))
    g = ln.evidence(x, "m", "code", "term", "s")
    return g.select("m", "code", F.round("best", 6).alias("best"), F.round("mean_top", 6).alias("mean_top"), "terms", F.round("aggregate_score", 6).alias("aggregate_score"))


@query("""WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings), s AS (SELECT q.vec_id AS q, x.vec_id AS code, list_cosine_similarity(q.e, x.e) AS score FROM v q JOIN v x ON true WHERE q.vec_id % 50 = 0)
SELECT q, code, CAST(rank AS INTEGER) AS rank, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, code) AS rank FROM s) WHERE rank <= 50""")
def vector_topk(spark, sf):
    v = t(spark, sf, "embeddings")
    return ln.nearest(v.where("vec_id % 50 = 0"), v, "vec_id", "vec_id", "embedding", 50).select("q", "code", "rank", F.round("score", 6).alias("score"))


@query("""WITH g AS (SELECT DISTINCT doc_id FROM labels WHERE toxic = 1), p AS (SELECT DISTINCT doc_id FROM labels WHERE quality = 0), s AS (SELECT (SELECT count(*) FROM g JOIN p USING (doc_id)) AS tp, (SELECT count(*) FROM g) AS n_gold, (SELECT count(*) FROM p) AS n_pred),
r AS (SELECT *, CASE WHEN n_pred > 0 THEN tp / n_pred ELSE 0.0 END AS p, CASE WHEN n_gold > 0 THEN tp / n_gold ELSE 0.0 END AS r FROM s)
SELECT tp, n_gold, n_pred, round(p, 9) AS precision, round(r, 9) AS recall, round(CASE WHEN tp > 0 THEN 2 * p * r / (p + r) ELSE 0.0 END, 9) AS f1 FROM r""")
def set_metrics(spark, sf):
    x = t(spark, sf, "labels")
    s = ln.span_scores(x.where("toxic = 1"), x.where("quality = 0"), ["doc_id"])
    return s.select("tp", "n_gold", "n_pred", *[F.round(c, 9).alias(c) for c in ("precision", "recall", "f1")])


@query("""WITH b AS (SELECT o_custkey, list(DISTINCT o_orderpriority) FILTER (WHERE o_orderstatus = 'O') AS g, list(DISTINCT o_orderpriority) FILTER (WHERE o_orderstatus <> 'O') AS p FROM orders GROUP BY o_custkey),
c AS (SELECT coalesce(g, []) AS g, coalesce(p, []) AS p FROM b), j AS (SELECT len(g) + 1 AS w, CASE WHEN len(list_distinct(list_concat(g, p))) = 0 THEN 1.0 ELSE len(list_intersect(g, p)) / len(list_distinct(list_concat(g, p))) END AS j FROM c)
SELECT round(sum(j * w) / sum(w), 9) AS weighted_jaccard, CAST(sum(w) AS BIGINT) AS weight FROM j""")
def weighted_jaccard(spark, sf):
    o = t(spark, sf, "orders").groupBy("o_custkey").agg(F.collect_set(F.when(F.col("o_orderstatus") == "O", F.col("o_orderpriority"))).alias("g"), F.collect_set(F.when(F.col("o_orderstatus") != "O", F.col("o_orderpriority"))).alias("p"))
    return ln.weighted_jaccard(o, "g", "p").withColumn("weighted_jaccard", F.round("weighted_jaccard", 9))


@query("SELECT o_orderstatus, quantile_disc(o_totalprice, 0.95) AS nearest_rank, round(quantile_cont(o_totalprice, 0.95), 6) AS interpolated, round(quantile_cont(o_totalprice, 0.5), 6) AS median FROM orders GROUP BY o_orderstatus")
def percentiles(spark, sf):
    p = ln.percentiles(t(spark, sf, "orders"), ["o_orderstatus"], "o_totalprice", 0.95)
    return p.select("o_orderstatus", "nearest_rank", F.round("interpolated", 6).alias("interpolated"), F.round("median", 6).alias("median"))


@query("""WITH c AS (SELECT c_mktsegment AS k, count(*) AS w FROM customer GROUP BY 1), e AS (SELECT k, w * 97 / (SELECT sum(w) FROM c) AS x FROM c), b AS (SELECT k, CAST(floor(x) AS BIGINT) AS b, x - floor(x) AS f FROM e)
SELECT k, b + CASE WHEN row_number() OVER (ORDER BY f DESC, k) <= 97 - (SELECT sum(b) FROM b) THEN 1 ELSE 0 END AS n FROM b""")
def quota(spark, sf):
    c = t(spark, sf, "customer").groupBy(F.col("c_mktsegment").alias("k")).agg(F.count("*").alias("w"))
    return ln.quota(c, "k", "w", 97)


@query("""SELECT (SELECT count(*) FROM (SELECT lang, source FROM documents WHERE doc_id % 2 = 0 EXCEPT ALL SELECT lang, source FROM documents WHERE doc_id % 2 = 1)) AS only_a,
(SELECT count(*) FROM (SELECT lang, source FROM documents WHERE doc_id % 2 = 1 EXCEPT ALL SELECT lang, source FROM documents WHERE doc_id % 2 = 0)) AS only_b, false AS same""")
def multiset_equal(spark, sf):
    d = t(spark, sf, "documents")
    return ln.same_rows(d.where("doc_id % 2 = 0").select("lang", "source"), d.where("doc_id % 2 = 1").select("lang", "source"))


@query("SELECT p_partkey, CASE WHEN p_size <= 12 THEN 'I' WHEN p_size <= 30 THEN 'II' WHEN p_size <= 48 THEN NULL ELSE 'XXII' END AS chapter FROM part")
def chapter_ranges(spark, sf):
    code = F.when(F.col("p_size") <= 12, F.lit("B01.1")).when(F.col("p_size") <= 30, F.lit("D48")).when(F.col("p_size") <= 48, F.lit("7x")).otherwise(F.lit("u49.1"))
    return t(spark, sf, "part").select("p_partkey", tx.chapter_of(code).alias("chapter"))


@query("""SELECT l_orderkey, l_linenumber, round(0.55 * (1 - l_discount) + 0.2 * l_tax + 0.1 * l_quantity / 50.0, 6) AS support,
CASE WHEN l_returnflag = 'A' THEN 'exact' WHEN 0.55 * (1 - l_discount) + 0.2 * l_tax + 0.1 * l_quantity / 50.0 >= 0.76 THEN 'strong' WHEN 0.55 * (1 - l_discount) + 0.2 * l_tax + 0.1 * l_quantity / 50.0 >= 0.64 THEN 'medium' ELSE 'weak' END AS level FROM lineitem""")
def support_levels(spark, sf):
    s = 0.55 * (1 - F.col("l_discount")) + 0.2 * F.col("l_tax") + 0.1 * F.col("l_quantity") / 50.0
    return t(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.round(s, 6).alias("support"), ln.support_level(s, F.col("l_returnflag") == "A").alias("level"))


@query("SELECT doc_id, 'cand_' || left(sha256(source || chr(31) || text), 16) AS id FROM documents")
def hash_ids(spark, sf):
    return t(spark, sf, "documents").select("doc_id", tx.digest_id("cand_", F.col("source"), F.col("text")).alias("id"))


@query("SELECT date_trunc('hour', ts) AS window_start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def windowed_counts(spark, sf):
    return ca.windowed_counts(t(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp")), "ts", "event_type").withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


@query("""SELECT user_id, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS r FROM events WHERE event_type <> 'error') WHERE r = 1""")
def last_write(spark, sf):
    e = t(spark, sf, "events").select("user_id", "event_id", "value", (F.col("event_type") != "error").alias("valid"))
    return ca.last_write(e, "user_id", "event_id").select("user_id", "event_id", "value")


@query("SELECT o_orderkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R')")
def resume_missing(spark, sf):
    done = t(spark, sf, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return ca.missing(t(spark, sf, "orders").select("o_orderkey"), done, ["o_orderkey"])


@query("""WITH w AS (SELECT p_partkey, ['amlodipine ' || p_size || ' mg po qd', 'x ' || p_size || ',5 mcg q' || (p_size % 12 + 1) || 'h', p_size || ' g bid'][CAST(p_partkey % 3 AS INTEGER) + 1] AS m, p_partkey % 3 AS k, p_size FROM part)
SELECT p_partkey, round(CASE k WHEN 0 THEN p_size WHEN 1 THEN (p_size + 0.5) * 0.001 ELSE p_size * 1000.0 END, 6) AS mg, CASE k WHEN 0 THEN 'QD' WHEN 1 THEN 'Q' || (p_size % 12 + 1) || 'H' ELSE 'BID' END AS freq, CASE k WHEN 0 THEN 24 WHEN 1 THEN p_size % 12 + 1 ELSE 12 END AS hours FROM w""")
def dose_parse(spark, sf):
    s = F.col("p_size").cast("string")
    m = F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("amlodipine "), s, F.lit(" mg po qd"))).when(F.col("p_partkey") % 3 == 1, F.concat(F.lit("x "), s, F.lit(",5 mcg q"), (F.col("p_size") % 12 + 1).cast("string"), F.lit("h"))).otherwise(F.concat(s, F.lit(" g bid")))
    p = t(spark, sf, "part").select("p_partkey", tx.strengths(m)[0].alias("s"), tx.frequency(m).alias("f"))
    return p.select("p_partkey", F.round(tx.milligrams(F.col("s.value"), F.col("s.unit")), 6).alias("mg"), F.col("f.code").alias("freq"), F.col("f.hours").alias("hours"))


@query(f"""WITH RECURSIVE v AS ({_SPAN}), w AS (SELECT user_id, s, e, pow((event_id % 97) / 97.0, 3) AS w, row_number() OVER (PARTITION BY user_id ORDER BY e, s, event_id) AS i FROM v),
p AS (SELECT a.user_id, a.i, any_value(a.w) AS w, count(b.i) AS p FROM w a LEFT JOIN w b ON a.user_id = b.user_id AND b.e <= a.s GROUP BY a.user_id, a.i),
r AS (SELECT user_id, CAST(0 AS BIGINT) AS i, [CAST(0 AS DOUBLE)] AS best FROM (SELECT DISTINCT user_id FROM w)
      UNION ALL SELECT r.user_id, p.i, list_append(r.best, greatest(r.best[r.i + 1], p.w + r.best[p.p + 1])) FROM r JOIN p ON p.user_id = r.user_id AND p.i = r.i + 1)
SELECT user_id, round(max(best[len(best)]), 6) AS total FROM r GROUP BY user_id""")
def weighted_interval(spark, sf):
    """What the chosen spans of each user are worth."""
    v = _spans(spark, sf).withColumnsRenamed({"s": "start", "e": "end"}).withColumn("score", (F.col("event_id") % 97) / 97.0)
    return sp.schedule(v, "user_id").groupBy("user_id").agg(F.round(F.sum(F.pow("score", 3)), 6).alias("total"))


def _mentions(spark, sf):
    n = F.col("p_size").cast("string")
    return t(spark, sf, "part").select(F.col("p_partkey").alias("mention_id"), "p_size", F.concat(F.lit("Paracetamol "), n, F.when(F.col("p_partkey") % 2 == 0, " mg viên nén po bid").otherwise(" mg/5 ml iv q6h")).alias("mention"))


@query("""SELECT p_partkey AS mention_id, 'acetaminophen' AS core, p_size || CASE WHEN p_partkey % 2 = 0 THEN ' MG' ELSE ' MG/5 ML' END AS strengths, CASE WHEN p_partkey % 2 = 0 THEN 'oral tablet' ELSE '' END AS forms,
CASE WHEN p_partkey % 2 = 0 THEN 'PO' ELSE 'IV' END AS route, CASE WHEN p_partkey % 2 = 0 THEN 'BID' ELSE 'Q6H' END AS frequency, CASE WHEN p_partkey % 2 = 0 THEN 12 ELSE 6 END AS hours, CASE WHEN p_partkey % 2 = 0 THEN 'full_product' ELSE 'ingredient_strength' END AS specificity,
'acetaminophen ' || p_size || CASE WHEN p_partkey % 2 = 0 THEN ' mg oral tablet' ELSE ' mg/5 ml' END AS normalized FROM part""")
def drug_parse(spark, sf):
    d = dg.parse_mentions(_mentions(spark, sf), "mention")
    p = F.col("parsed")
    return d.select("mention_id", p["core"].alias("core"), F.array_join(p["strengths"], ";").alias("strengths"), F.array_join(p["dose_forms"], ";").alias("forms"), p["route"].alias("route"), p["frequency"].alias("frequency"), p["interval_hours"].alias("hours"), p["specificity"].alias("specificity"), p["normalized"].alias("normalized"))


@query("""WITH c AS (SELECT p_partkey AS mention_id, p_size, k FROM part, (SELECT unnest(['1', '2', '3']) AS k))
SELECT mention_id, k AS rxcui, CAST(k AS INTEGER) AS rank, CASE k WHEN '1' THEN 'strong' WHEN '2' THEN 'weak' ELSE 'rejected' END AS level,
round(CASE k WHEN '1' THEN 0.28 * 0.5 + 0.12 * 0.5 + 0.30 + 0.13 + 0.06 + 0.10 + 0.13 WHEN '2' THEN 0.28 * 0.5 + 0.12 * 0.5 + 0.30 - 0.05 - 0.01 - 0.08 ELSE -1 + 0.005 END, 6) AS score FROM c""")
def drug_rank(spark, sf):
    m = _mentions(spark, sf).withColumn("mention", F.concat(F.lit("Paracetamol "), F.col("p_size").cast("string"), F.lit(" mg viên nén po bid")))
    return dr.once_per_text(m, ["p_size", "mention"], _ranked)


def _ranked(mentions: DataFrame) -> DataFrame:
    none = F.array().cast("array<string>")
    m = dg.parse_mentions(mentions, "mention")
    strength = F.concat((F.col("p_size") + F.when(F.col("rxcui") == "3", 1).otherwise(0)).cast("string"), F.lit(" MG"))
    c = m.withColumn("rxcui", F.explode(F.array(*map(F.lit, "123")))).withColumn("tty", F.when(F.col("rxcui") == "2", "IN").otherwise("SCD"))
    c = c.withColumn("bare", F.col("tty") == "IN").select("*", F.when(F.col("bare"), "acetaminophen").otherwise(F.concat(F.lit("acetaminophen "), strength, F.lit(" Oral Tablet"))).alias("name"), F.array(F.lit("acetaminophen")).alias("ingredients"), none.alias("brands"), F.when(F.col("bare"), none).otherwise(F.array(strength)).alias("cand_strengths"), F.when(F.col("bare"), none).otherwise(F.array(F.lit("Oral Tablet"))).alias("cand_forms"), none.alias("cand_releases"), none.alias("current"))
    c = c.select("*", F.lit(0.5).alias("dense"), F.lit(0.5).alias("lexical"), *[F.lit(v).alias(k) for k, v in {"exact_term": False, "structured": False, "active": True, "historical": False}.items()])
    return dr.rank_drugs(c).select("mention_id", "rxcui", "rank", "level", F.round("score", 6).alias("score"))


@query("""SELECT doc_id, CASE CAST(doc_id % 4 AS INTEGER) WHEN 0 THEN 'direct' WHEN 1 THEN 'direct' WHEN 2 THEN 'blocked' ELSE 'absent' END AS scope FROM documents""")
def negation_scope(spark, sf):
    lead = F.element_at(F.array(*map(F.lit, ["không ghi nhận co giật, ", "bệnh nhân không ", "không đáp ứng điều trị ", "bệnh nhân có "])), (F.col("doc_id") % 4 + 1).cast("int"))
    d = t(spark, sf, "documents").select("doc_id", F.concat(F.coalesce("text", F.lit("")), F.lit(". "), lead).alias("before")).withColumn("raw", F.concat("before", F.lit("sốt")))
    start = F.length("before")
    return d.select("doc_id", an.negation(F.col("raw"), start, start + 3, F.lit("sốt"), F.lit(an.SYMPTOM)).alias("scope"))


@query("""SELECT doc_id AS record_id, 0 AS start, 5 AS "end", CASE WHEN doc_id % 3 = 0 THEN 'KHÁC' ELSE 'THUỐC' END AS type, CASE WHEN doc_id % 3 = 0 THEN 'unknown_type' ELSE 'text_is_not_slice' END AS rule FROM documents WHERE length(text) >= 5 AND doc_id % 3 < 2""")
def output_violations(spark, sf):
    d = t(spark, sf, "documents").where(F.length("text") >= 5)
    third = F.col("doc_id") % 3
    none = F.array().cast("array<string>")
    return ou.violations(d.select(F.col("doc_id").alias("record_id"), F.col("text").alias("raw"), F.when(third == 1, "@@@@@").otherwise(F.substring("text", 1, 5)).alias("text"), F.when(third == 0, "KHÁC").otherwise(an.DRUG).alias("type"), none.alias("candidates"), none.alias("assertions"), F.lit(0).alias("start"), F.lit(5).alias("end"), F.lit(0).alias("position")))


@query("""WITH d AS (SELECT doc_id, replace(coalesce(text, ''), chr(13), ' ') AS x FROM documents), h AS (SELECT doc_id, 'Tiền sử bệnh: ' || x || chr(10) AS a, 'Khám tại bệnh viện: ' || x AS b FROM d)
SELECT doc_id, 0 AS block, 1 AS section_no, 0 AS start, length(a) AS "end", md5(a) AS body FROM h UNION ALL SELECT doc_id, 1, 3, length(a), length(a) + length(b), md5(b) FROM h""")
def note_sections(spark, sf):
    x = F.replace(F.coalesce("text", F.lit("")), F.lit("\r"), F.lit(" "))
    d = t(spark, sf, "documents").select("doc_id", F.concat(F.lit("Tiền sử bệnh: "), x, F.lit("\nKhám tại bệnh viện: "), x).alias("raw"))
    return no.sections(d, "doc_id", "raw").select("doc_id", "block", "section_no", "start", "end", F.md5(F.col("body").cast("binary")).alias("body"))


@query("""WITH w AS (SELECT item_id, unnest(string_split(text, ' ')) AS word, generate_subscripts(string_split(text, ' '), 1) AS i FROM benchmark),
o AS (SELECT item_id, length(word) AS n, coalesce(sum(length(word) + 1) OVER (PARTITION BY item_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s FROM w)
SELECT item_id, 'TERM' AS type, CAST(s AS INTEGER) AS start, CAST(s + n AS INTEGER) AS "end" FROM o WHERE n > 0 AND s % 7 = 0""")
def bio_round_trip(spark, sf):
    d = t(spark, sf, "benchmark").select("item_id", F.split("text", " ").alias("w"))
    w = d.select("item_id", F.posexplode("w").alias("i", "word"), "w").withColumn("start", F.aggregate(F.slice("w", 1, F.col("i")), F.lit(0), lambda a, x: a + F.length(x) + 1)).withColumn("end", F.col("start") + F.length("word"))
    w = w.where("end > start").select("item_id", "start", "end")
    e = w.where("start % 7 = 0").withColumn("type", F.lit("TERM"))
    return sp.bio_runs(sp.bio_tags(w, e, "item_id"), "item_id")


def rank_codes(spark, sf):
    """Flagship: items against documents by words, then lead and decision.

    The items' words are the small side of the join, hits are counted before the shuffle,
    and a limited window keeps the two best documents of an item.
    """
    items = t(spark, sf, "benchmark").select("item_id", F.array_distinct(tx.tokens(F.col("text"))).alias("w"))
    docs = t(spark, sf, "documents").select("doc_id", F.explode(F.array_distinct(tx.tokens(F.col("text")))).alias("token"))
    need = items.select("item_id", F.size("w").alias("need"))
    hit = items.select("item_id", F.explode("w").alias("token")).join(docs, "token").groupBy("item_id", "doc_id").agg(F.count("*").alias("got")).join(need, "item_id").withColumn("score", F.col("got") / F.col("need"))
    best = ln.margin(hit, ["item_id"], "doc_id", "score")
    return best.select("item_id", F.when((F.col("top_score") >= 0.5) & (F.coalesce("lead", F.lit(1.0)) >= 0.035), F.col("top_code")).otherwise(F.lit(-1)).alias("code"), F.round("top_score", 6).alias("top_score"), F.round(F.coalesce("lead", F.lit(1.0)), 6).alias("lead"))


QUERIES["rank_codes"] = rank_codes
ORACLE["rank_codes"] = """WITH i AS (SELECT item_id, unnest(list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+'))) AS token FROM benchmark), d AS (SELECT doc_id, unnest(list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+'))) AS token FROM documents),
n AS (SELECT item_id, count(*) AS need FROM i GROUP BY item_id), h AS (SELECT i.item_id, d.doc_id, count(*) AS got FROM i JOIN d USING (token) GROUP BY 1, 2), s AS (SELECT item_id, doc_id, got / need AS score, row_number() OVER (PARTITION BY item_id ORDER BY got / need DESC, doc_id) AS k FROM h JOIN n USING (item_id))
SELECT a.item_id, CASE WHEN a.score >= 0.5 AND coalesce(a.score - b.score, 1.0) >= 0.035 THEN a.doc_id ELSE -1 END AS code, round(a.score, 6) AS top_score, round(coalesce(a.score - b.score, 1.0), 6) AS lead FROM s a LEFT JOIN s b ON a.item_id = b.item_id AND b.k = 2 WHERE a.k = 1"""


def _register() -> None:
    """The case queries of the other modules, beside those above."""
    from . import linking_cases, note_cases, record_cases, span_cases

    for m in (linking_cases, note_cases, record_cases, span_cases):
        QUERIES.update(m.QUERIES)
        ORACLE.update(m.ORACLE)


_register()
