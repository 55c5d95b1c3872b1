"""Retrieval, evidence, ranking and evaluation of linked codes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


COVER_BLOCK = 4096  # codes of one set in one row; mentions are a sixteenth, so two blocks give a million pairs at most


def covering(mentions: DataFrame, index: DataFrame, mention: str, part: str, code: str) -> DataFrame:
    """Codes that hold every part of a mention: an equi-join on parts and a count, never a scan of the index.

    Mentions with the same parts have the same codes, and codes with the same parts the same
    mentions, so only distinct sets are joined and counted.  Their members follow in blocks of
    bounded size, so a set of any number of mentions or codes is dealt over all tasks.  Blocks
    are opened in two compiled stages: compiled as one, both loops would run before any row
    is handed on, with a million pairs on the heap.  A mention with a null part has no code; a
    null part of a code matches nothing.
    """
    need = _sets(mentions.where(F.col(mention).isNotNull()), mention, part).where("whole")
    have = _sets(index.where(F.col(part).isNotNull()), code, part)
    a, b = (x.select("parts").distinct().select(F.col("parts").alias(n), F.explode("parts").alias("_part")) for x, n in ((need, "_need"), (have, "_have")))
    met = a.join(b, "_part").groupBy("_need", "_have").agg(F.count("*").alias("got")).where("got = size(_need)").select("_need", "_have")
    left, right = (_blocks(x, k).withColumnsRenamed({"parts": n, "members": m}) for x, k, n, m in ((need, max(COVER_BLOCK // 16, 1), "_need", "_m"), (have, COVER_BLOCK, "_have", "_c")))
    pairs = left.join(met, "_need").join(right, "_have").select("_m", "_c")
    n = int(mentions.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    one = pairs.repartition(n).select(F.explode("_m").alias(mention), "_c").coalesce(n)  # as many partitions: it only ends the compiled stage
    return one.select(mention, F.explode("_c").alias(code))


def _sets(rows: DataFrame, key: str, part: str) -> DataFrame:
    """``(key, parts, whole)``: the sorted distinct parts of each key, and whether none of them is null."""
    d = rows.select(F.col(key).alias("key"), F.col(part).alias("part")).distinct()
    return d.groupBy("key").agg(F.array_sort(F.collect_list("part")).alias("parts"), (F.count("*") == F.count("part")).alias("whole"))


def _blocks(sets: DataFrame, size: int) -> DataFrame:
    """``(parts, members)``: the keys of each set in blocks of about ``size``."""
    n = sets.groupBy("parts").agg(F.ceil(F.count("*") / size).alias("n"))
    d = sets.join(n, "parts").withColumn("block", F.pmod(F.xxhash64("key"), "n"))
    return d.groupBy("parts", "block").agg(F.collect_list(F.struct("key")).alias("members")).select("parts", F.col("members.key").alias("members"))  # a list of plain keys would lose null


def components_or_union(mentions: DataFrame, index: DataFrame, mention: str, part: str, code: str) -> DataFrame:
    """As :func:`covering` when a mention has two parts or more and each has a hit; else the union of the hits."""
    need = mentions.select(mention, part).distinct()
    hits = need.join(index.select(part, code).distinct(), part)
    found = hits.groupBy(mention).agg(F.count_distinct(part).alias("found"))
    n = need.groupBy(mention).agg(F.count("*").alias("need")).join(found, mention)
    per = hits.groupBy(mention, code).agg(F.count("*").alias("got")).join(n, mention)
    return per.where("NOT (need >= 2 AND found = need) OR got = need").select(mention, code)


def evidence(rows: DataFrame, mention: str, code: str, term: str, score: str) -> DataFrame:
    """Scores of each code: the best, the mean of the best three, distinct terms, and their bounded sum.

    The best three come from a window limited to them before the shuffle; nothing else is kept of a code's rows.
    """
    by = [mention, code]
    top = ranked(rows, by, [F.col(score).desc(), F.col(term)], 3)
    best = top.groupBy(*by).agg(F.max(score).alias("best"), F.avg(score).alias("mean_top"), F.min_by(term, "rank").alias("best_term"))
    g = rows.groupBy(*by).agg(F.count_distinct(term).alias("terms")).join(best, by)
    bonus = F.least(F.lit(0.06), F.lit(0.02) * (F.col("terms") - 1))
    return g.withColumn("aggregate_score", F.least(F.lit(1.0), F.lit(0.75) * F.col("best") + F.lit(0.25) * F.col("mean_top") + bonus))


def ranked(df: DataFrame, keys: Sequence[str], order: Sequence[Column], limit: int) -> DataFrame:
    """The first ``limit`` rows of each key with their rank."""
    return df.withColumn("rank", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= limit)


def margin(df: DataFrame, keys: Sequence[str], code: str, score: str) -> DataFrame:
    """Best code (the smaller of equals), its score, and its lead over the second; no lead for a single candidate."""
    top = ranked(df.select(*keys, F.col(code).alias("_code"), F.col(score).alias("_score")), keys, [F.col("_score").desc(), F.col("_code")], 2)
    first = lambda c, r: F.max(F.when(F.col("rank") == r, F.col(c)))
    g = top.groupBy(*keys).agg(first("_code", 1).alias("top_code"), first("_score", 1).alias("top_score"), first("_score", 2).alias("_second"))
    return g.withColumn("lead", F.col("top_score") - F.col("_second")).drop("_second")


def unit(v: Column) -> Column:
    """The vector over its length; a zero vector fails the query."""
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    return F.transform(v, lambda x: x.cast("double") / F.when(norm == 0, F.raise_error(F.lit("zero vector"))).otherwise(norm))


def inner(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def nearest(queries: DataFrame, index: DataFrame, query: str, code: str, vector: str, k: int, block: int = 4096, shards: int = 64) -> DataFrame:
    """The ``k`` nearest by inner product of unit vectors.

    Up to ``block`` queries are sent to all tasks.  More are dealt into blocks and the
    index into ``shards``; each block meets each shard in one bucket of an equi-join,
    and only the best ``k`` of a bucket go on.
    """
    q = queries.select(F.col(query).alias("q"), unit(F.col(vector)).alias("qv"))
    x = index.select(F.col(code).alias("code"), unit(F.col(vector)).alias("xv"))
    score = inner(F.col("qv"), F.col("xv")).alias("score")
    best = [F.col("score").desc(), F.col("code")]
    n = queries.count()
    if n <= block:
        return ranked(q.hint("broadcast").join(x).select("q", "code", score), ["q"], best, k)
    blocks = -(-n // block)
    q = q.withColumn("b", F.pmod(F.xxhash64("q"), F.lit(blocks))).withColumn("s", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    x = x.withColumn("s", F.pmod(F.xxhash64("code"), F.lit(shards)).cast("int")).withColumn("b", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))
    part = ranked(q.join(x, ["b", "s"]).select("q", "s", "code", score), ["q", "s"], best, k).drop("rank")
    return ranked(part.select("q", "code", "score"), ["q"], best, k)


def support_level(score: Column, exact: Column) -> Column:
    return F.when(exact, "exact").when(score >= 0.76, "strong").when(score >= 0.64, "medium").otherwise("weak")


def span_scores(gold: DataFrame, pred: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Micro precision, recall and F1 over distinct keys."""
    g, p = gold.select(*keys).distinct().withColumn("g", F.lit(1)), pred.select(*keys).distinct().withColumn("p", F.lit(1))
    s = g.join(p, list(keys), "full").agg(F.count(F.when(F.col("g").isNotNull() & F.col("p").isNotNull(), 1)).alias("tp"), F.count("g").alias("n_gold"), F.count("p").alias("n_pred"))
    ratio = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(0.0)
    s = s.withColumn("precision", ratio("tp", "n_pred")).withColumn("recall", ratio("tp", "n_gold"))
    return s.withColumn("f1", F.when(F.col("tp") > 0, 2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall"))).otherwise(0.0))


def weighted_jaccard(df: DataFrame, gold: str, pred: str) -> DataFrame:
    """Mean Jaccard of two array columns, weighted by the number of gold codes plus one; two empty sets agree."""
    union = F.size(F.array_union(gold, pred))
    j = F.when(union == 0, 1.0).otherwise(F.size(F.array_intersect(gold, pred)) / union)
    w = F.size(F.array_distinct(gold)) + 1
    return df.agg((F.sum(j * w) / F.sum(w)).alias("weighted_jaccard"), F.sum(w).alias("weight"))


def quota(df: DataFrame, key: str, weight: str, total: int) -> DataFrame:
    """Largest-remainder shares of ``total``; ties by key.

    The rows are groups (one a key), already aggregated: the sums are one small row, and
    the order among the remainders is a count of those before, by an aggregate over arrays.
    """
    all_ = F.broadcast(df.agg(F.sum(weight).alias("_all"), F.array_sort(F.collect_list(F.struct(F.col(key).alias("k"), F.col(weight).alias("w")))).alias("_rows")))
    d = df.join(all_)
    part = lambda r: F.struct((-(r["w"] * F.lit(total) / F.col("_all") - F.floor(r["w"] * F.lit(total) / F.col("_all")))).alias("f"), r["k"].alias("k"))
    d = d.withColumn("_order", F.array_sort(F.transform("_rows", part)))
    base = F.floor(F.col(weight) * F.lit(total) / F.col("_all")).cast("long")
    left = F.lit(total) - F.aggregate("_rows", F.lit(0).cast("long"), lambda a, r: a + F.floor(r["w"] * F.lit(total) / F.col("_all")).cast("long"))
    turn = F.array_position(F.transform("_order", lambda o: o["k"]), F.col(key))
    return d.select(key, (base + (turn <= left).cast("long")).alias("n"))


def percentiles(df: DataFrame, keys: Sequence[str], value: str, rank: float) -> DataFrame:
    """Nearest-rank percentile, interpolated percentile and median of each key."""
    return df.groupBy(*keys).agg(F.expr(f"percentile_disc({rank}) WITHIN GROUP (ORDER BY {value})").alias("nearest_rank"), F.percentile(value, rank).alias("interpolated"), F.percentile(value, 0.5).alias("median"))


def first_copies(df: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """Distinct keys in their first row's place, with the number of copies; a partial aggregate."""
    return df.groupBy(*keys).agg(F.min(order).alias(order), F.count("*").alias("copies"))


def same_rows(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: whether two tables hold the same rows as often, and how many are in one only."""
    return a.exceptAll(b).agg(F.count("*").alias("only_a")).crossJoin(b.exceptAll(a).agg(F.count("*").alias("only_b"))).withColumn("same", (F.col("only_a") == 0) & (F.col("only_b") == 0))
