"""Tool-call linking for chat formatting, in DataFrame operations only (operator 3).

Calls and results meet by a hash join on the call's identifier.  A call may name one
call it comes after; levels of that forest (a topological order: sort by level, then
turn) follow by pointer doubling, in as many rounds as the logarithm of the longest
chain, so a conversation of any length is never gathered.  A call's position in that
order comes from a range partitioning: row numbers within a partition's share of the
conversation, after the sizes of its shares before.  Arguments are parsed as variants
and held against their tool's schema (required, unknown and wrongly typed fields).
A linked call is serialised as canonical JSON: keys sorted, no white space.

Defined cases: a call without a result is ``unanswered``, a result without a call
``orphan``; a call in or behind a circle has the status ``cycle``, no level and the last positions; several
results of one call are counted and the least is shown; calls that share an id keep
a row each; a null id links with nothing; null or malformed arguments give the error
``not an object``; a null text is an argument left out; a tool without a schema gives
``no schema``; equal rows take neighbouring positions; very long texts are values like
others; an empty table gives an empty result; further columns are never read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import table, written

SCHEMAS = [("answer", "query", "STRING", True), ("answer", "turn", "BIGINT", True), ("answer", "style", "STRING", False), ("search", "query", "STRING", True), ("search", "lang", "STRING", True)]


def levels(calls: DataFrame) -> DataFrame:
    """``(call_id, level)`` of the distinct ids of ``calls(call_id, after)``; null level in or behind a circle."""
    ids = calls.where("call_id IS NOT NULL").groupBy("call_id").agg(F.min("after").alias("up"))
    known = ids.select(F.col("call_id").alias("up"))
    state = written(ids.join(known, "up", "left_semi").select("call_id", "up", F.lit(1).cast("long").alias("level")).unionByName(ids.join(known, "up", "left_anti").select("call_id", F.lit(None).cast("string").alias("up"), F.lit(0).cast("long").alias("level"))), "levels")
    n, open_ = state.agg(F.count("*"), F.count("up")).first()
    for _ in range(max(1, n).bit_length() + 1):
        if not open_:
            break
        above = state.select(F.col("call_id").alias("up"), F.col("up").alias("upper"), F.col("level").alias("more"))
        state = written(state.join(above, "up", "left").select("call_id", F.col("upper").alias("up"), (F.col("level") + F.coalesce("more", F.lit(0))).alias("level")), "levels")
        open_ = state.agg(F.count("up")).first()[0]
    return state.select("call_id", F.when(F.col("up").isNull(), F.col("level")).alias("level"))


def argument_errors(arguments: Column, schema: Column) -> Column:
    """Sorted messages; ``schema`` is ``map<string, struct<type string, required boolean>>``."""
    kind = lambda v: F.regexp_extract(F.schema_of_variant(v), "^[A-Z]+", 0)
    missing = F.transform(F.filter(F.map_keys(schema), lambda k: schema[k]["required"] & ~F.array_contains(F.map_keys(arguments), k)), lambda k: F.concat(F.lit("missing "), k))
    unknown = F.transform(F.filter(F.map_keys(arguments), lambda k: ~F.array_contains(F.map_keys(schema), k)), lambda k: F.concat(F.lit("unknown "), k))
    both = F.filter(F.map_keys(arguments), lambda k: F.array_contains(F.map_keys(schema), k))
    wrong = F.transform(F.filter(both, lambda k: kind(arguments[k]) != schema[k]["type"]), lambda k: F.concat(F.lit("type of "), k))
    checked = F.array_sort(F.concat(missing, unknown, wrong))
    return F.when(schema.isNull(), F.array(F.lit("no schema"))).when(arguments.isNull(), F.array(F.lit("not an object"))).otherwise(checked)


def positions(rows: DataFrame, group: str, order: list[str]) -> DataFrame:
    """``rows`` with their place from 0 in the order of their group, nulls last; no group is gathered in one task."""
    by = [F.col(c).asc_nulls_last() for c in order]
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cut = written(rows.repartitionByRange(parts, group, *by).withColumn("__part", F.spark_partition_id()), "ordered")
    before = W.partitionBy(group).orderBy("__part").rowsBetween(W.unboundedPreceding, -1)
    shares = cut.groupBy(group, "__part").agg(F.count("*").alias("__n")).withColumn("__base", F.coalesce(F.sum("__n").over(before), F.lit(0)))
    placed = cut.withColumn("__at", F.row_number().over(W.partitionBy("__part", group).orderBy(*by)))
    met = placed.alias("a").join(F.broadcast(shares.where("__base > 0")).alias("b"), (F.col("a.__part") == F.col("b.__part")) & F.col(f"a.{group}").eqNullSafe(F.col(f"b.{group}")), "left")
    return met.select("a.*", F.coalesce("b.__base", F.lit(0).cast("long")).alias("__base")).withColumn("position", F.col("__base") + F.col("__at") - 1).drop("__part", "__at", "__base")


def link_calls(calls: DataFrame, results: DataFrame, schemas: DataFrame) -> DataFrame:
    """One row a call or orphan result.

    ``calls(conv_id, turn, call_id, name, arguments, after)``, ``results(conv_id, turn,
    call_id, content)``, ``schemas(name, field, type, required)``.
    """
    schema = schemas.groupBy("name").agg(F.map_from_entries(F.collect_list(F.struct("field", F.struct("type", "required")))).alias("schema"))
    got = results.where("call_id IS NOT NULL").groupBy("call_id").agg(F.min("content").alias("result"), F.count("*").alias("n_results"))
    deep = levels(calls)
    rows = calls.join(schema, "name", "left").join(got, "call_id", "left").join(deep, "call_id", "left")
    rows = rows.withColumn("value", F.expr("try_parse_json(arguments)"))
    rows = rows.withColumn("fields", F.expr("CASE WHEN schema_of_variant(value) LIKE 'OBJECT%' THEN try_variant_get(value, '$', 'map<string,variant>') END"))
    rows = rows.withColumn("errors", argument_errors(F.col("fields"), F.col("schema")))
    status = F.when(F.col("call_id").isNotNull() & F.col("level").isNull(), "cycle").when(F.coalesce("n_results", F.lit(0)) > 0, "linked").otherwise("unanswered")
    rows = positions(rows.drop("value", "fields", "schema"), "conv_id", ["level", "turn", "call_id"]).withColumn("value", F.expr("try_parse_json(arguments)"))
    rows = rows.withColumn("status", status).withColumn("n_results", F.coalesce("n_results", F.lit(0).cast("long")))
    text = F.to_json(F.struct(F.col("value").alias("arguments"), "errors", F.col("call_id").alias("id"), "level", "name", "result", "status"), {"ignoreNullFields": "false"})
    linked = rows.select("conv_id", "turn", "call_id", "name", "status", "level", "position", "n_results", (F.size("errors") == 0).alias("valid"), F.array_join("errors", "; ").alias("errors"), text.alias("canonical_json"))
    lost = results.join(calls.select("call_id").where("call_id IS NOT NULL").distinct(), "call_id", "left_anti")
    text = F.to_json(F.struct(F.col("call_id").alias("id"), F.col("content").alias("result"), F.lit("orphan").alias("status")), {"ignoreNullFields": "false"})
    none = lambda t: F.lit(None).cast(t)
    orphans = lost.select("conv_id", "turn", "call_id", none("string").alias("name"), F.lit("orphan").alias("status"), none("long").alias("level"), none("long").alias("position"), F.lit(0).cast("long").alias("n_results"), F.lit(False).alias("valid"), F.lit("").alias("errors"), text.alias("canonical_json"))
    return linked.unionByName(orphans)


def identifier(conv: Column, turn: Column) -> Column:
    """Null where either is null."""
    return F.substring(F.sha2(F.concat_ws(":", conv.cast("string"), turn.cast("string")).cast("binary"), 256), 1, 16)


def turns_as_calls(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Every user turn as a call that comes after the user turn two before, and every assistant turn as the result of the turn before.

    By its place a call has sound arguments for ``answer`` (kinds 0 and 1), a turn that
    is text (2), a language that is a number for ``search`` (3), prose (4), or a tool
    without a schema (5).
    """
    t = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    whole = F.col("conv_id").isNotNull() & F.col("turn").isNotNull()
    own = lambda back: F.when(whole, identifier(F.col("conv_id"), F.col("turn") - back))
    kind = F.pmod(F.coalesce("conv_id", F.lit(0)) + F.coalesce("turn", F.lit(0)), F.lit(6))
    query, turn = F.col("text").alias("query"), F.col("turn")
    made = [F.struct(turn, query), F.struct(F.lit("brief").alias("style"), turn, query), F.struct(turn.cast("string").alias("turn"), query), F.struct(query, turn.alias("lang")), None, F.struct(query)]
    arguments = F.concat(F.lit("say "), F.col("text"))
    for k, fields in enumerate(made):
        if fields is not None:
            arguments = F.when(kind == k, F.to_json(fields)).otherwise(arguments)
    name = F.when(kind == 3, "search").when(kind == 5, "lookup").otherwise("answer")
    calls = t.where("role = 'user'").select("conv_id", "turn", own(0).alias("call_id"), name.alias("name"), arguments.alias("arguments"), own(2).alias("after"))
    results = t.where("role = 'assistant'").select("conv_id", "turn", own(1).alias("call_id"), F.coalesce("text", F.lit("")).alias("content"))
    return calls, results


def op3_tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    schemas = spark.sql("SELECT * FROM VALUES " + ", ".join(f"('{a}', '{b}', '{c}', {str(d).lower()})" for a, b, c, d in SCHEMAS) + " AS t(name, field, type, required)")
    return link_calls(*turns_as_calls(table(spark, sf_dir, "conversations")), schemas)


ORACLE_SQL = """
WITH RECURSIVE c AS (SELECT conv_id, turn, text, left(sha256(conv_id || ':' || turn), 16) AS id, (conv_id + turn) % 6 AS kind FROM conversations WHERE role = 'user'),
r AS (SELECT conv_id, turn, coalesce(text, '') AS text, left(sha256(conv_id || ':' || (turn - 1)), 16) AS id FROM conversations WHERE role = 'assistant'),
d AS (SELECT conv_id, turn, CAST(0 AS BIGINT) AS level FROM c WHERE NOT EXISTS (SELECT 1 FROM c p WHERE p.conv_id = c.conv_id AND p.turn = c.turn - 2)
      UNION ALL SELECT c.conv_id, c.turn, d.level + 1 FROM d JOIN c ON c.conv_id = d.conv_id AND c.turn = d.turn + 2),
g AS (SELECT id, min(text) AS result, count(*) AS n FROM r GROUP BY id),
k AS (SELECT c.*, d.level, g.result, coalesce(g.n, 0) AS n, CASE WHEN g.n > 0 THEN 'linked' ELSE 'unanswered' END AS status, CASE kind WHEN 3 THEN 'search' WHEN 5 THEN 'lookup' ELSE 'answer' END AS name,
  coalesce('"query":' || CAST(to_json(text) AS VARCHAR), '') AS q, CASE WHEN text IS NULL THEN '' ELSE ',' END AS comma,
  CASE kind WHEN 5 THEN ['no schema'] WHEN 4 THEN ['not an object'] ELSE list_concat(CASE WHEN text IS NULL THEN ['missing query'] ELSE [] END, CASE kind WHEN 2 THEN ['type of turn'] WHEN 3 THEN ['type of lang'] ELSE [] END) END AS errors
  FROM c JOIN d USING (conv_id, turn) LEFT JOIN g ON g.id = c.id)
SELECT conv_id, turn, id AS call_id, name, status, level, row_number() OVER (PARTITION BY conv_id ORDER BY level, turn, id) - 1 AS position, n AS n_results, len(errors) = 0 AS valid, array_to_string(errors, '; ') AS errors,
  '{"arguments":' || CASE kind WHEN 0 THEN '{' || q || comma || '"turn":' || turn || '}' WHEN 1 THEN '{' || q || comma || '"style":"brief","turn":' || turn || '}' WHEN 2 THEN '{' || q || comma || '"turn":"' || turn || '"}'
    WHEN 3 THEN '{"lang":' || turn || comma || q || '}' WHEN 5 THEN '{' || q || '}' ELSE 'null' END || ',"errors":' || CAST(to_json(errors) AS VARCHAR) || ',"id":"' || id || '","level":' || level || ',"name":"' || name || '","result":' || coalesce(CAST(to_json(result) AS VARCHAR), 'null') || ',"status":"' || status || '"}' AS canonical_json
FROM k
UNION ALL
SELECT conv_id, turn, id, NULL, 'orphan', NULL, NULL, 0, false, '', '{"id":"' || id || '","result":' || CAST(to_json(text) AS VARCHAR) || ',"status":"orphan"}'
FROM r WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.id = r.id)
"""
