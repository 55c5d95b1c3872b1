"""Candidates for drug and disease mentions from lookups, by equi-joins.

A lookup is one long table ``(kind, key, rxcui)``; every way to find a candidate is a
join of exploded keys with it.  Results of all ways are merged in one aggregate.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.drug import normalized
from ..functions.text import fold_marks, nfkc
from .disease_ranking import TYPE_BONUS, alias_key, forms, lexical, words
from .linking import components_or_union, ranked

LEXICAL_LIMIT, COVERAGE = 96, 0.60
MARGIN_DRUG = 0.035
# Words that may be stuck to the end of a name; types whose names are components.
STUCK = ["trongngay", "hangngay", "moingay", "nhung", "oral", "ngay"]
COMPONENT_TYPES = ["IN", "PIN", "MIN", "BN"]
SOURCES = ["exact_term", "exact_ingredient", "exact_brand", "exact_structured", "historical_current_mapping"]


def query_key(c: Column) -> Column:
    return normalized(nfkc(c))


def compact(key: Column) -> Column:
    """Letters and digits of a key without marks."""
    return F.regexp_replace(fold_marks(key), r"[^\p{L}\p{N}]", "")


def lookups(records: DataFrame) -> DataFrame:
    """``(kind, key, rxcui)`` of flat records ``(rxcui, ingredients, strengths, dose_forms, release_types, brands)``."""
    both = lambda kind, name: F.flatten(F.transform("ingredients", lambda i: F.transform(name, lambda x: F.struct(F.lit(kind).alias("kind"), F.concat_ws(" ", i, x).alias("text")))))
    one = lambda kind, name: F.transform(name, lambda x: F.struct(F.lit(kind).alias("kind"), x.alias("text")))
    every = F.concat(one("core", "ingredients"), one("brand", "brands"), both("strength", "strengths"), both("form", "dose_forms"), both("release", "release_types"))
    d = records.select("rxcui", F.explode(every).alias("k")).select("rxcui", "k.kind", query_key(F.col("k.text")).alias("key"))
    return d.where("key <> ''").distinct().select("kind", "key", "rxcui")


def retrieve_drugs(mentions: DataFrame, terms: DataFrame, table: DataFrame) -> DataFrame:
    """Merged candidates ``(mention_id, rxcui, tier, tty, historical, exact_term, exact_ingredient, exact_structured, matched_terms, sources)``.

    ``mentions(mention_id, normalized, components, strengths, dose_forms, release_types,
    brands)``; ``terms(rxcui, text, tier, tty, priority, current)``; ``table`` is
    :func:`lookups`.  Historical candidates bring the concepts they became.
    """
    keyed = terms.withColumn("key", query_key(F.col("text")))
    hit = keyed.join(mentions.select("mention_id", F.col("normalized").alias("key")), "key").select("mention_id", "rxcui", "text", F.lit("exact_term").alias("source"))
    part = mentions.select("mention_id", F.explode("components").alias("c")).withColumn("key", query_key(F.col("c"))).select("mention_id", "key")
    core = table.where("kind = 'core'").select("key", "rxcui")
    ingredient = components_or_union(part, core, "mention_id", "key", "rxcui").withColumn("source", F.lit("exact_ingredient"))
    brand = mentions.select("mention_id", F.explode("brands").alias("b")).select("mention_id", query_key(F.col("b")).alias("key")).join(table.where("kind = 'brand'"), "key").select("mention_id", "rxcui", F.lit("exact_brand").alias("source"))
    joined = lambda kind, name: F.flatten(F.transform("components", lambda c: F.transform(name, lambda x: F.struct(F.lit(kind).alias("kind"), F.concat_ws(" ", c, x).alias("text")))))
    asked = mentions.select("mention_id", F.explode(F.concat(joined("strength", "strengths"), joined("form", "dose_forms"), joined("release", "release_types"))).alias("k")).select("mention_id", "k.kind", query_key(F.col("k.text")).alias("key"))
    structured = asked.join(table, ["kind", "key"]).select("mention_id", "rxcui")
    many = mentions.where("size(components) >= 2").select("mention_id")
    found = part.distinct().join(core, "key").groupBy("mention_id", "rxcui").agg(F.count("*").alias("got")).join(part.distinct().groupBy("mention_id").agg(F.count("*").alias("need")), "mention_id").where("got = need")
    structured = structured.unionByName(found.join(many, "mention_id", "left_semi").select("mention_id", "rxcui")).withColumn("source", F.lit("exact_structured"))
    by_id = ingredient.unionByName(brand).unionByName(structured).distinct().join(terms.select("rxcui", "text"), "rxcui").select("mention_id", "rxcui", "text", "source")
    merged = merge_candidates(hit.unionByName(by_id), terms)
    became = merged.where("historical").join(terms.groupBy("rxcui").agg(F.flatten(F.collect_set("current")).alias("current")), "rxcui").select("mention_id", F.explode(F.array_distinct("current")).alias("rxcui"))
    later = became.distinct().join(terms.select("rxcui", "text"), "rxcui").withColumn("source", F.lit("historical_current_mapping"))
    # a concept that was found already only gains the source
    known = merged.select("mention_id", "rxcui")
    extra = later.join(known, ["mention_id", "rxcui"], "left_semi").select("mention_id", "rxcui", F.lit(None).cast("string").alias("text"), "source").distinct()
    new = later.join(known, ["mention_id", "rxcui"], "left_anti").select("mention_id", "rxcui", "text", "source")
    return merge_candidates(hit.unionByName(by_id).unionByName(extra).unionByName(new), terms)


def merge_candidates(rows: DataFrame, terms: DataFrame) -> DataFrame:
    """One row a mention and concept: flags of its sources, distinct terms and sources, and the tier of its best term."""
    best = terms.groupBy("rxcui").agg(F.min_by(F.struct("tier", "tty"), F.struct("priority", "tier", "text")).alias("b"))
    order = F.array(*map(F.lit, SOURCES))
    g = rows.groupBy("mention_id", "rxcui").agg(F.array_sort(F.collect_set("text")).alias("matched_terms"), F.collect_set("source").alias("s")).join(best, "rxcui")
    has = lambda *names: F.arrays_overlap("s", F.array(*map(F.lit, names)))
    return g.select(
        "mention_id", "rxcui", "b.tier", "b.tty", (F.col("b.tier") == "historical").alias("historical"), has("exact_term", "exact_brand").alias("exact_term"), has("exact_ingredient").alias("exact_ingredient"),
        has("exact_structured").alias("exact_structured"), "matched_terms", F.filter(order, lambda x: F.array_contains("s", x)).alias("sources"),
    )


def component_lexicon(terms: DataFrame) -> DataFrame:
    """``(compact, term)``: of terms with the same letters the shortest, at least 4 letters."""
    d = terms.where(F.col("tty").isin(COMPONENT_TYPES)).select(query_key(F.col("text")).alias("term")).withColumn("compact", compact(F.col("term")))
    return d.where("length(compact) >= 4").groupBy("compact").agg(F.min_by("term", F.struct(F.length("term"), "term")).alias("term"))


def recovered_components(mentions: DataFrame, lexicon: DataFrame) -> DataFrame:
    """``(mention_id, components, note)`` of mentions ``(mention_id, component)`` whose one component is fused.

    The earliest split into two known names counts; else a known name with a word about
    taking stuck to its end.  Whole known names and short ones are left alone.
    """
    m = mentions.withColumn("c", compact(query_key(F.col("component")))).where("length(c) >= 8")
    m = m.join(lexicon.select(F.col("compact").alias("c")), "c", "left_anti")
    cut = m.select("mention_id", "c", F.explode(F.sequence(F.lit(4), F.length("c") - 4)).alias("at")).select("mention_id", "at", F.expr("substring(c, 1, at)").alias("a"), F.expr("substring(c, at + 1)").alias("b"))
    cut = cut.join(lexicon.toDF("a", "ta"), "a").join(lexicon.toDF("b", "tb"), "b")
    two = cut.groupBy("mention_id").agg(F.min_by(F.array("ta", "tb"), "at").alias("components")).withColumn("note", F.lit("concatenated_components_recovered"))
    tails = F.array_compact(F.array(*[F.when(F.endswith(F.col("c"), F.lit(s)), F.struct(F.lit(k).alias("k"), F.expr(f"substring(c, 1, length(c) - {len(s)})").alias("a"))) for k, s in enumerate(STUCK)]))
    one = m.select("mention_id", F.explode(tails).alias("t")).select("mention_id", "t.k", "t.a").join(lexicon.toDF("a", "ta"), "a")
    one = one.groupBy("mention_id").agg(F.min_by(F.array("ta"), "k").alias("components")).withColumn("note", F.lit("attached_administration_suffix_removed"))
    return two.unionByName(one.join(two, "mention_id", "left_anti"))


def part_union(children: DataFrame, parts: int = 2) -> DataFrame:
    """One code for each part of a fused mention from ranked ``children(mention_id, part, surface, rxcui, level, rank, margin)``.

    Every part needs a first supported code that is exact, or strong with a clear lead
    or alone; codes must differ.  Otherwise the mention gives no row.
    """
    good = children.where("level IN ('exact', 'strong')")
    g = good.groupBy("mention_id", "part").agg(F.min_by(F.struct("rxcui", "level", "surface", "margin"), "rank").alias("t"), F.count("*").alias("n"))
    g = g.where((F.col("t.level") == "exact") | (F.col("n") == 1) | (F.col("t.margin") >= MARGIN_DRUG))
    whole = g.groupBy("mention_id").agg(F.count("*").alias("n"), F.count_distinct("t.rxcui").alias("d")).where((F.col("n") == parts) & (F.col("d") == parts)).select("mention_id")
    return g.join(whole, "mention_id", "left_semi").select("mention_id", "part", F.lit(parts).alias("parts"), "t.surface", "t.rxcui", "t.level")


def certain(candidates: DataFrame, least: float, mention: str = "mention_id") -> DataFrame:
    """The conservative answer of ranked ``(mention, code, level, rank, score)``: the only exact code, or a strong one alone or ahead by ``least``."""
    ok = candidates.where("level IN ('exact', 'strong', 'medium')")
    g = ok.groupBy(mention).agg(F.min_by(F.struct("code", "level", "score"), "rank").alias("t"), F.count("*").alias("n"), F.count(F.when(F.col("level") == "exact", 1)).alias("exact"))
    second = ranked(ok.select(mention, "code", "score", F.col("rank").alias("_r")), [mention], [F.col("_r")], 2).where("rank = 2").select(mention, F.col("score").alias("s2"))
    g = g.join(second, mention, "left")
    sure = ((F.col("t.level") == "exact") & (F.col("exact") == 1)) | ((F.col("t.level") == "strong") & ((F.col("n") == 1) | (F.col("t.score") - F.col("s2") >= least)))
    return g.where(sure).select(mention, "t.code")


# -- diseases -------------------------------------------------------------


def exact_aliases(mentions: DataFrame, terms: DataFrame, configured: dict[str, str]) -> DataFrame:
    """``(mention_id, code, source)``: a configured code alone, else all codes of the alias, unique or ambiguous."""
    m = mentions.withColumn("key", alias_key(F.col("mention")))
    fixed = F.lit(None).cast("string")
    for k, v in configured.items():
        fixed = F.when(F.col("key") == k, v).otherwise(fixed)
    m = m.withColumn("fixed", fixed)
    own = m.where("fixed IS NOT NULL").select("mention_id", F.col("fixed").alias("code"), F.lit("configured_exact_alias").alias("source"))
    t = terms.withColumn("key", alias_key(F.col("text"))).select("key", "code").distinct()
    codes = t.groupBy("key").agg(F.count("*").alias("n"))
    hit = m.where("fixed IS NULL").select("mention_id", "key").join(t, "key").join(codes, "key")
    return own.unionByName(hit.select("mention_id", "code", F.when(F.col("n") == 1, "metadata_exact_unique").otherwise("metadata_exact_ambiguous").alias("source")))


def lexical_terms(mentions: DataFrame, terms: DataFrame, limit: int = LEXICAL_LIMIT) -> DataFrame:
    """Terms that hold all meaningful words of some form of a mention, with a score by wording; the best ``limit`` a mention.

    ``mentions(mention_id, mention)``, ``terms(term_id, code, text, term_type)``.  Words
    meet in an equi-join and a count; only the pairs left are compared as texts.
    """
    m = mentions.select("mention_id", F.explode(forms(alias_key(F.col("mention")))).alias("form")).withColumn("w", F.array_distinct(words(F.col("form")))).where("size(w) > 0")
    t = terms.select("term_id", F.explode(forms(alias_key(F.col("text")))).alias("tf")).select("term_id", F.explode(F.array_distinct(words(F.col("tf")))).alias("word")).distinct()
    met = m.select("mention_id", "form", F.size("w").alias("need"), F.explode("w").alias("word")).join(t, "word").groupBy("mention_id", "form", "need", "term_id").agg(F.count("*").alias("got")).where("got = need")
    d = lexical(met.join(terms, "term_id"), "form", "text")
    x = F.col("lex")
    bonus = F.lit(0.0)
    for k, v in TYPE_BONUS.items():
        bonus = F.when(F.col("term_type") == k, v).otherwise(bonus)
    score = F.least(F.lit(0.995), 0.60 + 0.19 * x["mention_coverage"] + 0.09 * x["candidate_coverage"] + 0.07 * x["similarity"] + 0.04 * x["contained"].cast("int") + bonus)
    d = d.where(x["mention_coverage"] >= COVERAGE).select("mention_id", "term_id", "code", "form", score.alias("score"))
    best = d.groupBy("mention_id", "term_id", "code").agg(F.max_by("form", "score").alias("form"), F.max("score").alias("score"))
    return best.withColumn("rank", F.row_number().over(W.partitionBy("mention_id").orderBy(F.col("score").desc(), "code", "term_id"))).where(F.col("rank") <= limit)
