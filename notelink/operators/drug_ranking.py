"""Ranking drug concepts for parsed mentions.

Candidates are rows with ``mention_id, parsed`` (see :mod:`notelink.functions.drug`)
and ``rxcui, tty, name, ingredients, brands, cand_strengths, cand_forms,
cand_releases`` (arrays, null as empty), ``dense, lexical, exact_term, structured,
active, historical, current``.  Features, scores and levels are columns; the one
shuffle is by mention.  Ties go to the smaller ``rxcui``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.drug import normalized
from ..functions.similarity import best_guarded
from ..functions.text import let

PRODUCTS = ["SCD", "SBD", "GPCK", "BPCK"]
BARE = ["IN", "PIN", "MIN", "BN"]
# What a term type adds, by how specific the mention is.
TYPE_BONUS = {
    "full_product": {"SCD": 0.130, "SBD": 0.090, "SCDC": -0.060, "SCDF": -0.060, "IN": -0.080, "PIN": -0.070, "MIN": -0.070},
    "ingredient_strength": {"SCD": 0.140, "SBD": 0.090, "SCDC": -0.080, "SCDF": -0.080, "IN": -0.050, "PIN": -0.040, "MIN": -0.040},
    "ingredient_form": {"IN": 0.100, "PIN": 0.080, "MIN": 0.080, "SCDF": -0.040, "SCD": -0.050, "SBD": -0.050},
    "ingredient_only": {"IN": 0.070, "PIN": 0.065, "MIN": 0.060, "BN": 0.055, "SCD": -0.050, "SBD": -0.055, "SCDC": -0.030, "SCDF": -0.030, "GPCK": -0.060, "BPCK": -0.060},
}
# Words of forms that suit a route and that exclude it.
SUITS = {
    "PO": ["oral", "tablet", "capsule", "solution", "suspension", "sublingual"], "IV": ["injection", "injectable", "intravenous"],
    "IM": ["injection", "injectable", "intramuscular"], "SC": ["injection", "injectable", "subcutaneous"], "OPHTH": ["ophthalmic"],
    "TOP": ["topical", "cream", "ointment", "lotion", "foam", "gel"], "SL": ["sublingual"],
}
EXCLUDES = {
    "IV": ["oral", "tablet", "capsule", "topical", "ophthalmic"], "IM": ["oral", "tablet", "capsule", "topical", "ophthalmic"],
    "SC": ["oral", "tablet", "capsule", "topical", "ophthalmic"], "PO": ["injectable", "injection", "ophthalmic", "topical"],
    "OPHTH": ["oral", "tablet", "capsule", "injection", "topical"], "TOP": ["oral", "tablet", "capsule", "injection", "ophthalmic"],
    "SL": ["injection", "ophthalmic", "topical"],
}
# Weights of relations.
STRENGTH_WEIGHT = {"exact": 0.13, "range_contains": 0.09, "dose_interpretation": 0.02, "mention_more_specific": -0.05, "candidate_more_specific": -0.04}
FORM_WEIGHT = {"exact": 0.06, "candidate_more_specific": -0.02}
RELEASE_WEIGHT = {"exact": 0.04, "candidate_more_specific": -0.01}
ROUTE_WEIGHT = {"exact": 0.10, "unknown": -0.01}
LEVELS = ["rejected", "weak", "medium", "strong", "exact"]
MARGIN = 0.035

_AMOUNT = r"(\d+(?:\.\d+)?)\s*(mcg|mg|gm|g|meq|iu|unt|units?)\b"


def _or_empty(c: Column) -> Column:
    return F.coalesce(c, F.array().cast("array<string>"))


def amounts(strengths: Column) -> Column:
    """``array<struct<value decimal, family>>``: masses in milligrams, other units as they are."""
    found = F.flatten(F.transform(strengths, lambda x: F.regexp_extract_all(normalized(x), F.lit(_AMOUNT), F.lit(0))))

    def one(m: Column) -> Column:
        return let(F.regexp_extract(m, "[a-z]+$", 0), lambda unit: of_unit(m, unit))

    def of_unit(m: Column, unit: Column) -> Column:
        factor = F.when(unit == "mcg", F.lit("0.001")).when(unit.isin("g", "gm"), F.lit("1000")).otherwise(F.lit("1")).cast("decimal(10,3)")
        value = (F.regexp_extract(m, _AMOUNT, 1).cast("decimal(20,6)") * factor).cast("decimal(30,9)")
        return F.struct(value.alias("value"), F.when(unit.isin("mcg", "mg", "g", "gm"), "mass").otherwise(F.regexp_replace(unit, "s$", "")).alias("family"))

    return F.transform(found, one)


def strength_relation(mention: Column, role: Column, forms: Column, candidate: Column) -> Column:
    return let(F.struct(amounts(mention).alias("m"), amounts(candidate).alias("c")), lambda v: _strength_relation(v["m"], v["c"], mention, role, forms, candidate))


def _strength_relation(m: Column, c: Column, mention: Column, role: Column, forms: Column, candidate: Column) -> Column:
    family = lambda f: F.transform(F.filter(m, lambda x: x["family"] == f), lambda x: x["value"])
    within = F.exists(c, lambda x: (F.size(family(x["family"])) >= 2) & x["value"].between(F.array_min(family(x["family"])), F.array_max(family(x["family"]))))
    below = F.exists(c, lambda x: (x["value"] > 0) & (x["value"] <= F.array_max(family(x["family"]))))
    none_m, none_c = F.size(mention) == 0, F.size(candidate) == 0
    return (
        F.when(none_m & none_c, "both_missing").when(none_m, "candidate_more_specific").when(none_c, "mention_more_specific").when(F.arrays_overlap(m, c), "exact")
        .when((role == "range") & within, "range_contains").when((F.size(forms) == 0) & F.coalesce(below, F.lit(False)), "dose_interpretation").otherwise("conflict")
    )


def term_relation(mention: Column, candidate: Column) -> Column:
    """Terms agree if one holds the other."""
    both = F.struct(F.transform(mention, normalized).alias("m"), F.transform(candidate, normalized).alias("c"))
    meets = let(both, lambda v: F.exists(v["m"], lambda a: F.exists(v["c"], lambda b: F.contains(a, b) | F.contains(b, a))))
    none_m, none_c = F.size(mention) == 0, F.size(candidate) == 0
    return F.when(none_m & none_c, "both_missing").when(none_m, "candidate_more_specific").when(none_c, "mention_more_specific").when(meets, "exact").otherwise("conflict")


def route_relation(route: Column, forms: Column, name: Column) -> Column:
    def of(hay: Column) -> Column:
        out = F.lit("unknown")
        for r in SUITS:
            out = F.when((route == r) & hay.rlike("|".join(SUITS[r])), "exact").when((route == r) & hay.rlike("|".join(EXCLUDES[r])), "conflict").otherwise(out)
        return out

    return let(normalized(F.concat_ws(" ", forms, name)), of)


def component_scores(components: Column, names: Column, fuzzy: Column) -> Column:
    """For each component its best match among ``names``: equal, one in the other, shared words, or alike in letters."""
    def match(a: Column, b: Column) -> Column:
        x, y = F.array_distinct(F.split(a, " ")), F.array_distinct(F.split(b, " "))
        shared = F.size(F.array_intersect(x, y)) / F.greatest(F.size(x), F.size(y))
        held = (F.least(F.length(a), F.length(b)) >= 4) & (F.contains(a, b) | F.contains(b, a))
        return F.when((a == "") | (b == ""), 0.0).when(a == b, 1.0).otherwise(F.greatest(F.when(held, F.when(shared >= 0.5, 0.92).otherwise(0.82)).otherwise(0.0), shared * 0.85))

    plain = F.transform(components, lambda a: F.coalesce(F.array_max(F.transform(names, lambda b: match(a, b))), F.lit(0.0)))
    return F.zip_with(plain, fuzzy, lambda a, b: F.greatest(a, b))


def _weight(c: Column, table: dict[str, float]) -> Column:
    out = F.lit(0.0)
    for k, v in table.items():
        out = F.when(c == k, v).otherwise(out)
    return out


def features(candidates: DataFrame) -> DataFrame:
    """Adds the relations of each candidate to its mention."""
    p = F.col("parsed")
    d = candidates
    for c in ("ingredients", "brands", "cand_strengths", "cand_forms", "cand_releases", "current"):
        d = d.withColumn(c, _or_empty(F.col(c)))
    norm = lambda c: F.filter(F.array_distinct(F.transform(c, normalized)), lambda x: x != "")
    own = F.when((F.size("ingredients") == 0) & F.col("tty").isin("IN", "PIN", "MIN"), F.array(normalized(F.col("name")))).otherwise(norm(F.col("ingredients")))
    d = d.withColumn("_names", F.concat(own, norm(F.col("brands")), F.array(normalized(F.coalesce("name", F.lit("")))))).withColumn("_parts", F.transform(p["components"], normalized))
    d = d.withColumn("_fuzzy", best_guarded("_parts", "_names")).withColumn("_scores", component_scores(F.col("_parts"), F.col("_names"), F.col("_fuzzy")))
    full = F.size(F.filter("_scores", lambda s: s >= 0.88))
    some = F.size(F.filter("_scores", lambda s: s >= 0.68))
    n, warned = F.size("_parts"), lambda w: F.array_contains(p["warnings"], w)
    gate = (
        F.when(warned("generic_drug_class"), "generic_class").when(warned("negated_or_excluded_ingredient"), "negated").when(n == 0, "unknown").when(full == n, "exact")
        .when((n >= 2) & (some > 0), "incomplete_combination").when(some > 0, "partial").otherwise("mismatch")
    )
    d = d.withColumn("ingredient_relation", gate).withColumn("strength_relation", strength_relation(p["strengths"], p["strength_role"], p["dose_forms"], F.col("cand_strengths")))
    d = d.withColumn("form_relation", term_relation(p["dose_forms"], F.col("cand_forms"))).withColumn("release_relation", term_relation(p["releases"], F.col("cand_releases")))
    d = d.withColumn("route_relation", F.when(p["route"].isNull(), "unknown").otherwise(route_relation(p["route"], F.col("cand_forms"), F.col("name"))))
    over = (p["specificity"] == "ingredient_only") & F.col("tty").isin(PRODUCTS) & ~F.col("exact_term")
    return d.withColumn("over_specific", F.coalesce(over, F.lit(False))).drop("_names", "_parts", "_fuzzy", "_scores")


def scored(candidates: DataFrame) -> DataFrame:
    """Adds ``rejections, evidence, score, level`` to rows with features."""
    p, ing = F.col("parsed"), F.col("ingredient_relation")
    clash = lambda given, c, why: F.when((F.size(given) > 0) & (F.col(c) == "conflict"), why)
    why = F.array_compact(F.array(
        F.when(ing == "generic_class", "generic_drug_class").when(ing == "negated", "negated_or_excluded_ingredient").when(ing == "mismatch", "ingredient_mismatch").when(ing == "incomplete_combination", "incomplete_combination_coverage"),
        clash(p["releases"], "release_relation", "explicit_release_conflict"), clash(p["dose_forms"], "form_relation", "explicit_form_conflict"),
        clash(p["strengths"], "strength_relation", "explicit_strength_conflict"), F.when(F.col("route_relation") == "conflict", "explicit_route_conflict"),
        F.when(~F.col("active") & (F.size("current") == 0), "inactive_without_current_mapping"),
    ))
    branded = F.exists("brands", lambda b: (normalized(b) == p["normalized"]) | F.array_contains(p["brands"], normalized(b)))
    by_type = F.lit(0.0)
    for s, table in TYPE_BONUS.items():
        by_type = F.when(p["specificity"] == s, _weight(F.col("tty"), table)).otherwise(by_type)
    flag = lambda c, w: F.when(c, w).otherwise(0.0)
    total = (
        0.28 * F.col("dense") + 0.12 * F.col("lexical") + flag(F.col("exact_term"), 0.30) + F.when(ing == "exact", 0.30).when(ing == "partial", 0.08).otherwise(0.0)
        + _weight(F.col("strength_relation"), STRENGTH_WEIGHT) + _weight(F.col("form_relation"), FORM_WEIGHT) + _weight(F.col("release_relation"), RELEASE_WEIGHT) + _weight(F.col("route_relation"), ROUTE_WEIGHT)
        + by_type + flag(F.col("historical"), -0.04) + flag(F.col("structured"), 0.06) + flag(F.col("over_specific"), -0.12) + flag((F.col("tty") == "SBD") & ~branded & ~F.col("exact_term"), -0.10)
    )
    open_ = ["exact", "both_missing", "candidate_more_specific"]
    parts = [ing == "exact", F.col("strength_relation").isin("exact", "range_contains", "dose_interpretation", "both_missing"), F.col("form_relation").isin(open_), F.col("release_relation").isin(open_), F.col("route_relation") != "conflict"]
    met = parts[0].cast("int")
    for x in parts[1:]:
        met = met + x.cast("int")
    d = candidates.withColumn("rejections", why).withColumn("evidence", F.when(F.size("rejections") > 0, 0.0).otherwise(met / 5.0)).withColumn("score", F.when(F.size("rejections") > 0, -1.0 + 0.01 * F.col("dense")).otherwise(total))
    fine = ~F.col("over_specific")
    strong = (ing == "exact") & (F.col("evidence") >= 0.8) & fine & (F.col("tty").isin(BARE) | (p["specificity"] != "ingredient_only")) & (F.col("score") >= 0.52)
    level = (
        F.when(F.size("rejections") > 0, "rejected").when(F.col("exact_term") & (ing == "exact") & fine, "exact")
        .when(strong, F.when(F.array_contains(p["warnings"], "bare_liquid_unit_without_quantity"), "medium").otherwise("strong"))
        .when(ing.isin("exact", "partial") & (F.col("score") >= 0.45) & fine, "medium").otherwise("weak")
    )
    return d.withColumn("level", level)


def rank_drugs(candidates: DataFrame) -> DataFrame:
    """Scored candidates with their ``rank`` within a mention and ``margin``, the lead of the first supported one (null if alone)."""
    d = scored(features(candidates))
    grade = F.array_position(F.array(*map(F.lit, LEVELS)), F.col("level"))
    supported = F.col("level").isin("exact", "strong", "medium")
    by = W.partitionBy("mention_id").orderBy(grade.desc(), F.col("score").desc(), F.col("dense").desc(), "rxcui")
    whole = W.partitionBy("mention_id").orderBy("rank").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    d = d.withColumn("rank", F.row_number().over(by))
    lead = [F.max(F.when(supported & (F.col("rank") == k), F.col("score"))).over(whole) for k in (1, 2)]
    return d.withColumn("margin", lead[0] - lead[1])


def once_per_text(mentions: DataFrame, text: list[str], of: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``of``, which reads only the columns ``text``, run once for each distinct value and joined back to all mentions that have it.

    ``of`` takes the distinct values under a ``mention_id`` of their own and gives rows with that id.
    """
    key = F.struct(*text)
    found = of(mentions.select(*text).distinct().withColumn("mention_id", key)).withColumnRenamed("mention_id", "_text")
    return mentions.select("mention_id", key.alias("_key")).join(found, F.col("_key") == F.col("_text")).drop("_key", "_text")


def predicted(ranked: DataFrame) -> DataFrame:
    """The one code of a mention that is safe to give: the only exact one, or a strong one alone or well ahead."""
    every = W.partitionBy("mention_id")
    d = ranked.withColumn("_exact", F.count(F.when(F.col("level") == "exact", 1)).over(every)).where("rank = 1")
    safe = ((F.col("level") == "exact") & (F.col("_exact") == 1)) | ((F.col("level") == "strong") & (F.col("margin").isNull() | (F.col("margin") >= MARGIN)))
    return d.where(safe).select("mention_id", "rxcui", "level", "score")
