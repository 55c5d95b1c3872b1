"""Vocabulary building: canonical names, ordered distinct names, edges, tiers, terms."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import lexical_text

# Ranks of the term types that may name a concept, and alias types that may not.
PRIMARY_RANK = ["SCD", "SBD", "GPCK", "BPCK", "SCDC", "SBDC", "SCDF", "SBDF", "SCDG", "SBDG", "IN", "PIN", "MIN", "BN", "DF", "DFG"]
ALIAS_TYPES = ["SY", "TMSY", "PSN", "ET"]


def pick(df: DataFrame, keys: Sequence[str], order: Sequence[Column], columns: Sequence[str]) -> DataFrame:
    """One row a key, the least by ``order``: a partial aggregate, no window."""
    rank = F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)])
    return df.groupBy(*keys).agg(F.min_by(F.struct(*columns), rank).alias("r")).select(*keys, "r.*")


def canonical_atoms(atoms: DataFrame) -> DataFrame:
    """Canonical name and flags of each concept."""
    rank = F.coalesce(F.array_position(F.array(*map(F.lit, PRIMARY_RANK)), F.col("tty")), F.lit(0))
    order = [F.col("tty").isin(ALIAS_TYPES), F.col("suppress") != "N", F.col("ispref") != "Y", F.when(rank == 0, 999).otherwise(rank), F.length("text"), F.lower("text"), F.col("line")]
    best = F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)])
    return atoms.groupBy("rxcui").agg(
        F.min_by(F.struct("rxaui", "tty", F.col("text").alias("name")), best).alias("c"), F.bool_or(F.col("suppress") == "N").alias("active"), F.bool_or(F.col("cvf") == "4096").alias("prescribable"),
        F.min_by("text", F.when((F.col("tty") == "PSN") & (F.col("suppress") == "N"), F.struct(F.lower("text"), "line"))).alias("prescribable_name"),
    ).select("rxcui", "c.tty", F.col("c.name").alias("canonical_name"), F.col("c.rxaui").alias("canonical_atom"), "active", "prescribable", "prescribable_name")


def names(atoms: DataFrame, concepts: DataFrame) -> DataFrame:
    """Distinct names by lexical text: the canonical first, then prescribable, then active, then by text."""
    a = atoms.join(concepts.select("rxcui", "canonical_atom"), "rxcui").withColumn("key", lexical_text(F.col("text")))
    a = a.withColumn("kind", F.when(F.col("rxaui") == F.col("canonical_atom"), "canonical").when(F.col("tty") == "PSN", "prescribable").otherwise("synonym"))
    order = [F.col("kind") != "canonical", F.col("tty") != "PSN", F.col("suppress") != "N", F.lower("text"), F.col("line")]
    one = pick(a.where("key <> ''"), ["rxcui", "key"], order, ["text", "kind", "tty", "suppress", "line"])
    order = [F.col("kind") != "canonical", F.col("tty") != "PSN", F.col("suppress") != "N", F.lower("text"), F.col("line")]
    return one.withColumn("position", F.row_number().over(W.partitionBy("rxcui").orderBy(*order)) - 1)


def components(edges: DataFrame, attrs: DataFrame, concepts: DataFrame) -> DataFrame:
    """Ingredient and strength of every component; a branded one inherits from its generic."""
    kind = concepts.select(F.col("rxcui").alias("target"), F.col("tty").alias("kind"))
    ing = pick(edges.where("rela = 'has_ingredient'").join(kind, "target").where("kind <> 'BN'"), ["source"], [F.col("line")], ["target"]).toDF("rxcui", "ingredient")
    precise = pick(edges.where("rela = 'has_precise_ingredient'"), ["source"], [F.col("line")], ["target"]).toDF("rxcui", "precise")
    strength = attrs.where("atn IN ('RXN_STRENGTH', 'RXN_AVAILABLE_STRENGTH')").groupBy("rxcui").agg(F.min_by("atv", F.struct(F.col("atn") != "RXN_STRENGTH", "line")).alias("strength"))
    own = concepts.select("rxcui", "tty").join(ing, "rxcui", "left").join(precise, "rxcui", "left").join(strength, "rxcui", "left")
    generic = edges.where("rela = 'tradename_of'").select(F.col("source").alias("rxcui"), F.col("target").alias("g"), "line")
    facts = own.select(F.col("rxcui").alias("g"), F.col("ingredient").alias("gi"), F.col("precise").alias("gp"), F.col("strength").alias("gs"))
    first = generic.join(facts, "g").groupBy("rxcui").agg(*[F.min_by(c, F.when(F.col(c).isNotNull(), F.col("line"))).alias(c) for c in ("gi", "gp", "gs")])
    return own.join(first, "rxcui", "left").select("rxcui", "tty", F.coalesce("ingredient", "gi").alias("ingredient"), F.coalesce("precise", "gp").alias("precise"), F.coalesce("strength", "gs").alias("strength"))


def history(remaps: DataFrame, archive: DataFrame) -> DataFrame:
    """Old identifiers: remapped if any current one is known, else retired or archived by the first source."""
    a = archive.where("lat = 'ENG' AND sab = 'RXNORM' AND old <> '' AND text <> ''")
    blank = lambda c: F.when(F.col(c) != "", F.col(c))
    both = remaps.select("old", blank("current").alias("current"), F.lit(0).alias("src"), "line", *[F.lit(None).cast("string").alias(c) for c in ("text", "created", "updated")]).unionByName(a.select("old", blank("merged").alias("current"), F.lit(1).alias("src"), "line", "text", blank("created").alias("created"), blank("updated").alias("updated")))
    current = F.array_distinct(F.transform(F.array_sort(F.collect_list(F.when(F.col("current") != F.col("old"), F.struct("src", "line", "current")))), lambda x: x["current"]))
    out = both.groupBy("old").agg(current.alias("current"), F.min("src").alias("src"), F.min("created").alias("first_seen"), F.max("updated").alias("last_seen"))
    return out.select("old", F.when(F.size("current") > 0, "remapped").when(F.col("src") == 0, "retired").otherwise("archived").alias("status"), "current", "first_seen", "last_seen")


def by_priority(sources: Sequence[DataFrame], keys: Sequence[str], order: str) -> DataFrame:
    """Union in order of priority, one row a key: the first source wins, then ``order``."""
    ranked = None
    for k, df in enumerate(sources):
        part = df.withColumn("tier", F.lit(k))
        ranked = part if ranked is None else ranked.unionByName(part, allowMissingColumns=True)
    return pick(ranked, keys, [F.col("tier"), F.col(order)], [c for c in ranked.columns if c not in keys])


def children(edges: DataFrame, parent: str, child: str) -> DataFrame:
    return edges.groupBy(parent).agg(F.array_sort(F.collect_set(child)).alias("children"))


def ambiguous(terms: DataFrame, keys: Sequence[str], code: str) -> DataFrame:
    """Keys shared by two codes or more."""
    return terms.groupBy(*keys).agg(F.array_sort(F.collect_set(code)).alias("codes")).where(F.size("codes") > 1)


def term_ids(terms: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """``term_id``: the keys and a running index from 0, joined by bars."""
    w = W.partitionBy(*keys).orderBy(*order)
    return terms.withColumn("position", (F.row_number().over(w) - 1).cast("long")).withColumn("term_id", F.concat_ws("|", *keys, F.col("position").cast("string")))
