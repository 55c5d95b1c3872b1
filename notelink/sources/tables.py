"""Sources: pipe-delimited vocabulary files, classification XML, JSON lines, notes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Used columns of each vocabulary file, by position.
LAYOUT = {
    "RXNCONSO": (18, {0: "rxcui", 1: "lat", 6: "ispref", 7: "rxaui", 11: "sab", 12: "tty", 14: "text", 16: "suppress", 17: "cvf"}),
    "RXNREL": (16, {0: "rxcui1", 4: "rxcui2", 7: "rela", 10: "sab", 14: "suppress"}),
    "RXNSAT": (13, {0: "rxcui", 8: "atn", 9: "sab", 10: "atv", 11: "suppress"}),
    "RXNSTY": (4, {0: "rxcui", 1: "tui", 3: "sty"}),
    "RXNCUI": (5, {0: "old", 4: "current"}),
    "RXNATOMARCHIVE": (16, {2: "text", 4: "created", 5: "updated", 8: "lat", 12: "old", 13: "sab", 14: "tty", 15: "merged"}),
}
# Relations and attributes that are kept.
RELATIONS = ["has_ingredient", "ingredient_of", "has_precise_ingredient", "precise_ingredient_of", "consists_of", "constitutes", "has_dose_form", "dose_form_of", "has_tradename", "tradename_of", "has_ingredients", "ingredients_of", "contains", "contained_in", "quantified_form_of", "has_quantified_form", "isa", "inverse_isa"]
ATTRIBUTES = ["RXN_STRENGTH", "RXN_AVAILABLE_STRENGTH", "RXN_BOSS_AI", "RXN_BOSS_AM", "RXN_BOSS_FROM", "RXN_BOSS_STRENGTH_NUM_VALUE", "RXN_BOSS_STRENGTH_NUM_UNIT", "RXN_BOSS_STRENGTH_DENOM_VALUE", "RXN_BOSS_STRENGTH_DENOM_UNIT", "RXN_QUANTITY", "RXN_QUALITATIVE_DISTINCTION", "RXTERM_FORM", "RXN_HUMAN_DRUG", "RXN_VET_DRUG", "RXN_ACTIVATED", "RXN_OBSOLETED"]


def read_rrf(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """The used columns of a file as strings, and ``line``, an order within the file.

    A row with too few fields fails the query.
    """
    width, names = LAYOUT[kind]
    raw = spark.read.text(path).withColumn("line", F.monotonically_increasing_id()).withColumn("f", F.split("value", r"\|", -1))
    short = F.when(F.size("f") < width, F.raise_error(F.concat(F.lit(f"malformed {kind} row: "), "value"))).otherwise(F.col("f"))
    return raw.withColumn("f", short).select("line", *[F.get("f", F.lit(i)).alias(n) for i, n in names.items()])


def atoms(conso: DataFrame) -> DataFrame:
    return conso.where("lat = 'ENG' AND sab = 'RXNORM' AND text <> ''")


def attributes(sat: DataFrame) -> DataFrame:
    return sat.where(F.col("sab").eqNullSafe("RXNORM") & F.col("atn").isin(ATTRIBUTES) & F.coalesce("suppress", F.lit("")).isin("", "N"))


def relations(rel: DataFrame, concepts: DataFrame) -> DataFrame:
    """Edges among known concepts, turned so that the source has the relation to the target."""
    known = concepts.select("rxcui", "tty")
    edges = rel.where(F.col("sab").eqNullSafe("RXNORM") & F.col("rela").isin(RELATIONS)).select("line", F.col("rxcui2").alias("source"), "rela", F.col("rxcui1").alias("target"))
    return edges.join(known.toDF("source", "source_tty"), "source").join(known.toDF("target", "target_tty"), "target")


def read_classification(spark: SparkSession, path: str) -> DataFrame:
    """``(code, parent, preferred, inclusions, exclusions)`` of the category classes of a ClaML file."""
    schema = "_code string, _kind string, SuperClass array<struct<_code string>>, Rubric array<struct<_kind string, Label array<string>>>"
    x = spark.read.format("xml").option("rowTag", "Class").schema(schema).load(path).where("_kind = 'category'")
    of = lambda kind: F.flatten(F.transform(F.filter("Rubric", lambda r: r["_kind"] == kind), lambda r: r["Label"]))
    return x.select(F.col("_code").alias("code"), F.get(F.col("SuperClass._code"), F.lit(0)).alias("parent"), F.get(of("preferred"), F.lit(0)).alias("preferred"), of("inclusion").alias("inclusions"), of("exclusion").alias("exclusions"))


def read_notes(spark: SparkSession, path: str) -> DataFrame:
    """``(record_id, text)``: whole files, line ends untouched, the file's stem as id."""
    files = spark.read.format("binaryFile").load(path)
    return files.select(F.regexp_extract("path", r"([^/]+?)(?:\.[^./]*)?$", 1).alias("record_id"), F.decode("content", "UTF-8").alias("text"))


def read_json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Typed rows; ``corrupt`` holds the text of lines that are not such objects."""
    return spark.read.schema(f"{schema}, corrupt string").option("columnNameOfCorruptRecord", "corrupt").json(path)
