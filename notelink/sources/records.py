"""Scans that check what they read, and sinks that can stop and go on."""

from __future__ import annotations

import re
import xml.etree.ElementTree as ET
from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

_LABEL = T.StructType().add("kind", "string").add("text", "string").add("raw", "string").add("references", T.ArrayType(T.StringType()))
_CLASS = T.StructType().add("code", "string").add("kind", "string").add("parent", "string").add("labels", T.ArrayType(_LABEL))
LANGUAGE = "{http://www.w3.org/XML/1998/namespace}lang"


def flat_label(label: ET.Element) -> tuple[str, str, list[str]]:
    """Text without references, text with them in brackets, and the references, in document order."""
    clean, raw, refs = [], [], []

    def walk(e: ET.Element) -> None:
        for part in (e.text,):
            clean.append(part or "")
            raw.append(part or "")
        for child in e:
            if child.tag.rsplit("}", 1)[-1] == "Reference":
                code = " ".join("".join(child.itertext()).split())
                refs.extend([code] if code else [])
                raw.append(f" ({code})")
            else:
                walk(child)
            clean.append(child.tail or "")
            raw.append(child.tail or "")

    walk(label)
    listed = any(x.tag.rsplit("}", 1)[-1] == "Fragment" for x in label.iter())
    tidy = lambda parts: " ".join((re.sub(r":\s+", " ", "".join(parts)) if listed else "".join(parts)).split())
    return tidy(clean), tidy(raw), refs


def read_classes(spark: SparkSession, path: str, language: str = "en") -> DataFrame:
    """``(code, kind, parent, labels)`` of a classification file, mixed content in order.

    The file is split at the ends of its classes, so it is read in parallel; labels of
    other languages are left out, those of no language stay.
    """
    def one(x: str) -> dict | None:
        at = x.find("<Class")
        if at < 0:
            return None
        c = ET.fromstring(x[at:] + "</Class>")
        up, labels = None, []
        for e in c:
            tag = e.tag.rsplit("}", 1)[-1]
            if tag == "SuperClass":
                up = up or e.get("code")
            if tag == "Rubric":
                for label in e:
                    if label.tag.rsplit("}", 1)[-1] == "Label" and label.get(LANGUAGE, language) == language:
                        text, raw, refs = flat_label(label)
                        labels.append({"kind": e.get("kind"), "text": text, "raw": raw, "references": refs})
        return {"code": c.get("code"), "kind": c.get("kind"), "parent": up, "labels": labels}

    @F.pandas_udf(_CLASS)
    def parsed(s: pd.Series) -> pd.DataFrame:
        rows = [one(x) or dict.fromkeys(_CLASS.names) for x in s]
        return pd.DataFrame(rows, columns=_CLASS.names)

    text = spark.read.option("lineSep", "</Class>").text(path)
    return text.select(parsed("value").alias("c")).select("c.*").where("code IS NOT NULL")


def sampled(df: DataFrame, n: int, seed: int, *keys: str) -> DataFrame:
    """``n`` distinct rows (of each key) in the order of a seeded hash: the same ones on every run."""
    d = df.distinct()
    order = F.xxhash64(F.lit(seed), *d.columns)
    if not keys:
        return d.orderBy(order).limit(n)
    return d.withColumn("_r", F.row_number().over(W.partitionBy(*keys).orderBy(order))).where(F.col("_r") <= n).drop("_r")


def read_table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A CSV file with a header; quoted fields may hold line ends."""
    return spark.read.schema(schema).csv(path, header=True, multiLine=True, escape='"')


def numbered_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Objects of a JSON lines file with their line number from 1; ``error`` says why a line is none."""
    raw = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", "\r?\n")).alias("at", "line")).where("trim(line) <> ''")
    parsed = F.from_json("line", f"{schema}, _corrupt string", {"columnNameOfCorruptRecord": "_corrupt", "mode": "PERMISSIVE"})
    d = raw.select((F.col("at") + 1).alias("line_no"), "line", parsed.alias("record"))
    object_ = F.trim("line").startswith("{")
    return d.withColumn("error", F.when(~object_, "not an object").when(F.col("record._corrupt").isNotNull(), "not valid")).withColumn("record", F.when(F.col("error").isNull(), F.col("record").dropFields("_corrupt")))


def sound_entities(saved: DataFrame, notes: DataFrame) -> DataFrame:
    """Saved ``(record_id, start, end, text, ...)`` with ``error`` where the note lacks that text at that place, or is missing."""
    d = saved.join(notes.select("record_id", F.col("text").alias("_raw")), "record_id", "left")
    there = (F.col("start") >= 0) & (F.col("start") < F.col("end")) & (F.substring("_raw", F.col("start") + 1, F.col("end") - F.col("start")) == F.col("text"))
    return d.withColumn("error", F.when(F.col("_raw").isNull(), "missing_note").when(~there, "text_moved")).drop("_raw")


def locked(artifacts: DataFrame, notes: DataFrame) -> DataFrame:
    """Artifacts whose note still has the text they were made from, by its digest."""
    now = notes.select("record_id", F.sha2(F.col("text").cast("binary"), 256).alias("raw_sha256"))
    return artifacts.join(now, ["record_id", "raw_sha256"], "left_semi")


def index_metadata(rows: DataFrame, allowed: Sequence[str]) -> DataFrame:
    """Metadata by place: a vector id that is not its line's place fails the query; types not allowed lose their text but keep their place."""
    at = F.when(F.col("vector_id") != F.col("place"), F.raise_error(F.concat(F.lit("vector id differs at "), F.col("place").cast("string")))).otherwise(F.col("vector_id"))
    return rows.select(at.alias("vector_id"), "tty", F.when(F.col("tty").isin(list(allowed)), F.col("text")).alias("text"))


def numbered_parts(text: Column) -> Column:
    """A text cut before the lines that begin with a number and a capital."""
    return F.split(text, r"\n(?=\d+\.\s+\p{Lu})")


def natural_order(name: Column) -> Column:
    """A key by which ``note2`` stands before ``note10``: the numbers of a name, then the name."""
    digits = F.transform(F.regexp_extract_all(name, F.lit(r"\d+"), F.lit(0)), lambda x: x.cast("decimal(38,0)"))
    return F.struct(F.regexp_replace(name, r"\d+", "#").alias("shape"), digits.alias("numbers"), name.alias("name"))


def isolated(notes: DataFrame, work: Callable[[str], str]) -> DataFrame:
    """``(record_id, result, error)``: a note on which the work fails gives its error and stops no other."""
    def one(t: str | None) -> dict:
        try:
            return {"result": work(t), "error": None}
        except Exception as e:  # the row carries it
            return {"result": None, "error": f"{type(e).__name__}: {e}"}

    @F.pandas_udf(T.StructType().add("result", "string").add("error", "string"))
    def of(s: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([one(t) for t in s], columns=["result", "error"])

    return notes.select("record_id", of("text").alias("r")).select("record_id", "r.*")


def fingerprint(parts: dict[str, Column]) -> Column:
    """The SHA-256 of parts as canonical JSON: keys sorted, no white space."""
    return F.sha2(F.to_json(F.struct(*[parts[k].alias(k) for k in sorted(parts)]), {"ignoreNullFields": "false"}).cast("binary"), 256)


def resumed(records: DataFrame, path: str, work: Callable[[DataFrame], DataFrame], keys: Sequence[str]) -> DataFrame:
    """All results at ``path`` after the missing ones are made and appended; a run that stopped goes on where it was.

    Each run appends one committed job, so a half-written one is never read.
    """
    spark = records.sparkSession
    fs = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    old = fs.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(fs)
    todo = records.join(spark.read.parquet(path).select(*keys), list(keys), "left_anti") if old else records
    work(todo).write.mode("append").parquet(path)
    return spark.read.parquet(path)


def repaired_lines(df: DataFrame, change: Callable[[DataFrame], DataFrame], path: str, audit: bool) -> DataFrame:
    """Rows ``(key, before, after)`` that a repair would change; unless ``audit`` the repaired rows are written to ``path``, never over their source."""
    new = change(df)
    if not audit:
        new.write.mode("overwrite").json(path)
    return df.join(new.withColumnRenamed("text", "after"), "key").where(~F.col("text").eqNullSafe(F.col("after"))).select("key", F.col("text").alias("before"), "after")
