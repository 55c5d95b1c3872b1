"""Ranking disease codes for mentions by wording, dense score, hierarchy and context.

Rows have ``mention_id, mention, code, term, term_type, aggregate_score,
query_variants, alias_source``; a mention has 64 codes at most, so what is gathered
for a mention is bounded.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.similarity import pair_ratios
from ..functions.text import casefold, clean_text, collapse, fold_marks, nfc

# Phrases that stand for each other.
SWAPS = [
    ("tan huyết", "tan máu"), ("tan máu", "tan huyết"), ("nhiễm khuẩn", "nhiễm trùng"), ("nhiễm trùng", "nhiễm khuẩn"),
    ("trí tuệ", "tâm thần"), ("tâm thần", "trí tuệ"), ("thiếu men", "thiếu enzyme"), ("thiếu enzyme", "thiếu men"),
]
# Words of catalogue wording.
EMPTY_WORDS = ["benh", "hoi", "chung", "do", "cua", "va", "hoac", "kem", "he", "vi", "tri", "typ", "type", "nos", "disease", "syndrome", "disorder"]
UNSPECIFIED = [
    r"\bkhong\s+(?:xac\s+dinh|dac\s+hieu|biet\s+dinh|phan\s+loai)\b", r"\bchua\s+phan\s+loai\b",
    r"\b(?:unspecified|not\s+specified|not\s+otherwise\s+specified|nos)\b",
]
# Phrases that point to chapters.
HINTS = [
    (["tăng huyết áp", "hạ huyết áp", "mạch vành", "nhồi máu cơ tim"], ["I"]), (["ổ loét", "bao tử", "viêm dạ dày", "trào ngược dạ dày"], ["K"]),
    (["đa xơ cứng", "bại não", "parkinson"], ["G"]), (["viêm cơ tim", "tràn dịch màng tim", "ngoại tâm thu", "viêm tim"], ["I"]),
    (["trầm cảm", "loạn thần", "nghiện rượu"], ["F"]), (["sốt siêu vi", "sốt phát ban", "nhiễm virus"], ["A", "B"]),
]
# Code letters that need one of some phrases, and the conflict without.
CONTEXT = [
    ("Z", ["sàng lọc", "khám", "tư vấn", "tiền sử", "theo dõi", "tình trạng", "người mang", "tiếp xúc"], "encounter_or_status_code_without_context"),
    ("O", ["mang thai", "thai", "sau đẻ", "sau sinh", "sản phụ"], "obstetric_code_without_pregnancy_context"),
    ("P", ["sơ sinh", "chu sinh", "bẩm sinh", "thai nhi"], "perinatal_code_without_neonatal_context"),
    ("VWXY", ["tai nạn", "chấn thương", "ngộ độc", "tác dụng phụ", "phản ứng có hại", "quá liều"], "external_cause_code_without_event_context"),
]
TYPE_BONUS = {"preferred": 0.012, "inclusion": 0.008, "alias": 0.006}
LEVELS = ["rejected", "weak", "medium", "strong", "exact"]
MARGIN = 0.055
EDGE = r"^[\s.,;:()\[\]{}]+|[\s.,;:()\[\]{}]+$"


def alias_key(c: Column) -> Column:
    """Composed, case folded, one space between words, no signs at either end."""
    return F.regexp_replace(casefold(clean_text(c)), EDGE, "")


def forms(key: Column) -> Column:
    """An alias key and its variants with one phrase swapped."""
    swapped = F.array_compact(F.array(*[F.when(F.contains(key, F.lit(a)), F.replace(key, F.lit(a), F.lit(b))) for a, b in SWAPS]))
    return F.filter(F.array_distinct(F.concat(F.array(key), swapped)), lambda x: x != "")


def words(key: Column) -> Column:
    """The words of an alias key that tell diseases apart, in order."""
    t = fold_marks(key)
    for p in UNSPECIFIED:
        t = F.regexp_replace(t, p, " ")
    return F.filter(F.regexp_extract_all(t, F.lit("[a-z0-9]+"), F.lit(0)), lambda w: ~w.isin(EMPTY_WORDS) & ~w.rlike(r"^\d+$"))


def abbreviation(c: Column) -> Column:
    """One word of 2 to 12 ASCII letters and digits, none of them small."""
    t = F.regexp_replace(F.trim(c), "[^A-Za-z0-9]", "")
    return ~F.trim(c).rlike(r"\s") & F.length(t).between(2, 12) & (F.upper(t) == t)


def acronyms(c: Column) -> Column:
    """Words with a digit or without small letters, lower-cased."""
    found = F.regexp_extract_all(c, F.lit("[A-Za-z0-9]+"), F.lit(0))
    return F.transform(F.filter(found, lambda w: (F.length(w) >= 2) & ((F.upper(w) == w) | w.rlike(r"\d"))), lambda w: F.lower(w))


def query_variants(df: DataFrame, mention: str, out: str = "variants") -> DataFrame:
    """Adds distinct query texts of a mention: swaps, without head or group words, brackets apart, signs as spaces, without marks."""
    names = df.columns
    d = df.select(*names, collapse(nfc(F.coalesce(F.col(mention), F.lit("")))).alias("_raw")).withColumn("_key", alias_key(F.col("_raw")))
    raw, key = F.col("_raw"), F.col("_key")
    headless = F.trim(F.regexp_replace(key, r"(?U)^(?:bệnh|hội chứng)\s+", ""))
    tailless = F.trim(F.regexp_replace(key, r"(?U)\s+(?:ở|trên|dưới)\s+(?:trẻ(?:\s+em)?|người\s+lớn|nam|nữ)$", ""))
    inside = F.regexp_extract(raw, r"\(([^()]{2,80})\)", 1)
    apart = F.when(inside != "", F.array(inside, F.trim(F.regexp_replace(raw, r"\s*\([^()]+\)\s*", " ")))).otherwise(F.array().cast("array<string>"))
    long = lambda c: F.when(F.length(c) >= 3, c)
    every = F.concat(F.array(raw), forms(key), F.array_compact(F.array(long(headless), long(tailless))), apart, F.array(collapse(F.regexp_replace(key, "[-_/]+", " ")), fold_marks(key)))
    return d.select(*names, F.filter(F.array_distinct(every), lambda x: F.length(x) >= 2).alias(out))


def lexical(df: DataFrame, mention: str, label: str, out: str = "lex") -> DataFrame:
    """Adds the struct of the best alignment over all forms of both texts; the first of equals wins."""
    names = df.columns
    d = df.select(*names, alias_key(F.coalesce(F.col(mention), F.lit(""))).alias("_m"), alias_key(F.coalesce(F.col(label), F.lit(""))).alias("_l"))
    d = d.withColumn("_mf", forms(F.col("_m"))).withColumn("_lf", forms(F.col("_l")))
    d = d.withColumn("_r", pair_ratios(F.transform("_mf", lambda x: fold_marks(x)), F.transform("_lf", lambda x: fold_marks(x))))
    short, marks = abbreviation(F.col(mention)), acronyms(F.col(mention))

    def pair(m: Column, label_form: Column) -> Column:
        a, b = words(m), words(label_form)
        x, y, fm, fl = F.array_distinct(a), F.array_distinct(b), fold_marks(m), fold_marks(label_form)
        both = F.size(F.array_intersect(x, y))
        share = lambda n: F.when(F.size(n) > 0, both / F.size(n)).otherwise(0.0)
        extra = F.array_sort(F.array_except(y, x))
        return F.struct(
            share(x).alias("mention_coverage"), share(y).alias("candidate_coverage"), extra.alias("extra"), (F.size(extra) / F.greatest(F.lit(1), F.size(y))).alias("extra_ratio"),
            (F.contains(fl, fm) | F.contains(fm, fl)).alias("contained"), ((short & (both > 0)) | F.exists(marks, lambda w: F.contains(fl, w))).alias("abbreviated"),
            ((F.size(a) >= 2) & (a == b)).alias("same_words"), F.size(a).alias("mention_words"),
        )

    pairs = F.flatten(F.transform("_mf", lambda m: F.transform("_lf", lambda x: pair(m, x))))
    d = d.withColumn("_p", F.zip_with(pairs, "_r", lambda p, r: p.withField("similarity", r)))
    worth = lambda p: 0.42 * p["mention_coverage"] + 0.24 * p["candidate_coverage"] + 0.20 * p["similarity"] + 0.08 * p["contained"].cast("int") + 0.06 * p["abbreviated"].cast("int")
    best = F.array_max(F.transform("_p", lambda p, i: F.struct(worth(p).alias("alignment"), (-i).alias("i"), p.alias("p"))))
    return d.withColumn("_b", best).select(*names, F.col("_b.p").withField("alignment", F.col("_b.alignment")).withField("same_key", F.col("_m") == F.col("_l")).alias(out))


def hard_conflicts(key: Column, code: Column, label_words: Column, mention_words: Column) -> Column:
    said = lambda phrases: key.rlike("|".join(phrases))
    found = [F.when(F.upper(code).rlike(f"^[{letters}]") & ~said(phrases), why) for letters, phrases, why in CONTEXT]
    no = F.when(F.array_contains(label_words, "khong") & ~F.array_contains(mention_words, "khong"), "negative_qualifier_not_supported_by_mention")
    return F.array_compact(F.array(*found, no))


def chapter_support(key: Column, code: Column) -> Column:
    """Whether the code lies in the chapters the wording points to; null if it points to none."""
    out = F.lit(None).cast("boolean")
    for phrases, letters in reversed(HINTS):
        out = F.when(key.rlike("|".join(phrases)), F.substring(code, 1, 1).isin(letters)).otherwise(out)
    return out


def code_key(c: Column) -> Column:
    return F.upper(F.regexp_replace(c, "[^A-Za-z0-9]", ""))


def rank_diseases(rows: DataFrame, limit: int = 10) -> DataFrame:
    """Adds support score, level and rank; the first ``limit`` codes of each mention stay."""
    if {"lex", "support_score"} & set(rows.columns):
        raise ValueError("lex and support_score are made here")
    d = lexical(rows, "mention", "term").withColumn("_key", alias_key(F.col("mention"))).withColumn("_words", words(F.col("_key")))
    x = F.col("lex")
    quality = (F.col("term_type") == "preferred") | (x["mention_words"] >= 3) | abbreviation(F.col("mention")) | (F.size(acronyms(F.col("mention"))) > 0)
    d = d.withColumn("_good", F.coalesce(quality, F.lit(False))).withColumn("exact_words", x["same_words"] & F.col("_good")).withColumn("exact_key", x["same_key"] & F.col("_good"))
    source = F.coalesce("alias_source", F.lit(""))
    unique = source == "metadata_exact_unique"
    technical = x["contained"] & (x["mention_coverage"] >= 0.90) & (x["abbreviated"] | F.col("mention").rlike(r"\d") | F.exists("_words", lambda w: F.length(w) >= 10))
    d = d.withColumn("technical", technical).withColumn("over_specific", (F.size(x["extra"]) > 0) & ~x["abbreviated"] & ~F.col("exact_key") & ~F.col("exact_words") & ~F.col("technical") & ~unique)
    d = d.withColumn("chapter_support", chapter_support(F.col("_key"), F.col("code"))).withColumn("conflicts", hard_conflicts(F.col("_key"), F.col("code"), words(alias_key(F.col("term"))), F.col("_words")))
    bonus = F.when(source == "configured_exact_alias", 0.18).when(unique & F.col("_good"), 0.14).when(source == "metadata_exact_ambiguous", 0.06).when(F.col("exact_key"), 0.10).when(F.col("exact_words"), 0.08).otherwise(0.0)
    kind = F.lit(0.0)
    for k, v in TYPE_BONUS.items():
        kind = F.when(F.col("term_type") == k, v).otherwise(kind)
    penalty = F.least(F.lit(0.16), 0.24 * x["extra_ratio"]) * F.when(x["abbreviated"], 0.20).when(F.col("technical"), 0.25).otherwise(1.0)
    total = (
        0.55 * F.col("aggregate_score") + 0.20 * x["mention_coverage"] + 0.10 * x["candidate_coverage"] + 0.08 * x["similarity"] + 0.04 * x["contained"].cast("int")
        + 0.03 * F.least(F.lit(1.0), F.col("query_variants") / 3.0) + 0.08 * x["abbreviated"].cast("int") + bonus + kind - penalty + F.when(F.col("chapter_support"), 0.015).otherwise(0.0)
    )
    d = d.withColumn("support_score", F.greatest(F.lit(0.0), F.least(F.lit(1.0), total))).withColumn("_code", code_key(F.col("code")))
    codes = F.collect_set("_code").over(W.partitionBy("mention_id"))
    d = d.withColumn("has_descendants", F.exists(codes, lambda c: F.startswith(c, F.col("_code")) & (c != F.col("_code"))))
    d = d.withColumn("support_score", F.when(F.col("has_descendants") & F.col("over_specific"), F.least(F.lit(1.0), F.col("support_score") + 0.012)).otherwise(F.col("support_score")))
    s, cover = F.col("support_score"), x["mention_coverage"]
    level = (
        F.when(F.size("conflicts") > 0, "rejected").when((source == "configured_exact_alias") | (unique & F.col("_good")) | F.col("exact_key") | F.col("exact_words"), "exact")
        .when(((s >= 0.76) & ((cover >= 0.65) | x["abbreviated"])) | (F.col("technical") & (s >= 0.70) & (cover >= 0.90)), "strong")
        .when((s >= 0.64) & ((cover >= 0.42) | (x["similarity"] >= 0.55)), "medium").otherwise("weak")
    )
    d = d.withColumn("level", level)
    grade = F.array_position(F.array(*map(F.lit, LEVELS)), F.col("level"))
    by = W.partitionBy("mention_id").orderBy(grade.desc(), s.desc(), F.col("aggregate_score").desc(), "code")
    return d.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= limit).drop("_key", "_words", "_good", "_code")
