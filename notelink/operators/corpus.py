"""The retrieval corpus of a disease classification and the clean records of a drug vocabulary.

Terms are rows from the start: preferred names and aliases are exploded once, skipped
ones keep the reason, and ids are running numbers within a code.  Nothing is looped over.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import clean_text, collapse, normalized_key, reserved_code, without_references

# Beginnings of coding notes, and of notes about the scope of a code.
NOTE_PREFIXES = ["bất kỳ tình trạng nào trong", "bất kỳ bệnh nào trong", "các tình trạng liệt kê trong", "các bệnh được liệt kê trong", "any condition in", "conditions listed in"]
SCOPE_PREFIXES = [
    "any condition listed", "any condition classified", "conditions listed", "diseases listed", "examples of the use of this category", "combination of disorders specified", "combination of conditions listed",
    "infestation classifiable to", "bất kỳ tình trạng nào liệt kê", "bất kỳ bệnh nào liệt kê", "các tình trạng liệt kê", "các bệnh được liệt kê", "ví dụ sử dụng mã này", "kết hợp các rối loạn được mô tả", "kết hợp các tình trạng liệt kê",
]
# Preferred names that replace the catalogue's.
PREFERRED = {
    "A87.1": "Viêm màng não do Adenovirus", "E63.0": "Thiếu acid béo cần thiết [EFA]", "G03.2": "Viêm màng não tái diễn lành tính [Mollaret]", "G12.0": "Teo cơ do tủy trẻ em, loại I [Werdnig - Hofman]",
    "G73.1": "Hội chứng Lambert-Eaton", "H65.9": "Viêm tai giữa không mủ, không xác định", "M09.1": "Viêm khớp trẻ em trong bệnh Crohn (viêm ruột đoạn)",
    "Y51.4": "Chất chủ vận thụ thể alpha-adrenergic, không xếp loại ở nơi khác", "Y51.5": "Chất chủ vận thụ thể beta-adrenergic, không xếp loại ở nơi khác",
    "Y51.6": "Chất đối kháng thụ thể alpha-adrenergic, không xếp loại ở nơi khác", "Y51.7": "Chất đối kháng thụ thể beta-adrenergic, không xếp loại ở nơi khác",
}
# Aliases broken by a removed reference, and four known ones.
BROKEN = [r"\bto\s+and\b", r"\band\s*,", r"specified in \.\d"]
BROKEN_EXACT = [
    "conditions classifiable to and , whether specified as rheumatic or not", "haematuria with morphological lesion specified in .0-.8 before N00.-",
    "nephropathy NOS and renal disease NOS with morphological lesion specified in .0-.8 before N00.-", "proteinuria (isolated)(orthostatic)(persistent) with morphological lesion specified in .0-.8 before N00.-",
]
# What coding notes look like in either language, words that join clauses, terms with one right translation.
NOTE_EN = [r"^conditions? (classifiable|listed|specified|described)\b", r"^diseases? (classifiable|listed|specified)\b", r"^use additional code\b", r"^code (first|also)\b", r"\bclassifiable to [A-Z]\d{2}\b", r"^the conditions? in\b"]
NOTE_VI = [
    r"^các (tình trạng|bệnh|trường hợp)(\s+\S+){0,3}\s+(liệt kê|được liệt kê|nêu|đã nêu|mô tả)\s+(trong|ở)\s+[A-Z]\d", r"^tình trạng(\s+\S+){0,3}\s+(liệt kê|nêu)\s+(trong|ở)\s+[A-Z]\d",
    r"^(sử dụng|dùng)\s+thêm\s+mã\b", r"^mã\s+hoá\s+trước\b",
]
CLAUSES = r"(?i)\b(or|and|due to|except|excluding|not classified|without)\b"
TRANSLATIONS = {"scrofuloderma": "Lao tầng (scrofuloderma)", "lupus vulgaris": "Lupus vulgaris (lao da dạng lupus)"}
# Term types of products, packs and what supports them.
PRIMARY, PACKS = ["SCD", "SBD"], ["GPCK", "BPCK"]
SUPPORT = ["IN", "PIN", "MIN", "BN", "SCDC", "SCDF", "SCDFP", "SCDG", "SCDGP", "SBDC", "SBDF", "SBDFP", "SBDG", "SBDGP"]
MODEL_SOURCE = "llm_openrouter"


def _starts(key: Column, prefixes: Sequence[str]) -> Column:
    return key.rlike("^(?:" + "|".join(prefixes) + ")")


def provisional_code(c: Column) -> Column:
    """Codes kept free for emergencies."""
    return F.upper(F.trim(c)).rlike(r"^U(?:1[3-9]|[2-4]\d)")


def coding_note(key: Column) -> Column:
    return _starts(key, NOTE_PREFIXES)


def scope_note(key: Column, term_type: Column) -> Column:
    return (term_type == "inclusion") & _starts(key, SCOPE_PREFIXES)


def broken_alias(c: Column) -> Column:
    return c.isin(BROKEN_EXACT) | c.rlike("|".join(BROKEN))


def alias_class(en: Column, vi: Column) -> Column:
    """``coding_note``, ``review`` for long or many-claused ones, else ``alias``."""
    en, vi = F.trim(F.coalesce(en, F.lit(""))), F.trim(F.coalesce(vi, F.lit("")))
    note = en.rlike("(?i)(?:" + "|".join(NOTE_EN) + ")") | vi.rlike("(?iU)(?:" + "|".join(NOTE_VI) + ")")
    words = F.size(F.filter(F.split(en, r"\s+"), lambda w: w != ""))
    clauses = F.regexp_count(en, F.lit(CLAUSES))
    return F.when(note, "coding_note").when(((words >= 9) & (clauses >= 2)) | (words >= 14), "review").otherwise("alias")


def corrected_translation(en: Column, vi: Column) -> Column:
    out = vi
    for term, right in reversed(TRANSLATIONS.items()):
        out = F.when(F.coalesce(en, F.lit("")).rlike(rf"(?i)\b{term}\b"), right).otherwise(out)
    return out


def clean_code(c: Column) -> Column:
    return F.trim(F.translate(c, "†*", ""))


def official_name(c: Column) -> Column:
    """A catalogue name without its trailing code reference."""
    token = r"[A-Z]\d{2}(?:\.[0-9A-Z]+)?[†\*]?"
    return F.trim(F.regexp_replace(F.trim(c), rf"\s*\(\s*{token}(?:\s*[,\-]\s*{token})*\s*\)\s*$", ""))


def and_group_aliases(c: Column) -> Column:
    """The base of ``base (and X)(and Y)``, base with each addition, and base with all of them."""
    more = F.transform(F.regexp_extract_all(c, F.lit(r"\(and ([^()]+)\)"), F.lit(1)), collapse)
    base = collapse(F.regexp_replace(c, r"\(and ([^()]+)\)", ""))
    n = F.size(more)
    every = F.concat(base, F.lit(", "), F.array_join(F.slice(more, F.lit(1), F.greatest(n - 1, F.lit(0))), ", "), F.lit(" and "), F.try_element_at(more, F.lit(-1)))
    out = F.concat(F.array(base), F.transform(more, lambda x: F.concat(base, F.lit(" and "), x)), F.when(n >= 2, F.array(every)).otherwise(F.array().cast("array<string>")))
    return F.filter(F.array_distinct(F.transform(out, collapse)), lambda x: x != "")


def checked_aliases(en: Column, vi: Column, source: Column) -> Column:
    """Struct of parallel arrays after correction and classification: kept pairs, notes, and why something wants review; pairs end with the shorter list."""
    n = F.least(F.size(en), F.size(vi))
    pairs = F.slice(F.arrays_zip(en.alias("en"), vi.alias("vi")), F.lit(1), n)
    pairs = F.transform(F.zip_with(F.slice(en, F.lit(1), n), F.slice(vi, F.lit(1), n), lambda a, b: F.struct(a.alias("en"), b.alias("was"), corrected_translation(a, b).alias("vi"))), lambda p: p.withField("class", alias_class(p["en"], p["vi"])))
    kept = F.filter(pairs, lambda p: p["class"] == "alias")
    flags = F.filter(F.transform(pairs, lambda p: F.when(p["class"] == "review", F.concat(F.lit("long_or_ambiguous:"), p["en"])).when((p["class"] == "alias") & (source == MODEL_SOURCE), F.concat(F.lit("llm_translated_alias_needs_spotcheck:"), p["en"]))), lambda f: f.isNotNull())
    return F.struct(
        F.transform(kept, lambda p: p["en"]).alias("aliases_en"), F.transform(kept, lambda p: p["vi"]).alias("aliases_vi"), F.transform(F.filter(pairs, lambda p: p["class"] != "alias"), lambda p: p["vi"]).alias("notes"),
        flags.alias("flags"), F.size(F.filter(pairs, lambda p: ~p["was"].eqNullSafe(p["vi"]))).alias("corrected"),
    )


def official_names(rows: DataFrame, code: str = "code", name: str = "name") -> DataFrame:
    """``(code, preferred_vi, preferred_vi_raw)``: one name a cleaned code, unmarked codes first; raw only where it differs."""
    d = rows.select(clean_code(F.col(code)).alias("code"), F.trim(name).alias("raw"), F.col(code).rlike("[†*]").alias("marked"))
    one = d.groupBy("code").agg(F.min_by("raw", F.struct("marked", "raw")).alias("raw"))
    name_ = official_name(F.col("raw"))
    return one.select("code", name_.alias("preferred_vi"), F.when(name_ != F.col("raw"), F.col("raw")).alias("preferred_vi_raw"))


def joined_names(records: DataFrame, official: DataFrame) -> DataFrame:
    """Records with their official name; those without keep what they have."""
    o = official.select("code", F.col("preferred_vi").alias("_n"), F.col("preferred_vi_raw").alias("_r"))
    d = records.join(o, "code", "left")
    got = F.col("_n").isNotNull()
    return d.withColumn("preferred_vi", F.coalesce("_n", "preferred_vi")).withColumn("preferred_vi_raw", F.col("_r")).withColumn("preferred_vi_source", F.when(got, "official").otherwise(F.col("preferred_vi_source"))).drop("_n", "_r")


def filled(records: DataFrame, found: DataFrame, key: str, once: Sequence[str], lists: Sequence[str]) -> DataFrame:
    """Left join that fills missing single values and appends distinct list values."""
    f = found.select(key, *[F.col(c).alias(f"_{c}") for c in (*once, *lists)])
    d = records.join(f, key, "left")
    for c in once:
        d = d.withColumn(c, F.coalesce(F.when(F.trim(F.col(c)) != "", F.col(c)), F.col(f"_{c}")))
    for c in lists:
        empty = F.array().cast("array<string>")
        d = d.withColumn(c, F.array_union(F.coalesce(c, empty), F.coalesce(f"_{c}", empty)))
    return d.drop(*[f"_{c}" for c in (*once, *lists)])


def repeated(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that more than one row holds; a sound table gives none."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def terms(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Terms ``(term_id, code, text, language, term_type)`` and what was skipped ``(code, language, text, reason)``.

    Records have ``code, preferred_en, preferred_vi, aliases_en, aliases_vi``.  Preferred
    names come first, then English aliases, then Vietnamese ones, which are inclusions as
    long as an English one stands in the same place.  Ids count within code, language and
    type before scope notes go, so they keep gaps.
    """
    one = lambda seq, lang, kind, text, pref: F.struct(seq.alias("seq"), F.lit(lang).alias("language"), kind.alias("term_type"), text.alias("raw"), F.lit(pref).alias("pref"))
    empty = F.array().cast("array<string>")
    en, vi = F.coalesce("aliases_en", empty), F.coalesce("aliases_vi", empty)
    fix = F.col("preferred_vi")
    for code, name in PREFERRED.items():
        fix = F.when(F.col("code") == code, name).otherwise(fix)
    listed = F.concat(
        F.array(one(F.lit(0).cast("long"), "en", F.lit("preferred"), F.col("preferred_en"), True), one(F.lit(1).cast("long"), "vi", F.lit("preferred"), fix, True)),
        F.transform(en, lambda x, i: one((i + 2).cast("long"), "en", F.lit("inclusion"), x, False)),
        F.transform(vi, lambda x, i: one((i + 2 + F.size(en)).cast("long"), "vi", F.when(i < F.size(en), "inclusion").otherwise("alias"), x, False)),
    )
    r = records.withColumn("code", collapse(F.col("code"))).where(~reserved_code(F.col("code")))
    d = r.select("code", F.explode(listed).alias("t")).select("code", "t.*").withColumn("text", without_references(clean_text(F.coalesce("raw", F.lit(""))))).withColumn("key", normalized_key(F.col("text")))
    of = W.partitionBy("code", "language")
    d = d.withColumn("_pref", F.max(F.when(F.col("pref"), F.col("key"))).over(of))
    d = d.withColumn("reason", F.when(F.col("raw").isNull(), "invalid_alias").when(F.col("text") == "", "empty").when(coding_note(F.col("key")), "coding_note").when(~F.col("pref") & (F.col("key") == F.col("_pref")), "equal_to_preferred"))
    d = d.withColumn("_turn", F.row_number().over(W.partitionBy("code", "language", "key", F.col("reason").isNull()).orderBy("seq")))
    d = d.withColumn("reason", F.when(F.col("reason").isNull() & (F.col("_turn") > 1), "repeated_within_code").otherwise(F.col("reason")))
    n = F.row_number().over(W.partitionBy("code", "language", "term_type", F.col("reason").isNull()).orderBy("seq")) - 1
    d = d.withColumn("term_id", F.when(F.col("reason").isNull(), F.concat_ws("|", "code", "language", "term_type", n.cast("string"))))
    d = d.withColumn("reason", F.when(F.col("reason").isNull() & scope_note(F.col("key"), F.col("term_type")), "scope_note").otherwise(F.col("reason")))
    return d.where("reason IS NULL").select("term_id", "code", "text", "language", "term_type"), d.where("reason IS NOT NULL").select("term_id", "code", "language", "text", "reason")


def translation_collisions(records: DataFrame) -> DataFrame:
    """``(code, key_vi, texts_en)``: Vietnamese aliases that translate two English ones or more of the same place and code."""
    n = F.least(F.size("aliases_en"), F.size("aliases_vi"))
    pairs = F.zip_with(F.slice("aliases_en", F.lit(1), n), F.slice("aliases_vi", F.lit(1), n), lambda a, b: F.struct(a.alias("en"), b.alias("vi")))
    d = records.select("code", F.posexplode(pairs).alias("at", "p")).select("code", "at", *[without_references(clean_text(F.col(f"p.{x}"))).alias(x) for x in ("en", "vi")])
    d = d.withColumn("key_vi", normalized_key(F.col("vi"))).withColumn("key_en", normalized_key(F.col("en"))).where("en <> '' AND vi <> ''").where(~coding_note(F.col("key_en")) & ~coding_note(F.col("key_vi")))
    one = d.groupBy("code", "key_vi", "key_en").agg(F.min(F.struct("at", "en")).alias("first"))
    g = one.groupBy("code", "key_vi").agg(F.array_sort(F.collect_list("first")).alias("f"))
    return g.where("size(f) > 1").select("code", "key_vi", F.transform("f", lambda x: x["en"]).alias("texts_en"))


# -- drug vocabulary ------------------------------------------------------


def attributes(rows: DataFrame, lists: Sequence[str]) -> DataFrame:
    """``(rxcui, atn, value, every)``: the first value of each attribute, and of those in ``lists`` all distinct ones in order."""
    g = rows.groupBy("rxcui", "atn", "atv").agg(F.min("line").alias("line")).groupBy("rxcui", "atn").agg(F.array_sort(F.collect_list(F.struct("line", "atv"))).alias("v"))
    return g.select("rxcui", "atn", F.col("v")[0]["atv"].alias("value"), F.when(F.col("atn").isin(list(lists)), F.transform("v", lambda x: x["atv"])).alias("every"))


def strength_struct(attrs: Column) -> Column:
    """The strength of ``map<string, string>`` attributes, or null where none is given."""
    get = lambda k: F.when(attrs[k] != "", attrs[k])
    shown = F.coalesce(get("RXN_STRENGTH"), get("RXN_AVAILABLE_STRENGTH"))
    nv, nu, dv, du = (get(f"RXN_BOSS_STRENGTH_{k}") for k in ("NUM_VALUE", "NUM_UNIT", "DENOM_VALUE", "DENOM_UNIT"))
    s = F.struct(shown.alias("display"), nv.alias("numerator_value"), nu.alias("numerator_unit"), dv.alias("denominator_value"), du.alias("denominator_unit"), F.when(F.coalesce(nv, nu).isNotNull(), "RXNSAT_BOSS").otherwise("RXNSAT").alias("source"))
    return F.when(F.coalesce(shown, nv, nu, dv, du).isNotNull(), s)


def index_tier(tty: Column, active: Column, products: Sequence[str]) -> Column:
    """Which index a concept belongs to; inactive ones are historical."""
    return F.when(~active, "historical").when(tty.isin(list(products)), "product").otherwise("support")


def candidate_priority(tty: Column, tier: Column, primary: Sequence[str] = PRIMARY, packs: Sequence[str] = PACKS, support: Sequence[str] = SUPPORT) -> Column:
    """0 for products, 1 packs, 2 support, 3 historical, 99 for what is no candidate."""
    known = tty.isin([*primary, *packs, *support])
    return F.when((tier == "historical") & known, 3).when(tier == "historical", 99).when(tty.isin(list(primary)), 0).when(tty.isin(list(packs)), 1).when(tty.isin(list(support)), 2).otherwise(99)


def concept_refs(ids: DataFrame, concepts: DataFrame, key: str = "rxcui") -> DataFrame:
    """Adds ``ref``, the struct of id, type and name; of unknown ids only the id."""
    c = concepts.select(F.col("rxcui").alias(key), F.col("tty").alias("_t"), F.col("canonical_name").alias("_n"))
    return ids.join(c, key, "left").withColumn("ref", F.struct(F.col(key).alias("rxcui"), F.col("_t").alias("tty"), F.col("_n").alias("name"))).drop("_t", "_n")


def flat_record(components: Column, dose_forms: Column, brand: Column, releases: Sequence[str]) -> Column:
    """Clean record flattened: distinct ingredients, precise ingredients, strengths, forms, releases named by the forms, brands."""
    some = lambda a: F.filter(F.array_distinct(a), lambda x: F.coalesce(x, F.lit("")) != "")
    forms = some(F.transform(dose_forms, lambda f: f["name"]))
    named = lambda r: F.exists(forms, lambda f: F.contains(F.lower(f), F.lit(r)))
    said = F.array(*[F.when(named(r), F.lit(r)) for r in releases])
    return F.struct(
        some(F.transform(components, lambda c: c["ingredient"])).alias("ingredients"), some(F.transform(components, lambda c: c["precise"])).alias("precise_ingredients"), some(F.transform(components, lambda c: c["strength"])).alias("strengths"),
        forms.alias("dose_forms"), F.array_compact(said).alias("release_types"), some(F.array(brand)).alias("brands"),
    )


def type_list(text: str, known: Sequence[str]) -> list[str]:
    """Term types of a comma-separated argument, upper case, each once; unknown ones are an error."""
    out = list(dict.fromkeys(x.strip().upper() for x in text.split(",") if x.strip()))
    wrong = [x for x in out if x not in known]
    if wrong or not out:
        raise ValueError(f"unknown term types: {wrong or text!r}")
    return out


def counts_by(df: DataFrame, *columns: str) -> DataFrame:
    """``(column, value, n)`` of several columns in one pass; arrays count each of their values."""
    def each(c: str) -> Column:
        v = F.col(c) if df.schema[c].dataType.typeName() == "array" else F.array(F.col(c))
        return F.transform(v, lambda x: F.struct(F.lit(c).alias("column"), x.cast("string").alias("value")))

    parts = [each(c) for c in columns]
    return df.select(F.explode(F.concat(*parts)).alias("x")).groupBy("x.column", "x.value").agg(F.count("*").alias("n"))
