"""Selection among ranked candidate codes: who may be chosen, what is certain, what a model is asked and may answer.

A mention is one row with ``text``, ``type``, ``context`` and an array of candidates in
rank order (a ranking keeps a bounded number), so nothing is shuffled: every decision
is an expression over that array.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.similarity import pair_ratios
from ..functions.text import casefold, clean_text, fold_marks
from .assertions import DISEASE, DRUG
from .disease_ranking import EDGE, code_key
from .output import tolerant_json

CANDIDATES = (
    "array<struct<code:string,name:string,level:string,score:double,dense:double,exact_source:string,exact_key:boolean,exact_term:boolean,quality:boolean,over_specific:boolean,"
    "conflicts:array<string>,coverage:double,similarity:double,mention_words:int,contained:boolean,abbreviated:boolean,technical:boolean,margin:double,part:int,parts:int,surface:string,terms:array<string>,extra:array<string>>>"
)
LEVELS = ["rejected", "weak", "medium", "strong", "exact"]
MARGIN, SHORTLIST, CONTEXT_CHARS = 0.055, 8, 320
# Single words that name no disease, heads that need a place or kind, words without meaning of their own.
UNSAFE_WORDS = ["benh", "viem", "ton", "mien", "xoang", "gan", "tuy", "da", "chi", "virus", "fibrin", "gen", "enzyme", "mau", "dich"]
UNDERSPECIFIED = r"^(?:nhoi mau|ap xe|viem cap|hoai tu(?: lan rong)?|roi loan van dong|benh tim mach|mun|khong viem|vo can|man tinh|toan bo|toan the)$"
WITHOUT_MEANING = (
    "benh hoi chung thuoc type typ khong xac dinh va hoac kem mg mcg g ml po iv im bid tid qid daily dac hieu khac chua phan loai vi tri he do cua nos unspecified other"
).split()
# Words that join two diseases in one mention.
JOINED = r"(?U)(?:\b(?:và|hoặc|kèm)\b|[+;])"


def exact_form(c: Column) -> Column:
    return F.regexp_replace(casefold(clean_text(c)), EDGE, "")


def meaning(form: Column) -> Column:
    """Distinct words of an exact form that carry meaning."""
    found = F.regexp_extract_all(fold_marks(form), F.lit("[a-z0-9]+"), F.lit(0))
    return F.array_distinct(F.filter(found, lambda w: ~w.isin(WITHOUT_MEANING) & ~w.rlike(r"^\d+$")))


def medical_abbreviation(c: Column) -> Column:
    """2 to 10 letters and digits, at least one letter, all letters upper case."""
    bare = F.regexp_replace(c, r"[^\p{L}\p{N}]", "")
    return F.length(bare).between(2, 10) & bare.rlike(r"\p{L}") & ~bare.rlike(r"[\p{L}&&[^\p{Lu}]]")


def unsafe_fragment(text: Column, form: Column, kind: Column) -> Column:
    """Why a mention must not be linked at all, or null."""
    folded = fold_marks(form)
    words = F.filter(F.regexp_extract_all(folded, F.lit("[a-z0-9]+"), F.lit(0)), lambda w: ~w.rlike(r"^\d+$"))
    open_ = (kind == DISEASE) & ~medical_abbreviation(text)
    return F.when(open_ & (F.size(words) == 1) & F.get(words, F.lit(0)).isin(UNSAFE_WORDS), "unsafe_single_token_diagnosis_fragment").when(open_ & folded.rlike(UNDERSPECIFIED), "underspecified_diagnosis_abstain")


def hard_conflict(c: Column) -> Column:
    return (F.size(F.coalesce(c["conflicts"], F.array().cast("array<string>"))) > 0) | (F.coalesce(c["level"], F.lit("")) == "rejected")


def grade(level: Column) -> Column:
    """0 for rejected up to 4 for exact; unknown levels count as weak."""
    at = F.array_position(F.array(*map(F.lit, LEVELS)), level) - 1
    return F.when(at.isNull() | (at < 0), 1).otherwise(at)


def _yes(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def supported(kind: Column, c: Column) -> Column:
    """Whether a candidate may be chosen: levels first, then exact sources, then scores with wording."""
    level = F.coalesce(c["level"], F.lit("")).isin("exact", "strong", "medium")
    dense = F.coalesce(c["dense"], c["score"], F.lit(0.0))
    by_score = ((dense >= 0.74) & (F.coalesce(c["coverage"], F.lit(0.0)) >= 0.50)) | ((dense >= 0.84) & (F.coalesce(c["similarity"], F.lit(0.0)) >= 0.48))
    disease = level | c["exact_source"].isNotNull() | _yes(c["exact_key"]) | by_score
    return ~hard_conflict(c) & F.when(kind == DISEASE, disease).when(kind == DRUG, level).otherwise(False)


def hierarchy_guard(codes: Column, kind: Column) -> Column:
    """Distinct codes; of diseases, none that lies above or below one kept before it."""
    key = code_key
    related = lambda a, b: (key(a) != key(b)) & (F.startswith(key(a), key(b)) | F.startswith(key(b), key(a)))
    kept = F.aggregate(F.array_distinct(codes), F.array().cast("array<string>"), lambda out, c: F.when(F.exists(out, lambda o: related(c, o)), out).otherwise(F.array_append(out, c)))
    return F.when(kind == DISEASE, kept).otherwise(F.array_distinct(codes))


def payload(c: Column) -> Column:
    """What a model is shown of a candidate, as JSON without empty values."""
    some = lambda a: F.when(F.size(a) > 0, a)
    true = lambda b: F.when(_yes(b), b)
    return F.to_json(F.struct(c["code"].alias("code"), c["name"].alias("name"), c["level"].alias("level"), c["score"].alias("score"), c["dense"].alias("dense"), c["exact_source"].alias("exact_source"), some(F.slice(c["terms"], 1, 4)).alias("terms"), some(F.slice(c["extra"], 1, 6)).alias("extra"), true(c["over_specific"]).alias("over_specific"), some(c["conflicts"]).alias("conflicts")))


def _decide_disease(s: Column) -> tuple[Column, Column]:
    top = F.get(s, F.lit(0))
    margin = F.coalesce(top["score"], F.lit(0.0)) - F.coalesce(F.get(s, F.lit(1))["score"], F.lit(0.0))
    over = _yes(top["over_specific"])
    shape = (F.coalesce(top["mention_words"], F.lit(0)) >= 2) & (_yes(top["contained"]) | _yes(top["abbreviated"]) | _yes(top["technical"]) | _yes(top["exact_key"]))
    source = F.coalesce(top["exact_source"], F.lit(""))
    reason = (
        F.when((source == "configured_exact_alias") | ((source == "metadata_exact_unique") & F.coalesce(top["quality"], F.lit(True))), "exact_unique_alias")
        .when(_yes(top["exact_key"]) & (source != "metadata_exact_ambiguous") & ~over, "normalized_exact")
        .when((top["level"] == "strong") & ~over & shape & ((F.size(s) == 1) | (margin >= MARGIN)), "strong_supported_margin")
        .when((F.size(s) == 1) & (top["level"] == "medium"), "single_medium_abstain").otherwise("ambiguous_supported_candidates")
    )
    return reason, F.when(reason.isin("exact_unique_alias", "normalized_exact", "strong_supported_margin"), F.array(top["code"])).otherwise(F.array().cast("array<string>"))


def _decide_drug(s: Column, limit: Column) -> tuple[Column, Column]:
    """One code for each recovered part of a fused mention, else one exact or clearly strong code."""
    parts = F.array_sort(F.transform(F.filter(s, lambda c: c["parts"].isNotNull()), lambda c: F.struct(c["part"].alias("part"), c["code"].alias("code"), c["surface"].alias("surface"), c["level"].alias("level"))))
    need = F.coalesce(F.array_max(F.transform(s, lambda c: c["parts"])), F.lit(0))
    codes = F.array_distinct(F.transform(parts, lambda p: p["code"]))
    union = (need > 0) & (need <= limit) & (F.size(codes) == need) & (F.size(F.array_distinct(F.transform(parts, lambda p: p["surface"]))) == need) & F.forall(parts, lambda p: p["level"].isin("exact", "strong"))
    top = F.get(s, F.lit(0))
    exact = F.size(F.filter(s, lambda c: c["level"] == "exact"))
    reason = (
        F.when(union, "part_union").when((top["level"] == "exact") & (exact == 1), "exact_unique").when((top["level"] == "strong") & ((F.size(s) == 1) | (F.coalesce(top["margin"], F.lit(0.0)) >= MARGIN)), "strong_margin")
        .when((F.size(s) == 1) & (top["level"] == "medium"), "single_medium_abstain").otherwise("ambiguous_supported_candidates")
    )
    return reason, F.when(union, codes).when(reason.isin("exact_unique", "strong_margin"), F.array(top["code"])).otherwise(F.array().cast("array<string>"))


def prepare(mentions: DataFrame, most: int = 2, shortlist: int = SHORTLIST) -> DataFrame:
    """Adds ``choice_limit, decided, reason, valid_codes, request_id, payloads, ask`` to rows ``(text, type, context, candidates)``.

    ``decided`` are the codes that need no model; ``ask`` says that one would have to
    choose among two valid codes or more.  A null list of candidates is empty.
    """
    none = F.array().cast("array<string>")
    names = mentions.columns
    kind = F.col("type")
    d = mentions.withColumn("_form", exact_form(F.coalesce("text", F.lit("")))).withColumn("candidates", F.coalesce("candidates", F.array().cast(CANDIDATES)))
    d = d.withColumn("_alike", pair_ratios(F.array(fold_marks(F.col("_form"))), F.transform("candidates", lambda c: fold_marks(F.lower(F.coalesce(c["name"], F.lit("")))))))
    words = meaning(F.col("_form"))
    share = lambda c: F.when(F.size(words) > 0, F.size(F.array_intersect(words, meaning_of(c["name"]))) / F.size(words)).otherwise(0.0)
    filled = F.zip_with("candidates", "_alike", lambda c, r: c.withField("coverage", F.coalesce(c["coverage"], share(c))).withField("similarity", F.coalesce(c["similarity"], r)))
    d = d.withColumn("_c", F.transform(filled, lambda c, i: F.struct(i.alias("i"), c.alias("c"))))
    exact = lambda c: F.when(kind == DISEASE, c["exact_source"].isNotNull() | _yes(c["exact_key"])).otherwise(_yes(c["exact_term"]))
    order = lambda x: F.struct(~exact(x["c"]), -grade(x["c"]["level"]), (kind == DISEASE) & _yes(x["c"]["over_specific"]), -F.coalesce(x["c"]["score"], F.lit(0.0)), -F.coalesce(x["c"]["dense"], F.lit(0.0)), x["i"].alias("i"), x["c"].alias("c"))
    ranked = F.transform(F.array_sort(F.transform(F.filter("_c", lambda x: supported(kind, x["c"])), order)), lambda x: x["c"])
    d = d.withColumn("_unsafe", unsafe_fragment(F.col("text"), F.col("_form"), kind)).withColumn("_s", ranked)
    parts = F.coalesce(F.array_max(F.transform("candidates", lambda c: c["parts"])), F.lit(0))
    limit = F.when((kind == DISEASE) & F.lit(most >= 2) & F.col("_form").rlike(JOINED), 2).when((kind == DRUG) & F.lit(most >= 2) & (parts == 2), 2).otherwise(1)
    d = d.withColumn("choice_limit", F.when(F.col("_unsafe").isNotNull(), 1).otherwise(limit))
    disease, drug = _decide_disease(F.col("_s")), _decide_drug(F.col("_s"), F.col("choice_limit"))
    shut = F.col("_unsafe").isNotNull()
    d = d.withColumn("reason", F.when(shut, F.col("_unsafe")).when(F.size("_s") == 0, "no_supported_candidate").when(kind == DISEASE, disease[0]).otherwise(drug[0]))
    d = d.withColumn("decided", F.when(shut | (F.size("_s") == 0), none).when(kind == DISEASE, disease[1]).otherwise(drug[1]))
    shown = F.slice("_s", 1, max(1, shortlist))
    d = d.withColumn("valid_codes", F.when(shut, none).otherwise(F.array_distinct(F.transform(shown, lambda c: c["code"]))))
    d = d.withColumn("payloads", F.transform("valid_codes", lambda v: payload(F.get(F.filter(shown, lambda c: c["code"] == v), F.lit(0)))))
    asked = F.concat_ws("|", kind, F.coalesce("text", F.lit("")), F.coalesce("context", F.lit("")), F.array_join("valid_codes", "|"))
    d = d.withColumn("request_id", F.when(F.size("valid_codes") > 0, F.substring(F.sha1(asked.cast("binary")), 1, 16)).otherwise(""))
    d = d.withColumn("ask", (F.size("decided") == 0) & (F.size("valid_codes") >= 2))
    return d.select(*names, "choice_limit", "decided", "reason", "valid_codes", "payloads", "request_id", "ask")


def meaning_of(name: Column) -> Column:
    """:func:`meaning` of a text in plain lower case; what runs inside array functions cannot call Python."""
    found = F.regexp_extract_all(fold_marks(F.lower(F.coalesce(name, F.lit("")))), F.lit("[a-z0-9]+"), F.lit(0))
    return F.array_distinct(F.filter(found, lambda w: ~w.isin(WITHOUT_MEANING) & ~w.rlike(r"^\d+$")))


def selector_prompt(text: Column, kind: Column, context: Column, payloads: Column, limit: Column, request_id: Column) -> Column:
    """The question to a model; of the context the last 320 characters."""
    return F.to_json(F.struct(request_id.alias("request_id"), kind.alias("type"), text.alias("mention"), F.right(F.coalesce(context, F.lit("")), F.lit(CONTEXT_CHARS)).alias("context"), limit.alias("most"), payloads.alias("candidates")))


def finish(prepared: DataFrame, answers: DataFrame) -> DataFrame:
    """Adds ``chosen`` and ``status`` from ``answers(request_id, output)``.

    An answer counts if it is an object that names its own request and chooses at most
    ``choice_limit`` codes; codes outside the shown ones go, as do those a kept code lies
    above or below.  What is no valid answer, or none, leaves the decided codes.
    """
    a = answers.groupBy("request_id").agg(F.max("output").alias("_output"))
    d = prepared.join(a, "request_id", "left")
    said = tolerant_json(F.col("_output"), "request_id string, chosen_codes array<string>")
    d = d.withColumn("_said", said)
    codes = F.coalesce(F.col("_said.chosen_codes"), F.array().cast("array<string>"))
    sound = F.coalesce(F.col("ask") & (F.col("_said.request_id") == F.col("request_id")) & F.col("_said.chosen_codes").isNotNull() & (F.size(codes) <= F.col("choice_limit")), F.lit(False))
    listed = F.filter(codes, lambda c: F.array_contains(F.col("valid_codes"), c))
    chosen = F.when(sound, hierarchy_guard(listed, F.col("type"))).otherwise(hierarchy_guard(F.col("decided"), F.col("type")))
    status = F.when(sound & (F.size("_chosen") > 0), "model").when(sound, "model_abstained").when(F.col("_output").isNotNull() & F.col("ask"), "bad_answer").when(F.size("decided") > 0, "deterministic").when(F.col("ask"), "not_answered").otherwise("abstained")
    d = d.withColumn("_chosen", F.slice(chosen, F.lit(1), F.col("choice_limit")))
    return d.withColumn("status", status).withColumn("chosen", F.col("_chosen")).drop("_output", "_said", "_chosen")
