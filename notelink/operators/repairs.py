"""Ordered repairs of the entity lists of training records, as functions over arrays.

A record has ``input_text`` and ``entities array<struct<text, type, assertions>>``.
Every rule maps a list to a list; their order shows in results and logs.  A record is
one row and nothing is shuffled.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .assertions import DISEASE, DRUG, FAMILY, HISTORICAL, NEGATED, RESULT, SYMPTOM, TEST

ENTITIES = "array<struct<text:string,type:string,assertions:array<string>>>"
# What a code, a negation, a connector, history and an absence of symptoms look like at the ends of a span.
CODE_SUFFIX = r"(?i)\s*\((?:ICD-?10\s*)?[A-Z]\d{2}(?:\.\d+)?\)\s*$"
NEGATION_PREFIX = r"(?iu)^(?:bệnh nhân bảo không bị|bệnh nhân phủ nhận|bệnh nhân khai không|chưa ghi nhận|âm tính với|phủ nhận|không thấy|không có|không còn|không bị|chưa từng|không hề|không|chưa)\s+"
CONNECTOR_SUFFIX = r"(?iu)\s+(?:khi|vì|do|sau|trước|trong)$"
HISTORY_PREFIX = r"(?iu)^(?:tiền sử|tiền căn)\s*[:\-]?\s+"
SILENT_SUFFIX = r"(?iu)\s+(?:không|chưa có)\s+(?:biểu hiện|triệu chứng)(?:\s+lâm sàng)?$"
# Cues that negate a list and those that end its reach.
SCOPE_CUE = r"không\s+(?:ghi nhận|có|thấy|bị|còn)|chưa\s+(?:ghi nhận|có|thấy)|phủ nhận|âm tính với"
SCOPE_END = r"nhưng|tuy nhiên|song|trái lại|nhập viện vì|vào viện vì|đến khám vì|hiện(?: tại)? (?:có|ghi nhận|xuất hiện)"
NO_HISTORY = r"(?iu)(?:không có|không còn|chưa từng|không hề)\s+tiền sử\s*[:\-]?\s*$"
# A test with its value, alone and as one of several.
MERGED = r"(?iu)^([A-Za-zÀ-ỹ][A-Za-zÀ-ỹ0-9\s]*?)\s+(\d[\d.,/\-]*\s*(?:g/l|mg/l|mmol/l|mg/dl|g/dl|u/l|meq/l|iu/l|ng/ml|pg/ml|mmhg|lần/phút|%)?)$"
SEGMENT = r"(?iu)^([^:;\n]+?)\s*:\s*([<>]?\s*\d[\d.,/\-]*(?:\s*[A-Za-zÀ-ỹ%+/\-]+(?:\^?\d+)?)?)$"
NOT_MERGED = r"(?iu)^nhịp\s+xoang\b"
ALLERGY = r"(?iU)^(?:dị ứng|quá mẫn)\s+(?:thuốc|dược phẩm)\b"
ENZYME_DISEASE = r"(?iu)^(?:bệnh\s+)?thiếu\s+men\s*G6PD$"

# Words for the direction of a value, marks of the past before a disease, and relatives.
DIRECTION = "tăng|giảm|cao|thấp"
PAST_MARK = r"(?iu)(?:tiền sử|tiền căn|trước đây|trước đó|đã từng|từng bị)\s*[:\-]?\s*$"
KIN = "bố|mẹ|ba|cha|anh|chị|em|ông|bà|cô|chú|bác|con|gia đình|người thân|họ hàng"

Rule = Callable[[Column, Column, Column], Column]


def entity(text: Column, kind: Column, assertions: Column) -> Column:
    return F.struct(text.alias("text"), kind.alias("type"), assertions.alias("assertions"))


def _none() -> Column:
    return F.array().cast("array<string>")


def _set(es: Column, when: Callable[[Column], Column], make: Callable[[Column], Column]) -> Column:
    return F.transform(es, lambda e: F.when(F.coalesce(when(e), F.lit(False)), make(e)).otherwise(e))


def _retext(es: Column, kinds: list[str], new: Callable[[Column], Column], also: Callable[[Column], Column] | None = None) -> Column:
    """Spans of the kinds get their new text where one is left and it differs."""
    def one(e: Column) -> Column:
        t = new(e["text"])
        return entity(t, e["type"], also(e["assertions"]) if also else e["assertions"])

    return _set(es, lambda e: e["type"].isin(kinds) & (new(e["text"]) != "") & (new(e["text"]) != e["text"]), one)


def strip_lab_assertions(es: Column, text: Column, section: Column) -> Column:
    return _set(es, lambda e: e["type"].isin(TEST, RESULT), lambda e: entity(e["text"], e["type"], _none()))


def _nth(text: Column, needle: Column, n: Column) -> Column:
    """0-based place of the n-th (from 0) occurrence in any case, or null."""
    parts = F.split(F.lower(text), F.regexp_replace(F.lower(needle), r"[^\p{L}\p{N}\s]", r"\\$0"), -1)
    at = F.aggregate(F.slice(parts, F.lit(1), n + 1), F.lit(0), lambda a, p: a + F.length(p)) + n * F.length(needle)
    return F.when(n + 1 < F.size(parts), at)


def real_case(es: Column, text: Column, section: Column) -> Column:
    """The n-th entity of a wording takes the letters of the wording's n-th place in the text."""
    def one(e: Column, i: Column) -> Column:
        n = F.size(F.filter(F.slice(es, F.lit(1), i), lambda o: F.lower(o["text"]) == F.lower(e["text"])))
        at = _nth(text, e["text"], n)
        return F.when(at.isNotNull(), entity(F.substring(text, at + 1, F.length(e["text"])), e["type"], e["assertions"])).otherwise(e)

    return F.transform(es, one)


def split_drugs(es: Column, text: Column, section: Column) -> Column:
    """Two drugs written with a slash between blanks become two, if the text has each."""
    def parts(e: Column) -> Column:
        names = F.filter(F.transform(F.split(e["text"], r"\s+/\s+"), lambda x: F.trim(x)), lambda x: x != "")
        return F.when((e["type"] == DRUG) & (F.size(names) >= 2) & F.forall(names, lambda x: F.contains(text, x)), F.transform(names, lambda x: entity(x, e["type"], e["assertions"]))).otherwise(F.array(e))

    return F.flatten(F.transform(es, parts))


def bare_result(es: Column, text: Column, section: Column) -> Column:
    """A result is its value and unit, without the word for its direction before."""
    value = rf"(?iu)^(?:{DIRECTION})(?:\s+\p{{L}}+){{0,2}}\s+([<>≤≥]?\s*\d+(?:[.,]\d+)?(?:\s*[\p{{L}}%µ]+(?:/\p{{L}}+)?)?)$"
    return _retext(es, [RESULT], lambda t: F.when(F.trim(t).rlike(value), F.trim(F.regexp_extract(F.trim(t), value, 1))).otherwise(t))


def whole_fever(es: Column, text: Column, section: Column) -> Column:
    """A fever takes the temperature that follows it: with a unit, or a number from 37.0 to 43.5."""
    degrees = r"(?iu)^((?:\s+(?:cao|nhẹ|vừa|đến|tới|lên đến|lên tới))?\s+(\d+(?:[.,]\d+)?)(\s*(?:°\s*[cf]|độ(?:\s*[cf])?))?).*"

    def one(e: Column) -> Column:
        at = F.position(F.lower(e["text"]), F.lower(text))
        tail = F.regexp_replace(F.substring(text, at + F.length(e["text"]), F.lit(40)), r"[\r\n].*", "")
        number = F.replace(F.regexp_extract(tail, degrees, 2), F.lit(","), F.lit(".")).try_cast("double")
        sound = (at > 0) & tail.rlike(degrees) & ((F.regexp_extract(tail, degrees, 3) != "") | number.between(37.0, 43.5))
        return F.when((e["type"] == SYMPTOM) & F.lower(F.trim(e["text"])).startswith("sốt") & F.coalesce(sound, F.lit(False)), entity(F.concat(F.substring(text, at, F.length(e["text"])), F.regexp_extract(tail, degrees, 1)), e["type"], e["assertions"])).otherwise(e)

    return F.transform(es, one)


def marked_history(es: Column, text: Column, section: Column, window: int = 80) -> Column:
    """A disease right after a mark of the past is historical, unless that past is denied."""
    def past(e: Column) -> Column:
        at = F.position(e["text"], text)
        first = F.greatest(at - window, F.lit(1))
        before = F.substring(text, first, at - first)
        return (at > 0) & (e["type"] == DISEASE) & ~F.array_contains(e["assertions"], HISTORICAL) & before.rlike(PAST_MARK) & ~before.rlike(NO_HISTORY)

    return _set(es, past, lambda e: entity(e["text"], e["type"], F.array_sort(F.array_union(e["assertions"], F.array(F.lit(HISTORICAL))))))


def whole_palsy(es: Column, text: Column, section: Column) -> Column:
    """The two halves of one disease's name give way to the whole, once for each place of it."""
    found = F.regexp_extract_all(text, F.lit(r"(?iU)\b(bại\s+não)\b"), F.lit(1))
    rest = F.filter(es, lambda e: ~F.lower(F.trim(e["text"])).isin("bại", "não"))
    have = F.size(F.filter(rest, lambda e: F.lower(F.trim(e["text"])) == "bại não"))
    new = F.transform(F.slice(found, have + 1, F.greatest(F.size(found) - have, F.lit(0))), lambda t: entity(t, F.lit(DISEASE), _none()))
    return F.when(F.size(found) > 0, F.concat(rest, new)).otherwise(es)


def real_family(es: Column, text: Column, section: Column, window: int = 80) -> Column:
    """Family stays only where the sentence around the span names a relative."""
    def strange(e: Column) -> Column:
        at = F.position(e["text"], text)
        first = F.greatest(at - window, F.lit(1))
        left = F.regexp_replace(F.substring(text, first, at - first), r"(?s)^.*[.\n]", "")
        right = F.regexp_replace(F.substring(text, at + F.length(e["text"]), F.lit(window)), r"(?s)[.\n].*$", "")
        return (at > 0) & F.array_contains(e["assertions"], FAMILY) & ~F.concat_ws(" ", left, right).rlike(rf"(?iU)\b(?:{KIN})\b")

    return _set(es, strange, lambda e: entity(e["text"], e["type"], F.array_remove(e["assertions"], FAMILY)))


def strip_code(es: Column, text: Column, section: Column) -> Column:
    return _retext(es, [DISEASE], lambda t: F.trim(F.regexp_replace(t, CODE_SUFFIX, "")))


def negation_leak(es: Column, text: Column, section: Column) -> Column:
    """A negation within a span becomes its assertion."""
    return _retext(es, [SYMPTOM, DISEASE], lambda t: F.trim(F.regexp_replace(t, NEGATION_PREFIX, "")), lambda a: F.array_sort(F.array_union(a, F.array(F.lit(NEGATED)))))


def trim_connector(es: Column, text: Column, section: Column) -> Column:
    return _retext(es, [SYMPTOM], lambda t: F.trim(F.regexp_replace(F.trim(t), CONNECTOR_SUFFIX, "")))


def negation_scope(es: Column, text: Column, section: Column) -> Column:
    """A negated list negates each of its spans; spans are found from left to right."""
    def step(state: Column, e: Column) -> Column:
        ahead = F.position(e["text"], text, state["cursor"] + 1)
        at = F.when(ahead > 0, ahead).otherwise(F.position(e["text"], text))
        before = F.regexp_replace(F.substring(text, F.lit(1), at - 1), r"(?s)^.*[.;\n]", "")
        cue = rf"(?isU)^.*\b(?:{SCOPE_CUE})\b(.*)$"
        covered = (at > 0) & e["type"].isin(SYMPTOM, DISEASE) & ~F.array_contains(e["assertions"], NEGATED) & before.rlike(cue) & ~F.regexp_extract(before, cue, 1).rlike(rf"(?iU)\b(?:{SCOPE_END})\b")
        new = F.when(covered, entity(e["text"], e["type"], F.array_append(e["assertions"], F.lit(NEGATED)))).otherwise(e)
        return F.struct(F.when(at > 0, at - 1 + F.length(e["text"])).otherwise(state["cursor"]).cast("int").alias("cursor"), F.array_append(state["out"], new).alias("out"))

    return F.aggregate(es, F.struct(F.lit(0).alias("cursor"), F.array().cast(ENTITIES).alias("out")), step, lambda s: s["out"])


def split_lab(es: Column, text: Column, section: Column) -> Column:
    """A result that holds names and values becomes pairs, only if every part is such a pair."""
    pair = lambda t, p: F.array(entity(F.trim(F.regexp_extract(t, p, 1)), F.lit(TEST), _none()), entity(F.trim(F.regexp_extract(t, p, 2)), F.lit(RESULT), _none()))

    def parts(e: Column) -> Column:
        segments = F.transform(F.split(e["text"], ";"), lambda x: F.trim(x))
        t, lab = F.trim(e["text"]), e["type"] == RESULT
        many = lab & (F.size(segments) >= 2) & F.forall(segments, lambda x: x.rlike(SEGMENT))
        return F.when(many, F.flatten(F.transform(segments, lambda x: pair(x, SEGMENT)))).when(lab & ~t.rlike(NOT_MERGED) & t.rlike(MERGED), pair(t, MERGED)).otherwise(F.array(e))

    return F.flatten(F.transform(es, parts))


def allergy_is_diagnosis(es: Column, text: Column, section: Column) -> Column:
    return _set(es, lambda e: (e["type"] == SYMPTOM) & F.trim(e["text"]).rlike(ALLERGY), lambda e: entity(e["text"], F.lit(DISEASE), e["assertions"]))


def enzyme_disease(es: Column, text: Column, section: Column) -> Column:
    return _set(es, lambda e: e["type"].isin(TEST, RESULT) & F.trim(e["text"]).rlike(ENZYME_DISEASE), lambda e: entity(e["text"], F.lit(DISEASE), _none()))


def diagnosis_context(es: Column, text: Column, section: Column) -> Column:
    return _retext(es, [DISEASE], lambda t: F.trim(F.regexp_replace(F.regexp_replace(F.trim(t), HISTORY_PREFIX, ""), SILENT_SUFFIX, "")))


def negated_history(es: Column, text: Column, section: Column, window: int = 20) -> Column:
    def denied(e: Column) -> Column:
        at = F.position(e["text"], text)
        first = F.greatest(at - window, F.lit(1))
        return (at > 0) & e["type"].isin(SYMPTOM, DISEASE) & F.substring(text, first, at - first).rlike(NO_HISTORY)

    return _set(es, denied, lambda e: entity(e["text"], e["type"], F.array(F.lit(NEGATED))))


def history_section(es: Column, text: Column, section: Column) -> Column:
    plain = lambda e: (section == "tien_su") & e["type"].isin(DISEASE, DRUG) & ~F.arrays_overlap(e["assertions"], F.array(F.lit(NEGATED), F.lit(HISTORICAL)))
    return _set(es, plain, lambda e: entity(e["text"], e["type"], F.array_append(e["assertions"], F.lit(HISTORICAL))))


def one_of_past_and_negated(es: Column, text: Column, section: Column) -> Column:
    both = lambda e: F.array_contains(e["assertions"], HISTORICAL) & F.array_contains(e["assertions"], NEGATED)
    return _set(es, both, lambda e: entity(e["text"], e["type"], F.array_remove(e["assertions"], HISTORICAL)))


def excess_duplicates(es: Column, text: Column, section: Column) -> Column:
    """Of equal entities as many stay as the text has occurrences; a span that the text lacks stays for the span check."""
    def stays(e: Column, i: Column) -> Column:
        allowed = (F.length(text) - F.length(F.replace(text, e["text"], F.lit("")))) / F.length(e["text"])
        same = F.size(F.filter(F.slice(es, F.lit(1), i), lambda o: (o["text"] == e["text"]) & (o["type"] == e["type"]) & (F.array_sort(o["assertions"]) == F.array_sort(e["assertions"]))))
        return (allowed == 0) | (same < allowed)

    return F.filter(es, stays)


def spans_in_text(es: Column, text: Column, section: Column) -> Column:
    return F.filter(es, lambda e: F.contains(text, e["text"]))


RULES: list[Rule] = [
    strip_lab_assertions, real_case, split_drugs, strip_code, negation_leak, trim_connector, negation_scope, bare_result, split_lab, allergy_is_diagnosis, enzyme_disease,
    diagnosis_context, whole_fever, negated_history, marked_history, whole_palsy, history_section, real_family, one_of_past_and_negated, excess_duplicates, spans_in_text,
]


def reject_reason(es: Column) -> Column:
    """Why a whole record cannot be repaired, or null."""
    return (
        F.when(es.isNull(), "no_entities").when(F.exists(es, lambda e: F.coalesce(e["text"], F.lit("")) == ""), "empty_text")
        .when(F.exists(es, lambda e: ~F.coalesce(e["type"], F.lit("")).isin(SYMPTOM, DISEASE, DRUG, TEST, RESULT)), "unknown_type")
        .when(F.exists(es, lambda e: F.exists(e["assertions"], lambda a: ~F.coalesce(a, F.lit("")).isin(NEGATED, FAMILY, HISTORICAL))), "unknown_assertion")
    )


def repaired_records(records: DataFrame, rules: list[Rule] = RULES) -> DataFrame:
    """Adds ``reason`` (null if kept) and ``log``, the rules that changed a record, in order; ``entities`` are the repaired ones.

    Columns ``input_text``, ``entities`` and ``section`` (null if unknown) are read.
    Null assertions are as none; records with a reason keep their entities.  Write the
    result before single fields of ``entities`` are selected: pruned to one field, the
    plan doubles at every rule and planning takes minutes.
    """
    es = F.transform("entities", lambda e: entity(e["text"], e["type"], F.coalesce(e["assertions"], _none())))
    d = records.withColumn("entities", es.cast(ENTITIES)).withColumn("reason", reject_reason(F.col("entities"))).withColumn("log", _none())
    ok = F.col("reason").isNull() & F.col("input_text").isNotNull()
    for rule in rules:
        d = d.withColumn("_new", F.when(ok, rule(F.col("entities"), F.col("input_text"), F.coalesce("section", F.lit("")))).otherwise(F.col("entities")))
        d = d.withColumn("log", F.when(F.col("_new") != F.col("entities"), F.array_append("log", F.lit(rule.__name__))).otherwise(F.col("log"))).withColumn("entities", F.col("_new")).drop("_new")
    return d
