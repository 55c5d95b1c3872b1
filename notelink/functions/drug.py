"""Drug mentions parsed into structured evidence.

One Arrow-batched step puts the text in compatibility form; all else is column
expressions, so a table of mentions of any size is parsed in one pass without a
shuffle.  An unset part is null (scalars) or empty (arrays).

The micro sign and ``ug`` become ``mcg`` only where no letter stands before them, so
names that hold these letters stay whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import casefold, collapse, fold_marks, frequency, let, nfkc

# Drug names and their names in the vocabulary.
ALIASES = {
    "paracetamol": "acetaminophen", "natri clorid": "sodium chloride", "kali clorid": "potassium chloride", "adrenalin": "epinephrine",
    "acid acetylsalicylic": "aspirin", "senna": "sennosides", "trimetazidin": "trimetazidine", "levafloxacin": "levofloxacin",
    "nhôm hydroxid": "aluminum hydroxide", "nhom hydroxid": "aluminum hydroxide", "magie hydroxid": "magnesium hydroxide",
    "simethicon": "simethicone", "alverin": "alverine", "cotrimoxazol": "sulfamethoxazole / trimethoprim",
    "cotrimoxazole": "sulfamethoxazole / trimethoprim", "co-trimoxazole": "sulfamethoxazole / trimethoprim", "doxycyclin": "doxycycline",
}
# Dose form and release phrases in English.
PHRASES = {
    "viên nén phóng thích kéo dài": "extended release oral tablet", "viên nén giải phóng kéo dài": "extended release oral tablet",
    "viên nén phóng thích chậm": "delayed release oral tablet", "viên bao tan trong ruột": "delayed release oral tablet",
    "viên nén": "oral tablet", "viên nang": "oral capsule", "viên con nhộng": "oral capsule", "viên nhai": "chewable tablet",
    "viên ngậm dưới lưỡi": "sublingual tablet", "dung dịch uống": "oral solution", "hỗn dịch uống": "oral suspension",
    "kem bôi": "topical cream", "thuốc mỡ": "topical ointment", "dung dịch nhỏ mắt": "ophthalmic solution", "thuốc tiêm": "injection",
    "dung dịch tiêm": "injection", "dung dịch truyền": "injection", "truyền tĩnh mạch": "injection", "tiêm tĩnh mạch": "injection",
    "phóng thích kéo dài": "extended release", "giải phóng kéo dài": "extended release", "tác dụng kéo dài": "extended release",
    "phóng thích chậm": "delayed release", "bao tan trong ruột": "delayed release",
}
# Release abbreviations, single words.
ABBREVIATIONS = {"xr": "extended release", "xl": "extended release", "er": "extended release", "sr": "extended release", "cr": "controlled release"}
# Words about taking a drug that are no part of its name.
NOISE = [
    "po", "prn", "bid", "tid", "qid", "qhs", "qam", r"q\d+h", "daily", "once daily", "twice daily", "uống", r"ngày\s+\d+\s+lần", "mỗi ngày",
    "sau ăn", "trước ăn", "sáng", "tối", "khi đau",
]
# Units by spelling; those of volume give a quantity, the others a strength.
UNITS = {"mg": "MG", "g": "G", "mcg": "MCG", "ml": "ML", "l": "L", "meq": "MEQ", "iu": "IU", "unit": "UNIT", "units": "UNIT", "unt": "UNIT", "gm": "G", "gram": "G", "grams": "G"}
VOLUME = ["ML", "L"]
# Dose forms and release types.
FORMS = [
    "extended release oral tablet", "delayed release oral tablet", "oral tablet", "oral capsule", "chewable tablet", "sublingual tablet",
    "oral solution", "oral suspension", "topical cream", "topical ointment", "ophthalmic solution", "injection", "injectable solution",
]
RELEASES = ["extended release", "delayed release", "controlled release"]
# Routes by phrase and by word.
ROUTE_PHRASES = {
    "truyền tĩnh mạch": "IV", "tiêm tĩnh mạch": "IV", "đường tĩnh mạch": "IV", "tiêm bắp": "IM", "tiêm dưới da": "SC", "nhỏ mắt": "OPHTH",
    "bôi ngoài da": "TOP", "ngậm dưới lưỡi": "SL", "đường uống": "PO",
}
ROUTES = {"po": "PO", "iv": "IV", "im": "IM", "sc": "SC", "sq": "SC", "top": "TOP", "ophth": "OPHTH", "sl": "SL"}
# Words that alone name no drug.
ADMINISTRATION = [
    "thuoc", "lieu", "ngay", "tuan", "lan", "cach", "moi", "cham", "uong", "tiem", "truyen", "giot", "phut", "vien", "ong", "goi", "po", "iv",
    "im", "sc", "sq", "prn", "bid", "tid", "qid", "qhs", "qam", "daily", "oral", "injection", "x", "chai",
]
# Classes of drugs that link to no concept, without marks.
CLASSES = [
    r"(?:thuoc\s+)?khang\s+sinh", r"(?:thuoc\s+)?uc\s+che\s+mien\s+dich", r"(?:thuoc\s+)?loi\s+tieu", r"(?:thuoc\s+)?chong\s+non",
    r"(?:thuoc\s+)?chong\s+tram\s+cam", r"(?:thuoc\s+)?khang\s+histamin(?:\s+h1)?", r"corticoid(?:\s+lieu.*)?", "nsaids?",
    r"vacc?in(?:e)?(?:\s+song)?", r"intravenous\s+fluids?",
]

NUMBER, UNIT = r"\d+(?:[.,]\d+)?", r"mg|mcg|grams?|gm|g|ml|l|meq|iu|unt|units?"
RANGE = rf"({NUMBER})\s*[-–—−]\s*({NUMBER})\s*({UNIT})\b"
RATIO = rf"({NUMBER})\s*({UNIT})\s*/\s*({NUMBER})?\s*({UNIT})\b"
AMOUNT = rf"({NUMBER})\s*({UNIT})\b"
PERCENT = rf"({NUMBER})\s*%"


def _any(words) -> str:
    return "|".join(sorted(words, key=len, reverse=True))


def _in_turn(c: Column, any_of: str, rules: list[tuple[str, str]]) -> Column:
    """Replacements in turn, skipped where ``any_of``, which finds whatever one of them finds, finds nothing."""
    def every(x: Column) -> Column:
        for a, b in rules:
            x = F.regexp_replace(x, a, b)
        return x

    return let(c, lambda x: F.when(x.rlike(any_of), every(x)).otherwise(x))


def semantic(c: Column) -> Column:
    """Lower case, phrases and names in English, one space between words; ``c`` is in compatibility form."""
    out = F.concat(F.lit(" "), F.regexp_replace(F.lower(c), r"(?U)(?<!\p{L})[µμu]g\b", "mcg"), F.lit(" "))
    for a in sorted(PHRASES, key=len, reverse=True):
        out = F.replace(out, F.lit(a), F.lit(PHRASES[a]))
    out = _in_turn(out, f"(?<= )(?:{_any(ABBREVIATIONS)})(?= )", [(f"(?<= ){a}(?= )", b) for a, b in ABBREVIATIONS.items()])
    return collapse(_in_turn(out, rf"(?U)(?<!\w)(?:{_any(ALIASES)})(?!\w)", [(rf"(?U)(?<!\w){a}(?!\w)", b) for a, b in ALIASES.items()]))


def _without_noise(c: Column) -> Column:
    c = _in_turn(c, rf"(?U)\b(?:{_any(NOISE)})\b", [(rf"(?U)\b{p}\b", " ") for p in NOISE])
    return F.regexp_replace(c, r"\b(?:iv|im|sc|sq|top|ophth|sl|prn)\b", " ")


def normalized(c: Column) -> Column:
    """A query text: no words about taking, only letters, digits and ``% . / +``."""
    return collapse(F.regexp_replace(_without_noise(semantic(c)), "[^a-z0-9À-ỹ%./+]+", " "))


def name_part(c: Column) -> Column:
    """What is left of a semantic text without strengths, quantities, forms and words about taking."""
    c = _without_noise(c)
    for p in (RANGE, RATIO, AMOUNT, PERCENT, rf"\bx\s*{NUMBER}\s*(?:vien|ong|goi|lo|chai|lan|lieu)?\b", _any(FORMS), _any(RELEASES)):
        c = F.regexp_replace(c, p, " ")
    c = F.regexp_replace(c, r"(?U)\b(?:ml|l|giot|giọt|phut|phút|vien|viên|ong|ống|goi|gói|chai|x)\b", " ")
    return F.trim(F.regexp_replace(collapse(c), r"^[\s:;,.\-/()]+|[\s:;,.\-/()]+$", ""))


def meaningful(c: Column) -> Column:
    """Whether a word is left that is neither a number nor about taking a drug."""
    words = F.regexp_extract_all(fold_marks(F.lower(c)), F.lit("[a-z0-9]+"), F.lit(0))
    return F.exists(words, lambda w: ~w.isin(ADMINISTRATION) & ~w.rlike(r"^\d+$"))


def _decimal(c: Column) -> Column:
    return F.replace(c, F.lit(","), F.lit("."))


def _unit(c: Column) -> Column:
    known = F.create_map(*[F.lit(x) for kv in UNITS.items() for x in kv])
    return F.coalesce(F.try_element_at(known, F.regexp_replace(F.lower(c), "s+$", "")), F.upper(c))


def _all(c: Column, pattern: str) -> Column:
    return F.regexp_extract_all(c, F.lit(pattern), F.lit(0))


def _strengths(s: Column) -> Column:
    lo, hi, u = (F.regexp_extract(s, RANGE, k) for k in (1, 2, 3))
    rest = F.regexp_replace(s, RANGE, " ")
    ratio = lambda m, k: F.regexp_extract(m, RATIO, k)
    ratios = F.transform(_all(rest, RATIO), lambda m: F.concat(_decimal(ratio(m, 1)), F.lit(" "), _unit(ratio(m, 2)), F.lit("/"), F.when(ratio(m, 3) != "", F.concat(_decimal(ratio(m, 3)), F.lit(" "))).otherwise(""), _unit(ratio(m, 4))))
    amounts = F.transform(_all(F.regexp_replace(rest, RATIO, " "), AMOUNT), lambda m: F.struct(_decimal(F.regexp_extract(m, AMOUNT, 1)).alias("n"), _unit(F.regexp_extract(m, AMOUNT, 2)).alias("u")))
    singles = F.transform(F.filter(amounts, lambda a: ~a["u"].isin(VOLUME)), lambda a: F.concat(a["n"], F.lit(" "), a["u"]))
    plain = lambda x: F.regexp_replace((x.cast("decimal(18,6)") * 10).cast("string"), r"\.?0+$", "")
    shares = F.transform(_all(rest, PERCENT), lambda m: _decimal(F.regexp_extract(m, PERCENT, 1)))
    percents = F.flatten(F.transform(shares, lambda p: F.array(F.concat(p, F.lit(" PERCENT")), F.concat(plain(p), F.lit(" MG/ML")))))
    span = F.when(lo != "", F.array(F.concat(_decimal(lo), F.lit("-"), _decimal(hi), F.lit(" "), _unit(u)))).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.concat(span, ratios, singles, percents))


def _quantity(s: Column) -> Column:
    found = _all(F.regexp_replace(F.regexp_replace(s, RATIO, " "), RANGE, " "), rf"({NUMBER})\s*(?:ml|l)\b")
    return let(F.get(found, F.lit(0)), lambda first: F.concat(_decimal(F.regexp_extract(first, NUMBER, 0)), F.lit(" "), F.upper(F.regexp_extract(first, "[a-z]+$", 0))))


def _holding(c: Column, words: list[str]) -> Column:
    return F.filter(F.array(*[F.lit(w) for w in sorted(words, key=len, reverse=True)]), lambda w: F.contains(c, w))


def _route(text: Column, s: Column) -> Column:
    def of(folded: Column) -> Column:
        out = F.lit(None).cast("string")
        for word, r in reversed(ROUTES.items()):
            out = F.when(s.rlike(rf"\b{word}\b"), r).otherwise(out)
        for phrase in sorted(ROUTE_PHRASES, key=len):
            out = F.when(F.contains(folded, fold_marks(F.lit(phrase))), ROUTE_PHRASES[phrase]).otherwise(out)
        return out

    return let(fold_marks(F.lower(text)), of)


def strength_role(strengths: Column) -> Column:
    held = lambda mark: F.exists(strengths, lambda x: F.contains(x, F.lit(mark)))
    return F.when(F.size(strengths) == 0, "missing").when(held("PERCENT"), "percent").when(held("-"), "range").when(held("/"), "ratio").when(F.size(strengths) == 1, "single").otherwise("range")


def specificity(strengths: Column, forms: Column, route: Column) -> Column:
    s, f = F.size(strengths) > 0, F.size(forms) > 0
    return F.when(s & f, "full_product").when(s, "ingredient_strength").when(f | route.isNotNull(), "ingredient_form").otherwise("ingredient_only")


def _distinct_by_text(v: Column) -> Column:
    of = lambda u: F.filter(u, lambda x, i: (x["text"] != "") & (F.array_position(F.transform(u, lambda y: y["text"]), x["text"]) == i + 1))
    return let(v, of)


def _variants() -> Column:
    """Query texts of a parsed mention with their kind, distinct by normalized text, the first kind stays."""
    one = lambda kind, text: F.struct(normalized(text).alias("text"), F.lit(kind).alias("source"))
    given = lambda ok, *v: F.when(ok, F.array(*v)).otherwise(F.array().cast("array<struct<text:string,source:string>>"))
    core, joined, s = F.col("core"), F.array_join("components", " / "), F.col("strengths")
    both = lambda name, values, kind: F.transform(values, lambda x: one(kind, F.concat(name, F.lit(" "), x)))
    each = F.flatten(F.transform("components", lambda c: F.concat(F.array(one("ingredient_component", c)), both(c, s, "ingredient_strength"), both(c, F.col("dose_forms"), "ingredient_form"), given(F.coalesce(F.col("route").isin("IV", "IM", "SC"), F.lit(False)), one("ingredient_route_form", F.concat(c, F.lit(" injection")))))))
    many = F.size("components") >= 2
    ends = r"^([0-9.]+)-([0-9.]+)\s+(.+)$"
    first = F.get(s, F.lit(0))
    end = lambda k: F.concat(core, F.lit(" "), F.regexp_extract(first, ends, k), F.lit(" "), F.regexp_extract(first, ends, 3))
    liquid = F.array_contains("warnings", "bare_liquid_unit_without_quantity") & core.isNotNull()
    return _distinct_by_text(F.concat(
        F.array(F.struct(F.col("normalized").alias("text"), F.lit("full_normalized").alias("source"))),
        given(core.isNotNull(), one("ingredient_core", core)), each,
        given(many, one("combination_ingredients", joined)), F.when(many, both(joined, s, "combination_strength")).otherwise(given(F.lit(False), one("", F.lit("")))),
        F.transform("brands", lambda b: one("brand_hint", b)),
        given(liquid, one("liquid_form_hint", F.concat(core, F.lit(" oral solution"))), one("liquid_form_hint", F.concat(core, F.lit(" oral suspension")))),
        given((F.col("strength_role") == "range") & first.rlike(ends) & core.isNotNull(), one("range_lower_endpoint", end(1)), one("range_upper_endpoint", end(2))),
    ))


def parse_mentions(df: DataFrame, text: str, out: str = "parsed") -> DataFrame:
    """Adds ``out``, a struct of all that a mention states; a null mention is as an empty one."""
    names = [c for c in df.columns]
    d = df.select(*names, casefold(nfkc(F.coalesce(F.col(text), F.lit("")))).alias("_t")).withColumn("_s", semantic(F.col("_t")))
    s = F.col("_s")
    d = d.withColumn("strengths", _strengths(s)).withColumn("dose_forms", _holding(s, FORMS)).withColumn("quantity", _quantity(s)).withColumn("route", _route(F.col("_t"), s)).withColumn("frequency", frequency(s))
    d = d.withColumn("releases", F.filter(_holding(s, RELEASES), lambda r: ~F.exists("dose_forms", lambda f: F.contains(f, r))))
    before, after = F.split_part(s, F.lit(":"), F.lit(1)), F.when(F.contains(s, F.lit(":")), F.regexp_replace(s, "^[^:]*:", ""))
    d = d.withColumn("_b1", F.when(after.isNotNull() & meaningful(before), name_part(before))).withColumn("_src", F.when(meaningful(after), after).otherwise(s))
    inside = F.regexp_extract("_src", r"\(([^)]{3,})\)?", 1)
    lead = F.regexp_extract("_src", r"^(.*?)\([^)]{3,}", 1)
    hit = (inside != "") & meaningful(inside)
    d = d.withColumn("_b2", F.when(hit & meaningful(lead), name_part(lead))).withColumn("_src", F.when(hit, inside).otherwise(F.col("_src")))
    d = d.withColumn("_name", F.trim(F.regexp_replace(name_part(F.col("_src")), r"^(?:(?:thuốc|thuoc)(?:i\s+|\s*))+", "")))
    parts = F.transform(F.split("_name", r"(?U)\b(?:va|và|and)\b|\+|\s/\s"), lambda p: F.regexp_replace(p, r"^[ ,;:/()]+|[ ,;:/()]+$", ""))
    d = d.withColumn("_parts", F.array_distinct(F.filter(parts, meaningful)))
    d = d.withColumn("components", F.when(F.size("_parts") > 0, F.col("_parts")).when(meaningful(F.col("_name")), F.array("_name")).otherwise(F.array().cast("array<string>")))
    d = d.withColumn("brands", F.filter(F.array_distinct(F.array_compact(F.array("_b1", "_b2"))), lambda b: b != ""))
    d = d.withColumn("core", F.when(F.size("components") > 0, F.array_join("components", " / "))).withColumn("strength_role", strength_role(F.col("strengths"))).withColumn("normalized", normalized(F.col("_t")))
    folded = fold_marks(F.col("_t"))
    d = d.withColumn("warnings", F.array_compact(F.array(
        F.when(s.rlike(r"(?<!\d)\b(?:ml|l)\b") & F.col("quantity").isNull(), "bare_liquid_unit_without_quantity"),
        F.when(fold_marks(F.col("core")).rlike(f"^(?:{'|'.join(CLASSES)})$"), "generic_drug_class"),
        F.when(folded.rlike(r"\b(?:khong|without|free)\b.{0,24}\b(?:caffeine|thuoc|drug)\b"), "negated_or_excluded_ingredient"),
        F.when(F.size("components") == 0, "missing_ingredient"), F.when(F.size("components") >= 2, "multi_ingredient_mention"),
    )))
    d = d.withColumn("specificity", specificity(F.col("strengths"), F.col("dose_forms"), F.col("route"))).withColumn("variants", _variants())
    fields = ["normalized", "core", "components", "brands", "strengths", "strength_role", "dose_forms", "releases", "quantity", "route", F.col("frequency.code").alias("frequency"), F.col("frequency.hours").alias("interval_hours"), "warnings", "specificity", "variants"]
    return d.select(*names, F.struct(*fields).alias(out))


def pack_quantity(name: Column, item: Column) -> Column:
    """How many of ``item`` a pack's name states before the bracket that opens with it."""
    before = F.split_part(name, F.concat(F.lit("("), item), F.lit(1))
    return F.when(F.contains(name, F.concat(F.lit("("), item)), F.regexp_extract(before, r"(\d+(?:\.\d+)?)\s*$", 1).try_cast("double"))
