"""Whether a mention is negated, historical or about a relative, as columns over the text before it.

Every function looks at a bounded window before the mention, so a very long note costs
no more than a short one.  Offsets are 0-based code points.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import collapse

SYMPTOM, DISEASE, DRUG, TEST, RESULT = "TRIỆU_CHỨNG", "CHẨN_ĐOÁN", "THUỐC", "TÊN_XÉT_NGHIỆM", "KẾT_QUẢ_XÉT_NGHIỆM"
HISTORICAL, NEGATED, FAMILY = "isHistorical", "isNegated", "isFamily"

# Words that are no entity, beginnings of devices, bare measurements, bare dosing.
NO_ENTITY = ["kết quả", "xét nghiệm", "thuốc", "mẫu", "dấu hiệu", "triệu chứng", "kem", "viên", "ống", "gói", "chai"]
DEVICES = ["stent", "catheter", "picc", "foley", "ống dẫn mật", "ống dẫn lưu"]
MEASURE = r"\d+(?:[.,]\d+)?\s*(?:kg|fr|tuần|week|weeks|w|mg|mcg|micrograms?|grams?|g|ml|l|iu|đơn\s+vị|units?)"
DOSING = r"(?:(?:iv|im|po|sc|sq|prn|bid|tid|qid|qhs|qam|daily|tĩnh\s+mạch|tiêm|uống|truyền|liều|giảm\s+liều|đơn\s+vị|giọt|ngày|lần|mỗi|cách)|\d+(?:[.,]\d+)?|[/x*+–-]|\s)+"
# Negation cues, phrases that carry them on, phrases that stop them, and lists they cover.
CUE = r"không|chưa|phủ\s+nhận|ko|k"
CARRIES = r"có|còn|hề|từng|hoàn\s+toàn|ghi\s+nhận|thấy|bất\s+kỳ|dấu\s+hiệu|triệu\s+chứng|biểu\s+hiện|bằng\s+chứng|tình\s+trạng|tiền\s+sử|bị|mắc|xuất\s+hiện|phải|được|coi|là|phát\s+hiện|thực\s+sự|ai|gây"
DEFICIT = r"thể|nhấc|nâng|đứng|đi|vận\s+động|cử\s+động|đáp\s+ứng|cải\s+thiện|ăn|nuốt|ngủ|nói|nghe|nhìn|thở|tự\s+chủ"
ACTION = r"nhớ|điều\s+trị|theo\s+dõi|chăm\s+sóc|được\s+(?:điều\s+trị|theo\s+dõi|chăm\s+sóc)|dùng|sử\s+dụng|uống|tiêm|truyền|tuân\s+thủ"
RESET = r"nhưng|tuy\s+nhiên|song|ngoại\s+trừ|sau\s+đó|bệnh\s+nhân|người\s+bệnh|bn|trẻ|dùng|sử\s+dụng|uống|tiêm|truyền|điều\s+trị|theo\s+dõi|chăm\s+sóc|kèm\s+theo|đồng\s+thời|rồi"
LIST_CUE = r"không\s+(?:có|ghi\s+nhận|thấy|còn)|chưa\s+(?:ghi\s+nhận|thấy|có)|phủ\s+nhận"
LEXICAL = r"không\s+(?:tự\s+chủ|đặc\s+hiệu|dung\s+nạp)"
CLASSED = r"không\s+được\s+(?:xem|coi|xếp)\s+(?:là|thành)(?:\s+một\s+loại)?"
TAKING = r"dùng|sử\s+dụng|uống|tiêm|truyền"
BUT = r"nhưng|tuy\s+nhiên|song|trong\s+khi|ngoại\s+trừ"
# Cues of the past, of the present, and of relatives.
PAST = r"trước\s+đây|đã\s+từng|từng|hồi\s+trước|cách\s+đây(?:\s+\d+)?|từ\s+năm\s+\d{2,4}|trước\s+khi\s+nhập\s+viện|trước\s+nhập\s+viện|nhập\s+viện\s+trước\s+đó|trong\s+quá\s+khứ|tiền\s+sử|sau\s+khi\s+dùng|đã\s+được\s+chẩn\s+đoán|đã\s+(?:dùng|sử\s+dụng|uống|tiêm|truyền|ngừng)"
PRESENT = r"hiện\s+tại|hiện\s+đang|hiện\s+giờ|đang|đến\s+hôm\s+nay|tới\s+hôm\s+nay|hôm\s+nay|lúc\s+này|nay|vẫn|quanh\s+năm|mọi\s+lúc|liên\s+tục|thường\s+xuyên|đang\s+có|đang\s+bị"
FAMILY_HISTORY = r"(?:tiền\s+sử|bệnh\s+sử)\s+gia\s+đình"
PATIENT = r"bệnh\s+nhân|người\s+bệnh|bn|em|tôi|bạn\s+ấy|trẻ"
RELATIVE = r"(?:mẹ|má|cha|bố|ba|ông|bà|anh\s+trai|chị\s+gái|em\s+trai|em\s+gái|anh\s+ruột|chị\s+ruột|em\s+ruột|bố\s+mẹ|cha\s+mẹ|người\s+thân)(?:\s+của\s+(?:bệnh\s+nhân|người\s+bệnh|bn|bạn\s+ấy))?(?:\s+cũng)?\s+(?:bị|mắc|có|từng|được\s+chẩn\s+đoán)"


def _word(p: str) -> str:
    return rf"(?iU)\b(?:{p})\b"


def _whole(p: str) -> str:
    return rf"(?iU)^(?:{p})$"


def _at_start(p: str) -> str:
    return rf"(?iU)^(?:{p})\b"


def entity_key(c: Column) -> Column:
    """Small letters, one space between words, no signs at either end."""
    return F.regexp_replace(F.lower(collapse(c)), r"^[\s.,;:()\[\]{}]+|[\s.,;:()\[\]{}]+$", "")


def no_entity_reason(text: Column, kind: Column) -> Column:
    """Why a span is no entity, or null."""
    t = entity_key(text)
    return (
        F.when(t.isin(NO_ENTITY), "generic_non_entity").when(t.rlike(r"(?U)^\d+$"), "isolated_number").when((kind == TEST) & t.rlike(r"^\d+(?:[./]\d+)?$"), "isolated_numeric_not_test_name")
        .when(t.rlike(_whole(MEASURE)), "isolated_measurement").when((kind == DRUG) & t.rlike(_whole(DOSING)), "dosing_without_ingredient")
        .when(kind.isin(DRUG, DISEASE) & t.rlike(f"^(?:{'|'.join(DEVICES)})"), "device_or_procedure")
    )


def linkable(text: Column, kind: Column) -> Column:
    return kind.isin(DRUG, DISEASE) & no_entity_reason(text, kind).isNull()


def _window(raw: Column, start: Column, width: int) -> Column:
    first = F.greatest(start - width, F.lit(0))
    return F.substring(raw, first + 1, start - first)


def sentence_before(raw: Column, start: Column, width: int = 360) -> Column:
    return F.lower(collapse(F.regexp_replace(_window(raw, start, width), r"(?s)^.*[\r\n;.!?]", "")))


def clause_before(raw: Column, start: Column, width: int = 220) -> Column:
    return F.lower(collapse(F.regexp_replace(_window(raw, start, width), rf"(?isU)^.*(?:[\r\n,;:.!?]|\b(?:{BUT})\b)", "")))


def negation(raw: Column, start: Column, end: Column, text: Column, kind: Column) -> Column:
    """``direct``, ``blocked``, ``submention`` or ``absent``."""
    t, before = entity_key(text), sentence_before(raw, start)
    own = F.regexp_replace(t, rf"(?iU)\b{LEXICAL}\b", "_")
    inside = own.rlike(_word(r"không|chưa|phủ\s+nhận"))
    stays = rf"không\s+(?:{DEFICIT}|{ACTION}|nghe\s+thấy|nhìn\s+thấy)"
    bracket = (F.substring(raw, start, 1) == "(") & (F.substring(raw, end + 1, 1) == ")") & (start > 0)
    outer = sentence_before(raw, start - 1)
    after_list = lambda c: F.regexp_replace(c, rf"(?iU)^.*?\b(?:{LIST_CUE})\b", "")
    segment = F.regexp_extract(before, rf"(?iU)^.*(?<!\w)((?:{CUE})\b.*)$", 1)
    lead = F.regexp_extract(before, rf"(?iU)^(.*)(?<!\w)(?:{CUE})\b.*$", 1)
    rest = F.regexp_replace(segment, rf"(?iU)^(?:{CUE})\b", "")
    n = lambda c: F.size(F.filter(F.split(c, " "), lambda w: w != ""))
    joined = segment.rlike(r"(?iU),|/|\b(?:và|hoặc|hay)\b")
    drug_stop = rf"(?:(?:không|chưa)\s+(?:{TAKING})|(?:đã\s+)?ngừng\s+(?:{TAKING})?)(?:\s+(?:bất\s+kỳ|thuốc|loại\s+thuốc))?"
    return (
        F.when(t.rlike(_at_start(rf"không\s+(?:{DEFICIT})|không\s+(?:nhìn|nghe)\s+thấy|không\s+thấy\s+gì")), "blocked")
        .when(inside & ~own.rlike(_at_start(r"không|chưa|phủ\s+nhận")), "submention")
        .when(inside & t.rlike(_at_start(stays)), "blocked").when(inside, "direct")
        .when(bracket & outer.rlike(_word(LIST_CUE)) & ~after_list(outer).rlike(_word(RESET)), "direct")
        .when(before.rlike(r"(?iU)\b(?:đã\s+)?hết(?:\s+(?:hẳn|hoàn\s+toàn))?$"), "direct")
        .when((kind == DRUG) & (before.rlike(_whole(drug_stop)) | segment.rlike(_whole(drug_stop))), "direct")
        .when(segment == "", "absent")
        .when(segment.rlike(_at_start(stays)) | rest.rlike(_word(RESET)), "blocked")
        .when(segment.rlike(_whole(rf"(?:{CUE})(?:\s+(?:{CARRIES})){{0,7}}")) | segment.rlike(_whole(CLASSED)), "direct")
        .when(segment.rlike(_word(LIST_CUE)) & joined & ~after_list(segment).rlike(_word(RESET)) & (n(after_list(segment)) <= 18), "direct")
        .when(lead.rlike(r"^[ \t\-•*]*$") & segment.rlike(_at_start("không|chưa|ko|k")) & segment.rlike(_word("và|hoặc|hay")) & (n(segment) <= 18), "direct")
        .otherwise("blocked")
    )


def about_family(raw: Column, start: Column, section: Column) -> Column:
    s = sentence_before(raw, start)
    return (F.coalesce(section, F.lit("")) == "family_history") | s.rlike(_word(RELATIVE)) | s.rlike(_word(FAMILY_HISTORY))


def history(raw: Column, start: Column, text: Column, section: Column, heading: Column | None = None) -> Column:
    """``struct<historical, current>`` by cues in the sentence and clause and by the kind of section (historical, family_history, current, general or unknown).

    Under the heading of a user's question a mention without a cue is neither.
    """
    asked = F.lit(False) if heading is None else F.coalesce(entity_key(heading).rlike("^(?:câu hỏi|hỏi)"), F.lit(False))
    s, c, kind = sentence_before(raw, start), clause_before(raw, start), F.coalesce(section, F.lit("unknown"))
    now = c.rlike(_word(PRESENT)) | entity_key(text).rlike(_word(PRESENT))
    reset = now & ~c.rlike(_word(PAST))
    family = s.rlike(_word(FAMILY_HISTORY))
    past = s.rlike(_word(PAST)) | family | c.rlike(r"(?iU)\b(?:sau|hậu)$")
    of_patient = past & (family | s.rlike(_word(PATIENT)))
    old = F.when(kind == "historical", ~reset).when(kind == "family_history", True).when(kind == "general", of_patient).otherwise(past)
    current = F.when(kind == "historical", reset).when(kind == "family_history", False).when((kind == "current") | ((kind == "general") & ~asked), now | ~old).otherwise(now)
    return F.struct(old.alias("historical"), current.alias("current"))


def repaired(entities: DataFrame) -> DataFrame:
    """Assertions by evidence; columns ``raw, start, end, text, type, section, assertions``.

    Negation and family are set anew; history is added or taken away where the evidence
    speaks and kept where it does not.  Types without assertions lose them.
    """
    raw, start = F.col("raw"), F.col("start")
    d = entities.withColumn("_neg", negation(raw, start, F.col("end"), F.col("text"), F.col("type"))).withColumn("_fam", about_family(raw, start, F.col("section"))).withColumn("_h", history(raw, start, F.col("text"), F.col("section")))
    kept = F.array_contains(F.coalesce("assertions", F.array().cast("array<string>")), HISTORICAL)
    old = F.col("_h.historical") | (kept & ~F.col("_h.current"))
    found = F.array_compact(F.array(F.when(old, HISTORICAL), F.when(F.col("_neg") == "direct", NEGATED), F.when(F.col("_fam"), FAMILY)))
    return d.withColumn("assertions", F.when(F.col("type").isin(SYMPTOM, DISEASE, DRUG), found).otherwise(F.array().cast("array<string>"))).drop("_neg", "_fam", "_h")
