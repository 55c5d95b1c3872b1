"""Notes cut into sections and blocks, and medication lists, with offsets into the raw text.

Spark has no function for the positions of all matches, so one Arrow-batched function
lists them; what follows is column expressions.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import casefold, fold_marks, nfkc
from .assertions import DRUG, HISTORICAL

SPANS = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("label", T.StringType()), T.StructField("text", T.StringType())]))

# Headings of the three kinds of section, the two sides of a consultation.
PAST = r"tiền\s+sử\s+bệnh(?:\s+lý)?|tiền\s+sử\s+y\s+khoa|bệnh\s+sử\s+trước\s+đây"
PRESENT = r"tiền\s+sử\s+bệnh\s+hiện\s+tại|bệnh\s+sử(?:\s+hiện\s+tại)?|diễn\s+biến\s+bệnh\s+hiện\s+tại|quá\s+trình\s+bệnh\s+lý\s+hiện\s+tại"
VISIT = r"đánh\s+giá\s+tại\s+bệnh\s+viện|khám\s+tại\s+bệnh\s+viện|thăm\s+khám\s+tại\s+bệnh\s+viện|kết\s+quả\s+đánh\s+giá\s+ban\s+đầu|đánh\s+giá\s+ban\s+đầu"
QUESTION = r"(?:câu\s+hỏi(?:\s+(?:từ|của)\s+người\s+dùng)?(?:\s+gửi\s+đến\s+hệ\s+thống)?)[ \t]*(?::|\r?$)|hỏi[ \t]*:"
ANSWER = r"(?:câu\s+trả\s+lời\s+của\s+bác\s+s[iĩ]|bác\s+s[iĩ]\s+trả\s+lời)[ \t]*(?::|\r?$)|trả\s+lời[ \t]*:"
# Beginnings of headings by the scope they open.
SCOPES = {
    "current": r"tiền sử bệnh hiện tại|bệnh sử(?: hiện tại)?(?! gia đình| trước đây)|diễn biến(?: bệnh)?(?: hiện tại)?|quá trình bệnh lý hiện tại|lý do (?:vào|nhập) viện|thời điểm khởi phát(?: triệu chứng)?|(?:các )?triệu chứng (?:hiện tại|khi nhập viện)|đặc điểm triệu chứng|tình trạng (?:hiện tại|khi nhập viện|ngay trước khi nhập viện)|(?:đánh giá|khám|thăm khám) tại bệnh viện|kết quả đánh giá ban đầu|kết quả (?:xét nghiệm|chẩn đoán hình ảnh)|các phát hiện chẩn đoán khác",
    "family_history": r"(?:tiền sử gia đình|bệnh sử gia đình|family history)(?=$|\s*:)",
    "historical": r"tiền sử bệnh(?: lý)?|tiền sử y khoa|bệnh sử trước đây|tiền sử bản thân|tiền sử phẫu thuật|(?:các )?bệnh lý mạn tính|(?:các )?bệnh lý mãn tính|thuốc trước (?:khi )?nhập viện|danh sách thuốc trước nhập viện|(?:các )?sự kiện trước khi nhập viện|các tập (?:phát bệnh )?tương tự trước đây",
    "general": r"yếu tố nguy cơ|nguyên nhân|cơ chế|dịch tễ|tiền sử dịch tễ|chẩn đoán|tiêu chuẩn chẩn đoán|điều trị|phòng ngừa|biến chứng|không thay đổi được|có thể thay đổi|cần làm gì|lưu ý|khuyến cáo|tổng quan|định nghĩa|câu hỏi|câu trả lời|bác sĩ trả lời|trả lời|lời khuyên|chào bạn|như bạn đã mô tả|cảm ơn bạn đã gửi câu hỏi|lưu ý quan trọng",
}
TAKEN = r"(?iU)\b(?:\d+(?:[.,]\d+)?\s*(?:mg|mcg|g|ml|l|iu|đơn\s+vị)|po|iv|im|sc|sq|prn|bid|tid|qid|qhs|qam|daily)\b"
INLINE = r"(?:[.:][ \t]*|[ \t]{2,})(?P<body>(?:\d{1,2}[.)][ \t]*)?(?:tiền\s+sử\s+bệnh\s+hiện\s+tại|tiền\s+sử\s+bệnh(?:\s+lý)?|tiền\s+sử\s+phẫu\s+thuật(?:\s*/\s*thủ\s+thuật)?|thuốc\s+trước\s+(?:khi\s+)?nhập\s+viện|bệnh\s+sử(?:\s+hiện\s+tại)?|diễn\s+biến\s+bệnh|triệu\s+chứng\s+(?:hiện\s+tại|khi\s+nhập\s+viện)|tình\s+trạng\s+(?:hiện\s+tại|ngay\s+trước\s+khi\s+nhập\s+viện)|câu\s+hỏi(?:\s+từ\s+người\s+dùng)?|câu\s+trả\s+lời\s+của\s+bác\s+sĩ))"
LIST_HEADER = r"danh\s+sách\s+thuốc\s+trước\s+nhập\s+viện"
JOINED_SUFFIXES = ["trongngay", "hangngay", "moingay", "nhung", "oral", "ngay"]


def matches(pattern: str):
    """A function of a text column: all matches with offsets; the last named group gives label and span, if there is one."""
    @F.pandas_udf(SPANS)
    def of(s: pd.Series) -> pd.Series:
        rx = re.compile(pattern, re.I | re.M)

        def one(m: re.Match) -> dict:
            g = m.lastgroup if m.lastgroup and m.lastgroup == "body" else 0
            return {"start": m.start(g), "end": m.end(g), "label": m.lastgroup, "text": m.group(g)}

        return s.map(lambda x: [] if x is None else [one(m) for m in rx.finditer(x)])

    return of


HEADERS = matches(rf"^[ \t]*(?:(?:[0-9]{{1,2}}[.)])|[-•])?[ \t]*(?:(?P<past>{PAST})|(?P<present>{PRESENT})|(?P<visit>{VISIT}))(?=[ \t]*(?::|\.|•|[-–—]|\r?\n|\Z))")
LINES = matches(r"[^\r\n]+")
INLINE_HEADERS = matches(INLINE)
LIST_HEADERS = matches(LIST_HEADER)
ITEMS = matches(r"(?:^|\s)\d+\.\s+")


def consultation(raw: Column) -> Column:
    return raw.rlike(rf"(?imU)^[ \t]*(?:{QUESTION})") & raw.rlike(rf"(?imU)^[ \t]*(?:{ANSWER})")


def sections(notes: DataFrame, key: str, raw: str) -> DataFrame:
    """``(key, block, section_no, start, end, heading, body)``; ``body`` is the raw text from ``start`` to ``end``.

    Numbers: 1 past, 2 present, 3 visit, 4 a whole consultation, 0 what has no heading.
    A null text is as an empty one and gives one empty block.
    """
    text = F.coalesce(F.col(raw), F.lit(""))
    d = notes.select(key, text.alias("_t")).withColumn("_h", HEADERS("_t"))
    t, h, n = F.col("_t"), F.col("_h"), F.length("_t")
    block = lambda no, start, end, heading: F.struct(no.cast("int").alias("section_no"), start.cast("int").alias("start"), end.cast("int").alias("end"), heading.cast("string").alias("heading"))
    number = lambda x: F.when(x == "past", 1).when(x == "present", 2).otherwise(3)
    nothing = F.lit(None)
    first = F.get(h, F.lit(0))["start"]
    head = F.when(F.substring(t, F.lit(1), first).rlike(r"(?U)\S"), F.array(block(F.lit(0), F.lit(0), first, nothing))).otherwise(F.array().cast("array<struct<section_no:int,start:int,end:int,heading:string>>"))
    rest = F.transform(h, lambda x, i: block(number(x["label"]), x["start"], F.coalesce(F.get(h, i + 1)["start"], n), x["text"]))
    whole = F.array(block(F.when(consultation(t), 4).otherwise(0), F.lit(0), n, nothing))
    d = d.select(key, "_t", F.posexplode(F.when(consultation(t) | (F.size(h) == 0), whole).otherwise(F.concat(head, rest))).alias("block", "b"))
    return d.select(key, "block", "b.*", F.substring("_t", F.col("b.start") + 1, F.col("b.end") - F.col("b.start")).alias("body"))


def heading_scope(body: Column, numbered: Column) -> Column:
    """The scope a heading opens, or null; ``body`` in compatibility form and small letters."""
    t = F.regexp_replace(F.regexp_replace(F.regexp_replace(body, r"^[ \t]*[-•*]+[ \t]*", ""), r"[ \t]+", " "), r"^[ \t.:;,\-–—()\[\]{}]+|[ \t.:;,\-–—()\[\]{}]+$", "")
    out = F.when(numbered & (t != "") & ~t.rlike(TAKEN), "general")
    for name in reversed(SCOPES):
        out = F.when(t.rlike(rf"(?U)^(?:{SCOPES[name]})(?:\b|$)"), name).otherwise(out)
    return out


def scope_blocks(notes: DataFrame, key: str, raw: str) -> DataFrame:
    """``(key, start, end, kind, heading)``: stretches of a note in which mentions are historical, current, of relatives or general."""
    d = notes.select(key, F.coalesce(F.col(raw), F.lit("")).alias("_t"))
    lines = d.select(key, F.explode(LINES("_t")).alias("x")).select(key, "x.start", "x.end", F.col("x.text").alias("line"), casefold(nfkc(F.col("x.text"))).alias("c"))
    number = r"^[ \t]*\d{1,2}[.)][ \t]*"
    bare = ~F.col("c").rlike(r"^\s*[-•*]") & (F.length("c") <= 5000)
    kind = F.when(bare, heading_scope(F.regexp_replace("c", number, ""), F.col("c").rlike(number)))
    advice = F.col("c").rlike(r"(?U)^[ \t]*[-•*][ \t]*(?:(?:không\s+nên|nên|cần|hãy|khuyến\s+cáo)\b|(?:uống|thực\s+hiện|ghép|súc|chải|tái\s+khám|đi\s+khám)\b(?=.{0,180}\b(?:để|giúp|nhằm|hỗ\s+trợ|ngăn|phòng|loại\s+bỏ|khử|làm\s+dịu|tái\s+tạo)\b)|trà\s+[^:;,.]{1,80}\b(?:giúp|để|nhằm)\b)")
    lines = lines.withColumn("kind", F.when(advice, "general").otherwise(kind))
    whole = lines.where("kind IS NOT NULL").select(key, "start", "kind", F.col("line").alias("heading"))
    inline = lines.where("kind IS NULL").select(key, F.col("start").alias("base"), F.explode(INLINE_HEADERS("line")).alias("x")).where("x.start > 0")
    c = casefold(nfkc(F.col("x.text")))
    inline = inline.select(key, (F.col("base") + F.col("x.start")).alias("start"), c.alias("c"), F.col("x.text").alias("heading"))
    inline = inline.select(key, "start", heading_scope(F.regexp_replace("c", number, ""), F.col("c").rlike(number)).alias("kind"), "heading").where("kind IS NOT NULL")
    opening = d.select(key, F.lit(0).alias("start"), F.lit("unknown").alias("kind"), F.lit(None).cast("string").alias("heading"))
    every = whole.unionByName(inline).unionByName(opening).groupBy(key, "start").agg(F.min_by(F.struct("kind", "heading"), F.struct(F.col("kind") == "unknown", "heading")).alias("k"))
    ends = d.select(key, F.length("_t").alias("_n"))
    w = W.partitionBy(key).orderBy("start")
    return every.join(ends, key).select(key, "start", F.coalesce(F.lead("start").over(w), "_n").alias("end"), "k.kind", "k.heading")


def medication_list(notes: DataFrame, key: str, raw: str) -> DataFrame:
    """Drugs of the numbered list under its heading: ``(key, start, end, text, type, assertions)``; an item ends before its indication."""
    d = notes.where(F.col(raw).isNotNull()).select(key, F.col(raw).alias("_t")).where(F.col("_t").rlike(f"(?iU){LIST_HEADER}"))
    d = d.withColumn("_from", F.get(LIST_HEADERS("_t"), F.lit(0))["end"]).withColumn("_m", ITEMS("_t"))
    d = d.withColumn("_m", F.filter("_m", lambda m: m["start"] >= F.col("_from")))
    ends = F.transform("_m", lambda m, i: F.struct(m["end"].alias("start"), F.coalesce(F.get("_m", i + 1)["start"], F.length("_t")).alias("stop")))
    d = d.select(key, "_t", F.explode(ends).alias("x")).select(key, "x.start", F.regexp_replace(F.substring("_t", F.col("x.start") + 1, F.col("x.stop") - F.col("x.start")), r"(?isU)\s+điều\s+trị\s+.*$|\s+$", "").alias("text"))
    d = d.where("text <> ''")
    return d.select(key, "start", (F.col("start") + F.length("text")).alias("end"), "text", F.lit(DRUG).alias("type"), F.array(F.lit(HISTORICAL)).alias("assertions"))


def split_joined(mentions: DataFrame, lexicon: DataFrame, key: str, name: str) -> DataFrame:
    """``(key, parts)`` for names that are two names of the lexicon run together, or one with a word about taking.

    The lexicon has ``compact`` (letters and digits without marks, unique) and ``term``.
    Every cut is looked up by two equi-joins; a name that is itself in the lexicon stays whole.
    """
    m = mentions.select(key, F.regexp_replace(fold_marks(F.lower(F.col(name))), "[^a-z0-9]", "").alias("c")).where(F.length("c") >= 8)
    m = m.join(lexicon.select(F.col("compact").alias("c")), "c", "left_anti")
    cuts = m.select(key, "c", F.explode(F.sequence(F.lit(4), F.length("c") - 4)).alias("cut")).select(key, "cut", F.expr("left(c, cut)").alias("a"), F.expr("substring(c, cut + 1)").alias("b"))
    side = lambda x: lexicon.select(F.col("compact").alias(x), F.col("term").alias(x + "_term"))
    two = cuts.join(side("a"), "a").join(side("b"), "b").groupBy(key).agg(F.min_by(F.array("a_term", "b_term"), "cut").alias("parts"))
    ends = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(s).alias("s")) for i, s in enumerate(JOINED_SUFFIXES)]))
    tail = m.join(two.select(key), key, "left_anti").select(key, "c", ends.alias("e")).where(F.endswith("c", F.col("e.s"))).select(key, F.col("e.i").alias("i"), F.expr("left(c, length(c) - length(e.s))").alias("a"))
    one = tail.join(side("a"), "a").groupBy(key).agg(F.min_by(F.array("a_term"), "i").alias("parts"))
    return two.unionByName(one)
