"""Words with offsets, and entities placed on them.

One record is one row; functions over its text and arrays run on Arrow batches.  A
segmenter may be given as a function from a text to its words; the default cuts at
white space.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

RESYNC = 128  # characters a word may be looked for beyond its place
# Marks of tones; punctuation between letters that ends a word.
TONES = {"̀", "́", "̃", "̉", "̣"}
STUCK = re.compile(r"(?<=[^\W\d_])[.!?](?=[^\W\d_])|(?<=\S)[:;](?=\S)|(?<=\S),(?=[^\s\d])|(?<=[^\d\s]),(?=\S)")
PLACES = T.ArrayType(T.StructType().add("start", "integer").add("end", "integer"))
WORDS = T.ArrayType(T.StructType().add("text", "string").add("start", "integer").add("end", "integer"))


def without_tones(s: str) -> str:
    return unicodedata.normalize("NFC", "".join(c for c in unicodedata.normalize("NFD", s) if c not in TONES)).lower()


@F.pandas_udf(T.StringType())
def toneless(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if x is None else without_tones(x))


def placed(text: str, words: list[str], reach: int = RESYNC, strict: bool = False) -> list[tuple[str, int, int]]:
    """Words with their offsets; ``_`` stands for white space.

    A word is looked for after the last one, at most ``reach`` characters on, exactly and
    then without tones; what is not found gets no offsets (-1) and moves nothing, or
    with ``strict`` is an error.
    """
    out, at, flat = [], 0, None
    for w in words:
        pattern = re.compile(r"\s+".join(re.escape(p) for p in w.split("_") if p) or re.escape(w))
        m = pattern.search(text, at, min(len(text), at + reach + len(w)))
        if m is None:
            flat = flat if flat is not None else "".join(c if len(t := without_tones(c)) != 1 else t for c in unicodedata.normalize("NFC", text))
            if len(flat) == len(text):
                bare = re.compile(r"\s+".join(re.escape(without_tones(p)) for p in w.split("_") if p) or re.escape(w))
                m = bare.search(flat, at, min(len(text), at + reach + len(w)))
        if m is None:
            if strict:
                raise ValueError(f"{w!r} is not at {at}")
            out.append((w, -1, -1))
            continue
        out.append((w, m.start(), m.end()))
        at = m.end()
    return out


def unstuck(text: str, words: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """Punctuation stuck between letters becomes a word of its own; decimals stay whole."""
    out = []
    for w, s, e in words:
        cuts = [m.start() for m in STUCK.finditer(text[s:e])] if s >= 0 else []
        if not cuts:
            out.append((w, s, e))
            continue
        edges = sorted({0, *cuts, *(c + 1 for c in cuts), e - s})
        out += [(re.sub(r"\s+", "_", text[s + a : s + b]), s + a, s + b) for a, b in zip(edges, edges[1:]) if b > a]
    return out


def segmented(text: Column, segmenter: Callable[[str], list[str]] | None = None, strict: bool = False) -> Column:
    """``array<struct<text,start,end>>`` of a text, line by line unless ``strict``."""
    cut = segmenter or (lambda t: re.findall(r"\S+", t))

    def one(t: str | None) -> list | None:
        if t is None:
            return None
        found, base = [], 0
        for line in [t] if strict else t.splitlines(keepends=True):
            found += [(w, s + base if s >= 0 else s, e + base if e >= 0 else e) for w, s, e in placed(line, cut(line), strict=strict)]
            base += len(line)
        return [{"text": w, "start": s, "end": e} for w, s, e in unstuck(t, found)]

    @F.pandas_udf(WORDS)
    def of(s: pd.Series) -> pd.Series:
        return s.map(one)

    return of(text)


def word_range(words: Column, start: Column, end: Column) -> Column:
    """``struct<first,last>`` of the words a span overlaps, last exclusive; nulls if none."""
    at = F.filter(F.transform(words, lambda w, i: F.when((w["start"] < end) & (w["end"] > start), i)), lambda i: i.isNotNull())
    return F.struct(F.array_min(at).alias("first"), (F.array_max(at) + 1).alias("last"))


def sound_range(words: Column, first: Column, last: Column) -> Column:
    """Whether all words of a range have offsets, in order."""
    part = F.slice(words, first + 1, F.greatest(last - first, F.lit(0)))
    ordered = F.forall(F.sequence(F.lit(0), F.greatest(F.size(part) - 2, F.lit(0))), lambda i: F.coalesce(F.get(part, i + 1)["start"] >= F.get(part, i)["end"], F.lit(True)))
    return F.when((first < 0) | (last <= first) | (last > F.size(words)), False).otherwise(F.forall(part, lambda w: (w["start"] >= 0) & (w["end"] > w["start"])) & ordered)


@F.pandas_udf(PLACES)
def free_spans(text: pd.Series, surfaces: pd.Series) -> pd.Series:
    """For each surface in order its first occurrence that overlaps none taken before; null if there is none."""
    def one(t, names):
        used, out = [], []
        for x in names if names is not None else []:
            at = next(((m.start(), m.end()) for m in re.finditer(re.escape(x), t or "") if all(m.end() <= a or m.start() >= b for a, b in used)), None) if x else None
            out.append(None if at is None else {"start": at[0], "end": at[1]})
            used += [at] if at else []
        return out

    return pd.Series([one(t, n) for t, n in zip(text, surfaces, strict=True)])


def span_errors(text: Column, entities: Column, spans: Column) -> Column:
    """What is wrong with given spans, in order: length, offsets, range, order, text, and the span's own text and type."""
    pairs = F.zip_with(entities, spans, lambda e, s: F.struct(e.alias("e"), s.alias("s")))

    def wrong(p: Column, i: Column) -> Column:
        s, e = p["s"], p["e"]
        before = F.when(i > 0, F.get(spans, i - 1)["end"])
        return (
            F.when(s.isNull(), "no_span").when(s["start"].isNull() | s["end"].isNull(), "no_offsets").when(~((s["start"] >= 0) & (s["start"] < s["end"]) & (s["end"] <= F.length(text))), "out_of_range")
            .when(s["start"] < before, "out_of_order").when(F.substring(text, s["start"] + 1, s["end"] - s["start"]) != e["text"], "other_text")
            .when(F.coalesce(s["text"], e["text"]) != e["text"], "span_text_differs").when(F.coalesce(s["type"], e["type"]) != e["type"], "span_type_differs")
        )

    each = F.filter(F.transform(pairs, wrong), lambda x: x.isNotNull())
    return F.when(spans.isNull() | (F.size(spans) != F.size(entities)), F.array(F.lit("length"))).otherwise(each)


@F.pandas_udf(T.ArrayType(T.IntegerType()))
def matched_runs(entities: pd.Series, runs: pd.Series) -> pd.Series:
    """For each entity ``(start, end, type)`` the index of the free run of its type that overlaps it most, earlier first; null if none."""
    def one(es, rs):
        free, out = list(range(len(rs))), []
        for e in es:
            cost = [(min(rs[k]["end"], e["end"]) - max(rs[k]["start"], e["start"]), -k) for k in free if rs[k]["type"] == e["type"]]
            best = max((c for c in cost if c[0] > 0), default=None)
            out.append(None if best is None else -best[1])
            if best:
                free.remove(-best[1])
        return out

    return pd.Series([one(list(e), list(r)) for e, r in zip(entities, runs, strict=True)])
