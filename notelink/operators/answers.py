"""What a model answered: the first value in its text, whether a decision is sound, and what sound decisions do.

A record's entities, proposals and decisions are arrays of one row; decisions are held
against the entities and those added before them, in order, by a fold.
"""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .assertions import DISEASE, DRUG, FAMILY, HISTORICAL, NEGATED, RESULT, SYMPTOM, TEST

KINDS, WITH_ASSERTIONS = [SYMPTOM, DISEASE, DRUG, TEST, RESULT], [SYMPTOM, DISEASE, DRUG]
# What a decision about a proposal may say.
ADD, UNRESOLVED, CONFIDENCES, ADD_REASON = "ADD_PROPOSAL", "UNRESOLVED", ["HIGH", "MEDIUM", "LOW"], "VALID_MISSING_ENTITY"
SPAN = "array<struct<start:int,end:int,type:string>>"


def decoded(text: str | None):
    """The first object or list that can be read, inside a code fence before elsewhere; commas before a closing bracket are passed over."""
    if text is None:
        return None
    reader = json.JSONDecoder()
    for part in [*re.findall(r"```(?:json)?(.*?)```", text, re.S), text]:
        part = re.sub(r",\s*(?=[}\]])", "", part)
        at = 0
        while (m := re.compile(r"[{\[]").search(part, at)) is not None:
            try:
                return reader.raw_decode(part, m.start())[0]
            except json.JSONDecodeError:
                at = m.start() + 1
    return None


@F.pandas_udf(T.StringType())
def first_value(s: pd.Series) -> pd.Series:
    """That value as canonical JSON, or null."""
    def one(t):
        v = decoded(t)
        return None if v is None else json.dumps(v, sort_keys=True, ensure_ascii=False, separators=(",", ":"))

    return s.map(one)


def decision_error(d: Column) -> Column:
    """Why a decision ``(proposal_id, decision, type, assertions, confidence, reason_code)`` is none, or null."""
    marks = F.coalesce(d["assertions"], F.array().cast("array<string>"))
    add = d["decision"] == ADD
    return (
        F.when(F.coalesce(d["proposal_id"], F.lit("")) == "", "no_proposal_id").when(d["decision"].isNull(), "no_decision").when(d["type"].isNotNull() & ~d["type"].isin(KINDS), "unknown_type")
        .when(F.exists(marks, lambda m: ~F.coalesce(m, F.lit("")).isin(NEGATED, FAMILY, HISTORICAL)), "unknown_assertion").when(~F.coalesce(d["confidence"], F.lit("LOW")).isin(CONFIDENCES), "unknown_confidence")
        .when(add & (d["type"].isNull() | (F.coalesce(d["confidence"], F.lit("LOW")) != "HIGH") | (F.coalesce(d["reason_code"], F.lit("")) != ADD_REASON)), "add_needs_type_confidence_reason")
        .when(add & ~d["type"].isin(WITH_ASSERTIONS) & (F.size(marks) > 0), "assertions_on_other_type")
    )


def applied_decisions(raw: Column, entities: Column, proposals: Column, decisions: Column) -> Column:
    """``array<struct<proposal_id, outcome>>`` of sound decisions in order: ``added``, ``ignored``, ``unresolved``, or what forbids adding, joined by ``+``.

    ``entities`` are :data:`SPAN`; ``proposals`` have ``proposal_id, start, end, text,
    types, supported, flagged``.  A proposal counts once; an added span binds later ones.
    """
    outcome = "array<struct<proposal_id:string,outcome:string>>"
    start = F.struct(entities.cast(SPAN).alias("e"), F.array().cast("array<string>").alias("seen"), F.array().cast(outcome).alias("out"))

    def step(s: Column, d: Column) -> Column:
        p = F.get(F.filter(proposals, lambda x: x["proposal_id"] == d["proposal_id"]), F.lit(0))
        known = p.isNotNull() & ~F.array_contains(s["seen"], d["proposal_id"])
        met = F.filter(s["e"], lambda o: (p["start"] < o["end"]) & (p["end"] > o["start"]))
        same = F.exists(met, lambda o: (o["start"] == p["start"]) & (o["end"] == p["end"]) & (o["type"] == d["type"]))
        inside = F.exists(met, lambda o: (o["type"] == d["type"]) & (o["start"] <= p["start"]) & (o["end"] >= p["end"]))
        exact = (F.substring(raw, p["start"] + 1, p["end"] - p["start"]) == p["text"]) & ~p["text"].rlike(r"[\r\n]")
        wrong = F.concat_ws(
            "+", F.when(~F.array_contains(p["types"], d["type"]), "type_not_allowed"), F.when(~F.coalesce(p["supported"], F.lit(False)), "insufficient_support"), F.when(F.coalesce(p["flagged"], F.lit(False)), "structural_negative"),
            F.when(same, "duplicate").when(inside, "covered").when(F.size(met) > 0, "unsafe_overlap"), F.when(~exact, "not_exact"),
        )
        said = F.when(~known, "unknown_or_repeated").when(d["decision"] == UNRESOLVED, "unresolved").when(d["decision"] != ADD, "ignored").when(wrong != "", wrong).otherwise("added")
        new = F.struct(p["start"].cast("int").alias("start"), p["end"].cast("int").alias("end"), d["type"].alias("type"))
        return F.struct(
            F.when(said == "added", F.array_append(s["e"], new)).otherwise(s["e"]).alias("e"), F.array_append(s["seen"], d["proposal_id"]).alias("seen"),
            F.array_append(s["out"], F.struct(d["proposal_id"].alias("proposal_id"), said.alias("outcome"))).cast(outcome).alias("out"),
        )

    return F.aggregate(decisions, start, step, lambda s: s["out"])
