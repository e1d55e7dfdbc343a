"""Detection and redaction of personal data in a text column.

Positions, priorities and splicing need one pass over a text with state, so they run as one Arrow function over batches
(compiled patterns, no row-at-a-time calls); everything about counts, mappings and keep-lists is DataFrame operations on
the spans. Nothing is shuffled but counts and mappings.
"""

from __future__ import annotations

import re
from bisect import bisect_left, insort
from itertools import chain, groupby

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from ..functions import detectors as D

SPANS = "array<struct<start:int,end:int,type:string,text:string>>"
MODES = ("label", "block", "pseudonym")
OVERLAPS = ("drop", "merge", "apart")
BLOCK = "█" * 6
#: A character that a text must have for a detector to find anything; spares most texts most scans.
_HINT = {"email": "@", "ipv6": ":", "url": "://"}
_DIGIT = re.compile("[0-9]")
_NEEDS_DIGIT = frozenset(("card", "iban", "ssn", "routing", "phone", "ipv4", "date", "uspostal", "ukpostal"))


def find_spans(text: str | None, compiled: list[tuple[D.Detector, re.Pattern]], on_overlap: str = "drop") -> list[dict]:
    """Spans in text order. Types claim in priority order; a hit on claimed characters is dropped whole, or merged into what it touches.

    apart: each type claims for itself only, and spans of several types may overlap.
    """
    if not text:
        return []
    if on_overlap == "apart":
        each = (find_spans(text, list(own)) for _, own in groupby(compiled, lambda c: c[0].id))
        return sorted(chain.from_iterable(each), key=lambda s: (s["start"], s["end"]))
    claimed: list[tuple[int, int]] = []  # sorted and disjoint
    found: dict[tuple[int, int], dict] = {}
    digit = bool(_DIGIT.search(text))
    for d, pattern in compiled:
        if d.id in _NEEDS_DIGIT and not digit or _HINT.get(d.id, "") not in text:
            continue
        for m in pattern.finditer(text):
            start, end = m.span(d.group)
            if start == end or d.check and not d.check(m[d.group]):
                continue
            at = bisect_left(claimed, (start, end))
            lo = at - 1 if at and claimed[at - 1][1] > start else at
            hi = at
            while hi < len(claimed) and claimed[hi][0] < end:
                hi += 1
            if lo < hi:
                if on_overlap != "merge":
                    continue
                old = claimed[lo:hi]
                kind = found[old[0]]["type"]
                start, end = min(start, old[0][0]), max(end, old[-1][1])
                del claimed[lo:hi]
                for key in old:
                    del found[key]
            else:
                kind = d.id
            insort(claimed, (start, end))
            found[start, end] = {"start": start, "end": end, "type": kind, "text": text[start:end]}
    return [found[key] for key in claimed]


def detect(text: Column, types=None, terms=(), on_overlap: str = "drop") -> Column:
    """Array of spans (start, end, type, text) in code points. A null or empty text has none."""
    if on_overlap not in OVERLAPS:
        raise ValueError(f"on_overlap is one of {', '.join(OVERLAPS)}")
    chosen = D.choose(types, terms)  # unknown types fail when the plan is built; tasks get the detectors by value

    @pandas_udf(SPANS)
    def run(texts: pd.Series) -> pd.Series:
        compiled = chosen.compiled()
        return texts.map(lambda t: find_spans(t, compiled, on_overlap))

    return run(text)


def keep(spans: Column, values: Column) -> Column:
    """The spans whose text isn't in an array of values that are to stay."""
    return F.filter(spans, lambda s: ~F.array_contains(values, s["text"]))


def splice(text: str | None, spans, mode: str, strict_compat: bool = False, known: dict[str, D.Detector] | None = None) -> tuple[str | None, list[dict]]:
    """The redacted text, and in pseudonym mode the mapping in order of appearance. known: the types by id."""
    if text is None:
        return None, []
    known = D.by_id() if known is None else known
    out, last, tokens, counters, mapping = [], 0, {}, {}, []
    for s in sorted(spans if spans is not None else [], key=lambda s: s["start"]):
        kind = s["type"]
        token = known[kind].token if kind in known else kind.upper()
        if mode == "block":
            put = BLOCK
        elif mode == "label":
            put = f"[{token}]"
        else:
            # One counter a token, so that two values never share a pseudonym; strict_compat counts by type.
            group = kind if strict_compat else token
            key = group, D.normalize(known.get(kind, kind), s["text"], strict_compat)
            if key not in tokens:
                counters[group] = counters.get(group, 0) + 1
                tokens[key] = f"{token}-{counters[group]}"
                mapping.append({"type": kind, "token": tokens[key], "original": s["text"]})
            put = tokens[key]
        out += [text[last : s["start"]], put]
        last = s["end"]
    out.append(text[last:])
    return "".join(out), mapping


def apply(text: Column, spans: Column, mode: str = "label", strict_compat: bool = False) -> Column:
    """Struct of text and mapping (type, token, original); spans that were taken out of the array stay in the text."""
    if mode not in MODES:
        raise ValueError(f"mode is one of {', '.join(MODES)}")

    known = D.by_id()

    @pandas_udf("text string, mapping array<struct<type:string,token:string,original:string>>")
    def run(texts: pd.Series, found: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([splice(t, s, mode, strict_compat, known) for t, s in zip(texts, found)], columns=["text", "mapping"])

    return run(text, spans)


def label_one(text: Column, pattern: str, token: str) -> Column:
    """Label mode for a single type without a check: JVM only."""
    return F.regexp_replace(text, pattern, f"[{token}]")


def counts(df: DataFrame, spans: str = "spans", by=()) -> DataFrame:
    """Spans by type (and further columns), with a total a group in the row whose type is null."""
    each = df.select(*by, F.explode(spans).alias("s")).select(*by, F.col("s.type").alias("type"))
    sets = each.groupBy(*by, "type").agg(F.count("*").alias("n"))
    total = each.groupBy(*by).agg(F.count("*").alias("n")).select(*by, F.lit(None).cast("string").alias("type"), "n")
    return sets.unionByName(total)


def verdict(spans: Column, kept: Column) -> Column:
    """What is to be said of a text: counts, "Everything kept" or "Nothing found"."""
    return F.when(F.size(kept) > 0, F.concat(F.size(kept).cast("string"), F.lit(" found"))).when(F.size(spans) > 0, "Everything kept").otherwise("Nothing found")


def mapping(df: DataFrame, applied: str = "applied", by=()) -> DataFrame:
    """The mapping rows of all texts."""
    return df.select(*by, F.explode(f"{applied}.mapping").alias("m")).select(*by, "m.type", "m.token", "m.original")
