"""The few functions no built-in expresses, Arrow-batched."""

from __future__ import annotations

import ast
import json
import re
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _load(text: str) -> object:
    try:
        return json.loads(text)
    except ValueError:
        try:
            return ast.literal_eval(text)
        except (ValueError, SyntaxError, RecursionError, MemoryError):
            return None


def _groups(text: str) -> tuple[list[tuple[int, int, int]], list[int]]:
    """((start, end, depth) of every closed bracket group, the starts of those left open), brackets within double quotes apart."""
    closed, open_, quoted, skip = [], [], False, False
    for at, c in enumerate(text):
        if skip:
            skip = False
        elif c == "\\":
            skip = quoted
        elif c == '"':
            quoted = not quoted
        elif not quoted and c in "[{":
            open_.append(at)
        elif not quoted and c in "]}" and open_ and text[open_[-1]] + c in ("[]", "{}"):
            closed.append((open_.pop(), at + 1, len(open_)))
    return closed, open_


def read_answer(text: str | None) -> object:
    """The first JSON value, or Python literal, in a model's answer, fences dropped: the first bracket group that reads as one; where a list was cut off, the whole
    objects directly in it; where nothing reads, an empty list if the answer says that there is nothing, else None."""
    if not text:
        return None
    bare = re.sub(r"```(?:json)?", "", text, flags=re.IGNORECASE)
    closed, left_open = _groups(bare)
    listed = [at for at in left_open if bare[at] == "["]
    if listed:
        whole = [_load(bare[a:b]) for a, b, depth in sorted(closed) if a > listed[0] and depth == left_open.index(listed[0]) + 1]
        if whole := [v for v in whole if v is not None]:
            return whole
    end, found = 0, []
    for a, b, _ in sorted(closed, key=lambda g: (g[0], -g[1])):
        if a >= end and (value := _load(bare[a:b])) is not None:
            found.append(value)
            end = b
    if found:
        return found if len(found) > 1 and all(isinstance(v, dict) for v in found) else found[0]
    return [] if re.search(r"\b(no|none|keine|keinen)\s+ads?\b|\bkeine\s+anzeigen\b", bare, re.IGNORECASE) else None


@F.pandas_udf(T.StringType())
def answer_json(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if (v := read_answer(t)) is None else json.dumps(v, ensure_ascii=False, sort_keys=True, default=str))


@F.pandas_udf(T.DoubleType())
def similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    """Share of words two texts have in common, in order; null where one is missing, 1 for two without words."""
    return pd.Series([None if x is None or y is None else SequenceMatcher(None, x.split(), y.split(), autojunk=False).ratio() for x, y in zip(a, b)], dtype="float64")


def span_confidence(target: str, words: list[tuple[str, float]]) -> float:
    """Mean confidence, from 0 to 1, of the first run of words that reads as ``target``; 0 where none does. The words are laid end to end once; a run is where
    the target stands between two of their edges."""
    parts = [" ".join(w.casefold().split()) for w, _ in words]
    starts, ends, at = {}, {}, 0
    for k, p in enumerate(parts):
        if p:
            starts[at], ends[at + len(p)] = k, k
            at += len(p) + 1
    line, wanted = " ".join(p for p in parts if p), " ".join(target.casefold().split())
    found = line.find(wanted) if wanted else -1
    while found >= 0:
        if found in starts and found + len(wanted) in ends:
            run = [c for w, c in words[starts[found] : ends[found + len(wanted)] + 1]]
            return sum(run) / (100 * len(run))
        found = line.find(wanted, found + 1)
    return 0.0
