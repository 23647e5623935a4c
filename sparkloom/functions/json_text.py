"""JSON objects within other text (F8)."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column, functions as F

_FENCED = re.compile(r"```(?:json)?\s*\n?(.*?)\n?```", re.S)
_MARKS = re.compile(r"[{}]")


def _valid(text: str) -> bool:
    try:
        json.loads(text)
    except (ValueError, RecursionError):
        return False
    return True


def found_json(text: str | None) -> str | None:
    """The first valid JSON of a text: in a fenced block, else between balanced braces."""
    if not text:
        return None
    for block in _FENCED.finditer(text):
        if _valid(block[1].strip()):
            return block[1].strip()
    depth, begun = 0, -1
    for mark in _MARKS.finditer(text):
        if mark[0] == "{":
            begun = mark.start() if not depth else begun
            depth += 1
            continue
        depth -= 1
        if not depth and begun >= 0:
            if _valid(text[begun : mark.end()]):
                return text[begun : mark.end()]
            begun = -1
    whole = text.strip()
    return whole if whole[:1] == "{" and whole[-1:] == "}" and _valid(whole) else None


def _extracted(texts: pd.Series) -> pd.Series:
    return pd.Series([found_json(t) if isinstance(t, str) else None for t in texts], dtype=object)


def extract_json(text: Column) -> Column:
    """JSON of every text, null where there is none. Texts without a brace or a fence never leave the JVM's side."""
    return F.pandas_udf(_extracted, "string")(F.when(text.contains("{") | text.contains("```"), text))
