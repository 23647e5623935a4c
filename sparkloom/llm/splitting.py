"""Splitting oversized diffs at natural boundaries (problem 6).

Structure-tree packing: a diff is a tree of file sections, hunks, lines and words. Sibling subtrees are merged from the
bottom up while they fit; only nodes over the limit are descended into, and the file sections among them are those that
cannot stay whole. Pieces after the first repeat the end of the piece before, so that
``pieces[0] + pieces[k][overlap_k:] ...`` is the text again.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from sparkloom.operators.latest import latest_rows

#: Starts of the children of each level: file sections, hunks, lines, words.
LEVELS = [re.compile(p, re.M) for p in (r"(?:(?<=\n)|\A)diff --(?:git|cc) ", r"(?:(?<=\n)|\A)@@", r"(?<=\n)", r"(?<=\s)(?=\S)")]

PIECES = "review_id bigint, piece_no int, start_at int, overlap int, piece string, cut_files array<int>"


def _children(text: str, start: int, end: int, level: int) -> list[tuple[int, int]]:
    cuts = [m.start() for m in LEVELS[level].finditer(text, start, end) if start < m.start() < end]
    return list(zip([start, *cuts], [*cuts, end]))


def _pack(text: str, start: int, end: int, room: int, opened: list[tuple[int, int, int]], level: int = 0) -> list[int]:
    """Ends of consecutive parts of ``text[start:end]``, none longer than ``room``; nodes descended into go to ``opened``."""
    if end - start <= room:
        return [end]
    if level == len(LEVELS):
        return [*range(start + room, end, room), end]
    ends: list[int] = []
    begun = start  # where the last part begins
    for a, b in _children(text, start, end, level):
        if b - a > room:
            opened.append((level, a, b))
        for e in _pack(text, a, b, room, opened, level + 1):
            if ends and e - begun <= room:
                ends[-1] = e
            else:
                begun = ends[-1] if ends else start
                ends.append(e)
    return ends


def split_text(text: str, limit: int = 4000, overlap: int = 200) -> tuple[list[tuple[int, int]], list[tuple[int, int, int]]]:
    """``(start, end)`` of the pieces' new characters (a piece also holds up to ``overlap`` characters before its start), and
    the nodes ``(level, start, end)`` of the tree that were descended into."""
    opened: list[tuple[int, int, int]] = []
    ends = _pack(text, 0, len(text), limit - overlap, opened)
    # The first piece repeats nothing and may take in more.
    while len(ends) > 1 and ends[1] <= limit:
        ends.pop(0)
    return list(zip([0, *ends], ends)), opened


def cut_files(text: str, opened: list[tuple[int, int, int]], limit: int) -> list[tuple[int, int]]:
    """``(start, number)`` of the file sections among the opened nodes that exceed the limit. Text before the first section
    is none; sections are numbered from 1."""
    numbers = {m.start(): k for k, m in enumerate(LEVELS[0].finditer(text), 1)}
    return [(a, numbers[a]) for level, a, b in opened if not level and b - a > limit and a in numbers]


def _pieces(limit: int, overlap: int):
    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for review, text in zip(batch["review_id"], batch["diff_context"]):
                parts, opened = split_text(text, limit, overlap)
                large = cut_files(text, opened, limit)
                for number, (a, b) in enumerate(parts, 1):
                    shared = min(overlap, a)
                    rows.append((review, number, a, shared, text[a - shared : b], [k for at, k in large if a <= at < b]))
            yield pd.DataFrame(rows, columns=["review_id", "piece_no", "start_at", "overlap", "piece", "cut_files"])

    return split


def latest_states(states: DataFrame) -> DataFrame:
    """``(review_id, diff_context)`` of each review's latest state (missing time: earliest; equal times: greatest text)."""
    rows = states.where(F.col("review_id").isNotNull()).select(F.col("review_id").cast("bigint").alias("review_id"), "updated_at", "diff_context")
    return latest_rows(rows, "review_id", "updated_at", ["diff_context"]).select("review_id", "diff_context")


def split_oversized(states: DataFrame, limit: int = 4000, overlap: int = 200) -> DataFrame:
    """Pieces of every latest diff longer than ``limit`` characters.

    ``piece`` has at most ``limit`` characters, the first ``overlap`` of which end the piece before it. ``cut_files`` names
    the file sections beginning in the piece that no piece can hold whole (longer than ``limit``), numbered from 1.
    Missing, empty and short diffs give no rows, as do rows without ``review_id``; repeated states count once; a text
    without any structure is cut at lines, words and at last anywhere; further columns are ignored.
    """
    if not 0 <= overlap < limit:
        raise ValueError("overlap must be smaller than the limit")
    oversized = latest_states(states).where(F.length("diff_context") > limit)
    return oversized.mapInPandas(_pieces(limit, overlap), PIECES)


def cut_sections(pieces: DataFrame) -> DataFrame:
    """``(review_id, file_no)`` of the file sections that could not stay whole."""
    return pieces.select("review_id", F.explode("cut_files").alias("file_no"))
