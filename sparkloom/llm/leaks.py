"""Evaluation texts leaking into training texts (problem 8).

Wu-Manber multi-pattern search over words: the patterns are all runs of ``SEED`` words of the evaluation items, a block is
a pair of words. The shift table tells for the block at the window's end how far the window may jump, the patterns that
end in a block lie in a bucket of their own, and the words before it are compared directly. Occurrences grow to passages
over changed, added and missing words: a passage of 15 words or more with an edit in eight has a run of five common words,
so none is without an occurrence.

The corpus is read once for each block of evaluation items (``block_words``); only that block's tables reach the tasks.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from sparkloom.sources.shared import written
from sparkloom.sources.tables import spread

SEED = 5
#: Words of a run by which stock instructions are known; shorter ones may be shared by chance.
STOCK = 8
FOUND = "doc_id bigint, item_id bigint, passage_words int, edits int"

#: Tags, character references and written-out line ends are no words; soft hyphens and zero-width signs part none.
_TAG = re.compile(r"</?[A-Za-z][^<>\n]*>|&(?:[a-z]+|#\d+);|\\[nrt]")
_BROKEN = re.compile(r"(?<=[^\W\d_])[-\u00ad]\r?\n[ \t]*(?:(?:>|//|#|\*)+[ \t]*)?(?=[a-z])|[\u00ad\u200b-\u200d\ufeff]")
_WORD = re.compile(r"[^\W_]+")


def words_of(text: str) -> list[str]:
    """Words without case, punctuation, spacing, markup, and hyphens at line ends."""
    return _WORD.findall(_TAG.sub(" ", _BROKEN.sub("", text)).casefold())


class Patterns:
    """Wu-Manber tables of one block of items: ``items`` maps an id to its words and the positions of stock words."""

    def __init__(self, items: dict[int, tuple[list[str], frozenset[int]]]):
        self.items = {}
        self.ids: dict[str, int] = {}
        for item, (words, stock) in items.items():
            # Every stock word becomes a number of its own, so that no run leads into or through stock instructions.
            self.items[item] = [-1 - at if at in stock else self.ids.setdefault(w, len(self.ids) + 1) for at, w in enumerate(words)]
        self.width = len(self.ids) + 1
        self.shift: dict[int, int] = {}
        self.bucket: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for item, ids in self.items.items():
            for at in range(len(ids) - SEED + 1):
                run = ids[at : at + SEED]
                if min(run) < 0:
                    continue
                for end in range(1, SEED):
                    block = run[end - 1] * self.width + run[end]
                    self.shift[block] = min(self.shift.get(block, SEED), SEED - 1 - end)
                self.bucket[run[-2] * self.width + run[-1]].append((item, at))

    def occurrences(self, ids: list[int]) -> dict[int, list[tuple[int, int]]]:
        """For each item the ``(text position, item position)`` of its runs in the text."""
        found: dict[int, list[tuple[int, int]]] = defaultdict(list)
        shift, width, n, at = self.shift.get, self.width, len(ids), SEED - 1
        while at < n:
            block = ids[at - 1] * width + ids[at]
            jump = shift(block, SEED - 1)
            if jump:
                at += jump
                continue
            start = at - SEED + 1
            head = ids[start : at - 1]
            for item, place in self.bucket[block]:
                if self.items[item][place : place + SEED - 2] == head:
                    found[item].append((start, place))
            at += 1
        return found


def _grow(text: list[int], item: list[int], hits: list[tuple[int, int]]) -> list[tuple[int, int, int]]:
    """Longest common runs ``(text start, item start, length)`` through the hits."""
    runs, ends = [], {}
    for d, i in sorted(hits, key=lambda h: (h[0] - h[1], h[0])):
        if ends.get(d - i, -1) >= d + SEED:
            continue
        n = SEED
        while d + n < len(text) and i + n < len(item) and text[d + n] == item[i + n]:
            n += 1
        while d and i and text[d - 1] == item[i - 1]:
            d, i, n = d - 1, i - 1, n + 1
        ends[d - i] = d + n
        runs.append((d, i, n))
    return runs


def _extended(text: list[int], item: list[int], d: int, i: int, step: int, edits: int) -> list[int]:
    """Item words gained from ``text[d]``, ``item[i]`` on in the direction ``step`` with 0, 1, .. ``edits`` edits.

    Furthest-reaching diagonals: for each number of edits and each shift of text against item the furthest text position,
    each slid over the words that agree. What is gained ends with a common word.
    """
    room, width = (len(text) - d, len(item) - i) if step > 0 else (d + 1, i + 1)

    def slide(at: int, shift: int) -> int:
        while at < room and 0 <= at - shift < width and text[d + step * at] == item[i + step * (at - shift)]:
            at += 1
        return at

    far = {0: slide(0, 0)}
    gains = [far[0]]
    for _ in range(edits):
        new, gain = {}, gains[-1]
        for shift in range(min(far) - 1, max(far) + 2):
            # A changed word, one more in the text, one missing from it.
            tried = [far[s] + more for s, more in ((shift, 1), (shift - 1, 1), (shift + 1, 0)) if s in far]
            at = min(max(tried), room, width + shift)
            if at < 0 or at < shift:
                continue
            new[shift] = slide(at, shift)
            if new[shift] > at:
                gain = max(gain, new[shift] - shift)
        far = new
        gains.append(gain)
        if not far:
            break
    return gains


def passage(text: list[int], item: list[int], hits: list[tuple[int, int]], least: int, rate: float) -> tuple[int, int]:
    """``(item words, edits)`` of the longest passage of the item around a hit, ``(0, 0)`` if all are too short.

    A passage begins and ends with common words and has at most ``rate`` edits a word of the item, whatever its length. One of
    twice ``least`` words or more has a half that keeps the rate too, so the edits of such a half are all that need be tried.
    """
    runs = _grow(text, item, hits)
    longest = max(n for _, _, n in runs)
    if longest >= least:
        return longest, 0
    best, edits = (0, 0), int(2 * least * rate) + 1
    for d, i, n in runs:
        after = _extended(text, item, d + n, i + n, 1, edits)
        before = _extended(text, item, d - 1, i - 1, -1, edits)
        for e, gained in enumerate(after):
            for f, more in enumerate(before):
                span = n + gained + more
                if span > best[0] and e + f <= span * rate:
                    best = (span, e + f)
    return best if best[0] >= least else (0, 0)


def item_words(items: DataFrame, stock_items: int) -> DataFrame:
    """``(item_id, words, stock)``: each item's words and the positions that lie in runs shared by many items."""
    cut = F.pandas_udf(lambda texts: texts.map(words_of), "array<string>")
    words = items.select(F.col("item_id").cast("bigint").alias("item_id"), "text").where("item_id is not null and text is not null")
    words = words.groupBy("item_id").agg(F.max("text").alias("text")).select("item_id", cut("text").alias("words"))
    starts = F.sequence(F.lit(1), F.size("words") - STOCK + 1)
    runs = words.where(F.size("words") >= STOCK).select(
        "item_id", F.explode(F.transform(starts, lambda at: F.struct(at.alias("at"), F.array_join(F.slice("words", at, STOCK), " ").alias("run")))).alias("r")
    )
    stock = runs.groupBy("r.run").agg(F.count_distinct("item_id").alias("n")).where(F.col("n") >= stock_items)
    shared = runs.select("item_id", F.col("r.at").alias("at"), F.col("r.run").alias("run")).join(stock, "run", "left_semi")
    shared = shared.groupBy("item_id").agg(F.collect_set("at").alias("stock"))
    return words.join(shared, "item_id", "left")


def _searched(block, least: int, rate: float):
    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        patterns = block.value
        known = patterns.ids.get
        for batch in batches:
            rows = []
            for doc, text in zip(batch["doc_id"], batch["text"]):
                ids = [known(w, 0) for w in words_of(text)]
                for item, hits in patterns.occurrences(ids).items():
                    span, edits = passage(ids, patterns.items[item], hits, least, rate)
                    if span:
                        rows.append((doc, item, span, edits))
            yield pd.DataFrame(rows, columns=["doc_id", "item_id", "passage_words", "edits"])

    return search


def leaked_passages(
    documents: DataFrame, items: DataFrame, least: int = 15, rate: float = 1 / 8, stock_items: int = 4, block_words: int = 2_000_000
) -> DataFrame:
    """Documents that repeat a connected passage of at least ``least`` words of an item, with the longest passage's size.

    ``rate``: edits (changed, added, missing words) allowed per word of the passage; a changed word at a passage's end is no
    part of it. Runs of words that at least ``stock_items`` items share are stock instructions and belong to no passage. Null
    and blank texts, missing ids and items shorter than a passage give no rows; an item given several times counts once (its
    greatest text); repeated documents give a row each; empty tables give none; further columns are ignored. Texts are
    searched whole, whatever their length.

    The items are dealt into blocks of about ``block_words`` words. One block at a time is on the driver; it is broadcast,
    and with several blocks each is searched and given up before the next is read.
    """
    spark = documents.sparkSession
    corpus = spread(documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").where("doc_id is not null and text is not null"))
    known = written(item_words(items, stock_items), "eval-items")
    blocks = max(1, -(-(known.agg(F.sum(F.size("words"))).first()[0] or 0) // block_words))
    found = []
    for number in range(blocks):
        part = known.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == number)
        held = {r["item_id"]: (r["words"], frozenset(at + k - 1 for at in r["stock"] or [] for k in range(STOCK))) for r in part.toLocalIterator()}
        block = spark.sparkContext.broadcast(Patterns(held))
        rows = corpus.mapInPandas(_searched(block, least, rate), FOUND)
        if blocks > 1:
            rows = written(rows, "leaks")
            block.destroy()
        found.append(rows)
    return reduce(DataFrame.unionByName, found)


def leaked_items(passages: DataFrame) -> DataFrame:
    """For each item that leaked: the number of documents and its longest passage."""
    return passages.groupBy("item_id").agg(F.count_distinct("doc_id").alias("n_documents"), F.max("passage_words").alias("longest_passage"))
