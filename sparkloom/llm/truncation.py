"""Texts cut off by field limits or in transfer (problem 9).

Three kinds of evidence meet in one verdict:

* Self-join by prefix. Prefixes of doubling lengths are hashed; a text can only begin a longer one if that has the same hash
  at the greatest such length. Texts that share one are sorted: a text is a strict prefix of a longer one exactly if it is
  a prefix of its successor. The same join on words finds last words that occur nowhere else but begin longer words.
* Limits. A source whose longest texts pile up at one length (in characters or in UTF-8 bytes) cuts there.
* The ending's shape: complete, stopped inside something, or open (a list item, a sign-off: complete as it stands, unless
  one of the two above says otherwise).
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.window import Window

from sparkloom.sources.shared import written
from sparkloom.sources.tables import spread

SHAPES = "doc_id bigint, source string, n_chars int, n_bytes int, key string, shape string, tail string"
#: Characters by which distinct texts are dealt into ranges, doubled where more than ``HOT_TEXTS`` share them; within a
#: range whole texts are sorted.
RANGE_CHARS, HOT_TEXTS = 256, 100_000
#: Rows of keys up to which they are broadcast; beyond it their joins shuffle.
BROADCAST_ROWS = 1_000_000

#: Notes that a text was cut, in the languages of the corpus.
_NOTE = re.compile(r"\s*[\[(<](?:\.\.\.|…|[^\])>\n]{0,12}\b)?(?:truncated|more|cut off|snipp?ed|continued|abridged|gekürzt|abgeschnitten|mehr|已截断|截断|更多)[^\])>\n]{0,12}[\])>]$", re.I)
_DOTS = re.compile(r"\s*(?:\.{3,}|…+)$")
_END = re.compile(r"[.!?。！？｡؟][\"'”’»)\]」』）*_`]*$")
_ABBREVIATED = re.compile(r"(?:^|\s)(?:etc|usw|u\.s\.w|etc\.|等|等等)$")
_FENCE = re.compile(r"^\s*(```|~~~)", re.M)
_LIST = re.compile(r"^\s*(?:[-*+•]|\d+[.)])\s+(.*)$")
_URL = re.compile(r"https?://\S*$")
_WHOLE_URL = re.compile(r"^(?:[-*+•<]\s*)?https?://(?:[\w-]+\.)+[A-Za-z]{2,}(?::\d+)?(?:/\S*[\w/)>])?$")
_TRAILER = re.compile(r"^[A-Z][A-Za-z]+(?:-[A-Za-z]+)*: ")
_REFS = re.compile(r"^[A-Z][A-Za-z-]+: (?:[\w/-]*#\d+|[A-Z]+-\d+)(?:, (?:[\w/-]*#\d+|[A-Z]+-\d+))*$")
_ADDRESS = re.compile(r"<[^<>\s]*@?[^<>\s]*$")
_LAST_WORD = re.compile(r"[^\W\d_]+$")
_HAN = re.compile(r"[㐀-鿿]")


def _words(line: str) -> int:
    return len(line.split()) + len(_HAN.findall(line)) // 2


def shape_of(text: str) -> str:
    """``complete``, ``cut`` or, with an open end, ``item`` (of a list) or ``open``."""
    t = text.rstrip()
    if t.endswith("�"):
        return "cut"
    if _NOTE.search(t):
        return "cut"
    lines = t.split("\n")
    if len(_FENCE.findall(t)) % 2:
        return "cut"
    line = lines[-1].rstrip("\r")
    if _FENCE.match(line):
        return "complete"
    dots = _DOTS.search(t)
    if dots:
        before = t[: dots.start()]
        if _END.search(before) or _ABBREVIATED.search(before):
            return "open"
        return "open" if "\n" not in before and _words(before) <= 8 and not re.search(r"[.!?。！？]\s*\S", before) else "cut"
    if line.lstrip().startswith("|"):
        head = line
        for other in reversed(lines[:-1]):
            if not other.lstrip().startswith("|"):
                break
            head = other
        return "complete" if line.endswith("|") and line.count("|") >= head.count("|") else "cut"
    if re.match(r"^\s*(?://|#|\*|>)*\s*#{1,6} \S", line) and len(lines) > 1:
        return "cut"  # a heading of which the text is lost
    if _URL.search(line):
        return "complete" if _WHOLE_URL.match(line.strip()) else "cut"
    if _ADDRESS.search(line):
        return "cut"
    if _TRAILER.match(line):
        if line.endswith(">") or _REFS.match(line) or _END.search(line):
            return "complete"
        if re.search(r"[,#<]\s*$", line):
            return "cut"
    if _END.search(line):
        return "complete"
    if re.search(r"[,;:，；：、(\[{（\-–/=&+]$", line):
        return "cut"
    item = _LIST.match(line)
    if item:
        siblings = []
        for other in reversed(lines[:-1]):
            m = _LIST.match(other.rstrip("\r"))
            if not m:
                break
            siblings.append(m[1])
        if siblings and all(_END.search(s) for s in siblings):
            return "cut"
        if siblings and _words(item[1]) < min(map(_words, siblings)):
            return "cut"
        return "item" if _words(item[1]) <= 8 else "cut"
    # A line of its own: signature, sign-off, title or a whole informal text.
    signed = len(lines) > 1 and lines[-2].rstrip("\r") in ("-- ", "--")
    alone = signed or len(lines) == 1 or not lines[-2].strip()
    if not alone or _words(line) > 8 or re.search(r"[.!?。！？；，,]\s*\S", line.replace(", ", " ", 1)) or line.startswith((" ", "\t")):
        return "cut"
    # Sign-offs are short; what begins like a sentence is one that did not end.
    begun = _words(line) > (2 if len(lines) > 1 else 4) and line[:1].isupper() or len(_HAN.findall(line)) > 7
    return "open" if signed or not begun else "cut"


def _shapes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        tails = [_LAST_WORD.search(t.rstrip()) for t in batch["text"]]
        yield batch.drop(columns="text").assign(shape=[shape_of(t) for t in batch["text"]], tail=[m[0].lower() if m else None for m in tails])


def _edge(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=["key", "part", "first", "last"], dtype=object)


def _successors(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Of a sorted partition: the keys of texts that begin their successor, and the partition's first and last text."""
    part, first, last = TaskContext.get().partitionId(), None, None
    for batch in batches:
        if batch.empty:
            continue
        texts, keys = batch["text"].tolist(), batch["key"].tolist()
        if last is not None:
            texts, keys = [last[0], *texts], [last[1], *keys]
        else:
            first = texts[0]
        found = [k for t, after, k in zip(texts, texts[1:], keys) if len(after) > len(t) and after.startswith(t)]
        last = texts[-1], keys[-1]
        if found:
            yield _edge([(k, part, None, None) for k in found])
    if last is not None:
        yield _edge([(last[1], part, first, last[0])])


def _small(rows: DataFrame, label: str) -> DataFrame:
    """Rows written once, and broadcast if they are few."""
    rows = written(rows, label)
    return F.broadcast(rows) if rows.count() <= BROADCAST_ROWS else rows


def sharing_texts(texts: DataFrame) -> DataFrame:
    """Distinct ``(key, text)`` of the texts that share a prefix hash with a longer or shorter one that may begin them.

    Of every text the prefixes of 1, 2, 4, .. characters are hashed. A text is an opening at its greatest such length; a hash
    is kept if an opening shorter than the longest text with this hash has it.
    """
    length = F.char_length("text")
    powers = F.transform(F.sequence(F.lit(0), F.floor(F.log2(length)).cast("int")), lambda k: F.pow(F.lit(2), k).cast("int"))
    hashed = F.transform(powers, lambda p: F.struct(p.alias("p"), F.xxhash64(F.left("text", p)).alias("h")))
    rows = texts.where(length > 0).select("key", length.alias("n"), F.explode(hashed).alias("x")).select("key", "n", "x.p", "x.h")
    rows = written(rows, "prefix-hashes")
    opening = F.when(F.col("n") < 2 * F.col("p"), F.col("n"))
    shared = rows.groupBy("p", "h").agg(F.min(opening).alias("opening"), F.max("n").alias("longest")).where("opening < longest")
    shared = _small(shared.select("p", "h", "opening"), "shared-prefixes")
    # A text as long as the shortest opening or longer may be begun by it, an opening may begin others.
    keys = rows.join(shared, ["p", "h"]).where("n >= opening").select("key").distinct()
    return texts.join(_small(keys, "sharing"), "key", "left_semi").groupBy("key").agg(F.first("text").alias("text"))


def _ranged(distinct: DataFrame, chars: int, hot: int) -> DataFrame:
    """Texts with the prefix ``at`` that they are put in order by: ``chars`` characters, or twice as many as often as more than
    ``hot`` texts share them. Texts that share ``chars`` characters have prefixes of one length, so that the order is theirs."""
    rows = distinct.withColumn("chars", F.lit(chars))
    while True:
        shared = rows.where(F.length("text") > F.col("chars")).groupBy("chars", F.xxhash64(F.left("text", F.col("chars"))).alias("h")).agg(F.count(F.lit(1)).alias("n"))
        crowded = written(shared.where((F.col("n") > hot) & (F.col("chars") == chars)).select("h"), "hot-prefixes")
        if crowded.isEmpty():  # at most one row for ``hot`` texts
            return rows.withColumn("at", F.left("text", F.col("chars"))).drop("chars")
        met = F.when(F.col("chars") == chars, F.xxhash64(F.left("text", F.col("chars"))))
        rows = rows.withColumn("h", met).join(F.broadcast(crowded.withColumn("more", F.lit(2 * chars))), "h", "left")
        rows = rows.withColumn("chars", F.coalesce("more", "chars")).drop("h", "more")
        chars *= 2


def strict_prefixes(texts: DataFrame) -> DataFrame:
    """Keys of the texts (``key``, ``text``) that are strict prefixes of a longer one; each once, copies or not."""
    distinct = written(sharing_texts(texts), "sharing-texts")
    ranged = _ranged(distinct, RANGE_CHARS, HOT_TEXTS).repartitionByRange("at").sortWithinPartitions("text").drop("at")
    rows = written(ranged.mapInPandas(_successors, "key string, part int, first string, last string"), "prefixes")
    # One row per partition: its last text against the first of the next partition that holds any. Only the partitions'
    # numbers are put in order in one task; the texts meet in a join.
    edges = rows.where("first is not null")
    order = edges.select("part", F.lead("part").over(Window.orderBy("part")).alias("next")).where("next is not null")
    followed = edges.select("part", "key", "last").join(order, "part").join(edges.select(F.col("part").alias("next"), F.col("first").alias("after")), "next")
    across = followed.where((F.length("after") > F.length("last")) & F.startswith("after", "last"))
    return rows.where("first is null").select("key").unionByName(across.select("key")).distinct()


def partial_words(texts: DataFrame, tails: DataFrame) -> DataFrame:
    """Of the last words ``tails`` (``tail``) those that stand nowhere else but begin longer words of the texts.

    Words are runs of letters of any script and length, in lower case. Only their prefixes of lengths that a last word has
    are looked up; the driver sees these lengths, at most as many as the longest last word has letters.
    """
    last = written(tails.where("tail is not null").groupBy("tail").agg(F.count(F.lit(1)).alias("as_tail")), "tails")
    lengths = sorted(r[0] for r in last.select(F.length("tail")).distinct().collect())
    words = texts.select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"(?<![\p{L}\p{N}_])\p{L}+(?![\p{L}\p{N}_])"), F.lit(0))).alias("word"))
    counts = written(words.groupBy("word").agg(F.count(F.lit(1)).alias("n")), "word-counts")  # looked up twice, counted once
    cut = F.filter(F.array(*map(F.lit, lengths)).cast("array<int>"), lambda k: k < F.length("word"))
    begun = counts.where("n > 1").select("word", F.explode(cut).alias("k")).select(F.left("word", F.col("k")).alias("tail")).distinct()
    elsewhere = counts.withColumnRenamed("word", "tail")
    return last.join(begun, "tail", "left_semi").join(elsewhere, "tail", "left").where("coalesce(n, 0) <= as_tail").select("tail")


def source_limits(shapes: DataFrame, least: int = 3, share: float = 0.005) -> DataFrame:
    """``(source, limit_chars, limit_bytes)``: lengths at which the longest texts of a source pile up, else null.

    A pile is at least ``least`` texts, not all equal, and ``share`` of the source's texts. A limit in bytes may leave out
    up to three bytes of a character.
    """

    def piled(length: str, slack: int, name: str) -> DataFrame:
        counts = shapes.groupBy("source", length).agg(F.count(F.lit(1)).alias("n"), F.min("key").alias("a"), F.max("key").alias("z"))
        top = F.max(length).over(Window.partitionBy("source"))
        near = counts.withColumn("top", top).withColumn("near", F.col(length) >= F.col("top") - slack)
        found = near.groupBy("source").agg(
            F.max("top").alias("top"), F.sum("n").alias("of"), F.sum(F.when(F.col("near"), F.col("n"))).alias("n"),
            F.min(F.when(F.col("near"), F.col("a"))).alias("a"), F.max(F.when(F.col("near"), F.col("z"))).alias("z"),
        )
        pile = (F.col("n") >= least) & (F.col("n") >= share * F.col("of")) & (F.col("a") != F.col("z"))
        return found.select("source", F.when(pile, F.col("top")).alias(name))

    return piled("n_chars", 0, "limit_chars").join(piled("n_bytes", 3, "limit_bytes"), "source", "full")


def judged(documents: DataFrame) -> DataFrame:
    """One row per text with ``is_cut`` and its evidence: ``shape``, ``at_limit``, ``has_longer``, ``ends_in_word``.

    Missing and blank texts are left out; a missing source is a source of its own; copies and repeated rows are judged
    each; an empty table gives no rows; texts are judged whole, whatever their length; further columns are ignored.
    """
    texts = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("source", F.lit("")).alias("source"), "text")
    texts = spread(texts.where(F.col("text").isNotNull() & F.col("text").rlike(r"\S")))
    keyed = texts.select("doc_id", "source", F.length("text").alias("n_chars"), F.octet_length("text").alias("n_bytes"), F.md5("text").alias("key"), "text")
    shapes = written(keyed.mapInPandas(_shapes, SHAPES), "shapes")
    longer = strict_prefixes(keyed.select("key", "text")).withColumn("has_longer", F.lit(True))
    limits = source_limits(shapes)
    at = (F.col("n_chars") == F.col("limit_chars")) | (F.col("n_bytes") >= F.col("limit_bytes") - 3)
    yes = lambda c: F.coalesce(c, F.lit(False))
    # Only list items need their last word looked up; the many rows without one never meet in a join.
    items = shapes.where("shape = 'item'")
    partial = partial_words(texts, items.select("tail")).withColumn("ends_in_word", F.lit(True))
    looked_up = items.join(partial, "tail", "left").unionByName(shapes.where("shape <> 'item'").withColumn("ends_in_word", F.lit(False)))
    evidence = (
        looked_up.join(limits, "source", "left").join(longer, "key", "left")
        .select("doc_id", "source", "shape", yes(at).alias("at_limit"), yes(F.col("has_longer")).alias("has_longer"), yes(F.col("ends_in_word")).alias("ends_in_word"))
    )
    # Sign-offs hold words of their own ("bot"), so the last word counts for list items only.
    stopped = F.col("shape").isin("open", "item") & (F.col("at_limit") | F.col("has_longer") | F.col("ends_in_word"))
    return evidence.withColumn("is_cut", (F.col("shape") == "cut") | stopped)


def cut_rates(verdicts: DataFrame) -> DataFrame:
    """Texts, cut texts and their share for every source."""
    return verdicts.groupBy("source").agg(
        F.count(F.lit(1)).alias("n_texts"), F.count_if("is_cut").alias("n_cut"), (F.count_if("is_cut") / F.count(F.lit(1))).alias("cut_rate")
    )
