"""Filling fixed-capacity containers with texts (problem 7).

Hierarchical multi-length packing. Texts are measured in tokens and dealt into pack groups of a fixed amount of tokens
(so a group's size is bounded whatever the input), in each of which they are routed to context-size tiers. From the
longest tier to the shortest, a tier's texts first fill the gaps that longer windows have left, then windows of the tier's
own size; these windows are then combined to containers of the full capacity, whose gaps the next tier fills. The shortest
tier is kept for the gaps and opens containers only with what is left. The containers of a group are dealt into step groups
of nearly equal load.
"""

from __future__ import annotations

import base64
import functools
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from sparkloom.sources.shared import written
from sparkloom.sources.tables import spread

#: Vocabulary of a public tokenizer, as ranks; on every machine at this path.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Pre-tokenizing pattern belonging to that vocabulary (fixed by it).
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

PARTS = "doc_id bigint, part_no int, n_parts int, token_start int, n_tokens int"
PLACED = "container_id bigint, step_group bigint, doc_id bigint, part_no int, n_parts int, token_start int, n_tokens int, tier int"


@functools.cache
def encoding(vocabulary: str):
    import tiktoken

    with open(vocabulary, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def _measured(vocabulary: str, capacity: int):
    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = encoding(vocabulary).encode_ordinary
        for batch in batches:
            rows = []
            for doc, text in zip(batch["doc_id"], batch["text"]):
                total = len(encode(text))
                starts = range(0, total, capacity)
                rows += [(doc, k, len(starts), at, min(capacity, total - at)) for k, at in enumerate(starts, 1)]
            yield pd.DataFrame(rows, columns=["doc_id", "part_no", "n_parts", "token_start", "n_tokens"])

    return measure


def token_parts(documents: DataFrame, capacity: int, vocabulary: str = VOCABULARY) -> DataFrame:
    """One row per text, or per ``capacity`` tokens of a longer text; missing and blank texts are left out."""
    texts = documents.select("doc_id", "text").where(F.col("text").isNotNull() & F.col("text").rlike(r"\S"))
    return spread(texts).mapInPandas(_measured(vocabulary, capacity), PARTS)


class _Gaps:
    """Free spaces of open containers, found by best fit: a bit for each size that some container has free."""

    def __init__(self):
        self.bits, self.at = 0, {}

    def put(self, container: int, space: int) -> None:
        if space:
            self.at.setdefault(space, []).append(container)
            self.bits |= 1 << space

    def take(self, n: int) -> tuple[int, int] | None:
        """``(container, space)`` with the least space of at least ``n``."""
        fitting = self.bits >> n
        if not fitting:
            return None
        space = n + (fitting & -fitting).bit_length() - 1
        container = self.at[space].pop()
        if not self.at[space]:
            self.bits &= ~(1 << space)
        return container, space


def _windows(order: list[int], lengths: list[int], size: int) -> list[list[int]]:
    """Windows of ``size`` for the texts in ``order`` (longest first), best fit."""
    gaps, windows = _Gaps(), []
    for i in order:
        found = gaps.take(lengths[i])
        if found is None:
            found = len(windows), size
            windows.append([])
        windows[found[0]].append(i)
        gaps.put(found[0], found[1] - lengths[i])
    return windows


def fill(lengths: list[int], capacity: int, tiers: tuple[int, ...]) -> list[int]:
    """A container number for every length. ``tiers``: window sizes, ascending, the last of them ``capacity``."""
    holds, gaps, used = [0] * len(lengths), _Gaps(), 0
    routed: dict[int, list[int]] = {t: [] for t in tiers}
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        routed[next(t for t in tiers if t >= lengths[i])].append(i)
    for tier in reversed(tiers):
        left = []
        for i in routed[tier]:
            found = gaps.take(lengths[i])
            if found is None:
                left.append(i)
            else:
                holds[i] = found[0]
                gaps.put(found[0], found[1] - lengths[i])
        # What fits in no gap: windows of the tier, combined to containers; the shortest tier's are the containers.
        windows = _windows(left, lengths, capacity if tier == tiers[0] else tier)
        loads = [sum(lengths[i] for i in w) for w in windows]
        for together in _windows(sorted(range(len(windows)), key=lambda w: -loads[w]), loads, capacity):
            for w in together:
                for i in windows[w]:
                    holds[i] = used
            gaps.put(used, capacity - sum(loads[w] for w in together))
            used += 1
    return holds


def _packed(capacity: int, tiers: tuple[int, ...], step: int, bits: int):
    def pack(key: tuple, parts: pd.DataFrame) -> pd.DataFrame:
        parts = parts.sort_values(["doc_id", "part_no", "n_tokens"], ignore_index=True)
        lengths = parts["n_tokens"].tolist()
        at = pd.Series(fill(lengths, capacity, tiers))
        load = parts["n_tokens"].groupby(at).sum().sort_values(ascending=False, kind="stable")
        steps = -(-len(load) // step)
        # Dealt to and fro, the fullest first, so that the groups' loads differ little.
        turn = [(k // steps) % 2 * (steps - 1 - 2 * (k % steps)) + k % steps for k in range(len(load))]
        group = dict(zip(load.index, turn))
        base = ((int(key[0]) << 20) + int(key[1])) << bits
        return parts.assign(
            container_id=at + base, step_group=at.map(group) + base, tier=[min(t for t in tiers if t >= n) for n in lengths]
        )[[c.split()[0] for c in PLACED.split(", ")]]

    return pack


def pack_texts(
    documents: DataFrame,
    capacity: int = 2048,
    tiers: tuple[int, ...] = (256, 512, 1024, 2048),
    group_containers: int = 1024,
    step: int = 64,
    vocabulary: str = VOCABULARY,
) -> DataFrame:
    """Places every text in a container of ``capacity`` tokens: one row per placed part.

    A text is in one part unless it is longer than ``capacity``; then all its parts but the last fill a container each.
    Missing and blank texts are left out; equal and repeated rows are placed each for itself; an empty table gives no
    rows; a missing ``doc_id`` is kept as missing; further columns are ignored. ``group_containers``: containers a pack
    group is expected to fill; ``step``: containers a step group. Texts go to groups by id, part and size, however the input is
    partitioned; only a group that rows of one id make more than twice as large is dealt out further.
    """
    tiers = tuple(sorted(t for t in {*tiers, capacity} if t <= capacity))
    parts = written(token_parts(documents, capacity, vocabulary), "token-parts")
    tokens = parts.agg(F.sum("n_tokens")).first()[0] or 0
    expected = capacity * group_containers
    groups = max(1, round(tokens / expected))
    dealt = parts.withColumn("pack_group", F.pmod(F.xxhash64("doc_id", "part_no", "n_tokens"), F.lit(groups)))
    loads = dealt.groupBy("pack_group").agg(F.sum("n_tokens").alias("load")).where(F.col("load") > 2 * expected)
    # At most half as many as groups. The written rows' numbers are the same at every reading.
    loads = loads.select("pack_group", F.ceil(F.col("load") / expected).alias("parts"))
    row = F.xxhash64(F.monotonically_increasing_id())
    dealt = dealt.withColumn("row", row).join(loads, "pack_group", "left")
    dealt = dealt.withColumn("part_group", F.pmod("row", F.coalesce("parts", F.lit(1)))).drop("row", "parts")
    return dealt.groupBy("pack_group", "part_group").applyInPandas(_packed(capacity, tiers, step, (8 * group_containers).bit_length()), PLACED)


def container_fill(placed: DataFrame, capacity: int = 2048) -> DataFrame:
    """Number of texts and tokens and the filled share of every container."""
    return placed.groupBy("step_group", "container_id").agg(
        F.count(F.lit(1)).alias("n_parts"), F.sum("n_tokens").alias("n_tokens"), (F.sum("n_tokens") / capacity).alias("filled")
    )
