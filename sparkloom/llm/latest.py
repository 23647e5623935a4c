"""Latest parse of each file, without moving the sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from sparkloom.operators.latest import flagged_latest
from sparkloom.sources.tables import spread


def latest_sources(parsed: DataFrame, extensions: tuple[str, ...] | None = None) -> DataFrame:
    """``(file_id, path, source)``: each file's latest parse, if it has a source.

    A missing ``parsed_at`` is the earliest; of equal times all rows remain. Rows without ``file_id`` are left out; a file
    whose latest parse has a missing or empty source gives no row; nor do other extensions if some are given.
    """
    rows = parsed.select(F.col("file_id").cast("bigint").alias("file_id"), "path", "source", "parsed_at").where("file_id is not null and source is not null")
    if extensions:
        rows = rows.where(F.lower(F.regexp_extract("path", r"\.([A-Za-z]+)$", 1)).isin(*extensions))
    return flagged_latest(spread(rows), "file_id", "parsed_at").where("octet_length(source) > 0").select("file_id", "path", "source")
