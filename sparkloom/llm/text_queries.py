"""Problems 8 and 9 on ``documents`` and ``eval_items``."""

from __future__ import annotations

from sparkloom.llm.leaks import leaked_items, leaked_passages
from sparkloom.llm.truncation import cut_rates, judged
from sparkloom.sources.tables import table


def _passages(spark, sf_dir):
    return leaked_passages(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))


def p8_found(spark, sf_dir):
    return _passages(spark, sf_dir).select("doc_id", "item_id")


def p8_items(spark, sf_dir):
    return leaked_items(_passages(spark, sf_dir))


def p9_found(spark, sf_dir):
    return judged(table(spark, sf_dir, "documents")).where("is_cut").select("doc_id")


def p9_rates(spark, sf_dir):
    return cut_rates(judged(table(spark, sf_dir, "documents")))


QUERIES = {"p8_found": p8_found, "p8_items": p8_items, "p9_found": p9_found, "p9_rates": p9_rates}
SQL: dict[str, str] = {}
