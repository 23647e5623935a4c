"""Problems 1, 2 and 3 on ``parsed_files``, ``files`` and ``file_versions``."""

from __future__ import annotations

from sparkloom.llm.credentials import credential_lines, credentials, redacted
from sparkloom.llm.parsing import broken_rates, unparsable
from sparkloom.llm.provenance import foreign_files, provenance, provenance_totals
from sparkloom.sources.tables import table


def p1_found(spark, sf_dir):
    return credential_lines(credentials(table(spark, sf_dir, "parsed_files")))


def p1_redacted(spark, sf_dir):
    return redacted(table(spark, sf_dir, "parsed_files"))


def _provenance(spark, sf_dir):
    return provenance(table(spark, sf_dir, "files"), table(spark, sf_dir, "parsed_files"), table(spark, sf_dir, "file_versions"))


def p2_found(spark, sf_dir):
    return foreign_files(_provenance(spark, sf_dir))


def p2_totals(spark, sf_dir):
    return provenance_totals(_provenance(spark, sf_dir))


def p3_found(spark, sf_dir):
    return unparsable(table(spark, sf_dir, "parsed_files")).where("broken").select("file_id")


def p3_rates(spark, sf_dir):
    return broken_rates(unparsable(table(spark, sf_dir, "parsed_files")), table(spark, sf_dir, "files"))


QUERIES = {"p1_found": p1_found, "p1_redacted": p1_redacted, "p2_found": p2_found, "p2_totals": p2_totals, "p3_found": p3_found, "p3_rates": p3_rates}
SQL: dict[str, str] = {}
