"""DuckDB SQL with the results the Spark queries have to match."""

from __future__ import annotations


def oracle() -> dict[str, str]:
    from sqlcheck.answers import ANSWERS
    from sqlcheck.audit import AUDIT
    from sqlcheck.provenance import PROVENANCE
    from sqlcheck.tables import TABLES

    return ANSWERS | PROVENANCE | AUDIT | TABLES
