"""Every query of the library by name, with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from marlspike.operators import analytics, audience, documents, inbox, layers, leads, mail, people, planning, rules

MODULES: list = [analytics, audience, planning, leads, mail, documents, inbox, rules, layers, people]
#: Queries whose rules SQL restates no better than they do: tested by golden vectors and loops.
TESTED_BY_VECTORS = ("u01_page_class", "u02_entries", "u05_page_facts")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: query for module in MODULES for name, query in module.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for module in MODULES for name, sql in module.ORACLES.items()}
