"""Where query modules enter their queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..sources.fixtures import TABLES, VIEWS, blocks_of, view, with_views
from .session import checkpointed

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


class Tables:
    """The driver tables and views of a folder, by attribute; each is built once for a query."""

    def __init__(self, spark: SparkSession, sf_dir: str, made: dict[str, DataFrame] | None = None):
        self.spark, self.sf_dir = spark, sf_dir
        self.made: dict[str, DataFrame] = dict(made or {})
        self.built: dict[str, DataFrame] = dict(self.made)

    def __getattr__(self, name: str) -> DataFrame:
        if name not in VIEWS and name not in TABLES:
            raise AttributeError(name)
        if name not in self.built:
            self.built[name] = view(self.spark, self.sf_dir, name, self.made)
        return self.built[name]

    def blocks_of(self, pages: DataFrame, linked: bool = False, how: str = "inner", told: Callable[[DataFrame], DataFrame] | None = None, translations: bool = True) -> DataFrame:
        """Blocks (or linked blocks) of ``pages`` with their columns. Where blocks are not made yet, pages are met before the texts.

        With ``told`` blocks have, instead of their text, the columns that it adds to blocks without a translation.
        """
        if "blocks" in self.made or "linked_blocks" in self.made:
            rows = (self.linked_blocks if linked else self.blocks).join(pages, "page_id", how)
            rows = told(rows).drop("text") if told else rows
            return rows if translations else rows.drop("translation")
        return blocks_of(self.spark, self.sf_dir, pages, linked, how, told, translations)

    def keep(self, **columns: list[str]) -> Tables:
        """Views of which only some columns are made, once for all their uses in the query, also those below other views."""
        for name, kept in columns.items():
            if name not in self.made:
                self.made[name] = checkpointed(getattr(self, name).select(*kept))
                self.built = dict(self.made)
        return self

    def share(self, *names: str) -> Tables:
        """Views that are made once for all their uses in the query, also those below other views."""
        for name in names:
            if name not in self.made:
                self.made[name] = checkpointed(getattr(self, name))
                self.built = dict(self.made)
        return self


def query(sql: str | None = None, name: str | None = None) -> Callable:
    """Enter a function of ``Tables`` as a query, with its twin in DuckDB's SQL."""

    def enter(make: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        key = name or make.__name__
        QUERIES[key] = lambda spark, sf_dir: make(Tables(spark, sf_dir))
        if sql:
            ORACLE_SQL[key] = with_views(sql)
        return make

    return enter
