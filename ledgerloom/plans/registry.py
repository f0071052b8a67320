"""Registry of named queries, each with (where SQL can say it) a reference SQL text.

``uses`` names the shared CTEs a reference SQL needs; they are prepended in
dependency order so that every text stands alone.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

from ..functions.columns import party_columns
from ..operators import rollups, text_index
from ..sources import trade_ledger as tl
from ..sources.staging import built, staged

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
CTES: dict[str, tuple[tuple[str, ...], str]] = {}


@dataclass
class Data:
    """Lazily derived inputs of one query run."""

    spark: SparkSession
    sf_dir: str
    as_of: str = tl.AS_OF
    period: tuple[str, str] = field(default=tl.PERIOD)

    @cached_property
    def gl_all(self) -> DataFrame:
        """The ledger as ingested; each file in order of the trade's day, from which no voucher is more than 45 days off, so a
        period skips row groups."""
        return staged(self.spark, "gl", self.sf_dir, lambda: tl.gl_with_excluded(self.spark, self.sf_dir))

    @cached_property
    def gl(self) -> DataFrame:
        """The ledger every operator runs on: excluded rows dropped once, up front."""
        return self.gl_all.filter("NOT excluded")

    @cached_property
    def rollups(self) -> rollups.Rollups:
        """The maintained states of the ledger, written once like the ledger itself."""
        return built(self.spark, "rollups", self.sf_dir, lambda path: rollups.build(self.gl, path), lambda path: rollups.load(self.spark, path, self.gl))

    @cached_property
    def texts(self) -> text_index.TextIndex:
        """The whole ledger with its text index, written once; blocks small enough that the test ledgers have many."""
        return built(self.spark, "texts", self.sf_dir, lambda path: text_index.build(self.gl_all, path, block_rows=100_000),
                     lambda path: text_index.load(self.spark, path, self.gl_all))

    @cached_property
    def parties(self) -> DataFrame:
        """The party columns each ledger uses, stored: its size is known when a join is planned."""
        return staged(self.spark, "party_columns", self.sf_dir, lambda: party_columns(self.gl))

    @cached_property
    def overrides(self) -> DataFrame:
        return tl.account_overrides(self.spark, self.sf_dir)

    def table(self, name: str) -> DataFrame:
        return tl.read(self.spark, self.sf_dir, name)


def cte(name: str, sql: str, uses: tuple[str, ...] = ()) -> None:
    CTES[name] = (uses, sql)


def with_ctes(uses: tuple[str, ...], sql: str) -> str:
    ordered: list[str] = []

    def visit(name: str) -> None:
        if name in ordered:
            return
        for dep in CTES[name][0]:
            visit(dep)
        ordered.append(name)

    for name in uses:
        visit(name)
    if not ordered:
        return sql
    head = ",\n".join(f"{n} AS MATERIALIZED ({CTES[n][1]})" for n in ordered)
    body = sql.strip()
    if body.upper().startswith("WITH "):
        return f"WITH {head},\n{body[5:]}"
    return f"WITH {head}\n{body}"


def register(
    name: str,
    build: Callable[[Data], DataFrame],
    sql: str | None = None,
    uses: tuple[str, ...] = ("gl",),
) -> None:
    if name in QUERIES:
        raise ValueError(f"query {name} registered twice")
    QUERIES[name] = lambda spark, sf_dir: build(Data(spark, sf_dir))
    if sql is not None:
        ORACLES[name] = with_ctes(uses, sql)
