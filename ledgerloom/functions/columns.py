"""Column builders shared by the operators: keywords, parties, money."""

from __future__ import annotations

import re
from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F


def as_col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def low(c: str | Column) -> Column:
    """lower(coalesce(c, ''))."""
    return F.lower(F.coalesce(as_col(c), F.lit("")))


def one_of(keywords: Iterable[str]) -> str:
    """A pattern that finds any keyword; ``%`` inside a keyword is a gap that no separator lies in.

    Keywords are tried by their first letter, and only where one of these stands, not all at every place.
    """
    heads: dict[str, list[str]] = {}
    for k in keywords:
        pattern = r"[^\x01]*".join(re.escape(p) for p in k.split("%"))
        first = re.escape(k[:1]) if k[:1] != "%" else ""
        heads.setdefault(first, []).append(pattern[len(first):])
    tried = "|".join(f"{first}(?:{'|'.join(rest)})" for first, rest in heads.items())
    return f"(?:{tried})" if "" in heads else f"(?=[{''.join(heads)}])(?:{tried})"


def keyword_any(columns: Sequence[str | Column], keywords: Iterable[str]) -> Column:
    """True when any column holds any keyword; ``%`` inside a keyword is a gap.

    One pattern runs once over the columns joined by a separator no keyword
    (and no gap) can cross.
    """
    text = low(columns[0]) if len(columns) == 1 else F.lower(F.concat_ws("\x01", *[as_col(c) for c in columns]))
    return text.rlike(one_of(keywords))


def num(c: str | Column) -> Column:
    return F.coalesce(as_col(c), F.lit(0))


def DR() -> Column:
    return num("debit_amount")


def CR() -> Column:
    return num("credit_amount")


def money(c: Column, places: int = 2) -> Column:
    """Round at the query boundary and hand out a double."""
    return F.round(c, places).cast("double")


def total(c: Column) -> Column:
    return F.sum(c)


def total_if(cond: Column, c: Column) -> Column:
    return F.sum(F.when(cond, c).otherwise(F.lit(0)))


def month(c: str | Column = "transaction_date") -> Column:
    return F.date_format(as_col(c), "yyyy-MM")


def best_vendor() -> Column:
    return F.coalesce("vendor_name", "party_name", "account_name")


def first_nonzero(*columns: str) -> Column:
    """The first of the columns that is neither null nor zero (a missing side is stored as 0), else 0."""
    return F.coalesce(*[F.nullif(F.col(c), F.lit(0)) for c in columns], F.lit(0))


def party_columns(gl: DataFrame) -> DataFrame:
    """Per ledger, the column that names its vendors and the one that names its customers.

    The specific column where any row of the ledger fills it, else
    ``party_name``, else ``account_name``.  One row per ledger.
    """
    def chosen(specific: str) -> Column:
        return (F.when(F.count(specific) > 0, F.lit(specific))
                .when(F.count("party_name") > 0, F.lit("party_name")).otherwise(F.lit("account_name")))

    return gl.groupBy("ledger_id").agg(
        chosen("vendor_name").alias("vendor_column"), chosen("customer_name").alias("customer_column"))


def with_parties(gl: DataFrame, choice: DataFrame) -> DataFrame:
    """Adds ``vendor_party`` and ``customer_party``: the value of the ledger's chosen column, null where that is null."""
    def value(column: str, specific: str) -> Column:
        return (F.when(F.col(column) == specific, F.col(specific))
                .when(F.col(column) == "party_name", F.col("party_name")).otherwise(F.col("account_name")))

    return gl.join(choice, "ledger_id", "left").withColumns({
        "vendor_party": value("vendor_column", "vendor_name"),
        "customer_party": value("customer_column", "customer_name")}).drop("vendor_column", "customer_column")


def any_party() -> Column:
    return F.coalesce("party_name", "vendor_name", "customer_name", "account_name")


def best_debit() -> Column:
    return F.coalesce("debit_amount", "net_amount", F.lit(0))


def best_credit() -> Column:
    return F.coalesce("credit_amount", "net_amount", F.lit(0))


def effective_amount() -> Column:
    """|net| when net is non-zero, else |debit or credit|."""
    net = num("net_amount")
    return F.when(net != 0, F.abs(net)).otherwise(F.abs(F.when(DR() != 0, DR()).otherwise(CR())))


def not_excluded(df: DataFrame) -> DataFrame:
    return df.filter(~F.coalesce(F.col("excluded"), F.lit(False)))


def in_period(start: str | Column, end: str | Column) -> Column:
    lo = F.lit(start).cast("date") if isinstance(start, str) else start
    hi = F.lit(end).cast("date") if isinstance(end, str) else end
    return F.col("transaction_date").between(lo, hi)


def natural_order(key: str) -> Column:
    """A text key whose numbers (of up to 20 digits) sort by value: "9-1" comes before "10-1"."""
    return F.regexp_replace(F.regexp_replace(key, r"(\d+)", "0" * 20 + "$1"), r"\d*(\d{20})", "$1")


def top_per(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int) -> DataFrame:
    """Top ``k`` rows per key.

    ``row_number() <= k`` lets Spark apply a partial group limit before the
    shuffle, so a ledger holding a third of the rows ships k rows per task.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= k).drop("_rn")
