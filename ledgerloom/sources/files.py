"""Reading exported files and reading / writing the canonical ledger."""

from __future__ import annotations

import re
from collections.abc import Iterator
from urllib.parse import unquote

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .schema import AMOUNT_COLUMNS, DATE_COLUMNS, GL_SCHEMA, MONEY, conform

DELIMITERS = [",", "\t", ";", "|"]
QUOTED = r'"[^"]*"'


def pick_delimiter(record: str) -> str:
    """The most frequent candidate outside quotes; earlier candidates win ties."""
    bare = re.sub(QUOTED, "", record)
    return max(DELIMITERS, key=lambda d: (bare.count(d), -DELIMITERS.index(d)))


def _open_quote(record: Column) -> Column:
    return F.length(F.regexp_replace(record, '[^"]', "")) % 2 == 1


def _to_quote_end(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The first record of each file, whose lines come in order; a file's later lines are passed over."""
    heads: dict[str, list[str]] = {}
    odd: dict[str, bool] = {}
    for batch in batches:
        for file, value in zip(batch["file"], batch["value"]):
            if odd.get(file, True) and (heads.get(file) or value.strip()):
                heads.setdefault(file, []).append(value)
                odd[file] = odd.get(file, False) ^ (value.count('"') % 2 == 1)
    yield pd.DataFrame({"file": list(heads), "head": ["\n".join(v) for v in heads.values()]})


def first_records(spark: SparkSession, path: str) -> DataFrame:
    """(file, head): the first record of each file, line breaks inside quotes included; files without one are left out.

    One aggregate keeps the first line that is not blank of each file.  Only files whose first line leaves a
    quote open are read again, by their first split.
    """
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("at"), "value")
    lines = lines.filter("at = 0")
    first = lines.filter(F.trim("value") != "").withColumn("n", F.monotonically_increasing_id()).groupBy("file").agg(F.min_by("value", "n").alias("head"))
    broken = [r.file for r in first.filter(_open_quote(F.col("head"))).select("file").collect()]
    if not broken:
        return first
    whole = lines.filter(F.col("file").isin(broken)).select("file", "value").mapInPandas(_to_quote_end, "file string, head string")
    return first.filter(~_open_quote(F.col("head"))).unionByName(whole)


def src_delimited(spark: SparkSession, path: str, breaks: bool = False) -> DataFrame:
    """CSV / TSV, each file by its own delimiter and header; every value a trimmed string, ragged rows kept.

    Files with equal first records are read together, and groups are joined by column name, missing columns
    NULL; columns stand in the order of the first file that has them.  ``breaks`` says that values hold line breaks,
    which keeps files from being split; a header with one implies it for its files,
    whose paths must then hold none of ``[]{}*?``.  No file with a record
    gives no columns and no rows.  The driver holds a path and a header for each file, as Spark's own listing does.
    """
    groups: dict[str, list[str]] = {}
    for r in first_records(spark, path).orderBy("file").collect():
        groups.setdefault(r.head, []).append(re.sub(r"([{}\[\]*?\\])", r"\\\1", unquote(r.file)))
    out = None
    for head, files in groups.items():
        df = (
            spark.read.option("header", True).option("sep", pick_delimiter(head.lstrip("\ufeff")))
            .option("ignoreLeadingWhiteSpace", True).option("ignoreTrailingWhiteSpace", True)
            .option("mode", "PERMISSIVE").option("quote", '"').option("escape", '"').option("enforceSchema", False)
            .option("multiLine", breaks or "\n" in head).csv(files))
        df = df.toDF(*[c.lstrip("\ufeff").strip() for c in df.columns])
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    return spark.createDataFrame([], "struct<>") if out is None else out


def parse_number(c: Column) -> Column:
    """Currency signs, commas and spaces dropped, then the number the text starts with; NULL when there is none."""
    clean = F.regexp_replace(c, r"[₹$€£,\s]", "")
    return F.regexp_extract(clean, r"^[+-]?\d*\.?\d+(?:[eE][+-]?\d+)?", 0).try_cast(MONEY)


def parse_day(c: Column) -> Column:
    """d/m/y with a two- or four-digit year, else ISO."""
    s = F.trim(c)
    parts = r"^(\d{1,2})[/-](\d{1,2})[/-](\d{2,4})$"
    year = F.regexp_extract(s, parts, 3)
    year = F.when(F.length(year) == 2, F.concat(F.lit("20"), year)).otherwise(year)
    dmy = F.concat_ws("-", year, F.lpad(F.regexp_extract(s, parts, 2), 2, "0"), F.lpad(F.regexp_extract(s, parts, 1), 2, "0"))
    return F.when(s.rlike(parts), dmy.try_cast("date")).otherwise(F.substring(s, 1, 10).try_cast("date"))


def canonicalise_gl(raw: DataFrame, mapping: dict[str, str], ledger_id: Column, row_id: Column) -> DataFrame:
    """Apply a resolved mapping {source column: canonical column} and cast to the canonical types.

    A side left blank becomes 0 when the other side is there, so that sums over
    ``debit - credit`` hold; both blank stay NULL.
    """
    cols = []
    for source, canon in mapping.items():
        c = F.col(f"`{source}`")
        c = F.when(F.trim(c) != "", c)
        if canon in AMOUNT_COLUMNS:
            c = parse_number(c)
        elif canon in DATE_COLUMNS:
            c = parse_day(c)
        cols.append(c.alias(canon))
    df = conform(raw.select(ledger_id.alias("ledger_id"), row_id.alias("row_id"), *cols))
    dr, cr = F.col("debit_amount"), F.col("credit_amount")
    zero = F.lit(0).cast(MONEY)
    return df.withColumns({
        "debit_amount": F.when(dr.isNull() & cr.isNotNull(), zero).otherwise(dr),
        "credit_amount": F.when(cr.isNull() & dr.isNotNull(), zero).otherwise(cr),
        "net_amount": F.coalesce("net_amount", (F.coalesce(dr, zero) - F.coalesce(cr, zero)).cast(MONEY)),
        "excluded": F.coalesce("excluded", F.lit(False)),
    })


#: Ledger-months are not cut into files of fewer rows.
LEAST_ROWS = 500_000
#: Rows that one task of a sink puts in order, few enough to be held in memory.
TASK_ROWS = 250_000


def sink_gl(gl: DataFrame, path: str, rows_per_file: int | None = None, mode: str = "overwrite") -> None:
    """Write the ledger by ledger and month; ``mode`` ``append`` adds late rows beside what is there.

    A histogram of the ledger-months, undated rows being one of them, sets into how many slices each is cut, so that no
    file holds more than ``rows_per_file`` rows: by default the median ledger-month, or LEAST_ROWS where that is larger.
    An empty ledger writes no file.
    """
    gl = gl.withColumn("month", F.coalesce(F.date_format("transaction_date", "yyyy-MM"), F.lit("none")))
    sizes = gl.groupBy("ledger_id", "month").agg(F.count(F.lit(1)).alias("_rows"))
    median, rows = sizes.agg(F.percentile_approx("_rows", 0.5), F.sum("_rows")).first()
    if rows_per_file is None:
        rows_per_file = max(int(median or 0), LEAST_ROWS)
    # more tasks than the session's where those would have to spill what they sort
    tasks = -(-int(rows or 0) // TASK_ROWS)
    more = [tasks] if tasks > int(gl.sparkSession.conf.get("spark.sql.shuffle.partitions")) else []
    # only ledger-months above the bound travel to the rows; a missing ledger is one, too.  Each stands for rows_per_file rows or more,
    # so they are few, and the rows need not be shuffled to meet them
    large = sizes.filter(F.col("_rows") > rows_per_file).select(
        F.col("ledger_id").alias("_l"), F.col("month").alias("_m"), F.ceil(F.col("_rows") / rows_per_file).alias("_slices"))
    dealt = gl.join(F.broadcast(large), F.col("ledger_id").eqNullSafe(F.col("_l")) & (F.col("month") == F.col("_m")), "left").withColumn(
        "_part", F.pmod(F.xxhash64("row_id", "transaction_date", "reference_number", "account_name"), F.coalesce("_slices", F.lit(1))))
    (dealt.drop("_l", "_m", "_slices").repartition(*more, "ledger_id", "month", "_part").sortWithinPartitions("ledger_id", "month", "_part", "transaction_date")
     .drop("_part").write.mode(mode).option("compression", "zstd").option("maxRecordsPerFile", rows_per_file).partitionBy("ledger_id", "month").parquet(path))


def scan_gl(spark: SparkSession, path: str, ledgers: list[int] | None = None, start: str | None = None,
            end: str | None = None) -> DataFrame:
    """Read the written ledger; ledger and date bounds prune partitions and row groups."""
    df = spark.read.parquet(path)
    if ledgers is not None:
        df = df.filter(F.col("ledger_id").isin(ledgers))
    if start is not None:
        df = df.filter((F.col("transaction_date") >= F.lit(start).cast("date")) & (F.col("month") >= start[:7]))
    if end is not None:
        df = df.filter((F.col("transaction_date") <= F.lit(end).cast("date")) & (F.col("month") <= end[:7]))
    return df.select(*GL_SCHEMA.fieldNames())


def src_tally_collection(spark: SparkSession, path: str, row_tag: str) -> DataFrame:
    """Rows of a collection in exported XML; attributes become plain columns."""
    df = spark.read.format("xml").option("rowTag", row_tag).option("attributePrefix", "").load(path)
    return df.toDF(*[re.sub(r"^@?_", "", c) for c in df.columns])


ROWS = "array<map<string,string>>"


def src_zoho_report(spark: SparkSession, path: str) -> DataFrame:
    """Report JSON, one document per line or file: the rows of its first non-empty report with their ``_section``.

    Returns (doc, _section, fields map).
    """
    docs = spark.read.text(path).filter(F.trim("value") != "").withColumn("doc", F.input_file_name())
    flat = F.from_json("value", f"map<string,{ROWS}>")
    deep = F.from_json("value", f"map<string,map<string,{ROWS}>>")

    def entries(m: Column, depth: int) -> Column:
        return F.filter(F.map_entries(m), lambda e: F.size(e["value"]) > 0 if depth else e["value"].isNotNull())

    nested = docs.select("doc", F.explode(F.map_entries(F.get(entries(deep, 1), 0)["value"])).alias("s")).select(
        "doc", F.col("s.key").alias("_section"), F.explode("s.value").alias("fields"))
    plain = docs.filter(F.size(entries(deep, 1)) <= 0).select(
        "doc", F.lit(None).cast("string").alias("_section"), F.explode(F.get(entries(flat, 1), 0)["value"]).alias("fields"))
    return nested.unionByName(plain)


SCAN_CSV = ["severity", "code", "category", "title", "affected_rows", "exposure_inr", "description"]


def sink_scan_csv(issues: DataFrame, path: str) -> None:
    """Issues as CSV with seven columns, a folder per ledger."""
    issues.select(
        "ledger_id", "severity", "code", "category", "title", "affected_rows",
        F.coalesce("exposure", F.lit(0.0)).alias("exposure_inr"), F.coalesce("detail", "title").alias("description"),
    ).write.mode("overwrite").option("header", True).partitionBy("ledger_id").csv(path)
