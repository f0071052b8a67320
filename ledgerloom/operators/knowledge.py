"""What reviewers have confirmed before: keys, lookup, merging, and readiness scoring."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.columns import top_per
from .accounts import recon_bucket

L = "ledger_id"

# --- keys --------------------------------------------------------------------------


def slug(c: Column) -> Column:
    """lower case, runs of anything else to '-', no dash at either end; whole, so that long names keep their own keys."""
    s = F.regexp_replace(F.lower(c), "[^a-z0-9]+", "-")
    s = F.regexp_replace(s, "^-|-$", "")
    return F.when(s == "", "unknown").otherwise(s)


# fixed values: 32-bit FNV-1a offset basis and prime, base-36 digits
FNV_BASIS, FNV_PRIME = 2166136261, 16777619


def short_hash(c: Column) -> Column:
    """FNV-1a over the UTF-16 code units of a text, as eight base-36 digits."""
    # utf-16be bytes in hex: four hex digits per code unit
    units = F.regexp_extract_all(F.hex(F.encode(c, "UTF-16BE")), F.lit("(.{4})"), F.lit(1))
    mask = F.lit(0xFFFFFFFF)

    def step(h: Column, u: Column) -> Column:
        x = h.bitwiseXOR(F.conv(u, 16, 10).cast("bigint"))
        return (x * F.lit(FNV_PRIME)).bitwiseAND(mask)

    folded = F.aggregate(units, F.lit(FNV_BASIS).cast("bigint"), step)
    return F.substring(F.lpad(F.lower(F.conv(folded.cast("string"), 10, 36)), 8, "0"), 1, 8)


def scan_key(code: Column, account: Column | None = None) -> Column:
    base = F.concat(F.lit("scan:"), slug(code))
    if account is None:
        return base
    return F.when(account.isNull(), base).otherwise(F.concat(base, F.lit(":"), slug(account)))


def recon_key(name: Column) -> Column:
    return F.concat(F.lit("recon:"), slug(name))


def flux_key(account: Column, period_end: Column, variance: Column) -> Column:
    label = F.coalesce(F.lower(F.date_format(period_end, "MMM")), F.lit("unknown"))
    return F.concat_ws(":", F.lit("flux"), slug(account), label, F.when(variance >= 0, "increase").otherwise("decrease"))


def agent_key(agent: Column, question: Column) -> Column:
    return F.concat_ws(":", F.lit("agent"), slug(agent), short_hash(question))


def manual_key(topic: Column) -> Column:
    return F.concat(F.lit("manual:"), slug(topic))


# --- lookup and policy ---------------------------------------------------------------

# fixed values: how far a finding may outgrow its confirmed scale
SCALE_FACTOR, EXPOSURE_BUFFER = 2, 50000


def knowledge_policy(knowledge: DataFrame) -> DataFrame:
    """May a match be applied without asking?  Only ALWAYS, and never a rejected one."""
    return knowledge.withColumn("can_auto", (F.col("auto_apply") == "ALWAYS") & (F.col("verdict") != "REJECTED"))


def knowledge_lookup(issues: DataFrame, knowledge: DataFrame) -> DataFrame:
    """Issues with the knowledge row of the same ledger and key, if any."""
    keyed = issues.withColumn("pattern_key", scan_key(F.col("code")))
    return keyed.join(knowledge, [L, "pattern_key"], "left")


def knowledge_autoresolve(issues: DataFrame, knowledge: DataFrame) -> DataFrame:
    """auto / hint per issue that a NORMAL, ALWAYS row covers.

    Knowledge without a stored scale resolves silently; otherwise the issue may
    be at most twice as large (rows), and twice plus a buffer (exposure).
    """
    usable = knowledge.filter((F.col("verdict") == "NORMAL") & (F.col("auto_apply") == "ALWAYS")).select(
        L, "pattern_key", "answer_id", "stored_rows", "stored_exposure")
    hit = knowledge_lookup(issues, usable).filter(F.col("answer_id").isNotNull())
    rows_up = F.coalesce(F.col("stored_rows").isNotNull() & (
        F.when(F.col("stored_rows") == 0, F.col("affected_rows") > 0)
        .otherwise(F.col("affected_rows") > SCALE_FACTOR * F.col("stored_rows"))), F.lit(False))
    money_up = F.coalesce(F.col("exposure") > F.col("stored_exposure") * SCALE_FACTOR + EXPOSURE_BUFFER, F.lit(False))
    return hit.select(L, "code", "pattern_key", "answer_id", F.when(rows_up | money_up, "hint").otherwise("auto").alias("decision"),
                      rows_up.alias("rows_outgrown"), money_up.alias("exposure_outgrown"))


HISTORY_CAP = 20


def knowledge_merge(answers: DataFrame, cap: int = HISTORY_CAP) -> DataFrame:
    """Fold answers (ledger_id, pattern_key, answered_at, answer_id, verdict, answer) into one row per key.

    The newest answer wins; reaffirmations are counted; the history keeps the
    newest ``cap`` entries.  The cap is applied by a per-key rank before the
    list is collected, so a key with any number of answers stays bounded.
    """
    keys = [L, "pattern_key"]
    counted = answers.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("reaffirmation_count"), F.max("answered_at").alias("last_reaffirmed_at"))
    newest = top_per(answers, keys, [F.col("answered_at").desc(), F.col("answer_id").desc()], cap)
    lists = newest.groupBy(*keys).agg(
        F.max_by("answer", F.struct("answered_at", "answer_id")).alias("answer"),
        F.transform(F.array_sort(F.collect_list(F.struct("answered_at", "answer_id", "verdict"))),
                    lambda s: s["verdict"]).alias("verdicts"))
    return counted.join(lists, keys)


RECURRING_MIN = 2


def recurring_patterns(items: DataFrame) -> DataFrame:
    """Watch items per ledger, case-insensitively counted.  ``items``: (ledger_id, item, seen_at)."""
    key = F.lower(F.trim("item"))
    agg = items.filter(key != "").groupBy(L, key.alias("pattern")).agg(
        F.count(F.lit(1)).alias("count"), F.max("seen_at").alias("last_seen"))
    return agg.withColumn("surfaced", F.col("count") >= RECURRING_MIN)


def knowledge_stats(knowledge: DataFrame) -> DataFrame:
    """Rows by verdict and by source with their embedding coverage."""
    def by(column: str) -> DataFrame:
        return knowledge.groupBy(F.lit(column).alias("facet"), F.col(column).alias("value")).agg(
            F.count(F.lit(1)).alias("rows"), F.count_if(F.col("embedding").isNotNull()).alias("with_embedding"))
    return by("verdict").unionByName(by("source")).withColumn(
        "coverage", F.round(F.col("with_embedding") / F.col("rows"), 4))


def data_hints(types: DataFrame, issues: DataFrame, period_end: str, k: int = 5) -> DataFrame:
    """Account counts by class, the year-end flag and the first five non-info issue codes per ledger."""
    bucket = F.coalesce(
        F.when(F.col("account_type") == "CURRENT_LIABILITY", "other").otherwise(recon_bucket(F.col("account_type"))),
        F.lit("other"))
    counts = types.groupBy(L).agg(*[
        F.count_if(bucket == b).alias(n) for b, n in (
            ("bank", "bank"), ("receivable", "ar"), ("payable", "ap"), ("tax", "tax"), ("inventory", "inventory"),
            ("other", "other"))])
    rank = F.when(F.col("severity") == "critical", 0).otherwise(1)
    order = [rank, F.coalesce("exposure", F.lit(0.0)).desc(), F.col("code")]
    top = (issues.filter("severity <> 'info'").withColumn("pos", F.row_number().over(Window.partitionBy(L).orderBy(*order)))
           .filter(F.col("pos") <= k))
    codes = top.groupBy(L).agg(F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct("pos", "code"))), lambda s: s["code"]), ",").alias("top_issues"))
    end = F.lit(period_end).cast("date")
    return counts.join(codes, L, "left").withColumn("year_end_likely", (F.month(end) == 3) & (F.day(end) >= 28))
