"""Close readiness: six weighted scores and four hard gates per ledger."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

L = "ledger_id"

# fixed values: weights, thresholds, gates
WEIGHTS = {"data_integrity": 0.30, "period_scope": 0.10, "reconciliation": 0.25, "compliance": 0.10,
           "variance_analysis": 0.15, "workflow_progress": 0.10}
READY, WARNING = 80, 50
MAX_IMBALANCE, MAX_MISSING, MAX_DUPLICATES = 1000, 20, 5
NO_SCAN = {"data_integrity": 50, "period_scope": 70, "compliance": 80}


def _clamp(c: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(100.0), c.cast("double")))


def scan_facts(issues: DataFrame) -> DataFrame:
    """The issue counts scoring needs, one row per ledger."""
    def rows(code: str) -> Column:
        return F.coalesce(F.max(F.when(F.col("code") == code, F.col("affected_rows"))), F.lit(0))

    return issues.groupBy(L).agg(
        F.count_if(F.col("severity") == "critical").alias("critical"),
        F.count_if(F.col("severity") == "review").alias("review"),
        *[rows(c).alias(c) for c in ("date_outliers", "missing_fields", "gst_mismatch", "sign_anomalies",
                                     "duplicate_transactions")],
        F.coalesce(F.max(F.when(F.col("code") == "voucher_imbalance", F.col("exposure"))), F.lit(0.0)).alias("imbalance"))


def readiness_facts(ledgers: DataFrame, issues: DataFrame, recons: DataFrame | None, flux_totals: DataFrame | None,
                    tasks: DataFrame, imbalance: DataFrame | None = None) -> DataFrame:
    """Join the inputs of the scores.

    ``tasks``: (ledger_id, completed, total).  ``imbalance``: voucher-imbalance
    issues, where the scan itself no longer runs that check.
    """
    facts = scan_facts(issues if imbalance is None else issues.unionByName(imbalance))
    if imbalance is not None:
        # the older check feeds its gate only; it is not one of the scored issues
        own = imbalance.groupBy(L).agg(F.count(F.lit(1)).alias("_extra"))
        facts = facts.join(own, L, "left").withColumn(
            "critical", F.col("critical") - F.coalesce("_extra", F.lit(0))).drop("_extra")
    out = ledgers.select(L).distinct().join(facts.withColumn("scanned", F.lit(True)), L, "left")
    if recons is not None:
        out = out.join(recons.groupBy(L).agg(
            F.count_if(F.col("status") == "PASSED").alias("passed"), F.count_if(F.col("status") == "FAILED").alias("failed"),
            F.count(F.lit(1)).alias("recons")), L, "left")
    if flux_totals is not None:
        out = out.join(flux_totals.select(L, "material_count"), L, "left")
    out = out.join(tasks, L, "left")
    for c in ("passed", "failed", "recons", "explained"):
        if c not in out.columns:
            out = out.withColumn(c, F.lit(0))
    if "material_count" not in out.columns:
        out = out.withColumn("material_count", F.lit(None).cast("bigint"))
    return out.fillna(0, ["passed", "failed", "recons", "explained", "completed", "total", "critical", "review",
                          "date_outliers", "missing_fields", "gst_mismatch", "sign_anomalies",
                          "duplicate_transactions"]).fillna(0.0, ["imbalance"]).fillna(False, ["scanned"])


def _scores() -> dict[str, Column]:
    c = F.col
    scanned = c("scanned")
    integrity = 100 - F.least(F.lit(40), c("critical") * 10) - F.least(F.lit(15), c("review") * 3)
    scope = 100 - F.least(F.lit(30), c("date_outliers") * 2) - F.least(F.lit(20), c("missing_fields"))
    compliance = 100 - F.least(F.lit(40), c("gst_mismatch") * 5) - F.least(F.lit(20), c("sign_anomalies") * 5)
    recon = F.try_divide(c("passed"), c("recons")) * 100 - F.try_divide(c("failed"), c("recons")) * 30
    flux = 100 - (c("material_count") - c("explained")) * 10
    return {
        "data_integrity": F.when(scanned, _clamp(integrity)).otherwise(float(NO_SCAN["data_integrity"])),
        "period_scope": F.when(scanned, _clamp(scope)).otherwise(float(NO_SCAN["period_scope"])),
        "reconciliation": F.when(c("recons") == 0, 50.0).otherwise(_clamp(recon)),
        "compliance": F.when(scanned, _clamp(compliance)).otherwise(float(NO_SCAN["compliance"])),
        "variance_analysis": F.when(c("material_count").isNull(), 40.0).when(c("material_count") == 0, 100.0)
        .otherwise(_clamp(flux)),
        "workflow_progress": F.when(c("total") == 0, 0.0).otherwise(
            _clamp(F.try_divide(c("completed"), c("total")) * 100)),
    }


def readiness_dimensions(facts: DataFrame) -> DataFrame:
    return facts.select("*", *[F.round(v, 4).alias(k) for k, v in _scores().items()])


def readiness_gates(facts: DataFrame) -> DataFrame:
    return facts.select(
        "*", (F.col("imbalance") <= MAX_IMBALANCE).alias("gate_vouchers"),
        (F.col("missing_fields") <= MAX_MISSING).alias("gate_fields"),
        (F.col("duplicate_transactions") <= MAX_DUPLICATES).alias("gate_duplicates"),
        (F.col("total") > 0).alias("gate_tasks"))


def readiness_score(facts: DataFrame) -> DataFrame:
    scored = readiness_gates(readiness_dimensions(facts))
    total = sum((F.col(k) * w for k, w in WEIGHTS.items()), F.lit(0.0))
    ok = F.col("gate_vouchers") & F.col("gate_fields") & F.col("gate_duplicates") & F.col("gate_tasks")
    score = F.round(F.round(total, 6), 0).cast("int")
    return scored.select(
        L, *WEIGHTS, "gate_vouchers", "gate_fields", "gate_duplicates", "gate_tasks", score.alias("score"),
        F.when(~ok, "blocked").when(score >= READY, "ready").when(score >= WARNING, "warning").otherwise("blocked")
        .alias("status"))
