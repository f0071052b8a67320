"""Reconciliations: two independent sums of the same ledger against a threshold.

All templates that depend only on account, voucher type and attribution are
answered from ONE small rollup of the ledger, so running every reconciliation
for every ledger is a single pass with partial aggregation.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.columns import CR, DR, keyword_any, low, total_if
from .accounts import account_types, recon_bucket, with_account_type
from .checks import P0, P1, Ledger, with_period
from .rollups import Rollups

L = "ledger_id"

# fixed values: voucher type names
SALES_TYPES = ["sales", "tax invoice", "sales invoice"]
PURCHASE_TYPES = ["purchase", "purchase invoice"]
GOODS_IN_TYPES = ["purchase", "purchase invoice", "material receipt", "goods receipt"]
STOCK_TYPES = ["stock journal", "material receipt", "goods receipt", "purchase", "stock transfer"]


def _in_period() -> Column:
    return F.col("transaction_date").between(F.col(P0), F.col(P1))


def _filled(*columns: str) -> Column:
    return F.coalesce(F.coalesce(*columns) != "", F.lit(False))


def account_rollup(gl: Ledger) -> DataFrame:
    """(ledger, account, voucher type, attribution) sums in the period and up to its end."""
    net, upto = DR() - CR(), F.col("transaction_date") <= F.col(P1)
    if isinstance(gl, Rollups):
        return gl.by_attribution(_in_period(), upto)
    # the greatest of a text needs sorted rows: the ledger is first summed by group too, which needs none
    sums = gl.groupBy(
        L, "account_name", low("voucher_type").alias("vt"),
        _filled("vendor_name", "party_name").alias("has_vendor"), _filled("vendor_name").alias("vendor_col"),
        _filled("customer_name", "party_name").alias("has_customer"), _filled("customer_name").alias("customer_col"),
        F.col("reference_number").isNotNull().alias("has_ref"), "account_group",
    ).agg(
        total_if(_in_period(), DR()).alias("dr_p"), total_if(_in_period(), CR()).alias("cr_p"),
        total_if(_in_period(), net).alias("net_p"), total_if(upto, net).alias("net_e"))
    return sums.groupBy(L, "account_name", "vt", "has_vendor", "vendor_col", "has_customer", "customer_col", "has_ref").agg(
        F.max("account_group").alias("account_group"),
        *(F.sum(c).cast(sums.schema[c].dataType).alias(c) for c in ("dr_p", "cr_p", "net_p", "net_e")))


@dataclass(frozen=True)
class Template:
    """``bucket`` names the account class; a ledger without one falls back to ``fallback`` in the name."""

    name: str
    bucket: str | None
    fallback: list[str]
    source: Callable[[Column], Column]
    target: Callable[[Column], Column]
    threshold: float


def _when(cond: Column, value: Column) -> Column:
    return F.when(cond, value).otherwise(F.lit(0))


def _has(*words: str) -> Column:
    return keyword_any(["account_name"], words)


def _inventory_flow(_: Column) -> Column:
    goods_in = F.col("vt").isin(GOODS_IN_TYPES) & F.col("account_name").isNotNull() & ~_has("gst", "creditor", "payable")
    cogs = F.col("vt").isin(SALES_TYPES) & (low("account_name").startswith("cogs") | _has("cost of goods"))
    return F.when(goods_in, F.col("net_p")).when(cogs, -F.col("net_p")).otherwise(F.lit(0))


def _signed_gst(own: Column) -> Column:
    signed = (F.when(F.col("vt").isin(SALES_TYPES), F.col("cr_p"))
              .when(F.col("vt").isin(PURCHASE_TYPES), -F.col("dr_p")).otherwise(F.col("cr_p") - F.col("dr_p")))
    return _when(own, signed)


def _implied_gst(_: Column) -> Column:
    sales = F.col("vt").isin(SALES_TYPES) & low("account_name").startswith("sales")
    return _when(sales, -F.col("net_p")) * F.lit("0.18").cast("decimal(4,2)")


TEMPLATES = [
    Template("recon_ap", "payable", ["payable"], lambda own: _when(own, -F.col("net_e")),
             lambda own: _when(own & F.col("has_vendor"), -F.col("net_e")), 1),
    Template("recon_ar", "receivable", ["receivable"], lambda own: _when(own, F.col("net_e")),
             lambda own: _when(own & F.col("has_customer"), F.col("net_e")), 1),
    Template("recon_gst_output", None, ["cgst output", "sgst output", "igst output"],
             lambda own: _when(own, -F.col("net_p")), _implied_gst, 100),
    Template("recon_inventory", "inventory", ["stock"], lambda own: _when(own, F.col("net_p")), _inventory_flow, 1000),
    Template("recon_tpl_bank", "bank", ["bank"], lambda own: _when(own, -F.col("net_e")),
             lambda own: _when(own, -F.col("net_p")), 0),
    Template("recon_tpl_ap", "payable", ["payable"], lambda own: _when(own, F.col("net_e")),
             lambda own: _when(own & F.col("vendor_col"), F.col("net_e")), 1),
    Template("recon_tpl_ar", "receivable", ["receivable"], lambda own: _when(own, -F.col("net_e")),
             lambda own: _when(own & F.col("customer_col"), -F.col("net_e")), 1),
    Template("recon_tpl_gst", "tax", ["gst"], lambda own: _when(own, -F.col("net_p")), _signed_gst, 1),
    Template("recon_tpl_inventory", "inventory", ["stock"], lambda own: _when(own, F.col("net_e")),
             lambda own: _when(own & F.col("vt").isin(STOCK_TYPES), F.col("net_e")), 100),
]
BY_NAME = {t.name: t for t in TEMPLATES}


def watch_account(fragment: str) -> Template:
    """A reconciliation for accounts whose name holds ``fragment``."""
    return Template(
        "recon_watch_account", None, [], lambda own: _when(low("account_name").contains(fragment.lower()), F.col("net_p")),
        lambda own: _when(low("account_name").contains(fragment.lower()) & F.col("has_ref"), F.col("net_p")), 1)


def _status(agg: DataFrame, name: str, source: Column, target: Column, threshold: float) -> Column:
    variance = F.abs(source - target)
    return F.struct(
        F.lit(name).alias("recon"), F.round(source, 2).cast("double").alias("source_balance"),
        F.round(target, 2).cast("double").alias("target_balance"),
        F.round(variance, 2).cast("double").alias("variance"), F.lit(float(threshold)).alias("threshold"),
        F.when(variance <= threshold, "PASSED").otherwise("FAILED").alias("status"))


def _run(gl: Ledger, templates: list[Template], overrides: DataFrame | None) -> DataFrame:
    rows = account_rollup(gl)
    needs_types = any(t.bucket for t in templates)
    if needs_types:
        rows = with_account_type(rows, overrides).withColumn("bucket", recon_bucket(F.col("account_type")))
    aggs = []
    for t in templates:
        named = _has(*t.fallback) if t.fallback else F.lit(False)
        mapped = (F.coalesce(F.col("bucket") == t.bucket, F.lit(False)) & _filled("account_name")
                  if t.bucket else F.lit(False))
        aggs += [F.max(mapped).alias(f"{t.name}_has"),
                 F.sum(t.source(mapped)).alias(f"{t.name}_ms"), F.sum(t.target(mapped)).alias(f"{t.name}_mt"),
                 F.sum(t.source(named)).alias(f"{t.name}_ns"), F.sum(t.target(named)).alias(f"{t.name}_nt")]
    agg = rows.groupBy(L).agg(*aggs)

    def side(t: Template, s: str) -> Column:
        return F.when(F.col(f"{t.name}_has"), F.col(f"{t.name}_m{s}")).otherwise(F.col(f"{t.name}_n{s}"))

    out = [_status(agg, t.name, side(t, "s"), side(t, "t"), t.threshold) for t in templates]
    return agg.select(L, F.explode(F.array(*out)).alias("r")).select(L, "r.*")


def bucket_rows(gl: Ledger, overrides: DataFrame | None, bucket: str, fallback: list[str]) -> DataFrame:
    """Flag ``own`` per row: account of the bucket, or of the fallback name where the ledger has none."""
    types = account_types(gl, overrides).withColumn("hit", F.coalesce(
        recon_bucket(F.col("account_type")) == bucket, F.lit(False)))
    # the flag table holds one row per account: small next to the ledger, so Spark
    # broadcasts it when its size allows and shuffles it otherwise
    has = types.groupBy(L).agg(F.bool_or("hit").alias("_any"))
    own = F.when(F.coalesce("_any", F.lit(False)), F.coalesce("hit", F.lit(False))).otherwise(
        keyword_any(["account_name"], fallback))
    rows = gl.gl if isinstance(gl, Rollups) else gl
    return (rows.join(types.select(L, "account_name", "hit"), [L, "account_name"], "left").join(has, L, "left")
            .withColumn("own", own).drop("hit", "_any"))


def bank_vouchers(gl: Ledger, overrides: DataFrame | None = None) -> DataFrame:
    """Per voucher in the period: net of the bank legs, net of the others, and whether it touches bank."""
    flagged = bucket_rows(gl, overrides, "bank", ["bank"]).filter(_in_period())
    return flagged.groupBy(L, "reference_number").agg(
        total_if(F.col("own"), DR() - CR()).alias("bank_net"),
        total_if(~F.col("own"), CR() - DR()).alias("other_net"),
        F.bool_or("own").alias("touches_bank"),
        total_if(F.col("own"), DR() - CR()).alias("bank_gap"))


def recon_bank_internal(gl: Ledger, start: str, end: str, overrides: DataFrame | None = None) -> DataFrame:
    v = bank_vouchers(with_period(gl, start, end), overrides)
    sums = v.groupBy(L).agg(
        F.sum("bank_net").alias("s"),
        total_if(F.col("reference_number").isNotNull() & F.col("touches_bank"), F.col("other_net")).alias("t"))
    # a ledger with nothing in the period reconciles at zero
    nil = F.lit(0).cast("decimal(38,4)")
    ledgers = gl.ledgers() if isinstance(gl, Rollups) else gl.select(L).distinct()
    agg = ledgers.join(sums, L, "left").select(
        L, F.coalesce("s", nil).alias("s"), F.coalesce("t", nil).alias("t"))
    r = _status(agg, "recon_bank_internal", F.col("s"), F.col("t"), 1)
    return agg.select(L, r.alias("r")).select(L, "r.*")


def recon(name: str, gl: Ledger, start: str, end: str, overrides: DataFrame | None = None) -> DataFrame:
    if name == "recon_bank_internal":
        return recon_bank_internal(gl, start, end, overrides)
    return _run(with_period(gl, start, end), [BY_NAME[name]], overrides)


def recon_watch_account(gl: Ledger, start: str, end: str, fragment: str) -> DataFrame:
    return _run(with_period(gl, start, end), [watch_account(fragment)], None)


def recon_watch_party(gl: DataFrame, start: str, end: str, fragment: str) -> DataFrame:
    hit = low("party_name").contains(fragment.lower())
    net = DR() - CR()
    hit = hit & F.coalesce(_in_period(), F.lit(False))
    agg = with_period(gl, start, end).groupBy(L).agg(
        total_if(hit, net).alias("s"), total_if(hit & F.col("reference_number").isNotNull(), net).alias("t"))
    return agg.select(L, _status(agg, "recon_watch_party", F.col("s"), F.col("t"), 1).alias("r")).select(L, "r.*")


STANDARD = ["recon_ap", "recon_ar", "recon_gst_output", "recon_inventory"]


def recon_run(gl: Ledger, start: str, end: str, overrides: DataFrame | None = None) -> DataFrame:
    """Every template for every ledger."""
    rest = _run(with_period(gl, start, end), TEMPLATES, overrides)
    return rest.unionByName(recon_bank_internal(gl, start, end, overrides))


# --- detail rows of failed reconciliations -------------------------------------


def _failed(results: DataFrame, name: str) -> DataFrame:
    return results.filter((F.col("recon") == name) & (F.col("status") == "FAILED")).select(L)


def _lines(rows: DataFrame, *extra: Column) -> DataFrame:
    return rows.select(
        L, "row_id", "reference_number", "transaction_date", "account_name",
        F.col("debit_amount").cast("double").alias("debit_amount"),
        F.col("credit_amount").cast("double").alias("credit_amount"), *extra)


def unattributed_rows(name: str, gl: DataFrame, start: str, end: str, overrides: DataFrame | None = None) -> DataFrame:
    """Control-account rows with no vendor (``recon_ap``) or customer (``recon_ar``) of each failed ledger."""
    t = BY_NAME[name]
    who = "vendor_name" if name == "recon_ap" else "customer_name"
    rows = bucket_rows(with_period(gl, start, end), overrides, t.bucket, t.fallback)
    bare = rows.filter(F.col("own") & (F.col("transaction_date") <= F.col(P1))
                       & (F.coalesce(who, F.lit("")) == "") & (F.coalesce("party_name", F.lit("")) == ""))
    return _lines(bare.join(_failed(recon(name, gl, start, end, overrides), name), L, "left_semi"))


def voucher_anti(gl: DataFrame, start: str, end: str) -> DataFrame:
    """In-period sales rows whose voucher has no GST leg anywhere (rows without a reference never qualify)."""
    gst = gl.filter(keyword_any(["account_name"], ["gst"]) & F.col("reference_number").isNotNull()).select(
        L, "reference_number")
    sales = with_period(gl, start, end).filter(
        _in_period() & low("voucher_type").isin(SALES_TYPES) & F.col("reference_number").isNotNull())
    return sales.join(gst, [L, "reference_number"], "left_anti")


def voucher_semi(gl: DataFrame, start: str, end: str) -> DataFrame:
    """In-period non-bank legs of the vouchers that touch a bank or cash account."""
    slice_ = with_period(gl, start, end).filter(_in_period())
    bank = keyword_any(["account_name"], ["bank", "cash"])
    touching = slice_.filter(bank & F.col("reference_number").isNotNull()).select(L, "reference_number")
    return slice_.filter(~bank).join(touching, [L, "reference_number"], "left_semi")


def unbalanced_bank_rows(gl: DataFrame, start: str, end: str, overrides: DataFrame | None = None) -> DataFrame:
    """Legs of the bank vouchers whose bank legs do not net to zero, of each failed ledger."""
    v = bank_vouchers(with_period(gl, start, end), overrides)
    bad = v.filter(F.col("touches_bank") & F.col("reference_number").isNotNull() & (F.abs("bank_gap") > 0.01))
    rows = gl.join(bad.select(L, "reference_number"), [L, "reference_number"], "left_semi")
    rows = rows.join(_failed(recon_bank_internal(gl, start, end, overrides), "recon_bank_internal"), L, "left_semi")
    return _lines(rows)


def control_rows(name: str, gl: DataFrame, start: str, end: str, overrides: DataFrame | None = None) -> DataFrame:
    """All in-period rows of the control accounts of a failed ledger (bank, GST and stock templates)."""
    t = BY_NAME[name]
    rows = bucket_rows(with_period(gl, start, end), overrides, t.bucket, t.fallback)
    rows = rows.filter(F.col("own") & _in_period())
    rows = rows.join(_failed(recon(name, gl, start, end, overrides), name), L, "left_semi")
    return _lines(rows, (CR() - DR()).cast("double").alias("net"))


def party_outstanding(name: str, gl: DataFrame, start: str, end: str, overrides: DataFrame | None = None) -> DataFrame:
    """All party balances on the control accounts of a failed ledger (AP / AR templates)."""
    t = BY_NAME[name]
    sign = 1 if name == "recon_tpl_ap" else -1
    who = F.coalesce("party_name", "vendor_name" if sign == 1 else "customer_name", "account_name")
    rows = bucket_rows(with_period(gl, start, end), overrides, t.bucket, t.fallback)
    agg = rows.filter(F.col("own") & (F.col("transaction_date") <= F.col(P1))).groupBy(L, who.alias("party")).agg(
        (F.sum(DR() - CR()) * sign).alias("o")).filter(F.abs("o") > 0.01)
    agg = agg.join(_failed(recon(name, gl, start, end, overrides), name), L, "left_semi")
    return agg.select(
        L, "party", F.round("o", 2).cast("double").alias("outstanding"))
