"""Account classification: chart-of-accounts group, then name, then confirmed overrides."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .rollups import Rollups

# fixed values: the financial account types
ACCOUNT_TYPES = [
    "REVENUE", "COGS", "EXPENSE", "OTHER_INCOME", "CURRENT_ASSET", "FIXED_ASSET", "INVESTMENT",
    "CASH", "BANK", "RECEIVABLE", "INVENTORY", "CURRENT_LIABILITY", "LONG_TERM_LIABILITY",
    "PAYABLE", "EQUITY", "TAX", "UNKNOWN",
]

# fixed values: account group (lower case) -> type, default chart of accounts
GROUP_TYPES = {
    "REVENUE": ["sales accounts", "sales", "direct incomes", "income", "revenue"],
    "OTHER_INCOME": ["indirect incomes", "other income"],
    "COGS": ["purchase accounts", "purchases", "direct expenses", "cost of goods sold"],
    "EXPENSE": ["indirect expenses", "expenses", "overhead", "depreciation", "salaries", "wages",
                "administration expenses", "selling expenses"],
    "FIXED_ASSET": ["fixed assets", "plant & machinery", "furniture & fittings", "vehicles",
                    "computer equipment", "office equipment", "land & building"],
    "INVESTMENT": ["investments", "investment"],
    "INVENTORY": ["stock-in-hand", "stock in hand", "closing stock", "inventory", "raw materials",
                  "finished goods", "work-in-progress"],
    "RECEIVABLE": ["sundry debtors", "debtors", "trade receivables", "accounts receivable",
                   "debtors (domestic)", "debtors (foreign)"],
    "CASH": ["cash-in-hand", "cash in hand", "petty cash"],
    "BANK": ["bank accounts", "bank", "bank o/d accounts", "bank od accounts"],
    "CURRENT_ASSET": ["loans & advances (asset)", "loans and advances (asset)", "deposits (asset)",
                      "advance to suppliers", "prepaid expenses", "other current assets",
                      "current assets", "misc. expenses (asset)"],
    "PAYABLE": ["sundry creditors", "creditors", "trade payables", "accounts payable",
                "creditors (domestic)", "creditors (foreign)"],
    "TAX": ["duties & taxes", "duties and taxes", "gst payable", "tds payable", "service tax", "income tax"],
    "CURRENT_LIABILITY": ["provisions", "current liabilities", "other current liabilities",
                          "advance from customers"],
    "EQUITY": ["capital account", "capital", "reserves & surplus", "reserves and surplus",
               "retained earnings", "share capital"],
    "LONG_TERM_LIABILITY": ["secured loans", "unsecured loans", "loans (liability)", "term loans", "bank loans"],
}

# fixed values: account type names of exported report JSON (lower case) -> type
EXPORT_TYPES = {
    "REVENUE": ["income", "sales"],
    "OTHER_INCOME": ["other_income"],
    "EXPENSE": ["expense", "other_expense"],
    "COGS": ["cost_of_goods_sold"],
    "FIXED_ASSET": ["fixed_asset"],
    "CURRENT_ASSET": ["other_asset", "current_asset", "other_current_asset"],
    "CASH": ["cash"],
    "BANK": ["bank"],
    "RECEIVABLE": ["accounts_receivable"],
    "INVENTORY": ["stock"],
    "CURRENT_LIABILITY": ["current_liability", "other_current_liability", "credit_card", "other_liability"],
    "LONG_TERM_LIABILITY": ["long_term_liability"],
    "PAYABLE": ["accounts_payable"],
    "EQUITY": ["equity", "retained_earnings"],
}

# fixed values: name patterns in order, first match wins (order is meaning: tax before payable,
# petty cash before bank).  The last item of a rule, where given, vetoes the match.
NAME_RULES = [
    ("CASH", r"\b(petty\s+cash|cash[- ]in[- ]hand|cash a\/?c|cash account)\b|^cash$", None),
    ("BANK", r"\b(bank|hdfc|icici|sbi|axis|kotak|yes bank|bob|pnb|uco|canara|union bank|idfc|indusind|"
             r"bank of baroda|bank of india|punjab national|state bank|current a\/?c|savings a\/?c|"
             r"cash credit|overdraft|od a\/?c)\b", None),
    ("TAX", r"\b(cgst|sgst|igst|gst|tds|tcs|vat|service tax|professional tax|composition tax|"
            r"duties\s*&?\s*taxes|duties and taxes)\b", None),
    ("RECEIVABLE", r"\b(sundry debtor|trade receivable|accounts? receivable|debtor|receivable)s?\b", None),
    ("PAYABLE", r"\b(sundry creditor|trade payable|accounts? payable|creditor|payable)s?\b", None),
    ("INVENTORY", r"\b(stock[- ]in[- ]hand|finished goods(?:\s+stock)?|raw material[- ]?stock|wip|"
                  r"work[- ]in[- ]progress|inventory)\b", None),
    ("INVENTORY", r"\bstock\b", r"\bstock\s+(?:journal|take)\b"),
    ("FIXED_ASSET", r"\b(plant\s*&?\s*machinery|machinery|equipment|vehicle|trucks?|vehicles|furniture|fixtures|"
                    r"computers?|laptops?|building|land|premises|fixed asset|capital wip|medical equipment|"
                    r"restaurant equipment|looms|x[- ]ray)\b", None),
    ("REVENUE", r"^sales\b|\bsales account\b", None),
    ("REVENUE", r"\b(tuition fees|registration fees|service income|freight income|cargo handling|"
                r"consultation fees income|diagnostic service income|restaurant sales|project revenue|"
                r"export sales|domestic sales|service revenue)\b", None),
    ("REVENUE", r"\b(income)\b", r"other income"),
    ("OTHER_INCOME", r"\b(other income|interest received|dividend received|rent received|"
                     r"miscellaneous income)\b", None),
    ("COGS", r"^purchases?\b|\b(raw material|cement|steel\s*&?\s*tmt|cotton yarn|dyes|chemicals|subcontractor|"
             r"site wages|factory wages|kitchen wages|driver salaries|fuel\s*-?\s*diesel|toll charges|vegetable|"
             r"meat\s*&?\s*poultry|spices\s*&?\s*provisions|lab reagents|medical consumables|"
             r"power\s*&?\s*fuel)\b|\b(mobile phones?|laptops?|tablets?|accessories|electronics)\s*-", None),
    ("EXPENSE", r"\b(rent|salary|salaries|wages|electricity|telephone|internet|charges|expense|expenses|bonus|"
                r"maintenance|travelling|travel|office|admin|administrative|stationery|printing|courier|postage|"
                r"audit|legal|consultancy|consulting|insurance|professional fees|repairs|advertisement|marketing|"
                r"warehouse rent|building rent|software subscriptions?|aws cloud|cloud services|study material|"
                r"faculty|discount allowed|discount given)\b", None),
    ("EQUITY", r"\b(capital|drawings|equity|reserves|retained earnings|share capital)\b", None),
    ("CURRENT_LIABILITY", r"\b(advance from customer|provident fund|employee provident|pf payable|esi payable|"
                          r"gratuity|bonus payable)\b", None),
]


def classify_by_group(group: Column) -> Column:
    """Type of a chart-of-accounts group, or NULL when the group is not a standard one."""
    key = F.lower(F.trim(group))
    out = F.lit(None).cast("string")
    for table in (EXPORT_TYPES, GROUP_TYPES):
        for kind, groups in table.items():
            out = F.when(key.isin(groups), F.lit(kind)).otherwise(out)
    return out


def classify_by_name(name: Column) -> Column:
    """Type read off the account name, UNKNOWN when no pattern matches."""
    n = F.trim(F.lower(name))
    out = F.lit("UNKNOWN")
    for kind, pattern, veto in reversed(NAME_RULES):
        hit = n.rlike(pattern)
        if veto:
            hit = hit & ~n.rlike(veto)
        out = F.when(hit, F.lit(kind)).otherwise(out)
    return out


def accounts_of(gl: DataFrame | Rollups) -> DataFrame:
    """The distinct accounts of each ledger with the group they post under."""
    if isinstance(gl, Rollups):
        return gl.chart()
    return (
        gl.filter(F.col("account_name").isNotNull() & (F.col("account_name") != ""))
        .groupBy("ledger_id", "account_name")
        .agg(F.max("account_group").alias("account_group")))


def with_account_type(accounts: DataFrame, overrides: DataFrame | None = None) -> DataFrame:
    """Add ``account_type``, ``source``, ``confidence``, ``is_confirmed`` to account-level rows.

    ``accounts`` is already aggregated to (ledger_id, account_name, account_group, ...), so
    the pattern rules run once per account, not once per posting.
    """
    by_group, by_name = classify_by_group(F.col("account_group")), classify_by_name(F.col("account_name"))
    if overrides is None:
        out = accounts.withColumn("_fixed", F.lit(None).cast("string"))
    else:
        fixed = overrides.filter("is_confirmed").select(
            "ledger_id", "account_name", F.col("account_type").alias("_fixed"))
        out = accounts.join(fixed, ["ledger_id", "account_name"], "left")
    named = F.when(by_name != "UNKNOWN", by_name)
    return (
        out.withColumn("_group", by_group).withColumn("_name", named)
        .withColumn("account_type", F.coalesce("_fixed", "_group", "_name", F.lit("UNKNOWN")))
        .withColumn("source", F.when(F.col("_fixed").isNotNull(), "confirmed")
                    .when(F.col("_group").isNotNull(), "group")
                    .when(F.col("_name").isNotNull(), "pattern").otherwise("unknown"))
        .withColumn("confidence", F.when(F.col("source").isin("confirmed", "group"), F.lit(0.95))
                    .when(F.col("source") == "pattern", F.lit(0.75)).otherwise(F.lit(0.0)))
        .withColumn("is_confirmed", F.col("_fixed").isNotNull())
        .drop("_fixed", "_group", "_name"))


def account_types(gl: DataFrame | Rollups, overrides: DataFrame | None = None) -> DataFrame:
    return with_account_type(accounts_of(gl), overrides)


def recon_bucket(account_type: Column) -> Column:
    """bank / payable / receivable / tax / inventory, or NULL."""
    return (
        F.when(account_type.isin("BANK", "CASH"), "bank")
        .when(account_type.isin("PAYABLE", "CURRENT_LIABILITY"), "payable")
        .when(account_type == "RECEIVABLE", "receivable")
        .when(account_type == "TAX", "tax")
        .when(account_type == "INVENTORY", "inventory"))


def accounts_by_type(types: DataFrame) -> DataFrame:
    """Accounts per type with their reconciliation bucket, one row per account.

    A chart of accounts has no size bound, so the list stays rows, not an array.
    """
    return types.select("ledger_id", "account_type", recon_bucket(F.col("account_type")).alias("bucket"),
                        "account_name")
