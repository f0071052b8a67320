"""Named queries for schema intelligence, row edits and the small building blocks."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from ..functions import columns as FC
from ..operators import hierarchy as H
from ..operators import accounts as A
from ..operators import checks as C
from ..operators import flux as X
from ..operators import schema_intel as S
from ..operators.recon import bucket_rows
from ..sources import uploads as U
from ..sources.trade_ledger import PERIOD
from .registry import cte, register
from .report_queries import MTH, kw, r2

P0, P1 = f"DATE '{PERIOD[0]}'", f"DATE '{PERIOD[1]}'"


def q(v: str) -> str:
    return "'" + v.replace("'", "''") + "'"


def arr(vs: list[str]) -> str:
    return "[" + ", ".join(q(v) for v in vs) + "]"


_names = "CASE c_custkey % 7 " + " ".join(f"WHEN {i} THEN {arr(c + U.EXTRA)}" for i, c in enumerate(U.CONVENTIONS)) + " END"
cte("hdr", f"""SELECT file_id, position, CASE WHEN file_id % 7 <> 2 AND file_id % 5 = 1 AND position = file_id % 6 THEN header || 'x'
    WHEN file_id % 5 = 2 THEN upper(header) WHEN file_id % 5 = 3 THEN replace(header, ' ', '_') ELSE header END AS header
  FROM (SELECT c_custkey AS file_id, CAST(unnest(range(len(n))) AS INTEGER) AS position, unnest(n) AS header
        FROM (SELECT c_custkey, {_names} AS n FROM customer))""")
cte("alias", "SELECT * FROM (VALUES " + ", ".join(
    f"({i}, {q(a)}, {q(c)})" for i, (a, c) in enumerate(S.column_aliases())) + ") v(alias_no, alias, canonical)")
cte("norms", """SELECT *, trim(regexp_replace(regexp_replace(regexp_replace(trim(lower(header)), '[_\\-.]+', ' ', 'g'),
  '[()#*/\\\\]+', '', 'g'), '\\s+', ' ', 'g')) AS norm FROM hdr""", uses=("hdr",))
cte("shapes", f"""SELECT file_id, position, COUNT(*) AS filled,
  COUNT(*) FILTER (regexp_matches(value, {q(S.DATE_SHAPE)})) AS dates,
  COUNT(*) FILTER (regexp_matches(value, {q(S.AMOUNT_SHAPE)})) AS amounts FROM (
  SELECT o_custkey AS file_id, b + 5 + unnest([0, 1, 2]) AS position, unnest([strftime(o_orderdate, '%d/%m/%Y'),
    CAST(CAST(o_totalprice AS DECIMAL(20,2)) AS VARCHAR), o_orderpriority]) AS value
  FROM (SELECT *, 7 + CASE WHEN o_custkey % 7 IN (1, 3, 4, 5, 6) THEN 1 ELSE 0 END AS b FROM orders)) GROUP BY 1, 2""")
cte("nearest", """SELECT norm, min_by(canonical, (dist, -conf, alias_no)) AS canonical, min_by(conf, (dist, -conf, alias_no)) AS conf
  FROM (SELECT norm, canonical, alias_no, levenshtein(norm, alias) AS dist,
    1 - CAST(levenshtein(norm, alias) AS DOUBLE) / GREATEST(length(norm), length(alias), 1) AS conf,
    CAST(len(list_filter(string_split(norm, ' '), lambda t: list_contains(string_split(alias, ' '), t))) AS DOUBLE)
    / GREATEST(len(string_split(norm, ' ')), len(string_split(alias, ' '))) AS overlap
    FROM (SELECT DISTINCT norm FROM norms), alias) WHERE dist <= 1 OR (dist = 2 AND overlap >= 0.5) GROUP BY 1""",
    uses=("norms", "alias"))
cte("mapped", f"""SELECT file_id, position, header,
  COALESCE(own, a.canonical, n.canonical, CASE WHEN dd THEN 'transaction_date' WHEN aa THEN 'net_amount' END) AS canonical,
  ROUND(CASE WHEN own IS NOT NULL OR a.canonical IS NOT NULL THEN 1.0 WHEN n.canonical IS NOT NULL THEN n.conf
    WHEN dd THEN CAST(dates AS DOUBLE) / filled WHEN aa THEN CAST(amounts AS DOUBLE) / filled ELSE 0 END, 6) AS confidence,
  CASE WHEN own IS NOT NULL OR a.canonical IS NOT NULL THEN 'exact' WHEN n.canonical IS NOT NULL THEN 'fuzzy'
    WHEN dd OR aa THEN 'inference' ELSE 'unmapped' END AS method
  FROM (SELECT h.*, CASE WHEN list_contains({arr(S.CANONICAL)}, replace(norm, ' ', '_')) THEN replace(norm, ' ', '_') END AS own,
    filled, dates, amounts, COALESCE(filled >= 5 AND dates >= 0.8 * filled, FALSE) AS dd,
    COALESCE(filled >= 5 AND amounts >= 0.8 * filled, FALSE) AS aa
    FROM norms h LEFT JOIN shapes s USING (file_id, position)) h
  LEFT JOIN alias a ON h.norm = a.alias LEFT JOIN nearest n ON h.norm = n.norm""", uses=("norms", "alias", "shapes", "nearest"))
cte("resolved", """SELECT * EXCLUDE (b, p, rn, special, live), COALESCE(special, CASE WHEN canonical IS NOT NULL AND live > 1
    THEN 'duplicate' END) AS drop_reason,
    COALESCE(special, CASE WHEN canonical IS NOT NULL AND live > 1 THEN 'duplicate' END) IS NOT NULL AS dropped FROM (
  SELECT *, CASE WHEN special IS NULL THEN ROW_NUMBER() OVER (PARTITION BY file_id, canonical, special IS NULL ORDER BY position)
    END AS live FROM (
    SELECT *, CASE WHEN rn <> 1 THEN NULL WHEN canonical = 'net_amount' AND b THEN 'debit and credit already present'
      WHEN canonical IN ('vendor_name', 'customer_name') AND p THEN 'party_name is more generic'
      WHEN canonical = 'opening_balance' THEN 'not expected in a transaction file' END AS special FROM (
      SELECT *, BOOL_OR(COALESCE(canonical = 'debit_amount', FALSE)) OVER f AND BOOL_OR(COALESCE(canonical = 'credit_amount', FALSE)) OVER f AS b,
        BOOL_OR(COALESCE(canonical = 'party_name', FALSE)) OVER f AS p,
        ROW_NUMBER() OVER (PARTITION BY file_id, canonical ORDER BY position) AS rn FROM mapped
      WINDOW f AS (PARTITION BY file_id))))""", uses=("mapped",))


def mapped(d):
    shapes = S.sample_shapes(U.values(d.spark, d.sf_dir))
    return S.map_columns(U.headers(d.spark, d.sf_dir), S.ref_column_aliases(d.spark), shapes)


register("map_columns", mapped, "SELECT * FROM mapped", uses=("mapped",))
register("ref_column_aliases",
         lambda d: U.headers(d.spark, d.sf_dir).withColumn("alias", S.normalise_header(F.col("header"))).join(
             F.broadcast(S.ref_column_aliases(d.spark)), "alias").groupBy("alias", "canonical").agg(F.count(F.lit(1)).alias("files")),
         "SELECT alias, canonical, COUNT(*) AS files FROM norms JOIN alias ON norm = alias GROUP BY 1, 2", uses=("norms", "alias"))
register("resolve_redundancy", lambda d: S.resolve_redundancy(mapped(d)), "SELECT * FROM resolved", uses=("resolved",))
register("validate_mapping", lambda d: S.validate_mapping(S.resolve_redundancy(mapped(d))), f"""
  SELECT *, has_date AND has_account AND has_amount AND columns >= 3 AS is_valid,
    CAST(NOT has_description AS INTEGER) + CAST(NOT has_reference AS INTEGER) + CAST(columns > 20 AS INTEGER) AS warnings FROM (
  SELECT file_id, {', '.join(f'COALESCE(BOOL_OR(NOT dropped AND list_contains({arr(c)}, canonical)), FALSE) AS {n}' for n, c in (
      ('has_date', S.DATE_COLUMNS), ('has_account', S.ACCOUNT_COLUMNS), ('has_amount', S.MONEY_COLUMNS),
      ('has_description', ['description']), ('has_reference', ['reference_number', 'document_number'])))},
    COUNT(*) FILTER (NOT dropped AND canonical IS NOT NULL) AS columns, COUNT(*) FILTER (dropped) AS dropped
  FROM resolved GROUP BY 1)""", uses=("resolved",))
PROFILE = ["transaction_date", "due_date", "vendor_name", "currency_code", "closing_balance", "voucher_type", "Sr. No"]
_prof = ", ".join(f"('{c}', COUNT({v}), COALESCE(MIN({v}) = MAX({v}), FALSE))" for c, v in (
    (c, f"NULLIF(lower(trim(CAST({'row_id' if c == 'Sr. No' else c} AS VARCHAR))), '')") for c in PROFILE))
register("profile_skip_columns",
         lambda d: S.profile_skip_columns(d.gl.withColumn("Sr. No", F.col("row_id")), PROFILE),
         f"""SELECT ledger_id, c[1] AS "column", c[2] AS filled, ROUND(1 - CAST(c[2] AS DOUBLE) / n, 6) AS empty_share,
         CASE WHEN regexp_matches(lower(c[1]), {q('|'.join(S.SKIP_NAMES))}) THEN 'name' WHEN 1 - CAST(c[2] AS DOUBLE) / n >= 0.95
         THEN 'empty' WHEN c[2] >= 3 AND c[3] THEN 'constant' END AS skip_reason
         FROM (SELECT ledger_id, COUNT(*) AS n, unnest([{_prof}]) AS c FROM gl GROUP BY 1)""")

_kinds = list(S.DOC_TYPES.values())
_cols = ("CASE c_custkey % 6 " + " ".join(f"WHEN {i} THEN {arr(_kinds[i][0])}" for i in range(1, 5))
         + f" WHEN 5 THEN ['foo', 'bar', 'baz'] ELSE {arr(_kinds[0][0])} END")
cte("dcols", f"""SELECT file_id, list_distinct(list(replace(replace(replace(lower(c), ' ', ''), '_', ''), '-', ''))) AS keys FROM (
  SELECT c_custkey AS file_id, unnest(range(len(n))) AS i, unnest(n) AS c FROM (SELECT c_custkey, {_cols} AS n FROM customer)
  ) WHERE (i + file_id) % 3 <> 0 OR i < 0 GROUP BY 1""")


def hits(names: list[str]) -> str:
    return f"len(list_intersect(keys, {arr(list(dict.fromkeys(S._key(c) for c in names)))}))"


def _score(n: int, kind: str) -> str:
    disc, anti, versions = S.DOC_TYPES[kind]
    v = "CASE " + " ".join(f"WHEN {hits(c)} = {len(c)} THEN '{k}'" for k, c in versions.items()) + " END" if versions else "NULL"
    size = len({S._key(c) for c in disc})
    return (f"SELECT file_id, {n} AS n, '{kind}' AS type, CAST({v} AS VARCHAR) AS version, ROUND(GREATEST(0.0, LEAST(1.0, "
            f"CAST({hits(disc)} AS DOUBLE) / {size} - LEAST(0.35, {hits(anti)} * 0.12))), 6) AS conf FROM keys2")


cte("keys2", """SELECT file_id, CASE WHEN file_id % 7 = 0 THEN list_distinct(list_append(keys, 'narration')) ELSE keys END AS keys
  FROM dcols""", uses=("dcols",))
cte("dscore", " UNION ALL ".join(_score(i, k) for i, k in enumerate(S.DOC_TYPES)), uses=("keys2",))
register("detect_doc_type", lambda d: S.detect_doc_type(U.doc_columns(d.spark, d.sf_dir)), """
  WITH r AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY file_id ORDER BY conf DESC, n) AS rn FROM dscore WHERE conf > 0.05)
  SELECT k.file_id, COALESCE(a.type, 'OTHER') AS type, CAST(COALESCE(a.conf, 0.1) AS DOUBLE) AS confidence, a.version,
    COALESCE(a.conf - b.conf < 0.15, FALSE) AS is_ambiguous FROM keys2 k
  LEFT JOIN r a ON k.file_id = a.file_id AND a.rn = 1 LEFT JOIN r b ON k.file_id = b.file_id AND b.rn = 2""", uses=("dscore", "keys2"))
register("ref_doc_types", lambda d: U.doc_columns(d.spark, d.sf_dir).select("file_id", S.doc_column_key(F.col("column")).alias("key")).distinct().join(
    F.broadcast(S.ref_doc_types(d.spark)), "key").groupBy("type", "role").agg(F.count(F.lit(1)).alias("hits")),
    "WITH k AS (SELECT file_id, unnest(keys) AS key FROM keys2), reg AS (SELECT * FROM (VALUES " + ", ".join(
        f"('{kind}', '{role}', '{S._key(c)}')" for kind, (disc, anti, vs) in S.DOC_TYPES.items()
        for role, names in [("disc", disc), ("anti", anti)] + [("version", v) for v in vs.values()] for c in names)
    + ") v(type, role, key)) SELECT type, role, COUNT(*) AS hits FROM k JOIN reg USING (key) GROUP BY 1, 2", uses=("keys2",))
register("extract_period", lambda d: S.extract_period(U.files(d.spark, d.sf_dir)), """
  WITH f AS (SELECT c_custkey AS file_id, c_custkey % 8 AS m, CAST(c_custkey % 30 AS INTEGER) AS r, a, b FROM customer LEFT JOIN (SELECT o_custkey,
    CAST(MIN(o_orderdate) AS DATE) AS a, CAST(MAX(o_orderdate) AS DATE) AS b FROM orders GROUP BY 1) ON c_custkey = o_custkey),
  y AS (SELECT *, CASE WHEN m IN (0, 1, 2, 4, 5) THEN 2000 + r WHEN m = 3 AND r <> 29 THEN 2001 + r END AS y FROM f)
  SELECT file_id, COALESCE(make_date(y - 1, 4, 1), a) AS period_start, COALESCE(make_date(y, 3, 31), b) AS period_end,
    CASE WHEN y IS NOT NULL THEN 'filename' WHEN a IS NOT NULL THEN 'date_column' ELSE 'user' END AS source,
    CAST(CASE WHEN y IS NOT NULL THEN 0.9 WHEN a IS NOT NULL THEN 0.75 ELSE 0 END AS DOUBLE) AS confidence FROM y""", uses=())
register("entity_lists", lambda d: S.entity_lists(d.gl), """
  SELECT DISTINCT ledger_id, 'vendor' AS kind, vendor_name AS name, 1 AS path FROM gl WHERE vendor_name <> ''
  UNION ALL SELECT DISTINCT ledger_id, 'customer', customer_name, 1 FROM gl WHERE customer_name <> ''""")
register("entity_lists_ledger", lambda d: S.entity_lists_ledger(A.accounts_of(d.gl).select(
    "ledger_id", F.col("account_name").alias("name"), F.col("account_group").alias("parent"))),
    f"""SELECT ledger_id, account_name AS name, CASE WHEN lower(account_group) IN ({', '.join(map(q, S.VENDOR_GROUPS))})
    THEN 'vendor' ELSE 'customer' END AS kind FROM types
    WHERE lower(account_group) IN ({', '.join(map(q, S.VENDOR_GROUPS + S.CUSTOMER_GROUPS))})""", uses=("types",))


# --- account hierarchy ---------------------------------------------------------------

TEAMS = 40


def _edges(d):
    """Each customer hangs under a team, teams under a third of their number, the first under the debtors."""
    k = F.col("team")
    customers = d.table("customer").select(F.col("c_nationkey").cast("int").alias("ledger_id"), F.col("c_name").alias("child"),
                                           F.concat(F.lit("Team "), F.col("c_custkey") % TEAMS).alias("parent"))
    teams = d.table("nation").select(F.col("n_nationkey").cast("int").alias("ledger_id"), F.explode(F.sequence(F.lit(0), F.lit(TEAMS - 1))).alias("team")).select(
        "ledger_id", F.concat(F.lit("Team "), k).alias("child"),
        F.when(k == 0, "Sundry Debtors").otherwise(F.concat(F.lit("Team "), F.floor(k / 3))).alias("parent"))
    return customers.unionByName(teams)


def _node_types(d):
    """The standard group is typed by its name, one team in each second ledger by hand."""
    ledgers = d.table("nation").select(F.col("n_nationkey").cast("int").alias("ledger_id"))
    group = ledgers.select("ledger_id", F.lit("Sundry Debtors").alias("node"), A.classify_by_group(F.lit("Sundry Debtors")).alias("account_type"))
    return group.unionByName(ledgers.filter("ledger_id % 2 = 0").select("ledger_id", F.lit("Team 4").alias("node"), F.lit("CURRENT_ASSET").alias("account_type")))


_EDGES = f"""SELECT CAST(c_nationkey AS INTEGER) AS ledger_id, c_name AS node, 'Team ' || (c_custkey % {TEAMS}) AS parent FROM customer
  UNION ALL SELECT CAST(n_nationkey AS INTEGER), 'Team ' || k, CASE WHEN k = 0 THEN 'Sundry Debtors' ELSE 'Team ' || (k // 3) END
  FROM nation, range({TEAMS}) t(k)"""
_WALK = f"""WITH RECURSIVE e AS ({_EDGES}), walk AS (SELECT ledger_id, node, parent AS ancestor, 1 AS distance FROM e
  UNION ALL SELECT w.ledger_id, w.node, e.parent, w.distance + 1 FROM walk w JOIN e ON e.ledger_id = w.ledger_id AND e.node = w.ancestor)"""
register("account_closure", lambda d: H.closure(_edges(d)), f"{_WALK} SELECT * FROM walk", uses=())
register("account_hierarchy", lambda d: H.inherited_types(_edges(d), _node_types(d)), f"""{_WALK},
  t AS (SELECT CAST(n_nationkey AS INTEGER) AS ledger_id, 'Sundry Debtors' AS node, 'RECEIVABLE' AS account_type FROM nation
    UNION ALL SELECT CAST(n_nationkey AS INTEGER), 'Team 4', 'CURRENT_ASSET' FROM nation WHERE n_nationkey % 2 = 0),
  seen AS (SELECT ledger_id, node, ancestor, distance FROM walk UNION ALL SELECT ledger_id, node, node, 0 FROM e
    UNION ALL SELECT ledger_id, node, node, 0 FROM t WHERE node = 'Sundry Debtors')
  SELECT s.ledger_id, s.node, t.account_type, s.ancestor AS typed_by, CAST(s.distance AS BIGINT) AS distance, FALSE AS is_cyclic
  FROM seen s JOIN t ON t.ledger_id = s.ledger_id AND t.node = s.ancestor
  QUALIFY ROW_NUMBER() OVER (PARTITION BY s.ledger_id, s.node ORDER BY s.distance) = 1""", uses=())


def _top(key: str, value: str, k: int, name: str, where: str) -> str:
    return f"""(SELECT ledger_id, string_agg(x, '|' ORDER BY pos) AS {name} FROM (SELECT ledger_id, {key} AS x,
      ROW_NUMBER() OVER (PARTITION BY ledger_id ORDER BY {value} DESC, {key}) AS pos FROM gl WHERE {where} GROUP BY 1, 2)
      WHERE pos <= {k} GROUP BY 1)"""


_quarters = ", ".join(f"CASE WHEN make_date(fy + {a}, {m}, 1) >= first AND last_day(make_date(fy + {a}, {m + 2}, 1)) <= last THEN '{n}' END"
                      for n, a, m in (("Q1", 0, 4), ("Q2", 0, 7), ("Q3", 0, 10), ("Q4", 1, 1)))
register("gl_context", lambda d: S.gl_context(d.gl), f"""
  SELECT b.* EXCLUDE (fy), array_to_string(list_filter([{_quarters}], lambda x: x IS NOT NULL), ',') AS quarters,
    top_accounts, top_vendors, voucher_types FROM (SELECT ledger_id, MIN(transaction_date) AS first,
    MAX(transaction_date) AS last, COUNT(*) AS entries, CAST(year(MIN(transaction_date) - INTERVAL 3 MONTH) AS INTEGER) AS fy FROM gl GROUP BY 1) b
  LEFT JOIN {_top('account_name', 'COUNT(*)', 5, 'top_accounts', "account_name <> ''")} USING (ledger_id)
  LEFT JOIN {_top('COALESCE(vendor_name, party_name)', 'SUM(debit_amount)', 3, 'top_vendors', "COALESCE(vendor_name, party_name) <> ''")} USING (ledger_id)
  LEFT JOIN {_top('lower(voucher_type)', '0', 10, 'voucher_types', "voucher_type <> ''")} USING (ledger_id)""")


# --- row edits -----------------------------------------------------------------------


def _edits(d):
    """Two corrections per receipt row on the bank side: the later one must win."""
    rows = d.gl.filter("voucher_type = 'Receipt' AND row_id LIKE '%/1'").select("ledger_id", "row_id")
    return rows.select("ledger_id", "row_id", F.lit("account_name").alias("field"),
                       F.explode(F.array(F.lit("First Guess"), F.lit("Axis Bank A/c"))).alias("value")).withColumn(
        "edited_at", F.when(F.col("value") == "First Guess", 1).otherwise(2))


register("apply_corrections", lambda d: S.apply_corrections(d.gl, _edits(d)).groupBy("ledger_id", "account_name").agg(
    F.count(F.lit(1)).alias("rows")),
    """SELECT ledger_id, CASE WHEN voucher_type = 'Receipt' AND row_id LIKE '%/1' THEN 'Axis Bank A/c' ELSE account_name END
    AS account_name, COUNT(*) AS rows FROM gl GROUP BY 1, 2""")


def _toggles(d):
    rows = d.gl_all.filter("voucher_type = 'Sales'").select("ledger_id", "row_id", "excluded")
    return rows.select("ledger_id", "row_id", (~F.col("excluded")).alias("exclude"), F.lit(1).alias("edited_at"))


register("apply_exclusions", lambda d: S.apply_exclusions(d.gl_all, _toggles(d)).groupBy("ledger_id", "excluded").agg(
    F.count(F.lit(1)).alias("rows")),
    """SELECT ledger_id, CASE WHEN voucher_type = 'Sales' THEN NOT excluded ELSE excluded END AS excluded, COUNT(*) AS rows
    FROM gl_all GROUP BY 1, 2""", uses=("gl_all",))
register("gl_search", lambda d: S.gl_search(d.gl_all, "bank", *PERIOD, voucher_type="payment").select(
    "ledger_id", "row_id"), f"""SELECT ledger_id, row_id FROM gl_all WHERE transaction_date BETWEEN {P0} AND {P1}
    AND lower(voucher_type) = 'payment' AND {kw(['party_name', 'vendor_name', 'customer_name', 'account_name', 'reference_number',
    'description'], ['bank'])}""", uses=("gl_all",))
register("gl_search_indexed", lambda d: d.texts.search("Cash", start=PERIOD[0], end=PERIOD[1]).select("ledger_id", "row_id", "account_name"),
         f"""SELECT ledger_id, row_id, account_name FROM gl_all WHERE transaction_date BETWEEN {P0} AND {P1}
    AND {kw(['party_name', 'vendor_name', 'customer_name', 'account_name', 'reference_number', 'description'], ['cash'])}""", uses=("gl_all",))

# --- filters, columns, joins, aggregates, windows ------------------------------------

register("filter_period", lambda d: d.gl.filter(FC.in_period(*PERIOD)).select("ledger_id", "row_id"),
         f"SELECT ledger_id, row_id FROM gl WHERE transaction_date BETWEEN {P0} AND {P1}")
register("filter_keyword_any", lambda d: d.gl.filter(FC.keyword_any(["account_name", "description"], ["gst", "bank%a/c"])).select(
    "ledger_id", "row_id"), f"SELECT ledger_id, row_id FROM gl WHERE {kw(['account_name', 'description'], ['gst', 'bank%a/c'])}")
register("filter_excluded", lambda d: FC.not_excluded(d.gl_all).groupBy("ledger_id").agg(F.count(F.lit(1)).alias("rows")),
         "SELECT ledger_id, COUNT(*) AS rows FROM gl GROUP BY 1")


def _filter_accounts(d):
    return bucket_rows(d.gl, d.overrides, "tax", ["gst"]).filter("own").select("ledger_id", "row_id")


register("filter_accounts", _filter_accounts, """SELECT g.ledger_id, row_id FROM gl g JOIN buckets b ON g.ledger_id = b.ledger_id
  AND g.account_name = b.account_name WHERE bucket = 'tax'""", uses=("buckets",))
register("join_account_type",
         lambda d: d.gl.groupBy("ledger_id", "account_name").agg(F.sum("net_amount").alias("net")).join(
             A.account_types(d.gl, d.overrides).select("ledger_id", "account_name", "account_type"), ["ledger_id", "account_name"], "left")
         .select("ledger_id", "account_name", "account_type", F.round("net", 2).cast("double").alias("net")),
         f"""SELECT g.ledger_id, g.account_name, account_type, {r2('net')} AS net FROM (SELECT ledger_id, account_name,
         SUM(net_amount) AS net FROM gl GROUP BY 1, 2) g LEFT JOIN types t ON g.ledger_id = t.ledger_id
         AND g.account_name = t.account_name""", uses=("types",))
for _n, _c, _s in (
    ("col_best_party", FC.best_vendor, "COALESCE(vendor_name, party_name, account_name)"),
    ("col_party_any", FC.any_party, "COALESCE(party_name, vendor_name, customer_name, account_name)")):
    register(_n, lambda d, c=_c: d.gl.groupBy("ledger_id", c().alias("party")).agg(F.count(F.lit(1)).alias("rows")),
             f"SELECT ledger_id, {_s} AS party, COUNT(*) AS rows FROM gl GROUP BY 1, 2")
for _n, _c, _s in (("col_debit", FC.best_debit, "debit_amount"), ("col_credit", FC.best_credit, "credit_amount"),
                   ("col_effective_amount", FC.effective_amount, "ABS(net_amount)")):
    register(_n, lambda d, c=_c: d.gl.groupBy("ledger_id").agg(FC.money(F.sum(c())).alias("amount")),
             f"SELECT ledger_id, {r2(f'SUM({_s})')} AS amount FROM gl GROUP BY 1")
register("agg_sum_count", lambda d: d.gl.groupBy("ledger_id", "account_name").agg(
    FC.money(F.sum("debit_amount")).alias("total"), F.count(F.lit(1)).alias("n"),
    F.min("debit_amount").cast("double").alias("lo"), F.max("debit_amount").cast("double").alias("hi")).filter("n > 10"),
    f"""SELECT ledger_id, account_name, {r2('SUM(debit_amount)')} AS total, COUNT(*) AS n, CAST(MIN(debit_amount) AS DOUBLE) AS lo,
    CAST(MAX(debit_amount) AS DOUBLE) AS hi FROM gl GROUP BY 1, 2 HAVING COUNT(*) > 10""")
register("agg_conditional", lambda d: d.gl.groupBy("ledger_id").agg(*[
    FC.money(FC.total_if(F.col("voucher_type") == v, F.col("debit_amount"))).alias(v.lower())
    for v in ("Sales", "Purchase", "Receipt", "Payment", "Journal")]),
    "SELECT ledger_id, " + ", ".join(f"{r2(f'''SUM(CASE WHEN voucher_type = '{v}' THEN debit_amount ELSE 0 END)''')} AS {v.lower()}"
                                     for v in ("Sales", "Purchase", "Receipt", "Payment", "Journal")) + " FROM gl GROUP BY 1")
register("agg_filter", lambda d: d.gl.groupBy("ledger_id").agg(
    F.count_if(F.col("transaction_date").isNull()).alias("undated"), F.count_if(F.col("net_amount") == 0).alias("zero")),
    """SELECT ledger_id, COUNT(*) FILTER (transaction_date IS NULL) AS undated, COUNT(*) FILTER (net_amount = 0) AS zero
    FROM gl GROUP BY 1""")
register("agg_bool_or", lambda d: d.gl.groupBy("ledger_id", "reference_number").agg(
    F.bool_or(F.lower("account_name").contains("tds")).alias("has_tds")),
    "SELECT ledger_id, reference_number, BOOL_OR(lower(account_name) LIKE '%tds%') AS has_tds FROM gl GROUP BY 1, 2")
register("agg_distinct", lambda d: d.gl.groupBy("ledger_id").agg(
    F.count_distinct("reference_number").alias("vouchers"), F.count_distinct("party_name").alias("parties")),
    """SELECT ledger_id, COUNT(DISTINCT reference_number) AS vouchers, COUNT(DISTINCT party_name) AS parties
    FROM gl GROUP BY 1""")
register("agg_ratio", lambda d: d.gl.groupBy("ledger_id").agg(F.sum("debit_amount").alias("a"), F.sum("credit_amount").alias("b"))
         .select("ledger_id", F.round(F.col("a").cast("double") / F.nullif(F.col("b").cast("double"), F.lit(0.0)), 2).alias("ratio")),
         """SELECT ledger_id, ROUND(CAST(SUM(debit_amount) AS DOUBLE) / NULLIF(CAST(SUM(credit_amount) AS DOUBLE), 0), 2) AS ratio
         FROM gl GROUP BY 1""")


def _cube(d, kind):
    # the greatest of a text needs sorted rows: the ledger is first summed by group too, which needs none
    sums = d.gl.filter("account_name <> '' AND transaction_date IS NOT NULL").groupBy(
        "ledger_id", "account_name", FC.month().alias("month"), "account_group").agg(F.sum("net_amount").alias("net"))
    typed = A.with_account_type(sums.groupBy("ledger_id", "account_name", "month").agg(
        F.max("account_group").alias("account_group"), F.sum("net").alias("net")), d.overrides)
    return getattr(typed, kind)("ledger_id", "account_type", "month").agg(
        F.round(F.sum("net"), 2).cast("double").alias("net"), F.grouping_id().cast("int").alias("level"))


for _kind in ("rollup", "cube"):
    register(f"agg_{_kind}", lambda d, k=_kind: _cube(d, k), f"""
      WITH t AS (SELECT a.ledger_id, account_name, {MTH} AS month, MAX(account_group) AS g, SUM(net_amount) AS net FROM gl a
        WHERE account_name <> '' AND transaction_date IS NOT NULL GROUP BY 1, 2, 3)
      SELECT ledger_id, account_type, month, {r2('SUM(net)')} AS net, CAST(GROUPING(ledger_id, account_type, month) AS INTEGER) AS level
      FROM (SELECT t.*, account_type FROM t JOIN types y ON t.ledger_id = y.ledger_id AND t.account_name = y.account_name)
      GROUP BY {_kind.upper()} (ledger_id, account_type, month)""", uses=("gl", "types"))


def _monthly(d):
    return d.gl.filter("transaction_date IS NOT NULL").groupBy("ledger_id", FC.month().alias("month")).agg(
        F.round(F.sum("debit_amount"), 2).alias("actual"))


MONTHLY = f"(SELECT ledger_id, {MTH} AS month, CAST(ROUND(SUM(debit_amount), 2) AS DECIMAL(18,2)) AS actual FROM gl WHERE transaction_date IS NOT NULL GROUP BY 1, 2)"
register("win_avg_partition", lambda d: _monthly(d).select(
    "ledger_id", "month", (F.col("actual") > F.avg("actual").over(Window.partitionBy("ledger_id"))).alias("above_average")),
    f"""SELECT ledger_id, month, actual * COUNT(*) OVER w > SUM(actual) OVER w AS above_average FROM {MONTHLY}
    WINDOW w AS (PARTITION BY ledger_id)""")
register("win_lag", lambda d: _monthly(d).select("ledger_id", "month", F.lag("actual", 1).over(
    Window.partitionBy("ledger_id").orderBy("month")).cast("double").alias("prior")),
    f"SELECT ledger_id, month, CAST(LAG(actual) OVER (PARTITION BY ledger_id ORDER BY month) AS DOUBLE) AS prior FROM {MONTHLY}")
register("topk_global", lambda d: d.gl.orderBy(F.col("debit_amount").desc(), "row_id").limit(100).select("ledger_id", "row_id"),
         "SELECT ledger_id, row_id FROM gl ORDER BY debit_amount DESC, row_id LIMIT 100")
register("sort_issues", lambda d: C.sort_issues(C.run_checks(C.with_period(d.gl, *PERIOD), C.VOUCHER_CODES)).select(
    "ledger_id", "code", "severity", "exposure"), "SELECT ledger_id, code, severity, exposure FROM issues WHERE code IN ('gst_mismatch', "
    "'tds_potentially_missed') UNION ALL SELECT ledger_id, code, severity, exposure FROM imb", uses=("issues", "imb"))
register("sort_material_first", lambda d: X.sort_material_first(X.flux(d.gl, *PERIOD)).select("ledger_id", "account_name", "is_material"),
         "SELECT ledger_id, account_name, is_material FROM flux", uses=("flux",))
register("fiscal_calendar", lambda d: d.gl.filter("transaction_date IS NOT NULL").groupBy(
    "ledger_id", S.fiscal_year(F.col("transaction_date")).alias("fy"), S.fiscal_quarter(F.col("transaction_date")).alias("fq")).agg(
    F.count(F.lit(1)).alias("rows")),
    """SELECT ledger_id, CAST(year(transaction_date - INTERVAL 3 MONTH) + 1 AS INTEGER) AS fy,
    CAST(quarter(transaction_date - INTERVAL 3 MONTH) AS INTEGER) AS fq, COUNT(*) AS rows FROM gl WHERE transaction_date IS NOT NULL
    GROUP BY 1, 2, 3""")
register("weekday_count", lambda d: d.gl.groupBy("ledger_id").agg(
    F.min("transaction_date").alias("a"), F.max("transaction_date").alias("b")).select(
    "ledger_id", C.weekdays_between(F.col("a"), F.col("b")).alias("weekdays")),
    """SELECT ledger_id, CAST(len(list_filter(range(MIN(transaction_date), MAX(transaction_date) + INTERVAL 1 DAY, INTERVAL 1 DAY),
    lambda d: isodow(d) <= 5)) AS INTEGER) AS weekdays FROM gl GROUP BY 1""")
