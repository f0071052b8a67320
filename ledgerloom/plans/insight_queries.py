"""Named queries for knowledge, readiness, retrieval and the pulse."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import checks as C
from ..operators import flux as X
from ..operators import knowledge as K
from ..operators import pulse as P
from ..operators import readiness as Y
from ..operators import recon as R
from ..operators import retrieval as T
from ..operators import vector_index
from ..operators.accounts import account_types
from ..sources import operational as ops
from ..sources.staging import built
from ..sources.trade_ledger import AS_OF, PERIOD
from .check_queries import ISSUES
from .registry import cte, register
from .report_queries import AS, r2

_case = "CASE CAST(floor(doc_id / 25) AS INTEGER) " + " ".join(
    f"WHEN {i} THEN '{k}'" for i, k in enumerate(ops.KEYS)) + " ELSE 'manual:doc-' || doc_id END"
cte("kb", f"""SELECT CAST(doc_id % 25 AS INTEGER) AS ledger_id, doc_id AS answer_id, {_case} AS pattern_key,
  text AS context, 'answer ' || doc_id AS answer,
  CASE doc_id % 7 WHEN 0 THEN 'REJECTED' WHEN 1 THEN 'INVESTIGATE' WHEN 2 THEN 'ANNOTATED' ELSE 'NORMAL' END AS verdict,
  CASE WHEN doc_id < 225 THEN 'SCAN_ISSUE' WHEN doc_id < 300 THEN 'AGENT_QUESTION' ELSE 'MANUAL' END AS source,
  CASE doc_id % 5 WHEN 0 THEN 'NEVER' WHEN 1 THEN 'ONCE' ELSE 'ALWAYS' END AS auto_apply,
  CAST(10 - doc_id % 10 AS DOUBLE) / 10 AS confidence, doc_id % 15 + 1 AS reaffirmation_count,
  {AS} - CAST(doc_id % 900 AS INTEGER) AS last_reaffirmed_at,
  CASE WHEN doc_id % 4 <> 0 THEN doc_id % 50 END AS stored_rows,
  CASE WHEN doc_id % 4 <> 0 THEN CAST((doc_id % 60) * 10000 AS DOUBLE) END AS stored_exposure, embedding
  FROM documents JOIN embeddings ON doc_id = vec_id""")
cte("qlog", f"""SELECT i AS query_id, CAST(conv_id % 25 AS INTEGER) AS ledger_id, text AS question,
  CASE WHEN i % 11 = 0 THEN 'FAILED' ELSE 'COMPLETED' END AS status, CASE WHEN i % 13 <> 0 THEN 'SELECT 1' END AS generated_sql,
  CAST(i % 10 + 1 AS DOUBLE) / 10 AS confidence, CASE WHEN i % 3 = 0 THEN 'pass' ELSE 'warn' END AS verdict,
  CASE WHEN i % 6 <> 0 THEN i % 4 END AS row_count, CASE WHEN i % 17 = 0 THEN 'thumbs_down' END AS feedback,
  {AS} - CAST(i % 400 AS INTEGER) AS created_at
  FROM (SELECT *, conv_id * 1000 + turn AS i FROM conversations WHERE role = 'user')""")


def kb(d):
    return ops.knowledge(d.spark, d.sf_dir)


def qlog(d):
    return ops.query_log(d.spark, d.sf_dir)


def issues(d):
    return C.run_checks(C.with_period(d.rollups, *d.period), C.SCAN_CODES, d.overrides)


# --- keys --------------------------------------------------------------------------


def slug(c: str) -> str:
    return f"""COALESCE(NULLIF(regexp_replace(regexp_replace(lower({c}), '[^a-z0-9]+', '-', 'g'), '^-|-$', '', 'g'), ''),
      'unknown')"""


register("pattern_keys",
         lambda d: X.flux(d.gl, *d.period, d.overrides).select(
             "ledger_id", "account_name", K.scan_key(F.lit("sign_anomalies"), F.col("account_name")).alias("scan_key"),
             K.recon_key(F.concat(F.lit("Watch: "), "account_name")).alias("recon_key"),
             K.flux_key(F.col("account_name"), F.lit(PERIOD[1]).cast("date"), F.col("variance")).alias("flux_key"),
             K.manual_key(F.col("account_name")).alias("manual_key")),
         f"""SELECT ledger_id, account_name, 'scan:sign-anomalies:' || {slug('account_name')} AS scan_key,
         'recon:' || {slug("'Watch: ' || account_name")} AS recon_key, 'flux:' || {slug('account_name')} || ':jun:' ||
         CASE WHEN variance >= 0 THEN 'increase' ELSE 'decrease' END AS flux_key, 'manual:' || {slug('account_name')}
         AS manual_key FROM flux""", uses=("flux",))
# FNV-1a folds 64-bit products of single characters: no ANSI SQL text for it, see tests
register("pattern_keys_agent", lambda d: qlog(d).select(
    "query_id", K.agent_key(F.lit("pl_review"), F.col("question")).alias("agent_key")))
register("knowledge_policy", lambda d: K.knowledge_policy(kb(d)).select("answer_id", "can_auto"),
         "SELECT answer_id, auto_apply = 'ALWAYS' AND verdict <> 'REJECTED' AS can_auto FROM kb", uses=("kb",))
register("knowledge_lookup", lambda d: K.knowledge_lookup(issues(d), kb(d)).select("ledger_id", "code", "pattern_key", "answer_id"),
         """SELECT i.ledger_id, code, 'scan:' || replace(code, '_', '-') AS pattern_key, answer_id FROM issues i LEFT JOIN kb
         ON i.ledger_id = kb.ledger_id AND kb.pattern_key = 'scan:' || replace(code, '_', '-')""", uses=("issues", "kb"))
register("knowledge_autoresolve", lambda d: K.knowledge_autoresolve(issues(d), kb(d)),
         """SELECT ledger_id, code, pattern_key, answer_id, CASE WHEN a OR b THEN 'hint' ELSE 'auto' END AS decision,
           a AS rows_outgrown, b AS exposure_outgrown FROM (
         SELECT i.ledger_id, code, pattern_key, answer_id, COALESCE(CASE WHEN stored_rows = 0 THEN affected_rows > 0
           ELSE affected_rows > 2 * stored_rows END, FALSE) AS a,
           COALESCE(exposure > stored_exposure * 2 + 50000, FALSE) AS b
         FROM issues i JOIN kb ON i.ledger_id = kb.ledger_id AND kb.pattern_key = 'scan:' || replace(code, '_', '-')
         WHERE verdict = 'NORMAL' AND auto_apply = 'ALWAYS')""", uses=("issues", "kb"))


def answers(d):
    """Every user turn answers one of three topics of its ledger."""
    return qlog(d).select("ledger_id", F.concat(F.lit("topic:"), (F.col("query_id") % 3).cast("string")).alias("pattern_key"),
                          F.col("created_at").alias("answered_at"), F.col("query_id").alias("answer_id"), "verdict",
                          F.col("question").alias("answer"))


register("knowledge_merge", lambda d: K.knowledge_merge(answers(d), cap=5).select(
    "ledger_id", "pattern_key", "reaffirmation_count", "last_reaffirmed_at", "answer",
    F.array_join("verdicts", ",").alias("verdicts")),
    """WITH a AS (SELECT ledger_id, 'topic:' || (query_id % 3) AS pattern_key, *,
      ROW_NUMBER() OVER (PARTITION BY ledger_id, query_id % 3 ORDER BY created_at DESC, query_id DESC) AS rn FROM qlog)
    SELECT ledger_id, pattern_key, COUNT(*) AS reaffirmation_count, MAX(created_at) AS last_reaffirmed_at,
      MAX(question) FILTER (rn = 1) AS answer,
      string_agg(verdict, ',' ORDER BY created_at, query_id) FILTER (rn <= 5) AS verdicts FROM a GROUP BY 1, 2""",
    uses=("qlog",))
register("recurring_patterns", lambda d: K.recurring_patterns(
    d.table("events").select((F.col("user_id") % 25).cast("int").alias("ledger_id"),
                             F.concat(F.lit(" "), F.upper("event_type"), F.lit(" "), (F.col("user_id") % 97).cast("string")).alias("item"),
                             F.col("ts").cast("date").alias("seen_at"))),
    """SELECT CAST(user_id % 25 AS INTEGER) AS ledger_id, lower(event_type || ' ' || (user_id % 97)) AS pattern,
    COUNT(*) AS count, MAX(CAST(ts AS DATE)) AS last_seen, COUNT(*) >= 2 AS surfaced FROM events GROUP BY 1, 2""", uses=())
_facets = " UNION ALL ".join(f"""SELECT '{f}' AS facet, {f} AS value, COUNT(*) AS rows, COUNT(embedding) AS with_embedding,
  ROUND(CAST(COUNT(embedding) AS DOUBLE) / COUNT(*), 4) AS coverage FROM kb GROUP BY 2""" for f in ("verdict", "source"))
register("agg_group_count", lambda d: K.knowledge_stats(kb(d)), _facets, uses=("kb",))
register("data_hints", lambda d: K.data_hints(account_types(d.gl, d.overrides), issues(d), "2002-03-31"),
         """WITH t AS (SELECT ledger_id, COUNT(*) FILTER (account_type IN ('BANK', 'CASH')) AS bank,
           COUNT(*) FILTER (account_type = 'RECEIVABLE') AS ar, COUNT(*) FILTER (account_type = 'PAYABLE') AS ap,
           COUNT(*) FILTER (account_type = 'TAX') AS tax, COUNT(*) FILTER (account_type = 'INVENTORY') AS inventory,
           COUNT(*) FILTER (account_type NOT IN ('BANK', 'CASH', 'RECEIVABLE', 'PAYABLE', 'TAX', 'INVENTORY')) AS other
           FROM types GROUP BY 1),
         r AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY ledger_id ORDER BY CASE severity WHEN 'critical' THEN 0 ELSE 1 END,
           COALESCE(exposure, 0) DESC, code) AS pos FROM issues WHERE severity <> 'info')
         SELECT t.*, top_issues, TRUE AS year_end_likely FROM t LEFT JOIN (SELECT ledger_id,
           string_agg(code, ',' ORDER BY pos) AS top_issues FROM r WHERE pos <= 5 GROUP BY 1) USING (ledger_id)""",
         uses=("issues", "types"))

# --- readiness -----------------------------------------------------------------------


def tasks(d):
    """Close tasks from the order book: an order is a task, a finished order a completed one."""
    o, c = d.table("orders"), d.table("customer")
    return o.join(c, o.o_custkey == c.c_custkey).groupBy(F.col("c_nationkey").alias("ledger_id")).agg(
        F.count_if(F.col("o_orderstatus") == "F").alias("completed"), F.count(F.lit(1)).alias("total"))


def facts(d):
    imbalance = C.check("voucher_imbalance", d.rollups, *d.period)
    return Y.readiness_facts(d.rollups.ledgers(), issues(d), R.recon_run(d.rollups, *d.period, d.overrides),
                             X.flux_totals(X.flux(d.rollups, *d.period, d.overrides)), tasks(d), imbalance)


cte("imb", ISSUES["voucher_imbalance"], uses=("gl",))


def _n(code: str) -> str:
    return f"COALESCE(MAX(affected_rows) FILTER (code = '{code}'), 0) AS {code}"


cte("facts", f"""SELECT l.ledger_id, i.critical, i.review, {', '.join('i.' + c for c in ('date_outliers', 'missing_fields', 'gst_mismatch', 'sign_anomalies', 'duplicate_transactions'))},
  COALESCE(m.exposure, 0) AS imbalance, r.passed, r.failed, r.recons, f.mc, t.completed, t.total
  FROM (SELECT DISTINCT ledger_id FROM gl) l
  LEFT JOIN (SELECT ledger_id, COUNT(*) FILTER (severity = 'critical') AS critical, COUNT(*) FILTER (severity = 'review')
    AS review, {_n('date_outliers')}, {_n('missing_fields')}, {_n('gst_mismatch')}, {_n('sign_anomalies')},
    {_n('duplicate_transactions')} FROM issues GROUP BY 1) i ON l.ledger_id = i.ledger_id
  LEFT JOIN imb m ON l.ledger_id = m.ledger_id
  LEFT JOIN (SELECT ledger_id, COUNT(*) FILTER (status = 'PASSED') AS passed, COUNT(*) FILTER (status = 'FAILED') AS failed,
    COUNT(*) AS recons FROM recons GROUP BY 1) r ON l.ledger_id = r.ledger_id
  LEFT JOIN (SELECT ledger_id, COUNT(*) FILTER (is_material) AS mc FROM flux GROUP BY 1) f ON l.ledger_id = f.ledger_id
  LEFT JOIN (SELECT c_nationkey AS ledger_id, COUNT(*) FILTER (o_orderstatus = 'F') AS completed, COUNT(*) AS total
    FROM so GROUP BY 1) t ON l.ledger_id = t.ledger_id""", uses=("issues", "imb", "recons", "flux", "so"))
CL = "CAST(GREATEST(0.0, LEAST(100.0, {})) AS DOUBLE)".format
cte("dims", f"""SELECT ledger_id,
  {CL('100 - LEAST(40, critical * 10) - LEAST(15, review * 3)')} AS data_integrity,
  {CL('100 - LEAST(30, date_outliers * 2) - LEAST(20, missing_fields)')} AS period_scope,
  ROUND({CL('CAST(passed AS DOUBLE) / recons * 100 - CAST(failed AS DOUBLE) / recons * 30')}, 4) AS reconciliation,
  {CL('100 - LEAST(40, gst_mismatch * 5) - LEAST(20, sign_anomalies * 5)')} AS compliance,
  {CL('100 - mc * 10')} AS variance_analysis,
  ROUND({CL('CAST(completed AS DOUBLE) / total * 100')}, 4) AS workflow_progress,
  imbalance <= 1000 AS gate_vouchers, missing_fields <= 20 AS gate_fields, duplicate_transactions <= 5 AS gate_duplicates,
  total > 0 AS gate_tasks FROM facts""", uses=("facts",))
DIM = list(Y.WEIGHTS)
GATE = ["gate_vouchers", "gate_fields", "gate_duplicates", "gate_tasks"]
register("readiness_dimensions", lambda d: Y.readiness_dimensions(facts(d)).select("ledger_id", *DIM),
         f"SELECT ledger_id, {', '.join(DIM)} FROM dims", uses=("dims",))
register("readiness_gates", lambda d: Y.readiness_gates(facts(d)).select("ledger_id", *GATE),
         f"SELECT ledger_id, {', '.join(GATE)} FROM dims", uses=("dims",))
register("readiness_score", lambda d: Y.readiness_score(facts(d)),
         f"""SELECT *, CASE WHEN NOT ({' AND '.join(GATE)}) THEN 'blocked' WHEN score >= 80 THEN 'ready'
         WHEN score >= 50 THEN 'warning' ELSE 'blocked' END AS status FROM (SELECT ledger_id, {', '.join(DIM + GATE)},
         CAST(ROUND(ROUND({' + '.join(f'{k} * {w}' for k, w in Y.WEIGHTS.items())}, 6), 0) AS INTEGER) AS score FROM dims)""",
         uses=("dims",))


def questions(d):
    return X.pl_questions(X.pl_triggers(d.gl, *d.period, d.overrides), kb(d))


cte("questions", """SELECT *, impact >= 10000 AND SUM(CASE WHEN impact >= 10000 THEN 1 ELSE 0 END) OVER w <= 3 AS asked,
  CASE WHEN priority >= 9 THEN 'critical' WHEN priority >= 7 THEN 'review' ELSE 'info' END AS severity
  FROM (SELECT * FROM triggers t WHERE NOT EXISTS (SELECT 1 FROM kb WHERE kb.ledger_id = t.ledger_id
    AND kb.pattern_key = t.pattern_key AND confidence >= 0.6)
    QUALIFY ROW_NUMBER() OVER (PARTITION BY ledger_id ORDER BY priority DESC, impact DESC, pattern_key) <= 5)
  WINDOW w AS (PARTITION BY ledger_id ORDER BY priority DESC, impact DESC, pattern_key)""", uses=("triggers", "kb"))
register("pl_questions", questions, "SELECT * FROM questions", uses=("questions",))
register("pl_confidence", lambda d: X.pl_confidence(X.pl_numbers(d.gl, *d.period, d.overrides), questions(d)),
         """SELECT pl.ledger_id, COALESCE(a, 0) AS questions, COALESCE(c, 0) AS concerns, CASE WHEN a > 0 THEN 'medium_confidence'
         WHEN c > 0 THEN 'high_confidence_concerns' WHEN rev = 0 THEN 'low_confidence' ELSE 'high_confidence_clean' END AS label
         FROM pl LEFT JOIN (SELECT ledger_id, COUNT(*) FILTER (asked) AS a, COUNT(*) FILTER (severity = 'critical') AS c
         FROM questions GROUP BY 1) q ON pl.ledger_id = q.ledger_id""", uses=("pl", "questions"))

# --- retrieval -----------------------------------------------------------------------


def words(ws: list[str]) -> str:
    return "[" + ", ".join(f"'{w}'" for w in dict.fromkeys(ws)) + "]"


def qtok(c: str) -> str:
    return (f"list_distinct(list_filter(regexp_split_to_array(regexp_replace(lower({c}), '[^a-zA-Z0-9_\\s]', ' ', 'g'), '\\s+'), "
            f"lambda t: length(t) > 2 AND NOT list_contains({words(T.STOP_WORDS)}, t)))")


SIM = f"""LEAST(1.0, CAST(len(list_intersect(qt, et)) AS DOUBLE) / (len(qt) + len(et) - len(list_intersect(qt, et)))
  + len(list_filter(list_intersect(qt, et), lambda t: list_contains({words(T.FINANCE_TERMS)}, t))) * CAST(0.05 AS DOUBLE))"""


def asked(d):
    return qlog(d).select("ledger_id", F.col("query_id").alias("question_id"), "question")


register("text_similarity",
         lambda d: d.table("conversations").alias("a").join(
             d.table("conversations").alias("b"), (F.col("a.conv_id") == F.col("b.conv_id"))
             & (F.col("b.turn") == F.col("a.turn") + 1)).select(
             F.col("a.conv_id").alias("conv_id"), F.col("a.turn").alias("turn"),
             F.round(T.text_similarity(F.col("a.text"), F.col("b.text")), 6).alias("similarity")),
         f"""SELECT conv_id, turn, CASE WHEN len(qt) = 0 OR len(et) = 0 THEN 0.0 ELSE ROUND({SIM}, 6) END AS similarity FROM (
         SELECT a.conv_id, a.turn, {qtok('a.text')} AS qt, {qtok('b.text')} AS et FROM conversations a JOIN conversations b
         ON a.conv_id = b.conv_id AND b.turn = a.turn + 1)""", uses=())
register("similar_questions", lambda d: T.similar_questions(asked(d), qlog(d), AS_OF), f"""
  WITH good AS (SELECT ledger_id, query_id, created_at, {qtok('question')} AS et FROM qlog WHERE status = 'COMPLETED'
    AND generated_sql IS NOT NULL AND confidence >= 0.7 AND created_at >= {AS} - 180
    AND (row_count IS NULL OR row_count > 0) AND feedback IS NULL),
  q AS (SELECT ledger_id, query_id AS question_id, {qtok('question')} AS qt FROM qlog),
  cand AS (SELECT l.ledger_id AS scope, g.*, CASE WHEN l.ledger_id = g.ledger_id THEN 1 ELSE 2 END AS path
    FROM (SELECT DISTINCT ledger_id FROM q) l, good g),
  s AS (SELECT q.ledger_id, question_id, cand.query_id AS example_id, cand.path, created_at, {SIM} AS raw
    FROM q JOIN cand ON q.ledger_id = cand.scope WHERE len(list_intersect(qt, et)) > 0),
  k AS (SELECT *, COUNT(*) FILTER (path = 1) OVER (PARTITION BY ledger_id, question_id) AS n1 FROM s WHERE raw > 0.3)
  SELECT ledger_id, question_id, example_id, path, CAST(ROW_NUMBER() OVER w AS INTEGER) AS rank, ROUND(raw, 6) AS similarity
  FROM k WHERE path = 1 OR n1 < 3
  WINDOW w AS (PARTITION BY ledger_id, question_id ORDER BY path, ROUND(raw, 6) DESC, created_at DESC, example_id DESC)
  QUALIFY ROW_NUMBER() OVER w <= 5""",
         uses=("qlog",))


def vectors(d):
    """Every knowledge row asks with its own vector."""
    return kb(d).select("ledger_id", F.col("answer_id").alias("question_id"), F.col("embedding").alias("query_vector"))


def index(d):
    """The vector index of the knowledge rows, written once for the application."""
    return built(d.spark, "vector_index", d.sf_dir, lambda path: vector_index.build(kb(d), path), lambda path: vector_index.load(d.spark, path))


cte("vq", "SELECT ledger_id, answer_id AS question_id, embedding AS v FROM kb", uses=("kb",))


def vec(n: float) -> str:
    return f"""SELECT * FROM (SELECT kb.ledger_id, question_id, answer_id, ROUND(list_cosine_similarity(
      CAST(embedding AS DOUBLE[]), CAST(v AS DOUBLE[])), 6) AS similarity FROM kb JOIN vq ON kb.ledger_id = vq.ledger_id
      WHERE verdict <> 'REJECTED' QUALIFY ROW_NUMBER() OVER (PARTITION BY kb.ledger_id, question_id
      ORDER BY similarity DESC, answer_id) <= 5) WHERE similarity >= {n}"""


register("vector_topk", lambda d: T.vector_topk(vectors(d), index(d), 5, 0.1), vec(0.1), uses=("vq",))
STEM = """CASE WHEN w LIKE '%ies' AND length(w) > 4 THEN left(w, length(w) - 3) || 'y' WHEN w LIKE '%es' AND length(w) > 4
  THEN left(w, length(w) - 2) WHEN w LIKE '%s' AND length(w) > 3 THEN left(w, length(w) - 1) WHEN w LIKE '%ing'
  AND length(w) > 5 THEN left(w, length(w) - 3) WHEN w LIKE '%ed' AND length(w) > 4 THEN left(w, length(w) - 2) ELSE w END"""


def kwords(c: str) -> str:
    return (f"list_distinct(list_transform(list_filter(regexp_extract_all(lower({c}), '[a-z][a-z0-9]+'), "
            f"lambda w: length(w) >= 3 AND NOT list_contains({words(T.NOISE_WORDS)}, w)), lambda w: {STEM}))")


cte("kwhits", f"""WITH rows AS (SELECT ledger_id, answer_id, confidence * LEAST(2.0, 1 + log10(reaffirmation_count))
    * CASE WHEN {AS} - last_reaffirmed_at < 365 THEN 1.0 ELSE GREATEST(0.5, 1.0 - CAST({AS} - last_reaffirmed_at - 365
      AS DOUBLE) / 730) END AS weight, unnest({kwords("context || ' ' || answer")}) AS word
    FROM kb WHERE verdict <> 'REJECTED' AND confidence >= 0.4),
  q AS (SELECT ledger_id, query_id AS question_id, unnest({kwords('question')}) AS word FROM qlog)
  SELECT q.ledger_id, question_id, answer_id, ROUND(COUNT(*) * MAX(weight), 6) AS score FROM q JOIN rows
  ON q.ledger_id = rows.ledger_id AND q.word = rows.word GROUP BY 1, 2, 3""", uses=("kb", "qlog"))
KTOP = "QUALIFY ROW_NUMBER() OVER (PARTITION BY ledger_id, question_id ORDER BY score DESC, answer_id) <= 5"
register("keyword_retrieval", lambda d: T.keyword_retrieval(asked(d), kb(d), AS_OF), f"SELECT * FROM kwhits {KTOP}",
         uses=("kwhits",))


def _prompt_vectors(d):
    """A question carries the vector of the knowledge row with its number, where there is one."""
    return asked(d).withColumn("slot", F.floor(F.col("question_id") / 1000)).join(
        d.table("embeddings").select(F.col("vec_id").alias("slot"), F.col("embedding").alias("query_vector")), "slot").select(
        "ledger_id", "question_id", "query_vector")


register("knowledge_context", lambda d: T.knowledge_context(asked(d), _prompt_vectors(d), kb(d), index(d), AS_OF), f"""
  WITH pv AS (SELECT ledger_id, query_id AS question_id, embedding AS v FROM qlog JOIN embeddings
    ON vec_id = query_id // 1000),
  vs AS (SELECT kb.ledger_id, question_id, answer_id, ROUND(list_cosine_similarity(CAST(embedding AS DOUBLE[]),
    CAST(v AS DOUBLE[])), 6) AS score FROM kb JOIN pv ON kb.ledger_id = pv.ledger_id WHERE verdict <> 'REJECTED'),
  vm AS (SELECT * FROM (SELECT * FROM vs {KTOP}) WHERE score >= 0.55)
  SELECT ledger_id, question_id, answer_id, 'vector' AS retrieval, score FROM vm
  UNION ALL SELECT ledger_id, question_id, answer_id, 'keyword' AS retrieval, score FROM (SELECT * FROM kwhits
    WHERE NOT EXISTS (SELECT 1 FROM vm WHERE vm.ledger_id = kwhits.ledger_id AND vm.question_id = kwhits.question_id) {KTOP})""",
         uses=("kwhits",))
register("query_log_page", lambda d: T.query_log_page(qlog(d), 50, status="COMPLETED", date_from="2001-01-01", cursor=("2001-06-01", 50000))
         .select("query_id", "ledger_id", "confidence", "created_at"),
         """SELECT query_id, ledger_id, confidence, created_at FROM qlog WHERE status = 'COMPLETED'
         AND created_at >= DATE '2001-01-01' AND (created_at < DATE '2001-06-01' OR (created_at = DATE '2001-06-01' AND query_id < 50000)) ORDER BY created_at DESC, query_id DESC LIMIT 50""", uses=("qlog",))

# --- pulse ---------------------------------------------------------------------------


def contexts(d):
    k = F.col("ledger_id")
    return d.gl.groupBy("ledger_id").agg(F.max("transaction_date").alias("gl_max_date")).select(
        "ledger_id", F.when(k % 3 == 0, F.array(F.lit("GL"), F.lit("ITR"))).otherwise(F.array(F.lit("GL"))).alias("document_types"),
        F.when(k % 11 == 5, "HISTORICAL").otherwise("CURRENT_OPERATIONAL").alias("data_intent"), "gl_max_date",
        F.when(k % 7 == 2, F.array(F.lit("tds_deadline"))).otherwise(F.array().cast("array<string>")).alias("snoozed"))


def side(p: str, wrap: str = "{}") -> str:
    p = p.replace("'", "''")
    hit = f"regexp_matches(lower(account_name), '{p}')"
    return f"CASE WHEN BOOL_OR({hit}) THEN {r2(wrap.format(f'SUM(CASE WHEN {hit} THEN net_amount ELSE 0 END)'))} END"


cte("snap", f"""SELECT ledger_id, {side(P.CASH_BANK)} AS cash_and_bank, {side(P.RECEIVABLE)} AS receivables,
  {side(P.PAYABLE, 'ABS({})')} AS payables FROM gl GROUP BY 1""", uses=("gl",))
cte("ptds", """SELECT ledger_id, COALESCE(vendor_name, party_name, account_name) AS vendor, SUM(ABS(net_amount)) AS paid FROM gl
  WHERE lower(voucher_type) IN ('payment', 'bank payment', 'cash payment') GROUP BY 1, 2
  HAVING SUM(ABS(net_amount)) >= 30000 AND NOT BOOL_OR(lower(account_name) LIKE '%tds%')""", uses=("gl",))
cte("dead", f"""SELECT ledger_id, category, severity, due_date, CAST(due_date - {AS} AS INTEGER) AS days_left FROM
  (SELECT ledger_id, MAX(transaction_date) AS newest FROM gl GROUP BY 1) JOIN (VALUES ('tds_deadline', 'review', DATE '2001-08-07'),
    ('itr_deadline', 'critical', DATE '2001-07-31')) v(category, severity, due_date)
  ON (category = 'tds_deadline' AND ledger_id % 7 <> 2) OR (category = 'itr_deadline' AND ledger_id % 3 = 0)
  WHERE ledger_id % 11 <> 5 AND ({AS} - newest <= 90 OR newest IS NULL)""", uses=("gl",))
register("pulse_snapshot", lambda d: P.pulse_snapshot(d.gl), "SELECT * FROM snap", uses=("snap",))
TDS = """SELECT ledger_id, COUNT(*) AS vendors, CAST(ROUND(SUM(paid * 0.02), 2) AS DOUBLE) AS tds_estimate,
  'tds_calculator' AS category, 'review' AS severity FROM ptds GROUP BY 1"""
register("pulse_tds", lambda d: P.pulse_tds(d.gl), TDS, uses=("ptds",))
register("pulse_deadlines", lambda d: P.pulse_deadlines(contexts(d), AS_OF), "SELECT * FROM dead", uses=("dead",))
register("pulse_digest", lambda d: P.pulse_digest(d.gl, contexts(d), AS_OF), f"""
  WITH a AS (SELECT ledger_id, category, severity FROM dead UNION ALL SELECT ledger_id, category, severity FROM ({TDS}))
  SELECT s.ledger_id, {AS} AS day, COALESCE(n, 0) AS alerts, COALESCE(c, 0) AS critical, COALESCE(cats, '') AS categories,
    cash_and_bank, receivables, payables FROM snap s LEFT JOIN (SELECT ledger_id, COUNT(*) AS n,
    COUNT(*) FILTER (severity = 'critical') AS c, string_agg(category, ',' ORDER BY category) AS cats FROM a GROUP BY 1) x
    ON s.ledger_id = x.ledger_id""", uses=("snap", "ptds", "dead"))
