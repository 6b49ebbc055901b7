"""DuckDB oracle SQL, written from the operator semantics (not from the
DataFrame code).  Every statement starts from the driver's tables through
the same adapter views the Spark jobs use."""

from __future__ import annotations

from clientlens.operators import actions as _act

ADAPTERS = """
clients AS (
  SELECT c.c_custkey AS client_id, n.n_name AS ville,
    CASE WHEN c.c_mktsegment IN ('AUTOMOBILE','BUILDING') THEN 'pro'
         WHEN c.c_mktsegment IN ('FURNITURE','HOUSEHOLD') THEN 'basic' ELSE 'free' END AS plan,
    DATE '1994-01-01' + CAST(c.c_custkey % 365 AS INT) AS date_inscription
  FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey),
subscriptions AS (
  SELECT o_custkey AS client_id, CAST(o_totalprice AS DECIMAL(18,2)) AS montant,
    CAST(o_orderdate AS DATE) AS date_paiement,
    CASE o_orderstatus WHEN 'F' THEN 'paid' WHEN 'O' THEN 'failed' ELSE 'cancelled' END AS statut,
    o_orderkey AS payment_id FROM orders),
usage_ AS (
  SELECT user_id AS client_id, CAST(FLOOR(value) AS INT) AS actions,
    CASE WHEN event_type IN ('view','signup') THEN 1 ELSE 0 END AS sessions,
    CAST(ts AS DATE) - CAST(user_id % 30 AS INT) AS activity_date, event_id FROM events),
revenue_events AS (
  SELECT user_id AS client_id,
    CASE event_type WHEN 'purchase' THEN 'one_shot' WHEN 'signup' THEN 'upsell' WHEN 'click' THEN 'extra_service' ELSE event_type END AS event_type,
    CAST(value AS DECIMAL(18,2)) AS amount, CAST(ts AS DATE) AS event_date, event_id
  FROM events)
"""

# Shared derived views, each defined once from the semantics text.
VIEWS = {
    "report": """
report AS (
  SELECT ids.client_id, c.plan, c.ville,
    CAST(COALESCE(p.ca, 0) AS DOUBLE) AS ca_total,
    CAST(COALESCE(p.n, 0) AS BIGINT) AS nb_paiements,
    CAST(COALESCE(u.a, 0) AS BIGINT) AS actions_total,
    CAST(COALESCE(u.s, 0) AS BIGINT) AS sessions_total,
    p.last_pay AS last_payment_date, u.last_act AS last_activity_date
  FROM (SELECT client_id FROM clients
        UNION SELECT client_id FROM subscriptions WHERE statut = 'paid'
        UNION SELECT client_id FROM usage_) ids
  LEFT JOIN clients c USING (client_id)
  LEFT JOIN (SELECT client_id, SUM(montant) ca, COUNT(*) n, MAX(date_paiement) last_pay
             FROM subscriptions WHERE statut = 'paid' GROUP BY client_id) p USING (client_id)
  LEFT JOIN (SELECT client_id, SUM(actions) a, SUM(sessions) s, MAX(activity_date) last_act
             FROM usage_ GROUP BY client_id) u USING (client_id))""",
    "paid": """
paid AS (
  SELECT client_id, CAST(SUM(montant) AS DOUBLE) AS ca_total, CAST(COUNT(*) AS BIGINT) AS nb_paiements,
         MAX(date_paiement) AS last_payment_date
  FROM subscriptions WHERE statut = 'paid' GROUP BY client_id)""",
    "uk": """
uk AS (
  SELECT client_id, CAST(SUM(actions) AS BIGINT) AS actions_total, CAST(SUM(sessions) AS BIGINT) AS sessions_total,
         MAX(activity_date) AS last_activity_date, CAST(COUNT(DISTINCT activity_date) AS BIGINT) AS days_active,
         CAST(SUM(actions) AS DOUBLE) / COUNT(DISTINCT activity_date) AS freq_actions
  FROM usage_ GROUP BY client_id)""",
    "kpi": """
kpi AS (
  SELECT c.client_id, c.ville, c.plan, c.date_inscription,
    COALESCE(p.ca_total, 0.0) AS ca_total, COALESCE(p.nb_paiements, 0) AS nb_paiements, p.last_payment_date,
    COALESCE(u.actions_total, 0) AS actions_total, COALESCE(u.sessions_total, 0) AS sessions_total,
    u.last_activity_date, COALESCE(u.days_active, 0) AS days_active, COALESCE(u.freq_actions, 0.0) AS freq_actions,
    CAST((SELECT MAX(activity_date) FROM usage_) - c.date_inscription AS INT) AS tenure_days,
    CAST((SELECT MAX(activity_date) FROM usage_) - u.last_activity_date AS INT) AS days_since_last_activity
  FROM clients c LEFT JOIN paid p USING (client_id) LEFT JOIN uk u USING (client_id))""",
}

# view dependencies (emitted in this order)
_VIEW_ORDER = ["report", "paid", "uk", "kpi"]
_VIEW_DEPS = {"kpi": ["paid", "uk"]}


def with_views(body: str, *views: str) -> str:
    need: list[str] = []

    def add(v: str) -> None:
        for d in _VIEW_DEPS.get(v, []):
            add(d)
        if v not in need:
            need.append(v)

    for v in views:
        add(v)
    need.sort(key=_VIEW_ORDER.index)
    ctes = ",\n".join([ADAPTERS.strip()] + [VIEWS[v].strip() for v in need])
    body = body.strip()
    kw = "WITH RECURSIVE" if any(v in globals().get("RECURSIVE_VIEWS", ()) for v in need) else "WITH"
    if body.upper().startswith("WITH "):  # the body brings its own CTEs: chain them
        return f"{kw} {ctes},\n{body[5:]}"
    return f"{kw} {ctes}\n{body}"


SQL: dict[str, str] = {}


def register(name: str, body: str, *views: str) -> None:
    SQL[name] = with_views(body, *views)


register("client_report", "SELECT * FROM report", "report")
register("paid_kpis", "SELECT * FROM paid", "paid")
register("usage_kpis", "SELECT * FROM uk", "uk")
register(
    "kpi_by_client",
    "SELECT *, CAST(COALESCE(days_since_last_activity, 9999) > 14 AS INT) AS churn_heuristic FROM kpi",
    "kpi",
)
register(
    "ml_ready_v1",
    """SELECT client_id, plan, ville, tenure_days, ca_total, nb_paiements, actions_total, sessions_total,
       days_active, freq_actions, days_since_last_activity,
       CAST(COALESCE(days_since_last_activity, 9999) > 14 AS INT) AS churn_heuristic FROM kpi""",
    "kpi",
)
register(
    "top_clients",
    "SELECT * FROM report ORDER BY ca_total DESC, actions_total DESC, client_id LIMIT 10",
    "report",
)
register(
    "revenue_by_plan",
    """SELECT plan, CAST(SUM(CAST(ca_total AS DECIMAL(28,2))) AS DOUBLE) AS ca_total,
       CAST(COUNT(client_id) AS BIGINT) AS nb_clients,
       ROUND(AVG(CAST(ca_total AS DECIMAL(28,2))), 6) AS ca_moyen_client
       FROM report WHERE plan IS NOT NULL GROUP BY plan""",
    "report",
)

# --------------------------------------------------------------- churn
VIEWS["churn"] = """
churn AS (
  SELECT f.client_id, f.paid_count_before_T, f.paid_sum_before_T, f.last_paid_before_T,
         f.days_since_last_paid,
         CASE WHEN f.client_id IN (SELECT client_id FROM subscriptions WHERE statut = 'paid'
              AND date_paiement BETWEEN DATE '2001-01-08' AND DATE '2001-01-31') THEN 0 ELSE 1 END AS churn_7_30j,
         r.plan, r.ville
  FROM (SELECT client_id, CAST(COUNT(date_paiement) AS BIGINT) AS paid_count_before_T,
               CAST(COALESCE(SUM(montant), 0) AS DOUBLE) AS paid_sum_before_T,
               MAX(date_paiement) AS last_paid_before_T,
               CAST(DATE '2001-01-01' - MAX(date_paiement) AS INT) AS days_since_last_paid
        FROM subscriptions WHERE date_paiement < DATE '2001-01-01' GROUP BY client_id) f
  LEFT JOIN report r USING (client_id)
  WHERE r.plan IS NOT NULL AND r.ville IS NOT NULL)"""
_VIEW_ORDER.append("churn")
_VIEW_DEPS["churn"] = ["report"]

register(
    "pre_t_features",
    """SELECT client_id, CAST(COUNT(date_paiement) AS BIGINT) AS paid_count_before_T,
       CAST(COALESCE(SUM(montant), 0) AS DOUBLE) AS paid_sum_before_T, MAX(date_paiement) AS last_paid_before_T,
       CAST(DATE '2001-01-01' - MAX(date_paiement) AS INT) AS days_since_last_paid
       FROM subscriptions WHERE date_paiement < DATE '2001-01-01' GROUP BY client_id""",
)
register(
    "churn_label",
    """SELECT p.client_id, CASE WHEN EXISTS (SELECT 1 FROM subscriptions s WHERE s.client_id = p.client_id
         AND s.statut = 'paid' AND s.date_paiement BETWEEN DATE '2001-01-08' AND DATE '2001-01-31') THEN 0 ELSE 1 END
         AS churn_7_30j
       FROM (SELECT DISTINCT client_id FROM subscriptions WHERE date_paiement < DATE '2001-01-01') p""",
)
register(
    "label_population_diff",
    """SELECT client_id FROM subscriptions WHERE date_paiement < DATE '2001-01-01'
       EXCEPT SELECT client_id FROM subscriptions WHERE statut = 'paid'
         AND date_paiement BETWEEN DATE '2001-01-08' AND DATE '2001-01-31'""",
)
register(
    "coverage_guard",
    """SELECT MAX(date_paiement) AS max_payment, DATE '2001-01-31' AS required,
       COALESCE(MAX(date_paiement) >= DATE '2001-01-31', false) AS ok FROM subscriptions""",
)
register("churn_ready", "SELECT * FROM churn", "churn")
register(
    "reference_date",
    "SELECT COALESCE(MAX(last_activity_date), MAX(last_payment_date)) AS reference_date FROM report",
    "report",
)
register(
    "serving_features",
    """SELECT client_id, nb_paiements AS paid_count_before_T, ca_total AS paid_sum_before_T,
       COALESCE(GREATEST(CAST((SELECT COALESCE(MAX(last_activity_date), MAX(last_payment_date)) FROM report)
                 - last_payment_date AS INT), 0), 999) AS days_since_last_paid, plan, ville FROM report""",
    "report",
)
register(
    "temporal_split",
    """WITH o AS (
         SELECT *, CAST(ROW_NUMBER() OVER (ORDER BY days_since_last_paid, client_id) - 1 AS BIGINT) AS position,
                COUNT(*) OVER () AS n FROM churn),
       s AS (SELECT *, position >= n - GREATEST(1, CAST(round_even(n * 0.3, 0) AS BIGINT)) AS is_test FROM o),
       g AS (SELECT bool_or(NOT is_test AND churn_7_30j = 0) tr0, bool_or(NOT is_test AND churn_7_30j = 1) tr1,
                    bool_or(churn_7_30j = 0) a0, bool_or(churn_7_30j = 1) a1,
                    MIN(CASE WHEN is_test AND churn_7_30j = 1 THEN position END) AS first1 FROM s)
       SELECT s.client_id, s.paid_count_before_T, s.paid_sum_before_T, s.last_paid_before_T, s.days_since_last_paid,
              s.churn_7_30j, s.plan, s.ville, s.position,
              CASE WHEN s.is_test AND NOT (g.a0 AND g.a1 AND NOT (g.tr0 AND g.tr1) AND s.position = g.first1)
                   THEN 'test' ELSE 'train' END AS split
       FROM s CROSS JOIN g""",
    "churn",
)
register(
    "ml_ready",
    """SELECT client_id, nb_paiements, actions_total, sessions_total, plan, ville,
       CAST((SELECT MAX(last_activity_date) FROM report) - last_activity_date AS INT) AS anciennete_jours, ca_total
       FROM report WHERE plan IS NOT NULL AND ville IS NOT NULL AND last_activity_date IS NOT NULL""",
    "report",
)
register(
    "churn_rule_summary",
    """SELECT MAX(last_activity_date) AS date_ref,
       CAST(COUNT(*) FILTER (WHERE nb_paiements = 0
            AND (SELECT MAX(last_activity_date) FROM report) - last_activity_date > 30) AS BIGINT) AS nb_churn,
       CAST(COUNT(*) AS BIGINT) AS nb_clients,
       ROUND(COALESCE(CAST(COUNT(*) FILTER (WHERE nb_paiements = 0
            AND (SELECT MAX(last_activity_date) FROM report) - last_activity_date > 30) AS DOUBLE) / NULLIF(COUNT(*), 0), 0), 6)
         AS taux_churn FROM report""",
    "report",
)
register(
    "churn_rule_list",
    """SELECT client_id, plan, ville, nb_paiements,
       CAST((SELECT MAX(last_activity_date) FROM report) - last_activity_date AS INT) AS anciennete_jours,
       last_activity_date FROM report
       WHERE nb_paiements = 0 AND (SELECT MAX(last_activity_date) FROM report) - last_activity_date > 30""",
    "report",
)
register(
    "churn_distribution",
    "SELECT churn_7_30j, CAST(COUNT(*) AS BIGINT) AS n_clients FROM churn GROUP BY churn_7_30j",
    "churn",
)

# --------------------------------------------------------------- views
register(
    "watchlist",
    """SELECT client_id, plan, ville, days_since_last_paid, paid_count_before_T,
       ROUND(paid_sum_before_T, 2) AS paid_sum_before_T, last_paid_before_T FROM churn
       ORDER BY days_since_last_paid DESC NULLS LAST, paid_count_before_T ASC NULLS LAST,
                paid_sum_before_T ASC NULLS LAST, client_id LIMIT 30""",
    "churn",
)
VIEWS["inactive"] = """
inactive AS (SELECT client_id, plan, ville, days_since_last_paid, last_paid_before_T FROM churn
  WHERE days_since_last_paid IS NOT NULL ORDER BY days_since_last_paid DESC, client_id LIMIT 20)"""
VIEWS["lowhist"] = """
lowhist AS (SELECT client_id, plan, ville, paid_count_before_T, paid_sum_before_T FROM churn
  WHERE paid_count_before_T IS NOT NULL AND paid_sum_before_T IS NOT NULL
  ORDER BY paid_count_before_T, paid_sum_before_T, client_id LIMIT 20)"""
_VIEW_ORDER += ["inactive", "lowhist"]
_VIEW_DEPS["inactive"] = ["churn"]
_VIEW_DEPS["lowhist"] = ["churn"]
register("at_risk_inactive", "SELECT * FROM inactive", "inactive")
register("at_risk_low_history", "SELECT * FROM lowhist", "lowhist")
register("at_risk_union", "SELECT client_id FROM inactive UNION SELECT client_id FROM lowhist", "inactive", "lowhist")
register(
    "health_overview",
    """SELECT CAST(COUNT(*) AS BIGINT) AS n_clients, ROUND(AVG(days_since_last_paid), 6) AS avg_days,
       ROUND(AVG(paid_count_before_T), 6) AS avg_paid_count, ROUND(AVG(paid_sum_before_T), 6) AS avg_paid_sum,
       ROUND(quantile_cont(days_since_last_paid, 0.5), 6) AS med_days FROM churn""",
    "churn",
)
register(
    "plan_distribution",
    "SELECT plan, CAST(COUNT(*) AS BIGINT) AS clients FROM churn WHERE plan IS NOT NULL GROUP BY plan",
    "churn",
)
register(
    "segment_facts",
    """SELECT plan, CAST(COUNT(*) AS BIGINT) AS n_clients, CAST(COUNT(DISTINCT ville) AS BIGINT) AS n_villes
       FROM churn WHERE plan IS NOT NULL GROUP BY plan""",
    "churn",
)
VIEWS["meds"] = """
meds AS (
  SELECT plan AS scope, quantile_cont(days_since_last_paid, 0.5) AS md, quantile_cont(paid_count_before_T, 0.5) AS mc,
         quantile_cont(paid_sum_before_T, 0.5) AS ms FROM churn WHERE plan IS NOT NULL GROUP BY plan
  UNION ALL
  SELECT '(global)', quantile_cont(days_since_last_paid, 0.5), quantile_cont(paid_count_before_T, 0.5),
         quantile_cont(paid_sum_before_T, 0.5) FROM churn)"""
VIEWS["pct"] = """
pct AS (
  SELECT client_id, plan, indicator, value,
         round_even(100.0 * CUME_DIST() OVER (PARTITION BY plan, indicator ORDER BY value), 1) AS percentile_in_plan
  FROM (SELECT client_id, plan, 'days_since_last_paid' AS indicator, CAST(days_since_last_paid AS DOUBLE) AS value FROM churn
        UNION ALL SELECT client_id, plan, 'paid_count_before_T', CAST(paid_count_before_T AS DOUBLE) FROM churn
        UNION ALL SELECT client_id, plan, 'paid_sum_before_T', paid_sum_before_T FROM churn) l
  WHERE plan IS NOT NULL)"""
_VIEW_ORDER += ["meds", "pct"]
_VIEW_DEPS["meds"] = ["churn"]
_VIEW_DEPS["pct"] = ["churn"]
register(
    "plan_medians",
    """SELECT scope, ROUND(md, 6) AS median_days_since_last_paid, ROUND(mc, 6) AS median_paid_count_before_T,
       ROUND(ms, 6) AS median_paid_sum_before_T FROM meds""",
    "meds",
)
register("percentile_in_plan", "SELECT * FROM pct", "pct")
register(
    "client_comparison",
    """SELECT p.client_id, p.plan, p.indicator, round_even(p.value, 2) AS client_value,
       round_even(CASE p.indicator WHEN 'days_since_last_paid' THEN ROUND(m.md, 6)
            WHEN 'paid_count_before_T' THEN ROUND(m.mc, 6) ELSE ROUND(m.ms, 6) END, 2) AS plan_median,
       round_even(CASE p.indicator WHEN 'days_since_last_paid' THEN ROUND(g.md, 6)
            WHEN 'paid_count_before_T' THEN ROUND(g.mc, 6) ELSE ROUND(g.ms, 6) END, 2) AS global_median,
       p.percentile_in_plan
       FROM pct p LEFT JOIN meds m ON m.scope = p.plan LEFT JOIN meds g ON g.scope = '(global)'""",
    "meds", "pct",
)
register(
    "client_signals",
    """SELECT c.client_id, c.plan, c.ville,
       COALESCE(c.days_since_last_paid > ROUND(m.md, 6), false) AS inactivity_high,
       COALESCE(c.paid_count_before_T < ROUND(m.mc, 6), false) OR COALESCE(c.paid_sum_before_T < ROUND(m.ms, 6), false)
         AS history_low
       FROM churn c LEFT JOIN meds m ON m.scope = c.plan""",
    "meds",
)
register(
    "client_fact_sheet",
    """SELECT client_id, plan, ville, CAST(days_since_last_paid AS BIGINT) AS days_since_last_paid,
       CAST(paid_count_before_T AS BIGINT) AS paid_count_before_T, ROUND(paid_sum_before_T, 2) AS paid_sum_before_T,
       strftime(last_paid_before_T, '%Y-%m-%d') AS last_paid_before_T FROM churn""",
    "churn",
)
register(
    "ca_quantile",
    """SELECT CASE WHEN q IS NULL OR q <= 0 THEN 300.0 ELSE ROUND(q, 6) END AS ca_threshold
       FROM (SELECT quantile_cont(ca_total, 0.8) AS q FROM report)""",
    "report",
)
register(
    "dedup_first",
    """SELECT client_id, montant, date_paiement, statut, payment_id FROM (
         SELECT client_id, CAST(montant AS DOUBLE) AS montant, date_paiement, statut, payment_id,
                ROW_NUMBER() OVER (PARTITION BY client_id ORDER BY date_paiement, payment_id) AS rn
         FROM subscriptions) WHERE rn = 1""",
)

# ------------------------------------------- revenue, policy, decisions
register(
    "revenue_summary",
    """SELECT client_id, CAST(SUM(COALESCE(amount, 0)) AS DOUBLE) AS total_amount, CAST(COUNT(*) AS BIGINT) AS events_count,
       (SELECT string_agg(event_type || ':' || n, ',' ORDER BY event_type) FROM
          (SELECT event_type, COUNT(*) AS n FROM revenue_events r2 WHERE r2.client_id = r.client_id GROUP BY event_type)) AS types,
       MAX(event_date) AS most_recent_date
       FROM revenue_events r GROUP BY client_id""",
)
register(
    "revenue_type_counts",
    "SELECT client_id, event_type, CAST(COUNT(*) AS BIGINT) AS n_events FROM revenue_events GROUP BY client_id, event_type",
)
VIEWS["feats"] = """
sc AS (SELECT client_id, CASE WHEN client_id % 17 = 0 THEN NULL
                         ELSE CAST((client_id * 37) % 100 AS DOUBLE) / 100 END AS p FROM report),
feats AS (
  SELECT r.client_id, r.plan, r.ville,
    CASE WHEN sc.p > 0.5 THEN 'high' WHEN sc.p IS NULL THEN 'medium' WHEN sc.p < 0.2 THEN 'low'
         WHEN sc.p < 0.5 THEN 'medium' ELSE 'high' END AS churn_risk,
    CASE WHEN r.sessions_total >= 30 THEN 'high' WHEN r.sessions_total <= 8 THEN 'low' ELSE 'medium' END AS usage_level,
    r.ca_total >= (SELECT CASE WHEN q IS NULL OR q <= 0 THEN 300.0 ELSE ROUND(q, 6) END
                   FROM (SELECT quantile_cont(ca_total, 0.8) AS q FROM report)) AS ca_total_high,
    COALESCE((SELECT MAX(event_date) FROM revenue_events) - rv.mr BETWEEN 0 AND 30, false) AS recent_one_shot
  FROM report r LEFT JOIN sc USING (client_id)
  LEFT JOIN (SELECT client_id, MAX(event_date) AS mr FROM revenue_events GROUP BY client_id) rv USING (client_id)),
ruled AS (
  SELECT *, CASE
      WHEN churn_risk = 'high' AND ca_total_high THEN 1
      WHEN recent_one_shot AND churn_risk IN ('medium', 'high') THEN 2
      WHEN usage_level = 'high' AND churn_risk = 'low' THEN 3
      WHEN usage_level = 'low' AND churn_risk = 'medium' THEN 4 END AS rule_priority
  FROM feats),
decided AS (
  SELECT client_id, plan, ville, churn_risk, usage_level, rule_priority,
    CASE rule_priority WHEN 1 THEN 'appel_urgent_48h' WHEN 2 THEN 'appel_reassurance_et_plan'
         WHEN 3 THEN 'proposer_upsell' WHEN 4 THEN 'onboarding_cible' ELSE 'no_action' END AS action,
    COALESCE(CAST(rule_priority AS VARCHAR), 'low') AS priority,
    CASE rule_priority WHEN 1 THEN 'Risque de perte + impact financier important'
         WHEN 2 THEN 'Achat récent ≠ fidélité ; sécuriser la relation'
         WHEN 3 THEN 'Client engagé => opportunité d’augmenter le panier'
         WHEN 4 THEN 'Réactiver avant que l’inertie devienne churn'
         ELSE 'Aucune règle métier déclenchée' END AS rationale,
    CASE WHEN rule_priority IS NULL THEN 'low' ELSE 'medium' END AS confidence,
    CASE WHEN rule_priority IS NULL THEN 'signal client insuffisant' ELSE '' END AS missing_data
  FROM ruled)"""
_VIEW_ORDER.append("feats")
_VIEW_DEPS["feats"] = ["report"]
register(
    "risk_bucket",
    """SELECT client_id, p AS churn_probability, p > 0.5 AS churn,
       CASE WHEN p > 0.5 THEN 'high' WHEN p IS NULL THEN 'medium' WHEN p < 0.2 THEN 'low'
            WHEN p < 0.5 THEN 'medium' ELSE 'high' END AS churn_risk FROM sc""",
    "feats",
)
register("rule_features", "SELECT client_id, churn_risk, usage_level, ca_total_high, recent_one_shot FROM feats", "feats")
register(
    "apply_policy",
    """SELECT client_id, CASE rule_priority WHEN 1 THEN 'Churn élevé + client à fort CA'
         WHEN 2 THEN 'One-shot récent + churn moyen/élevé' WHEN 3 THEN 'Usage fort + churn faible => upsell'
         WHEN 4 THEN 'Usage faible + churn moyen' END AS rule_name, CAST(rule_priority AS INTEGER) AS rule_priority FROM ruled""",
    "feats",
)
register(
    "decide_action",
    "SELECT client_id, action, priority, rationale, confidence, missing_data FROM decided",
    "feats",
)
register(
    "action_mix",
    "SELECT action, plan, CAST(COUNT(*) AS BIGINT) AS n_clients FROM decided GROUP BY action, plan",
    "feats",
)

# ------------------------------------------------------------ retrieval
# Python/Java Unicode whitespace spelled out for RE2
WS = r"[\t\n\x{0b}\f\r \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
TOKCLASS = r"[^a-z0-9àâçéèêëîïôûùüÿñæœ_\-\t\n\x{0b}\f\r \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def _strip(x: str) -> str:
    return f"regexp_replace({x}, '^{WS}+|{WS}+$', '', 'g')"


def _tokens(x: str) -> str:
    # raw split; callers unnest and keep tokens of length >= 3
    return f"regexp_split_to_array(regexp_replace(lower({x}), '{TOKCLASS}', ' ', 'g'), '{WS}+')"


VIEWS["paras"] = f"""
parts AS (
  SELECT doc_id, i, {_strip('p0')} AS p
  FROM (SELECT doc_id, unnest(ps) AS p0, generate_subscripts(ps, 1) AS i
        FROM (SELECT doc_id, regexp_split_to_array(COALESCE(text, ''), '\\n{WS}*\\n') AS ps FROM documents))),
paras AS (SELECT doc_id, ROW_NUMBER() OVER (PARTITION BY doc_id ORDER BY i) AS idx, p FROM parts WHERE length(p) > 0),
pack AS (
  SELECT doc_id, idx, 0 AS chunk_no, p AS buf FROM paras WHERE idx = 1
  UNION ALL
  SELECT k.doc_id, q.idx,
    CASE WHEN length(k.buf) + length(q.p) + 2 <= 900 THEN k.chunk_no ELSE k.chunk_no + 1 END,
    CASE WHEN length(k.buf) + length(q.p) + 2 <= 900 THEN k.buf || chr(10) || chr(10) || q.p ELSE q.p END
  FROM pack k JOIN paras q ON q.doc_id = k.doc_id AND q.idx = k.idx + 1),
pchunks AS (SELECT doc_id, CAST(chunk_no AS INTEGER) AS chunk, arg_max(buf, idx) AS text FROM pack GROUP BY doc_id, chunk_no)"""
_VIEW_ORDER.append("paras")
RECURSIVE_VIEWS = {"paras"}

register(
    "chunk_fixed",
    f"""SELECT CAST(doc_id AS VARCHAR) || '::chunk_' || CAST(k AS VARCHAR) AS id, doc_id AS source,
       CAST(k AS INTEGER) AS chunk, substring(t, CAST(s AS BIGINT) + 1, 900) AS text
       FROM (SELECT doc_id, t, unnest(generate_series(0, length(t) - 1, 750)) AS s,
                    generate_subscripts(generate_series(0, length(t) - 1, 750), 1) - 1 AS k
             FROM (SELECT doc_id, {_strip("COALESCE(text, '')")} AS t FROM documents) WHERE length(t) > 0)""",
)
VIEWS["fx"] = f"""
fx AS (SELECT CAST(doc_id AS VARCHAR) || '::chunk_' || CAST(k AS VARCHAR) AS id, doc_id AS source,
       CAST(k AS INTEGER) AS chunk, substring(t, CAST(s AS BIGINT) + 1, 900) AS text
       FROM (SELECT doc_id, t, unnest(generate_series(0, length(t) - 1, 750)) AS s,
                    generate_subscripts(generate_series(0, length(t) - 1, 750), 1) - 1 AS k
             FROM (SELECT doc_id, {_strip("COALESCE(text, '')")} AS t FROM documents) WHERE length(t) > 0)),
ftok AS (SELECT id AS key, unnest({_tokens('text')}) AS token FROM fx
         UNION ALL SELECT 'q' || item_id, unnest({_tokens('text')}) FROM benchmark),
ftf AS (SELECT key, CAST(('0x' || substr(md5(token), 1, 8)) AS BIGINT) % 256 AS b, COUNT(*) AS tf
        FROM ftok WHERE length(token) >= 1 GROUP BY 1, 2),
feat AS (SELECT key, b, tf / sqrt(CAST(sum(tf * tf) OVER (PARTITION BY key) AS DOUBLE)) AS w FROM ftf)"""
_VIEW_ORDER.append("fx")
_EMBED = """SELECT fx.*, v.embedding FROM fx JOIN (
         SELECT id, list(CAST(coalesce(w, 0) AS FLOAT) ORDER BY i) AS embedding
         FROM (SELECT id, unnest(range(0, 256)) AS i FROM fx) s LEFT JOIN feat ON feat.key = s.id AND feat.b = s.i GROUP BY id) v USING (id)"""
register("embed_chunks", _EMBED, "fx")
register("chunk_index", _EMBED, "fx")
_RAG = """SELECT question_id, rank, CAST(source AS VARCHAR) AS source, chunk, distance, text FROM (
         SELECT *, CAST(ROW_NUMBER() OVER (PARTITION BY question_id ORDER BY distance, id) AS INT) AS rank FROM (
           SELECT q.item_id AS question_id, fx.*, round(
             (CASE WHEN qk.key IS NULL THEN 0 ELSE 1 END) + (CASE WHEN ck.key IS NULL THEN 0 ELSE 1 END) - 2 * coalesce(d.dot, 0.0), 12) AS distance
           FROM benchmark q CROSS JOIN fx
           LEFT JOIN (SELECT a.key AS qk, c.key AS ck, sum(a.w * c.w) AS dot FROM feat a JOIN feat c ON a.b = c.b
                      WHERE a.key LIKE 'q%' AND c.key NOT LIKE 'q%' GROUP BY 1, 2) d ON d.qk = 'q' || q.item_id AND d.ck = fx.id
           LEFT JOIN (SELECT DISTINCT key FROM feat) qk ON qk.key = 'q' || q.item_id
           LEFT JOIN (SELECT DISTINCT key FROM feat) ck ON ck.key = fx.id)) WHERE rank <= 4"""
register("rag_hits", _RAG, "fx")
register("chunk_paragraphs", "SELECT doc_id AS source, chunk, text FROM pchunks", "paras")
register(
    "tokenize_docs",
    f"""SELECT doc_id, token, CAST(COUNT(*) AS BIGINT) AS tf
       FROM (SELECT doc_id, unnest({_tokens('text')}) AS token FROM documents) WHERE length(token) >= 3
       GROUP BY doc_id, token""",
)
VIEWS["kw"] = f"""
qtok AS (SELECT DISTINCT item_id, token FROM (SELECT item_id, unnest({_tokens('text')}) AS token FROM benchmark)
         WHERE length(token) >= 3),
ctok AS (SELECT doc_id, chunk, token, COUNT(*) AS tf
         FROM (SELECT doc_id, chunk, unnest({_tokens('text')}) AS token FROM pchunks) WHERE length(token) >= 3
         GROUP BY doc_id, chunk, token),
kwall AS (
  SELECT q.item_id, c.doc_id, c.chunk, COUNT(*) AS n, SUM(LEAST(c.tf, 3)) AS b,
         ROW_NUMBER() OVER (PARTITION BY q.item_id ORDER BY COUNT(*) * 20 + SUM(LEAST(c.tf, 3)) DESC, c.doc_id, c.chunk) AS rank
  FROM qtok q JOIN ctok c USING (token) GROUP BY q.item_id, c.doc_id, c.chunk)"""
_VIEW_ORDER.append("kw")
_VIEW_DEPS["kw"] = ["paras"]
register(
    "keyword_retrieve",
    """SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, chunk, ROUND(CAST(n + b * 0.05 AS DOUBLE), 6) AS score
       FROM kwall WHERE rank <= 5""",
    "kw",
)
register(
    "vector_topk",
    """WITH e AS (SELECT vec_id, label, CAST(unnest(embedding) AS DOUBLE) AS v, generate_subscripts(embedding, 1) AS i
                FROM embeddings),
       c AS (SELECT label, i, AVG(v) AS m FROM e GROUP BY label, i),
       nrm AS (SELECT label, SQRT(SUM(m * m)) AS nr FROM c GROUP BY label),
       q AS (SELECT c.label, c.i, c.m / nrm.nr AS qv FROM c JOIN nrm USING (label)),
       d AS (SELECT q.label AS query_label, e.vec_id, SUM((e.v - q.qv) * (e.v - q.qv)) AS distance
             FROM e JOIN q ON e.i = q.i GROUP BY q.label, e.vec_id),
       r AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY query_label ORDER BY distance, vec_id) AS rank FROM d)
       SELECT query_label, CAST(rank AS INTEGER) AS rank, vec_id, ROUND(distance, 6) AS distance FROM r WHERE rank <= 4""",
)
register(
    "vector_neighbors",
    """WITH q AS (SELECT vec_id AS query_id, embedding AS qv FROM embeddings WHERE vec_id % 50 = 0),
       d AS (SELECT q.query_id, e.vec_id, list_sum(list_transform(list_zip(q.qv, e.embedding),
                    lambda x: (CAST(x[1] AS DOUBLE) - CAST(x[2] AS DOUBLE)) * (CAST(x[1] AS DOUBLE) - CAST(x[2] AS DOUBLE)))) AS distance
             FROM q, embeddings e),
       r AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY query_id ORDER BY distance, vec_id) AS rank FROM d)
       SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, ROUND(distance, 6) AS distance FROM r WHERE rank <= 4""",
)
register(
    "signal_queries",
    """SELECT c.client_id, concat_ws(' ', 'contexte', 'métriques', 'rétention', 'pmE saas', 'client',
         NULLIF(c.plan, ''), NULLIF(c.ville, ''),
         CASE WHEN COALESCE(c.days_since_last_paid > ROUND(m.md, 6), false)
              THEN 'inactivité dernier paiement retard days_since_last_paid' END,
         CASE WHEN COALESCE(c.paid_count_before_T < ROUND(m.mc, 6), false) OR COALESCE(c.paid_sum_before_T < ROUND(m.ms, 6), false)
              THEN 'historique paiement faible paid_count_before_T paid_sum_before_T' END,
         CASE WHEN c.plan = 'free' THEN 'acquisition conversion free' ELSE 'rétention payant basic pro' END) AS query
       FROM churn c LEFT JOIN meds m ON m.scope = c.plan""",
    "meds",
)
register(
    "rag_context_block",
    f"""WITH h AS (
         SELECT k.item_id, k.rank, CAST(k.doc_id AS VARCHAR) AS source, k.chunk,
                {_strip(_strip("regexp_replace(p.text, '" + WS + "+', ' ', 'g')"))} AS t
         FROM kwall k JOIN pchunks p USING (doc_id, chunk) WHERE k.rank <= 4),
       ne AS (SELECT *, LEAST(900, COALESCE(SUM(length(t)) OVER (PARTITION BY item_id ORDER BY rank
                ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS used FROM h WHERE length(t) > 0)
       SELECT item_id, 'Contexte interne (extraits du corpus):' || chr(10) ||
              string_agg('- (' || rank || ') ' || source || ' | chunk=' || chunk || ': ' || substring(t, 1, CAST(900 - used AS BIGINT)),
                         chr(10) ORDER BY rank) AS context
       FROM ne WHERE 900 - used > 0 GROUP BY item_id""",
    "kw",
)

# -------------------------------------------------------------- cleaning
register(
    "clean_clients",
    """SELECT CAST(c.c_custkey AS VARCHAR) AS client_id, n.n_name AS ville,
       CASE WHEN c.c_mktsegment IN ('AUTOMOBILE','BUILDING') THEN 'pro'
            WHEN c.c_mktsegment IN ('FURNITURE','HOUSEHOLD') THEN 'basic' ELSE 'free' END AS plan,
       DATE '1994-01-01' + CAST(c.c_custkey % 365 AS INT) AS date_inscription
       FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey""",
)
register(
    "clean_clients_dedup",
    """SELECT CAST(client_id AS VARCHAR) AS client_id, ville, plan, date_inscription FROM clients""",
)
register(
    "clean_subscriptions",
    """SELECT CAST(client_id AS VARCHAR) AS client_id, CAST(montant AS DOUBLE) AS montant, date_paiement, statut
       FROM subscriptions""",
)
register(
    "clean_usage",
    """SELECT CAST(client_id AS VARCHAR) AS client_id, actions, sessions, activity_date FROM usage_""",
)
register(
    "clean_rejects",
    """SELECT 'clients' AS source, CAST(client_id AS VARCHAR) AS client_id, 'ville_missing' AS reason
       FROM clients WHERE trim(ville) = ''""",
)

# ------------------------------------------------------- model metrics
VIEWS["rpred"] = """
rpred AS (
  SELECT client_id, ca_total AS actual, ca_total + CAST((client_id * 13) % 101 AS DOUBLE) - 50 AS prediction
  FROM report WHERE plan IS NOT NULL AND ville IS NOT NULL AND last_activity_date IS NOT NULL)"""
VIEWS["cpred"] = """
cpred AS (
  SELECT client_id, churn_7_30j AS actual,
         CASE WHEN client_id % 17 = 0 THEN 0 ELSE CAST(CAST((client_id * 37) % 100 AS DOUBLE) / 100 > 0.5 AS INT) END
           AS prediction
  FROM churn),
cm AS (
  SELECT CAST(COUNT(*) FILTER (WHERE actual = 0 AND prediction = 0) AS BIGINT) AS tn,
         CAST(COUNT(*) FILTER (WHERE actual = 0 AND prediction = 1) AS BIGINT) AS fp,
         CAST(COUNT(*) FILTER (WHERE actual = 1 AND prediction = 0) AS BIGINT) AS fn,
         CAST(COUNT(*) FILTER (WHERE actual = 1 AND prediction = 1) AS BIGINT) AS tp FROM cpred)"""
_VIEW_ORDER += ["rpred", "cpred"]
_VIEW_DEPS["rpred"] = ["report"]
_VIEW_DEPS["cpred"] = ["churn"]
register(
    "regression_metrics",
    """SELECT ROUND(AVG(ABS(prediction - actual)), 6) AS MAE, ROUND(SQRT(AVG((prediction - actual) * (prediction - actual))), 6) AS RMSE,
       CAST(COUNT(*) AS BIGINT) AS n_eval FROM rpred""",
    "rpred",
)
register(
    "residuals",
    "SELECT client_id, actual, prediction, ROUND(actual - prediction, 6) AS residual FROM rpred",
    "rpred",
)
register(
    "churn_metrics",
    """SELECT tn, fp, fn, tp, ROUND(COALESCE(tp / NULLIF(CAST(tp + fp AS DOUBLE), 0), 0), 6) AS precision,
       ROUND(COALESCE(tp / NULLIF(CAST(tp + fn AS DOUBLE), 0), 0), 6) AS recall FROM cm""",
    "cpred",
)
register(
    "classification_report",
    """WITH pc AS (
         SELECT '0' AS label, COALESCE(tn / NULLIF(CAST(tn + fn AS DOUBLE), 0), 0) AS p,
                COALESCE(tn / NULLIF(CAST(tn + fp AS DOUBLE), 0), 0) AS r, tn + fp AS support FROM cm
         UNION ALL
         SELECT '1', COALESCE(tp / NULLIF(CAST(tp + fp AS DOUBLE), 0), 0),
                COALESCE(tp / NULLIF(CAST(tp + fn AS DOUBLE), 0), 0), fn + tp FROM cm),
       pf AS (SELECT label, p, r, COALESCE(2 * p * r / NULLIF(p + r, 0), 0) AS f, support FROM pc)
       SELECT label, ROUND(p, 6) AS precision, ROUND(r, 6) AS recall, ROUND(f, 6) AS f1_score,
              CAST(support AS BIGINT) AS support FROM pf
       UNION ALL SELECT 'accuracy', NULL, NULL, ROUND(COALESCE((tn + tp) / NULLIF(CAST(tn + fp + fn + tp AS DOUBLE), 0), 0), 6),
              CAST(tn + fp + fn + tp AS BIGINT) FROM cm
       UNION ALL SELECT 'macro avg', ROUND(AVG(p), 6), ROUND(AVG(r), 6), ROUND(AVG(f), 6), CAST(SUM(support) AS BIGINT) FROM pf
       UNION ALL SELECT 'weighted avg', ROUND(COALESCE(SUM(p * support) / NULLIF(SUM(support), 0), 0), 6),
              ROUND(COALESCE(SUM(r * support) / NULLIF(SUM(support), 0), 0), 6),
              ROUND(COALESCE(SUM(f * support) / NULLIF(SUM(support), 0), 0), 6), CAST(SUM(support) AS BIGINT) FROM pf""",
    "cpred",
)

# -------------------------------------------- agent, actions, journal


def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def fill(template: str, *exprs: str) -> str:
    parts = template.split("%s")
    assert len(parts) == len(exprs) + 1
    out = lit(parts[0])
    for e, p in zip(exprs, parts[1:]):
        out += f" || ({e}) || {lit(p)}"
    return out


_RISK = "COALESCE(NULLIF(churn_risk, ''), 'medium')"
_USAGE = "COALESCE(NULLIF(usage_level, ''), 'medium')"
_SUBJECT = (f"CASE WHEN {_RISK} = 'high' THEN {lit(_act.SUBJECT_HIGH)} "
            f"WHEN {_RISK} = 'low' AND {_USAGE} = 'high' THEN {lit(_act.SUBJECT_OPTIMISE)} ELSE {lit(_act.SUBJECT_DEFAULT)} END")
_EMAIL = fill(_act.EMAIL_TEMPLATE, _SUBJECT, "trim(CAST(client_id AS VARCHAR))", "trim(COALESCE(plan, ''))",
              "trim(COALESCE(ville, ''))", _USAGE, _RISK)
_BASE = "[" + ", ".join(lit(x) for x in _act.BASE_STEPS) + "]"
_L0 = f"list_concat(CASE WHEN {_RISK} = 'high' THEN [{lit(_act.URGENT_STEP)}] ELSE [] END, {_BASE})"
_CHECK = (f"CASE WHEN {_USAGE} = 'low' THEN list_concat(({_L0})[1:3], [{lit(_act.ACTIVATION_STEP)}], ({_L0})[4:]) "
          f"ELSE {_L0} END")
_UPSELL = "[" + ", ".join(lit(x) for x in _act.UPSELL_STEPS) + "]"

register(
    "agent_features",
    """SELECT r.client_id, r.plan, r.ville, r.ca_total, r.nb_paiements, r.sessions_total,
       COALESCE(v.total_amount, 0.0) AS revenue_total, COALESCE(v.events_count, 0) AS revenue_events,
       v.most_recent_date, s.p AS churn_probability, s.p > 0.5 AS churn,
       v.client_id IS NOT NULL AS has_revenue, s.client_id IS NOT NULL AS has_prediction
       FROM report r
       LEFT JOIN (SELECT client_id, CAST(SUM(amount) AS DOUBLE) AS total_amount, CAST(COUNT(*) AS BIGINT) AS events_count,
                         MAX(event_date) AS most_recent_date FROM revenue_events GROUP BY client_id) v USING (client_id)
       LEFT JOIN (SELECT * FROM sc WHERE p IS NOT NULL) s USING (client_id)""",
    "feats",
)
register("prepare_email", f"SELECT client_id, {_EMAIL} AS email FROM decided", "feats")
register("prepare_checklist", f"SELECT client_id, array_to_string({_CHECK}, chr(10)) AS checklist FROM decided", "feats")
register(
    "prepared_actions",
    f"""SELECT client_id, action,
       CASE WHEN action = 'send_retention_email' THEN 'email'
            WHEN action IN ('schedule_call', 'proposer_upsell') THEN 'call_plan' ELSE 'none' END AS type,
       CASE WHEN action = 'send_retention_email' THEN {_EMAIL}
            WHEN action = 'schedule_call' THEN array_to_string({_CHECK}, chr(10))
            WHEN action = 'proposer_upsell' THEN array_to_string(list_concat({_UPSELL}, {_CHECK}), chr(10))
            ELSE {lit(_act.NO_ACTION_MESSAGE)} END AS payload
       FROM decided""",
    "feats",
)


def _answer_sql(t: dict) -> str:
    body = "\n".join(["## 1) Résumé", t["summary"], "", "## 2) Pourquoi", *[f"- {b}" for b in t["why"][:3]], "",
                      "## 3) Action recommandée", t["action"], "", "## 4) Action préparée", t["prepared"], "",
                      "## 5) Confiance", "moyen"])
    return lit(body)


register(
    "answer_batch",
    f"""SELECT b.item_id,
       CASE WHEN COALESCE(contains(p.text, {lit(_act.ONE_SHOT_MARKER)}), false) THEN {_answer_sql(_act.ONE_SHOT)}
            ELSE {_answer_sql(_act.GENERIC)} END
       || CASE WHEN k.doc_id IS NOT NULL THEN chr(10) || chr(10) || '_Source: ' || CAST(k.doc_id AS VARCHAR) || '_' ELSE '' END
         AS answer_md
       FROM benchmark b LEFT JOIN (SELECT * FROM kwall WHERE rank = 1) k ON k.item_id = b.item_id
       LEFT JOIN pchunks p ON p.doc_id = k.doc_id AND p.chunk = k.chunk""",
    "kw",
)
register(
    "client_lookup",
    """SELECT c.c_custkey AS client_id, r.client_id IS NOT NULL AS found, NULLIF(trim(r.plan), '') AS plan,
       NULLIF(trim(r.ville), '') AS ville, COALESCE(r.ca_total, 0.0) AS ca_total, COALESCE(r.nb_paiements, 0) AS nb_paiements,
       COALESCE(r.actions_total, 0) AS actions_total, COALESCE(r.sessions_total, 0) AS sessions_total,
       r.last_activity_date, r.last_payment_date
       FROM customer c LEFT JOIN report r ON r.client_id = c.c_custkey""",
    "report",
)
register(
    "score_requests_valid",
    """SELECT client_id, reason IS NULL AS valid, reason FROM (
         SELECT client_id, CASE WHEN nb_paiements < 0 THEN 'paid_count_before_T' WHEN ca_total < 0 THEN 'paid_sum_before_T'
           WHEN plan IS NULL OR plan NOT IN ('free', 'basic', 'pro') THEN 'plan'
           WHEN COALESCE(length(ville), 0) < 1 THEN 'ville' END AS reason FROM report)""",
    "report",
)
VIEWS["feed"] = f"""
feed AS (
  SELECT strftime(TIMESTAMP '2024-01-01 00:00:00' + to_seconds(conv_id * 3600 + turn * 60), '%Y-%m-%dT%H:%M:%SZ') AS timestamp_iso,
    CASE role WHEN 'user' THEN 'client' WHEN 'assistant' THEN 'plan' ELSE role END AS scope_type,
    CASE WHEN role = 'assistant' THEN (['free', 'basic', 'pro'])[CAST(conv_id % 3 + 1 AS INT)] ELSE CAST(conv_id AS VARCHAR) END
      AS scope_value,
    (['Surveiller', 'À analyser (E5)', 'Rien à faire', 'Hors périmètre'])[CAST(turn % 4 + 1 AS INT)] AS decision_type,
    {_strip("COALESCE(text, '')")} AS rationale_short, role AS author
  FROM conversations),
vfeed AS (
  SELECT *, CASE WHEN decision_type NOT IN ('Surveiller', 'À analyser (E5)', 'Rien à faire', 'Hors périmètre')
                 THEN 'decision_type_invalid'
            WHEN scope_type NOT IN ('client', 'plan') THEN 'scope_type_invalid'
            WHEN length(rationale_short) = 0 THEN 'rationale_missing'
            WHEN length(rationale_short) > 200 THEN 'rationale_too_long' END AS reason FROM feed)"""
_VIEW_ORDER.append("feed")
register("journal_validate", "SELECT * FROM vfeed", "feed")
register(
    "journal_view",
    """SELECT timestamp_iso, scope_type, scope_value, decision_type, rationale_short, author FROM vfeed
       WHERE reason IS NULL AND scope_type = 'client'""",
    "feed",
)
for _name in ("journal_append", "stream_journal"):  # the feed has no repeated decision
    register(_name, """SELECT timestamp_iso, scope_type, scope_value, decision_type, rationale_short, author FROM vfeed
       WHERE reason IS NULL""", "feed")
register(
    "signal_retrieve",
    f"""WITH sq AS (
         SELECT c.client_id, concat_ws(' ', 'contexte', 'métriques', 'rétention', 'pmE saas', 'client',
           NULLIF(c.plan, ''), NULLIF(c.ville, ''),
           CASE WHEN COALESCE(c.days_since_last_paid > ROUND(m.md, 6), false)
                THEN 'inactivité dernier paiement retard days_since_last_paid' END,
           CASE WHEN COALESCE(c.paid_count_before_T < ROUND(m.mc, 6), false) OR COALESCE(c.paid_sum_before_T < ROUND(m.ms, 6), false)
                THEN 'historique paiement faible paid_count_before_T paid_sum_before_T' END,
           CASE WHEN c.plan = 'free' THEN 'acquisition conversion free' ELSE 'rétention payant basic pro' END) AS query
         FROM churn c LEFT JOIN meds m ON m.scope = c.plan),
       qt AS (SELECT DISTINCT query, token FROM (SELECT query, unnest({_tokens('query')}) AS token FROM (SELECT DISTINCT query FROM sq))
              WHERE length(token) >= 3),
       ct AS (SELECT doc_id, chunk, token, COUNT(*) AS tf
              FROM (SELECT doc_id, chunk, unnest({_tokens('text')}) AS token FROM pchunks) WHERE length(token) >= 3
              GROUP BY doc_id, chunk, token),
       sc AS (SELECT q.query, c.doc_id, c.chunk, COUNT(*) AS n, SUM(LEAST(c.tf, 3)) AS b,
                     ROW_NUMBER() OVER (PARTITION BY q.query ORDER BY COUNT(*) * 20 + SUM(LEAST(c.tf, 3)) DESC, c.doc_id, c.chunk) AS rank
              FROM qt q JOIN ct c USING (token) GROUP BY q.query, c.doc_id, c.chunk)
       SELECT sq.client_id, CAST(sc.rank AS INTEGER) AS rank, sc.doc_id, sc.chunk, ROUND(CAST(sc.n + sc.b * 0.05 AS DOUBLE), 6) AS score
       FROM sq JOIN sc USING (query) WHERE sc.rank <= 5""",
    "meds", "paras",
)
register("plan_choices", "SELECT DISTINCT plan FROM churn WHERE plan IS NOT NULL", "churn")
register(
    "revenue_source",
    """SELECT CAST(client_id AS VARCHAR) AS client_id, event_type, CAST(amount AS DOUBLE) AS amount, event_date
       FROM revenue_events""",
)


def _f0(x: str) -> str:
    return f"printf('%.0f', round_even(CAST({x} AS DOUBLE), 0))"


def _f2(x: str) -> str:
    return f"printf('%.2f', round_even(CAST({x} AS DOUBLE), 2))"


register(
    "guided_reading",
    f"""WITH m AS (SELECT scope, ROUND(md, 6) AS md, ROUND(mc, 6) AS mc, ROUND(ms, 6) AS ms FROM meds),
       g AS (SELECT md AS gd, mc AS gc, ms AS gs FROM m WHERE scope = '(global)')
       SELECT 'client' AS scope_type, CAST(c.client_id AS VARCHAR) AS scope_value,
         concat_ws(chr(10),
           '- Périmètre : **client_id=' || CAST(c.client_id AS VARCHAR) || '** (plan=' || c.plan || ', ville=' || c.ville || ').',
           CASE WHEN c.days_since_last_paid IS NOT NULL AND p.md IS NOT NULL THEN
             '- `days_since_last_paid` = **' || CAST(c.days_since_last_paid AS VARCHAR) || '** vs médiane plan **' || {_f0('p.md')}
             || '** (médiane globale **' || {_f0('g.gd')} || '**).' END,
           CASE WHEN c.paid_count_before_T IS NOT NULL AND p.mc IS NOT NULL THEN
             '- `paid_count_before_T` = **' || {_f0('c.paid_count_before_T')} || '** vs médiane plan **' || {_f0('p.mc')}
             || '** (médiane globale **' || {_f0('g.gc')} || '**).' END,
           CASE WHEN c.paid_sum_before_T IS NOT NULL AND p.ms IS NOT NULL THEN
             '- `paid_sum_before_T` = **' || {_f2('c.paid_sum_before_T')} || '** vs médiane plan **' || {_f2('p.ms')}
             || '** (médiane globale **' || {_f2('g.gs')} || '**).' END,
           '- Ces comparaisons sont **descriptives** (pas de score, pas de décision automatique).') AS text
       FROM churn c LEFT JOIN m p ON p.scope = c.plan CROSS JOIN g
       UNION ALL
       SELECT 'plan', p.scope,
         concat_ws(chr(10),
           '- Périmètre : **plan=' || p.scope || '**.',
           '- Médiane `days_since_last_paid` (plan) = **' || {_f0('p.md')} || '** vs globale **' || {_f0('g.gd')} || '**.',
           '- Médiane `paid_count_before_T` (plan) = **' || {_f0('p.mc')} || '** vs globale **' || {_f0('g.gc')} || '**.',
           '- Médiane `paid_sum_before_T` (plan) = **' || {_f2('p.ms')} || '** vs globale **' || {_f2('g.gs')} || '**.',
           '- Cette lecture est **synthétique** et **descriptive** (pas de décision automatique).')
       FROM m p CROSS JOIN g WHERE p.scope <> '(global)'""",
    "meds",
)


# ------------------------------------------------- exports and variants
for _export, _host in {"export_kpi": "kpi_by_client", "export_ml_ready_v1": "ml_ready_v1", "export_ml_ready": "ml_ready",
                       "export_churn_ready": "churn_ready", "clean_subscriptions_lenient": "clean_subscriptions"}.items():
    SQL[_export] = SQL[_host]
register(
    "export_report",
    """SELECT * REPLACE (strftime(last_payment_date, '%Y-%m-%d') AS last_payment_date,
       strftime(last_activity_date, '%Y-%m-%d') AS last_activity_date) FROM report""",
    "report",
)
register(
    "clean_usage_lenient",
    """SELECT CAST(client_id AS VARCHAR) AS client_id, CAST(actions AS DOUBLE) AS actions,
       CAST(sessions AS DOUBLE) AS sessions, activity_date FROM usage_""",
)
register(
    "segment_queries",
    """WITH g AS (
         SELECT c.plan, COALESCE(c.days_since_last_paid > ROUND(m.md, 6), false) AS inactivity_high,
           COALESCE(c.paid_count_before_T < ROUND(m.mc, 6), false) OR COALESCE(c.paid_sum_before_T < ROUND(m.ms, 6), false) AS history_low
         FROM churn c LEFT JOIN meds m ON m.scope = c.plan)
       SELECT plan, inactivity_high, history_low, CAST(COUNT(*) AS BIGINT) AS n_clients,
         concat_ws(' ', 'contexte', 'métriques', 'rétention', 'pmE saas', 'segment', 'plan', NULLIF(plan, ''),
           CASE WHEN inactivity_high THEN 'inactivité dernier paiement retard days_since_last_paid' END,
           CASE WHEN history_low THEN 'historique paiement faible paid_count_before_T paid_sum_before_T' END,
           CASE WHEN plan = 'free' THEN 'acquisition conversion free' ELSE 'rétention payant basic pro' END) AS query
       FROM g GROUP BY plan, inactivity_high, history_low""",
    "meds",
)


def _confident(t: dict) -> str:
    return f"replace({_answer_sql(t)}, chr(10) || 'moyen', chr(10) || CASE WHEN sc.p IS NULL THEN 'moyen' ELSE 'fort' END)"


register(
    "answer_clients",
    f"""WITH best AS ({_RAG})
       SELECT sc.client_id, sc.client_id % (SELECT COUNT(*) FROM benchmark) AS question_id,
         CASE WHEN COALESCE(contains(b.text, {lit(_act.ONE_SHOT_MARKER)}), false) THEN {_confident(_act.ONE_SHOT)}
              ELSE {_confident(_act.GENERIC)} END
         || CASE WHEN b.source IS NOT NULL THEN chr(10) || chr(10) || '_Source: ' || b.source || '_' ELSE '' END AS answer_md
       FROM sc LEFT JOIN (SELECT * FROM best WHERE rank = 1) b ON b.question_id = sc.client_id % (SELECT COUNT(*) FROM benchmark)""",
    "feats", "fx",
)


# ------------------------------------------------------ dirty feeds, sketches
_DIRTY = """WITH c AS (SELECT *, client_id % 50 AS k, concat_ws(',', client_id, ville, plan) AS short, concat_ws(',', client_id, ville, plan, strftime(date_inscription, '%Y-%m-%d')) AS line FROM clients),
  s AS (SELECT *, payment_id % 60 AS k, concat_ws(',', client_id, CAST(montant AS VARCHAR), strftime(date_paiement, '%Y-%m-%d')) AS short FROM subscriptions),
  u AS (SELECT *, event_id % 70 AS k, concat_ws(',', client_id, actions, sessions) AS short FROM usage_),
  r AS (
    SELECT 'clients' AS source, CASE WHEN k IN (3, 4, 7) THEN NULL ELSE CAST(client_id AS VARCHAR) END AS client_id,
      CASE k WHEN 1 THEN 'ville_missing' WHEN 2 THEN 'plan_invalid' WHEN 3 THEN 'corrupt_record' WHEN 4 THEN 'corrupt_record' WHEN 5 THEN 'date_invalid' ELSE 'client_id_missing' END AS reason,
      CASE k WHEN 3 THEN short WHEN 4 THEN line || ',x' END AS raw FROM c WHERE k IN (1, 2, 3, 4, 5, 7)
    UNION ALL SELECT 'subscriptions', CASE WHEN k <> 3 THEN CAST(client_id AS VARCHAR) END,
      CASE k WHEN 1 THEN 'montant_invalid' WHEN 2 THEN 'statut_invalid' WHEN 3 THEN 'corrupt_record' ELSE 'date_invalid' END, CASE WHEN k = 3 THEN short END FROM s WHERE k IN (1, 2, 3, 4)
    UNION ALL SELECT 'usage', CASE WHEN k <> 3 THEN CAST(client_id AS VARCHAR) END,
      CASE k WHEN 1 THEN 'actions_invalid' WHEN 2 THEN 'sessions_invalid' ELSE 'corrupt_record' END, CASE WHEN k = 3 THEN short END FROM u WHERE k IN (1, 2, 3))"""
register("feed_rejects", _DIRTY + " SELECT * FROM r")
register(
    "feed_reconciliation",
    _DIRTY + """, n AS (SELECT 'clients' AS source, count(*) AS n FROM c UNION ALL SELECT 'subscriptions', count(*) FROM s UNION ALL SELECT 'usage', count(*) FROM u)
    SELECT n.source, n.n AS n_records, n.n - count(r.source) AS n_valid, count(r.source) AS n_rejected, true AS ok FROM n LEFT JOIN r ON r.source = n.source GROUP BY n.source, n.n""",
)
register(
    "feed_clients",
    """SELECT CAST(client_id AS VARCHAR) AS client_id, ville, plan, date_inscription FROM clients WHERE client_id % 50 NOT IN (1, 2, 3, 4, 5, 7)""",
)
register(
    "payment_range_facts",
    """SELECT c.plan, CAST(count(*) AS BIGINT) AS n, true AS clients_ok, true AS quantile_ok FROM subscriptions s JOIN clients c USING (client_id)
       WHERE s.statut = 'paid' AND s.date_paiement BETWEEN DATE '1995-03-01' AND DATE '1997-08-31' GROUP BY c.plan""",
)
