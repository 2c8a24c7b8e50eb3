"""The domain-table bindings of ``churnlens.sources.bindings`` written as SQL
common table expressions, for the DuckDB cross-check of every registered
query.  The driver tables are views named ``customer``, ``orders``, ...; the
CTE names below (``customers``, ``subscriptions``, ...) do not clash with them.
"""

from __future__ import annotations

CTES: dict[str, str] = {
    "plans": """
SELECT k.plan_id, coalesce(t.plan_name, k.plan_id) AS plan_name, coalesce(t.plan_tier, 'free') AS plan_tier,
       coalesce(t.monthly_price_usd, CAST(0.00 AS DECIMAL(18,2))) AS monthly_price_usd, t.max_users, t.max_projects
FROM (SELECT DISTINCT o_orderpriority AS plan_id FROM orders WHERE o_orderpriority IS NOT NULL) k LEFT JOIN (VALUES
  ('1-URGENT', 'Enterprise Custom', 'enterprise', CAST(499.00 AS DECIMAL(18,2)), CAST(NULL AS INTEGER), 100),
  ('2-HIGH', 'Professional', 'professional', CAST(199.00 AS DECIMAL(18,2)), 50, 50),
  ('3-MEDIUM', 'Starter Plus', 'starter', CAST(79.00 AS DECIMAL(18,2)), 20, 20),
  ('4-NOT SPECIFIED', 'Starter', 'starter', CAST(49.00 AS DECIMAL(18,2)), 10, 10),
  ('5-LOW', 'Free', 'free', CAST(0.00 AS DECIMAL(18,2)), 3, 1)
) AS t(plan_id, plan_name, plan_tier, monthly_price_usd, max_users, max_projects) ON t.plan_id = k.plan_id""",
    "subscriptions": """
SELECT o_orderkey AS subscription_id,
       o_custkey AS customer_id,
       o_orderpriority AS plan_id,
       CASE o_orderstatus WHEN 'O' THEN 'active' WHEN 'F' THEN 'cancelled' WHEN 'P' THEN 'paused' END AS status,
       o_orderdate AS start_date,
       CASE WHEN o_orderstatus = 'F' THEN o_orderdate + INTERVAL 180 DAY END AS end_date,
       CASE WHEN o_orderkey % 4 = 0 THEN o_orderdate + INTERVAL 14 DAY END AS trial_end_date,
       CAST(o_totalprice AS DECIMAL(18,2)) AS mrr_usd,
       CASE WHEN o_orderkey % 3 = 0 THEN 'annual' ELSE 'monthly' END AS billing_cycle,
       CASE WHEN o_orderstatus = 'F' AND o_orderkey % 2 = 0 THEN 'price' END AS cancellation_reason
FROM orders""",
    "billing_invoices": """
SELECT l_orderkey * 10 + l_linenumber AS invoice_id,
       l_orderkey AS subscription_id,
       CAST(CAST(l_extendedprice AS DECIMAL(18,2)) * (1 - CAST(l_discount AS DECIMAL(18,2))) AS DECIMAL(18,2)) AS amount_usd,
       CAST(l_extendedprice AS DECIMAL(18,2)) AS total_usd,
       CASE WHEN l_linestatus = 'F' THEN 'paid' WHEN l_linestatus = 'O' THEN 'open' END AS status,
       CASE WHEN l_linestatus = 'F' THEN l_shipdate END AS paid_at
FROM lineitem""",
    "support_tickets": """
SELECT l.l_orderkey * 10 + l.l_linenumber AS ticket_id,
       o.o_custkey AS customer_id,
       l.l_shipdate AS created_at,
       CASE WHEN l.l_linestatus = 'F' THEN 'closed' ELSE 'open' END AS status
FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey
WHERE l.l_returnflag = 'R'""",
    "customers": """
SELECT c.c_custkey AS customer_id,
       c.c_name AS company_name,
       CASE WHEN c.c_custkey % 17 = 0 THEN NULL
            ELSE 'contact' || CAST(c.c_custkey AS VARCHAR) || '@d' || CAST(c.c_custkey % 50 AS VARCHAR) || '.com' END AS contact_email,
       CASE WHEN c.c_custkey % 19 = 0 THEN NULL
            WHEN c.c_custkey % 41 = 0 THEN ' "Contact",' || chr(10) || CAST(c.c_custkey AS VARCHAR) || ' '
            WHEN c.c_custkey % 43 = 0 THEN '' ELSE 'Contact ' || CAST(c.c_custkey AS VARCHAR) END AS contact_name,
       CASE WHEN c.c_custkey % 11 = 0 THEN NULL ELSE c.c_mktsegment END AS industry,
       CASE WHEN c.c_custkey % 29 = 0 THEN NULL
            WHEN c.c_custkey % 4 = 0 THEN '1-10' WHEN c.c_custkey % 4 = 1 THEN '11-50'
            WHEN c.c_custkey % 4 = 2 THEN '51-200' ELSE '201+' END AS company_size,
       upper(substr(n.n_name, 1, 2)) AS country_code,
       n.n_name AS country_name,
       CASE WHEN c.c_custkey % 23 = 0 THEN NULL ELSE 'UTC' END AS timezone,
       CASE WHEN c.c_custkey % 7 = 0 THEN NULL ELSE CAST(c.c_custkey % 11 AS DOUBLE) END AS nps_score,
       CASE WHEN c.c_acctbal < 0 THEN 'price' END AS churn_reason,
       CASE WHEN c.c_custkey % 13 = 0 THEN 'bad' ELSE '1995-01-01' END AS signup_date,
       CASE WHEN c.c_custkey % 31 = 0 THEN '' ELSE '1995-01-01 00:00:00' END AS created_at,
       CASE WHEN c.c_custkey % 37 = 0 THEN NULL ELSE '2001-08-01 00:00:00' END AS updated_at,
       CASE WHEN c.c_acctbal < 0 THEN '2000-06-30' END AS churned_at,
       NOT (c.c_acctbal < 0) AS is_active
FROM customer c LEFT JOIN nation n ON c.c_nationkey = n.n_nationkey""",
    "accounts": """
SELECT c_custkey AS customer_id,
       CASE WHEN c_custkey % 2 = 0 THEN 'Acme N ' ELSE 'ACMEN' END || CAST(c_custkey // 4 AS VARCHAR) AS company_name,
       'ops@d' || CAST(c_custkey // 3 AS VARCHAR) || '.com' AS contact_email
FROM customer""",
    "team_members": """
SELECT l_suppkey * 10000000 + l_partkey AS member_id,
       l_suppkey AS customer_id,
       'u' || CAST(l_partkey AS VARCHAR) || '.' || CAST(l_suppkey // 2 AS VARCHAR) || '@x.com' AS email,
       CASE WHEN l_partkey % 5 = 0 THEN 'admin' ELSE 'member' END AS role,
       CASE WHEN l_partkey % 3 = 0 THEN NULL ELSE TIMESTAMP '1995-01-01 00:00:00' END AS joined_at,
       CASE WHEN l_partkey % 4 = 0 THEN NULL ELSE min(l_shipdate) END AS last_login_at
FROM lineitem
GROUP BY l_suppkey, l_partkey""",
    "feature_flags": """
SELECT p_partkey AS flag_id,
       ['1-URGENT', '2-HIGH', '3-MEDIUM', '4-NOT SPECIFIED', '5-LOW'][CAST(p_partkey % 5 AS INTEGER) + 1] AS plan_id,
       p_type AS feature_key,
       p_size % 2 = 0 AS is_enabled,
       CASE WHEN p_size % 2 = 0 THEN TIMESTAMP '2000-01-01 00:00:00' END AS enabled_at
FROM part""",
    "_events_seg": """
SELECT e.event_id, e.ts, e.user_id, e.event_type, e.value, c.c_mktsegment,
       CASE WHEN c.c_mktsegment = 'AUTOMOBILE' THEN 'enterprise'
            WHEN c.c_mktsegment = 'BUILDING' THEN 'professional'
            WHEN c.c_mktsegment = 'FURNITURE' THEN 'starter'
            WHEN c.c_mktsegment IS NOT NULL THEN 'free' END AS tier
FROM events e LEFT JOIN customer c ON e.user_id = c.c_custkey""",
    "user_activity_logs": """
SELECT user_id AS customer_id,
       user_id * 10 + event_id % 7 AS member_id,
       event_type,
       value AS session_duration_sec,
       ts AS "timestamp",
       tier AS subscription_tier
FROM _events_seg""",
    "raw_activity": """
SELECT 'a' || CAST(event_id AS VARCHAR) AS _id,
       CASE WHEN event_id % 2 = 0 THEN user_id END AS customer_id,
       CASE WHEN event_id % 2 = 1 THEN user_id END AS "customerId",
       CASE WHEN event_id % 2 = 0 THEN user_id * 10 + event_id % 7 END AS member_id,
       CASE WHEN event_id % 2 = 1 THEN user_id * 10 + event_id % 7 END AS "userId",
       event_type,
       value AS session_duration_sec,
       CAST(ts AS VARCHAR) AS "timestamp",
       tier AS subscription_tier
FROM _events_seg""",
    "raw_surveys": """
SELECT 's' || CAST(event_id AS VARCHAR) AS _id,
       CASE WHEN event_id % 2 = 0 THEN user_id END AS customer_id,
       CASE WHEN event_id % 2 = 1 THEN user_id END AS "customerId",
       CASE WHEN event_id % 2 = 0 THEN user_id * 10 + event_id % 7 END AS member_id,
       CASE WHEN event_id % 2 = 1 THEN user_id * 10 + event_id % 7 END AS "memberId",
       CAST(event_id % 11 AS DOUBLE) AS nps_score,
       event_type AS feedback,
       strftime(ts, '%Y-%m-%d') AS survey_date
FROM events""",
    "raw_onboarding": """
SELECT 'o' || CAST(event_id AS VARCHAR) AS _id,
       CASE WHEN event_id % 2 = 0 THEN user_id END AS customer_id,
       CASE WHEN event_id % 2 = 1 THEN user_id END AS "customerId",
       CASE WHEN event_id % 2 = 0 THEN user_id * 10 + event_id % 7 END AS member_id,
       CASE WHEN event_id % 2 = 1 THEN user_id * 10 + event_id % 7 END AS "memberId",
       event_type AS step,
       CAST(ts AS VARCHAR) AS "timestamp",
       event_id % 5 <> 0 AS completed
FROM events""",
}

DEPENDS = {
    "user_activity_logs": ["_events_seg"],
    "raw_activity": ["_events_seg"],
}


def with_bindings(body: str, *tables: str, extra: list[tuple[str, str]] | None = None) -> str:
    """Prefix ``body`` with the CTEs of the named domain tables (plus any
    query-specific ``extra`` CTEs, appended after them in order)."""
    order: list[str] = []

    def add(name):
        for dep in DEPENDS.get(name, []):
            add(dep)
        if name not in order:
            order.append(name)

    for t in tables:
        add(t)
    parts = [f"{n} AS ({CTES[n]}\n)" for n in order]
    parts += [f"{n} AS ({sql}\n)" for n, sql in (extra or [])]
    if not parts:
        return body
    return "WITH " + ",\n".join(parts) + "\n" + body
