"""Queries of detectors that follow values through time, groups and spellings, over the test tables with changes planted.

Those without SQL are compared with brute force in the tests of their operators.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import changes, ledger, names, oddities, timeline
from tidemark.plans.catalogue import query

AT = "1998-03-01"  # the day from which orders are written another way


def changed_orders(t):
    """Orders of which priorities have new names, totals the other sign and clerks a new prefix from a day on."""
    late = F.col("o_orderdate") >= F.lit(AT).cast("timestamp_ntz")
    priority = F.when(late, F.initcap(F.substring("o_orderpriority", 3, 20))).otherwise(F.col("o_orderpriority"))
    return t("orders").select(F.col("o_orderdate").alias("day"), priority.alias("priority"), (F.col("o_totalprice") * F.when(late, -1).otherwise(1)).alias("total"), "o_orderstatus",
                              F.concat(F.when(late, "X").otherwise("C"), F.lit("-"), 100000 + F.col("o_custkey")).alias("account"))


_CHANGED = f"""o AS (SELECT CAST(o_orderdate AS DATE) AS day, o_orderdate >= TIMESTAMP '{AT}' AS late, o_orderpriority, o_totalprice, o_custkey, o_orderstatus FROM orders WHERE o_orderdate IS NOT NULL),
c AS (SELECT day - DATE '1970-01-01' AS day, CASE WHEN late THEN array_to_string(list_transform(string_split(o_orderpriority[3:], ' '), lambda w: upper(w[1]) || lower(w[2:])), ' ') ELSE o_orderpriority END AS priority,
o_totalprice * (CASE WHEN late THEN -1 ELSE 1 END) AS total, o_orderstatus AS status, (CASE WHEN late THEN 'X' ELSE 'C' END) || '-' || (100000 + o_custkey) AS account FROM o)"""

_TAKE_OVERS = f"""WITH {_CHANGED},
v AS (SELECT 'priority' AS "column", 'label' AS view, lower(priority) AS value, day FROM c UNION ALL SELECT 'priority', 'form', CASE WHEN regexp_matches(priority, '[a-z]') THEN 'word' ELSE 'caps' END, day FROM c
UNION ALL SELECT 'account', 'form', 'id:' || account[1] || '-#', day FROM c UNION ALL SELECT 'o_orderstatus', 'label', lower(status), day FROM c UNION ALL SELECT 'o_orderstatus', 'form', 'caps', day FROM c
UNION ALL SELECT 'total', 'sign', CASE WHEN total > 0 THEN 'positive' ELSE 'negative' END, day FROM c WHERE total <> 0),
e AS (SELECT count(*) AS n, max(day) - min(day) AS span FROM c), r AS (SELECT *, row_number() OVER (PARTITION BY "column", view, value ORDER BY day) - 1 AS i, count(*) OVER (PARTITION BY "column", view, value) AS k FROM v),
s AS (SELECT "column", view, value, any_value(k) AS k, min(day) AS f, max(day) AS l, min(day) FILTER (i >= floor(0.03 * k)) AS s, max(day) FILTER (i <= k - 1 - floor(0.03 * k)) AS z FROM r GROUP BY 1, 2, 3),
t AS (SELECT s.* FROM s, e WHERE k >= greatest(20, 0.02 * n) AND z - s >= 0.10 * span),
p AS (SELECT a."column", a.view, a.value AS old, b.value AS new FROM t a JOIN t b ON a."column" = b."column" AND a.view = b.view AND a.value <> b.value, e
 WHERE b.s > a.s AND b.z > a.z AND greatest(0, a.z - b.s) <= 0.15 * span AND b.f - a.l <= 14),
d AS (SELECT DISTINCT "column", view, value AS new, day FROM v),
w AS (SELECT p.*, d.day, (SELECT count(*) FROM v WHERE v."column" = p."column" AND v.view = p.view AND v.value = p.old AND v.day >= d.day) + (SELECT count(*) FROM v WHERE v."column" = p."column" AND v.view = p.view AND v.value = p.new AND v.day < d.day) AS cost
 FROM p JOIN d USING ("column", view, new)),
b AS (SELECT "column", view, old, new, arg_min(day, cost * 1000000 + day) AS day FROM w GROUP BY 1, 2, 3, 4)"""


@query(f"""{_TAKE_OVERS} SELECT "column", view, old, new, strftime(DATE '1970-01-01' + day::INT, '%Y-%m-%d') AS day FROM b""")
def take_overs_orders(t):
    return changes.take_overs(changed_orders(t), "day", ["priority", "total", "account", "o_orderstatus"], ["total"])


@query(f"""{_TAKE_OVERS}, g AS (SELECT count(DISTINCT "column") AS k, bool_or(view = 'sign') AS signs, min(day) AS lo, max(day) AS hi FROM b)
SELECT strftime(DATE '1970-01-01' + lo::INT, '%Y-%m-%d') AS boundary, "column", view AS kind, old AS before, new AS after, strftime(DATE '1970-01-01' + lo::INT, '%Y-%m-%d') AS day,
(SELECT count(*) FROM c WHERE c.day < lo) AS n_before, (SELECT count(*) FROM c WHERE c.day >= lo) AS n_after FROM b, g WHERE (signs OR k >= 2) AND hi - lo <= 14""")
def boundaries_orders(t):
    """All switches of this table lie within two weeks, so they are one date; the SQL gives no row otherwise."""
    return changes.boundaries(changed_orders(t), "day", ["priority", "total", "account", "o_orderstatus"], ["total"])


@query()
def handoffs_orders(t):
    """New names of priorities; each is followed by the customers' regions that only it has."""
    o = changed_orders(t).withColumn("desk", F.concat(F.lower(F.substring(F.regexp_replace("priority", "^[0-9]-", ""), 1, 3)), F.pmod(F.xxhash64("account"), F.lit(7)).cast("string")))
    return changes.handoffs(o, "priority", "day", AT, ["o_orderstatus", "desk"])


@query()
def alias_pairs_part(t):
    """Names of parts, some of them with a slip: a letter doubled, left out, replaced or moved, an ending added."""
    name, k = F.col("p_name"), F.col("p_partkey") % 23
    slip = (F.when(k == 1, F.concat(F.substring(name, 1, 2), F.substring(name, 2, 60))).when(k == 2, F.concat(F.substring(name, 1, 3), F.substring(name, 5, 60))).when(k == 3, F.concat(F.substring(name, 1, 2), F.lit("q"), F.substring(name, 4, 60)))
            .when(k == 4, F.concat(F.substring(name, 2, 60), F.substring(name, 1, 1))).when(k == 5, F.concat(name, F.lit(" set"))).when(k == 6, F.upper(name)).otherwise(name))
    return names.alias_pairs(t("part").withColumn("name", slip), "name")


def odd_lines(t):
    """Lines of six shippers; one of them begins late, has clerks of its own and most of the money."""
    k = F.col("l_suppkey") % 6
    odd = k == 5
    late = F.when(odd, F.expr("make_dt_interval(3650)")).otherwise(F.expr("make_dt_interval(0)"))
    return t("lineitem").select(F.concat(F.lit("shipper "), k).alias("shipper"), (F.col("l_shipdate") + late).alias("day"), F.concat(F.when(odd, "own ").otherwise("clerk "), F.col("l_partkey") % 5).alias("clerk"),
                                F.when(odd, "O").otherwise(F.col("l_linestatus")).alias("status"), (F.col("l_extendedprice") * F.when(odd, 20).otherwise(1)).alias("amount"), "l_returnflag")


_ODD = """WITH l AS (SELECT 'shipper ' || (l_suppkey % 6) AS g, l_returnflag, CAST(l_shipdate + CASE WHEN l_suppkey % 6 = 5 THEN INTERVAL 3650 DAY ELSE INTERVAL 0 DAY END AS DATE) AS day,
l_extendedprice * (CASE WHEN l_suppkey % 6 = 5 THEN 20 ELSE 1 END) AS amount FROM lineitem),
u AS (SELECT 'shipper' AS grouping, g AS value, day, amount FROM l UNION ALL SELECT 'l_returnflag', lower(l_returnflag), day, amount FROM l),
a AS (SELECT count(*) AS n, sum(abs(amount)) AS m, min(day) AS lo, max(day) AS hi FROM l),
k AS (SELECT grouping, value, count(*) AS n, sum(abs(amount)) AS m, min(day) AS f FROM u GROUP BY 1, 2 HAVING count(*) >= 20),
x AS (SELECT k.*, k.m / a.m AS share, (k.m / a.m) / (k.n / a.n) AS ratio FROM k, a),
p AS (SELECT x.*, list_sort(list(y.ratio)) AS o FROM x JOIN x y ON x.grouping = y.grouping AND x.value <> y.value GROUP BY ALL HAVING count(*) >= 2),
w AS (SELECT *, CASE WHEN o[1] > 0 AND o[-1] <= 2.5 * o[1] THEN CASE WHEN ratio / o[len(o) // 2 + 1] >= 5 AND share >= 0.2 THEN 4 WHEN ratio / o[len(o) // 2 + 1] >= 3 AND share >= 0.1 THEN 2 END WHEN o[-1] > 0 AND ratio >= 5 * o[-1] AND share >= 0.2 THEN 4 END AS w FROM p)"""


@query(f"""{_ODD} SELECT grouping, value, 'share' AS kind, w AS weight, 'amount' AS about FROM w WHERE w IS NOT NULL
UNION ALL SELECT grouping, value, 'late', 3, 'day' FROM k, a WHERE hi - lo >= 28 AND f - lo >= floor(0.9 * (hi - lo))""")
def share_and_late_evidence(t):
    """Two kinds of evidence alone, for which the rule is short enough for SQL."""
    ev = oddities.group_evidence(odd_lines(t), ["shipper", "l_returnflag"], "day", "amount")
    return ev.filter(F.col("kind").isin("share", "late"))


@query()
def odd_groups_lines(t):
    lines, groups = odd_lines(t), ["shipper", "l_returnflag"]
    return oddities.odd_groups(lines, groups, oddities.group_evidence(lines, groups, "day", "amount", categories=["clerk", "status"]))


_RUSH = "CASE WHEN o_orderpriority = '1-URGENT' AND o_orderdate >= TIMESTAMP '1996-06-01' AND o_orderkey % 4 < 3 THEN 'RUSH' ELSE o_orderstatus END"


@query(f"""WITH w AS (SELECT lower(o_orderpriority) AS g, lower({_RUSH}) AS c, year(o_orderdate) * 12 + month(o_orderdate) - 1 AS m FROM orders WHERE o_orderdate IS NOT NULL),
l AS (SELECT g, m, count(*) AS r FROM w GROUP BY 1, 2), p AS (SELECT g, c, min(m) AS onset, count(*) AS n, count(DISTINCT m) AS have FROM w GROUP BY 1, 2),
k AS (SELECT c, min(onset) AS debut, count(*) AS held FROM p GROUP BY 1), a AS (SELECT count(*) AS pairs, min(onset) AS lo FROM p),
j AS (SELECT p.g, p.c, any_value(p.onset) AS onset, any_value(p.n) AS n, any_value(p.have) AS have, count(*) FILTER (l.m < p.onset) AS b, count(*) FILTER (l.m >= p.onset) AS f, coalesce(sum(l.r) FILTER (l.m < p.onset), 0) AS rb, sum(l.r) AS r FROM p JOIN l USING (g) GROUP BY 1, 2)
SELECT g AS grp, c AS code, (onset // 12) || '-' || lpad((onset % 12 + 1)::VARCHAR, 2, '0') AS month, b AS months_before, n AS n_rows FROM j JOIN k USING (c), a
WHERE b >= 3 AND f >= 3 AND n >= 5 AND have >= 0.8 * f AND pow(1 - n / r, rb) <= 0.01 / pairs AND NOT (debut - lo >= 3 AND held >= 2)""")
def onset_orders(t):
    """Rush orders begin for one priority at a day and go on."""
    return timeline.steady_onsets(t("orders").withColumn("code", F.expr(_RUSH)), "o_orderpriority", "code", "o_orderdate")


@query("""WITH l AS (SELECT c_custkey, c_mktsegment AS account, c_custkey % 40 = 7 AS odd, c_custkey % 3 = 0 AS rev FROM customer), k AS (SELECT account, count(*) AS n, count(*) FILTER (NOT odd) AS own FROM l GROUP BY 1)
SELECT c_custkey, account, 'debit' AS usual_side FROM l JOIN k USING (account) WHERE odd AND rev AND own >= 0.8 * n AND n >= 5 AND (SELECT count(*) FROM l JOIN k USING (account) WHERE odd AND rev AND own >= 0.8 * n AND n >= 5) >= 3""")
def contra_lines_customer(t):
    """Each fortieth line is on the credit side; those with a mark are told."""
    odd = F.col("c_custkey") % 40 == 7
    lines = t("customer").select("c_custkey", F.col("c_mktsegment").alias("account"), F.when(~odd, 10.5).alias("debit"), F.when(odd, 10.5).alias("credit"), F.when(F.col("c_custkey") % 3 == 0, "REV").otherwise("x").alias("memo"))
    return ledger.contra_lines(lines, "account", "debit", "credit", marked=F.col("memo") == "REV").select("c_custkey", "account", "usual_side")


@query("""WITH w AS (SELECT isodow(CAST(ts AS DATE)) IN (6, 7) AS off, CASE WHEN isodow(CAST(ts AS DATE)) IN (6, 7) THEN CASE WHEN event_id % 40 = 0 THEN 'usual' ELSE 'weekend' END ELSE 'usual' END AS code, event_type FROM events WHERE ts IS NOT NULL),
g AS (SELECT 1 AS i, 'code' AS "column", code AS value, count(*) FILTER (off) AS n_off, count(*) FILTER (NOT off) AS n_on FROM w GROUP BY 3 UNION ALL SELECT 0, 'event_type', event_type, count(*) FILTER (off), count(*) FILTER (NOT off) FROM w GROUP BY 3)
SELECT "column", value, n_off, n_on FROM g WHERE n_off >= 0.9 * (SELECT count(*) FROM w WHERE off) AND n_on <= 0.1 * n_off ORDER BY i LIMIT 1""")
def off_cycle_code_events(t):
    """Events of weekends, off a cycle of working days, share a code."""
    weekend = F.weekday("ts") >= 5
    code = F.when(weekend & (F.col("event_id") % 40 != 0), "weekend").otherwise("usual")
    return timeline.off_cycle_code(t("events").withColumn("code", code), weekend, ["event_type", "code"])
