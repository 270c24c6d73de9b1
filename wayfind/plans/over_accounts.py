"""Queries over orders, lineitems and events that stand for ledgers, jobs and calls."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wayfind.functions import stats
from wayfind.operators import accounts, measure, resolve
from wayfind.plans.registry import query
from wayfind.streaming import events as streams


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


ENTRIES_SQL = "entries AS (SELECT o_orderkey AS id, o_custkey AS account_id, CASE WHEN o_orderstatus = 'F' THEN -1 ELSE 1 END * round(o_totalprice * 10)::BIGINT AS milli, o_orderdate AS made_at, o_orderpriority AS source FROM orders)"


def _entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    sign = F.when(F.col("o_orderstatus") == "F", -1).otherwise(1)
    return _table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("account_id"), (sign * F.round(F.col("o_totalprice") * 10).cast("long")).alias("milli"), F.col("o_orderdate").alias("at"), F.col("o_orderpriority").alias("source"))


@query("account_balances", f"WITH {ENTRIES_SQL} SELECT account_id, sum(milli)::BIGINT AS milli FROM entries GROUP BY account_id")
def account_balances(spark: SparkSession, sf_dir: str) -> DataFrame:
    return accounts.balances(_entries(spark, sf_dir))


@query("ledger_history", f"WITH {ENTRIES_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY account_id ORDER BY made_at DESC, id DESC) AS n FROM entries) SELECT account_id, id, milli FROM r WHERE n <= 3")
def ledger_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = Window.partitionBy("account_id").orderBy(F.desc("at"), F.desc("id"))
    return _entries(spark, sf_dir).withColumn("n", F.row_number().over(order)).filter("n <= 3").select("account_id", "id", "milli")


@query("channel_report", f"WITH {ENTRIES_SQL}, per AS (SELECT account_id, coalesce(min(source), '(none)') AS source, count(*) AS runs, (sum(milli) FILTER (milli < 0))::BIGINT AS spent, min(made_at) AS first_at FROM entries GROUP BY account_id) SELECT source, count(*) AS accounts, count(*) FILTER (spent IS NOT NULL) AS paying, sum(runs)::BIGINT AS runs, coalesce(sum(spent), 0)::BIGINT AS spent, min(first_at) AS first_at FROM per GROUP BY source")
def channel_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    per = _entries(spark, sf_dir).groupBy("account_id").agg(F.coalesce(F.min("source"), F.lit("(none)")).alias("source"), F.count("*").alias("runs"), F.sum(F.when(F.col("milli") < 0, F.col("milli"))).alias("spent"), F.min("at").alias("first_at"))
    return per.groupBy("source").agg(F.count("*").alias("accounts"), F.count("spent").alias("paying"), F.sum("runs").alias("runs"), F.coalesce(F.sum("spent"), F.lit(0)).alias("spent"), F.min("first_at").alias("first_at"))


@query("nudge_candidates", """SELECT c_custkey AS account_id, coalesce(b.milli, 0)::BIGINT AS milli FROM customer LEFT JOIN (SELECT o_custkey, sum(round(o_totalprice * 10)::BIGINT) AS milli FROM orders GROUP BY o_custkey) b ON o_custkey = c_custkey
WHERE c_custkey % 17 < 5 AND NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c_custkey AND o_orderstatus = 'F') AND NOT EXISTS (SELECT 1 FROM events e WHERE e.user_id = c_custkey AND event_type = 'purchase')""")
def nudge_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A cohort never charged and never nudged, with balances."""
    orders = _table(spark, sf_dir, "orders")
    cohort = _table(spark, sf_dir, "customer").filter("c_custkey % 17 < 5").select(F.col("c_custkey").alias("account_id"))
    charged = orders.filter("o_orderstatus = 'F'").select(F.col("o_custkey").alias("account_id"))
    nudged = _table(spark, sf_dir, "events").filter("event_type = 'purchase'").select(F.col("user_id").alias("account_id"))
    balance = orders.groupBy(F.col("o_custkey").alias("account_id")).agg(F.sum(F.round(F.col("o_totalprice") * 10).cast("long")).alias("milli"))
    left = cohort.join(charged, "account_id", "left_anti").join(nudged, "account_id", "left_anti")
    return left.join(balance, "account_id", "left").select("account_id", F.coalesce("milli", F.lit(0)).cast("long").alias("milli"))


SITES_SQL = "sites AS (SELECT l_orderkey AS job_id, l_linenumber AS ordinal, CASE l_linestatus WHEN 'O' THEN 'pending' ELSE 'done' END AS state, CASE WHEN l_linestatus <> 'O' THEN CASE l_returnflag WHEN 'R' THEN 'match' WHEN 'A' THEN 'no_match' ELSE 'couldnt_tell' END END AS verdict FROM lineitem)"


def _sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = F.col("l_linestatus") != "O"
    verdict = F.when(done, F.when(F.col("l_returnflag") == "R", "match").when(F.col("l_returnflag") == "A", "no_match").otherwise("couldnt_tell"))
    return _table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("job_id"), F.col("l_linenumber").alias("ordinal"), F.when(done, "done").otherwise("pending").alias("state"), verdict.alias("verdict"))


@query("job_counters", f"WITH {SITES_SQL} SELECT job_id, count(*) AS sites_total, count(*) FILTER (state = 'done') AS sites_read, count(*) FILTER (state = 'done' AND verdict IS NOT NULL) AS sites_judged, count(*) FILTER (verdict = 'match') AS matched, count(*) FILTER (verdict = 'couldnt_tell') AS unclear FROM sites GROUP BY job_id")
def job_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return accounts.job_counters(_sites(spark, sf_dir))


@query("job_claim", f"WITH {SITES_SQL} SELECT o_orderkey AS job_id FROM orders WHERE o_orderkey % 3 <> 0 AND EXISTS (SELECT 1 FROM sites WHERE job_id = o_orderkey AND state = 'pending') ORDER BY o_orderdate, o_orderkey LIMIT 1")
def job_claim(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The job that a worker takes next; every third is leased."""
    now = F.lit("2100-01-01").cast("timestamp")
    k = F.col("o_orderkey")
    lease = F.when(k % 3 == 0, F.lit("2200-01-01").cast("timestamp"))
    jobs = _table(spark, sf_dir, "orders").select(k.alias("job_id"), F.col("o_orderdate").alias("created_at"), lease.alias("leased_until"))
    return accounts.claim(jobs, _sites(spark, sf_dir), now).select("job_id")


@query("stale_sites", """WITH last AS (SELECT max(ts) AS now FROM events), s AS (SELECT event_type, CASE WHEN event_id % 2 = 0 AND epoch(now) - epoch(ts) > 86400 THEN 'pending' WHEN event_id % 2 = 0 THEN 'taken' ELSE 'done' END AS state FROM events, last) SELECT event_type, state, count(*) AS n FROM s GROUP BY ALL""")
def stale_sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leases older than a day go back to pending."""
    events = _table(spark, sf_dir, "events")
    last = events.agg(F.max("ts").cast("timestamp").alias("now"))
    sites = events.crossJoin(F.broadcast(last)).select("event_type", "now", F.when(F.col("event_id") % 2 == 0, "taken").otherwise("done").alias("state"), F.col("ts").cast("timestamp").alias("taken_at"))
    return accounts.sweep(sites, F.col("now"), 86_400).groupBy("event_type", "state").agg(F.count("*").alias("n"))


@query("run_checkpoints", """WITH r AS (SELECT l_suppkey % 5 AS job_id, row_number() OVER w AS reads, sum(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) OVER w AS matches FROM lineitem WINDOW w AS (PARTITION BY l_suppkey % 5 ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey ROWS UNBOUNDED PRECEDING)) SELECT job_id, reads, matches::BIGINT AS matches FROM r WHERE reads IN (200, 400, 800, 1600)""")
def run_checkpoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    reads = _table(spark, sf_dir, "lineitem").select((F.col("l_suppkey") % 5).alias("job_id"), F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("ordinal"), (F.col("l_returnflag") == "R").alias("matched"))
    return accounts.checkpoints(reads)


CHARGES_SQL = """WITH RECURSIVE r AS (SELECT o_orderkey AS request_id, o_custkey AS account_id, 'b' || (o_orderkey % 7) AS business_id, o_orderkey % 5 + 1 AS cost, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS k FROM orders),
a AS (SELECT c_custkey AS account_id, c_custkey % 20 AS milli, c_custkey % 25 = 1 AS comped FROM customer WHERE c_custkey % 10 <> 0), j AS (SELECT r.*, milli, coalesce(comped, false) AS comped FROM r LEFT JOIN a USING (account_id)),
f AS (SELECT account_id, 0::BIGINT AS k, milli AS funds, []::VARCHAR[] AS unlocked, NULL::BIGINT AS request_id, false AS charged, NULL::VARCHAR AS reason, 0::BIGINT AS milli FROM j WHERE k = 1
  UNION ALL SELECT account_id, k, CASE WHEN why IS NULL THEN funds - taken ELSE funds END, CASE WHEN why IS NULL THEN list_append(unlocked, business_id) ELSE unlocked END, request_id, why IS NULL, why, CASE WHEN why IS NULL THEN taken ELSE 0 END
  FROM (SELECT j.account_id, j.k, f.funds, f.unlocked, j.business_id, j.request_id, CASE WHEN comped THEN 0 ELSE cost END::BIGINT AS taken,
    CASE WHEN f.funds IS NULL THEN 'No such account.' WHEN list_contains(f.unlocked, j.business_id) THEN 'Already unlocked by this workspace.' WHEN NOT comped AND f.funds < cost THEN 'Not enough credits left.' END AS why FROM f JOIN j ON j.account_id = f.account_id AND j.k = f.k + 1))
SELECT request_id, charged, reason, milli FROM f WHERE k > 0"""
RATION_SQL = """WITH RECURSIVE q AS (SELECT event_id AS call_id, user_id AS caller, epoch_us(ts) AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events),
f AS (SELECT caller, 0::BIGINT AS k, []::BIGINT[] AS kept, NULL::BIGINT AS call_id, false AS admitted FROM q WHERE k = 1
  UNION ALL SELECT caller, k, CASE WHEN ok THEN list_append(recent, t) ELSE recent END, call_id, ok FROM (SELECT *, len(recent) < 5 AND len(list_filter(recent, lambda x: x > t - 3600000000)) < 2 AS ok
    FROM (SELECT q.caller, q.k, q.t, q.call_id, list_filter(f.kept, lambda x: x > q.t - 86400000000) AS recent FROM f JOIN q ON q.caller = f.caller AND q.k = f.k + 1)))
SELECT call_id, admitted FROM f WHERE k > 0"""


@query("credit_charges", CHARGES_SQL)
def credit_charges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each order asks for credits in turn: a fold over the running balance."""
    requests = _table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("request_id"), F.col("o_custkey").alias("account_id"), F.concat(F.lit("b"), (F.col("o_orderkey") % 7).cast("string")).alias("business_id"), (F.col("o_orderkey") % 5 + 1).cast("long").alias("cost"), F.col("o_orderdate").alias("at"))
    opening = _table(spark, sf_dir, "customer").filter("c_custkey % 10 <> 0").select(F.col("c_custkey").alias("account_id"), (F.col("c_custkey") % 20).cast("long").alias("milli"), (F.col("c_custkey") % 25 == 1).alias("comped"))
    return accounts.charge(requests, opening)


@query("rationed_calls", RATION_SQL)
def rationed_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which events a limit of 2 an hour and 5 a day admits: a fold in which refused calls leave no trace."""
    return accounts.rationed(_table(spark, sf_dir, "events").select(F.col("event_id").alias("call_id"), F.col("user_id").alias("caller"), F.col("ts").alias("at")), 2, 5)


@query("recent_calls", "SELECT event_id AS call_id, count(*) OVER (PARTITION BY user_id ORDER BY epoch_us(ts) RANGE BETWEEN 3600000000 PRECEDING AND CURRENT ROW) AS in_hour FROM events")
def recent_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls = _table(spark, sf_dir, "events").select(F.col("event_id").alias("call_id"), F.col("user_id").alias("caller"), F.col("ts").alias("at"))
    return accounts.recent_calls(calls).select("call_id", "in_hour")


@query("stop_rule", """WITH e AS (SELECT lower('U' || user_id || '@Example.com') AS who, CASE event_type WHEN 'click' THEN 'sent' WHEN 'error' THEN 'bounced' WHEN 'purchase' THEN 'reply' ELSE 'sent' END AS kind FROM events WHERE user_id % 50 <> 0)
SELECT (SELECT count(DISTINCT who) FROM e WHERE kind = 'sent' AND who NOT IN (SELECT who FROM e WHERE kind = 'bounced')) AS sent, (SELECT count(DISTINCT who) FROM e WHERE kind = 'reply') AS wanted""")
def stop_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = _table(spark, sf_dir, "events")
    kind = F.when(F.col("event_type") == "error", "bounced").when(F.col("event_type") == "purchase", "reply").otherwise("sent")
    email = F.concat(F.lit("U"), F.col("user_id").cast("string"), F.lit("@Example.com"))
    seeds = events.filter("user_id % 50 = 0").select(F.upper(email).alias("email")).distinct()
    return measure.stop_rule(events.select(email.alias("email"), kind.alias("kind")), seeds)


@query("daily_digest", "SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) AS events, count(*) FILTER (event_type = 'purchase') AS replies, count(DISTINCT CASE WHEN event_type = 'purchase' THEN user_id END) AS repliers, count(DISTINCT user_id) AS visitors FROM events GROUP BY 1")
def daily_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    bought = F.col("event_type") == "purchase"
    return _table(spark, sf_dir, "events").groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(F.count("*").alias("events"), F.count_if(bought).alias("replies"), F.countDistinct(F.when(bought, F.col("user_id"))).alias("repliers"), F.countDistinct("user_id").alias("visitors"))


@query("event_props", "SELECT event_type, count(*) AS n, sum((props->>'$.k')::BIGINT)::BIGINT AS k_sum, max((props->>'$.k')::BIGINT) AS k_max FROM events GROUP BY event_type")
def event_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Free-form properties read as variants."""
    k = F.try_variant_get(F.try_parse_json("props"), "$.k", "long")
    return _table(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.sum(k).alias("k_sum"), F.max(k).alias("k_max"))


@query("latest_event", "SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n = 1")
def latest_event(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolve.latest(_table(spark, sf_dir, "events"), ["user_id"], [F.desc("ts"), F.desc("event_id")]).select("user_id", "event_id", "event_type")


@query("event_windows", "SELECT date_trunc('hour', ts)::TIMESTAMP AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def event_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return streams.counts_by_window(_table(spark, sf_dir, "events")).withColumn("total", F.round("total", 4))


@query("event_sessions", """WITH g AS (SELECT user_id, ts, CASE WHEN ts > lag(ts) OVER w + INTERVAL 30 MINUTE THEN 1 WHEN lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS s FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
n AS (SELECT user_id, ts, sum(s) OVER (PARTITION BY user_id ORDER BY ts, s DESC ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 30 MINUTE AS "end", count(*) AS n FROM n GROUP BY user_id, k""")
def event_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return streams.sessions(_table(spark, sf_dir, "events"))


@query("pushed_then_suppressed", """SELECT o_orderkey AS push_id, c_custkey AS account_id, s_suppkey AS supplier FROM orders JOIN customer ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN supplier ON s_suppkey = l_suppkey AND s_suppkey % 20 = 0 WHERE l_shipdate > o_orderdate""")
def pushed_then_suppressed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pushes to destinations whose business asked for removal before delivery."""
    lines = _table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("push_id"), F.col("l_suppkey").alias("supplier"), "l_shipdate")
    asked = _table(spark, sf_dir, "supplier").filter("s_suppkey % 20 = 0").select(F.col("s_suppkey").alias("supplier"))
    orders = _table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("push_id"), F.col("o_custkey").alias("account_id"), "o_orderdate")
    customers = _table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("account_id"))
    return lines.join(asked, "supplier").join(orders, "push_id").filter("l_shipdate > o_orderdate").join(customers, "account_id").select("push_id", "account_id", "supplier")


@query("cost_by_stage", "SELECT l_returnflag AS stage, count(*) AS calls, sum(l_quantity * 3 + l_discount * 100)::DOUBLE AS units, round(100.0 * count(*) FILTER (l_linestatus = 'F') / count(*), 1)::DOUBLE AS cached_share FROM lineitem GROUP BY l_returnflag")
def cost_by_stage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("stage")).agg(F.count("*").alias("calls"), F.sum(F.col("l_quantity") * 3 + F.col("l_discount") * 100).alias("units"), stats.share(F.count_if(F.col("l_linestatus") == "F"), F.count("*")).alias("cached_share"))


@query("coverage_estimate", """WITH s AS (SELECT n_regionkey AS market, s_nationkey % 3 AS stratum, count(*) AS places, count(*) FILTER (s_acctbal > 0) AS matched FROM supplier JOIN nation ON n_nationkey = s_nationkey GROUP BY 1, 2)
SELECT market, round(sum(matched * (10.0 + stratum) / (stratum + 1)) / sum(places * (10.0 + stratum) / (stratum + 1)), 6)::DOUBLE AS estimate FROM s GROUP BY market""")
def coverage_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = _table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("s_nationkey"), F.col("n_regionkey").alias("market"))
    strata = _table(spark, sf_dir, "supplier").join(nation, "s_nationkey").groupBy("market", (F.col("s_nationkey") % 3).alias("stratum")).agg(F.count("*").alias("places"), F.count_if(F.col("s_acctbal") > 0).alias("matched"))
    shaped = strata.withColumns({"cells": 10.0 + F.col("stratum"), "sampled": F.col("stratum") + 1})
    return measure.strata_estimate(shaped, "market").withColumn("estimate", F.round("estimate", 6))
