"""Queries over orders, lineitems and events that stand for ledgers, job queues, runs and shares."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wayfind.operators import ledger, measure
from wayfind.plans.over_accounts import SITES_SQL, _entries, _sites, _table
from wayfind.plans.registry import query

CHARGES_SQL = "charges AS (SELECT o_custkey AS account_id, 'b' || (o_orderkey % 40) AS business_id, CASE o_orderkey % 5 WHEN 0 THEN 'grant' WHEN 1 THEN 'refund' WHEN 2 THEN 'no_website_unlock' ELSE 'match' END AS kind, -(o_orderkey % 5 + 1) * 1000 AS milli, o_orderdate AS made_at FROM orders)"


def _charges(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    kind = F.when(k % 5 == 0, "grant").when(k % 5 == 1, "refund").when(k % 5 == 2, "no_website_unlock").otherwise("match")
    return _table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("account_id"), F.concat(F.lit("b"), (k % 40).cast("string")).alias("business_id"), kind.alias("kind"), (-(k % 5 + 1) * 1000).alias("milli"), F.col("o_orderdate").alias("at"))


@query("refunds", f"""WITH {CHARGES_SQL}, asked AS (SELECT event_id AS request_id, user_id AS account_id, 'b' || (event_id % 40) AS business_id FROM events),
c AS (SELECT account_id, business_id, arg_min(milli, (made_at, milli)) AS charged FROM charges WHERE kind IN ('match', 'no_website_unlock') GROUP BY account_id, business_id), p AS (SELECT DISTINCT account_id, business_id, true AS before FROM charges WHERE kind = 'refund'),
j AS (SELECT a.*, charged, before, k.c_custkey AS known, row_number() OVER (PARTITION BY a.account_id, a.business_id ORDER BY request_id) AS rn FROM asked a LEFT JOIN c USING (account_id, business_id) LEFT JOIN p USING (account_id, business_id) LEFT JOIN customer k ON c_custkey = account_id AND c_custkey % 10 <> 0),
r AS (SELECT *, CASE WHEN known IS NULL THEN 'No such account.' WHEN before OR (rn > 1 AND charged IS NOT NULL) THEN 'Already refunded.' WHEN charged IS NULL THEN 'Nothing was charged for this.' END AS reason FROM j)
SELECT request_id, reason IS NULL AS refunded, reason, CASE WHEN reason IS NULL THEN -charged ELSE 0 END::BIGINT AS milli FROM r""")
def refunds(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = _table(spark, sf_dir, "events").select(F.col("event_id").alias("request_id"), F.col("user_id").alias("account_id"), F.concat(F.lit("b"), (F.col("event_id") % 40).cast("string")).alias("business_id"))
    accounts = _table(spark, sf_dir, "customer").filter("c_custkey % 10 <> 0").select(F.col("c_custkey").alias("account_id"))
    return ledger.refunds(asked, _charges(spark, sf_dir), accounts)


@query("renewals", "WITH b AS (SELECT o_custkey AS account_id, sum(CASE WHEN o_orderstatus = 'F' THEN -1 ELSE 1 END * round(o_totalprice * 10)::BIGINT) AS milli FROM orders GROUP BY o_custkey), a AS (SELECT *, (account_id % 7 + 1) * 400000 AS cap FROM b) SELECT account_id, greatest(0, least(milli, cap))::BIGINT AS carried, greatest(0, milli - cap)::BIGINT AS expired, cap AS granted FROM a")
def renewals(spark: SparkSession, sf_dir: str) -> DataFrame:
    balances = _entries(spark, sf_dir).groupBy("account_id").agg(F.sum("milli").alias("milli"))
    return ledger.renewals(balances.withColumn("allowance", (F.col("account_id") % 7 + 1) * 400_000))


@query("spend_reads", """WITH a AS (SELECT event_id AS request_id, user_id AS account_id, event_id % 9 AS reads, user_id % 4 * 10 AS allowance, ts FROM events), b AS (SELECT *, coalesce(sum(reads) OVER (PARTITION BY account_id ORDER BY ts, request_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM a)
SELECT request_id, (greatest(0, least(reads, allowance - least(before, allowance))))::BIGINT AS allowed FROM b""")
def spend_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = _table(spark, sf_dir, "events").select(F.col("event_id").alias("request_id"), F.col("user_id").alias("account_id"), (F.col("event_id") % 9).alias("reads"), (F.col("user_id") % 4 * 10).alias("allowance"), F.col("ts").alias("at"))
    return ledger.spend_reads(asked)


@query("recorded_runs", """WITH r AS (SELECT user_id AS account_id, event_type AS market, ts, event_id, event_id % 30 - 2 AS matched, CASE WHEN event_id % 3 = 0 THEN 'q' || event_id END AS query FROM events)
SELECT account_id, market, count(*) AS times, max(ts) AS last_run_at, arg_max(greatest(matched, 0), (ts, event_id)) AS matched, arg_max(query, (ts, event_id)) FILTER (query IS NOT NULL) AS query FROM r GROUP BY account_id, market""")
def recorded_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = _table(spark, sf_dir, "events").select(F.col("user_id").alias("account_id"), F.col("event_type").alias("market"), F.col("ts").alias("at"), F.col("event_id").alias("run_id"), (F.col("event_id") % 30 - 2).alias("matched"), F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("q"), F.col("event_id").cast("string"))).alias("query"))
    return ledger.upserted_runs(runs, ["account_id", "market"])


@query("mail_claims", "SELECT event_id, row_number() OVER (PARTITION BY user_id, event_type, yearweek(ts) ORDER BY ts, event_id) = 1 AS claimed, isoyear(ts) || '-W' || lpad(weekofyear(ts)::VARCHAR, 2, '0') AS period FROM events")
def mail_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One mail of a kind an account and week: the first claim acts."""
    claims = _table(spark, sf_dir, "events").withColumn("period", ledger.iso_week(F.col("ts")))
    return ledger.first_claims(claims, ["user_id", "event_type", "period"], ["ts", "event_id"]).select("event_id", "claimed", "period")


@query("unlock_windows", """WITH w AS (SELECT o_orderkey AS id, o_orderdate AS a, (SELECT max(o_orderdate) FROM orders) AS b FROM orders) SELECT id, ((year(b) - year(a)) * 12 + month(b) - month(a) - CASE WHEN day(b) < day(a) THEN 1 ELSE 0 END)::INTEGER AS months, (year(b) - year(a)) * 12 + month(b) - month(a) - CASE WHEN day(b) < day(a) THEN 1 ELSE 0 END < 12 AS free FROM w""")
def unlock_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many calendar months ago each order was made, and whether an unlock of that age still holds."""
    orders = _table(spark, sf_dir, "orders")
    now = orders.agg(F.max("o_orderdate").alias("now"))
    months = ledger.months_between(F.col("o_orderdate"), F.col("now"))
    return orders.crossJoin(F.broadcast(now)).select(F.col("o_orderkey").alias("id"), months.alias("months"), (months < 12).alias("free"))  # one row


@query("sites_taken", f"WITH {SITES_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY job_id, state ORDER BY ordinal) AS rn FROM sites) SELECT job_id, ordinal, CASE WHEN state = 'pending' AND rn <= 2 THEN 'taken' ELSE state END AS state FROM r")
def sites_taken(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.taken(_sites(spark, sf_dir), 2).select("job_id", "ordinal", "state")


@query("sites_recorded", f"WITH {SITES_SQL}, n AS (SELECT job_id, ordinal, CASE WHEN job_id % 4 = 0 THEN NULL ELSE 'match' END AS v, CASE WHEN job_id % 3 = 0 THEN NULL ELSE ordinal + 1 END AS p FROM sites WHERE ordinal % 2 = 0) SELECT s.job_id, s.ordinal, CASE WHEN n.job_id IS NOT NULL THEN 'done' ELSE state END AS state, coalesce(v, verdict) AS verdict, coalesce(p, 1)::INTEGER AS pages FROM sites s LEFT JOIN n ON n.job_id = s.job_id AND n.ordinal = s.ordinal")
def sites_recorded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The results of a slice of reads written over the sites they belong to."""
    sites = _sites(spark, sf_dir).withColumn("pages", F.lit(1))
    results = sites.filter("ordinal % 2 = 0").select("job_id", "ordinal", F.when(F.col("job_id") % 4 != 0, "match").alias("verdict"), F.when(F.col("job_id") % 3 != 0, F.col("ordinal") + 1).alias("pages"))
    return ledger.recorded(sites, results)


@query("sites_appended", "WITH s AS (SELECT l_orderkey AS job_id, 's' || l_partkey AS site, l_linenumber::BIGINT AS ordinal FROM lineitem), m AS (SELECT o_orderkey AS job_id, unnest(['x', 'y', 'z']) AS site, unnest([1, 2, 3]) AS i FROM orders WHERE o_orderkey % 5 = 0) SELECT * FROM s UNION ALL SELECT m.job_id, m.site, coalesce((SELECT max(ordinal) FROM s WHERE s.job_id = m.job_id), 0) + i FROM m")
def sites_appended(spark: SparkSession, sf_dir: str) -> DataFrame:
    sites = _table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("job_id"), F.concat(F.lit("s"), F.col("l_partkey").cast("string")).alias("site"), F.col("l_linenumber").alias("ordinal"))
    more = _table(spark, sf_dir, "orders").filter("o_orderkey % 5 = 0").select(F.col("o_orderkey").alias("job_id"), F.array(F.lit("x"), F.lit("y"), F.lit("z")).alias("sites"))
    return ledger.appended(sites, more)


@query("first_orders", "SELECT c_custkey AS account_id, (SELECT o_orderkey FROM orders WHERE o_custkey = c_custkey ORDER BY o_orderdate, o_orderkey LIMIT 1) AS first_order FROM customer")
def first_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = _table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("account_id")).agg(F.min_by("o_orderkey", F.struct("o_orderdate", "o_orderkey")).alias("first_order"))
    return _table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("account_id")).join(first, "account_id", "left")


@query("share_report", """WITH s AS (SELECT o_custkey AS account_id, o_orderkey AS token, o_orderstatus <> 'F' AS live, o_orderkey % 12 AS views FROM orders), v AS (SELECT user_id AS token, count(*) AS signups FROM events WHERE event_type = 'purchase' GROUP BY user_id)
SELECT account_id, count(*) AS shares, count(*) FILTER (live) AS live, sum(views)::BIGINT AS views, coalesce(sum(signups), 0)::BIGINT AS signups FROM s LEFT JOIN v USING (token) GROUP BY account_id""")
def share_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shared lists of each account, how often they were seen and who signed up from them."""
    shares = _table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("account_id"), F.col("o_orderkey").alias("token"), (F.col("o_orderstatus") != "F").alias("live"), (F.col("o_orderkey") % 12).alias("views"))
    signups = _table(spark, sf_dir, "events").filter("event_type = 'purchase'").groupBy(F.col("user_id").alias("token")).agg(F.count("*").alias("signups"))
    return shares.join(signups, "token", "left").groupBy("account_id").agg(F.count("*").alias("shares"), F.count_if("live").alias("live"), F.sum("views").alias("views"), F.coalesce(F.sum("signups"), F.lit(0)).alias("signups"))


@query("stale_counts", "WITH m AS (SELECT max(ts) AS now FROM events), l AS (SELECT event_type AS trade, user_id % 50 AS city, max(ts) AS computed_at FROM events GROUP BY 1, 2) SELECT trade, city, computed_at > now - INTERVAL 7 DAY AS cached, computed_at > now - INTERVAL 30 DAY AS fresh FROM l, m")
def stale_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which counts may be answered from the cache (7 days) and which need no recount (30 days)."""
    events = _table(spark, sf_dir, "events")
    now = events.agg(F.max("ts").alias("now"))
    last = events.groupBy(F.col("event_type").alias("trade"), (F.col("user_id") % 50).alias("city")).agg(F.max("ts").alias("computed_at"))
    younger = lambda days: F.col("computed_at") > F.col("now") - F.expr(f"INTERVAL {days} DAY")
    return last.crossJoin(F.broadcast(now)).select("trade", "city", younger(7).alias("cached"), younger(30).alias("fresh"))  # one row


@query("cohort_window", "WITH m AS (SELECT max(o_orderdate) AS now FROM orders) SELECT o_orderkey AS id FROM orders, m WHERE o_orderdate BETWEEN now - INTERVAL 168 HOUR AND now - INTERVAL 48 HOUR AND NOT EXISTS (SELECT 1 FROM events WHERE user_id = o_custkey AND event_type = 'error') ORDER BY o_orderdate, o_orderkey LIMIT 200")
def cohort_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accounts between two days and a week old that were not nudged, the oldest first."""
    orders = _table(spark, sf_dir, "orders")
    now = orders.agg(F.max("o_orderdate").alias("now"))
    nudged = _table(spark, sf_dir, "events").filter("event_type = 'error'").select(F.col("user_id").alias("o_custkey"))
    aged = orders.crossJoin(F.broadcast(now)).filter(F.col("o_orderdate").between(F.col("now") - F.expr("INTERVAL 168 HOUR"), F.col("now") - F.expr("INTERVAL 48 HOUR")))  # one row
    return aged.join(nudged, "o_custkey", "left_anti").orderBy("o_orderdate", "o_orderkey").limit(200).select(F.col("o_orderkey").alias("id"))


@query("prospect_counts", "SELECT o_orderstatus AS status, count(*) AS n FROM orders GROUP BY o_orderstatus ORDER BY n DESC, status")
def prospect_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "orders").groupBy(F.col("o_orderstatus").alias("status")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "status")


CONTACT_SQL = "log AS (SELECT user_id AS account_id, event_id % 20 AS business, event_id, ts, CASE WHEN event_type = 'error' THEN 'unmark' ELSE 'mark' END AS kind FROM events), last AS (SELECT *, row_number() OVER (PARTITION BY account_id, business ORDER BY ts DESC, event_id DESC) AS rn FROM log)"


@query("contacted_list", f"WITH {CONTACT_SQL}, c AS (SELECT *, row_number() OVER (PARTITION BY account_id ORDER BY ts DESC, event_id DESC) AS place FROM last WHERE rn = 1 AND kind = 'mark') SELECT account_id, business, place::INTEGER AS place FROM c WHERE place <= 5")
def contacted_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whom each account has contacted, latest first: the last mark or unmark of a business holds."""
    log = _table(spark, sf_dir, "events").select(F.col("user_id").alias("account_id"), (F.col("event_id") % 20).alias("business"), F.struct("ts", "event_id").alias("at"), (F.col("event_type") != "error").alias("marked"))
    now = log.groupBy("account_id", "business").agg(F.max("at").alias("at"), F.max_by("marked", "at").alias("marked")).filter("marked")
    return now.withColumn("place", F.row_number().over(Window.partitionBy("account_id").orderBy(F.desc("at")))).filter("place <= 5").select("account_id", "business", "place")


@query("margin_sweep", """WITH m AS (SELECT n_regionkey AS niche, sum(o_totalprice) / 1e6 AS spend, count(*) AS reads, count(*) FILTER (o_orderkey % 9 = 0) AS matched FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey GROUP BY n_regionkey),
p(plan, price, credits) AS (VALUES ('Starter', 29.0::DOUBLE, 120), ('Growth', 79.0::DOUBLE, 400), ('Agency', 199.0::DOUBLE, 1000)), r(policy) AS (VALUES ('every'), ('match')),
c AS (SELECT niche, plan, policy, price / credits * CASE WHEN matched / reads::DOUBLE >= 0.15 THEN 1 WHEN matched / reads::DOUBLE >= 0.06 THEN 4 ELSE 5 END AS revenue, (spend / reads + 0.0015 + CASE WHEN policy = 'every' THEN 0.008 ELSE 0 END) * reads / matched + CASE WHEN policy = 'match' THEN 0.008 ELSE 0 END AS cost FROM m, p, r)
SELECT niche, plan, policy, round((revenue - cost) / revenue, 6) AS margin FROM c""")
def margin_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gross margin of every niche under every plan and way to buy reviews."""
    nation = _table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_regionkey").alias("niche"))
    orders = _table(spark, sf_dir, "orders").join(_table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey"), "o_custkey").join(nation, "c_nationkey")
    niches = orders.groupBy("niche").agg((F.sum("o_totalprice") / 1e6).alias("spend"), F.count("*").alias("reads"), F.count_if(F.col("o_orderkey") % 9 == 0).alias("matched"))
    return measure.margins(niches).select("niche", "plan", "policy", F.round("margin", 6).alias("margin"))


@query("gap_fill_costs", """WITH r AS (SELECT n_regionkey AS market, s_suppkey % 4 AS run, avg(abs(s_acctbal)) / 1e6 AS per_read FROM supplier JOIN nation ON n_nationkey = s_nationkey GROUP BY 1, 2), d AS (SELECT market, max(per_read) AS read_cost FROM r GROUP BY market),
c AS (SELECT n_regionkey AS market, count(*) AS places, count(*) FILTER (c_acctbal < 0) AS missing, count(*) FILTER (c_custkey % 8 = 0) AS matched FROM customer JOIN nation ON n_nationkey = c_nationkey GROUP BY 1)
SELECT market, round(read_cost, 9) AS read_cost, round((read_cost + 0.0032 * missing / places) * places / matched, 9) AS per_match FROM c JOIN d USING (market) WHERE matched > 0""")
def gap_fill_costs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a match costs with bought places for the missing share, from the dearest run of each market."""
    nation = _table(spark, sf_dir, "nation").select("n_nationkey", F.col("n_regionkey").alias("market"))
    runs = _table(spark, sf_dir, "supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey")).groupBy("market", (F.col("s_suppkey") % 4).alias("run")).agg((F.avg(F.abs("s_acctbal")) / 1e6).alias("per_read"))
    pools = _table(spark, sf_dir, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey")).groupBy("market").agg(F.count("*").alias("places"), F.count_if(F.col("c_acctbal") < 0).alias("missing"), F.count_if(F.col("c_custkey") % 8 == 0).alias("matched"))
    return measure.gap_fill(runs, pools, 0.0032).select("market", F.round("read_cost", 9).alias("read_cost"), F.round("per_match", 9).alias("per_match"))


@query("stop_verdict", """WITH e AS (SELECT 'u' || user_id AS who, CASE event_type WHEN 'error' THEN 'bounced' WHEN 'purchase' THEN 'reply' ELSE 'sent' END AS kind FROM events WHERE user_id % 50 <> 0),
s AS (SELECT (SELECT count(DISTINCT who) FROM e WHERE kind = 'sent' AND who NOT IN (SELECT who FROM e WHERE kind = 'bounced')) AS reached, (SELECT count(DISTINCT who) FROM e WHERE kind = 'reply') AS wanted)
SELECT limit_, reached, CASE WHEN wanted > 0 AND limit_ % 2 = 0 THEN 'working' WHEN reached >= limit_ THEN 'stop' ELSE 'testing' END AS verdict FROM s, (VALUES (1), (2), (1001), (1000000001)) t(limit_)""")
def stop_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether to go on, for several limits: with answers counted for the even ones only."""
    events = _table(spark, sf_dir, "events")
    kind = F.when(F.col("event_type") == "error", "bounced").when(F.col("event_type") == "purchase", "reply").otherwise("sent")
    email = F.concat(F.lit("U"), F.col("user_id").cast("string"))
    seeds = events.filter("user_id % 50 = 0").select(email.alias("email")).distinct()
    counted = measure.stop_rule(events.select(email.alias("email"), kind.alias("kind")), seeds)
    limits = spark.createDataFrame([(1,), (2,), (1001,), (1_000_000_001,)], "limit_ long")
    wanted = F.when(F.col("limit_") % 2 == 0, F.col("wanted")).otherwise(0)
    return limits.crossJoin(F.broadcast(counted)).select("limit_", F.col("sent").alias("reached"), measure.stop_verdict(F.col("sent"), wanted, F.col("limit_")).alias("verdict"))  # one row
