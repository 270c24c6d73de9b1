"""Ledgers, reports over accounts, work queues and rationed calls."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def balances(entries: DataFrame) -> DataFrame:
    return entries.groupBy("account_id").agg(F.sum("milli").alias("milli"))


def _folded(rows: DataFrame, key: str, order: list[str], step, schema: str) -> DataFrame:
    """Rows in order within each key, given one by one to step(state, row) -> (state, output row).

    Partitions are sorted and streamed, so memory holds a batch and one key's state,
    however many rows a key has.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in schema.split(", ")]
        now, state = object(), None  # no key is this object, so the first row begins a state
        for pdf in batches:
            out = []
            for row in pdf.itertuples(index=False):
                this = getattr(row, key)
                this = None if pd.isna(this) else this  # a null key is one key, although NaN never equals itself
                if this != now:
                    now, state = this, None
                state, made = step(state, row)
                out.append(made)
            yield pd.DataFrame(out, columns=names)

    return rows.repartition(key).sortWithinPartitions(key, *order).mapInPandas(run, schema)


def charge(requests: DataFrame, opening: DataFrame) -> DataFrame:
    """request_id, charged, reason, milli: requests(request_id, account_id, business_id, cost, at) in order, from opening(account_id, milli, comped).

    Each charge depends on the balance that those before it left, so an account's
    requests are folded in order; the state is its balance and the ids that it unlocked,
    so it is as large as one account's unlocks.
    """

    def step(state, r):
        left, unlocked = state or (r.milli, set())
        if pd.isna(left):
            return (left, unlocked), (r.request_id, False, "No such account.", 0)
        if r.business_id in unlocked:
            return (left, unlocked), (r.request_id, False, "Already unlocked by this workspace.", 0)
        if not r.comped and left < r.cost:
            return (left, unlocked), (r.request_id, False, "Not enough credits left.", 0)
        unlocked.add(r.business_id)
        cost = 0 if r.comped else int(r.cost)
        return (left - cost, unlocked), (r.request_id, True, None, cost)

    joined = requests.join(opening, "account_id", "left").withColumn("comped", F.coalesce("comped", F.lit(False)))
    return _folded(joined, "account_id", ["at", "request_id"], step, "request_id long, charged boolean, reason string, milli long")


def rationed(calls: DataFrame, per_hour: int, per_day: int) -> DataFrame:
    """call_id, admitted: calls(call_id, caller, at) in order; only admitted calls count against a caller."""

    def step(kept, r):
        kept = [t for t in kept or [] if t > r.at - pd.Timedelta(days=1)]
        ok = len(kept) < per_day and sum(t > r.at - pd.Timedelta(hours=1) for t in kept) < per_hour
        return (kept + [r.at] if ok else kept), (r.call_id, ok)

    return _folded(calls, "caller", ["at", "call_id"], step, "call_id long, admitted boolean")


def recent_calls(calls: DataFrame) -> DataFrame:
    """Each call with its caller's calls in the hour up to it: the analytic form, over all calls."""
    hour = Window.partitionBy("caller").orderBy(F.unix_micros(F.col("at").cast("timestamp"))).rangeBetween(-3_600_000_000, 0)
    return calls.withColumn("in_hour", F.count("*").over(hour))


def job_counters(sites: DataFrame) -> DataFrame:
    """Counters of job_sites(job_id, state, verdict), recomputed."""
    done = F.col("state") == "done"
    return sites.groupBy("job_id").agg(
        F.count("*").alias("sites_total"), F.count_if(done).alias("sites_read"), F.count_if(done & F.col("verdict").isNotNull()).alias("sites_judged"),
        F.count_if(F.col("verdict") == "match").alias("matched"), F.count_if(F.col("verdict") == "couldnt_tell").alias("unclear"),
    )


def sweep(sites: DataFrame, now, seconds: int = 600) -> DataFrame:
    """Taken sites whose lease is older than so many seconds (60 at least) go back to pending; parts of a second count, as in SQL's epoch()."""
    epoch = lambda c: F.unix_micros(c.cast("timestamp")) / F.lit(1e6)
    stale = (F.col("state") == "taken") & (epoch(F.lit(now)) - epoch(F.col("taken_at")) > max(seconds, 60))
    return sites.withColumn("state", F.when(stale, "pending").otherwise(F.col("state"))).withColumn("taken_at", F.when(~stale, F.col("taken_at")))


def claim(jobs: DataFrame, sites: DataFrame, now) -> DataFrame:
    """The oldest unleased job that has a pending site."""
    work = sites.filter("state = 'pending'").select("job_id")
    return jobs.filter(F.col("leased_until").isNull() | (F.col("leased_until") < F.lit(now))).join(work, "job_id", "left_semi").orderBy("created_at", "job_id").limit(1)


def checkpoints(reads: DataFrame, at: tuple[int, ...] = (200, 400, 800, 1600)) -> DataFrame:
    """job_id, reads, matches at the reads where a run's health is judged."""
    place = F.row_number().over(Window.partitionBy("job_id").orderBy("ordinal"))
    # a limit by rank is applied in every task before the shuffle, so a job sends no more rows than the last checkpoint needs
    run = reads.withColumn("reads", place).filter(F.col("reads") <= max(at))
    so_far = Window.partitionBy("job_id").orderBy("reads").rowsBetween(Window.unboundedPreceding, 0)
    return run.select("job_id", "reads", F.sum(F.col("matched").cast("long")).over(so_far).alias("matches")).filter(F.col("reads").isin(*at))


def contacted(log: DataFrame) -> DataFrame:
    """account_id, business_id, at, channel: whom each account has contacted, of log(account_id, business_id, at, marked, channel); at orders all entries.

    Marking twice says the same thing, so the first mark since the last unmark holds, with
    its channel (blank: null). Last unmarks are summed first, in part before they are
    shuffled, and what is left is summed again: no pair's log is gathered or sorted.
    """
    undone = log.filter(~F.col("marked")).groupBy("account_id", "business_id").agg(F.max("at").alias("_undone"))
    standing = log.filter("marked").join(undone, ["account_id", "business_id"], "left").filter(F.col("_undone").isNull() | (F.col("at") > F.col("_undone")))
    first = standing.groupBy("account_id", "business_id").agg(F.min(F.struct("at", F.nullif(F.trim("channel"), F.lit("")).alias("channel"))).alias("f"))
    return first.select("account_id", "business_id", "f.at", "f.channel")


def feedback(rows: DataFrame) -> DataFrame:
    """business_id, kind, n, accounts, latest: why matches were called wrong, of rows(account_id, business_id, at, kind); a kind that is not stated is not_a_fit."""
    kind = F.coalesce(F.nullif(F.trim("kind"), F.lit("")), F.lit("not_a_fit"))
    return rows.groupBy("business_id", kind.alias("kind")).agg(F.count("*").alias("n"), F.countDistinct("account_id").alias("accounts"), F.max("at").alias("latest"))
