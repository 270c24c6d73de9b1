"""Sites of jobs that workers take, finish, give back or leave stranded: keyed state with leases and timers.

Requests come as requests(job_id, request_id, at, kind, site, n): `add` puts a site at the
end of its job's list, `take` leases the next n sites, `done` ends a lease with a result,
`release` gives a site back to the end of the list. A lease that ends without either
returns its site to the list at that very moment: before the next request of its job, or
by a timer when none comes. What happens is told as (job_id, site, at, what, until,
request_id) with what in added, taken, done, released, stranded.

A job's requests are in order of time and request_id; the stream orders those of one
trigger and drops what is later than the watermark. State is the list of waiting sites,
the leases, and the sites ever added, per job; a job whose sites are all done holds its
names only. The same step runs over a table, where it must tell the same story. Requests
with a null job, kind or time are left out; a `done` or `release` of a site that is not
leased, and a site added again, are ignored, so a repeated request changes nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

LEASE_SECONDS, LEAST_SECONDS = 120, 10
TOLD = "job_id long, site string, at timestamp, what string, until timestamp, request_id long"
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _micros(t: pd.Timestamp) -> int:
    return int(t.value // 1000)


class Job:
    """One job's sites: those waiting, in order, the ends of the leases, and all ever added."""

    def __init__(self, waiting: list[str], leases: dict[str, int], known: set[str], seconds: int):
        self.waiting, self.leases, self.known, self.length = waiting, leases, known, max(seconds, LEAST_SECONDS) * 1_000_000
        self.told: list[tuple] = []

    def tell(self, site: str, at: int, what: str, until: int | None = None, request: int | None = None) -> None:
        self.told.append((site, at, what, until, request))

    def strand(self, before: int) -> None:
        """Leases that ended before a moment give their sites back, in order of their ends."""
        for until, site in sorted((u, s) for s, u in self.leases.items() if u < before):
            del self.leases[site]
            self.waiting.append(site)
            self.tell(site, until, "stranded")

    def step(self, at: int, request: int, kind: str, site: str | None, n: int) -> None:
        self.strand(at)
        if kind == "add" and site is not None and site not in self.known:
            self.known.add(site)
            self.waiting.append(site)
            self.tell(site, at, "added", None, request)
        elif kind == "take":
            for taken in self.waiting[: max(n, 0)]:
                self.leases[taken] = at + self.length
                self.tell(taken, at, "taken", at + self.length, request)
            del self.waiting[: max(n, 0)]
        elif kind in ("done", "release") and site in self.leases:
            del self.leases[site]
            if kind == "release":
                self.waiting.append(site)
            self.tell(site, at, "done" if kind == "done" else "released", None, request)

    def run(self, requests: pd.DataFrame) -> None:
        ordered = requests.sort_values(["at", "request_id"], kind="stable")
        for at, request, kind, site, n in zip(ordered["at"], ordered["request_id"], ordered["kind"], ordered["site"], ordered["n"], strict=True):
            self.step(_micros(at), int(request), kind, None if pd.isna(site) else site, 0 if pd.isna(n) else int(n))

    def rows(self, job: int) -> pd.DataFrame:
        site, at, what, until, request = zip(*self.told, strict=True) if self.told else ((),) * 5
        plain = lambda xs: pd.Series(list(xs), dtype=object)
        moment = lambda xs: pd.Series([pd.NaT if x is None else pd.Timestamp(x, unit="us") for x in xs], dtype="datetime64[us]")
        return pd.DataFrame({"job_id": pd.Series([job] * len(site), dtype="int64"), "site": plain(site), "at": moment(at), "what": plain(what), "until": moment(until), "request_id": plain(request)})


def _usable(requests: DataFrame) -> DataFrame:
    return requests.filter("job_id is not null and kind is not null and at is not null").select("job_id", "request_id", "at", "kind", "site", "n")


def table(requests: DataFrame, until, seconds: int = LEASE_SECONDS) -> DataFrame:
    """What happened up to a moment, from all requests at once; one job is one task's work, as its steps follow each other."""
    end = pd.Timestamp(until)

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        job = Job([], {}, set(), seconds)
        job.run(pdf)
        job.strand(_micros(end))
        return job.rows(int(key[0]))

    return _usable(requests).groupBy("job_id").applyInPandas(run, TOLD)


class Leasing(StatefulProcessor):
    """The stream's side: the same steps, with what a job holds kept between triggers and a timer at the end of each lease."""

    def __init__(self, seconds: int):
        self.seconds = seconds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "site string")
        self.leases = handle.getMapState("leases", "site string", "until long")
        self.known = handle.getMapState("known", "site string", "added boolean")

    def _load(self) -> Job:
        waiting = [r[0] for r in self.waiting.get()] if self.waiting.exists() else []
        leases = {k[0]: v[0] for k, v in self.leases.iterator()} if self.leases.exists() else {}
        known = {k[0] for k in self.known.keys()} if self.known.exists() else set()
        return Job(waiting, leases, known, self.seconds)

    def _store(self, job: Job, before: Job) -> None:
        if job.waiting != before.waiting:
            self.waiting.clear()
            if job.waiting:
                self.waiting.put([(s,) for s in job.waiting])
        for s in before.leases.keys() - job.leases.keys():
            self.leases.removeKey((s,))
        for s, until in job.leases.items():
            if before.leases.get(s) != until:
                self.leases.updateValue((s,), (until,))
                self.handle.registerTimer(until // 1000 + 1)
        for s in job.known - before.known:
            self.known.updateValue((s,), (True,))

    def _told(self, key: tuple, act) -> Iterator[pd.DataFrame]:
        before = self._load()
        job = Job(list(before.waiting), dict(before.leases), set(before.known), self.seconds)
        act(job)
        self._store(job, before)
        if job.told:
            yield job.rows(int(key[0]))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        yield from self._told(key, lambda job: job.run(pd.concat(list(rows))))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        yield from self._told(key, lambda job: job.strand(expiredTimerInfo.getExpiryTimeInMs() * 1000))

    def close(self) -> None:
        pass


def stream(requests: DataFrame, late: str = "0 seconds", seconds: int = LEASE_SECONDS) -> DataFrame:
    """The same from a stream; the session's state store must be PROVIDER."""
    held = _usable(requests).withWatermark("at", late)
    return held.groupBy("job_id").transformWithStateInPandas(Leasing(seconds), TOLD, "append", "eventTime")


def outcomes(told: DataFrame) -> DataFrame:
    """job_id, added, taken, done, released, stranded, waiting, leased: where each job stands."""
    count = lambda what: F.count_if(F.col("what") == what).alias(what)
    summed = told.groupBy("job_id").agg(*[count(w) for w in ("added", "taken", "done", "released", "stranded")])
    return summed.withColumn("leased", F.col("taken") - F.col("done") - F.col("released") - F.col("stranded")).withColumn("waiting", F.col("added") - F.col("done") - F.col("leased"))
