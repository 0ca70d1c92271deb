"""Operational state: rate limits, budgets, caches, queues and locks as tables."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Tokens a minute by class of endpoint.
LIMITS = {"ingestion": 10, "search": 60, "review": 30, "webhook": 100, "default": 120}


def micros(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp"))


def offered_load(requests: DataFrame, seconds: int, *key: str) -> DataFrame:
    """requests with `offered`: the tokens asked for in the window that ends with the request; its beginning is open."""
    w = Window.partitionBy(*key).orderBy("at").rangeBetween(-(seconds * 1_000_000 - 1), 0)
    return requests.withColumn("at", micros(F.col("ts"))).withColumn("offered", F.sum("tokens").over(w)).drop("at")


def class_limit(endpoint_class: Column) -> Column:
    """The limit of a class of endpoint, that of the default class for others."""
    out = F.lit(LIMITS["default"])
    for name, limit in LIMITS.items():
        out = F.when(endpoint_class == name, limit).otherwise(out)
    return out


#: Above this share of its limit an admitted request is warned.
WARN = 0.8


class SlidingLog:
    """The admitted requests of one key within the window, with the sum of their tokens; what is turned away isn't recorded."""

    def __init__(self, window: int, log: Iterable[tuple[int, int]] = ()):
        self._window, self.log = window, deque(log)
        self._used = sum(n for _, n in self.log)

    def ask(self, at: int, tokens: int, limit: int) -> tuple[bool, int, int, bool]:
        """Whether a request of `tokens` is admitted at `at` (microseconds), the tokens used before it, the whole seconds after which the oldest request
        leaves the window (0 if admitted, or if there is none), and whether it comes above the share that is warned of."""
        while self.log and self.log[0][0] <= at - self._window:
            self._used -= self.log.popleft()[1]
        used, ok = self._used, self._used + tokens <= limit
        if ok:
            self.log.append((at, tokens))
            self._used += tokens
        retry = 0 if ok or not self.log else (self._window - (at - self.log[0][0])) // 1_000_000
        return ok, used, retry, ok and used + tokens > WARN * limit


def rate_decisions(requests: DataFrame, seconds: int, limit: Column, *key: str, tokens: str = "tokens") -> DataFrame:
    """(key..., id, admitted, used long, retry_after int, warned): the sliding log over requests(key..., id, ts, tokens), one after the other in order of ts
    and id.

    A request is admitted if the tokens of those admitted within the last `seconds` (the beginning is open) and its own don't exceed the limit. A
    null of tokens counts 1; rows without ts are left out. A key's requests stream through one task in order, which holds no more of them than the
    window does.
    """
    rows = requests.select(*key, F.col("id").cast("long").alias("id"), micros(F.col("ts")).alias("__at"), F.coalesce(F.col(tokens), F.lit(1)).cast("long").alias("__tokens"), limit.cast("long").alias("__limit"))
    rows = rows.where("__at is not null").repartition(*key).sortWithinPartitions(*key, "__at", "id")
    names, window = [*key, "id"], seconds * 1_000_000
    types = ", ".join(f"`{n}` {rows.schema[n].dataType.simpleString()}" for n in names)

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, log = object(), None
        for batch in batches:
            columns = [batch.column(i).to_pylist() for i in range(len(key))]
            out = []
            for *own, at, n, most in zip(*columns, *(batch.column(len(key) + i).to_pylist() for i in (1, 2, 3)), strict=True):
                if own != last:
                    last, log = own, SlidingLog(window)
                out.append(log.ask(at, n, most))
            told = list(zip(*out, strict=True)) if out else [(), (), (), ()]
            kinds = (pa.bool_(), pa.int64(), pa.int32(), pa.bool_())
            yield pa.RecordBatch.from_arrays(
                [batch.column(i) for i in range(len(names))] + [pa.array(c, t) for c, t in zip(told, kinds, strict=True)], names=[*names, "admitted", "used", "retry_after", "warned"]
            )

    return rows.mapInArrow(fold, f"{types}, admitted boolean, used long, retry_after int, warned boolean")


def admissions(requests: DataFrame, seconds: int, limit: int, *key: str) -> DataFrame:
    """(key..., id, admitted): the sliding log where each request counts one."""
    return rate_decisions(requests.withColumn("__one", F.lit(1)), seconds, F.lit(limit), *key, tokens="__one").select(*key, "id", "admitted")


def usage(requests: DataFrame, now: Column, seconds: int, *key: str) -> DataFrame:
    """Tokens of the last seconds before `now`."""
    at = micros(F.col("ts"))
    return requests.where((at > micros(now) - seconds * 1_000_000) & (at <= micros(now))).groupBy(*key).agg(F.sum("tokens").alias("used"))


def daily_tokens(requests: DataFrame, budget: int, warn: float = 0.8) -> DataFrame:
    days = requests.groupBy(F.to_date("ts").cast("string").alias("day")).agg(F.sum("tokens").alias("tokens"))
    return days.withColumn("over", F.col("tokens") > budget).withColumn("warned", F.col("tokens") > warn * budget)


def monthly_tokens(requests: DataFrame) -> DataFrame:
    return requests.groupBy(F.date_format("ts", "yyyy-MM").alias("month")).agg(F.sum("tokens").alias("tokens"))


def running_tokens(requests: DataFrame) -> DataFrame:
    """Tokens of each day and of its month up to it."""
    days = requests.groupBy(F.to_date("ts").alias("d")).agg(F.sum("tokens").alias("tokens"))
    w = Window.partitionBy(F.date_format("d", "yyyy-MM")).orderBy("d")
    return days.select(F.col("d").cast("string").alias("day"), "tokens", F.sum("tokens").over(w).alias("month_to_date"))


def cache_stats(entries: DataFrame, now: Column, ttl_minutes: int, *key: str) -> DataFrame:
    """(key..., total, expired, active): an entry is expired once it is older than its time to live."""
    old = micros(now) - micros(F.col("created_at")) > ttl_minutes * 60_000_000
    return entries.groupBy(*key).agg(F.count("*").alias("total"), F.count_if(old).alias("expired"), F.count_if(~old).alias("active"))


def cache_key(*parts: Column) -> Column:
    return F.sha2(F.concat_ws(":", *parts), 256)


def queue_order(tasks: DataFrame, priority: Column, task: Column, seq: str, capacity: int = 100) -> DataFrame:
    """(task, priority, place): one entry a task id (the first), by priority and arrival, of the first `capacity` that arrived."""
    named = tasks.withColumn("task", task).withColumn("priority", priority)
    first = F.row_number().over(Window.partitionBy("task").orderBy(seq))
    once = named.withColumn("__r", first).where("__r = 1")
    held = once.orderBy(seq).limit(capacity)
    rank = F.when(F.col("priority") == "CRITICAL", 0).when(F.col("priority") == "HIGH", 1).when(F.col("priority") == "MEDIUM", 2).otherwise(3)
    return held.select("task", "priority", F.row_number().over(Window.orderBy(rank, seq)).alias("place"))


def lock_replay(asks: DataFrame, key: str, stale_seconds: int = 1800) -> DataFrame:
    """(key, id, granted): asks for a lock in order of time; one is granted if none is held, or the holder's is stale."""
    item = F.struct(micros(F.col("ts")).alias("at"), F.col("id").cast("long").alias("id"))
    grouped = asks.groupBy(key).agg(F.array_sort(F.collect_list(item)).alias("asked"))
    start = F.expr("named_struct('held', cast(null as bigint), 'out', cast(array() as array<struct<id:bigint,granted:boolean>>))")

    def step(s: Column, x: Column) -> Column:
        ok = s["held"].isNull() | (x["at"] - s["held"] >= stale_seconds * 1_000_000)
        return F.struct(F.when(ok, x["at"]).otherwise(s["held"]).alias("held"), F.array_append(s["out"], F.struct(x["id"].alias("id"), ok.alias("granted"))).alias("out"))

    done = grouped.select(key, F.explode(F.aggregate("asked", start, step)["out"]).alias("r"))
    return done.select(key, F.col("r.id").alias("id"), F.col("r.granted").alias("granted"))
