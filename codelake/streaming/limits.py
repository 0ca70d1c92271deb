"""Structured Streaming forms of the operational operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.ops import SlidingLog


_DECISIONS = "installation long, endpoint string, id long, admitted boolean, used long, retry_after int, warned boolean"


def rate_decision_stream(requests: DataFrame, seconds: int, limits: dict[str, int], delay: str = "5 minutes") -> DataFrame:
    """(installation, endpoint, id, admitted, used, retry_after, warned) of a stream of requests(installation, endpoint, id, ts, tokens): the decisions of
    ops.rate_decisions, with the limit of each endpoint (its class) in limits, which has "default".

    The state of a key is the log of what it was admitted within the window; it is dropped once the watermark, `delay` behind the latest request,
    is two windows past it. Requests of one batch are taken in order of ts and id; one that comes in a later batch than a younger one of its key
    is taken at the time of the latest decision of the key.
    """

    def decide(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        held, now = state.get if state.exists else ([], 0)
        log = SlidingLog(seconds * 1_000_000, [(r["at"], r["tokens"]) if isinstance(r, dict) else tuple(r) for r in held])
        rows = pd.concat(list(batches))
        rows = rows.assign(at=rows["ts"].astype("int64") // {"ns": 1000, "us": 1}[rows["ts"].dt.unit]).sort_values(["at", "id"])
        limit, out = limits.get(key[1], limits["default"]), []
        for at, id_, tokens in zip(rows["at"].tolist(), rows["id"].tolist(), rows["tokens"].fillna(1).astype("int64").tolist(), strict=True):
            now = max(now, at)
            out.append((*key, id_, *log.ask(now, tokens, limit)))
        state.update(([{"at": at, "tokens": n} for at, n in log.log], now))
        state.setTimeoutTimestamp(max(state.getCurrentWatermarkMs(), now // 1000) + 2 * seconds * 1000)
        yield pd.DataFrame(out, columns=[c.split(" ")[0] for c in _DECISIONS.split(", ")])

    keyed = requests.withWatermark("ts", delay).groupBy("installation", "endpoint")
    return keyed.applyInPandasWithState(decide, _DECISIONS, "log array<struct<at:long,tokens:long>>, now long", "append", GroupStateTimeout.EventTimeTimeout)


def admission_stream(requests: DataFrame, seconds: int, limit: int, delay: str = "5 minutes") -> DataFrame:
    """(installation, endpoint, id, admitted) of a stream of requests(installation, endpoint, id, ts), each of which counts one."""
    counted = requests.select("installation", "endpoint", "id", "ts", F.lit(1).cast("long").alias("tokens"))
    return rate_decision_stream(counted, seconds, {"default": limit}, delay).select("installation", "endpoint", "id", "admitted")


def offered_load_stream(requests: DataFrame, window: str = "1 minute", delay: str = "5 minutes") -> DataFrame:
    """Tokens of each key and window; late requests count until the watermark passes them."""
    counted = requests.withWatermark("ts", delay).groupBy(F.window("ts", window), "installation", "endpoint").agg(F.sum("tokens").alias("tokens"))
    return counted.select(F.col("window.start").alias("start"), "installation", "endpoint", "tokens")


def fresh_entries(entries: DataFrame, key: str, delay: str = "120 minutes") -> DataFrame:
    """Cache entries without those whose key came before within its time to live."""
    return entries.withWatermark("created_at", delay).dropDuplicatesWithinWatermark([key])


def ingest_stream(files: DataFrame, apply: Callable[[DataFrame, int], None], checkpoint: str, available_now: bool = False):
    """Starts a query that hands each micro-batch of files(repo_id, file, language, content, deleted) to apply(batch, id), such as Engine.apply.

    A batch that is tried again after a failure comes with the same rows; as apply replaces by file and commits once, that changes nothing.
    available_now ends the query with what is there.
    """
    writer = files.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
