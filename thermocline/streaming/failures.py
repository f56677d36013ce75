"""Consecutive failures per service over a stream.

Tasks reduce their rows to one per service first: what happened before a service's last success needs no place of its
own any more.  The rest meets keyed state, by buckets of services, as a call and a look at the state cost milliseconds each
and a batch may touch very many services.  Failures older than the watermark are settled into a number and a first time,
as no success before them can arrive; so a service's state is a few numbers and the failures within the watermark,
however many batches there were.  Deliveries that repeat an event within the watermark count once, later ones are late.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from .activity import deduplicated

STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
STATE = ", ".join(f"{c} array<bigint>" for c in ("version", "events", "failures", "last_event", "ok_at", "ok_id", "settled", "settled_since",
                                                 "open_at", "open_id", "open_number"))  # an entry per service, or per open failure in their order
BUCKETS = 1024  # of services; fixed, as the state on disk is kept by it
WHOLE = ("tinyint", "smallint", "int", "bigint")
NEVER = -(1 << 62)


def _reduced(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows of a column batch to one per service: counts, the last success and the failures after it."""
    for batch in batches:
        rows = batch.sort_values(["at", "event_id"], kind="stable")
        ok = ~rows["failed"]
        after = ok[::-1].groupby(rows["service"][::-1], dropna=False).cumsum()[::-1]
        rows = rows.assign(ok_at=rows["at"].where(ok, NEVER), ok_id=rows["event_id"].where(ok, NEVER), open=rows["failed"] & (after == 0))
        groups = rows.groupby("service", dropna=False, sort=False)
        out = groups.agg(events=("at", "size"), failures=("failed", "sum"), last_event=("at", "max"), ok_at=("ok_at", "max"))
        last = rows[ok].groupby("service", dropna=False)["event_id"].last()
        out["ok_id"] = last.reindex(out.index).fillna(NEVER).astype("int64")
        here = rows["open"].to_numpy()
        of = groups.ngroup().to_numpy()[here]
        order, cuts = np.argsort(of, kind="stable"), np.cumsum(np.bincount(of, minlength=len(out)))[:-1]
        for name, source in (("open_at", "at"), ("open_id", "event_id")):
            out[name] = pd.Series(np.split(rows[source].to_numpy()[here][order], cuts), index=out.index, dtype=object)
        yield out.reset_index()


class Runs(StatefulProcessor):
    """Merges partial rows of the services of a bucket into its state and hands on where those services stand."""

    def __init__(self, service: str = "string"):
        self.service = service

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("runs", f"{STATE}, service array<{self.service}>")

    def _names(self, column: pd.Series) -> list:
        whole = int if self.service in WHOLE else lambda x: x  # a null makes floats of them
        return [None if pd.isna(x) else whole(x) for x in column.tolist()]

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        *held, names = self.state.get() or [[] for _ in range(12)]
        version, events, failures, last, ok_at, ok_id, settled, since, at, ids, number = (np.array(x, np.int64) for x in held)
        parts, before = pd.concat(list(rows)), len(names)
        of, names = pd.factorize(np.array([*names, *self._names(parts["service"])], dtype=object), use_na_sentinel=False)
        of, n = of[before:], len(names)  # those held come first, in their order
        names = [None if pd.isna(x) else x for x in names]  # a missing one comes back as NaN
        more = lambda x, value=0: np.append(x, np.full(n - before, value, np.int64))
        version, events, failures, settled = more(version), more(events), more(failures), more(settled)
        last, ok_at, ok_id, since = (more(x, NEVER) for x in (last, ok_at, ok_id, since))
        touched = np.unique(of)
        version[touched] += 1
        np.add.at(events, of, parts["events"].to_numpy())
        np.add.at(failures, of, parts["failures"].to_numpy())
        np.maximum.at(last, of, parts["last_event"].to_numpy())
        all_of, all_at, all_id = np.append(np.arange(n), of), np.append(ok_at, parts["ok_at"].to_numpy()), np.append(ok_id, parts["ok_id"].to_numpy())
        order = np.lexsort((all_id, all_at, all_of))
        newest = order[np.searchsorted(all_of[order], np.arange(n), side="right") - 1]
        newer = newest >= n  # whatever was settled is older than any success that can still arrive
        newer &= (all_at[newest] != ok_at) | (all_id[newest] != ok_id)
        settled[newer], since[newer] = 0, NEVER
        ok_at, ok_id = all_at[newest], all_id[newest]
        at = np.concatenate([at, *[np.array(x, np.int64) for x in parts["open_at"]]])
        ids = np.concatenate([ids, *[np.array(x, np.int64) for x in parts["open_id"]]])
        open_of = np.append(np.repeat(np.arange(before), number), np.repeat(of, [len(x) for x in parts["open_at"]]))
        later = (at > ok_at[open_of]) | ((at == ok_at[open_of]) & (ids > ok_id[open_of]))
        at, ids, open_of = at[later], ids[later], open_of[later]
        old = at < timerValues.getCurrentWatermarkInMs() * 1000
        first = np.where(settled > 0, since, -NEVER)
        np.minimum.at(first, open_of[old], at[old])
        settled += np.bincount(open_of[old], minlength=n)
        since = np.where(settled > 0, first, NEVER)
        np.minimum.at(first, open_of, at)
        at, ids, open_of = at[~old], ids[~old], open_of[~old]
        order = np.argsort(open_of, kind="stable")
        number = np.bincount(open_of, minlength=n)
        self.state.update((*(x.tolist() for x in (version, events, failures, last, ok_at, ok_id, settled, since, at[order], ids[order], number)), names))
        failing = settled + number
        yield pd.DataFrame({"service": pd.Series([names[i] for i in touched], dtype=object), "version": version[touched], "events": events[touched],
                            "failures": failures[touched], "last_event": last[touched], "consecutive_failures": failing[touched],
                            "failing_since": pd.Series(first[touched], dtype="Int64").mask(failing[touched] == 0)})

    def close(self) -> None:
        pass


def followed(events: DataFrame, failed: Column, delay: str = "1 hour") -> DataFrame:
    """A row per service and micro-batch with events: service, version, events, failures, last_event, consecutive_failures, failing_since.

    ``events`` is a stream of service, ts, event_id and what ``failed`` asks for.  Rows later than ``delay`` behind the newest are left
    out; within it, order and repeats of deliveries don't matter.
    """
    kind = events.schema["service"].dataType.simpleString()
    marked = deduplicated(events, delay=delay).select("service", F.unix_micros("ts").alias("at"), "event_id", F.coalesce(failed, F.lit(False)).alias("failed"))
    parts = marked.mapInPandas(_reduced, f"service {kind}, events bigint, failures bigint, last_event bigint, ok_at bigint, ok_id bigint, "
                                         "open_at array<bigint>, open_id array<bigint>")
    states = parts.withColumn("bucket", F.pmod(F.xxhash64("service"), F.lit(BUCKETS))).groupBy("bucket").transformWithStateInPandas(
        Runs(kind), f"service {kind}, version bigint, events bigint, failures bigint, last_event bigint, consecutive_failures bigint, failing_since bigint",
        "Append", "EventTime")
    time = lambda c: F.timestamp_micros(c).cast("timestamp_ntz").alias(c)
    return states.select("service", "version", "events", "failures", time("last_event"), "consecutive_failures", time("failing_since"))


def run(events: DataFrame, failed: Column, sink: str, checkpoint: str, delay: str = "1 hour", **trigger) -> StreamingQuery:
    """Follow a stream; ``current`` reads where each service stands.  Keyed state needs the store that keeps it on disk."""
    spark = events.sparkSession
    before = spark.conf.get(STORE)
    spark.conf.set(STORE, ROCKS)
    try:
        writer = followed(events, failed, delay).writeStream.format("parquet").option("path", sink).option("checkpointLocation", checkpoint)
        return writer.outputMode("append").trigger(**(trigger or {"availableNow": True})).start()
    finally:
        spark.conf.set(STORE, before)


def current(spark: SparkSession, sink: str) -> DataFrame:
    """The newest row of each service."""
    rows = spark.read.parquet(sink)
    newest = rows.groupBy("service").agg(F.max("version").alias("version"))
    return rows.join(newest, [rows["service"].eqNullSafe(newest["service"]), rows["version"] == newest["version"]], "left_semi").drop("version")
