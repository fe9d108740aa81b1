"""Live forms: hits as files arrive, re-indexing by file, latest states, trails and transitions."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from siltstone.functions.patterns import search_condition


def stream_search(spark: SparkSession, folder: str, schema: str, pattern: str, text: str = "text", **options) -> DataFrame:
    """A stream of the rows of arriving Parquet files whose text matches."""
    return spark.readStream.schema(schema).parquet(folder).filter(search_condition(text, pattern, **options))


def capped_sink(limit: int, out: str, order: tuple = ("path", "line_no")):
    """A foreachBatch function that appends to `out` until `limit` rows stand there, the first of a batch by those columns of `order` that it has; a batch done twice adds nothing."""

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        try:
            before = spark.read.parquet(out).filter(F.col("batch") < number).count()
        except Exception as e:  # nothing written yet
            if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
                raise
            before = 0
        if before < limit:
            by = [c for c in order if c in batch.columns]
            (batch.orderBy(*by) if by else batch).limit(limit - before).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return write


def replace_by_path(out: str, buckets: int = 16):
    """A foreachBatch function that replaces the rows of the batch's paths in a table of buckets by path; only touched buckets are rewritten."""

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        batch = batch.withColumn("bucket", F.pmod(F.xxhash64("path"), F.lit(buckets)).cast("int")).persist()
        touched = [r.bucket for r in batch.select("bucket").distinct().collect()]  # `buckets` at most
        try:
            old = spark.read.parquet(out).filter(F.col("bucket").isin(touched)).join(batch.select("path").distinct(), "path", "left_anti")
            merged = old.select(batch.columns).unionByName(batch)
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
                raise
            merged = batch
        side = f"{out}__staged"
        merged.write.mode("overwrite").parquet(side)  # the old rows are read before their buckets are replaced
        spark.read.parquet(side).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(out)
        batch.unpersist()

    return write


def latest_by_key(events: DataFrame, key: str, at: str, value: str) -> DataFrame:
    """The last value of each key so far, for update mode; age is taken where it is read."""
    return events.groupBy(key).agg(F.max_by(value, at).alias("value"), F.max(at).alias("at"))


def _steps(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState, name: str, order: list[str], item: str, changes_only: bool) -> Iterator[pd.DataFrame]:
    rows = pd.concat(list(batches)).sort_values(order)
    last = state.get[0] if state.exists else None
    before = [last, *rows[item].tolist()[:-1]]
    out = pd.DataFrame({name: key[0], "src": pd.Series(before, dtype=object).to_numpy(), "dst": rows[item].to_numpy(), order[-1]: rows[order[-1]].to_numpy()})
    state.update((rows[item].iloc[-1],))
    out = out[out["src"].notna()]
    yield out[out["src"] != out["dst"]] if changes_only else out


def stream_steps(events: DataFrame, key: str, order: list[str], item: str, changes_only: bool = False) -> DataFrame:
    """(key, src, dst, last of order): each item of a key with the one before it, across batches; the state is one item a key.

    changes_only leaves out steps to the same item (a trail); else all steps stand (transitions). Rows
    are put in order within a batch; put a watermark and a window before it where they come late.
    """
    kinds = {f.name: f.dataType.simpleString() for f in events.schema}
    out = f"`{key}` {kinds[key]}, src {kinds[item]}, dst {kinds[item]}, `{order[-1]}` {kinds[order[-1]]}"

    def step(k, batches, state):
        yield from _steps(k, batches, state, key, order, item, changes_only)

    return events.groupBy(key).applyInPandasWithState(step, out, f"last {kinds[item]}", "append", GroupStateTimeout.NoTimeout)


def stream_transitions(events: DataFrame, key: str, at: str, item: str, delay: str = "10 minutes") -> DataFrame:
    """(key, src, dst, at): each item of a key with the one before it by time, whatever order the rows come in.

    Rows wait in the state until the watermark, `delay` behind the latest row, has passed them; then they are
    put out in order of time. Rows older than that are dropped, which bounds the state.
    """
    kinds = {f.name: f.dataType.simpleString() for f in events.schema}
    out = f"`{key}` {kinds[key]}, src {kinds[item]}, dst {kinds[item]}, `{at}` {kinds[at]}"
    held = f"last {kinds[item]}, times array<bigint>, items array<{kinds[item]}>"

    def step(k, batches, state):
        last, times, items = state.get if state.exists else (None, [], [])
        waiting = list(zip(times, items, strict=True))
        for pdf in batches:
            if pdf.empty:  # a timeout brings no rows
                continue
            waiting += zip((pdf[at].astype("int64") // _unit_of(pdf[at])).tolist(), pdf[item].tolist(), strict=True)
        limit = state.getCurrentWatermarkMs()
        waiting.sort()
        ready = [w for w in waiting if w[0] // 1000 < limit]
        waiting = waiting[len(ready) :]
        steps = []
        for time, value in ready:
            if last is not None:
                steps.append((k[0], last, value, pd.Timestamp(time, unit="us")))
            last = value
        state.update((last, [w[0] for w in waiting], [w[1] for w in waiting]))
        if waiting:
            state.setTimeoutTimestamp(max(waiting[0][0] // 1000, limit) + 1)
        yield pd.DataFrame(steps, columns=[key, "src", "dst", at])

    late = events.withWatermark(at, delay)
    return late.groupBy(key).applyInPandasWithState(step, out, held, "append", GroupStateTimeout.EventTimeTimeout)


def _unit_of(times: pd.Series) -> int:
    """How many of the column's own units make a microsecond."""
    return {"ns": 1000, "us": 1}[times.dt.unit]


def stale_monitor(files: DataFrame, index: DataFrame) -> DataFrame:
    """Streaming files(path, mtime) joined with the index's (path, indexed_at): how many of a batch are newer, and the newest."""
    joined = files.join(index, "path", "left")
    return joined.filter(F.col("indexed_at").isNull() | (F.col("mtime") > F.col("indexed_at"))).groupBy().agg(F.count("*").alias("n_stale"), F.max("mtime").alias("newest"))


class _Fresh(StatefulProcessor):
    """The last value of a key: fresh when it comes, stale by a timer, and gone by its time to live."""

    def __init__(self, key: str, at: str, value: str, kinds: dict[str, str], fresh_ms: int, keep_ms: int):
        self.key, self.at, self.value, self.kinds, self.fresh_ms, self.keep_ms = key, at, value, kinds, fresh_ms, keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", f"at {self.kinds[self.at]}, value {self.kinds[self.value]}", self.keep_ms)

    def _row(self, key, at, value, fresh: bool) -> pd.DataFrame:
        return pd.DataFrame({self.key: [key[0]], "value": pd.Series([value], dtype=object), "at": [at], "fresh": [fresh]})

    def handleInputRows(self, key, rows, timerValues):
        new = pd.concat(list(rows))
        top = new.loc[new[self.at].idxmax()]
        at, value = top[self.at], top[self.value]
        if self.last.exists():
            before = self.last.get()
            if before[0] is not None and pd.Timestamp(before[0]) > at:
                at, value = pd.Timestamp(before[0]), before[1]
        self.last.update((at, value))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.fresh_ms)
        yield self._row(key, at, value, True)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        if self.last.exists():
            at, value = self.last.get()
            yield self._row(key, pd.Timestamp(at), value, False)

    def close(self) -> None:
        pass


def latest_state(events: DataFrame, key: str, at: str, value: str, fresh_ms: int = 20_000, keep_ms: int = 3_600_000) -> DataFrame:
    """(key, value, at, fresh): a row with fresh whenever a key gets events, its last one by time, and one without when fresh_ms pass and none comes.

    The state is one row a key, which leaves the store keep_ms after the key's last event; keep_ms over
    fresh_ms. An event older than the kept one renews the key but not its value. For update mode, on the RocksDB
    state store; timers run by the clock, so a row turns stale without new input.
    """
    kinds = {f.name: f.dataType.simpleString() for f in events.schema}
    out = f"`{key}` {kinds[key]}, value {kinds[value]}, at {kinds[at]}, fresh boolean"
    return events.select(key, at, value).groupBy(key).transformWithStateInPandas(_Fresh(key, at, value, kinds, fresh_ms, keep_ms), out, "Update", "processingTime")
