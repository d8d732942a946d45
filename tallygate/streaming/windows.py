"""Pairs of games in event time: repeated deliveries, late halves and windows, with state that the watermark clears."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

from ..functions import columns
from ..operators.trials import effective_outcome

#: State of this kind needs the store that holds it on disk.
PROVIDER = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
#: Parts that the ids of a stream are dealt to; the open ids of one are in a task's memory together.
PARTS = 256


class PairUp(StatefulProcessor):
    """Games by id: the lines seen, their points and last time. Two different records make a pair, a repeated one is passed over.

    A pair is told when its second record comes, with the later of both times. State goes ``forget_ms`` after the
    last record; a half that has found no other by then is told as unpaired at that time. More than two records of an
    id are told one by one.

    A key of the state is a part of the ids, dealt by hash: one state, one timer and one call serve all ids of a part in a micro-batch.
    """

    def __init__(self, keys: list[str], forget_ms: int):
        self.keys, self.forget_ms = keys, forget_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.games = handle.getValueState("games", "records binary, timer long")

    def _read(self) -> tuple[pd.DataFrame | None, int | None]:
        known = self.games.get()
        if not known:
            return None, None
        return pa.ipc.open_stream(known[0]).read_pandas(), known[1]

    def _write(self, records: pd.DataFrame, timer: int | None) -> None:
        """The records, in order of coming, and a timer for the first id to be forgotten in place of the one before."""
        first = int(records.groupby(self.keys, sort=False, dropna=False)["ms"].max().min()) + self.forget_ms if len(records) else None
        if timer is not None and timer != first:
            self.handle.deleteTimer(timer)
        if first is None:
            self.games.clear()
            return
        if timer != first:
            self.handle.registerTimer(first)
        table, out = pa.Table.from_pandas(records, preserve_index=False), pa.BufferOutputStream()
        with pa.ipc.new_stream(out, table.schema) as stream:
            stream.write_table(table)
        self.games.update((out.getvalue().to_pybytes(), first))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        known, timer = self._read()
        came = pd.concat([f[[*self.keys, "line", "points", "ms"]] for f in rows], ignore_index=True)
        before = 0 if known is None else len(known)
        records = pd.concat([known, came], ignore_index=True) if before else came
        records = records[~records.duplicated([*self.keys, "line"])]
        of = records.groupby(self.keys, sort=False, dropna=False)
        told = records[self.keys].assign(ms=of["ms"].cummax(), bucket=of["points"].transform("first") + records["points"], k=of.cumcount())
        told = told[(told.index >= before) & (told["k"] > 0)]
        told["bucket"] = told["bucket"].where(told["k"] == 1, -1)
        self._write(records, timer)
        yield self._frame(told)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        known, timer = self._read()
        of = known.groupby(self.keys, sort=False, dropna=False)
        gone = of["ms"].transform("max") + self.forget_ms
        expired = gone <= max(timerValues.getCurrentWatermarkInMs(), expiredTimerInfo.getExpiryTimeInMs())
        told = known[self.keys].assign(ms=gone, bucket=None)[expired & (of["line"].transform("size") == 1)]
        # A timer that has fired is gone.
        self._write(known[~expired], None if timer == expiredTimerInfo.getExpiryTimeInMs() else timer)
        yield self._frame(told)

    def _frame(self, told: pd.DataFrame) -> pd.DataFrame:
        f = told[self.keys].reset_index(drop=True)
        f["completed"] = pd.to_datetime(told["ms"].to_numpy("int64"), unit="ms")
        f["bucket"] = pd.array(told["bucket"].tolist(), dtype="Int32")
        return f

    def close(self) -> None:
        pass


def _milliseconds(interval: str) -> int:
    return int(pd.Timedelta(interval).total_seconds() * 1000)


def paired_windows(stream: DataFrame, by: tuple[str, ...] = (), *, time: str = "ts", window: str = "1 day", delay: str = "1 hour", forget: str = "1 day", policy: str = "report-only") -> DataFrame:
    """(start, by, bucket_0 to bucket_4, unpaired, excess): pentanomial counts of the windows that the watermark has closed (append mode).

    ``stream`` has trial columns, ``line``, a time, and the columns of ``by``, which follow from the id. A record that comes
    more than ``delay`` after later ones is late and plays no part. Records of an id must lie within ``forget``.
    """
    points = columns.points2(effective_outcome(policy))
    ms = F.unix_millis(time)
    rows = stream.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, delay).where(F.col("id").isNotNull()).select(time, *by, "id", F.col("line").cast("long").alias("line"), points.cast("int").alias("points"), ms.alias("ms")).where("points is not null")
    keys = [*by, "id"]
    kinds = {f.name: f for f in rows.schema}
    out = StructType([kinds[k] for k in keys]).add("completed", "timestamp").add("bucket", "integer")
    part = F.pmod(F.xxhash64(*keys), F.lit(PARTS)).alias("part_of_ids")
    pairs = rows.select("*", part).groupBy("part_of_ids").transformWithStateInPandas(PairUp(keys, _milliseconds(forget)), out, "append", "EventTime", eventTimeColumnName="completed")
    bucket = F.col("bucket")
    counts = [F.count_if(bucket == b).alias(f"bucket_{b}") for b in range(5)]
    found = pairs.groupBy(F.window("completed", window), *by).agg(*counts, F.count_if(bucket.isNull()).alias("unpaired"), F.count_if(bucket < 0).alias("excess"))
    return found.select(F.col("window.start").alias("start"), *by, *(f"bucket_{b}" for b in range(5)), "unpaired", "excess")


def replay(spark: SparkSession, batches: list[DataFrame], found, folder: str) -> DataFrame:
    """What ``found``, a function of a stream, has told after the batches, each of which is written and then taken up as one micro-batch."""
    before = spark.conf.get(PROVIDER[0], None)
    spark.conf.set(*PROVIDER)
    try:
        for batch in batches:
            batch.write.mode("append").parquet(f"{folder}/in")
            stream = spark.readStream.schema(batch.schema).parquet(f"{folder}/in")
            run = found(stream).writeStream.format("parquet").option("checkpointLocation", f"{folder}/state").option("path", f"{folder}/out").outputMode("append").trigger(availableNow=True).start()
            run.awaitTermination()
    finally:
        if before is None:
            spark.conf.unset(PROVIDER[0])
        else:
            spark.conf.set(PROVIDER[0], before)
    return spark.read.parquet(f"{folder}/out")
