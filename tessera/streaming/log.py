"""Extension: the event log as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.io import EVENT


def read_events(spark: SparkSession, path: str) -> DataFrame:
    """Event lines as they are appended, with ``at``, their time."""
    return spark.readStream.schema(EVENT).json(path).withColumn("at", F.try_to_timestamp("timestamp"))


def stage_latency(events: DataFrame, every: str = "1 minute", late: str = "10 minutes") -> DataFrame:
    """Per state and time window: events, failures and the sum of latencies; later rows than ``late`` are dropped."""
    window = F.window("at", every)
    return events.withWatermark("at", late).groupBy(window, "state").agg(
        F.count("*").alias("events"), F.count_if(F.col("status") != "ok").alias("failures"), F.sum(F.coalesce("latency_ms", F.lit(0))).alias("latency_ms"))


def latest(events: DataFrame, late: str = "10 minutes") -> DataFrame:
    """Each (case, state, output) once: retried stages repeat their lines."""
    return events.withWatermark("at", late).dropDuplicatesWithinWatermark(["case_id", "state", "output_ref"])


#: What the state of a stream needs: the store that holds states of several columns.
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
IN_ORDER = "case_id string, seq long, state string, line string"


def _in_order():
    """The processor of :func:`in_order`."""
    import pandas as pd
    from pyspark.sql.streaming import StatefulProcessor

    class InOrder(StatefulProcessor):
        def init(self, handle) -> None:
            self.next = handle.getValueState("next", "seq long")  # -1 once the case is closed
            self.waiting = handle.getMapState("waiting", "seq long", "state string, line string")

        def handleInputRows(self, key, rows, timerValues):
            at, out = self.next.get()[0] if self.next.exists() else 0, []
            for part in rows:
                for seq, state, line in part[["seq", "state", "line"]].itertuples(index=False):
                    if 0 <= at <= seq and not self.waiting.containsKey((int(seq),)):
                        self.waiting.updateValue((int(seq),), (state, line))
            while at >= 0 and self.waiting.containsKey((at,)):
                state, line = self.waiting.getValue((at,))
                self.waiting.removeKey((at,))
                out.append((key[0], at, state, line))
                at = -1 if state == "END" else at + 1
            if at < 0:
                self.waiting.clear()
            self.next.update((at,))
            yield pd.DataFrame(out, columns=["case_id", "seq", "state", "line"]).astype({"seq": "int64"})

        def close(self) -> None:
            pass

    return InOrder()


def in_order(events: DataFrame) -> DataFrame:
    """Events (case_id, seq, state, line) of a stream or a table in the order of their case's ``seq``, which counts from 0.

    An event waits until those before it have come; its case closes at END, and
    what comes later, or again, is dropped. Events without case_id or seq are dropped. The state
    of an open case is what waits in it, that of a closed one a number. Set
    spark.sql.streaming.stateStore.providerClass to :data:`ROCKSDB`.
    """
    rows = events.select(F.col("case_id").cast("string").alias("case_id"), F.col("seq").cast("long").alias("seq"), "state", "line").filter("case_id IS NOT NULL AND seq IS NOT NULL")
    return rows.groupBy("case_id").transformWithStateInPandas(statefulProcessor=_in_order(), outputStructType=IN_ORDER, outputMode="Append", timeMode="None")
