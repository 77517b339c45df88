"""The delivery bridge as a stateful stream: each stream's last crossed number is its state."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.query import StreamingQuery

from ..functions.hashing import receipt_checksum

OUTPUT = "stream_id string, velocity_seq long, event_type string, payload string, status string"


class Gate(StatefulProcessor):
    """accepted, transient, duplicate (accepted before), reorder (before the first that was accepted) or gap, in the order of numbers within a micro-batch."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "first long, crossed long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        state = self.last.get()
        first, last = state or (0, 0)
        batch = pd.concat(list(rows)).sort_values("velocity_seq", kind="stable")
        status = []
        for seq, real in zip(batch.velocity_seq, batch.irreversibility_marker, strict=True):
            if not real or seq <= 0:
                status.append("transient")
            elif last and seq <= last:
                status.append("duplicate" if seq >= first else "reorder")
            elif last and seq != last + 1:
                status.append("gap")
            else:
                first, last = first or int(seq), int(seq)
                status.append("accepted")
        self.last.update((first, last))
        yield batch.assign(status=status)[["stream_id", "velocity_seq", "event_type", "payload", "status"]]

    def close(self) -> None:
        pass


def gated(events: DataFrame) -> DataFrame:
    """A streaming frame (stream_id, velocity_seq, irreversibility_marker, event_type, payload) with each row's status. Needs the RocksDB state store provider."""
    return events.groupBy("stream_id").transformWithStateInPandas(Gate(), OUTPUT, "append", "none")


def deliver(events: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str, receipts: str) -> StreamingQuery:
    """Accepted rows go to ``write(frame, batch)`` and, as receipts, to a Parquet table by batch: a batch that is run again after a crash overwrites its own part, so each number is delivered once if ``write`` overwrites by batch too."""

    def each(batch: DataFrame, number: int) -> None:
        good = batch.filter("status = 'accepted'").persist()
        write(good, number)
        rows = good.withColumn("wal_sequence", F.col("velocity_seq"))
        rows.select("stream_id", "velocity_seq", "wal_sequence", "event_type", receipt_checksum().alias("checksum")).write.mode("overwrite").parquet(f"{receipts}/batch={number}")
        good.unpersist()

    return gated(events).writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def registry(receipts: DataFrame) -> DataFrame:
    """The receipts of a ``deliver`` folder that hold: sound by their checksum, and each number once, by its first log sequence. What a compaction would keep."""
    sound = receipts.filter(receipt_checksum() == F.col("checksum"))
    return sound.groupBy("stream_id", "velocity_seq").agg(F.min_by(F.struct("wal_sequence", "event_type", "checksum"), "wal_sequence").alias("r")).select("stream_id", "velocity_seq", "r.*")


def deduplicated(events: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """Each (stream_id, velocity_seq) once within the watermark."""
    return events.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["stream_id", "velocity_seq"])
