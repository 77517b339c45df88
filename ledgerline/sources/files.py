"""The log's files: JSON lines, JSON documents, and two binary segment formats."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.hashing import payload_hash
from ..schema import SEGMENT

ENVELOPE = "event_id string, project_id string, event_type string, payload_hash string, sequence_number long, timestamp timestamp, previous_hash string, metadata map<string,string>"


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines as log rows; ``payload`` stays the text that was hashed, if the line is canonical. ``corrupt`` marks lines that don't parse or whose hash differs."""
    lines = spark.read.text(path).select("value", F.from_json("value", ENVELOPE).alias("e"), F.get_json_object("value", "$.payload").alias("payload"))
    rows = lines.select("e.project_id", "e.sequence_number", "e.event_id", "e.event_type", "payload", "e.payload_hash", "e.previous_hash", F.col("e.timestamp").alias("ts"), "e.metadata", F.col("value").alias("line"))
    return rows.withColumn("corrupt", F.coalesce((payload_hash() != F.col("payload_hash")) | F.col("event_id").isNull() | F.col("sequence_number").isNull(), F.lit(True)))


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """Sound lines only."""
    return read_lines(spark, path).filter(~F.col("corrupt")).drop("corrupt", "line")


def write_lines(log: DataFrame, path: str) -> None:
    """One JSON line an event, in a folder for each project; the payload is written as it stands."""
    plain = F.to_json(F.struct("event_id", "project_id", "event_type", "payload_hash", "sequence_number", F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("timestamp"), "previous_hash"))
    line = F.concat(F.regexp_replace(plain, r"\}$", ',"payload":'), "payload", F.lit("}"))
    log.select(line.alias("value"), F.col("project_id").alias("project")).write.partitionBy("project").text(path)


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """JSON documents, one a file; ``corrupt`` has the text of bad ones."""
    schema = "id string, project_id string, collection string, content string, created_at timestamp, updated_at timestamp, version long, event_id string, corrupt string"
    return spark.read.schema(schema).option("multiLine", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "corrupt").option("recursiveFileLookup", True).json(path)


# Fixed values of the formats: magic numbers, and the little-endian headers of segments and events.
MAGIC_1, MAGIC_2, HEADER = 0x5348524B, 0x53485257, 64
EVENT_1, EVENT_2 = struct.Struct("<qqIHHII"), struct.Struct("<QQBBHII")


def decode_segment(body: bytes, version: int) -> Iterator[tuple]:
    """(position, sequence, micros, tenant, type, payload, checksum, valid) of each event; stops at a torn tail."""
    at, head = HEADER, EVENT_1 if version == 1 else EVENT_2
    while at + head.size <= len(body):
        if version == 1:
            sequence, micros, n, n_tenant, n_type, checksum, _ = head.unpack_from(body, at)
            total = n + n_tenant + n_type
            summed = body[at : at + 24] + body[at + 28 : at + head.size + total]
            n_payload = n
        else:
            sequence, micros, n_tenant, n_type, n_payload, total, checksum = head.unpack_from(body, at)
            summed = body[at : at + 24] + body[at + head.size : at + head.size + total]
        start = at + head.size
        if total <= 0 or start + total > len(body):
            return
        parts = body[start : start + total]
        yield at, sequence, micros, parts[:n_tenant].decode("utf-8", "replace"), parts[n_tenant : n_tenant + n_type].decode("utf-8", "replace"), parts[n_tenant + n_type :][:n_payload], checksum, zlib.crc32(summed) == checksum
        at = start + total


def read_segments(spark: SparkSession, path: str) -> DataFrame:
    """Events of binary segment files of either version, told by their magic numbers; other files give no rows. A segment is one task's work: files are rotated at a fixed size."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ["segment", "position", "sequence_number", "micros", "project_id", "event_type", "payload", "checksum", "valid"]
        for pdf in batches:
            for name, body in zip(pdf.path, pdf.content, strict=True):
                magic = struct.unpack_from("<I", body)[0] if len(body) >= HEADER else 0
                if magic in (MAGIC_1, MAGIC_2):
                    rows = [(name, *e) for e in decode_segment(bytes(body), 1 if magic == MAGIC_1 else 2)]
                    yield pd.DataFrame(rows, columns=names)

    raw = spark.read.format("binaryFile").load(path).select("path", "content")
    out = raw.mapInPandas(run, SEGMENT.replace("ts timestamp", "micros long"))
    return out.withColumn("ts", F.timestamp_micros("micros")).select("segment", "position", "sequence_number", "ts", "project_id", "event_type", "payload", "checksum", "valid")


SEALED = "project_id string, segment long, first_sequence long, last_sequence long, events long, bytes long, content binary"


def sealed(log: DataFrame, most_bytes: int = 64 << 20, version: int = 2) -> DataFrame:
    """The log as sealed segments, a row each with the file's bytes: a project's events in order, a new segment begun where the running size passes a multiple of ``most_bytes``. Sizes are summed by blocks of numbers, so that no project is walked by one task."""
    head = HEADER // 2
    size = F.octet_length("payload") + F.octet_length("project_id") + F.octet_length("event_type") + head
    rows = log.select("project_id", "sequence_number", F.unix_micros(F.col("ts").cast("timestamp")).alias("micros"), "event_type", F.col("payload").cast("binary").alias("payload"), size.cast("long").alias("__size"))
    rows = rows.withColumn("__block", F.floor(F.col("sequence_number") / 65_536))
    past = Window.partitionBy("project_id").orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    before = rows.groupBy("project_id", "__block").agg(F.sum("__size").alias("__sum")).select("project_id", "__block", F.coalesce(F.sum("__sum").over(past), F.lit(0)).alias("__before"))
    own = Window.partitionBy("project_id", "__block").orderBy("sequence_number").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.join(before, ["project_id", "__block"]).withColumn("__at", F.col("__before") + F.coalesce(F.sum("__size").over(own), F.lit(0)))
    rows = rows.withColumn("segment", F.floor(F.col("__at") / most_bytes)).drop("__block", "__before", "__at", "__size")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("sequence_number")
        events = list(zip(pdf.sequence_number, pdf.micros, pdf.project_id, pdf.event_type, pdf.payload, strict=True))
        body = encode_segment([(int(a), int(b), c, d, bytes(e)) for a, b, c, d, e in events], version)
        return pd.DataFrame([(events[0][2], int(pdf.segment.iloc[0]), int(events[0][0]), int(events[-1][0]), len(events), len(body), body)], columns=["project_id", "segment", "first_sequence", "last_sequence", "events", "bytes", "content"])

    return rows.groupBy("project_id", "segment").applyInPandas(run, SEALED)


def write_segments(log: DataFrame, path: str, most_bytes: int = 64 << 20, version: int = 2) -> None:
    """Sealed segments as a Parquet table of blobs by project; ``read_sealed`` decodes them."""
    sealed(log, most_bytes, version).write.partitionBy("project_id").mode("append").parquet(path)


def read_sealed(segments: DataFrame, from_sequence: int = 0, to_sequence: int | None = None, types: list[str] | None = None, limit: int = 0) -> DataFrame:
    """Events of sealed segments that pass the filters; segments outside the range aren't decoded."""
    segments = segments.filter(F.col("last_sequence") >= from_sequence)
    if to_sequence is not None:
        segments = segments.filter(F.col("first_sequence") <= to_sequence)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for body in pdf.content:
                rows = [e for e in decode_segment(bytes(body), version_of(bytes(body))) if e[-1]]
                yield pd.DataFrame([(e[3], e[1], e[2], e[4], e[5].decode("utf-8", "replace")) for e in rows], columns=["project_id", "sequence_number", "micros", "event_type", "payload"])

    out = segments.select("content").mapInPandas(run, "project_id string, sequence_number long, micros long, event_type string, payload string")
    out = out.filter(F.col("sequence_number") >= from_sequence)
    out = out if to_sequence is None else out.filter(F.col("sequence_number") <= to_sequence)
    out = out.filter(F.col("event_type").isin(*types)) if types else out
    out = out.withColumn("ts", F.timestamp_micros("micros")).drop("micros")
    return out.orderBy("project_id", "sequence_number").limit(limit) if limit else out


def version_of(body: bytes) -> int:
    """1 or 2 by a segment's magic number."""
    return 1 if struct.unpack_from("<I", body)[0] == MAGIC_1 else 2


def encode_segment(events: list[tuple], version: int = 2) -> bytes:
    """A sealed segment of (sequence, micros, tenant, type, payload) rows."""
    out = []
    for sequence, micros, tenant, kind, payload in events:
        a, b = tenant.encode(), kind.encode()
        body, total = a + b + payload, len(a) + len(b) + len(payload)
        if version == 1:
            head = struct.pack("<qqIHH", sequence, micros, len(payload), len(a), len(b))
            out.append(head + struct.pack("<II", zlib.crc32(head + struct.pack("<I", 0) + body), 0) + body)
        else:
            head = struct.pack("<QQBBHI", sequence, micros, len(a), len(b), len(payload), total)
            out.append(head + struct.pack("<I", zlib.crc32(head + body)) + body)
    first, last = (events[0][0], events[-1][0]) if events else (0, 0)
    head = struct.pack("<IIqqqqqq", MAGIC_1 if version == 1 else MAGIC_2, version, 0, first, last, len(events), 0, 0)
    return (head + struct.pack("<I", zlib.crc32(head))).ljust(HEADER, b"\0") + b"".join(out)
