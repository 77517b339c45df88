"""Hashes, checksums and keys, all as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def payload_hash(payload: str | Column = "payload") -> Column:
    return F.sha2(payload, 256)


def chain_hash(event_id="event_id", hashed="payload_hash", sequence="sequence_number") -> Column:
    """What the next event of the project carries as previous_hash."""
    return F.sha2(F.concat_ws(":", event_id, hashed, F.col(sequence).cast("string")), 256)


def receipt_checksum(sequence="velocity_seq", stream="stream_id", wal="wal_sequence", event_type="event_type") -> Column:
    return F.crc32(F.concat_ws(":", F.col(sequence).cast("string"), stream, F.col(wal).cast("string"), event_type))


def tenant_partition(tenant: str | Column, partitions: int = 16) -> Column:
    """h = 33 h + code, from 5381, in 32 bits; then modulo. The hash is of the tenant's code points."""
    codes = F.filter(F.split(tenant, ""), lambda c: c != "")
    return (F.aggregate(F.transform(codes, F.ascii), F.lit(5381).cast("long"), lambda h, c: (h * 33 + c) % (1 << 32)) % partitions).cast("int")


def sortable_id(nanos: str | Column, salt: str | Column) -> Column:
    """16 hex digits of the time, then 8 characters."""
    nanos = F.col(nanos) if isinstance(nanos, str) else nanos
    return F.concat(F.lpad(F.lower(F.hex(nanos)), 16, "0"), F.substring(salt, 1, 8))


def sortable_id_time(event_id: str | Column) -> Column:
    return F.conv(F.substring(event_id, 1, 16), 16, 10).cast("long")


def document_id(nanos: str | Column, salt: str | Column) -> Column:
    nanos = F.col(nanos) if isinstance(nanos, str) else nanos
    return F.concat_ws("_", F.lit("doc"), nanos.cast("string"), F.substring(salt, 1, 8))


def namespaced_key(project, namespace, kind, name) -> Column:
    return F.concat_ws(":", project, namespace, kind, name)


def audit_action(event_type: str | Column = "event_type") -> Column:
    """Capitals, the first dot an underscore."""
    return F.upper(F.regexp_replace(event_type, r"^([^.]*)\.", "$1_"))


def index_key(value: Column) -> Column:
    return F.coalesce(value.cast("string"), F.lit("__null__"))


def backoff_ms(base: int, attempt: str | Column, most: int = 30_000) -> Column:
    attempt = F.col(attempt) if isinstance(attempt, str) else attempt
    return F.least(F.lit(base) * F.pow(F.lit(2), attempt), F.lit(most)).cast("long")


def kilobytes(size: str | Column) -> Column:
    return F.round(F.col(size) / 1024 if isinstance(size, str) else size / 1024, 2)


def micros(ts: str | Column) -> Column:
    return F.unix_micros(ts)
