"""The registered queries over the driver's tables and their SQL twins for DuckDB."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import hashing
from ..functions.values import Field
from ..operators import aggregate, delivery, find, log, ordered
from ..functions import canonical
from ..sources import files
from ..storage import shared_dir
from ..streaming import bridge
from . import adapter, folds, snapshots, store, views
from .adapter import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

LOG = """log AS (
  SELECT 'tenant-' || (user_id % 4) AS project_id, row_number() OVER (PARTITION BY user_id % 4 ORDER BY event_id) AS sequence_number,
         CAST(event_id AS VARCHAR) AS event_id, event_type, user_id, value, props AS payload, sha256(props) AS payload_hash, ts FROM events)"""
CRUD = LOG + """, crud AS (
  SELECT project_id, CAST(user_id AS VARCHAR) AS id, sequence_number AS s, ts, payload, event_id,
         CASE event_type WHEN 'signup' THEN 'c' WHEN 'purchase' THEN 'u' WHEN 'click' THEN 'u' WHEN 'error' THEN 'd' END AS k
  FROM log WHERE event_type IN ('signup', 'purchase', 'click', 'error'))"""
CUSTOMERS = """cust AS (
  SELECT c_custkey AS id, c_name AS name, c_acctbal AS balance, c_nationkey AS nation, CASE WHEN c_nationkey % 3 <> 0 THEN c_mktsegment END AS segment FROM customer)"""
DELIVERIES = """e AS (SELECT 'stream-' || (user_id % 8) AS stream_id, event_id AS velocity_seq, event_type FROM events),
r AS (SELECT *, velocity_seq * 2 AS wal_sequence FROM e WHERE velocity_seq % 4 <> 0)"""
STREAM = LOG + """, m AS (SELECT project_id, event_type AS stream, sequence_number AS "offset", ts, value FROM log),
commits AS (SELECT project_id, event_type AS stream, 'group-' || (user_id % 3) AS consumer_group, sequence_number AS "offset" FROM log WHERE sequence_number % 50 = 0)"""


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


# --- reading the log


@query(f"WITH {LOG} SELECT project_id, sequence_number, event_type, payload FROM log WHERE project_id = 'tenant-1' AND sequence_number >= 50")
def log_read_from(spark, d):
    return log.read_events(adapter.log(spark, d), "tenant-1", 50).select("project_id", "sequence_number", "event_type", "payload")


@query(f"WITH {LOG} SELECT sequence_number, event_type, payload FROM log WHERE project_id = 'tenant-2' AND sequence_number >= 10 ORDER BY sequence_number LIMIT 20")
def log_tail_limit(spark, d):
    return log.read_events(adapter.log(spark, d), "tenant-2", 10, limit=20).select("sequence_number", "event_type", "payload")


@query(f"WITH {LOG} SELECT project_id, sequence_number, event_type FROM log WHERE event_type IN ('purchase', 'error') AND sequence_number BETWEEN 100 AND 900")
def log_filter_types(spark, d):
    return log.read_events(adapter.log(spark, d), None, 100, 900, ["purchase", "error"]).select("project_id", "sequence_number", "event_type")


@query(f"WITH {LOG} SELECT project_id, max(sequence_number) AS head, count(*) AS events FROM log GROUP BY project_id")
def log_heads(spark, d):
    return log.heads(adapter.log(spark, d))


@query(f"WITH {LOG} SELECT project_id, sequence_number, event_id, event_type FROM log QUALIFY row_number() OVER (PARTITION BY project_id ORDER BY sequence_number DESC) = 1")
def log_last_event(spark, d):
    return log.last_events(adapter.log(spark, d)).select("project_id", "sequence_number", "event_id", "event_type")


@query("SELECT count(*) AS events FROM events")
def log_count(spark, d):
    return table(spark, d, "events").agg(F.count("*").alias("events"))


@query(f"WITH {LOG} SELECT project_id, CAST((sequence_number - 1) // 500 AS BIGINT) AS segment, min(sequence_number) AS first_sequence, max(sequence_number) AS last_sequence, count(*) AS events FROM log GROUP BY ALL")
def log_segments(spark, d):
    rows = adapter.log(spark, d).withColumn("segment", F.expr("(sequence_number - 1) div 500"))
    out = log.segments(rows, F.struct("project_id", "segment"))
    return out.select("segment.project_id", "segment.segment", "first_sequence", "last_sequence", "events")


#: CRC-32 of ``text``, bit by bit, since DuckDB has none.
CRC = """CAST(xor(list_reduce(list_prepend(CAST(4294967295 AS UBIGINT), list_transform(regexp_extract_all(hex(encode(text)), '..'), lambda x: CAST(('0x' || x) AS UBIGINT))),
    lambda a, b: list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda v, z: xor(v >> 1, (v & 1) * CAST(3988292384 AS UBIGINT)))), CAST(4294967295 AS UBIGINT)) AS BIGINT)"""


@query(f"""WITH {LOG}, c AS (SELECT text, {CRC} AS crc FROM (SELECT DISTINCT payload AS text FROM log))
SELECT project_id || ':' || ((sequence_number - 1) // 500) AS segment, min(sequence_number) AS first_sequence, max(sequence_number) AS last_sequence, count(*) AS events, bit_xor(crc) AS checksum
FROM log JOIN c ON payload = text GROUP BY 1""")
def log_segment_checksums(spark, d):
    return log.segments(adapter.log(spark, d), F.expr("concat(project_id, ':', (sequence_number - 1) div 500)"))


@query(f"""WITH {LOG}, p AS (SELECT *, sha256(event_id || ':' || payload_hash || ':' || sequence_number) AS h FROM log)
SELECT project_id, sequence_number, payload_hash, lag(h) OVER (PARTITION BY project_id ORDER BY sequence_number) AS previous_hash FROM p""")
def log_append(spark, d):
    """The later half appended to the earlier one gives the whole log again."""
    whole = adapter.chained(spark, d)
    new = whole.filter("sequence_number > 1000").select("project_id", "event_type", "payload", F.col("ts").cast("timestamp").alias("ts"), F.col("sequence_number").alias("arrival"), "event_id")
    old = whole.filter("sequence_number <= 1000").withColumn("ts", F.col("ts").cast("timestamp"))
    names = ["project_id", "sequence_number", "payload_hash", "previous_hash"]
    return old.select(names).unionByName(log.append(old, new).select(names))


# --- integrity


@query(f"WITH {LOG} SELECT project_id, sequence_number, payload_hash FROM log")
def payload_hash(spark, d):
    return adapter.log(spark, d).select("project_id", "sequence_number", hashing.payload_hash().alias("payload_hash"))


@query(f"""WITH {LOG}, p AS (SELECT *, sha256(event_id || ':' || payload_hash || ':' || sequence_number) AS h FROM log)
SELECT project_id, sequence_number, h AS chain_hash, lag(h) OVER (PARTITION BY project_id ORDER BY sequence_number) AS previous_hash FROM p""")
def hash_chain(spark, d):
    return adapter.chained(spark, d).select("project_id", "sequence_number", hashing.chain_hash().alias("chain_hash"), "previous_hash")


@query(f"""WITH {LOG}, p AS (SELECT *, lag(sequence_number) OVER (PARTITION BY project_id ORDER BY sequence_number) AS previous_sequence FROM log WHERE sequence_number % 37 <> 0)
SELECT project_id, sequence_number, previous_sequence FROM p WHERE sequence_number <> previous_sequence + 1""")
def sequence_gaps(spark, d):
    torn = adapter.chained(spark, d).filter("sequence_number % 37 <> 0")
    return log.chain(torn).filter("gap").select("project_id", "sequence_number", "previous_sequence")


@query(f"""WITH {LOG}, p AS (SELECT *, lag(sequence_number) OVER (PARTITION BY project_id ORDER BY sequence_number) AS q FROM log WHERE sequence_number % 37 <> 0)
SELECT project_id, count(*) AS events, CAST(count_if(sequence_number % 100 = 50) AS BIGINT) AS bad_hashes, CAST(count_if(sequence_number <> q + 1) AS BIGINT) AS gaps,
       CAST(count_if(sequence_number <> q + 1) AS BIGINT) AS broken, FALSE AS ok FROM p GROUP BY project_id""")
def verify_summary(spark, d):
    torn = adapter.chained(spark, d).filter("sequence_number % 37 <> 0")
    torn = torn.withColumn("payload", F.when(F.col("sequence_number") % 100 == 50, F.concat("payload", F.lit(" "))).otherwise(F.col("payload")))
    return log.verification(torn)


@query(f"""WITH {LOG}, f AS (SELECT project_id, min(sequence_number) AS bad FROM log WHERE sequence_number % 400 = 399 GROUP BY project_id)
SELECT project_id, count(*) AS kept FROM log LEFT JOIN f USING (project_id) WHERE bad IS NULL OR sequence_number < bad GROUP BY project_id""")
def recover_prefix(spark, d):
    rows = adapter.log(spark, d)
    return log.sound_prefix(rows, "sequence_number", F.col("sequence_number") % 400 == 399).groupBy("project_id").agg(F.count("*").alias("kept"))


@query(f"""WITH {LOG}, a AS (SELECT project_id, sequence_number, payload_hash FROM log), b AS (SELECT * FROM a WHERE sequence_number % 500 <> 7)
SELECT *, 1 AS only_in FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM b)""")
def replay_except(spark, d):
    one = adapter.log(spark, d).select("project_id", "sequence_number", "payload_hash")
    return log.same_replays(one, one.filter("sequence_number % 500 <> 7"))


@query(f"""WITH {LOG}, h AS (SELECT project_id, sha256('{{"payload":"' || replace(payload, '"', '\\"') || '","project_id":"' || project_id || '","sequence_number":' || sequence_number || '}}') AS h FROM log)
SELECT project_id, count(*) AS "rows", sha256(concat_ws(':', count(*), sum(CAST('0x' || substr(h, 1, 15) AS UBIGINT)), sum(CAST('0x' || substr(h, 16, 15) AS UBIGINT)))) AS state_hash FROM h GROUP BY project_id""")
def replay_state_hash(spark, d):
    return log.state_hash(adapter.log(spark, d).select("project_id", "sequence_number", "payload"), ["project_id"])


@query(f"""WITH {LOG}, f AS (SELECT project_id, unnest([CASE WHEN sequence_number % 50 = 0 THEN 'event_type' END, CASE WHEN sequence_number % 70 = 0 THEN 'payload' END, CASE WHEN sequence_number % 70 = 0 OR sequence_number % 90 = 0 THEN 'payload_hash' END]) AS fault FROM log)
SELECT project_id, fault, count(*) AS events FROM f WHERE fault IS NOT NULL GROUP BY ALL""")
def validate_events(spark, d):
    at = F.col("sequence_number")
    torn = adapter.log(spark, d).withColumns({
        "event_type": F.when(at % 50 == 0, "two words").otherwise(F.col("event_type")),
        "payload": F.when(at % 70 == 0, F.lit("{")).otherwise(F.col("payload")),
        "payload_hash": F.when(at % 90 == 0, F.lit("0")).otherwise(F.col("payload_hash")),
    })
    return log.faults(torn).select("project_id", F.explode("faults").alias("fault")).groupBy("project_id", "fault").agg(F.count("*").alias("events"))


# --- predicates, order and paging


def found(*conditions):
    def run(spark, d):
        rows = adapter.customers(spark, d)
        for c in conditions:
            rows = rows.filter(find.where(*c))
        return rows.select("id")

    return run


for name, conditions, sql in (
    ("find_eq", [("segment", "eq", "BUILDING")], "segment = 'BUILDING'"),
    ("find_ne_missing", [("segment", "ne", "BUILDING")], "segment IS DISTINCT FROM 'BUILDING'"),
    ("find_range", [("account.balance", "gte", 1000), ("account.balance", "lt", 5000)], "balance >= 1000 AND balance < 5000"),
    ("find_range_of_text", [("name", "gt", 5)], "FALSE"),
    ("find_in", [("account.nation", "in", [1, 2, 17])], "nation IN (1, 2, 17)"),
    ("find_nested_path", [("data.account.nation", "eq", 7)], "nation = 7"),
    ("find_number_is_no_text", [("account.nation", "eq", "7")], "FALSE"),
    ("find_by_id", [("id", "eq", 42)], "id = 42"),
):
    QUERIES[name] = found(*conditions)
    ORACLES[name] = f"WITH {CUSTOMERS} SELECT id FROM cust WHERE {sql}"


@query(f"WITH {CUSTOMERS} SELECT id, balance FROM cust WHERE balance > 500 ORDER BY balance DESC, id LIMIT 100")
def find_topk(spark, d):
    q = find.Query(adapter.customers(spark, d)).where("account.balance", "gt", 500).order_by("account.balance", "desc").limit(100)
    return q.rows().select("id", Field("data", "account.balance").number.alias("balance"))


@query(f"WITH {CUSTOMERS} SELECT id, segment FROM cust ORDER BY segment ASC NULLS FIRST, id LIMIT 40 OFFSET 480")
def find_sorted_page(spark, d):
    return find.Query(adapter.customers(spark, d)).order_by("segment").offset(480).limit(40).rows().select("id", Field("data", "segment").string.alias("segment"))


@query(f"WITH {CUSTOMERS} SELECT count(*) AS total, least(greatest(count(*) - 30, 0), 50) AS returned, least(greatest(count(*) - 30, 0), 50) + 30 < count(*) AS has_more FROM cust WHERE nation = 3")
def page_total_has_more(spark, d):
    return find.page_info(find.Query(adapter.customers(spark, d)).where("account.nation", "eq", 3).df, 30, 50)


@query("SELECT doc_id FROM documents WHERE source = 'src1' AND lang = 'en'")
def documents_by_fields(spark, d):
    docs = table(spark, d, "documents").select(F.lit("p").alias("project_id"), F.col("doc_id").alias("id"), F.col("source").alias("collection"), F.to_json(F.struct("lang", "n_chars")).alias("content"))
    return find.by_fields(docs, "p", {"lang": "en"}, "src1").select(F.col("id").alias("doc_id"))


@query("SELECT DISTINCT source AS collection FROM documents")
def distinct_collections(spark, d):
    return table(spark, d, "documents").select(F.col("source").alias("collection")).distinct()


@query("SELECT c_custkey FROM customer WHERE contains(lower(c_name), 'r#0000000')")
def cache_key_contains(spark, d):
    return table(spark, d, "customer").filter(F.lower("c_name").contains("r#0000000")).select("c_custkey")


# --- aggregates

for kind, sql in (
    ("count", "CAST(count(*) AS DOUBLE)"),
    ("sum", "round(coalesce(sum(balance), 0), 4)"),
    ("min", "coalesce(min(balance), 0)"),
    ("max", "coalesce(max(balance), 0)"),
    ("avg", "round(sum(balance) / count(*), 6)"),
):

    def run(spark, d, kind=kind):
        out = find.Query(adapter.customers(spark, d)).where("account.nation", "lte", 12).aggregate(kind, "account.balance")
        return out.select(F.round("value", {"sum": 4}.get(kind, 6)).alias("value"))

    QUERIES[f"agg_{kind}"] = run
    ORACLES[f"agg_{kind}"] = f"WITH {CUSTOMERS} SELECT {sql} AS value FROM cust WHERE nation <= 12"


@query(f"WITH {CUSTOMERS} SELECT CAST('Infinity' AS DOUBLE) AS lowest, CAST('-Infinity' AS DOUBLE) AS highest, CAST(0 AS DOUBLE) AS mean FROM cust LIMIT 1")
def agg_without_numbers(spark, d):
    number = Field("data", "name").number
    return adapter.customers(spark, d).agg(*(aggregate.aggregate_column(k, number).alias(n) for k, n in (("min", "lowest"), ("max", "highest"), ("avg", "mean"))))


@query("""WITH s AS (SELECT list_sort(list(value)) AS v FROM events), p AS (SELECT unnest([0.5, 0.95, 0.99, 1.0]) AS share)
SELECT CAST(share AS DOUBLE) AS share, v[least(CAST(floor(len(v) * share) AS BIGINT) + 1, len(v))] AS value FROM s, p""")
def percentile_floor(spark, d):
    return ordered.at_ranks(table(spark, d, "events"), "value", [0.5, 0.95, 0.99, 1.0])


@query("""SELECT unnest(['10', '50', '100', '500', '1000', '5000', '+Inf']) AS le, unnest([count(*) FILTER (value <= 10), count(*) FILTER (value <= 50), count(*) FILTER (value <= 100), count(*) FILTER (value <= 500),
 count(*) FILTER (value <= 1000), count(*) FILTER (value <= 5000), count(value)]) AS n FROM events""")
def histogram_buckets(spark, d):
    return aggregate.histogram(table(spark, d, "events"), "value")


@query("""SELECT count(*) AS documents, count(DISTINCT source) AS collections, max(doc_id) AS last_updated,
CAST(sum(octet_length(encode('{"doc_id":' || doc_id || coalesce(',"collection":"' || source || '"', '') || ',"updated_at":' || doc_id || '}'))) AS BIGINT) AS bytes FROM documents""")
def store_stats(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.col("source").alias("collection"), F.col("doc_id").alias("updated_at"))
    return aggregate.store_stats(docs).select("documents", "collections", "last_updated", "bytes")


@query("SELECT source AS collection, count(*) AS documents FROM documents GROUP BY source")
def documents_per_collection(spark, d):
    return aggregate.collections(table(spark, d, "documents").withColumnRenamed("source", "collection"))


@query(f"""WITH {LOG} SELECT 'ledger_events_total{{project="' || project_id || '",type="' || event_type || '"}} ' || count(*) AS line FROM log GROUP BY project_id, event_type""")
def prometheus_metrics(spark, d):
    counts = adapter.log(spark, d).groupBy("project_id", "event_type").agg(F.count("*").alias("value"))
    return aggregate.prometheus(counts.select(F.lit("events_total").alias("name"), F.create_map(F.lit("project"), "project_id", F.lit("type"), "event_type").alias("labels"), "value"))


@query("""WITH t AS (SELECT user_id, 'tenant-' || user_id AS t FROM events), h AS (
  SELECT user_id, list_reduce(list_prepend(CAST(5381 AS BIGINT), list_transform(string_split(t, ''), lambda c: CAST(ascii(c) AS BIGINT))), lambda h, c: (h * 33 + c) % 4294967296) % 16 AS p FROM t)
SELECT CAST(p AS INTEGER) AS "partition", count(DISTINCT user_id) AS tenants, count(*) AS events FROM h GROUP BY p""")
def tenant_partitions(spark, d):
    rows = table(spark, d, "events").withColumn("tenant", F.concat(F.lit("tenant-"), F.col("user_id").cast("string")))
    return aggregate.partition_stats(rows, "tenant", hashing.tenant_partition("tenant"))


# --- folds


@query(f"""WITH {CRUD}, b AS (SELECT project_id, id, max(s) AS born FROM crud WHERE k = 'c' GROUP BY ALL),
g AS (SELECT project_id, id, born, min(s) FILTER (k = 'd') AS gone FROM crud JOIN b USING (project_id, id) WHERE s >= born GROUP BY ALL)
SELECT project_id, id, CAST(max_by(json_extract_string(payload, '$.k'), s) FILTER (k <> 'd' AND (gone IS NULL OR s < gone)) AS BIGINT) AS k,
       count(*) FILTER (k <> 'd' AND (gone IS NULL OR s < gone)) AS version, bool_or(gone IS NOT NULL) AS deleted, max(ts) FILTER (k = 'd' OR gone IS NULL OR s < gone) AS updated_at
FROM crud JOIN g USING (project_id, id) WHERE s >= born GROUP BY project_id, id""")
def entity_fold(spark, d):
    out = folds.entities(adapter.crud(spark, d), "user")
    return out.select("project_id", "id", F.get_json_object("data", "$.k").cast("long").alias("k"), "version", "deleted", "updated_at")


@query(f"""WITH {CRUD}, w AS (SELECT *, last_value(CASE WHEN k <> 'u' THEN k END IGNORE NULLS) OVER (PARTITION BY project_id, id ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS was FROM crud),
ok AS (SELECT * FROM w WHERE NOT (k = 'c' AND was IS NOT DISTINCT FROM 'c') AND NOT (k = 'u' AND was IS DISTINCT FROM 'c')),
b AS (SELECT project_id, id, max(s) FILTER (k = 'c') AS born, max(s) FILTER (k = 'd') AS gone FROM ok GROUP BY ALL)
SELECT project_id, id, CAST(max_by(json_extract_string(payload, '$.k'), s) AS BIGINT) AS k, count(*) AS version, min_by(event_id, s) AS event_id
FROM ok JOIN b USING (project_id, id) WHERE born IS NOT NULL AND (gone IS NULL OR gone < born) AND s >= born GROUP BY project_id, id""")
def document_fold(spark, d):
    rows = adapter.crud(spark, d).withColumns({"event_type": F.concat(F.lit("document."), "kind"), "document_id": F.col("entity_id")})
    out = folds.documents(rows)
    return out.select("project_id", "id", F.get_json_object("content", "$.k").cast("long").alias("k"), "version", "event_id")


@query(f"""WITH {CRUD}, w AS (SELECT *, last_value(CASE WHEN k <> 'u' THEN k END IGNORE NULLS) OVER (PARTITION BY project_id, id ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS was FROM crud)
SELECT project_id, id, s AS sequence_number, CASE k WHEN 'c' THEN 'exists' ELSE 'missing' END AS error FROM w WHERE (k = 'c' AND was = 'c') OR (k = 'u' AND was IS DISTINCT FROM 'c')""")
def document_errors(spark, d):
    rows = adapter.crud(spark, d).withColumns({"event_type": F.concat(F.lit("document."), "kind"), "document_id": F.col("entity_id")})
    return folds.document_steps(rows).filter("error is not null").select("project_id", "id", "sequence_number", "error")


@query(f"WITH {LOG} SELECT project_id, CAST(user_id AS VARCHAR) AS key, max_by(payload, sequence_number) AS payload FROM log WHERE event_type IN ('view', 'error') GROUP BY ALL HAVING max_by(event_type, sequence_number) = 'view'")
def console_cache(spark, d):
    return views.cache(adapter.log(spark, d), F.col("user_id").cast("string"), "view", "error")


@query(f"WITH {LOG} SELECT sequence_number, project_id, replace(upper(event_type), '.', '_') AS action FROM log")
def console_audit(spark, d):
    return views.audit(adapter.log(spark, d)).select("sequence_number", "project_id", "action")


@query(f"WITH {LOG} SELECT project_id, count(*) AS n, round(sum(value), 2) AS total FROM log GROUP BY project_id")
def user_fold(spark, d):
    rows = adapter.log(spark, d).select("project_id", "sequence_number", "value")
    out = folds.user_fold(rows, ["project_id"], lambda: {"n": 0, "total": 0.0}, lambda s, e: {"n": s["n"] + 1, "total": s["total"] + e["value"]}, "n long, total double")
    return out.withColumn("total", F.round("total", 2))


# --- snapshots


@query(f"WITH {LOG} SELECT project_id, count(*) AS event_count, max_by(ts, sequence_number) AS last_event_at, max(sequence_number) AS last_sequence FROM log GROUP BY project_id")
def tenant_state(spark, d):
    """A snapshot carried on by the tail."""
    rows = adapter.log(spark, d)
    return views.advanced(views.tenant_state(rows, 300), rows.filter("sequence_number > 300"))


@query(f"WITH {LOG} SELECT project_id, event_type, sequence_number, payload FROM log QUALIFY row_number() OVER (PARTITION BY project_id, event_type ORDER BY sequence_number DESC) <= 100")
def last_100_per_type(spark, d):
    return views.last_per_type(adapter.log(spark, d)).select("project_id", "event_type", "sequence_number", "payload")


@query(f"""WITH {LOG}, t AS (SELECT project_id, count(*) AS event_count FROM log GROUP BY project_id),
k AS (SELECT project_id, event_type, sequence_number, payload FROM log QUALIFY row_number() OVER (PARTITION BY project_id, event_type ORDER BY sequence_number DESC) <= 100)
SELECT k.*, event_count FROM k JOIN t USING (project_id)""")
def snapshot(spark, d):
    rows = views.snapshot(adapter.log(spark, d)).select("project_id", "event_count", F.explode("data").alias("event_type", "events"))
    return rows.select("project_id", "event_count", "event_type", F.explode("events").alias("e")).select("project_id", "event_count", "event_type", "e.sequence_number", "e.payload")


def _two_snapshots(spark, d):
    """The log, and where its states up to 200 and up to 500 are written."""
    rows, path = adapter.log(spark, d), f"{shared_dir(spark)}/snapshots-{uuid.uuid4().hex}"
    snapshots.write(rows, path, "early", "2024-01-01 00:00:00", 200)
    snapshots.write(rows, path, "late", "2024-02-01 00:00:00", 500)
    return rows, path


@query(f"""WITH {LOG}, s AS (SELECT unnest(['early', 'late']) AS snapshot_id, unnest([200, 500]) AS up_to)
SELECT snapshot_id, CAST(up_to AS BIGINT) AS up_to, count(DISTINCT project_id) AS tenants, count(*) AS events FROM log JOIN s ON sequence_number <= up_to GROUP BY ALL""")
def snapshot_list(spark, d):
    return snapshots.listed(spark, _two_snapshots(spark, d)[1]).drop("created_at")


@query(f"WITH {LOG} SELECT project_id, count(*) AS event_count, max_by(ts, sequence_number) AS last_event_at, max(sequence_number) AS last_sequence FROM log GROUP BY project_id")
def snapshot_restore(spark, d):
    """The newest snapshot, carried on by the events after it."""
    rows, path = _two_snapshots(spark, d)
    return snapshots.restore(spark, path, snapshots.latest(spark, path), rows)


@query(f"WITH {LOG} SELECT project_id, least(count(*), 200) AS events_one, count(*) FILTER (sequence_number <= 200 AND sequence_number % 7 <> 0) AS events_two FROM log GROUP BY project_id")
def snapshot_faults(spark, d):
    """A snapshot held against a log that has lost every seventh event."""
    rows, path = _two_snapshots(spark, d)
    return snapshots.faults(spark, path, "early", rows.filter("sequence_number % 7 <> 0"))


@query(f"WITH {LOG} SELECT project_id, count(*) AS events_one, count(*) FILTER (sequence_number <= 200) AS events_two FROM log GROUP BY project_id HAVING count(*) > 200")
def snapshot_diff(spark, d):
    rows = adapter.log(spark, d)
    return views.snapshot_diff(views.tenant_state(rows), views.tenant_state(rows, 200))


# --- delivery


@query(f"WITH {DELIVERIES} SELECT stream_id, velocity_seq, event_type FROM e ANTI JOIN r USING (stream_id, velocity_seq)")
def dedupe_anti(spark, d):
    return delivery.undelivered(*adapter.deliveries(spark, d))


@query(f"WITH {DELIVERIES} SELECT r.stream_id, r.velocity_seq, r.event_type, r.wal_sequence FROM e JOIN r USING (stream_id, velocity_seq) WHERE e.event_type = 'purchase'")
def dedupe_receipt_lookup(spark, d):
    events, receipts = adapter.deliveries(spark, d)
    return delivery.known_receipts(events.filter("event_type = 'purchase'"), receipts)


@query(f"WITH {DELIVERIES} SELECT stream_id, velocity_seq, event_type FROM e WHERE velocity_seq % 10 <> 0")
def pending_minus_tombstones(spark, d):
    events, _ = adapter.deliveries(spark, d)
    return delivery.pending(events, events.filter("velocity_seq % 10 = 0"))


@query(f"WITH {DELIVERIES} SELECT stream_id, velocity_seq, event_type, CASE WHEN velocity_seq % 4 <> 0 THEN 'skip' ELSE 'redeliver' END AS action FROM e")
def recovery_classify(spark, d):
    events, receipts = adapter.deliveries(spark, d)
    return delivery.recovery(events, receipts)


GATE = """g AS (SELECT 'stream-' || (user_id % 8) AS stream_id, row_number() OVER (PARTITION BY user_id % 8 ORDER BY event_id) AS n, event_id AS arrival, event_type <> 'view' OR user_id % 8 < 6 AS real FROM events),
w AS (SELECT *, lag(n) OVER (PARTITION BY stream_id ORDER BY n) AS q FROM g WHERE real),
f AS (SELECT stream_id, min(n) AS stop FROM w WHERE n <> q + 1 GROUP BY stream_id)"""


@query(f"""WITH {GATE} SELECT stream_id, n AS velocity_seq, CASE WHEN NOT real THEN 'transient' WHEN stop IS NULL OR n < stop THEN 'accepted' ELSE 'gap' END AS status FROM g LEFT JOIN f USING (stream_id)
UNION ALL SELECT stream_id, n, CASE WHEN NOT real THEN 'transient' WHEN stop IS NULL OR n < stop THEN 'duplicate' ELSE 'gap' END FROM g LEFT JOIN f USING (stream_id) WHERE n % 10 = 0""")
def bridge_gate(spark, d):
    """Streams with transient events (two of them break there) and every tenth event sent twice."""
    e = table(spark, d, "events").select(F.concat(F.lit("stream-"), (F.col("user_id") % 8).cast("string")).alias("stream_id"), "event_id", ((F.col("event_type") != "view") | (F.col("user_id") % 8 < 6)).alias("irreversibility_marker"))
    e = ordered.numbered(e, ["stream_id"], ["event_id"], "velocity_seq").withColumnRenamed("event_id", "arrival")
    e = e.unionByName(e.filter("velocity_seq % 10 = 0").withColumn("arrival", F.col("arrival") + 1_000_000_000_000))
    return delivery.gate(e).select("stream_id", "velocity_seq", "status")


@query("""WITH l AS (SELECT event_id, CASE WHEN value >= 100 THEN TRUE WHEN value <= 10 THEN FALSE END AS m FROM events)
SELECT event_id, coalesce(last_value(m IGNORE NULLS) OVER (ORDER BY event_id ROWS UNBOUNDED PRECEDING), FALSE) AS pressed FROM l""")
def backpressure(spark, d):
    return delivery.backpressure(table(spark, d, "events").select("event_id", "value"), "event_id", "value", 100, 10).select("event_id", "pressed")


# --- streams and tenancy


@query("""SELECT DISTINCT concat_ws(':', 'tenant-' || (user_id % 4), 'default', 'stream', event_type) AS key FROM events""")
def namespaced_keys(spark, d):
    e = table(spark, d, "events")
    return e.select(hashing.namespaced_key(F.concat(F.lit("tenant-"), (F.col("user_id") % 4).cast("string")), F.lit("default"), F.lit("stream"), "event_type").alias("key")).distinct()


@query(f"""WITH {STREAM}, o AS (SELECT project_id, stream, consumer_group, max("offset") AS committed FROM commits GROUP BY ALL)
SELECT o.project_id, o.stream, o.consumer_group, o.committed, count(m."offset") AS waiting FROM o LEFT JOIN m ON m.project_id = o.project_id AND m.stream = o.stream AND m."offset" > o.committed GROUP BY ALL""")
def consumer_lag(spark, d):
    return views.lag(*adapter.stream(spark, d))


@query(f"""WITH {STREAM} SELECT project_id, stream, "offset", value FROM m WHERE stream = 'purchase' AND "offset" >= 500""")
def stream_replay_offset(spark, d):
    return views.replay(adapter.stream(spark, d)[0], "purchase", 500).select("project_id", "stream", "offset", "value")


@query(f"""WITH {STREAM} SELECT project_id, stream, "offset", value FROM m WHERE stream = 'click' AND ts >= TIMESTAMP '2024-01-05 00:00:00'""")
def stream_replay_time(spark, d):
    return views.replay(adapter.stream(spark, d)[0], "click", from_time="2024-01-05 00:00:00").select("project_id", "stream", "offset", "value")


@query(f"WITH {LOG} SELECT project_id, date_trunc('second', ts) AS second, count(*) AS events FROM log GROUP BY ALL HAVING count(*) > 1")
def quota_per_second(spark, d):
    return views.rate_violations(adapter.log(spark, d), 1)


@query(f"""WITH {STREAM} SELECT project_id, count(DISTINCT stream) AS streams, count(DISTINCT consumer_group) AS "groups", count(*) AS events FROM commits GROUP BY project_id""")
def tenant_usage(spark, d):
    return views.usage(adapter.stream(spark, d)[1])


# --- what applications write


STEPS = CRUD + """, w AS (SELECT *, last_value(CASE WHEN k <> 'u' THEN k END IGNORE NULLS) OVER (PARTITION BY project_id, id ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS was FROM crud),
ok AS (SELECT * FROM w WHERE NOT (k = 'c' AND was IS NOT DISTINCT FROM 'c') AND NOT (k = 'u' AND was IS DISTINCT FROM 'c')),
b AS (SELECT project_id, id, max(s) FILTER (k = 'c') AS born, max(s) FILTER (k = 'd') AS gone FROM ok GROUP BY ALL),
live AS (SELECT project_id, id, 'c' || (CAST(id AS BIGINT) % 3) AS collection, min(s) AS first, max(s) FILTER (k = 'u') AS last, CAST(max_by(json_extract_string(payload, '$.k'), s) AS BIGINT) AS k, count(*) AS version
  FROM ok JOIN b USING (project_id, id) WHERE born IS NOT NULL AND (gone IS NULL OR gone < born) AND s >= born GROUP BY project_id, id)"""


def _number(name):
    return F.get_json_object("content", f"$.{name}").cast("long")


@query(f"WITH {STEPS} SELECT project_id, id, collection, k, first, last, version FROM live")
def document_payloads(spark, d):
    """Documents from events that carry content and updates."""
    out = folds.documents(folds.document_events(adapter.document_log(spark, d)))
    return out.select("project_id", "id", "collection", _number("props.k").alias("k"), _number("first").alias("first"), _number("last").alias("last"), "version")


@query(f"WITH {STEPS} SELECT project_id, id, collection, k, version FROM live")
def document_store(spark, d):
    """The same changes, made through the document store: appended to a new log, numbered there, and folded."""
    rows = adapter.crud(spark, d)
    kept = store.TableStore(spark, f"{shared_dir(spark)}/store-{uuid.uuid4().hex}")
    kept.create(spark.createDataFrame([], "project_id string, sequence_number long, event_id string, event_type string, payload string, payload_hash string, previous_hash string, ts timestamp, metadata map<string,string>"))
    changes = rows.select("project_id", "kind", F.col("entity_id").alias("document_id"), F.concat(F.lit("c"), (F.col("user_id") % 3).cast("string")).alias("collection"), F.col("payload").alias("body"), F.col("ts").cast("timestamp").alias("at"), F.col("event_id").cast("long").alias("arrival"))
    docs = store.Documents(kept)
    docs.apply(changes)
    return docs.state().select("project_id", "id", "collection", _number("k").alias("k"), "version")


@query(f"WITH {STEPS} SELECT project_id, collection, count(*) AS documents FROM live WHERE project_id = 'tenant-1' GROUP BY ALL")
def document_collections(spark, d):
    docs = folds.documents(folds.document_events(adapter.document_log(spark, d))).filter("project_id = 'tenant-1'")
    return docs.groupBy("project_id", "collection").agg(F.count("*").alias("documents"))


@query(f"""WITH {CRUD}, x AS (SELECT *, row_number() OVER (PARTITION BY project_id, id ORDER BY s DESC) AS n FROM crud WHERE k <> 'u')
SELECT project_id, id, 'c' || (CAST(id AS BIGINT) % 3) AS collection, s AS first FROM x WHERE n = 1 AND k = 'c'""")
def console_documents(spark, d):
    return views.console_documents(adapter.document_log(spark, d)).select("project_id", "id", "collection", F.get_json_object("content", "$.first").cast("long").alias("first"))


@query(f"WITH {CRUD} SELECT s AS sequence_number, project_id, CASE k WHEN 'c' THEN 'DOCUMENT_CREATED' WHEN 'u' THEN 'DOCUMENT_UPDATED' ELSE 'DOCUMENT_DELETED' END AS action, id AS entity FROM crud ORDER BY s DESC, project_id LIMIT 500")
def console_audit_latest(spark, d):
    return views.audit(adapter.document_log(spark, d)).limit(500).select("sequence_number", "project_id", "action", "entity")


def _console(spark, d):
    """The log as what a console writes: messages (some without a stream), files and alerts."""
    name = F.create_map(*map(F.lit, ("click", "message.published", "purchase", "file.uploaded", "error", "alert.created")))
    rows = adapter.log(spark, d)
    message = F.to_json(F.struct(F.col("event_id").alias("message_id"), F.when(F.col("user_id") % 3 != 0, F.concat(F.lit("s"), F.col("user_id") % 5)).alias("stream"), F.lit("hello").alias("payload"), F.col("sequence_number").alias("published_at")))
    upload = F.to_json(F.struct(F.col("event_id").alias("file_id"), F.lit("a.txt").alias("name"), (F.col("user_id") * 10).alias("size"), F.lit("text/plain").alias("type"), F.col("sequence_number").alias("uploaded_at")))
    alert = F.to_json(F.struct(F.col("event_id").alias("rule_id"), F.col("event_type").alias("source"), F.lit("k").alias("conditionField"), F.col("user_id").alias("conditionValue"), F.lit("notify").alias("action")))
    kind = F.coalesce(name[F.col("event_type")], F.col("event_type"))
    return rows.withColumns({"payload": F.when(kind == "message.published", message).when(kind == "file.uploaded", upload).when(kind == "alert.created", alert).otherwise(F.col("payload")), "event_type": kind})


@query(f"WITH {LOG} SELECT project_id, event_id AS id, CASE WHEN user_id % 3 <> 0 THEN 's' || (user_id % 5) END AS stream, sequence_number AS \"offset\" FROM log WHERE event_type = 'click'")
def console_messages(spark, d):
    return views.messages(_console(spark, d)).select("project_id", "id", "stream", "offset")


@query(f"WITH {LOG} SELECT project_id, event_id AS id, user_id * 10 AS size, CAST(sequence_number AS VARCHAR) AS uploaded_at FROM log WHERE event_type = 'purchase'")
def console_files(spark, d):
    return views.files(_console(spark, d)).select("project_id", "id", "size", "uploaded_at")


@query(f"WITH {LOG} SELECT project_id, event_id AS id, event_type AS source, CAST(user_id AS VARCHAR) AS condition_value, TRUE AS active FROM log WHERE event_type = 'error'")
def console_alerts(spark, d):
    return views.alerts(_console(spark, d)).select("project_id", "id", "source", "condition_value", "active")


@query(f"""WITH {LOG} SELECT project_id, count(*) AS events, count(*) FILTER (event_type = 'click') AS messages, count(*) FILTER (event_type = 'purchase') AS files,
CAST(coalesce(sum(user_id * 10) FILTER (event_type = 'purchase'), 0) AS BIGINT) AS file_bytes FROM log GROUP BY project_id""")
def dashboard(spark, d):
    return views.dashboard(_console(spark, d)).drop("documents")


@query(f"""WITH {CRUD}, b AS (SELECT project_id, id, max(s) AS born FROM crud WHERE k = 'c' GROUP BY ALL)
SELECT project_id, id FROM crud JOIN b USING (project_id, id) WHERE s >= born GROUP BY project_id, id HAVING NOT bool_or(k = 'd')""")
def live_entities(spark, d):
    """Entities with a tombstone don't show."""
    return find.Query(folds.entities(adapter.crud(spark, d), "user")).rows().select("project_id", "id")


@query(f"WITH {LOG} SELECT project_id, count(*) AS event_count, max(sequence_number) AS last_sequence FROM log GROUP BY project_id")
def projection_rebuild(spark, d):
    """A projection of half the log, then rebuilt for one project after the other from the whole."""
    rows, kept = adapter.log(spark, d), store.Projections()
    kept.register("state", views.tenant_state)
    kept.rebuild(rows.filter("sequence_number <= 100"))
    for k in range(4):
        kept.rebuild(rows, "state", f"tenant-{k}")
    return kept.get("state").select("project_id", "event_count", "last_sequence")


# --- order by the envelope and by mixed values


@query("SELECT c_custkey AS id, c_custkey % 5 AS version FROM customer ORDER BY c_custkey % 5 DESC, c_custkey % 97, c_custkey LIMIT 50 OFFSET 10")
def find_sorted_envelope(spark, d):
    return find.Query(adapter.customers(spark, d)).order_by("version", "desc").order_by("created_at").offset(10).limit(50).rows().select("id", "version")


@query("SELECT c_custkey AS id FROM customer WHERE c_custkey % 5 >= 3 AND 1700000000 + c_custkey % 97 < 1700000040")
def find_by_envelope(spark, d):
    q = find.Query(adapter.customers(spark, d)).where("version", "gte", 3).where("created_at", "lt", F.timestamp_seconds(F.lit(1_700_000_040)))
    return q.rows().select("id")


@query("""SELECT id, place FROM (SELECT c_custkey AS id, row_number() OVER (ORDER BY CASE c_custkey % 4 WHEN 0 THEN 0 WHEN 1 THEN 1 WHEN 2 THEN 2 ELSE 3 END,
CASE c_custkey % 4 WHEN 1 THEN CAST(c_custkey % 8 = 1 AS INTEGER) WHEN 2 THEN c_acctbal ELSE 0 END, CASE WHEN c_custkey % 4 = 3 THEN c_name END, c_custkey) - 1 AS place FROM customer)""")
def find_sorted_mixed(spark, d):
    """Missing values, then false and true, numbers and texts."""
    c, key = table(spark, d, "customer"), F.col("c_custkey") % 4
    mixed = F.when(key == 1, F.when(F.col("c_custkey") % 8 == 1, "true").otherwise("false")).when(key == 2, F.col("c_acctbal").cast("string")).when(key == 3, F.concat(F.lit('"'), "c_name", F.lit('"')))
    docs = c.select(F.col("c_custkey").alias("id"), F.coalesce(F.concat(F.lit('{"m":'), mixed, F.lit("}")), F.lit("{}")).alias("data"))
    return ordered.ranked(docs, [*find.sort_keys(Field("data", "m")), F.asc("id")], "place").select("id", "place")


# --- more of the log, of delivery and of the functions


@query("SELECT event_id, user_id, q AS previous FROM (SELECT *, lag(user_id) OVER (ORDER BY event_id) AS q FROM events) WHERE user_id <= q")
def log_out_of_order(spark, d):
    return log.out_of_order(table(spark, d, "events").select("event_id", "user_id"), "event_id", "user_id").select("event_id", "user_id", "previous")


@query(f"WITH {LOG} SELECT project_id, sequence_number, event_type FROM log ORDER BY sequence_number DESC, project_id LIMIT 25")
def log_latest(spark, d):
    return log.latest(adapter.log(spark, d), 25).select("project_id", "sequence_number", "event_type")


@query(f"WITH {LOG} SELECT project_id, max(sequence_number) AS processed, max(sequence_number) AS current_sequence, max_by(ts, sequence_number) AS last_event_time FROM log GROUP BY project_id, (sequence_number - 1) // 1000")
def replay_progress(spark, d):
    return log.progress(adapter.log(spark, d))


@query(f"""WITH {LOG}, r AS (SELECT project_id, count(*) AS events, (epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6 AS seconds, avg(value) AS mean FROM log GROUP BY project_id)
SELECT project_id, events, round(seconds, 3) AS seconds, round(events / seconds, 9) AS per_second, round(events / seconds * 200, 6) AS bytes_per_second, round(mean, 6) AS mean FROM r""")
def log_rates(spark, d):
    out = aggregate.rates(adapter.log(spark, d), ["project_id"])
    return out.select("project_id", "events", *(F.round(c, n).alias(c) for c, n in (("seconds", 3), ("per_second", 9), ("bytes_per_second", 6), ("mean", 6))))


@query(f"""WITH {LOG}, b AS (SELECT project_id, epoch_us(ts) - sequence_number AS base FROM log WHERE sequence_number = 1000)
SELECT project_id, sequence_number, greatest(max(epoch_us(ts) - sequence_number) OVER (PARTITION BY project_id ORDER BY sequence_number), base) + sequence_number AS micros
FROM log JOIN b USING (project_id) WHERE sequence_number > 1000""")
def append_times(spark, d):
    """Appended events get times that rise by a microsecond at least."""
    whole = adapter.log(spark, d).withColumn("ts", F.col("ts").cast("timestamp"))
    new = whole.filter("sequence_number > 1000").select("project_id", "event_type", "payload", "ts", F.col("sequence_number").alias("arrival"), "event_id")
    return log.append(whole.filter("sequence_number <= 1000"), new).select("project_id", "sequence_number", F.unix_micros("ts").alias("micros"))


SIZED = LOG + """, z AS (SELECT *, octet_length(encode(payload)) + length(project_id) + length(event_type) + 32 AS size FROM log),
y AS (SELECT *, (sum(size) OVER (PARTITION BY project_id ORDER BY sequence_number) - size) // 50000 AS segment FROM z)"""


@query(f"WITH {SIZED} SELECT project_id, CAST(segment AS BIGINT) AS segment, min(sequence_number) AS first_sequence, max(sequence_number) AS last_sequence, count(*) AS events, CAST(64 + sum(size - 0) AS BIGINT) AS bytes FROM y GROUP BY ALL")
def segments_sealed(spark, d):
    return files.sealed(adapter.log(spark, d), 50_000, version=1).drop("content")


@query(f"WITH {LOG} SELECT project_id, sequence_number, event_type, payload FROM log")
def segments_decoded(spark, d):
    """Written as sealed segments and read back."""
    path = f"{shared_dir(spark)}/segments-{uuid.uuid4().hex}"
    files.write_segments(adapter.log(spark, d), path, 200_000)
    return files.read_sealed(spark.read.parquet(path)).select("project_id", "sequence_number", "event_type", "payload")


@query(f"WITH {LOG} SELECT project_id, sequence_number, event_type, ts FROM log WHERE sequence_number BETWEEN 300 AND 900 AND event_type IN ('click', 'error')")
def segments_filtered(spark, d):
    out = files.read_sealed(files.sealed(adapter.log(spark, d), 50_000, version=1), 300, 900, ["click", "error"])
    return out.select("project_id", "sequence_number", "event_type", F.col("ts").cast("timestamp_ntz").alias("ts"))


@query(f"WITH {DELIVERIES} SELECT stream_id, velocity_seq, event_type FROM e WHERE velocity_seq % 3 <> 0 ORDER BY stream_id, velocity_seq")
def pending_ordered(spark, d):
    events, _ = adapter.deliveries(spark, d)
    return delivery.pending_in_order(events, events.filter("velocity_seq % 3 = 0"))


@query(f"WITH {DELIVERIES} SELECT DISTINCT velocity_seq FROM r WHERE stream_id = 'stream-3'")
def delivered_numbers(spark, d):
    return delivery.delivered_numbers(adapter.deliveries(spark, d)[1], "stream-3")


@query(f"WITH {DELIVERIES} SELECT stream_id, velocity_seq, event_type, CASE WHEN velocity_seq % 4 <> 0 THEN velocity_seq * 2 END AS wal_sequence FROM e")
def original_receipts(spark, d):
    """A second receipt for some events; each gets its first."""
    events, receipts = adapter.deliveries(spark, d)
    return delivery.with_receipts(events, receipts.unionByName(receipts.filter("velocity_seq % 3 = 0").withColumn("wal_sequence", F.col("wal_sequence") + 1)))


@query(f"""WITH {DELIVERIES}, c AS (SELECT r.*, velocity_seq || ':' || stream_id || ':' || wal_sequence || ':' || event_type AS text FROM r)
SELECT stream_id, velocity_seq, wal_sequence, {CRC} AS checksum FROM c WHERE velocity_seq % 11 <> 0""")
def receipt_registry(spark, d):
    """Receipts that were written twice, some with a wrong checksum."""
    _, r = adapter.deliveries(spark, d)
    r = r.withColumn("checksum", hashing.receipt_checksum() + F.when(F.col("velocity_seq") % 11 == 0, 1).otherwise(0))
    return bridge.registry(r.unionByName(r)).select("stream_id", "velocity_seq", "wal_sequence", "checksum")


@query(f"""WITH {GATE}, s AS (SELECT stream_id, n, CASE WHEN NOT real THEN 'transient' WHEN stop IS NULL OR n < stop THEN 'accepted' ELSE 'gap' END AS status FROM g LEFT JOIN f USING (stream_id)
UNION ALL SELECT stream_id, n, CASE WHEN NOT real THEN 'transient' WHEN stop IS NULL OR n < stop THEN 'duplicate' ELSE 'gap' END FROM g LEFT JOIN f USING (stream_id) WHERE n % 10 = 0)
SELECT stream_id, count(*) AS received, count(*) FILTER (status = 'accepted') AS delivered, count(*) FILTER (status IN ('transient', 'gap')) AS rejected, count(*) FILTER (status = 'duplicate') AS duplicates,
max(n) FILTER (status = 'accepted') AS last_crossed, CAST(0 AS BIGINT) AS buffered FROM s GROUP BY stream_id""")
def bridge_metrics(spark, d):
    return delivery.metrics(bridge_gate(spark, d))


@query("""SELECT o_orderkey, format('{:016x}', o_orderkey) || left(o_orderpriority, 8) AS sortable, o_orderkey AS decoded, 'doc_' || o_orderkey || '_' || left(o_orderpriority, 8) AS document, least(100 * pow(2, o_orderkey % 12), 30000)::BIGINT AS wait,
round(o_orderkey / 1024, 2) AS kb, coalesce(CASE WHEN o_custkey % 2 = 0 THEN CAST(o_custkey AS VARCHAR) END, '__null__') AS index_key, epoch_us(o_orderdate) AS micros FROM orders""")
def function_values(spark, d):
    o = table(spark, d, "orders")
    sortable = hashing.sortable_id("o_orderkey", "o_orderpriority")
    return o.select(
        "o_orderkey", sortable.alias("sortable"), hashing.sortable_id_time(sortable).alias("decoded"), hashing.document_id("o_orderkey", "o_orderpriority").alias("document"), hashing.backoff_ms(100, F.col("o_orderkey") % 12).alias("wait"),
        hashing.kilobytes("o_orderkey").alias("kb"), hashing.index_key(F.when(F.col("o_custkey") % 2 == 0, F.col("o_custkey"))).alias("index_key"), hashing.micros(F.col("o_orderdate").cast("timestamp")).alias("micros"),
    )


@query("""SELECT event_id, '{"a":{"user":' || user_id || ',"z":null},"k":' || json_extract_string(props, '$.k') || ',"t":"\\u003c' || event_type || '\\u003e"}' AS canonical FROM events""")
def canonical_payloads(spark, d):
    """Keys out of order, blanks and characters that are escaped."""
    text = F.concat(F.lit('{"t": "<'), "event_type", F.lit('>", "k": '), F.get_json_object("props", "$.k"), F.lit(', "a" : {"z":null,"user":'), F.col("user_id").cast("string"), F.lit(".0}}"))
    return table(spark, d, "events").select("event_id", canonical.canonical_json(text).alias("canonical"))


# --- what Spark adds to the reference's operations


@query("SELECT n_name, count(*) AS orders, round(sum(o_totalprice), 2) AS total FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name")
def ext_join_aggregate(spark, d):
    o, c, n = (table(spark, d, t) for t in ("orders", "customer", "nation"))
    joined = o.select("o_custkey", "o_totalprice").join(c.select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey")).join(n, F.col("c_nationkey") == F.col("n_nationkey"))
    return joined.groupBy("n_name").agg(F.count("*").alias("orders"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS quantity, count(*) AS n FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)")
def ext_rollup(spark, d):
    return table(spark, d, "lineitem").rollup("l_returnflag", "l_linestatus").agg(F.round(F.sum("l_quantity"), 2).alias("quantity"), F.count("*").alias("n"))


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS hour, event_type, count(*) AS n FROM events GROUP BY ALL")
def ext_hourly(spark, d):
    return table(spark, d, "events").groupBy(F.window("ts", "1 hour").start.alias("hour"), "event_type").agg(F.count("*").alias("n"))


@query("""WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER w < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM g) SELECT user_id, min(ts) AS start, count(*) AS n FROM s GROUP BY user_id, k""")
def ext_sessions(spark, d):
    out = table(spark, d, "events").groupBy("user_id", F.session_window("ts", "30 minutes").alias("w")).agg(F.count("*").alias("n"))
    return out.select("user_id", F.col("w.start").alias("start"), "n")


@query("SELECT p_brand, p_partkey, p_retailprice FROM part QUALIFY row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) <= 3")
def ext_top_per_group(spark, d):
    place = F.row_number().over(Window.partitionBy("p_brand").orderBy(F.desc("p_retailprice"), "p_partkey"))
    return table(spark, d, "part").withColumn("place", place).filter("place <= 3").select("p_brand", "p_partkey", "p_retailprice")
