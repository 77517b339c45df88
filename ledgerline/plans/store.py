"""Document operations on a log, as an application uses them: each change is an event first, and what is read is a fold of the events."""

from __future__ import annotations

import json
from collections.abc import Callable
from typing import Protocol

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import aggregate, find
from ..operators import log as logs
from ..storage import staged
from . import folds

CHANGES = "project_id string, event_type string, payload string, ts timestamp, arrival long, event_id string"


class Handler(Protocol):
    """What a projection does with an event of a replay."""

    def __call__(self, event) -> None: ...


class Store(Protocol):
    """What the façade needs of a store of events."""

    def read(self) -> DataFrame: ...

    def append(self, changes: DataFrame) -> None: ...


class TableStore:
    """A log kept as a stored table, an append adding files to it."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path, self.schema = spark, path, None

    def create(self, empty: DataFrame) -> TableStore:
        empty.write.mode("ignore").parquet(self.path)
        return self

    def read(self) -> DataFrame:
        return self.spark.read.parquet(self.path)

    def append(self, changes: DataFrame) -> None:
        """The changes as events after the log's heads; refused as a whole if any isn't valid."""
        log = self.read()
        new = logs.append(log, changes).withColumn("metadata", F.lit(None).cast("map<string,string>"))
        new = staged(new.select(*log.columns), "appended")
        bad = logs.faults(new).filter(F.size("faults") > 0)
        if not bad.isEmpty():
            raise ValueError(f"invalid events: {bad.first().faults}")
        new.write.mode("append").parquet(self.path)


class Documents:
    """Create, update, delete, get, find, list and count documents of projects. Changes come one by one or as a frame of many."""

    def __init__(self, store: Store):
        self.store = store

    def state(self) -> DataFrame:
        return folds.documents(folds.document_events(self.store.read()))

    def apply(self, changes: DataFrame) -> None:
        """``changes``: (project_id, kind, document_id, collection, body, at, arrival), body the content or the updates as JSON text."""
        body = F.parse_json(F.coalesce("body", F.lit("{}")))
        payload = (
            F.when(F.col("kind") == "created", F.to_json(F.struct("document_id", "collection", body.alias("content"))))
            .when(F.col("kind") == "updated", F.to_json(F.struct("document_id", body.alias("updates"))))
            .otherwise(F.to_json(F.struct("document_id")))
        )
        event_id = F.concat_ws("-", F.lit("e"), F.sha2(F.concat_ws(":", "project_id", "document_id", "kind", F.col("arrival").cast("string")), 256).substr(1, 16))
        self.store.append(changes.select("project_id", F.concat(F.lit("document."), "kind").alias("event_type"), payload.alias("payload"), F.col("at").alias("ts"), "arrival", event_id.alias("event_id")))

    def _one(self, project: str, kind: str, document: str, collection: str | None, body: dict | None, at) -> None:
        spark = self.store.read().sparkSession
        row = [(project, kind, document, collection, None if body is None else json.dumps(body), at, 0)]
        self.apply(spark.createDataFrame(row, "project_id string, kind string, document_id string, collection string, body string, at timestamp, arrival long"))

    def create(self, project: str, document: str, collection: str, content: dict, at) -> None:
        if not document or not collection:
            raise ValueError("a document needs an id and a collection")
        if not self.get(project, document).isEmpty():
            raise ValueError(f"document {document!r} exists")
        self._one(project, "created", document, collection, content, at)

    def update(self, project: str, document: str, updates: dict, at) -> None:
        if not updates:
            raise ValueError("an update needs values")
        if self.get(project, document).isEmpty():
            raise KeyError(document)
        self._one(project, "updated", document, None, updates, at)

    def delete(self, project: str, document: str, at) -> None:
        if self.get(project, document).isEmpty():
            raise KeyError(document)
        self._one(project, "deleted", document, None, None, at)

    def get(self, project: str, document: str) -> DataFrame:
        return self.state().filter((F.col("project_id") == project) & (F.col("id") == document))

    def find(self, project: str, fields: dict, collection: str | None = None) -> find.Query:
        return find.Query(find.by_fields(self.state(), project, fields, collection), data="content")

    def count(self, project: str, collection: str | None = None, fields: dict | None = None) -> int:
        return self.find(project, fields or {}, collection).total()

    def collections(self, project: str) -> DataFrame:
        return aggregate.collections(self.state().filter(F.col("project_id") == project))

    def replay(self, handler: Handler, project: str | None = None, from_sequence: int = 0) -> int:
        return logs.handled(self.store.read(), handler, project, from_sequence)


class Projections:
    """Named projections of a log, each a function from the log to a frame: rebuilt whole, or for one project, which reads that project's events alone."""

    def __init__(self):
        self.known: dict[str, Callable[[DataFrame], DataFrame]] = {}
        self.built: dict[str, DataFrame] = {}

    def register(self, name: str, fold: Callable[[DataFrame], DataFrame]) -> None:
        if name in self.known:
            raise ValueError(f"projection {name!r} is registered")
        self.known[name] = fold

    def rebuild(self, log: DataFrame, name: str | None = None, project: str | None = None) -> None:
        log = log if project is None else log.filter(F.col("project_id") == project)
        for n in self.known if name is None else [name]:
            new = self.known[n](log)
            if project is not None and n in self.built:
                new = self.built[n].filter(F.col("project_id") != project).unionByName(new)
            self.built[n] = staged(new, f"projection-{n}")

    def get(self, name: str, project: str | None = None) -> DataFrame:
        rows = self.built[name]
        return rows if project is None else rows.filter(F.col("project_id") == project)

    def delete(self, name: str, project: str | None = None) -> None:
        """Forgets a projection's rows, or one project's."""
        if project is None:
            del self.built[name]
        else:
            self.built[name] = staged(self.built[name].filter(F.col("project_id") != project), f"projection-{name}")
