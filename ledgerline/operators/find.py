"""Filters, order and paging over documents and entities."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.values import Field

#: Fields of the envelope; all others are looked up in the data.
ENVELOPE = ("id", "version", "collection", "project_id", "created_at", "updated_at")
OPERATIONS = ("eq", "ne", "gt", "gte", "lt", "lte", "in")


def where(field: str, op: str, value, data: str | Column = "data", envelope: tuple[str, ...] = ENVELOPE) -> Column:
    """A condition that is never null; an envelope field that the rows don't have is an error. ``eq`` and ``ne`` mean same type and value, so that ``ne`` keeps rows without the field; ranges are for numbers alone; an unknown operation holds for no row."""
    if op not in OPERATIONS:
        return F.lit(False)
    if field in envelope:
        c = F.col(field)
        plain = {"eq": lambda: c.eqNullSafe(value), "ne": lambda: ~c.eqNullSafe(value), "in": lambda: c.isin(*value), "gt": lambda: c > value, "gte": lambda: c >= value, "lt": lambda: c < value, "lte": lambda: c <= value}
        return F.coalesce(plain[op](), F.lit(False))
    f = Field(data, field.removeprefix("data."))
    if op == "eq":
        return f.equals(value)
    if op == "ne":
        return ~f.equals(value)
    if op == "in":
        return reduce(lambda a, b: a | b, (f.equals(v) for v in value), F.lit(False))
    if isinstance(value, bool) or not isinstance(value, int | float):
        return F.lit(False)
    n = f.number
    return F.coalesce({"gt": n > value, "gte": n >= value, "lt": n < value, "lte": n <= value}[op], F.lit(False))


def by_fields(docs: DataFrame, project: str, fields: dict, collection: str | None = None, content: str = "content") -> DataFrame:
    """A project's documents whose top-level keys equal all the given values; the key ``id`` means the document's id."""
    conditions = [F.col("id") == v if k == "id" else Field(content, k, dotted=False).equals(v) for k, v in fields.items()]
    docs = docs.filter(F.col("project_id") == project)
    if collection:
        docs = docs.filter(F.col("collection") == collection)
    return docs.filter(reduce(lambda a, b: a & b, conditions, F.lit(True)))


def sort_keys(field: Field, descending: bool = False) -> list[Column]:
    """Missing values first (last, if descending), then false and true, numbers, and texts by Unicode's order."""
    rank = F.when(~field.present | F.is_variant_null(field.variant), 0).when(field.kind == "BOOLEAN", 1).when(field.number.isNotNull(), 2).otherwise(3)
    keys = [rank, F.coalesce(field.number, field.boolean.cast("double")), F.collate(field.text, "UNICODE")]
    return [k.desc_nulls_last() if descending else k.asc_nulls_first() for k in keys]


def page(df: DataFrame, order: list[Column], offset: int = 0, limit: int = 0, tiebreak: str = "id") -> DataFrame:
    """Rows from ``offset`` in order; limit 0 is all. With a limit the plan is a top-k: no global sort."""
    if offset < 0 or limit < 0:
        raise ValueError("offset and limit can't be negative")
    df = df.orderBy(*order, tiebreak)
    df = df.offset(offset) if offset else df
    return df.limit(limit) if limit else df


def page_info(df: DataFrame, offset: int, limit: int) -> DataFrame:
    """(total, returned, has_more) of a page."""
    n = F.count("*")
    left = F.greatest(n - offset, F.lit(0))
    returned = F.least(left, F.lit(limit)) if limit else left
    return df.agg(n.alias("total"), returned.alias("returned"), (returned + offset < n).alias("has_more"))


class Query:
    """Conditions, order and paging collected, then made a DataFrame. Entities marked deleted never show."""

    def __init__(self, entities: DataFrame, data: str = "data"):
        self.df = entities.filter(~F.col("deleted")) if "deleted" in entities.columns else entities
        self.data, self.order, self.skip, self.most = data, [], 0, 0

    def where(self, field: str, op: str, value) -> Query:
        self.df = self.df.filter(where(field, op, value, self.data))
        return self

    def order_by(self, field: str, direction: str = "asc") -> Query:
        if direction not in ("asc", "desc", ""):
            raise ValueError(f"unknown direction {direction!r}")
        descending = direction == "desc"
        if field in ENVELOPE:
            if field not in self.df.columns:
                raise ValueError(f"these rows have no {field!r}")
            self.order.append(F.desc_nulls_last(field) if descending else F.asc_nulls_first(field))
        else:
            self.order += sort_keys(Field(self.data, field.removeprefix("data.")), descending)
        return self

    def offset(self, n: int) -> Query:
        self.skip = n
        return self

    def limit(self, n: int) -> Query:
        self.most = n
        return self

    def rows(self) -> DataFrame:
        return page(self.df, self.order, self.skip, self.most)

    def total(self) -> int:
        return self.df.count()

    def by_id(self, entity: str) -> DataFrame:
        return self.df.filter(F.col("id") == entity)

    def between(self, field: str, low=None, high=None, include_low: bool = True, include_high: bool = True) -> Query:
        if low is not None:
            self.where(field, "gte" if include_low else "gt", low)
        if high is not None:
            self.where(field, "lte" if include_high else "lt", high)
        return self

    def aggregate(self, kind: str, field: str | None = None) -> DataFrame:
        from .aggregate import aggregated

        return aggregated(self.df, kind, field, self.data)
