"""Typed looks into JSON documents. A VARIANT tells a missing key (null) from a JSON null, and a number from a text that looks like one."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NUMBER = r"^(BIGINT|DOUBLE|FLOAT|DECIMAL.*)$"


def path(field: str, dotted: bool = True) -> str:
    return "$" + "".join(f'["{p}"]' for p in (field.split(".") if dotted else [field]))


class Field:
    """One field of a VARIANT column: ``doc`` may be JSON text too."""

    def __init__(self, doc: str | Column, field: str, dotted: bool = True, parsed: bool = False):
        doc = F.col(doc) if isinstance(doc, str) else doc
        self.doc, self.path = doc if parsed else F.try_parse_json(doc), path(field, dotted)
        self.variant = F.try_variant_get(self.doc, self.path, "variant")
        self.kind = F.schema_of_variant(self.variant)

    @property
    def present(self) -> Column:
        return self.variant.isNotNull()

    @property
    def number(self) -> Column:
        """The value as double; null unless it is a JSON number."""
        return F.when(self.kind.rlike(NUMBER), F.try_variant_get(self.doc, self.path, "double"))

    @property
    def string(self) -> Column:
        return F.when(self.kind == "STRING", F.try_variant_get(self.doc, self.path, "string"))

    @property
    def boolean(self) -> Column:
        return F.when(self.kind == "BOOLEAN", F.try_variant_get(self.doc, self.path, "boolean"))

    @property
    def text(self) -> Column:
        """Any value as text."""
        return F.try_variant_get(self.doc, self.path, "string")

    def equals(self, value) -> Column:
        """Same type and value; a JSON null equals None; a missing key equals nothing. Never null."""
        if value is None:
            found = self.present & F.is_variant_null(self.variant)
        elif isinstance(value, bool):
            found = self.boolean == value
        elif isinstance(value, int | float):
            found = self.number == float(value)
        elif isinstance(value, str):
            found = self.string == value
        else:
            import json

            # objects and lists: equal if their normal forms are
            found = F.to_json(self.variant) == F.to_json(F.parse_json(F.lit(json.dumps(value))))
        return F.coalesce(found, F.lit(False))
