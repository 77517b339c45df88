"""Canonical JSON: keys sorted at every depth, no blanks, numbers as doubles, and < > & escaped."""

from __future__ import annotations

import json
import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Characters that are written as escapes.
ESCAPES = {"<": "\\u003c", ">": "\\u003e", "&": "\\u0026", " ": "\\u2028", " ": "\\u2029", "\n": "\\n", "\r": "\\r", "\t": "\\t", '"': '\\"', "\\": "\\\\", "\b": "\\b", "\f": "\\f"}


def _number(x: float) -> str:
    """The shortest digits; an exponent below 1e-6 and from 1e21, without a leading zero."""
    if x == 0:
        return "-0" if math.copysign(1, x) < 0 else "0"
    if 1e-6 <= abs(x) < 1e21:
        from decimal import Decimal

        text = format(Decimal(repr(x)), "f")
        return text.rstrip("0").rstrip(".") if "." in text else text
    digits, exponent = repr(x).split("e") if "e" in repr(x) else (repr(x), "+0")
    sign = exponent[0] if exponent[0] in "+-" else "+"
    return f"{digits.removesuffix('.0')}e{sign}{exponent.lstrip('+-0').zfill(2)}"


def _string(s: str) -> str:
    return '"' + "".join(ESCAPES.get(c) or (f"\\u{ord(c):04x}" if c < " " else c) for c in s) + '"'


def _written(x) -> str:
    if isinstance(x, dict):
        return "{" + ",".join(f"{_string(k)}:{_written(x[k])}" for k in sorted(x, key=lambda k: k.encode("utf-8", "surrogatepass"))) + "}"
    if isinstance(x, list):
        return "[" + ",".join(map(_written, x)) + "]"
    if isinstance(x, bool) or x is None:
        return {True: "true", False: "false", None: "null"}[x]
    return _number(float(x)) if isinstance(x, int | float) else _string(x)


def canonical(text: str | None) -> str | None:
    """Null for what isn't JSON."""
    try:
        return None if text is None else _written(json.loads(text))
    except (ValueError, RecursionError):
        return None


@F.pandas_udf(StringType())
def canonical_json(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for texts in batches:
        yield texts.map(canonical)
