"""Python functions of documents, by Arrow batches."""

from __future__ import annotations

from collections.abc import Callable
from datetime import date, datetime, time, timezone
from decimal import Decimal
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import values as V


def value(x: Any, t: T.DataType, tag: str | None = None) -> Any:
    """A document's value from one of an Arrow batch: nulls stay None, integers stay integers."""
    if x is None:
        return None
    if isinstance(t, T.StructType):
        return {f.name: value(x[f.name], f.dataType, (f.metadata or {}).get("kind")) for f in t.fields}
    if isinstance(t, T.ArrayType):
        return [value(y, t.elementType) for y in x]
    if isinstance(t, T.MapType):
        return {k: value(y, t.valueType) for k, y in (x.items() if isinstance(x, dict) else x)}
    if tag == "id":
        return V.DocId(x)
    if tag == "time":
        us = x // 1000
        return time(us // 3_600_000_000, us // 60_000_000 % 60, us // 1_000_000 % 60, us % 1_000_000)
    if isinstance(x, datetime):
        return x.replace(tzinfo=timezone.utc) if x.tzinfo is None else x.astimezone(timezone.utc)
    if isinstance(x, Decimal) and not isinstance(x, date):
        return float(x)
    return x


def on_documents(function: Callable[[dict], Any], schema: T.StructType, returns: str) -> Column:
    """A column of ``function`` of the documents that these fields make, in whole Arrow batches."""
    import pyarrow as pa

    kind = {"boolean": pa.bool_(), "double": pa.float64()}[returns]
    fields = list(schema.fields)
    always = "_"
    while any(f.name.lower() == always.lower() for f in fields):
        always += "_"

    def run(batch):  # noqa: ANN001, ANN202
        docs = batch.to_pylist()
        return pa.array([function({f.name: value(d[f.name], f.dataType, (f.metadata or {}).get("kind")) for f in fields}) for d in docs], kind)

    run.__annotations__ = {"batch": pa.Array, "return": pa.Array}
    # a struct needs a field even if the function asks for none
    return F.arrow_udf(run, returns)(F.struct(F.lit(True).alias(always), *[F.col(f"`{f.name}`") for f in fields]))
