"""Connected components by alternating large and small stars, as DataFrame joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.names import fresh
from .common import discard, materialize

#: So many edges are one task's work in a round; more are dealt to all tasks.
FEW_EDGES = 20_000


def _stars(sym: DataFrame, keep_larger: bool) -> DataFrame:
    """From pairs (u, v): link the chosen neighbours of each u to the least of them and u."""
    if not keep_larger:
        sym = sym.where("v <= u")
    least = sym.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    joined = sym.join(least, "u")
    if keep_larger:
        out = joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        own = least.select("u", F.col("m").alias("v"))
        out = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).union(own)
    return out.where("u <> v").distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """Rows (u, v) of longs, any direction -> (id, component): the least id reachable.

    Only ids that have an edge to another id appear.  Rounds grow with the logarithm of the
    longest path.  Every round is a table in the shared folder; the driver sees one count and
    one checksum of it.  Nulls and loops are ignored; an empty input gives an empty result.
    """
    pairs = edges.select(F.col("u").cast("long"), F.col("v").cast("long")).where("u <> v")
    current = materialize(pairs.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    table, seen, number = current, None, current.count()
    while True:
        if number <= FEW_EDGES:
            current = current.coalesce(1)
        sym = current.union(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        last, current = table, materialize(_stars(_stars(sym, True), False), "edges")
        table = current
        discard(last)
        now = current.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == seen:
            break
        seen, number = now, now[0]
    ids = current.select(F.col("u").alias("id"), F.col("v").alias("component"))
    return ids.union(current.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())


def kept_rows(docs: DataFrame, found: DataFrame) -> DataFrame:
    """``docs`` with one row of each class of ``found`` (doc_id, component_id): that of the smallest doc_id.

    Rows that repeat a kept doc_id are dropped but for one, with the least text (null first).  Rows
    with a null doc_id name no document and stay.  All columns pass through.
    """
    kept, nth = fresh(docs.columns, "kept", "nth")
    ids = found.select(F.col("component_id").alias(kept)).distinct()
    own = docs.join(ids, F.col("doc_id").cast("long") == F.col(kept), "left_semi")
    first = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.col("text").asc_nulls_first()))
    return own.withColumn(nth, first).where(F.col(nth) == 1).drop(nth).unionByName(docs.where("doc_id is null"))
