"""Near copies by the Jaccard likeness of word shingles: SimHash and pigeonring find candidates, whole sets decide.

A text is the set of its ``SHINGLE_WORDS``-word shingles (one of all its words if it has fewer),
hashed to 64 bits.  The set's SimHash is a ring of 2048 bits (``ring.py``), as 64 are too few to tell
0.8 from less.  Every pair that the pigeonring search finds, and that could still join two
classes, is decided by its whole sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import ring
from .common import LOWER_ASCII, join_lookup, materialize, small_batches
from .components import connected_components

SHINGLE_WORDS, LEAST_LIKENESS, SEED = 5, 0.8, 42
#: The sets in larger buckets are looked through for shingles that no other there has.
PAIRWISE_BUCKET = 24
#: Starts of the ring by which crowds of copies are made classes before the others are tried.
FIRST_STARTS = 8
#: Shingles of a crowd that a task holds before it counts them.
HELD_SHINGLES = 1 << 20


def shingle_set(text: str | None, n: int = SHINGLE_WORDS) -> np.ndarray:
    """The different shingles of a text as ascending 64-bit hashes; none for null and blank texts."""
    import xxhash

    found = (text or "").encode("utf-8", "surrogatepass").translate(LOWER_ASCII).split()
    if not found:
        return np.zeros(0, np.uint64)
    digest = xxhash.xxh64_intdigest
    if len(found) < n:
        return np.array([digest(b" ".join(found), SEED)], np.uint64)
    return np.unique(np.array([digest(b" ".join(x), SEED) for x in zip(*(found[i:] for i in range(n)))], np.uint64))


def _name(shingles: np.ndarray) -> int:
    """One signed 64-bit name of a set; 0 for the empty one."""
    import xxhash

    found = xxhash.xxh64_intdigest(shingles.tobytes(), SEED) if len(shingles) else 0
    return found - (1 << 64) if found >> 63 else found


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)


def _described(docs: DataFrame, n: int) -> DataFrame:
    """(doc_id, fp, size, rings) of every row: its set's name, size and SimHash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shingle_set(text.as_py(), n) for text in batch.column(1)]
            rings = [ring.rings(x) if len(x) else b"" for x in found]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(map(_name, found), pa.int64()), pa.array(map(len, found), pa.int64()), pa.array(rings, pa.binary())], ["doc_id", "fp", "size", "rings"])

    small_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, fp long, size long, rings binary")


def _sets(docs: DataFrame, wanted: DataFrame, n: int) -> DataFrame:
    """(fp, set) of the wanted (fp, rep)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shingle_set(x.as_py(), n) for x in batch.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array(map(_name, found), pa.int64()), pa.array([x.tobytes() for x in found], pa.binary())], ["fp", "set"])

    rows = docs.select(F.col("doc_id").cast("long").alias("rep"), F.col("text").cast("string").alias("text")).join(wanted, "rep", "left_semi")
    # a repeated id may stand for several texts
    found = rows.select("text").mapInArrow(run, "fp long, set binary").join(wanted, "fp", "left_semi")
    return found.groupBy("fp").agg(F.first("set").alias("set"))


def _linked(pairs: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """The pairs (a, b, u, v) whose sets are alike, as edges (u, v)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            whole = lambda x: np.frombuffer(x.as_py(), np.uint64)
            keep = [likeness(whole(x), whole(y)) >= least for x, y in zip(batch.column(2), batch.column(3))]
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    one, two = sets.select(F.col("fp").alias("a"), F.col("set").alias("set_a")), sets.select(F.col("fp").alias("b"), F.col("set").alias("set_b"))
    return pairs.distinct().join(one, "a").join(two, "b").select("u", "v", "set_a", "set_b").mapInArrow(run, "u long, v long")


def _common(crowd: DataFrame, sets: DataFrame) -> DataFrame:
    """(fp, common) of every fp of ``crowd``: how many of a set's shingles another set of the crowd has too."""

    def told(fps: list[int], sets: list[np.ndarray]) -> pa.RecordBatch:
        every, at, n = np.unique(np.concatenate(sets), return_index=True, return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(every), pa.array(np.repeat(fps, list(map(len, sets)))[at]), pa.array(n)], ["shingle", "fp", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fps, found, rows = [], [], 0
        for batch in batches:
            for fp, whole in zip(batch.column(0).to_pylist(), batch.column(1)):
                fps.append(fp)
                found.append(np.frombuffer(whole.as_py(), np.int64))
                rows += len(found[-1])
                if rows > HELD_SHINGLES:
                    yield told(fps, found)
                    fps, found, rows = [], [], 0
        if fps:
            yield told(fps, found)

    own = sets.join(crowd, "fp", "left_semi")
    every = own.select("fp", "set").mapInArrow(run, "shingle long, fp long, n long")
    alone = every.groupBy("shingle").agg(F.sum("n").alias("n"), F.min("fp").alias("fp")).where("n = 1").groupBy("fp").agg(F.count("*").alias("alone"))
    own = own.select("fp", F.expr("octet_length(set) div 8").alias("size"))
    return own.join(alone, "fp", "left").select("fp", (F.col("size") - F.coalesce("alone", F.lit(0))).alias("common"))


def _placed(nodes: DataFrame, found: DataFrame | None) -> DataFrame:
    """``nodes`` with the ``class`` that the components found have so far; a node without one is its own."""
    if found is None:
        return nodes.withColumn("class", F.col("rep"))
    return nodes.join(found, nodes["rep"] == found["id"], "left").withColumn("class", F.coalesce("component", "rep")).drop("id", "component")


def classes(docs: DataFrame, least: float = LEAST_LIKENESS, n: int = SHINGLE_WORDS) -> DataFrame:
    """(doc_id, fp, component_id) for every row of ``docs`` (doc_id, text).

    Documents of likeness ``least`` or more are linked; component_id is the smallest doc_id that
    links reach.  Equal sets are one node.  First, members of the buckets of a few starts are compared with
    the one of their bucket that has the least of its own, which copies of one text are most alike to;
    so most of a crowd is one class.  Then all buckets give the pairs of different classes, each pair
    once: some members are compared with all others before the rest are, in ``ring.TURNS`` turns, and
    what they join is not compared again.  No candidate that could join two
    classes is left out.  Null ids get the component of their set.
    """
    rows = materialize(_described(docs, n), "shingles")
    nodes = materialize(rows.groupBy("fp").agg(F.min("doc_id").alias("rep"), F.first("size").alias("size"), F.first("rings").alias("rings")).where("rep is not null"), "nodes")
    nodes = nodes.withColumn("common", F.lit(-1).cast("long"))

    met = materialize(ring.members(_placed(nodes, None), least, FIRST_STARTS), "buckets")
    crowd = met.join(met.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > PAIRWISE_BUCKET), "key", "left_semi").select("fp").distinct()
    crowd = materialize(crowd, "crowd")
    sets = materialize(_sets(docs, nodes.join(met, "fp", "left_semi").select("fp", "rep"), n), "sets")
    common = materialize(_common(crowd, sets), "common")
    nodes = nodes.drop("common").join(common, "fp", "left").withColumn("common", F.coalesce("common", F.lit(-1).cast("long")))
    edges = materialize(_linked(ring.pairs(_placed(nodes, None).join(met, "fp"), least, None), sets, least), "links")
    found = connected_components(edges)

    met = materialize(ring.members(_placed(nodes, found), least), "buckets")
    nodes_met = materialize(nodes.join(met.select("fp").distinct(), "fp"), "nodes")
    sets = materialize(_sets(docs, nodes_met.select("fp", "rep"), n), "sets")
    for turn in range(ring.TURNS):
        more = materialize(_linked(ring.pairs(_placed(nodes_met, found).join(met, "fp"), least, turn), sets, least), "links")
        if not more.isEmpty():
            edges = edges.union(more)
            found = connected_components(edges)
    named = nodes.join(found, nodes["rep"] == found["id"], "left").select("fp", F.coalesce("component", "rep").alias("component_id"))
    return join_lookup(rows.select("doc_id", "fp"), named, ["fp"], "left").select("doc_id", "fp", "component_id")
