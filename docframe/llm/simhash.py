"""Near-duplicate classes by 64-bit SimHash and pigeonring filtering.

A ring of ``SEGMENTS`` segments and a distance of at most ``MAX_BITS`` bits leave at least one
start from which every run of l consecutive segments differs in at most l * MAX_BITS / SEGMENTS
bits.  With five segments and two bits the first two segments of that run are equal: they are
the bucket key.  Runs of three and four segments may differ in one bit; pairs that break this
are dropped before the full comparison.  Large buckets are split by the third segment of the run,
where a member also visits the 12 or 13 values that differ from its own in one bit.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import shingles
from .common import LOWER_ASCII, join_lookup, materialize, small_batches
from .components import connected_components, kept_rows

SEGMENTS, MAX_BITS, SHINGLE_WORDS, SEED = 5, 2, 3, 42
WIDTHS = [64 // SEGMENTS + (i < 64 % SEGMENTS) for i in range(SEGMENTS)]
#: Members of a bucket that are compared pair by pair; a larger one is split by the next segment, and if
#: a part is still larger, its members meet at the points next to them: exact ways both.
PAIRWISE_BUCKET = 24


def simhash(text: str | None, n: int = SHINGLE_WORDS) -> int:
    """Signed 64-bit SimHash of a text: a bit is 1 if set in over half the shingle hashes."""
    import xxhash

    found = (text or "").encode("utf-8", "surrogatepass").translate(LOWER_ASCII).split()
    if not found:
        return 0
    digest = xxhash.xxh64_intdigest
    if len(found) < n:
        hashes = [digest(b" ".join(found), SEED)]
    else:
        hashes = [digest(b" ".join(x), SEED) for x in zip(*(found[i:] for i in range(n)))]
    every = np.array(hashes, dtype=">u8").view(np.uint8).reshape(-1, 8)
    ones = np.zeros(64, np.int64)
    for at in range(0, len(every), 1 << 15):
        ones += np.unpackbits(every[at : at + (1 << 15)], axis=1).sum(axis=0, dtype=np.uint32)
    return int(np.packbits(2 * ones > len(every)).view(">i8")[0])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        fps = [simhash(x.as_py()) for x in batch.column(1)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps, pa.int64())], ["doc_id", "fp"])


def fingerprints(docs: DataFrame, n: int = SHINGLE_WORDS) -> DataFrame:
    """(doc_id, fp) of every document; null, empty and blank texts have fingerprint 0."""
    small_batches(docs.sparkSession)
    if n == SHINGLE_WORDS:
        run = _fingerprints
    else:

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                fps = [simhash(x.as_py(), n) for x in batch.column(1)]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps, pa.int64())], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, fp long")


def _mask(i: int) -> int:
    """The bits of segment i (counted from the low end), as a signed long."""
    low = sum(WIDTHS[:i])
    bits = ((1 << WIDTHS[i]) - 1) << low
    return bits - (1 << 64) if bits >= 1 << 63 else bits


def _signed(bits: int) -> int:
    return bits - (1 << 64) if bits >= 1 << 63 else bits


def _differs(xor: Column, segments: list[int]) -> Column:
    return F.bit_count(xor.bitwiseAND(F.lit(_signed(sum(_mask(i) % (1 << 64) for i in segments)))))


def _viable(xor: Column, start: Column) -> Column:
    """Do all runs from this start keep within their share of MAX_BITS?"""
    out = F.lit(False)
    for i in range(SEGMENTS):
        runs = [[(i + k) % SEGMENTS for k in range(size)] for size in range(1, SEGMENTS + 1)]
        inside = F.lit(True)
        for run in runs[2:]:
            inside = inside & (_differs(xor, run) <= len(run) * MAX_BITS // SEGMENTS)
        out = out | ((start == i) & inside)
    return out


def _bits_of(*segments: int) -> int:
    return sum(_mask(i % SEGMENTS) % (1 << 64) for i in segments)


def _by_start(make) -> Column:
    """The value that ``make`` gives for each start."""
    out = make(SEGMENTS - 1)
    for i in range(SEGMENTS - 1):
        out = F.when(F.col("start") == i, make(i)).otherwise(out)
    return out


def _flips(bits: int) -> Column:
    """No flip, and one for each of the bits."""
    return F.array(*[F.lit(x).cast("long") for x in [0, *(_signed(1 << b) for b in range(64) if bits >> b & 1)]])


def link_fingerprints(reps: DataFrame) -> DataFrame:
    """(fp, rep) with distinct fp -> edges (u, v) of reps, enough to join all within MAX_BITS.

    Buckets of up to PAIRWISE_BUCKET members compare their pairs.  The members of a larger one are
    dealt by their third segment, and each visits the values next to its own: pairs of a member at
    home with another or a visitor pass the chain test, then the full one.  In a part that is still
    too large the members at home go on to the points next to them in the last two segments, and
    visitors, that have a bit less to spare, stay where they are.  All that meet at a point are
    within two bits, so they are linked to the least of them; and any two within two bits whose
    runs keep their budget from this start meet.  That grows with the part, not with its square.
    """
    key = F.col("fp").bitwiseAND(_by_start(lambda i: F.lit(_signed(_bits_of(i, i + 1)))))
    keyed = reps.select("fp", "rep", F.explode(F.array(*map(F.lit, range(SEGMENTS)))).alias("start")).withColumn("key", key)
    sizes = keyed.groupBy("start", "key").agg(F.count("*").alias("members")).where("members > 1")
    keyed = materialize(join_lookup(keyed, sizes, ["start", "key"]), "buckets")
    xor = F.col("a.fp").bitwiseXOR(F.col("b.fp"))
    alike = (F.col("a.fp") < F.col("b.fp")) & _viable(xor, F.col("a.start")) & (F.bit_count(xor) <= MAX_BITS)

    few = keyed.where(F.col("members") <= PAIRWISE_BUCKET)
    a, b = few.alias("a"), few.alias("b")
    pairs = a.join(b, (F.col("a.start") == F.col("b.start")) & (F.col("a.key") == F.col("b.key")) & alike).select(F.col("a.rep").alias("u"), F.col("b.rep").alias("v"))

    many = keyed.where(F.col("members") > PAIRWISE_BUCKET)
    if many.isEmpty():
        return pairs
    third = many.select("start", "fp", "rep", F.explode(_by_start(lambda i: _flips(_bits_of(i + 2)))).alias("flip"))
    third = third.select("start", "fp", "rep", (F.col("flip") == 0).alias("home"), F.col("fp").bitwiseXOR(F.col("flip")).alias("at"))
    third = third.withColumn("part", F.col("at").bitwiseAND(_by_start(lambda i: F.lit(_signed(_bits_of(i, i + 1, i + 2))))))
    sizes = third.groupBy("start", "part").agg(F.count("*").alias("members"), F.max("home").alias("lived")).where("members > 1 and lived").drop("lived")
    third = materialize(join_lookup(third, sizes, ["start", "part"]), "parts")
    few = third.where(F.col("members") <= PAIRWISE_BUCKET)
    a, b = few.where("home").alias("a"), few.alias("b")
    split = a.join(b, (F.col("a.start") == F.col("b.start")) & (F.col("a.part") == F.col("b.part")) & alike).select(F.col("a.rep").alias("u"), F.col("b.rep").alias("v"))

    flips = F.when(F.col("home"), _by_start(lambda i: _flips(_bits_of(i + 3, i + 4)))).otherwise(F.array(F.lit(0).cast("long")))
    points = third.where(F.col("members") > PAIRWISE_BUCKET).select("start", "at", "rep", F.explode(flips).alias("flip"))
    points = points.select("start", F.col("at").bitwiseXOR(F.col("flip")).alias("point"), "rep")
    least = points.groupBy("start", "point").agg(F.min("rep").alias("v"), F.max("rep").alias("most")).where("v < most").drop("most")
    stars = join_lookup(points, least, ["start", "point"]).select(F.col("rep").alias("u"), "v").where("u <> v").distinct()
    return pairs.union(split).union(stars)


def near_duplicates(docs: DataFrame, n: int = SHINGLE_WORDS) -> DataFrame:
    """(doc_id, fingerprint, component_id) for every row of ``docs``.

    Documents whose fingerprints differ in at most MAX_BITS bits are linked; component_id is the
    smallest doc_id that links reach, itself included.  Equal fingerprints are one node, so copies
    are never paired.  Null, empty and blank texts share fingerprint 0 and link like any other;
    rows with a null doc_id get the component of their fingerprint (null if no other id has it).
    Repeated rows are kept.  An empty table gives an empty result.
    """
    fps = materialize(fingerprints(docs, n), "simhash")
    reps = materialize(fps.groupBy("fp").agg(F.min("doc_id").alias("rep")).where("rep is not null"), "reps")
    found = connected_components(link_fingerprints(reps))
    classes = reps.join(found, reps["rep"] == found["id"], "left").select("fp", F.coalesce("component", "rep").alias("component_id"))
    return join_lookup(fps, classes, ["fp"], "left").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, least: float | None = None, n: int = SHINGLE_WORDS) -> DataFrame:
    """``docs`` with one row of each class, as ``kept_rows`` chooses it.

    Classes are those of ``near_duplicates``.  With ``least`` they are those of texts whose shingles
    have that Jaccard likeness at least: texts of likeness 0.8 differ in about ten of 64 bits, so
    ``shingles.classes`` takes longer SimHashes to the pigeonring search, and whole sets decide.
    """
    return kept_rows(docs, near_duplicates(docs, n) if least is None else shingles.classes(docs, least, n))
