"""Mixing sources to target weights by Pfair scheduling.

Each source's documents stand in a fixed random order and are cut into blocks of ``BLOCK``.  With
weights that sum to 1, block j = 1, 2, ... of a source of weight w may run from slot
floor((j - 1) / w) and must run before slot ceil(j / w).  In every slot the earliest deadline among
the released blocks runs.  That meets all deadlines, so in any prefix each source has less than
one block more or less than its weight asks for.  When a source is used up, the others' weights
are scaled up to 1 and a new phase begins.  No document is dropped or repeated.

Weights are whole parts of a cycle: after that many slots every source stands where it began, and
the schedule repeats.  So one cycle of each phase tells the slot of any block, and the driver's
work depends on the sources and the cycle, not on the number of documents.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.names import fresh

#: Documents of a block.
BLOCK = 1
#: Parts that weights are rounded to; a cycle has about as many slots.
PRECISION = 1 << 14
#: Documents whose places in their source are counted together.
RANK_GROUP = 4096
#: Rows of all cycles that are broadcast at most (about 24 bytes each); more are joined by a shuffle.
BROADCAST_ROWS = 1 << 20


@dataclass
class Phase:
    """One set of sources that still have blocks, its cycle, and where it begins."""

    slot: int  # of its first block
    parts: dict[int, int]
    done: dict[int, int]  # blocks of each source before the phase
    took: dict[int, int]  # and in it
    order: np.ndarray  # the source of every slot of the cycle, as far as the phase runs

    @property
    def cycle(self) -> int:
        return sum(self.parts.values())


def cycle_order(parts: dict[int, int], slots: int) -> np.ndarray:
    """The source of each of the first ``slots`` slots of a cycle, earliest deadline first.

    Exact integer arithmetic; equal deadlines go by source number.
    """
    whole = sum(parts.values())
    out = np.empty(slots, np.int64)
    count = dict.fromkeys(parts, 0)
    waiting = [(0, i) for i in sorted(parts)]
    ready: list[tuple[int, int]] = []
    for now in range(slots):
        while waiting and waiting[0][0] <= now:
            _, i = heapq.heappop(waiting)
            heapq.heappush(ready, (-(-(count[i] + 1) * whole // parts[i]), i))
        _, i = heapq.heappop(ready)
        out[now] = i
        count[i] += 1
        heapq.heappush(waiting, (count[i] * whole // parts[i], i))
    return out


def schedule(blocks: list[int], parts: list[int]) -> list[Phase]:
    """The phases of mixing blocks[i] blocks of each source i with weight parts[i]."""
    left, done, slot, out = list(blocks), [0] * len(blocks), 0, []
    while any(left):
        active = {i: parts[i] for i, n in enumerate(left) if n}
        whole = sum(active.values())
        order = cycle_order(active, min(whole, sum(left)))
        places = {i: np.flatnonzero(order == i) for i in active}
        # the phase ends with the last block of the source that is used up first; blocks beyond what
        # was scheduled end later than all that was
        ends = [(left[i] - 1) // p * whole + int(places[i][(left[i] - 1) % p]) + 1 for i, p in active.items() if (left[i] - 1) % p < len(places[i])]
        length = min(ends)
        cycles, rest = divmod(length, whole)
        head = np.bincount(order[:rest], minlength=len(blocks))
        took = {i: cycles * p + int(head[i]) for i, p in active.items()}
        out.append(Phase(slot, active, {i: done[i] for i in active}, took, order[: min(whole, length)]))
        for i, n in took.items():
            left[i] -= n
            done[i] += n
        slot += length
    return out


def whole_parts(weights: list[float], precision: int = PRECISION) -> list[int]:
    """Weights above 0, of any scale, as numbers of parts; one that comes to less than half a part is an error."""
    if any(not 0 < w < float("inf") for w in weights):
        raise ValueError("target weights must be above 0")
    scale = sum(weights)
    out = [round(w / scale * precision) for w in weights]
    if not all(out):
        raise ValueError(f"a target weight is less than half of 1 / {precision} of all")
    return out


def tempered(counts: dict[str | None, int], power: float = 0.5, precision: int = PRECISION) -> dict[str | None, float]:
    """Target weights in proportion to the sources' sizes to that power, none below 1 / ``precision`` of all."""
    sizes = {k: n**power for k, n in counts.items()}
    least = sum(sizes.values()) / precision
    return {k: max(x, least) for k, x in sizes.items()}


def _div(a: Column, b: Column) -> Column:
    return F.call_function("div", a, b)


def mix(docs: DataFrame, weights: dict[str | None, float] | None = None, block: int = BLOCK, seed: int = 5, precision: int = PRECISION) -> DataFrame:
    """Every row of ``docs`` (doc_id, source) with its place in the mix.

    Returns doc_id, source, block (of the source), phase, slot, release, deadline and position
    (0, 1, ... without gaps over all rows).  ``weights`` maps every source (None: null source) to
    its target; by default ``tempered``.  A source that it lacks is an error, as is a weight too
    small for ``precision``.  The order within a source is that of the MD5 of seed and doc_id, then
    doc_id.  Rows that are equal in both take any order among themselves.  The driver gets a row
    per source and makes at most one cycle for each of them (about 2 microseconds a slot).
    Hot sources are ranked in groups of hash ranges, so no task holds a source.  An empty table
    gives an empty result.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"))
    key = F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("n"))
    hashed = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    rows = rows.select("doc_id", "source", key.alias("key"), hashed.alias("hash"))
    counts = {r["key"]: r["n"] for r in rows.groupBy("key").agg(F.count("*").alias("n")).collect()}
    names = "doc_id long, source string, block long, phase long, slot long, release long, deadline long, position long"
    if not counts:
        return spark.createDataFrame([], names)
    keys = sorted(counts)
    named = {k: None if k == "n" else k[1:] for k in keys}
    precision = max(precision, 8 * len(keys))
    weights = tempered({named[k]: counts[k] for k in keys}, precision=precision) if weights is None else weights
    if missing := [named[k] for k in keys if named[k] not in weights]:
        raise ValueError(f"no target weight for sources {missing[:5]}")
    total = sum(counts.values())
    blocks = [-(-counts[k] // block) for k in keys]
    phases = schedule(blocks, whole_parts([weights[named[k]] for k in keys], precision))

    # a row for each block of a cycle: the source's nth in it, and its slot there
    parts_of: list[tuple[np.ndarray, ...]] = []
    for n, p in enumerate(phases):
        by_source = np.argsort(p.order, kind="stable")
        source = p.order[by_source]
        nth = np.arange(len(source)) - np.searchsorted(source, source)
        parts_of.append((np.full(len(source), n), source, nth, by_source))
    cycles = pa.table([pa.array(np.concatenate([x[i] for x in parts_of]).astype(np.int64)) for i in range(4)], ["phase", "src", "nth", "in_cycle"])
    # a row for each source of a phase, an array by source: its first block, parts, and the phase's numbers
    spans = [[(p.done[i], n, p.parts[i], p.cycle, p.slot) for n, p in enumerate(phases) if i in p.parts] for i in range(len(keys))]
    sources = spark.createDataFrame([(k, i, [tuple(map(int, x)) for x in spans[i]]) for i, k in enumerate(keys)], "key string, src long, spans array<struct<done:long,phase:long,parts:long,cycle:long,begin:long>>")
    # blocks that are not full are the last of their source: how many documents the ones before a slot lack
    lacking = []
    for i, k in enumerate(keys):
        if lack := blocks[i] * block - counts[k]:
            p = next(p for p in reversed(phases) if p.took.get(i))
            at = blocks[i] - 1 - p.done[i]
            lacking.append((p.slot + at // p.parts[i] * p.cycle + int(np.flatnonzero(p.order == i)[at % p.parts[i]]), lack))

    groups = 1 << max(0, (total // RANK_GROUP).bit_length())
    rows = rows.withColumn("group", F.pmod(F.conv(F.substring("hash", 1, 8), 16, 10).cast("long") * groups / (1 << 32), F.lit(groups)).cast("long"))
    before = Window.partitionBy("key").orderBy("group").rowsBetween(Window.unboundedPreceding, -1)
    sizes = rows.groupBy("key", "group").agg(F.count("*").alias("n")).select("key", "group", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    within = F.row_number().over(Window.partitionBy("key", "group").orderBy("hash", "doc_id")) - 1
    ranked = rows.withColumn("within", within).join(sizes, ["key", "group"]).withColumn("rank", F.col("before") + F.col("within"))
    ranked = ranked.withColumn("block", F.floor(F.col("rank") / block).cast("long"))
    small = len(cycles) + sum(map(len, spans)) <= BROADCAST_ROWS
    ranked = ranked.join(F.broadcast(sources) if small else sources, "key")
    span = F.element_at(F.filter("spans", lambda s: s["done"] <= F.col("block")), -1)
    ranked = ranked.withColumn("span", span).drop("spans").select("*", (F.col("block") - F.col("span.done")).alias("own"))
    ranked = ranked.select("*", F.col("span.phase").alias("phase"), (F.col("own") % F.col("span.parts")).alias("nth"))
    cycles = spark.createDataFrame(cycles)
    out = ranked.join(F.broadcast(cycles) if small else cycles, ["phase", "src", "nth"])
    begin, parts, cycle = F.col("span.begin"), F.col("span.parts"), F.col("span.cycle")
    slot = begin + _div(F.col("own"), parts) * cycle + F.col("in_cycle")
    out = out.select("doc_id", "source", "rank", "block", "phase", slot.alias("slot"), (begin + _div(F.col("own") * cycle, parts)).alias("release"), (begin + _div((F.col("own") + 1) * cycle + parts - 1, parts)).alias("deadline"))
    short = F.lit(0).cast("long")
    if lacking:
        array = F.array(*[F.struct(F.lit(s).cast("long").alias("slot"), F.lit(n).cast("long").alias("lack")) for s, n in lacking])
        short = F.aggregate(array, F.lit(0).cast("long"), lambda acc, x: acc + F.when(x["slot"] < F.col("slot"), x["lack"]).otherwise(0))
    position = F.col("slot") * block - short + F.col("rank") - F.col("block") * block
    return out.select("doc_id", "source", "block", "phase", "slot", "release", "deadline", position.alias("position"))


def in_order(docs: DataFrame, weights: dict[str | None, float] | None = None) -> DataFrame:
    """``docs`` with all its rows and columns, sorted by their place in the mix over all partitions.

    Rows are matched by doc_id and source; rows that repeat both stay as many as they are.
    """
    d, s, at = fresh(docs.columns, "d", "s", "position")
    places = mix(docs, weights).groupBy("doc_id", "source").agg(F.min("position").alias(at)).select(F.col("doc_id").alias(d), F.col("source").alias(s), at)
    joined = docs.join(places, F.col("doc_id").cast("long").eqNullSafe(F.col(d)) & F.col("source").cast("string").eqNullSafe(F.col(s)))
    # sampled range edges keep neighbours together; the sort makes each file one stretch of the mix
    return joined.repartitionByRange(at).sortWithinPartitions(at, d).drop(d, s, at)
