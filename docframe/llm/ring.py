"""Long SimHashes of shingle sets, and the pigeonring search for those that may be alike.

A set's SimHash has WORDS * 64 bits, a ring of 16-bit segments.  Sets of Jaccard likeness 0.8 differ
in 0.15 of their bits.  If two rings differ in at most SHARE bits a segment all around, there is a
start from which every run of l segments differs in at most l * SHARE bits (the pigeonring principle).
Starts whose first segment is equal are the bucket keys; a pair is dropped from a bucket unless the
runs of 2, 4 and 8 segments keep within their share.  A start of two sets of likeness 0.8 does so with
probability 0.070, one of the 128 starts with 0.9999.  Sets of fewer than SMALL shingles have
two such rings, as their bits differ more often.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import give_back

WORDS, SHARE, SMALL = 32, 3.4, 40
SEGMENTS = WORDS * 4
RUNS = (2, 4, 8)
#: Rings of likeness 0.8 differ in 310 bits, with a deviation of 16.
MOST_BITS = 384
#: Rows of a bucket that are compared by their distance in it; members of larger ones in blocks.
NEIGHBOURS = 64
#: Comparisons made within a bucket; members of a bucket that needs more all stay.
COMPARISONS = 1 << 24
#: Bytes of rows that are worked on at a time, about; lists of rings take several times as much.
HELD_BYTES = 12 << 20
TURNS = 3
_ALL = ~np.uint64(0)


def _words(shingles: np.ndarray, first: int) -> np.ndarray:
    """WORDS hashes of 64 bits of every shingle, one row a word."""
    x = shingles[None, :] + (np.arange(first, first + WORDS, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))[:, None]
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB), (31, 1)):
        x ^= x >> np.uint64(shift)
        x *= np.uint64(factor)
    return x


def simhash(shingles: np.ndarray, first: int = 0) -> np.ndarray:
    """WORDS * 64 bits: each is 1 if set in over half the shingles' hashes.

    The counts of all bits are added up side by side: ``planes[k]`` has the bits of weight 2^k.
    """
    planes, level = [], [_words(shingles, first)]
    while level:
        x, level = np.concatenate(level, axis=1), []
        while x.shape[1] > 2:
            m = x.shape[1] // 3
            a, b, c = x[:, :m], x[:, m : 2 * m], x[:, 2 * m : 3 * m]
            odd = a ^ b
            level.append((a & b) | (odd & c))
            x = np.concatenate([odd ^ c, x[:, 3 * m :]], axis=1)
        if x.shape[1] == 2:
            level.append(x[:, :1] & x[:, 1:])
            x = x[:, :1] ^ x[:, 1:]
        planes.append(x[:, 0])
    half = len(shingles) // 2
    more, same = np.zeros(WORDS, np.uint64), np.full(WORDS, _ALL)
    for k in range(len(planes) - 1, -1, -1):
        if half >> k & 1:
            same &= planes[k]
        else:
            more |= same & planes[k]
            same &= ~planes[k]
    return more


def rings(shingles: np.ndarray) -> bytes:
    """The rings of a set that is not empty, one after the other."""
    return b"".join(simhash(shingles, i * WORDS).tobytes() for i in range(1 + (len(shingles) < SMALL)))


def runs_of(ring: np.ndarray, starts: int) -> tuple[np.ndarray, np.ndarray]:
    """For each of the first starts of rings (rows of words): the four segments from there on, and the next four."""
    out = []
    for at in range(0, ring.shape[1] * 4, SEGMENTS):
        own = ring.view(np.uint16)[:, at : at + SEGMENTS]
        around = np.concatenate([own, own[:, :8]], axis=1)
        out.append(np.stack([around[:, i : i + 8] for i in range(min(starts, SEGMENTS))], axis=1))
    runs = np.ascontiguousarray(np.concatenate(out, axis=1)).view(np.uint64)
    return runs[:, :, 0], runs[:, :, 1]


def within_share(near: np.ndarray, further: np.ndarray) -> np.ndarray:
    """Do runs that differ in these bits (the four segments from a start on, the next four) keep within their share?"""
    pair, four = np.bitwise_count(near & np.uint64(0xFFFFFFFF)), np.bitwise_count(near)
    eight = four + np.bitwise_count(further)
    return (near & np.uint64(0xFFFF) == 0) & (pair <= int(RUNS[0] * SHARE)) & (four <= int(RUNS[1] * SHARE)) & (eight <= int(RUNS[2] * SHARE))


def may_be_alike(one: tuple, two: tuple, least: float) -> np.ndarray:
    """By (size, common) of two sets each: may they have the likeness?  ``common``, if not negative, is how
    many shingles a set shares with any other set that has such a number, at most."""
    (size, common), (other, others) = one, two
    most = np.where((common >= 0) & (others >= 0), np.minimum(common, others), np.minimum(size, other))
    return most * (1 + least) >= least * (size + other) - 1e-6


def _buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Tables of whole buckets from batches ordered by ``key``, of about HELD_BYTES unless a bucket has more."""
    give_back()
    held: list[pa.RecordBatch] = []
    size, again = 0, HELD_BYTES
    for batch in batches:
        held.append(batch)
        size += batch.nbytes
        if size < again:
            continue
        whole = pa.Table.from_batches(held)
        key = whole.column("key").to_numpy()
        cut = int(np.searchsorted(key, key[-1]))
        if cut:
            yield whole.slice(0, cut)
        held = whole.slice(cut).combine_chunks().to_batches()
        size = sum(x.nbytes for x in held)
        again = max(HELD_BYTES, 2 * size)
    if any(x.num_rows for x in held):
        yield pa.Table.from_batches(held)


def _by_key(rows: DataFrame) -> DataFrame:
    return rows.repartition("key").sortWithinPartitions("key")


def members(nodes: DataFrame, least: float, starts: int = SEGMENTS) -> DataFrame:
    """(key, fp): the buckets, by the first ``starts`` starts, and those in them that have a candidate there.

    ``nodes`` is (fp, size, common, class, rings).  A candidate is of another class, keeps the runs
    within their share and may be alike by ``may_be_alike``.
    """

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["key", "near", "further", "fp", "class", "size", "common"]
        for batch in batches:
            own = batch.column("rings").to_pylist()
            for words in (WORDS, 2 * WORDS):
                chosen = np.flatnonzero(np.fromiter((len(x) == words * 8 for x in own), bool, len(own)))
                for at in range(0, len(chosen), 256):
                    some = chosen[at : at + 256]
                    near, further = runs_of(np.frombuffer(b"".join(own[i] for i in some), np.uint64).reshape(-1, words), starts)
                    key = (near & np.uint64(0xFFFF)).astype(np.int32) + (np.arange(near.shape[1], dtype=np.int32) << 16)
                    every = np.repeat(some, near.shape[1])
                    rest = [batch.column(x).to_numpy(zero_copy_only=False)[every] for x in names[3:]]
                    yield pa.RecordBatch.from_arrays([pa.array(x.ravel()) for x in (key, near.view(np.int64), further.view(np.int64), *rest)], names)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _buckets(batches):
            key, near, further, group, size, common = (rows.column(x).to_numpy() for x in ("key", "near", "further", "class", "size", "common"))
            near, further = near.view(np.uint64), further.view(np.uint64)
            keep = np.zeros(len(key), bool)

            def found(i: np.ndarray, j: np.ndarray) -> np.ndarray:
                out = (group[i] != group[j]) & within_share(near[i] ^ near[j], further[i] ^ further[j])
                return out & may_be_alike((size[i], common[i]), (size[j], common[j]), least)

            begin = np.concatenate([[0], np.flatnonzero(key[1:] != key[:-1]) + 1])
            count = np.diff(np.append(begin, len(key)))
            left = np.repeat(np.where(count <= NEIGHBOURS, begin + count, 0), count) - np.arange(len(key))
            i, d = np.flatnonzero(left > 1), 1
            while len(i):
                yes = i[found(i, i + d)]
                keep[yes] = keep[yes + d] = True
                d += 1
                i = i[left[i] > d]
            for b in np.flatnonzero(count > NEIGHBOURS):
                own = np.arange(begin[b], begin[b] + count[b])
                names, place, n = np.unique(group[own], return_inverse=True, return_counts=True)
                strays = own[place != n.argmax()]
                if len(strays) * len(own) > COMPARISONS:
                    keep[own] = True
                    continue
                for at in range(0, len(strays), 64):
                    some = strays[at : at + 64]
                    yes = found(some[:, None], own[None, :])
                    keep[some[yes.any(axis=1)]] = True
                    keep[own[yes.any(axis=0)]] = True
            if keep.any():
                yield pa.RecordBatch.from_arrays([pa.array(key[keep]), pa.array(rows.column("fp").to_numpy()[keep])], ["key", "fp"])

    rows = nodes.select("fp", F.col("size").cast("int"), F.col("common").cast("int"), "class", "rings").mapInArrow(spread, "key int, near long, further long, fp long, class long, size int, common int")
    return _by_key(rows).mapInArrow(meet, "key int, fp long")


def _first(key: int, ring: bytes, others: list[bytes], words: int) -> np.ndarray:
    """Is the bucket of this key the first whose test the rings, of so many words, pass with each other?"""
    bits = np.frombuffer(ring, np.uint64)[:words] ^ np.frombuffer(b"".join(x[: words * 8] for x in others), np.uint64).reshape(-1, words)
    passed = within_share(*runs_of(bits, SEGMENTS))
    return passed.any(axis=1) & (passed.argmax(axis=1) == key >> 16)


def _turn(fp: np.ndarray) -> np.ndarray:
    """The turn of a member among TURNS, by its name: one in 64 is first, then seven, then all others."""
    mixed = fp.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(58)
    return np.where(mixed == 0, 0, np.where(mixed < 8, 1, 2))


def pairs(placed: DataFrame, least: float, turn: int | None) -> DataFrame:
    """(a, b, u, v): candidates of different classes within a bucket, the lesser fp first.

    ``placed`` is (key, fp, rep, size, common, class, rings).  Without a ``turn`` they are the bucket's hub,
    which shares most of its own, with all others.  Else those with a member of this turn and none of
    an earlier one, each in the first bucket where it passes.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _buckets(batches):
            key, fp, rep, size, common, group = (rows.column(x).to_numpy() for x in ("key", "fp", "rep", "size", "common", "class"))
            own, turns = rows.column("rings").to_pylist(), _turn(fp)
            words = np.fromiter((len(x) // 8 for x in own), np.int64, len(own))
            begin = np.concatenate([[0], np.flatnonzero(key[1:] != key[:-1]) + 1])
            for at, to in zip(begin, np.append(begin[1:], len(key))):
                every = np.arange(at, to)
                ring = np.frombuffer(b"".join(x[: WORDS * 8] for x in own[at:to]), np.uint64).reshape(-1, WORDS)
                chosen = every[turns[every] == turn]
                if turn is None:
                    share = np.where(common[every] < 0, size[every], common[every]) / size[every]
                    chosen = every[np.lexsort((fp[every], share))[-1:]]
                for i in chosen:
                    others = every[(group[every] != group[i]) & (fp[every] != fp[i])]
                    if turn is not None:
                        others = others[(turns[others] > turn) | (turns[others] == turn) & (fp[others] > fp[i])]
                    others = others[may_be_alike((size[i], common[i]), (size[others], common[others]), least)]
                    differ = np.bitwise_count(ring[i - at] ^ ring[others - at]).sum(axis=1, dtype=np.int64)
                    others = others[(differ <= MOST_BITS) | (np.minimum(size[others], size[i]) < SMALL)]
                    if turn is not None:
                        both = np.minimum(words[others], words[i])
                        some = [others[both == n][_first(int(key[at]), own[i], [own[j] for j in others[both == n]], n)] for n in (WORDS, 2 * WORDS) if (both == n).any()]
                        others = np.concatenate([others[:0], *some])
                    if len(others):
                        a, u = np.full(len(others), fp[i]), np.full(len(others), rep[i])
                        yield pa.RecordBatch.from_arrays([pa.array(f(x, y)) for x, y in ((a, fp[others]), (u, rep[others])) for f in (np.minimum, np.maximum)], ["a", "b", "u", "v"])

    wanted = placed.select("key", "fp", "rep", F.col("size").cast("int"), F.col("common").cast("int"), "class", "rings")
    return _by_key(wanted).mapInArrow(run, "a long, b long, u long, v long")
