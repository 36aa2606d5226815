"""Hidden Markov language model over hashed words.

A word w with symbol s(w) has probability P(s(w) | state) * P(w | s(w)).  States follow a Markov
chain; its parameters are trained by Baum-Welch, whose expected counts are summed over partitions.
P(w | s) is (c + 1) / (C + V + 1) with c the word's count in the training tokens, C and V the
symbol's tokens and different words there.  All words that training lacks share the last 1 of
their symbol.  The likelihood of a whole text comes from the scaled forward recursion.

Texts are read once, into blocks: rows of many documents with the block's own word list.  Counts
of words are joined to block word lists, not to tokens.  Every round of Baum-Welch goes over whole
training texts, all of them; what the driver gets of it has the size of the model.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_mod, LOWER_ASCII, materialize, small_batches

STATES, SYMBOLS = 8, 16_384
#: The end token's word and symbol; no word contains white space.
END, END_SYMBOL = b"\n", 0
#: Tokens of a block, about (a longer text is a block of its own).
BLOCK_TOKENS = 1_000_000
#: Tokens of a stretch: texts are worked on in stretches side by side, which are joined exactly.
STRETCH = 512
#: Tokens whose states are held at a time.
HELD_TOKENS = 1 << 20
#: Baum-Welch ends when a round adds less than GAIN to the log likelihood of a token, or after ROUNDS.
ROUNDS, GAIN = 6, 1e-3
#: Weight of the corpus' symbol distribution in every state's, in tokens.
PRIOR = 2000.0

_BLOCK = pa.schema([
    ("block", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("held", pa.list_(pa.bool_())), ("lengths", pa.list_(pa.int32())),
    ("low", pa.binary()), ("mid", pa.binary()), ("high", pa.binary()), ("top", pa.binary()), ("symbols", pa.binary()),
    ("words", pa.list_(pa.string())), ("counts", pa.list_(pa.int64())),
])
_BLOCK_SQL = "block long, doc_ids array<long>, held array<boolean>, lengths array<int>, low binary, mid binary, high binary, top binary, symbols binary, words array<string>, counts array<long>"


def symbol(word: bytes) -> int:
    return END_SYMBOL if word == END else 1 + zlib.crc32(word) % (SYMBOLS - 1)


class _Block:
    def __init__(self) -> None:
        self.local: dict[bytes, int] = {END: 0}
        self.docs: list = []
        self.held: list[bool] = []
        self.ids: list[np.ndarray] = []
        self.tokens = 0

    def add(self, doc_id, held: bool, text: str | None) -> None:
        local = self.local
        found = (text or "").encode("utf-8", "replace").translate(LOWER_ASCII).split()
        ids = [local.setdefault(w, len(local)) for w in found]
        ids.append(0)
        self.docs.append(doc_id)
        self.held.append(held)
        self.ids.append(np.array(ids, np.uint32))
        self.tokens += len(ids)

    def row(self, number: int) -> pa.RecordBatch:
        """Ids are stored as three planes of bytes, which compress better than whole numbers."""
        ids = np.concatenate(self.ids)
        lengths = [len(x) for x in self.ids]
        train = np.repeat(~np.array(self.held), lengths)
        counts = np.bincount(ids[train], minlength=len(self.local))
        symbols = np.fromiter(map(symbol, self.local), np.uint16, len(self.local))
        planes = [((ids >> s) & 255).astype(np.uint8).tobytes() for s in (0, 8, 16, 24)]
        values = [number, self.docs, self.held, lengths, *planes, symbols.tobytes(), [w.decode("utf-8") for w in self.local], counts]
        return pa.RecordBatch.from_arrays([pa.array([v], t.type) for v, t in zip(values, _BLOCK)], schema=_BLOCK)


def _encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    block, number = _Block(), TaskContext.get().partitionId() << 24
    for batch in batches:
        docs, held = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        for i, text in enumerate(batch.column(2)):
            block.add(docs[i], held[i], text.as_py())
            if block.tokens >= BLOCK_TOKENS:
                yield block.row(number)
                block, number = _Block(), number + 1
    if block.docs:
        yield block.row(number)


def encode(docs: DataFrame) -> DataFrame:
    """(doc_id, held, text) -> the table of blocks."""
    small_batches(docs.sparkSession)
    return materialize(docs.select("doc_id", "held", "text").mapInArrow(_encode, _BLOCK_SQL), "blocks")


_PLANES = ("low", "mid", "high", "top")


def _ids(planes: list[bytes]) -> np.ndarray:
    out = np.zeros(len(planes[0]), np.uint32)
    for i, x in enumerate(planes):
        out |= np.frombuffer(x, np.uint8).astype(np.uint32) << np.uint32(8 * i)
    return out


@dataclass
class Model:
    start: np.ndarray  # states
    move: np.ndarray  # states x states
    emit: np.ndarray  # symbols x states

    def sequences(self, symbols: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Natural log likelihood of every sequence of symbols, by the scaled forward recursion.

        Sequences stand one after the other in ``symbols``.  The longest come first, so those that
        still run are a prefix at every step.
        """
        order = np.argsort(-lengths, kind="stable")
        begins = (np.cumsum(lengths) - lengths)[order]
        sizes = lengths[order]
        running = np.searchsorted(-sizes, -np.arange(sizes[0] if len(sizes) else 0), side="left")
        total = np.zeros(len(lengths))
        alpha = np.tile(self.start, (len(lengths), 1))
        for t, n in enumerate(running):
            alpha = alpha[:n] if t == 0 else alpha[:n] @ self.move
            alpha = alpha * self.emit[symbols[begins[:n] + t]]
            scale = alpha.sum(axis=1)
            alpha /= scale[:, None]
            total[:n] += np.log(scale)
        out = np.empty(len(lengths))
        out[order] = total
        return out

    def expected(self, symbols: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
        """Expected counts (start, move, emit) of whole sequences, one after the other in ``symbols``,
        and their log likelihood.

        A sequence of more than STRETCH symbols is cut into stretches.  The product of a stretch's
        steps as one matrix carries the forward and backward variables over it, so every stretch
        gets its own exactly and all are worked on side by side.
        """
        k = len(self.start)
        first, move, emit = (x.astype(np.float32) for x in (self.start, self.move, self.emit))
        # emissions relative to the mean over states: products of steps stay near 1
        mean = emit.mean(axis=1, keepdims=True)
        near = emit / mean
        # a row a state: what is done for each state runs over stretches side by side in memory
        likely, onward = np.ascontiguousarray(near.T), np.ascontiguousarray(move.T)
        pieces = -(-lengths // STRETCH)
        doc = np.repeat(np.arange(len(lengths)), pieces)
        nth = np.arange(len(doc)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        begin = np.repeat(np.cumsum(lengths) - lengths, pieces) + nth * STRETCH
        size = np.minimum(lengths[doc] - nth * STRETCH, STRETCH)
        order = np.argsort(-size, kind="stable")
        order = order[size[order] > 0]

        def groups(chosen: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
            """(stretches, longest first; how many of them run at each step; where each step's states stand)"""
            ends = np.cumsum(size[chosen])
            at = 0
            while at < len(chosen):
                to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + HELD_TOKENS)))
                own = chosen[at:to]
                running = np.searchsorted(-size[own], -np.arange(size[own[0]]), side="left")
                yield own, running, np.concatenate([[0], np.cumsum(running)])
                at = to

        prior = np.tile(first, (len(doc), 1))  # state distribution before a stretch's first symbol
        before = np.zeros((len(doc), k), np.float32)  # and behind the stretch before it
        ahead = np.ones((len(doc), k), np.float32)  # likelihood of what follows a stretch, by its last state
        if (pieces > 1).any():
            whole = np.empty((len(doc), k, k), np.float32)
            for own, running, _ in groups(order[pieces[doc[order]] > 1]):
                m = likely[:, symbols[begin[own]]][:, None, :] * np.eye(k, dtype=np.float32)[:, :, None]
                for t in range(1, len(running) + 1):
                    n = running[t] if t < len(running) else 0
                    if n < m.shape[2]:
                        ended = m[:, :, n:]
                        whole[own[n : m.shape[2]]] = (ended / ended.sum(axis=(0, 1))).transpose(2, 1, 0)
                        m = np.ascontiguousarray(m[:, :, :n])
                    if n:
                        m = (onward @ m.reshape(k, k * n)).reshape(k, k, n)
                        m *= likely[:, symbols[begin[own[:n]] + t]][:, None, :]
                        if t % 4 == 0:
                            m /= m.sum(axis=(0, 1))
            for p in range(1, int(pieces.max())):
                now = np.flatnonzero(nth == p)
                end = np.einsum("ni,nij->nj", prior[now - 1], whole[now - 1])
                before[now] = end / end.sum(axis=1, keepdims=True)
                prior[now] = before[now] @ move
            for p in range(int(pieces.max()) - 1, 0, -1):
                now = np.flatnonzero(nth == p)
                back = np.einsum("nij,nj->ni", whole[now], ahead[now]) @ move.T
                ahead[now - 1] = back / back.sum(axis=1, keepdims=True)

        starts, moves, emits, total = np.zeros(k), np.zeros((k, k)), np.zeros((SYMBOLS, k)), 0.0
        with np.errstate(divide="ignore"):
            logs = np.log(mean[:, 0], dtype=np.float64)
        for own, running, place in groups(order):
            seen = np.empty(place[-1], np.int64)
            for t, n in enumerate(running):
                np.take(symbols, begin[own[:n]] + t, out=seen[place[t] : place[t] + n])
            states = np.empty((k, place[-1]), np.float32)
            scale = np.empty(place[-1], np.float32)
            for t, n in enumerate(running):
                at = slice(place[t], place[t] + n)
                alpha = prior[own].T if t == 0 else onward @ states[:, place[t - 1] : place[t - 1] + n]
                alpha = alpha * likely[:, seen[at]]
                alpha.sum(axis=0, out=scale[at])
                np.divide(alpha, scale[at], out=states[:, at])
            total += float(np.log(scale, dtype=np.float64).sum() + logs[seen].sum())
            beta = np.empty((k, len(own)), np.float32)
            inside = 0
            for t in range(len(running) - 1, -1, -1):
                n, at = running[t], slice(place[t], place[t] + running[t])
                # stretches that end here take up what follows them
                if n > inside:
                    following = ahead[own[inside:n]].T
                    beta[:, inside:n] = following / (states[:, place[t] + inside : place[t] + n] * following).sum(axis=0)
                    inside = n
                here = likely[:, seen[at]]
                here *= beta[:, :n]
                here /= scale[at]
                if t:
                    moves += states[:, place[t - 1] : place[t - 1] + n] @ here.T
                else:
                    later = nth[own] > 0
                    moves += before[own[later]].T @ here[:, later].T
                    starts += (states[:, at] * beta[:, :n])[:, ~later].sum(axis=1, dtype=np.float64)
                states[:, at] *= beta[:, :n]
                beta[:, :n] = move @ here
            for s in range(k):
                emits[:, s] += np.bincount(seen, weights=states[s], minlength=SYMBOLS)
        return starts, moves * self.move, emits, total

    def improved(self, start: np.ndarray, move: np.ndarray, emit: np.ndarray, background: np.ndarray) -> "Model":
        start, move = start + 1.0, move + 1.0
        emit = emit + PRIOR * background[:, None]
        return Model(start / start.sum(), move / move.sum(axis=1, keepdims=True), emit / emit.sum(axis=0))


def _training(row: dict) -> tuple[np.ndarray, np.ndarray]:
    """Symbols and lengths of a block's training documents."""
    lengths, held = np.array(row["lengths"], np.int64), np.array(row["held"], bool)
    own = np.repeat(~held, lengths)
    symbols = np.frombuffer(row["symbols"], np.uint16)[_ids([row[x] for x in _PLANES])[own]]
    return symbols.astype(np.int64), lengths[~held]


_READ = ["block", "held", "lengths", *_PLANES, "symbols"]


def gather(blocks: DataFrame, count) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """Sums of ``count(symbols, lengths)`` (start, move, emit, a number) over all blocks.  Each task
    returns a row per symbol and per state; the driver gets SYMBOLS + STATES + 2 rows, whatever the corpus."""
    k = STATES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        start, move, emit, number = np.zeros(k), np.zeros((k, k)), np.zeros((SYMBOLS, k)), 0.0
        for batch in batches:
            for i in range(batch.num_rows):
                found = count(*_training(batch.slice(i, 1).to_pylist()[0]))
                start, move, emit, number = start + found[0], move + found[1], emit + found[2], number + found[3]
        used = np.flatnonzero(emit.any(axis=1))
        if len(used):
            keys = np.concatenate([[-1], -2 - np.arange(k), [-2 - k], used]).astype(np.int32)
            flat = np.concatenate([start[None], move, np.full((1, k), number / k), emit[used]])
            values = pa.FixedSizeListArray.from_arrays(pa.array(flat.ravel()), k).cast(pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([pa.array(keys), values], ["key", "value"])

    parts = blocks.select(*_READ).mapInArrow(run, "key int, value array<double>")
    start, move, emit, number = np.zeros(k), np.zeros((k, k)), np.zeros((SYMBOLS, k)), 0.0
    for r in parts.groupBy("key").agg(F.array(*[F.sum(F.col("value")[s]) for s in range(k)]).alias("value")).collect():
        if r["key"] == -1:
            start += r["value"]
        elif r["key"] == -2 - k:
            number = float(sum(r["value"]))
        elif r["key"] < -1:
            move[-2 - r["key"]] += r["value"]
        else:
            emit[r["key"]] += r["value"]
    return start, move, emit, number


def sorted_apart(background: np.ndarray):
    """Counts for the first model: each document goes to one state, told by the signs of fixed random
    projections of its symbols, less those of the whole corpus."""
    bits = max(1, (STATES - 1).bit_length())
    directions = np.random.default_rng(4).choice([-1.0, 1.0], (SYMBOLS, bits)).astype(np.float32)
    directions -= (background @ directions).astype(np.float32)

    def count(symbols: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
        start, emit = np.zeros(STATES), np.zeros((SYMBOLS, STATES))
        if len(symbols):
            signs = np.add.reduceat(directions[symbols], np.cumsum(lengths) - lengths, axis=0, dtype=np.float64) > 0
            state = (signs @ (1 << np.arange(bits))) % STATES
            start += np.bincount(state, minlength=STATES)
            of_token = np.repeat(state, lengths)
            for s in range(STATES):
                emit[:, s] += np.bincount(symbols[of_token == s], minlength=SYMBOLS)
        return start, np.zeros((STATES, STATES)), emit, 0.0

    return count


def train(blocks: DataFrame, background: np.ndarray, rounds: int = ROUNDS, gain: float = GAIN) -> tuple[Model, list[float]]:
    """Baum-Welch over all training documents, and the log likelihood of a token before each round."""
    start, _, emit, _ = gather(blocks, sorted_apart(background))
    stay = np.full((STATES, STATES), 0.1 / (STATES - 1)) + (0.9 - 0.1 / (STATES - 1)) * np.eye(STATES)
    model = Model(start, stay, emit).improved(start, stay * 100, emit, background)
    tokens, told = emit.sum(), []
    for _ in range(rounds if tokens else 0):
        *counts, likelihood = gather(blocks, model.expected)
        told.append(likelihood / tokens)
        model = model.improved(*counts, background)
        if len(told) > 1 and told[-1] - told[-2] < gain:
            break
    return model, told


def word_totals(blocks: DataFrame) -> DataFrame:
    """(word, c): every word's count in all training tokens.  Tasks sum up what they have first."""
    rows = blocks.select(F.explode(F.arrays_zip("words", "counts")).alias("x"))
    return rows.groupBy(F.col("x.words").alias("word")).agg(F.sum("x.counts").alias("c"))


def word_counts(blocks: DataFrame, totals: DataFrame) -> DataFrame:
    """(block, counts): for every word of a block, in its order, its count in all training tokens.

    A word has one row for each block that has it, which is a small share of all rows however
    frequent the word is: a block has many words, each once.
    """
    rows = blocks.select("block", F.posexplode("words").alias("pos", "word")).join(totals, "word")
    # place and count of a word go as one number; counts that leave no room for it go as they are
    half, c, pos = F.lit(1 << 32), F.col("c"), F.col("pos")
    of_block = rows.groupBy("block").agg(F.collect_list(F.when(c < half, pos * half + c)).alias("small"), F.collect_list(F.when(c >= half, F.struct(pos.alias("pos"), c.alias("c")))).alias("large"))
    every = F.concat(F.transform("small", lambda x: F.struct(F.shiftright(x, 32).cast("int").alias("pos"), x.bitwiseAND((1 << 32) - 1).alias("c"))), F.col("large"))
    return of_block.select("block", F.transform(F.sort_array(every), lambda x: x["c"]).alias("counts"))


def symbol_totals(totals: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Training tokens and different training words of every symbol."""
    own = F.when(F.col("word") == END.decode(), F.lit(END_SYMBOL)).otherwise(1 + F.crc32(F.col("word").cast("binary")) % (SYMBOLS - 1))
    tokens, words = np.zeros(SYMBOLS, np.int64), np.zeros(SYMBOLS, np.int64)
    for r in totals.where("c > 0").groupBy(own.cast("int").alias("key")).agg(F.sum("c").alias("tokens"), F.count("*").alias("words")).collect():
        tokens[r["key"]], words[r["key"]] = r["tokens"], r["words"]
    return tokens, words


def score_documents(docs: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """Scores of every row of ``docs`` (doc_id, text): doc_id, held_out, n_tokens, n_known,
    train_tokens, base_score and score, as the query's contract has them.

    Learns from rows whose crc32(doc_id) mod 7 is not 2, in ``rounds`` rounds at most.  Null texts are the end token alone.
    Repeated rows are counted and scored each.  Without training rows every word is unknown.
    An empty table gives an empty result.
    """
    held = crc_mod(F.col("doc_id"), 7) == 2
    blocks = encode(docs.select(F.col("doc_id").cast("long").alias("doc_id"), held.alias("held"), F.col("text").cast("string").alias("text")))
    totals = materialize(word_totals(blocks), "words")
    tokens, words = symbol_totals(totals)
    n, v = int(tokens.sum()), int(words.sum())
    share = tokens + words + 1.0
    background = share / share.sum()
    model, _ = train(blocks, background, rounds)
    joined = blocks.drop("words", "counts").join(word_counts(blocks, totals), "block")

    names = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = {k: batch.column(k)[i] for k in batch.schema.names}
                ids = _ids([row[k].as_py() for k in _PLANES])
                lengths = row["lengths"].values.to_numpy()
                local = np.frombuffer(row["symbols"].as_py(), np.uint16)
                counts = row["counts"].values.to_numpy()
                base = np.log10((counts + 1) / (n + v + 1))
                inside = np.log10((counts + 1) / share[local])
                at = np.cumsum(lengths) - lengths
                sums = lambda x: np.add.reduceat(x[ids], at)
                score = model.sequences(local[ids], lengths) / np.log(10) + sums(inside)
                yield pa.RecordBatch.from_arrays(
                    [row["doc_ids"].values, row["held"].values, pa.array(lengths.astype(np.int64)), pa.array(sums((counts > 0).astype(np.int64))), pa.array(np.full(len(lengths), n)), pa.array(sums(base)), pa.array(score)], names
                )

    return joined.select("doc_ids", "held", "lengths", *_PLANES, "symbols", "counts").mapInArrow(run, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
