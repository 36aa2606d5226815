"""Packing of token sequences: bounded-space online best fit, then merging of the leftovers.

Every partition keeps at most ``WINDOWS`` open sequences.  A piece goes to the open sequence that
it fills best.  If it fits none, a new one opens; if that is one too many, the fullest is emitted,
topped up first with the head of the piece where at least ``MIN_CUT`` ids fit.  Pieces still open
at the end of a partition are few (WINDOWS sequences at most); groups of partitions pack them
again in the same way, over and over, until one task holds the last.
"""

from __future__ import annotations

import json
import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import give_back, materialize, process_cache, small_batches

LENGTH, WINDOWS, MIN_CUT, END = 2048, 16, 32, 1
#: Partitions whose leftovers one task of the next round packs.
GROUP = 32
#: Parts of texts that one worker remembers, about 180 bytes each; beyond it, those of the last texts stay.
REMEMBERED = 300_000
#: Bytes of text that are worked on together; the arrays and the library take some 20 times as much.
CHUNK_BYTES = 1 << 20
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


#: What the tokenizer's pattern matches beside runs of letters, of lower-case texts without ODD parts.
MARKS = "('s|'t|'re|'ve|'m|'ll|'d|\\p{N}|[^\\x09-\\x0d\\x20\\p{L}\\p{N}]+)"
#: Characters from U+0250 on may combine, and their categories change between Unicode versions; a few
#: others are white space to some libraries only, or change their length in lower case; "<|" begins
#: the special strings.
ODD = "[^\\x00-\\x1b\\x20-\\x84\\x86-\\x9f\\xa1-\\x{12f}\\x{131}-\\x{24f}]|<\\|"

#: What a tokenizer's file says of the steps that TextIds takes apart; fixed values.
WORD_STEPS = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
    "model": {"type": "BPE", "dropout": None, "unk_token": None, "continuing_subword_prefix": None, "end_of_word_suffix": "</w>", "fuse_unk": False, "byte_fallback": False, "ignore_merges": False},
}


class TextIds:
    """Token ids of texts by a memory of the pieces that the tokenizer cuts them into.

    A tokenizer of the shape of WORD_STEPS lower-cases, drops white space and never joins across
    the matches of its pattern, so a text's ids are those of the matches, one after the other.
    Spaces around MARKS part the matches of most texts.  Texts with ODD parts are cut at ASCII
    white space, and their words are encoded whole.  Any other tokenizer gets whole texts.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        self.model.no_truncation()
        self.model.no_padding()
        self.pieces: dict[str, bytes] = {}
        self.words: dict[str, bytes] = {}
        with open(path, encoding="utf-8") as f:
            known = json.load(f)
        kind = {k: v for k, v in known["model"].items() if k not in ("vocab", "merges")}
        self.whole = {"normalizer": known.get("normalizer"), "pre_tokenizer": known.get("pre_tokenizer"), "model": kind} != WORD_STEPS or any(
            x["lstrip"] or x["rstrip"] or x["single_word"] or x["normalized"] or not x["content"].startswith("<|") for x in known.get("added_tokens") or []
        )
        vocabulary = self.model.get_vocab()
        # the last id of a match ends a word
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for piece, i in vocabulary.items() if piece.endswith("</w>")]] = True

    def _encode(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.model.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn_pieces(self, new: list[str]) -> None:
        """Runs of letters are encoded as one text and told apart by the ends of words; the rest one by one."""
        runs = [x for x in new if x.isalpha()]
        ids = np.array(self.model.encode_batch_fast([" ".join(runs)], add_special_tokens=False)[0].ids, "<u4")
        stops = np.flatnonzero(self.ends[ids]) + 1
        if len(stops) == len(runs):
            data, at = ids.tobytes(), (4 * stops).tolist()
            self.pieces.update(zip(runs, (data[i:j] for i, j in zip([0, *at], at))))
        rest = [x for x in new if x not in self.pieces]
        self.pieces.update(zip(rest, self._encode(rest)))

    def _learn_words(self, new: list[str]) -> None:
        self.words.update(zip(new, self._encode(new)))

    def _ids(self, texts: pa.Array, odd: bool) -> list[bytes]:
        """The texts' ids; only the different parts are looked up, the rest is done by arrays."""
        memory, learn = (self.words, self._learn_words) if odd else (self.pieces, self._learn_pieces)
        cut = texts if odd else pc.replace_substring_regex(pc.utf8_lower(texts), MARKS, " \\1 ")
        found = pc.ascii_split_whitespace(cut)
        coded = found.flatten().dictionary_encode()
        different = coded.dictionary.to_pylist()
        ids = list(map(memory.get, different))
        if None in ids:
            learn([x for x, known in zip(different, ids) if known is None])
            ids = list(map(memory.get, different))
        if len(memory) > REMEMBERED:
            # the parts of these texts are the likeliest in the next
            memory.clear()
            memory.update(zip(different, ids))
        sizes = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        begins = np.cumsum(sizes) - sizes
        every = np.frombuffer(b"".join(ids), "<u4")
        at = coded.indices.to_numpy(zero_copy_only=False)
        lengths = sizes[at]
        ends = np.cumsum(lengths)
        flat = every[np.repeat(begins[at] - ends + lengths, lengths) + np.arange(ends[-1] if len(ends) else 0)]
        stops = np.concatenate([[0], ends])[found.offsets.to_numpy()[1:] - found.offsets[0].as_py()]
        whole = np.insert(flat, stops, END).astype("<u4").tobytes()
        stops = 4 * (stops + np.arange(1, len(stops) + 1))
        # copies: a piece in an open sequence must not hold the ids of all these texts
        return [whole[i:j] for i, j in zip([0, *stops[:-1].tolist()], stops.tolist())]

    def documents(self, texts: pa.Array) -> list[bytes]:
        """Each text's ids, then END, as little-endian unsigned 32-bit bytes."""
        texts = pc.fill_null(texts, "")
        if self.whole:
            end = np.array([END], "<u4").tobytes()
            return [x + end for x in self._encode(texts.to_pylist())]
        odd = pc.match_substring_regex(texts, ODD)
        if not pc.any(odd).as_py():
            return self._ids(texts, False)
        own = {False: iter(self._ids(texts.filter(pc.invert(odd)), False)), True: iter(self._ids(texts.filter(odd), True))}
        return [next(own[x]) for x in odd.to_pylist()]


def chunks(texts: pa.Array, most: int = CHUNK_BYTES) -> Iterator[tuple[int, pa.Array]]:
    """(first row, texts) of runs of rows with about ``most`` bytes or one row at least."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False))
    start = 0
    while start < len(texts):
        before = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, before + most)))
        yield start, texts.slice(start, stop - start)
        start = stop


class Packer:
    """Open sequences; ``add`` and ``close`` return sequences that are done.

    A sequence is a list of parts (length, tag).  A part may be cut: ``cut(tag, n)`` gives the tags
    of its first n ids and of the rest.
    """

    def __init__(self, cut, windows: int = WINDOWS, length: int = LENGTH, min_cut: int = MIN_CUT):
        self.cut, self.windows, self.length, self.min_cut = cut, windows, length, min_cut
        self.open: list[list] = []  # [room, parts]

    def add(self, n: int, tag) -> Iterator[list]:
        while n > self.length:
            head, tag = self.cut(tag, self.length)
            yield [(self.length, head)]
            n -= self.length
        while True:
            best = min((w for w in self.open if w[0] >= n), key=lambda w: w[0], default=None)
            if best is None and len(self.open) < self.windows:
                best = [self.length, []]
                self.open.append(best)
            if best is not None:
                best[0] -= n
                best[1].append((n, tag))
                if best[0] == 0:
                    self.open.remove(best)
                    yield best[1]
                return
            fullest = min(self.open, key=lambda w: w[0])
            if self.min_cut <= fullest[0] <= n - self.min_cut:
                head, tag = self.cut(tag, fullest[0])
                fullest[1].append((fullest[0], head))
                n -= fullest[0]
            self.open.remove(fullest)
            yield fullest[1]


def _cut_ids(tag: tuple, n: int) -> tuple[tuple, tuple]:
    doc, start, ids, total = tag
    return (doc, start, ids[: 4 * n], total), (doc, start + n, ids[4 * n :], total)


def _rows(sequence: list, number: int, is_open: bool) -> list[tuple]:
    out, offset = [], 0
    for n, (doc, start, ids, total) in sequence:
        # leftovers carry their ids: they may be cut again
        out.append((doc, start, n, zlib.crc32(ids), total, number, offset, bytes(ids) if is_open else None))
        offset += n
    return out


_SCHEMA = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()), ("ids", pa.binary())])


def _batches(rows: Iterator[list[tuple]]) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    for some in rows:
        held += some
        if len(held) >= 5000:
            yield pa.RecordBatch.from_arrays([pa.array(x, t.type) for x, t in zip(zip(*held), _SCHEMA)], schema=_SCHEMA)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(x, t.type) for x, t in zip(zip(*held), _SCHEMA)], schema=_SCHEMA)


def _pack(items: Iterator[tuple], windows: int, base: int) -> Iterator[list[tuple]]:
    packer, number = Packer(_cut_ids, windows), base
    for n, tag in items:
        for sequence in packer.add(n, tag):
            yield _rows(sequence, number, False)
            number += 1
    for _, parts in packer.open:
        yield _rows(parts, number, True)
        number += 1


def pack_documents(docs: DataFrame, path: str, windows: int = WINDOWS) -> DataFrame:
    """One row per piece of the packed documents; columns as in PIECES.

    ``path`` is a tokenizers file.  Null and empty texts are the end id alone.  Documents longer
    than a sequence are cut in whole sequences and a rest.  Repeated rows and null ids are packed
    like any other.  An empty table gives an empty result.  Memory: one batch of texts and the
    open sequences.  Only the last sequence of all may be short; others lack fewer than MIN_CUT
    ids, or pieces too short to cut.
    """
    small_batches(docs.sparkSession)

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory = process_cache(f"packing:{path}", lambda: TextIds(path))

        def items() -> Iterator[tuple]:
            give_back()
            for batch in batches:
                docs_of = batch.column(0).to_pylist()
                for start, texts in chunks(batch.column(1)):
                    for i, ids in enumerate(memory.documents(texts), start):
                        yield len(ids) // 4, (docs_of[i], 0, memoryview(ids), len(ids) // 4)
                give_back()

        yield from _batches(_pack(items(), windows, TaskContext.get().partitionId() << 32))

    schema = f"{PIECES}, ids binary"
    packed = materialize(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(first, schema), "packed")
    done = [packed.where("ids is null")]
    left, level = packed.where("ids is not null"), 1
    tasks = left.select(F.count_distinct(F.shiftright("sequence_id", 32))).first()[0]
    while True:
        tasks = max(1, -(-tasks // GROUP))
        last, at = tasks == 1, level

        def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            def items() -> Iterator[tuple]:
                for batch in batches:
                    for x in batch.to_pylist():
                        yield x["length"], (x["doc_id"], x["start"], memoryview(x["ids"]), x["doc_tokens"])

            base = (at << 56) + (TaskContext.get().partitionId() << 32)
            yield from _batches(_pack(items(), windows, base))

        dealt = left.repartition(tasks, F.shiftright("sequence_id", 32)) if not last else left.repartition(1)
        merged = materialize(dealt.sortWithinPartitions(F.col("length").desc(), "doc_id", "start").mapInArrow(again, schema), "packed")
        if last:
            done.append(merged)
            break
        done.append(merged.where("ids is null"))
        left, level = merged.where("ids is not null"), level + 1
    out = done[0]
    for more in done[1:]:
        out = out.union(more)
    return out.drop("ids")
