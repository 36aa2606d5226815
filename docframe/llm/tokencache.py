"""Token counts through a cache keyed by digests of the content and of the tokenizer.

A count is looked up by (content digest, tokenizer digest).  Only contents that the cache lacks
are encoded, each once, however many documents have it; their counts are appended to the cache,
a Parquet folder that later calls read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import join_lookup, materialize, process_cache, scratch_path, small_batches

SCHEMA = "content string, tokenizer string, n_tokens long"
#: Segments that one worker remembers; the memory is emptied when full.
REMEMBERED = 300_000


def tokenizer_digest(path: str) -> str:
    """SHA-256 of the tokenizer's file: another file is another version."""
    with open(path, "rb") as f:
        return hashlib.file_digest(f, "sha256").hexdigest()


class PieceCounter:
    """Token counts of a sentencepiece model, the same as encoding the whole text.

    If no piece of the model holds a space mark behind another character, no merge crosses the
    place before a run of spaces: the text falls into segments, each a run of spaces and the
    word behind it, that are encoded apart and remembered.  Otherwise whole texts are encoded.
    """

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = map(self.model.id_to_piece, range(self.model.get_piece_size()))
        mark = "▁"
        plain = [self.model.normalize(x) for x in ("a  b\tc Ωﬁ", " a ")] == [f"{mark}a{mark}{mark}b\tc{mark}Ωﬁ", f"{mark}{mark}a{mark}"]
        self.apart = plain and not any(mark in p.lstrip(mark) for p in pieces)
        self.seen: dict[str, int] = {}

    def _first(self, text: str) -> int:
        return len(self.model.encode(text))

    def count(self, text: str) -> int:
        if not text:
            return self._first("")
        if not self.apart or "▁" in text or "\0" in text:
            return self._first(text)
        # a leading space stands for the mark the model puts before a text, so each segment
        # " word" is counted as the text "word"; runs of spaces go with the word behind them
        total, seen, blanks = 0, self.seen, 0
        if len(seen) > REMEMBERED:
            seen.clear()
        for part in text.split(" "):
            if not part:
                blanks += 1
                continue
            if blanks:
                part, blanks = " " * blanks + part, 0
            n = seen.get(part)
            if n is None:
                n = seen[part] = len(self.model.encode(part))
            total += n
        if blanks:
            # blanks - 1 spaces behind the mark: a run of `blanks` marks in all
            total += self._first(" " * (blanks - 1)) if blanks > 1 else 1
        return total


class JsonCounter:
    """Token counts of a tokenizers file; special strings as the library's default has them."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        self.model.no_truncation()
        self.model.no_padding()

    def count(self, text: str) -> int:
        return len(self.model.encode(text, add_special_tokens=False).ids)


def counter(path: str):
    """The worker's counter of that file, made once per process."""
    return process_cache(f"counter:{path}", lambda: (PieceCounter if path.endswith(".model") else JsonCounter)(path))


def encode_counts(contents: DataFrame, path: str) -> DataFrame:
    """(content, text) -> (content, n_tokens), encoding every row."""
    small_batches(contents.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = counter(path)
        for batch in batches:
            counts = [own.count(x.as_py()) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64())], ["content", "n_tokens"])

    return contents.select("content", "text").mapInArrow(run, "content string, n_tokens long")


def count_tokens(docs: DataFrame, path: str, cache: str | None = None, limit: int = 4096) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of every row of ``docs`` (doc_id, text).

    ``cache`` is a Parquet folder in storage that all executors share; without one, a fresh
    folder in the scratch folder serves this call alone.  The normalised content is the text
    itself, null as empty.  Repeated rows and null ids are kept.  An empty table gives an empty
    result and appends nothing.  Calls that append to one folder at the same time may store a
    count twice; lookups take one row per digest, so results stay right.
    """
    spark = docs.sparkSession
    version = tokenizer_digest(path)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumn("content", F.sha2("text", 256))
    known = None
    if cache is not None:
        hadoop = spark._jvm.org.apache.hadoop.fs.Path(cache)
        if hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop):
            known = spark.read.schema(SCHEMA).parquet(cache).where(F.col("tokenizer") == version).groupBy("content").agg(F.max("n_tokens").alias("n_tokens"))
    folder = cache or scratch_path(spark, f"token-cache-{version[:12]}")

    digests = materialize(rows.select("doc_id", "content", F.length(F.col("text").cast("binary")).cast("long").alias("n_bytes")), "digests")
    wanted = digests.groupBy("content").agg(F.min("doc_id").alias("doc_id"))
    if known is not None:
        wanted = wanted.join(known, "content", "left_anti")
    # the text of each missing digest comes from the row with its least id
    chosen = rows.select("doc_id", "content", "text").join(wanted.withColumnRenamed("content", "c").withColumnRenamed("doc_id", "d"), (F.col("content") == F.col("c")) & F.col("doc_id").eqNullSafe(F.col("d")), "left_semi")
    missing = encode_counts(chosen, path).groupBy("content").agg(F.max("n_tokens").alias("n_tokens"))
    missing.select("content", F.lit(version).alias("tokenizer"), "n_tokens").write.mode("append").parquet(folder)

    stored = spark.read.schema(SCHEMA).parquet(folder).where(F.col("tokenizer") == version)
    stored = stored.groupBy("content").agg(F.max("n_tokens").alias("n_tokens"))
    # one content may be that of a third of all rows
    return join_lookup(digests, stored, ["content"]).select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
