"""Language identification by string kernels.

The kernel of two texts is the number of different n-grams of 1 to ``LONGEST`` characters that
both have, divided by the root of the product of their numbers of n-grams (a blended spectrum of
presences).  Landmark texts span the feature space (Nyström); kernel ridge regression of one
language against the rest is solved in it.  A text's n-grams that no landmark has add nothing to a
kernel but to the text's norm, so a batch is scored as the product of its (sparse) presences with
one matrix, n-grams of the landmarks x languages.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, StringType, StructField, StructType

from .common import crc_mod, small_batches

LONGEST = 3
#: Bounds of the labelled sample, for each language and for all of them together.  Every language has
#: LEAST_ROWS and LEAST_LANDMARKS, however many there are, if it has so many rows.
ROWS_PER_LANGUAGE, ALL_ROWS, LEAST_ROWS = 400, 20_000, 8
LANDMARKS_PER_LANGUAGE, ALL_LANDMARKS, LEAST_LANDMARKS = 32, 512, 2
#: Longer texts, in characters, are not learned from.
LONGEST_LEARNED = 200_000
RIDGE = 1e-3
#: Characters of texts that are worked on together (a longer text alone).
BATCH_CHARS, BATCH_TEXTS = 1 << 20, 256
#: Texts with a smaller share of known n-grams are of no learned language; lower for a language whose own rows
#: beside the landmarks have less: the share that all but 1 in 100 of them reach, less SHARE_SLACK.
LEAST_SHARE, SHARE_SLACK, SHARE_ROWS = 0.75, 0.05, 20
UNKNOWN = "und"
#: Bits of a character in an n-gram's number: a code point and one more.
_BITS = 21


def _gaps() -> np.ndarray:
    out = np.zeros(0x3001, bool)
    for i in range(0x3001):
        out[i] = chr(i).isspace() or chr(i).isdigit() or i < 32
    return out


_GAP = _gaps()


def _codes(text: str) -> np.ndarray:
    """Code points of the lower-case text plus one; a run of white space, controls and digits is one gap of code 1."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    gap = _GAP[np.minimum(points, 0x2FFF)] & (points < 0x3001)
    codes = np.where(gap, 1, points + 1)
    keep = np.ones(len(codes), bool)
    keep[1:] = ~(gap[1:] & gap[:-1])
    return codes[keep]


def grams(text: str | None) -> np.ndarray:
    """The different n-grams of 1 to LONGEST characters of a text, as ascending numbers; equal numbers are equal n-grams."""
    c = _codes(text or "")
    out, mixed = [c], c
    for n in range(1, LONGEST):
        mixed = (mixed[:-1] << _BITS) | c[n:]
        out.append(mixed)
    every = np.sort(np.concatenate(out))
    return every[np.concatenate([[True], every[1:] != every[:-1]])] if len(every) else every


@dataclass
class Model:
    languages: list[str]
    inventory: np.ndarray  # the landmarks' n-grams, ascending
    weights: np.ndarray  # float32, n-grams x languages: the landmarks' presences by their norms, times their weights
    least_shares: np.ndarray | None = None  # by language: the share of known n-grams that its texts have at least

    def _places(self, found: np.ndarray) -> np.ndarray:
        """Places in the inventory of those n-grams that it has."""
        if not len(self.inventory):
            return np.zeros(0, np.int64)
        at = np.minimum(np.searchsorted(self.inventory, found), len(self.inventory) - 1)
        return at[self.inventory[at] == found]

    def decide(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """texts x languages: regression towards 1 for a text's language and -1 for others; and the
        share of each text's different n-grams that the inventory has, which falls for foreign text."""
        every = [grams(x) for x in texts]
        known = [self._places(x) for x in every]
        sizes = np.array(list(map(len, every)))
        have = np.array(list(map(len, known)))
        out = np.zeros((len(texts), len(self.languages)))
        some = np.flatnonzero(have)
        if len(some):
            # the rows of a sparse matrix of presences times the weights
            out[some] = np.add.reduceat(self.weights[np.concatenate(known)], (np.cumsum(have) - have)[some], axis=0, dtype=np.float64)
        return out / np.sqrt(np.maximum(sizes, 1))[:, None], have / np.maximum(sizes, 1)

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float], list[bool]]:
        """Language and score of each text, and whether it fits the language by its share of known
        n-grams: UNKNOWN, 0 and False for null and for texts without a letter.

        The score is the regression of the best language, mapped from -1..1 to 0..1.
        """
        langs, scores, fits = [UNKNOWN] * len(texts), [0.0] * len(texts), [False] * len(texts)
        real = [i for i, x in enumerate(texts) if x and any(map(str.isalpha, x))]
        if not self.languages:
            return langs, scores, fits
        start = 0
        while start < len(real):
            end, chars = start, 0
            while end < len(real) and (end == start or (end - start < BATCH_TEXTS and chars < BATCH_CHARS)):
                chars += len(texts[real[end]])
                end += 1
            values, shares = self.decide([texts[i] for i in real[start:end]])
            best = values.argmax(axis=1)
            for i, b, v, share in zip(real[start:end], best, values, shares):
                langs[i], scores[i] = self.languages[b], float(np.clip((v[b] + 1) / 2, 0, 1))
                fits[i] = bool(share >= self.least_shares[b])
            start = end
        return langs, scores, fits


def _shared(bound: int, least: int, every: int, languages: int) -> int:
    """Of ``every`` in all, what one of so many languages may have: at most ``bound``, at least ``least``."""
    return max(least, min(bound, every // max(1, languages)))


def fit(rows: list[tuple[str, str]]) -> Model:
    """Train on (text, language), in the order given (the first rows of a language are its landmarks).

    Without a text that has a letter the model has no language.
    """
    rows = [(x, lang) for x, lang in rows if x and any(map(str.isalpha, x))]
    languages = sorted({lang for _, lang in rows})
    if not rows:
        return Model([], np.zeros(0, np.int64), np.zeros((0, 0), np.float32), np.zeros(0))
    most = _shared(LANDMARKS_PER_LANGUAGE, LEAST_LANDMARKS, ALL_LANDMARKS, len(languages))
    by: dict[str, list[np.ndarray]] = {x: [] for x in languages}
    for x, lang in rows:
        by[lang].append(grams(x))
    marks = [x for lang in languages for x in by[lang][:most]]
    places, of_mark = np.concatenate(marks), np.repeat(np.arange(len(marks)), list(map(len, marks)))
    by_gram = np.argsort(places, kind="stable")
    inventory, begins = np.unique(places[by_gram], return_index=True)
    of_mark = of_mark[by_gram]
    stops = np.append(begins[1:], len(of_mark))
    norms = np.sqrt(np.array(list(map(len, marks))))
    probe = Model(languages, inventory, np.zeros((0, 0), np.float32))

    def kernel(x: np.ndarray) -> np.ndarray:
        at = probe._places(x)
        hits = np.concatenate([of_mark[begins[i] : stops[i]] for i in at]) if len(at) else np.zeros(0, np.int64)
        return np.bincount(hits, minlength=len(marks)) / (norms * np.sqrt(max(1, len(x))))

    inner = np.array([kernel(x) for x in marks])
    values, vectors = np.linalg.eigh((inner + inner.T) / 2)
    good = values > 1e-6 * values.max()
    root = vectors[:, good] / np.sqrt(values[good])  # K_mm^(-1/2)
    features = np.array([kernel(x) for lang in languages for x in by[lang]]) @ root
    target = np.array([[1.0 if lang == x else -1.0 for x in languages] for lang in languages for _ in by[lang]])
    # languages weigh alike, however many rows each has
    weight = np.array([1.0 / len(by[lang]) for lang in languages for _ in by[lang]])[:, None]
    left = features.T @ (weight * features) + RIDGE * np.eye(features.shape[1])
    of_landmark = (root @ np.linalg.solve(left, features.T @ (weight * target))) / norms[:, None]
    weights = np.add.reduceat(of_landmark[of_mark], begins, axis=0).astype(np.float32)
    model = Model(languages, inventory, weights)
    # the inventory comes from the landmarks alone, so the other rows are held out from it
    own = [np.array([len(model._places(x)) / len(x) for x in by[name][most:]]) for name in languages]
    pool = np.concatenate(own)
    reached = [x if len(x) >= SHARE_ROWS else pool for x in own]
    model.least_shares = np.array([min(LEAST_SHARE, np.quantile(x, 0.01) - SHARE_SLACK) if len(x) >= SHARE_ROWS else 0.0 for x in reached])
    return model


def training_rows(labelled: DataFrame) -> list[tuple[str, str]]:
    """A bounded sample of (text, lang) for ``fit``: of every language the rows of the least hashes
    of doc_id and text, ROWS_PER_LANGUAGE of them at most and ALL_ROWS in all (but LEAST_ROWS of each).

    Texts of more than LONGEST_LEARNED characters are passed over.  Equal inputs give equal samples.
    """
    rows = labelled.where(F.col("text").isNotNull() & F.col("lang").isNotNull() & (F.length("text") <= LONGEST_LEARNED))
    rows = rows.select("lang", "text", F.shiftrightunsigned(F.xxhash64("doc_id", "text", F.lit(7)), 1).alias("h"))
    counts = rows.groupBy("lang").count().collect()
    if not counts:
        return []
    most = _shared(ROWS_PER_LANGUAGE, LEAST_ROWS, ALL_ROWS, len(counts))
    # hashes that the rows looked for do not reach, so that few rows are dealt by language
    reach = [(r["lang"], min((1 << 63) - 1, (2 * most + 50) * (1 << 63) // r["count"])) for r in counts]
    near = rows.join(F.broadcast(labelled.sparkSession.createDataFrame(reach, "lang string, reach long")), "lang").where("h <= reach")
    nth = F.row_number().over(Window.partitionBy("lang").orderBy("h", "text"))
    found = near.withColumn("nth", nth).where(F.col("nth") <= most).select("lang", "nth", "text").collect()
    return [(r["text"], r["lang"]) for r in sorted(found, key=lambda r: (r["lang"], r["nth"]))]


def classify(docs: DataFrame, model: Model, columns: tuple[str, ...] = ("lang_pred", "score")) -> DataFrame:
    """``docs`` with the language and score of column ``text``; other columns pass through.

    A third name adds a boolean: does the text fit its language?
    """
    small_batches(docs.sparkSession)

    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(names.index("text")).to_pylist()
            found = [pa.array(x, t) for x, t in zip(model.predict(texts), (pa.string(), pa.float64(), pa.bool_()))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *found[: len(columns)]], [*names, *columns])

    kinds = (StringType(), DoubleType(), BooleanType())
    return docs.mapInArrow(run, StructType([*docs.schema.fields, *map(StructField, columns, kinds)]))


def learn(docs: DataFrame) -> Model:
    """The model learned from the documents that are not held out and have a language."""
    return fit(training_rows(docs.where(crc_mod(F.col("doc_id"), 4) != 2).select("doc_id", F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))))


def identify(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of every row of ``docs`` (doc_id, text, lang).

    Learns from text and lang of rows whose crc32(doc_id) mod 4 is not 2; predicts from the text
    alone.  Null texts and texts without a letter are UNKNOWN with score 0, as are all texts when
    nothing can be learned.  Long texts are scored whole, one at a time.  Repeated rows and null ids
    are kept.  An empty table gives an empty result.
    """
    held: Column = crc_mod(F.col("doc_id"), 4) == 2
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held.alias("held_out"), F.col("text").cast("string").alias("text"))
    return classify(rows, learn(docs)).drop("text")
