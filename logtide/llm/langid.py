"""Language identification by hyperdimensional profiles.

Every letter has a random vector of +1 and -1 that its code point determines.  An n-gram's vector binds its letters'
vectors, each permuted (rolled) by its place, by multiplication; a text's vector bundles (adds) those of its n-grams, and
a language's prototype bundles the vectors of all its training documents.  A text gets the language whose prototype
has the largest cosine with it; the score is that cosine, cut to 0 to 1.

Training is one pass that adds integers by language and dimension, so its result does not depend on how the rows are
partitioned.  What reaches the driver is one vector a language.

Cases:  a null text or one without a letter is ``und`` with score 0; so is every text if no row has a language; rows with a null
doc_id are not held out; rows that repeat are counted and predicted as often; a very long text takes memory in proportion to its length, with its n-grams' vectors made a few thousand at a time; equal scores go to the language that sorts first; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read, with_fields

DIMENSION, GRAM = 512, 3
TABLE_ROWS, CHUNK = 40_000, 8_192
"""N-gram vectors that a worker keeps, and makes at a time."""
BLOCK = 128
"""Documents whose vectors are made by one matrix product."""
UND = "und"


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def letter_vectors(points: np.ndarray) -> np.ndarray:
    """(n, DIMENSION) of +1 and -1."""
    words = DIMENSION // 64
    seeds = points.astype(np.uint64)[:, None] * np.uint64(words) + np.arange(1, words + 1, dtype=np.uint64)
    bits = np.unpackbits(_mix(seeds * np.uint64(0x9E3779B97F4A7C15)).view(np.uint8), axis=1)
    return bits.astype(np.int8) * 2 - 1


def gram_vectors(codes: np.ndarray) -> np.ndarray:
    """Bind the permuted letters of each n-gram."""
    out = np.ones((len(codes), DIMENSION), np.int8)
    for place in range(GRAM):
        points = (codes >> (21 * (GRAM - 1 - place))) & 0x1FFFFF
        letters, where = np.unique(points, return_inverse=True)
        out *= np.roll(letter_vectors(letters), GRAM - 1 - place, axis=1)[where]
    return out.astype(np.float32)


@cache
def _letters() -> np.ndarray:
    return np.array([chr(i).isalpha() for i in range(0x110000)])


def grams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Codes and counts of a text's n-grams; whatever is no letter is one gap, and the text begins and ends with one."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32)
    letter = _letters()[points]
    if not letter.any():
        return np.empty(0, np.int64), np.empty(0, np.int64)
    points = np.concatenate([[32], np.where(letter, points, 32), [32]]).astype(np.int64)
    points = points[np.concatenate([[True], (points[1:] != 32) | (points[:-1] != 32)])]
    codes = points[: len(points) - GRAM + 1].copy()
    for place in range(1, GRAM):
        codes = (codes << 21) | points[place : len(points) - GRAM + 1 + place]
    return np.unique(codes, return_counts=True)


class Table:
    """Vectors of the n-grams met first; others are made anew whenever they occur."""

    def __init__(self) -> None:
        self.codes, self.rows = np.empty(0, np.int64), np.empty(0, np.int64)
        self.vectors = np.empty((TABLE_ROWS, DIMENSION), np.float32)

    def _place(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.minimum(np.searchsorted(self.codes, codes), max(0, len(self.codes) - 1))
        return at, (self.codes[at] == codes) if len(self.codes) else np.zeros(len(codes), bool)

    def take(self, codes: np.ndarray) -> np.ndarray:
        """Vectors of at most CHUNK sorted codes."""
        at, known = self._place(codes)
        if not known.all() and len(self.codes) < TABLE_ROWS:
            new = codes[~known][: TABLE_ROWS - len(self.codes)]
            self.vectors[len(self.codes) : len(self.codes) + len(new)] = gram_vectors(new)
            codes_now = np.concatenate([self.codes, new])
            order = np.argsort(codes_now, kind="stable")
            self.codes, self.rows = codes_now[order], np.concatenate([self.rows, np.arange(len(self.rows), len(codes_now))])[order]
            at, known = self._place(codes)
        if known.all():
            return self.vectors[self.rows[at]]
        out = np.empty((len(codes), DIMENSION), np.float32)
        out[known], out[~known] = self.vectors[self.rows[at[known]]], gram_vectors(codes[~known])
        return out


@cache
def _table() -> Table:
    return Table()


def bundle(found: list[tuple[np.ndarray, np.ndarray]], kind: type = np.float32) -> np.ndarray:
    """One vector for each (codes, counts): the sum of count times n-gram vector, CHUNK n-grams at a time."""
    total = np.zeros((len(found), DIMENSION), kind)
    codes, where = np.unique(np.concatenate([c for c, _ in found]), return_inverse=True)
    row = np.repeat(np.arange(len(found)), [len(c) for c, _ in found])
    counts = np.concatenate([n for _, n in found])
    for first in range(0, len(codes), CHUNK):
        inside = slice(None) if len(codes) <= CHUNK else (where >= first) & (where < first + CHUNK)
        part = codes[first : first + CHUNK]
        dense = np.zeros((len(found), len(part)), kind)
        dense[row[inside], where[inside] - first] = counts[inside]
        total += dense @ _table().take(part).astype(kind, copy=False)
    return total


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def train(labelled: DataFrame) -> dict[str, np.ndarray]:
    """Prototypes of (text, lang); the result has one vector of DIMENSION a language."""
    rows = labelled.where(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("text", F.col("lang").cast("string").alias("lang"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            pending: dict[str, list] = {}
            for text, lang in zip(batch.column(0), batch.column(1), strict=True):
                pending.setdefault(lang.as_py(), []).append(grams(text.as_py()))
                if len(pending[lang.as_py()]) >= 256:
                    _add(sums, lang.as_py(), pending.pop(lang.as_py()))
            for lang, found in pending.items():
                _add(sums, lang, found)
        for lang, total in sums.items():
            yield pa.record_batch([pa.array([lang] * DIMENSION), pa.array(range(DIMENSION), pa.int32()), pa.array(total.astype(np.int64))], names=["lang", "dim", "value"])

    sums = rows.mapInArrow(run, "lang string, dim int, value long").groupBy("lang", "dim").agg(F.sum("value").alias("value"))
    vectors = sums.groupBy("lang").agg(F.transform(F.sort_array(F.collect_list(F.struct("dim", "value"))), lambda s: s["value"]).alias("v"))
    found = {r["lang"]: np.array(r["v"], np.float64) for r in vectors.collect()}
    return {k: v / max(np.linalg.norm(v), 1e-12) for k, v in sorted(found.items())}


def _add(sums: dict, lang: str, found: list) -> None:
    codes, where = np.unique(np.concatenate([c for c, _ in found]), return_inverse=True)
    counts = np.bincount(where, np.concatenate([n for _, n in found]), len(codes)) if len(codes) else np.empty(0)
    sums[lang] = sums.get(lang, 0) + np.rint(bundle([(codes, counts)], np.float64)[0])


def classify(texts: list[str | None], names: list[str], prototypes: np.ndarray) -> tuple[list[str], list[float]]:
    langs, scores = [UND] * len(texts), [0.0] * len(texts)
    block: list[tuple[int, np.ndarray, np.ndarray]] = []

    def decide() -> None:
        vectors = bundle([(c, n) for _, c, n in block]).astype(np.float64)
        norms = np.maximum(np.linalg.norm(vectors, axis=1), 1e-12)
        cosines = np.round((vectors @ prototypes.T) / norms[:, None], 9)
        for (i, _, _), best, row in zip(block, cosines.argmax(axis=1), cosines, strict=True):
            langs[i], scores[i] = names[best], float(min(1.0, max(0.0, row[best])))
        block.clear()

    for i, text in enumerate(texts):
        codes, counts = grams(text) if text and names else (np.empty(0), np.empty(0))
        if len(codes):
            block.append((i, codes, counts))
        if len(block) == BLOCK or block and (i == len(texts) - 1 or len(codes) > CHUNK):
            decide()
    if block:
        decide()
    return langs, scores


def predict(docs: DataFrame, prototypes: dict[str, np.ndarray]) -> DataFrame:
    """``docs`` with lang_pred and score; columns of these names are replaced."""
    names = list(prototypes)
    matrix = np.stack([prototypes[n] for n in names]) if names else np.empty((0, DIMENSION))
    kept = docs.drop("lang_pred", "score")
    place = kept.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in (batch.slice(i, 1024) for i in range(0, batch.num_rows, 1024)):
                langs, scores = classify(piece.column(place).to_pylist(), names, matrix)
                yield pa.RecordBatch.from_arrays([*piece.columns, pa.array(langs, pa.string()), pa.array(scores, pa.float64())], [*piece.schema.names, "lang_pred", "score"])

    return kept.mapInArrow(run, with_fields(kept, ("lang_pred", "string"), ("score", "double")))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    prototypes = train(docs.where(~held_out(F.col("doc_id"))).select("text", "lang"))
    rows = predict(docs.select("doc_id", "text"), prototypes)
    return rows.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
