"""Toxicity by non-negative positive-unlabelled learning.

Confirmed toxic documents are the positives; all documents of the training part, whatever their label, are the unlabelled rest, which holds toxic ones
too.  The risk of a classifier on both is corrected by the class prior p: with loss l, ``p R(positive, 1) + max(0, R(unlabelled, 0) - p R(positive, 0))``.
Where the second term would fall below 0 (the classifier learns the positives by heart), it is left out of a step.

Features are the terms, and the beginnings of 4 and 5 characters of longer ones (stems that stand with many endings, each of them rare), that stand in clearly more or fewer positives than other documents: document counts among positives and among unlabelled texts
are taken over the whole training part, first of buckets of terms (20 bits of hash), then of the terms of the clear buckets.  A text is the set of its features.  ``MEMBERS`` linear classifiers are
trained with numpy, each by a task of its own on its own bounded sample of about ``SAMPLE`` positives and four times as many unlabelled texts; the mean of their weights
scores every text.  The prior is the share of toxic labels of the training part and a margin (a twentieth and two standard errors), unless it is given: one that is too low makes the classifier
deny toxic texts among the unlabelled ones.  Where one that is too high makes it score unlabelled texts above the prior on average, the bias is lowered.

Bounds: members, sample, features and steps are parameters.  What reaches the driver are the chosen features (``FEATURES`` at most) and a vector a member.

Cases:  a null or empty text has no feature and gets the classifier's base score; equal texts have equal scores; labels are null-safe (a null one says nothing); a
document with several labels is toxic if one says so; labels without a document and documents without a label are allowed; repeated
positives count once; without a positive in the training part every score is 0; a null doc_id is in the training part and has no label; no documents give no
rows; very long texts are hashed in blocks; further columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import terms
from .common import read, saved, with_fields

BITS = 20
BUCKETS = 1 << BITS
FEATURES, LEAST_Z, OF_BEST, LEAST = 512, 4.0, 0.5, 3
"""Most features; how many standard errors apart a feature's shares among positives and unlabelled must be, at least, and as a part of the clearest feature's,
which keeps out words of a few copies of one positive; the least number of positives that hold one (or would, at the unlabelled texts' rate)."""
MEMBERS, SAMPLE, UNLABELLED, MARGIN = 4, 4_000, 4, 1.05
BROADCAST = 500_000
"""Most confirmed ids that are sent to every executor."""
STEPS, RATE, DECAY = 1000, 0.1, 5e-4
"""Adam's steps and first rate (it falls to 0), weight decay."""


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def labelled(labels: DataFrame) -> DataFrame:
    """(doc_id, toxic): one row a document."""
    return labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg((F.max("toxic") > 0).alias("toxic"))


LETTER = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"
BEGINNINGS = [re.compile(rf"(?<!{LETTER}){LETTER}{{{n}}}(?={LETTER})") for n in (4, 5)]
MARK = "\ue000"
"""Behind a beginning, so that it is not the term of the same letters."""


def _with_beginnings(text: str | None) -> str | None:
    """A text and, as terms behind it, the beginnings of its terms."""
    return text and " ".join([text, *(b + MARK for pattern in BEGINNINGS for b in set(pattern.findall(text)))])


def _pairs(texts: list[str | None], chosen: Callable) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For some texts at a time: the place of the first, and the distinct pairs of a text (counted from it) and a key; ``chosen`` gives which hashes count, and their keys."""
    for first, stop, hashes, ends in terms.pieces([_with_beginnings(t) for t in texts]):
        text = np.repeat(np.arange(stop - first), np.diff(ends, prepend=0))
        counts, keys = chosen(hashes)
        order = np.lexsort((keys, text[counts]))
        text, keys = text[counts][order], keys[order]
        new = np.concatenate([[True], (text[1:] != text[:-1]) | (keys[1:] != keys[:-1])]) if len(keys) else np.empty(0, bool)
        yield first, text[new], keys[new]


def _bucket(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(64 - BITS)).astype(np.int64)


def _known(known: np.ndarray) -> Callable:
    """Places of those hashes that are in the sorted array ``known``."""

    def chosen(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.searchsorted(known, hashes)
        counts = (at < len(known)) & (known[np.minimum(at, len(known) - 1)] == hashes) if len(known) else np.zeros(len(hashes), bool)
        return counts, at[counts]

    return chosen


def document_counts(docs: DataFrame, buckets: np.ndarray | None = None) -> DataFrame:
    """(key, n): in how many rows (text) each bucket of terms occurs or, given ``buckets``, each term of these; key null has the number of rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, exact, rows = np.zeros(BUCKETS, np.int64), {}, 0
        wanted = np.zeros(BUCKETS, bool)
        if buckets is not None:
            wanted[buckets] = True
        chosen = (lambda h: (np.ones(len(h), bool), _bucket(h))) if buckets is None else (lambda h: (wanted[_bucket(h)], h[wanted[_bucket(h)]].view(np.int64)))
        for batch in batches:
            rows += batch.num_rows
            for piece in (batch.slice(i, 1024) for i in range(0, batch.num_rows, 1024)):
                for _, _, keys in _pairs(piece.column(0).to_pylist(), chosen):
                    found, n = np.unique(keys, return_counts=True)
                    if buckets is None:
                        counts[found] += n
                    else:
                        for k, v in zip(found.tolist(), n.tolist(), strict=True):
                            exact[k] = exact.get(k, 0) + v
        some = np.flatnonzero(counts)
        keys, n = (some.tolist(), counts[some].tolist()) if buckets is None else (list(exact), list(exact.values()))
        yield pa.record_batch([pa.array([*keys, None], pa.int64()), pa.array([*n, rows], pa.int64())], names=["key", "n"])

    return docs.select(F.col("text").cast("string")).mapInArrow(run, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))


def features(positive: DataFrame, unlabelled: DataFrame, most: int = FEATURES) -> tuple[np.ndarray, int, int]:
    """Sorted hashes of the terms that tell positives from unlabelled texts, and the numbers of both: first the buckets that do, then the terms in them."""
    keys, n_p, n_u = _clear(document_counts(positive), document_counts(unlabelled), most)
    if keys:
        keys, _, _ = _clear(document_counts(positive, np.array(keys)), document_counts(unlabelled, np.array(keys)), most)
    return np.sort(np.array(keys, np.int64).view(np.uint64)), n_p, n_u


def _clear(positive: DataFrame, unlabelled: DataFrame, most: int) -> tuple[list[int], int, int]:
    """Keys whose shares among positives and unlabelled texts are clearly apart, clearest first."""
    both = positive.select("key", F.col("n").alias("p"), F.lit(0).alias("u")).unionByName(unlabelled.select("key", F.lit(0).alias("p"), F.col("n").alias("u")))
    counted = saved(both.groupBy("key").agg(F.sum("p").alias("p"), F.sum("u").alias("u")), "term-counts")
    n_p, n_u = counted.where("key is null").select("p", "u").first() or (0, 0)
    p, u = F.col("p"), F.col("u")
    share, rest, pooled = (p + 0.5) / (n_p + 1), (u + 0.5) / (n_u + 1), (p + u + 1) / (n_p + n_u + 2)
    z = F.abs(share - rest) / F.sqrt(pooled * (1 - pooled) * (1 / max(n_p, 1) + 1 / max(n_u, 1)))
    enough = counted.where("key is not null").where(F.greatest(p.cast("double"), u * n_p / max(n_u, 1)) >= LEAST)
    rows = enough.withColumn("z", z).where(F.col("z") >= LEAST_Z).orderBy(F.desc("z"), "key").limit(most).collect()
    return [r.key for r in rows if r.z >= OF_BEST * rows[0].z], n_p, n_u


def _bits(texts: list[str | None], known: np.ndarray) -> np.ndarray:
    """(texts, features): which features each text has."""
    out = np.zeros((len(texts), len(known)), bool)
    for first, text, place in _pairs(texts, _known(known)):
        out[first + text, place] = True
    return out


def fit(x: np.ndarray, positive: np.ndarray, prior: float) -> np.ndarray:
    """Weights of the features and, last, the bias, that minimise the non-negative risk with logistic loss: Adam over the whole sample.

    Texts with the same features are one row with a weight.
    """
    x, where = np.unique(x, axis=0, return_inverse=True)
    x = np.hstack([x.astype(np.float64), np.ones((len(x), 1))])
    p, u = (np.bincount(where.ravel()[rows], minlength=len(x)) / max(rows.sum(), 1) for rows in (positive, ~positive))
    w = np.zeros(x.shape[1])
    w[-1] = np.log(prior / (1 - prior))
    decay = np.append(np.full(len(w) - 1, DECAY), 0.0)
    mean, square = np.zeros_like(w), np.zeros_like(w)
    for step in range(1, STEPS + 1):
        z = np.clip(x @ w, -40, 40)
        s = 1 / (1 + np.exp(-z))
        excess = u - prior * p  # what is left of the unlabelled texts without their share of positives
        slope = prior * p * (s - 1) + (excess * s if excess @ np.logaddexp(0, z) >= 0 else 0)
        slope = x.T @ slope + decay * w
        mean, square = 0.9 * mean + 0.1 * slope, 0.99 * square + 0.01 * slope**2
        w -= RATE * (1 - step / STEPS) * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.99**step)) + 1e-8)
    return _calibrated(x, u, w, prior)


def _calibrated(x: np.ndarray, share: np.ndarray, w: np.ndarray, prior: float) -> np.ndarray:
    """The bias lowered until the mean score of the unlabelled texts is the prior, where it is above."""
    low, high = w[-1] - 40, w[-1]
    mean = lambda bias: share @ (1 / (1 + np.exp(-np.clip(x @ w + bias - w[-1], -40, 40))))
    if mean(high) > prior:
        for _ in range(60):
            low, high = ((low + high) / 2, high) if mean((low + high) / 2) < prior else (low, (low + high) / 2)
    return np.append(w[:-1], high)


def _sampled(rows: DataFrame, key: Column, member: int, size: int, total: int) -> DataFrame:
    """About ``size`` of ``total`` rows, by a hash."""
    share = min(1.0, size / max(total, 1))
    return rows.where(F.pmod(F.xxhash64(F.lit(member), key), F.lit(1 << 30)) < int(share * (1 << 30))).withColumn("member", F.lit(member))


def train(docs: DataFrame, labels: DataFrame, prior: float | None = None, members: int = MEMBERS, sample: int = SAMPLE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the features and the weights (with the bias last) learned from documents (doc_id, text) and labels (doc_id, toxic)."""
    spark = docs.sparkSession
    told = saved(labelled(labels), "labels")
    confirmed = told.where("toxic").select("doc_id")
    if confirmed.count() <= BROADCAST:  # else both sides are shuffled
        confirmed = F.broadcast(confirmed)
    positive = saved(docs.join(confirmed, "doc_id", "left_semi").where("text is not null").select("text").distinct(), "positives")
    if prior is None:
        share, n = told.agg(F.avg(F.col("toxic").cast("double")), F.count(F.lit(1))).first()
        prior = MARGIN * share + 2 * (share * (1 - share) / n) ** 0.5 if n else 0.0
    prior = min(0.9, max(0.001, prior))
    known, n_p, n_u = features(positive, docs)
    if not n_p:
        return known, np.array([-np.inf])
    chosen = None
    for m in range(members):
        p = _sampled(positive, F.col("text"), m, sample, n_p).withColumn("positive", F.lit(True))
        u = _sampled(docs.select("text", "doc_id"), F.struct("doc_id", "text"), m, UNLABELLED * sample, n_u).select("text", "member").withColumn("positive", F.lit(False))
        both = p.select("text", "member", "positive").unionByName(u.select("text", "member", "positive"))
        chosen = both if chosen is None else chosen.unionByName(both)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bits = [np.packbits(_bits(batch.slice(i, 1024).column(0).to_pylist(), known), axis=1) for i in range(0, batch.num_rows, 1024)]
            values = [row.tobytes() for part in bits for row in part]
            yield pa.record_batch([batch.column(1), batch.column(2), pa.array(values, pa.binary())], names=["member", "positive", "bits"])

    def learn(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["positive", "bits"], kind="stable")  # however the rows came
        packed = np.frombuffer(b"".join(frame.bits), np.uint8).reshape(len(frame), -1)
        x = np.unpackbits(packed, axis=1, count=len(known)) if len(known) else np.empty((len(frame), 0))
        w = fit(x, frame.positive.to_numpy(), prior)
        return pd.DataFrame({"member": [int(frame.member.iloc[0])], "w": [w.tolist()]})

    learned = chosen.mapInArrow(rows, "member int, positive boolean, bits binary").groupBy("member").applyInPandas(learn, "member int, w array<double>")
    weights = [r.w for r in learned.orderBy("member").collect()]
    return known, np.mean(weights, axis=0)


def score(docs: DataFrame, known: np.ndarray, weights: np.ndarray) -> DataFrame:
    """``docs`` (with text) and their ``score``; a column of this name is replaced."""
    kept = docs.drop("score")
    place = kept.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in (batch.slice(i, 1024) for i in range(0, batch.num_rows, 1024)):
                z = np.full(piece.num_rows, weights[-1])
                for first, text, feature in _pairs(piece.column(place).cast(pa.string()).to_pylist(), _known(known)):
                    z += np.bincount(first + text, weights[feature], piece.num_rows)
                values = np.round(1 / (1 + np.exp(-np.clip(z, -700, 700))), 9)
                yield pa.RecordBatch.from_arrays([*piece.columns, pa.array(values)], [*piece.schema.names, "score"])

    return kept.mapInArrow(run, with_fields(kept, ("score", "double")))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    labels = read(spark, sf_dir, "labels").where(~held_out(F.col("doc_id")))
    known, weights = train(docs.where(~held_out(F.col("doc_id"))), labels)
    rows = score(docs, known, weights)
    return rows.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
