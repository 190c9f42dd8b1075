import hashlib
import random
import zlib
from collections import Counter
from fractions import Fraction
from math import floor

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from logtide.llm import centroids, terms, toxicity
from tests.llm.conftest import SF

VECTORS = "vec_id long, embedding array<float>"


def lloyd(vectors, k, rounds):
    """Rows of (vec_id, cluster, distance) and centroids, one vector at a time."""
    kept = [(i, [floor(64 * Fraction(x)) for x in v]) for i, v in vectors]
    starts = sorted((hashlib.sha256(f"1:{i}".encode()).hexdigest(), q) for i, q in kept if i is not None)[:k]
    middle = [q for _, q in starts]

    def near(q):
        return min((sum((a - b) ** 2 for a, b in zip(q, c)), n) for n, c in enumerate(middle))

    for _ in range(rounds):
        own = [near(q)[1] for _, q in kept]
        for n in range(len(middle)):
            mine = [q for (_, q), c in zip(kept, own) if c == n]
            if mine:
                middle[n] = [sum(column) // len(mine) for column in zip(*mine)]
    return [(i, near(q)[1], near(q)[0]) for i, q in kept], middle


@pytest.fixture(scope="module")
def vectors():
    dice = random.Random(5)
    one = lambda: [dice.choice([-1.5, -0.015625, 0.0, 0.25, 1.0, 100.0]) + dice.random() for _ in range(64)]
    base = [one() for _ in range(40)]
    rows = [(i, dice.choice(base)) for i in range(200)] + [(1000 + i, base[0]) for i in range(150)] + [(7, base[1]), (7, base[2]), (None, base[3]), (None, base[4])]
    return [(i, [float(np.float32(x)) for x in v]) for i, v in rows]


def test_clusters_like_plain_rounds(spark, vectors):
    odd = [(1, None), (2, []), (3, [1.0] * 63), (4, [1.0] * 65), (5, [None] + [1.0] * 63), (6, [float("nan")] * 64), (8, [float("inf")] + [0.0] * 63)]
    table = spark.createDataFrame(vectors + odd, VECTORS).withColumn("n", F.lit("clash")).withColumn("cluster", F.lit("clash"))
    for k, rounds in ((16, 3), (3, 1), (1000, 2)):
        rows, middle, inertia = centroids.cluster(table.repartition(5), k, rounds)
        want, wanted = lloyd(vectors, k, rounds)
        assert middle.tolist() == wanted
        assert Counter(tuple(r) for r in rows.collect()) == Counter(want)
        assert sum(inertia.values()) == sum(d for _, _, d in want)


def test_a_common_vector_is_joined_by_broadcast(spark, vectors):
    kept = centroids.quantised(spark.createDataFrame(vectors, VECTORS))
    distinct, start = centroids.groups(kept), centroids.starts(kept)
    clustered = centroids.assigned(distinct, start)
    plan = centroids.joined(kept, clustered, 10**6)._jdf.queryExecution().optimizedPlan().toString()
    assert "strategy=broadcast" in plan
    for total in (10**6, len(vectors), 1):  # none, some, and all groups are common
        assert centroids.joined(kept, clustered, total).count() == len(vectors)


def test_cluster_cases(spark):
    empty = spark.createDataFrame([], VECTORS)
    rows, middle, inertia = centroids.cluster(empty)
    assert rows.count() == 0 and not len(middle) and not inertia
    rows, middle, _ = centroids.cluster(spark.createDataFrame([(1, [0.5] * 64)], VECTORS))
    assert [tuple(r) for r in rows.collect()] == [(1, 0, 0)] and middle.tolist() == [[32] * 64]
    with pytest.raises(PySparkException, match="too large"):
        centroids.cluster(spark.createDataFrame([(1, [131072.0] + [0.5] * 63)], VECTORS))
    edge = spark.createDataFrame([(1, [-131071.9] * 64), (2, [131071.9] * 64)], VECTORS)
    rows, _, _ = centroids.cluster(edge, 1, 1)
    low, high = (floor(64 * float(np.float32(x))) for x in (-131071.9, 131071.9))
    assert {r.vec_id: r.distance for r in rows.collect()} == {1: 64 * (low - (low + high) // 2) ** 2, 2: 64 * (high - (low + high) // 2) ** 2}


RUDE = ["blockhead", "nitwit", "dunce"]


def rated(n, seed, rate=0.15):
    """(doc_id, text, rude): texts of common words, some of them with rude ones."""
    dice = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(300)]
    rows = []
    for i in range(n):
        words, rude = [dice.choice(vocabulary) for _ in range(dice.randrange(5, 60))], dice.random() < rate
        for _ in range(dice.randrange(1, 4) if rude else 0):
            words.insert(dice.randrange(len(words)), dice.choice(RUDE).upper() + dice.choice(["", "!", ","]))
        rows.append((i, " ".join(words), rude))
    return rows


def test_toxicity_from_positives_and_unlabelled(spark):
    rows = rated(3000, 1)
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(rude)) for i, _, rude in rows[:1200]], "doc_id long, toxic int")
    known, weights = toxicity.train(docs.repartition(5), labels)
    fresh = rated(1000, 2)
    got = {r.doc_id: r.score for r in toxicity.score(spark.createDataFrame([r[:2] for r in fresh], "doc_id long, text string"), known, weights).collect()}
    assert all((got[i] >= 0.5) == rude for i, _, rude in fresh)
    again = toxicity.train(docs.coalesce(1), labels)
    assert (again[0] == known).all() and np.allclose(again[1], weights)
    only = toxicity.train(docs, labels.where("toxic = 1"), prior=0.17)  # confirmed positives and a prior are enough
    got = {r.doc_id: r.score for r in toxicity.score(spark.createDataFrame([r[:2] for r in fresh], "doc_id long, text string"), *only).collect()}
    assert sum((got[i] >= 0.5) == rude for i, _, rude in fresh) > 980


def test_risk_stays_above_zero():
    """More positives than the prior allows: the plain risk would fall without end, the non-negative one does not."""
    dice = np.random.default_rng(1)
    x = np.vstack([np.ones((50, 1)), (dice.random((400, 1)) < 0.3)]).astype(bool)
    positive = np.arange(450) < 50
    w = toxicity.fit(x, positive, 0.6)
    mean = lambda rows: (1 / (1 + np.exp(-(rows @ w[:-1] + w[-1])))).mean()
    assert np.abs(w).max() < 20 and mean(x[~positive]) < 0.601 and mean(x[positive]) > 0.9


def test_toxicity_cases(spark, hard, nothing):
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)] + [(1, None), (None, 1), (5000, 1), (3, 0), (3, 1)], "doc_id long, toxic int")
    known, weights = toxicity.train(hard, labels)
    rows = toxicity.score(hard.withColumn("score", F.lit("clash")), known, weights)
    got = {(r.doc_id, r.text): r.score for r in rows.collect()}
    assert len(got) == len({(r.doc_id, r.text) for r in hard.collect()}) and all(0 <= s <= 1 for s in got.values())
    assert got[95, None] == got[96, ""] == got[97, " \n\t\n "]
    assert rows.count() == hard.count()
    assert toxicity.score(nothing, known, weights).count() == 0
    for docs, told in ((nothing, labels), (hard, labels.limit(0)), (hard, labels.where("toxic = 0"))):
        assert {r.score for r in toxicity.score(hard, *toxicity.train(docs, told)).collect()} == {0.0}


def test_toxicity_query(spark, documents):
    rows = toxicity.query(spark, SF).collect()
    words = {"trash", "pathetic", "idiot", "disgusting", "worthless", "stupid", "clown", "loser", "scum", "moron"}
    text = {r.doc_id: r.text or "" for r in documents.collect()}
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and r.predicted == int(r.score >= 0.5)
    right = [r.predicted == int(any(w.strip(".,!").lower() in words for w in text[r.doc_id].split())) for r in rows]
    assert len(rows) == len(text) and sum(right) / len(right) > 0.98


def test_counts_of_documents(spark, hard):
    texts = [r.text for r in hard.collect()]
    hashes = [set(h[a:b].tolist()) for _, _, h, ends in terms.pieces(texts) for a, b in zip([0, *ends[:-1]], ends)]
    counts = {r.key: r.n for r in toxicity.document_counts(hard.repartition(3)).collect()}
    want = Counter(b for s in hashes for b in {h >> 44 for h in s})
    assert counts.pop(None) == hard.count() and counts == want
    some = np.array(sorted(want)[::3])
    counts = {r.key: r.n for r in toxicity.document_counts(hard.repartition(3), some).collect()}
    want = Counter(int(np.uint64(h).view(np.int64)) for s in hashes for h in s if h >> 44 in set(some.tolist()))
    assert counts.pop(None) == hard.count() and counts == want


def test_toxic_stems_with_many_endings(spark):
    """Each form of a stem is too rare to be a feature; their common beginning is one."""
    import random

    from logtide.llm import toxicity

    dice = random.Random(12)
    word = lambda n: "".join(dice.choice("abdegiklmnoprstu") for _ in range(n))
    plain = [word(dice.randrange(2, 8)) for _ in range(400)]
    rows = [(i, " ".join([*dice.choices(plain, k=30), *(["Lowei" + word(4)] if i % 10 == 0 else [])]), int(i % 10 == 0)) for i in range(2000)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows if r[0] < 1200], "doc_id long, toxic int")
    got = toxicity.score(docs, *toxicity.train(docs.where("doc_id < 1200"), labels, members=1)).where("doc_id >= 1200").collect()
    found = {r.doc_id for r in got if r.score >= 0.5}
    assert len([i for i in found if i % 10 == 0]) >= 76 and not [i for i in found if i % 10]
    assert toxicity._with_beginnings("Abcdef abcd, x") == "Abcdef abcd, x Abcd\ue000 Abcde\ue000" and toxicity._with_beginnings(None) is None
