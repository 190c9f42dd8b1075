import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from logtide.llm import bitsliced, terms
from tests.llm.brute import LOWER

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def found(text):
    return TERM.findall((text or "").translate(LOWER))


def brute(docs, items, k):
    """{(item, text): [(doc_id, score)]} by scoring every document."""
    held = [(d, Counter(found(t))) for d, t in docs]
    n_docs, total = sum(bool(c) for _, c in held), sum(sum(c.values()) for _, c in held)
    df = Counter(t for _, c in held for t in c)
    out = {}
    for item, text in set(items):
        scored = []
        for d, c in held:
            m = 75 + (25 * sum(c.values()) * n_docs) // total if total else 0
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 12 * m)) for t in found(text) if c[t])
            if score > 0:
                scored.append((-score, d is None, d or 0, d))
        out[item, text] = [(d, -s) for s, _, _, d in sorted(scored)[:k]]
    return {key: rows for key, rows in out.items() if rows}


def test_slices_add_and_multiply():
    dice = np.random.default_rng(1)
    for n in (1, 63, 64, 65, 1000):
        a, b, w = dice.integers(0, 1 << 20, n), dice.integers(0, 1 << 20, n), dice.integers(0, 30_000, n)
        value = lambda planes: sum(bitsliced.unpack(p, n).astype(object) << i for i, p in enumerate(planes))  # noqa: E731, B023
        total = np.zeros((40, len(bitsliced.pack(np.zeros(n, bool)))), np.uint64)
        bitsliced.add(total, bitsliced.sliced(a))
        bitsliced.add(total, bitsliced.sliced(b), 3)
        assert (value(total) == a + 8 * b).all()
        assert (value(bitsliced.weighted(bitsliced.sliced(a), w)) == a * w).all()


def test_best_by_slices():
    dice = np.random.default_rng(2)
    for n, top in ((5, 4), (100, 3), (200, 1000), (64, 1)):
        values = dice.integers(0, top, (7, n))
        planes = bitsliced.pack((values[None] >> np.arange(12)[:, None, None]) & 1)
        for k in (1, 3, 20):
            chosen = bitsliced.unpack(bitsliced.best(planes, k), n)
            for row, bits in zip(values, chosen, strict=True):
                want = sorted((i for i in range(n) if row[i]), key=lambda i: (-row[i], i))[:k]
                assert sorted(want) == np.flatnonzero(bits).tolist()


def test_terms_are_those_of_the_expression():
    dice = random.Random(3)
    alphabet = "aZ09 _-\n\t.é  漢\U0001f600\x7f\x00"
    texts = ["".join(dice.choice(alphabet) for _ in range(dice.randrange(40))) for _ in range(500)] + [None, "", "x" * 3_000_000 + " y"]
    identity = {}
    for first, _, hashes, ends in terms.pieces(texts, 1000):
        for i, (a, b) in enumerate(zip([0, *ends[:-1]], ends)):
            words = found(texts[first + i])
            assert len(words) == b - a
            for w, h in zip(words, hashes[a:b].tolist(), strict=True):
                assert identity.setdefault(w, h) == h
    assert len(set(identity.values())) == len(identity)
    assert terms.sizes(texts).tolist() == [len(found(t)) for t in texts]


@pytest.mark.parametrize("blocks", [(1 << 14, 1 << 21), (7, 1 << 21), (1 << 14, 300)])
def test_search_like_all_scores(spark, hard, blocks, monkeypatch):
    monkeypatch.setattr(bitsliced, "CHUNK_BYTES", 2000)  # the driver's: several chunks
    items = [(f"i{i}", " ".join(f"w{(i * 37 + j * j) % 420}" for j in range(i))) for i in range(25)]
    items += [("i3", "W1 w1 w1 w2"), ("i3", "W1 w1 w1 w2"), ("none", None), ("empty", ""), ("gap", "--"), ("odd", "ünï \U0001f600 12345"), (None, "w5 w6"), ("once", "one two")]
    table = spark.createDataFrame(items, "item_id string, text string").withColumn("item", F.lit("clash")).withColumn("score", F.lit(0))
    n_docs, total = bitsliced.statistics(hard)
    docs = [(r.doc_id, r.text) for r in hard.collect()]
    assert (n_docs, total) == (sum(bool(found(t)) for _, t in docs), sum(len(found(t)) for _, t in docs))
    index = bitsliced.written(spark, bitsliced.build(hard.repartition(3), n_docs, total, *blocks))
    for k in (1, 20):
        rows = bitsliced.search(index, n_docs, table, k).collect()
        got = Counter((r.item_id, r["rank"], r.doc_id, r.score) for r in rows)
        want = Counter((item, i + 1, *row) for (item, _), best in brute(docs, [x for x in items if x[1] is not None], k).items() for i, row in enumerate(best))
        assert got == want


def test_search_cases(spark, hard, nothing):
    items = spark.createDataFrame([("a", "w1 w2")], "item_id string, text string")
    index = bitsliced.build(nothing, *bitsliced.statistics(nothing))
    assert bitsliced.search(index, 0, items).count() == 0
    n_docs, total = bitsliced.statistics(hard)
    index = bitsliced.build(hard, n_docs, total)
    assert bitsliced.search(index, n_docs, items.limit(0)).count() == 0
    assert bitsliced.search(index, n_docs, spark.createDataFrame([("a", "unknown")], "item_id string, text string")).count() == 0
    one = spark.createDataFrame([(1, "a a b")], "doc_id long, text string")
    index = bitsliced.build(one, *bitsliced.statistics(one))
    row = bitsliced.search(index, 1, spark.createDataFrame([("x", "a")], "item_id string, text string")).first()
    assert (row["rank"], row.doc_id, row.score) == (1, 1, math.floor(1000 * math.log(4 / 3)) * (2 * 10**9 // (2000 + 12 * 100)))


def test_search_finds_passages_of_the_benchmark(spark):
    from tests.llm.conftest import SF

    rows = bitsliced.query(spark, SF)
    assert rows.where("rank = 1").count() == spark.read.parquet(f"{SF}/benchmark.parquet").where("text is not null").count()
