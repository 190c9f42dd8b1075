"""Ranked lexical search over a bit-sliced impact index.

A document's impact for a term is ``(10^9 tf) div (1000 tf + 12 m)`` with m = 75 + (25 n N) div L: n is its length in terms, N the number of
documents that have terms, L the length of all.  The index deals each input partition's documents to blocks of at most ``DOCS`` documents and
about ``TERMS`` terms; inside a block a document is a position, in order of its id.  For each term a block holds the positions of its
documents and, for each of the 20 bits of an impact, a bitmap over them.  So the index is written by one pass without a shuffle, and depends on
the corpus only through N and L, which a pass before it counts.

A search takes the items in chunks.  The bitmaps of an item's terms are multiplied by the term's weight, ``floor(1000 ln((2N + 2) / (2df + 1)))``,
and added up by bitwise carry arithmetic on whole words: one operation adds a bit of 64 documents, for all items of a batch at once.  The best k of
a block are found from the most significant slice down: documents that have the bit are taken while they are no more than are
still wanted, and else go on alone.  Blocks give k rows an item; the first k of these by score and id are the answer, which is exact.

Terms are met by 64-bit hashes, taken as exact.  Ids are cast to long.

Cases:  a null or empty text, and one without a term, is no document (N) and no result; a null id comes after all others of its score; rows that
repeat an id are documents of their own; items of one id and text count once, those of one id and several texts are ranked apart, with equal item_id; a
null item_id is kept; an item without terms, or with none that a document holds, has no rows; very long texts are hashed in blocks and
stand in a block of their own; no documents or no items give no rows; further columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import terms
from .common import LOWER, UPPER, read, scratch

K = 20
DOCS, TERMS = 1 << 14, 1 << 21
"""Most documents of a block, and terms after which it is closed: they bound a task's memory at any size of the input."""
BITS = 20
"""An impact is below 10^6."""
CHUNK_BYTES = 8 << 20
"""Bytes of item texts, on average, that are answered by one pass over the index."""
PLANE_BYTES = 64 << 20
"""Memory of the bitmaps that a batch of items works on."""
INDEX = "block long, ids array<long>, terms binary, ends binary, positions binary, slices binary"


def statistics(docs: DataFrame) -> tuple[int, int]:
    """N and L of documents (text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = total = 0
        for batch in batches:
            found = terms.sizes(batch.column(0).to_pylist())
            n, total = n + int((found > 0).sum()), total + int(found.sum())
        yield pa.record_batch([pa.array([n]), pa.array([total])], names=["n", "total"])

    row = docs.select(F.col("text").cast("string")).mapInArrow(run, "n long, total long").agg(F.sum("n"), F.sum("total")).first()
    return int(row[0] or 0), int(row[1] or 0)


def impacts(tf: np.ndarray, n: np.ndarray, docs: int, total: int) -> np.ndarray:
    """The impact of ``tf`` occurrences in documents of ``n`` terms."""
    lengths, where = np.unique(n, return_inverse=True)
    m = np.array([75 + (25 * int(x) * docs) // max(total, 1) for x in lengths], np.int64)[where]  # whole numbers without a bound
    return (1_000_000_000 * tf) // (1000 * tf + 12 * m)


def pack(bits: np.ndarray) -> np.ndarray:
    """Bitmaps (last axis) in 64-bit words."""
    packed = np.packbits(bits, axis=-1, bitorder="little")
    gap = -packed.shape[-1] % 8
    return np.ascontiguousarray(np.pad(packed, [(0, 0)] * (packed.ndim - 1) + [(0, gap)])).view(np.uint64)


def unpack(words: np.ndarray, n: int) -> np.ndarray:
    return np.unpackbits(np.ascontiguousarray(words).view(np.uint8), axis=-1, count=n, bitorder="little")


def sliced(values: np.ndarray, bits: int = BITS) -> np.ndarray:
    """(bits, words): bitmap i has the i-th bit of each value."""
    return pack((values[None, :] >> np.arange(bits)[:, None]) & 1)


def add(total: np.ndarray, more: np.ndarray, shift: int = 0) -> None:
    """Add slices to slices in place, ``more`` moved up by ``shift`` bits: the carry is a bitmap."""
    carry = None
    for i in range(len(more)):
        a, b = total[i + shift], more[i]
        half = a ^ b
        if carry is None:
            total[i + shift], carry = half, a & b
        else:
            total[i + shift], carry = half ^ carry, (a & b) | (carry & half)
    i = len(more) + shift
    while carry is not None and i < len(total) and carry.any():
        total[i], carry = total[i] ^ carry, total[i] & carry
        i += 1


def weighted(slices: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Slices of each value times its weight: the slices are added once for each bit of the weights, where that bit is set."""
    top = int(weights.max(initial=0)).bit_length()
    out = np.zeros((len(slices) + top, slices.shape[1]), np.uint64)
    for j in range(top):
        add(out, slices & pack((weights >> j) & 1)[None, :], j)
    return out


def best(total: np.ndarray, k: int) -> np.ndarray:
    """(items, words): bitmap of the k positions of the greatest values above 0 of each item; of equal ones the first positions."""
    sure, open_ = np.zeros(total.shape[1:], np.uint64), np.bitwise_or.reduce(total, axis=0)
    count = lambda x: np.bitwise_count(x).sum(axis=-1, dtype=np.int64)
    wanted = np.full(total.shape[1], k, np.int64)
    enough = count(open_) > wanted  # fewer than k are all taken
    sure[~enough], open_[~enough] = open_[~enough], 0
    for plane in total[::-1]:
        with_bit = open_ & plane
        n = count(with_bit)
        many = (n > wanted)[:, None]
        sure |= np.where(many, np.uint64(0), with_bit)
        wanted -= np.where(many[:, 0], 0, n)
        open_ = np.where(many, with_bit, open_ & ~plane)
    for i in np.flatnonzero(open_.any(axis=1) & (wanted > 0)):  # ties
        bits = unpack(open_[i], open_.shape[1] * 64)
        bits[np.flatnonzero(bits)[wanted[i] :]] = 0
        sure[i] |= pack(bits)
    return sure


class _Block:
    """Documents of a block while it is filled."""

    def __init__(self) -> None:
        self.ids: list = []
        self.hashes: list[np.ndarray] = []
        self.sizes: list[np.ndarray] = []
        self.terms = 0

    def take(self, ids: list, hashes: np.ndarray, sizes: np.ndarray) -> None:
        self.ids += ids
        self.hashes.append(hashes)
        self.sizes.append(sizes)
        self.terms += len(hashes)

    def row(self, block: int, docs: int, total: int) -> pa.RecordBatch:
        ids = pa.array(self.ids, pa.int64())
        place = np.empty(len(ids), np.int64)
        place[pc.array_sort_indices(ids, null_placement="at_end").to_numpy()] = np.arange(len(ids))
        size, hashes = np.concatenate(self.sizes), np.concatenate(self.hashes)
        position = np.repeat(place, size)
        order = np.lexsort((position, hashes))
        hashes, position = hashes[order], position[order]
        new = np.concatenate([[True], (hashes[1:] != hashes[:-1]) | (position[1:] != position[:-1])]) if len(hashes) else np.empty(0, bool)
        at = np.flatnonzero(new)
        tf, hashes, position = np.diff(at, append=len(new)), hashes[at], position[at]
        lengths = np.empty(len(ids), np.int64)
        lengths[place] = size
        slices = sliced(impacts(tf, lengths[position], docs, total)) if len(at) else np.empty((BITS, 0), np.uint64)
        begins = np.flatnonzero(np.concatenate([[True], hashes[1:] != hashes[:-1]])) if len(at) else at
        ends = np.append(begins[1:], len(hashes)) if len(at) else at
        raw = lambda x, kind: pa.array([np.ascontiguousarray(x, kind).tobytes()], pa.binary())
        ordered = ids.take(pa.array(np.argsort(place)))
        return pa.record_batch(
            [pa.array([block]), pa.array([ordered.to_pylist()], pa.list_(pa.int64())), raw(hashes[begins], np.uint64), raw(ends, np.int32), raw(position, np.uint16), raw(slices, np.uint64)],
            names=["block", "ids", "terms", "ends", "positions", "slices"],
        )


def build(docs: DataFrame, n_docs: int, total: int, most_docs: int = DOCS, most_terms: int = TERMS) -> DataFrame:
    """The index of documents (doc_id, text): a row a block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, block = TaskContext.get().partitionId() << 32, _Block()
        for batch in batches:
            for piece in (batch.slice(i, 1024) for i in range(0, batch.num_rows, 1024)):
                ids = piece.column(0).to_pylist()
                for first, stop, hashes, ends in terms.pieces(piece.column(1).to_pylist()):
                    if block.ids and (block.terms + len(hashes) > most_terms or len(block.ids) + stop - first > most_docs):
                        yield block.row(number, n_docs, total)
                        number, block = number + 1, _Block()
                    block.take(ids[first:stop], hashes, np.diff(ends, prepend=0))
        if block.ids:
            yield block.row(number, n_docs, total)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, INDEX)


def written(spark: SparkSession, index: DataFrame) -> DataFrame:
    """The index as a table of the shared folder; rows are large, so files close their row groups by bytes from the first row on."""
    path = scratch(spark, "impacts")
    index.write.option("parquet.page.size.row.check.min", 1).option("parquet.block.size", 32 << 20).option("compression", "zstd").parquet(path)
    return spark.read.schema(INDEX).parquet(path)


def _parsed(batch: pa.RecordBatch, i: int) -> tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """block, terms, their bounds in the postings, positions and slices."""
    raw = lambda name, kind: np.frombuffer(batch.column(name)[i].as_py(), kind)
    ends = raw("ends", np.int32).astype(np.int64)
    return batch.column("block")[i].as_py(), raw("terms", np.uint64), np.concatenate([[0], ends]), raw("positions", np.uint16), raw("slices", np.uint64).reshape(BITS, -1)


def frequencies(index: DataFrame, wanted: np.ndarray) -> dict[int, int]:
    """How many documents hold each of the (sorted, distinct) terms ``wanted``; one row a wanted term comes back."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(len(wanted), np.int64)
        for batch in batches:
            for i in range(batch.num_rows):
                known, ends = (np.frombuffer(batch.column(c)[i].as_py(), kind) for c, kind in (("terms", np.uint64), ("ends", np.int32)))
                at = np.searchsorted(known, wanted)
                there = np.flatnonzero((at < len(known)) & (known[np.minimum(at, len(known) - 1)] == wanted)) if len(known) else np.empty(0, np.int64)
                counts[there] += np.diff(ends, prepend=0)[at[there]]
        some = np.flatnonzero(counts)
        yield pa.record_batch([pa.array(some), pa.array(counts[some])], names=["term", "n"])

    rows = index.select("terms", "ends").mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()
    return {int(wanted[r.term]): r.n for r in rows}


def answered(index: DataFrame, items: list[dict[int, int]], weights: dict[int, int], k: int) -> DataFrame:
    """(item, doc_id, score): the k best of each block for each item (by its place) of term counts."""
    known = np.array(sorted(weights), np.uint64)
    weight = np.array([weights[int(t)] for t in known], np.int64)
    own = [{int(np.searchsorted(known, np.uint64(t))): n for t, n in item.items() if t in weights} for item in items]
    widest = max((sum(int(weight[t]) * n for t, n in item.items()) for item in own), default=0)
    planes = (widest * 1_000_000).bit_length() + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                _, found, bounds, positions, slices = _parsed(batch, i)
                ids = batch.column("ids")[i].values
                yield from _search(ids, found, bounds, positions, slices)

    def _search(ids: pa.Array, found: np.ndarray, bounds: np.ndarray, positions: np.ndarray, slices: np.ndarray) -> Iterator[pa.RecordBatch]:
        at = np.searchsorted(found, known)
        here = np.flatnonzero((at < len(found)) & (found[np.minimum(at, len(found) - 1)] == known)) if len(found) else np.empty(0, np.int64)
        if not len(here):
            return
        at = at[here]
        length = bounds[at + 1] - bounds[at]
        columns = np.repeat(bounds[at] - np.cumsum(length) + length, length) + np.arange(length.sum())
        term = np.repeat(np.arange(len(here)), length)
        kept = pack(np.stack([unpack(plane, len(positions))[columns] for plane in slices]))
        bits = unpack(weighted(kept, weight[here][term]), len(columns))  # weighted impacts, a row a bit
        place, starts = positions[columns].astype(np.int64), np.cumsum(length) - length
        local = {int(t): j for j, t in enumerate(here)}
        wide = -(-len(ids) // 64)
        most = max(1, PLANE_BYTES // (8 * wide * max(len(bits), planes)))  # bitmaps that fit
        todo = [(j, [(local[t], n) for t, n in item.items() if t in local]) for j, item in enumerate(own)]
        todo = [(j, held) for j, held in todo if held]
        while todo:
            group, used = [], set()
            while todo and (not group or len(group) < most and len(used | {t for t, _ in todo[0][1]}) <= most):
                group.append(todo.pop(0))
                used |= {t for t, _ in group[-1][1]}
            yield from _scored(group, sorted(used), bits, place, starts, length, ids, wide)

    def _scored(group: list, used: list[int], bits: np.ndarray, place: np.ndarray, starts: np.ndarray, length: np.ndarray, ids: pa.Array, wide: int) -> Iterator[pa.RecordBatch]:
        maps, column = np.zeros((len(bits), len(used) + 1, wide), np.uint64), {t: j for j, t in enumerate(used)}
        for t in used:  # from places among a term's documents to places in the block
            dense = np.zeros((len(bits), wide * 64), np.uint8)
            span = slice(starts[t], starts[t] + length[t])
            dense[:, place[span]] = bits[:, span]
            maps[:, column[t]] = pack(dense)
        total = np.zeros((planes, len(group), wide), np.uint64)
        by_shift: dict[int, list[list[int]]] = {}
        for i, (_, held) in enumerate(group):  # an item that repeats a term adds its bitmaps once for each bit of the count
            for t, n in held:
                for shift in range(n.bit_length()):
                    if n >> shift & 1:
                        by_shift.setdefault(shift, [[] for _ in group])[i].append(column[t])
        for shift, lists in by_shift.items():
            for step in range(max(map(len, lists))):
                add(total, maps[:, [x[step] if step < len(x) else len(used) for x in lists]], shift)
        chosen = unpack(best(total, k), len(ids))
        item, position = np.nonzero(chosen)
        score = np.zeros(len(item), np.int64)
        for i, plane in enumerate(total):
            word = plane[item, position >> 6]
            score |= ((word >> (position & 63).astype(np.uint64)) & np.uint64(1)).astype(np.int64) << i
        numbers = np.array([j for j, _ in group], np.int64)[item]
        yield pa.record_batch([pa.array(numbers), ids.take(pa.array(position)), pa.array(score)], names=["item", "doc_id", "score"])

    return index.mapInArrow(run, "item long, doc_id long, score long")


def search(index: DataFrame, n_docs: int, items: DataFrame, k: int = K) -> DataFrame:
    """(item_id, rank, doc_id, score): the k best documents for each of ``items`` (item_id, text), in chunks of items that are known to be small."""
    spark = index.sparkSession
    rows = items.select("item_id", F.col("text").cast("string").alias("text")).where("text is not null").distinct()
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    chunks = max(1, -(-size // CHUNK_BYTES))
    out = None
    for chunk in range(chunks):
        part = rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(chunks)) == chunk).collect() if size else []
        counts = []
        for _, _, hashes, ends in terms.pieces([r.text for r in part]):
            for a, b in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True):
                found, n = np.unique(hashes[a:b], return_counts=True)
                counts.append(dict(zip(found.tolist(), n.tolist(), strict=True)))
        wanted = np.array(sorted(set().union(*counts)), np.uint64)
        df = frequencies(index, wanted) if len(wanted) else {}
        weights = {t: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * n + 1))) for t, n in df.items()}
        scored = answered(index, counts, {t: w for t, w in weights.items() if w > 0}, k)
        names = spark.createDataFrame([(i, r.item_id) for i, r in enumerate(part)], f"item long, item_id {rows.schema['item_id'].dataType.simpleString()}")
        first = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))
        ranked = scored.withColumn("rank", first).where(F.col("rank") <= k).join(F.broadcast(names), "item")  # names: a row an item of the chunk
        found = ranked.select("item_id", "rank", "doc_id", "score")
        out = found if out is None else out.unionByName(found)
    return out


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    n_docs, total = statistics(docs)
    index = written(spark, build(docs, n_docs, total))
    return search(index, n_docs, read(spark, sf_dir, "benchmark"))


_WORDS = f"regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{terms.TERM}')"
ORACLE = f"""
WITH t AS (SELECT doc_id, len(w) AS n, unnest(w) AS term FROM (SELECT doc_id, {_WORDS} AS w FROM documents)),
p AS (SELECT doc_id, term, any_value(n) AS n, count(*) AS tf FROM t GROUP BY doc_id, term),
s AS (SELECT count(DISTINCT doc_id) AS n_docs, count(*) AS total FROM t),
w AS (SELECT term, CAST(floor(1000 * ln((2 * (SELECT n_docs FROM s) + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM p GROUP BY term),
i AS (SELECT item_id, unnest({_WORDS}) AS term FROM benchmark),
x AS (SELECT item_id, p.doc_id, CAST(sum(w.w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * n_docs) // total)))) AS BIGINT) AS score
      FROM i JOIN w USING (term) JOIN p USING (term), s GROUP BY item_id, p.doc_id)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM x WHERE score > 0) WHERE rank <= {K}
"""
