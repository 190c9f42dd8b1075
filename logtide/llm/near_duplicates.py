"""Jaccard join of documents on sets of word shingles, exact, by set-relation skipping.

Documents of equal sets are one class; everything after the first pass works on classes.

1. One pass gives every row its set's size and id and counts all shingles of all documents in ``BUCKETS`` buckets.
2. Shingles are ordered by that count, rare ones first.  A class is indexed under its first ``n - ceil(0.8 n) + 1`` shingles only; any two
   classes that link meet in the list of their first common shingle, and there their sizes and positions allow the overlap that a link needs.
   The list of a shingle that the counts show to be frequent is dealt to parts of about ``PART`` entries, so no list is the work of one task.
3. Lists are sorted by (size, position) and cut into blocks.  A first round compares each entry with one of a tree over its part
   (and the parts' first entries with one another).  Later rounds compare the parts of a list that holds more than one component in pairs, and
   each entry skips a whole block if its sizes and positions cannot give the overlap, or all of it is in the entry's component already.
4. Pairs are answered on whole sets: the text of one side is sent to the other.  A class that links with others takes that of most links as its leader; the overlap with it
   says how many shingles the two do not share.  Later pairs are answered from the overlap of their leaders, which is computed once:  it differs from
   theirs by at most the unshared shingles.  Only pairs which that leaves open are answered on their own texts.

``near_components`` skips pairs that are in one component already (links inside a component do not change it); ``join`` lists every link.
A pair is dropped unanswered if the parity bitmaps of its sets (each shingle flips one of ``64 * MASKS`` bits) differ in so many
bits that the sets must differ in too many shingles; sets of more than about 1,200 shingles always pass that test, and only size and position skip them.

Cases:  null or wordless texts have the empty set, link with nothing and are their own component; rows that
repeat an id are separate rows of the least id's component; a null id never is a component's name if another id is there; an empty table gives
no row; a very long text is hashed in blocks, and its set (8 bytes a shingle) is held by one task at a time; other columns are ignored.
Set ids and shingle hashes have 64 bits and are taken as exact.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read, saved
from .components import components, extended
from .shingles import GOLD, STEP, mix, set_id, shingle_sets

K, PERCENT = 5, 80
BUCKETS, CHUNK = 1 << 22, 1 << 14
MASKS = 8
PART, BLOCK, HUB = 512, 32, 4096
ROUNDS = (1, None)
"""With how many most similar members of other components a later round compares an entry in a part; None: with all."""
PAIR, TOP, ENTRY = 0, 1, 2


def _bucket(hashes: np.ndarray) -> np.ndarray:
    return (hashes & np.uint64(BUCKETS - 1)).astype(np.int64)


def _prefix(n: int) -> int:
    return n - (-(-PERCENT * n // 100)) + 1


def _needed(a, b):
    """Least common shingles of linked sets of sizes a and b."""
    return -(-PERCENT * (a + b) // (100 + PERCENT))


def _mask(hashes: np.ndarray) -> np.ndarray:
    """The parity of the set's shingles in each of 64 * MASKS bits, as MASKS numbers."""
    odd = np.bincount((hashes >> np.uint64(32)).astype(np.int64) % (64 * MASKS), minlength=64 * MASKS) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def _may_link(n, bits):
    """n: sum of both sizes; bits: in how many bits the masks differ, at most the number of unshared shingles."""
    return (n - bits) * (100 + PERCENT) >= 2 * PERCENT * n


MASK_NAMES = [f"m{i}" for i in range(MASKS)]
LINKED = f"{100 + PERCENT} * common >= {PERCENT} * (n_a + n_b)"


def sets(docs: DataFrame) -> tuple[DataFrame, np.ndarray, int]:
    """(doc_id, print, n, sid, masks) of every row; the rank of each bucket, about 8 log2 of the shingles in it; and their sum."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(BUCKETS, np.int32)
        names = ["doc_id", "print", "n", "sid", "chunk", "counts", *MASK_NAMES]
        for batch in batches:
            sizes, sids, masks = [], [], []
            for s, _ in shingle_sets(batch.column(1).to_pylist(), K):
                np.add.at(counts, _bucket(s), 1)
                sizes.append(len(s))
                sids.append(set_id(s))
                masks.append(_mask(s))
            own = [pa.array(m) for m in np.array(masks, np.int64).reshape(-1, MASKS).T]
            blank = [pa.nulls(len(sizes), pa.int32()), pa.nulls(len(sizes), pa.binary())]
            yield pa.record_batch([batch.column(0), batch.column(2), pa.array(sizes, pa.int64()), pa.array(sids, pa.int64()), *blank, *own], names=names)
        pack, parts = zstandard.ZstdCompressor(level=1), counts.reshape(-1, CHUNK)
        used = np.flatnonzero(parts.any(axis=1))
        blank = pa.nulls(len(used), pa.int64())
        blobs = pa.array([pack.compress(parts[i].tobytes()) for i in used.tolist()], pa.binary())
        yield pa.record_batch([blank, blank, blank, blank, pa.array(used.astype(np.int32)), blobs, *([blank] * MASKS)], names=names)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack, total = zstandard.ZstdDecompressor(), {}
        for batch in batches:
            for i, blob in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                part = np.frombuffer(unpack.decompress(blob.as_py()), np.int32)
                total[i] = total[i] + part if i in total else part.astype(np.int64)
        rank = {i: np.floor(8 * np.log2(np.maximum(c, 1))).astype(np.uint8).tobytes() for i, c in total.items()}
        columns = [pa.array(list(total), pa.int32()), pa.array(list(rank.values()), pa.binary()), pa.array([int(c.sum()) for c in total.values()], pa.int64())]
        yield pa.record_batch(columns, names=["chunk", "ranks", "total"])

    schema = "doc_id long, print long, n long, sid long, chunk int, counts binary, " + ", ".join(f"{m} long" for m in MASK_NAMES)
    out = saved(docs.selectExpr("cast(doc_id as long) doc_id", "text", "xxhash64(text) print").mapInArrow(run, schema), "near-sets")
    added = out.where("chunk is not null").select("chunk", "counts").repartition("chunk").mapInArrow(add, "chunk int, ranks binary, total long")
    ranks, total = np.zeros(BUCKETS, np.uint8), 0
    for row in added.toLocalIterator():  # BUCKETS bytes in all
        ranks[row.chunk * CHUNK : (row.chunk + 1) * CHUNK] = np.frombuffer(row.ranks, np.uint8)
        total += row.total
    return out.where("chunk is null").drop("chunk", "counts"), ranks, total


def postings(docs: DataFrame, ranks: np.ndarray, total: int, part: int = PART) -> DataFrame:
    """(key, sid, place, list, part) of the first shingles of every class that a task meets; place is size and position in one number.

    ``key`` is the shingle.  If its bucket holds more than ``part`` shingles (and twice those of an even spread) it is that of one part
    of its list, and ``list`` is the shingle; else ``list`` is 0.
    """
    shared = docs.sparkSession.sparkContext.broadcast(ranks)
    most = part + 2 * total // BUCKETS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            tokens, sids, places, counts = [], [], [], []
            for s, _ in shingle_sets(batch.column(0).to_pylist(), K):
                sid = set_id(s)
                if not len(s) or sid in seen:
                    continue
                seen.add(sid)
                rank = shared.value[_bucket(s)]
                first = np.lexsort((s, rank))[: _prefix(len(s))]
                tokens.append(s[first])
                sids.append(np.full(len(first), sid))
                places.append((len(s) << 32) + np.arange(len(first)))
                counts.append(rank[first])
            if not tokens:
                continue
            token, sid, place = np.concatenate(tokens), np.concatenate(sids), np.concatenate(places)
            parts = np.ceil(2.0 ** ((np.concatenate(counts).astype(np.float64) + 1) / 8) / most).astype(np.uint64)
            hot = parts > 1
            own = mix(sid.view(np.uint64) + GOLD) % parts
            key = np.where(hot, mix(token ^ (own * STEP)), token)
            columns = [key.view(np.int64), sid, place, np.where(hot, token | np.uint64(1), np.uint64(0)).view(np.int64), own.astype(np.int32)]
            yield pa.record_batch([pa.array(c) for c in columns], names=["key", "sid", "place", "list", "part"])

    return docs.select("text").mapInArrow(run, "key long, sid long, place long, list long, part int")


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
    """Columns of whole groups of the first column's sorted values; a group's batches are put together once."""
    kept: list[list[np.ndarray]] = []
    for batch in batches:
        columns = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        if not len(columns[0]):
            continue
        cut = int(np.searchsorted(columns[0], columns[0][-1])) if not kept or columns[0][-1] != kept[0][0][-1] else 0
        if cut or (kept and columns[0][0] != kept[0][0][-1]):
            yield [np.concatenate(c) for c in zip(*kept, [x[:cut] for x in columns], strict=True)]
            kept = []
        kept.append([c[cut:] for c in columns])
    if kept:
        yield [np.concatenate(c) for c in zip(*kept, strict=True)]


def heads(posted: DataFrame) -> DataFrame:
    """Rows (kind, x, y, place, part): PAIR (x, y) of an entry and its head in the tree; TOP (list x, class y), the first entry of each part; and ENTRY
    (list x, class y) of lists with more than two entries.  Of lists with equal members, a task keeps the entries of the earliest shingle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[int, int] = {}
        names = ["kind", "x", "y", "place", "part"]

        def rows(kind, x, y, place, part):
            return pa.record_batch([pa.array(np.full(len(x), kind, np.int32)), pa.array(x), pa.array(y), pa.array(place), pa.array(part)], names=names)

        for key, sid, place, listed, part in _groups(batches):
            new = np.concatenate([[True], (key[1:] != key[:-1]) | (sid[1:] != sid[:-1])])
            key, sid, place, listed, part = key[new], sid[new], place[new], listed[new], part[new]
            start = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            length = np.diff(np.concatenate([start, [len(key)]]))
            a, b = _paired(sid, place >> 32, place & 0xFFFFFFFF, start, length)
            if len(a):
                yield rows(PAIR, a, b, np.zeros(len(a), np.int64), np.zeros(len(a), np.int32))
            hot = listed[start] != 0
            if hot.any():
                yield rows(TOP, listed[start[hot]], sid[start[hot]], place[start[hot]], part[start[hot]])
            name = (mix(np.add.reduceat(mix(sid.view(np.uint64) ^ GOLD), start) + length.astype(np.uint64) * STEP)).view(np.int64)
            keep = hot.copy()
            for i in np.flatnonzero(~hot & (length > 2)).tolist():
                first = int(place[start[i]])
                if first < known.get(int(name[i]), first + 1):
                    known[int(name[i])] = first
                    keep[i] = True
            if keep.any():
                own = np.repeat(keep, length)
                yield rows(ENTRY, np.where(listed != 0, listed, np.repeat(name, length))[own], sid[own], place[own], part[own])

    sorted_lists = posted.repartition("key").sortWithinPartitions("key", "place", "sid")
    return sorted_lists.mapInArrow(run, "kind int, x long, y long, place long, part int")


def _paired(sid: np.ndarray, n: np.ndarray, pos: np.ndarray, start: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each entry of a list with the one whose place has one base-8 digit less, if size and position allow them to link.

    So a list becomes a tree of few levels, which components need few rounds for; the smaller id stands first.
    """
    place = np.arange(len(sid)) - np.repeat(start, length)
    digit = np.ones(len(sid), np.int64)
    while (more := (place > 0) & (place % (digit * 8) == 0)).any():
        digit[more] *= 8
    other = np.flatnonzero(place > 0)
    head = other - place[other] % (8 * digit[other])
    small, large = n[head], n[other]  # lists are sorted by size
    fits = (100 * small >= PERCENT * large) & (1 + np.minimum(small - pos[head] - 1, large - pos[other] - 1) >= _needed(small, large)) & (sid[head] != sid[other])
    x, y = sid[head][fits], sid[other][fits]
    return np.minimum(x, y), np.maximum(x, y)


def likely(pairs: DataFrame, masks: DataFrame) -> DataFrame:
    """The ``pairs`` that their masks allow to link."""
    one, other = (masks.select(F.col("sid").alias(c), F.col("n").alias(f"n_{c}"), *[F.col(m).alias(f"{m}_{c}") for m in MASK_NAMES]) for c in "ab")
    bits = sum((F.bit_count(F.col(f"{m}_a").bitwiseXOR(F.col(f"{m}_b"))) for m in MASK_NAMES), F.lit(0))
    return pairs.join(one, "a").join(other, "b").where(_may_link(F.col("n_a") + F.col("n_b"), bits)).select("a", "b", "n_a", "n_b")


def _met(sid: np.ndarray, place: np.ndarray, root: np.ndarray, mask: np.ndarray, asks: np.ndarray, most: int | None) -> tuple[np.ndarray, np.ndarray]:
    """Places (query, entry) of the pairs in a cell that may link: queries are rows that ask, entries the others, all sorted by (size, position)."""
    asked, entry = np.flatnonzero(asks), np.flatnonzero(~asks)
    if not len(asked) or not len(entry):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    n, pos = place >> 32, place & 0xFFFFFFFF
    cut = np.arange(0, len(entry), BLOCK)
    rest = n - pos  # the shingle itself and all behind it
    low, high = n[entry[cut]], np.maximum.reduceat(n[entry], cut)
    reach, one_root = np.maximum.reduceat(rest[entry], cut), np.minimum.reduceat(root[entry], cut)
    one_root = np.where(one_root == np.maximum.reduceat(root[entry], cut), one_root, -1)
    own = n[asked][:, None]
    open_blocks = (100 * high >= PERCENT * own) & (PERCENT * low <= 100 * own) & (root[asked][:, None] != one_root)
    open_blocks &= np.minimum(rest[asked][:, None], reach) >= _needed(own, np.maximum(low, -(-PERCENT * own // 100)))
    q, block = np.nonzero(open_blocks)
    size = np.minimum(BLOCK, len(entry) - cut)[block]
    x, y = np.repeat(asked[q], size), entry[np.repeat(cut[block], size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)]
    small, large = np.minimum(n[x], n[y]), np.maximum(n[x], n[y])
    may = (root[x] != root[y]) & (100 * small >= PERCENT * large) & (np.minimum(rest[x], rest[y]) >= _needed(small, large))
    x, y = x[may], y[may]
    apart = np.bitwise_count((mask[x] ^ mask[y]).view(np.uint64)).sum(axis=1, dtype=np.int64)
    may = _may_link(n[x] + n[y], apart)
    x, y, apart = x[may], y[may], apart[may]
    if most is not None and len(x):
        order = np.lexsort((sid[y], apart, x))
        first = np.concatenate([[True], x[order][1:] != x[order][:-1]])
        place_in = np.arange(len(order)) - np.maximum.accumulate(np.where(first, np.arange(len(order)), 0))
        order = order[place_in < most]
        x, y = x[order], y[order]
    return x, y


def dealt(lists: DataFrame, roots: DataFrame) -> DataFrame:
    """(list, mine, other, sid, place, root, asks): the cells of lists with several components.  A cell is a part with asking members, which are those outside the list's
    largest component, and another part, whose entries they ask."""
    members = lists.join(roots.withColumnRenamed("node", "sid"), "sid", "left").withColumn("root", F.coalesce("root", "sid"))
    shares = members.groupBy("list", "root").agg(F.count(F.lit(1)).alias("k"), F.max("part").alias("last"))
    open_lists = shares.groupBy("list").agg(F.max_by("root", F.struct("k", "root")).alias("main"), F.max("last").alias("last"), F.count(F.lit(1)).alias("roots")).where("roots > 1")
    pieces = lists.select("list", "part").distinct().join(open_lists.drop("roots"), "list")
    open_ = saved(members.join(pieces, ["list", "part"]), "near-open")
    # An entry is dealt only to the parts of its list that have asking members: what is written grows with the entries times those parts.
    askers = open_.where(F.col("root") != F.col("main"))
    met = pieces.select("list", "part").join(askers.select("list", F.col("part").alias("mine")).distinct(), "list")
    asked = open_.join(met, ["list", "part"]).select("*", F.col("part").alias("other"), F.lit(False).alias("asks"))
    asking = askers.select("*", F.col("part").alias("mine"), F.explode(F.sequence(F.lit(0), "last")).alias("other"), F.lit(True).alias("asks"))
    return asked.select("list", "mine", "other", "sid", "place", "root", "asks").unionByName(asking.select("list", "mine", "other", "sid", "place", "root", "asks"))


def across(lists: DataFrame, roots: DataFrame, masks: DataFrame, most: int | None) -> DataFrame:
    """(a, b, n_a, n_b): classes of one list and of different components that size, position and masks allow to link;
    of each entry outside the list's largest component, in each part, its ``most`` likely partners (None: all).

    Every pair of parts of a list is a cell, and cells are dealt to tasks.
    """
    cells = dealt(lists, roots).join(masks.drop("n"), "sid").withColumn("cell", F.xxhash64("list", "mine", "other"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cell, sid, place, root, asks, *mask in _groups(batches):
            mask = np.column_stack(mask)
            start = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]]))
            found = []
            for first, stop in zip(start.tolist(), [*start[1:].tolist(), len(cell)], strict=True):
                x, y = _met(sid[first:stop], place[first:stop], root[first:stop], mask[first:stop], asks[first:stop].astype(bool), most)
                if len(x):
                    swap = sid[first + x] > sid[first + y]
                    a, b = first + np.where(swap, y, x), first + np.where(swap, x, y)
                    found.append(np.column_stack([sid[a], sid[b], place[a] >> 32, place[b] >> 32]))
            if found:
                once = np.unique(np.concatenate(found), axis=0)
                yield pa.record_batch([pa.array(np.ascontiguousarray(c)) for c in once.T], names=["a", "b", "n_a", "n_b"])

    rows = cells.select("cell", "sid", "place", "root", "asks", *MASK_NAMES).repartition("cell").sortWithinPartitions("cell", "place", "sid")
    return rows.mapInArrow(run, "a long, b long, n_a long, n_b long").distinct()


def texts_of(docs: DataFrame, rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """(sid, text): a text of each wanted class (twice, if rows repeat it with its id)."""
    one = rows.where("n > 0").groupBy("sid").agg(F.min(F.struct("doc_id", "print")).alias("_one")).join(wanted, "sid", "left_semi")
    one = saved(one.select("sid", F.col("_one.doc_id").alias("_id"), F.col("_one.print").alias("_print")), "near-wanted")
    same = F.col("doc_id").cast("long").eqNullSafe(F.col("_id")) & (F.xxhash64("text") == F.col("_print"))
    return docs.select("doc_id", "text").join(one.hint("shuffle_hash"), same).select("sid", "text")  # texts need no sort


def answered(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The (a, b) of ``pairs`` with n_a, n_b and ``common``, counted on whole sets.

    The pairs of a class with more than ``HUB`` of them are dealt to several tasks.
    """
    asked = saved(pairs.select("a", "b"), "near-asked")
    count = asked.count()
    small = count <= 200_000  # 24 bytes a row
    hubs = asked.groupBy("a").agg((F.count(F.lit(1)) / HUB).cast("long").alias("parts")).where("parts > 0")
    if count <= HUB or (hubs := saved(hubs, "near-hubs")).isEmpty():
        asked = asked.withColumn("part", F.lit(0).cast("long"))
    else:
        asked = asked.join(hubs, "a", "left").select("a", "b", F.coalesce(F.pmod(F.xxhash64("b"), F.col("parts") + 1), F.lit(0)).alias("part"))
        asked = saved(asked, "near-asked")
    side = lambda df: F.broadcast(df) if small else df.hint("shuffle_hash")
    sent = texts.join(side(asked), asked["b"] == texts["sid"]).select("a", "part", "b", "text")
    owners = asked.select("a", "part").distinct()
    own = texts.join(side(owners), F.col("a") == texts["sid"]).select("a", "part", F.lit(None).cast("long").alias("b"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        owner, mine, last = None, None, None
        for batch in batches:
            out = []
            for a, b, (theirs, _) in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), shingle_sets(batch.column(3).to_pylist(), K), strict=True):
                if b is None:
                    owner, mine, last = a, theirs, None
                elif b != last:
                    assert owner == a
                    last = b
                    out.append((a, b, len(mine), len(theirs), _common(mine, theirs)))
            columns = zip(*out, strict=True) if out else [[]] * 5
            yield pa.record_batch([pa.array(c, pa.int64()) for c in columns], names=["a", "b", "n_a", "n_b", "common"])

    rows = own.unionByName(sent).repartition("a", "part").sortWithinPartitions("a", "part", F.col("b").asc_nulls_first())
    return saved(rows.mapInArrow(run, "a long, b long, n_a long, n_b long, common long"), "near-answers")


def _common(a: np.ndarray, b: np.ndarray) -> int:
    both = np.concatenate([a, b])
    both.sort()
    return int((both[1:] == both[:-1]).sum())


def leaders(linked: DataFrame) -> DataFrame:
    """(sid, leader, lost, more) of classes that link with one of more links (or as many and a less id): of these the one of most links, the
    shingles of this leader that the class lacks, and those that it has besides."""
    both = linked.select(F.col("a").alias("x"), F.col("b").alias("y"), F.col("n_a").alias("n_x"), F.col("n_b").alias("n_y"), "common").unionByName(
        linked.select(F.col("b").alias("x"), F.col("a").alias("y"), F.col("n_b").alias("n_x"), F.col("n_a").alias("n_y"), "common")
    )
    degree = both.groupBy(F.col("y").alias("node")).agg((-F.count(F.lit(1))).alias("k"))
    own = F.struct(F.col("y").alias("leader"), (F.col("n_y") - F.col("common")).alias("lost"), (F.col("n_x") - F.col("common")).alias("more"))
    rank = F.struct("k", F.col("y").alias("node"))
    chosen = both.join(degree.withColumnRenamed("node", "y"), "y").groupBy("x").agg(F.min(rank).alias("rank"), F.min_by(own, rank).alias("own"))
    chosen = chosen.join(degree.withColumnsRenamed({"node": "x", "k": "k_x"}), "x").where(F.col("rank") < F.struct(F.col("k_x").alias("k"), F.col("x").alias("node")))
    return chosen.select(F.col("x").alias("sid"), "own.*")


def derived(more: DataFrame, nearest: DataFrame, answers: DataFrame, texts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(answers, links) of the pairs ``more`` (a, b, n_a, n_b): the overlaps that had to be counted, and (a, b, n_a, n_b, common) of the pairs that link.

    Leaders l, m of a and b with ``c`` common shingles: a and b share at least c less what they lack of theirs, at most c and what they have
    besides.  ``common`` of a pair that needs no text is that least number.
    """
    led = more
    for c in "ab":
        names = {"sid": c, "leader": f"leader_{c}", "lost": f"lost_{c}", "more": f"more_{c}"}
        led = led.join(nearest.withColumnsRenamed(names), c, "left")
        led = led.withColumns({f"leader_{c}": F.coalesce(f"leader_{c}", c), f"lost_{c}": F.coalesce(f"lost_{c}", F.lit(0)), f"more_{c}": F.coalesce(f"more_{c}", F.lit(0))})
    led = saved(led.withColumns({"u": F.least("leader_a", "leader_b"), "v": F.greatest("leader_a", "leader_b")}), "near-led")
    known = answers.select(F.col("a").alias("u"), F.col("b").alias("v"), F.col("common").alias("of_leaders"))
    fresh = answered(led.where("u <> v").select(F.col("u").alias("a"), F.col("v").alias("b")).distinct().join(answers.select("a", "b"), ["a", "b"], "left_anti"), texts)
    known = known.unionByName(fresh.select(F.col("a").alias("u"), F.col("b").alias("v"), F.col("common").alias("of_leaders")))
    known = led.join(known, ["u", "v"], "left").withColumn("of_leaders", F.coalesce("of_leaders", F.expr("n_a - more_a + lost_a")))  # u = v: its size
    known = known.withColumns({
        "low": F.expr("of_leaders - lost_a - lost_b"), "high": F.expr("least(of_leaders + more_a + more_b, n_a, n_b)"), "same": F.expr("u = a and v = b or u = b and v = a"),
    })
    enough = lambda c: (100 + PERCENT) * F.col(c) >= PERCENT * (F.col("n_a") + F.col("n_b"))
    known = saved(known.withColumns({"yes": enough("low"), "open": ~F.col("same") & enough("high") & ~enough("low")}), "near-derived")
    own = answered(known.where("open").select("a", "b"), texts)
    links = known.where("yes").select("a", "b", "n_a", "n_b", F.col("low").alias("common"))
    return fresh.unionByName(own).distinct(), links.unionByName(own.where(LINKED))


class Index:
    """Lists, texts and the answers of the first round: what all later rounds work on."""

    def __init__(self, docs: DataFrame, part: int = PART) -> None:
        self.rows, ranks, total = sets(docs)
        self.masks = saved(self.rows.where("n > 0").groupBy("sid").agg(F.max("n").alias("n"), *[F.max(m).alias(m) for m in MASK_NAMES]), "near-masks")
        found = saved(heads(postings(docs, ranks, total, part)), "near-lists")
        tops = found.where(F.col("kind") == TOP).select(F.col("x").alias("key"), F.col("y").alias("sid"), "place", F.lit(0).cast("long").alias("list"), F.lit(0).alias("part"))
        pairs = found.unionByName(heads(tops)).where(F.col("kind") == PAIR).select(F.col("x").alias("a"), F.col("y").alias("b"))
        pairs = saved(likely(pairs.distinct(), self.masks), "near-pairs")
        lists = found.where(F.col("kind") == ENTRY).groupBy(F.col("x").alias("list"), "part", F.col("y").alias("sid")).agg(F.min("place").alias("place"))
        self.lists = saved(lists, "near-entries")
        wanted = pairs.select(F.col("a").alias("sid")).union(pairs.select("b")).union(self.lists.select("sid")).distinct()
        self.texts = saved(texts_of(docs, self.rows, wanted), "near-texts")
        self.asked = pairs.select("a", "b")
        self.answers = answered(pairs, self.texts)
        self.linked = self.answers.where(LINKED)
        self.nearest = None

    def round(self, roots: DataFrame, most: int | None) -> DataFrame | None:
        """Answer the likely pairs across ``roots``; the new links, if there are some."""
        more = saved(across(self.lists, roots, self.masks, most).join(self.asked, ["a", "b"], "left_anti"), "near-pairs")
        if more.isEmpty():
            return None
        if self.nearest is None:
            self.nearest = saved(leaders(self.linked), "near-leaders")
        answers, links = derived(more, self.nearest, self.answers, self.texts)
        self.asked = self.asked.unionByName(more.select("a", "b"))
        self.answers, self.linked = self.answers.unionByName(answers), self.linked.unionByName(links)
        return None if links.isEmpty() else links


def join(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Every link between classes, (a, b, n_a, n_b), and every row's class, (doc_id, sid).  A group of near copies has as many links as pairs."""
    index = Index(docs)
    alone = docs.sparkSession.createDataFrame([], "node long, root long")
    index.round(alone, None)
    return index.linked.select("a", "b", "n_a", "n_b").distinct(), index.rows.where("n > 0").select("doc_id", "sid")


def near_components(docs: DataFrame) -> DataFrame:
    """Per row of (doc_id, text): doc_id, n_shingles, component_id, print (xxhash64 of the text)."""
    index = Index(docs)
    rows, roots = index.rows, components(index.linked.select("a", "b"))
    for most in ROUNDS:
        links = index.round(roots, most)
        roots = roots if links is None else extended(roots, links)
    classes = rows.where("n > 0").groupBy("sid").agg(F.min("doc_id").alias("least")).join(roots.withColumnRenamed("node", "sid"), "sid", "left")
    classes = saved(classes.withColumn("root", F.coalesce("root", "sid")), "near-classes")
    named = saved(classes.groupBy("root").agg(F.min("least").alias("component_id")), "near-named")
    classes = saved(classes.join(named, "root").select("sid", "component_id"), "near-classes")
    joined = rows.select("doc_id", "print", "n", "sid").join(classes, "sid", "left")
    own = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return joined.select("doc_id", F.col("n").alias("n_shingles"), own.alias("component_id"), "print")


def keep_one(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each component: that of the component's least id (of rows that repeat it, one)."""
    rows = near_components(docs.select("doc_id", "text"))
    alone = (F.col("n_shingles") == 0) | F.col("doc_id").isNull()
    key = F.struct("doc_id", "print")
    named = rows.where(~alone & (F.col("doc_id") == F.col("component_id"))).groupBy("component_id").agg(F.min(key).alias("key"))
    kept = saved(named.select("key.*").unionByName(rows.where(alone).select("doc_id", "print").distinct()), "near-kept")
    distinct = rows.groupBy("doc_id", "print").count().where("count > 1").isEmpty()
    kept = kept.withColumnsRenamed({"doc_id": "_near_id", "print": "_near_print"}).hint("shuffle_hash")  # texts need no sort
    same = docs["doc_id"].eqNullSafe(kept["_near_id"]) & F.xxhash64(docs["text"]).eqNullSafe(kept["_near_print"])
    left = docs.join(kept, same, "left_semi")
    return left if distinct else left.dropDuplicates(["doc_id", "text"])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_components(read(spark, sf_dir, "documents").select("doc_id", "text")).drop("print")
