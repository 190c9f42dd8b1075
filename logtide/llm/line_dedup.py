"""Line deduplication across documents, with an edit bound of one word.

A line is its sequence of words (white space and the case of A-Z do not count).  Lines of ``least`` words or more go
when an equal line stands earlier, lines of ``near`` words or more also when an earlier one of so many differs by one word put in, left out
or replaced.  Earlier means a smaller doc_id, then a smaller line number.  By default every line that has a word takes part, and near ones from five words on: one word in five.

Equal lines are found by hash.  For the rest, each distinct line emits its deletion neighbourhood: the hash of itself
without word i, for every i.  Two lines of equal length that differ by one word share a variant with the same i; a line and one
of a word more do if a variant of the longer one is the shorter one.  Lines are joined on variant (with i and length, or the whole line), and the words of the
lines that meet are compared, which verifies the distance.  An edit leaves either the first or the last words of a line as they are, so only lines that
share such a half with another distinct line emit variants, and only for the words outside of it; this loses no pair.

Hot lines and halves are aggregated map-side; joins back to them are plain sort-merge joins that adaptive execution splits.

Cases:  a null text stays null and has no lines; shorter lines and blank ones always stay; rows that repeat id and text count as one
document, so none of them makes the other go; a null id counts as the smallest; an empty table gives no row; a very long line of n words is one row of the line table and
makes at most 2n + 1 variants, in batches of at most twice ``VARIANTS``, those of a very long line in several; other columns stay as they are.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOWER, UPPER, read, saved, text_of
from .shingles import BACK, GOLD, grouped, mix, powers, words

LEAST, NEAR = 1, 5
VARIANTS = 200_000
SUBSTITUTED, SHORTENED, WHOLE = 0, 1, 2
LEFT, RIGHT = np.uint64(0x51ED270B27B7A3D1), np.uint64(0xA24BAED4963EE407)


@cache
def _halves(near: int) -> np.ndarray:
    """Lengths of halves: each about a fifth more than the one before."""
    out = [near // 2]
    while out[-1] < 1 << 40:
        out.append(max(out[-1] + 1, out[-1] * 6 // 5))
    return np.array(out)


def _half(n: np.ndarray, near: int) -> np.ndarray:
    halves = _halves(near)
    return halves[np.maximum(np.searchsorted(halves, n // 2, side="right") - 1, 0)]


class Lines:
    """Word hashes of a text, by line: ``number``, ``n`` words, ``first`` word of each line of ``least`` words or more."""

    def __init__(self, data: bytes, least: int, near: int) -> None:
        w, at = words(data)
        self.data, self.near = data, near
        self.breaks = breaks = np.flatnonzero(np.frombuffer(data, np.uint8) == 10)
        line = np.searchsorted(breaks, at)
        first = np.flatnonzero(np.concatenate([[True], line[1:] != line[:-1]])) if len(line) else np.empty(0, np.int64)
        n = np.diff(np.concatenate([first, [len(line)]]))
        place = np.arange(len(line)) - np.repeat(first, n)
        top = int(n.max()) + 1 if len(n) else 1
        self.power, self.inverse = powers(top), powers(top, back=True)
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(w * self.power[place])]) if len(w) else np.zeros(1, np.uint64)
        kept = n >= least
        self.number, self.n, self.first = line[first][kept], n[kept], first[kept]

    def part(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        """Hash of words start .. stop of each line, from the beginning of the run."""
        return (self.sums[self.first + stop] - self.sums[self.first + start]) * self.inverse[start]

    def names(self) -> np.ndarray:
        return mix(self.part(self.n * 0, self.n) + self.n.astype(np.uint64) * GOLD)

    def half_keys(self, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Keys of the halves that a line of n words has, for these lines."""
        a = _half(n, self.near)
        size = a.astype(np.uint64) * GOLD
        near = self.n >= self.near
        a = np.where(near, a, 0)
        left, right = mix(self.part(a * 0, a) + size + LEFT), mix(self.part(self.n - a, self.n) + size + RIGHT)
        return left, right

    def body(self, i: int) -> str:
        """Line i as it stands."""
        number = int(self.number[i])
        stop = int(self.breaks[number]) if number < len(self.breaks) else len(self.data)
        return self.data[int(self.breaks[number - 1]) + 1 if number else 0 : stop].decode()

    def variants(self, i: int, low: int, high: int) -> np.ndarray:
        """Line i without word j, for each j of low .. high, unmixed."""
        start = self.sums[self.first[i]]
        j = self.first[i] + np.arange(low, high)
        return (self.sums[j] - start) + (self.sums[self.first[i] + self.n[i]] - self.sums[j + 1]) * BACK


def line_table(docs: DataFrame, least: int = LEAST, near: int = NEAR) -> DataFrame:
    """(h, n, doc_id, print, line, left, right, left2, right2) of every line of ``least`` words or more in (doc_id, text, print).

    left2 and right2 are the halves that a line of one word less has, where they differ.
    """
    names = ["h", "n", "doc_id", "print", "line", "left", "right", "left2", "right2"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for group in grouped(batch.column(1).to_pylist()):
                x = Lines(b"\n".join(group), least, near)
                breaks = np.cumsum([data.count(b"\n") + 1 for data in group])  # lines up to each text's end
                place = np.searchsorted(breaks, x.number, side="right")
                line = x.number - np.concatenate([[0], breaks])[place]
                doc_ids, marks = (batch.column(c).take(pa.array(place + at)) for c in (0, 2))
                long, more = x.n >= near, (x.n > near) & (_half(x.n, near) != _half(x.n - 1, near))
                halves = [*x.half_keys(x.n), *x.half_keys(x.n - 1)]
                keys = [pa.array(k.view(np.int64), mask=~m) for k, m in zip(halves, (long, long, more, more), strict=True)]
                columns = [pa.array(x.names().view(np.int64)), pa.array(x.n.astype(np.int32)), doc_ids, marks, pa.array(line.astype(np.int32)), *keys]
                yield pa.RecordBatch.from_arrays(columns, names)
                at += len(group)

    schema = "h long, n int, doc_id long, print long, line int, left long, right long, left2 long, right2 long"
    return docs.select("doc_id", "text", "print").mapInArrow(run, schema)


def variant_table(docs: DataFrame, suspects: DataFrame, least: int = LEAST, near: int = NEAR) -> DataFrame:
    """(g, kind, doc_id, line, h, body): the variants of the suspects' lines; the whole line's row has its text."""
    names = ["g", "kind", "doc_id", "line", "h", "body"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made, count = [], 0

        def rows() -> pa.RecordBatch:
            keys, kinds, ids, lines, own, bodies = zip(*made, strict=True)
            columns = [pa.array(np.concatenate(c)) for c in (keys, kinds)]
            columns += [pa.array(sum(ids, []), pa.int64()), pa.array(np.concatenate(lines)), pa.array(np.concatenate(own)), pa.array(sum(bodies, []), pa.string())]
            return pa.RecordBatch.from_arrays(columns, names)

        for batch in batches:
            for doc_id, text, asked in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), strict=True):
                x = Lines(text.as_py().encode("utf-8", "replace"), least, near)
                index, hashes = {int(v): i for i, v in enumerate(x.number)}, x.names()
                for ask in asked:
                    i = index[ask["line"]]
                    n = int(x.n[i])
                    a = int(min(_half(np.array([max(n - 1, near), n]), near)))
                    low, high = (0 if ask["r"] else a), (n if ask["l"] else n - a)
                    for first in range(low, max(high, low + 1), VARIANTS // 2):  # a very long line takes several batches
                        stop = min(high, first + VARIANTS // 2)
                        whole = hashes[i : i + 1] if stop == high else hashes[:0]
                        v, at = x.variants(i, first, stop), np.arange(first, stop, dtype=np.uint64)
                        keys = np.concatenate([mix(v + mix(at + LEFT) + np.array([n], np.uint64) * RIGHT), mix(v + np.array([n - 1], np.uint64) * GOLD), whole])
                        kinds = np.repeat(np.array([SUBSTITUTED, SHORTENED, WHOLE], np.int32), [len(v), len(v), len(whole)])
                        size = len(keys)
                        line, own = np.full(size, ask["line"], np.int32), np.full(size, hashes[i]).view(np.int64)
                        made.append((keys.view(np.int64), kinds, [doc_id] * size, line, own, [None] * (2 * len(v)) + [x.body(i)] * len(whole)))
                        count += size
                        if count >= VARIANTS:
                            yield rows()
                            made.clear()
                            count = 0
        if made:
            yield rows()

    asked = suspects.withColumnsRenamed({"doc_id": "_line_id", "print": "_line_print"}).hint("shuffle_hash")  # texts need no sort
    rows = docs.select("doc_id", "text", "print").join(asked, _same("doc_id", "print"))
    return rows.select("doc_id", "text", "asked").mapInArrow(run, "g long, kind int, doc_id long, line int, h long, body string")


GAP = re.compile(r"[\x20\x09-\x0D]+")
LOWERED = str.maketrans(UPPER, LOWER)


def one_apart(mine: str, theirs: str) -> bool:
    """Whether one word put in, left out or replaced makes one line the other."""
    a, b = (GAP.sub(" ", x.translate(LOWERED)).strip(" ").split(" ") for x in (mine, theirs))
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    most = min(len(a), len(b))
    same = next((i for i in range(most) if a[i] != b[i]), most)
    behind = next((i for i in range(most - same) if a[-1 - i] != b[-1 - i]), most - same)
    return same + behind >= max(len(a), len(b)) - 1


def verified(met: DataFrame) -> DataFrame:
    """(h) of the rows (h, mine, theirs) whose lines are one word apart."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [one_apart(a, b) for a, b in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            yield pa.record_batch([batch.column(0).filter(pa.array(found, pa.bool_()))], names=["h"])

    return met.select("h", "mine", "theirs").mapInArrow(run, "h long")


def _same(doc_id: str, mark: str):
    return F.col(doc_id).eqNullSafe(F.col("_line_id")) & (F.col(mark) == F.col("_line_print"))


def _near(docs: DataFrame, firsts: DataFrame, least: int, near: int) -> DataFrame:
    """(h) of the distinct lines that an earlier distinct line is one word away from."""
    pairs = [F.struct(F.col(c).alias("key"), F.lit(c[0] == "l").alias("l")) for c in ("left", "right", "left2", "right2")]
    keys = firsts.where(F.col("n") >= near).select("h", "pos", F.explode(F.array(*pairs)).alias("k")).select("h", "pos", "k.key", "k.l").where("key is not null")
    shared = saved(keys.groupBy("key").agg(F.min("h").alias("lo"), F.max("h").alias("hi")).where("lo <> hi").select("key"), "line-halves")
    asked = keys.join(shared, "key", "left_semi").groupBy("pos.doc_id", "pos.print", "pos.line").agg(F.max("l").alias("l"), F.max(~F.col("l")).alias("r"))
    suspects = saved(asked.groupBy("doc_id", "print").agg(F.collect_list(F.struct("line", "l", "r")).alias("asked")), "line-suspects")
    variants = saved(variant_table(docs, suspects, least, near), "line-variants")
    at = F.struct("doc_id", "line", "h")
    least_of = lambda kind: F.min(F.when(F.col("kind") == kind, at))
    met = variants.groupBy("g").agg(
        F.count(F.lit(1)).alias("rows"), least_of(SUBSTITUTED).alias("substituted"), least_of(SHORTENED).alias("shortened"), least_of(WHOLE).alias("whole")
    )
    met = saved(met.where("rows > 1").drop("rows"), "line-met")
    kind = F.col("kind")
    other = F.when(kind == SUBSTITUTED, F.col("substituted")).when(kind == SHORTENED, F.col("whole")).otherwise(F.col("shortened"))
    pairs = variants.drop("body").join(met, "g").withColumn("other", other).where(F.col("other") < at).select("h", F.col("other.h").alias("earlier")).distinct()
    lines = variants.where(F.col("kind") == WHOLE).select("h", "body")
    own = saved(pairs.join(lines.withColumnsRenamed({"h": "earlier", "body": "theirs"}), "earlier").select("h", "theirs"), "line-pairs")
    return saved(verified(own.join(lines.withColumnRenamed("body", "mine"), "h")).distinct(), "line-near")


def duplicate_lines(docs: DataFrame, least: int = LEAST, near: int = NEAR) -> DataFrame:
    """(doc_id, print, gone): numbers of the lines to drop from each document that has some; ``print`` is xxhash64 of the text."""
    own = docs.where(F.col("text").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("print"))
    lines = saved(line_table(own, least, near), "lines")
    firsts = saved(
        lines.groupBy("h").agg(F.min(F.struct("doc_id", "line", "print")).alias("pos"), *(F.max(c).alias(c) for c in ("n", "left", "right", "left2", "right2"))), "line-firsts"
    )
    close = _near(own, firsts, least, near)
    marks = saved(firsts.select("h", "pos").join(close.withColumn("near", F.lit(True)), "h", "left"), "line-marks")
    here = F.struct("doc_id", "line", "print")
    gone = lines.select("h", "doc_id", "line", "print").join(marks, "h").where(F.coalesce("near", F.lit(False)) | (here != F.col("pos")))
    return saved(gone.groupBy("doc_id", "print").agg(F.collect_set("line").alias("gone")), "line-gone")


def dedup_lines(docs: DataFrame, least: int = LEAST, near: int = NEAR) -> DataFrame:
    """``docs`` with the text's remaining lines, and n_lines (before) and n_gone; columns of these names are replaced."""
    gone = duplicate_lines(docs.select("doc_id", "text"), least, max(near, 2)).withColumnsRenamed({"doc_id": "_line_id", "print": "_line_print", "gone": "_line_gone"}).hint("shuffle_hash")
    rows = docs.drop("n_lines", "n_gone")
    joined = rows.withColumn("_line_mark", F.xxhash64(text_of(F.col("text")))).join(gone, _same("doc_id", "_line_mark"), "left")
    # A column of its own: inside the lambda the text would be split anew for each line.
    joined = joined.withColumn("_line_all", F.when(F.col("_line_gone").isNotNull(), F.split("text", "\n")))
    kept = F.transform(F.array_except(F.sequence(F.lit(0), F.size("_line_all") - 1), "_line_gone"), lambda i: F.get("_line_all", i))
    joined = joined.withColumns({
        "n_lines": F.coalesce(F.octet_length("text") - F.octet_length(F.replace("text", F.lit("\n"), F.lit(""))) + 1, F.lit(0)).cast("long"),
        "n_gone": F.coalesce(F.size("_line_gone"), F.lit(0)).cast("long"),
    })
    text = F.when(F.col("_line_gone").isNull(), F.col("text")).otherwise(F.array_join(kept, "\n"))
    return joined.withColumn("text", text).drop("_line_id", "_line_print", "_line_gone", "_line_mark", "_line_all")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_lines(read(spark, sf_dir, "documents").select("doc_id", "text"))
