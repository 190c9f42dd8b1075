"""Connected components of an edge table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import saved


def _mark(edges: DataFrame) -> tuple:
    """Changes with the set of edges."""
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def _each(df: DataFrame, *rows: tuple[str, str], names: tuple[str, str] = ("u", "v")) -> DataFrame:
    """For each row of ``df`` one for each of ``rows``, which name its columns."""
    structs = [F.struct(*[F.col(c).alias(n) for c, n in zip(row, names, strict=True)]) for row in rows]
    return df.select(F.explode(F.array(*structs)).alias("_row")).select("_row.*")


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node in (a, b): root is the smallest node that it reaches.

    Each round links every node's larger neighbours to its smallest one, then its smaller ones; every round is
    written, so the plan stays short.  Ends when a round changes nothing.
    """
    edges = saved(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "stars")
    mark = _mark(edges)
    while mark[0]:
        both = _each(edges, ("u", "v"), ("v", "u"))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        large = saved(large, "stars")
        small = _each(large.join(large.groupBy("u").agg(F.min("v").alias("m")), "u"), ("u", "m"), ("v", "m"))
        edges = saved(small.where("u <> v").distinct(), "stars")
        before, mark = mark, _mark(edges)
        if mark == before:
            break
    return saved(_each(edges, ("u", "v"), ("v", "v"), names=("node", "root")).groupBy("node").agg(F.min("root").alias("root")), "roots")


def extended(roots: DataFrame, edges: DataFrame) -> DataFrame:
    """``roots``, as of ``components``, with further edges: only components are joined anew, not their members."""
    ends = edges.select("a", "b")
    for c in "ab":
        ends = ends.join(roots.select(F.col("node").alias(c), F.col("root").alias(f"root_{c}")), c, "left")
    joined = components(ends.select(F.coalesce("root_a", "a").alias("a"), F.coalesce("root_b", "b").alias("b")))
    moved = roots.join(joined.select(F.col("node").alias("root"), F.col("root").alias("new")), "root", "left").select("node", F.coalesce("new", "root").alias("root"))
    return saved(moved.unionByName(joined.join(roots, "node", "left_anti")), "roots")
