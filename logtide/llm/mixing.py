"""Mix sources to target token counts by entropy balancing.

Each document gets a rate ``w`` between 0 and ``cap`` (copies of it that the mix takes).  Among all
rates that meet every source's token target, the ones of maximal entropy (of ``w`` against ``cap - w``)
are an exponential tilt in the document's size, ``w / (cap - w) = exp(lambda * size / mean size)``.
The multipliers ``lambda`` solve the convex dual, one constraint a source, by Newton steps inside a
bracket; each step is one Spark aggregation over the (source, size) histogram, so the documents
themselves are read once.  Rates become copies by sequential Poisson rounding on a hash of the document.

Cases:  null or blank text has size 0 and takes 0 words; a null source is a source of its own, sorted last;
repeated rows count as often as they occur and are rounded alike; an empty table gives an empty result;
a source without words has target 0; a very long text counts by its words alone, and is cut nowhere.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import saved, text_of

WORD = r"[^\x20\x09-\x0D]+"
BINS = 4096


def size_of(text: Column) -> Column:
    return F.regexp_count(text_of(text), F.lit(WORD)).cast("long")


def source_targets(hist: DataFrame, ratio: float = 1.5, weights: tuple = (5, 2, 1), cap: float = 2.0) -> DataFrame:
    """(source, source_size, docs, target) from a histogram (source, size, n).

    Sources in code point order, nulls last, take ``weights`` in turn and share ``ratio`` times all words.
    A target stops at ``cap`` times its source's size and the excess goes to the others by weight: sorted by
    the level ``cap * size / weight`` at which a source fills up, running sums give the final level directly.
    The windows run over one row a source, not over documents.
    """
    per = hist.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"), F.sum("n").alias("docs"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    turn = F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights)))
    per = per.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), turn + 1))
    every = Window.partitionBy()
    before = Window.orderBy("fills_at", F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    per = (
        per.withColumn("most", F.lit(float(cap)) * F.col("source_size"))
        .withColumn("fills_at", F.col("most") / F.col("weight"))
        .withColumn("left", F.lit(float(ratio)) * F.sum("source_size").over(every) - F.coalesce(F.sum("most").over(before), F.lit(0.0)))
        .withColumn("level", F.col("left") / (F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))))
        .withColumn("full", F.col("fills_at") <= F.col("level"))
        .withColumn("level", F.max(F.when(~F.col("full"), F.col("level"))).over(every))
    )
    target = F.when(F.col("full"), F.col("most")).otherwise(F.least("most", F.col("weight") * F.col("level")))
    return per.select("source", "source_size", "docs", target.alias("target"))


def _rate(cap: float) -> Column:
    tilt = F.exp(-F.col("lam") * F.col("size") / F.col("mean"))
    return F.when(F.col("full"), F.lit(cap)).when(F.col("target") <= 0, F.lit(0.0)).otherwise(F.lit(cap) / (1 + tilt))


def solve_dual(hist: DataFrame, targets: DataFrame, cap: float = 2.0, tolerance: float = 1e-6, steps: int = 60) -> DataFrame:
    """Multipliers (source, ..., lam) whose rates meet every target within ``tolerance``.

    ``steps`` bounds the loop only against a target that doubles cannot represent; the rounding later
    meets the target exactly whatever the last residual is.
    """
    inf = float("inf")
    state = targets.withColumns({
        "mean": F.greatest(F.col("source_size") / F.col("docs"), F.lit(1e-9)),
        "full": F.col("target") >= F.lit(cap * (1 - 1e-12)) * F.col("source_size"),
        "lam": F.lit(0.0), "lo": F.lit(-inf), "hi": F.lit(inf), "miss": F.lit(inf),
    })
    state = saved(state, "mix-dual")
    columns = state.columns
    rate, tokens = _rate(cap), F.col("n") * F.col("size")
    for _ in range(steps):
        moment = (
            hist.join(state, hist["source"].eqNullSafe(state["source"])).drop(hist["source"])
            .groupBy(*[F.col(c) for c in columns])
            .agg(F.sum(tokens * rate).alias("f"), F.sum(tokens * F.col("size") / F.col("mean") * rate * (1 - rate / cap)).alias("slope"))
        )
        low = F.col("f") < F.col("target")
        lo, hi = F.when(low, F.col("lam")).otherwise(F.col("lo")), F.when(low, F.col("hi")).otherwise(F.col("lam"))
        newton = F.col("lam") + (F.col("target") - F.col("f")) / F.when(F.col("slope") > 0, F.col("slope"))
        inside = (newton > lo) & (newton < hi)
        bisect = F.when(hi == inf, F.abs(lo) * 2 + 1).when(lo == -inf, -F.abs(hi) * 2 - 1).otherwise((lo + hi) / 2)
        fixed = F.col("full") | (F.col("target") <= 0)
        miss = F.when(fixed, F.lit(0.0)).otherwise(F.abs(F.col("f") - F.col("target")) / F.col("target"))
        step = moment.withColumns({
            "miss": miss, "lo": lo, "hi": hi,
            "lam": F.when(fixed | (miss <= tolerance), F.col("lam")).when(inside, newton).otherwise(bisect),
        })
        state = saved(step.select(*columns), "mix-dual")
        if (state.agg(F.max("miss")).first()[0] or 0.0) <= tolerance:
            break
    return state


def _draw(cap: float) -> dict[str, Column]:
    """Whole copies of a document and the rank (0 to 1) at which it takes one more."""
    rate = _rate(cap)
    whole = F.floor(rate)
    u = (F.pmod(F.xxhash64(F.lit("mix"), *_identity()), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    part = rate - whole
    rank = F.when(part > 0, u / (u + part))
    return {"whole": whole, "rank": rank}


def _identity() -> list[Column]:
    return [F.col("doc_id"), F.col("size")]


def _bin(rank: Column, level: int) -> Column:
    scaled = rank * float(BINS**level)
    return F.pmod(F.floor(scaled), F.lit(BINS)).cast("int")


def _cut(drawn: DataFrame, level: int) -> DataFrame:
    """Per source, the bin of ranks in which the running total passes what is left to take."""
    sums = drawn.groupBy("source", "rest", _bin(F.col("rank"), level).alias("bin")).agg(F.sum("size").alias("words"))
    run = Window.partitionBy("source").orderBy("bin")
    upto = F.sum("words").over(run)
    crossing = sums.withColumn("upto", upto).where((F.col("upto") >= F.col("rest")) & (F.col("upto") - F.col("words") < F.col("rest")))
    return crossing.groupBy("source").agg(
        F.min("bin").alias(f"bin{level}"), F.min(F.col("rest") - F.col("upto") + F.col("words")).alias("rest_in"), F.min("words").alias("words_in")
    )


def plan_mix(sized: DataFrame, ratio: float = 1.5, weights: tuple = (5, 2, 1), cap: float = 2.0) -> DataFrame:
    """Per source, everything a document needs to know its words: see ``apply_mix``.

    ``sized`` has doc_id, source, size.  Bins of ranks are found in two levels (``BINS`` squared in all), each one
    aggregation; documents of the last bin share the remainder, so a source misses its target by fewer words
    than that bin has documents.
    """
    hist = saved(sized.groupBy("source", "size").agg(F.count(F.lit(1)).alias("n")), "mix-hist")
    solved = solve_dual(hist, source_targets(hist, ratio, weights, cap), cap)
    solved = solved.drop("lo", "hi", "miss")
    taken = (
        hist.join(solved, hist["source"].eqNullSafe(solved["source"])).drop(hist["source"])
        .groupBy("source").agg(F.sum(F.col("n") * F.col("size") * F.floor(_rate(cap))).alias("sure"))
    )
    solved = _keyed(solved, taken).withColumn("rest", F.col("target") - F.col("sure"))
    solved = saved(solved, "mix-solved")
    drawn = _with_plan(sized.select("doc_id", "source", "size"), solved).withColumns(_draw(cap)).where(F.col("rank").isNotNull())
    first = saved(_keyed(solved, _cut(drawn, 1)), "mix-cut")
    rest = first.withColumn("rest", F.coalesce("rest_in", F.lit(0.0))).drop("rest_in", "words_in")
    inner = _with_plan(drawn.select("doc_id", "source", "size", "rank"), rest.select("source", "rest", "bin1"))
    second = _cut(inner.where(_bin(F.col("rank"), 1) == F.col("bin1")), 2)
    plan = _keyed(rest, second).withColumn("share", F.coalesce(F.col("rest_in") / F.col("words_in"), F.lit(0.0)))
    return saved(plan.drop("rest_in", "words_in"), "mix-plan")


def _keyed(left: DataFrame, right: DataFrame) -> DataFrame:
    right = right.withColumnRenamed("source", "_source")
    return left.join(right, left["source"].eqNullSafe(right["_source"]), "left").drop("_source")


def _with_plan(docs: DataFrame, plan: DataFrame) -> DataFrame:
    """Rows with their source's plan.  One row a source: Spark broadcasts it while it is small and otherwise
    shuffles, where adaptive execution splits a hot source."""
    return _keyed(docs, plan)


def apply_mix(sized: DataFrame, plan: DataFrame, cap: float = 2.0) -> DataFrame:
    """``sized`` with source_size, target and taken (words the mix takes of each document).

    A document gets its whole copies, one more if its rank lies below its source's cut, and in the bin of the
    cut the leading words of one more copy.
    """
    names = sized.columns
    clash = {c: f"_mix_{c}" for c in names if c not in ("doc_id", "source", "size") and c in {*plan.columns, "whole", "rank", "taken"}}
    rows = _with_plan(sized.withColumnsRenamed(clash), plan).withColumns(_draw(cap))
    bin1, bin2 = _bin(F.col("rank"), 1), _bin(F.col("rank"), 2)
    more = (
        F.when(F.col("rank").isNull() | F.col("bin1").isNull(), F.lit(0.0))
        .when(bin1 < F.col("bin1"), F.lit(1.0)).when(bin1 > F.col("bin1"), F.lit(0.0))
        .when(F.col("bin2").isNull(), F.lit(0.0))
        .when(bin2 < F.col("bin2"), F.lit(1.0)).when(bin2 > F.col("bin2"), F.lit(0.0))
        .otherwise(F.least(F.col("share"), F.lit(1.0)))
    )
    taken = (F.col("whole") * F.col("size") + F.floor(more * F.col("size") + 1e-9)).cast("long")
    kept = [F.col(clash.get(c, c)).alias(c) for c in names if c not in ("source_size", "target", "taken")]
    return rows.select(*kept, F.col("source_size"), F.col("target"), taken.alias("taken"))


def mix(docs: DataFrame, ratio: float = 1.5, weights: tuple = (5, 2, 1), cap: float = 2.0) -> DataFrame:
    """``docs`` (doc_id, text, source, any more) with size, source_size, target and taken; columns of these names are replaced."""
    sized = docs.withColumn("size", size_of(F.col("text")))
    narrow = saved(sized.select("doc_id", "source", "size"), "mix-sizes")
    return apply_mix(sized, plan_mix(narrow, ratio, weights, cap), cap)


def copies(mixed: DataFrame) -> DataFrame:
    """The mix itself: each document as often as it is taken, the last copy cut to its leading words."""
    n = F.ceil(F.col("taken") / F.col("size")).cast("int")
    rows = mixed.where(F.col("taken") > 0).withColumn("copy", F.explode(F.sequence(F.lit(1), n)))
    left = (F.col("taken") - (F.col("copy") - 1) * F.col("size")).cast("int")
    lead = F.array_join(F.slice(F.regexp_extract_all("text", F.lit(f"({WORD})"), 1), F.lit(1), left), " ")
    return rows.withColumn("text", F.when(left < F.col("size"), lead).otherwise(F.col("text")))


def query(spark, sf_dir: str) -> DataFrame:
    from .common import read

    docs = read(spark, sf_dir, "documents")
    sized = saved(docs.select("doc_id", "source", size_of(F.col("text")).alias("size")), "mix-sizes")
    return apply_mix(sized, plan_mix(sized)).select("doc_id", "size", "source_size", "target", "taken")
