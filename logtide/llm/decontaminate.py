"""Benchmark decontamination by winnowing, in DataFrame functions only.

Every text is cut into words; each run of ``K`` words has a hash, and of each ``WINDOW - K + 1`` consecutive hashes the
smallest is a fingerprint.  Two texts that share ``WINDOW`` words share a fingerprint, so joining fingerprints finds
every document that holds a window of an item.  Those documents are then compared word by word: their own windows
are joined with the items' windows as text, and the hits extend to all words they cover.  Items of fewer than
``WINDOW`` words are one window each; as they have too few words for a fingerprint, every run of as many words is
compared, for those lengths only that the benchmark has and, while they are few enough to be broadcast, only where an item's first word stands.
Windows of the same items, and documents of the same such sets, are told apart no further: the items of each combination are listed once.

Cases:  null or wordless texts have no words and no hits; a wordless item has no window; an item without id counts
in n_hit and not in n_items; rows that repeat an id and a text get equal results; a very long text is one array of words and of
three numbers a word, and its windows stand in rows of ``PIECE`` words; no documents give no row, no items no hit; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, read, saved, text_of

BREAK = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WINDOW, K = 10, 5
#: Words of a text whose windows stand in one row.
PIECE = 512
#: Fingerprints or windows of at most so many bytes, 40 a row added, are broadcast; more are joined by a shuffle.
BROADCAST_BYTES = 16 << 20


def words_of(text: Column) -> Column:
    """Words in order: A-Z lowered, ASCII other than letters and digits separates."""
    return F.array_remove(F.split(ascii_lower(text_of(text)), BREAK), "")


def _runs(n: Column, length: int) -> Column:
    """1 .. n - length + 1, or nothing."""
    return F.when(n >= length, F.sequence(F.lit(1), n - (length - 1))).otherwise(F.array().cast("array<int>"))


def _text_at(words: str, length: int | Column) -> Column:
    n = F.size(words)
    length = F.lit(length) if isinstance(length, int) else length
    starts = F.when((n >= length) & (n > 0), F.sequence(F.lit(1), n - length + 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.array_join(F.slice(words, i, length), " "))


def with_fingerprints(df: DataFrame, words: str = "words") -> DataFrame:
    """Adds ``prints``, the distinct winnowed hashes of ``words``."""
    gap = WINDOW - K + 1
    at = lambda a, i, j: F.get(a, i + (j - 1))
    hashed = df.withColumn("_w", F.transform(words, lambda w: F.xxhash64(w)))
    hashed = hashed.withColumn("_k", F.transform(_runs(F.size("_w"), K), lambda i: F.xxhash64(*[at("_w", i, j) for j in range(K)])))
    least = F.transform(_runs(F.size("_k"), gap), lambda i: F.least(*[at("_k", i, j) for j in range(gap)]))
    return hashed.withColumn("prints", F.array_distinct(least)).drop("_w", "_k")


def _fits(df: DataFrame, width: Column) -> bool:
    """Whether ``df``, a written table or little more, has been measured to be small enough for a broadcast."""
    return (df.agg(F.sum(width + 40)).first()[0] or 0) <= BROADCAST_BYTES


def _sized(df: DataFrame, width: Column) -> DataFrame:
    return F.broadcast(df) if _fits(df, width) else df


def item_windows(items: DataFrame) -> DataFrame:
    """Distinct (item_id, length, window) of (item_id, words)."""
    words = items.select("item_id", "words").where(F.size("words") > 0)
    words = words.withColumn("length", F.least(F.lit(WINDOW), F.size("words")))
    return words.select("item_id", "length", F.explode(_text_at("words", F.col("length"))).alias("window")).distinct()


def contaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """Per row of (doc_id, text): doc_id, n_words, n_hit, n_items, items_sha256, contaminated, print (of the text)."""
    rows = docs.select("doc_id", text_of(F.col("text")).alias("text"))
    rows = rows.withColumn("print", F.xxhash64("text")).withColumn("words", words_of(F.col("text")))
    counted = saved(with_fingerprints(rows).select("doc_id", "print", F.size("words").alias("n_words"), "prints"), "leak-prints")
    # Written before they are exploded: a filter on the exploded array would else compute it anew for each element.
    item_prints = saved(with_fingerprints(items.select("item_id", words_of(F.col("text")).alias("words"))), "leak-items")
    windows = saved(item_windows(item_prints), "leak-windows")
    known = saved(item_prints.select(F.explode("prints").alias("fp")).distinct(), "leak-known")

    met = counted.select("doc_id", "print", F.explode("prints").alias("fp")).join(_sized(known, F.lit(8)), "fp", "left_semi")
    candidates = saved(met.select("doc_id", "print").distinct(), "leak-candidates")
    near = rows.join(candidates, [rows["doc_id"].eqNullSafe(candidates["doc_id"]), rows["print"] == candidates["print"]], "left_semi")
    texts = saved(windows.select("length", "window").distinct(), "leak-texts")
    whole, short = texts.where(F.col("length") == WINDOW), texts.where(F.col("length") < WINDOW)
    found = _hits(near, whole)
    lengths = sorted(r["length"] for r in short.select("length").distinct().collect())  # 9 lengths at most
    if lengths:
        found = found.unionByName(_short_hits(rows, short, lengths))
    found = saved(found, "leak-hits")

    cover = F.transform("spans", lambda s: F.sequence(s["start"], s["start"] + s["length"] - 1))
    covered = (
        found.groupBy("doc_id", "print").agg(F.collect_set(F.struct("start", "length")).alias("spans"))
        .select("doc_id", "print", F.size(F.array_distinct(F.flatten(cover))).cast("long").alias("n_hit"))
    )
    which = _items(found, windows)
    result = _left(_left(counted.select("doc_id", "print", "n_words"), covered), which)
    n_hit = F.coalesce("n_hit", F.lit(0))
    return result.select(
        "doc_id", F.col("n_words").cast("long"), n_hit.cast("long").alias("n_hit"), F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"),
        F.coalesce("items_sha256", F.sha2(F.lit(""), 256)).alias("items_sha256"), (n_hit > 0).alias("contaminated"), "print",
    )


def _pieces(docs: DataFrame, length: int) -> DataFrame:
    """(doc_id, print, base, words): each text in pieces of ``PIECE`` words and the ``length`` - 1 that follow, so that no row holds the windows of a whole text."""
    bases = F.sequence(F.lit(0), F.greatest(F.size("words") - 1, F.lit(0)), F.lit(PIECE))
    rows = docs.select("doc_id", "print", "words", F.explode(bases).alias("base"))
    return rows.select("doc_id", "print", "base", F.slice("words", F.col("base") + 1, F.lit(PIECE + length - 1)).alias("words"))


def _hits(docs: DataFrame, texts: DataFrame) -> DataFrame:
    """(doc_id, print, start, length, window) of each window of ``WINDOW`` words that an item has too."""
    own = _pieces(docs.dropDuplicates(["doc_id", "print"]), WINDOW)
    # The outer explode gets no filter that would make the array twice; the join drops its null rows.
    own = own.select("doc_id", "print", "base", F.posexplode_outer(_text_at("words", WINDOW)).alias("at", "window"))
    own = own.select("doc_id", "print", (F.col("base") + F.col("at")).alias("start"), "window")
    joined = own.join(_sized(texts, F.octet_length("window")), "window")
    return joined.select("doc_id", "print", "start", "length", "window")


def _short_hits(docs: DataFrame, texts: DataFrame, lengths: list[int]) -> DataFrame:
    """As ``_hits``, for items of fewer than ``WINDOW`` words; ``docs`` are read once for all ``lengths``."""
    most = lengths[-1]
    n = F.least(F.size("words"), F.lit(PIECE))
    starts = F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))
    own = _pieces(docs, most).select("doc_id", "print", "base", F.posexplode_outer(F.transform(starts, lambda i: F.slice("words", i, most))).alias("at", "ahead"))
    own = own.select("doc_id", "print", (F.col("base") + F.col("at")).alias("start"), "ahead")
    heads = texts.select(F.substring_index("window", " ", 1).alias("head")).distinct()
    if _fits(heads, F.octet_length("head")):  # by a shuffle, frequent words would be hot keys; without it the join below does the same
        own = own.join(F.broadcast(heads), F.get("ahead", F.lit(0)) == F.col("head"), "left_semi")
    runs = F.transform(
        F.array(*[F.lit(length) for length in lengths]),
        lambda k: F.when(F.size("ahead") >= k, F.struct(k.alias("length"), F.array_join(F.slice("ahead", 1, k), " ").alias("window"))),
    )
    own = own.select("doc_id", "print", "start", F.explode_outer(runs).alias("run")).select("doc_id", "print", "start", "run.length", "run.window")
    joined = own.join(_sized(texts, F.octet_length("window")), ["length", "window"])
    return joined.select("doc_id", "print", "start", "length", "window")


def _items(found: DataFrame, windows: DataFrame) -> DataFrame:
    """(doc_id, print, n_items, items_sha256) of the documents with hits."""
    sets = windows.groupBy("length", "window").agg(F.sort_array(F.collect_set(F.col("item_id").cast("string"))).alias("ids"))
    sets = sets.withColumn("items", F.sha2(F.to_json("ids"), 256))
    met = found.select("doc_id", "print", "length", "window").distinct().join(sets.drop("ids"), ["length", "window"])
    mine = met.groupBy("doc_id", "print").agg(F.sort_array(F.collect_set("items")).alias("combination"))
    each = mine.select("combination").distinct().select("combination", F.explode("combination").alias("items"))
    listed = each.join(sets.select("items", "ids").dropDuplicates(["items"]), "items").groupBy("combination")
    ids = listed.agg(F.sort_array(F.array_distinct(F.flatten(F.collect_list("ids")))).alias("ids"))
    ids = ids.select("combination", F.size("ids").alias("n_items"), F.sha2(F.array_join("ids", ","), 256).alias("items_sha256"))
    return mine.join(ids, "combination").drop("combination")


def _left(rows: DataFrame, found: DataFrame) -> DataFrame:
    found = found.withColumnsRenamed({"doc_id": "_leak_id", "print": "_leak_print"})
    return rows.join(found, rows["doc_id"].eqNullSafe(found["_leak_id"]) & (rows["print"] == found["_leak_print"]), "left").drop("_leak_id", "_leak_print")


def clean(docs: DataFrame, items: DataFrame) -> DataFrame:
    """``docs`` without those that hold a benchmark window."""
    bad = contaminated(docs, items).where("contaminated").select(F.col("doc_id").alias("_leak_id"), F.col("print").alias("_leak_print")).distinct()
    bad = saved(bad, "leak-bad")
    same = docs["doc_id"].eqNullSafe(bad["_leak_id"]) & (F.xxhash64(text_of(docs["text"])) == bad["_leak_print"])
    return docs.join(bad, same, "left_anti")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark")).drop("print")


ORACLE = r"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
              '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS words FROM documents),
b AS (SELECT item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
              '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS words FROM benchmark),
bl AS (SELECT item_id, words, least(10, len(words)) AS n FROM b WHERE len(words) > 0),
bw AS (SELECT DISTINCT item_id, n, array_to_string(words[i:i + n - 1], ' ') AS win FROM (SELECT item_id, words, n, unnest(range(1, len(words) - n + 2)) AS i FROM bl)),
dw AS (SELECT doc_id, i, n, array_to_string(words[i:i + n - 1], ' ') AS win
       FROM (SELECT doc_id, words, n, unnest(range(1, len(words) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM bw) WHERE len(words) >= n)),
h AS (SELECT doc_id, i, dw.n, item_id FROM dw JOIN bw ON dw.n = bw.n AND dw.win = bw.win),
hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM (SELECT DISTINCT doc_id, i, n FROM h)) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM h) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit ON d.doc_id = hit.doc_id LEFT JOIN its ON d.doc_id = its.doc_id
"""
