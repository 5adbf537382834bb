"""Benchmark decontamination by size-partitioned MinHash containment, in DataFrame functions only.

Test items are partitioned by their number of shingles into classes [2^j, 2^(j+1)).  An item of a
class is sketched by k of its shingles, k following from the class's upper size bound: the smallest
hashes, those that fewest items share first.  If a document holds at least ``percent`` of the
item's q shingles, at most (100 - percent) * q / 100 are missing, so at least k less that number of
the sketch are in the document.  A document thus is a candidate for an item only with so many hits,
however long it is, and no pair over the threshold is missed; a shingle that all items share makes
no candidates by itself.  Banded signatures of whole documents would be blind here: 30 shingles
among 20,000 have a Jaccard similarity of about 0.001.

Items shorter than a shingle are one shingle of their own length, looked for at that length.
Candidates are verified by the exact share of the item's distinct shingles, compared as strings.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from placeloom.llm.common import materialize

OTHER = r"[^\p{L}\p{M}\p{N}]+"


def text_words(text: Column) -> Column:
    """Lower-cased runs of letters, marks and digits; null gives none."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), OTHER), lambda w: w != "")


def windows(w: str, size: int, make) -> Column:
    """``make`` of the words of each window of ``size`` words; none in a shorter text."""
    at = F.col(w)
    full = F.transform(F.sequence(F.lit(0), F.size(w) - size), lambda i: make(*[at[i + k] for k in range(size)]))
    return F.when(F.size(w) >= size, full).otherwise(F.array())


def hashes(w: str, size: int) -> Column:
    return windows(w, size, lambda *x: F.xxhash64(F.lit(size), *x))


def shingles(w: str, size: int) -> Column:
    return windows(w, size, lambda *x: F.concat_ws(" ", *x))


def shingled_items(items: DataFrame, size: int = 5) -> DataFrame:
    """item_id, item_key (alike for items of the same shingles), window, h and s of each distinct shingle, n_shingles.

    Items without words are left out: they are in no document.
    """
    w = items.select("item_id", text_words(F.col("text")).alias("w")).where(F.size("w") > 0)
    w = w.withColumn("window", F.least(F.size("w"), F.lit(size)))
    pick = lambda make: F.coalesce(*[F.when(F.col("window") == n, make("w", n)) for n in range(1, size + 1)])
    s = w.select("item_id", "window", F.array_sort(F.array_distinct(F.arrays_zip(pick(hashes).alias("h"), pick(shingles).alias("s")))).alias("x"))
    s = s.select("item_id", "window", F.size("x").cast("long").alias("n_shingles"), F.sha2(F.concat_ws("|", F.transform("x", lambda e: e["s"])), 256).alias("item_key"), F.inline("x"))
    return s.select("item_id", "item_key", "window", "h", "s", "n_shingles")


def sketches(shingled: DataFrame, percent: int = 80) -> DataFrame:
    """item_key, size_class, h (of the sketch) and need (hits without which no document can hold ``percent``)."""
    one = shingled.select("item_key", "h", "n_shingles").distinct()
    one = one.join(one.groupBy("h").agg(F.count("*").alias("items")), "h")
    missing = F.floor((100 - percent) * F.col("n_shingles") / 100)
    size_class = F.floor(F.log2("n_shingles")).cast("int")
    bound = F.pow(F.lit(2.0), size_class + 1).cast("long")
    k = F.least(F.col("n_shingles"), 2 * F.floor((100 - percent) * bound / 100) + 1).cast("int")
    kept = one.groupBy("item_key", "n_shingles").agg(F.array_sort(F.collect_list(F.struct("items", "h"))).alias("x"))
    return kept.select("item_key", size_class.alias("size_class"), (k - missing).alias("need"), F.explode(F.slice("x", F.lit(1), k)).alias("e")).select("item_key", "size_class", "need", "e.h")


def contained(docs: DataFrame, items: DataFrame, percent: int = 80, size: int = 5) -> DataFrame:
    """One row for each document and item with at least ``percent`` of the item's shingles in the text.

    Columns doc_id, text_key, item_id, n_shingles, n_shared (long), containment (double).  Rows
    of ``docs`` that repeat id and text count once; equal item ids with different texts are
    different items of which the best counts.  Null and empty texts contain nothing; without
    documents or items the result is empty.
    """
    known = materialize(shingled_items(items.select("item_id", "text"), size), "decontaminate-items")
    index = materialize(sketches(known, percent), "decontaminate-sketches")
    sizes = [r[0] for r in known.select("window").distinct().orderBy("window").collect()]  # at most ``size``
    # a document is known by 128 bits of its id and text
    keyed = docs.select("doc_id", F.xxhash64(F.col("doc_id").isNull(), "doc_id").alias("d"), F.xxhash64("text").alias("text_key"), "text")
    split = lambda rows, make: rows.select("doc_id", "d", "text_key", text_words(F.col("text")).alias("w")).select("doc_id", "d", "text_key", F.explode(F.concat(*[make(n) for n in sizes] or [make(size)])).alias("x"))
    # the planner broadcasts the written sketches if they are under its threshold, else shuffles
    seen = split(keyed, lambda n: hashes("w", n)).withColumnRenamed("x", "h")
    hits = seen.join(index, "h").groupBy("doc_id", "d", "text_key", "item_key", "need").agg(F.count_distinct("h").alias("hits"))
    pairs = materialize(hits.where("hits >= need").select("doc_id", "d", "text_key", "item_key"), "decontaminate-candidates")
    # exact: of the candidates' texts only shingles that items have move on
    some = keyed.join(pairs.select("d", "text_key").distinct(), ["d", "text_key"], "left_semi")
    both = split(some, lambda n: F.arrays_zip(hashes("w", n).alias("h"), shingles("w", n).alias("s"))).select("d", "text_key", "x.h", "x.s")
    held = both.join(known.select("h", "s").distinct(), ["h", "s"], "left_semi").select("d", "text_key", "s").distinct()
    wanted = pairs.join(known.select("item_key", "s", "n_shingles").distinct(), "item_key")
    counted = wanted.join(held, ["d", "text_key", "s"]).groupBy("doc_id", "d", "text_key", "item_key", "n_shingles").agg(F.count("*").alias("n_shared"))
    enough = counted.where(100 * F.col("n_shared") >= percent * F.col("n_shingles"))
    named = enough.join(known.select("item_id", "item_key").distinct(), "item_key")
    best = named.groupBy("doc_id", "text_key", "item_id").agg(F.max_by(F.struct("n_shingles", "n_shared"), F.struct(F.col("n_shared") / F.col("n_shingles"), "n_shared")).alias("x"))
    return best.select("doc_id", "text_key", "item_id", "x.n_shingles", "x.n_shared", (F.col("x.n_shared") / F.col("x.n_shingles")).alias("containment"))


def drop_contaminated(docs: DataFrame, items: DataFrame, percent: int = 80, size: int = 5) -> DataFrame:
    """The rows of ``docs`` that contain no item, with the same columns and whole texts."""
    bad = materialize(contained(docs, items, percent, size).select(F.col("doc_id").alias("__i"), F.col("text_key").alias("__k")).distinct(), "decontaminate-found")
    same = docs["doc_id"].eqNullSafe(bad["__i"]) & (F.xxhash64(docs["text"]) == bad["__k"])
    return docs.join(bad, same, "left_anti")
