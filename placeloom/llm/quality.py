"""Quality rules with risk-controlled thresholds, in DataFrame functions only.

Four rules score a document by an integer from 0 to 100, higher being worse.  For each stratum
cutoffs are chosen such that, with confidence ``1 - delta`` over all strata together, no stratum
loses more than ``alpha`` of its good documents that pass the base rules to all rules together:

* a quarter of the labelled documents (by a hash of the id) chooses: for each rule the cutoff that
  rejects most bad documents, good ones weighing ``1 / alpha`` times as much; rules are then put in
  order of what they gain.  The first rule, the first two and so on are a path of ever stricter
  unions,
* the other three quarters test: along the path, the union's rejected good documents k of n must
  have an exact binomial tail P(Bin(n, alpha) <= k) of at most the stratum's share of ``delta``
  (the Clopper-Pearson upper bound is then at most ``alpha``).  The first failure ends the path, a
  fixed sequence, which needs no division of ``delta`` over rules, and ``alpha`` is spent on the
  union rather than divided,
* ``delta`` is divided evenly over the strata that have enough good documents to certify anything
  (their number of test documents, not their scores, decides that).

A stratum without a certified step rejects nothing beyond the base rules.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from placeloom.llm.common import WHITE, materialize, words

SYMBOLS = "#*$%&|<>"
RULES = ("symbols", "capitals", "lines", "repeats")
TOP = 100


def counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_capitals and n_lines (long).

    Null and empty texts count 0 everywhere.  Lines without a word are no lines.  Texts with no
    three-word window found twice take a short path.  Columns of ``docs`` with these names are
    replaced.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    stripped = F.translate(t, WHITE, "")
    lines = F.filter(F.split(t, "\n"), lambda x: F.translate(x, WHITE, "") != "")
    out = docs.withColumns({"__w": words(F.col(text)), "__s": stripped, "__l": lines})
    out = out.withColumn(
        "__t",
        F.when(
            F.size("__w") >= 3,
            F.transform(F.sequence(F.lit(0), F.size("__w") - 3), lambda i: F.xxhash64(F.col("__w")[i], F.col("__w")[i + 1], F.col("__w")[i + 2])),
        ).otherwise(F.array().cast("array<bigint>")),
    )
    out = out.withColumn("__d", F.size("__t") > F.size(F.array_distinct("__t")))
    # (hash, place) in order; a window is repeated if a neighbour has its hash
    out = out.withColumn("__o", F.when(F.col("__d"), F.sort_array(F.transform("__t", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    last = F.size("__o") - 1
    twice = lambda x, i: (
        (F.when(i > 0, F.col("__o")[F.greatest(i - 1, F.lit(0))]["h"] == x["h"]).otherwise(False))
        | (F.when(i < last, F.col("__o")[F.least(i + 1, last)]["h"] == x["h"]).otherwise(False))
    )
    starts = F.sort_array(F.transform(F.filter("__o", twice), lambda x: x["i"]))
    out = out.withColumn("__p", F.when(F.col("__d"), starts))
    tail = F.size("__p") - 1
    covered = F.transform("__p", lambda p, i: F.when(i < tail, F.least(F.lit(3), F.col("__p")[F.least(i + 1, tail)] - p)).otherwise(3))
    return out.withColumns(
        {
            "n_words": F.size("__w").cast("long"),
            "word_chars": F.length("__s").cast("long"),
            "n_symbols": (F.length("__s") - F.length(F.translate("__s", SYMBOLS, ""))).cast("long"),
            "n_dup_lines": (F.size("__l") - F.size(F.array_distinct("__l"))).cast("long"),
            "n_repeat_words": F.when(F.col("__d"), F.aggregate(covered, F.lit(0).cast("long"), lambda a, x: a + x)).otherwise(0).cast("long"),
            "n_capitals": (F.length("__s") - F.length(F.translate("__s", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))).cast("long"),
            "n_lines": F.size("__l").cast("long"),
        }
    ).drop("__w", "__s", "__l", "__t", "__d", "__o", "__p")


def base_failed() -> Column:
    """Under 50 words, or over half of the words in repeated windows."""
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def bins() -> dict[str, Column]:
    """Each rule's integer score, 0 to 100."""
    per = lambda a, b: F.when(F.col(b) > 0, F.least(F.lit(TOP), F.floor(100 * F.col(a) / F.col(b)))).otherwise(0).cast("int")
    return {
        "symbols": per("n_symbols", "n_words"),
        "capitals": per("n_capitals", "word_chars"),
        "lines": per("n_dup_lines", "n_lines"),
        "repeats": per("n_repeat_words", "n_words"),
    }


def stratum(column: str) -> Column:
    """Null is a stratum of its own."""
    return F.coalesce(F.concat(F.lit("="), F.col(column).cast("string")), F.lit("null"))


def _log_gamma(x: Column) -> Column:
    """Stirling's series after shifting by 8; the error is below 1e-13 for x >= 1."""
    z = x + 8
    shift = F.log(x * (x + 1) * (x + 2) * (x + 3)) + F.log((x + 4) * (x + 5) * (x + 6) * (x + 7))
    series = 1 / (12 * z) - 1 / (360 * z**3) + 1 / (1260 * z**5) - 1 / (1680 * z**7)
    return (z - 0.5) * F.log(z) - z + 0.9189385332046727 + series - shift


def binomial_tail(k: Column, n: Column, p: float) -> Column:
    """P(Bin(n, p) <= k): all terms from k down are added.

    At or above the mean the answer is 1, which is safe for a test against a small level.
    """
    k, n = k.cast("double"), n.cast("double")
    first = F.exp(_log_gamma(n + 1) - _log_gamma(k + 1) - _log_gamma(n - k + 1) + k * F.log(F.lit(p)) + (n - k) * F.log(F.lit(1 - p)))
    ratio = lambda i: i * (1 - p) / ((n - i + 1) * p)  # noqa: E731  term(i-1) / term(i)
    below = F.when((n <= 0) | (k >= n * p), F.lit(0.0)).otherwise(k)  # else nothing is to be added up
    total = F.aggregate(
        F.sequence(F.lit(0), below.cast("int")),
        F.struct(first.alias("term"), F.lit(0.0).alias("sum")),
        lambda a, j: F.struct((a["term"] * F.greatest(ratio(k - j), F.lit(0.0))).alias("term"), (a["sum"] + a["term"]).alias("sum")),
    )
    return F.when((n <= 0) | (k >= n * p), F.lit(1.0)).otherwise(F.least(F.lit(1.0), total["sum"]))


def chooses(id_col: str = "doc_id") -> Column:
    """Whether a labelled document is of the quarter that chooses; the others test."""
    return F.substring(F.md5(F.col(id_col).cast("string").cast("binary")), 1, 1).isin("0", "1", "2", "3")


def paths(labelled: DataFrame, alpha: float) -> DataFrame:
    """stratum, rule, cut and step (1, 2, ...): the rules in the order in which they are tested, from the choosing quarter."""
    pairs = F.array(*[F.struct(F.lit(k).alias("rule"), F.col(r).alias("bin")) for k, r in enumerate(RULES)])
    by_bin = (
        labelled.where("chooses")
        .select("stratum", "good", F.inline(pairs))
        .groupBy("stratum", "rule", "bin")
        .agg(F.sum((F.col("good") > 0).cast("long")).alias("good"), F.sum((F.col("good") <= 0).cast("long")).alias("bad"))
    )
    # a row for each stratum and rule: counts by bin, of which there are at most 101
    grouped = by_bin.groupBy("stratum", "rule").agg(
        F.map_from_entries(F.collect_list(F.struct("bin", F.struct("good", "bad")))).alias("m"), F.sum("good").alias("n"), F.sum("bad").alias("nb")
    )
    cut = (
        grouped.where("n > 0 AND nb > 0")
        .select("stratum", "rule", "m", "n", "nb", F.explode(F.sequence(F.lit(1), F.lit(TOP))).alias("cut"))
        .withColumn("over", F.filter(F.map_entries("m"), lambda e: e["key"] >= F.col("cut")))
        .withColumn("k", F.aggregate("over", F.lit(0).cast("long"), lambda a, e: a + e["value"]["good"]))
        .withColumn("b", F.aggregate("over", F.lit(0).cast("long"), lambda a, e: a + e["value"]["bad"]))
        .withColumn("gain", F.col("b") / F.col("nb") - F.col("k") / F.col("n") / alpha)
        .where("gain > 0")
    )
    best = cut.groupBy("stratum", "rule").agg(F.max_by(F.struct("cut", "gain"), F.struct("gain", "cut")).alias("x"))
    ranked = best.groupBy("stratum").agg(F.array_sort(F.collect_list(F.struct((-F.col("x.gain")).alias("worth"), "rule", F.col("x.cut").alias("cut")))).alias("path"))
    return ranked.select("stratum", F.posexplode("path").alias("at", "e")).select("stratum", F.col("e.rule").alias("rule"), F.col("e.cut").alias("cut"), (F.col("at") + 1).alias("step"))


def thresholds(scored: DataFrame, labels: DataFrame, alpha: float = 0.04, delta: float = 0.05) -> DataFrame:
    """Certified cutoffs by stratum from labelled rows: stratum, then a nullable int for each of RULES.

    ``scored``: doc_id, stratum and the rules' scores, of documents that pass the base rules.
    ``labels``: doc_id, quality.  Null labels are ignored; several labels of a document count
    once, good if any is.  Rows of ``scored`` that repeat a doc_id count each.  No labels: no rows.
    """
    marks = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id").agg(F.max("quality").alias("good"))
    labelled = materialize(scored.join(marks, "doc_id").select("stratum", "good", chooses().alias("chooses"), *RULES), "quality-labelled")
    path = materialize(paths(labelled, alpha), "quality-paths")
    tests = labelled.where("NOT chooses AND good > 0")
    sizes = tests.groupBy("stratum").agg(F.count("*").alias("n"))
    # the most strata that can all certify something at an even share of delta; there are as many as values of the stratum
    able = sizes.where(F.col("n") * F.log(F.lit(1 - alpha)) <= F.log(F.lit(delta)))
    ranks = able.alias("a").join(able.alias("b"), F.col("b.n") >= F.col("a.n")).groupBy("a.stratum", "a.n").agg(F.count("*").alias("rank"))
    level = ranks.where(F.col("n") * F.log(F.lit(1 - alpha)) <= F.log(F.lit(delta) / F.col("rank"))).agg((F.lit(delta) / F.max("rank")).alias("level"))
    # the step of the path that first rejects each good test document
    wide = path.groupBy("stratum").agg(F.collect_list(F.struct("rule", "cut", "step")).alias("path"))
    bins_ = F.array(*[F.col(r) for r in RULES])
    first = F.array_min(F.transform(F.filter("path", lambda e: bins_[e["rule"]] >= e["cut"]), lambda e: e["step"]))
    counted = tests.join(wide, "stratum").select("stratum", first.alias("first")).groupBy("stratum", "first").agg(F.count("*").alias("k"))
    lost = path.join(counted, "stratum", "left").groupBy("stratum", "rule", "cut", "step").agg(F.coalesce(F.sum(F.when(F.col("first") <= F.col("step"), F.col("k"))), F.lit(0)).alias("k"))
    tested = lost.join(sizes, "stratum").crossJoin(level).withColumn("passed", binomial_tail(F.col("k"), F.col("n"), alpha) <= F.col("level"))
    end = tested.groupBy("stratum").agg(F.coalesce(F.min(F.when(~F.coalesce("passed", F.lit(False)), F.col("step"))), F.lit(len(RULES) + 1)).alias("end"))
    sure = tested.join(end, "stratum").where("step < end").withColumn("rule", F.element_at(F.array(*[F.lit(r) for r in RULES]), F.col("rule") + 1))
    return sure.groupBy("stratum").pivot("rule", list(RULES)).agg(F.max("cut"))


def verdict() -> Column:
    """True if no rule with a cutoff in the row's stratum rejects it."""
    ok = F.lit(True)
    for r in RULES:
        ok = ok & ~F.coalesce(F.col(r) >= F.col(f"cut_{r}"), F.lit(False))
    return ok


def assess(docs: DataFrame, labels: DataFrame, strata: str = "lang", alpha: float = 0.04, delta: float = 0.05) -> DataFrame:
    """One row for each row of ``docs``: doc_id, the counts, base_failed, the scores, stratum and kept.

    Documents failing the base rules are not kept, whatever their stratum.  Null texts have no
    words and fail.  Repeated rows are judged each; an empty table gives an empty result.
    """
    scored = counts(docs.select("doc_id", "text", stratum(strata).alias("stratum"))).drop("text")
    scored = materialize(scored.withColumn("base_failed", base_failed()).withColumns(bins()), "quality-scores")
    return _judge(scored, scored, labels, alpha, delta)


def _judge(docs: DataFrame, scored: DataFrame, labels: DataFrame, alpha: float, delta: float) -> DataFrame:
    cuts = thresholds(scored.where(~F.col("base_failed")), labels, alpha, delta)
    cuts = materialize(cuts.select("stratum", *[F.col(r).alias(f"cut_{r}") for r in RULES]), "quality-cutoffs")
    # one condition over both sides: a part of it pushed below would split the text anew for each word
    return docs.join(cuts, "stratum", "left").withColumn("kept", F.when(F.col("base_failed"), False).otherwise(verdict()))


def keep_good(docs: DataFrame, labels: DataFrame, strata: str = "lang", alpha: float = 0.04, delta: float = 0.05) -> DataFrame:
    """The rows of ``docs`` that the rules keep, with the same columns and whole texts.

    Scores of labelled documents choose the cutoffs; a second pass applies them where the text
    is, so that texts are never shuffled.  Columns that clash with the counts' names survive.
    """
    inner = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row")
    packed = docs.select(inner, F.col("doc_id"), F.col("text"), stratum(strata).alias("stratum"))
    full = counts(packed).drop("text").withColumn("base_failed", base_failed()).withColumns(bins())
    scored = materialize(full.select("doc_id", "stratum", "base_failed", *RULES), "quality-scores")
    return _judge(full, scored, labels, alpha, delta).where("kept").select("__row.*")
