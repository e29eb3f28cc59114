"""Quality rules with risk-controlled thresholds, in DataFrame functions only.

Method: each rule rejects documents whose metric exceeds a cutoff.  On the
labelled documents that are good, every candidate cutoff of every rule is
tested in every stratum: the hypothesis "the rule falsely rejects more than
its share of ``risk``" is rejected when a binomial variable of that rate would
show so few false rejections with probability at most ``delta`` over the
number of all tests (exact binomial bound, Bonferroni correction).  A rule
takes the lowest certified cutoff of the stratum; where none is certified it
never rejects.  The shares of the rules add up to ``risk``, so with
probability 1 - delta no stratum loses more than ``risk`` of its good
documents to the rules.

Edge cases: a null text has no words and fails the base rule; a null stratum
is a stratum of its own; repeated rows give repeated results; without labels
nothing is certified and only the base rule rejects; extra columns are not
read.  A label repeated for a document counts once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from vectriage.llm.common import keep

WHITE = "\t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
MOST_STRATA = 50_000           # cutoffs of so many strata, under 5 MB, are broadcast
# Candidate cutoffs of each rule, tested from all sides at once.
CUTOFFS = {
    "symbol_share": [0.005, 0.01, 0.02, 0.05, 0.1, 0.2],
    "repeat_share": [0.05, 0.1, 0.15, 0.2, 0.3, 0.4],
    "dup_line_share": [0.01, 0.02, 0.05, 0.1, 0.2, 0.5],
    "mean_word": [6.0, 7.0, 8.0, 10.0, 12.0, 20.0],
}


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once, also inside a branch."""
    return F.element_at(F.transform(F.array(value), body), 1)


def repeat_words(words: Column, size: int = 3) -> Column:
    """Words covered by windows of ``size`` words found twice or more in the array ``words``."""
    windows = F.transform(F.slice(words, 1, F.greatest(F.size(words) - (size - 1), F.lit(0))),
                          lambda x, i: F.xxhash64(x, *(F.get(words, i + k) for k in range(1, size))))

    def covered(w: Column) -> Column:
        pairs = F.array_sort(F.transform(w, lambda h, i: F.struct(h.alias("h"), i.alias("p"))))
        twice = let(pairs, lambda s: F.filter(s, lambda x, i: F.coalesce(
            (i > 0) & (F.get(s, i - 1)["h"] == x["h"]), F.lit(False)) | F.coalesce(F.get(s, i + 1)["h"] == x["h"], F.lit(False))))
        places = F.array_sort(F.transform(twice, lambda x: x["p"]))
        zero = F.struct(F.lit(0).cast("long").alias("n"), F.lit(-size).alias("end"))
        return F.aggregate(places, zero, lambda a, p: F.struct(
            (a["n"] + size - F.greatest(a["end"] - p, F.lit(0))).alias("n"), (p + size).alias("end")), lambda a: a["n"])

    return let(windows, lambda w: F.when(F.size(F.array_distinct(w)) == F.size(w), F.lit(0).cast("long")).otherwise(covered(w)))


def base_metrics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", stratum_col: str = "lang") -> DataFrame:
    """Counts of every whole text: (doc_id, stratum, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words)."""
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"),
                       F.col(stratum_col).cast("string").alias("stratum"),
                       F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    spaced = F.col("text")
    for c in WHITE:
        spaced = F.replace(spaced, F.lit(c), F.lit(" "))
    bare = F.col("text")
    for c in SYMBOLS:
        bare = F.replace(bare, F.lit(c), F.lit(""))
    split = slim.withColumn("words", F.array_remove(F.split(spaced, " "), ""))
    lines = F.filter(F.split("text", "\n"), lambda x: F.trim(x, F.lit(WHITE + " ")) != "")
    return split.select(
        "doc_id", "stratum", F.size("words").cast("long").alias("n_words"),
        F.char_length(F.array_join("words", "")).cast("long").alias("word_chars"),
        (F.octet_length("text") - F.octet_length(bare)).cast("long").alias("n_symbols"),
        let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        repeat_words(F.col("words")).alias("n_repeat_words"))


def with_rules(metrics: DataFrame) -> DataFrame:
    words = F.greatest("n_words", F.lit(1))
    return metrics.withColumns({
        "base_failed": (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")),
        "symbol_share": F.col("n_symbols") / F.greatest("word_chars", F.lit(1)),
        "repeat_share": F.col("n_repeat_words") / words,
        "dup_line_share": F.col("n_dup_lines") / words,
        "mean_word": F.col("word_chars") / words,
    })


def binomial_at_most(k: Column, n: Column, rate: float) -> Column:
    """P(X <= k) for X binomial(n, rate), by summing exact terms in logarithms."""
    zero = F.struct((n * F.log1p(F.lit(-rate))).alias("term"), F.lit(0.0).alias("sum"))
    odds = F.log(F.lit(rate / (1 - rate)))
    return F.aggregate(F.sequence(F.lit(0).cast("long"), k), zero, lambda a, i: F.struct(
        (a["term"] + F.log((n - i).cast("double") / (i + 1)) + odds).alias("term"), (a["sum"] + F.exp(a["term"])).alias("sum")),
        lambda a: a["sum"])


def certified_cutoffs(labelled: DataFrame, risk: float, delta: float, cutoffs: dict[str, list[float]] = CUTOFFS) -> DataFrame:
    """(stratum, <rule>...): lowest certified cutoff of each rule, null where none is; ``labelled``: good documents only."""
    rate = risk / len(cutoffs)
    tests = [(rule, c) for rule, values in cutoffs.items() for c in values]
    counts = labelled.groupBy("stratum").agg(F.count("*").alias("n"), *(
        F.count_if(F.col(rule) > c).alias(f"t{i}") for i, (rule, c) in enumerate(tests)))
    strata = counts.agg(F.count("*").alias("strata"))
    one = counts.crossJoin(F.broadcast(strata)).select("stratum", "n", "strata", F.explode(F.array(*(
        F.struct(F.lit(rule).alias("rule"), F.lit(c).alias("cutoff"), F.col(f"t{i}").alias("k")) for i, (rule, c) in enumerate(tests)))).alias("t"))
    # At or above the expected count the bound cannot hold, so the sum is not needed there.
    sure = one.where(F.col("t.k") < F.col("n") * rate).where(
        binomial_at_most(F.col("t.k"), F.col("n"), rate) <= F.lit(delta) / (len(tests) * F.col("strata")))
    return sure.groupBy("stratum").agg(*(F.min(F.when(F.col("t.rule") == rule, F.col("t.cutoff"))).alias(f"cut_{rule}") for rule in cutoffs))


def judge(docs: DataFrame, labels: DataFrame, risk: float = 0.04, delta: float = 0.05, id_col: str = "doc_id",
          text_col: str = "text", stratum_col: str = "lang") -> DataFrame:
    """Base metrics of every document, the base rule, and ``kept`` by the certified cutoffs of its stratum."""
    metrics = keep(base_metrics(docs, id_col, text_col, stratum_col))
    rated = with_rules(metrics)
    good = labels.where("quality = 1").select(F.col("doc_id").cast("long").alias("doc_id")).distinct()
    cuts = certified_cutoffs(rated.where("not base_failed").join(good, "doc_id", "left_semi"), risk, delta)
    # One row per stratum that has a certified cutoff: broadcast while these are few.
    cuts = keep(cuts.withColumnRenamed("stratum", "_stratum"))
    cuts = F.broadcast(cuts) if cuts.count() <= MOST_STRATA else cuts
    over = F.lit(False)
    for rule in CUTOFFS:
        over = over | F.coalesce(F.col(rule) > F.col(f"cut_{rule}"), F.lit(False))
    return (rated.join(cuts, F.col("stratum").eqNullSafe(F.col("_stratum")), "left")
            .withColumn("kept", ~F.col("base_failed") & ~over)
            .select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"))
