"""Retrieval quality and grounding."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T


def hits(ranked: DataFrame, expected: DataFrame, task: str, item: str, k: int) -> DataFrame:
    """Per task of expected (task, item): first (rank of the first expected item within k, or null), found, returned."""
    top = ranked.where(F.col("rank") <= k)
    got = top.join(expected, [task, item]).groupBy(task).agg(F.min("rank").alias("first"), F.count(F.lit(1)).alias("found"))
    n = top.groupBy(task).agg(F.count(F.lit(1)).alias("returned"))
    return expected.select(task).distinct().join(n, task, "left").join(got, task, "left").select(task, "first", F.coalesce("found", F.lit(0)).alias("found"), F.coalesce("returned", F.lit(0)).alias("returned"))


def quality(h: DataFrame) -> DataFrame:
    """tasks, hit, mrr, precision (of what was returned), each to 3 digits, and the tiers full (rank 1), partial (2 to 5), miss."""
    zero = F.lit(0.0)
    return h.agg(
        F.count(F.lit(1)).alias("tasks"),
        T.half_up(F.avg(F.when(F.col("first").isNotNull(), 1.0).otherwise(0.0)), 3).alias("hit"),
        T.half_up(F.avg(F.coalesce(1.0 / F.col("first"), zero)), 3).alias("mrr"),
        T.half_up(F.avg(F.when(F.col("returned") > 0, F.col("found") / F.col("returned")).otherwise(zero)), 3).alias("precision"),
        F.sum(F.when(F.col("first") == 1, 1).otherwise(0)).alias("n_full"),
        F.sum(F.when(F.col("first").between(2, 5), 1).otherwise(0)).alias("n_partial"),
        F.sum(F.when(F.coalesce(F.col("first"), F.lit(99)) > 5, 1).otherwise(0)).alias("n_miss"),
    )


def usefulness(first: Column) -> Column:
    """1 at rank 1, a half at ranks 2 to 5, else 0."""
    return F.when(first == 1, 1.0).when(first.between(2, 5), 0.5).otherwise(0.0)


def groundedness(answer: Column, context: Column) -> Column:
    """The part of the answer's words that the context has, repeats counted; 0 of an empty answer; 3 digits."""
    a, c = T.judge_tokens(answer), T.judge_tokens(context)
    return F.when(F.size(a) > 0, T.half_up(F.size(F.filter(a, lambda t: F.array_contains(c, t))) / F.size(a), 3)).otherwise(0.0)


def grounded_scores(answers: DataFrame, contexts: DataFrame, key: str, keep: list[str], text: str = "text") -> DataFrame:
    """keep, score of each row of answers (key, text): groundedness in the words of all rows of contexts (key, text) of the same key. Words
    meet words, so no context is gathered and a key of any size spreads over its words."""
    a = answers.select(F.monotonically_increasing_id().alias("_row"), F.col(key).alias("_key"), *keep, T.judge_tokens(F.col(text)).alias("_words"))
    a = a.select("_row", "_key", *keep, F.explode_outer("_words").alias("_word"))
    a = a.groupBy("_row", "_key", *keep, "_word").agg(F.count("_word").alias("_n"))
    known = contexts.select(F.col(key).alias("_key"), F.explode(T.judge_tokens(F.col(text))).alias("_word")).distinct().withColumn("_known", F.lit(True))
    g = a.join(known, ["_key", "_word"], "left").groupBy("_row", *keep).agg(F.sum("_n").alias("_n"), F.sum(F.when(F.col("_known"), F.col("_n")).otherwise(0)).alias("_hit"))
    return g.select(*keep, F.when(F.col("_n") > 0, T.half_up(F.col("_hit") / F.col("_n"), 3)).otherwise(0.0).alias("score"))


GENERIC = ["as an ai", "generally speaking", "in general", "it depends", "there are many ways", "typically you would"]


def judged(rows: DataFrame, answer: str = "answer", context: str = "context", least: float = 0.25) -> DataFrame:
    """rows with score, reasons and verdict: pass without reasons."""
    score = groundedness(F.col(answer), F.col(context))
    low = F.lower(F.coalesce(F.col(answer), F.lit("")))
    reasons = F.array_compact(F.array(F.when(F.length(F.trim(low)) == 0, "empty answer"), F.when(score < least, "low grounding"), *[F.when(F.contains(low, F.lit(g)), f"generic: {g}") for g in GENERIC]))
    out = rows.withColumn("score", score).withColumn("reasons", reasons)
    return out.withColumn("verdict", F.when(F.size("reasons") == 0, "pass").otherwise("fail")).withColumn("learn", F.when(F.col("score") > 0.75, 0.05).when(F.col("score") < 0.40, -0.03).otherwise(0.0))


def macro_prf(pairs: DataFrame, truth: DataFrame, key: str, item: str) -> DataFrame:
    """Mean precision, recall and F1 over keys of found and true (key, item) pairs."""
    p, t = pairs.select(key, item).distinct(), truth.select(key, item).distinct()
    both = p.join(t, [key, item]).groupBy(key).agg(F.count(F.lit(1)).alias("both"))
    n = p.groupBy(key).agg(F.count(F.lit(1)).alias("np")).join(t.groupBy(key).agg(F.count(F.lit(1)).alias("nt")), key, "full").join(both, key, "left").fillna(0, ["np", "nt", "both"])
    pr, rc = F.when(F.col("np") > 0, F.col("both") / F.col("np")).otherwise(0.0), F.when(F.col("nt") > 0, F.col("both") / F.col("nt")).otherwise(0.0)
    return n.agg(F.avg(pr).alias("precision"), F.avg(rc).alias("recall")).withColumn("f1", F.when(F.col("precision") + F.col("recall") > 0, 2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall"))).otherwise(0.0))


def ablation(runs: DataFrame) -> DataFrame:
    """arm, mean, least and largest flagged per 100 over runs of (arm, run, flagged)."""
    r = runs.groupBy("arm", "run").agg((100.0 * F.avg(F.col("flagged").cast("int"))).alias("per_100"))
    return r.groupBy("arm").agg(T.half_up(F.avg("per_100"), 1).alias("mean"), F.min("per_100").alias("least"), F.max("per_100").alias("largest"))
