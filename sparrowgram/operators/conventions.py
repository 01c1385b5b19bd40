"""Naming and export conventions: how consistent a code base is, and what breaks them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

NEUTRAL = ("other", "single-word")


def scored(rows: DataFrame, by: str, label: str, item: str, examples: int = 3) -> DataFrame:
    """Of rows (by, label, item): by, dominant, pct, total, tier, examples (the first by name). Neutral labels don't count; ties go to the
    first label."""
    n = rows.where(~F.col(label).isin(*NEUTRAL)).groupBy(by, label).agg(F.count(F.lit(1)).alias("n"), F.slice(F.array_sort(F.collect_set(item)), 1, examples).alias("examples"))
    w = Window.partitionBy(by)
    best = n.withColumn("total", F.sum("n").over(w)).withColumn("r", F.row_number().over(w.orderBy(F.col("n").desc(), label))).where("r = 1")
    pct = F.col("n") / F.col("total")
    tier = F.when(pct >= 0.9, "consistent").when(pct >= 0.7, "mostly").otherwise("mixed")
    return best.select(by, F.col(label).alias("dominant"), pct.alias("pct"), "total", tier.alias("tier"), "examples")


def variants(rows: DataFrame, by: str, label: str) -> DataFrame:
    """by, label, n, pct for every counted label."""
    n = rows.where(~F.col(label).isin(*NEUTRAL)).groupBy(by, label).agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("pct", F.col("n") / F.sum("n").over(Window.partitionBy(by)))


def overall(s: DataFrame) -> DataFrame:
    """One row, score: the mean of pct weighted by total."""
    return s.agg((F.sum(F.col("pct") * F.col("total")) / F.sum("total")).alias("score"))


def delta(now: DataFrame, before: DataFrame, by: str) -> DataFrame:
    return now.select(by, F.col("pct").alias("now")).join(before.select(by, F.col("pct").alias("before")), by, "full").withColumn("change", F.coalesce("now", F.lit(0.0)) - F.coalesce("before", F.lit(0.0)))


def gate(d: DataFrame, s: DataFrame, least: float = 0.7) -> DataFrame:
    """One row: score, regressions, ok (the score reaches the least and nothing fell)."""
    fell = d.agg(F.sum((F.col("change") < -1e-9).cast("int")).alias("regressions"))
    return overall(s).join(F.broadcast(fell)).withColumn("ok", (F.col("score") >= least) & (F.coalesce("regressions", F.lit(0)) == 0))


def fixes(names: DataFrame, name: str, dominant: str) -> DataFrame:
    """name, to: each name of another style in the dominant one."""
    style = T.naming_style(F.col(name))
    return names.where((style != dominant) & ~style.isin(*NEUTRAL)).select(name, T.restyled(F.col(name), dominant).alias("to"))


def proposal(s: DataFrame) -> DataFrame:
    """Whether new files should follow the dominant style: propose from 0.7, warn from 0.5, else refuse."""
    return s.withColumn("action", F.when(F.col("pct") >= 0.7, "propose").when(F.col("pct") >= 0.5, "warn").otherwise("refuse"))
