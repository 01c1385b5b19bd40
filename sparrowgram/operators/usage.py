"""Roll-ups of usage logs: one pass, partial aggregates, the buckets by grouping sets."""

from __future__ import annotations

import re
from datetime import UTC, datetime, timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

PRICES = {"default": 3.0, "large": 15.0, "medium": 3.0, "small": 0.25}  # USD a million tokens


def normalized(log: DataFrame) -> DataFrame:
    """Rows of either schema as ts, op, baseline, actual, saved (never negative)."""
    has = set(log.columns)
    pick = lambda *names: F.coalesce(*[F.col(n) for n in names if n in has], F.lit(0))
    base, actual = pick("baseline_tokens", "raw_tokens"), pick("actual_tokens", "final_tokens")
    return log.select("ts", (F.coalesce("op", F.lit("generate")) if "op" in has else F.lit("generate")).alias("op"), base.alias("baseline"), actual.alias("actual"), F.greatest(F.lit(0), base - actual).alias("saved"))


def share(part: Column, whole: Column) -> Column:
    """Percent with one digit, 0 of nothing, within 0 and 100."""
    return F.when(whole > 0, F.least(F.lit(100.0), F.greatest(F.lit(0.0), T.half_up(part * 100 / whole, 1)))).otherwise(0.0)


SUMS = (F.count, F.sum)


def sums() -> list[Column]:
    return [F.count(F.lit(1)).alias("runs"), F.sum("baseline").alias("baseline"), F.sum("actual").alias("actual"), F.sum("saved").alias("saved")]


def totals(u: DataFrame, price: float = PRICES["default"]) -> DataFrame:
    return u.agg(*sums()).withColumn("saved_pct", share(F.col("saved"), F.col("baseline"))).withColumn("usd", T.half_up(F.col("saved") * price / 1e6, 4))


def by_op(u: DataFrame) -> DataFrame:
    """Per operation, with its share of all that was saved."""
    g = u.groupBy("op").agg(*sums())
    return g.withColumn("saved_pct", share(F.col("saved"), F.col("baseline"))).withColumn("share_pct", share(F.col("saved"), F.sum("saved").over(Window.partitionBy())))


def bucket(ts: Column, unit: str) -> Column:
    return F.date_format(F.date_trunc(unit, ts), "yyyy-MM" if unit == "MONTH" else "yyyy-MM-dd")


def by_time(u: DataFrame, unit: str) -> DataFrame:
    """Per UTC day, week from Monday, or month."""
    return u.groupBy(bucket(F.col("ts"), unit.upper()).alias("bucket")).agg(*sums()).withColumn("saved_pct", share(F.col("saved"), F.col("baseline")))


def all_buckets(u: DataFrame) -> DataFrame:
    """unit, bucket and sums for days, weeks and months from one scan."""
    b = u.select(*[bucket(F.col("ts"), x).alias(x.lower()) for x in ("DAY", "WEEK", "MONTH")], "baseline", "actual", "saved")
    g = b.groupingSets([["day"], ["week"], ["month"]], "day", "week", "month").agg(*sums())
    return g.select(F.when(F.col("day").isNotNull(), "day").when(F.col("week").isNotNull(), "week").otherwise("month").alias("unit"), F.coalesce("day", "week", "month").alias("bucket"), "runs", "baseline", "actual", "saved")


def since(text: str | None, now: datetime | None = None) -> datetime | None:
    """The cutoff of `7d`, `12h`, `2w` or an ISO date; None where it can't be read."""
    if not text:
        return None
    if m := re.fullmatch(r"(\d+)([dhw])", text.strip()):
        n = int(m[1])
        return (now or datetime.now(UTC)) - {"d": timedelta(days=n), "h": timedelta(hours=n), "w": timedelta(weeks=n)}[m[2]]
    try:
        return datetime.fromisoformat(text)
    except ValueError:
        return None


def after(log: DataFrame, cutoff: datetime | str | None) -> DataFrame:
    """Rows from the cutoff on; without one, all rows, those without time too."""
    return log if cutoff is None else log.where(F.col("ts") >= F.lit(str(cutoff)).cast("timestamp"))


def log_summary(log: DataFrame, value: str, over: Column, order: str) -> DataFrame:
    """runs, mean (1 digit), least, largest, first and last by order, and how many are over budget."""
    return log.agg(
        F.count(F.lit(1)).alias("runs"), T.half_up(F.avg(value), 1).alias("mean_value"), F.min(value).alias("min_value"), F.max(value).alias("max_value"),
        F.min_by(value, order).alias("first_value"), F.max_by(value, order).alias("last_value"), F.sum(over.cast("int")).alias("n_over"),
    )


def percentiles(log: DataFrame, value: str, by: str, points: tuple[float, ...] = (0.5, 0.95)) -> DataFrame:
    return log.groupBy(by).agg(*[F.percentile(value, p).alias(f"p{round(p * 100)}") for p in points])


def tail_streak(log: DataFrame, over: Column, by: str, order: str) -> DataFrame:
    """by, streak: how many of the last rows in order are over, without a break. Two aggregates, no window over a group."""
    last = log.groupBy(by).agg(F.max(F.when(~over, F.col(order))).alias("last_ok"))
    return log.join(last, by).groupBy(by).agg(F.sum((F.col("last_ok").isNull() | (F.col(order) > F.col("last_ok"))).cast("int")).alias("streak"))


def health(s: DataFrame) -> DataFrame:
    """Score and grade of rows of days_since_regen, has_source, strategy, reduction_pct, cold_days, over_runs, runs, streak."""
    c = F.col
    rate = F.when((c("over_runs") > 0) & (c("runs") > 0), c("over_runs") * 100.0 / c("runs")).otherwise(0.0)
    lost = (
        F.when(c("days_since_regen").isNull() & c("has_source"), 45).otherwise(0)
        + F.when(c("days_since_regen") > 7, F.least(F.lit(30), F.floor((c("days_since_regen") - 7) * 4))).otherwise(0)
        + F.when((c("strategy") == "full") & (c("reduction_pct") < 60), 20).otherwise(0)
        + F.when((c("strategy") == "hot-cold") & (c("cold_days") > 1), F.least(F.lit(10), F.floor(c("cold_days") - 1) * 3)).otherwise(0)
        + F.when(rate > 20, 20).otherwise(0)
        + F.when(c("streak") >= 3, 5).otherwise(0)
    )
    score = F.greatest(F.lit(0), F.least(F.lit(100), 100 - lost)).cast("int")
    return s.withColumn("score", score).withColumn("grade", T.grade(score))
