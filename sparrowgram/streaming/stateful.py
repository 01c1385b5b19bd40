"""Live state by Structured Streaming: an index that follows changes, sessions that expire, weights that fade."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from ..sources.durable import cut


def latest(changes: DataFrame) -> DataFrame:
    """path, seq, sigs of the last change of each path in (path, seq, op, sigs); paths whose last change is a delete are left out. append adds
    signatures that aren't there."""
    last_set = changes.where("op <> 'append'").groupBy("path").agg(F.max_by(F.struct("seq", "op", "sigs"), "seq").alias("s"))
    more = changes.where("op = 'append'").join(last_set, "path", "left").where("s IS NULL OR seq > s.seq").groupBy("path").agg(F.array_sort(F.collect_list(F.struct("seq", "sigs"))).alias("a"), F.max("seq").alias("aseq"))
    none = F.expr("CAST(array() AS array<string>)")
    j = last_set.join(more, "path", "full")
    base = F.when(F.col("s.op") == "delete", none).otherwise(F.coalesce("s.sigs", none))
    added = F.coalesce(F.flatten(F.transform("a", lambda x: x["sigs"])), none)
    return j.where("s IS NULL OR s.op <> 'delete' OR a IS NOT NULL").select("path", F.greatest("s.seq", "aseq").alias("seq"), F.array_distinct(F.concat(base, added)).alias("sigs"))


def follow(changes: DataFrame, at: str, checkpoint: str) -> DataStreamWriter:
    """Each micro-batch is folded into a new version of the table under `at`; a version is whole before its number is used, and a batch that is
    tried again writes the same version."""

    def fold(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        rows = batch.select("path", "seq", "op", "sigs")
        if number:
            old = spark.read.parquet(f"{at}/v{number - 1}").select("path", "seq", F.lit("upsert").alias("op"), "sigs")
            rows = rows.unionByName(old)
        latest(rows).write.mode("overwrite").parquet(f"{at}/v{number}")

    return changes.writeStream.foreachBatch(fold).option("checkpointLocation", checkpoint)


def tumbling(log: DataFrame, size: str = "1 day", late: str = "1 hour") -> DataFrame:
    """bucket, op and sums of a usage stream by event time, with a bound for late rows."""
    return log.withWatermark("ts", late).groupBy(F.window("ts", size).alias("w"), "op").agg(F.count(F.lit(1)).alias("runs"), F.sum("saved").alias("saved")).select(F.col("w.start").alias("bucket"), "op", "runs", "saved")


def sessions(events: DataFrame, ttl: str = "4 hours", late: str = "1 hour") -> DataFrame:
    """session_id, ended, intent, last_query, n of (session_id, ts, intent, query), batch or stream: a session that is silent for the time to live
    is closed, and its state is dropped once the watermark passes; the next event opens another."""
    e = events.withWatermark("ts", late) if events.isStreaming else events
    g = e.groupBy(F.session_window("ts", ttl).alias("w"), "session_id").agg(F.max_by("intent", "ts").alias("intent"), F.max_by("query", "ts").alias("last_query"), F.count(F.lit(1)).alias("n"))
    return g.select("session_id", F.col("w.end").alias("ended"), "intent", "last_query", "n")


def session_boost(ranked: DataFrame, session: DataFrame) -> DataFrame:
    """ranked (path, intent, score) + 0.20 for files of a session (path, intent) of the same intent, 0.10 of another."""
    s = session.groupBy("path").agg(F.first("intent").alias("session_intent"))
    boost = F.when(F.col("session_intent").isNull(), 0.0).when(F.col("session_intent") == F.col("intent"), 0.20).otherwise(0.10)
    return ranked.join(s, "path", "left").withColumn("score", F.col("score") + boost).drop("session_intent")


def numbered(rows: DataFrame, *order: str) -> DataFrame:
    """rows with at: their number from 0 in order, over all rows, without bringing them together: ranges are numbered within, and begin after
    those before them."""
    r = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    r = cut(r.withColumn("_id", F.monotonically_increasing_id()).withColumn("_part", F.shiftrightunsigned("_id", 33)).withColumn("_n", F.col("_id").bitwiseAND((1 << 33) - 1)))
    size = r.groupBy("_part").agg(F.count(F.lit(1)).alias("_size"))  # a row for each partition
    before = size.withColumn("_before", F.coalesce(F.sum("_size").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return r.join(F.broadcast(before.select("_part", "_before")), "_part").withColumn("at", F.col("_before") + F.col("_n")).drop("_id", "_part", "_n", "_before")


def folded_weights(updates: DataFrame, key: str, order: str, delta: str, decay: float = 0.95, low: float = 0.30, high: float = 3.0) -> DataFrame:
    """key, weight after all updates (key, order, delta) in order. Each update multiplies the weights that are there by decay, whosever it is, then adds
    delta to that of its key, which is 1 where it isn't there; weights stay within bounds, have 6 digits, and one of 1 is dropped.

    The updates of others only count by their number, so each key is a stream of its own updates with their numbers among all, and holds one
    weight. A weight reaches the lower bound after few decays, so a long silence costs no more than a short one."""
    schema = f"{key} {dict(updates.dtypes)[key]}, weight double"
    all_ = numbered(updates.select(F.col(key), F.col(order), F.col(delta).cast("double").alias("_delta")), order, key)
    total = all_.count()
    names = [key, "at", "_delta"]

    def within(w: float) -> float:
        return high if w > high else low if w < low else math.floor(w * 1e6 + 0.5) / 1e6

    def faded(w: float, times: int) -> float:
        for _ in range(times):
            if w == 1.0 or w == low:  # not there, or at the bound
                break
            w = within(w * decay)
        return w

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, w, last = None, 1.0, 0

        def done(rows: list) -> pa.RecordBatch:
            k, ws = zip(*rows, strict=True)
            return pa.RecordBatch.from_arrays([pa.array(k, kind), pa.array(ws, pa.float64())], [key, "weight"])

        kind, rows = None, []
        for b in batches:
            kind = b.column(0).type
            for k, at, d in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                if (k,) != now:
                    if now is not None and (w := faded(w, total - 1 - last)) != 1.0:
                        rows.append((now[0], w))
                    now, w, last = (k,), 1.0, at
                w, last = within(faded(w, at - last) + d), at
            if len(rows) > 4096:
                yield done(rows)
                rows = []
        if now is not None and (w := faded(w, total - 1 - last)) != 1.0:
            rows.append((now[0], w))
        if rows:
            yield done(rows)

    return all_.select(*names).repartition(key).sortWithinPartitions(key, "at").mapInArrow(run, schema)
