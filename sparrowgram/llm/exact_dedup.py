"""Exact deduplication by skew-safe combining.

Texts are equal when identical after lower-casing A-Z only; null counts as empty. Of equal texts the row
with the largest doc_id stays.

1. Each map task deduplicates locally: Spark's partial aggregate on (digest, salt, text), whose keys compare
   the whole text, leaves one row per text and task.
2. Digest groups merge on (digest, salt, text). Only hot digests, those with more than 1/1000 of all rows,
   have more than one salt; there are fewer than 1000 of them, so their broadcast has a proven bound.
3. Salt winners of the hot digests combine globally, again on (digest, text).

A digest that stands for several texts keeps them apart: its classes carry their text, and its rows are joined
on the text as well. With SHA-256 that table is empty and the step is left out.

Defined results: null text is the empty text; an empty table gives an empty result; of rows that repeat a
doc_id all count, and each is a row of the groups, but of equal ones only one is kept; a null doc_id loses to any other; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, narrowed

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A digest is hot when its rows are more than this share of all rows: fewer than HOT digests are.
HOT = 1000


def normal_text(text: Column) -> Column:
    """Lower-cases A-Z only. ASCII texts take the built-in lower, which is the same there and faster."""
    whole = F.coalesce(text, F.lit(""))
    return F.when(F.octet_length(whole) == F.length(whole), F.lower(whole)).otherwise(F.translate(whole, UPPER, LOWER))


def sha(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = 32, digest: Callable[[Column], Column] = sha) -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, digest (binary).

    digest may be any function of the text, however weak; groups are of equal texts all the same.
    """
    d = narrowed(docs, doc_id=id_col, text=text_col).withColumn("text", normal_text(F.col("text")))
    d = d.withColumn("digest", digest(F.col("text")))
    ids = cut(d.select("doc_id", "digest"), "dedup-ids")
    total = ids.count()
    ids = numbered(ids)
    hot = ids.groupBy("digest").count().where(F.col("count") * HOT > total).select("digest", F.lit(True).alias("hot"))
    salted = (
        d.join(F.broadcast(hot), "digest", "left")
        .withColumn("salt", F.when(F.col("hot"), F.pmod(F.xxhash64("doc_id"), F.lit(salts)).cast("int")).otherwise(F.lit(-1)))
        .groupBy("digest", "salt", "text")
        .agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
        .withColumn("text", F.when(F.col("salt") >= 0, F.col("text")))
    )
    salted = cut(salted, "dedup-salted")
    merged = salted.where("salt >= 0").groupBy("digest", "text").agg(F.max("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size"))
    kept = ("digest", "keep_id", "group_size")
    hot_classes, cold_classes = merged.select(*kept), salted.where("salt < 0").select(*kept)
    twins = hot_classes.unionByName(cold_classes).groupBy("digest").count().where("count > 1").select("digest")
    exact = None
    if not twins.isEmpty():
        twins = cut(twins, "dedup-twins")
        hot_classes, cold_classes, ids = (x.join(twins, "digest", "left_anti") for x in (hot_classes, cold_classes, ids))
        apart = d.join(twins, "digest", "left_semi")
        classes = apart.groupBy("digest", "text").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
        exact = apart.join(classes, ["digest", "text"])
        # equal rows among these few: a rank is enough
        again = Window.partitionBy("digest", "text", "doc_id").orderBy("keep_id")
        exact = exact.withColumn("first", F.row_number().over(again) == 1)
    hot_classes = F.broadcast(hot_classes)
    parts = [ids.join(hot_classes, "digest"), ids.join(F.broadcast(hot), "digest", "left_anti").join(cold_classes, "digest")]
    names = ("doc_id", "keep_id", "group_size", "digest", "first")
    out = None
    for part in [*parts, exact]:
        if part is not None:
            part = part.select(*names)
            out = part if out is None else out.unionByName(part)
    return out.select("doc_id", "keep_id", "group_size", (F.col("first") & F.col("doc_id").eqNullSafe(F.col("keep_id"))).alias("kept"), "digest")


def numbered(ids: DataFrame) -> DataFrame:
    """ids (doc_id, digest), a written table, with first: false for all but one of equal rows. These are alike in every column, so they are
    counted, and made again from their number, however many they are."""
    short = F.xxhash64("digest").alias("short")
    many = ids.groupBy("doc_id", short).agg(F.count(F.lit(1)).alias("rows")).where("rows > 1").select("doc_id", "short")
    many = cut(many, "dedup-repeated")
    if many.isEmpty():
        return ids.withColumn("first", F.lit(True))
    same = F.col("a.doc_id").eqNullSafe(F.col("b.doc_id")) & (F.xxhash64("a.digest") == F.col("b.short"))
    one = ids.alias("a").join(many.alias("b"), same, "left_anti").select("doc_id", "digest", F.lit(True).alias("first"))
    rows = ids.alias("a").join(many.alias("b"), same, "left_semi").groupBy("doc_id", "digest").agg(F.count(F.lit(1)).alias("rows"))
    chunk = F.lit(1 << 16)
    rows = rows.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("rows") - 1) / chunk))))
    rows = rows.withColumn("at", F.explode(F.sequence(F.col("part") * chunk, F.least((F.col("part") + 1) * chunk, F.col("rows")) - 1)))
    return one.unionByName(rows.select("doc_id", "digest", (F.col("at") == 0).alias("first")))


def keep_largest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each class of equal texts, with all its columns: that with the largest doc_id, a null one last; of rows
    that repeat it any one. The row limit of the window works within each task before the shuffle as well, so a hot text
    sends one row a task."""
    names = docs.columns
    text = normal_text(F.col(text_col))
    w = Window.partitionBy(sha(text), text).orderBy(F.col(id_col).desc_nulls_last(), text_col)
    return docs.withColumn("_dedup_rank", F.row_number().over(w)).where("_dedup_rank = 1").select(*(f"`{c}`" for c in names))
