"""Postings and ranked retrieval. All queries of a batch are ranked in one plan over one scan of the documents; only query terms, a few rows a
query, are the small side of a join, and Spark broadcasts them by their measured size."""

from __future__ import annotations

from bisect import insort
from collections.abc import Iterator
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources.durable import cut
from . import counted

#: Query terms that tasks look for themselves; with more, all postings are joined with them.
MOST_TERMS = 20_000
#: Terms x queries whose weights a task holds as numbers, and documents that it scores at once.
MOST_CELLS, SCORED = 8_000_000, 512
K1, B, PATH_WEIGHT, SYNONYM = 1.5, 0.75, 3, 0.15
GROUPS = [
    "auth authenticate authentication credential login signin", "access authorization authorize permission", "config configuration options settings",
    "database db", "context ctx", "req request", "res response", "err error", "message msg", "init initialization initialize setup",
    "async asynchronous", "sync synchronize synchronous", "repo repository", "impl implementation", "helper util utility", "argument param parameter",
    "fn func function", "btn button", "calc calculate calculation", "gen generate generator", "val validate validation", "del delete remove",
    "dir directory folder", "env environment", "doc document documentation", "id identifier", "num number", "str string",
]


def postings(docs: DataFrame, key: str, text: Column, path: Column | None = None) -> DataFrame:
    """key, token, tf, doc_len. Tokens of a path count PATH_WEIGHT times."""
    return counted.postings(docs, key, text, path, PATH_WEIGHT).select(key, "token", "tf", "doc_len")


def asked_postings(docs: DataFrame, key: str, text: Column, terms: DataFrame, path: Column | None = None) -> DataFrame:
    """key, token, doc_len, tf of the tokens among terms (token), and a row of each document with a null token, whose tf is the rows it had: a
    written table, made in one scan."""
    known = terms.select(F.col("token").alias("asked")).distinct()
    asked = [r.asked for r in known.limit(MOST_TERMS + 1).collect()]
    if len(asked) <= MOST_TERMS:
        return cut(counted.postings(docs, key, text, path, PATH_WEIGHT, asked, True))
    d = counted.postings(docs, key, text, path, PATH_WEIGHT, None, True)
    return cut(d.join(known, d["token"] == known["asked"], "left").where("token IS NULL OR asked IS NOT NULL").drop("asked"))


def query_terms(queries: DataFrame, key: str, text: Column, expand: bool = False) -> DataFrame:
    """key, token, w: each distinct term once with weight 1; synonyms with SYNONYM unless they are terms themselves."""
    q = queries.select(key, F.explode(F.array_distinct(T.index_tokens(text))).alias("token")).withColumn("w", F.lit(1.0))
    if not expand:
        return q
    spark = queries.sparkSession
    g = spark.createDataFrame([(i, w) for i, ws in enumerate(GROUPS) for w in ws.split()], "g int, w string").select("g", T.stem(F.col("w")).alias("t")).distinct()
    syn = g.join(g.withColumnRenamed("t", "other"), "g").where("t <> other").select("t", "other").distinct()
    more = q.join(syn, q.token == syn.t).select(key, F.col("other").alias("token"), F.lit(SYNONYM).alias("w"))
    return q.unionByName(more).groupBy(key, "token").agg(F.max("w").alias("w"))


def bm25(docs: DataFrame, doc_key: str, text: Column, queries: DataFrame, query_key: str, query_text: Column, expand: bool = False, path: Column | None = None) -> DataFrame:
    """query_key, doc_key, score for every document with a term of the query."""
    terms = cut(query_terms(queries, query_key, query_text, expand))
    post = asked_postings(docs, doc_key, text, terms, path)
    stats = post.where("token IS NULL").agg(F.sum("tf").alias("N"), (F.sum("doc_len") / F.sum("tf")).alias("avgdl"))
    post = post.where("token IS NOT NULL")
    df = post.groupBy("token").agg(F.count(F.lit(1)).alias("df"))
    s = post.where(F.col(doc_key).isNotNull()).join(terms.join(df, "token"), "token").join(F.broadcast(stats))  # one row
    idf = F.log(1 + (F.col("N") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = F.col("w") * idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("doc_len") / F.coalesce(F.nullif("avgdl", F.lit(0.0)), F.lit(1.0))))
    return s.groupBy(query_key, doc_key).agg(F.sum(part).alias("score"))


def without_words(queries: DataFrame, query_key: str, query_text: Column, docs: DataFrame, doc_key: str, size: Column, k: int) -> DataFrame:
    """query_key, doc_key, score for queries that have no word to look for: the k documents with the largest size, ties by key; size is the score."""
    empty = queries.where(F.size(T.ranker_tokens(query_text)) == 0).select(query_key)
    best = docs.select(doc_key, size.cast("double").alias("score")).orderBy(F.col("score").desc(), doc_key).limit(k)
    return empty.join(F.broadcast(best)).select(query_key, doc_key, "score")  # k rows


def top_k(scores: DataFrame, query_key: str, doc_key: str, k: int, score: str = "score", digits: int = 6) -> DataFrame:
    """The k best of each query with their rank; ties by document."""
    w = Window.partitionBy(query_key).orderBy(F.round(F.col(score), digits).desc(), doc_key)
    return scores.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def rounded(x: float, digits: int) -> Decimal:
    """As Spark's round."""
    return Decimal(repr(x)).quantize(Decimal(1).scaleb(-digits), ROUND_HALF_UP)


def best(docs: DataFrame, doc_key: str, text: Column, queries: DataFrame, query_key: str, query_text: Column, k: int, expand: bool = False, path: Column | None = None, digits: int = 6) -> DataFrame:
    """top_k of bm25: query_key, doc_key, score, rank. Each task scores its documents against all queries and sends on the k best of each query,
    so that pairs of document and query never become rows. With more than MOST_TERMS terms, or MOST_CELLS terms x queries, it is top_k of bm25."""
    terms = cut(query_terms(queries, query_key, query_text, expand).where(F.col(query_key).isNotNull()).groupBy(query_key, "token").agg(F.max("w").alias("w")))
    n_terms, n_queries = terms.agg(F.count_distinct("token"), F.count_distinct(query_key)).first()
    if n_terms > MOST_TERMS or n_terms * n_queries > MOST_CELLS:
        return top_k(bm25(docs, doc_key, text, queries, query_key, query_text, expand, path), query_key, doc_key, k, digits=digits)
    asked = terms.collect()
    names, ids = sorted({r.token for r in asked}), sorted({r[query_key] for r in asked})
    at, of = {t: i for i, t in enumerate(names)}, {q: i for i, q in enumerate(ids)}
    weight = np.zeros((len(names), len(ids)))
    for r in asked:
        weight[at[r.token], of[r[query_key]]] = r.w
    d = cut(counted.found(docs, doc_key, text, at, path, PATH_WEIGHT))
    total, length = d.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("doc_len"), F.lit(0))).first()
    df = np.zeros(len(names))
    for t, n in d.select(F.explode("at").alias("t")).groupBy("t").agg(F.count(F.lit(1)).alias("n")).collect():
        df[t] = n
    weight *= np.log(1 + (total - df + 0.5) / (df + 0.5))[:, None] * (K1 + 1)
    scale = length / total if length else 1.0
    place = docs.sparkSession.createDataFrame(list(enumerate(ids)), f"at int, `{query_key}` {queries.schema[query_key].dataType.simpleString()}")
    shared = docs.sparkSession.sparkContext.broadcast(weight)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = shared.value
        kept: list[list[tuple]] = [[] for _ in range(w.shape[1])]  # of a query: (less the rounded score, key, score), sorted
        least = np.zeros(w.shape[1])
        key_type = None
        for b in batches:
            key_type = b.schema.field(0).type
            for start in range(0, b.num_rows, SCORED):
                part = b.slice(start, SCORED)
                keys = part.column(0).to_pylist()
                scores = np.zeros((len(keys), w.shape[1]))
                for i, (t, tf, size) in enumerate(zip(part.column(1), part.column(2), part.column(3).to_pylist(), strict=True)):
                    if len(t.values) and keys[i] is not None:
                        f = tf.values.to_numpy()
                        scores[i] = (f / (f + K1 * (1 - B + B * size / scale))) @ w[t.values.to_numpy()]
                floor = least if len(keys) < k else np.maximum(least, np.partition(scores, -k, axis=0)[-k])
                for i, q in np.argwhere((scores > 0) & (scores >= floor - 3 * 10.0**-digits)):
                    s = float(scores[i, q])
                    insort(kept[q], (-rounded(s, digits), keys[i], s))
                    if len(kept[q]) > k:
                        kept[q].pop()
                    if len(kept[q]) == k:
                        least[q] = float(-kept[q][-1][0])
        found = [(q, key, s) for q, xs in enumerate(kept) for _, key, s in xs]
        if found:
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in found], pa.int32()), pa.array([x[1] for x in found], key_type), pa.array([x[2] for x in found], pa.float64())], names=["at", doc_key, "score"])

    s = d.select(doc_key, "at", "tf", "doc_len").mapInArrow(run, f"at int, `{doc_key}` {d.schema[doc_key].dataType.simpleString()}, score double")
    return top_k(s.join(F.broadcast(place), "at").select(query_key, doc_key, "score"), query_key, doc_key, k, digits=digits)


def confident(scores: DataFrame, query_key: str, score: str = "score") -> DataFrame:
    """scores with confidence, by the position between the least and the largest score of all rows of the query."""
    w = Window.partitionBy(query_key)
    low, high = F.min(score).over(w), F.max(score).over(w)
    at = F.when(high > low, (F.col(score) - low) / (high - low)).otherwise(1.0)
    label = F.when(F.col(score) <= 0, "low").when(at > 0.66, "high").when(at > 0.33, "medium").otherwise("low")
    return scores.withColumn("confidence", label)


def boosted(scores: DataFrame, doc_key: str, multiplier: DataFrame | None = None, recent: DataFrame | None = None, session: DataFrame | None = None) -> DataFrame:
    """scores x learned multipliers (doc_key, mult), x 1.5 for recent documents (doc_key), + session boosts (doc_key, boost). Rows
    without score stay without, but for the session's."""
    s, positive = scores, F.col("score") > 0
    if recent is not None:
        s = s.join(recent.select(doc_key).distinct().withColumn("recent", F.lit(1.5)), doc_key, "left")
        s = s.withColumn("score", F.when(positive, F.col("score") * F.coalesce("recent", F.lit(1.0))).otherwise(F.col("score"))).drop("recent")
    if multiplier is not None:
        s = s.join(multiplier, doc_key, "left").withColumn("score", F.when(positive, F.col("score") * F.coalesce("mult", F.lit(1.0))).otherwise(F.col("score"))).drop("mult")
    if session is not None:
        s = s.join(session, doc_key, "left").withColumn("score", F.col("score") + F.coalesce("boost", F.lit(0.0))).drop("boost")
    return s
