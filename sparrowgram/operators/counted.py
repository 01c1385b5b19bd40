"""Stemmed words of documents, counted within each row in Python: a text is cut into words and counted by C code, and what a word's tokens are is
looked up, so that rules run once a word and worker. Gives what functions/text.py's index_tokens gives.

Rows of one key are one document. Keys that come once, as nearly all, never move; texts of the others (and of null keys) are joined, so one such
document must fit in a task."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources.durable import cut

#: Words that a worker knows, tokens that a task counts before it sends them on, and rows of a batch that it sends.
KNOWN, HELD, SENT = 1 << 19, 1 << 18, 1 << 17
PLAIN = bytes(c if chr(c).isalnum() and c < 128 else 32 for c in range(256))
PIECE = re.compile("[A-Z]+(?=[A-Z][a-z])|[A-Z]*[a-z0-9]+|[A-Z]+")
STEPS = [(re.compile(p), r) for p, r in (("ies$", "y"), ("(ss|sh|ch|x|z)es$", r"\1"), ("([^s])s$", r"\1"), ("izations?$", "ize"), (f"({T.SUFFIXES})$", ""))]
ENDS = ("s", *T.SUFFIXES.split("|"))
STOP = frozenset(T.INDEX_STOP)


def stem(w: str) -> str:
    if len(w) <= 3 or not w.endswith(ENDS):
        return w
    s = w
    for p, r in STEPS:
        s = p.sub(r, s)
    return s if len(s) >= 3 else w


class Known(dict):
    """Tokens of each word as it stands in texts."""

    def __missing__(self, word: bytes) -> tuple[str, ...]:
        if len(self) >= KNOWN:
            self.clear()
        low = [x.lower() for x in PIECE.findall(word.decode())]
        got = self[word] = tuple(stem(x) for x in low if len(x) > 1 and x not in STOP)
        return got


_known = Known()


def counts(text: bytes | None, path: bytes | None = None, weight: int = 1) -> dict[str, int]:
    """How often each token comes; those of a path weight times."""
    out: dict[str, int] = {}
    get = out.get
    for x, times in ((text, 1), (path, weight)):
        if x:
            for word, n in Counter(x.translate(PLAIN).split()).items():
                for t in _known[word]:
                    out[t] = get(t, 0) + n * times
    return out


def merged(docs: DataFrame, key: str, text: Column, path: Column | None = None) -> DataFrame:
    """key, _text, _path, _n: one row a key, and how many it had."""
    d = docs.select(key, text.cast("string").alias("_text"), (F.lit(None) if path is None else path).cast("string").alias("_path"))
    again = cut(d.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).where(F.col(key).isNull() | (F.col("_n") > 1)).select(F.col(key).alias("_again")))
    once = d.withColumn("_n", F.lit(1).cast("long"))
    if again.isEmpty():
        return once
    same = d[key].eqNullSafe(again["_again"])
    parts = [F.concat_ws("\n", F.collect_list(c)).alias(c) for c in ("_text", "_path")]
    return once.join(again, once[key].eqNullSafe(again["_again"]), "left_anti").unionByName(d.join(again, same, "left_semi").groupBy(key).agg(*parts, F.count(F.lit(1)).alias("_n")))


def rows(b: pa.RecordBatch) -> Iterable[tuple]:
    """Text, path, n."""
    return zip(b.column(1).cast(pa.binary()).to_pylist(), b.column(2).cast(pa.binary()).to_pylist(), b.column(3).to_pylist(), strict=True)


def totals(docs: DataFrame, key: str, text: Column) -> DataFrame:
    """token, n, n_docs: how often each token comes, and in how many documents with a key. Each task sends a token on once, or once for HELD of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n: dict[str, int] = {}
        n_docs: dict[str, int] = {}

        def send():
            names = list(n)
            for i in range(0, len(names), SENT):
                part = names[i : i + SENT]
                yield pa.RecordBatch.from_pydict({"token": pa.array(part, pa.string()), "n": pa.array([n[t] for t in part], pa.int64()), "n_docs": pa.array([n_docs.get(t, 0) for t in part], pa.int64())})
            n.clear()
            n_docs.clear()

        for b in batches:
            for k, (x, _, _) in zip(b.column(0).is_valid().to_pylist(), rows(b), strict=True):
                for t, times in counts(x).items():
                    n[t] = n.get(t, 0) + times
                    if k:
                        n_docs[t] = n_docs.get(t, 0) + 1
                if len(n) > HELD:
                    yield from send()
        yield from send()

    d = merged(docs, key, text)
    return d.mapInArrow(run, "token string, n long, n_docs long").groupBy("token").agg(F.sum("n").alias("n"), F.sum("n_docs").alias("n_docs"))


def postings(docs: DataFrame, key: str, text: Column, path: Column | None = None, weight: int = 1, terms: Iterable[str] | None = None, ends: bool = False) -> DataFrame:
    """key, token, doc_len, tf; only of terms, where given. ends: also a row of each document with a null token, whose tf is the rows it had."""
    wanted = None if terms is None else frozenset(terms)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, tokens, sizes, tfs = [], [], [], []

            def send(b=b):
                out = pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at, pa.int64())), pa.array(tokens, pa.string()), pa.array(sizes, pa.int32()), pa.array(tfs, pa.int64())], names=[key, "token", "doc_len", "tf"])
                for x in (at, tokens, sizes, tfs):
                    x.clear()
                return out

            for i, (x, p, n) in enumerate(rows(b)):
                c = counts(x, p, weight)
                size = sum(c.values())
                kept = list(c.items()) if wanted is None else [(t, c[t]) for t in c.keys() & wanted]
                if ends:
                    kept.append((None, n))
                at += [i] * len(kept)
                sizes += [size] * len(kept)
                tokens += [t for t, _ in kept]
                tfs += [n for _, n in kept]
                if len(at) > SENT:
                    yield send()
            yield send()

    d = merged(docs, key, text, path)
    return d.mapInArrow(run, f"`{key}` {d.schema[key].dataType.simpleString()}, token string, doc_len int, tf long")


def found(docs: DataFrame, key: str, text: Column, terms: dict[str, int], path: Column | None = None, weight: int = 1) -> DataFrame:
    """key, at, tf, doc_len, n of each document: the numbers of the terms that it has in order, how often it has each, its length, the rows it had."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, tfs, sizes = [], [], []
            for x, p, _ in rows(b):
                c = counts(x, p, weight)
                has = sorted((terms[t], c[t]) for t in c.keys() & terms.keys())
                at.append([t for t, _ in has])
                tfs.append([n for _, n in has])
                sizes.append(sum(c.values()))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(at, pa.list_(pa.int32())), pa.array(tfs, pa.list_(pa.int32())), pa.array(sizes, pa.int64()), b.column(3)], names=[key, "at", "tf", "doc_len", "n"])

    d = merged(docs, key, text, path)
    return d.mapInArrow(run, f"`{key}` {d.schema[key].dataType.simpleString()}, at array<int>, tf array<int>, doc_len long, n long")
