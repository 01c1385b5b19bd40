"""Best-two-fit packing of tokenised documents into sequences of a fixed length.

A bin is filled greedily, longest first. When nothing fits any more, its smallest piece is exchanged for two unpacked
pieces that fit the gap so made more tightly.

Pieces of equal length are interchangeable, so bins are planned on the counts by length alone: at most `size` numbers,
whatever the corpus. A bin's recipe is repeated until one of its lengths runs out, so there are few recipes. The plan
and the counts by (bucket, length), at most MOST_BUCKETS * size, are all that is ever broadcast or sent to the driver.
A piece finds its place by its rank among the pieces of its length: its rank within its bucket and the counts of
the buckets before it.

Defined results: null is the empty text, whose one piece is the end token; a text longer than a sequence is cut into
whole sequences, its first piece taking the remainder; repeated rows are separate documents; empty tables give
empty results; further columns are ignored.
"""

from __future__ import annotations

import json
import zlib
from array import array
from collections import Counter
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_map, batch, cut, narrowed, partitions
from .token_counts import byte_signs

MEMO = 1_000_000
MOST_BUCKETS = 256
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def check_rules(path: str) -> None:
    """Raises where the vocabulary file names other rules than PATTERN stands for: they would give other ids."""
    with open(path, encoding="utf-8") as f:
        rules = json.load(f)
    splitter, model = rules.get("pre_tokenizer") or {}, rules["model"]
    plain = splitter.get("type") == "ByteLevel" and splitter.get("use_regex", True) and not splitter.get("add_prefix_space")
    if rules.get("normalizer") or not plain or model.get("type") != "BPE" or model.get("dropout") or any(t.get("single_word") or t.get("lstrip") or t.get("rstrip") for t in rules.get("added_tokens", [])):
        raise ValueError(f"{path}: this normaliser or splitting rule isn't supported")


class PieceTokenizer(dict):
    """Packed ids by piece of the pattern: each new piece goes through the library's merges once."""

    def __init__(self, path: str):
        import re

        from tokenizers import Tokenizer

        check_rules(path)
        library = Tokenizer.from_file(path)
        self.merge, self.last_id = library.model.tokenize, library.get_vocab_size(with_added_tokens=True) - 1
        self.signs = byte_signs()
        self.special = {t.content: i for i, t in library.get_added_tokens_decoder().items()}
        self.marks = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        self.pattern = regex.compile(PATTERN)
        self.ascii = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z]+| ?[0-9]+| ?[^\sA-Za-z0-9]+|\s+(?!\S)|\s+", re.ASCII)
        self.odd = re.compile(r"[\x1c-\x1f]")

    def __missing__(self, piece: str) -> bytes:
        signs = "".join(map(self.signs.__getitem__, piece.encode()))
        ids = array("I", [t.id for t in self.merge(signs)]).tobytes()
        if len(piece) <= 64:
            self[piece] = ids
        return ids

    def encode(self, text: str | None) -> bytes:
        if not text:
            return b""
        out = []
        for part in self.marks.split(text) if self.marks else [text]:
            if part in self.special:
                out.append(array("I", [self.special[part]]).tobytes())
            elif part:
                if len(self) > MEMO:
                    self.clear()
                out.append(b"".join(map(self.__getitem__, self.pieces(part))))
        return b"".join(out)

    def pieces(self, part: str) -> list[str]:
        return (self.ascii if part.isascii() and not self.odd.search(part) else self.pattern).findall(part)


@lru_cache(maxsize=2)
def tokenizer(path: str) -> PieceTokenizer:
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return PieceTokenizer(path)


def cuts(n: int, size: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document of n tokens; the first may be shorter."""
    first = n % size or min(n, size)
    return [(0, first), *((s, size) for s in range(first, n, size))]


def token_pieces(docs: DataFrame, path: str, size: int, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 for each piece of each row of docs."""
    schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])
    end = np.asarray([end_id], "<u4").tobytes()

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        t = tokenizer(path)
        rows: tuple[list, ...] = ([], [], [], [], [])
        for doc, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
            ids = memoryview(t.encode(text.as_py()) + end)
            for k, (start, n) in enumerate(cuts(len(ids) // 4, size)):
                for r, v in zip(rows, (doc, k, start, n, zlib.crc32(ids[4 * start : 4 * (start + n)])), strict=True):
                    r.append(v)
        return batch(schema, *rows)

    return arrow_map(narrowed(docs, doc_id=id_col, text=text_col), run, PIECES)


def best_two_fit(counts: dict[int, int], size: int) -> list[tuple[list[int], int]]:
    """[(lengths in a bin, how many such bins)] that use up counts exactly."""
    left = Counter({k: v for k, v in counts.items() if v})
    if any(not 0 < k <= size for k in left):
        raise ValueError(f"lengths must be from 1 to {size}")
    plan = []
    lengths = sorted(left, reverse=True)
    while lengths:
        used: Counter = Counter()
        gap, bin_ = size, []
        while True:
            k = next((x for x in lengths if x <= gap and left[x] > used[x]), None)
            if k is None:
                break
            n = min(left[k] - used[k], gap // k)
            bin_ += [k] * n
            used[k] += n
            gap -= k * n
        if gap and bin_:
            small = bin_[-1]
            used[small] -= 1
            room = gap + small
            best: tuple[int, int] | None = None
            free = {x for x in lengths if left[x] > used[x] and x < room}
            for total in range(room, small, -1):
                best = next(((a, total - a) for a in sorted(free, reverse=True) if 2 * a >= total and total - a in free and (2 * a != total or left[a] - used[a] > 1)), None)
                if best:
                    break
            # the exchanged piece itself may be one of the two only if another of its length is free
            if best:
                bin_ = [*bin_[:-1], *best]
                used[best[0]] += 1
                used[best[1]] += 1
            else:
                used[small] += 1
        used += Counter()
        times = min(left[k] // n for k, n in used.items())
        plan.append((bin_, times))
        for k, n in used.items():
            left[k] -= n * times
        lengths = [x for x in lengths if left[x]]
    return plan


def places(plan: list[tuple[list[int], int]]) -> dict[int, tuple[np.ndarray, ...]]:
    """By length: (first rank, first bin, pieces a bin, offsets' place in a flat array, flat offsets) of each recipe in turn."""
    rows: dict[int, list] = {}
    first_bin = 0
    ranks: Counter = Counter()
    for bin_, times in plan:
        at, offsets = 0, {}
        for k in bin_:
            offsets.setdefault(k, []).append(at)
            at += k
        for k, o in offsets.items():
            rows.setdefault(k, []).append((ranks[k], first_bin, o))
            ranks[k] += len(o) * times
        first_bin += times
    out = {}
    for k, r in rows.items():
        flat = [x for _, _, o in r for x in o]
        starts = np.cumsum([0, *(len(o) for _, _, o in r)])[:-1]
        out[k] = (np.array([x[0] for x in r]), np.array([x[1] for x in r]), np.array([len(x[2]) for x in r]), starts, np.array(flat))
    return out


def pack(pieces: DataFrame, size: int) -> DataFrame:
    """pieces (doc_id, piece, start, length, ids_crc32) with sequence_id and offset. pieces must be a written table."""
    spark = pieces.sparkSession
    buckets = max(1, min(MOST_BUCKETS, partitions(spark)))
    # a piece as long as a sequence is one: it needs no rank
    full = pieces.where(F.col("length") == size).withColumn("sequence_id", -1 - F.monotonically_increasing_id()).withColumn("offset", F.lit(0).cast("long"))
    part = pieces.where(F.col("length") < size).withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(buckets)).cast("int"))
    counts = part.groupBy("length", "bucket").count().toArrow()  # at most MOST_BUCKETS * size rows
    table = np.zeros((size + 1, buckets + 1), np.int64)
    table[counts.column("length").to_numpy(), counts.column("bucket").to_numpy() + 1] = counts.column("count").to_numpy()
    before = np.cumsum(table, axis=1)
    where = places(best_two_fit({k: int(n) for k, n in enumerate(before[:, -1]) if n}, size))
    shipped = spark.sparkContext.broadcast((before[:, :-1], where))
    schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())])

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        before, where = shipped.value
        length, bucket, rank = (b.column(n).to_numpy() for n in ("length", "bucket", "rank"))
        rank = before[length, bucket] + rank - 1
        seq, off = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
        for k in np.unique(length):
            at = np.flatnonzero(length == k)
            first, bin_, many, flat_at, flat = where[int(k)]
            r = np.searchsorted(first, rank[at], "right") - 1
            rest = rank[at] - first[r]
            seq[at] = bin_[r] + rest // many[r]
            off[at] = flat[flat_at[r] + rest % many[r]]
        return batch(schema, *(b.column(n) for n in ("doc_id", "piece", "start", "length", "ids_crc32")), seq, off)

    w = Window.partitionBy("bucket", "length").orderBy("doc_id", "piece", "ids_crc32")
    ranked = part.withColumn("rank", F.row_number().over(w).cast("long"))
    packed = arrow_map(ranked, run, PIECES + ", sequence_id long, offset long")
    return packed.unionByName(full)


def pack_documents(docs: DataFrame, path: str, size: int = 1024, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset for each piece of docs. Texts are encoded once; what is
    written in between has a few numbers a piece."""
    return pack(cut(token_pieces(docs, path, size, end_id, id_col, text_col), "token-pieces"), size)
