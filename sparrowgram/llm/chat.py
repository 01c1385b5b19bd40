"""Chat formatting with offset-aligned loss masks.

A conversation is rendered whole, encoded once with offsets, and its sorted turn spans are laid on the sorted token spans by binary
search: a token bears loss where it meets the text of a turn of a trained role.

    <|im_start|>role<|im_sep|>text<|im_end|>

The three marks are special tokens, so no token crosses the border of a text. Inside roles and texts every `<` that only
backslashes part from a `|` gets one more backslash, which unescape() takes away again; so no mark can arise from a text.

Encoding is that of the library with the marks as special tokens: a piece of the splitting pattern goes through the library's merges
when it is first met, and its ids and the steps of its offsets are kept.

Turns of a conversation are sorted by turn, then role, then text. A conversation is one row, rendered and encoded whole, unless its turn
numbers reach over several blocks of BLOCK (or are null or negative): then each block is a row, with offsets from its own start. As marks part
tokens, the blocks' tokens in order are those of the whole. So a conversation that holds a third of all rows spreads over many tasks, and no row
grows without bound.

Defined results: null role or text is empty; a null turn comes first; rows with a null conv_id are one conversation; repeated rows are
turns of their own; very long texts are encoded whole; empty tables give empty results; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache
from itertools import groupby

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import batch, cut, narrowed
from .packing import MEMO, tokenizer

START, SEP, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>"
BLOCK = 4096
TRAINED = ("assistant",)
ESCAPE, UNESCAPE = re.compile(r"<(\\*)\|"), re.compile(r"<\\(\\*)\|")
TURN = re.compile(re.escape(START) + "(.*?)" + re.escape(SEP) + "(.*?)" + re.escape(END), re.S)
ROWS = "conv_id long, block long, text string, ids array<int>, starts array<int>, ends array<int>, mask array<boolean>"


def escape(text: str) -> str:
    return ESCAPE.sub(r"<\\\1|", text)


def unescape(text: str) -> str:
    return UNESCAPE.sub(r"<\1|", text)


def render(turns: list[tuple[str, str]], trained: tuple[str, ...] = TRAINED) -> tuple[str, list[tuple[int, int]]]:
    """The text, and the spans of the texts that bear loss, in order."""
    out, at, spans = [], 0, []
    for role, text in turns:
        head, body = f"{START}{escape(role)}{SEP}", escape(text)
        out += [head, body, END]
        if role in trained and body:
            spans.append((at + len(head), at + len(head) + len(body)))
        at += len(head) + len(body) + len(END)
    return "".join(out), spans


class OffsetTokenizer(dict):
    """By piece: its ids, and for each token the signs of the text that begin and that end in it, packed."""

    def __init__(self, path: str):
        self.base = tokenizer(path)
        # the library numbers new special tokens after all others
        first = 1 + max([*self.base.special.values(), self.base.last_id])
        self.special = self.base.special | {m: first + i for i, m in enumerate((START, SEP, END))}
        self.marks = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")")

    def __missing__(self, piece: str) -> tuple[bytes, bytes, bytes]:
        base = self.base
        tokens = base.merge("".join(map(base.signs.__getitem__, piece.encode())))
        ids, size = array("i", [t.id for t in tokens]), [len(t.value) for t in tokens]
        if len(piece) == sum(size):
            begun = done = array("i", size)
        else:
            ends = np.cumsum(size)
            first = np.cumsum([len(c.encode()) for c in piece])  # where each sign ends
            done = np.searchsorted(first, ends, "right")
            begun = np.searchsorted(first, ends - 1, "right") + 1
            begun, done = (array("i", np.diff(x, prepend=0).tolist()) for x in (begun, done))
        got = ids.tobytes(), begun.tobytes(), done.tobytes()
        if len(piece) <= 64:
            self[piece] = got
        return got

    def encode(self, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """ids, starts, ends; offsets are code points of text."""
        found = []
        if len(self) > MEMO:
            self.clear()
        for part in self.marks.split(text):
            if part in self.special:
                n = array("i", [len(part)]).tobytes()
                found.append((array("i", [self.special[part]]).tobytes(), n, n))
            elif part:
                found += map(self.__getitem__, self.base.pieces(part))
        ids, begun, done = (np.frombuffer(b"".join(x), np.int32) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int32),) * 3
        return ids, np.cumsum(done, dtype=np.int32) - done, np.cumsum(begun, dtype=np.int32)


@lru_cache(maxsize=2)
def encoder(path: str) -> OffsetTokenizer:
    return OffsetTokenizer(path)


def loss_mask(starts: np.ndarray, ends: np.ndarray, spans: list[tuple[int, int]]) -> np.ndarray:
    """Of tokens sorted by offset: whether each meets a span. Two binary searches a span."""
    mask = np.zeros(len(starts), bool)
    if spans:
        a, b = np.asarray(spans).T
        for first, last in zip(np.searchsorted(ends, a, "right"), np.searchsorted(starts, b, "left"), strict=True):
            mask[first:last] = True
    return mask


def read_back(text: str, starts: np.ndarray, ends: np.ndarray, mask: np.ndarray) -> tuple[list[tuple[str, str]], str]:
    """Turns, and the text under the mask, of one output row."""
    turns = [(unescape(a), unescape(b)) for a, b in TURN.findall(text)]
    edges = np.flatnonzero(np.diff(np.concatenate([[0], mask.astype(np.int8), [0]])))
    return turns, "".join(unescape(text[starts[i] : ends[j - 1]]) for i, j in zip(edges[::2], edges[1::2], strict=True))


def listed(parts: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    """A list column of arrays."""
    at = np.concatenate([[0], np.cumsum([len(x) for x in parts])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(at), pa.array(np.concatenate(parts), kind))


def sliced(column: pa.Array) -> list[np.ndarray]:
    """The rows of a list column as arrays, without a Python value for each item."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    at = np.concatenate([[0], np.cumsum(pc.list_value_length(column).to_numpy())])
    return [flat[i:j] for i, j in zip(at[:-1], at[1:], strict=True)]


def stream(batches: Iterator[pa.RecordBatch], *columns: str) -> Iterator[tuple]:
    for b in batches:
        yield from zip(*(b.column(c).to_pylist() for c in columns), strict=True)


def format_conversations(turns: DataFrame, path: str, trained: tuple[str, ...] = TRAINED, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", block: int = BLOCK) -> DataFrame:
    """A row for each block of each conversation: conv_id, block, text, ids, starts, ends, mask. starts and ends are code points of text."""
    t = narrowed(turns, conv_id=conv, turn=turn, role=role, text=text).withColumns({"role": F.coalesce("role", F.lit("")), "text": F.coalesce("text", F.lit(""))})
    t = t.withColumn("block", blocks(t, "turn", block))
    t = t.repartition("conv_id", "block").sortWithinPartitions("conv_id", "block", "turn", "role", "text")
    schema = pa.schema([("conv_id", pa.int64()), ("block", pa.int64()), ("text", pa.string()), ("ids", pa.list_(pa.int32())), ("starts", pa.list_(pa.int32())), ("ends", pa.list_(pa.int32())), ("mask", pa.list_(pa.bool_()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e, rows, size = encoder(path), [], 0

        def out() -> pa.RecordBatch:
            conv, k, texts, ids, starts, ends, masks = zip(*rows, strict=True)
            return batch(schema, list(conv), list(k), list(texts), listed(ids, pa.int32()), listed(starts, pa.int32()), listed(ends, pa.int32()), listed(masks, pa.bool_()))

        for (conv_id, k), group in groupby(stream(batches, "conv_id", "block", "role", "text"), key=lambda r: r[:2]):
            whole, spans = render([r[2:] for r in group], trained)
            ids, starts, ends = e.encode(whole)
            rows.append((conv_id, k, whole, ids, starts, ends, loss_mask(starts, ends, spans)))
            size += len(whole)
            if size > 1 << 20:
                yield out()
                rows, size = [], 0
        if rows:
            yield out()

    return t.mapInArrow(run, ROWS)


def blocks(turns: DataFrame, turn: str, block: int) -> Column:
    return F.coalesce(F.floor(F.col(turn) / block), F.lit(-(1 << 40))).cast("long")


def conversation_digests(turns: DataFrame, path: str, trained: tuple[str, ...] = TRAINED, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", block: int = BLOCK) -> DataFrame:
    """digests() of format_conversations(): conversations of one block are formatted and read back in the same task; only rows of others are
    shuffled once more."""
    t = narrowed(turns, conv_id=conv, turn=turn, role=role, text=text)
    several = cut(t.where(blocks(t, "turn", block) != 0).select("conv_id").distinct().withColumnRenamed("conv_id", "long_id"), "long-conversations")
    if several.isEmpty():
        return digests(format_conversations(t, path, trained, block=block), True)
    same = F.col("conv_id").eqNullSafe(F.col("long_id"))
    one, more = t.join(several, same, "left_anti"), t.join(several, same, "left_semi")
    return digests(format_conversations(one, path, trained, block=block), True).unionByName(digests(format_conversations(more, path, trained, block=block)))


def digests(formatted: DataFrame, together: bool = False) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, read back from the output rows as a sorted stream. together: the
    rows of a conversation already follow each other in one partition."""
    schema = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])
    d = formatted.select("conv_id", "block", "text", "starts", "ends", "mask")
    if not together:
        d = d.repartition("conv_id").sortWithinPartitions("conv_id", "block")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = []
        parts = (r for b in batches for r in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), *map(sliced, (b.column(i) for i in (3, 4, 5))), strict=True))
        for conv_id, group in groupby(parts, key=lambda r: r[0]):
            n = loss_chars = chars = 0
            of_turns, of_loss = hashlib.sha256(), hashlib.sha256()
            for _, text, starts, ends, mask in group:
                turns, loss = read_back(text, starts, ends, mask)
                for role, body in turns:
                    of_turns.update(f"{role}\n{body}\n".encode())
                of_loss.update(loss.encode())
                n, loss_chars, chars = n + len(turns), loss_chars + len(loss), chars + len(text)
            rows.append((conv_id, n, of_turns.hexdigest(), loss_chars, of_loss.hexdigest(), chars))
            if len(rows) == 4096:
                yield batch(schema, *map(list, zip(*rows, strict=True)))
                rows = []
        if rows:
            yield batch(schema, *map(list, zip(*rows, strict=True)))

    return d.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
