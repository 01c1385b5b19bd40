"""Byte-level byte-pair encoding and decoding by prefix dynamic programming.

Every prefix of a piece has one valid last token (see merge_pairs), so a row holds, for each prefix, that token; the ids of
the prefix are those of the row before it and the token. Appending a byte adds one row and never changes one. Pieces
are the matches of the splitting pattern; each is encoded by itself, and a piece that is itself a token is that token.

Edit keeps the pieces of a text: after an append or an edit only pieces near the change are split and encoded again.

Defined results: null is the empty text, with no ids; empty tables give empty results; repeated rows each get a row;
whole texts, however long, are encoded; further columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
from functools import lru_cache
from itertools import accumulate

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import arrow_map, batch, narrowed
from .merge_pairs import Neighbours

MEMO = 500_000
ASCII = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z]+| ?[0-9]+| ?[^\sA-Za-z0-9]+|\s+(?!\S)|\s+", re.ASCII)
ODD = re.compile(r"[\x1c-\x1f]")


class PrefixCodec:
    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.bytes_of = {r: t for t, r in self.ranks.items()}
        self.packed = {t: r.to_bytes(4, "little") for t, r in self.ranks.items()}
        self.pattern = regex.compile(pattern)
        self.reach: dict[bytes, int] = {}
        for t in self.ranks:
            self.reach[t[-2:]] = max(self.reach.get(t[-2:], 1), len(t))
        self.split: dict[bytes, tuple[bytes, bytes] | None] = {}
        self.apart = Neighbours(lambda a, b: self.ranks.get(a + b), self.parts).apart
        self.rows: dict[bytes, tuple[bytes, bytes]] = {}
        self.memo = Memo(self)

    def parts(self, t: bytes) -> tuple[bytes, bytes] | None:
        """The two tokens that the merges make t of."""
        if len(t) == 1:
            return None
        got = self.split.get(t)
        if got is None:
            top, ranks = self.ranks[t], self.ranks
            s = [t[i : i + 1] for i in range(len(t))]
            while len(s) > 2:
                r, i = min((r, i) for i in range(len(s) - 1) if (r := ranks.get(s[i] + s[i + 1])) is not None and r < top)
                s[i : i + 2] = [s[i] + s[i + 1]]
            got = self.split[t] = (s[0], s[1])
        return got

    def row(self, s: bytes) -> tuple[bytes, bytes]:
        """The last token of s and the packed ids of s."""
        got = self.rows.get(s)
        if got is None:
            n, packed = len(s), self.packed
            if n == 1:
                return s, packed[s]
            for m in range(min(n, self.reach.get(s[-2:], 1)), 0, -1):
                t = s[n - m :]
                p = packed.get(t)
                if p is not None:
                    if m == n:
                        got = (t, p)
                        break
                    last, ids = self.row(s[: n - m])
                    if self.apart(last, t):
                        got = (t, ids + p)
                        break
            if len(self.rows) > MEMO:
                self.rows.clear()
            self.rows[s] = got
        return got

    def chain(self, s: bytes) -> list[bytes]:
        """The last token of every prefix of s, from the shortest."""
        last, packed, reach, apart = [b""], self.packed, self.reach, self.apart
        for i in range(1, len(s) + 1):
            for m in range(min(i, reach.get(s[i - 2 : i], 1)) if i > 1 else 1, 0, -1):
                t = s[i - m : i]
                if t in packed and (m == i or apart(last[i - m], t)):
                    last.append(t)
                    break
        return last[1:]

    def piece(self, piece: str) -> bytes:
        """Packed ids of one piece."""
        s = piece.encode()
        p = self.packed.get(s)
        if p is not None:
            return p
        if len(s) <= 40:
            return self.row(s)[1]
        last, at, out = self.chain(s), len(s), []
        while at:
            t = last[at - 1]
            out.append(self.packed[t])
            at -= len(t)
        return b"".join(reversed(out))

    def pieces(self, text: str) -> list[str]:
        return ASCII.findall(text) if text.isascii() and not ODD.search(text) else self.pattern.findall(text)

    def encode(self, text: str | None) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        return b"".join(map(self.memo.__getitem__, self.pieces(text))) if text else b""

    def decode(self, ids) -> bytes:
        """Bytes of ids, packed or as integers."""
        if isinstance(ids, bytes | memoryview):
            ids = np.frombuffer(ids, "<u4").tolist()
        return b"".join(map(self.bytes_of.__getitem__, ids))


class Memo(dict):
    """Packed ids by piece, bounded."""

    def __init__(self, codec: PrefixCodec):
        self.codec = codec

    def __missing__(self, piece: str) -> bytes:
        if len(self) > MEMO:
            self.clear()
        ids = self.codec.piece(piece)
        if len(piece) <= 64:
            self[piece] = ids
        return ids


class Edit:
    """A text, its pieces and their ids, kept exact under changes. A piece that ends at least LOOK code points before a change
    stays, as the pattern looks no farther ahead; after the change, splitting stops at the first old border that it meets."""

    LOOK = 3

    def __init__(self, codec: PrefixCodec, text: str = ""):
        self.codec, self.text, self.spans, self.encoded = codec, text, codec.pieces(text), 0
        self.ids = [codec.piece(p) for p in self.spans]

    def packed(self) -> bytes:
        return b"".join(self.ids)

    def append(self, more: str) -> None:
        self.replace(len(self.text), len(self.text), more)

    def replace(self, start: int, end: int, new: str) -> None:
        ends = list(accumulate(map(len, self.spans)))
        keep = 0
        while keep < len(ends) and ends[keep] <= start - self.LOOK:
            keep += 1
        shift = len(new) - (end - start)
        text = self.text[:start] + new + self.text[end:]
        old = {e: k + 1 for k, e in enumerate(ends) if e >= end}
        at, made, rest = ends[keep - 1] if keep else 0, [], len(self.spans)
        for m in self.codec.pattern.finditer(text, at):
            made.append(m[0])
            if m.end() >= start + len(new) and m.end() - shift in old:
                rest = old[m.end() - shift]
                break
        self.encoded = len(made)
        self.spans[keep:rest] = made
        self.ids[keep:rest] = [self.codec.piece(p) for p in made]
        self.text = text


@lru_cache(maxsize=4)
def codec(path: str, pattern: str) -> PrefixCodec:
    return PrefixCodec(path, pattern)


def encode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids (array of int) for each row of docs."""
    schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32()))])

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        c = codec(path, pattern)
        return batch(schema, b.column(0), [np.frombuffer(c.encode(t.as_py()), "<i4") for t in b.column(1)])

    return arrow_map(narrowed(docs, doc_id=id_col, text=text_col), run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, path: str, pattern: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """doc_id, data (binary): the bytes of each row's ids; null ids are none."""
    schema = pa.schema([("doc_id", pa.int64()), ("data", pa.binary())])

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        c = codec(path, pattern)
        return batch(schema, b.column(0), [c.decode(x.as_py() or []) for x in b.column(1)])

    return arrow_map(narrowed(encoded, doc_id=id_col, ids=ids_col), run, "doc_id long, data binary")


def round_trip(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: each text encoded, and its ids decoded, in one pass."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        c, n, ids_hex, hexes = codec(path, pattern), [], [], []
        for t in b.column(1):
            ids = c.encode(t.as_py())
            n.append(len(ids) // 4)
            ids_hex.append(hashlib.sha256(ids).hexdigest())
            hexes.append(hashlib.sha256(c.decode(ids)).hexdigest())
        return batch(schema, b.column(0), n, ids_hex, hexes)

    return arrow_map(narrowed(docs, doc_id=id_col, text=text_col), run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
