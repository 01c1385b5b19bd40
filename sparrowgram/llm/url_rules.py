"""URL rules as one bit-parallel wildcard automaton.

Each rule is a glob over the canonical URL, `.host` then the path: `*` stands for any signs but `/`, `**` for any signs. All globs
share one row of bits, in as many 64-bit words as they need. Bit i says that the signs read so far match a glob up to its place
i. One sign moves every bit of every glob at once:

    bits = (bits << 1) & next[sign] | bits & stay[sign]

`stay` keeps a place at a wildcard; `next` admits a sign at a place, and nothing at the first place of a glob, so that no
bit crosses from one glob into the next. A batch of URLs is read sign by sign together, each with its own row of bits.

Defined results: null and URLs without `://` have empty host and path and take the default verdict; empty tables give empty results;
with no rules all take the default; of rules equally long the first wins; repeated rows each get a row; further columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import arrow_map, batch, narrowed

SLASH = ord("/")
UPPER = {i: i + 32 for i in range(65, 91)}
CHUNK = 4096


def canonical(url: str | None) -> tuple[str, str]:
    """Host, A-Z lower-cased, and path."""
    if url is None:
        return "", ""
    _, there, rest = url.partition("://")
    if not there:
        return "", ""
    end = min((i for i in map(rest.find, "?#") if i >= 0), default=len(rest))
    host, slash, path = rest[:end].partition("/")
    return host.translate(UPPER), slash + path


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path

    @property
    def glob(self) -> str:
        return f"*.{self.host}{self.path}**"


class Automaton:
    """Of globs over bytes. A glob of n signs (wildcards not counted) takes n + 1 bits."""

    def __init__(self, globs: list[str]):
        places: list[tuple[int | None, int]] = []  # (sign that leads here; what stays here: 0 nothing, 1 all but /, 2 all)
        self.ends = []
        starts = []
        for g in globs:
            starts.append(len(places))
            places.append((None, 0))
            data, i = g.encode(), 0
            while i < len(data):
                if data[i : i + 2] == b"**":
                    places[-1] = (places[-1][0], 2)
                    i += 2
                elif data[i] == 42:
                    places[-1] = (places[-1][0], max(1, places[-1][1]))
                    i += 1
                else:
                    places.append((data[i], 0))
                    i += 1
            self.ends.append(len(places) - 1)
        self.words = max(1, -(-len(places) // 64))
        self.start = np.zeros(self.words, np.uint64)
        self.next = np.zeros((256, self.words), np.uint64)
        self.stay = np.zeros((256, self.words), np.uint64)
        for i in starts:
            self.start[i // 64] |= np.uint64(1 << i % 64)
        for i, (sign, stays) in enumerate(places):
            bit = np.uint64(1 << i % 64)
            if sign is not None:
                self.next[sign, i // 64] |= bit
            if stays:
                self.stay[:, i // 64] |= bit
            if stays == 1:
                self.stay[SLASH, i // 64] &= ~bit

    def match(self, texts: list[bytes]) -> np.ndarray:
        """bool (texts, globs)."""
        out = np.zeros((len(texts), len(self.ends)), bool)
        one, top = np.uint64(1), np.uint64(63)
        order = sorted(range(len(texts)), key=lambda i: -len(texts[i]))
        for a in range(0, len(order), CHUNK):
            part = order[a : a + CHUNK]
            bits = np.tile(self.start, (len(part), 1))
            size = np.array([len(texts[i]) for i in part])
            flat = np.frombuffer(b"".join(texts[i] for i in part), np.uint8)
            at = np.cumsum(size) - size
            for k in range(int(size[0]) if len(size) else 0):
                n = int(np.searchsorted(-size, -k, "left"))  # those longer than k come first
                sign = flat[at[:n] + k]
                b = bits[:n]
                moved = b << one
                moved[:, 1:] |= b[:, :-1] >> top
                bits[:n] = moved & self.next[sign] | b & self.stay[sign]
            for g, e in enumerate(self.ends):
                out[part, g] = (bits[:, e // 64] >> np.uint64(e % 64)) & one
        return out


def judge(urls: DataFrame, rules: list[Rule], default: str = "allow", id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """page_id, host, path, rule, verdict for each row of urls: the longest rule that fits, else the default."""
    schema = pa.schema([("page_id", pa.int64()), ("host", pa.string()), ("path", pa.string()), ("rule", pa.string()), ("verdict", pa.string())])
    ordered = sorted(rules, key=lambda r: -len(r.text))
    machine = Automaton([r.glob for r in ordered])

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        parts = [canonical(u) for u in b.column(1).to_pylist()]
        fits = machine.match([f".{h}{p}".encode() for h, p in parts])
        first = [ordered[int(r.argmax())] if r.any() else None for r in fits]
        return batch(schema, b.column(0), [h for h, _ in parts], [p for _, p in parts], [r and r.text for r in first], [r.verdict if r else default for r in first])

    return arrow_map(narrowed(urls, page_id=id_col, url=url_col), run, "page_id long, host string, path string, rule string, verdict string")
