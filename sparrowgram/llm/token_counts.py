"""Exact token counts of every prefix by dynamic programming over byte-pair merges.

An encoding by ranked merges is the one chain of tokens in which each neighbouring pair, encoded by itself, stays
that pair. So each prefix has one valid last token, and
    count[i] = count[i - len(t)] + 1
for the token t that ends at i and is valid after the last token of the prefix before it. The table built in one
pass answers how long a text is, where a budget of tokens cuts it, and how many tokens any prefix has, without
encoding again: token_counts takes all its columns from that table.

The vocabulary marks word ends, so two rows are kept for a piece: the last token where the word goes on, and the
count where the word ends at i. Pieces (runs of letters, single digits, runs of other signs) are independent; the steps from
prefix to prefix of a piece are found once a worker and kept in a bounded memo, and the table of a text is the running sum of
the steps of its pieces. Signs that normalising joins, adds or reorders are counted prefix by prefix, from the last place
that they can't reach; such a place comes before a plain sign of another kind than the one before it.

The normaliser and the splitting pattern of the vocabulary file are checked: others than those built in here raise an error.

Defined results: null is the empty text with 0 tokens; empty tables give empty results; repeated rows each get a
row; whole texts are counted, however long; further columns are ignored.
"""

from __future__ import annotations

import json
import re
import unicodedata
from bisect import bisect_left
from functools import lru_cache
from itertools import accumulate

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame

from .common import arrow_map, batch, narrowed
from .merge_pairs import Neighbours

END = "</w>"
MEMO = 500_000
#: Signs at a word's beginning whose rows are kept.
HEAD = 6
#: Longer stretches of odd signs go by clusters.
SHARED = 64
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+"
ASCII_WORDS = r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^\sa-z0-9]+"
#: What the vocabulary file must say: other rules would give other counts.
NORMALIZER = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def byte_signs() -> dict[int, str]:
    """The sign that byte-level vocabularies print for each byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(other)}


def reach(tokens: set[str]) -> tuple[dict[str, tuple[int, ...]], dict[str, tuple[int, ...]]]:
    """By the three, and by the two signs that a text ends in: the lengths of tokens that end so, the longest first, and 1."""
    three: dict[str, set[int]] = {}
    two: dict[str, tuple[int, ...]] = {}
    for t in tokens:
        if len(t) > 2:
            three.setdefault(t[-3:], {1}).add(len(t))
        elif len(t) == 2:
            two[t] = (2, 1)
    for k, v in three.items():
        if k[1:] in two:
            v.add(2)
    return {k: tuple(sorted(v, reverse=True)) for k, v in three.items()}, two


ONE = (1,)


class PrefixTable:
    """Of one vocabulary with word ends. A token is a tuple of signs; the last sign of a word carries END."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            model = json.load(f)
        check_rules(model, path)
        self.special = [t["content"] for t in model["added_tokens"]]
        self.rank: dict[tuple[str, str], int] = {}
        self.parts: dict[str, tuple[str, str]] = {}
        self.inner: set[str] = set()
        self.final: dict[str, str] = {}
        for i, m in enumerate(model["model"]["merges"]):
            a, b = m if isinstance(m, list) else m.split(" ")
            self.rank[(a, b)] = i
            t = a + b
            self.parts.setdefault(t, (a, b))
            if t.endswith(END):
                self.final[t[: -len(END)]] = t
            else:
                self.inner.add(t)
        self.inner_reach, self.final_reach = reach(self.inner), reach(set(self.final))
        self.longest = max(map(len, self.inner | set(self.final)), default=1)
        self.signs = byte_signs()
        neighbours = Neighbours(lambda a, b: self.rank.get((a, b)), self.parts.get)
        self.apart, self.known = neighbours.apart, neighbours.known
        self.pieces = regex.compile(WORDS)
        self.ascii_pieces = re.compile(ASCII_WORDS, re.ASCII)
        # all signs of a text: pieces and the white space between
        self.all = regex.compile(rf"\s+|{WORDS}")
        self.ascii_all = re.compile(rf"\s+|{ASCII_WORDS}", re.ASCII)
        self.marks = regex.compile("|".join(map(regex.escape, self.special)))
        self.rows: dict[str, tuple[list[str], list[int], list[int]]] = {}
        self.memo: Memo = Memo(self)
        self.steps: Steps = Steps(self)

    def chain(self, s: str, ends: list[int] | None = None, begun: tuple | None = None) -> tuple[list[str], list[int]]:
        """Of each prefix of s, as the beginning of a longer word: its last token and its number of tokens; into ends the number of tokens of each
        as a word. begun: the three of a prefix that is known."""
        inner, final, apart, known, three, two = self.inner, self.final, self.apart, self.known, *self.inner_reach
        final_three, final_two = self.final_reach
        last, count = (["", *begun[0]], [0, *begun[1]]) if begun else ([""], [0])
        if begun and ends is not None:
            ends += begun[2]
        for i in range(len(last), len(s) + 1):
            back = s[i - 3 : i] if i > 2 else ""
            near = s[i - 2 : i] if i > 1 else ""
            for m in three.get(back) or two.get(near, ONE):
                if m <= i:
                    t = s[i - m : i]
                    if m == 1 or t in inner:
                        if m == i:
                            break
                        pair = (last[i - m], t)
                        ok = known.get(pair)
                        if apart(*pair) if ok is None else ok:
                            break
            last.append(t)
            count.append(count[i - m] + 1)
            if ends is not None:
                for m in final_three.get(back) or final_two.get(near, ONE):
                    if m <= i:
                        t = s[i - m : i]
                        word = final.get(t) if m > 1 else t + END
                        if word is not None:
                            if m == i:
                                break
                            pair = (last[i - m], word)
                            ok = known.get(pair)
                            if apart(*pair) if ok is None else ok:
                                break
                ends.append(count[i - m] + 1)
        return last, count

    def ended(self, s: str, i: int, last: list[str], count: list[int]) -> int:
        """Tokens of the word s[:i]; last and count reach to i - 1 at least."""
        three, two = self.final_reach
        for m in (three.get(s[i - 3 : i]) if i > 2 else None) or (two.get(s[i - 2 : i], ONE) if i > 1 else ONE):
            if m > i:
                continue
            t = s[i - m : i]
            word = self.final.get(t) if m > 1 else t + END
            if word is not None and (m == i or self.apart(last[i - m], word)):
                return count[i - m] + 1
        raise ValueError(s)

    def word_counts(self, s: str) -> list[int]:
        """Tokens of the words s[:1], s[:2] and so on to s. Words that begin alike share the rows of their first signs."""
        head = s[:HEAD]
        begun = self.rows.get(head)
        if begun is None:
            ends: list[int] = []
            last, count = self.chain(head, ends)
            if len(self.rows) > MEMO:
                self.rows.clear()
            begun = self.rows[head] = (last[1:], count[1:], ends)
        if len(s) <= HEAD:
            return begun[2]
        ends = []
        self.chain(s, ends, begun)
        return ends

    def prefixes(self, piece: str) -> list[int]:
        """Of one piece: [tokens of the word piece[:i] for i in 1..len]."""
        if piece.isascii():
            return self.word_counts(piece)
        ends = self.word_counts(self.sign_string(piece))
        return [ends[i - 1] for i in accumulate(len(c.encode()) for c in piece)]

    def piece_count(self, piece: str) -> int:
        s = piece if piece.isascii() else self.sign_string(piece)
        return 1 if s in self.final or len(s) == 1 else self.word_counts(s)[-1]

    def sign_string(self, piece: str) -> str:
        return "".join(map(self.signs.__getitem__, piece.encode()))

    def whole(self, stretch: str) -> int:
        """Tokens of a text by its pieces; any text, special strings included."""
        n = at = 0
        for m in [*self.marks.finditer(stretch), None]:
            part = stretch[at : m.start()] if m else stretch[at:]
            if part:
                if part.isascii():
                    words = self.ascii_pieces.findall(part.lower())
                else:
                    words = self.pieces.findall(unicodedata.normalize("NFC", part).replace("Σ", "σ").lower())
                n += sum(map(self.memo.__getitem__, words))
            if m:
                n, at = n + 1, m.end()
        return n

    def piece_steps(self, piece: str) -> list[int]:
        """Of one lower-cased piece or run of white space: the tokens that each sign adds to the prefix before it, if the word ends there; may be negative."""
        if self.pieces.match(piece) is None:  # white space
            return [0] * len(piece)
        row = self.prefixes(piece)
        if piece[0] == "'" and len(piece) > 1 and piece[1].isalpha():  # cut short it is a sign and a letter
            row = [self.whole(piece[:i]) for i in range(1, len(piece))] + row[-1:]
        return [b - a for a, b in zip([0, *row], row)]

    def plain_steps(self, text: str) -> np.ndarray:
        """Of a text that lower-casing and NFC leave sign for sign: the step of each sign."""
        low = text.lower()
        found = (self.ascii_all if low.isascii() else self.all).findall(low)
        try:
            return np.frombuffer(b"".join(map(self.steps.__getitem__, found)), np.int8)
        except OverflowError:  # a step that no byte holds
            return np.array([x for f in found for x in self.piece_steps(f)], np.int64)

    def odd_steps(self, segment: str) -> np.ndarray:
        """Of a text that nothing before or after can reach, with signs that normalising joins or adds. A prefix that ends before a sign that
        joins nothing is, normalised, a prefix of the whole; of others only what stands after the last such place is normalised
        by itself and put after the rows that are there."""
        if len(segment) <= SHARED:
            return np.diff([0, *(self.whole(segment[:i]) for i in range(1, len(segment) + 1))])
        normal = lambda t: unicodedata.normalize("NFC", t).lower()
        closed = [i for i, c in enumerate(segment) if not i or not unicodedata.category(c).startswith("M") and not 0x1160 <= ord(c) < 0x1200]
        clusters = [normal(segment[i:j]) for i, j in zip(closed, [*closed[1:], len(segment)], strict=True)]
        low = "".join(clusters)
        pieces = [(m.start(), m[0]) for m in self.pieces.finditer(low)]
        upto = np.concatenate([[0], np.cumsum([x for m in self.all.findall(low) for x in self.piece_steps(m)])])
        starts, chains = [a for a, _ in pieces], {}
        out, at = [], 0
        for i, j, cluster in zip(closed, [*closed[1:], len(segment)], clusters, strict=True):
            k = bisect_left(starts, at) - 1
            if k > 0 and pieces[k - 1] == (starts[k] - 1, "'") and at - starts[k] < 3:
                k -= 1  # a sign and letters may still become a contraction
            head = low[starts[k] : at] if k >= 0 else ""
            before = int(upto[starts[k]]) if k >= 0 else 0
            for end in range(i + 1, j):
                tail = normal(segment[i:end])
                if len(head) <= SHARED:
                    out.append(before + self.whole(head + tail))
                    continue
                first, *rest = self.pieces.findall((head[-1] if head[-1].isalpha() else "!") + tail)
                if k not in chains:
                    s = self.sign_string(pieces[k][1])
                    chains = {k: (s, *self.chain(s))}  # of the latest long piece only
                out.append(before + self.longer(*chains[k], len(self.sign_string(head)), self.sign_string(first[1:])) + sum(map(self.memo.__getitem__, rest)))
            at += len(cluster)
            out.append(int(upto[at]))
        return np.diff([0, *out])

    def longer(self, s: str, last: list[str], count: list[int], q: int, more: str) -> int:
        """Tokens of the word s[:q] + more, from the rows of s."""
        if not more:
            return self.ended(s, q, last, count)
        base = max(0, q - self.longest)
        near = s[base:q] + more
        last, count = last[base : q + 1], count[base : q + 1]
        lengths = lambda reach, i: (reach[0].get(near[i - 3 : i]) if i > 2 else None) or (reach[1].get(near[i - 2 : i], ONE) if i > 1 else ONE)
        for i in range(q + 1 - base, len(near)):
            for m in lengths(self.inner_reach, i):
                t = near[i - m : i]
                if m <= i and (m == 1 or t in self.inner) and (m == i and not base or self.apart(last[i - m], t)):
                    last.append(t)
                    count.append(count[i - m] + 1)
                    break
        i = len(near)
        for m in lengths(self.final_reach, i):
            t = near[i - m : i]
            word = self.final.get(t) if m > 1 else t + END
            if m <= i and word is not None and (m == i and not base or self.apart(last[i - m], word)):
                return count[i - m] + 1
        raise ValueError(near)

    def part_steps(self, part: str) -> np.ndarray:
        """Of a text without special strings: the step of each sign."""
        if part.isascii():
            return self.plain_steps(part)
        part = part.replace("Σ", "σ")  # as the library does, wherever it stands
        if unicodedata.is_normalized("NFC", part) and len(part.lower()) == len(part):
            return self.plain_steps(part)
        out = []
        for segment in self.segments(part):
            even = segment.isascii() or unicodedata.is_normalized("NFC", segment) and len(segment.lower()) == len(segment)
            out.append(self.plain_steps(segment) if even else self.odd_steps(segment))
        return np.concatenate(out)

    def segments(self, text: str) -> list[str]:
        """A text cut where pieces part for good: at white space, and between plain signs of two pieces."""
        out, at = [], 0
        for m in self.pieces.finditer(text):
            i = m.start()
            if i > at and (text[i - 1].isspace() or plain(text[i - 1])) and plain(text[i]):
                out.append(text[at:i])
                at = i
        return [*out, text[at:]]

    def count(self, text: str | None) -> int:
        return self.whole(text) if text else 0

    def prefix_counts(self, text: str | None) -> np.ndarray:
        """int32[len + 1]: tokens of text[:i]."""
        text = text or ""
        if "<|" not in text:
            steps = [self.part_steps(text)] if text else []
        else:
            steps, at = [], 0
            for m in self.marks.finditer(text):
                part, special = text[at : m.start()], m[0]
                steps.append(self.part_steps(part))
                # until the special string is whole it goes on from the last piece before it
                tail = ([""] + [x for x in self.segments(part) if x])[-1]
                grown = [self.whole(tail), *(self.whole(tail + special[:i]) for i in range(1, len(special))), self.whole(tail) + 1]
                steps.append(np.diff(grown))
                at = m.end()
            steps.append(self.part_steps(text[at:]))
        out = np.zeros(len(text) + 1, np.int32)
        if steps:
            np.cumsum(np.concatenate(steps) if len(steps) > 1 else steps[0], out=out[1:])
        return out


@lru_cache(maxsize=1 << 16)
def plain(c: str) -> bool:
    """Whether a sign stays one sign of its kind whatever stands before or after it."""
    return len(c.lower()) == 1 and not unicodedata.category(c).startswith("M") and not 0x1100 <= ord(c) < 0x1200 and unicodedata.is_normalized("NFC", c) and c != "'"


def check_rules(model: dict, path: str) -> None:
    normalizer, splitter = model.get("normalizer") or {}, model.get("pre_tokenizer") or {}
    steps = normalizer.get("normalizers", [normalizer])
    splits = splitter.get("pretokenizers", [splitter])
    regexes = [x["pattern"].get("Regex") for x in splits if x.get("type") == "Split"]
    if steps != NORMALIZER or regexes != [SPLIT] or [x.get("type") for x in splits] != ["Split", "ByteLevel"] or model["model"].get("end_of_word_suffix") != END:
        raise ValueError(f"{path}: this normaliser or splitting pattern isn't supported")


class Memo(dict):
    """Tokens by piece, bounded."""

    def __init__(self, table: PrefixTable):
        self.table = table

    def __missing__(self, piece: str) -> int:
        if len(self) > MEMO:
            self.clear()
        n = self.table.piece_count(piece)
        if len(piece) <= 64:
            self[piece] = n
        return n


class Steps(dict):
    """By piece: the steps of its signs, a signed byte each; bounded."""

    def __init__(self, table: PrefixTable):
        self.table = table

    def __missing__(self, piece: str) -> bytes:
        if len(self) > MEMO:
            self.clear()
        steps = self.table.piece_steps(piece)
        if min(steps) < -128 or max(steps) > 127:
            raise OverflowError(piece[:40])
        out = bytes([x & 255 for x in steps])
        if len(piece) <= 64:
            self[piece] = out
        return out


@lru_cache(maxsize=4)
def prefix_table(path: str) -> PrefixTable:
    import gc

    table = PrefixTable(path)
    gc.freeze()  # the vocabulary stays: no need to walk it again and again
    return table


class Prefixes:
    """The stored answer for one text: no encoding happens after it is made."""

    def __init__(self, counts: np.ndarray):
        self.counts = np.asarray(counts)

    def tokens(self, i: int) -> int:
        return int(self.counts[i])

    def longest(self, budget: int) -> int:
        """Code points of the longest prefix of at most `budget` tokens. Counts may fall where a sign completes a token, so it's the last of all."""
        if self.counts[-1] <= budget:
            return len(self.counts) - 1
        return int(np.flatnonzero(self.counts <= budget)[-1])


def token_counts(docs: DataFrame, path: str, limit: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit, cut for each row of docs, all from the prefix counts of the text; cut: the code points of its
    longest prefix of at most limit tokens."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64()), ("over_limit", pa.bool_()), ("cut", pa.int64())])

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        t = prefix_table(path)
        texts = b.column(1)
        n, cut = [], []
        for x in texts:
            p = Prefixes(t.prefix_counts(x.as_py()))
            n.append(p.tokens(-1))
            cut.append(p.longest(limit))
        size = np.nan_to_num(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(float)).astype(np.int64)
        return batch(schema, b.column(0), size, n, [x > limit for x in n], cut)

    return arrow_map(narrowed(docs, doc_id=id_col, text=text_col), run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean, cut long")


def prefix_counts(docs: DataFrame, path: str, budgets: tuple[int, ...] = (), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, counts (array of int, counts[i] for the first i code points) and cuts (for each budget the code points of
    the longest prefix within it). Later questions are answered from counts alone."""
    schema = pa.schema([("doc_id", pa.int64()), ("counts", pa.list_(pa.int32())), ("cuts", pa.list_(pa.int64()))])

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        t = prefix_table(path)
        rows = [t.prefix_counts(x.as_py()) for x in b.column(1)]
        return batch(schema, b.column(0), rows, [[Prefixes(r).longest(x) for x in budgets] for r in rows])

    return arrow_map(narrowed(docs, doc_id=id_col, text=text_col), run, "doc_id long, counts array<int>, cuts array<long>")
