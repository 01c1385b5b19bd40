"""Language identification by nearest centroid.

A text is a vector of letter n-grams (1 to 3, within words and at their borders; lower-cased), hashed into BUCKETS places,
weighted by (1 + ln tf) * idf and scaled to length one. Each language has several centroids, found by spherical k-means among
its training texts, so that its kinds of text each have one. A text takes the language of the centroid with the largest
cosine. It is rejected where that cosine is below the floor of that language and of its length: the quantile REJECT of
the cosines of training texts, and of pieces of 1 to 32 words of them, that are of this length (by powers of two of the
n-grams) and nearest to this language. So short texts, which lie farther out, have a low floor, and texts of
languages not learned, hex and base64 dumps and random letters fall below. Texts of 2 ** LENGTHS n-grams or more take the
floor of the length before, as a high one would reject long repetitions of a known word. At a few letters nothing tells languages apart, and some foreign words stay.

Training reads only text and language of the rows that `learn` keeps. It takes at most PER_LANG texts a language, those with the
least hash of their id, one row of each id, so what reaches the driver is bounded by PER_LANG * BUCKETS numbers a language.

Defined results: null texts and texts without letters are `und`, score 0, rejected; empty tables give empty results; with no
training text every row is `und`; ties go to the language that comes first in the alphabet; repeated rows each get a row;
whole texts are read; further columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable
from dataclasses import dataclass
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_map, batch, narrowed

BUCKETS = 1 << 13
PER_LANG = 600
CENTROIDS = 4
CHUNK = 1 << 20
REJECT = 0.01
LENGTHS = 9
#: A language with fewer training texts of a length takes that length's floor over all languages.
ENOUGH = 50


@lru_cache(maxsize=1)
def letters() -> np.ndarray:
    """By code point: itself where it is a letter, else 0."""
    out = np.zeros(0x110000, np.uint32)
    for c in range(0x110000):
        if not 0xD800 <= c < 0xE000 and chr(c).isalpha():
            out[c] = c
    return out


def counts(text: str | None) -> np.ndarray | None:
    """n-gram counts of a whole text, by bucket; None without letters."""
    if not text:
        return None
    c = letters()[np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32)]
    total = None
    step = CHUNK
    for a in range(0, len(c), step):  # a long text in overlapping parts: no n-gram is lost or counted twice
        x = c[max(0, a - 2) : a + step].astype(np.uint64)
        if not x.any():
            continue
        fresh = min(2, a)
        x = np.concatenate([[0] * (2 - fresh), x, [0] if a + step >= len(c) else []]).astype(np.uint64)
        p, q, r = x[:-2], x[1:-1], x[2:]
        h1 = r[r > 0] * np.uint64(0x9E3779B97F4A7C15) + np.uint64(1)
        two = (q > 0) | (r > 0)
        h2 = (q * np.uint64(0xC2B2AE3D27D4EB4F) + r * np.uint64(0x9E3779B97F4A7C15))[two] + np.uint64(2)
        h3 = ((p * np.uint64(0x165667B19E3779F9) ^ q) * np.uint64(0xC2B2AE3D27D4EB4F) + r * np.uint64(0x9E3779B97F4A7C15))[q > 0] + np.uint64(3)
        h = np.concatenate([h1, h2, h3])
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        n = np.bincount((h >> np.uint64(51)).astype(np.int64), minlength=BUCKETS)
        total = n if total is None else total + n
    return total


def pieces(text: str) -> list[str]:
    """Runs of 1, 2, 4, 8, 16 and 32 words out of a text, each from a place that its hash gives; of a script without blanks, of signs."""
    words, blank = text.split(), " "
    if len(text) > 20 * len(words):
        words, blank = list(text), ""
    at = zlib.crc32(text.encode("utf-8", "replace"))
    return [blank.join(words[(i := at % (len(words) - k + 1)) : i + k]) for k in (1, 2, 4, 8, 16, 32) if len(words) > k]


def length(row: np.ndarray) -> int:
    return min(int(row.sum()).bit_length(), LENGTHS)


@dataclass
class Model:
    langs: list[str]
    idf: np.ndarray
    centroids: np.ndarray  # one row each
    of: np.ndarray  # the language of each row
    floor: np.ndarray  # by language and length

    def vectors(self, rows: list[np.ndarray]) -> np.ndarray:
        m = np.asarray(rows, np.float32)
        m = np.where(m > 0, 1 + np.log(np.maximum(m, 1)), 0) * self.idf
        return m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-12)

    def predict(self, rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Index of the language and cosine of its nearest centroid."""
        cos = self.vectors(rows) @ self.centroids.T
        best = cos.argmax(axis=1)
        return self.of[best], cos[np.arange(len(best)), best]

    def known(self, rows: list[np.ndarray], lang: np.ndarray, cos: np.ndarray) -> np.ndarray:
        """Whether each row reaches the floor of its language and length."""
        return cos >= self.floor[lang, [length(x) for x in rows]]


def floors(model: Model, samples: Iterable[np.ndarray]) -> np.ndarray:
    """The quantile REJECT of cosines by nearest language and length. A length that no sample has takes that of the next shorter."""
    found, rows = [], []

    def flush() -> None:
        if rows:
            found.extend(zip(*model.predict(rows), (int(x.sum()).bit_length() for x in rows), strict=True))
        rows.clear()

    for x in samples:
        rows.append(x)
        if len(rows) == 128:
            flush()
    flush()
    lang, cos, n = (np.array(x) for x in zip(*found, strict=True))
    out = np.zeros((len(model.langs), LENGTHS + 1))
    for b in range(1, LENGTHS + 1):
        for i in range(len(model.langs)):
            own = (n == b) & (lang == i)
            own = own if own.sum() >= ENOUGH else n == b
            out[i, b] = np.quantile(cos[own], REJECT) if own.any() else out[i, b - 1]
    return out


def fit(samples: dict[str, list[np.ndarray]], centroids: int = CENTROIDS, rounds: int = 12, short: Iterable[np.ndarray] = ()) -> Model | None:
    """From n-gram counts by language; short has those of pieces, for the floors only."""
    langs = sorted(k for k, v in samples.items() if v)
    if not langs:
        return None
    texts = sum(len(samples[k]) for k in langs)
    seen = sum((np.asarray(samples[k]) > 0).sum(axis=0) for k in langs)  # a language at a time: the driver holds no second copy of all
    idf = (np.log((1 + texts) / (1 + seen)) + 0.1).astype(np.float32)
    model = Model(langs, idf, np.zeros((0, BUCKETS), np.float32), np.zeros(0, int), np.zeros((len(langs), LENGTHS + 1)))
    rows, of = [], []
    for i, k in enumerate(langs):
        v = model.vectors(samples[k])
        c = v[[0]]
        while len(c) < min(centroids, len(v)):  # the farthest text from those taken starts the next
            c = np.vstack([c, v[[(v @ c.T).max(axis=1).argmin()]]])
        for _ in range(rounds):
            own = (v @ c.T).argmax(axis=1)
            new = np.vstack([v[own == j].mean(axis=0) if (own == j).any() else c[j] for j in range(len(c))])
            c = new / np.maximum(np.linalg.norm(new, axis=1, keepdims=True), 1e-12)
        rows.append(c)
        of += [i] * len(c)
    model.centroids, model.of = np.vstack(rows), np.array(of)
    model.floor = floors(model, chain((x for k in langs for x in samples[k]), short))
    return model


def held_out(id_: Column) -> Column:
    """The rows that training never sees."""
    return F.coalesce(F.crc32(id_.cast("string")) % 5 == 0, F.lit(False))


def learn(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_lang: int = PER_LANG) -> Model | None:
    """A model from the rows with a language that are not held out."""
    d = narrowed(docs, doc_id=id_col, text=text_col, lang=lang_col).where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    # ids first, without the texts: two narrow columns are read
    w = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    chosen = d.select("doc_id", "lang").withColumn("n", F.row_number().over(w)).where(F.col("n") <= per_lang).select("doc_id", "lang").distinct()
    schema = pa.schema([("lang", pa.string()), ("piece", pa.bool_()), ("at", pa.list_(pa.int16())), ("n", pa.list_(pa.int32()))])

    def sparse(c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.flatnonzero(c)
        return at.astype(np.int16), c[at].astype(np.int32)

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        # counts go to their sparse form one by one: a dense row is 64 kB, and a batch may have thousands
        rows = [(k, i > 0, *sparse(c)) for k, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) for i, x in enumerate([t, *pieces(t or "")]) if (c := counts(x)) is not None]
        return batch(schema, *(list(x) for x in zip(*rows, strict=True))) if rows else batch(schema, [], [], [], [])

    texts = d.join(F.broadcast(chosen), ["doc_id", "lang"], "left_semi")  # per_lang ids a language
    # one row of each id, else repeated rows would have no bound; the limit works within each task before the shuffle as well
    one = Window.partitionBy("lang", "doc_id").orderBy(F.xxhash64("text"), "text")
    texts = texts.withColumn("n", F.row_number().over(one)).where("n = 1").select("lang", "text")
    got = arrow_map(texts, run, "lang string, piece boolean, at array<short>, n array<int>").toArrow()

    def dense(at: pa.Scalar, n: pa.Scalar) -> np.ndarray:
        c = np.zeros(BUCKETS, np.int32)
        c[at.values.to_numpy()] = n.values.to_numpy()
        return c

    samples: dict[str, list[np.ndarray]] = {}
    short = []  # stay sparse
    for k, piece, at, n in zip(got.column("lang").to_pylist(), got.column("piece").to_pylist(), got.column("at"), got.column("n"), strict=True):
        if piece:
            short.append((at, n))
        else:
            samples.setdefault(k, []).append(dense(at, n))
    for v in samples.values():  # whatever order the tasks ended in
        v.sort(key=lambda c: c.tobytes())
    short.sort(key=lambda x: (x[0].values.to_numpy().tobytes(), x[1].values.to_numpy().tobytes()))
    return fit(samples, short=(dense(*x) for x in short))


def predict(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred, score, rejected for each row of docs."""
    schema = pa.schema([("doc_id", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64()), ("rejected", pa.bool_())])
    shipped = docs.sparkSession.sparkContext.broadcast(model)

    def one(b: pa.RecordBatch) -> pa.RecordBatch:
        m, n = shipped.value, b.num_rows
        langs, score, rejected = ["und"] * n, np.zeros(n), np.ones(n, bool)
        rows, at = [], []

        def flush() -> None:
            if rows and m is not None:
                k, cos = m.predict(rows)
                for i, j, c, known in zip(at, k, cos, m.known(rows, k, cos), strict=True):
                    langs[i], score[i], rejected[i] = m.langs[j], min(1.0, max(0.0, float(c))), not known
            rows.clear()
            at.clear()

        for i, t in enumerate(b.column(1)):
            if (c := counts(t.as_py())) is not None:
                rows.append(c)
                at.append(i)
                if len(rows) == 128:
                    flush()
        flush()
        return batch(schema, b.column(0), langs, score, rejected)

    return arrow_map(narrowed(docs, doc_id=id_col, text=text_col), one, "doc_id long, lang_pred string, score double, rejected boolean")


def keep_known(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs whose language is known, with all their columns: one pass, no join."""
    shipped = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("boolean")
    def known(texts):
        import pandas as pd

        m, out = shipped.value, np.zeros(len(texts), bool)
        for a in range(0, len(texts), 128):
            part = [(i, c) for i, t in enumerate(texts.iloc[a : a + 128], a) if (c := counts(t)) is not None]
            if part and m is not None:
                rows = [c for _, c in part]
                out[[i for i, _ in part]] = m.known(rows, *m.predict(rows))
        return pd.Series(out)

    return docs.where(known(F.col(text_col)))

