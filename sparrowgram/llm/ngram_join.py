"""Similarity join of documents on their word 5-grams by PartEnum signatures (see partenum).

1. Screen. A document all of whose partners are similar shares at least the threshold's part of its shingles with others. Shingles
   whose hash is low enough are counted over the corpus; a document with too many that nobody else has is linked with none.
   A document of n shingles sends hashes below share(n) and judges by those below share(n / threshold), which every
   possible partner has sent. Shingles that several documents of one batch have go out once a batch.
2. Classes. Documents that are left are grouped by their shingle set; one of each class stands for it.
3. Signatures. Representatives that share a signature are joined to the least of them, as in a star; no pairs are made. Of a signature
   that many have, each task sends on one row. Clusters are the connected components: every similar pair lies in one.
4. Refinement. The sets of a large cluster make signatures again, under another scattering of the domain. Similar sets share one of those as
   well, so the components within the cluster still hold every pair, while sets that only met by chance part. This goes on until a
   cluster is small or keeps more than half of its sets.
5. Verification. A cluster is compared set by set inside one task if it is small; else it is split by size band and hash into
   blocks of bounded bytes and of a bounded number of sets, and each pair of blocks that can hold similar sets goes to a task of its
   own. So no task holds a matrix of more than 2 * BLOCK_SETS rows. Tasks return sums and spanning edges, never pairs.
6. Components of the spanning edges, with the members of each class, give the result.

Shingles are known by 64-bit hashes, classes by two such sums and the size.

Defined results: null, empty and blank texts have no shingles, no links and are their own component; texts with fewer than 5 words have one
shingle, the whole sequence; texts are read whole; empty tables give an empty result; rows that repeat a doc_id are one
document, whose text is that of the set with the least digest; rows with a null doc_id are left out; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import batch, bounded_batches, cut, narrowed, spent
from .components import components
from .partenum import band_ends, mix, shingle_hashes, signatures

U = np.uint64
MASK = (1 << 64) - 1
CHECKED, UNCHECKED, SEVERAL = 0, 2, 1
#: Bytes of sets in one block of a large cluster, and their number.
BLOCK_BYTES = 4 << 20
BLOCK_SETS = 1024
SETS = "doc_id long, n long, h1 long, h2 long, hashes binary"


def share(n: np.ndarray) -> np.ndarray:
    """The part of the hash range that a document of n shingles sends: more than its judgement needs, less for long ones."""
    return np.minimum(1.0, 0.25 + 1.7 / np.sqrt(np.maximum(n, 1)))


def below(h: np.ndarray, part: float) -> int:
    return len(h) if part >= 1 else int(np.searchsorted(h, U(int(part * 2.0**64))))


def sent(docs: DataFrame, num: int, den: int) -> DataFrame:
    """key, doc_id, kind: a row for each hash sent (kind CHECKED or UNCHECKED; SEVERAL stands for several documents of a batch), and a row of
    kind below 0 for each document: its key is its size, and -1 - kind its checked hashes less those shared in its batch."""
    schema = pa.schema([("key", pa.int64()), ("doc_id", pa.int64()), ("kind", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (x for whole in batches for x in bounded_batches(whole, "text")):
            sets = [shingle_hashes(t.as_py()) for t in b.column(1)]
            n = np.array([len(h) for h in sets], np.int64)
            out = [below(h, float(share(np.array(len(h))))) for h in sets]
            judged = np.array([below(h, float(share(np.array(len(h) * den / num)))) for h in sets], np.int64)
            ids = b.column(0).to_numpy()
            key = np.concatenate([h[:k] for h, k in zip(sets, out, strict=True)]) if sets else np.zeros(0, U)
            doc = np.repeat(np.arange(len(sets)), out)
            place = np.arange(len(key)) - np.repeat(np.cumsum(out) - out, out)
            checked = place < judged[doc]
            order = np.argsort(key, kind="stable")
            key, doc, checked = key[order], doc[order], checked[order]
            first = np.concatenate([[True], key[1:] != key[:-1]]) if len(key) else np.zeros(0, bool)
            run_of = np.cumsum(first) - 1
            size = np.bincount(run_of, minlength=int(first.sum()))
            several = size[run_of] > 1
            credit = np.bincount(doc[several & checked], minlength=len(sets))
            kind = np.where(several, SEVERAL, np.where(checked, CHECKED, UNCHECKED)).astype(np.int32)
            keep = first
            yield batch(
                schema,
                pa.array(np.concatenate([key[keep].view(np.int64), n])),
                pa.array(np.concatenate([np.where(several, 0, ids[doc])[keep], ids])),
                pa.array(np.concatenate([kind[keep], (-1 - (judged - credit)).astype(np.int32)])),
            )

    return docs.mapInArrow(run, "key long, doc_id long, kind int")


def shared(rows: DataFrame) -> DataFrame:
    """Of sorted rows: doc_id, n (of its own row, else null), kind (1 for a checked hash that others have; a document's own kind)."""
    schema = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("kind", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # of a run that may go on in the next batch, only its first row waits
        last, waiting, hit = None, None, False
        for b in batches:
            key, doc, kind = (b.column(i).to_numpy() for i in range(3))
            own = kind < 0
            parts = [(doc[own], key[own], kind[own].astype(np.int64))]
            key, doc, kind = key[~own], doc[~own], kind[~own]
            if len(key):
                first = np.concatenate([[last is None or key[0] != last], key[1:] != key[:-1]])
                run_of = np.cumsum(first)
                size = np.bincount(run_of, minlength=int(run_of[-1]) + 1)
                many = size[run_of] > 1
                goes_on = run_of == 0
                many |= goes_on
                if goes_on.any() and not hit and waiting is not None:
                    parts.append((np.array([waiting]), None, np.array([1])))
                k = np.flatnonzero(many & (kind == CHECKED))
                parts.append((doc[k], None, np.ones(len(k), np.int64)))
                hit = bool(many[-1])
                if not hit:
                    waiting = int(doc[-1]) if kind[-1] == CHECKED else None
                last = key[-1]
            docs_ = np.concatenate([p[0] for p in parts])
            n = pa.concat_arrays([pa.array(p[1], pa.int64()) if p[1] is not None else pa.nulls(len(p[0]), pa.int64()) for p in parts])
            yield batch(schema, pa.array(docs_.astype(np.int64)), n, pa.array(np.concatenate([p[2] for p in parts])))

    return rows.mapInArrow(run, "doc_id long, n long, kind long")


def screened(docs: DataFrame, num: int, den: int) -> DataFrame:
    """doc_id, n, alone: checked hashes that no other document has, repeated: whether several rows have the doc_id."""
    rows = sent(docs, num, den)
    spread = F.when(F.col("kind") < 0, F.xxhash64("doc_id")).otherwise(F.col("key"))
    rows = rows.repartition(spread).sortWithinPartitions("key")
    return shared(rows).groupBy("doc_id").agg(F.max("n").alias("n"), (-F.sum("kind") - F.count("n")).alias("alone"), (F.count("n") > 1).alias("repeated"))


def set_rows(docs: DataFrame) -> DataFrame:
    """docs: doc_id, text, repeated, with the rows of a doc_id in one partition. Its sets, equal ones of a doc_id once."""
    schema = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("h1", pa.int64()), ("h2", pa.int64()), ("hashes", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = set()
        for b in batches:
            rows = []
            for doc, t, repeated in zip(b.column(0).to_pylist(), b.column(1), b.column(2).to_pylist(), strict=True):
                h = shingle_hashes(t.as_py())
                one, two = np.array([int(mix(h ^ U(s)).sum(dtype=U)) for s in (0x1B873593, 0xCC9E2D51)], U).view(np.int64).tolist()
                if repeated:
                    if (doc, one, two, len(h)) in seen:
                        continue
                    seen.add((doc, one, two, len(h)))
                rows.append((doc, len(h), one, two, h.tobytes()))
            if rows:
                yield batch(schema, *map(list, zip(*rows, strict=True)))

    return docs.mapInArrow(run, SETS)


def distinct(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each pair (u, v) once."""
    order = np.lexsort((v, u))
    u, v = u[order], v[order]
    keep = np.ones(len(u), bool)
    keep[1:] = (u[1:] != u[:-1]) | (v[1:] != v[:-1])
    return u[keep], v[keep]


def stars(sets: DataFrame, num: int, den: int, level: int = 0) -> DataFrame:
    """u, v: representatives that share a signature, each joined to the least of its signature. sets: doc_id, hashes and, for a level above
    0, cluster: then the sets are scattered anew for that level and only those of one cluster share signatures."""
    schema = pa.schema([("key", pa.int64()), ("u", pa.int64()), ("v", pa.int64())])
    out = pa.schema([("u", pa.int64()), ("v", pa.int64())])

    def combined(key: np.ndarray, doc: np.ndarray) -> pa.RecordBatch:
        """A row for each signature with its least document, and rows with v that already are edges: a hot signature sends one row a task."""
        order = np.lexsort((doc, key))
        key, doc = key[order], doc[order]
        first = np.concatenate([[True], key[1:] != key[:-1]])
        least = doc[np.flatnonzero(first)][np.cumsum(first) - 1]
        k = np.flatnonzero(least != doc)
        u, v = distinct(least[k], doc[k])
        spread = mix(u.view(U) ^ mix(v.view(U))).view(np.int64)
        none = np.zeros(int(first.sum()), np.int64)
        mask = np.concatenate([np.ones(len(none), bool), np.zeros(len(v), bool)])
        return batch(schema, pa.array(np.concatenate([key[first], spread])), pa.array(np.concatenate([doc[first], u])), pa.array(np.concatenate([none, v]), mask=mask))

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, ids, size = [], [], 0
        for b in batches:
            clusters = b.column(2).to_numpy() if level else None
            for i, (doc, h) in enumerate(zip(b.column(0).to_pylist(), b.column(1), strict=True)):
                h = np.frombuffer(h.as_buffer(), U)
                s = signatures(h if not level else np.sort(mix(h + U(level * 0x632BE59BD9B4E019 & MASK))), num, den)
                if level:
                    s = mix(s ^ mix(clusters[i : i + 1].view(U)))
                keys.append(s)
                ids.append(np.full(len(s), doc, np.int64))
                size += len(s)
                if size > 1 << 18:
                    yield combined(np.concatenate(keys).view(np.int64), np.concatenate(ids))
                    keys, ids, size = [], [], 0
        if keys:
            yield combined(np.concatenate(keys).view(np.int64), np.concatenate(ids))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, head = None, 0
        for b in batches:
            edge = b.column(2).is_valid().to_numpy(zero_copy_only=False)
            key, doc = b.column(0).to_numpy(), b.column(1).to_numpy()
            parts = [np.stack([doc[edge], b.column(2).drop_null().to_numpy()])]
            key, doc = key[~edge], doc[~edge]
            if len(key):
                first = np.concatenate([[last is None or key[0] != last], key[1:] != key[:-1]])
                at = np.maximum.accumulate(np.where(first, np.arange(len(key)), -1))
                least = np.where(at >= 0, doc[np.maximum(at, 0)], head)
                last, head = key[-1], int(least[-1])
                k = np.flatnonzero(least != doc)
                parts.append(np.stack([least[k], doc[k]]))
            u, v = distinct(*np.concatenate(parts, axis=1))
            if len(u):
                yield batch(out, pa.array(u), pa.array(v))

    rows = sets.select("doc_id", "hashes", *(["cluster"] if level else [])).mapInArrow(make, "key long, u long, v long")
    return rows.repartition("key").sortWithinPartitions("key", "u").mapInArrow(run, "u long, v long")


def refined(members: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """members (cluster, doc_id, n, copies) with large clusters parted by further signatures. A set that meets no other under them has no
    similar set and is left out."""
    small, level, was = [], 0, None
    names = ("cluster", "doc_id", "n", "copies")
    while True:
        size = members.groupBy("cluster").agg(F.count(F.lit(1)).alias("sets"), (F.sum("n") * 8).alias("bytes"))
        if was is not None:
            size = size.join(was, "cluster")
        large = (F.col("sets") > 2 * BLOCK_SETS) | (F.col("bytes") > BLOCK_BYTES)
        size = cut(size.withColumn("open", large if was is None else large & (F.col("sets") * 2 <= F.col("was"))), "cluster-sizes")
        open_ = size.where("open").select("cluster", F.col("sets").alias("was"))
        if open_.isEmpty():
            return reduce(DataFrame.unionByName, [*small, members.select(*names)])
        small.append(members.join(open_, "cluster", "left_anti").select(*names))
        members = members.drop("was").join(open_, "cluster")
        level += 1
        again = members.select("doc_id", "cluster").join(sets.select("doc_id", "hashes").hint("shuffle_hash"), "doc_id")
        parts = components(stars(again, num, den, level)).select(F.col("node").alias("doc_id"), F.col("component").alias("part"))
        members = cut(members.join(parts, "doc_id").select(F.col("part").alias("cluster"), "doc_id", "n", "copies", "was"), "clusters")
        was = members.select("cluster", "was").distinct()


def overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections of sorted sets, by products of blocks of columns; at most 2 * BLOCK_SETS sets come here."""
    n = len(sets)
    flat = np.concatenate(sets)
    row = np.repeat(np.arange(n), [len(s) for s in sets])
    order = np.argsort(flat, kind="stable")
    flat, row = flat[order], row[order]
    col = np.cumsum(np.concatenate([[True], flat[1:] != flat[:-1]])) - 1
    many = np.bincount(col)[col] > 1
    row, col = row[many], col[many]
    out = np.zeros((n, n), np.float32)
    if len(col):
        col = np.cumsum(np.concatenate([[0], (col[1:] != col[:-1]).astype(np.int64)]))
        step = max(256, (1 << 22) // n)
        for a in range(0, int(col[-1]) + 1, step):
            i, j = np.searchsorted(col, [a, a + step])
            m = np.zeros((n, min(step, int(col[-1]) + 1 - a)), np.float32)
            m[row[i:j], col[i:j] - a] = 1
            out += m @ m.T
    return out


def verified(ids: list[int], copies: list[int], sides: list[int], sets: list[np.ndarray], within: bool, num: int, den: int) -> tuple[list, list]:
    """[(id, copies linked)] and [(id, id)], a spanning forest of the links. With two sides and not within, only links across count."""
    n = len(ids)
    size = np.array([len(s) for s in sets], np.int64)
    both = overlaps(sets)
    copies, side = np.array(copies, np.int64), np.array(sides)
    sums = np.zeros(n, np.int64)
    root = list(range(n))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    edges = []
    for a in range(0, n, 256):  # a strip of rows at a time
        b = min(n, a + 256)
        common = both[a:b].astype(np.int64)
        link = den * common >= num * (size[a:b, None] + size[None, :] - common)
        link[np.arange(b - a), np.arange(a, b)] = False
        if not within:
            link &= side[a:b, None] != side[None, :]
        sums[a:b] = link @ copies
        for i in range(a, b):
            for j in np.flatnonzero(link[i - a, :i]).tolist():
                x, y = find(i), find(j)
                if x != y:
                    root[x] = y
                    edges.append((ids[i], ids[j]))
    return [(i, int(k)) for i, k in zip(ids, sums, strict=True) if k], edges


def compared(members: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """members: cluster, doc_id, n, copies; sets: doc_id, hashes. Returns u, v, links: rows with links have the sum for u, others are
    spanning edges. Places are found on the narrow rows; sets join them once."""
    ends = band_ends(num, den)
    band = F.lit(0)
    for i, e in enumerate(ends[:60]):
        band = F.when(F.col("n") > e, i + 1).otherwise(band)
    m = members.withColumn("band", band)
    size = m.groupBy("cluster", "band").agg((F.sum("n") * 8).alias("bytes"), F.count(F.lit(1)).alias("sets"))
    total = size.groupBy("cluster").agg(((F.sum("bytes") > BLOCK_BYTES) | (F.sum("sets") > 2 * BLOCK_SETS)).alias("large"))
    blocks = F.greatest(F.lit(1), F.ceil(F.col("bytes") / BLOCK_BYTES), F.ceil(F.col("sets") / BLOCK_SETS)).cast("int")
    large = cut(size.join(total.where("large"), "cluster").select("cluster", "band", blocks.alias("blocks")), "cluster-blocks")
    one = m.join(large.select("cluster").distinct(), "cluster", "left_anti").select("cluster", F.lit(-1).alias("b1"), F.lit(0).alias("k1"), F.lit(-1).alias("b2"), F.lit(0).alias("k2"), F.lit(0).alias("side"), "doc_id", "copies")
    beside = large
    up = beside.select("cluster", (F.col("band") - 1).alias("band"), F.col("blocks").alias("above"))
    down = beside.select("cluster", (F.col("band") + 1).alias("band"), F.col("blocks").alias("under"))
    b = m.join(beside, ["cluster", "band"]).join(up, ["cluster", "band"], "left").join(down, ["cluster", "band"], "left")
    b = b.withColumn("k", F.pmod(F.xxhash64("doc_id"), F.col("blocks")).cast("int"))
    key = lambda b1, k1, b2, k2, side: F.struct(b1.alias("b1"), k1.alias("k1"), b2.alias("b2"), k2.alias("k2"), side.cast("int").alias("side"))
    here, k = F.col("band"), F.col("k")
    none = F.expr("CAST(array() AS array<int>)")
    upto = lambda c: F.when(F.col(c).isNotNull(), F.sequence(F.lit(0), F.col(c) - 1)).otherwise(none)
    goes = F.concat(
        F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda x: key(here, F.least(k, x), here, F.greatest(k, x), k > x)),
        F.transform(upto("above"), lambda x: key(here, k, here + 1, x, F.lit(0))),
        F.transform(upto("under"), lambda x: key(here - 1, x, here, k, F.lit(1))),
    )
    many = b.withColumn("to", F.explode(goes)).select("cluster", "to.b1", "to.k1", "to.b2", "to.k2", "to.side", "doc_id", "copies")
    group = ("cluster", "b1", "k1", "b2", "k2")
    places = one.unionByName(many)
    rows = sets.select("doc_id", "hashes").join(places.hint("shuffle_hash"), "doc_id").select(*group, "side", "doc_id", "copies", "hashes")
    rows = rows.repartition(*group).sortWithinPartitions(*group, "doc_id")
    schema = pa.schema([("u", pa.int64()), ("v", pa.int64()), ("links", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, ([], [], [], [])

        def done() -> pa.RecordBatch | None:
            if len(held[0]) < 2:
                return None
            within = now[1:3] == now[3:5]
            sums, edges = verified(*held, within, num, den)
            u = [i for i, _ in sums] + [i for i, _ in edges]
            return batch(schema, u, [None] * len(sums) + [j for _, j in edges], [k for _, k in sums] + [None] * len(edges)) if u else None

        for b in batches:
            keys = list(zip(*(b.column(i).to_pylist() for i in range(5)), strict=True))
            sides, ids, copies = (b.column(i).to_pylist() for i in (5, 6, 7))
            for i, x in enumerate(keys):
                if x != now:
                    if now is not None and (got := done()) is not None:
                        yield got
                    now, held = x, ([], [], [], [])
                held[0].append(ids[i])
                held[1].append(copies[i])
                held[2].append(sides[i])
                held[3].append(np.frombuffer(b.column(8)[i].as_py(), U))
        if now is not None and (got := done()) is not None:
            yield got

    return rows.mapInArrow(run, "u long, v long, links long")


def similar_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", num: int = 80, den: int = 100) -> DataFrame:
    """doc_id, n_shingles, n_similar, component_id for each document; similar: den * |A & B| >= num * |A | B|."""
    d = narrowed(docs, doc_id=id_col, text=text_col).where(F.col("doc_id").isNotNull())
    stats = cut(screened(d, num, den), "screened")
    # alone is summed over all rows of a doc_id, so it says nothing of one set where the id is repeated
    left = stats.where((F.col("n") > 0) & (F.col("repeated") | (F.col("alone") * den <= F.col("n") * (den - num)))).select("doc_id", "repeated")
    # hints: one plan at every size, with the rows of a doc_id together
    sets = cut(set_rows(d.join(left.hint("shuffle_hash"), "doc_id").select("doc_id", "text", "repeated")), "sets")
    whole = sets.where("n > 0").groupBy("doc_id").agg(F.min(F.struct("h1", "h2", "n")).alias("s")).select("doc_id", "s.*")
    classes = cut(whole.groupBy("h1", "h2", "n").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("copies")), "classes")
    total = stats.count()
    hot = classes.where(F.col("copies") * 1000 > total)  # fewer than 1000
    key = ["h1", "h2", "n"]
    member = whole.join(F.broadcast(hot), key).unionByName(whole.join(F.broadcast(hot), key, "left_anti").join(classes, key)).select("doc_id", "rep", "copies", F.col("n").alias("chosen"))
    reps = sets.join(classes.select(F.col("rep").alias("doc_id"), *key, "copies").hint("shuffle_hash"), ["doc_id", *key])
    reps = cut(reps.select("doc_id", "n", "copies", "hashes"), "representatives")
    clusters = components(stars(reps, num, den)).select(F.col("node").alias("doc_id"), F.col("component").alias("cluster"))
    members = refined(cut(reps.select("doc_id", "n", "copies").join(clusters, "doc_id"), "clusters"), reps, num, den)
    found = cut(compared(members, reps, num, den), "links")
    spent(reps)
    links = found.where("links IS NOT NULL").groupBy(F.col("u").alias("rep")).agg(F.sum("links").alias("links"))
    joined = components(found.where("v IS NOT NULL").select("u", "v")).select(F.col("node").alias("rep"), "component")
    of_rep = cut(classes.select("rep", "copies").join(links, "rep", "left").join(joined, "rep", "left").select("rep", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_similar"), F.coalesce("component", "rep").alias("component_id"), (F.col("copies") * 1000 > total).alias("hot")), "class-links")
    hot_rep = of_rep.where("hot").drop("hot")
    member = member.select("doc_id", "rep", "chosen")
    per_doc = member.join(F.broadcast(hot_rep), "rep").unionByName(member.join(F.broadcast(hot_rep), "rep", "left_anti").join(of_rep.drop("hot"), "rep")).drop("rep")
    return stats.join(per_doc, "doc_id", "left").select("doc_id", F.coalesce("chosen", "n").alias("n_shingles"), F.coalesce("n_similar", F.lit(0)).cast("long").alias("n_similar"), F.coalesce("component_id", "doc_id").alias("component_id"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", num: int = 80, den: int = 100) -> DataFrame:
    """The rows of docs that stay, with all their columns: of each component the document with the least id.

    Ids that several rows share, and null ids, don't tell documents apart. Each text of such an id is a document of its own, with a number made
    of id and text in place of the id; of equal rows of it one stays."""
    one = docs.groupBy(id_col).agg(F.count(F.lit(1)).alias("rows")).where(F.col(id_col).isNull() | (F.col("rows") > 1)).select(F.col(id_col).alias("odd_id"))
    if one.isEmpty():
        gone = similar_documents(docs, id_col, text_col, num, den).where("component_id <> doc_id").select(F.col("doc_id").alias("gone_id"))
        return docs.join(gone.hint("shuffle_hash"), docs[id_col] == gone["gone_id"], "left_anti")
    names = docs.columns
    one = cut(one, "repeated-ids")
    same = docs[id_col].eqNullSafe(one["odd_id"])
    number = F.xxhash64(F.col(id_col), F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256))
    odd = docs.join(one, same, "left_semi").withColumn("_join_number", number)
    odd = odd.withColumn("_join_rank", F.row_number().over(Window.partitionBy("_join_number").orderBy(F.lit(0)))).where("_join_rank = 1").drop("_join_rank")
    rows = cut(docs.join(one, same, "left_anti").withColumn("_join_number", F.col(id_col).cast("long")).unionByName(odd), "numbered")
    gone = similar_documents(rows, "_join_number", text_col, num, den).where("component_id <> doc_id").select(F.col("doc_id").alias("gone_id"))
    return rows.join(gone.hint("shuffle_hash"), rows["_join_number"] == gone["gone_id"], "left_anti").select(*(f"`{c}`" for c in names))
