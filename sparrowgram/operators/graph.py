"""Graphs as edge tables (src, dst): src imports or calls dst. Loops run on the frontier and cut their lineage each round."""

from __future__ import annotations

from array import array
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources.durable import cut, spent

#: Edges of a graph whose cycles one task finds.
IN_ONE_TASK = 1 << 24


def reverse(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))


def nodes_of(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """All nodes, those without edges too if a table of them is given."""
    n = edges.select(F.col("src").alias("node")).union(edges.select("dst"))
    return (n if nodes is None else n.union(nodes)).distinct()


def degrees(edges: DataFrame) -> DataFrame:
    """node, n_in, n_out over distinct edges."""
    e = edges.select("src", "dst").distinct()
    both = e.select(F.col("dst").alias("node"), F.lit(1).alias("i"), F.lit(0).alias("o")).union(e.select("src", F.lit(0), F.lit(1)))
    return both.groupBy("node").agg(F.sum("i").alias("n_in"), F.sum("o").alias("n_out"))


def hubs(edges: DataFrame, nodes: DataFrame | None = None, part: float = 0.2) -> DataFrame:
    """node, n_in of the nodes that at least a fifth of all nodes point to."""
    least = nodes_of(edges, nodes).agg(F.greatest(F.lit(1), F.ceil(F.count(F.lit(1)) * part)).alias("least"))
    return degrees(edges).join(F.broadcast(least)).where("n_in >= least").select("node", "n_in")  # one row


def entry_points(edges: DataFrame) -> DataFrame:
    """Nodes that point to others and that nothing points to."""
    e = edges.where("src <> dst")
    return e.select(F.col("src").alias("node")).distinct().join(e.select(F.col("dst").alias("node")), "node", "left_anti")


def reach(edges: DataFrame, seeds: DataFrame, depth: int = 0) -> DataFrame:
    """seed, node, depth: what each seed reaches along the edges, with the fewest steps; depth 0 has no bound."""
    e = edges.select("src", "dst").distinct()
    front = seeds.select("seed", F.col("seed").alias("node")).distinct().withColumn("depth", F.lit(0))
    seen, k = cut(front), 0
    front = seen
    while (not depth or k < depth) and not front.isEmpty():
        k += 1
        step = front.join(e, front.node == e.src).select("seed", F.col("dst").alias("node")).distinct().withColumn("depth", F.lit(k))
        front = cut(step.join(seen, ["seed", "node"], "left_anti"))
        seen = seen.unionByName(front)
    return seen.where("depth > 0")


def impact(edges: DataFrame, seeds: DataFrame, depth: int = 0) -> DataFrame:
    """seed, node, depth: what depends on each seed, directly (depth 1) or through others."""
    return reach(reverse(edges), seeds, depth)


def blast_radius(edges: DataFrame, seeds: DataFrame, depth: int = 0) -> DataFrame:
    """seed, direct, transitive, score, tier."""
    i = impact(edges, seeds, depth).groupBy("seed").agg(F.sum(F.when(F.col("depth") == 1, 1).otherwise(0)).alias("direct"), F.sum(F.when(F.col("depth") > 1, 1).otherwise(0)).alias("transitive"))
    all_ = seeds.select("seed").distinct().join(i, "seed", "left").fillna(0)
    score = F.least(F.lit(100), 4 * F.col("direct") + F.col("transitive"))
    return all_.withColumn("score", score).withColumn("tier", T.blast_tier(score))


def pagerank(edges: DataFrame, nodes: DataFrame | None = None, damping: float = 0.85, rounds: int = 20) -> DataFrame:
    """node, rank divided by the largest; the rank of nodes without edges out goes to all alike. As ranks sum up to 1, what each node gets as
    its base is 1 less all that flows, shared by all.

    Only nodes with edges in and out, the core, need rounds: what no edge leads to has the base as its rank, and what no edge leaves gives
    nothing on, so that its rank is reckoned once, at the end. The driver keeps two numbers a round; a round's plan is one join of the core's
    links with its ranks, and without a core no round touches a table."""
    e = cut(edges.where("src IS NOT NULL AND dst IS NOT NULL").select("src", "dst").distinct())
    ends = [e.groupBy("src").agg(F.count(F.lit(1)).alias("n_out")).select(F.col("src").alias("node"), F.lit(0).alias("i"), "n_out"), e.select(F.col("dst").alias("node"), F.lit(1).alias("i"), F.lit(0).cast("long").alias("n_out"))]
    if nodes is not None:
        ends.append(nodes.select("node", F.lit(0).alias("i"), F.lit(0).cast("long").alias("n_out")))
    n = cut(reduce(DataFrame.union, ends).groupBy("node").agg(F.max("i").alias("i"), F.max("n_out").alias("n_out")))
    count, n_givers, n_core = n.agg(F.count(F.lit(1)), F.coalesce(F.sum((F.col("n_out") > 0).cast("long")), F.lit(0)), F.coalesce(F.sum(((F.col("n_out") > 0) & (F.col("i") > 0)).cast("long")), F.lit(0))).first()
    if not count or not rounds:
        return n.select("node", F.lit(1.0).alias("rank"))
    links = e.join(n.where("n_out > 0").select(F.col("node").alias("src"), "i", (F.lit(damping) / F.col("n_out")).alias("part")), "src")
    # what a base of 1 at all nodes that no edge leads to sends on
    steady = links.where("i = 0").groupBy(F.col("dst").alias("node")).agg(F.sum("part").alias("steady"))
    if n_core:
        core = cut(n.where("n_out > 0 AND i > 0").select("node", F.monotonically_increasing_id().alias("id")).join(steady, "node", "left").select("node", "id", F.coalesce("steady", F.lit(0.0)).alias("steady")))
        out = links.where("i > 0").join(core.select(F.col("node").alias("src"), F.col("id").alias("s")), "src").select("s", "dst", "part")
        inner = cut(out.join(core.select(F.col("node").alias("dst"), F.col("id").alias("d")), "dst").select("s", "d", "part"))
        r = core.select("id", F.lit(1.0 / count).alias("rank"))
    first = last = 1.0 / count  # of the nodes that no edge leads to
    held = n_core / count
    for k in range(rounds):
        last, first = first, (1 - damping * ((n_givers - n_core) * first + held)) / count
        if n_core and k < rounds - 1:
            flow = inner.join(r, inner["s"] == r["id"]).groupBy("d").agg(F.sum(F.col("rank") * F.col("part")).alias("flow"))
            r, old = cut(core.join(flow, core["id"] == flow["d"], "left").select("id", (F.lit(first) + F.lit(last) * F.col("steady") + F.coalesce("flow", F.lit(0.0))).alias("rank"))), r
            spent(old)
            held = r.agg(F.sum("rank")).first()[0]
    got = n.select("node").join(steady, "node", "left").select("node", (F.lit(first) + F.lit(last) * F.coalesce("steady", F.lit(0.0))).alias("rank"))
    if n_core:
        moving = out.join(r, out["s"] == r["id"]).groupBy(F.col("dst").alias("node")).agg(F.sum(F.col("rank") * F.col("part")).alias("flow"))
        got = got.join(moving, "node", "left").select("node", (F.col("rank") + F.coalesce("flow", F.lit(0.0))).alias("rank"))
    got = cut(got)
    top = got.agg(F.max("rank").alias("top")).first().top
    return got.select("node", (F.col("rank") / F.lit(top)).alias("rank"))


def strong(s: np.ndarray, d: np.ndarray, n: int) -> np.ndarray:
    """For each of the nodes 0 to n - 1 one that stands for all which it reaches and which reach it; by Tarjan's method without recursion."""

    def ints(x: np.ndarray) -> array:
        out = array("i")
        out.frombytes(x.astype(np.int32).tobytes())
        return out

    ends = np.concatenate([[0], np.cumsum(np.bincount(s, minlength=n))])
    dst, at, end = ints(d[np.argsort(s, kind="stable")]), ints(ends[:-1]), ints(ends[1:])
    index, low, of = ints(np.zeros(n)), ints(np.zeros(n)), ints(np.full(n, -1))
    count, held = 0, array("i")
    for root in range(n):
        if index[root]:
            continue
        count += 1
        index[root] = low[root] = count
        held.append(root)
        path = array("i", [root])
        while path:
            v = path[-1]
            i = at[v]
            if i < end[v]:
                at[v] = i + 1
                w = dst[i]
                if not index[w]:
                    count += 1
                    index[w] = low[w] = count
                    held.append(w)
                    path.append(w)
                elif of[w] < 0 and index[w] < low[v]:
                    low[v] = index[w]
                continue
            path.pop()
            if low[v] == index[v]:
                w = -1
                while w != v:
                    w = held.pop()
                    of[w] = v
            elif low[v] < low[path[-1]]:
                low[path[-1]] = low[v]
    return np.frombuffer(of, np.int32) if n else np.zeros(0, np.int32)


def in_one_task(edges: DataFrame) -> DataFrame:
    """cycles() of edges without nulls and loops, by one task. Nodes that aren't whole numbers are numbered first."""
    whole = {edges.schema[c].dataType.typeName() for c in ("src", "dst")} <= {"byte", "short", "integer", "long"}
    if whole:
        e = edges.select(F.col("src").cast("long").alias("s"), F.col("dst").cast("long").alias("d"))
    else:
        names = cut(nodes_of(edges).select("node", F.monotonically_increasing_id().alias("id")))
        a, b = names.select(F.col("node").alias("src"), F.col("id").alias("s")), names.select(F.col("node").alias("dst"), F.col("id").alias("d"))
        e = cut(edges.join(a, "src").join(b, "dst").select("s", "d"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches]
        if not parts:
            return
        s, d = (np.concatenate(x) for x in zip(*parts, strict=True))
        parts.clear()
        ids = np.unique(np.concatenate([np.unique(s), np.unique(d)]))
        s, d = np.searchsorted(ids, s).astype(np.int32), np.searchsorted(ids, d).astype(np.int32)
        _, least, of, size = np.unique(strong(s, d, len(ids)), return_index=True, return_inverse=True, return_counts=True)
        on = np.flatnonzero(size[of] > 1)
        for i in range(0, len(on), 1 << 17):
            x = on[i : i + (1 << 17)]
            yield pa.RecordBatch.from_arrays([pa.array(ids[x]), pa.array(ids[least[of[x]]])], names=["node", "component"])

    got = cut(e.coalesce(1).mapInArrow(run, "node long, component long"))
    if whole:
        kind = nodes_of(edges).schema["node"].dataType
        return got.select(F.col("node").cast(kind).alias("node"), F.col("component").cast(kind).alias("component"))
    named = got.join(names.withColumnRenamed("node", "name"), got["node"] == names["id"]).select("name", "component")
    return named.join(named.groupBy("component").agg(F.min("name").alias("least")), "component").select(F.col("name").alias("node"), F.col("least").alias("component"))


def cycles(edges: DataFrame) -> DataFrame:
    """node, component of the nodes that lie on a cycle: nodes that reach each other, named by the least of them.

    What is left of the graph, all of it at first, is done by one task in linear time if it has no more than IN_ONE_TASK edges. Of a larger
    one, each round every node takes the least node that reaches it as its colour; of a colour, those that reach its name backwards along edges
    of that colour are one component, and leave the graph. Only a colour a node is kept, never what each reaches."""
    e = cut(edges.where("src IS NOT NULL AND dst IS NOT NULL").select("src", "dst").distinct())
    loops = e.where("src = dst").select(F.col("src").alias("node"), F.col("src").alias("component"))
    found = []
    rest = cut(e.where("src <> dst"))
    while True:
        if rest.count() <= IN_ONE_TASK:
            found.append(in_one_task(rest))
            break
        # what nothing points to, or what points to nothing, lies on no cycle
        rest, last = cut(rest.join(rest.select(F.col("dst").alias("src")).distinct(), "src", "left_semi").join(rest.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi")), rest
        spent(last)
        if rest.isEmpty():
            break
        colour = cut(nodes_of(rest).select("node", F.col("node").alias("colour"), F.lit(True).alias("moved")))
        while not colour.where("moved").isEmpty():
            step = rest.join(colour.where("moved").select(F.col("node").alias("src"), "colour"), "src").groupBy(F.col("dst").alias("node")).agg(F.min("colour").alias("new"))
            less = F.col("new") < F.col("colour")
            colour, last = cut(colour.join(step, "node", "left").select("node", F.when(less, F.col("new")).otherwise(F.col("colour")).alias("colour"), F.coalesce(less, F.lit(False)).alias("moved"))), colour
            spent(last)
        a, b = colour.select(F.col("node").alias("src"), "colour"), colour.select(F.col("node").alias("dst"), F.col("colour").alias("other"))
        inside = cut(rest.join(a, "src").join(b, "dst").where("colour = other").select("src", "dst", "colour"))
        front = cut(colour.where("node = colour").select("node", F.col("colour").alias("component")))
        parts, member = [front], front
        while not front.isEmpty():
            back = inside.join(front.select(F.col("node").alias("dst"), "component"), "dst").select(F.col("src").alias("node"), "component").distinct()
            front = cut(back.join(member, "node", "left_anti"))
            parts.append(front)
            member = reduce(DataFrame.unionByName, parts)
        member = cut(member)
        several = member.groupBy("component").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("component")
        found.append(member.join(several, "component", "left_semi").select("node", "component"))
        gone = member.select("node")
        rest, last = cut(rest.join(gone.withColumnRenamed("node", "src"), "src", "left_anti").join(gone.withColumnRenamed("node", "dst"), "dst", "left_anti")), rest
        spent(last, inside, colour, *parts)
    out = reduce(DataFrame.unionByName, found, loops)
    return out.groupBy("node").agg(F.min("component").alias("component"))


def graph_boosts(scores: DataFrame, edges: DataFrame, nodes: DataFrame | None = None, hop1: float = 0.40, hop2: float = 0.15) -> DataFrame:
    """node, score with the boosts of neighbours, from the scores as they came: hop1 for each neighbour with a score, hop2 for each such
    neighbour's neighbour if it has a score. Hubs give and take none."""
    hub = hubs(edges, nodes).select("node")
    e = edges.where("src <> dst").select("src", "dst").distinct()
    e = e.unionByName(reverse(e)).distinct().join(hub.withColumnRenamed("node", "src"), "src", "left_anti").join(hub.withColumnRenamed("node", "dst"), "dst", "left_anti")
    seed = scores.where("score > 0").select(F.col("node").alias("src"))
    first = e.join(seed, "src").groupBy(F.col("dst").alias("node")).agg((F.count(F.lit(1)) * hop1).alias("b1"))
    second = e.join(first.select(F.col("node").alias("src")), "src").join(first.select(F.col("node").alias("dst")), "dst", "left_anti").groupBy(F.col("dst").alias("node")).agg((F.count(F.lit(1)) * hop2).alias("b2"))
    s = scores.join(first, "node", "left").join(second, "node", "left")
    return s.select("node", (F.col("score") + F.coalesce("b1", F.lit(0.0)) + F.when(F.col("score") > 0, F.coalesce("b2", F.lit(0.0))).otherwise(0.0)).alias("score"))


def blended(scores: DataFrame, rank: DataFrame, weight: float = 0.3) -> DataFrame:
    """Scores plus weight times the centrality, where there is a score."""
    return scores.join(rank, "node", "left").select("node", F.when(F.col("score") > 0, F.col("score") + weight * F.coalesce("rank", F.lit(0.0))).otherwise(F.col("score")).alias("score"))


def call_files(calls: DataFrame, defs: DataFrame) -> DataFrame:
    """Calls (caller, callee) as distinct file pairs in both directions, without those inside a file. defs: sym_id, file."""
    a = defs.select(F.col("sym_id").alias("caller"), F.col("file").alias("src"))
    b = defs.select(F.col("sym_id").alias("callee"), F.col("file").alias("dst"))
    e = calls.join(a, "caller").join(b, "callee").where("src <> dst").select("src", "dst")
    return e.unionByName(reverse(e)).distinct()


def resolve_calls(uses: DataFrame, defs: DataFrame, imports: DataFrame, packages: DataFrame | None = None) -> DataFrame:
    """uses: caller, file, name; defs: sym_id, file, name; imports: file, target, priority; packages: file, package of files that share names. Each
    use goes to the definitions of its own file, else to those of the first import that has any, else to those of its package.
    Returns caller, callee without self edges."""
    own = uses.join(defs, ["file", "name"]).select("caller", "name", F.col("sym_id").alias("callee"))
    rest = uses.join(defs.select("file", "name").distinct(), ["file", "name"], "left_anti")
    far = rest.join(imports, "file").join(defs.select(F.col("file").alias("target"), "name", "sym_id"), ["target", "name"])
    first = far.groupBy("caller", "name").agg(F.min("priority").alias("priority"))
    far = far.join(first, ["caller", "name", "priority"]).select("caller", "name", F.col("sym_id").alias("callee"))
    out = own.unionByName(far)
    if packages is not None:
        near = rest.join(first.select("caller", "name"), ["caller", "name"], "left_anti").join(packages, "file").join(defs.join(packages, "file").select("package", "name", "sym_id"), ["package", "name"])
        out = out.unionByName(near.select("caller", "name", F.col("sym_id").alias("callee")))
    return out.where("caller <> callee").select("caller", "callee").distinct()


def routes_into_signatures(sig_index: DataFrame, routes: DataFrame) -> DataFrame:
    """sig_index (path, sigs) with a line `route METHOD path` for each route (method, path, file), sorted, none twice."""
    r = routes.groupBy(F.col("file").alias("path")).agg(F.array_sort(F.collect_set(F.concat_ws(" ", F.lit("route"), "method", "path"))).alias("more"))
    return sig_index.join(r, "path", "left").select("path", F.when(F.col("more").isNull(), F.col("sigs")).otherwise(F.array_union("sigs", "more")).alias("sigs"))
