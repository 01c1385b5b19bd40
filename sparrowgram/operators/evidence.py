"""Evidence packs, plans and reviews: compositions of ranking, graphs and risks."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T


def greedy(items: DataFrame, key: str, order: Column, cost: str, item: str, budget: int) -> DataFrame:
    """key, item, cost of what fits a budget, best first, ties by item: one too dear is skipped, later ones may still fit; the first always
    stays. Costs are whole numbers, a null or negative one is 0.

    What is left of a budget never grows, so of a key's items of equal cost those that are taken come first: of cost c only the first
    budget / c can be. All others go before anything is brought together, within each task first. At most budget * (1 + ln budget) rows a
    key are left to walk in order, however many it has, with a running sum."""
    f = items.select(F.col(key).alias("k"), order.alias("o"), F.col(item).alias("x"), F.greatest(F.coalesce(F.col(cost), F.lit(0)), F.lit(0)).cast("long").alias("c"))
    lead = f.groupBy("k").agg(F.min(F.struct("o", "x", "c")).alias("f"))
    # with a first one beyond the budget nothing else fits, not even what costs nothing
    free = f.where("c = 0").join(lead.where(F.col("f.c") > budget).select("k"), "k", "left_anti")
    w = Window.partitionBy("k", "c").orderBy("o", "x")
    dear = f.where(F.col("c") > 0).where(F.col("c") <= budget).withColumn("n", F.row_number().over(w)).where(F.col("n") <= budget).where(F.col("n") * F.col("c") <= budget).drop("n")
    over = lead.where(F.col("f.c") > budget).select("k", "f.*")
    rows = dear.unionByName(over.select("k", "o", "x", "c"))
    kept = rows.repartition("k").sortWithinPartitions("k", "o", "x").select("k", "x", "c").mapInArrow(_filled(budget), rows.select("k", "x", "c").schema)
    return kept.unionByName(free.select("k", "x", "c")).select(F.col("k").alias(key), F.col("x").alias(item), F.col("c").alias(cost))


def _filled(budget: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, used = None, 0
        for b in batches:
            keep = []
            for i, (k, c) in enumerate(zip(b.column(0).to_pylist(), b.column(2).to_pylist(), strict=True)):
                first = (k,) != now
                if first:
                    now, used = (k,), 0
                if first or used + c <= budget:
                    used += c
                    keep.append(i)
            yield b.take(pa.array(keep, pa.int64()))

    return run


def related_tests(files: DataFrame, path: str = "path") -> DataFrame:
    """path, test: tests whose stem names what they test; paths that are tests have none."""
    f = files.select(F.col(path).alias("path"), T.risk_factors(F.col(path))[0].alias("risk"))
    src = f.where("risk <> 'test'").select("path", F.lower(T.file_stem(F.col("path"))).alias("stem")).where("stem <> ''")
    tests = f.where("risk = 'test'").select(F.col("path").alias("test"), F.lower(T.tested_stem(F.col("path"))).alias("stem"))
    return src.join(tests, "stem").select("path", "test")


def missing_tests(changed: DataFrame) -> DataFrame:
    """Changed sources (path) with no changed test whose base name has their stem."""
    f = changed.select("path", T.risk_factors(F.col("path"))[0].alias("risk"))
    src = f.where("risk = 'source'").select("path", F.lower(T.file_stem(F.col("path"))).alias("stem"))
    tests = f.where("risk = 'test'").select(F.lower(T.base_name(F.col("path"))).alias("base")).distinct()
    # a base name that has the stem has its first three signs: both meet by those
    grams = F.flatten(F.transform(F.sequence(F.lit(1), F.length("base")), lambda i: F.array(*[F.substr("base", i, F.lit(n)) for n in (1, 2, 3)])))
    tests = tests.select("base", F.explode(F.array_distinct(grams)).alias("gram"))
    src = src.where("stem <> ''").withColumn("begin", F.substring("stem", 1, 3)).unionByName(src.where("stem = ''").withColumn("begin", F.lit(None).cast("string")))
    return src.join(tests, (F.col("begin") == F.col("gram")) & F.contains(F.col("base"), F.col("stem")), "left_anti").select("path")


SECURITY_PATH = r"(?i)(^|/)(\.env|\.github/workflows|auth|crypto|dockerfile|permissions?|secrets?|security)([./]|\z)"


def review(changed: DataFrame, contents: DataFrame, fan_in: DataFrame, most_in: int = 15, most_dirs: int = 5) -> DataFrame:
    """path, finding: what a reviewer should look at. changed: path; contents: path, content; fan_in: path, n_in."""
    out = missing_tests(changed).withColumn("finding", F.lit("missing-tests"))
    out = out.unionByName(changed.where(F.col("path").rlike(SECURITY_PATH)).select("path", F.lit("security-file").alias("finding")))
    found = contents.join(changed, "path").where(F.length("content") <= 2 << 20).withColumn("s", T.secret_name(F.col("content"))).where("s IS NOT NULL")
    out = out.unionByName(found.select("path", F.concat(F.lit("secret-detected: "), "s").alias("finding")))
    out = out.unionByName(changed.join(fan_in, "path").where(F.col("n_in") > most_in).select("path", F.lit("god-node").alias("finding")))
    dirs = changed.agg(F.count_distinct(F.regexp_extract("path", r"^(.*)/[^/]*\z", 1)).alias("n")).where(F.col("n") > most_dirs)
    return out.unionByName(dirs.select(F.lit(None).cast("string").alias("path"), F.concat(F.lit("scope-drift: "), F.col("n").cast("string"), F.lit(" directories")).alias("finding")))


def plan(ranked: DataFrame, dependents: DataFrame, each: int = 5) -> DataFrame:
    """path, role: entry (high confidence), support (medium), each at most so many, and impacted (what depends on entries)."""
    pick = lambda label, role: ranked.where(F.col("confidence") == label).orderBy(F.col("score").desc(), "path").limit(each).select("path", F.lit(role).alias("role"))
    entry = pick("high", "entry")
    hit = dependents.join(entry.select(F.col("path").alias("seed")), "seed").select(F.col("node").alias("path")).distinct().join(entry, "path", "left_anti")
    return entry.unionByName(pick("medium", "support")).unionByName(hit.select("path", F.lit("impacted").alias("role")))


def check_plan(steps: DataFrame, files: DataFrame, names: DataFrame, blast: DataFrame) -> DataFrame:
    """Findings on a plan's (path, symbol): missing-file and unknown-symbol are errors, high-blast and broad-scope warnings."""
    e = steps.select("path").distinct().join(files.select("path"), "path", "left_anti").select(F.col("path").alias("value"), F.lit("missing-file").alias("finding"), F.lit("error").alias("level"))
    s = steps.where("symbol IS NOT NULL").select(F.col("symbol").alias("name")).distinct().join(names, "name", "left_anti").select(F.col("name").alias("value"), F.lit("unknown-symbol"), F.lit("error"))
    b = steps.select(F.col("path").alias("seed")).distinct().join(blast, "seed").where(F.col("direct") + F.col("transitive") > 20).select("seed", F.lit("high-blast"), F.lit("warn"))
    n = steps.agg(F.count_distinct("path").alias("n")).where("n > 10").select(F.col("n").cast("string"), F.lit("broad-scope"), F.lit("warn"))
    return e.union(s).union(b).union(n)


def pack(ranked: DataFrame, key: str, sigs: DataFrame, files: DataFrame, budget: int, k: int = 12) -> DataFrame:
    """key, path, tokens, sigs (redacted), risk, tests, confidence, dropped, digest of the row's canonical JSON. ranked: key, path, score; sigs:
    path, sigs. The k best files of a key with a score are considered; those that the budget leaves out have dropped set and no sigs."""
    best = Window.partitionBy(key).orderBy(F.col("score").desc(), "path")
    r = ranked.where("score > 0").withColumn("r", F.row_number().over(best)).where(F.col("r") <= k).drop("r")
    r = r.join(sigs, "path").withColumn("tokens", T.token_estimate(F.col("sigs")))
    r = r.withColumn("confidence", T.half_up(F.col("score") / F.max("score").over(Window.partitionBy(key)), 2))
    kept = greedy(r, key, -F.col("score"), "tokens", "path", budget).select(key, "path", F.lit(False).alias("dropped"))
    tests = related_tests(files).groupBy("path").agg(F.array_sort(F.collect_set("test")).alias("tests"))
    out = r.select(key, "path", "tokens", "sigs", "confidence").join(kept, [key, "path"], "left").join(tests, "path", "left").withColumn("dropped", F.coalesce("dropped", F.lit(True)))
    none = F.expr("CAST(array() AS array<string>)")
    out = out.select(key, "path", "tokens", F.when(F.col("dropped"), none).otherwise(F.transform("sigs", T.redacted)).alias("sigs"), T.risk_factors(F.col("path")).alias("risk"), F.coalesce("tests", none).alias("tests"), "confidence", "dropped")
    fields = sorted(["path", "tokens", "sigs", "risk", "tests", "confidence", "dropped"])
    return out.withColumn("digest", F.sha2(F.to_json(F.struct(*fields)), 256))


def modules(files: DataFrame, path: str = "path", tokens: str = "tokens") -> DataFrame:
    """module (first folder or `.`), files, tokens."""
    m = F.when(F.instr(path, "/") > 0, F.substring_index(path, "/", 1)).otherwise(".")
    return files.groupBy(m.alias("module")).agg(F.count(F.lit(1)).alias("files"), F.sum(tokens).alias("tokens"))


def coverage(files: DataFrame, indexed: DataFrame) -> DataFrame:
    """module, total, included, pct, grade of files (path) in the index."""
    m = F.when(F.instr("path", "/") > 0, F.substring_index("path", "/", 1)).otherwise(".")
    f = files.select("path").distinct().join(indexed.select("path").distinct().withColumn("i", F.lit(1)), "path", "left")
    g = f.groupBy(m.alias("module")).agg(F.count(F.lit(1)).alias("total"), F.sum(F.coalesce("i", F.lit(0))).alias("included"))
    pct = F.floor(F.col("included") * 100 / F.col("total") + 0.5)
    return g.withColumn("pct", pct).withColumn("grade", T.grade(pct))


def effective_budget(total: Column, target: float = 0.8, least: int = 4000, limit: int = 128_000, headroom: float = 0.2) -> Column:
    """Tokens to spend on a context: a part of all there are, within bounds."""
    return F.least(F.floor(F.lit(limit * headroom)), F.greatest(F.lit(least), F.ceil(total * target)))
