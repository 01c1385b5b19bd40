"""Claims of an answer against an index: parsing, anti-joins, and the closest known name."""

from __future__ import annotations

import builtins
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources.durable import cut

EXTENSIONS = "c cc cpp cs css dart go h html java js json jsx kt md mjs php py r rb rs scala sh sql svelte swift toml ts tsx vue xml yaml yml".split()
PATH = rf"(?<![\w/.-])((?:[\w.-]+/)*[\w.-]+\.(?:{'|'.join(EXTENSIONS)}))(?![\w/-])"
PLACEHOLDER = r"(?i)(^|/)(example|foo|bar|baz|my[-_]?file|path/to|your[-_])"
SYMBOL = r"`([A-Za-z_$][\w$.]*)\([^`]*\)`"
SCRIPT = r"\bnpm (?:run |run-script )([\w:.-]+)"
IMPORT_JS = r"""(?:\bfrom\s+|\bimport\s+|\brequire\(\s*|\bimport\(\s*)['"]([^'"]+)['"]"""
IMPORT_PY = r"^\s*(?:from\s+([\w.]+)\s+import\b|import\s+([\w.]+))"


def lines(answers: DataFrame, key: str, text: Column) -> DataFrame:
    """key, line (from 1), content, fenced: whether the line is inside a closed code block. The count of fences decides, so each
    answer is one array and no window is needed."""
    a = answers.select(key, F.split(F.coalesce(text, F.lit("")), "\n").alias("ls"))
    fence = F.transform("ls", lambda x: x.rlike(r"^\s*```").cast("int"))
    a = a.withColumn("f", fence).withColumn("total", F.aggregate("f", F.lit(0), lambda s, x: s + x))
    a = a.withColumn("opened", F.slice(F.aggregate("f", F.array(F.lit(0)), lambda s, x: F.array_append(s, F.element_at(s, -1) + x)), 2, 1 << 30))
    x = a.select(key, "total", F.posexplode(F.arrays_zip("ls", "f", "opened")).alias("i", "r"))
    n = F.col("r.opened")
    inside = (n % 2 == 1) & (F.col("r.f") == 0) & ((F.col("total") % 2 == 0) | (n < F.col("total")))
    return x.select(key, (F.col("i") + 1).alias("line"), F.col("r.ls").alias("content"), inside.alias("fenced"))


def claims(ls: DataFrame, key: str) -> DataFrame:
    """key, kind (file, symbol, script, import, python-import), value, line: each value where it is first claimed."""
    found = lambda kind, pattern, i=1: ls.select(key, F.lit(kind).alias("kind"), F.explode(F.regexp_extract_all("content", F.lit(pattern), i)).alias("value"), "line")
    # a Python import of a library can't be checked without it: it is a claim of its own kind, which issues() never flags
    out = found("file", PATH).where(~F.col("value").rlike(PLACEHOLDER)).unionByName(found("symbol", SYMBOL)).unionByName(found("script", SCRIPT))
    code = ls.where("fenced")
    js = code.select(key, F.lit("import").alias("kind"), F.explode(F.regexp_extract_all("content", F.lit(IMPORT_JS), 1)).alias("value"), "line")
    module = F.concat(F.regexp_extract("content", IMPORT_PY, 1), F.regexp_extract("content", IMPORT_PY, 2))
    py = code.select(key, F.when(module.startswith("."), "import").otherwise("python-import").alias("kind"), module.alias("value"), "line")
    return out.unionByName(js).unionByName(py).where("value <> ''").groupBy(key, "kind", "value").agg(F.min("line").alias("line"))


def symbols_of(sigs: DataFrame, sig: str = "sig") -> DataFrame:
    """Distinct identifiers of signatures: name."""
    return sigs.select(F.explode(F.regexp_extract_all(sig, F.lit(r"[A-Za-z_$][\w$]*"), 0)).alias("name")).distinct()


def shorter(c: Column, deletions: int) -> Column:
    """c and all that is left of it after at most 1 or 2 deletions."""
    one = lambda x: F.transform(F.sequence(F.lit(1), F.length(x)), lambda i: F.concat(F.substr(x, F.lit(1), i - 1), F.substr(x, i + 1, F.length(x))))
    first = F.array_distinct(one(c))
    return F.array_distinct(F.concat(F.array(c), first)) if deletions == 1 else F.array_distinct(F.concat(F.array(c), first, F.flatten(F.transform(first, one))))


def closest(wanted: DataFrame, names: DataFrame, value: str = "value", name: str = "name", least: int = 3, salts: int = 16) -> DataFrame:
    """value, suggestion, distance, confidence: the known name nearest by edits, at most half the value's length and at least 1; ties go
    to the shorter, then the first. Names one edit, then two edits away share what is left after as many deletions, and are met by that alone.
    Only values without any such name meet the names of each length within their bound; each length is spread over salts."""
    w = cut(wanted.select(F.col(value).alias("v")).where(F.length("v") >= least).distinct().withColumn("cap", F.greatest(F.lit(1), F.ceil(F.length("v") * 0.5)).cast("int")))
    n = cut(names.select(F.col(name).alias("n")).where(F.length("n") >= least).distinct())

    def nearest(pairs: DataFrame) -> DataFrame:
        p = pairs.where(F.lower("v") != F.lower("n")).withColumn("distance", F.levenshtein(F.lower("v"), F.lower("n"))).where(F.col("distance") <= F.col("cap"))
        return p.groupBy("v").agg(F.min(F.struct("distance", F.length("n").alias("len"), "n")).alias("b"))

    parts = []
    for edits in (1, 2):
        a, b = w.withColumn("left", F.explode(shorter(F.lower("v"), edits))), n.withColumn("left", F.explode(shorter(F.lower("n"), edits)))
        got = cut(nearest(a.join(b, "left").select("v", "cap", "n")).where(F.col("b.distance") <= edits))
        parts.append(got)
        w = cut(w.join(got.select("v"), "v", "left_anti"))
    w = w.withColumn("len", F.explode(F.sequence(F.length("v") - F.col("cap"), F.length("v") + F.col("cap")))).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    far = n.withColumn("len", F.length("n")).withColumn("salt", F.pmod(F.xxhash64("n"), F.lit(salts)).cast("int"))
    best = parts[0].unionByName(parts[1]).unionByName(nearest(w.join(far, ["len", "salt"]).select("v", "cap", "n")))
    return best.select(F.col("v").alias(value), F.col("b.n").alias("suggestion"), F.col("b.distance").alias("distance"), T.suggestion_confidence(F.col("b.distance"), F.length("v")).alias("confidence"))


ISSUE = {"file": "fake-file", "symbol": "fake-symbol", "script": "fake-script", "import": "fake-import"}


#: Names that any program has.
GLOBALS = sorted({x for x in dir(builtins) if not x.startswith("_")} | set("Array BigInt Boolean Date Error Function Infinity JSON Map Math NaN Number Object Promise Proxy Reflect RegExp Set String Symbol WeakMap WeakSet alert clearInterval clearTimeout console document fetch globalThis module parseFloat parseInt process require setImmediate setInterval setTimeout super this undefined window".split()))
NODE_MODULES = "assert async_hooks buffer child_process cluster crypto dgram dns events fs http http2 https net os path perf_hooks process querystring readline stream string_decoder timers tls tty url util v8 vm worker_threads zlib".split()
TEST_PATH = r"(^|/)(__tests__|specs?|tests?)/|\.(spec|test)\.[a-z]+\z|(^|/)test_[^/]*\z|_test\.[a-z]+\z"


def issues(c: DataFrame, key: str, files: DataFrame, names: DataFrame, scripts: DataFrame, modules: DataFrame) -> DataFrame:
    """Claims with no match, with the nearest known value: key, type, value, line, suggestion, confidence. files: path; names, scripts,
    modules: name. Packages are only checked where a manifest names any, symbols where any are known; built-in ones always pass, as Python
    imports do. A relative import resolves by the base name of a file."""
    base = F.element_at(F.split("value", "[.]"), -1)
    file_names = files.select(F.explode(F.array_distinct(F.array("path", T.base_name(F.col("path"))))).alias("name")).distinct()
    stems = files.select(F.explode(F.array_distinct(F.array(T.base_name(F.col("path")), T.file_stem(F.col("path"))))).alias("name")).distinct()
    relative = F.col("value").startswith(".")
    package = F.regexp_extract("value", r"^(?:node:)?(@[^/]+/[^/]+|[^/]+)", 1)
    kinds = [
        ("file", file_names, F.col("value"), F.lit(True)), ("symbol", names, base, ~base.isin(GLOBALS)), ("script", scripts, F.col("value"), F.lit(True)),
        ("import", modules, package, ~relative & ~package.isin(NODE_MODULES)), ("import", stems, F.when(F.contains("value", F.lit("/")), F.regexp_replace(T.base_name(F.col("value")), r"\.[cm]?[jt]sx?\z", "")).otherwise(F.element_at(F.split("value", "[.]"), -1)), relative & (F.regexp_replace("value", "[./]", "") != "")),
    ]
    parts = []
    for kind, known, on, when in kinds:
        part = c.where((F.col("kind") == kind) & when).withColumn("probe", on)
        if kind in ("symbol", "import") and known is not stems:  # nothing to check against
            part = part.join(F.broadcast(known.select(F.lit(True).alias("any")).limit(1)))
        miss = part.join(known.select(F.col("name").alias("probe")), "probe", "left_anti")
        near = closest(miss.select(F.col("probe").alias("value")), known).withColumnRenamed("value", "probe")
        type_ = F.when(F.col("value").rlike(TEST_PATH), "fake-test-file").otherwise("fake-file") if kind == "file" else F.lit(ISSUE[kind])
        parts.append(miss.join(near, "probe", "left").select(key, type_.alias("type"), "value", "line", "suggestion", "confidence"))
    return reduce(DataFrame.unionByName, parts)


def summary(i: DataFrame, key: str) -> DataFrame:
    """Issues per answer by type, zero where there are none."""
    return i.groupBy(key).agg(*[F.sum((F.col("type") == t).cast("int")).alias(t.replace("-", "_")) for t in [*ISSUE.values(), "fake-test-file"]])


def grounded(c: DataFrame, contexts: DataFrame, key: str, context: str) -> DataFrame:
    """claims with grounded: whether the context has the value, or the base name of a file, whatever the case."""
    probe = F.lower(F.when(F.col("kind") == "file", T.base_name(F.col("value"))).otherwise(F.col("value")))
    return c.join(contexts.select(key, context), key).withColumn("grounded", F.contains(F.lower(F.col(context)), probe)).drop(context)


def signature_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """name-wise difference of (path, sig) tables: path, sig, change: added, removed; modified where a name is on both sides."""
    a, r = new.exceptAll(old).distinct().join(old, ["path", "sig"], "left_anti"), old.join(new, ["path", "sig"], "left_anti").distinct()
    both = a.withColumn("name", T.defined_symbol(F.col("sig"))).select("path", "name").intersect(r.withColumn("name", T.defined_symbol(F.col("sig"))).select("path", "name")).withColumn("m", F.lit(True))
    rows = a.withColumn("change", F.lit("added")).unionByName(r.withColumn("change", F.lit("removed")))
    return rows.withColumn("name", T.defined_symbol(F.col("sig"))).join(both, ["path", "name"], "left").select("path", "sig", F.when(F.col("m"), "modified").otherwise(F.col("change")).alias("change"))


def first_of(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Of rows alike in keys, the first."""
    return rows.withColumn("r", F.row_number().over(Window.partitionBy(*keys).orderBy(order))).where("r = 1").drop("r")
