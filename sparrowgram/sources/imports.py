"""Import edges between files (path, content), for JavaScript and TypeScript with aliases, Python, Go, Rust, Java, Kotlin, Scala, Ruby and R.

Every import yields the paths, or the endings of paths, that it may stand for, in order; the first that exists is its target. Both sides meet by
equi-joins: on the whole path, or on a path's ending for languages that import by package.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

JS_ENDS = ["", ".ts", ".tsx", ".js", ".jsx", ".mjs", ".cjs", "/index.ts", "/index.tsx", "/index.js"]
JS = r"""(?:\bfrom\s+|\bimport\s+|\brequire\(\s*|\bimport\(\s*)['"]([^'"]+)['"]"""
PYTHON = r"(?m)^\s*(?:from\s+([.\w]+)\s+import\b|import\s+([\w.]+))"
JVM_ENDS = ["java", "kt", "kts", "scala", "sc"]


def found(f: DataFrame, ends: str, pattern: str, group: int = 1, text: Column | None = None) -> DataFrame:
    """path, folder, at, spec: what a pattern finds in files with one of the endings, in order."""
    content = F.col("content") if text is None else text
    folder = F.regexp_extract("path", r"^(.*/)?[^/]*\z", 1)
    x = f.where(F.col("path").rlike(rf"(?i)\.({ends})\z")).select("path", folder.alias("folder"), F.posexplode(F.regexp_extract_all(content, F.lit(pattern), group)).alias("at", "spec"))
    return x.where("spec <> ''")


def tried(x: DataFrame, candidates: list[Column]) -> DataFrame:
    """path, at, spec, priority, c: a row for each candidate path; null ones are none."""
    return x.select("path", "at", "spec", F.posexplode(F.array(*candidates)).alias("priority", "c")).where("c IS NOT NULL")


def aliases(f: DataFrame) -> DataFrame:
    """prefix, wild, target, at of the path aliases of the root's tsconfig.json, else jsconfig.json; baseUrl comes last, with an empty prefix."""
    from .readers import strip_jsonc

    schema = pa.schema([("name", pa.string()), ("prefix", pa.string()), ("wild", pa.bool_()), ("target", pa.string()), ("at", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for name, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                try:
                    options = (json.loads(strip_jsonc(text or "")) or {}).get("compilerOptions") or {}
                except (ValueError, AttributeError):
                    continue
                base = options.get("baseUrl")
                for pattern, targets in (options.get("paths") or {}).items():
                    for t in targets if isinstance(targets, list) else []:
                        rows.append((name, pattern.split("*")[0], "*" in pattern, "/".join(x for x in (base or "", str(t).split("*")[0]) if x), len(rows)))
                if base:
                    rows.append((name, "", True, base.rstrip("/") + "/", len(rows)))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    a = f.where(F.col("path").isin("tsconfig.json", "jsconfig.json")).select("path", "content").mapInArrow(run, "name string, prefix string, wild boolean, target string, at int")
    first = a.agg(F.max("name").alias("first"))  # tsconfig before jsconfig
    return a.join(F.broadcast(first), F.col("name") == F.col("first")).select("prefix", "wild", "target", F.col("at").alias("alias_at"))


def normal(c: Column) -> Column:
    """a/b/../c and ./ resolved, by folding over the parts."""
    empty = F.expr("CAST(array() AS array<string>)")
    step = lambda s, x: F.when(x.isin(".", ""), s).when(x == "..", F.slice(s, F.lit(1), F.greatest(F.size(s) - 1, F.lit(0)))).otherwise(F.array_append(s, x))
    return F.array_join(F.aggregate(F.split(F.coalesce(c, F.lit("")), "/"), empty, step), "/")


def import_targets(f: DataFrame, package: str | None = None) -> DataFrame:
    """file, target, priority: what each file imports, in the order of its imports. package: the name of the R package that the files are."""
    f = f.select("path", "content")
    exact = []
    js = found(f, "[cm]?jsx?|[cm]?tsx?|vue|svelte", JS)
    exact.append(tried(js.where(F.col("spec").startswith(".")), [F.concat("folder", "spec", F.lit(e)) for e in JS_ENDS]))
    # one file's aliases: few rows
    named = js.where(~F.col("spec").startswith(".")).join(F.broadcast(aliases(f)), (F.col("wild") & F.col("spec").startswith(F.col("prefix"))) | (F.col("spec") == F.col("prefix")))
    to = F.concat("target", F.when(F.col("wild"), F.substr("spec", F.length("prefix") + 1)).otherwise(""))
    named = named.select("path", "at", "spec", "alias_at", F.posexplode(F.array(*[F.concat(to, F.lit(e)) for e in JS_ENDS])).alias("end", "c"))
    exact.append(named.select("path", "at", "spec", (F.col("alias_at") * len(JS_ENDS) + F.col("end")).alias("priority"), "c"))

    both = F.arrays_zip(F.regexp_extract_all("content", F.lit(PYTHON), 1).alias("a"), F.regexp_extract_all("content", F.lit(PYTHON), 2).alias("b"))
    folder = F.regexp_extract("path", r"^(.*/)?[^/]*\z", 1)
    py = f.where(F.col("path").rlike(r"\.pyw?\z")).select("path", folder.alias("folder"), F.posexplode(F.transform(both, lambda z: F.concat(z["a"], z["b"]))).alias("at", "spec")).where("spec <> ''")
    dots = F.length(F.regexp_extract("spec", r"^\.*", 0))
    module = F.translate(F.regexp_replace("spec", r"^\.+", ""), ".", "/")
    up = F.concat("folder", F.repeat(F.lit("../"), F.greatest(dots - 1, F.lit(0))))
    exact.append(tried(py, [F.when(w, F.concat(base, module, F.lit(e))) for w, base in ((dots > 0, up), (dots == 0, F.lit("")), (dots == 0, F.col("folder")), (dots == 0, F.concat("folder", F.lit("../")))) for e in (".py", "/__init__.py")]))

    mod = found(f, "rs", r"(?m)^\s*(?:pub\s+)?mod\s+(\w+)\s*;")
    for end in (".rs", "/mod.rs"):  # both count
        exact.append(tried(mod.withColumn("spec", F.concat("spec", F.lit(end))), [F.concat("folder", "spec")]))
    exact.append(tried(found(f, "rb", r"""(?m)^\s*require_relative\s+['"]([^'"]+)['"]"""), [F.concat("folder", "spec", F.when(F.col("spec").endswith(".rb"), "").otherwise(".rb"))]))
    plain_r = F.regexp_replace("content", "#[^\n]*", "")
    exact.append(tried(found(f, "r", r"""(?:^|[^\w.])source\s*\(\s*["']([^"']+)["']""", text=plain_r), [F.concat("folder", "spec"), F.col("spec")]))

    files = f.select(F.col("path").alias("dst"))
    c = reduce(DataFrame.unionByName, exact).withColumn("key", F.lower(normal(F.col("c"))))
    hit = c.join(files.withColumn("key", F.lower("dst")), "key").groupBy("path", "at", "spec").agg(F.min_by("dst", F.struct("priority", "dst")).alias("dst")).select("path", "at", "dst")

    # Go: a file of that name, or one in a folder of that name; the first in order
    quoted = found(f, "go", r'(?s)import\s*\(\s*(.*?)\s*\)|(?m)^\s*import\s+(?:\w+\s+)?"[^"]+"', 0).select("path", "at", F.explode(F.regexp_extract_all("spec", F.lit('"([^"]+)"'), 1)).alias("spec"))
    go_keys = F.concat(F.split("dst", "/"), F.array(F.regexp_extract("dst", r"([^/]+)\.go\z", 1)))
    go_files = files.where(F.col("dst").endswith(".go")).select("dst", F.explode(F.array_distinct(go_keys)).alias("key")).where("key <> '' AND NOT endswith(key, '.go')")
    go = quoted.withColumn("key", F.element_at(F.split("spec", "/"), -1)).join(go_files, "key").where("dst <> path").groupBy("path", "at", "spec").agg(F.min("dst").alias("dst")).select("path", "at", "dst")

    # Java, Kotlin, Scala: a file whose path ends as the name does; one of each ending
    jvm = found(f, "java|kts?|scala|sc", r"(?m)^\s*import\s+(?:static\s+)?([\w.]+)").withColumn("key", F.translate("spec", ".", "/"))
    pieces = F.split(F.regexp_replace("dst", r"\.[^.]+\z", ""), "/")
    ending = F.transform(F.sequence(F.lit(1), F.size(pieces)), lambda i: F.array_join(F.slice(pieces, i, F.size(pieces)), "/"))
    jvm_files = files.where(F.col("dst").rlike(r"\.(" + "|".join(JVM_ENDS) + r")\z")).select("dst", F.regexp_extract("dst", r"\.([^.]+)\z", 1).alias("end"), F.explode(ending).alias("key"))
    jvm = jvm.join(jvm_files, "key").groupBy("path", "at", "key", "end").agg(F.min("dst").alias("dst")).select("path", "at", "dst")

    out = [hit, go, jvm]
    if package:  # names of the package's own functions
        own = f.where(F.col("path").rlike(r"(?i)\.r\z")).select(F.col("path").alias("dst"), F.explode(F.regexp_extract_all(plain_r, F.lit(r"(?m)^[ \t]*([A-Za-z][\w.]*)\s*(?:<<-|<-|=)\s*function\b"), 1)).alias("spec")).groupBy("spec").agg(F.min("dst").alias("dst"))
        out.append(found(f, "r", rf"\b{package}:::?([A-Za-z][\w.]*)", text=plain_r).join(own, "spec").select("path", "at", "dst"))
    all_ = reduce(DataFrame.unionByName, out).where("path <> dst")
    return all_.groupBy(F.col("path").alias("file"), F.col("dst").alias("target")).agg(F.min("at").alias("priority"))


def import_edges(f: DataFrame, package: str | None = None) -> DataFrame:
    """src, dst: imports between files."""
    return import_targets(f, package).select(F.col("file").alias("src"), F.col("target").alias("dst"))


def packages(f: DataFrame) -> DataFrame:
    """file, package of files whose language shares names within a folder: Go, Java."""
    folder = F.regexp_extract("path", r"^(.*/)?[^/]*\z", 1)
    return f.where(F.col("path").rlike(r"\.(go|java)\z")).select(F.col("path").alias("file"), F.concat(folder, F.regexp_extract("path", r"[^.]*\z", 0)).alias("package"))
