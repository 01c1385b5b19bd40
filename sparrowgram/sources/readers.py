"""Sources: folders, context files, logs, tasks and manifests as DataFrames."""

from __future__ import annotations

import json
import re

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .imports import import_edges, import_targets, packages

SKIPPED = (".git", "__pycache__", "build", "dist", "node_modules", "target", "venv")


def files(spark: SparkSession, root: str, endings: tuple[str, ...] = (), depth: int = 0, skipped: tuple[str, ...] = SKIPPED) -> DataFrame:
    """path (below root), path_key, ext, mtime, size, content. Content is read only if it is selected; endings prune files before that."""
    r = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if endings:
        r = r.option("pathGlobFilter", "*.{" + ",".join(endings) + "}")
    base = root.rstrip("/").removeprefix("file://")
    rel = F.regexp_replace("path", rf"^(?:file:/*)?/?{re.escape(base.lstrip('/'))}/", "")
    d = r.load(root).select(rel.alias("path"), F.col("modificationTime").alias("mtime"), F.col("length").alias("size"), F.decode("content", "UTF-8").alias("content"))
    d = d.where(~F.arrays_overlap(F.split("path", "/"), F.array(*map(F.lit, skipped))))
    if depth:
        d = d.where(F.size(F.split("path", "/")) <= depth)
    return d.select("path", F.lower("path").alias("path_key"), F.lower(F.regexp_extract("path", r"\.([^./]+)\z", 1)).alias("ext"), "mtime", "size", "content")


def unignored(f: DataFrame, patterns: list[str]) -> DataFrame:
    """Without the paths that patterns name: exactly, or `x/**` and `x/*` by folder; # starts a comment."""
    out = f
    for p in (x.strip() for x in patterns):
        if p and not p.startswith("#"):
            stem = re.sub(r"/\*\*?\Z", "", p.rstrip("/"))
            out = out.where(~((F.col("path") == stem) | F.col("path").startswith(stem + "/")))
    return out


def changed(f: DataFrame, known: DataFrame) -> DataFrame:
    """Files that are new or whose mtime differs from the known (path, mtime)."""
    return f.join(known.select("path", F.col("mtime").alias("seen")), "path", "left").where("seen IS NULL OR mtime <> seen").drop("seen")


def line_range(f: DataFrame, start: int, end: int) -> DataFrame:
    """path, line, text of the lines from start to end, whichever is less first."""
    a, b = max(1, min(start, end)), max(start, end)
    return f.select("path", F.posexplode(F.split("content", "\n")).alias("i", "text")).where(F.col("i").between(a - 1, b - 1)).select("path", (F.col("i") + 1).alias("line"), "text")


def context_index(docs: DataFrame, key: str = "doc", text: str = "text", marker: str = "## Auto-generated signatures") -> DataFrame:
    """key, path, ordinal, sigs of a context in Markdown: `### path` and a fenced block each, after the marker if there is one."""
    body = F.when(F.instr(text, marker) > 0, F.substring_index(text, marker, -1)).otherwise(F.col(text))
    p = r"(?m)^###\s+(\S+)\s*\n+```\w*\n((?:(?!```)[^\n]*\n)*)```"
    z = F.arrays_zip(F.regexp_extract_all(body, F.lit(p), 1).alias("p"), F.regexp_extract_all(body, F.lit(p), 2).alias("s"))
    x = docs.select(key, F.posexplode(z).alias("ordinal", "z"))
    return x.select(key, F.col("z.p").alias("path"), "ordinal", F.filter(F.split("z.s", "\n"), lambda s: F.trim(s) != "").alias("sigs"))


def merged_index(first: DataFrame, second: DataFrame) -> DataFrame:
    """path, sigs: the longer list of signatures of either, the first's among equals."""
    u = first.select("path", "sigs", F.lit(1).alias("r")).unionByName(second.select("path", "sigs", F.lit(0).alias("r")))
    return u.groupBy("path").agg(F.max_by("sigs", F.struct(F.size("sigs"), "r")).alias("sigs"))


USAGE = "ts timestamp, op string, baseline_tokens long, actual_tokens long, raw_tokens long, final_tokens long, duration_ms long, model string, ok boolean"


def ndjson(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of a log of JSON lines; broken lines are dropped."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def append_ndjson(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").json(path)


def tasks(spark: SparkSession, path: str) -> DataFrame:
    """id, query, expected, repo of a task file; rows without a query or expected files are left out, ids default to the number of the row kept."""
    d = spark.read.schema("id string, query string, expected_files array<string>, repo string").json(path).where("query IS NOT NULL AND expected_files IS NOT NULL")
    n = F.row_number().over(Window.orderBy(F.monotonically_increasing_id()))  # a task file is small
    return d.select(F.coalesce("id", n.cast("string")).alias("id"), "query", F.col("expected_files").alias("expected"), "repo")


def strip_jsonc(text: str) -> str:
    """JSON without comments and trailing commas; strings are left alone."""
    keep = re.sub(r'("(?:[^"\\]|\\.)*")|//[^\n]*|/\*.*?\*/', lambda m: m[1] or "", text, flags=re.S)
    return re.sub(r'("(?:[^"\\]|\\.)*")|,(?=\s*[}\]])', lambda m: m[1] or "", keep, flags=re.S)


def manifest(name: str, text: str) -> dict:
    """name, version and dependencies of package.json, pyproject.toml, Cargo.toml, go.mod or DESCRIPTION; {} where it can't be read."""
    try:
        if name.endswith(".json"):
            j = json.loads(strip_jsonc(text))
            return {"name": j.get("name"), "version": j.get("version"), "dependencies": sorted({*(j.get("dependencies") or {}), *(j.get("devDependencies") or {}), *(j.get("require") or {})})}
        if name.endswith(".toml"):
            import tomllib

            j = tomllib.loads(text)
            p = j.get("project") or j.get("package") or (j.get("tool") or {}).get("poetry") or {}
            deps = p.get("dependencies") or j.get("dependencies") or []
            return {"name": p.get("name"), "version": p.get("version"), "dependencies": sorted(re.split(r"[\s<>=!~;\[]", d)[0] for d in deps)}
        if name.endswith("go.mod"):
            m = re.search(r"^module\s+(\S+)", text, re.M)
            return {"name": m and m[1], "version": None, "dependencies": sorted(re.findall(r"^\s*(?:require\s+)?([\w./-]+\.[\w./-]+)\s+v", text, re.M))}
        if name.endswith("DESCRIPTION"):
            fields = {k: " ".join(v.split()) for k, v in re.findall(r"^(\w+):((?:[^\n]*\n?)(?:[ \t]+[^\n]*\n?)*)", text, re.M)}
            deps = ",".join(fields.get(k, "") for k in ("Depends", "Imports", "Suggests"))
            return {"name": fields.get("Package"), "version": fields.get("Version"), "dependencies": sorted({re.split(r"[\s(]", d.strip())[0] for d in deps.split(",") if d.strip()} - {"R"})}
    except (ValueError, AttributeError, TypeError):
        pass
    return {}


def ranked_roots(f: DataFrame, most: int = 6) -> DataFrame:
    """folder, score of the likely source roots: top folders by their share of code, known names first, tests and docs last."""
    top = F.when(F.instr("path", "/") > 0, F.substring_index("path", "/", 1)).otherwise(".")
    code = F.col("path").rlike(r"\.(c|cc|cpp|cs|dart|go|java|js|jsx|kt|php|py|r|rb|rs|scala|swift|ts|tsx)\z").cast("int")
    g = f.groupBy(top.alias("folder")).agg(F.sum(code).alias("n_code"), F.count(F.lit(1)).alias("n"))
    score = F.col("n_code") * 1.0 + F.when(F.col("folder").isin("app", "cmd", "lib", "packages", "pkg", "source", "src"), 10).otherwise(0) + F.col("n_code") / F.col("n") - F.when(F.col("folder").rlike("(?i)^(docs?|examples?|fixtures|tests?)$"), 10).otherwise(0)
    return g.withColumn("score", score).where("n_code > 0 AND score > 0").orderBy(F.col("score").desc(), "folder").limit(most).select("folder", "score")


def language_weights(f: DataFrame) -> DataFrame:
    """ext, weight: share of files, divided by the largest, 2 digits."""
    g = f.groupBy("ext").agg(F.count(F.lit(1)).alias("n"))
    return g.withColumn("weight", F.round(F.col("n") / F.max("n").over(Window.partitionBy()), 2)).select("ext", "weight")
