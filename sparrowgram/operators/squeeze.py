"""Compression of logs, stack traces and JSON. What classifies and cuts logs is Column work on arrays of lines; only the recursive JSON
cut is Python."""

from __future__ import annotations

import json

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

SPOT, HMS, YMD = r"(?::\d+){2}", r"\d{1,2}(?::\d\d){2}", r"\d{4}(?:-\d\d){2}"
AT, FRACTION = r"^\s*at\s+", r"(?:[,.]\d+)?"
FRAMES = [
    AT + rf".+\(.+{SPOT}\)\s*$", AT + rf".+{SPOT}\s*$", AT + r"[<>.$\w]+\(.+[.]\w+:\d+\)",
    r'^\s*File[\t ]+".+",[\t ]+line[\t ]+\d+', r"^\s+\w.*\([^)]*[.](rs|go):\d+\)", r"^\s*#\d+[\t ]+0x[\da-f]+",
]
HEADERS = "|".join([r"Traceback [(]most recent call last[)]", "Exception in thread", r"\bat Object[.]<anonymous>", "thread '.*' panicked at", "(?m)^panic:", r"goroutine \d+ \["])
CLOCK = rf"\b{HMS}\b|{YMD}[T ]{HMS}"
PROGRESS = "|".join([r"\d{1,3}%", r"\b(?:ETA|Downloading)\b", r"\bnpm (?:http|notice|WARN)\b", r"##\[(?:command|group|endgroup)\]", r"\[\d+/\d+\]", "[━█▕⠿]", r"\r\z"])
CLOCK_PREFIX = rf"^(?:\s*\[?(?:{YMD}[T ])?{HMS}{FRACTION}Z?\]?)+\s*"
STEPS = "Compressing objects|Receiving objects|Resolving deltas|Downloading"
NOISE = rf"(?:^|\s)(?:{STEPS}|\d{{1,3}}%|npm (?:http|notice|sill|verb|WARN)|##\[(?:command|endgroup|group|section)\]|\[\d+/\d+\]|ETA[ :]|[⣿▕━█])"
ERROR = r"(?i)\b(?:err!|err_|error|exception|fail(?:ed|ure)?|fatal|panic|traceback|e[a-z]{3,})\b|[✗❌]"
ERROR_STRICT = r"(?i)\b(?:err!|error|exception|fail(?:ed|ure)?|fatal|panic|traceback)\b"
VENDOR = r"(?:^|/)(?:\.cargo|\.venv|build|dist|external|go/pkg/mod|node_modules|site-packages|third_party|vendor|venv)/"


def two(c: Column) -> Column:
    return F.round(c, 2)


def classified(docs: DataFrame, key: str, text: Column) -> DataFrame:
    """key, category (stacktrace, cilog, json or null), confidence."""
    whole = F.coalesce(text, F.lit(""))
    d = docs.select(key, whole.alias("t"), F.split(whole, "\n").alias("ls"))
    frames = F.size(F.filter("ls", lambda x: x.rlike("|".join(f"(?:{p})" for p in FRAMES))))
    header = F.col("t").rlike(T.java(HEADERS))
    norm = F.filter(F.transform("ls", lambda x: F.trim(F.regexp_replace(x, r"\d+", "#"))), lambda x: x != "")
    n = F.size("ls")
    logish = F.size(F.filter("ls", lambda x: x.rlike(T.java(f"{CLOCK}|{PROGRESS}")))) / n
    repeats = (F.size(norm) - F.size(F.array_distinct(norm))) / n
    trimmed = F.trim(F.col("t"))
    parsed = trimmed.rlike(r"\A[\[{]") & F.expr("try_parse_json(trim(t)) IS NOT NULL")
    tl = F.split(trimmed, "\n")
    kv = F.size(F.filter(tl, lambda x: x.rlike(r'^\s*"[^"]+"\s*:.*\S|^\s*[\]}],?\s*$'))) / F.size(tl)
    d = d.select(key, (F.trim("t") == "").alias("blank"), frames.alias("fr"), header.alias("hd"), n.alias("n"), F.greatest(logish, repeats).alias("ci"), parsed.alias("js"), F.size(tl).alias("tn"), kv.alias("kv"))
    st, ci = F.col("hd") | (F.col("fr") >= 2), (F.col("n") >= 8) & (F.col("ci") >= 0.4)
    js = F.col("js") | ((F.col("tn") >= 4) & (F.col("kv") >= 0.6))
    least = F.least(F.lit(0.97), 0.15 * F.col("fr"))
    trace = two(F.when(F.col("hd"), F.greatest(least, 0.6 + F.least(F.lit(0.3), 0.05 * F.col("fr")))).otherwise(least))
    category = F.when(F.col("blank"), None).when(st, "stacktrace").when(ci, "cilog").when(js, "json")
    confidence = F.when(F.col("blank"), 0.0).when(st, trace).when(ci, two(F.least(F.lit(0.95), F.col("ci") + 0.15))).when(F.col("js"), 0.95).when(js, two(F.least(F.lit(0.9), F.col("kv")))).otherwise(0.0)
    return d.select(key, category.alias("category"), confidence.alias("confidence"))


def error_context(docs: DataFrame, key: str, text: Column, around: int = 2, pattern: str = ERROR_STRICT) -> DataFrame:
    """key, pos (from 0), line of the lines within `around` of an error, clock prefixes removed. The array of lines is the state, so a long
    log needs no window."""
    d = docs.select(key, F.split(F.coalesce(text, F.lit("")), "\n").alias("ls"))
    e = F.filter(F.transform("ls", lambda x, i: F.when(x.rlike(T.java(pattern)), i)), lambda x: x.isNotNull())
    near = F.array_distinct(F.flatten(F.transform(e, lambda i: F.sequence(F.greatest(F.lit(0), i - around), F.least(F.size("ls") - 1, i + around)))))
    return d.select(key, "ls", F.explode(near).alias("pos")).select(key, "pos", F.regexp_replace(F.element_at("ls", F.col("pos") + 1), CLOCK_PREFIX, "").alias("line"))


def squeeze_log(docs: DataFrame, key: str, text: Column, around: int = 2) -> DataFrame:
    """key, squeezed: errors with their context and notes of what is left out; without errors the first and last ten lines."""
    schema = pa.schema([("key", pa.int64()), ("squeezed", pa.string())])

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([log_text(t or "", around) for t in b.column(1).to_pylist()])], schema=schema)

    return docs.select(F.col(key).cast("long").alias("key"), text.alias("t")).mapInArrow(run, "key long, squeezed string").withColumnRenamed("key", key)


def log_text(text: str, around: int = 2) -> str:
    import re

    error, noise, clock = re.compile(ERROR), re.compile(NOISE), re.compile(CLOCK_PREFIX)
    ls = text.split("\n")
    bad = [i for i, x in enumerate(ls) if error.search(x)]
    short = [clock.sub("", x) for x in ls]
    if not bad:
        return "\n".join(short if len(ls) <= 10 else short[:10] + ([f"… ({len(ls) - 20} lines omitted) …", *short[-10:]] if len(ls) > 20 else []))
    out, last = [], -2
    for i in sorted({j for i in bad for j in range(max(0, i - around), min(len(ls), i + around + 1))}):
        if noise.search(short[i]) and not error.search(short[i]):
            continue
        if i > last + 1:
            out.append(f"… ({i - last - 1} lines) …")
        out.append(short[i])
        last = i
    return "\n".join(out or [short[i] for i in bad])


def frames(docs: DataFrame, key: str, text: Column) -> DataFrame:
    """key, pos, fn, file, line, vendor for the stack frames of each text; of equal file and line the first."""
    d = docs.select(key, F.posexplode(F.split(F.coalesce(text, F.lit("")), "\n")).alias("pos", "raw"))
    forms = [(AT + rf"(.+?)\s+\((.+?):(\d+):\d+\)", 1, 2, 3), (AT + r"(.+?):(\d+):\d+\s*$", 0, 1, 2), (AT + r"([<>.$\w]+)\((.+?):(\d+)\)", 1, 2, 3), (r'^\s*File[\t ]+"(.+?)",[\t ]+line[\t ]+(\d+)(?:,[\t ]+in[\t ]+(.+))?', 3, 1, 2), (r"^\s*(.+[.](?:rs|go)):(\d+)", 0, 1, 2)]
    out = None
    for p, fn, file, line in forms:
        got = F.struct((F.regexp_extract("raw", p, fn) if fn else F.lit("")).alias("fn"), F.regexp_extract("raw", p, file).alias("file"), F.regexp_extract("raw", p, line).cast("int").alias("line"))
        out = F.when(F.col("raw").rlike(p), got) if out is None else out.when(F.col("raw").rlike(p), got)
    f = d.select(key, "pos", out.alias("f")).where("f IS NOT NULL").select(key, "pos", "f.*")
    return f.groupBy(key, "file", "line").agg(F.min(F.struct("pos", "fn")).alias("a")).select(key, "a.pos", "a.fn", "file", "line", F.translate("file", "\\", "/").rlike(VENDOR).alias("vendor"))


def squeeze_trace(docs: DataFrame, key: str, text: Column, source: str = "src", most: int = 8) -> DataFrame:
    """key, pos, fn, file, line of the frames shown: those of the source folder, else three that aren't vendored, else three."""
    f = frames(docs, key, text)
    tier = F.when(~F.col("vendor") & F.concat(F.lit("/"), F.col("file")).contains(f"/{source}/"), 0).when(~F.col("vendor"), 1).otherwise(2)
    f = f.withColumn("tier", tier)
    best = f.groupBy(key).agg(F.min("tier").alias("tier"))
    shown = f.join(best, [key, "tier"]).groupBy(key, "tier").agg(F.array_sort(F.collect_list(F.struct("pos", "fn", "file", "line"))).alias("fs"))
    return shown.select(key, F.explode(F.slice("fs", F.lit(1), F.when(F.col("tier") == 0, most).otherwise(3))).alias("x")).select(key, "x.*")


def with_signatures(shown: DataFrame, sigs: DataFrame) -> DataFrame:
    """Frames with the signature whose lines hold theirs, by base name and range; sigs: path, sig, start, end."""
    s = sigs.select(F.regexp_extract("path", r"[^/]*\z", 0).alias("base"), "path", "sig", "start", "end")
    f = shown.withColumn("base", F.regexp_extract("file", r"[^/]*\z", 0))
    j = f.join(s, "base", "left").withColumn("fits", F.col("line").between(F.col("start"), F.col("end")).cast("int"))
    keys = shown.columns
    return j.groupBy(*keys).agg(F.max_by("sig", F.struct("fits", "start")).alias("sig"), F.max("fits").alias("fits")).withColumn("sig", F.when(F.col("fits") == 1, F.col("sig"))).drop("fits")


def small_json(value, keep: int = 2, chars: int = 500):
    if isinstance(value, list):
        items = [small_json(v, keep, chars) for v in (value[:keep] if len(value) > keep + 1 else value)]
        return [*items, f"… {len(value) - keep} more items"] if len(value) > keep + 1 else items
    if isinstance(value, dict):
        return {k: small_json(v, keep, chars) for k, v in value.items()}
    return value[:chars] + "…" if isinstance(value, str) and len(value) > chars else value


def squeeze_json(docs: DataFrame, key: str, text: Column) -> DataFrame:
    """key, squeezed: long arrays and strings cut; text that isn't JSON as it is."""
    schema = pa.schema([("key", pa.int64()), ("squeezed", pa.string())])

    def one(t: str | None) -> str | None:
        try:
            return None if t is None else json.dumps(small_json(json.loads(t)), ensure_ascii=False)
        except ValueError:
            return t

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([one(t) for t in b.column(1).to_pylist()], pa.string())], schema=schema)

    return docs.select(F.col(key).cast("long").alias("key"), text.alias("t")).mapInArrow(run, "key long, squeezed string").withColumnRenamed("key", key)


def reduction(before: Column, after: Column) -> Column:
    """The part of the tokens saved, 4 digits."""
    tokens = lambda c: F.ceil(F.length(c) / 4)
    return F.when(tokens(before) > 0, F.round(1 - tokens(after) / tokens(before), 4)).otherwise(0.0)
