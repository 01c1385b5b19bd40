"""The tools as one dispatcher over JSON-RPC: each is a bounded query of an index held as DataFrames."""

from __future__ import annotations

import inspect
import json
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import evidence, extract, graph, retrieval, squeeze, verify
from ..sources import readers

MOST = 200


@dataclass
class Index:
    """files: path, content; built once, the rest derives from it lazily."""

    spark: SparkSession
    files: DataFrame
    notes: list[dict] = field(default_factory=list)
    session: dict | None = None
    added: dict[str, list[str]] = field(default_factory=dict)
    deleted: set[str] = field(default_factory=set)

    @property
    def sigs(self) -> DataFrame:
        s = extract.signatures(self.files).where(~F.col("path").isin(list(self.deleted))) if self.deleted else extract.signatures(self.files)
        if self.added:
            more = self.spark.createDataFrame([(p, 10**6 + i, x) for p, xs in self.added.items() for i, x in enumerate(xs)], "path string, pos int, sig string")
            s = s.unionByName(more)
        return s

    @property
    def index(self) -> DataFrame:
        return self.sigs.groupBy("path").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "sig"))), lambda x: x["sig"]).alias("sigs"))

    @property
    def edges(self) -> DataFrame:
        return readers.import_edges(self.files)


def rows(df: DataFrame, most: int = MOST) -> list[dict]:
    """The first rows, as an answer is for a reader; where there are more, a last row says how many."""
    got = [r.asDict(recursive=True) for r in df.limit(most + 1).collect()]
    return got if len(got) <= most else [*got[:most], {"note": f"the first {most} of {df.count()} rows"}]


def ranked(ix: Index, query: str) -> DataFrame:
    q = ix.spark.createDataFrame([(0, query)], "q long, query string")
    i = ix.index.withColumn("text", F.array_join("sigs", " "))
    s = retrieval.bm25(i, "path", F.col("text"), q, "q", F.col("query"), expand=True, path=F.col("path"))
    return retrieval.confident(s.withColumn("score", F.col("score") * T.path_penalty(F.col("path"))), "q")


def _seed(ix: Index, value: str) -> DataFrame:
    return ix.spark.createDataFrame([(value,)], "seed string")


def _calls(ix: Index) -> tuple[DataFrame, DataFrame]:
    defs, uses = extract.call_table(ix.files)
    return defs, graph.resolve_calls(uses, defs, readers.import_targets(ix.files), readers.packages(ix.files))


def read_context(ix: Index, module: str = "") -> list[dict]:
    return rows(ix.index.where(F.col("path").contains(module)).orderBy("path"))


def search_signatures(ix: Index, query: str) -> list[dict]:
    return rows(ix.sigs.where(F.contains(F.lower("sig"), F.lit(query.lower()))).groupBy("path").agg(F.array_sort(F.collect_list("sig")).alias("sigs")).orderBy("path"))


def get_map(ix: Index) -> dict:
    f = ix.files
    return {"imports": rows(ix.edges), "routes": rows(extract.routes(f)), "classes": rows(extract.classes(f)), "env": rows(extract.env_names(f)), "migrations": rows(extract.migrations(f)), "cycles": rows(graph.cycles(ix.edges)), "modules": list_modules(ix)}


def create_checkpoint(ix: Index, note: str = "") -> dict:
    return {"note": note, "files": ix.files.count(), "signatures": ix.sigs.count()}


def get_routing(ix: Index) -> list[dict]:
    return rows(ix.index.select("path", T.routing_tier(F.col("path"), F.col("sigs")).alias("tier")).orderBy("tier", "path"))


def explain_file(ix: Index, path: str) -> dict:
    e = ix.edges
    return {"signatures": rows(ix.sigs.where(F.col("path") == path).orderBy("pos")), "imports": rows(e.where(F.col("src") == path)), "imported_by": rows(e.where(F.col("dst") == path))}


def list_modules(ix: Index) -> list[dict]:
    return rows(evidence.modules(ix.index.withColumn("tokens", T.token_estimate(F.col("sigs")))).orderBy(F.col("tokens").desc(), "module"))


def query_context(ix: Index, query: str, topK: int = 10) -> list[dict]:  # noqa: N803
    k = max(1, min(25, int(topK) or 10))
    q = ix.spark.createDataFrame([(0, query)], "q long, query string")
    if q.where(F.size(T.ranker_tokens(F.col("query"))) > 0).isEmpty():
        return rows(retrieval.without_words(q, "q", F.col("query"), ix.index, "path", F.size("sigs"), k).orderBy(F.col("score").desc(), "path"), k)
    return rows(ranked(ix, query).orderBy(F.col("score").desc(), "path").limit(k), k)


def get_method_impact(ix: Index, symbol: str, depth: int = 0) -> dict:
    defs, calls = _calls(ix)
    ids = [r.sym_id for r in defs.where((F.col("sym_id") == symbol) | (F.col("name") == symbol)).limit(MOST).collect()]
    if not ids:
        return {"unresolved": True, "impact": []}
    e = calls.select(F.col("caller").alias("src"), F.col("callee").alias("dst"))
    return {"unresolved": False, "impact": rows(graph.impact(e, ix.spark.createDataFrame([(i,) for i in ids], "seed string"), depth))}


def get_impact(ix: Index, path: str, depth: int = 3) -> list[dict]:
    return rows(graph.impact(ix.edges, _seed(ix, path), int(depth) or 3).orderBy("depth", "node"))


def get_lines(ix: Index, path: str, start: int, end: int) -> list[dict]:
    got = readers.line_range(ix.files.where(F.col("path") == path), int(start), int(end))
    return rows(got.withColumn("text", T.redacted(F.col("text"))).orderBy("line"), 2000)


def read_memory(ix: Index, last: int = 10) -> dict:
    return {"notes": ix.notes[-int(last) :], "session": ix.session}


def get_callee_signatures(ix: Index, names: list[str]) -> dict:
    s = ix.sigs.withColumn("name", T.defined_symbol(F.col("sig")))
    wanted = ix.spark.createDataFrame([(n,) for n in names], "value string")
    missing = wanted.join(s.select(F.col("name").alias("value")), "value", "left_anti")
    return {"found": rows(s.where(F.col("name").isin(names))), "suggestions": rows(verify.closest(missing, s.select("name").where("name IS NOT NULL")))}


def notify_file_created(ix: Index, path: str, content: str = "") -> dict:
    ix.deleted.discard(path)
    ix.added[path] = extract.extract(content, extract.language_of(path))
    return {"path": path, "signatures": len(ix.added[path])}


def notify_symbol_added(ix: Index, path: str, signature: str) -> dict:
    have = ix.added.setdefault(path, [])
    if signature not in have:
        have.append(signature)
    return {"path": path, "signatures": len(have)}


def notify_file_deleted(ix: Index, path: str) -> dict:
    ix.deleted.add(path)
    ix.added.pop(path, None)
    return {"path": path}


def get_diff_context(ix: Index, paths: list[str]) -> list[dict]:
    d = ix.spark.createDataFrame([(p,) for p in paths], "path string")
    hit = graph.impact(ix.edges, d.withColumnRenamed("path", "seed"), 3).groupBy(F.col("seed").alias("path")).agg(F.count(F.lit(1)).alias("impacted"))
    return rows(d.join(ix.index, "path", "left").join(hit, "path", "left").select("path", "sigs", T.risk_factors(F.col("path")).alias("risk"), F.coalesce("impacted", F.lit(0)).alias("impacted")))


def get_architecture_overview(ix: Index) -> dict:
    e = ix.edges
    return {"modules": list_modules(ix), "hubs": rows(graph.degrees(e).orderBy(F.col("n_in").desc(), "node"), 10), "entry_points": rows(graph.entry_points(e), 20), "cycles": rows(graph.cycles(e), 50)}


def verify_suggestion(ix: Index, text: str) -> list[dict]:
    a = ix.spark.createDataFrame([(0, text)], "id long, text string")
    c = verify.claims(verify.lines(a, "id", F.col("text")), "id")
    none = ix.spark.createDataFrame([], "name string")
    return rows(verify.issues(c, "id", ix.files.select("path"), verify.symbols_of(ix.sigs), none, none).where("type <> 'fake-import'").orderBy("line"))


def squeeze_output(ix: Index, text: str) -> dict:
    d = ix.spark.createDataFrame([(0, text)], "id long, text string")
    kind = squeeze.classified(d, "id", F.col("text")).first()
    out = squeeze.log_text(text) if kind.category == "cilog" else text
    if kind.category == "json":
        out = squeeze.squeeze_json(d, "id", F.col("text")).first().squeezed
    if kind.category == "stacktrace":
        frames = rows(squeeze.squeeze_trace(d, "id", F.col("text")))
        out = "\n".join([text.split("\n")[0], *(f"    {f['fn']} {f['file']}:{f['line']}" for f in frames)])
    return {"category": kind.category, "confidence": kind.confidence, "squeezed": out}


TOOLS = {f.__name__: f for f in (read_context, search_signatures, get_map, create_checkpoint, get_routing, explain_file, list_modules, query_context, get_method_impact, get_impact, get_lines, read_memory, get_callee_signatures, notify_file_created, notify_symbol_added, notify_file_deleted, get_diff_context, get_architecture_overview, verify_suggestion, squeeze_output)}


PROTOCOL = "2024-11-05"
SAYS = {
    "read_context": "Signatures of all files, or of those below a module's path.", "search_signatures": "Signatures that hold a text, whatever its case.", "get_map": "Imports, routes, classes, environment names, migrations, cycles and modules.",
    "create_checkpoint": "Counts of files and signatures, with a note.", "get_routing": "The model tier that work on each file needs.", "explain_file": "Signatures of a file, what it imports and what imports it.", "list_modules": "Modules by tokens.",
    "query_context": "The files that answer a question best.", "get_method_impact": "What calls a method, directly or through others.", "get_impact": "What depends on a file.", "get_lines": "Lines of a file, secrets left out.", "read_memory": "The latest notes and the session.",
    "get_callee_signatures": "Signatures of named functions, and the nearest names of unknown ones.", "notify_file_created": "Takes a new file into the index.", "notify_symbol_added": "Takes a new signature into the index.", "notify_file_deleted": "Takes a file out of the index.",
    "get_diff_context": "Signatures, risks and reach of changed files.", "get_architecture_overview": "Modules, hubs, entry points and cycles.", "verify_suggestion": "Names and files in an answer that aren't there.", "squeeze_output": "A log, stack trace or JSON text made short.",
}
KINDS = {"str": {"type": "string"}, "int": {"type": "integer"}, "list[str]": {"type": "array", "items": {"type": "string"}}}


def schema(name: str) -> dict:
    """A tool as tools/list shows it, its arguments read from the function."""
    args = list(inspect.signature(TOOLS[name]).parameters.values())[1:]
    return {"name": name, "description": SAYS[name], "inputSchema": {"type": "object", "properties": {a.name: KINDS[a.annotation] for a in args}, "required": [a.name for a in args if a.default is a.empty]}}


def dispatch(ix: Index, request: str) -> str | None:
    """One JSON-RPC request line as its response line: unknown methods and tools -32601, failures -32603. Notifications and what isn't JSON have no
    response. A tool's answer is a content of one text, which holds JSON."""
    try:
        r = json.loads(request)
    except ValueError:
        return None
    if not isinstance(r, dict):
        return None
    method, params = r.get("method"), r.get("params") or {}
    if r.get("id") is None:  # a notification
        return None
    answer = {"jsonrpc": "2.0", "id": r["id"]}
    fail = lambda code, message: json.dumps(answer | {"error": {"code": code, "message": message}})
    if method == "initialize":
        return json.dumps(answer | {"result": {"protocolVersion": params.get("protocolVersion") or PROTOCOL, "serverInfo": {"name": "sparrowgram", "version": "1"}, "capabilities": {"tools": {}}}})
    if method == "tools/list":
        return json.dumps(answer | {"result": {"tools": [schema(n) for n in TOOLS]}})
    if method != "tools/call":
        return fail(-32601, f"Method not found: {method}")
    tool = TOOLS.get(params.get("name", ""))
    if tool is None:
        return fail(-32601, f"Unknown tool: {params.get('name')}")
    try:
        text = json.dumps(tool(ix, **(params.get("arguments") or {})), default=str, ensure_ascii=False)
        return json.dumps(answer | {"result": {"content": [{"type": "text", "text": text}]}})
    except Exception as e:  # the answer carries the failure
        return fail(-32603, f"Tool error: {type(e).__name__}: {e}")
