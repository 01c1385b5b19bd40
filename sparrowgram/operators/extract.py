"""Signatures of source files: one table-driven extractor a language, run file by file in Arrow batches, without a shuffle.

extract() never raises: what can't be read gives no signature. A signature is a line of text, members indented by two blanks, with an
anchor `  :start-end` where the language has one.
"""

from __future__ import annotations

import ast
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import languages

MEMBERS = 8


def masked(src: str, line: str = "//", block: tuple[str, str] | None = ("/*", "*/"), quotes: str = "\"'`") -> str:
    """src with comments and strings blanked, each sign kept in its place."""
    out, i, n = list(src), 0, len(src)

    def blank(a: int, b: int) -> None:
        for k in range(a, min(b, n)):
            if out[k] != "\n":
                out[k] = " "

    while i < n:
        if line and src.startswith(line, i):
            j = src.find("\n", i)
            j = n if j < 0 else j
            blank(i, j)
        elif block and src.startswith(block[0], i):
            j = src.find(block[1], i + len(block[0]))
            j = n if j < 0 else j + len(block[1])
            blank(i, j)
        elif src[i] in quotes:
            q, j = src[i], i + 1
            while j < n and src[j] != q and (q == "`" or src[j] != "\n"):
                j += 2 if src[j] == "\\" else 1
            blank(i + 1, j)
            j = min(n, j + 1)
        else:
            j = i + 1
        i = j
    return "".join(out)


def closing(src: str, at: int, pair: str = "{}") -> int:
    """Where the bracket that opens at or after `at` closes; the end of the text if it never does."""
    depth, i = 0, src.find(pair[0], at)
    if i < 0:
        return len(src) - 1
    while i < len(src):
        if src[i] == pair[0]:
            depth += 1
        elif src[i] == pair[1]:
            depth -= 1
            if not depth:
                return i
        i += 1
    return len(src) - 1


def tidy(s: str) -> str:
    return " ".join(s.split())


def anchored(sig: str, src: str, a: int, b: int) -> str:
    return f"{sig}  :{src.count(chr(10), 0, a) + 1}-{src.count(chr(10), 0, max(a, b)) + 1}"


@dataclass(frozen=True)
class Lines:
    """Patterns whose groups fill a template, in page order."""

    rules: tuple[tuple[str, str], ...]
    cap: int = 0
    strip: str = ""
    distinct: bool = False

    def __call__(self, src: str) -> list[str]:
        s = re.sub(self.strip, lambda m: re.sub(r"[^\n]", " ", m[0]), src, flags=re.S | re.M) if self.strip else src
        out = []
        for k, (p, template) in enumerate(self.rules):
            for m in re.finditer(p, s, re.M):
                out.append((m.start(), k, tidy(re.sub(r"\{(\d)\}", lambda g: m[int(g[1])] or "", template)) if template[0] != " " else "  " + tidy(re.sub(r"\{(\d)\}", lambda g: m[int(g[1])] or "", template))))
        sigs = [x for _, _, x in sorted(out)]
        if self.distinct:
            sigs = list(dict.fromkeys(sigs))
        return sigs[: self.cap] if self.cap else sigs


def python_ast(src: str) -> list[str]:
    """Classes with fields and methods, functions and route decorators, from the syntax tree."""
    out: list[str] = []

    def arguments(a: ast.arguments) -> str:
        plain = [*a.posonlyargs, *a.args]
        parts = [x.arg + ("=..." if i >= len(plain) - len(a.defaults) else "") for i, x in enumerate(plain)]
        if a.vararg:
            parts.append("*" + a.vararg.arg)
        parts += [x.arg + ("=..." if d is not None else "") for x, d in zip(a.kwonlyargs, a.kw_defaults, strict=True)]
        if a.kwarg:
            parts.append("**" + a.kwarg.arg)
        return ", ".join(parts)

    def line(f: ast.FunctionDef | ast.AsyncFunctionDef, indent: str = "") -> str:
        back = f" → {ast.unparse(f.returns)}" if f.returns else ""
        doc = (ast.get_docstring(f) or "").strip().split("\n")[0][:60]
        word = "async def" if isinstance(f, ast.AsyncFunctionDef) else "def"
        return f"{indent}{word} {f.name}({arguments(f.args)}){back}  :{f.lineno}-{f.end_lineno}" + (f"  # {doc}" if doc else "")

    for x in ast.parse(src).body:
        if isinstance(x, ast.ClassDef):
            bases = ", ".join(map(ast.unparse, x.bases))
            data = any("dataclass" in ast.unparse(d) for d in x.decorator_list)
            out.append(("@dataclass " if data else "") + f"class {x.name}" + (f"({bases})" if bases else "") + f"  :{x.lineno}-{x.end_lineno}")
            if data or "BaseModel" in bases:
                out += [f"  {f.target.id}: {ast.unparse(f.annotation)}" for f in x.body if isinstance(f, ast.AnnAssign) and isinstance(f.target, ast.Name)][:6]
            out += [line(f, "  ") for f in x.body if isinstance(f, ast.FunctionDef | ast.AsyncFunctionDef) and (not f.name.startswith("_") or f.name == "__init__")][:MEMBERS]
        elif isinstance(x, ast.FunctionDef | ast.AsyncFunctionDef):
            for d in x.decorator_list:
                if isinstance(d, ast.Call) and isinstance(d.func, ast.Attribute) and d.func.attr in ("delete", "get", "patch", "post", "put", "route") and d.args and isinstance(d.args[0], ast.Constant):
                    out.append(f"{d.func.attr.upper()} {d.args[0].value} → {x.name}")
            if not x.name.startswith("_"):
                out.append(line(x))
    return out[:30]


def sql(src: str) -> list[str]:
    s = re.sub(r"--[^\n]*|/\*.*?\*/", " ", src, flags=re.S)
    name = r"(?:IF\s+NOT\s+EXISTS\s+)?([\w.\"`\[\]]+)"
    out = []
    for m in re.finditer(rf"\bCREATE\s+(?:OR\s+REPLACE\s+)?(?:(?:GLOBAL|LOCAL|MATERIALIZED|TEMP|TEMPORARY|UNIQUE|UNLOGGED)\s+)*(FUNCTION|INDEX|PROCEDURE|SEQUENCE|TABLE|TRIGGER|TYPE|VIEW)\s+{name}(\s*\([^)]*\))?(?:\s+ON\s+([\w.\"`]+))?", s, re.I):
        kind, n = m[1].upper(), m[2].strip('"`[]')
        more = tidy(m[3] or "()").replace("( ", "(") if kind in ("FUNCTION", "PROCEDURE") else f" ON {m[4]}" if kind == "INDEX" and m[4] else ""
        out.append(f"{kind} {n}{more}")
    return out


def script(src: str) -> str:
    m = re.search(r"<script[^>]*>(.*?)</script>", src, re.S | re.I)
    return m[1] if m else ""


def vue_sfc(src: str) -> list[str]:
    s = script(src)
    out = [f"component {m[1]}" for m in re.finditer(r"""\bname:\s*['"]([\w-]+)""", s)][:1]
    for m in re.finditer(r"\b(?:defineProps(?:<)?|props:)\s*[(]?\s*\{([^}]*)\}", s):
        out += [f"prop {x}" for x in re.findall(r"(\w+)\??\s*:", m[1])]
    for m in re.finditer(r"\bdefineEmits\(?\s*\[([^\]]*)\]|\bemits:\s*\[([^\]]*)\]", s):
        out.append("emits " + ", ".join(re.findall(r"['\"]([\w:-]+)", m[1] or m[2] or "")))
    hooks = "onBeforeMount|onBeforeUnmount|onBeforeUpdate|onMounted|onUnmounted|onUpdated"
    out += [f"hook {x}" for x in dict.fromkeys(re.findall(rf"\b({hooks})\(", s))] + [f"composable {x}" for x in dict.fromkeys(re.findall(r"\b(use[A-Z]\w*)\(", s))]
    out += [f"function {x}" for x in re.findall(r"\bfunction\s+(\w+)", s)]
    return (out + [f"slot {x}" for x in re.findall(r"""<slot\s+name=["']([\w-]+)""", src)])[:50]


def docker(src: str) -> list[str]:
    out = [tidy(f"FROM {a}" + (f" AS {b}" if b else "")) for a, b in re.findall(r"^FROM\s+(\S+)(?:\s+AS\s+(\S+))?", src, re.M | re.I)]
    ports = [p for x in re.findall(r"^EXPOSE\s+([^\n]+)", src, re.M | re.I) for p in x.split()]
    out += [f"EXPOSE {' '.join(ports)}"] if ports else []
    return (out + [tidy(f"{k.upper()} {v}") for k, v in re.findall(r"^(ENTRYPOINT|CMD)\s+([^\n]+)", src, re.M | re.I)] + [f"{k.upper()} {v}" for k, v in re.findall(r"^(ENV|ARG)\s+(\w+)", src, re.M | re.I)])[:25]


def properties(src: str) -> list[str]:
    keys = [m[1] for m in re.finditer(r"^\s*([^#!\s=:][^=:\n]*?)\s*[=:]", src, re.M)]
    groups = list(dict.fromkeys(".".join(k.split(".")[:2]) for k in keys if k.count(".") >= 2))
    return ([f"group {g}" for g in groups] + [f"key {k}" for k in keys])[:50]


def toml(src: str) -> list[str]:
    return Lines(((r"^\s*\[+([^\]\n]+)\]+", "[{1}]"), (r"^\s*([\w.-]+)\s*=\s*(?:[\"'\d]|true|false)", "{1}")), 40, r"^\s*#[^\n]*", True)(src)


def xml(src: str) -> list[str]:
    s = re.sub(r"<!--.*?-->|<\?.*?\?>|<![^>]*>", " ", src, flags=re.S)
    root = re.search(r"<([A-Za-z][\w:.-]*)", s)
    out = [f"root {root[1]}"] if root else []
    for t, a in re.findall(r"<([A-Za-z][\w:.-]*)\s([^>]*)>", s):
        for k, form in (("id", "{t}#{v}"), ("name", "{t}[name={v}]"), ("class", "{t} -> {v}")):
            if m := re.search(rf"""\b{k}=["']([^"']+)""", a):
                out.append(form.format(t=t, v=m[1]))
                break
    return out[:50]


def todos(src: str) -> list[str]:
    return [f"{m[1]}: {tidy(m[2])[:70]}  :{src.count(chr(10), 0, m.start()) + 1}" for m in re.finditer(r"\b(TODO|FIXME|HACK|XXX)\b[:\s(]*([^\n]*)", src)]


REGISTRY: dict[str, Callable[[str], list[str]]] = {
    "typescript_react": Lines(((r"\b(?:export\s+)?(?:default\s+)?function\s+([A-Z]\w*)\s*\(", "component {1}"), (r"\bconst\s+([A-Z]\w*)\s*(?::[^=\n]+)?=\s*(?:React\.memo\()?\(", "component {1}"), (r"\b(?:interface|type)\s+(\w*Props)\b", "props {1}"), (r"\b(use[A-Z]\w*)\(", "hook {1}"), (r"\b(?:const|function)\s+(handle[A-Z]\w*)", "handler {1}"), (r"^export\s+(?:default\s+)?(?:const|function|class)\s+(\w+)", "export {1}")), 50, distinct=True),
    "python_ast": python_ast,
    "graphql": Lines(((r"^\s*(?:extend\s+)?(type|interface|input|enum|scalar|union)\s+(\w+)", "{1} {2}"), (r"^\s*extend\s+type\s+(\w+)", "extend {1}"), (r"^\s*(query|mutation|subscription)\s+(\w+)", "{1} {2}"), (r"^\s*fragment\s+(\w+)\s+on\s+(\w+)", "fragment {1} on {2}"), (r"^\s*(schema)\s*\{", "{1}")), 0, r"#[^\n]*"),
    "protobuf": Lines(((r'^\s*syntax\s*=\s*"(\w+)"', "syntax {1}"), (r"^\s*package\s+([\w.]+)", "package {1}"), (r"^\s*(message|enum|service|oneof|extend)\s+([\w.]+)", "{1} {2}"), (r"^\s*rpc\s+(\w+)\s*\(([^)]*)\)\s*returns\s*\(([^)]*)\)", "  rpc {1}({2}) → {3}")), 0, r"//[^\n]*|/\*.*?\*/"),
    "terraform": Lines(((r'^(resource|data)\s+"([^"]+)"\s+"([^"]+)"', "{1} {2}.{3}"), (r'^(module|variable|output|provider)\s+"([^"]+)"', "{1} {2}"), (r"^(locals|terraform|moved|import)\s*\{", "{1}")), 0, r"#[^\n]*|//[^\n]*|/\*.*?\*/"),
    "markdown": Lines(((r"^(#{1,6})\s+(.+?)\s*#*$", "{1} {2}"), (r"^```(\w+)", "code {1}")), 40, distinct=True),
    "dataclass": Lines(((r"^@dataclass[^\n]*\n\s*class\s+(\w+)", "dataclass {1}"), (r"^class\s+(\w+)\(.*BaseModel.*\)", "model {1}"), (r"^\s+(\w+)\s*=\s*(?:db\.)?(?:Column|mapped_column)\(", "column {1}"), (r"^\s+(\w+)\s*=\s*relationship\(", "relation {1}"), (r"^\s+@(?:field_)?validator\(([^)]*)\)", "validator {1}"), (r"^\s+(\w+)\s*:\s*[\w\[\]., |]+(?:\s*=|$)", "field {1}")), 50),
    "patterns": Lines(((r"class\s+(\w*Repository)\b", "repository {1}"), (r"class\s+(\w*Service)\b", "service {1}"), (r"class\s+(\w*Controller)\b", "controller {1}"), (r"\b(?:app|router)\.use\((\w+)", "middleware {1}"), (r"@(Inject\w*)", "injection {1}"), (r"catch\s*\([^)]*\)\s*\{\s*(\})", "empty catch"), (r"(\bany\b)", "untyped any")), 60),
    "generic": Lines(((r"^((?:export\s+|pub(?:lic)?\s+)?(?:class|def|enum|fn|func|function|interface|module|struct|trait|type)\s+\w[^\n{]{0,90})", "{1}"),), 15),
    **{k: getattr(languages, k) for k in "javascript typescript python go rust java kotlin csharp scala swift dart php cpp ruby gdscript yaml css html svelte vue shell".split()},
    "vue_sfc": vue_sfc, "r": languages.r_lang, "sql": sql, "dockerfile": docker, "properties": properties, "toml": toml, "xml": xml, "todos": todos,
}
BY_EXTENSION = {
    e: k
    for k, es in {
        "javascript": "js jsx mjs cjs", "typescript": "ts mts cts", "typescript_react": "tsx", "python": "py pyw", "go": "go", "rust": "rs", "java": "java", "kotlin": "kt kts", "csharp": "cs", "scala": "scala sc", "swift": "swift",
        "dart": "dart", "php": "php", "cpp": "c cc cpp cxx h hpp hxx", "ruby": "rb rake", "gdscript": "gd", "graphql": "graphql gql", "protobuf": "proto", "terraform": "tf tfvars", "markdown": "md markdown", "yaml": "yml yaml",
        "css": "css scss sass less", "html": "html htm", "sql": "sql", "svelte": "svelte", "vue_sfc": "vue", "shell": "sh bash zsh fish", "properties": "properties", "toml": "toml", "xml": "xml", "r": "r",
    }.items()
    for e in es.split()
}


def language_of(path: str) -> str | None:
    name = path.rsplit("/", 1)[-1]
    return "dockerfile" if name.startswith("Dockerfile") else BY_EXTENSION.get(name.rsplit(".", 1)[-1].lower())


def extract(src: str | None, language: str | None) -> list[str]:
    f = REGISTRY.get(language or "")
    if not f or not isinstance(src, str):
        return []
    try:
        return f(src)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return languages.python(src) if language == "python_ast" else []


def signatures(files: DataFrame, path: str = "path", content: str = "content", language: str | None = None) -> DataFrame:
    """path, pos, sig for each signature of each file; language overrides what the path says."""
    schema = pa.schema([("path", pa.string()), ("pos", pa.int32()), ("sig", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(p, i, s) for p, c in zip(b.column(0).to_pylist(), b.column(1), strict=True) for i, s in enumerate(extract(c.as_py(), language or language_of(p or "")))]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x, t.type) for x, t in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    return files.select(F.col(path).cast("string").alias("path"), F.col(content).alias("content")).mapInArrow(run, "path string, pos int, sig string")


def definitions(src: str, language: str) -> list[tuple[str, int, int, list[str]]]:
    """(name, first line, last line, names called) of the functions of a file."""
    if language == "python":
        try:
            tree = ast.parse(src)
        except (SyntaxError, ValueError):
            return []
        return [(f.name, f.lineno, f.end_lineno or f.lineno, sorted({c.func.id for c in ast.walk(f) if isinstance(c, ast.Call) and isinstance(c.func, ast.Name)})) for f in ast.walk(tree) if isinstance(f, ast.FunctionDef | ast.AsyncFunctionDef)]
    head = {"javascript": r"\b(?:async\s+)?function\*?\s+([\w$]+)\s*\(|\b(?:const|let|var)\s+([\w$]+)\s*=\s*(?:async\s*)?(?:\([^)]*\)|[\w$]+)\s*=>", "go": r"^func\s+(?:\([^)]*\)\s*)?(\w+)\s*\(", "rust": r"\bfn\s+(\w+)", "java": r"^[ \t]*(?:[\w<>\[\],]+\s+)+(\w+)\s*\([^)]*\)\s*(?:throws\s+[\w, ]+)?\{"}
    p = head.get("javascript" if language.startswith("typescript") else language)
    if not p:
        return []
    m, out = masked(src), []
    words = frozenset("catch for func function if match return sizeof switch while with".split())
    for f in re.finditer(p, m, re.M):
        name, end = next(filter(None, f.groups())), closing(m, f.start())
        calls = {c[1] for c in re.finditer(r"(?<![.\w$])([A-Za-z_$][\w$]*)\s*\(", m[f.end() : end])}
        out.append((name, src.count("\n", 0, f.start()) + 1, src.count("\n", 0, end) + 1, sorted(calls - words - {name})))
    return out


def call_table(files: DataFrame, path: str = "path", content: str = "content") -> tuple[DataFrame, DataFrame]:
    """defs (sym_id, file, name, line) and uses (caller, file, name)."""
    schema = pa.schema([("sym_id", pa.string()), ("file", pa.string()), ("name", pa.string()), ("line", pa.int32()), ("called", pa.list_(pa.string()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(f"{p}#{n}", p, n, a, calls) for p, c in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) for n, a, _, calls in definitions(c or "", language_of(p or "") or "")]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x, t.type) for x, t in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    d = files.select(F.col(path).alias("path"), F.col(content).alias("content")).mapInArrow(run, "sym_id string, file string, name string, line int, called array<string>")
    return d.drop("called"), d.select(F.col("sym_id").alias("caller"), "file", F.explode("called").alias("name")).distinct()


ROUTES = [
    ("js", r"""\b(?:app|router)\.(delete|get|patch|post|put)\(\s*['"`]([^'"`]+)"""), ("ts", r"""@(Delete|Get|Patch|Post|Put)\(\s*['"`]?([^'"`)]*)"""),
    ("py", r"""@\w+\.(delete|get|patch|post|put|route)\(\s*['"]([^'"]+)"""), ("go", r"""\.(DELETE|GET|PATCH|POST|PUT|HandleFunc)\(\s*"([^"]+)"""), ("java", r"""@(Delete|Get|Patch|Post|Put|Request)Mapping\(\s*(?:value\s*=\s*)?"([^"]+)"""),
]


def routes(files: DataFrame) -> DataFrame:
    """method, path, file: web routes, by Column regexes. files: path, content."""
    out = None
    for ext, p in ROUTES:
        both = F.explode(F.arrays_zip(F.regexp_extract_all("content", F.lit(p), 1).alias("m"), F.regexp_extract_all("content", F.lit(p), 2).alias("p")))
        endings = {"js": "[cm]?jsx?|tsx?", "ts": "ts"}.get(ext, ext)
        x = files.where(F.col("path").rlike(rf"\.({endings})\z")).select("path", both.alias("r")).select(F.upper("r.m").alias("method"), F.col("r.p").alias("route"), F.col("path").alias("file"))
        out = x if out is None else out.unionByName(x)
    return out.select(F.when(F.col("method").isin("ROUTE", "HANDLEFUNC", "REQUEST"), "ANY").otherwise(F.col("method")).alias("method"), F.col("route").alias("path"), "file").distinct()


def classes(files: DataFrame) -> DataFrame:
    """name, parent, interfaces, file of class declarations."""
    p = r"\b(?:class|interface|object)\s+(\w+)(?:<[^>{]*>)?\s*(?:(?:extends|:|\()\s*([\w.]+))?(?:[^{\n]*?\bimplements\s+([\w., ]+))?"
    z = F.arrays_zip(*[F.regexp_extract_all("content", F.lit(p), i).alias(n) for i, n in ((1, "n"), (2, "p"), (3, "i"))])
    x = files.select("path", F.explode(z).alias("c"))
    return x.select(F.col("c.n").alias("name"), F.nullif("c.p", F.lit("")).alias("parent"), F.filter(F.split(F.trim("c.i"), r"\s*,\s*"), lambda s: s != "").alias("interfaces"), F.col("path").alias("file"))


def env_names(files: DataFrame) -> DataFrame:
    """name, file of the environment variables that code reads or .env files set."""
    p = r"(?:process\.env\.|os\.environ(?:\.get\(|\[)\s*['\"]|os\.getenv\(\s*['\"]|os\.Getenv\(\s*\"|System\.getenv\(\s*\"|ENV\[['\"])([A-Z][A-Z0-9_]*)"
    used = files.select(F.explode(F.regexp_extract_all("content", F.lit(p), 1)).alias("name"), F.col("path").alias("file"))
    declared = files.where(F.col("path").rlike(r"(^|/)\.env[^/]*\z")).select(F.explode(F.regexp_extract_all("content", F.lit(r"(?m)^\s*(?:export\s+)?([A-Z][A-Z0-9_]*)\s*="), 1)).alias("name"), F.col("path").alias("file"))
    return used.union(declared).distinct()


def migrations(files: DataFrame) -> DataFrame:
    """version, name, file of schema migrations, by path."""
    p = r"(?:^|/)V?(\d+(?:_\d+)*)[_-]+([^/]+?)\.(?:java|js|py|rb|sql|ts)\z"
    f = files.where(F.col("path").rlike(r"(?i)(^|/)(alembic/versions|db/migrate|migrations?)/") & F.col("path").rlike(p))
    return f.select(F.regexp_extract("path", p, 1).alias("version"), F.regexp_extract("path", p, 2).alias("name"), F.col("path").alias("file"))
