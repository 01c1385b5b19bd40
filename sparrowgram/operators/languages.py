"""Signatures of the languages with types, members and functions. A language of braces is a table of declarations: what to look for, and how
the line reads. Types come first, each with its public members, then functions; anchors count from line 1.

Comments are blanked sign for sign, so places in the text stay lines of the file.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

MEMBERS, LINES = 8, 25
Form = Callable[[re.Match], str | None]


def blanked(src: str, line: str = "//", block: tuple[str, str] | None = ("/*", "*/"), quotes: str = "") -> str:
    """src with comments, and what stands between quotes, as blanks; line ends stay."""
    parts = [re.escape(line) + r"[^\n]*"] if line else []
    if block:
        parts.append(re.escape(block[0]) + r"(?s:.*?)(?:" + re.escape(block[1]) + r"|\Z)")
    parts += [rf"{q}(?:\\.|[^{q}\\\n])*{q}?" for q in quotes if q != "`"] + [r"`(?:\\.|[^`\\])*`?"] * ("`" in quotes)
    return re.sub("|".join(parts), lambda m: re.sub(r"[^\n]", " ", m[0]), src) if parts else src


def closes(src: str, at: int, pair: str = "{}") -> int:
    """Where the bracket at `at` closes; the end of the text if it never does."""
    depth = 0
    for m in re.compile("[" + re.escape(pair) + "]").finditer(src, at):
        depth += 1 if m[0] == pair[0] else -1
        if not depth:
            return m.start()
    return max(0, len(src) - 1)


def flat(s: str | None, most: int = 1 << 20) -> str:
    return " ".join((s or "").split())[:most]


def arrow(s: str | None, most: int, dots: bool = False) -> str:
    t = flat(s).rstrip("; ")
    return f" → {t[: most - 3] + '...' if dots and len(t) > most else t[:most]}" if t else ""


def names(args: str | None) -> str:
    """Parameters without types and defaults."""
    out, depth, part = [], 0, ""
    for c in (args or "") + ",":
        depth += (c in "([{<") - (c in ")]}>")
        if c == "," and depth <= 0:
            out.append(flat(re.split(r"\s*[:=]", part.strip(), maxsplit=1)[0]))
            part = ""
        else:
            part += c
    return ", ".join(x for x in out if x)


def line_of(src: str, at: int) -> int:
    return src.count("\n", 0, at) + 1


def sentence(body: str) -> str:
    """The first prose sentence of a documentation comment."""
    for row in body.split("\n"):
        row = row.strip().lstrip("*/").strip()
        if row and row[0] != "@":
            return re.split("[.!?]", row)[0].strip()[:60]
    return ""


def doc_block(src: str, at: int) -> str:
    """Of the block comment right above a declaration, annotations between allowed."""
    head = re.sub(r"(?:\s*@\w+(?:\([^)]*\))?)*\s*\Z", "", src[:at])
    begin = head.rfind("/**")
    return sentence(head[begin + 3 : -2]) if head.endswith("*/") and begin >= 0 and "*/" not in head[begin:-2] else ""


def doc_lines(mark: str) -> Callable[[str, int], str]:
    """Of the run of comment lines right above a declaration."""

    def find(src: str, at: int) -> str:
        rows = []
        for row in reversed(src[:at].rstrip(" \t").split("\n")[:-1]):
            row = row.strip()
            if row.startswith(mark):
                rows.append(row[len(mark) :])
            elif not row.startswith("#["):
                break
        return sentence("\n".join(reversed(rows)))

    return find


@dataclass(frozen=True)
class Tongue:
    """types: patterns that reach to the opening brace, each with its line, or to the end of the head where `open_` finds the brace. members and
    functions: patterns and lines; a line of None is none. whole: members end with their block, else with their head."""

    types: tuple[tuple[str, Form], ...]
    members: tuple[tuple[str, Form], ...] = ()
    functions: tuple[tuple[str, Form], ...] = ()
    with_members: str = r".*"
    whole: bool = False
    anchors: bool = True
    quotes: str = "\"'"
    hash_comments: bool = False
    doc: Callable[[str, int], str] | None = None
    shown: str = ""  # member names match it

    def __call__(self, src: str) -> list[str]:
        text = blanked(src)
        if self.hash_comments:
            text = blanked(text, "#", None)
        bare = blanked(text, "", None, self.quotes)
        out: list[str] = []

        def put(line: str, a: int, b: int, documented: bool = True) -> None:
            hint = self.doc(src, a) if self.doc and documented else ""
            out.append(line + (f"  :{line_of(src, a)}-{line_of(src, b)}" if self.anchors else "") + (f"  # {hint}" if hint else ""))

        for pattern, form in self.types:
            at, p = 0, re.compile(pattern, re.M)
            while m := p.search(text, at):
                at = max(m.end(), m.start() + 1)
                if (line := form(m)) is None:
                    continue
                brace = m.end() - 1 if text[m.end() - 1] == "{" else bare.find("{", m.end())
                end = closes(bare, brace) if brace >= 0 and not re.search(r"[;]", bare[m.end() : brace]) else m.end() - 1
                put(line, m.start(), end)
                if brace < end and re.match(self.with_members, line):
                    for a, b, member in self.inside(text, bare, brace + 1, end):
                        put("  " + member, a, b)
        for pattern, form in self.functions:
            for m in re.compile(pattern, re.M).finditer(text):
                if (line := form(m)) is not None:
                    after = re.compile(r"\s*\{").match(bare, m.end()) if text[m.end() - 1] != "{" else re.compile(r"\{").match(bare, m.end() - 1)
                    put(line, m.start(), closes(bare, after.end() - 1) if after else m.end() - 1)
        return out[:LINES]

    def inside(self, text: str, bare: str, begin: int, end: int) -> Iterator[tuple[int, int, str]]:
        kept = 0
        for pattern, form in self.members:
            for m in re.compile(pattern, re.M).finditer(text, begin, end):
                line = form(m)
                if line is None or self.shown and not re.search(self.shown, m["name"]):
                    continue
                kept += 1
                if kept <= MEMBERS:
                    a = m.start() + len(m[0]) - len(m[0].lstrip())
                    yield a, closes(bare, m.end() - 1) if self.whole and text[m.end() - 1] == "{" else m.end() - 1, line


def some(words: str) -> str:
    """Any of the words, each followed by blanks, any number of times."""
    return "(?:(?:" + words.replace(" ", "|") + r")\s+)*"


NAME, ARGS, GENERIC = r"(?P<name>\w+)", r"\s*\((?P<args>[^)]*)\)", r"(?:<[^(){]*>)?"
JAVA_TYPE, CS_TYPE = r"(?P<ret>[\w<>\[\],?. ]*[\w>\]?])", r"(?P<ret>[\w<>\[\],?. ]*[\w>\]?])"


def kotlin_fun(m: re.Match) -> str:
    return f"{'suspend ' if re.search(r'suspend', m[0][: m.start('name') - m.start()]) else ''}fun {m['name']}({names(m['args'])}){arrow(m['ret'], 25)}"


def swift_func(m: re.Match) -> str:
    back = re.search(r"->([^{\n]+)", m["rest"])
    return f"{'async ' if 'async' in m[0][: m.start('name') - m.start()] else ''}func {m['name']}({names(m['args'])}){arrow(back and back[1], 25, True)}"


def rust_fn(m: re.Match) -> str:
    back = re.search(r"->([^{;]+)", m["rest"])
    return f"pub {'async ' if m['async'] else ''}fn {m['name']}({flat(m['args'])}){arrow(back and back[1], 30, True)}"


def scala_def(m: re.Match) -> str:
    return f"def {m['name']}({names(m['args'])}){arrow(m['ret'], 25)}" if m["args"] is not None else f"def {m['name']}{arrow(m['ret'], 25)}"


def php_function(m: re.Match) -> str | None:
    return None if m["name"].startswith("_") else f"function {m['name']}({flat(m['args'])}){arrow(m['ret'], 25)}"


def dart_method(m: re.Match) -> str | None:
    if m["name"].startswith("_") or m["ret"] in ("return", "await", "else", "new", "throw"):
        return None
    back = "".join(m["ret"].split())[:25]
    return f"{m['name']}({flat(m['args'])})" + (f" → {back}" if back != "void" else "")


def typed_method(m: re.Match) -> str:
    return f"{m['name']}({flat(m['args'])}){arrow(m['ret'], 30)}"


def cpp_member(m: re.Match) -> str | None:
    before = m.string[: m.start("name")]
    access = re.findall(r"\b(private|protected|public)\s*:", before[before.rfind("{") + 1 :]) if before.count("{") else []
    if m["name"].startswith("_") or access[-1:] == ["private"]:
        return None
    return f"{m['name']}({flat(m['args'])})" + arrow(re.sub(r"\b(?:virtual|static|inline|explicit)\s+", "", m["ret"] or ""), 30)


def go_method(m: re.Match) -> str:
    owner = f"({m['owner']}) " if m["owner"] else ""
    return f"func {owner}{m['name']}({flat(m['args'])}){arrow(m['rest'], 30)}"


SWIFT = r"func\s+" + NAME + GENERIC + ARGS + r"(?P<rest>[^{\n]*)"
KOTLIN = r"fun\s+(?:<[^(]*>\s*)?" + NAME + ARGS + r"(?:\s*:\s*(?P<ret>[^\n{=]+))?"
RUST = r"pub\s+(?P<async>async\s+)?fn\s+" + NAME + GENERIC + ARGS + r"(?P<rest>[^{;]*)"
SCALA = r"def\s+" + NAME + r"(?:\[[^\]]*\])?(?:\s*\((?P<args>[^)]*)\))?(?:\s*:\s*(?P<ret>[^=\n{]+))?"
PHP = r"function\s+" + NAME + ARGS + r"\s*(?::\s*(?P<ret>[^\n{]+))?"
DART = r"(?P<ret>Future<[^(){};]*>|[\w<>?]+)\s+" + NAME + ARGS
kind_name = lambda m: f"{m['kind']} {m['name']}"

java = Tongue(
    ((r"^" + some("public protected") + some("abstract final") + r"(?P<kind>class|enum|interface)\s+" + NAME + r"(?:\s+(?:extends|implements)\s[^{;()]+)?\s*\{", kind_name),),
    ((r"^\s+(?:public|protected)\s+" + some("static final synchronized abstract") + r"(?:<[^>]+>\s+)?" + JAVA_TYPE + r"\s+" + NAME + ARGS, typed_method),), doc=doc_block,
)
kotlin = Tongue(
    ((r"^" + some("public internal") + some("data sealed abstract open") + r"(?P<kind>class|interface|object)\s+" + NAME + r"[^{]*\{", kind_name),),
    ((r"^\s+" + some("public internal override") + some("suspend") + KOTLIN, kotlin_fun),), ((r"^" + some("public internal") + some("suspend") + KOTLIN, kotlin_fun),),
)
csharp = Tongue(
    ((r"^[ \t]*" + some("public internal protected") + some("abstract sealed static partial") + r"(?P<kind>class|enum|interface|record|struct)\s+" + NAME + r"(?:<[^{]*>)?(?:\s*:\s*[^{;()]+)?\s*\{", kind_name),),
    ((r"^\s+(?:public|internal|protected)\s+" + some("static virtual override async abstract sealed") + CS_TYPE + r"\s+" + NAME + ARGS, typed_method),),
)
swift = Tongue(
    ((r"^" + some("public internal open") + some("final") + r"(?P<kind>actor|class|enum|protocol|struct)\s+" + NAME + GENERIC + r"(?:\s*:[^{]+)?\s*\{", kind_name),),
    ((r"^\s+" + some("public internal open static class mutating async") + SWIFT, swift_func),), ((r"^" + some("public internal static async") + SWIFT, swift_func),),
)
rust = Tongue(
    (*((rf"^pub\s+(?P<kind>{k})\s+" + NAME, lambda m: f"pub {m['kind']} {m['name']}") for k in ("struct", "enum", "trait")), (r"^impl(?:<[^>]*>)?\s+(?:[\w:<>]+\s+for\s+)?" + NAME + r"(?:<[^{]*>)?\s*\{", lambda m: f"impl {m['name']}")),
    ((r"^\s+" + RUST, rust_fn),), ((r"^" + RUST, rust_fn),), with_members="impl ", quotes='"', doc=doc_lines("///"),
)
scala = Tongue(
    ((r"^(?P<case>case\s+)?(?P<kind>class|object|trait)\s+" + NAME + r"[^{]*\{", lambda m: ("case " if m["case"] else "") + kind_name(m)),),
    ((r"^\s+" + some("override final implicit") + SCALA, scala_def),), ((r"^" + SCALA, scala_def),), quotes='"',
)
go = Tongue(
    tuple((rf"^type\s+{NAME}\s+(?P<kind>{k})\s*\{{", lambda m: f"type {m['name']} {m['kind']}") for k in ("struct", "interface")),
    ((r"^\s+" + NAME + ARGS + r"(?P<rest>[^\n]*)", lambda m: f"{m['name']}({flat(m['args'])}){arrow(m['rest'], 30)}"),),
    ((r"^func\s+(?:\((?P<owner>\w+)\s+[\w*\[\]]+\)\s+)?" + NAME + ARGS + r"(?P<rest>[^{]*)\{", go_method),), with_members=r"type \w+ interface", quotes="\"`", doc=doc_lines("//"),
)
php = Tongue(
    ((r"^" + some("abstract final") + r"(?P<kind>class|interface|trait)\s+" + NAME + r"(?:\s+(?:extends|implements)\s[^{]+)?\s*\{", kind_name),),
    ((r"^\s+(?:public|protected)\s+(?:static\s+)?" + PHP, php_function),), ((r"^" + PHP, php_function),), hash_comments=True,
)
dart = Tongue(
    ((r"^(?P<abstract>abstract\s+)?(?P<kind>class)\s+" + NAME + r"[^{;]*\{", lambda m: ("abstract " if m["abstract"] else "") + kind_name(m)),),
    ((r"^\s+(?:@\w+\s+)*" + DART, dart_method),), ((r"^" + DART, dart_method),),
)
cpp = Tongue(
    ((r"^(?P<kind>class|struct)\s+" + NAME + r"(?:\s*:[^{;]+)?\s*\{", kind_name),),
    ((r"^\s+(?P<ret>" + some("virtual static inline explicit") + r"(?:[\w:*&<>, ]*[\w*&>]\s+[*&]*)?)" + NAME + ARGS + r"\s*" + some("const noexcept override") + r"(?:const|noexcept|override)?\s*(?:=\s*0\s*)?[;{]", cpp_member),),
    ((r"^(?!class|else|for|if|struct|switch|while)(?P<ret>[\w:*&<> ]*[\w*&>]\s+[*&]*)" + NAME + ARGS + r"\s*(?:const\s*)?\{", typed_method),), anchors=False, quotes='"',
)


NOT_METHODS = frozenset("catch do else finally for if return switch try while".split())


def js_method(m: re.Match) -> str | None:
    if m["name"] in NOT_METHODS or m["name"].startswith("_"):
        return None
    words = m[0][: m.start("name") - m.start()].split()
    return "".join(f"{w} " for w in ("static", "async") if w in words) + f"{m['name']}({flat(m['args'])})"


def ts_method(m: re.Match) -> str | None:
    if m["name"] in NOT_METHODS or re.match(r"private|protected|_", m["name"]):
        return None
    words = m[0][: m.start("name") - m.start()].split()
    if m["name"] == "constructor":
        return f"constructor({names(m['args'])})"
    return "".join(f"{w} " for w in ("static", "async") if w in words) + f"{m['name']}({names(m['args'])}){arrow(m['ret'], 20)}"


def hook_shape(m: re.Match) -> str:
    """What a hook returns, if it returns an object."""
    back = re.search(r"return\s*\{([^}]{1,260})\}", m.string[m.end() : m.end() + 800]) if m["name"].startswith("use") else None
    keys = [k for k in (re.split("[:(]", x.strip())[0].strip() for x in back[1].split(",")) if k][:MEMBERS] if back else []
    return f" → {{ {', '.join(keys)} }}" if keys else ""


def ts_function(m: re.Match) -> str:
    return f"export {'async ' if m['async'] else ''}function {m['name']}({names(m['args'])}){arrow(m['ret'], 30)}{hook_shape(m)}"


def ts_const(m: re.Match) -> str:
    return f"export const {m['name']} = {'async ' if m['async'] else ''}({names(m['args'])}) =>{hook_shape(m)}"


TS_RETURN = r"(?:\s*:\s*(?P<ret>[^{;]+))?\s*\{"
CONST = r"^export\s+const\s+" + NAME + r"\s*(?::[^=]+)?=\s*(?P<async>async\s+)?" + ARGS[3:]
JS_CLASS = r"^(?P<export>export\s+(?:default\s+)?)?(?P<abstract>abstract\s+)?class\s+" + NAME + r"[^{;()]*\{"
js_class = lambda m: f"{'export ' if m['export'] else ''}{'abstract ' if m['abstract'] else ''}class {m['name']}"
_js = Tongue(
    ((JS_CLASS, js_class),), ((r"^\s+" + some("static async get set") + NAME + ARGS + r"\s*\{", js_method),),
    ((r"^export\s+(?:default\s+)?(?P<async>async\s+)?function\*?\s+" + NAME + ARGS, lambda m: f"export {'async ' if m['async'] else ''}function {m['name']}({flat(m['args'])})"), (CONST + r"\s*=>", lambda m: f"export const {m['name']} = {'async ' if m['async'] else ''}({flat(m['args'])}) =>"), (r"^module\.exports\s*=\s*\{(?P<name>[^}]+)\}", lambda m: f"module.exports = {{ {flat(m['name'])} }}"), (r"^(?P<async>async\s+)?function\*?\s+" + NAME + ARGS, lambda m: None if m["name"].startswith("_") else f"{'async ' if m['async'] else ''}function {m['name']}({flat(m['args'])})")),
    whole=True, quotes="\"'`",
)
_ts = Tongue(
    ((JS_CLASS, js_class),), ((r"^\s+" + some("public static async override") + NAME + GENERIC + ARGS + TS_RETURN, ts_method),),
    ((r"^export\s+(?:default\s+)?(?P<async>async\s+)?function\s+" + NAME + r"\s*" + GENERIC + ARGS + TS_RETURN, ts_function), (CONST + r"\s*(?::\s*[^=>{]+)?=>", ts_const)), whole=True, quotes="\"'`",
)
_ts_shapes = Tongue(
    ((r"^export\s+(?P<kind>interface)\s+" + NAME + r"[^{]*\{", lambda m: f"export interface {m['name']}"), (r"^export\s+(?P<kind>type)\s+" + NAME + r"(?:<[^=]*>)?\s*=", lambda m: f"export type {m['name']}"), (r"^export\s+(?:const\s+)?(?P<kind>enum)\s+" + NAME + r"\s*\{", lambda m: f"export enum {m['name']}")),
    ((r"^\s+(?P<ro>readonly\s+)?" + NAME + r"(?P<opt>\??):\s*(?P<ret>[^;]+);", lambda m: f"{'readonly ' if m['ro'] else ''}{m['name']}{m['opt']}: {flat(m['ret'], 35)}"), (r"^\s+" + NAME + r"\s*" + GENERIC + ARGS + r"\s*:", lambda m: f"{m['name']}({names(m['args'])})")),
    with_members="export interface", quotes="\"'`",
)


def javascript(src: str) -> list[str]:
    return _js(src)


def typescript(src: str) -> list[str]:
    """Interfaces, types and enums, then classes and functions. An alias has no block of its own."""
    shapes = []
    for s in _ts_shapes(src):
        m = re.match(r"(export type \w+)  :(\d+)-\d+", s)
        shapes.append(f"{m[1]}  :{m[2]}-{m[2]}" if m else s)
    return (shapes + _ts(src))[:35]


def ruby(src: str) -> list[str]:
    s = blanked(src, "#", None)
    out = [f"{m[1]} {m[2]}" for m in re.finditer(r"^(module|class)[ \t]+([\w:]+)[^\n]*$", s, re.M)]
    for lead, indent in ((r"^\s+", "  "), ("^", "")):
        for m in re.finditer(lead + r"def\s+(?P<own>self\.)?(?P<name>\w+[?!=]?)(?:[ \t]*\((?P<args>[^)]*)\))?", s, re.M):
            if not m["name"].startswith("_"):
                typed = re.search(r"sig\s*\{[^}]*returns\(([^)]+)\)[^}]*\}\s*\Z", s[max(0, m.start() - 180) : m.start()])
                out.append(f"{indent}def {m['own'] or ''}{m['name']}" + (f"({flat(m['args'])})" if m["args"] else "") + arrow(typed and typed[1], 25))
    return out[:LINES]


def block_end(rows: list[str], first: int) -> int:
    """The last line of an indented block that begins at line `first`, from 1."""
    end = first
    for k in range(first, len(rows)):
        if rows[k].strip():
            if not rows[k][0].isspace():
                break
            end = k + 1
    return end


def python_args(args: str) -> str:
    out = []
    for part in args.split(","):
        part = part.strip()
        stars = re.match(r"\**", part)[0]
        bare = part[len(stars) :].split("=")[0].strip()
        bare = re.sub(r"Union\[([^\]]+),\s*None\]", r"\1?", re.sub(r"Optional\[([^\]]+)\]", r"\1?", bare))
        if stars + bare not in ("", "self", "cls"):
            out.append(stars + bare)
    return ", ".join(out)


def python(src: str) -> list[str]:
    """Classes with constants and methods, functions with what their documentation says first, routes."""
    code = blanked(src, "#", None)
    bare = re.sub(r'("""|\'\'\')(?s:.*?)\1', lambda m: re.sub(r"[^\n]", " ", m[0]), code)
    rows, out = src.split("\n"), []
    back = lambda t: arrow(re.sub(r"Optional\[([^\]]+)\]", r"\1|None", t or ""), 30, True)
    for m in re.finditer(r"^class[ \t]+(\w+)[ \t]*(?:\(([^)]*)\))?[ \t]*:", bare, re.M):
        first = line_of(bare, m.start())
        end = block_end(rows, first)
        body, base = "\n".join(bare.split("\n")[first:end]), flat(m[2])
        anchor = f"  :{first}-{end}"
        fields = re.findall(r"^[ \t]+(\w+)[ \t]*:[ \t]*[^=\n]+", body.split("def ")[0], re.M)[:6]
        above = bare[max(0, m.start() - 120) : m.start()].rstrip().split("\n")[-1]
        if above.startswith("@dataclass"):
            out.append(f"@dataclass {m[1]}({', '.join(fields)}){anchor}")
            continue
        if fields and re.search("BaseModel|BaseSettings", base):
            out.append(f"class {m[1]}({base}) {{{', '.join(fields)}}}{anchor}")
            continue
        out.append(f"class {m[1]}" + (f"({base})" if base else "") + anchor)
        for name, value in re.findall(r"^ {4}([A-Z][A-Z0-9_]+)[ \t]*=[ \t]*([^\n]+)", body, re.M)[:3]:
            value = value.strip()
            out.append(f"  {name} = {value[:37] + '...' if len(value) > 40 else value}")
        methods = [f"  {'async ' if d[1] else ''}def {d[2]}({python_args(d[3])}){back(d[4])}" for d in re.finditer(r"^[ \t]+(async\s+)?def\s+(\w+)\s*\(([^)]*)\)(?:\s*->\s*([^:\n]+))?\s*:", body, re.M) if not d[2].startswith("_") or d[2] == "__init__"]
        out += methods[:MEMBERS]
    for m in re.finditer(r"^(async\s+)?def\s+(\w+)\s*\(([^)]*)\)(?:\s*->\s*([^:]+))?\s*:", bare, re.M):
        if m[2].startswith("_"):
            continue
        first = line_of(bare, m.start())
        doc = re.match(r'\s*\n\s*[rubfRUBF]{0,2}("""|\'\'\')((?s:.*?))\1', src[m.end() : m.end() + 600])
        said = re.split("[.!?]", next((x.strip() for x in doc[2].split("\n") if x.strip()), ""))[0].strip()[:60] if doc else ""
        out.append(f"{'async ' if m[1] else ''}def {m[2]}({python_args(m[3])}){back(m[4])}  :{first}-{block_end(rows, first)}" + (f"  # {said}" if said else ""))
    for m in re.finditer(r"^[ \t]*@\w+\.(delete|get|head|patch|post|put)\s*\(\s*['\"]([^'\"]+)[^\n]*\n(?:[ \t]*@[^\n]*\n){0,4}[ \t]*(?:async\s+)?def\s+(\w+)", code, re.M):
        first = line_of(code, m.end())
        out.append(f"{m[1].upper()} {m[2]}  →  {m[3]}()  :{first}-{block_end(rows, first)}")
    return out[:30]


ASSIGN = r"\s*(?:<<-|<-|=)\s*"


def r_lang(src: str) -> list[str]:
    """R6 and S7 classes with their methods, functions, S4 declarations; what roxygen comments say first."""
    s, hints, block = blanked(src, "#", None), {}, []
    for row in src.split("\n"):
        if row.lstrip().startswith("#'"):
            block.append(row.lstrip()[2:].strip())
        elif row.strip():
            if block and (m := re.match(r"\s*([\w.]+)" + ASSIGN, row)):
                tagged = lambda tag: next((x[len(tag) :].strip() for x in block if x.startswith(tag) and x[len(tag) :].strip()), "")  # noqa: B023, E731
                said = tagged("@title") or tagged("@description") or next((x for x in block if x and x[0] != "@"), "")
                hints[m[1]] = flat(said, 60).strip().rstrip(".,;:!?").strip()
            block = []
    note = lambda n: f"  # {hints[n]}" if hints.get(n) else ""
    spans, out, s7 = [], [], set()

    def args_at(at: int) -> str:
        return flat(s[at + 1 : closes(s, at, "()")]).strip(" ,")

    for kind, package in (("R6Class", "R6"), ("new_class", "S7")):
        for m in re.finditer(rf"([\w.]+){ASSIGN}(?:{package}::)?{kind}\s*\(", s):
            end = closes(s, m.end() - 1, "()")
            spans.append((m.start(), end))
            if m[1].startswith("."):
                continue
            title = re.match(r"\s*[\"']([^\"']+)", s[m.end() : end])
            title = title[1] if title else m[1]
            out.append(f'{m[1]} <- {kind}("{title}"){note(m[1])}')
            if kind == "R6Class":
                inner = [f"  {x[1]} <- function({args_at(x.end() - 1)})" for x in re.compile(r"([\w.]+)\s*=\s*function\s*\(").finditer(s, m.end(), end) if not x[1].startswith(".")]
                out += inner[:MEMBERS]
            else:
                s7 |= {m[1], title}
    for m in re.finditer(rf"^[ \t]*method\s*\(\s*([\w.]+)\s*,\s*([\w.]+)\s*\){ASSIGN}function\s*\(", s, re.M):
        if m[2] in s7:
            out.append(f"  method({m[1]}, {m[2]}) <- function({args_at(m.end() - 1)})")
    for m in re.finditer(rf"^[ \t]*([\w.]+){ASSIGN}function\s*\(", s, re.M):
        if not m[1].startswith(".") and not any(a <= m.start() <= b for a, b in spans):
            out.append(f"{m[1]} <- function({args_at(m.end() - 1)}){note(m[1])}")
    for kind, n in (("setGeneric", 1), ("setMethod", 2), ("setClass", 1)):
        for m in re.finditer(rf"^[ \t]*{kind}\s*\(\s*" + r"\s*,\s*".join([r"[\"']([\w.]+)[\"']"] * n), s, re.M):
            out.append(f"{kind}(" + ", ".join(f'"{x}"' for x in m.groups()) + ")")
    return out[:30]


def css(src: str) -> list[str]:
    s = blanked(src, "", ("/*", "*/"))
    root = re.search(r":root\s*\{([^}]*)", s)
    out = [f"var {x}" for x in re.findall(r"(--[\w-]+)\s*:", root[1])] if root else []
    out += [f"$var {x}" for x in re.findall(r"^(\$[\w-]+)\s*:", s, re.M)]
    out += [f"@mixin {n}" + (f"({flat(a)})" if a else "") for n, a in re.findall(r"^@mixin\s+([\w-]+)(?:\s*\(([^)]*)\))?", s, re.M)]
    out += [f"@function {n}({flat(a)})" for n, a in re.findall(r"^@function\s+([\w-]+)\s*\(([^)]*)\)", s, re.M)]
    classes = list(dict.fromkeys(re.findall(r"^\.([\w-]+)[^{}]*\{", s, re.M)))
    utility = [c for c in classes if "-" not in c and len(c) < 4 or re.search(r"-(?:\d+|2?xl|lg|md|sm|xs)\Z", c)]
    if len(classes) < 5 or len(utility) < 0.7 * len(classes):
        out += ["." + c for c in [*(c for c in classes if "-" in c or "__" in c), *(c for c in classes if "-" not in c and "__" not in c)][:8]]
    return out[:LINES]


def html(src: str) -> list[str]:
    title = re.search(r"<title[^>]*>(.*?)</title>", src, re.S | re.I)
    out = [f"title: {title[1].strip()}"] if title and title[1].strip() else []
    for attributes in re.findall(r"<form\s+([^>]*)>", src, re.I):
        name, goes = re.search(r"\bid=[\"']?(\w+)", attributes), re.search(r"\baction=[\"']?([^\"'\s>]+)", attributes)
        if name:
            out.append(f"form#{name[1]}" + (f' action="{goes[1]}"' if goes else ""))
    # an id of word signs only, whatever stands before it in the tag
    out += [f"{tag}#{name}" for tag, name in re.findall(r"""<(\w+)\s[^>]*?\bid=["'](\w+)["']""", src, re.I) if tag.lower() not in ("html", "head", "body", "script", "style", "link", "meta")]
    out += [f"data-{k}: {v}" for k, v in re.findall(r"""\bdata-(component|controller|page|view)=["'](\w[\w-]*)""", src, re.I)]
    return out[:LINES]


def script_of(src: str) -> str:
    m = re.search(r"<script(?:\s[^>]*)?>\s*(.*?)</script>", src, re.S | re.I)
    return blanked(m[1]) if m else ""


def script_function(m: re.Match, export: bool) -> str | None:
    if m["name"].startswith("_"):
        return None
    return f"{'export ' if export else ''}{'async ' if m['async'] else ''}function {m['name']}({flat(m['args'])}){arrow(m['ret'], 25)}"


FUNCTION = r"(?P<async>async\s+)?function\s+" + NAME + ARGS + r"(?:\s*:\s*(?P<ret>[^{=\n]+))?"


def svelte(src: str) -> list[str]:
    s = script_of(src)
    out = [f"export let {x}" for x in re.findall(r"^\s+export\s+let\s+(\w+)(?:\s*=[^;]+)?;", s, re.M)]
    out += [script_function(m, True) for m in re.finditer(r"^export\s+" + FUNCTION, s, re.M)]
    out += [script_function(m, False) for m in re.finditer(r"^" + FUNCTION, s, re.M)]
    return [x for x in [*out, *(f"$: {x}" for x in re.findall(r"^\s+\$:\s+(\w+)\s*=", s, re.M))] if x][:LINES]


def vue(src: str) -> list[str]:
    s = script_of(src)
    name = re.search(r"\bname\s*:\s*['\"](\w+)['\"]", src)
    out = [f"component {name[1]}"] if name else []

    def object_keys(pattern: str) -> list[str]:
        m = re.search(pattern, s)
        if not m:
            return []
        body = s[m.end() : closes(s, m.end() - 1)]
        inner = re.sub(r"\{[^{}]*\}", "", body)
        return re.findall(r"^\s*(\w+)\??\s*:", inner, re.M)

    def listed(label: str, keys: list[str]) -> None:
        if keys:
            out.append(f"{label}: [{', '.join(keys)}]")

    # of an options object the first key that begins a line, up to the first closing brace
    options = re.search(r"\bprops\s*:\s*\{([^}]*)\}", s)
    listed("props", re.findall(r"^\s+(\w+)\s*:", options[1], re.M) if options else [])
    methods = re.search(r"\bmethods\s*:\s*\{", s)
    if methods:
        end = closes(s, methods.end() - 1)
        depth_one = [m for m in re.compile(r"^\s+(?P<async>async\s+)?" + NAME + ARGS + r"(?:\s*:\s*(?P<ret>[^{=\n]+))?\s*\{", re.M).finditer(s, methods.end(), end)]
        out.extend(f"  {'async ' if m['async'] else ''}{m['name']}({flat(m['args'])}){arrow(m['ret'], 25)}" for m in depth_one if not m["name"].startswith("_") and m["name"] not in NOT_METHODS)
    out += [x for m in re.finditer(r"^(?:export\s+)?" + FUNCTION, s, re.M) if (x := script_function(m, False))]
    listed("props", object_keys(r"\bdefineProps(?:<[^>]*>)?\s*\(\s*\{"))
    emits = re.search(r"\b(?:defineEmits|emits)\s*(?::|\()\s*(\[[^\]]*\])", s)
    return (out + ([f"emits: {flat(emits[1])}"] if emits else []))[:LINES]


def shell(src: str) -> list[str]:
    s, out = blanked(src, "#", None), []
    for row in src.split("\n")[:5]:
        if row.startswith("#") and not row.startswith("#!") and row.strip("# "):
            out.append(f"# {row.lstrip('#').strip()}")
            break
    out += [f"function {x}()" for x in re.findall(r"^(?:function\s+)?([\w:-]+)\s*\(\s*\)\s*\{", s, re.M) if not x.startswith("_")]
    if re.search(r"^\s*main\s*(?:\(|\"?\$@)", src, re.M):
        out.append('main "$@"')
    return (out + [f"export {x}" for x in re.findall(r"^export\s+(\w+)=", s, re.M)])[:LINES]


def yaml(src: str) -> list[str]:
    top = list(dict.fromkeys(re.findall(r"^([\w-]+)\s*:", src, re.M)))
    out = [f"keys: [{', '.join(top[:12])}]"] if top else []
    for section, label, key in (("jobs", "job", r"[\w-]+"), ("services", "service", r"[\w-]+"), ("paths", "path", r"/[\w/{}-]*")):
        if m := re.search(rf"^{section}\s*:[^\n]*\n((?:[ \t][^\n]*\n?|[ \t]*\n)*)", src, re.M):
            out += [f"{label}: {x}" for x in re.findall(rf"^ {{2}}({key})\s*:", m[1], re.M)]
    return out[:LINES]


def gdscript(src: str) -> list[str]:
    """The class of a file with signals, enums, constants, variables and functions, then its inner classes."""
    s = blanked(src, "#", None)
    name, base = re.search(r"^class_name\s+(\w+)(?:\s+extends\s+([\w.]+))?", s, re.M), re.search(r"^extends\s+([\w.\"/]+)", s, re.M)
    parent = name and name[2] or base and base[1]
    out = [f"class {name[1]}" + (f"({parent})" if parent else "")] if name else [f"extends {parent}"] if parent else []
    lead = "  " if out else ""
    out += [f"{lead}signal {n}({names(a)})" for n, a in re.findall(r"^signal\s+(\w+)(?:\s*\(([^)]*)\))?", s, re.M)]
    out += [f"{lead}enum {n} {{ {', '.join([x.split('=')[0].strip() for x in a.split(',') if x.strip()][:6])} }}" for n, a in re.findall(r"^enum\s+(\w+)\s*\{([^}]*)\}", s, re.M)]
    for n, v in re.findall(r"^const\s+(\w+)(?:\s*:\s*[^=\n]+?)?\s*:?=\s*([^\n]+)$", s, re.M):
        out.append(f"{lead}const {n} = {v.strip()[:37] + '...' if len(v.strip()) > 40 else v.strip()}")
    for marks, n, kind in re.findall(r"^((?:@\w+(?:\([^)]*\))?\s+)*)var\s+(\w+)(?:\s*:\s*(\w[^=\n]*?))?(?:\s*:?=[^\n]*)?$", s, re.M):
        if not n.startswith("_"):
            words = [x.split("(")[0] for x in re.findall(r"@\w+(?:\([^)]*\))?", marks)]
            out.append(lead + " ".join([*words, "var", n]) + (f": {kind.strip()}" if kind else ""))
    line = lambda m: f"{'static ' if m[1] else ''}func {m[2]}({names(m[3])}){arrow(m[4], 30)}"
    func = r"(static\s+)?func\s+(\w+)\s*\(([^)]*)\)(?:\s*->\s*([^:\n]+))?\s*:"
    out += [lead + line(m) for m in re.finditer("^" + func, s, re.M)]
    rows = s.split("\n")
    for m in re.finditer(r"^class\s+(\w+)(?:\s+extends\s+(\w+))?\s*:", s, re.M):
        if name and m[1] == name[1]:
            continue
        out.append(f"class {m[1]}" + (f"({m[2]})" if m[2] else ""))
        first = line_of(s, m.start())
        body = "\n".join(rows[first : block_end(rows, first)])
        out += ["  " + line(x) for x in re.finditer(r"^[ \t]+" + func, body, re.M)][:6]
    return out[:LINES]
