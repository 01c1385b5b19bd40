"""Text functions as Column expressions: they stay in generated code and never enter Python.

All are null-safe: a null text gives an empty array, null label or null text, as each says.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

RANKER_STOP = sorted("a an and are as at be by do for from get if in is it no not of on or set so that the this to up use we with".split())
INDEX_STOP = sorted("a add an and are as at be by for from get in into is it its new of on or return set test that the this to value with".split())
SUFFIXES = "able|al|ation|ations|ed|edly|er|ers|ible|ing|ise|ity|ive|ize|ment|ness"
CAMEL = [("([a-z])([A-Z])", "$1 $2"), ("([A-Z]+)([A-Z][a-z])", "$1 $2")]


#: Java's own word bound knows letters beyond ASCII: it sees none in "testä".
BOUND = r"(?:(?<![0-9A-Za-z_])(?=[0-9A-Za-z_])|(?<=[0-9A-Za-z_])(?![0-9A-Za-z_]))"


def java(pattern: str) -> str:
    """A pattern for Java, with word bounds at ASCII words only, as SQL and JavaScript have them."""
    return pattern.replace(r"\b", BOUND)


def replaced(c: Column, *steps: tuple[str, str]) -> Column:
    return reduce(lambda x, s: F.regexp_replace(x, F.lit(java(s[0])), F.lit(s[1])), steps, c)


def words(c: Column, stop: list[str], least: int) -> Column:
    return F.filter(F.split(c, " +"), lambda t: (F.length(t) >= least) & ~t.isin(stop))


def ranker_tokens(text: Column) -> Column:
    """Distinct words of identifiers and paths, in order, without file endings and stop words."""
    c = replaced(F.coalesce(text, F.lit("")), (r"\.\w{1,6}(?=\s|/|\z)", " "), *CAMEL, (r"[_\-./]", " "), (r"[^\w\s]", " "), (r"\s+", " "))
    return F.array_distinct(words(F.lower(c), RANKER_STOP, 2))


def stem(w: Column) -> Column:
    """A light stemmer: words of up to 3 signs stay, and so does a word that would become shorter than 3."""
    s = replaced(w, (r"ies\z", "y"), (r"(ss|sh|ch|x|z)es\z", "$1"), (r"([^s])s\z", "$1"), (r"izations?\z", "ize"), (rf"({SUFFIXES})\z", ""))
    # of the stem and the word the first that is long enough: the chain is evaluated once
    return F.when(F.length(w) <= 3, w).otherwise(F.get(F.filter(F.array(s, w), lambda x: F.length(x) >= 3), F.lit(0)))


def index_words(text: Column) -> Column:
    """The words of index_tokens before they are stemmed."""
    c = replaced(F.coalesce(text, F.lit("")), ("[^A-Za-z0-9]+", " "), ("([a-z0-9])([A-Z])", "$1 $2"), CAMEL[1])
    return words(F.lower(c), INDEX_STOP, 2)


def index_tokens(text: Column) -> Column:
    """Stemmed words, repeats kept, for postings."""
    return F.transform(index_words(text), stem)


def judge_tokens(text: Column) -> Column:
    """Lower-case words of three signs or more that begin with a letter, repeats kept."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"(?<![A-Za-z0-9_])[a-z][a-z0-9_]{2,}"), 0)


#: First match wins.
INTENTS = [
    ("debug", r"\b(broken|bug|crash|error|exception|failing|fix|issue|problem|regression)\b"),
    ("explain", r"\b(architecture|describe|explain|how does|overview|teach|understand|walk me|what is)\b"),
    ("refactor", r"\b(clean up|extract|move|optimize|redesign|refactor|rename|restructure|simplify)\b"),
    ("review", r"\b(assess|audit|check|pr|pull request|review|security|validate)\b"),
    ("test", r"\b(assert|integration test|mock|spec|test|testing|unit test)\b"),
    ("integrate", r"\b(bind|connect|depend|export|graph|import|integrate|require|wire)\b|require[ds]\b"),
    ("navigate", r"\b(browse|find|list|locate|look for|navigate|search|show me|where)\b"),
]


def first_label(c: Column, rules: list[tuple[str, str]], default) -> Column:
    out = None
    for label, pattern in rules:
        out = (F.when if out is None else out.when)(c.rlike(pattern), F.lit(label))
    return out.otherwise(F.lit(default))


def intent(query: Column) -> Column:
    # a dotted capital I becomes one sign, as in SQL; the other signs beyond ASCII bound words: one pass is cheaper than seven patterns that look around
    plain = F.regexp_replace(F.lower(F.translate(query, "\u0130", "i")), r"[^\x00-\x7F]", "\x01")
    return F.coalesce(first_label(plain, INTENTS, "search"), F.lit("search"))


PENALTIES = [
    (0.0, "node_modules"),
    (0.4, r"(^|/)(__tests__|e2e|spec|test|tests)(\z|/)"),
    (0.3, r"(^|/)(\.next|\.nuxt|\.venv|build|dist|out|venv)(\z|/)"),
    (0.2, r"(^|/)(changelog|doc|docs|readme)(\z|/)"),
]


def path_penalty(path: Column) -> Column:
    return F.coalesce(first_label(F.lower(path), PENALTIES, 1.0), F.lit(1.0))


def hub_name(path: Column) -> Column:
    """Whether a path names a shared helper, whatever its fan-in."""
    return path.rlike(r"/(common|constants|globals|helpers|index|interfaces|shared|types|utils|zzz)\.(R|js|jsx|r|ts|tsx)\z")


def token_estimate(sigs: Column) -> Column:
    """A quarter of the signs of the signatures joined by line ends, rounded up."""
    return F.ceil(F.length(F.array_join(sigs, "\n")) / 4).cast("long")


def token_estimate_apart(sigs: Column) -> Column:
    """As token_estimate, without the line ends."""
    return F.ceil(F.length(F.array_join(sigs, "")) / 4).cast("long")


ANCHOR = r"\s*:(\d+)-(\d+)\s*\z"


def anchor(sig: Column) -> Column:
    """symbol, start, end of a signature with a trailing :start-end."""
    has = sig.rlike(ANCHOR)
    part = lambda i: F.when(has, F.regexp_extract(sig, ANCHOR, i).cast("int"))
    return F.struct(F.trim(F.regexp_replace(sig, ANCHOR, "")).alias("symbol"), part(1).alias("start"), part(2).alias("end"))


def line_at(text: Column, offset: Column) -> Column:
    """1 and the line ends before an offset."""
    head = F.substr(text, F.lit(1), offset)
    return 1 + F.length(head) - F.length(F.replace(head, F.lit("\n"), F.lit("")))


def base_name(path: Column) -> Column:
    return F.regexp_extract(path, r"[^/]*\z", 0)


def name_stem(name: Column) -> Column:
    """A base name up to its first dot, unless it begins with one."""
    return F.when(F.instr(name, ".") > 1, F.substring_index(name, ".", 1)).otherwise(name)


def naming_style(name: Column) -> Column:
    s = name_stem(F.coalesce(name, F.lit("")))
    return (
        F.when(s.rlike(r"\A[a-z0-9]+(-[a-z0-9]+)+\z"), "kebab-case")
        .when(s.rlike(r"\A[a-z0-9]+(_[a-z0-9]+)+\z"), "snake_case")
        .when(s.rlike(r"\A[A-Z][A-Za-z0-9]*\z") & s.rlike("[a-z]"), "PascalCase")
        .when(s.rlike(r"\A[a-z][A-Za-z0-9]*\z") & s.rlike("[A-Z]"), "camelCase")
        .when(s.rlike(r"\A[a-z][a-z0-9]*\z"), "single-word")
        .otherwise("other")
    )


def restyled(name: Column, style: str) -> Column:
    """A name's stem in another style, its endings kept."""
    s = name_stem(name)
    w = F.split(F.lower(F.trim(replaced(s, ("([a-z0-9])([A-Z])", "$1 $2"), CAMEL[1], ("[-_ ]+", " ")))), " ")
    caps = F.transform(w, F.initcap)
    new = {
        "kebab-case": F.array_join(w, "-"),
        "snake_case": F.array_join(w, "_"),
        "PascalCase": F.array_join(caps, ""),
        "camelCase": F.concat(w[0], F.array_join(F.slice(caps, 2, 1000), "")),
    }[style]
    return F.concat(new, F.substr(name, F.length(s) + 1))


def export_style(src: Column) -> Column:
    named = r"\bexport\s+(async\s+function|class|const|enum|function|interface|let|type|var)\b|\bexport\s+\{|\bmodule\.exports\s*=\s*\{|\bexports\.[A-Za-z_$]"
    return F.when(src.rlike(java(r"\bexport\s+default\b")), "default").when(src.rlike(java(r"\bmodule\.exports\s*=\s*\{")), "named").when(src.rlike(java(r"\bmodule\.exports\s*=\s*(class|function|[A-Za-z_$])")), "default").when(src.rlike(java(named)), "named").otherwise("other")


def _whole(names: str) -> str:
    return rf"(?i)(^|/|[._-])({names})([._-]|/|\z)"


RISKS = [
    ("generated", r"(^|/)(build|dist|node_modules|out|vendor)/|\.(bundle|generated|min)\.|\.(_pb|pb)\.|_pb2\.py\z"),
    ("test", r"(^|/)(__tests__|specs?|tests?)/|\.(spec|test)\.[a-z]+\z|(^|/)test_[^/]+\.py\z|_test\.(go|py|rb)\z"),
    ("migration", r"(?i)(^|/)(alembic/versions|migrations?|prisma/migrations)(/|\z)|(^|/)db/migrate/|(^|/)V[0-9]+(_[0-9]+)*__[^/]+[.](java|sql)\z|(^|/)[0-9]{8,}[-_][^/]+[.](js|py|rb|sql|ts)\z|[._-]migrations?[._-]"),
    ("payment", _whole("billing|braintree|charge|checkout|invoice|invoicing|payments?|payout|paypal|refund|stripe|subscription")),
    ("auth", _whole("acl|auth|authn|authz|credentials?|jwt|login|logout|oauth|passwd|password|permissions?|rbac|session|signin|signup")),
    ("security", _whole("cipher|crypto|decrypt|encrypt|keystore|secrets?|signing|token|vault")),
    ("config", r"(?i)\.(conf|config|env|ini|json|properties|toml|ya?ml)\z|(^|/)\.?[a-z]+rc\z|\.config\.[a-z]+\z"),
    ("public-api", r"(?i)(^|/)api(/|\z)|(^|/)public[-_]?api(/|\z)|(^|/)index\.(cjs|js|mjs|ts)\z"),
]


def risk_factors(path: Column) -> Column:
    """All risks of a path in order of weight, or source; the first is its label."""
    found = F.filter(F.array(*[F.when(path.rlike(p), F.lit(k)) for k, p in RISKS]), lambda x: x.isNotNull())
    return F.when(F.size(found) > 0, found).otherwise(F.array(F.lit("source")))


def file_stem(path: Column) -> Column:
    return replaced(base_name(path), (r"\.[^.]+\z", ""), (r"(?i)\.(spec|test)\z", ""))


def tested_stem(path: Column) -> Column:
    """The stem of what a test file tests."""
    return replaced(file_stem(path), (r"(?i)\Atest[_-]", ""), (r"(?i)[_-]test\z", ""), (r"(Specs?|Tests?)\z", ""))


def impact_test(path: Column) -> Column:
    return path.rlike(r"[./](__tests__|spec|test|tests)[./]|\.(spec|test)\.[jt]sx?\z|_test\.(py|[jt]sx?)\z|test_[^/]+\.py\z")


def blast_test(path: Column) -> Column:
    return path.rlike(r"\.(spec|test)\.[jt]sx?\z|(^|/)test_|_test\.(go|py)\z|(^|/)(__tests__|spec|tests?)/")


def route_file(path: Column) -> Column:
    return path.rlike(r"(?i)(router?|routes?|controller|views?|handlers?)\.[jt]sx?\z")


def routing_tier(path: Column, sigs: Column) -> Column:
    """fast, balanced or powerful: the model tier that a file's work needs."""
    p, n = F.lower(path), F.size(sigs)
    members = F.size(F.filter(sigs, lambda s: s.startswith("  ")))
    return (
        F.when(p.rlike(r"\.(bash|css|env|fish|html?|json|less|s[ac]ss|sh|toml|ya?ml|zsh)\z|dockerfile"), "fast")
        .when(p.rlike("/(configs?|fixtures|migrations|seeds)/"), F.when(n > 4, "balanced").otherwise("fast"))
        .when(p.rlike(r"(\.(spec|test)|_test)\.[a-z]+\z"), "balanced")
        .when(p.rlike("/(auth|compiler|core|crypto|engine|parser|scheduler|security)/|/orchestrat") | (n >= 12) | (members >= 8), "powerful")
        .when(n <= 2, "fast")
        .otherwise("balanced")
    )


#: In order; the first that matches names the redaction.
SECRETS = [
    ("AWS Access Key", "AKIA[A-Z0-9]{16}"),
    ("AWS Secret Key", r"(?i)(SecretAccessKey|aws_secret|secret_access_key)\s*[=:]\s*[\"']?[+/A-Za-z0-9]{40}"),
    ("GCP API Key", r"AIza[0-9A-Za-z_-]{35}"),
    ("GitHub Token", "gh[opsur]_[A-Za-z0-9_]{36,}"),
    ("JWT Token", r"eyJ[\w-]+\.[\w-]+\.[\w-]+"),
    ("DB Connection String", r"(?i)(mongodb|mysql|postgres|postgresql|redis)://[^:]+:[^@]+@"),
    ("SSH Private Key", "-----BEGIN ((DSA|EC|OPENSSH|RSA) )?PRIVATE KEY-----"),
    ("Stripe Key", "sk_(test|live)_[A-Za-z0-9]{24,}"),
    ("Twilio Key", "SK[A-Fa-f0-9]{32}"),
    ("Generic Secret", r"(?i)(access_token|api_key|apikey|auth_token|passwd|password|secret)\s*[=:]\s*[\"'][^\"']{8,}[\"']"),
]


def secret_name(sig: Column, extra: tuple[tuple[str, str], ...] = ()) -> Column:
    return first_label(sig, [(k, java(p)) for k, p in (*SECRETS, *extra)], None)


def redacted(sig: Column) -> Column:
    name = secret_name(sig)
    return F.when(name.isNotNull(), F.concat(F.lit("[REDACTED — "), name, F.lit(" detected in file]"))).otherwise(sig)


def terse(sig: Column) -> Column:
    """A signature line with less white space and shorter words; its anchor and hint stay."""
    tail = r"(\s+:\d+-\d+(\s+#.*)?\s*)\z"
    end = F.regexp_extract(sig, tail, 1)
    head = F.substr(sig, F.lit(1), F.length(sig) - F.length(end))
    steps = [(r"\bfunction\b", "fn"), (r"\s+→\s+", "→"), (r",\s+", ","), (r"\s+=\s+", "="), (r"\{\s+", "{"), (r"\s+\}", "}"), (r"(\S)\s{2,}(?=\S)", "$1 "), (r"\Amodule\.exports=", "exports=")]
    return F.concat(replaced(head, *steps), end)


def half_up(c: Column, digits: int) -> Column:
    return F.floor(c * 10**digits + 0.5) / 10**digits


def suggestion_confidence(distance: Column, length: Column) -> Column:
    ratio = distance / F.greatest(length, F.lit(1))
    return F.when(ratio <= 0.2, "high").when(ratio <= 0.4, "medium").otherwise("low")


def grade(points: Column) -> Column:
    return F.when(points >= 90, "A").when(points >= 75, "B").when(points >= 60, "C").otherwise("D")


def blast_tier(score: Column) -> Column:
    return F.when(score >= 60, "critical").when(score >= 30, "high").when(score >= 10, "medium").when(score >= 1, "low").otherwise("none")


def capped(items: Column, most: int, label: str) -> Column:
    """The first items, and a note of how many more there are."""
    more = F.size(items) - most
    return F.when(more > 0, F.concat(F.slice(items, 1, most), F.array(F.concat(F.lit("… +"), more.cast("string"), F.lit(f" more {label}"))))).otherwise(items)


def defined_symbol(sig: Column) -> Column:
    """The name that a signature defines: after a keyword, before a call, or its first word."""
    keyword = F.regexp_extract(sig, java(r"\b(?:class|const|def|enum|fn|fun|func|function|interface|let|object|struct|trait|type|var)\s+([A-Za-z_$][\w$]*)"), 1)
    call = F.regexp_extract(sig, r"([A-Za-z_$][\w$]*)\s*\(", 1)
    first = F.regexp_extract(sig, r"[A-Za-z_$][\w$]*", 0)
    return F.coalesce(F.nullif(keyword, F.lit("")), F.nullif(call, F.lit("")), F.nullif(first, F.lit("")))
