"""Sinks: bounded results as text for people and tools. What is rendered is a top-k or one row a module; nothing here collects a corpus."""

from __future__ import annotations

import hashlib
import json
import os
import tempfile

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MARKER = "## Auto-generated signatures"
HEADERS = {
    "assistant": "# Code signatures\n\nUse these before opening files.", "chat": "You know this code base by its signatures:", "editor": "# Editor rules\n\nSignatures of the project:",
    "agents": "# Agents\n\nThe project's signatures:", "plain": "", "web": "# llms.txt\n\n> Signatures of the project", "review": "# Review context", "wind": "# Rules\n\nSignatures:",
}


def adapt(name: str, context: str) -> str:
    """A context under the header of an adapter; an unknown adapter gives nothing."""
    return f"{HEADERS[name]}\n\n{context}".lstrip() if name in HEADERS else ""


def write_after_marker(path: str, generated: str, marker: str = MARKER) -> str:
    """Replaces what follows the marker in a file and keeps what people wrote before it; the file is exchanged whole."""
    old = ""
    if os.path.exists(path):
        with open(path, encoding="utf-8") as f:
            old = f.read()
    head = old.split(marker)[0].rstrip() if old else ""
    text = (head + "\n\n" if head else "") + marker + "\n\n" + generated.strip() + "\n"
    folder = os.path.dirname(os.path.abspath(path))
    with tempfile.NamedTemporaryFile("w", dir=folder, delete=False, encoding="utf-8") as f:
        f.write(text)
    os.replace(f.name, path)
    return text


def context_rows(sig_index: DataFrame) -> DataFrame:
    """path, block: the Markdown block of each file, made by columns, to be written by partition."""
    return sig_index.select("path", F.concat(F.lit("### "), "path", F.lit("\n```\n"), F.array_join("sigs", "\n"), F.lit("\n```\n")).alias("block"))


def atoms(docs: DataFrame, text: str = "text", most: int = 20_000) -> DataFrame:
    """id (SHA-256 of the title), title, body of each `## ` section not longer than `most`."""
    s = docs.select(F.explode(F.slice(F.split(F.concat(F.lit("\n"), text), "\n## "), 2, 1 << 30)).alias("s"))
    title = F.trim(F.substring_index("s", "\n", 1))
    return s.where(F.length("s") <= most).select(F.sha2(title, 256).alias("id"), title.alias("title"), F.col("s").alias("body"))


def rank_table(ranked: DataFrame, k: int = 10) -> str:
    """The k best of a ranking (path, score, confidence) as a Markdown table."""
    rows = ranked.orderBy(F.col("score").desc(), "path").limit(k).collect()
    lines = ["| # | file | score | confidence |", "|--:|---|--:|---|"]
    return "\n".join(lines + [f"| {i} | {r.path} | {r.score:.3f} | {r.confidence} |" for i, r in enumerate(rows, 1)])


def impact_text(impacted: DataFrame, most: int = 200) -> str:
    rows = impacted.orderBy("depth", "node").limit(most + 1).collect()
    out = [f"{'direct' if r.depth == 1 else f'depth {r.depth}'}: {r.node}" for r in rows[:most]]
    return "\n".join(out + ["… more"] * (len(rows) > most))


def canonical(value) -> tuple[str, str]:
    """JSON with sorted keys and its SHA-256."""
    text = json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False)
    return text, hashlib.sha256(text.encode()).hexdigest()


def sparkline(values: list[float]) -> str:
    bars, top = "▁▂▃▄▅▆▇█", max(values, default=0)
    return "".join(bars[min(7, int(v / top * 7.999))] if top > 0 else bars[0] for v in values)


def human(n: float) -> str:
    for size, sign in ((1e9, "B"), (1e6, "M"), (1e3, "K")):
        if abs(n) >= size:
            return f"{n / size:.1f}{sign}"
    return f"{n:.0f}"


def project_map(sections: dict[str, list[str]], most: int = 200) -> str:
    """Sections of lines as Markdown, each cut at `most` with a note."""
    out = ["# Project map"]
    for title, lines in sections.items():
        out += [f"\n## {title}", *(f"- {x}" for x in lines[:most])]
        if len(lines) > most:
            out.append(f"- … +{len(lines) - most} more")
    return "\n".join(out) + "\n"
