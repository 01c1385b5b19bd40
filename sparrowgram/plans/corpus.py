"""A small invented code base for queries that need paths and signatures; both engines get it as the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

FILES = [
    ("src/auth/login_service.py", ["class LoginService(Base)  :3-40", "  def verify(user, secret)  :9-18", "  def logout(user)  :20-25"]),
    ("src/auth/tests/test_login_service.py", ["def test_verify()  :1-9"]),
    ("src/billing/invoiceMaker.ts", ["export class InvoiceMaker  :1-80", "  total(lines)  :5-12", "  addTax(rate)  :14-20", "  render()  :22-60"]),
    ("src/billing/invoiceMaker.test.ts", ["function checksTotal()  :1-12"]),
    ("src/core/engine.go", ["func Run(ctx Context) error  :4-30"] + [f"func step{i}(x int) int  :{30 + 10 * i}-{38 + 10 * i}" for i in range(13)]),
    ("src/core/engine_test.go", ["func TestRun(t *testing.T)  :1-20"]),
    ("src/api/index.js", ["module.exports = { route, handler }", "function handler(req, res)  :5-9", "async function  loadAll(a,  b)  :11-30"]),
    ("src/parser/token-stream.rs", ["pub struct TokenStream  :1-9", "pub fn next_token(&mut self) → Token  :11-30"]),
    ("db/migrate/20240101_add_users.sql", ["TABLE users"]),
    ("config/app.yaml", ["keys: name, port, region"]),
    ("web/components/UserCard.tsx", ["component UserCard", "props UserCardProps"]),
    ("web/components/nav-bar.css", [".nav-bar", ".nav-item"]),
    ("web/pages/home_page.html", ["title: Home"]),
    ("docs/readme/intro.md", ["# Intro", "## Use"]),
    ("node_modules/left/index.js", ["module.exports = function pad(s)"]),
    ("dist/app.min.js", ["function a(b)"]),
    ("scripts/deploy.sh", ["deploy()", "export REGION"]),
    ("README.md", ["# Project"]),
    ("src/crypto/secretBox.kt", ["class SecretBox  :1-30", "  fun seal(text: String): Bytes  :3-9"]),
    ("src/util/helpers.ts", ["export function clamp(x, lo, hi)  :1-3"]),
]
NEW = [("src/auth/login_service.py", ["class LoginService(Base)  :3-44", "  def verify(user, secret)  :9-18", "  def refresh(user)  :20-25"]), ("src/core/engine.go", ["func Run(ctx Context) error  :4-30"]), ("src/new/cache.py", ["class Cache  :1-9"])]
EDGES = [(1, 2), (2, 3), (3, 1), (3, 4), (4, 5), (5, 4), (6, 6), (7, 1), (8, 7), (9, 10), (2, 1)]
WANTED = ["lineitm", "veryfi", "InvoceMaker", "nextToken", "qqqqqqqq", "handlr", "claamp"]


def text(s) -> str:
    return "'" + s.replace("'", "''") + "'" if isinstance(s, str) else str(s)


def values(rows: list[tuple]) -> str:
    cell = lambda c: "[" + ", ".join(map(text, c)) + "]" if isinstance(c, list) else text(c)
    return "(VALUES " + ", ".join("(" + ", ".join(map(cell, r)) + ")" for r in rows) + ")"


def files(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(FILES, "path string, sigs array<string>")


def lines(spark: SparkSession, rows=FILES) -> DataFrame:
    return spark.createDataFrame([(p, s) for p, ss in rows for s in ss], "path string, sig string")


FILES_SQL = values(FILES) + " f(path, sigs)"
LINES_SQL = values([(p, s) for p, ss in FILES for s in ss]) + " l(path, sig)"
NEW_SQL = values([(p, s) for p, ss in NEW for s in ss]) + " n(path, sig)"
EDGES_SQL = values(EDGES) + " e(src, dst)"
WANTED_SQL = values([(w,) for w in WANTED]) + " w(value)"
