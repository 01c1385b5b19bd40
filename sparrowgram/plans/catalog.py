"""Every query over the driver's tables, and the SQL each is checked against. All read their whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import conventions, counted, evaluate, evidence, graph, retrieval, squeeze, usage, verify
from ..sources import readers
from ..streaming import stateful
from . import corpus, samples

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# SQL of the text functions


def sub(e: str, *steps: tuple[str, str]) -> str:
    for p, r in steps:
        e = f"regexp_replace({e}, '{p}', '{r}', 'g')"
    return e


def listed(words: list[str]) -> str:
    return ", ".join(f"'{w}'" for w in words)


STEM = f"(CASE WHEN length(t) <= 3 THEN t WHEN length({{s}}) >= 3 THEN {{s}} ELSE t END)".replace("{s}", sub("t", ("ies$", "y"), ("(ss|sh|ch|x|z)es$", "\\1"), ("([^s])s$", "\\1"), ("izations?$", "ize"), (f"({T.SUFFIXES})$", "")))


def index_sql(e: str) -> str:
    return f"string_split(lower({sub(f"coalesce({e}, '')", ('[^A-Za-z0-9]+', ' '), ('([a-z0-9])([A-Z])', chr(92) + '1 ' + chr(92) + '2'), ('([A-Z]+)([A-Z][a-z])', chr(92) + '1 ' + chr(92) + '2'))}), ' ')"


def tokens_sql(table: str, key: str, text: str, name: str = "tok") -> str:
    """CTE name(key, t): stemmed words of every row."""
    return f"{name}_raw AS (SELECT {key}, unnest({index_sql(text)}) AS t FROM {table}), {name} AS (SELECT {key}, {STEM} AS t FROM {name}_raw WHERE length(t) > 1 AND t NOT IN ({listed(T.INDEX_STOP)}))"


def bm25_sql(terms: str) -> str:
    """CTEs up to sc(q, doc_id, score); terms is a CTE text that defines term(q, t, w)."""
    return f"""WITH {tokens_sql('documents', 'doc_id', 'text')},
len AS (SELECT doc_id, count(*) AS n FROM tok GROUP BY doc_id),
st AS (SELECT (SELECT count(*) FROM documents) AS total, (SELECT coalesce(sum(n), 0) FROM len) * 1.0 / (SELECT count(*) FROM documents) AS avgdl),
tf AS (SELECT doc_id, t, count(*) AS tf FROM tok GROUP BY doc_id, t), df AS (SELECT t, count(*) AS df FROM tf GROUP BY t),
{terms},
sc AS (SELECT q, tf.doc_id, sum(w * ln(1 + (total - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * n / avgdl))) AS score FROM term JOIN tf USING (t) JOIN df USING (t) JOIN len ON len.doc_id = tf.doc_id CROSS JOIN st GROUP BY q, tf.doc_id)"""


QUESTION = "licensed under the licence, releasing and creation of works"
ITEM_TERMS = f"{tokens_sql('benchmark', 'item_id', 'text', 'qt')}, term AS (SELECT DISTINCT item_id AS q, t, 1.0 AS w FROM qt)"
ONE_TERMS = f"one AS (SELECT 0 AS item_id, '{QUESTION}' AS text), {tokens_sql('one', 'item_id', 'text', 'qt')}, term AS (SELECT DISTINCT item_id AS q, t, 1.0 AS w FROM qt)"
TOP = " SELECT {q}doc_id, rank, round(score, 5) AS score FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY round(score, 6) DESC, doc_id) AS rank FROM sc) WHERE rank <= {k}"


@query(bm25_sql(ONE_TERMS) + TOP.format(q="", k=10))
def bm25_topk(spark: SparkSession, d: str) -> DataFrame:
    q = spark.createDataFrame([(0, QUESTION)], "q long, query string")
    s = retrieval.bm25(read(spark, d, "documents"), "doc_id", F.col("text"), q, "q", F.col("query"))
    return retrieval.top_k(s, "q", "doc_id", 10).select("doc_id", F.col("rank").cast("long").alias("rank"), F.round("score", 5).alias("score"))


@query(bm25_sql(ITEM_TERMS) + TOP.format(q="q AS item_id, ", k=5))
def bm25_multi_query(spark: SparkSession, d: str) -> DataFrame:
    s = retrieval.best(read(spark, d, "documents"), "doc_id", F.col("text"), read(spark, d, "benchmark"), "item_id", F.col("text"), 5)
    return s.select("item_id", "doc_id", F.col("rank").cast("long").alias("rank"), F.round("score", 5).alias("score"))


_groups = corpus.values([(i, w) for i, ws in enumerate(retrieval.GROUPS) for w in ws.split()])


@query(
    bm25_sql(
        f"one AS (SELECT 0 AS item_id, 'authentication error in the database configuration' AS text), {tokens_sql('one', 'item_id', 'text', 'qt')}, g AS (SELECT DISTINCT g, {STEM} AS s FROM {_groups} x(g, t)), "
        f"syn AS (SELECT DISTINCT a.s AS t, b.s AS o FROM g a JOIN g b USING (g) WHERE a.s <> b.s), allt AS (SELECT DISTINCT 0 AS q, t, 1.0 AS w FROM qt UNION ALL SELECT 0, o, {retrieval.SYNONYM} FROM qt JOIN syn USING (t)), term AS (SELECT q, t, max(w) AS w FROM allt GROUP BY q, t)"
    ).split("sc AS (")[0].rstrip(", \n") + " SELECT t AS token, w FROM term"
)
def bm25_expanded_terms(spark: SparkSession, d: str) -> DataFrame:
    q = spark.createDataFrame([(0, "authentication error in the database configuration")], "q long, query string")
    return retrieval.query_terms(q, "q", F.col("query"), expand=True).select("token", "w")


@query(f"""WITH r AS (SELECT doc_id, unnest(string_split(lower({sub("coalesce(text, '')", (chr(92) + '.[A-Za-z0-9_]{1,6}(' + chr(92) + 's|/|$)', ' ' + chr(92) + '1'), ('([a-z])([A-Z])', chr(92) + '1 ' + chr(92) + '2'), ('([A-Z]+)([A-Z][a-z])', chr(92) + '1 ' + chr(92) + '2'), ('[_./-]', ' '), ('[^0-9A-Za-z_' + chr(92) + 's]', ' '), (chr(92) + 's+', ' '))}), ' ')) AS t FROM documents)
SELECT doc_id, count(DISTINCT t) AS n_tokens FROM r WHERE length(t) >= 2 AND t NOT IN ({listed(T.RANKER_STOP)}) GROUP BY doc_id""")
def tokenize_ranker(spark: SparkSession, d: str) -> DataFrame:
    t = read(spark, d, "documents").select("doc_id", F.size(T.ranker_tokens(F.col("text"))).cast("long").alias("n_tokens"))
    return t.where("n_tokens > 0")


@query(f"WITH {tokens_sql('documents', 'doc_id', 'text')} SELECT t AS token, count(*) AS n, count(DISTINCT doc_id) AS n_docs FROM tok GROUP BY t")
def tokenize_index(spark: SparkSession, d: str) -> DataFrame:
    return counted.totals(read(spark, d, "documents"), "doc_id", F.col("text"))


@query(f"SELECT DISTINCT t AS word, {STEM} AS stem FROM (SELECT unnest({index_sql('text')}) AS t FROM documents) WHERE length(t) > 1 AND t NOT IN ({listed(T.INDEX_STOP)})")
def stem_vocab(spark: SparkSession, d: str) -> DataFrame:
    c = T.replaced(F.coalesce("text", F.lit("")), ("[^A-Za-z0-9]+", " "), ("([a-z0-9])([A-Z])", "$1 $2"), T.CAMEL[1])
    w = read(spark, d, "documents").select(F.explode(T.words(F.lower(c), T.INDEX_STOP, 2)).alias("word")).distinct()
    return w.select("word", T.stem(F.col("word")).alias("stem"))


@query("SELECT role, " + "CASE " + " ".join(f"WHEN regexp_matches(lower(text), '{p}') THEN '{k}'" for k, p in T.INTENTS) + " ELSE 'search' END AS intent, count(*) AS n FROM conversations GROUP BY 1, 2")
def intent_classify(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "conversations").groupBy("role", T.intent(F.col("text")).alias("intent")).agg(F.count(F.lit(1)).alias("n"))


def case_sql(rules, e: str, default) -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches({e}, '{p.replace(chr(92) + 'z', '$').replace(chr(39), chr(39) * 2)}') THEN {corpus.text(k)}" for k, p in rules) + f" ELSE {default} END"


@query(f"SELECT path, {case_sql(T.PENALTIES, 'lower(path)', '1.0')}::DOUBLE AS penalty FROM {corpus.FILES_SQL}")
def path_penalties(spark: SparkSession, d: str) -> DataFrame:
    return corpus.files(spark).select("path", T.path_penalty(F.col("path")).alias("penalty"))


@query(f"SELECT path, {case_sql(T.RISKS, 'path', chr(39) + 'source' + chr(39))} AS risk FROM {corpus.FILES_SQL}")
def risk_labels(spark: SparkSession, d: str) -> DataFrame:
    return corpus.files(spark).select("path", T.risk_factors(F.col("path"))[0].alias("risk"))


@query(f"""SELECT path, CASE WHEN regexp_matches(p, '\\.(bash|css|env|fish|html?|json|less|s[ac]ss|sh|toml|ya?ml|zsh)$|dockerfile') THEN 'fast' WHEN regexp_matches(p, '/(configs?|fixtures|migrations|seeds)/') THEN CASE WHEN n > 4 THEN 'balanced' ELSE 'fast' END
WHEN regexp_matches(p, '(\\.(spec|test)|_test)\\.[a-z]+$') THEN 'balanced' WHEN regexp_matches(p, '/(auth|compiler|core|crypto|engine|parser|scheduler|security)/|/orchestrat') OR n >= 12 OR m >= 8 THEN 'powerful' WHEN n <= 2 THEN 'fast' ELSE 'balanced' END AS tier
FROM (SELECT path, lower(path) AS p, len(sigs) AS n, len(list_filter(sigs, lambda s: starts_with(s, '  '))) AS m FROM {corpus.FILES_SQL})""")
def routing_tiers(spark: SparkSession, d: str) -> DataFrame:
    return corpus.files(spark).select("path", T.routing_tier(F.col("path"), F.col("sigs")).alias("tier"))


@query(f"SELECT module, count(*) AS files, sum(tokens)::BIGINT AS tokens FROM (SELECT CASE WHEN strpos(path, '/') > 0 THEN split_part(path, '/', 1) ELSE '.' END AS module, ceil(length(array_to_string(sigs, chr(10))) / 4)::BIGINT AS tokens FROM {corpus.FILES_SQL}) GROUP BY module")
def module_rollup(spark: SparkSession, d: str) -> DataFrame:
    return evidence.modules(corpus.files(spark).withColumn("tokens", T.token_estimate(F.col("sigs"))))


_tok = "regexp_extract_all(lower(coalesce({0}, '')), '\\b[a-z][a-z0-9_]{{2,}}\\b')"


@query(f"""WITH u AS (SELECT conv_id, string_agg(text, ' ' ORDER BY turn) AS context FROM conversations WHERE role = 'user' GROUP BY conv_id), a AS (SELECT conv_id, turn, {_tok.format('text')} AS a FROM conversations WHERE role = 'assistant'),
j AS (SELECT conv_id, turn, a, {_tok.format('context')} AS c FROM a LEFT JOIN u USING (conv_id)) SELECT conv_id, turn, CASE WHEN len(a) > 0 THEN floor(len(list_filter(a, lambda t: list_contains(c, t))) / len(a) * 1000 + 0.5) / 1000 ELSE 0.0 END AS score FROM j""")
def groundedness(spark: SparkSession, d: str) -> DataFrame:
    c = read(spark, d, "conversations")
    return evaluate.grounded_scores(c.where("role = 'assistant'"), c.where("role = 'user'"), "conv_id", ["conv_id", "turn"])


SCAN = [(k, p) for k, p in T.SECRETS]
BARE = ("Bare Token", r"(?i)\btoken\s*=\s*\"[0-9a-f]{40}\"")


@query(f"SELECT secret, count(*) AS n FROM (SELECT {case_sql([*SCAN, BARE], 'text', 'NULL')} AS secret FROM documents) WHERE secret IS NOT NULL GROUP BY secret")
def secret_scan_extended(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "documents").select(T.secret_name(F.col("text"), (BARE,)).alias("secret")).where("secret IS NOT NULL").groupBy("secret").agg(F.count(F.lit(1)).alias("n"))


@query(f"SELECT doc_id, {case_sql(SCAN, 'text', 'NULL')} AS secret FROM documents WHERE {case_sql(SCAN, 'text', 'NULL')} IS NOT NULL")
def secret_scan(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "documents").select("doc_id", T.secret_name(F.col("text")).alias("secret")).where("secret IS NOT NULL")


@query("SELECT page_id, unnest(regexp_extract_all(html, '<a\\s+href=\"([^\"]*)\"', 1)) AS href FROM pages")
def html_links(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit(r'<a\s+href="([^"]*)"'), 1)).alias("href"))


@query("SELECT page_id, 'title: ' || trim(regexp_extract(html, '<title[^>]*>([^<]*)</title>', 1)) AS sig FROM pages WHERE regexp_matches(html, '<title[^>]*>[^<]*[^<\\s][^<]*</title>')")
def html_signatures(spark: SparkSession, d: str) -> DataFrame:
    from ..operators import extract

    s = extract.signatures(read(spark, d, "pages").select(F.col("page_id").cast("string").alias("path"), "html"), "path", "html", "html")
    return s.select(F.col("path").cast("long").alias("page_id"), "sig")


_sample_lines = corpus.values([(p, i, x) for p, (_, want) in samples.SAMPLES.items() for i, x in enumerate(want.split("\n"))])


@query(f"SELECT * FROM {_sample_lines} s(path, pos, sig)")
def language_signatures(spark: SparkSession, d: str) -> DataFrame:
    """The signatures of one file of each language; the SQL has the lines as they must be."""
    from ..operators import extract

    return extract.signatures(spark.createDataFrame([(p, src) for p, (src, _) in samples.SAMPLES.items()], "path string, content string"))


@query(f"SELECT * FROM {corpus.values(samples.EDGES)} e(src, dst)")
def language_imports(spark: SparkSession, d: str) -> DataFrame:
    """Imports in eight languages; the SQL has the edges as they must be."""
    return readers.import_edges(spark.createDataFrame(samples.LINKED, "path string, content string"), "shop")


@query(f"SELECT * FROM {corpus.values(samples.CALLS)} c(caller, callee)")
def package_calls(spark: SparkSession, d: str) -> DataFrame:
    """Calls through imports, and within a package of Go or Java."""
    from ..operators import extract

    f = spark.createDataFrame(samples.LINKED, "path string, content string")
    defs, uses = extract.call_table(f)
    return graph.resolve_calls(uses, defs, readers.import_targets(f), readers.packages(f))


# graphs
TRADE_SQL = "edge AS (SELECT DISTINCT 'c' || o_custkey AS src, 's' || l_suppkey AS dst FROM orders JOIN lineitem ON l_orderkey = o_orderkey)"


def trade(spark: SparkSession, d: str) -> DataFrame:
    o, li = read(spark, d, "orders").select("o_orderkey", "o_custkey"), read(spark, d, "lineitem").select("l_orderkey", "l_suppkey")
    return o.join(li, o.o_orderkey == li.l_orderkey).select(F.concat(F.lit("c"), "o_custkey").alias("src"), F.concat(F.lit("s"), "l_suppkey").alias("dst")).distinct()


def _pagerank_sql() -> str:
    s = f"WITH {TRADE_SQL}, node AS (SELECT src AS n FROM edge UNION SELECT dst FROM edge), cnt AS (SELECT count(*) AS c FROM node), outd AS (SELECT src, count(*) AS d FROM edge GROUP BY src), r0 AS (SELECT n, 1.0 / c AS r FROM node, cnt)"
    for k in range(20):
        s += f", l{k} AS (SELECT coalesce(sum(r), 0) AS l FROM r{k} WHERE n NOT IN (SELECT src FROM outd)), f{k} AS (SELECT dst AS n, sum(r / d) AS f FROM r{k} JOIN edge ON src = n JOIN outd USING (src) GROUP BY dst), r{k + 1} AS MATERIALIZED (SELECT n, 0.15 / c + 0.85 * (coalesce(f, 0) + l / c) AS r FROM r{k} LEFT JOIN f{k} USING (n), cnt, l{k})"
    return s + " SELECT n AS node, round(r / (SELECT max(r) FROM r20), 6) AS rank FROM r20"


@query(_pagerank_sql())
def pagerank_trade(spark: SparkSession, d: str) -> DataFrame:
    return graph.pagerank(trade(spark, d)).select("node", F.round("rank", 6).alias("rank"))


@query(f"WITH {TRADE_SQL}, node AS (SELECT src AS n FROM edge UNION SELECT dst FROM edge) SELECT dst AS node, count(*) AS n_in FROM edge GROUP BY dst HAVING count(*) >= (SELECT ceil(count(*) * 0.2) FROM node)")
def hubs(spark: SparkSession, d: str) -> DataFrame:
    return graph.hubs(trade(spark, d)).select("node", F.col("n_in").cast("long").alias("n_in"))


@query(f"WITH {TRADE_SQL} SELECT DISTINCT src AS node FROM edge WHERE src NOT IN (SELECT dst FROM edge)")
def entry_points(spark: SparkSession, d: str) -> DataFrame:
    return graph.entry_points(trade(spark, d))


@query("WITH RECURSIVE r(node, depth) AS (SELECT p_partkey, 1 FROM part WHERE p_partkey // 4 = 1 AND p_partkey <> 1 UNION ALL SELECT p_partkey, depth + 1 FROM part JOIN r ON p_partkey // 4 = node WHERE p_partkey <> node) SELECT 1::BIGINT AS seed, node, depth::BIGINT AS depth FROM r")
def impact_bfs(spark: SparkSession, d: str) -> DataFrame:
    e = read(spark, d, "part").select(F.col("p_partkey").alias("src"), F.expr("p_partkey div 4").alias("dst")).where("src <> dst AND dst > 0")
    return graph.impact(e, spark.createDataFrame([(1,)], "seed long")).select("seed", "node", F.col("depth").cast("long").alias("depth"))


@query(f"WITH RECURSIVE e AS (SELECT * FROM {corpus.EDGES_SQL}), r(a, b) AS (SELECT src, dst FROM e UNION SELECT a, dst FROM r JOIN e ON src = b) SELECT x.a AS node, min(y.b) AS component FROM r x JOIN r y ON y.a = x.a JOIN r z ON z.a = y.b AND z.b = x.a WHERE x.a = x.b GROUP BY x.a")
def cycle_members(spark: SparkSession, d: str) -> DataFrame:
    return graph.cycles(spark.createDataFrame(corpus.EDGES, "src int, dst int"))


PART_RING = "e AS (SELECT p_partkey AS src, (p_partkey * 7 + 3) % (SELECT count(*) FROM part) AS dst FROM part UNION SELECT p_partkey, p_partkey // 2 FROM part)"


@query(f"WITH RECURSIVE {PART_RING}, up(n, l) AS (SELECT src, src FROM e UNION SELECT dst, dst FROM e UNION SELECT e.dst, up.l FROM up JOIN e ON e.src = up.n) SELECT a.n AS node, min(b.n) AS component FROM up a JOIN up b ON b.n = a.l AND b.l = a.n GROUP BY a.n HAVING count(*) > 1 OR a.n IN (SELECT src FROM e WHERE src = dst)")
def cycle_members_part(spark: SparkSession, d: str) -> DataFrame:
    """Cycles of a graph over all parts."""
    p = read(spark, d, "part").select("p_partkey")
    n = p.agg(F.count(F.lit(1)).alias("n"))
    e = p.join(F.broadcast(n)).select(F.col("p_partkey").alias("src"), ((F.col("p_partkey") * 7 + 3) % F.col("n")).alias("dst")).unionByName(p.select(F.col("p_partkey").alias("src"), F.expr("p_partkey div 2").alias("dst")))
    return graph.cycles(e)


@query(f"WITH RECURSIVE e AS (SELECT * FROM {corpus.EDGES_SQL}), n AS (SELECT src AS seed FROM e UNION SELECT dst FROM e), r(seed, node, depth) AS (SELECT dst, src, 1 FROM e WHERE src <> dst UNION SELECT seed, src, depth + 1 FROM r JOIN e ON dst = node WHERE depth < 12 AND src <> seed), m AS (SELECT seed, node, min(depth) AS depth FROM r GROUP BY ALL), s AS (SELECT seed, count(*) FILTER (depth = 1) AS direct, count(*) FILTER (depth > 1) AS transitive FROM n LEFT JOIN m USING (seed) GROUP BY seed) SELECT seed, direct, transitive, least(100, 4 * direct + transitive) AS score, CASE WHEN least(100, 4 * direct + transitive) >= 60 THEN 'critical' WHEN 4 * direct + transitive >= 30 THEN 'high' WHEN 4 * direct + transitive >= 10 THEN 'medium' WHEN 4 * direct + transitive >= 1 THEN 'low' ELSE 'none' END AS tier FROM s")
def blast_radius(spark: SparkSession, d: str) -> DataFrame:
    e = spark.createDataFrame(corpus.EDGES, "src int, dst int")
    return graph.blast_radius(e, graph.nodes_of(e).withColumnRenamed("node", "seed"))


# usage
USAGE_SQL = "u AS (SELECT ts, event_type AS op, user_id, floor(value)::BIGINT AS baseline, floor(value / 3)::BIGINT AS actual, greatest(0, floor(value)::BIGINT - floor(value / 3)::BIGINT) AS saved FROM events)"
SUMS_SQL = "count(*) AS runs, sum(baseline)::BIGINT AS baseline, sum(actual)::BIGINT AS actual, sum(saved)::BIGINT AS saved"
PCT = "CASE WHEN {1} > 0 THEN least(100.0, greatest(0.0, floor({0} * 100.0 / {1} * 10 + 0.5) / 10)) ELSE 0.0 END"


def log(spark: SparkSession, d: str) -> DataFrame:
    e = read(spark, d, "events").select("ts", F.col("event_type").alias("op"), "user_id", F.floor("value").alias("baseline_tokens"), F.floor(F.col("value") / 3).alias("actual_tokens"))
    return usage.normalized(e)


@query(f"WITH {USAGE_SQL}, s AS (SELECT {SUMS_SQL} FROM u) SELECT *, {PCT.format('saved', 'baseline')} AS saved_pct, floor(saved * 3.0 / 1e6 * 10000 + 0.5) / 10000 AS usd FROM s")
def usage_totals(spark: SparkSession, d: str) -> DataFrame:
    return usage.totals(log(spark, d))


@query(f"WITH {USAGE_SQL}, s AS (SELECT op, {SUMS_SQL} FROM u GROUP BY op) SELECT *, {PCT.format('saved', 'baseline')} AS saved_pct, {PCT.format('saved', '(SELECT sum(saved)::BIGINT FROM s)')} AS share_pct FROM s")
def usage_by_op(spark: SparkSession, d: str) -> DataFrame:
    return usage.by_op(log(spark, d))


def _by_time(unit: str, form: str) -> str:
    return f"WITH {USAGE_SQL}, s AS (SELECT strftime(date_trunc('{unit}', ts), '{form}') AS bucket, {SUMS_SQL} FROM u GROUP BY 1) SELECT *, {PCT.format('saved', 'baseline')} AS saved_pct FROM s"


@query(_by_time("day", "%Y-%m-%d"))
def usage_daily(spark: SparkSession, d: str) -> DataFrame:
    return usage.by_time(log(spark, d), "day")


@query(_by_time("week", "%Y-%m-%d"))
def usage_weekly(spark: SparkSession, d: str) -> DataFrame:
    return usage.by_time(log(spark, d), "week")


@query(_by_time("month", "%Y-%m"))
def usage_monthly(spark: SparkSession, d: str) -> DataFrame:
    return usage.by_time(log(spark, d), "month")


@query(f"WITH {USAGE_SQL} " + " UNION ALL ".join(f"SELECT '{u}' AS unit, strftime(date_trunc('{u}', ts), '{f}') AS bucket, {SUMS_SQL} FROM u GROUP BY 2" for u, f in (("day", "%Y-%m-%d"), ("week", "%Y-%m-%d"), ("month", "%Y-%m"))))
def usage_all_buckets(spark: SparkSession, d: str) -> DataFrame:
    return usage.all_buckets(log(spark, d))


@query(f"WITH {USAGE_SQL} SELECT {SUMS_SQL} FROM u WHERE ts >= TIMESTAMP '2024-01-15'")
def usage_since(spark: SparkSession, d: str) -> DataFrame:
    return usage.after(log(spark, d), "2024-01-15").agg(*usage.sums())


@query("SELECT event_type, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95 FROM events GROUP BY event_type")
def value_percentiles(spark: SparkSession, d: str) -> DataFrame:
    return usage.percentiles(read(spark, d, "events"), "value", "event_type").select("event_type", F.round("p50", 6).alias("p50"), F.round("p95", 6).alias("p95"))


@query("WITH l AS (SELECT user_id, max(event_id) FILTER (NOT value > 40) AS ok FROM events GROUP BY user_id) SELECT user_id, count(*) FILTER (ok IS NULL OR event_id > ok) AS streak FROM events JOIN l USING (user_id) GROUP BY user_id")
def tail_streaks(spark: SparkSession, d: str) -> DataFrame:
    return usage.tail_streak(read(spark, d, "events"), F.col("value") > 40, "user_id", "event_id")


@query("SELECT count(*) AS runs, floor(avg(value) * 10 + 0.5) / 10 AS mean_value, min(value) AS min_value, max(value) AS max_value, arg_min(value, event_id) AS first_value, arg_max(value, event_id) AS last_value, count(*) FILTER (value > 90) AS n_over FROM events")
def log_summary(spark: SparkSession, d: str) -> DataFrame:
    return usage.log_summary(read(spark, d, "events"), "value", F.col("value") > 90, "event_id")


@query("SELECT event_type, count(*) AS n, round(avg(CAST(json_extract(props, '$.k') AS DOUBLE)), 6) AS mean_k FROM events GROUP BY event_type")
def json_props_profile(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(F.get_json_object("props", "$.k").cast("double")), 6).alias("mean_k"))


# quality
@query("""WITH r AS (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS rank FROM documents), e AS (SELECT source, doc_id FROM documents JOIN labels USING (doc_id) WHERE quality = 1),
t AS (SELECT * FROM r WHERE rank <= 5), h AS (SELECT source, min(rank) AS first, count(*) AS found FROM t JOIN e USING (source, doc_id) GROUP BY source), n AS (SELECT source, count(*) AS returned FROM t GROUP BY source),
a AS (SELECT DISTINCT source FROM e), j AS (SELECT a.source, first, coalesce(found, 0) AS found, coalesce(returned, 0) AS returned FROM a LEFT JOIN n USING (source) LEFT JOIN h USING (source))
SELECT count(*) AS tasks, floor(avg(CASE WHEN first IS NOT NULL THEN 1.0 ELSE 0.0 END) * 1000 + 0.5) / 1000 AS hit, floor(avg(coalesce(1.0 / first, 0)) * 1000 + 0.5) / 1000 AS mrr, floor(avg(CASE WHEN returned > 0 THEN found / returned ELSE 0.0 END) * 1000 + 0.5) / 1000 AS precision,
count(*) FILTER (first = 1) AS n_full, count(*) FILTER (first BETWEEN 2 AND 5) AS n_partial, count(*) FILTER (coalesce(first, 99) > 5) AS n_miss FROM j""")
def retrieval_quality(spark: SparkSession, d: str) -> DataFrame:
    docs = read(spark, d, "documents").select("source", "doc_id", "n_chars")
    ranked = docs.withColumn("rank", F.row_number().over(Window.partitionBy("source").orderBy(F.col("n_chars").desc(), "doc_id")))
    good = docs.join(read(spark, d, "labels").where("quality = 1"), "doc_id").select("source", "doc_id")
    return evaluate.quality(evaluate.hits(ranked, good, "source", "doc_id", 5))


@query("WITH s AS (SELECT doc_id, source, n_chars * 1.0 AS score FROM documents), m AS (SELECT *, min(score) OVER (PARTITION BY source) AS lo, max(score) OVER (PARTITION BY source) AS hi FROM s) SELECT doc_id, CASE WHEN score <= 0 THEN 'low' WHEN (CASE WHEN hi > lo THEN (score - lo) / (hi - lo) ELSE 1.0 END) > 0.66 THEN 'high' WHEN (CASE WHEN hi > lo THEN (score - lo) / (hi - lo) ELSE 1.0 END) > 0.33 THEN 'medium' ELSE 'low' END AS confidence FROM m")
def rank_confidence(spark: SparkSession, d: str) -> DataFrame:
    s = read(spark, d, "documents").select("doc_id", "source", F.col("n_chars").cast("double").alias("score"))
    return retrieval.confident(s, "source").select("doc_id", "confidence")


# verification
_names = f"names AS (SELECT DISTINCT unnest(regexp_extract_all(sig, '[A-Za-z_$][A-Za-z0-9_$]*')) AS name FROM {corpus.LINES_SQL})"


@query(f"WITH {_names}, p AS (SELECT value, name, levenshtein(lower(value), lower(name)) AS distance FROM {corpus.WANTED_SQL} JOIN names ON length(value) >= 3 AND length(name) >= 3 AND lower(value) <> lower(name)), q AS (SELECT *, row_number() OVER (PARTITION BY value ORDER BY distance, length(name), name) AS r FROM p WHERE distance <= greatest(1, ceil(length(value) * 0.5))) SELECT value, name AS suggestion, distance, CASE WHEN distance / length(value) <= 0.2 THEN 'high' WHEN distance / length(value) <= 0.4 THEN 'medium' ELSE 'low' END AS confidence FROM q WHERE r = 1")
def closest_names(spark: SparkSession, d: str) -> DataFrame:
    wanted = spark.createDataFrame([(w,) for w in corpus.WANTED], "value string")
    return verify.closest(wanted, verify.symbols_of(corpus.lines(spark)))


@query("WITH n AS (SELECT DISTINCT p_name AS name FROM part), w AS (SELECT DISTINCT replace(replace(p_name, 'i', 'y'), 'l', '') AS value FROM part), p AS (SELECT value, name, levenshtein(lower(value), lower(name)) AS distance FROM w JOIN n ON lower(value) <> lower(name) AND abs(length(value) - length(name)) <= greatest(1, ceil(length(value) * 0.5)) WHERE length(value) >= 3 AND length(name) >= 3), q AS (SELECT *, row_number() OVER (PARTITION BY value ORDER BY distance, length(name), name) AS r FROM p WHERE distance <= greatest(1, ceil(length(value) * 0.5))) SELECT value, name AS suggestion, distance FROM q WHERE r = 1")
def closest_part_name(spark: SparkSession, d: str) -> DataFrame:
    wanted = read(spark, d, "part").select(F.translate("p_name", "il", "y").alias("value"))
    return verify.closest(wanted, read(spark, d, "part").select(F.col("p_name").alias("name"))).select("value", "suggestion", "distance")


@query(f"WITH o AS (SELECT path, sig FROM {corpus.LINES_SQL}), n AS (SELECT path, sig FROM {corpus.NEW_SQL}), x AS (SELECT path, sig, 'added' AS change FROM (SELECT * FROM n EXCEPT SELECT * FROM o) UNION ALL SELECT path, sig, 'removed' FROM (SELECT * FROM o EXCEPT SELECT * FROM n)) SELECT change, count(*) AS n FROM x GROUP BY change")
def signature_sets(spark: SparkSession, d: str) -> DataFrame:
    old, new = corpus.lines(spark), corpus.lines(spark, corpus.NEW)
    x = new.subtract(old).withColumn("change", F.lit("added")).unionByName(old.subtract(new).withColumn("change", F.lit("removed")))
    return x.groupBy("change").agg(F.count(F.lit(1)).alias("n"))


STYLE = "CASE WHEN regexp_matches(s, '^[a-z0-9]+(-[a-z0-9]+)+$') THEN 'kebab-case' WHEN regexp_matches(s, '^[a-z0-9]+(_[a-z0-9]+)+$') THEN 'snake_case' WHEN regexp_matches(s, '^[A-Z][A-Za-z0-9]*$') AND regexp_matches(s, '[a-z]') THEN 'PascalCase' WHEN regexp_matches(s, '^[a-z][A-Za-z0-9]*$') AND regexp_matches(s, '[A-Z]') THEN 'camelCase' WHEN regexp_matches(s, '^[a-z][a-z0-9]*$') THEN 'single-word' ELSE 'other' END"
NAMES_SQL = f"nm AS (SELECT path, split_part(regexp_extract(path, '[^/]*$'), '.', 1) AS s, CASE WHEN strpos(path, '/') > 0 THEN split_part(path, '/', 1) ELSE '.' END AS module FROM {corpus.FILES_SQL}), st AS (SELECT path, module, {STYLE} AS style FROM nm)"


@query(f"WITH {NAMES_SQL} SELECT path, style FROM st")
def naming_styles(spark: SparkSession, d: str) -> DataFrame:
    return corpus.files(spark).select("path", T.naming_style(T.base_name(F.col("path"))).alias("style"))


@query(f"WITH {NAMES_SQL}, n AS (SELECT module, style, count(*) AS n FROM st WHERE style NOT IN ('other', 'single-word') GROUP BY ALL), w AS (SELECT *, sum(n) OVER (PARTITION BY module) AS total, row_number() OVER (PARTITION BY module ORDER BY n DESC, style) AS r FROM n) SELECT module, style AS dominant, round(n / total, 6) AS pct, total::BIGINT AS total, CASE WHEN n / total >= 0.9 THEN 'consistent' WHEN n / total >= 0.7 THEN 'mostly' ELSE 'mixed' END AS tier FROM w WHERE r = 1")
def naming_conventions(spark: SparkSession, d: str) -> DataFrame:
    m = F.when(F.instr("path", "/") > 0, F.substring_index("path", "/", 1)).otherwise(".")
    rows = corpus.files(spark).select(m.alias("module"), T.naming_style(T.base_name(F.col("path"))).alias("style"), "path")
    return conventions.scored(rows, "module", "style", "path").select("module", "dominant", F.round("pct", 6).alias("pct"), "total", "tier")


_risk = case_sql(T.RISKS, "path", "'source'")
_stem = "regexp_replace(regexp_replace(regexp_extract({0}, '[^/]*$'), '\\.[^.]+$', ''), '(?i)\\.(spec|test)$', '')"


@query(f"WITH k AS (SELECT path, {_risk} AS risk, {_stem.format('path')} AS stem FROM {corpus.FILES_SQL}) SELECT a.path AS path, b.path AS test FROM k a JOIN k b ON a.risk <> 'test' AND b.risk = 'test' AND lower(a.stem) = lower(regexp_replace(regexp_replace(regexp_replace(b.stem, '(?i)^test[_-]', ''), '(?i)[_-]test$', ''), '(Specs?|Tests?)$', ''))")
def related_tests(spark: SparkSession, d: str) -> DataFrame:
    return evidence.related_tests(corpus.files(spark))


@query(f"WITH k AS (SELECT path, {_risk} AS risk, {_stem.format('path')} AS stem FROM {corpus.FILES_SQL}) SELECT path FROM k a WHERE risk = 'source' AND NOT EXISTS (SELECT 1 FROM k b WHERE b.risk = 'test' AND contains(lower(regexp_extract(b.path, '[^/]*$')), lower(a.stem)))")
def missing_tests(spark: SparkSession, d: str) -> DataFrame:
    return evidence.missing_tests(corpus.files(spark).select("path"))


@query("""WITH RECURSIVE c AS (SELECT source, doc_id, ceil(n_chars / 4)::BIGINT AS tokens, row_number() OVER (PARTITION BY source ORDER BY -n_chars, doc_id) AS r FROM documents), k AS MATERIALIZED (SELECT * FROM c),
f(source, r, used, kept) AS (SELECT source, 1::BIGINT, tokens, true FROM k WHERE r = 1 UNION ALL SELECT k.source, k.r, used + CASE WHEN used + tokens <= 9000 THEN tokens ELSE 0 END, used + tokens <= 9000 FROM f JOIN k ON k.source = f.source AND k.r = f.r + 1)
SELECT k.source, k.doc_id, k.tokens FROM f JOIN k USING (source, r) WHERE kept""")
def budget_pack(spark: SparkSession, d: str) -> DataFrame:
    """All documents of each source, the longest first, packed into a budget."""
    docs = read(spark, d, "documents").select("source", "doc_id", "n_chars", F.ceil(F.col("n_chars") / 4).alias("tokens"))
    return evidence.greedy(docs, "source", -F.col("n_chars"), "tokens", "doc_id", 9000)


# texts
MARK = "(Apache|GNU|MIT) "


@query(f"WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos FROM documents), e AS (SELECT doc_id, pos FROM l WHERE regexp_matches(line, '{MARK}')) SELECT DISTINCT l.doc_id, l.pos, l.line FROM l JOIN e ON l.doc_id = e.doc_id AND abs(l.pos - e.pos) <= 2")
def line_context(spark: SparkSession, d: str) -> DataFrame:
    x = squeeze.error_context(read(spark, d, "documents"), "doc_id", F.col("text"), 2, MARK)
    return x.select("doc_id", F.col("pos").cast("long").alias("pos"), "line")


@query("WITH l AS (SELECT doc_id, trim(regexp_replace(unnest(string_split(text, chr(10))), '[0-9]+', '#', 'g')) AS line FROM documents) SELECT line, count(*) AS n, count(DISTINCT doc_id) AS n_docs FROM l WHERE line <> '' GROUP BY line HAVING count(*) > 1")
def repeated_lines(spark: SparkSession, d: str) -> DataFrame:
    ls = read(spark, d, "documents").select("doc_id", F.explode(F.split("text", "\n")).alias("l")).select("doc_id", F.trim(F.regexp_replace("l", "[0-9]+", "#")).alias("line")).where("line <> ''")
    return ls.groupBy("line", "doc_id").agg(F.count(F.lit(1)).alias("c")).groupBy("line").agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("n_docs")).where("n > 1")


def _re(p: str) -> str:
    return p.replace("\\z", "$").replace("'", "''")


_KV = r'^\s*"[^"]+"\s*:.*\S|^\s*[\]}],?\s*$'
_SAMPLES = [
    (-1, "Traceback (most recent call last):\n  File \"a.py\", line 3\nValueError: x"), (-2, "x\n  at f (a.js:1:2)\n  at g (b.js:3:4)\n  at h (c.js:5:6)"), (-3, "\n".join(f"12:00:0{i} step {i}" for i in range(9))),
    (-4, "\n".join(["same line 1"] * 5 + [f"other {c}" for c in "abcde"])), (-5, '{"a": [1, 2], "b": {"c": null}}'), (-6, '{\n"a": 1,\n"b": 2,\n"c": 3,\n'), (-7, "   "), (-8, "plain words\nof prose"), (-9, "[1, 2"), (-10, "goroutine 7 [running]:\nmain.f(0x1)\n  main.go(a.go:12)"),
]


@query(f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents UNION ALL SELECT * FROM (VALUES {', '.join(f"({i}, {corpus.text(t)})" for i, t in _SAMPLES)}) v(doc_id, t)), l AS (SELECT doc_id, t, string_split(t, chr(10)) AS ls, string_split(trim(t), chr(10)) AS tl FROM d),
n AS (SELECT *, list_filter(list_transform(ls, lambda x: trim(regexp_replace(x, '[0-9]+', '#', 'g'))), lambda x: x <> '') AS norm FROM l),
f AS (SELECT doc_id, trim(t) = '' AS blank, len(list_filter(ls, lambda x: regexp_matches(x, '{_re("|".join(f"(?:{p})" for p in squeeze.FRAMES))}'))) AS fr, regexp_matches(t, '{_re(squeeze.HEADERS)}') AS hd, len(ls) AS n,
greatest(len(list_filter(ls, lambda x: regexp_matches(x, '{_re(squeeze.CLOCK + "|" + squeeze.PROGRESS)}'))) / len(ls), (len(norm) - len(list_distinct(norm))) / len(ls)) AS ci, regexp_matches(trim(t), '^[\\[{{]') AND json_valid(trim(t)) AS js, len(tl) AS tn, len(list_filter(tl, lambda x: regexp_matches(x, '{_re(_KV)}'))) / len(tl) AS kv FROM n),
c AS (SELECT CASE WHEN blank THEN NULL WHEN hd OR fr >= 2 THEN 'stacktrace' WHEN n >= 8 AND ci >= 0.4 THEN 'cilog' WHEN js OR (tn >= 4 AND kv >= 0.6) THEN 'json' END AS category, round(CASE WHEN blank THEN 0 WHEN hd THEN greatest(least(0.97, 0.15 * fr), 0.6 + least(0.3, 0.05 * fr)) WHEN fr >= 2 THEN least(0.97, 0.15 * fr) WHEN n >= 8 AND ci >= 0.4 THEN least(0.95, ci + 0.15) WHEN js THEN 0.95 WHEN tn >= 4 AND kv >= 0.6 THEN least(0.9, kv) ELSE 0 END, 2) AS confidence FROM f)
SELECT category, count(*) AS n, round(avg(confidence), 4) AS confidence FROM c GROUP BY category""")
def text_classes(spark: SparkSession, d: str) -> DataFrame:
    """All documents, and a sample of each class."""
    x = read(spark, d, "documents").select("doc_id", "text").unionByName(spark.createDataFrame(_SAMPLES, "doc_id long, text string"))
    c = squeeze.classified(x, "doc_id", F.col("text"))
    return c.groupBy("category").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("confidence"), 4).alias("confidence"))


_terse = sub("head", ("\\bfunction\\b", "fn"), ("\\s+→\\s+", "→"), (",\\s+", ","), ("\\s+=\\s+", "="), ("\\{\\s+", "{"), ("\\s+\\}", "}"))
_LINES = f"x AS (SELECT text FROM documents UNION ALL SELECT sig FROM {corpus.LINES_SQL} UNION ALL SELECT sig FROM {corpus.NEW_SQL})"


@query(f"""WITH {_LINES}, a AS (SELECT text, regexp_extract(text, '(\\s+:[0-9]+-[0-9]+(\\s+#.*)?\\s*)$', 1) AS tail FROM x), h AS (SELECT text, tail, left(text, length(text) - length(tail)) AS head FROM a),
s AS (SELECT text, tail, {_terse} AS s FROM h), t AS (SELECT text, tail, s, regexp_extract(s, '^\\s*') AS lead, CASE WHEN trim(s, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) = '' THEN '' ELSE regexp_extract(s, '\\s*$') END AS trail FROM s),
m AS (SELECT text, tail, lead, trail, regexp_replace(substr(s, length(lead) + 1, length(s) - length(lead) - length(trail)), '\\s{{2,}}', ' ', 'g') AS mid FROM t)
SELECT sum(ceil(length(text) / 4))::BIGINT AS before_tokens, sum(ceil(length(regexp_replace(lead || mid || trail, '^module\\.exports=', 'exports=') || tail) / 4))::BIGINT AS after_tokens FROM m""")
def terse_reduction(spark: SparkSession, d: str) -> DataFrame:
    """All documents, and the signatures of the small code base."""
    lines = corpus.lines(spark).unionByName(corpus.lines(spark, corpus.NEW)).select(F.col("sig").alias("text"))
    x = read(spark, d, "documents").select("text").unionByName(lines)
    return x.agg(F.sum(F.ceil(F.length("text") / 4)).alias("before_tokens"), F.sum(F.ceil(F.length(T.terse(F.col("text"))) / 4)).alias("after_tokens"))


@query("SELECT source, count(*) AS files, sum(ceil(length(coalesce(text, '')) / 4))::BIGINT AS tokens FROM documents GROUP BY source")
def token_estimate(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "documents").groupBy("source").agg(F.count(F.lit(1)).alias("files"), F.sum(T.token_estimate(F.array(F.coalesce("text", F.lit(""))))).alias("tokens"))


@query("""WITH RECURSIVE u AS (SELECT user_id, row_number() OVER (ORDER BY event_id, user_id) AS pos, CASE event_type WHEN 'purchase' THEN 0.15::DOUBLE ELSE -0.10::DOUBLE END AS d FROM events WHERE event_type IN ('purchase', 'error')),
o AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY pos) AS k, coalesce(pos - lag(pos) OVER (PARTITION BY user_id ORDER BY pos), 0) AS gap FROM u),
f(user_id, k, pos, w) AS (SELECT user_id, 0::BIGINT, 0::BIGINT, 1.0::DOUBLE FROM (SELECT DISTINCT user_id FROM o) UNION ALL
SELECT o.user_id, o.k, o.pos, CASE WHEN x > 3 THEN 3.0::DOUBLE WHEN x < 0.3 THEN 0.3::DOUBLE ELSE floor(x * 1000000.0::DOUBLE + 0.5::DOUBLE) / 1000000.0::DOUBLE END FROM (SELECT o.*, o.d + list_reduce(list_prepend(f.w, [0.95::DOUBLE for i in range(least(o.gap, 64))]), lambda s, x: CASE WHEN s = 1 THEN s WHEN s * x < 0.3 THEN 0.3::DOUBLE ELSE floor(s * x * 1000000.0::DOUBLE + 0.5::DOUBLE) / 1000000.0::DOUBLE END) AS x FROM f JOIN o ON o.user_id = f.user_id AND o.k = f.k + 1) o),
l AS (SELECT user_id, arg_max(pos, k) AS pos, arg_max(w, k) AS w FROM f GROUP BY user_id),
e AS (SELECT user_id, list_reduce(list_prepend(w, [0.95::DOUBLE for i in range(least((SELECT count(*) FROM u) - pos, 64))]), lambda s, x: CASE WHEN s = 1 THEN s WHEN s * x < 0.3 THEN 0.3::DOUBLE ELSE floor(s * x * 1000000.0::DOUBLE + 0.5::DOUBLE) / 1000000.0::DOUBLE END) AS w FROM l)
SELECT user_id, round(w, 5) AS weight FROM e WHERE w <> 1""")
def weights_fold(spark: SparkSession, d: str) -> DataFrame:
    e = read(spark, d, "events").where("event_type IN ('purchase', 'error')").select("user_id", "event_id", F.when(F.col("event_type") == "purchase", 0.15).otherwise(-0.10).alias("delta"))
    return stateful.folded_weights(e, "user_id", "event_id", "delta").select("user_id", F.round("weight", 5).alias("weight"))
