"""The library from SQL: register(spark) adds temporary functions, which stay expressions of the plan, and a table function over source files.

    SELECT path_penalty('src/tests/a.py'), risk_label('db/migrate/1.sql'), query_intent('fix the crash'), token_estimate('some text')
    SELECT path, pos, sig FROM files, LATERAL extract_signatures(path, content)
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from ..functions import text as T


def quoted(s: str) -> str:
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


def cases(value: str, rules: list[tuple], default: str) -> str:
    """The first rule (label, pattern) that matches."""
    label = lambda k: quoted(k) if isinstance(k, str) else f"{k}D"
    return "CASE " + " ".join(f"WHEN {value} RLIKE {quoted(T.java(p))} THEN {label(k)}" for k, p in rules) + f" ELSE {default} END"


FUNCTIONS = {
    "path_penalty": ("path STRING", "DOUBLE", cases("lower(coalesce(path, ''))", T.PENALTIES, "1.0D")),
    "risk_label": ("path STRING", "STRING", cases("coalesce(path, '')", T.RISKS, "'source'")),
    "query_intent": ("query STRING", "STRING", cases("lower(translate(coalesce(query, ''), '\u0130', 'i'))", T.INTENTS, "'search'")),
    "secret_name": ("sig STRING", "STRING", cases("sig", T.SECRETS, "NULL")),
    "token_estimate": ("words STRING", "BIGINT", "CAST(ceil(length(coalesce(words, '')) / 4) AS BIGINT)"),
}


@udtf(returnType="pos int, sig string")
class ExtractSignatures:
    def eval(self, path: str, content: str) -> Iterator[tuple[int, str]]:
        from sparrowgram.operators import extract

        yield from enumerate(extract.extract(content, extract.language_of(path or "")))


def register(spark: SparkSession) -> list[str]:
    """The names that are now there."""
    for name, (args, kind, body) in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({args}) RETURNS {kind} RETURN {body}")
    spark.udtf.register("extract_signatures", ExtractSignatures)
    return [*FUNCTIONS, "extract_signatures"]
