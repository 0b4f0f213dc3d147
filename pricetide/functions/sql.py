"""The Column functions under SQL names.

Each is registered as a temporary SQL function whose body is the Column's own
expression, so a query that calls it is inlined by the optimizer and runs in the
JVM like the DataFrame form.  Functions over arrays with lambdas have no SQL text
that Spark reads back and exist as Column functions only.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from pricetide.functions import catalog, kinds, price, text

#: SQL name: (parameters with types, function of the parameter columns).
FUNCTIONS: dict[str, tuple[dict[str, str], Callable[..., Column]]] = {
    "pt_normalize": ({"x": "string"}, text.normalize), "pt_phonetic": ({"x": "string"}, text.phonetic_key), "pt_slug": ({"x": "string"}, text.slug), "pt_slug_ascii": ({"x": "string"}, text.slug_ascii),
    "pt_similarity": ({"a": "string", "b": "string"}, text.similarity), "pt_clean_price": ({"x": "string"}, price.clean_price), "pt_scraped_price": ({"x": "string"}, price.scraped_price), "pt_engine_price": ({"x": "string"}, price.engine_price),
    "pt_savings": ({"c": "bigint", "o": "bigint"}, price.savings), "pt_savings_percent": ({"c": "bigint", "o": "bigint"}, price.savings_percent), "pt_half_up": ({"x": "double"}, price.half_up), "pt_format_price": ({"x": "bigint"}, price.format_price),
    "pt_condition": ({"x": "string"}, catalog.condition), "pt_host": ({"u": "string"}, catalog.host),
    "pt_in_stock": ({"x": "string"}, catalog.in_stock), "pt_is_portable": ({"x": "string"}, kinds.is_portable), "pt_slug_of": ({"x": "string"}, kinds.slug_of),
}


def register(spark: SparkSession) -> list[str]:
    """Register every function for the session; the names that are now known."""
    for name, (parameters, function) in FUNCTIONS.items():
        empty = spark.createDataFrame([], ", ".join(f"{k} {t}" for k, t in parameters.items()))
        one = empty.select(function(*map(F.col, parameters)).alias("y"))
        body = one._jdf.queryExecution().analyzed().expressions().apply(0).child().sql()
        kind = one.schema["y"].dataType.simpleString()
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({', '.join(f'{k} {t}' for k, t in parameters.items())}) RETURNS {kind} RETURN {body}")
    return list(FUNCTIONS)
