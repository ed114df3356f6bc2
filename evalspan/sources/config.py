"""Small things that live on the driver: configuration files, response keys, reports."""

from __future__ import annotations

import os
import re
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_ENV = re.compile(r"\$\{(\w+)(?::([^}]*))?\}")


def merged(base: dict, over: dict) -> dict:
    """Deep merge; values of ``over`` win."""
    return base | {k: merged(base[k], v) if isinstance(v, dict) and isinstance(base.get(k), dict) else v for k, v in over.items()}


def load_config(path: str, overrides: dict | None = None) -> dict:
    """YAML with ``extends`` (a parent file, merged below) and ${NAME:default} from the environment."""
    import yaml

    text = _ENV.sub(lambda m: os.environ.get(m[1], m[2] or ""), Path(path).read_text())
    own = yaml.safe_load(text) or {}
    parent = own.pop("extends", None)
    base = load_config(str(Path(path).parent / parent)) if parent else {}
    return merged(merged(base, own), overrides or {})


def equivalence_classes(spark: SparkSession, path: str) -> DataFrame:
    """(variant, canonical), lower case, of a YAML file canonical -> variants."""
    rows = [(str(v).strip().lower(), str(c).strip().lower()) for c, vs in load_config(path).items() for v in (c, *(vs or []))]
    return spark.createDataFrame(rows, "variant string, canonical string").distinct()


def query(spark: SparkSession, sql: str, *args: object) -> DataFrame:
    """SQL over registered views with positional parameters."""
    return spark.sql(sql, args=list(args))


def response_key(*parts: Column) -> Column:
    """Content address of a request."""
    return F.sha2(F.to_json(F.struct(*(p.alias(f"p{i}") for i, p in enumerate(parts)))), 256)


def cached_responses(requests: DataFrame, key: Column, cache: DataFrame, temperature: str) -> DataFrame:
    """Requests with their cached response (cache: key, response); requests with a positive temperature bypass the cache."""
    c = cache.select(F.col("key").alias("__k"), "response")
    return requests.withColumn("key", key).join(c, (F.col("key") == F.col("__k")) & (F.coalesce(F.col(temperature), F.lit(0)) <= 0), "left").drop("__k")


def markdown(df: DataFrame, limit: int = 50) -> str:
    """First rows of a small result as a table; a last line says so if there are more."""
    rows = df.limit(limit + 1).collect()
    line = lambda cells: "| " + " | ".join("" if c is None else str(c) for c in cells) + " |"
    more = [f"\n(first {limit} rows)"] if len(rows) > limit else []
    return "\n".join([line(df.columns), line(["---"] * len(df.columns)), *map(line, rows[:limit]), *more])
