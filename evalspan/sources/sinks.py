"""Exports: nested rows as flat columns, files, and one nested document per run."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evalspan.session import cut_lineage


def flatten_struct(df: DataFrame, separator: str = ".") -> DataFrame:
    """Structs at any depth as columns with joined names; arrays and maps stay as they are."""

    def fields(schema: T.StructType, at: Column | None, prefix: str) -> list[Column]:
        out: list[Column] = []
        for f in schema.fields:
            c = F.col(f"`{f.name}`") if at is None else at[f.name]
            name = f"{prefix}{f.name}"
            out += fields(f.dataType, c, name + separator) if isinstance(f.dataType, T.StructType) else [c.alias(name)]
        return out

    return df.select(*fields(df.schema, None, ""))


def export_columns(df: DataFrame, plain: dict[str, str], sizes: dict[str, str], joined: dict[str, tuple[str, str | None]], separator: str = "|") -> DataFrame:
    """Columns of a file without nesting: values, array lengths (0 for null), and arrays joined to a text ('' for null)."""
    at = lambda c: F.col(f"`{c}`")

    def text(c: str, field: str | None) -> Column:
        items = F.transform(at(c), lambda x: F.coalesce((x if field is None else x[field]).cast("string"), F.lit("")))
        return F.coalesce(F.array_join(items, separator), F.lit(""))

    return df.select(*(at(c).alias(n) for n, c in plain.items()), *(F.coalesce(F.when(at(c).isNotNull(), F.size(at(c))), F.lit(0)).alias(n) for n, c in sizes.items()), *(text(c, f).alias(n) for n, (c, f) in joined.items()))


def write_csv(df: DataFrame, path: str) -> None:
    """CSV with a header; the commit protocol of the writer makes the output atomic."""
    df.write.mode("overwrite").option("header", True).csv(path)


def append_jsonl(df: DataFrame, path: str) -> None:
    """Adds rows as JSON lines, as a checkpoint of finished work."""
    df.write.mode("append").json(path)


def write_experiments(df: DataFrame, path: str, key: str = "experiment_id") -> None:
    """One folder of parquet per experiment."""
    df.write.mode("overwrite").partitionBy(key).parquet(path)


def keyed_overwrite(old: DataFrame, new: DataFrame, keys: Sequence[str], path: str, order: Sequence[str] = ()) -> None:
    """Writes old rows without the keys of the new ones, and the new ones; of equal keys the last by ``order`` wins.

    The rows are written to the shared checkpoint folder first, so ``path`` may be what ``old`` was read from. Keys are
    compared null-safe; without an order, the greatest row wins.
    """
    rank = F.struct(*order) if order else F.struct(*new.columns)
    last = new.groupBy(*keys).agg(F.max(F.struct(rank.alias("rank"), F.struct(*new.columns).alias("row"))).alias("r")).select("r.row.*")
    taken = last.select(*(F.col(k).alias(f"__{k}") for k in keys))
    on = [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys]
    kept = old.join(taken, on, "left_anti")
    cut_lineage(kept.unionByName(last.select(*old.columns))).write.mode("overwrite").parquet(path)


def run_documents(runs: DataFrame, predictions: DataFrame, run_id: str = "run_id") -> DataFrame:
    """One JSON document per run with its predictions nested (for runs of a size that a document may have)."""
    nested = predictions.groupBy(F.col(run_id).alias("r")).agg(F.sort_array(F.collect_list(F.struct(*[c for c in predictions.columns if c != run_id]))).alias("predictions"))
    j = runs.join(nested, F.col(run_id) == F.col("r"), "left").drop("r")
    return j.select(run_id, F.to_json(F.struct(*j.columns)).alias("document"))
