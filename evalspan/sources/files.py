"""File sources: wrapped and line-delimited JSON, delimited and piped tables, XML articles and workspaces."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def wrapped_json(spark: SparkSession, path: str, schema: T.StructType | str, keys: Sequence[str] = ("results", "predictions")) -> DataFrame:
    """Rows of JSON files that hold a list, or an object with the list under one of ``keys``; other files give none."""
    row = schema if isinstance(schema, str) else schema.simpleString()
    text = spark.read.text(path, wholetext=True).select(F.try_parse_json("value").alias("v"))
    listed = F.coalesce(*(F.try_variant_get("v", p, f"array<{row}>") for p in ("$", *(f"$.{k}" for k in keys))))
    return text.select(F.inline(listed))


def json_documents(spark: SparkSession, path: str, schema: T.StructType | str, id_column: str, pattern: str = "*.json") -> DataFrame:
    """One document per file, by normalised id (upper case, '-' for '_'); files that are not JSON are skipped."""
    row = schema if isinstance(schema, str) else schema.simpleString()
    text = spark.read.option("pathGlobFilter", pattern).text(path, wholetext=True)
    parsed = text.select(F.try_variant_get(F.try_parse_json("value"), "$", row).alias("d")).filter("d is not null").select("d.*")
    return parsed.withColumn("id", F.upper(F.replace(F.col(id_column), F.lit("_"), F.lit("-"))))


def json_lines(spark: SparkSession, paths: str | Sequence[str], schema: T.StructType | str, key: str | None = None) -> DataFrame:
    """Rows of JSON lines; blank and malformed lines, and rows without the key, are skipped."""
    df = spark.read.schema(schema).option("mode", "DROPMALFORMED").json(paths if isinstance(paths, str) else list(paths))
    return df.filter(F.col(key).isNotNull()) if key else df


def succeeded(df: DataFrame, error: str = "error") -> DataFrame:
    return df.filter(F.col(error).isNull() | (F.col(error) == ""))


def merged_lines(spark: SparkSession, paths: Sequence[str], schema: T.StructType | str, keys: Sequence[str]) -> DataFrame:
    """Union of files in the order given; the first row of a key wins (order of files, then of lines)."""
    parts = [json_lines(spark, p, schema).withColumn("__file", F.lit(i)).withColumn("__line", F.monotonically_increasing_id()) for i, p in enumerate(paths)]
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    columns = [c for c in every.columns if not c.startswith("__")]
    return every.groupBy(*keys).agg(F.min_by(F.struct(*columns), F.struct("__file", "__line")).alias("r")).select("r.*")


def marker_table(spark: SparkSession, path: str) -> DataFrame:
    """CSV with a header: population and parent (recognised by name), all other columns as a map marker -> state."""
    df = spark.read.option("header", True).csv(path)
    find = lambda names: next((c for c in df.columns if c.strip().lower() in names), None)
    population, parent = find(("population", "cell type", "subset", "name")), find(("parent",))
    rest = [c for c in df.columns if c not in (population, parent)]
    col = lambda c: F.col(f"`{c}`") if c else F.lit(None).cast("string")
    states = F.map_filter(F.map_from_arrays(F.array(*map(F.lit, rest)), F.array(*map(col, rest))), lambda _, v: v.isNotNull() & (F.trim(v) != "")) if rest else F.create_map().cast("map<string,string>")
    return df.select(F.trim(col(population)).alias("population"), F.trim(col(parent)).alias("parent"), states.alias("markers"))


def piped_table(text: Column) -> Column:
    """Markdown table as array<map<header, cell>>: separator line dropped, short rows padded with '', empty cells kept."""
    lines = F.filter(F.split(text, "\n"), lambda x: x.contains("|"))
    cells = lambda x: F.transform(F.split(F.regexp_replace(F.trim(x), r"^\||\|$", ""), r"\|"), lambda s: F.trim(s))
    header = cells(F.get(lines, F.lit(0)))
    body = F.filter(F.slice(lines, 2, F.greatest(F.size(lines) - 1, F.lit(0))), lambda x: ~x.rlike(r"^[\s|:-]+$"))
    return F.transform(body, lambda x: F.map_from_arrays(header, F.transform(header, lambda _, i: F.coalesce(F.get(cells(x), i), F.lit("")))))


def articles(spark: SparkSession, path: str) -> DataFrame:
    """Title, abstract, DOI, section titles and figure captions of XML articles, one per file."""
    x = spark.read.text(path, wholetext=True).select(F.regexp_replace("value", r"<!DOCTYPE[^>]*>", "").alias("x"))
    one = lambda p: F.nullif(F.trim(F.regexp_replace(F.xpath_string("x", F.lit(p)), r"\s+", " ")), F.lit(""))
    return x.select(one("//article-title").alias("title"), one("//abstract").alias("abstract"), one("//article-id[@pub-id-type='doi']").alias("doi"), F.xpath("x", F.lit("//body/sec/title/text()")).alias("sections"), F.xpath("x", F.lit("//fig/caption//p/text()")).alias("captions"))


def workspace_gates(spark: SparkSession, path: str) -> DataFrame:
    """Gates of the first sample of XML workspaces: file, path, parent_path, name, depth; other files give none.

    A workspace is one record; its tree of nested populations is walked where the file is read.
    """

    def walk(parts):
        import xml.etree.ElementTree as ET

        import pandas as pd

        for part in parts:
            rows = []
            for name, text in zip(part["file"], part["value"]):
                try:
                    root = ET.fromstring(text)
                except ET.ParseError:
                    continue
                sample = next((e for e in root.iter() if e.tag.rsplit("}", 1)[-1] == "SampleNode"), None)
                todo = [(sample, "", 0)] if sample is not None else []
                while todo:
                    node, above, depth = todo.pop()
                    for holder in node:
                        if holder.tag.rsplit("}", 1)[-1] != "Subpopulations":
                            continue
                        for gate in holder:
                            if "name" in gate.attrib:
                                rows.append((name, f"{above}/{gate.attrib['name']}", above, gate.attrib["name"], depth))
                                todo.append((gate, f"{above}/{gate.attrib['name']}", depth + 1))
            yield pd.DataFrame(rows, columns=["file", "path", "parent_path", "name", "depth"])

    text = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), "value")
    return text.mapInPandas(walk, "file string, path string, parent_path string, name string, depth int")
