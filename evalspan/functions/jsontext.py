"""JSON and trees inside free text, by Arrow-batched functions: braces can't be balanced by a regex."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_FENCE = re.compile(r"```(?:json)?\s*(.*?)```", re.S)
_BULLET = re.compile(r"^(\s*)(?:[-*+•]|\d+[.)])?\s*(.+?)\s*$")


def balanced_object(text: str) -> str | None:
    """First balanced {...} of a text; braces within JSON strings don't count; None if it never closes."""
    start = text.find("{")
    if start < 0:
        return None
    depth, quoted, i = 0, False, start
    while i < len(text):
        c = text[i]
        if quoted:
            if c == "\\":
                i += 1
            quoted = c != '"'
        elif c == '"':
            quoted = True
        elif c in "{}":
            depth += 1 if c == "{" else -1
            if not depth:
                return text[start : i + 1]
        i += 1
    return None


def indented_nodes(text: str) -> list[tuple[int, int | None, str]]:
    """(node, parent, name) of an indented or bulleted list: the parent is the last line with a smaller indent, else the first node."""
    nodes: list[tuple[int, int | None, str]] = []
    stack: list[tuple[int, int]] = []
    for line in text.splitlines():
        m = _BULLET.match(line)
        if not line.strip() or not m:
            continue
        indent = len(m[1].expandtabs(4))
        while stack and stack[-1][0] >= indent:
            stack.pop()
        parent = stack[-1][1] if stack else (0 if nodes else None)
        nodes.append((len(nodes), parent, m[2].strip("*_` ")))
        stack.append((indent, len(nodes) - 1))
    return nodes


def _json_nodes(x: object) -> list[tuple[int, int | None, str]]:
    while isinstance(x, dict) and "name" not in x and len(inner := [v for v in x.values() if isinstance(v, dict)]) == 1:
        x = inner[0]
    nodes: list[tuple[int, int | None, str]] = []
    todo: list[tuple[object, int | None]] = [(x, None)]
    while todo:
        item, parent = todo.pop(0)
        name = item.get("name") if isinstance(item, dict) else item
        if not isinstance(name, str):
            continue
        nodes.append((len(nodes), parent, name))
        children = item.get("children") if isinstance(item, dict) else None
        todo += [(c, len(nodes) - 1) for c in (children if isinstance(children, list) else [])]
    return nodes


def response_nodes(text: str | None) -> tuple[str, list[tuple[int, int | None, str]]]:
    """Format and nodes of an answer: fenced JSON, JSON in prose, list, or 'none'; the first that gives a node counts."""
    if not text or not text.strip():
        return "none", []
    fence = _FENCE.search(text)
    for kind, part in (("fenced", fence[1] if fence else None), ("json", balanced_object(text))):
        if part:
            try:
                nodes = _json_nodes(json.loads(part))
            except (ValueError, RecursionError):
                continue
            if nodes:
                return kind, nodes
    if "{" not in text:
        nodes = indented_nodes(text)
        if len(nodes) > 1:
            return "list", nodes
    return "none", []


def parse_responses(df: DataFrame, key: str, text: str) -> DataFrame:
    """Nodes of every answer: key, format, node, parent, name; an answer without nodes gives one row of nulls."""

    def parse(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = []
            for k, t in zip(part[key], part[text]):
                kind, nodes = response_nodes(t)
                rows += [(k, kind, *n) for n in nodes] or [(k, kind, None, None, None)]
            out = pd.DataFrame(rows, columns=[key, "format", "node", "parent", "name"])
            yield out.astype({"node": "Int64", "parent": "Int64"})

    return df.select(key, text).mapInPandas(parse, f"`{key}` {dict(df.dtypes)[key]}, format string, node bigint, parent bigint, name string")


def with_depth(nodes: DataFrame, key: str) -> DataFrame:
    """Node tables of one record each get a depth by walking the parents (nodes are numbered parents first)."""

    def walk(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = []
            for k, items in zip(part[key], part["items"]):
                depth: dict[int, int] = {}
                for n in sorted(items, key=lambda n: n["node"]):
                    depth[n["node"]] = 0 if n["parent"] is None else depth.get(n["parent"], 0) + 1
                    rows.append((k, n["node"], n["parent"], n["name"], depth[n["node"]]))
            yield pd.DataFrame(rows, columns=[key, "node", "parent", "name", "depth"]).astype({"node": "Int64", "parent": "Int64"})

    packed = nodes.filter("node is not null").groupBy(key).agg(F.collect_list(F.struct("node", "parent", "name")).alias("items"))
    return packed.mapInPandas(walk, f"`{key}` {dict(nodes.dtypes)[key]}, node bigint, parent bigint, name string, depth int")
