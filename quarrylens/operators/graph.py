"""Strongly connected components of a directed graph."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrylens.runtime import materialize

IN_ONE_TASK = 200_000


def strong_components(edges: DataFrame, in_one_task: int = IN_ONE_TASK) -> DataFrame:
    """(node, component) of every node on a cycle through other nodes; component is the least node of it.

    edges(src, dst) are distinct; loops on one node don't count. Up to in_one_task edges that survive the trimming one task solves the graph;
    a larger one is solved by rounds of joins: the largest node that reaches each node colours it, and within a colour the nodes that reach
    the root are one component. Nothing is collected.
    """
    edges = materialize(edges.where("src <> dst AND src IS NOT NULL AND dst IS NOT NULL").select("src", "dst"))
    while True:
        before = edges.count()
        if not before:
            return edges.select(F.col("src").alias("node"), F.col("src").alias("component"))
        if before <= in_one_task:
            return edges.select(F.lit(0).alias("g"), "src", "dst").groupBy("g").applyInPandas(lambda pdf: _tarjan(pdf), f"node {edges.schema['src'].dataType.simpleString()}, component {edges.schema['src'].dataType.simpleString()}")
        edges = materialize(edges.join(edges.select(F.col("dst").alias("src")).distinct(), "src", "left_semi").join(edges.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi").select("src", "dst"))
        if edges.count() == before:
            return _coloured(edges)


def _spread(labels: DataFrame, edges: DataFrame) -> DataFrame:
    """labels(node, label) raised along edges to the largest label that reaches each node."""
    while True:
        moved = labels.join(edges, labels.node == edges.src).select(F.col("dst").alias("node"), "label")
        new = materialize(labels.unionByName(moved).groupBy("node").agg(F.max("label").alias("label")))
        changed = new.join(labels.withColumnRenamed("label", "old"), "node", "left").where("old IS NULL OR old <> label").limit(1).count()
        labels = new
        if not changed:
            return labels


def _coloured(edges: DataFrame) -> DataFrame:
    found = None
    while not edges.isEmpty():
        nodes = edges.select(F.col("src").alias("node")).union(edges.select("dst")).distinct()
        colour = _spread(nodes.select("node", F.col("node").alias("label")), edges)
        a, b = colour.select(F.col("node").alias("src"), F.col("label").alias("ca")), colour.select(F.col("node").alias("dst"), F.col("label").alias("cb"))
        within = materialize(edges.join(a, "src").join(b, "dst").where("ca = cb").select(F.col("dst").alias("src"), F.col("src").alias("dst")))
        reached = _spread(colour.where("node = label"), within)
        part = reached.groupBy("label").agg(F.min("node").alias("component"), F.count("*").alias("n")).where("n > 1")
        part = materialize(reached.join(part, "label").select("node", "component"))
        found = part if found is None else found.unionByName(part)
        gone = reached.select("node")
        edges = materialize(edges.join(gone.withColumnRenamed("node", "src"), "src", "left_anti").join(gone.withColumnRenamed("node", "dst"), "dst", "left_anti").select("src", "dst"))
    return found


def _tarjan(pdf: pd.DataFrame) -> pd.DataFrame:
    """Components of a small graph without recursion."""
    out: dict = {}
    for s, d in zip(pdf["src"].tolist(), pdf["dst"].tolist()):
        out.setdefault(s, []).append(d)
        out.setdefault(d, [])
    index: dict = {}
    low: dict = {}
    stack: list = []
    on: set = set()
    rows: list = []
    for root in out:
        work: list[tuple[object, Iterator]] = []
        if root not in index:
            work.append((root, iter(out[root])))
            index[root] = low[root] = len(index)
            stack.append(root)
            on.add(root)
        while work:
            v, rest = work[-1]
            w = next(rest, None)
            if w is not None:
                if w not in index:
                    index[w] = low[w] = len(index)
                    stack.append(w)
                    on.add(w)
                    work.append((w, iter(out[w])))
                elif w in on:
                    low[v] = min(low[v], index[w])
                continue
            work.pop()
            if work:
                low[work[-1][0]] = min(low[work[-1][0]], low[v])
            if low[v] == index[v]:
                part = []
                while not part or part[-1] != v:
                    part.append(stack.pop())
                    on.discard(part[-1])
                if len(part) > 1:
                    rows += [(x, min(part)) for x in part]
    return pd.DataFrame(rows, columns=["node", "component"])
