"""Dated trees: Newick topologies as edge tables, clades of calibrated pairs, consistency of bounds."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators.hierarchy import ancestors

_TOKEN = re.compile(r"\s*(?:([(),;])|'((?:[^']|'')*)'|:\s*([0-9.eE+-]+)|([^\s(),:;']+))")


def parse_newick(text: str) -> list[tuple[int, int | None, str, float | None]]:
    """(node, parent, label, length) of a Newick tree, the root first; a tree is one small text."""
    rows: list[list] = [[0, None, "", None]]
    at, done = 0, False
    for m in _TOKEN.finditer(text):
        sign, quoted, length, label = m.groups()
        if done:
            raise ValueError("text after the end of the tree")
        if sign == "(":
            rows.append([len(rows), at, "", None])
            at = len(rows) - 1
        elif sign == ",":
            parent = rows[at][1]
            if parent is None:
                raise ValueError("a comma outside of parentheses")
            rows.append([len(rows), parent, "", None])
            at = len(rows) - 1
        elif sign == ")":
            if rows[at][1] is None:
                raise ValueError("unbalanced parentheses")
            at = rows[at][1]
        elif sign == ";":
            if at != 0:
                raise ValueError("unbalanced parentheses")
            done = True
        elif length is not None:
            rows[at][3] = float(length)
        else:
            rows[at][2] = quoted.replace("''", "'") if quoted is not None else label
    if not done:
        raise ValueError("a tree ends with a semicolon")
    return [tuple(r) for r in rows]


def edges(spark: SparkSession, text: str) -> DataFrame:
    return spark.createDataFrame(parse_newick(text), "node long, parent long, label string, length double")


def clades(tree: DataFrame, pairs: DataFrame) -> DataFrame:
    """Pairs of labels (a, b, ...) with ``mrca``, the deepest node above both; null if a label is not in the tree."""
    leaf = tree.where("label <> ''").select("label", "node")
    up = ancestors(tree, leaf.select("node"), child="node", parent="parent")
    wanted = pairs.withColumn("__i", F.xxhash64("a", "b"))
    side = lambda c: wanted.join(leaf, F.col(c) == F.col("label")).join(up.select(F.col("start").alias("node"), F.col("node").alias("anc"), "depth"), "node").select("__i", "anc", F.col("depth").alias(f"d_{c}"))
    common = side("a").join(side("b"), ["__i", "anc"]).groupBy("__i").agg(F.min_by("anc", F.col("d_a") + F.col("d_b")).alias("mrca"))
    return wanted.join(common, "__i", "left").drop("__i")


def bound_conflicts(tree: DataFrame, bounds: DataFrame) -> DataFrame:
    """(ancestor, descendant): calibrated nodes (node, low, high) whose ancestor must be younger than the descendant's least age."""
    up = ancestors(tree, bounds.select("node"), child="node", parent="parent").where("depth > 0")
    old, young = bounds.select(F.col("node").alias("ancestor"), F.col("high").alias("__high")), bounds.select(F.col("node").alias("start"), F.col("low").alias("__low"))
    return up.join(young, "start").join(old, F.col("node") == F.col("ancestor")).where("__high < __low").select("ancestor", F.col("start").alias("descendant"))
