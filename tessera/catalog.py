"""Ad-hoc SQL over registered tables, queries only."""

from __future__ import annotations

from collections.abc import Iterator, Mapping

from pyspark.sql import DataFrame, SparkSession

_QUERIES = frozenset(
    "Project Filter Aggregate Sort GlobalLimit LocalLimit Limit Join Union Except Intersect Distinct Deduplicate SubqueryAlias With UnresolvedWith WithCTE UnresolvedInlineTable LocalRelation OneRowRelation UnresolvedRelation "
    "Window Generate Pivot Unpivot Expand Sample Offset Tail View UnresolvedHaving UnresolvedSubqueryColumnAliases RepartitionByExpression Repartition LateralJoin Range UnresolvedHint ResolvedHint".split()
)


class NotAQuery(ValueError):
    """The statement would change something, or is no single query."""


def register(spark: SparkSession, tables: Mapping[str, DataFrame]) -> None:
    """Tables as temporary views."""
    for name, df in tables.items():
        df.createOrReplaceTempView(name)


# Functions that run code of any class, and formats whose names make a path a table.
_CODE = frozenset(("java_method", "reflect", "try_reflect"))
_FORMATS = frozenset(("parquet", "csv", "json", "orc", "text", "binaryfile", "avro", "xml", "libsvm", "image", "delta", "jdbc"))


def _nodes(spark: SparkSession, plan) -> Iterator:
    """All nodes of a parsed plan: children, expressions, subqueries, common table expressions."""
    jvm = spark._jvm
    load = lambda name: jvm.java.lang.Thread.currentThread().getContextClassLoader().loadClass(name)
    node, many, product = load("org.apache.spark.sql.catalyst.trees.TreeNode"), load("scala.collection.Iterable"), load("scala.Product")
    todo = [plan]
    while todo:
        at = todo.pop()
        if at is None or not hasattr(at, "getClass"):
            continue
        if many.isInstance(at):
            inner = at.iterator()
        elif product.isInstance(at):
            if node.isInstance(at):
                yield at
            inner = at.productIterator()
        else:
            continue
        while inner.hasNext():
            todo.append(inner.next())


def query(spark: SparkSession, text: str) -> DataFrame:
    """Run one read-only statement over registered tables; the parser's own plan is judged, all of it, before anything is executed.

    Commands, scripts, functions that run code by name, and files as tables are refused, wherever they stand.
    """
    plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(text)
    name = plan.getClass().getSimpleName()
    if name not in _QUERIES:
        raise NotAQuery(f"only queries are allowed, not {name}")
    for at in _nodes(spark, plan):
        kind = at.getClass().getSimpleName()
        if kind.endswith("Command") or kind in ("ScriptTransformation", "InsertIntoStatement", "InsertIntoDir"):
            raise NotAQuery(f"only queries are allowed, not {kind}")
        if kind == "UnresolvedFunction" and at.nameParts().last().lower() in _CODE:
            raise NotAQuery(f"{at.nameParts().last()} is not allowed")
        if kind == "UnresolvedRelation" and at.multipartIdentifier().size() > 1 and at.multipartIdentifier().head().lower() in _FORMATS:
            raise NotAQuery("files are no tables here: register them")
    return spark.sql(text)
