"""Near-duplicate detection by bottom-k sketches.

One hash function orders all word shingles; the k smallest hash values of a
document's shingle set are its sketch. Inverted lists of the retained values
generate overlaps, an estimate on the union's sketch filters them, and the exact
Jaccard coefficient of the full sets decides.

How the work stays linear in hot groups
---------------------------------------
* Equal shingle sets form one class, represented by its smallest doc_id.
* A value retained by one class only cannot be shared; a class with too few
  shared values cannot have a partner and leaves.
* The rest enter only the lists of their rarest shared values, as many as the
  prefix-filter principle needs so that partners meet in one list at least.
* Let u(x) be the number of shingles of x that no other candidate has. The sets
  of a link differ by at least u(x)+u(y) shingles, so a link with threshold
  num/den needs (den+num)(u(x)+u(y)) <= (den-num)(|x|+|y|). With
  e(x) = (den+num)u(x) - (den-num)|x| that reads e(x)+e(y) <= 0. In each list the
  member with the least e (the most central text) is compared with all others:
  whoever fails e(pivot)+e(y) <= 0 can have no partner in that list at all.
* Members that could be but are not linked with the pivot, nor in its component
  by another way, are searched for in full: a partner shares at least one of the
  rarest shingles of such a set, as many as the overlap that a link of these two
  sizes needs leaves over, so these few shingles are looked up in all sets.

No list is capped or sampled and no list's pairs are enumerated as such.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import ascii_lower, forget, stored, words
from tessera.llm.components import connected_components

#: Sketch size, the least share of a full sketch that partners have in common, and the estimate below which a pair is not verified.
#: For partners of Jaccard 0.8 a 64-value union sketch has 51 +- 3.2 common values; 32 lies 6 deviations below.
SKETCH, LEAST_COMMON, LEAST_SHORT = 64, 32, 0.7


def shingle_set(text_words: str, width: int) -> str:
    """SQL for the sorted distinct hash values of the word shingles in an array column."""
    parts = ", ".join(f"element_at({text_words}, i + {k})" for k in range(width))
    return (
        f"sort_array(array_distinct(CASE WHEN size({text_words}) >= {width} THEN transform(sequence(1, size({text_words}) - {width - 1}), i -> xxhash64({parts})) "
        f"WHEN size({text_words}) > 0 THEN array(xxhash64(array_join({text_words}, ' '), size({text_words}))) ELSE cast(array() AS array<bigint>) END))"
    )


def _sets(docs: DataFrame, width: int) -> DataFrame:
    """(doc_id, s): the full shingle set of each row, as sorted 64-bit hash values."""
    return docs.select("doc_id", words(ascii_lower(F.col("text"))).alias("w")).select("doc_id", F.expr(shingle_set("w", width)).alias("s"))


def _verified(pairs: DataFrame, sketches: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """Pairs (a, b) that pass the union-sketch estimate and the exact test."""
    sk = lambda end: sketches.select(F.col("node").alias(end), F.col("sketch").alias(f"sk_{end}"))
    full = lambda end: sets.select(F.col("node").alias(end), F.col("s").alias(f"s_{end}"))
    k = f"least({SKETCH}, size(array_union(sk_a, sk_b)))"
    union = f"slice(sort_array(array_union(sk_a, sk_b)), 1, {k})"
    common = f"size(array_intersect(array_intersect(sk_a, sk_b), {union}))"
    near = pairs.join(sk("a"), "a").join(sk("b"), "b").where(F.expr(f"{common} >= {LEAST_COMMON / SKETCH} * {k}")).select("a", "b")
    both = near.join(full("a"), "a").join(full("b"), "b").select("a", "b", F.expr("size(array_intersect(s_a, s_b))").alias("i"), (F.size("s_a") + F.size("s_b")).alias("n"))
    return both.where(F.col("i") * den >= (F.col("n") - F.col("i")) * num).select("a", "b")


def near_duplicates(docs: DataFrame, *, width: int = 5, num: int = 8, den: int = 10) -> DataFrame:
    """Near-duplicate components of ``docs`` (doc_id, text).

    Two documents are linked if their sets of ``width``-word shingles (ASCII
    lower-cased; the whole sequence if there are fewer words) have a Jaccard
    coefficient of at least num/den. Returns one row per input row: doc_id,
    n_shingles, component_id (smallest doc_id reachable), kept (doc_id is
    component_id), class_id (smallest doc_id with the same set).

    Null and empty texts have no shingles and are linked with nothing. Rows with
    a null doc_id link with nothing: component_id null, kept true. Rows that
    repeat a doc_id are one document: if their texts differ, it links by each of
    them, and n_shingles and class_id are those of the row. Ties go to the smaller doc_id. Other columns, whatever their names,
    are not read. An empty table gives an empty table.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    base = _sets(docs, width).select("doc_id", F.size("s").cast("long").alias("n"), F.xxhash64("s").alias("h1"), F.hash("s").alias("h2"), F.slice("s", 1, SKETCH).alias("sketch"))
    base = stored(base, "nd-base")
    key = ["h1", "h2", "n"]
    real = base.where("n > 0 AND doc_id IS NOT NULL")
    # A class is named by its smallest doc_id; if that id has other texts too, the further classes get names of their own.
    classes = real.groupBy(*key).agg(F.min("doc_id").alias("first_id"))
    turn = F.row_number().over(Window.partitionBy("first_id").orderBy(*key))
    classes = stored(classes.withColumn("node", F.when(turn == 1, F.col("first_id")).otherwise(F.xxhash64(*key, turn))), "nd-classes")
    nodes = classes.withColumnRenamed("first_id", "doc_id")
    sketches = stored(real.join(nodes, ["doc_id", *key]).dropDuplicates(["node"]).select("node", "n", "sketch"), "nd-sketches")
    # The classes of one doc_id belong together.
    several = real.groupBy("doc_id").agg(F.min("h1").alias("lo"), F.max("h1").alias("hi")).where("lo <> hi").select("doc_id")
    texts = real.join(several, "doc_id", "left_semi").select("doc_id", *key).distinct().join(classes, key).select("doc_id", "node")
    same_id = texts.join(texts.groupBy("doc_id").agg(F.min("node").alias("a")), "doc_id").where("node <> a").select("a", F.col("node").alias("b"))

    values = sketches.select("node", F.col("n"), F.explode("sketch").alias("v"))
    shared = values.groupBy("v").agg(F.count(F.lit(1)).alias("f")).where("f > 1")
    least = F.expr(f"CASE WHEN n >= {SKETCH} THEN {LEAST_COMMON} ELSE ceil({LEAST_SHORT} * n) END")
    by_node = Window.partitionBy("node")
    lists = values.join(shared, "v").withColumn("c", F.count(F.lit(1)).over(by_node)).withColumn("r", F.row_number().over(by_node.orderBy("f", "v")))
    lists = stored(lists.where(F.col("c") >= least).where(F.col("r") <= F.col("c") - least + 1).select("v", "node", "n"), "nd-lists")

    members = lists.select("node").distinct()
    wanted = nodes.join(members, "node", "left_semi")
    sets = _sets(docs.join(wanted, "doc_id", "left_semi"), width)
    sets = sets.join(wanted, "doc_id").where((F.xxhash64("s") == F.col("h1")) & (F.hash("s") == F.col("h2"))).dropDuplicates(["node"]).select("node", "s")
    sets = stored(sets, "nd-sets")
    # A 32-bit value may hide that a shingle is unique, which only weakens the bound.
    single = sets.select("node", F.explode("s").alias("v")).groupBy(F.hash("v").alias("v"))
    single = single.agg(F.count(F.lit(1)).alias("f"), F.min("node").alias("node")).where("f = 1").groupBy("node").agg(F.count(F.lit(1)).alias("u"))
    excess = sets.select("node").join(single, "node", "left").select("node", F.coalesce("u", F.lit(0)).alias("u"))
    lists_e = lists.join(excess, "node").select("v", "node", "n", (F.col("u") * (den + num) - F.col("n") * (den - num)).alias("e"))
    lists_e = stored(lists_e, "nd-lists")
    forget(lists)
    pivots = lists_e.groupBy("v").agg(F.min(F.struct("e", "node", "n")).alias("p")).select("v", F.col("p.node").alias("p"), F.col("p.e").alias("pe"), F.col("p.n").alias("pn"))
    sized = lambda x, y: (F.col(x) * den >= F.col(y) * num) & (F.col(y) * den >= F.col(x) * num)
    hub = lists_e.join(pivots, "v").where((F.col("node") != F.col("p")) & (F.col("e") + F.col("pe") <= 0) & sized("n", "pn"))
    hub = hub.select(F.least("node", "p").alias("a"), F.greatest("node", "p").alias("b")).distinct()
    first = connected_components(_verified(hub, sketches, sets, num, den).unionByName(same_id))

    placed = lists_e.join(first, "node", "left").withColumn("g", F.coalesce("component", "node")).drop("component")
    centre = pivots.join(first.withColumnRenamed("node", "p"), "p", "left").select("v", "pe", F.coalesce("component", "p").alias("pg"))
    failed = placed.join(centre, "v").where("g <> pg AND e + pe <= 0").select("node", "n", "e", "g").distinct()
    failed = stored(failed.join(sets, "node").select(F.col("node").alias("y"), F.col("n").alias("yn"), F.col("e").alias("ye"), F.col("g").alias("yg"), F.explode("s").alias("v")), "nd-failed")
    tokens = sets.select("node", F.explode("s").alias("v")).join(failed.select("v").distinct(), "v", "left_semi")
    tokens = stored(tokens, "nd-tokens")
    often = tokens.groupBy("v").agg(F.count(F.lit(1)).alias("f"))
    rare = failed.join(often, "v").withColumn("r", F.row_number().over(Window.partitionBy("y").orderBy("f", "v")))
    rare = rare.where(F.col("r") <= F.col("yn") - F.ceil(F.col("yn") * num / den) + 1)
    facts = placed.select("node", "n", "e", "g").distinct()
    overlap = F.ceil((F.col("n") + F.col("yn")) * num / (num + den))
    rest = tokens.join(facts, "node").join(rare, "v").where((F.col("g") != F.col("yg")) & (F.col("e") + F.col("ye") <= 0) & sized("n", "yn") & (F.col("r") <= F.col("yn") - overlap + 1))
    rest = rest.select(F.least("node", "y").alias("a"), F.greatest("node", "y").alias("b")).distinct().join(hub, ["a", "b"], "left_anti")
    more = _verified(rest, sketches, sets, num, den)
    # Components contracted so far are the nodes of the second search.
    label = first.select(F.col("node"), "component")
    ends = more.join(label.toDF("a", "ca"), "a", "left").join(label.toDF("b", "cb"), "b", "left").select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b"))
    second = connected_components(ends)
    groups = classes.join(first, "node", "left").withColumn("g", F.coalesce("component", "node")).join(second.toDF("g", "h"), "g", "left")
    groups = stored(groups.select(*key, "first_id", F.coalesce("h", "g").alias("group")), "nd-groups")
    # What is returned reads base and groups only.
    for table in (classes, sketches, lists_e, sets, first, failed, tokens, second):
        forget(table)
    # The smallest doc_id of a component is that of one of its classes.
    names = groups.groupBy("group").agg(F.min("first_id").alias("component_id"))
    named = groups.join(names, "group").select(*key, F.col("first_id").alias("class_id"), "component_id")
    out = base.select("doc_id", *key).join(named, key, "left")
    real_row = (F.col("n") > 0) & F.col("doc_id").isNotNull()
    out = out.select("doc_id", F.col("n").alias("n_shingles"), F.when(real_row, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"), F.when(real_row, F.col("class_id")).otherwise(F.col("doc_id")).alias("class_id"))
    return out.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"), "class_id")
