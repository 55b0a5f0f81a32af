"""Line deduplication by the suffix array of line-ID sequences (native).

Every line with a word is an ID (a 64-bit hash value) and every document a sequence
of IDs; a repeat never crosses a document's end. An ID that stands in one place only
belongs to no repeat, so suffixes are sorted only as far as the next such line.

The suffix array is built by distributed prefix doubling. A suffix's rank for h lines
is the number of suffixes that come before it by their first h lines; ranks for 2h
lines come from sorting the pairs (rank here, rank h lines on) of all suffixes. The
distinct pairs are counted first and only they are sorted, by range over all tasks,
with running sums of their counts; so the copies of a very common line are one row of
the sort, and pairs that occur once leave. Six ranks, for 1 to 32 lines, place every
run of up to 64 lines: by the rank of its first lines and that of its last ones.

Suffixes with equal ranks are neighbours in the array and form its LCP intervals. The
depth wanted is, for each suffix, the fewest lines with ``min_words`` words: an
interval of that depth with two suffixes is a repeated run that is long enough, and
whatever longer repeat there is, is a chain of overlapping ones. Each suffix but an
interval's first is a later copy, and its lines go; what overlaps or touches is
deleted as one stretch.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import WORD, forget, stored

def _levels(min_words: int) -> list[int]:
    out = [1]
    while 2 * out[-1] <= min_words:
        out.append(2 * out[-1])
    return out


def line_rows(docs: DataFrame) -> DataFrame:
    """(uid, doc_id, line, id, w): the lines with words of each distinct (doc_id, text), numbered from 0 with blank lines counted."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("text IS NOT NULL")
    lines = rows.select("doc_id", F.xxhash64("doc_id", "text").alias("uid"), F.posexplode(F.split("text", "\n")).alias("line", "t"))
    # Repeated rows are one document.
    lines = lines.select("uid", "doc_id", "line", F.xxhash64("t").alias("id"), F.regexp_count("t", F.lit(WORD)).alias("w")).where("w > 0")
    return lines.repartition("uid").groupBy("uid", "doc_id", "line").agg(F.first("id").alias("id"), F.first("w").alias("w"))


def _ranked(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """Distinct ``keys`` that occur twice or more, with ``rank``: how many rows come before them in their order.

    Sorted by range over all tasks; a task's sum of counts is added to those after it.
    """
    counts = pairs.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    # Stored, so that the ranges are drawn once.
    counts = stored(counts.repartitionByRange(*keys).withColumn("task", F.spark_partition_id()), "ld-pairs")
    sums = counts.groupBy("task").agg(F.sum("n").alias("own"))
    # One row for each task of the sort.
    sums = sums.select("task", (F.sum("own").over(Window.orderBy("task")) - F.col("own")).alias("offset"))
    inside = F.sum("n").over(Window.partitionBy("task").orderBy(*keys).rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")
    return counts.withColumn("inside", inside).join(F.broadcast(sums), "task").select(*keys, (F.col("offset") + F.col("inside")).alias("rank"))


def suffix_ranks(docs: DataFrame, *, min_words: int = 50) -> DataFrame:
    """The suffixes that begin with a repeated line: (uid, doc_id, line, w, before, k, r1, r2, r4, ...).

    ``before`` are the document's words before the line, ``k`` the line's number
    without blank lines, ``rh`` the suffix's rank by its first h lines, null if no
    other suffix has the same.
    """
    own = Window.partitionBy("uid").orderBy("line")
    lines = line_rows(docs).withColumn("before", F.sum("w").over(own.rowsBetween(Window.unboundedPreceding, 0)) - F.col("w")).withColumn("k", F.row_number().over(own))
    lines = stored(lines, "ld-lines")
    ranks = stored(lines.join(_ranked(lines, ["id"]), "id").drop("id").withColumnRenamed("rank", "r1"), "ld-ranks")
    forget(lines)
    by_line = Window.partitionBy("uid").orderBy("k")
    for h in _levels(min_words)[1:]:
        half, step = f"r{h // 2}", h // 2
        after = F.when(F.lead("k", step).over(by_line) == F.col("k") + step, F.lead(half, step).over(by_line))
        paired = stored(ranks.withColumn("p", F.when(after.isNotNull(), F.col(half))).withColumn("q", after), "ld-ranks")
        ranked = _ranked(paired.where("p IS NOT NULL").select("p", "q"), ["p", "q"])
        new = stored(paired.join(ranked, ["p", "q"], "left").drop("p", "q").withColumnRenamed("rank", f"r{h}"), "ld-ranks")
        forget(ranks), forget(paired)
        ranks = new
    return ranks


def suffix_runs(docs: DataFrame, *, min_words: int = 50) -> DataFrame:
    """Runs that repeat, if their ``name`` does: (name, doc_id, uid, a, b, ka, kb).

    For each suffix, the fewest lines from it on, and the fewest up to its first line,
    that have ``min_words`` words; ``name`` is the run's place in the suffix array
    (number of lines, ranks of its first and of its last lines), a and b are the
    first and last line, ka and kb the same without counting blank lines.
    """
    levels = _levels(min_words)
    named = suffix_ranks(docs, min_words=min_words).withColumn("after", F.col("before") + F.col("w"))
    by_line = Window.partitionBy("uid").orderBy("k")
    for h in levels:
        # The rank of the h lines that end here.
        named = named.withColumn(f"e{h}", F.when(F.lag("k", h - 1).over(by_line) == F.col("k") - (h - 1), F.lag(f"r{h}", h - 1).over(by_line)) if h > 1 else F.col("r1"))
    ahead = Window.partitionBy("uid").orderBy("before").rangeBetween(0, min_words - 1)
    back = Window.partitionBy("uid").orderBy("after").rangeBetween(-(min_words - 1), 0)

    def run(frame, back: bool) -> Column:
        m = F.count(F.lit(1)).over(frame)
        edge = (lambda c: F.first(c).over(frame)) if back else (lambda c: F.last(c).over(frame))
        first, last = F.lit(None).cast("long"), F.lit(None).cast("long")
        for h in levels:
            first = F.when(m >= h, edge(f"r{h}") if back else F.col(f"r{h}")).otherwise(first)
            last = F.when(m >= h, F.col(f"e{h}") if back else edge(f"e{h}")).otherwise(last)
        start, stop = (edge("line"), F.col("line")) if back else (F.col("line"), edge("line"))
        ka, kb = (edge("k"), F.col("k")) if back else (F.col("k"), edge("k"))
        whole = (F.sum("w").over(frame) >= min_words) & (kb - ka + 1 == m) & first.isNotNull() & last.isNotNull()
        return F.when(whole, F.struct(F.struct(m.alias("m"), first.alias("first"), last.alias("last")).alias("name"), start.alias("a"), stop.alias("b"), ka.alias("ka"), kb.alias("kb")))

    both = named.select("doc_id", "uid", F.array(run(ahead, False), run(back, True)).alias("runs"))
    return both.select("doc_id", "uid", F.explode(F.array_distinct(F.array_compact("runs"))).alias("r")).select("r.name", "doc_id", "uid", "r.a", "r.b", "r.ka", "r.kb")


def later_copies(docs: DataFrame, *, min_words: int = 50) -> DataFrame:
    """Stretches of lines that are later copies: (uid, a, b), first and last line.

    The first copy is the one with the smallest (doc_id, nulls last; text hash; line).
    Copies that overlap or touch, of one run or of several, are one stretch.
    """
    runs = stored(suffix_runs(docs, min_words=min_words), "ld-runs")
    place = F.struct(F.col("doc_id").isNull().alias("z"), "doc_id", "uid", "a")
    heads = runs.groupBy("name").agg(F.min(place).alias("head"), F.count(F.lit(1)).alias("copies")).where("copies > 1").select("name", "head")
    later = runs.join(heads, "name").where(place > F.col("head")).select("uid", "a", "b", "ka", "kb").distinct()
    by_start = Window.partitionBy("uid").orderBy("ka", "kb")
    reach = F.max("kb").over(by_start.rowsBetween(Window.unboundedPreceding, -1))
    chained = later.withColumn("fresh", F.when(reach.isNull() | (F.col("ka") > reach + 1), 1).otherwise(0)).withColumn("chain", F.sum("fresh").over(by_start.rowsBetween(Window.unboundedPreceding, 0)))
    return chained.groupBy("uid", "chain").agg(F.min("a").alias("a"), F.max("b").alias("b")).select("uid", "a", "b")


def _left(lines: Column, cut: Column) -> Column:
    """The lines outside of the stretches, which are in order: one slice before each and one after the last."""

    def between(own: Column) -> Column:
        end = F.size(cut)
        first = lambda j: F.when(j == 0, 0).otherwise(F.get(cut, j - 1)["b"] + 1)
        after = lambda j: F.when(j == end, F.size(own)).otherwise(F.get(cut, j)["a"])
        return F.flatten(F.transform(F.sequence(F.lit(0), end), lambda j: F.slice(own, first(j) + 1, after(j) - first(j))))

    # An array of one element names the lines: they are split once, not for each stretch.
    return F.transform(F.array(lines), between)[0]


def dedup_lines(docs: DataFrame, *, min_words: int = 50) -> DataFrame:
    """Delete later copies of repeated line runs of at least ``min_words`` words.

    Keeps the columns and rows of ``docs`` (doc_id, text, ...) and adds n_lines,
    n_removed, n_runs (stretches deleted) and text_before; a clashing column of
    one of these names is replaced. Lines are what newlines separate; lines without
    words join no run, but go if the lines with words on either side of them go. A run is a copy if an equal
    sequence of lines starts earlier, in document order (doc_id, nulls last) or in
    the same document. Null texts stay null with 0 lines; empty texts have one
    line. Repeated rows are one document and lose the same lines; rows with one
    doc_id but different texts are documents of their own. An empty table gives an
    empty table.
    """
    docs = docs.drop("n_lines", "n_removed", "n_runs", "text_before")
    uid = F.xxhash64(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    cut = later_copies(docs, min_words=min_words).groupBy("uid").agg(F.array_sort(F.collect_list(F.struct("a", "b"))).alias("__cut"))
    out = docs.withColumn("__uid", uid).join(cut.withColumnRenamed("uid", "__uid"), "__uid", "left")
    lines = F.split(F.col("text"), "\n")
    removed = F.coalesce(F.aggregate("__cut", F.lit(0), lambda n, s: n + s["b"] - s["a"] + 1), F.lit(0))
    out = out.withColumn("n_lines", F.coalesce(F.size(lines), F.lit(0)).cast("long")).withColumn("n_lines", F.greatest(F.col("n_lines"), F.lit(0)))
    out = out.withColumn("n_removed", removed.cast("long")).withColumn("n_runs", F.coalesce(F.size("__cut"), F.lit(0)).cast("long"))
    out = out.withColumn("n_runs", F.greatest("n_runs", F.lit(0).cast("long"))).withColumn("text_before", F.col("text"))
    out = out.withColumn("text", F.when(F.col("__cut").isNull(), F.col("text")).otherwise(F.array_join(_left(lines, F.col("__cut")), "\n")))
    return out.drop("__uid", "__cut")


def dedup_sql(min_words: int = 50) -> str:
    """DuckDB SQL of the digest rows, with runs spelled out instead of named."""
    last = min_words - 1
    return rf"""
WITH l AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS t, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line FROM documents WHERE text IS NOT NULL
), w AS (SELECT *, len(regexp_extract_all(t, '[^\x20\x09-\x0D]+')) AS w FROM l
), p AS (SELECT *, sum(w) OVER (PARTITION BY doc_id ORDER BY line) - w AS before, sum(w) OVER (PARTITION BY doc_id ORDER BY line) AS after FROM w WHERE w > 0
), r AS (
  SELECT doc_id, line AS a, last(line) OVER f AS b, string_agg(t, chr(10)) OVER f AS run, sum(w) OVER f AS n FROM p WINDOW f AS (PARTITION BY doc_id ORDER BY before RANGE BETWEEN CURRENT ROW AND {last} FOLLOWING)
  UNION
  SELECT doc_id, first(line) OVER f AS a, line AS b, string_agg(t, chr(10)) OVER f AS run, sum(w) OVER f AS n FROM p WINDOW f AS (PARTITION BY doc_id ORDER BY after RANGE BETWEEN {last} PRECEDING AND CURRENT ROW)
), g AS (SELECT *, min((doc_id, a)) OVER (PARTITION BY md5(run)) AS head FROM r WHERE n >= {min_words}
), gone AS (SELECT DISTINCT doc_id, unnest(range(a, b + 1)) AS line FROM g WHERE (doc_id, a) > head
), c AS (SELECT l.*, CASE WHEN p.line IS NOT NULL THEN gone.line IS NOT NULL END AS gone FROM l LEFT JOIN p ON p.doc_id = l.doc_id AND p.line = l.line LEFT JOIN gone ON l.doc_id = gone.doc_id AND l.line = gone.line
), x AS (
  SELECT doc_id, t, line, coalesce(last(gone IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY line ROWS UNBOUNDED PRECEDING) AND first(gone IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY line ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), false) AS gone FROM c
), k AS (SELECT doc_id, string_agg(t, chr(10) ORDER BY line) FILTER (WHERE NOT gone) AS text, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_removed FROM x GROUP BY doc_id)
SELECT d.doc_id, CAST(coalesce(n_lines, 0) AS BIGINT) AS n_lines, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, md5(CASE WHEN d.text IS NOT NULL THEN coalesce(k.text, '') END) AS text_md5 FROM documents d LEFT JOIN k USING (doc_id)
"""
