"""Selections over the manifest: active rows, releases, exports, evidence of hits, attention lists."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.latest import latest_completed
from tessera.operators.predicates import role_matches

# Decisions that a release accepts.
ACCEPTED = ("PASS", "PASS_WITH_WARNINGS", "ACCEPT_WITH_WARNING")


def without(df: DataFrame, *gone: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows whose key is in none of the tables."""
    for g in gone:
        df = df.join(g.select(*keys), list(keys), "left_anti")
    return df


def active(df: DataFrame, retired: DataFrame, superseded: DataFrame) -> DataFrame:
    """Rows whose (entity_type, entity_id) is neither retired nor superseded."""
    keys = ["entity_type", "entity_id"]
    return without(df, retired.toDF(*keys), superseded.toDF(*keys), keys=keys)


def active_sources(sources: DataFrame, links: DataFrame, live: DataFrame, key: str) -> DataFrame:
    """Sources without links, or with at least one link to a live row."""
    linked = links.select(key).distinct()
    alive = links.join(live, [c for c in live.columns if c in links.columns], "left_semi").select(key).distinct()
    return sources.join(linked.join(alive, key, "left_anti"), key, "left_anti")


def either_join(left: DataFrame, right: DataFrame, pairs: Sequence[tuple[str, str]]) -> DataFrame:
    """Distinct rows of a join by any of several key pairs: a union of equi-joins instead of an OR condition."""
    return reduce(DataFrame.unionByName, [left.join(right, left[a] == right[b]) for a, b in pairs]).distinct()


def candidate_files(files: DataFrame, *, role: str, formats: Sequence[str], retired: DataFrame, superseded: DataFrame) -> DataFrame:
    return active(files.where(role_matches(F.col("file_role"), role) & F.col("format").isin(*formats)), retired, superseded)


def release_files(files: DataFrame, decisions: DataFrame, retired: DataFrame, superseded: DataFrame, accepted: Sequence[str] = ACCEPTED) -> DataFrame:
    """Files of entities whose effective decision is accepted, still active."""
    good = decisions.where(F.coalesce("curated_decision", "decision").isin(*accepted)).select("entity_type", "entity_id")
    return active(files.join(good, ["entity_type", "entity_id"], "left_semi"), retired, superseded)


def release_exclusions(decisions: DataFrame, retirements: DataFrame, accepted: Sequence[str] = ACCEPTED) -> DataFrame:
    """(entity_type, entity_id, reason, detail): retired ones with their roots, else those whose decision isn't accepted."""
    keys = ["entity_type", "entity_id"]
    roots = retirements.groupBy(*keys).agg(F.array_join(F.sort_array(F.collect_set(F.concat_ws(":", "root_type", "root_id"))), ";").alias("__roots"))
    out = decisions.withColumn("__d", F.coalesce("curated_decision", "decision")).join(roots, keys, "left")
    out = out.where(F.col("__roots").isNotNull() | ~F.col("__d").isin(*accepted))
    return out.select(*keys, F.when(F.col("__roots").isNotNull(), "RETIRED").otherwise("DECISION").alias("reason"), F.coalesce("__roots", "__d").alias("detail"))


def not_evaluated(files: DataFrame, decisions: DataFrame, changes: DataFrame | None = None) -> DataFrame:
    """Distinct entities of files without decision (MISSING), or whose latest change is newer than the decision's audit mark (STALE)."""
    keys = ["entity_type", "entity_id"]
    who = files.select(*keys).distinct().join(decisions.select(*keys, F.lit(True).alias("__has"), *(["change_id"] if changes is not None else [])), keys, "left")
    status = F.when(F.col("__has").isNull(), "MISSING")
    if changes is not None:
        last = changes.groupBy(*keys).agg(F.max("change_id").alias("__last"))
        who = who.join(last, keys, "left")
        status = status.when(F.coalesce("__last", F.lit(0)) > F.coalesce("change_id", F.lit(0)), "STALE")
    return who.withColumn("status", status).where("status IS NOT NULL").select(*keys, "status")


def select_files(files: DataFrame, criteria: Sequence[Column], *, states: DataFrame | None = None, state: str | None = None, decisions: DataFrame | None = None, decision: str | None = None) -> DataFrame:
    """Files that meet all criteria, by columns, entity state and effective decision; at least one is needed."""
    if not criteria and state is None and decision is None:
        raise ValueError("a selection needs a criterion")
    out = files
    for test in criteria:
        out = out.where(test)
    if state is not None:
        out = out.join(states.where(F.col("state") == state).select("entity_type", "entity_id"), ["entity_type", "entity_id"], "left_semi")
    if decision is not None:
        if decisions is None:
            raise ValueError("a decision needs a profile's decisions")
        out = out.join(decisions.where(F.coalesce("curated_decision", "decision") == decision).select("entity_type", "entity_id"), ["entity_type", "entity_id"], "left_semi")
    return out


def preview(files: DataFrame, size: str = "size_bytes") -> DataFrame:
    return files.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(size), F.lit(0)).alias("bytes"))


def latest_job_rows(rows: DataFrame, jobs: DataFrame, keys: Sequence[str] = ("analysis_name", "file_id")) -> DataFrame:
    """Hits or alignments of the newest completed job of each key."""
    return rows.join(latest_completed(jobs, keys).select("job_id"), "job_id", "left_semi")


def ignored_jobs(jobs: DataFrame, key: str = "analysis_name") -> DataFrame:
    """One row: completed jobs that a newer one of the same analysis replaces."""
    return jobs.where("status = 'completed'").agg((F.count(F.lit(1)) - F.count_distinct(key)).alias("ignored"))


def region_order(subject: str = "subject_id") -> list[Column]:
    """Order in which extracted regions are listed: sequence, start, end, subject; a missing subject counts as empty."""
    return [F.col("seqid").asc(), F.col("start").cast("long").asc(), F.col("end").cast("long").asc(), F.coalesce(F.col(subject).cast("string"), F.lit("")).asc()]


def sweep_stale(jobs: DataFrame, analysis: str, now: Column, *, name: str = "analysis_name", status: str = "status") -> DataFrame:
    """All jobs, with those of one analysis that a killed run left RUNNING marked as interrupted: status, finished_at and error change, other rows stay."""
    stale = F.coalesce((F.col(status) == "RUNNING") & (F.col(name) == analysis), F.lit(False))
    new = {status: F.lit("interrupted"), "finished_at": now, "error": F.lit("swept at startup: previous run terminated abnormally")}
    return jobs.select(*[F.when(stale, new[c]).otherwise(F.col(c)).alias(c) if c in new else F.col(c) for c in jobs.columns])


def evidence(alignments: DataFrame, *, evalue_max: float | None = None, min_span: int | None = None, criteria: Sequence[Column] = ()) -> DataFrame:
    """Alignments within an e-value and of a least query span."""
    out = alignments if evalue_max is None else alignments.where(F.col("evalue") <= evalue_max)
    out = out if min_span is None else out.where(F.col("query_end") - F.col("query_start") + 1 >= min_span)
    for c in criteria:
        out = out.where(c)
    return out


def select_sequences(universe: DataFrame, hits: DataFrame, key: str, *, complement: bool = False, analysis: str = "analysis_name", score: str = "evalue") -> DataFrame:
    """All sequences with selected, analyses, best score and number of hits."""
    found = hits.groupBy(key).agg(F.array_join(F.sort_array(F.collect_set(analysis)), ",").alias("analyses"), F.min(score).alias("best"), F.count(F.lit(1)).alias("n_hits"))
    out = universe.join(found, key, "left").withColumn("n_hits", F.coalesce("n_hits", F.lit(0)))
    return out.withColumn("selected", (F.col("n_hits") > 0) != F.lit(complement)).withColumn("analyses", F.coalesce("analyses", F.lit("")))


def resolve_sequences(wanted: DataFrame, sequences: DataFrame, key: str = "seqid", source: str = "file_id") -> DataFrame:
    """(seqid, status, source): FOUND in exactly one source, MISSING, or AMBIGUOUS."""
    where = sequences.groupBy(key).agg(F.count_distinct(source).alias("__n"), F.min(source).alias(source))
    out = wanted.select(key).distinct().join(where, key, "left")
    status = F.when(F.col("__n").isNull(), "MISSING").when(F.col("__n") > 1, "AMBIGUOUS").otherwise("FOUND")
    return out.select(key, status.alias("status"), F.when(status == "FOUND", F.col(source)).alias(source))


def hit_summary(hits: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    return hits.groupBy(*keys).agg(
        F.count_distinct("query_id").alias("queries"), F.count_distinct(F.when(F.col("hit_rank") == 1, F.col("query_id"))).alias("queries_with_best"), F.count_distinct("query_id", "subject_id").alias("pairs"), F.min("evalue").alias("min_evalue")
    )


def attention(sources: Mapping[str, DataFrame], order: Sequence[Column], *, limit: int = 0) -> DataFrame:
    """Union of listings with their kind, the whole count of each kind, and a page of each."""
    both = reduce(DataFrame.unionByName, [df.withColumn("kind", F.lit(kind)) for kind, df in sources.items()])
    totals = both.groupBy("kind").agg(F.count(F.lit(1)).alias("total"))
    w = Window.partitionBy("kind").orderBy(*order)
    out = both.withColumn("rank", F.row_number().over(w))
    out = out.where(F.col("rank") <= limit) if limit else out
    return out.join(totals, "kind")


def listed(df: DataFrame, keys: Sequence[str], item: Column, name: str, sep: str = ", ") -> DataFrame:
    """Texts of each key joined in sorted order."""
    return df.groupBy(*keys).agg(F.array_join(F.sort_array(F.collect_list(item)), sep).alias(name))


def search(df: DataFrame, text: str, columns: Sequence[str]) -> DataFrame:
    """Rows in which a column contains the text, whatever its case."""
    return df.where(reduce(or_, [F.contains(F.lower(F.col(c)), F.lit(text.lower())) for c in columns])) if text else df


def uses(snapshots: DataFrame, log: DataFrame, key: str, name: str = "uses") -> DataFrame:
    """Snapshots with how many rows of a log refer to each."""
    n = log.groupBy(key).agg(F.count(F.lit(1)).alias(name))
    return snapshots.join(n, key, "left").withColumn(name, F.coalesce(name, F.lit(0)))


def missing_kinds(wanted: DataFrame, present: DataFrame, key: str, kind: str) -> DataFrame:
    """(key, missing): the wanted kinds that are not present, as one sorted text; complete keys have an empty one."""
    lack = wanted.join(present, [key, kind], "left_anti").groupBy(key).agg(F.array_join(F.sort_array(F.collect_set(kind)), ",").alias("missing"))
    return wanted.select(key).distinct().join(lack, key, "left").withColumn("missing", F.coalesce("missing", F.lit("")))


def accession_matches(df: DataFrame, column: str, accession: str) -> DataFrame:
    """Rows with this accession, or any version of it if it has none."""
    c = F.col(column)
    return df.where(c == accession if "." in accession else (c == accession) | c.startswith(accession + "."))


def supersessions(annotations: DataFrame, keys: Sequence[str], score: Sequence[str], content: str, ident: str) -> DataFrame:
    """(old, new): annotations of one identity that the best one, of the same content, replaces."""
    w = Window.partitionBy(*keys).orderBy(*[F.col(s).desc() for s in score], F.col(ident))
    ranked = annotations.withColumn("__best", F.first(ident).over(w)).withColumn("__same", F.first(content).over(w))
    return ranked.where((F.col(ident) != F.col("__best")) & F.col(content).eqNullSafe(F.col("__same"))).select(F.col(ident).alias("old"), F.col("__best").alias("new"))


def unordered_pairs(df: DataFrame, a: str, b: str) -> DataFrame:
    """Distinct unordered pairs of different positive numbers."""
    ok = (F.col(a) > 0) & (F.col(b) > 0) & (F.col(a) != F.col(b))
    return df.where(ok).select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).distinct()


def fanout(assignments: DataFrame, sequences: DataFrame, unit: str = "unit", seqid: str = "seqid") -> DataFrame:
    """(unit, n, fasta_hash): records of each unit in order of seqid, and the hash of their content; repeated assignments count once."""
    rows = assignments.select(unit, seqid).distinct().join(sequences.select(seqid, "sequence"), seqid)
    rows = rows.withColumn("__h", F.sha2(F.concat_ws("\n", F.col(seqid), F.col("sequence")), 256))
    return rows.groupBy(unit).agg(F.count(F.lit(1)).alias("n"), F.sha2(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(seqid, "__h"))), lambda x: x["__h"]), ""), 256).alias("fasta_hash"))
