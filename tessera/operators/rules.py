"""Versioned rule profiles compiled to columns: decisions and classifications in one pass."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.scalar import number
from tessera.operators.latest import current, latest
from tessera.operators.predicates import ORDERED, all_hold

# The state that a decision moves an entity to, states that decisions don't move, and the allowed moves.
DECISION_STATE = {"PASS": "ACCEPTED", "PASS_WITH_WARNINGS": "ACCEPTED", "NOT_EVALUATED": "QC_COMPLETE", "REVIEW": "REVIEW", "FAIL": "REJECTED", "EXCLUDED": "REJECTED"}
DECIDED = ("ACCEPTED", "REVIEW", "REJECTED", "RELEASED")


def satisfies(value: Column, rule: Mapping) -> Column:
    """Test of a metric's text by a rule; a rule without operator holds. Ordering needs numbers, equality and membership of ``in`` compare texts where it isn't one."""
    operator = rule.get("operator")
    if operator is None:
        return F.lit(True)
    if operator == "exists":
        return value.isNotNull()
    if operator in ("in", "not_in"):
        inside = value.cast("string").isin(*[str(v) for v in rule["values"]])
        return inside if operator == "in" else ~inside
    n = number(value.cast("string"))
    n = F.when(value.isNotNull() & n.isNull(), F.raise_error(F.concat(F.lit("not a number: "), value.cast("string"))).cast("double")).otherwise(n)
    if operator == "between":
        return (n >= float(rule["min"])) & (n <= float(rule["max"]))
    wanted = float(rule["value"])
    if operator in ORDERED:
        return ORDERED[operator](n, F.lit(wanted))
    if operator in ("==", "!="):
        return n == wanted if operator == "==" else n != wanted
    raise ValueError(f"unknown operator {operator}")


def _outcome(rule: Mapping, metrics: Mapping[str, Column], required: bool) -> Column:
    """Struct (kind, code) of one rule: kind is fail, missing, warning, note, or null if nothing follows."""
    name = rule["metric"]
    value = metrics.get(_source_name(rule, name), F.lit(None).cast("string"))
    say = lambda kind, code: F.struct(F.lit(kind).alias("kind"), F.lit(code).alias("code"))
    nothing = F.lit(None).cast("struct<kind:string,code:string>")
    by = rule.get("value_by")
    if by is None:
        test = F.coalesce(satisfies(value, rule), F.lit(False))
        unknown = None
    else:
        selector = by["metric"]
        chosen = metrics.get(_source_name(rule, selector), F.lit(None).cast("string")).cast("string")
        keys = [str(k) for k in by["values"]]
        test = F.lit(False)
        for key, threshold in by["values"].items():
            own = {k: v for k, v in rule.items() if k != "value_by"} | {"value": threshold}
            test = F.when(chosen == str(key), F.coalesce(satisfies(value, own), F.lit(False))).otherwise(test)
        policy = by.get("unknown", "not_evaluated")
        code = rule.get("unknown_code", f"{selector.upper()}_{'IGNORED' if policy == 'ignore' else 'UNKNOWN'}")
        if required:
            effect = {"warning": say("warning", code), "fail": say("fail", code), "ignore": say("note", code), "not_evaluated": say("missing", code)}[policy]
        else:
            effect = {"warning": say("warning", code), "ignore": say("note", code)}.get(policy, nothing)
        unknown = (F.coalesce(~chosen.isin(*keys), F.lit(True)), effect)
    if required:
        out = F.when(~test, say("fail", rule.get("code", f"{name.upper()}_FAILED"))).otherwise(nothing)
        missing = say("missing", f"MISSING_METRIC:{name}")
    else:
        out = F.when(test, say("warning", rule.get("code", f"{name.upper()}_WARNING"))).otherwise(nothing)
        missing = nothing
    if unknown is not None:
        out = F.when(unknown[0], unknown[1]).otherwise(out)
    return F.when(value.isNull(), missing).otherwise(out)


def _source_name(rule: Mapping, metric: str) -> str:
    stage = (rule.get("source") or {}).get("qc_stage")
    return f"{stage}/{metric}" if stage else metric


def evaluate(entities: DataFrame, profile: Mapping, metrics: Mapping[str, Column]) -> DataFrame:
    """Add decision and reason_codes (in rule order) by a profile of required rules and warnings.

    ``metrics``: columns of metric values by name, or ``stage/name`` for rules that
    read one stage. A failed required rule gives FAIL, else a missing required metric
    NOT_EVALUATED, else a warning PASS_WITH_WARNINGS, else PASS.
    """
    results = [_outcome(r, metrics, True) for r in profile.get("required", [])] + [_outcome(r, metrics, False) for r in profile.get("warnings", [])]
    out = entities.withColumn("__o", F.array_compact(F.array(*results)) if results else F.lit(None).cast("array<struct<kind:string,code:string>>"))
    has = lambda kind: F.exists("__o", lambda o: o["kind"] == kind)
    out = out.withColumn("decision", F.when(has("fail"), "FAIL").when(has("missing"), "NOT_EVALUATED").when(has("warning"), "PASS_WITH_WARNINGS").otherwise("PASS"))
    return out.withColumn("reason_codes", F.transform("__o", lambda o: o["code"])).drop("__o")


def decided_state(decision: Column, state: Column) -> Column:
    """State after a decision; states that a decision was already taken in stay."""
    moves = F.create_map(*[F.lit(x) for pair in DECISION_STATE.items() for x in pair])
    return F.when(state.isin(*DECIDED), state).otherwise(F.element_at(moves, decision))


def transition(state: Column, wanted: Column, allowed: Mapping[str, Sequence[str]], *, force: bool = False) -> Column:
    """The wanted state if the table allows the move, or an error."""
    if force:
        return wanted
    ok = reduce(lambda a, kv: a | ((state == kv[0]) & wanted.isin(*kv[1])), allowed.items(), state == wanted)
    return F.when(ok, wanted).otherwise(F.raise_error(F.concat(F.lit("not allowed: "), state, F.lit(" to "), wanted)).cast("string"))


def curate(decisions: DataFrame, keys: Sequence[str], sequence: str, overrides: DataFrame) -> DataFrame:
    """Current decisions with the newest override of each key (keys, curated_decision, sequence) as effective_decision."""
    now = current(decisions, keys, sequence)
    over = current(overrides, keys, sequence).select(*keys, F.col("curated_decision").alias("__c"))
    return now.join(over, list(keys), "left").withColumn("effective_decision", F.coalesce("__c", "decision")).drop("__c")


def best_order(best_by: Sequence[Mapping] | None, tie: str) -> list[Column]:
    """Sort columns of a source's preference: fields up or down, by rank tables with defaults, missing last, then ``tie``."""
    out = []
    for by in best_by or [{"field": "hit_rank"}]:
        value = F.col(by["field"])
        if "rank" in by:
            table = F.create_map(*[F.lit(x) for k, v in by["rank"].items() for x in (str(k), float(v))])
            value = F.coalesce(F.try_element_at(table, value.cast("string")), F.lit(by.get("default")).cast("double"))
        elif "default" in by:
            value = F.coalesce(value, F.lit(by["default"]))
        out.append(value.desc_nulls_last() if by.get("direction") == "desc" else value.asc_nulls_last())
    return [*out, F.col(tie)]


def best_hits(hits: DataFrame, keys: Sequence[str], source: Mapping, *, tie: str = "alignment_id") -> DataFrame:
    """The best hit of each key among those that pass the source's filter."""
    return latest(hits.where(all_hold(source.get("filter", []))), keys, best_order(source.get("best_by"), tie))


def classify(sequences: DataFrame, keys: Sequence[str], sources: Mapping[str, DataFrame], rules: Sequence[Mapping]) -> DataFrame:
    """Label each sequence by the first rule that matches.

    ``sources``: best hits by name, one row per key. Rules: a default, a source that
    is absent, or conditions on a source's best hit. Sequences that none matches get
    no label. Adds label and rule (number of the rule, from 0).
    """
    out, fields = sequences, {}
    for name, hits in sources.items():
        rest = [c for c in hits.columns if c not in keys]
        out = out.join(hits.select(*keys, F.struct(F.lit(True).alias("__there"), *rest).alias(f"__{name}")), list(keys), "left")
        fields[name] = {c: F.col(f"__{name}.{c}") for c in rest}
    label, which = F.lit(None).cast("string"), F.lit(None).cast("int")
    for k, rule in reversed(list(enumerate(rules))):
        if rule.get("default"):
            test = F.lit(True)
        elif rule.get("absent"):
            test = F.col(f"__{rule['source']}").isNull()
        else:
            test = F.col(f"__{rule['source']}").isNotNull() & all_hold(rule["when"], fields[rule["source"]])
        label, which = F.when(test, rule["label"]).otherwise(label), F.when(test, k).otherwise(which)
    return out.select(*sequences.columns, label.alias("label"), which.alias("rule"))


def label_changes(old: DataFrame, new: DataFrame, keys: Sequence[str], value: str = "label") -> DataFrame:
    """(keys, change): written, removed or unchanged, comparing existing labels with assigned ones."""
    a, b = old.select(*keys, F.col(value).alias("__old")), new.select(*keys, F.col(value).alias("__new"))
    both = a.join(b, list(keys), "full")
    change = F.when(F.col("__new").isNull(), "removed").when(F.col("__old").eqNullSafe(F.col("__new")), "unchanged").otherwise("written")
    return both.where(F.col("__old").isNotNull() | F.col("__new").isNotNull()).select(*keys, change.alias("change"))


def validate_profile(profile: Mapping) -> None:
    """Raise ValueError if a classification profile isn't sound."""
    if profile.get("kind") != "sequence_classification":
        raise ValueError("kind must be sequence_classification")
    sources, rules = profile.get("sources") or {}, profile.get("rules") or []
    if not rules:
        raise ValueError("rules are missing")

    def check(c: Mapping) -> None:
        if "any" in c:
            for x in c["any"]:
                check(x)
        elif "not" in c:
            check(c["not"])
        elif "field" not in c:
            raise ValueError(f"a condition needs a field: {c}")
        elif c.get("operator", "==") not in (*ORDERED, "==", "!=", "in", "not_in", "between", "exists", "like"):
            raise ValueError(f"unknown operator: {c['operator']}")

    for k, rule in enumerate(rules):
        if "label" not in rule:
            raise ValueError("a rule needs a label")
        if rule.get("default"):
            if k != len(rules) - 1:
                raise ValueError("the default rule comes last")
        elif rule.get("source") not in sources:
            raise ValueError(f"unknown source: {rule.get('source')}")
        for c in rule.get("when", []):
            check(c)
    for source in sources.values():
        for c in source.get("filter", []):
            check(c)


