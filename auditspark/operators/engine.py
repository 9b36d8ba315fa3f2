"""From claims to findings, gate runs and verdicts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .checks import CHECKS, with_decoded
from .rules import GATES, RULES, SEVERITIES, gates_table, known_gates, rules_table

VERDICTS = ("approve", "needs_human", "reject")


def severity_rank(col="severity"):
    return F.array_position(F.array(*map(F.lit, SEVERITIES)), F.col(col)).cast("int") - 1


def outcomes(claims: DataFrame, rules=RULES) -> DataFrame:
    """(claim_id, rule_id, ok, override, evidence): all rules of all claims, in one projection. Unknown checks are passed over."""
    each = [F.struct(F.lit(r.rule_id).alias("rule_id"), CHECKS[r.check](r.params).alias("o")) for r in rules if r.check in CHECKS]
    flat = with_decoded(claims).select(F.col("id").alias("claim_id"), F.explode(F.array(*each)).alias("r"))
    return flat.select("claim_id", "r.rule_id", "r.o.ok", "r.o.override", "r.o.evidence")


def findings(claims: DataFrame, gates=None, rules=RULES) -> DataFrame:
    """One row per claim and applicable rule, with its severity."""
    wanted = set(known_gates(gates)) if gates is not None else set(GATES)
    rules = [r for r in rules if r.gate in wanted]
    found = outcomes(claims, rules).filter(F.col("ok").isNotNull())
    joined = found.join(F.broadcast(rules_table(claims.sparkSession, rules).withColumnRenamed("severity", "default")), "rule_id")  # a row a rule
    severity = F.when(F.col("ok"), "ok").otherwise(F.coalesce("override", "default", F.lit("fail")))
    return joined.withColumn("severity", severity).withColumn("severity_rank", severity_rank()).select(
        "claim_id", "gate", "gate_order", "rule_id", "rule_order", "severity", "severity_rank", "title", "source", "evidence"
    )


def gate_runs(claim_ids: DataFrame, found: DataFrame, gates=None) -> DataFrame:
    """(claim_id, gate, gate_order, severity, n_findings, n_issues); a gate without findings is ok."""
    all_gates = gates_table(found.sparkSession).filter(F.col("gate").isin(known_gates(gates if gates is not None else GATES)))
    grid = claim_ids.select("claim_id").distinct().withColumn("g", F.explode(F.array(*[F.struct(F.lit(g).alias("gate"), F.lit(i + 1).alias("gate_order")) for i, g in enumerate(GATES)])))
    grid = grid.select("claim_id", "g.gate", "g.gate_order").join(F.broadcast(all_gates.select("gate")), "gate", "left_semi")
    worst = found.groupBy("claim_id", "gate").agg(F.max("severity_rank").alias("r"), F.count("*").alias("n"), F.count_if(F.col("severity") != "ok").alias("issues"))
    out = grid.join(worst, ["claim_id", "gate"], "left")
    name = F.element_at(F.array(*map(F.lit, SEVERITIES)), F.coalesce("r", F.lit(0)) + 1)
    return out.select("claim_id", "gate", "gate_order", name.alias("severity"), F.coalesce("n", F.lit(0)).alias("n_findings"), F.coalesce("issues", F.lit(0)).alias("n_issues"))


def verdicts(claim_ids: DataFrame, found: DataFrame) -> DataFrame:
    """(claim_id, verdict, rationale): the worst severity decides; the titles behind it, in order of gates and rules."""
    title = lambda kind: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("severity") == kind, F.struct("gate_order", "rule_order", "title")))), lambda x: x["title"]), "; ")
    each = found.groupBy("claim_id").agg(F.max("severity_rank").alias("r"), title("fail").alias("failed"), title("warn").alias("warned"))
    out = claim_ids.select("claim_id").distinct().join(each, "claim_id", "left").withColumn("r", F.coalesce("r", F.lit(0)))
    verdict = F.element_at(F.array(*map(F.lit, VERDICTS)), F.col("r") + 1)
    why = F.when(F.col("r") == 2, F.col("failed")).when(F.col("r") == 1, F.col("warned")).otherwise("")
    return out.select("claim_id", verdict.alias("verdict"), why.alias("rationale"))


def ranked(claims: DataFrame, gates=None, rules=RULES) -> tuple[DataFrame, list]:
    """(claim_id, r0, r1, ...) and the rules meant: each rule's rank of its severity in a claim, null where it doesn't apply.

    One row a row of claims, with no shuffle and without evidence: what roll-ups and plain findings are worked out from. Ranks
    are columns, not an array: functions of arrays are interpreted with all that they are made of, columns are compiled.
    """
    wanted, ranks = set(known_gates(gates)) if gates is not None else set(GATES), {x: i for i, x in enumerate(SEVERITIES)}
    kept = [(i, r) for i, r in enumerate(r for r in rules if r.gate in wanted) if r.check in CHECKS]
    each = [(CHECKS[r.check](r.params), F.lit(ranks[r.severity or "fail"])) for _, r in kept]
    if_bad = [F.coalesce(F.array_position(F.array(*map(F.lit, SEVERITIES)), o["override"]).cast("int") - 1, default) for o, default in each]
    flat = with_decoded(claims).select(F.col("id").alias("claim_id"), *[x.alias(f"{n}{i}") for i, (o, _) in enumerate(each) for n, x in (("ok", o["ok"]), ("bad", if_bad[i]))])
    return flat.select("claim_id", *[F.when(F.col(f"ok{i}"), 0).when(~F.col(f"ok{i}"), F.col(f"bad{i}")).alias(f"r{i}") for i in range(len(kept))]), kept


def plain_findings(claims: DataFrame, gates=None, rules=RULES) -> DataFrame:
    """As findings, without evidence, which is most of their work."""
    rows, kept = ranked(claims, gates, rules)
    about = F.array(*[F.struct(F.lit(r.gate).alias("gate"), F.lit(GATES.index(r.gate) + 1).alias("gate_order"), F.lit(r.rule_id).alias("rule_id"), F.lit(i).alias("rule_order"), F.lit(r.title).alias("title"), F.lit(r.source).alias("source")) for i, r in kept])
    each = F.array(*[F.when(F.col(f"r{i}").isNotNull(), F.struct(F.lit(i).alias("at"), F.col(f"r{i}").alias("rank"))) for i in range(len(kept))])
    flat = rows.select("claim_id", F.explode(each).alias("x")).filter("x is not null").select("claim_id", F.get(about, F.col("x.at")).alias("rule"), "x.rank")
    name = F.element_at(F.array(*map(F.lit, SEVERITIES)), F.col("rank") + 1)
    return flat.select("claim_id", "rule.gate", "rule.gate_order", "rule.rule_id", "rule.rule_order", name.alias("severity"), F.col("rank").alias("severity_rank"), "rule.title", "rule.source")


def _worst(ranks: list[Column]) -> Column:
    return F.greatest(F.lit(0), F.lit(0), *ranks)


def roll_up(claims: DataFrame, gates=None, rules=RULES) -> DataFrame:
    """As verdicts, within each row of claims."""
    rows, kept = ranked(claims, gates, rules)
    titles = lambda k: F.concat_ws("; ", *[F.when(F.col(f"r{i}") == k, F.lit(r.title)) for i, (_, r) in enumerate(kept)])
    worst = rows.withColumn("r", _worst([F.col(f"r{i}") for i in range(len(kept))]))
    why = F.when(F.col("r") == 2, titles(2)).when(F.col("r") == 1, titles(1)).otherwise("")
    return worst.select("claim_id", F.element_at(F.array(*map(F.lit, VERDICTS)), F.col("r") + 1).alias("verdict"), why.alias("rationale"))


def gate_roll_up(claims: DataFrame, gates=None, rules=RULES) -> DataFrame:
    """As gate_runs, within each row of claims: one row a gate."""
    rows, kept = ranked(claims, gates, rules)
    each = []
    for g in known_gates(gates if gates is not None else GATES):
        mine = [F.col(f"r{i}") for i, (_, r) in enumerate(kept) if r.gate == g]
        count = lambda of: sum((F.when(of(r), 1).otherwise(0) for r in mine), F.lit(0)).cast("long")
        each.append(F.struct(F.lit(g).alias("gate"), F.lit(GATES.index(g) + 1).alias("gate_order"), _worst(mine).alias("rank"), count(lambda r: r.isNotNull()).alias("n_findings"), count(lambda r: r > 0).alias("n_issues")))
    name = F.element_at(F.array(*map(F.lit, SEVERITIES)), F.col("g.rank") + 1)
    return rows.select("claim_id", F.explode(F.array(*each)).alias("g")).select("claim_id", "g.gate", "g.gate_order", name.alias("severity"), "g.n_findings", "g.n_issues")


def run(claims: DataFrame, gates=None, rules=RULES) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(findings, gate runs, verdicts) of all claims. Reuse a checkpoint or table of the findings where several are used."""
    found = findings(claims, gates, rules)
    ids = claims.select(F.col("id").alias("claim_id"))
    return found, gate_runs(ids, found, gates), verdicts(ids, found)


def judge_floor(verdict, proposed):
    """A proposed verdict may be stricter than the rules' verdict, never milder."""
    rank = lambda v: F.array_position(F.array(*map(F.lit, VERDICTS)), v)
    return F.when(rank(proposed) > rank(verdict), proposed).otherwise(verdict)
