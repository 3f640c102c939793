"""Detection evaluation: rule runs against ground truth, threshold metrics, curves and workflow metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from watchtide.functions.core import one_row
from watchtide.operators.windows import next_in_time


def fired(gated: DataFrame, group: str) -> DataFrame:
    """Per scenario: fired techniques and rules (both bounded by the rule set)."""
    hits = gated.select(group, F.explode("matches").alias("m"))
    tech = hits.select(group, F.explode("m.technique_ids").alias("t")).groupBy(group).agg(F.array_sort(F.collect_set("t")).alias("detected"))
    rules = hits.groupBy(group).agg(F.array_sort(F.collect_set("m.rule_id")).alias("rules"), F.count("*").alias("hits"))
    return rules.join(tech, group, "left")


def rule_hits(gated: DataFrame) -> DataFrame:
    return gated.select(F.explode("matches.rule_id").alias("rule_id")).groupBy("rule_id").agg(F.count("*").alias("hits"))


def set_scores(predicted: Column, expected: Column) -> Column:
    """Struct (precision, recall, f1) of two sets; both empty scores 1."""
    p, e = F.array_distinct(predicted), F.array_distinct(expected)
    tp, np_, ne = F.size(F.array_intersect(p, e)), F.size(p), F.size(e)
    both_empty = (np_ == 0) & (ne == 0)
    precision = F.when(both_empty, 1.0).when(np_ > 0, tp / np_).otherwise(0.0)
    recall = F.when(both_empty, 1.0).when(ne > 0, tp / ne).otherwise(0.0)
    f1 = F.when(both_empty, 1.0).when(tp > 0, 2.0 * tp / (np_ + ne)).otherwise(0.0)
    return F.struct(precision.alias("precision"), recall.alias("recall"), f1.alias("f1"))


def scenario_scores(labels: DataFrame, fired_: DataFrame, group: str = "scenario_id") -> DataFrame:
    """``labels``: group, expected techniques, is_attack.  Adds scores and a note."""
    none = F.array().cast("array<string>")
    out = labels.join(fired_, group, "left").withColumn("detected", F.coalesce("detected", none)).withColumn("hits", F.coalesce("hits", F.lit(0)))
    note = F.when(F.col("is_attack") & (F.col("hits") == 0), F.lit("missed attack")).when(
        ~F.col("is_attack") & (F.col("hits") > 0), F.lit("benign scenario fired rules")).otherwise(F.lit(""))
    return out.withColumn("s", set_scores(F.col("detected"), F.coalesce("expected", none))).select(
        group, "is_attack", "hits", "s.precision", "s.recall", "s.f1", note.alias("note"))


def macro_average(scores: DataFrame) -> DataFrame:
    return scores.agg(*[F.round(F.avg(c), 4).alias(c) for c in ("precision", "recall", "f1")], F.count("*").alias("scenarios"),
                      F.count_if(F.col("note") == "missed attack").alias("missed"))


def benign_hit_rate(gated: DataFrame) -> DataFrame:
    """Rule hits over a benign corpus: total, events, and hits per event."""
    return gated.agg(F.sum(F.size("matches")).alias("hits"), F.count("*").alias("events")).withColumn(
        "hits_per_event", F.round(F.col("hits") / F.greatest("events", F.lit(1)), 4))


def threshold_metrics(scored: DataFrame, thresholds: list[float], score: str = "score", label: str = "label") -> DataFrame:
    """Precision, recall, F1 and false positive rate at each threshold; label is 0/1."""
    aggs = []
    for i, th in enumerate(thresholds):
        hit = F.col(score) >= th
        aggs += [F.count_if(hit & (F.col(label) == 1)).alias(f"tp{i}"), F.count_if(hit & (F.col(label) == 0)).alias(f"fp{i}")]
    one = scored.agg(F.count_if(F.col(label) == 1).alias("pos"), F.count_if(F.col(label) == 0).alias("neg"), *aggs)
    rows = one.select("pos", "neg", F.inline(F.array(*[F.struct(F.lit(th).alias("threshold"), F.col(f"tp{i}").alias("tp"), F.col(f"fp{i}").alias("fp"))
                                                       for i, th in enumerate(thresholds)])))
    precision = F.when(F.col("tp") + F.col("fp") > 0, F.col("tp") / (F.col("tp") + F.col("fp"))).otherwise(0.0)
    recall = F.when(F.col("pos") > 0, F.col("tp") / F.col("pos")).otherwise(0.0)
    f1 = F.when(F.col("tp") > 0, 2.0 * F.col("tp") / (F.col("tp") + F.col("fp") + F.col("pos"))).otherwise(0.0)
    return rows.select("threshold", "tp", "fp", F.round(precision, 4).alias("precision"), F.round(recall, 4).alias("recall"),
                       F.round(f1, 4).alias("f1"), F.round(F.when(F.col("neg") > 0, F.col("fp") / F.col("neg")).otherwise(0.0), 4).alias("fpr"))


def curve_points(scored: DataFrame, score: str = "score", label: str = "label") -> DataFrame:
    """Cumulative true and false positives per distinct score, highest first.

    Counts run inside score ranges of a ten-thousandth and start from the sums of the ranges above, so
    the single ordered window sees one row per range.
    """
    by_score = scored.groupBy(F.col(score).alias("s")).agg(
        F.count_if(F.col(label) == 1).alias("p"), F.count_if(F.col(label) == 0).alias("n"))
    by_score = by_score.withColumn("_g", F.floor(F.col("s") * 10_000))
    above = Window.orderBy(F.col("_g").desc()).rowsBetween(Window.unboundedPreceding, -1)
    heads = by_score.groupBy("_g").agg(F.sum("p").alias("_p"), F.sum("n").alias("_n")).select(
        "_g", F.coalesce(F.sum("_p").over(above), F.lit(0)).alias("_p"), F.coalesce(F.sum("_n").over(above), F.lit(0)).alias("_n"))
    inside = Window.partitionBy("_g").orderBy(F.col("s").desc()).rowsBetween(Window.unboundedPreceding, 0)
    running = by_score.withColumn("tp", F.sum("p").over(inside)).withColumn("fp", F.sum("n").over(inside))
    heads = heads.withColumnRenamed("_g", "_h")
    return running.join(heads, F.col("_g").eqNullSafe(F.col("_h"))).select(
        "s", "p", "n", (F.col("tp") + F.col("_p")).alias("tp"), (F.col("fp") + F.col("_n")).alias("fp"))


def auc(scored: DataFrame, score: str = "score", label: str = "label") -> DataFrame:
    """ROC-AUC (trapezoid) and PR-AUC (average precision)."""
    pts = curve_points(scored, score, label)
    roc = (F.sum(F.col("n") * ((F.col("tp") - F.col("p")) + F.col("tp")) / 2.0)) / (F.sum("p") * F.sum("n"))
    ap = F.sum(F.col("p") * F.col("tp") / (F.col("tp") + F.col("fp"))) / F.sum("p")
    return pts.agg(F.round(roc, 4).alias("roc_auc"), F.round(ap, 4).alias("pr_auc"))


def top_k_utility(scored: DataFrame, k: int, score: str = "score", label: str = "label", key: str = "alert_id") -> DataFrame:
    """Share of all true positives found among the k highest scores."""
    top = scored.orderBy(F.col(score).desc(), key).limit(k).agg(F.count_if(F.col(label) == 1).alias("found"))
    total = scored.agg(F.count_if(F.col(label) == 1).alias("positives"))
    return one_row(top, total).withColumn("utility", F.round(F.col("found") / F.greatest("positives", F.lit(1)), 4))


def next_step_accuracy(events: DataFrame, key: str, t: str, step: str, order: str, split: Column) -> DataFrame:
    """First-order next-step model: train where ``split`` is false, test where it is true."""
    pairs = next_in_time(events.withColumn("_test", split), [key], t, order, step, "next_step").where("next_step IS NOT NULL")
    counts = pairs.where(~F.col("_test")).groupBy(step, "next_step").agg(F.count("*").alias("n"))
    best = counts.groupBy(step).agg(F.max(F.struct("n", "next_step")).alias("m")).select(step, F.col("m.next_step").alias("predicted"))
    test = pairs.where("_test").groupBy(step, "next_step").agg(F.count("*").alias("n"))
    return test.join(best, step, "left").agg(
        F.sum("n").alias("steps"), F.coalesce(F.sum(F.when(F.col("next_step") == F.col("predicted"), F.col("n"))), F.lit(0)).alias("correct")
    ).withColumn("accuracy", F.round(F.col("correct") / F.col("steps"), 4))


def mean_seconds(rows: DataFrame, start: str, end: str, name: str) -> DataFrame:
    """Mean time between two microsecond columns (time to triage, alert to action)."""
    return rows.where(F.col(start).isNotNull() & F.col(end).isNotNull()).agg(
        F.count("*").alias("n"), F.round(F.avg((F.col(end) - F.col(start)) / 1e6), 3).alias(name))


def escalation_precision(cases: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Share of escalated cases a verdict later confirms."""
    confirmed = verdicts.groupBy("case_id").agg(F.max(F.col("verdict") == "true_positive").alias("ok"))
    return cases.where("escalated").join(confirmed, "case_id", "left").agg(
        F.count("*").alias("escalated"), F.count_if("ok").alias("confirmed")).withColumn(
        "precision", F.round(F.try_divide("confirmed", "escalated"), 4))


def dedup_quality(assigned: DataFrame, cluster: str, truth: str) -> DataFrame:
    """Pairwise precision and recall of a clustering, from group sizes; no pair is formed."""
    def pairs(c: str) -> Column:
        return F.sum(F.col(c).cast("decimal(38,0)") * (F.col(c) - 1) / 2)
    cell = assigned.groupBy(cluster, truth).agg(F.count("*").alias("n"))
    both = cell.agg(pairs("n").alias("joint_pairs"))
    same_cluster = cell.groupBy(cluster).agg(F.sum("n").alias("n")).agg(pairs("n").alias("clustered"))
    same_truth = cell.groupBy(truth).agg(F.sum("n").alias("n")).agg(pairs("n").alias("true_pairs"))
    out = one_row(both, same_cluster, same_truth)
    return out.select(
        F.col("joint_pairs").cast("long").alias("joint_pairs"), F.col("clustered").cast("long").alias("clustered"), F.col("true_pairs").cast("long").alias("true_pairs"),
        F.round(F.try_divide(F.col("joint_pairs").cast("double"), F.col("clustered").cast("double")), 4).alias("precision"),
        F.round(F.try_divide(F.col("joint_pairs").cast("double"), F.col("true_pairs").cast("double")), 4).alias("recall"))


REQUIRED = ["summary", "likely_objective", "containment_recommendation", "confidence_explanation"]


def report_quality(reports: DataFrame, required: list[str] = REQUIRED) -> DataFrame:
    """Mean groundedness, share of reports with unsupported claims, and completeness."""
    filled = sum([F.when(F.length(F.trim(c)) > 0, 1).otherwise(0) for c in required], F.lit(0))
    return reports.agg(
        F.count("*").alias("reports"), F.round(F.avg("groundedness_score"), 4).alias("groundedness"),
        F.round(F.avg(F.when(F.size("unsupported_claims") > 0, 1.0).otherwise(0.0)), 4).alias("hallucination_rate"),
        F.round(F.avg(filled / len(required)), 4).alias("completeness"))


def baseline_ladder(scored: DataFrame, label: str, rungs: dict[str, Column], threshold: float = 0.5) -> DataFrame:
    """Threshold metrics and AUC of several score columns, from simple to full."""
    out = None
    for name, col in rungs.items():
        one = scored.select(col.alias("score"), F.col(label).alias("label"))
        part = one_row(threshold_metrics(one, [threshold]), auc(one)).withColumn("rung", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return out


def expectation_check(scenarios: DataFrame, results: DataFrame) -> DataFrame:
    """Compare scenario labels with results (scenario_id, severity, risk)."""
    return scenarios.join(results, "scenario_id", "left").select(
        "scenario_id", F.coalesce(F.col("severity") == F.col("expected_severity"), F.lit(False)).alias("severity_ok"),
        (F.col("expected_min_risk").isNull() | F.coalesce(F.col("risk") >= F.col("expected_min_risk"), F.lit(False))).alias("floor_ok"),
        (F.col("expected_max_risk").isNull() | F.coalesce(F.col("risk") <= F.col("expected_max_risk"), F.lit(False))).alias("ceiling_ok"))
