"""Response policy: objectives, a LinUCB contextual bandit, recommendations and offline evaluation.

Training is one aggregate: the normal matrix and reward vector of each action are sums over episodes,
so episodes can arrive in any order and combine on the map side.  Only the ten small systems are
solved in Python, one row per action.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from watchtide import fixed
from watchtide.functions.core import first_match, literal_map, lookup, round_plain

DIM = 3 + len(fixed.OBJECTIVES)


def objective_of(techniques: Column, risk: Column, catalog: dict | None = None) -> Column:
    """Most urgent objective among the techniques' tactics; without techniques by risk."""
    tactics = literal_map({t: tactic for t, (_, tactic) in (catalog or fixed.TECHNIQUE_CATALOG).items()})
    objectives = literal_map(fixed.TACTIC_OBJECTIVES)
    found = F.transform(techniques, lambda t: F.coalesce(
        F.try_element_at(objectives, F.coalesce(F.try_element_at(tactics, t), F.lit("?"))), F.lit("recon")))
    pairs = [(F.array_contains(found, o), F.lit(o)) for o in fixed.OBJECTIVE_PRIORITY]
    empty = F.coalesce(F.size(techniques) <= 0, F.lit(True))
    return F.when(empty, F.when(F.coalesce(risk, F.lit(0.0)) < 0.3, F.lit("benign")).otherwise(F.lit("recon"))).otherwise(
        first_match(pairs, F.lit("recon")))


def resolve_objective(text: Column, risk: Column) -> Column:
    """Playbook objective for free text: exact name, else first needle found, else by risk."""
    raw = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), " ", "_")
    pairs = [(raw.isin(fixed.OBJECTIVES), raw)]
    pairs += [(F.contains(raw, F.lit(needle)), F.lit(o)) for needle, o in fixed.OBJECTIVE_NEEDLES]
    return first_match(pairs, F.when(risk < 0.3, F.lit("benign")).otherwise(F.lit("recon")))


def context(risk: Column, criticality: Column, objective: Column) -> list[Column]:
    """Bias, risk, criticality and one-hot objective."""
    hot = [F.when(objective == o, F.lit(1.0)).otherwise(F.lit(0.0)) for o in fixed.OBJECTIVES]
    return [F.lit(1.0), risk.cast("double"), criticality.cast("double"), *hot]


def context_vector(risk: Column, criticality: Column, objective: Column) -> Column:
    return F.array(*context(risk, criticality, objective))


def fit(episodes: DataFrame) -> DataFrame:
    """Per action: pulls, xtx (upper triangle, row by row) and xr.  Unknown actions are skipped."""
    x = context(F.col("risk_score"), F.col("asset_criticality"), F.col("objective"))
    rows = episodes.where(F.col("action_class").isin(fixed.ACTIONS)).select(
        "action_class", "reward", *[c.alias(f"x{i}") for i, c in enumerate(x)])
    xtx = [F.sum(F.col(f"x{i}") * F.col(f"x{j}")) for i in range(DIM) for j in range(i, DIM)]
    xr = [F.sum(F.col("reward") * F.col(f"x{i}")) for i in range(DIM)]
    return rows.groupBy("action_class").agg(
        F.count("*").alias("pulls"), F.array(*xtx).alias("xtx"), F.array(*xr).alias("xr"))


def merge_fits(*fits: DataFrame) -> DataFrame:
    """Add fits together: warm start plus later outcomes."""
    out = fits[0]
    for f in fits[1:]:
        out = out.unionByName(f)
    n = DIM * (DIM + 1) // 2
    return out.groupBy("action_class").agg(
        F.sum("pulls").alias("pulls"),
        F.array(*[F.sum(F.element_at("xtx", i + 1)) for i in range(n)]).alias("xtx"),
        F.array(*[F.sum(F.element_at("xr", i + 1)) for i in range(DIM)]).alias("xr"))


def fit_cells(fit_: DataFrame) -> DataFrame:
    """Fit as (action, i, j, value) rows; j is -1 for the reward vector."""
    index = [(i, j) for i in range(DIM) for j in range(i, DIM)]
    a = F.arrays_zip(F.lit([i for i, _ in index]).alias("i"), F.lit([j for _, j in index]).alias("j"), F.col("xtx").alias("value"))
    b = F.arrays_zip(F.lit(list(range(DIM))).alias("i"), F.lit([-1] * DIM).alias("j"), F.col("xr").alias("value"))
    return fit_.select("action_class", F.inline(F.concat(a, b)))


def _solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    upper = np.triu_indices(DIM)
    for pdf in batches:
        theta, inverse = [], []
        for xtx, xr in zip(pdf["xtx"], pdf["xr"]):
            a = np.zeros((DIM, DIM))
            a[upper] = np.asarray(xtx, dtype=float)
            a = a + a.T - np.diag(np.diag(a)) + np.eye(DIM)
            inv = np.linalg.inv(a)
            inverse.append(inv.ravel().tolist())
            theta.append((inv @ np.asarray(xr, dtype=float)).tolist())
        yield pd.DataFrame({"action_class": pdf["action_class"], "pulls": pdf["pulls"], "theta": theta, "inverse": inverse})


def arms(spark: SparkSession, fit_: DataFrame) -> DataFrame:
    """One solved row per known action; actions never pulled keep the identity matrix."""
    n = DIM * (DIM + 1) // 2
    blank = spark.createDataFrame([(a,) for a in fixed.ACTIONS], "action_class string").select(
        "action_class", F.lit(0).cast("long").alias("pulls"), F.array_repeat(F.lit(0.0), n).alias("xtx"),
        F.array_repeat(F.lit(0.0), DIM).alias("xr"))
    return merge_fits(blank, fit_).mapInPandas(
        _solve, "action_class string, pulls long, theta array<double>, inverse array<double>")


def allowed_table(spark: SparkSession) -> DataFrame:
    rows = [(o, a, i) for o, _, _, _, _, allowed in fixed.PLAYBOOKS for i, a in enumerate(allowed)]
    return spark.createDataFrame(rows, "objective string, action_class string, position int")


def playbooks(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(
        [(o, p, a, t, s, allowed, a in fixed.DISRUPTIVE_ACTIONS) for o, p, a, t, s, allowed in fixed.PLAYBOOKS],
        "objective string, playbook_id string, action_class string, title string, risk_if_executed string, "
        "allowed array<string>, disruptive boolean")


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)


def score_arms(rows: DataFrame, solved: DataFrame, explore: Column, alpha: float = fixed.LINUCB_ALPHA) -> DataFrame:
    """Add ``scores`` (action, score) over the allowed actions of each row's objective.

    The allowed actions of an objective (three at most) are folded into one array and joined on the
    objective, so a row is scored in place.
    """
    spark = rows.sparkSession
    table = allowed_table(spark).join(solved, "action_class").groupBy(F.col("objective").alias("_o")).agg(
        F.array_sort(F.collect_list(F.struct("position", "action_class", "theta", "inverse"))).alias("_arms"))
    x = context_vector(F.col("risk_score"), F.col("asset_criticality"), F.col("objective"))
    out = rows.withColumn("_x", x).withColumn("_explore", explore).join(table, F.col("objective") == F.col("_o"), "left")

    def one(a: Column) -> Column:
        mean = _dot(a["theta"], F.col("_x"))
        spread = F.aggregate(F.transform(F.sequence(F.lit(0), F.lit(DIM - 1)), lambda i: F.element_at(F.col("_x"), i + 1) * _dot(
            F.slice(a["inverse"], i * DIM + 1, F.lit(DIM)), F.col("_x"))), F.lit(0.0), lambda s, v: s + v)
        bonus = F.when(F.col("_explore"), alpha * F.sqrt(spread)).otherwise(F.lit(0.0))
        return F.struct(a["action_class"].alias("action_class"), (mean + bonus).alias("score"), a["position"].alias("position"))

    return out.withColumn("scores", F.transform("_arms", one)).drop("_arms", "_o", "_x", "_explore")


def best_arm(scores: Column) -> Column:
    """Highest score; the first action listed wins a tie."""
    top = F.array_max(F.transform(scores, lambda s: F.struct(
        s["score"].alias("score"), (-s["position"]).alias("order"), s["action_class"].alias("action_class"))))
    return top["action_class"]


def recommend(cases: DataFrame, solved: DataFrame) -> DataFrame:
    """Action recommendation per case (case_id, risk_score, asset_criticality, likely_objective)."""
    risk = F.col("risk_score")
    rows = cases.withColumn("objective", resolve_objective(F.col("likely_objective"), risk))
    middle = (risk >= 0.25) & (risk < 0.55)
    rows = score_arms(rows, solved, middle)
    book = playbooks(cases.sparkSession).select(
        F.col("objective").alias("_o"), "playbook_id", F.col("action_class").alias("_primary"), F.col("title").alias("_title"), "risk_if_executed")
    out = rows.join(book, F.col("objective") == F.col("_o"), "left").drop("_o")
    action = F.when(risk < 0.25, F.lit("ignore")).when(risk >= 0.55, F.col("_primary")).otherwise(best_arm(F.col("scores")))
    out = out.withColumn("action_class", action).withColumn("disruptive", F.col("action_class").isin(fixed.DISRUPTIVE_ACTIONS))
    return out.select(
        "case_id", "risk_score", "asset_criticality", "likely_objective", "objective", "action_class", "disruptive", "playbook_id",
        F.when(F.col("action_class") == F.col("_primary"), F.col("_title")).otherwise(
            F.initcap(F.regexp_replace("action_class", "_", " "))).alias("title"),
        "risk_if_executed", F.lit(True).alias("dry_run_default"),
        round_plain(F.least(0.5 + 0.5 * risk, F.lit(0.99)), 3).alias("confidence"),
        F.when(F.col("disruptive"), F.lit("pending")).otherwise(F.lit("auto_applied_dry_run")).alias("status"), "scores")


def record_outcomes(outcomes: DataFrame, fit_: DataFrame) -> DataFrame:
    """Fold observed rewards into a fit."""
    return merge_fits(fit_, fit(outcomes))


def outcome_status(outcomes: DataFrame) -> DataFrame:
    return outcomes.withColumn("status", F.when(F.col("reward") > 0, F.lit("approved")).otherwise(F.lit("rejected")))


def choose(episodes: DataFrame, solved: DataFrame) -> DataFrame:
    """Greedy choice per logged episode."""
    return score_arms(episodes, solved, F.lit(False)).withColumn("chosen", best_arm(F.col("scores"))).drop("scores")


def evaluate_offline(chosen: DataFrame) -> DataFrame:
    """How often the policy agrees with the log and what those episodes earned."""
    same = F.col("chosen") == F.col("action_class")
    return chosen.agg(
        F.count("*").alias("episodes"), F.round(F.count_if(same) / F.count("*"), 3).alias("match_rate"),
        F.round(F.avg(F.when(same, F.col("reward"))), 3).alias("avg_reward_when_policy_matches_log"),
        F.round(F.avg("reward"), 3).alias("avg_reward_baseline_all_logged"))


def action_distribution(chosen: DataFrame) -> DataFrame:
    return chosen.groupBy("chosen").agg(F.count("*").alias("episodes"))


def list_recommendations(actions: DataFrame, case_id: str | None = None, status: str | None = None) -> DataFrame:
    out = actions
    if case_id:
        out = out.where(F.col("case_id") == case_id)
    if status:
        out = out.where(F.col("status") == status)
    return out.orderBy(F.col("created_us").desc(), "case_id")


def policy_state(spark: SparkSession, fit_: DataFrame) -> DataFrame:
    """Pulls per action, zero for actions never tried."""
    known = spark.createDataFrame([(a,) for a in fixed.ACTIONS], "action_class string")
    return known.join(fit_.select("action_class", "pulls"), "action_class", "left").fillna(0, ["pulls"])


def tactic_of(technique: Column) -> Column:
    return lookup({t: tactic for t, (_, tactic) in fixed.TECHNIQUE_CATALOG.items()}, technique)
