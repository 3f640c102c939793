"""Grounding: which claims of a report rest on evidence that exists."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from watchtide.functions.text import citations, sentences


def sentence_verdicts(reports: DataFrame, valid: DataFrame, key: str = "case_id") -> DataFrame:
    """One row per sentence: grounded, unresolvable or uncited.

    ``reports``: key, summary.  ``valid``: key, evidence_id - one row per existing item.  Citations are
    matched by an equi-join, so neither table is gathered.
    """
    rows = reports.select(key, F.posexplode(sentences(F.col("summary"))).alias("pos", "sentence"))
    cited = rows.select(key, "pos", "sentence", F.explode_outer(citations(F.col("sentence"))).alias("cite"))
    known = valid.select(key, F.col("evidence_id").alias("cite"), F.lit(True).alias("ok")).distinct()
    out = cited.join(known, [key, "cite"], "left").groupBy(key, "pos", "sentence").agg(
        F.count("cite").alias("cites"), F.count("ok").alias("valid_cites"))
    return out.withColumn("verdict", F.when(F.col("valid_cites") > 0, F.lit("grounded")).when(
        F.col("cites") > 0, F.lit("unresolvable")).otherwise(F.lit("uncited")))


def groundedness(verdicts: DataFrame, key: str = "case_id") -> DataFrame:
    """Share of grounded sentences per report."""
    return verdicts.groupBy(key).agg(
        F.count("*").alias("sentences"), F.count_if(F.col("verdict") == "grounded").alias("grounded"),
        F.round(F.count_if(F.col("verdict") == "grounded") / F.count("*"), 3).alias("groundedness_score"))


def unsupported_claims(verdicts: DataFrame, key: str = "case_id") -> DataFrame:
    lead = F.when(F.col("verdict") == "unresolvable", F.lit("Unresolvable citation removed from: ")).otherwise(F.lit("Uncited claim flagged: "))
    return verdicts.where("verdict <> 'grounded'").select(key, "pos", F.concat(lead, F.col("sentence")).alias("claim"))


def check_mapping(reports: DataFrame, valid: DataFrame, key: str = "case_id") -> tuple[DataFrame, DataFrame]:
    """(kept, dropped) technique mappings by whether their evidence exists."""
    rows = reports.select(key, F.inline("attack_mapping"))
    known = valid.select(key, "evidence_id").distinct()
    return rows.join(known, [key, "evidence_id"], "left_semi"), rows.join(known, [key, "evidence_id"], "left_anti")


def cited_evidence(reports: DataFrame, valid: DataFrame, key: str = "case_id") -> DataFrame:
    """Existing evidence ids a report cites, in its texts or its mapping."""
    texts = F.concat_ws(" ", *[c for c in ("summary", "containment_recommendation", "confidence_explanation") if c in reports.columns])
    cites = reports.select(key, F.explode(citations(texts)).alias("evidence_id"))
    if "attack_mapping" in reports.columns:
        cites = cites.unionByName(reports.select(key, F.explode(F.transform("attack_mapping", lambda m: m["evidence_id"])).alias("evidence_id")))
    return cites.distinct().join(valid.select(key, "evidence_id").distinct(), [key, "evidence_id"], "left_semi")


def validate_reports(reports: DataFrame, valid: DataFrame, key: str = "case_id") -> DataFrame:
    """Reports with dropped mappings removed, their score, cited ids and unsupported claims.

    Claims that a report already lists as unsupported stay, before those found here; its other results are replaced.
    Lists here are per report and bounded by the report's own text.
    """
    own = reports.select(key, F.posexplode("unsupported_claims").alias("pos", "claim")).withColumn(
        "pos", F.col("pos") - (1 << 30)) if "unsupported_claims" in reports.columns else None
    reports = reports.drop("unsupported_claims", "groundedness_score", "evidence_cited")
    verdicts = sentence_verdicts(reports, valid, key)
    kept, dropped = check_mapping(reports, valid, key)
    lost = dropped.select(key, F.lit(1 << 30).alias("pos"), F.concat(
        F.lit("Dropped technique mapping "), F.col("technique_id"), F.lit(" (no valid evidence citation)")).alias("claim"))
    found = unsupported_claims(verdicts, key).unionByName(lost)
    if own is not None:
        first = own.groupBy(key, "claim").agg(F.min("pos").alias("pos"))
        found = first.unionByName(found.join(first, [key, "claim"], "left_anti"))
    claims = found.groupBy(key).agg(F.transform(
        F.array_sort(F.collect_list(F.struct("pos", "claim"))), lambda x: x["claim"]).alias("unsupported_claims"))
    cited = cited_evidence(reports, valid, key).groupBy(key).agg(F.array_sort(F.collect_set("evidence_id")).alias("evidence_cited"))
    mapped = kept.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("technique_id", "evidence_id"))).alias("attack_mapping"))
    none = F.array().cast("array<string>")
    out = reports.drop("attack_mapping").join(groundedness(verdicts, key).select(key, "groundedness_score"), key, "left")
    out = out.join(claims, key, "left").join(cited, key, "left").join(mapped, key, "left")
    return (out.withColumn("groundedness_score", F.coalesce("groundedness_score", F.lit(0.0)))
            .withColumn("unsupported_claims", F.coalesce("unsupported_claims", none))
            .withColumn("evidence_cited", F.coalesce("evidence_cited", none)))


def assemble_reports(validated: DataFrame, links: DataFrame, model_id: str = "template-v1") -> DataFrame:
    """Triage reports with the number of alerts they cover; alert ids stay in the link table."""
    counts = links.groupBy("case_id").agg(F.count_distinct("alert_id").alias("alerts"))
    return validated.join(counts, "case_id", "left").fillna(0, ["alerts"]).withColumn("model_id", F.lit(model_id))


def score_reports(reports: DataFrame) -> DataFrame:
    """Quality of exported reports.

    ``reports``: report_id, scenario_id, evidence_cited, unsupported_claims, predicted (technique ids),
    expected (technique ids), pool (evidence ids that exist), self_reported.
    """
    cited, pool = F.col("evidence_cited"), F.col("pool")
    ok = F.size(F.filter(cited, lambda c: F.array_contains(pool, c)))
    n = F.size(cited)
    claims = n + F.size("unsupported_claims")
    validity = F.when(n > 0, ok / n).otherwise(F.lit(1.0))
    support = F.when(claims > 0, n / claims).otherwise(F.lit(1.0))
    predicted = F.array_distinct("predicted")
    expected = F.array_distinct("expected")
    tp = F.size(F.array_intersect(predicted, expected))
    has = F.size(expected) > 0
    precision = F.when(has, F.when(F.size(predicted) > 0, tp / F.size(predicted)).otherwise(F.lit(0.0)))
    recall = F.when(has, tp / F.size(expected))
    computed = F.round((validity + support) / 2, 3)
    return reports.select(
        "report_id", "scenario_id", n.alias("evidence_cited"),
        F.filter(cited, lambda c: ~F.array_contains(pool, c)).alias("hallucinated_citations"),
        F.round(validity, 3).alias("evidence_validity_rate"), F.size("unsupported_claims").alias("unsupported_claims"),
        F.round(support, 3).alias("claim_support_ratio"), F.round(precision, 3).alias("mapping_precision"),
        F.round(recall, 3).alias("mapping_recall"), F.col("self_reported").alias("self_reported_groundedness"),
        computed.alias("computed_groundedness"), F.round(F.col("self_reported") - computed, 3).alias("groundedness_delta"))


def report_means(scored: DataFrame) -> DataFrame:
    return scored.agg(
        F.count("*").alias("reports"), F.round(F.avg("evidence_validity_rate"), 3).alias("evidence_validity_rate"),
        F.round(F.avg("claim_support_ratio"), 3).alias("claim_support_ratio"),
        F.round(F.avg("mapping_precision"), 3).alias("mapping_precision"), F.round(F.avg("mapping_recall"), 3).alias("mapping_recall"),
        F.count_if(F.size("hallucinated_citations") > 0).alias("hallucinating_reports"))
