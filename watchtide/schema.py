"""Schemas of the tables that flow between stages."""

from pyspark.sql import Column, functions as F, types as T

from watchtide import fixed

ENVELOPE = T.StructType([
    T.StructField("event_id", T.StringType()),
    T.StructField("tenant_id", T.StringType()),
    T.StructField("source", T.StringType()),
    T.StructField("timestamp", T.StringType()),
    T.StructField("received_at", T.TimestampType()),
    T.StructField("payload", T.StringType()),
])

ENTITY = T.StructType([
    T.StructField("type", T.StringType()),
    T.StructField("id", T.StringType()),
    T.StructField("display_name", T.StringType()),
    T.StructField("attributes", T.MapType(T.StringType(), T.StringType())),
])

# name -> SQL type of the scalar canonical columns the parsers fill
CANONICAL = {
    "event_type": "string", "severity": "string", "host": "string", "user": "string",
    "process": "string", "process_id": "int", "parent_process": "string", "parent_process_id": "int",
    "command_line": "string", "file_path": "string", "file_hash": "string", "src_ip": "string",
    "dst_ip": "string", "src_port": "int", "dst_port": "int", "domain": "string", "url": "string",
    "email_from": "string", "email_to": "string", "email_subject": "string", "cloud_account": "string",
    "cloud_resource": "string", "k8s_namespace": "string", "k8s_pod": "string", "registry_key": "string",
    "technique_ids": "array<string>", "tags": "array<string>",
}

INDICATOR = T.StructType([
    T.StructField("indicator_id", T.StringType()),
    T.StructField("type", T.StringType()),
    T.StructField("value", T.StringType()),
    T.StructField("malware_family", T.StringType()),
    T.StructField("confidence", T.DoubleType()),
    T.StructField("tags", T.ArrayType(T.StringType())),
    T.StructField("first_seen", T.StringType()),
    T.StructField("last_seen", T.StringType()),
    T.StructField("related_case_ref", T.StringType()),
    T.StructField("source", T.StringType()),
])
IOC_FEED = T.StructType([
    T.StructField("tenant_id", T.StringType()),
    T.StructField("feed_name", T.StringType()),
    T.StructField("generated_at", T.StringType()),
    T.StructField("indicators", T.ArrayType(INDICATOR)),
])
VULNERABILITY = T.StructType([
    T.StructField("cve_id", T.StringType()),
    T.StructField("vendor_project", T.StringType()),
    T.StructField("product", T.StringType()),
    T.StructField("date_added", T.StringType()),
    T.StructField("due_date", T.StringType()),
    T.StructField("known_ransomware_use", T.BooleanType()),
    T.StructField("cvss_v3", T.DoubleType()),
])
KEV_FEED = T.StructType([
    T.StructField("catalog_version", T.StringType()),
    T.StructField("vulnerabilities", T.ArrayType(VULNERABILITY)),
])
ASSET = T.MapType(T.StringType(), T.StructType([
    T.StructField("criticality", T.DoubleType()),
    T.StructField("role", T.StringType()),
    T.StructField("environment", T.StringType()),
    T.StructField("title", T.StringType()),
    T.StructField("department", T.StringType()),
]))
INVENTORY = T.StructType([
    T.StructField("hosts", ASSET),
    T.StructField("users", ASSET),
    T.StructField("default_host_criticality", T.DoubleType()),
    T.StructField("default_user_criticality", T.DoubleType()),
])
EPISODE = T.StructType([
    T.StructField("risk_score", T.DoubleType()),
    T.StructField("asset_criticality", T.DoubleType()),
    T.StructField("objective", T.StringType()),
    T.StructField("action_class", T.StringType()),
    T.StructField("reward", T.DoubleType()),
])
# raw and event stay JSON text, because their shape depends on the source
SCENARIO = T.StructType([
    T.StructField("scenario_id", T.StringType()),
    T.StructField("title", T.StringType()),
    T.StructField("name", T.StringType()),
    T.StructField("description", T.StringType()),
    T.StructField("expected_outcome", T.StringType()),
    T.StructField("expected_severity", T.StringType()),
    T.StructField("expected_techniques", T.ArrayType(T.StringType())),
    T.StructField("expected_min_risk", T.DoubleType()),
    T.StructField("expected_max_risk", T.DoubleType()),
    T.StructField("is_attack", T.BooleanType()),
    T.StructField("events", T.ArrayType(T.StructType([
        T.StructField("source", T.StringType()),
        T.StructField("timestamp", T.StringType()),
        T.StructField("raw", T.StringType()),
    ]))),
])
RAW_LINE = T.StructType([
    T.StructField("source", T.StringType()),
    T.StructField("timestamp", T.StringType()),
    T.StructField("tenant_id", T.StringType()),
    T.StructField("event", T.StringType()),
    T.StructField("raw", T.StringType()),
])
REPORT_FILE = T.StructType([
    T.StructField("scenario_id", T.StringType()),
    T.StructField("evidence_pool", T.MapType(T.StringType(), T.StringType())),
    T.StructField("report", T.StructType([
        T.StructField("report_id", T.StringType()),
        T.StructField("summary", T.StringType()),
        T.StructField("attack_mapping", T.ArrayType(T.StructType([
            T.StructField("technique_id", T.StringType()),
            T.StructField("evidence_id", T.StringType()),
        ]))),
        T.StructField("evidence_cited", T.ArrayType(T.StringType())),
        T.StructField("unsupported_claims", T.ArrayType(T.StringType())),
        T.StructField("groundedness_score", T.DoubleType()),
    ])),
])


def severity_rank(severity: Column) -> Column:
    """Ordinal of a severity name, null for names outside the domain."""
    pos = F.array_position(F.array(*[F.lit(s) for s in fixed.SEVERITIES]), severity)
    return F.when(pos > 0, (pos - 1).cast("int"))


def severity_name(rank: Column) -> Column:
    return F.try_element_at(F.array(*[F.lit(s) for s in fixed.SEVERITIES]), (rank + 1).cast("int"))


def node_type_ok(c: Column) -> Column:
    return c.isin(fixed.NODE_TYPES)


def edge_type_ok(c: Column) -> Column:
    return c.isin(fixed.EDGE_TYPES)
