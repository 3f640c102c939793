"""Normalize: one projection turns envelopes of every source into canonical events.

Each source is described by a dict of canonical field -> column over the parsed payload.  All
sources are resolved in the same pass as CASE branches per field, so the raw table is scanned once
and nothing is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from watchtide import fixed
from watchtide.functions.core import blank_to_null, chosen, lookup
from watchtide.operators.ingest import RAW_TOPIC, resolve_source
from watchtide.schema import CANONICAL


def field(*names: str, type: str = "string", of: str = "body") -> Column:
    """First present payload value among ``names``; dotted keys are literal, ``a/b`` descends."""
    def get(name: str) -> str:
        path = "$" + "".join(p if p.startswith("[") else f"[\"{p}\"]" for p in name.split("/"))
        value = f"try_variant_get({of}, '{path}', '{type}')"
        return f"nullif({value}, '')" if type == "string" else value
    return F.expr(f"coalesce({', '.join(get(n) for n in names)})")


def read_time(text: Column) -> Column:
    """UTC timestamp of a record's time text, null where no known format reads it; naive text is UTC."""
    bare = F.regexp_replace(text, r"^[A-Za-z]{3}, ", "")
    return F.coalesce(
        F.try_to_timestamp(text),
        F.try_to_timestamp(bare, F.lit("d MMM yyyy HH:mm:ss Z")),
        F.try_to_timestamp(bare, F.lit("d MMM yyyy HH:mm:ss z")),
        F.try_to_timestamp(text, F.lit("MM/dd/yyyy HH:mm:ss")),
    )


def parse_time(text: Column, fallback: Column) -> Column:
    """UTC timestamp; unreadable text takes the arrival time (counted by :func:`time_problems`)."""
    return F.coalesce(read_time(text), fallback)


def time_problems(envelopes: DataFrame) -> DataFrame:
    """Per resolved source: records, those without a time, and those whose time no format reads (``unreadable``)."""
    text = F.col("timestamp").cast("string")
    blank = F.coalesce(F.trim(text) == "", F.lit(True))
    return envelopes.groupBy(resolve_source(F.col("source")).alias("source")).agg(
        F.count("*").alias("records"), F.count_if(blank).alias("without_time"),
        F.count_if(~blank & read_time(text).isNull()).alias("unreadable"))


def account_name(user: Column) -> Column:
    """Lower-cased account without its domain prefix."""
    return F.lower(F.element_at(F.split(user, r"\\"), -1))


def tag_list(tag: Column) -> Column:
    return chosen((F.length(tag) > 0, tag))


def _coded_type(code: Column, names: dict, prefix: str) -> Column:
    code = F.coalesce(code, F.lit(0))
    return F.coalesce(lookup(names, code), F.concat(F.lit(prefix), code))


def parsers() -> dict[str, dict[str, Column]]:
    """Per source: canonical field -> column over the payload column ``body``."""
    code = field("EventID", type="int")
    sysmon_type = _coded_type(code, fixed.SYSMON_TYPES, "sysmon_event_")
    directory_type = _coded_type(code, fixed.DIRECTORY_TYPES, "ad_event_")
    is_dns = F.coalesce(field("log_type"), F.lit("conn")) == "dns"
    alert_level = F.coalesce(field("alert/severity", type="int"), F.lit(3))
    verdict = F.lower(field("verdict"))
    auth_failed = F.coalesce(field("spf") == "fail", F.lit(False)) | F.coalesce(
        field("dkim") == "fail", F.lit(False)) | F.coalesce(field("dmarc") == "fail", F.lit(False))
    bad_verdict = F.coalesce(verdict.isin("malicious", "phishing", "spam"), F.lit(False))
    not_clean = F.coalesce(verdict != "clean", F.lit(True))
    reputation = F.lower(field("reputation"))
    action = F.coalesce(field("action"), F.lit("allow"))
    verb_resource = F.trim(F.concat_ws(" ", field("verb"), field("resource", "objectRef/resource")))
    return {
        "sysmon": {
            "event_type": sysmon_type,
            "severity": F.when(sysmon_type.isin("process_access", "create_remote_thread"), F.lit("medium")),
            "host": field("Computer"), "user": account_name(field("User")), "process": field("Image"),
            "process_id": field("ProcessId", type="int"),
            "parent_process": field("ParentImage", "SourceImage"),
            "parent_process_id": field("ParentProcessId", "SourceProcessId", type="int"),
            "command_line": field("CommandLine"), "file_path": field("TargetFilename"),
            "file_hash": blank_to_null(F.coalesce(
                F.regexp_extract(field("Hashes"), r"(?i)SHA256=([^,]*)", 1), F.lit(""))),
            "registry_key": field("TargetObject"), "domain": field("QueryName", "DestinationHostname"),
            "dst_ip": field("DestinationIp"), "dst_port": field("DestinationPort", type="int"),
        },
        "zeek": {
            "event_type": F.concat(F.lit("zeek_"), F.coalesce(field("log_type"), F.lit("conn"))),
            "host": field("host"), "user": field("user"), "src_ip": field("id.orig_h"),
            "dst_ip": F.when(is_dns, field("answers/[0]", "id.resp_h")).otherwise(field("id.resp_h")),
            "src_port": F.when(~is_dns, field("id.orig_p", type="int")),
            "dst_port": F.when(~is_dns, field("id.resp_p", type="int")),
            "domain": F.when(is_dns, field("query")),
        },
        "suricata": {
            "event_type": F.lit("network_alert"),
            "severity": F.when(alert_level == 1, F.lit("high")).when(alert_level == 2, F.lit("medium")).otherwise(F.lit("low")),
            "host": field("host"), "src_ip": field("src_ip"), "dst_ip": field("dest_ip"),
            "dst_port": field("dest_port", type="int"), "tags": tag_list(field("alert/category")),
        },
        "active_directory": {
            "event_type": directory_type,
            "severity": F.when(directory_type == "logon_failure", F.lit("medium")),
            "host": field("Computer"), "user": account_name(field("TargetUserName", "SubjectUserName")),
            "src_ip": field("IpAddress"),
            "tags": tag_list(F.concat(F.lit("logon_type_"), field("LogonType"))),
        },
        "cloudtrail": {
            "event_type": F.lit("aws_api_call"), "user": field("user", "userIdentity/userName"),
            "src_ip": field("sourceIPAddress", "src_ip"),
            "cloud_account": field("cloud_account", "recipientAccountId"),
            "cloud_resource": field("cloud_resource", "eventSource"),
            "command_line": F.coalesce(field("command_line", "eventName", "event_type"), F.lit("aws_api_call")),
        },
        "email": {
            "event_type": F.coalesce(field("event_type"), F.lit("email_received")),
            "severity": F.when(bad_verdict | (auth_failed & not_clean), F.lit("medium")).otherwise(F.lit("low")),
            "host": field("host"),
            "user": F.coalesce(field("user"), F.element_at(F.split(field("to"), "@"), 1)),
            "email_from": field("from"), "email_to": field("to"), "email_subject": field("subject"),
            "url": field("url", "urls/[0]"), "file_hash": field("attachment_hash", "attachments/[0]/sha256"),
            "file_path": field("attachment_name", "attachments/[0]/filename"), "tags": tag_list(verdict),
        },
        "edr": {
            "event_type": F.lit("edr_process_event"),
            "severity": F.when(reputation == "malicious", F.lit("critical")).when(
                reputation.isin("suspicious", "suspicious_behavior"), F.lit("high")),
            "host": field("host"), "user": account_name(field("user")), "process": field("process_name"),
            "process_id": field("pid", type="int"), "parent_process": field("parent_process"),
            "parent_process_id": field("ppid", type="int"), "command_line": field("command_line"),
            "file_hash": field("sha256"), "dst_ip": field("network_connections/[0]/dst_ip"),
            "dst_port": field("network_connections/[0]/dst_port", type="int"),
            "technique_ids": field("mitre_techniques", type="array<string>"), "tags": tag_list(reputation),
        },
        "kubernetes": {
            "event_type": F.coalesce(field("event_type"), F.lit("k8s_audit")),
            "user": field("user/username", "user"),
            "k8s_namespace": field("k8s_namespace", "namespace", "objectRef/namespace"),
            "k8s_pod": field("k8s_pod", "pod", "objectRef/name"),
            "command_line": F.coalesce(field("command_line"), verb_resource),
            "src_ip": field("sourceIPs/[0]"),
        },
        "dns": {
            "event_type": F.lit("dns_query"), "host": field("host"), "src_ip": field("src_ip", "client_ip"),
            "domain": field("query"), "dst_ip": field("answer", "resolved_ip"),
            "tags": tag_list(field("response_code")),
        },
        "firewall": {
            "event_type": F.lit("firewall_connection"),
            "severity": F.when(action == "deny", F.lit("low")), "host": field("host"),
            "src_ip": field("src_ip"), "dst_ip": field("dst_ip"), "dst_port": field("dst_port", type="int"),
            "tags": tag_list(action),
        },
    }


def generic_parser() -> dict[str, Column]:
    """Sources without a shape of their own (windows, threat_intel, synthetic)."""
    return {
        "event_type": F.coalesce(field("event_type"), F.concat(F.col("source"), F.lit("_event"))),
        "host": field("host"), "user": field("user"), "src_ip": field("src_ip"), "dst_ip": field("dst_ip"),
    }


def _default(name: str) -> Column:
    if name == "severity":
        return F.lit("informational")
    if CANONICAL[name] == "array<string>":
        return F.array().cast("array<string>")
    return F.lit(None)


def normalize(envelopes: DataFrame) -> DataFrame:
    """Canonical events; rows that cannot be normalized carry a non-null ``error``."""
    src = F.col("source")
    known = parsers()
    generic = generic_parser()
    parsed = envelopes.withColumn("body", F.try_parse_json(F.coalesce("payload", F.lit("{}"))))
    base = parsed.select(
        "event_id", F.coalesce("tenant_id", F.lit("default")).alias("tenant_id"), resolve_source(src).alias("source"),
        parse_time(F.col("timestamp").cast("string"), F.col("received_at")).alias("ts"),
        "received_at", F.coalesce("payload", F.lit("{}")).alias("raw"), "body",
        F.when(src.isNull() | (src == ""), F.lit("missing_source")).when(
            F.col("body").isNull(), F.lit("parser_error: payload is not JSON")).alias("error"),
    )
    cols = []
    for name, sql_type in CANONICAL.items():
        branches = None
        for source, fields in known.items():
            if name in fields:
                cond = F.col("source") == source
                value = fields[name].cast(sql_type)
                branches = F.when(cond, value) if branches is None else branches.when(cond, value)
        if name in generic:
            other = F.when(~F.col("source").isin(list(known)), generic[name].cast(sql_type))
            branches = F.coalesce(branches, other)
        cols.append(F.coalesce(branches, _default(name).cast(sql_type)).alias(name))
    out = base.select(
        "event_id", "tenant_id", "ts", "source", lookup(fixed.SOURCE_CONFIDENCE, F.col("source")).alias("source_confidence"),
        *cols, "raw", "body", "error", "received_at",
    )
    provenance = F.struct(
        F.col("event_id").alias("raw_event_id"), F.lit(RAW_TOPIC).alias("topic"), F.col("source").alias("source"),
        F.col("received_at").alias("ingested_at"))
    return out.withColumn("provenance", provenance)


def split_errors(normalized: DataFrame) -> tuple[DataFrame, DataFrame]:
    return normalized.where("error IS NULL").drop("error"), normalized.where("error IS NOT NULL")
