"""Evaluator vocabulary: a second, source-agnostic flattening of raw payloads.

Rules evaluated offline read these names; ``event_id`` is the log's numeric code here.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from watchtide.operators.normalize import field


def short_host(name: Column) -> Column:
    head = F.element_at(F.split(name, r"\."), 1)
    return F.when(head != "", head)


def sha256_part(hashes: Column) -> Column:
    got = F.regexp_extract(hashes, r"(?i)(?:^|,)SHA256=([^,]*)", 1)
    return F.when(got != "", got)


def _texts(path: str) -> Column:
    arr = field(path, type="array<string>")
    return F.when(F.size(arr) > 0, arr)


def vocabularies() -> dict[tuple[str, ...], dict[str, Column]]:
    query = field("query")
    conns = F.try_variant_get("body", "$.network_connections", "array<struct<dst_ip: string>>")
    files = F.try_variant_get("body", "$.attachments", "array<struct<filename: string>>")
    names = F.transform(files, lambda a: a["filename"])
    return {
        ("sysmon",): {
            "event_id": field("EventID"), "host": short_host(field("Computer", "host")), "user": field("User", "user"),
            "image": field("Image"), "command_line": field("CommandLine"), "parent_image": field("ParentImage"),
            "parent_command_line": field("ParentCommandLine"), "target_filename": field("TargetFilename"),
            "target_object": field("TargetObject"), "dest_ip": F.array_compact(F.array(field("DestinationIp"))),
            "dest_port": field("DestinationPort"), "dest_hostname": field("DestinationHostname"),
            "sha256": sha256_part(field("Hashes")), "integrity_level": field("IntegrityLevel"),
        },
        ("edr",): {
            "host": field("host"), "user": field("user"), "image": field("process_name"),
            "command_line": field("command_line"), "parent_image": field("parent_process"), "sha256": field("sha256"),
            "signed": field("signed"), "reputation": field("reputation"),
            "mitre_techniques": field("mitre_techniques", type="array<string>"),
            "dest_ip": F.transform(conns, lambda c: c["dst_ip"]),
        },
        ("ad_auth", "active_directory"): {
            "event_id": field("EventID"), "host": F.coalesce(field("WorkstationName"), short_host(field("Computer"))),
            "user": field("TargetUserName"), "src_ip": field("IpAddress"), "logon_type": field("LogonType"),
            "service_name": field("ServiceName"), "privilege_list": field("PrivilegeList"),
            "failure_reason": field("FailureReason"),
        },
        ("cloudtrail",): {
            "event_name": field("eventName"), "event_source": field("eventSource"),
            "user_name": field("userIdentity/userName", "userIdentity/type"), "user_type": field("userIdentity/type"),
            "src_ip": field("sourceIPAddress"), "mfa_used": field("additionalEventData/MFAUsed"),
            "error_code": field("errorCode"), "read_only": field("readOnly"), "aws_region": field("awsRegion"),
        },
        ("kubernetes", "k8s"): {
            "k8s_verb": field("verb"), "k8s_resource": field("objectRef/resource"),
            "k8s_namespace": field("objectRef/namespace"), "user": field("user/username"),
            "src_ip": field("sourceIPs/[0]"), "response_code": field("responseStatus/code"),
        },
        ("email",): {
            "email_from": field("from"), "email_to": field("to"), "subject": field("subject"),
            "attachment_name": F.try_element_at(names, F.lit(1)),
            "attachment_names": F.when(F.size(names) > 0, names), "urls": _texts("urls"), "spf": field("spf"),
            "dkim": field("dkim"), "dmarc": field("dmarc"), "verdict": field("verdict"),
        },
        ("zeek",): {
            "zeek_log_type": field("log_type"), "src_ip": field("id.orig_h"),
            "dest_ip": F.array_compact(F.array(field("id.resp_h"))), "dest_port": field("id.resp_p"), "dns_query": query,
            "dns_query_length": F.length(query), "http_host": field("host"), "http_uri": field("uri"),
            "service": field("service"),
        },
        ("suricata",): {
            "alert_signature": field("alert/signature"), "alert_category": field("alert/category"),
            "src_ip": field("src_ip"), "dest_ip": F.array_compact(F.array(field("dest_ip"))), "dest_port": field("dest_port"),
        },
        ("dns", "firewall", "firewall_dns"): {
            "zeek_log_type": F.when(query.isNotNull(), F.lit("dns")), "dns_query": query,
            "dns_query_length": F.length(query), "src_ip": field("client_ip", "src_ip"),
            "dest_ip": F.array_compact(F.array(field("dst_ip", "resolved_ip"))), "action": field("action"),
            "rule_name": field("rule_name"),
        },
    }


ARRAYS = {"mitre_techniques", "dest_ip", "attachment_names", "urls"}


def flatten(events: DataFrame, keep: list[str] = []) -> DataFrame:
    """Flat vocabulary over ``source``, ``timestamp`` and JSON text ``raw``; one pass, no shuffle.

    ``keep`` names columns to carry along; they must not clash with the vocabulary.
    """
    vocab = vocabularies()
    names = sorted({n for fields in vocab.values() for n in fields})
    base = events.withColumn("body", F.coalesce(F.try_parse_json("raw"), F.parse_json(F.lit("{}"))))
    cols = []
    for name in names:
        kind = "array<string>" if name in ARRAYS else "string"
        branches = None
        for sources, fields in vocab.items():
            if name in fields:
                cond, value = F.col("source").isin(list(sources)), fields[name].cast(kind)
                branches = F.when(cond, value) if branches is None else branches.when(cond, value)
        cols.append(branches.alias(name))
    return base.select(*keep, "source", "timestamp", *cols)
