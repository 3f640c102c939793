import json

import pytest
from pyspark.sql import functions as F

from watchtide.operators import enrich, rules
from watchtide.plans import flow


def rows(tag, host, items):
    return [(None, "default", s, f"2024-05-0{tag}T{t}Z", json.dumps(p)) for s, t, p in
            [(s, t, {**p, **({"Computer": host} if s in ("sysmon", "ad_auth") else {"host": host})}) for s, t, p in items]]


ATTACK = rows(1, "dc01", [
    ("email", "22:00:00", {"to": "jdoe@corp.example", "from": "x@evil.example", "subject": "invoice", "spf": "fail", "dmarc": "fail", "verdict": "malicious",
                           "attachments": [{"filename": "invoice.docm", "sha256": "aa" * 32}]}),
    ("sysmon", "22:05:00", {"EventID": 1, "User": "CORP\\jdoe", "Image": "C:\\powershell.exe", "ParentImage": "C:\\winword.exe", "CommandLine": "powershell -enc AAAA", "ProcessId": 10, "Hashes": "SHA256=" + "aa" * 32}),
    ("edr", "22:10:00", {"user": "jdoe", "process_name": "procdump.exe", "command_line": "procdump lsass.dmp sekurlsa", "reputation": "malicious", "sha256": "aa" * 32,
                         "mitre_techniques": ["T1003.001"], "network_connections": [{"dst_ip": "203.0.113.9", "dst_port": 443}]}),
    ("sysmon", "22:20:00", {"EventID": 11, "User": "CORP\\jdoe", "Image": "C:\\enc.exe", "TargetFilename": "C:\\a.locked"}),
])
BENIGN = rows(2, "wks7", [
    ("sysmon", "12:00:00", {"EventID": 1, "User": "CORP\\svc-sccm", "Image": "C:\\powershell.exe", "ParentImage": "C:\\taskeng.exe", "CommandLine": "powershell -enc patch-compliance"}),
])


@pytest.fixture(scope="module")
def tables(spark):
    env = spark.createDataFrame(ATTACK + BENIGN, "event_id string, tenant_id string, source string, timestamp string, payload string").withColumn(
        "received_at", F.to_timestamp("timestamp"))
    feed = spark.createDataFrame([("aa" * 32, 0.95, "i1", 1), ("203.0.113.9", 0.9, "i2", 2)], "value string, confidence double, indicator_id string, load_order int")
    hosts = spark.createDataFrame([("DC01", 1.0)], "name string, criticality double")
    users = spark.createDataFrame([("jdoe", 0.5)], "name string, criticality double")
    return flow.run(env, enrich.latest_indicators(feed), hosts, users, rules.shipped_rules())


def test_attack_outranks_benign_activity(tables):
    top = {r.host: r.s for r in tables["scored"].groupBy("host").agg(F.max("calibrated_score").alias("s")).collect()}
    assert top["DC01"] >= 0.5 and top["WKS7"] < 0.55 and top["WKS7"] < top["DC01"]


def test_stages_are_linked(tables):
    s = tables["summary"].first()
    assert s.events == 5 and s.hits >= 5 and s.alerts == 5 and s.cases == 2 and s.graph_updates > 0
    assert tables["errors"].count() == 0 and tables["nodes"].count() > 5 and tables["edges"].count() > 5
    reports = {r.case_id: r for r in tables["reports"].collect()}
    assert len(reports) == 2 and all(r.groundedness_score > 0.5 for r in reports.values())
    recs = {r.case_id: r for r in tables["recommendations"].collect()}
    attack = max(tables["cases"].collect(), key=lambda c: c.risk_score)
    assert recs[attack.case_id].disruptive and recs[attack.case_id].status == "pending"
    assert "T1486" in attack.technique_ids
