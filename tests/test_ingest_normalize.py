import json

from pyspark.sql import functions as F

from watchtide.operators import enrich, flatten, ingest, normalize

ENV = "event_id string, tenant_id string, source string, timestamp string, received_at timestamp, payload string"


def envelopes(spark, rows):
    data = [(r.get("id"), "t1", r["source"], r.get("ts", "2024-05-01T03:00:00Z"), r.get("at", "2024-05-01 03:00:05"),
             r["payload"] if isinstance(r.get("payload"), str) else json.dumps(r["payload"])) for r in rows]
    return spark.createDataFrame(data, ENV.replace("received_at timestamp", "received_at string")).withColumn(
        "received_at", F.to_timestamp("received_at"))


def one(spark, source, payload, **kw):
    return normalize.normalize(envelopes(spark, [{"id": "x", "source": source, "payload": payload, **kw}])).first()


def test_source_aliases(spark):
    df = spark.createDataFrame([("ad_auth",), ("ad",), ("windows_security",), ("firewall_dns",), ("network_firewall",), ("edr",), ("nope",)], "s string")
    got = [r[0] for r in df.select(ingest.resolve_source(F.col("s"))).collect()]
    assert got == ["active_directory", "active_directory", "windows", "dns", "firewall", "edr", "synthetic"]


def test_duplicate_is_recognised_before_validation(spark):
    rows = [{"id": "a", "source": "sysmon", "payload": {}, "at": f"2024-05-01 03:00:0{i}"} for i in range(3)]
    rows += [{"id": "b", "source": "sysmon", "payload": {"EventID": 1}}, {"id": "c", "source": "edr", "payload": {"host": "h"}}]
    routed = ingest.route(envelopes(spark, rows))
    got = {(r.event_id, r.status): (r.reason, r.records) for r in ingest.ingest_results(routed).collect()}
    assert got == {("a", "dead_lettered"): ("empty_payload", 1), ("a", "duplicate"): ("already_ingested", 2),
                   ("b", "accepted"): (None, 1), ("c", "dead_lettered"): ("missing_event_type_discriminator", 1)}
    assert ingest.batch_summary(routed).first().asDict() == {"accepted": 1, "duplicates": 2, "dead_lettered": 2}


def test_event_id_does_not_depend_on_key_order(spark):
    rows = [{"source": "edr", "payload": '{"b": 1, "a": {"y": 2, "x": 1}}'}, {"source": "edr", "payload": '{"a":{"x":1,"y":2},"b":1}'},
            {"source": "edr", "payload": '{"a":{"x":1,"y":2},"b":2}'}]
    ids = [r.event_id for r in ingest.with_event_id(envelopes(spark, rows)).collect()]
    assert ids[0] == ids[1] != ids[2] and ids[0].startswith("edr-") and len(ids[0]) == 36


def test_sysmon_fields(spark):
    r = one(spark, "sysmon", {"EventID": 10, "Computer": "H1", "User": "CORP\\Bob", "SourceImage": "a.exe", "SourceProcessId": 7,
                              "Hashes": "MD5=1,SHA256=abc", "DestinationIp": "1.2.3.4"})
    assert (r.event_type, r.severity, r.user, r.parent_process, r.parent_process_id, r.file_hash, r.dst_ip) == (
        "process_access", "medium", "bob", "a.exe", 7, "abc", "1.2.3.4")
    assert one(spark, "sysmon", {"EventID": 99}).event_type == "sysmon_event_99"


def test_zeek_prefers_answers_and_reads_dotted_keys(spark):
    r = one(spark, "zeek", {"log_type": "dns", "id.orig_h": "10.0.0.1", "id.resp_h": "8.8.8.8", "answers": ["9.9.9.9"], "query": "x.example"})
    assert (r.event_type, r.src_ip, r.dst_ip, r.domain) == ("zeek_dns", "10.0.0.1", "9.9.9.9", "x.example")
    r = one(spark, "zeek", {"id.resp_h": "8.8.8.8", "id.resp_p": 443})
    assert (r.event_type, r.dst_ip, r.dst_port, r.domain) == ("zeek_conn", "8.8.8.8", 443, None)


def test_email_user_and_severity(spark):
    r = one(spark, "email", {"to": "ann@corp.example", "spf": "fail", "verdict": "Clean", "attachments": [{"filename": "a.docm", "sha256": "ff"}], "urls": ["http://u"]})
    assert (r.user, r.severity, r.file_path, r.file_hash, r.url, r.tags) == ("ann", "low", "a.docm", "ff", "http://u", ["clean"])
    assert one(spark, "email", {"to": "ann@corp.example", "spf": "fail"}).severity == "medium"


def test_kubernetes_accepts_user_as_object_or_text(spark):
    assert one(spark, "kubernetes", {"verb": "get", "resource": "pods", "user": {"username": "sa"}}).user == "sa"
    r = one(spark, "kubernetes", {"verb": "get", "resource": "pods", "user": "sb"})
    assert (r.user, r.command_line) == ("sb", "get pods")


def test_bad_rows_carry_an_error_and_time_falls_back(spark):
    rows = [{"id": "1", "source": None, "payload": {}}, {"id": "2", "source": "edr", "payload": "{oops"}, {"id": "3", "source": "edr", "payload": {"host": "h"}, "ts": "???"}]
    good, bad = normalize.split_errors(normalize.normalize(envelopes(spark, rows)))
    assert {r.event_id: r.error for r in bad.collect()} == {"1": "missing_source", "2": "parser_error: payload is not JSON"}
    assert good.first().ts == good.first().received_at


def test_times_with_and_without_zone(spark):
    df = spark.createDataFrame([("2024-05-01T05:00:00+02:00",), ("2024-05-01 03:00:00",), ("Wed, 1 May 2024 03:00:00 GMT",), ("Wed, 1 May 2024 05:00:00 +0200",)], "s string")
    got = {str(r[0]) for r in df.select(normalize.parse_time(F.col("s"), F.lit(None).cast("timestamp"))).collect()}
    assert got == {"2024-05-01 03:00:00"}


def test_identity_and_entities(spark):
    ev, _ = normalize.split_errors(normalize.normalize(envelopes(spark, [
        {"id": "1", "source": "sysmon", "payload": {"EventID": 1, "Computer": "wks", "User": "CORP\\John.Doe", "Image": "c.exe", "ParentImage": "p.exe", "ProcessId": 5}}])))
    feed = spark.createDataFrame([("X.example", 0.4, "i1", 1), ("x.EXAMPLE", 0.9, "i2", 2)], "value string, confidence double, indicator_id string, load_order int")
    hosts = spark.createDataFrame([("WKS", 0.8)], "name string, criticality double")
    users = spark.createDataFrame([("jdoe", 0.5)], "name string, criticality double")
    r = enrich.enrich(ev.withColumn("domain", F.lit("x.Example")), enrich.latest_indicators(feed), hosts, users).first()
    assert (r.user, r.host, r.asset_criticality, r.intel_matches, r.intel_hits[0].confidence) == ("jdoe", "WKS", 0.8, ["x.Example"], 0.9)
    assert [e.type for e in r.entities] == ["Host", "User", "Process", "Process", "Domain"]
    assert r.entities[2].attributes == {"process_id": "5", "host": "WKS"}
    assert all(e.id.startswith(f"t1:{e.type}:") and len(e.id.split(":")[2]) == 32 for e in r.entities)


def test_entity_ids_ignore_case_and_differ_by_tenant(spark):
    from watchtide.functions.core import entity_id
    df = spark.createDataFrame([("t1", "Host-1"), ("t1", " host-1 "), ("t2", "host-1")], "t string, k string")
    a, b, c = [r[0] for r in df.select(entity_id("Host", F.col("k"), F.col("t"))).collect()]
    assert a == b != c


def test_evaluator_vocabulary(spark):
    df = spark.createDataFrame([("sysmon", "t", json.dumps({"EventID": 4624, "Computer": "a.b.c", "Hashes": "SHA256=ff,MD5=1"})),
                                ("edr", "t", json.dumps({"network_connections": [{"dst_ip": "1.1.1.1"}, {"dst_ip": "2.2.2.2"}]}))], "source string, timestamp string, raw string")
    a, b = flatten.flatten(df).collect()
    assert (a.event_id, a.host, a.sha256) == ("4624", "a", "ff") and b.dest_ip == ["1.1.1.1", "2.2.2.2"]
