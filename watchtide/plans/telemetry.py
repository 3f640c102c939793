"""Projection of the given tables onto raw telemetry envelopes and reference lists.

The given tables hold no security logs, so each row of ``events`` becomes one raw record of one of
ten log sources, chosen by its ``k`` property; fields vary with user, type and value.  The
fragments below are plain SQL that Spark and the oracle both understand: Spark builds payload JSON
from them and has to normalize it back, while the oracle reads the same fragments as the expected
canonical columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from watchtide.functions.core import fence
from watchtide.session import spread

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()

BS = "chr(92)"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def _by_type(signup: str, error: str, click: str, view: str, purchase: str) -> str:
    return (f"CASE event_type WHEN 'signup' THEN {signup} WHEN 'error' THEN {error} WHEN 'click' THEN {click} "
            f"WHEN 'view' THEN {view} ELSE {purchase} END")


EXE = f"concat('C:', {BS}, 'bin', {BS}, " + _by_type(
    "'powershell.exe'", "'cmd.exe'", "'wmic.exe'", "'notepad.exe'", "'rundll32.exe'") + ")"
CMD = _by_type("'powershell -nop -enc SQBFAFgA'", "'cmd /c procdump -ma lsass.exe'",
               "concat('wmic /node:WKS', k % 40, ' process call create calc')", "'notepad notes.txt'",
               "'rundll32 comsvcs.dll MiniDump'")
PARENT = (f"concat('C:', {BS}, 'bin', {BS}, CASE user_id % 4 WHEN 0 THEN 'WINWORD.EXE' WHEN 1 THEN 'taskeng.exe' "
          "WHEN 2 THEN 'explorer.exe' ELSE 'services.exe' END)")
TARGET = f"concat('C:', {BS}, 'share', {BS}, " + _by_type(
    "concat('f', k, '.locked')", "concat('HOW_TO_DECRYPT_', k, '.txt')", "concat('f', k, '.dmp')",
    "concat('f', k, '.docx')", "concat('f', k, '.tmp')") + ")"
HOST = "concat('wks', k % 40)"
USER = "concat('user', user_id)"
DOMAIN = "CASE WHEN event_type = 'error' THEN concat('dom', (user_id * 7 + k) % 97, '.', repeat('x', 40), '.example') " \
         "ELSE concat('dom', (user_id * 7 + k) % 97, '.example') END"
IN_IP = "concat('10.0.', user_id % 8, '.', user_id % 250)"
OUT_IP = "concat('203.0.113.', (user_id * 3 + k) % 120)"
SHA = "sha2(concat('bin', k), 256)"

# variant number = k % 12
VARIANTS = ["sysmon", "sysmon", "zeek", "zeek", "suricata", "active_directory", "cloudtrail", "email",
            "edr", "kubernetes", "dns", "firewall"]
RAW_NAMES = ["sysmon", "sysmon", "zeek", "zeek", "suricata", "ad_auth", "cloudtrail", "email",
             "edr", "kubernetes", "firewall_dns", "network_firewall"]


def _pick(values: dict, default: str = "NULL") -> str:
    whens = " ".join(f"WHEN {k} THEN {v}" for k, v in values.items())
    return f"CASE k % 12 {whens} ELSE {default} END"


SOURCE = _pick({i: f"'{s}'" for i, s in enumerate(VARIANTS)})
RAW_SOURCE = _pick({i: f"'{s}'" for i, s in enumerate(RAW_NAMES)})
FILE_CODE = _by_type("11", "11", "10", "13", "22")
LOGON_CODE = _by_type("4624", "4625", "4672", "4769", "4720")
EVENT_NAME = _by_type("'ConsoleLogin'", "'CreateAccessKey'", "'AttachUserPolicy'", "'DescribeInstances'", "'StopLogging'")
REPUTATION = _by_type("'malicious'", "'suspicious'", "'unknown'", "'trusted'", "'trusted'")
VERDICT = _by_type("'phishing'", "'clean'", "'unknown'", "'clean'", "'spam'")
TECH_EDR = _by_type("'T1059.001'", "'T1003.001'", "'T1021.002'", "'T1082'", "'T1218'")

# the canonical columns the normalizer has to reproduce
CANON = {
    "source": SOURCE,
    "event_type": _pick({
        0: "'process_create'",
        1: _by_type("'file_create'", "'file_create'", "'process_access'", "'registry_event'", "'dns_query'"),
        2: "'zeek_dns'", 3: "'zeek_conn'", 4: "'network_alert'",
        5: _by_type("'logon'", "'logon_failure'", "'special_privileges_assigned'", "'ad_event_4769'", "'account_created'"),
        6: "'aws_api_call'", 7: "'email_received'", 8: "'edr_process_event'", 9: "'k8s_audit'",
        10: "'dns_query'", 11: "'firewall_connection'"}),
    "severity": _pick({
        1: "CASE WHEN event_type = 'click' THEN 'medium' ELSE 'informational' END",
        4: "CASE 1 + event_id % 3 WHEN 1 THEN 'high' WHEN 2 THEN 'medium' ELSE 'low' END",
        5: "CASE WHEN event_type = 'error' THEN 'medium' ELSE 'informational' END",
        7: "CASE WHEN event_type IN ('signup', 'purchase') OR (event_type = 'click' AND user_id % 2 = 0) THEN 'medium' ELSE 'low' END",
        8: "CASE event_type WHEN 'signup' THEN 'critical' WHEN 'error' THEN 'high' ELSE 'informational' END",
        11: "CASE WHEN event_type = 'error' THEN 'low' ELSE 'informational' END"}, "'informational'"),
    "host": _pick({i: HOST for i in (0, 1, 3, 5, 8, 11)}),
    "user": _pick({i: USER for i in (0, 5, 6, 7, 8, 9)}),
    "process": _pick({0: EXE, 1: f"CASE WHEN event_type IN ('click', 'view') THEN {EXE} END", 8: EXE}),
    "process_id": _pick({0: "event_id % 1000", 8: "event_id % 1000"}),
    "parent_process": _pick({0: PARENT, 8: PARENT}),
    "parent_process_id": _pick({0: "user_id % 50", 8: "user_id % 50"}),
    "command_line": _pick({0: CMD, 6: EVENT_NAME, 8: CMD, 9: "concat('get pods', CASE WHEN event_type = 'click' THEN '/exec' ELSE '' END)"}),
    "file_path": _pick({1: f"CASE WHEN event_type IN ('signup', 'error', 'click') THEN {TARGET} END",
                        7: "CASE WHEN event_type IN ('signup', 'click') THEN concat('inv', k, '.docm') END"}),
    "file_hash": _pick({0: SHA, 7: f"CASE WHEN event_type IN ('signup', 'click') THEN {SHA} END", 8: SHA}),
    "src_ip": _pick({2: IN_IP, 3: IN_IP, 4: IN_IP, 5: IN_IP, 6: OUT_IP, 10: IN_IP, 11: IN_IP}),
    "dst_ip": _pick({2: OUT_IP, 3: OUT_IP, 4: OUT_IP, 8: f"CASE WHEN event_type IN ('signup', 'error') THEN {OUT_IP} END",
                     10: OUT_IP, 11: OUT_IP}),
    "dst_port": _pick({3: "443 + k % 3", 4: "443", 8: "CASE WHEN event_type IN ('signup', 'error') THEN 8443 END", 11: "22 + k % 2"}),
    "domain": _pick({1: f"CASE WHEN event_type = 'purchase' THEN {DOMAIN} END", 2: DOMAIN, 10: DOMAIN}),
    "url": _pick({7: "CASE WHEN event_type = 'purchase' THEN concat('http://dom', k % 97, '.example/l') END"}),
    "email_from": _pick({7: "concat('sender', k % 9, '@mail.example')"}),
    "email_to": _pick({7: f"concat({USER}, '@corp.example')"}),
    "email_subject": _pick({7: "concat('invoice ', k)"}),
    "cloud_resource": _pick({6: "'iam.service.example'"}),
    "k8s_namespace": _pick({9: "concat('ns', user_id % 5)"}),
    "k8s_pod": _pick({9: "concat('pod', k)"}),
    "registry_key": _pick({1: "CASE WHEN event_type = 'view' THEN concat('HKLM/Run/', k) END"}),
    "tag": _pick({4: "CASE WHEN event_type = 'signup' THEN 'A Network Trojan was detected' ELSE 'Misc activity' END",
                  5: "concat('logon_type_', CASE WHEN event_id % 2 = 0 THEN '10' ELSE '3' END)", 7: VERDICT, 8: REPUTATION,
                  10: "CASE WHEN event_type = 'error' THEN 'NXDOMAIN' ELSE 'NOERROR' END",
                  11: "CASE WHEN event_type = 'error' THEN 'deny' ELSE 'allow' END"}),
    "given_technique": _pick({8: TECH_EDR}),
}

# payload per variant: JSON key -> fragment
_DOMAIN_USER = f"concat('CORP', {BS}, 'User', user_id)"
PAYLOADS = {
    0: {"EventID": "1", "Computer": HOST, "User": _DOMAIN_USER, "Image": EXE, "CommandLine": CMD,
        "ParentImage": PARENT, "ProcessId": "event_id % 1000", "ParentProcessId": "user_id % 50",
        "Hashes": f"concat('MD5=00,SHA256=', {SHA})"},
    1: {"EventID": FILE_CODE, "Computer": HOST,
        "Image": f"CASE WHEN event_type IN ('click', 'view') THEN {EXE} END",
        "TargetFilename": f"CASE WHEN event_type IN ('signup', 'error', 'click') THEN {TARGET} END",
        "TargetObject": "CASE WHEN event_type = 'view' THEN concat('HKLM/Run/', k) END",
        "QueryName": f"CASE WHEN event_type = 'purchase' THEN {DOMAIN} END"},
    2: {"log_type": "'dns'", "id.orig_h": IN_IP, "id.resp_h": "'10.0.0.53'", "query": DOMAIN,
        "answers": f"array({OUT_IP}, '198.51.100.7')"},
    3: {"log_type": "'conn'", "host": HOST, "id.orig_h": IN_IP, "id.resp_h": OUT_IP, "id.resp_p": "443 + k % 3"},
    4: {"src_ip": IN_IP, "dest_ip": OUT_IP, "dest_port": "443",
        "alert": "named_struct('severity', 1 + event_id % 3, 'category', CASE WHEN event_type = 'signup' "
                 "THEN 'A Network Trojan was detected' ELSE 'Misc activity' END)"},
    5: {"EventID": LOGON_CODE, "Computer": HOST, "TargetUserName": "concat('User', user_id)", "IpAddress": IN_IP,
        "LogonType": "CASE WHEN event_id % 2 = 0 THEN 10 ELSE 3 END",
        "PrivilegeList": "CASE WHEN event_type = 'click' THEN 'SeDebugPrivilege SeBackupPrivilege' END",
        "ServiceName": "CASE WHEN event_type = 'view' THEN 'cifs/fs1' END"},
    6: {"eventName": EVENT_NAME, "eventSource": "'iam.service.example'", "sourceIPAddress": OUT_IP,
        "userIdentity": f"named_struct('type', 'IAMUser', 'userName', {USER})",
        "additionalEventData": "named_struct('MFAUsed', CASE WHEN event_id % 2 = 0 THEN 'No' ELSE 'Yes' END)"},
    7: {"from": "concat('sender', k % 9, '@mail.example')", "to": f"concat({USER}, '@corp.example')",
        "subject": "concat('invoice ', k)", "verdict": VERDICT, "spf": "CASE WHEN user_id % 2 = 0 THEN 'fail' ELSE 'pass' END",
        "dmarc": "CASE WHEN user_id % 2 = 0 THEN 'fail' ELSE 'pass' END",
        "attachments": f"CASE WHEN event_type IN ('signup', 'click') THEN array(named_struct('filename', concat('inv', k, '.docm'), 'sha256', {SHA})) END",
        "urls": "CASE WHEN event_type = 'purchase' THEN array(concat('http://dom', k % 97, '.example/l')) END"},
    8: {"host": HOST, "user": _DOMAIN_USER, "process_name": EXE, "pid": "event_id % 1000", "ppid": "user_id % 50",
        "command_line": CMD, "parent_process": PARENT, "sha256": SHA, "reputation": REPUTATION,
        "signed": "event_id % 2 = 0", "mitre_techniques": f"array({TECH_EDR})",
        "network_connections": f"CASE WHEN event_type IN ('signup', 'error') THEN array(named_struct('dst_ip', {OUT_IP}, 'dst_port', 8443)) END"},
    9: {"verb": "'get'", "resource": "concat('pods', CASE WHEN event_type = 'click' THEN '/exec' ELSE '' END)",
        "user": f"named_struct('username', {USER})", "namespace": "concat('ns', user_id % 5)", "pod": "concat('pod', k)"},
    10: {"client_ip": IN_IP, "query": DOMAIN, "resolved_ip": OUT_IP,
         "response_code": "CASE WHEN event_type = 'error' THEN 'NXDOMAIN' ELSE 'NOERROR' END"},
    11: {"host": HOST, "src_ip": IN_IP, "dst_ip": OUT_IP, "dst_port": "22 + k % 2",
         "action": "CASE WHEN event_type = 'error' THEN 'deny' ELSE 'allow' END"},
}


def event_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` with its ``k`` property as a column; ``ts`` is a UTC timestamp."""
    return read(spark, sf_dir, "events").select(
        "event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", "event_type", "value",
        F.get_json_object("props", "$.k").cast("int").alias("k"), "props")


def envelopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw envelopes with JSON payloads, one per event."""
    def obj(fields: dict) -> str:
        inner = ", ".join(f"{frag} AS `{name}`" for name, frag in fields.items())
        return f"to_json(struct({inner}))"
    payload = _pick({i: obj(p) for i, p in PAYLOADS.items()})
    rows = spread(event_rows(spark, sf_dir), task_mb=4).selectExpr(
        "concat('evt-', event_id) AS event_id", "concat('t', user_id % 3) AS tenant_id",
        f"{RAW_SOURCE} AS source", "date_format(ts, \"yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX\") AS timestamp",
        "ts AS received_at", f"{payload} AS payload")
    # stands for a stored column, which filters would not recompute either
    return rows.withColumn("payload", fence(F.col("payload")))


def indicators(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Threat indicators, one for each part; those of every fifth part name domains and addresses of the telemetry."""
    return read(spark, sf_dir, "part").selectExpr(
        "CASE WHEN p_partkey % 5 > 0 THEN concat('unseen', p_partkey, '.example') "
        "WHEN p_partkey % 2 = 0 THEN concat('DOM', p_partkey % 97, '.example') "
        "ELSE concat('203.0.113.', p_partkey % 120) END AS value",
        "(50 + p_partkey % 50) / 100.0D AS confidence", "concat('ioc-', p_partkey) AS indicator_id",
        "p_partkey AS load_order")


def host_assets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "part").selectExpr(
        "concat('WKS', p_partkey) AS name", "(p_partkey % 10) / 10.0D AS criticality", "p_brand AS role")


def user_assets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "customer").selectExpr(
        "concat('user', c_custkey) AS name", "(c_custkey % 10) / 10.0D AS criticality", "c_mktsegment AS role")


# --- the same inputs for the oracle ------------------------------------------------------------

def sql_base() -> str:
    """Oracle CTE body: events with k and epoch microseconds."""
    return ("SELECT event_id, epoch_us(ts) AS ts_us, ts, user_id, event_type, value, "
            "CAST(json_extract_string(props, '$.k') AS INT) AS k, props FROM events")


def sql_canon(columns: list[str] | None = None, extra: str = "") -> str:
    """Oracle CTE body: canonical columns straight from the fragments."""
    names = columns or list(CANON)
    cols = ", ".join(f'{CANON[c].replace("sha2(concat(\'bin\', k), 256)", "sha256(concat(\'bin\', k))")} AS "{c}"' for c in names)
    return (f"SELECT concat('evt-', event_id) AS event_id, concat('t', user_id % 3) AS tenant_id, ts_us, ts, "
            f"user_id, k, value, event_id AS n, event_type AS etype, {cols}{extra} FROM base")
