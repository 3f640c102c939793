"""Stage tables over the given data, shared by the registered queries, and their oracle CTEs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from watchtide import fixed
from watchtide.operators import detect, enrich, graph_build, normalize, rules, scoring
from watchtide.plans import telemetry as tel


def normalized(spark: SparkSession, sf: str) -> DataFrame:
    return normalize.split_errors(normalize.normalize(tel.envelopes(spark, sf)))[0]


def enriched(spark: SparkSession, sf: str) -> DataFrame:
    return enrich.enrich(normalized(spark, sf), enrich.latest_indicators(tel.indicators(spark, sf)),
                         tel.host_assets(spark, sf), tel.user_assets(spark, sf))


def gated(spark: SparkSession, sf: str) -> DataFrame:
    """Enriched events with the single-event rules that match (correlation rules left out)."""
    single = [r for r in rules.shipped_rules() if not r.get("correlation")]
    return rules.gate(enriched(spark, sf), single)


def graph(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(events, nodes, edges) of the telemetry graph."""
    ev = enriched(spark, sf)
    return ev, graph_build.upsert_nodes(graph_build.node_rows(ev)), graph_build.upsert_edges(graph_build.edge_rows(ev))


def scored(spark: SparkSession, sf: str) -> DataFrame:
    """Fully scored events: all shipped rules, correlation included, temporal and graph features, ensemble."""
    return detect.detect(enriched(spark, sf), rules.shipped_rules())[0]


def alert_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Alerts straight from the events table: a light stand-in with bounded item sets for clustering."""
    return tel.event_rows(spark, sf).selectExpr(
        "concat('a', event_id) AS alert_id", "concat('t', user_id % 3) AS tenant_id", "unix_micros(ts) AS ts_us",
        "concat('Alert ', event_type) AS title", "event_type",
        "least(value / 250.0D, 1.0D) AS score_raw", "k", "user_id", "event_id",
        "array(concat('H', k % 40), concat('U', user_id % 60), concat('T', event_type)) AS items").selectExpr(
        "*", "round(score_raw, 4) AS calibrated_score").withColumn("severity", scoring.severity_of(F.col("calibrated_score"))).withColumn(
        "technique_ids", F.array("event_type")).withColumn("tags", F.array(F.concat(F.lit("s"), F.col("k") % 7)))


SQL_SEVERITY = ("CASE WHEN {0} >= 0.85 THEN 'critical' WHEN {0} >= 0.65 THEN 'high' WHEN {0} >= 0.4 THEN 'medium' "
                "WHEN {0} >= 0.2 THEN 'low' ELSE 'informational' END")


def _quote(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def sql_any(text: str, words: list[str]) -> str:
    return "(" + " OR ".join(f"contains({text}, {_quote(w.lower())})" for w in words) + ")"


def sql_compact(items: list[str]) -> str:
    return "[x FOR x IN [" + ", ".join(items) + "] IF x IS NOT NULL]"


def sql_enriched() -> str:
    """Oracle CTEs up to ``enr``: canonical columns, techniques, criticality and intel hits."""
    tags = ["given_technique"] + [
        f"CASE WHEN {sql_any('hay', words)} THEN {_quote(t)} END" for t, words in fixed.KEYWORD_TECHNIQUES.items()]
    hits = ", ".join(f"i{n}.conf AS conf_{n}" for n in enrich.INTEL_FIELDS)
    joins = " ".join(f"LEFT JOIN ioc i{n} ON lower(c.{n}) = i{n}.ioc_key" for n in enrich.INTEL_FIELDS)
    matches = sql_compact([f"CASE WHEN conf_{n} IS NOT NULL THEN {n} END" for n in enrich.INTEL_FIELDS])
    confs = sql_compact([f"conf_{n}" for n in enrich.INTEL_FIELDS])
    return f"""
base AS ({tel.sql_base()}),
canon0 AS ({tel.sql_canon()}),
canon AS (SELECT * REPLACE (upper(host) AS host, lower("user") AS "user"), lower(concat_ws(' ', event_type, command_line, file_path, email_subject, url)) AS hay FROM canon0),
ioc AS (SELECT lower(value) AS ioc_key, arg_max(confidence, load_order) AS conf, arg_max(indicator_id, load_order) AS ind FROM (
  SELECT CASE WHEN p_partkey % 5 > 0 THEN concat('unseen', p_partkey, '.example') WHEN p_partkey % 2 = 0 THEN concat('DOM', p_partkey % 97, '.example') ELSE concat('203.0.113.', p_partkey % 120) END AS value,
  (50 + p_partkey % 50) / 100.0::DOUBLE AS confidence, concat('ioc-', p_partkey) AS indicator_id, p_partkey AS load_order FROM part) GROUP BY 1),
ha AS (SELECT concat('WKS', p_partkey) AS name, (p_partkey % 10) / 10.0::DOUBLE AS criticality FROM part),
ua AS (SELECT concat('user', c_custkey) AS name, (c_custkey % 10) / 10.0::DOUBLE AS criticality FROM customer),
enr0 AS (SELECT c.*, list_sort(list_distinct({sql_compact(tags)})) AS techs,
  round(greatest(coalesce(ha.criticality, 0.3), coalesce(ua.criticality, 0.3)), 3)::DOUBLE AS crit, {hits}
  FROM canon c LEFT JOIN ha ON c.host = ha.name LEFT JOIN ua ON c."user" = ua.name {joins}),
enr AS (SELECT *, {matches} AS intel, {confs} AS confs FROM enr0)"""


def sql_entity(kind: str, key: str) -> str:
    return f"CASE WHEN {key} IS NOT NULL THEN concat(tenant_id, ':{kind}:', substr(sha256(trim(lower({key}))), 1, 32)) END"


def sql_entities() -> str:
    """Oracle CTE ``ent`` on top of ``enr``: one id column per entity slot."""
    def none(c: str) -> str:
        return f"coalesce(CAST({c} AS VARCHAR), 'None')"
    def proc(c: str, pid: str) -> str:
        return f"CASE WHEN {c} IS NOT NULL THEN concat(tenant_id, ':Process:', substr(sha256(trim(lower(concat({none('host')}, ':', {c}, ':', {none(pid)})))), 1, 32)) END"
    email = ("CASE WHEN email_to IS NOT NULL THEN concat(tenant_id, ':Email:', substr(sha256(trim(lower(concat(email_from, '->', email_to, ':', email_subject)))), 1, 32)) END")
    slots = {
        "e_host": sql_entity("Host", "host"), "e_user": sql_entity("User", '"user"'), "e_proc": proc("process", "process_id"),
        "e_parent": proc("parent_process", "parent_process_id"), "e_file": sql_entity("File", "file_path"),
        "e_hash": sql_entity("Hash", "file_hash"), "e_src": sql_entity("IP", "src_ip"), "e_dst": sql_entity("IP", "dst_ip"),
        "e_domain": sql_entity("Domain", "domain"), "e_url": sql_entity("URL", "url"), "e_reg": sql_entity("RegistryKey", "registry_key"),
        "e_email": email, "e_cloud": sql_entity("CloudResource", "cloud_resource"),
        "e_k8s": "CASE WHEN k8s_pod IS NOT NULL THEN concat(tenant_id, ':K8sWorkload:', substr(sha256(lower(concat(k8s_namespace, '/', k8s_pod))), 1, 32)) END"}
    cols = ", ".join(f"{v} AS {k}" for k, v in slots.items())
    tech = "[concat(tenant_id, ':AttackTechnique:', substr(sha256(lower(x)), 1, 32)) FOR x IN techs]"
    return (f"ent AS (SELECT *, {cols}, {tech} AS e_tech FROM enr),\n"
            f"ents AS (SELECT *, list_concat({sql_compact(list(slots))}, e_tech) AS ids FROM ent)")


def sql_rules() -> dict[str, str]:
    """Oracle predicate per shipped single-event rule, in service mode over ``enr`` columns."""
    def ends(c: str, words: list[str]) -> str:
        return "(" + " OR ".join(f"ends_with(lower({c}), {_quote(w)})" for w in words) + ")"
    def has(c: str, words: list[str]) -> str:
        return sql_any(f"lower({c})", words)
    shells = ["powershell.exe", "cmd.exe", "wscript.exe", "cscript.exe", "mshta.exe", "rundll32.exe"]
    is_v = "(k % 12) = {}".format
    return {
        "DR-0001": f"{ends('process', ['powershell.exe'])} AND {has('command_line', ['-enc ', '-encodedcommand', 'frombase64string', '-nop -w hidden', '-windowstyle hidden', 'downloadstring'])}",
        "DR-0002": f"{ends('parent_process', ['winword.exe', 'excel.exe', 'outlook.exe', 'powerpnt.exe'])} AND {ends('process', shells)}",
        "DR-0003": has("command_line", ["comsvcs.dll", "minidump", "sekurlsa", "lsass.dmp", "procdump", "lsass_1.dmp"]),
        "DR-0004": has("command_line", ["psexesvc", "psexec"]),
        "DR-0005": f"{ends('process', ['wmic.exe'])} AND {has('command_line', ['/node:', 'process call create'])}",
        "DR-0006": "FALSE",
        "DR-0007": has("file_path", [".locked", ".encrypted", ".crypt"]),
        "DR-0008": has("file_path", ["README_RECOVER", "HOW_TO_DECRYPT", "DECRYPT_INSTRUCTIONS", "HowToDecrypt"]),
        "DR-0009": f"{is_v(7)} AND user_id % 2 = 0 AND tag <> 'clean'",
        "DR-0010": ends("file_path", [".docm", ".xlsm", ".pptm"]),
        "DR-0011": "FALSE",
        "DR-0012": f"{is_v(6)} AND command_line IN ('AttachUserPolicy', 'PutUserPolicy', 'CreateAccessKey', 'AddUserToGroup')",
        "DR-0013": f"{is_v(2)} AND length(domain) > 40",
        "DR-0014": f"{ends('parent_process', ['wmiprvse.exe', 'taskeng.exe', 'services.exe'])} AND "
                   f"{ends('process', ['powershell.exe', 'cmd.exe', 'rundll32.exe', 'wscript.exe'])} AND NOT ({is_v(8)} AND n % 2 = 0)",
        "DR-0016": f"{is_v(4)} AND contains(tag, 'Trojan')",
        "DR-0018": "FALSE",
        "DR-0019": "domain IN ('api.cloudsync-telemetry.com', 'secure-office365-update.com', 'cdn-office-update-cache.net')",
        "DR-0020": "FALSE",
    }


def sql_gated(correlated: bool = False) -> str:
    """Oracle CTE ``gat``: enriched events with matched rules and their weights; with the correlation rule or without."""
    by_id = {r["id"]: r for r in rules.shipped_rules()}
    preds = sql_rules()
    ids = sql_compact([f"CASE WHEN {p} THEN '{r}' END" for r, p in preds.items()])
    weights = sql_compact([f"CASE WHEN {p} THEN {fixed.SEVERITY_WEIGHT[by_id[r]['level']]}::DOUBLE END" for r, p in preds.items()])
    if not correlated:
        return f"gat AS (SELECT *, {ids} AS rule_ids, {weights} AS rule_weights FROM enr)"
    rule, = [r for r in by_id.values() if r.get("correlation")]
    corr = rule["correlation"]
    window = (f"count(DISTINCT {corr['distinct_field']}) OVER (PARTITION BY \"{corr['group_by'][0]}\" ORDER BY ts "
              f"RANGE BETWEEN INTERVAL {corr['window_seconds']} SECONDS PRECEDING AND CURRENT ROW)")
    hit = f"CASE WHEN seen >= {corr['min_distinct']} THEN list_append({{0}}, {{1}}) ELSE {{0}} END"
    weight = f"{fixed.SEVERITY_WEIGHT[rule['level']]}::DOUBLE"
    return (f"gat AS (SELECT * EXCLUDE (ids0, weights0, seen), {hit.format('ids0', _quote(rule['id']))} AS rule_ids, {hit.format('weights0', weight)} AS rule_weights "
            f"FROM (SELECT *, {ids} AS ids0, {weights} AS weights0, {window} AS seen FROM enr))")
