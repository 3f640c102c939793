"""Queries for response policy, approvals and the audit log."""

from __future__ import annotations

from pyspark.sql import functions as F

from watchtide import fixed
from watchtide.operators import approvals, audit, policy
from watchtide.plans import telemetry as tel
from watchtide.plans.registry import query
from watchtide.session import cut_lineage

_OBJ = fixed.OBJECTIVES
_ARM = fixed.ACTIONS
# every event is one logged episode: risk from value, reward in quarters, objective and action by id
_EP_COLS = {
    "risk_score": "least(value / 250.0, 1.0)", "asset_criticality": "(user_id % 11) / 10.0",
    "objective": "CASE event_id % 7 " + " ".join(f"WHEN {i} THEN '{o}'" for i, o in enumerate(_OBJ)) + " END",
    "action_class": "CASE (event_id + user_id) % 11 " + " ".join(f"WHEN {i} THEN '{a}'" for i, a in enumerate(_ARM)) + " ELSE 'unheard_of' END",
    "reward": "(CASE WHEN event_type = 'error' THEN -1.0 WHEN event_type = 'click' THEN 0.25 WHEN event_type = 'view' THEN 0.5 WHEN event_type = 'signup' THEN 0.75 ELSE 1.0 END)",
}
_EP = "ep AS (SELECT event_id, " + ", ".join(f"{v if n in ('objective', 'action_class') else f'CAST({v} AS DOUBLE)'} AS {n}" for n, v in _EP_COLS.items()) + " FROM events)"


def _episodes(spark, sf):
    return tel.event_rows(spark, sf).selectExpr(
        "event_id", *[f"{v if n in ('objective', 'action_class') else f'CAST({v} AS DOUBLE)'} AS {n}" for n, v in _EP_COLS.items()])


_TACTIC = "CASE x " + " ".join(f"WHEN '{t}' THEN '{fixed.TACTIC_OBJECTIVES[tac]}'" for t, (_, tac) in fixed.TECHNIQUE_CATALOG.items()) + " ELSE 'recon' END"
_TECHS = ["T1566.001", "T1059", "T1003", "T1021.002", "T1486", "T1071.004", "T1190", "T9999"]
_TECH_SQL = "[x FOR x IN [" + ", ".join(f"CASE WHEN (event_id // {3 + i}) % {4 + i} = 0 THEN '{t}' END" for i, t in enumerate(_TECHS)) + "] IF x IS NOT NULL]"
_TECH_SPARK = "array_compact(array(" + ", ".join(f"CASE WHEN (event_id div {3 + i}) % {4 + i} = 0 THEN '{t}' END" for i, t in enumerate(_TECHS)) + "))"


@query("policy_objective", f"""WITH t AS (SELECT event_id, {_TECH_SQL} AS techs, least(value / 250.0, 1.0) AS risk FROM events), o AS (SELECT event_id, techs, risk, [{_TACTIC} FOR x IN techs] AS objs FROM t)
SELECT event_id, CASE WHEN len(techs) = 0 THEN CASE WHEN risk < 0.3 THEN 'benign' ELSE 'recon' END {' '.join(f"WHEN list_contains(objs, '{o}') THEN '{o}'" for o in fixed.OBJECTIVE_PRIORITY)} ELSE 'recon' END AS objective FROM o""")
def policy_objective(spark, sf):
    rows = tel.event_rows(spark, sf).selectExpr("event_id", f"{_TECH_SPARK} AS techs", "least(value / 250.0D, 1.0D) AS risk")
    return rows.select("event_id", policy.objective_of(F.col("techs"), F.col("risk")).alias("objective"))


_PHRASE = "CASE event_id % 9 WHEN 0 THEN 'Ransomware deployment' WHEN 1 THEN 'credential_access_and_lateral_movement' WHEN 2 THEN 'initial_access_phishing' WHEN 3 THEN 'C2 beaconing' WHEN 4 THEN 'infrastructure_reconnaissance' WHEN 5 THEN 'recon' WHEN 6 THEN 'likely_benign_activity' WHEN 7 THEN 'suspicious' ELSE NULL END"


@query("policy_resolve_objective", f"""WITH t AS (SELECT event_id, replace(lower(coalesce({_PHRASE}, '')), ' ', '_') AS raw, least(value / 250.0, 1.0) AS risk FROM events)
SELECT event_id, CASE WHEN raw IN ({', '.join(f"'{o}'" for o in _OBJ)}) THEN raw {' '.join(f"WHEN contains(raw, '{n}') THEN '{o}'" for n, o in fixed.OBJECTIVE_NEEDLES)} WHEN risk < 0.3 THEN 'benign' ELSE 'recon' END AS objective FROM t""")
def policy_resolve_objective(spark, sf):
    rows = tel.event_rows(spark, sf).selectExpr("event_id", f"{_PHRASE} AS phrase", "least(value / 250.0D, 1.0D) AS risk")
    return rows.select("event_id", policy.resolve_objective(F.col("phrase"), F.col("risk")).alias("objective"))


@query("policy_context", f"WITH {_EP} SELECT event_id, 1.0::DOUBLE AS x0, risk_score AS x1, asset_criticality AS x2, " + ", ".join(
    f"(CASE WHEN objective = '{o}' THEN 1.0 ELSE 0.0 END)::DOUBLE AS x{i + 3}" for i, o in enumerate(_OBJ)) + " FROM ep")
def policy_context(spark, sf):
    v = policy.context_vector(F.col("risk_score"), F.col("asset_criticality"), F.col("objective"))
    return _episodes(spark, sf).withColumn("v", v).select("event_id", *[F.element_at("v", i + 1).alias(f"x{i}") for i in range(policy.DIM)])


_X = ["1.0::DOUBLE", "risk_score", "asset_criticality"] + [f"(CASE WHEN objective = '{o}' THEN 1.0 ELSE 0.0 END)::DOUBLE" for o in _OBJ]
_CELLS = [f"SELECT action_class, {i} AS i, {j} AS j, round(sum({_X[i]} * {_X[j]}), 4) AS value FROM known GROUP BY 1" for i in range(policy.DIM) for j in range(i, policy.DIM)]
_CELLS += [f"SELECT action_class, {i}, -1, round(sum(reward * {_X[i]}), 4) FROM known GROUP BY 1" for i in range(policy.DIM)]


@query("policy_linucb_fit", f"WITH {_EP}, known AS (SELECT * FROM ep WHERE action_class <> 'unheard_of') " + " UNION ALL ".join(_CELLS))
def policy_linucb_fit(spark, sf):
    return policy.fit_cells(policy.fit(_episodes(spark, sf))).withColumn("value", F.round("value", 4))


@query("policy_linucb_update", f"WITH {_EP} SELECT action_class, count(*) + count(*) FILTER (reward > 0) AS pulls, round(sum(reward) + sum(CASE WHEN reward > 0 THEN reward ELSE 0 END), 4) AS total_reward FROM ep WHERE action_class <> 'unheard_of' GROUP BY 1")
def policy_linucb_update(spark, sf):
    ep = _episodes(spark, sf)
    out = policy.record_outcomes(ep.where("reward > 0"), policy.fit(ep))
    return out.select("action_class", "pulls", F.round(F.element_at("xr", 1), 4).alias("total_reward"))


def _solved(spark, sf):
    return policy.arms(spark, policy.fit(_episodes(spark, sf)))


# the oracle solves every action's system by elimination: [A | I] becomes [I | inverse], pivot by pivot
_D = policy.DIM
_X_LIST = "[" + ", ".join(_X) + "]"
_SOLVED = f"""{_EP}, known AS (SELECT action_class, reward, {_X_LIST} AS x FROM ep WHERE action_class <> 'unheard_of'),
cells AS (SELECT action_class, i, j, sum(x[i] * x[j]) + CASE WHEN i = j THEN 1 ELSE 0 END AS v FROM known, range(1, {_D + 1}) r(i), range(1, {_D + 1}) c(j) GROUP BY action_class, i, j),
lines AS (SELECT action_class, i, list_concat(list(v ORDER BY j), [CASE WHEN k = i THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END FOR k IN range(1, {_D + 1})]) AS line FROM cells GROUP BY action_class, i),
steps(action_class, step, m) AS (SELECT action_class, 0, list(line ORDER BY i) FROM lines GROUP BY 1
 UNION ALL SELECT action_class, step + 1, list_transform(range(1, {_D + 1}), lambda r: list_transform(range(1, {2 * _D + 1}), lambda c:
  CASE WHEN r = step + 1 THEN m[r][c] / m[r][r] ELSE m[r][c] - m[r][step + 1] / m[step + 1][step + 1] * m[step + 1][c] END)) FROM steps WHERE step < {_D}),
rewards AS (SELECT action_class, i, sum(reward * x[i]) AS v FROM known, range(1, {_D + 1}) r(i) GROUP BY action_class, i),
b AS (SELECT action_class, list(v ORDER BY i) AS b FROM rewards GROUP BY 1),
arms AS (SELECT action_class, [line[{_D + 1}:{2 * _D}] FOR line IN m] AS inv, [list_dot_product(line[{_D + 1}:{2 * _D}], b) FOR line IN m] AS theta FROM steps JOIN b USING (action_class) WHERE step = {_D}),
allowed(objective, action_class, position) AS (VALUES {', '.join(f"('{o}', '{a}', {i})" for o, *_, allowed in fixed.PLAYBOOKS for i, a in enumerate(allowed))}),
scored AS (SELECT event_id, risk_score, action_class, reward, objective, armed, position, mean, mean + {fixed.LINUCB_ALPHA} * sqrt(list_dot_product(x, [list_dot_product(line, x) FOR line IN inv])) AS upper
 FROM (SELECT *, {_X_LIST} AS x FROM ep) e JOIN (SELECT objective, action_class AS armed, position, theta, inv FROM allowed JOIN arms USING (action_class)) USING (objective), LATERAL (SELECT list_dot_product(theta, x) AS mean)),
bold AS (SELECT event_id, any_value(risk_score) AS risk_score, any_value(objective) AS objective, arg_max(armed, (upper, -position)) AS chosen, max(upper) AS score FROM scored GROUP BY 1),
greedy AS (SELECT event_id, any_value(action_class) AS action_class, any_value(reward) AS reward, arg_max(armed, (mean, -position)) AS chosen FROM scored GROUP BY 1)"""


@query("policy_linucb_select", f"WITH RECURSIVE {_SOLVED} SELECT event_id, chosen, round(score, 6) AS score FROM bold")
def policy_linucb_select(spark, sf):
    """Greedy choice per episode with its score; the solver is checked against numpy in the tests."""
    scored = policy.score_arms(_episodes(spark, sf), _solved(spark, sf), F.lit(True))
    return scored.select("event_id", policy.best_arm(F.col("scores")).alias("chosen"),
                         F.round(F.array_max(F.transform("scores", lambda s: s["score"])), 6).alias("score"))


_PB = {o: (p, a, t, s) for o, p, a, t, s, _ in fixed.PLAYBOOKS}


def _case(col: int) -> str:
    return "CASE objective " + " ".join(f"WHEN '{o}' THEN " + (f"'{v[col]}'" if v[col] else "NULL") for o, v in _PB.items()) + " END"


@query("policy_recommend", f"""WITH {_EP}, r AS (SELECT event_id, objective, risk_score, CASE WHEN risk_score < 0.25 THEN 'ignore' ELSE {_case(1)} END AS action_class FROM ep WHERE risk_score < 0.25 OR risk_score >= 0.55)
SELECT event_id AS case_id, objective, action_class, action_class IN ({', '.join(f"'{a}'" for a in fixed.DISRUPTIVE_ACTIONS)}) AS disruptive, {_case(0)} AS playbook_id, {_case(3)} AS risk_if_executed,
 CASE WHEN action_class = {_case(1)} THEN {_case(2)} ELSE 'Ignore' END AS title, floor(least(0.5::DOUBLE + 0.5::DOUBLE * risk_score, 0.99::DOUBLE) * 1000 + 0.5::DOUBLE) / 1000 AS confidence,
 CASE WHEN action_class IN ({', '.join(f"'{a}'" for a in fixed.DISRUPTIVE_ACTIONS)}) THEN 'pending' ELSE 'auto_applied_dry_run' END AS status FROM r""")
def policy_recommend(spark, sf):
    rows = _episodes(spark, sf).select(F.col("event_id").alias("case_id"), "risk_score", "asset_criticality", F.col("objective").alias("likely_objective"))
    out = policy.recommend(rows, _solved(spark, sf)).where("risk_score < 0.25 OR risk_score >= 0.55")
    return out.select("case_id", "objective", "action_class", "disruptive", "playbook_id", "risk_if_executed", "title", "confidence", "status")


_DISRUPTIVE = ", ".join(f"'{a}'" for a in fixed.DISRUPTIVE_ACTIONS)


@query("policy_recommend_explore", f"""WITH RECURSIVE {_SOLVED} SELECT event_id AS case_id, objective, chosen AS action_class, CASE WHEN chosen IN ({_DISRUPTIVE}) THEN 'pending' ELSE 'auto_applied_dry_run' END AS status
FROM bold WHERE risk_score >= 0.25 AND risk_score < 0.55""")
def policy_recommend_explore(spark, sf):
    rows = _episodes(spark, sf).select(F.col("event_id").alias("case_id"), "risk_score", "asset_criticality", F.col("objective").alias("likely_objective"))
    out = policy.recommend(rows, _solved(spark, sf)).where("risk_score >= 0.25 AND risk_score < 0.55")
    return out.select("case_id", "objective", "action_class", "status")


@query("policy_outcome_status", f"WITH {_EP} SELECT CASE WHEN reward > 0 THEN 'approved' ELSE 'rejected' END AS status, action_class, count(*) AS outcomes FROM ep GROUP BY 1, 2")
def policy_outcome_status(spark, sf):
    return policy.outcome_status(_episodes(spark, sf)).groupBy("status", "action_class").agg(F.count("*").alias("outcomes"))


@query("policy_offline_evaluation", f"""WITH RECURSIVE {_SOLVED} SELECT count(*) AS episodes, round(count(*) FILTER (chosen = action_class) / count(*), 3) AS match_rate,
 round(avg(reward) FILTER (chosen = action_class), 3) AS avg_reward_when_policy_matches_log, round(avg(reward), 3) AS avg_reward_baseline_all_logged FROM greedy""")
def policy_offline_evaluation(spark, sf):
    return policy.evaluate_offline(policy.choose(_episodes(spark, sf), _solved(spark, sf)))


@query("policy_action_distribution", f"WITH RECURSIVE {_SOLVED} SELECT chosen, count(*) AS episodes FROM greedy GROUP BY 1")
def policy_action_distribution(spark, sf):
    return policy.action_distribution(policy.choose(_episodes(spark, sf), _solved(spark, sf)))


@query("policy_recommendation_list", "SELECT concat('c', user_id) AS case_id, event_id, epoch_us(ts) AS created_us FROM events WHERE user_id = 7 AND event_type = 'error'")
def policy_recommendation_list(spark, sf):
    rows = tel.event_rows(spark, sf).selectExpr("concat('c', user_id) AS case_id", "event_id", "unix_micros(ts) AS created_us", "event_type AS status")
    return policy.list_recommendations(rows, case_id="c7", status="error").select("case_id", "event_id", "created_us")


@query("policy_state", f"WITH {_EP}, a AS (SELECT unnest([{', '.join(repr(a) for a in _ARM)}]) AS action_class) SELECT action_class, coalesce(n, 0) AS pulls FROM a LEFT JOIN (SELECT action_class, count(*) AS n FROM ep GROUP BY 1) USING (action_class)")
def policy_state(spark, sf):
    return policy.policy_state(spark, policy.fit(_episodes(spark, sf)))


@query("policy_playbooks", f"WITH {_EP} SELECT objective, {_case(0)} AS playbook_id, {_case(1)} AS action_class, count(*) AS episodes FROM ep GROUP BY 1, 2, 3")
def policy_playbooks(spark, sf):
    books = policy.playbooks(spark).select("objective", "playbook_id", "action_class")
    return _episodes(spark, sf).select("objective", "event_id").join(books, "objective").groupBy("objective", "playbook_id", "action_class").agg(F.count("*").alias("episodes"))


# --- approvals: lineitem as life-cycle log -------------------------------------------------------
_LOG = """log AS (SELECT l_orderkey AS approval_id, l_linenumber * 10000000000 + l_partkey * 10000 + l_suppkey AS seq, epoch_us(l_shipdate) AS t, concat('a', l_suppkey % 9) AS actor,
 CASE WHEN l_linenumber = 1 AND l_partkey % 10 > 0 THEN 'request' ELSE CASE l_partkey % 5 WHEN 0 THEN 'approve' WHEN 1 THEN 'reject' WHEN 2 THEN 'execute' WHEN 3 THEN 'rollback' ELSE 'approve' END END AS kind FROM lineitem)"""


def _approval_log(spark, sf):
    return tel.read(spark, sf, "lineitem").selectExpr(
        "l_orderkey AS approval_id", "l_linenumber * 10000000000 + l_partkey * 10000 + l_suppkey AS seq", "unix_micros(cast(l_shipdate AS timestamp)) AS t", "concat('a', l_suppkey % 9) AS actor",
        "CASE WHEN l_linenumber = 1 AND l_partkey % 10 > 0 THEN 'request' ELSE CASE l_partkey % 5 WHEN 0 THEN 'approve' WHEN 1 THEN 'reject' WHEN 2 THEN 'execute' WHEN 3 THEN 'rollback' ELSE 'approve' END END AS kind")


_STATE = f"""{_LOG}, r AS (SELECT approval_id, min(seq) AS request_seq, arg_min(t, seq) AS created FROM log WHERE kind = 'request' GROUP BY 1),
d AS (SELECT approval_id, min(seq) AS decision_seq, arg_min(kind, seq) AS decision, arg_min(actor, seq) AS decided_by, arg_min(t, seq) AS dt FROM log JOIN r USING (approval_id) WHERE kind IN ('approve', 'reject') AND seq > request_seq GROUP BY 1),
e AS (SELECT approval_id, min(seq) AS execution_seq, arg_min(t, seq) AS et FROM log JOIN d USING (approval_id) WHERE kind = 'execute' AND decision = 'approve' AND seq > decision_seq GROUP BY 1),
b AS (SELECT approval_id, min(seq) AS rollback_seq, arg_min(t, seq) AS bt FROM log JOIN e USING (approval_id) WHERE kind = 'rollback' AND seq > execution_seq GROUP BY 1),
state AS (SELECT approval_id, CASE WHEN rollback_seq IS NOT NULL THEN 'rolled_back' WHEN execution_seq IS NOT NULL THEN 'executed' WHEN decision = 'approve' THEN 'approved' WHEN decision = 'reject' THEN 'rejected' ELSE 'pending' END AS status,
 created, request_seq, decision_seq, execution_seq, rollback_seq, decided_by, coalesce(bt, et, dt, created) AS updated FROM r LEFT JOIN d USING (approval_id) LEFT JOIN e USING (approval_id) LEFT JOIN b USING (approval_id))"""


@query("approval_state", f"WITH {_STATE} SELECT approval_id, status, created, decided_by, updated FROM state")
def approval_state(spark, sf):
    return approvals.fold_approvals(_approval_log(spark, sf)).select("approval_id", "status", "created", "decided_by", "updated")


@query("approval_illegal_events", f"""WITH {_STATE}, x AS (SELECT log.approval_id, log.seq, kind, CASE WHEN request_seq IS NULL OR log.seq < request_seq THEN 'unknown approval' WHEN kind = 'request' AND log.seq > request_seq THEN 'already requested'
 WHEN kind IN ('approve', 'reject') AND decision_seq < log.seq THEN 'already decided' WHEN kind = 'execute' AND coalesce(log.seq <> execution_seq, TRUE) THEN 'not approved' WHEN kind = 'rollback' AND coalesce(log.seq <= execution_seq, TRUE) THEN 'nothing to roll back' END AS reason
 FROM log LEFT JOIN state USING (approval_id)) SELECT approval_id, seq, kind, reason FROM x WHERE reason IS NOT NULL""")
def approval_illegal_events(spark, sf):
    log = _approval_log(spark, sf)
    return approvals.illegal_events(log, approvals.fold_approvals(log))


@query("approval_list", f"WITH {_STATE} SELECT approval_id, status, created FROM state WHERE status = 'approved' ORDER BY created DESC, approval_id LIMIT 50")
def approval_list(spark, sf):
    return approvals.list_approvals(approvals.fold_approvals(_approval_log(spark, sf)), status="approved").select("approval_id", "status", "created")


@query("approval_executions", f"WITH {_LOG} SELECT approval_id, arg_max(seq, (t, seq)) AS execution_id, max(t) AS t FROM log WHERE kind = 'execute' GROUP BY 1")
def approval_executions(spark, sf):
    rows = _approval_log(spark, sf).where("kind = 'execute'").select("approval_id", F.col("seq").alias("execution_id"), "t")
    return approvals.latest_executions(rows)


@query("approval_unauthorized", """SELECT o_orderkey AS approval_id, role FROM (SELECT o_orderkey, CASE o_custkey % 4 WHEN 0 THEN 'analyst' WHEN 1 THEN 'senior_analyst' WHEN 2 THEN 'admin' ELSE 'guest' END AS role,
 o_orderstatus <> 'F' AS approved, o_orderkey % 2 = 0 AS disruptive FROM orders) WHERE approved AND disruptive AND role IN ('analyst', 'guest')""")
def approval_unauthorized(spark, sf):
    rows = tel.read(spark, sf, "orders").selectExpr(
        "o_orderkey AS approval_id", "CASE o_custkey % 4 WHEN 0 THEN 'analyst' WHEN 1 THEN 'senior_analyst' WHEN 2 THEN 'admin' ELSE 'guest' END AS role",
        "CASE WHEN o_orderstatus <> 'F' THEN 'approved' ELSE 'rejected' END AS decision", "o_orderkey % 2 = 0 AS disruptive")
    return approvals.unauthorized_decisions(rows).select("approval_id", "role")


# --- audit: orders as audited actions ------------------------------------------------------------
_CONTENT = "concat('{\"action\":\"', o_orderstatus, '\",\"actor\":\"u', o_custkey, '\",\"resource_id\":\"', o_orderkey, '\"}')"


def _audit_rows(spark, sf):
    rows = tel.read(spark, sf, "orders").selectExpr("o_orderkey", "o_orderstatus AS action", "concat('u', o_custkey) AS actor", "cast(o_orderkey AS string) AS resource_id", "o_orderdate AS timestamp")
    return audit.number_records(rows, "o_orderkey").withColumn("content", audit.canonical_record(["action", "actor", "resource_id"]))


_NUM = f"num AS (SELECT row_number() OVER (ORDER BY o_orderkey) AS sequence, {_CONTENT} AS content, o_orderstatus AS action, concat('u', o_custkey) AS actor, CAST(o_orderkey AS VARCHAR) AS resource_id, epoch_us(o_orderdate) AS t FROM orders)"


@query("audit_sequence", f"WITH {_NUM} SELECT sequence, md5(content) AS content FROM num")
def audit_sequence(spark, sf):
    return _audit_rows(spark, sf).select("sequence", F.md5("content").alias("content"))


_CHAIN = f"""{_NUM}, chain(sequence, prev_hash, record_hash) AS (
 SELECT sequence, repeat('0', 64), sha256(concat(sequence, '|', repeat('0', 64), '|', content)) FROM num WHERE (sequence - 1) % {audit.BLOCK} = 0
 UNION ALL SELECT num.sequence, record_hash, sha256(concat(num.sequence, '|', record_hash, '|', content)) FROM chain JOIN num ON num.sequence = chain.sequence + 1 WHERE (num.sequence - 1) % {audit.BLOCK} > 0)"""


@query("audit_append", f"WITH RECURSIVE {_CHAIN} SELECT sequence, prev_hash, record_hash FROM chain")
def audit_append(spark, sf):
    rows = _audit_rows(spark, sf).select("sequence", "content")
    return audit.append_events(rows).where("level = 0").select("sequence", "prev_hash", "record_hash")


def _tampered(spark, sf):
    """The chain with every 997th content edited after hashing."""
    chain = cut_lineage(audit.append_events(_audit_rows(spark, sf).select("sequence", "content")))
    return chain.withColumn("content", F.when((F.col("level") == 0) & (F.col("sequence") % 997 == 0), F.concat("content", F.lit("!"))).otherwise(F.col("content")))


@query("audit_verify", f"WITH {_NUM} SELECT FALSE AS valid, count(*) FILTER (sequence < 997) AS events_checked, min(sequence) FILTER (sequence % 997 = 0) AS first_broken_sequence, 'record_hash mismatch at sequence=997' AS detail FROM num")
def audit_verify(spark, sf):
    return audit.verify(_tampered(spark, sf))


@query("audit_broken_records", f"WITH {_NUM} SELECT 0 AS level, sequence, 'record_hash mismatch' AS problem FROM num WHERE sequence % 997 = 0")
def audit_broken_records(spark, sf):
    return audit.broken_records(_tampered(spark, sf)).select("level", "sequence", "problem")


def _kept_chain(spark, sf):
    return cut_lineage(audit.append_events(_audit_rows(spark, sf).select("sequence", "content")))


def _forged(chain, edited):
    """Records of ``edited`` numbers with new content and hashes that fit together again, in the place of the old ones."""
    own = chain.where((F.col("level") == 0) & edited)
    new = audit._chain(own.select("level", "sequence", F.concat("content", F.lit("!")).alias("content")), audit.BLOCK)
    return chain.where(~((F.col("level") == 0) & edited)).unionByName(new.withColumn("segment", F.lit(1)).select(chain.columns))


_THIRD = f"sequence BETWEEN {2 * audit.BLOCK + 1} AND {3 * audit.BLOCK}"


@query("audit_verify_block_removed", f"WITH {_NUM} SELECT FALSE AS valid, count(*) FILTER (sequence <= {2 * audit.BLOCK}) AS events_checked, {2 * audit.BLOCK + 1}::BIGINT AS first_broken_sequence, 'block missing at sequence={2 * audit.BLOCK + 1}' AS detail FROM num")
def audit_verify_block_removed(spark, sf):
    return audit.verify(_kept_chain(spark, sf).where(f"NOT (level = 0 AND {_THIRD})"))


@query("audit_verify_block_forged", f"WITH {_NUM} SELECT FALSE AS valid, count(*) FILTER (sequence < {3 * audit.BLOCK}) AS events_checked, {3 * audit.BLOCK}::BIGINT AS first_broken_sequence, 'block hash mismatch at sequence={3 * audit.BLOCK}' AS detail FROM num")
def audit_verify_block_forged(spark, sf):
    return audit.verify(_forged(_kept_chain(spark, sf), F.expr(_THIRD)))


@query("audit_verify_tail_removed", f"""WITH {_NUM}, ends AS (SELECT count(*) AS n, count(*) - 20 AS last FROM num)
SELECT FALSE AS valid, CASE WHEN last % {audit.BLOCK} = 0 THEN last ELSE last - 1 END AS events_checked FROM ends""")
def audit_verify_tail_removed(spark, sf):
    """The last 20 records gone, with all rows above them left."""
    chain = _kept_chain(spark, sf)
    last = chain.where("level = 0").agg(F.max("sequence") - 20).scalar()
    return audit.verify(chain.where((F.col("level") != 0) | (F.col("sequence") <= last))).select("valid", "events_checked")


@query("audit_append_continued", f"WITH {_NUM} SELECT TRUE AS valid, count(*) AS events_checked, NULL::BIGINT AS first_broken_sequence, 'chain intact' AS detail FROM num")
def audit_append_continued(spark, sf):
    """The log appended in two goes, the second after the head of the first."""
    rows = cut_lineage(_audit_rows(spark, sf).select("sequence", "content"))
    early = cut_lineage(audit.append_events(rows.where("sequence <= 1000")))
    late = audit.append_events(rows.where("sequence > 1000"), after=audit.last_head(early))
    both = cut_lineage(early.unionByName(late))
    return audit.verify(both, pinned=audit.last_head(both))


@query("audit_query", f"WITH {_NUM} SELECT sequence, actor, action FROM num WHERE action = 'O' AND actor = 'u7' ORDER BY sequence DESC LIMIT 100")
def audit_query(spark, sf):
    return audit.query_events(_audit_rows(spark, sf), action="O", actor="u7").select("sequence", "actor", "action")


@query("audit_search", f"""WITH {_NUM}, f AS (SELECT sequence, actor FROM num WHERE contains(lower(concat(action, actor)), 'u12')) SELECT sequence, actor, (SELECT count(*) FROM f) AS total FROM f ORDER BY sequence DESC OFFSET 5 LIMIT 100""")
def audit_search(spark, sf):
    return audit.search_log(_audit_rows(spark, sf).select("sequence", "action", "actor"), "U12", offset=5).select("sequence", "actor", "total")
