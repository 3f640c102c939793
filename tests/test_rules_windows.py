import random

from pyspark.sql import functions as F

from watchtide.operators import rules, windows


def fired(spark, cols, schema, rule_list, mode="service", body=None):
    df = spark.createDataFrame([cols], schema)
    if body is not None:
        df = df.withColumn("body", F.parse_json(F.lit(body)))
    return [m.rule_id for m in rules.gate(df, rule_list, mode).first().matches]


def rule(rid, blocks, cond="selection", **kw):
    return {"id": rid, "title": rid, "level": "high", "detection": {**blocks, "condition": cond}, **kw}


def test_at_least_fifteen_rules_ship():
    shipped = rules.shipped_rules()
    assert len(shipped) == 19 and len({r["id"] for r in shipped}) == 19


def test_event_id_means_own_id_in_service_and_code_in_evaluator(spark):
    logon = [r for r in rules.shipped_rules() if r["id"] == "DR-0006"]
    assert fired(spark, ("evt-1", "x"), "event_id string, host string", logon, body='{"EventID": 4624, "LogonType": 10}') == []
    assert fired(spark, ("4624", "10"), "event_id string, logon_type string", logon, "evaluator") == ["DR-0006"]


def test_raw_keys_match_loosely(spark):
    r = rule("r", {"selection": {"service_name|contains": "CIFS/", "logon_type": 10}})
    assert fired(spark, ("x",), "host string", [r], body='{"ServiceName": "cifs/a", "LogonType": 10}') == ["r"]
    assert fired(spark, ("x",), "host string", [r], body='{"ServiceName": "cifs/a", "LogonType": 3}') == []


def test_conditions(spark):
    blocks = {"selection": {"a": "1"}, "other": {"b": "1"}, "filter_x": {"c": "1"}}
    schema = "a string, b string, c string"
    assert fired(spark, ("1", "0", "1"), schema, [rule("r", blocks, "selection and not filter_x")]) == []
    assert fired(spark, ("0", "1", "0"), schema, [rule("r", blocks, "selection or (other and not filter_x)")]) == ["r"]
    assert fired(spark, ("1", "1", "1"), schema, [rule("r", blocks, "__import__('os')")]) == ["r"]       # all blocks but filters
    assert fired(spark, ("1", "1", "1"), schema, [rule("r", blocks, "__import__('os')")], "evaluator") == []
    assert fired(spark, ("1", "1", "1"), schema, [rule("r", blocks, "selection and and other")]) == ["r"]


def test_missing_values_never_match(spark):
    blocks = {"selection": {"a|contains": "x"}, "filter_n": {"a": "x"}}
    assert fired(spark, (None,), "a string", [rule("r", blocks)]) == []
    assert fired(spark, (None,), "a string", [rule("r", blocks, "not filter_n")]) == ["r"]
    assert fired(spark, ("text",), "a string", [rule("r", {"selection": {"a|gt": 1}})]) == []


def test_booleans_and_exists(spark):
    assert fired(spark, (True,), "signed boolean", [rule("r", {"selection": {"signed": "yes"}})]) == ["r"]
    r = [rule("has", {"selection": {"a|exists": True}}), rule("not", {"selection": {"a|not_exists": True}})]
    assert fired(spark, (None,), "a string", r, "evaluator") == ["not"]


def test_pure_correlation_rule_passes_every_event(spark):
    r = [x for x in rules.shipped_rules() if x.get("correlation")]
    assert fired(spark, ("h",), "host string", r) == [r[0]["id"]]


def test_many_rules_are_evaluated_in_groups(spark):
    many = [rule(f"r{i}", {"selection": {"n": i}}) for i in range(230)]
    df = spark.createDataFrame([("7",), ("229",)], "n string")
    got = [[m.rule_id for m in r.matches] for r in rules.gate(df, many).collect()]
    assert got == [["r7"], ["r229"]]


# --- windows against brute force ----------------------------------------------------------------

def rows_with_hot_key(n=400, seed=3):
    rnd = random.Random(seed)
    return [(i, "hot" if rnd.random() < 0.6 else rnd.choice(["a", "b", None]), rnd.choice(["x", "y", "z", None]),
             rnd.randrange(0, 2000) * 500_000) for i in range(n)]


def frame(spark, rows):
    return spark.createDataFrame(rows, "id long, k string, f string, t long")


def test_sliding_count_and_distinct_match_brute_force(spark):
    rows = rows_with_hot_key()
    for seconds in (1, 10, 60):
        w = seconds * windows.SECOND
        want = {i: (sum(1 for _, k2, _, t2 in rows if k2 == k and t - w <= t2 <= t),
                    len({f2 for _, k2, f2, t2 in rows if k2 == k and t - w <= t2 <= t and f2})) for i, k, f, t in rows}
        out = windows.sliding_distinct(windows.sliding_count(frame(spark, rows), ["k"], "t", seconds), ["k"], "f", "t", seconds)
        assert {r.id: (r.n, r.n_distinct) for r in out.collect()} == want


def test_row_order_does_not_matter(spark):
    rows = rows_with_hot_key(150)
    a = windows.sliding_count(frame(spark, rows), ["k"], "t", 30).collect()
    b = windows.sliding_count(frame(spark, rows[::-1]), ["k"], "t", 30).collect()
    assert sorted((r.id, r.n) for r in a) == sorted((r.id, r.n) for r in b)


def test_sessions_split_only_after_the_gap(spark):
    rows = [(i, "k", None, t * windows.SECOND) for i, t in enumerate([0, 10, 20, 31, 100])]
    got = {r.id: r.session_start // windows.SECOND for r in windows.sessionize(frame(spark, rows), ["k"], "t", 10).collect()}
    assert got == {0: 0, 1: 0, 2: 0, 3: 31, 4: 100}


def test_evidence_members_are_those_inside_a_hit_window(spark):
    rows = rows_with_hot_key(200, 5)
    r = {"correlation": {"type": "threshold", "group_by": ["k"], "min_count": 6, "window_seconds": 20}}
    out = windows.correlate(frame(spark, rows).where("k IS NOT NULL"), r, "t")
    hits = [(x.k, x.t) for x in out.collect() if x.correlated]
    want = {i for i, k, _, t in rows if any(k == hk and ht - 20 * windows.SECOND <= t <= ht for hk, ht in hits)}
    assert {x.id for x in windows.evidence_members(out, ["k"], "t", 20).collect()} == want


def test_rate_limit_replay(spark):
    rows = sorted(rows_with_hot_key(300, 9), key=lambda r: (r[3], str(r[0])))
    want, state = {}, {}
    for i, k, _, t in rows:
        q = [x for x in state.get(k, []) if x >= t - 30 * windows.SECOND]
        want[str(i)] = len(q) < 4
        state[k] = q + [t] if len(q) < 4 else q
    keyed = frame(spark, rows).where("k IS NOT NULL")
    got = {r.o: r.allowed for r in windows.rate_limit(keyed, "k", "t", "id", 4, 30).collect()}
    assert got == {i: ok for i, ok in want.items() if dict((str(r[0]), r[1]) for r in rows)[i] is not None}


def test_next_in_time(spark):
    rows = [(i, "k", v, t * windows.SECOND) for i, (v, t) in enumerate([("a", 0), ("b", 90_000), ("c", 400_000), ("d", 400_001)])]
    got = {r.id: r.nxt for r in windows.next_in_time(frame(spark, rows), ["k"], "t", "id", "f", "nxt").collect()}
    assert got == {0: "b", 1: "c", 2: "d", 3: None}


def test_raw_keys_are_found_in_any_spelling(spark):
    spellings = ["target_filename", "TargetFilename", "targetfilename", "Target_Filename", "TARGETFILENAME", "_target_file_name_"]
    rows = [(i, '{"%s": "C:/a.locked", "N": 7, "x": null}' % k) for i, k in enumerate(spellings)]
    rows += [(90, '{"Target_Filename": null, "targetfilename": "a.locked"}'), (91, '{"target": "a.locked"}'), (92, "[1]"), (93, None),
             (94, '{"target_filename": "clean", "TargetFilename": "a.locked"}')]
    df = spark.createDataFrame(rows, "event_id int, raw string").withColumn("body", F.try_parse_json("raw"))
    rule = {"id": "R", "detection": {"selection": {"target_filename|endswith": ".locked"}, "condition": "selection"}}
    got = {r.event_id for r in rules.gate(df, [rule]).where(F.size("matches") > 0).collect()}
    assert got == {0, 1, 2, 3, 4, 5, 90}  # the very key wins over other spellings
    number = {"id": "N", "detection": {"selection": {"n|gte": 7}}}
    assert {r.event_id for r in rules.gate(df, [number]).where(F.size("matches") > 0).collect()} == {0, 1, 2, 3, 4, 5}


def test_values_of_every_hit(spark):
    rng = random.Random(5)
    rows = [(i, rng.choice([None, "a", "b"]), rng.choice([None, "h1", "h2", "h3", "h4"]), rng.randrange(60) * 10 * windows.SECOND) for i in range(120)]
    events = spark.createDataFrame(rows, "event_id long, user string, host string, ts_us long")
    spans = windows.value_spans(events, ["user"], "host", "ts_us", 100)
    assert spans.count() <= len(rows)
    found = sorted(map(tuple, windows.hit_values(events, spans, ["user"], "host", "ts_us", 100).select("event_id", "host").collect()))
    assert found == sorted({(i, h) for i, u, _, t in rows for _, v, h, at in rows if h and v == u and t - 100 * windows.SECOND <= at <= t})
