"""Detection rules: rule documents become boolean columns over an event table.

A rule is a dict with ``id``, ``title``, ``level``, ``technique_ids``, ``detection`` (named blocks of
``field|modifier: value(s)`` plus a boolean ``condition``) and optionally ``correlation``.  All rules
are evaluated in one scan: each becomes one boolean expression, and literals are lower-cased once
when the rule is compiled.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, functions as F

from watchtide import fixed
from watchtide.functions.core import all_of, any_of, chosen, compact, fence, lookup

# --- fixed values: field vocabulary and the shipped rules ---------------------------------------
FIELD_ALIASES = {
    "image": "process",
    "parent_image": "parent_process",
    "target_filename": "file_path",
    "dns_query": "domain",
    "attachment_name": "file_path",
    "attachment_hash": "file_hash",
    "mitre_techniques": "technique_ids",
    "technique_id": "technique_ids",
}
RAW_ALIASES = {"zeek_log_type": "log_type", "k8s_resource": "resource", "k8s_verb": "verb"}
# (id, title, level, detection blocks, condition, techniques, correlation)
SHIPPED = [
    ("DR-0001", "Encoded or obfuscated PowerShell", "high",
     {"selection": {"image|endswith": "powershell.exe", "command_line|contains": [
         "-enc ", "-encodedcommand", "frombase64string", "-nop -w hidden", "-windowstyle hidden", "downloadstring"]}},
     "selection", ["T1059.001", "T1027"], None),
    ("DR-0002", "Office program starts a shell", "high",
     {"selection": {"parent_image|endswith": ["winword.exe", "excel.exe", "outlook.exe", "powerpnt.exe"],
                    "image|endswith": ["powershell.exe", "cmd.exe", "wscript.exe", "cscript.exe", "mshta.exe", "rundll32.exe"]}},
     "selection", ["T1566.001", "T1204.002", "T1059.001"], None),
    ("DR-0003", "LSASS memory access", "critical",
     {"selection": {"command_line|contains": ["comsvcs.dll", "minidump", "sekurlsa", "lsass.dmp", "procdump", "lsass_1.dmp"]}},
     "selection", ["T1003.001"], None),
    ("DR-0004", "Remote execution with PsExec", "high",
     {"selection": {"command_line|contains": ["psexesvc", "psexec"]}}, "selection", ["T1021.002", "T1570"], None),
    ("DR-0005", "Remote process creation through WMI", "high",
     {"selection": {"image|endswith": "wmic.exe", "command_line|contains": ["/node:", "process call create"]}},
     "selection", ["T1047", "T1021.006"], None),
    ("DR-0006", "Privileged remote desktop logon", "medium",
     {"selection": {"event_id": 4624, "logon_type": 10}}, "selection", ["T1021.001"], None),
    ("DR-0007", "Burst of ransomware file extensions", "critical",
     {"selection": {"target_filename|contains": [".locked", ".encrypted", ".crypt"]}}, "selection", ["T1486"], None),
    ("DR-0008", "Ransom note dropped", "critical",
     {"selection": {"target_filename|contains": ["README_RECOVER", "HOW_TO_DECRYPT", "DECRYPT_INSTRUCTIONS", "HowToDecrypt"]}},
     "selection", ["T1486", "T1491.001"], None),
    ("DR-0009", "Mail failed authentication and was delivered", "high",
     {"selection": {"spf": "fail", "dmarc": "fail"}, "filter_clean": {"verdict": "clean"}},
     "selection and not filter_clean", ["T1566.001", "T1566.002"], None),
    ("DR-0010", "Macro-enabled attachment", "medium",
     {"selection": {"attachment_name|endswith": [".docm", ".xlsm", ".pptm"]}}, "selection", ["T1566.001", "T1204.002"], None),
    ("DR-0011", "Sensitive cloud action without MFA", "high",
     {"selection": {"event_name": ["ConsoleLogin", "CreateAccessKey", "AttachUserPolicy", "CreateUser"], "mfa_used": "No"}},
     "selection", ["T1078.004", "T1098"], None),
    ("DR-0012", "Cloud privilege escalation", "high",
     {"selection": {"event_name": ["AttachUserPolicy", "PutUserPolicy", "CreateAccessKey", "AddUserToGroup"]}},
     "selection", ["T1098", "T1078.004"], None),
    ("DR-0013", "Long DNS query", "medium",
     {"selection": {"zeek_log_type": "dns", "dns_query_length|gt": 40}}, "selection", ["T1071.004", "T1568"], None),
    ("DR-0014", "Rare process ancestry", "medium",
     {"selection": {"parent_image|endswith": ["wmiprvse.exe", "taskeng.exe", "services.exe"],
                    "image|endswith": ["powershell.exe", "cmd.exe", "rundll32.exe", "wscript.exe"]},
      "filter_signed": {"signed": True}}, "selection and not filter_signed", ["T1059", "T1055"], None),
    ("DR-0016", "Trojan signature on an encrypted channel", "high",
     {"selection": {"alert_category|contains": "Trojan"}}, "selection", ["T1071.001", "T1573"], None),
    ("DR-0018", "Service ticket request pattern", "medium",
     {"selection": {"event_id": 4769, "service_name|contains": "cifs/"}}, "selection", ["T1558.003"], None),
    ("DR-0019", "Known malicious infrastructure contacted again", "high",
     {"selection": {"dns_query": ["api.cloudsync-telemetry.com", "secure-office365-update.com", "cdn-office-update-cache.net"]}},
     "selection", ["T1583.001", "T1071.001"], None),
    ("DR-0020", "Debug privilege assigned", "high",
     {"selection": {"event_id": 4672, "privilege_list|contains": "SeDebugPrivilege"}}, "selection", ["T1078", "T1134"], None),
    ("DR-0021", "One identity on several hosts", "high", {}, "correlation", ["T1021", "T1078"],
     {"type": "distinct_count", "group_by": ["user"], "distinct_field": "host", "min_distinct": 3, "window_seconds": 600}),
]


def shipped_rules() -> list[dict]:
    return [
        {"id": i, "title": title, "level": level, "detection": {**blocks, "condition": cond},
         "technique_ids": techniques, **({"correlation": corr} if corr else {})}
        for i, title, level, blocks, cond, techniques, corr in SHIPPED
    ]


# --- matching one value ------------------------------------------------------------------------

def _values(expected) -> list:
    return expected if isinstance(expected, list) else [expected]


def _text(value) -> str:
    return str(value).lower()


def _number(value) -> float | None:
    try:
        return float(value)
    except (TypeError, ValueError):
        return None


def match_value(actual: Column, expected, modifier: str, kind: str = "string", mode: str = "service") -> Column:
    """Does ``actual`` satisfy ``field|modifier: expected``?  Never null.

    ``kind`` is string, array or boolean.  In service mode a list is compared by membership; in
    evaluator mode every element is tried with the modifier.
    """
    needles = _values(expected)
    if modifier == "exists":
        return actual.isNotNull()
    if modifier == "not_exists":
        return actual.isNull()
    if mode == "evaluator" and modifier in ("contains", "startswith", "endswith"):
        needles = [n for n in needles if isinstance(n, str)]
    words = [_text(n) for n in needles]
    if kind == "array":
        if mode == "service" and modifier in ("", "contains"):
            lowered = F.transform(actual, lambda x: F.lower(x.cast("string")))
            return F.coalesce(F.arrays_overlap(lowered, F.array(*[F.lit(w) for w in words])), F.lit(False))
        if mode == "evaluator":
            return F.coalesce(F.exists(actual, lambda x: match_value(x, expected, modifier, "string", mode)), F.lit(False))
        actual = actual.cast("string")
    if modifier in ("gt", "gte", "lt", "lte"):
        bounds = [n for n in map(_number, needles if mode == "evaluator" else needles[:1]) if n is not None]
        num = actual.try_cast("double")
        compare = {"gt": num.__gt__, "gte": num.__ge__, "lt": num.__lt__, "lte": num.__le__}[modifier]
        return F.coalesce(any_of([compare(F.lit(b)) for b in bounds]), F.lit(False))
    if kind == "boolean" and modifier == "" and mode == "service":
        wanted = {n if isinstance(n, bool) else _text(n).strip() in ("true", "1", "yes") if isinstance(n, str) else bool(n) for n in needles}
        return F.coalesce(any_of([actual == F.lit(w) for w in wanted]), F.lit(False))
    low = F.lower(actual.cast("string"))
    if modifier == "contains":
        hit = any_of([F.contains(low, F.lit(w)) for w in words])
    elif modifier == "startswith":
        hit = any_of([F.startswith(low, F.lit(w)) for w in words])
    elif modifier == "endswith":
        hit = any_of([F.endswith(low, F.lit(w)) for w in words])
    else:
        hit = low.isin(words) if words else F.lit(False)
    return F.coalesce(hit, F.lit(False))


# --- finding the value of a rule field ---------------------------------------------------------

KEYS = "_raw_keys"


def _folded(name: str) -> str:
    return name.replace("_", "").lower()


def folded_keys(body: Column) -> Column:
    """Top-level entries of a raw payload with folded keys (lower case, no underscores), in order of the keys; no nulls.

    Worked out once per event; a rule field then looks its folded name up.
    """
    entries = F.array_sort(F.map_entries(F.from_json(F.to_json(body), "map<string,string>")))
    return F.transform(F.filter(entries, lambda e: e["value"].isNotNull()), lambda e: F.struct(
        F.lower(F.replace(e["key"], F.lit("_"), F.lit(""))).alias("key"), e["value"].alias("value")))


class FieldResolver:
    """Maps rule field names to columns of an event table.

    ``service`` mode reads canonical columns first (so ``event_id`` is the event's own id) and then
    the raw payload by loose key spelling.  ``evaluator`` mode reads the flattened vocabulary, where
    ``event_id`` is the log's numeric code.
    """

    def __init__(self, df: DataFrame, mode: str = "service", body: str = "body"):
        self.mode, self.body = mode, body
        self.types = dict(df.dtypes)

    def _typed(self, name: str) -> tuple[Column, str]:
        t = self.types[name]
        kind = "array" if t.startswith("array") else "boolean" if t == "boolean" else "string"
        return F.col(name), kind

    def _raw(self, name: str) -> Column:
        """The payload's value under this very key, else under the first key that is the same when folded."""
        exact = F.try_variant_get(F.col(self.body), f"$['{name}']", "string")
        keys = F.col(KEYS) if KEYS in self.types else folded_keys(F.col(self.body))
        return F.coalesce(exact, F.try_element_at(F.filter(keys, lambda e: e["key"] == F.lit(_folded(name))), F.lit(1))["value"])

    def resolve(self, name: str) -> tuple[Column, str]:
        name = name.lower()
        if self.mode == "evaluator":
            return self._typed(name) if name in self.types else (F.lit(None).cast("string"), "string")
        if name == "dns_query_length":
            return F.coalesce(F.length("domain"), F.lit(0)), "string"
        if name in ("alert_category", "alert_severity"):
            return F.try_variant_get(F.col(self.body), "$.alert." + name[6:], "string"), "string"
        column = FIELD_ALIASES.get(name, name)
        has_raw = self.body in self.types
        if column in self.types and column != self.body:
            value, kind = self._typed(column)
            if kind == "string" and has_raw:
                value = value.cast("string")
                return F.coalesce(F.when(value != "", value), self._raw(RAW_ALIASES.get(name, name))), kind
            return value, kind
        if has_raw:
            return self._raw(RAW_ALIASES.get(name, name)), "string"
        return F.lit(None).cast("string"), "string"


# --- rules to columns --------------------------------------------------------------------------
_WORD = re.compile(r"[A-Za-z_][A-Za-z0-9_]*")


def block_column(block: dict, fields: FieldResolver) -> Column:
    """AND over the block's field predicates."""
    preds = []
    for key, expected in block.items():
        name, _, modifier = str(key).partition("|")
        value, kind = fields.resolve(name)
        if fields.mode == "evaluator" and modifier in ("eq", "equals"):
            modifier = ""
        preds.append(match_value(value, expected, modifier, kind, fields.mode))
    return all_of(preds)


def block_columns(rule: dict, fields: FieldResolver) -> dict[str, Column]:
    detection = rule.get("detection") or {}
    out = {n: block_column(b, fields) for n, b in detection.items() if n != "condition" and isinstance(b, dict)}
    if fields.mode == "service":
        out.setdefault("correlation", F.lit(True))  # decided later, by the correlation operators
    return out


def condition_column(rule: dict, blocks: list[str], flags: str, mode: str) -> Column:
    """The rule's condition as a Spark expression over the block flags in struct column ``flags``.

    Only block names, and / or / not and brackets are let through.  Anything else means all blocks
    but the filters in service mode, and no match in evaluator mode.
    """
    text = ((rule.get("detection") or {}).get("condition") or "selection").strip()
    fallback = F.lit(False) if mode == "evaluator" else all_of(
        [F.col(f"{flags}.{n}") for n in blocks if not n.startswith("filter")])
    words = set(_WORD.findall(text))
    if not words <= {*blocks, "and", "or", "not"} or _WORD.sub("", text).strip("() \t"):
        return fallback
    try:
        compile(text, "<condition>", "eval")  # names, and / or / not and brackets read the same in both languages
    except SyntaxError:
        return fallback
    return F.expr(_WORD.sub(lambda m: f"{flags}.`{m[0]}`" if m[0] in blocks else m[0], text))


def matched_evidence(rule: dict, fields: FieldResolver) -> Column:
    """Map of ``block.field`` -> value for the blocks that matched."""
    parts = []
    for name, block in (rule.get("detection") or {}).items():
        if name == "condition" or not isinstance(block, dict):
            continue
        hit = block_column(block, fields)
        for key in block:
            field = str(key).partition("|")[0]
            value, _ = fields.resolve(field)
            parts.append(F.when(hit, F.struct(F.lit(f"{name}.{field}").alias("key"), value.cast("string").alias("value"))))
    if not parts:
        return F.create_map().cast("map<string,string>")
    return F.map_from_entries(F.array_distinct(compact(*parts)))


def gate(events: DataFrame, rules: list[dict], mode: str = "service", evidence: bool = False,
         group: int = 100) -> DataFrame:
    """Add ``matches``: array of rule structs whose single-event gate the event passes.

    Long rule sets are evaluated in groups of ``group`` so generated code stays compilable.
    """
    out = events
    if mode == "service" and "body" in events.columns:
        out = out.withColumn(KEYS, fence(folded_keys(F.col("body"))))
    names = []
    for start in range(0, max(len(rules), 1), group):
        part = rules[start:start + group]
        fields = FieldResolver(out, mode)
        blocks = [block_columns(r, fields) for r in part]
        flags = [F.struct(*[c.alias(n) for n, c in b.items()]).alias(f"r{i}") for i, b in enumerate(blocks) if b]
        if flags:
            out = out.withColumn("_blocks", F.struct(*flags))
        structs = []
        for i, rule in enumerate(part):
            cols = [
                F.lit(rule.get("id", "unknown")).alias("rule_id"),
                F.lit(rule.get("title", rule.get("id", "unknown"))).alias("rule_name"),
                F.lit(rule.get("level") or rule.get("severity") or "medium").alias("severity"),
                F.array(*[F.lit(t) for t in rule.get("technique_ids", [])]).cast("array<string>").alias("technique_ids"),
                F.lit(rule.get("description", rule.get("title", ""))).alias("description"),
                F.lit(bool(rule.get("correlation"))).alias("correlated"),
            ]
            if evidence:
                cols.append(matched_evidence(rule, fields).alias("evidence"))
            hit = condition_column(rule, list(blocks[i]), f"_blocks.r{i}", mode)
            structs.append((hit, F.struct(*cols)))
        name = f"_m{start}"
        out = out.withColumn(name, chosen(*structs) if structs else compact()).drop("_blocks")
        names.append(name)
    merged = F.concat(*[F.col(n) for n in names]) if len(names) > 1 else F.col(names[0])
    return out.withColumn("matches", fence(merged)).drop(*names, KEYS)


def catalog(spark, rules: list[dict]) -> DataFrame:
    """Rules as a table."""
    rows = [(r.get("id", "unknown"), r.get("title", r.get("id", "unknown")),
             r.get("level") or r.get("severity") or "medium", list(r.get("technique_ids", [])),
             (r.get("detection") or {}).get("condition", "selection"), bool(r.get("correlation"))) for r in rules]
    return spark.createDataFrame(
        rows, "rule_id string, title string, level string, technique_ids array<string>, condition string, correlated boolean")


def severity_weight(severity: Column, default: float = 0.5) -> Column:
    return F.coalesce(lookup(fixed.SEVERITY_WEIGHT, severity), F.lit(default))
