"""Fixed values.

These tables and numbers are inputs of the computations, not logic: changing one changes results.
They are stated as text, in their natural order.  Two file-name needles that carry a product name are
left out of KEYWORD_TECHNIQUES and of shipped rule DR-0007; deployments add their own through the
``extra_keywords`` argument or a rules directory.
"""

# --- telemetry sources -------------------------------------------------------------------------
SOURCE_ALIASES = {
    "ad_auth": "active_directory",
    "ad": "active_directory",
    "windows_security": "windows",
    "firewall_dns": "dns",
    "network_firewall": "firewall",
}
FALLBACK_SOURCE = "synthetic"
SOURCE_CONFIDENCE = {
    "sysmon": 0.9,
    "windows": 0.85,
    "zeek": 0.85,
    "suricata": 0.8,
    "firewall": 0.75,
    "dns": 0.7,
    "edr": 0.9,
    "active_directory": 0.95,
    "cloudtrail": 0.9,
    "kubernetes": 0.85,
    "email": 0.6,
    "threat_intel": 0.95,
    "synthetic": 0.5,
}
SYSMON_TYPES = {
    1: "process_create", 3: "network_connection", 5: "process_terminate", 7: "image_load",
    8: "create_remote_thread", 10: "process_access", 11: "file_create", 12: "registry_event",
    13: "registry_event", 22: "dns_query", 23: "file_delete",
}
DIRECTORY_TYPES = {
    4624: "logon", 4625: "logon_failure", 4672: "special_privileges_assigned",
    4688: "process_create", 4720: "account_created", 4728: "group_membership_change",
}

# --- identity and technique tagging ------------------------------------------------------------
USER_ALIASES = {
    "jdoe": "jdoe", "john.doe": "jdoe", "asmith": "asmith", "alice.smith": "asmith",
    "mchen": "mchen", "administrator": "administrator", "svc-backup": "svc-backup",
}
KEYWORD_TECHNIQUES = {
    "T1566.001": ["email_received", "attachment"],
    "T1566.002": ["email_link_click"],
    "T1204.002": ["docm", "macro"],
    "T1059.001": ["-enc ", "-encodedcommand", "frombase64string", "powershell"],
    "T1027": ["-enc ", "frombase64string", "obfuscat"],
    "T1003.001": ["lsass", "sekurlsa", "mimikatz", "procdump"],
    "T1021.002": ["admin$", "\\\\c$", "psexec", "wmic /node"],
    "T1570": ["wmic /node", "psexec"],
    "T1486": [".locked", ".encrypted", "howtodecrypt", "how_to_decrypt"],
    "T1071.004": ["dns_query"],
    "T1078": ["logon", "valid account"],
    "T1098": ["root", "stoplogging", "deletetrail"],
    "T1562.001": ["stoplogging", "deletetrail", "disassociateencryptionconfig", "deletedetector"],
    "T1609": ["pods/exec"],
    "T1610": ["privileged", "hostpath"],
    "T1082": ["systeminfo", "uname -a"],
    "T1087": ["net user", "net group"],
}
TECHNIQUE_CATALOG = {
    "T1566.001": ("Phishing: Spearphishing Attachment", "initial-access"),
    "T1566.002": ("Phishing: Spearphishing Link", "initial-access"),
    "T1204.002": ("User Execution: Malicious File", "execution"),
    "T1059.001": ("Command and Scripting Interpreter: PowerShell", "execution"),
    "T1059": ("Command and Scripting Interpreter", "execution"),
    "T1027": ("Obfuscated Files or Information", "defense-evasion"),
    "T1003.001": ("OS Credential Dumping: LSASS Memory", "credential-access"),
    "T1003": ("OS Credential Dumping", "credential-access"),
    "T1078": ("Valid Accounts", "persistence"),
    "T1021.002": ("Remote Services: SMB/Windows Admin Shares", "lateral-movement"),
    "T1570": ("Lateral Tool Transfer", "lateral-movement"),
    "T1486": ("Data Encrypted for Impact", "impact"),
    "T1071.004": ("Application Layer Protocol: DNS", "command-and-control"),
    "T1568.002": ("Dynamic Resolution: Domain Generation Algorithms", "command-and-control"),
    "T1098": ("Account Manipulation", "persistence"),
    "T1562.001": ("Impair Defenses: Disable or Modify Tools", "defense-evasion"),
    "T1609": ("Container Administration Command", "execution"),
    "T1610": ("Deploy Container", "defense-evasion"),
    "T1190": ("Exploit Public-Facing Application", "initial-access"),
    "T1210": ("Exploitation of Remote Services", "lateral-movement"),
    "T1068": ("Exploitation for Privilege Escalation", "privilege-escalation"),
    "T1082": ("System Information Discovery", "discovery"),
    "T1087": ("Account Discovery", "discovery"),
    "T1489": ("Service Stop", "impact"),
    "T1005": ("Data from Local System", "collection"),
}
DEFAULT_CRITICALITY = 0.3

# --- scoring -----------------------------------------------------------------------------------
SEVERITIES = ["informational", "low", "medium", "high", "critical"]
SEVERITY_WEIGHT = {"informational": 0.1, "low": 0.3, "medium": 0.55, "high": 0.8, "critical": 1.0}
SUSPICIOUS_HINTS = [
    "mimikatz", "procdump", "psexec", "wmic /node", "certutil -urlcache",
    "-enc ", "-encodedcommand", "frombase64string", "sekurlsa",
]
BENIGN_HINTS = [
    "svc-sccm", "taskeng.exe", "sccm", "patch-compliance", "patch_compliance",
    "invoke-sccmpatch", "monthly-patch", "change-managed", "softwarecenter",
]
ENSEMBLE_WEIGHTS = {"rule": 0.35, "heuristic": 0.15, "graph": 0.20, "intel": 0.15, "ml": 0.15}
SELF_WEIGHTS = [0.9, 0.6, 0.7, 0.8, 1.0, 0.5, 0.4]
NEIGHBOR_WEIGHTS = [0.5, 0.4, 0.5, 0.6, 0.7, 0.3, 0.2]
NEIGHBOR_BIAS = -1.2
MIN_ALERT_SCORE = 0.3
FEATURE_WINDOW_SECONDS = 300

# --- graph -------------------------------------------------------------------------------------
LOGON_TYPES = ["logon", "logon_failure", "special_privileges_assigned"]
NETWORK_TYPES = ["network_connection", "network_alert", "zeek_conn", "firewall_connection"]
MAX_OBSERVATIONS = 25
NODE_TYPES = [
    "User", "Host", "Process", "File", "IP", "Domain", "URL", "Hash", "RegistryKey", "Alert",
    "DetectionRule", "Email", "CloudResource", "K8sWorkload", "AttackTechnique", "Incident",
]
EDGE_TYPES = [
    "logged_in_to", "spawned", "executed", "connected_to", "resolved_to", "downloaded", "modified",
    "authenticated_to", "created", "accessed", "emailed", "triggered", "related_to", "observed_in",
    "mapped_to_technique",
]

# --- clustering --------------------------------------------------------------------------------
CLUSTER_WINDOW_SECONDS = 45 * 60
OVERLAP_THRESHOLD = 0.15

# --- evidence ----------------------------------------------------------------------------------
EMAIL_PATTERN = r"[a-zA-Z0-9_.+-]+@[a-zA-Z0-9-]+\.[a-zA-Z0-9-.]+"
EMAIL_TOKEN = "[REDACTED_EMAIL]"
IPV4_PATTERN = r"\b(\d{1,3}\.\d{1,3}\.\d{1,3})\.\d{1,3}\b"
INJECTION_PATTERNS = [
    r"ignore (all|any|previous|the above)\s+instructions?",
    r"disregard (the )?(above|prior|previous)",
    r"you are now",
    r"new instructions?:",
    r"system prompt",
    r"act as (an?|the)",
    r"reveal (your|the) (system )?prompt",
    r"</?(system|assistant|user)>",
    r"\bmark (this|it) as (benign|false.positive|resolved)\b",
    r"do not (flag|alert|report)",
]
INJECTION_TOKEN = "[REDACTED_SUSPECTED_INSTRUCTION]"
EVIDENCE_TEXT_LIMIT = 1500
EVIDENCE_KINDS = ["case", "alert", "event", "node"]
MAX_EVIDENCE_ITEMS = 40
EVENTS_PER_ENTITY = 10
DIGEST_EDGES = 8
CITATION_PATTERN = r"\[([A-Za-z0-9_-]+)\]"
TECHNIQUE_OBJECTIVES = [
    ("T1486", "ransomware_deployment"),
    ("T1490", "ransomware_deployment"),
    ("T1489", "impact_service_disruption"),
    ("T1021", "credential_access_and_lateral_movement"),
    ("T1570", "credential_access_and_lateral_movement"),
    ("T1003", "credential_access_and_lateral_movement"),
    ("T1078", "credential_access_and_lateral_movement"),
    ("T1110", "credential_access_and_lateral_movement"),
    ("T1566", "initial_access_phishing"),
    ("T1204", "initial_access_phishing"),
    ("T1071", "command_and_control"),
    ("T1573", "command_and_control"),
    ("T1583", "infrastructure_reconnaissance"),
    ("T1059", "suspicious_scripting_or_execution"),
    ("T1027", "defense_evasion"),
    ("T1055", "defense_evasion"),
]
LIKELY_BENIGN_BELOW = 0.45

# --- response policy ---------------------------------------------------------------------------
TACTIC_OBJECTIVES = {
    "impact": "ransomware",
    "credential-access": "credential_access",
    "lateral-movement": "lateral_movement",
    "initial-access": "phishing",
    "command-and-control": "c2_beacon",
    "discovery": "recon",
    "collection": "recon",
    "persistence": "credential_access",
    "privilege-escalation": "credential_access",
    "defense-evasion": "recon",
    "execution": "recon",
}
OBJECTIVE_PRIORITY = [
    "ransomware", "credential_access", "lateral_movement", "c2_beacon", "phishing", "recon", "benign",
]
OBJECTIVES = [
    "ransomware", "credential_access", "lateral_movement", "phishing", "c2_beacon", "recon", "benign",
]
OBJECTIVE_NEEDLES = [
    ("ransomware", "ransomware"),
    ("phishing", "phishing"),
    ("initial_access", "phishing"),
    ("credential", "credential_access"),
    ("lateral", "lateral_movement"),
    ("command_and_control", "c2_beacon"),
    ("c2", "c2_beacon"),
    ("beacon", "c2_beacon"),
    ("benign", "benign"),
    ("recon", "recon"),
    ("infrastructure", "c2_beacon"),
]
ACTIONS = [
    "notify", "collect_data", "create_ticket", "quarantine_recommend", "disable_account_recommend",
    "isolate_host_recommend", "block_ioc_recommend", "ignore", "enrich", "escalate",
]
DISRUPTIVE_ACTIONS = [
    "quarantine_recommend", "disable_account_recommend", "isolate_host_recommend", "block_ioc_recommend",
]
# objective, playbook id, primary action, title, severity if executed, allowed actions
PLAYBOOKS = [
    ("ransomware", "PB-CONTAIN-RANSOMWARE", "isolate_host_recommend",
     "Contain suspected ransomware host", "high",
     ["isolate_host_recommend", "quarantine_recommend", "escalate"]),
    ("credential_access", "PB-CRED-ACCESS-RESPONSE", "isolate_host_recommend",
     "Contain credential-dumping host and reset affected credentials", "high",
     ["isolate_host_recommend", "disable_account_recommend", "escalate"]),
    ("lateral_movement", "PB-LATERAL-MOVEMENT", "isolate_host_recommend",
     "Isolate hosts participating in lateral movement", "medium",
     ["isolate_host_recommend", "collect_data"]),
    ("phishing", "PB-PHISHING-RESPONSE", "disable_account_recommend",
     "Disable compromised account and quarantine phishing artifact", "medium",
     ["disable_account_recommend", "create_ticket", "notify"]),
    ("c2_beacon", "PB-BLOCK-C2", "block_ioc_recommend",
     "Block command-and-control indicators at the perimeter", "medium",
     ["block_ioc_recommend", "collect_data"]),
    ("recon", "PB-COLLECT-EVIDENCE", "collect_data",
     "Collect additional evidence for reconnaissance activity", "low",
     ["collect_data", "enrich", "notify"]),
    ("benign", None, "ignore", "No action -- likely benign", "informational", ["ignore", "notify"]),
]
LINUCB_ALPHA = 0.6

# --- approvals and ledger ----------------------------------------------------------------------
ROLE_RANK = {"analyst": 1, "senior_analyst": 2, "admin": 3}
GENESIS_HASH = "0" * 64
