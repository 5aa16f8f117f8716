"""Word lists, patterns, thresholds and rule tables.

Fixed values: results depend on them, so they are stated plainly and in order.
Patterns are Java regular expressions that RE2 reads the same way.
"""

from __future__ import annotations

from dataclasses import dataclass, field

# --- fixed values: log line formats -----------------------------------------
SYSLOG = r"^(\w+\s+\d+\s+\d+:\d+:\d+)\s+(\S+)\s+(\S+?)(?:\[(\d+)\])?:\s+(.+)"
STRICT_SYSLOG = r"^(\w{3}\s+\d{1,2}\s+\d{2}:\d{2}:\d{2})\s+(\S+)\s+(\S+?)(?:\[(\d+)\])?:\s+(.*)$"
ACCESS = r'^([\d\.]+)\s+-\s+-\s+\[([^\]]+)\]\s+"(\w+)\s+(\S+)\s+HTTP/[\d\.]+"\s+(\d+)\s+(\d+|-)'

# --- fixed values: named log patterns (name, pattern, severity) --------------
LOG_PATTERNS = [
    ("SSH_FAILED_LOGIN", r"Failed password for .+ from ([\d\.]+)", "warning"),
    ("SSH_SUCCESSFUL_LOGIN", r"Accepted password for (.+) from ([\d\.]+)", "info"),
    ("SUDO_COMMAND", r"sudo:?\s+(\w+)\s+:.*COMMAND=(.+)", "info"),
    ("SEGFAULT", r"segfault at", "error"),
    ("OUT_OF_MEMORY", r"Out of memory|OOM|killed process", "critical"),
    ("KERNEL_PANIC", r"kernel panic|fatal exception", "critical"),
    ("SERVICE_START", r"Started|Starting (.+)", "info"),
    ("SERVICE_STOP", r"Stopped|Stopping (.+)", "info"),
    ("DISK_ERROR", r"I/O error|disk error|read error", "error"),
    ("NETWORK_ERROR", r"Connection refused|Connection timed out|Network unreachable", "error"),
    ("AUTHENTICATION_FAILURE", r"authentication failure|auth failed|invalid user", "warning"),
    ("PRIVILEGE_ESCALATION", r"gained privileges|escalated to root|became root", "warning"),
    ("MALWARE_SIGNATURE", r"malware|virus|trojan|backdoor|rootkit", "critical"),
    ("BRUTE_FORCE", r"multiple failed|repeated attempts|brute.?force", "warning"),
]

# --- fixed values: severity words --------------------------------------------
LEVEL_WORDS = [
    ("critical", ["panic", "fatal", "critical"]),
    ("error", ["error", "fail", "exception"]),
    ("warning", ["warn", "warning"]),
    ("info", ["info", "notice"]),
]
COLLECTOR_WORDS = [
    ("critical", ["critical", "fatal", "emergency", "panic"]),
    ("error", ["error", "fail", "failed", "denied", "refused"]),
    ("warning", ["warning", "warn", "timeout", "retry"]),
    ("info", ["info", "notice", "accepted", "started", "opened"]),
    ("debug", ["debug", "trace"]),
]
SEVERITY_RULES = [
    ("critical", ["kernel panic", "segfault", "out of memory", "authentication failure.*root", "POSSIBLE BREAK-IN"]),
    ("high", ["error", "failed", "denied", "unauthorized", "attack"]),
    ("medium", ["warning", "timeout", "retry"]),
    ("low", ["info", "notice", "debug"]),
]
TRIAGE_WORDS = [
    ("critical", ["failed password", "authentication failure", "root login", "out of memory", "kernel panic",
                  "segfault", "exploit", "unauthorized", "malware", "virus", "attack", "breach", "invalid user",
                  "fatal", "panic"]),
    ("high", ["error", "failed", "denied", "refused", "killed", "crash", "terminated", "timeout", "unreachable",
              "down", "block"]),
    ("medium", ["warning", "deprecated", "retry", "slow", "high usage"]),
]
RISK_WORDS = [
    ("critical", 0.95, ["failed password", "authentication failure", "root login", "out of memory", "kernel panic",
                        "segfault", "exploit", "unauthorized", "malware", "virus", "attack", "breach"]),
    ("high", 0.75, ["error", "failed", "denied", "refused", "killed", "crash", "terminated", "timeout",
                    "unreachable", "down"]),
    ("medium", 0.50, ["warning", "deprecated", "retry", "slow", "high usage", "threshold", "limit"]),
    ("low", 0.20, ["started", "stopped", "completed", "success", "info", "listening", "connected"]),
]
RISK_BY_LEVEL = [
    ("critical", "critical", 0.95),
    ("error", "high", 0.70),
    ("warning", "medium", 0.50),
    ("info", "low", 0.20),
    ("debug", "low", 0.10),
]
RISK_DEFAULT = ("medium", 0.40)
THREAT_TYPES = [
    ("Authentication Attack", ["failed password", "authentication", "invalid user"]),
    ("Brute Force Attack", ["brute", "multiple failed"]),
    ("Resource Exhaustion", ["out of memory", "oom"]),
    ("Access Denied", ["denied", "refused", "block"]),
    ("System Crash", ["segfault", "crash", "panic"]),
    ("Malware Detection", ["malware", "virus", "trojan"]),
    ("Exploit Attempt", ["exploit", "injection", "xss"]),
    ("Firewall Event", ["ufw", "firewall", "iptables"]),
    ("SSH Security Event", ["sshd", "ssh"]),
    ("System Error", ["error", "failed"]),
]
THREAT_DEFAULT = "Security Event"
SERVICE_WORDS = [("sshd", "sshd"), ("kernel", "kernel"), ("systemd", "systemd"), ("nginx", "nginx"),
                 ("apache", "apache2"), ("audit", "audit")]
PATTERN_SEVERITY = [
    ("Critical", ["MALWARE", "KERNEL_PANIC", "OUT_OF_MEMORY", "BRUTE_FORCE"]),
    ("Warning", ["SSH_FAILED_LOGIN", "AUTHENTICATION_FAILURE", "PRIVILEGE_ESCALATION"]),
]

# --- fixed values: authentication messages ------------------------------------
AUTH_PATTERNS = [
    ("login_success", r"Accepted\s+(password|publickey)\s+for\s+(\S+)\s+from\s+(\S+)"),
    ("login_failure", r"Failed\s+(password|publickey)\s+for\s+(?:invalid user\s+)?(\S+)\s+from\s+(\S+)"),
    ("sudo", r"(\S+)\s+:\s+.*COMMAND=(.*)"),
    ("session_open", r"session opened for user (\S+)"),
    ("session_close", r"session closed for user (\S+)"),
]

# --- fixed values: line filters ------------------------------------------------
EXCLUDE_LINES = [r"^\s*$", r"CRON\[.*\]: \(root\)"]
ALWAYS_INCLUDE_LINES = ["error", "fail", "attack", "unauthorized", "denied", "critical"]
TAMPER_STATEMENTS = [r"DELETE FROM", r"DROP TABLE", r"TRUNCATE", r"UPDATE.*SET.*hash", r"ALTER TABLE"]

# --- fixed values: log features --------------------------------------------------
SEVERITY_SCORES = {
    "debug": 0.1, "info": 0.2, "notice": 0.3, "warning": 0.5, "warn": 0.5, "error": 0.7, "err": 0.7,
    "critical": 0.9, "crit": 0.9, "alert": 0.95, "emergency": 1.0, "emerg": 1.0,
}
SEVERITY_DEFAULT = 0.3
SUSPICIOUS_PATTERNS = [
    (r"failed\s+password", "auth_failure", 0.7),
    (r"authentication\s+failure", "auth_failure", 0.7),
    (r"invalid\s+user", "invalid_user", 0.6),
    (r"connection\s+refused", "conn_refused", 0.4),
    (r"permission\s+denied", "perm_denied", 0.5),
    (r"segfault|segmentation\s+fault", "crash", 0.8),
    (r"out\s+of\s+memory|oom", "resource_exhaustion", 0.9),
    (r"root\s+login", "root_access", 0.6),
    (r"sudo|su\s+:", "privilege_escalation", 0.5),
    (r"cron|scheduled", "scheduled_task", 0.2),
    (r"ssh|sshd", "ssh_activity", 0.3),
    (r"firewall|iptables|nftables", "firewall_event", 0.4),
    (r"malware|virus|trojan", "malware_indicator", 1.0),
    (r"brute\s*force|bruteforce", "brute_force", 0.9),
    (r"scan|nmap|masscan", "scanning", 0.7),
]
IP_ADDRESS = r"\b(?:\d{1,3}\.){3}\d{1,3}\b"
PORT_MENTION = r"(?i)\bport[:\s]+(\d+)\b|\b:(\d{2,5})\b"
PATH_MENTION = r"[/\\][\w./\\-]+"
SENSITIVE_PATHS = ["/etc/passwd", "/etc/shadow", "/etc/sudoers", ".ssh", "id_rsa", "authorized_keys", "/root",
                   "/home", "c:\\users", "password", "secret", "credential", "token", ".env", "config", ".git"]
SAFE_PORTS = [22, 80, 443, 53, 25, 587, 993, 995, 3306, 5432, 27017]
SOURCE_SENSITIVITY = {"auth": 0.6, "secure": 0.6, "syslog": 0.3, "kernel": 0.5, "cron": 0.2, "messages": 0.3}
SOURCE_SENSITIVITY_DEFAULT = 0.3
ENTROPY_BITS = 6.6
PRIVATE_IPV4 = (r"0*10\.\d+\.\d+\.\d+|0*172\.0*(?:1[6-9]|2\d|3[01])\.\d+\.\d+|0*192\.0*168\.\d+\.\d+"
                r"|0*127\.\d+\.\d+\.\d+")

# --- fixed values: ordered feature names ------------------------------------------
LOG_FEATURES = [
    "message_length", "word_count", "uppercase_ratio", "digit_ratio", "special_char_ratio", "severity_score",
    "hour_of_day", "day_of_week", "is_business_hours", "is_weekend", "max_pattern_score", "avg_pattern_score",
    "pattern_count", "ip_count", "has_private_ip", "port_count", "has_unusual_port", "path_count",
    "has_sensitive_path", "source_sensitivity", "entropy",
]
PROCESS_FEATURES = [
    "cpu_percent", "memory_percent", "resource_total", "connection_count", "open_files_count", "children_count",
    "name_length", "cmdline_length", "is_suspicious_name", "has_suspicious_in_cmdline", "is_root",
    "is_service_account", "has_shell_operators", "has_redirection", "has_encoded_data", "has_network_args",
    "hour_of_day", "is_business_hours",
]
NETWORK_FEATURES = [
    "local_port_normalized", "remote_port_normalized", "is_privileged_local", "is_privileged_remote",
    "is_common_port", "is_high_port", "is_local_loopback", "is_remote_loopback", "is_remote_private",
    "is_remote_public", "is_tcp", "is_udp", "status_score", "bytes_sent_normalized", "bytes_recv_normalized",
    "data_ratio_normalized", "has_process", "is_suspicious_process", "hour_of_day", "is_business_hours",
]
METRIC_FEATURES = [
    "cpu_percent", "memory_percent", "disk_percent", "high_cpu", "high_memory", "high_disk", "overall_stress",
    "disk_io_read_normalized", "disk_io_write_normalized", "disk_io_total", "net_bytes_sent_normalized",
    "net_bytes_recv_normalized", "net_total", "process_count_normalized", "high_process_count", "hour_of_day",
    "is_business_hours",
]
FEATURES = {"log": LOG_FEATURES, "process": PROCESS_FEATURES, "network": NETWORK_FEATURES, "metric": METRIC_FEATURES}

# --- fixed values: processes and connections -----------------------------------------
TOOL_NAMES = ["nc", "netcat", "ncat", "nmap", "masscan", "zmap", "hydra", "medusa", "john", "hashcat", "mimikatz",
              "msfconsole", "meterpreter", "powershell", "cmd.exe", "wget", "curl", "fetch"]
ROOT_USERS = ["root", "SYSTEM", "Administrator"]
SERVICE_PREFIXES = ["_", "sys", "daemon"]
SHELL_OPERATORS = ["|", "&&", "||", ";", "`", "$("]
REDIRECTIONS = [">", ">>", "<", "2>&1"]
ENCODED_MARKERS = ["base64", "-enc", "-e "]
NETWORK_ARGS = ["-p ", "--port", "::", "http", "tcp", "udp"]
STATUS_SCORES = {"established": 0.3, "listen": 0.2, "time_wait": 0.4, "close_wait": 0.5, "syn_sent": 0.6,
                 "syn_recv": 0.5, "fin_wait": 0.4, "closing": 0.4}
STATUS_DEFAULT = 0.3
PROCESS_PATHS = ["/tmp/", "/dev/shm/", "/var/tmp/", "C:\\Temp\\", "C:\\Users\\Public\\", "/home/",
                 "\\AppData\\Local\\Temp\\"]
PROCESS_NAMES = ["nc", "ncat", "netcat", "nmap", "masscan", "mimikatz", "pwdump", "procdump", "powershell",
                 "cmd.exe", "wscript", "cscript", "python", "perl", "ruby", "bash", "sh"]
PROCESS_PORTS = [4444, 5555, 6666, 1234, 31337, 12345]
PROCESS_COMMANDS = ["base64", "eval", "exec", "wget", "curl", "-e ", "nc -", "bash -i", "python -c",
                    "powershell -enc", "IEX", "Invoke-Expression"]
PROCESS_FAMILIES = [
    ("remote_access", ["ssh", "sshd"]),
    ("web_server", ["apache", "nginx", "httpd", "iis"]),
    ("database", ["mysql", "postgres", "mongo", "redis"]),
    ("container", ["docker", "containerd", "kubelet"]),
]
PORT_NAMES = {4444: "metasploit_default", 5555: "common_backdoor", 6666: "irc_backdoor", 31337: "elite_backdoor",
              12345: "netbus", 1234: "common_rat", 8080: "http_alt", 3389: "rdp", 22: "ssh", 23: "telnet",
              445: "smb", 135: "rpc", 139: "netbios"}
CONNECTION_TOOLS = ["nc", "netcat", "ncat", "nmap"]
PORT_TAGS = [(80, "http"), (443, "https"), (22, "ssh"), (3389, "rdp")]
METRIC_BANDS = {"cpu": (80.0, 95.0), "memory": (85.0, 95.0), "disk": (85.0, 95.0)}
WINDOWS_TYPES = {1: "error", 2: "warning", 4: "info", 8: "info", 16: "warning"}

# --- fixed values: detectors and score bands -----------------------------------------
METHOD_WEIGHTS = {"statistical": 0.4, "isolation_forest": 0.3, "pattern": 0.2, "temporal": 0.1}
ANOMALY_BANDS = [("critical", 0.95), ("high", 0.8), ("medium", 0.6)]
THREAT_BANDS = [("critical", 0.9), ("high", 0.7), ("medium", 0.5), ("low", 0.3)]
ENSEMBLE = [(2.5, 0.5), (3.0, 0.6), (3.5, 0.7)]
SEVERITY_RANK = ["low", "medium", "high", "critical"]
EULER = 0.5772156649
AUTH_FAILURE_WORDS = ["failed password", "authentication failure", "invalid user"]


@dataclass(frozen=True)
class Rule:
    """One detection rule; a rule fires when any of its patterns does."""

    rule_id: str
    name: str
    category: str
    severity: float
    log_patterns: list[str] = field(default_factory=list)
    process_patterns: list[str] = field(default_factory=list)
    port_ranges: list[tuple[int, int]] = field(default_factory=list)
    ports: list[int] = field(default_factory=list)
    public_ip: bool = False
    window_seconds: int = 300
    min_occurrences: int = 1
    tactics: list[str] = field(default_factory=list)
    techniques: list[str] = field(default_factory=list)
    actions: list[str] = field(default_factory=list)


# --- fixed values: default detection rules --------------------------------------------
RULES = [
    Rule("AUTH-001", "SSH Brute Force Attempt", "authentication", 0.8,
         log_patterns=[r"sshd.*failed password", r"sshd.*invalid user", r"sshd.*authentication failure"],
         min_occurrences=3, tactics=["TA0006", "TA0001"], techniques=["T1110", "T1110.001"],
         actions=["Review source IP addresses", "Consider implementing fail2ban",
                  "Enable SSH key-based authentication"]),
    Rule("AUTH-002", "Root Login Attempt", "authentication", 0.7,
         log_patterns=[r"sshd.*root.*accepted", r"login.*root.*success", r"su.*root"],
         tactics=["TA0004"], techniques=["T1078.003"],
         actions=["Verify if root login is expected", "Disable direct root SSH access", "Implement sudo policies"]),
    Rule("RECON-001", "Network Enumeration", "reconnaissance", 0.6,
         process_patterns=[r"nmap", r"masscan", r"zmap", r"netdiscover", r"arp-scan"],
         tactics=["TA0007"], techniques=["T1046", "T1040"],
         actions=["Verify if scan is authorized", "Review source user and system", "Check for compromised systems"]),
    Rule("EXPLOIT-001", "Reverse Shell Indicator", "exploitation", 0.95,
         log_patterns=[r"reverse shell", r"connect back"],
         process_patterns=[r"nc\s+-e", r"bash\s+-i\s+>&", r"/dev/tcp/", r"mkfifo.*nc", r"python.*socket.*connect"],
         tactics=["TA0002", "TA0011"], techniques=["T1059", "T1071"],
         actions=["Immediately isolate affected system", "Capture forensic evidence", "Identify and block C2 IP",
                  "Initiate incident response"]),
    Rule("PERSIST-001", "Cron Job Modification", "persistence", 0.7,
         log_patterns=[r"crontab.*modified", r"CROND.*CMD", r"/etc/cron"], process_patterns=[r"crontab\s+-[ei]"],
         tactics=["TA0003"], techniques=["T1053.003"],
         actions=["Review cron job changes", "Compare with baseline configuration",
                  "Check for unauthorized entries"]),
    Rule("MALWARE-001", "Cryptominer Indicators", "malware", 0.8,
         log_patterns=[r"mining pool", r"stratum", r"cryptonight"],
         process_patterns=[r"xmrig", r"minerd", r"cpuminer", r"stratum\+tcp", r"nicehash"],
         tactics=["TA0040"], techniques=["T1496"],
         actions=["Kill mining processes", "Check for persistence mechanisms", "Review initial access vector",
                  "Check for other compromised systems"]),
    Rule("C2-001", "Suspicious Outbound Connection", "command_control", 0.6,
         port_ranges=[(8080, 8090), (4443, 4445), (9000, 9999)], public_ip=True,
         tactics=["TA0011"], techniques=["T1571", "T1071"],
         actions=["Investigate destination IP reputation", "Review process making connection",
                  "Check for data exfiltration"]),
    Rule("ABUSE-001", "Resource Exhaustion", "resource_abuse", 0.6,
         log_patterns=[r"out of memory", r"oom[-_]killer", r"no space left", r"fork\(\) failed"],
         tactics=["TA0040"], techniques=["T1499"],
         actions=["Identify resource-consuming processes", "Check for DoS attack indicators",
                  "Review system limits"]),
]
RULE_CONFIDENCE = {"log": 0.8, "process": 0.85, "network": 0.75}
WINDOWED_BONUS = 0.1

# --- fixed values: attack chains, stages in order ----------------------------------------
ATTACK_CHAINS = {
    "reconnaissance_to_exploitation": [
        {"source_type": "network", "contains": "scan"},
        {"source_type": "log", "contains": "auth"},
        {"source_type": "process", "min_score": 0.6},
    ],
    "credential_stuffing": [
        {"source_type": "log", "contains": "failure"},
        {"source_type": "log", "contains": "failure"},
        {"source_type": "log", "contains": "success"},
    ],
    "lateral_movement": [
        {"source_type": "process", "contains": "suspicious"},
        {"source_type": "network", "contains": "internal"},
        {"source_type": "log", "contains": "login"},
    ],
    "data_exfiltration": [
        {"source_type": "process", "min_score": 0.5},
        {"source_type": "network", "contains": "transfer"},
    ],
}

# --- fixed values: responses ------------------------------------------------------------
PROTECTED_TARGETS = ["root", "SYSTEM", "Administrator", "127.0.0.1", "localhost", "systemd", "init", "kernel"]
ASSESS_TECHNIQUES = {"log": ["T1078 - Valid Accounts", "T1110 - Brute Force"],
                     "process": ["T1059 - Command Line", "T1106 - Native API"],
                     "network": ["T1071 - Application Layer Protocol"]}
ASSESS_ACTIONS = {
    "critical": ["Immediately isolate affected system", "Alert security team", "Capture forensic evidence"],
    "high": ["Investigate anomaly immediately", "Check for related events",
             "Consider isolation if attack confirmed"],
    "other": ["Monitor for additional anomalies", "Review system logs"],
}
ASSESS_SOURCE_ACTION = {"log": "Check authentication logs", "process": "Review running processes",
                        "network": "Analyze network traffic"}
CORRELATION_ACTIONS = ["Review correlated events", "Check for ongoing attack"]
CHAIN_ACTIONS = ["Immediately isolate affected systems", "Initiate incident response procedures",
                 "Capture forensic evidence", "Review all related events"]
INTEGRITY_ACTIONS = {
    "chain": ["CRITICAL: Backup database chain compromised", "Isolate backup server immediately",
              "Check for unauthorized access to backup system", "Preserve all logs for forensic analysis"],
    "tampered": ["Records have been modified in the primary database",
                 "Review recent access logs for suspicious activity", "Check for compromised credentials",
                 "Consider restoring data from backup"],
    "missing": ["Records have been deleted from primary database", "Attacker may be attempting to cover tracks",
                "Preserve backup database for evidence", "Initiate incident response procedure"],
    "always": ["Review system access logs", "Check for unauthorized processes",
               "Consider isolating affected system", "Document all findings for forensics"],
}
GENESIS = "genesis-v1"
