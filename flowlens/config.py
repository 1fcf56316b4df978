"""Dataset configuration: which columns are features, label, identity and time.

Every operator takes a :class:`DatasetConfig` (or plain column lists), so the same
code runs on network-flow CSVs and on the driver's parquet tables.
"""
from __future__ import annotations

from dataclasses import dataclass, field, replace

# ---------------------------------------------------------------------------
# Fixed values (must equal the reference's for identical results).
# ---------------------------------------------------------------------------

# Identity / leakage columns dropped before modelling.
LEAKAGE_COLUMNS = (
    "Flow ID", "Source IP", "Src IP", "Destination IP", "Dst IP", "Source Port", "Src Port",
    "Destination Port", "Dst Port", "Timestamp", "Unnamed: 0",
)

# Enterprise flow dataset (dataset 1): mandatory numeric features, in order.
ENTERPRISE_FEATURES = (
    "Flow Duration", "Total Fwd Packets", "Total Backward Packets", "Total Length of Fwd Packets",
    "Total Length of Bwd Packets", "Fwd Packet Length Max", "Fwd Packet Length Min",
    "Fwd Packet Length Mean", "Fwd Packet Length Std", "Bwd Packet Length Max",
    "Bwd Packet Length Min", "Bwd Packet Length Mean", "Bwd Packet Length Std", "Flow Bytes/s",
    "Flow Packets/s", "Flow IAT Mean", "Flow IAT Std", "Flow IAT Max", "Flow IAT Min",
    "Fwd IAT Total", "Fwd IAT Mean", "Fwd IAT Std", "Fwd IAT Max", "Fwd IAT Min", "Bwd IAT Total",
    "Bwd IAT Mean", "Bwd IAT Std", "Bwd IAT Max", "Bwd IAT Min", "Fwd PSH Flags", "Bwd PSH Flags",
    "Fwd URG Flags", "Bwd URG Flags", "Fwd Header Length", "Bwd Header Length", "Fwd Packets/s",
    "Bwd Packets/s", "Min Packet Length", "Max Packet Length", "Packet Length Mean",
    "Packet Length Std", "Packet Length Variance", "FIN Flag Count", "SYN Flag Count",
    "RST Flag Count", "PSH Flag Count", "ACK Flag Count", "URG Flag Count", "CWE Flag Count",
    "ECE Flag Count", "Down/Up Ratio", "Average Packet Size", "Avg Fwd Segment Size",
    "Avg Bwd Segment Size", "Subflow Fwd Packets", "Subflow Fwd Bytes", "Subflow Bwd Packets",
    "Subflow Bwd Bytes", "Init_Win_bytes_forward", "Init_Win_bytes_backward", "act_data_pkt_fwd",
    "min_seg_size_forward", "Active Mean", "Active Std", "Active Max", "Active Min", "Idle Mean",
    "Idle Std", "Idle Max", "Idle Min",
)
ENTERPRISE_VALID_LABELS = (
    "BENIGN", "Bot", "DDoS", "DoS GoldenEye", "DoS Hulk", "DoS Slowhttptest", "DoS slowloris",
    "FTP-Patator", "Heartbleed", "Infiltration", "PortScan", "SSH-Patator",
    "Web Attack - Brute Force", "Web Attack - Sql Injection", "Web Attack - XSS",
)
ENTERPRISE_NON_NEGATIVE = (
    "Flow Duration", "Total Fwd Packets", "Total Backward Packets", "Total Length of Fwd Packets",
    "Total Length of Bwd Packets", "Flow Bytes/s", "Flow Packets/s",
)

# IoT flow dataset (dataset 2).
IOT_FEATURES = (
    "flow_duration", "Header_Length", "Protocol Type", "Duration", "Rate", "Srate", "Drate",
    "fin_flag_number", "syn_flag_number", "rst_flag_number", "psh_flag_number", "ack_flag_number",
    "ece_flag_number", "cwr_flag_number", "ack_count", "syn_count", "fin_count", "urg_count",
    "rst_count", "HTTP", "HTTPS", "DNS", "Telnet", "SMTP", "SSH", "IRC", "TCP", "UDP", "DHCP",
    "ARP", "ICMP", "IPv", "LLC", "Tot sum", "Min", "Max", "AVG", "Std", "Tot size", "IAT",
    "Number", "Magnitue", "Radius", "Covariance", "Variance", "Weight",
)
IOT_FAMILIES = ("BenignTraffic", "DDoS", "DoS", "Recon", "Web", "BruteForce", "Spoofing", "Mirai")
IOT_NON_NEGATIVE = ("flow_duration", "Header_Length", "Duration", "Rate", "Tot sum", "Tot size")

# IoT sub-label -> family (label consolidation); unknown labels pass through.
IOT_FAMILY_MAP = (
    ("BenignTraffic", "BenignTraffic"), ("DDoS-RSTFINFlood", "DDoS"), ("DDoS-PSHACK_Flood", "DDoS"),
    ("DDoS-SYN_Flood", "DDoS"), ("DDoS-UDP_Flood", "DDoS"), ("DDoS-TCP_Flood", "DDoS"),
    ("DDoS-ICMP_Flood", "DDoS"), ("DDoS-SynonymousIP_Flood", "DDoS"),
    ("DDoS-ACK_Fragmentation", "DDoS"), ("DDoS-UDP_Fragmentation", "DDoS"),
    ("DDoS-ICMP_Fragmentation", "DDoS"), ("DDoS-SlowLoris", "DDoS"), ("DDoS-HTTP_Flood", "DDoS"),
    ("DoS-UDP_Flood", "DoS"), ("DoS-TCP_Flood", "DoS"), ("DoS-SYN_Flood", "DoS"),
    ("DoS-HTTP_Flood", "DoS"), ("Mirai-greeth_flood", "Mirai"), ("Mirai-greip_flood", "Mirai"),
    ("Mirai-udpplain", "Mirai"), ("Recon-PingSweep", "Recon"), ("Recon-OSScan", "Recon"),
    ("Recon-PortScan", "Recon"), ("VulnerabilityScan", "Recon"), ("Recon-HostDiscovery", "Recon"),
    ("DNS_Spoofing", "Spoofing"), ("MITM-ArpSpoofing", "Spoofing"), ("Benign", "BenignTraffic"),
    ("BrowserHijacking", "Web"), ("Backdoor_Malware", "Web"), ("XSS", "Web"),
    ("SqlInjection", "Web"), ("CommandInjection", "Web"), ("DictionaryBruteForce", "BruteForce"),
)

# Five-category taxonomy: (raw_label, dataset, category, severity, description).
TAXONOMY = (
    ("BENIGN", "cicids2017", "Normal", "none", "Benign/background traffic."),
    ("DoS Hulk", "cicids2017", "DoS", "high", "HTTP flood DoS tool (Hulk)."),
    ("DoS GoldenEye", "cicids2017", "DoS", "high", "HTTP flood DoS tool (GoldenEye)."),
    ("DoS slowloris", "cicids2017", "DoS", "medium", "Low-bandwidth slow-connection DoS, harder to spot by volume alone."),
    ("DoS Slowhttptest", "cicids2017", "DoS", "medium", "Low-bandwidth slow-HTTP DoS."),
    ("DDoS", "cicids2017", "DoS", "critical", "Distributed DoS — multiple sources, larger blast radius than single-host DoS."),
    ("Heartbleed", "cicids2017", "DoS", "critical", "OpenSSL heartbeat memory-disclosure vulnerability — can leak private keys/credentials, not just availability impact despite the DoS bucket."),
    ("PortScan", "cicids2017", "Probe", "low", "Port scanning — reconnaissance, no direct damage but precedes targeted attacks."),
    ("FTP-Patator", "cicids2017", "R2L", "medium", "FTP credential brute-force."),
    ("SSH-Patator", "cicids2017", "R2L", "medium", "SSH credential brute-force."),
    ("Web Attack – Brute Force", "cicids2017", "R2L", "medium", "Web login brute-force."),
    ("Web Attack – XSS", "cicids2017", "R2L", "high", "Cross-site scripting injection."),
    ("Web Attack – Sql Injection", "cicids2017", "R2L", "high", "SQL injection — can lead to full data exposure."),
    ("Infiltration", "cicids2017", "U2R", "critical", "Attacker has already infiltrated a host via a dropped payload."),
    ("Bot", "cicids2017", "U2R", "high", "Host compromised and acting as part of a botnet."),
    ("BenignTraffic", "ciciot2023", "Normal", "none", "Benign/background IoT traffic."),
    ("DDoS-RSTFINFlood", "ciciot2023", "DoS", "high", "TCP RST/FIN flood DDoS."),
    ("DDoS-PSHACK_Flood", "ciciot2023", "DoS", "high", "TCP PSH-ACK flood DDoS."),
    ("DDoS-SYN_Flood", "ciciot2023", "DoS", "high", "TCP SYN flood DDoS."),
    ("DDoS-UDP_Flood", "ciciot2023", "DoS", "high", "UDP flood DDoS."),
    ("DDoS-TCP_Flood", "ciciot2023", "DoS", "high", "Generic TCP flood DDoS."),
    ("DDoS-ICMP_Flood", "ciciot2023", "DoS", "medium", "ICMP flood DDoS."),
    ("DDoS-SynonymousIP_Flood", "ciciot2023", "DoS", "high", "DDoS using spoofed/synonymous source IPs."),
    ("DDoS-ACK_Fragmentation", "ciciot2023", "DoS", "medium", "Fragmented ACK packet flood."),
    ("DDoS-UDP_Fragmentation", "ciciot2023", "DoS", "medium", "Fragmented UDP packet flood."),
    ("DDoS-ICMP_Fragmentation", "ciciot2023", "DoS", "medium", "Fragmented ICMP packet flood."),
    ("DDoS-SlowLoris", "ciciot2023", "DoS", "medium", "Low-bandwidth slow-connection DDoS variant."),
    ("DDoS-HTTP_Flood", "ciciot2023", "DoS", "high", "HTTP flood DDoS."),
    ("DoS-UDP_Flood", "ciciot2023", "DoS", "high", "Single-source UDP flood DoS."),
    ("DoS-SYN_Flood", "ciciot2023", "DoS", "high", "Single-source TCP SYN flood DoS."),
    ("DoS-TCP_Flood", "ciciot2023", "DoS", "high", "Single-source TCP flood DoS."),
    ("DoS-HTTP_Flood", "ciciot2023", "DoS", "high", "Single-source HTTP flood DoS."),
    ("Recon-PingSweep", "ciciot2023", "Probe", "low", "ICMP ping sweep — host discovery."),
    ("Recon-OSScan", "ciciot2023", "Probe", "low", "OS fingerprinting scan."),
    ("Recon-PortScan", "ciciot2023", "Probe", "low", "Port scanning."),
    ("VulnerabilityScan", "ciciot2023", "Probe", "medium", "Active vulnerability scanning — more targeted than a plain port scan."),
    ("Recon-HostDiscovery", "ciciot2023", "Probe", "low", "Host discovery sweep."),
    ("DNS_Spoofing", "ciciot2023", "R2L", "high", "DNS response spoofing — can redirect victims to malicious hosts."),
    ("MITM-ArpSpoofing", "ciciot2023", "R2L", "high", "ARP spoofing for man-in-the-middle positioning."),
    ("BrowserHijacking", "ciciot2023", "R2L", "high", "Browser session/settings hijacking."),
    ("Backdoor_Malware", "ciciot2023", "R2L", "critical", "Backdoor malware deployment — persistent unauthorized access."),
    ("CommandInjection", "ciciot2023", "R2L", "critical", "OS command injection — can lead to full host compromise."),
    ("SqlInjection", "ciciot2023", "R2L", "high", "SQL injection."),
    ("XSS", "ciciot2023", "R2L", "high", "Cross-site scripting injection."),
    ("Uploading_Attack", "ciciot2023", "R2L", "high", "Malicious file upload."),
    ("DictionaryBruteForce", "ciciot2023", "R2L", "medium", "Dictionary-based credential brute-force."),
    ("Mirai-greeth_flood", "ciciot2023", "U2R", "critical", "Mirai botnet GRE-over-Ethernet flood — host already compromised and attacking."),
    ("Mirai-greip_flood", "ciciot2023", "U2R", "critical", "Mirai botnet GRE-over-IP flood."),
    ("Mirai-udpplain", "ciciot2023", "U2R", "critical", "Mirai botnet plain UDP flood."),
)
CATEGORIES = ("Normal", "DoS", "Probe", "R2L", "U2R", "Other")
CATEGORY_DESCRIPTIONS = (
    ("Normal", "Benign traffic — no attack."),
    ("DoS", "Denial-of-Service / Distributed DoS: flooding or resource-exhaustion attacks that degrade or deny service availability."),
    ("Probe", "Reconnaissance/scanning: an attacker mapping hosts, ports, or vulnerabilities before a targeted attack."),
    ("R2L", "Remote-to-Local: an outside attacker gaining unauthorized access or executing commands on a host over the network (brute force, injection, spoofing)."),
    ("U2R", "User-to-Root / host compromise: malware or botnet activity that has already gained a foothold and is escalating privileges or acting as a compromised host."),
    ("Other", "Not yet mapped to a category — needs manual triage."),
)
DEFAULT_SEVERITY_BY_CATEGORY = (
    ("Normal", "none"), ("DoS", "high"), ("Probe", "low"), ("R2L", "medium"), ("U2R", "critical"),
    ("Other", "medium"),
)
UNKNOWN_CATEGORY = "Other"
UNKNOWN_SEVERITY = "medium"
ATTACK_CATEGORIES = ("DoS", "Probe", "R2L", "U2R")

# Benign label tokens (compared after trim + lower-case): the union of every place
# the reference defines "benign".
BENIGN_TOKENS = ("benign", "normal", "benigntraffic", "background", "0", "benign_final")

# Identity-like column name fragments (case-insensitive substring match).
IDENTITY_LEAK_PATTERNS = ("ip", "port", "flow id", "flow_id", "timestamp", "src mac", "dst mac")
# Identity-like names on token boundaries (regex, case-insensitive).
IDENTITY_NAME_REGEX = r"(?i)(^|[^a-z])(ip|port|flow[ _]?id|timestamp|mac)([^a-z]|$)"

# Spoofability name patterns; aggregate patterns are checked first.
ATTACKER_CONTROLLABLE_PATTERNS = (
    "flag", "ttl", "window", "port", "header", "payload", "protocol", "fin", "syn", "rst", "psh",
    "ack", "urg", "ece", "cwr", "len", "size",
)
AGGREGATE_PATTERNS = (
    "mean", "std", "avg", "variance", "var", "total", "rate", "iat", "duration", "count", "sum",
    "bytes/s", "packets/s",
)
SPOOF_AGGREGATE = "aggregate (harder to spoof)"
SPOOF_CONTROLLABLE = "attacker-controllable (per-packet field)"
SPOOF_UNCLASSIFIED = "unclassified — manual review"
SPOOF_WEIGHTS = ((SPOOF_CONTROLLABLE, 1.0), (SPOOF_UNCLASSIFIED, 0.5), (SPOOF_AGGREGATE, 0.2))

# Triage: labels that count as benign for the classifier output (upper-cased compare).
TRIAGE_BENIGN = ("BENIGN", "BENIGN_FINAL", "NORMAL")
ALERT_SEVERITIES = ("CRITICAL", "HIGH", "ZERO_DAY_SUSPECT", "MEDIUM")
SUSPECTED_ANOMALY = "Suspected_Anomaly"
SUSPECTED_ZERO_DAY = "Suspected_Zero_Day"

# Payload contract limits.
PAYLOAD_MAX_KEYS = 500
PAYLOAD_MAX_KEY_LEN = 100
PAYLOAD_MAX_TEXT_LEN = 200


@dataclass(frozen=True)
class DatasetConfig:
    """Column roles for one dataset."""
    name: str
    features: tuple[str, ...]
    label: str
    identity: tuple[str, ...] = LEAKAGE_COLUMNS
    valid_labels: tuple[str, ...] = ()
    non_negative: tuple[str, ...] = ()
    benign: tuple[str, ...] = BENIGN_TOKENS
    time_col: str | None = None
    key: tuple[str, ...] = ()           # stable row key used for deterministic ordering
    taxonomy_dataset: str | None = None
    family_map: tuple[tuple[str, str], ...] = ()
    extra: dict = field(default_factory=dict, compare=False, hash=False)

    def with_(self, **kw) -> "DatasetConfig":
        return replace(self, **kw)


ENTERPRISE = DatasetConfig(
    name="CICIDS2017", features=ENTERPRISE_FEATURES, label="Label",
    valid_labels=ENTERPRISE_VALID_LABELS, non_negative=ENTERPRISE_NON_NEGATIVE,
    taxonomy_dataset="cicids2017",
)
IOT = DatasetConfig(
    name="CIC-IoT2023", features=IOT_FEATURES, label="label",
    valid_labels=tuple(sorted(set(IOT_FAMILIES) | {k for k, _ in IOT_FAMILY_MAP})),
    non_negative=IOT_NON_NEGATIVE, taxonomy_dataset="ciciot2023", family_map=IOT_FAMILY_MAP,
)
PRESETS = {ENTERPRISE.name: ENTERPRISE, IOT.name: IOT}

# Stand-in configurations for the driver's tables (see SURVEY section 7.4).
LINEITEM_FLOWS = DatasetConfig(
    name="lineitem", features=("l_quantity", "l_extendedprice", "l_discount", "l_tax"),
    label="l_returnflag", identity=("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"),
    valid_labels=("A", "N"), non_negative=("l_quantity", "l_extendedprice"),
    benign=("n",), time_col="l_shipdate", key=("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"),
)
EVENTS_FLOWS = DatasetConfig(
    name="events", features=("value",), label="event_type", identity=("user_id",),
    valid_labels=("click", "view", "purchase", "signup"), non_negative=("value",),
    benign=("click", "view", "purchase", "signup"), time_col="ts", key=("event_id",),
)
