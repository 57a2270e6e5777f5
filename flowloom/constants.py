"""Thresholds and fixed vocabularies of the detectors, the alert policy and the incident rules."""

# Windows, in microseconds where a name ends in _US.
SECOND_US = 1_000_000
WINDOW_US = 5 * SECOND_US
CONTEXT_WINDOW_US = 5 * SECOND_US

# Packet and flow detectors.
FRAGMENT_FLOOD = 30
ICMP_FLOOD = 100
STEALTH_PACKETS, STEALTH_PORTS = 5, 3
ACK_SCAN_PORTS = 10
SYN_FLOOD_HALF_OPEN, SYN_FLOOD_PORTS = 30, 3
SLOWLORIS_CONNECTIONS, SLOWLORIS_PACKETS, SLOWLORIS_WINDOWS, SLOWLORIS_PERSISTENT = 20, 12, 3, 10
SCAN_HISTORY_US, SLOW_SCAN_DISTINCT, DEST_SCAN_DISTINCT = 300 * SECOND_US, 15, 20
EPISODE_GAP_US = 60 * SECOND_US

# TCP flag bits.
FIN, SYN, RST, PSH, ACK, URG = 1, 2, 4, 8, 16, 32
BASE_FLAGS = 63

# Campaign labels and the model's alert bound.
SCAN_RATIO = 3
LABEL_SCAN_PORTS, LABEL_ATTACK_FLOWS, LABEL_FEW_PORTS, LABEL_SUSPICIOUS, LABEL_FLOOD_RATIO, LABEL_SCAN_RATIO = 10, 10, 3, 5, 5, 3
MODEL_CONFIDENCE = 0.70

# Alert policy.
COOLDOWN_US = 60 * SECOND_US
FAMILY = {
    "port_scan": "recon", "slow_scan": "recon", "distributed_scan": "recon", "udp_scan": "recon", "stealth_scan": "evasion", "fragmented_scan": "evasion", "ack_scan": "evasion",
    "brute_force": "access", "dos": "flood", "syn_flood": "flood", "icmp_flood": "flood", "slowloris": "flood", "anomaly": "anomaly", "suspicious": "unclassified",
}
COVERED_BY = {"recon": ["evasion"]}
GENERIC = ("slow_scan", "distributed_scan", "suspicious")

# Incidents and campaigns.
INCIDENT_GAP_US, SLOW_INCIDENT_GAP_US, CAMPAIGN_GAP_US = 300 * SECOND_US, 1800 * SECOND_US, 120 * SECOND_US
HIGH_IMPACT, EVASION = ("dos", "flood", "slowloris"), ("fragment", "stealth", "ack_scan")
RANK = {"HIGH": 3, "MEDIUM": 2, "LOW": 1}
MULTI_SOURCE, BRUTE_HIGH, SCAN_MEDIUM, OTHER_MEDIUM = 3, 5, 3, 3
LOW_CONFIDENCE = 0.60
PLACEHOLDERS = ("unknown", "multiple")

# Names under which alert files give their fields.
SOURCE_KEYS = ("src", "src_ip", "source", "source_ip", "attacker", "ip")
TARGET_KEYS = ("dst", "dst_ip", "destination", "dest", "target")
KIND_KEYS = ("type", "attack_type", "attack", "label", "kind", "prediction")
TIME_KEYS = ("timestamp", "time", "ts", "window_start", "start")
CONFIDENCE_KEYS = ("confidence", "conf", "probability", "score")

# Evaluation.
SCAN_KINDS = ("port_scan", "udp_scan", "stealth_scan", "ack_scan", "fragmented_scan")
GENERIC_RECON = ("slow_scan", "distributed_scan")
CAPTURE_CAP, SPLIT_SHARE = 3000, 0.5

# Columns of training tables.
FLOW_METADATA = ("window_time", "is_ipv6")
LABEL_CANDIDATES = ("label", "Label", "class", "target", "attack", "type")
FLOW_TABLE_NAMES = {
    "Destination Port": "destination_port", "Total Fwd Packets": "total_fwd_packets", "Total Length of Fwd Packets": "fwd_bytes",
    "Fwd Packet Length Max": "fwd_pkt_len_max", "Fwd Packet Length Min": "fwd_pkt_len_min", "Fwd Packet Length Mean": "fwd_pkt_len_mean", "Fwd Packet Length Std": "fwd_pkt_len_std",
    "Bwd Packet Length Max": "bwd_pkt_len_max", "Bwd Packet Length Mean": "bwd_pkt_len_mean", "Packet Length Mean": "pkt_len_mean", "Packet Length Std": "pkt_len_std",
    "Flow IAT Mean": "flow_iat_mean", "Flow IAT Std": "flow_iat_std", "Flow IAT Max": "flow_iat_max", "Flow IAT Min": "flow_iat_min",
    "Flow Bytes/s": "flow_bytes_per_sec", "Flow Packets/s": "flow_packets_per_sec", "FIN Flag Count": "fin_count", "PSH Flag Count": "psh_count", "ACK Flag Count": "ack_count",
}

# The ephemeral range, and empty windows in a row before a warning.
EPHEMERAL_PORT, EMPTY_WINDOWS = 32768, 12

# What a source's connection attempts look like, and the words of a notice.
HINT_ONE_PORT, HINT_SCAN, HINT_MIXED = "one port hammered (flood / brute-force)", "many different ports (scan)", "mixed"
NOTICE_START, NOTICE_MORE, NOTICE_UPGRADE = "ALERT: ", " similar since last notice: ", " [more specific than the earlier notice]"
