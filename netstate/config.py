"""Options of the library, with their default values."""
from __future__ import annotations

from dataclasses import dataclass, replace

# ---------------------------------------------------------------------------
# Field aliases, label rules, stage order, tactic ids, port lists.
# They have to be equal to the values users of flow exports already rely on.
# ---------------------------------------------------------------------------
COLUMN_ALIASES = {
    "timestamp": ["Timestamp", "timestamp", "time", "Time", "Date", "ts", "start_time", "Flow Start Time", "Stime"],
    "src_ip": ["Src IP", "src_ip", "Source IP", "source_ip", "srcip", "sa"],
    "dst_ip": ["Dst IP", "dst_ip", "Destination IP", "destination_ip", "dstip", "da"],
    "src_port": ["Src Port", "src_port", "Source Port", "source_port", "sport"],
    "dst_port": ["Dst Port", "dst_port", "Destination Port", "destination_port", "dport", "dsport",
                 "Destination Port Number"],
    "protocol": ["Protocol", "protocol", "proto", "IP Protocol", "ip_proto"],
    "label": ["Label", "label", "attack", "Attack", "attack_cat", "category", "Category", "class", "Class"],
    "flow_duration": ["Flow Duration", "flow_duration", "duration", "Duration", "dur"],
    "fwd_packets": ["Tot Fwd Pkts", "Total Fwd Packets", "fwd_packets", "total_fwd_packets", "spkts"],
    "bwd_packets": ["Tot Bwd Pkts", "Total Backward Packets", "bwd_packets", "total_bwd_packets", "dpkts"],
    "fwd_bytes": ["TotLen Fwd Pkts", "Total Length of Fwd Packets", "fwd_bytes", "total_fwd_bytes", "sbytes"],
    "bwd_bytes": ["TotLen Bwd Pkts", "Total Length of Bwd Packets", "bwd_bytes", "total_bwd_bytes", "dbytes"],
    "iat_mean": ["Flow IAT Mean", "flow_iat_mean", "iat_mean"],
    "iat_std": ["Flow IAT Std", "flow_iat_std", "iat_std"],
    "iat_max": ["Flow IAT Max", "flow_iat_max", "iat_max"],
    "ttl": ["TTL", "ttl", "ttl_mean", "sttl"],
    "win_fwd": ["Init Fwd Win Byts", "Init_Win_bytes_forward", "swin", "tcp_window", "TCP Window Size", "window_size"],
    "win_bwd": ["Init Bwd Win Byts", "Init_Win_bytes_backward", "dwin"],
    "retransmissions": ["Retransmission Count", "retransmissions", "retransmission_count", "sloss"],
    "pktlen_mean": ["Pkt Len Mean", "Packet Length Mean", "pkt_len_mean"],
    "pktlen_std": ["Pkt Len Std", "Packet Length Std", "pkt_len_std"],
    "syn": ["SYN Flag Cnt", "SYN Flag Count", "syn_count"],
    "ack": ["ACK Flag Cnt", "ACK Flag Count", "ack_count"],
    "rst": ["RST Flag Cnt", "RST Flag Count", "rst_count"],
    "fin": ["FIN Flag Cnt", "FIN Flag Count", "fin_count"],
    "psh": ["PSH Flag Cnt", "PSH Flag Count", "psh_count"],
    "urg": ["URG Flag Cnt", "URG Flag Count", "urg_count"],
}
BENIGN = "Benign"
BENIGN_LABELS = ["benign", "normal", "0"]
EXACT_LABELS = {
    "ftp-bruteforce": "Credential Access",
    "ssh-bruteforce": "Credential Access",
    "brute force -web": "Credential Access",
    "brute force -xss": "Initial Access",
    "sql injection": "Initial Access",
    "infilteration": "Lateral Movement",
    "infiltration": "Lateral Movement",
    "bot": "Command and Control",
    "botnet": "Command and Control",
    "heartbleed": "Initial Access",
    "portscan": "Reconnaissance",
    "reconnaissance": "Reconnaissance",
    "exfiltration": "Exfiltration",
}
LABEL_PATTERNS = [
    ("ddos", "Impact"),
    ("dos", "Impact"),
    ("fuzzer|fuzz", "Command and Control"),
    ("brute", "Credential Access"),
    ("xss|sql|web attack|exploit", "Initial Access"),
    ("infil", "Lateral Movement"),
    ("bot", "Command and Control"),
    ("scan|recon", "Reconnaissance"),
    ("exfil", "Exfiltration"),
]
STAGE_ORDER = ["Benign", "Reconnaissance", "Initial Access", "Credential Access", "Discovery", "Lateral Movement",
               "Command and Control", "Exfiltration", "Impact"]
TACTIC_IDS = {
    "Reconnaissance": "TA0043",
    "Initial Access": "TA0001",
    "Credential Access": "TA0006",
    "Discovery": "TA0007",
    "Lateral Movement": "TA0008",
    "Command and Control": "TA0011",
    "Exfiltration": "TA0010",
    "Impact": "TA0040",
}
WELL_KNOWN_PORTS = [20, 21, 22, 23, 25, 53, 80, 110, 123, 135, 139, 143, 443, 445, 3389, 8080, 8443]
PROTOCOL_NUMBERS = {"tcp": 6, "udp": 17, "icmp": 1, "icmpv6": 58, "sctp": 132, "gre": 47}
SPLIT_LETTERS = {"T": "train", "V": "val", "E": "test"}
SCENARIOS = {
    "rate_limit": ("Rate-limit / block suspicious source",
                   {"flow_count": 0.5, "packets_total": 0.5, "bytes_total": 0.5, "pkt_rate_mean": 0.5,
                    "byte_rate_mean": 0.5, "syn_count": 0.4, "unique_dst_ports": 0.4, "scan_score": 0.1,
                    "failed_flow_ratio": 0.3, "small_flow_ratio": 0.4, "syn_ratio": 0.5, "rst_ratio": 0.4}),
    "isolate_host": ("Isolate affected host",
                     {"flow_count": 0.1, "packets_total": 0.1, "bytes_total": 0.1, "pkt_rate_mean": 0.1,
                      "byte_rate_mean": 0.1, "syn_count": 0.05, "ack_count": 0.1, "rst_count": 0.1, "fin_count": 0.1,
                      "psh_count": 0.1, "unique_dst_ports": 0.1, "scan_score": 0.0, "failed_flow_ratio": 0.1,
                      "small_flow_ratio": 0.1, "syn_ratio": 0.2, "rst_ratio": 0.1}),
}
SCENARIO_RATIOS = ["scan_score", "failed_flow_ratio", "small_flow_ratio", "syn_ratio", "rst_ratio",
                   "well_known_dst_port_ratio"]


@dataclass(frozen=True)
class Options:
    """All settings of the library; derive variants with :meth:`having`."""

    # time grid
    window_seconds: int = 10
    history: int = 12                     # windows a forecast looks back on (L)
    horizon: int = 6                      # windows a forecast looks ahead (H)
    max_gap_windows: int = 6
    min_segment_windows: int | None = None
    # labels
    min_attack_flows: int = 3
    min_attack_fraction: float = 0.01
    unknown_stage: str = "Initial Access"
    # flow features
    port_buckets: tuple[int, ...] = tuple(WELL_KNOWN_PORTS)
    well_known_ports: tuple[int, ...] = tuple(WELL_KNOWN_PORTS)
    small_flow_packets: float = 3.0
    rate_clip: float = 1e6
    duration_divisor: float = 1e6
    iat_divisor: float = 1e6
    timestamp_format: str | None = None   # None = elect one per file
    approximate_distinct: bool = False
    # scaling
    clip: float = 10.0
    # split
    split_strategy: str = "blocked"       # blocked | day_chronological | chronological
    block_windows: int = 90
    block_pattern: str = "TTTVTTTETE"
    train_fraction: float = 0.70
    val_fraction: float = 0.10
    # calibration and alerts
    target_fpr: float = 0.05
    fallback_threshold: float = 0.5
    watch_ratio: float = 0.70
    critical_margin: float = 0.5
    persistence: int = 2
    clear_ratio: float = 0.80
    clear_windows: int = 3
    cooldown_windows: int = 6
    lookback_windows: int | None = None
    # physical design: positions per time chunk (the unit of parallelism along a source)
    chunk_windows: int = 4096
    seed: int = 42

    @property
    def min_segment(self) -> int:
        return self.min_segment_windows or self.history + self.horizon + 1

    @property
    def lookback(self) -> int:
        return self.lookback_windows or self.horizon

    @property
    def split_parts(self) -> list[str]:
        return [SPLIT_LETTERS[c] for c in self.block_pattern.upper()]

    def having(self, **changes) -> "Options":
        return replace(self, **changes)
