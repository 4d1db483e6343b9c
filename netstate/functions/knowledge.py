"""Words for people: feature labels, services, tactics, playbooks. Small dimension tables of fixed size."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from netstate.config import EXACT_LABELS, LABEL_PATTERNS, STAGE_ORDER, TACTIC_IDS, Options

# Services behind the well-known ports.
PORT_SERVICES = {20: "FTP data", 21: "FTP", 22: "SSH", 23: "Telnet", 25: "SMTP mail", 53: "DNS", 80: "web (HTTP)",
                 110: "POP3 mail", 123: "NTP time", 135: "Windows RPC", 139: "NetBIOS", 143: "IMAP mail",
                 443: "web (HTTPS)", 445: "SMB file sharing", 3389: "Remote Desktop", 8080: "alternate web",
                 8443: "alternate HTTPS"}
#: Measures of a window in words: what is counted or averaged, over all flows of the window.
FEATURE_LABELS = {
    "flow_count": "flows", "unique_src_ips": "source addresses", "unique_dst_ips": "destination addresses",
    "unique_src_ports": "source ports", "unique_dst_ports": "destination ports",
    "packets_total": "packets", "bytes_total": "bytes", "pkt_rate_mean": "packets a second",
    "byte_rate_mean": "bytes a second", "duration_mean": "flow duration, mean", "duration_std": "flow duration, spread",
    "iat_mean": "time between packets, mean", "iat_std": "time between packets, spread",
    "iat_max": "time between packets, maximum", "ttl_mean": "time to live, mean", "ttl_var": "time to live, variance",
    "tcp_window_mean": "TCP receive window, mean", "tcp_window_var": "TCP receive window, variance",
    "pkt_len_mean": "packet length, mean", "pkt_len_std": "packet length, spread",
    "payload_mean": "bytes of a flow, mean", "payload_std": "bytes of a flow, spread",
    "retransmissions": "packets sent again", "syn_count": "SYN flags", "ack_count": "ACK flags", "rst_count": "RST flags",
    "fin_count": "FIN flags", "psh_count": "PSH flags", "urg_count": "URG flags", "syn_ratio": "SYN flags a packet",
    "rst_ratio": "RST flags a packet", "inbound_outbound_byte_ratio": "bytes back for each byte sent",
    "inbound_outbound_packet_ratio": "packets back for each packet sent",
    "distinct_dst_per_src_mean": "destinations of one source, mean", "failed_flow_ratio": "flows without an answer, share",
    "small_flow_ratio": "flows of few packets, share", "scan_score": "likeness to a port scan",
    "well_known_dst_port_ratio": "flows to ports under 1024, share", "protocol_tcp": "TCP flows, share",
    "protocol_udp": "UDP flows, share", "protocol_icmp": "ICMP flows, share",
    "protocol_other": "flows of other protocols, share", "dst_port_other": "flows to all other ports, share",
    **{f"dst_port_{port}": f"flows to {name}, port {port}, share" for port, name in PORT_SERVICES.items()}}

# Enterprise mitigations of the public MITRE ATT&CK catalogue, by identifier.
MITIGATIONS = {
    "M1018": "User Account Management", "M1026": "Privileged Account Management", "M1027": "Password Policies",
    "M1028": "Operating System Configuration", "M1030": "Network Segmentation", "M1031": "Network Intrusion Prevention",
    "M1032": "Multi-factor Authentication", "M1035": "Limit Access to Resource Over Network",
    "M1036": "Account Use Policies", "M1037": "Filter Network Traffic", "M1042": "Disable or Remove Feature or Program",
    "M1050": "Exploit Protection", "M1051": "Update Software", "M1053": "Data Backup", "M1056": "Pre-compromise",
    "M1057": "Data Loss Prevention"}
#: Stage -> what its tactic is after, and the mitigations that the catalogue names for its network techniques.
PLAYBOOKS = {
    "Reconnaissance": ("Gathers information for a later operation.", ["M1056", "M1042"]),
    "Initial Access": ("Tries to get a first foothold.", ["M1050", "M1051", "M1030"]),
    "Credential Access": ("Tries to obtain account names and passwords.", ["M1036", "M1032", "M1027"]),
    "Discovery": ("Explores the environment around a foothold.", ["M1028", "M1018"]),
    "Lateral Movement": ("Tries to reach further systems of the network.", ["M1030", "M1035", "M1026"]),
    "Command and Control": ("Exchanges commands and results with systems it controls.", ["M1031", "M1037"]),
    "Exfiltration": ("Tries to take data out of the network.", ["M1057", "M1037"]),
    "Impact": ("Disrupts systems or destroys data.", ["M1037", "M1053"]),
}
DEFAULT_PLAYBOOK = ("-", "No tactic is known for this stage.", ["M1031", "M1037"])


def _texts(mitigations: list[str]) -> list[str]:
    return [f"{m} {MITIGATIONS[m]}" for m in mitigations]


def feature_dimension(spark: SparkSession) -> DataFrame:
    """(feature, feature_label), one row per feature that has a label."""
    return spark.createDataFrame(list(FEATURE_LABELS.items()), "feature string, feature_label string")


def with_feature_labels(df: DataFrame, options: Options) -> DataFrame:
    """Add ``feature_label``; features without one, such as other ports, keep their name with blanks.

    The dimension has one row per labelled feature, so it is broadcast.
    """
    return (df.join(F.broadcast(feature_dimension(df.sparkSession)), "feature", "left")
            .withColumn("feature_label", F.coalesce("feature_label", F.replace("feature", F.lit("_"), F.lit(" ")))))


def port_service(port: Column) -> Column:
    rule = F.when(port.isNull(), None)
    for p, name in PORT_SERVICES.items():
        rule = rule.when(port == p, name)
    return rule


def playbook_dimension(spark: SparkSession) -> DataFrame:
    rows = [(s, TACTIC_IDS[s], text, _texts(actions)) for s, (text, actions) in PLAYBOOKS.items()]
    return spark.createDataFrame(rows, "stage string, tactic_id string, meaning string, actions array<string>")


def with_playbook(df: DataFrame) -> DataFrame:
    """Add tactic id, meaning and actions for ``stage``; unknown stages get the default entry."""
    tactic, meaning, actions = DEFAULT_PLAYBOOK
    joined = df.join(F.broadcast(playbook_dimension(df.sparkSession)), "stage", "left")
    return joined.withColumns({"tactic_id": F.coalesce("tactic_id", F.lit(tactic)),
                               "meaning": F.coalesce("meaning", F.lit(meaning)),
                               "actions": F.coalesce("actions", F.array(*[F.lit(a) for a in _texts(actions)]))})


def tactic_dimension(spark: SparkSession) -> DataFrame:
    """Stage -> tactic id, url, the dataset labels and label patterns mapped to it."""
    rows = [(s, TACTIC_IDS[s], f"https://attack.mitre.org/tactics/{TACTIC_IDS[s]}/",
             [k for k, v in EXACT_LABELS.items() if v == s], [p for p, v in LABEL_PATTERNS if v == s])
            for s in STAGE_ORDER if s in TACTIC_IDS]
    return spark.createDataFrame(rows, "stage string, tactic_id string, url string, dataset_labels array<string>, "
                                       "label_patterns array<string>")


def with_tactic(df: DataFrame) -> DataFrame:
    return df.join(F.broadcast(tactic_dimension(df.sparkSession)), "stage", "left")


def driver_sentence(attribution: Column, label: Column) -> Column:
    return F.concat(F.when(attribution > 0, "Raises").otherwise("Lowers"), F.lit(" the risk: "), label)
