"""Stage schemas, vocabularies and code tables."""

from __future__ import annotations

from pyspark.sql import types as T


def _struct(spec: str) -> T.StructType:
    kinds = {"str": T.StringType(), "int": T.IntegerType(), "long": T.LongType(),
             "double": T.DoubleType(), "bool": T.BooleanType()}
    fields = (item.rsplit(" ", 1) for item in spec.split(", "))
    return T.StructType([T.StructField(name, kinds[kind]) for name, kind in fields])


# --- fixed values: column names and vocabularies of the stage files -------------------------
RAW_FLOW = _struct(
    "row_id long, src_ip str, dst_ip str, src_port int, dst_port int, protocol int, stime long, "
    "ltime long, duration_ms long, src_ip_bytes long, dst_ip_bytes long, src_pkts long, "
    "dst_pkts long, connection_state str, requested_service str, application_name str, "
    "dns_query str, dns_rejected bool, dns_rd bool, http_status_code int, label str, "
    "source_file str")

BASE = _struct(
    "src_ip str, dst_ip str, src_port int, dst_port int, proto str, stime long, ltime long, "
    "dur double, dns_query str, dns_rejected str, dns_RD str, conn_state str, service str, "
    "http_status_code int, src_ip_bytes long, dst_ip_bytes long, src_pkts long, dst_pkts long, "
    "label str")

BASE_DASHED = _struct(
    "src-ip str, dst-ip str, src-port int, dst-port int, protocol int, stime long, dns-query str, "
    "dns-rejected int, dns-RD int, state str, service str, http-status-code int, "
    "src-ip-bytes long, dst-ip-bytes long, src2dst_packets long, dst2src_packets long, label str")

REQUIRED = ["src_ip", "dst_ip", "src_pkts", "dst_pkts", "src_ip_bytes", "dst_ip_bytes", "proto",
            "dst_port", "stime", "ltime", "dur", "conn_state", "service", "dns_rejected", "label"]
REQUIRED_DASHED = ["src-ip", "dst-ip", "src2dst_packets", "dst2src_packets", "src-ip-bytes",
                   "dst-ip-bytes", "protocol", "dst-port", "stime", "label"]

DAMPED_COLUMNS = ["H_L0.01_weight", "H_L0.1_weight", "H_L1_weight", "H_L3_weight", "H_L0.01_mean",
                  "MI_dir_L0.01_weight", "MI_dir_L0.1_weight", "MI_dir_L1_weight",
                  "MI_dir_L0.1_mean", "HH_jit_L1_mean"]

ENRICHED = ["proto", "conn_state", "service", "dns_rejected", "src_ip_bytes", "dst_ip_bytes",
            "src_pkts", "dst_pkts", "http_status_code", "dst_port", "stime", "ltime", "dur",
            "TnBPDstIP", "sum", "N_IN_Conn_P_DstIP", "N_IN_Conn_P_SrcIP", "max", "mean", "min",
            "stddev", "state_number", "proto_number", *DAMPED_COLUMNS, "label"]

ENRICHED_DASHED = ["state", "service", "http-status-code", "src-bytes", "dst-ip-bytes", "dst-port",
                   "conn-state", "src-pkts", "proto", "MI-dir-L5-weight", "HH-L3-weight",
                   "HH-L0.01-weight", "HpHp-L0.01-weight", "HpHp-L0.01-mean", "HpHp-L0.01-std",
                   "HpHp-L0.01-magnitude", "N-IN-Conn-P-DstIP", "N-IN-Conn-P-SrcIP",
                   "state-number", "proto-number", "stime", "max", "mean", "min", "stddev",
                   "label"]

ENRICHED_UNFILTERED = ["dns-query", "dns-rejected", "dns-RD", "state", "service",
                       "http-status-code", "src-bytes", "dst-ip-bytes", "MI-dir-L5-weight",
                       "HH-L3-weight", "HH-L0.01-weight", "HpHp-L0.01-weight", "HpHp-L0.01-mean",
                       "HpHp-L0.01-std", "HpHp-L0.01-magnitude", "N-IN-Conn-P-SrcIP",
                       "N-IN-Conn-P-DstIP", "state-number", "proto-number", "stime", "max", "mean",
                       "min", "stddev", "label"]

COUNTER_TABLE = ["N-IN-Conn-P-SrcIP", "N-IN-Conn-P-DstIP", "state-number", "proto-number",
                 "stime", "max", "mean", "min", "stddev", "label"]

CATEGORICAL = ["proto", "conn_state", "service", "dns_rejected"]
NUMERIC = ["http_status_code", "src_ip_bytes", "dst_ip_bytes", "dst_port", "src_pkts", "dst_pkts",
           "stime", "ltime", "dur", "TnBPDstIP", "sum", "N_IN_Conn_P_DstIP", "N_IN_Conn_P_SrcIP",
           "state_number", "proto_number", "max", "mean", "min", "stddev", *DAMPED_COLUMNS]
CATEGORICAL_DASHED = ["state", "service", "conn-state"]
NUMERIC_DASHED = ["http-status-code", "src-bytes", "dst-ip-bytes", "dst-port", "src-pkts", "proto",
                  "MI-dir-L5-weight", "HH-L3-weight", "HH-L0.01-weight", "HpHp-L0.01-weight",
                  "HpHp-L0.01-mean", "HpHp-L0.01-std", "HpHp-L0.01-magnitude",
                  "N-IN-Conn-P-DstIP", "N-IN-Conn-P-SrcIP", "state-number", "proto-number",
                  "stime", "max", "mean", "min", "stddev"]

# Values an encoder knows in advance; anything else encodes to an all-zero block.
KNOWN_VOCAB = {
    "proto": ["tcp", "udp", "Other", "None"],
    "conn_state": ["OTH", "Other", "REJ", "S0", "SF"],
    "service": ["-", "Other", "dns", "http", "None"],
    "dns_rejected": ["-", "F", "Other", "None"],
}
# Values the base table may hold.
CONTRACT_VOCAB = {
    "proto": ["tcp", "udp", "Other", "None"],
    "dns_rejected": ["T", "F", "-"],
    "conn_state": ["S0", "SF", "REJ", "OTH", "Other", "None"],
    "service": ["-", "dns", "http", "Other", "None"],
}

STATE_CODES = {"S0": 1, "SF": 2, "REJ": 3, "OTH": 0, "Other": -1, "None": -2}
STATE_CODES_DASHED = {"S0": 1, "SF": 2, "OTH": 0}
STATE_CODES_ALT = {"S0": 0, "S1": 1, "OTH": 2}
PROTO_CODES = {"tcp": 6, "udp": 17, "Other": 0, "None": -1}

CLASS_CODES = {"normal": 0, "backdoor": 1, "dos": 2, "ddos": 3, "injection": 4, "mitm": 5,
               "scanning": 6, "ransomware": 7, "password": 8, "xss": 9}
FOLDER_CLASS_CODES = {"Normal": 0, "MITM": 1, "NormalDdos": 2, "NormalDos": 3,
                      "NormalScanning": 4, "NormalXss": 5, "NormalRunsomware": 6,
                      "InjectionNormal": 7, "PasswordNormal": 8, "Normal_backdoor": 9}
FOLDER_LABELS = {"BackDoor": "backdoor", "DDos": "ddos", "DoS": "dos", "Injection": "injection",
                 "MITM": "mitm", "Password": "password", "RunsomWare": "ransomware",
                 "Scanning": "scanning", "XSS": "xss", "Normal": "normal"}
FOLDER_LABELS_DASHED = {"Normal": "normal", "NormalDdos": "ddos", "NormalDos": "dos",
                        "NormalBackdoor": "backdoor", "NormalRunsomware": "ransomware",
                        "NormalScanning": "scanning", "NormalXss": "xss",
                        "PasswordNormal": "password", "InjectionNormal": "injection",
                        "MITM": "mitm"}
CLASS_QUOTAS = {"normal": 300000, "ddos": 20000, "dos": 20000, "backdoor": 20000,
                "injection": 20000, "mitm": 1043, "scanning": 20000, "ransomware": 20000,
                "password": 20000, "xss": 20000}

SUPERVISED_MODELS = ["Random Forest", "Decision Tree", "Naive Bayes"]
UNSUPERVISED_MODELS = ["Isolation Forest", "One-Class SVM", "Local Outlier Factor",
                       "Elliptic Envelope"]
MODELS = SUPERVISED_MODELS + UNSUPERVISED_MODELS
METRICS = ["accuracy", "precision", "recall", "f1_score", "auc", "MCC", "TP", "TN", "FP", "FN",
           "train_time", "predict_time"]
COUNT_METRICS = ["TP", "TN", "FP", "FN"]
TESTED_METRICS = ["MCC", "f1_score", "auc"]
TARGET = "category"
LEAK_COLUMNS = ["label", "proto-number"]
# --- end of fixed values -----------------------------------------------------------------------
