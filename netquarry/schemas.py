"""Column types of the input tables.

Names are the Zeek ones with ``id.`` cut and remaining dots written as underscores,
so no back-ticks are needed downstream. Schemas are DDL text.
"""

from __future__ import annotations

# Each log: field name as written in the JSON -> Spark type.
ZEEK_LOGS: dict[str, dict[str, str]] = {
    "conn": {
        "ts": "double", "uid": "string", "id.orig_h": "string", "id.orig_p": "int",
        "id.resp_h": "string", "id.resp_p": "int", "proto": "string", "service": "string",
        "duration": "double", "orig_bytes": "bigint", "resp_bytes": "bigint",
        "conn_state": "string", "history": "string", "orig_pkts": "bigint", "resp_pkts": "bigint",
    },
    "dns": {
        "ts": "double", "uid": "string", "id.orig_h": "string", "id.orig_p": "int",
        "id.resp_h": "string", "id.resp_p": "int", "proto": "string", "query": "string",
        "qtype_name": "string", "rcode_name": "string", "answers": "array<string>",
    },
    "http": {
        "ts": "double", "uid": "string", "id.orig_h": "string", "id.orig_p": "int",
        "id.resp_h": "string", "id.resp_p": "int", "method": "string", "host": "string",
        "uri": "string", "referrer": "string", "user_agent": "string", "status_code": "int",
        "request_body_len": "bigint", "response_body_len": "bigint",
    },
    "ssl": {
        "ts": "double", "uid": "string", "id.orig_h": "string", "id.orig_p": "int",
        "id.resp_h": "string", "id.resp_p": "int", "version": "string", "cipher": "string",
        "server_name": "string", "ja3": "string", "ja3s": "string",
        "validation_status": "string", "cert_chain_fps": "array<string>",
    },
    "x509": {
        "ts": "double", "fingerprint": "string", "certificate.subject": "string",
        "certificate.issuer": "string", "certificate.not_valid_before": "double",
        "certificate.not_valid_after": "double", "certificate.key_type": "string",
        "certificate.key_length": "int", "basic_constraints.ca": "boolean",
        "san.dns": "array<string>",
    },
    "files": {
        "ts": "double", "fuid": "string", "tx_hosts": "string", "rx_hosts": "string",
        "source": "string", "mime_type": "string", "filename": "string", "extracted": "string",
        "md5": "string", "sha1": "string", "sha256": "string", "seen_bytes": "bigint",
    },
    "weird": {
        "ts": "double", "uid": "string", "id.orig_h": "string", "id.orig_p": "int",
        "id.resp_h": "string", "id.resp_p": "int", "name": "string", "addl": "string",
    },
    "smb_mapping": {
        "ts": "double", "uid": "string", "id.orig_h": "string", "id.orig_p": "int",
        "id.resp_h": "string", "id.resp_p": "int", "path": "string", "share_type": "string",
    },
    "smb_files": {
        "ts": "double", "uid": "string", "id.orig_h": "string", "id.orig_p": "int",
        "id.resp_h": "string", "id.resp_p": "int", "action": "string", "path": "string",
        "name": "string", "size": "bigint",
    },
    "kerberos": {
        "ts": "double", "uid": "string", "id.orig_h": "string", "id.orig_p": "int",
        "id.resp_h": "string", "id.resp_p": "int", "request_type": "string", "client": "string",
        "service": "string", "error_msg": "string", "cipher": "string",
    },
    "dhcp": {
        "ts": "double", "client_addr": "string", "assigned_addr": "string", "mac": "string",
        "host_name": "string", "domain": "string",
    },
    "dce_rpc": {
        "ts": "double", "uid": "string", "id.orig_h": "string", "id.orig_p": "int",
        "id.resp_h": "string", "id.resp_p": "int", "endpoint": "string", "operation": "string",
        "named_pipe": "string",
    },
    "ssh": {
        "ts": "double", "uid": "string", "id.orig_h": "string", "id.orig_p": "int",
        "id.resp_h": "string", "id.resp_p": "int", "auth_success": "boolean",
        "client": "string", "server": "string",
    },
    "ftp": {
        "ts": "double", "uid": "string", "id.orig_h": "string", "id.orig_p": "int",
        "id.resp_h": "string", "id.resp_p": "int", "user": "string", "command": "string",
        "arg": "string",
    },
    "rdp": {
        "ts": "double", "uid": "string", "id.orig_h": "string", "id.orig_p": "int",
        "id.resp_h": "string", "id.resp_p": "int", "cookie": "string", "result": "string",
    },
    "ntlm": {
        "ts": "double", "uid": "string", "id.orig_h": "string", "id.orig_p": "int",
        "id.resp_h": "string", "id.resp_p": "int", "username": "string", "hostname": "string",
        "domainname": "string", "success": "boolean",
    },
}


def column_name(field: str) -> str:
    """``id.orig_h`` -> ``orig_h``, ``certificate.subject`` -> ``certificate_subject``."""
    return field.removeprefix("id.").replace(".", "_")


def log_schema(log: str) -> str:
    """Typed schema of a log table, capture key first."""
    fields = ", ".join(f"{column_name(f)} {t}" for f, t in ZEEK_LOGS[log].items())
    return f"capture_id string, {fields}"


# Exported packet fields: export name -> (column, type). The order is the column order of the export.
PACKET_FIELDS: dict[str, tuple[str, str]] = {
    "frame.number": ("frame_no", "bigint"),
    "frame.time_epoch": ("ts", "double"),
    "frame.len": ("frame_len", "int"),
    "frame.protocols": ("protocols", "array<string>"),
    "eth.src": ("eth_src", "string"),
    "ip.src": ("ip_src", "string"),
    "ip.dst": ("ip_dst", "string"),
    "ip.ttl": ("ip_ttl", "string"),
    "tcp.dstport": ("tcp_dstport", "int"),
    "udp.dstport": ("udp_dstport", "int"),
    "dns.qry.name": ("dns_qry_name", "string"),
    "dns.flags.response": ("dns_is_response", "boolean"),
    "dns.a": ("dns_a", "array<string>"),
    "arp.opcode": ("arp_opcode", "int"),
    "arp.src.proto_ipv4": ("arp_src_ip", "string"),
    "arp.dst.proto_ipv4": ("arp_dst_ip", "string"),
    "arp.src.hw_mac": ("arp_src_mac", "string"),
    "http.authorization": ("http_authorization", "string"),
    "ftp.request.command": ("ftp_command", "string"),
    "data.len": ("data_len", "int"),
}

PACKET_SCHEMA = "capture_id string, " + ", ".join(f"{c} {t}" for c, t in PACKET_FIELDS.values())

ALERT_SCHEMA = (
    "capture_id string, timestamp string, src_ip string, src_port int, dst_ip string, "
    "dst_port int, proto string, signature string, signature_id bigint, severity int, "
    "category string, technique string"
)

BEACON_CSV_SCHEMA = (
    "capture_id string, score double, src_ip string, dst_ip string, connections bigint, "
    "avg_bytes double, top_interval_secs double, interval_skew double, size_skew double"
)

FLOW_SCHEMA = (
    "capture_id string, src string, dst string, port int, ts double, orig_bytes double"
)
