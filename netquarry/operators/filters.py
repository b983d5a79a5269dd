"""Display-filter texts for a packet viewer, filled with the values of each capture.

Templates are constant arrays, chosen by technique or by signal; placeholders are replaced in
Spark. Internal hosts are written as the internal networks, which covers the same
addresses and keeps a filter short whatever the size of the network.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netquarry.functions.lists import INTERNAL_RANGES
from netquarry.functions.net import is_external
from netquarry.operators.common import CAPTURE, top_k
from netquarry.operators.scoring import REPORT_THRESHOLD

QUICK, VICTIM, FINDING, ADDRESS, DOMAIN, PROTOCOL, COMBINED, TIME, BEACON = range(9)

TO_INTERNAL = " || ".join(f"ip.dst == {n}" for n in INTERNAL_RANGES)
ANY_INTERNAL = " || ".join(f"ip.addr == {n}" for n in INTERNAL_RANGES)

# Filter expressions by section. {victim}, {scanner} and {dc} are addresses
# of the capture; a template with {dc} or {targets} is left out where none is known.
NO_SNI = "tls.handshake.type == 1 && !tls.handshake.extensions_server_name"
SYN_ONLY = "tcp.flags.syn == 1 && tcp.flags.ack == 0"
GRATUITOUS = "arp.opcode == 1 && arp.src.proto_ipv4 == arp.dst.proto_ipv4"
POST = 'ip.src == {victim} && http.request.method == "POST"'

QUICK_FILTERS = (
    ("victim traffic", "ip.addr == {victim}"),
    ("victim outbound", "ip.src == {victim}"),
    ("victim and controller", "ip.addr == {victim} && ip.addr == {dc}"),
    ("TXT lookups", "ip.src == {victim} && dns.qry.type == 16"),
    ("TLS without server name", NO_SNI),
    ("half-open probes", "ip.src == {scanner} && " + SYN_ONLY),
    ("clear-text credentials", "http.authorization"),
    ("service ticket requests", "ip.src == {victim} && kerberos && kerberos.msg_type == 12"),
)

VICTIM_FILTERS = (
    ("all traffic of the victim", "ip.addr == {victim}"),
    ("sent by the victim", "ip.src == {victim}"),
    ("received by the victim", "ip.dst == {victim}"),
    ("victim to external hosts", "ip.src == {victim} && !(" + TO_INTERNAL + ")"),
    ("all internal traffic", "(" + ANY_INTERNAL + ")"),
    ("victim to other internal hosts", "ip.src == {victim} && ip.dst != {victim} && (" + TO_INTERNAL + ")"),
)

PROTOCOL_FILTERS = {
    "dns_packet_count": (
        ("DNS from victim", "ip.src == {victim} && dns"),
        ("DNS TXT", "ip.src == {victim} && dns.qry.type == 16"),
        ("DNS NULL", "ip.src == {victim} && dns.qry.type == 10"),
        ("DNS name errors", "dns.flags.rcode == 3 && ip.addr == {victim}"),
        ("DNS names over 30 characters", "dns.qry.name.len > 30 && ip.src == {victim}"),
        ("DNS answers to victim", "ip.dst == {victim} && dns.flags.response == 1"),
    ),
    "http_packet_count": (
        ("HTTP from victim", "ip.src == {victim} && http"),
        ("HTTP POST", POST),
        ("HTTP credentials", "http.authorization"),
        ("HTTP errors", "http.response.code >= 400 && ip.addr == {victim}"),
        ("HTTP user agents", "ip.src == {victim} && http.user_agent"),
    ),
    "tls_packet_count": (
        ("TLS from victim", "ip.src == {victim} && tls"),
        ("TLS client hello", "ip.src == {victim} && tls.handshake.type == 1"),
        ("TLS without server name", NO_SNI),
        ("TLS certificates", "ip.addr == {victim} && tls.handshake.type == 11"),
        ("TLS application data", "ip.src == {victim} && tls.record.content_type == 23"),
    ),
    "smb_packet_count": (
        ("SMB of victim", "ip.addr == {victim} && (smb || smb2)"),
        ("SMB2 tree connect", "ip.addr == {victim} && smb2 && smb2.cmd == 3"),
        ("SMB2 file operations", "ip.addr == {victim} && smb2 && smb2.cmd == 5"),
        ("SMB2 named pipes", "ip.addr == {victim} && smb2 && smb2.fid"),
    ),
    "kerberos_packet_count": (
        ("Kerberos from victim", "ip.src == {victim} && kerberos"),
        ("Kerberos AS-REQ", "ip.src == {victim} && kerberos && kerberos.msg_type == 10"),
        ("Kerberos TGS-REQ", "ip.src == {victim} && kerberos && kerberos.msg_type == 12"),
        ("Kerberos errors", "ip.addr == {victim} && kerberos && kerberos.msg_type == 30"),
    ),
    "arp_packet_count": (
        ("ARP requests", "arp && arp.opcode == 1"),
        ("ARP from victim", "arp.src.proto_ipv4 == {victim}"),
        ("ARP gratuitous", GRATUITOUS),
        ("ARP replies", "arp.opcode == 2"),
    ),
    "icmp_packet_count": (
        ("ICMP", "icmp"),
        ("ICMP echo from victim", "icmp.type == 8 && ip.src == {victim}"),
        ("ICMP large payload", "icmp && frame.len > 560"),
    ),
    "drsuapi_packet_count": (
        ("replication traffic", "drsuapi"),
        ("replication from victim", "ip.src == {victim} && drsuapi"),
        ("DCE/RPC from victim", "dcerpc && ip.src == {victim}"),
    ),
    "directory_packet_count": (
        ("LDAP from victim", "ldap && ip.src == {victim}"),
        ("CLDAP from victim", "cldap && ip.src == {victim}"),
        ("LDAP binds", "ip.src == {victim} && ldap"),
    ),
    "rdp_packet_count": (
        ("RDP sessions", "tcp.port == 3389"),
        ("RDP opened by victim", "ip.src == {victim} && tcp.dstport == 3389"),
        ("RDP decoded", "rdp && ip.addr == {victim}"),
    ),
}

FINDING_FILTERS = {
    "T1046": (
        ("half-open probes", "ip.src == {scanner} && " + SYN_ONLY),
        ("TCP of scanner", "ip.src == {scanner} && tcp"),
        ("UDP of scanner", "ip.src == {scanner} && udp"),
        ("scanner to first targets", "ip.src == {scanner} && ({targets})"),
        ("ping sweep", "ip.src == {scanner} && icmp.type == 8"),
    ),
    "T1071.004": (
        ("TXT lookups", "ip.src == {victim} && dns.qry.type == 16"),
        ("NULL lookups", "ip.src == {victim} && dns.qry.type == 10"),
        ("names over 40 characters", "ip.src == {victim} && dns.qry.name.len > 40"),
        ("name errors", "dns.flags.rcode == 3 && ip.src == {victim}"),
    ),
    "T1021.002": (
        ("SMB of victim", "ip.addr == {victim}{dc_addr} && (smb || smb2)"),
        ("SMB from victim", "(smb || smb2) && ip.src == {victim}"),
        ("tree connect", "ip.src == {victim} && smb2 && smb2.cmd == 3"),
        ("named pipes", "ip.src == {victim} && smb2 && smb2.fid"),
        ("file transfers", "ip.src == {victim} && smb2 && smb2.cmd == 5"),
    ),
    "T1040": (
        ("HTTP credentials", "http.authorization"),
        ("FTP user", 'ftp.request.command == "USER"'),
        ("FTP password", 'ftp.request.command == "PASS"'),
        ("credentials of victim", "ip.src == {victim} && (http.authorization || ftp.request.command)"),
    ),
    "T1048.003": (
        ("POST from victim", POST),
        ("large responses", "ip.dst == {victim} && http && http.content_length > 1000"),
        ("HTTP bodies", "ip.src == {victim} && http.file_data"),
    ),
    "T1558.003": (
        ("Kerberos from victim", "ip.src == {victim} && kerberos"),
        ("TGS-REQ", "ip.src == {victim} && kerberos && kerberos.msg_type == 12"),
        ("TGS-REP", "ip.dst == {victim} && kerberos && kerberos.msg_type == 13"),
        ("AS-REQ", "ip.src == {victim} && kerberos && kerberos.msg_type == 10"),
    ),
    "T1110.001": (
        ("failed pre-authentication", "kerberos.msg_type == 30 && ip.addr == {victim}"),
        ("AS-REQ bursts", "ip.src == {victim} && kerberos && kerberos.msg_type == 10"),
    ),
    "T1557": (
        ("ARP", "arp"),
        ("gratuitous ARP", GRATUITOUS),
        ("ARP from victim", "arp.src.proto_ipv4 == {victim}"),
        ("ARP replies", "arp.opcode == 2"),
    ),
    "T1095": (
        ("ICMP of victim", "icmp && ip.addr == {victim}"),
        ("large ICMP", "icmp && frame.len > 560 && ip.addr == {victim}"),
        ("echo requests", "icmp.type == 8 && ip.src == {victim}"),
        ("echo replies", "icmp.type == 0 && ip.dst == {victim}"),
    ),
    "T1071.001": (
        ("POST from victim", POST),
        ("GET from victim", 'ip.src == {victim} && http.request.method == "GET"'),
        ("user agents", "ip.src == {victim} && http.user_agent"),
        ("credentials", "ip.src == {victim} && http.authorization"),
    ),
    "T1003.006": (
        ("replication traffic", "drsuapi"),
        ("replication from victim", "ip.src == {victim} && drsuapi"),
        ("DCE/RPC from victim", "ip.src == {victim}{dc_dst} && dcerpc"),
        ("replication interface", 'dcerpc.cn_if_id == "e3514235-4b06-11d1-ab04-00c04fc2dcd2"'),
    ),
    "T1573.001": (
        ("TLS without server name", NO_SNI),
        ("client hello", "ip.src == {victim} && tls.handshake.type == 1"),
        ("certificates", "ip.addr == {victim} && tls.handshake.type == 11"),
        ("application data", "ip.src == {victim} && tls.record.content_type == 23"),
    ),
    "T1018": (
        ("ARP requests", "arp.src.proto_ipv4 == {victim} && arp.opcode == 1"),
        ("ping sweep", "ip.src == {victim} && icmp.type == 8"),
        ("all probes", "ip.src == {victim} && (arp || icmp.type == 8)"),
    ),
    "T1041": (
        ("large TLS frames", "ip.src == {victim} && tls && frame.len > 1000"),
        ("application data", "ip.src == {victim} && tls.record.content_type == 23"),
        ("TLS from victim", "ip.src == {victim} && tls"),
    ),
    "T1048.001": (
        ("TXT lookups", "ip.src == {victim} && dns.qry.type == 16"),
        ("names over 50 characters", "ip.src == {victim} && dns.qry.name.len > 50"),
    ),
    "T1049": (
        ("LDAP", "ldap && ip.src == {victim}"),
        ("CLDAP", "cldap && ip.src == {victim}"),
        ("both", "(ldap || cldap) && ip.src == {victim}"),
    ),
    "T1135": (
        ("SMB from victim", "ip.src == {victim} && (smb || smb2)"),
        ("tree connect", "ip.src == {victim} && smb2 && smb2.cmd == 3"),
        ("NetBIOS names", "nbns && ip.src == {victim}"),
        ("victim to controller", "ip.src == {victim}{dc_addr} && (smb || smb2)"),
    ),
    "T1008": (
        ("all channels", "ip.src == {victim} && (dns || http || tls)"),
        ("DNS channel", "ip.src == {victim} && dns.qry.type == 16"),
        ("HTTP channel", POST),
        ("TLS channel", "ip.src == {victim} && " + NO_SNI),
    ),
    "T1021.001": (
        ("RDP", "tcp.port == 3389"),
        ("RDP opened by victim", "ip.src == {victim} && tcp.dstport == 3389"),
        ("RDP decoded", "rdp && ip.addr == {victim}"),
    ),
    "T1056.003": (
        ("HTTP credentials", "http.authorization"),
        ("POST from victim", POST),
        ("all credential HTTP", "ip.src == {victim} && (http.authorization || http.request.method)"),
    ),
}

# (techniques any of which must have fired, label, filter); no techniques means always.
COMBINED_FILTERS = (
    ((), "everything unusual of the victim",
     "ip.src == {victim} && (dns.qry.type == 16 || (" + NO_SNI + ") || http.authorization || drsuapi"
     " || kerberos.msg_type == 12)"),
    (("T1046",), "port scan", "ip.src == {scanner} && " + SYN_ONLY),
    (("T1003.006", "T1021.002"), "lateral movement", "ip.addr == {victim} && (smb2 || kerberos || drsuapi)"),
    (("T1071.004", "T1048.001"), "unusual DNS",
     "ip.src == {victim} && dns && (dns.qry.type == 16 || dns.qry.name.len > 30 || dns.flags.rcode == 3)"),
    (("T1071.004", "T1048.001"), "suspicious domains", "{domains3}"),
    (("T1558.003",), "ticket exchange",
     "ip.addr == {victim} && kerberos && (kerberos.msg_type == 12 || kerberos.msg_type == 13)"),
    (("T1040", "T1056.003"), "credential exposure",
     "ip.addr == {victim} && (http.authorization || ftp.request.command)"),
    (("T1573.001", "T1041"), "suspicious TLS", "ip.src == {victim} && (" + NO_SNI + ")"),
)

DOMAIN_TECHNIQUES = ("T1071.004", "T1048.001")


def external_addresses(talkers: DataFrame, transfers: DataFrame) -> DataFrame:
    """External targets of the 12 largest conversations and of all large transfers."""
    busy = talkers.where((F.col("position") <= 12) & is_external(F.col("dst")))
    large = transfers.where(is_external(F.col("resp_h")))
    return busy.select(CAPTURE, F.col("dst").alias("ip")).unionByName(
        large.select(CAPTURE, F.col("resp_h").alias("ip"))
    ).distinct()


PLACEHOLDERS = ("victim", "scanner", "dc", "dc_addr", "dc_dst", "targets", "domains3")


#: Stands for a value that is not known.
UNKNOWN = "{}"


def _fill(template: Column) -> Column:
    """Replace the placeholders; UNKNOWN remains where one has no value."""
    return reduce(
        lambda out, name: F.replace(out, F.lit("{" + name + "}"), F.coalesce(name, F.lit(UNKNOWN))), PLACEHOLDERS, template)


def _facts(df: DataFrame, kind: str, at: Column | None = None, a: Column | None = None, b: Column | None = None, port: Column | None = None) -> DataFrame:
    none = F.lit(None)
    return df.select(
        CAPTURE, F.lit(kind).alias("kind"), (F.lit(0) if at is None else at).cast("int").alias("at"),
        (none if a is None else a).cast("string").alias("a"), (none if b is None else b).cast("string").alias("b"),
        (none if port is None else port).cast("int").alias("port"))


def _row(section: int, at: Column, label: Column, text: Column, ttp: Column | None = None) -> Column:
    return F.struct(
        F.lit(section).alias("section"), (F.lit("") if ttp is None else ttp).alias("ttp_id"),
        at.cast("int").alias("at"), label.alias("label"), text.alias("text"))


def _table(section: int, entries: list[tuple[str, str, str]], ttp: bool = False) -> Column:
    """Rows (key, label, text) as one constant array, numbered from 1."""
    return F.array(*(
        F.struct(F.lit(key).alias("key"), _row(section, F.lit(i), F.lit(label), F.lit(text), F.lit(key) if ttp else None).alias("row"))
        for i, (key, label, text) in enumerate(entries, 1)))


def _of_keys(table: Column, keys: Column) -> Column:
    return F.transform(F.filter(table, lambda t: F.array_contains(keys, t["key"])), lambda t: t["row"])


def _flat(templates: dict) -> list[tuple[str, str, str]]:
    return [(key, label, text) for key, entries in templates.items() for label, text in entries]


def display_filters(
    findings: DataFrame,
    signals: DataFrame,
    victims: DataFrame,
    captures: DataFrame,
    talkers: DataFrame,
    transfers: DataFrame,
    parents: DataFrame,
    scans: DataFrame,
    scan_targets: DataFrame | None = None,
    controllers: DataFrame | None = None,
    beacons: DataFrame | None = None,
) -> DataFrame:
    """(capture_id, section, ttp_id, at, label, filter) rows.

    victims from report.primary_victim, controllers from report.controller, scans and
    parents are the ranked top lists, scan_targets the scan evidence. Facts of all inputs
    meet once, in one row a capture with short lists; all templates are filled from that row.
    """
    def moment(c: str) -> Column:
        return F.date_format(F.timestamp_seconds(c), "MMM dd, yyyy HH:mm:ss")

    window = captures.where("start_ts IS NOT NULL").select(CAPTURE, F.posexplode(F.array(
        F.format_string('frame.time >= "%s" && frame.time <= "%s"', moment("start_ts"), moment("end_ts")),
        F.format_string('frame.time >= "%s" && frame.time_relative <= 600', moment("start_ts")),
        F.format_string("frame.time_relative >= %d", F.greatest(F.lit(0), F.floor("duration_secs") - 600)),
    )).alias("i", "text"))
    counts = {k: F.col(k) for k in PROTOCOL_FILTERS if k in signals.columns}
    counts["directory_packet_count"] = F.expr("ldap_packet_count + cldap_packet_count")
    seen = F.array_compact(F.array(F.lit(""), *(F.when(n > 0, F.lit(k)) for k, n in counts.items())))
    # Only as many addresses as a reader of the filters looks at, A-Z.
    addresses = top_k(external_addresses(talkers, transfers), [CAPTURE], [F.asc("ip")], 15, rank="at")
    facts = [
        _facts(signals.select(CAPTURE, F.explode(seen).alias("k")), "signal", a=F.col("k")),
        _facts(findings.where(F.col("score") >= REPORT_THRESHOLD), "fired", a=F.col("ttp_id")),
        _facts(victims, "victim", a=F.col("victim")),
        _facts(scans.where("position = 1"), "scanner", a=F.col("src")),
        _facts(parents.where("fqdn_count > 10"), "domain", F.col("position"), F.col("parent")),
        _facts(addresses, "ip", F.col("at"), F.col("ip")),
        _facts(window, "time", F.col("i"), F.col("text")),
    ]
    if controllers is not None:
        facts.append(_facts(controllers, "dc", a=F.col("dc")))
    if scan_targets is not None:
        first = F.transform(F.slice("unique_dst_hosts_sample", 1, 5), lambda h: F.concat(F.lit("ip.addr == "), h))
        facts.append(_facts(scan_targets, "targets", a=F.nullif(F.array_join(first, " || "), F.lit(""))))
    if beacons is not None:
        facts.append(_facts(beacons.where("position <= 5"), "beacon", *map(F.col, ("position", "src", "dst", "port"))))

    def one(kind: str) -> Column:
        return F.max(F.when(F.col("kind") == kind, F.col("a")))

    def several(kind: str) -> Column:
        return F.array_sort(F.collect_list(F.when(F.col("kind") == kind, F.struct("at", "a", "b", "port")))).alias(kind)

    kinds = ("signal", "fired", "domain", "ip", "time", "beacon")
    met = reduce(DataFrame.unionByName, facts).groupBy(CAPTURE).agg(
        *(several(k) for k in kinds), *(one(k).alias(f"found_{k}") for k in ("victim", "scanner", "dc", "targets")))
    named = lambda d: F.concat(F.lit('dns.qry.name contains "'), d["a"], F.lit('"'))
    victim, dc = F.coalesce("found_victim", F.lit("VICTIM_IP")), F.col("found_dc")
    joined = lambda items, k, each: F.nullif(F.array_join(F.transform(F.slice(items, 1, k), each), " || "), F.lit(""))
    each_ip = lambda x: F.concat(F.lit("ip.addr == "), x["a"])
    context = met.select(
        CAPTURE, *kinds, victim.alias("victim"), F.coalesce("found_scanner", victim).alias("scanner"), dc.alias("dc"),
        F.coalesce(F.concat(F.lit(" && ip.addr == "), dc), F.lit("")).alias("dc_addr"),
        F.coalesce(F.concat(F.lit(" && ip.dst == "), dc), F.lit("")).alias("dc_dst"),
        F.col("found_targets").alias("targets"), F.slice("domain", 1, 20).alias("domains"),
        joined("domain", 3, named).alias("domains3"),
        F.transform("fired", lambda f: f["a"]).alias("ids"), F.transform("signal", lambda f: f["a"]).alias("sources"))

    # A capture without a signal row has no section that speaks of its victim.
    known = F.size("signal") > 0
    ids, domains = F.col("ids"), F.col("domains")
    always = F.array(F.lit(""))
    combined = F.array(*(
        F.struct(F.array(*map(F.lit, ttps)).cast("array<string>").alias("ttps"), _row(COMBINED, F.lit(i), F.lit(label), F.lit(text)).alias("row"))
        for i, (ttps, label, text) in enumerate(COMBINED_FILTERS, 1)))
    time_labels = F.array(*[F.lit(x) for x in ("whole capture", "first 10 minutes", "last 10 minutes")])
    at_domain = lambda d, i, section, at, label, ttp=None: _row(section, at, F.concat(F.lit(label), d["a"]), named(d), ttp)
    by_victim = [
        _of_keys(_table(QUICK, [("", *t) for t in QUICK_FILTERS]), always),
        _of_keys(_table(VICTIM, [("", *t) for t in VICTIM_FILTERS]), always),
        _of_keys(_table(FINDING, _flat(FINDING_FILTERS), ttp=True), ids),
        F.transform("ip", lambda x: _row(ADDRESS, x["at"] * 2 - 1, F.concat(F.lit("traffic of "), x["a"]), each_ip(x))),
        F.transform("ip", lambda x: _row(ADDRESS, x["at"] * 2, F.concat(F.lit("victim to "), x["a"]),
                                         F.concat(F.lit("ip.src == "), F.col("victim"), F.lit(" && ip.dst == "), x["a"]))),
        F.array(_row(ADDRESS, F.lit(1000), F.lit("all suspicious addresses"),
                     F.concat(F.lit("("), joined("ip", 10, each_ip), F.lit(") && ip.addr == "), F.col("victim")))),
        _of_keys(_table(PROTOCOL, _flat(PROTOCOL_FILTERS)), F.col("sources")),
        F.transform(F.filter(combined, lambda c: (F.size(c["ttps"]) == 0) | F.arrays_overlap(c["ttps"], ids)), lambda c: c["row"]),
    ]
    pair = lambda x: F.concat(F.lit("ip.src == "), x["a"], F.lit(" && ip.dst == "), x["b"])
    called = lambda text, x: F.concat(F.lit(text), x["a"], F.lit(" to "), x["b"], F.lit(":"), x["port"].cast("string"))
    port = lambda x: F.concat(F.lit(" && tcp.dstport == "), x["port"].cast("string"))
    source = lambda x: F.concat(F.lit("ip.src == "), x["a"])
    by_victim.append(F.flatten(F.transform("beacon", lambda x: F.array(
        _row(BEACON, x["at"] * 4 - 3, called("all traffic ", x), pair(x)),
        _row(BEACON, x["at"] * 4 - 2, called("beacon channel ", x), F.concat(pair(x), port(x))),
        _row(BEACON, x["at"] * 4 - 1, F.concat(F.lit("outbound of "), x["a"]), F.concat(source(x), F.lit(" && !ip.dst == "), F.col("victim"))),
        _row(BEACON, x["at"] * 4, called("same port, any target ", x), F.concat(source(x), port(x))),
    ))))
    others = [
        F.flatten(F.transform(F.array_intersect(ids, F.array(*map(F.lit, DOMAIN_TECHNIQUES))), lambda t: F.transform(
            F.slice(domains, 1, 3), lambda d, i: at_domain(d, i, FINDING, i + 1001, "suspicious domain ", t)))),
        F.transform(F.slice(domains, 1, 10), lambda d, i: at_domain(d, i, DOMAIN, i + 1, "lookups below ")),
        F.array(_row(DOMAIN, F.lit(1000), F.lit("all suspicious domains"), joined("domains", 5, named))),
        F.transform("time", lambda t: _row(TIME, t["at"] + 1, F.get(time_labels, t["at"]), t["a"])),
        F.when(F.array_contains("sources", "drsuapi_packet_count"), F.array(_row(QUICK, F.lit(100), F.lit("replication"), F.lit("drsuapi")))),
        F.transform(F.slice(domains, 1, 1), lambda d: _row(QUICK, F.lit(101), F.lit("suspicious domain"), named(d))),
        F.transform(F.filter("beacon", lambda x: x["at"] == 1), lambda x: _row(QUICK, F.lit(102), F.lit("best beacon"), pair(x))),
    ]
    items = F.flatten(F.array_compact(F.array(*(F.when(known, p) for p in by_victim), *others)))
    wide = context.select(CAPTURE, *PLACEHOLDERS, F.inline(items))
    filled = wide.select(CAPTURE, "section", "ttp_id", "at", "label", _fill(F.col("text")).alias("filter"))
    return filled.where((F.col("filter") != "") & ~F.col("filter").contains(UNKNOWN))
