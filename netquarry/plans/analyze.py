"""The whole analysis as one set of lazy tables."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession

from netquarry.operators import (
    alerts as alert_ops,
    anomaly,
    artifacts,
    beacon,
    evidence,
    filters,
    inventory,
    ioc,
    report,
    scoring,
    sigma,
    signals as sig,
)
from netquarry.operators import packets as packet_ops
from netquarry.operators.common import CAPTURE
from netquarry.schemas import ALERT_SCHEMA, BEACON_CSV_SCHEMA, PACKET_SCHEMA, ZEEK_LOGS
from netquarry.session import local_table
from netquarry.sources import alerts as alert_source
from netquarry.sources import intel, packets as packet_source, rules as rule_source, zeek


@dataclass(frozen=True)
class Options:
    """Options of one analysis."""

    max_iocs: int = 20
    offline: bool = False
    skip_anomalies: bool = False
    skip_signatures: bool = False
    report_threshold: float = scoring.REPORT_THRESHOLD
    deep_dive_threshold: float = scoring.DEEP_DIVE_THRESHOLD
    playbooks: str | None = None
    allowlist: str | None = None
    sigma_rules: str | None = None
    beacon: beacon.BeaconSpec = beacon.BeaconSpec()
    # Keep the tables that many outputs share (signals, findings) for the session.
    persist: bool = True


@dataclass(frozen=True)
class Inputs:
    """Tables to analyze. A log that is absent reads as empty."""

    packets: DataFrame
    logs: dict[str, DataFrame]
    alerts: DataFrame | None = None
    beacons: DataFrame | None = None
    ip_reputation: DataFrame | None = None
    ioc_feed: DataFrame | None = None
    raw_logs: dict[str, DataFrame] | None = None
    files_dir: str | None = None


def read_inputs(
    spark: SparkSession,
    logs: str,
    packets: str | None = None,
    alerts: str | None = None,
    beacons: str | None = None,
    ip_reputation: str | None = None,
    ioc_feed: str | None = None,
    files_dir: str | None = None,
    sigma_rules: str | None = None,
) -> Inputs:
    """Inputs from paths; ``sigma_rules`` adds the fields its rules name to the raw logs."""
    rules = rule_source.load_sigma(spark, sigma_rules)
    raw = {
        log: zeek.read_zeek_raw(spark, logs, log, sigma.rule_fields(rules, log))
        for log in sigma.SIGMA_LOGS
        if any(r.service == log for r in rules)
    }
    return Inputs(
        packets=packet_source.read_packets(spark, packets) if packets else spark.createDataFrame([], PACKET_SCHEMA),
        logs=zeek.read_logs(spark, logs),
        alerts=alert_source.read_alerts(spark, alerts) if alerts else None,
        beacons=alert_source.read_beacon_csv(spark, beacons) if beacons else None,
        ip_reputation=intel.read_ip_reputation(spark, ip_reputation) if ip_reputation else None,
        ioc_feed=intel.read_ioc_feed(spark, ioc_feed) if ioc_feed else None,
        raw_logs=raw,
        files_dir=files_dir,
    )


def analyze(spark: SparkSession, inputs: Inputs, options: Options = Options()) -> dict[str, DataFrame]:
    """All result tables by name. Nothing but the rule files and pair sizes is read until one is used."""
    packets = inputs.packets
    log = {name: inputs.logs.get(name) for name in ZEEK_LOGS}
    log = {name: df if df is not None else zeek.empty_log(spark, name) for name, df in log.items()}
    alerts = inputs.alerts
    if alerts is None or options.skip_signatures:
        alerts = spark.createDataFrame([], ALERT_SCHEMA)
    beacons = inputs.beacons if inputs.beacons is not None else spark.createDataFrame([], BEACON_CSV_SCHEMA)

    def keep(df: DataFrame) -> DataFrame:
        return df.persist(StorageLevel.MEMORY_AND_DISK) if options.persist else df

    rules = rule_source.load_playbooks(spark, options.playbooks)
    allow = rule_source.load_allowlist(spark, options.allowlist)
    log_rules = rule_source.load_sigma(spark, options.sigma_rules)

    # Inventory. A capture is known by its packets or by any of its logs.
    traffic = keep(packet_ops.packet_rollup(packets))
    facts = keep(packet_ops.packet_facts(packets))
    samples = keep(packet_ops.packet_samples(packets))
    rollup = keep(sig.conn_rollup(log["conn"]))
    names = keep(sig.dns_names(log["dns"]))
    histogram = inventory.protocol_histogram(traffic)
    timed = inventory.classify_conversations(inventory.timed_conversations(traffic))
    convs = inventory.from_start(timed, traffic)
    hosts = inventory.hosts(traffic)
    # Begins are subtracted from the few rows kept.
    talkers = keep(inventory.from_start(inventory.top_talkers(timed), traffic))
    known = traffic.select(CAPTURE)
    for df in (log | {"conn": rollup, "dns": names}).values():
        known = known.unionByName(df.select(CAPTURE))
    captures = keep(known.distinct().join(inventory.captures(traffic), CAPTURE, "left"))
    thresholds = inventory.calibrate(captures)
    allowed = inventory.mark_allowed(hosts.select("ip").distinct(), allow).where("allowed")

    # Signals.
    sources = keep(sig.scan_sources(rollup, thresholds))
    scans = sig.scan_candidates(sources)
    transfers = keep(sig.outbound_transfers(log["conn"], thresholds=thresholds))
    first_transfers = sig.first_transfers(transfers)
    parents = keep(sig.top_parents(names))
    singletons = sig.dns_singletons(names)
    default_pairs = options.beacon.keys == beacon.BeaconSpec().keys
    sizes = beacon.pair_sizes_from_rollup(rollup) if default_pairs else None
    flows = beacon.internal_to_external(log["conn"])
    candidates = keep(beacon.beacon_candidates(flows, options.beacon, sizes))
    signals = keep(
        sig.assemble_signals(
            captures,
            sig.packet_signals(traffic),
            sig.arp_conflict_signals(facts),
            sig.dcsync_signals(facts, log["kerberos"]),
            sig.dns_signals(names),
            sig.http_signals(log["http"]),
            sig.tls_signals(log["ssl"], log["x509"]),
            sig.smb_signals(log["smb_mapping"]),
            sig.scan_signals(rollup, thresholds=thresholds),
            sig.exfil_signals(rollup, thresholds=thresholds),
            sig.kerberos_signals(log["kerberos"]),
            beacon.beacon_signals(candidates),
            beacon.external_beacon_signals(beacons),
        )
    )

    # Rules.
    sigma_hits = sigma.sigma_scan(inputs.raw_logs or log, log_rules)
    if sigma_hits is None:
        sigma_hits = spark.createDataFrame([], sigma.HIT_SCHEMA)
    scores = scoring.score_rules(signals, rules)
    findings = keep(scoring.sweep(scores, alerts, sigma_hits, options.report_threshold))

    # Evidence.
    scan_rows = keep(evidence.scan_evidence(rollup, sources))
    shares = evidence.smb_share_evidence(log["smb_mapping"])
    tables = {
        "scan": scan_rows,
        "scan_timeline": evidence.scan_timeline(scan_rows),
        "smb_shares": shares,
        "smb_paths": evidence.smb_paths(log["smb_mapping"]),
        "smb_files": evidence.smb_file_evidence(log["smb_files"]),
        "dns": evidence.dns_evidence(log["dns"]),
        "credentials": evidence.credential_evidence(samples),
        "transfers": evidence.transfer_evidence(transfers),
        "posts": evidence.post_evidence(log["http"]),
    }
    dives = evidence.deep_dive(findings, tables, options.deep_dive_threshold)
    summaries = evidence.of_strong(
        evidence.evidence_summaries(tables, signals), findings, options.deep_dive_threshold
    )

    # Indicators.
    targets = ioc.enrichment_targets(hosts, talkers, scan_rows, allowed, options.max_iocs)
    if options.offline or (inputs.ip_reputation is None and inputs.ioc_feed is None):
        targets = targets.where("false")
    no_reputation = "ip string, owner string, country string, malicious bigint, suspicious bigint, harmless bigint, undetected bigint, reputation bigint, tags array<string>"
    reputation = inputs.ip_reputation if inputs.ip_reputation is not None else spark.createDataFrame([], no_reputation)
    feed = inputs.ioc_feed if inputs.ioc_feed is not None else spark.createDataFrame([], intel.FEED_SCHEMA)
    enriched = keep(ioc.enrich(targets, reputation, feed))
    confirmed = enriched.where("is_confirmed_malicious")

    # Report.
    macs = inventory.mac_ip(facts)
    victims = keep(
        report.victim_identity(log["dhcp"], log["kerberos"], log["smb_mapping"], log["dns"], macs)
    )
    primary = report.primary_victim(talkers, hosts)
    certificates = artifacts.certificates(log["x509"], captures)
    events = artifacts.smb_events(log["smb_files"])
    out = {
        "captures": captures,
        "thresholds": thresholds,
        "protocols": histogram,
        "conversations": convs,
        "top_talkers": talkers,
        "hosts": hosts,
        "mac_ip": macs,
        "hostnames": inventory.hostnames(facts),
        "os_hints": inventory.os_hints(facts),
        "odd_ports": inventory.odd_ports(samples),
        "allowed_ips": allowed,
        "allow_summary": local_table(
            spark,
            [{"rules_loaded": allow.rule_count, "cleared_protocols": allow.protocols}],
            "rules_loaded int, cleared_protocols array<string>",
        ),
        "signals": signals,
        "beacons": candidates,
        "external_beacons": beacon.top_external_beacons(beacons),
        "scan_candidates": scans,
        "large_transfers": first_transfers,
        "dns_top_parents": parents,
        "dns_singletons": singletons,
        "post_destinations": sig.post_destinations(log["http"]),
        "tls_anomaly_ips": sig.tls_anomaly_ips(log["ssl"], log["x509"]),
        "tls_sessions": sig.tls_sessions(log["ssl"]),
        "alert_stats": alert_ops.alert_stats(alerts),
        "alert_duplicates": alert_ops.duplicate_alerts(alerts),
        "sigma_hits": sigma_hits,
        "sigma_stats": sigma.sigma_stats(sigma_hits),
        "scores": scores,
        "findings": findings,
        "evidence_summaries": summaries,
        "finding_view": report.finding_view(
            findings, summaries, evidence.evidence_lines(tables), threshold=options.deep_dive_threshold
        ),
        "certificates": certificates,
        "smb_events": events,
        "smb_writes": artifacts.smb_writes(events),
        "ja3_matches": ioc.ja3_matches(log["ssl"]),
        "ioc_enrichment": enriched,
        "ioc_ips": ioc.ioc_ips(
            talkers, sources.where("candidate"), transfers, sig.post_destinations(log["http"]),
            sig.tls_anomaly_ips(log["ssl"], log["x509"]), confirmed, alerts,
        ),
        "ioc_domains": ioc.ioc_domains(parents, alerts),
        "ioc_hashes": ioc.ioc_hashes(log["files"]),
        "victims": victims,
        "lan_segment": report.lan_segment(hosts),
        "visible_protocols": report.visible_protocols(captures),
        "summary": report.summary(findings, victims, enriched, alerts),
        "display_filters": filters.display_filters(
            findings, signals, primary, captures, talkers, transfers, parents, scans,
            scan_rows, report.controller(shares), candidates,
        ),
    }
    out |= {f"evidence_{name}": df for name, df in dives.items()}
    if inputs.files_dir is not None:
        files = artifacts.file_hashes(spark, inputs.files_dir, log["files"])
        out |= {"extracted_files": files, "duplicate_files": artifacts.duplicate_files(files)}
    if not options.skip_anomalies:
        out["anomalies"] = anomaly.anomalies(
            signals, findings, captures, parents, sources.where("candidate"), singletons
        )
    return out
