"""Tables behind a report: victim, summary, host lists, finding details."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netquarry.functions import text
from netquarry.functions.lists import NOISE_PROTOCOLS
from netquarry.functions.net import is_internal
from netquarry.operators.common import CAPTURE, count_if
from netquarry.operators.evidence import lines_by_finding, summary_text
from netquarry.operators.scoring import DEEP_DIVE_THRESHOLD, confidence_rank


def victim_identity(
    dhcp: DataFrame, kerberos: DataFrame, smb_mapping: DataFrame, dns: DataFrame, mac_ip: DataFrame
) -> DataFrame:
    """Address, host name, hardware address, user and domain of the victim of each capture.

    Leases come first, then Kerberos clients (people before machine accounts). The domain
    of a file server name overrides the others. Local names and the packet table fill gaps.
    """
    address = F.coalesce(F.nullif("assigned_addr", F.lit("")), F.nullif("client_addr", F.lit("")))
    lease = dhcp.where(address.isNotNull()).groupBy(CAPTURE).agg(
        F.min_by(
            F.struct(address.alias("ip"), "host_name", "mac", "domain"),
            F.struct("ts", address.alias("a")),
        ).alias("lease")
    )
    # Logs are reduced to distinct values with their first time before texts are compared.
    client = F.col("client")
    clients = kerberos.where("client IS NOT NULL").groupBy(CAPTURE, "client", "orig_h").agg(F.min("ts").alias("ts"))
    login = clients.groupBy(CAPTURE).agg(
        F.min_by(
            F.struct(
                text.principal_name(client).alias("user"),
                text.principal_realm(client).alias("realm"),
                F.nullif("orig_h", F.lit("")).alias("ip"),
            ),
            F.struct(text.is_machine_account(client).alias("m"), "ts", "client", "orig_h"),
        ).alias("login")
    )
    directory = text.unc_domain(F.col("path"))
    paths = smb_mapping.groupBy(CAPTURE, "path").agg(F.min("ts").alias("ts"))
    # Not a filter, which would be pushed below the reduction and take every row's path apart.
    named = F.when(directory.isNotNull(), F.struct("ts", "path"))
    server = paths.groupBy(CAPTURE).agg(F.min_by(directory, named).alias("server_domain")).where(
        "server_domain IS NOT NULL"
    )
    ids = reduce(
        lambda a, b: a.unionByName(b), [d.select(CAPTURE) for d in (lease, login, server)]
    ).distinct()
    victims = ids.join(lease, CAPTURE, "left").join(login, CAPTURE, "left").join(server, CAPTURE, "left")
    victims = victims.select(
        CAPTURE,
        F.coalesce("lease.ip", "login.ip").alias("ip"),
        F.col("lease.host_name").alias("lease_name"),
        F.col("lease.mac").alias("lease_mac"),
        F.col("login.user").alias("windows_user"),
        F.coalesce("server_domain", "lease.domain", "login.realm").alias("domain"),
    )
    query = F.col("query")
    own_names = dns.where(text.is_mdns(query) & F.col("orig_h").isNotNull()).groupBy(
        CAPTURE, F.col("orig_h").alias("ip"), "query"
    ).agg(F.min("ts").alias("ts"))
    local_names = own_names.groupBy(CAPTURE, "ip").agg(
        F.min_by("query", F.struct("ts", "query")).alias("local_name")
    )
    macs = mac_ip.groupBy(CAPTURE, "ip").agg(
        F.min_by("mac", F.struct("first_frame", "mac")).alias("seen_mac")
    )
    return (
        victims.join(local_names, [CAPTURE, "ip"], "left")
        .join(macs, [CAPTURE, "ip"], "left")
        .select(
            CAPTURE,
            F.coalesce("lease_name", text.first_label(F.regexp_replace("local_name", r"\.local$", ""))).alias("hostname"),
            "ip",
            F.coalesce("lease_mac", "seen_mac").alias("mac"),
            "windows_user",
            "domain",
        )
    )


def primary_victim(talkers: DataFrame, hosts: DataFrame) -> DataFrame:
    """Source of the largest conversation that is internal, else the smallest internal address."""
    busiest = talkers.where(is_internal(F.col("src"))).groupBy(CAPTURE).agg(
        F.min_by("src", "position").alias("busiest")
    )
    lowest = hosts.where("is_internal").groupBy(CAPTURE).agg(F.min("ip").alias("lowest"))
    captures = hosts.select(CAPTURE).distinct()
    return captures.join(busiest, CAPTURE, "left").join(lowest, CAPTURE, "left").select(
        CAPTURE, F.coalesce("busiest", "lowest").alias("victim")
    )


def controller(smb_evidence: DataFrame) -> DataFrame:
    """Target of the first administrative-share event."""
    return smb_evidence.groupBy(CAPTURE).agg(F.min_by("resp_h", "position").alias("dc"))


def lan_segment(hosts: DataFrame) -> DataFrame:
    """Internal hosts without unset, link-local and broadcast addresses."""
    ip = F.col("ip")
    return hosts.where(
        F.col("is_internal") & (ip != "0.0.0.0") & ~ip.startswith("169.254.") & ~ip.endswith(".255")
    ).select(CAPTURE, "ip")


def visible_protocols(captures: DataFrame, k: int = 15) -> DataFrame:
    """Protocol names that mean something to an analyst."""
    noise = F.array(*[F.lit(p) for p in NOISE_PROTOCOLS])
    names = F.sort_array(F.array_except("protocols_present", noise))
    return captures.select(CAPTURE, F.slice(names, 1, k).alias("protocols"))


def summary(
    findings: DataFrame,
    victims: DataFrame,
    enriched: DataFrame | None = None,
    alerts: DataFrame | None = None,
) -> DataFrame:
    """One row per capture with findings: counts, severity, family, main techniques, victim."""
    level = F.col("confidence")
    # A capture has at most one finding per rule, so its list is as short as the rule table.
    ranked = F.array_sort(
        F.collect_list(F.struct(confidence_rank(level).alias("rank"), (-F.col("score")).alias("s"), "ttp_id", "name"))
    )
    counts = findings.groupBy(CAPTURE).agg(
        F.count("*").alias("findings"),
        count_if(level.isin("CONFIRMED", "HIGH")).alias("high"),
        count_if(level == "MEDIUM").alias("medium"),
        count_if(level == "LOW").alias("low"),
        F.size(F.collect_set("category")).cast("bigint").alias("tactic_areas"),
        F.transform(F.slice(ranked, 1, 4), lambda f: f["name"]).alias("names"),
    )
    out = counts.join(victims.select(CAPTURE, "ip", "hostname", "windows_user"), CAPTURE, "left")
    if alerts is not None:
        named = alerts.withColumn("family", text.family_from_text(F.col("signature"))).where("family IS NOT NULL")
        families = named.groupBy(CAPTURE).agg(
            F.min_by("family", F.struct("timestamp", "signature")).alias("malware_family")
        )
        out = out.join(families, CAPTURE, "left")
    else:
        out = out.withColumn("malware_family", F.lit(None).cast("string"))
    if enriched is not None:
        bad = enriched.where("is_confirmed_malicious").groupBy(CAPTURE).agg(
            F.sort_array(F.collect_set("ip")).alias("confirmed_ips")
        )
        out = out.join(bad, CAPTURE, "left")
    else:
        out = out.withColumn("confirmed_ips", F.lit(None).cast("array<string>"))
    host = F.coalesce("ip", F.lit("unknown host"))
    host = F.when(F.col("hostname").isNotNull(), F.concat("hostname", F.lit(" ("), host, F.lit(")"))).otherwise(host)
    user = F.when(F.col("windows_user").isNotNull(), F.concat(F.lit(", user "), "windows_user")).otherwise("")
    family = F.col("malware_family").isNotNull()
    return out.select(
        CAPTURE, "findings", "high", "medium", "low", "tactic_areas",
        F.when(F.col("high") > 0, "high").when(F.col("medium") > 0, "medium").otherwise("low").alias("severity"),
        "malware_family",
        F.coalesce("confirmed_ips", F.array().cast("array<string>")).alias("confirmed_ips"),
        # The leading technique is already named when there is no family to name.
        F.when(family, F.slice("names", 2, 3)).otherwise(F.slice("names", 1, 3)).alias("top_techniques"),
        F.concat(host, user).alias("victim"),
    )


def finding_view(
    findings: DataFrame,
    summaries: DataFrame | None = None,
    lines: DataFrame | None = None,
    preview: int = 3,
    threshold: float = DEEP_DIVE_THRESHOLD,
) -> DataFrame:
    """Findings for display: plain signal ids, indicators that count, guidance, evidence.

    Of the evidence (evidence.evidence_lines) each finding at the threshold shows the first ``preview`` rows of every kind.
    Lines with ``about`` need no summaries if the findings carry evidence.SUMMARY_SIGNALS as the struct ``_signals``: they
    are then made of the one reduction of the lines, so that evidence and signals are worked out once.
    """
    columns = [
        F.col(CAPTURE), *map(F.col, ("ttp_id", "name", "category", "mitre_tactic", "score", "confidence")),
        F.transform("signals_fired", lambda s: F.regexp_replace(s, "_weak$", "")).alias("signals_fired"),
        F.map_filter("raw_values", lambda k, v: v != 0).alias("indicators"),
        F.col("fp_notes").alias("guidance"),
    ]
    key, strong = [CAPTURE, "ttp_id"], F.col("score") >= threshold
    nothing = F.array().cast("array<string>")
    shown = F.coalesce(F.when(strong, F.col("evidence_preview")), nothing).alias("evidence_preview")
    if summaries is None and lines is not None and "about" in lines.columns:
        rows = findings.select("*", "_signals.*").join(lines_by_finding(lines, preview), key, "left")
        summary = summary_text(F.col("summary_kind"), F.col("summary_about"), F.col("summary_rows"))
        summary = F.when(strong & (F.col("summary_rows") > 0), summary)
        return rows.select(*columns, summary.alias("evidence_summary"), shown)
    out = findings.select(*columns)
    if summaries is None:
        out = out.withColumn("evidence_summary", F.lit(None).cast("string"))
    else:
        out = out.join(summaries.select(*key, F.col("summary").alias("evidence_summary")), key, "left")
        out = out.withColumn("evidence_summary", F.when(strong, F.col("evidence_summary")))
    if lines is None:
        return out.withColumn("evidence_preview", nothing)
    out = out.join(evidence_preview(lines, preview), key, "left")
    return out.withColumn("evidence_preview", shown)


def evidence_preview(lines: DataFrame, k: int = 3) -> DataFrame:
    """The first k lines of every kind of evidence, by kind and position; a short list a finding."""
    first = lines.where(F.col("position") <= k)
    return lines_by_finding(first, k).select(CAPTURE, "ttp_id", "evidence_preview")
