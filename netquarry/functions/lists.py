"""Word lists, address ranges and lookup tables.

The entries below are data that decide results, kept in one place.
"""

# --- fixed values: address ranges treated as internal -----------------------
INTERNAL_RANGES = (
    "10.0.0.0/8", "172.16.0.0/12", "192.168.0.0/16",
    "127.0.0.0/8", "169.254.0.0/16", "0.0.0.0/32",
)

# --- fixed values: top-level domains with a high abuse rate ------------------
# "biz.pl" has two labels and only the last label is compared, so it never matches.
HIGH_RISK_TLDS = (
    "su", "ru", "cyou", "xyz", "top", "tk", "ml", "ga", "cf", "gq", "pw", "cc",
    "ws", "biz.pl", "click", "download", "host", "uno", "rest", "icu", "monster",
    "cfd", "sbs", "beauty",
)

# --- fixed values: words of delivery and remote-access infrastructure --------
NAME_KEYWORDS = (
    "crack", "cracked", "keygen", "serial", "patch", "loader", "payload",
    "stealer", "modapk", "modandcracked", "apkmod", "hackmod", "netsupport",
    "anydesk", "remotedesktop", "teamviewer-", "malware", "virus", "trojan",
    "ransomware",
)

# --- fixed values: web services used as command channels ---------------------
WEB_SERVICE_DOMAINS = (
    "api.telegram.org", "t.me", "core.telegram.org", "discord.com",
    "discordapp.com", "cdn.discordapp.com", "pastebin.com", "rentry.co",
    "hastebin.com", "api.slack.com", "hooks.slack.com",
    "raw.githubusercontent.com",
)

# --- fixed values: domains never reported as indicators ----------------------
SAFE_DOMAINS = (
    "microsoft.com", "msn.com", "office.com", "office.net", "windows.com",
    "windowsupdate.com", "bing.com", "google.com", "googleapis.com", "apple.com",
    "amazon.com", "akamai.com", "cloudflare.com", "gvt1.com", "gvt2.com",
    "youtube.com", "githubusercontent.com", "msedge.net", "azure.com",
    "azureedge.net", "azurefd.net", "teamviewer.com", "zoom.us", "slack.com",
    "dropbox.com",
)

# --- fixed values: protocol names without meaning to an analyst --------------
NOISE_PROTOCOLS = (
    "_ws.malformed", "data", "data-text-lines", "epm", "browser", "frame", "eth",
    "ip", "tcp", "udp", "icmp", "raw",
)

# --- fixed values: connection states ----------------------------------------
HALF_OPEN_STATES = ("S0", "REJ", "RSTO", "RSTOS0")
INBOUND_SCAN_STATES = ("S0", "REJ", "RSTO")
WINRM_PORTS = (5985, 5986)

# --- fixed values: alert text to technique, first match wins -----------------
ALERT_TECHNIQUES = (
    ("ET DNS POSSIBLE DNS TUNNEL", "T1071.004"),
    ("ET DNS Query to a *.TK Domain", "T1568.002"),
    ("ET DNS Suspicious Lookup", "T1071.004"),
    ("ET DNS", "T1071.004"),
    ("ET SCAN NMAP", "T1046"),
    ("ET SCAN Masscan", "T1046"),
    ("ET SCAN", "T1046"),
    ("ET TROJAN Cobalt Strike", "T1071"),
    ("ET TROJAN Metasploit", "T1059"),
    ("ET TROJAN", "T1071"),
    ("ET MALWARE", "T1071"),
    ("ET SMB", "T1021.002"),
    ("ET NETBIOS", "T1021.002"),
    ("ET CREDENTIAL", "T1078"),
    ("ET WEB_SERVER SQL Injection", "T1190"),
    ("ET WEB_SERVER", "T1190"),
    ("ET POLICY Kerberos", "T1558"),
    ("ET POLICY FTP", "T1048"),
    ("ET POLICY Cleartext", "T1040"),
    ("ET POLICY", "T1071"),
    ("ET EXPLOIT", "T1190"),
    ("ET INFO", "T1082"),
    ("GPL", "T1059"),
)

# --- fixed values: TLS client and server fingerprints of known tooling -------
BAD_JA3 = {
    "72a589da586844d7f0818ce684948eea": "Cobalt Strike default beacon",
    "a0e9f5d64349fb13191bc781f81f42e1": "Cobalt Strike beacon (Malleable C2)",
    "a1cdd6ef66c0a1e3e464cad8437b7b79": "Cobalt Strike beacon (Malleable C2)",
    "fc54e0d16d9764783542f0146a98b300": "Cobalt Strike beacon (Malleable C2 variant)",
    "e7d705a3286e19ea42f587b6d84c549f": "Cobalt Strike HTTPS malleable",
    "de350869b8c85de67a350c8d186f11e6": "Metasploit Meterpreter",
    "6734f37431670b3ab4292b8f60f29984": "Metasploit Meterpreter",
    "7dd80c5c57a4c47985fc87e37ab33d87": "AsyncRAT / QuasarRAT",
    "3b5074b1b5d032e5620f69f9f700ff0e": "AgentTesla / NjRAT C2",
    "2fe9b0e731d3d41b2b84e8e1d6186836": "Generic malware implant (multiple families)",
    "6b9b58d3cb2fbbcfb52fb2f2e43a1c70": "Emotet C2",
    "44d4a61e0a93c91edf75e87d9f8a71f9": "Qbot banker C2",
    "eb1d94daa7e0344597e756a1fb6e7054": "IcedID / BokBot C2",
}
BAD_JA3S = {
    "ec74a5c51106f0419184d0dd08fb05bc": "Cobalt Strike Team Server response",
}

# --- fixed values: confidence levels, best first ------------------------------
CONFIDENCE_RANK = {"CONFIRMED": 0, "HIGH": 1, "MEDIUM": 2, "LOW": 3, "ANOMALY": 4}
