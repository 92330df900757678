"""Indicators read from fields whose names tell what they hold, without well-known noise."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberlog.functions.columns import any_of, field, is_public_ip, octets
from emberlog.functions.tables import broadcast_if_small, written
from emberlog.operators.indicators import PATTERNS, extract_iocs

#: Names of fields (lower case) by what they hold (fixed values).
IP_FIELDS = ("sourceip", "destinationip", "src_ip", "dst_ip", "ipaddress", "clientipaddress", "serveripaddress", "remoteaddress", "localaddress", "sourceaddress", "destinationaddress", "calleripaddress", "clientip", "serverip", "source_ip", "dest_ip", "src", "dst", "id_orig_h", "id_resp_h", "c-ip", "s-ip", "shost", "dhost")
NOT_IP = ("script", "descript", "pip", "zip", "tip")
NOT_ADDRESS = ("email", "mail", "street")
PATH_FIELDS = ("image", "parentimage", "targetfilename", "sourcefilename", "imageloaded", "servicefilename")
DOMAIN_FIELDS = ("queryname", "destinationhostname", "sourcehostname", "r-dns", "query", "host", "server_name", "sni", "domain")
REGISTRY_FIELDS = ("targetobject", "objectname")
SERVICE_FIELDS = ("servicename", "service_name")
WHOLE_NAME = r"\b(?:[a-zA-Z0-9](?:[a-zA-Z0-9\-]{0,61}[a-zA-Z0-9])?\.)+[a-zA-Z]{2,63}\b"
DOMAIN = r"\b[a-zA-Z0-9](?:[a-zA-Z0-9\-]{0,61}[a-zA-Z0-9])?\.[a-zA-Z]{2,63}\b"

#: Programs and folders of the operating system (fixed values).
NOISE_PROGRAMS = ("svchost.exe", "services.exe", "lsass.exe", "csrss.exe", "smss.exe", "wininit.exe", "conhost.exe", "dwm.exe", "taskhostw.exe", "runtimebroker.exe", "searchindexer.exe", "wmiprvse.exe", "spoolsv.exe", "dllhost.exe", "backgroundtaskhost.exe", "sihost.exe", "fontdrvhost.exe", "logonui.exe", "winlogon.exe", "ctfmon.exe", "searchprotocolhost.exe", "searchfilterhost.exe")
NOISE_PATHS = ("c:\\windows\\explorer.exe", "c:\\windows\\system32\\msiexec.exe")
NOISE_FOLDERS = ("winsxs", "assembly", "microsoft.net", "syswow64", "servicing")
NOISE_KEYS = ("\\currentcontrolset\\services\\bam\\", "\\deliveryoptimization\\", "\\tracing\\")
#: Domains of infrastructure, and last labels that are file extensions (fixed values; "com" is left out, which is a top-level domain as well).
NOISE_DOMAINS = ("microsoft.com", "windows.com", "windowsupdate.com", "microsoftonline.com", "microsoftonline.cn", "office.com", "office365.com", "azure.com", "msocsp.com", "msn.com", "live.com", "bing.com", "aka.ms", "msol-test.com", "ccsctp.com", "live-int.com", "spoppe.com", "passport.net", "w3.org", "globalsign.com", "digicert.com", "verisign.com", "symantec.com", "thawte.com", "geotrust.com", "letsencrypt.org", "oasis-open.org", "xmlsoap.org", "dmtf.org", "outlook.com", "outlook.cn", "gmail.com", "google.com", "yandex.net", "yandex.ru", "cloudapp.net", "localhost.com", "kaspersky.com", "microsoft.net")
FILE_ENDINGS = ("exe", "dll", "sys", "bat", "cmd", "ps1", "vbs", "js", "wsf", "msi", "msp", "scr", "log", "txt", "cfg", "ini", "xml", "json", "yaml", "yml", "csv", "tsv", "tmp", "bak", "old", "dat", "db", "sqlite", "png", "jpg", "gif", "bmp", "ico", "svg", "doc", "docx", "xls", "xlsx", "pdf", "ppt", "pptx", "zip", "rar", "gz", "tar", "7z", "cab", "evtx", "etl", "dmp", "aspx", "asp", "php", "jsp", "cgi", "htm", "html", "css", "cs", "java", "py", "rb", "go", "rs", "cpp", "c", "h", "psm1", "psd1", "conf", "config", "properties", "env", "toml", "lock", "gen", "heur", "script")
SCANNER_PREFIXES = ("trojan.", "exploit.", "heur:", "not-a-virus:", "backdoor.", "worm.", "virus.", "adware.", "riskware.", "hacktool.", "ransom.", "rootkit.", "bss:")
NOISE_URL_PARTS = ("schemas.microsoft.com", "www.w3.org", "schemas.openxmlformats.org", "purl.org", "docs.oasis-open.org", "xmlsoap.org", "://localhost", ".local/", ".local:", ".local\\", ".internal/", ".internal:", "\\r\\n", "&#13;", "&#10;", "replace_percent_sign", "/unsubscribe", "/unsub/")
ROLE_MAILBOXES = ("abuse", "postmaster", "noreply", "no-reply", "nobody", "dummy", "bookingmailbox", "mailer-daemon")


def _either(words) -> str:
    return "|".join(re.escape(w) for w in words)


def noise_path(path: Column) -> Column:
    p = F.replace(F.lower(path), F.lit("/"), F.lit("\\"))
    system = p.rlike(r"^c:\\windows\\(.*\\)?(" + _either(NOISE_PROGRAMS) + ")$") | p.rlike(r"^c:\\windows\\(" + _either(NOISE_FOLDERS) + r")\\")
    return (F.octet_length(p) < 4) | p.isin(*NOISE_PATHS) | system


def noise_registry(key: Column) -> Column:
    return key.isin("", "-") | F.lower(key).rlike(_either(NOISE_KEYS))


def noise_domain(domain: Column) -> Column:
    d = F.lower(domain)
    known = d.rlike(r"(^|\.)(" + _either(NOISE_DOMAINS) + ")$") | d.rlike(r"\.(local|internal)$")
    no_domain = d.rlike(r"(^|\.)(" + _either(FILE_ENDINGS) + ")$") | d.rlike("^(" + _either(SCANNER_PREFIXES) + ")") | d.rlike(r"\.(proxyshell|generic)")
    return known | no_domain | (F.length(d) < 4) | ~F.contains(d, F.lit("."))


def noise_url(url: Column) -> Column:
    u = F.lower(url)
    host = F.regexp_extract(u, r"://(?:[^/?#@]*@)?([0-9.]+)(?:[:/?#]|$)", 1)
    inside = octets(host).isNotNull() & ~is_public_ip(host)
    return inside | u.rlike(_either(NOISE_URL_PARTS)) | u.rlike(r"\.(local|internal)$") | u.rlike(_either(NOISE_DOMAINS))


def noise_email(email: Column) -> Column:
    e = F.lower(email)
    generated = e.rlike("^[^@]{36}@") & (F.length(F.regexp_replace(F.substring_index(e, "@", 1), "[^-]", "")) == 4)
    return e.rlike(r"^(healthmailbox|%|postman[0-9]+@|[0-9]{14}|[0-9a-f]{32,}@|(" + _either(ROLE_MAILBOXES) + ")@)") | e.rlike(r"\.(local|internal)$|@doesntexist\.|@localhost") | generated


def implausible_hash(value: Column) -> Column:
    """Hex strings with fewer than 8 different digits, more than 40 % zeros, or decimal digits only."""
    v = F.lower(value)
    kinds = sum((F.contains(v, F.lit(c)).cast("int") for c in "0123456789abcdef"), F.lit(0))
    zeros = F.length(v) - F.length(F.replace(v, F.lit("0"), F.lit("")))
    return (kinds < 8) | (zeros * 5 > F.length(v) * 2) | v.rlike("^[0-9]+$")


def is_noise(kind: Column, value: Column) -> Column:
    """Whether an indicator is missing or well-known noise."""
    v, t = F.trim(F.coalesce(value, F.lit(""))), kind
    tests = {"file_path": noise_path(v), "registry_key": noise_registry(v), "domain": noise_domain(v), "url": noise_url(v), "email": noise_email(v), **dict.fromkeys(("md5", "sha1", "sha256"), implausible_hash(v)), "pipe_name": v.isin("-", "\\"), "service_name": v == "-", "task_name": v == "-", "ipv4": ~is_public_ip(v)}
    return (v == "") | any_of([(t == kind) & test for kind, test in tests.items()])


def without_noise(iocs: DataFrame) -> DataFrame:
    """Rows of (type, value) that are no well-known noise; missing values go."""
    return iocs.filter(~is_noise(F.col("type"), F.col("value")))


def kinds_of(name: str) -> list[str]:
    """What a field of this name may hold."""
    n = name.lower()
    ip = n in IP_FIELDS or ("ip" in n and not any(w in n for w in NOT_IP)) or ("address" in n and not any(w in n for w in NOT_ADDRESS))
    domain = n in DOMAIN_FIELDS or any(w in n for w in ("hostname", "domainname", "fqdn"))
    tests = {"ipv4": ip, "file_path": n in PATH_FIELDS, "registry_key": n in REGISTRY_FIELDS, "service_name": n in SERVICE_FIELDS, "task_name": n == "taskname", "pipe_name": n == "pipename", "domain": domain}
    return [kind for kind, holds in tests.items() if holds]


def field_iocs(df: DataFrame, key: str, suffixes: DataFrame | None = None) -> DataFrame:
    """(key, type, value, field) of every indicator in the fields named for it, without noise, in one pass.

    A domain is a label and a last label of letters; with a list of public suffixes (see
    with_public_suffix) it is a whole name below one of them.
    """

    found = indicators_of(df, key, domain=DOMAIN if suffixes is None else WHOLE_NAME)
    if found is None:
        return df.select(key, F.lit("").alias("type"), F.lit("").alias("value"), F.lit("").alias("field")).limit(0)
    iocs = without_noise(df.select(key, F.explode(found).alias("i")).select(key, "i.type", "i.value", "i.field"))
    if suffixes is None:
        return iocs
    domains = with_public_suffix(iocs.filter("type = 'domain'"), suffixes).filter("registered_domain IS NOT NULL").select(iocs.columns)
    return iocs.filter("type <> 'domain'").unionByName(domains)


def indicators_of(df: DataFrame, *without: str, domain: str = DOMAIN) -> Column | None:
    """Array of (type, value, field) of an event's fields but those of `without`; None if no field is named for an indicator."""

    def found(kind: str, name: str) -> Column:
        text = F.trim(field(df, name))
        pattern = {"ipv4": PATTERNS["ipv4"], "domain": domain}.get(kind)
        values = F.array_distinct(F.regexp_extract_all(F.lower(text) if kind == "domain" else text, F.lit(pattern), F.lit(0))) if pattern else F.array(text)
        return F.transform(values, lambda v: F.struct(F.lit(kind).alias("type"), v.alias("value"), F.lit(name).alias("field")))

    parts = [found(kind, name) for name in df.columns if name not in without for kind in kinds_of(name)]
    return F.flatten(F.array(*parts)) if parts else None


def with_public_suffix(df: DataFrame, suffixes: DataFrame, name: str = "value") -> DataFrame:
    """`df` with public_suffix and registered_domain (a label more) of a column of domains; null where no suffix fits.

    suffixes(suffix) is a list of public suffixes, one a row, in which `*.x` stands for every
    name right below x, and `!y` takes y out of such a rule.  The longest suffix that fits
    counts.  Each different domain is looked up once, by its last labels.
    """
    domain = F.rtrim(F.lower(F.trim(F.col(f"`{name}`"))), F.lit("."))
    known = broadcast_if_small(written(suffixes.select(F.lower(F.trim("suffix")).alias("rule")).filter("rule <> ''").distinct(), "suffixes"))
    distinct = df.select(domain.alias("domain")).filter("domain <> ''").distinct()
    labels = F.split("domain", r"\.", -1)
    size = F.size("labels")
    tails = distinct.withColumn("labels", labels).select("domain", "labels", F.explode(F.sequence(F.lit(1), size)).alias("k"))
    tail = lambda k: F.array_join(F.slice("labels", size - k + 1, k), ".")
    keys = F.array(tail(F.col("k")), F.concat(F.lit("!"), tail(F.col("k"))), F.when(F.col("k") > 1, F.concat(F.lit("*."), tail(F.col("k") - 1))))
    hits = tails.select("domain", "labels", "k", F.explode(keys).alias("key")).filter("key IS NOT NULL").join(known, F.col("key") == F.col("rule"))
    exact = F.max(F.when(F.startswith("key", F.lit("!")), F.col("k") - 1))
    longest = hits.groupBy("domain", "labels").agg(F.coalesce(exact, F.max("k")).alias("k"))
    found = longest.select("domain", tail(F.col("k")).alias("public_suffix"), F.when(F.col("k") < size, tail(F.col("k") + 1)).alias("registered_domain"))
    taken = {"public_suffix", "registered_domain"} & set(df.columns)
    if taken:
        raise ValueError(f"columns that are there: {sorted(taken)}")
    return df.join(found.withColumnRenamed("domain", "__emberlog_domain"), domain == F.col("__emberlog_domain"), "left").drop("__emberlog_domain")


def extract_iocs_all_text(df: DataFrame, key: str, without=("_raw",)) -> DataFrame:
    """(key, type, value) of every pattern in the values of all columns but `without`."""
    text = F.concat_ws(" ", *[field(df, c) for c in df.columns if c not in (key, *without)])
    return without_noise(extract_iocs(df.select(key, text.alias("__text")), "__text"))


def iocs_table(iocs: DataFrame, first: str, last: str | None = None) -> DataFrame:
    """Type, Value, Count, First Seen, Last Seen, Source Fields and, where there is source_file, Source Files of indicators(type, value, field, time), for CSV."""
    files = [F.array_join(F.array_sort(F.collect_set("source_file")), "; ").alias("Source Files")] if "source_file" in iocs.columns else []
    grouped = iocs.groupBy(F.col("type").alias("Type"), F.col("value").alias("Value"))
    return grouped.agg(F.count("*").alias("Count"), F.min(first).alias("First Seen"), F.max(last or first).alias("Last Seen"), F.array_join(F.array_sort(F.collect_set("field")), "; ").alias("Source Fields"), *files)
