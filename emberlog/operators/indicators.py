"""Indicators of compromise from texts, and per-event enrichment."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberlog.functions.columns import entropy, field, is_public_ip

#: Pattern of each indicator type (fixed values).
PATTERNS = {
    "ipv4": r"\b[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\b",
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}",
    "url": r"https?://[^\s\"'<>]+",
    "sha256": r"\b[0-9a-fA-F]{64}\b",
    "sha1": r"\b[0-9a-fA-F]{40}\b",
    "md5": r"\b[0-9a-fA-F]{32}\b",
}

#: Upper-case hex of UTF-16LE without single surrogates.
_UTF16 = "^(?:..(?:[0-9A-CEF].|D[0-7])|..D[89AB]..D[C-F])+$"


def extract_iocs(df: DataFrame, text: str, types=tuple(PATTERNS), public_ips: bool = True) -> DataFrame:
    """(type, value) of every indicator of each row once, with the row's other columns.

    Type `domain` is the host of a URL, where it is a name.
    """
    content = F.coalesce(F.col(text), F.lit(""))

    def of_type(t: str):
        found = F.regexp_extract_all(content, F.lit(PATTERNS["url" if t == "domain" else t]), F.lit(0))
        if t == "domain":
            hosts = F.transform(found, lambda u: F.lower(F.regexp_extract(u, r"^https?://(?:[^/?#@]*@)?([^/?#:]*)", 1)))
            found = F.filter(hosts, lambda h: h.rlike(r"^[a-z0-9-]+(\.[a-z0-9-]+)*\.[a-z]{2,}$"))
        return F.transform(F.array_distinct(found), lambda v: F.struct(F.lit(t).alias("type"), v.alias("value")))

    found = [of_type(t) for t in types]
    rows = df.withColumn("ioc", F.explode(F.flatten(F.array(*found)))).select(*[c for c in df.columns if c != text], "ioc.type", "ioc.value")
    return rows.filter((F.col("type") != "ipv4") | is_public_ip(F.col("value"))) if public_ips else rows


def ioc_rollup(iocs: DataFrame, key: str) -> DataFrame:
    """How many rows hold each indicator, and the smallest and largest key."""
    return iocs.groupBy("type", "value").agg(F.count("*").alias("n"), F.min(key).alias("first_key"), F.max(key).alias("last_key"))


#: Order in which indicators are looked up, and zones from worst on (fixed values).
PRIORITY = ("sha256", "sha1", "md5", "ipv4", "domain", "url")
ZONES = ("Red", "Orange", "Yellow", "Grey", "Green")


def enrich_iocs(iocs: DataFrame, reputation: DataFrame, types=PRIORITY, most: int | None = None) -> DataFrame:
    """Each (type, value) of the types once, with its zone in a reputation table (type, value, zone), worst zones first.

    With `most`, only that many are looked up, in the order of PRIORITY and value (a limit of
    the caller); indicators that the table lacks are Grey; of several zones the worst counts.
    """
    rank = F.array_position(F.array(*map(F.lit, PRIORITY)), F.col("type"))
    asked = iocs.select("type", "value").filter(F.col("type").isin(*types)).distinct()
    if most is not None:
        asked = asked.orderBy(rank, "value").limit(most)
    order = lambda z: F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, ZONES)), z), F.lit(0)), F.lit(len(ZONES) + 1))
    worst = reputation.groupBy("type", "value").agg(F.min_by("zone", order(F.col("zone"))).alias("zone"))
    return asked.join(worst, ["type", "value"], "left").withColumn("zone", F.coalesce("zone", F.lit("Grey"))).orderBy(order(F.col("zone")), rank, "value")


def entropy_level(df: DataFrame, name: str = "QueryName") -> DataFrame:
    e = F.round(entropy(field(df, name)), 2)
    return df.withColumn(f"{name}_entropy", e).withColumn(f"{name}_entropy_level", F.when(e > 4.5, "very_high").when(e > 3.5, "high").when(e > 2.5, "medium").otherwise("low"))


def obfuscation_score(df: DataFrame, name: str = "CommandLine") -> DataFrame:
    """obfuscation_score, and obfuscation_signs: the names of the parts that add to it."""
    c = field(df, name)
    count = lambda x: F.length(c) - F.length(F.replace(c, F.lit(x), F.lit("")))
    parts = [("carets", count("^") >= 3, 3), ("joined strings", F.contains(c, F.lit('"+"')) | F.contains(c, F.lit("'+'")), 3), ("backticks", count("`") >= 2, 2), ("variables", count("%") >= 4, 2), ("length", F.octet_length(c) > 1000, 1), ("entropy", entropy(c) > 4.5, 2)]
    signs = F.array_compact(F.array(*[F.when(test, F.struct(F.lit(sign).alias("sign"), F.lit(weight).alias("weight"))) for sign, test, weight in parts]))
    found = df.withColumn("__signs", signs)
    total = F.aggregate("__signs", F.lit(0), lambda acc, x: acc + x["weight"])
    return found.withColumns({"obfuscation_score": total, "obfuscation_signs": F.transform("__signs", lambda x: x["sign"])}).drop("__signs")


def decode_utf16_base64(df: DataFrame, name: str = "CommandLine") -> DataFrame:
    """decoded_<name>: the first base64 run of 8 characters or more that decodes to printable text."""
    runs = F.regexp_extract_all(field(df, name), F.lit(r"[A-Za-z0-9+/]{8,}={0,2}"), F.lit(0))
    whole = F.filter(runs, lambda r: F.length(r) % 4 == 0)
    binary = F.filter(F.transform(whole, lambda r: F.try_to_binary(r, F.lit("base64"))), lambda b: b.isNotNull())
    wide = lambda b: F.when(F.hex(b).rlike(_UTF16), F.decode(b, "UTF-16LE"))
    texts = F.flatten(F.transform(binary, lambda b: F.array(F.when(F.is_valid_utf8(b.cast("string")), b.cast("string")), wide(b))))
    printable = F.filter(texts, lambda t: t.isNotNull() & (t != "") & ~F.regexp_replace(t, r"[\r\n\t]", "").rlike(r"\p{Cc}"))
    return df.withColumn(f"decoded_{name}", F.try_element_at(printable, F.lit(1)))


#: Fields that may hold coded commands (fixed values).
CODED_FIELDS = ("CommandLine", "ScriptBlockText", "Payload", "ServiceFileName")


def decode_base64(df: DataFrame, names=CODED_FIELDS) -> DataFrame:
    """decoded_<name> of every one of the fields that the events have."""
    known = {c.lower() for c in df.columns}
    for name in names:
        if name.lower() in known:
            df = decode_utf16_base64(df, name)
    return df


def deobfuscate(df: DataFrame, name: str = "CommandLine") -> DataFrame:
    """deobfuscated_<name> and deobfuscation (kinds found), both null unless the text changes.

    Three carets or more go, and so do backticks before letters where there are two or
    more; joined strings and parts of environment variables are only named.
    """
    c = field(df, name)
    count = lambda x: F.length(c) - F.length(F.replace(c, F.lit(x), F.lit("")))
    carets, ticks = count("^") >= 3, count("`") >= 2
    plain = F.when(carets, F.replace(c, F.lit("^"), F.lit(""))).otherwise(c)
    plain = F.when(ticks, F.regexp_replace(plain, "`([a-zA-Z])", "$1")).otherwise(plain)
    joined = F.contains(c, F.lit("'+'")) & c.rlike(r"'[^']*'\s*\+\s*'[^']*'")
    part = F.contains(c, F.lit(":~")) & F.contains(c, F.lit("%"))
    kinds = F.concat_ws(",", *[F.when(test, kind) for test, kind in ((carets, "CARET"), (ticks, "BACKTICK"), (joined, "CONCAT"), (part, "ENV_SUBSTR"))])
    changed = (F.length(c) > 10) & (plain != c)
    return df.withColumns({f"deobfuscated_{name}": F.when(changed, plain), "deobfuscation": F.when(changed, kinds)})


#: System tools that attackers use, in the order in which they are named (fixed values).
LOLBINS = (
    "bash.exe", "bginfo.exe", "bitsadmin", "certutil", "cmd.exe", "cmstp", "control", "cscript", "dfsvc", "dnscmd", "esentutl.exe", "explorer.exe", "extrac32.exe", "findstr.exe", "forfiles", "ftp.exe", "hh.exe", "ieexec", "infdefaultinstall.exe", "installutil", "makecab.exe", "mavinject.exe", "msbuild", "msconfig", "mshta", "msiexec", "msxsl.exe", "pcalua", "powershell", "presentationhost", "pwsh", "regasm", "register-cimprovider.exe", "regsvcs", "regsvr32", "replace.exe", "rpcping.exe", "rundll32", "scriptrunner.exe", "sfc.exe", "syncappvpublishingserver.exe", "wmic", "wscript", "xwizard",
)


def lolbin(df: DataFrame, name: str = "Image") -> DataFrame:
    """is_lolbin and lolbin_name: the first of LOLBINS that the image holds, else null."""
    first = F.coalesce(*[F.when(F.contains(F.lower(field(df, name)), F.lit(x)), F.lit(x)) for x in LOLBINS])
    return df.withColumns({"is_lolbin": F.when(first.isNotNull(), F.lit(True)), "lolbin_name": first})


def inline_iocs(df: DataFrame, name: str = "_raw") -> DataFrame:
    """ioc_ips, ioc_urls and ioc_domains of each event, in the order of their first places, or null."""
    tlds = "com|net|org|io|xyz|top|ru|cn|tk|pw|info|biz|cc"
    found = lambda pattern: F.array_distinct(F.regexp_extract_all(field(df, name), F.lit(pattern), F.lit(0)))
    joined = lambda values: F.when(F.size(values) > 0, F.array_join(values, ", "))
    ips = F.filter(found(PATTERNS["ipv4"]), lambda x: ~x.rlike(r"^(10|192\.168|127|0)\."))
    domains = found(rf"\b[a-zA-Z0-9](?:[a-zA-Z0-9\-]{{0,61}}[a-zA-Z0-9])?\.(?:{tlds})\b")
    return df.withColumns({"ioc_ips": joined(ips), "ioc_urls": joined(found(PATTERNS["url"])), "ioc_domains": joined(domains)})
