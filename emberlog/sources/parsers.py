"""Log lines to maps of text fields, as column expressions; empty values are left out, null lines have no fields."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from emberlog.sources.json_lines import json_fields


def _entry(key: Column, value: Column) -> Column:
    return F.struct(key.alias("key"), value.alias("value"))


def _let(value: Column, then) -> Column:
    """`then` of a value that is computed once, however often `then` names it."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def first_wins(entries: Column) -> Column:
    """Map of (key, value) entries with non-empty values; of equal keys the first counts."""
    full = F.filter(entries, lambda e: F.coalesce(e["value"], F.lit("")) != "")
    first = lambda x: F.filter(x, lambda e, i: F.array_position(x["key"], e["key"]) == i + 1)
    return F.map_from_entries(_let(full, first))


def last_wins(entries: Column) -> Column:
    return first_wins(F.reverse(entries))


def _pairs(text: Column, pattern: str, key: int = 1, value: int = 2) -> Column:
    keys, values = (F.regexp_extract_all(text, F.lit(pattern), F.lit(g)) for g in (key, value))
    return F.zip_with(keys, values, _entry)


def _unquoted(entries: Column) -> Column:
    return F.transform(entries, lambda e: _entry(e["key"], F.regexp_replace(e["value"], '^"(.*)"$', "$1")))


def _groups(text: Column, pattern: str, names) -> Column:
    """Named groups of a pattern as entries ('-' counts as missing)."""
    parts = [_entry(F.lit(n), F.nullif(F.regexp_extract(text, pattern, i + 1), F.lit("-"))) for i, n in enumerate(names) if n]
    return F.array(*parts)


_RFC5424 = r"^<([0-9]{1,3})>([0-9]+) (\S+) (\S+) (\S+) (\S+) (\S+) ?(.*)$"
_RFC3164 = r"^(?:<([0-9]{1,3})>)?([A-Z][a-z]{2}\s+[0-9]{1,2} [0-9:]{8}) (\S+) ([^\s\[:]+)(?:\[([0-9]+)\])?: ?(.*)$"


def syslog_fields(text: Column) -> Column:
    """RFC 5424, else RFC 3164 (whose message may hold k=v pairs), else the message alone."""
    pri = F.regexp_extract(text, "^<([0-9]{1,3})>", 1).try_cast("int")
    priority = F.array(*[_entry(F.lit(n), v.cast("string")) for n, v in (("priority", pri), ("facility", F.floor(pri / 8)), ("severity", pri % 8))])
    new = F.concat(priority, _groups(text, _RFC5424, (None, "version", "timestamp", "hostname", "app_name", "procid", "msgid", "message")))
    old = _groups(text, _RFC3164, (None, "timestamp", "hostname", "app_name", "procid", "message"))
    pairs = _unquoted(_pairs(F.regexp_extract(text, _RFC3164, 6), r'(\w+)=("[^"]*"|\S+)'))
    return first_wins(F.when(text.rlike(_RFC5424), new).when(text.rlike(_RFC3164), F.concat(priority, old, pairs)).otherwise(F.array(_entry(F.lit("message"), text))))


_CEF_NAMES = ("CEFVersion", "DeviceVendor", "DeviceProduct", "DeviceVersion", "DeviceEventClassID", "Name", "Severity")
_CEF = r"CEF:([0-9]+)\|((?:[^|\\]|\\.)*)\|((?:[^|\\]|\\.)*)\|((?:[^|\\]|\\.)*)\|((?:[^|\\]|\\.)*)\|((?:[^|\\]|\\.)*)\|((?:[^|\\]|\\.)*)\|(.*)$"


def cef_fields(text: Column) -> Column:
    """Null where the line is no CEF record."""
    pairs = _pairs(F.regexp_extract(text, _CEF, 8), r"(\w+)=(.*?)(?=\s+\w+=|\s*$)")
    clean = F.transform(pairs, lambda e: _entry(e["key"], F.regexp_replace(e["value"], r"\\([=\\])", "$1")))
    return F.when(text.rlike(_CEF), last_wins(F.concat(_groups(text, _CEF, _CEF_NAMES), clean)))


def leef_fields(text: Column) -> Column:
    """LEEF 1.0 (tab) and 2.0 (the delimiter is the first character of the extension); null for other lines."""
    two = text.rlike(r"LEEF:2\.")
    parts = F.split(F.regexp_extract(text, r"LEEF:(.*)$", 1), r"\|", 6)
    names = ("LEEFVersion", "DeviceVendor", "DeviceProduct", "DeviceVersion", "DeviceEventID")
    header = F.array(*[_entry(F.lit(n), F.get(parts, F.lit(i))) for i, n in enumerate(names)])
    tail = F.get(parts, F.lit(5))
    delimiter = F.when(two, F.substring(tail, 1, 1)).otherwise(F.lit("\t"))
    items = F.split(F.when(two, F.substring(tail, 2, 1_000_000_000)).otherwise(tail), F.concat(F.lit(r"\Q"), delimiter, F.lit(r"\E")))
    pairs = F.transform(items, lambda x: _entry(F.trim(F.substring_index(x, "=", 1)), F.when(F.contains(x, F.lit("=")), F.regexp_extract(x, r"(?s)^[^=]*=(.*)$", 1))))
    return F.when(text.rlike(r"LEEF:[12]\.0\|") & (F.size(parts) >= 5), last_wins(F.concat(header, F.coalesce(pairs, F.array().cast("array<struct<key:string,value:string>>")))))


def auditd_fields(text: Column) -> Column:
    return last_wins(_unquoted(_pairs(text, r'(\w+)=("[^"]*"|\S+)')))


def event_xml_fields(text: Column) -> Column:
    """Fields of one <Event> block: named Data, leaf elements, and attributes of the system elements."""
    data = _pairs(text, r"""<Data Name=["']([^"']+)["'][^>]*>([^<]*)</Data>""")
    leaves = F.filter(_pairs(text, r"<([A-Za-z]\w*)(?:\s[^>]*)?>([^<]+)</\1>"), lambda e: e["key"] != "Data")
    tags = F.regexp_extract_all(text, F.lit(r"<(?:Provider|TimeCreated|Execution|Security|Correlation)\s[^>]*>"), F.lit(0))
    attributes = F.flatten(F.transform(tags, lambda t: _attributes(t)))
    both = F.transform(F.concat(data, leaves), lambda e: _entry(e["key"], _unescaped(e["value"])))
    return last_wins(F.concat(attributes, both))


def _attributes(tag: Column) -> Column:
    element = F.regexp_extract(tag, r"^<(\w+)", 1)
    named = _pairs(tag, r"""\s(\w+)=["']([^"']*)["']""")
    return F.transform(named, lambda e: _entry(F.when(e["key"] == "Name", F.concat(element, F.lit("_"), e["key"])).otherwise(e["key"]), e["value"]))


def _unescaped(text: Column) -> Column:
    for name, sign in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&amp;", "&")):
        text = F.replace(text, F.lit(name), F.lit(sign))
    return text


_ACCESS = r'^(\S+) \S+ (\S+) \[([^\]]+)\] "(\S+) (\S+)(?: ([^"]*))?" ([0-9]{3}) ([0-9]+|-)'


def text_fields(text: Column) -> Column:
    """Access-log fields, else message, first ISO time and first level word."""
    access = _groups(text, _ACCESS, ("c-ip", "cs-username", "timestamp", "cs-method", "cs-uri-stem", "cs-version", "sc-status", "sc-bytes"))
    time = F.regexp_extract(text, r"[0-9]{4}-[0-9]{2}-[0-9]{2}[T ][0-9]{2}:[0-9]{2}:[0-9]{2}\S*", 0)
    level = F.upper(F.regexp_extract(text, r"(?i)\b(TRACE|DEBUG|INFO|NOTICE|WARN|WARNING|ERROR|CRITICAL|FATAL)\b", 1))
    plain = F.array(_entry(F.lit("message"), text), _entry(F.lit("timestamp"), time), _entry(F.lit("level"), level))
    return first_wins(F.when(text.rlike(_ACCESS), access).otherwise(plain))


# Long field names and the short names that rules use; of two that set one name the later counts.
ALIASES = [
    ("Provider_#attributes_Name", "Provider_Name"), ("Provider_#attributes_Guid", "Provider_Guid"), ("Execution_#attributes_ProcessID", "ExecutionProcessID"), ("Execution_#attributes_ThreadID", "ExecutionThreadID"), ("TimeCreated_#attributes_SystemTime", "TimeCreated"), ("Security_#attributes_UserID", "SecurityUserID"),
    ("NewProcessName", "Image"), ("ParentProcessName", "ParentImage"), ("SubjectUserName", "User"), ("SubjectUserSid", "UserSid"), ("SubjectDomainName", "UserDomain"), ("SubjectLogonId", "LogonId"), ("NewProcessId", "ProcessId"), ("CreatorProcessId", "ParentProcessId"), ("TokenElevationType", "IntegrityLevel"),
    ("TargetUserName", "User"), ("IpAddress", "SourceIp"), ("IpPort", "SourcePort"), ("WorkstationName", "Workstation"),
    ("EventXML_ServiceName", "ServiceName"), ("EventXML_Version", "ServiceVersion"), ("EventXML_ImagePath", "ServiceImagePath"), ("EventXML_Param1", "param1"), ("EventXML_Param2", "param2"), ("EventXML_Param3", "param3"),
    ("Threat Name", "ThreatName"), ("Threat ID", "ThreatID"), ("Detection Source", "DetectionSource"), ("Process Name", "ProcessName"), ("Detection User", "DetectionUser"), ("Action Name", "ActionName"), ("Severity Name", "SeverityName"), ("Category Name", "CategoryName"), ("Product Name", "ProductName"), ("Product Version", "ProductVersion"),
]
MACOS = [("processImagePath", "Image"), ("processID", "ProcessId"), ("eventMessage", "message")]


def with_aliases(fields: Column, aliases=tuple(ALIASES)) -> Column:
    """Adds short names that are not there; fields EventXML_x also become x."""
    long_names = [long for long, _ in aliases]

    def extended(m: Column) -> Column:
        added = F.array(*[_entry(F.lit(short), F.try_element_at(m, F.lit(long))) for long, short in reversed(list(aliases))])
        stripped = F.transform(F.filter(F.map_entries(m), lambda e: F.startswith(e["key"], F.lit("EventXML_"))), lambda e: _entry(F.substring(e["key"], 10, 1_000), e["value"]))
        return first_wins(F.concat(F.map_entries(m), added, stripped))

    def named(m: Column) -> Column:  # most events have no long name and are not taken apart
        some = F.exists(F.map_keys(m), lambda k: k.isin(long_names) | F.startswith(k, F.lit("EventXML_")))
        return F.when(some, extended(m)).otherwise(F.map_filter(m, lambda k, v: F.coalesce(v, F.lit("")) != ""))

    return _let(fields, named)


PARSERS = {"json": json_fields, "syslog": syslog_fields, "cef": cef_fields, "leef": leef_fields, "auditd": auditd_fields, "event_xml": event_xml_fields, "text": text_fields}
