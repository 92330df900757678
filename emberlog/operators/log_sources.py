"""Log sources of rules as a dimension: which formats and event ids a rule's product and category stand for.

Formats go by the names that the readers write, in lower case; ALIASES has other spellings.
A product of its own (a row of PRODUCT_FORMATS) is told by the format alone, whatever the
category; event ids of a category are asked only of Windows events, which rules without
product mean as well.  Two products read more than one format here, as this library keeps
logs apart that elsewhere share one: audit records (service auditd) and the unified log.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from emberlog.functions.columns import field

#: Formats that hold the events of a product (fixed values).
PRODUCT_FORMATS = {
    "zeek": ("zeek",),
    "linux": ("syslog",),
    "macos": ("syslog", "macos"),
    **dict.fromkeys(("cisco", "juniper", "fortinet", "paloalto"), ("cef", "leef", "syslog")),
    **dict.fromkeys(("aws", "azure", "gcp", "google_workspace", "m365", "okta", "github", "onelogin", "qualys"), ("json",)),
    "apache": ("w3c", "text"),
}
SERVICE_FORMATS = {("linux", "auditd"): ("auditd",)}

#: Category of Windows events -> event ids that it covers (fixed values).
CATEGORY_EVENTS = {
    "process_creation": ("1", "4688"),
    **dict.fromkeys(("file_event", "file_creation", "file_change", "file_delete", "file_delete_detected", "file_rename"), ("11", "23", "26")),
    **dict.fromkeys(("network_connection", "network_connection_detection"), ("3", "5156")),
    "image_load": ("7",),
    **dict.fromkeys(("registry_add", "registry_delete", "registry_event", "registry_rename", "registry_set", "registry_key_rename", "registry_value_set"), ("12", "13", "14")),
    "create_remote_thread": ("8",),
    "raw_access_read": ("9",),
    "process_access": ("10",),
    **dict.fromkeys(("pipe_creation", "pipe_connected"), ("17", "18")),
    **dict.fromkeys(("dns_query", "dns"), ("22",)),
    "process_tampering": ("25",),
    "driver_load": ("6",),
    "ps_module": ("4103",),
    "ps_script": ("4103", "4104"),
    **dict.fromkeys(("ps_classic_start", "ps_classic_provider_start"), ("400", "600")),
    **dict.fromkeys(("account_login", "user_accounts"), ("4624", "4625", "4648", "4768", "4769", "4771", "4776")),
}
#: Words of the channels that antivirus rules mean (fixed values).
ANTIVIRUS_CHANNELS = ("defender", "virus", "endpoint", "antivirus")
#: Event id 1 means a process only from this provider, where the events name one.
PROCESS_PROVIDER = "sysmon"
ALIASES = {"zeektsv": "zeek", "syslogrfc5424": "syslog", "jsonlines": "json", "apachecombined": "text", "plaintext": "text", "w3cextended": "w3c"}
FORMAT_COLUMNS = ("_source_format", "source_format")


@dataclass(frozen=True)
class Route:
    """What a log source asks of an event; None and () ask nothing."""

    formats: frozenset | None = None
    event_ids: frozenset | None = None
    channel_words: tuple = ()
    process: bool = False


def _text(logsource: dict, key: str) -> str:
    return str(logsource.get(key) or "").lower()


def route(logsource: dict | None) -> Route:
    """The route of a rule's log source."""
    logsource = logsource or {}
    product, category, service = (_text(logsource, k) for k in ("product", "category", "service"))
    if product in PRODUCT_FORMATS:
        return Route(formats=frozenset(PRODUCT_FORMATS[product] + SERVICE_FORMATS.get((product, service), ())))
    if product in ("", "windows") and category in CATEGORY_EVENTS:
        return Route(event_ids=frozenset(CATEGORY_EVENTS[category]), process=category == "process_creation")
    if category == "antivirus":
        return Route(channel_words=ANTIVIRUS_CHANNELS)
    return Route()


def format_column(df: DataFrame) -> str | None:
    known = {c.lower(): c for c in df.columns}
    return next((known[c] for c in FORMAT_COLUMNS if c in known), None)


def format_name(text: Column) -> Column:
    """A format as the readers name it."""
    low = F.lower(text)
    return F.coalesce(F.create_map(*[F.lit(x) for pair in ALIASES.items() for x in pair])[low], low)


def routed(df: DataFrame, logsource: dict | None, column: str | None = None) -> Column:
    """Whether an event can belong to a log source; events without a format are of no product that is told by its format."""
    way = route(logsource)
    tests = []
    if way.formats is not None:
        named = column or format_column(df)
        tests.append(format_name(field(df, named)).isin(sorted(way.formats)) if named else F.lit(False))
    if way.event_ids is not None:
        number = field(df, "EventID")
        test = number.isin(sorted(way.event_ids))
        if way.process and "provider_name" in {c.lower() for c in df.columns}:
            test &= (number != "1") | F.contains(F.lower(field(df, "Provider_Name")), F.lit(PROCESS_PROVIDER))
        tests.append(test)
    if way.channel_words:
        channel = F.lower(field(df, "Channel"))
        test = F.lit(False)
        for word in way.channel_words:
            test |= F.contains(channel, F.lit(word))
        tests.append(test)
    out = F.lit(True)
    for test in tests:
        out &= test
    return out


def log_source_table(spark: SparkSession) -> DataFrame:
    """(product, category, service, format, event_id): the dimension, one row for each pair that a rule may mean; null is any."""
    rows = [(p, None, None, f, None) for p, formats in PRODUCT_FORMATS.items() for f in formats]
    rows += [(p, None, s, f, None) for (p, s), formats in SERVICE_FORMATS.items() for f in formats]
    rows += [("windows", c, None, None, e) for c, events in CATEGORY_EVENTS.items() for e in events]
    return spark.createDataFrame(rows, "product string, category string, service string, format string, event_id string")
