"""Hunting queries that analysts run as they are, over the log-shaped view with the fields that it lacks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberlog.plans.log_view import WITH, log_events

#: Event ids of the view's rows, by event_id % 24.
_IDS = ("1", "2", "3", "7", "8", "10", "11", "13", "16", "19", "20", "21", "22", "25", "104", "1102", "4624", "4625", "4662", "4768", "4769", "5145", "7045", "")


def _choose(number: str, *texts: str) -> str:
    return f"CASE {number} % {len(texts)} " + " ".join(f"WHEN {i} THEN '{t}'" for i, t in enumerate(texts)) + " END"


#: Fields as the same SQL text in both engines; q counts rounds of event ids.
FIELDS = {
    "EventID": _choose("event_id", *_IDS),
    "LogonType": _choose("q", "2", "3", "10"),
    "AuthenticationPackageName": _choose("(q + event_id)", "NTLM", "Kerberos", "Negotiate", ""),
    "ParentImage": _choose("q", r"C:\Windows\System32\wbem\WmiPrvSE.exe", r"C:\Windows\explorer.exe", r"C:\wmiprvse.exe.bak"),
    "ServiceFileName": _choose("q", r"\\host\share\a.exe", r"C:\Tools\a.exe", r"%COMSPEC% \\.\pipe\x", ""),
    "ServiceName": _choose("q", "krbtgt", "MSSQLSvc", "updater", "host$"),
    "RelativeTargetName": _choose("q", r"dir\a.EXE", "b.txt", "exe", "c.exe"),
    "SourceImage": _choose("q", r"C:\Temp\dump.exe", r"C:\Windows\System32\svchost.exe", ""),
    "TargetImage": _choose("q", r"C:\Windows\System32\LSASS.exe", "x-lsass.exe", r"C:\Windows\explorer.exe", "", r"C:\lsass.exe.txt"),
    "GrantedAccess": _choose("q", "0x1010", "0x1410", "0x1038", "0x1fffff", "0x1000", "", "0x40"),
    "TargetObject": _choose("q", r"HKLM\Software\Microsoft\Windows\CurrentVersion\Run\x", r"HKLM\Software\RunOnce", r"HKCU\run\y"),
    "Details": _choose("q", "a.exe", ""),
    "TargetFilename": _choose("q", r"C:\Users\a\Start Menu\Programs\Startup\x.lnk", r"C:\startup.txt", r"C:\a.txt", ""),
    "ImageLoaded": _choose("q", r"C:\Temp\version.dll", r"C:\Windows\System32\a.dll"),
    "Signed": _choose("q", "false", "true", ""),
    "TicketEncryptionType": _choose("q", "0x12", "0x17", "0x11"),
    "Properties": _choose("q", "%%7688 {1131F6AD-9c07}", "{x}", "1131f6ad", ""),
    "DestinationIp": _choose("q", "203.0.113.9", "10.1.2.3", "172.16.0.9", "172.32.0.1", "192.168.1.1", "127.0.0.1", "198.51.100.7", ""),
    "DestinationPort": _choose("q", "443", "4444", "8080", "80", "1337"),
    "QueryName": _choose("q", "a.example.xyz", "b.top", "c.example.net", "d.onion", "e.pw.example.com", "", "f.bit"),
    "Image": _choose("q", r"C:\Windows\System32\cmd.exe", r"C:\Users\a\AppData\Local\x.exe", r"C:\Temp\evil.exe", "", r"C:\tmp\y.exe"),
    "OriginalFileName": _choose("q", "Cmd.Exe", "powershell.exe", "", "evil.exe"),
    "CommandLine": _choose("q", "powershell Invoke-WebRequest http://a", "wget b", "Set-MpPreference -DisableRealtimeMonitoring 1", "amsi memory bypass", "schtasks /Create /tn x", "schtasks /query", "[Ref].AmsiInitFailed", "", "curl.exe c", "(New-Object Net.WebClient).DownloadString(1)"),
    "eventName": _choose("q", "ConsoleLogin", "CreateUser", "GetObject"),
    "additionalEventData": _choose("q", "", '{"MFAUsed": "No"}', '{"MFAUsed": "Yes"}', '{"MobileVersion":"No","MFAUsed":"Yes"}'),
    "eventSource": _choose("q", "iam.amazonaws.com", "s3.amazonaws.com", "signin.amazonaws.com"),
    "riskState": _choose("q", "atRisk", "none", "remediated"),
}
_Q = "CAST((event_id - event_id % 24) / 24 AS BIGINT)"
_SQL = f"{WITH}, base AS (SELECT event_id, _raw, {_Q} AS q FROM logs), more AS (SELECT event_id, _raw, " + ", ".join(f'{sql} AS "{name}"' for name, sql in FIELDS.items()) + " FROM base)"


def events(spark, sf_dir: str) -> DataFrame:
    """The view's rows with the fields of FIELDS."""
    base = log_events(spark, sf_dir).select("event_id", "_raw", F.expr(_Q).alias("q"))
    doubled = {name: sql.replace("\\", "\\\\") for name, sql in FIELDS.items()}
    return base.select("event_id", "_raw", *[F.expr(sql).alias(name) for name, sql in doubled.items()])


def event(*ids: str) -> Column:
    return F.col("EventID").isin(*ids)


def has(name: str, *words: str) -> Column:
    """Whether a field holds any of the words, without case."""
    out = F.contains(F.lower(name), F.lit(words[0].lower()))
    for w in words[1:]:
        out = out | F.contains(F.lower(name), F.lit(w.lower()))
    return out


def ends(name: str, *words: str) -> Column:
    """Whether a field ends with any of the words, without case."""
    out = F.endswith(F.lower(name), F.lit(words[0].lower()))
    for w in words[1:]:
        out = out | F.endswith(F.lower(name), F.lit(w.lower()))
    return out


_queries, _oracles = {}, {}


def _hunt(name: str, columns: str, where: Callable[[], Column], sql: str):
    """Registers a filter that shows event_id and `columns`, with its SQL."""
    shown = ["event_id", *columns.split()]
    _queries[name] = lambda spark, sf: events(spark, sf).filter(where()).select(*shown)
    _oracles[name] = f"{_SQL} SELECT " + ", ".join(f'"{c}"' for c in shown) + f" FROM more WHERE {sql}"


# lateral movement
_hunt("pass_the_hash", "LogonType", lambda: event("4624") & (F.col("LogonType") == "3") & (F.col("AuthenticationPackageName") == "NTLM"), """"EventID"='4624' AND "LogonType"='3' AND "AuthenticationPackageName"='NTLM'""")
_hunt("wmi_children", "ParentImage", lambda: event("1") & ends("ParentImage", "wmiprvse.exe"), """"EventID"='1' AND "ParentImage" ILIKE '%wmiprvse.exe'""")
_hunt("remote_service", "ServiceFileName", lambda: event("7045") & has("ServiceFileName", "\\\\"), r""""EventID"='7045' AND position('\\' IN "ServiceFileName") > 0""")
_hunt("smb_exe_copy", "RelativeTargetName", lambda: event("5145") & ends("RelativeTargetName", ".exe"), """"EventID"='5145' AND "RelativeTargetName" ILIKE '%.exe'""")
# processes
_hunt("ps_downloads", "CommandLine", lambda: has("CommandLine", "Invoke-WebRequest", "wget", "curl", "DownloadString", "DownloadFile"), "regexp_matches(\"CommandLine\", '(?i)invoke-webrequest|wget|curl|downloadstring|downloadfile')")
_hunt("remote_thread", "SourceImage TargetImage", lambda: event("8"), """"EventID"='8'""")
_hunt("temp_and_profile_exec", "Image CommandLine", lambda: has("Image", "\\temp\\", "\\tmp\\", "\\appdata\\"), r"""regexp_matches("Image", '(?i)\\(temp|tmp|appdata)\\')""")
_hunt("renamed_binary", "Image OriginalFileName", lambda: (F.col("OriginalFileName") != "") & ~F.endswith(F.lower("Image"), F.concat(F.lit("\\"), F.lower("OriginalFileName"))), r""""OriginalFileName" <> '' AND NOT ends_with(lower("Image"), '\' || lower("OriginalFileName"))""")
# persistence
_hunt("persistence_tasks", "CommandLine", lambda: event("1") & F.col("CommandLine").ilike("%schtasks%create%"), """"EventID"='1' AND "CommandLine" ILIKE '%schtasks%create%'""")
_hunt("persistence_services", "ServiceName ServiceFileName", lambda: event("7045"), """"EventID"='7045'""")
_hunt("persistence_run_keys", "Image TargetObject Details", lambda: event("13") & has("TargetObject", "\\run\\"), r""""EventID"='13' AND contains(lower("TargetObject"), '\run\')""")
_hunt("persistence_wmi", "EventID", lambda: event("19", "20", "21"), """"EventID" IN ('19','20','21')""")
_hunt("persistence_startup", "Image TargetFilename", lambda: event("11") & has("TargetFilename", "startup"), """"EventID"='11' AND "TargetFilename" ILIKE '%startup%'""")
_hunt("persistence_unsigned_dll", "Image ImageLoaded", lambda: event("7") & (F.col("Signed") == "false"), """"EventID"='7' AND "Signed"='false'""")
# credential access
_hunt("credential_lsass", "SourceImage GrantedAccess", lambda: event("10") & ends("TargetImage", "lsass.exe"), """"EventID"='10' AND "TargetImage" ILIKE '%lsass.exe'""")
_hunt("credential_rc4_tickets", "ServiceName TicketEncryptionType", lambda: event("4769") & (F.col("TicketEncryptionType") == "0x17"), """"EventID"='4769' AND "TicketEncryptionType"='0x17'""")
_hunt("credential_no_preauth", "TicketEncryptionType", lambda: event("4768") & (F.col("TicketEncryptionType") == "0x17"), """"EventID"='4768' AND "TicketEncryptionType"='0x17'""")
_hunt("credential_sam", "TargetImage GrantedAccess", lambda: event("10") & ends("TargetImage", "\\lsass.exe") & F.col("GrantedAccess").isin("0x1010", "0x1038", "0x1fffff"), r""""EventID"='10' AND ends_with(lower("TargetImage"), '\lsass.exe') AND "GrantedAccess" IN ('0x1010','0x1038','0x1fffff')""")
_hunt("credential_replication", "Properties", lambda: event("4662") & has("Properties", "1131f6ad"), """"EventID"='4662' AND "Properties" ILIKE '%1131f6ad%'""")
# network
_hunt("c2_ports", "DestinationIp DestinationPort Image", lambda: F.col("DestinationPort").isin("4444", "5555", "8080", "8443", "1337", "9001", "6666", "1234"), """"DestinationPort" IN ('4444','5555','8080','8443','1337','9001','6666','1234')""")
_hunt("rare_tlds", "QueryName Image", lambda: event("22") & ends("QueryName", ".xyz", ".top", ".tk", ".pw", ".onion", ".bit"), """"EventID"='22' AND regexp_matches("QueryName", '(?i)\\.(xyz|top|tk|pw|onion|bit)$')""")
# evasion
_hunt("evasion_config_change", "EventID", lambda: event("16"), """"EventID"='16'""")
_hunt("evasion_log_clearing", "EventID", lambda: event("1102", "104"), """"EventID" IN ('1102','104')""")
_hunt("evasion_defender", "CommandLine", lambda: has("CommandLine", "DisableRealtimeMonitoring", "Set-MpPreference"), """"CommandLine" ILIKE '%disablerealtimemonitoring%' OR "CommandLine" ILIKE '%set-mppreference%'""")
_hunt("evasion_amsi", "CommandLine", lambda: F.col("CommandLine").ilike("%amsi%bypass%") | has("CommandLine", "AmsiInitFailed"), """"CommandLine" ILIKE '%amsi%bypass%' OR "CommandLine" ILIKE '%amsiinitfailed%'""")
_hunt("evasion_timestomping", "Image TargetFilename", lambda: event("2"), """"EventID"='2'""")
_hunt("evasion_tampering", "EventID", lambda: event("25"), """"EventID"='25'""")
# cloud
_hunt("cloud_login_without_mfa", "eventName additionalEventData", lambda: (F.col("eventName") == "ConsoleLogin") & ~F.col("additionalEventData").ilike("%MFAUsed%Yes%"), """"eventName"='ConsoleLogin' AND NOT "additionalEventData" ILIKE '%mfaused%yes%'""")
_hunt("cloud_iam_changes", "eventName eventSource", lambda: F.col("eventSource") == "iam.amazonaws.com", """"eventSource"='iam.amazonaws.com'""")
_hunt("cloud_risky_signins", "riskState", lambda: F.col("riskState") == "atRisk", """"riskState"='atRisk'""")


def outbound_by_process(spark, sf):
    """Addresses that each process connects to; the twenty processes with most of them."""
    found = events(spark, sf).filter(event("3")).groupBy("Image").agg(F.count_distinct("DestinationIp").alias("ips"))
    return found.orderBy(F.col("ips").desc(), "Image").limit(20)


_queries["outbound_by_process"] = outbound_by_process
_oracles["outbound_by_process"] = f"""{_SQL} SELECT "Image", count(DISTINCT "DestinationIp") AS ips FROM more WHERE "EventID"='3' GROUP BY 1 ORDER BY ips DESC, "Image" LIMIT 20"""


def queries():
    return dict(_queries)


def oracles():
    return dict(_oracles)
