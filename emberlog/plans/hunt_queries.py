"""Hunts as named queries over the log-shaped view, with SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from emberlog.operators import hunts as hu
from emberlog.plans.log_view import WITH, log_events

#: Fields that the view lacks, as the same SQL text in both engines.
_MORE = {
    "TargetFilename": r"CASE WHEN event_id % 11 = 0 THEN 'C:\Users\a\invoice.pdf.exe' WHEN event_id % 11 = 1 THEN 'C:\backup\ntds.dit' ELSE '' END",
    "TargetObject": r"CASE WHEN event_id % 7 = 0 THEN 'HKLM\Software\Microsoft\Windows\CurrentVersion\Run\x' WHEN event_id % 7 = 1 THEN 'HKLM\x\AppInit_DLLs' ELSE '' END",
    "ScriptBlockText": "CASE WHEN event_id % 13 = 0 THEN '[Reflection.Assembly]::Load($x).GetType($y)' WHEN event_id % 13 = 1 THEN 'VirtualAlloc then CreateThread in kernel32.dll' WHEN event_id % 13 = 2 THEN 'start meterpreter' ELSE '' END",
}
#: Command lines for the hunts of commands, chosen by event_id.
_COMMANDS = "CASE event_id % 6 WHEN 0 THEN 'psexec host cmd' WHEN 1 THEN 'schtasks /create /tn a' WHEN 2 THEN '7z a out.7z' WHEN 3 THEN 'runas /user:admin cmd' WHEN 4 THEN 'whoami & ipconfig & netstat' ELSE 'dir' END"
_DNS = "CASE event_id % 4 WHEN 0 THEN 'deadbeefdeadbeef01.example.net' WHEN 1 THEN 'a.b.c.example.net' WHEN 2 THEN '1234567890x.example.net' ELSE 'www.example.net' END"
_IMAGE = r"CASE event_id % 3 WHEN 0 THEN 'C:\Temp\svchost.exe' WHEN 1 THEN 'C:\Windows\System32\lsass.exe' ELSE 'C:\Windows\System32\lsas.exe' END"

#: Bytes of the table for a task: a hundred thousand events or so, as hunts take longer than reading does.
_TASK = 2 << 20

_queries, _oracles = {}, {}


def _spark_text(sql: str) -> str:
    return sql.replace("\\", "\\\\")


def _add(name: str, hunt: str, description: str, severity: str, **columns: str):
    """Registers hunt `hunt` with the view's columns replaced; SQL names the description (null: none) and severity."""

    def run(spark, sf):
        ev = log_events(spark, sf, _TASK).withColumns({k: F.expr(_spark_text(v)) for k, v in (_MORE | columns).items()})
        found = hu.findings(hu.hunt(ev, (hunt,)), "event_id")
        return found.select("event_id", "f.severity", "f.description")

    _queries[name] = run
    _oracles[name] = f"{WITH} SELECT event_id, {severity} AS severity, d AS description FROM (SELECT *, {description} AS d FROM logs) WHERE d IS NOT NULL"


_add("hunt_typosquat", "typosquat", r"""CASE WHEN ends_with("Image",'svch0st.exe') THEN 'svch0st.exe is Levenshtein distance 1 from svchost.exe' END""", "'high'")
_add("hunt_masquerade", "masquerade", r"""CASE event_id % 3 WHEN 0 THEN 'svchost.exe running from unexpected path: C:\Temp\svchost.exe' END""", "'critical'", Image=_IMAGE)
_add("hunt_path_anomaly", "path_anomaly", r"""CASE WHEN contains("Image",'\Public\') THEN 'Executable in suspicious directory: PUBLIC_PROFILE' END""", "'medium'")
_add("hunt_double_extension", "double_extension", "CASE WHEN event_id % 11 = 0 THEN 'Double extension: invoice.pdf.exe' END", "'high'")
_add("hunt_c2_framework", "c2_framework", "CASE WHEN event_id % 13 = 2 THEN 'Metasploit C2 framework indicators detected' END", "'critical'")
_add("hunt_download_cradle", "download_cradle", """CASE WHEN contains("CommandLine",'certutil') THEN 'Download cradle: certutil-urlcache' END""", "'high'")
_add("hunt_credential_exposure", "credential_exposure", "CASE event_id % 6 WHEN 3 THEN 'Credentials exposed in command line arguments' END", "'high'", CommandLine=_COMMANDS)
_add("hunt_shellcode", "shellcode", "CASE event_id % 13 WHEN 1 THEN 'Shellcode indicators (3): virtualalloc, kernel32.dll, createthread' END", "'critical'")
_add("hunt_ps_reflection", "ps_reflection", "CASE event_id % 13 WHEN 0 THEN '.NET reflection abuse: [reflection.assembly]::load, gettype(' END", "'high'")
_add("hunt_parent_anomaly", "parent_anomaly", r"""CASE WHEN ends_with("ParentImage",'WINWORD.EXE') AND regexp_matches("Image",'(cmd|powershell|certutil)\.exe$') THEN 'OFFICE_SPAWN: winword.exe spawned ' || regexp_extract("Image",'[a-z]+\.exe$') END""", "'high'")
_add("hunt_registry_path", "registry_path", "CASE event_id % 7 WHEN 0 THEN 'Suspicious registry path: RUN_KEY' WHEN 1 THEN 'Suspicious registry path: APPINIT_DLLS' END", "CASE event_id % 7 WHEN 0 THEN 'medium' ELSE 'high' END")
_add("hunt_sensitive_file", "sensitive_file", "CASE event_id % 11 WHEN 1 THEN 'Access to sensitive file: AD_DATABASE' END", "'critical'")
_add("hunt_lateral_command", "lateral_command", "CASE event_id % 6 WHEN 0 THEN 'Lateral movement: PsExec' END", "'high'", CommandLine=_COMMANDS)
_add("hunt_persistence_command", "persistence_command", "CASE event_id % 6 WHEN 1 THEN 'Persistence mechanism: scheduled_task' END", "'medium'", CommandLine=_COMMANDS)
_add("hunt_recon_command", "recon_command", "CASE event_id % 6 WHEN 4 THEN 'Reconnaissance: whoami, ipconfig, netstat' END", "'medium'", CommandLine=_COMMANDS)
_add("hunt_data_staging", "data_staging", "CASE event_id % 6 WHEN 2 THEN 'Data staging activity: archive_7z' END", "'medium'", CommandLine=_COMMANDS)
_add("hunt_dns_subdomain", "dns_subdomain", "CASE event_id % 4 WHEN 0 THEN 'DNS anomaly: HEX_SUBDOMAIN' WHEN 1 THEN 'DNS anomaly: DEEP_NESTING' WHEN 2 THEN 'DNS anomaly: NUMERIC_SUBDOMAIN' END", "CASE event_id % 4 WHEN 0 THEN 'high' ELSE 'medium' END", QueryName=_DNS)


def hunt_summary(spark, sf):
    """All hunts over the view with the fields that it lacks."""
    ev = log_events(spark, sf, _TASK).withColumns({k: F.expr(_spark_text(v)) for k, v in _MORE.items()})
    return hu.hunt_summary(hu.hunt(ev)).select("transform", "severity", "description", "n")


#: Kinds of the hunts that find something in the view as it is; the others need columns replaced.
_FOUND = {
    "typosquat": "ProcessTyposquatting", "path_anomaly": "ProcessPathAnomaly", "double_extension": "DoubleExtension", "c2_framework": "C2Framework", "download_cradle": "DownloadCradle", "shellcode": "ShellcodeIndicator",
    "ps_reflection": "PowerShellReflection", "parent_anomaly": "ParentProcessAnomaly", "registry_path": "SuspiciousRegistryPath", "sensitive_file": "SensitiveFileAccess",
}
_queries["hunt_summary"] = hunt_summary
_oracles["hunt_summary"] = "SELECT transform, severity, description, count(*) AS n FROM (" + " UNION ALL ".join(
    [f"SELECT '{kind}' AS transform, severity, description FROM ({_oracles[f'hunt_{name}']})" for name, kind in _FOUND.items()]
    + [f"""SELECT 'ReconIndicator', 'low', d FROM ({WITH} SELECT CASE WHEN contains("CommandLine",'whoami') THEN 'Reconnaissance: whoami' WHEN contains("CommandLine",'net user') THEN 'Reconnaissance: net user' END AS d FROM logs) WHERE d IS NOT NULL"""]
) + ") GROUP BY 1,2,3"


def queries():
    return dict(_queries)


def oracles():
    return dict(_oracles)
