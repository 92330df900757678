"""Heuristics over single events; each yields at most one finding (transform, severity, description) per event.

The texts of all tables are searched by one automaton, once for each distinct value of a
batch, where what hunts of tables find is told as well; the other hunts are expressions
(`hunt` puts both together).
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable
from functools import cache, lru_cache
from itertools import accumulate
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberlog.functions.columns import any_of, field, let

# Fixed values of the hunts, in their order (the first that fits decides).
SYSTEM_PROCESSES = ["svchost.exe", "lsass.exe", "csrss.exe", "smss.exe", "wininit.exe", "winlogon.exe", "services.exe", "spoolsv.exe", "conhost.exe", "dllhost.exe", "taskhost.exe", "taskhostw.exe", "RuntimeBroker.exe", "explorer.exe", "dwm.exe"]
LOOKALIKES_ALLOWED = ["svchostctl.exe", "svchost_2.exe", "iexplore.exe", "dllhst3g.exe", "taskhostex.exe", "wmiprvse.exe", "consent.exe", "smartscreen.exe"]
SYSTEM32, SYSWOW64, WINDOWS = "\\windows\\system32\\", "\\windows\\syswow64\\", "\\windows\\"
EXPECTED_DIRS = {"svchost.exe": (SYSTEM32, SYSWOW64), "lsass.exe": (SYSTEM32,), "csrss.exe": (SYSTEM32,), "smss.exe": (SYSTEM32,), "wininit.exe": (SYSTEM32,), "winlogon.exe": (SYSTEM32,), "services.exe": (SYSTEM32,), "spoolsv.exe": (SYSTEM32,), "explorer.exe": (WINDOWS, SYSWOW64), "dllhost.exe": (SYSTEM32, SYSWOW64), "conhost.exe": (SYSTEM32,), "dwm.exe": (SYSTEM32,), "taskhostw.exe": (SYSTEM32,)}
SUSPICIOUS_DIRS = [("\\appdata\\local\\temp\\", "USER_TEMP"), ("\\windows\\temp\\", "WINDOWS_TEMP"), ("\\$recycle.bin\\", "RECYCLE_BIN"), ("\\perflogs\\", "PERFLOGS"), ("\\users\\public\\", "PUBLIC_PROFILE"), ("\\downloads\\", "DOWNLOADS"), ("\\temp\\", "TEMP_DIR"), ("/dev/shm/", "DEV_SHM"), ("/var/tmp/", "VAR_TMP"), ("/tmp/", "LINUX_TMP")]
DOUBLE_EXTENSION = r"(?i)\.(doc|docx|pdf|txt|jpg|jpeg|png|gif|bmp|xls|xlsx|ppt|pptx|csv|rtf|odt)\.(exe|scr|bat|cmd|com|pif|vbs|vbe|js|jse|wsh|wsf|ps1|msi|dll|hta|cpl)$"
C2_PATTERNS = [
    (r"(?i)\bbeacon\.(exe|dll|bin)\b", "CobaltStrike"),
    (r"(?i)\\\\\.\\pipe\\(msagent_|MSSE-|postex_|status_|postex_ssh_)", "CobaltStrike"),
    (r"(?i)\bjump\s+(psexec|winrm|ssh)\b", "CobaltStrike"),
    (r"(?i)\bspawn(to|as|x64|x86)\b", "CobaltStrike"),
    (r"(?i)(meterpreter|msfvenom|msfconsole|multi/handler)", "Metasploit"),
    (r"(?i)(LHOST\s*=|LPORT\s*=|payload/)", "Metasploit"),
    (r"(?i)\b(sliver|implant.*generate|mtls\s|wg\s.*listener)\b", "Sliver"),
    (r"(?i)(invoke-empire|starkiller|launcher.*stager)", "Empire"),
    (r"(?i)\b(havoc.*listener|demon\b.*\bhavoc)\b", "Havoc"),
    (r"(?i)(bruteratel|BRc4|badger\.exe)", "BruteRatel"),
    (r"(?i)(PoshC2|Invoke-Pbind|posh-server)", "PoshC2"),
    (r"(?i)(grunt(http|smb)|covenant)", "Covenant"),
    (r"(?i)\\\\\.\\pipe\\[a-f0-9]{8}-[a-f0-9]{4}-[a-f0-9]{4}", "GenericC2Pipe"),
]
CRADLES = [("downloadstring", "Net.WebClient.DownloadString"), ("downloadfile", "Net.WebClient.DownloadFile"), ("downloaddata", "Net.WebClient.DownloadData"), ("invoke-webrequest", "Invoke-WebRequest"), ("invoke-restmethod", "Invoke-RestMethod"), ("start-bitstransfer", "Start-BitsTransfer"), ("net.webclient", "Net.WebClient"), ("bitstransfer", "BitsTransfer"), ("certutil -urlcache", "certutil-urlcache"), ("certutil -decode", "certutil-decode"), ("certutil /urlcache", "certutil-urlcache"), ("bitsadmin /transfer", "bitsadmin-transfer"), ("bitsadmin /addfile", "bitsadmin-addfile"), ("wget ", "wget"), ("curl ", "curl"), ("iex(", "IEX"), ("iex (", "IEX"), ("invoke-expression", "Invoke-Expression"), (".openread(", "WebClient.OpenRead"), ("xmlhttp", "XMLHTTP"), ("msxml2.xmlhttp", "MSXML2.XMLHTTP"), ("winhttprequest", "WinHttpRequest")]
CREDENTIALS = [r"/user:\S+\s+/p(assword)?:\S+", r"/U\s+\S+\s+/P\s+\S+", r"net\s+use\s+\\\\\S+\s+\S+\s+/user:", r"wmic\s+/node:\S+\s+/user:\S+\s+/password:\S+", r"cmdkey\s+/add:", r"schtasks\s+.*(/U\s+\S+|/RU\s+\S+).*(/P\s+\S+|/RP\s+\S+)", r"psexec\s+.*-u\s+\S+\s+-p\s+\S+", r"runas\s+/user:\S+"]
SHELLCODE = ["virtualalloc", "virtualprotect", "kernel32.dll", "ntdll.dll", "marshal.copy", "rtlmovememory", "getprocaddress", "createthread", "createremotethread", "ntcreatethreadex", "queueuserapc", "ntqueueapcthread", "allocglobal", "allochglobal", "[runtime.interopservices.marshal]", "0x90,0x90", "\\x90\\x90", "page_execute", "0x40"]
REFLECTION = ["[reflection.assembly]::load", "[system.reflection.assembly]", "assembly.load(", "gettype(", "invokemember(", "getmethod(", "getfield(", "invoke(", "add-type -typedefinition", "dllimport", "[appdomain]::currentdomain", "definedynamicassembly", "system.runtime.interopservices", "marshal]::ptrtostructure"]
OFFICE = ["winword.exe", "excel.exe", "powerpnt.exe", "outlook.exe", "msaccess.exe", "onenote.exe", "mspub.exe", "visio.exe"]
BROWSERS = ["chrome.exe", "msedge.exe", "firefox.exe", "iexplore.exe", "brave.exe", "opera.exe"]
PDF_READERS = ["acrobat.exe", "acrord32.exe", "foxitreader.exe", "foxitphantom.exe", "sumatrapdf.exe"]
SCRIPT_ENGINES = ["cmd.exe", "powershell.exe", "pwsh.exe", "wscript.exe", "cscript.exe", "mshta.exe", "rundll32.exe", "regsvr32.exe", "certutil.exe", "bitsadmin.exe"]
REGISTRY = [("\\currentversion\\run\\", "RUN_KEY", "medium"), ("\\currentversion\\runonce\\", "RUNONCE_KEY", "medium"), ("\\currentversion\\runservices\\", "RUNSERVICES_KEY", "medium"), ("\\image file execution options\\", "IFEO", "high"), ("\\appinit_dlls", "APPINIT_DLLS", "high"), ("\\inprocserver32", "COM_HIJACK", "medium"), ("\\winlogon\\shell", "WINLOGON_SHELL", "high"), ("\\winlogon\\userinit", "WINLOGON_USERINIT", "high"), ("\\policies\\explorer\\run", "POLICY_RUN", "medium"), ("\\policies\\system\\", "SECURITY_POLICY", "medium"), ("\\silentprocessexit\\", "SILENT_EXIT", "high"), ("\\globalflag", "GLOBAL_FLAG", "high"), ("\\environment\\userinitmprlogonscript", "LOGON_SCRIPT", "high"), ("\\currentversion\\explorer\\shell folders", "SHELL_FOLDERS", "medium")]
SENSITIVE_FILES = [("\\config\\sam", "CREDENTIAL_HIVE_SAM", "critical"), ("\\config\\system", "CREDENTIAL_HIVE_SYSTEM", "critical"), ("\\config\\security", "CREDENTIAL_HIVE_SECURITY", "critical"), ("ntds.dit", "AD_DATABASE", "critical"), ("lsass.dmp", "LSASS_DUMP", "critical"), ("lsass.zip", "LSASS_DUMP", "critical"), ("procdump", "PROCDUMP_TOOL", "high"), ("/etc/shadow", "LINUX_SHADOW", "critical"), ("/etc/passwd", "LINUX_PASSWD", "medium"), ("id_rsa", "SSH_PRIVATE_KEY", "high"), ("id_ed25519", "SSH_PRIVATE_KEY", "high"), ("id_ecdsa", "SSH_PRIVATE_KEY", "high"), ("authorized_keys", "SSH_AUTHORIZED_KEYS", "medium"), ("login data", "BROWSER_CREDS", "high"), ("cookies", "BROWSER_COOKIES", "medium"), ("key3.db", "FIREFOX_KEY_DB", "high"), ("key4.db", "FIREFOX_KEY_DB", "high"), ("logins.json", "FIREFOX_LOGINS", "high"), (".kdbx", "KEEPASS_DB", "high"), (".kdb", "KEEPASS_DB", "high"), (".pfx", "CERTIFICATE_PFX", "high"), (".p12", "CERTIFICATE_P12", "high"), (".pem", "PRIVATE_KEY_PEM", "medium"), (".key", "PRIVATE_KEY", "medium"), (".env", "DOTENV_FILE", "medium"), ("web.config", "WEB_CONFIG", "medium"), ("wp-config.php", "WORDPRESS_CONFIG", "medium"), (".git-credentials", "GIT_CREDENTIALS", "high"), (".aws/credentials", "AWS_CREDENTIALS", "high")]
LATERAL = [("psexec", "PsExec"), ("paexec", "PaExec"), ("psexesvc", "PsExecSvc"), ("wmic /node:", "WMI_Remote"), ("invoke-wmimethod", "WMI_PS"), ("enter-pssession", "PSRemoting"), ("invoke-command -computername", "PSRemoting"), ("new-pssession", "PSRemoting"), ("winrs -r:", "WinRS"), ("net use \\\\", "SMB_Net_Use"), ("schtasks /s ", "Remote_ScheduledTask"), ("schtasks /create /s ", "Remote_ScheduledTask"), ("mstsc /v:", "RDP")]
PERSISTENCE = [("schtasks /create", "scheduled_task"), ("register-scheduledjob", "scheduled_task_ps"), ("new-scheduledtask", "scheduled_task_ps"), ("sc create", "service_creation"), ("new-service", "service_creation_ps"), ("reg add", "registry_run"), ("set-itemproperty", "registry_run_ps"), ("new-itemproperty", "registry_run_ps"), ("__eventfilter", "wmi_subscription"), ("__eventconsumer", "wmi_subscription"), ("register-wmievent", "wmi_subscription_ps"), ("crontab", "cron_linux"), ("systemctl enable", "systemd_linux")]
RECON = ["systeminfo", "hostname", "whoami", "ipconfig", "ifconfig", "netstat", "arp -a", "route print", "nslookup", "net user", "net group", "net localgroup", "net share", "net view", "nltest", "dsquery", "adfind", "ldapsearch", "tasklist", "qprocess", "wmic process", "netsh firewall", "netsh advfirewall"]
STAGING = [("rar a", "archive_rar"), ("7z a", "archive_7z"), ("7za a", "archive_7z"), ("zip -r", "archive_zip"), ("tar czf", "archive_tar"), ("tar -czf", "archive_tar"), ("makecab", "archive_cab"), ("compact /c", "compress_ntfs"), ("sqlcmd", "db_dump_mssql"), ("mysqldump", "db_dump_mysql"), ("pg_dump", "db_dump_postgres"), ("mongodump", "db_dump_mongo"), ("robocopy", "bulk_copy"), ("xcopy /s", "bulk_copy"), ("findstr /s /i password", "sensitive_file_hunt"), ("findstr /s /i credential", "sensitive_file_hunt")]
ATTACK = {"ProcessTyposquatting": ("defense-evasion", "T1036.004"), "ProcessMasquerade": ("defense-evasion", "T1036.005"), "ProcessPathAnomaly": ("execution", "T1204"), "DoubleExtension": ("defense-evasion", "T1036.007"), "C2Framework": ("command-and-control", "T1071"), "DownloadCradle": ("command-and-control", "T1105"), "CredentialExtraction": ("credential-access", "T1078"), "ShellcodeIndicator": ("execution", "T1055"), "PowerShellReflection": ("defense-evasion", "T1620"), "ParentProcessAnomaly": ("execution", "T1204.002"), "SuspiciousRegistryPath": ("persistence", "T1547"), "SensitiveFileAccess": ("credential-access", "T1003"), "LateralMovement": ("lateral-movement", "T1021"), "PersistenceClassifier": ("persistence", "T1053"), "ReconIndicator": ("discovery", "T1082"), "DataStaging": ("collection", "T1074"), "DnsSubdomain": ("command-and-control", "T1071.004")}

SEVERITIES = ("info", "low", "medium", "high", "critical")
Hunt = Callable[[DataFrame], Column]


def finding(transform: str, severity: Column | str, description: Column) -> Column:
    """The finding, or null where the description is null."""
    level = F.lit(severity) if isinstance(severity, str) else severity
    return let(description, lambda d: F.when(d.isNotNull(), _entry(transform, level, d)))


def _entry(transform: str, severity: Column, description: Column) -> Column:
    return F.struct(F.lit(transform).alias("transform"), severity.alias("severity"), description.alias("description"))


def _file_name(path: Column) -> Column:
    return F.regexp_extract(path, r"[^\\/]*$", 0)


#: Tables of texts that fields are searched for, all in one pass of each distinct value.
_TABLES = {"dirs": SUSPICIOUS_DIRS, "cradles": CRADLES, "shellcode": [(k, k) for k in SHELLCODE], "reflection": [(k, k) for k in REFLECTION], "registry": REGISTRY, "files": SENSITIVE_FILES, "lateral": LATERAL, "persistence": PERSISTENCE, "recon": [(k, k) for k in RECON], "staging": STAGING}
_FIRST = dict(zip(_TABLES, accumulate([0, *map(len, _TABLES.values())]), strict=False))
_SEARCHED = ("CommandLine", "ScriptBlockText", "TargetFilename", "ObjectName", "TargetObject", "Image")
_SOUGHT, _LOOKALIKE, _DNS = "__emberlog_sought", "__emberlog_lookalike", "__emberlog_dns"


@cache
def _automaton():
    import ahocorasick

    places: dict[str, list[int]] = {}
    for at, text in enumerate(row[0] for table in _TABLES.values() for row in table):
        places.setdefault(text, []).append(at)
    out = ahocorasick.Automaton()
    for text, at in places.items():
        out.add_word(text, at)
    out.make_automaton()
    return out


@lru_cache(maxsize=1 << 16)
def marks_of(text: str) -> list[int]:
    """Numbers of all rows of all tables whose text a value holds, without regard to case."""
    return sorted({n for _, found in _automaton().iter(text.lower()) for n in found})


Row = tuple[str, ...]
Told = tuple[str, str]


def _first(prefix: str, severity: str | None = None) -> Callable[[list[Row]], Told]:
    """The first row that a field holds, with its own severity where none is given."""
    return lambda rows: (severity or rows[0][2], prefix + rows[0][1])


def _all(prefix: str, severity: str) -> Callable[[list[Row]], Told]:
    return lambda rows: (severity, prefix + _joined(rows))


def _joined(rows: list[Row]) -> str:
    return ", ".join(row[1] for row in rows)


class _Search(NamedTuple):
    """A hunt for the texts of a table: the first of its fields that tells something decides."""

    transform: str
    table: str
    fields: tuple[str, ...]
    told: Callable[[list[Row]], Told]  # severity and description of the rows that a field holds
    longer: int = -1  # characters that a field must exceed
    least: int = 1  # rows
    first_present: bool = False  # the first field that is there decides, whatever it holds


SEARCHES = {
    "path_anomaly": _Search("ProcessPathAnomaly", "dirs", ("Image",), _first("Executable in suspicious directory: ", "medium")),
    "download_cradle": _Search("DownloadCradle", "cradles", ("CommandLine", "ScriptBlockText"), _all("Download cradle: ", "high"), 5),
    "shellcode": _Search("ShellcodeIndicator", "shellcode", ("CommandLine", "ScriptBlockText"), lambda rows: ("critical", f"Shellcode indicators ({len(rows)}): {_joined(rows[:3])}"), 20, 2),
    "ps_reflection": _Search("PowerShellReflection", "reflection", ("ScriptBlockText",), _all(".NET reflection abuse: ", "high"), 20, 2),
    "registry_path": _Search("SuspiciousRegistryPath", "registry", ("TargetObject", "ObjectName"), _first("Suspicious registry path: "), first_present=True),
    "sensitive_file": _Search("SensitiveFileAccess", "files", ("TargetFilename", "ObjectName", "CommandLine"), _first("Access to sensitive file: ")),
    "lateral_command": _Search("LateralMovement", "lateral", ("CommandLine",), _first("Lateral movement: ", "high"), 5),
    "persistence_command": _Search("PersistenceClassifier", "persistence", ("CommandLine",), _first("Persistence mechanism: ", "medium"), 5),
    "recon_command": _Search("ReconIndicator", "recon", ("CommandLine",), lambda rows: ("medium" if len(rows) >= 3 else "low", "Reconnaissance: " + _joined(rows)), 3),
    "data_staging": _Search("DataStaging", "staging", ("CommandLine",), _first("Data staging activity: ", "medium"), 5),
}


def told(search: _Search, text: str) -> Told | tuple[()] | None:
    """What a field's text tells: severity and description, nothing for good (empty), or null, so that the next field is asked."""
    first, table = _FIRST[search.table], _TABLES[search.table]
    rows = [table[n - first] for n in marks_of(text) if 0 <= n - first < len(table)]
    if len(rows) >= search.least and len(text) > search.longer:
        return search.told(rows)
    return () if search.first_present and text else None


def _sought(df: DataFrame, names: list[str]) -> Column:
    """Findings of the named searches, a struct; once for each distinct value of a field in a batch."""
    fields = list(dict.fromkeys(f for n in names for f in SEARCHES[n].fields))
    kind = pa.struct([(n, pa.string()) for n in ("transform", "severity", "description")])

    @F.arrow_udf("struct<" + ", ".join(f"{n}: struct<transform: string, severity: string, description: string>" for n in names) + ">")
    def findings(*texts: pa.Array) -> pa.Array:
        encoded = [pc.dictionary_encode(x) for x in texts]
        values = {f: (x.dictionary.to_pylist(), x.indices.to_numpy(zero_copy_only=False)) for f, x in zip(fields, encoded, strict=True)}
        out = []
        for search in map(SEARCHES.__getitem__, names):
            places: dict = {None: 0}  # what is told -> its place among the findings
            chosen = np.zeros(len(texts[0]), np.int32)
            for f in search.fields:
                distinct, at = values[f]
                here = np.array([places.setdefault(told(search, v), len(places)) for v in distinct], np.int32)
                if here.any():
                    chosen = np.where(chosen > 0, chosen, here[at])
            found = pa.array([(search.transform, *x) if x else None for x in places], kind)
            out.append(found.take(pa.array(chosen)))
        return pa.StructArray.from_arrays(out, names)

    return findings.asNondeterministic()(*[field(df, n) for n in fields])  # once an event, however many hunts there are


def _search(name: str) -> Hunt:
    return lambda _: F.col(_SOUGHT)[name]


def _deletions(word: str, most: int) -> set[str]:
    """The word without up to `most` of its letters."""
    out = last = {word}
    for _ in range(most):
        last = {w[:i] + w[i + 1 :] for w in last for i in range(len(w))}
        out = out | last
    return out


def _distance(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
    return row[-1]


#: Lower-case target -> most letters that a name may be away from it.
_AWAY = {t.lower(): 1 if len(t) <= 7 else 2 for t in SYSTEM_PROCESSES}
_NEAR: dict[str, list[str]] = {}  # what targets leave without one or two letters -> the targets
for _target, _most in _AWAY.items():
    for _left in _deletions(_target, _most):
        _NEAR.setdefault(_left, []).append(_target)
_SHORTEST, _LONGEST = min(map(len, _AWAY)) - 2, max(map(len, _AWAY)) + 2
_KNOWN = {x.lower() for x in SYSTEM_PROCESSES + LOOKALIKES_ALLOWED}


@lru_cache(maxsize=1 << 16)
def lookalike(name: str) -> str | None:
    """What a lower-case file name imitates: two words are so many letters apart only if both leave a common word without as many."""
    if not name or name in _KNOWN:
        return None
    near = {t for w in _deletions(name, 2) for t in _NEAR.get(w, ())} if _SHORTEST <= len(name) <= _LONGEST else set()
    plain = name.replace("0", "o").replace("1", "l").replace("rn", "m").replace("vv", "w")
    for target in SYSTEM_PROCESSES:
        low = target.lower()
        if low in near and 0 < (distance := _distance(name, low)) <= _AWAY[low]:
            return f"{name} is Levenshtein distance {distance} from {target}"
        if plain == low:
            return f"{name} is homoglyph of {target}"
    return None


def _lookalikes(df: DataFrame) -> Column:
    """What the image's file name imitates; each name of a batch is looked at once."""

    @F.arrow_udf("string")
    def verdict(names: pa.Array) -> pa.Array:
        found = pc.dictionary_encode(names)
        return pa.array([lookalike(n) for n in found.dictionary.to_pylist()], pa.string()).take(found.indices)

    return verdict.asNondeterministic()(F.lower(_file_name(field(df, "Image"))))


def typosquat(df: DataFrame) -> Column:
    """Names one or two letters away from a system process, or equal to one after swapping look-alike letters."""
    return finding("ProcessTyposquatting", "high", F.col(_LOOKALIKE))


def masquerade(df: DataFrame) -> Column:
    image = field(df, "Image")

    def outside(low: Column) -> Column:
        name = _file_name(low)
        wrong = any_of([(name == exe) & ~any_of([F.contains(low, F.lit(d)) for d in dirs]) for exe, dirs in EXPECTED_DIRS.items()])
        return F.when(name.isin(list(EXPECTED_DIRS)), F.when(wrong, F.concat(name, F.lit(" running from unexpected path: "), image)))

    return finding("ProcessMasquerade", "critical", let(F.replace(F.lower(image), F.lit("/"), F.lit("\\")), outside))


def double_extension(df: DataFrame) -> Column:
    held = lambda n: F.when(field(df, n).rlike(DOUBLE_EXTENSION), field(df, n))
    return finding("DoubleExtension", "high", F.concat(F.lit("Double extension: "), _file_name(F.coalesce(held("TargetFilename"), held("Image")))))


def c2_framework(df: DataFrame) -> Column:
    any_of_them = "|".join(f"(?:{p})" for p, _ in C2_PATTERNS)  # most texts fail this one and see no other
    named = lambda n: F.when((F.length(field(df, n)) > 5) & field(df, n).rlike(any_of_them), F.coalesce(*[F.when(field(df, n).rlike(p), F.lit(who)) for p, who in C2_PATTERNS]))
    return finding("C2Framework", "critical", F.concat(F.coalesce(named("CommandLine"), named("ScriptBlockText")), F.lit(" C2 framework indicators detected")))


def credential_exposure(df: DataFrame) -> Column:
    command = field(df, "CommandLine")
    exposed = (F.length(command) > 10) & command.rlike("(?i)" + "|".join(CREDENTIALS))
    return finding("CredentialExtraction", "high", F.when(exposed, F.lit("Credentials exposed in command line arguments")))


def parent_anomaly(df: DataFrame) -> Column:
    """Script engines that a document, browser, PDF, Java or WMI process started."""
    name = lambda n: F.substring_index(F.lower(field(df, n)), "\\", -1)
    parent, child = name("ParentImage"), name("Image")
    kind = F.when(parent.isin(OFFICE), "OFFICE_SPAWN").when(parent.isin(BROWSERS), "BROWSER_SPAWN").when(parent.isin(PDF_READERS), "PDF_SPAWN").when(parent.isin("java.exe", "javaw.exe"), "JAVA_SPAWN").when(parent == "wmiprvse.exe", "WMI_SPAWN")
    return finding("ParentProcessAnomaly", "high", F.when(child.isin(SCRIPT_ENGINES), F.concat(kind, F.lit(": "), parent, F.lit(" spawned "), child)))


_GRAVE = ("VERY_LONG_QUERY", "HEX_SUBDOMAIN", "BASE64_SUBDOMAIN")
_LABEL_TESTS = {
    "LONG_SUBDOMAIN": lambda x: len(x) > 30,
    "HEX_SUBDOMAIN": lambda x: re.fullmatch("[0-9a-fA-F]{16,}", x),
    "BASE64_SUBDOMAIN": lambda x: re.fullmatch("[A-Za-z0-9+/=]{20,}", x),
    "HIGH_ENTROPY_LABEL": lambda x: len(x) >= 8 and len(x.encode()) > 11 and _entropy(x.encode()) > 3.5,  # 2**3.5 kinds of bytes at least
    "NUMERIC_SUBDOMAIN": lambda x: len(x) >= 8 and 2 * len(re.findall("[0-9]", x)) > len(x),
}


def _entropy(data: bytes) -> float:
    return -sum(n / len(data) * math.log2(n / len(data)) for n in Counter(data).values())


@lru_cache(maxsize=1 << 16)
def dns_anomalies(name: str) -> list[str]:
    """What is odd about a queried name: its length, its depth, or a label before the last two."""
    if len(name) <= 5:
        return []
    labels = name.rstrip(".").split(".")
    found = [k for k, test in _LABEL_TESTS.items() if any(test(x) for x in labels[:-2])]
    return sorted(found + ["VERY_LONG_QUERY"] * (len(name) > 100) + ["DEEP_NESTING"] * (len(labels) > 4))


def _dns_names(df: DataFrame) -> Column:
    @F.arrow_udf("array<string>")
    def anomalies(names: pa.Array) -> pa.Array:
        found = pc.dictionary_encode(names)
        return pa.array([dns_anomalies(n) for n in found.dictionary.to_pylist()], pa.list_(pa.string())).take(found.indices)

    return anomalies.asNondeterministic()(field(df, "QueryName"))


def dns_subdomain(df: DataFrame) -> Column:
    """Names that look like tunnelled data: long, deep, or with odd labels before the last two."""
    found = F.col(_DNS)
    grave = F.arrays_overlap(found, F.array(*[F.lit(x) for x in _GRAVE]))
    return finding("DnsSubdomain", F.when(grave, "high").otherwise("medium"), F.when(F.size(found) > 0, F.concat(F.lit("DNS anomaly: "), F.array_join(found, ", "))))


_ORDER = ("typosquat", "masquerade", "path_anomaly", "double_extension", "c2_framework", "download_cradle", "credential_exposure", "shellcode", "ps_reflection", "parent_anomaly", "registry_path", "sensitive_file", "lateral_command", "persistence_command", "recon_command", "data_staging", "dns_subdomain")
_PLAIN = {f.__name__: f for f in (typosquat, masquerade, double_extension, c2_framework, credential_exposure, parent_anomaly, dns_subdomain)}
HUNTS: dict[str, Hunt] = {n: _search(n) if n in SEARCHES else _PLAIN[n] for n in _ORDER}


def hunt(df: DataFrame, names=tuple(HUNTS), fast: bool = False) -> DataFrame:
    """Adds hunt_findings, an array of (transform, severity, description); `fast` leaves out the edit distances."""
    chosen = [n for n in names if not (fast and n == "typosquat")]
    sought = list(dict.fromkeys(n for n in chosen if n in SEARCHES))
    looked = df.withColumns(({_SOUGHT: _sought(df, sought)} if sought else {}) | ({_LOOKALIKE: _lookalikes(df)} if "typosquat" in chosen else {}) | ({_DNS: _dns_names(df)} if "dns_subdomain" in chosen else {}))
    return looked.withColumn("hunt_findings", F.array_compact(F.array(*[HUNTS[n](looked) for n in chosen]))).drop(_SOUGHT, _LOOKALIKE, _DNS)


def findings(hunted: DataFrame, *columns: str) -> DataFrame:
    """One row (columns, f) for each finding; of a bare column the optimizer would ask for its size first, and hunt twice."""
    return hunted.select(*columns, F.explode(F.array_compact("hunt_findings")).alias("f"))


def hunt_summary(hunted: DataFrame) -> DataFrame:
    """Findings by kind and description with their ATT&CK tactic and technique, most severe first."""
    counted = findings(hunted).groupBy("f.transform", "f.severity", "f.description").agg(F.count("*").alias("n"))
    lookup = lambda i: F.coalesce(*[F.when(F.col("transform") == k, F.lit(v[i])) for k, v in ATTACK.items()], F.lit(("unknown", "")[i]))
    rank = F.array_position(F.array(*[F.lit(s) for s in SEVERITIES]), F.col("severity"))
    return counted.withColumn("tactic", lookup(0)).withColumn("technique", lookup(1)).orderBy(rank.desc(), F.col("n").desc(), "description")
