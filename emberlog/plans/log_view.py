"""The log-shaped view of the driver's `events` table, as the same SQL text for Spark and for oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberlog.functions.tables import spread

_K = "CAST(regexp_extract(props,'[0-9]+',0) AS INT)"
COLUMNS = {
    "event_id": "event_id",
    "EventID": "CASE event_type WHEN 'error' THEN '4625' WHEN 'purchase' THEN '4624' WHEN 'signup' THEN '4672' WHEN 'click' THEN '1' ELSE '22' END",
    "SystemTime": "replace(substr(CAST(ts AS STRING),1,19),' ','T')",
    "AcctName": "CASE WHEN user_id % 10 = 0 THEN concat('host',user_id,'$') ELSE concat('user',user_id) END",
    "Computer": "concat('WS',user_id % 7)",
    "IpAddress": "CASE WHEN k % 9 = 0 THEN '-' WHEN k % 3 = 0 THEN concat('10.0.',k % 4,'.',user_id % 20 + 1) ELSE concat('203.0.113.',user_id % 4 + 1) END",
    "LogonType": "CASE event_id % 3 WHEN 0 THEN '2' WHEN 1 THEN '3' ELSE '10' END",
    "QueryName": "CASE WHEN event_type='view' THEN concat('q',k,'.example.net') ELSE '' END",
    "Image": r"CASE WHEN event_type <> 'click' THEN '' ELSE CASE event_id % 5 WHEN 0 THEN 'C:\Windows\System32\cmd.exe' WHEN 1 THEN 'C:\Windows\System32\WindowsPowerShell\v1.0\powershell.exe' WHEN 2 THEN 'C:\Users\Public\svch0st.exe' WHEN 3 THEN 'C:\Windows\System32\certutil.exe' ELSE 'C:\Windows\System32\svchost.exe' END END",
    "ParentImage": r"CASE WHEN event_type <> 'click' THEN '' WHEN event_id % 4 = 0 THEN 'C:\Office\WINWORD.EXE' ELSE 'C:\Windows\explorer.exe' END",
    "CommandLine": "CASE WHEN event_type <> 'click' THEN '' ELSE CASE k % 6 WHEN 0 THEN 'cmd.exe /c whoami' WHEN 1 THEN 'powershell.exe -enc ZQBjAGgAbwA=' WHEN 2 THEN 'net user /domain' WHEN 3 THEN 'certutil -urlcache http://files.example.net/a' WHEN 4 THEN 'p^o^w^e^r^s^h^e^l^l' ELSE concat('task_',event_id) END END",
    "_raw": "concat(event_type,' ',props)",
}
_DUCK = ", ".join(f'{sql} AS "{name}"' for name, sql in COLUMNS.items())
#: Prefix of every oracle over the view.
WITH = f"WITH logs AS (SELECT {_DUCK} FROM (SELECT *, {_K} AS k FROM events))"


def as_logs(events: DataFrame) -> DataFrame:
    """The view over any batch or stream of the table's rows."""
    doubled = {name: sql.replace("\\", "\\\\") for name, sql in COLUMNS.items()}
    return events.withColumn("k", F.expr(_K)).select(*[F.expr(sql).alias(name) for name, sql in doubled.items()])


def log_events(spark: SparkSession, sf_dir: str, most: int | None = None) -> DataFrame:
    """The view over the table; `most` bytes of its files for a task, where that is given."""
    return as_logs(spread(spark.read.parquet(f"{sf_dir}/events.parquet"), most))
