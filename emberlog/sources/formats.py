"""Which log format a file holds, by its name and the head of its content."""

from __future__ import annotations

from urllib.parse import unquote

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

HEAD = 8192


def format_of(name: Column, head: Column) -> Column:
    """The format of a file with this name whose first HEAD characters are `head`; missing text is 'text'."""
    extension = F.lower(F.regexp_extract(F.coalesce(name, F.lit("")), r"\.([^./\\]+)$", 1))
    body = F.regexp_replace(F.coalesce(head, F.lit("")), r"^\s+|\s+$", "")
    line = F.regexp_extract(body, r"^[^\r\n]*", 0)
    unified = body.rlike('"processImagePath"')
    tests = [
        (extension.isin("evtx", "csv", "tsv"), extension),
        (F.startswith(body, F.lit("ElfFile")), F.lit("evtx")),
        (line.rlike("^#(separator|fields)"), F.lit("zeek")),
        (line.rlike("^#(Software|Fields|Version):"), F.lit("w3c")),
        (body.rlike(r"CEF:[01]\|"), F.lit("cef")),
        (body.rlike(r"LEEF:[12]\.0\|"), F.lit("leef")),
        (F.startswith(body, F.lit("[")), F.when(unified, "macos").otherwise("json_array")),
        (F.startswith(body, F.lit("{")), F.when(unified | body.rlike('"subsystem"'), "macos").otherwise("json")),
        (F.startswith(line, F.lit("type=")), F.lit("auditd")),
        (body.rlike("<Event>") & body.rlike("<EventData>"), F.lit("event_xml")),
        (line.rlike("^<[0-9]{1,3}>") | line.rlike(r"^[A-Z][a-z]{2}\s+\d{1,2}\s+\d{2}:\d{2}:\d{2}\s+\S+"), F.lit("syslog")),
        (F.startswith(body, F.lit("<?xml")) | (F.startswith(body, F.lit("<")) & body.rlike("</")), F.lit("xml")),
        (line.rlike("^[^{]*,[^{]*,[^{]*$"), F.lit("csv")),
        (line.rlike("\t.*\t"), F.lit("tsv")),
    ]
    chain = F.when(*tests[0])
    for test, value in tests[1:]:
        chain = chain.when(test, value)
    return chain.otherwise("text")


def classify_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, format) of every file below `path`; of each file its first HEAD bytes are read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path")

    def heads(batches):
        from pyarrow import fs

        for batch in batches:
            out = []
            for name in batch.column(0).to_pylist():
                system, inner = (fs.LocalFileSystem(), unquote(name.removeprefix("file:").replace("//", "/", 1))) if name.startswith("file:") else fs.FileSystem.from_uri(name)
                with system.open_input_stream(inner, compression=None) as stream:
                    out.append(stream.read(HEAD).decode("latin-1"))  # the tests look at ASCII alone
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], ["path", "head"])

    return files.mapInArrow(heads, "path string, head string").select("path", format_of(F.col("path"), F.col("head")).alias("format"))
