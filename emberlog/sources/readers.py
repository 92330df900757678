"""Files to the landing schema: fields (map), raw, source_file, source_format, event_hash.

Lines are read by Spark's text source, so that files split and .gz and .bz2 open as they are.
Headers and directives are carried along inside each split of a file; what the splits before
it end with comes from a table with one row a split, made only where a file may be split.
Lines that hold no event are left out, and counted where an `Ingest` is given.
"""

from __future__ import annotations

import hashlib
import re
import time
from urllib.parse import unquote

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from emberlog.functions.tables import broadcast_if_small, written
from emberlog.sources import parsers


class Ingest:
    """Counts of what readers read, gathered by the job that uses their rows; `with` around that job takes its time."""

    def __init__(self):
        self.seen: list[tuple[str, Observation]] = []
        self.began = self.ended = time.time()

    def __enter__(self) -> Ingest:
        self.began = self.ended = time.time()
        return self

    def __exit__(self, *_) -> None:
        self.ended = time.time()

    def watched(self, rows: DataFrame, source_format: str) -> DataFrame:
        seen = Observation(f"ingest-{len(self.seen)}-{source_format}")
        self.seen.append((source_format, seen))
        return rows.observe(seen, F.count("*").alias("lines"), F.count_if(F.size("fields") > 0).alias("events"))

    def report(self, spark: SparkSession) -> DataFrame:
        """(source_format, lines, events, malformed, seconds), one row a format; waits for the job where it has not run yet."""
        counts = [(name, seen.get["lines"], seen.get["events"], self.ended - self.began) for name, seen in self.seen]  # one a reader
        rows = spark.createDataFrame(counts, "source_format string, lines long, events long, seconds double")
        return rows.groupBy("source_format").agg(F.sum("lines").alias("lines"), F.sum("events").alias("events"), F.max("seconds").alias("seconds")).select("source_format", "lines", "events", (F.col("lines") - F.col("events")).alias("malformed"), "seconds")


def _named(df: DataFrame, include: str, exclude: str) -> DataFrame:
    """Rows of files whose names hold `include` and not `exclude`, without regard to case."""
    name = F.lower(F.col("_metadata.file_name"))
    kept = df.filter(F.contains(name, F.lit(include.lower()))) if include else df
    return kept.filter(~F.contains(name, F.lit(exclude.lower()))) if exclude else kept


def lines(spark: SparkSession, path, end: str | None = None, include: str = "", exclude: str = "") -> DataFrame:
    """Lines below a path, of the files that _named keeps."""
    reader = spark.read.option("recursiveFileLookup", "true")
    text = (reader.option("lineSep", end) if end else reader).text(path).select(F.rtrim(F.col("value"), F.lit("\r")).alias("value"), "_metadata")
    return _named(text, include, exclude).select("value", F.col("_metadata.file_path").alias("source_file"), F.col("_metadata.file_block_start").alias("block"))


def discover(spark: SparkSession, path, include: str = "", exclude: str = "") -> DataFrame:
    """(path, name, size) of the files below a path, without reading them; Spark's source leaves out empty ones."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    listed = files.select("path", F.substring_index("path", "/", -1).alias("name"), F.col("length").alias("size"))
    kept = listed.filter(F.contains(F.lower("name"), F.lit(include.lower()))) if include else listed
    return kept.filter(~F.contains(F.lower("name"), F.lit(exclude.lower()))) if exclude else kept


def landed(df: DataFrame, fields: Column, source_format: str, raw: str = "value", ingest: Ingest | None = None) -> DataFrame:
    """The landing schema; rows without fields are left out."""
    some = lambda m: F.size(m) > 0
    if ingest is None:  # no row or its one map of fields: a filter would be moved below the fields, and parse each line twice
        fields = F.explode(F.filter(F.array(fields), some))
    rows = df.select(fields.alias("fields"), F.col(raw).alias("raw"), "source_file", F.lit(source_format).alias("source_format"), F.xxhash64(raw).alias("event_hash"))
    return rows if ingest is None else ingest.watched(rows, source_format).filter(some("fields"))


def _by_line(name: str, parser, end: str | None = None):
    def read(spark: SparkSession, path, ingest: Ingest | None = None, **names) -> DataFrame:
        found = lines(spark, path, end, **names).filter(F.trim("value") != "")
        return landed(found, parser(F.col("value")), name, ingest=ingest)

    return read


read_jsonl = _by_line("json", lambda v: _json(v))
read_syslog = _by_line("syslog", parsers.syslog_fields)
read_cef = _by_line("cef", parsers.cef_fields)
read_leef = _by_line("leef", parsers.leef_fields)
read_auditd = _by_line("auditd", parsers.auditd_fields)
read_text_log = _by_line("text", parsers.text_fields)
read_event_xml = _by_line("event_xml", lambda v: F.when(F.contains(v, F.lit("<Event")), parsers.with_aliases(parsers.event_xml_fields(v))), "</Event>")
read_macos = _by_line("macos", lambda v: parsers.with_aliases(parsers.json_fields(v), parsers.MACOS))


def read_json_array(spark: SparkSession, path, include: str = "", exclude: str = "", parser=None, ingest: Ingest | None = None) -> DataFrame:
    """Files that hold one array of objects each; such a file is one row until it is taken apart."""
    whole = _named(spark.read.option("recursiveFileLookup", "true").text(path, wholetext=True).select("value", "_metadata"), include, exclude)
    each = whole.select(F.explode(F.from_json("value", "array<string>")).alias("value"), F.col("_metadata.file_path").alias("source_file"))
    return landed(each, (parser or _json)(F.col("value")), "json" if parser is None else "macos", ingest=ingest)


def _json(value: Column) -> Column:
    return parsers.with_aliases(parsers.json_fields(value))


def read_macos_array(spark: SparkSession, path, **names) -> DataFrame:
    """The unified log as one array of objects in each file."""
    return read_json_array(spark, path, parser=lambda v: parsers.with_aliases(parsers.json_fields(v), parsers.MACOS), **names)


def _may_split(spark: SparkSession, path) -> bool:
    """Whether Spark may split a file below a path: one that is longer than the smallest split."""
    size = lambda key: spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(key))
    least = min(size("spark.sql.files.maxPartitionBytes"), size("spark.sql.files.openCostInBytes"))
    longest = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).agg(F.max("length")).first()[0]  # lists files only
    return (longest or 0) > least


def carried(spark: SparkSession, path, marks: dict[str, str | None], include: str = "", exclude: str = "") -> DataFrame:
    """Data lines (value, source_file), and for each mark the last line before them in their file that begins with it.

    A mark of None is the file's first line.  Lines that begin with # are no data where all marks are texts.
    """
    found = lines(spark, path, include=include, exclude=exclude).filter(F.trim("value") != "")
    names, directives = list(marks), None not in marks.values()

    def filled(batches):
        key, state = None, {}
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            value, file, block = batch.column(0), batch.column(1), batch.column(2).to_numpy(zero_copy_only=False)
            code = pc.dictionary_encode(file).indices.to_numpy(zero_copy_only=False)
            starts = np.ones(n, bool)
            starts[1:] = (code[1:] != code[:-1]) | (block[1:] != block[:-1])
            goes_on = key == (file[0].as_py(), int(block[0]))
            starts[0] = not goes_on
            begin = np.maximum.accumulate(np.where(starts, np.arange(n), -1))
            data = np.ones(n, bool)
            columns = []
            for name, mark in marks.items():
                is_head = starts & (block == 0) if mark is None else pc.starts_with(value, mark).to_numpy(zero_copy_only=False)
                data &= ~is_head
                last = np.maximum.accumulate(np.where(is_head, np.arange(n), -1))
                here = (last >= 0) & (last >= begin)
                column = value.take(pa.array(np.where(here, last, 0), mask=~here))
                if goes_on and state.get(name) is not None:
                    column = pc.if_else(pa.array(~here & (begin < 0)), state[name], column)
                columns.append(column)
                state[name] = column[-1] if column[-1].is_valid else None
            key = (file[-1].as_py(), int(block[-1]))
            if directives:
                data &= ~pc.starts_with(value, "#").to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays([value, file, batch.column(2), *columns], ["value", "source_file", "block", *names]).filter(pa.array(data))

    rows = found.mapInArrow(filled, "value string, source_file string, block long, " + ", ".join(f"`{n}` string" for n in names))
    if not _may_split(spark, path):
        return rows.drop("block")
    row = F.monotonically_increasing_id()
    test = lambda mark: F.col("block") == 0 if mark is None else F.startswith("value", F.lit(mark))
    pick = lambda mark: F.min_by if mark is None else F.max_by
    ends = found.withColumn("row", row).groupBy("source_file", "block").agg(*[pick(m)(F.when(test(m), F.col("value")), F.when(test(m), F.col("row"))).alias(n) for n, m in marks.items()])
    before = Window.partitionBy("source_file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)  # one row a split
    carry = ends.select("source_file", "block", *[F.last(n, True).over(before).alias(f"before_{n}") for n in names]).filter("block > 0")
    joined = rows.join(broadcast_if_small(written(carry, "headers")), ["source_file", "block"], "left")
    return joined.select("value", "source_file", *[F.coalesce(n, f"before_{n}").alias(n) for n in names])


def _cells(line: Column, sep: str) -> Column:
    """The cells of a line; quoted ones may hold the separator, and quotes twice."""
    mark, other = re.escape(sep), sep if sep != "\\" else "\\\\"
    found = F.regexp_extract_all(F.concat(F.lit(sep), line), F.lit(f'{mark}("(?:[^"]|"")*"[^{other}]*|[^{other}]*)'), F.lit(1))
    plain = lambda c: F.replace(F.regexp_replace(c, '^"((?:[^"]|"")*)"(.*)$', "$1$2"), F.lit('""'), F.lit('"'))
    return F.transform(found, lambda c: F.when(F.startswith(c, F.lit('"')), plain(c)).otherwise(c))


def read_csv(spark: SparkSession, path, sep: str = ",", include: str = "", exclude: str = "", ingest: Ingest | None = None) -> DataFrame:
    """Every file by its own first line; empty cells are left out, cells beyond that line are field_{i}; raw is the cells joined by `sep`."""
    df = carried(spark, path, {"head": None}, include, exclude).filter("head IS NOT NULL")
    names = _cells(F.regexp_replace("head", "^\ufeff", ""), sep)
    df = df.select("source_file", names.alias("names"), _cells(F.col("value"), sep).alias("cells"))
    entries = F.transform("cells", lambda v, i: F.struct(F.coalesce(F.get("names", i), F.concat(F.lit("field_"), i)).alias("key"), v.alias("value")))
    return landed(df.select(parsers.first_wins(entries).alias("f"), F.array_join("cells", sep).alias("value"), "source_file"), F.col("f"), "csv" if sep == "," else "tsv", ingest=ingest)


def read_w3c(spark: SparkSession, path, ingest: Ingest | None = None, **names) -> DataFrame:
    """Names in lower case, `(` as `-`; '-' is missing; timestamp is date and time."""
    df = carried(spark, path, {"head": "#Fields:"}, **names).filter("head IS NOT NULL")
    keys = F.split(F.trim(F.replace(F.replace(F.lower(F.substring("head", 9, 1_000_000)), F.lit("("), F.lit("-")), F.lit(")"), F.lit(""))), r"\s+")
    cells = F.zip_with(keys, F.split("value", r"\s+"), lambda k, v: F.struct(k.alias("key"), F.nullif(v, F.lit("-")).alias("value")))
    known = F.map_filter(parsers.first_wins(F.filter(cells, lambda e: e["key"].isNotNull())), lambda k, v: k.isNotNull())
    stamp = F.concat(known["date"], F.lit("T"), known["time"])
    return landed(df, F.when(stamp.isNotNull(), F.map_concat(F.map_filter(known, lambda k, v: k != "timestamp"), F.create_map(F.lit("timestamp"), stamp))).otherwise(known), "w3c", ingest=ingest)


def read_zeek(spark: SparkSession, path, ingest: Ingest | None = None, **names) -> DataFrame:
    """Logs with #fields and the separator, unset and empty marks that the directives before name (tab, '-' and '(empty)' without); dots in names become _."""
    marks = {"head": "#fields", "kind": "#path", "separator": "#separator", "unset": "#unset_field", "empty": "#empty_field"}
    df = carried(spark, path, marks, **names).filter("head IS NOT NULL")
    df = df.withColumns({n: F.substring(n, len(m) + 1, 1_000_000) for n, m in marks.items() if n != "head"})
    code = F.regexp_extract(F.trim("separator"), r"^\\x([0-9a-fA-F]{2})$", 1)
    sep = F.when(code != "", F.char(F.conv(code, 16, 10).cast("int"))).otherwise(F.coalesce(F.nullif(F.trim("separator"), F.lit("")), F.lit("\t")))
    df = df.withColumn("sep", sep)
    split = lambda text: F.split(text, F.concat(F.lit(r"\Q"), F.col("sep"), F.lit(r"\E")), -1)
    after = lambda name, usual: F.coalesce(F.nullif(F.replace(F.col(name), F.col("sep"), F.lit("")), F.lit("")), F.lit(usual))
    keys = F.transform(F.slice(split(F.col("head")), 2, 100_000), lambda n: F.replace(n, F.lit("."), F.lit("_")))
    cells = F.zip_with(keys, split(F.col("value")), lambda k, v: F.struct(k.alias("key"), F.when((v != after("unset", "-")) & (v != after("empty", "(empty)")), v).alias("value")))
    kind = F.array(F.struct(F.lit("_zeek_log_type").alias("key"), F.nullif(F.trim(F.replace("kind", F.col("sep"), F.lit(""))), F.lit("")).alias("value")))
    return landed(df, parsers.first_wins(F.concat(F.filter(cells, lambda e: e["key"].isNotNull()), kind)), "zeek", ingest=ingest)


READERS = {"json": read_jsonl, "json_array": read_json_array, "csv": read_csv, "tsv": lambda spark, path, **options: read_csv(spark, path, "\t", **options), "syslog": read_syslog, "cef": read_cef, "leef": read_leef, "w3c": read_w3c, "zeek": read_zeek, "auditd": read_auditd, "event_xml": read_event_xml, "macos": read_macos, "macos_array": read_macos_array, "text": read_text_log}


def wide(landing: DataFrame, names) -> DataFrame:
    """Chosen fields as columns, with _raw, _source_file and _source_format."""
    return landing.select(*[F.col("fields")[n].alias(n) for n in names], F.col("raw").alias("_raw"), F.col("source_file").alias("_source_file"), F.col("source_format").alias("_source_format"))


def field_names(landing: DataFrame, longest: int = 128) -> DataFrame:
    """Names of all fields with the number of events, longest names left out."""
    return landing.select(F.explode(F.map_keys("fields")).alias("field")).filter(F.octet_length("field") <= longest).groupBy("field").agg(F.count("*").alias("n"))


def ingest_report(landing: DataFrame) -> DataFrame:
    """Events of each format; lines without an event are counted by `Ingest`, while they are read."""
    return landing.groupBy("source_format").agg(F.count("*").alias("n"))


def evidence_manifest(spark: SparkSession, path) -> DataFrame:
    """SHA-256 and size of every file; files are read in blocks, so their size has no limit. Spark's source leaves out empty ones."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", F.col("length").alias("size"))

    def hashed(batches):
        from pyarrow import fs

        for batch in batches:
            out = []
            for name in batch.column(0).to_pylist():
                system, inner = (fs.LocalFileSystem(), unquote(name.removeprefix("file:").replace("//", "/", 1))) if name.startswith("file:") else fs.FileSystem.from_uri(name)
                digest = hashlib.sha256()
                with system.open_input_stream(inner, compression=None) as stream:
                    while block := stream.read(1 << 20):
                        digest.update(block)
                out.append(digest.hexdigest())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.string())], ["path", "size", "sha256"])

    return files.mapInArrow(hashed, "path string, size long, sha256 string")
