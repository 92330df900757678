"""Shared numpy helpers for the text operators: Arrow access, words, hashes, packed exchange.

Words are ``[^\\x20\\x09-\\x0D]+``.  The separators are ASCII, so splitting UTF-8
bytes gives the same words as splitting code points, and whole Arrow buffers can
be handled without building Python strings.
"""

from __future__ import annotations

import ctypes

import numpy as np
import pyarrow as pa

U64 = np.uint64
CHUNK_BYTES = (1 << 20) - 4096

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_M, _A, _B = U64(0x9E3779B97F4A7C15), U64(0xBF58476D1CE4E5B9), U64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer: spreads every input bit over the whole word."""
    x = x ^ (x >> U64(30))
    x = x * _A
    x = x ^ (x >> U64(27))
    x = x * _B
    return x ^ (x >> U64(31))


#: Pseudo-random value of each (place << 8 | byte); places beyond the table are computed.
_PLACES = 64
_TABLE = mix(np.arange(1, (_PLACES << 8) + 1, dtype=U64) * _M)


def join(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hash of a pair of hashes; the order counts, and no arithmetic structure of the parts survives."""
    x = a * _A
    x += b * _B
    x ^= x >> U64(32)
    x *= _M
    x ^= x >> U64(29)
    return x


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the bytes data[start:end] of spans in order that do not overlap.

    A span hashes to the sum of pseudo-random values of its (place, byte) pairs.  Unlike a
    polynomial modulo 2**64 that has no texts that collide by their structure.
    """
    if not len(starts):
        return np.zeros(0, U64)
    begin, stop = int(starts[0]), int(ends[-1])
    small = np.int32 if stop - begin < 1 << 22 else np.int64
    code = np.arange(0, (stop - begin) << 8, 256, dtype=small)
    code -= np.repeat(((starts - begin) << 8).astype(small), np.diff(np.append(starts, stop)))
    code += data[begin:stop]
    far = np.flatnonzero(code >= _PLACES << 8) if (ends - starts).max() + (starts[1:] - ends[:-1]).max(initial=0) > _PLACES else ()
    values = _TABLE.take(code, mode="clip")
    if len(far):
        values[far] = mix((code[far] + 1).astype(U64) * _M)
    sums = np.zeros(stop - begin + 1, U64)
    np.cumsum(values, out=sums[1:])
    return mix(sums[ends - begin] - sums[starts - begin] + (ends - starts).astype(U64) * _B)


def gram_hashes(codes: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all k-grams of 64-bit codes (one per start), by doubling."""
    n = len(codes) - k + 1
    if n <= 0:
        return np.zeros(0, U64)
    out, done, power, size = None, 0, codes, 1
    while True:
        if k & size:
            out = power[:n] if out is None else join(out, power[done : done + n])
            done += size
        if done == k:
            return out
        power = join(power[:-size], power[size:])
        size *= 2


def eights(data: np.ndarray) -> np.ndarray:
    """At each place the eight bytes that begin there, as a little-endian number (a view; none for the last seven)."""
    return np.ndarray((max(len(data) - 7, 0),), "<u8", np.ascontiguousarray(data), strides=(1,))


def byte_gram_hashes(data: np.ndarray, k: int, at: np.ndarray | None = None) -> np.ndarray:
    """Hashes of the k-grams of bytes (k is 8 or more) at all starts, or at those of `at`."""
    n = len(data) - k + 1
    if n <= 0:
        return np.zeros(0, U64)
    view = eights(data)
    take = (lambda o: view[o : o + n]) if at is None else (lambda o: view[at + o])
    places = [*range(0, k - 7, 8)]
    if places[-1] != k - 8:
        places.append(k - 8)
    out = np.array(take(0))
    for o in places[1:]:
        out = join(out, take(o))
    return out


def strings(column: pa.Array | pa.ChunkedArray) -> pa.Array:
    """A text column as one Arrow string array; null becomes empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    return column.fill_null("") if column.null_count else column


def chunks(column, limit: int = CHUNK_BYTES):
    """(first row, bytes, offsets) for slices of whole texts of about `limit` bytes (one text at least)."""
    array = strings(column)
    offsets = np.frombuffer(array.buffers()[1], np.int64, len(array) + 1 + array.offset)[array.offset :] if len(array) else np.zeros(1, np.int64)
    data = np.frombuffer(array.buffers()[2], np.uint8) if len(array) and array.buffers()[2] is not None else np.zeros(0, np.uint8)
    row = 0
    while row < len(array):
        to = max(row + 1, int(np.searchsorted(offsets, offsets[row] + limit, "right")) - 1)
        yield row, data[offsets[row] : offsets[to]], offsets[row : to + 1] - offsets[row]
        row = to
    if len(data) > CHUNK_BYTES:
        release()


_libc: list = []


def release() -> None:
    """Gives freed memory back to the system: workers live on after a task, beside other stages' workers."""
    if not _libc:
        try:
            _libc.append(ctypes.CDLL("libc.so.6").malloc_trim)
        except (OSError, AttributeError):
            _libc.append(None)
    pa.default_memory_pool().release_unused()
    if _libc[0] is not None:
        _libc[0](0)


def ids(column) -> np.ndarray:
    """An id column as int64; null becomes the smallest value (see NO_ID)."""
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)
    return column.cast(pa.int64()).fill_null(NO_ID).to_numpy(zero_copy_only=False)


NO_ID = -(1 << 63)


def word_spans(data: np.ndarray, offsets: np.ndarray, space: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word starts, word ends, and for each text the number of its first word (one more at the end); `space` tells which bytes part words."""
    word = ~space[data]
    begins = word.copy()
    begins[1:] &= ~word[:-1]
    ends = word.copy()
    ends[:-1] &= ~word[1:]
    inner = offsets[1:-1]
    inner = inner[(inner > 0) & (inner < len(data))]
    begins[inner] = word[inner]
    ends[inner - 1] = word[inner - 1]
    starts = np.flatnonzero(begins)
    return starts, np.flatnonzero(ends) + 1, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = False) -> np.ndarray:
    return span_hashes(_LOWER[data] if lower else data, starts, ends)


def sliding_min_positions(values: np.ndarray, width: int) -> np.ndarray:
    """For each window of `width` values the position of its (leftmost) smallest value.

    Block prefix and suffix minima; the low bits hold the position, so ties of the
    upper bits resolve to the leftmost.
    """
    n = len(values) - width + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    bits = U64(32)  # the same for every chunk: which value wins depends on the values alone
    keyed = ((values >> bits) << bits) | np.arange(len(values), dtype=U64)
    pad = (-len(values)) % width
    blocks = np.concatenate([keyed, np.full(pad, ~U64(0), U64)]).reshape(-1, width)
    before = np.minimum.accumulate(blocks, axis=1).ravel()
    after = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    least = np.minimum(after[:n], before[width - 1 : width - 1 + n])
    return (least & ((U64(1) << bits) - U64(1))).astype(np.int64)


def run_starts(*columns: np.ndarray) -> np.ndarray:
    """First positions of the runs of equal rows."""
    n = len(columns[0])
    if not n:
        return np.zeros(0, np.int64)
    new = np.zeros(n, bool)
    new[0] = True
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    return np.flatnonzero(new)


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """All integers of [start, start+length), one range after the other."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    out = np.ones(total, np.int64)
    keep = lengths > 0
    starts, lengths = starts[keep], lengths[keep]
    at = np.cumsum(lengths)[:-1]
    out[0] = starts[0]
    out[at] = starts[1:] - (starts[:-1] + lengths[:-1] - 1)
    return np.cumsum(out)


def by_bucket(bucket: np.ndarray, n: int, stable: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """An order by bucket and the bounds of each bucket in it."""
    order = np.argsort(bucket.astype(np.int32), kind="stable")
    return order, np.searchsorted(bucket[order], np.arange(n + 1))


def union_mask(n: int, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Which of n positions lie in any [start, end)."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, ends, -1)
    return np.cumsum(edge[:-1]) > 0


def numbered(df):
    """df with its columns named c0, c1 and so on: names with dots do not pass through mapInArrow."""
    return df.toDF(*[f"c{i}" for i in range(len(df.columns))])


def shuffle_partitions(spark) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


BUCKETS_PER_TASK, BUCKET_BYTES = 2, 64 << 20


def buckets(df) -> int:
    """Buckets for the rows of df: two a shuffle task, and more where the planner's size of df asks for it, so that a bucket's size is bounded."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    known = size < 1 << 53  # a size that is not known is the largest long, or what projections make of it
    return max(shuffle_partitions(df.sparkSession) * BUCKETS_PER_TASK, min(size // BUCKET_BYTES, 1 << 20) if known else 0)


def scratch(spark, name: str) -> str:
    """A new folder under spark.checkpoint.dir; a local one only where none is set and Spark runs in this process."""
    import tempfile
    import uuid

    root = spark.conf.get("spark.checkpoint.dir", None) or (spark.sparkContext.getCheckpointDir() or None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and the executors share")
        root = "file://" + tempfile.mkdtemp(prefix="emberlog-")
        spark.sparkContext.setCheckpointDir(root)
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df, name: str):
    """df, cut from its lineage by a table in the shared folder (see discard)."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._scratch = path
    return out


def discard(*tables) -> None:
    """Deletes tables that `written` made, once nothing that is still to run reads them."""
    for table in tables:
        spark = table.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(table._scratch)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def doc_bucket(values: np.ndarray, n: int) -> np.ndarray:
    """The bucket of each id; doc_bucket_column() is the same in SQL."""
    return (values % 1000003 * 7919 % n).astype(np.int32)


def doc_bucket_column(column, n: int):
    from pyspark.sql import functions as F

    return F.pmod(F.pmod(F.coalesce(column, F.lit(NO_ID)), F.lit(1000003)) * F.lit(7919), F.lit(n)).cast("int")


def pack(bucket: np.ndarray, n: int, kind: int, columns: dict[str, np.ndarray]):
    """One Arrow row for each bucket that has rows: bucket, kind and every column's bytes."""
    order, bounds = by_bucket(bucket, n)
    used = np.flatnonzero(np.diff(bounds))
    arrays = [pa.array(used, pa.int32()), pa.array(np.full(len(used), kind), pa.int32())]
    for c in columns.values():
        c = np.ascontiguousarray(c[order])
        width = c.itemsize * (c.shape[1] if c.ndim > 1 else 1)
        offsets = np.concatenate([bounds[used], bounds[-1:]]) * width if len(used) else np.zeros(1, np.int64)
        arrays.append(pa.Array.from_buffers(pa.large_binary(), len(used), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(c)]).cast(pa.binary()))
    return pa.RecordBatch.from_arrays(arrays, ["bucket", "kind", *columns])


def unpack(table, name: str, dtype) -> np.ndarray:
    """All values of one packed column."""
    return np.frombuffer(b"".join(x.as_py() for x in table.column(name)), dtype)


def packed_schema(columns) -> str:
    return ", ".join(["bucket int", "kind int", *(f"{c} binary" for c in columns)])


def filtered(table: pa.Table, kind: int) -> pa.Table:
    import pyarrow.compute as pc

    return table.filter(pc.equal(table.column("kind"), kind))
