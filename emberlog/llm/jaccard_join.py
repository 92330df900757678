"""N-gram Jaccard join with parity sketches.

A document's set holds the distinct hashes of its 5-word shingles.  Within a size
band the shingles are dealt to P parts by hash; a part's sketch is the XOR of its
shingles' hashes.  One differing shingle changes one part, so the number of parts
that differ, like the Hamming distance of parity bit sketches, is at most the
symmetric difference D of two sets.  Sets of E non-empty parts share at least E - D
of them; by the pigeonhole principle they share one of the first D + 1 in any order
that all documents use.  That order puts parts with rare shingles first, by a count
sketch of fixed size, so shared passages do not make candidates.

1. one pass: set sizes and fingerprints (equal sets are one vertex) and the counts;
2. keys of all documents meet by bucket; documents with equal keys form groups;
3. each group's members are verified against its smallest member;
4. groups that are still in several components: the bit sketches of members of
   different components are compared in blocks of bounded size, and pairs within
   the bound are verified, so no link between components is lost;
5. components.

No group is expanded into all of its pairs: pairs inside a component are skipped.  A
key that many documents hold is cut into groups of at most GROUP members, in the task
that makes its entries and again where they meet, so that it does not travel to one
task whole; the groups of one key hold its smallest member each, or are led to it by a
representative, and count as one group in step 4.

Defined results: null, empty and blank texts have an empty set and are linked with
nothing; fewer than 5 words make one shingle; the set of a long text is whole; a null
doc_id has no component; rows that share a doc_id are one vertex, linked with what any
of its texts is linked with; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberlog.llm import _text as tx
from emberlog.llm.components import connected_components

U64 = tx.U64
WORDS, PERCENT = 5, 75
#: Slots of the count sketch: one for SHARE shingles of the input, within these bounds (4 to 64 MB in a task, a byte each in the broadcast).
LEAST_SLOTS, MOST_SLOTS, SHARE = 1 << 20, 1 << 24, 256
GROUP = 1024  # most members of a group but for its smallest
BLOCKS = 64
LOWEST, STEP = 64, 4  # size bands: below 64 shingles, then 64..256, 256..1024 and so on
FLUSH = 1 << 19
KEY_BYTES = 5


def shingle_sets(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingle hashes of each text in order, and the bounds of each text."""
    starts, ends, first = tx.word_spans(data, offsets)
    words = tx.word_hashes(data, starts, ends, lower=True)
    n_words = np.diff(first)
    counts = np.where(n_words >= WORDS, n_words - WORDS + 1, np.minimum(n_words, 1))
    at = tx.ranges(first[:-1], counts)
    text = np.repeat(np.arange(len(counts)), counts)
    hashes = np.empty(len(at), U64)
    whole = n_words[text] >= WORDS
    hashes[whole] = tx.mix(tx.gram_hashes(words, WORDS)[at[whole]])
    for i in np.flatnonzero(~whole).tolist():  # texts of fewer words
        hashes[i] = tx.mix(tx.join(tx.gram_hashes(words[at[i] : at[i] + n_words[text[i]]], int(n_words[text[i]])), n_words[text[i : i + 1]].astype(U64)))[0]
    order = np.lexsort((hashes, text))
    hashes, text = hashes[order], text[order]
    keep = tx.run_starts(hashes, text)
    hashes, text = hashes[keep], text[keep]
    return hashes, np.searchsorted(text, np.arange(len(counts) + 1))


def _sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    total = np.zeros(len(values) + 1, values.dtype)
    np.cumsum(values, out=total[1:])
    return total[bounds[1:]] - total[bounds[:-1]]


def _fingerprints(hashes, bounds):
    return _sums(tx.mix(hashes), bounds).astype(np.int64), _sums(tx.mix(hashes ^ tx._M), bounds).astype(np.int64)


def bit_sketches(hashes: np.ndarray, bounds: np.ndarray) -> list[bytes]:
    """Parity sketches: each hash flips one bit; 4 bits or more for each hash, a power of two.

    Halves of a sketch XOR to the sketch of half the length.
    """
    sizes = np.diff(bounds)
    bits = np.maximum(256, 1 << np.ceil(np.log2(np.maximum(4 * sizes, 1))).astype(np.int64))
    begins = np.concatenate([[0], np.cumsum(bits)])
    text = np.repeat(np.arange(len(sizes)), sizes)
    cell = begins[text] + ((hashes >> U64(8)) & (bits[text] - 1).astype(U64)).astype(np.int64)
    packed = np.packbits((np.bincount(cell, minlength=begins[-1]) & 1).astype(np.uint8)).tobytes()
    return [packed[a // 8 : b // 8] for a, b in zip(begins[:-1].tolist(), begins[1:].tolist(), strict=True)]


SETS = "doc_id long, n_shingles long, f1 long, f2 long, sketch binary"
CELL = 2048  # most members of a block of a group


def set_table(documents: DataFrame) -> DataFrame:
    """doc_id, n_shingles and a 128-bit fingerprint of each document's set."""

    def run(batches):
        for batch in batches:
            for row, data, offsets in tx.chunks(batch.column(1)):
                hashes, bounds = shingle_sets(data, offsets)
                f1, f2 = _fingerprints(hashes, bounds)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(row, len(bounds) - 1), *(pa.array(x) for x in (np.diff(bounds), f1, f2)), pa.array(bit_sketches(hashes, bounds), pa.binary())], ["doc_id", "n_shingles", "f1", "f2", "sketch"])

    return documents.mapInArrow(run, SETS)


def shingle_counts(documents: DataFrame, slots: int) -> np.ndarray:
    """Rounded logarithms of how many documents hold the shingles of each slot."""

    def count(batches):
        table = np.zeros(slots, np.uint32)
        for batch in batches:
            for _, data, offsets in tx.chunks(batch.column(1)):
                hashes, _ = shingle_sets(data, offsets)
                np.add.at(table, (hashes & U64(slots - 1)).astype(np.int64), np.uint32(1))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(BLOCKS), pa.int32()), pa.array([zlib.compress(p.tobytes(), 1) for p in table.reshape(BLOCKS, -1)], pa.binary())], ["block", "counts"])

    def add(table: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(zlib.decompress(x.as_py()), np.uint32).astype(np.int64) for x in table.column("counts"))
        log = np.log2(np.maximum(total, 1)).astype(np.uint8)
        return pa.table({"block": table.column("block")[:1], "counts": pa.array([log.tobytes()], pa.binary())})

    rows = documents.mapInArrow(count, "block int, counts binary").groupBy("block").applyInArrow(add, "block int, counts binary").collect()
    blocks = {r.block: np.frombuffer(r.counts, np.uint8) for r in rows}
    return np.concatenate([blocks.get(b, np.zeros(slots // BLOCKS, np.uint8)) for b in range(BLOCKS)])


def _band(sizes: np.ndarray) -> np.ndarray:
    """0 below LOWEST; band i holds LOWEST * STEP**(i-1) .. LOWEST * STEP**i."""
    edges = LOWEST * STEP ** np.arange(24)
    return np.searchsorted(edges, sizes, "right")


def join_keys(hashes: np.ndarray, bounds: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys of the documents of a chunk, and the number of the document of each."""
    sizes = np.diff(bounds)
    band = _band(sizes)
    own = np.flatnonzero(sizes > 0)
    floor = LOWEST * STEP ** (np.maximum(band, 1) - 1)  # the smallest size of the band
    near = np.flatnonzero((band > 0) & (3 * sizes <= 4 * floor))  # may match a set of the band below
    text = np.concatenate([own, near])
    scheme = np.concatenate([band[own], band[near] - 1])
    differ = np.concatenate([sizes[own] // 3, (sizes[near] + floor[near]) // 7])  # the largest D of a match
    at = tx.ranges(bounds[:-1][text], sizes[text])
    item = np.repeat(np.arange(len(text)), sizes[text])
    h = hashes[at]
    parts = np.where(scheme > 0, (LOWEST // 2) * STEP ** np.minimum(scheme, 20), 0).astype(U64)[item]  # half the upper edge of the band
    part = np.where(parts > 0, (h >> U64(32)) % np.maximum(parts, U64(1)), h >> U64(32))
    order = np.argsort((item.astype(U64) << U64(40)) | part, kind="stable") if len(item) < 1 << 23 else np.lexsort((part, item))
    h, item, part, parts = h[order], item[order], part[order], parts[order]
    alone = parts == 0  # the lowest band: every shingle is a part
    head = tx.run_starts(item, np.where(alone, h, part))
    if not len(head):
        return np.zeros(0, U64), np.zeros(0, np.int64)
    sketch = np.bitwise_xor.reduceat(h, head)
    rare = np.minimum.reduceat(counts[(h & U64(len(counts) - 1)).astype(np.int64)], head)
    item, part = item[head], part[head]
    key = tx.mix(sketch ^ tx.mix(part + (scheme[item].astype(U64) << U64(56)) + U64(1)))
    order = np.lexsort((key, rare, item))
    key, item = key[order], item[order]
    place = np.arange(len(item)) - np.searchsorted(item, item)
    take = place <= differ[item]
    return key[take], text[item[take]]


def _squeezed(values: np.ndarray) -> np.ndarray:
    """Sorted ids as byte planes of their differences, which compress well (per packed row)."""
    return np.ascontiguousarray(np.diff(values, prepend=np.int64(0)).view(np.uint8).reshape(-1, 8).T)


def _groups_of(doc: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """A number for each run of sorted ids, equal for equal runs."""
    place = np.arange(len(doc)) - np.repeat(bounds[:-1], np.diff(bounds))
    return _sums(tx.mix(doc.astype(U64) * tx._M + place.astype(U64)), bounds).view(np.int64)


def _key_number(bucket: np.ndarray, short: np.ndarray) -> np.ndarray:
    """A number of a key that its bucket can tell as well."""
    return tx.join(bucket.astype(U64), short).view(np.int64)


SHORT = U64((1 << 8 * KEY_BYTES) - 1)
#: Packed entries: kind 0 keys and documents of a bucket; kind 1 a group cut off a hot key (numbers of group and key); kind 2 hot keys of a bucket.
ENTRIES = "bucket int, kind int, key binary, doc binary"


def _key_rows(n: int, counts):
    def flush(keys, docs, marks):
        key, doc, f1 = np.concatenate(keys), np.concatenate(docs), np.concatenate(marks)
        # Of equal sets in this task only the smallest document's keys travel.
        order = np.lexsort((doc, f1))
        head = tx.run_starts(f1[order])
        least = np.repeat(doc[order][head], np.diff(np.append(head, len(order))))
        stays = np.empty(len(doc), bool)
        stays[order] = doc[order] == least
        key, doc = key[stays], doc[stays]
        bucket = ((key >> U64(20)) % U64(n)).astype(np.int32)
        order = np.lexsort((doc, key))
        key, doc, bucket = key[order], doc[order], bucket[order]
        keep = tx.run_starts(key, doc)
        key, doc, bucket = key[keep], doc[keep], bucket[keep]
        head = tx.run_starts(key)
        size = np.diff(np.append(head, len(key)))
        rows = []
        if (size > GROUP).any():
            travels = np.ones(len(key), bool)
            hot = head[size > GROUP]
            for begin, count in zip(hot.tolist(), size[size > GROUP].tolist(), strict=True):
                number = _key_number(bucket[begin : begin + 1], key[begin : begin + 1] & SHORT)
                for lo in range(begin, begin + count, GROUP):
                    part = doc[lo : min(lo + GROUP, begin + count)]
                    group = _groups_of(part, np.array([0, len(part)]))
                    rows.append((int(group[0] % n), 1, group.tobytes() + number.tobytes(), _squeezed(part).tobytes()))
                    travels[lo + 1 : lo + len(part)] = False  # the smallest of the part stands for it
            for b in np.unique(bucket[hot]).tolist():
                rows.append((b, 2, (key[hot[bucket[hot] == b]] & SHORT).tobytes(), b""))
            key, doc, bucket = key[travels], doc[travels], bucket[travels]
        order = np.lexsort((doc, bucket))
        key, doc, bucket = key[order], doc[order], bucket[order]
        bounds = np.searchsorted(bucket, np.arange(n + 1))
        short = key.view(np.uint8).reshape(-1, 8)[:, :KEY_BYTES]
        rows += [(b, 0, short[bounds[b] : bounds[b + 1]].tobytes(), _squeezed(doc[bounds[b] : bounds[b + 1]]).tobytes()) for b in np.flatnonzero(np.diff(bounds)).tolist()]
        columns = list(zip(*rows, strict=True))
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int32(), pa.binary(), pa.binary()), strict=True)], ["bucket", "kind", "key", "doc"])

    def run(batches):
        table = counts.value
        keys, docs, marks, size = [], [], [], 0
        for batch in batches:
            ids = tx.ids(batch.column(0))
            for row, data, offsets in tx.chunks(batch.column(1)):
                hashes, bounds = shingle_sets(data, offsets)
                f1, f2 = _fingerprints(hashes, bounds)
                key, text = join_keys(hashes, bounds, table)
                known = ids[row + text] != tx.NO_ID
                keys.append(key[known])
                docs.append(ids[row + text][known])
                marks.append((f1 ^ f2)[text][known])
                size += len(keys[-1])
                if size >= FLUSH:
                    yield from flush(keys, docs, marks)
                    keys, docs, marks, size = [], [], [], 0
        if size:
            yield from flush(keys, docs, marks)

    return run


def _plain(squeezed: bytes) -> np.ndarray:
    """The ids that _squeezed packed."""
    planes = np.frombuffer(squeezed, np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view(np.int64).ravel())


def _groups(table: pa.Table) -> pa.Table:
    """A bucket of entries -> (gid, doc) of every group of documents with one key, equal groups once, and (gid, sid) of the groups of a hot key."""
    gids, members = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    of, whole = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]  # groups of hot keys, and the numbers of these keys
    for x, y in zip(*(tx.filtered(table, 1).column(c).to_pylist() for c in ("key", "doc")), strict=True):
        group, number = np.frombuffer(x, np.int64)
        doc = _plain(y)
        gids.append(np.full(len(doc), group))
        members.append(doc)
        of.append(np.array([group]))
        whole.append(np.array([number]))
    marked = np.unique(tx.unpack(tx.filtered(table, 2), "key", U64))
    rows = tx.filtered(table, 0)
    if rows.num_rows:
        raw = b"".join(x.as_py() for x in rows.column("key"))
        key = np.zeros((len(raw) // KEY_BYTES, 8), np.uint8)
        key[:, :KEY_BYTES] = np.frombuffer(raw, np.uint8).reshape(-1, KEY_BYTES)
        key = key.view(U64).ravel()
        doc = np.concatenate([_plain(x.as_py()) for x in rows.column("doc")])
        order = np.lexsort((doc, key))
        key, doc = key[order], doc[order]
        keep = tx.run_starts(key, doc)
        key, doc = key[keep], doc[keep]
        head = tx.run_starts(key)
        sizes = np.diff(np.append(head, len(key)))
        # Parts of at most GROUP members; all but the first of a key also hold its smallest.
        parts = np.where(sizes > 1, -(-sizes // GROUP), 0)
        owner = np.repeat(np.arange(len(head)), parts)
        nth = tx.ranges(np.zeros(len(parts), np.int64), parts)
        begin = head[owner] + nth * GROUP
        length = np.minimum(head[owner] + sizes[owner] - begin, GROUP)
        extra = (nth > 0).astype(np.int64)
        bounds = np.concatenate([[0], np.cumsum(length + extra)])
        at = np.empty(bounds[-1], np.int64)
        at[tx.ranges(bounds[:-1] + extra, length)] = tx.ranges(begin, length)
        at[bounds[:-1][extra > 0]] = head[owner[extra > 0]]
        group = _groups_of(doc[at], bounds)
        _, once = np.unique(group, return_index=True)
        width = np.diff(bounds)
        gids.append(np.repeat(group[once], width[once]))
        members.append(doc[at[tx.ranges(bounds[:-1][once], width[once])]])
        hot = (parts[owner] > 1) | np.isin(key[head[owner]], marked)
        of.append(group[hot])
        whole.append(_key_number(np.full(int(hot.sum()), table.column("bucket")[0].as_py()), key[head[owner[hot]]]))
    gid, of = np.concatenate(gids), np.concatenate(of)
    nulls = lambda k: pa.nulls(k, pa.int64())
    return pa.table({"gid": np.concatenate([gid, of]), "doc": pa.chunked_array([pa.array(np.concatenate(members)), nulls(len(of))]), "sid": pa.chunked_array([nulls(len(gid)), pa.array(np.concatenate(whole))])})


def similar(data_a, offsets_a, data_b, offsets_b) -> np.ndarray:
    """Which pairs of texts have 100 * intersection >= PERCENT * union: sketches first, then the sets."""
    (ha, ba), (hb, bb) = shingle_sets(data_a, offsets_a), shingle_sets(data_b, offsets_b)
    na, nb = np.diff(ba), np.diff(bb)
    pairs, bits = len(na), 4096
    pa_, pb = np.repeat(np.arange(pairs), na), np.repeat(np.arange(pairs), nb)
    cell = lambda p, h: p * bits + (h >> U64(52)).astype(np.int64)
    odd = (np.bincount(cell(pa_, ha), minlength=pairs * bits) + np.bincount(cell(pb, hb), minlength=pairs * bits)) & 1
    hamming = odd.reshape(pairs, bits).sum(axis=1)  # at most the symmetric difference
    may = ((100 + PERCENT) * hamming <= (100 - PERCENT) * (na + nb)) & (na > 0) & (nb > 0)
    ka, kb = may[pa_], may[pb]
    h, p = np.concatenate([ha[ka], hb[kb]]), np.concatenate([pa_[ka], pb[kb]])
    order = np.lexsort((h, p))
    h, p = h[order], p[order]
    both = np.bincount(p[1:][(h[1:] == h[:-1]) & (p[1:] == p[:-1])], minlength=pairs)
    return may & (100 * both >= PERCENT * (na + nb - both))


def _across(sketches: list[bytes], n, c, block, same: bool):
    """Positions (i, j) of members of different components that may link, by the Hamming distance of their sketches."""
    short = min(map(len, sketches))
    rows = []
    for x in sketches:
        a = np.frombuffer(x, U64)
        while a.nbytes > short:
            a = a[: len(a) // 2] ^ a[len(a) // 2 :]
        rows.append(a)
    bits = np.stack(rows)
    _, label, count = np.unique(c, return_inverse=True, return_counts=True)
    outside = np.flatnonzero(label != count.argmax())  # pairs inside the largest component never come up
    found = []
    step = max(1, (1 << 21) // bits.size) if bits.size else 1
    for lo in range(0, len(outside), step):
        i = outside[lo : lo + step]
        ok = (label[i, None] != label) & (100 * np.minimum(n[i, None], n) >= PERCENT * np.maximum(n[i, None], n))
        ok &= same | (block[i, None] != block)
        hamming = np.bitwise_count(bits[i, None] ^ bits).sum(axis=2, dtype=np.int64)
        a, b = np.nonzero(ok & ((100 + PERCENT) * hamming <= (100 - PERCENT) * (n[i, None] + n)))
        found.append((i[a], b))
    return tuple(np.concatenate([f[k] for f in found]) if found else np.zeros(0, np.int64) for k in (0, 1))


def _compare_cells(buckets: int):
    """Cells (gid, i, j) of a bucket -> pairs that may link, packed and each once."""

    def run(table: pa.Table) -> pa.Table:
        gid, i, j, m, n, c, block = (table.column(x).to_numpy() for x in ("gid", "i", "j", "m", "n", "c", "b"))
        sketch = table.column("sketch").to_pylist()
        order = np.lexsort((m, j, i, gid))
        head = tx.run_starts(gid[order], i[order], j[order])
        pairs = [np.zeros((0, 2), np.int64)]
        for a, b in zip(head.tolist(), [*head[1:].tolist(), len(order)], strict=True):
            at = order[a:b]
            if len(at) > 1:
                x, y = _across([sketch[k] for k in at], n[at], c[at], block[at], i[at[0]] == j[at[0]])
                pairs.append(np.stack([np.minimum(m[at][x], m[at][y]), np.maximum(m[at][x], m[at][y])], axis=1))
        return _pair_rows(np.concatenate(pairs), buckets)

    return run


def _pair_rows(pairs: np.ndarray, buckets: int) -> pa.Table:
    pairs = _once(pairs)
    bucket = (tx.mix(pairs[:, 0].astype(U64) * tx._M ^ pairs[:, 1].astype(U64)) % U64(buckets)).astype(np.int32)
    return pa.Table.from_batches([tx.pack(bucket, buckets, 0, {"a": pairs[:, 0], "b": pairs[:, 1]})])


def _once(pairs: np.ndarray) -> np.ndarray:
    """Each pair once, in order."""
    pairs = pairs[np.lexsort((pairs[:, 1], pairs[:, 0]))]
    return pairs[tx.run_starts(pairs[:, 0], pairs[:, 1])]


def _unique_pairs(table: pa.Table) -> pa.Table:
    pairs = _once(np.stack([tx.unpack(table, "a", np.int64), tx.unpack(table, "b", np.int64)], axis=1))
    return pa.table({"a": pairs[:, 0], "b": pairs[:, 1]})


def across_components(open_groups: DataFrame, buckets: int) -> DataFrame:
    """Pairs (a, b) of open_groups(gid, size, m, n, c, sketch) with different components that may link.

    A group larger than CELL is cut into blocks, and every pair of blocks is a cell of its own.
    """
    blocks = F.ceil(F.col("size") / CELL).cast("long")
    rows = open_groups.withColumn("b", F.pmod(F.xxhash64("m"), blocks).cast("int")).withColumn("k", F.explode(F.sequence(F.lit(0), (blocks - 1).cast("int"))))
    rows = rows.withColumn("i", F.least("b", "k")).withColumn("j", F.greatest("b", "k"))
    cell = F.xxhash64("gid", "i", "j")
    # Small cells share a bucket, a large one has its own, so that what a task holds is bounded by a cell.
    alone = F.lit(buckets) + F.pmod(cell, F.lit(1 << 30))
    rows = rows.withColumn("bucket", F.when(F.col("size") > CELL // 8, alone).otherwise(F.pmod(cell, F.lit(buckets))).cast("int"))
    packed = rows.select("bucket", "gid", "i", "j", "m", "n", "c", "b", "sketch").groupBy("bucket").applyInArrow(_compare_cells(buckets), tx.packed_schema(["a", "b"]))
    return packed.groupBy("bucket").applyInArrow(_unique_pairs, "a long, b long")


def verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The rows of pairs(a, b) whose texts link; texts(doc, text)."""
    with_a = pairs.join(texts.select(F.col("doc").alias("a"), F.col("text").alias("text_a")), "a")
    with_b = with_a.join(texts.select(F.col("doc").alias("b"), F.col("text").alias("text_b")), "b").select("a", "b", "text_a", "text_b")

    def run(batches):
        for batch in batches:
            a, b = tx.strings(batch.column(2)), tx.strings(batch.column(3))
            row = 0
            for row, data, offsets in tx.chunks(a, tx.CHUNK_BYTES // 4):
                rows = len(offsets) - 1
                part = b.slice(row, rows)
                at = 0
                for at, data_b, offsets_b in tx.chunks(part, tx.CHUNK_BYTES // 4):
                    m = len(offsets_b) - 1
                    good = similar(data[offsets[at] : offsets[at + m]], offsets[at : at + m + 1] - offsets[at], data_b, offsets_b)
                    yield batch.slice(row + at, m).select(["a", "b"]).filter(pa.array(good))

    return with_b.mapInArrow(run, "a long, b long")


def near_duplicates(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles and component_id of every document."""
    spark = documents.sparkSession
    docs = documents.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    sets = tx.written(set_table(docs), "sets")
    total = sets.agg(F.coalesce(F.sum("n_shingles"), F.lit(0))).first()[0]
    slots = 1 << min(max(total // SHARE, LEAST_SLOTS), MOST_SLOTS).bit_length() - 1
    counts = spark.sparkContext.broadcast(shingle_counts(docs, slots))
    real = sets.filter("doc_id is not null and n_shingles > 0")
    # Documents with equal sets are one vertex, named by the smallest of them; a doc_id with several texts has several.
    vertex = real.groupBy("n_shingles", "f1", "f2").agg(F.min("doc_id").alias("v"))
    sizes = F.min("n_shingles").alias("low"), F.max("n_shingles").alias("high")  # of the sets of a vertex
    named = tx.written(real.join(vertex, ["n_shingles", "f1", "f2"]).groupBy("doc_id", "v").agg(*sizes), "named")
    first = named.groupBy("doc_id").agg(F.min("v").alias("least"), F.max("v").alias("most"))
    own = named.join(first.filter("least < most"), "doc_id").filter("v > least").select(F.col("least").alias("a"), F.col("v").alias("b"))

    n = tx.buckets(docs)
    keys = docs.mapInArrow(_key_rows(n, counts), ENTRIES)
    groups = tx.written(keys.groupBy("bucket").applyInArrow(_groups, "gid long, doc long, sid long"), "groups")
    grouped = groups.filter("doc is not null").select("gid", "doc").distinct()
    members = grouped.join(named, grouped.doc == named.doc_id).groupBy("gid", F.col("v").alias("m")).agg(F.min("low").alias("low"), F.max("high").alias("high"))
    members = tx.written(members, "members")
    # The groups of each hot key; keys with the same groups count once.
    supers = groups.filter("sid is not null").select("sid", "gid").distinct()
    alike = supers.groupBy("sid").agg(F.sum(F.xxhash64("gid").cast("decimal(38,0)")).alias("mark"), F.count("*").alias("k")).groupBy("mark", "k").agg(F.min("sid").alias("sid"))
    supers = tx.written(supers.join(alike.select("sid"), "sid"), "supers")
    tx.discard(groups)

    texts = docs.select(F.col("doc_id").alias("doc"), "text")
    lead = members.groupBy("gid").agg(F.min(F.struct("m", "low", "high")).alias("lead"))
    fit = (F.col("m") != F.col("lead.m")) & (100 * F.col("high") >= PERCENT * F.col("lead.low")) & (100 * F.col("lead.high") >= PERCENT * F.col("low"))
    against = members.join(lead, "gid").filter(fit).select(F.col("lead.m").alias("a"), F.col("m").alias("b")).distinct()
    tried = tx.written(against, "pairs")
    links = tx.written(verified(tried, texts).unionByName(own), "links")

    parts = connected_components(links.select(F.col("a").alias("u"), F.col("b").alias("v")))
    placed = tx.written(members.join(parts, members.m == parts.node, "left").select("gid", "m", F.coalesce("component", "m").alias("c")), "placed")
    ends = placed.groupBy("gid").agg(F.min("c").alias("c0"), F.max("c").alias("c1"), F.count("*").alias("size"))
    split = ends.filter("c0 < c1").select("gid", "size")
    wide = supers.join(ends, "gid").groupBy("sid").agg(F.min("c0").alias("c0"), F.max("c1").alias("c1"), F.sum("size").alias("size")).filter("c0 < c1").select("sid", "size")
    split = split.join(supers.join(wide, "sid").select("gid"), "gid", "left_anti")  # compared as a part of its key
    spread = supers.join(wide, "sid").join(placed, "gid").select(F.col("sid").alias("gid"), "size", "m", "c").distinct()
    sketches = real.select(F.col("doc_id").alias("m"), F.col("n_shingles").alias("n"), "sketch").distinct()
    open_groups = placed.join(split, "gid").select("gid", "size", "m", "c").unionByName(spread).join(sketches, "m")
    again = tx.written(across_components(open_groups, n).join(tried, ["a", "b"], "left_anti"), "pairs")
    links = tx.written(links.unionByName(verified(again, texts)), "links")
    tx.discard(tried, again, members, supers, placed)

    parts = connected_components(links.select(F.col("a").alias("u"), F.col("b").alias("v")))
    degree = links.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count("*").alias("n_verified_links"))
    vertices = named.groupBy("doc_id").agg(F.min("v").alias("v"))
    vertices = vertices.join(parts, vertices.v == parts.node, "left").join(degree, vertices.v == degree.node, "left").select("doc_id", F.coalesce("component", "v").alias("component_id"), F.coalesce("n_verified_links", F.lit(0)).alias("n_verified_links"))
    return sets.join(vertices, "doc_id", "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"), F.coalesce("n_verified_links", F.lit(0)).cast("long").alias("n_verified_links"))


def keep_first_of_group(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`documents`, all columns, without those whose group holds a smaller doc_id."""
    gone = near_duplicates(documents, id_col, text_col).filter("component_id < doc_id").select(F.col("doc_id").alias("__gone")).distinct()
    return documents.join(gone, F.col(f"`{id_col}`").cast("long") == gone["__gone"], "left_anti")
