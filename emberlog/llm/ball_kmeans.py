"""Vector code compression: product codebooks by ball k-means, in exact integers.

A vector is cut into PARTS equal parts; each part position has a codebook, trained by rounds
of k-means.  Every entry is the centre of a ball that holds the parts assigned to it:

- an entry whose centre lies within twice the ball's radius is a neighbour; no other entry
  can be nearer to any part of the ball;
- parts nearer to their entry than half the way to its nearest neighbour (the stable core)
  stay, and a ball that has not moved and whose neighbours have not moved is left alone;
- all other parts lie in rings: one at distance r compares the neighbours within 2r alone.

So a round yields exactly the assignments of a full search.  Vectors lie in blocks of about
BLOCK_BYTES beside their codes, in a table that each round writes anew and the next one reads;
there is no shuffle of vectors.  A task adds up its parts first and sends one row for each
entry; the driver holds the codebooks alone (16 entries of one vector's length).

Components are floor(SCALE * x) as whole numbers of any size: doubles while every squared
distance stays below 2**53, Python's integers elsewhere.

Defined results: vectors that are null or hold null or non-finite components take no part;
the codebooks have the length of the vector with the smallest id among those that can be cut
(a length that is a positive multiple of `parts`); vectors of other lengths are returned with
code and error null and add nothing to label_error; the first entries are the vectors with
the smallest ids, null ids last, rows that share an id by their components, and fewer than
`entries` where there are fewer vectors; errors beyond a long's range show as its largest
value; labels of any sortable type, null being one label; an empty table gives no rows; extra
columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from emberlog.llm import _text as tx

SCALE, PARTS, ENTRIES, ROUNDS = 4096, 8, 16, 6
BLOCK_BYTES = 1 << 20  # of components in a block
EXACT = 2.0**53  # doubles hold all whole numbers below
LONG = (1 << 63) - 1
HOT_SHARE = 1024  # a label with more than this share of all rows joins by broadcast; there are as many at most


def whole_numbers(x: np.ndarray) -> np.ndarray:
    """floor(SCALE * x) as doubles where squared distances stay exact, else as Python's integers."""
    with np.errstate(over="ignore"):
        scaled = np.floor(x * SCALE)
    if not x.size or 4 * x.shape[-1] * np.abs(scaled).max() ** 2 < EXACT:
        return scaled
    return np.array([int(v * SCALE // 1) if abs(v) < EXACT else int(v) * SCALE for v in x.ravel().tolist()], object).reshape(x.shape)


def _integers(x: np.ndarray) -> np.ndarray:
    return x if x.dtype == object else np.array([int(v) for v in x.ravel().tolist()], object).reshape(x.shape)


def _squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    d = a - b
    return (d * d).sum(axis=-1)


class Balls:
    """The entries of one part position: their centres, radii and neighbours."""

    def __init__(self, centres: np.ndarray, reach: list[int], moved: list[bool]):
        """reach: four times the largest squared distance of a ball's parts from the centre it has now, or more; -1 for empty balls."""
        self.centres = centres
        between = _squared(centres[:, None], centres[None, :])
        self.neighbours, self.still = [], []
        for i, far in enumerate(reach):
            near = sorted((between[i, j], j) for j in range(len(centres)) if j != i and between[i, j] <= far)
            self.neighbours.append(near)
            self.still.append(not moved[i] and not any(moved[j] for _, j in near))

    def assign(self, x: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """New codes of parts and their squared distances; parts of balls at rest keep theirs, with distance -1."""
        centres = self.centres
        if x.dtype != centres.dtype:
            x, centres = _integers(x), _integers(centres)
        out = codes.copy()
        distance = np.full(len(x), -1, x.dtype)
        for i in range(len(centres)):
            own = np.flatnonzero(codes == i)
            if not len(own) or self.still[i]:
                continue
            least = _squared(x[own], centres[i])
            best, ring = np.full(len(own), i), 4 * least
            at = np.arange(len(own))
            for apart, j in self.neighbours[i]:  # nearest first, so that the rings that remain shrink
                at = at[apart <= ring[at]]
                if not len(at):
                    break
                d = _squared(x[own[at]], centres[j])
                nearer = (d < least[at]) | (d == least[at]) & (j < best[at])
                least[at[nearer]], best[at[nearer]] = d[nearer], j
            out[own], distance[own] = best, least
        return out, distance


def _decoded(raw: bytes, dim: int, double: bool) -> np.ndarray:
    return whole_numbers(np.frombuffer(raw, np.float64 if double else np.float32).reshape(-1, dim).astype(np.float64))


def usable(embeddings: DataFrame, id_col: str, vector_col: str, label_col: str) -> DataFrame:
    """vec_id, label and vector of the rows that take part."""
    rows = embeddings.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), F.col(f"`{label_col}`").alias("label"), F.col(f"`{vector_col}`").alias("x"))
    if rows.schema["x"].dataType.elementType != T.FloatType():
        rows = rows.withColumn("x", F.col("x").cast("array<double>"))
    return rows.filter(F.col("x").isNotNull() & ~F.exists("x", lambda v: F.coalesce(F.isnan(v) | (F.abs(v) == float("inf")), F.lit(True))))


def _blocks(rows: DataFrame, dim: int, parts: int) -> DataFrame:
    """ids, labels, components and codes of vectors of length dim, packed in blocks."""
    double = rows.schema["x"].dataType.elementType == T.DoubleType()
    label = rows.schema["label"].dataType
    step = max(1, BLOCK_BYTES // (dim * (8 if double else 4)))
    names = ["ids", "labels", "vectors", "codes"]

    def run(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, step):
                part = batch.slice(lo, step)
                bounds = pa.array([0, part.num_rows], pa.int32())
                values = part.column(2).flatten().to_numpy(zero_copy_only=False)
                yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(bounds, part.column(0)), pa.ListArray.from_arrays(bounds, part.column(1)), pa.array([values.tobytes()], pa.binary()), pa.array([bytes(part.num_rows * parts)], pa.binary())], names)

    schema = T.StructType([T.StructField("ids", T.ArrayType(T.LongType())), T.StructField("labels", T.ArrayType(label)), T.StructField("vectors", T.BinaryType()), T.StructField("codes", T.BinaryType())])
    return rows.filter(F.size("x") == dim).select("vec_id", "label", "x").mapInArrow(run, schema)


def _each(batches):
    """Blocks one by one; release() keeps a task's memory at a few of them."""
    for batch in batches:
        for row in range(batch.num_rows):
            yield batch.slice(row, 1)
        tx.release()


class Trainer:
    """Codebooks and balls between rounds, on the driver."""

    def __init__(self, first: np.ndarray, parts: int):
        self.parts = parts
        self.centres = [first[:, p] for p in range(parts)]  # [entry, component] of each part position
        k = len(first)
        #: Before the first round all parts are in the first ball, which reaches everywhere.
        self.reach = [[float("inf")] + [-1] * (k - 1) for _ in range(parts)]
        self.moved = [[True] * k for _ in range(parts)]

    def balls(self) -> list[Balls]:
        return [Balls(c, r, m) for c, r, m in zip(self.centres, self.reach, self.moved, strict=True)]

    def update(self, sums: dict) -> None:
        """sums: (part, entry) -> (count, sums of components, largest squared distance)."""
        for p in range(self.parts):
            old = self.centres[p]
            new = [[s // sums[p, e][0] for s in sums[p, e][1]] if (p, e) in sums else [int(v) for v in old[e].tolist()] for e in range(len(old))]
            size = max(abs(v) for row in new for v in row)
            self.centres[p] = np.array(new, float if 4 * len(new[0]) * size**2 < EXACT else object)
            shift = [int(v) for v in _squared(np.array(new, object), _integers(old))]
            self.moved[p] = [s > 0 for s in shift]
            # a part at distance r from the old centre is within r + shift of the new one; (a + b)^2 <= 2 (a^2 + b^2)
            self.reach[p] = [-1 if (p, e) not in sums else 4 * sums[p, e][2] if not shift[e] else 8 * (sums[p, e][2] + shift[e]) for e in range(len(old))]


STATISTICS = "part int, entry int, n long, sums array<string>, far string"


def _round(blocks: DataFrame, balls: list[Balls], dim: int, double: bool, last_far: dict) -> DataFrame:
    """Blocks with new codes (kind 0), and one row of statistics for each part, entry and task (kind 1); last_far: largest squared distance of each ball."""
    parts, width = len(balls), dim // len(balls)
    shared = blocks.sparkSession.sparkContext.broadcast(balls)  # entries x dim numbers, and as many neighbours
    names = [*blocks.columns, "part", "entry", "n", "sums", "far", "kind"]
    schema = T.StructType([*blocks.schema.fields, *T._parse_datatype_string(STATISTICS).fields, T.StructField("kind", T.IntegerType())])

    def run(batches):
        sums: dict = {}
        kinds: list = []  # of the blocks' columns
        for block in _each(batches):
            kinds = block.schema.types
            x = _decoded(block.column(2)[0].as_py(), dim, double)
            x = x.reshape(len(x), parts, width)
            codes = np.frombuffer(block.column(3)[0].as_py(), np.uint8).reshape(-1, parts)
            new = np.zeros_like(codes)
            for p, ball in enumerate(shared.value):
                new[:, p], distance = ball.assign(x[:, p], codes[:, p])
                order = np.argsort(new[:, p], kind="stable")
                bounds = np.searchsorted(new[order, p], np.arange(len(ball.centres) + 1))
                for e in np.flatnonzero(np.diff(bounds)).tolist():
                    at = order[bounds[e] : bounds[e + 1]]
                    own = x[at, p]
                    total = [int(v) for v in (own if own.dtype == object else own.astype(np.int64)).sum(axis=0).tolist()]
                    n, before, far = sums.get((p, e), (0, [0] * width, -1))
                    sums[p, e] = (n + len(at), [a + b for a, b in zip(before, total, strict=True)], max(far, int(distance[at].max())))
            yield pa.RecordBatch.from_arrays([*block.columns[:3], pa.array([new.tobytes()], pa.binary()), *(pa.nulls(1, t) for t in (pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.string()), pa.string())), pa.array([0], pa.int32())], names)
        keys = sorted(sums)
        if not keys:
            return
        rows = [[k[0] for k in keys], [k[1] for k in keys], [sums[k][0] for k in keys], [[str(v) for v in sums[k][1]] for k in keys], [str(max(sums[k][2], last_far.get(k, -1) if shared.value[k[0]].still[k[1]] else -1)) for k in keys]]
        blank = [pa.nulls(len(keys), t) for t in kinds]
        yield pa.RecordBatch.from_arrays([*blank, *(pa.array(v, t) for v, t in zip(rows, (pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.string()), pa.string()), strict=True)), pa.array([1] * len(keys), pa.int32())], names)

    return blocks.mapInArrow(run, schema)


def _merged(table: pa.Table) -> pa.Table:
    """The sum of the tasks' rows of one part and entry."""
    n = sum(table.column("n").to_pylist())
    sums = [sum(map(int, v)) for v in zip(*table.column("sums").to_pylist(), strict=True)]
    far = max(map(int, table.column("far").to_pylist()))
    return pa.table({"part": table.column("part").slice(0, 1), "entry": table.column("entry").slice(0, 1), "n": [n], "sums": pa.array([[str(v) for v in sums]], pa.list_(pa.string())), "far": [str(far)]})


def train(rows: DataFrame, dim: int, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[Trainer, DataFrame]:
    """Codebooks after `rounds` rounds, and the blocks with the codes of the last one."""
    double = rows.schema["x"].dataType.elementType == T.DoubleType()
    first = rows.filter(F.size("x") == dim).orderBy(F.col("vec_id").asc_nulls_last(), "x").limit(entries).collect()
    start = whole_numbers(np.array([r.x for r in first], float).reshape(len(first), dim))
    trainer = Trainer(start.reshape(len(first), parts, dim // parts), parts)
    blocks = tx.written(_blocks(rows, dim, parts), "blocks")
    far: dict = {}
    for number in range(rounds):
        done = tx.written(_round(blocks, trainer.balls(), dim, double, far), f"round-{number}")
        found = done.filter("kind = 1").select("part", "entry", "n", "sums", "far").groupBy("part", "entry").applyInArrow(_merged, STATISTICS).collect()  # one row an entry
        sums = {(r.part, r.entry): (r.n, [int(v) for v in r.sums], int(r.far)) for r in found}
        far = {k: v[2] for k, v in sums.items()}
        trainer.update(sums)
        tx.discard(blocks)
        blocks, path = done.filter("kind = 0").select("ids", "labels", "vectors", "codes"), done._scratch
        blocks._scratch = path
    return trainer, blocks


def _coded(blocks: DataFrame, balls: list[Balls], dim: int, double: bool) -> DataFrame:
    """vec_id, label, code and error of every vector, by the final codebooks."""
    parts, width = len(balls), dim // len(balls)
    for ball in balls:
        ball.still = [False] * len(ball.still)  # every distance is asked for
    shared = blocks.sparkSession.sparkContext.broadcast(balls)
    label = blocks.schema["labels"].dataType.elementType

    def run(batches):
        for block in _each(batches):
            x = _decoded(block.column(2)[0].as_py(), dim, double)
            x = x.reshape(len(x), parts, width)
            codes = np.frombuffer(block.column(3)[0].as_py(), np.uint8).reshape(-1, parts)
            new, error = np.zeros_like(codes), np.zeros(len(x), object)
            for p, ball in enumerate(shared.value):
                new[:, p], distance = ball.assign(x[:, p], codes[:, p])
                error = error + (distance if distance.dtype == object else distance.astype(np.int64)).astype(object)
            text = new.tobytes().hex()
            yield pa.RecordBatch.from_arrays([block.column(0).flatten(), block.column(1).flatten(), pa.array([text[i : i + 2 * parts] for i in range(0, len(text), 2 * parts)], pa.string()), pa.array([min(v, LONG) for v in error.tolist()], pa.int64())], ["vec_id", "label", "code", "error"])

    return blocks.mapInArrow(run, T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("label", label), T.StructField("code", T.StringType()), T.StructField("error", T.LongType())]))


def with_label_errors(coded: DataFrame) -> DataFrame:
    """`coded` with the sum of errors over equal labels; labels that hold a large share of all rows join by broadcast, HOT_SHARE at most."""
    by = coded.groupBy("label").agg(F.count("*").alias("n"), F.sum(F.col("error").cast("decimal(38,0)")).alias("s"))
    by = by.select(F.col("label").alias("by"), F.least("s", F.lit(LONG).cast("decimal(38,0)")).cast("long").alias("s"), "n")
    by = tx.written(by, "labels")
    total = by.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    hot = by.filter(F.col("n") * HOT_SHARE > total).withColumnsRenamed({"by": "hot", "s": "hot_s"}).select("hot", "hot_s", F.lit(True).alias("is_hot"))
    known = coded.join(F.broadcast(hot), F.col("label").eqNullSafe(F.col("hot")), "left")
    columns = ["vec_id", "code", "error", "label_error", "label"]
    often = known.filter("is_hot").withColumn("label_error", F.col("hot_s")).select(*columns)
    rare = known.filter("is_hot IS NULL").join(by.filter(F.col("n") * HOT_SHARE <= total), F.col("label").eqNullSafe(F.col("by")), "left").withColumn("label_error", F.col("s")).select(*columns)
    return often.unionByName(rare)


def codebook_digest(trainer: Trainer) -> str:
    """Hex SHA-256 of all entries' components, by part, entry and place."""
    return hashlib.sha256(",".join(str(int(v)) for c in trainer.centres for row in c for v in row).encode()).hexdigest()


def vector_codes(embeddings: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """vec_id, code, error, label_error, codebooks_sha256 and label of every vector that takes part."""
    if not 1 <= entries <= 256:
        raise ValueError("a code has two hex digits: 1 to 256 entries")
    rows = usable(embeddings, id_col, vector_col, label_col)
    fits = (F.size("x") > 0) & (F.size("x") % parts == 0)
    first = rows.filter(fits).orderBy(F.col("vec_id").asc_nulls_last(), "x").select(F.size("x")).first()
    dim = first[0] if first else -1
    null = {"code": "string", "error": "long", "label_error": "long", "codebooks_sha256": "string"}
    none = rows.filter(F.size("x") != dim).select("vec_id", "label", *[F.lit(None).cast(t).alias(c) for c, t in null.items()])
    if first is None:
        return none
    trainer, blocks = train(rows, dim, parts, entries, rounds)
    coded = tx.written(_coded(blocks, trainer.balls(), dim, rows.schema["x"].dataType.elementType == T.DoubleType()), "coded")
    tx.discard(blocks)
    out = with_label_errors(coded).withColumn("codebooks_sha256", F.lit(codebook_digest(trainer)))
    return out.unionByName(none)


def _oracle() -> str:
    """The contract as SQL: the rounds one after the other."""
    head = """WITH v AS MATERIALIZED (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(4096 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
 WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
p AS MATERIALIZED (SELECT vec_id, p, e[p * (len(e) // 8) + 1 : (p + 1) * (len(e) // 8)] AS x FROM v, range(8) AS r(p)),
c0 AS MATERIALIZED (SELECT p, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS c, x FROM p QUALIFY c < 16)"""
    assign = """a{n} AS MATERIALIZED (SELECT p.vec_id, p.p, p.x, min({{'d': CAST(list_sum(list_transform(list_zip(p.x, k.x), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS BIGINT), 'c': k.c}}) AS b
 FROM p JOIN c{n} k ON p.p = k.p GROUP BY ALL)"""
    update = """m{n} AS (SELECT p, c, list(m ORDER BY i) AS x FROM (SELECT p, c, i, CAST(floor(CAST(sum(y) AS DOUBLE) / count(*)) AS BIGINT) AS m
 FROM (SELECT p, b.c AS c, unnest(x) AS y, unnest(range(len(x))) AS i FROM a{n}) GROUP BY ALL) GROUP BY ALL),
c{m} AS MATERIALIZED (SELECT p, c, coalesce(m.x, k.x) AS x FROM c{n} k LEFT JOIN m{n} m USING (p, c))"""
    steps = [head] + [part.format(n=n, m=n + 1) for n in range(ROUNDS) for part in (assign, update)] + [assign.format(n=ROUNDS)]
    tail = f"""SELECT vec_id, label, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, (SELECT sha256(string_agg(y, ',' ORDER BY p, c, i)) FROM (SELECT p, c, unnest(x)::VARCHAR AS y, unnest(range(len(x))) AS i FROM c{ROUNDS})) AS codebooks_sha256
 FROM (SELECT vec_id, string_agg(printf('%02x', b.c), '' ORDER BY p) AS code, CAST(sum(b.d) AS BIGINT) AS error FROM a{ROUNDS} GROUP BY vec_id) JOIN v USING (vec_id)"""
    return ",\n".join(steps) + "\n" + tail


ORACLE = _oracle()
