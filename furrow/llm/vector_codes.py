"""Product codes of vectors, with codebooks fitted in exact integers.

Vectors are cut into equal parts, and each part's components are integers. Parts of one position are put in the order
of a Hilbert curve, so that neighbours in the order are near each other, and cut into flat blocks: ids, components, the
box of their least and greatest components, and their sums. Blocks are written once. In each round a block's box gives
every codebook entry a least and a greatest distance; entries whose least distance exceeds the smallest greatest one
cannot be nearest, and what remains is the block's shortlist. One entry alone takes the whole block by its sums;
otherwise a small kernel measures the shortlist exactly. A round brings sums and counts of each entry back, which
are as many whatever the table holds.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from furrow.llm import common as C
from furrow.session import broadcast_if_small, stored

# Parts of a vector, entries of a codebook, rounds, and integer steps of one.
PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
BLOCK = 256
# Bits of each component in the place on the curve, and components that take part in it.
CURVE_BITS, CURVE_AXES = 4, 15
# Products below this bound are exact in double precision.
EXACT = 2**53


def largest(size: int) -> float:
    """Below this size of components, squared distances of ``size`` of them fit 64 bits: 262,144 for parts of 16."""
    return 2.0 ** ((60 - max(1, size - 1).bit_length()) // 2) / SCALE


def hilbert(cells: np.ndarray, bits: int) -> np.ndarray:
    """Place of each row of ``cells``, whole numbers below ``2 ** bits``, on the Hilbert curve through all such rows.

    Plane by plane from the highest bit: where an axis has the bit, the lower bits of the first axis are turned
    over, elsewhere they change places with those of that axis. A Gray code over all axes then orders each plane.
    """
    x = cells.astype(np.uint32).T.copy()
    axes = len(x)
    for bit in range(bits - 1, 0, -1):
        low = np.uint32((1 << bit) - 1)
        for i in range(axes):
            has = (x[i] >> np.uint32(bit)) & np.uint32(1) == 1
            swap = np.where(has, np.uint32(0), (x[0] ^ x[i]) & low)
            x[0] ^= np.where(has, low, swap)
            x[i] ^= swap
    for i in range(1, axes):
        x[i] ^= x[i - 1]
    turn = np.zeros(x.shape[1], np.uint32)
    for bit in range(bits - 1, 0, -1):
        has = (x[-1] >> np.uint32(bit)) & np.uint32(1) == 1
        turn ^= np.where(has, np.uint32((1 << bit) - 1), np.uint32(0))
    x ^= turn
    place = np.zeros(x.shape[1], np.int64)
    for bit in range(bits - 1, -1, -1):
        for i in range(axes):
            place = (place << 1) | ((x[i] >> np.uint32(bit)) & np.uint32(1)).astype(np.int64)
    return place


def integers(batch: pa.RecordBatch, width: int) -> np.ndarray:
    """The vectors of a batch in integer steps, rounded down."""
    values = batch.column("vector").flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return np.floor(values * SCALE).astype(np.int64).reshape(-1, width)


def moments(width: int):
    """Count, sum and sum of squares of each component; one row a task."""

    def run(batches):
        n, total, squares = 0, np.zeros(width), np.zeros(width)
        for batch in batches:
            x = integers(batch, width).astype(np.float64)
            n, total, squares = n + len(x), total + x.sum(axis=0), squares + np.square(x).sum(axis=0)
        if n:
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(width, dtype=np.int32)), pa.array([n] * width, pa.int64()), pa.array(total), pa.array(squares)],
                names=["at", "n", "total", "squares"],
            )

    return run


def on_curve(width: int, parts: int, low: np.ndarray, cell: np.ndarray):
    """A row for each part of each vector, with its place on the curve."""
    size = width // parts

    def run(batches):
        for batch in batches:
            x = integers(batch, width)
            grid = np.clip(np.floor((x - low) / cell), 0, (1 << CURVE_BITS) - 1).astype(np.uint32)
            for p in range(parts):
                own = slice(p * size, p * size + min(size, CURVE_AXES))
                components = pa.FixedSizeBinaryArray.from_buffers(
                    pa.binary(4 * size), len(x), [None, pa.py_buffer(np.ascontiguousarray(x[:, p * size : (p + 1) * size].astype("<i4")))]
                ).cast(pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(len(x), p, np.int32)), pa.array(hilbert(grid[:, own], CURVE_BITS)), batch.column("id"),
                        batch.column("name"), batch.column("label"), components,
                    ],
                    names=["part", "place", "id", "name", "label", "components"],
                )

    return run


BLOCKS = "part int, n int, ids binary, names binary, labels array<{}>, components binary, low binary, high binary, sums binary"


def blocked(size: int, label: pa.DataType, block: int = BLOCK):
    """Flat blocks of neighbours; a task holds one block at a time."""

    def block_of(part: int, pieces: list[pa.RecordBatch]) -> pa.RecordBatch:
        x = np.frombuffer(b"".join(v for piece in pieces for v in piece.column("components").to_pylist()), "<i4").reshape(-1, size)
        ids, names = (np.concatenate([piece.column(c).to_numpy(zero_copy_only=False) for piece in pieces]) for c in ("id", "name"))
        labels = pa.concat_arrays([piece.column("label").cast(label) for piece in pieces])
        return pa.RecordBatch.from_arrays(
            [
                pa.array([part], pa.int32()), pa.array([len(x)], pa.int32()), pa.array([ids.astype("<i8").tobytes()], pa.binary()),
                pa.array([names.astype("<i8").tobytes()], pa.binary()), pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), labels),
                pa.array([x.tobytes()], pa.binary()),
                pa.array([x.min(axis=0).astype("<i8").tobytes()], pa.binary()), pa.array([x.max(axis=0).astype("<i8").tobytes()], pa.binary()),
                pa.array([x.astype("<i8").sum(axis=0).tobytes()], pa.binary()),
            ],
            names=["part", "n", "ids", "names", "labels", "components", "low", "high", "sums"],
        )

    def run(batches):
        part, held, n = None, [], 0
        for batch in batches:
            parts = batch.column("part").to_numpy()
            cuts = np.flatnonzero(C.starts(parts)).tolist() if len(parts) else []
            for first, last in zip(cuts, [*cuts[1:], batch.num_rows], strict=True):
                if parts[first] != part:
                    if held:
                        yield block_of(part, held)
                    part, held, n = int(parts[first]), [], 0
                while first < last:
                    take = min(block - n, last - first)
                    held.append(batch.slice(first, take))
                    first, n = first + take, n + take
                    if n == block:
                        yield block_of(part, held)
                        held, n = [], 0
        if held:
            yield block_of(part, held)

    return run


class Boxes:
    """Blocks of one batch, and the entries that can be nearest to something in each of them."""

    def __init__(self, batch: pa.RecordBatch, size: int):
        self.size = size
        self.part = batch.column("part").to_pylist()
        self.n = batch.column("n").to_pylist()
        self.low, self.high, self.sums = (
            np.frombuffer(b"".join(batch.column(c).to_pylist()), "<i8").reshape(-1, size) for c in ("low", "high", "sums")
        )
        self.components = batch.column("components")

    def shortlist(self, k: int, entries: np.ndarray) -> np.ndarray:
        """Numbers of the entries that no other entry beats wherever in the box a vector lies."""
        below, above = self.low[k] - entries, entries - self.high[k]
        least = np.square(np.maximum(np.maximum(below, above), 0)).sum(axis=1)
        greatest = np.square(np.maximum(np.abs(below), np.abs(above))).sum(axis=1)
        return np.flatnonzero(least <= greatest.min())

    def vectors(self, k: int) -> np.ndarray:
        return np.frombuffer(self.components[k].as_py(), "<i4").reshape(-1, self.size).astype(np.int64)


def nearest(x: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Place of the nearest of ``entries`` for each row of ``x``, the first on ties, and its squared distance."""
    reach = int(np.abs(x).max(initial=0)) + int(np.abs(entries).max(initial=0))
    if x.shape[1] * reach * reach < EXACT:
        # whole numbers all the way, none of which double precision rounds
        a, b = x.astype(np.float64), entries.astype(np.float64)
        d = np.square(a).sum(axis=1)[:, None] + np.square(b).sum(axis=1) - 2 * (a @ b.T)
    else:
        d = np.stack([np.square(x - entry).sum(axis=1) for entry in entries], axis=1)
    best = d.argmin(axis=1)
    return best, d[np.arange(len(x)), best].astype(np.int64)


def summed(books: list[np.ndarray], size: int):
    """Count and sums of the vectors nearest to each entry; one row a task and entry in use."""

    def run(batches):
        count = [np.zeros(len(b), np.int64) for b in books]
        total = [np.zeros((len(b), size), np.int64) for b in books]
        for batch in batches:
            boxes = Boxes(batch, size)
            for k, part in enumerate(boxes.part):
                few = boxes.shortlist(k, books[part])
                if len(few) == 1:
                    count[part][few[0]] += boxes.n[k]
                    total[part][few[0]] += boxes.sums[k]
                    continue
                x = boxes.vectors(k)
                own = few[nearest(x, books[part][few])[0]]
                count[part] += np.bincount(own, minlength=len(books[part]))
                order = np.argsort(own, kind="stable")
                new = np.flatnonzero(C.starts(own[order]))
                total[part][own[order][new]] += np.add.reduceat(x[order], new, axis=0)
        for part, (n, t) in enumerate(zip(count, total, strict=True)):
            used = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(used), part, np.int32)), pa.array(used.astype(np.int32)), pa.array(n[used]), pa.array(t[used].tolist(), pa.list_(pa.int64()))],
                names=["part", "entry", "n", "sums"],
            )

    return run


def assigned(books: list[np.ndarray], size: int):
    """The entry of every part, and its squared distance."""

    def run(batches):
        for batch in batches:
            boxes = Boxes(batch, size)
            for k, part in enumerate(boxes.part):
                few = boxes.shortlist(k, books[part])
                best, error = nearest(boxes.vectors(k), books[part][few])
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(boxes.n[k], part, np.int32)), *[pa.array(np.frombuffer(batch.column(c)[k].as_py(), "<i8")) for c in ("ids", "names")],
                        batch.column("labels")[k].values, pa.array(few[best].astype(np.int32)), pa.array(error),
                    ],
                    names=["part", "id", "name", "label", "entry", "error"],
                )

    return run


def common_width(rows: DataFrame, parts: int) -> int | None:
    """The most frequent length that can be cut into ``parts``, the greater on ties."""
    n = rows.groupBy(F.size("vector").alias("width")).agg(F.count("*").alias("n"))
    found = n.where(f"width > 0 AND width % {parts} = 0").orderBy(F.desc("n"), F.desc("width")).first()
    return found and found["width"]


def first_entries(rows: DataFrame, entries: int) -> np.ndarray:
    """Vectors of the ``entries`` smallest ids, in their order; of rows that repeat an id, the smallest vector."""
    ids = [r["id"] for r in rows.select("id").where(F.col("id") != C.NO_ID).distinct().orderBy("id").limit(entries).collect()]
    if not ids:
        return np.zeros((0, 0))
    # as many rows as entries, of the given length
    found = rows.where(F.col("id") != C.NO_ID).where(F.col("id") <= ids[-1]).groupBy("id").agg(F.min("vector").alias("vector")).orderBy("id").collect()
    return np.array([r["vector"] for r in found], np.float64)


def encode(
    vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
    parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS,
) -> tuple[DataFrame, list[np.ndarray]]:
    """``id, label, codes, error`` for each vector, and the codebooks, one array of entries for each part.

    Components are rounded down to steps of 1 / 1024. Each codebook starts as the parts of the smallest ids; in each
    round every part goes to the nearest entry, the lower on ties, and entries in use become the mean of their parts,
    rounded down. ``codes`` are the entries after the last round, ``error`` the sum of squared distances.

    Vectors that are null or hold null or non-finite components are left out, and so are those with a component whose
    squares would not fit 64 bits (``largest``). Vectors of another length than the most frequent one that ``parts``
    divides come back with null codes and errors, and so do all if no row has an id. Rows that repeat an id are rows of
    their own and count as such, but start no second entry; a null id starts none. Other columns are not read. An empty table
    gives no rows and empty codebooks.
    """
    spark = vectors.sparkSession
    vector = F.col(vector_col).cast("array<double>")
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.select(C.key_of(id_col).alias("id"), F.col(label_col).alias("label"), vector.alias("vector")).where(F.col("vector").isNotNull() & finite)
    width = common_width(rows, parts)
    size = (width or parts) // parts
    kept = rows.where(F.forall("vector", lambda x: F.abs(x) < largest(size)))
    same = kept.where(F.size("vector") == (width or -1)).withColumn("name", F.xxhash64("vector", "label"))
    start = first_entries(same, entries)
    kind = rows.schema["label"].dataType
    label = kind.simpleString()
    null = [F.lit(None).cast("array<int>").alias("codes"), F.lit(None).cast("long").alias("error")]
    own = F.when(F.col("id") != C.NO_ID, F.col("id")).alias("id")
    if not len(start):
        return kept.select(own, "label", *null), [np.zeros((0, size), np.int64)] * parts
    books = list(np.floor(start * SCALE).astype(np.int64).reshape(len(start), parts, size).transpose(1, 0, 2))

    stats = {r["at"]: r for r in same.select("vector").mapInArrow(moments(width), "at int, n long, total double, squares double").groupBy("at").agg(
        F.sum("n").alias("n"), F.sum("total").alias("total"), F.sum("squares").alias("squares")).collect()}
    mean = np.array([stats[i]["total"] / stats[i]["n"] for i in range(width)])
    spread = np.sqrt(np.maximum(1, np.array([stats[i]["squares"] / stats[i]["n"] for i in range(width)]) - mean**2))
    placed = f"part int, place long, id long, name long, label {label}, components binary"
    # the grid of the curve reaches two standard deviations to each side
    dealt = same.mapInArrow(on_curve(width, parts, mean - 2 * spread, 4 * spread / (1 << CURVE_BITS)), placed)
    order = ["part", "place", "id", "name"]  # ids part what the curve cannot: many equal vectors
    n = max(1, C.shuffle_partitions(spark))
    sorted_parts = dealt.repartitionByRange(n, *order).sortWithinPartitions(*order)
    blocks = stored(sorted_parts.mapInArrow(blocked(size, to_arrow_type(kind)), BLOCKS.format(label)))

    for _ in range(rounds):
        found = blocks.mapInArrow(summed(books, size), "part int, entry int, n long, sums array<long>")
        totals = found.select("part", "entry", "n", F.posexplode("sums").alias("at", "total")).groupBy("part", "entry", "at").agg(
            F.sum("n").alias("n"), F.sum("total").alias("total"))
        books = [b.copy() for b in books]
        for r in totals.collect():  # parts x entries x size rows at most
            books[r["part"]][r["entry"], r["at"]] = r["total"] // r["n"]

    each = blocks.mapInArrow(assigned(books, size), f"part int, id long, name long, label {label}, entry int, error long")
    of = lambda p, c: F.max(F.when(F.col("part") == p, F.col(c))).alias(f"{c}{p}")
    coded = each.groupBy("id", "name").agg(
        F.min("label").alias("label"), F.count(F.when(F.col("part") == 0, 1)).cast("int").alias("times"),
        *[of(p, c) for p in range(parts) for c in ("entry", "error")],
    )
    total = sum((F.col(f"error{p}") for p in range(1, parts)), F.col("error0"))
    found = coded.select(own, "label", F.array(*[f"entry{p}" for p in range(parts)]).alias("codes"), total.alias("error"), F.explode(F.sequence(F.lit(1), "times")).alias("time"))
    others = kept.where(F.size("vector") != width).select(own, "label", *null)
    return found.drop("time").union(others), books


def digest(books: list[np.ndarray]) -> str:
    """SHA-256 of all components in decimal, by part, entry and position."""
    return hashlib.sha256(",".join(str(x) for book in books for x in book.ravel().tolist()).encode()).hexdigest()


def op11_vector_codes(spark, sf_dir: str) -> DataFrame:
    """Codes of all embeddings in four bytes, and the errors of rows and of labels."""
    coded, books = encode(C.table(spark, sf_dir, "embeddings"))
    rows = stored(coded)
    errors = broadcast_if_small(stored(rows.groupBy(F.col("label").alias("of")).agg(F.sum("error").alias("label_error"))))
    code = F.concat(*[F.lpad(F.lower(F.hex(F.col("codes")[p])), 2, "0") for p in range(PARTS)])
    return rows.join(errors, F.col("label").eqNullSafe(F.col("of"))).select(
        F.col("id").alias("vec_id"), code.alias("code"), "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256")
    )


def codes_sql(width: int = 64) -> str:
    """The rounds unrolled, for vectors of ``width``."""
    size = width // PARTS
    distance = " + ".join(f"(x[{i}] - c[{i}]) * (x[{i}] - c[{i}])" for i in range(1, size + 1))
    # a floor for negative sums too
    means = ", ".join(f"(s[{i}] - ((s[{i}] % n) + n) % n) // n" for i in range(1, size + 1))
    sums = ", ".join(f"sum(x[{i}])::BIGINT" for i in range(1, size + 1))
    steps = []
    for r in range(ROUNDS + 1):
        # distance and entry in one number: the least one is the nearest, the lower on ties
        steps.append(f"""a{r} AS MATERIALIZED (
            SELECT vec_id, p, min(({distance}) * {ENTRIES} + e) AS best, any_value(x) AS x FROM parts JOIN b{r} USING (p) GROUP BY vec_id, p)""")
        if r < ROUNDS:
            steps.append(f"""b{r + 1} AS MATERIALIZED (
            WITH t AS (SELECT p, best % {ENTRIES} AS e, count(*) AS n, [{sums}] AS s FROM a{r} GROUP BY 1, 2)
            SELECT b{r}.p, b{r}.e, CASE WHEN n IS NULL THEN c ELSE [{means}] END AS c FROM b{r} LEFT JOIN t ON t.p = b{r}.p AND t.e = b{r}.e)""")
    return f"""
        WITH kept AS (
            SELECT vec_id, label, [floor(x::DOUBLE * {SCALE})::BIGINT FOR x IN embedding] AS v FROM embeddings
            WHERE embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NOT NULL AND isfinite(x)]) = len(embedding)),
        parts AS MATERIALIZED (SELECT vec_id, p, v[p * {size} + 1:p * {size} + {size}] AS x FROM kept, range({PARTS}) t(p)),
        b0 AS MATERIALIZED (
            SELECT p, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS e, x AS c FROM parts
            WHERE vec_id IN (SELECT vec_id FROM kept ORDER BY vec_id LIMIT {ENTRIES})),
        {", ".join(steps)},
        coded AS (
            SELECT vec_id, string_agg(format('{{:02x}}', best % {ENTRIES}), '' ORDER BY p) AS code, sum(best // {ENTRIES})::BIGINT AS error
            FROM a{ROUNDS} GROUP BY vec_id),
        books AS (SELECT p, e, unnest(c) AS v, generate_subscripts(c, 1) AS i FROM b{ROUNDS})
        SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error,
               (SELECT sha256(string_agg(v::VARCHAR, ',' ORDER BY p, e, i)) FROM books) AS codebooks_sha256
        FROM coded JOIN kept USING (vec_id)"""


OP11_SQL = codes_sql()
