"""Operator 13, centroid clustering of integer vectors (Lloyd's rounds).

Vectors are stored once, in blocks of some thousand, as matrices of the smallest integers that hold them. A round is one pass over the blocks: squared distances to all
centroids are |x|² - 2 x·c + |c|², one matrix product a block, in float64 where every term is below 2^53 and so exact, else in 64-bit integers, else in Python's. Sums and counts
of the clusters are combined by treeAggregate; the driver gets one vector for each centroid and round.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, map_arrow, remove_folder, shared_folder, without_shuffles

CLUSTERS, ROUNDS, PARTS, SCALE, SEED = 8, 10, 64, 1024, 3
#: Vectors of a block.
BLOCK = 4096
_LONG = 2**63
_BLOCKS = "ids binary, nulls binary, kind string, data binary"
_SCHEMA = pa.schema([("ids", pa.binary()), ("nulls", pa.binary()), ("kind", pa.string()), ("data", pa.binary())])


def to_block(matrix: np.ndarray) -> tuple[str, bytes]:
    """A matrix of whole doubles as the smallest integers that hold it; of larger ones, as the doubles themselves."""
    most = np.abs(matrix).max(initial=0)
    kind = next((k for k, bits in (("<i2", 15), ("<i4", 31), ("<i8", 63)) if most < 2.0**bits), "<f8")
    return kind, matrix.astype(kind).tobytes()


def from_block(kind: str, data: bytes, parts: int) -> np.ndarray:
    """A block's integers, as Python's where 64 bits don't hold them."""
    values = np.frombuffer(data, kind)
    if kind == "<f8":
        values = np.array([int(x) for x in values], object)
    return values.reshape(-1, parts)


def distances(x: np.ndarray, centroids: list[list[int]]) -> np.ndarray:
    """Exact squared distances of the rows of x to all centroids, as doubles, 64-bit integers or Python's, whichever hold every term."""
    size = lambda rows: max((abs(int(v)) for v in rows), default=0)
    most = (0 if not x.size else max(int(x.max()), -int(x.min()))) + size(v for c in centroids for v in c)
    # no partial sum of |x|², 2 x·c or |c|² passes this bound, in whatever order a product adds up
    bound = x.shape[1] * most * most
    kind = np.float64 if bound < 2**53 else np.int64 if bound < _LONG else object
    a, c = x.astype(kind), np.array(centroids, dtype=kind)
    return (a * a).sum(1)[:, None] - 2 * (a @ c.T) + (c * c).sum(1)[None, :]


def nearest(x: np.ndarray, centroids: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centroid of each row, the first of equally near ones, and its squared distance."""
    far = distances(x, centroids)
    best = np.array([min(range(len(centroids)), key=row.__getitem__) for row in far], np.int64) if far.dtype == object else far.argmin(1)
    return best, far[np.arange(len(far)), best]


def _sums(x: np.ndarray, best: np.ndarray, clusters: int) -> list[tuple[int, list[int]]]:
    """(count, componentwise sum) of each cluster."""
    out = []
    for k in range(clusters):
        own = x[best == k]
        if own.dtype == object or (len(own) and len(own) * max(int(own.max()), -int(own.min())) >= _LONG):
            own = own.astype(object)
        else:
            own = own.astype(np.int64)
        out.append((len(own), [int(v) for v in own.sum(0)] if len(own) else [0] * x.shape[1]))
    return out


def _added(a: list, b: list) -> list:
    if not a or not b:
        return a or b
    return [(n + m, [x + y for x, y in zip(s, t, strict=True)]) for (n, s), (m, t) in zip(a, b, strict=True)]


def _to_blocks(parts: int):
    """(id, vector) rows to blocks. An id that is null is told by a byte."""

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                piece = batch.slice(at, BLOCK)
                ids = piece.column(0)
                matrix = piece.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, parts)
                kind, data = to_block(matrix)
                yield pa.RecordBatch.from_pydict({"ids": [ids.fill_null(0).to_numpy().tobytes()], "nulls": [ids.is_null().to_numpy(zero_copy_only=False).tobytes()], "kind": [kind], "data": [data]}, _SCHEMA)

    return blocks


def usable(df: DataFrame, id_col: str, vector_col: str, parts: int, scale: int) -> DataFrame:
    """(id, x) of the vectors with exactly so many components, none null or non-finite; x has floor(scale * component), as doubles."""
    # Spark's floor of a double is a 64-bit integer; this one stays a double
    floor = lambda x: F.rint(x) - F.when(F.rint(x) > x, 1.0).otherwise(0.0)
    sized = df.select(F.col(id_col).cast("long").alias("id"), F.transform(vector_col, lambda x: x.cast("double") * scale).alias("v")).where(F.size("v") == parts)
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return sized.where(finite).select("id", F.transform("v", floor).alias("x"))


def _fits(n: int) -> int | None:
    return n if n < _LONG else None


def _assigned(parts: int, centroids: list[list[int]]):
    """Blocks to (id, cluster, distance)."""

    def assigned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, nulls, kind, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                best, far = nearest(from_block(kind, data, parts), centroids)
                numbers = pa.array(np.frombuffer(ids, np.int64), mask=np.frombuffer(nulls, bool))
                yield pa.RecordBatch.from_arrays([numbers, pa.array(best.astype(np.int32)), pa.array([_fits(int(d)) for d in far], pa.int64())], ["vec_id", "cluster", "distance"])

    return assigned


def cluster(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", clusters: int = CLUSTERS, rounds: int = ROUNDS, parts: int = PARTS, scale: int = SCALE, seed: int = SEED) -> DataFrame:
    """One row for each usable vector: vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256.

    A vector is usable if it has exactly ``parts`` components, none of which is null, non-finite, or so large that its product with ``scale`` is no finite double. Centroids start
    as those vectors whose digest of seed and id is least (of rows that share an id, those with the smaller vector); fewer vectors than clusters make fewer clusters. Each round assigns every
    vector to the nearest centroid (of equally near ones, that with the smaller number) and moves centroids to the floor of the exact mean; a centroid without
    vectors stays. Rounds end early where nothing moves, as no later one would move anything.

    All is exact at any magnitude; a squared distance or sum of them over 2^63 - 1 is null in the result. Null ids count as empty text in the digest; repeated rows count again;
    other columns, of any name, are not read; an empty table gives an empty table. The driver holds ``clusters`` centroids.
    """
    spark = df.sparkSession
    folder = f"{shared_folder(spark)}/vectors-{uuid.uuid4().hex}"
    vectors = usable(df, id_col, vector_col, parts, scale)
    with without_shuffles(spark):
        map_arrow(vectors, _to_blocks(parts), _BLOCKS).write.parquet(folder)
    blocks = spark.read.schema(_BLOCKS).parquet(folder)
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256)
    centroids = [[int(v) for v in r.x] for r in vectors.orderBy(digest, "x").select("x").limit(clusters).collect()]
    matrices = blocks.select("kind", "data").rdd.map(lambda r: from_block(r.kind, r.data, parts))
    k = len(centroids)
    for _ in range(rounds if k else 0):
        found = matrices.map(lambda x, c=centroids: _sums(x, nearest(x, c)[0], k)).treeAggregate([], _added, _added)
        moved = [[v // n for v in s] if n else c for (n, s), c in zip(found, centroids, strict=True)]
        if moved == centroids:
            break
        centroids = moved

    def inertia(x: np.ndarray) -> list:
        best, far = nearest(x, centroids)
        return [(int((best == i).sum()), [sum(int(d) for d in far[best == i])]) for i in range(k)]

    totals = [s[0] for _, s in matrices.map(inertia).treeAggregate([], _added, _added)] if k else []
    out = checkpointed(map_arrow(blocks, _assigned(parts, centroids), "vec_id long, cluster int, distance long"))
    remove_folder(spark, folder)
    of = [(i, _fits(totals[i]), _fits(sum(totals)), hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()) for i, c in enumerate(centroids)]
    # one row a cluster
    return out.join(F.broadcast(spark.createDataFrame(of, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _oracle() -> str:
    """The rounds one after another, over rows (r, v) and (k, v); for tables that one machine holds."""
    far = "list_sum(list_transform(list_zip(x.v, c.v), lambda p: (p[1] - p[2])::HUGEINT * (p[1] - p[2])))"
    sql = f"""WITH x AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda e: floor({SCALE} * e::DOUBLE)::BIGINT) AS v FROM embeddings
 WHERE len(embedding) = {PARTS} AND len(list_filter(embedding, lambda e: e IS NOT NULL AND isfinite(e))) = {PARTS}),
c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('{SEED}:' || coalesce(vec_id::VARCHAR, '')), v) - 1 AS k, v FROM x QUALIFY k < {CLUSTERS})"""
    for i in range(ROUNDS + 1):
        sql += f", a{i} AS MATERIALIZED (SELECT x.r, x.vec_id, x.v, c.k, {far} AS d FROM x, c{i} c QUALIFY row_number() OVER (PARTITION BY x.r ORDER BY d, c.k) = 1)"
        if i < ROUNDS:
            sql += f""", s{i} AS (SELECT k, j, sum(e) AS s, count(*) AS n FROM (SELECT k, unnest(range(1, {PARTS + 1})) AS j, unnest(v) AS e FROM a{i}) GROUP BY ALL),
m{i} AS (SELECT k, list(((s - ((s % n) + n) % n) // n)::BIGINT ORDER BY j) AS v FROM s{i} GROUP BY k),
c{i + 1} AS MATERIALIZED (SELECT c.k, coalesce(m.v, c.v) AS v FROM c{i} c LEFT JOIN m{i} m ON c.k = m.k)"""
    return f"""{sql} SELECT a.vec_id, a.k::INTEGER AS cluster, a.d::BIGINT AS distance, (sum(a.d) OVER (PARTITION BY a.k))::BIGINT AS cluster_inertia, (sum(a.d) OVER ())::BIGINT AS inertia,
 sha256(array_to_string(c.v, ',')) AS centroid_sha256 FROM a{ROUNDS} a JOIN c{ROUNDS} c ON a.k = c.k"""


ORACLE = _oracle()
