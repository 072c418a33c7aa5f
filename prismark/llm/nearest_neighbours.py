"""Approximate nearest neighbours by multi-index hashing.

Vectors become binary codes: directions are centred, rotated to principal axes and then by a learned rotation that brings
them close to the corners of a cube (fitted on a bounded sample), and each axis gives its sign. Codes are split into
substrings, each an index of its own. Two codes within a Hamming radius r have a substring within r // m (pigeonhole), so
probing all values that near in every substring's index retrieves every code within the radius; what is retrieved is
ranked by the cosine of the original vectors. The radius is that within which a bounded number of queries have their true
neighbours among all rows.

An index is dealt by the leading bits of its substring's value, as many as make groups of some BLOCK rows, and a query goes
to the groups with a value that near: the more rows, the more groups and the smaller the share that a query meets. In a group
rows are listed by the whole value of the substring, and a query takes the lists of those values that are that near. Groups
that are larger, of a dense cluster, are split, and copies of a vector beyond those that can be among the nearest are left
out. Queries that find less than they ask for are held against all rows, in blocks, with a radius that widens. Codes, not
vectors, decide what is compared.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from prismark.functions.trees import levels, merged
from prismark.llm.common import materialise

BITS, SUBSTRINGS = 64, 4
PART = BITS // SUBSTRINGS
#: Most rows that the rotation is fitted on, and most queries that the radius is fitted on.
SAMPLE, SAMPLE_QUERIES = 8_192, 256
#: Rows of a block of the index and of the queries.
BLOCK, QUERY_BLOCK = 16_384, 4_096
#: Share of the true neighbours that the radius must reach.
REACH = 0.95
RESULT = "query_id long, query_row long, vec_id long, row long, score double"


@dataclass(frozen=True)
class Coder:
    centre: np.ndarray
    rotation: np.ndarray

    def codes(self, x: np.ndarray) -> np.ndarray:
        x = x / np.sqrt((x * x).sum(axis=1))[:, None]
        bits = (x - self.centre) @ self.rotation > 0
        return np.packbits(bits, axis=1).view(">u8").astype(np.uint64)[:, 0]


def scaled(x: np.ndarray) -> np.ndarray:
    """Each row times a power of two, exactly, so that squares neither overflow nor vanish."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, keepdims=True))[1])


def hamming(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b)


def part(codes: np.ndarray, j: int) -> np.ndarray:
    """The codes' substring j."""
    return ((codes >> np.uint64(j * PART)) & np.uint64((1 << PART) - 1)).astype(np.uint16)


def part_radius(radius: int, j: int) -> int:
    """A code within the radius differs in so many bits of substring j at most, for one j: radius // m, or, behind the first radius % m + 1 substrings, one less."""
    return radius // SUBSTRINGS - (j > radius % SUBSTRINGS)


def fit(sample: np.ndarray, rounds: int = 30) -> Coder:
    """Centre and rotation from a sample of vectors (rows)."""
    rng = np.random.default_rng(64)
    x = sample / np.sqrt((sample * sample).sum(axis=1))[:, None]
    centre = x.mean(axis=0)
    d = x.shape[1]
    _, axes = np.linalg.eigh(np.cov((x - centre).T) if len(x) > 1 else np.eye(d))
    axes = np.atleast_2d(axes)[:, ::-1][:, : min(d, BITS)]
    projected = (x - centre) @ axes
    parts = []
    while sum(p.shape[1] for p in parts) < BITS:  # narrow vectors get several rotations
        r = np.linalg.qr(rng.normal(size=(axes.shape[1],) * 2))[0]
        for _ in range(rounds):
            u, _, v = np.linalg.svd(np.sign(projected @ r).T @ projected)
            r = (u @ v).T
        parts.append(axes @ r)
    return Coder(centre, np.concatenate(parts, axis=1)[:, :BITS])


class Postings:
    """Rows by the value of one substring of their codes."""

    def __init__(self, codes: np.ndarray, j: int):
        values = part(codes, j)
        self.rows = np.argsort(values, kind="stable")
        self.values, starts = np.unique(values[self.rows], return_index=True)
        self.starts, self.sizes = starts, np.diff(np.append(starts, len(values)))

    def near(self, value: np.uint16, radius: int) -> np.ndarray:
        """The rows with a value within the radius."""
        lists = np.flatnonzero(hamming(self.values, value) <= radius)
        sizes = self.sizes[lists]
        at = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(self.starts[lists], sizes)
        return self.rows[at]


class Block:
    """Some rows of an index, which queries are held against."""

    def __init__(self, vectors: np.ndarray, codes: np.ndarray):
        self.vectors, self.codes = vectors, codes
        self.norms = np.sqrt((vectors * vectors).sum(axis=1))
        self.postings: dict[int, Postings] = {}

    def within(self, code: np.uint64, radius: int, index: int | None = None) -> np.ndarray:
        """Rows whose code is within the radius: those that an index retrieves, each in the first index that does, or without an index all."""
        if index is None:
            return np.flatnonzero(hamming(self.codes, code) <= radius)
        if index not in self.postings:
            self.postings[index] = Postings(self.codes, index)
        rows = self.postings[index].near(part(code, index), part_radius(radius, index))
        rows = np.sort(rows[hamming(self.codes[rows], code) <= radius])
        for j in range(index):
            rows = rows[hamming(part(self.codes[rows], j), part(code, j)) > part_radius(radius, j)]
        return rows

    def nearest(self, vector: np.ndarray, code: np.uint64, radius: int, k: int, own: int, index: int | None) -> tuple[np.ndarray, np.ndarray]:
        """Rows and cosines of the best k candidates and their ties; for a block that all queries meet the radius widens until k are found or the block has no more."""
        while True:
            rows = self.within(code, radius, index)
            rows = rows[rows != own]
            if len(rows) >= k or radius >= BITS or index is not None:
                break
            radius += 4
        rough = (self.vectors[rows] @ vector) / self.norms[rows]
        if len(rows) > k:  # sums in another order may differ in the last places; those within 1e-9 are summed anew
            least = np.partition(rough, len(rough) - k)[len(rough) - k]
            rows = rows[rough >= least - 1e-9 * np.sqrt((vector * vector).sum())]
        score = (self.vectors[rows] * vector).sum(axis=1) / (self.norms[rows] * np.sqrt((vector * vector).sum()))
        return rows, score


def usable(v: Column) -> Column:
    """Not null, not zero, and all components finite."""
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return v.isNotNull() & finite & F.exists(v, lambda x: x != 0)


def _matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    n = len(column)
    return np.frombuffer(b"".join(column.to_pylist()), np.float64).reshape(n, -1) if n else np.zeros((0, 1))


def _lists(column: pa.Array) -> np.ndarray:
    return np.asarray(column.flatten(), np.float64).reshape(len(column), -1) if len(column) else np.zeros((0, 1))


def _coded(coder):
    """Rows with a number of their own, code, and scaled vector as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 36
        for batch in batches:
            n = batch.num_rows
            x = scaled(_lists(batch.column("v"))) if n else np.zeros((0, 1))
            codes = coder.value.codes(x).astype(np.int64) if n else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(row, row + n)), batch.column("id"), batch.column("asks"), pa.array(codes), pa.array([r.tobytes() for r in x], pa.binary())], ["row", "id", "asks", "code", "vector"])
            row += n

    return run


def fitted_radius(coded: DataFrame, k: int) -> int:
    """The radius within which SAMPLE_QUERIES rows at most, drawn by hash, have REACH of their true k nearest among all rows; one pass over these."""
    asked = coded.orderBy(F.xxhash64("row"), "row").limit(SAMPLE_QUERIES).select("row", "code", "vector").toArrow()
    shared = coded.sparkSession.sparkContext.broadcast((asked.column("row").to_numpy(), asked.column("code").to_numpy().astype(np.uint64), _unit(_matrix(asked.column("vector")))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, codes, x = shared.value
        best, far = np.full((len(x), k), -np.inf), np.full((len(x), k), BITS)
        for batch in batches:
            if not batch.num_rows:
                continue
            cosine = x @ _unit(_matrix(batch.column("vector"))).T
            rows = np.asarray(batch.column("row"))
            cosine[own[:, None] == rows[None, :]] = -np.inf
            distance = hamming(codes[:, None], np.asarray(batch.column("code")).astype(np.uint64)[None, :])
            both, dist = np.hstack([best, cosine]), np.hstack([far, distance])
            top = np.argpartition(-both, k - 1, axis=1)[:, :k]
            best, far = np.take_along_axis(both, top, axis=1), np.take_along_axis(dist, top, axis=1)
        yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([np.concatenate([best.ravel(), far.ravel()]).tobytes()], pa.binary())], ["part", "payload"])

    near = coded.select("row", "code", "vector")
    found = merged(near.mapInArrow(run, "part long, payload binary"), functools.partial(_best_parts, k=k), height=levels(near)).collect()
    shared.unpersist()
    best, far = np.frombuffer(found[0]["payload"], np.float64).reshape(2, -1) if found else np.zeros((2, 0))
    far = far[np.isfinite(best)]
    return int(np.quantile(far, REACH, method="higher")) if len(far) else BITS


def _best_parts(parts: list[np.ndarray], k: int) -> np.ndarray:
    """The k best (cosine, distance) of each query of several tasks' best."""
    both = np.concatenate([p.reshape(2, -1, k) for p in parts], axis=2)
    top = np.lexsort((both[1], -both[0]), axis=-1)[:, :k]
    return np.stack([np.take_along_axis(b, top, axis=1) for b in both]).ravel()


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.sqrt((x * x).sum(axis=1))[:, None]


def _search(k: int, radius: int, indexed: bool):
    def run(key, index: pa.Table, queries: pa.Table) -> pa.Table:
        out_q, out_qr, out_id, out_row, out_s = [], [], [], [], []
        if index.num_rows and queries.num_rows:
            codes = lambda t: t.column("code").to_numpy().astype(np.uint64)
            block, rows, ids = Block(_matrix(index.column("vector")), codes(index)), index.column("row").to_numpy(), index.column("id").to_pylist()
            place = {r: i for i, r in enumerate(rows.tolist())}
            rank = np.argsort(np.argsort([(2**63 - 1 if i is None else i) for i in ids], kind="stable"), kind="stable")
            j = key[0].as_py() if indexed else None
            for q, r, c, v in zip(queries.column("id").to_pylist(), queries.column("row").to_pylist(), codes(queries), _matrix(queries.column("vector")), strict=True):
                at, score = block.nearest(v, c, radius, k, place.get(r, -1), j)
                for i in np.lexsort((rank[at], -score))[:k]:
                    out_q.append(q)
                    out_qr.append(r)
                    out_id.append(ids[at[i]])
                    out_row.append(int(rows[at[i]]))
                    out_s.append(float(score[i]))
        return pa.table({"query_id": pa.array(out_q, pa.int64()), "query_row": pa.array(out_qr, pa.int64()), "vec_id": pa.array(out_id, pa.int64()), "row": pa.array(out_row, pa.int64()), "score": pa.array(out_s, pa.float64())})

    return run


KEPT = ("row", "id", "code", "vector")


def _own() -> list[Column]:
    """KEPT as columns of their own, so that queries are not taken for the index that they come from."""
    return [F.col(c).alias(c) for c in KEPT]


def _numbers(upto: Column) -> Column:
    return F.explode(F.sequence(F.lit(0).cast("long"), upto.cast("long") - 1))


def _parts(n: Column, size: int) -> Column:
    return F.greatest(F.lit(1), F.ceil(n / size)).cast("long")


def in_blocks(index: DataFrame, queries: DataFrame, n: int, q: int, k: int, radius: int) -> DataFrame:
    """Every query against every block of n rows."""
    blocks, query_blocks = -(-n // BLOCK), -(-q // QUERY_BLOCK)
    block, query_block = F.pmod(F.xxhash64("row"), F.lit(blocks)), F.pmod(F.xxhash64("row", F.lit(1)), F.lit(query_blocks))
    index = index.select(block.cast("long").alias("b"), _numbers(F.lit(query_blocks)).alias("q"), *KEPT)
    asking = queries.select(_numbers(F.lit(blocks)).alias("b"), query_block.cast("long").alias("q"), *_own())
    return index.groupBy("b", "q").cogroup(asking.groupBy("b", "q")).applyInArrow(_search(k, radius, False), RESULT)


def group_bits(n: int) -> int:
    """Leading bits of a substring that make groups of some BLOCK of n rows."""
    return min(PART, max(0, (-(-n // BLOCK) - 1).bit_length()))


def probed(radius: int, j: int, bits: int) -> list[int]:
    """What groups of index j a query meets: differences of the leading bits."""
    return [m for m in range(1 << bits) if m.bit_count() <= part_radius(radius, j)]


def in_groups(index: DataFrame, queries: DataFrame, n: int, k: int, radius: int) -> DataFrame:
    """Every query against the groups of each index that it probes."""
    bits = group_bits(n)
    group = lambda j: F.shiftrightunsigned("code", (j + 1) * PART - bits).bitwiseAND(F.lit((1 << bits) - 1))
    each = F.explode(F.array(*[F.struct(F.lit(j).cast("long").alias("j"), group(j).cast("long").alias("g")) for j in range(SUBSTRINGS)])).alias("e")
    tables = F.array(*[F.lit(probed(radius, j, bits)).cast("array<long>") for j in range(SUBSTRINGS)])
    index = index.select(*KEPT, each).select("e.j", "e.g", *KEPT)
    asking = queries.select(*_own(), each).select("e.j", "e.g", *KEPT)
    asking = asking.withColumn("m", F.explode(F.get(tables, F.col("j").cast("int")))).select("j", F.col("g").bitwiseXOR(F.col("m")).alias("g"), *KEPT)
    # At most SUBSTRINGS << PART groups, with their numbers of rows and queries: those that are too large are split.
    parts = index.groupBy("j", "g").agg(_parts(F.count("*"), BLOCK).alias("parts"))
    query_parts = asking.groupBy("j", "g").agg(_parts(F.count("*"), QUERY_BLOCK).alias("query_parts"))
    split = F.broadcast(materialise(parts.join(query_parts, ["j", "g"]), "groups"))
    of = lambda by, seed: F.pmod(F.xxhash64("row", F.lit(seed)), F.col(by)).cast("long")
    index = index.join(split, ["j", "g"]).select("j", "g", of("parts", 0).alias("p"), _numbers(F.col("query_parts")).alias("q"), *KEPT)
    asking = asking.join(split, ["j", "g"]).select("j", "g", _numbers(F.col("parts")).alias("p"), of("query_parts", 1).alias("q"), *KEPT)
    keys = ("j", "g", "p", "q")
    return index.groupBy(*keys).cogroup(asking.groupBy(*keys)).applyInArrow(_search(k, radius, True), RESULT)


def without_surplus(coded: DataFrame, k: int) -> DataFrame:
    """coded without copies of a vector that are never among the k nearest, as k + 1 copies with smaller ids are there."""
    key = [F.xxhash64("vector").alias("h1"), F.xxhash64(F.lit(1), "vector").alias("h2")]
    order = Window.partitionBy("h1", "h2", "code").orderBy(F.asc_nulls_last("id"), "row")
    many = coded.select(*key, "code").groupBy("h1", "h2", "code").count().where(F.col("count") > k + 1).drop("count")
    ranked = coded.select(*key, "code", "id", "row").join(many, ["h1", "h2", "code"], "left_semi").withColumn("r", F.row_number().over(order)).where(F.col("r") <= k + 1)
    many = materialise(many, "copied")
    if many.isEmpty():
        return coded
    stays = materialise(ranked.select("row"), "staying")
    keyed = coded.withColumns({"h1": F.xxhash64("vector"), "h2": F.xxhash64(F.lit(1), "vector")})
    one = keyed.join(many, ["h1", "h2", "code"], "left_anti").select(*coded.columns)
    return one.unionByName(coded.join(stays, "row", "left_semi").select(*coded.columns))


def best_of(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id", "query_row").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"), "row")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def search(vectors: DataFrame, is_query: Column, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): for each row where is_query holds its k nearest other rows found, by cosine in double precision.

    Nearest first, ties to the smaller id (null ids last). Vectors that are null, zero or hold null or non-finite components
    take no part, nor do those of another length than most have. Every usable row is in the index. Repeated rows are
    candidates of each other. With k or fewer candidates all are returned. An empty table gives no rows; other columns are
    not read but for is_query.
    """
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"), F.coalesce(is_query, F.lit(False)).alias("asks")).where(usable(F.col("v")))
    sizes = rows.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n"), F.sum(F.col("asks").cast("long")).alias("q")).orderBy(F.desc("n"), "d").first()
    spark = vectors.sparkSession
    if sizes is None or not sizes["q"]:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    rows = rows.where(F.size("v") == sizes["d"])
    draw = F.xxhash64("id", "v")
    sample = rows.where(F.abs(draw / F.lit(2.0**63)) <= SAMPLE / sizes["n"]).orderBy(draw).limit(SAMPLE).select("v").toArrow().column("v").combine_chunks()
    if not len(sample):
        sample = rows.orderBy(draw).limit(SAMPLE).select("v").toArrow().column("v").combine_chunks()
    coder = spark.sparkContext.broadcast(fit(scaled(np.asarray(sample.flatten(), np.float64).reshape(-1, sizes["d"]))))

    coded = materialise(rows.select("id", "asks", "v").mapInArrow(_coded(coder), "row long, id long, asks boolean, code long, vector binary"), "codes")
    coder.unpersist()
    radius, n, q = fitted_radius(coded, k), sizes["n"], sizes["q"]
    index, asking = without_surplus(coded, k), coded.where("asks")
    found = materialise(best_of(in_groups(index, asking, n, k, radius), k).drop("rank"), "found")
    enough = found.groupBy(F.col("query_row").alias("row")).count().where(F.col("count") >= min(k, n - 1))
    rest = materialise(asking.join(enough, "row", "left_anti").select(*coded.columns), "rest")
    if left := rest.count():
        found = found.join(rest.select(F.col("row").alias("query_row")), "query_row", "left_anti").unionByName(in_blocks(index, rest, n, left, k, radius))
    return best_of(found, k).select("query_id", "rank", "vec_id", "score")
