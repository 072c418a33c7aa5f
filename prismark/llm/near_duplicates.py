"""MinHash near-duplicates with min-max hashing.

Each permutation gives two values of a document's signature, the minimum and the maximum over its shingles, so a
signature of 2p values costs p hash evaluations. Bands of four values (two permutations) make the candidates.

1. Documents with the same set of shingles are one class; from here on a class is one node with a number of its own.
2. Classes that share a bucket of a band are candidates. Buckets are never expanded into all pairs: their members are held
   against a hub, the one with the fewest shingles of its own, and what is confirmed is joined to components.
3. Only buckets whose members still lie in several components are looked at again, with two other hubs at once, and at last
   pair by pair across components; what is confirmed there links components, not classes. Two members share at most the
   smaller of what each shares with the hub, and the smaller of what each shares with others besides; in a group of edited
   copies that alone, exactly, rules out nearly all pairs. Sizes and one-bit sketches rule out more.
4. Every link is confirmed on the full sets of shingles.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from prismark.llm.common import materialise
from prismark.llm.components import components
from prismark.llm.wordhash import WordHashes, runs

PERMUTATIONS, BAND_VALUES = 48, 4
BANDS = 2 * PERMUTATIONS // BAND_VALUES
#: Other hubs of a bucket that members of other components are held against before the pairs that are left are compared one by one.
MORE_HUBS = 2
#: Shingles that are hashed at once.
BLOCK = 65_536


def shingle_set(text: str, hashes: WordHashes, k: int) -> np.ndarray:
    """Sorted distinct hashes of a text's k-word shingles; words are runs of characters other than space and \\t\\n\\v\\f\\r, A-Z in lower case."""
    words = hashes.of(text.encode("utf-8", "surrogatepass").lower().split())
    if not len(words):
        return np.zeros(0, np.uint64)
    return np.unique(runs(words, min(k, len(words))))


def _family() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20_11)
    a = rng.integers(0, 1 << 63, PERMUTATIONS, np.uint64) * np.uint64(2) + np.uint64(1)
    return a[:, None], rng.integers(0, 1 << 63, PERMUTATIONS, np.uint64)[:, None]


def min_max(shingles: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The signature: minimum and maximum under each permutation, next to each other, as 32-bit values."""
    low, high = np.full(len(a), 2**64 - 1, np.uint64), np.zeros(len(a), np.uint64)
    for i in range(0, len(shingles), BLOCK):
        h = shingles[None, i : i + BLOCK] * a + b
        np.minimum(low, h.min(axis=1), out=low)
        np.maximum(high, h.max(axis=1), out=high)
    both = np.stack([low, high], axis=1).reshape(-1)
    both = both * np.uint64(0x9E3779B97F4A7C15)
    return (both >> np.uint64(32)).astype("<u4")


def signatures(docs: DataFrame, k: int, keep: list[str]) -> DataFrame:
    """(row, id, keep, n, set_key, sig, s1, s2): a number for the row, size and digest of the set, signature, and one bit of each value in two longs; null where there are no words."""
    fields = "".join(f"`{c}` {docs.schema[c].dataType.simpleString()}, " for c in keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, (a, b) = WordHashes(), _family()
        weights = (np.uint64(1) << np.arange(PERMUTATIONS, dtype=np.uint64))[None, :]
        row = TaskContext.get().partitionId() << 36
        for batch in batches:
            sizes, keys, sigs = [], [], []
            for text in batch.column("text").to_pylist():
                s = shingle_set(text, hashes, k)
                sizes.append(len(s))
                keys.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
                sigs.append(min_max(s, a, b) if len(s) else np.zeros(2 * PERMUTATIONS, "<u4"))
            bits = (np.stack(sigs) & 1).astype(np.uint64) if sigs else np.zeros((0, 2 * PERMUTATIONS), np.uint64)
            s1, s2 = ((bits[:, i::2] * weights).sum(axis=1).astype(np.int64) for i in (0, 1))
            rows = pa.array(np.arange(row, row + len(sizes)))
            row += len(sizes)
            yield pa.RecordBatch.from_arrays(
                [rows, *(batch.column(c) for c in ["id", *keep]), pa.array(sizes, pa.int64()), pa.array(keys, pa.binary()), pa.array([x.tobytes() for x in sigs], pa.binary()), pa.array(s1), pa.array(s2)],
                ["row", "id", *keep, "n", "set_key", "sig", "s1", "s2"],
            )

    return docs.select("id", *keep, "text").mapInArrow(run, f"row long, id long, {fields}n long, set_key binary, sig binary, s1 long, s2 long")


def _counted(pairs: DataFrame, sets: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """(a, b, keep, n_a, n_b, both) for pairs (a, b): sizes of the full sets and of their intersection; keep: further longs of the pairs."""
    own = ["a", "b", *keep]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = []
            for x, y in zip(batch.column("x"), batch.column("y"), strict=True):
                x, y = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
                sizes.append((len(x), len(y), len(np.intersect1d(x, y, assume_unique=True))))
            n = np.array(sizes, np.int64).reshape(-1, 3)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in own), *(pa.array(n[:, i]) for i in range(3))], [*own, "n_a", "n_b", "both"])

    full = pairs.join(sets.select(F.col("id").alias("a"), F.col("shingles").alias("x")), "a").join(sets.select(F.col("id").alias("b"), F.col("shingles").alias("y")), "b")
    return full.select(*own, "x", "y").mapInArrow(run, ", ".join(f"{c} long" for c in [*own, "n_a", "n_b", "both"]))


def _links(counted: DataFrame, percent: int, a: str = "a", b: str = "b") -> DataFrame:
    return counted.where(100 * F.col("both") >= percent * (F.col("n_a") + F.col("n_b") - F.col("both"))).select(a, b)


@functools.lru_cache
def sketch_limit(percent: int, chance: float = 1e-8) -> int:
    """Differing bits of two sketches that a pair at the threshold does not exceed but for the chance (the exact binomial tail)."""
    p, n = (1 - percent / 100) / 2, 2 * PERMUTATIONS
    tail, d = 0.0, n
    while d and tail + (one := math.comb(n, d) * p**d * (1 - p) ** (n - d)) <= chance:
        tail += one
        d -= 1
    return d


def near_duplicates(docs: DataFrame, percent: int = 80, words: int = 5, id_col: str = "doc_id", text_col: str = "text", by_row: bool = False, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per row of docs: id_col (long), keep, n_shingles, component_id (the smallest id reachable over links), kept (id = component_id).

    Linked are documents whose sets of shingles (runs of `words` words; fewer words are one shingle) have a similarity of
    `percent` or more. A null text, or one without words, has n_shingles 0 and links with nothing. Rows with a null id
    link with nothing, have a null component_id and are kept. Rows that share an id are one document: what links with one
    of them is linked with all, and all are kept or none. Other columns are not read. An empty table gives no rows.

    by_row: each row with an id is a document of its own. Rows are not linked by their ids, and of each component one row is
    kept, of the smallest id.
    """
    carried = [f"keep{i}" for i in range(len(keep))]
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), *[F.col(c).alias(k) for c, k in zip(keep, carried, strict=True)])
    sigs = materialise(signatures(rows, words, carried), "signatures")
    named = sigs.where("n > 0 and id is not null")
    first = named.groupBy("set_key").agg(F.min(F.struct(F.col("id").alias("first_id"), "row", "n", "s1", "s2", "sig")).alias("c"))
    classes = materialise(first.select("set_key", F.monotonically_increasing_id().alias("id"), "c.*"), "classes")

    width = 4 * BAND_VALUES
    slices = F.array(*[F.xxhash64(F.lit(i), F.substring("sig", 1 + i * width, width)) for i in range(BANDS)])
    bands = classes.select("id", F.explode(slices).alias("bucket"))
    several = bands.groupBy("bucket").agg(F.min("id").alias("lo"), F.max("id").alias("hi")).where("lo != hi").select("bucket")
    members = materialise(bands.join(several, "bucket", "left_semi"), "members")

    # Sets of all that share a bucket with another class, once for all rounds.
    shared = members.select("id").distinct().join(classes.select("id", "set_key", "first_id"), "id")
    texts = shared.select(F.col("first_id").alias("wanted")).distinct()
    made = _sets(rows.join(texts, F.col("id") == F.col("wanted"), "left_semi"), words)
    sets = materialise(made.join(shared.select("set_key", "id"), "set_key").dropDuplicates(["id"]).select("id", "shingles"), "sets")

    # common: shingles that another candidate has too. With less than the threshold's share of them a class has no link.
    sizes = classes.select("id", "n", "s1", "s2", slices.alias("bands")).join(sets.select("id"), "id", "left_semi")
    sizes = sizes.join(_own(sets), "id", "left").withColumn("common", F.col("n") - F.coalesce("own", F.lit(0))).drop("own")
    sizes = materialise(sizes.where(100 * F.col("common") >= percent * F.col("n")), "sizes")
    members = materialise(members.join(sizes.select("id", "n", "common"), "id"), "candidates")

    # Each member against its bucket's hub: how much they share (met), and what it shares with others besides (apart).
    hub = F.struct(F.floor(20 * (F.col("n") - F.col("common")) / F.col("n")).alias("own"), F.xxhash64("id"), F.col("id").alias("hub"))
    hubs = members.groupBy("bucket").agg(F.min(hub)["hub"].alias("hub"), F.count("*").alias("k")).where("k > 1").select("bucket", "hub")
    members = materialise(members.join(hubs, "bucket"), "members")
    tested = [materialise(members.where("id != hub").select(F.col("id").alias("a"), F.col("hub").alias("b")).distinct(), "tested")]
    counted = materialise(_counted(tested[0], sets), "counted")
    links = _links(counted, percent)
    labels = components(links if by_row else links.unionByName(_of_one_id(named, classes)))
    met = counted.select(F.col("a").alias("id"), F.col("b").alias("hub"), "both")
    members = members.join(met, ["id", "hub"], "left").withColumn("met", F.coalesce("both", "n")).drop("both", "hub")
    members = members.withColumn("apart", F.greatest(F.lit(0), F.col("common") - F.col("met")))
    # c: the component so far; a class without a link is one of its own.
    members = members.join(labels, "id", "left").withColumn("c", F.coalesce("component", "id")).drop("component")
    members = materialise(members, "members")
    ends = labels.select("id", F.col("component").alias("c")).unionByName(members.select("id", "c")).distinct()

    def possible(x: str, y: str) -> Column:
        """Whether a link between two members of a bucket is possible."""
        least = lambda c: F.least(f"{c}_{x}", f"{c}_{y}")
        most = F.least(least("common"), least("met") + least("apart"))
        return 100 * most >= percent * (F.col(f"n_{x}") + F.col(f"n_{y}") - most)

    def pair(x: str, y: str) -> list:
        return [F.least(x, y).alias("a"), F.greatest(x, y).alias("b")]

    def moved(rows: DataFrame, moves: DataFrame) -> DataFrame:
        """rows with the component that moves, of components by number, have for c."""
        to = moves.select(F.col("id").alias("c"), F.col("component").alias("to"))
        return rows.join(to, "c", "left").withColumn("c", F.coalesce("to", "c")).drop("to")

    known_of = ("n", "common", "met", "apart")
    both_of = [F.least("c_x", "c_y").alias("c_a"), F.greatest("c_x", "c_y").alias("c_b")]
    for last in (False, True):
        several = members.groupBy("bucket").agg(F.min("c").alias("c0"), F.max("c").alias("c1"), *([] if last else [_hub(turn, known_of) for turn in range(MORE_HUBS)])).where("c0 != c1")
        if not last:  # other hubs of each bucket against the members of other components
            hubs = several.select("bucket", F.explode(F.array(*[f"hub{turn}" for turn in range(MORE_HUBS)])).alias("h"))
            hubs = hubs.select("bucket", F.col("h.id").alias("id_y"), "h.c_y", *[f"h.{k}_y" for k in known_of])
            faced = members.select("bucket", F.col("id").alias("id_x"), F.col("c").alias("c_x"), *[F.col(k).alias(f"{k}_x") for k in known_of]).join(hubs, "bucket")
            pairs = faced.where((F.col("c_x") != F.col("c_y")) & possible("x", "y"))
        else:  # whatever is left, pair by pair across components; a pair in the first bucket that it shares
            left = members.join(several.select("bucket"), "bucket", "left_semi").join(sizes.select("id", "s1", "s2", "bands"), "id")
            left = materialise(left, "left")
            x, y = (left.select("bucket", *[F.col(c).alias(f"{c}_{s}") for c in ("id", "c", "s1", "s2", "bands", *known_of)]) for s in "xy")
            bits = F.bit_count(F.col("s1_x").bitwiseXOR(F.col("s1_y"))) + F.bit_count(F.col("s2_x").bitwiseXOR(F.col("s2_y")))
            first = F.get(F.array_compact(F.zip_with("bands_x", "bands_y", lambda p, q: F.when(p == q, p))), 0)
            near = (x["bucket"] == y["bucket"]) & F.expr("c_x < c_y") & possible("x", "y") & (bits <= sketch_limit(percent)) & (first == x["bucket"])
            pairs = x.join(y, near)
        pairs = pairs.select(*pair("id_x", "id_y"), *both_of).groupBy("a", "b").agg(F.min("c_a").alias("c_a"), F.min("c_b").alias("c_b"))
        old = functools.reduce(DataFrame.unionByName, [t.select(*pair("a", "b")) for t in tested])
        pairs = materialise(pairs.join(old, ["a", "b"], "left_anti"), "tested")
        if pairs.isEmpty():
            continue
        tested.append(pairs)
        found = materialise(_links(_counted(pairs, sets, ("c_a", "c_b")), percent, "c_a", "c_b"), "links")
        if not found.isEmpty():
            moves = components(found, "c_a", "c_b")
            members, ends = members if last else materialise(moved(members, moves), "members"), moved(ends, moves)
    labels = ends.withColumnRenamed("c", "component")

    # What a class has in common with its component: the first row of all.
    head = F.struct(F.col("first_id").alias("component_id"), F.col("row").alias("first_row"))
    own = classes.select("set_key", "id", head.alias("head")).join(labels, "id", "left")
    best = own.where("component is not null").groupBy("component").agg(F.min("head").alias("best"))
    known = own.join(best, "component", "left").select("set_key", F.coalesce("best", "head").alias("head")).select("set_key", "head.*")
    out = sigs.select("row", "id", *carried, "n", "set_key").join(known, "set_key", "left")
    component = F.when(F.col("id").isNotNull(), F.coalesce("component_id", "id"))
    stays = F.when(F.col("id").isNotNull(), F.col("row") == F.col("first_row") if by_row else F.col("id") == component)
    return out.select(
        F.col("id").alias(id_col),
        *[F.col(k).alias(c) for c, k in zip(keep, carried, strict=True)],
        F.col("n").alias("n_shingles"),
        component.alias("component_id"),
        F.coalesce(stays, F.lit(True)).alias("kept"),
    )


def _hub(turn: int, known_of: tuple[str, ...]) -> Column:
    """Any member of a bucket, another one in each turn, with all that is known of it."""
    fields = [F.xxhash64("id", F.lit(turn + 1)).alias("_"), "id", F.col("c").alias("c_y"), *[F.col(k).alias(f"{k}_y") for k in known_of]]
    return F.min(F.struct(*fields)).alias(f"hub{turn}")


def _of_one_id(named: DataFrame, classes: DataFrame) -> DataFrame:
    """(a, b): links between the classes of rows that share an id."""
    several = named.groupBy("id").agg(F.min("set_key").alias("k0"), F.max("set_key").alias("k1")).where("k0 != k1").select("id")
    held = named.select("id", "set_key").join(several, "id", "left_semi").distinct()
    nodes = held.withColumnRenamed("id", "of").join(classes.select("set_key", "id"), "set_key")
    return nodes.join(nodes.groupBy("of").agg(F.min("id").alias("b")), "of").where("id != b").select(F.col("id").alias("a"), "b")


def _own(sets: DataFrame) -> DataFrame:
    """(id, own): shingles of each set that no other set has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, value in zip(batch.column("id").to_pylist(), batch.column("shingles"), strict=True):
                s = np.frombuffer(value.as_buffer(), np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(s), pa.array(np.full(len(s), key, np.int64))], ["shingle", "id"])

    flat = sets.select("id", "shingles").mapInArrow(run, "shingle long, id long")
    alone = flat.groupBy("shingle").agg(F.min("id").alias("id"), F.count("*").alias("n")).where("n = 1")
    return alone.groupBy("id").agg(F.count("*").alias("own"))


def _sets(rows: DataFrame, k: int) -> DataFrame:
    """(set_key, shingles): the full sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            found = [shingle_set(t, hashes, k).tobytes() for t in batch.column("text").to_pylist()]
            keys = [xxhash.xxh3_128_digest(s) for s in found]
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(found, pa.binary())], ["set_key", "shingles"])

    return rows.select("text").mapInArrow(run, "set_key binary, shingles binary")
