"""Lines that many documents share, dropped by a sharded minimal perfect hash.

The distinct hashes of lines are counted, and those of lines in enough documents are dealt over shards by hash. A shard's
minimal perfect hash gives each of its n hashes a place 0 .. n - 1: at each level the hashes that still have none are
thrown into a bit array, those that meet no other keep their bit, the rest goes a level up; the place is the rank of the bit.
At its place each hash has a fingerprint, the number of documents with the line, and the document that keeps it. Documents
probe these arrays with the hashes of their lines; lines are joined with nothing, and a line that is in no shard is told
by its fingerprint.

While all arrays take ARRAY_BYTES at most, they are sent to the tasks. Beyond that the hashes of lines go to their
shard's arrays (those that may be listed, by a bitmap of fixed size), and only documents that lose lines meet what was found.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from prismark.llm.common import apart, materialise
from prismark.llm.wordhash import mixed

#: What is stripped from the ends of a line's key.
BLANK = " \t\n\v\f\r"
#: Hashes of a shard, on average, and most bytes of arrays that are sent to every task.
SHARD_LINES, ARRAY_BYTES = 1 << 16, 48 << 20
#: Bits of a level for each hash that comes to it, and probes of a shard that one task takes.
SPARSE, PROBES = 2, 1 << 20
_STEP = np.uint64(0x9E3779B97F4A7C15)
_ONE, _63 = np.uint64(1), np.uint64(63)


def line_hash(line: str, min_chars: int) -> bytes | None:
    """128 bits of a line's key, or None if that is too short."""
    key = line.strip(BLANK)
    return xxhash.xxh3_128_digest(key.encode("utf-8", "surrogatepass").lower()) if len(key) >= min_chars else None


def halves(digests: list[bytes]) -> np.ndarray:
    """Two columns of 64 bits."""
    return np.frombuffer(b"".join(digests), np.uint64).reshape(-1, 2)


def _throw(h: np.ndarray, level: np.ndarray | int, size: np.ndarray) -> np.ndarray:
    return mixed(h[:, 0] + h[:, 1] * (np.uint64(2) * np.asarray(level, np.uint64) + _ONE)) % size


@dataclass(frozen=True)
class Shard:
    """bits: the words of all levels; ranks: set bits before each word; sizes, starts: bits and first word of each level; fingerprints, counts and keepers by place."""

    bits: np.ndarray
    ranks: np.ndarray
    sizes: np.ndarray
    starts: np.ndarray
    fingerprints: np.ndarray
    counts: np.ndarray
    keepers: np.ndarray

    FIELDS = (("bits", np.uint64), ("ranks", np.uint32), ("sizes", np.uint64), ("starts", np.int64), ("fingerprints", np.uint64), ("counts", np.uint32), ("keepers", np.int64))


def build(h: np.ndarray, counts: np.ndarray, keepers: np.ndarray) -> Shard:
    """Of distinct hashes (two columns) with what is to be found at their places."""
    levels, sizes, left = [], [], h
    while len(left):
        size = np.uint64(max(64, -(-len(left) * SPARSE // 64) * 64))
        at = _throw(left, len(levels), size)
        alone = np.bincount(at.astype(np.int64), minlength=int(size)) == 1
        levels.append(np.packbits(alone, bitorder="little").view(np.uint64))
        sizes.append(size)
        left = left[~alone[at.astype(np.int64)]]
    bits = np.concatenate(levels) if levels else np.zeros(0, np.uint64)
    ones = np.bitwise_count(bits).astype(np.int64)
    starts = np.cumsum([0, *(len(x) for x in levels)])[:-1].astype(np.int64)
    bare = Shard(bits, (np.cumsum(ones) - ones).astype(np.uint32), np.array(sizes, np.uint64), starts, *(np.zeros(0, t) for _, t in Shard.FIELDS[4:]))
    place = Probes([bare]).places(h, np.zeros(len(h), np.int64))
    put = lambda v, kind: _scattered(place, np.asarray(v).astype(kind))
    return Shard(bare.bits, bare.ranks, bare.sizes, bare.starts, put(h[:, 1], np.uint64), put(np.minimum(counts, 2**32 - 1), np.uint32), put(keepers, np.int64))


def _scattered(place: np.ndarray, values: np.ndarray) -> np.ndarray:
    out = np.empty_like(values)
    out[place] = values
    return out


class Probes:
    """Several shards' arrays end to end, probed for many hashes at once."""

    def __init__(self, shards: list[Shard]):
        words = np.cumsum([0, *(len(s.bits) for s in shards)])
        self.first = np.cumsum([0, *(int(np.bitwise_count(s.bits).sum()) for s in shards)])
        self.bits = np.concatenate([s.bits for s in shards])
        self.ranks = np.concatenate([s.ranks.astype(np.int64) + f for s, f in zip(shards, self.first, strict=False)])
        self.height = max(len(s.sizes) for s in shards)
        self.sizes, self.starts = np.ones((len(shards), self.height), np.uint64), np.full((len(shards), self.height), -1, np.int64)
        for i, s in enumerate(shards):
            self.sizes[i, : len(s.sizes)], self.starts[i, : len(s.sizes)] = s.sizes, s.starts + words[i]
        self.fingerprints, self.counts, self.keepers = (np.concatenate([getattr(s, k) for s in shards]) for k in ("fingerprints", "counts", "keepers"))

    def places(self, h: np.ndarray, shard: np.ndarray) -> np.ndarray:
        """The place of each hash, -1 if none; a hash that was not built in may get any."""
        out, open_ = np.full(len(h), -1, np.int64), np.arange(len(h))
        for level in range(self.height):
            s = shard[open_]
            there = self.starts[s, level] >= 0
            open_, s = open_[there], s[there]
            if not len(open_):
                break
            at = _throw(h[open_], level, self.sizes[s, level])
            word = self.starts[s, level] + (at >> np.uint64(6)).astype(np.int64)
            bit = _ONE << (at & _63)
            found = (self.bits[word] & bit) != 0
            out[open_[found]] = self.ranks[word[found]] + np.bitwise_count(self.bits[word[found]] & (bit[found] - _ONE))
            open_ = open_[~found]
        return out

    def keeper(self, h: np.ndarray, shard: np.ndarray, min_docs: int) -> tuple[np.ndarray, np.ndarray]:
        """(whether each hash is listed with min_docs documents or more, the document that keeps it)."""
        at = self.places(h, shard)
        known = at >= 0
        safe = np.where(known, at, 0)
        if not len(self.fingerprints):
            return np.zeros(len(h), bool), np.zeros(len(h), np.int64)
        return known & (self.fingerprints[safe] == h[:, 1]) & (self.counts[safe] >= min_docs), self.keepers[safe]


def shard_of(h: np.ndarray, shards: int) -> np.ndarray:
    return ((h[:, 0] >> np.uint64(11)) % np.uint64(shards)).astype(np.int64)


def _hashed(text: str, min_chars: int) -> list[bytes | None]:
    """Of each line of a text."""
    return [line_hash(line, min_chars) if len(line) >= min_chars else None for line in text.split("\n")]


def _distinct_lines(min_chars: int):
    """(h1, h2, id, t) of each document's distinct long lines."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [set(_hashed(text, min_chars)) - {None} for text in batch.column("text").to_pylist()]
            of = pa.array(np.repeat(np.arange(len(found)), [len(x) for x in found]))
            if len(of):
                h = halves([x for some in found for x in some]).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(h[:, 0]), pa.array(h[:, 1]), batch.column("id").take(of), batch.column("t").take(of)], ["h1", "h2", "id", "t"])

    return run


def lines_of(docs: DataFrame, min_chars: int) -> DataFrame:
    """docs: (id, t, text)."""
    return docs.select("id", "t", "text").mapInArrow(_distinct_lines(min_chars), "h1 long, h2 long, id long, t long")


def listed_lines(docs: DataFrame, min_chars: int, min_docs: int) -> DataFrame:
    """(h1, h2, n, keeper) of lines in min_docs documents or more."""
    lines = lines_of(docs, min_chars).select("h1", "h2", "id")
    once = docs.groupBy("id").count().where("count > 1").isEmpty()  # then each (line, document) is one row already
    lines = lines if once else lines.distinct()
    # Rows without an id are one document, before all others; with min_docs of 2 or more there is always another one.
    return lines.groupBy("h1", "h2").agg(F.count("*").alias("n"), F.max("id").alias("keeper")).where(F.col("n") >= min_docs)


SHARD_FIELDS = ", ".join(f"{k} binary" for k, _ in Shard.FIELDS)


def _built(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    h = np.stack([table.column(c).to_numpy().view(np.uint64) for c in ("h1", "h2")], axis=1)
    s = build(h, table.column("n").to_numpy(), np.asarray(table.column("keeper").fill_null(0)))
    return pa.table({"shard": pa.array([key[0].as_py()]), "n": pa.array([len(h)]), **{k: pa.array([getattr(s, k).tobytes()], pa.binary()) for k, _ in Shard.FIELDS}})


def _shard(row) -> Shard:
    return Shard(*(np.frombuffer(row[k], t) for k, t in Shard.FIELDS))


def built_shards(listed: DataFrame, shards: int) -> DataFrame:
    """(shard, n, the arrays of its minimal perfect hash); each of some SHARD_LINES hashes."""
    shard = F.pmod(F.shiftrightunsigned("h1", 11), F.lit(shards)).cast("long").alias("shard")
    return listed.select(shard, "h1", "h2", "n", "keeper").groupBy("shard").applyInArrow(_built, f"shard long, n long, {SHARD_FIELDS}")


def _stays(texts: list[str], hashes: list[list[bytes | None]], gone: list[set[bytes]]) -> tuple[list, list, list]:
    """(lines, dropped lines, text) of each document that loses the lines with the hashes `gone`."""
    n, dropped, out = [], [], []
    for text, hs, lost in zip(texts, hashes, gone, strict=True):
        kept = [line for line, h in zip(text.split("\n"), hs, strict=True) if h not in lost] if lost else None
        n.append(len(hs))
        dropped.append(len(hs) - len(kept) if lost else 0)
        out.append("\n".join(kept) if lost else text)
    return n, dropped, out


def _rows(batch: pa.RecordBatch, carried: list[str], columns: tuple[list, list, list]) -> pa.RecordBatch:
    n, dropped, text = columns
    names = ["id", *carried]
    return pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(n, pa.int64()), pa.array(dropped, pa.int64()), pa.array(text, pa.string())], [*names, "n_lines", "n_dropped", "text"])


def _probing(sent, shards: int, min_chars: int, min_docs: int, carried: list[str]):
    """Documents against all arrays."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = [Shard(*(np.frombuffer(b, t) for b, (_, t) in zip(row, Shard.FIELDS, strict=True))) for _, *row in sent.value]
        probes = Probes(found) if found else None
        number = np.full(shards, -1)
        number[[s for s, *_ in sent.value]] = np.arange(len(found))
        for batch in batches:
            texts = batch.column("text").to_pylist()
            hashes = [_hashed(t, min_chars) for t in texts]
            gone: list[set[bytes]] = [set() for _ in texts]
            of = [(i, x) for i, hs in enumerate(hashes) for x in hs if x is not None]
            if of and probes:
                h = halves([x for _, x in of])
                shard = number[shard_of(h, shards)]
                listed, keeper = probes.keeper(h, np.maximum(shard, 0), min_docs)
                own, ids = np.array([i for i, _ in of]), batch.column("id")
                kept = np.asarray(ids.is_valid())[own] & (keeper == np.asarray(ids.fill_null(0))[own])
                for k in np.flatnonzero(listed & (shard >= 0) & ~kept).tolist():
                    gone[of[k][0]].add(of[k][1])
            yield _rows(batch, carried, _stays(texts, hashes, gone))

    return run


def _given(min_chars: int, carried: list[str]):
    """Documents that come with the hashes of the lines that they lose."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").to_pylist()
            yield _rows(batch, carried, _stays(texts, [_hashed(t, min_chars) for t in texts], [set(x or ()) for x in batch.column("gone").to_pylist()]))

    return run


def _probed(min_docs: int):
    """Some hashes of a shard's lines against its arrays: those that their document loses."""

    def run(key, arrays: pa.Table, lines: pa.Table) -> pa.Table:
        lost = np.zeros(lines.num_rows, bool)
        h = np.stack([lines.column(c).to_numpy().view(np.uint64) for c in ("h1", "h2")], axis=1)
        if arrays.num_rows and lines.num_rows:
            listed, keeper = Probes([_shard(arrays.to_pylist()[0])]).keeper(h, np.zeros(len(h), np.int64), min_docs)
            ids = lines.column("id").combine_chunks()
            lost = listed & ~(np.asarray(ids.is_valid()) & (keeper == np.asarray(ids.fill_null(0))))
        digest = [r.tobytes() for r in h[lost]]
        return lines.filter(pa.array(lost)).select(["id", "t"]).append_column("digest", pa.array(digest, pa.binary()))

    return run


def _dealt(rows: DataFrame, listed: DataFrame, arrays: DataFrame, shards: int, min_chars: int, min_docs: int) -> DataFrame:
    """rows with `gone`, the hashes of the lines that each loses; found at the shards, a shard with many probes in several tasks."""
    _, maybe = apart(lines_of(rows, min_chars), listed, ("h1", "h2"))
    shard = F.pmod(F.shiftrightunsigned("h1", 11), F.lit(shards)).cast("long")
    maybe = materialise(maybe.select(shard.alias("shard"), "h1", "h2", "id", "t"), "probes")
    parts = materialise(maybe.groupBy("shard").agg(F.ceil(F.count("*") / PROBES).cast("long").alias("parts")), "parts")
    some = arrays.join(parts, "shard").withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))).drop("n", "parts")
    probes = maybe.join(parts, "shard").withColumn("part", F.pmod(F.xxhash64("t", "id", "h1"), F.col("parts"))).drop("parts")
    found = some.groupBy("shard", "part").cogroup(probes.groupBy("shard", "part")).applyInArrow(_probed(min_docs), "id long, t long, digest binary")
    # A document's own lines only, known by its id and text: rows without an id are no one group.
    gone = materialise(found.groupBy("id", "t").agg(F.collect_set("digest").alias("gone")), "gone")
    none = F.lit(None).cast("array<binary>").alias("gone")
    sure, left = apart(rows, gone.select("id", "t"), ("id", "t"))
    gone = gone.select(F.col("id").alias("gone_id"), F.col("t").alias("gone_t"), "gone")
    met = left.join(gone, (F.col("t") == F.col("gone_t")) & F.col("id").eqNullSafe(F.col("gone_id")), "left")
    return sure.select("*", none).unionByName(met.select(*rows.columns, "gone"))


def dedup_lines(docs: DataFrame, min_chars: int = 40, min_docs: int = 5, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per row of docs: id_col, keep, n_lines, n_dropped, text (the lines that stay, joined by line feeds).

    Lines are split at line feeds; a null or empty text is one empty line. A line's key is the line without BLANK at both ends
    and with A-Z in lower case. Keys of min_chars code points or more in min_docs (2 or more) documents lose all their lines but
    those of the largest id that holds them. Rows of one id are one document; so are all rows without an id, which come before all
    others. Repeated rows give repeated results; an empty table gives none; other columns are not read. Two keys are the same if
    128 bits of hash are.
    """
    if min_docs < 2:
        raise ValueError("min_docs must be 2 or more")
    spark = docs.sparkSession
    carried = [f"keep{i}" for i in range(len(keep))]
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), *[F.col(c).alias(k) for c, k in zip(keep, carried, strict=True)])
    rows = rows.withColumn("t", F.xxhash64("text"))
    listed = materialise(listed_lines(rows, min_chars, min_docs), "listed")
    n = listed.count()
    shards = max(1, -(-n // SHARD_LINES))
    arrays = materialise(built_shards(listed, shards), "shards")
    kinds = [T.StructField("id", T.LongType()), *(T.StructField(k, docs.schema[c].dataType) for c, k in zip(keep, carried, strict=True))]
    schema = T.StructType([*kinds, T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType()), T.StructField("text", T.StringType())])
    size = arrays.agg(F.sum(sum((F.octet_length(k) for k, _ in Shard.FIELDS), F.lit(0)))).first()[0] or 0
    if size <= ARRAY_BYTES:
        found = [(r["shard"], *(bytes(r[k]) for k, _ in Shard.FIELDS)) for r in arrays.collect()]  # ARRAY_BYTES at most
        out = rows.drop("t").mapInArrow(_probing(spark.sparkContext.broadcast(found), shards, min_chars, min_docs, carried), schema)
    else:
        out = _dealt(rows, listed, arrays, shards, min_chars, min_docs).drop("t").mapInArrow(_given(min_chars, carried), schema)
    return out.select(F.col("id").alias(id_col), *[F.col(k).alias(c) for c, k in zip(keep, carried, strict=True)], "n_lines", "n_dropped", "text")
