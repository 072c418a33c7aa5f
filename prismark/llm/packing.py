"""Best-fit packing by hierarchical residual packing.

Level 0: each input partition tokenises its documents, cuts those longer than a sequence and packs the pieces best fit,
longest first. Nearly full bins, with `slack` free places or fewer, are done. Level 1 and up: the underfull bins of `fan_in` groups meet in one task, opened, so that
their pieces are the items of another round of best fit, until one group is left. Opened, because two bins over half full
can't be merged: with whole bins as items many small partitions would keep a few per cent more sequences.
Only (number, length) of pieces move between levels, never texts.
"""

from __future__ import annotations

import functools
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from prismark.llm import tokenizing
from prismark.llm.common import materialise

#: Pieces that a task packs at once; a larger partition is packed in turns.
CHUNK = 200_000
#: Pieces of a partition are numbered from partition << SHIFT; a bin has the number of its first piece.
SHIFT = 36


def best_fit(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, list[int]]:
    """Bin and offset of each item, and the fill of each bin; items are placed longest first, each into the fullest open bin that it fits."""
    where, offset, fills = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64), []
    free: list[list[int]] = [[] for _ in range(capacity + 1)]
    mask = 0  # bit f: a bin with f free places is open
    for i in np.argsort(-sizes, kind="stable"):
        size = int(sizes[i])
        fitting = mask >> size
        if fitting:
            space = size + (fitting & -fitting).bit_length() - 1
            b = free[space].pop()
            if not free[space]:
                mask &= ~(1 << space)
        else:
            b, space = len(fills), capacity
            fills.append(0)
        where[i], offset[i] = b, fills[b]
        fills[b] += size
        space -= size
        if space:
            free[space].append(b)
            mask |= 1 << space
    return where, offset, fills


def placed(number: np.ndarray, length: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each piece its bin, named by the bin's first piece, its offset there and the bin's fill."""
    where, offset, fills = best_fit(length, capacity)
    names = np.zeros(len(fills), np.int64)
    names[where[offset == 0]] = number[offset == 0]
    return names[where], offset, np.array(fills, np.int64)[where]


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n tokens: whole up to capacity, else pieces of capacity with what is over in front."""
    if n <= capacity:
        return [(0, n)]
    over = n % capacity
    return [(0, over)] * bool(over) + [(s, capacity) for s in range(over, n, capacity)]


def _local(tokenizer: str, eos: int, capacity: int, id_type: pa.DataType):
    def packed(ids: list, rows: list[tuple[int, int, int, int]], base: int) -> pa.RecordBatch:
        piece, start, length, crc = (np.array(x, np.int64) for x in zip(*rows, strict=True))
        number = base + np.arange(len(rows))
        owner, offset, fill = placed(number, length, capacity)
        return pa.RecordBatch.from_arrays(
            [pa.array(ids, id_type), *(pa.array(x) for x in (piece, start, length, crc, number, owner, offset, fill))],
            ["id", "piece", "start", "length", "ids_crc32", "number", "bin", "offset", "fill"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = tokenizing.id_coder(tokenizer)
        base = TaskContext.get().partitionId() << SHIFT
        ids: list = []
        rows: list[tuple[int, int, int, int]] = []
        for batch in batches:
            for key, text in zip(batch.column("id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                tokens = np.append(code(text), np.array([eos], "<u4"))
                for k, (s, n) in enumerate(cut(len(tokens), capacity)):
                    ids.append(key)
                    rows.append((k, s, n, zlib.crc32(tokens[s : s + n].astype("<u4", copy=False).tobytes())))
            if len(rows) >= CHUNK:
                yield packed(ids, rows, base)
                base += len(rows)
                ids, rows = [], []
        if rows:
            yield packed(ids, rows, base)

    return run


def _again(capacity: int, full: int, climb: int, last: bool):
    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        """One more round over the pieces of underfull bins; up: goes on to the next round."""
        pdf = pdf.sort_values("number", ignore_index=True)
        owner, offset, fill = placed(pdf["number"].to_numpy(), pdf["length"].to_numpy(), capacity)
        up = np.zeros(len(pdf), bool)
        if not last:
            # The emptiest bins first, as many as hold `climb` pieces; the others stay sequences as they are.
            order = np.lexsort((owner, fill))
            taken = np.zeros(len(pdf), bool)
            taken[order[:climb]] = True
            whole = pd.Series(taken).groupby(owner).transform("all").to_numpy()
            up = whole & (fill < full)
        return pd.DataFrame({"number": pdf["number"], "length": pdf["length"], "bin": owner, "offset": offset, "up": up})

    return run


def pack(
    docs: DataFrame,
    tokenizer: str,
    eos: int = 2,
    capacity: int = 1024,
    id_col: str = "doc_id",
    text_col: str = "text",
    fan_in: int = 8,
    climb: int = 250_000,
    slack: int = 2,
) -> DataFrame:
    """One row per piece: id_col, piece, start, length, ids_crc32, sequence_id, offset.

    Every document is packed, with `eos` behind its ids, so a null or empty text is one piece of one token. Only
    documents longer than `capacity` are cut. Sequences are gapless from offset 0 and hold `capacity` at most. A null id
    stays null; repeated rows are packed each for itself; an empty table gives no rows; other columns are not read.

    A bin with `slack` free places or fewer goes up no more. `climb` bounds the pieces that a task hands up, not what is
    packed: a bin that stays below is a finished sequence. slack=0 with a climb beyond the table's pieces packs all
    underfull bins again, in one task at last.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    key = rows.schema["id"]
    longs = ["piece", "start", "length", "ids_crc32", "number", "bin", "offset", "fill"]
    schema = T.StructType([T.StructField("id", key.dataType), *(T.StructField(c, T.LongType()) for c in longs)])
    from pyspark.sql.pandas.types import to_arrow_type

    pieces = materialise(rows.mapInArrow(_local(tokenizer, eos, capacity, to_arrow_type(key.dataType)), schema), "pieces")
    items = pieces.where(F.col("fill") < capacity - slack).select("number", "length")
    groups = (pieces.agg(F.max(F.shiftright("number", SHIFT))).first()[0] or 0) + 1
    settled, last = [], groups == 1
    while not last:
        groups = -(-groups // fan_in)
        last = groups == 1
        group = (F.shiftright("number", SHIFT) % groups).alias("g")
        step = items.groupBy(group).applyInPandas(_again(capacity, capacity - slack, climb, last), "number long, length long, bin long, offset long, up boolean")
        step = materialise(step, "round")
        settled.append(step.where("not up").select("number", F.col("bin").alias("late_bin"), F.col("offset").alias("late_offset")))
        items = step.where("up").select("number", "length")
    out = pieces
    if settled:
        out = pieces.join(functools.reduce(DataFrame.unionByName, settled), "number", "left")
        out = out.withColumn("bin", F.coalesce("late_bin", "bin")).withColumn("offset", F.coalesce("late_offset", "offset"))
    return out.select(F.col("id").alias(id_col), "piece", "start", "length", "ids_crc32", F.col("bin").alias("sequence_id"), "offset")
