"""Benchmark decontamination by winnowing.

Of a text's k-gram hashes those are its fingerprints that are the minimum of some window of w consecutive k-grams. Two
texts that share k + w - 1 words share a fingerprint there, so with k + w - 1 = `words` no shared window of `words` words
is missed. Fingerprints of documents and of benchmark items are joined, and each meeting is extended to the whole windows
around it, which are compared as text. Items shorter than a window are one window; their runs are all fingerprints (w = 1).
Windows that the same items hold are one class, and documents that meet the same classes one group, whose items are listed once.

Before the join, documents' fingerprints pass a bitmap of the benchmark's: fixed size, so it can be sent to every task
however large the benchmark is; what passes by chance goes in the join.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from prismark.llm.common import materialise
from prismark.llm.wordhash import WordHashes, runs

#: Bits of the bitmap, a power of two: 16 MB.
BITMAP_BITS = 1 << 27
_ASCII = bytes(c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else c + 32 if 65 <= c <= 90 else 32 for c in range(256))


def words_of(text: str) -> list[bytes]:
    """Runs of characters other than ASCII ones that are neither letters nor digits; A-Z in lower case."""
    return text.encode("utf-8", "surrogatepass").translate(_ASCII).split()


def winnowed(grams: np.ndarray, w: int) -> np.ndarray:
    """Places of the k-grams that are the minimum of a window of w; where there are fewer than w, none (no shared window fits)."""
    n = len(grams) - w + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    low = grams[:n].copy()
    for i in range(1, w):
        np.minimum(low, grams[i : n + i], out=low)
    chosen = np.zeros(len(grams), bool)
    for i in range(w):
        chosen[i : n + i] |= grams[i : n + i] == low
    return np.flatnonzero(chosen)


def _signed(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)


def _item_prints(words: int, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            ids, prints, spans, windows = [], [], [], []
            for key, text in zip(batch.column("id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                item = words_of(text)
                if not item:
                    continue
                n = min(words, len(item))
                h = hashes.of(item)
                grams = runs(h, k) if n == words else runs(h, n)
                at = winnowed(grams, words - k + 1) if n == words else np.zeros(1, np.int64)
                ids.append(key)
                spans.append(n)
                prints.append(_signed(grams[at]).tolist())
                windows.append(sorted({b" ".join(item[i : i + n]).decode("utf-8", "surrogatepass") for i in range(len(item) - n + 1)}))
            yield pa.RecordBatch.from_arrays([pa.array(ids, batch.column("id").type), pa.array(spans, pa.int32()), pa.array(prints, pa.list_(pa.int64())), pa.array(windows, pa.list_(pa.string()))], ["id", "span", "prints", "windows"])

    return run


def _bitmap(prints: DataFrame) -> bytes:
    """Bit (hash mod BITMAP_BITS) of each fingerprint; at most BITMAP_BITS / 64 rows come to the driver whatever the benchmark holds."""
    bit = F.col("fp").bitwiseAND(F.lit(BITMAP_BITS - 1))
    words = prints.select(F.shiftright(bit, 6).alias("w"), bit.bitwiseAND(F.lit(63)).cast("int").alias("b"))
    words = words.select("w", F.expr("shiftleft(1L, b)").alias("x")).groupBy("w").agg(F.bit_or("x").alias("x"))
    found = words.toArrow()
    bits = np.zeros(BITMAP_BITS // 64, np.int64)
    bits[found.column("w").to_numpy()] = found.column("x").to_numpy()
    return bits.tobytes()


def _doc_prints(words: int, k: int, short: list[int], bitmap, keep: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        bits = np.frombuffer(bitmap.value, np.uint64)
        mask = np.uint64(BITMAP_BITS - 1)
        row = TaskContext.get().partitionId() << 36

        def listed(grams: np.ndarray) -> np.ndarray:
            low = grams & mask
            return (bits[(low >> np.uint64(6)).astype(np.int64)] >> (low & np.uint64(63))) & np.uint64(1) != 0

        for batch in batches:
            counts, hits = [], []
            for text in batch.column("text").to_pylist():
                doc = words_of(text)
                counts.append(len(doc))
                h, found = hashes.of(doc), []
                grams = runs(h, k)
                at = winnowed(grams, words - k + 1)
                for p in at[listed(grams[at])].tolist():
                    first = max(0, p + k - words)
                    found.append((int(_signed(grams[p : p + 1])[0]), words, first, doc[first : p + words]))
                for n in short:
                    grams = runs(h, n)
                    for p in np.flatnonzero(listed(grams)).tolist():
                        found.append((int(_signed(grams[p : p + 1])[0]), n, p, doc[p : p + n]))
                hits.append([{"fp": f, "span": n, "first": a, "around": [x.decode("utf-8", "surrogatepass") for x in ws]} for f, n, a, ws in found])
            kind = pa.list_(pa.struct([("fp", pa.int64()), ("span", pa.int32()), ("first", pa.int32()), ("around", pa.list_(pa.string()))]))
            rows = pa.array(np.arange(row, row + len(counts)))
            row += len(counts)
            yield pa.RecordBatch.from_arrays([rows, *(batch.column(c) for c in keep), pa.array(counts, pa.int64()), pa.array(hits, kind)], ["row", *keep, "n_words", "hits"])

    return run


def find_contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    words: int = 10,
    gram: int = 5,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    keep: tuple[str, ...] = (),
) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(per document, spans, classes met, items of classes).

    Per row of docs: row (a number that the others refer to), id_col, keep, n_words; materialised. Spans: (row, first, span) of
    every place where a window of an item occurs, distinct. Windows that the same items hold are a class. Classes met: (row,
    class) distinct. Items of classes: (class, item) distinct. So a passage that many items and many documents share is one row for
    each document and one for each item, never one for each two. A window is `words` consecutive words of an item; an item of
    fewer words, but not none, is one window. Null or empty texts have no words and match nothing. Rows are told apart
    whatever their ids.
    """
    spark = docs.sparkSession
    items = benchmark.select(F.col(item_col).alias("id"), F.coalesce(F.col(item_text_col), F.lit("")).alias("text"))
    kind = items.schema["id"].dataType
    schema = T.StructType([T.StructField("id", kind), T.StructField("span", T.IntegerType()), T.StructField("prints", T.ArrayType(T.LongType())), T.StructField("windows", T.ArrayType(T.StringType()))])
    items = materialise(items.mapInArrow(_item_prints(words, gram), schema), "items")
    prints = items.select("span", F.explode("prints").alias("fp")).distinct()
    short = sorted(r[0] for r in items.where(F.col("span") < words).select("span").distinct().collect())  # at most words - 1 numbers
    bitmap = spark.sparkContext.broadcast(_bitmap(prints))

    carried = [f"keep{i}" for i in range(1 + len(keep))]
    rows = docs.select(*[F.col(c).alias(k) for c, k in zip((id_col, *keep), carried, strict=True)], F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    hit = "array<struct<fp:long,span:int,first:int,around:array<string>>>"
    schema = T.StructType([T.StructField("row", T.LongType()), *rows.drop("text").schema.fields, T.StructField("n_words", T.LongType()), T.StructField("hits", T._parse_datatype_string(hit))])
    scanned = materialise(rows.mapInArrow(_doc_prints(words, gram, short, bitmap, carried), schema), "prints")
    bitmap.unpersist()

    met = scanned.select("row", F.explode("hits").alias("h")).select("row", "h.*").join(prints, ["span", "fp"], "left_semi")
    starts = F.expr("transform(sequence(0, size(around) - span), i -> struct(cast(first + i as int) as first, array_join(slice(around, i + 1, span), ' ') as window))")
    around = met.where("size(around) >= span").select("row", "span", F.explode(starts).alias("s")).select("row", "span", "s.first", "s.window").distinct()
    listed = items.select(F.col("id").alias("item"), F.explode("windows").alias("window")).distinct()
    spans = materialise(around.join(listed.select("window").distinct(), "window", "left_semi"), "spans")
    of, holders = classes(listed)
    met = spans.select("row", "window").distinct().join(of, "window").select("row", "class").distinct()
    counted = scanned.select("row", *[F.col(k).alias(c) for c, k in zip((id_col, *keep), carried, strict=True)], "n_words")
    return counted, spans.select("row", "first", "span").distinct(), met, holders


def classes(listed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(window, class) and (class, item) of (item, window), distinct: windows with the same items have one class, which is known by their number and two sums of their hashes."""
    text = F.coalesce(F.col("item").cast("string"), F.lit("")) if isinstance(listed.schema["item"].dataType, T.StringType) else F.col("item")
    sums = [F.sum(F.xxhash64(F.lit(k), F.col("item").isNull(), text).cast("decimal(20,0)")).cast("string") for k in (0, 1)]
    of = materialise(listed.groupBy("window").agg(F.concat_ws(":", F.count("*").cast("string"), *sums).alias("class")).select("window", "class"), "classes")
    one = of.groupBy("class").agg(F.min("window").alias("window"))
    return of, listed.join(one, "window").select("class", "item").distinct()


def covered(spans: DataFrame) -> DataFrame:
    """(row, n_hit): words of each row inside any of its spans."""
    w = Window.partitionBy("row").orderBy("first", "span").rowsBetween(Window.unboundedPreceding, -1)
    end = F.col("first") + F.col("span")
    before = F.coalesce(F.max(end).over(w), F.lit(0))
    new = F.greatest(F.lit(0), end - F.greatest("first", before))
    return spans.select("row", new.cast("long").alias("new")).groupBy("row").agg(F.sum("new").alias("n_hit"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", item_col: str = "item_id", keep: tuple[str, ...] = (), **kw) -> DataFrame:
    """One row per row of docs: id_col, keep, n_words, n_hit, n_items, items_sha256, contaminated; see find_contamination for the cases.

    items_sha256: of the items' ids as strings, sorted and joined by commas (of the empty string if there are none).
    """
    counted, spans, met, holders = find_contamination(docs, benchmark, id_col=id_col, item_col=item_col, keep=keep, **kw)
    # Rows that meet the same classes have the same items, which are listed once.
    met = materialise(met.groupBy("row").agg(F.array_join(F.sort_array(F.collect_set("class")), ";").alias("met")).withColumn("group", F.sha2("met", 256)), "met")
    groups = met.groupBy("group").agg(F.first("met").alias("met")).select("group", F.explode(F.split("met", ";")).alias("class"))
    names = groups.join(holders, "class").select("group", "item").distinct()
    names = names.groupBy("group").agg(F.count("*").alias("n_items"), F.array_join(F.sort_array(F.collect_list(F.col("item").cast("string"))), ",").alias("names"))
    names = names.select("group", "n_items", F.sha2("names", 256).alias("items_sha256"))
    items = met.select(F.col("row").alias("met_row"), "group").join(names, "group").drop("group")
    hit = covered(spans)
    found = hit.join(items, F.col("row") == F.col("met_row"), "left").drop("met_row").withColumnRenamed("row", "found_row")
    out = counted.join(found, F.col("row") == F.col("found_row"), "left")
    return out.select(
        id_col,
        *keep,
        "n_words",
        F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"),
        F.coalesce("items_sha256", F.sha2(F.lit(""), 256)).alias("items_sha256"),
        (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"),
    )
