"""Token counts by the whole-token shortcut.

Which strings of the vocabulary encode alone as one token is proved beforehand with the tokenizer's own library
(tokenizing.whole_tokens). A text is split into pre-tokens as the library splits it; a pre-token among the proved
strings counts one, and only the rest are merged, by the library, once for each distinct pre-token.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from prismark.llm import tokenizing

#: Pre-tokens whose count a worker remembers besides the proved strings; beyond, it forgets them and starts anew.
REMEMBERED = 400_000


class PreTokenCounts:
    """Tokens of each pre-token: one for whole tokens, merged by the library for the rest."""

    def __init__(self, path: str):
        import regex

        self.path = path
        self.find = regex.compile(tokenizing.PRE_TOKEN).findall
        self.base = dict.fromkeys(tokenizing.whole_tokens(path), 1)
        self.known = dict(self.base)
        self.specials = tokenizing.special_strings(path)

    def __call__(self, texts: list[str]) -> list[int]:
        lib = tokenizing.library(self.path)
        plain = [not any(s in t for s in self.specials) for t in texts]
        split = [self.find(t) if p else [] for t, p in zip(texts, plain, strict=True)]
        if len(self.known) > len(self.base) + REMEMBERED:
            self.known = dict(self.base)
        rest = list(set().union(*split) - self.known.keys())
        for token, coded in zip(rest, lib.encode_batch(rest, add_special_tokens=False), strict=True):
            self.known[token] = len(coded.ids)
        at = self.known.__getitem__
        return [sum(map(at, s)) if p else len(lib.encode(t, add_special_tokens=False).ids) for s, p, t in zip(split, plain, texts, strict=True)]


def counter(path: str):
    """A function from texts to their numbers of tokens: the shortcut for byte-level files, else the library itself."""
    if tokenizing.byte_level(path):
        return PreTokenCounts(path)
    lib = tokenizing.library(path)
    if path.endswith(".model"):
        return lambda texts: [len(x) for x in lib.encode(texts, num_threads=1)]
    return lambda texts: [len(e.ids) for e in lib.encode_batch(texts, add_special_tokens=False)]


def count_tokens(df: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 1024) -> DataFrame:
    """One row for each row of df: id_col, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > limit).

    No shuffle, whole texts. A null text counts as empty: 0 bytes, 0 tokens. A null id stays null; repeated rows give
    repeated results; an empty table gives no rows. Other columns, also ones named like the results, are not read.
    """
    rows = df.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = None
        for batch in batches:
            count = count or counter(tokenizer)
            n = pa.array(count(batch.column("text").to_pylist()), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("n_bytes"), n], ["id", "n_bytes", "n_tokens"])

    rows = rows.withColumn("n_bytes", F.octet_length("text").cast("long"))
    schema = T.StructType([T.StructField("id", rows.schema["id"].dataType), T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType())])
    counted = rows.mapInArrow(run, schema)
    return counted.select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
