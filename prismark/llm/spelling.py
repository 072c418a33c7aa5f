"""Spelling variants: words one edit apart, found through a reduced alphabet.

Letters are hashed to a few symbols. For each word the full one-edit neighbourhood of its reduced form is generated (every
deletion, every replacement and insertion of a symbol, where an alphabet of 57 letters would ask for many times more), and
joined to the reduced vocabulary; what meets is verified on the original strings. An edit leaves the letters of one half of a
word as they are, so that half is part of the key: words that only look alike when reduced hardly ever meet, and no key
gathers more than the words that share a half and a reduced form. Of the edits that lead from one word to the other the one
at their first difference counts, so each pair is found once.

Generated keys first pass a bitmap of the vocabulary's, of fixed size: most neighbours do not exist.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prismark.llm.common import MAX_BITS, discard, materialise
from prismark.llm.wordhash import mixed

#: Symbols of the reduced alphabet.
SYMBOLS = 4
#: Words that a task counts before it hands them on.
HELD = 200_000
#: A-Z in lower case, other bytes of Latin-1 that are no letters of a run become spaces.
_LETTERS = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 0xC0 else 32 for c in range(256))
#: The symbol of each Latin-1 letter, from 1, by hash.
_SYMBOL = np.array([1 + zlib.crc32(bytes([c])) % SYMBOLS for c in range(256)], np.uint64)
#: Base of polynomial hashes modulo 2^64, and its inverse; hashes only bring words together, which are then compared.
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
_ONE, _STEP = np.uint64(1), 0xD6E8FEB86659FD93
#: Where a key's bits in the bitmap are read off.
PLACES = (0, 18, 36)
DELETION, REPLACEMENT, INSERTION = 0, 1, 2


def runs_of(text: str) -> list[bytes]:
    """Maximal runs of A-Z, a-z and U+00C0 to U+00FF in Latin-1, a byte for each code point; A-Z in lower case."""
    return text.encode("latin-1", "replace").translate(_LETTERS).split()


def misspelt(words: Counter, doc_id: int | None, every: int) -> Iterator[tuple[bytes, int]]:
    """The words of a document with their counts; those whose crc32 with the id `every` divides lose a letter."""
    start = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
    for w, n in words.items():
        h = zlib.crc32(w if w.isascii() else w.decode("latin-1").encode(), start)
        if h % every == 0:
            p = h % len(w)
            w = w[:p] + w[p + 1 :]
        yield w, n


def _counted(min_length: int, every: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()

        def out() -> pa.RecordBatch:
            words = pa.array([w.decode("latin-1") for w in held], pa.string())
            made = pa.RecordBatch.from_arrays([words, pa.array(list(held.values()), pa.int64())], ["word", "n"])
            held.clear()
            return made

        for batch in batches:
            for i, text in zip(batch.column("id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                for w, n in misspelt(Counter(runs_of(text)), i, every):
                    if len(w) >= min_length:
                        held[w] += n
                if len(held) >= HELD:
                    yield out()
        yield out()

    return run


def vocabulary(docs: DataFrame, min_length: int, min_count: int, every: int, id_col: str, text_col: str) -> DataFrame:
    """(word, n) of the words of all texts."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return rows.mapInArrow(_counted(min_length, every), "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= min_count)


def _powers(n: int, of: int) -> np.ndarray:
    out = np.full(n + 1, of, np.uint64)
    out[0] = 1
    return np.cumprod(out)


def _sums(values: np.ndarray) -> np.ndarray:
    """Of each row of numbers the polynomial hashes of all its beginnings, the empty one first."""
    terms = values * _powers(values.shape[1], BASE)[:-1]
    return np.concatenate([np.zeros((len(values), 1), np.uint64), np.cumsum(terms, axis=1, dtype=np.uint64)], axis=1)


def _times(n: int) -> np.uint64:
    return np.uint64(n * _STEP % (1 << 64))


def _halves(words: np.ndarray, short: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the first and the last letters of words (rows of bytes) that a partner shares, if the shorter of both has `short`."""
    n, half = words.shape[1], short // 2
    sums, at = _sums(words.astype(np.uint64) + _ONE), n - (short - half)
    last = (sums[:, n] - sums[:, at]) * _powers(at, INVERSE)[at]
    return tuple(mixed(h + _times(2 * size + side)) for h, size, side in ((sums[:, half], half, 0), (last, short - half, 1)))


def _reduced(words: np.ndarray) -> np.ndarray:
    return _SYMBOL[words]


def _keyed(form: np.ndarray, length: int, half: np.ndarray) -> np.ndarray:
    return mixed(form + _times(length) + half)


def own_keys(words: np.ndarray) -> np.ndarray:
    """Three keys of each word (rows of bytes): its reduced form with each half that a partner may share with it. The shorter of two words is cut in the middle."""
    n = words.shape[1]
    form = _sums(_reduced(words))[:, n]
    left, right = _halves(words, n)
    # The shorter partner's cut moves one of the halves only.
    other = _halves(words, n - 1)[n % 2]
    return np.stack([_keyed(form, n, h) for h in (left, right, other)], axis=1)


def neighbour_keys(words: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(edit, keys by word and place, which of them are needed) of every reduced form one edit away from words of one length (rows of bytes)."""
    n = words.shape[1]
    r, power = _reduced(words), _powers(n + 1, BASE)
    sums = _sums(r)
    whole, places = sums[:, n:], np.arange(n + 1)
    halves, less = _halves(words, n), _halves(words, n - 1)
    # An edit in the second half leaves the first one, an edit before it the second.
    kept = lambda h, short, upto: np.where(places[:upto] >= short // 2, h[0][:, None], h[1][:, None])
    every = np.ones((len(words), n + 1), bool)
    for c in range(1, SYMBOLS + 1):
        symbol = np.uint64(c)
        yield INSERTION, _keyed(sums + symbol * power[: n + 1] + (whole - sums) * np.uint64(BASE), n + 1, kept(halves, n, n + 1)), every
        yield REPLACEMENT, _keyed(whole + (symbol - r) * power[:n], n, kept(halves, n, n)), every[:, :n]
    last = np.concatenate([words[:, 1:] != words[:, :-1], every[:, :1]], axis=1)  # of equal letters in a row the last stands for all
    yield DELETION, _keyed(sums[:, :n] + (whole - sums[:, 1:]) * np.uint64(INVERSE), n - 1, kept(less, n - 1, n)), last


def _by_length(words: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, their words as rows of bytes) for each length."""
    sizes = np.array([len(w) for w in words])
    for n in np.unique(sizes):
        rows = np.flatnonzero(sizes == n)
        yield rows, np.frombuffer("".join(words[i] for i in rows).encode("latin-1"), np.uint8).reshape(len(rows), n)


def _listing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for rows, words in _by_length(batch.column("word").to_pylist()):
            keys = own_keys(words)
            of = pa.array(np.repeat(rows, keys.shape[1]))
            yield pa.RecordBatch.from_arrays([pa.array(keys.ravel().view(np.int64)), batch.column("word").take(of), batch.column("n").take(of)], ["key", "near", "near_n"])


def _generating(bitmap):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.frombuffer(bitmap.value, np.uint64)
        mask = np.uint64(len(bits) * 64 - 1)

        def listed(key: np.ndarray) -> np.ndarray:
            found = np.ones(len(key), bool)
            for shift in PLACES:
                at = (key >> np.uint64(shift)) & mask
                found &= (bits[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & _ONE != 0
            return found

        for batch in batches:
            for rows, words in _by_length(batch.column("word").to_pylist()):
                for edit, keys, needed in neighbour_keys(words):
                    of, place = np.nonzero(needed)
                    key = keys[of, place]
                    there = listed(key)
                    if there.any():
                        at = pa.array(rows[of[there]])
                        yield pa.RecordBatch.from_arrays([pa.array(key[there].view(np.int64)), batch.column("word").take(at), batch.column("n").take(at), pa.array((place[there] * 4 + edit).astype(np.int32))], ["key", "word", "n", "edit"])

    return run


def _bitmap(keys: DataFrame, n: int) -> bytes:
    """Some bits for each key, of 16 a key and MAX_BITS at most: at most MAX_BITS / 64 rows come to the driver, whatever the vocabulary."""
    size = min(MAX_BITS, max(64, 1 << (16 * n - 1).bit_length() if n else 64))
    at = F.explode(F.array(*[F.shiftrightunsigned("key", k).bitwiseAND(F.lit(size - 1)) for k in PLACES])).alias("at")
    words = keys.select(at).select(F.shiftright("at", 6).alias("w"), F.expr("shiftleft(1L, cast(at & 63L as int))").alias("x")).groupBy("w").agg(F.bit_or("x").alias("x")).toArrow()
    bits = np.zeros(size // 64, np.int64)
    bits[words.column("w").to_numpy()] = words.column("x").to_numpy()
    return bits.tobytes()


def _one_edit() -> Column:
    """Whether near comes of word by the row's edit, and no earlier place differs."""
    p, kind = F.shiftright("edit", 2), F.col("edit").bitwiseAND(F.lit(3))
    word, near = F.col("word"), F.col("near")
    left = F.substring(word, F.lit(1), p) == F.substring(near, F.lit(1), p)
    cut = lambda c, by: F.substring(c, p + 1 + by, F.length(c))
    other = F.substring(word, p + 1, F.lit(1)) != F.substring(near, p + 1, F.lit(1))
    same = F.when(kind == DELETION, cut(word, 1) == cut(near, 0)).when(kind == INSERTION, cut(word, 0) == cut(near, 1)).otherwise(cut(word, 1) == cut(near, 1))
    sizes = F.length(near) - F.length(word) == F.when(kind == DELETION, F.lit(-1)).when(kind == INSERTION, F.lit(1)).otherwise(F.lit(0))
    return sizes & left & other & same


def near_pairs(words: DataFrame) -> DataFrame:
    """(word, n, near, near_n) of words (word, n: materialised, distinct, Latin-1) one edit apart, each pair both ways, once."""
    listed = words.select("word", "n").mapInArrow(_listing, "key long, near string, near_n long")
    bitmap = words.sparkSession.sparkContext.broadcast(_bitmap(listed, 3 * words.count()))
    asked = words.select("word", "n").mapInArrow(_generating(bitmap), "key long, word string, n long, edit int")
    # Neither side is small, and both grow with the vocabulary.
    return asked.hint("merge").join(listed, (asked["key"] == listed["key"]) & _one_edit()).select("word", "n", "near", "near_n")


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of (word, form), forms not null and without circles: each round doubles how far a word has followed its forms."""
    at = materialise(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        on = at.select(F.col("word").alias("root"), F.col("root").alias("further"))
        moved = materialise(at.join(on, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "roots")
        discard(at)
        at = moved
        if at.where("moved").isEmpty():
            return at.select("word", "root")


def spelling_variants(docs: DataFrame, min_length: int = 5, min_count: int = 3, ratio: int = 2, every: int = 97, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per word: word, form, root, n, n_near, form_n.

    Words are runs of A-Z (in lower case), a-z and U+00C0 to U+00FF in whole texts; where `every` divides the crc32 of
    `<id>:<run>`, the letter at crc32 % length is left out. Words of min_length letters or more with min_count occurrences or
    more take part. Near words differ by one inserted, deleted or replaced letter. A word's form is the most frequent
    near word (ties: the first in code-point order) if that is ratio times as frequent or more, else null; its root is where
    its forms lead. A null text has no runs; a null id is written as nothing. Repeated rows count again; an empty table gives
    no rows; other columns are not read.
    """
    words = materialise(vocabulary(docs, min_length, min_count, every, id_col, text_col), "vocabulary")
    best = F.min(F.struct((-F.col("near_n")).alias("less"), "near", "near_n")).alias("best")
    # A word has no more neighbours than there are edits.
    found = near_pairs(words).groupBy("word").agg(F.count("*").alias("n_near"), F.min("n").alias("own"), best)
    good = F.col("best.near_n") >= ratio * F.col("own")
    found = materialise(found.select("word", "n_near", F.when(good, F.col("best.near")).alias("form"), F.when(good, F.col("best.near_n")).alias("form_n")), "near")
    ends = roots(found.where("form is not null"))
    out = words.join(found, "word", "left").join(ends, "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), "form_n")
