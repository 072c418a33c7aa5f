"""Language identification by Bayesian evidence fusion.

Four kinds of evidence are multiplied: the likelihood of the text's letter trigrams, the declared markup language, the
language that the address names (top-level domain or first part of the path), and a prior of the host, smoothed towards
that of its domain, which is smoothed towards that of all rows.

Trigram counts are grouped aggregates over all rows, with the declared language as the label, in folds: a text is scored by
the counts of the other folds, so its own declaration, and that of its copies, never speaks twice. How often declarations
and addresses are right is counted over all rows, against the languages that their texts are likeliest in; so are the
languages of hosts, of which a row sees all but its own. That a text is in none of the languages has a likelihood of its own:
that of its characters, counted over all rows, in any order.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prismark.llm.common import materialise, on_known

BUCKETS = 1 << 15
#: Letters of a text that are looked at together.
BLOCK = 1 << 20
#: Trigrams beyond this many add no certainty: they are far from independent.
EFFECTIVE = 60
#: Bounds of how often declarations, and languages named in addresses, are taken to be right; rows and share that the count begins with.
RIGHT = (0.5, 0.98)
RIGHT_ROWS, RIGHT_SHARE = 20.0, 0.85
#: Letters from which a text counts for that.
TELLING = 200
#: What is added to each count.
SPREAD = 0.5
#: Parts of the rows whose trigrams are counted apart.
FOLDS = 5
#: Rows that the prior of the level above counts as.
PRIOR_ROWS = 10.0
#: Share of a text's trigrams that must be likelier than chance under its language: names and codes are not, foreign scripts aren't at all.
LEAST_LIKELY = 0.25
#: Trigrams that a text in its language may have that are unheard of there (a code, a notice), and share of them besides; one costs the more the larger the corpus is.
UNHEARD, UNHEARD_SHARE = 36, 0.03
#: Code points that are told apart; those beyond count as 0.
CHARACTERS = 0x10000
_letters = None


def _folded() -> np.ndarray:
    """For each code point below U+10000 its lower-case letter, or a space."""
    global _letters
    if _letters is None:
        table = np.full(0x10000, 32, np.uint32)
        for c in range(0x10000):
            if not 0xD800 <= c <= 0xDFFF and (x := chr(c)).isalpha():
                low = x.lower()
                table[c] = ord(low) if len(low) == 1 else c
        _letters = table
    return _letters


def _characters(text: str) -> np.ndarray:
    c = np.frombuffer(f" {text} ".encode("utf-32-le", "surrogatepass"), "<u4")
    return np.where(c < 0x10000, _folded()[np.minimum(c, 0xFFFF)], c).astype(np.uint32)


def _buckets(c: np.ndarray) -> np.ndarray:
    h = (c[:-2] * np.uint32(0x9E3779B1)) ^ (c[1:-1] * np.uint32(0x85EBCA77)) ^ (c[2:] * np.uint32(0xC2B2AE3D))
    h = (h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
    return ((h >> np.uint32(17)) & np.uint32(BUCKETS - 1))[c[1:-1] != 32].astype(np.int32)


def trigrams(text: str) -> np.ndarray:
    """Buckets of all three consecutive characters with a letter in the middle, other characters counting as spaces; whole text."""
    return _buckets(_characters(text))


def fold_of(text: Column) -> Column:
    """The part of the rows that a text belongs to; copies belong together."""
    return F.pmod(F.xxhash64(text, F.lit("fold")), F.lit(FOLDS)).cast("int")


def trigram_counts(rows: DataFrame, languages: list[str]) -> DataFrame:
    """(fold, language, bucket, n) over all rows (text, declared) that declare one of the languages; with language -1, characters of all rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, all_ = np.zeros((FOLDS, len(languages), BUCKETS), np.int64), np.zeros((1, CHARACTERS), np.int64)
        place = {x: i for i, x in enumerate(languages)}
        for batch in batches:
            for text, name, fold in zip(*(batch.column(c).to_pylist() for c in ("text", "declared", "fold")), strict=True):
                c = _characters(text)
                n = np.bincount(np.where(c < CHARACTERS, c, 0))
                all_[0, : len(n)] += n
                if name in place:
                    total[fold, place[name]] += np.bincount(_buckets(c), minlength=BUCKETS)
        fold, at, bucket = np.nonzero(total)
        one, seen = np.nonzero(all_)
        columns = ((fold, one), (at, one - 1), (bucket, seen), (total[fold, at, bucket], all_[one, seen]))
        kinds = (np.int32, np.int32, np.int32, np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).astype(k)) for x, k in zip(columns, kinds, strict=True)], ["fold", "language", "bucket", "n"])

    counted = rows.select("text", "declared", fold_of(F.col("text")).alias("fold")).mapInArrow(run, "fold int, language int, bucket int, n long")
    return counted.groupBy("fold", "language", "bucket").agg(F.sum("n").alias("n"))


def text_model(counts: DataFrame, languages: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Log-likelihoods of each bucket under each language, by the fold that is scored with them, and of each character; FOLDS x len(languages) x BUCKETS + CHARACTERS numbers at most come to the driver."""
    n, characters = np.zeros((FOLDS, len(languages), BUCKETS)), np.zeros(CHARACTERS)
    found = counts.toArrow()
    fold, at, bucket, k = (found.column(c).to_numpy() for c in ("fold", "language", "bucket", "n"))
    n[fold[at >= 0], at[at >= 0], bucket[at >= 0]] = k[at >= 0]
    characters[bucket[at < 0]] = k[at < 0]
    n = n.sum(axis=0) - n
    # What is not seen is as likely as if all folds were counted.
    logs = [np.log((x + spread) / (x.sum(axis=-1, keepdims=True) + spread * x.shape[-1])).astype(np.float32) for x, spread in ((n, SPREAD * (FOLDS - 1) / FOLDS), (characters, SPREAD))]
    return logs[0], logs[1]


def unheard_costs(model: tuple[np.ndarray, np.ndarray]) -> list[float]:
    """How much less likely than chance a trigram is that was never seen in each language."""
    return np.maximum(0.0, -np.log(BUCKETS) - model[0].min(axis=2).mean(axis=0)).astype(float).tolist()


def text_scores(rows: DataFrame, model: tuple[np.ndarray, np.ndarray], keep: list[str]) -> DataFrame:
    """keep, letters (trigrams seen), text_score (mean log-likelihood of a trigram by language), likely (share of them likelier than chance) and background (mean log-likelihood of a trigram's characters, chance at least) of each row."""
    shared = rows.sparkSession.sparkContext.broadcast(model)
    fields = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (models, characters), chance = shared.value, -np.log(BUCKETS)
        for batch in batches:
            seen, scores, likely, background = [], [], [], []
            for text, fold in zip(batch.column("text").to_pylist(), batch.column("fold").to_pylist(), strict=True):
                c, m = _characters(text), models[fold]
                t = _buckets(c)
                seen.append(len(t))
                each = [x[t] for x in m] if len(t) else [np.zeros(1)] * len(m)
                scores.append([float(v.mean(dtype=np.float64)) for v in each])
                likely.append([float((v > chance).mean()) for v in each])
                one = characters[np.where(c < CHARACTERS, c, 0)]
                three = (one[:-2] + one[1:-1] + one[2:])[c[1:-1] != 32]
                background.append(float(np.maximum(three, chance).mean(dtype=np.float64)) if len(t) else 0.0)
            lists = [pa.array(x, pa.list_(pa.float64())) for x in (scores, likely)]
            columns = [*(batch.column(c) for c in keep), pa.array(seen, pa.int64()), *lists, pa.array(background, pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, [*keep, "letters", "text_score", "likely", "background"])

    rows = rows.select(*keep, "text", fold_of(F.col("text")).alias("fold"))
    return rows.mapInArrow(run, f"{fields}, letters long, text_score array<double>, likely array<double>, background double")


def domain_of(host: Column) -> Column:
    """The last two labels of a host."""
    return F.substring_index(host, ".", -2)


def tally(rows: DataFrame, languages: list[str]) -> list[dict]:
    """What rows (declared, address, k, telling) say in sum, one row: telling rows with a declared and with an address language, how many of them name language k, and rows of each language."""
    names = F.array(*map(F.lit, languages))
    sums = [F.sum((F.col("k") == i).cast("double")).alias(f"n{i}") for i in range(len(languages))]
    for c in ("declared", "address"):
        known = F.col("telling") & F.col(c).isin(languages)
        sums += [F.sum(known.cast("double")).alias(c), F.sum((known & (F.col(c) == F.get(names, F.col("k")))).cast("double")).alias(f"{c}_right")]
    return rows.agg(*sums).first().asDict()


def _right(found: dict, column: str) -> float:
    share = ((found[f"{column}_right"] or 0) + RIGHT_ROWS * RIGHT_SHARE) / ((found[column] or 0) + RIGHT_ROWS)
    return min(max(share, RIGHT[0]), RIGHT[1])


def host_counts(rows: DataFrame, languages: list[str]) -> DataFrame:
    """(host, counts, above): rows of each language k on a host, and on its domain, as arrays."""
    ones = [F.sum(F.coalesce((F.col("k") == i).cast("double"), F.lit(0.0))).alias(f"n{i}") for i in range(len(languages))]
    hosts = rows.where("host is not null").groupBy("host", "domain").agg(*ones)
    domains = hosts.groupBy("domain").agg(*[F.sum(f"n{i}").alias(f"n{i}") for i in range(len(languages))])
    counts = F.array(*[f"n{i}" for i in range(len(languages))])
    return hosts.select("host", "domain", counts.alias("counts")).join(domains.select("domain", counts.alias("above")), "domain").drop("domain")


def _prior(everywhere: list[float], k: Column) -> Column:
    """The host's languages smoothed towards its domain's and those towards all rows', without the row's own."""
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda a, x: a + x)
    others = lambda c: F.transform(c, lambda x, i: x - (i == F.coalesce(k, F.lit(-1))).cast("double"))
    smooth = lambda c, up: F.zip_with(c, up, lambda x, p: (x + PRIOR_ROWS * p) / (total(c) + PRIOR_ROWS))
    base = F.array(*map(F.lit, everywhere))
    return F.coalesce(smooth(others(F.col("counts")), smooth(others(F.col("above")), base)), base)


def identify(
    rows: DataFrame,
    languages: list[str],
    id_col: str = "doc_id",
    text_col: str = "text",
    declared_col: str = "declared",
    address_col: str = "address_language",
    host_col: str = "host",
    least: float = 0.5,
    evidence: DataFrame | None = None,
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """One row per row of rows: id_col, keep, language, confidence, text_language, letters, kept.

    language is the one with the largest posterior (ties: the first of `languages`), confidence its probability, that of none
    of them included. A row is kept if its text has letters, LEAST_LIKELY of its trigrams are likelier than chance under that language, and confidence >= least.
    Declared or address languages that are null or not among `languages` say nothing, nor does a null host. A null or
    empty text is decided by the other evidence, has text_language null and is not kept. Null ids stay, repeated rows
    give repeated results, an empty table gives none, other columns are not read.

    evidence: (id_col, declared, address_language, host) of another table, one row per id; where not null it stands in
    for the row's own. It meets the rows when their texts are scored already, so texts are not shuffled.
    """
    carried = [f"keep{i}" for i in range(len(keep))]
    base = rows.select(
        F.col(id_col).alias("id"),
        F.coalesce(F.col(text_col), F.lit("")).alias("text"),
        F.col(declared_col).cast("string").alias("declared"),
        F.col(address_col).cast("string").alias("address"),
        F.col(host_col).cast("string").alias("host"),
        *[F.col(c).alias(k) for c, k in zip(keep, carried, strict=True)],
    )
    model = text_model(trigram_counts(base, languages), languages)
    seen = ["letters", "text_score", "likely", "background"]
    scored = text_scores(base, model, ["id", *carried, "declared", "address", "host"])
    if evidence is not None:
        more = evidence.select(F.col(id_col).alias("e_id"), F.col("declared").alias("e_declared"), F.col("address_language").alias("e_address"), F.col("host").alias("e_host"))
        own = [F.coalesce(f"e_{c}", c).alias(c) for c in ("declared", "address", "host")]
        scored = scored.join(more, on_known(F.col("id"), F.col("e_id"), F.col("text_score")), "left").select("id", *carried, *seen, *own)
    place = lambda values, top: F.array_position(values, top).cast("int") - 1
    text_k = F.when(F.col("letters") > 0, place(F.col("text_score"), F.array_max("text_score")))
    scored = materialise(scored.withColumn("domain", domain_of(F.col("host"))).withColumn("k", text_k), "scores")
    found = tally(scored.withColumn("telling", F.col("letters") >= TELLING), languages)
    n = [found[f"n{i}"] or 0.0 for i in range(len(languages))]
    prior = _prior([(x + 1) / (sum(n) + len(n)) for x in n], F.col("k"))
    hosts = host_counts(scored, languages).withColumnRenamed("host", "counted_host")
    joined = scored.join(hosts, on_known(F.col("host"), F.col("counted_host"), F.col("text_score")), "left").withColumn("prior", prior)

    def stated(column: str) -> list[Column]:
        right = _right(found, column)
        wrong = (1 - right) / max(1, len(languages) - 1)
        known = F.col(column).isin(languages)
        return [F.when(known, F.when(F.col(column) == x, F.lit(right)).otherwise(F.lit(wrong))).otherwise(F.lit(1.0)) for x in languages]

    effective = F.least(F.col("letters"), F.lit(EFFECTIVE)).cast("double")
    logs = [
        F.get("text_score", i) * effective + F.log(d) + F.log(a) + F.log(F.get("prior", i))
        for i, (d, a) in enumerate(zip(stated("declared"), stated("address"), strict=True))
    ]
    fused = joined.select("id", *carried, *seen, F.col("k").alias("text_k"), F.array(*logs).alias("logs")).withColumn("best", F.array_max("logs"))
    names = F.array(*map(F.lit, languages))
    k = place(F.col("logs"), F.col("best"))
    cost = F.get(F.array(*map(F.lit, unheard_costs(model))), k)
    none = F.exp((F.col("background") - F.get("text_score", k)) * F.col("letters") - cost * (UNHEARD + UNHEARD_SHARE * F.col("letters")))
    confidence = 1 / F.aggregate("logs", none, lambda s, x: s + F.exp(x - F.col("best")))
    out = fused.select("id", *carried, "letters", "likely", "text_k", k.alias("k"), confidence.alias("confidence"))
    return out.select(
        F.col("id").alias(id_col),
        *[F.col(k).alias(c) for c, k in zip(keep, carried, strict=True)],
        F.get(names, F.col("k")).alias("language"),
        "confidence",
        F.get(names, F.col("text_k")).alias("text_language"),
        "letters",
        ((F.col("letters") > 0) & (F.get("likely", F.col("k")) >= LEAST_LIKELY) & (F.col("confidence") >= least)).alias("kept"),
    )


def markup_language(html: Column) -> Column:
    """The primary tag of the html element's lang attribute, lower-cased; null without one."""
    return _or_null(F.lower(F.regexp_extract(html, r"(?i)<html\b[^>]*?\slang\s*=\s*[\"']?([a-z]{2,3})", 1)))


def address_language(url: Column, languages: list[str]) -> Column:
    """The language that a path's first part or the top-level domain names, if it is one of languages."""
    part = F.lower(F.regexp_extract(url, r"://[^/?#]*/([A-Za-z]{2})(?:[/?#]|$)", 1))
    top = F.lower(F.regexp_extract(url, r"://[^/?#]*\.([A-Za-z]{2})(?:[:/?#]|$)", 1))
    return F.when(part.isin(languages), part).when(top.isin(languages), top)


def page_host(url: Column) -> Column:
    return _or_null(F.lower(F.regexp_extract(url, r"://([^/?#]*)", 1)))


def _or_null(x: Column) -> Column:
    return F.when(x != "", x)
