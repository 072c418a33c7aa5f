"""A quality classifier by co-training.

Two views of a document are classified apart: its text (how its words, symbols and repetitions look, and which words and
pairs of words occur) and its metadata (language, source, length, and what pages say of it). In each round each classifier
labels for the other one the documents of the pool that it is sure of, and its surest of each class in any case, as a view may
be right more often than not and never sure. In the end each view's margin is calibrated on labelled documents that no round
has seen, both are combined, and every document is scored. (Few labels are all used for both, by folds.)

The pool is all documents without a label. A round takes some passes over their views: one counts margins, for what is surest;
the others add up slope and bend of both classifiers' losses for a step of Newton's method, in tasks and up a tree, so that
what comes to the driver is as large as a view is wide, squared. Labelled rows, of bounded number (FIT_ROWS), are at the driver.
"""

from __future__ import annotations

import functools
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prismark.functions.trees import added, levels, merged
from prismark.llm.common import materialise, on_known
from prismark.llm.wordhash import WordHashes, mixed

FEATURES = ("words", "word_length", "upper", "digits", "symbols", "bars", "capital_words", "distinct", "top_word", "lines", "repeated_lines", "stops", "ends", "longest")
#: Buckets that words and pairs of words are hashed to, and those of metadata names.
WORD_BUCKETS, NAME_BUCKETS = 128, 64
#: About as many labelled rows the classifiers are fitted and calibrated on, at most; of a rarer class more than its share are
#: drawn, up to LEAST_ROWS, and weigh less.
FIT_ROWS, LEAST_ROWS = 20_000, 1_000
#: Rounds of labelling, and passes of Newton's method in a round.
ROUNDS, STEPS = 2, 5
#: A view labels for the other one what it is at least this sure of, and at least this share of the pool, its surest of each
#: class as the classes are among the labels. Such a label weighs half a given one, and all together a tenth of those at most,
#: so that the many labels of a view that is little better than chance do not drown the given ones.
SURE, SHARE, PSEUDO_WEIGHT, PSEUDO_SHARE = 0.99, 0.1, 0.5, 0.1
#: Margins lie between -MARGIN and MARGIN and are told apart in steps of 1 / GRADES.
MARGIN, GRADES = 30, 1000
#: Of ten labelled documents so many are kept for calibration.
CALIBRATION = 2
#: What score's few_rows is in the queries, and the folds that fewer labelled rows are dealt over.
FEW_ROWS, FOLDS = 1_000, 5
#: What pages may say of a document: names, and counts in their markup.
PAGE_NAMES, PAGE_COUNTS = ("host", "declared", "address_language"), ("tags", "links", "scripts")
NAMES, COUNTS = ("source", "lang", *PAGE_NAMES), ("chars", *PAGE_COUNTS)


def text_features(text: str) -> list[float]:
    """FEATURES of a whole text; all zero without words."""
    words = text.split()
    if not words:
        return [0.0] * len(FEATURES)
    n, size = len(words), len(text)
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    ascii_ = np.bincount(np.minimum(codes, 127), minlength=128)
    letters = ascii_[65:91].sum() + ascii_[97:123].sum() + ascii_[127]
    symbols = sum(int(ascii_[ord(c)]) for c in "!#$%&*+<=>@[]^_`{|}~\\/")
    counts = Counter(words)
    lines = [x for x in text.split("\n") if x.strip()]
    upper = sum(1 for w in words if len(w) > 1 and w.isupper())
    ends = sum(1 for x in lines if x.rstrip()[-1] in ".!?:;\"'”»)")
    return [
        float(np.log1p(n)),
        float(letters) / n,
        float(ascii_[65:91].sum()) / max(1, letters),
        float(ascii_[48:58].sum()) / size,
        symbols / n,
        float(ascii_[ord("|")]) / n,
        upper / n,
        len(counts) / n**0.8,
        counts.most_common(1)[0][1] / n,
        float(np.log1p(len(lines))),
        1 - len(set(lines)) / len(lines),
        float(ascii_[ord(".")] + ascii_[ord(",")]) / n,
        ends / len(lines),
        float(np.log1p(max(map(len, counts)))),
    ]


def word_buckets(text: str, hashes: WordHashes) -> np.ndarray:
    """Square roots of the shares of a text's words and pairs of words in each of WORD_BUCKETS buckets, in 255ths."""
    h = hashes.of(text.encode("utf-8", "surrogatepass").split())
    h = np.concatenate([mixed(h), mixed(h[:-1] * np.uint64(3) + h[1:])]) if len(h) else h
    n = np.bincount((h % np.uint64(WORD_BUCKETS)).astype(np.int64), minlength=WORD_BUCKETS)
    return np.round(255 * np.sqrt(n / max(1, len(h)))).astype(np.uint8)


def text_view(docs: DataFrame, keep: list[str]) -> DataFrame:
    """keep, surface (FEATURES) and buckets (word_buckets) of each row (text)."""
    fields = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            texts = batch.column("text").to_pylist()
            surface = pa.array([text_features(t) for t in texts], pa.list_(pa.float32()))
            buckets = pa.array([word_buckets(t, hashes).tobytes() for t in texts], pa.binary())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), surface, buckets], [*keep, "surface", "buckets"])

    return docs.select(*keep, "text").mapInArrow(run, f"{fields}, surface array<float>, buckets binary")


def text_matrix(rows: pa.Table | pa.RecordBatch) -> np.ndarray:
    n = rows.num_rows
    surface = np.array(rows.column("surface").to_pylist(), np.float64).reshape(n, len(FEATURES))
    buckets = np.frombuffer(b"".join(rows.column("buckets").to_pylist()), np.uint8).reshape(n, WORD_BUCKETS)
    return np.hstack([surface, buckets / 255.0])


def metadata_matrix(rows: pa.Table | pa.RecordBatch) -> np.ndarray:
    """Counts as they are, names as ones in the buckets of their hashes."""
    n = rows.num_rows
    out = np.zeros((n, len(COUNTS) + NAME_BUCKETS))
    for i, c in enumerate(COUNTS):
        out[:, i] = rows.column(c).to_numpy(zero_copy_only=False) if isinstance(rows, pa.RecordBatch) else rows.column(c).to_numpy()
    for c in NAMES:
        values = rows.column(c).to_pylist()
        at = {v: len(COUNTS) + xxhash.xxh3_64_intdigest(f"{c}={v}".encode("utf-8", "surrogatepass")) % NAME_BUCKETS for v in set(values)}
        out[np.arange(n), [at[v] for v in values]] += 1
    return out


VIEWS = (text_matrix, metadata_matrix)


@dataclass(frozen=True)
class Linear:
    """A logistic model: weights of the standardised columns, folded into weights and offset of the raw ones."""

    weights: np.ndarray
    offset: float

    def margin(self, x: np.ndarray) -> np.ndarray:
        return np.clip(x @ self.weights + self.offset, -MARGIN, MARGIN)


def standard(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(means, standard deviations) of the columns; columns that do not vary are divided away."""
    centre, spread = x.mean(axis=0), x.std(axis=0)
    return centre, np.where(spread < 1e-9, np.inf, spread)


def standardised(x: np.ndarray, centre: np.ndarray, spread: np.ndarray) -> np.ndarray:
    return np.hstack([(x - centre) / spread, np.ones((len(x), 1))])


def raw(w: np.ndarray, centre: np.ndarray, spread: np.ndarray) -> Linear:
    weights = w[:-1] / spread
    return Linear(weights, float(w[-1] - weights @ centre))


def terms(z: np.ndarray, y: np.ndarray, weight: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Loss, slope and bend of weighted rows, summed, in one array."""
    m = z @ w
    p = 1 / (1 + np.exp(-np.clip(m, -35, 35)))
    bend = (z * (weight * p * (1 - p))[:, None]).T @ z
    return np.concatenate([[weight @ np.logaddexp(0, -(2 * y - 1) * m)], z.T @ (weight * (p - y)), bend.ravel()])


class Newton:
    """Newton's method for a logistic loss over all rows' weight and a penalty (not on the offset); steps that go up are halved."""

    def __init__(self, w: np.ndarray, total: float, penalty: float):
        self.w, self.at, self.total, self.least, self.done = w, w, total, np.inf, False
        self.ridge = np.diag(np.r_[np.full(len(w) - 1, penalty), 1e-6])
        self.step = np.zeros(len(w))

    def move(self, found: np.ndarray) -> None:
        """found: the terms at self.at."""
        d = len(self.w)
        loss = found[0] / self.total + self.at @ self.ridge @ self.at / 2
        if loss > self.least:
            self.step, self.at = self.step / 2, self.w - self.step / 2
            self.done = np.abs(self.step).max() < 1e-9
            return
        self.done = self.least - loss < 1e-10
        self.w, self.least = self.at, loss
        slope = found[1 : 1 + d] / self.total + self.ridge @ self.w
        self.step = np.linalg.solve(found[1 + d :].reshape(d, d) / self.total + self.ridge, slope)
        self.at = self.w - self.step


def fit(x: np.ndarray, y: np.ndarray, weight: np.ndarray, penalty: float = 1e-2, steps: int = 40) -> Linear:
    """Logistic regression on rows that are at hand."""
    by = standard(x)
    z = standardised(x, *by)
    method = Newton(np.zeros(z.shape[1]), weight.sum(), penalty)
    for _ in range(steps):
        method.move(terms(z, y, weight, method.at))
        if method.done:
            break
    return raw(method.w, *by)


def grades(m: np.ndarray) -> np.ndarray:
    """Margins as whole numbers from 0."""
    return np.floor((m + MARGIN) * GRADES).astype(np.int64)


def surest(counts: np.ndarray, good: float) -> tuple[int, int]:
    """(grade up to which rows are labelled bad, grade from which they are labelled good) for counts of grades: what a view is SURE of, and SHARE of all at least, `good` of it good; rows of one grade go together."""
    n, edge = counts.sum(), np.log(SURE / (1 - SURE))
    low = int(np.searchsorted(np.cumsum(counts), max(1, round(n * SHARE * (1 - good)))))
    high = len(counts) - 1 - int(np.searchsorted(np.cumsum(counts[::-1]), max(1, round(n * SHARE * good))))
    return max(low, int(grades(np.array(-edge)))), min(high, int(grades(np.array(edge))))


def given_labels(grade: np.ndarray, bounds: tuple[int, int]) -> np.ndarray:
    """1, 0, or NaN where a row gets no label or both."""
    bad, fine = grade <= bounds[0], grade >= bounds[1]
    return np.where(bad == fine, np.nan, fine)


def _over(pool: DataFrame, each) -> np.ndarray:
    """The sum over all rows of pool of each(views of some rows), an array; added in tasks and up a tree."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                part = each([v(batch) for v in VIEWS])
                total = part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([total.tobytes()], pa.binary())], ["part", "payload"])

    rows = pool.select(*NAMES, *COUNTS, "surface", "buckets")
    found = merged(rows.mapInArrow(run, "part long, payload binary"), added, height=levels(rows)).collect()
    return np.frombuffer(found[0]["payload"], np.float64)


def cotrain(train: list[np.ndarray], y: np.ndarray, weight: np.ndarray, over) -> list[Linear]:
    """The classifiers of both views after ROUNDS of labelling the pool for each other; over(each): each's sum over the pool's views, None without a pool."""
    models = [fit(x, y, weight) for x in train]
    if over is None:
        return models
    scales = [standard(x) for x in train]
    z = [standardised(x, *s) for x, s in zip(train, scales, strict=True)]
    good, total = np.average(y, weights=weight), weight.sum()
    size = 2 * MARGIN * GRADES + 1
    for _ in range(ROUNDS):
        counts = over(lambda x, m=models: np.concatenate([np.bincount(grades(m[v].margin(x[v])), minlength=size) for v in (0, 1)]).astype(float)).reshape(2, size)
        bounds = [surest(c, good) for c in counts]
        # View v learns from what the other one labels.
        n = [counts[1 - v][: bounds[1 - v][0] + 1].sum() + counts[1 - v][bounds[1 - v][1] :].sum() for v in (0, 1)]
        each_weighs = [min(PSEUDO_WEIGHT, PSEUDO_SHARE * total / max(1.0, k)) for k in n]
        start = [np.r_[m.weights * np.where(np.isinf(s[1]), 0.0, s[1]), m.offset + m.weights @ s[0]] for m, s in zip(models, scales, strict=True)]
        methods = [Newton(w, total + k * e, 1e-2) for w, k, e in zip(start, n, each_weighs, strict=True)]

        def pooled(x: list[np.ndarray], models=models, bounds=bounds, at=None, each_weighs=each_weighs) -> np.ndarray:
            out = []
            for v in (0, 1):
                said = given_labels(grades(models[1 - v].margin(x[1 - v])), bounds[1 - v])
                some = ~np.isnan(said)
                out.append(terms(standardised(x[v][some], *scales[v]), said[some], np.full(some.sum(), each_weighs[v]), at[v]))
            return np.concatenate(out)

        for _ in range(STEPS):
            found = over(functools.partial(pooled, at=[m.at for m in methods]))
            split = 1 + z[0].shape[1] + z[0].shape[1] ** 2
            for v, part in enumerate((found[:split], found[split:])):
                methods[v].move(part + terms(z[v], y, weight, methods[v].at))
            if all(m.done for m in methods):
                break
        models = [raw(m.w, *s) for m, s in zip(methods, scales, strict=True)]
    return models


def out_of_fold(views: list[np.ndarray], y: np.ndarray, weight: np.ndarray, fold: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """(each view's margins of rows by a classifier of the other folds' rows, which rows have some); fold: a whole number of each row."""
    margins, some = [np.zeros(len(y)) for _ in views], np.zeros(len(y), bool)
    for k in range(FOLDS):
        here = fold % FOLDS == k
        if len(set(y[~here])) == 2:
            some |= here
            for m, x in zip(margins, views, strict=True):
                m[here] = fit(x[~here], y[~here], weight[~here]).margin(x[here])
    return margins, some


def calibrated(margins: list[np.ndarray], y: np.ndarray, weight: np.ndarray) -> tuple[list[Linear], Linear]:
    """Each view's margin to its log odds, and both log odds to those of the document."""
    each = [fit(m[:, None], y, weight, 1e-3) for m in margins]
    odds = np.stack([c.margin(m[:, None]) for c, m in zip(each, margins, strict=True)], axis=1)
    return each, fit(odds, y, weight, 1e-3)


def score(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "quality",
    source_col: str = "source",
    lang_col: str = "lang",
    chars_col: str = "n_chars",
    threshold: float = 0.5,
    evidence: DataFrame | None = None,
    keep: tuple[str, ...] = (),
    few_rows: int = 0,
) -> DataFrame:
    """One row per row of docs: id_col, keep, text_margin, metadata_margin, quality_score (probability of good), kept (score >= threshold).

    labels: (id_col, label_col 0/1), some of them; null labels are left out, of several for one document the mean decides (good
    from a half on). Without labels of both kinds nothing can be learnt: all scores are null and all documents kept. A null
    text counts as empty, null metadata as unknown. Null ids are scored and take no label; repeated rows give repeated
    results; an empty table gives none; other columns are not read.

    evidence: (id_col, PAGE_NAMES, PAGE_COUNTS) of another table, one row per id; it meets the documents without their texts.

    few_rows: of fewer labelled rows than this, those held out are too few to calibrate on. All are fitted on then, and all
    calibrate, with margins of classifiers fitted on the other folds' labels.
    """
    carried = [f"keep{i}" for i in range(len(keep))]
    base = docs.select(
        F.col(id_col).alias("id"),
        F.coalesce(F.col(text_col), F.lit("")).alias("text"),
        F.coalesce(F.col(source_col).cast("string"), F.lit("?")).alias("source"),
        F.coalesce(F.col(lang_col).cast("string"), F.lit("?")).alias("lang"),
        F.log1p(F.greatest(F.coalesce(F.col(chars_col).cast("double"), F.lit(0.0)), F.lit(0.0))).alias("chars"),
        *[F.col(c).alias(k) for c, k in zip(keep, carried, strict=True)],
    )
    seen = text_view(base, ["id", "source", "lang", "chars", *carried])
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("label_id"))
    known = known.agg((F.avg(F.col(label_col).cast("double")) >= 0.5).cast("double").alias("y"))
    seen = seen.join(known, on_known(F.col("id"), F.col("label_id"), F.col("buckets")), "left").drop("label_id")
    if evidence is not None:
        more = evidence.select(F.col(id_col).alias("page_of"), *PAGE_NAMES, *PAGE_COUNTS)
        seen = seen.join(more, on_known(F.col("id"), F.col("page_of"), F.col("buckets")), "left").drop("page_of")
    names = [F.coalesce(F.col(c).cast("string") if evidence is not None else F.lit(None), F.lit("?")).alias(c) for c in PAGE_NAMES]
    counts = [F.log1p(F.coalesce(F.col(c).cast("double") if evidence is not None else F.lit(None), F.lit(0.0))).alias(c) for c in PAGE_COUNTS]
    seen = materialise(seen.select("id", *carried, "source", "lang", "chars", "surface", "buckets", "y", *names, *counts), "views")

    own = [F.col("id").alias(id_col), *[F.col(k).alias(c) for c, k in zip(keep, carried, strict=True)]]
    found = {r["y"]: r["count"] for r in seen.groupBy("y").count().collect()}  # three rows at most
    if not (found.get(0.0) and found.get(1.0)):
        none = F.lit(None).cast("double")
        return seen.select(*own, none.alias("text_margin"), none.alias("metadata_margin"), none.alias("quality_score"), F.lit(True).alias("kept"))
    usual = min(1.0, FIT_ROWS / (found[0.0] + found[1.0]))
    rate = {c: max(usual, min(1.0, LEAST_ROWS / found[c])) for c in (0.0, 1.0)}
    wanted = F.when(F.col("y") == 0, F.lit(rate[0.0])).otherwise(F.lit(rate[1.0]))
    draw = F.xxhash64("id", "buckets", F.lit("draw"))
    sample = seen.where(F.col("y").isNotNull() & (F.abs(draw / F.lit(2.0**63)) < wanted))
    fold = F.pmod(F.xxhash64("id", F.lit("held")), F.lit(10))
    # Rows in an order of their own, whatever order tasks end in: the same input gives the same models.
    sample = sample.select("y", fold.alias("fold"), draw.alias("draw"), *NAMES, *COUNTS, "surface", "buckets").toArrow().sort_by("draw")
    y = sample.column("y").to_numpy()
    fold, every = sample.column("fold").to_numpy(), np.ones(len(y), bool)
    held = (fold < CALIBRATION) & (len(y) >= few_rows)
    train = ~held if len(set(y[~held])) == 2 else every  # too few labels to keep some of them for calibration
    check = held if len(set(y[held])) == 2 else every
    weight = np.where(y == 0, usual / rate[0.0], usual / rate[1.0])
    views = [v(sample) for v in VIEWS]
    pool = seen.where(F.col("y").isNull())
    models = cotrain([x[train] for x in views], y[train], weight[train], functools.partial(_over, pool) if found.get(None) else None)
    margins = [m.margin(x) for m, x in zip(models, views, strict=True)]
    if len(y) < few_rows:
        apart, some = out_of_fold(views, y, weight, fold)
        margins, check = (apart, some) if len(set(y[some])) == 2 else (margins, every)
    each, both = calibrated([m[check] for m in margins], y[check], weight[check])

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            margins = [m.margin(v(batch)) for m, v in zip(models, VIEWS, strict=True)]
            odds = np.stack([c.margin(m[:, None]) for c, m in zip(each, margins, strict=True)], axis=1)
            p = 1 / (1 + np.exp(-both.margin(odds)))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ["id", *carried]), *map(pa.array, (*margins, p))], ["id", *carried, "text_margin", "metadata_margin", "quality_score"])

    fields = ", ".join(f"`{c}` {seen.schema[c].dataType.simpleString()}" for c in ["id", *carried])
    out = seen.select("id", *carried, *NAMES, *COUNTS, "surface", "buckets").mapInArrow(scored, f"{fields}, text_margin double, metadata_margin double, quality_score double")
    return out.select(*own, "text_margin", "metadata_margin", "quality_score", (F.col("quality_score") >= threshold).alias("kept"))
