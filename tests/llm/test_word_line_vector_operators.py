import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from prismark.llm import line_dedup, singular_values, spelling, whitening
from prismark.llm.common import table, tuned
from tests.llm import brute

ODD = [None, "", " ", "\n", "\n\n a", "x" * 5000, "word " * 30_000, "naïve Ünïcode 汉字汉字汉字 🙂 straße ×÷×÷×", "line one\r\nline two\n", "éèêëàâ ÉÈÊËÀÂ"]


def frame(spark, docs):
    """With columns that clash with those that the operators make."""
    rows = [(i, t, 7, "x", "y") for i, t in docs]
    return spark.createDataFrame(rows, "doc_id long, text string, n long, word string, `_metadata` string")


# --- spelling ------------------------------------------------------------------------------------------------------
def variants(df):
    got = spelling.spelling_variants(df).collect()
    assert len({r.word for r in got}) == len(got)
    return {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in got}


def test_spelling_on_documents(spark, sf_dir):
    docs = [(r.doc_id, r.text) for r in table(tuned(spark), sf_dir, "documents").select("doc_id", "text").collect()]
    assert variants(table(spark, sf_dir, "documents")) == brute.spelling(docs)


def test_spelling_of_odd_and_repeated_texts(spark, monkeypatch):
    rng = random.Random(11)
    words = ["aaaaa", "aaaaaa", "aaaaaaa", "ababab", "bababa", "garçon", "garcon", "ÀÀÀÀÀ", "ààààà", "Zebra", "zebras", "zebra", "xebra", "abcde", "bcde", "abcdef"]
    docs = [(i, t) for i, t in enumerate(ODD)] + [(None, " ".join(words)), (3, "ZEBRA zebra")]
    for i in range(60):
        docs.append((100 + i, "/".join(rng.choices(words, [2**k for k in range(len(words))], k=30))))
        docs.append((200 + i, " ".join("".join(rng.choices("abé", k=rng.randrange(4, 9))) for _ in range(80))))
    docs.append((400, "planet " * 60 + "planets " * 25 + "planetss " * 10 + "planetsss " * 4))
    want = brute.spelling(docs)
    assert any(v[1] not in (w, v[0]) for w, v in want.items())  # roots further than the form
    assert variants(frame(tuned(spark), docs)) == want
    monkeypatch.setattr(spelling, "HELD", 10)
    assert variants(frame(spark, docs).repartition(7)) == want
    assert variants(frame(spark, docs).limit(0)) == {}
    assert variants(frame(spark, [(1, "one two"), (2, None)])) == {}


def test_each_pair_meets_once():
    rng = random.Random(3)
    words = sorted({bytes(rng.choices(b"ab\xe9", k=rng.randrange(5, 9))) for _ in range(500)})
    row = lambda w: np.frombuffer(w, np.uint8)[None]
    own = {w: spelling.own_keys(row(w))[0].tolist() for w in words}
    assert all(len(set(k)) == 3 for k in own.values())
    for w in words[::7]:
        keys = {int(k) for _, keys, needed in spelling.neighbour_keys(row(w)) for k in keys[needed]}
        for v in words:
            near = v != w and abs(len(v) - len(w)) <= 1 and any(v[:p] + v[p + (len(v) >= len(w)) :] == w[:p] + w[p + (len(w) >= len(v)) :] for p in range(max(len(v), len(w))))
            assert not near or keys & set(own[v])


def test_very_long_words(spark):
    rng = random.Random(6)
    long = "".join(rng.choices("abcdefgh", k=5_000))
    docs = [(i, t) for i, t in enumerate([long, long, long, long, "x" + long, "x" + long, "x" + long, long[:3000] + long[3001:]] + [long[:3000] + "y" + long[3001:]] * 9)]
    assert variants(tuned(spark).createDataFrame(docs, "doc_id long, text string")) == brute.spelling(docs)


# --- whitening -----------------------------------------------------------------------------------------------------
def check_whitened(df, rows):
    at = lambda r: (r[1], str(r[0]), r[3])
    got = sorted((tuple(r) for r in whitening.whiten(df).collect()), key=at)
    ids, n, deviations, w, explained = brute.whitened(rows)
    k = w.shape[1]
    want = sorted(((i, c + 1, n, d, w[r, c]) for r, (i, d) in enumerate(zip(ids, deviations, strict=True)) for c in range(k)), key=at)
    assert [r[:4] for r in got] == [r[:4] for r in want]
    found, true = (np.array([r[4] for r in x]).reshape(k, -1) for x in (got, want))
    np.testing.assert_allclose(found * np.sign((found * true).sum(axis=1))[:, None], true, atol=1e-9)
    got = got[:: len(ids)]
    np.testing.assert_allclose([r[5] for r in got[:k]], explained, rtol=1e-9)
    assert {r[6] for r in got} == {got[0][6]} and got[0][6] < 1e-10


def test_whitening_on_embeddings(spark, sf_dir):
    df = table(tuned(spark), sf_dir, "embeddings")
    check_whitened(df.repartition(5), [(r.vec_id, r.embedding) for r in df.collect()])


def test_whitening_of_odd_rows(spark):
    rng = np.random.default_rng(12)
    rows = [(i, v.tolist()) for i, v in enumerate(rng.normal(size=(300, 5)) * [40, 9, 3, 1, 0.2])]
    rows += [(1000, None), (1001, [1.0, None, 2.0, 0.0, 0.0]), (1002, [1.0, float("nan"), 2.0, 0.0, 0.0]), (1003, [float("inf"), 1.0, 2.0, 0.0, 0.0]), (None, [0.0] * 5), (5, rows[5][1]), (2000, rows[7][1])]
    more = [*rows, (3000, []), (3001, [1.0, 2.0])]
    df = tuned(spark).createDataFrame([(i, v, 5, "x", 0.0) for i, v in more], "vec_id long, embedding array<double>, n long, x string, component double")
    check_whitened(df.repartition(4), rows)
    assert whitening.whiten(df.limit(0)).count() == 0 and whitening.whiten(df.where("vec_id = 1000")).count() == 0
    same = whitening.whiten(df.where("vec_id = 5")).collect()
    assert [(r.vec_id, r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in same] == [(5, 1, 0, None, 0.0, 0.0)] * 8
    flat = spark.createDataFrame([(i, [float(i), 1.0, float(-i)]) for i in range(9)], "vec_id long, embedding array<float>")
    got = whitening.whiten(flat, keep=()).where("vec_id = 0").orderBy("component").collect()
    assert [r.whitened is None for r in got] == [False, True, True] and abs(got[0].explained - 1) < 1e-12
    huge = spark.createDataFrame([(1, [1e300, 0.0]), (2, [-1e300, 1.0])], "vec_id long, embedding array<double>")
    assert {r.deviation for r in whitening.whiten(huge).collect()} == {None}


@pytest.mark.parametrize("kind", ["plain", "graded", "rank", "diagonal", "equal", "cluster", "zero"])
def test_singular_values(kind):
    rng = np.random.default_rng(5)
    for d in (1, 2, 3, 7, 24, 40):
        a = rng.normal(size=(d, d))
        q, p = (np.linalg.qr(rng.normal(size=(d, d)))[0] for _ in range(2))
        a = {"plain": a * 1e150, "graded": a * 10.0 ** rng.uniform(-12, 0, size=d), "rank": a[:, : d // 2] @ rng.normal(size=(d // 2, d)), "diagonal": np.diag(rng.integers(0, 4, size=d).astype(float)), "equal": 3 * q, "zero": 0 * a,
             "cluster": q @ np.diag(np.r_[np.full(min(3, d), 5.0), rng.uniform(size=max(0, d - 3))]) @ p}[kind]
        k = min(4, d)
        s, v, total = singular_values.leading(np.linalg.qr(a, mode="r"), k)
        want = np.linalg.svd(a, compute_uv=False) ** 2
        np.testing.assert_allclose(s, want[:k], rtol=1e-11, atol=1e-13 * want[0])
        np.testing.assert_allclose(total, want.sum(), rtol=1e-11)
        np.testing.assert_allclose(v.T @ v, np.eye(k), atol=1e-12)
        np.testing.assert_allclose(a.T @ (a @ v), v * s, atol=1e-11 * max(want[0], 1e-300))


def test_small_singular_values_keep_their_digits():
    a, b = 10.0 ** -np.arange(12.0), 10.0 ** -np.arange(0.5, 11)
    found = singular_values.squared_values(a, b)
    assert abs(np.prod(found) / np.prod(a * a) - 1) < 1e-12 and found[-1] < 1e-20


# --- lines ---------------------------------------------------------------------------------------------------------
def kept(df):
    return sorted((tuple(r) for r in line_dedup.dedup_lines(df).select("doc_id", "n_lines", "n_dropped", "text").collect()), key=str)


@pytest.mark.parametrize("sent", [True, False])
def test_line_dedup(spark, sf_dir, monkeypatch, sent):
    if not sent:
        monkeypatch.setattr(line_dedup, "ARRAY_BYTES", 0)
        monkeypatch.setattr(line_dedup, "PROBES", 50)
    monkeypatch.setattr(line_dedup, "SHARD_LINES", 9)
    docs = [(r.doc_id, r.text) for r in table(tuned(spark), sf_dir, "documents").select("doc_id", "text").collect()]
    assert kept(table(spark, sf_dir, "documents")) == sorted(brute.lines_kept(docs), key=str)
    rng = random.Random(13)
    lines = [f"This line, number {i}, is long enough to count {i}" for i in range(40)] + ["short", "", "é" * 39, "É" * 40, "é" * 40, "x" * 40, "  " + "X" * 40 + "\t\r"]
    docs = [(i, t) for i, t in enumerate(ODD)] + [(100 + i, "\n".join(rng.choices(lines, k=rng.randrange(12)))) for i in range(40)]
    docs += [(None, "\n".join(lines)), (None, lines[3]), (None, lines[3]), (120, lines[4]), (120, "\n".join(lines[:9])), (7, None), docs[20], docs[20]]
    got = kept(frame(spark, docs).repartition(5))
    assert got == sorted(brute.lines_kept(docs), key=str) and sum(r[2] for r in got) > 50
    assert kept(frame(spark, docs).limit(0)) == [] and kept(frame(spark, [(1, None)])) == [(1, 1, 0, "")]
    carried = line_dedup.dedup_lines(frame(spark, docs), keep=("n", "word")).agg(F.sum("n"), F.min("word"), F.max("word")).first()
    assert tuple(carried) == (7 * len(docs), "x", "x")


def test_perfect_hash_is_minimal_and_tells_others():
    rng = np.random.default_rng(2)
    for n in (0, 1, 2, 63, 5000):
        h = np.unique(rng.integers(0, 2**63, size=(n, 2), dtype=np.uint64), axis=0)
        shard = line_dedup.build(h, np.arange(n) + 5, np.arange(n) - 3)
        if not n:
            continue
        probes = line_dedup.Probes([shard])
        assert sorted(probes.places(h, np.zeros(n, np.int64)).tolist()) == list(range(n))
        listed, keeper = probes.keeper(h, np.zeros(n, np.int64), 5)
        assert listed.all() and (keeper == np.arange(n) - 3).all()
        others = rng.integers(0, 2**63, size=(20_000, 2), dtype=np.uint64)
        assert not probes.keeper(others, np.zeros(len(others), np.int64), 5)[0].any()
        assert shard.bits.nbytes * 8 < 6 * n + 600
