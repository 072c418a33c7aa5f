import hashlib
import math
import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from prismark.llm import components, decontamination, near_duplicates, packing, token_counts
from prismark.llm.common import table, tuned
from prismark.llm.tokenizing import id_coder, library, public_path, whole_tokens
from tests.llm import brute

PATH = public_path("byte_bpe_50k.json")
DOC = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("n_tokens", T.StringType()), T.StructField("bin", T.StringType())])
ODD = [None, "", " ", "\n\t", "a", "A b", "don't 123 <|endoftext|> x", "naïve Ünïcode 汉字 🙂", "x" * 5000, "word " * 30_000, "   lead\n\n  two "]


def documents(spark, sf_dir):
    return [(r.doc_id, r.text) for r in table(spark, sf_dir, "documents").select("doc_id", "text").collect()]


def odd(spark):
    rows = [(i, t, "7", "x") for i, t in enumerate(ODD)] + [(0, None, None, None), (7, ODD[7], None, None), (None, "lost id", "1", None)]
    return spark.createDataFrame(rows, DOC), rows


def test_whole_tokens_are_single():
    lib = library(PATH)
    some = sorted(whole_tokens(PATH))[::500]
    assert len(whole_tokens(PATH)) > 40_000 and all(len(e.ids) == 1 for e in lib.encode_batch(some, add_special_tokens=False))


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model"])
def test_token_counts(spark, sf_dir, name):
    path, lib = public_path(name), library(public_path(name))
    plain = (lambda t: len(lib.encode(t))) if name.endswith(".model") else (lambda t: len(lib.encode(t, add_special_tokens=False).ids))
    df, rows = odd(tuned(spark))
    got = sorted(map(tuple, token_counts.count_tokens(df, path).collect()), key=str)
    assert got == sorted(((i, len((t or "").encode()), n := plain(t or ""), n > 1024) for i, t, *_ in rows), key=str)
    if name.startswith("byte"):
        got = {r.doc_id: r.n_tokens for r in token_counts.count_tokens(table(spark, sf_dir, "documents"), path).collect()}
        assert got == {i: plain(t or "") for i, t in documents(spark, sf_dir)}


def test_token_counts_of_an_empty_table(spark):
    got = token_counts.count_tokens(odd(tuned(spark))[0].limit(0), PATH)
    assert got.columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"] and got.count() == 0


def check_packed(rows, texts, capacity=1024):
    """rows of pack() against texts, a list of (id, text)."""
    want = sorted(((i, *p) for i, t in texts for p in brute.pieces([*library(PATH).encode(t or "", add_special_tokens=False).ids, 2], capacity)), key=str)
    assert sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows), key=str) == want
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by)


def test_packing(spark, sf_dir):
    df, rows = odd(tuned(spark))
    check_packed(packing.pack(df, PATH).collect(), [(i, t) for i, t, *_ in rows])
    docs = documents(spark, sf_dir)
    many = packing.pack(table(spark, sf_dir, "documents").repartition(20), PATH, fan_in=3).collect()
    n = check_packed(many, docs)
    total = sum(r.length for r in many)
    assert n <= 1.05 * -(-total // 1024) + 1
    assert packing.pack(df.limit(0), PATH).count() == 0
    assert packing.pack(df.repartition(9), PATH, climb=1).count() == packing.pack(df, PATH).count()


def test_id_coder_is_the_library():
    lib = library(PATH)
    rng = random.Random(4)
    chars = "aé ßz 'sre1٣\n\t\r  汉🙂ǅ́%$"
    for _ in range(300):
        t = "".join(rng.choices(chars, k=30))
        assert id_coder(PATH)(t).tolist() == lib.encode(t, add_special_tokens=False).ids


def near(df, **kw):
    return {r.doc_id: (r.n_shingles, r.component_id) for r in near_duplicates.near_duplicates(df, **kw).collect()}


def test_near_duplicates_on_documents(spark, sf_dir):
    docs = documents(tuned(spark), sf_dir)
    for percent in (80, 85):
        assert near(table(spark, sf_dir, "documents"), percent=percent) == brute.near_duplicates(docs, percent)


def test_near_duplicates_groups(spark):
    """A large loose group, whose members often miss the threshold to each other, copies, and odd texts."""
    rng = random.Random(1)
    words = [f"w{i}" for i in range(3000)]
    docs = [(i, t) for i, t in enumerate(ODD)]
    for g in range(3):
        base = rng.choices(words, k=120)
        for _ in range(60):
            w = list(base)
            for _ in range(rng.choice([0, 1, 1, 2])):
                w[rng.randrange(len(w))] = rng.choice(words)
            docs.append((len(docs), " ".join(w)))
    chain = rng.choices(words, k=100)  # each like the next, far ends not
    for i in range(12):
        chain = chain[2:] + rng.choices(words, k=2)
        docs.append((1000 + i, " ".join(chain)))
    df = tuned(spark).createDataFrame([(i, t, "1", "2") for i, t in docs], DOC)
    for percent in (80, 85):
        assert near(df, percent=percent) == brute.near_duplicates(docs, percent)
    got = near_duplicates.near_duplicates(spark.createDataFrame([(None, "a b", None, None), (3, None, None, None), (3, None, None, None)], DOC)).collect()
    assert sorted(map(tuple, got), key=str) == [(3, 0, 3, True), (3, 0, 3, True), (None, 1, None, True)]
    assert near_duplicates.near_duplicates(df.limit(0)).count() == 0


def test_components_stop_as_soon_as_they_are_stars(spark, monkeypatch):
    """Edges that are stars take no step, and the last step is not made again to see that it changes nothing."""
    written, write = [], components.materialise
    monkeypatch.setattr(components, "materialise", lambda df, label: written.append(label) or write(df, label))

    def found(edges):
        written.clear()
        df = spark.createDataFrame(edges, "a long, b long")
        return {r.id: r.component for r in components.components(df).collect()}, len(written)

    assert found([(5, 1), (1, 6), (7, 2), (3, 3), (None, 4)]) == ({1: 1, 5: 1, 6: 1, 2: 2, 7: 2}, 1)
    assert found([(1, 5), (5, 9), (7, 8)]) == ({1: 1, 5: 1, 9: 1, 7: 7, 8: 7}, 2)
    assert found([]) == ({}, 1)
    rng = random.Random(3)
    edges = [(i, i + 1) for i in range(200, 260)] + [(rng.randrange(150), rng.randrange(150)) for _ in range(90)] + [(400, 300 + i) for i in range(40)]
    root = {i: i for e in edges for i in e}
    for _ in root:
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    assert found(edges)[0] == {i: root[i] for a, b in edges if a != b for i in (a, b)}


def test_near_duplicates_of_a_chain_of_groups_in_few_steps(spark, monkeypatch):
    """Groups that later rounds link are linked as components, whatever their numbers of members."""
    written, write = [], near_duplicates.materialise
    for module in (components, near_duplicates):
        monkeypatch.setattr(module, "materialise", lambda df, label: written.append(label) or write(df, label))
    rng = random.Random(8)
    words = [f"w{i}" for i in range(3000)]
    docs, chain = [], rng.choices(words, k=120)
    for g in range(12):
        chain = chain[3:] + rng.choices(words, k=3)
        for _ in range(8):
            w = list(chain)
            w[rng.randrange(len(w))] = rng.choice(words)
            docs.append((len(docs), " ".join(w)))
    df = tuned(spark).createDataFrame([(i, t, "1", "2") for i, t in docs], DOC)
    assert near(df, percent=85) == brute.near_duplicates(docs, 85)
    assert len(written) < 30  # 34 with a round for each hub and edges of classes in each


def contaminated(docs, items):
    return {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in decontamination.decontaminate(docs, items).collect()}


def test_decontamination(spark, sf_dir):
    docs = documents(tuned(spark), sf_dir)
    items = [tuple(r) for r in table(spark, sf_dir, "benchmark").select("item_id", "text").collect()]
    got = contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    assert got == brute.decontaminate(docs, items)
    rng = random.Random(5)
    words = "a b c d e f É 1 ß".split()
    docs = [(i, t) for i, t in enumerate(ODD)] + [(100 + i, " ".join(rng.choices(words, k=rng.randrange(60)))) for i in range(80)]
    items = [(0, None), (1, ""), (2, "b, C!"), (3, "don't"), (None, "É 1 ß a b c"), *((9 + i, " ".join(rng.choices(words, k=10 + i % 5))) for i in range(30))]
    items += [(50 + i, " ".join(docs[20 + i][1].split()[3:16])) for i in range(20)] + [(50, items[9][1])]
    frame = spark.createDataFrame([(i, t, "3", "b") for i, t in docs], DOC)
    bench = spark.createDataFrame(items, "item_id long, text string")
    for some in (items[:3], items):
        got = contaminated(frame, spark.createDataFrame(some, "item_id long, text string"))
        assert {k: v[:2] + v[4:] for k, v in got.items()} == {k: v[:2] + v[4:] for k, v in brute.decontaminate(docs, some).items()}
        known = [x for x in some if x[0] is not None]
        assert contaminated(frame, spark.createDataFrame(known, "item_id long, text string")) == brute.decontaminate(docs, known)
    assert contaminated(frame, bench.limit(0)) == brute.decontaminate(docs, [])
    assert contaminated(frame.limit(0), bench) == {}


def test_decontamination_tells_rows_apart_whatever_their_ids(spark):
    item = " ".join(f"q{i}" for i in range(12))
    docs = spark.createDataFrame([(1, "x y z"), (1, f"so {item} so"), (None, "clean words"), (None, item), (2, item), (2, item)], "doc_id long, text string")
    got = decontamination.decontaminate(tuned(spark).createDataFrame(docs.collect(), docs.schema), spark.createDataFrame([(7, item)], "item_id long, text string"))
    rows = sorted(((r.doc_id, r.n_words, r.n_hit, r.n_items, r.contaminated) for r in got.collect()), key=str)
    assert rows == sorted([(1, 3, 0, 0, False), (1, 14, 12, 1, True), (None, 2, 0, 0, False), (None, 12, 12, 1, True), (2, 12, 12, 1, True), (2, 12, 12, 1, True)], key=str)


def test_a_passage_of_many_items_in_many_documents(spark, tmp_path):
    """Documents that meet the same items are one group: the work is some rows for each document and item, not for each two."""
    hot, more = " ".join(f"h{i}" for i in range(10)), " ".join(f"m{i}" for i in range(12))
    items = [(i, f"{hot} {i} " + " ".join(f"q{i}x{j}" for j in range(12))) for i in range(1000)] + [(1000, more)]
    own = [f"q7x{j}" for j in range(12)]
    docs = [(i, f"a{i} {hot} b{i}" + (f" {more}" if i % 3 == 0 else "") + (" c " + " ".join(own) if i % 5000 == 0 else "")) for i in range(10_000)]
    tuned(spark).createDataFrame(docs, "doc_id long, text string").repartition(4).write.parquet(str(tmp_path / "docs"))
    frame, bench = spark.read.parquet(str(tmp_path / "docs")), spark.createDataFrame(items, "item_id long, text string")
    counted, _, met, holders = decontamination.find_contamination(frame, bench)
    assert met.count() < 2 * len(docs) and holders.count() < 15_000
    names = lambda ids: hashlib.sha256(",".join(sorted(map(str, ids))).encode()).hexdigest()
    got = contaminated(frame, bench)
    assert len(got) == len(docs)
    for i, (n_words, n_hit, n_items, sha, bad) in got.items():
        extra = (12 if i % 3 == 0 else 0) + (12 if i % 5000 == 0 else 0)
        assert (n_hit, n_items, bad) == (10 + extra, 1000 + (i % 3 == 0), True) and sha == names(range(1000 + (i % 3 == 0)))
        assert n_words == len(docs[i][1].split())


def _two_texts_of_one_id():
    a, b = (" ".join(f"{c}{i}" for i in range(60)) for c in "ab")
    return [(5, a), (5, b), (6, a + " a60"), (7, b + " b60"), (8, a), (9, b), (None, a + " a61"), (None, None), (10, "")]


def test_near_duplicates_of_repeated_and_null_ids(spark):
    df = tuned(spark).createDataFrame(_two_texts_of_one_id(), "doc_id long, text string")
    got = {(r.doc_id, r.n_shingles): (r.component_id, r.kept) for r in near_duplicates.near_duplicates(df).collect()}
    assert {i: got[i, n] for i, n in got if i in (5, 6, 7, 8, 9)} == {5: (5, True), 6: (5, False), 7: (5, False), 8: (5, False), 9: (5, False)}
    assert got[None, 57] == (None, True) and got[None, 0] == (None, True) and got[10, 0] == (10, True)
    got = near_duplicates.near_duplicates(df.unionByName(df.limit(1)).withColumn("n", F.lit("a")), by_row=True, keep=("text", "n")).collect()
    of = {k: [(r.doc_id, r.component_id, r.kept) for r in got if (r.text or "-")[0] == k] for k in "ab-"}
    kept = [(i, k) for i, _, k in of["a"]]
    assert sorted(kept, key=str) == [(5, False), (5, True), (6, False), (8, False), (None, True)]
    assert sorted(of["b"]) == [(5, 5, True), (7, 5, False), (9, 5, False)]
    assert all(k for *_, k in of["-"]) and all(r.n == "a" for r in got)


def test_sketch_limit_is_the_binomial_tail():
    for percent in (80, 85):
        d, p, n = near_duplicates.sketch_limit(percent), (1 - percent / 100) / 2, 2 * near_duplicates.PERMUTATIONS
        tail = lambda k: sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k, n + 1))
        assert tail(d + 1) <= 1e-8 < tail(d)
