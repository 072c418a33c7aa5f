"""Each stage of the pipeline on what the stage before has kept, against plain versions; and queries with SQL against DuckDB."""

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from prismark.llm import queries
from prismark.llm.common import materialise, table, tuned
from tests.llm import brute
from tests.llm.test_text_operators import check_packed


def pairs(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


def test_stages(spark, sf_dir):
    docs = table(tuned(spark), sf_dir, "documents")
    extra = spark.createDataFrame([(5000, None, "en", "s", 0), (5001, "", None, None, None), (None, docs.first().text + " tail", "en", "s", 3)], docs.schema)
    given = materialise(docs.unionByName(extra).unionByName(docs.limit(1)).withColumn("kept_id", F.lit(1)), "given")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["language ID", "quality classifier", "near duplicates", "decontamination", "packing"]
    labels = {r.doc_id: r.quality for r in table(spark, sf_dir, "labels").collect()}
    now = given
    for name, stage in corpus_pipeline.STAGES:
        before, now = now, materialise(stage(spark, now, sf_dir), "stage")
        if name == "packing":
            check_packed(now.collect(), pairs(before))
            break
        assert set(docs.columns) <= set(now.columns)
        was, kept = dict(pairs(before)), dict(pairs(now))
        assert all(was[i] == t for i, t in kept.items())
        gone = set(was) - set(kept)
        if name == "language ID":
            assert gone == {5000, 5001}
        elif name == "quality classifier":
            bad = [i for i in gone if i in labels]
            assert bad and sum(labels[i] == 0 for i in bad) / len(bad) > 0.9
        elif name == "near duplicates":
            groups = brute.near_duplicates([(i, t) for i, t in was.items() if i is not None], 80)
            assert set(kept) - {None} == {i for i, (_, c) in groups.items() if i == c} and None in kept
            assert now.count() == len(kept)
        else:
            items = [tuple(r) for r in table(spark, sf_dir, "benchmark").select("item_id", "text").collect()]
            assert gone == {i for i, r in brute.decontaminate(list(was.items()), items).items() if r[4]}


def test_run_and_empty_input(spark, sf_dir):
    assert corpus_pipeline.run(spark, sf_dir).where("length > 1024 or offset < 0").count() == 0
    empty = table(spark, sf_dir, "documents").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, sf_dir).count() == 0


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_against_sql(spark, sf_dir, name):
    c = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "embeddings", "labels"):
        c.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    df = queries.QUERIES[name](spark, sf_dir)
    columns = sorted(df.columns)
    found = c.execute(queries.ORACLE_SQL[name])
    names = [d[0] for d in found.description]
    want = sorted((tuple(r[names.index(k)] for k in columns) for r in found.fetchall()), key=str)
    assert sorted(names) == columns
    assert sorted((tuple(r) for r in df.select(*columns).collect()), key=str) == want
