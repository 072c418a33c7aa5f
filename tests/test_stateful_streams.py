import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from prismark.operators import latent, outliers
from prismark.plans import evaluation
from prismark.streaming import spectra_streams, stateful


def replayed(spark, df, schema, tmp_path, name, query, files=1):
    """The rows of a query over a folder of files that are read some at a time."""
    stream = spectra_streams.read_stream(spark, df, schema, files)
    query(stream).writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / f"check-{name}")).trigger(availableNow=True).start().awaitTermination()
    return spark.table(name).collect()


def files(spark, rows, schema, path, each):
    """Rows in files of `each`, in order: files are read in the order of their times."""
    import os

    for i in range(0, len(rows), each):
        spark.createDataFrame(rows[i : i + each], schema).coalesce(1).write.mode("append").parquet(path)
        for f in os.listdir(path):
            full = os.path.join(path, f)
            if f.endswith(".parquet") and os.path.getmtime(full) > 2_000_000_000 or not f.endswith(".parquet"):
                continue
            if os.path.getmtime(full) > 1_500_000_000:
                os.utime(full, (1_000_000_000 + i, 1_000_000_000 + i))


START = datetime.datetime(2024, 1, 1)
SPECTRA = "id long, ts timestamp, x array<double>, y double"


@pytest.fixture(scope="module")
def timed(spark):
    rng = np.random.default_rng(4)
    rows = []
    for i in range(120):
        x = rng.normal(size=6) + (5 if i == 50 else 0)
        rows.append((i, START + datetime.timedelta(minutes=0.5 * i), x.tolist(), float(x[:3].sum() + rng.normal() * 0.1 + (4 if i == 70 else 0))))
    # Within the watermark's five minutes out of order.
    order = sorted(range(120), key=lambda i: i + rng.uniform(0, 8))
    return [rows[i] for i in order]


@pytest.mark.parametrize("kind", ["Leverage", "StudentizedResiduals"])
def test_windowed_detectors(spark, tmp_path, timed, kind):
    train = spark.createDataFrame(timed, SPECTRA)
    if kind == "Leverage":
        model = outliers.Leverage(latent.PCA(2).fit(train)).fit(train)
    else:
        model = outliers.StudentizedResiduals(latent.PLSRegression(2).fit(train)).fit(train)
    after = [(1000, START + datetime.timedelta(days=1), [0.0] * 6, 0.0), (1001, START + datetime.timedelta(days=3), [0.0] * 6, 0.0)]
    late = [(2000, START + datetime.timedelta(minutes=1), [9.0] * 6, 9.0)]  # a day too late
    folder = str(tmp_path / "in")
    files(spark, [*timed, *after[:1]], SPECTRA, folder, 11)
    spark.createDataFrame([*late, after[1]], SPECTRA).coalesce(1).write.mode("append").parquet(folder)
    found = {}
    for n in (1, 3, 100):
        got = replayed(spark, folder, spark.createDataFrame(timed[:1], SPECTRA).schema, tmp_path, f"{kind}{n}", lambda s: stateful.windowed_outliers(s, model, salts=3), n)
        found[n] = {r.id: (r.start, r.n, round(r.residual, 9) if r.residual is not None else None, r.outlier) for r in got if r.id < 1000}
        assert len(found[n]) == len([r for r in got if r.id < 1000])
    assert set(found[1]) == set(range(120)) and found[1] == found[3]
    assert 2000 not in {r.id for r in spark.table(f"{kind}1").collect()}
    # By hand, window by window.
    for w in range(6):
        rows = train.where((F.col("ts") >= F.lit(START + datetime.timedelta(minutes=10 * w))) & (F.col("ts") < F.lit(START + datetime.timedelta(minutes=10 * w + 10))))
        for r in model.transform(rows).collect():
            start, n, value, flag = found[1][r.id]
            assert n == 20 and abs(value - r.residual) < 1e-6 and flag == r.outlier


def test_streaming_as_of(spark, tmp_path, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "user_id", F.col("ts").cast("timestamp").alias("ts"), "event_type", "value")
    rows = [tuple(r) for r in e.orderBy("ts").collect()]
    rng = np.random.default_rng(8)
    # Up to half an hour out of order, within a watermark of an hour.
    rows.sort(key=lambda r: r[2].timestamp() + rng.uniform(0, 1800))
    end = (-1, -1, rows[-1][2] + datetime.timedelta(days=9), "click", 0.0)
    folder = str(tmp_path / "events")
    files(spark, [*rows, end], e.schema, folder, 1 + len(rows) // 4)
    clicks = lambda d: d.where("event_type = 'click'").select("user_id", "ts", "event_id")
    bought = lambda d: d.where("event_type = 'purchase'").select("user_id", "ts", "value")
    want = evaluation.latest_measurement(clicks(e), bought(e).groupBy("user_id", "ts").agg(F.max("value").alias("value")), "ts", "value", "user_id")
    want = {r.event_id: (r.user_id, r.value) for r in want.collect()}
    for n in (1, 9):
        got = replayed(spark, folder, e.schema, tmp_path, f"asof{n}", lambda s: stateful.latest_measurement(clicks(s), bought(s), "ts", "value", "user_id", "1 hour"), n)
        assert len(got) == len(want) and {r.event_id: (r.user_id, r.value) for r in got} == want
