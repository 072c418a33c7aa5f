from pyspark.sql import functions as F

from prismark.operators import latent, outliers, scatter
from prismark.streaming import spectra_streams


def test_stream_gives_what_a_batch_gives(spark, tmp_path):
    df = spark.range(60).select("id", F.timestamp_seconds(F.col("id") * 60).alias("ts"), F.transform(F.sequence(F.lit(1), F.lit(5)), lambda i: (i * F.col("id") % 7 + i * i).cast("double")).alias("x"))
    path = str(tmp_path / "in")
    df.repartition(3).write.parquet(path)
    snv = scatter.StandardNormalVariate()
    stream = spectra_streams.transformed(spectra_streams.read_stream(spark, path, df.schema), [snv])
    stream.writeStream.format("memory").queryName("snv").trigger(availableNow=True).start().awaitTermination()
    batch = {r.id: r.x for r in snv.transform(df).collect()}
    assert {r.id: r.x for r in spark.table("snv").collect()} == batch

    summary = spectra_streams.window_summary(spectra_streams.read_stream(spark, path, df.schema))
    summary.writeStream.format("memory").queryName("windows").outputMode("complete").trigger(availableNow=True).start().awaitTermination()
    assert sorted((r.n for r in spark.table("windows").collect())) == [10] * 6

    leverage = outliers.Leverage(latent.PCA(2).fit(df)).fit(df)
    spectra_streams.batch_scored(spectra_streams.read_stream(spark, path, df.schema), leverage.transform, str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 60
