"""Loaders of the three published example datasets from a folder of CSV files, and writers of results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from prismark.sources.frames import from_wide

OUTPUTS = ("spark", "pandas", "arrow", "polars")


def given_out(df: DataFrame, set_output: str):
    """As the container asked for: a Spark frame, or a pandas, Arrow or polars table at the driver (polars must be installed)."""
    if set_output not in OUTPUTS:
        raise ValueError(f"set_output must be one of {OUTPUTS}, not {set_output!r}")
    if set_output == "polars":
        import polars

        return polars.from_arrow(df.toArrow())
    return df if set_output == "spark" else df.toPandas() if set_output == "pandas" else df.toArrow()


def numbered(rows: DataFrame) -> DataFrame:
    """rows of text files with `id`, their places from 0 in the order of files and lines, whatever the splits that the files are read in.

    Rows are counted by split (a pair of numbers for each comes to the driver) and numbered on from what is before their split.
    """
    of = rows.metadataColumn("_metadata")  # also where the table has a column of that name
    file, begin = of["file_path"], of["file_block_start"]
    placed = rows.select("*", file.alias("_file"), begin.alias("_begin"), F.monotonically_increasing_id().alias("_order"))
    counts = sorted(tuple(r) for r in placed.groupBy("_file", "_begin").count().collect())
    ahead, known = 0, []
    for f, b, n in counts:
        known.append((f, b, ahead))
        ahead += n
    before = rows.sparkSession.createDataFrame(known, "_of string, _from long, _ahead long")
    placed = placed.join(F.broadcast(before), (F.col("_file") == F.col("_of")) & (F.col("_begin") == F.col("_from")), "left")
    inside = F.row_number().over(Window.partitionBy("_file", "_begin").orderBy("_order"))
    lost = F.raise_error("the files' splits have changed between two reads").cast("long")
    place = F.coalesce(F.col("_ahead"), lost) + inside - 1
    return placed.select(place.alias("id"), *[F.col(f"`{c}`") for c in rows.columns])


def read_spectra(spark: SparkSession, path: str) -> tuple[DataFrame, list[str]]:
    """(id, x) of a CSV file with a header of axis positions, and the positions; ids are the places of rows."""
    wide = spark.read.csv(path, header=True)
    names = wide.columns
    return from_wide(numbered(wide), names), names


def _numbers(text: Column) -> Column:
    parts = F.filter(F.split(text, r"[,;\s]+"), lambda v: v != "")
    return F.transform(parts, lambda v: v.cast("double"))


def read_spectrum_files(spark: SparkSession, path: str, stream: bool = False, files_per_trigger: int = 1000) -> DataFrame:
    """(name, x) of text files that hold one spectrum each, one value a line or all in lines of commas; name is the file's. A file without
    values is an empty spectrum, a value that is no number an error. As a stream, files are read as they come.
    """
    reader = spark.readStream.option("maxFilesPerTrigger", files_per_trigger) if stream else spark.read
    rows = reader.text(path, wholetext=True)
    return rows.select(F.element_at(F.split(rows.metadataColumn("_metadata")["file_path"], "/"), -1).alias("name"), _numbers(F.col("value")).alias("x"))


def stream_spectra(spark: SparkSession, path: str, names: list[str], ts: str = "ts", files_per_trigger: int = 1) -> DataFrame:
    """(ts, x) of CSV files as they come, each with a header of a time and of axis positions `names`: spectra of a running process."""
    schema = ", ".join([f"`{ts}` timestamp", *(f"`{n}` double" for n in names)])
    rows = spark.readStream.schema(schema).option("header", True).option("maxFilesPerTrigger", files_per_trigger).csv(path)
    return from_wide(rows, names)


def read_table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return numbered(spark.read.csv(path, header=True, schema=schema))


def load_fermentation_train(spark: SparkSession, folder: str, set_output: str = "spark"):
    """(spectra, glucose)."""
    return _pair(spark, f"{folder}/train_spectra.csv", f"{folder}/train_hplc.csv", "glucose double", set_output)


def load_fermentation_test(spark: SparkSession, folder: str, set_output: str = "spark"):
    """(spectra, measurements by time)."""
    schema = "time double, glucose double, xylose double, acetic_acid double, ethanol double, furfural double"
    return _pair(spark, f"{folder}/fermentation_spectra.csv", f"{folder}/fermentation_hplc.csv", schema, set_output)


def load_coffee(spark: SparkSession, folder: str, set_output: str = "spark"):
    """(spectra, labels)."""
    return _pair(spark, f"{folder}/coffee_spectra.csv", f"{folder}/coffee_labels.csv", "labels string", set_output)


def _pair(spark: SparkSession, spectra: str, table: str, schema: str, set_output: str):
    if set_output not in OUTPUTS:
        raise ValueError(f"set_output must be one of {OUTPUTS}, not {set_output!r}")
    return given_out(read_spectra(spark, spectra)[0], set_output), given_out(read_table(spark, table, schema), set_output)
