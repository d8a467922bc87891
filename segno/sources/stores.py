"""Finding inputs, what is stored between runs, a check of the setup, and the SQL surface."""

from __future__ import annotations

import os
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from segno.sources.tables import table

#: The variable that names a play log's export, and what exports are called.
CSV_VARIABLE, CSV_PATTERN = "MUSIC_HISTORY_CSV", "recenttracks-*.csv"
#: The input tables, and the columns without which each is of no use.
TABLES = {
    "plays": ("username", "uts", "artist", "album", "track"), "artists": ("artist_id", "name"), "critic_lists": ("list_id", "critic", "year", "albums"),
    "releases": ("id", "artist_norm", "title_norm", "year"), "release_genres": ("release_id", "genre", "count"), "release_labels": ("release_id", "label_name"), "embeddings": ("vec_id", "embedding"),
}
#: Tables that queries can do without.
OPTIONAL = {"release_genres", "release_labels", "embeddings"}


def find_export(folder: str | Path = ".", variable: str = CSV_VARIABLE) -> Path | None:
    """The export that the environment names, if it exists, else the last by name in a folder; None without any."""
    named = os.environ.get(variable)
    if named and Path(named).exists():
        return Path(named)
    return max(Path(folder).glob(CSV_PATTERN), default=None, key=lambda p: p.name)


def save_space(vectors: DataFrame, folder: str, **config: object) -> str:
    """Write a space of vectors under a name that tells its settings; gives the path."""
    path = f"{folder}/" + "-".join(f"{k}_{config[k]}" for k in sorted(config))
    vectors.write.mode("overwrite").parquet(path)
    return path


def load_space(spark: SparkSession, folder: str, **config: object) -> DataFrame | None:
    """The space saved with these settings, or None."""
    path = f"{folder}/" + "-".join(f"{k}_{config[k]}" for k in sorted(config))
    fs_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    exists = fs_path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(fs_path)
    return spark.read.parquet(path) if exists else None


def save_run(metrics: DataFrame, folder: str, run: str) -> None:
    """Append an evaluation (metric, value) under a name to the runs kept in a folder; a run saved again takes the place of the old one."""
    rows = metrics.select("metric", F.col("value").cast("double").alias("value")).coalesce(1)
    rows.write.mode("overwrite").parquet(f"{folder}/run={run}")


def load_runs(spark: SparkSession, folder: str) -> DataFrame:
    """(run, metric, value) of all saved runs."""
    return spark.read.option("basePath", folder).schema("metric string, value double, run string").parquet(folder).select("run", "metric", "value")


def release_years(albums: DataFrame, cache: DataFrame, found: DataFrame) -> DataFrame:
    """(artist, album, year, source): years of albums from a cache, by id and else by name, then from the releases found.

    ``albums`` has artist, album, album_mbid; ``cache`` has key and year, a
    key being an id, or artist and album in lower case joined by three bars;
    ``found`` has artist, album, year.  Albums that nothing knows have no year.
    """
    known = cache.where("key IS NOT NULL AND year IS NOT NULL").groupBy("key").agg(F.max("year").alias("y"))
    by_id = known.select(F.col("key").alias("_id"), F.col("y").alias("_a"))
    by_name = known.select(F.col("key").alias("_name"), F.col("y").alias("_b"))
    keyed = albums.withColumns({"_i": F.when(F.col("album_mbid") != "", F.col("album_mbid")), "_n": F.concat_ws("|||", F.lower("artist"), F.lower("album"))})
    met = keyed.join(by_id, F.col("_i") == F.col("_id"), "left").join(by_name, F.col("_n") == F.col("_name"), "left")
    dated = met.join(found.groupBy("artist", "album").agg(F.min("year").alias("_c")), ["artist", "album"], "left")
    source = F.when(F.col("_a").isNotNull(), "cache by id").when(F.col("_b").isNotNull(), "cache by name").when(F.col("_c").isNotNull(), "releases")
    return dated.select("artist", "album", F.coalesce("_a", "_b", "_c").cast("bigint").alias("year"), source.alias("source"))


def as_json(df: DataFrame) -> DataFrame:
    """One column ``json``: each row as an object, keys in order, nulls kept."""
    columns = sorted(df.columns)
    return df.select(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}).alias("json"))


def check_setup(spark: SparkSession, folder: str) -> DataFrame:
    """(name, status, details): per input table ok with its rows, missing, or optional where queries can do without it; columns that lack are missing."""
    out = []
    for name, columns in TABLES.items():
        absent = "optional" if name in OPTIONAL else "missing"
        try:
            df = table(spark, folder, name)
        except Exception as e:  # noqa: BLE001 - whatever keeps a table from being read is what is reported
            out.append((name, absent, f"not read: {type(e).__name__}"))
            continue
        lacking = sorted(set(columns) - set(df.columns))
        out.append((name, absent, f"without {', '.join(lacking)}") if lacking else (name, "ok", f"{df.count()} rows"))
    return spark.createDataFrame(out, "name string, status string, details string")


def register_views(spark: SparkSession, folder: str) -> list[str]:
    """Make the input tables that are there temporary views, for queries in SQL; gives their names."""
    made = []
    for r in check_setup(spark, folder).where("status = 'ok'").select("name").collect():
        table(spark, folder, r["name"]).createOrReplaceTempView(r["name"])
        made.append(r["name"])
    return made
