"""The canonical play log and its sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Columns of an exported play log.
CSV_SCHEMA = T.StructType([T.StructField("uts", T.LongType())] + [T.StructField(c, T.StringType()) for c in ("utc_time", "artist", "artist_mbid", "album", "album_mbid", "track", "track_mbid")])


def with_time(plays: DataFrame, uts: str = "uts") -> DataFrame:
    """Add ``ts`` and year, month, day, hour, weekday in UTC; rows without ``uts`` are left out; null album and ids become ""."""
    ts = F.timestamp_seconds(F.col(uts))
    out = plays.where(F.col(uts).isNotNull()).withColumn("ts", ts)
    for c in ("album", "artist_mbid", "album_mbid", "track_mbid"):
        if c in out.columns:
            out = out.withColumn(c, F.coalesce(F.col(c), F.lit("")))
    parts = {"year": F.year("ts"), "month": F.month("ts"), "day": F.dayofmonth("ts"), "hour": F.hour("ts")}
    return out.withColumns({k: v.cast("bigint") for k, v in parts.items()} | {"weekday": F.date_format("ts", "EEEE")})


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """Play log exports: CSV files with a header; the listener is the file's name without its ending."""
    raw = spark.read.csv(path, header=True, schema=CSV_SCHEMA, multiLine=True, escape='"')
    return with_time(raw.withColumn("username", F.regexp_replace(F.regexp_extract(F.input_file_name(), r"([^/]+)$", 1), r"\.csv$", "")))


def read_stream_history(spark: SparkSession, path: str, least_ms: int = 30_000) -> DataFrame:
    """Streaming-service exports (JSON arrays) as a play log: skipped and short plays and those without track are left out; sorted by time within partitions."""
    raw = spark.read.json(path, multiLine=True, schema="ts string, ms_played bigint, skipped boolean, shuffle boolean, reason_start string, reason_end string, platform string, conn_country string, master_metadata_track_name string, master_metadata_album_artist_name string, master_metadata_album_album_name string")
    return stream_to_plays(raw, least_ms)


def stream_to_plays(raw: DataFrame, least_ms: int = 30_000) -> DataFrame:
    kept = raw.where(F.col("master_metadata_track_name").isNotNull() & (F.coalesce("ms_played", F.lit(0)) >= least_ms) & ~F.coalesce("skipped", F.lit(False)))
    uts = F.unix_timestamp(F.to_timestamp("ts"))
    blank: Column = F.lit("")
    return kept.select(
        uts.alias("uts"), F.date_format(F.timestamp_seconds(uts), "dd MMM yyyy, HH:mm").alias("utc_time"), F.col("master_metadata_album_artist_name").alias("artist"), blank.alias("artist_mbid"),
        F.coalesce("master_metadata_album_album_name", blank).alias("album"), blank.alias("album_mbid"), F.col("master_metadata_track_name").alias("track"), blank.alias("track_mbid"),
        "ms_played", F.coalesce("shuffle", F.lit(False)).alias("shuffle"), "reason_start", "reason_end", "platform", "conn_country", F.lit("stream").alias("source"),
    ).sortWithinPartitions("uts")


def write_csv(plays: DataFrame, path: str, keep: Column | None = None) -> tuple[int, int]:
    """Write a play log, of which rows for which ``keep`` is true; gives how many rows were read and kept, counted while they are written."""
    counts = Observation()
    keep = F.lit(True) if keep is None else F.coalesce(keep, F.lit(False))
    seen = plays.withColumn("_keep", keep).observe(counts, F.count(F.lit(1)).alias("read"), F.count_if("_keep").alias("kept"))
    seen.where("_keep").drop("_keep").write.mode("overwrite").csv(path, header=True, quoteAll=True)
    return counts.get["read"], counts.get["kept"]


def read_critic_json(spark: SparkSession, path: str) -> DataFrame:
    """Ranked lists from files ``critics-YYYY.json``; a list without a year takes the file's."""
    album = "array<struct<artist:string,title:string,rank:int,artist_url:string,album_url:string>>"
    raw = spark.read.json(path, multiLine=True, schema=f"critic string, publication string, url string, title string, year int, albums {album}")
    return raw.withColumn("year", F.coalesce("year", F.expr("try_cast(nullif(regexp_extract(input_file_name(), '-(\\\\d{4})\\\\.json', 1), '') AS int)")))


def picks(lists: DataFrame) -> DataFrame:
    """(list_id, critic, publication, year, artist, title, rank, place): a row per listed album."""
    return lists.select("list_id", "critic", "publication", F.col("year").cast("bigint").alias("year"), F.posexplode("albums").alias("place", "a")).select(
        "list_id", "critic", "publication", "year", F.col("a.artist").alias("artist"), F.col("a.title").alias("title"), F.col("a.rank").cast("bigint").alias("rank"), F.col("place").cast("bigint").alias("place")
    )


_NAMED = "id: string, name: string"
_DUMP = f"""id string, title string, date string, country string, `text-representation` struct<language: string>,
 `artist-credit` array<struct<name: string, joinphrase: string, artist: struct<{_NAMED}>>>,
 `release-group` struct<`primary-type`: string, `secondary-types`: array<string>>, tags array<struct<name: string, count: bigint>>,
 `label-info` array<struct<`catalog-number`: string, label: struct<{_NAMED}>>>, _bad string"""


def read_dump(spark: SparkSession, path: str) -> DataFrame:
    """A metadata dump, one JSON object a line; lines that aren't one are skipped."""
    raw = spark.read.json(path, schema=_DUMP.replace("\n", ""), mode="PERMISSIVE", columnNameOfCorruptRecord="_bad")
    return raw.where("_bad IS NULL").drop("_bad")


def release_tables(dump: DataFrame) -> dict[str, DataFrame]:
    """The three tables of a dump: releases, release_genres (release_id, genre, count) and release_labels (release_id, label_name, catalog_number), of releases with title and credit."""
    rows = release_rows(dump)
    kept = dump.join(rows.select("id"), "id", "left_semi")
    named = lambda df, c: df.where(F.coalesce(c, F.lit("")) != "")
    tags = kept.select(F.col("id").alias("release_id"), F.explode("tags").alias("t"))
    genres = named(tags, F.col("t.name")).select("release_id", F.col("t.name").alias("genre"), F.coalesce("t.count", F.lit(0)).cast("bigint").alias("count"))
    info = kept.select(F.col("id").alias("release_id"), F.explode("label-info").alias("i"))
    labels = named(info, F.col("i.label.name")).select("release_id", F.col("i.label.name").alias("label_name"), F.col("i.catalog-number").alias("catalog_number"))
    return {"releases": rows, "release_genres": genres, "release_labels": labels}


def release_rows(dump: DataFrame) -> DataFrame:
    """Releases from a nested metadata dump: a row per release with title and credit.

    The year is the first four characters of the date if from 1900 to 2030;
    the type is the first secondary type, else the primary one, in lower case;
    genres are the tags by falling count.
    """
    credit = F.array_join(F.transform("artist-credit", lambda c: F.concat(F.coalesce(c["name"], c["artist"]["name"]), F.coalesce(c["joinphrase"], F.lit("")))), "")
    year = F.expr("try_cast(substring(date, 1, 4) AS int)")
    tags = F.transform(F.array_sort(F.coalesce("tags", F.array()), lambda a, b: F.when(a["count"] > b["count"], -1).when(a["count"] < b["count"], 1).otherwise(0)), lambda t: t["name"])
    group = F.col("release-group")
    out = dump.select(
        "id", credit.alias("artist_credit"), "title", F.when(year.between(1900, 2030), year).alias("year"), F.col("artist-credit")[0]["artist"]["id"].alias("artist_mbid"),
        F.lower(F.coalesce(F.try_element_at(group["secondary-types"], F.lit(1)), group["primary-type"])).alias("release_type"), "country", tags.alias("genres"),
        F.filter(F.transform(F.coalesce("label-info", F.array()), lambda i: i["label"]["name"]), lambda n: n.isNotNull()).alias("labels"),
    )
    named = out.where((F.coalesce("title", F.lit("")) != "") & (F.coalesce("artist_credit", F.lit("")) != ""))
    return named.withColumns({"artist_norm": F.lower(F.trim("artist_credit")), "title_norm": F.lower(F.trim("title"))})
