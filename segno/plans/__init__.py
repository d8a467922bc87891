"""Planning helpers: what may be broadcast, and where lineage is cut."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows up to which a keyed lookup table is broadcast; checked by counting no further than that.
BROADCAST_ROWS = 200_000


def is_small(df: DataFrame, most: int = BROADCAST_ROWS) -> bool:
    """Whether ``df`` has at most ``most`` rows; reads no more rows than needed to tell."""
    return df.limit(most + 1).count() <= most


def small_or_shuffled(df: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` hinted for broadcast if it is small; else as it is, for a shuffled join that AQE splits at hot keys."""
    return F.broadcast(df) if is_small(df, most) else df


def with_facts(df: DataFrame, facts: DataFrame, by: list[str] = [], how: str = "inner") -> DataFrame:  # noqa: B006 - never changed
    """Rows with the facts of their owner.  Without owners ``facts`` is one row, such as an ungrouped aggregate, and belongs to every row."""
    if by:
        return df.join(facts, by, how)
    return df.withColumn("_one", F.lit(1)).join(F.broadcast(facts.withColumn("_one", F.lit(1))), "_one").drop("_one")


def durable(df: DataFrame) -> DataFrame:
    """Cut lineage with a reliable checkpoint in the session's ``spark.checkpoint.dir``.

    Only a session without that setting (tests, a laptop) gets a folder of its own.
    """
    spark = df.sparkSession
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(checkpoint_dir(spark))
    return df.checkpoint(eager=True)


def checkpoint_dir(spark: SparkSession) -> str:
    """The session's shared folder; a machine's own temporary one serves a local session only, so on a cluster its lack is an error."""
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if shared:
        return shared
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
    return tempfile.mkdtemp(prefix="segno-checkpoint-")


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the session's executors, once, so that Python workers anywhere can import it."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    folder = Path(__file__).resolve().parents[1]
    shared = spark.conf.get("spark.checkpoint.dir", None) or ""  # the driver serves the file, so any folder of its own does
    place = Path(shared.removeprefix("file://")) if shared.startswith(("/", "file:///")) else Path(tempfile.mkdtemp(prefix="segno-"))
    place.mkdir(parents=True, exist_ok=True)
    target = place / f"segno-{context.applicationId}.zip"
    with zipfile.ZipFile(target, "w") as z:
        for p in sorted(folder.rglob("*.py")):
            z.write(p, p.relative_to(folder.parent))
    context.addPyFile(str(target))
    _shipped.add(context.applicationId)
