"""Names that look like plain text but are written in other characters."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from segno.functions.names import Memo, plain

# Words of ASCII letters, digits and signs with single blanks between them need no look.
_ORDINARY = r"^[!-~]+( [!-~]+)*$"


def plain_names(values: DataFrame, text: str) -> DataFrame:
    """``values`` with ``plain``: the one form of ``text`` in which equal-looking names are equal.

    Accents are composed, widths and blanks ordinary, ligatures taken apart,
    invisible characters gone, and each word is spelled in one script: the
    script sets of its letters are intersected, so that mixed words and words
    made wholly of look-alikes are found.  Null stays null; blank becomes
    empty.  Names in another script, emoji and signs such as ½ stay.
    """
    kind = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in values.schema)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        memo = Memo(plain)
        for pdf in batches:
            yield pdf.assign(plain=pd.Series(memo.over(pdf[text].tolist()), index=pdf.index, dtype=object))

    return values.mapInPandas(run, kind + ", plain string")


def _suspects(values: DataFrame) -> DataFrame:
    name: Column = F.col("name")
    return values.where(name.isNotNull() & (name != "") & ~name.rlike(_ORDINARY))


def disguised(values: DataFrame) -> DataFrame:
    """(source_table, row_id, item_no, name, plain) of the names whose plain form differs from what is stored.

    ASCII names are told apart before any Python runs.  Null, empty and blank
    names are no cases.  Repeated rows are given out repeatedly.
    """
    return plain_names(_suspects(values), "name").where("plain <> name AND plain <> ''")


def disguised_names(plays: DataFrame, releases: DataFrame, critic_lists: DataFrame) -> DataFrame:
    """``disguised`` over plays.artist, releases.artist_credit and the titles in critic_lists.albums (item_no: position from 1; else 0)."""
    zero = F.lit(0).alias("item_no")
    titles = critic_lists.select(F.col("list_id").alias("row_id"), F.posexplode("albums").alias("at", "album"))
    sources = [
        plays.select(F.lit("plays").alias("source_table"), F.col("play_id").cast("bigint").alias("row_id"), zero, F.col("artist").alias("name")),
        releases.select(F.lit("releases").alias("source_table"), F.col("id").cast("bigint").alias("row_id"), zero, F.col("artist_credit").alias("name")),
        titles.select(F.lit("critic_lists").alias("source_table"), F.col("row_id").cast("bigint").alias("row_id"), (F.col("at") + 1).alias("item_no"), F.col("album.title").alias("name")),
    ]
    return disguised(reduce(DataFrame.unionByName, sources))
