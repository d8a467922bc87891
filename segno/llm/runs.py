"""Runs of repeated consecutive events, collapsed into one event each."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

from segno.functions.names import same_recording
from segno.operators.ordered import Rows, stitch
from segno.operators.plays import merged_plays

RUN = ["username", "first_uts", "last_uts", "n_plays", "artist_id", "base", "mark"]
_SCHEMA = "username string, first_uts bigint, last_uts bigint, n_plays bigint, artist_id bigint, base string, mark string"


def _follows(anchor, last: int, rec, uts: int, gap: int) -> bool:
    """Whether an event goes on with the run of ``anchor``: the same recording, within the session."""
    return rec is not None and anchor is not None and uts - last <= gap and rec[0] == anchor[0] and same_recording(anchor[1:], rec[1:])


def collapse_runs(plays: DataFrame, gap: int = 1800, least: int = 2) -> DataFrame:
    """Runs of one recording in plays in order: (username, first_uts, last_uts, n_plays, duration, artist_id, base, mark).

    ``plays`` are ``merged_plays``: partitions sorted by listener, time and
    play.  A run goes on while the next play in order is the same recording as
    the run's first one (its anchor; a slip of a letter is tolerated) and no
    more than ``gap`` seconds later.  Plays without a recording end a run and
    start none.  Runs of fewer than ``least`` plays are left out.  Runs at a
    partition's ends are joined in a second pass over those alone.
    """

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out = Rows([*RUN, "open"])
        name, anchor, run, first_entity, at_start, last = None, None, None, True, True, 0

        def finish(at_end: bool) -> None:
            # a run at a partition's end may go on in the neighbour, whatever its length
            is_open = (at_start and first_entity) or at_end
            if run is not None and (is_open or (anchor is not None and run[3] >= least)):
                out.rows.append((*run, *(anchor or (None, None, None)), is_open))

        for pdf in batches:
            artists = [None if a != a else a for a in pdf["artist_id"].tolist()]
            for user, uts, artist, base, mark in zip(pdf["username"].tolist(), pdf["uts"].tolist(), artists, pdf["base"].tolist(), pdf["mark"].tolist(), strict=True):
                rec = None if artist is None or base is None else (int(artist), base, mark)
                if run is not None and user == name and _follows(anchor, last, rec, uts, gap):
                    run[2], run[3] = uts, run[3] + 1
                else:
                    finish(False)
                    if user != name:
                        first_entity, at_start = name is None, True
                    else:
                        at_start = False
                    name, anchor, run = user, rec, [user, uts, uts, 1]
                last = uts
            if out.full():
                yield out.frame()
        finish(True)
        if out.rows:
            yield out.frame()

    def join(pdf: pd.DataFrame) -> pd.DataFrame:
        out, run = Rows(RUN), None
        pdf = pdf.sort_values(["first_uts", "last_uts"], kind="stable")
        for user, first, last, n, artist, base, mark in pdf[RUN].itertuples(index=False):
            rec = None if artist != artist or artist is None else (int(artist), base, mark)
            if run is not None and _follows(run[4], run[2], rec, first, gap):
                run[2], run[3] = last, run[3] + n
                continue
            if run is not None and run[4] is not None and run[3] >= least:
                out.rows.append((*run[:4], *run[4]))
            run = [user, first, last, n, rec]
        if run is not None and run[4] is not None and run[3] >= least:
            out.rows.append((*run[:4], *run[4]))
        return out.frame()

    scanned = plays.mapInPandas(scan, _SCHEMA + ", open boolean")
    runs = stitch(scanned, "username", join, _SCHEMA)
    return runs.selectExpr("username", "first_uts", "last_uts", "n_plays", "last_uts - first_uts AS duration", "artist_id", "base", "mark")


def repeated_plays(plays: DataFrame, artists: DataFrame, gap: int = 1800) -> DataFrame:
    """Each longest stretch of two or more plays of one recording next to each other within a session."""
    return collapse_runs(merged_plays(plays, artists), gap)
