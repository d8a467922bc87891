import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from segno.session import session

    s = session("tests", "local[4]", spark__sql__shuffle__partitions="4", spark__ui__enabled="false", spark__checkpoint__dir=str(tmp_path_factory.mktemp("checkpoints")), spark__driver__memory="3g")
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


PLAYS = "play_id bigint, username string, uts bigint, artist string, album string, track string, extra string"


@pytest.fixture
def plays_of(spark):
    """Plays from (username, uts, artist, album, track) tuples; play ids count from 1."""

    def make(rows):
        return spark.createDataFrame([(k, *r, "x") for k, r in enumerate(rows, 1)], PLAYS)

    return make


@pytest.fixture
def artists_of(spark):
    def make(*names):
        return spark.createDataFrame([(100 + k, n) for k, n in enumerate(names)], "artist_id bigint, name string")

    return make
