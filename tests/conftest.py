import sys
from pathlib import Path

import pytest

sys.path[:0] = [str(Path(__file__).resolve().parent.parent), str(Path(__file__).resolve().parent)]

from courtledger.session import build_session  # noqa: E402
from helpers import utc  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = build_session(
        "courtledger-tests",
        "local[8]",
        spark__sql__shuffle__partitions="4",
        spark__ui__enabled="false",
        spark__ui__showConsoleProgress="false",
        spark__driver__memory="4g",
        spark__checkpoint__dir=str(tmp_path_factory.mktemp("checkpoints")),
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


GAMES = (
    "period string, game_id bigint, home_team string, home_score int, away_team string, "
    "away_score int, game_time timestamp"
)


@pytest.fixture(scope="session")
def games(spark):
    """Build a games frame from (home, score, away, score, time[, id]) tuples."""

    def build(rows, period="season-15-16"):
        full = [
            (period, row[5] if len(row) > 5 else n, *row[:4], utc(row[4]))
            for n, row in enumerate(rows, start=1)
        ]
        return spark.createDataFrame(full, GAMES)

    return build
