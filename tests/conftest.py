import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from matchloom.plans.ordered import GROUP_LIMIT_CONF
from matchloom.session import local_session


@pytest.fixture(scope="session")
def spark():
    return local_session(4, "tests", **{"spark.sql.shuffle.partitions": "4"})


@pytest.fixture
def small_groups(spark):
    """Treats every group above seven rows as too large for one task."""
    spark.conf.set(GROUP_LIMIT_CONF, "7")
    yield
    spark.conf.unset(GROUP_LIMIT_CONF)


def rows_of(df, keys):
    pdf = df.toPandas()
    return pdf.sort_values(list(keys)).reset_index(drop=True)[sorted(pdf.columns)]


@pytest.fixture(scope="session")
def games(spark):
    """Games of two leagues; one team plays in a third of them, ties on time, some ineligible rows."""
    import random

    rng = random.Random(3)
    out = []
    for i in range(160):
        home = "hot" if rng.random() < 0.6 else f"t{rng.randrange(5)}"
        away = f"u{rng.randrange(4)}"
        day = rng.randrange(60)
        out.append(("A" if i % 4 else "B", i, f"2023-12-{1 + day % 28:02d} 00:00:00" if day < 28 else f"2024-01-{1 + day % 28:02d} 00:00:00", home, away, rng.randrange(9), rng.randrange(8), f"v{i % 3}", rng.random() < 0.7))
    df = spark.createDataFrame(out, "league string, game_id long, datetime string, home string, away string, home_score long, away_score long, venue string, training_included boolean")
    return df.selectExpr("league", "game_id", "cast(datetime as timestamp) datetime", "home", "away", "home_score", "away_score", "venue", "training_included").cache()
