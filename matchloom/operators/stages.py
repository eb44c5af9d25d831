"""Named feature stages: DataFrame -> DataFrame functions applied in order."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matchloom.operators import form, harmonise


def _sides(games: DataFrame, build: Callable[[DataFrame], DataFrame], names: Sequence[str]) -> DataFrame:
    rows = build(form.team_rows(games))
    wide = form.game_differences(rows, names).drop("league")
    return games.join(wide, "game_id", "left")


def rest(games: DataFrame) -> DataFrame:
    return _sides(games, lambda r: form.rest_days(r, None), ["rest_days"])


def recent(games: DataFrame) -> DataFrame:
    return _sides(games, lambda r: form.rolling_form(r, (5, 10), neutral=False), ["pts_5", "pts_10", "gd_5", "gd_10"])


def shots(games: DataFrame) -> DataFrame:
    """A no-op where shot columns are absent."""
    return harmonise.shot_efficiency(games) if "shots_home" in games.columns else games


STAGES: dict[str, Callable[[DataFrame], DataFrame]] = {
    "ratings_only": lambda games: games, "rest_days": rest, "recent_form": recent, "head_to_head": form.head_to_head, "shot_efficiency": shots,
}


def apply_stages(games: DataFrame, names: Sequence[str]) -> DataFrame:
    """Apply stages by name; ``all`` means every stage, an unknown name raises."""
    for name in [n for x in names for n in (STAGES if x == "all" else [x])]:
        if name not in STAGES:
            raise KeyError(f"unknown feature stage: {name}")
        games = games.transform(STAGES[name])
    return games
