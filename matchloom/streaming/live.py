"""Structured Streaming forms of the ledger, change, rating, routing and settlement operators.

All but the stateless filter hold a key's rows until event time has passed them (``held``), so their rows do not depend on
how the input is dealt to files or in which order these come. ``hold`` is how late a row may be; rows beyond it leave in
the same output with ``late`` set and without results. State is bounded: what waits within the hold, and per operator the
last observation of each kind, a rating per team, at most 120 rows of forecast history, or the counts of one window.
"""

from __future__ import annotations

import json
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from matchloom.operators import harmonise, rating, routing
from matchloom.operators.context import row_events
from matchloom.streaming.held import NEVER, Clock, InOrder, held, milliseconds, packed, shaped, unpacked

DAY = 86_400


def on_time(out: DataFrame) -> DataFrame:
    return out.filter("not late").drop("late")


def late_count(out: DataFrame) -> DataFrame:
    """One row: how many rows went to the side."""
    return out.filter("late").agg(F.count(F.lit(1)).alias("late_rows"))


def split_late(observations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(usable, late): rows known by their forecast time, and the others for a side table."""
    ok = harmonise.pit_usable(F.col("available_at"), F.col("prediction_time"))
    return observations.filter(ok), observations.filter(~ok)


class Snapshots(InOrder):
    def take(self, key, rows, now):
        # All rows of a forecast time share a slot, so the last of them is known here.
        last = rows.drop_duplicates([self.when], keep="last")
        yield shaped(last.reset_index(drop=True), self.names, False)


def deduplicated(snapshots: DataFrame, hold: str = "2 hours", order: Sequence[str] = (), slot_seconds: int = 3600, clock: Clock | None = None) -> DataFrame:
    """The last row by ``order`` of each (game_id, prediction_time), and ``late``."""
    schema = T.StructType([*snapshots.schema.fields, T.StructField("late", T.BooleanType())])
    processor = Snapshots("prediction_time", ["prediction_time", *order], snapshots.columns, slot_seconds)
    return held(snapshots, ["game_id"], "prediction_time", hold, processor, schema, clock)


class SlidingCounts(InOrder):
    """Counts by slide; a window is closed by the timer of its end, whether or not its last slides hold rows."""

    def __init__(self, when, names, slide_seconds, slides):
        super().__init__(when, [when], names, slide_seconds)
        self.slides = slides

    def open(self, handle):
        self.counts = handle.getValueState("counts", "slides string, closed long")

    def after(self, key, rows, now):
        kept, closed = self.counts.get() if self.counts.exists() else ("{}", NEVER)
        counts = {int(k): n for k, n in json.loads(kept).items()}
        if rows is not None:
            for slide, n in (milliseconds(rows[self.when]) // self.slot).value_counts().items():
                counts[int(slide)] = counts.get(int(slide), 0) + int(n)
        if not counts:
            return
        # A window ends with each slide from the first with rows to the last window that any of them is part of.
        last = min(now // self.slot - 1, max(counts) + self.slides - 1)
        out = []
        for end in range(max(closed + 1, min(counts)), last + 1):
            n = sum(counts.get(end - k, 0) for k in range(self.slides))
            if n:
                out.append(((end - self.slides + 1) * self.slot, (end + 1) * self.slot, n))
        closed = max(closed, last)
        counts = {k: n for k, n in counts.items() if k + self.slides - 1 > closed}
        self.counts.update((json.dumps(counts), closed))
        if counts:
            self.handle.registerTimer((closed + 2) * self.slot)
        if out:
            start, end, n = zip(*out)
            stamp = lambda ms: pd.to_datetime(pd.Series(ms), unit="ms")
            yield pd.DataFrame({"start": stamp(start), "end": stamp(end), "key": key[0], "n": n})[self.names].assign(late=False)


def sliding_counts(
    events: DataFrame, key: str, when: str, width_seconds: int = 7 * DAY, slide_seconds: int = DAY, hold: str = "0 seconds", clock: Clock | None = None
) -> DataFrame:
    """Counts (start, end, key, n, late) of the sliding windows that hold rows, each once its end has passed; a late row has no count."""
    if width_seconds % slide_seconds:
        raise ValueError("a window is a whole number of slides")
    rows = events.select(F.col(key).alias("key"), F.col(when).alias("at"))
    of = events.schema[key].dataType.simpleString()
    processor = SlidingCounts("at", ["start", "end", "key", "n"], slide_seconds, width_seconds // slide_seconds)
    return held(rows, ["key"], "at", hold, processor, f"start timestamp, end timestamp, key {of}, n long, late boolean", clock).withColumnRenamed("key", key)


class Settlement(InOrder):
    """Forecasts wait until results within reach can no longer come; results wait as long after they are published.

    The key is a bucket of games, so that state is read and written for many games at once.
    """

    def __init__(self, when, names, wait_ms, reach_ms):
        super().__init__(when, [when, "game_id"], names, 1)
        self.wait_ms, self.reach_ms = wait_ms, reach_ms

    def open(self, handle):
        self.results = handle.getValueState("results", "known binary")

    def due(self, rows):
        # A forecast is settled when results of its whole reach have passed; a result is filed as soon as it has passed.
        return milliseconds(rows[self.when]) + rows["is_result"].map({True: 0, False: self.reach_ms}).astype("int64") + 1

    def take(self, key, rows, now):
        rows = rows.assign(at=milliseconds(rows[self.when]))
        known = rows[rows["is_result"]][["game_id", "at", "home_score", "away_score"]]
        if self.results.exists():
            known = pd.concat([unpacked(self.results.get()[0]), known], ignore_index=True)
        # A forecast that could still use a result leaves no later than twice the reach after it.
        stay = known[known["at"] + 2 * self.reach_ms > now].reset_index(drop=True)
        self.results.update((packed(stay),)) if len(stay) else self.results.clear()
        ledger = rows[~rows["is_result"]].reset_index(drop=True).reset_index(names="place")
        both = ledger[["place", "game_id", self.when, "at"]].merge(known, on="game_id", suffixes=("", "_published"))
        lag = both["at_published"] - both["at"]
        first = both[(lag >= self.wait_ms) & (lag <= self.reach_ms)].sort_values(["place", "at_published", "home_score", "away_score"]).drop_duplicates("place")
        if len(first):
            first = first.assign(published_at=pd.to_datetime(first["at_published"], unit="ms"))
            yield shaped(first.reset_index(drop=True), self.names, False)


def settled(
    ledger: DataFrame, results: DataFrame, wait_hours: int = 5, reach_hours: int = 48, hold: str = "0 seconds", buckets: int = 256, clock: Clock | None = None
) -> DataFrame:
    """Forecasts (game_id, datetime) with their first result published ``wait_hours`` to ``reach_hours`` after the start.

    Columns: ``game_id, datetime, published_at, home_score, away_score, late, actual``; forecasts without a result give no
    row. Of results at the same instant the lowest score counts, in every layout.
    """
    if wait_hours > reach_hours:
        raise ValueError("the wait ends before the reach")
    score = lambda c: F.col(c).cast("double").alias(c)
    nothing = [F.lit(None).cast("double").alias(c) for c in ("home_score", "away_score")]
    both = ledger.select("game_id", "datetime", *nothing, F.lit(False).alias("is_result")).unionByName(
        results.select("game_id", F.col("published_at").alias("datetime"), score("home_score"), score("away_score"), F.lit(True).alias("is_result"))
    )
    of = ledger.schema["game_id"].dataType.simpleString()
    processor = Settlement("datetime", ["game_id", "datetime", "published_at", "home_score", "away_score"], 3_600_000 * wait_hours, 3_600_000 * reach_hours)
    schema = f"game_id {of}, datetime timestamp, published_at timestamp, home_score long, away_score long, late boolean"
    dealt = both.withColumn("bucket", F.pmod(F.xxhash64("game_id"), F.lit(buckets)))
    out = held(dealt, ["bucket"], "datetime", hold, processor, schema, clock)
    return out.withColumn("actual", F.when(~F.col("late"), harmonise.outcome(F.col("home_score"), F.col("away_score"))))


class Changes(InOrder):
    """Change events against the last observation of the kind; a game without news for ``idle`` is forgotten."""

    def __init__(self, when, order, names, slot_seconds, tie, idle_seconds):
        super().__init__(when, order, names, slot_seconds)
        self.tie, self.idle = tie, 1000 * idle_seconds

    def open(self, handle):
        self.last = handle.getMapState("last", "kind string", "state string, value string")
        self.ends = handle.getValueState("ends", "at long")

    def after(self, key, rows, now):
        if rows is not None:
            yield from self.take(key, rows, now)
        elif self.ends.exists() and self.ends.get()[0] + self.slot <= now:
            self.last.clear(), self.ends.clear()

    def take(self, key, rows, now):
        seen = {kind[0]: pair for kind, pair in self.last.iterator()}
        ends, out = self.ends.get()[0] if self.ends.exists() else None, []
        for row, at in zip(rows.itertuples(index=False), milliseconds(rows[self.when]).tolist()):
            if ends is not None and at > ends:
                seen.clear()
            ends = at + self.idle
            state = None if row.state is None else row.state.upper()
            out += [(getattr(row, self.tie), key[0], event) for event in row_events(row.kind, seen.get(row.kind), state, row.value)]
            seen[row.kind] = (state, row.value)
        self.last.clear()
        for kind, pair in seen.items():
            self.last.updateValue((kind,), pair)
        self.ends.update((ends,))
        self.handle.registerTimer(ends + self.slot)
        if out:
            yield pd.DataFrame(out, columns=self.names).assign(late=False)


def change_stream(observations: DataFrame, tie: str = "event_id", hold: str = "2 hours", idle_days: int = 400, slot_seconds: int = 3600, clock: Clock | None = None) -> DataFrame:
    """Change events (tie, game_id, event, late) per game; rows not known by their forecast time never count.

    Games without an observation for ``idle_days`` of event time leave the state; a later observation counts as their first.
    """
    usable, _ = split_late(observations)
    rows = usable.select(tie, "game_id", "prediction_time", "available_at", "kind", "state", "value")
    ids = [rows.schema[c].dataType.simpleString() for c in (tie, "game_id")]
    order = ["prediction_time", "available_at", tie]
    processor = Changes("prediction_time", order, [tie, "game_id", "event"], slot_seconds, tie, idle_days * DAY)
    return held(rows, ["game_id"], "prediction_time", hold, processor, f"{tie} {ids[0]}, game_id {ids[1]}, event string, late boolean", clock)


class Ratings(InOrder):
    """Predict, then update; of a league's ratings only those of a game's teams are read and written."""

    def __init__(self, when, order, names, slot_seconds, rule):
        super().__init__(when, order, names, slot_seconds)
        self.rule = rule

    def open(self, handle):
        self.teams = handle.getMapState("teams", "team string", "rating double, season long")
        self.season = handle.getValueState("season", "year long, number long")

    def take(self, key, rows, now):
        rule, touched, out = self.rule, {}, []
        year, number = self.season.get() if self.season.exists() else (None, 0)

        def rating_of(team):
            if team not in touched:
                touched[team] = self.teams.getValue((team,)) if self.teams.containsKey((team,)) else (rule.start, number)
            value, since = touched[team]
            touched[team] = (rating.carried(rule, value, number - since), number)
            return touched[team][0]

        for row in rows.itertuples(index=False):
            if year is not None and row.season != year:
                number += 1
            year = int(row.season)
            home, away = rating_of(row.home), rating_of(row.away)
            expected, change = rating.game_update(rule, home, away, row.home_score, row.away_score)
            out.append((key[0], row.game_id, home, away, expected))
            if row.live:
                touched[row.home], touched[row.away] = (home + change, number), (away - change, number)
        for team, pair in touched.items():
            self.teams.updateValue((team,), (float(pair[0]), int(pair[1])))
        self.season.update((year, number))
        yield pd.DataFrame(out, columns=self.names).assign(late=False)


RATED = ("elo_home", "elo_away", "elo_expected")


def rating_stream(games: DataFrame, rule: str = "main", hold: str = "2 days", slot_seconds: int = DAY, clock: Clock | None = None) -> DataFrame:
    """Ratings before each game (league, game_id, elo_home, elo_away, elo_expected, late), the streaming form of ``ratings``."""
    rows = games.select(
        "league", "game_id", F.col("datetime").cast("timestamp").alias("datetime"), "home", "away", F.col("home_score").cast("double").alias("home_score"),
        F.col("away_score").cast("double").alias("away_score"), F.year("datetime").alias("season"), F.coalesce(F.col("training_included"), F.lit(False)).alias("live"),
    )
    of = rows.schema["game_id"].dataType.simpleString()
    processor = Ratings("datetime", ["datetime", "game_id"], ["league", "game_id", *RATED], slot_seconds, rating.RULES[rule])
    return held(rows, ["league"], "datetime", hold, processor, f"league string, game_id {of}, elo_home double, elo_away double, elo_expected double, late boolean", clock)


class Routed(InOrder):
    """The routing replay of a league: resolved games in a list of at most 120 rows, weights and temperatures beside it."""

    def __init__(self, when, order, names, slot_seconds, experts, cfg, classes):
        super().__init__(when, order, names, slot_seconds)
        self.experts, self.cfg, self.classes = list(experts), cfg, classes

    def open(self, handle):
        self.games = handle.getListState("games", routing.HISTORY)
        self.settings = handle.getValueState("settings", "json string")

    def take(self, key, rows, now):
        known = routing.joined_state(list(self.games.get()), json.loads(self.settings.get()[0])) if self.settings.exists() else None
        out, after = routing.replay_step(self.experts, ["league"], self.cfg, self.classes)(rows, known)
        games, settings = routing.split_state(after)
        self.games.put(games)
        self.settings.update((json.dumps(settings),))
        yield out[self.names].assign(late=False)


def routing_stream(
    forecasts: DataFrame, experts: Sequence[str], cfg: routing.Routing = routing.Routing(), classes: int = 3, hold: str = "2 days", slot_seconds: int = DAY, clock: Clock | None = None
) -> DataFrame:
    """Online expert routing and calibration per league, the streaming form of the replay."""
    rows = forecasts.select("league", "game_id", F.col("datetime").cast("timestamp").alias("datetime"), "actual", *experts)
    names = ["league", "game_id", "routed", "weights", *routing.FIELDS]
    vec = T.ArrayType(T.DoubleType())
    schema = T.StructType([
        T.StructField("league", T.StringType()), T.StructField("game_id", rows.schema["game_id"].dataType), T.StructField("routed", vec), T.StructField("weights", vec),
        *[T.StructField(n, T.DoubleType()) for n in routing.FIELDS], T.StructField("late", T.BooleanType()),
    ])
    processor = Routed("datetime", ["datetime", "game_id"], names, slot_seconds, experts, cfg, classes)
    return held(rows, ["league"], "datetime", hold, processor, schema, clock)
