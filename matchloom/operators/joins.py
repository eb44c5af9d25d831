"""Joins with point-in-time rules."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from matchloom.plans.ordered import Timeline, latest_per_key


def settle(ledger: DataFrame, results: DataFrame, now: Column, zone: str = "Asia/Tokyo", hold_hours: int = 5) -> DataFrame:
    """Fill outcomes of unsettled forecasts from results of the same local date and teams.

    Future dates never settle; same-day games wait ``hold_hours`` after the start; probabilities are untouched. Of
    several results for one date and pairing the one with the higher scores counts, so ledger rows never multiply.
    """
    day = F.to_date(F.from_utc_timestamp(F.col("datetime"), zone))
    today = F.to_date(F.from_utc_timestamp(now, zone))
    found = results.select(
        F.col("date").alias("_day"), F.col("home").alias("_home"), F.col("away").alias("_away"),
        F.col("home_score").alias("_hs"), F.col("away_score").alias("_as"),
    )
    found = latest_per_key(found, ["_day", "_home", "_away"], ["_hs", "_as"])
    open_row = F.col("actual").isNull()
    due = (day < today) | ((day == today) & (F.unix_timestamp(now) - F.unix_timestamp(F.col("datetime")) >= hold_hours * 3600))
    joined = ledger.withColumn("_due", F.coalesce(open_row & due, F.lit(False))).withColumn("_d", day)
    joined = joined.join(
        found, (F.col("_d") == F.col("_day")) & (F.col("home") == F.col("_home")) & (F.col("away") == F.col("_away")), "left"
    )
    hit = F.col("_due") & F.col("_hs").isNotNull() & F.col("_as").isNotNull()
    result = F.when(F.col("_hs") > F.col("_as"), 0).when(F.col("_hs") == F.col("_as"), 1).otherwise(2).cast("long")
    filled = {
        "actual": F.when(hit, result).otherwise(F.col("actual")),
        "actual_home_score": F.when(hit, F.col("_hs")).otherwise(F.col("actual_home_score")),
        "actual_away_score": F.when(hit, F.col("_as")).otherwise(F.col("actual_away_score")),
        "settled_now": hit,
    }
    return joined.withColumns(filled).select(*ledger.columns, "settled_now")


def hourly(df: DataFrame, readings: DataFrame, place: str = "venue", when: str = "datetime", at: str = "hour") -> DataFrame:
    """Left join of readings on place and hour floor."""
    keyed = df.withColumn("_hour", F.date_trunc("hour", F.col(when)))
    right = readings.withColumnRenamed(at, "_hour")
    return keyed.join(right, [place, "_hour"], "left").drop("_hour")


def nearest(
    df: DataFrame, readings: DataFrame, place: Sequence[str], key: str, when_us: str, at_us: str, value: Sequence[str], reach_us: int
) -> DataFrame:
    """Closest reading in time within ``reach_us`` (earlier wins a tie), with EXACT / NEAREST quality.

    Times are cut into buckets of the reach. In a bucket, rows and readings form one timeline, to which the last reading of
    the bucket before and the first of the one after are added; a row so meets the reading before and the one after it
    only, however dense the readings are.
    """
    place = list(place)
    # Readings of one place and time are interchangeable: combine them first.
    marks = readings.dropna(subset=[*place, at_us]).groupBy(*place, at_us).agg(*[F.max(c).alias(c) for c in value])
    marks = marks.select(*place, F.floor(F.col(at_us) / reach_us).alias("_b"), F.struct(at_us, *value).alias("_mark"))
    ends = marks.groupBy(*place, "_b").agg(F.min("_mark").alias("_first"), F.max("_mark").alias("_last"))
    beside = F.explode(F.array(F.struct((F.col("_b") - 1).alias("_b"), F.col("_first").alias("_mark")), F.struct((F.col("_b") + 1).alias("_b"), F.col("_last").alias("_mark"))))
    marks = marks.unionByName(ends.select(*place, beside.alias("_e")).select(*place, "_e._b", "_e._mark"))
    # A null key finds nothing, as rows take their reading by key.
    asks = df.dropna(subset=[*place, key, when_us]).select(*place, F.floor(F.col(when_us) / reach_us).alias("_b"), F.col(when_us).alias("_t"), key)
    line = asks.unionByName(marks.withColumn("_t", F.col(f"_mark.{at_us}")), allowMissingColumns=True)
    # Equal times are peers of a range, so a reading at the very time is found whatever the order.
    met = lambda order: F.last("_mark", ignorenulls=True).over(Window.partitionBy(*place, "_b").orderBy(order).rangeBetween(Window.unboundedPreceding, Window.currentRow))
    line = line.withColumns({"_before": met(F.col("_t").asc()), "_after": met(F.col("_t").desc())}).filter(F.col("_mark").isNull())
    gap = lambda c: F.abs(F.col(f"{c}.{at_us}") - F.col("_t"))
    found = F.when(F.coalesce(gap("_after") < gap("_before"), F.col("_before").isNull()), F.col("_after")).otherwise(F.col("_before"))
    pairs = line.withColumn("_mark", found).withColumn("_gap", gap("_mark")).filter(F.col("_gap") <= reach_us)
    best = pairs.groupBy(key).agg(F.min_by("_mark", F.struct("_gap", F.col(f"_mark.{at_us}"))).alias("_best"))
    out = df.join(best, key, "left")
    quality = F.when(F.col("_best").isNull(), "UNKNOWN").when(F.col("_best")[at_us] == F.col(when_us), "EXACT").otherwise("NEAREST")
    return out.withColumns({at_us: F.col("_best")[at_us], **{c: F.col("_best")[c] for c in value}, "quality": quality}).drop("_best")


def as_of(
    left: DataFrame, right: DataFrame, keys: Sequence[str], left_time: str, right_time: str, values: Sequence[str], tie: str
) -> DataFrame:
    """Latest right row with time <= the left time, else nulls.

    Both sides are unioned into one timeline per key (right rows first at equal times) and the last right
    row is carried forward, so cost is one ordered pass whatever the number of matches; ``tie`` orders
    right rows of equal time.
    """
    keys = list(keys)
    payload = F.struct(F.col(right_time).alias(f"matched_{right_time}"), *values)
    marks = right.select(
        *keys, F.col(right_time).alias("_t"), F.lit(0).alias("_side"), F.col(tie).cast("string").alias("_tie"),
        payload.alias("_payload"), F.lit(True).alias("_is_right"),
    )
    rows = left.select(
        *keys, F.col(left_time).alias("_t"), F.lit(1).alias("_side"), F.lit("").alias("_tie"),
        F.lit(None).cast(marks.schema["_payload"].dataType).alias("_payload"), F.lit(False).alias("_is_right"),
        F.struct(*left.columns).alias("_left"),
    )
    marks = marks.withColumn("_left", F.lit(None).cast(rows.schema["_left"].dataType))
    line = Timeline(rows.unionByName(marks), keys, ["_t", "_side", "_tie"], eligible="_is_right")
    seen = line.last_seen({"_m": F.col("_payload")}).filter("_side = 1")
    return seen.select("_left.*", *[F.col("_m")[c].alias(c) for c in (f"matched_{right_time}", *values)])


def canonical_snapshots(snapshots: DataFrame, key: str = "game_id", when: str = "prediction_time", tie: str = "snapshot_id") -> DataFrame:
    """The final snapshot of each game."""
    return latest_per_key(snapshots, [key], [when, tie])


def reconcile(predictions: DataFrame, results: DataFrame, key: str = "event_id") -> DataFrame:
    """Key-level reconciliation counts and duplicates; null-safe status."""
    p = predictions.groupBy(key).agg(F.count(F.lit(1)).alias("_p"))
    r = results.groupBy(key).agg(F.count(F.lit(1)).alias("_r"))
    both = p.join(r, key, "full_outer")
    hp, hr = F.col("_p").isNotNull(), F.col("_r").isNotNull()
    out = both.agg(
        F.coalesce(F.sum("_p"), F.lit(0)).alias("prediction_rows"), F.coalesce(F.sum("_r"), F.lit(0)).alias("result_rows"),
        F.count_if(hp & hr).alias("matched_rows"), F.count_if(hp & ~hr).alias("unmatched_predictions"),
        F.count_if(~hp & hr).alias("unmatched_results"),
        F.count_if((F.col("_p") > 1) | (F.col("_r") > 1)).alias("duplicated_keys"),
    )
    return out.withColumn("status", F.when(F.col("duplicated_keys") > 0, "FAIL").otherwise("PASS"))


def two_source(candidate: DataFrame, official: DataFrame, identity: Sequence[str]) -> DataFrame:
    """One gate row: games confirmed by the official source, score mismatches fail, none admitted fails."""
    off = official.select(*identity, F.col("home_score").alias("_oh"), F.col("away_score").alias("_oa")).dropDuplicates()
    joined = candidate.join(off, list(identity), "left")
    admitted = F.col("_oh").isNotNull()
    differs = admitted & ((F.col("_oh") != F.col("home_score")) | (F.col("_oa") != F.col("away_score")))
    out = joined.agg(
        F.count(F.lit(1)).alias("candidates"), F.count_if(admitted).alias("admitted"), F.count_if(differs).alias("mismatched")
    )
    return out.withColumn("status", F.when((F.col("mismatched") > 0) | (F.col("admitted") == 0), "FAIL").otherwise("PASS"))


def repair(df: DataFrame, fixes: DataFrame, key: str, columns: Sequence[str], recent: Column) -> DataFrame:
    """Fill blank values of recent rows from fixes; existing values are kept."""
    right = fixes.select(key, *[F.col(c).alias(f"_{c}") for c in columns])
    joined = df.join(right, key, "left")
    keep = lambda c: F.coalesce(F.nullif(F.trim(F.col(c)), F.lit("")), F.when(recent, F.col(f"_{c}")))
    return joined.withColumns({c: F.coalesce(keep(c), F.lit("")) for c in columns}).select(*df.columns)


def upsert(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Replace the keys that arrive."""
    return old.join(new.select(*keys).distinct(), list(keys), "left_anti").unionByName(new, allowMissingColumns=True)


def notices_for_games(games: DataFrame, notices: DataFrame) -> DataFrame:
    """Roster notices attached to the games of the named team, home or away."""
    sides = games.select("game_id", F.explode(F.array("home", "away")).alias("team"))
    return sides.join(notices, "team")


def frame_equality(a: DataFrame, b: DataFrame, key: str, numeric: Sequence[str], tolerance: float = 0.0) -> DataFrame:
    """Exact comparison of two result sets: sizes, duplicate keys, key sets and numeric cells."""
    left = a.groupBy(key).agg(F.count(F.lit(1)).alias("_na"), *[F.max(c).alias(f"_a_{c}") for c in numeric])
    right = b.groupBy(key).agg(F.count(F.lit(1)).alias("_nb"), *[F.max(c).alias(f"_b_{c}") for c in numeric])
    both = left.join(right, key, "full_outer")
    off = lambda c: ~F.coalesce(
        (F.abs(F.col(f"_a_{c}") - F.col(f"_b_{c}")) <= tolerance) | F.col(f"_a_{c}").eqNullSafe(F.col(f"_b_{c}")), F.lit(False)
    )
    shared = F.col("_na").isNotNull() & F.col("_nb").isNotNull()
    cells = sum((F.when(shared & off(c), 1).otherwise(0) for c in numeric), start=F.lit(0))
    out = both.agg(
        F.coalesce(F.sum("_na"), F.lit(0)).alias("left_rows"), F.coalesce(F.sum("_nb"), F.lit(0)).alias("right_rows"),
        F.count_if((F.col("_na") > 1) | (F.col("_nb") > 1)).alias("duplicated_keys"),
        F.count_if(~shared).alias("unpaired_keys"), F.coalesce(F.sum(cells), F.lit(0)).cast("long").alias("differing_cells"),
    )
    same = (F.col("left_rows") == F.col("right_rows")) & (F.col("duplicated_keys") + F.col("unpaired_keys") + F.col("differing_cells") == 0)
    return out.withColumn("schema_equal", F.lit(a.dtypes == b.dtypes)).withColumn("equal", same & F.col("schema_equal"))


def versus_baseline(variants: DataFrame, name: str, baseline: str, metrics: Sequence[str]) -> DataFrame:
    """Metric deltas of each variant against the named baseline row."""
    base = variants.filter(F.col(name) == baseline).select(F.lit(1).alias("_k"), *[F.col(m).alias(f"_{m}") for m in metrics])
    joined = variants.withColumn("_k", F.lit(1)).join(base, "_k")
    return joined.select(name, *metrics, *[(F.col(m) - F.col(f"_{m}")).alias(f"delta_{m}") for m in metrics])


def coverage_check(wanted: DataFrame, delivered: DataFrame, key: str) -> DataFrame:
    """Missing, unexpected and repeated keys between a plan and what was delivered."""
    w = wanted.groupBy(key).agg(F.count(F.lit(1)).alias("_w"))
    d = delivered.groupBy(key).agg(F.count(F.lit(1)).alias("_d"))
    both = w.join(d, key, "full_outer")
    out = both.agg(
        F.count_if(F.col("_d").isNull()).alias("missing"), F.count_if(F.col("_w").isNull()).alias("unexpected"),
        F.count_if(F.col("_d") > 1).alias("duplicated"),
    )
    return out.withColumn("complete", F.col("missing") + F.col("unexpected") + F.col("duplicated") == 0)


def lineup_array(json: Column, cap: int = 12) -> Column:
    """Parsed lineup in batting order (unknown order last), at most ``cap`` starters; malformed text is empty."""
    schema = "array<struct<player_id:string,player_name:string,batting_order:double,position:string,hand:string>>"
    parsed = F.coalesce(F.from_json(json, schema), F.array().cast(schema))
    keyed = F.transform(
        F.filter(parsed, lambda x: F.trim(F.coalesce(x["player_id"], F.lit(""))) != ""),
        lambda x: F.struct(F.coalesce(x["batting_order"], F.lit(999.0)).alias("o"), x["player_id"].alias("i"), x.alias("x")),
    )
    return F.transform(F.slice(F.array_sort(keyed), 1, cap), lambda k: k["x"])


# What a lineup is taken to be when a game has none.
LINEUP_NEUTRAL = {
    "avg": 0.25, "obp": 0.32, "slg": 0.38, "iso": 0.13, "bb_rate": 0.08, "so_rate": 0.20, "sb_rate": 0.02, "bunt_rate": 0.02, "power_rate": 0.05,
    "contact_rate": 0.70, "gidp_rate": 0.03, "groundout_rate": 0.20, "flyout_rate": 0.20, "lineout_rate": 0.08, "errors_rate": 0.0,
    "recent_iso": 0.13, "recent_so_rate": 0.20, "recent_bb_rate": 0.08, "recent_sb_rate": 0.02,
}
LINEUP_SUMS = {"power_sum": "power_rate", "speed_sum": "sb_rate", "bunt_sum": "bunt_rate", "contact_sum": "contact_rate", "gdp_sum": "gidp_rate"}


def lineup_features(lineups: DataFrame, profiles: DataFrame, games: DataFrame | None = None) -> DataFrame:
    """PA-weighted means of 19 metrics, five sums, size and coverage of each lineup (game_id, side), in one aggregate.

    ``lineups`` has (game_id, side, player_id); ``profiles`` the batter profile (pp_ columns) as of each game. A player
    without a profile counts in ``lineup_n`` alone. With ``games`` (game_id, side) a game without a lineup has the
    neutral values, and sums and counts of zero; a lineup without a single profile has neutral means too.
    """
    profile = profiles.select("game_id", "player_id", "pp_pa", "pp_games", *(f"pp_{m}" for m in LINEUP_NEUTRAL))
    # Dealt by game alone, a lineup and the profiles of its game meet where they are added up: as a second key the player would deal
    # them anew, and the partial sums, two to a metric, would travel. As a condition on an array it is none.
    line, of = lineups.alias("line"), profile.withColumnRenamed("player_id", "_player").alias("of")
    joined = line.join(of, (F.col("line.game_id") == F.col("of.game_id")) & F.array_contains(F.array("_player"), F.col("line.player_id")), "left")
    joined = joined.select("line.game_id", "side", "pp_pa", "pp_games", *(f"pp_{m}" for m in LINEUP_NEUTRAL))
    weight = F.greatest(F.coalesce(F.col("pp_pa"), F.lit(0.0)), F.lit(1.0))
    known = F.coalesce(F.col("pp_games"), F.lit(0.0)) > 0
    mean = lambda m: F.sum(F.col(f"pp_{m}") * weight) / F.sum(F.when(F.col(f"pp_{m}").isNotNull(), weight))
    out = joined.groupBy("game_id", "side").agg(
        *[mean(m).alias(f"lineup_{m}") for m in LINEUP_NEUTRAL], *[F.sum(f"pp_{m}").alias(f"lineup_{name}") for name, m in LINEUP_SUMS.items()],
        F.count(F.lit(1)).cast("double").alias("lineup_n"), F.count_if(known).cast("double").alias("lineup_known_n"),
        (F.count_if(known) / F.greatest(F.count(F.lit(1)), F.lit(1))).alias("lineup_history_coverage"),
    )
    if games is not None:
        out = games.select("game_id", "side").join(out, ["game_id", "side"], "left")
    absent = {f"lineup_{m}": v for m, v in LINEUP_NEUTRAL.items()} | {f"lineup_{c}": 0.0 for c in (*LINEUP_SUMS, "n", "known_n", "history_coverage")}
    return out.withColumns({c: F.coalesce(F.col(c), F.lit(v)) for c, v in absent.items()})
