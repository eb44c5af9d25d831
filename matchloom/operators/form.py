"""Team, venue, pair and player history features: what was known strictly before each game."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from matchloom.functions import prob
from matchloom.plans.ordered import SLICE, Timeline, group_limit, largest_group

ORDER = ["datetime", "game_id"]
TEAM = ["league", "team"]
FORM_WIDTHS = (3, 5, 10, 20, 30, 45, 60)
BAT_WIDTHS = (3, 5, 10, 20, 30)
DAY_US = 86_400_000_000
SHRINK_K, SHRINK_PRIOR = 100.0, 0.5


def micros(c: str = "datetime") -> Column:
    return F.unix_micros(F.col(c).cast("timestamp"))


def team_rows(games: DataFrame, extra: Sequence[str] = ()) -> DataFrame:
    """Two rows per game, one per side; ``training_included`` becomes ``eligible``.

    ``extra`` names per-side statistics held as ``home_<name>`` / ``away_<name>``.
    """

    def side(me: str, you: str, is_home: bool) -> Column:
        return F.struct(
            F.col(me).alias("team"), F.col(you).alias("opponent"), F.lit(is_home).alias("is_home"),
            F.col(f"{me}_score").alias("gf"), F.col(f"{you}_score").alias("ga"),
            *[F.col(f"{me}_{x}").alias(x) for x in extra],
        )

    eligible = F.col("training_included") if "training_included" in games.columns else F.lit(True)
    keep = [c for c in ("league", "game_id", "datetime") if c in games.columns]
    wide = games.select(
        *keep, eligible.alias("eligible"),
        F.explode(F.array(side("home", "away", True), side("away", "home", False))).alias("s"),
    )
    return wide.select(*keep, "eligible", "s.*")


def points(win: int = 3, draw: int = 1) -> Column:
    return F.when(F.col("gf") > F.col("ga"), win).when(F.col("gf") == F.col("ga"), draw).otherwise(0)


def _mean(total: str, n: str, default: float) -> Column:
    return F.when(F.col(n) > 0, F.col(total) / F.nullif(F.col(n), F.lit(0))).otherwise(default)


def rolling_form(rows: DataFrame, widths: Sequence[int] = FORM_WIDTHS, neutral: bool = True) -> DataFrame:
    """Trailing points, goals and win/draw rates; neutral defaults when there is no history."""
    line = Timeline(rows, TEAM, ORDER, eligible="eligible")
    sums = line.rolling(
        {
            "pts": points(), "gf": F.col("gf"), "ga": F.col("ga"),
            "win": (F.col("gf") > F.col("ga")).cast("int"), "draw": (F.col("gf") == F.col("ga")).cast("int"),
        },
        widths,
    )
    defaults = {"pts": 1.0, "gf": 0.0, "ga": 0.0, "win": 0.33, "draw": 0.33}
    out = {}
    for w in widths:
        for name, value in defaults.items():
            out[f"{name}_{w}"] = _mean(f"{name}_{w}", f"n_{w}", value if neutral else None)
    df = sums.withColumns(out)
    df = df.withColumns({f"gd_{w}": F.col(f"gf_{w}") - F.col(f"ga_{w}") for w in widths})
    return df.drop(*[f"n_{w}" for w in widths])


def venue_split(rows: DataFrame, width: int = 10) -> DataFrame:
    """History of the same team on the same side of the fixture: games, points per game, recent goals."""
    keys = [*TEAM, "is_home"]
    base = Timeline(rows, keys, ORDER, eligible="eligible", chain=True)
    recent = base.rolling({"gf": F.col("gf"), "ga": F.col("ga")}, [width])
    totals = base.again(recent).running({"_games": F.lit(1), "_pts": points()}).drop(SLICE)
    return totals.withColumns(
        {
            "venue_n": F.col("_games").cast("double"),
            "venue_pts": _mean("_pts", "_games", 1.0),
            "venue_gf": _mean(f"gf_{width}", f"n_{width}", 0.0),
            "venue_ga": _mean(f"ga_{width}", f"n_{width}", 0.0),
        }
    ).drop("_games", "_pts", f"gf_{width}", f"ga_{width}", f"n_{width}")


def shrunk_win_rate(rows: DataFrame, keys: Sequence[str] = TEAM, legacy_depth: int | None = None) -> DataFrame:
    """Empirical-Bayes win rate over all earlier games.

    ``legacy_depth`` counts wins in that many last games against all games, as older reports did.
    """
    won = (F.col("gf") > F.col("ga")).cast("int")
    df = Timeline(rows, keys, ORDER, eligible="eligible").running({"matches": F.lit(1), "_wins": won})
    if legacy_depth:
        df = Timeline(df, keys, ORDER, eligible="eligible").rolling({"_recent": won}, [legacy_depth])
        df = df.withColumn("_wins", F.col(f"_recent_{legacy_depth}")).drop(f"_recent_{legacy_depth}", f"n_{legacy_depth}")
    n = F.col("matches").cast("double")
    return df.withColumns(
        {
            "matches": n,
            "win_rate_raw": F.col("_wins") / F.greatest(n, F.lit(1.0)),
            "win_rate_shrunk": (F.col("_wins") + SHRINK_K * SHRINK_PRIOR) / F.greatest(n + SHRINK_K, F.lit(1.0)),
        }
    ).drop("_wins")


def rest_days(rows: DataFrame, first: float | None = 30.0) -> DataFrame:
    """Fractional days since the last eligible game, never below zero."""
    seen = Timeline(rows, TEAM, ORDER, eligible="eligible").last_seen({"_last": micros()})
    gap = F.greatest((micros() - F.col("_last")) / F.lit(float(DAY_US)), F.lit(0.0))
    rest = F.coalesce(gap, F.lit(first).cast("double"))
    return seen.withColumns({"rest_days": rest, "short_rest": (rest < 2.0).cast("double")}).drop("_last")


def games_last_days(rows: DataFrame, days: Sequence[int] = (3, 7, 14)) -> DataFrame:
    """Eligible games of the team in the last d days, strictly before the game's time."""
    timed = rows.withColumn("_us", micros())
    live = timed.filter(F.coalesce(F.col("eligible"), F.lit(False))).select(*TEAM, "_us")
    # Every reading time enters with weight zero so that ineligible games are counted for, not counted.
    times = live.withColumn("_w", F.lit(1)).unionByName(timed.select(*TEAM, "_us").withColumn("_w", F.lit(0)))
    per_time = times.groupBy(*TEAM, "_us").agg(F.sum("_w").alias("_w"))
    counted = weighted_within(per_time, TEAM, "_us", "_w", {f"games_last_{d}d": d * DAY_US for d in days})
    return timed.join(counted, [*TEAM, "_us"], "left").drop("_us")


def weighted_within(per_time: DataFrame, keys: Sequence[str], time_us: str, weight: str, spans: dict[str, int]) -> DataFrame:
    """Sum of ``weight`` in [t - span, t) for each distinct (key, time) row."""
    cells, df = list(keys), per_time
    if largest_group(df, keys)[0] > group_limit(df.sparkSession):
        own = F.floor(F.col(time_us) / max(spans.values()))
        df = df.withColumn("_own", own).withColumn("_bucket", F.explode(F.array(own, own + 1)))
        cells = [*cells, "_bucket"]
    spec = Window.partitionBy(*cells).orderBy(time_us)
    df = df.withColumns({n: F.coalesce(F.sum(weight).over(spec.rangeBetween(-s, -1)), F.lit(0)) for n, s in spans.items()})
    if "_bucket" in cells:
        df = df.filter("_bucket = _own")
    return df.select(*keys, time_us, *spans)


def same_opponent(rows: DataFrame, width: int = 10) -> DataFrame:
    """Meetings with the target opponent among the last games."""
    line = Timeline(rows, TEAM, ORDER, eligible="eligible")
    df = line.trailing(width, lambda f: {"_opp": F.collect_list("opponent").over(f(width))})
    met = F.size(F.filter(F.coalesce(F.col("_opp"), F.array().cast("array<string>")), lambda x: x == F.col("opponent")))
    return df.withColumn(f"same_opponent_last_{width}", met.cast("double")).drop("_opp")


BATTING = ("pa", "ab", "h", "hr", "bb", "so", "doubles", "triples")


def batting_process(rows: DataFrame, widths: Sequence[int] = BAT_WIDTHS) -> DataFrame:
    """Rates of trailing mean batting counters; denominators are at least one."""
    have = {c: F.col(c) if c in rows.columns else F.lit(0.0) for c in BATTING}
    df = Timeline(rows, TEAM, ORDER, eligible="eligible").rolling({f"_{c}": x for c, x in have.items()}, widths)
    out = {}
    for w in widths:
        m = {c: _mean(f"_{c}_{w}", f"n_{w}", 0.0) for c in BATTING}
        at_bats, plate = F.greatest(m["ab"], F.lit(1.0)), F.greatest(m["pa"], F.lit(1.0))
        extra = (m["doubles"] + 2 * m["triples"] + 3 * m["hr"]) / at_bats
        out |= {
            f"bat_avg_{w}": m["h"] / at_bats,
            f"bat_bb_rate_{w}": m["bb"] / plate,
            f"bat_so_rate_{w}": m["so"] / plate,
            f"bat_xbh_{w}": m["doubles"] + m["triples"] + m["hr"],
            f"bat_hr_rate_{w}": m["hr"] / at_bats,
            f"bat_iso_{w}": F.greatest(extra - m["h"] / at_bats, F.lit(0.0)),
            f"bat_extra_{w}": F.greatest(extra, F.lit(0.0)),
        }
    return df.withColumns(out).select(*rows.columns, *out)


def bullpen(rows: DataFrame, width: int = 10) -> DataFrame:
    """Mean earned runs and total appearances of the bullpen; runs beyond three stand in when absent."""
    spare = F.greatest(F.col("ga") - 3, F.lit(0)).cast("double")
    er = F.coalesce(F.col("bullpen_er"), spare) if "bullpen_er" in rows.columns else spare
    runs = F.coalesce(F.col("bullpen_runs"), er) if "bullpen_runs" in rows.columns else er
    apps = F.coalesce(F.col("bullpen_apps"), F.lit(0.0)) if "bullpen_apps" in rows.columns else F.lit(0.0)
    df = Timeline(rows, TEAM, ORDER, eligible="eligible").rolling({"_er": er, "_runs": runs, "_apps": apps}, [width])
    n = f"n_{width}"
    return df.withColumns(
        {
            f"bp_er_{width}": _mean(f"_er_{width}", n, 0.0),
            f"bp_runs_{width}": _mean(f"_runs_{width}", n, 0.0),
            f"bp_app_{width}": F.col(f"_apps_{width}"),
        }
    ).select(*rows.columns, f"bp_er_{width}", f"bp_runs_{width}", f"bp_app_{width}")


# Fixed values: (carry, gain) of the short and long bullpen load recurrences.
BULLPEN_DECAY = {"bp3": (0.65, 0.45), "bp7": (0.88, 0.20)}


def bullpen_decay(rows: DataFrame) -> DataFrame:
    """s <- carry * s + gain * max(0, ga - 3), written as a decayed sum of earlier loads."""
    load = F.greatest(F.col("ga") - 3, F.lit(0)).cast("double")
    df, line = rows, Timeline(rows, TEAM, ORDER, eligible="eligible", chain=True)
    for name, (carry, gain) in BULLPEN_DECAY.items():
        df = line.again(df).decayed({name: load * gain}, -1.0 / math.log(carry), mean=False)
    return df.withColumns({n: F.coalesce(F.col(n), F.lit(0.0)) for n in BULLPEN_DECAY}).drop(SLICE)


def head_to_head(games: DataFrame, meetings: int = 8) -> DataFrame:
    """Last meetings of the two teams at either ground: count, home-team win rate, draw rate."""
    winner = F.when(F.col("home_score") > F.col("away_score"), F.col("home")).when(
        F.col("home_score") < F.col("away_score"), F.col("away")
    ).otherwise("")
    pair = games.withColumns(
        {"_a": F.least("home", "away"), "_b": F.greatest("home", "away"), "_w": winner}
    )
    line = Timeline(pair, ["league", "_a", "_b"], ORDER)
    df = line.trailing(meetings, lambda f: {"_won": F.collect_list("_w").over(f(meetings))})
    won, n = F.col("_won"), F.size("_won")
    rate = lambda who: F.when(n > 0, F.size(F.filter(won, lambda x: x == who)) / F.nullif(n, F.lit(0)))
    return df.withColumns(
        {"h2h_n": n.cast("long"), "h2h_home_win_rate": rate(F.col("home")), "h2h_draw_rate": rate(F.lit(""))}
    ).drop("_a", "_b", "_w", "_won")


def volatility(rows: DataFrame, names: Sequence[str] = ("gf", "ga"), width: int = 20) -> DataFrame:
    """Population deviation (two games or more) and least-squares slope (four or more) of recent values."""
    line = Timeline(rows, TEAM, ORDER, eligible="eligible")

    def build(frame):
        out = {"_n": F.count(F.lit(1)).over(frame(width))}
        for n in names:
            out[f"_sd_{n}"] = F.stddev_pop(F.col(n).cast("double")).over(frame(width))
            out[f"_xs_{n}"] = F.collect_list(F.col(n).cast("double")).over(frame(width))
        return out

    df = line.trailing(width, build)
    out = {}
    for n in names:
        out[f"{n}_sd_{width}"] = F.when(F.col("_n") >= 2, F.col(f"_sd_{n}")).otherwise(0.0)
        out[f"{n}_slope_{width}"] = F.when(F.col("_n") >= 4, F.coalesce(prob.slope(F.col(f"_xs_{n}")), F.lit(0.0))).otherwise(0.0)
    return df.withColumns(out).select(*rows.columns, *out)


def venue_environment(games: DataFrame, minimum: int = 3, binary_leagues: Sequence[str] = ()) -> DataFrame:
    """Run level and outcome rates of a venue from its earlier eligible games; priors below the minimum."""
    known_venue = F.lower(F.trim(F.coalesce("venue", F.lit("")))).isin("", "unknown")
    base = games.withColumn("_live", F.coalesce(F.col("training_included"), F.lit(True)) & ~known_venue)
    h, a = F.col("home_score"), F.col("away_score")
    df = Timeline(base, ["league", "venue"], ORDER, eligible="_live").running(
        {
            "_games": F.lit(1), "_runs": (h + a).cast("double"),
            "_wins": (h > a).cast("int"), "_draws": (h == a).cast("int"),
        }
    )
    n = F.col("_games")
    known = (n >= minimum) & ~known_venue
    binary = F.col("league").isin(*binary_leagues) if binary_leagues else F.lit(False)
    rate = lambda c: F.col(c) / F.nullif(n, F.lit(0))
    out = {
        "venue_known": known.cast("double"),
        "venue_games": F.when(known_venue, 0.0).otherwise(n.cast("double")),
        "venue_run_env": F.when(known, rate("_runs")).otherwise(0.0),
        "venue_home_win_rate": F.when(known, rate("_wins")).otherwise(F.when(binary, 0.5).otherwise(1.0 / 3.0)),
        "venue_draw_rate": F.when(binary, 0.0).otherwise(F.when(known, rate("_draws")).otherwise(1.0 / 3.0)),
    }
    return df.withColumns(out).drop("_live", "_games", "_runs", "_wins", "_draws")


def context_readiness(df: DataFrame, valid: Column, safe: Column, keys: Sequence[str] = ("league",), share: float = 0.5) -> DataFrame:
    """Ready when at least ``share`` of the earlier eligible rows with a valid cutoff were safe."""
    seen = Timeline(df, list(keys), ORDER, eligible="training_included").running(
        {"valid_seen": valid.cast("int"), "safe_seen": (valid & safe).cast("int")}
    )
    ready = (F.col("valid_seen") > 0) & (F.col("safe_seen") >= share * F.col("valid_seen"))
    return seen.withColumn("context_ready", ready)


# Neutral starter line used when a pitcher has no earlier line.
STARTER_PRIOR = {
    "era": 4.00, "whip": 1.30, "k9": 7.5, "bb9": 3.0, "hr9": 1.0, "fip": 4.00,
    "recent_era": 4.00, "recent_k9": 7.5, "recent_k_rate": 0.20, "recent_bb_rate": 0.08,
    "recent_pitches": 0.0, "recent_ip": 0.0, "era_slope": 0.0, "k9_slope": 0.0, "fip_slope": 0.0,
    "recent_era_sd": 0.0, "recent_k9_sd": 0.0, "recent_pitches_sd": 0.0,
}
STARTER_METRICS = ("era", "whip", "k9", "bb9", "hr9", "fip", "pitches", "ip", "k_rate", "bb_rate")


def starter_profiles(lines: DataFrame, key: Sequence[str] = ("league", "pitcher"), scale: float = 18.0) -> DataFrame:
    """Decayed means, last-five means and deviations, last-eight slopes of a pitcher's earlier lines."""
    have = [m for m in STARTER_METRICS if m in lines.columns]
    value = lambda m: F.col(m).cast("double")
    lines = lines if "eligible" in lines.columns else lines.withColumn("eligible", F.lit(True))
    line = Timeline(lines, key, ORDER, eligible="eligible", chain=True)
    decayed = [m for m in ("era", "whip", "k9", "bb9", "hr9", "fip") if m in have]
    df = line.decayed({f"sp_{m}": value(m) for m in decayed}, scale)
    recent = [m for m in ("era", "k9", "k_rate", "bb_rate", "pitches", "ip") if m in have]
    spread = [m for m in ("era", "k9", "pitches") if m in have]

    def last_five(frame):
        out = {f"sp_recent_{m}": F.avg(value(m)).over(frame(5)) for m in recent}
        return out | {f"sp_recent_{m}_sd": F.stddev_pop(value(m)).over(frame(5)) for m in spread}

    df = line.again(df).trailing(5, last_five)
    sloped = [m for m in ("era", "k9", "fip") if m in have]
    for m in sloped:
        # The last eight lines that carry the metric, however far back they lie.
        carried = df.withColumn("_has", F.col("eligible") & value(m).isNotNull())
        df = line.again(carried, "_has").trailing(8, lambda frame: {f"_{m}_xs": F.collect_list(value(m)).over(frame(8))})
        df = df.drop("_has")
    df = line.again(df).running({"_starts": F.lit(1)})
    out = {"sp_starts": F.col("_starts").cast("double")}
    for m in sloped:
        xs = F.col(f"_{m}_xs")
        out[f"sp_{m}_slope"] = F.when((F.col("_starts") >= 3) & (F.size(xs) >= 3), prob.slope(xs))
    df = df.withColumns(out)
    names = [c for c in df.columns if c.startswith("sp_")]
    filled = {c: F.coalesce(F.col(c), F.lit(STARTER_PRIOR.get(c[3:], 0.0))) for c in names}
    return df.withColumns(filled).select(*lines.columns, *names)


# Neutral batter profile.
PLAYER_PRIOR = {
    "avg": 0.25, "obp": 0.32, "slg": 0.38, "iso": 0.13, "bb_rate": 0.08, "so_rate": 0.20, "sb_rate": 0.02,
    "bunt_rate": 0.02, "power_rate": 0.05, "contact_rate": 0.70, "gidp_rate": 0.03, "groundout_rate": 0.20,
    "flyout_rate": 0.20, "lineout_rate": 0.08, "errors_rate": 0.0, "pa": 0.0,
}
PLAYER_RATES = {
    "bb_rate": "bb", "so_rate": "so", "sb_rate": "sb", "bunt_rate": "bunt", "power_rate": "power_events",
    "contact_rate": "contact_events", "gidp_rate": "gidp", "groundout_rate": "groundout", "flyout_rate": "flyout",
    "lineout_rate": "lineout", "errors_rate": "errors",
}
PLAYER_RECENT = ("pa", "iso", "so_rate", "bb_rate", "sb_rate")
BATTING_COUNTERS = {"pa", "ab", "h", "bb", "doubles", "triples", "hr", *PLAYER_RATES.values()}


def batting_rates(df: DataFrame) -> dict[str, Column]:
    """Per-game rates of a batting line; absent counters are zero."""
    x = lambda n: F.coalesce(F.col(n).cast("double"), F.lit(0.0)) if n in df.columns else F.lit(0.0)
    ab, pa = F.greatest(x("ab"), F.lit(1.0)), F.greatest(x("pa"), F.lit(1.0))
    avg = x("h") / ab
    slg = (x("h") + x("doubles") + 2 * x("triples") + 3 * x("hr")) / ab
    return {
        "pa": x("pa"), "avg": avg, "obp": (x("h") + x("bb")) / F.greatest(x("ab") + x("bb"), F.lit(1.0)),
        "slg": slg, "iso": F.greatest(slg - avg, F.lit(0.0)),
        **{name: x(counter) / pa for name, counter in PLAYER_RATES.items()},
    }


def player_profiles(lines: DataFrame, key: Sequence[str] = ("league", "player_id"), scale: float = 12.0) -> DataFrame:
    """Decayed batting rates and last-five means from a player's earlier games."""
    lines = lines if "eligible" in lines.columns else lines.withColumn("eligible", F.lit(True))
    rates = batting_rates(lines)
    base = lines.withColumns({f"_g_{n}": c for n, c in rates.items()})
    line = Timeline(base, key, ORDER, eligible="eligible", chain=True)
    # Rates of whole counters are never missing.
    counters = [f.dataType for f in lines.schema if f.name in BATTING_COUNTERS]
    whole = all(isinstance(t, (T.IntegralType, T.BooleanType)) for t in counters)
    df = line.profile(
        5, lambda frame: {f"pp_recent_{n}": F.avg(f"_g_{n}").over(frame(5)) for n in PLAYER_RECENT},
        {f"pp_{n}": F.col(f"_g_{n}") for n in rates}, scale, "_games", present=whole,
    ).withColumn("pp_games", F.col("_games").cast("double"))
    prior = {f"pp_{n}": v for n, v in PLAYER_PRIOR.items()} | {f"pp_recent_{n}": PLAYER_PRIOR[n] for n in PLAYER_RECENT}
    filled = {c: F.coalesce(F.col(c), F.lit(v)) for c, v in prior.items()}
    return df.withColumns(filled).select(*lines.columns, *filled, "pp_games")


def game_differences(rows: DataFrame, names: Sequence[str]) -> DataFrame:
    """One row per game with home, away and home-minus-away values of team-row features."""
    home = lambda c: F.max(F.when(F.col("is_home"), F.col(c)))
    away = lambda c: F.max(F.when(~F.col("is_home"), F.col(c)))
    wide = rows.groupBy("game_id", "league").agg(
        *[home(c).alias(f"h_{c}") for c in names], *[away(c).alias(f"a_{c}") for c in names]
    )
    return wide.withColumns({f"d_{c}": F.col(f"h_{c}") - F.col(f"a_{c}") for c in names})
