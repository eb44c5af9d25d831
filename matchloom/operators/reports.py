"""Out-of-sample reports, data-quality profiles and audits: aggregations that combine map-side."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from matchloom.functions import dist, prob, score, text
from matchloom.operators.scorelines import score_candidates
from matchloom.plans.durable import measured
from matchloom.plans.ordered import Timeline, latest_per_key, values_at_ranks

SIDES = {"top": ("top", "表", "visitor", "away", "先攻"), "bottom": ("bottom", "裏", "home", "後攻")}


# ---- game reconstruction --------------------------------------------------------------------


def _any_of(c: Column, terms: Sequence[str]) -> Column:
    hit = F.lit(False)
    for t in terms:
        hit = hit | c.contains(t.lower())
    return hit


def half_side(df: DataFrame) -> Column:
    """'away' for the top of an inning, 'home' for the bottom, from half and inning labels."""
    parts = [F.coalesce(F.lower(F.col(c).cast("string")), F.lit("")) for c in ("half", "inning") if c in df.columns]
    label = F.concat_ws(" ", *parts)
    return F.when(_any_of(label, SIDES["top"]), "away").when(_any_of(label, SIDES["bottom"]), "home")


def rebuilt_scores(events: DataFrame) -> DataFrame:
    """Scores per game from added runs by half, else the largest run total named in the event text."""
    side = half_side(events)
    if "added_runs" in events.columns:
        runs = F.greatest(F.coalesce(text.number(F.col("added_runs")), F.lit(0.0)), F.lit(0.0))
        score_of = lambda s: F.coalesce(F.sum(F.when(side == s, runs)), F.lit(0.0))
    else:
        said = F.regexp_extract(F.col("event").cast("string"), r"(?i)(?:runs?|得点)[=: ]+(\d+)", 1)
        runs = F.when(said != "", said.try_cast("double"))
        score_of = lambda s: F.coalesce(F.max(F.when(side == s, runs)), F.lit(0.0))
    return events.groupBy("game_id").agg(score_of("home").alias("home_score"), score_of("away").alias("away_score"))


def aggregate_games(events: DataFrame, classify=None) -> DataFrame:
    """One row per game from ordered event rows: first identity values, last known scores, game type.

    Events are reduced with min_by / max_by, so a game with very many rows combines map-side.
    """
    at = F.col("row_order")
    first = lambda c: F.min_by(text.present(F.col(c)), F.when(text.present(F.col(c)).isNotNull(), at))
    last = lambda c: F.max_by(F.col(c), F.when(F.col(c).isNotNull(), at))
    aggs = [
        F.min_by("home", at).alias("home"), F.min_by("away", at).alias("away"), F.min_by("date", at).alias("datetime"),
        last("home_score").cast("double").alias("_hs"), last("away_score").cast("double").alias("_as"),
    ]
    for source, name in (("home_pitcher", "home_starter"), ("away_pitcher", "away_starter"), ("venue", "venue")):
        if source in events.columns:
            aggs.append(first(source).alias(name))
    games = events.groupBy("game_id").agg(*aggs)
    rebuilt = rebuilt_scores(events).withColumnsRenamed({"home_score": "_rh", "away_score": "_ra"})
    games = games.join(rebuilt, "game_id")
    stated = F.col("_hs").isNotNull() & F.col("_as").isNotNull()
    # The joined type text only matters through its distinct labels, in order of first appearance.
    types = (
        events.groupBy("game_id", "game_type").agg(F.min(at).alias("_at")).filter("game_type is not null")
        .groupBy("game_id").agg(F.array_sort(F.collect_list(F.struct("_at", "game_type"))).alias("_t"))
        .select("game_id", F.concat_ws(" ", F.col("_t.game_type")).alias("game_type"))
    )
    games = games.join(types, "game_id", "left").withColumns(
        {
            "home_score": F.when(stated, F.col("_hs")).otherwise(F.col("_rh")),
            "away_score": F.when(stated, F.col("_as")).otherwise(F.col("_ra")),
            "game_type": F.coalesce(F.col("game_type"), F.lit("UNKNOWN")),
        }
    )
    if "home_starter" in games.columns:
        games = games.withColumn(
            "confirmed_starters", F.col("home_starter").isNotNull() & F.col("away_starter").isNotNull()
        )
    if "venue" in games.columns:
        games = games.withColumn("venue", F.coalesce(F.col("venue"), F.lit("unknown")))
    games = games.drop("_hs", "_as", "_rh", "_ra").filter("home_score is not null and away_score is not null")
    if classify is None:
        return games
    return classify(games).filter("category <> 'excluded'")


def first_pitchers(at_bats: DataFrame) -> DataFrame:
    """Starter per side from the first at-bat of its half-innings; blank when there is no evidence.

    The five-digit serial holds the inning (two digits) and the half (third character).
    """
    serial = F.col("serial").cast("string")
    half = F.upper(F.substring(serial, 3, 1))
    side = F.when(half.isin("T", "1"), "away").when(half.isin("B", "2"), "home")
    known = at_bats.withColumn("_side", side).filter(text.present(F.col("pitcher_id")).isNotNull() & (F.length(serial) >= 3))
    pick = lambda s: F.coalesce(F.min_by(F.col("pitcher_id").cast("string"), F.when(F.col("_side") == s, serial)), F.lit(""))
    return known.groupBy("game_id").agg(pick("home").alias("home_starter"), pick("away").alias("away_starter"))


# ---- batting, pitching and play text ----------------------------------------------------------


def team_batting(records: DataFrame, counters: Sequence[str]) -> DataFrame:
    """Team totals from one record per (game, side, player): the one with the highest counters, compared in their order."""
    best = latest_per_key(records, ["game_id", "side", "player_id"], list(counters))
    return best.groupBy("game_id", "side").agg(*[F.sum(F.coalesce(F.col(c), F.lit(0))).alias(c) for c in counters])


def pitching_line(df: DataFrame) -> DataFrame:
    """Derived pitching rates; stated rates win over derived ones, lines without innings are dropped."""
    x = lambda c: F.col(c).cast("double") if c in df.columns else F.lit(None).cast("double")
    thirds = x("ip3") / 3
    ip = F.coalesce(x("ip") + thirds, x("ip"), thirds)
    base = df.withColumn("ip", ip).filter(F.col("ip") > 0)
    ip = F.col("ip")
    outs = F.greatest(ip * 3, F.lit(1.0))
    return base.withColumns(
        {
            "era": F.coalesce(x("era"), 9 * x("er") / ip),
            "whip": F.coalesce(x("whip"), (x("h") + x("bb")) / ip),
            "k9": F.coalesce(x("k9"), 9 * x("so") / ip),
            "bb9": F.coalesce(x("bb9"), 9 * x("bb") / ip),
            "hr9": F.coalesce(x("hr9"), 9 * x("hr") / ip),
            "fip": F.coalesce(x("fip"), (13 * x("hr") + 3 * x("bb") - 2 * x("so")) / ip + 3.20),
            "k_rate": F.coalesce(x("so"), F.lit(0.0)) / outs,
            "bb_rate": F.coalesce(x("bb"), F.lit(0.0)) / outs,
        }
    ).withColumn("k_minus_bb", F.col("k_rate") - F.col("bb_rate"))


# Play-text classes in matching order, with the counters each one raises.
PLAY_RULES = (
    (("本塁打", "ホームラン"), ("hr", "h", "ab", "pa", "power_events", "contact_events")),
    (("二塁打",), ("doubles", "h", "ab", "pa", "power_events", "contact_events")),
    (("三塁打",), ("triples", "h", "ab", "pa", "power_events", "contact_events")),
    (("四球", "死球"), ("pa",)),
    (("三振",), ("so", "ab", "pa")),
    (("犠打", "バント"), ("sh", "bunt", "pa")),
    (("犠飛",), ("sf", "pa")),
    (("併殺",), ("gidp", "ab", "pa")),
    (("失策",), ("errors", "ab", "pa")),
    (("安打", "単打"), ("h", "ab", "pa", "contact_events")),
    (("ゴロ",), ("groundout", "ab", "pa")),
    (("フライ",), ("flyout", "ab", "pa")),
    (("ライナー",), ("lineout", "ab", "pa")),
)
# Counters of plays and of box lines.
PLAY_COUNTERS = (
    "pa", "ab", "h", "doubles", "triples", "hr", "bb", "hbp", "so", "rbi", "sb", "cs", "sh", "sf", "gidp", "errors", "bunt", "groundout", "flyout", "lineout",
    "power_events", "contact_events", "event_count",
)
BOX_COUNTERS = ("pa", "ab", "h", "doubles", "triples", "hr", "bb", "so", "sb", "cs")


def play_counters(plays: DataFrame, box: DataFrame | None = None) -> DataFrame:
    """Player-game counters from play text: the first matching class of each play, then sums per player.

    Where text names fewer than two players of a game, box totals raise the counters.
    """
    t = F.lower(F.col("event").cast("string"))
    rule = F.lit(None).cast("int")
    for i in reversed(range(len(PLAY_RULES))):
        rule = F.when(_any_of(t, PLAY_RULES[i][0]), i).otherwise(rule)
    raised = {c: [i for i, (_, cs) in enumerate(PLAY_RULES) if c in cs] for c in PLAY_COUNTERS}
    one = lambda cond: F.when(cond, 1).otherwise(0)
    hit = F.col("_rule")
    value = {c: one(hit.isin(*ids)) if ids else F.lit(0) for c, ids in raised.items()}
    value["bb"], value["hbp"] = one((hit == 3) & t.contains("四球")), one((hit == 3) & t.contains("死球"))
    value["rbi"] = one(hit.isNotNull() & (t.contains("打点") | t.contains("rbi")))
    value["cs"] = one(hit.isNotNull() & t.contains("盗塁死"))
    value["sb"] = one(hit.isNotNull() & t.contains("盗塁") & ~t.contains("盗塁死"))
    value["event_count"] = one(hit.isNotNull() | t.contains("盗塁"))
    keys = ["game_id", "side", "player_id"]
    counted = plays.withColumn("_rule", rule).groupBy(*keys).agg(*[F.sum(v).cast("long").alias(c) for c, v in value.items()])
    if box is not None:
        few = counted.groupBy("game_id").agg(F.count(F.lit(1)).alias("_n"))
        extra = box.join(few, "game_id", "left").filter(F.coalesce(F.col("_n"), F.lit(0)) < 2).drop("_n")
        extra = extra.select(*keys, *[F.col(c).cast("long").alias(f"_{c}") for c in BOX_COUNTERS if c in box.columns])
        counted = counted.join(extra, keys, "full_outer")
        counted = counted.withColumns(
            {
                c: F.greatest(F.coalesce(F.col(c), F.lit(0)), F.coalesce(F.col(f"_{c}"), F.lit(0)))
                if f"_{c}" in counted.columns else F.coalesce(F.col(c), F.lit(0))
                for c in PLAY_COUNTERS
            }
        ).select(*keys, *PLAY_COUNTERS)
    pa = F.greatest("pa", "ab", "bb", "hbp", "sf", "sh")
    acted = F.col("event_count") + sum((F.col(c) for c in ("pa", "ab", "h", "hr", "bb", "so", "sb")), start=F.col("cs")) > 0
    return counted.filter(acted).withColumn("pa", pa)


# ---- forecast reports -------------------------------------------------------------------------


def vector_of(df: DataFrame, columns: Sequence[str] = ("pred_home", "pred_draw", "pred_away"), name: str = "p") -> DataFrame:
    return df.withColumn(name, prob.vector(*columns))


def with_scores(df: DataFrame) -> DataFrame:
    """Row-level correctness, losses, Low/High call and top-4 hit of three-way forecasts."""
    base = vector_of(df).withColumn("p", prob.normalise(F.col("p")))
    lh, la = F.col("lambda_home"), F.col("lambda_away")
    low = dist.low_total(lh, la)
    base = score_candidates(base)
    ah, aa = F.col("actual_home_score"), F.col("actual_away_score")
    label = F.when((ah >= 7) | (aa >= 7), "OTHER").otherwise(
        F.concat_ws("-", ah.cast("long").cast("string"), aa.cast("long").cast("string"))
    )
    return base.withColumns(
        {
            "correct": (prob.favourite(F.col("p")) == F.col("actual")).cast("double"),
            "logloss": prob.log_loss(F.col("p"), F.col("actual")),
            "brier": prob.brier(F.col("p"), F.col("actual")),
            "high": F.lit(1.0) - low,
            "actual_high": (ah + aa >= 7).cast("double"),
        }
    ).withColumn(
        "top4_hit", F.exists(F.col("candidates"), lambda c: c["label"] == label).cast("double")
    )


def summary_terms() -> dict[str, Column]:
    gap = lambda side: F.abs(F.col(f"actual_{side}_score") - F.col(f"lambda_{side}"))
    call = (F.col("high") >= 0.5).cast("double")
    return {
        "predictions": F.count(F.lit(1)),
        "accuracy": F.avg("correct"),
        "logloss": F.avg("logloss"),
        "brier": F.avg("brier"),
        "score_mae": F.avg((gap("home") + gap("away")) / 2),
        "high_rate": F.avg("actual_high"),
        "low_high_accuracy": F.avg((call == F.col("actual_high")).cast("double")),
        "top4_rate": F.avg("top4_hit"),
    }


def summarise(scored: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    terms = [c.alias(n) for n, c in summary_terms().items()]
    return scored.groupBy(*keys).agg(*terms) if keys else scored.agg(*terms)


def leaderboard(scored: DataFrame, key: str = "model") -> DataFrame:
    """Models ordered by log loss, Brier, then accuracy."""
    board = scored.groupBy(key).agg(
        F.count(F.lit(1)).alias("predictions"), F.avg("correct").alias("accuracy"),
        F.avg("logloss").alias("logloss"), F.avg("brier").alias("brier"),
    )
    # One row per model: the rank window sorts the report, never the forecasts.
    by = Window.orderBy("logloss", "brier", F.col("accuracy").desc(), key)
    return board.withColumn("rank", F.row_number().over(by).cast("long"))


def calibration_table(df: DataFrame, p: str, hit: Column, bins: int = 10) -> DataFrame:
    """(lo, hi] bins with the lowest edge included; empty bins are kept."""
    edges = [i / bins for i in range(1, bins)]
    which = F.size(F.filter(F.array(*[F.lit(e) for e in edges]), lambda e: F.col(p) > e)).cast("long")
    found = df.groupBy(which.alias("bin")).agg(
        F.count(F.lit(1)).alias("rows"), F.avg(p).alias("mean_p"), F.avg(hit.cast("double")).alias("rate")
    )
    every = df.sparkSession.range(bins).withColumnRenamed("id", "bin")
    return every.join(found, "bin", "left").withColumn("rows", F.coalesce(F.col("rows"), F.lit(0)))


def auc(df: DataFrame, p: str, positive: Column, keys: Sequence[str] = ()) -> DataFrame:
    """Area under the ROC curve by rank sums with average ranks for ties.

    Scores are combined to one row per distinct value first; ranks come from a sliced running count.
    """
    keys = list(keys)
    anchor = keys or ["_all"]
    base = df.withColumn("_all", F.lit(0)) if not keys else df
    per = base.groupBy(*anchor, p).agg(
        F.count(F.when(positive, 1)).alias("_pos"), F.count(F.when(~positive, 1)).alias("_neg")
    )
    line = Timeline(per, anchor, [p]).running({"_below": F.col("_neg")})
    out = line.groupBy(*anchor).agg(
        F.sum("_pos").alias("positives"), F.sum("_neg").alias("negatives"),
        F.sum(F.col("_pos") * (F.col("_below") + F.col("_neg") / 2.0)).alias("_u"),
    )
    pairs = F.col("positives").cast("double") * F.col("negatives")
    return out.select(*keys, "positives", "negatives", (F.col("_u") / F.nullif(pairs, F.lit(0.0))).alias("auc"))


def condition_accuracy(df: DataFrame, conditions: Sequence[str], correct: str = "correct") -> DataFrame:
    """Accuracy per value of each condition in one pass; missing values are 'unknown', weakest first."""
    pairs = F.array(
        *[F.struct(F.lit(c).alias("condition"), F.coalesce(F.col(c).cast("string"), F.lit("unknown")).alias("value")) for c in conditions]
    )
    return (
        df.select(F.explode(pairs).alias("c"), F.col(correct).cast("double").alias("_ok"))
        .groupBy("c.condition", "c.value").agg(F.count(F.lit(1)).alias("samples"), F.avg("_ok").alias("accuracy"))
        .orderBy("condition", "accuracy", "value")
    )


def condition_cube(df: DataFrame, first: str, second: str, correct: str = "correct") -> DataFrame:
    """Accuracy by both conditions, by each alone and overall (grouping sets)."""
    label = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("unknown"))
    base = df.select(label(first).alias(first), label(second).alias(second), F.col(correct).cast("double").alias("_ok"))
    sets = [[F.col(first), F.col(second)], [F.col(first)], [F.col(second)], []]
    return base.groupingSets(sets, F.col(first), F.col(second)).agg(
        F.count(F.lit(1)).alias("samples"), F.avg("_ok").alias("accuracy")
    )


def confusion(scored: DataFrame, both_sides: bool = True) -> DataFrame:
    """Low/High confusion and side errors; 'high' means either side at seven or more, or the total."""
    ah, aa = F.col("actual_home_score"), F.col("actual_away_score")
    high = ((ah >= 7) | (aa >= 7)) if both_sides else (ah + aa >= 7)
    call = F.col("high") >= 0.5
    rate = lambda hit, of: F.sum(F.when(hit, 1.0).otherwise(0.0)) / F.greatest(F.sum(F.when(of, 1.0).otherwise(0.0)), F.lit(1.0))
    return scored.agg(
        F.count_if(call & high).alias("high_tp"), F.count_if(call & ~high).alias("high_fp"), F.count_if(~call & high).alias("high_fn"),
        rate(call & high, high).alias("high_accuracy"), rate(~call & ~high, ~high).alias("low_accuracy"),
        F.avg(F.abs(ah - F.col("lambda_home"))).alias("home_mae"), F.avg(F.abs(aa - F.col("lambda_away"))).alias("away_mae"),
        F.avg(F.abs(ah + aa - F.col("lambda_home") - F.col("lambda_away"))).alias("total_mae"),
    )


def dispersion(df: DataFrame, value: str, keys: Sequence[str]) -> DataFrame:
    """Method-of-moments over-dispersion: alpha for the NLL and the bounded NB size."""
    x = F.col(value).cast("double")
    n, mu, pop, samp = F.count(x), F.avg(x), F.var_pop(x), F.var_samp(x)
    agg = df.groupBy(*keys).agg(n.alias("n"), mu.alias("mu"), pop.alias("_pop"), samp.alias("_samp"))
    excess = F.col("_samp") - F.col("mu")
    size = F.when((F.col("n") < 8) | (excess <= 1e-9), 1e6).otherwise(
        F.least(F.greatest(F.col("mu") * F.col("mu") / F.nullif(excess, F.lit(0.0)), F.lit(0.25)), F.lit(1e6))
    )
    alpha = F.greatest((F.col("_pop") - F.col("mu")) / F.greatest(F.col("mu") * F.col("mu"), F.lit(0.25)), F.lit(0.03))
    return agg.select(*keys, "n", "mu", alpha.alias("alpha"), size.alias("size"))


def shared_component(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Residual covariance of the two sides, clipped to [0, 0.85 * the smaller median mean]."""
    rh, ra = F.col("home_score") - F.col("lambda_home"), F.col("away_score") - F.col("lambda_away")
    cov = df.groupBy(*keys).agg(F.covar_pop(rh, ra).alias("_cov"))
    mid = {"m": lambda n: (n - 1) / 2.0}
    home = values_at_ranks(df, keys, "lambda_home", mid).withColumnRenamed("m", "_mh")
    away = values_at_ranks(df, keys, "lambda_away", mid).withColumnRenamed("m", "_ma")
    joined = cov.join(home, list(keys)).join(away, list(keys))
    upper = F.greatest(F.least("_mh", "_ma") * 0.85, F.lit(0.0))
    return joined.select(*keys, F.least(F.greatest("_cov", F.lit(0.0)), upper).alias("shared"))


def base_rate(df: DataFrame, target: Column, expected: Column, keys: Sequence[str] = ()) -> DataFrame:
    """Home-win base rate and how much a rating's calls improve on it."""
    hit = ((expected > 0.5) == target).cast("double")
    out = df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("samples"), F.avg(hit).alias("accuracy"), F.avg(target.cast("double")).alias("base_rate")
    )
    return out.withColumn("improvement", F.col("accuracy") - F.col("base_rate"))


# ---- data quality and integrity ---------------------------------------------------------------


def quality_profile(df: DataFrame, numeric: Sequence[str]) -> DataFrame:
    """One row: size, exact duplicates, missing shares and extreme-outlier shares with PASS / FAIL.

    Quartiles are nearest-rank values at n // 4 and 3n // 4; outliers lie beyond five interquartile ranges.
    """
    size = df.agg(
        F.count(F.lit(1)).alias("rows"),
        *[F.avg(F.col(c).isNull().cast("double")).alias(f"missing_{c}") for c in df.columns],
    )
    # Digests travel for every row; whole rows only where a digest repeats, which decides nothing by itself.
    digest = F.xxhash64(*df.columns)
    shared = measured(df.groupBy(digest.alias("_digest")).agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").select("_digest"))
    suspects = df.withColumn("_digest", digest).join(shared, "_digest", "left_semi")
    repeated = (
        suspects.groupBy("_digest", *df.columns).agg(F.count(F.lit(1)).alias("_n")).agg(F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).alias("duplicates"))
    )
    # All numeric columns travel as (column, value) so that quartiles need one pass, not one per column.
    long = df.select(
        F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("v")) for c in numeric])).alias("x")
    ).select("x.column", "x.v").filter("v is not null and not isnan(v)")
    quart = values_at_ranks(long, ["column"], "v", {"q1": lambda n: F.floor(n / 4), "q3": lambda n: F.floor(3 * n / 4)})
    fence = quart.withColumn("_w", (F.col("q3") - F.col("q1")) * 5)
    # A fence is one row per column of the table: met by key, every value of a column would travel to one task.
    out = (
        long.join(F.broadcast(fence), "column").groupBy("column").agg(
            F.count(F.lit(1)).alias("_n"), F.max("_w").alias("_w"),
            F.count_if((F.col("v") < F.col("q1") - F.col("_w")) | (F.col("v") > F.col("q3") + F.col("_w"))).alias("_out"),
        )
        .filter((F.col("_n") >= 20) & (F.col("_w") > 0) & (F.col("_out") / F.col("_n") > 0.10))
        .agg(F.count(F.lit(1)).alias("outlier_columns"))
    )
    sparse = sum((F.when(F.col(f"missing_{c}") > 0.20, 1).otherwise(0) for c in df.columns), start=F.lit(0)).cast("long")
    # Three one-row frames side by side.
    one = size.withColumn("_k", F.lit(1)).join(repeated.withColumn("_k", F.lit(1)), "_k").join(out.withColumn("_k", F.lit(1)), "_k")
    status = F.when((F.col("rows") == 0) | (F.col("duplicates") > 0), "FAIL").otherwise("PASS")
    return one.select("rows", "duplicates", sparse.alias("sparse_columns"), "outlier_columns", status.alias("status"))


def probability_integrity(df: DataFrame, classes: Sequence[str], key: str, tolerance: float = 1e-6) -> DataFrame:
    """Violation counts per rule over the league's own classes, with a fail-closed status."""
    cols = [F.col(c) for c in classes]
    missing = sum((c.isNull().cast("int") for c in cols), start=F.lit(0)) > 0
    outside = F.lit(False)
    for c in cols:
        outside = outside | (c < 0) | (c > 1) | F.isnan(c)
    mass = F.abs(sum(cols[1:], start=cols[0]) - 1.0) > tolerance
    checks = df.agg(
        F.count(F.lit(1)).alias("rows"), F.count_if(missing).alias("missing"),
        F.count_if(F.coalesce(outside, F.lit(False))).alias("outside"), F.count_if(F.coalesce(mass, F.lit(False))).alias("mass"),
    )
    repeats = df.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).agg(F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).alias("repeated"))
    both = checks.withColumn("_k", F.lit(1)).join(repeats.withColumn("_k", F.lit(1)), "_k").drop("_k")
    bad = F.col("missing") + F.col("outside") + F.col("mass") + F.col("repeated") > 0
    return both.withColumn("status", F.when(bad | (F.col("rows") < 2), "FAIL").otherwise("PASS"))


def coverage_gate(games: DataFrame, season: Column, home: str, away: str, threshold: float, critical_from: int | None = None) -> DataFrame:
    """Share of games per season with both starters known; seasons below the threshold fail."""
    both = text.present(F.col(home)).isNotNull() & text.present(F.col(away)).isNotNull()
    out = games.groupBy(season.cast("long").alias("season")).agg(
        F.count(F.lit(1)).alias("games"), F.count_if(both).alias("both_starters")
    )
    rate = F.col("both_starters") / F.col("games") * 100
    critical = F.lit(True) if critical_from is None else F.col("season") >= critical_from
    return out.withColumns(
        {
            "coverage_pct": rate,
            "status": F.when(~critical, "REFERENCE_ONLY").when(rate >= threshold, "PASS").otherwise("FAIL"),
        }
    )


def season_status(games: DataFrame, season: Column, complete: Column) -> DataFrame:
    """Completeness per season and over all seasons (null season)."""
    base = games.select(season.cast("long").alias("season"), complete.alias("_ok"))
    return base.groupingSets([[F.col("season")], []], F.col("season")).agg(
        F.count(F.lit(1)).alias("games"), F.count_if("_ok").alias("complete_games"), F.bool_and("_ok").alias("all_complete")
    )


def zero_filled_pivot(df: DataFrame, key: str, column: str, values: Sequence[str]) -> DataFrame:
    """Counts per known value; the value list is fixed, so no distinct scan is needed."""
    return df.groupBy(key).agg(*[F.count_if(F.col(column) == v).alias(v.lower()) for v in values])


def weaknesses(summary: DataFrame, key: str = "league", n: int = 20) -> DataFrame:
    """Improvement priorities per league and objective, largest first."""
    pos = lambda c: F.greatest(c, F.lit(0.0))
    parts = {
        "win": pos(F.lit(0.65) - F.col("accuracy")) + pos(F.col("logloss") - 0.67),
        "score": pos(F.col("score_mae") - 2.0) * 0.35,
        "low_high": pos(F.lit(0.68) - F.col("low_high_accuracy")),
        "calibration": pos(F.col("brier") - 0.25),
    }
    rows = F.array(*[F.struct(F.lit(n).alias("objective"), c.alias("priority")) for n, c in parts.items()])
    out = summary.select(key, F.explode(rows).alias("r")).select(key, "r.objective", "r.priority")
    return out.orderBy(F.col("priority").desc(), key, "objective").limit(n)


def status_rollup(df: DataFrame, status: str = "status") -> DataFrame:
    """PASS when every part passes, PARTIAL when some do, DEFERRED otherwise."""
    n, ok = F.count(F.lit(1)), F.count_if(F.col(status) == "PASS")
    return df.agg(n.alias("parts"), ok.alias("passed")).withColumn(
        "status",
        F.when((F.col("parts") > 0) & (F.col("passed") == F.col("parts")), "PASS").when(F.col("passed") > 0, "PARTIAL").otherwise("DEFERRED"),
    )


def high_confidence_error(df: DataFrame, p: str, y: str, keys: Sequence[str], threshold: float = 0.70) -> DataFrame:
    """Error rate of forecasts whose favourite has at least the threshold probability."""
    sure = F.array_max(F.col(p)) >= threshold
    wrong = (prob.favourite(F.col(p)) != F.col(y)).cast("double")
    return df.groupBy(*keys).agg(F.count_if(sure).alias("sure_rows"), F.avg(F.when(sure, wrong)).alias("error_rate"))


def at_least_quantile(df: DataFrame, value: str, q: float, keys: Sequence[str]) -> DataFrame:
    """Rows whose value reaches its group's q-quantile (linear interpolation)."""
    cut = measured(values_at_ranks(df, keys, value, {"_cut": lambda n: (n - 1) * F.lit(q)}))
    joined = df.join(cut, list(keys)) if keys else df.withColumn("_k", F.lit(1)).join(cut.withColumn("_k", F.lit(1)), "_k").drop("_k")
    return joined.filter(F.col(value) >= F.col("_cut")).drop("_cut")


def metric_bundle(df: DataFrame, keys: Sequence[str], p: str = "p", y: str = "actual", floor: float = 1e-12) -> DataFrame:
    return score.bundle(df, keys, p, y, floor)
