"""Source harmonisation: labels, taxonomy, eligibility and point-in-time predicates as columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from matchloom.functions import text
from matchloom.plans.durable import spool
from matchloom.plans.ordered import latest_per_key

# Competition taxonomy. Exclusion terms are tested first, then the groups in this order.
EXCLUDED_TERMS = (
    "オープン戦", "春季キャンプ", "キャンプ", "ファーム", "二軍", "二軍公式戦", "教育リーグ", "春季教育リーグ",
    "秋季教育リーグ", "練習試合", "紅白戦", "practice", "training", "minor league", "farm", "open game", "exhibition",
)
CATEGORY_TERMS = {
    "climax": ("クライマックスシリーズ", "クライマックス", "CSファースト", "CSファイナル", "climax series", "climax"),
    "japan_series": ("日本シリーズ", "日本選手権シリーズ", "japan series"),
    "allstar": ("オールスター", "all-star", "all star", "フレッシュオールスター", "fresh all-star"),
    "special": (
        "親善試合", "特別試合", "壮行試合", "チャリティー試合", "記念試合", "エキシビション", "special game", "friendly", "friendship",
    ),
    "interleague": ("交流戦", "セ・パ交流戦", "interleague"),
    "regular": ("セ・リーグ公式戦", "パ・リーグ公式戦", "公式戦", "レギュラーシーズン", "regular season"),
}
TRAINING = ("regular", "interleague")
EVALUATION = ("regular", "interleague", "climax", "japan_series", "allstar", "special")
# Numeric competition codes of raw schedules.
KIND_CODES = {
    1: "regular", 2: "regular", 11: "regular", 26: "interleague", 3: "japan_series", 4: "allstar", 13: "allstar",
    35: "climax", 36: "climax", 37: "climax", 38: "climax", 5: "excluded",
}
# Context states that may be used, and retired weather-provenance labels.
USABLE_STATES = ("VERIFIED", "PROJECTED")
RETIRED_WEATHER = ("", "UNKNOWN", "CONSERVATIVE_8H_BOUND", "FAIL_CLOSED_NO_ISSUANCE_TIMESTAMP")
# Team short names and their canonical forms.
TEAM_ALIASES = {
    "巨人": "読売ジャイアンツ",
    "読売": "読売ジャイアンツ",
    "阪神": "阪神タイガース",
    "中日": "中日ドラゴンズ",
    "広島": "広島東洋カープ",
    "ヤクルト": "東京ヤクルトスワローズ",
    "東京ヤクルト": "東京ヤクルトスワローズ",
    "DeNA": "横浜DeNAベイスターズ",
    "ＤｅＮＡ": "横浜DeNAベイスターズ",
    "横浜": "横浜DeNAベイスターズ",
    "横浜DeNA": "横浜DeNAベイスターズ",
    "ソフトバンク": "福岡ソフトバンクホークス",
    "福岡ソフトバンク": "福岡ソフトバンクホークス",
    "西武": "埼玉西武ライオンズ",
    "埼玉西武": "埼玉西武ライオンズ",
    "日本ハム": "北海道日本ハムファイターズ",
    "日ハム": "北海道日本ハムファイターズ",
    "北海道日本ハム": "北海道日本ハムファイターズ",
    "ロッテ": "千葉ロッテマリーンズ",
    "千葉ロッテ": "千葉ロッテマリーンズ",
    "楽天": "東北楽天ゴールデンイーグルス",
    "東北楽天": "東北楽天ゴールデンイーグルス",
    "オリックス": "オリックス・バファローズ",
}


def _mentions(label: Column, terms: Sequence[str]) -> Column:
    hit = F.lit(False)
    for term in terms:
        hit = hit | label.contains(term.lower())
    return hit


def category(label: Column) -> Column:
    """Competition class of a free-text game type."""
    clean = text.collapse(label)
    out = F.when(_mentions(clean, EXCLUDED_TERMS), "excluded")
    for name, terms in CATEGORY_TERMS.items():
        out = out.when(_mentions(clean, terms), name)
    return out.otherwise("unknown")


def policy_set(value: str | None, default: Sequence[str]) -> tuple[str, ...]:
    """Distinct lower-case names of a comma list, or the default when it is blank."""
    if value is None or not value.strip():
        return tuple(default)
    return tuple(dict.fromkeys(x.strip().lower() for x in value.split(",") if x.strip()))


def classify(df: DataFrame, label: str = "game_type", training: Sequence[str] = TRAINING, evaluation: Sequence[str] = EVALUATION) -> DataFrame:
    found = category(F.col(label))
    return df.withColumns(
        {
            "category": found,
            "confidence": F.when(found == "unknown", "low").otherwise("high"),
            "training_default": found.isin(*training),
            "evaluation_default": found.isin(*evaluation),
        }
    )


def kind_category(code: Column) -> Column:
    table = F.create_map(*[F.lit(x) for kv in KIND_CODES.items() for x in kv])
    return F.coalesce(F.try_element_at(table, code.try_cast("int")), F.lit("unknown"))


def override_category(games: DataFrame, raw_codes: DataFrame) -> DataFrame:
    """Raw competition codes beat stored labels; eligibility is recomputed only where a label was recovered.

    ``raw_codes`` has (game_id, kind_code), one row per game.
    """
    joined = games.join(raw_codes.select("game_id", kind_category(F.col("kind_code")).alias("_raw")), "game_id", "left")
    recovered = F.col("_raw").isNotNull() & (F.col("_raw") != "unknown")
    return joined.withColumns(
        {
            "category_recovered": recovered,
            "training_default": F.when(recovered, F.col("_raw").isin(*TRAINING)).otherwise(F.col("training_default")),
            "evaluation_default": F.when(recovered, F.col("_raw").isin(*EVALUATION)).otherwise(F.col("evaluation_default")),
            "category": F.when(recovered, F.col("_raw")).otherwise(F.col("category")),
        }
    ).drop("_raw")


def outcome(home: Column, away: Column, classes: int = 3) -> Column:
    """0 home, 1 draw, 2 away; with two classes 0 home, 1 otherwise."""
    if classes == 2:
        return F.when(home > away, 0).otherwise(1).cast("long")
    return F.when(home > away, 0).when(home == away, 1).otherwise(2).cast("long")


def outcome_letter(home: Column, away: Column) -> Column:
    return F.when(home > away, "H").when(home < away, "A").when(home == away, "D")


def pit_usable(
    available: Column, cutoff: Column, state: Column | None = None, allowed: Sequence[str] = USABLE_STATES,
    weather_quality: Column | None = None,
) -> Column:
    """Known by an explicit cutoff and in a usable state; anything unknown is false."""
    ok = available <= cutoff
    if state is not None:
        ok = ok & F.upper(F.trim(state)).isin(*allowed)
    if weather_quality is not None:
        ok = ok & ~F.upper(F.trim(F.coalesce(weather_quality, F.lit("")))).isin(*RETIRED_WEATHER)
    return F.coalesce(ok, F.lit(False))


def line_violations(df: DataFrame) -> Column:
    """Contract violations of a totals line, as an array of rule names."""
    line = F.col("line")
    blank = lambda c: text.present(F.col(c)).isNull()
    half = F.abs(line * 2 - F.round(line * 2)) > 1e-9
    iso = lambda c: F.try_to_timestamp(F.col(c).cast("string")).isNull()
    rules = {
        "event_id": blank("event_id"), "league": blank("league"), "source": blank("source"),
        "line": line.isNull() | F.isnan(line) | (line < 0) | half,
        "observed_at": iso("observed_at"), "available_at": iso("available_at"),
        "status": ~F.coalesce(F.col("status").isin("KNOWN", "UNKNOWN"), F.lit(False)),
    }
    return F.array_compact(F.array(*[F.when(bad, F.lit(name)) for name, bad in rules.items()]))


def line_result(total: Column, line: Column) -> Column:
    valid = line.isNotNull() & (line >= 0) & (F.abs(line * 2 - F.round(line * 2)) <= 1e-9)
    push = (line == F.floor(line)) & (total == line)
    return F.when(valid, F.when(push, "PUSH").when(total < line, "LOW").otherwise("HIGH"))


def schedule_state(start: Column, now: Column) -> Column:
    return F.when(start > now, "FUTURE").otherwise("STARTED")


def eligibility(model_available: Column, starter_state: Column) -> Column:
    """struct(eligible, reason): a model and both verified starters are required."""
    verified = F.coalesce(F.upper(starter_state) == "VERIFIED", F.lit(False))
    have = F.coalesce(model_available, F.lit(False))
    reason = F.when(~have, "MODEL_UNAVAILABLE").when(~verified, "STARTERS_UNCONFIRMED").otherwise("READY")
    return F.struct((have & verified).alias("eligible"), reason.alias("reason"))


def context_free(df: DataFrame) -> DataFrame:
    """Drop match-day context columns."""
    return df.drop(*[c for c in df.columns if c.lower().startswith("weather_") or "lineup_" in c.lower()])


def pregame_columns(df: DataFrame) -> list[str]:
    """Numeric columns that are explicitly pre-game and not a target."""
    numeric = ("int", "bigint", "smallint", "tinyint", "float", "double", "decimal")
    banned = {f"{p}{x}" for p in ("feature_", "pregame_") for x in ("actual", "target")}
    return sorted(
        n for n, t in df.dtypes
        if n.lower().startswith(("feature_", "pregame_")) and n.lower() not in banned and t.split("(")[0] in numeric
    )


def shot_efficiency(df: DataFrame) -> DataFrame:
    """Conversion and accuracy ratios; no shots gives null."""
    out = {}
    for side in ("home", "away"):
        out[f"shot_conversion_{side}"] = F.try_divide(F.col(f"{side}_score"), F.nullif(F.col(f"shots_{side}"), F.lit(0)))
        out[f"shot_accuracy_{side}"] = F.try_divide(F.col(f"sot_{side}"), F.nullif(F.col(f"shots_{side}"), F.lit(0)))
    return df.withColumns(out)


def percent(c: Column) -> Column:
    return F.round(c * 100, 2)


def normalise_events(events: DataFrame) -> DataFrame:
    """Heterogeneous event rows to one schema: clean ids, UTC time from local time, running row order."""
    from matchloom.plans.ordered import Timeline

    gid = F.regexp_replace(F.trim(text.pick(events, ["game_id", "gameid", "gamepk"])), r"\.0$", "")
    when = F.to_utc_timestamp(F.try_to_timestamp(text.pick(events, ["datetime", "date", "game_date"])), "Asia/Tokyo")
    out = events.select(
        gid.alias("game_id"), when.alias("datetime"),
        text.pick(events, ["home", "home_team", "hometeam"]).alias("home"),
        text.pick(events, ["away", "away_team", "visitor"]).alias("away"),
        text.number(text.pick(events, ["home_score", "hscore"])).alias("home_score"),
        text.number(text.pick(events, ["away_score", "vscore", "ascore"])).alias("away_score"),
        text.pick(events, ["home_starter", "home_pitcher"], "").alias("home_starter"),
        text.pick(events, ["away_starter", "away_pitcher"], "").alias("away_starter"),
        text.pick(events, ["game_type", "gametype"], "UNKNOWN").alias("game_type"),
        text.number(text.pick(events, ["seqno", "row_order", "seq"])).alias("_seq"),
    ).filter("game_id is not null and home is not null and away is not null and datetime is not null")
    # Written once: the rows are counted and ranked, and cleaning them costs far more than reading them.
    out = spool(out.withColumn("_unordered", F.col("_seq").isNull()), "events")
    ranked = Timeline(out, ["game_id"], ["_unordered", "_seq", "datetime"]).positions("row_order")
    return ranked.withColumn("row_order", F.col("row_order") - 1).drop("_seq", "_unordered")


def season_schedule(raw: DataFrame, year: int) -> DataFrame:
    """One clean row per finished, competitive game of a season (March to December)."""
    day, clock = text.pick(raw, ["DateJPN", "game_date", "date"]), text.pick(raw, ["TimeJPN", "game_time", "time"])
    out = raw.select(
        text.pick(raw, ["GameID", "game_id", "gamepk"]).alias("game_id"),
        text.stamp(day, clock, "UTC").alias("datetime"),
        text.canonical(text.pick(raw, ["HTeamNameS", "home_team_short_name", "home_team", "home"]), TEAM_ALIASES).alias("home"),
        text.canonical(text.pick(raw, ["VTeamNameS", "away_team_short_name", "away_team", "away"]), TEAM_ALIASES).alias("away"),
        text.number(text.pick(raw, ["HScore", "home_score"])).alias("home_score"),
        text.number(text.pick(raw, ["VScore", "away_score"])).alias("away_score"),
        text.pick(raw, ["GameKindName", "game_type_name", "game_type"], "UNKNOWN").alias("game_type"),
        text.pick(raw, ["StadiumName", "venue"], "").alias("venue"),
    )
    out = classify(out.dropna(subset=["game_id", "datetime", "home", "away", "home_score", "away_score"]))
    inside = (F.year("datetime") == year) & F.month("datetime").between(3, 12)
    kept = out.filter((F.col("category") != "excluded") & inside)
    return latest_per_key(kept, ["game_id"], ["datetime", "home", "away", "home_score", "away_score", "game_type", "venue"])


def raw_schedule(raw: DataFrame, kinds: bool = True) -> DataFrame:
    """Finished games of a raw schedule with competition class from the kind code; last row per game wins."""
    done = raw.filter(F.col("game_state").cast("int") == 2)
    seq = F.col("SeqNo").cast("long") if "SeqNo" in raw.columns else F.lit(0).cast("long")
    out = done.select(
        F.col("game_id").cast("string").alias("game_id"), F.try_to_timestamp(F.col("game_date").cast("string")).alias("datetime"),
        text.canonical(F.col("home_team_short_name"), TEAM_ALIASES).alias("home"),
        text.canonical(F.col("away_team_short_name"), TEAM_ALIASES).alias("away"),
        text.number(F.col("home_score")).alias("home_score"), text.number(F.col("away_score")).alias("away_score"),
        F.col("stadium_name_jpn").alias("venue"), kind_category(F.col("game_kind_id")).alias("category"), seq.alias("_seq"),
    ).dropna(subset=["game_id", "home_score", "away_score"]).filter("category <> 'excluded'")
    return latest_per_key(out, ["game_id"], ["datetime", "_seq"]).drop("_seq")
