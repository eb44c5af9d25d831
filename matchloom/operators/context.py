"""Match-day context: observations, change events, learned effects, bounded policies and their gates."""

from __future__ import annotations

import json
from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from matchloom.functions import prob, score
from matchloom.operators import drift, harmonise
from matchloom.operators.calibrate import linspace, over_grid
from matchloom.plans.durable import spool
from matchloom.plans.ordered import Timeline

# Context events and the pairs in which the first clears the second.
EVENTS = (
    "STARTER_CONFIRMED", "STARTER_CHANGED", "LINEUP_PROJECTED", "LINEUP_CONFIRMED", "LINEUP_CHANGED", "PLAYER_OUT", "PLAYER_RETURNED",
    "WEATHER_CHANGED", "REST_ASYMMETRY", "TRAVEL_BURDEN", "MARKET_MOVED", "BULLPEN_STATE_CHANGED", "WEATHER_PRESENT", "REST_TRAVEL_PRESENT",
)
CLEARS = {"PLAYER_RETURNED": "PLAYER_OUT", "LINEUP_CONFIRMED": "LINEUP_PROJECTED"}
OUT_WORDS, BACK_WORDS = ("OUT", "IL", "SCRATCH"), ("ACTIVE", "RETURNED")
# Effect learning and gate thresholds.
EFFECT = {"rows": 160, "event_rows": 25, "shrink": 20.0, "cap": 0.15, "floor": 0.005, "binary_cap": 0.65}
GATE = {"logloss": 0.0005, "brier": 0.00025, "accuracy": 0.005, "ece": 0.010}


def _events(*pairs: tuple[Column, str]) -> Column:
    return F.array_distinct(F.array_compact(F.array(*[F.when(cond, F.lit(name)) for cond, name in pairs])))


class Rule(NamedTuple):
    """A change event of one kind: a state is entered, or a word is reached (``source`` and ``unless`` look at the word before),
    or both sides of a JSON value stand apart, or else the value changes. Words are compared in upper case."""

    kind: str
    event: str
    state: str = ""
    to: tuple[str, ...] = ()
    source: tuple[str, ...] = ()
    unless: tuple[str, ...] = ()
    apart: str = ""


# The change events between two consecutive observations of one kind.
RULES = (
    Rule("STARTER", "STARTER_CONFIRMED", state="VERIFIED"), Rule("STARTER", "STARTER_CHANGED"),
    Rule("LINEUP", "LINEUP_PROJECTED", state="PROJECTED"), Rule("LINEUP", "LINEUP_CONFIRMED", state="VERIFIED"),
    Rule("INJURY", "PLAYER_OUT", to=OUT_WORDS, unless=OUT_WORDS), Rule("INJURY", "PLAYER_RETURNED", to=BACK_WORDS, source=OUT_WORDS),
    Rule("WEATHER", "WEATHER_CHANGED"), Rule("MARKET", "MARKET_MOVED"), Rule("BULLPEN", "BULLPEN_STATE_CHANGED"),
    Rule("REST_TRAVEL", "REST_ASYMMETRY", apart="rest_days"),
    Rule("AVAILABILITY", "PLAYER_OUT", to=("PLAYER_OUT",), unless=("PLAYER_OUT",)),
    Rule("AVAILABILITY", "PLAYER_RETURNED", to=("PLAYER_RETURNED",), unless=("PLAYER_RETURNED",)),
)
APART = 1e-9


def delta_rules(kind: Column, old_state: Column, new_state: Column, old: Column, new: Column, had: Column) -> Column:
    """The events of ``RULES`` as an array column."""
    before, after = F.upper(F.coalesce(old, F.lit(""))), F.upper(F.coalesce(new, F.lit("")))

    def side(name: str, of: str) -> Column:
        text = F.get_json_object(new, f"$.{name}.{of}")
        return F.when(text.isNull(), F.lit(0.0)).otherwise(text.try_cast("double"))

    def holds(rule: Rule) -> Column:
        if rule.state:
            return (new_state == rule.state) & ~old_state.eqNullSafe(F.lit(rule.state))
        if rule.to:
            return after.isin(*rule.to) & (before.isin(*rule.source) if rule.source else F.lit(True)) & ~before.isin(*rule.unless or ("\0",))
        if rule.apart:
            return F.abs(side("home", rule.apart) - side("away", rule.apart)) > APART
        return had & ~old.eqNullSafe(new)

    return _events(*[((kind == rule.kind) & holds(rule), rule.event) for rule in RULES])


def row_events(kind: str, old: tuple | None, state: str | None, value: str | None) -> list[str]:
    """The events of ``RULES`` for one observation in a stream; ``old`` is the (state, value) before it, or None."""
    before, after = ("" if old is None or old[1] is None else old[1].upper()), ("" if value is None else value.upper())

    def side(document: object, name: str, of: str) -> float:
        part = document.get(name) if isinstance(document, dict) else None
        found = part.get(of) if isinstance(part, dict) else None
        if isinstance(found, bool):
            raise ValueError("not a number")
        return 0.0 if found is None else float(found)

    def holds(rule: Rule) -> bool:
        if rule.state:
            return state == rule.state and (old is None or old[0] != rule.state)
        if rule.to:
            return after in rule.to and (not rule.source or before in rule.source) and before not in rule.unless
        if rule.apart:
            try:
                document = json.loads(value or "")
                return abs(side(document, "home", rule.apart) - side(document, "away", rule.apart)) > APART
            except (ValueError, TypeError):
                return False
        return old is not None and old[1] != value

    return list(dict.fromkeys(rule.event for rule in RULES if rule.kind == kind and holds(rule)))


def delta_events(observations: DataFrame, tie: str = "event_id") -> DataFrame:
    """Events from each observation against the previous one of the same game and kind; late rows never count."""
    safe = observations.filter(harmonise.pit_usable(F.col("available_at"), F.col("prediction_time")))
    line = Timeline(safe, ["game_id", "kind"], ["prediction_time", "available_at", tie])
    seen = line.last_seen({"_old": F.struct(F.upper("state").alias("state"), F.col("value").alias("value"))})
    rules = delta_rules(F.col("kind"), F.col("_old.state"), F.upper("state"), F.col("_old.value"), F.col("value"), F.col("_old").isNotNull())
    return seen.select(tie, "game_id", "prediction_time", F.explode(rules).alias("event"))


def snapshot_view(observations: DataFrame, tie: str = "event_id") -> DataFrame:
    """One row per (game, snapshot): the leading usable observation of each kind and availability flags."""
    safe = observations.filter(harmonise.pit_usable(F.col("available_at"), F.col("prediction_time")))
    first = lambda kind: F.min_by(F.struct(F.upper("state").alias("state"), F.col("value").alias("value")), F.when(F.col("kind") == kind, F.col(tie)))
    flag = lambda word: F.coalesce(F.max(((F.col("kind") == "AVAILABILITY") & (F.upper("value") == word)).cast("int")), F.lit(0)) == 1
    kinds = ("STARTER", "LINEUP", "WEATHER", "REST_TRAVEL")
    return safe.groupBy("game_id", "prediction_time").agg(
        *[first(k).alias(k.lower()) for k in kinds], flag("PLAYER_OUT").alias("is_out"), flag("PLAYER_RETURNED").alias("is_back")
    )


def weather_moved(a: Column, b: Column, tolerance: float = 1e-6) -> Column:
    """Any comma-separated reading differs by more than the tolerance; missing readings are ignored."""
    split = lambda c: F.transform(F.split(c, ","), lambda x: x.try_cast("double"))
    gaps = F.zip_with(split(a), split(b), lambda x, y: F.abs(x - y))
    return F.coalesce(F.array_max(F.array_compact(gaps)) > tolerance, F.lit(False))


def change_events(observations: DataFrame) -> DataFrame:
    """Events from each snapshot of a game against the previous snapshot."""
    view = snapshot_view(observations)
    kinds = ["starter", "lineup", "weather", "rest_travel", "is_out", "is_back"]
    seen = Timeline(view, ["game_id"], ["prediction_time"]).last_seen({"_prev": F.struct(*kinds)})
    now, prev = (lambda k: F.col(k)), (lambda k: F.col(f"_prev.{k}"))
    changed = lambda k: prev(k).isNotNull() & now(k).isNotNull() & ~prev(f"{k}.value").eqNullSafe(now(f"{k}.value"))
    confirmed = lambda k: (now(f"{k}.state") == "VERIFIED") & (prev(k).isNull() | (prev(f"{k}.state") != "VERIFIED"))
    rules = _events(
        (changed("starter"), "STARTER_CHANGED"), (confirmed("starter"), "STARTER_CONFIRMED"),
        (changed("lineup"), "LINEUP_CHANGED"), (confirmed("lineup"), "LINEUP_CONFIRMED"),
        (prev("weather").isNotNull() & weather_moved(prev("weather.value"), now("weather.value")), "WEATHER_CHANGED"),
        (now("is_out") & ~prev("is_out"), "PLAYER_OUT"), (now("is_back") & ~prev("is_back"), "PLAYER_RETURNED"),
        (changed("rest_travel"), "REST_TRAVEL_CHANGED"),
    )
    return seen.filter("_prev is not null").select("game_id", "prediction_time", F.explode(rules).alias("event"))


def cumulative_events(events: DataFrame) -> DataFrame:
    """Events still standing per game: an event falls when its clearing partner came at or after it."""
    seen = events.groupBy("game_id", "event").agg(F.max("prediction_time").alias("at"))
    partner = F.create_map(*[F.lit(x) for cleared, by in ((v, k) for k, v in CLEARS.items()) for x in (cleared, by)])
    clearing = seen.select("game_id", F.col("event").alias("_by"), F.col("at").alias("_cleared_at"))
    joined = seen.withColumn("_by", F.try_element_at(partner, F.col("event"))).join(clearing, ["game_id", "_by"], "left")
    return joined.filter(F.col("_cleared_at").isNull() | (F.col("_cleared_at") < F.col("at"))).select("game_id", "event", "at")


def effect_dataset(ledger: DataFrame, observations: DataFrame) -> DataFrame:
    """One row per settled game with its final forecast and the events standing at its final snapshot.

    ``ledger`` has (game_id, datetime, prediction_time, actual, p); interim forecasts are not independent outcomes.
    """
    from matchloom.plans.ordered import latest_per_key

    final = latest_per_key(ledger.filter("actual is not null"), ["game_id"], ["prediction_time"])
    changes = change_events(observations).unionByName(delta_events(observations).select("game_id", "prediction_time", "event"))
    standing = cumulative_events(changes.distinct())
    present = observations.filter(harmonise.pit_usable(F.col("available_at"), F.col("prediction_time"))).select(
        "game_id",
        F.when((F.col("kind") == "WEATHER") & F.col("state").isin(*harmonise.USABLE_STATES), "WEATHER_PRESENT")
        .when((F.col("kind") == "REST_TRAVEL") & (F.col("state") == "VERIFIED"), "REST_TRAVEL_PRESENT").alias("event"),
    ).filter("event is not null").distinct()
    every = standing.select("game_id", "event").unionByName(present)
    flags = every.groupBy("game_id").agg(*[F.max((F.col("event") == e).cast("int")).alias(f"ctx_{e}") for e in EVENTS])
    have = observations.select("game_id").distinct()
    out = final.join(have, "game_id").join(flags, "game_id", "left")
    return out.withColumns({f"ctx_{e}": F.coalesce(F.col(f"ctx_{e}"), F.lit(0)) for e in EVENTS})


def flagged(df: DataFrame, names: Sequence[str] | None = None) -> DataFrame:
    """Adds ``events``: the names of the ctx_ columns that are set."""
    names = names or [c for c in df.columns if c.startswith("ctx_")]
    return df.withColumn("events", F.array_compact(F.array(*[F.when(F.col(c) > 0, F.lit(c)) for c in names])))


def fit_effects(df: DataFrame, keys: Sequence[str] = (), classes: int = 3) -> DataFrame:
    """Shrunk, clipped logit effect of each event on each class against the mean baseline of its rows.

    ``df`` has p, actual and events; one row per (event, class) that has enough support.
    """
    keys = list(keys)
    q = prob.normalise(F.col("p"), 1e-8)
    rows = df.select(*keys, "actual", q.alias("q"), F.explode("events").alias("key"))
    per = rows.groupBy(*keys, "key").agg(
        F.count(F.lit(1)).alias("support"), *[F.count_if(F.col("actual") == c).alias(f"_n{c}") for c in range(classes)],
        *[F.avg(F.col("q")[c]).alias(f"_b{c}") for c in range(classes)],
    )
    n = F.col("support")
    cap = F.lit(EFFECT["cap"])
    clip = lambda x: F.least(F.greatest(x, F.lit(1e-5)), F.lit(1.0 - 1e-5))
    odds = lambda x: F.ln(clip(x) / (F.lit(1.0) - clip(x)))

    def coefficient(c: int) -> Column:
        raw = odds((F.col(f"_n{c}") + 1.0) / (n + classes)) - odds(F.col(f"_b{c}"))
        return F.least(F.greatest(raw * n / (n + EFFECT["shrink"]), -cap), cap)

    long = per.filter(n >= EFFECT["event_rows"]).select(
        *keys, "key", "support", F.explode(F.array(*[F.struct(F.lit(c).cast("long").alias("class_index"), coefficient(c).alias("coefficient")) for c in range(classes)])).alias("e")
    )
    return long.select(*keys, "key", "support", "e.class_index", "e.coefficient").filter(F.abs("coefficient") > EFFECT["floor"])


def effect_map(effects: DataFrame, keys: Sequence[str] = (), classes: int = 3) -> DataFrame:
    """One row per key: map event -> array of class shifts. The event vocabulary bounds its size."""
    keys = list(keys)
    cap = F.lit(EFFECT["cap"])
    shift = F.least(F.greatest(F.col("coefficient"), -cap), cap)
    per = effects.groupBy(*keys, "key").agg(
        F.array(*[F.coalesce(F.sum(F.when(F.col("class_index") == c, shift)), F.lit(0.0)) for c in range(classes)]).alias("shift")
    )
    return per.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("key", "shift"))).alias("effect_map"))


def apply_effects(df: DataFrame, effects: DataFrame, keys: Sequence[str] = (), classes: int = 3) -> DataFrame:
    """Adds ``adjusted``: log-probabilities shifted by the effects of the row's events, then softmax."""
    on = list(keys) or ["_k"]
    left, right = (df, effect_map(effects, keys, classes)) if keys else (df.withColumn("_k", F.lit(1)), effect_map(effects, (), classes).withColumn("_k", F.lit(1)))
    joined = left.join(right, on, "left")
    move = lambda c: F.aggregate("events", F.lit(0.0), lambda acc, e: acc + F.coalesce(F.try_element_at(F.col("effect_map"), e)[c], F.lit(0.0)))
    logs = F.transform(prob.normalise(F.col("p"), 1e-8), lambda x: F.ln(x))
    shifted = prob.let(logs, lambda l: F.array(*[l[c] + move(c) for c in range(classes)]))
    return joined.withColumn("adjusted", prob.softmax(shifted)).drop("effect_map", "_k")


def learn_effects(df: DataFrame, classes: int = 3) -> tuple[DataFrame, DataFrame]:
    """(effects, gate): fit on 55 %, choose the fusion strength on the next 20 %, judge on the last 25 %."""
    base = df.withColumn("competition", F.lit("all"))
    cuts = (("fit", 0.55, 80), ("tune", 0.75, 80 + EFFECT["event_rows"]))
    rows = spool(drift.chrono_split(base.select("competition", "game_id", "datetime", "actual", "p", "events"), ["competition"], cuts), "effects")
    effects = spool(fit_effects(rows.filter("split = 'fit'"), (), classes), "effects")
    moved = spool(apply_effects(rows.filter("split <> 'fit'"), effects, (), classes), "moved")
    grid = over_grid(moved.filter("split = 'tune'"), "alpha", linspace(0.0, 1.0, 21))
    grid = grid.withColumn("q", prob.mix_two(prob.normalise(F.col("p"), 1e-8), F.col("adjusted"), F.col("alpha"), 1e-8))
    per = grid.groupBy("alpha").agg(F.avg(prob.log_loss(F.col("q"), F.col("actual"))).alias("loss"))
    alpha = per.agg(F.min_by("alpha", F.struct(F.round("loss", 12), F.col("alpha"))).alias("fusion_alpha")).withColumn("_k", F.lit(1))
    scored = moved.withColumn("_k", F.lit(1)).join(alpha, "_k")
    fused = prob.mix_two(prob.normalise(F.col("p"), 1e-8), F.col("adjusted"), F.col("fusion_alpha"), 1e-8)
    long = scored.select(
        "split", "fusion_alpha", "actual",
        F.explode(F.array(F.struct(F.lit("base").alias("v"), F.col("p").alias("q")), F.struct(F.lit("fused").alias("v"), fused.alias("q")))).alias("x"),
    ).select("split", "fusion_alpha", "actual", "x.v", "x.q")
    met = score.bundle(long, ["split", "fusion_alpha", "v"], "q", "actual", 1e-8)
    at = lambda m, v: F.max(F.when(F.col("v") == v, F.col(m)))
    wide = met.groupBy("split", "fusion_alpha").agg(F.max("rows").alias("rows"), *[(at(m, "fused") - at(m, "base")).alias(f"d_{m}") for m in ("logloss", "brier", "accuracy", "ece")])
    ok = (F.col("d_logloss") <= -GATE["logloss"]) & (F.col("d_brier") <= -GATE["brier"]) & (F.col("d_accuracy") >= -GATE["accuracy"]) & (F.col("d_ece") <= GATE["ece"])
    gate = wide.groupBy("fusion_alpha").agg(
        F.count(F.lit(1)).alias("windows"), F.count_if(ok).alias("windows_passed"),
        *[F.max(F.when(F.col("split") == s, F.col(f"d_{m}"))).alias(f"{s}_d_{m}") for s in ("tune", "eval") for m in ("logloss", "brier", "accuracy", "ece")],
    )
    return effects, gate.withColumn("candidate_eligible", (F.col("windows") == 2) & (F.col("windows_passed") == 2) & (F.col("fusion_alpha") > 0))


def to_policy(effects: DataFrame, cap: float = EFFECT["cap"]) -> DataFrame:
    """Effects as policy rows (key, class_index, coef, cap, target), one per event and class."""
    target = F.element_at(F.array(F.lit("home"), F.lit("draw"), F.lit("away")), (F.col("class_index") + 1).cast("int"))
    coef = F.least(F.greatest(F.col("coefficient"), F.lit(-cap)), F.lit(cap))
    return effects.filter((F.abs("coefficient") >= 1e-9) & F.col("class_index").between(0, 2)).select(
        "key", "class_index", coef.alias("coef"), F.lit(cap).alias("cap"), target.alias("target"), "support"
    )


def apply_policy(df: DataFrame, policy: DataFrame, fusion_alpha: float = 1.0, eligible: bool = True, classes: int = 3) -> DataFrame:
    """Adds ``decided`` and ``shift``: bounded context shifts, identity when the policy is not eligible.

    ``df`` has p and contexts: array<struct(key, state, confidence)> (one entry per key). Two classes use a
    home logit with a total cap.
    """
    base = prob.normalise(F.col("p"))
    if not eligible:
        return df.withColumns({"decided": base, "shift": F.array(*[F.lit(0.0)] * classes)})
    per = policy.groupBy("key").agg(
        F.array(*[F.struct(F.coalesce(F.sum(F.when(F.col("class_index") == c, F.col("coef"))), F.lit(0.0)).alias("coef"), F.coalesce(F.max(F.when(F.col("class_index") == c, F.abs("cap"))), F.lit(0.0)).alias("cap")) for c in range(3)]).alias("spec")
    )
    table = per.agg(F.map_from_entries(F.collect_list(F.struct("key", "spec"))).alias("_policy")).withColumn("_k", F.lit(1))
    joined = df.withColumn("_k", F.lit(1)).join(table, "_k", "left")

    def total(c: int) -> Column:
        def one(acc: Column, x: Column) -> Column:
            spec = F.try_element_at(F.col("_policy"), x["key"])[c]
            sure = prob.clip01(F.coalesce(x["confidence"], F.lit(1.0)))
            move = F.least(F.greatest(spec["coef"] * sure, -spec["cap"]), spec["cap"])
            return acc + F.when(F.upper(x["state"]).isin(*harmonise.USABLE_STATES), F.coalesce(move, F.lit(0.0))).otherwise(0.0)

        return F.aggregate("contexts", F.lit(0.0), one)

    moves = joined.withColumn("shift", F.array(*[total(c) for c in range(classes)]))
    if classes == 2:
        bound = F.lit(EFFECT["binary_cap"])
        move = F.least(F.greatest(F.col("shift")[0], -bound), bound)
        home = prob.sigmoid(prob.logit(base[0]) + move)
        out = F.array(home, F.lit(1.0) - home)
    else:
        out = prob.softmax(F.zip_with(F.transform(base, lambda x: F.ln(x)), F.col("shift"), lambda l, s: l + s))
    return moves.withColumn("decided", prob.mix_two(base, out, fusion_alpha)).drop("_k", "_policy")


def contexts_of(observations: DataFrame) -> DataFrame:
    """Per (game, forecast time): usable contexts keyed by kind and by event value, first observation per key."""
    safe = observations.filter(harmonise.pit_usable(F.col("available_at"), F.col("prediction_time")))
    named = F.array_compact(F.array(F.lower("kind"), F.when(F.col("value").isin(*EVENTS), F.concat(F.lit("ctx_"), F.col("value")))))
    conf = F.coalesce(F.col("confidence"), F.lit(1.0)) if "confidence" in observations.columns else F.lit(1.0)
    long = safe.select("game_id", "prediction_time", "event_id", "state", conf.alias("confidence"), F.explode(named).alias("key"))
    per = long.groupBy("game_id", "prediction_time", "key").agg(F.min_by(F.struct("state", "confidence"), "event_id").alias("c"))
    # At most one entry per context key, so the list is as short as the vocabulary.
    return per.groupBy("game_id", "prediction_time").agg(
        F.collect_list(F.struct("key", F.col("c.state").alias("state"), F.col("c.confidence").alias("confidence"))).alias("contexts")
    )


def replay_policy(ledger: DataFrame, observations: DataFrame, policy: DataFrame, fusion_alpha: float = 1.0, eligible: bool = True) -> DataFrame:
    """Settled final forecasts re-decided with the latest snapshot at or before their cutoff; metric rows per variant."""
    from matchloom.operators import joins
    from matchloom.plans.ordered import latest_per_key

    final = latest_per_key(ledger.filter("actual is not null"), ["game_id"], ["prediction_time"])
    snaps = contexts_of(observations).withColumn("_tie", F.lit(""))
    seen = joins.as_of(final, snaps.withColumnRenamed("prediction_time", "snapshot_time"), ["game_id"], "prediction_time", "snapshot_time", ["contexts"], "_tie")
    decided = apply_policy(seen.filter("contexts is not null"), policy, fusion_alpha, eligible)
    long = decided.select(
        "actual", F.explode(F.array(F.struct(F.lit("baseline").alias("variant"), F.col("p").alias("q")), F.struct(F.lit("policy").alias("variant"), F.col("decided").alias("q")))).alias("x")
    ).select("actual", "x.variant", "x.q")
    return score.bundle(long, ["variant"], "q", "actual", 1e-8)


def reforecast(df: DataFrame, effects: DataFrame, experts: Sequence[str], fusion_alpha: float, deferred: bool = False) -> DataFrame:
    """Adds ``final``: routed expert mixture fused with the context overlay, then tempered; identity when deferred.

    ``df`` has p, events, weights (routing) and temperature.
    """
    if deferred:
        return df.withColumns({"final": prob.normalise(F.col("p")), "status": F.lit("DEFERRED")})
    moved = apply_effects(df, effects)
    routed = prob.mix([F.col(e) for e in experts], F.col("weights"))
    fused = prob.mix_two(routed, F.col("adjusted"), fusion_alpha)
    return moved.withColumns({"final": prob.temper(fused, F.col("temperature")), "status": F.lit("PASS")})


def build_observations(games: DataFrame) -> DataFrame:
    """Observation rows of game contexts with content ids, freshness and confidence; later knowledge is refused.

    ``games`` has game_id, prediction_time and, per topic, <topic>_state, <topic>_available_at, <topic>_source, <topic>_value.
    """
    sure = lambda state, part: F.when(state == "VERIFIED", 1.0).otherwise(part)

    def rows(topic: str, kind: str, label: Column, part: float) -> list[Column]:
        state, at, source, value = (F.col(f"{topic}_{x}") for x in ("state", "available_at", "source", "value"))
        usable = state.isin(*harmonise.USABLE_STATES)
        make = lambda v, conf, on: F.when(at.isNotNull() & on, F.struct(F.lit(kind).alias("kind"), state.alias("state"), source.alias("source"), v.alias("value"), at.alias("available_at"), conf.alias("confidence")))
        return [make(value.cast("string"), F.lit(1.0), F.lit(True)), make(label, sure(state, part), usable)]

    lineup = F.when(F.col("lineup_state") == "VERIFIED", "LINEUP_CONFIRMED").otherwise("LINEUP_PROJECTED")
    items = rows("starter", "STARTER", F.lit("STARTER_CONFIRMED"), 0.7) + rows("lineup", "LINEUP", lineup, 0.7) + rows("weather", "WEATHER", F.lit("WEATHER_PRESENT"), 0.8)
    long = games.select("game_id", "prediction_time", F.explode(F.array_compact(F.array(*items))).alias("o")).select("game_id", "prediction_time", "o.*")
    safe = long.filter(harmonise.pit_usable(F.col("available_at"), F.col("prediction_time")))
    ident = F.substring(F.sha2(F.to_json(F.struct("game_id", "kind", "prediction_time", "value")), 256), 1, 16)
    fresh = (F.unix_micros("prediction_time") - F.unix_micros("available_at")) / F.lit(1e6)
    return safe.withColumns({"snapshot_id": ident, "freshness_seconds": fresh})


def integrated_gate(routing: DataFrame, effects: DataFrame, replay: DataFrame) -> DataFrame:
    """Candidate only when the routing gate, the effect gate and the forward replay all pass."""
    r = routing.agg(F.coalesce(F.bool_or("candidate_eligible"), F.lit(False)).alias("routing_gate")).withColumn("_k", F.lit(1))
    e = effects.agg(F.coalesce(F.bool_or("candidate_eligible"), F.lit(False)).alias("effect_gate")).withColumn("_k", F.lit(1))
    at = lambda m, v: F.max(F.when(F.col("variant") == v, F.col(m)))
    d = replay.agg(*[(at(m, "policy") - at(m, "baseline")).alias(f"d_{m}") for m in ("logloss", "brier", "accuracy", "ece")], F.max("rows").alias("rows")).withColumn("_k", F.lit(1))
    ok = (F.col("d_logloss") <= -GATE["logloss"]) & (F.col("d_brier") <= -GATE["brier"]) & (F.col("d_accuracy") >= -GATE["accuracy"]) & (F.col("d_ece") <= GATE["ece"]) & (F.col("rows") >= 50)
    out = r.join(e, "_k").join(d, "_k").withColumn("forward_replay_gate", F.coalesce(ok, F.lit(False)))
    out = out.withColumn("candidate_eligible", F.col("routing_gate") & F.col("effect_gate") & F.col("forward_replay_gate"))
    return out.withColumn("status", F.when(F.col("rows") >= 50, "PASS").otherwise("DEFERRED")).drop("_k")


# Promotion gate.
PROMOTION = {"min_rows": 200, "min_relative_gain": 0.01, "logloss": 0.005, "brier": 0.005, "accuracy": 0.005, "ece": 0.010, "high_state": 0.010}


# Evidence without which nothing is promoted.
REQUIRED = (
    "oos", "two_validation_windows", "calibration_check", "no_future_target_data", "reproducible_candidate", "matchday_pit_snapshots",
    "two_late_routing_windows", "rollback_on_regression",
)


def promotion_gate(
    metrics: DataFrame, key: str, baseline: str, candidate: str, high_state: DataFrame | None = None, evidence: DataFrame | None = None
) -> DataFrame:
    """Promotion checks of a candidate's metric row against the baseline's, one row (check, passed) per entry of the gate.

    ``high_state`` has the same metrics over the rows of high drift or uncertainty. ``evidence`` has boolean columns named in
    ``REQUIRED``; each must hold in all of its rows. What is missing or null fails.
    """
    at = lambda m, v: F.max(F.when(F.col(key) == v, F.col(m)))
    d = lambda m: at(m, candidate) - at(m, baseline)
    gain = -d("logloss") / F.greatest(at("logloss", baseline), F.lit(1e-12))
    checks = {
        "min_rows": at("rows", candidate) >= PROMOTION["min_rows"], "relative_gain": gain >= PROMOTION["min_relative_gain"],
        "logloss": d("logloss") <= PROMOTION["logloss"], "brier": d("brier") <= PROMOTION["brier"],
        "accuracy": d("accuracy") >= -PROMOTION["accuracy"], "ece": d("ece") <= PROMOTION["ece"],
    }

    def rows_of(df: DataFrame | None, of: dict[str, Column]) -> DataFrame:
        pairs = F.array(*[F.struct(F.lit(n).alias("check"), F.coalesce(c, F.lit(False)).alias("passed")) for n, c in of.items()])
        one = metrics.limit(0).agg(pairs.alias("checks")) if df is None else df.agg(pairs.alias("checks"))
        return one.select(F.explode("checks").alias("c")).select("c.check", "c.passed")

    high = {"high_state": F.lit(False) if high_state is None else d("logloss") <= PROMOTION["high_state"]}
    have = evidence.columns if evidence is not None else []
    shown = {n: F.bool_and(F.coalesce(F.col(n), F.lit(False))) if n in have else F.lit(False) for n in REQUIRED}
    return rows_of(metrics, checks).unionByName(rows_of(high_state, high)).unionByName(rows_of(evidence, shown))
