"""Drift- and uncertainty-aware expert routing with online temperature calibration."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from matchloom.operators import drift, lanes, reports
from matchloom.functions import prob
from matchloom.plans.durable import spool
from matchloom.plans.recursion import scan

TINY = 1e-12
#: Rows of a replay that are worked on at once, rows checked ahead at one temperature, and rows that are dealt to lanes at once.
BLOCK, AHEAD, PIECE = 4096, 64, 131_072
#: Rows ahead of a slice from which a replay starts. Where temperatures move often, all is forgotten within a thousand rows.
WARM = 16_384


@dataclass(frozen=True)
class Routing:
    """Fixed values of the routing and calibration rules."""

    short: int = 24
    long: int = 96
    half_life: float = 24.0
    recent_mix: float = 0.85
    floor: float = 0.03
    inertia: float = 0.65
    inertia_relax: float = 0.35
    uniform_mix: float = 0.70
    uncertainty: tuple[float, float, float] = (0.65, 0.20, 0.15)
    drift_sharpen: float = 0.30
    t_min: float = 0.65
    t_max: float = 1.90
    step: float = 0.15
    max_step: float = 0.15
    fit_min: int = 30
    check_min: int = 15
    check_share: float = 0.30
    gain: float = 0.0005
    bootstrap: int = 8


def unit(p: np.ndarray) -> np.ndarray:
    q = np.minimum(np.maximum(p, TINY), 1.0)
    return q / q.sum(axis=-1, keepdims=True)


def tempered(p: np.ndarray, t: float | np.ndarray) -> np.ndarray:
    q = unit(p) ** (1.0 / (np.clip(t, 0.1, 10.0) if isinstance(t, np.ndarray) else min(max(t, 0.1), 10.0)))
    return q / q.sum(axis=-1, keepdims=True)


def checked(p: np.ndarray, y: np.ndarray, t: float | np.ndarray) -> np.ndarray:
    """Log loss of each row at a temperature."""
    q = tempered(p, t)
    hit = q[np.arange(len(y)), y] if q.ndim == 2 else np.take_along_axis(q, y[..., None], axis=-1)[..., 0]
    return -np.log(np.minimum(np.maximum(hit, TINY), 1.0))


class Temperature:
    """Predict-then-update temperature over the last ``long`` resolved rows.

    Each resolved row keeps its loss at every grid temperature, so a refit is a sum over stored losses.
    """

    def __init__(self, cfg: Routing, state: dict | None = None):
        self.cfg = cfg
        self.grid = np.linspace(cfg.t_min, cfg.t_max, 51)
        self.penalty = 0.01 * (self.grid - 1.0) ** 2
        state = state or {}
        self.t = float(state.get("t", 1.0))
        self.accepted, self.rejected = int(state.get("accepted", 0)), int(state.get("rejected", 0))
        self.y = np.asarray(state.get("y", []), np.int64)
        self.p = np.asarray(state.get("p", []), float)
        self.losses = self.grid_loss(self.p, self.y) if len(self.y) else np.empty((0, len(self.grid)))

    def grid_loss(self, p: np.ndarray, y: np.ndarray) -> np.ndarray:
        """(rows, grid) losses."""
        logs = np.log(unit(p))
        total = np.exp(logs[:, :1] / self.grid)
        for c in range(1, logs.shape[1]):
            total += np.exp(logs[:, c:c + 1] / self.grid)
        return np.minimum(np.log(total, out=total) - logs[np.arange(len(y)), y][:, None] / self.grid, -np.log(TINY))

    def state(self) -> dict:
        return {"t": self.t, "accepted": self.accepted, "rejected": self.rejected, "p": self.p.tolist(), "y": self.y.tolist()}

    def _cut(self, n: int) -> int:
        """How many of ``n`` rows fit a candidate; the rest check it. Zero if they are too few."""
        cfg = self.cfg
        return 0 if n < max(cfg.fit_min + cfg.check_min, 2 * cfg.fit_min) else n - max(cfg.check_min, int(round(n * cfg.check_share)))

    def _candidates(self, total: np.ndarray, fit: int) -> np.ndarray:
        """The best temperature by each row of losses summed over ``fit`` rows."""
        best = (total / fit + self.penalty).argmin(axis=-1)
        return self.grid[best] if fit >= self.cfg.fit_min else np.ones(best.shape)

    def _judge(self, candidate: float, its: float, now: float) -> None:
        cfg = self.cfg
        if its + cfg.gain >= now:
            self.rejected += 1
            return
        move = min(max(candidate - self.t, -cfg.max_step), cfg.max_step)
        self.t = min(max(self.t + cfg.step * move, cfg.t_min), cfg.t_max)
        self.accepted += 1

    def resolve(self, p: np.ndarray, y: int) -> None:
        y = int(y)
        self.p = np.concatenate([self.p, p[None]] if len(self.y) else [p[None]])[-self.cfg.long:]
        self.y = np.append(self.y, y)[-self.cfg.long:]
        self.losses = np.concatenate([self.losses, self.grid_loss(p[None], self.y[-1:])])[-self.cfg.long:]
        if fit := self._cut(len(self.y)):
            candidate = float(self._candidates(np.add.reduce(self.losses[:fit]), fit))
            late = self.p[fit:], self.y[fit:]
            self._judge(candidate, checked(*late, candidate).mean(), checked(*late, self.t).mean())

    def rules(self) -> lanes.Fitted | None:
        """The rules of a full window, for lanes; None if too few rows fit a candidate or the history is not full."""
        fit = self._cut(self.cfg.long)
        return lanes.Fitted(self.cfg, self.grid, self.penalty, fit, -np.log(TINY)) if fit >= max(self.cfg.fit_min, 1) and len(self.y) == self.cfg.long else None

    def candidates(self, p: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The candidate after each new row and its loss over the late rows, from a full window on."""
        rules, long = self.rules(), self.cfg.long
        best, its, held = np.empty(len(y)), np.empty(len(y)), self.losses
        for low in range(0, len(y), BLOCK):
            n = len(y[low:low + BLOCK])
            both = np.concatenate([held, self.grid_loss(p[low:low + n], y[low:low + n])])
            sums = lanes.ladder(both, max(rules.fit, rules.late))
            at = (lanes.over(sums, rules.fit, long - rules.late, n) / rules.fit + self.penalty).argmin(axis=1)
            best[low:low + n] = self.grid[at]
            its[low:low + n] = lanes.over(sums, rules.late, long, n)[np.arange(n), at] / rules.late
            held = both[-long:]
        return best, its

    def passed(self, p: np.ndarray, y: np.ndarray, t: float, taken: int) -> None:
        """Takes over what lanes found for many rows."""
        long = self.cfg.long
        self.t, self.accepted, self.rejected = float(t), self.accepted + int(taken), self.rejected + len(y) - int(taken)
        self.p, self.y = np.concatenate([self.p, p])[-long:], np.concatenate([self.y, y])[-long:]
        self.losses = self.grid_loss(self.p, self.y)

    def resolve_all(self, p: np.ndarray, y: np.ndarray) -> np.ndarray:
        """``resolve`` row by row; the temperature before each row. Candidates do not depend on it and are found for all rows at once."""
        long, before = self.cfg.long, np.empty(len(y))
        few = min(len(y), max(0, long - len(self.y)))
        for i in range(few):
            before[i] = self.t
            self.resolve(p[i], y[i])
        if few == len(y):
            return before
        n = len(y) - few
        ps, ys = np.concatenate([self.p, p[few:]]), np.concatenate([self.y, y[few:]])
        losses = np.concatenate([self.losses, self.grid_loss(p[few:], y[few:])])
        fit = self._cut(long)
        if fit:
            total = np.zeros((n, len(self.grid)))
            for k in range(1, fit + 1):  # in the order of a sum over one window
                total += losses[k:k + n]
            candidates, size = self._candidates(total, fit), long - fit
            windows = np.lib.stride_tricks.sliding_window_view
            late_p, late_y = windows(ps[fit + 1:], size, axis=0).swapaxes(1, 2), windows(ys[fit + 1:], size)
            its = checked(late_p, late_y, candidates[:, None, None]).mean(axis=-1)
            ready, at = np.empty(0), 0
            for i in range(n):
                before[few + i] = t = self.t
                if i - at >= len(ready):
                    # Losses at the present temperature hold until it changes.
                    to = min(n, i + AHEAD)
                    ready, at = windows(checked(ps[fit + 1 + i:fit + to + size], ys[fit + 1 + i:fit + to + size], t), size).mean(axis=-1), i
                self._judge(float(candidates[i]), its[i], ready[i - at])
                if self.t != t:
                    ready = ready[:0]
        else:
            before[few:] = self.t
        self.p, self.y, self.losses = ps[-long:], ys[-long:], losses[-long:]
        return before


def decayed_loss(history: np.ndarray, depth: int, half_life: float) -> np.ndarray:
    """Decayed mean over the last rows of (..., rows, experts)."""
    h = history[..., -depth:, :]
    w = np.exp2(-np.arange(h.shape[-2] - 1, -1, -1) / half_life)[:, None]
    ok = np.isfinite(h)
    den = (w * ok).sum(axis=-2)
    return np.where(den > 0, (np.where(ok, h, 0.0) * w).sum(axis=-2) / np.maximum(den, TINY), np.nan)


def base_weights(short: np.ndarray, long: np.ndarray, shift: np.ndarray, cfg: Routing) -> np.ndarray:
    """(rows, experts) weights from decayed losses; an expert without losses has the mean of the others."""
    d = np.clip(shift, 0.0, 1.0)[:, None]
    short, long = np.where(np.isfinite(short), short, long), np.where(np.isfinite(long), long, short)
    seen = np.isfinite(short) & np.isfinite(long)
    m = np.clip(cfg.recent_mix * d, 0.0, 1.0)
    blend = np.where(seen, (1.0 - m) * long + m * short, 0.0)
    count = seen.sum(axis=1, keepdims=True)
    blend = np.where(seen, blend, blend.sum(axis=1, keepdims=True) / np.maximum(count, 1))
    z = (blend.min(axis=1, keepdims=True) - blend) / np.maximum(cfg.t_min, 1.0 - cfg.drift_sharpen * d)
    base = np.exp(np.clip(z, -50.0, 50.0))
    return np.where(count > 0, base / base.sum(axis=1, keepdims=True), 1.0 / short.shape[1])


def vagueness(current: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(spread of the experts, entropy of their mean) of each row of (rows, experts, classes)."""
    mean = current.mean(axis=1)
    entropy = -(mean * np.log(np.clip(mean, TINY, 1.0))).sum(axis=1) / np.log(current.shape[2])
    return np.std(current, axis=1).mean(axis=1), entropy


def clip01(x: float) -> float:
    return min(max(x, 0.0), 1.0)


def softened(base: np.ndarray, shift: float, spread: float, vague: float, conformal: float, previous: np.ndarray | None, cfg: Routing):
    """(weights, uncertainty): base weights held back towards the previous ones."""
    k = len(base)
    a, b, c = cfg.uncertainty
    doubt = clip01(a * clip01(spread / 0.25) + b * clip01(vague) + c * clip01(conformal))
    pull = min(max(cfg.uniform_mix * doubt, 0.0), 0.80)
    anchor = np.full(k, 1.0 / k) if previous is None else previous / previous.sum()
    w = (1.0 - pull) * base + pull * anchor
    if previous is not None:
        hold = min(max(cfg.inertia - cfg.inertia_relax * clip01(shift), 0.0), 0.95)
        w = hold * anchor + (1.0 - hold) * w
    w = np.maximum(w, min(cfg.floor, 0.98 / k))
    return w / w.sum(), doubt


def route(current: np.ndarray, history: np.ndarray, shift: float, previous: np.ndarray | None, conformal: float, cfg: Routing):
    """Weights from decayed losses, softened towards the previous weights by uncertainty; (weights, uncertainty, spread)."""
    short, long = (decayed_loss(history, depth, cfg.half_life)[None] for depth in (cfg.short, cfg.long))
    spread, vague = (float(x[0]) for x in vagueness(current[None]))
    w, doubt = softened(base_weights(short, long, np.array([shift]), cfg)[0], shift, spread, vague, conformal, previous, cfg)
    return w, doubt, spread


def mixed(current: np.ndarray, weights: np.ndarray) -> np.ndarray:
    return unit((current * weights[:, None]).sum(axis=0))


class Replay:
    """State of one league's replay; every history is bounded, so it fits a streaming state as well."""

    DEPTH = 120

    def __init__(self, experts: int, classes: int, cfg: Routing, state: dict | None = None):
        s = state or {}
        self.cfg, self.k, self.c = cfg, experts, classes
        self.losses = np.asarray(s.get("losses", np.empty((0, experts))), float).reshape(-1, experts)
        self.outputs = np.asarray(s.get("outputs", np.empty((0, experts, classes))), float).reshape(-1, experts, classes)
        self.scores = np.asarray(s.get("scores", []), float)
        self.previous = np.asarray(s["previous"]) if s.get("previous") is not None else None
        self.final = Temperature(cfg, s.get("final"))
        self.bank = [Temperature(cfg, x) for x in s.get("bank", [None] * experts)]

    def state(self) -> dict:
        return {
            "losses": self.losses.tolist(), "outputs": self.outputs.tolist(), "scores": self.scores.tolist(),
            "previous": None if self.previous is None else self.previous.tolist(),
            "final": self.final.state(), "bank": [b.state() for b in self.bank],
        }

    def _before(self, history: np.ndarray, new: np.ndarray, depth: int, of: Callable) -> np.ndarray:
        """``of`` over the last ``depth`` rows (fewer at the start) before each new row: (rows, depth, ...) at a time."""
        both, n, held = np.concatenate([history, new]), len(new), len(history)
        few = min(n, max(0, depth - held))
        out = [of(both[None, max(0, held + i - depth):held + i], slice(i, i + 1)) for i in range(few)]
        if few < n:
            low = held + few - depth
            past = np.lib.stride_tricks.sliding_window_view(both[low:held + n - 1], depth, axis=0)
            out.append(of(np.moveaxis(past, -1, 1), slice(few, n)))
        return np.concatenate(out)

    def _output_drift(self, current: np.ndarray) -> np.ndarray:
        def of(past: np.ndarray, at: slice) -> np.ndarray:
            if past.shape[1] < 24:
                return np.zeros(len(past))
            recent, older = past[:, -12:].mean(axis=1), past[:, :-12].mean(axis=1)
            moved, now = np.abs(recent - older), np.abs(current[at] - recent)
            raw = 0.75 * moved.reshape(len(past), -1).mean(axis=1) + 0.25 * now.reshape(len(past), -1).mean(axis=1)
            return 1.0 - np.exp(-raw / 0.12)

        return self._before(self.outputs, current, 96, of)

    def _conformal(self, p: np.ndarray, gap: float, past: np.ndarray) -> float:
        n = len(past)
        if n < 30:
            return 0.0
        above = (past >= (1.0 - p - 1e-12)[:, None]).sum(axis=1).tolist()
        size = sum((1.0 + x) / (n + 1.0) > 0.10 for x in above)
        return clip01(0.6 * clip01((size - 1) / max(self.c - 1, 1)) + 0.4 * clip01(1.0 - gap / 0.25))

    def block(self, raw: np.ndarray, y: np.ndarray, feature_drift: np.ndarray, feature_mmd: np.ndarray, has_features: bool) -> dict[str, np.ndarray]:
        """Forecast and resolve rows (rows, experts, classes) one after the other; columns of ``routed``, ``weights`` and ``FIELDS``.

        What the experts alone decide (their temperatures, losses, drift and base weights) is computed for all rows at
        once; only weights, scores and the last temperature follow from row to row.
        """
        n, cfg = len(y), self.cfg
        raw = unit(raw)
        current = np.stack([tempered(raw[:, j], b.resolve_all(raw[:, j], y)[:, None]) for j, b in enumerate(self.bank)], axis=1)
        loss = -np.log(np.maximum(np.take_along_axis(current, y[:, None, None], axis=2)[:, :, 0], TINY))
        out_drift = self._output_drift(current)
        shift = np.clip(0.55 * out_drift + 0.225 * feature_drift + 0.225 * feature_mmd if has_features else out_drift, 0.0, 1.0)
        short, long = (self._before(self.losses, loss, depth, lambda past, _, d=depth: decayed_loss(past, d, cfg.half_life)) for depth in (cfg.short, cfg.long))
        base = base_weights(short, long, shift, cfg)
        spread, vague = vagueness(current)
        mean = unit(current.mean(axis=1))
        top = np.sort(mean, axis=1)
        gap = (top[:, -1] - top[:, -2]).tolist()
        known, held = len(self.losses), len(self.scores)
        scores = np.concatenate([self.scores, np.empty(n)])
        final, weights = np.empty((n, self.c)), np.empty((n, self.k))
        doubt, signal, temperature = np.zeros(n), np.empty(n), np.empty(n)
        even, spreads, vagues, shifts = np.full(self.k, 1.0 / self.k), spread.tolist(), vague.tolist(), shift.tolist()
        for i in range(n):
            conformal = self._conformal(mean[i], gap[i], scores[max(0, held + i - self.DEPTH):held + i])
            w = even
            if known + i >= cfg.bootstrap:
                w, doubt[i] = softened(base[i], shifts[i], spreads[i], vagues[i], conformal, self.previous, cfg)
            mix = mixed(current[i], w)
            signal[i], temperature[i], weights[i], self.previous = conformal, self.final.t, w, w
            final[i] = tempered(mix, self.final.t)
            scores[held + i] = 1.0 - unit(final[i])[y[i]]
            self.final.resolve(mix, y[i])
        self.losses = np.concatenate([self.losses, loss])[-self.DEPTH:]
        self.outputs = np.concatenate([self.outputs, current])[-96:]
        self.scores = scores[-self.DEPTH:]
        return {
            "routed": final, "weights": weights, "drift": shift, "output_drift": out_drift, "uncertainty": doubt, "conformal": signal,
            "disagreement": spread, "temperature": temperature,
        }

    def _windows(self, outputs: np.ndarray, losses: np.ndarray, n: int, shift_of: Callable) -> tuple[np.ndarray, ...]:
        """(output drift, shift, base weights) of the last ``n`` rows of full histories, from sums over powers of two rows."""
        cfg, held = self.cfg, len(outputs) - n
        sums = lanes.ladder(outputs, 96)
        recent, older = lanes.over(sums, 12, held - 1, n) / 12, lanes.over(sums, 84, held - 13, n) / 84
        raw = 0.75 * np.abs(recent - older).reshape(n, -1).mean(axis=1) + 0.25 * np.abs(outputs[held:] - recent).reshape(n, -1).mean(axis=1)
        out_drift = 1.0 - np.exp(-raw / 0.12)
        shift = shift_of(out_drift)
        ok, held, fade = np.isfinite(losses), len(losses) - n, 2.0 ** (-1.0 / cfg.half_life)
        weights, values = (lanes.ladder(x, cfg.long, fade) for x in (ok.astype(float), np.where(ok, losses, 0.0)))

        def decayed(depth: int) -> np.ndarray:
            den = lanes.over(weights, depth, held - 1, n, fade)
            return np.where(den > 0, lanes.over(values, depth, held - 1, n, fade) / np.maximum(den, TINY), np.nan)

        return out_drift, shift, base_weights(decayed(cfg.short), decayed(cfg.long), shift, cfg)

    def long_block(self, raw: np.ndarray, y: np.ndarray, feature_drift: np.ndarray, feature_mmd: np.ndarray, has_features: bool) -> tuple[int, dict[str, np.ndarray]]:
        """``block`` for many rows by lanes: (rows done, their columns); none are done where histories are short or rows few."""
        cfg, k, c = self.cfg, self.k, self.c
        rules = self.final.rules()
        side, rows = lanes.cut(len(y))
        ready = rules and side and rows >= max(self.DEPTH, cfg.long) and cfg.long >= 96 and all(b.rules() for b in self.bank)
        if not ready or len(self.losses) < self.DEPTH or len(self.scores) < self.DEPTH or len(self.outputs) < 96 or self.previous is None:
            return 0, {}
        n, late = side * rows, rules.late
        raw, y, feature_drift, feature_mmd = unit(raw[:n]), y[:n], feature_drift[:n], feature_mmd[:n]
        found = [b.candidates(raw[:, j], y) for j, b in enumerate(self.bank)]
        logs, hit = [], []
        for j, b in enumerate(self.bank):
            log = np.log(unit(np.concatenate([b.p[1 - late:], raw[:, j]])))
            hits = log[np.arange(len(log)), np.concatenate([b.y[1 - late:], y])]
            logs.append(lanes.spread_out(log, side, rows, late - 1)), hit.append(lanes.spread_out(hits, side, rows, late - 1))
        beside = lambda parts: np.ascontiguousarray(np.concatenate(parts, axis=-1))
        bank = lanes.Bank(
            rules, np.array([b.t for b in self.bank]), beside(logs), beside(hit), *(beside([lanes.spread_out(f[i], side, rows) for f in found]) for i in (0, 1)),
        )
        del logs, hit, found
        bank.settle()
        own = lambda x, j: x[..., j * side:(j + 1) * side]
        current = np.stack([tempered(raw[:, j], lanes.end_to_end(own(bank.kept["t"], j))[:, None]) for j in range(k)], axis=1)
        for j, b in enumerate(self.bank):
            b.passed(raw[:, j], y, own(bank.after, j)[-1], own(bank.kept["taken"], j).sum())
        del bank
        loss = -np.log(np.maximum(np.take_along_axis(current, y[:, None, None], axis=2)[:, :, 0], TINY))
        outputs, losses = np.concatenate([self.outputs, current]), np.concatenate([self.losses, loss])
        parts = []
        for low in range(0, n, BLOCK):
            to = min(n, low + BLOCK)
            fd, mmd = feature_drift[low:to], feature_mmd[low:to]
            shift_of = lambda drifted: np.clip(0.55 * drifted + 0.225 * fd + 0.225 * mmd if has_features else drifted, 0.0, 1.0)  # noqa: B023, E731
            windows = self._windows(outputs[low:to + len(self.outputs)], losses[low:to + len(self.losses)], to - low, shift_of)
            parts.append((*windows, *vagueness(current[low:to]), unit(current[low:to].mean(axis=1))))
        out_drift, shift, base, spread, vague, mean = (np.concatenate(x) for x in zip(*parts))
        top = np.sort(mean, axis=1)
        a, b, _ = cfg.uncertainty
        given = {
            "current": current, "base": base, "y": y, "edge": 1.0 - mean - 1e-12, "near": 0.4 * lanes.clip01(1.0 - (top[:, -1] - top[:, -2]) / 0.25),
            "unsure": a * lanes.clip01(spread / 0.25) + b * lanes.clip01(vague), "hold": np.clip(cfg.inertia - cfg.inertia_relax * lanes.clip01(shift), 0.0, 0.95),
        }
        given = {name: lanes.spread_out(x, side, rows) for name, x in given.items()}
        # Ahead of a lane lie guesses: even weights and no temperature; ahead of the first one what this replay has seen.
        guess = unit(mean)
        score = 1.0 - guess[np.arange(n), y]
        known = np.log(unit(self.final.p))
        log = np.log(guess)
        hits = log[np.arange(n), y]
        ahead = lambda seen, x, depth: lanes.spread_out(np.concatenate([seen[-depth:], x]), side, rows, depth)[:depth]
        past = {
            "score": ahead(self.scores, score, self.DEPTH), "logs": ahead(known, log, cfg.long),
            "hit": ahead(known[np.arange(len(known)), self.final.y], hits, cfg.long),
        }
        start = {"weights": np.full((k, side), 1.0 / k), "t": np.ones(side)}
        start["weights"][:, 0], start["t"][0] = self.previous, self.final.t
        run = lanes.Mixture(rules, rows, side, self.DEPTH, given, past, start)
        run.settle()
        got = {name: lanes.end_to_end(x) for name, x in run.kept.items()}
        self.losses, self.outputs = losses[-self.DEPTH:], outputs[-96:]
        self.scores, self.previous = np.concatenate([self.scores, got["score"]])[-self.DEPTH:], got["weights"][-1]
        mix = unit((current[-cfg.long:] * got["weights"][-cfg.long:, :, None]).sum(axis=1))
        self.final.passed(mix, y, run.after[-1], got["taken"].sum())
        return n, {
            "routed": got["routed"], "weights": got["weights"], "drift": shift, "output_drift": out_drift, "uncertainty": got["doubt"], "conformal": got["conformal"],
            "disagreement": spread, "temperature": got["t"],
        }


FIELDS = ("drift", "output_drift", "uncertainty", "conformal", "disagreement", "temperature")


def replayed(run: Replay, cube: np.ndarray, y: np.ndarray, fd: np.ndarray, mm: np.ndarray, has: bool) -> dict[str, np.ndarray]:
    """Columns of a replay over the rows of (rows, experts, classes)."""
    parts, low, n = [], 0, len(y)
    while low < n:
        # One by one, the first rows fill the histories; then come as many as go into lanes.
        size, part = run.long_block(*(x[low:low + PIECE] for x in (cube, y, fd, mm)), has)
        if not size:
            size = min(BLOCK, n - low, max(1, run.DEPTH - len(run.scores)) if lanes.cut(n - low)[0] else BLOCK)
            part = run.block(*(x[low:low + size] for x in (cube, y, fd, mm)), has)
        parts.append(part)
        low += size
    return {c: np.concatenate([p[c] for p in parts]) for c in ("routed", "weights", *FIELDS)}


def _features(pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, bool]:
    has = "feature_drift" in pdf.columns
    return *(pdf[c].to_numpy() if has else np.zeros(len(pdf)) for c in ("feature_drift", "feature_mmd")), has


def replay_step(experts: Sequence[str], keys: Sequence[str], cfg: Routing, classes: int):
    def step(pdf: pd.DataFrame, state: dict | None):
        run = Replay(len(experts), classes, cfg, state)
        cube = np.stack([np.stack(pdf[e].to_numpy()) for e in experts], axis=1).astype(float)
        y = np.array([int(v) for v in pdf["actual"].to_numpy()], np.int64)
        out = pdf[[*keys, "game_id"]].copy()
        for n, values in replayed(run, cube, y, *_features(pdf)).items():
            out[n] = list(values) if values.ndim > 1 else values
        return out, run.state()

    return step


def _flat(name: str, n: int) -> list[str]:
    return [f"_{name}_{i}" for i in range(n)]


def flat_step(experts: Sequence[str], keys: Sequence[str], cfg: Routing, classes: int):
    """``replay_step`` with a column for each element of a vector, which takes a fifth of the memory."""
    names = [c for e in experts for c in _flat(e, classes)]

    def step(pdf: pd.DataFrame, state: dict | None):
        run = Replay(len(experts), classes, cfg, state)
        cube = pdf[names].to_numpy(float).reshape(len(pdf), len(experts), classes)
        y = pdf["actual"].to_numpy().astype(np.int64)
        columns = {}
        for n, values in replayed(run, cube, y, *_features(pdf)).items():
            columns |= {n: values} if values.ndim == 1 else dict(zip(_flat(n, values.shape[1]), values.T))
        out = pd.concat([pdf[[*keys, "game_id"]], pd.DataFrame(columns, index=pdf.index)], axis=1)
        # No row depends on how often a temperature was moved; only states that are alike without the counts can meet.
        state = run.state()
        for part in (state["final"], *state["bank"]):
            part["accepted"] = part["rejected"] = 0
        return out, state

    return step


#: One resolved game of a replay's history; vectors of several experts are flat.
HISTORY = "loss array<double>, output array<double>, score double, raw array<double>, mix array<double>, actual long"


def split_state(state: dict) -> tuple[list[tuple], dict]:
    """A replay's state as rows of resolved games, oldest first, and the settings beside them.

    Histories end with the same game; shorter ones have no entry for the oldest rows.
    """
    n, bank, final = len(state["scores"]), state["bank"], state["final"]
    at = lambda values, i: values[i - n + len(values)] if i >= n - len(values) else None
    flat = lambda vectors: None if any(v is None for v in vectors) else [float(x) for v in vectors for x in v]
    rows = [
        (
            at(state["losses"], i), flat([*(at(state["outputs"], i) or [None])]), state["scores"][i], flat([at(b["p"], i) for b in bank]),
            at(final["p"], i), at(final["y"], i),
        )
        for i in range(n)
    ]
    kept = lambda t: {k: t[k] for k in ("t", "accepted", "rejected")}
    return rows, {"previous": state["previous"], "final": kept(final), "bank": [kept(b) for b in bank]}


def joined_state(rows: list[tuple], settings: dict) -> dict:
    """The state that ``split_state`` took apart."""
    losses, outputs, scores, raws, mixes, actuals = ([x for x in column if x is not None] for column in zip(*rows))
    k = len(settings["bank"])
    cut = lambda flat: [list(flat[j * (len(flat) // k):(j + 1) * (len(flat) // k)]) for j in range(k)]
    apart = [cut(r) for r in raws]
    actuals = [int(y) for y in actuals]
    return {
        "losses": [list(x) for x in losses], "outputs": [cut(o) for o in outputs], "scores": scores, "previous": settings["previous"],
        "final": settings["final"] | {"p": [list(m) for m in mixes], "y": actuals},
        "bank": [t | {"p": [a[j] for a in apart], "y": actuals} for j, t in enumerate(settings["bank"])],
    }


def replay(
    df: DataFrame, experts: Sequence[str], keys: Sequence[str] = ("league",), features: Sequence[str] = (), cfg: Routing = Routing(), classes: int = 3,
    log: list[int] | None = None,
) -> DataFrame:
    """Chronological predict-then-update replay per league (and configuration).

    Feature drift depends on features alone, so Spark windows compute it; only the true recursion runs in the step.
    ``log`` receives the number of slices that ran in each round, if a league is cut.
    """
    keys = list(keys)
    rows = df
    if features:
        # Written, as cutting the next timeline into slices would compute the windows once more.
        rows = rows.select(*dict.fromkeys([*keys, "game_id", "datetime", "actual", *experts, *features]))
        rows = drift.mmd_drift(spool(drift.feature_drift(rows, features, keys), "drifts"), features, keys)
        # The feature score blends the location-scale and kernel parts equally.
        rows = rows.withColumn("feature_mmd", F.col("mmd_drift")).withColumn("feature_drift", prob.clip01(0.5 * F.col("feature_drift") + 0.5 * F.col("mmd_drift")))
    # A vector of another length is an error, as it would be in the step.
    element = lambda e, i: F.when(F.size(e) == classes, F.col(e)[i].cast("double")).otherwise(F.raise_error(F.lit(f"{e} has not {classes} classes")).cast("double"))
    given = [element(e, i).alias(c) for e in experts for i, c in enumerate(_flat(e, classes))]
    rows = rows.select(*keys, "game_id", "datetime", "actual", *given, *(["feature_drift", "feature_mmd"] if features else []))
    if features:
        # Counting the leagues and drawing the bounds of slices would compute the windows again each time.
        rows = spool(rows, "drifts")
    kept = [f for f in rows.schema.fields if f.name in (*keys, "game_id")]
    vectors = {"routed": _flat("routed", classes), "weights": _flat("weights", len(experts))}
    schema = T.StructType([*kept, *[T.StructField(n, T.DoubleType()) for n in (*vectors["routed"], *vectors["weights"], *FIELDS)]])
    out = scan(rows, keys, ["datetime", "game_id"], flat_step(list(experts), keys, cfg, classes), schema, tolerance=1e-10, log=log, warm=WARM)
    return out.select(*[f.name for f in kept], *[F.array(*columns).alias(n) for n, columns in vectors.items()], *FIELDS)


#: What the report reads of a replay.
REPORTED = ("game_id", "routed", "drift", "uncertainty")


def replay_report(df: DataFrame, routed: DataFrame, keys: Sequence[str] = ("league",), p: str = "p") -> DataFrame:
    """Metric bundle of baseline and routed forecasts: all rows, two late windows and high-state slices."""
    keys = list(keys)
    both = df.select(*keys, "game_id", "datetime", "actual", p).join(routed.select(*REPORTED), "game_id")
    both = spool(both, "report")
    parts = [both.withColumn("slice", F.lit("all"))]
    late = drift.late_windows(both, keys)
    parts.append(late.withColumn("slice", F.col("window")).drop("window"))
    for c in ("drift", "uncertainty"):
        parts.append(reports.at_least_quantile(both, c, 0.5, keys).withColumn("slice", F.lit(f"high_{c}")))
    rows = parts[0]
    for x in parts[1:]:
        rows = rows.unionByName(x)
    long = rows.select(
        *keys, "slice", "actual",
        F.explode(F.array(F.struct(F.lit("baseline").alias("variant"), F.col(p).alias("q")), F.struct(F.lit("routed").alias("variant"), F.col("routed").alias("q")))).alias("v"),
    ).select(*keys, "slice", "actual", "v.variant", "v.q")
    return reports.metric_bundle(long, [*keys, "slice", "variant"], "q")


# Routing acceptance thresholds.
GATE = {"rows": 50, "logloss": 0.0005, "brier": 0.00025, "accuracy": 0.005, "ece": 0.010, "high_state": 0.010}


def acceptance_gate(report: DataFrame, keys: Sequence[str] = ("league",)) -> DataFrame:
    """Candidate gate per league: both late windows must improve and high-state slices must not regress."""
    keys = list(keys)
    at = lambda m, v: F.max(F.when(F.col("variant") == v, F.col(m)))
    wide = report.groupBy(*keys, "slice").agg(F.max("rows").alias("rows"), *[(at(m, "routed") - at(m, "baseline")).alias(f"d_{m}") for m in ("logloss", "brier", "accuracy", "ece")])
    passed = (
        (F.col("rows") >= GATE["rows"]) & (F.col("d_logloss") <= -GATE["logloss"]) & (F.col("d_brier") <= -GATE["brier"])
        & (F.col("d_accuracy") >= -GATE["accuracy"]) & (F.col("d_ece") <= GATE["ece"])
    )
    window, high = F.col("slice").startswith("window_"), F.col("slice").startswith("high_")
    safe = F.coalesce(F.bool_and(F.when(high & (F.col("rows") >= 20), F.col("d_logloss") <= GATE["high_state"])), F.lit(True))
    out = wide.groupBy(*keys).agg(F.count_if(window).alias("windows"), F.count_if(window & passed).alias("windows_passed"), safe.alias("high_state_safe"))
    ok = (F.col("windows") >= 2) & (F.col("windows_passed") == F.col("windows")) & F.col("high_state_safe")
    return out.withColumns({"candidate_eligible": ok, "status": F.when(F.col("windows") > 0, "PASS").otherwise("DEFERRED")})
