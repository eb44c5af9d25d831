"""A replay's recursions over many stretches of a league at once.

Rows of a replay follow from each other, but only through weights and temperatures, which forget where they came from. Long runs
of rows are therefore cut into lanes of equal length that advance together, one step of array arithmetic for all of them. Every
lane but the first starts from a guess; then the rows at its start are done again from the end of the lane before, until both
courses have been the same for as many rows as the state remembers. A lane whose end changes hands it on once more, so the rows
are those of one pass from the first row to the last, whatever the guesses were.
"""

from __future__ import annotations

import numpy as np

#: Courses that differ by no more are the same. Fewer rows than these are not worth lanes.
SAME, FEW = 1e-12, 2048
#: Steps after which lanes that have met their former course are left out.
SIFT = 32


def cut(n: int) -> tuple[int, int]:
    """(lanes, rows in each) for ``n`` rows, fewer than a row a lane being left over. A step costs about as much as 50 rows, and a lane's start is done twice."""
    lanes = int(n**0.5 / 4) if n >= FEW else 0
    return (lanes, n // lanes) if lanes else (0, 0)


# ---- sums over the last rows -----------------------------------------------------------------------


def powers(width: int) -> list[tuple[int, int]]:
    """Sums over ``width`` rows as sums over powers of two: (size, how far back its last row lies)."""
    out, back = [], 0
    for k in reversed(range(width.bit_length())):
        if width >> k & 1:
            out.append((1 << k, back))
            back += 1 << k
    return out


def ladder(x: np.ndarray, widest: int, fade: float = 1.0) -> dict[int, np.ndarray]:
    """Sums over 1, 2, 4, ... rows that end at each row which has so many; a row weighs ``fade`` times the one after it."""
    sums, size = {1: x}, 1
    while 2 * size <= widest:
        one = sums[size]
        sums[2 * size] = one[size:] + (one[:-size] if fade == 1.0 else fade**size * one[:-size])
        size *= 2
    return sums


def over(sums: dict[int, np.ndarray], width: int, first: int, n: int, fade: float = 1.0) -> np.ndarray:
    """Sums of ``ladder`` over the last ``width`` rows, at the ``n`` rows from ``first`` on."""
    total = 0.0
    for size, back in powers(width):
        at = first - back - size + 1
        total = total + (sums[size][at:at + n] if fade == 1.0 else fade**back * sums[size][at:at + n])
    return total


# ---- lanes -----------------------------------------------------------------------------------------


def spread_out(x: np.ndarray, lanes: int, rows: int, before: int = 0) -> np.ndarray:
    """(before + rows, ..., lanes): the rows of each lane and those ahead of them; ``x`` begins ``before`` rows ahead of the first lane."""
    at = np.arange(before + rows)[:, None] + rows * np.arange(lanes)
    return np.ascontiguousarray(np.moveaxis(x[at], 1, -1))


def end_to_end(x: np.ndarray) -> np.ndarray:
    """(lanes * rows, ...) of (rows, ..., lanes)."""
    y = np.moveaxis(x, -1, 0)
    return y.reshape(-1, *y.shape[2:])


class Course:
    """Lanes of one recursion. ``kept`` has what each step left, (rows, ..., lanes); ``followed`` names what makes two courses the same.

    Subclasses define ``begin`` (the state of lanes, from a guess or from what is kept of the lanes before them), ``step`` and
    ``only`` (the state of some of the lanes).
    """

    followed: tuple[str, ...] = ()
    #: Rows that the state remembers.
    memory = 1

    def __init__(self, rows: int, lanes: int, leagues: int = 1):
        self.rows, self.lanes = rows, lanes
        # Side by side lie as many independent recursions, each with a first lane whose start is known.
        self.first = np.arange(lanes) % (lanes // leagues) == 0
        self.kept: dict[str, np.ndarray] = {}
        #: What a lane hands on beside its kept rows.
        self.after = np.empty(lanes)

    def settle(self) -> None:
        every = np.arange(self.lanes)
        self._run(every, self.begin(every, True), False)
        todo = every[~self.first]
        while len(todo):
            moved = self._run(todo, self.begin(todo, False), True) + 1
            moved = moved[moved < self.lanes]
            todo = moved[~self.first[moved]]

    def _run(self, which: np.ndarray, state: dict, again: bool) -> np.ndarray:
        """Advances lanes to their ends; of a second run the lanes that came there without having met their former course."""
        met = np.zeros(len(which), np.int64)
        full = not again
        for s in range(self.rows):
            out = self.step(s, state, which)
            if again:
                alike = np.ones(len(which), bool)
                for c in self.followed:
                    was, now = self.kept[c][s][..., which], out[c]
                    close = (np.abs(was - now) <= SAME) | (np.isnan(was) & np.isnan(now))
                    alike &= close if close.ndim == 1 else close.all(axis=0)
                met = (met + 1) * alike
            for c, x in out.items():
                if full:
                    self.kept[c][s] = x
                else:
                    self.kept[c][s][..., which] = x
            if again and s % SIFT == SIFT - 1:
                apart = met < self.memory
                if not apart.all():
                    which, met, state = which[apart], met[apart], self.only(state, apart)
                if not len(which):
                    return which
        self.after[which] = state["t"]
        return which[met < self.memory]


class Fitted:
    """What a temperature's rules need: the grid, how a window is cut, and the bounds of a move."""

    def __init__(self, cfg, grid: np.ndarray, penalty: np.ndarray, fit: int, most: float):
        self.cfg, self.grid, self.penalty, self.fit, self.most = cfg, grid, penalty, fit, most
        self.late = cfg.long - fit

    def losses(self, logs: np.ndarray, hit: np.ndarray) -> np.ndarray:
        """(grid, ...) losses of log vectors (classes, ...) of which ``hit`` is the resolved class."""
        grid = self.grid.reshape(-1, *[1] * hit.ndim)
        total = np.exp(logs[0] / grid)
        for x in logs[1:]:
            total += np.exp(x / grid)
        return np.minimum(np.log(total, out=total) - hit / grid, self.most)

    def now(self, logs: np.ndarray, hit: np.ndarray, t: np.ndarray) -> np.ndarray:
        """Mean loss at ``t`` over late rows: logs (late, classes, lanes), hit (late, lanes)."""
        total = np.exp(logs / t).sum(axis=1)
        return np.minimum(np.log(total, out=total) - hit / t, self.most).mean(axis=0)

    def judged(self, t: np.ndarray, candidate: np.ndarray, its: np.ndarray, now: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(temperature, whether the candidate was taken up) of each lane."""
        cfg = self.cfg
        taken = ~(its + cfg.gain >= now)
        move = np.minimum(np.maximum(candidate - t, -cfg.max_step), cfg.max_step)
        return np.where(taken, np.minimum(np.maximum(t + cfg.step * move, cfg.t_min), cfg.t_max), t), taken


class Bank(Course):
    """Temperatures of the experts, whose candidates are known: only the temperature follows from row to row."""

    followed = ("t",)

    def __init__(self, fitted: Fitted, start: np.ndarray, logs: np.ndarray, hit: np.ndarray, candidate: np.ndarray, its: np.ndarray):
        """``logs`` (late - 1 + rows, classes, lanes) and ``hit`` begin ahead of the first row; lanes of one expert lie together."""
        super().__init__(len(candidate), candidate.shape[1], len(start))
        self.fitted, self.start, self.logs, self.hit, self.candidate, self.its = fitted, start, logs, hit, candidate, its
        self.kept = {"t": np.empty(candidate.shape), "taken": np.empty(candidate.shape, bool)}

    def begin(self, which, guess):
        t = np.ones(self.lanes) if guess else self.after[which - 1]
        if guess:
            t[self.first] = self.start
        return {"t": t, "all": len(which) == self.lanes, "which": which}

    def only(self, state, some):
        return {"t": state["t"][some], "all": False, "which": state["which"][some]}

    def step(self, s, state, which):
        t, late = state["t"], self.fitted.late
        of = (lambda x: x) if state["all"] else (lambda x: x[..., which])
        now = self.fitted.now(of(self.logs[s:s + late]), of(self.hit[s:s + late]), t)
        state["t"], taken = self.fitted.judged(t, of(self.candidate[s]), of(self.its[s]), now)
        return {"t": t, "taken": taken}


class Mixture(Course):
    """Weights, conformal scores and the last temperature, which follow from each other."""

    followed = ("weights", "t")

    def __init__(self, fitted: Fitted, rows: int, lanes: int, depth: int, given: dict[str, np.ndarray], past: dict[str, np.ndarray], start: dict):
        """``given`` (rows, ..., lanes) is what the experts alone decide; ``past`` (before, ..., lanes) guesses of the rows ahead of each lane."""
        super().__init__(rows, lanes)
        self.fitted, self.depth, self.given, self.past, self.start = fitted, depth, given, past, start
        self.memory = max(depth, fitted.cfg.long)
        _, k, c, _ = given["current"].shape
        wide = {"weights": (k,), "routed": (c,), "logs": (c,)}
        self.kept = {n: np.empty((rows, *wide.get(n, ()), lanes)) for n in ("weights", "routed", "logs", "hit", "t", "score", "conformal", "doubt")}
        self.kept["taken"] = np.empty((rows, lanes), bool)
        self.need = max(fitted.fit, fitted.late).bit_length()
        self.ring = 1 << max(fitted.cfg.long, 2).bit_length()

    def begin(self, which, guess):
        long, n = self.fitted.cfg.long, self.rows
        if guess:
            past = self.past
            previous, t = self.start["weights"], self.start["t"]
        else:
            tail = {c: (self.depth if c == "score" else long) for c in ("score", "logs", "hit")}
            past = {c: self.kept[c][n - rows:][..., which - 1] for c, rows in tail.items()}
            previous, t = self.kept["weights"][n - 1][..., which - 1], self.after[which - 1]
        lanes = len(which)
        scores = np.empty((self.depth + n, lanes))
        scores[:self.depth] = past["score"]
        logs = np.empty((long + n, *past["logs"].shape[1:]))
        logs[:long] = past["logs"]
        hit = np.empty((long + n, lanes))
        hit[:long] = past["hit"]
        # Rings of the losses over the last 1, 2, 4, ... rows, by row number modulo their length.
        losses = np.moveaxis(self.fitted.losses(np.moveaxis(past["logs"], 1, 0), past["hit"]), 0, 1)
        rings = []
        for sums in ladder(losses, 1 << (self.need - 1)).values():
            ring = np.empty((self.ring, len(self.fitted.grid), lanes))
            ring[(np.arange(long - len(sums), long)) % self.ring] = sums
            rings.append(ring)
        given = self.given if lanes == self.lanes else {c: x[..., which] for c, x in self.given.items()}
        return {"scores": scores, "logs": logs, "hit": hit, "rings": rings, "previous": previous, "t": t, "given": given, "lane": np.arange(lanes)}

    def only(self, state, some):
        at = np.flatnonzero(some)
        cut_ = lambda x: np.ascontiguousarray(x[..., at])
        return {
            **{c: cut_(state[c]) for c in ("scores", "logs", "hit", "previous", "t")}, "rings": [cut_(r) for r in state["rings"]],
            "given": {c: cut_(x) for c, x in state["given"].items()}, "lane": np.arange(len(at)),
        }

    def step(self, s, state, which):
        cfg, f, g, t, lane = self.fitted.cfg, self.fitted, state["given"], state["t"], state["lane"]
        # The conformal signal.
        above = np.add.reduce((state["scores"][s:s + self.depth, None] >= g["edge"][s]).view(np.int8), axis=0, dtype=np.int16)
        size = np.add.reduce((1.0 + above) / (self.depth + 1.0) > 0.10, axis=0, dtype=np.int64)
        conformal = clip01(0.6 * clip01((size - 1) / max(len(above) - 1, 1)) + g["near"][s])
        # The weights.
        doubt = clip01(g["unsure"][s] + cfg.uncertainty[2] * conformal)
        pull = np.minimum(np.maximum(cfg.uniform_mix * doubt, 0.0), 0.80)
        anchor = state["previous"] / state["previous"].sum(axis=0)
        w = (1.0 - pull) * g["base"][s] + pull * anchor
        w = g["hold"][s] * anchor + (1.0 - g["hold"][s]) * w
        w = np.maximum(w, min(cfg.floor, 0.98 / len(w)))
        w = w / w.sum(axis=0)
        mix = unit((g["current"][s] * w[:, None]).sum(axis=0))
        # The forecast at the present temperature, and its score.
        q = unit(mix)
        final = q ** (1.0 / t)
        final = final / final.sum(axis=0)
        y = g["y"][s]
        score = 1.0 - unit(final)[y, lane]
        # Resolve: the candidate from the first rows of the window, judged by the others.
        at = self.depth + s
        state["scores"][at] = score
        row = cfg.long + s
        logs = np.log(q)
        hit = logs[y, lane]
        state["logs"][row], state["hit"][row] = logs, hit
        rings, mod = state["rings"], self.ring - 1
        one = f.losses(logs, hit)
        rings[0][row & mod] = one
        for k in range(1, len(rings)):
            one = one + rings[k - 1][(row - (1 << (k - 1))) & mod]
            rings[k][row & mod] = one
        total = 0.0
        for width, back in powers(f.fit):
            total = total + rings[width.bit_length() - 1][(row - f.late - back) & mod]
        total /= f.fit
        total += f.penalty[:, None]
        best = total.argmin(axis=0)
        its = 0.0
        for width, back in powers(f.late):
            its = its + rings[width.bit_length() - 1][(row - back) & mod][best, lane]
        late = slice(row - f.late + 1, row + 1)
        state["t"], taken = f.judged(t, f.grid[best], its / f.late, f.now(state["logs"][late], state["hit"][late], t))
        state["previous"] = w
        return {"weights": w, "routed": final, "logs": logs, "hit": hit, "t": t, "score": score, "conformal": conformal, "doubt": doubt, "taken": taken}


def clip01(x: np.ndarray) -> np.ndarray:
    return np.minimum(np.maximum(x, 0.0), 1.0)


def unit(p: np.ndarray) -> np.ndarray:
    """Vectors along the first axis, within their bounds and with a sum of one."""
    q = np.minimum(np.maximum(p, 1e-12), 1.0)
    return q / q.sum(axis=0)
