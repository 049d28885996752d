"""A small causal self-attention model in numpy over subword symbols: one head, one hidden layer, and an output that mixes
distributions over all symbols.

The output's weights come from the attention's state; its parts are distributions over the symbols themselves (columns
of a table) and, as part 0, a probability that the caller has for the symbol (0 where there is none, and part 0 then
takes no weight). So a symbol's probability is exact, and costs as much as there are parts.

Sequences are read in overlapping windows: a window scores STRIDE symbols and sees CONTEXT symbols before them,
so each symbol is scored once. All windows of a batch go through one masked attention.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np

STRIDE, CONTEXT = 48, 16
WIDTH, HIDDEN = 16, 16
#: Parts of the output: the caller's, and this many less one of the table.
PARTS = 16
BATCH = 96
#: Share of all symbols' distribution in each part while training.
FLOOR = 0.02
#: Logit of a part that takes no weight.
NEVER = np.float32(-1e4)


def windows(first: np.ndarray, stride: int = STRIDE, context: int = CONTEXT) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For sequences that begin at first (and end at first[1:]): where each window's scored part begins, how many
    symbols it scores, and how many of its context belong to its sequence."""
    size = np.diff(first)
    n = -(-size // stride)
    seq = np.repeat(np.arange(len(size)), n)
    place = (np.arange(len(seq)) - np.repeat(np.cumsum(n) - n, n)) * stride
    return first[:-1][seq] + place, np.minimum(stride, size[seq] - place), np.minimum(context, place)


@dataclass
class Attention:
    """Weights; inputs are numbers below `inputs`, outputs the weights of `parts` distributions."""

    inputs: int
    parts: int = PARTS
    seed: int = 0
    w: dict[str, np.ndarray] = field(default_factory=dict)
    room: dict[str, np.ndarray] | None = None

    def __post_init__(self):
        rng = np.random.default_rng(self.seed)
        shape = {"embed": (self.inputs, WIDTH), "place": (CONTEXT + STRIDE, WIDTH), "q": (WIDTH, WIDTH), "k": (WIDTH, WIDTH), "v": (WIDTH, WIDTH), "o": (WIDTH, WIDTH), "up": (WIDTH, HIDDEN), "down": (HIDDEN, WIDTH), "out": (WIDTH, self.parts), "bias": (self.parts,)}
        for k, s in shape.items():
            self.w.setdefault(k, np.zeros(s, np.float32) if len(s) == 1 else rng.normal(0, 0.5 if k == "embed" else 1 / np.sqrt(s[0]), s).astype(np.float32))
        t = np.arange(CONTEXT + STRIDE)
        self.mask = (t[None, :] <= t[CONTEXT:, None]).astype(np.float32)  # causal: scored place by seen place

    def __getstate__(self):
        return self.__dict__ | {"room": None}

    def _gather(self, x: np.ndarray, begin: np.ndarray, before: np.ndarray) -> tuple[np.ndarray, tuple[np.ndarray, np.ndarray]]:
        """Ids of the windows; which of them reach before their sequence, and for these 0 where a place lies there."""
        t, some = np.arange(CONTEXT + STRIDE) - CONTEXT, np.flatnonzero(before < CONTEXT)
        return x.take(begin[:, None] + t, mode="clip"), (some, (t >= -before[some, None]).astype(np.float32)[:, None, :])

    def _room(self, b: int) -> dict[str, np.ndarray]:
        """Arrays for b windows, kept for the next batch: fresh memory costs more than the arithmetic."""
        if self.room is None or len(self.room["h"]) != b or self.room["h"].dtype != self.w["embed"].dtype:
            seen, n, d = CONTEXT + STRIDE, b * STRIDE, self.w["embed"].dtype
            shape = {"h": (b, seen, WIDTH), "hs": (n, WIDTH), "q": (n, WIDTH), "a": (b, STRIDE, seen), "sum": (n, 1), "m": (n, WIDTH), "z": (n, WIDTH), "r": (n, HIDDEN), "out": (n, self.parts), "p": (n, self.parts)}
            later = {"d": (b, STRIDE, seen), "dh": (b, seen, WIDTH), "dk": (b, seen, WIDTH), "dz": (n, WIDTH), "dm": (n, WIDTH), "dq": (n, WIDTH), "dr": (n, HIDDEN), "x": (n, WIDTH)}  # the gradient's
            self.room = {k: np.empty(s, d) for k, s in (shape | later).items()} | {"at": np.empty((b * seen, WIDTH), np.int64)}
        return self.room

    def _products(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Products of weights that always meet: of q and k, of v and o, of down and out. With these the seen places
        need no keys and values of their own, nor the parts a state."""
        w = self.w
        return w["q"] @ w["k"].T * w["q"].dtype.type(WIDTH**-0.5), w["v"] @ w["o"], w["down"] @ w["out"]

    def forward(self, ids: np.ndarray, inside: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
        """Logits of the parts (windows * STRIDE, parts) for windows of input ids (windows, CONTEXT + STRIDE)."""
        w, b = self.w, len(ids)
        x = self._room(b)
        qk, vo, last = x["products"] = self._products()
        ones = np.ones((CONTEXT + STRIDE, 1), qk.dtype)  # sums of short rows cost less as products
        np.take(w["embed"], ids, axis=0, out=x["h"], mode="clip")
        x["h"] += w["place"]
        x["hs"].reshape(b, STRIDE, WIDTH)[:] = x["h"][:, CONTEXT:]
        np.matmul(x["hs"], qk, out=x["q"])
        a = x["a"]
        np.matmul(x["q"].reshape(b, STRIDE, WIDTH), x["h"].transpose(0, 2, 1), out=a)
        if a.max(initial=0) > 60:
            np.minimum(a, 60, out=a)
        np.exp(a, out=a)
        a *= self.mask
        some, inside = inside
        if len(some):
            a[some] *= inside
        np.matmul(a.reshape(-1, CONTEXT + STRIDE), ones, out=x["sum"])
        np.matmul(a, x["h"], out=x["m"].reshape(b, STRIDE, WIDTH))
        x["m"] /= x["sum"]
        np.matmul(x["m"], vo, out=x["z"])
        x["z"] += x["hs"]
        np.matmul(x["z"], w["up"], out=x["r"])
        np.maximum(x["r"], 0, out=x["r"])
        np.matmul(x["z"], w["out"], out=x["out"])
        x["out"] += np.matmul(x["r"], last, out=x["p"])
        x["out"] += w["bias"]
        return x["out"]

    def log_probability(self, x: np.ndarray, symbols: np.ndarray, given: np.ndarray, table: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Natural log probability of each symbol, given the inputs x up to it (x[i] is what stands before symbol i).
        table: a row of the parts for each symbol, part 0 unused; given: part 0 of each place."""
        out = np.empty(len(x), np.float32)
        begin, size, before = windows(first)
        ones, place = np.ones(self.parts, np.float32), np.arange(STRIDE)
        none = given == 0
        for i in range(0, len(begin), BATCH):
            b = begin[i : i + BATCH]
            logits = self.forward(*self._gather(x, b, before[i : i + BATCH]))
            at = b[:, None] + place
            flat = at.ravel()
            never, one = none.take(flat, mode="clip"), given.take(flat, mode="clip")
            if logits.max(initial=0) > 40 or logits.min(initial=0) < -40:
                logits[never, 0] = NEVER
                logits -= logits.max(axis=1, keepdims=True)
            p = np.exp(logits, out=logits)
            p[:, 0] *= ~never
            of = np.take(table, symbols.take(flat, mode="clip"), axis=0, out=self.room["p"], mode="clip")
            of[:, 0] = one
            of *= p
            found = np.log((of @ ones) / (p @ ones))
            real = place < size[i : i + BATCH, None]
            out[at[real]] = found[real.ravel()]
        return out

    def gradient(self, x: np.ndarray, symbols: np.ndarray, given: np.ndarray, rows, begin: np.ndarray, size: np.ndarray, before: np.ndarray) -> tuple[float, dict, np.ndarray, np.ndarray]:
        """Mean loss of the windows' symbols and its gradient (of the embedding: rows and theirs); the symbols, and
        how much each part had of each. rows: from symbols to their rows of the table."""
        w = self.w
        ids, inside = self._gather(x, begin, before)
        logits, t, b = self.forward(ids, inside), self.room, len(ids)
        full = (size == STRIDE).all()
        real = slice(None) if full else (np.arange(STRIDE) < size[:, None]).ravel()
        at = (begin[:, None] + np.arange(STRIDE)).ravel()
        target, one = symbols.take(at, mode="clip"), given.take(at, mode="clip")
        logits[one == 0, 0] = NEVER
        if logits.max(initial=0) > 40 or logits[:, 1:].min(initial=0) < -40:
            logits -= logits.max(axis=1, keepdims=True)
        ones, each = np.ones((self.parts, 1), logits.dtype), np.ones(len(logits), logits.dtype)
        p = np.exp(logits, out=logits)
        p /= p @ ones
        share = rows(target)
        share[:, 0] = one
        share *= p
        total = share @ ones
        share /= total
        n = len(target) if full else real.sum()
        loss = float(-np.log(total.ravel()[real]).mean())
        d = np.subtract(p, share, out=p)
        d *= p.dtype.type(1 / n) if full else (real / n)[:, None].astype(p.dtype)
        qk, vo, last = t["products"]
        z, r, m = t["z"].T @ d, t["r"].T @ d, t["m"]
        g = {"out": z + w["down"].T @ r, "down": r @ w["out"].T, "bias": each @ d}
        dr = np.matmul(d, last.T, out=t["dr"])
        dr *= t["r"] > 0
        g["up"] = t["z"].T @ dr
        dz = np.matmul(d, w["out"].T, out=t["dz"])
        dz += np.matmul(dr, w["up"].T, out=t["x"])
        dvo = m.T @ dz
        g["v"], g["o"] = dvo @ w["o"].T, w["v"].T @ dvo
        dm = np.matmul(dz, vo.T, out=t["dm"])
        e = np.multiply(dm, m, out=t["x"]) @ np.ones((WIDTH, 1), dm.dtype)  # as the weights' sums make m
        dm /= t["sum"]
        deep = lambda v: v.reshape(b, STRIDE, WIDTH)
        ds = np.matmul(deep(dm), t["h"].transpose(0, 2, 1), out=t["d"])
        ds *= t["a"]
        dq = t["dq"]
        np.matmul(ds, t["h"], out=deep(dq))
        dq -= np.multiply(m, e, out=t["x"])
        e /= t["sum"]
        dm -= np.multiply(t["q"], e, out=t["x"])
        dh = np.matmul(t["a"].transpose(0, 2, 1), deep(dm), out=t["dh"])
        dh += np.matmul(ds.transpose(0, 2, 1), deep(t["q"]), out=t["dk"])
        scale = dm.dtype.type(WIDTH**-0.5)
        g["q"], g["k"] = _apart(t["hs"].T @ dq * scale, w["q"], w["k"])
        dz += np.matmul(dq, qk.T, out=t["x"])
        dh[:, CONTEXT:] += deep(dz)
        g["place"] = dh.sum(0)
        np.add(ids.reshape(-1, 1) * WIDTH, np.arange(WIDTH), out=t["at"])
        g["embed"] = slice(None), np.zeros_like(w["embed"])
        np.add.at(g["embed"][1].reshape(-1), t["at"].reshape(-1), dh.reshape(-1))  # one flat array costs far less than rows
        return loss, g, target[real], share[real]


def _apart(d: np.ndarray, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The gradients of left and right from that of left @ right.T."""
    return d @ right, d.T @ left


def summed(keys: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different keys, and the sums of their rows."""
    order = np.argsort((keys & 0xFFFF).astype(np.uint16), kind="stable")  # by digits, as short numbers are sorted in one pass
    for shift in range(16, int(keys.max(initial=0)).bit_length(), 16):
        order = order[np.argsort(((keys[order] >> shift) & 0xFFFF).astype(np.uint16), kind="stable")]
    same = keys[order]
    edge = np.flatnonzero(np.append(True, same[1:] != same[:-1]))
    return same[edge], np.add.reduceat(rows[order], edge)


class Training:
    """Adam for the attention, and expectation-maximisation in steps for the table: what each part had of each symbol is
    summed, later steps weighing more. fixed: the table stays, only its sums grow."""

    BATCH = 96
    #: Steps whose shares are added up together.
    HELD = 16

    def __init__(self, model: Attention, sums: np.ndarray, common: np.ndarray, steps: int, rate: float = 0.01, fixed: bool = False):
        """sums: by symbol and part, to begin with; common: the distribution of all symbols."""
        self.model, self.steps, self.rate, self.step, self.fixed = model, steps, rate, 0, fixed
        self.rng = np.random.default_rng(model.seed)
        ends = np.cumsum([v.size for v in model.w.values()])
        self.w, self.g = np.concatenate([v.ravel() for v in model.w.values()]), np.zeros(ends[-1], np.float32)
        self.m, self.s, self.by = (np.zeros_like(self.w) for _ in range(3))
        pieces = lambda flat: {k: x.reshape(v.shape) for (k, v), x in zip(model.w.items(), np.split(flat, ends[:-1]), strict=True)}
        model.w, self.grad = pieces(self.w), pieces(self.g)  # as parts of one array, a step takes few calls
        self.common = common.astype(np.float32)
        self.begin, self.total = sums.astype(np.float32), sums.sum(0).astype(np.float32)
        self.sums = np.zeros_like(self.begin, order="F") if fixed else self.begin
        self.table = None
        if fixed:
            self.table = self.rows(np.arange(len(self.common)))
            most = self.BATCH * STRIDE
            self.taken = np.empty((most, model.parts), np.float32)
            self.keys, self.shares, self.used = np.empty(self.HELD * most, np.int64), np.empty((self.HELD * most, model.parts), np.float32), 0

    def rows(self, symbols: np.ndarray) -> np.ndarray:
        """Of the table, until the next call."""
        if self.table is not None:
            return self.table.take(symbols, axis=0, out=self.taken[: len(symbols)], mode="clip")
        return self.begin[symbols] / self.total * (1 - FLOOR) + FLOOR * self.common[symbols][:, None]

    def on(self, x: np.ndarray, symbols: np.ndarray, given: np.ndarray, begin: np.ndarray, size: np.ndarray, before: np.ndarray) -> list[float]:
        """Each window once, in random order; returns the mean loss of each step."""
        order, losses = self.rng.permutation(len(begin)), []
        for a in range(0, len(order), self.BATCH):
            i = order[a : a + self.BATCH]
            self.step += 1
            loss, grad, target, share = self.model.gradient(x, symbols, given, self.rows, begin[i], size[i], before[i])
            losses.append(loss)
            at, grad["embed"] = grad["embed"]
            for k, g in grad.items():
                self.grad[k][at if k == "embed" else ...] = g
            self._adam()
            if self.fixed:
                if self.used + len(target) > len(self.keys):
                    self.add()
                here = slice(self.used, self.used + len(target))
                self.keys[here], self.shares[here] = target, share
                self.used += len(target)
                continue
            at, rows = summed(target, share)
            weight = np.float32(self.step)
            self.sums[at] += weight * rows
            self.total += weight * rows.sum(0)
        self.add()
        return losses

    def _adam(self) -> None:
        g, m, s, by = self.g, self.m, self.s, self.by
        now = self.rate * min(1, self.step / 20) * max(0.05, 1 - 0.95 * self.step / self.steps)
        m *= 0.9
        m += np.multiply(g, 0.1, out=by)
        s *= 0.99
        g *= g
        s += np.multiply(g, 0.01, out=by)
        np.sqrt(s, out=by)
        by *= (1 - 0.99**self.step) ** -0.5
        by += 1e-6
        np.divide(m, by, out=by)
        by *= now / (1 - 0.9**self.step)
        self.w -= by

    def add(self) -> None:
        """Puts the held steps' shares into the sums; several steps have many symbols in common."""
        if self.fixed and self.used:
            keys, rows = self.keys[: self.used], self.shares[: self.used]
            for j in range(rows.shape[1]):
                self.sums[:, j] += np.bincount(keys, rows[:, j], len(self.sums))
            self.used = 0
