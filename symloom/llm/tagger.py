"""A character-level bidirectional recurrent network with CRF transitions, in numpy: tagging and training."""

from __future__ import annotations

import numpy as np

KINDS = ("email", "phone", "id_number", "address", "person")
#: O, then B and I of each kind.
TAGS = ("O", *(f"{p}-{k}" for k in KINDS for p in "BI"))

# Letters with marks are read as the letter below them; all else beyond ASCII as one of a few classes.
_PLAIN = "àáâãäåçèéêëìíîïñòóôõöøùúûüýÿÀÁÂÃÄÅÇÈÉÊËÌÍÎÏÑÒÓÔÕÖØÙÚÛÜÝß"
_BELOW = "aaaaaaceeeeiiiinoooooouuuuyyAAAAAACEEEEIIIINOOOOOOUUUUYs"
OTHER_LOWER, OTHER_UPPER, OTHER, PAD = 96, 97, 98, 99
VOCABULARY = 100


def _table() -> np.ndarray:
    codes = np.full(0x590, OTHER, dtype=np.uint8)  # up to Armenian: the scripts that have capitals
    for i in range(0xC0, 0x590):
        codes[i] = OTHER_LOWER if chr(i).islower() else OTHER_UPPER if chr(i).isupper() else OTHER
    codes[32:127] = np.arange(95)
    codes[[9, 0xA0]] = 0
    codes[[10, 13]] = 95
    for a, b in zip(_PLAIN, _BELOW):
        codes[ord(a)] = ord(b) - 32
    return codes


_CODES = _table()


def encode(text: str) -> np.ndarray:
    """One code per character."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    return np.where(points < len(_CODES), _CODES[np.minimum(points, len(_CODES) - 1)], OTHER).astype(np.uint8)


class Tagger:
    """Weights, and the best tag sequence of each window.

    Each direction is a recurrent cell of two gates: h += f * (g - h), f = clip(z_f, 0, 1), g = clip(z_g, -1, 1), where z
    is a line of `x` for the character plus h @ u. Clipping takes a twentieth of the time of exp and tanh.
    x is (gate, direction, code, unit), u is (gate, direction, unit, unit).
    """

    def __init__(self, weights: dict[str, np.ndarray]):
        self.w = {k: np.asarray(v, dtype=np.float32) for k, v in weights.items()}
        self.hidden = self.w["u"].shape[-1]

    @classmethod
    def fresh(cls, hidden: int, seed: int = 5) -> Tagger:
        rng = np.random.default_rng(seed)
        n = len(TAGS)
        x = rng.normal(0, 0.25, (2, 2, VOCABULARY, hidden))
        x[0] += 0.4  # neither stuck nor forgetful at first
        u = rng.normal(0, hidden**-0.5 / 2, (2, 2, hidden, hidden))
        return cls({"x": x, "u": u, "out": rng.normal(0, hidden**-0.5, (2 * hidden, n)), "bias": np.zeros(n), "move": np.zeros((n, n)), "first": np.zeros(n)})

    @classmethod
    def load(cls, path) -> Tagger:
        with np.load(path) as stored:
            return cls({k: stored[k] for k in stored.files})

    def save(self, path) -> None:
        np.savez_compressed(path, **{k: v.astype(np.float16) for k, v in self.w.items()})

    def _lines(self, codes: np.ndarray) -> np.ndarray:
        """(length, gate, direction, batch): the lines of all of `x` that the cells read."""
        both = np.stack([codes.T, codes.T[::-1]], axis=1).astype(np.intp)  # time, direction, batch
        return both[:, None] + np.arange(0, 4 * VOCABULARY, VOCABULARY).reshape(2, 2, 1)

    def emissions(self, codes: np.ndarray) -> np.ndarray:
        """(length, batch, tags) scores of windows (batch, length). Every step works in place, on what the caches hold."""
        batch, length = codes.shape
        n = self.hidden
        u, x, out = self.w["u"], self.w["x"].reshape(-1, n), np.ascontiguousarray(self.w["out"].reshape(2, n, -1).swapaxes(1, 2))
        lines = self._lines(codes)
        z = np.empty((2, 2, batch, n), dtype=np.float32)
        read = np.empty_like(z)
        f, g = z
        least, most = np.array([0, -1], dtype=np.float32).reshape(2, 1, 1, 1), np.float32(1)
        h = np.zeros((2, batch, n), dtype=np.float32)
        turned = h.swapaxes(1, 2)
        scores = np.empty((length, 2, len(TAGS), batch), dtype=np.float32)
        for t in range(length):
            np.matmul(h, u, out=z)
            z += x.take(lines[t], axis=0, out=read, mode="clip")
            np.clip(z, least, most, out=z)
            g -= h
            g *= f
            h += g
            np.matmul(out, turned, out=scores[t])
        scores[:, 0] += scores[::-1, 1]
        scores[:, 0] += self.w["bias"][:, None]
        return scores[:, 0].swapaxes(1, 2)

    def forward(self, codes: np.ndarray):
        """Scores as `emissions` gives them, and all that a gradient needs: states (with the first, zero), gates, lines of x."""
        batch, length = codes.shape
        n = self.hidden
        lines = self._lines(codes)
        gates = self.w["x"].reshape(-1, n)[lines]
        states = np.zeros((length + 1, 2, batch, n), dtype=np.float32)
        for t in range(length):
            z = gates[t]
            z += np.matmul(states[t], self.w["u"])
            np.clip(z[0], 0, 1, out=z[0])
            np.clip(z[1], -1, 1, out=z[1])
            states[t + 1] = states[t] + z[0] * (z[1] - states[t])
        joined = np.concatenate([states[1:, 0], states[:0:-1, 1]], axis=2)
        return joined @ self.w["out"] + self.w["bias"], joined, states, gates, lines

    def decode(self, scores: np.ndarray) -> np.ndarray:
        """The best sequence of tags (batch, length) under the CRF."""
        length, batch, n = scores.shape
        back = np.empty((length, batch, n), dtype=np.int8)
        best = scores[0] + self.w["first"]
        for t in range(1, length):
            options = best[:, :, None] + self.w["move"]
            back[t] = options.argmax(axis=1)
            best = options.max(axis=1) + scores[t]
        tags = np.empty((batch, length), dtype=np.int8)
        tags[:, -1] = best.argmax(axis=1)
        rows = np.arange(batch)
        for t in range(length - 1, 0, -1):
            tags[:, t - 1] = back[t, rows, tags[:, t]]
        return tags

    def gains(self) -> tuple[float, float]:
        """The most that transitions give other tags in a row over O: at each place, and once more for the whole row
        (into and out of it, instead of one within)."""
        move, first = self.w["move"], self.w["first"]
        stay = move[0, 0]
        enter = max(float((move[0, 1:] - stay).max()), float((first[1:] - first[0]).max()))
        leave = max(0.0, float((move[1:, 0] - stay).max()))  # at the end of a window there is no transition out
        within = float((move[1:, 1:] - stay).max())
        return within, enter + leave - within

    def tag(self, codes: np.ndarray) -> np.ndarray:
        """Tags of windows. Other tags in a row pay only where their gains outweigh O's leads, so a place that lies in no
        stretch of that kind is O; only what lies between such places is searched."""
        scores = self.emissions(codes)
        length, batch, n = scores.shape
        tags = np.zeros(codes.shape, dtype=np.int8)
        best = scores[:, :, 1].copy()
        for k in range(2, n):
            np.maximum(best, scores[:, :, k], out=best)
        best -= scores[:, :, 0]
        within, once = self.gains()
        best += within + 1e-3  # for rounding
        before, behind = best.copy(), best.copy()  # the best sums of stretches that end and that begin at a place
        for t in range(1, length):
            before[t] += np.maximum(before[t - 1], 0)
            behind[-1 - t] += np.maximum(behind[-t], 0)
        searched = np.zeros((batch, length + 2), dtype=np.int8)
        searched[:, 1:-1] = (before + behind - best + (once + 1e-3) > 0).T
        edge = np.diff(searched, axis=1)
        rows, starts = np.nonzero(edge > 0)
        stops = np.nonzero(edge < 0)[1]
        own = stops - starts
        # Runs are filled up by places of O alone, of which one at least stands on each side that is not the window's edge.
        front, back = starts > 0, stops < length
        sizes = own + front + back
        group = front + 2 * back
        order = np.lexsort((sizes, group))
        at = 0
        while at < len(order):
            same = order[at : at + 256]
            fits = (group[same] == group[same[0]]) & (sizes[same] <= 2 * sizes[same[0]]) & (back[same] | front[same] | (sizes[same] == sizes[same[0]]))
            same = same[: len(same) if fits.all() else int(fits.argmin())]
            at += len(same)
            size = int(sizes[same].max())
            first = np.where(back[same], front[same], size - own[same])
            part = np.full((size, len(same), n), -1e6, dtype=np.float32)
            part[:, :, 0] = 0
            for r, (m, a) in enumerate(zip(same, first)):
                part[a : a + own[m], r] = scores[starts[m] : stops[m], rows[m]]
            found = self.decode(part)
            for r, (m, a) in enumerate(zip(same, first)):
                tags[rows[m], starts[m] : stops[m]] = found[r, a : a + own[m]]
        return tags

    # -------------------------------------------------------------------------------------- training

    def gradient(self, codes: np.ndarray, tags: np.ndarray, mask: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean negative log-likelihood of the windows' tags under the CRF, and its gradient.

        mask (batch, length) is 0 on padding, which stands at the end of windows and counts as O.
        """
        scores, joined, states, gates, lines = self.forward(codes)
        length, batch, n = scores.shape
        move, first = self.w["move"].astype(np.float64), self.w["first"].astype(np.float64)
        s = scores.astype(np.float64)
        rows = np.arange(batch)
        # Forward and backward sums, scaled at each place to stay in range.
        highest = s.max(axis=2)
        e, moves = np.exp(s - highest[:, :, None]), np.exp(move)
        alpha, beta, scale = np.empty_like(e), np.ones_like(e), np.empty((length, batch))
        for t in range(length):
            a = np.matmul(alpha[t - 1], moves) * e[t] if t else np.exp(first) * e[0]
            scale[t] = a.sum(axis=1)
            alpha[t] = a / scale[t][:, None]
        ahead = e / scale[:, :, None]  # becomes what follows a place, with it
        for t in range(length - 1, -1, -1):
            ahead[t] *= beta[t]
            if t:
                beta[t - 1] = np.matmul(ahead[t], moves.T)
        z = (np.log(scale) + highest).sum(axis=0)
        y = tags.T
        gold = first[y[0]] + np.take_along_axis(s, y[:, :, None].astype(np.intp), 2).sum(axis=(0, 2)) + move[y[:-1], y[1:]].sum(axis=0)
        ds = alpha * beta
        dmove = moves * (alpha[:-1].reshape(-1, n).T @ ahead[1:].reshape(-1, n))
        np.add.at(dmove, (y[:-1], y[1:]), -1.0)
        ds[np.arange(length)[:, None], rows[None, :], y] -= 1.0
        loss = float((z - gold).mean())
        dfirst = ds[0].sum(axis=0)
        d = (ds / batch).astype(np.float32)
        grads = {"move": (dmove / batch).astype(np.float32), "first": (dfirst / batch).astype(np.float32), "bias": d.sum(axis=(0, 1)), "out": np.tensordot(joined, d, axes=([0, 1], [0, 1]))}
        dj = d @ self.w["out"].T
        m = self.hidden
        back = self.w["u"].swapaxes(-1, -2)
        dz = np.empty_like(gates)
        dh = np.zeros((2, batch, m), dtype=np.float32)
        for t in range(length - 1, -1, -1):
            dh[0] += dj[t, :, :m]
            dh[1] += dj[length - 1 - t, :, m:]
            f, g = gates[t]
            by = dz[t]
            np.multiply(dh, g - states[t], out=by[0])
            by[0] *= (f > 0) & (f < 1)
            np.multiply(dh, f, out=by[1])
            dh = dh - by[1]
            by[1] *= np.abs(g) < 1
            dh += np.matmul(by, back).sum(axis=0)
        du, dx = np.empty_like(self.w["u"]), np.empty_like(self.w["x"])
        for k in range(2):
            before = np.ascontiguousarray(states[:-1, k]).reshape(-1, m)
            read = np.zeros((len(before), VOCABULARY), dtype=np.float32)
            read[np.arange(len(before)), lines[:, 0, k].ravel() - k * VOCABULARY] = 1
            for gate in range(2):
                own = np.ascontiguousarray(dz[:, gate, k]).reshape(-1, m)
                du[gate, k], dx[gate, k] = before.T @ own, read.T @ own
        return loss, grads | {"u": du, "x": dx}


class Adam:
    def __init__(self, weights: dict[str, np.ndarray], step: float = 0.004):
        self.step, self.n = step, 0
        self.m = {k: np.zeros_like(v) for k, v in weights.items()}
        self.v = {k: np.zeros_like(v) for k, v in weights.items()}

    def update(self, weights: dict[str, np.ndarray], grads: dict[str, np.ndarray], scale: float = 1.0) -> None:
        self.n += 1
        norm = np.sqrt(sum(float((g * g).sum()) for g in grads.values()))
        clip = min(1.0, 5.0 / (norm + 1e-9))
        for k, g in grads.items():
            g = g * clip
            self.m[k] += 0.1 * (g - self.m[k])
            self.v[k] += 0.002 * (g * g - self.v[k])
            weights[k] -= scale * self.step * (self.m[k] / (1 - 0.9**self.n)) / (np.sqrt(self.v[k] / (1 - 0.998**self.n)) + 1e-8)
