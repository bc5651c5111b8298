"""A character tagger in numpy: a bidirectional LSTM gives each character scores, a CRF the best sequence of tags.

Arrays are (directions, windows, ...); both directions run in one loop over the characters of all windows.
"""

from __future__ import annotations

import numpy as np

#: Symbols: ASCII, one for all other characters, one for what lies outside the text.
OTHER, OUTSIDE, SYMBOLS = 128, 129, 130
_NEVER = -1e4


def symbols(text: str, begin: int, width: int) -> np.ndarray:
    """Symbols of text[begin : begin + width], filled up to width."""
    out = np.full(width, OUTSIDE, np.uint8)
    codes = np.frombuffer(text[begin : begin + width].encode("utf-32-le", "surrogatepass"), "<u4")
    out[: len(codes)] = np.minimum(codes, OTHER)
    return out


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * z) + 0.5


def _sum_exp(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(x - top).sum(axis=axis))


class Tagger:
    """Tags: 0 is none; 1 + 2k begins kind k, 2 + 2k goes on with it."""

    def __init__(self, kinds: int, hidden: int = 16, seed: int = 42):
        rng, tags = np.random.default_rng(seed), 1 + 2 * kinds
        self.hidden, self.tags = hidden, tags
        draw = lambda *shape, scale: (rng.standard_normal(shape) * scale).astype(np.float32)
        self.p = {
            "wx": draw(2, SYMBOLS, 4 * hidden, scale=0.3),
            "wh": draw(2, hidden, 4 * hidden, scale=hidden**-0.5),
            "b": np.zeros((2, 1, 4 * hidden), np.float32),
            "wo": draw(2 * hidden, tags, scale=(2 * hidden) ** -0.5),
            "bo": np.zeros(tags, np.float32),
            "step": np.zeros((tags, tags), np.float32),
            "start": np.zeros(tags, np.float32),
        }
        self.p["b"][:, :, hidden : 2 * hidden] = 1  # remember at first
        # Going on with a kind needs its begin before it; a window may begin inside a span.
        self.never = np.zeros((tags, tags), np.float32)
        for k in range(kinds):
            for tag in range(tags):
                if tag not in (1 + 2 * k, 2 + 2 * k):
                    self.never[tag, 2 + 2 * k] = _NEVER

    # --- scores of characters ---------------------------------------------------------------------------------

    def scores(self, sym: np.ndarray, keep: dict | None = None) -> np.ndarray:
        """(windows, width, tags) from symbols (windows, width); keep receives what the gradient needs."""
        p, H = self.p, self.hidden
        B, T = sym.shape
        both = np.stack([sym, sym[:, ::-1]])
        gates = np.empty((T, 2, B, 4 * H), np.float32)
        for d in range(2):
            gates[:, d] = p["wx"][d][both[d].T] + p["b"][d]
        h, c = np.zeros((2, B, H), np.float32), np.zeros((2, B, H), np.float32)
        hs, cs = np.empty((T, 2, B, H), np.float32), np.empty((T, 2, B, H), np.float32)
        for t in range(T):
            z = gates[t]
            z += h @ p["wh"]
            z[..., : 3 * H] = _sigmoid(z[..., : 3 * H])
            z[..., 3 * H :] = np.tanh(z[..., 3 * H :])
            c = z[..., H : 2 * H] * c + z[..., :H] * z[..., 3 * H :]
            h = z[..., 2 * H : 3 * H] * np.tanh(c)
            hs[t], cs[t] = h, c
        features = np.concatenate([hs[:, 0], hs[::-1, 1]], axis=-1).transpose(1, 0, 2)
        if keep is not None:
            keep.update(both=both, gates=gates, hs=hs, cs=cs, features=features)
        return features @ p["wo"] + p["bo"]

    def _back(self, d_scores: np.ndarray, kept: dict) -> dict[str, np.ndarray]:
        p, H = self.p, self.hidden
        features, gates, hs, cs, both = (kept[k] for k in ("features", "gates", "hs", "cs", "both"))
        B, T, _ = features.shape
        flat = d_scores.reshape(-1, self.tags)
        g = {"wo": features.reshape(-1, 2 * H).T @ flat, "bo": flat.sum(0), "wx": np.zeros_like(p["wx"]), "wh": np.zeros_like(p["wh"]), "b": np.zeros_like(p["b"])}
        df = (d_scores @ p["wo"].T).transpose(1, 0, 2)
        d_h = np.stack([df[..., :H], df[::-1, :, H:]], axis=1)
        dh_next, dc = np.zeros((2, B, H), np.float32), np.zeros((2, B, H), np.float32)
        d_gates = np.empty_like(gates)
        for t in range(T - 1, -1, -1):
            i, f, o, a = (gates[t][..., k * H : (k + 1) * H] for k in range(4))
            dh, tc = d_h[t] + dh_next, np.tanh(cs[t])
            dc = dc + dh * o * (1 - tc * tc)
            before = cs[t - 1] if t else np.zeros_like(tc)
            d_gates[t] = np.concatenate([dc * a * i * (1 - i), dc * before * f * (1 - f), dh * tc * o * (1 - o), dc * i * (1 - a * a)], axis=-1)
            dh_next = d_gates[t] @ p["wh"].transpose(0, 2, 1)
            dc = dc * f
        for d in range(2):
            mine = d_gates[:, d].reshape(-1, 4 * H)
            g["wh"][d] = hs[:-1, d].reshape(-1, H).T @ d_gates[1:, d].reshape(-1, 4 * H)
            np.add.at(g["wx"][d], both[d].T.reshape(-1), mine)
            g["b"][d, 0] = mine.sum(0)
        return g

    # --- sequences of tags ------------------------------------------------------------------------------------

    def _passes(self, scores: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Log sums of all sequences up to, and from, each character; the total."""
        step, (B, T, K) = self.p["step"] + self.never, scores.shape
        ahead, behind = np.empty((T, B, K), np.float32), np.zeros((T, B, K), np.float32)
        ahead[0] = scores[:, 0] + self.p["start"]
        for t in range(1, T):
            ahead[t] = scores[:, t] + _sum_exp(ahead[t - 1][:, :, None] + step, 1)
        for t in range(T - 2, -1, -1):
            behind[t] = _sum_exp(step + (scores[:, t + 1] + behind[t + 1])[:, None, :], 2)
        return ahead, behind, _sum_exp(ahead[-1], 1)

    def marginals(self, scores: np.ndarray) -> np.ndarray:
        """(windows, width, tags): how probable each tag is."""
        ahead, behind, total = self._passes(scores)
        return np.exp(ahead + behind - total[None, :, None]).transpose(1, 0, 2)

    def decode(self, scores: np.ndarray) -> np.ndarray:
        """(windows, width): the best sequence of tags."""
        step, (B, T, K) = self.p["step"] + self.never, scores.shape
        best, came = scores[:, 0] + self.p["start"], np.empty((T, B, K), np.int64)
        for t in range(1, T):
            ways = best[:, :, None] + step
            came[t] = ways.argmax(1)
            best = scores[:, t] + ways.max(1)
        out = np.empty((B, T), np.int64)
        out[:, -1] = best.argmax(1)
        for t in range(T - 1, 0, -1):
            out[:, t - 1] = came[t][np.arange(B), out[:, t]]
        return out

    def loss(self, sym: np.ndarray, gold: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean negative log-likelihood of the tags by character, and its gradient."""
        kept: dict = {}
        scores = self.scores(sym, kept)
        (B, T, K), step = scores.shape, self.p["step"] + self.never
        ahead, behind, total = self._passes(scores)
        rows, at = np.arange(B)[:, None], np.arange(T)[None, :]
        told = scores[rows, at, gold].sum() + self.p["start"][gold[:, 0]].sum() + step[gold[:, :-1], gold[:, 1:]].sum()
        d = np.exp(ahead + behind - total[None, :, None]).transpose(1, 0, 2).astype(np.float32)
        d[rows, at, gold] -= 1
        d_step = np.zeros((K, K), np.float32)
        for t in range(1, T):
            pair = ahead[t - 1][:, :, None] + step + (scores[:, t] + behind[t])[:, None, :] - total[:, None, None]
            d_step += np.exp(pair).sum(0)
        np.subtract.at(d_step, (gold[:, :-1], gold[:, 1:]), 1)
        n = B * T
        g = self._back(d / n, kept)
        g["step"], g["start"] = d_step / n, d[:, 0].sum(0) / n
        return float(total.sum() - told) / n, g

    def fit(self, sym: np.ndarray, gold: np.ndarray, steps: int, batch: int = 64, rate: float = 0.05, seed: int = 42) -> Tagger:
        """Adam over shuffled batches, with a rate that falls to nothing."""
        rng = np.random.default_rng(seed)
        m, v = ({k: np.zeros_like(x) for k, x in self.p.items()} for _ in range(2))
        order = np.zeros(0, np.int64)
        for n in range(1, steps + 1):
            if len(order) < batch:
                order = np.concatenate([order, rng.permutation(len(sym))])
            pick, order = order[:batch], order[batch:]
            _, g = self.loss(sym[pick], gold[pick])
            size = np.sqrt(sum(float((x * x).sum()) for x in g.values()))
            now = rate * (1 - (n - 1) / steps)
            for k, x in self.p.items():
                one = g[k] * min(1.0, 1 / max(size, 1e-12))
                m[k] = 0.9 * m[k] + 0.1 * one
                v[k] = 0.99 * v[k] + 0.01 * one * one
                x -= (now * (m[k] / (1 - 0.9**n)) / (np.sqrt(v[k] / (1 - 0.99**n)) + 1e-8)).astype(np.float32)
        return self
