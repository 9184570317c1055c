"""A character-level bidirectional LSTM with CRF transitions, in numpy.

``Tagger.fit`` minimises the CRF's negative log-likelihood by Adam over
batches of equal-length windows; ``Tagger.decode`` gives the best tag path
(Viterbi) and each position's marginal probability of its tag. Everything is
seeded, so equal windows give equal weights.
"""

from __future__ import annotations

import numpy as np

# printable ASCII has symbols of its own; other letters, other characters and padding share one each
OTHER_LETTER, OTHER, PAD = 96, 97, 98
SYMBOLS = 99


def symbols(text: str, length: int) -> np.ndarray:
    out = np.full(length, PAD, np.int64)
    for i, c in enumerate(text[:length]):
        k = ord(c) - 32
        out[i] = k if 0 <= k < 96 else OTHER_LETTER if c.isalpha() else OTHER
    return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1.0 + np.tanh(0.5 * x))


def _run(x: np.ndarray, w: np.ndarray, u: np.ndarray, b: np.ndarray):
    """LSTM over (steps, rows, inputs) -> hidden states and what backward needs."""
    steps, rows, _ = x.shape
    hid = u.shape[0]
    h, c = np.zeros((rows, hid), x.dtype), np.zeros((rows, hid), x.dtype)
    zx = x @ w + b
    hs, keep = np.empty((steps, rows, hid), x.dtype), []
    for t in range(steps):
        z = zx[t] + h @ u
        gates = _sigmoid(z[:, :3 * hid])
        i, f, o = gates[:, :hid], gates[:, hid:2 * hid], gates[:, 2 * hid:]
        g = np.tanh(z[:, 3 * hid:])
        before, h_before = c, h
        c = f * c + i * g
        th = np.tanh(c)
        h = o * th
        hs[t] = h
        keep.append((i, f, o, g, before, th, h_before))
    return hs, keep


def _back(dh: np.ndarray, keep: list, x: np.ndarray, w: np.ndarray, u: np.ndarray):
    """Gradients (dx, dw, du, db) of ``_run``."""
    hid = u.shape[0]
    dz = np.empty((len(dh), dh.shape[1], 4 * hid), dh.dtype)
    dc, carry = 0.0, 0.0
    du = np.zeros_like(u)
    for t in range(len(dh) - 1, -1, -1):
        i, f, o, g, before, th, h_before = keep[t]
        d = dh[t] + carry
        dc = dc + d * o * (1 - th * th)
        dz[t, :, :hid] = dc * g * i * (1 - i)
        dz[t, :, hid:2 * hid] = dc * before * f * (1 - f)
        dz[t, :, 2 * hid:3 * hid] = d * th * o * (1 - o)
        dz[t, :, 3 * hid:] = dc * i * (1 - g * g)
        du += h_before.T @ dz[t]
        carry = dz[t] @ u.T
        dc = dc * f
    flat = dz.reshape(-1, 4 * hid)
    return dz @ w.T, x.reshape(-1, x.shape[2]).T @ flat, du, flat.sum(axis=0)


def _lse(x: np.ndarray, axis: int) -> np.ndarray:
    m = x.max(axis=axis, keepdims=True)
    return (m + np.log(np.exp(x - m).sum(axis=axis, keepdims=True))).squeeze(axis)


class Tagger:
    def __init__(self, tags: int, embed: int = 12, hidden: int = 20, seed: int = 1):
        rng = np.random.default_rng(seed)
        init = lambda *s: (rng.standard_normal(s) / np.sqrt(s[0])).astype(np.float32)
        p = {"emb": rng.standard_normal((SYMBOLS, embed)).astype(np.float32) * 0.3}
        for d in "fb":
            p["w" + d], p["u" + d] = init(embed, 4 * hidden), init(hidden, 4 * hidden)
            p["b" + d] = np.zeros(4 * hidden, np.float32)
            p["b" + d][hidden:2 * hidden] = 1.0  # forget gates start open
        p["out"], p["bias"] = init(2 * hidden, tags), np.zeros(tags, np.float32)
        p["trans"], p["start"] = np.zeros((tags, tags), np.float32), np.zeros(tags, np.float32)
        self.p = p

    def _scores(self, x: np.ndarray):
        """(rows, steps) symbols -> (steps, rows, tags) scores."""
        p = self.p
        e = p["emb"][x.T]
        hf, kf = _run(e, p["wf"], p["uf"], p["bf"])
        hb, kb = _run(e[::-1], p["wb"], p["ub"], p["bb"])
        both = np.concatenate([hf, hb[::-1]], axis=2)
        return both @ p["out"] + p["bias"], (e, kf, kb, both)

    def _marginals(self, s: np.ndarray):
        """Forward-backward: log Z, node marginals (steps, rows, tags), summed pair marginals."""
        trans = self.p["trans"]
        a = np.empty_like(s)
        a[0] = s[0] + self.p["start"]
        for t in range(1, len(s)):
            a[t] = s[t] + _lse(a[t - 1][:, :, None] + trans, 1)
        z = _lse(a[-1], 1)
        b = np.zeros_like(s)
        pairs = np.zeros_like(trans)
        for t in range(len(s) - 2, -1, -1):
            nxt = trans + (s[t + 1] + b[t + 1])[:, None, :]
            b[t] = _lse(nxt, 2)
            pairs += np.exp(a[t][:, :, None] + nxt - z[:, None, None]).sum(axis=0)
        return z, np.exp(a + b - z[:, None]), pairs

    def _gradients(self, x: np.ndarray, y: np.ndarray) -> dict:
        p, rows = self.p, len(x)
        s, (e, kf, kb, both) = self._scores(x)
        _, node, pairs = self._marginals(s)
        gold = np.zeros_like(s)
        steps = np.arange(x.shape[1])[:, None]
        gold[steps, np.arange(rows)[None, :], y.T] = 1
        seen = np.zeros_like(pairs)
        np.add.at(seen, (y[:, :-1].ravel(), y[:, 1:].ravel()), 1)
        ds = (node - gold) / rows
        d = ds @ p["out"].T
        hid = p["uf"].shape[0]
        dxf, dwf, duf, dbf = _back(d[:, :, :hid], kf, e, p["wf"], p["uf"])
        dxb, dwb, dub, dbb = _back(d[::-1, :, hid:], kb, e[::-1], p["wb"], p["ub"])
        demb = np.zeros_like(p["emb"])
        np.add.at(demb, x.T, dxf + dxb[::-1])
        return {"emb": demb, "wf": dwf, "uf": duf, "bf": dbf, "wb": dwb, "ub": dub, "bb": dbb,
                "out": both.reshape(-1, 2 * hid).T @ ds.reshape(-1, ds.shape[2]), "bias": ds.sum((0, 1)),
                "trans": (pairs - seen) / rows, "start": ds[0].sum(0)}

    def fit(self, x: np.ndarray, y: np.ndarray, epochs: int = 12, batch: int = 32, rate: float = 0.01,
            seed: int = 1) -> Tagger:
        rng = np.random.default_rng(seed)
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        v2 = {k: np.zeros_like(v) for k, v in self.p.items()}
        step, total = 0, max(1, epochs * -(-len(x) // batch))
        for _ in range(epochs):
            order = rng.permutation(len(x))
            for lo in range(0, len(x), batch):
                at = order[lo:lo + batch]
                g = self._gradients(x[at], y[at])
                step += 1
                norm = np.sqrt(sum(float((a * a).sum()) for a in g.values()))
                scale = min(1.0, 5.0 / (norm + 1e-9))
                now = rate * (1 - 0.9 * step / total)
                for k, a in g.items():
                    a = a * np.float32(scale)
                    m[k] = 0.9 * m[k] + 0.1 * a
                    v2[k] = 0.999 * v2[k] + 0.001 * a * a
                    self.p[k] = (self.p[k] - now * (m[k] / (1 - 0.9 ** step))
                                 / (np.sqrt(v2[k] / (1 - 0.999 ** step)) + 1e-8)).astype(np.float32)
        return self

    def decode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rows, steps) symbols -> best tags and their marginals, same shape."""
        s, _ = self._scores(x)
        trans, rows = self.p["trans"], np.arange(len(x))
        best, frm = s[0] + self.p["start"], np.empty(s.shape, np.int64)
        for t in range(1, len(s)):
            every = best[:, :, None] + trans
            frm[t] = every.argmax(axis=1)
            best = s[t] + every.max(axis=1)
        tags = np.empty(x.T.shape, np.int64)
        tags[-1] = best.argmax(axis=1)
        for t in range(len(s) - 1, 0, -1):
            tags[t - 1] = frm[t][rows, tags[t]]
        node = self._marginals(s)[1]
        sure = node[np.arange(len(s))[:, None], rows[None, :], tags]
        return tags.T, sure.T
