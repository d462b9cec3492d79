"""A character-level bidirectional LSTM with CRF transitions, in numpy.

Input signs come as small numbers; each direction keeps a table with the gate inputs of every sign, so that an input
costs a look-up. Both directions run in one loop over batches of windows of like length. The CRF's transitions join
the label scores; decode takes the best path. fit trains all of it by gradient descent (Adam) on labelled windows.
"""

from __future__ import annotations

import numpy as np

Params = dict[str, np.ndarray]


def new_params(signs: int, hidden: int, labels: int, seed: int = 1) -> Params:
    rng = np.random.default_rng(seed)
    p = {
        "X": rng.normal(0, 0.1, (2, signs, 4 * hidden)),
        "U": rng.normal(0, 1 / np.sqrt(hidden), (2, hidden, 4 * hidden)),
        "W": rng.normal(0, 0.1, (2 * hidden, labels)),
        "b": np.zeros(labels),
        "A": np.zeros((labels, labels)),
        "s": np.zeros(labels),
    }
    p["X"][:, :, hidden : 2 * hidden] += 0.5  # remember at first
    return {k: v.astype(np.float32) for k, v in p.items()}


def both_ways(sym: np.ndarray, lens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(T, 2, B) signs forward and backward, and the (B, T) place that undoes the backward order."""
    t = np.arange(sym.shape[1])
    back = np.where(t[None] < lens[:, None], lens[:, None] - 1 - t[None], t[None])
    return np.stack([sym.T, np.take_along_axis(sym, back, 1).T], 1), back


def _sigmoid(minus: np.ndarray) -> None:
    """1 / (1 + exp(x)) in place; much cheaper in numpy than a tanh."""
    np.exp(minus, out=minus)
    minus += 1
    np.reciprocal(minus, out=minus)


def run_states(p: Params, sym: np.ndarray, lens: np.ndarray, keep: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray, list]:
    """(T, 2, B, H) states, the backward ones in their own order; with keep also what the gradient needs.

    Gates lie in the order in, forget, out, new, each gate of all windows in one piece.
    """
    seq, back = both_ways(sym, lens)
    steps, _, n = seq.shape
    signs, hid, kind = p["X"].shape[1], p["U"].shape[1], p["U"].dtype
    scale = np.array([-1, -1, -1, -2], kind)[:, None]  # 1 / (1 + exp(-z)) is a gate, twice that of 2 z less 1 a tanh
    x = np.ascontiguousarray((p["X"].reshape(2, signs, 4, hid) * scale).transpose(2, 0, 1, 3)).reshape(4, 2 * signs, hid)
    u = np.ascontiguousarray((p["U"].reshape(2, hid, 4, hid) * scale).transpose(2, 0, 1, 3))
    at = (seq + np.array([0, signs])[None, :, None]).reshape(steps, 2 * n).astype(np.intp)
    h, c = np.zeros((2, n, hid), kind), np.zeros((2, n, hid), kind)
    hs = np.empty((steps, 2, n, hid), kind)
    g, inputs, new = np.empty((4, 2, n, hid), kind), np.empty((4, 2 * n, hid), kind), np.empty((2, n, hid), kind)
    kept = []
    with np.errstate(over="ignore"):
        for t in range(steps):
            if keep:
                g, before, old = np.empty_like(g), c.copy(), h.copy()
            np.matmul(h, u, out=g)
            x.take(at[t], 1, out=inputs, mode="clip")
            g += inputs.reshape(g.shape)
            _sigmoid(g)
            g[3] *= 2
            g[3] -= 1
            c *= g[1]
            np.multiply(g[0], g[3], out=new)
            c += new
            np.multiply(c, -2, out=h)
            _sigmoid(h)
            h *= 2
            h -= 1
            if keep:
                kept.append((g, before, h.copy(), old))
            h *= g[2]
            hs[t] = h
    return hs, seq, back, kept


def hidden_states(p: Params, sym: np.ndarray, lens: np.ndarray, keep: bool = False) -> tuple[np.ndarray, tuple]:
    """(T, B, 2H) states in text order, and what the gradient needs."""
    hs, seq, back, kept = run_states(p, sym, lens, keep)
    return np.concatenate([hs[:, 0], np.take_along_axis(hs[:, 1], back.T[:, :, None], 0)], 2), (seq, back, kept)


def label_scores(p: Params, sym: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """(T, K, B) scores; the backward half is put in text order only after it is as narrow as the labels."""
    hs, _, back, _ = run_states(p, sym, lens)
    hid = p["U"].shape[1]
    forward, backward = hs[:, 0] @ p["W"][:hid] + p["b"], hs[:, 1] @ p["W"][hid:]
    steps, n, _ = forward.shape
    forward += backward.reshape(steps * n, -1).take(back.T * n + np.arange(n), 0)
    return np.ascontiguousarray(forward.transpose(0, 2, 1))


def decode(p: Params, sym: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """(B, T) labels of the best paths."""
    e = label_scores(p, sym, lens)
    search = np.flatnonzero(_may_leave_zero(p, e, lens))
    out = np.zeros((e.shape[2], e.shape[0]), np.int8)
    if len(search):
        out[search] = _best_paths(p, e[:, :, search], lens[search])
    return out


def _may_leave_zero(p: Params, e: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """Whether any run of signs off label 0 could make up for the ways in and out of it; else all are label 0.

    A run gains at most the sum of its signs' best scores over label 0, each with the best stay, and what the best way
    in (or start) and the best way out cost, the last of which it saves at the end. The greatest sums of runs anywhere,
    from the start and to the end are found in one pass.
    """
    t, s = p["A"] - p["A"][0, 0], p["s"] - p["s"][0]
    gain = e[:, 1:].max(1) - e[:, 0] + max(0.0, float(t[1:, 1:].max()))
    way_in, way_out, start = float(t[0, 1:].max()), float(t[1:, 0].max()), float(s[1:].max())
    n = len(lens)
    run, best = np.full(n, -np.inf, np.float32), np.full(n, -np.inf, np.float32)
    prefix, most = np.zeros(n, np.float32), np.full(n, -np.inf, np.float32)
    may = np.zeros(n, bool)
    for i in range(len(gain)):
        run = np.maximum(run, 0) + gain[i]
        prefix = prefix + gain[i]
        inside = i < lens
        best = np.where(inside, np.maximum(best, run), best)
        most = np.where(inside, np.maximum(most, prefix), most)
        at_end = lens == i + 1
        if at_end.any():
            may |= at_end & ((run + way_in >= 0) | (prefix + start >= 0))
    return may | (best + way_in + way_out >= 0) | (most + start + way_out >= 0)


def _best_paths(p: Params, e: np.ndarray, lens: np.ndarray) -> np.ndarray:
    steps, _, n = e.shape
    score = e[0] + p["s"][:, None]
    ways = np.empty(e.shape, np.int8)
    step = p["A"][:, :, None]
    final = np.where(lens == 1, score, 0)
    for t in range(1, steps):
        s = score[:, None] + step
        ways[t] = s.argmax(0)
        score = s.max(0) + e[t]
        ends = lens == t + 1
        if ends.any():
            final[:, ends] = score[:, ends]
    out = np.zeros((n, steps), np.int8)
    at = final.argmax(0)
    rows = np.arange(n)
    for t in range(steps - 1, -1, -1):
        inside = t < lens
        out[inside, t] = at[inside]
        if t:
            at = np.where(inside, ways[t][at, rows], at)
    return out


def _lse(x: np.ndarray, axis: int) -> np.ndarray:
    m = x.max(axis, keepdims=True)
    return np.log(np.exp(x - m).sum(axis)) + np.squeeze(m, axis)


def gradients(p: Params, sym: np.ndarray, lens: np.ndarray, gold: np.ndarray) -> tuple[float, Params]:
    """Mean negative log-likelihood of the gold paths, and its gradient."""
    states, (seq, back, kept) = hidden_states(p, sym, lens, keep=True)
    e = (states @ p["W"] + p["b"]).astype(np.float64)
    a, start = p["A"].astype(np.float64), p["s"].astype(np.float64)
    steps, n, k = e.shape
    y, rows = gold.T, np.arange(n)
    mask = np.arange(steps)[:, None] < lens[None]
    alpha, beta = np.empty_like(e), np.zeros_like(e)
    alpha[0] = e[0] + start
    for t in range(1, steps):
        alpha[t] = np.where(mask[t][:, None], _lse(alpha[t - 1][:, :, None] + a[None], 1) + e[t], alpha[t - 1])
    for t in range(steps - 2, -1, -1):
        beta[t] = np.where(mask[t + 1][:, None], _lse(a[None] + (e[t + 1] + beta[t + 1])[:, None, :], 2), beta[t + 1])
    z = _lse(alpha[-1], 1)
    marg = np.exp(alpha + beta - z[None, :, None]) * mask[:, :, None]
    gold_score = start[y[0]] + e[0][rows, y[0]]
    de, da, ds = marg.copy(), np.zeros_like(a), marg[0].sum(0)
    de[0][rows, y[0]] -= 1
    np.subtract.at(ds, y[0], 1)
    for t in range(1, steps):
        m = mask[t]
        gold_score = gold_score + np.where(m, a[y[t - 1], y[t]] + e[t][rows, y[t]], 0)
        de[t][rows[m], y[t][m]] -= 1
        pair = np.exp(alpha[t - 1][:, :, None] + a[None] + (e[t] + beta[t])[:, None, :] - z[:, None, None])
        da += pair[m].sum(0)
        np.subtract.at(da, (y[t - 1][m], y[t][m]), 1)
    de = (de / n).astype(np.float32)
    grads = {"A": (da / n).astype(np.float32), "s": (ds / n).astype(np.float32), "W": np.einsum("tbh,tbk->hk", states, de), "b": de.sum((0, 1))}
    dout = de @ p["W"].T
    hid = p["U"].shape[1]
    dh_all = np.empty((steps, 2, n, hid), np.float32)
    dh_all[:, 0] = dout[:, :, :hid]
    dh_all[:, 1] = np.take_along_axis(dout[:, :, hid:], back.T[:, :, None], 0)
    gx, gu = np.zeros_like(p["X"]), np.zeros_like(p["U"])
    dh, dc = np.zeros((2, n, hid), np.float32), np.zeros((2, n, hid), np.float32)
    ut = p["U"].transpose(0, 2, 1)
    for t in range(steps - 1, -1, -1):
        g, before, tc, hb = kept[t]
        i, f, o, new = g
        dh = dh + dh_all[t]
        dc = dc + dh * o * (1 - tc * tc)
        dg = np.concatenate([dc * new * i * (1 - i), dc * before * f * (1 - f), dh * tc * o * (1 - o), dc * i * (1 - new * new)], 2)
        dc = dc * f
        for w in (0, 1):
            np.add.at(gx[w], seq[t, w], dg[w])
        gu += np.matmul(hb.transpose(0, 2, 1), dg)
        dh = np.matmul(dg, ut)
    return float((z - gold_score).mean()), grads | {"X": gx, "U": gu}


def padded(rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    lens = np.array([len(r) for r in rows])
    out = np.zeros((len(rows), lens.max()), rows[0].dtype)
    for i, r in enumerate(rows):
        out[i, : len(r)] = r
    return out, lens


def fit(p: Params, data: list[tuple[np.ndarray, np.ndarray]], epochs: int, batch: int = 48, rate: float = 0.01, seed: int = 3, say=print) -> Params:
    rng = np.random.default_rng(seed)
    m, v = ({k: np.zeros_like(x) for k, x in p.items()} for _ in range(2))
    order = sorted(range(len(data)), key=lambda i: len(data[i][0]))
    groups = [order[i : i + batch] for i in range(0, len(order), batch)]
    step, total = 0, epochs * len(groups)
    for epoch in range(epochs):
        loss = 0.0
        for g in rng.permutation(len(groups)):
            sym, lens = padded([data[i][0] for i in groups[g]])
            gold, _ = padded([data[i][1] for i in groups[g]])
            value, grads = gradients(p, sym, lens, gold)
            loss += value
            step += 1
            norm = np.sqrt(sum(float((x * x).sum()) for x in grads.values()))
            lr = rate * (1 - step / (total + 1)) * min(1.0, step / 50)
            for k, x in grads.items():
                x = x * min(1.0, 5 / (norm + 1e-9))
                m[k] = 0.9 * m[k] + 0.1 * x
                v[k] = 0.999 * v[k] + 0.001 * x * x
                p[k] -= (lr * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
        say(f"epoch {epoch + 1}: loss {loss / len(groups):.4f}")
    return p
