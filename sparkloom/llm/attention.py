"""A small causal self-attention language model in numpy.

Every id of the vocabulary is an input with rows of its own.  A window has ``2 * STEP``
inputs; its last ``STEP`` positions are scored, the ones before only give context, so
overlapping windows score every token once.  One head attends with learned distance
biases; its output and the current id's own row make the hidden state.  Three softmaxes
predict the next id: the class, the symbol within the class (the ``SYMBOLS - 1`` most
frequent ids, and one for all others), and for those others a class of ``TAIL`` ids and
the id in it, which cost only where they occur.  The prediction is mixed with a smoothed
table of symbol pairs counted over all training text.
"""

from __future__ import annotations

import numpy as np

SYMBOLS, CLASSES, STEP = 1024, 16, 16
MEMBERS = SYMBOLS // CLASSES
#: Rarer ids in a class of their own softmax.
TAIL = 224
DIM, HIDDEN = 16, 32
#: An input or target that is not there, in windows of ids.
NONE = 65_535
#: Where a sum of exponentials leaves these bounds, each row's largest logit is taken from it first.
LEAST_SUM, MOST_SUM = 1e-26, 1e26
#: Training: windows of a step unless given, rate, seed.  Bins of log(network / pairs), and
#: their range.
BATCH, RATE, SEED, BINS, SPAN = 256, 0.03, 20240617, 4096, 20.0


def arranged(pairs: np.ndarray) -> np.ndarray:
    """An order of the symbols in which similar ones stand together, so that each run of
    ``MEMBERS`` is a class: halves along the main direction of their predecessors."""
    x = np.sqrt(pairs / np.maximum(pairs.sum(axis=0), 1)).T.astype(np.float64)

    def halves(items: np.ndarray) -> list[int]:
        if len(items) <= MEMBERS:
            return items.tolist()
        y = x[items] - x[items].mean(axis=0)
        v = np.linspace(-1, 1, y.shape[1]) + 0.01
        for _ in range(20):
            v = y.T @ (y @ v)
            v /= np.linalg.norm(v) or 1.0
        order = items[np.argsort(y @ v, kind="stable")]
        return halves(order[: len(order) // 2]) + halves(order[len(order) // 2 :])

    return np.array(halves(np.arange(SYMBOLS)))


def smoothed(pairs: np.ndarray) -> np.ndarray:
    """Probability of each symbol after each, backed off to single symbols by the number
    of distinct followers."""
    single = pairs.sum(axis=0) + 0.5
    single = single / single.sum()
    total, kinds = pairs.sum(axis=1, keepdims=True), (pairs > 0).sum(axis=1, keepdims=True) + 0.5
    return ((pairs + kinds * single) / (total + kinds)).astype(np.float32)


def symbols(counts: np.ndarray) -> np.ndarray:
    """Each id's symbol: its rank by count if among the first, else ``SYMBOLS - 1``."""
    found = np.full(len(counts), SYMBOLS - 1, np.int64)
    found[np.argsort(-counts, kind="stable")[: SYMBOLS - 1]] = np.arange(min(SYMBOLS - 1, len(counts)))
    return found


def _added(at: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
    """Sums of rows by their number; the last row, which has none, is zeros.  Rows of a number
    are added four at a time, all numbers at once (which is faster than ``np.add.at``)."""
    order = np.argsort(at.astype(np.uint16) if n <= 65_536 else at, kind="stable")
    sizes = np.bincount(at, minlength=n)
    fours = (sizes + 3) >> 2
    first = np.cumsum(fours) - fours
    place = np.full(int(fours.sum()) * 4, len(at))
    place[np.arange(len(at)) + np.repeat(first * 4 - (np.cumsum(sizes) - sizes), sizes)] = order
    a, b, c, d = rows.take(place.reshape(-1, 4).T, axis=0)
    a += b
    c += d
    a += c
    some, sums = np.flatnonzero(sizes), np.zeros((n, rows.shape[1]), rows.dtype)
    sums[some] = np.add.reduceat(a, first.take(some), axis=0)
    return sums


def _with_ones(x: np.ndarray) -> np.ndarray:
    """``x`` and a column of ones: a product by weights over their bias then adds the bias,
    and one by its transpose gives the bias's gradient."""
    out = np.empty((len(x), x.shape[1] + 1), x.dtype)
    out[:, :-1] = x
    out[:, -1] = 1
    return out


def _within(sums: np.ndarray) -> bool:
    return not sums.size or bool(sums.max() < MOST_SUM and sums.min() > LEAST_SUM)


def _exponentials(x: np.ndarray, w: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the logits ``x @ w``: their exponentials, the logits ``at`` (places in the flattened
    array) and each row's sum of exponentials; all less the rows' largest logits if a sum is out
    of bounds, which no share or log probability shows."""
    logit = x @ w
    picked, ones = logit.take(at), np.ones(w.shape[1], w.dtype)
    with np.errstate(over="ignore"):
        total = np.exp(logit, out=logit) @ ones  # products sum short rows faster
    if not _within(total):
        logit = x @ w
        logit -= logit.max(axis=1, keepdims=True)
        picked = logit.take(at)
        total = np.exp(logit, out=logit) @ ones
    return logit, picked, total


class Model:
    """``p`` holds the weights.  Ids are renumbered as codes: frequent ones by class, then
    the others by count, then ``pad``; ``rare`` is the code of the symbol for the others."""

    def __init__(self, counts: np.ndarray, pairs: np.ndarray) -> None:
        """``counts`` of each id and ``pairs`` of symbols, over all training text."""
        symbol, place = symbols(counts), np.empty(SYMBOLS, np.int64)
        place[arranged(pairs)] = np.arange(SYMBOLS)
        self.rare = int(place[SYMBOLS - 1])
        others = np.flatnonzero(symbol == SYMBOLS - 1)
        others = others[np.argsort(-counts[others], kind="stable")]
        self.pad = SYMBOLS + len(others)
        self.code = np.full(NONE + 1, self.pad, np.int32)
        self.code[: len(counts)] = place[symbol]
        self.code[others] = SYMBOLS + np.arange(len(others))
        back = np.argsort(place)
        pairs = pairs[np.ix_(back, back)].astype(np.float64)
        self.table = smoothed(pairs)
        groups = max(1, -(-len(others) // TAIL))
        tail = np.zeros(groups * TAIL)
        tail[: len(others)] = counts[others] + 0.05
        self.tail = (tail / max(tail.sum(), 1e-300)).astype(np.float32)  # of each other id among them
        tail = np.maximum(tail, 1e-9).reshape(groups, TAIL)
        rng = np.random.default_rng(SEED)

        def normal(*shape: int, scale: float) -> np.ndarray:
            return (rng.standard_normal(shape) * scale).astype(np.float32)

        def logs(x: np.ndarray) -> np.ndarray:
            return np.log(x / x.sum(axis=-1, keepdims=True)).astype(np.float32)

        single = (pairs.sum(axis=0) + 0.5).reshape(CLASSES, MEMBERS)
        self.p = {
            "E": normal(self.pad + 1, DIM, scale=0.3), "D": normal(self.pad + 1, HIDDEN, scale=0.3),
            "Q": normal(DIM, DIM, scale=0.25), "K": normal(DIM, DIM, scale=0.25), "V": normal(DIM, DIM, scale=0.25),
            "far": np.linspace(0, -1, 2 * STEP, dtype=np.float32), "O": normal(DIM, HIDDEN, scale=0.25), "h": np.full(HIDDEN, 0.1, np.float32),
            "C": normal(HIDDEN, CLASSES, scale=0.1), "c": logs(single.sum(axis=1)), "M": normal(CLASSES, HIDDEN, MEMBERS, scale=0.1), "m": logs(single),
            "G": np.zeros((HIDDEN, groups), np.float32), "g": logs(tail.sum(axis=1)), "T": np.zeros((groups, HIDDEN, TAIL), np.float32), "t": logs(tail),
        }
        self.gate = 0.5
        i, j = np.arange(STEP)[:, None] + STEP, np.arange(2 * STEP)
        self.distance, self.ahead = np.maximum(i - j, 0), (j > i)
        self.tables()

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k not in ("q", "k", "v")}  # follow from the weights

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        self.tables()

    #: Weights that belong to single inputs, and those that belong to single classes of the
    #: third softmax: only the rows that a step touches are changed.
    BY_INPUT, BY_GROUP = ("E", "D"), ("T", "t")

    def tables(self) -> None:
        """What depends on an input alone, looked up instead of multiplied for each token scored."""
        p = self.p
        self.q, self.k, self.v = p["E"] @ p["Q"] / np.float32(DIM**0.5), p["E"] @ p["K"], p["E"] @ p["V"]
        self.bias = self._bias()

    def _bias(self) -> np.ndarray:
        return np.where(self.ahead, np.float32(-1e9), self.p["far"][self.distance]).astype(np.float32)

    def _weights(self, query: np.ndarray, key: np.ndarray, bias: np.ndarray, x: np.ndarray, less: bool = False) -> np.ndarray:
        """Attention weights of windows ``x`` times each position's sum of them."""
        weight = np.matmul(query, key.transpose(0, 2, 1))
        weight += bias
        missing = (x == self.pad).nonzero()
        if len(missing[0]):
            weight[missing[0], :, missing[1]] = -1e9
        if less:
            weight -= weight.max(axis=2, keepdims=True)
        with np.errstate(over="ignore"):
            return np.exp(weight, out=weight)

    def _attended(self, query: np.ndarray, key: np.ndarray, value: np.ndarray, bias: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``_weights`` and their products with ``value``, whose last column is ones, so that the
        product's are the sums; less the rows' largest scores if a sum is out of bounds."""
        weight = self._weights(query, key, bias, x)
        with np.errstate(invalid="ignore", over="ignore"):
            out = np.matmul(weight, value)
        if not _within(out[..., DIM]):
            weight = self._weights(query, key, bias, x, less=True)
            out = np.matmul(weight, value)
        return weight, out

    def _states(self, x: np.ndarray) -> np.ndarray:
        """Hidden states of windows ``x`` as ``_hidden`` gives them, without what training needs."""
        out = self._attended(self.q.take(x[:, STEP:], axis=0), self.k.take(x, axis=0), self.ones.take(x, axis=0), self.bias, x)[1].reshape(-1, DIM + 1)
        h = (out[:, :DIM] / out[:, DIM:]) @ self.p["O"]
        h += self.start.take(x[:, STEP:].ravel(), axis=0)
        return np.maximum(h, 0, out=h)

    def _hidden(self, x: np.ndarray):
        """Windows ``x`` of inputs: the distinct ones, the place of each among them, queries, keys,
        values and ones, weights times their sums, these sums' inverses, the head's output and
        hidden states.  Products are by distinct input."""
        p, seen = self.p, np.zeros(self.pad + 1, bool)
        seen[x.ravel()] = True
        rows = np.flatnonzero(seen)
        local = np.empty(self.pad + 1, np.intp)
        local[rows] = np.arange(len(rows))
        at, e = local.take(x), p["E"].take(rows, axis=0)
        now = at[:, STEP:]
        query, key, value = (e @ p["Q"] / np.float32(DIM**0.5)).take(now, axis=0), (e @ p["K"]).take(at, axis=0), _with_ones(e @ p["V"]).take(at, axis=0)  # faster than indexing
        weight, out = self._attended(query, key, value, self._bias(), x)
        inverse = 1 / out.reshape(-1, DIM + 1)[:, DIM:]
        out = out.reshape(-1, DIM + 1)[:, :DIM] * inverse
        h = out @ p["O"]
        h += (p["D"].take(rows, axis=0) + p["h"]).take(now.ravel(), axis=0)
        return rows, at, query, key, value, weight, inverse, out, np.maximum(h, 0, out=h)

    def _softmax(self, h, y, top: tuple[str, str], low: tuple[str, str], width: int, grads: dict | None, out_h: np.ndarray | None):
        """Log probability of each target by class and member, of hidden states with their ones
        (``_with_ones``); ``out_h`` takes the gradients of the hidden state, ``grads`` those of
        the weights (members by class)."""
        group, rows = y // width, np.arange(len(y))
        weights = np.concatenate([self.p[top[0]], self.p[top[1]][None]])
        classes = weights.shape[1]
        flat = rows * classes + group
        share, picked, total = _exponentials(h, weights, flat)
        out = picked - np.log(total)
        if grads is not None:
            share *= (1 / total)[:, None]
            share.reshape(-1)[flat] -= 1
            both = h.T @ share
            grads[top[0]], grads[top[1]] = both[:-1], both[-1]
            np.matmul(share, self.p[top[0]].T, out=out_h)
            own = grads[low[0]], grads[low[1]] = {}, {}
        order = np.argsort(group.astype(np.uint8 if classes < 256 else np.int32), kind="stable")
        sorted_h, flat = h.take(order, axis=0), (y - group * width).take(order)
        below, back = np.empty(len(y), out.dtype), None if grads is None else np.empty((len(h), h.shape[1] - 1), h.dtype)
        ends = np.searchsorted(group.take(order), np.arange(classes + 1))
        some = np.flatnonzero(np.diff(ends))
        members = np.concatenate([self.p[low[0]].take(some, axis=0), self.p[low[1]].take(some, axis=0)[:, None]], axis=1)
        for c, weights in zip(some.tolist(), members):
            part = slice(ends[c], ends[c + 1])
            hc = sorted_h[part]
            own_flat = rows[: len(hc)] * width + flat[part]
            share, picked, total = _exponentials(hc, weights, own_flat)
            below[part] = picked - np.log(total)
            if grads is not None:
                share *= (1 / total)[:, None]
                share.reshape(-1)[own_flat] -= 1
                both = hc.T @ share
                own[0][c], own[1][c] = both[:-1], both[-1]
                np.matmul(share, weights[:-1].T, out=back[part])
        back_to = np.empty_like(order)
        back_to[order] = rows
        out += below.take(back_to)
        if grads is not None:
            out_h += back.take(back_to, axis=0)
        return out

    def _head(self, h: np.ndarray, y: np.ndarray, grads=None, out_h=None) -> np.ndarray:
        """Log probability of each target's symbol (``y``: codes below ``SYMBOLS``)."""
        return self._softmax(h, y, ("C", "c"), ("M", "m"), MEMBERS, grads, out_h)

    def _other(self, h: np.ndarray, y: np.ndarray, grads=None, out_h=None) -> np.ndarray:
        """Log probability of each of the other ids (``y``: their codes less ``SYMBOLS``)."""
        return self._softmax(h, y, ("G", "g"), ("T", "t"), TAIL, grads, out_h)

    def _learned(self, x: np.ndarray, y: np.ndarray):
        """Windows of codes: log probability of each target that counts, that of the pair
        table, and gradients of their mean loss; rows of inputs and classes as (rows, values)."""
        p, g = self.p, {}
        rows, at, query, key, value, weight, inverse, out, h = self._hidden(x)
        target, live = y.ravel(), np.flatnonzero(y.ravel() != self.pad)
        code, hl = target.take(live), _with_ones(h.take(live, axis=0))
        symbol, others = np.where(code < SYMBOLS, code, self.rare), np.flatnonzero(code >= SYMBOLS)
        dl = np.empty((len(live), HIDDEN), h.dtype)
        logp = self._head(hl, symbol, g, dl)
        before = x[:, STEP:].ravel()[live]
        pair = np.log(self.table[np.where(before < SYMBOLS, before, self.rare), symbol])
        if len(others):
            some = np.empty((len(others), HIDDEN), h.dtype)
            logp[others] += self._other(hl[others], code[others] - SYMBOLS, g, some)
            pair[others] += np.log(self.tail[code[others] - SYMBOLS])
            dl[others] += some
        n = max(1, len(live))
        for low in ("M", "m"):
            dense = np.zeros_like(p[low])
            for c, v in g[low].items():
                dense[c] = v
            g[low] = dense
        dh = np.zeros_like(h)
        dh[live] = dl
        dh *= h > 0
        g["h"], g["O"] = np.ones(len(h), h.dtype) @ dh, out.T @ dh
        # Beside the output's gradients by the sums of weights, less their products with the output:
        # its product with values and ones is each weight's gradient by the sums.
        dout = np.empty((len(h), DIM + 1), h.dtype)
        np.matmul(dh, p["O"].T, out=dout[:, :DIM])
        dout[:, DIM] = (dout[:, :DIM] * out) @ np.full(DIM, -1, h.dtype)
        dout *= inverse
        dout = dout.reshape(*y.shape, -1)
        dscore = np.matmul(dout, value.transpose(0, 2, 1))
        dscore *= weight
        g["far"] = np.bincount(self.distance.ravel(), dscore.sum(axis=0).ravel(), 2 * STEP).astype(np.float32)
        near, asks = (np.empty((m + 1, w), h.dtype) for m, w in ((x.size, 2 * DIM), (target.size, DIM + HIDDEN)))
        near[-1] = asks[-1] = 0
        by_key, by_query = near[:-1].reshape(*x.shape, -1), asks[:-1].reshape(*y.shape, -1)
        np.matmul(dscore.transpose(0, 2, 1), query, out=by_key[:, :, :DIM])
        np.matmul(weight.transpose(0, 2, 1), dout[:, :, :DIM], out=by_key[:, :, DIM:])
        np.matmul(dscore, key, out=by_query[:, :, :DIM])
        asks[:-1, DIM:] = dh
        near, asks = _added(at.ravel(), near, len(rows)), _added(at[:, STEP:].ravel(), asks, len(rows))
        e, dk, dvalue, dq = p["E"].take(rows, axis=0), near[:, :DIM], near[:, DIM:], asks[:, :DIM] * np.float32(DIM**-0.5)
        g["Q"], g["K"], g["V"] = e.T @ dq, e.T @ dk, e.T @ dvalue
        g["E"], g["D"] = (rows, (dk @ p["K"].T + dvalue @ p["V"].T + dq @ p["Q"].T) / n), (rows, asks[:, DIM:] / n)
        groups = np.array(sorted(g.get("T", ())), np.int64)
        for low in self.BY_GROUP:
            found = g.pop(low, {})
            if len(groups):
                g[low] = groups, np.stack([found[c] for c in groups.tolist()]) / n
        return logp, pair, {k: v if isinstance(v, tuple) else v / n for k, v in g.items()}

    def gradients(self, x: np.ndarray, y: np.ndarray) -> tuple[float, dict]:
        """Mean log loss of windows and its gradients, all as full arrays."""
        logp, _, g = self._learned(x, y)
        full = {k: np.zeros_like(v) for k, v in self.p.items()}
        for k, v in g.items():
            if isinstance(v, tuple):
                full[k][v[0]] = v[1]
            else:
                full[k] = v
        return -float(logp.sum()) / max(1, len(logp)), full

    def train(self, windows: np.ndarray, begin: float = 0.0, end: float = 1.0, passes: int = 1, batch: int = 0) -> np.ndarray:
        """Adam over windows of ids, in their order, ``batch`` (else ``BATCH``) a step; ``begin``
        and ``end`` say which part of the whole training this is, from which the rate follows.  Gives how many targets fall
        into each bin of log(network / pairs), every one predicted before the step it is in."""
        one, two = ({k: np.zeros_like(v) for k, v in self.p.items()} for _ in range(2))
        batch = batch or BATCH
        bins, each = np.zeros(BINS, np.int64), -(-len(windows) // batch)
        steps = passes * each
        for t in range(1, steps + 1):
            at = (t - 1) % each * batch
            part = self.code[windows[at : at + batch]]
            logp, pair, g = self._learned(part[:, : 2 * STEP], part[:, 2 * STEP :])
            if t > steps - each:
                bins += np.bincount(np.clip((logp - pair + SPAN) * (BINS / (2 * SPAN)), 0, BINS - 1).astype(np.int64), minlength=BINS)
            rate = RATE * (1 - 0.95 * (begin + (end - begin) * t / steps)) * min(1, t / 50)
            for k, v in g.items():
                rows, v = v if isinstance(v, tuple) else (slice(None), v)
                a, b = one[k][rows], two[k][rows]
                step = v - a
                step *= 0.1
                a += step
                np.multiply(v, v, out=step)
                step -= b
                step *= 0.01
                b += step
                if not isinstance(rows, slice):
                    one[k][rows], two[k][rows] = a, b
                np.multiply(b, 1 / (1 - 0.99**t), out=step)
                np.sqrt(step, out=step)
                step += 1e-8
                np.divide(a, step, out=step)
                step *= rate / (1 - 0.9**t)
                self.p[k][rows] -= step
        self.tables()
        return bins

    def weigh(self, bins: np.ndarray) -> None:
        """Sets the share of the network by expectation maximisation on counts of ``train``."""
        ratio = np.exp((np.arange(BINS) + 0.5) * (2 * SPAN / BINS) - SPAN)
        for _ in range(30):
            self.gate = float((bins * (self.gate * ratio / (self.gate * ratio + 1 - self.gate))).sum() / max(1, bins.sum()))
        self.gate = min(0.99, max(0.01, self.gate))

    def log10(self, streams: list[np.ndarray], at_once: int = 1024) -> list[np.ndarray]:
        """log10 probability of every id of each stream but the first, which is given."""
        self.ones = _with_ones(self.v)
        self.start = self.p["D"] + self.p["h"]
        sizes = np.array([len(s) - 1 for s in streams], np.int64)
        flat = self.code[np.concatenate(streams)].astype(np.uint16) if streams else np.empty(0, np.uint16)
        begins = np.cumsum(sizes + 1) - sizes - 1
        count = -(-sizes // STEP)
        doc = np.repeat(np.arange(len(sizes)), count)
        nth = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)
        out = np.empty(int(sizes.sum()), np.float64)
        ends, offset = begins + sizes, np.arange(len(sizes)) + 1  # a stream's outputs start at begins - its number
        span = np.arange(-STEP, STEP)
        late, held = [], 0  # targets that are other ids: place, code, hidden state, both parts so far

        def settle() -> None:
            place, code, h, own, pair = (np.concatenate(c) for c in zip(*late))
            p = self.gate * np.exp(own + self._other(h, code)) + (1 - self.gate) * pair * self.tail[code]
            out[place] = np.log10(np.maximum(p, 1e-300, dtype=np.float64))

        for a in range(0, len(doc), at_once):
            d, k = doc[a : a + at_once], nth[a : a + at_once]
            where = (begins[d] + k * STEP)[:, None] + span
            x = np.where(where < begins[d][:, None], self.pad, flat[np.maximum(np.minimum(where, ends[d][:, None]), 0)])
            live = (where[:, STEP:] < ends[d][:, None]).ravel()
            follow = (where[:, STEP:].ravel() + 1)[live]
            y = flat[follow].astype(np.int64)
            some = np.flatnonzero(live)
            h, before = _with_ones(self._states(x).take(some, axis=0)), x[:, STEP:].ravel().take(some)
            symbol = np.where(y < SYMBOLS, y, self.rare)
            own = self._head(h, symbol)
            pair = self.table[np.where(before < SYMBOLS, before, self.rare), symbol]
            place = follow - np.repeat(offset[d], STEP)[live]
            out[place] = np.log10(self.gate * np.exp(own) + (1 - self.gate) * pair)
            others = np.flatnonzero(y >= SYMBOLS)
            if len(others):
                late.append((place[others], y[others] - SYMBOLS, h[others], own[others], pair[others]))
                held += len(others)
                if held >= 65_536:
                    settle()
                    late, held = [], 0
        if late:
            settle()
        return np.split(out, np.cumsum(sizes)[:-1]) if len(sizes) else []
