"""A gated recurrent network in numpy with a class-factored softmax."""

from __future__ import annotations

import heapq

import numpy as np

WINDOW = 12
LANES = 512
#: Where all logits of a row may lie this far below the bound, its largest one is sought instead.
_SPAN = 60


def _order(numbers: np.ndarray, most: int) -> np.ndarray:
    """The stable order of numbers up to ``most``; short ones are sorted by their digits."""
    return np.argsort(numbers.astype(np.min_scalar_type(most)), kind="stable")


def _placed(values: np.ndarray, order: np.ndarray) -> np.ndarray:
    """``values`` that lie in ``order``, back in their places."""
    out = np.empty_like(values)
    out[order] = values
    return out


def _bounds(weights: np.ndarray, bias: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What no logit of a class exceeds, and whether each row of states has a
    logit so close to it that it can be taken off in the place of the largest one.

    States lie within -1 and 1, which bounds the logits of all of them.
    """
    reach = np.abs(weights).sum(-1)
    most = (bias + reach).max(-1)
    return most, most - (bias - reach).max(-1) < _SPAN


def _softened(
    logit: np.ndarray, bias: np.ndarray, most: float, close: bool, rows: np.ndarray, at: np.ndarray
) -> tuple[np.ndarray, np.ndarray]:
    """Turns logits into exponentials, up to a factor of the row; gives their sums, and the
    natural log probability of the column ``at`` of each row."""
    if close:
        logit += bias - most
    else:
        logit += bias
        logit -= logit.max(1, keepdims=True)
    picked = logit[rows, at]
    np.exp(logit, out=logit)
    total = logit @ np.ones(logit.shape[1], np.float32)
    return total, picked - np.log(total)


class Network:
    """Predicts the next code from those before.

    Codes 0 to ``words`` - 1 are words by falling frequency, in classes of ``per_class``;
    the ``tails`` codes after them are classes by themselves; the last code stands before a
    text. P(code) = P(its class) for a tail, and P(its class) P(word | class) for a word.
    """

    NAMES = ("table", "recurrent", "out", "out_bias", "within", "within_bias")

    def __init__(self, words: int, tails: int, per_class: int, hidden: int, seed: int = 7):
        self.words, self.tails, self.per_class, self.hidden = words, tails, per_class, hidden
        self.heads = -(-words // per_class)
        self.start = words + tails
        rng = np.random.default_rng(seed)

        def small(*shape: int) -> np.ndarray:
            return (rng.standard_normal(shape) * 0.1).astype(np.float32)

        self.table = small(words + tails + 1, 3 * hidden)
        self.recurrent = small(hidden, 3 * hidden)
        self.out = small(hidden, self.heads + tails) * np.float32(0.1)
        self.out_bias = np.zeros(self.heads + tails, np.float32)
        self.within = small(self.heads * per_class, hidden) * np.float32(0.1)
        self.within_bias = np.full(self.heads * per_class, -30, np.float32)

    def start_from(self, counts: np.ndarray) -> None:
        """Biases that give every code its share of the counts (words, then tails)."""
        c = counts + 0.5
        heads = np.zeros(self.heads * self.per_class)
        heads[: self.words] = c[: self.words]
        self.within_bias[: self.words] = np.log(c[: self.words])
        by_class = np.r_[heads.reshape(self.heads, -1).sum(1), c[self.words :]]
        self.out_bias[:] = np.log(np.maximum(by_class, 1e-9) / by_class.sum())

    def flat(self) -> np.ndarray:
        return np.concatenate([getattr(self, n).ravel() for n in self.NAMES])

    def load(self, flat: np.ndarray) -> None:
        at = 0
        for name in self.NAMES:
            held = getattr(self, name)
            held[...] = flat[at : at + held.size].reshape(held.shape)
            at += held.size

    def run(self, inputs: np.ndarray, state: np.ndarray) -> tuple[np.ndarray, list]:
        """States after each step of inputs (steps x lanes), and what backward needs."""
        h, n = state, self.hidden
        states = np.empty((len(inputs), inputs.shape[1], n), np.float32)
        kept = []
        for t, codes in enumerate(inputs):
            h = h * (codes != self.start)[:, None]
            x = self.table.take(codes, axis=0)
            u = h @ self.recurrent
            gates = x[:, : 2 * n] + u[:, : 2 * n]
            np.exp(np.negative(gates, out=gates), out=gates)
            gates += 1
            np.reciprocal(gates, out=gates)
            r, z = gates[:, :n], gates[:, n:]
            new = r * u[:, 2 * n :]
            new += x[:, 2 * n :]
            np.tanh(new, out=new)
            kept.append((h, r, z, new, u[:, 2 * n :]))
            h = h - new
            h *= z
            h += new
            states[t] = h
        return states, kept

    def score(self, h: np.ndarray, target: np.ndarray, grads: dict | None = None) -> tuple[np.ndarray, np.ndarray | None]:
        """Natural log probability of each target; with ``grads``, adds up gradients of the
        negative log likelihood and returns that of the states."""
        word = target < self.words
        cls = np.where(word, target // self.per_class, target - self.words + self.heads)
        # Rows lie by class, so that those of one class are a slice.
        order = _order(cls, self.heads + len(self.out_bias))
        h, target, cls = h.take(order, axis=0), target[order], cls[order]
        rows = np.arange(len(h))
        p = h @ self.out
        total, log = _softened(p, self.out_bias, *_bounds(self.out.T, self.out_bias), rows, cls)
        back = None
        if grads is not None:
            p *= (1 / total)[:, None]
            p[rows, cls] -= 1
            grads["out"] += h.T @ p
            grads["out_bias"] += np.ones(len(p), np.float32) @ p
            back = p @ self.out.T
        cuts = np.searchsorted(cls, np.arange(self.heads + 1))
        most, close = _bounds(
            self.within.reshape(self.heads, self.per_class, -1), self.within_bias.reshape(self.heads, -1)
        )
        for c in range(self.heads):
            mine = slice(cuts[c], cuts[c + 1])
            if cuts[c] == cuts[c + 1]:
                continue
            part = slice(c * self.per_class, (c + 1) * self.per_class)
            w, hm = self.within[part], h[mine]
            each, at = rows[: len(hm)], target[mine] - c * self.per_class
            q = hm @ w.T
            total, inner = _softened(q, self.within_bias[part], most[c], close[c], each, at)
            log[mine] += inner
            if grads is not None:
                q *= (1 / total)[:, None]
                q[each, at] -= 1
                grads["within"][part] += q.T @ hm
                grads["within_bias"][part] += np.ones(len(at), np.float32) @ q
                back[mine] += q @ w
        return _placed(log, order), None if back is None else _placed(back, order)

    def backward(self, inputs: np.ndarray, kept: list, back: np.ndarray, grads: dict) -> None:
        """Truncated backpropagation: through the steps of this window only."""
        n = self.hidden
        carry = np.zeros_like(back[0])
        wide = np.empty((*inputs.shape, 3 * n), np.float32)
        deep, before = np.empty_like(wide), np.empty((*inputs.shape, n), np.float32)
        for t in range(len(inputs) - 1, -1, -1):
            h, r, z, new, un = kept[t]
            g = back[t] + carry
            gz = g * z
            dn = g - gz
            dz = h - new
            dz *= dn
            dz *= z
            dn *= 1 - new * new
            dr = dn * un
            dr *= r
            dr *= 1 - r
            wide[t, :, :n], wide[t, :, n : 2 * n], wide[t, :, 2 * n :] = dr, dz, dn
            du = deep[t]
            du[:, : 2 * n] = wide[t, :, : 2 * n]
            np.multiply(dn, r, out=du[:, 2 * n :])
            before[t] = h
            carry = du @ self.recurrent.T
            carry += gz
            carry *= (inputs[t] != self.start)[:, None]
        grads["recurrent"] += before.reshape(-1, n).T @ deep.reshape(-1, 3 * n)
        codes = inputs.ravel()
        order = _order(codes, self.start)
        codes = codes[order]
        first = np.flatnonzero(np.diff(codes, prepend=-1))
        grads["table"] = (codes[first], np.add.reduceat(wide.reshape(-1, 3 * n).take(order, axis=0), first, axis=0))


class Trainer:
    """Adagrad over windows; the state of each lane goes on from window to window."""

    def __init__(self, net: Network, rate: float):
        self.net, self.rate = net, rate
        self.squares = {n: np.full_like(getattr(net, n), 1e-2) for n in net.NAMES}

    def learn(self, inputs: np.ndarray, targets: np.ndarray, active: np.ndarray, state: np.ndarray) -> np.ndarray:
        net = self.net
        states, kept = net.run(inputs, state)
        grads = {n: np.zeros_like(getattr(net, n)) for n in net.NAMES if n != "table"}
        mask = active.ravel()
        h = states.reshape(-1, net.hidden)[mask]
        _, back = net.score(h, targets.ravel()[mask], grads)
        whole = np.zeros((mask.size, net.hidden), np.float32)
        whole[mask] = back
        net.backward(inputs, kept, whole.reshape(states.shape), grads)
        for name in net.NAMES:
            if name == "table":
                seen, g = grads[name]
                self.squares[name][seen] += g * g
                net.table[seen] -= self.rate * g / np.sqrt(self.squares[name][seen])
            else:
                g = grads[name]
                self.squares[name] += g * g
                getattr(net, name)[...] -= self.rate * g / np.sqrt(self.squares[name])
        return states[-1]


def lanes(lengths: np.ndarray, most: int = LANES) -> list[list[int]]:
    """Texts dealt to at most ``most`` lanes of about equal length, the longest lane first."""
    count = max(1, min(most, len(lengths)))
    heap = [(0, k) for k in range(count)]
    out: list[list[int]] = [[] for _ in range(count)]
    for i in np.argsort(-lengths, kind="stable").tolist():
        held, k = heapq.heappop(heap)
        out[k].append(i)
        heapq.heappush(heap, (held + int(lengths[i]), k))
    return sorted(out, key=lambda lane: -int(lengths[lane].sum()))


def streams(codes: np.ndarray, lengths: np.ndarray, start: int, most: int = LANES) -> tuple[np.ndarray, ...]:
    """Inputs, targets and text numbers, steps x lanes; the number is -1 behind a lane's end."""
    ends = np.cumsum(lengths)
    dealt = lanes(lengths, most)
    steps = max((int(lengths[lane].sum()) for lane in dealt), default=0)
    inputs = np.full((steps, len(dealt)), start, np.int64)
    targets = np.zeros((steps, len(dealt)), np.int64)
    texts = np.full((steps, len(dealt)), -1, np.int64)
    for k, lane in enumerate(dealt):
        at = 0
        for i in lane:
            n = int(lengths[i])
            mine = codes[ends[i] - n : ends[i]]
            targets[at : at + n, k] = mine
            inputs[at + 1 : at + n, k] = mine[:-1]
            texts[at : at + n, k] = i
            at += n
    return inputs, targets, texts


def train(trainer: Trainer, codes: np.ndarray, lengths: np.ndarray, window: int = WINDOW) -> None:
    net = trainer.net
    inputs, targets, texts = streams(codes, lengths, net.start)
    state = np.zeros((inputs.shape[1], net.hidden), np.float32)
    for a in range(0, len(inputs), window):
        part = slice(a, a + window)
        width = int((texts[a] >= 0).sum())  # lanes are sorted: the others have ended
        state = trainer.learn(
            inputs[part, :width], targets[part, :width], texts[part, :width] >= 0, state[:width]
        )


def log_likelihoods(net: Network, codes: np.ndarray, lengths: np.ndarray, window: int = 32) -> np.ndarray:
    """Natural log probability of each whole text; states are carried across windows."""
    inputs, targets, texts = streams(codes, lengths, net.start)
    state = np.zeros((inputs.shape[1], net.hidden), np.float32)
    out = np.zeros(len(lengths))
    for a in range(0, len(inputs), window):
        part = slice(a, a + window)
        width = int((texts[a] >= 0).sum())
        states, _ = net.run(inputs[part, :width], state[:width])
        mask = (texts[part, :width] >= 0).ravel()
        log, _ = net.score(states.reshape(-1, net.hidden)[mask], targets[part, :width].ravel()[mask])
        out += np.bincount(texts[part, :width].ravel()[mask], log, len(lengths))
        state = states[-1]
    return out
