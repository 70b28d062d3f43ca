"""Language-model scoring: a gated recurrent network with a class-factored output, trained by truncated backpropagation.

Words are known by 64-bit hashes and counted over all training documents. The HEAD most frequent are symbols of the network, in
classes of CLASS words by frequency; every other word belongs to one of TAILS open classes by its first letters. The network
gives the class; a symbol's probability in its class is a softmax over the class, a rare word's (c + 1) / (tokens + distinct
words + 1) of its open class, so that one unknown word per open class has a share. The state is carried from window to
window, so that a document is scored whole; the gradients are cut at the windows.

The network learns from every training document, in rounds over growing SHARES of them, dealt by a hash of the id. In a round each
task starts from the same weights and lays its documents end to end over streams, LAID tokens at once; each stream begins with a
state of zeros, hands it on from window to window, and begins anew where a document ends. Every window is backpropagated. The tasks' weights are averaged by their tokens, in a tree of jobs, so
that no task holds more than FAN models. Biases start from the counts of all. The counts of the most frequent words, KNOWN at
most, are shipped to the tasks; all other words of all documents meet their counts in a join.

Defined results: a null, empty or blank text is one end token; repeated rows are scored each; held-out documents count in
nothing; a null id is not held out; other columns are not looked at.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.llm.hashing import Words
from codeloom.llm.shared import written

HEAD, CLASS, TAILS, KNOWN = 4096, 64, 16, 200_000
HIDDEN, WINDOW, STREAMS = 24, 32, 384
#: Eighths of the training documents that a round learns from; models that are averaged at once; tasks of a round at most, and
#: training tokens for each, so that a small table's models have enough to learn from.
SHARES, FAN, TASKS, PER_TASK = (1, 2, 5), 64, 4096, 250_000
#: Bytes of text that are read at once, and tokens that are laid over the streams at once.
READ, LAID = 4 << 20, 1 << 20
#: Documents that are scored together; tokens whose classes are scored at once, and are gathered for that; tokens whose documents are
#: scored at once.
GROUP, BLOCK, READY, SCORED = 512, 1024, 8192, 4 << 20
END = np.uint64(0x5851F42D4C957F2D)  # stands for the end of a text; no word's hash but by chance
_SCORES = "doc_id long, row long, held_out boolean, n_tokens long, known long, logs double, network double, words array<long>, times array<int>"


def held_out(doc_id="doc_id") -> F.Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 7 == 2, F.lit(False))


def open_class(heads: np.ndarray) -> np.ndarray:
    """The open class of words by their first three bytes, as one number."""
    return ((heads * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)).astype(np.int64) % TAILS


def tokens(words: Words, texts: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, open class) of the tokens of texts, ends included, and where each text's begin, and the end of all."""
    h, heads, n = words.of(texts)
    bounds = np.cumsum([0, *(n + 1)])
    own, cls = np.full(int(bounds[-1]), END, np.uint64), np.zeros(int(bounds[-1]), np.int64)
    inside = np.ones(len(own), bool)
    inside[bounds[1:] - 1] = False
    own[inside], cls[inside] = h, open_class(heads)
    return own, cls, bounds


def _together(texts: list) -> Iterator[slice]:
    """Ranges of texts of about READ characters."""
    at, size = 0, 0
    for k, x in enumerate(texts):
        size += len(x) if isinstance(x, str) else 0
        if size >= READ:
            yield slice(at, k + 1)
            at, size = k + 1, 0
    if at < len(texts):
        yield slice(at, len(texts))


def _distinct(own: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct numbers, the order that sorts all, and where each begins in it. Equal ones take any order, which sorts much faster."""
    order = np.argsort(own)
    ordered = own[order]
    first = np.flatnonzero(np.append(True, ordered[1:] != ordered[:-1]))
    return ordered[first], order, first


def counts(docs: DataFrame) -> DataFrame:
    """(id, k, n): the tokens of the training documents by their hashes, with their open classes, pre-aggregated in the tasks."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words, held, total = Words(), [], 0
        for b in batches:
            texts = b.text.tolist()
            for part in _together(texts):
                own, cls, _ = tokens(words, texts[part])
                keys, order, first = _distinct(own)
                held.append((keys, cls[order[first]], np.diff(first, append=len(own))))
                total += len(keys)
                if total > 1_000_000:
                    held = [merged(held)]
                    if len(held[0][0]) > 500_000:
                        yield frame(*held[0])
                        held = []
                    total = sum(len(x[0]) for x in held)
        if held:
            yield frame(*merged(held))

    def merged(held: list) -> tuple:
        keys, order, first = _distinct(np.concatenate([x[0] for x in held]))
        return keys, np.concatenate([x[1] for x in held])[order[first]], np.add.reduceat(np.concatenate([x[2] for x in held])[order], first)

    def frame(keys: np.ndarray, cls: np.ndarray, n: np.ndarray) -> pd.DataFrame:
        return pd.DataFrame({"id": keys.view(np.int64), "k": cls.astype(np.int32), "n": n})

    rows = docs.where(~held_out()).select("text").mapInPandas(count, "id long, k int, n long")
    return rows.groupBy("id", "k").agg(F.sum("n").alias("n"))


class _Spaces(dict):
    """Arrays that are written anew in each step, so that no step asks the system for memory."""

    def of(self, name: str, *shape: int) -> np.ndarray:
        n = math.prod(shape)
        if name not in self or self[name].size < n:
            self[name] = np.empty(n, np.float32)
        return self[name][:n].reshape(shape)


class _Softmaxes:
    """The softmaxes of classes, each over the symbols in it. weights: (classes, symbols, HIDDEN); biases: (classes, symbols)."""

    def __init__(self, weights: np.ndarray, biases: np.ndarray):
        self.weights, self.turned = weights, np.ascontiguousarray(weights.transpose(0, 2, 1))
        # Biases are factors of what is summed up.
        self.biases = np.maximum(biases - biases.max(1, keepdims=True), -60)
        self.mass = np.exp(self.biases)
        # States lie between -1 and 1, so no sum is larger than those of the weights; only larger ones need their row's largest taken off.
        self.cut = np.abs(weights).sum(2).max() > 60
        self.logits, self.total, self.rows = np.empty((BLOCK, weights.shape[1]), np.float32), np.empty(BLOCK, np.float32), np.arange(BLOCK)

    def __call__(self, states: np.ndarray, own: np.ndarray, bounds: np.ndarray, grad: tuple | None = None) -> np.ndarray:
        """Natural logs of the probabilities of `own`, each in its class; states: those of class k are from bounds[k] to bounds[k + 1].
        grad: the gradients of the weights and the biases, and the states', to be filled."""
        logs, bias = np.empty(len(own), np.float32), self.biases[np.repeat(np.arange(len(self.biases)), np.diff(bounds)), own]
        edges, k = bounds.tolist(), 0
        if grad is not None:
            by_weight, by_bias, back = grad
            heavy = self.weights * self.mass[:, :, None]
        for at in range(0, len(own), BLOCK):  # in blocks that stay in the cache
            to, parts = min(at + BLOCK, len(own)), []
            while True:
                if (a := max(at, edges[k])) < (b := min(to, edges[k + 1])):
                    parts.append((k, slice(a, b), slice(a - at, b - at)))
                if edges[k + 1] >= to:
                    break
                k += 1
            p, total, rows = self.logits[: to - at], self.total[: to - at], self.rows[: to - at]
            for c, x, y in parts:
                np.matmul(states[x], self.turned[c], out=p[y])
            if self.cut:
                p -= p.max(1, keepdims=True)
            mine = p[rows, own[at:to]]
            np.exp(p, out=p)
            for c, _, y in parts:
                np.matmul(p[y], self.mass[c], out=total[y])
            logs[at:to] = mine + bias[at:to] - np.log(total)
            if grad is None:
                continue
            # p times its mass over the total is the probability: the narrow sides of the products are divided, and the sums get the mass.
            p[rows, own[at:to]] -= total * np.exp(-bias[at:to])
            np.reciprocal(total, out=total)
            scaled = states[at:to] * total[:, None]
            for c, x, y in parts:
                by_weight[c] += p[y].T @ scaled[y]
                by_bias[c] += total[y] @ p[y]
                np.matmul(p[y], heavy[c], out=back[x])
            back[at:to] *= total[:, None]
        if grad is not None:
            by_weight *= self.mass[:, :, None]
            by_bias *= self.mass
        return logs


def _by_gate(x: np.ndarray) -> np.ndarray:
    """(rows, 3 * HIDDEN) as (3, rows, HIDDEN), the two gates negative, as they are wanted as exp(-x)."""
    out = np.ascontiguousarray(x.reshape(-1, 3, HIDDEN).transpose(1, 0, 2))
    np.negative(out[:2], out=out[:2])
    return out


def _log_p(outer: _Softmaxes, inner: _Softmaxes, states: np.ndarray, targets: np.ndarray, spaces: _Spaces, grad: dict | None = None) -> np.ndarray | tuple:
    """Natural logs of the probabilities of `targets`: of their class, and in it; with grad, whose arrays are filled, also the states' gradient."""
    classes = HEAD // CLASS
    cls = np.where(targets < HEAD, targets // CLASS, targets - HEAD + classes).astype(np.uint8)
    order = np.argsort(cls, kind="stable")  # by class, so that each class is a stretch
    cls, states = cls[order], states.take(order, axis=0, out=spaces.of("ordered", *states.shape), mode="clip")
    bounds = np.searchsorted(cls, np.arange(classes + 1))
    near, place = bounds[-1], np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    if grad is not None:
        back, more = spaces.of("outer", *states.shape), spaces.of("inner", near, states.shape[1])
    logs = outer(states, cls, np.array([0, len(cls)]), grad and (grad["c"], grad["cb"], back))
    logs[:near] += inner(states[:near], targets[order[:near]] % CLASS, bounds, grad and (grad["o"], grad["ob"], more))
    if grad is None:
        return logs[place]
    back[:near] += more
    return logs[place], back.take(place, axis=0, out=spaces.of("back", *states.shape), mode="clip")


class Network:
    """Weights, forward pass and one training step. Symbols: HEAD words, then TAILS open classes."""

    def __init__(self, heads: np.ndarray, tails: np.ndarray, seed: int = 11):
        """heads: the counts of the HEAD most frequent words (0 for lacking ones); tails: of the open classes."""
        rng, h = np.random.default_rng(seed), HIDDEN
        normal = lambda *s: rng.normal(0, 0.1, s).astype(np.float32)
        classes = HEAD // CLASS
        mass = np.concatenate([heads.reshape(classes, CLASS).sum(1), tails]) + 1.0
        self.w = {
            "e": normal(HEAD + TAILS, h), "x": normal(h, 3 * h), "u": normal(h, 3 * h), "b": np.zeros(3 * h, np.float32),
            "c": normal(h, classes + TAILS) * 0.1, "cb": np.log(mass / mass.sum()).astype(np.float32),
            "o": normal(classes, CLASS, h) * 0.1, "ob": np.log(heads.reshape(classes, CLASS) + 1e-3).astype(np.float32),
        }
        self.m = {k: np.zeros_like(v) for k, v in self.w.items()}
        self.v = {k: np.zeros_like(v) for k, v in self.w.items()}
        self.t, self.spaces = 0, _Spaces()

    def project(self) -> np.ndarray:
        return self.w["e"] @ self.w["x"] + self.w["b"]

    def run(self, projected: np.ndarray, inputs: np.ndarray, state: np.ndarray, keep: tuple | None = None) -> tuple[np.ndarray, np.ndarray]:
        """inputs: (steps, streams). The states after each step, and the last. keep: arrays for the states, the first one before them, for
        the gates and the fresh states, and for the recurrent parts of the latter, of each step."""
        steps, n = inputs.shape
        states, gates, recurrent = keep or (np.empty(shape, np.float32) for shape in ((steps + 1, n, HIDDEN), (1, 3, n, HIDDEN), (1, n, HIDDEN)))
        table, u, by_state = _by_gate(projected), _by_gate(self.w["u"]), np.empty((2, n, HIDDEN), np.float32)
        states[0] = state
        for t in range(steps):
            state, new, own, r = states[t], states[t + 1], gates[t % len(gates)], recurrent[t % len(gates)]
            table.take(inputs[t], axis=1, out=own, mode="clip")
            both, fresh = own[:2], own[2]
            both += np.matmul(state, u[:2], out=by_state)
            np.exp(both, out=both)
            both += 1
            np.reciprocal(both, out=both)
            fresh += np.multiply(both[1], np.matmul(state, u[2], out=r), out=new)
            np.tanh(fresh, out=fresh)
            np.subtract(state, fresh, out=new)
            new *= both[0]
            new += fresh
        return states[1:], states[-1]

    def log_p(self, states: np.ndarray, targets: np.ndarray, grad: dict | None = None) -> np.ndarray | tuple:
        """Natural logs of the probabilities of `targets` (of a rare word's open class); with grad, also the states' gradient."""
        w = self.w
        outer, inner = _Softmaxes(np.ascontiguousarray(w["c"].T)[None], w["cb"][None]), _Softmaxes(w["o"], w["ob"])
        if grad is None:
            return _log_p(outer, inner, states, targets, self.spaces)
        g = {"c": np.zeros_like(outer.weights), "cb": np.zeros_like(outer.mass), "o": np.zeros_like(w["o"]), "ob": np.zeros_like(w["ob"])}
        logs, back = _log_p(outer, inner, states, targets, self.spaces, g)
        grad |= g | {"c": g["c"][0].T, "cb": g["cb"][0]}
        return logs, back

    def train(self, inputs: np.ndarray, targets: np.ndarray, state: np.ndarray, rate: float) -> tuple[float, np.ndarray]:
        """One step of truncated backpropagation over a window (steps, streams)."""
        h, w, g, (steps, n), space = HIDDEN, self.w, {}, inputs.shape, self.spaces.of
        keep = all_states, gates, recurrent = space("states", steps + 1, n, h), space("gates", steps, 3, n, h), space("recurrent", steps, n, h)
        states, last = self.run(self.project(), inputs, state, keep)
        logs, back = self.log_p(states.reshape(-1, h), targets.reshape(-1), g)
        back = back.reshape(states.shape)
        # The gradients before the two gates, before the recurrent part of the fresh state, and before all of the fresh state.
        by, turned = space("by", 4, steps, n, h), np.ascontiguousarray(w["u"].reshape(h, 3, h).transpose(1, 2, 0))
        d_state, one, two, handed = np.zeros((n, h), np.float32), space("one", n, h), space("two", n, h), space("handed", 3, n, h)
        for t in range(steps - 1, -1, -1):
            (z, s, fresh), d, (d_z, d_s, d_r, d_n) = gates[t], back[t], by[:, t]
            d += d_state
            np.multiply(d, z, out=d_state)
            np.subtract(d, d_state, out=one)  # d * (1 - z)
            np.multiply(fresh, fresh, out=two)
            np.subtract(1, two, out=two)
            np.multiply(one, two, out=d_n)
            np.subtract(states[t], fresh, out=two)  # z * (the state before - fresh)
            np.multiply(one, two, out=d_z)
            np.multiply(d_n, s, out=d_r)
            np.multiply(d_r, recurrent[t], out=one)
            np.subtract(1, s, out=two)
            np.multiply(one, two, out=d_s)
            for x in np.matmul(by[:3, t], turned, out=handed):
                d_state += x
        flat, rows, befores = by.reshape(4, -1, h), inputs.reshape(-1).astype(np.uint16), all_states[:-1].reshape(-1, h)
        by_input, ones = (flat[0], flat[1], flat[3]), np.ones(inputs.size, np.float32)
        embedded = w["e"].take(rows, axis=0, out=space("embedded", inputs.size, h), mode="clip")
        g["u"] = np.concatenate([befores.T @ x for x in flat[:3]], 1)
        g["b"], g["x"] = np.concatenate([ones @ x for x in by_input]), np.concatenate([embedded.T @ x for x in by_input], 1)
        d_e = np.matmul(flat[0], w["x"][:, :h].T, out=space("outer", inputs.size, h))
        for k in (1, 2):
            d_e += np.matmul(by_input[k], w["x"][:, k * h : (k + 1) * h].T, out=space("inner", inputs.size, h))
        order = np.argsort(rows, kind="stable")
        ordered = rows[order]
        first = np.flatnonzero(np.append(True, ordered[1:] != ordered[:-1]))
        used = ordered[first]
        g["e"] = np.zeros_like(w["e"])
        g["e"][used] = np.add.reduceat(d_e.take(order, axis=0, out=space("embedded", inputs.size, h), mode="clip"), first)
        self.t += 1
        n = inputs.size
        for k, x in w.items():
            d, m, v = g[k], self.m[k], self.v[k]
            d /= n
            np.clip(d, -0.05, 0.05, out=d)
            m *= 0.9
            v *= 0.99
            m += 0.1 * d
            d *= d
            d *= 0.01
            v += d
            np.multiply(v, 1 / (1 - 0.99**self.t), out=d)
            np.sqrt(d, out=d)
            d += 1e-7
            np.divide(m, d, out=d)
            d *= rate / (1 - 0.9**self.t)
            x -= d
        return float(logs.mean()), last.copy()

    def learn(self, flat: np.ndarray, rate: float, seed: int | None = None) -> None:
        """flat: the symbols of documents, end to end, an end token after each; laid over streams, each a stretch of the text that begins
        with a state of zeros. Every window is backpropagated, and hands its state on; after an end token it is zeros again.
        seed: without effect, as no windows are drawn any more; callers may still give one."""
        streams = int(np.clip(len(flat) // (64 * WINDOW), 1, STREAMS))
        steps = len(flat) // streams
        if steps < 2:
            return
        lanes = np.ascontiguousarray(flat[: steps * streams].reshape(streams, steps).T)
        inputs = np.vstack([np.zeros((1, streams), lanes.dtype), lanes[:-1]])
        state = np.zeros((streams, HIDDEN), np.float32)
        for at in range(0, steps, WINDOW):
            state = state * (inputs[at] != 0)[:, None]  # after an end token a document begins
            _, state = self.train(inputs[at : at + WINDOW], lanes[at : at + WINDOW], state, rate)
        if steps * streams < len(flat):  # fewer tokens than streams are left; they are one more stretch
            rest = flat[steps * streams - 1 :]
            self.train(rest[:-1, None], rest[1:, None], np.zeros((1, HIDDEN), np.float32), rate * len(rest) / (WINDOW * streams))

    def score(self, symbols: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """symbols: of documents, end to end, which begin at `bounds`. The natural log of each one's probability (open classes
        without their words), from a state of zeros."""
        lengths = np.diff(bounds)
        out, held, ready = np.zeros(len(lengths)), [], 0
        fast = _Scorer(self.w)

        def settle() -> None:
            states, targets, docs = (np.concatenate(x) for x in zip(*held))
            np.add(out, np.bincount(docs, fast.log_p(states, targets), len(out)), out=out)
            held.clear()

        order = np.argsort(-lengths, kind="stable")
        for at in range(0, len(order), GROUP):
            group = order[at : at + GROUP]
            size, begins = lengths[group], bounds[:-1][group]
            state = np.zeros((len(group), HIDDEN), np.float32)
            last = np.zeros(len(group), symbols.dtype)
            for begin in range(0, int(size[0]), WINDOW):
                n = int((size > begin).sum())  # documents that go on; the longest are first
                steps = min(WINDOW, int(size[0]) - begin)
                step = np.arange(begin, begin + steps)[:, None]
                inside = step < size[None, :n]
                targets = symbols[np.minimum(begins[None, :n] + step, len(symbols) - 1)]
                states = fast.run(np.vstack([last[None, :n], targets[:-1]]), state[:n])
                state, last = states[-1].copy(), targets[-1]
                held.append((states[inside], targets[inside], group[np.nonzero(inside)[1]]))
                ready += len(held[-1][1])
                if ready >= READY:  # a window of few documents waits for others
                    settle()
                    ready = 0
        if held:
            settle()
        return out


class _Scorer:
    """The network's forward pass alone, without new arrays for each step."""

    def __init__(self, w: dict):
        self.table, self.u = _by_gate(w["e"] @ w["x"] + w["b"]), _by_gate(w["u"])
        self.outer, self.inner = _Softmaxes(np.ascontiguousarray(w["c"].T)[None], w["cb"][None]), _Softmaxes(w["o"], w["ob"])
        self.spaces = _Spaces()

    def run(self, inputs: np.ndarray, state: np.ndarray) -> np.ndarray:
        """inputs: (steps, documents). The states after each step."""
        n, space = inputs.shape[1], self.spaces.of
        gates, r, out = space("gates", 3, n, HIDDEN), space("recurrent", 3, n, HIDDEN), space("states", len(inputs), n, HIDDEN)
        both, fresh, by_state, by_fresh = gates[:2], gates[2], r[:2], r[2]
        for own, new in zip(inputs, out):
            np.take(self.table, own, axis=1, out=gates, mode="clip")
            np.matmul(state, self.u, out=r)
            both += by_state
            np.exp(both, out=both)
            both += 1
            np.reciprocal(both, out=both)
            by_fresh *= both[1]
            fresh += by_fresh
            np.tanh(fresh, out=fresh)
            np.subtract(state, fresh, out=new)
            new *= both[0]
            new += fresh
            state = new
        return out

    def log_p(self, states: np.ndarray, targets: np.ndarray) -> np.ndarray:
        return _log_p(self.outer, self.inner, states, targets, self.spaces).astype(float)


class Lexicon:
    """The KNOWN words by their hashes, in the order of their counts, the end first."""

    def __init__(self, ids: np.ndarray, classes: np.ndarray):
        self.order = np.argsort(ids, kind="stable")
        self.ids = ids[self.order]
        self.symbols = np.where(np.arange(len(ids)) < HEAD, np.arange(len(ids)), HEAD + classes)

    def read(self, own: np.ndarray, cls: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each token its index among the known words, or -1, and its symbol."""
        keys, at = np.unique(own, return_inverse=True)
        found = np.minimum(np.searchsorted(self.ids, keys), len(self.ids) - 1)
        index = np.where(self.ids[found] == keys, self.order[found], -1)[at]
        return index, np.where(index >= 0, self.symbols[index], HEAD + cls)


def _network(weights: dict) -> Network:
    net = Network(np.zeros(HEAD), np.zeros(TAILS))
    net.w = {k: x.copy() for k, x in weights.items()}
    net.m, net.v = ({k: np.zeros_like(x) for k, x in net.w.items()} for _ in range(2))
    return net


def averaged(models: DataFrame) -> DataFrame:
    """models: (task, tokens, model). One row: the mean of the models by their tokens, FAN at a time."""

    def mean(b: pd.DataFrame) -> pd.DataFrame:
        b = b.sort_values("task")
        total, out = float(b.tokens.sum()), None
        for n, raw in zip(b.tokens, b.model):
            w = pickle.loads(raw)
            out = {k: x * (n / total) for k, x in w.items()} if out is None else {k: out[k] + x * (n / total) for k, x in w.items()}
        out = {k: x.astype(np.float32) for k, x in out.items()}
        return pd.DataFrame({"task": [int(b.task.min()) // FAN], "tokens": [total], "model": [pickle.dumps(out)]})

    n = TASKS
    while n > 1:
        models = models.groupBy(F.expr(f"task div {FAN}").alias("group")).applyInPandas(mean, models.schema)
        n = -(-n // FAN)
        if n > 1:
            models = written(models, "models")
    return written(models, "model")


def trained(docs: DataFrame, lexicon: Lexicon, net: Network, total: int) -> Network:
    """The network after it has learnt from every training document; total: their tokens."""
    context = docs.sparkSession.sparkContext
    source = docs.where(~held_out()).select("doc_id", "text")
    part = F.pmod(F.xxhash64("doc_id", F.lit(9)), F.lit(sum(SHARES)))
    begin = 0
    for k, share in enumerate(SHARES):
        own = source.where((part >= begin) & (part < begin + share)).select("text")
        begin += share
        rate = 0.02 * 0.6**k
        shared = context.broadcast((net.w, lexicon))

        def learn(batches: Iterator[pd.DataFrame], shared=shared, rate=rate) -> Iterator[pd.DataFrame]:
            weights, lexicon = shared.value
            net, words, held, size, total = _network(weights), Words(), [], 0, 0
            for b in batches:
                texts = b.text.tolist()
                for one in _together(texts):
                    own, cls, _ = tokens(words, texts[one])
                    held.append(lexicon.read(own, cls)[1])
                    size += len(own)
                    while size >= LAID:  # a long text is laid over the streams part by part
                        flat = np.concatenate(held)
                        net.learn(flat[:LAID], rate)
                        total += LAID
                        held, size = [flat[LAID:]], size - LAID
            if size:
                net.learn(np.concatenate(held), rate)
                total += size
            if total:
                yield pd.DataFrame({"task": [TaskContext.get().partitionId() % TASKS], "tokens": [float(total)], "model": [pickle.dumps(net.w)]})

        models = written(own.coalesce(max(1, min(TASKS, total // PER_TASK))).mapInPandas(learn, "task long, tokens double, model binary"), "models")
        row = averaged(models).first()
        shared.unpersist()
        if row is not None:
            net = _network(pickle.loads(row.model))
    return net


def frequent(table: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(id, class, n) of the end token, then of the most frequent words by (count, id): about KNOWN words at most, and never
    fewer than HEAD if there are as many."""
    # The frequent words are those above a count that no more than KNOWN reach; it is found from counts by powers of 2 ** 1/16.
    end = int(END.view(np.int64))
    rest, step = table.where(F.col("id") != end), F.floor(F.log2("n") * 16)
    above, least, taken = 0, None, 0
    for r in rest.groupBy(step.alias("step")).agg(F.count("*").alias("words")).orderBy(F.desc("step")).collect():  # 1024 rows at most
        above += r.words
        if above > KNOWN:
            break
        least, taken = r.step, above
    if above > KNOWN and taken < HEAD:  # one step holds too many: the network's words come from its part, in the order
        top = rest.orderBy(F.desc("n"), "id").limit(HEAD).collect()
    else:
        top = rest.where(step >= least).collect() if least is not None else []
    ends = table.where(F.col("id") == end).agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    top = sorted((-r.n, r.id, r.k) for r in top)
    return np.array([end, *(i for _, i, _ in top)], np.int64).view(np.uint64), np.array([0, *(k for *_, k in top)], np.int64), np.array([ends, *(-n for n, *_ in top)], np.int64)


def scored(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score), a row for each of docs."""
    spark = docs.sparkSession
    table = written(counts(docs), "counts")
    ids, classes, numbers = frequent(table)
    total, distinct = table.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    head = spark.createDataFrame(pd.DataFrame({"id": ids[:HEAD].view(np.int64)}), "id long")
    rare = table.join(F.broadcast(head), "id", "left_anti").groupBy("k").agg(F.sum("n").alias("n"), F.count("*").alias("v"))
    mass, size = np.zeros(TAILS), np.zeros(TAILS)
    for r in rare.collect():  # TAILS rows
        mass[r.k], size[r.k] = r.n, r.v
    heads = np.zeros(HEAD)
    heads[: min(HEAD, len(numbers))] = numbers[:HEAD]
    lexicon = Lexicon(ids, classes)
    net = trained(docs, lexicon, Network(heads, mass), int(total))
    within = np.concatenate([np.zeros(HEAD), -np.log10(mass + size + 1)])
    shared = spark.sparkContext.broadcast((lexicon, numbers, net.w, within))

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lexicon, numbers, weights, within = shared.value
        net, words, logs_of = _network(weights), Words(), np.log10(numbers + 1.0)

        def settled(held: list[tuple]) -> Iterator[pd.DataFrame]:
            symbols, bounds = np.concatenate([x for x, _ in held]), np.cumsum(np.concatenate([[0], *(x.n_tokens for _, x in held)]))
            logs, at = net.score(symbols, bounds) / np.log(10), 0
            for _, x in held:
                yield x.assign(network=x.network + logs[at : at + len(x)])
                at += len(x)

        for b in batches:
            texts, held, size = b.text.tolist(), [], 0
            for part in _together(texts):
                own, cls, bounds = tokens(words, texts[part])
                index, symbols = lexicon.read(own, cls)
                n = np.diff(bounds)
                doc = np.repeat(np.arange(len(n)), n)
                near = index >= 0
                logs = np.where(near, logs_of[index], 0.0)
                summed = lambda x: np.bincount(doc, x, len(n))  # noqa: B023, E731
                outside = summed(within[symbols] + np.where(symbols >= HEAD, logs, 0.0))
                known = summed(near & (numbers[index] > 0)).astype(np.int64)
                # Words that aren't among the known ones: each once a document, with its times there.
                order = np.lexsort((own[~near], doc[~near]))
                far, far_doc = own[~near][order], doc[~near][order]
                fresh = np.flatnonzero(np.append(True, (far[1:] != far[:-1]) | (far_doc[1:] != far_doc[:-1]))) if len(far) else np.zeros(0, np.int64)
                times = np.diff(np.append(fresh, len(far))).astype(np.int32)
                cut = np.searchsorted(far_doc[fresh], np.arange(1, len(n)))
                out = b.iloc[part][["doc_id", "row", "held_out"]].reset_index(drop=True).assign(
                    n_tokens=n, known=known, logs=summed(logs), network=outside,
                    words=pd.Series(np.split(far[fresh].view(np.int64), cut), dtype=object), times=pd.Series(np.split(times, cut), dtype=object),
                ).astype({"doc_id": "Int64"})
                held.append((symbols.astype(np.uint16), out))
                size += len(symbols)
                if size >= SCORED:
                    yield from settled(held)
                    held, size = [], 0
            if held:
                yield from settled(held)

    rows = docs.select("doc_id", F.monotonically_increasing_id().alias("row"), held_out().alias("held_out"), "text").mapInPandas(score, _SCORES)
    rows = written(rows, "scores")
    far = rows.select("row", F.explode(F.arrays_zip("words", "times")).alias("x")).select("row", F.col("x.words").alias("id"), F.col("x.times").alias("k"))
    known = table.select("id", "n")
    met = far.join(known, "id").groupBy("row").agg(F.sum(F.col("k") * F.log10(F.col("n") + 1)).alias("far"), F.sum("k").alias("far_known"))
    both = rows.join(met, "row", "left")
    zero = lambda c: F.coalesce(c, F.lit(0))
    return both.select(
        "doc_id", "held_out", "n_tokens", (F.col("known") + zero("far_known")).cast("long").alias("n_known"),
        F.lit(int(total)).cast("long").alias("train_tokens"),
        (F.col("logs") + zero("far") - F.col("n_tokens") * F.log10(F.lit(float(total + distinct + 1)))).alias("base_score"),
        (F.col("network") + zero("far")).alias("score"),
    )
