"""Toxicity: a bidirectional gated recurrent network with attention pooling, trained in numpy.

Inputs of a step are a word (embedding of words known from training) and its characters (mean embedding of byte
bigrams). A window of WINDOW words starts at every word that has a full window; each gets a logit, and a document's
score is the calibrated greatest logit of its windows. Training is multiple-instance: in a toxic document the window
that scores highest is the example, in others the highest and some random ones are.

Rows are scored by the same network as a graph of onnxruntime, whose tanh and sigmoid cost a fraction of numpy's; where
that is not installed, numpy scores them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import onnx_graph
from .learn import held_out, labelled
from .scratch import bounded, lean
from .wordhash import slices, utf8, word_spans

#: Most labelled documents of each class that the fit sees.
SAMPLE = 1500
MODULUS, HELD, THRESHOLD = 3, 1, 0.7
WINDOW = 24
WORDS, WORD_DIM, GRAMS, CHAR_DIM, HIDDEN = 8192, 8, 4096, 6, 8
EPOCHS, PASSES, BATCH, RATE = 4, 2, 128, 0.01
#: Windows whose states are kept at once, so that they stay in a core's cache.
BLOCK = 2048
#: Windows of one run of the graph, whose cost by node is shared by them.
GRAPH_BLOCK = 4096
_f = np.float32


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return (np.tanh(x * _f(0.5)) + _f(1)) * _f(0.5)


def _grams(text: bytes, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashed byte bigrams of words, one after the other, and each word's first; a word's last byte pairs with 0."""
    buf = np.frombuffer(text, np.uint8).astype(np.int64)
    sizes = ends - starts
    first = np.cumsum(sizes) - sizes
    at = np.arange(sizes.sum()) + np.repeat(starts - first, sizes)
    after = np.append(buf, 0)[at + 1]
    after[first + sizes - 1] = 0
    return (buf[at] * 257 + after * 31) % GRAMS, first


class Words:
    """Distinct words of some texts: hashes, bigrams, and each text's words as numbers of them."""

    def __init__(self, texts: list[bytes]):
        whole = b" ".join(texts)
        hashes, starts, ends = word_spans(whole)
        self.hashes, at, inverse = np.unique(hashes, return_index=True, return_inverse=True)
        self.grams, self.first = _grams(whole, starts[at], ends[at]) if len(at) else (np.empty(0, np.int64), np.empty(0, np.int64))
        after = np.cumsum([len(t) + 1 for t in texts])
        self.docs = np.split(inverse.astype(np.int32), np.searchsorted(starts, after[:-1])) if texts else []


def sequence(docs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word numbers of all texts, short ones filled up to WINDOW with -1; starts of all windows; each text's count of them.

    A window starts at every word up to the last full window; texts without words have none.
    """
    docs = [np.append(d, np.full(WINDOW - len(d), -1, np.int32)) if 0 < len(d) < WINDOW else d for d in docs]
    sizes = np.array([len(d) for d in docs], np.int64)
    counts = np.maximum(sizes - WINDOW + 1, 0)
    shift = np.cumsum(sizes) - sizes - (np.cumsum(counts) - counts)
    starts = np.arange(counts.sum()) + np.repeat(shift, counts)
    return np.concatenate([*docs, np.empty(0, np.int32)]).astype(np.int32), starts, counts


def window_matrix(docs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Word numbers of every window (-1: no word), and each document's count of windows; none without words."""
    seq, starts, counts = sequence(docs)
    return seq[starts[:, None] + np.arange(WINDOW)], counts


@dataclass
class Network:
    vocabulary: np.ndarray = field(default_factory=lambda: np.empty(0, np.uint64))
    p: dict[str, np.ndarray] = field(default_factory=dict)
    calibration: tuple[float, float, float] = (1.0, 0.0, 0.0)

    @classmethod
    def start(cls, vocabulary: np.ndarray, hint: np.ndarray) -> Network:
        """hint: log odds of the vocabulary's words, the first embedding dimension to begin with."""
        rng = np.random.Generator(np.random.PCG64(3))
        rand = lambda *s, k=0.3: (rng.standard_normal(s) * k).astype(_f)
        p = {"E": rand(len(vocabulary) + 1, WORD_DIM, k=0.05), "C": rand(GRAMS, CHAR_DIM, k=0.05), "v": rand(2 * HIDDEN), "w": rand(2 * HIDDEN), "b": np.zeros(1, _f)}
        p["E"][1:, 0] = hint / 3
        for d in "fb":
            p |= {f"X{d}": rand(WORD_DIM + CHAR_DIM, 3 * HIDDEN), f"U{d}": rand(HIDDEN, 3 * HIDDEN), f"c{d}": np.zeros(3 * HIDDEN, _f)}
        return cls(vocabulary, p)

    def known(self, hashes: np.ndarray) -> np.ndarray:
        """Rows of E; 0 for words outside the vocabulary."""
        if not len(self.vocabulary):
            return np.zeros(len(hashes), np.int64)
        at = np.minimum(np.searchsorted(self.vocabulary, hashes), len(self.vocabulary) - 1)
        return np.where(self.vocabulary[at] == hashes, at + 1, 0)

    def inputs(self, words: Words) -> np.ndarray:
        sizes = np.diff(np.append(words.first, len(words.grams)))[:, None]
        chars = np.add.reduceat(self.p["C"][words.grams], words.first, axis=0) / sizes if len(words.first) else np.empty((0, CHAR_DIM), _f)
        return np.concatenate([self.p["E"][self.known(words.hashes)], chars], axis=1).astype(_f)

    def states(self, x: np.ndarray, index: np.ndarray, d: str, tape: list | None = None) -> np.ndarray:
        """Hidden states of one direction (steps, windows, HIDDEN) over projected inputs x by word number."""
        steps = range(WINDOW) if d == "f" else range(WINDOW - 1, -1, -1)
        h, out, u, k = np.zeros((len(index), HIDDEN), _f), np.empty((WINDOW, len(index), HIDDEN), _f), self.p[f"U{d}"], HIDDEN
        short = (index[:, -1] < 0).any()
        for t in steps:
            g, gh = x[index[:, t]], h @ u
            zr = _sigmoid(g[:, : 2 * k] + gh[:, : 2 * k])
            n = np.tanh(g[:, 2 * k :] + zr[:, k:] * gh[:, 2 * k :])
            new = n + zr[:, :k] * (h - n)
            if short:
                new = np.where(index[:, t : t + 1] < 0, h, new)
            if tape is not None:
                tape.append((t, h, zr, n, gh[:, 2 * k :]))
            out[t] = h = new
        return out

    def logits(self, x: tuple[np.ndarray, np.ndarray], index: np.ndarray, tape: dict | None = None) -> np.ndarray:
        """Of every window; x: inputs projected for both directions."""
        tapes = {d: [] if tape is not None else None for d in "fb"}
        h = np.concatenate([self.states(x[k], index, d, tapes[d]) for k, d in enumerate("fb")], axis=2)
        a = h @ self.p["v"]
        a[index.T < 0] = -30
        a = np.exp(a - a.max(axis=0))
        a /= a.sum(axis=0)
        c = (a[:, :, None] * h).sum(axis=0)
        if tape is not None:
            tape.update(h=h, a=a, c=c, tapes=tapes)
        return c @ self.p["w"] + self.p["b"]

    def projected(self, inputs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The last row stands for no word."""
        return tuple(np.append(inputs @ self.p[f"X{d}"] + self.p[f"c{d}"], np.zeros((1, 3 * HIDDEN), _f), axis=0) for d in "fb")

    def reads(self, x: np.ndarray, d: str, way: int) -> tuple[np.ndarray, np.ndarray]:
        """Attention and value (steps, windows) of one direction, for windows at each column of inputs x (3 * HIDDEN, words).

        The state is kept as columns, so a step of all windows reads one slice of x. Gates are tanh of half their input.
        """
        n, k = x.shape[1] - WINDOW + 1, HIDDEN
        u = np.concatenate([self.p[f"U{d}"].T * _f(0.5), self.p["v"][None, way * k : way * k + k], self.p["w"][None, way * k : way * k + k]])
        h, both, more = np.zeros((k, n), _f), np.zeros((3 * k + 2, n), _f), np.empty((k, n), _f)
        out = np.empty((2, WINDOW, n), _f)
        steps = range(WINDOW) if d == "f" else range(WINDOW - 1, -1, -1)
        zr, z, r, gn = both[: 2 * k], both[:k], both[k : 2 * k], both[2 * k : 3 * k]
        last = None
        for t in steps:
            if last is not None:
                np.matmul(u, h, out=both)
                out[:, last] = both[3 * k :]
            zr += x[: 2 * k, t : t + n]
            np.tanh(zr, out=zr)
            np.multiply(r, gn, out=more)
            more += gn
            more += x[2 * k :, t : t + n]
            np.tanh(more, out=more)
            h -= more
            z += _f(1)
            z *= _f(0.5)
            h *= z
            h += more
            last = t
        out[:, last] = u[3 * k :] @ h
        return out[0], out[1]

    def both(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Attention and value (steps, windows) of both directions; x (6 * HIDDEN, words): inputs projected for one and the other."""
        scale = np.repeat(np.array([0.5, 1], _f), [2 * HIDDEN, HIDDEN])[:, None]
        (a, c), (b, e) = (self.reads(x[way * 3 * HIDDEN :][: 3 * HIDDEN] * scale, d, way) for way, d in enumerate("fb"))
        a += b
        c += e
        return a, c

    def graph(self) -> bytes:
        """An ONNX model of `both`, unrolled; a step's rows of attention and of value follow each other in its output."""
        g, k, out = onnx_graph.Graph(), HIDDEN, {}
        axis = g.constant("axis", np.array([1], np.int64))
        spans = [(g.constant(f"from{t}", np.array([t], np.int64)), g.constant(f"to{t}", np.array([t - WINDOW + 1 or 2**62], np.int64))) for t in range(WINDOW)]
        for way, d in enumerate("fb"):
            gates, candidate = g.constant(f"gates_{d}", self.p[f"U{d}"][:, : 2 * k].T), g.constant(f"candidate_{d}", self.p[f"U{d}"][:, 2 * k :].T)
            ends = g.constant(f"ends_{d}", np.stack([self.p[n][way * k : way * k + k] for n in "vw"]))
            h = None
            for t in range(WINDOW) if d == "f" else range(WINDOW - 1, -1, -1):
                at = f"{d}{t}"
                xzr, xn = (g.node("Slice", [f"{name}_{d}", *spans[t], axis], f"{name}_{at}") for name in ("xzr", "xn"))
                g.node("Split", [g.node("Sigmoid", [g.node("Gemm", [gates, h, xzr], f"a_{at}") if h else xzr], f"zr_{at}")], f"z_{at}", f"r_{at}", axis=0)
                if h:
                    xn = g.node("Add", [xn, g.node("Mul", [f"r_{at}", g.node("MatMul", [candidate, h], f"u_{at}")], f"ru_{at}")], f"b_{at}")
                n = g.node("Tanh", [xn], f"n_{at}")
                if h:
                    h = g.node("Add", [n, g.node("Mul", [f"z_{at}", g.node("Sub", [h, n], f"hn_{at}")], f"zhn_{at}")], f"h_{at}")
                else:
                    h = g.node("Sub", [n, g.node("Mul", [f"z_{at}", n], f"zn_{at}")], f"h_{at}")
                out[at] = g.node("MatMul", [ends, h], f"e_{at}")
        g.node("Concat", [g.node("Add", [out[f"f{t}"], out[f"b{t}"]], f"e_{t}") for t in range(WINDOW)], "out", axis=0)
        return g.model([f"{name}_{d}" for d in "fb" for name in ("xzr", "xn")], ["out"])

    def runner(self) -> Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]] | None:
        """`both` by onnxruntime; None without it."""
        session, k = onnx_graph.session(self.graph()), HIDDEN

        def run(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            out = session.run(None, {"xzr_f": x[: 2 * k], "xn_f": x[2 * k : 3 * k], "xzr_b": x[3 * k : 5 * k], "xn_b": x[5 * k :]})[0]
            return out[0::2], out[1::2]

        return run if session else None

    def all_logits(self, words: Words, run: Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]] | None = None) -> np.ndarray:
        """Of every window of every text, in order; run: what reads the full ones, `both` if none is given."""
        x = self.projected(self.inputs(words))
        seq, starts, _ = sequence(words.docs)
        out = np.empty(len(starts), _f)
        full = seq[starts + WINDOW - 1] >= 0
        some = starts[~full]
        out[~full] = np.concatenate([self.logits(x, seq[some[k : k + 4096, None] + np.arange(WINDOW)]) for k in range(0, len(some), 4096)] or [np.empty(0, _f)])
        if not full.any():
            return out
        at = np.full(len(seq), -1, np.int64)
        at[starts[full]] = np.flatnonzero(full)
        table, size = np.concatenate(x, axis=1), GRAPH_BLOCK if run else BLOCK
        for k in range(0, len(seq) - WINDOW + 1, size):
            to = at[k : k + size][: len(seq) - WINDOW + 1 - k]
            here = seq[k : k + len(to) + WINDOW - 1]
            a, c = (run or self.both)(np.ascontiguousarray(table.take(here, axis=0).T))
            a = np.exp(a - a.max(axis=0))
            logit = (a * c).sum(axis=0) / a.sum(axis=0) + self.p["b"]
            out[to[to >= 0]] = logit[to >= 0]
        return out

    def gradients(self, words: Words, index: np.ndarray, y: np.ndarray, weight: np.ndarray) -> dict[str, np.ndarray]:
        """Of the mean weighted logistic loss, by backpropagation through time."""
        p, k = self.p, HIDDEN
        inputs = self.inputs(words)
        tape: dict = {}
        logit = self.logits(self.projected(inputs), index, tape)
        g = {n: np.zeros_like(v) for n, v in p.items()}
        d = ((_sigmoid(logit) - y) * weight / len(y)).astype(_f)
        h, a, c = tape["h"], tape["a"], tape["c"]
        g["w"], g["b"] = c.T @ d, np.array([d.sum()], _f)
        dc = d[:, None] * p["w"]
        dh = a[:, :, None] * dc
        da = (h * dc).sum(axis=2)
        ds = a * (da - (a * da).sum(axis=0))
        g["v"] = np.tensordot(ds, h, axes=((0, 1), (0, 1)))
        dh = dh + ds[:, :, None] * p["v"]
        din = np.zeros((len(inputs) + 1, inputs.shape[1]), _f)
        for part, way in ((slice(0, k), "f"), (slice(k, 2 * k), "b")):
            dx, back = np.zeros((len(inputs) + 1, 3 * k), _f), np.zeros((len(index), k), _f)
            for t, before, zr, n, ghn in reversed(tape["tapes"][way]):
                here = back + dh[t, :, part]
                gone = index[:, t : t + 1] < 0
                own = np.where(gone, 0, here)
                z, r = zr[:, :k], zr[:, k:]
                dz = own * (before - n) * z * (1 - z)
                dn = own * (1 - z) * (1 - n * n)
                dr = dn * ghn * r * (1 - r)
                np.add.at(dx, index[:, t], np.concatenate([dz, dr, dn], axis=1))
                dgh = np.concatenate([dz, dr, dn * r], axis=1)
                g[f"U{way}"] += before.T @ dgh
                back = np.where(gone, here, own * z) + dgh @ p[f"U{way}"].T
            dx[-1] = 0
            g[f"X{way}"], g[f"c{way}"] = inputs.T @ dx[:-1], dx.sum(axis=0)
            din += dx @ p[f"X{way}"].T
        np.add.at(g["E"], self.known(words.hashes), din[:-1, :WORD_DIM])
        sizes = np.diff(np.append(words.first, len(words.grams)))
        np.add.at(g["C"], words.grams, np.repeat(din[:-1, WORD_DIM:] / sizes[:, None], sizes, axis=0))
        return g


def _subset(words: Words, index: np.ndarray) -> tuple[Words, np.ndarray]:
    """Only the words of these windows, renumbered."""
    used, inverse = np.unique(index, return_inverse=True)
    inverse = inverse.reshape(index.shape) - (used[0] < 0)
    used = used[used >= 0]
    sizes = np.diff(np.append(words.first, len(words.grams)))[used]
    out = Words([])
    out.hashes, out.first = words.hashes[used], np.cumsum(sizes) - sizes
    out.grams = words.grams[np.arange(sizes.sum()) + np.repeat(words.first[used] - out.first, sizes)]
    return out, inverse.astype(np.int32)


def fit(texts: list[bytes], y: np.ndarray, odds: float | None = None) -> Network:
    """Trains on whole texts with labels y; odds: of label 1 in the population, if the sample's differ."""
    keep = [k for k, t in enumerate(texts) if t.split()]
    texts, y = [texts[k] for k in keep], y[keep].astype(_f)
    if len(y) == 0 or y.min() == y.max():
        net = Network.start(np.empty(0, np.uint64), np.empty(0, _f))
        net.calibration = (0.0, 0.0, float(np.log((y.sum() + 1) / (len(y) - y.sum() + 1))))
        return net
    words = Words(texts)
    seen = [np.unique(d) for d in words.docs]
    of = lambda c: np.bincount(np.concatenate([s for s, k in zip(seen, y, strict=True) if k == c]), minlength=len(words.hashes))
    one, none = of(1), of(0)
    lift = np.log((one + 0.5) / (y.sum() + 1)) - np.log((none + 0.5) / (len(y) - y.sum() + 1))
    lift *= (one + none) / (one + none + 4)
    often = np.flatnonzero(one + none >= 3)
    often = np.sort(often[np.argsort(-np.abs(lift[often]), kind="stable")[:WORDS]])
    net = Network.start(words.hashes[often], np.clip(lift[often], -4, 4).astype(_f))

    seq, starts, counts = sequence(words.docs)
    bounds = np.cumsum(counts) - counts
    rng = np.random.Generator(np.random.PCG64(4))
    rank = np.lib.stride_tricks.sliding_window_view(np.append(lift, -9)[seq], WINDOW).max(axis=1)[starts]
    moments = {n: (np.zeros_like(v), np.zeros_like(v)) for n, v in net.p.items()}
    step = 0
    for epoch in range(EPOCHS):
        if epoch:
            rank = net.all_logits(words, net.runner())
        top = np.array([b + rank[b : b + c].argmax() for b, c in zip(bounds, counts, strict=True)])
        some = rng.integers(0, counts[y == 0], (2, int((y == 0).sum()))) + bounds[y == 0]
        rows, goal = np.concatenate([top, some.ravel()]), np.concatenate([y, np.zeros(some.size, _f)])
        weight = np.where(goal == 1, len(goal) / 2 / goal.sum(), len(goal) / 2 / (len(goal) - goal.sum())).astype(_f)
        for _ in range(PASSES):
            order = rng.permutation(len(rows))
            for at in range(0, len(order), BATCH):
                part = order[at : at + BATCH]
                step += 1
                for n, grad in net.gradients(*_subset(words, seq[starts[rows[part], None] + np.arange(WINDOW)]), goal[part], weight[part]).items():
                    m, v = moments[n]
                    m += (grad - m) * _f(0.1)
                    v += (grad * grad - v) * _f(0.001)
                    net.p[n] -= _f(RATE * (1 - 0.999**step) ** 0.5 / (1 - 0.9**step)) * m / (np.sqrt(v) + _f(1e-6))
    # logistic regression on the greatest logit and the log of the number of windows
    rank = net.all_logits(words, net.runner())
    x = np.column_stack([np.maximum.reduceat(rank, bounds), np.log(counts), np.ones(len(y))]).astype(float)
    w = np.array([1.0, 0.0, 0.0])
    for _ in range(50):
        q = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        ridge = np.diag([0.5, 0.5, 0.01])
        w = w - np.linalg.solve((x * (q * (1 - q))[:, None]).T @ x + ridge, x.T @ (q - y) + ridge @ (w - [1, 0, 0]))
    shift = np.log(odds) - np.log(y.sum() / (len(y) - y.sum())) if odds else 0
    net.calibration = (float(w[0]), float(w[1]), float(w[2] + shift))
    return net


def scores(net: Network, texts: list[bytes]) -> np.ndarray:
    """0 to 1 of each text; one without words has the bias alone."""
    words = Words(texts)
    counts = sequence(words.docs)[2]
    logit = net.all_logits(words, net.runner())
    top = np.full(len(texts), net.p["b"][0], float)
    full = counts > 0
    if full.any():
        top[full] = np.maximum.reduceat(logit, (np.cumsum(counts) - counts)[full])
    slope, by_size, constant = net.calibration
    return 1 / (1 + np.exp(-np.clip(slope * top + by_size * np.log(np.maximum(counts, 1)) + constant, -50, 50)))


def _score_rows(net: Network):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, rows=batch.num_rows):
                yield pa.record_batch({"doc_id": part.column("doc_id"), "score": pa.array(scores(net, [t.lower() for t in utf8(part.column("text"))]))})

    return run


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", sample: int = SAMPLE) -> Network:
    """A network from at most `sample` labelled documents of each class, none of them held out.

    Null labels and ids name no document; an id with several labels has the greatest; an id of several rows gives one
    of them; null and empty texts are left out. Without labels, or with one class only, every score is a constant.
    """
    got = labelled(docs.select("doc_id", "text"), labels, label, MODULUS, HELD, sample).select("doc_id", "text", "y").toPandas().sort_values(["doc_id", "text"])
    whole = labels.where(F.col(label).isNotNull() & F.coalesce(F.crc32(F.col("doc_id").cast("string")) % MODULUS != HELD, F.lit(False))).agg(F.sum((F.col(label) > 0).cast("int")).alias("one"), F.count("*").alias("all")).first()
    odds = whole["one"] / (whole["all"] - whole["one"]) if whole["one"] and whole["one"] < whole["all"] else None
    return fit([(t or "").encode().lower() for t in got["text"]], got["y"].to_numpy(), odds)


def score(docs: DataFrame, net: Network) -> DataFrame:
    """(doc_id, held_out, score, predicted) per row, whatever columns stand beside.

    A null text scores as an empty one: the bias alone. A very long text is scored over all its windows; equal texts
    score alike; rows that repeat an id, or have none, each come back (held_out is false without an id). An empty
    table gives no rows.
    """
    bounded(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(lean(_score_rows(net)), "doc_id long, score double")
    return rows.select("doc_id", held_out("doc_id", MODULUS, HELD).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
