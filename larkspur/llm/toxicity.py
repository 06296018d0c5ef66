"""Toxicity by a bidirectional gated recurrent network with attention pooling, in numpy.

A text's words, in overlapping windows, are the steps. A step's input is the sum of its word's embedding and
of the mean embedding of the word's character n-grams; both are rows of hashed tables. Two gated recurrent
units read the window, one from either end; attention over their states pools it, and a logistic unit scores
it. A text's score is that of its worst window. Training is by Adam on windows of labelled texts; in a
toxic text only the window that scores worst counts as toxic, as the label doesn't say where it is.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from larkspur.llm.labelled import SAMPLE_BYTES, labelled_texts, learnt_in_one_task
from larkspur.llm.storage import bounded
from larkspur.llm.textkit import NON_ALPHANUMERIC, Words, chunks, find_words, mix, powers, ranges

#: Words of a window, and from one window's start to the next's, alike when texts are learnt from and when they are scored.
WINDOW, STRIDE = 24, 12
#: Widths of the inputs and of each direction's state, and rows of the two hashed tables.
WIDTH, STATE, WORD_ROWS, CHAR_ROWS = 8, 8, 1 << 14, 1 << 15
#: Most labelled rows of each class that are learnt from, chosen by a hash of their ids. Each is learnt from whole.
SAMPLE = 2000
#: Lengths, in bytes, of the character n-grams, which are taken all over a word.
_GRAMS = (3, 4, 5)


@dataclass
class Lexicon:
    """Distinct words: the row of each in the word table, and the rows of its character n-grams, one word's after another's."""

    word: np.ndarray
    grams: np.ndarray
    first: np.ndarray  # of each word's n-grams, and the total last

    def some(self, which: np.ndarray) -> Lexicon:
        counts = np.diff(self.first)[which]
        at = np.repeat(self.first[which], counts) + ranges(counts)
        return Lexicon(self.word[which], self.grams[at], np.concatenate(([0], np.cumsum(counts))))

    def share(self) -> np.ndarray:
        """What each n-gram counts in the mean of its word's."""
        counts = np.diff(self.first)
        return np.repeat(1 / np.maximum(counts, 1), counts).astype(np.float32)[:, None]


def lexicon(words: Words) -> tuple[Lexicon, np.ndarray]:
    """The distinct words, and which of them each word is."""
    _, at, number = np.unique(words.hashes(), return_index=True, return_inverse=True)
    data, start, end = words.data, words.start[at], words.end[at]
    up, down = powers(len(data) + 1)
    total = np.empty(len(data) + 1, dtype=np.uint64)
    total[0] = 0
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=total[1:])

    def rows(low: np.ndarray, high: np.ndarray, salt: int, size: int) -> np.ndarray:
        return (mix((total[high] - total[low]) * down[low] + np.uint64(salt)) % np.uint64(size)).astype(np.int32)

    owners, grams = [], []
    for n in _GRAMS:
        counts = np.maximum(end - start - n + 1, 0)
        owner = np.repeat(np.arange(len(start)), counts)
        low = start[owner] + ranges(counts)
        owners.append(owner)
        grams.append(rows(low, low + n, 100 + n, CHAR_ROWS))
    owner = np.concatenate(owners)
    order = np.argsort(owner, kind="stable")
    first = np.concatenate(([0], np.cumsum(np.bincount(owner, minlength=len(start)))))
    return Lexicon(rows(start, end, 1, WORD_ROWS), np.concatenate(grams)[order], first), number.reshape(-1)


def window_starts(first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text, first word) of all windows: STRIDE apart, the last one up to the text's end; texts without words have none."""
    count = np.diff(first)
    n = np.where(count > 0, np.maximum(1, -(-(count - WINDOW) // STRIDE) + 1), 0)
    doc = np.repeat(np.arange(len(count)), n)
    return doc, first[doc] + ranges(n) * STRIDE


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return np.float32(0.5) * np.tanh(np.float32(0.5) * x) + np.float32(0.5)


@dataclass
class Network:
    """All parameters by name."""

    p: dict[str, np.ndarray]
    slope: float = 1.0
    shift: float = 0.0

    @classmethod
    def new(cls, seed: int = 5) -> Network:
        rng = np.random.default_rng(seed)
        make = lambda *shape, by: (rng.standard_normal(shape) * by).astype(np.float32)
        # what isn't learnt says nothing
        p = {"word": np.zeros((WORD_ROWS, WIDTH), np.float32), "char": np.zeros((CHAR_ROWS, WIDTH), np.float32)}
        for d in "fb":
            p |= {f"x{d}": make(WIDTH, 3 * STATE, by=0.4), f"b{d}": np.zeros(3 * STATE, np.float32), f"h{d}": make(STATE, 3 * STATE, by=0.3)}
        return cls(p | {"attend": make(2 * STATE, STATE, by=0.4), "query": make(STATE, by=0.4), "out": make(2 * STATE, by=0.4), "bias": np.full(1, -1, np.float32)})

    def embed(self, lex: Lexicon) -> np.ndarray:
        """The input that each word of lex makes."""
        out = self.p["word"][lex.word]
        has, share = np.flatnonzero(np.diff(lex.first)), lex.share()
        for k in range(0, len(has), 1 << 14):
            some = has[k : k + (1 << 14)]
            low, high = lex.first[some[0]], lex.first[some[-1] + 1]
            out[some] += np.add.reduceat(self.p["char"][lex.grams[low:high]] * share[low:high], lex.first[some] - low)
        return out

    def _run(self, d: str, x: np.ndarray, mask: np.ndarray, keep: list | None) -> np.ndarray:
        """States of one direction for inputs projected already: x (steps, windows, 3 * STATE), mask (steps, windows, 1)."""
        steps, n, _ = x.shape
        h, U, out = np.zeros((n, STATE), np.float32), self.p[f"h{d}"], np.empty((steps, n, STATE), np.float32)
        for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
            u = h @ U
            gates = _sigmoid(x[t, :, : 2 * STATE] + u[:, : 2 * STATE])
            z, r = gates[:, :STATE], gates[:, STATE:]
            c = np.tanh(x[t, :, 2 * STATE :] + r * u[:, 2 * STATE :])
            new = h + mask[t] * z * (c - h)
            if keep is not None:
                keep.append((t, h, u, z, r, c))
            h = out[t] = new
        return out

    def forward(self, inputs: dict[str, np.ndarray], mask: np.ndarray, keep: dict | None = None) -> np.ndarray:
        """Logits of windows: inputs by direction (steps, windows, 3 * STATE), mask (steps, windows, 1)."""
        tapes = {d: [] if keep is not None else None for d in "fb"}
        states = np.concatenate([self._run(d, inputs[d], mask, tapes[d]) for d in "fb"], axis=2)
        a = np.tanh(states @ self.p["attend"])
        e = np.where(mask[:, :, 0] > 0, a @ self.p["query"], np.float32(-1e9))
        e = np.exp(e - e.max(axis=0))
        weight = e / e.sum(axis=0)
        pooled = np.einsum("tn,tnk->nk", weight, states)
        if keep is not None:
            keep |= {"tapes": tapes, "states": states, "a": a, "weight": weight, "pooled": pooled}
        return pooled @ self.p["out"] + self.p["bias"][0]

    def window_logits(self, x: np.ndarray, number: np.ndarray, first: np.ndarray, doc: np.ndarray, start: np.ndarray) -> np.ndarray:
        """Logits of windows (text, first word) of texts whose words are given as rows of x."""
        projected = {d: x @ self.p[f"x{d}"] + self.p[f"b{d}"] for d in "fb"}
        out, size = np.empty(len(doc), np.float32), 2048
        for k in range(0, len(doc), size):
            at = start[k : k + size] + np.arange(WINDOW)[:, None]
            inside = at < first[doc[k : k + size] + 1]
            at = number[np.where(inside, at, 0)]
            out[k : k + size] = self.forward({d: projected[d][at] for d in "fb"}, inside[:, :, None].astype(np.float32))
        return out

    def logits(self, words: Words) -> tuple[np.ndarray, np.ndarray]:
        """(text, logit) of all windows of the texts."""
        doc, start = window_starts(words.first)
        if not len(doc):
            return doc, np.zeros(0, np.float32)
        lex, number = lexicon(words)
        return doc, self.window_logits(self.embed(lex), number, words.first, doc, start)

    def scores(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """The score of each text's worst window; a text without words scores as the least a window could."""
        doc, logit = self.logits(find_words(data, offsets, NON_ALPHANUMERIC, lower=True))
        worst = np.full(len(offsets) - 1, -30.0)
        np.maximum.at(worst, doc, logit.astype(np.float64))
        return 1 / (1 + np.exp(-np.clip(self.slope * worst + self.shift, -40, 40)))

    def gradient(self, lex: Lexicon, at: np.ndarray, inside: np.ndarray, target: np.ndarray, weight: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Loss and gradients for windows: at (steps, windows), numbers of words in lex; inside, of the same shape."""
        p, (steps, n) = self.p, at.shape
        mask = inside[:, :, None].astype(np.float32)
        used, number = np.unique(at, return_inverse=True)
        lex, number = lex.some(used), number.reshape(-1)
        x = self.embed(lex)[number].reshape(steps, n, WIDTH)
        kept: dict = {}
        logit = self.forward({d: x @ p[f"x{d}"] + p[f"b{d}"] for d in "fb"}, mask, kept)
        prob = _sigmoid(logit)
        loss = float(-(weight * (target * np.log(prob + 1e-7) + (1 - target) * np.log(1 - prob + 1e-7))).mean())
        g: dict[str, np.ndarray] = {}
        top = (weight * (prob - target) / n).astype(np.float32)
        g["bias"], g["out"] = top.sum(keepdims=True), kept["pooled"].T @ top
        pooled = top[:, None] * p["out"]
        states, a, w = kept["states"], kept["a"], kept["weight"]
        d_states = w[:, :, None] * pooled
        d_w = np.einsum("nk,tnk->tn", pooled, states)
        d_e = w * (d_w - (w * d_w).sum(axis=0))
        g["query"] = np.einsum("tn,tnk->k", d_e, a)
        d_a = d_e[:, :, None] * p["query"] * (1 - a * a)
        g["attend"] = np.einsum("tnj,tnk->jk", states, d_a)
        d_states = d_states + d_a @ p["attend"].T
        d_x = np.zeros_like(x)
        for i, d in enumerate("fb"):
            U, own = p[f"h{d}"], d_states[:, :, i * STATE : (i + 1) * STATE]
            d_h, g_u, d_in = np.zeros((n, STATE), np.float32), np.zeros_like(U), np.zeros((steps, n, 3 * STATE), np.float32)
            for t, h, u, z, r, c in reversed(kept["tapes"][d]):
                d_h = d_h + own[t]
                m = mask[t]
                d_z = d_h * m * (c - h) * z * (1 - z)
                d_c = d_h * m * z * (1 - c * c)
                d_r = d_c * u[:, 2 * STATE :] * r * (1 - r)
                d_in[t] = np.concatenate((d_z, d_r, d_c), axis=1)
                d_u = np.concatenate((d_z, d_r, d_c * r), axis=1)
                g_u += h.T @ d_u
                d_h = d_h * (1 - m * z) + d_u @ U.T
            g[f"h{d}"], g[f"b{d}"] = g_u, d_in.sum(axis=(0, 1))
            g[f"x{d}"] = np.einsum("tnj,tnk->jk", x, d_in)
            d_x += d_in @ p[f"x{d}"].T
        d_x = (d_x * mask).reshape(-1, WIDTH)

        def summed(rows: np.ndarray, values: np.ndarray, size: int) -> np.ndarray:
            return np.stack([np.bincount(rows, values[:, k], minlength=size) for k in range(WIDTH)], axis=1).astype(np.float32)

        d_x = summed(number, d_x, len(used))
        g["word"] = summed(lex.word, d_x, WORD_ROWS)
        g["char"] = summed(lex.grams, np.repeat(d_x, np.diff(lex.first), axis=0) * lex.share(), CHAR_ROWS)
        return loss, g


class Adam:
    """Adam's steps; table rows that took no part stay as they are."""

    def __init__(self, p: dict[str, np.ndarray], rate: float = 0.01):
        self.p, self.rate, self.t = p, rate, 0
        self.m, self.v = ({k: np.zeros_like(x) for k, x in p.items()} for _ in range(2))

    def step(self, g: dict[str, np.ndarray]) -> None:
        self.t += 1
        fix = np.sqrt(1 - 0.999**self.t) / (1 - 0.9**self.t)
        for k, x in g.items():
            at = np.flatnonzero(x.any(axis=1)) if k in ("word", "char") else slice(None)
            self.m[k][at] = 0.9 * self.m[k][at] + 0.1 * x[at]
            self.v[k][at] = 0.999 * self.v[k][at] + 0.001 * x[at] ** 2
            self.p[k][at] -= (self.rate * fix) * self.m[k][at] / (np.sqrt(self.v[k][at]) + 1e-7)


def fit(lex: Lexicon, number: np.ndarray, first: np.ndarray, label: np.ndarray, share: float | None = None, epochs: int = 9, batch: int = 192, seed: int = 3) -> Network:
    """A network learnt from texts: number says which word of lex each of their words is, first where each text begins.

    Every epoch but the first few, the window of each text that scores worst at its beginning stands for the
    text, and with it the next worst windows of clean texts. Every eighth text is kept apart; a logistic curve
    over these texts' worst windows makes the scores probabilities. share: of toxic texts among
    all, by default as among the given.
    """
    net, rng = Network.new(seed), np.random.default_rng(seed)
    texts = len(label)
    if not len(number) or len(np.unique(label)) < 2:
        only = float(label.mean()) if len(label) else 0.0
        net.p["out"][:] = 0
        net.p["bias"][:] = np.log((only + 0.05) / (1.05 - only))
        return net
    doc, start = window_starts(first)
    steps = np.arange(WINDOW)[:, None]
    apart = (np.arange(texts) % 8 == 0) if texts >= 64 else np.zeros(texts, dtype=bool)
    learnt = np.flatnonzero(~apart[doc])
    adam = Adam(net.p)
    # few texts are met more often, in smaller batches
    batch = min(batch, max(32, texts // 4))
    epochs = max(epochs, -(-400 * batch // (4 * texts)))

    def worst(doc: np.ndarray, logit: np.ndarray) -> np.ndarray:
        order = np.lexsort((-logit, doc))
        return order[np.concatenate(([True], doc[order][1:] != doc[order][:-1]))]

    for epoch in range(epochs):
        if epoch < max(2, epochs // 4):  # nothing is known yet: windows at random, several of each text, all with their text's label
            some = rng.permutation(learnt)[: 12 * texts]
        else:
            logit = net.window_logits(net.embed(lex), number, first, doc, start)
            clean = learnt[label[doc[learnt]] == 0]
            clean = clean[np.argsort(-logit[clean])[: 2 * texts]]
            some = worst(doc, logit)
            some = rng.permutation(np.unique(np.concatenate((some[~apart[doc[some]]], clean, rng.choice(learnt[label[doc[learnt]] == 0], texts)))))
        adam.rate = 0.01 if epoch < epochs - 3 else 0.002
        for k in range(0, len(some), batch):
            part = some[k : k + batch]
            y = label[doc[part]].astype(np.float32)
            at = start[part] + steps
            inside = at < first[doc[part] + 1]
            _, g = net.gradient(lex, number[np.where(inside, at, 0)], inside, y, np.ones(len(part), np.float32))
            adam.step(g)
    if apart.any():
        doc, start = doc[apart[doc]], start[apart[doc]]
    logit = net.window_logits(net.embed(lex), number, first, doc, start)
    judged = worst(doc, logit)
    y, given = label[doc[judged]], label.mean()
    share = given if share is None else share
    net.slope, net.shift = _curve(logit[judged].astype(np.float64), y, np.where(y == 1, share / given, (1 - share) / (1 - given)))
    return net


def _curve(logit: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope and shift of a weighted logistic regression, held near (1, 0) by a small penalty."""
    a, b = 1.0, 0.0
    target = np.where(y == 1, 0.99, 0.01)
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(a * logit + b, -40, 40)))
        g = np.array([(weight * (p - target) * logit).sum() + (a - 1), (weight * (p - target)).sum() + 0.1 * b])
        h = weight * np.maximum(p * (1 - p), 1e-4)
        hess = np.array([[(h * logit * logit).sum() + 1, (h * logit).sum()], [(h * logit).sum(), h.sum() + 0.1]])
        step = np.linalg.solve(hess, g)
        step *= min(1.0, 1 / np.abs(step).max())
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-6:
            break
    return float(max(a, 1e-2)), float(b)


def learn(texts: pa.Array, label: np.ndarray, share: float | None = None) -> Network:
    """The network of labelled texts; share: of toxic ones among all."""
    lexicons, numbers, counts, words_before = [], [], [], 0
    for _, _, data, offsets in chunks(texts):
        words = find_words(data, offsets, NON_ALPHANUMERIC, lower=True)
        counts.append(np.diff(words.first))
        if len(words.start):
            lex, number = lexicon(words)
            lexicons.append(lex)
            numbers.append((number + words_before).astype(np.int32))
            words_before += len(lex.word)
    if not lexicons:
        return fit(Lexicon(np.zeros(0, np.int32), np.zeros(0, np.int32), np.zeros(1, np.int64)), np.zeros(0, np.int32), np.zeros(1, np.int64), label)
    grams = np.concatenate([x.grams for x in lexicons])
    first = np.concatenate(([0], np.cumsum(np.concatenate([np.diff(x.first) for x in lexicons]))))
    lex = Lexicon(np.concatenate([x.word for x in lexicons]), grams, first)
    return fit(lex, np.concatenate(numbers), np.concatenate(([0], np.cumsum(np.concatenate(counts)))), label, share)


def train(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text", label_column: str = "toxic", sample: int = SAMPLE, sample_bytes: int = SAMPLE_BYTES) -> Network:
    """A network of at most `sample` labelled texts of each class and sample_bytes of both, those whose ids hash lowest, each learnt from whole.

    Which rows are left out, and what counts where ids or labels are repeated, labelled_texts() says. With labels of one class, or
    none, also of empty tables, every text gets about the same score. One task holds the sample: its texts, and about
    8 bytes for each of their words.
    """
    rows, share = labelled_texts(docs, labels, id_column, text_column, label_column, sample, sample_bytes)
    return learnt_in_one_task(bounded(rows), lambda texts, label: learn(texts, label, share))
