"""Toxicity: a bidirectional gated recurrent network with attention pooling, trained and run in numpy.

A word enters as the sum of a word vector and the mean of its character n-gram vectors, both by hash. A window of
words goes through two gated recurrent layers, one from each end; attention pools their states to one number.
A text is scored over all windows, each overlapping the next, and takes the highest.

Labels mark whole texts, not windows. Learning therefore goes in rounds: choose the window that speaks most for the
label (first by odds of its n-grams, then by the network itself), learn on the chosen windows, choose again. Where a
score passes one half is set by texts that the network scoring them has not learned from.
"""

from __future__ import annotations

import pickle
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from maskweave.llm.common import held_out

#: Words that are worked on at once, where each has all of its n-grams beside it.
PART = 4_000
TRIM = ".,;:!?\"'()[]{}<>*#|"


@dataclass(frozen=True)
class ToxicityRules:
    """window: words; stride: words between windows; rows: most labelled texts of a class that are taken, chosen by a
    hash of the id; characters: longest text that is learned from, cut_characters: longest that helps to place the cut (all
    texts are scored whole); doubt: standard errors taken off the odds of an n-gram; hard_windows: most windows of clean
    texts that score over one half and are learned from again, drawn evenly from all of them; folds: parts of the sample
    scored by networks learned on the others, to place the cut (1: none, the time of learning grows with them); spare: what a clean text marked costs against a toxic one
    missed, in shares of each."""

    window: int = 24
    stride: int = 16
    vector: int = 24
    hidden: int = 8
    attention: int = 8
    word_bits: int = 18
    gram_bits: int = 18
    word_scale: float = 0.01
    gram_scale: float = 0.02
    rows: int = 2500
    characters: int = 8_000
    cut_characters: int = 100_000
    doubt: float = 1.5
    rounds: int = 3
    epochs: int = 2
    batch: int = 192
    least_steps: int = 30
    rate: float = 0.01
    seed: int = 11
    hard_windows: int = 20_000
    folds: int = 1
    spare: float = 2.0

    def __post_init__(self):
        if not 0 < self.stride <= self.window:
            raise ValueError("windows must overlap or meet")


def _slots(words: list[str], rules: ToxicityRules, part: int = 20_000) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For distinct words: word slot, flat n-gram slots (3 to 5 characters, ends marked), and where each word's start.
    Words are taken in parts, so that memory beyond the answer is bounded."""
    some = [_slots_of(words[a : a + part], rules) for a in range(0, len(words), part)] or [_slots_of([], rules)]
    counts = np.concatenate([c for _, _, c in some])
    return np.concatenate([w for w, _, _ in some]), np.concatenate([g for _, g, _ in some]), np.append(0, np.cumsum(counts))


def _slots_of(words: list[str], rules: ToxicityRules) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    marked = [f"<{w.lower().strip(TRIM) or '-'}>" for w in words]
    lengths = np.fromiter(map(len, marked), np.int64, len(marked))
    codes = np.frombuffer("".join(marked).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    ends = np.cumsum(lengths)
    starts = ends - lengths
    word_of = np.repeat(np.arange(len(marked)), lengths)
    left = np.repeat(ends, lengths) - np.arange(len(codes))  # characters from here to the word's end
    prime = np.uint64(0x100000001B3)
    slots, owners = [], []
    with np.errstate(over="ignore"):
        running = np.zeros(len(codes), np.uint64)
        padded = np.concatenate([codes, np.zeros(8, np.uint64)])
        for n in range(5):
            running = (running ^ padded[n : n + len(codes)]) * prime + np.uint64(n)
            if n >= 2:
                keep = left > n
                h = running[keep]
                slots.append(((h ^ (h >> np.uint64(29))) * prime >> np.uint64(64 - rules.gram_bits)).astype(np.int64))
                owners.append(word_of[keep])
        # The whole word: a sum over its characters and places.
        place = np.arange(len(codes), dtype=np.uint64) - np.repeat(starts, lengths).astype(np.uint64)
        each = (codes + np.uint64(31)) * (place * np.uint64(0x9E3779B97F4A7C15) + prime)
        whole = np.add.reduceat(each ^ (each >> np.uint64(31)), starts) if len(starts) else np.empty(0, np.uint64)
        whole = (whole * prime >> np.uint64(64 - rules.word_bits)).astype(np.int64)
    grams, owner = np.concatenate(slots), np.concatenate(owners)
    order = np.argsort(owner, kind="stable")
    return whole.astype(np.int32), grams[order].astype(np.int32), np.bincount(owner, minlength=len(words))


def windows_of(lengths: list[int], rules: ToxicityRules) -> tuple[np.ndarray, np.ndarray]:
    """For texts of these many words, laid end to end: word numbers of all windows (-1 beyond the text), and each
    window's text. Every word of every text is in a window; a text without words has none."""
    spans, owners, at = [], [], 0
    for k, n in enumerate(lengths):
        if n:
            starts = np.arange(0, max(1, n - rules.window + rules.stride), rules.stride)
            span = starts[:, None] + np.arange(rules.window)
            spans.append(np.where(span < n, span + at, -1).astype(np.int32))
            owners.append(np.full(len(starts), k, np.int32))
        at += n
    if not spans:
        return np.empty((0, rules.window), np.int32), np.empty(0, np.int32)
    return np.concatenate(spans), np.concatenate(owners)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


class Network:
    """Weights and both passes. Arrays are float32."""

    def __init__(self, rules: ToxicityRules):
        self.rules = rules
        rng = np.random.default_rng(rules.seed)
        d, h, a = rules.vector, rules.hidden, rules.attention

        def small(*shape, scale):
            return (rng.standard_normal(shape) * scale).astype(np.float32)

        self.w = {
            "words": small(1 << rules.word_bits, d, scale=rules.word_scale),
            "grams": small(1 << rules.gram_bits, d, scale=rules.gram_scale),
            "attend": small(2 * h, a, scale=0.3),
            "attend_bias": np.zeros(a, np.float32),
            "query": small(a, scale=0.3),
            "out": small(2 * h, scale=0.3),
            "bias": np.zeros(1, np.float32),
        }
        for side in "fb":
            self.w[f"in_{side}"] = small(d, 3 * h, scale=d**-0.5)
            self.w[f"rec_{side}"] = small(h, 3 * h, scale=h**-0.5)
            self.w[f"in_bias_{side}"] = np.zeros(3 * h, np.float32)
        self.moments = {k: [np.zeros_like(v), np.zeros_like(v)] for k, v in self.w.items()}
        self.steps = 0

    @classmethod
    def of(cls, rules: ToxicityRules, tables: dict[str, np.ndarray]) -> Network:
        """A network that has learned already."""
        net = cls.__new__(cls)
        net.rules, net.w, net.moments, net.steps = rules, tables, {}, 0
        return net

    def vectors(self, slots) -> np.ndarray:
        """A vector per distinct word, in parts of bounded size."""
        whole, grams, at = slots
        out = np.empty((len(whole), self.rules.vector), np.float32)
        for a in range(0, len(whole), PART):
            b = min(a + PART, len(whole))
            sums = np.add.reduceat(self.w["grams"][grams[at[a] : at[b]]].astype(np.float32, copy=False), at[a:b] - at[a], axis=0)
            out[a:b] = self.w["words"][whole[a:b]] + sums / (at[a + 1 : b + 1] - at[a:b])[:, None].astype(np.float32)
        return out

    def _side(self, gates_in, index, mask, side, keep):
        """States of one direction, (time, window, hidden)."""
        h = self.rules.hidden
        rec = self.w[f"rec_{side}"]
        state = np.zeros((index.shape[0], h), np.float32)
        states = np.empty((index.shape[1], index.shape[0], h), np.float32)
        saved = []
        steps = range(index.shape[1]) if side == "f" else range(index.shape[1] - 1, -1, -1)
        for t in steps:
            x = gates_in[index[:, t]]
            r = state @ rec
            zr = _sigmoid(x[:, : 2 * h] + r[:, : 2 * h])
            z, reset = zr[:, :h], zr[:, h:]
            new = np.tanh(x[:, 2 * h :] + reset * r[:, 2 * h :])
            nxt = new + z * (state - new)
            m = mask[:, t, None]
            if keep:
                saved.append((t, state, z, reset, new, r[:, 2 * h :], m))
            state = nxt * m
            states[t] = state
        return states, saved

    def finish(self) -> None:
        """Ends learning: drops what only steps need and halves the tables, which travel to all tasks."""
        self.moments = {}
        for name in ("words", "grams"):
            self.w[name] = self.w[name].astype(np.float16)

    def gates(self, vectors) -> list[np.ndarray]:
        """What each distinct word gives to the gates, forwards and backwards."""
        return [vectors @ self.w[f"in_{side}"] + self.w[f"in_bias_{side}"] for side in "fb"]

    def forward(self, gates, index, mask, keep=False):
        """Logits of windows. ``index`` holds rows of ``gates``."""
        sides, saved = [], []
        for side, gates_in in zip("fb", gates, strict=True):
            states, kept = self._side(gates_in, index, mask, side, keep)
            sides.append(states)
            saved.append(kept)
        states = np.concatenate(sides, axis=2)
        hidden = np.tanh(states @ self.w["attend"] + self.w["attend_bias"])
        energy = hidden @ self.w["query"] - 1e4 * (1 - mask.T)
        energy = np.exp(energy - energy.max(axis=0))
        share = energy / energy.sum(axis=0)
        pooled = np.einsum("tw,twh->wh", share, states)
        logit = pooled @ self.w["out"] + self.w["bias"]
        return (logit, (states, hidden, share, pooled, saved)) if keep else logit

    def logits(self, vectors, spans, word_ids) -> np.ndarray:
        out, gates = np.empty(len(spans), np.float32), self.gates(vectors)
        for a in range(0, len(spans), 4096):
            span = spans[a : a + 4096]
            mask = (span >= 0).astype(np.float32)
            out[a : a + 4096] = self.forward(gates, word_ids[np.maximum(span, 0)], mask)
        return out

    def step(self, slots, index, mask, target, weight) -> float:
        """One step of learning on a batch of windows; ``slots`` are those of its distinct words."""
        w, h = self.w, self.rules.hidden
        vectors = self.vectors(slots)
        logit, (states, hidden, share, pooled, saved) = self.forward(self.gates(vectors), index, mask, keep=True)
        p = _sigmoid(logit)
        d_logit = ((p - target) * weight / weight.sum()).astype(np.float32)
        g = {"out": pooled.T @ d_logit, "bias": d_logit.sum(keepdims=True)}
        d_pooled = d_logit[:, None] * w["out"]
        d_share = np.einsum("wh,twh->tw", d_pooled, states)
        d_states = share[:, :, None] * d_pooled
        d_energy = share * (d_share - (share * d_share).sum(axis=0))
        g["query"] = np.einsum("tw,twa->a", d_energy, hidden)
        d_hidden = d_energy[:, :, None] * w["query"] * (1 - hidden**2)
        g["attend"] = np.einsum("twh,twa->ha", states, d_hidden)
        g["attend_bias"] = d_hidden.sum(axis=(0, 1))
        d_states += d_hidden @ w["attend"].T
        d_vectors = np.zeros_like(vectors)
        for k, side in enumerate("fb"):
            d_gates = np.zeros((len(vectors), 3 * h), np.float32)
            d_rec = np.zeros_like(w[f"rec_{side}"])
            carry = np.zeros((index.shape[0], h), np.float32)
            for t, state, z, reset, new, r_new, m in reversed(saved[k]):
                d = (carry + d_states[t, :, k * h : (k + 1) * h]) * m
                d_new = d * (1 - z) * (1 - new**2)
                d_z = d * (state - new) * z * (1 - z)
                d_reset = d_new * r_new * reset * (1 - reset)
                d_in = np.concatenate([d_z, d_reset, d_new], axis=1)
                d_r = np.concatenate([d_z, d_reset, d_new * reset], axis=1)
                np.add.at(d_gates, index[:, t], d_in)
                d_rec += state.T @ d_r
                carry = d * z + d_r @ w[f"rec_{side}"].T
            g[f"rec_{side}"] = d_rec
            g[f"in_{side}"] = vectors.T @ d_gates
            g[f"in_bias_{side}"] = d_gates.sum(axis=0)
            d_vectors += d_gates @ w[f"in_{side}"].T
        whole, grams, at = slots
        counts = np.diff(at)
        self.steps += 1
        self._update("words", np.unique(whole), _summed(whole, d_vectors))
        spread = np.repeat(d_vectors / counts[:, None].astype(np.float32), counts, axis=0)
        self._update("grams", np.unique(grams), _summed(grams, spread))
        for name, grad in g.items():
            self._update(name, slice(None), grad)
        return float(-(target * np.log(p + 1e-7) + (1 - target) * np.log(1 - p + 1e-7)).mean())

    def _update(self, name, rows, grad):
        m, v = self.moments[name]
        m[rows] = 0.9 * m[rows] + 0.1 * grad
        v[rows] = 0.99 * v[rows] + 0.01 * grad**2
        scale = self.rules.rate / (1 - 0.9**self.steps)
        self.w[name][rows] -= scale * m[rows] / (np.sqrt(v[rows] / (1 - 0.99**self.steps)) + 1e-6)


def _summed(slots: np.ndarray, grad: np.ndarray) -> np.ndarray:
    """Rows of ``grad`` summed by slot, in the order of the distinct slots."""
    order = np.argsort(slots, kind="stable")
    starts = np.flatnonzero(np.diff(slots[order], prepend=-1))
    return np.add.reduceat(grad[order], starts, axis=0)


def _numbered(texts: list[str | None]) -> tuple[list[str], np.ndarray, list[int]]:
    """Distinct words, the words of all texts as numbers, and the texts' lengths."""
    known: dict[str, int] = {}
    ids = [np.fromiter((known.setdefault(w, len(known)) for w in (t or "").split()), np.int32) for t in texts]
    return list(known), np.concatenate(ids) if ids else np.empty(0, np.int32), [len(x) for x in ids]


@dataclass
class Model:
    network: Network | None
    shift: float = 0.0
    prior: float = 0.0

    def scores(self, texts: list[str | None]) -> np.ndarray:
        """The highest window's score per text; a text without words gets the lowest."""
        if self.network is None:
            return np.full(len(texts), self.prior)
        out = np.full(len(texts), -30.0)
        words, ids, lengths = _numbered(texts)
        if words:
            spans, owners = windows_of(lengths, self.network.rules)
            vectors = self.network.vectors(_slots(words, self.network.rules))
            np.maximum.at(out, owners, self.network.logits(vectors, spans, ids).astype(np.float64))
        return 1 / (1 + np.exp(-np.clip(out + self.shift, -30, 30)))


class _Sample:
    """Labelled texts as windows of word numbers."""

    def __init__(self, texts: list[str], labels: list[int], rules: ToxicityRules):
        self.rules = rules
        words, self.ids, self.lengths = _numbered(texts)
        self.spans, self.owners = windows_of(self.lengths, rules)
        self.target = np.asarray(labels, np.float32)
        self.slots = _slots(words, rules)
        self.counts = np.diff(self.slots[2])
        self.first = np.flatnonzero(np.diff(self.owners, prepend=-1))
        self.has = self.owners[self.first]  # texts with a window

    def _picks(self, used: np.ndarray) -> np.ndarray:
        """Places of the n-grams of these words."""
        if not len(used):
            return np.empty(0, np.int32)
        counts = self.counts[used]
        ends = np.cumsum(counts)
        out = np.ones(int(ends[-1]), np.int32)  # steps from place to place, then their sums
        out[0] = self.slots[2][used[0]]
        out[ends[:-1]] = self.slots[2][used[1:]] - self.slots[2][used[:-1] + 1] + 1
        return np.cumsum(out, dtype=np.int32, out=out)

    def local(self, span: np.ndarray) -> tuple[tuple[np.ndarray, np.ndarray, np.ndarray], np.ndarray]:
        """Slots of the distinct words of some windows, and the windows as numbers of these words."""
        used, index = np.unique(self.ids[np.maximum(span, 0)], return_inverse=True)
        whole, grams, _ = self.slots
        return (whole[used], grams[self._picks(used)], np.append(0, np.cumsum(self.counts[used]))), index.reshape(span.shape)

    def logits(self, net: Network, spans: np.ndarray, part: int = 16_384) -> np.ndarray:
        """Logits of windows, some at a time, so that only vectors of their words are held."""
        out = np.empty(len(spans), np.float32)
        for a in range(0, len(spans), part):
            span = spans[a : a + part]
            slots, index = self.local(span)
            at = np.where(span >= 0, np.arange(span.size).reshape(span.shape), -1)
            out[a : a + part] = net.logits(net.vectors(slots), at, index.ravel())
        return out

    def highest(self, net: Network) -> np.ndarray:
        """The highest window's logit of each text that has one."""
        return np.maximum.reduceat(self.logits(net, self.spans), self.first)

    def both(self, part: np.ndarray) -> bool:
        return len({*self.target[self.has[part[self.has]]].tolist()}) == 2

    def _odds(self, part: np.ndarray) -> np.ndarray:
        """The highest odds of a word's n-grams, by the texts of each class that hold them, less some standard errors: an
        n-gram of a few texts says less than one of many."""
        rules, (_, grams, at) = self.rules, self.slots
        seen, texts = np.zeros((2, 1 << rules.gram_bits)), np.zeros(2)
        for some, label, taken in zip(np.split(self.ids, np.cumsum(self.lengths)[:-1]), self.target, part, strict=True):
            if taken:
                texts[int(label)] += 1
                seen[int(label), np.unique(grams[self._picks(np.unique(some))])] += 1
        odds = np.log((seen[1] + 0.5) / (texts[1] + 1)) - np.log((seen[0] + 0.5) / (texts[0] + 1))
        odds -= rules.doubt * np.sqrt(1 / (seen[1] + 0.5) + 1 / (seen[0] + 0.5))
        out = np.empty(len(at) - 1, np.float32)
        for a in range(0, len(out), PART):
            b = min(a + PART, len(out))
            out[a:b] = np.maximum.reduceat(odds[grams[at[a] : at[b]]], at[a:b] - at[a])
        return out

    def learned(self, part: np.ndarray) -> Network:
        """A network learned on the texts of ``part``."""
        rules = self.rules
        rng = np.random.default_rng(rules.seed)
        mine = np.flatnonzero(part[self.owners])
        spans, owners = self.spans[mine], self.owners[mine]
        first = np.flatnonzero(np.diff(owners, prepend=-1))
        n_windows = np.diff(np.append(first, len(owners)))
        clean = self.target[owners[first]] == 0
        of_words = self._odds(part)[self.ids]
        speaks = np.array([of_words[s[s >= 0]].max() for s in spans])
        net = Network(rules)
        for round_ in range(rules.rounds):
            if round_:
                speaks = self.logits(net, spans)
            top = speaks == np.repeat(np.maximum.reduceat(speaks, first), n_windows)
            best = first + np.array([top[a : a + n].argmax() for a, n in zip(first, n_windows, strict=True)])
            chosen = [best, (first + rng.integers(0, n_windows))[clean]]
            if round_ == 0:
                chosen.append((first + rng.integers(0, n_windows))[clean])
            else:
                # Windows that speak against their text's label: those of clean texts that score over one half.
                wrong = np.flatnonzero((speaks > 0) & (self.target[owners] == 0))
                if len(wrong) > rules.hard_windows:
                    wrong = rng.choice(wrong, rules.hard_windows, replace=False)
                chosen.append(wrong)
            chosen = np.unique(np.concatenate(chosen))
            truth = self.target[owners[chosen]]
            weight = np.where(truth == 1, max(1.0, (truth == 0).sum() / max(1.0, 2 * truth.sum())), 1.0).astype(np.float32)
            # Few rows are gone through more often.
            for _ in range(max(rules.epochs, rules.least_steps * rules.batch // len(chosen))):
                order = rng.permutation(len(chosen))
                for a in range(0, len(order), rules.batch):
                    rows = order[a : a + rules.batch]
                    span = spans[chosen[rows]]
                    local, index = self.local(span)
                    net.step(local, index, (span >= 0).astype(np.float32), truth[rows], weight[rows])
        net.finish()
        return net


def train(texts: list[str], labels: list[int], rules: ToxicityRules = ToxicityRules()) -> Model:
    """Learn from labelled texts. Without texts of both classes, the score is the share of label 1.

    The cut is placed by scores of networks that have not learned from the texts they score: equal texts are in one fold,
    and texts longer than ``rules.characters`` are learned from by none. It is never above the one that the network's own
    texts give, which counts alone where there are too few texts for folds.
    """
    short = np.array([len(t or "") <= rules.characters for t in texts], bool)
    fold = np.array([zlib.crc32((t or "").encode("utf-8", "surrogatepass")) % rules.folds for t in texts])
    sample = _Sample(texts, labels, rules)
    del texts  # the sample holds them as numbers
    if not len(sample.spans) or not sample.both(short):
        return Model(None, prior=float(sample.target.mean()) if len(sample.target) else 0.0)
    truth, cuts = sample.target[sample.has], []
    parts = [short & (fold != k) for k in range(rules.folds)]
    if rules.folds > 1 and all(map(sample.both, parts)):
        top = np.empty(len(sample.has), np.float32)
        for k, part in enumerate(parts):
            top = np.where(fold[sample.has] == k, sample.highest(sample.learned(part)), top)
        cuts.append(_cut(top, truth, rules.spare))
    net = sample.learned(short)
    cuts.append(_cut(sample.highest(net), truth, rules.spare))
    return Model(net, shift=-min(cuts))


def _cut(logits: np.ndarray, truth: np.ndarray, spare: float) -> float:
    """The logit where the share of toxic texts found, less ``spare`` times the share of clean ones marked, is highest: the
    middle between the two logits there."""
    order = np.argsort(logits, kind="stable")
    logits, truth = logits[order], truth[order]
    marked = 1 - np.append(0, np.cumsum(truth == 0)) / max(1, (truth == 0).sum())
    found = 1 - np.append(0, np.cumsum(truth == 1)) / max(1, (truth == 1).sum())
    worth = found - spare * marked
    inner = np.append(np.append(True, logits[1:] > logits[:-1]), True)  # no cut between equal logits
    k = int(np.argmax(np.where(inner, worth, -np.inf)))
    low = logits[k - 1] if k else logits[0] - 1
    high = logits[k] if k < len(logits) else logits[-1] + 1
    return float((low + high) / 2)


def learning_labels(labels: DataFrame, label: str) -> DataFrame:
    """``(doc_id, label)``: the labels outside the held-out fold, one of each id."""
    return labels.where(F.col(label).isin(0, 1) & ~held_out()).groupBy("doc_id").agg(F.max(label).alias("label"))


def learning_rows(docs: DataFrame, labels: DataFrame, label: str, rows: int, characters: int | None = None) -> DataFrame:
    """``(text, label)``: labelled texts outside the held-out fold, at most ``rows`` of a class, by a hash of the id.

    The chosen ids are a bounded set, so they meet the texts in a broadcast join.
    """
    known = learning_labels(labels, label)
    picked = None
    for k in (0, 1):
        some = known.where(F.col("label") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
        picked = some if picked is None else picked.unionAll(some)
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    if characters is not None:
        texts = texts.where(F.length("text") <= characters)
    return texts.join(F.broadcast(picked), "doc_id").select("doc_id", "text", "label")


def fit(docs: DataFrame, labels: DataFrame, rules: ToxicityRules = ToxicityRules()) -> Model:
    """Learn from a bounded sample of labelled texts. One task learns, since the driver may be small; its tables come back."""

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        some: dict[str, list] = {"text": [], "label": []}
        for batch in batches:
            for name, values in some.items():
                values += batch.column(name).to_pylist()
        model = train(some.pop("text"), some.pop("label"), rules)
        told = (model.network and model.network.w, model.shift, model.prior)
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(told)])], names=["model"])

    rows = learning_rows(docs, labels, "toxic", rules.rows, rules.cut_characters)
    told = rows.repartition(1).sortWithinPartitions("doc_id", "text").mapInArrow(learn, "model binary").toArrow()
    if not told.num_rows:  # no row to learn from, and no task either
        return Model(None)
    tables, shift, prior = pickle.loads(told.column("model")[0].as_py())
    return Model(tables and Network.of(rules, tables), shift, prior)


def score(docs: DataFrame, model: Model, out: str = "score") -> DataFrame:
    """``docs`` with the score of each whole text, from 0 to 1.

    Null, empty and blank texts get the lowest score. A column named ``out`` is replaced; other columns pass through.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            values, some, size = [], [], 0
            for t in texts:
                some.append(t)
                size += len(t or "")
                if size > 4_000_000:
                    values.append(shared.value.scores(some))
                    some, size = [], 0
            values.append(shared.value.scores(some))
            yield pd.Series(np.concatenate(values))

    return docs.withColumn(out, scored(F.col("text")))
