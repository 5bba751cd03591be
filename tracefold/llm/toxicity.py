"""Toxicity: a bidirectional gated recurrent network with attention pooling, trained in numpy.

* Inputs of a word: a hashed word vector and the mean of its hashed character-trigram vectors. Upper and
  lower case and punctuation at the borders are folded, so ``IDIOT!!`` and ``idiot,`` are one word.
* A text is read in overlapping windows (``window`` words, a new one every ``stride``), the whole text, the
  last window padded and masked. In each window a forward and a backward GRU run over the words, attention
  weighs their states, and a linear unit gives a logit. The text's logit is its windows' largest.
* Training takes labelled rows only, at most ``max_rows`` of them, chosen by the least hash of their id.
  It is the one bounded step; scoring reads every row and every window. A text is toxic if any of its
  windows is, so each pass trains on the windows that score highest in their text beside random windows of
  clean texts. The vectors' first components start as the smoothed log-odds of the word or trigram in the sample.
* Scoring is one pass over the documents in a pandas UDF: no shuffle. The model (under 1 MB, fixed by its
  parameters) goes to the executors with the UDF.

Edge cases: a null text is an empty text; texts without words get the score of an all-padding window; very
long texts are scored in blocks of windows; no labelled rows, or labels of one class only, give the base rate
for every text; repeated rows get equal scores; an empty table gives an empty result; extra columns are not
read. Null labels are not used.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORDS_KEPT = 100_000  # written forms whose gates a scoring task keeps, some 300 bytes each
TEXTS_AT_ONCE = 250  # texts that a task scores before it looks at what it keeps
WORDS_AT_ONCE = 8192  # words whose trigrams are looked up at once
EDGES = " \t\n\r\x0b\x0c.,;:!?\"'()[]{}<>*#$%&|-_/\\=+~`^"


@dataclass(frozen=True)
class Settings:
    window: int = 32
    stride: int = 16
    word_rows: int = 8192
    char_rows: int = 4096
    width: int = 8
    hidden: int = 8
    passes: int = 5
    rate: float = 0.02
    batch: int = 64
    clean_windows: int = 3
    max_rows: int = 2400
    seed: int = 11
    block: int = 4096


def fold(word: str) -> str:
    return word.lower().strip(EDGES)


@dataclass
class Vocabulary:
    """Hashed rows of a list of folded words; the trigram rows of all words stand in one array."""

    word: np.ndarray
    char: np.ndarray
    starts: np.ndarray
    counts: np.ndarray

    @staticmethod
    def of(words: list[str], s: Settings) -> Vocabulary:
        """Trigrams are those of the UTF-8 bytes of ``^word$``, hashed for all words at once."""
        coded = [w.encode("utf-8", "surrogatepass") for w in words]
        own = np.fromiter((zlib.crc32(w) for w in coded), np.int64, len(coded)) % s.word_rows
        sizes = np.fromiter((len(w) or 1 for w in coded), np.int64, len(coded))
        raw = np.frombuffer(b"".join(b"^%s$" % (w or b" ") for w in coded), np.uint8).astype(np.int64)
        first = np.concatenate([[0], np.cumsum(sizes + 2)[:-1]])
        starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        at = np.arange(int(sizes.sum())) + np.repeat(first - starts, sizes)
        mixed = (raw[at] * 65_536 + raw[at + 1] * 256 + raw[at + 2]) * 0x9E3779B1
        return Vocabulary(own, (mixed >> 15) % s.char_rows, starts, sizes)

    def part(self, used: np.ndarray) -> Vocabulary:
        counts = self.counts[used]
        starts = np.concatenate([[0], np.cumsum(counts)[:-1]])
        at = np.arange(int(counts.sum())) + np.repeat(self.starts[used] - starts, counts)
        return Vocabulary(self.word[used], self.char[at], starts, counts)


def window_table(n: int, s: Settings) -> np.ndarray:
    """Word positions of the windows of an ``n``-word text, -1 where padded; one row at least."""
    starts = np.arange(0, max(1, n - s.window + s.stride), s.stride)
    at = starts[:, None] + np.arange(s.window)
    return np.where(at < n, at, -1)


def _sig(x):
    return 1.0 / (1.0 + np.exp(-np.clip(x, -30, 30)))


@dataclass
class Network:
    """``wx``: input to gates (reset, update, new) of both directions; ``wh``: state to gates."""

    s: Settings
    p: dict[str, np.ndarray] = field(default_factory=dict)
    shift: float = 0.0
    base: float | None = None

    @staticmethod
    def fresh(s: Settings) -> Network:
        r = np.random.default_rng(s.seed)
        e, h = s.width, s.hidden
        g = lambda *d, k=0.25: (r.standard_normal(d) * k).astype(np.float32)
        p = {"word": g(s.word_rows, e, k=0.1), "char": g(s.char_rows, e, k=0.1), "att": g(2 * h), "out": g(2 * h, k=0.5), "bias": np.zeros(1, np.float32)}
        for d in "fb":
            p |= {f"wx{d}": g(2 * e, 3 * h, k=0.4), f"wh{d}": g(h, 3 * h), f"b{d}": np.zeros(3 * h, np.float32)}
        return Network(s, p)

    def inputs(self, words: Vocabulary) -> np.ndarray:
        """Input vectors of words; the rows of their trigrams, many more, are taken for some words at a time."""
        n, e = len(words.word), self.s.width
        x = np.empty((n, 2 * e), np.float32)
        x[:, :e] = self.p["word"][words.word]
        for a in range(0, n, WORDS_AT_ONCE):
            starts, counts = words.starts[a : a + WORDS_AT_ONCE], words.counts[a : a + WORDS_AT_ONCE]
            char = words.char[starts[0] : starts[-1] + counts[-1]]
            x[a : a + len(starts), e:] = np.add.reduceat(self.p["char"][char], starts - starts[0], axis=0) / counts[:, None]
        return x

    def gates(self, x: np.ndarray) -> dict[str, np.ndarray]:
        """Input part of the gates, once per distinct word; the last row is the padding's."""
        out = {}
        for d in "fb":
            w = self.p[f"wx{d}"]
            out[d] = np.zeros((len(x) + 1, w.shape[1]), np.result_type(x, w))
            np.matmul(x, w, out=out[d][:-1])
            out[d][:-1] += self.p[f"b{d}"]
        return out

    def forward(self, gates: dict[str, np.ndarray], idx: np.ndarray, keep: bool = False):
        """Logits of windows; ``idx``: rows of ``gates``, -1 for padding."""
        h, (n, steps) = self.s.hidden, idx.shape
        mask = (idx >= 0).astype(np.float32)
        whole = mask.all(0)  # steps without padding need no mask
        kind = gates["f"].dtype
        states, tape = np.zeros((steps, n, 2 * h), kind), {"f": [None] * steps, "b": [None] * steps}
        for d, part in (("f", slice(0, h)), ("b", slice(h, 2 * h))):
            state, w = np.zeros((n, h), kind), self.p[f"wh{d}"]
            for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
                x = gates[d].take(idx[:, t], axis=0)  # -1 is the padding's row
                u = state @ w
                rz = x[:, : 2 * h] + u[:, : 2 * h]
                rz *= 0.5
                np.tanh(rz, out=rz)
                rz *= 0.5
                rz += 0.5  # the logistic function
                r, z, un = rz[:, :h], rz[:, h:], u[:, 2 * h :]
                new = np.tanh(x[:, 2 * h :] + r * un)
                nxt = z * (state - new) + new
                if not whole[t]:
                    nxt *= mask[:, t, None]
                if keep:
                    tape[d][t] = (state, r, z, new, un)
                states[t, :, part] = state = nxt
        states = states.transpose(1, 0, 2)
        score = states @ self.p["att"] + (mask - 1) * 30
        score -= score.max(1, keepdims=True)
        a = np.exp(score)
        a /= a.sum(1, keepdims=True)
        pooled = np.einsum("nt,nth->nh", a, states)
        logit = pooled @ self.p["out"] + self.p["bias"][0]
        return (logit, (states, tape, a, pooled, mask)) if keep else logit

    def gradients(self, x: np.ndarray, gates, idx: np.ndarray, y: np.ndarray, weight: np.ndarray):
        """Loss gradients of the parameters and of the word inputs ``x``."""
        h, (n, steps) = self.s.hidden, idx.shape
        logit, (states, tape, a, pooled, mask) = self.forward(gates, idx, keep=True)
        dl = ((_sig(logit) - y) * weight / n).astype(np.float32)
        g = {"out": pooled.T @ dl, "bias": np.array([dl.sum()], np.float32)}
        dp = dl[:, None] * self.p["out"]
        ds = a[:, :, None] * dp[:, None, :]
        da = np.einsum("nh,nth->nt", dp, states)
        dscore = a * (da - (a * da).sum(1, keepdims=True))
        g["att"] = np.einsum("nt,nth->h", dscore, states)
        ds += dscore[:, :, None] * self.p["att"]
        dx = np.zeros((len(x) + 1, x.shape[1]), np.float32)
        for d in "fb":
            part = slice(0, h) if d == "f" else slice(h, 2 * h)
            wh, dwh = self.p[f"wh{d}"], np.zeros_like(self.p[f"wh{d}"])
            dgates, carry = np.zeros((len(x) + 1, 3 * h), np.float32), np.zeros((n, h), np.float32)
            for t in range(steps - 1, -1, -1) if d == "f" else range(steps):
                prev, r, z, new, un = tape[d][t]
                dh = (ds[:, t, part] + carry) * mask[:, t, None]
                dnew = dh * (1 - z) * (1 - new * new)
                dz = dh * (prev - new) * z * (1 - z)
                dr = dnew * un * r * (1 - r)
                du = np.concatenate([dr, dz, dnew * r], axis=1)
                dwh += prev.T @ du
                carry = du @ wh.T + dh * z
                np.add.at(dgates, idx[:, t], np.concatenate([dr, dz, dnew], axis=1))
            dgates = dgates[:-1]  # padding's
            g[f"wh{d}"], g[f"b{d}"], g[f"wx{d}"] = dwh, dgates.sum(0), x.T @ dgates
            dx[:-1] += dgates @ self.p[f"wx{d}"].T
        return g, dx[:-1]

    def text_logits(self, texts: Iterable[str | None], cache: dict | None = None) -> np.ndarray:
        """Largest window logit of each text, every window of every text."""
        cache = cache if cache is not None else {}
        texts = list(texts)
        out = np.full(len(texts), -np.inf, np.float32)
        pending, owner, held = [], [], 0
        for k, text in enumerate(texts):
            codes = self._codes((text or "").split(), cache)
            at = window_table(len(codes), self.s)
            rows = np.where(at >= 0, codes[at] if len(codes) else -1, -1)
            for a in range(0, len(rows), self.s.block):
                pending.append(rows[a : a + self.s.block])
                owner.append(np.full(len(pending[-1]), k))
                held += len(pending[-1])
                if held >= self.s.block:
                    self._flush(out, pending, owner, cache)
                    pending, owner, held = [], [], 0
        if pending:
            self._flush(out, pending, owner, cache)
        return out

    def _flush(self, out, pending, owner, cache) -> None:
        idx, own = np.concatenate(pending), np.concatenate(owner)
        gates = self._cached_gates(cache)
        np.maximum.at(out, own, self.forward(gates, idx))

    def _codes(self, words: list[str], cache: dict) -> np.ndarray:
        """Numbers of the words in ``cache``; it keeps each written form once, with its gates."""
        known = cache.setdefault("raw", {})
        return np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, len(words))

    def _cached_gates(self, cache: dict) -> dict[str, np.ndarray]:
        known, done = cache["raw"] if "raw" in cache else {}, cache.get("done", 0)
        store = cache.setdefault("gates", {d: np.zeros((8192, 3 * self.s.hidden), np.float32) for d in "fb"})
        if len(known) > done:
            forms = list(known)[done:]
            fresh = self.gates(self.inputs(Vocabulary.of([fold(w) for w in forms], self.s)))
            for d in "fb":
                if len(known) + 1 > len(store[d]):
                    store[d] = np.concatenate([store[d], np.zeros((len(known) + 1, store[d].shape[1]), np.float32)])
                store[d][done : len(known)] = fresh[d][:-1]
            cache["done"] = len(known)
        return store

    def scores(self, logits: np.ndarray) -> np.ndarray:
        if self.base is not None:
            return np.full(len(logits), self.base)
        return _sig(np.asarray(logits, np.float64) - self.shift)


def train(texts: list[str | None], labels: list[int], s: Settings | None = None) -> Network:
    """Network fitted to labelled texts (1: toxic). Every fourth text only helps to place the cut."""
    s = s or Settings()
    y = np.asarray(labels, np.float32)
    net = Network.fresh(s)
    if not len(y) or y.min() == y.max():
        net.base = float(y.mean()) if len(y) else 0.0
        return net
    known: dict[str, int] = {}
    codes = [np.fromiter((known.setdefault(fold(w), len(known)) for w in (t or "").split()), np.int64) for t in texts]
    vocab = Vocabulary.of(list(known) or [""], s)
    windows = [np.where((at := window_table(len(c), s)) >= 0, c[at] if len(c) else -1, -1) for c in codes]
    fitted = np.arange(len(y)) % 4 != 3 if len(y) >= 40 else np.ones(len(y), bool)
    if y[fitted].min() == y[fitted].max():
        fitted[:] = True
    own = [w for w, f in zip(windows, fitted, strict=True) if f]
    _start_from_log_odds(net, vocab, [c for c, f in zip(codes, fitted, strict=True) if f], y[fitted])
    rng = np.random.default_rng(s.seed)
    moments: dict[str, list[np.ndarray]] = {}
    step = 0
    for turn in range(s.passes):
        idx, target, weight = _chosen_windows(net, vocab, own, y[fitted], rng, turn)
        order = rng.permutation(len(idx))
        for a in range(0, len(order), s.batch):
            part = order[a : a + s.batch]
            step += 1
            _update(net, vocab, idx[part], target[part], weight[part], moments, step)
    check = ~fitted if len(set(y[~fitted])) == 2 else fitted
    top = _tops(net, vocab, [w for w, c in zip(windows, check, strict=True) if c])[0]
    net.shift = _threshold(top, y[check])
    return net


def _start_from_log_odds(net: Network, vocab: Vocabulary, codes: list[np.ndarray], y: np.ndarray) -> None:
    seen = np.zeros((2, len(vocab.word)))
    for c, label in zip(codes, y, strict=True):
        seen[int(label), np.unique(c)] += 1
    rate = (seen + 0.5) / (np.array([(y == 0).sum(), (y == 1).sum()])[:, None] + 1)
    enough = np.minimum(1, seen.sum(0) / 8)
    odds = np.clip(np.log(rate[1] / rate[0]), -3, 3) * enough
    total, hits = np.zeros(net.s.word_rows), np.zeros(net.s.word_rows)
    np.add.at(total, vocab.word, odds * seen.sum(0))
    np.add.at(hits, vocab.word, seen.sum(0))
    net.p["word"][:, 0] = total / np.maximum(hits, 1)
    grams = np.zeros((2, net.s.char_rows))
    for c, label in zip(codes, y, strict=True):
        if len(c):
            grams[int(label), np.unique(vocab.part(np.unique(c)).char)] += 1
    rate = (grams + 0.5) / (np.array([(y == 0).sum(), (y == 1).sum()])[:, None] + 1)
    net.p["char"][:, 0] = np.clip(np.log(rate[1] / rate[0]), -3, 3) * np.minimum(1, grams.sum(0) / 8)


def _tops(net: Network, vocab: Vocabulary, windows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Largest logit of each text and the window that has it."""
    gates = net.gates(net.inputs(vocab))
    sizes = np.array([len(w) for w in windows])
    flat = np.concatenate(windows)
    logit = np.concatenate([net.forward(gates, flat[a : a + 8192]) for a in range(0, len(flat), 8192)])
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    best = np.array([a + int(np.argmax(logit[a : a + n])) for a, n in zip(starts, sizes, strict=True)])
    return logit[best], best - starts


def _chosen_windows(net, vocab, windows, y, rng, turn):
    """The best window of each text, and random windows of clean texts; the classes weigh the same.

    After the first pass a toxic text weighs as much as its best window convinces: a label without a trace
    in the text would otherwise be learnt by heart.
    """
    top, best = _tops(net, vocab, windows)
    trust = np.clip(_sig(top), 0.05, 1) if turn else np.ones(len(y))
    if turn == 0:  # the untrained network knows nothing but the words' log-odds
        odds = np.append(net.p["word"][vocab.word, 0], 0.0)
        best = np.array([int(np.argmax(odds[w].max(1))) for w in windows])
    picked, target, weight = [], [], []
    for k, w in enumerate(windows):
        picked.append(w[best[k]][None])
        target.append([y[k]])
        weight.append([trust[k] if y[k] else 1.0])
        if not y[k]:
            more = rng.integers(0, len(w), min(len(w), net.s.clean_windows))
            picked.append(w[more])
            target.append([0.0] * len(more))
            weight.append([1.0] * len(more))
    target, weight = np.concatenate(target).astype(np.float32), np.concatenate(weight)
    for label in (0.0, 1.0):
        weight[target == label] /= 2 * max(float(weight[target == label].sum()), 1e-6) / len(target)
    return np.concatenate(picked), target, weight.astype(np.float32)


def _update(net, vocab, idx, target, weight, moments, step) -> None:
    """One Adam step."""
    used = np.unique(idx[idx >= 0])
    if not len(used):
        return
    local = np.where(idx >= 0, np.searchsorted(used, idx), -1)
    words = vocab.part(used)
    x = net.inputs(words)
    g, dx = net.gradients(x, net.gates(x), local, target, weight)
    e = net.s.width
    g["word"], g["char"] = np.zeros_like(net.p["word"]), np.zeros_like(net.p["char"])
    np.add.at(g["word"], words.word, dx[:, :e])
    np.add.at(g["char"], words.char, np.repeat(dx[:, e:] / words.counts[:, None], words.counts, axis=0))
    for k, grad in g.items():
        m, v = moments.setdefault(k, [np.zeros_like(net.p[k]), np.zeros_like(net.p[k])])
        m += 0.1 * (grad - m)
        v += 0.002 * (grad * grad - v)
        net.p[k] -= (net.s.rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.998**step)) + 1e-7)).astype(np.float32)


def _threshold(top: np.ndarray, y: np.ndarray) -> float:
    """Logit cut with the best F0.5 (a wrong alarm costs more than a miss); of cuts about as good, the highest.

    The cut lies midway between the texts around it.
    """
    order = np.argsort(-top)
    hit = np.cumsum(y[order])
    score = 1.25 * hit / (np.arange(1, len(y) + 1) + 0.25 * y.sum())
    k = int(np.flatnonzero(score >= score.max() - 0.01)[0])
    below = top[order[k + 1]] if k + 1 < len(top) else top[order[k]] - 1
    return float((top[order[k]] + below) / 2)


def held_out(id_col: str, folds: int = 5) -> Column:
    """Ids whose CRC32 (of the id as text) leaves no remainder are never trained on; a null id counts as text ''."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % folds == 0


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", s: Settings | None = None) -> Network:
    """Train on at most ``s.max_rows`` labelled rows outside of the held-out fold.

    The sample is by hash of the id, half of each class where there are enough, so reruns train alike.
    The rows are chosen among labels alone, before any text is read; only those texts reach the driver.
    """
    s = s or Settings()
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & ~held_out(id_col))
    known = known.groupBy(id_col).agg(F.max(F.col(label_col).cast("int")).alias("_y")).withColumn("_h", F.xxhash64(F.col(id_col), F.lit(s.seed)))
    half = s.max_rows // 2
    some = known.where("_y = 1").orderBy("_h", id_col).limit(half).unionByName(known.where("_y = 0").orderBy("_h", id_col).limit(half))
    rows = docs.select(F.col(id_col), F.col(text_col).alias("_t")).join(F.broadcast(some), id_col)  # at most max_rows rows
    rows = rows.dropDuplicates([id_col]).orderBy("_h", id_col).select("_t", "_y").collect()
    return train([r["_t"] for r in rows], [r["_y"] for r in rows], s)


def toxicity(text: Column | str, net: Network) -> Column:
    """Score of a text column, 0 to 1."""

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        cache: dict = {}
        for texts in batches:
            yield pd.Series(text_scores(net, texts, cache), dtype="float64")

    return score(text)


def text_scores(net: Network, texts: Sequence[str | None], cache: dict) -> np.ndarray:
    """Scores of a batch. What is kept of its words is bounded inside the batch too, which may hold a whole task's rows."""
    out = [np.zeros(0)]
    for a in range(0, len(texts), TEXTS_AT_ONCE):
        if len(cache.get("raw", ())) > WORDS_KEPT:
            cache.clear()
        out.append(net.scores(net.text_logits(texts[a : a + TEXTS_AT_ONCE], cache)))
    return np.concatenate(out)


def score_toxicity(docs: DataFrame, net: Network, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, ``held_out``, ``score`` and ``predicted`` (1 from 0.5 on)."""
    scored = docs.select(F.col(id_col), held_out(id_col).alias("held_out"), toxicity(F.col(text_col), net).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
