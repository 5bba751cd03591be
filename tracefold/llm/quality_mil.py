"""Quality: attention-based multiple-instance learning over the passages of a text, trained in numpy.

* A text is a bag of passages of ``words`` words; its label says nothing about which of them is poor. Every
  passage of the whole text is read: shares of byte kinds, word length, repeated words, word triples seen before,
  and a histogram of hashed byte pairs (``read_passages``).
* One layer encodes each passage; gated attention (tanh times logistic units) weighs the passages of a text
  against each other; the weighted sum of their codes is the text's representation, a linear unit scores it.
* Training takes labelled rows only, at most ``max_rows``, by the least hash of their id, and of each at most
  ``max_passages`` passages, evenly spread over the whole text. Executors read the passages, so only that many
  short vectors, no texts, reach the driver. It is the one bounded step. Every fourth text only places the cut.
* The cut that rejects poor texts with few wrong alarms comes to lie at a score of ``CUT``.
* Scoring is one pass over the documents in a pandas UDF; the model (some 30 kB) goes along.

Edge cases: a null text is an empty text, and a text without words is one empty passage; very long texts are read
in blocks of ``block`` bytes, cut between words; no labelled rows give a score of 1 to every text, labels of one
class their mean; null labels are not used; of several labels of an id the largest counts; repeated rows get equal
scores; an empty table gives an empty result; extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracefold.llm.toxicity import held_out

CUT = 0.3
#: Byte kinds: lower case, upper case, digit, beyond ASCII, sentence mark, call or question, sign, other, line end, blank.
KINDS = 10
_LIST = [(b"abcdefghijklmnopqrstuvwxyz", 0), (b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", 1), (b"0123456789", 2), (bytes(range(128, 256)), 3), (b".,;:'\"()-", 4), (b"!?", 5), (b"#*$%&|<>", 6), (b"\n", 8), (b" \t\r\x0b\x0c", 9)]
KIND = np.full(256, 7, np.int64)
for _bytes, _kind in _LIST:
    KIND[list(_bytes)] = _kind
STATS = KINDS + 5


@dataclass(frozen=True)
class Settings:
    words: int = 48
    grams: int = 256
    width: int = 16
    gate: int = 8
    passes: int = 12
    rate: float = 0.01
    decay: float = 1e-4
    batch: int = 32
    max_rows: int = 2400
    max_passages: int = 32
    seed: int = 5
    block: int = 1 << 20

    @property
    def inputs(self) -> int:
        return STATS + self.grams


def blocks_of(text: str | None, size: int) -> list[bytes]:
    """The text's bytes in blocks of at most ``size``, cut after a blank where there is one."""
    raw, out = (text or "").encode("utf-8", "surrogatepass"), []
    while len(raw) > size:
        at = max(raw.rfind(b" ", 0, size), raw.rfind(b"\n", 0, size)) + 1 or size
        out.append(raw[:at])
        raw = raw[at:]
    return [*out, raw]


def _repeated(keys: np.ndarray) -> np.ndarray:
    """Which entries equal an earlier one."""
    order = np.argsort(keys, kind="stable")
    out = np.zeros(len(keys), bool)
    out[order[1:]] = keys[order[1:]] == keys[order[:-1]]
    return out


def read_passages(blocks: list[bytes], s: Settings) -> tuple[np.ndarray, np.ndarray]:
    """Vectors of all passages, and the block each comes from (in order; a block without words has one passage)."""
    raw = np.frombuffer(b" ".join([*blocks, b""]), np.uint8)
    sizes = np.array([len(b) + 1 for b in blocks])
    begin = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    kind = KIND[raw]
    blank = kind >= 8
    first = np.flatnonzero(~blank & np.concatenate([[True], blank[:-1]]))  # first byte of each word
    home = np.searchsorted(begin, first, "right") - 1
    per_block = np.bincount(home, minlength=len(blocks))
    passages = np.maximum(1, -(-per_block // s.words))
    start = np.concatenate([[0], np.cumsum(passages)[:-1]])
    number = np.arange(len(first)) - np.repeat(np.cumsum(per_block) - per_block, per_block)
    of_word = start[home] + number // s.words
    n = int(passages.sum())
    # each byte belongs to the word at or before it; blanks before a block's first word to its first passage
    of_byte = np.repeat(start, sizes)
    if len(first):
        word_at = np.searchsorted(first, np.arange(len(raw)), "right") - 1
        own = (word_at >= 0) & (home[word_at] == np.repeat(np.arange(len(blocks)), sizes))
        of_byte = np.where(own, of_word[word_at], of_byte)
    out = np.zeros((n, s.inputs), np.float32)
    size = np.maximum(1, np.bincount(of_byte, minlength=n))[:, None]
    out[:, :KINDS] = np.bincount(of_byte * KINDS + kind, minlength=n * KINDS).reshape(n, KINDS) / size
    at = of_byte[:-1] * s.grams + ((raw[:-1].astype(np.int64) * 31 + raw[1:]) * 0x9E3779B1 >> 12) % s.grams
    at = np.delete(at, begin[1:] - 1)  # pairs over the border of two blocks
    out[:, STATS:] = np.sqrt(np.bincount(at, minlength=n * s.grams).reshape(n, s.grams) / size)
    if len(first):
        inside = np.flatnonzero(~blank)
        far = inside - first[word_at[inside]]
        spread = (raw[inside].astype(np.uint64) + np.uint64(1)) * (np.uint64(0x9E3779B97F4A7C15) * (far.astype(np.uint64) * np.uint64(2) + np.uint64(1)))
        spread ^= spread >> np.uint64(31)
        lengths = np.bincount(word_at[inside], minlength=len(first))
        word = np.add.reduceat(spread * np.uint64(0xBF58476D1CE4E5B9), np.concatenate([[0], np.cumsum(lengths)[:-1]]))
        count = np.bincount(of_word, minlength=n)
        share = lambda w: np.bincount(of_word, w, minlength=n) / np.maximum(1, count)
        mixed = lambda own: own.astype(np.uint64) * np.uint64(0x94D049BB133111EB)
        same = np.concatenate([[False], (word[1:] == word[:-1]) & (of_word[1:] == of_word[:-1])])
        triple = word.copy()
        triple[1:] += word[:-1] * np.uint64(3)
        triple[2:] += word[:-2] * np.uint64(7)
        triple[number < 2] = np.flatnonzero(number < 2)  # no triple of this block ends here
        seen = _repeated(triple ^ mixed(home)) & (number > 1)
        for k, values in enumerate((share(lengths) / 16, share(_repeated(word ^ mixed(of_word))), share(same), share(seen))):
            out[:, KINDS + k] = values
        out[:, KINDS + 4] = count / s.words
    return out, np.repeat(np.arange(len(blocks)), passages)


def _sig(x):
    return 1.0 / (1.0 + np.exp(-np.clip(x, -30, 30)))


@dataclass
class Model:
    s: Settings
    p: dict[str, np.ndarray] = field(default_factory=dict)
    mean: np.ndarray | None = None
    scale: np.ndarray | None = None
    shift: float = 0.0
    base: float | None = None

    @staticmethod
    def fresh(s: Settings) -> Model:
        r = np.random.default_rng(s.seed)
        g = lambda *d, k: (r.standard_normal(d) * k).astype(np.float32)
        p = {
            "code": g(s.inputs, s.width, k=s.inputs**-0.5), "code0": np.zeros(s.width, np.float32), "tan": g(s.width, s.gate, k=0.3), "log": g(s.width, s.gate, k=0.3),
            "att": g(s.gate, k=0.3), "out": g(s.width, k=0.3), "out0": np.zeros(1, np.float32),
        }
        return Model(s, p, np.zeros(s.inputs, np.float32), np.ones(s.inputs, np.float32))

    def forward(self, x: np.ndarray, starts: np.ndarray):
        """Logits of bags; ``starts``: first passage of each. Also what the gradients need."""
        p = self.p
        h = np.tanh(x @ p["code"] + p["code0"])
        t, u = np.tanh(h @ p["tan"]), _sig(h @ p["log"])
        e = (t * u) @ p["att"]
        sizes = np.diff(np.append(starts, len(x)))
        a = np.exp(e - np.repeat(np.maximum.reduceat(e, starts), sizes))
        a /= np.repeat(np.add.reduceat(a, starts), sizes)
        z = np.add.reduceat(a[:, None] * h, starts, axis=0)
        return z @ p["out"] + p["out0"][0], (h, t, u, a, z, sizes)

    def gradients(self, x: np.ndarray, starts: np.ndarray, y: np.ndarray, weight: np.ndarray) -> dict[str, np.ndarray]:
        p = self.p
        logit, (h, t, u, a, z, sizes) = self.forward(x, starts)
        dl = (_sig(logit) - y) * weight / len(y)
        g = {"out": z.T @ dl, "out0": np.array([dl.sum()])}
        dz = np.repeat(dl[:, None] * p["out"], sizes, axis=0)
        da = (dz * h).sum(1)
        de = a * (da - np.repeat(np.add.reduceat(a * da, starts), sizes))
        g["att"] = (t * u).T @ de
        dt, du = de[:, None] * p["att"] * u * (1 - t * t), de[:, None] * p["att"] * t * u * (1 - u)
        g["tan"], g["log"] = h.T @ dt, h.T @ du
        dh = (a[:, None] * dz + dt @ p["tan"].T + du @ p["log"].T) * (1 - h * h)
        g["code"], g["code0"] = x.T @ dh, dh.sum(0)
        return g

    def attention(self, text: str | None) -> np.ndarray:
        """Weights of the text's passages, which add up to 1."""
        x = read_passages(blocks_of(text, self.s.block), self.s)[0]
        return self.forward((x - self.mean) / self.scale, np.zeros(1, np.int64))[1][3]

    def logits(self, texts: list[str | None]) -> np.ndarray:
        """Every passage of every text; codes of blocks are gathered until a text is whole."""
        out = np.zeros(len(texts))
        blocks, owner, held = [], [], 0
        for k, text in enumerate(texts):
            own = blocks_of(text, self.s.block)
            if blocks and held + sum(map(len, own)) > self.s.block:
                self._score(out, blocks, owner)
                blocks, owner, held = [], [], 0
            if len(own) > 1:
                self._score_long(out, own, k)
                continue
            blocks += own
            owner.append(k)
            held += len(own[0])
        if blocks:
            self._score(out, blocks, owner)
        return out

    def _score(self, out, blocks, owner) -> None:
        x, home = read_passages(blocks, self.s)
        out[owner] = self.forward(((x - self.mean) / self.scale).astype(np.float64), np.searchsorted(home, np.arange(len(blocks))))[0]

    def _score_long(self, out, blocks, k) -> None:
        """The softmax over a text of many blocks, block by block."""
        p, most, total, z = self.p, -np.inf, 0.0, np.zeros(self.s.width)
        for block in blocks:
            x = ((read_passages([block], self.s)[0] - self.mean) / self.scale).astype(np.float64)
            h = np.tanh(x @ p["code"] + p["code0"])
            e = (np.tanh(h @ p["tan"]) * _sig(h @ p["log"])) @ p["att"]
            top = max(most, float(e.max()))
            w = np.exp(e - top)
            old = np.exp(most - top)
            total, z, most = total * old + w.sum(), z * old + w @ h, top
        out[k] = z / total @ p["out"] + p["out0"][0]

    def scores(self, texts: list[str | None]) -> np.ndarray:
        if self.base is not None:
            return np.full(len(texts), self.base)
        # in double precision and rounded, so that equal texts score alike whatever stands beside them in a batch
        return np.round(_sig(self.logits(texts) - self.shift), 9)


def train(bags: list[np.ndarray], labels: list[int], s: Settings | None = None) -> Model:
    """Model fitted to bags of passage vectors and their labels (1: good)."""
    s = s or Settings()
    y = np.asarray(labels, np.float32)
    model = Model.fresh(s)
    if not len(y) or y.min() == y.max():
        model.base = float(y.mean()) if len(y) else 1.0
        return model
    fitted = np.arange(len(y)) % 4 != 3
    if len(set(y[fitted])) < 2:
        fitted[:] = True
    flat = np.concatenate([b for b, f in zip(bags, fitted, strict=True) if f])
    model.mean, model.scale = flat.mean(0), flat.std(0) + 0.01
    ready = [(b.astype(np.float32) - model.mean) / model.scale for b in bags]
    weight = np.where(y == 1, 0.5 / y[fitted].mean(), 0.5 / (1 - y[fitted].mean())).astype(np.float32)
    rng, moments, step = np.random.default_rng(s.seed), {}, 0
    for _ in range(s.passes):
        order = rng.permutation(np.flatnonzero(fitted))
        for a in range(0, len(order), s.batch):
            part = order[a : a + s.batch]
            step += 1
            x, starts = _joined([ready[k] for k in part])
            g = model.gradients(x, starts, y[part], weight[part])
            for name, grad in g.items():
                grad = grad + s.decay * model.p[name]
                m, v = moments.setdefault(name, [np.zeros_like(grad), np.zeros_like(grad)])
                m += 0.1 * (grad - m)
                v += 0.002 * (grad * grad - v)
                model.p[name] -= (s.rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.998**step)) + 1e-7)).astype(np.float32)
    check = ~fitted if len(set(y[~fitted])) == 2 else fitted
    logit = model.forward(*_joined([b for b, c in zip(ready, check, strict=True) if c]))[0]
    model.shift = _cut(logit, y[check]) - float(np.log(CUT / (1 - CUT)))
    return model


def _joined(bags: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    sizes = np.array([len(b) for b in bags])
    return np.concatenate(bags), np.cumsum(sizes) - sizes


def _cut(logit: np.ndarray, y: np.ndarray) -> float:
    """Cut for rejecting texts below it: best F0.5 of the poor class, as rejecting a good text costs more; of cuts
    about as good, the lowest; midway between the texts around it. The classes weigh the same."""
    order = np.argsort(logit)
    poor, good = (y[order] == 0) / (y == 0).sum(), (y[order] == 1) / (y == 1).sum()
    hit, wrong = np.cumsum(poor), np.cumsum(good)
    score = 1.25 * hit / (hit + wrong + 0.25)
    k = int(np.flatnonzero(score >= score.max() - 0.002)[0])
    above = logit[order[k + 1]] if k + 1 < len(order) else logit[order[k]] + 1
    return float((logit[order[k]] + above) / 2)


def _spread(n: int, most: int) -> np.ndarray:
    """At most ``most`` of n passages, evenly spread."""
    return np.arange(n) if n <= most else np.linspace(0, n - 1, most).astype(np.int64)


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", s: Settings | None = None) -> Model:
    """Train on at most ``s.max_rows`` labelled rows outside of the held-out fold, half of each class where there
    are enough; the rows are chosen among labels alone, before any text is read."""
    s = s or Settings()

    @F.pandas_udf("binary")
    def vectors(texts: pd.Series) -> pd.Series:
        def one(text):
            rows = [read_passages([b], s)[0] for b in blocks_of(text, s.block)]
            picked = [(k, i) for k, r in enumerate(rows) for i in range(len(r))]
            picked = [picked[i] for i in _spread(len(picked), s.max_passages)]
            return np.stack([rows[k][i] for k, i in picked]).astype(np.float16).tobytes()

        return pd.Series([one(t) for t in texts])

    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & ~held_out(id_col))
    known = known.groupBy(id_col).agg(F.max(F.col(label_col).cast("int")).alias("_y")).withColumn("_h", F.xxhash64(F.col(id_col), F.lit(s.seed)))
    half = s.max_rows // 2
    some = known.where("_y = 1").orderBy("_h", id_col).limit(half).unionByName(known.where("_y = 0").orderBy("_h", id_col).limit(half))
    rows = docs.select(F.col(id_col), F.col(text_col).alias("_t")).join(F.broadcast(some), id_col)  # at most max_rows rows
    rows = rows.groupBy(id_col).agg(F.first("_y").alias("_y"), F.first("_h").alias("_h"), F.min("_t").alias("_t"))
    rows = rows.select("_h", id_col, "_y", vectors("_t").alias("_v")).orderBy("_h", id_col).select("_y", "_v").collect()
    return train([np.frombuffer(r["_v"], np.float16).reshape(-1, s.inputs).astype(np.float32) for r in rows], [r["_y"] for r in rows], s)


def quality(text: Column | str, model: Model) -> Column:
    """Score of a text column, 0 to 1."""

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(model.scores(list(texts)), dtype="float64")

    return score(text)


def score_quality(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, ``held_out``, ``score`` and ``predicted`` (1 from ``CUT`` on)."""
    scored = docs.select(F.col(id_col), held_out(id_col).alias("held_out"), quality(F.col(text_col), model).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= CUT).cast("int"))
