import numpy as np

from tracefold.llm import toxicity as toxicity_module
from tracefold.llm.toxicity import Network, Settings, Vocabulary, fit, fold, score_toxicity, train, window_table


def test_gradients_are_right():
    s = Settings(window=5, stride=2, word_rows=11, char_rows=7, width=3, hidden=2)
    net = Network.fresh(s)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    words = Vocabulary.of(["aa", "bb", "cde", "f"], s)
    idx = np.array([[0, 1, 2, 3, 0], [3, 2, -1, -1, -1], [1, 1, 0, 2, -1]])
    y, weight = np.array([1.0, 0.0, 1.0]), np.array([0.5, 1.5, 1.0])

    def loss():
        x = net.inputs(words)
        logit = net.forward(net.gates(x.astype(np.float64)), idx).astype(np.float64)
        return float((weight * (np.logaddexp(0, logit) - y * logit)).mean())

    x = net.inputs(words)
    g, dx = net.gradients(x, net.gates(x), idx, y, weight)
    rng = np.random.default_rng(0)
    for name in ("wxf", "whf", "bf", "wxb", "whb", "bb", "att", "out", "bias"):
        flat = net.p[name].reshape(-1)
        for k in rng.integers(0, len(flat), 3):
            old, eps = flat[k], 1e-3
            flat[k] = old + eps
            up = loss()
            flat[k] = old - eps
            down = loss()
            flat[k] = old
            assert abs((up - down) / (2 * eps) - g[name].reshape(-1)[k]) < 2e-3, name
    r = words.word[0]
    got = sum(dx[i, :3] for i, a in enumerate(words.word) if a == r)
    old = net.p["word"][r, 1]
    net.p["word"][r, 1] = old + 1e-2
    up = loss()
    net.p["word"][r, 1] = old - 1e-2
    down = loss()
    assert abs((up - down) / 2e-2 - got[1]) < 3e-3


def test_windows_cover_the_whole_text():
    s = Settings(window=8, stride=4)
    for n in range(0, 40):
        at = window_table(n, s)
        assert set(at[at >= 0]) == set(range(n)) and len(at) >= 1
        assert n <= 8 or (at[:-1] >= 0).all()


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    rows = score_toxicity(docs, fit(docs, labels)).join(labels, "doc_id").where("held_out").collect()
    hit = sum(r.predicted == 1 and r.toxic == 1 for r in rows)
    assert hit / sum(r.toxic for r in rows) > 0.55  # a third of the labels have no trace in the text
    assert hit / sum(r.predicted for r in rows) > 0.95


def test_words_anywhere_in_a_long_text():
    rng = np.random.default_rng(3)
    vocab = [f"w{k}" for k in range(300)]
    texts, y = [], []
    for k in range(200):
        words = rng.choice(vocab, 60).tolist()
        if k % 2:
            words[int(rng.integers(0, 60))] = "vilething"
        texts.append(" ".join(words))
        y.append(k % 2)
    net = train(texts, y, Settings(batch=16))
    long = rng.choice(vocab, 9000).tolist()
    bad = long.copy()
    bad[8777] = "VileThing!!"
    score = net.scores(net.text_logits([" ".join(long), " ".join(bad), None, ""]))
    assert score[0] < 0.5 < score[1] and score[2] == score[3] < 0.5
    assert fold("VileThing!!") == "vilething"


def test_awkward_rows(spark, awkward, empty):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    labels = spark.createDataFrame([(1, 1), (2, 0), (7, 0), (9, 1), (4, None), (None, 1), (1, 1)], "doc_id long, toxic int")
    for known in (none, labels):
        rows = score_toxicity(awkward, fit(awkward, known)).collect()
        assert len(rows) == awkward.count() and all(0 <= r.score <= 1 for r in rows)
    assert score_toxicity(empty, fit(empty, labels)).count() == 0


def test_what_is_kept_is_bounded_inside_a_batch(monkeypatch):
    """A batch may hold all rows of a task, so its words must not be kept until it ends."""
    net = Network.fresh(Settings())
    texts = [" ".join(f"w{k}x{i}" for i in range(40)) for k in range(200)] + [None, ""]
    whole = net.scores(net.text_logits(texts))
    monkeypatch.setattr(toxicity_module, "WORDS_KEPT", 400)
    monkeypatch.setattr(toxicity_module, "TEXTS_AT_ONCE", 10)
    cache: dict = {}
    got = toxicity_module.text_scores(net, texts, cache)
    assert np.allclose(got, whole, atol=1e-6) and len(cache["raw"]) <= 400 + 10 * 40
    assert len(cache["gates"]["f"]) < 200 * 40 + 8192
    assert len(toxicity_module.text_scores(net, [], {})) == 0


def test_trigrams_are_looked_up_for_some_words_at_a_time(monkeypatch):
    words = [f"w{k}x{k % 7}" for k in range(100)] + ["", "é"]
    s = Settings()
    net, vocab = Network.fresh(s), Vocabulary.of(words, s)
    whole = net.inputs(vocab)
    most = []

    class Rows(np.ndarray):
        def __getitem__(self, at):
            most.append(len(at))
            return np.asarray(self)[at]

    monkeypatch.setattr(toxicity_module, "WORDS_AT_ONCE", 8, raising=False)
    net.p["char"] = net.p["char"].view(Rows)
    assert (net.inputs(vocab) == whole).all()
    assert max(most) <= 8 * max(len(w) or 1 for w in words)
