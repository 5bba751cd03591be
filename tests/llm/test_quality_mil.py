import numpy as np

from tracefold.llm.quality_mil import CUT, Model, Settings, blocks_of, fit, read_passages, score_quality, train


def small(**more):
    return Settings(words=4, grams=8, width=3, gate=2, **more)


def test_gradients_are_right():
    s = small()
    model = Model.fresh(s)
    model.p = {k: v.astype(np.float64) + 0.1 for k, v in model.p.items()}
    rng = np.random.default_rng(0)
    x, starts = rng.standard_normal((9, s.inputs)), np.array([0, 1, 5])
    y, weight = np.array([1.0, 0.0, 1.0]), np.array([0.5, 1.5, 1.0])

    def loss():
        logit = model.forward(x, starts)[0]
        return float((weight * (np.logaddexp(0, logit) - y * logit)).mean())

    g = model.gradients(x, starts, y, weight)
    for name, p in model.p.items():
        flat = p.reshape(-1)
        for k in rng.integers(0, len(flat), 4):
            old, eps = flat[k], 1e-5
            flat[k] = old + eps
            up = loss()
            flat[k] = old - eps
            down = loss()
            flat[k] = old
            assert abs((up - down) / (2 * eps) - g[name].reshape(-1)[k]) < 1e-6, name


def test_passages_of_whole_texts():
    s = Settings(words=5)
    texts = ["", " \n ", "one two", "a b c d e f g h i j k", "x" * 50, "ä ö\nü  ß é à"]
    x, home = read_passages([b for t in texts for b in blocks_of(t, s.block)], s)
    assert np.bincount(home).tolist() == [1, 1, 1, 3, 1, 2]
    alone = [read_passages([t.encode()], s)[0] for t in texts]
    assert np.allclose(x, np.concatenate(alone))  # neighbours in a batch change nothing
    assert np.allclose(x[:, :10].sum(1), 1) and x[6, 13] == 0


def test_repetition_shows():
    s = Settings(words=6)
    x, _ = read_passages([b"go go go go go go", b"one two three four five six one two three four five six"], s)
    assert x[0, 11] > 0.8 and x[0, 12] > 0.8 and x[1, 11] == x[1, 12] == x[1, 13] == 0
    assert abs(x[2, 13] - 4 / 6) < 1e-6


def test_blocks_add_up():
    text = " ".join(f"wörd{k}" for k in range(500))
    assert b"".join(blocks_of(text, 64)) == text.encode() and max(map(len, blocks_of(text, 64))) <= 64
    assert b"".join(blocks_of("x" * 300, 64)) == b"x" * 300
    model = Model.fresh(Settings(block=256))
    long = model.logits([text])[0]  # block by block
    x, _ = read_passages(blocks_of(text, 256), model.s)
    assert abs(long - model.forward(x, np.zeros(1, np.int64))[0][0]) < 1e-5


def test_one_poor_passage_in_many():
    """The label is the text's, the attention finds the passage."""
    rng = np.random.default_rng(3)
    s = Settings(words=8, passes=30)
    vocab = [f"wo{chr(97 + k % 26)}rd{chr(97 + k // 26)}" for k in range(300)]
    texts, y = [], []
    for k in range(240):
        words = rng.choice(vocab, 80).tolist()
        if k % 2:
            at = int(rng.integers(0, 10)) * 8
            words[at : at + 8] = [w + "$$$" for w in words[at : at + 8]]
        texts.append(" ".join(words))
        y.append(1 - k % 2)
    model = train([read_passages([t.encode()], s)[0] for t in texts], y, s)
    words = rng.choice(vocab, 160).tolist()
    clean, words[96:104] = " ".join(words), [w + "###" for w in words[96:104]]
    score = model.scores([clean, " ".join(words), None, ""])
    assert score[1] < CUT < score[0] and score[2] == score[3]
    assert model.attention(" ".join(words)).argmax() == 12 and abs(model.attention(clean).sum() - 1) < 1e-5


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    rows = score_quality(docs, fit(docs, labels)).join(labels, "doc_id").where("held_out").collect()
    poor = sum(r.quality == 0 for r in rows)
    assert sum(r.quality == 0 and r.predicted == 0 for r in rows) > 0.95 * poor
    assert sum(r.quality == 1 and r.predicted == 1 for r in rows) > 0.99 * (len(rows) - poor)


def test_awkward_rows(spark, awkward, empty):
    none = spark.createDataFrame([], "doc_id long, quality int")
    labels = spark.createDataFrame([(1, 1), (2, 0), (7, 0), (9, 1), (4, None), (None, 1), (1, 1), (99, 0)], "doc_id long, quality int")
    for known in (none, labels, labels.where("quality = 1")):
        rows = score_quality(awkward, fit(awkward, known)).collect()
        assert len(rows) == awkward.count() and all(0 <= r.score <= 1 for r in rows)
        assert known is labels or all(r.predicted == 1 for r in rows)
        assert len({r.score for r in rows if r.doc_id == 1}) == 1
    assert score_quality(empty, fit(empty, labels)).count() == 0


def test_equal_texts_score_alike_in_any_batch():
    rng = np.random.default_rng(4)
    texts = [" ".join(f"w{i}" for i in rng.integers(0, 500, int(rng.integers(1, 300)))) for _ in range(60)]
    model = Model.fresh(Settings())
    alone = [float(model.scores([t])[0]) for t in texts]
    assert alone == model.scores(texts).tolist() == model.scores(texts[::-1]).tolist()[::-1]
