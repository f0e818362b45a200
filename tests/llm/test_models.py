"""Classifiers: held-out accuracy, awkward inputs, whole texts."""

import numpy as np
import pyarrow as pa
import pytest

from litsieve.llm import language_id, quality, toxicity
from tests.llm import cases

SF = "/root/testdata/sf0.01"


def held_out(spark, scored, table, column, predicted):
    truth = spark.read.parquet(f"{SF}/{table}.parquet").select("doc_id", column)
    rows = scored.where("held_out").join(truth, "doc_id").collect()
    return np.mean([r[column] == r[predicted] for r in rows]), rows


def test_language(spark):
    scored = language_id.op6_language_id(spark, SF)
    accuracy, rows = held_out(spark, scored, "documents", "lang", "lang_pred")
    assert accuracy > 0.98 and all(0 <= r.score <= 1 for r in rows)
    assert scored.count() == spark.read.parquet(f"{SF}/documents.parquet").count()


def test_quality(spark):
    accuracy, rows = held_out(spark, quality.op3_quality(spark, SF), "labels", "quality", "predicted")
    assert accuracy > 0.9 and all(r.predicted == int(r.score >= 0.3) for r in rows)


def constant(rows, column):
    """Accuracy of always guessing the commoner label."""
    ones = sum(r[column] for r in rows if r[column] is not None)
    known = sum(r[column] is not None for r in rows)
    return max(ones, known - ones) / known


def test_toxicity(spark):
    accuracy, rows = held_out(spark, toxicity.op9_toxicity(spark, SF), "labels", "toxic", "predicted")
    assert accuracy > 0.95 > constant(rows, "toxic") and all(r.predicted == int(r.score >= 0.5) for r in rows)


def test_toxicity_learns_by_training(spark):
    """The trained filters do the work: the random start guesses, and so does always saying the commoner label."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    rows = toxicity.draw_sample(docs, labels, "toxic", 1500)
    train, test = rows[:1000], rows[1000:]
    accuracy = []
    for epochs in (0, None):
        model = toxicity.fit([r[3] for r in train], np.array([r[1] for r in train], np.float32), [r[2] for r in train], epochs)
        scores = [s for r in test for s in 1 / (1 + np.exp(-(model.raw_logits(r[3], np.array([0, len(r[3])])) - model.shifts[model.languages(r[3], np.array([0, len(r[3])]))])))]
        accuracy.append(np.mean([(s >= 0.5) == r[1] for s, r in zip(scores, test, strict=True)]))
    guess = max(np.mean([r[1] for r in test]), 1 - np.mean([r[1] for r in test]))
    assert accuracy[1] > 0.97 and accuracy[1] > guess + 0.05 and accuracy[1] > accuracy[0] + 0.05


def test_toxicity_scores_by_brute_force():
    """One document at a time, window by window, against the batch form."""
    r = np.random.default_rng(3)
    texts = [" ".join(f"w{k}" for k in r.integers(0, 50, n)) for n in (0, 1, 2, 3, 7, 40)]
    model = toxicity.ConvolutionalClassifier(seed=5)
    model.embedding[:] = r.normal(size=model.embedding.shape)
    model.bias[:] = r.normal(0, 0.1, model.bias.shape)
    want = []
    for text in texts:
        data = np.frombuffer(text.encode(), np.uint8)
        codes = toxicity.word_codes(data, np.array([0, len(data)]))[0]
        e, n = [model.embedding[c].astype(float).sum(axis=0) for c in codes], len(codes)
        columns = []
        for width, f in zip(toxicity.WIDTHS, model.filters, strict=True):
            for c in range(toxicity.FILTERS):
                values = [sum(float(e[k + j] @ f[j, :, c]) for j in range(width)) if k + width <= n else 0.0 for k in range(n)]
                thirds = [values[n * t // 3 : n * (t + 1) // 3] for t in range(3)]
                columns.append(sorted((max(t) if t else 0.0 for t in thirds), reverse=True))
        pooled = np.array([column[t] for t in range(3) for column in columns])
        logit = np.maximum(pooled + model.bias, 0) @ model.out + model.out_bias
        want.append(1 / (1 + np.exp(-logit)))
    assert model.scores(pa.array([t.encode() for t in texts], pa.binary())) == pytest.approx(want, abs=1e-4)


def test_long_texts_are_scored_alike_in_blocks(monkeypatch):
    r = np.random.default_rng(3)
    model = toxicity.ConvolutionalClassifier(seed=5)
    model.embedding[:] = r.normal(size=model.embedding.shape)
    model.language, model.shifts = r.normal(size=(toxicity.LANGUAGE_BUCKETS, 3)).astype(np.float32), np.array([0.0, 0.5, -0.5])
    texts = [" ".join(f"w{k}" for k in r.integers(0, 50, n)).encode() for n in (1, 2, 4, 5, 29, 30, 31, 200)]
    want = model.scores(pa.array(texts, pa.binary()))
    monkeypatch.setattr(toxicity, "LONG_BYTES", 0)
    for block in (1, 3, 10, 1000):
        monkeypatch.setattr(toxicity, "LONG_BLOCK", block)
        assert model.scores(pa.array(texts, pa.binary())) == pytest.approx(want, abs=1e-5)


def test_quality_scores_by_brute_force():
    """Every pair of features summed one by one, over whole texts."""
    r = np.random.default_rng(3)
    texts = ["", "A a b", "Same same SAME #1 x!", " ".join(f"w{k}" for k in r.integers(0, 9, 60))]
    model = quality.FactorisationMachine(seed=2)
    model.w[:] = r.normal(size=model.w.shape)
    want = []
    for text in texts:
        data = np.frombuffer(text.encode(), np.uint8)
        ((index, x),) = quality.features(data, np.array([0, len(data)]))
        pairs = sum(float(model.v[a].astype(float) @ model.v[b].astype(float)) * x[i] * x[j] for i, a in enumerate(index) for j, b in enumerate(index) if i < j)
        want.append(1 / (1 + np.exp(-(float(model.w[index].astype(float) @ x) + pairs))))
    assert quality._scores(model, pa.array([t.encode() for t in texts], pa.binary())) == pytest.approx(want, abs=1e-4)


def test_class_counts_over_segments(monkeypatch):
    monkeypatch.setattr(quality, "SEGMENT", 3)
    text = "Ab1!\n\u00e9 zZ9".encode()
    assert quality._class_counts(np.frombuffer(text + text, np.uint8), np.array([0, len(text), len(text), 2 * len(text)])) == [[2, 4, 2, 1, 1], [0] * 5, [2, 4, 2, 1, 1]]


def test_samples_hold_one_row_an_id(spark):
    rows = [(1, "copy", "en", "a")] * 200 + [(2, "two", "en", "a"), (3, "three", "fr", "a"), (None, "none", "en", "a")]
    labels = spark.createDataFrame([(k, k % 2, k % 2) for k in (1, 2, 3)], "doc_id long, quality int, toxic int")
    drawn = toxicity.draw_sample(spark.createDataFrame(rows, cases.SCHEMA).repartition(5), labels, "toxic", 3, 100)
    assert len(drawn) == len({r[0] for r in drawn}) <= 3


def test_language_awkward(spark):
    df = cases.docs(spark)
    model = language_id.fit_language_model(df)
    got = {r.doc_id: r.lang_pred for r in language_id.predict_language(df, model).collect()}
    assert got[0] == got[1] == got[4] == "und" and got[5] in ("en", "de", "fr")
    assert language_id.fit_language_model(cases.empty(spark)) is None
    assert {r.lang_pred for r in language_id.predict_language(df, None).collect()} == {"und"}
    assert language_id.predict_language(cases.empty(spark), model).count() == 0
    kept = language_id.keep_identified(df)
    assert kept.columns == df.columns and {0, 1, 4}.isdisjoint(r.doc_id for r in kept.collect())


@pytest.mark.parametrize("module", [quality, toxicity])
def test_labelled_awkward(spark, module):
    fit, score = (quality.fit_quality_model, quality.score_quality) if module is quality else (toxicity.fit_toxicity_model, toxicity.score_toxicity)
    df = cases.docs(spark)
    rows = [(2, 1, 0), (2, 0, 1), (3, 1, 0), (5, 0, 1), (7, None, None), (None, 1, 1), (99, 1, 0)]
    labels = spark.createDataFrame(rows, "doc_id long, quality int, toxic int")
    model = fit(df, labels)
    got = score(df, model).collect()
    assert len(got) == df.count() and all(0 <= r.score <= 1 for r in got)
    none = fit(df, labels.limit(0))
    assert none is None and {r.score for r in score(df, none).collect()} == {0.5 if module is quality else 0.0}
    assert score(cases.empty(spark), model).count() == 0


def test_keep_good(spark):
    df = cases.docs(spark)
    labels = spark.createDataFrame([], "doc_id long, quality int")
    assert quality.keep_good(df, labels).count() == df.count() and quality.keep_good(df, labels).columns == df.columns


def test_factorisation_machine_identity():
    m = quality.FactorisationMachine(20, 3, seed=1)
    m.w[:] = np.arange(20) / 10
    index, x = np.array([1, 4, 7, 19]), np.array([0.5, 1.0, -2.0, 0.3])
    pairs = sum(float(m.v[a] @ m.v[b]) * x[i] * x[j] for i, a in enumerate(index) for j, b in enumerate(index) if i < j)
    assert m.logit(index, x) == pytest.approx(float(m.w[index] @ x) + pairs, abs=1e-5)


def test_character_grams(monkeypatch):
    text = "Abc \u041f\u0440\u0418 \u6f22\u5b57\u4e2d \U0001f600z" * 40
    data = np.frombuffer(text.encode(), np.uint8)
    (whole,) = language_id.gram_buckets(data)
    assert len(whole) == 2 * len(text) - 3
    (small,) = language_id.gram_buckets(np.frombuffer(text.lower().encode(), np.uint8))
    assert (whole == small).all()
    index, counts = language_id.gram_counts(data)
    for block in (7, 64):
        monkeypatch.setattr(language_id, "BLOCK", block)
        pieces = np.concatenate(list(language_id.gram_buckets(data)))
        assert sorted(pieces.tolist()) == sorted(whole.tolist())
    monkeypatch.setattr(language_id, "BUCKETS", 1 << 16)
    again = language_id.gram_counts(data)
    assert (again[0] == index).all() and (again[1] == counts).all()


def test_language_scores_by_brute_force():
    """The score of a document as the sum over its n-grams of share x inverse frequency x weight, one by one."""
    r = np.random.default_rng(1)
    weights, idf = r.normal(size=(3, language_id.BUCKETS)), r.uniform(0, 3, language_id.BUCKETS)
    model = language_id.LanguageModel(["a", "b", "c"], weights * idf * 30, np.array([0.1, 0.0, -0.1]), 1.7, idf)
    for text in ("ab", "Some words here", "\u0395\u03bb\u03bb\u03b7\u03bd\u03b9\u03ba\u03ac " * 30):
        data = np.frombuffer(text.encode(), np.uint8)
        grams = np.concatenate(list(language_id.gram_buckets(data))).tolist()
        logits = [sum(grams.count(g) / len(grams) * idf[g] * 30 * weights[k, g] for g in set(grams)) + model.bias[k] for k in range(3)]
        p = np.exp((np.array(logits) - max(logits)) / 1.7)
        language, score, _ = model.predict(data)
        assert language == "abc"[int(p.argmax())] and score == pytest.approx(p.max() / p.sum(), abs=1e-4)


def test_foreign_text_is_not_identified(spark):
    """Text in no learned language goes, whatever the best of the learned ones is; the learned languages stay."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    foreign = [(10**6 + k, t * 20) for k, t in enumerate(["\u041f\u0440\u0438\u0432\u0435\u0442 \u043c\u0438\u0440 \u0438 \u0432\u0441\u0435\u043c. ", "\u6f22\u5b57\u6587\u5316\u5713\u4e2d\u570b\u8a71\u8a9e\u8a00", "xqzj wvkq zzxq jjqx kkwv "])]
    extra = spark.createDataFrame([(i, t, None, "s", len(t)) for i, t in foreign], docs.schema)
    kept = {r.doc_id for r in language_id.keep_identified(docs.unionByName(extra)).select("doc_id").collect()}
    assert not kept & {i for i, _ in foreign} and len(kept) >= 0.99 * docs.where("text rlike '[a-zA-Z]'").count()


def test_scores_read_whole_texts():
    codes, first = toxicity.word_codes(np.frombuffer(b"one two three one", np.uint8), np.array([0, 17]))
    assert first.tolist() == [0, 4] and codes[0].tolist() == codes[3].tolist()
    values = list(quality.features(np.frombuffer(b"A a b", np.uint8), np.array([0, 5])))
    assert len(values) == 1 and len(values[0][0]) == 2 + quality.STATISTICS
    assert len(toxicity.ConvolutionalClassifier().scores(pa.array([b"", b"a", b"a b"], pa.binary()))) == 3


def test_toxicity_sample_ignores_the_layout(spark):
    """A labelled text of very many words, wherever it stands, changes no other row's use; nor does the partitioning. Rows are whole."""
    rows = [(k, " ".join(f"w{k}x{j}" for j in range(50_000 if k == 1 else 200)), "en" if k < 100 else "fr", "s") for k in range(200)]
    labels = spark.createDataFrame([(k, k % 2) for k in range(200)], "doc_id long, toxic int")
    drawn = []
    for some, parts, words in ((rows, 1, 60_000), (rows[::-1], 50, 60_000), ([r for r in rows if r[0] != 1], 3, 60_000), (rows, 2, 20_000), (rows[::-1], 7, 20_000), (rows, 3, 10**6)):
        df = spark.createDataFrame(some, cases.SCHEMA).repartition(parts)
        drawn.append([(i, y, lang, c.tobytes()) for i, y, lang, c in toxicity.draw_sample(df, labels, "toxic", 1000, words)])
    assert drawn[0] == drawn[1] == drawn[2] and drawn[3] == drawn[4]
    assert {r[2] for r in drawn[2]} == {"en", "fr"} and all(len(r[3]) == 200 * 16 for r in drawn[2])
    assert len(drawn[3]) == 100 and set(drawn[3]) < set(drawn[2])  # in the order of their hashes, as many as fit
    assert {r[0] for r in drawn[5]} - {r[0] for r in drawn[2]} == {1} and {len(r[3]) for r in drawn[5] if r[0] == 1} == {50_000 * 16}


def test_steps_in_parts():
    docs = [np.zeros((n, 4), np.int32) for n in (5, 0, 30, 3, 4, 100, 1)]
    split = [p.tolist() for p in toxicity._in_parts(np.arange(7), docs, 10)]
    assert split == [[0, 1], [2], [3, 4], [5], [6]] and [p.tolist() for p in toxicity._in_parts(np.arange(7), docs, 1000)] == [list(range(7))]


def test_factorisation_machine_step():
    """One Adagrad step against numeric derivatives of the loss."""
    r = np.random.default_rng(4)
    index, x, y, l2, rate = np.array([1, 4, 7]), np.array([0.5, 1.0, -0.3]), 1, 1e-5, 0.15
    model = quality.FactorisationMachine(10, 3)
    model.w[:], model.v[:], model.w0 = r.normal(0, 0.3, 10), r.normal(0, 0.3, (10, 3)), 0.2

    def loss(w0, w, v):
        pairs = sum((v[a] @ v[b]) * x[i] * x[j] for i, a in enumerate(index) for j, b in enumerate(index) if i < j)
        return np.log1p(np.exp(-(w0 + w[index] @ x + pairs)))

    start = (model.w0, model.w.astype(np.float64), model.v.astype(np.float64))
    model.fit([(index, x, y)], epochs=1, rate=rate, l2=l2)
    assert model.w0 - start[0] == pytest.approx(rate * 1.0, rel=1e-3)  # the first step of Adagrad has its rate's length
    for k, scale in ((1, rate), (2, 0.3 * rate)):
        for at in np.ndindex(start[k].shape):
            moved = (model.w, model.v)[k - 1][at] - start[k][at]
            up, down = ([a.copy() if k2 else a for k2, a in enumerate(start)] for _ in range(2))
            up[k][at] += 1e-5
            down[k][at] -= 1e-5
            g = (loss(*up) - loss(*down)) / 2e-5 + (l2 * start[k][at] if at[0] in index else 0)
            assert moved == pytest.approx(-scale * g / np.sqrt(1e-6 + g * g), abs=2e-3)


def test_ftrl_against_one_coordinate_at_a_time():
    r = np.random.default_rng(6)
    rows = [(np.sort(r.choice(50, 6, replace=False)), r.normal(size=6), int(r.integers(0, 3))) for _ in range(15)]
    alpha, beta, l1, l2 = 0.5, 1.0, 0.05, 0.01
    got, bias = language_id.fit_ftrl(rows, 3, alpha, beta, l1, l2, epochs=2)
    z, n = {}, {}

    def weight(key, l1):
        zk, nk = z.get(key, 0.0), n.get(key, 0.0)
        return 0.0 if abs(zk) <= l1 else -(zk - np.sign(zk) * l1) / ((beta + nk**0.5) / alpha + l2)

    order = np.random.default_rng(11)
    for _ in range(2):
        for k in order.permutation(len(rows)):
            index, values, y = rows[k]
            features = [*zip(index.tolist(), values.tolist(), strict=True), (-1, 1.0)]
            w = {(c, i): weight((c, i), 0.0 if i < 0 else l1) for c in range(3) for i, _ in features}
            logits = np.array([sum(w[c, i] * v for i, v in features) for c in range(3)])
            p = np.exp(logits) / np.exp(logits).sum()
            for c in range(3):
                for i, v in features:
                    g = (p[c] - (c == y)) * v
                    old = n.get((c, i), 0.0)
                    z[c, i] = z.get((c, i), 0.0) + g - ((old + g * g) ** 0.5 - old**0.5) / alpha * w[c, i]
                    n[c, i] = old + g * g
    want = np.array([[weight((c, i), l1) for i in range(50)] for c in range(3)])
    assert np.allclose(got[:, :50], want) and not got[:, 50:].any() and np.allclose(bias, [weight((c, -1), 0.0) for c in range(3)])
    assert (want == 0).sum() > 5  # the penalty leaves some at nothing


def test_convolution_step():
    """The first step of Adagrad moves each weight against the numeric derivative of the loss (pooling by nearly the maximum)."""
    r = np.random.default_rng(8)
    docs = [r.integers(0, 40, (n, 4)).astype(np.int32) for n in (7, 12, 1, 20)]
    y = np.array([1, 0, 1, 0], np.float32)
    codes, first = np.concatenate(docs), np.concatenate([[0], np.cumsum([len(d) for d in docs])])
    model = toxicity.ConvolutionalClassifier(5)
    model.embedding = model.embedding.astype(np.float64) * 20
    model.filters = [f.astype(np.float64) for f in model.filters]
    model.out = r.normal(0, 0.5, model.out.shape)
    model.bias = np.full(model.bias.shape, 0.3)

    def loss():
        logits = model.raw_logits(codes, first).astype(np.float64)
        return np.mean(np.log1p(np.exp(logits)) - y * logits)

    chosen = [(a, tuple(r.integers(0, s) for s in a.shape)) for a in (model.out, model.bias, *model.filters) for _ in range(12)]
    chosen += [(model.embedding, (int(r.integers(0, 40)), int(r.integers(0, toxicity.DIMENSIONS)))) for _ in range(25)]
    before, slopes = [], []
    for a, at in chosen:
        own = a[at]
        a[at] = own + 1e-4
        up = loss()
        a[at] = own - 1e-4
        slopes.append((up - loss()) / 2e-4)
        a[at] = own
        before.append(own)
    toxicity._Trainer(model).step(docs, y, 1e-4)
    moved = np.array([a[at] for a, at in chosen]) - before
    slopes = np.array(slopes)
    clear = np.abs(slopes) > 2e-3
    assert clear.sum() > 20 and (np.sign(moved[clear]) == -np.sign(slopes[clear])).mean() > 0.95


def test_rare_languages_are_learned(spark):
    rows = [(k, f"the cat number {k} and the dog sat here", "en", "s") for k in range(400)] + [(k, f"der hund nummer {k} und die katze", "de", "s") for k in range(400, 800)]
    rows += [(900 + k, f"zxqj wvkq xqzz {k} qwxz", "xx", "s") for k in range(2)]
    df = spark.createDataFrame(rows, cases.SCHEMA)
    model = language_id.fit_language_model(df, sample_rows=20)
    assert model.languages == ["de", "en", "xx"]
    assert {r.lang_pred for r in language_id.predict_language(df.where("doc_id >= 900"), model).collect()} == {"xx"}
