import gzip
import json
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from loomtext.operators import compose as C
from loomtext.operators import models as M
from loomtext.operators.dictionary import Dictionary
from loomtext.operators.features import WordBag
from loomtext.sources import io
from loomtext.streaming.incremental import StreamingDictionary, StreamingModel


@pytest.fixture(scope="module")
def table(spark):
    return spark.createDataFrame([(i, i % 5, f"w{i % 3} x") for i in range(40)], "k long, g long, t string")


def test_rows_batches_groups(spark, table):
    got = C.apply_rows(table, lambda a, b, c: a + b * c, ["k", "g"], "y", "long", args=(10,))
    assert {(r.k, r.y) for r in got.collect()} == {(i, i + 10 * (i % 5)) for i in range(40)}
    cached = C.apply_rows(table, str.upper, ["t"], "y", "string", cache=10)
    assert {r.y for r in cached.collect()} == {"W0 X", "W1 X", "W2 X"} and cached.count() == 40
    halves = C.apply_batches(table, lambda t: t[t.k % 2 == 0], table.schema.simpleString()[7:-1].replace(":", " "))
    assert halves.count() == 20
    for size in (2, 200):
        means = C.apply_groups(table, lambda t: t.groupby("g").k.mean().reset_index(), "g", "g long, k double", groups_per_bin=size)
        assert {r.g: r.k for r in means.collect()} == {g: np.mean(range(g, 40, 5)) for g in range(5)}
    wrapped = C.as_column_function(lambda a: a * 2, "long")
    assert table.select(F.sum(wrapped(F.col("k"))).alias("s")).first().s == 2 * sum(range(40))


def test_batches_and_union(spark, table):
    got = {r.k: r.batch for r in C.split_batches(table, "k", 7).collect()}
    assert got == {i: i // 7 for i in range(40)}
    a = spark.createDataFrame([(1, 0, 1.0), (1, 2, 3.0)], "doc_id long, idx long, val double")
    union = C.FeatureUnion([("a", lambda d: a, 3), ("off", None, 5), ("b", lambda d: a, 3)], {"b": 0.5})
    assert {(r.idx, r.val) for r in union.transform(table).collect()} == {(0, 1.0), (2, 3.0), (3, 0.5), (5, 1.5)}
    assert union.feature_names()[:4] == ["a__0", "a__1", "a__2", "b__0"]
    lists = spark.createDataFrame([(1, [3, 3, 5], [1.0, 2.0, 4.0])], "k long, i array<long>, v array<double>")
    assert {(r.idx, r.val) for r in C.ragged_to_features(lists, "k", "i", "v").collect()} == {(3, 3.0), (5, 4.0)}


def test_pipeline_states(spark):
    docs = spark.createDataFrame([(1, "Alpha beta beta"), (2, "beta gamma"), (3, None)], "doc_id long, text string")
    p = C.TextPipeline(extractor=WordBag(idf=None))
    first = p.fit_transform(docs)
    assert p.dictionary.doc_count == 3
    before = p.dictionary
    p.transform(docs)
    assert p.dictionary is before
    p.partial_fit(docs)
    assert p.dictionary.doc_count == 6
    p.frozen = True
    p.fit(docs)
    assert p.dictionary.doc_count == 6 and first.count() == 5


def scalar_ftrl(rows, y, m):
    z, n = np.zeros(m.size + 1), np.zeros(m.size + 1)
    for _ in range(m.iters):
        for (i, x), t in zip(rows, y):
            w = {}
            for j in i:
                w[j] = 0.0 if abs(z[j + 1]) <= m.l1 else (np.sign(z[j + 1]) * m.l1 - z[j + 1]) / (np.sqrt(n[j + 1]) / m.alpha + m.beta / m.alpha + m.l2)
            b = -z[0] / ((m.beta + np.sqrt(n[0])) / m.alpha) if z[0] else 0.0
            e = 1 / (1 + np.exp(-(b + sum(w[j] * v for j, v in zip(i, x))))) - t
            e = max(-m.e_clip, min(m.e_clip, e))
            for j, g, wj in [(0, e, b)] + [(j + 1, e * v, w[j]) for j, v in zip(i, x)]:
                z[j] += g - (np.sqrt(n[j] + g * g) - np.sqrt(n[j])) / m.alpha * wj
                n[j] += g * g
    return z, n


@pytest.fixture(scope="module")
def samples(spark):
    rng = np.random.default_rng(1)
    rows = []
    for d in range(60):
        idx = sorted(rng.choice(20, 5, replace=False).tolist())
        rows.append((d, float(3 in idx or 7 in idx), 1.0, idx, rng.random(5).tolist()))
    return spark.createDataFrame(rows, "doc_id long, y double, w double, idx array<long>, val array<double>")


def test_exact_ftrl_equals_scalar_loop(samples):
    t = samples.toPandas().sort_values("doc_id")
    rows = [(np.array(i), np.array(v)) for i, v in zip(t.idx, t.val)]
    m = M.FTRL(l1=0.05, l2=0.1, iters=4)
    got = M.fit_exact(samples.repartition(5), lambda: M.FTRL(l1=0.05, l2=0.1, iters=4), 20).toPandas()
    m.size = 20
    z, n = scalar_ftrl(rows, t.y.to_numpy(), m)
    for r in got.itertuples():
        assert (r.z, r.n) == pytest.approx((z[r.i], n[r.i]), abs=1e-9)
    assert len(got) == int(((z != 0) | (n != 0)).sum())


def test_models_learn_and_predict(spark, samples):
    y = {r.doc_id: r.y for r in samples.collect()}
    for make in (lambda: M.FTRL(l1=0.01, l2=0.01, iters=30), lambda: M.FTRL(l1=0.01, l2=0.01, iters=30, dtype=np.float32), lambda: M.FactorizationMachine(rank=4, iters=40), lambda: M.relu_1(init=0.5, iters=60), lambda: M.relu_2(init=0.8, iters=120)):
        got = M.fit_predict(samples, make, 20).toPandas()
        good = np.mean([(s > 0.5) == (y[d] > 0.5) for d, s in zip(got.doc_id, got.score)])
        assert good > 0.85, make()
    layers = M.fit_predict(samples, lambda: M.relu_2(iters=1), 20, layer=2).toPandas()
    assert len(layers) == 60 * 4 and (layers.score >= 0).all()


def scalar_fm(rows, y, m, v):
    """Steps of a factorisation machine, a number at a time: FTRL for the weights, shrinking steps for the factors."""
    z, n, nf = np.zeros(m.size + 1), np.zeros(m.size + 1), np.zeros(m.size)
    for (i, x), t in zip(rows, y):
        weight = lambda j: 0.0 if abs(z[j + 1]) <= m.l1 else (np.sign(z[j + 1]) * m.l1 - z[j + 1]) / (np.sqrt(n[j + 1]) / m.alpha + m.beta / m.alpha + m.l2)
        b = -z[0] / ((m.beta + np.sqrt(n[0])) / m.alpha) if z[0] else 0.0
        w = {j: weight(j) for j in i}
        pair = sum(sum(v[a][f] * v[c][f] for f in range(m.rank)) * p * q for k, (a, p) in enumerate(zip(i, x)) for c, q in list(zip(i, x))[k + 1 :])
        e = b + sum(w[j] * p for j, p in zip(i, x)) + m.weight_fm * pair - t
        e = max(-m.e_clip, min(m.e_clip, e))
        total = [sum(v[j][f] * p for j, p in zip(i, x)) for f in range(m.rank)]
        for j, g, wj in [(0, e, b)] + [(j + 1, e * p, w[j]) for j, p in zip(i, x)]:
            z[j] += g - (np.sqrt(n[j] + g * g) - np.sqrt(n[j])) / m.alpha * wj
            n[j] += g * g
        for j, p in zip(i, x):
            rate = m.alpha_fm / (np.sqrt(nf[j]) + 1)
            for f in range(m.rank):
                v[j][f] -= rate * p * (e * (total[f] - v[j][f] * p) + m.l2_fm * v[j][f])
            nf[j] += e * e
    return z, v


def scalar_net(rows, y, m, w, c):
    """Back-propagation unit by unit, a number at a time."""
    a, l2 = m.alpha, m.l2

    def inputs_of(j, d, i, x):
        for p, q in zip(i, x):
            g = d * q
            w[0][p][j] -= (g + l2 * w[0][p][j]) * a / (c[0][p] ** 0.5 + 1)
            c[0][p] += abs(g)

    def unit(j, k, layer, z, d):
        """Unit j, whose value z goes on to unit k of the next layer with derivative d; gives its own derivative."""
        g = d * z
        r = a / (c[layer][j] ** 0.5 + 1)
        w[layer][j][k] -= (g + l2 * w[layer][j][k]) * r
        own = d * w[layer][j][k]
        w[layer - 1][-1][j] -= (own + l2 * w[layer - 1][-1][j]) * r
        return own, abs(g)

    for (i, x), t in zip(rows, y):
        z1 = [max(0.0, sum(w[0][p][j] * q for p, q in zip(i, x)) + w[0][-1][j]) for j in range(m.units[0])]
        zs = [z1] if len(m.units) == 1 else [z1, [max(0.0, sum(w[1][j][k] * z for j, z in enumerate(z1)) + w[1][-1][k]) for k in range(m.units[1])]]
        e = sum(w[-1][j][0] * z for j, z in enumerate(zs[-1])) + w[-1][-1][0] - t
        e = max(-m.e_clip, min(m.e_clip, e))
        w[-1][-1][0] -= a * (e + l2 * w[-1][-1][0])
        tops = [(0, e, None)]
        if len(m.units) == 2:
            tops = [(k, None, k) for k, z in enumerate(zs[1]) if z > 0]
        for k, d, second in tops:
            if second is not None:
                d, size = unit(second, 0, 2, zs[1][second], e)
            for j, z in enumerate(z1):
                if z > 0:
                    own, g = unit(j, k, 1, z, d)
                    inputs_of(j, own, i, x)
                    c[1][j] += g
            if second is not None:
                c[2][second] += size
    return w


def test_kernels_equal_scalar_loops(samples):
    t = samples.toPandas().sort_values("doc_id")
    rows, y = [(np.array(i), np.array(v)) for i, v in zip(t.idx, t.val)], t.y.to_numpy()
    fm = M.FactorizationMachine(rank=3, e_noise=0.0, init_fm=0.5)
    fm.reset(20)
    z, v = scalar_fm(rows, y, fm, fm.v.tolist())
    fm.partial(rows, y, iters=1)
    assert np.allclose(fm.z, z) and np.allclose(fm.v, v)
    for net in (M.relu_1(units=(4,), e_noise=0.0, init=1.0), M.relu_2(units=(5, 3), e_noise=0.0, init=1.5, l2=0.01)):
        net.reset(20)
        w = scalar_net(rows, y, net, [x.tolist() for x in net.w], [x.tolist() for x in net.c])
        net.partial(rows, y, iters=1)
        assert all(np.allclose(a, b) for a, b in zip(net.w, w)) and net.c[-1].any()


MAKERS = [lambda: M.FTRL(l1=0.05, iters=2), lambda: M.FactorizationMachine(rank=3, iters=2), lambda: M.relu_1(init=0.5, iters=2), lambda: M.relu_2(init=0.5, iters=2)]


@pytest.mark.parametrize("make", MAKERS)
def test_states_go_on_and_predict(spark, samples, make):
    t = samples.toPandas().sort_values("doc_id")
    rows, y = [(np.array(i), np.array(v)) for i, v in zip(t.idx, t.val)], t.y.to_numpy()
    m = make()
    m.reset(20)
    for _ in range(2):
        m.renew()
        m.partial(rows, y, iters=1)
    state = M.fit_exact(samples.repartition(4), make, 20)
    got = {r.doc_id: r.score for r in M.predict(samples.select("doc_id", "idx", "val"), state, make, 20).collect()}
    assert got == pytest.approx(dict(zip(t.doc_id, m.predict(rows))), abs=1e-9)
    again = make().load(state.toPandas(), 20)
    assert all(np.allclose(a, b) for a, b in zip(again.parameters().values(), m.parameters().values()))
    by_jobs = M.partial_fit(samples, None, make, 20, held_values=0)
    key = lambda r: tuple(r)[:-1]
    assert sorted(map(str, map(key, by_jobs.collect()))) == sorted(map(str, map(key, state.collect())))
    first = M.partial_fit(samples.where("doc_id < 30"), None, make, 20, epochs=1)
    both = M.partial_fit(samples.where("doc_id >= 30"), first, make, 20, epochs=1).toPandas()
    m.reset(20)
    m.partial(rows[:30], y[:30], iters=1)
    m.renew()
    m.partial(rows[30:], y[30:], iters=1)
    assert all(np.allclose(a, b) for a, b in zip(make().load(both, 20).parameters().values(), m.parameters().values()))
    averaged = M.fit_averaged(samples.repartition(3), make, 20, epochs=1)
    assert averaged.count() > 5 and M.predict(samples, averaged, make, 20).count() == 60


def test_averaging_one_replica_is_exact(samples):
    for make in (lambda: M.FTRL(l1=0.05, iters=1), lambda: M.FactorizationMachine(rank=3, iters=1)):
        one = samples.repartition(1).sortWithinPartitions("doc_id")
        a, b = (make().load(x.toPandas(), 20).parameters() for x in (M.fit_averaged(one, make, 20, epochs=1), M.fit_exact(samples, make, 20)))
        assert all(np.allclose(a[k], b[k]) for k in a)


def test_models_by_key_and_empty_tables(spark, samples):
    make = lambda: M.FTRL(l1=0.05, iters=2)
    keyed = samples.withColumn("g", F.col("doc_id") % 3)
    got = M.fit_exact(keyed, make, 20, model_key="g")
    for g in range(3):
        alone = M.fit_exact(keyed.where(F.col("g") == g), make, 20)
        assert sorted(map(tuple, got.where(F.col("model") == str(g)).drop("model").collect())) == sorted(map(tuple, alone.drop("model").collect()))
    assert M.fit_exact(samples.limit(0), make, 20).count() == 0
    kept = M.partial_fit(samples.limit(0), got, make, 20)
    assert sorted(map(tuple, kept.collect())) == sorted(map(tuple, got.collect()))


def test_streamed_model_equals_partial_fits_and_replays(spark, samples, tmp_path):
    make = lambda: M.FTRL(l1=0.05, iters=1)
    for i in range(3):
        samples.where(F.col("doc_id") % 3 == i).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    s = StreamingModel(str(tmp_path / "state"), make=make, size=20)
    s.run(spark.readStream.schema(samples.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")), str(tmp_path / "marks")).awaitTermination()
    state = None
    for i in range(3):
        state = M.partial_fit(samples.where(F.col("doc_id") % 3 == i), state, make, 20, epochs=1)
    assert sorted(map(tuple, s.latest(spark).collect())) == sorted(map(tuple, state.collect()))
    s.update(samples, 2)
    assert sorted(map(tuple, s.latest(spark).collect())) == sorted(map(tuple, state.collect()))


def test_decorators_and_batch_transformer(spark):
    rows = spark.createDataFrame([(i, i % 3, float(i)) for i in range(30)], "k long, g long, x double")

    @C.batch_function("k long, y double")
    def scaled(t, by, plus=0.0):
        return t[["k"]].assign(y=t.x * by + plus)

    assert {r.k: r.y for r in scaled(rows, 2.0, plus=1.0).collect()} == {i: 2.0 * i + 1 for i in range(30)}

    @C.group_function("g", "g long, s double", groups_per_bin=1)
    def sums(t):
        return t.groupby("g").x.sum().rename("s").reset_index()

    assert {r.g: r.s for r in sums(rows).collect()} == {g: float(sum(range(g, 30, 3))) for g in range(3)}

    class Centred:
        def fit(self, df):
            self.mean = df.agg(F.avg("x")).first()[0]

        def transform(self, t):
            return t[["k"]].assign(y=t.x - self.mean)

    got = C.BatchTransformer(Centred(), "k long, y double").fit_transform(rows)
    assert got.agg(F.sum("y")).first()[0] == pytest.approx(0)


def test_union_is_fitted_and_has_parameters(spark):
    @dataclass(frozen=True)
    class Count:
        least: int = 0
        seen: int = 0

        def fit(self, docs):
            return replace(self, seen=docs.count())

        def transform(self, docs):
            return docs.select("doc_id", F.lit(0).alias("idx"), F.lit(float(self.seen + self.least)).alias("val"))

    docs = spark.createDataFrame([(1,), (2,)], "doc_id long")
    union = C.FeatureUnion([("n", Count(), 1), ("gone", "drop", 5), ("one", lambda d: d.select("doc_id", F.lit(0).alias("idx"), F.lit(1.0).alias("val")), 1)])
    assert union.get_params()["n__least"] == 0 and union.get_params(deep=False).keys() == {"weights", "n", "gone", "one"}
    union.set_params(n__least=5, weights={"one": 3.0})
    assert sorted(map(tuple, union.fit_transform(docs).collect())) == [(1, 0, 7.0), (1, 1, 3.0), (2, 0, 7.0), (2, 1, 3.0)]
    with pytest.raises(ValueError, match="no part"):
        union.set_params(other=1)


def test_join_prediction_equals_kernel(spark, samples):
    state = M.fit_exact(samples, lambda: M.FTRL(l1=0.05, iters=3), 20)
    long = samples.select("doc_id", F.explode(F.arrays_zip("idx", "val")).alias("e")).select("doc_id", "e.idx", "e.val")
    got = {r.doc_id: r.score for r in M.predict_linear(long, M.finalized(state), samples).collect()}
    want = {r.doc_id: r.score for r in M.fit_predict(samples, lambda: M.FTRL(l1=0.05, iters=3), 20).collect()}
    assert got == pytest.approx(want, abs=1e-9)
    averaged = M.fit_averaged(samples.repartition(3), lambda: M.FTRL(l1=0.01), 20, epochs=2)
    assert averaged.count() > 5


def test_io_round_trips(spark, tmp_path):
    rows = spark.createDataFrame([(1, 5, 0.5)], "doc_id long, idx long, val double")
    io.save_table(rows, str(tmp_path / "f"), columns=99)
    back, meta = io.load_table(spark, str(tmp_path / "f"))
    assert back.collect() == rows.collect() and meta == {"columns": 99}
    calls = []
    for _ in range(2):
        got = io.cached(spark, str(tmp_path / "c"), lambda: calls.append(1) or rows)
    assert len(calls) == 1 and got.count() == 1
    tokens = spark.createDataFrame([(1, ["a", "b"])], "doc_id long, tokens array<string>")
    d = Dictionary(max_words=7, max_df=0.9).fit(tokens)
    io.save_dictionary(d, str(tmp_path / "d"))
    e = io.load_dictionary(spark, str(tmp_path / "d"))
    assert (e.doc_count, e.max_words, e.max_df) == (1, 7, 0.9) and e.words.count() == 2


def test_sources(spark, tmp_path):
    (tmp_path / "v.gz").write_bytes(gzip.compress(b"2 3\nCat 1 2 3\ncat 3 2 1\ndog 1 0\nbad x y z\n"))
    got = {r.word: r.vec for r in io.read_word_vectors(spark, str(tmp_path / "v.gz"), dim=3, normalize=F.lower).collect()}
    assert got == {"cat": [2.0, 2.0, 2.0]}
    lines = [json.dumps({"Reviews": [{"Content": f"c{i}", "Ratings": {"Overall": "5"} if i % 2 == 0 else {}} for i in range(4)]}), "{broken"]
    (tmp_path / "r.json").write_text("\n".join(lines))
    assert {(r.content, r.label) for r in io.read_reviews(spark, str(tmp_path / "r.json")).collect()} == {("c0", 1.0), ("c2", 1.0)}
    (tmp_path / "t.csv").write_text("text,airline_sentiment\n@air hello there,positive\n@sky hello there,negative\nbye,neutral\n")
    assert {(r.text, r.label) for r in io.read_tweets(spark, str(tmp_path / "t.csv")).collect()} == {("hello there", 1), ("bye", 0)}  # the first row of a text is the one that counts
    assert sorted((r.id, r.text) for r in io.read_tweets(spark, str(tmp_path / "t.csv")).collect()) == [(0, "hello there"), (1, "bye")]
    last = io.read_word_vectors(spark, str(tmp_path / "v.gz"), dim=3, normalize=F.lower, merge=False).collect()
    assert [(r.word, r.vec) for r in last] == [("cat", [3.0, 2.0, 1.0])]
    more = [json.dumps({"Reviews": [{"Content": f"d{i}", "Ratings": {"Overall": str(1 + i)}} for i in range(3)]}), "{broken", json.dumps({"Reviews": [{"Content": f"e{i}", "Ratings": {"Overall": "5"}} for i in range(4)]})]
    (tmp_path / "s.json").write_text("\n".join(more))
    assert sorted(r.content for r in io.read_reviews(spark, str(tmp_path / "s.json"), every=2).collect()) == ["d0", "d2", "e1", "e3"]


def test_stream_equals_batch_and_replays(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"word{i % 4} common") for i in range(20)], "doc_id long, text string")
    docs.repartition(4).write.parquet(str(tmp_path / "in"))
    s = StreamingDictionary(str(tmp_path / "state"), Dictionary())
    s.run(spark.readStream.schema(docs.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")), str(tmp_path / "marks")).awaitTermination()
    d = s.latest(spark)
    assert d.doc_count == 20
    assert {(r.word, r.df) for r in d.words.collect()} == {("common", 20)} | {(f"word{i}", 5) for i in range(4)}
    s.update(docs, 1)
    assert s.latest(spark).doc_count == 20


@pytest.mark.parametrize("make", MAKERS + [lambda: M.FTRL(l1=0.01, init=0.5), lambda: M.FactorizationMachine(rank=3, iters=1, init=0.3)])
def test_large_states_are_applied_by_their_features(spark, samples, make, monkeypatch):
    state = M.fit_exact(samples, make, 50)
    rows = samples.select("doc_id", "idx", "val").unionByName(spark.createDataFrame([(-1, [49, 51], [1.0, 2.0]), (-2, [], [])], "doc_id long, idx array<long>, val array<double>"))
    want = {r.doc_id: r.score for r in M.predict(rows, state, make, 50).collect()}
    monkeypatch.setattr(M, "MOST_SENT", -1)
    assert {r.doc_id: r.score for r in M.predict(rows, state, make, 50).collect()} == pytest.approx(want, abs=1e-12) and len(want) == 62


def test_packed_rows_are_predicted_like_long_ones(spark, samples, monkeypatch):
    rows = samples.select("doc_id", "idx", "val")
    long = rows.select("doc_id", F.explode(F.arrays_zip("idx", "val")).alias("e")).select("doc_id", "e.*")
    weights = spark.createDataFrame([(0, 0.2)] + [(i, 0.1 * i) for i in range(1, 15)], "i long, w double")
    want = {r.doc_id: r.score for r in M.predict_linear(long, weights, rows).collect()}
    for most in (M.MOST_SENT, -1):
        monkeypatch.setattr(M, "MOST_SENT", most)
        assert {r.doc_id: r.score for r in M.predict_packed(rows, weights).collect()} == pytest.approx(want, abs=1e-12)
