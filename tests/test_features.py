import random

import numpy as np
import pytest
from models_by_hand import bag, deleted, dictionary, distance
from pyspark.sql import functions as F

from loomtext.operators.dictionary import Dictionary, doc_frequencies
from loomtext.operators.features import WordBag, WordSeq, WordVec, default_salt, encode_categories, hash_columns, to_vectors, word_hash
from loomtext.operators.spelling import Tokenizer, corrections

rng = random.Random(5)
WORDS = ["the", "of", "cat", "cut", "cats", "form", "from", "été", "日本", "xyzzy", "a", "bb"]
DOCS = [[rng.choice(WORDS[: rng.randint(2, 12)]) for _ in range(rng.randint(1, 14))] for _ in range(30)] + [[""], ["zz"]]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(list(enumerate(DOCS)), "doc_id long, tokens array<string>")


@pytest.fixture(scope="module")
def known(docs):
    return Dictionary().fit(docs)


def ids(d):
    return {r.word: r.id for r in d.encoded().collect()}


def test_dictionary(docs, known):
    assert ids(known) == dictionary(DOCS)[0]
    assert known.doc_count == len(DOCS)
    assert ids(Dictionary(max_words=4, min_df=2).fit(docs)) == dictionary(DOCS, 4, 2)[0]
    assert ids(Dictionary(max_df=0.3).fit(docs)) == dictionary(DOCS, high=0.3 * len(DOCS))[0]
    assert ids(Dictionary(max_df=1).fit(docs)) == dictionary(DOCS, high=1)[0]


def test_partial_fit_keeps_ids_and_adds_counts(docs, known):
    first = Dictionary().fit(docs.where("doc_id < 10"))
    both = first.partial_fit(docs.where("doc_id >= 10"))
    before, after = ids(first), ids(both)
    assert {w: after[w] for w in before} == before
    assert sorted(after.values()) == list(range(1, len(after) + 1))
    count = lambda d: {(r.word, r.df) for r in d.words.collect()}
    assert count(both) == count(known)


def test_prune(known):
    all_ids, df = dictionary(DOCS)
    kept = known.prune(max_words=6, min_df=3)
    assert ids(kept) == {w: i for w, i in all_ids.items() if i <= 6 and df[w] >= 3}
    assert kept.max_words == len(ids(kept))
    dense = known.prune(max_df=0.3, re_encode=True, drop_counts=False)
    assert ids(dense) == {w: i for w, i in all_ids.items() if df[w] <= 0.3 * len(DOCS)}
    assert dense.words.count() == len(df)


@pytest.mark.parametrize(
    "how",
    [dict(norm=n, tf=t, idf=i) for n in ("l0", "l1", "l2", None) for t, i in (("log", 0.0), ("binary", 50.0))]
    + [dict(tf=None, idf=None), dict(tf=1.2, idf=3.0), dict(hash_ngrams=3, ngram_weights=(-1.0, -0.5, 1.0), hash_size=37, idf=50.0), dict(hash_ngrams=1, hash_size=101, polys_window=4, polys_mindf=2, polys_weight=-0.1, idf=50.0)],
)
def test_bag(docs, known, how):
    all_ids, df = dictionary(DOCS)
    got = {}
    for r in WordBag(**how).transform(docs, known).collect():
        got.setdefault(r.doc_id, {})[r.idx] = r.val
    for i, tokens in enumerate(DOCS):
        want = bag(tokens, all_ids, df, len(DOCS), **how)
        assert got.get(i, {}) == pytest.approx(want, abs=1e-12), (i, tokens)


def test_one_document_has_no_idf(spark):
    one = spark.createDataFrame([(1, ["a", "b"])], "doc_id long, tokens array<string>")
    assert WordBag().transform(one, Dictionary().fit(one)).count() == 0


def test_to_vectors_keeps_empty_documents(docs, known):
    rows = to_vectors(docs, WordBag().transform(docs, known.prune(max_words=2)), 100).collect()
    assert len(rows) == len(DOCS) and any(not r.indices for r in rows)


def test_sequences(docs):
    d = Dictionary(max_words=5).fit(docs)
    known = ids(d)
    for how in (dict(), dict(maxlen=6), dict(maxlen=6, pad_start=False, trunc_start=False, pad_id=9), dict(remove_oov=True, maxlen=3)):
        s = WordSeq(**how)
        for r in s.transform(docs, d).collect():
            want = [known.get(w, 6) for w in DOCS[r.doc_id] if not s.remove_oov or w in known]
            if s.maxlen:
                pad = [s.pad_id] * (s.maxlen - len(want))
                want = (want[-s.maxlen :] if s.trunc_start else want[: s.maxlen])
                want = pad + want if s.pad_start else want + pad
            assert r.ids == want


def test_word_vectors(spark, docs):
    vectors = spark.createDataFrame([("the", [1.0, 0.0]), ("of", [0.0, 2.0])], "word string, vec array<double>")
    table = {"the": (1.0, 0.0), "of": (0.0, 2.0)}
    for r in WordVec(norm=None).transform(docs, vectors, 2).collect():
        own = [table.get(w, (0.0, 0.0)) for w in DOCS[r.doc_id]]
        assert r.vec == pytest.approx([sum(x) / len(own) for x in zip(*own)])
    each = {r.doc_id: r.vec for r in WordVec(merge=None).transform(docs, vectors, 2).collect()}
    assert all(len(v) == len(DOCS[i]) for i, v in each.items())


def test_corrections(docs, known):
    _, df = dictionary(DOCS)
    for count, dist in ((8, 1), (8, 2), (12, 2)):
        want = {}
        for w, c in df.items():
            if c <= count and len(w) >= 3:
                near = [x for x, n in df.items() if n > count and len(x) <= 15 and deleted(w, dist) & deleted(x, dist) and distance(w, x) <= dist]
                if near:
                    want[w] = min(near, key=lambda x: (-df[x], x))
        assert {r.word: r.corrected for r in corrections(known.words, count, dist).collect()} == want


def test_tokenizer_without_options_is_identity(docs):
    assert Tokenizer(0, 2).fit(docs).transform(docs) is docs


def test_tokenizer_replaces_in_order(docs):
    t = Tokenizer(8, 2, stem=lambda w: w.upper()).fit(docs)
    for r in t.transform(docs).collect():
        assert len(r.tokens) == len(DOCS[r.doc_id]) and all(x == x.upper() for x in r.tokens)


def test_hashed_columns_and_categories(spark):
    assert default_salt("o_order status|x") == "oosx"
    rows = spark.createDataFrame([(1, "x", 0.5, True), (2, None, 2.0, False), (3, "x", 1.0, True)], "k long, c string, v double, b boolean")
    got = hash_columns(rows, "k", ["c", "v", "b"], 64, dtype_specific=True, weights={"v": 2.0})
    assert got.groupBy("k").agg(F.sum("val").alias("s")).orderBy("k").collect()[0].s == 1.0 + 1.0 + 1.0
    codes = {r.k: r.code for r in encode_categories(rows, "k", "c").collect()}
    assert codes == {1: 1, 2: 2, 3: 1}
    assert word_hash(spark.createDataFrame([(1, "ab ab c"), (2, None)], "doc_id long, text string"), 16, (1, 2), norm=None).count() >= 1


def test_word_vectors_of_words_beyond_the_first_100000(spark, tmp_path):
    from loomtext.plans.text_features import _word_vectors

    words = " ".join(f"w{i:06d}" for i in range(100_003))
    spark.createDataFrame([(0, words)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(0, [1.0]), (100_001, [2.0])], "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    assert {r.word: r.vec for r in _word_vectors(spark, str(tmp_path)).collect()} == {"w100002": [1.0], "w000001": [2.0]}


def test_first_normal_word(spark):
    from loomtext.functions import text as T

    texts = [None, "", "a", "a B cd", "--Ab9 x", "É école", "x1\ny2", "a b c", "1 22 333", "Iİ ab", "a-bc_d"]
    rows = spark.createDataFrame([(t,) for t in texts], "text string")
    got = rows.select(T.first_word(T.normalize_default(F.col("text"))).alias("a"), T.first_normal_word(F.col("text")).alias("b")).collect()
    assert [r.b for r in got] == [r.a for r in got] and "cd" in [r.b for r in got]


def test_corrections_to_candidates_of_any_length(spark):
    """Against all pairs: deletions shared and edits within the distance, also above 15 characters."""
    rng = np.random.default_rng(5)
    cut = lambda w, d: {w} if not d else {x for v in cut(w, d - 1) for x in [v, *(v[:i] + v[i + 1 :] for i in range(len(v)))]}

    def edits(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row, old = [i], row
            for j, y in enumerate(b, 1):
                row.append(min(old[j] + 1, row[-1] + 1, old[j - 1] + (x != y)))
        return row[-1]

    common = ["".join(rng.choice(list("ab"), n)) for n in (14, 15, 15, 16, 16, 17, 18, 22, 30)]
    rare = set()
    for w in common:
        for _ in range(25):
            v = list(w)
            for _ in range(rng.integers(1, 4)):
                i, how = int(rng.integers(len(v))), int(rng.integers(3))
                v[i : i + (how != 0)] = list(rng.choice(list("abc"), int(how != 1)))
            rare.add("".join(v))
    rare -= set(common)
    df = {w: 10 + i % 3 for i, w in enumerate(common)}
    for dist in (1, 2):
        want = {}
        for w in rare:
            near = [(-df[c], c) for c in common if edits(w, c) <= dist and (cut(w, dist) - {w}) & (cut(c, dist) - {c})]
            if near:
                want[w] = min(near)[1]
        words = spark.createDataFrame([(w, 1) for w in rare] + list(df.items()), "word string, df long")
        assert {r.word: r.corrected for r in corrections(words, 8, dist, longest=None).collect()} == want
        assert any(len(c) > 15 for c in want.values())


def test_document_frequencies_need_no_python(spark):
    rows = spark.createDataFrame([(["a", "b", "a", None, None],), (["", "a"],), ([],), (None,), ([None],)], "tokens array<string>").coalesce(1)
    got = doc_frequencies(rows)
    assert {r.word: r.df for r in got.collect()} == {"a": 2, "b": 1, None: 2, "": 1}
    assert {r.word: r.df for r in doc_frequencies(spark.createDataFrame([([1, 1, 2],), ([2],)], "n array<int>"), "n").collect()} == {"1": 1, "2": 2}
    assert "Arrow" not in got._jdf.queryExecution().executedPlan().toString()
