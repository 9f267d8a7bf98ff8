"""Features made in the row against the same by joins, and the lookup itself."""

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from loomtext.operators import inrow
from loomtext.operators.dictionary import Dictionary, doc_frequencies
from loomtext.operators.features import WordBag, WordSeq, WordVec, hash_columns
from loomtext.operators.spelling import replace_tokens
from loomtext.plans import text_features


@pytest.fixture(scope="module")
def docs(spark):
    texts = ["a b a c", "", None, "b b b", "ü ö a zz", "c a b a c a b", "nothing known here", "a"]
    rows = [(i, None if t is None else t.split(" ")) for i, t in enumerate(texts)] + [(8, [])]
    return spark.createDataFrame(rows, "doc_id long, tokens array<string>").repartition(3)


def by_joins(monkeypatch, make):
    monkeypatch.setattr(inrow, "MOST_ROWS", -1)
    return sorted(map(str, make().collect()))


def rounded(rows):
    return rows.withColumn("val", F.round("val", 9))


@pytest.mark.parametrize("how", [{}, {"tf": None, "norm": None, "idf": None}, {"tf": "binary", "norm": "l0"}, {"tf": 1.2, "norm": "l1", "idf": 2.0}, {"hash_ngrams": 3, "hash_size": 7, "idf": 1.0, "ngram_weights": (-1.0, 0.5, 2.0)}, {"hash_ngrams": 1, "hash_size": 1000, "polys_window": 4, "polys_mindf": 2, "polys_maxdf": 0.9, "polys_weight": -0.3}, {"polys_window": 2, "polys_mindf": 1, "polys_maxdf": 1.0, "hash_size": 50}])
def test_bags(docs, monkeypatch, how):
    d = Dictionary(min_df=1, max_words=6).fit(docs)
    make = lambda: rounded(WordBag(**how).transform(docs, d))
    got = sorted(map(str, make().collect()))
    assert got and got == by_joins(monkeypatch, make)


@pytest.mark.parametrize("how", [{}, {"remove_oov": True}, {"maxlen": 3}, {"maxlen": 3, "trunc_start": False, "pad_start": False}])
def test_sequences(docs, monkeypatch, how):
    d = Dictionary(max_words=3).fit(docs)
    make = lambda: WordSeq(**how).transform(docs, d)
    got = sorted(map(str, make().collect()))
    assert len(got) == 9 and got == by_joins(monkeypatch, make)


@pytest.mark.parametrize("merge", ["mean", None])
def test_vectors(spark, docs, monkeypatch, merge):
    vectors = spark.createDataFrame([("a", [1.0, 2.0]), ("b", [0.5, -1.0]), ("ü", [3.0, 0.0])], "word string, vec array<double>")
    make = lambda: WordVec(merge=merge).transform(docs, vectors, 2)
    got = sorted(map(str, make().collect()))
    assert got and got == by_joins(monkeypatch, make)


def test_replacements(spark, docs, monkeypatch):
    table = spark.createDataFrame([("a", "x"), ("ö", "oe")], "word string, corrected string")
    make = lambda: replace_tokens(docs.withColumn("other", F.lit(1)), table).select("doc_id", "tokens", "other")
    got = sorted(map(str, make().collect()))
    assert len(got) == 9 and got == by_joins(monkeypatch, make)


def test_rows_of_one_key_are_added_up(spark):
    table = spark.createDataFrame([(1, "u", 2.0), (1, "u", 3.0), (2, None, None)], "k long, s string, x double")
    got = {(r.k, r.idx): r.val for r in hash_columns(table, "k", ["s", "x"], 1 << 20, dtype_specific=True).collect()}
    assert sorted(got.values()) == [0.0, 1.0, 2.0, 5.0]
    assert hash_columns(table, "k", ["s", "x"], 1 << 20, dtype_specific=True, unique=True).count() == 6


def test_lookup_of_many_words_with_nulls():
    words = [f"w{i}" for i in range(5000)] + ["", "é"]
    found = inrow.Lookup(pa.table({"word": words}))
    asked = pa.array(["w17", "é", None, "no", "", "w4999", "w17"])
    assert [words[i] if i >= 0 else None for i in found.find(asked)] == ["w17", "é", None, None, "", "w4999", "w17"]
    assert list(inrow.Lookup(pa.table({"word": pa.array([], pa.string())})).find(asked)) == [-1] * 7


def test_repeated_words_are_not_looked_up(spark):
    assert inrow.lookup(spark.createDataFrame([("a", 1), ("a", 2)], "word string, id long")) is None


def test_small_blocks_give_each_row_its_words(docs, monkeypatch):
    monkeypatch.setattr(inrow, "BLOCK_VALUES", 3)
    d = Dictionary().fit(docs)
    make = lambda: rounded(WordBag(idf=1.0).packed(docs, d).select("doc_id", F.explode(F.arrays_zip("idx", "val")).alias("e")).select("doc_id", "e.*"))
    got = sorted(map(str, make().collect()))
    assert got == by_joins(monkeypatch, make) == sorted(map(str, rounded(WordBag(idf=1.0).transform(docs, d)).collect()))
    blocks = inrow.numbered_blocks(docs, "tokens")
    assert blocks.count() == 9 and blocks.groupBy("__block").count().count() > 4


def test_replacements_in_blocks_of_split_texts(spark, monkeypatch):
    rows = spark.createDataFrame([(1, "a b"), (2, "")], "doc_id long, text string").select("doc_id", F.split(F.coalesce("text", F.lit("")), " ").alias("tokens"))
    monkeypatch.setattr(inrow, "MOST_ROWS", -1)
    got = replace_tokens(rows, spark.createDataFrame([("a", "x")], "word string, corrected string"))
    assert {r.doc_id: r.tokens for r in got.collect()} == {1: ["x", "b"], 2: [""]}


@pytest.mark.parametrize("limits", [{"BLOCK_VALUES": 3}, {"BLOCK_BYTES": 40}, {"WORDS_OF_ROW": 2}])
def test_coded_blocks_keep_rows_and_words(docs, monkeypatch, limits):
    for k, v in limits.items():
        monkeypatch.setattr(inrow, k, v)
    table = docs.sparkSession.createDataFrame([("a", 1), ("b", 2), ("ü", 3), ("never", 4)], "word string, n long")

    def known(own, words):
        n = dict(zip(words["word"].to_pylist(), words["n"].to_pylist()))
        assert "never" not in n
        return pa.table({"doc_id": own["doc_id"], "tokens": own["tokens"], "n": pa.array([None if t is None else [n.get(w, 0) for w in t] for t in own["tokens"].to_pylist()], pa.list_(pa.int64()))})

    rows = docs.unionByName(docs.sparkSession.createDataFrame([(9, ["a", None, "b"])], docs.schema))
    got = inrow.over_blocks(rows, table, "doc_id long, tokens array<string>, n array<long>", known)
    n = {"a": 1, "b": 2, "ü": 3}
    want = {r.doc_id: (r.tokens, None if r.tokens is None else [n.get(w, 0) for w in r.tokens]) for r in rows.collect()}
    assert {r.doc_id: (r.tokens, r.n) for r in got.collect()} == want and got.count() == len(want)


def test_more_blocks_make_more_tasks_not_larger_ones(spark, monkeypatch):
    """With few shuffle partitions, too."""
    monkeypatch.setattr(inrow, "BLOCK_VALUES", 10)
    rows = spark.range(0, 400, 1, 4).select(F.col("id").alias("doc_id"), F.array(F.col("id").cast("string"), F.lit("a")).alias("tokens"))
    table = spark.range(400).select(F.col("id").cast("string").alias("word"), "id")

    def sizes(own, words):
        return pa.table({"rows": [own.num_rows]})

    got = inrow.over_blocks(rows, table, "rows long", sizes)
    blocks = got.count()
    assert blocks > 100 and got.select(F.max("rows")).first()[0] <= 5
    assert got.rdd.getNumPartitions() == blocks


def test_every_block_has_its_own_task(spark, monkeypatch):
    """Blocks spread by hash met in tasks, the more the more blocks there were."""
    monkeypatch.setattr(inrow, "BLOCK_VALUES", 10)
    rows = spark.range(0, 400, 1, 4).select(F.col("id").alias("doc_id"), F.array(F.col("id").cast("string"), F.lit("a")).alias("tokens"))
    table = spark.range(400).select(F.col("id").cast("string").alias("word"), "id")

    def sizes(own, words):
        return pa.table({"rows": [own.num_rows], "words": [words.num_rows]})

    got = inrow.over_blocks(rows, table, "rows long, words long", sizes).withColumn("task", F.spark_partition_id()).collect()
    assert len({r.task for r in got}) == len(got) > 100
    assert sum(r.rows for r in got) == sum(r.words for r in got) == 400
    nothing = inrow.over_blocks(rows.where("doc_id < 0"), table, "rows long, words long", sizes)
    assert nothing.count() == 0


@pytest.mark.parametrize("limits", [{}, {"BLOCK_VALUES": 3}, {"WORDS_OF_ROW": 2}])
def test_blocks_count_words_as_their_rows_do(docs, monkeypatch, limits):
    for k, v in limits.items():
        monkeypatch.setattr(inrow, k, v)
    rows = docs.unionByName(docs.sparkSession.createDataFrame([(9, ["a", None, "b", None]), (10, [None])], docs.schema))
    blocks = inrow.Blocks.of(rows)
    want = sorted(map(str, doc_frequencies(rows).collect()))
    assert sorted(map(str, blocks.frequencies().collect())) == want and blocks.count() == rows.count() == 11
    nothing = inrow.Blocks.of(rows.where("doc_id < 0"))
    assert nothing.count() == 0 and nothing.frequencies().isEmpty()


@pytest.mark.parametrize("how", [{"tf": 1.2, "idf": None}, {"tf": "binary", "idf": 0.0}])
def test_bags_of_large_dictionaries_normalise_texts_once(spark, docs, monkeypatch, how):
    """They did it for the dictionary, for the number of rows and for the blocks."""
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    some = docs.where("tokens is not null").localCheckpoint()
    want = sorted(map(str, WordBag(**how).transform(some, Dictionary().fit(some)).select("doc_id", "idx", F.round("val", 6).alias("val")).collect()))
    monkeypatch.setattr(text_features, "doc_tokens", lambda *_: some.mapInArrow(counted, some.schema))
    monkeypatch.setattr(inrow, "MOST_ROWS", -1)
    got = text_features._bag(spark, "", **how).collect()
    assert seen.value == 8
    assert want and sorted(map(str, got)) == want
