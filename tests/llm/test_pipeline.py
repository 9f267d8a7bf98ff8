"""The stages one after another, each against its plain version."""

import random
from collections import defaultdict

import corpus_pipeline
import pytest
import test_brute_force as B

from loomtext.llm import packing as P

rng = random.Random(9)
STEMS = {"en": "the er th ing st ough wor".split(), "es": "ia los es dad cion que rra".split()}


def word(lang):
    return "".join(rng.choice(STEMS[lang]) for _ in range(rng.randint(2, 4)))


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("sf")
    items = [[word("en") for _ in range(30)] for _ in range(4)]
    rows = []
    for i in range(90):
        lang = rng.choice(list(STEMS))
        words = [word(lang) for _ in range(rng.randint(20, 120))]
        if i % 9 == 0:
            words[5:5] = items[i % 4]
        rows.append([" ".join(words), lang])
        if i % 6 == 1:
            words[len(words) // 2] = word(lang)
            rows.append([" ".join(words), lang])
    rows += [["", "en"], ["??? --", "en"], [None, "es"], [rows[3][0], "en"]]
    docs = [(i, t, lang, "s", len(t or "")) for i, (t, lang) in enumerate(rows)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(list(enumerate(map(" ".join, items))), "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return str(folder), {d[0]: d[1] for d in docs}, items


def test_stages_against_plain_versions(spark, tables):
    folder, texts, items = tables
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["language_id", "near_dedup", "benchmark_decontamination", "packing"] and corpus_pipeline.ORACLE_SQL is None
    left = set(texts)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, folder)
        assert out.columns == docs.columns
        got = sorted(r.doc_id for r in out.collect())
        if name == "language_id":  # texts without words go, clean ones stay
            want = {i for i in left if texts[i] and any(c.isalnum() for c in texts[i])}
        elif name == "near_dedup":
            order = sorted(left)
            vectors = B.weighted_vectors([texts[i] for i in order])
            pairs = [(a, b) for a in range(len(order)) for b in range(a) if B.weighted_jaccard(vectors[a], vectors[b]) >= 0.5]
            roots = B.groups_of(len(order), pairs)
            want = {order[r] for r in roots}
        else:
            want = {i for i in left if all(B.best_local(texts[i].split(), t) < 0.5 for t in items)}
        assert got == sorted(want), name
        assert name == "language_id" or len(want) < len(left)
        left, docs = want, spark.createDataFrame(out.collect(), out.schema)
    by_doc = defaultdict(int)
    rows = corpus_pipeline.run(spark, folder).collect()
    for r in rows:
        by_doc[r.doc_id] += r.tokens
    encoding = P._encoding(open(P.VOCABULARY, "rb").read())
    assert by_doc == {i: len(encoding.encode_ordinary(texts[i])) for i in left}
