"""Nulls, empty and very long texts, ties, repeated rows, empty tables, clashing names: for every operator."""

import pytest
from pyspark.sql import functions as F

from loomtext.llm import registry
from loomtext.llm.chat_format import format_chats
from loomtext.llm.decontaminate import contaminated, decontaminate
from loomtext.llm.html_wrapper import extract_content
from loomtext.llm.language_crf import label_words, reject_unreliable
from loomtext.llm.license_scan import scan
from loomtext.llm.near_dedup import keep_one_of_each, near_duplicates
from loomtext.llm.packing import pack
from loomtext.llm.permutation_index import neighbours
from loomtext.llm.url_rules import filter_urls
from loomtext.llm.warc import rewrite_pages

LONG = "lorem ipsum " * 60_000
CLASH = ["k", "root", "n", "h", "u", "row", "id", "v", "bin", "tokens", "own", "__own_k", "scope", "unit", "key", "g", "f", "host", "x", "bad", "t", "file"]
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def wide(df):
    return df.select("*", *[F.lit(f"c{i}").alias(c) for i, c in enumerate(CLASH) if c not in df.columns])


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(None, None, None, None, None), (1, "", "en", "s", 0), (1, "", "en", "s", 0), (2, "!!! ...", None, None, 3), (3, LONG, "en", None, None), (4, "one", "en", "s", 3), (None, "the same few words are here", "en", None, 1), (None, "the same few words are here", "en", None, 1), (7, "a\u0000b   c", "fr", "", -1), (8, "x" * 300_000, "fr", None, None), (9, "Licensed under the MIT License.", "en", None, None)]
    return wide(spark.createDataFrame(rows, DOCS))


@pytest.fixture(scope="module")
def items(spark):
    return wide(spark.createDataFrame([(1, "the same few words are here"), (None, None), (2, ""), (3, "one"), (1, "the same few words are here")], "item_id long, text string"))


def test_odd_documents(spark, odd, items):
    assert sorted((r.doc_id, r.scope, r.license) for r in scan(odd).collect()) == [(9, "document", "MIT")]
    near = near_duplicates(odd).collect()
    assert sorted((str(r.doc_id), str(r.keep_id), r.exact) for r in near) == [("1", "1", True)] * 2 + [("None", "None", True)] * 2
    kept = keep_one_of_each(odd)
    assert kept.columns == odd.columns and kept.count() == odd.count() - 2
    packed = pack(odd).collect()
    assert sum(r.tokens for r in packed if r.doc_id == 3) > 100_000 and not any(r.doc_id == 1 for r in packed)
    pairs = sorted((str(r.doc_id), r.item_id, r.score) for r in contaminated(odd, items).collect())
    assert pairs == [("4", 3, 1.0)] + [("None", 1, 1.0)] * 4
    clean = decontaminate(odd, items)
    assert clean.columns == odd.columns and sorted(str(r.doc_id) for r in clean.collect()) == sorted(["None", "1", "1", "2", "3", "7", "8", "9"])
    labels = label_words(odd)
    assert labels.count() == odd.count()
    assert all(r.language is None and not r.accepted and r.words == 0 and r.run_at == [] for r in labels.collect() if r.doc_id in (1, 2))
    stay = reject_unreliable(odd)
    assert stay.columns == odd.columns and not {1, 2} & {r.doc_id for r in stay.collect()}


def test_odd_others(spark):
    turns = spark.createDataFrame([(None, None, None, None), (1, 0, "user", "b"), (1, 0, "user", "a"), (1, 0, "user", "a"), (1, None, "assistant", ""), (2, 5, None, LONG)], "conv_id long, turn long, role string, text string")
    got = {r.conv_id: r for r in format_chats(wide(turns)).collect()}
    assert got[1].text == "<|im_start|>assistant\n<|im_end|>\n" + "<|im_start|>user\na<|im_end|>\n" * 2 + "<|im_start|>user\nb<|im_end|>\n"
    assert got[None].text == "<|im_start|>\n<|im_end|>\n" and got[2].bytes == len(got[2].text.encode()) and got[1].turns == 4
    pages = spark.createDataFrame([(None, None, None), (1, "", ""), (1, "", ""), (2, "http://a.b/1", "<p>x<p>y" * 3), (3, "http://a.b/2\n", "<b>" * 5000 + "deep"), (4, "http://a.b/3", LONG)], "page_id long, url string, html string")
    content = {(r.page_id, r.host): r.content for r in extract_content(wide(pages)).collect()}
    assert content[(3, "a.b")] == "deep" and content[(None, "")] == "" and content[(4, "a.b")] == LONG.strip()
    assert content == {(r.page_id, r.host): r.content for r in extract_content(wide(pages), broadcast_bytes=0, held_nodes=1).collect()}
    index = rewrite_pages(wide(pages)).collect()
    assert sorted(str(r.page_id) for r in index) == ["1", "1", "2", "3", "4", "None"]
    marks = spark.createDataFrame([(1, None, None), (None, 1, 1), (1, 0, None), (1, 1, 0)], "doc_id long, quality int, toxic int")
    assert filter_urls(wide(pages), wide(marks)).count() == 6
    vectors = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 0.0]), (2, [1.0, 0.0]), (None, [0.0, 1.0]), (5, None), (6, [0.0, 0.0]), (7, [1.0]), (8, [float("nan"), 1.0]), (9, [None, 1.0])], "vec_id long, embedding array<float>")
    near = neighbours(wide(vectors), k=2).collect()
    assert {r.vec_id for r in near} == {1, 2, None} and len(near) == 8
    assert [(r.neighbour_id, r.similarity) for r in near if r.vec_id == 1] == [(2, 1.0), (2, 1.0)]


def test_empty_tables(spark, odd, items):
    none, no_items = odd.limit(0), items.limit(0)
    assert [x.count() for x in (scan(none), near_duplicates(none), keep_one_of_each(none), pack(none), contaminated(none, items), contaminated(odd, no_items), decontaminate(none, items), label_words(none), reject_unreliable(none))] == [0] * 9
    assert decontaminate(odd, no_items).count() == odd.count()
    empty = lambda schema: spark.createDataFrame([], schema)
    pages = empty("page_id long, url string, html string")
    assert [x.count() for x in (format_chats(empty("conv_id long, turn long, role string, text string")), extract_content(pages), rewrite_pages(pages), filter_urls(pages, empty("doc_id long, quality int, toxic int")), neighbours(empty("vec_id long, embedding array<float>")))] == [0] * 5


def test_every_operator_has_a_query():
    names = sorted(registry.queries())
    assert [sum(n.startswith(f"op{i}_") for n in names) for i in range(1, 11)] == [1] * 10
