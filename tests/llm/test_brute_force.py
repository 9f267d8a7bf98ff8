"""Every operator that SQL can't express against a plain version over all pairs or all rows."""

import gzip
import io
import math
import random
import re
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from pyarrow import fs
from pyspark.sql import functions as F

from loomtext.llm import decontaminate as D
from loomtext.llm import html_wrapper as H
from loomtext.llm import language_crf as L
from loomtext.llm import near_dedup as N
from loomtext.llm import packing as P
from loomtext.llm import permutation_index as X
from loomtext.llm import url_rules as U
from loomtext.llm import warc as W
from loomtext.llm.chat_format import SQL, format_chats
from loomtext.llm.license_scan import canonical, scan, sql

rng = random.Random(3)
VOCABULARY = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 8))) for _ in range(900)]


def prose(n):
    return [rng.choice(VOCABULARY) for _ in range(n)]


def edited(words, share):
    out = []
    for w in words:
        x = rng.random()
        if x < share / 3:
            continue
        out.append(rng.choice(VOCABULARY) if x < share else w)
    return out


# --- near duplicates


def weighted_vectors(texts, size=3):
    """TF-IDF over exact document frequencies, which the operator's tables give as long as few entries are taken."""
    vectors = []
    for t in texts:
        row, g, tf = N.shingles(pa.array([t], pa.large_string()), size)
        vectors.append(dict(zip(g.tolist(), tf.tolist())))
    df = Counter(x for v in vectors for x in v)
    n = sum(bool(v) for v in vectors)
    return [{x: c * math.log1p(n / df[x]) for x, c in v.items()} for v in vectors]


def weighted_jaccard(a, b):
    most = sum(max(a.get(x, 0), b.get(x, 0)) for x in a.keys() | b.keys())
    return sum(min(a[x], b[x]) for x in a.keys() & b.keys()) / most if most else 0.0


def groups_of(n, pairs):
    root = list(range(n))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in pairs:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return [find(i) for i in range(n)]


def test_near_duplicates_against_all_pairs(spark):
    texts = []
    for _ in range(40):
        base = prose(rng.randint(20, 200))
        texts.append(" ".join(base))
        texts += [" ".join(edited(base, rng.choice([0.02, 0.05, 0.3]))) for _ in range(rng.randint(0, 4))]
    hot = prose(60)
    texts += [" ".join(hot)] * 30 + [" ".join(edited(hot, 0.03)) for _ in range(60)]
    shared = prose(70)
    texts += [" ".join(prose(150) + shared + prose(100)) for _ in range(25)]
    rng.shuffle(texts)
    vectors = weighted_vectors(texts)
    pairs = [(a, b, weighted_jaccard(vectors[a], vectors[b])) for a in range(len(texts)) for b in range(a) if vectors[a].keys() & vectors[b].keys()]
    truth = groups_of(len(texts), [(a, b) for a, b, s in pairs if s >= 0.5])
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.keep_id for r in N.near_duplicates(docs.repartition(3)).collect()}
    sizes = Counter(truth)
    want = {i: r for i, r in enumerate(truth) if sizes[r] > 1}
    right = sum(got.get(i) == r for i, r in want.items())
    assert right >= 0.97 * len(want)
    for i, k in got.items():  # nothing is grouped that all pairs don't join
        assert truth[i] == truth[k]
    kept = {r.doc_id for r in N.keep_one_of_each(docs).collect()}
    assert kept == set(range(len(texts))) - {i for i, k in got.items() if i != k}


def test_near_duplicates_against_exact_document_frequencies(spark):
    rows = [r for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect() if r.text]
    counts, holders = [], defaultdict(list)
    for i, r in enumerate(rows):
        _, g, tf = N.shingles(pa.array([r.text], pa.large_string()), 3)
        counts.append(dict(zip(g.tolist(), tf.tolist())))
        for x in counts[i]:
            holders[x].append(i)
    n = sum(map(bool, counts))
    vectors = [{x: c * math.log1p(n / len(holders[x])) for x, c in v.items()} for v in counts]
    shared = Counter((a, b) for own in holders.values() if len(own) <= 400 for a in own for b in own if b < a)
    pairs = [p for p, c in shared.items() if c >= 0.2 * min(len(counts[p[0]]), len(counts[p[1]])) and weighted_jaccard(vectors[p[0]], vectors[p[1]]) >= 0.5]
    truth = groups_of(len(rows), pairs)
    sizes = Counter(truth)
    want = {rows[i].doc_id: rows[r].doc_id for i, r in enumerate(truth) if sizes[r] > 1}
    got = {r.doc_id: r.keep_id for r in N.near_duplicates(spark.createDataFrame(rows)).collect()}
    assert sum(got.get(i) == k for i, k in want.items()) >= 0.97 * len(want) > 100
    assert len(got.keys() - want.keys()) <= 0.01 * len(want)


def test_consistent_samples_estimate_weighted_jaccard():
    a, b = prose(300), None
    b = a[:200] + prose(100)
    col = pa.array([" ".join(a), " ".join(b)], pa.large_string())
    row, g, tf = N.shingles(col, 1)
    weight = tf * np.where(g % np.uint64(3) == 0, 2.5, 0.7)
    _, keys = N.band_keys(row, g, weight, 4000, 1)
    own = [dict(zip(g[row == i].tolist(), weight[row == i].tolist())) for i in (0, 1)]
    assert abs((keys[0] == keys[1]).mean() - weighted_jaccard(*own)) < 0.03


def test_components(spark):
    pairs = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(400 + i, 401 + i) for i in range(40)]
    pairs = [p for p in pairs if p[0] != p[1]]
    b = lambda i: i.to_bytes(16, "big")
    edges = spark.createDataFrame([(bytearray(b(x)), bytearray(b(y))) for x, y in pairs], "a binary, b binary")
    got = {int.from_bytes(r.k, "big"): int.from_bytes(r.root, "big") for r in N.components(edges).collect()}
    truth = groups_of(500, pairs)
    nodes = {x for p in pairs for x in p}
    assert got == {i: truth[i] for i in nodes}


# --- decontamination


def best_local(doc, item):
    above, most = [0] * (len(doc) + 1), 0
    for y in item:
        row = [0]
        for j, x in enumerate(doc):
            row.append(max(0, above[j] + (D.MATCH if x == y else D.MISS), above[j + 1] + D.GAP, row[j] + D.GAP))
        most, above = max(most, *row), row
    return most / (D.MATCH * len(item))


def test_decontamination_against_all_alignments(spark):
    items = [prose(rng.randint(12, 50)) for _ in range(25)] + [prose(1), prose(2), prose(3)]
    docs = []
    for i in range(120):
        d = prose(rng.randint(5, 150))
        if i % 2:
            at = rng.randint(0, len(d))
            d = d[:at] + edited(rng.choice(items[:25]), rng.choice([0, 0.1, 0.25, 0.4])) + d[at:]
        docs.append(d)
    docs += [prose(10) + items[0] + prose(10) for _ in range(60)]
    table = spark.createDataFrame([(i, " ".join(d)) for i, d in enumerate(docs)], "doc_id long, text string")
    bench = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(items)], "item_id long, text string")
    truth = {(i, j): s for i, d in enumerate(docs) for j, t in enumerate(items) if (s := best_local(d, t)) >= (0.5 if len(t) > 3 else 1.0)}
    for part_words in (4_000_000, 200):
        got = {(r.doc_id, r.item_id): r.score for r in D.contaminated(table, bench, part_words=part_words).collect()}
        assert got.keys() <= truth.keys()
        assert all(abs(got[k] - truth[k]) < 1e-9 for k in got)
        assert len(got) >= 0.97 * len(truth)
        clear = {k for k, s in truth.items() if s >= 0.6}
        assert clear <= got.keys()
    kept = {r.doc_id for r in D.decontaminate(table, bench).collect()}
    assert kept == set(range(len(docs))) - {i for i, _ in got}


@pytest.mark.parametrize("kind", ["int", "string", "double", "smallint"])
def test_items_of_any_key(spark, kind):
    items = spark.createDataFrame([(1, "one two three four five six"), (2, "seven eight nine ten eleven"), (None, "one two three four five six")], "item_id int, text string").withColumn("item_id", F.col("item_id").cast(kind))
    docs = spark.createDataFrame([("a", "so one two three four five six so"), (None, "seven eight nine ten eleven"), ("c", "no")], "doc_id string, text string")
    got = D.contaminated(docs, items)
    one = {"string": "1", "double": 1.0}.get(kind, 1)
    assert got.schema["item_id"].dataType == items.schema["item_id"].dataType
    assert Counter((r.doc_id, r.item_id) for r in got.collect()) == Counter([("a", one), ("a", None), (None, one * 2 if kind != "string" else "2")])


# --- packing


def test_nnls_against_random_search():
    r = np.random.default_rng(0)
    for _ in range(5):
        a, b = r.random((8, 12)), r.random(8) * 3 - 0.5
        x = P.nnls(a, b)
        assert (x >= 0).all()
        g = a.T @ (b - a @ x)  # optimal: no gradient on used columns, none upwards elsewhere
        assert np.abs(g[x > 1e-9]).max(initial=0) < 1e-6 and g.max() < 1e-6


def test_plans_use_every_piece_once():
    r = np.random.default_rng(1)
    for h in (np.zeros(65, int), np.eye(1, 65, 64, dtype=int)[0] * 7, r.integers(0, 500, 65), np.bincount(np.clip(r.lognormal(2.5, 1, 20000).astype(int), 1, 64), minlength=65)):
        h[0] = 0
        plan = P.plan(h)
        used = sum((n * np.bincount(c, minlength=65) for c, n in zip(plan.combos, plan.times)), np.zeros(65, int))
        assert (used == h).all() and all(sum(c) <= 64 for c in plan.combos)
    assert len(plan.combos) and sum(plan.times) <= 1.01 * (h * np.arange(65)).sum() / 64 + 1
    assert set(P.combinations(9)) == {tuple(sorted(c, reverse=True)) for c in [(9,)] + [(a, 9 - a) for a in range(1, 9)] + [(a, b, 9 - a - b) for a in range(1, 8) for b in range(1, 9 - a)]}


@pytest.mark.parametrize("shard", [1 << 18, 50])
def test_packed_pieces_tile_the_documents(spark, shard):
    texts = [" ".join(prose(rng.choice([1, 3, 40, 300, 2500]))) for _ in range(150)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    counts = {r.doc_id: r.n for r in P.token_counts(docs).collect()}
    encoding = P._encoding(open(P.VOCABULARY, "rb").read())
    assert counts == {i: len(encoding.encode_ordinary(t)) for i, t in enumerate(texts)}
    rows = P.pack(docs, window=512, shard=shard).collect()
    by_doc, by_bin = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append((r.start, r.tokens))
        by_bin[r.bin].append((r.at, r.tokens))
    for i, n in counts.items():
        at = 0
        for start, tokens in sorted(by_doc[i]):
            assert start == at and 0 < tokens <= 512
            at += tokens
        assert at == n
    for pieces in by_bin.values():
        pieces.sort()
        assert all(a + n <= b for (a, n), (b, _) in zip(pieces, pieces[1:] + [(512, 0)]))
    assert sorted(by_bin) == list(range(len(by_bin)))
    assert len(by_bin) <= 1.06 * sum(counts.values()) / 512 + 2


# --- language labels


def test_marginals_against_all_paths():
    import itertools

    r = np.random.default_rng(0)
    e, t, s = r.normal(size=(19, 3)) * 2, r.normal(size=(3, 3)), r.normal(size=3)
    begins = [0, 4, 5, 12, 19]
    restart = np.zeros(19, bool)
    restart[begins[:-1]] = True
    got = L.marginals(e, restart, t, s)
    for a, z in zip(begins, begins[1:]):
        total = np.zeros((z - a, 3))
        for path in itertools.product(range(3), repeat=z - a):
            p = np.exp(s[path[0]] + sum(e[a + i, y] for i, y in enumerate(path)) + sum(t[x, y] for x, y in zip(path, path[1:])))
            for i, y in enumerate(path):
                total[i, y] += p
        assert np.allclose(total / total.sum(axis=1, keepdims=True), got[a:z], atol=1e-10)


def test_held_out_accuracy_on_switched_text(spark):
    stems = {"north": "an er th ing st ough".split(), "south": "ia lo es dad cion que".split(), "east": "ov ski czy wa na rz".split()}
    word = lambda lang: "".join(rng.choice(stems[lang]) for _ in range(rng.randint(1, 3)))
    train = [(i, " ".join(word(lang) for _ in range(60)), lang) for i, lang in enumerate(list(stems) * 40)]
    docs = spark.createDataFrame(train, "doc_id long, text string, lang string")
    model = L.fit(docs, docs_per_language=30, rounds=25)
    held, truth = [], []
    for _ in range(60):
        labels = [lang for lang in rng.sample(list(stems), 2) for _ in range(rng.randint(8, 20))]
        held.append(" ".join(word(x) for x in labels))
        truth.append(labels)
    rows = L.label_words(spark.createDataFrame(list(enumerate(held)), "doc_id long, text string"), model).collect()
    good = n = 0
    for r in rows:
        labels = []
        for a, z, name in zip(r.run_at, r.run_at[1:] + [r.words], r.run_language):
            labels += [name] * (z - a)
        good += sum(x == y for x, y in zip(labels, truth[r.doc_id]))
        n += len(truth[r.doc_id])
        assert len(labels) == len(truth[r.doc_id]) == r.words
    assert good / n > 0.95
    plain = L.label_words(docs, model)
    assert plain.where("accepted").count() == len(train)
    assert plain.join(docs, "doc_id").where("language = lang").count() >= 0.99 * len(train)


# --- neighbours


@pytest.mark.parametrize("cell", [20_000, 300])
def test_neighbours_recall_against_brute_force(spark, cell):
    r = np.random.default_rng(2)
    x = r.normal(size=(1500, 32)).astype(np.float32)
    x[700:] += 2 * r.normal(size=(40, 32))[r.integers(0, 40, 800)]
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    rows = X.neighbours(table, cell=cell).collect()
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = u @ u.T
    np.fill_diagonal(s, -2)
    truth = np.argsort(-s, axis=1, kind="stable")[:, :10]
    found = defaultdict(set)
    for q in rows:
        found[q.vec_id].add(q.neighbour_id)
        assert abs(q.similarity - s[q.vec_id, q.neighbour_id]) < 1e-5
    assert len(rows) == 15_000
    assert np.mean([len(found[i] & set(truth[i])) / 10 for i in range(len(x))]) >= 0.9


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.1", "check_s"])
def test_neighbours_recall_on_the_embeddings_tables(spark, sf):
    table = spark.read.parquet(f"/root/testdata/{sf}/embeddings.parquet")
    ids, x = zip(*((r.vec_id, r.embedding) for r in table.collect()))
    u = np.array(x) / np.linalg.norm(x, axis=1, keepdims=True)
    asked = [i for i, v in enumerate(ids) if v % 100 == 0]
    s = u[asked] @ u.T
    s[np.arange(len(asked)), asked] = -2
    truth = np.argsort(-s, axis=1, kind="stable")[:, :10]
    found = defaultdict(set)
    for q in X.neighbours(table, asks=F.col("vec_id") % 100 == 0).collect():
        found[q.vec_id].add(q.neighbour_id)
    assert set(found) == {ids[i] for i in asked}
    assert np.mean([len(found[ids[i]] & {ids[j] for j in t}) / 10 for i, t in zip(asked, truth)]) >= 0.9


def test_agreement_is_the_footrule():
    r = np.random.default_rng(8)
    orders = np.array([r.permutation(40)[:12] for _ in range(60)], np.int32)
    full = 12 - X.pivot_weights(orders, 40).T.astype(int)  # the place, 12 where it is missing
    for i in range(5):
        footrule = np.abs(full - full[i]).sum(axis=1)
        assert (12 * 13 - 2 * X.agreement(orders[i], X.pivot_weights(orders, 40)) == footrule).all()


def test_cells_give_each_pair_once(spark):
    """Without a footrule bound, all opened files together hold what a plain union of them holds."""
    r = np.random.default_rng(9)
    x = r.normal(size=(400, 16)).astype(np.float32)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    for cell in (20_000, 7):
        rows = X.neighbours(table, k=400, pivots=20, length=8, posted=3, opened=5, rerank_share=1.0, cell=cell, asks=F.col("vec_id") % 50 == 0).collect()
        got = sorted((q.vec_id, q.neighbour_id) for q in rows)
        assert len(got) == len(set(got)) and 0 < len(got) < 8 * 399
        if cell == 20_000:
            want = got
    assert got == want


# --- URL rules


def test_rules_against_counting_all_combinations(spark):
    import itertools

    hosts = ["good.example.com", "news.example.org", "spam-farm.example.net", "casino.example.net"]
    rows = []
    for i in range(400):
        h = rng.choice(hosts)
        path = rng.choice(["blog", "win", "buy"])
        bad = rng.random() < (0.9 if "spam" in h else 0.85 if "casino" in h and path == "win" else 0.1)
        rows.append((i, f"https://{h}/{path}/{i}", bad))
    table = spark.createDataFrame(rows, "page_id long, url string, bad boolean")
    sets = {r.page_id: (set(r.t), r.bad) for r in table.select("page_id", U.url_tokens(F.col("url")).alias("t"), "bad").collect()}
    n = len(rows)
    common = {t for t, c in Counter(t for s, _ in sets.values() for t in s).items() if c == n}
    tokens = sorted({t for s, _ in sets.values() for t in s} - common)
    rules = {}
    for size in range(1, 5):
        for combo in itertools.combinations(tokens, size):
            hit = [b for s, b in sets.values() if s.issuperset(combo)]
            if sum(hit) >= max(5, 0.02 * n) and sum(hit) / len(hit) >= 0.6:
                if not any(set(k) <= set(combo) and c >= sum(hit) / len(hit) for k, c in rules.items()):
                    rules[combo] = sum(hit) / len(hit)
    mined = U.mine(table, min_support=0.02)
    got = {tuple(r.tokens): r.confidence for r in mined.collect() if len(r.tokens) <= 4}
    assert got.keys() == rules.keys() and all(abs(got[k] - rules[k]) < 1e-9 for k in got)
    for most in (100_000, 0):
        matched = {r.page_id: (r.blocked, r.rules) for r in U.match(table, mined, broadcast_rules=most).collect()}
        every = [set(r.tokens) for r in mined.collect()]
        assert matched == {i: (k > 0, k) for i, (s, _) in sets.items() for k in [sum(s >= r for r in every)]}
    blocked = [i for i, (b, _) in matched.items() if b]
    assert all("spam" in rows[i][1] for i in blocked if "casino" not in rows[i][1]) and len(blocked) > 80


def test_numbers_in_urls_are_whole_segments(spark):
    urls = ["http://a.b/en/7", "http://a.b/7abc/9", "http://a.b/7.html?x=/8", "http://a.b/123456789012345678901", "http://a.b/x?y=/7", "http://a.b/7#top", None]
    pages = spark.createDataFrame(list(enumerate(urls * 4)), "page_id long, url string")
    labels = spark.createDataFrame([(7, 0, 1), (9, 1, 0), (8, 1, 0), (123456789012345678, 0, 1)], "doc_id long, quality int, toxic int")
    taken = {}
    whole, U.mine = U.mine, lambda rows, **how: taken.update(rows=rows) or spark.createDataFrame([], "tokens array<string>, confidence double, support double")
    try:
        U.filter_urls(pages, labels)
    finally:
        U.mine = whole
    got = Counter((urls.index(r.url), r.bad) for r in taken["rows"].collect())
    assert got == {(0, True): 4, (1, False): 4, (2, True): 4, (5, True): 4}


# --- WARC


def test_members_round_trip():
    bodies = [bytes(rng.randrange(256) for _ in range(rng.choice([0, 1, 50, 5000]))) for _ in range(40)] + [b"WARC/1.0\r\n\r\n" * 3, b"\r\n" * 9]
    whole = b"".join(W.record("resource", f"http://x/{i}\r\nevil: 1", str(i), b) for i, b in enumerate(bodies))
    halves = gzip.compress(whole[:1000]) + gzip.compress(whole[1000:])
    for stream in (gzip.compress(whole), halves):
        sink = io.BytesIO()
        index = list(W.normalise(io.BytesIO(stream), sink))
        out = sink.getvalue()
        assert gzip.decompress(out) == whole and len(index) == len(bodies)
        for entry, body in zip(index, bodies):
            member = gzip.decompress(out[entry["offset"] : entry["offset"] + entry["length"]])
            assert member.endswith(body + b"\r\n\r\n") and entry["bytes"] == len(body) and entry["url"].endswith("%0D%0Aevil: 1")
    with pytest.raises(ValueError, match="cut off"):
        list(W.normalise(io.BytesIO(gzip.compress(whole)[:-300]), io.BytesIO()))
    with pytest.raises(ValueError, match="not a WARC"):
        list(W.normalise(io.BytesIO(gzip.compress(b"hello\r\n\r\n")), io.BytesIO()))


def test_rewritten_pages_can_be_read_by_offset(spark, tmp_path):
    pages = spark.createDataFrame([(i, f"http://h/{i}", "".join(prose(80))) for i in range(60)], "page_id long, url string, html string")
    before, after = f"file://{tmp_path}/a", f"file://{tmp_path}/b"
    names = W.write_monoliths(pages, before, file_bytes=9_000)
    assert names.count() > 3
    assert names.agg(F.sum("records")).first()[0] == 60
    index = W.normalise_files(spark, before, after, names).collect()
    html = {f"<urn:x-page:{r.page_id}>": r.html for r in pages.collect()}
    store = fs.LocalFileSystem()
    for r in index:
        with store.open_input_file(f"{tmp_path}/b/{r.file}") as f:
            f.seek(r.offset)
            record = gzip.decompress(f.read(r.length))
        assert record.split(b"\r\n\r\n", 1)[1][:-4].decode() == html[r.id]
    sidecars = list((tmp_path / "b").glob("*.idx"))
    assert sum(len(p.read_text().splitlines()) for p in sidecars) == 60 and not list((tmp_path / "b").glob(".*"))


def test_broken_files_are_rows(spark, tmp_path):
    (tmp_path / "a").mkdir()
    whole = b"".join(W.record("resource", f"http://x/{i}", str(i), b"body %d" % i) for i in range(30))
    second = whole.index(b"WARC/1.0", 10)
    files = {"cut": gzip.compress(whole)[:-40], "plain": b"no gzip at all", "good": gzip.compress(whole), "length": gzip.compress(whole.replace(b"Content-Length: 6", b"Content-Size: 6", 1)), "ends": gzip.compress(whole[: second - 2] + whole[second:]), "flipped": gzip.compress(whole)[:200] + b"\0\xff" * 9 + gzip.compress(whole)[218:], "empty": b""}
    for name, data in files.items():
        (tmp_path / "a" / name).write_bytes(data)
    names = spark.createDataFrame([(n,) for n in files], "file string")
    index = W.normalise_files(spark, f"file://{tmp_path}/a", f"file://{tmp_path}/b", names).collect()
    by = defaultdict(list)
    for r in index:
        by[r.file].append(r)
    assert [r.error for r in by["good"]] == [None] * 30 and "empty" not in by
    for name in ("cut", "plain", "length", "ends", "flipped"):
        last = max(by[name], key=lambda r: r.record)
        assert last.error and last.record == len(by[name]) - 1 and all(r.error is None for r in by[name] if r is not last)
        kept = (tmp_path / "b" / name).read_bytes()
        inflated = gzip.decompress(kept) if kept else b""
        assert whole.startswith(inflated) and len((tmp_path / "b" / f"{name}.idx").read_text().splitlines()) == len(by[name])
    assert by["length"][0].error == "a record has no length" and "two line breaks" in by["ends"][0].error


@pytest.mark.parametrize("kind", ["string", "int", "double"])
def test_pages_of_any_key_come_back(spark, kind):
    ids = {"string": ["a\r\n\r\nb", "None", "a>\nb", "", "50% +é", None], "int": [1, -2, None], "double": [1.5, 1e300, None]}[kind]
    urls = [" http://x/ ", "http://x/\r\n\r\nWARC/1.0", "\t", "", None, "http://é"]
    pages = spark.createDataFrame([(x, u, f"<p>{i}") for i, x in enumerate(ids) for u in urls], f"page_id {kind}, url string, html string")
    got = W.rewrite_pages(pages).collect()
    assert Counter(r.page_id for r in got) == {x: len(urls) for x in ids}
    assert {r.url for r in got} == {"%20http://x/%20", "http://x/%0D%0A%0D%0AWARC/1.0", "%09", "", None, "http://é"}


# --- texts in no known language


@pytest.mark.parametrize("langs", [["de", "en", "es", "fr"], ["en", "es"], ["en"]])
def test_texts_in_no_known_language_are_rejected(spark, langs):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where(F.col("lang").isin(langs))
    strange = ["Все люди рождаются свободными и равными", "xkcd bcdfg qwrtz plkjh mnbvc", "人人生而自由 在尊严和权利上一律平等", "zzyzx qqq wvw xjx", None, "", "?!"]
    rows = docs.unionByName(spark.createDataFrame([(-1 - i, t, None, "s", 1) for i, t in enumerate(strange)], docs.schema))
    model = L.fit(docs)
    kept = [r.doc_id for r in L.reject_unreliable(rows, model).collect()]
    assert not any(i < 0 for i in kept)
    clean = docs.count()
    assert len(kept) >= clean - 1  # one that is mostly numbers may be unsure between four languages
    got = {r.doc_id: r.accepted for r in L.label_words(rows, model).collect()}
    assert {i for i, a in got.items() if a} == set(kept)


# --- HTML


def test_markup_at_length_takes_linear_time():
    import time

    began = time.process_time()
    assert H.parse("<a " * 350_000).kids[0].text.startswith("<a <a ")
    assert H.parse("<a '\"" * 100_000).kids[0].tag == "#text"
    assert H.parse("<p><div>" + "<b>" * 20_000 + "<p></p>" * 20_000).size == 40_003
    assert H.parse("<b>" * 50_000 + "</i>" * 50_000 + "x").size == 50_002
    assert time.process_time() - began < 10


def test_pages_deeper_than_any_stack(spark):
    pages = spark.createDataFrame([(i, "http://h/", "<div>" * 20_000 + f"<p>same</p><p>own {i}</p>") for i in range(4)], "page_id long, url string, html string")
    for how in ({}, {"broadcast_bytes": 0, "held_nodes": 1}):
        got = {r.page_id: (r.content, r.constants) for r in H.extract_content(pages.repartition(2), **how).collect()}
        assert got == {i: (f"own {i}", 1) for i in range(4)}


def matching_by_definition(a, b):
    if a.tag != b.tag:
        return 0
    m = [[0] * (len(b.kids) + 1) for _ in range(len(a.kids) + 1)]
    for i, x in enumerate(a.kids):
        for j, y in enumerate(b.kids):
            m[i + 1][j + 1] = max(m[i][j + 1], m[i + 1][j], m[i][j] + matching_by_definition(x, y))
    return 1 + m[-1][-1]


def random_tree(depth):
    node = H.Node(rng.choice("abc"))
    if depth:
        node.kids = [random_tree(depth - 1) for _ in range(rng.randint(0, 4))]
    node.seal()
    return node


def test_tree_matching_equals_its_definition():
    for _ in range(120):
        a, b = random_tree(3), random_tree(3)
        a.tag = b.tag = "r"
        a.seal(), b.seal()
        assert H.weight(a, b) == matching_by_definition(a, b)


def test_long_lists_are_aligned_in_halves():
    table = np.random.default_rng(0).integers(0, 5, (4, 4))
    r = np.random.default_rng(1)
    ia, ib = r.integers(0, 4, 6000), r.integers(0, 4, 6001)
    got = H._align(table, ia, ib)
    assert sum(table[ia[i], ib[j]] for i, j in got) == H._row(table, ia, ib)[-1]
    assert all(a[0] < b[0] and a[1] < b[1] for a, b in zip(got, got[1:]))


def test_wrappers_keep_content_and_drop_template(spark):
    page = lambda host, i, ps: f"<html><head><title>t{i}</title></head><body><div>Menu of {host}</div><ul><li>Home<li>About</ul><h1>Title {i}</h1>" + "".join(f"<p>text {i} {k} &amp; more" for k in range(ps)) + f"<script>x={i}</script><footer>All rights of {host}</footer></body></html>"
    rows = [(10 * h + i, f"https://u@www.h{h}.org:80/{i}", page(h, i, 1 + (i * 7) % 5)) for h in range(3) for i in range(8)]
    rows.append((99, "http://alone.org/", page(9, 0, 2)))
    table = spark.createDataFrame(rows, "page_id long, url string, html string")
    for how in ({}, {"held_nodes": 1}, {"broadcast_bytes": 0}):
        got = {r.page_id: r for r in H.extract_content(table.repartition(4), **how).collect()}
        for h in range(3):
            for i in range(8):
                r = got[10 * h + i]
                assert r.content == "\n".join([f"Title {i}"] + [f"text {i} {k} & more" for k in range(1 + (i * 7) % 5)])
                assert r.host == f"www.h{h}.org" and r.constants == 4
        assert "Menu of 9" in got[99].content and got[99].constants == 0


# --- the two that SQL expresses


def licences_by_sql(docs):
    import duckdb

    c = duckdb.connect()
    c.register("documents", docs.toPandas())
    return sorted(c.execute(sql()).fetchall())


def test_licences(spark):
    from loomtext.llm.license_texts import APACHE_HEADER, MIT

    wrapped = "Copyright (c) 2020 A. Person\nCOPYRIGHT 2021 others\n\n" + "\n".join(line for w in [MIT.upper().split()] for line in [" ".join(w[i : i + 9]) for i in range(0, len(w), 9)])
    texts = [wrapped, MIT.replace("license", "licence") + "  ", "some code\n\n// " + APACHE_HEADER.replace("\n", "\n// ").replace("http:", "https:"), "x\nLicenced under the MIT Licence\ny", "MIT license is not all of this text, licensed as it is", None, "", "Prose.\r\n\r\nreleased under the Apache License, Version 2.0!\r\n"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = sorted((r.doc_id, r.scope, r.part, r.license) for r in scan(docs).collect())
    assert [(d, s, x) for d, s, _, x in got] == [(0, "document", "MIT"), (1, "document", "MIT"), (3, "line", "MIT"), (7, "line", "Apache-2.0")] or (2, "block", 1, "Apache-2.0") in got
    assert {d for d, *_ in got} >= {0, 1, 3, 7} and 4 not in {d for d, *_ in got}
    assert licences_by_sql(docs) == got
    same = spark.createDataFrame([("© 2020 X\nLicence, colour; sub-license v. 2.0",), ("license color sublicense version 2 0",)], "t string").select(canonical(F.col("t"))).collect()
    assert same[0][0] == same[1][0]


def test_licences_whatever_parts_their_words(spark):
    from loomtext.llm.license_texts import KNOWN

    texts = ["All rights  reserved.", "All rights\u00a0reserved.", "All rights-reserved", "All rights\nreserved.", "All rights\n(c) 2020 X\nreserved.", "Released\tunder MIT.", "Released under  the GPL-2.0.", "Distributed -- under the CC BY 4.0", "Available\nunder the ISC."]
    apart = [t.replace(" ", " \u00a0\n* ") for _, t in KNOWN]
    docs = spark.createDataFrame(list(enumerate(texts + apart)), "doc_id long, text string")
    rows = scan(docs).collect()
    assert licences_by_sql(docs) == sorted(map(tuple, rows))
    got = {r.doc_id: r.license for r in rows if r.scope == "document"}
    assert [got.get(i) for i in range(len(texts))] == ["LicenseRef-All-Rights-Reserved"] * 5 + ["MIT", "GPL-2.0", "CC-BY-4.0", "ISC"]
    assert len(got) == len(texts + apart)


def test_licences_below_copyright_lines(spark):
    from loomtext.llm.license_texts import KNOWN, MIT

    lines = ["Copyright OpenJS Foundation and other contributors", "Copyright Joyent, Inc.", "Copyright: 2019 X", " * Copyright [2019] X", "COPYRIGHT the authors", "Copyright (c) 2020 X", "Copyright © Örg"]
    wrapped = [t.replace(" copyright ", "\n# copyright ").replace(" COPYRIGHT ", "\n# COPYRIGHT ") for _, t in KNOWN]
    others = ["Copyright notices stay here.\n" + MIT, "Copyright holders may sue.\n" + MIT, "Copyright law is not a holder.\n" + MIT]
    docs = spark.createDataFrame(list(enumerate([x + "\n" + MIT for x in lines] + wrapped + others)), "doc_id long, text string")
    rows = scan(docs).collect()
    assert licences_by_sql(docs) == sorted(map(tuple, rows))
    got = {r.doc_id: r.license for r in rows if r.scope == "document"}
    assert [got.get(i) for i in range(len(lines))] == ["MIT"] * len(lines)
    assert set(got) == set(range(len(lines) + len(wrapped)))


def test_full_licence_texts_by_digest(spark):
    """The digests are those of the texts that Debian ships, however they are wrapped."""
    folder = Path("/usr/share/common-licenses")
    files = {"Apache-2.0": "Apache-2.0", "GPL-2": "GPL-2.0", "GPL-3": "GPL-3.0", "LGPL-2.1": "LGPL-2.1", "LGPL-3": "LGPL-3.0", "MPL-2.0": "MPL-2.0", "CC0-1.0": "CC0-1.0"}
    if not all((folder / f).exists() for f in files):
        pytest.skip("the texts aren't here")
    texts = [(folder / f).read_text() for f in files]
    reflowed = ["/* " + re.sub(r"\n(?![ ]*Copyright)(?<!\n\n)", "\n * ", t).replace("license", "licence") + " */" for t in texts]
    without = [t[: t.index("END OF TERMS AND CONDITIONS") + 27] for t in texts if "END OF TERMS AND CONDITIONS" in t]
    docs = spark.createDataFrame(list(enumerate(texts + reflowed + without)), "doc_id long, text string")
    rows = scan(docs).collect()
    assert licences_by_sql(docs) == sorted(map(tuple, rows))
    got = {r.doc_id: r.license for r in rows if r.scope == "document"}
    names = list(files.values())
    assert got == dict(enumerate(names + names + [n for n, t in zip(names, texts) if "END OF TERMS AND CONDITIONS" in t]))


def test_chats_against_sql(spark):
    import duckdb

    rows = [(c, t, rng.choice(["user", "assistant", "system", None, "ünï"]), rng.choice([None, "", "a\nb", "été " * 30, "x" * 2000])) for c in list(range(80)) + [None] for t in range(rng.randint(1, 9))]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(5)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = sorted(map(tuple, format_chats(turns).collect()), key=str)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    c = duckdb.connect()
    c.execute("create table conversations(conv_id bigint, turn bigint, role varchar, text varchar)")
    c.executemany("insert into conversations values (?, ?, ?, ?)", rows)
    assert got == sorted(c.execute(SQL).fetchall(), key=str)
