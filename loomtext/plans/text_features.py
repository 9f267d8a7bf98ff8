"""Queries over texts: normalisation, dictionaries, spelling, extractors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomtext.functions import text as T
from loomtext.functions.hashing import murmur3_sql
from loomtext.operators.compose import TextPipeline, hstack_vectors
from loomtext.operators.dictionary import Dictionary, doc_frequencies
from loomtext.operators.features import WordBag, WordSeq, WordVec, encode_categories, hash_columns, word_hash
from loomtext.operators.inrow import Blocks
from loomtext.operators.spelling import Tokenizer, corrections, deletion_index, porter, stemmed
from loomtext.plans.registry import query, read, spread
from loomtext.session import written

NORM_SQL = "array_to_string(list_filter(string_split(trim(lower(regexp_replace(coalesce(text, ''), '[^A-Za-z0-9]+', ' ', 'g'))), ' '), lambda x: length(x) > 1), ' ')"
TOK_SQL = f"tok as (select doc_id, string_split({NORM_SQL}, ' ') as tokens from documents)"
DFS_SQL = "dfs as (select word, count(*) as df from (select unnest(list_distinct(tokens)) as word from tok) group by word)"
DICT_SQL = f"{TOK_SQL}, {DFS_SQL}, n as (select count(*) as n from tok), dict as (select word, df, row_number() over (order by df desc, word desc) as id from dfs)"
EACH_SQL = "each as (select doc_id, tokens, generate_subscripts(tokens, 1) - 1 as x, unnest(tokens) as word from tok)"
_MARKED = "regexp_replace(coalesce(text, ''), '[^A-Za-z0-9_]*[0-9]+[^A-Za-z0-9_]*', ' NUM ', 'g')"
_DELETE_1 = "list_distinct(list_filter(list_transform(range(1, length({w}) + 1), lambda i: substr({w}, 1, i - 1) || substr({w}, i + 1)), lambda q: q <> {w}))"


def doc_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, tokens) of the normalised documents."""
    return spread(read(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", T.tokens(T.normalize_default(F.col("text"))).alias("tokens"))


def turn_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, tokens) of the turns of all conversations."""
    rows = read(spark, sf_dir, "conversations")
    return rows.select((F.col("conv_id") * 100_000 + F.col("turn")).alias("doc_id"), T.tokens(T.normalize_default(F.col("text"))).alias("tokens"))


TURN_SQL = f"tok as (select conv_id * 100000 + turn as doc_id, string_split({NORM_SQL}, ' ') as tokens from conversations)"


@query(f"select doc_id, {NORM_SQL} as norm from documents")
def normalize_default(spark, sf_dir):
    return spread(read(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", T.normalize_default(F.col("text")).alias("norm"))


@query(f"select doc_id, lower(trim(regexp_replace({_MARKED}, '[^A-Za-z0-9_]+', ' ', 'g'))) as norm from documents")
def normalize_num(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", T.words_only(F.col("text")).alias("norm"))


@query("select doc_id, trim(lower(regexp_replace(coalesce(text, ''), '[^A-Za-z]+', ' ', 'g'))) as norm from documents")
def normalize_letters(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", T.letters_only(F.col("text")).alias("norm"))


@query(r"select doc_id, regexp_replace(regexp_replace(coalesce(text, ''), ' @[^ ]* ', ' ', 'g'), '[A-Za-z0-9_]+\]', '', 'g') as norm from documents")
def strip_tags(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", T.strip_tags(F.col("text")).alias("norm"))


_PAIRS = [("[!$%&*#]+", " "), ("  +", " "), (" ([.,])", "$1")]
_squeezed = "coalesce(text, '')"
for _ in range(5):
    for _p, _t in _PAIRS:
        _squeezed = f"regexp_replace({_squeezed}, '{_p}', '{_t.replace('$', chr(92))}', 'g')"


@query(f"select doc_id, {_squeezed} as norm from documents")
def squeeze_patterns(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", T.squeeze(F.col("text"), _PAIRS).alias("norm"))


@query(r"select doc_id, length(text) as chars, ln(1 + length(text))::decimal(18, 6)::double as log_chars, len(list_filter(string_split(regexp_replace(text, '[ \t\r\n]+', ' ', 'g'), ' '), lambda x: x <> '')) as words, string_split(text, ' ')[1] as first from documents")
def text_lengths(spark, sf_dir):
    t = F.col("text")
    log = F.log(1 + F.length(t)).cast("decimal(18,6)").cast("double")
    return read(spark, sf_dir, "documents").select("doc_id", F.length(t).alias("chars"), log.alias("log_chars"), T.word_count(t).alias("words"), T.first_word(t).alias("first"))


@query(f"with {TOK_SQL}, {DFS_SQL} select word, df from dfs")
def doc_freq(spark, sf_dir):
    return doc_frequencies(doc_tokens(spark, sf_dir))


@query(f"with {DICT_SQL} select word, df, id from dict")
def dictionary_fit(spark, sf_dir):
    return Dictionary().fit(doc_tokens(spark, sf_dir)).encoded()


@query(f"with {DICT_SQL} select word, df, row_number() over (order by df desc, word desc) as id from dict, n where df >= 5 and df <= 0.2 * n.n")
def dictionary_minmax_df(spark, sf_dir):
    return Dictionary(min_df=5, max_df=0.2).fit(doc_tokens(spark, sf_dir)).encoded()


@query(f"with {DICT_SQL} select word, df, id from dict where id <= 1000")
def dictionary_max_words(spark, sf_dir):
    return Dictionary(max_words=1000).fit(doc_tokens(spark, sf_dir)).encoded()


@query(f"with {DICT_SQL} select word, df, id from dict, n where id <= 5000 and df >= 3 and df <= 0.3 * n.n")
def dictionary_prune_reencode(spark, sf_dir):
    return Dictionary().fit(doc_tokens(spark, sf_dir)).prune(max_words=5000, min_df=3, max_df=0.3, re_encode=True).encoded()


@query(
    f"""with {TOK_SQL}, a as (select word, count(*) as df from (select unnest(list_distinct(tokens)) as word from tok where doc_id % 2 = 0) group by word),
b as (select word, count(*) as df from (select unnest(list_distinct(tokens)) as word from tok where doc_id % 2 = 1) group by word),
one as (select word, row_number() over (order by df desc, word desc) as id from a),
both_ as (select word, coalesce(a.df, 0) + coalesce(b.df, 0) as df from a full join b using (word)),
new as (select word, row_number() over (order by df desc, word desc) + (select max(id) from one) as id from both_ where word not in (select word from one))
select word, df, id from both_ join (select * from one union all select * from new) using (word)"""
)
def dictionary_partial_fit(spark, sf_dir):
    rows = doc_tokens(spark, sf_dir)
    return Dictionary().fit(rows.where("doc_id % 2 = 0")).partial_fit(rows.where("doc_id % 2 = 1")).encoded()


@query(f"with {TOK_SQL}, {DFS_SQL} select word, unnest({_DELETE_1.format(w='word')}) as deletion from dfs")
def deletions_1(spark, sf_dir):
    return doc_freq(spark, sf_dir).select("word", F.explode(T.deletions(F.col("word"), 1)).alias("deletion"))


_RARE = f"""with {TOK_SQL}, {DFS_SQL},
d1 as (select word, df, unnest({_DELETE_1.format(w='word')}) as d from dfs),
dels as (select distinct word, df, d from (select * from d1 union all select word, df, unnest({_DELETE_1.format(w='d')}) from d1) where d <> word),
common as (select d, word as c, df as cdf from dels where df > 8 and length(word) <= 15)"""


@query(f"{_RARE} select d as deletion, c as candidate, cdf from common")
def deletions_index(spark, sf_dir):
    return deletion_index(doc_freq(spark, sf_dir), 8, 2)


_FIXED = f"""{_RARE}, near as (select distinct r.word, c, cdf from dels r join common using (d) where r.df <= 8 and length(r.word) >= 3 and levenshtein(r.word, c) <= 2),
fixed as (select word, c as corrected from near qualify row_number() over (partition by word order by cdf desc, c) = 1)"""


@query(f"{_FIXED.replace(' and length(word) <= 15', '')} select word, corrected from fixed")
def spell_correct(spark, sf_dir):
    """Candidates of any length."""
    return corrections(written(doc_freq(spark, sf_dir), "counts"), 8, 2, longest=None)


@query(
    f"""{_FIXED}, {EACH_SQL}
select doc_id, string_agg(coalesce(corrected, word), ' ' order by x) as text from each left join fixed using (word) group by doc_id"""
)
def tokenizer_transform(spark, sf_dir):
    rows = doc_tokens(spark, sf_dir)
    return Tokenizer(8, 2).fit(rows).transform(rows).select("doc_id", F.array_join("tokens", " ").alias("text"))


@query()
def stem_vocabulary(spark, sf_dir):
    return doc_freq(spark, sf_dir).select("word", stemmed(F.col("word")).alias("stem"))


def _bag_sql(tf: str, norm: str, idf: str = "1.0", entries: str | None = None, more: str = "") -> str:
    entries = entries or f"select doc_id, id as idx, 1.0 as sg, {idf} as wt, x as ord from each join dict using (word), n where {idf} <> 0"
    total = {"l0": "count(*) over w", "l1": "sum(abs(val)) over w", "l2": "sqrt(sum(val * val) over w)", "none": "1"}[norm]
    return f"""with {DICT_SQL}, {EACH_SQL}{more}, entries as ({entries}),
summed as (select doc_id, idx, sum(sg) as v, arg_max(wt, ord) as wt from entries group by doc_id, idx),
valued as (select doc_id, idx, {tf} * wt as val from summed)
select doc_id, idx, round(case when {total} = 0 then val else val / {total} end, 6) as val from valued window w as (partition by doc_id)"""


_LOG = "ln(1 + abs(v)) * sign(v)"
_IDF50 = "ln(greatest(1, 50 + n.n / df)) / ln(greatest(1, 50 + n.n::double))"
_IDF0 = "ln(greatest(1, n.n / df)) / ln(greatest(1, n.n::double))"


def _bag(spark: SparkSession, sf_dir: str, **how) -> DataFrame:
    rows = Blocks.of(doc_tokens(spark, sf_dir))
    d = Dictionary().fit(rows)
    return WordBag(**how).transform(rows, d).select("doc_id", "idx", F.round("val", 6).alias("val"))


@query(_bag_sql("v", "none"))
def wordbag_raw(spark, sf_dir):
    return _bag(spark, sf_dir, norm=None, tf=None, idf=None)


@query(_bag_sql(_LOG, "l1"))
def wordbag_log_l1(spark, sf_dir):
    return _bag(spark, sf_dir, norm="l1", tf="log", idf=None)


@query(_bag_sql("sign(v)", "l0"))
def wordbag_binary_l0(spark, sf_dir):
    return _bag(spark, sf_dir, norm="l0", tf="binary", idf=None)


@query(_bag_sql("sign(v) * (2.2) * abs(v) / (1.2 + abs(v))", "l2"))
def wordbag_bm25(spark, sf_dir):
    return _bag(spark, sf_dir, norm="l2", tf=1.2, idf=None)


@query(_bag_sql(_LOG, "l2", _IDF50))
def wordbag_l2(spark, sf_dir):
    return _bag(spark, sf_dir, norm="l2", tf="log", idf=50.0)


@query(_bag_sql("sign(v)", "l2", _IDF0))
def wordbag_idf(spark, sf_dir):
    return _bag(spark, sf_dir, norm="l2", tf="binary", idf=0.0)


_HASH_OF = "abs(h) % 1000003 as idx, case when h >= 0 then 1.0 else -1.0 end as sg"
_GRAMS = f""", grams as (select doc_id, x, y, list_reduce(tokens[x - y + 1 : x + 1], lambda a, b: a || ' ' || b) as g, case y when 0 then {_IDF50} else 1.0 end as wt
  from (select *, unnest(range(0, least(1, x) + 1)) as y from each) join dict using (word), n where id < 1000003), {murmur3_sql("grams", "g")}"""


@query(_bag_sql(_LOG, "l2", entries=f"select doc_id, {_HASH_OF}, wt, x * 100 + y as ord from grams join mm on g = mm.w", more=_GRAMS))
def wordbag_ngram_hash(spark, sf_dir):
    return _bag(spark, sf_dir, idf=50.0, hash_ngrams=2, ngram_weights=(-1.0, 1.0), hash_size=1_000_003)


_PAIRS_SQL = f""", known as (select doc_id, tokens, x, word, df, id from each join dict using (word)),
pairs as (select doc_id, x, y, least(p.word, v) || '#' || greatest(p.word, v) as g, 0.1 / ln(1 + y) as wt, 1 as kind
  from (select doc_id, x, word, y, tokens[x - y + 1] as v from (select *, unnest(range(1, least(2, x) + 1)) as y from known, n where df >= 5 and df <= 0.5 * n.n)) p join dict d on d.word = v, n where d.df >= 5 and d.df <= 0.5 * n.n),
grams as (select doc_id, x, 0 as y, word as g, {_IDF50} as wt, 0 as kind from known, n union all select doc_id, x, y, g, wt, kind from pairs), {murmur3_sql("grams", "g")}"""


@query(_bag_sql(_LOG, "l2", entries=f"select doc_id, {_HASH_OF}, wt, x * 100 + kind * 10 + y as ord from grams join mm on g = mm.w", more=_PAIRS_SQL))
def wordbag_polys(spark, sf_dir):
    return _bag(spark, sf_dir, idf=50.0, hash_ngrams=1, ngram_weights=(-1.0,), hash_size=1_000_003, polys_window=3, polys_weight=-0.1)


@query(
    f"""with each as (select doc_id, g, count(*) as c from (select doc_id, unnest(regexp_extract_all(lower(coalesce(text, '')), '[A-Za-z0-9_]{{2,}}')) as g from documents) group by doc_id, g),
{murmur3_sql("each", "g")},
summed as (select doc_id, abs(h) % 1048576 as idx, sum(c * case when h >= 0 then 1.0 else -1.0 end) as val from each join mm on g = mm.w group by 1, 2)
select doc_id, idx, round(case when sum(val * val) over (partition by doc_id) = 0 then val else val / sqrt(sum(val * val) over (partition by doc_id)) end, 6) as val from summed"""
)
def wordhash(spark, sf_dir):
    return word_hash(spread(read(spark, sf_dir, "documents").select("doc_id", "text")), 1 << 20).select("doc_id", "idx", F.round("val", 6).alias("val"))


_WORDS2 = "regexp_extract_all(lower(coalesce(text, '')), '[A-Za-z0-9_]{2,}')"


@query(
    f"""with t as (select doc_id, {_WORDS2} as w from documents),
grams as (select doc_id, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) as g from t),
each as (select doc_id, g, count(*) as c from grams group by doc_id, g), {murmur3_sql("each", "g")},
summed as (select doc_id, abs(h) % 33554432 as idx, sum(c * case when h >= 0 then 1.0 else -1.0 end) as val from each join mm on g = mm.w group by 1, 2)
select doc_id, idx, round(case when sum(val * val) over (partition by doc_id) = 0 then val else val / sqrt(sum(val * val) over (partition by doc_id)) end, 6) as val from summed"""
)
def wordhash_bigrams(spark, sf_dir):
    return word_hash(spread(read(spark, sf_dir, "documents").select("doc_id", "text")), 1 << 25, (1, 2)).select("doc_id", "idx", F.round("val", 6).alias("val"))


@query()
def wordbag_stemmed(spark, sf_dir):
    """Corrected, stemmed, pruned and weighted: the longest chain of steps."""
    p = TextPipeline(tokenizer=Tokenizer(2, 2, stem=porter), dictionary=Dictionary(min_df=10, max_words=1_000_000), extractor=WordBag(tf="binary", idf=50.0))
    return p.fit_transform(spread(read(spark, sf_dir, "documents").select("doc_id", "text"))).select("doc_id", "idx", F.round("val", 6).alias("val"))


@query()
def stemmed_first_word_mean(spark, sf_dir):
    """Mean text length by the stem of the first word; stems are computed once for each distinct word."""
    rows = read(spark, sf_dir, "documents").select(T.first_normal_word(F.col("text")).alias("word"), F.length("text").alias("n"))
    stems = rows.select("word").distinct().withColumn("stem", stemmed(F.col("word")))
    return rows.groupBy("word").agg(F.sum("n").alias("s"), F.count("n").alias("c")).join(stems, "word").groupBy("stem").agg((F.sum("s") / F.sum("c")).alias("mean"))


_SEQ_DICT = f"with {TURN_SQL}, {DFS_SQL}, dict as (select word, id from (select word, row_number() over (order by df desc, word desc) as id from dfs) where id <= 500), {EACH_SQL}"
_SEQ = f"{_SEQ_DICT}, seq as (select doc_id, list(coalesce(id, 501) order by x) as ids from each left join dict using (word) group by doc_id)"


def _seq(spark: SparkSession, sf_dir: str, **how) -> DataFrame:
    rows = turn_tokens(spark, sf_dir)
    return WordSeq(**how).transform(rows, Dictionary(max_words=500).fit(rows)).select("doc_id", F.array_join(F.col("ids").cast("array<string>"), " ").alias("ids"))


@query(f"{_SEQ} select doc_id, array_to_string(list_concat(list_transform(range(0, greatest(40 - len(ids), 0)), lambda i: 0), case when len(ids) > 40 then ids[len(ids) - 39 :] else ids end), ' ') as ids from seq")
def wordseq_pad(spark, sf_dir):
    return _seq(spark, sf_dir, maxlen=40)


@query(f"{_SEQ} select doc_id, array_to_string(list_concat(ids[1 : 40], list_transform(range(0, greatest(40 - len(ids), 0)), lambda i: 0)), ' ') as ids from seq")
def wordseq_trunc_end(spark, sf_dir):
    return _seq(spark, sf_dir, maxlen=40, pad_start=False, trunc_start=False)


@query(f"{_SEQ_DICT}, seq as (select doc_id, list(id order by x) as ids from each join dict using (word) group by doc_id) select tok.doc_id, coalesce(array_to_string(ids, ' '), '') as ids from tok left join seq using (doc_id)")
def wordseq_remove_oov(spark, sf_dir):
    return _seq(spark, sf_dir, remove_oov=True)


def _word_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The k-th word of the dictionary has the k-th embedding."""
    words = Dictionary().fit(doc_tokens(spark, sf_dir)).encoded()
    vectors = read(spark, sf_dir, "embeddings").select((F.col("vec_id") + 1).alias("id"), F.col("embedding").cast("array<double>").alias("vec"))
    return words.join(vectors, "id").select("word", "vec")


_VEC = f"""with {DICT_SQL}, {EACH_SQL}, wv as (select word, embedding as vec from dict join embeddings on vec_id + 1 = id),
lens as (select doc_id, count(*) as n from each group by doc_id),
dims as (select doc_id, i, sum(v) as s from (select doc_id, generate_subscripts(vec, 1) as i, unnest(vec)::double as v from each join wv using (word)) group by doc_id, i),
means as (select lens.doc_id, i, coalesce(s, 0) / lens.n as m from lens cross join (select unnest(range(1, 65)) as i) left join dims using (doc_id, i)),
totals as (select doc_id, sqrt(sum(m * m)) as t from means group by doc_id),
normed as (select doc_id, i, case when t = 0 then m else m / t end as m from means join totals using (doc_id))"""


@query(f"{_VEC} select doc_id, i - 1 as dim, round(m, 6) + 0.0 as x from normed")
def wordvec_mean_l2(spark, sf_dir):
    got = WordVec().transform(doc_tokens(spark, sf_dir), _word_vectors(spark, sf_dir), 64)
    return got.select("doc_id", F.posexplode("vec").alias("dim", "x")).select("doc_id", F.col("dim").cast("long").alias("dim"), (F.round("x", 6) + 0.0).alias("x"))


@query(f"{_VEC} select doc_id, i - 1 as dim, round(m, 6) + 0.0 as x from normed union all select doc_id, i + 63, round(m, 6) + 0.0 from means")
def wordvec_hstack(spark, sf_dir):
    rows, vectors = doc_tokens(spark, sf_dir), _word_vectors(spark, sf_dir)
    both = hstack_vectors(WordVec().transform(rows, vectors, 64), WordVec(norm=None).transform(rows, vectors, 64))
    return both.select("doc_id", F.posexplode("vec").alias("dim", "x")).select("doc_id", F.col("dim").cast("long").alias("dim"), (F.round("x", 6) + 0.0).alias("x"))


@query("with v as (select o_orderpriority as v, count(*) as c from orders group by 1), r as (select v, row_number() over (order by c desc, v desc) as code from v) select o_orderkey, code from orders join r on v = o_orderpriority")
def categorical_encode(spark, sf_dir):
    return encode_categories(read(spark, sf_dir, "orders"), "o_orderkey", "o_orderpriority")


@query(
    f"""with each as (select o_orderkey, unnest([o_orderstatus || 'oo', o_orderpriority || 'oo', o_custkey::varchar || 'oc']) as g from orders), {murmur3_sql("each", "g")}
select o_orderkey, ((h % 1024) + 1024) % 1024 as idx, count(*)::double as val from each join mm on g = mm.w group by 1, 2"""
)
def pandas_hash(spark, sf_dir):
    return hash_columns(read(spark, sf_dir, "orders"), "o_orderkey", ["o_orderstatus", "o_orderpriority", "o_custkey"], 1024, unique=True)


@query(
    f"""with rows_ as (select l_orderkey * 10 + l_linenumber as line, l_returnflag, l_quantity, l_discount from lineitem),
each as (select line, unnest([struct_pack(g := l_returnflag || 'lr', val := 1.0::double), struct_pack(g := 'lq', val := l_quantity * 0.5), struct_pack(g := 'ld', val := l_discount)]) as e from rows_),
flat as (select line, e.g as g, e.val as val from each), {murmur3_sql("flat", "g")}
select line, ((h % 512) + 512) % 512 as idx, round(sum(val), 6) as val from flat join mm on g = mm.w group by 1, 2"""
)
def pandas_hash_dtype(spark, sf_dir):
    rows = read(spark, sf_dir, "lineitem").withColumn("line", F.col("l_orderkey") * 10 + F.col("l_linenumber"))
    got = hash_columns(rows, "line", ["l_returnflag", "l_quantity", "l_discount"], 512, weights={"l_quantity": 0.5}, dtype_specific=True)
    return got.select("line", "idx", F.round("val", 6).alias("val"))


@query(
    f"""with {DICT_SQL}, {EACH_SQL}, c as (select doc_id, id, count(*) as v from each join dict using (word) group by 1, 2),
f as (select doc_id, string_agg(id || ':' || v, ' ' order by id) as f from c group by doc_id) select tok.doc_id, coalesce(f, '') as features from tok left join f using (doc_id)"""
)
def feature_vectors(spark, sf_dir):
    rows = doc_tokens(spark, sf_dir)
    d = Dictionary().fit(rows)
    got = WordBag(norm=None, tf=None, idf=None).packed(rows, d)
    pair = F.zip_with("idx", "val", lambda i, v: F.concat(i.cast("string"), F.lit(":"), v.cast("long").cast("string")))
    return got.select("doc_id", F.array_join(pair, " ").alias("features"))
