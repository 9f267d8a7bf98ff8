"""Queries over rows, batches and groups: functions, splits, samples, unions, sources and sinks."""

from __future__ import annotations

from dataclasses import dataclass, replace

import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F

from loomtext.functions import text as T
from loomtext.operators import compose as C
from loomtext.operators.dictionary import Dictionary
from loomtext.operators.features import WordBag, WordSeq
from loomtext.operators.spelling import Tokenizer
from loomtext.plans.registry import query, read, spread
from loomtext.plans.text_features import _FIXED, _SEQ, DICT_SQL, EACH_SQL, TOK_SQL, doc_tokens, turn_tokens
from loomtext.session import fresh_path
from loomtext.sources import io
from loomtext.streaming.incremental import StreamingDictionary


@query("select doc_id, (row_number() over (order by doc_id) - 1) // 300 as batch from documents")
def split_batches(spark, sf_dir):
    return C.split_batches(read(spark, sf_dir, "documents").select("doc_id"), "doc_id", 300).select("doc_id", "batch")


@query("select source, doc_id from documents qualify row_number() over (partition by source order by doc_id) % 7 = 1")
def every_kth(spark, sf_dir):
    own = Window.partitionBy("source").orderBy("doc_id")
    rows = read(spark, sf_dir, "documents").select("source", "doc_id").withColumn("r", F.row_number().over(own))
    return rows.where("r % 7 = 1").select("source", "doc_id")


@query("select min(doc_id) as doc_id, text from documents group by text")
def dedupe_first(spark, sf_dir):
    return io.first_of_each(read(spark, sf_dir, "documents").select("doc_id", "text"), "text", "doc_id")


@query("select doc_id, ('0x' || substr(md5(doc_id::varchar), 1, 8))::ubigint::bigint % 10 as fold from documents")
def kfold(spark, sf_dir):
    h = F.conv(F.substring(F.md5(F.col("doc_id").cast("string")), 1, 8), 16, 10).cast("long")
    return read(spark, sf_dir, "documents").select("doc_id", F.pmod(h, F.lit(10)).alias("fold"))


@query("select doc_id, md5('7:' || doc_id) as order_key from documents")
def shuffle_batch(spark, sf_dir):
    return C.shuffled(read(spark, sf_dir, "documents").select("doc_id"), "doc_id", 7)


@query("select l_orderkey, l_linenumber, case when l_tax = 0 then 0 else l_discount / l_tax end as ratio from lineitem")
def apply_scalar(spark, sf_dir):
    rows = read(spark, sf_dir, "lineitem")
    return C.apply_rows(rows, T.safe_ratio, ["l_discount", "l_tax"], "ratio", "double", native=True).select("l_orderkey", "l_linenumber", "ratio")


@query("select p_partkey, upper(string_split(p_type, ' ')[1]) as kind from part")
def apply_cached(spark, sf_dir):
    return C.apply_rows(read(spark, sf_dir, "part"), lambda x: x.split(" ")[0].upper(), ["p_type"], "kind", "string", cache=1000).select("p_partkey", "kind")


@query("select doc_id, n_chars / (1 + length(text)) as ratio from documents")
def apply_vectorized(spark, sf_dir):
    rows = read(spark, sf_dir, "documents").select("doc_id", "n_chars", F.length("text").alias("n"))
    return C.apply_rows(rows, lambda a, b: a / (1 + b), ["n_chars", "n"], "ratio", "double", native=True).select("doc_id", "ratio")


def _long_only(t: pd.DataFrame, least: int) -> pd.DataFrame:
    t = t[t.text.str.len() >= least]
    return pd.DataFrame({"doc_id": t.doc_id, "first": t.text.str.slice(0, 3)})


@query("select doc_id, substr(text, 1, 3) as first from documents where length(text) >= 500")
def apply_batch(spark, sf_dir):
    return C.apply_batches(read(spark, sf_dir, "documents").select("doc_id", "text"), _long_only, "doc_id long, first string", args=(500,))


@query("select string_split(text, ' ')[1] as first, round(avg(length(text)), 6) as mean from documents group by 1")
def apply_groupby_mean(spark, sf_dir):
    rows = read(spark, sf_dir, "documents").select(T.first_word(F.col("text")).alias("first"), F.length("text").alias("n"))
    return rows.groupBy("first").agg(F.round(F.avg("n"), 6).alias("mean"))


def _supplier_spread(t: pd.DataFrame) -> pd.DataFrame:
    return t.groupby("l_suppkey").l_quantity.agg(low="min", high="max").reset_index()


@query("select l_suppkey, min(l_quantity) as low, max(l_quantity) as high from lineitem group by 1")
def apply_groupby_bins(spark, sf_dir):
    rows = read(spark, sf_dir, "lineitem").select("l_suppkey", "l_quantity")
    return C.apply_groups(rows, _supplier_spread, "l_suppkey", "l_suppkey long, low double, high double", groups_per_bin=20)


_UNION = f"""with {DICT_SQL}, {EACH_SQL}, c as (select doc_id, id, count(*) as v from each join dict using (word) group by 1, 2)
select doc_id, id as idx, v::double as val from c union all select doc_id, (select count(*) + 1 from dict), 0.5 * length(text) from documents"""


@dataclass(frozen=True)
class _Counts:
    """Raw counts of all words."""

    dictionary: Dictionary = Dictionary()

    def fit(self, rows):
        return replace(self, dictionary=self.dictionary.fit(rows))

    def transform(self, rows):
        return WordBag(norm=None, tf=None, idf=None).transform(rows, self.dictionary)


@query(_UNION)
def feature_union(spark, sf_dir):
    rows = doc_tokens(spark, sf_dir)
    docs = read(spark, sf_dir, "documents").select("doc_id", F.lit(0).alias("idx"), F.length("text").cast("double").alias("val"))
    bag = _Counts().fit(rows)
    size = bag.dictionary.words.count() + 1
    return C.FeatureUnion([("bag", bag, size), ("none", "drop", 9), ("length", lambda d: docs, 1)], {"length": 0.5}).transform(rows)


@query("select conv_id, turn as idx, count(*)::double as val from conversations group by 1, 2")
def ragged_lists(spark, sf_dir):
    lists = read(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.collect_list("turn").alias("turns"))
    return C.ragged_to_features(lists, "conv_id", "turns")


@query(f"with {DICT_SQL}, {EACH_SQL} select doc_id, id as idx, count(*)::double as val from each join dict using (word) group by 1, 2")
def feature_cache(spark, sf_dir):
    path = fresh_path(spark, "features")
    rows = doc_tokens(spark, sf_dir)
    io.cached(spark, path, lambda: _Counts().fit(rows).transform(rows))
    return io.cached(spark, path, lambda: (_ for _ in ()).throw(AssertionError("made twice")))


@query(f"{_SEQ} select doc_id, array_to_string(ids, ' ') as ids from seq")
def sequence_round_trip(spark, sf_dir):
    path = fresh_path(spark, "sequences")
    rows = turn_tokens(spark, sf_dir)
    io.save_table(WordSeq().transform(rows, Dictionary(max_words=500).fit(rows)), path)
    return io.load_table(spark, path)[0].select("doc_id", F.array_join(F.col("ids").cast("array<string>"), " ").alias("ids"))


class _Centred:
    """Numbers of characters about their mean over all rows."""

    def fit(self, df):
        self.mean = df.agg(F.avg("n_chars")).first()[0]

    def transform(self, t: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"doc_id": t.doc_id, "x": (t.n_chars - self.mean).round(6)})


@query("select doc_id, round(n_chars - avg(n_chars) over (), 6) as x from documents")
def batch_transformer(spark, sf_dir):
    rows = read(spark, sf_dir, "documents").select("doc_id", "n_chars")
    return C.BatchTransformer(_Centred(), "doc_id long, x double").fit_transform(rows)


@query("select doc_id, n_chars * 2 + 1 as x from documents")
def decorated_batches(spark, sf_dir):
    @C.batch_function("doc_id long, x long")
    def scaled(t: pd.DataFrame, by: int, plus: int = 0) -> pd.DataFrame:
        return pd.DataFrame({"doc_id": t.doc_id, "x": t.n_chars * by + plus})

    return scaled(read(spark, sf_dir, "documents").select("doc_id", "n_chars"), 2, plus=1)


@query("select o_custkey, max(o_orderkey) as last from orders group by 1")
def decorated_groups(spark, sf_dir):
    @C.group_function("o_custkey", "o_custkey long, last long")
    def last(t: pd.DataFrame) -> pd.DataFrame:
        return t.groupby("o_custkey").o_orderkey.max().rename("last").reset_index()

    return last(read(spark, sf_dir, "orders").select("o_custkey", "o_orderkey"))


@query(
    """with v as (select 'w' || vec_id % 50 as word, generate_subscripts(embedding, 1) - 1 as dim, unnest(embedding)::decimal(12, 3)::double as x from embeddings)
select word, dim, round(avg(x), 6) + 0.0 as x from v group by 1, 2"""
)
def word_vector_file(spark, sf_dir):
    """The embeddings as a file of word vectors, several of a word, with a header, and read again."""
    path = fresh_path(spark, "vectors")
    cells = F.transform("embedding", lambda x: x.cast("decimal(12,3)").cast("string"))
    lines = read(spark, sf_dir, "embeddings").select(F.concat_ws(" ", F.concat(F.lit("W"), (F.col("vec_id") % 50).cast("string")), cells).alias("value"))
    lines.unionByName(spark.createDataFrame([("2000 64",)], "value string")).write.option("compression", "gzip").text(path)
    got = io.read_word_vectors(spark, path, dim=64, normalize=F.lower)
    return got.select("word", F.posexplode("vec").alias("dim", "x")).select("word", F.col("dim").cast("long").alias("dim"), (F.round("x", 6) + 0.0).alias("x"))


@query("select text as content, (quality * 2 + toxic - 3) * 0.5 as label from documents join labels using (doc_id)")
def review_files(spark, sf_dir):
    """Documents as lines of two reviews, one without a rating, with a broken line, and read again."""
    path = fresh_path(spark, "reviews")
    rated = F.struct(F.col("text").alias("Content"), F.struct((F.col("quality") * 2 + F.col("toxic")).cast("string").alias("Overall")).alias("Ratings"))
    other = F.struct(F.col("text").alias("Content"), F.struct(F.lit(None).cast("string").alias("Overall")).alias("Ratings"))
    rows = read(spark, sf_dir, "documents").join(read(spark, sf_dir, "labels"), "doc_id")
    lines = rows.select(F.to_json(F.struct(F.array(other, rated).alias("Reviews"))).alias("value"))
    lines.unionByName(spark.createDataFrame([('{"Reviews": [',)], "value string")).write.text(path)
    return io.read_reviews(spark, path)


_CLEANED = r"trim(regexp_replace(regexp_replace(' ' || text, ' @[^ ]* ', ' ', 'g'), '[A-Za-z0-9_]+\]', '', 'g'))"


@query(
    f"""with t as (select conv_id * 100000 + turn as n, {_CLEANED} as text, case role when 'user' then 1 when 'assistant' then -1 else 0 end as label from conversations)
select row_number() over (order by min(n)) - 1 as id, text, arg_min(label, n) as label from t group by text"""
)
def tweet_files(spark, sf_dir):
    """Turns as CSV files with a header and quoted texts, and read again: the first of equal texts counts."""
    path = fresh_path(spark, "tweets")
    n, role = F.col("conv_id") * 100_000 + F.col("turn"), F.col("role")
    name = F.when(role == "user", "positive").when(role == "assistant", "negative").otherwise("neutral")
    rows = read(spark, sf_dir, "conversations").select(n.alias("n"), "text", name.alias("airline_sentiment"))
    files = rows.repartitionByRange(4, "n").sortWithinPartitions("n").select("text", "airline_sentiment")
    files.write.csv(path, header=True, quoteAll=True, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    return io.read_tweets(spark, path)


@query(
    f"""{_FIXED}, {EACH_SQL}, new as (select doc_id, x, coalesce(corrected, word) as word from each left join fixed using (word)),
newdf as (select word, count(distinct doc_id) as df from new group by word), n as (select count(*) as n from tok),
d as (select word, df, row_number() over (order by df desc, word desc) as id from newdf),
s as (select doc_id, id as idx, ln(1 + count(*)) * any_value(ln(greatest(1, 50 + n.n / df)) / ln(greatest(1, 50 + n.n::double))) as val from new join d using (word), n where df >= 2 group by 1, 2)
select doc_id, dense_id as idx, round(val / sqrt(sum(val * val) over (partition by doc_id)), 6) as val from s join (select id, row_number() over (order by df desc, word desc) as dense_id from d where df >= 2) on idx = id"""
)
def text_pipeline(spark, sf_dir):
    p = C.TextPipeline(tokenizer=Tokenizer(8, 2), dictionary=Dictionary(min_df=2), extractor=WordBag(idf=50.0))
    return p.fit_transform(spread(read(spark, sf_dir, "documents").select("doc_id", "text"))).select("doc_id", "idx", F.round("val", 6).alias("val"))


@query(f"with {TOK_SQL} select word, count(*) as df from (select unnest(list_distinct(tokens)) as word from tok) group by word")
def stream_doc_freq(spark, sf_dir):
    source, state, marks = (fresh_path(spark, x) for x in ("stream-in", "stream-state", "stream-marks"))
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    each = -(-docs.rdd.getNumPartitions() // 3)  # three batches, of as many files as keep a file the size of a piece of the table
    docs.repartition(3 * each, "doc_id").write.parquet(source)
    stream = spark.readStream.schema(docs.schema).option("maxFilesPerTrigger", each).parquet(source)
    grown = StreamingDictionary(state, Dictionary())
    grown.run(stream, marks).awaitTermination()
    return grown.latest(spark).words.select("word", "df")
