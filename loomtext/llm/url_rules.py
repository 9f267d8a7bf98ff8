"""URL filtering by association rules.

URLs become sets of tokens. On the labelled ones, Spark's FP-growth mines token
combinations together with the label ``bad``; a rule is kept if it has the
support and the confidence, and no shorter rule within it is as confident.
Pruning looks rules up by an inverted index too, on the executors.
Rules are posted in an inverted index under their rarest token, so a URL is
only compared with rules that share that token.
"""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomtext.session import written

BAD = "label=bad"


def url_tokens(url: Column) -> Column:
    """Distinct tokens of a URL, in order: scheme, domain labels, path segments, file ending, query fields, fragment.

    Numbers in path and query are written #. A null or empty URL has no tokens.
    """
    u = F.lower(F.trim(url))
    host = F.regexp_extract(u, r"^(?:[a-z][a-z0-9+.-]*:)?//([^/?#]*)", 1)
    host = F.regexp_replace(F.regexp_replace(host, r"^[^@]*@", ""), r":[0-9]*$", "")
    rest = F.regexp_replace(u, r"^(?:[a-z][a-z0-9+.-]*:)?//[^/?#]*", "")
    path = F.regexp_replace(F.regexp_replace(rest, r"[?#].*$", ""), r"[0-9]+", "#")
    query = F.regexp_replace(F.regexp_extract(rest, r"\?([^#]*)", 1), r"[0-9]+", "#")
    some = lambda kind, values: F.transform(F.filter(values, lambda x: x != ""), lambda x: F.concat(F.lit(kind), x))
    labels = F.split(host, r"\.")
    parts = [
        some("scheme=", F.array(F.regexp_extract(u, r"^([a-z][a-z0-9+.-]*):", 1))),
        some("host=", F.array(host)),
        some("name=", labels),
        some("word=", F.flatten(F.transform(labels, lambda x: F.filter(F.split(x, "-"), lambda y: F.contains(x, F.lit("-")) & (y != ""))))),
        some("path=", F.split(path, "/")),
        some("type=", F.array(F.regexp_extract(path, r"\.([a-z]+)$", 1))),
        some("query=", F.split(query, "&")),
        some("fragment=", F.array(F.regexp_extract(rest, r"#([^?]*)", 1))),
    ]
    return F.array_distinct(F.coalesce(F.concat(*parts), F.array().cast("array<string>")))


def mine(labelled: DataFrame, *, min_support: float = 0.002, min_count: int = 5, min_confidence: float = 0.6, url: str = "url", bad: str = "bad") -> DataFrame:
    """(tokens, confidence, support): the rules, from rows with a URL and a boolean label.

    Support is a share of the labelled rows, at least min_count rows. Tokens
    that every row has are left out: a rule with one is no surer than without,
    unless the token alone is a rule. Rows without a label or without a token
    are passed over; repeated rows count.
    """
    spark = labelled.sparkSession
    rows = labelled.where(F.col(bad).isNotNull()).select(url_tokens(F.col(url)).alias("t"), F.col(bad).cast("boolean").alias("bad")).where(F.size("t") > 0)
    rows = rows.cache()
    try:
        n, positive = rows.agg(F.count("*"), F.sum(F.col("bad").cast("long"))).first()
        if not positive:
            return spark.createDataFrame([], "tokens array<string>, confidence double, support double")
        everywhere = [r.x for r in rows.select(F.explode("t").alias("x")).groupBy("x").count().where(F.col("count") == n).collect()] if positive < min_confidence * n else []
        left = F.array_except("t", F.array(*[F.lit(x) for x in everywhere])) if everywhere else F.col("t")
        items = rows.select(F.when(F.col("bad"), F.array_append(left, F.lit(BAD))).otherwise(left).alias("items"))
        support = min(1.0, max(min_support, min_count / n))
        model = FPGrowth(itemsCol="items", minSupport=support, minConfidence=min_confidence).fit(items)
        found = model.associationRules.where(F.col("consequent") == F.array(F.lit(BAD)))
        rules = written(found.select(F.array_sort("antecedent").alias("tokens"), "confidence", "support"), "rules")
    finally:
        rows.unpersist()
    return undominated(rules)


def posted(rules: DataFrame) -> DataFrame:
    """(x, own, own_confidence): every rule under that of its tokens that the fewest rules have."""
    token = rules.select(F.explode("tokens").alias("x")).groupBy("x").count()
    each = rules.select(F.col("tokens").alias("own"), F.col("confidence").alias("own_confidence"), F.explode("tokens").alias("x")).join(token, "x")
    rarest = F.row_number().over(Window.partitionBy("own").orderBy("count", "x"))
    return each.withColumn("r", rarest).where("r = 1").select("x", "own", "own_confidence")


def undominated(rules: DataFrame) -> DataFrame:
    """The rules within which no shorter rule is as confident."""
    within = rules.select("tokens", "confidence", F.explode("tokens").alias("x")).join(posted(rules), "x")
    within = within.where((F.size("own") < F.size("tokens")) & (F.col("own_confidence") >= F.col("confidence")) & (F.size(F.array_except("own", "tokens")) == 0))
    return rules.join(within.select("tokens").distinct(), "tokens", "left_anti").select("tokens", "confidence", "support")


def match(pages: DataFrame, rules: DataFrame, *, key: str = "page_id", url: str = "url", broadcast_rules: int = 100_000) -> DataFrame:
    """(page_id, url, blocked, rules, confidence) for every row of pages.

    blocked: at least one rule's tokens are all in the URL; rules is how many,
    confidence that of the surest, 0 without. Null and empty URLs match no
    rule. Repeated rows stay repeated; null keys are carried along.
    """
    rows = pages.select(F.col(key).alias("page_id"), F.col(url).alias("url"))
    tokens = rows.select("url").distinct().withColumn("t", url_tokens(F.col("url")))
    posts = posted(rules)
    if rules.count() <= broadcast_rules:
        posts = F.broadcast(posts)
    hits = tokens.select("url", "t", F.explode("t").alias("x")).join(posts, "x").where(F.size(F.array_except("own", "t")) == 0)
    best = hits.groupBy("url").agg(F.count("*").alias("rules"), F.max("own_confidence").alias("confidence"))
    out = rows.join(best, "url", "left")
    return out.select("page_id", "url", F.col("rules").isNotNull().alias("blocked"), F.coalesce("rules", F.lit(0)).alias("rules"), F.coalesce("confidence", F.lit(0.0)).alias("confidence"))


def filter_urls(pages: DataFrame, labels: DataFrame, *, key: str = "page_id", url: str = "url", **how) -> DataFrame:
    """match() with rules mined from ``labels``: (doc_id, quality, toxic) of the document whose number is in the URL's path.

    The number is the first path segment, or stem before a file ending, of
    digits alone; one that is no id (too large for a long) has no label. A
    label is bad if quality is 0 or toxic is 1; both null is no label.
    """
    number = F.expr(f"try_cast(regexp_extract(`{url}`, r'^[^?#]*?/([0-9]+)(?=([.][A-Za-z]+)?([/?#]|$))', 1) as bigint)")
    verdict = F.coalesce(F.col("toxic") == 1, F.lit(False)) | F.coalesce(F.col("quality") == 0, F.lit(False))
    known = labels.where("doc_id is not null and (quality is not null or toxic is not null)").groupBy("doc_id").agg(F.max(verdict).alias("bad"))
    labelled = pages.select(F.col(url).alias("url"), number.alias("doc_id")).join(known, "doc_id").select("url", "bad")
    return match(pages, mine(labelled, **how), key=key, url=url)
