"""Licence scans by canonical digests.

A text is reduced to a canonical form: lower case, copyright lines dropped,
punctuation as single spaces, equivalent spellings made one. The digest of the
whole canonical text is hash-joined to those of known licences. Looked up are a
document as a whole, each of its blocks (parted by blank lines) and each line,
always as entire texts.

Only texts with one of ANCHOR's word stems are reduced. A stem lies within one
word, where canonical() parts nothing, and no spelling rule makes one of other
letters; so a text has a stem if its canonical form has. That every known
canonical form has one is checked when the known digests are made.
Everything runs as built-in expressions; the known digests, a table that does
not depend on the corpus, are broadcast up to ``broadcast_known`` rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomtext.llm.license_texts import DIGESTS, KNOWN

#: The canonical form of every known licence has at least one of these. None reaches over a space, which may be a line or any punctuation in the text.
ANCHOR = r"licen[cs]e|gplv|permission|redistribut|domain|reserved|software|released|distributed|available"
#: Words after "copyright" at the start of a line that go on with a sentence, as the known texts' lines do wherever they are wrapped; any other is a year, a sign or a holder.
_NOT_HOLDERS = r"notices?|holders?|owners?|laws?|interests?|licen[cs]\w*|statements?|protect\w*|infring\w*|and|or|is|in|of|to|as|for|may|shall|must"
_COPYRIGHT = rf"(^|\n)[^\p{{L}}\p{{N}}\n]*(©|\(c\)|copyright[ \t]*(©|\(c\)|[0-9]|by )|copyright[^\p{{L}}\p{{N}}\n]+(?!({_NOT_HOLDERS})\b)[\p{{L}}\p{{N}}])[^\n]*"
#: For the oracle, whose expressions have no lookahead: the word in a sentence is marked first, then lines are dropped, then the mark becomes the word.
_SQL_SENTENCE = rf"(^|\n)([^\p{{L}}\p{{N}}\n]*)copyright([ \t]+|[ \t]*[^\p{{L}}\p{{N}}\n© \t][^\p{{L}}\p{{N}}\n]*)(({_NOT_HOLDERS})\b)"
_SQL_COPYRIGHT = r"(^|\n)[^\p{L}\p{N}\n]*(©|\(c\)|copyright[ \t]*(©|\(c\)|[0-9]|by )|copyright[^\p{L}\p{N}\n]+[\p{L}\p{N}])[^\n]*"
#: Applied in order to canonical text with single spaces; a pattern and its replacement mean the same in Java and RE2.
SPELLINGS = [
    (r"licenc", "licens"),
    (r"is(e|es|ed|er|ers|ing|ation|ations)\b", r"iz\1"),
    (r"our(s|ed|ing|ite|able|ably)?\b", r"or\1"),
    (r"ogue(s?)\b", r"og\1"),
    (r"ll(ed|ing)\b", r"l\1"),
    (r"dgement", "dgment"),
    (r"\bwhilst\b", "while"),
    (r"\bhttps\b", "http"),
    (r"\b(sub|non) (licens|commercial|infring|exclusiv)", r"\1\2"),
    (r"\bper cent\b", "percent"),
    (r"\bcopyright owner", "copyright holder"),
    (r"\b(version|ver|v) ?([0-9])", r"v\2"),
]


def canonical(text: Column) -> Column:
    """The canonical form of a text; empty if nothing but copyright lines and punctuation is in it."""
    t = F.regexp_replace(F.lower(text), _COPYRIGHT, "$1")
    t = F.trim(F.regexp_replace(t, r"[^\p{L}\p{N}]+", " "))
    for pattern, to in SPELLINGS:
        t = F.regexp_replace(t, pattern, to.replace("\\", "$"))
    return t


def known_digests(spark: SparkSession, known: list[tuple[str, str]] = KNOWN, digests: list[tuple[str, str]] = DIGESTS) -> DataFrame:
    """(digest, license) of the known texts and of those that are known by digest; the first licence in alphabetical order where two have one digest."""
    table = spark.createDataFrame(known, "license string, text string")
    stray = table.where(~canonical(F.col("text")).rlike(ANCHOR)).first()
    if stray:
        raise ValueError(f"a known text of {stray.license} has none of the stems {ANCHOR}")
    whole = spark.createDataFrame(digests, "license string, digest string").select("digest", "license")
    return table.select(F.md5(canonical(F.col("text"))).alias("digest"), "license").unionByName(whole).groupBy("digest").agg(F.min("license").alias("license"))


def scan(docs: DataFrame, known: list[tuple[str, str]] = KNOWN, *, broadcast_known: int = 100_000, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, scope, part, license): every match of a document, block or line.

    part numbers blocks and lines from 0, and is 0 for a document. A block is
    looked up if the document has several, and a line if its block has several
    lines or the document several blocks of one line each: no text is looked up
    twice. Null and empty texts match nothing. Repeated rows give repeated
    matches; null ids are carried along; extra columns aren't read.
    """
    plain = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).where(F.lower("text").rlike(ANCHOR))
    blocks = F.split(F.regexp_replace("text", "\r\n?", "\n"), r"\n[ \t]*\n")
    lines = F.split(F.regexp_replace("text", "\r\n?", "\n"), "\n")
    entry = lambda scope: lambda x, i: F.struct(F.lit(scope).alias("scope"), i.alias("part"), x.alias("unit"))
    units = F.concat(
        F.array(F.struct(F.lit("document").alias("scope"), F.lit(0).alias("part"), F.col("text").alias("unit"))),
        F.when(F.size(blocks) > 1, F.filter(F.transform(blocks, entry("block")), lambda u: F.contains(u["unit"], F.lit("\n")))).otherwise(F.array()),
        F.when(F.size(lines) > 1, F.transform(lines, entry("line"))).otherwise(F.array()),
    )
    each = plain.select("doc_id", F.explode(units).alias("u")).select("doc_id", "u.*").where(F.lower("unit").rlike(ANCHOR))
    table = known_digests(docs.sparkSession, known)
    if len(known) <= broadcast_known:
        table = F.broadcast(table)
    return each.select("doc_id", "scope", "part", F.md5(canonical(F.col("unit"))).alias("digest")).join(table, "digest").select("doc_id", "scope", "part", "license")


def _sql_canonical(text: str) -> str:
    out = f"regexp_replace(lower({text}), '{_SQL_SENTENCE}', '\\1\\2' || chr(1) || '\\3\\4', 'g')"
    out = f"replace(regexp_replace({out}, '{_SQL_COPYRIGHT}', '\\1', 'g'), chr(1), 'copyright')"
    out = f"trim(regexp_replace({out}, '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'))"
    for pattern, to in SPELLINGS:
        out = f"regexp_replace({out}, '{pattern}', '{to}', 'g')"
    return out


def sql(known: list[tuple[str, str]] = KNOWN, digests: list[tuple[str, str]] = DIGESTS) -> str:
    """The same without any filter of texts or units."""
    rows, whole = (", ".join("(" + ", ".join("'" + x.replace("'", "''") + "'" for x in r) + ")" for r in table) for table in (known, digests))
    return f"""
with known as (select digest, min(license) as license from (select license, md5({_sql_canonical("body")}) as digest from (values {rows}) k(license, body) union all select license, digest from (values {whole}) d(license, digest)) group by 1),
docs as (select doc_id, text, regexp_replace(text, chr(13) || chr(10) || '?', chr(10), 'g') as t from documents where text is not null),
parts as (select doc_id, text, regexp_split_to_array(t, '\\n[ \\t]*\\n') as blocks, string_split(t, chr(10)) as lines from docs),
units as (
  select doc_id, 'document' as scope, 0 as part, text as unit from parts
  union all select doc_id, 'block', i - 1, blocks[i] from (select doc_id, blocks, unnest(range(1, len(blocks) + 1)) as i from parts where len(blocks) > 1) where contains(blocks[i], chr(10))
  union all select doc_id, 'line', i - 1, lines[i] from (select doc_id, lines, unnest(range(1, len(lines) + 1)) as i from parts where len(lines) > 1))
select u.doc_id, u.scope, u.part::integer as part, k.license from (select *, md5({_sql_canonical("unit")}) as digest from units) u join known k using (digest)
"""
