"""Body search over a table of postings: which texts hold which three characters in a row.

Texts and queries are compared in lower case. A query of three characters or more
is looked up by its rarest grams; the texts that hold all of them are candidates,
and only those are read and searched. Texts are posted with two end marks, so a
shorter query is found as the beginning of a gram, over all postings.

Texts have a key and a text. Defined cases: a null key or text has no postings;
repeated queries are one; a null or empty query finds nothing; no texts give no
rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from lodeline.session import stored

GRAM = 3
END_MARKS = "\0\0"
# Grams of a query that are looked up, the rarest first; all if there are fewer.
RAREST = 4


def grams(text: Column) -> Column:
    """Different grams of a text, in one pass."""
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(f"(?s)(?=(.{{{GRAM}}}))"), F.lit(1)))


def postings(texts: DataFrame, key: str, text: str) -> DataFrame:
    """``gram, <key>``: one row per text and gram.

    The grams of a text are different as they are taken, so only the rows of keys
    that come more than once are shuffled to be made distinct.
    """
    known = texts.where(F.col(key).isNotNull() & F.col(text).isNotNull())
    posted = lambda rows: rows.select(F.explode(grams(F.concat(F.col(text), F.lit(END_MARKS)))).alias("gram"), F.col(key))
    repeated = stored(known.groupBy(F.col(key).alias("_repeated")).agg(F.count("*").alias("_rows")).where("_rows > 1").select("_repeated"))
    if repeated.isEmpty():
        return posted(known)
    same = F.col(key) == F.col("_repeated")
    return posted(known.join(repeated, same, "left_anti")).union(posted(known.join(repeated, same, "left_semi")).distinct())


def gram_counts(posted: DataFrame) -> DataFrame:
    """``gram, n_texts``: how many texts hold a gram."""
    return posted.groupBy("gram").agg(F.count("*").alias("n_texts"))


def update_postings(posted: DataFrame, changed: DataFrame, key: str, text: str) -> DataFrame:
    """Postings after texts have changed: the old ones of the changed keys go, those of texts that are not null come."""
    kept = posted.join(stored(changed.select(key).distinct()), key, "left_anti")
    return kept.select("gram", key).unionByName(postings(changed, key, text))


def candidates(queries: DataFrame, posted: DataFrame, counts: DataFrame, key: str, rarest: int = RAREST) -> DataFrame:
    """``query, <key>`` of texts that hold the rarest grams of a query.

    The grams of the queries are as few as the queries are long; a window has the
    grams of one query. A gram that no text holds leaves its query without candidates.
    """
    wanted = queries.select("query").where(F.length("query") >= GRAM).distinct().select("query", F.explode(grams(F.col("query"))).alias("gram"))
    counted = wanted.join(counts, "gram", "left").withColumn("n_texts", F.coalesce("n_texts", F.lit(0)))
    place = F.row_number().over(Window.partitionBy("query").orderBy("n_texts", "gram"))
    picked = counted.withColumn("_place", place).where(F.col("_place") <= rarest)
    picked = stored(picked.withColumn("_picked", F.count("*").over(Window.partitionBy("query"))))
    met = picked.join(posted, "gram").groupBy("query", key).agg(F.count("*").alias("_met"), F.first("_picked").alias("_picked"))
    return met.where(F.col("_met") == F.col("_picked")).select("query", key)


def search_texts(
    queries: DataFrame, texts: DataFrame, posted: DataFrame, counts: DataFrame, key: str, text: str, rarest: int = RAREST
) -> DataFrame:
    """``query, <key>`` of all texts that hold a query, the same as a scan finds."""
    queries = stored(queries.select("query").distinct())
    found = candidates(queries, posted, counts, key, rarest)
    for length in range(1, GRAM):
        short = queries.select("query").where(F.length("query") == length).distinct().withColumn("_start", F.lower("query"))
        met = posted.withColumn("_start", F.substring("gram", 1, length)).join(short, "_start")
        found = found.unionByName(met.select("query", key).distinct())
    # A text is put in lower case once, not for each of its queries.
    lower = texts.select(key, F.lower(F.col(text)).alias("_lower"))
    return lower.join(found, key).where(F.contains("_lower", F.lower("query"))).select("query", key)


def share_read(queries: DataFrame, texts: DataFrame, posted: DataFrame, counts: DataFrame, key: str, rarest: int = RAREST) -> DataFrame:
    """``query, candidates, share``: the texts that a query reads, and their part of all texts."""
    found = candidates(queries, posted, counts, key, rarest).groupBy("query").agg(F.count("*").alias("candidates"))
    total = texts.where(F.col(key).isNotNull()).count()
    asked = queries.select("query").where(F.length("query") >= GRAM).distinct().join(found, "query", "left")
    number = F.coalesce("candidates", F.lit(0))
    return asked.select("query", number.alias("candidates"), (number / F.lit(max(1, total))).alias("share"))
