"""Quality rules from the frequency of lines across documents, in DataFrame operations.

Lines are normalised (white space squeezed, lower case) and hashed, and the
distinct documents that hold a line are counted per host. Equal texts are one
document, so copies of a page do not make its lines common. A line above the
limit of its host is boilerplate and goes; a document with too little left goes.

A common line is counted over distinct (host, line, text), which spreads it over
all tasks, and only the few common lines meet the lines of the documents again.
Defined cases: a null text has no words and fails; a null source is a host of its
own; equal rows give equal results; a text of one very long line is one line.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodeline.llm.common import GAP, written

# A line is common above this many documents of its host and this share of them.
MAX_DOCS = 10
MAX_SHARE = 0.002
# A document is depleted if less than this share of its words is left.
LEAST_LEFT = 0.3
LEAST_WORDS = 10
MOST_REPEATED_PERCENT = 20
SYMBOLS = "#*$%&|<>"
WINDOW = 5
_SPACES = " \t\n\x0b\x0c\r"


def words_of(text: Column) -> Column:
    """Words of a text as an array."""
    squeezed = F.trim(F.regexp_replace(text, GAP, " "))
    return F.when(squeezed == "", F.array().cast("array<string>")).otherwise(F.split(squeezed, " "))


def without(text: Column, characters: str) -> Column:
    return F.translate(text, characters, "")


def _let(value: Column, use) -> Column:
    """``use(value)``, with the value worked out once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def repeated_words(words: Column, window: int = WINDOW) -> Column:
    """Number of words inside windows of words that occur twice or more."""

    def covered(hashes: Column) -> Column:
        placed = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def again(sorted_: Column) -> Column:
            last = F.size(sorted_) - 1
            at = lambda k: F.get(sorted_, k)["h"]
            same = lambda x, k: ((k > 0) & (at(k - 1) == x["h"])) | ((k < last) & (at(k + 1) == x["h"]))
            return F.array_sort(F.transform(F.filter(sorted_, same), lambda x: x["i"]))

        def length(places: Column) -> Column:
            start = F.struct(F.lit(-window).alias("end"), F.lit(0).alias("total"))
            step = lambda acc, p: F.struct(
                (p + window).alias("end"), (acc["total"] + F.least(F.lit(window), p + window - acc["end"])).alias("total")
            )
            return F.aggregate(places, start, step)["total"]

        some = F.size(hashes) > F.size(F.array_distinct(hashes))
        return F.when(some, _let(_let(placed, again), length)).otherwise(F.lit(0))

    def hashed(words_: Column) -> Column:
        places = F.sequence(F.lit(1), F.size(words_) - (window - 1))
        windows = F.transform(places, lambda i: F.xxhash64(F.slice(words_, i, window)))
        return F.when(F.size(words_) > window, _let(windows, covered)).otherwise(F.lit(0))

    return _let(words, hashed)


def base_measures(docs: DataFrame) -> DataFrame:
    """Add the counts of words, symbols, repeated lines and repeated words, and ``base_failed``."""
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda line: without(line, _SPACES) != "")
    words = words_of(text)
    counts = {
        "n_words": F.size(words),
        "word_chars": F.length(without(text, _SPACES)),
        "n_symbols": F.length(text) - F.length(without(text, SYMBOLS)),
        "n_dup_lines": _let(lines, lambda kept: F.size(kept) - F.size(F.array_distinct(kept))),
        "n_repeat_words": repeated_words(words),
    }
    measured = docs.withColumns({name: value.cast("bigint") for name, value in counts.items()})
    failed = (F.col("n_words") < LEAST_WORDS) | (
        100 * F.col("n_repeat_words") > MOST_REPEATED_PERCENT * F.col("n_words")
    )
    return measured.withColumn("base_failed", failed)


def text_key() -> Column:
    return F.xxhash64(F.coalesce(F.col("text"), F.lit("")))


def line_table(docs: DataFrame) -> DataFrame:
    """One row per line with a word: ``doc_id, host, text_key, line_no, line_key, line_words``."""
    lines = docs.select(
        "doc_id", F.col("source").alias("host"), text_key().alias("text_key"),
        F.posexplode(F.split("text", "\n")).alias("line_no", "_line"),
    )
    squeezed = lines.withColumn("_line", F.lower(F.trim(F.regexp_replace("_line", GAP, " ")))).where("_line <> ''")
    spaces = F.length("_line") - F.length(without(F.col("_line"), " "))
    return squeezed.select(
        "doc_id", "host", "text_key", "line_no", F.xxhash64("_line").alias("line_key"), (spaces + 1).cast("bigint").alias("line_words")
    )


def common_lines(lines: DataFrame, max_docs: int = MAX_DOCS, max_share: float = MAX_SHARE) -> DataFrame:
    """``host, line_key, line_docs`` of the lines above the limit of their host."""
    seen = lines.select("host", "line_key", "text_key").distinct()
    counts = seen.groupBy("host", "line_key").agg(F.count("*").alias("line_docs")).where(F.col("line_docs") > max_docs)
    hosts = lines.select("host", "text_key").distinct().groupBy("host").agg(F.count("*").alias("_host_docs"))
    hosts = hosts.withColumnRenamed("host", "_host")
    return counts.join(hosts, F.col("host").eqNullSafe(F.col("_host"))).where(
        F.col("line_docs") > F.lit(max_share) * F.col("_host_docs")
    ).select("host", "line_key", "line_docs")


def removed_lines(lines: DataFrame, common: DataFrame) -> DataFrame:
    """``doc_id, host, text_key, removed, removed_words`` of documents that hold common lines."""
    c = common.select(F.col("host").alias("_host"), F.col("line_key").alias("_line_key"))
    held = lines.join(c, F.col("host").eqNullSafe(F.col("_host")) & (F.col("line_key") == F.col("_line_key")))
    # Equal rows hold the same lines: each line of a text counts once.
    once = held.groupBy("doc_id", "host", "text_key", "line_no").agg(F.first("line_words").alias("line_words"))
    return once.groupBy("doc_id", "host", "text_key").agg(
        F.collect_list("line_no").alias("removed"), F.sum("line_words").alias("removed_words")
    )


MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
VERDICT = [*MEASURES, "removed", "removed_words", "kept"]


def judge(
    docs: DataFrame, carry: list[str] | None = None, max_docs: int = MAX_DOCS, max_share: float = MAX_SHARE,
    least_left: float = LEAST_LEFT,
) -> DataFrame:
    """The columns ``carry`` (all, if not given) of every document with ``VERDICT``.

    ``removed`` holds the numbers of its common lines, null if it has none. A
    column of the documents named like one of these gives way.
    """
    carry = [c for c in (docs.columns if carry is None else carry) if c not in VERDICT]
    lines = written(line_table(docs.select("doc_id", "source", "text")), "lines")
    removed = removed_lines(lines, common_lines(lines, max_docs, max_share))
    removed = removed.select(
        *[F.col(c).alias(f"_{c}") for c in ("doc_id", "host", "text_key")], "removed", F.col("removed_words").alias("_words")
    )
    rows = docs.select(F.struct(*carry).alias("_row"), F.col("doc_id").alias("_id"), F.col("source").alias("_source"), "text")
    measured = base_measures(rows).withColumn("_key", text_key()).drop("text")
    same = F.col("_id").eqNullSafe(F.col("_doc_id")) & F.col("_source").eqNullSafe(F.col("_host"))
    joined = measured.join(removed, same & (F.col("_key") == F.col("_text_key")), "left")
    words = F.coalesce("_words", F.lit(0))
    left = F.col("n_words") - words
    kept = ~F.col("base_failed") & (left >= F.lit(least_left) * F.col("n_words"))
    return joined.select(
        *[F.col("_row").getField(c).alias(c) for c in carry], *MEASURES, "removed", words.alias("removed_words"), kept.alias("kept")
    )


def clean(docs: DataFrame) -> DataFrame:
    """The kept documents without their common lines, in the columns they came with.

    Where lines went, ``n_chars`` is that of the text that is left.
    """
    rows = docs.select(F.struct(*docs.columns).alias("row"), "doc_id", "source", "text")
    judged = judge(rows, ["row"]).where("kept")
    changed = F.col("removed").isNotNull()
    lines = F.filter(F.split("row.text", "\n"), lambda line, i: ~F.array_contains("removed", i))
    text = F.when(changed, F.array_join(lines, "\n")).otherwise(F.col("row.text"))
    own = {"text": text, "n_chars": F.when(changed, F.length(text).cast("bigint")).otherwise(F.col("row.n_chars"))}
    return judged.select(*[own.get(c, F.col("row").getField(c)).alias(c) for c in docs.columns])
