import pytest


@pytest.fixture(scope="session")
def edge_docs(spark):
    """Nulls in every column, empty and long texts, ties, repeated rows, columns with clashing names."""
    long_text = " ".join(f"w{i % 977}" for i in range(60_000))
    rows = [
        (1, "the cat sat on the mat and the dog lay by the door all day", "en", "a", 58),
        (1, "the cat sat on the mat and the dog lay by the door all day", "en", "a", 58),
        (2, None, None, None, None),
        (3, "", "en", "a", 0),
        (4, " \t\n\x0b\x0c\r ", "de", "b", 7),
        (None, "ein Text ohne Nummer der trotzdem aus genug einzelnen Wörtern besteht damit er bleibt", "de", None, 20),
        (None, None, "de", "b", 0),
        (5, "x", None, "b", 1),
        (6, long_text, "en", "c", len(long_text)),
        (7, "12 34 !!! ###", "en", "c", 13),
        (8, "the cat sat on the mat and the dog lay by the door all day", None, "c", 58),
        (9, "é ü 中 \U0001f600 </s> [INST] \\ a\x00b", "fr", "", 20),
    ]
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint"
    extra = "n_words kept ids size bands finish text_key language sequence_id row_no shard _row _key host target".split()
    docs = spark.createDataFrame(rows, schema)
    for name in extra:
        docs = docs.selectExpr("*", f"'clash' AS {name}")
    return docs


@pytest.fixture(scope="session")
def no_docs(edge_docs):
    return edge_docs.where("false")
