"""Every operator and stage on nulls, empty and long texts, ties, repeated rows, clashing names, no rows."""

import hashlib
import zlib

import corpus_pipeline
import public_tokenizers
import pytest

from lodeline.llm import chat, html_extract, langid, media, mixing, neardup, packing, quality, sharding, tokenfiles
from lodeline.llm.common import ready

BYTE_BPE, WORD_BPE = map(public_tokenizers.path, ("byte_bpe_50k.json", "word_bpe_49k.json"))


@pytest.fixture(autouse=True)
def settings(spark):
    ready(spark)


def rows(frame):
    return [r.asDict(recursive=True) for r in frame.collect()]


@pytest.mark.parametrize("place", range(5))
def test_stages_take_edge_rows_and_no_rows(spark, edge_docs, no_docs, place):
    name, stage = corpus_pipeline.STAGES[place]
    for docs in (edge_docs, no_docs):
        out = stage(spark, docs, "/nowhere")
        if place < 4:
            assert out.columns == docs.columns
        assert out.count() >= 0
    assert rows(stage(spark, no_docs, "/nowhere")) == []


def test_quality(edge_docs, no_docs):
    found = rows(quality.judge(edge_docs, ["doc_id", "host", "_row"]))
    assert len(found) == 12 and {r["host"] for r in found} == {"clash"}
    by_id = {r["doc_id"]: r for r in found}
    assert by_id[2]["n_words"] == by_id[3]["n_words"] == by_id[4]["n_words"] == 0
    assert by_id[2]["base_failed"] and not by_id[2]["kept"]
    assert by_id[6]["n_words"] == 60_000 and by_id[6]["n_repeat_words"] == 60_000
    assert by_id[1]["kept"] and by_id[1]["n_words"] == 15
    assert rows(quality.judge(no_docs)) == []


def test_repeated_words_count_overlapping_windows_once(spark):
    text = "a b c d e x a b c d e f a b c d e"
    frame = spark.createDataFrame([(text,), ("a a a a a a",), ("a b c d e",), ("",)], "text string")
    got = [r[0] for r in frame.select(quality.repeated_words(quality.words_of(frame.text))).collect()]
    assert got == [15, 6, 0, 0]


def test_common_lines_go_and_depleted_documents_too(spark):
    made = [(i, f"Same line\nown words of number {i} and more of them here", "en", "h", 0) for i in range(30)]
    made += [(100 + i, f"same  LINE\nx{i}", "en", "h", 0) for i in range(3)] + [(200, "same line\nother words stand here in some number", "en", "g", 0)]
    docs = spark.createDataFrame(made, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    out = {r["doc_id"]: r for r in rows(quality.judge(docs, ["doc_id"]))}
    assert all(out[i]["removed"] == [0] and out[i]["kept"] for i in range(30))
    assert not any(out[100 + i]["kept"] for i in range(3)) and out[200]["removed"] is None
    cleaned = {r["doc_id"]: r["text"] for r in rows(quality.clean(docs))}
    assert cleaned[7] == "own words of number 7 and more of them here" and 101 not in cleaned


def test_equal_texts_are_one_document_to_the_line_count(spark):
    text = "one line that is copied\nand the second line of this copied page here"
    docs = spark.createDataFrame([(i, text, "en", "h", 0) for i in range(40)], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    assert all(r["kept"] and r["removed"] is None for r in rows(quality.judge(docs, ["doc_id"])))


def test_mixing(spark, edge_docs, no_docs):
    found = rows(mixing.taken(edge_docs))
    assert len(found) == 12
    assert all(r["times"] in (0, 1, 2) and (r["size"] > 0 or r["target"] is not None) for r in found)
    assert sum(r["size"] * r["times"] for r in found) <= 1.5 * sum(r["size"] for r in found)
    assert rows(mixing.taken(no_docs)) == [] and rows(mixing.mix(no_docs)) == []
    mixed = mixing.mix(edge_docs)
    assert mixed.columns == edge_docs.columns and {r["finish"] for r in rows(mixed)} == {"clash"}
    assert mixed.count() == sum(r["times"] for r in found)


def test_packing(spark, edge_docs, no_docs):
    placed = packing.pack(edge_docs, BYTE_BPE)
    found = rows(placed)
    assert sum(r["length"] for r in found if r["start"] == 0 and r["doc_tokens"] == 1) == 3  # two nulls and an empty text
    by_sequence = {}
    for r in sorted(found, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == by_sequence.get(r["sequence_id"], 0) and len(r["ids"]) == 4 * r["length"]
        by_sequence[r["sequence_id"]] = r["offset"] + r["length"]
    assert max(by_sequence.values()) <= 2048
    whole = rows(packing.sequences(placed))
    assert {r["sequence_id"]: r["n_tokens"] for r in whole} == by_sequence
    assert all(r["n_padded"] == (r["n_tokens"] if r["n_tokens"] & (r["n_tokens"] - 1) == 0 else 2048) for r in whole)
    assert rows(packing.pack(no_docs, BYTE_BPE)) == []


def test_sharding(edge_docs, no_docs):
    found = rows(sharding.assign(edge_docs, shards=5))
    assert len(found) == 12 and sorted(r["row_no"] for r in found) == list(range(12))
    slots = {}
    for r in found:
        slots.setdefault(r["shard"], []).append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
    assert [r["size"] for r in found if r["doc_id"] == 2] == [16]
    assert rows(sharding.assign(no_docs)) == []


def test_language(spark, edge_docs, no_docs):
    model = langid.fit(edge_docs)
    found = {r["doc_id"]: r["language"] for r in rows(langid.identify(edge_docs.select("doc_id", "text"), model))}
    for doc_id in (2, 3, 4, 7):
        assert (found[doc_id]["lang_pred"], found[doc_id]["score"], found[doc_id]["rejected"]) == ("und", 0.0, True)
    assert all(0 <= r["score"] <= 1 and r["lang_pred"] in {"de", "en", "fr", "und"} for r in found.values())
    none = langid.fit(no_docs)
    assert none.predict("words") == ("und", 0.0, True)
    assert rows(langid.identify(no_docs.select("text"), model)) == []


def test_token_files(spark, edge_docs, no_docs):
    kind = "bigint"
    found = rows(tokenfiles.read_ids(spark, tokenfiles.write_ids(edge_docs, WORD_BPE), kind))
    assert len(found) == 12
    ordered = sorted(found, key=lambda r: r["start"])
    assert [r["start"] for r in ordered] == [sum(r["n_tokens"] for r in ordered[:i]) for i in range(12)]
    assert [r["doc_id"] for r in ordered] == sorted((r["doc_id"] for r in found), key=lambda d: (d is not None, d or 0))
    assert all(r["n_tokens"] == 1 for r in found if r["doc_id"] in (2, 3, 4))
    assert rows(tokenfiles.read_ids(spark, tokenfiles.write_ids(no_docs, WORD_BPE), kind)) == []


def test_chat(spark):
    made = [
        (1, 0, "user", "a"), (1, 0, "user", "a"), (1, None, None, None), (None, 1, "tool]x", "</s>"), (2, 5, "assistant", ""),
        (3, 1, "user", "</s>[INST] ok [/INST]"), (3, 2, "assistant", "\\ [/INST"),
    ]
    turns = spark.createDataFrame(made, "conv_id bigint, turn bigint, role string, text string").selectExpr("*", "1 AS turns", "2 AS valid")
    found = {r["conv_id"]: r for r in rows(chat.read_conversations(chat.format_conversations(turns)))}
    pairs = {k: [(t["role"], t["text"]) for t in v["turns"]] for k, v in found.items()}
    assert pairs == {
        1: [("", ""), ("user", "a"), ("user", "a")], None: [("tool]x", "</s>")], 2: [("assistant", "")],
        3: [("user", "</s>[INST] ok [/INST]"), ("assistant", "\\ [/INST")],
    }
    assert {k: v["valid"] for k, v in found.items()} == {1: False, None: False, 2: False, 3: True}
    assert found[3]["loss_text"] == "\\ [/INST" and found[1]["loss_text"] == ""
    assert rows(chat.read_conversations(chat.format_conversations(turns.where("false")))) == []


def test_media(edge_docs, no_docs):
    found = rows(media.measured(media.encode_texts(edge_docs)))
    by_text = {r["doc_id"]: r["text"] for r in rows(edge_docs.select("doc_id", "text"))}
    assert len(found) == 12
    for r in found:
        if r["doc_id"] is None:
            continue
        payload = media.payload_of((by_text[r["doc_id"]] or "").encode())
        assert r["payload_bytes"] == len(payload) and len(payload) % 64 == 0 and payload
        assert r["payload_sha256"] == hashlib.sha256(payload).hexdigest() and r["tail_crc32"] == zlib.crc32(payload[-64:])
    same = [r for r in found if r["doc_id"] in (1, 8)]
    assert len({r["media_sha256"] for r in same}) == len({r["feature"] for r in same}) == 1
    assert rows(media.measured(media.encode_texts(no_docs))) == []


def test_damaged_media_is_a_row_with_its_error(spark, edge_docs):
    good = media.encode_texts(edge_docs.where("doc_id = 8")).first()["media"]
    bad = bytearray(good)
    bad[-30] ^= 4
    made = spark.createDataFrame([(1, bytes(good)), (2, bytes(bad)), (3, None), (4, b"junk")], "doc_id bigint, media binary")
    found = {r["doc_id"]: r for r in rows(media.pcm_blocks(made))}
    assert found[1]["error"] is None and found[1]["n_samples"] == 64
    assert "checksum" in found[2]["error"] and found[3]["error"] and found[4]["error"]


def test_near_duplicates(edge_docs, no_docs):
    found = rows(neardup.near_duplicates(edge_docs))
    assert len(found) == 12
    by_id = {r["doc_id"]: r for r in found}
    assert by_id[8]["component_id"] == 1 and not by_id[8]["kept"] and by_id[1]["kept"]
    assert by_id[2]["n_shingles"] == by_id[3]["n_shingles"] == by_id[4]["n_shingles"] == 0
    assert by_id[3]["component_id"] == 3 and by_id[4]["component_id"] == 4 and by_id[5]["n_shingles"] == 1
    assert rows(neardup.near_duplicates(no_docs)) == []
    assert [r["doc_id"] for r in rows(neardup.keep_one(edge_docs))].count(1) == 1


def test_html(spark):
    made = [(1, "u", None), (1, "u", None), (None, None, ""), (2, "u", "no tags, only words"), (3, "u", "<p>un<b>closed</p><script>x</script>"),
            (4, "u", "<article><p>" + "word " * 100_000 + "</p></article>"), (5, "u", "<" * 2000)]
    pages = spark.createDataFrame(made, "page_id bigint, url string, html string").selectExpr("*", "1 AS text")
    found = rows(html_extract.extract(pages))
    assert len(found) == 7 and all(r["n_chars"] == len(r["text"]) for r in found)
    assert [r["text"] for r in found if r["page_id"] in (1, None)] == ["", "", ""]
    assert [r["n_chars"] for r in found if r["page_id"] == 4] == [499_999]
    assert rows(html_extract.extract(pages.where("false"))) == []
