"""The operators against brute force, exact round trips, held-out accuracy and SQL."""

import random
import time
import tracemalloc
import zlib
from itertools import combinations

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from oracle import differences
from tokenizers import Tokenizer

from lodeline.llm import boosting, dom, flac, html_extract, langid, neardup, packing, queries, sharding, tokenfiles
from lodeline.llm.chat import Template
from lodeline.llm.common import ready, table
from lodeline.llm.components import components
from lodeline.llm.dom import parse
from lodeline.llm.tokenize import encoder

FILES = ["byte_bpe_50k.json", "word_bpe_49k.json"]


def test_every_operator_is_registered():
    assert sorted(int(name[2:].split("_")[0]) for name in queries.QUERIES) == list(range(1, 14))


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_against_sql(spark, tiny, name):
    assert differences(spark, tiny, queries.QUERIES[name], queries.ORACLES[name]) == []


@pytest.mark.parametrize("name", ["op2_quality", "op3_mixing"])
def test_native_operators_run_no_python(spark, tiny, name):
    plan = queries.QUERIES[name](spark, tiny)._jdf.queryExecution().executedPlan().toString()
    assert not any(word in plan for word in ("Python", "Pandas", "Arrow", "CartesianProduct", "NestedLoop"))


# Tokens


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(st.sampled_from("aB é\n\t'sΣİ ß1#\x1c\x85\u0301中😀\x00<|>") | st.characters(codec="utf-8"), max_size=12), max_size=5))
@pytest.mark.parametrize("name", FILES)
def test_encoder_agrees_with_the_library(name, texts):
    plain = Tokenizer.from_file(public_tokenizers.path(name))
    got = encoder(public_tokenizers.path(name)).encode(texts)
    assert [g.tolist() for g in got] == [plain.encode(t, add_special_tokens=False).ids for t in texts]


@pytest.mark.parametrize("name", FILES)
def test_names_of_special_tokens_are_their_ids_as_in_the_library(name):
    plain = Tokenizer.from_file(public_tokenizers.path(name))
    ids = lambda text: plain.encode(text, add_special_tokens=False).ids
    for i, token in plain.get_added_tokens_decoder().items():
        text = f"one {token.content} two{token.content}"
        found = encoder(public_tokenizers.path(name)).encode([text, "one two", text + "<|", token.content.upper()])
        assert [f.tolist() for f in found] == [ids(text), ids("one two"), ids(text + "<|"), ids(token.content.upper())]
        assert found[0].tolist().count(i) == 2


@pytest.mark.parametrize("space", [" ", "\n", "\t", " \n"])
@pytest.mark.parametrize("name", FILES)
def test_very_long_runs_of_white_space(name, space):
    plain = Tokenizer.from_file(public_tokenizers.path(name))
    text = "a" + space * (2_000_000 // len(space)) + "b c"
    assert encoder(public_tokenizers.path(name)).encode([text])[0].tolist() == plain.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("name,query", [(FILES[0], "op4_packing"), (FILES[1], "op7_token_ids")])
def test_token_queries_give_the_ids_of_the_library(spark, tiny, name, query):
    plain = Tokenizer.from_file(public_tokenizers.path(name))
    docs = table(spark, tiny, "documents").select("doc_id", "text").orderBy("doc_id").collect()
    ids = {d.doc_id: np.array(plain.encode(d.text or "", add_special_tokens=False).ids + [1], "<u4") for d in docs}
    found = queries.QUERIES[query](spark, tiny).collect()
    if query.startswith("op4"):
        assert sum(r.length for r in found) == sum(map(len, ids.values()))
        assert all(zlib.crc32(ids[r.doc_id][r.start : r.start + r.length].tobytes()) == r.ids_crc32 for r in found)
    else:
        starts = dict(zip(ids, np.cumsum([0, *map(len, ids.values())])))
        want = {d: (starts[d], len(i), zlib.crc32(i.tobytes())) for d, i in ids.items()}
        assert {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in found} == want


@given(st.integers(1, 32), st.data())
@settings(max_examples=60, deadline=None)
def test_bit_fields(width, data):
    ids = np.array(data.draw(st.lists(st.integers(0, 2**width - 1), max_size=60)), np.uint32)
    packed = tokenfiles.pack_bits(ids, width)
    assert len(packed) == -(-len(ids) * width // 8)
    assert tokenfiles.unpack_bits(packed, width, len(ids)).tolist() == ids.tolist()


def test_random_access_in_a_file(tmp_path):
    import pyarrow as pa

    docs = [np.arange(n, dtype=np.uint32) % 1000 for n in (0, 5, 300, 1, 77)]
    system, root = tokenfiles.file_system(str(tmp_path))
    writer = tokenfiles.IdFileWriter(system.open_output_stream(f"{root}/x.ids"), 10, block_ids=64)
    for i, ids in enumerate(docs):
        writer.add(i, ids)
    writer.close(pa.int64())
    file = tokenfiles.IdFile(system.open_input_file(f"{root}/x.ids"))
    assert [file.document(i).tolist() for i in range(5)] == [d.tolist() for d in docs]
    whole = np.concatenate(docs)
    assert all(file.range(a, b).tolist() == whole[a:b].tolist() for a in range(0, 380, 37) for b in range(a, 383, 51))


# Packing


def test_tournament_tree_is_first_fit_decreasing():
    draw = random.Random(3)
    for _ in range(30):
        sizes = [draw.randint(1, 100) for _ in range(draw.randint(1, 60))]
        room: list[int] = []
        want = {}
        for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
            place = next((b for b, left in enumerate(room) if left >= sizes[i]), len(room))
            if place == len(room):
                room.append(100)
            want[i] = (place, 100 - room[place])
            room[place] -= sizes[i]
        bins, offsets = packing.first_fit_decreasing(sizes, 100)
        assert {i: (b, o) for i, (b, o) in enumerate(zip(bins, offsets))} == want


# Sharding


@pytest.mark.parametrize("rows", [1, 2, 3, 17, 64, 65, 1000, 4097])
def test_permutation_and_its_inverse(rows):
    places = sharding.permute(np.arange(rows), rows)
    assert sorted(places.tolist()) == list(range(rows))
    assert sharding.permute(places, rows, back=True).tolist() == list(range(rows))
    shard, slot = sharding.locate(np.arange(rows), rows, 7)
    assert sharding.row_at(shard, slot, rows, 7).tolist() == list(range(rows))


def test_written_shards_hold_all_rows(spark, edge_docs, tmp_path):
    sharding.write_shards(edge_docs.drop("shard"), str(tmp_path / "s"), shards=3)
    back = spark.read.parquet(str(tmp_path / "s"))
    assert back.select("doc_id", "text").exceptAll(edge_docs.select("doc_id", "text")).isEmpty() and back.count() == 12


# Near duplicates


def _copies(seed: int) -> list[tuple[int, str]]:
    """Groups whose members differ by a few words, around the threshold, with texts that share long passages."""
    draw = random.Random(seed)
    words = [f"w{i}" for i in range(4000)]
    docs: list[str] = []
    for size in (1, 2, 5, 90, 160):
        base = draw.choices(words, k=draw.randint(40, 160))
        for _ in range(size):
            copy = list(base)
            for _ in range(draw.randint(0, 5)):
                copy[draw.randrange(len(copy))] = draw.choice(words)
            docs.append(" ".join(copy))
    docs += [docs[3], docs[-1], "", "  ", "one two", "one two", "ONE two", "solo"]
    draw.shuffle(docs)
    return list(enumerate(docs))


@pytest.mark.parametrize("seed,members", [(1, 32), (2, 4)])
def test_near_duplicates_against_all_pairs(spark, monkeypatch, seed, members):
    ready(spark)
    monkeypatch.setattr(neardup, "PAIRED_MEMBERS", members)
    monkeypatch.setattr(neardup, "BLOCK_MEMBERS", 40)
    docs = _copies(seed)
    sets = {}
    for i, text in docs:
        w = text.lower().split()
        sets[i] = {tuple(w[k : k + 3]) for k in range(len(w) - 2)} if len(w) > 2 else ({tuple(w)} if w else set())
    least = {i: i for i in sets}
    links = [(a, b) for a, b in combinations(sets, 2) if sets[a] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])]
    for _ in sets:
        for a, b in links:
            least[a] = least[b] = min(least[a], least[b])
    frame = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(4)
    got = neardup.near_duplicates(frame).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in got} == {i: (len(sets[i]), least[i], least[i] == i) for i in sets}


def test_signatures_refuse_no_link_and_most_strangers():
    rng = np.random.default_rng(5)
    for percent in (80, 85):
        bands = neardup.band_count(percent)
        need, signer = neardup.agreement_bound(bands * neardup.BAND_ROWS, percent), neardup.Signer(bands)
        agree = lambda a, b: np.count_nonzero(signer.minima(a).astype(np.uint8) == signer.minima(b).astype(np.uint8))
        draw = lambda n: np.unique(rng.integers(0, 2**63, n, dtype=np.uint64))
        for size in (20, 200, 2000):
            whole = draw(size)
            kept = -(-percent * len(whole) // 100)
            assert all(agree(whole, rng.choice(whole, kept, replace=False)) >= need for _ in range(40))
            assert all(agree(draw(size), draw(size)) < need for _ in range(40))
            assert all(agree(whole, rng.choice(whole, size * 4 // 10, replace=False)) < need for _ in range(40))


def test_a_bucket_of_one_component_and_a_stranger(spark, monkeypatch):
    """Members of the large component are copied once, not once for each of its blocks."""
    ready(spark)
    monkeypatch.setattr(neardup, "PAIRED_MEMBERS", 2)
    monkeypatch.setattr(neardup, "BLOCK_MEMBERS", 10)
    seen = []
    plain = neardup.block_links
    monkeypatch.setattr(neardup, "block_links", lambda units, *rest: seen.append(units) or plain(units, *rest))
    base = [f"w{i}" for i in range(60)]
    near = [(i, " ".join([*base, f"own{i}"])) for i in range(200)]
    # Shares most of the words with them, yet stays below the threshold.
    strangers = [(1000 + i, " ".join([*base[: 40 - i], *[f"s{i}.{k}" for k in range(8)]])) for i in range(3)]
    frame = spark.createDataFrame(near + strangers, "doc_id bigint, text string").repartition(4)
    got = {r.doc_id: r.component_id for r in neardup.near_duplicates(frame).collect()}
    sets = {i: {tuple(t.split()[k : k + 3]) for k in range(len(t.split()) - 2)} for i, t in near + strangers}
    least = {i: i for i in sets}
    for _ in range(3):
        for a, b in combinations(sets, 2):
            if 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
                least[a] = least[b] = min(least[a], least[b])
    assert got == least
    # At most one copy for each block of the strangers that a bucket holds, and theirs for its blocks.
    copies = seen[0].groupBy("unit.band").count().collect()
    assert copies and all(r["count"] <= 200 + 3 * (1 + 20 + 1) for r in copies)


def test_only_texts_that_meet_others_are_shuffled(spark, monkeypatch, tmp_path):
    """A filter stands before the shuffle of the texts, and no result depends on it."""
    ready(spark)
    names = ["spark.sql.autoBroadcastJoinThreshold", "spark.sql.optimizer.runtime.bloomFilter.applicationSideScanSizeThreshold"]
    before = [spark.conf.get(name) for name in names]
    base = [f"w{i}" for i in range(60)]
    near = [" ".join([*base, f"own{i}"]) for i in range(3)]
    docs = [(i, " ".join(f"d{i}.{k}" for k in range(20))) for i in range(300)]
    # An id that comes twice with different texts, a null id, and equal rows.
    docs += [(400, near[0]), (400, docs[7][1]), (None, near[1]), (500, near[2]), (500, near[2]), (600, None)]
    spark.createDataFrame(docs, "doc_id bigint, text string").repartition(4).write.parquet(f"{tmp_path}/docs")
    plans, sets_of = [], neardup.full_sets

    def seen(texts, words):
        plans.append((texts._jdf.queryExecution().optimizedPlan().toString(), texts.count()))
        return sets_of(texts, words)

    monkeypatch.setattr(neardup, "full_sets", seen)
    try:
        spark.conf.set(names[0], "-1")
        found = neardup.near_duplicates(spark.read.parquet(f"{tmp_path}/docs"))
        got = sorted((r.doc_id is None, r.doc_id, r.component_id) for r in found.collect())
        assert [spark.conf.get(name) for name in names] == ["-1", before[1]]
    finally:
        spark.conf.set(names[0], before[0])
    least = {7: 7, 400: None, None: 400, 500: 400}
    expected = [(i, least.get(i, i)) for i, _ in docs if i != 400] + [(400, 400), (400, 7)]
    assert got == sorted((i is None, i, c) for i, c in expected)
    # The two texts of id 400, that of no id, and the copies of 500.
    assert [rows for _, rows in plans] == [5]
    assert "might_contain" in plans[0][0]


def test_components_of_a_long_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(200)] + [(1000, 1000 + i) for i in range(1, 300)] + [(5000, 5000)]
    found = components(spark.createDataFrame(edges, "u bigint, v bigint"))
    assert {r.node: r.root for r in found.collect()} == {i: 0 for i in range(201)} | {1000 + i: 1000 for i in range(300)}


# Languages


def test_held_out_languages(spark):
    ready(spark)
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    model = langid.fit(docs.where(~langid.held_out()), sample_docs=200)
    rows = langid.identify(docs.where(langid.held_out()).select("lang", "text"), model).collect()
    right = sum(r.language["lang_pred"] == r.lang for r in rows)
    assert right / len(rows) > 0.97 and sum(r.language["rejected"] for r in rows) <= 0.02 * len(rows)


def test_labels_beyond_the_most_frequent(spark):
    ready(spark)
    made = [(i, "the words of this text are here and there", "en") for i in range(40)]
    made += [(100 + i, "die Worte des Textes sind hier und dort zu sehen", "de") for i in range(40)]
    made += [(1000 + i, "the label of this text says nothing", f"junk{i:03}") for i in range(langid.MOST_LANGUAGES + 40)]
    docs = spark.createDataFrame(made, "doc_id bigint, text string, lang string")
    with pytest.warns(UserWarning, match="42 labels of 42 documents"):
        model = langid.fit(docs)
    assert model.left_out == (42, 42) and len(model.languages) == langid.MOST_LANGUAGES
    assert model.languages == sorted(model.languages) and {"en", "de"} < set(model.languages)
    assert langid.identify(docs, model).where("language.lang_pred is not null").count() == len(made)
    few = langid.fit(docs.where("lang in ('en', 'de')"))
    assert few.left_out == (0, 0) and few.predict("die Worte des Textes")[0] == "de"


# Pages


def test_made_up_pages_the_trees_have_not_seen():
    forest, draw = html_extract.trained(), random.Random(1234)
    right = total = 0
    for _ in range(40):
        tree = parse(html_extract.training_page(draw))
        rows, blocks, own = html_extract.node_features(tree)
        kept = html_extract.decode(tree, blocks, forest.log_odds(rows), own)
        assert all(kept[tree.nodes[i].parent] for i in range(1, len(kept)) if kept[i])
        hits = [kept[i] == tree.nodes[i].marked for i, chars in zip(blocks.tolist(), own) if chars]
        right, total = right + sum(hits), total + len(hits)
    assert right / total > 0.99


def test_pages_give_their_article(spark, tiny):
    import html
    import re

    pages = {r.page_id: r.html for r in table(spark, tiny, "pages").collect()}
    for row in queries.QUERIES["op1_html_text"](spark, tiny).collect():
        article = re.search(r"<article>(.*?)</article>", pages[row.page_id], re.S)[1]
        blocks = re.sub(r"<[^>]+>", "", re.sub(r"</?(?:p|h1|br)>", "\n", article)).split("\n")
        assert row.text == " ".join(" ".join(html.unescape(b).split()) for b in blocks if b.strip())


def test_text_of_odd_markup():
    page = (
        "<html><head><title>t</title></head><body><nav><a href=/>home</a></nav><article><h1>A &amp; B&nbsp;&#233;</h1>"
        "<p>one<b>two</b> <i>three\n four</i><br>five<ul><li>six<li>seven</ul><p>x &lt;p&gt; y<script>no()</script></article>"
        "<div class='comments'><p>first reader comment here</p></div><footer>end</footer>"
    )
    assert html_extract.main_text(page, html_extract.trained()) == "A & B é onetwo three four five six seven x <p> y"


def test_formulas_graphics_and_players_are_read():
    start = "<html><body><nav><a href=/>home</a></nav><article><h1>On the energy of masses</h1><p>The energy of a mass at rest, "
    formula = "<math><mrow><mi>E</mi><mo>=</mo><mi>m</mi><msup><mi>c</mi><mn>2</mn></msup></mrow></math>"
    end = ", was found by measuring.</p><p>More words of the article follow here, and then it ends.</p></article><footer>end</footer></body></html>"
    want = "On the energy of masses The energy of a mass at rest, {}, was found by measuring. More words of the article follow here, and then it ends."
    forest = html_extract.trained()
    assert html_extract.main_text(start + formula + end, forest) == want.format("E=mc2")
    assert html_extract.main_text(start + "<math><mi>E</mi>" + end, forest) == want.format("E")
    assert html_extract.main_text(start + "<math><mtr><mtd>1<mtd>2</mtr></math>" + end, forest) == want.format("1 2 ")
    for tag in ("object", "canvas", "audio", "video", "svg", "noembed", "noframes"):
        tree = parse(f"<p>before</p><{tag}>its own text<p>and more</p></{tag}><p>after</p>")
        assert [t for _, t in tree.pieces if t] == ["before", "its own text", "and more", "after"]
        assert tag in [tree.nodes[i].tag for i in html_extract.node_features(tree)[1]]
        assert html_extract.main_text(start + f"<{tag}>" + end, forest).endswith("follow here, and then it ends.")
    for tag in ("script", "style", "noscript", "template", "iframe"):
        assert [t for _, t in parse(f"a<{tag}>b</{tag}>c").pieces if t] == ["a", "c"]
    assert parse("<p>a<svg><title/><path d='m0'/><text>b</text></svg>c").pieces[-1][1] == "c"


def test_siblings_are_counted_in_large_families():
    for n in (20, 401, 2500):
        rows, blocks, _ = html_extract.node_features(parse("<article>" + "<p>some words</p>" * n + "<h2>b</h2></article>"))
        place, family, share = rows[2:, -15:-12].T
        assert place.tolist() == list(range(n + 1)) and set(family) == {n + 1}
        assert np.allclose(share, [n / (n + 1)] * n + [1 / (n + 1)])


def test_trees_learn_a_rule():
    rows = np.random.default_rng(0).random((2000, 4))
    labels = ((rows[:, 0] > 0.5) ^ (rows[:, 2] > 0.3)).astype(float)
    assert ((boosting.train(rows, labels, trees=20).log_odds(rows) > 0) == (labels > 0)).mean() > 0.98


# Chat


@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "system", "", "tool x]"]), st.text(st.sampled_from("</s>[INST] \\AN\nYé"), max_size=20)), max_size=4))
@settings(max_examples=200, deadline=None)
def test_conversations_read_back(turns):
    template = Template()
    assert template.parse("".join(piece for piece, _, _ in template.segments(turns))) == turns


# FLAC


@given(st.lists(st.binary(max_size=400), min_size=1, max_size=4), st.sampled_from([1, 0]))
@settings(max_examples=40, deadline=None)
def test_streams_read_back(parts, smooth):
    payloads = [p + bytes(-len(p) % 64 if p else 64) for p in parts]
    if smooth:
        payloads.append((128 + 100 * np.sin(np.arange(64 * 130) / 9)).astype(np.uint8).tobytes())
    streams = flac.encode(payloads)
    assert [b"".join(block for _, block in blocks) for blocks in flac.decode(streams)] == payloads
    for payload, stream in zip(payloads, streams):
        head = flac.read_metadata(stream)
        unseekable = stream[:4] + b"\x80" + stream[5:42] + stream[head.first :]
        assert [b for b in flac.decode([unseekable])] == flac.decode([stream]) and head.samples == len(payload)


def test_a_stream_by_hand():
    """A frame written bit by bit: a fixed predictor of order one, an escaped partition and a Rice one."""
    samples = [-3, -2, -2, 5] + [5] * 12
    bits = "0" + "001001" + "0" + f"{samples[0] & 255:08b}" + "00" + "0001"
    bits += "1111" + "01000" + "".join(f"{(b - a) & 255:08b}" for a, b in zip(samples[:7], samples[1:8]))
    bits += "0001" + "10" * 8
    head = flac.frame_header(0, 16)
    body = head + bytes(int(bits.ljust(-(-len(bits) // 8) * 8, "0")[i : i + 8], 2) for i in range(0, len(bits), 8))
    check = flac.crc16_of_ranges(np.frombuffer(body, np.uint8), np.array([0]), np.array([len(body)]))[0]
    frame = body + int(check).to_bytes(2, "big")
    assert flac._decode_frames([frame]) == [bytes(s + 128 for s in samples)]
    with pytest.raises(ValueError):
        flac._decode_frames([frame[:-4] + bytes([frame[-4] ^ 1]) + frame[-3:]])


@pytest.mark.parametrize("wasted", [1, 3, 7])
@pytest.mark.parametrize("kind", ["constant", "verbatim", "fixed", "linear"])
def test_wasted_bits_by_hand(kind, wasted):
    """Frames whose samples end in zeros that are not written."""
    held = 8 - wasted
    low, high = -(1 << held - 1), (1 << held - 1) - 1
    samples = [low] * 16 if kind == "constant" else ([low, high, 0, low] * 4 if kind == "verbatim" else [low, low, high, 0] + [0] * 12)
    bits = lambda value, size: f"{value & (1 << size) - 1:0{size}b}"
    rice = lambda error: "0" * (error << 1 ^ error >> 31) + "1"
    code = {"constant": "000000", "verbatim": "000001", "fixed": "001001", "linear": "100000"}[kind]
    written = f"0{code}1" + "0" * (wasted - 1) + "1"
    if kind == "constant":
        written += bits(low, held)
    elif kind == "verbatim":
        written += "".join(bits(s, held) for s in samples)
    else:
        # Either predictor takes the sample before; of the linear one 2 >> 1.
        written += bits(samples[0], held) + ("0011" + "00001" + "0010" if kind == "linear" else "") + "000000" + "0000"
        written += "".join(rice(b - a) for a, b in zip(samples, samples[1:]))
    body = flac.frame_header(0, 16) + bytes(int(written.ljust(-(-len(written) // 8) * 8, "0")[i : i + 8], 2) for i in range(0, len(written), 8))
    check = flac.crc16_of_ranges(np.frombuffer(body, np.uint8), np.array([0]), np.array([len(body)]))[0]
    assert flac._decode_frames([body + int(check).to_bytes(2, "big")]) == [bytes((s << wasted) + 128 for s in samples)]


# Pages that never end a tag, a quote or an element


@pytest.mark.parametrize(
    "unit", ["<a ", "<div>", "<p><div>", '<x "', "<a b='\"", "<!", "<?", "<p><button><div>", "<b><div><i></b>", "<li><ul>", "<!--", "<title>", '<a "b>" ', "</x><i>"]
)
def test_a_megabyte_of_open_things_is_parsed_in_seconds(unit):
    page = unit * (1_000_000 // len(unit))
    start = time.perf_counter()
    tree = dom.parse(page)
    dom.block_text(tree, [True] * len(tree.nodes))
    dom.parse("<a x" * 250_000 + '"<>"')
    assert time.perf_counter() - start < 30


def test_open_things_of_a_page():
    read = lambda html: dom.block_text(tree := dom.parse(html), [True] * len(tree.nodes))
    assert read('<p>one<p title="x>two</p>') == "one two"
    assert read("<p>a <b") == "a <b" and read("a <!-- b") == "a" and read("a <! b") == "a <! b"
    assert read("&#" + "9" * 5000 + ";x &#00065; &#x41;") == "\ufffdx A A"


# The sample and the memory of the language model


def test_the_sample_of_a_language_is_bounded_with_repeated_ids(spark):
    docs = spark.range(3000).selectExpr("1 AS doc_id", "concat('some words of document ', id) AS text", "'en' AS lang")
    docs = docs.union(spark.range(500).selectExpr("2 AS doc_id", "'the same text in all of them' AS text", "'de' AS lang"))
    languages, pieces, _ = langid.labelled_pieces(docs, sample_docs=50)
    assert languages == ["de", "en"]
    assert len(pieces) <= 2 * 50 * langid.PIECES and len({p[2] for p in pieces if p[1] == 1}) == 50


def test_long_texts_are_counted_slice_by_slice():
    draw = np.random.default_rng(1)
    table = draw.normal(size=(1 << langid.BUCKET_BITS, 3)).astype(np.float32)
    text = " ".join("".join(draw.choice(list("abcdefgh"), 5)) for _ in range(langid.SLICE // 3))
    assert np.allclose(langid.mean_embedding(text, table), table[langid.features(text)].mean(axis=0, dtype=np.float64), atol=1e-9)
    long_text = "ab cd " * (20_000_000 // 6)
    tracemalloc.start()
    langid.mean_embedding(long_text, table)
    assert tracemalloc.get_traced_memory()[1] < 200_000_000
    tracemalloc.stop()
