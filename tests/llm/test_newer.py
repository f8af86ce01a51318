"""Swap packing, whitening and the Merkle manifest against plain Python."""

import random
import zlib
from collections import defaultdict
from hashlib import sha256
from math import floor

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from lodeline.llm import merkle, queries, swap_packing, whitening
from lodeline.llm.common import ready, table

WORD_BPE = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(autouse=True)
def settle(spark):
    ready(spark)


# Packing with swaps


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 40), max_size=60))
def test_pieces_are_packed_whole(sizes):
    places, offsets = swap_packing.pack_sizes(sizes, 40)
    by_bin = defaultdict(list)
    for size, place, offset in zip(sizes, places, offsets):
        by_bin[place].append((offset, size))
    assert sorted(by_bin) == list(range(len(by_bin)))
    for found in by_bin.values():
        found.sort()
        assert [o for o, _ in found] == [sum(s for _, s in found[:i]) for i in range(len(found))] and sum(s for _, s in found) <= 40


@pytest.mark.parametrize("seed", range(4))
def test_the_search_raises_squared_fill_and_empties_bins(seed):
    draw = random.Random(seed)
    sizes = [draw.randint(500, 900) for _ in range(600)]
    bins = swap_packing.Bins(sizes, 2048)
    started, squares = int((bins.fill > 0).sum()), int((bins.fill**2).sum())
    step = bins._improve

    def watched(taken):
        nonlocal squares
        done = step(taken)
        now = int((bins.fill**2).sum())
        assert now > squares if done else now == squares
        squares = now
        return done

    bins._improve = watched
    bins.empty_bins()
    ended = int((bins.fill > 0).sum())
    assert bins.least <= ended < started
    assert all(bins.fill[b] == sum(sizes[i] for i in found) <= 2048 for b, found in enumerate(bins.inside))
    assert sorted(i for found in bins.inside for i in found) == list(range(600))


@pytest.mark.parametrize("full,items", [(10, [6, 5, 5, 4]), (12, [7, 7, 5, 5]), (10, [8, 2, 9, 1])])
def test_the_least_number_of_bins_is_found(full, items):
    assert max(swap_packing.pack_sizes(items, full)[0]) + 1 == -(-sum(items) // full)


def test_best_fit_query_gives_the_ids_of_the_library(spark, tiny):
    plain = Tokenizer.from_file(WORD_BPE)
    docs = {d.doc_id: np.array(plain.encode(d.text or "", add_special_tokens=False).ids + [0], "<u4") for d in table(spark, tiny, "documents").collect()}
    found = queries.QUERIES["op11_best_fit"](spark, tiny).collect()
    assert sum(r.length for r in found) == sum(map(len, docs.values()))
    by_sequence = defaultdict(list)
    for r in found:
        ids = docs[r.doc_id]
        assert (r.start, r.length) == (2048 * r.piece, min(2048, len(ids) - r.start))
        assert zlib.crc32(ids[r.start : r.start + r.length].tobytes()) == r.ids_crc32
        by_sequence[r.sequence_id].append((r.offset, r.length))
    for places in by_sequence.values():
        places.sort()
        assert [o for o, _ in places] == [sum(n for _, n in places[:i]) for i in range(len(places))] and sum(n for _, n in places) <= 2048
    assert len(by_sequence) <= -(-sum(map(len, docs.values())) // 2048) + 1


def test_best_fit_takes_edge_rows_and_no_rows(spark, edge_docs, no_docs):
    found = swap_packing.pack(edge_docs, WORD_BPE).collect()
    assert sum(r["start"] == 0 for r in found) == 12 and all(len(r["ids"]) == 4 * r["length"] for r in found)
    assert swap_packing.pack(no_docs, WORD_BPE).collect() == []


def test_copies_beyond_a_group_are_packed_in_parts(spark, monkeypatch):
    pieces = spark.range(500).selectExpr("7 AS doc_id", "0L AS start", "700L AS length").repartition(2)
    placed = swap_packing.place_pieces(pieces, 1).collect()
    places = defaultdict(list)
    for r in placed:
        places[r["sequence_id"]].append(r["offset"])
    assert len(placed) == 500 and len(places) == 250 and all(sorted(o) == [0, 700] for o in places.values())


# Whitening


def brute_whitening(rows, weight="one"):
    kept = [(i, tuple(floor(256 * float(c)) for c in v)) for i, v in rows if v is not None and all(c is not None and np.isfinite(c) for c in v)]
    fitted = [x for _, x in kept] if weight == "copies" else sorted({x for _, x in kept})
    n, x = len(fitted), np.array(fitted, float)
    sums = [sum(v[d] for v in fitted) for d in range(len(fitted[0]))]
    values, axes = np.linalg.eigh(np.cov(x.T, bias=True))
    out = {}
    for i, v in kept:
        white = [abs((np.array(v) - np.array(sums) / n) @ axes[:, -k] / values[-k] ** 0.5) for k in range(1, 1 + min(4, len(values)))]
        out.setdefault(i, []).append((sum((n * a - s) ** 2 for a, s in zip(v, sums)), white))
    return n, out, [values[-k] / values.sum() for k in range(1, 1 + min(4, len(values)))]


@pytest.mark.parametrize("sf", ["0.001", "0.01"])
def test_whitening_query_against_numpy(spark, sf):
    sf_dir = f"/root/testdata/sf{sf}"
    n, want, explained = brute_whitening([(r.vec_id, r.embedding) for r in table(spark, sf_dir, "embeddings").collect()])
    found = queries.QUERIES["op12_whitening"](spark, sf_dir).collect()
    assert len(found) == 4 * len(want) and {r.n for r in found} == {n} and {r.identity_error for r in found} == {found[0].identity_error}
    assert found[0].identity_error < 1e-9
    for r in found:
        deviation, white = want[r.vec_id][0]
        assert r.deviation == deviation and abs(abs(r.whitened) - white[r.component - 1]) < 1e-6
        assert abs(r.explained / explained[r.component - 1] - 1) < 1e-9


def made_vectors(spark):
    draw = random.Random(1)
    rows = [(i, [draw.gauss(0, 1), draw.gauss(0, 0.5), draw.gauss(0, 0.1)]) for i in range(40)]
    rows += [(100 + i, rows[0][1]) for i in range(30)]
    odd = [(200, None), (201, [1.0, None, 2.0]), (202, [1.0, float("nan"), 2.0]), (203, [float("inf"), 0.0, 0.0]), (204, [1.0, 2.0]), (None, [0.5, 0.5, 0.5]), (5, [0.25, 0.0, 0.0])]
    frame = spark.createDataFrame(rows + odd, "vec_id bigint, embedding array<double>")
    return rows + [r for r in odd if r[0] != 204], frame.selectExpr("*", "'clash' AS x", "1 AS copies", "2 AS whitened")


@pytest.mark.parametrize("weight", ["one", "copies"])
@pytest.mark.parametrize("hot", [10_000, 5])
def test_whitening_of_edge_rows(spark, weight, hot, monkeypatch):
    monkeypatch.setattr(whitening, "HOT_COPIES", hot)
    monkeypatch.setattr(whitening, "HOT_PARTS", 1000)
    rows, frame = made_vectors(spark)
    n, want, _ = brute_whitening([(i, v) for i, v in rows], weight) if weight == "one" else (None, None, None)
    out, model, error = whitening.whiten(frame, weight=weight, components=3)
    found = out.collect()
    assert len(found) == 73 and error < 1e-9 and model.n == (n or 72)
    assert [r["whitened"] for r in found if r["vec_id"] == 204] == [None]
    assert {tuple(r["whitened"]) for r in found if (r["vec_id"] or 0) >= 100 and r["vec_id"] != 204} == {tuple(next(r["whitened"] for r in found if r["vec_id"] == 0))}
    if weight == "one":
        for r in found:
            if r["vec_id"] != 204:
                assert r["deviation"] in {d for d, _ in want[r["vec_id"]]}


def test_whitening_without_variance_or_rows(spark):
    frame = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0])], "vec_id bigint, embedding array<double>")
    out, model, error = whitening.whiten(frame)
    assert model.n == 1 and error == 0 and [(r["deviation"], r["whitened"]) for r in out.collect()] == [(0, []), (0, [])]
    out, model, _ = whitening.whiten(frame.where("false"))
    assert model is None and out.collect() == []
    nothing = frame.selectExpr("vec_id", "cast(array() AS array<double>) AS embedding")
    assert [r["whitened"] for r in whitening.whiten(nothing)[0].collect()] == [None, None]


def test_deviations_beyond_a_long_are_null():
    model = whitening.Whitening(2**40, [0], np.zeros(1), np.ones(1), np.ones((1, 1)), np.ones(1))
    assert model.deviation(np.array([[1], [2**20], [2**21]], np.int64)) == [None, None, None]
    model = whitening.Whitening(3, [2**33], np.zeros(1), np.ones(1), np.ones((1, 1)), np.ones(1))
    assert model.deviation(np.array([[0], [2**31]], np.int64)) == [None, (3 * 2**31 - 2**33) ** 2]


# Merkle manifest


def digest(texts):
    return sha256("".join(texts).encode()).hexdigest()


def leaf_of(values):
    return digest("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values)


def tree_of(leaves):
    """Root, and for every leaf the siblings of each step to the left and right."""
    paths, at, level = [[] for _ in leaves], list(range(len(leaves))), list(leaves)
    while len(level) > 1:
        for i, place in enumerate(at):
            start = place // 3 * 3
            paths[i].append((level[start:place], level[place + 1 : start + 3]))
            at[i] = place // 3
        level = [digest(level[i : i + 3]) for i in range(0, len(level), 3)]
    return level[0], paths


def brute_manifest(docs):
    by_source = defaultdict(list)
    for d in docs:
        by_source[d[3]].append((d[0], leaf_of((d[0], d[3], d[2], d[4], d[1]))))
    sources = sorted(by_source, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in sources:
        by_source[s].sort(key=lambda p: (p[0] is not None, p[0] or 0, p[1]))
        trees[s] = tree_of([leaf for _, leaf in by_source[s]])
    root, above = tree_of([trees[s][0] for s in sources])
    out = []
    for s, over in zip(sources, above):
        for (doc_id, leaf), path in zip(by_source[s], trees[s][1]):
            out.append((doc_id, leaf, trees[s][0], digest(d for left, right in path + over for d in left + right)))
    return root, out


def found_manifest(docs):
    from pyspark.sql import functions as F

    proofs, root = merkle.manifest(docs)
    assert proofs.where(merkle.fold(F.col("leaf"), F.col("steps")) != F.lit(root)).isEmpty()
    rows = proofs.select("doc_id", "leaf", "subroot", F.sha2(merkle.siblings(F.col("steps")), 256)).collect()
    return root, sorted(map(tuple, rows), key=str)


def test_manifest_of_edge_rows(edge_docs, no_docs):
    docs = [tuple(r) for r in edge_docs.select("doc_id", "text", "lang", "source", "n_chars").collect()]
    root, want = brute_manifest(docs)
    assert found_manifest(edge_docs) == (root, sorted(want, key=str))
    proofs, none = merkle.manifest(no_docs)
    assert none is None and proofs.collect() == []


@pytest.mark.parametrize("sizes,sent", [([1], 0), ([1, 1, 1, 1, 1], 4_000_000), ([40, 1, 7], 0), ([95], 0), ([3, 28], 4_000_000)])
def test_manifest_of_trees_of_all_heights(spark, sizes, sent, monkeypatch):
    monkeypatch.setattr(merkle, "LEVELS", 2)
    monkeypatch.setattr(merkle, "SENT_BYTES", sent)
    docs = [(1000 * s + i, f"text {i}", "en", f"s{s}", i) for s, n in enumerate(sizes) for i in range(n)]
    docs += docs[:3]
    frame = spark.createDataFrame(docs, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    root, want = brute_manifest(docs)
    assert found_manifest(frame) == (root, sorted(want, key=str))


def test_tampered_documents_do_not_lead_to_the_root(spark, tiny):
    texts = {r.doc_id: r.text for r in table(spark, tiny, "documents").collect()}
    found = queries.QUERIES["op13_merkle"](spark, tiny).collect()
    assert len(found) == len(texts) and len({r.root for r in found}) == 1
    for r in found:
        cut = zlib.crc32(str(r.doc_id).encode()) % 2 == 0 and "\n" in (texts[r.doc_id] or "")
        assert r.verified == (not cut) == (r.folded_root == r.root)
    assert {r.verified for r in found} == {True, False}
