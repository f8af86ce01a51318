"""Columns of the queries recomputed in plain Python, and stages of the pipeline against all pairs."""

import re
import zlib
from collections import Counter, defaultdict
from hashlib import sha256

import corpus_pipeline
import pytest

from lodeline.llm import queries
from lodeline.llm.common import ready, table


@pytest.fixture(autouse=True)
def settle(spark):
    ready(spark)


def test_shards_of_all_documents(spark, tiny):
    texts = Counter((r.doc_id, r.text or "") for r in table(spark, tiny, "documents").select("doc_id", "text").collect())
    got = queries.QUERIES["op5_sharding"](spark, tiny).collect()
    want = Counter()
    for (doc_id, text), n in texts.items():
        data = text.encode()
        want[doc_id, len(data) + 16, zlib.crc32(data)] += n
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in got) == want
    slots = defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
    assert set(slots) == set(range(40))
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
    assert {(r.law, r.grown_shard) for r in got} == {("rows", None)}


def test_digests_of_all_conversations(spark, tiny):
    marks = "</s>[INST] ok [/INST]"
    turns = defaultdict(list)
    for r in table(spark, tiny, "conversations").orderBy("conv_id", "turn").collect():
        turns[r.conv_id].append((r.role, r.text or ""))
    turns[-1] = [("user", marks), ("assistant", marks)]
    got = {r.conv_id: r for r in queries.QUERIES["op8_chat"](spark, tiny).collect()}
    assert set(got) == set(turns)
    for conv_id, said in turns.items():
        whole = "".join(f"{role}\n{text}\n" for role, text in said)
        loss = "".join(text for role, text in said if role == "assistant")
        r = got[conv_id]
        assert (r.n_turns, r.turns_sha256) == (len(said), sha256(whole.encode()).hexdigest())
        assert (r.loss_chars, r.loss_sha256) == (len(loss), sha256(loss.encode()).hexdigest())
        assert r.formatted_chars > sum(len(text) for _, text in said)


def test_languages_of_all_documents(spark):
    sf = "/root/testdata/sf0.01"
    docs = {r.doc_id: r for r in table(spark, sf, "documents").select("doc_id", "lang", "text").collect()}
    got = {r.doc_id: r for r in queries.QUERIES["op6_language"](spark, sf).collect()}
    assert set(got) == set(docs)
    held = {i for i in docs if zlib.crc32(str(i).encode()) % 4 == 2}
    assert {i for i, r in got.items() if r.held_out} == held
    learned = {r.lang for i, r in docs.items() if i not in held and r.lang is not None}
    lettered = {i for i, r in docs.items() if any(c.isalpha() for c in r.text or "")}
    assert all(got[i].lang_pred in learned for i in lettered)
    assert all(got[i].lang_pred == "und" for i in set(docs) - lettered)
    assert all(0 <= r.score <= 1 for r in got.values())
    judged = [i for i in held & lettered if docs[i].lang in learned]
    assert sum(got[i].lang_pred == docs[i].lang for i in judged) >= 0.95 * len(judged)


def words(text):
    return re.findall("[^\x20\x09-\x0d]+", text or "")


def test_near_dedup_stage_against_all_pairs(spark, tiny):
    docs = table(spark, tiny, "documents")
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = {}
    for r in docs.select("doc_id", "text").collect():
        said = words((r.text or "").translate(lower))
        width = min(5, len(said))
        sets[r.doc_id] = {tuple(said[i : i + width]) for i in range(len(said) - width + 1)} if said else set()
    root = {i: i for i in sets}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for n, i in enumerate(ids):
        for j in ids[n + 1 :]:
            inter = len(sets[i] & sets[j])
            if inter and 100 * inter >= 80 * (len(sets[i]) + len(sets[j]) - inter):
                a, b = sorted((top(i), top(j)))
                root[b] = a
    kept = corpus_pipeline.near_dedup(spark, docs, tiny)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == [i for i in ids if top(i) == i]


def test_mixing_stage_repeats_whole_documents_near_the_targets(spark, tiny):
    docs = table(spark, tiny, "documents")
    rows = docs.select("doc_id", "source", "text").collect()
    size = {r.doc_id: len(words(r.text)) for r in rows}
    source = {r.doc_id: r.source for r in rows}
    total, largest = Counter(), Counter()
    for i, s in source.items():
        total[s] += size[i]
        largest[s] = max(largest[s], size[i])
    # The weights in turn, the excess over two passes shared again until there is none.
    names = sorted(total, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[n % 3] for n, s in enumerate(names)}
    target, free, left = {}, set(names), 1.5 * sum(total.values())
    while free:
        level = left / sum(weight[s] for s in free)
        full = {s for s in free if level * weight[s] >= 2 * total[s]}
        if not full:
            target |= {s: level * weight[s] for s in free}
            break
        target |= {s: 2.0 * total[s] for s in full}
        left -= sum(2 * total[s] for s in full)
        free -= full
    mixed = corpus_pipeline.mix_sources(spark, docs, tiny)
    assert mixed.columns == docs.columns
    times = Counter(r.doc_id for r in mixed.select("doc_id").collect())
    assert set(times.values()) <= {1, 2}
    taken = Counter()
    for i, n in times.items():
        taken[source[i]] += n * size[i]
    most = max(largest.values())
    assert all(abs(taken[s] - target[s]) <= 2 * most for s in names)
