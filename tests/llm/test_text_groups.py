"""Verified near-duplicates: groups by the exact share of five-word shingles, against brute force."""


import numpy as np
import pytest

from copytrail.llm import blocks, simhash
from copytrail.llm.common import table
from tests.llm.test_operators import ODD, clashing, docs_of, plain_components, prose


def shingles(text, words=5):
    parts = (text or "").encode().lower().split()
    return {b" ".join(parts[i:i + words]) for i in range(max(1, len(parts) - words + 1))} if parts else set()


def alike(a, b):
    return not a | b or len(a & b) / len(a | b) >= 0.8 - 1e-12


def plain_groups(texts):
    sets = [shingles(t) for t in texts]
    return plain_components(len(texts), lambda i, j: alike(sets[i], sets[j]))


def at_share(seed, n, changed):
    """A text and one with runs of its end replaced, so that both share (n - 4 - changed) of (n - 4 + changed) shingles."""
    words = prose(seed, n).split()
    return " ".join(words), " ".join(words[:n - changed] + prose(seed + 7000, changed).split())


def groups_of(spark, texts, **options):
    frame = clashing(docs_of(spark, texts))
    key = {bytes(r.k): r.doc_id for r in frame.select("doc_id", simhash.text_key(frame["text"]).alias("k")).orderBy("doc_id", ascending=False).collect()}
    label = {}
    rows = simhash.text_groups(frame, **options).collect()
    assert len(rows) == len(key)
    for r in rows:
        assert key[bytes(r.text_key)] == r.doc_id
        label.setdefault(r.group, []).append(r.doc_id)
    least = {d: min(ids) for ids in label.values() for d in ids}
    first = {}
    for i, t in enumerate(texts):
        first.setdefault(t or "", i)
    return [least[first[t or ""]] for t in texts]


@pytest.mark.parametrize("chunk", [2048, 8])
def test_groups_equal_brute_force(spark, monkeypatch, chunk):
    monkeypatch.setattr(blocks.pair_blocks, "__defaults__", (chunk,))
    base = prose(5, 80).split()
    chain = [" ".join(base[k:] + prose(900 + k, k).split()) for k in range(0, 30)]
    hot = [" ".join(w if (i * 7 + k) % 79 else "x" for i, w in enumerate(base)) for k in range(60)]
    texts = [*ODD[:7], " \n ", "a b c d e", "A B C D E", "a b c d f", *chain, *hot, *[prose(100 + k, 40) for k in range(20)], *hot[:3], None]
    assert groups_of(spark, texts) == plain_groups(texts)


def test_pairs_just_above_link_and_pairs_below_do_not(spark):
    above = [at_share(k, 204, 22) for k in range(60)]  # 178 of 222: 0.802
    below = [at_share(1000 + k, 204, 23) for k in range(60)]  # 177 of 223: 0.794
    far = [at_share(2000 + k, 204, 36) for k in range(60)]  # 164 of 236: 0.695
    texts = [t for pair in above + below + far for t in pair]
    got = groups_of(spark, texts)
    linked = [got[2 * k] == got[2 * k + 1] for k in range(180)]
    assert not any(linked[60:])
    assert sum(linked[:60]) >= 59


def test_recall_of_candidates_follows_the_number_of_texts():
    for texts in (100, 10**5, 10**9):
        layout = simhash.Layout(texts, 256, 0.8, 0.99)
        rng = np.random.default_rng(1)
        marks = rng.integers(0, 256, (2000, 32), dtype=np.uint8)
        apart = 0.1514
        other = np.packbits(np.unpackbits(marks, axis=1) ^ (rng.random((2000, 256)) < apart), axis=1)
        met = (layout.values(marks) == layout.values(other)).any(axis=1)
        assert met.mean() >= 0.98
        assert np.bitwise_count(marks ^ other).sum(axis=1).max() <= layout.distance
    assert layout.width >= 24


def test_a_text_of_its_own_stays_when_its_id_repeats(spark):
    a, b = prose(1, 50), prose(2, 50)
    rows = [(3, a), (3, b), (1, a), (3, b), (None, a), (None, a), (5, None), (4, "")]
    kept = simhash.keep_representatives(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(((r.doc_id or 0), r.text or "") for r in kept) == sorted([(1, a), (3, b), (0, a), (0, a), (4, "")])
    assert simhash.keep_representatives(docs_of(spark, [])).collect() == []


def test_representatives_of_the_given_documents(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    rows = docs.select("doc_id", "text").collect()
    sets = [shingles(r.text) for r in rows]
    holders = {}
    for i, s in enumerate(sets):
        for x in s:
            holders.setdefault(x, []).append(i)
    label = list(range(len(rows)))

    def root(i):
        while label[i] != i:
            label[i] = label[label[i]]
            i = label[i]
        return i

    links = missed = 0
    kept = {r.doc_id for r in simhash.keep_representatives(docs).select("doc_id").collect()}
    for i, s in enumerate(sets):
        near = {j for x in s for j in holders[x] if j > i} or ({j for j in range(i + 1, len(rows)) if not sets[j]} if not s else set())
        for j in near:
            if alike(s, sets[j]):
                links += 1
                missed += rows[i].doc_id in kept and rows[j].doc_id in kept
                a, b = sorted((root(i), root(j)), key=lambda k: rows[k].doc_id)
                label[b] = a
    want = {rows[i].doc_id for i in range(len(rows)) if root(i) == i}
    assert links > 50 and missed == 0
    assert len(kept ^ want) <= 0.01 * links
