"""The operators against brute force, and every case with a defined result: nulls, empty, long, repeated, clashing names."""

import hashlib
import html as html_library
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
import xxhash

from copytrail.llm import decontaminate, embeddings, graph, html, lengths, lines, pieces, quality, rans, simhash, urlfilter
from copytrail.llm.queries import byte_bpe

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = [a + b for a in ("an", "er", "thi", "on", "re", "sta", "li", "mo") for b in ("nd", "ing", "sh", "ble", "tion", "ou", "ra", "ste")]


def prose(seed: int, n: int) -> str:
    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) + rng.choice(WORDS) for _ in range(n))


def docs_of(spark, texts, start=0):
    return spark.createDataFrame([(start + i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)], DOCS)


def clashing(frame):
    """The same rows with columns named like the operators' own."""
    from pyspark.sql import functions as F

    for name in ("key", "_key", "_text_key", "_drop", "_score", "fp", "node", "component", "line", "leaf", "template", "n", "hash", "host", "slot", "vector", "part"):
        frame = frame.withColumn(name, F.lit("x"))
    return frame


ODD = [None, "", " ", "a", "a b", "É é\n\tß", "x" * 5000, prose(1, 30000)]


# 1 SimHash


def plain_fingerprint(text, words):
    parts = (text or "").encode().lower().split()
    shingles = [b" ".join(parts[i:i + words]) for i in range(max(1, len(parts) - words + 1))] if parts else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << i for i in range(64) if 2 * sum(h >> i & 1 for h in hashes) > len(hashes))


def plain_components(n, linked):
    label = list(range(n))
    for _ in range(n):
        new = [min([label[i], *[label[j] for j in range(n) if linked(i, j)]]) for i in range(n)]
        if new == label:
            return label
        label = new
    return label


def test_simhash_equals_brute_force(spark):
    base = prose(5, 60).split()
    texts = [*ODD[:7], *[" ".join(base[:k] + ["changed"] + base[k + 1:]) for k in range(30)], *[prose(100 + k, 40) for k in range(20)], "a b", None]
    got = {r.doc_id: r for r in simhash.near_duplicates(clashing(docs_of(spark, texts)), words=4, bits=64, blocks=6, agree=2, distance=4).collect()}
    marks = [plain_fingerprint(t, 4) for t in texts]
    assert [int(got[i].fingerprint, 16) for i in range(len(texts))] == marks
    assert all(len(r.fingerprint) == 16 for r in got.values())
    want = plain_components(len(texts), lambda i, j: (marks[i] ^ marks[j]).bit_count() <= 4)
    assert [got[i].component_id for i in range(len(texts))] == want


def test_simhash_of_a_very_long_text(spark):
    got = simhash.near_duplicates(docs_of(spark, [ODD[-1]]), words=4, bits=64, blocks=6, agree=2, distance=4).first()
    assert int(got.fingerprint, 16) == plain_fingerprint(ODD[-1], 4)


def test_simhash_rows_without_id_and_repeated_rows(spark):
    rows = [(None, "a b c d"), (3, "a b c d"), (3, "a b c d"), (1, "a b c d")]
    got = simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), words=4, bits=64, blocks=6, agree=2, distance=4).collect()
    assert sorted((r.doc_id or 0, r.component_id) for r in got) == [(0, None), (1, 1), (3, 1), (3, 1)]
    kept = simhash.keep_representatives(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(r.doc_id or 0 for r in kept) == [0, 1]
    assert simhash.keep_representatives(docs_of(spark, [])).collect() == []


def test_pipeline_stage_keeps_one_of_each_group_of_near_copies(spark):
    base = [prose(k, 200).split() for k in range(12)]
    copies = [" ".join(w if i % 97 else "other" for i, w in enumerate(b)) for b in base for _ in range(2)]
    frame = docs_of(spark, [" ".join(b) for b in base] + copies)
    assert sorted(r.doc_id for r in simhash.keep_representatives(frame).collect()) == list(range(12))


def test_blocks_of_a_hot_key_meet_every_pair(spark, monkeypatch):
    from copytrail.llm import blocks

    monkeypatch.setattr(blocks.pair_blocks, "__defaults__", (8,))
    rng = random.Random(3)
    center = rng.getrandbits(64)
    marks = [center ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 3))) for _ in range(60)]
    frame = spark.createDataFrame([(i, m.to_bytes(8)) for i, m in enumerate(marks)], "node long, fp binary")
    links = simhash.near_links(simhash.block_keys(frame, 64, 6, 2), 64, 4)
    got = {r.node: r.component for r in graph.components(links).collect()}
    want = plain_components(60, lambda i, j: (marks[i] ^ marks[j]).bit_count() <= 4)
    assert [got.get(i, i) for i in range(60)] == want


def test_components_of_chains_and_stars(spark):
    chain = [(i, i + 1) for i in range(40)] + [(100, k) for k in range(101, 140)] + [(7, 7), (200, 201), (201, 200)]
    got = {r.node: r.component for r in graph.components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {k: 100 for k in range(100, 140)} | {200: 200, 201: 200}
    assert graph.components(spark.createDataFrame([], "a long, b long")).collect() == []


# 2 decontamination


def plain_overlap(text, item):
    cut = lambda s: re.sub(r"[\W_]+", " ", s.lower()).split()
    t, b = cut(text or ""), cut(item or "")
    width = min(len(b), decontaminate.WINDOW)
    if len(b) < decontaminate.MIN_TOKENS:
        return 0.0
    return max((sum(0 <= s + j < len(t) and t[s + j] == b[j] for j in range(at, at + width)) / width
                for s in range(-len(b), len(t)) for at in range(len(b) - width + 1)), default=0.0)


def test_decontamination_equals_brute_force(spark):
    items = [prose(900 + k, 10 + 4 * k) for k in range(8)] + ["too short", None, ""]
    swap = lambda s, step: " ".join("swapped" if i % step == step - 1 else w for i, w in enumerate(s.split()))
    texts = [None, "", "word", *[f"{prose(k, 20)} {items[k % 8]} {prose(50 + k, 20)}" for k in range(8)],
             *[f"{prose(k, 20)} {swap(items[k], 6)}" for k in range(8)], *[f"{swap(items[k], 3)} tail" for k in range(8)], items[4].upper().replace(" ", ",\n"), prose(77, 300)]
    benchmark = spark.createDataFrame([*[(k, t) for k, t in enumerate(items)], (0, items[0])], "item_id long, text string")
    docs = clashing(docs_of(spark, texts))
    got = {(r.doc_id, r.item_id): r.similarity for r in decontaminate.contaminated(docs, benchmark).collect()}
    scores = {(i, k): plain_overlap(t, b) for i, t in enumerate(texts) for k, b in enumerate(items)}
    want = {pair: s for pair, s in scores.items() if s >= 0.8}
    assert got == pytest.approx(want)
    clean = decontaminate.clean(docs, benchmark)
    assert clean.columns == docs.columns
    assert sorted(r.doc_id for r in clean.collect()) == sorted(set(range(len(texts))) - {i for i, _ in want})


def test_masks_meet_every_pattern_of_short_items(spark):
    from itertools import combinations

    masks = [(len(m), sum(1 << i for i, c in enumerate(m) if c == "1")) for m in decontaminate.MASKS + decontaminate.SHORT_MASKS]
    for n in range(decontaminate.MIN_TOKENS, decontaminate.WINDOW):
        for swapped in combinations(range(n), n // 5):
            equal = (1 << n) - 1 - sum(1 << i for i in swapped)
            assert any(equal >> p & m == m for k, m in masks for p in range(n - k + 1)), (n, swapped)
    words = prose(950, 15).split()
    docs = docs_of(spark, [" ".join("swapped" if i % 4 == 3 else w for i, w in enumerate(words))])
    found = decontaminate.contaminated(docs, spark.createDataFrame([(1, " ".join(words))], "item_id long, text string")).collect()
    assert [(r.item_id, r.matched, r.length) for r in found] == [(1, 12, 15)]


def test_decontamination_with_empty_tables(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    docs = docs_of(spark, ["a b c", None])
    assert decontaminate.contaminated(docs, none).collect() == []
    assert decontaminate.clean(docs, none).count() == 2
    assert decontaminate.clean(docs_of(spark, []), none).collect() == []


def test_decontamination_plan_has_no_python(spark):
    benchmark = spark.createDataFrame([(1, "x")], "item_id long, text string")
    plan = decontaminate.contaminated(docs_of(spark, ["a"]), benchmark)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow|Cartesian|NestedLoop", plan)


# 3 quality


def test_machine_equals_the_double_sum():
    rng = np.random.default_rng(1)
    model = quality.Machine(0.3, rng.normal(size=quality.DIMENSIONS), rng.normal(0, 0.3, (quality.DIMENSIONS, 4)))
    rows = [quality.features(t) for t in ("some words here", "", None, prose(3, 50))]
    for score, (at, x) in zip(model.scores(rows), rows, strict=True):
        z = model.bias + (model.linear[at] * x).sum() + sum(model.factors[at[i]] @ model.factors[at[j]] * x[i] * x[j] for i in range(len(at)) for j in range(i))
        assert score == pytest.approx(1 / (1 + np.exp(-z)))


def test_quality_learns_and_keeps_columns(spark):
    bad = [" ".join(w + random.Random(k).choice(["###", "$$$", "%%%"]) for w in prose(k, 60).split()) for k in range(60)]
    frame = clashing(docs_of(spark, [prose(200 + k, 60) for k in range(120)] + bad + [None, ""]))
    labels = spark.createDataFrame([*[(i, 1, 0) for i in range(120)], *[(120 + i, 0, 0) for i in range(60)], (None, 1, 0), (5, None, None), (999, 0, 0)],
                                   "doc_id long, quality int, toxic int")
    rows = {r.doc_id: r for r in quality.judge(frame, labels).collect()}
    assert len(rows) == 182 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows.values())
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in rows.items())
    held = [i for i, r in rows.items() if r.held_out and i < 180]
    assert np.mean([rows[i].predicted == (i < 120) for i in held]) > 0.95
    kept = quality.keep_good(frame, labels)
    assert kept.columns == frame.columns and {r.doc_id for r in kept.collect()} == {i for i, r in rows.items() if r.predicted}


def test_quality_without_labels_rejects_nothing(spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert quality.keep_good(docs_of(spark, ["a", None]), none).count() == 2
    assert quality.judge(docs_of(spark, []), none).collect() == []


# 4 URL filter


def test_cascade_is_exact_over_its_universe(spark):
    from pyspark.sql import functions as F

    universe = spark.range(3000).select(F.concat(F.lit("k"), "id").alias("key"))
    listed = universe.filter("key like '%7'").unionByName(spark.createDataFrame([("not there",), ("k7",), (None,)], "key string"))
    cascade = urlfilter.build_cascade(listed, universe)
    keys = universe.select("key", F.xxhash64("key").alias("h")).collect()
    found = cascade.holds(np.array([r.h for r in keys], dtype=np.int64).view(np.uint64))
    assert [r.key.endswith("7") for r in keys] == found.tolist()
    assert len(cascade.levels) > 1
    empty = urlfilter.build_cascade(listed.limit(0), universe)
    assert not empty.holds(np.arange(10, dtype=np.uint64)).any()


def test_urls_by_rules(spark):
    rules = [("net/", 1, "block"), ("example.net/en/", 4, "allow"), ("example.com/de/", 4, "block"), ("org/fr/", 4, "allow")]
    urls = ["http://A.example.NET/en/x?q", "http://a.example.net/de/", "https://example.com/de/1#x", "https://notexample.com/de/1", "http://x.org/fr/", "http://x.org/en/",
            "no scheme", None, "http://net", "http://net/", "http://planet/", "x://y://z.net/a", "http://b.net?x=/", "http://éxample.net/en/a"]
    frame = clashing(spark.createDataFrame([(i, u) for i, u in enumerate(urls)] + [(0, urls[0])], "page_id long, url string"))
    got = {r.page_id: r for r in urlfilter.judge(frame, spark.createDataFrame(rules, "key string, path_length int, verdict string")).collect()}
    for i, url in enumerate(urls):
        m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
        host, path = (m[1].translate({c: c + 32 for c in range(65, 91)}), m[2]) if m else ("", "")
        fits = [(len(k), k, v) for k, n, v in rules if (host == k[:-n] or host.endswith("." + k[:-n])) and path.startswith(k[-n:])]
        want = max(fits) if fits else (0, None, "allow")
        assert (got[i].host, got[i].path, got[i].rule, got[i].verdict) == (host, path, *want[1:]), url
    none = urlfilter.judge(frame, spark.createDataFrame([], "key string, path_length int, verdict string"))
    assert {(r.rule, r.verdict) for r in none.collect()} == {(None, "allow")}
    assert urlfilter.judge(frame.limit(0), spark.createDataFrame(rules, "key string, path_length int, verdict string")).collect() == []


# 5 embeddings


def test_embedding_links_equal_brute_force(spark, monkeypatch):
    from copytrail.llm import blocks

    monkeypatch.setattr(blocks.pair_blocks, "__defaults__", (16,))
    rng = np.random.default_rng(4)
    centers = rng.normal(size=(6, 32))
    rows = [(i, (centers[i % 6] + rng.normal(0, 0.16, 32)).tolist()) for i in range(150)]
    rows += [(200 + i, rows[3][1]) for i in range(5)] + [(300, None), (301, [0.0] * 32), (302, [1.0, None] * 16), (303, [float("nan")] * 32), (304, [float("inf")] * 32), (305, []), (306, [1.0, 2.0])]
    frame = spark.createDataFrame(rows + [(None, rows[3][1])], "vec_id long, embedding array<float>")
    got = {r.vec_id: r for r in embeddings.near_duplicates(clashing(frame)).collect()}
    sound = [(i, np.array(v, dtype=np.float32).astype(float)) for i, v in rows[:155]]
    unit = np.array([v / np.linalg.norm(v) for _, v in sound])
    near = unit @ unit.T >= 0.95
    np.fill_diagonal(near, False)
    ids = [i for i, _ in sound]
    missed = sum(int(near[a].sum()) - got[i].n_links for a, i in enumerate(ids))
    assert 0 <= missed <= 0.01 * near.sum() and near.sum() > 500
    want = plain_components(len(ids), lambda a, b: near[a, b])
    assert [got[i].component_id for i in ids] == [ids[w] for w in want]
    assert all((got[i].n_links, got[i].component_id, got[i].kept) == (0, i, True) for i in range(300, 307))
    assert (got[None].n_links, got[None].component_id, got[None].kept) == (0, None, False)
    assert embeddings.near_duplicates(frame.limit(0)).collect() == []


# 6 lines


def test_recurring_lines_go_and_copies_stay(spark):
    texts = [f"{prose(k, 30)}\nAccept all 12{k} cookies to go on reading here\n\n{prose(500 + k, 40)}" for k in range(14)]
    copy = "\n".join(prose(700 + k, 12) for k in range(8))
    near = ["\n".join(" ".join("changed" if (i + k) % 11 == 0 else w for i, w in enumerate(line.split())) for line in copy.split("\n")) for k in range(14)]
    frame = clashing(docs_of(spark, texts + near + [copy] * 3 + [None, "", "\n\n", texts[0]]))
    got = {r.doc_id: r for r in lines.drop_recurring(frame).collect()}
    for i in range(14):
        assert got[i].text == f"{prose(i, 30)}\n\n{prose(500 + i, 40)}" and got[i].n_dropped == 1 and got[i].n_chars == len(got[i].text)
    assert [got[i].text for i in range(14, 34)] == near + [copy] * 3 + [None, "", "\n\n"] and got[34].text == got[0].text
    assert lines.drop_recurring(frame, count=None).columns == frame.columns
    assert lines.drop_recurring(docs_of(spark, [])).collect() == []


def test_a_template_generalises_fields_that_differ(spark):
    from pyspark.sql import functions as F

    texts = [f"read the full story by {name} in today s print edition" for name in ("anna", "bert", "carl")] + ["read the full page", "x " * 300 + "end"]
    frame = spark.createDataFrame([(1, i, t, 1) for i, t in enumerate(texts)], "leaf long, line_key long, line string, n long")
    frame = frame.withColumn("leaf", F.length(F.regexp_replace("line", "[^ ]", ""))).withColumn("slots", lines.slots(F.col("line")))
    got = {r.line_key: r.template for r in lines.templates(frame).collect()}
    assert got[0] == got[1] == got[2] and len({got[0], got[3], got[4]}) == 3


def test_boilerplate_of_short_texts_recurs(spark):
    head, foot = prose(801, 20), prose(802, 20)
    frame = docs_of(spark, [f"{head}\n{prose(820 + k, 12)}\n{foot}" for k in range(14)])
    assert [r.text for r in lines.drop_recurring(frame).orderBy("doc_id").collect()] == [prose(820 + k, 12) for k in range(14)]


def test_copies_with_lines_that_left_their_template_count_once(spark):
    copy = [prose(840 + k, 30) for k in range(6)]
    texts = ["\n".join("added " + line if i in (k % 6, (k // 3) % 6) else line for i, line in enumerate(copy)) for k in range(18)]
    assert [r.text for r in lines.drop_recurring(docs_of(spark, texts)).orderBy("doc_id").collect()] == texts


def test_long_passages_recur_from_two_different_texts_on(spark):
    passage = prose(860, 60)
    texts = [f"{prose(870 + k, 80)}\n{passage}" for k in range(2)] + [f"{prose(880 + k, 80)}\n{prose(861, 40)}" for k in range(2)]
    whole = [prose(890 + k, 60) for k in range(4)]
    copies = ["\n".join("added " + line if i == k else line for i, line in enumerate(whole)) for k in range(3)] + ["\n".join(whole)]
    got = [r.text for r in lines.drop_recurring(docs_of(spark, texts + copies + [prose(895, 60) + " a", prose(895, 60) + " b"])).orderBy("doc_id").collect()]
    assert got == [prose(870, 80), prose(871, 80), *texts[2:], *copies, prose(895, 60) + " a", prose(895, 60) + " b"]


def test_all_tokens_of_long_lines_are_compared(spark):
    base = prose(900, 400).split()
    varied = [" ".join(w if i < 3 or random.Random(1000 * k + i).random() > 0.15 else "other" + "x" * k for i, w in enumerate(base)) for k in range(12)]
    spaced = ["a b c d  e f", "a b c d e f g"]
    frame = docs_of(spark, [f"{prose(910 + k, 420)}\n{line}" for k, line in enumerate(varied)] + [f"{prose(930 + k, 40)}\n{spaced[k % 2]}" for k in range(20)])
    got = [r.n_dropped for r in lines.drop_recurring(frame).orderBy("doc_id").collect()]
    assert got == [1] * 32


# 7 lengths


def test_length_answers_equal_direct_sums(spark):
    texts = [prose(k, random.Random(k).randint(0, 900)) for k in range(40)] + [None, "", "one", prose(9, 4000)]
    counts = lengths.counted(clashing(docs_of(spark, texts)), byte_bpe)
    n = np.array([len(x) for x in byte_bpe(texts)])
    assert sorted(r.n_tokens for r in counts.collect()) == sorted(n.tolist())
    suffixes = lengths.limits(lengths.histogram(counts))
    for r in suffixes.collect():
        assert (r.n_docs, r.docs_at_least, r.tokens_at_least, r.truncated_total, r.total_docs, r.total_tokens) == (
            (n == r.n_tokens).sum(), (n >= r.n_tokens).sum(), n[n >= r.n_tokens].sum(), np.minimum(n, r.n_tokens).sum(), len(n), n.sum())
    for limit in (0, 1, 100, 1024, 10**6):
        a = lengths.answer(suffixes, limit).first()
        assert (a.kept_tokens, a.cut_docs) == (np.minimum(n, limit).sum(), (n > limit).sum())
    for share in (0.01, 0.5, 0.99, 1.0):
        assert lengths.quantile(suffixes, share).first().n_tokens == next(v for v in sorted(n) if (n <= v).mean() >= share)
    none = lengths.limits(lengths.histogram(lengths.counted(docs_of(spark, []), byte_bpe)))
    assert none.collect() == [] and tuple(lengths.answer(none, 5).first()) == (5, 0, 0)


# 8 HTML


def page(title, blocks, extra="", tail=""):
    body = "".join(f"<p>{b}</p>" for b in blocks)
    return (f"<!DOCTYPE html><html><head><title>{title}</title><style>p{{}}</style><script>var t='</p>';</script></head><body><nav><ul><li>Home</li></ul></nav>"
            f"<div class='ad'>Buy</div>{extra}<article><h1>{title}</h1>{body}</article><footer>end</footer>{tail}")


def test_main_text_of_pages(spark):
    pages = [(i, f"http://h{i % 3}.org/{i}", page(f"T{i} &amp; co", [f"one  {i}<br>two", "<b>bold</b> &lt;x&gt; &#233;", ""])) for i in range(30)]
    pages += [(40, None, None), (41, "http://h0.org/x", ""), (42, "http://solo.org/", page("S", ["<b>open <i>tags", "x"], tail="<div id=comments><p>nice</p></div>")),
              (43, "http://solo2.org/", "<html><body><div class='sidebar'><p>menu menu menu</p></div><div id='content'><p>The text itself is here</p><form>mail</form></div></body>"),
              (44, "http://h1.org/", "plain < text"), (45, "http://h1.org/z", page("R", ["kept"]).replace("</article>", "<section class='reader-comments'><p>bad</p></section></article>")),
              (0, pages[0][1], pages[0][2])]
    got = {r.page_id: r for r in html.main_text(clashing(spark.createDataFrame(pages, "page_id long, url string, html string"))).collect()}
    for i in range(30):
        assert got[i].text == f"T{i} & co\none {i} two\nbold <x> é" and got[i].n_chars == len(got[i].text)
    assert [got[i].text for i in range(40, 46)] == ["", "", "S\nopen tags\nx", "The text itself is here", "plain < text", "R\nkept"]
    assert got[40].n_chars == 0 and html_library.unescape("&eacute;") == "é"
    assert html.main_text(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []


def test_a_host_without_semantic_tags_has_its_slot_deduced(spark):
    pages = [(i, f"http://old.org/{i}", f"<html><body><table class=x><tr><td>Top</td></tr></table><div class=b1><p>{prose(i, 40)}</p></div><div class=b2><p>About us</p></div></body></html>") for i in range(8)]
    got = html.main_text(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()
    assert all(r.text == prose(r.page_id, 40) for r in got)


# 9 SentencePiece

PIECES = public_tokenizers.path("piece_bpe_32k.model")


def odd_texts():
    rng = random.Random(6)
    letters = "abtheingon ▁\né日"
    return [*ODD, "  a  b\n c▁d", "▁", "   ", "a" * 3000, "ab" * 2000, "日本語テキスト" * 20, "😀 emoji \t tab\r\n x\u0000y", " lead", "trail  ", "<0x0A> <s> </s> <unk>",
            "<|endoftext|>", "a <|endoftext|> b", *["".join(rng.choice(letters) for _ in range(rng.randint(1, 60))) for _ in range(600)]]


def test_pieces_equal_the_library(spark):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    texts = odd_texts()
    got = {r.doc_id: r for r in pieces.round_trip(clashing(docs_of(spark, texts)), PIECES).collect()}
    for i, text in enumerate(texts):
        ids = library.encode(text or "")
        want = (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(library.decode(ids).encode()).hexdigest())
        assert (got[i].n_tokens, got[i].ids_sha256, got[i].decoded_sha256) == want, text
    assert pieces.round_trip(docs_of(spark, []), PIECES).collect() == []


def test_pieces_as_rows_and_back(spark):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    texts = odd_texts()[:40]
    rows = pieces.encode(docs_of(spark, texts), PIECES)
    assert {r.doc_id: r.ids for r in rows.collect()} == {i: library.encode(t or "") for i, t in enumerate(texts)}
    assert {r.doc_id: r.text for r in pieces.decode(rows, PIECES).collect()} == {i: library.decode(library.encode(t or "")) for i, t in enumerate(texts)}


# 10 token files


def test_byte_bpe_equals_the_library():
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = odd_texts()
    assert [x.tolist() for x in byte_bpe(texts)] == [library.encode(t or "", add_special_tokens=False).ids for t in texts]


@pytest.mark.parametrize("n", [1, 5, rans.LANES, rans.SECTION - 1, rans.SECTION, rans.SECTION + 1, 3 * rans.SECTION + 77])
def test_coder_round_trip(n):
    ids = np.random.default_rng(n).zipf(1.3, n) % 50000
    table = rans.Frequencies.of(dict(zip(*[x.tolist() for x in np.unique(ids, return_counts=True)], strict=True)))
    assert table.freq.sum() == 1 << table.bits and table.freq.min() >= 1
    coder = rans.Coder(table)
    block = coder.encode(ids.astype(np.uint32))
    assert (coder.decode(block) == ids).all()
    first = n // rans.SECTION
    assert (coder.decode(block, first) == ids[first * rans.SECTION:]).all()
    with pytest.raises(ValueError):
        coder.decode(block[:-1] + bytes([block[-1] ^ 1]))


def test_token_files_round_trip(spark):
    texts = [*ODD, *[prose(k, 300) for k in range(30)]]
    frame = clashing(docs_of(spark, texts)).repartition(3)
    got = sorted(rans.digests(frame, rans.new_folder(spark), byte_bpe, 0).collect())
    start, want = 0, []
    for i, ids in enumerate(byte_bpe(texts)):
        ids = np.append(ids, 0).astype("<u4")
        want.append((i, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert [tuple(r) for r in got] == want


def test_token_files_of_empty_and_repeated_rows(spark):
    assert rans.digests(docs_of(spark, []), rans.new_folder(spark), byte_bpe, 0).collect() == []
    rows = spark.createDataFrame([(2, "b"), (2, "a a"), (None, "c"), (2, "b")], "doc_id long, text string")
    got = rans.digests(rows, rans.new_folder(spark), byte_bpe, 0).orderBy("start").collect()
    assert [(r.doc_id, r.start, r.n_tokens) for r in got] == [(None, 0, 2), (2, 2, 3), (2, 5, 2), (2, 7, 2)]
