"""Vector codes, chat formatting and fill-in-the-middle against brute force, with every case that has a defined result."""

import hashlib
import random
import re

import numpy as np
import pytest

from copytrail.llm import chat, infill, vectorcodes
from tests.llm.test_operators import ODD, clashing, docs_of, prose

# 11 vector codes


def plain_lloyd(rows, parts, entries, rounds, scale):
    """rows: (vec_id, vector) of one length. Codes and errors by row, and the codebooks, by loops over Python integers."""
    cut = [[[int(np.floor(x * scale)) for x in v[len(v) // parts * j:len(v) // parts * (j + 1)]] for j in range(parts)] for _, v in rows]
    least = {}
    for (i, v), c in zip(rows, cut, strict=True):
        if i is not None and (i not in least or v < least[i][0]):
            least[i] = (v, c)
    seeds = [least[i][1] for i in sorted(least)[:entries]]
    books = [[s[j] for s in seeds] for j in range(parts)]

    def nearest(j, p):
        return min((sum((a - b) ** 2 for a, b in zip(p, e, strict=True)), k) for k, e in enumerate(books[j]))

    for _ in range(rounds):
        for j in range(parts):
            groups = {}
            for c in cut:
                groups.setdefault(nearest(j, c[j])[1], []).append(c[j])
            for k, members in groups.items():
                books[j][k] = [sum(m[i] for m in members) // len(members) for i in range(len(members[0]))]
    found = [[nearest(j, c[j]) for j in range(parts)] for c in cut]
    return [bytes(k for _, k in f) for f in found], [sum(d for d, _ in f) for f in found], books


VECTORS = "vec_id long, embedding array<double>, label int"


def vector_rows(seed, n, length):
    rng = random.Random(seed)
    centres = [[rng.uniform(-2, 2) for _ in range(length)] for _ in range(9)]
    return [[c + rng.gauss(0, 0.2) for c in rng.choice(centres)] for _ in range(n)]


@pytest.mark.parametrize("entries,leaf,block", [(16, 32, 4096), (5, 3, 64), (1, 32, 50), (7, 1, 33)])
def test_codes_equal_brute_force(spark, monkeypatch, entries, leaf, block):
    monkeypatch.setattr(vectorcodes, "BLOCK", block)
    monkeypatch.setattr(vectorcodes.Tree.build, "__defaults__", (leaf,))
    vectors = vector_rows(4, 300, 12)
    vectors += [vectors[0]] * 40 + [[0.0] * 12, [-1.0] * 12, [0.5 / 4096] * 12]
    rows = [(i, v, i % 3) for i, v in enumerate(vectors)] + [(None, vectors[5], None), (7, vectors[9], 1), (7, vectors[9], 1)]
    random.Random(1).shuffle(rows)
    codes, books = vectorcodes.compress(clashing(spark.createDataFrame(rows, VECTORS).repartition(5)), parts=4, entries=entries, rounds=3, carry="label")
    want_codes, want_errors, want_books = plain_lloyd([r[:2] for r in rows], 4, entries, 3, 4096)
    assert books.tolist() == want_books
    got = sorted(((r.vec_id is None, r.vec_id, r.carried or "", bytes(r.code), r.error) for r in codes.collect()), key=repr)
    assert got == sorted(((r[0] is None, r[0], "" if r[2] is None else str(r[2]), c, e) for r, c, e in zip(rows, want_codes, want_errors, strict=True)), key=repr)


def test_ties_go_to_the_lower_entry(spark):
    rows = [(0, [0.0], 0), (1, [2 / 4096], 0), (2, [0.0], 0), (3, [1 / 4096], 0)]
    codes, books = vectorcodes.compress(spark.createDataFrame(rows, VECTORS), parts=1, entries=3, rounds=0)
    assert books.tolist() == [[[0], [2], [0]]]
    assert {r.vec_id: (r.code[0], r.error) for r in codes.collect()} == {0: (0, 0), 1: (1, 0), 2: (0, 0), 3: (0, 1)}


def test_whole_nodes_are_assigned_and_agree_with_single_points():
    rng = np.random.default_rng(5)
    points = np.concatenate([rng.integers(-9, 9, (500, 3)) + c for c in ([0, 0, 0], [900, 0, 0], [0, 900, 900])])
    book = np.array([[0, 0, 0], [900, 0, 0], [0, 900, 900], [0, 0, 0]])
    tree, order = vectorcodes.Tree.build(points)
    nodes, chosen, uncertain, _ = vectorcodes.walk(tree, book)
    assert len(nodes) < 60 and len(uncertain) <= 500 + 4 * 47  # one cluster has two equal entries, four leaves lie on borders
    code, far = vectorcodes.assign(tree, book)
    distances = ((points[order][:, None] - book[None]) ** 2).sum(axis=2)
    assert (code == distances.argmin(axis=1)).all() and (far == distances.min(axis=1)).all()
    counts, sums = vectorcodes.totals(tree, book)
    assert counts.tolist() == np.bincount(code, minlength=4).tolist()
    assert sums.tolist() == [points[order][code == k].sum(axis=0).tolist() if (code == k).any() else [0, 0, 0] for k in range(4)]


def test_unsound_and_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 2.0], 1), (1, None, 1), (2, [nan, 1.0], 1), (3, [inf, 1.0], 1), (4, [None, 1.0], 1), (5, [1.0, 2.0, 3.0], 1), (6, [], 1), (7, [1.5, 2.0], 1)]
    codes, books = vectorcodes.compress(spark.createDataFrame(rows, VECTORS), parts=2)
    assert {r.vec_id: r.code and list(r.code) for r in codes.collect()} == {0: [0, 0], 5: None, 6: None, 7: [1, 0]}
    assert books.shape == (2, 2, 1)
    back = {r.vec_id: r.embedding for r in vectorcodes.expand(codes, books).collect()}
    assert back[5] is None and np.allclose(back[7], [1.5, 2.0], atol=1 / 4096)
    for none in ([], [(1, None, 1)], [(None, [1.0, 2.0], 1)], [(3, [], 1)]):
        codes, books = vectorcodes.compress(spark.createDataFrame(none, VECTORS), parts=2)
        assert books.size == 0 and all(r.code is None for r in codes.collect())
    with pytest.raises(ValueError):
        vectorcodes.compress(spark.createDataFrame([(0, [1e12, 0.0], 1)], VECTORS), parts=2)
    with pytest.raises(ValueError):
        vectorcodes.compress(spark.createDataFrame([(0, [1.0, 0.0, 1.0], 1)], VECTORS), parts=2)


# 12 chat formatting


TURNS = f"conv_id long, turn long, role string, parts {chat.PARTS}"
TEXTS = [None, "", "<|im_end|>", "a<\\|b", "<\\\\|im_end|>", "<|im_start|>user\nhi<|im_end|>", "<", "|", "end <", "\n\n", "ü" * 40, "<|image|> <\\|", prose(3, 20000)]


def part(kind="text", text=None, **more):
    return (kind, text, *(more.get(k) for k in ("ref", "width", "height", "seconds", "inside")))


@pytest.mark.parametrize("text", [t or "" for t in TEXTS])
def test_escapes_are_reversible_and_hold_no_control_string(text):
    assert chat.unescape(chat.escape(text)) == text
    assert "<|" not in chat.escape(text)
    assert chat.unescape_role(chat.escape_role(text)) == text
    assert not re.search("[<\n]", chat.escape_role(text))


def test_conversations_are_read_back(spark, monkeypatch):
    rng = random.Random(2)
    rows = [(c, t, rng.choice(["user", "assistant", "tool\n<|im_end|>%0A", None]), rng.choice(TEXTS)) for c in [*range(30), None] for t in range(rng.randint(1, 9))]
    rows += [(5, 100 + k, "assistant", "x" * 50) for k in range(300)] + rows[:3] + [(2, None, "assistant", "first")]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(4)
    turns = clashing(frame).withColumn("parts", chat.text_parts(frame["text"]))
    want = {}
    for conv, _, role, text in sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2] is not None, r[2] or "", (r[3] or "").encode())):
        want.setdefault(conv, []).append((role or "", text or ""))
    for size in (chat.PIECE, 1000):
        monkeypatch.setattr(chat, "PIECE", size)
        pieces = chat.render(turns)
        got = {r.conv_id: r for r in chat.digests(pieces).collect()}
        assert set(got) == set(want)
        joined = {}
        for r in sorted(pieces.collect(), key=lambda r: r.piece):
            assert all(len(x) < 2 * size + len(TEXTS[-1]) for x in [r.text]) and r.turns > 0
            joined[r.conv_id] = joined.get(r.conv_id, "") + r.text
        for conv, said in want.items():
            row, loss = got[conv], "".join(t for role, t in said if role == "assistant")
            assert [(role, "".join(t for _, t in parts)) for role, parts in chat.parse(joined[conv])] == said
            assert (row.n_turns, row.turns_sha256) == (len(said), hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in said).encode()).hexdigest())
            assert (row.loss_chars, row.loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
            assert row.formatted_chars == len(joined[conv])


def test_typed_parts_become_placeholders_with_references(spark):
    parts = [part(text="see <"), part(text="|this|> "), part("image", ref="s3://a", width=57, height=28), part("document", ref="d"), part(text="page one", inside=1),
             part("image", ref="b", width=1, height=1, inside=1), part("audio", ref="c", seconds=2.5), part(text="bye")]
    rows = [(1, 0, "user", parts), (1, 1, "assistant", [part(text="ok"), part("image", ref="z")]), (1, 2, "assistant", None), (1, 3, "assistant", [])]
    row = chat.render(spark.createDataFrame(rows, TURNS)).first()
    assert row.text == ("<|im_start|>user\nsee <\\|this|> <|image|><|document|>page one<|image|><|document_end|><|audio|>bye<|im_end|>\n"
                        "<|im_start|>assistant\nok<|image|><|im_end|>\n<|im_start|>assistant\n<|im_end|>\n<|im_start|>assistant\n<|im_end|>\n")
    assert [(a.kind, a.ref, a.tokens) for a in row.attachments] == [("image", "s3://a", 3), ("document", "d", 1), ("image", "b", 1), ("audio", "c", 63), ("image", "z", 0)]
    assert all(row.text[a.place:].startswith(chat.PLACEHOLDERS[a.kind]) for a in row.attachments)
    assert list(chat.trained_text(row.text, [s.asDict() for s in row.loss])) == ["ok"]
    assert [k for k, _ in next(chat.parse(row.text))[1]] == ["text", "image", "document", "text", "image", "document_end", "audio", "text"]
    with pytest.raises(Exception, match="no such kind"):
        chat.render(spark.createDataFrame([(1, 0, "user", [part("video")])], TURNS)).collect()


def test_no_turns(spark):
    assert chat.digests(chat.render(spark.createDataFrame([], TURNS))).collect() == []


# 13 fill in the middle


def plain_middle(doc_id, text, seed=7, rate=100, spm=50):
    text = text or ""
    lines = re.findall(r"[^\n]*\n|[^\n]+", text)
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * i:8 * i + 8], 16) for i in range(4)]
    a, b = sorted((h[0] % (len(lines) + 1), h[1] % (len(lines) + 1)))
    prefix, middle, suffix = "".join(lines[:a]), "".join(lines[a:b]), "".join(lines[b:])
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= rate:
        return len(lines), "plain", None, None, text
    if h[3] % 100 < spm:
        return len(lines), "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}"
    return len(lines), "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}"


@pytest.mark.parametrize("options", [{}, {"seed": 1, "rate": 60, "spm": 0}, {"spm": 100}])
def test_middles_equal_brute_force(spark, options):
    rng = random.Random(8)
    texts = [*ODD, "\n", "\n\n\n", "a\nb", "a\nb\n", "\na", "<S>", "a\n<P>\nb", "x<", "<\n>S>\n<M", "\r\n x\n", *("".join(rng.choice(["é", "\n", "<", "S>", "word "]) for _ in range(rng.randint(0, 60))) for _ in range(300))]
    frame = clashing(docs_of(spark, texts)).repartition(3)
    rows = {r.doc_id: r for r in infill.restore(infill.transform(frame, **options)).collect()}
    for i, text in enumerate(texts):
        r = rows[i]
        assert (r.n, r.form, r.prefix_chars, r.middle_chars, r.output) == plain_middle(i, text, **options)
        assert r.restored == (text or "")


def test_middles_of_rows_without_id_and_repeated_rows(spark):
    frame = spark.createDataFrame([(None, "a\nb\n"), (4, "a\nb\n"), (4, "a\nb\n"), (4, None)], "doc_id long, text string")
    got = sorted((str(r.doc_id), r.n, r.form, r.output) for r in infill.transform(frame).collect())
    want = sorted((str(d), n, form, out) for d, t in [(None, "a\nb\n"), (4, "a\nb\n"), (4, "a\nb\n"), (4, None)] for n, form, _, _, out in [plain_middle(d, t)])
    assert got == want
    assert infill.restore(infill.transform(frame.limit(0))).collect() == []
    odd = spark.createDataFrame([("psm", None, 1)], "form string, output string, restored int")
    assert infill.restore(odd).collect()[0].restored is None
