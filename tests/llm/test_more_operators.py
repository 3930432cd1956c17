"""Token alignment, contextual extraction and whitening against plain versions; long, odd and hot input of the others."""

import collections
import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from eventalpha.llm import chat_format as C
from eventalpha.llm import decontamination as D
from eventalpha.llm import personal_data as P
from eventalpha.llm import secrets as SS
from eventalpha.llm import token_alignment as T
from eventalpha.llm import whitening as W

from .conftest import prose

# --- 5: groups without an indexed word, short items ---

BENCH = [(1, "what stands at the far end of the stone pier in winter? an old red lantern with nine sides"), (2, "Paris"), (3, "a b c d")]


@pytest.fixture(scope="module")
def bench(spark):
    return spark.createDataFrame(BENCH, "item_id long, text string")


@pytest.mark.parametrize("texts", [
    ["всё это написано на другом языке и ничего общего не имеет"], ["x" + str(i) for i in range(3)], [" ".join(f"q{i}" for i in range(5000))],
    ["..., !!!"], ["слово " * 400, f"before {BENCH[0][1]} after", "Paris is a word"],
])
def test_documents_without_a_word_of_the_benchmark(spark, bench, texts):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(len(texts), "doc_id")
    got = {(r.doc_id, r.item_id) for r in D.leaked_items(docs, bench).collect()}
    assert got == {(i, 1) for i, t in enumerate(texts) if BENCH[0][1] in t}


def test_pipeline_stage_on_another_language(spark, bench, tmp_path):
    pipeline = pytest.importorskip("corpus_pipeline")
    bench.write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.createDataFrame([(1, "ни одного общего слова", "ru", "h", 22), (2, f"so {BENCH[0][1]}", "en", "h", 9), (3, "Paris in spring", "en", "h", 15)], "doc_id long, text string, lang string, source string, n_chars long").repartition(3, "doc_id")
    assert sorted(r.doc_id for r in pipeline.decontaminate(spark, docs, str(tmp_path)).collect()) == [1, 3]


def test_items_shorter_than_a_shingle_can_be_asked_for(spark, bench):
    docs = spark.createDataFrame([(1, "off to Paris")], "doc_id long, text string")
    assert [r.item_id for r in D.leaked_items(docs, bench, least=1).collect()] == [2]


# --- 7: a turn over many stretches ---


@pytest.mark.parametrize("history", [0, 30, 90])
def test_a_long_turn_goes_only_where_it_is_used(spark, monkeypatch, history):
    monkeypatch.setattr(C, "STRETCH", 2)
    rng = random.Random(history)
    said = [prose(rng, n) for n in (5, 9, 3000, 4, 7, 1500, 6, 2, 8)]
    rows = [(1, i, ("system" if i == 0 else "user" if i % 2 else "assistant"), t) for i, t in enumerate(said)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    copies = collections.Counter(r.place for r in C.placed(df, 60, history).collect())
    assert max(n for place, n in copies.items() if place) <= 3  # its own stretch, that of its end, one more for the history
    r = C.digests(C.format_windows(df, 60, history)).first()
    assert r.n_turns == len(rows)
    assert r.turns_sha256 == hashlib.sha256("".join(f"{x[2]}\n{x[3]}\n" for x in rows).encode()).hexdigest()
    assert r.loss_sha256 == hashlib.sha256("".join(x[3] for x in rows if x[2] == "assistant").encode()).hexdigest()


# --- 2: very many spans in one text ---


def test_fifty_thousand_spans(spark):
    rng = random.Random(4)
    text = "é ".join("%032x" % rng.getrandbits(128) + (f" token={i:09d}" if i % 5 == 0 else "") for i in range(42_000))
    got = SS.scan(spark.createDataFrame([(1, text), (2, "short token=abcdefgh9")], "doc_id long, text string")).collect()
    spans = next(r.base_spans for r in got if r.doc_id == 1)
    want = [(m.start(), 0, m.end()) for m in re.finditer(SS.ASSIGN, text)] + [(m.start(), 2, m.end()) for m in re.finditer(SS.HEX, text)]
    assert [(s.start, s.rank, s.end) for s in spans] == sorted(want) and len(want) > 50_000


def test_prefixes_by_blocks(spark):
    for n in (0, 1, 63, 64, 65, 200):
        values = [(i * 37) % 101 - 40 for i in range(n)]
        df = spark.createDataFrame([(values,)], "v array<bigint>")
        sums, most = df.select(SS.prefixes(F.col("v"), lambda a, x: a + x), SS.prefixes(F.col("v"), lambda a, x: F.greatest(a, x))).first()
        assert sums == [sum(values[:i]) for i in range(n)] and most == [max([0, *values[:i]]) for i in range(n)]


# --- 11 ---


@pytest.fixture(scope="module")
def tools():
    return T.Tokenizers()


def aligned_by_hand(text, tools):
    """Ids and groups of the whole text, or None."""
    if not text:
        return None
    raw = (" " + text).encode()
    a, b = tools.a.encode(" " + text, add_special_tokens=False).ids, tools.b.encode(text)
    if b"".join(tools.a_bytes[x] for x in a) != raw or b"".join(tools.b_bytes[x] for x in b) != raw:
        return None
    ends = [np.cumsum([len(names[x]) for x in ids]).tolist() for ids, names in ((a, tools.a_bytes), (b, tools.b_bytes))]
    groups, i, j = [], 0, 0
    for e in sorted(set(ends[0]) & set(ends[1])):
        k, m = ends[0].index(e, i) + 1, ends[1].index(e, j) + 1
        groups.append((a[i:k], b[j:m]))
        i, j = k, m
    return a, b, groups


TEXTS = [
    "plain words, and  two spaces", "tail \n", "tail ", " ", "  lead", "\nline\n\nline \t x", "<|endoftext|> <s> </s> <0x41>", "▁ marked", "Ünïcode naïve ﬁ é", "😀😀👩‍👩‍👧 한국어 中文字符连续没有空格",
    "A" * 5000, "0123456789" * 300, "a b　c  d", "x\x1cy \x1d z", "don't we'll  I'M", "﻿bom", "\x00 nul", "a" + "́" * 50, "end with nbsp ",
]


def test_groups_match_whole_encodings(spark, tools):
    rng = random.Random(1)
    texts = [*TEXTS, None, "", *(prose(rng, rng.randint(1, 60)) for _ in range(30)), prose(rng, 20_000), TEXTS[0], TEXTS[0]]
    df = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)], "doc_id int, text string, pairs string").repartition(3)
    got = {r.doc_id: r for r in T.align(df).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        r, want = got[i], aligned_by_hand(t, tools)
        if want is None:
            assert not (r.a_ids or r.b_ids or r.a_sizes or r.pairs), t
            continue
        a, b, groups = want
        assert (r.a_ids, r.b_ids) == (a, b), t
        assert list(zip(r.a_sizes, r.b_sizes)) == [(len(x), len(y)) for x, y in groups]
        links = collections.Counter(x << T.PAIR_BITS | y for g, h in groups for x in g for y in h)
        assert dict(zip(r.pairs, r.times)) == links
    assert T.align(df.limit(0)).count() == 0


@settings(max_examples=120, deadline=None)
@given(st.text(alphabet=st.sampled_from(list("ab .,'\n\t é中😀́▁<|s>0_")), max_size=40))
def test_units_make_no_difference(tools, text):
    made = [c[0].as_py() for c in T.align_texts([text, "next " + text], tools)]
    want = aligned_by_hand(text, tools)
    assert (made[0], made[1]) == (want[:2] if want else ([], []))
    assert list(zip(made[2], made[3])) == ([(len(x), len(y)) for x, y in want[2]] if want else [])


def test_shared_cuts_of_long_cutless_stretches():
    rng = random.Random(3)
    for n in (1, 2, 50, 3000):
        a = np.cumsum([rng.randint(1, 5) for _ in range(n)]) * 2
        b = np.unique(np.r_[a[-1], [x for x in a if rng.random() < 0.02], np.array([rng.randint(0, int(a[-1]) // 2) * 2 + 1 for _ in range(n)])])
        b = b[(b > 0) & (b <= a[-1])]
        got = T.shared_cuts(a, b, np.array([0]), np.array([n]))
        assert np.array_equal(got, np.isin(a, b))


@pytest.mark.parametrize("short_list", [0, 5, 1 << 18])
def test_counts_with_and_without_the_short_list(spark, tools, short_list):
    rng = random.Random(2)
    texts = [" ".join(rng.choice(("tokenization", "naïveté", "the", "Straße", "xyzzy")) for _ in range(rng.randint(0, 9))) for _ in range(60)] + [None, "▁"]
    df = spark.createDataFrame(list(enumerate(texts)), "row long, text string")
    from eventalpha.llm.common import cut

    made = cut(T.align(df).select("row", "pairs", "times"), "test-aligned")
    got = {r.row: (r.n_best, r.count_sum) for r in T.link_sums(made, "row", short_list).collect()}
    links = {i: [(x, y) for g, h in (aligned_by_hand(t, tools) or ((), (), ()))[2] for x in g for y in h] for i, t in enumerate(texts)}
    count = collections.Counter(p for own in links.values() for p in set(own))
    best = {}
    for (x, _), n in count.items():
        best[x] = max(best.get(x, 0), n)
    assert got == {i: (sum(count[p] == best[p[0]] for p in own), sum(count[p] for p in own)) for i, own in links.items()}


def test_large_groups_link_by_distinct_ids():
    rng = random.Random(7)
    a, b = np.array([rng.randint(0, 9) for _ in range(400)]), np.array([rng.randint(0, 5) for _ in range(300)])
    a_sizes, b_sizes = np.array([1, 99, 300]), np.array([2, 98, 200])
    group, pair, times = T.links(a, b, a_sizes, b_sizes)
    got = collections.Counter()
    for g, p, n in zip(group.tolist(), pair.tolist(), times.tolist()):
        got[g, p] += n
    want, i, j = collections.Counter(), 0, 0
    for g in range(3):
        want.update((g, int(x) << T.PAIR_BITS | int(y)) for x in a[i : i + a_sizes[g]] for y in b[j : j + b_sizes[g]])
        i, j = i + a_sizes[g], j + b_sizes[g]
    assert got == want and len(group) < 1000


# --- 12 ---

PLAIN = (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]")


def spans_by_hand(text):
    out = []
    for kind, pattern in enumerate(PLAIN):
        for m in re.finditer(pattern, text):
            digits = [int(c) for c in m[0] if c in "0123456789"]
            doubled = sum(digits[-1::-2]) + sum(sum(divmod(2 * d, 10)) for d in digits[-2::-2])
            if (kind == 1 and any(int(p) > 255 for p in m[0].split("."))) or (kind == 2 and not (14 <= len(digits) <= 19 and doubled % 10 == 0)) or (kind == 3 and not 10 <= len(digits) <= 15):
                continue
            out.append((m.start(), kind, m.end()))
    return sorted(out)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.sampled_from(list("ab@.-_+ ()0123456789é")), max_size=60))
def test_base_spans(text):
    assert P.base_spans(text) == spans_by_hand(text)


def test_base_spans_of_real_shapes():
    text = "é x.y+z@mail.example.com, 4111 1111 1111 1111; 4111111111111112 +1 (743) 555-3824, 300.1.1.1 10.0.0.255 1.2.3.4.5 a@b@c.d"
    assert P.base_spans(text) == spans_by_hand(text) and {k for _, k, _ in P.base_spans(text)} == {0, 1, 2, 3}
    for hostile in ("1" * 200_000, "a" * 200_000, "1." * 100_000, "a@" * 100_000, "+1" + "(" * 200_000, "1 " * 100_000):
        P.base_spans(hostile)  # linear, or this does not end


def planted():
    rng = random.Random(1)
    words = "alpha beta gamma delta river stone the of and to".split()
    talk = lambda n: " ".join(rng.choice(words) for _ in range(n))
    rows = [(i, f"{talk(10)} Reach me at: +1 (555) 010-{1000 + i * 37}, {talk(5)}") for i in range(12)]
    rows += [(100 + i, f"{talk(8)} reach me at (555-0199-{2000 + i}) {talk(5)} the x9y8z7q {talk(3)}") for i in range(6)]
    rows += [(200, None), (201, ""), (202, "12345678"), (203, "reach me at home today"), rows[3], rows[12]]
    # Seeds behind a frequent word prove nothing: other words stand there far more often.
    return rows + [(300 + i, f"{talk(3)} the +1 555 010 {3000 + i} {talk(30)} the k2k2k2k2 {talk(4)}") for i in range(20)]


def test_contexts_find_unseen_identifiers(spark):
    rows = planted()
    df = spark.createDataFrame([(i, t, "clash", 5) for i, t in rows], "doc_id long, text string, spans string, a int").repartition(4)
    got = P.scan(df).collect()
    assert len(got) == len(rows) and {r.a for r in got} == {5}
    for r in got:
        text = next((t for i, t in rows if i == r.doc_id), None) or ""
        assert [(s.start, s.rank, s.end) for s in r.base_spans] == spans_by_hand(text)
        mine = [(s.start, s.rank, s.end) for s in r.spans]
        assert mine == sorted(mine) and set((s.start, s.rank, s.end) for s in r.base_spans) <= set(mine)
        found = [text[a:b] for a, k, b in mine if k >= 4]
        assert found == ([f"(555-0199-{1900 + r.doc_id}"] if 100 <= r.doc_id < 106 else []), text
        assert {k for _, k, _ in mine if k >= 4} <= {7}
    assert P.scan(df.limit(0)).count() == 0


def test_pattern_scores_against_a_plain_version(spark):
    rng = random.Random(5)
    edges = {(p, i): int(i < 6) for p in range(5) for i in range(14) if rng.random() < 0.5}
    others = {0: 0, 1: 1, 2: 40, 4: 2}
    rows = [(1, 1, p, i, 0 if seed else -1, 0, 1, None) for (p, i), seed in edges.items()] + [(None, None, p, None, None, None, None, n) for p, n in others.items()]
    fillers = spark.createDataFrame(rows + rows[:4], "a long, b long, context long, instance long, kind int, start int, end int, others long")
    patterns = spark.createDataFrame([(p, 3) for p in range(5)], "context long, like int")
    got = {r.context: r.confidence for r in P.scored_patterns(fillers, patterns).collect()}
    inside = {p: [i for q, i in edges if q == p] for p in range(5)}
    play = [p for p in range(5) if inside[p] and len(inside[p]) / (len(inside[p]) + others.get(p, 0) + 1) >= 0.5]
    score = {i: float(i < 6) for i in range(14)}
    for _ in range(3):
        conf = {p: sum(score[i] for i in inside[p]) / (len(inside[p]) + others.get(p, 0) + 1) for p in play}
        score = {i: 1.0 if i < 6 else 1 - np.prod([1 - conf[p] for p in play if i in inside[p] and conf[p] >= 0.5]) for i in range(14)}
    assert got == pytest.approx(conf) and 2 not in got


# --- 13 ---


def exact_whitening(x):
    from fractions import Fraction

    n, d = len(x), len(x[0])
    s = [sum(r[i] for r in x) for i in range(d)]
    v = np.array([[float(Fraction(n * sum(r[i] * r[j] for r in x) - s[i] * s[j], n * n)) for j in range(d)] for i in range(d)])
    e, u = np.linalg.eigh(v)
    return n, s, v, e[::-1], u[:, ::-1]


def whitened(spark, vectors, **more):
    df = spark.createDataFrame(list(enumerate(vectors)), "vec_id long, embedding array<float>").withColumn("component", F.lit("clash")).repartition(3)
    return df, W.whiten(df, **more).collect()


def test_whitening_against_numpy(spark):
    rng = np.random.default_rng(1)
    vectors = (rng.normal(size=(300, 12)) @ rng.normal(size=(12, 12)) + 5).astype(np.float32).tolist()
    dropped = [None, [], [None] * 12, [float("nan")] * 12, [float("inf")] + [0.0] * 11, [1.0] * 5]
    _, got = whitened(spark, vectors + dropped + vectors[:7])
    x = [[int(np.floor(np.float64(c) * 1024)) + 100000 for c in r] for r in vectors + vectors[:7]]
    n, s, v, e, u = exact_whitening(x)
    assert len(got) == 8 * 307 and {r.n for r in got} == {307}
    ids = [*range(300), *range(306, 313)]
    by = {(r.vec_id, r.component): r for r in got}
    projected = (np.array(x) - np.array(s) / n) @ u[:, :8] / np.sqrt(e[:8])
    found = np.array([[by[i, k].whitened for k in range(1, 9)] for i in ids])
    signs = np.sign((found * projected).sum(axis=0))
    assert np.abs(found - projected * signs).max() < 1e-9
    assert all(by[i, 1].deviation == sum((n * c - t) ** 2 for c, t in zip(row, s)) for i, row in zip(ids, x))
    assert [by[0, k].explained for k in range(1, 9)] == pytest.approx((e[:8] / np.trace(v)).tolist(), rel=1e-12)
    assert {r.identity_error for r in got} == {got[0].identity_error} and got[0].identity_error < 1e-9


@pytest.mark.parametrize("values", [[5, 5, 5, 2, 1, 1], list(range(1, 33)), [1] * 10, [1, 1 + 1e-9, 1 + 2e-9, 3, 0], [1e6, 1, 1 + 1e-12, 1e-3, 0, 0], [1, 1 + 3e-8, 1 + 6e-8, 1 - 5e-8, 2]])
def test_refined_eigenvectors_also_in_clusters(values):
    rng = np.random.default_rng(len(values))
    d = len(values)
    q = np.linalg.qr(rng.normal(size=(d, d)))[0].astype(np.longdouble)
    for _ in range(3):
        q = q @ (1.5 * np.eye(d, dtype=np.longdouble) - 0.5 * (q.T @ q))
    a = (q * np.array(values, np.longdouble)) @ q.T
    a = (a + a.T) / 2
    e, x = W.eigenvectors(a)
    top = max(values)
    assert np.abs(e - sorted(values, reverse=True)).max() < 1e-14 * top
    assert np.abs(x.T @ x - np.eye(d)).max() < 5e-15
    assert np.abs((a @ x - x * e)).max() < 1e-15 * top * d
    for at, value in enumerate(sorted(values, reverse=True)):  # vectors of gaps that double precision can tell apart
        if all(abs(value - o) > 1e-10 * top for i, o in enumerate(sorted(values, reverse=True)) if i != at):
            exact = q[:, values.index(value)].astype(np.float64)
            assert min(np.abs(x[:, at] - exact).max(), np.abs(x[:, at] + exact).max()) < 1e-6 if values.count(value) == 1 else True


def test_whitening_of_odd_tables(spark):
    _, same = whitened(spark, [[0.5, -0.25, 1.0]] * 4)  # no variance at all
    assert len(same) == 12 and {(r.whitened, r.explained, r.deviation, r.identity_error) for r in same} == {(0.0, 0.0, 0, 1.0)}
    _, flat = whitened(spark, [[float(i), 1.0, 2.0 * i] for i in range(9)])  # one direction only
    assert {r.component: r.explained for r in flat}[1] == pytest.approx(1.0) and {r.whitened for r in flat if r.component > 1} == {0.0}
    _, far = whitened(spark, [[3e38, 1.0], [-3e38, 2.0], [0.0, 0.0]])  # beyond the largest entry
    assert len(far) == 6 and all(np.isfinite(r.whitened) for r in far) and {r.deviation for r in far if r.vec_id == 0} == {None}
    _, two = whitened(spark, [[1.0, 2.0], [3.0, 5.0], [0.0, 1.0]], components=1)
    assert {r.component for r in two} == {1} and len(two) == 3
    df, none = whitened(spark, [[1.0, None]])
    assert none == [] and W.whiten(df.limit(0)).columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]


def test_products_are_exact_for_large_numbers():
    rng = random.Random(2)
    y = [[rng.randint(-(1 << 39), 1 << 39) for _ in range(3)] for _ in range(5000)]
    got = W.products(np.array(y, np.int64))
    assert [[int(v) for v in r] for r in got] == [[sum(r[i] * r[j] for r in y) for j in range(3)] for i in range(3)]
