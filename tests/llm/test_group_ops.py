"""Joins, searches and mixing against brute force on small tables."""

import re

import duckdb
import numpy as np
import pytest

from conftest import SF_SMALL
from llm_help import frame, groups, pairs, vectors  # noqa: F401 - fixtures
from tripframe.llm import caps, catalog, exchange, knn, mixing, partenum, passages, urls
from tripframe.llm.components import components


def shingles(t):
    w = [x.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
         for x in re.findall(r"[^\x20\x09-\x0D]+", t or "")]
    if not w:
        return frozenset()
    return frozenset([tuple(w)] if len(w) < 5 else [tuple(w[i:i + 5]) for i in range(len(w) - 4)])


def near_copies(rng, n=40):
    """Texts of many lengths with copies, near copies at every distance, a
    frequent passage, and odd rows."""
    words = [f"w{i}" for i in range(3000)]
    common = list(rng.choice(words, 30))
    out = [None, "", "  ", "one", "one", "ONE", "one two three four", "one two three four"]
    for k in range(n):
        base = list(rng.choice(words, int(rng.integers(5, 400))))
        if k % 3 == 0:
            base[2:2] = common
        out.append(" ".join(base))
        for edits in (0, 1, 3, 8):
            v = list(base)
            for _ in range(edits):
                v[int(rng.integers(0, len(v)))] = str(rng.choice(words))
            out.append(" ".join(v))
    return out


def test_ngram_join_matches_brute_force(spark, frame):
    texts = near_copies(np.random.default_rng(11))
    docs = frame([(i * 3 + 1, t) for i, t in enumerate(texts)] + [(None, "one"), (4, texts[1])])
    got = partenum.join(docs).collect()
    assert len(got) == len(texts) + 2
    sets = {i * 3 + 1: shingles(t) for i, t in enumerate(texts)}
    links = [(a, b) for a, b in pairs(sets) if sets[a] and sets[b]
             and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    want = groups(links, sets)
    for r in got:
        if r.doc_id is not None:
            assert (r.n_shingles, r.component_id) == (len(sets[r.doc_id]), want[r.doc_id]), r


def test_ngram_join_large_group_of_near_copies(spark, frame):
    rng = np.random.default_rng(5)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(300):
        v = list(base)
        for _ in range(int(rng.integers(0, 9))):
            v[int(rng.integers(0, 120))] = f"x{rng.integers(0, 10 ** 9)}"
        rows.append((i, " ".join(v)))
    sets = {i: shingles(t) for i, t in rows}
    links = [(a, b) for a, b in pairs(sets) if 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    want = groups(links, sets)
    got = {r.doc_id: r.component_id for r in partenum.join(frame(rows)).collect()}
    assert got == want


def test_ngram_join_crowded_run_is_dealt_as_blocks(spark, frame):
    """Sets that share most shingles, in many components, one of them large."""
    rng = np.random.default_rng(21)
    base = [f"w{i}" for i in range(140)]
    rows = []
    for i in range(160):
        v = base + [f"y{i if i % 2 else 0}_{k}" for k in range(22 + i % 9)]
        for _ in range(int(rng.integers(0, 5))):
            v[int(rng.integers(0, 140))] = f"x{rng.integers(0, 10 ** 9)}"
        rows.append((i, " ".join(v)))
    sets = {i: shingles(t) for i, t in rows}
    links = [(a, b) for a, b in pairs(sets) if 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    want = groups(links, sets)
    for block in (8, 1024):
        got = {r.doc_id: r.component_id for r in partenum.join(frame(rows), block=block).collect()}
        assert got == want


def test_ngram_join_blocks_are_bounded_and_meet_once(spark):
    rows = [(7, i, 10, b"s", 1 if i < 100 else 2 if i < 140 else 1000 + i // 2) for i in range(200)]
    rows += [(8, i, 10, b"s", 5) for i in range(50)]
    known = spark.createDataFrame(rows, "center long, own long, n int, sigs binary, comp long")
    bits = spark.range(200).selectExpr("id as own", "cast('b' as binary) as bits")
    met = []
    for r in partenum._dealt(known, bits, 20).collect():
        one = [(m.own, m.comp) for m in r.one]
        two = one if r.two is None else [(m.own, m.comp) for m in r.two]
        assert max(len(one), len(two)) <= 60
        assert len({c for _, c in one + two}) > 1
        met += [(x[0], y[0]) if x < y else (y[0], x[0]) for x in one for y in two
                if x[1] != y[1] and (r.two is not None or x < y)]
    comp = {o: c for k, o, _, _, c in rows if k == 7}
    assert sorted(tuple(sorted(m)) for m in met) == [(a, b) for a, b in pairs(range(200)) if comp[a] != comp[b]]


def test_ngram_join_empty(spark, frame):
    assert partenum.join(frame([])).count() == 0
    got = partenum.join(frame([(1, None), (2, "")])).collect()
    assert {(r.doc_id, r.n_shingles, r.component_id) for r in got} == {(1, 0, 1), (2, 0, 2)}


def test_signature_guarantee():
    """Linked sets agree on a signature that neither leaves out."""
    scheme = partenum.Scheme(75)
    rng = np.random.default_rng(2)
    for n in (1, 2, 3, 4, 7, 20, 150, 900):
        a = np.sort(rng.integers(0, 1 << 63, n, dtype=np.uint64))
        for part in (0.0, 0.1, 0.14):
            b = a.copy()
            k = int(part * n)
            b[:k] = rng.integers(0, 1 << 63, k, dtype=np.uint64)
            b = np.sort(b)
            same = len(np.intersect1d(a, b))
            if 100 * same < 75 * (2 * n - same):
                continue
            h, off = np.concatenate([a, b]), np.array([0, n, 2 * n])
            sig, owner, _, drop = partenum.signatures(h, off, np.arange(2), scheme)
            for d in (0, 2):
                x, y = sig[owner == d], sig[owner == d + 1]
                assert len(np.intersect1d(x, y)) > max(drop[d], drop[d + 1])


def test_components(spark):
    edges = [(1, 2), (2, 3), (5, 4), (6, 6), (7, 8), (8, 9), (9, 10), (10, 11), (None, 3), (1, 2)]
    df = spark.createDataFrame(edges, "a long, b long")
    got = {r.node: r.root for r in components(df).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 4, 5: 4, 7: 7, 8: 7, 9: 7, 10: 7, 11: 7}


def test_caps_match_brute_force(spark, vectors):
    rng = np.random.default_rng(4)
    rows = []
    for k in range(60):
        c = rng.standard_normal(16)
        for j in range(5):
            v = c + rng.standard_normal(16) * (0, 0.05, 0.2, 0.3, 1.0)[j]
            rows.append((len(rows), [float(np.float32(x)) for x in v], k % 3))
    rows += [(1000, None, 1), (1001, [], 1), (1002, [0.0] * 16, 1), (1003, [float("nan")] * 16, 1),
             (1004, [1.0, None] * 8, 1), (1005, rows[0][1], None), (1006, rows[0][1], 0), (1007, rows[0][1], 1),
             (1008, [1.0, 2.0], 0), (1009, [2.0, 4.0], 0)]
    got = {r.vec_id: r for r in caps.link(vectors(rows)).collect()}
    assert len(got) == len(rows)
    good = {}
    for i, v, lab in rows:
        if v and lab is not None and all(x is not None and np.isfinite(x) for x in v) and any(v):
            u = np.array(v, dtype=float)
            good[i] = (lab, u / np.linalg.norm(u))
    links = [(a, b) for a, b in pairs(good) if good[a][0] == good[b][0] and len(good[a][1]) == len(good[b][1])
             and good[a][1] @ good[b][1] >= 0.93]
    want = groups(links, [i for i, _, _ in rows])
    missed = 0
    for i, _, _ in rows:
        n = sum(i in p for p in links)
        assert got[i].n_links <= n
        missed += n - got[i].n_links
        assert got[i].kept == (got[i].component_id == i)
    assert missed <= 0.1 * 2 * len(links)
    assert sum(got[i].component_id != want[i] for i in want) <= 0.05 * len(want)
    assert got[1006].n_links >= 1 and got[1005].n_links == 0 and got[1009].component_id == 1008


def test_caps_crowded_filter_is_dealt_as_blocks(spark, vectors):
    rng = np.random.default_rng(8)
    c = rng.standard_normal(16)
    rows = [(i, [float(np.float32(x)) for x in c + 0.01 * rng.standard_normal(16)], 0) for i in range(90)]
    got = caps.link(vectors(rows), block=16).collect()
    assert {(r.n_links, r.component_id) for r in got} == {(89, 0)}


def test_caps_partitions_and_rounds_are_bounded(spark, vectors, monkeypatch):
    """A partition gets a bounded number of bytes, and links do not depend on rounds."""
    from pyspark.sql import functions as F
    rng = np.random.default_rng(3)
    v = rng.standard_normal((12000, 64)).astype(np.float32)
    v[11000:] = v[:1000] + 0.01 * v[1000:2000]
    rows = [(i, x.tolist(), i % 1000 % 3) for i, x in enumerate(v)]
    most, count = [], caps._count

    def watched(sent, *rest):
        most.append(sent.groupBy("part").agg(F.sum(F.length("payload")).alias("n")).agg(F.max("n")).first()[0])
        return count(sent, *rest)

    monkeypatch.setattr(caps, "_count", watched)
    got = {r.vec_id: (r.n_links, r.component_id) for r in caps.link(vectors(rows)).collect()}
    assert sum(got[i] == (1, i % 11000) for i in [*range(1000), *range(11000, 12000)]) >= 1990
    assert max(most) < 16 << 20
    monkeypatch.setattr(caps, "ROUND_BYTES", 16 << 20)
    monkeypatch.setattr(caps, "ROUND", 0.1)
    most.clear()
    again = {r.vec_id: (r.n_links, r.component_id) for r in caps.link(vectors(rows)).collect()}
    assert again == got and len(most) > 4


@pytest.mark.parametrize("d", [1, 2, 8])
def test_caps_short_vectors_match_brute_force(spark, vectors, d):
    rng = np.random.default_rng(d)
    v = rng.standard_normal((120, d)).astype(np.float32)
    got = caps.link(vectors([(i, x.tolist(), i % 2) for i, x in enumerate(v)]), block=32).collect()
    u = v / np.linalg.norm(v.astype(float), axis=1)[:, None]
    links = [(a, b) for a, b in pairs(range(120)) if a % 2 == b % 2 and u[a] @ u[b] >= 0.93]
    want = groups(links, range(120))
    assert {r.vec_id: (r.n_links, r.component_id) for r in got} == {
        i: (sum(i in p for p in links), want[i]) for i in range(120)}


def test_caps_repeated_ids_and_doubles(spark):
    """An id with two vectors joins their components; doubles keep their precision."""
    base = np.random.default_rng(5).standard_normal((3, 24))
    rows = [(1, base[0].tolist(), 0), (2, base[0].tolist(), 0), (1, base[1].tolist(), 0),
            (3, (base[1] * (1 + 1e-12)).tolist(), 0), (3, (base[1] * (1 + 1e-12)).tolist(), 0), (4, base[2].tolist(), 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = sorted((r.vec_id, r.n_links, r.component_id) for r in caps.link(df).collect())
    assert got == [(1, 1, 1), (1, 2, 1), (2, 1, 1), (3, 2, 1), (3, 2, 1), (4, 0, 4)]


def test_caps_empty(spark, vectors):
    assert caps.link(vectors([])).count() == 0


def test_topk_matches_brute_force(spark, vectors):
    from pyspark.sql import functions as F
    rng = np.random.default_rng(9)
    rows = [(i, [float(np.float32(x)) for x in rng.integers(-2, 3, 12) / 4], 0) for i in range(400)]
    rows += [(1000, None, 0), (1050, [float("inf")] * 12, 0), (1100, [1.0], 0), (1150, [2.0 ** 40, -2.0 ** 40] * 6, 0),
             (1151, [2.0 ** 40, -2.0 ** 40] * 6, 0), (None, [0.5] * 12, 0)]
    got = {}
    for r in knn.search(vectors(rows), F.pmod(F.col("id"), F.lit(50)) == 0).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    good = {i: [int(np.floor(256 * x)) for x in v] for i, v, _ in rows
            if i is not None and v and all(np.isfinite(v))}
    big = (1 << 63) - 1
    for q in [i for i in good if i % 50 == 0]:
        s = sorted((-max(-big, min(big, sum(a * b for a, b in zip(good[q], good[c])))), c) for c in good
                   if c != q and len(good[c]) == len(good[q]))
        want = [(n + 1, c, -v) for n, (v, c) in enumerate(s[:5])]
        assert sorted(got.get(q, [])) == want


def test_bounds_hold():
    rng = np.random.default_rng(1)
    q, x = rng.standard_normal((40, 30)), rng.standard_normal((50, 30))
    for n in (1, 4, 16, 64):
        assert (knn._bound(q, x, n) >= q @ x.T).all()


def test_mix(spark, frame):
    rng = np.random.default_rng(0)
    rows = [(i, "w " * int(rng.integers(0, 40)), [None, "a", "b", "é", "c"][int(rng.integers(0, 5)) * (i % 3 > 0)])
            for i in range(500)]
    rows += [(9999, None, "a"), (3, "x y", "b"), (3, "x y", "b")]
    out = mixing.report(mixing.mix(mixing.of_source(frame(rows))))
    got = out.collect()
    assert len(got) == len(rows)
    size, taken, goal = {}, {}, {}
    for r in got:
        assert r.taken <= 2 * r.size and (r.size == 0 or r.taken % r.size == 0)
        size[r.source_size] = r.source_size
        taken[r.source_size] = taken.get(r.source_size, 0) + r.taken
        goal[r.source_size] = r.target
    for k in size:
        assert abs(taken[k] - goal[k]) <= max(2, 0.02 * goal[k])
    assert sorted(map(str, got)) == sorted(map(str, mixing.report(mixing.mix(
        mixing.of_source(frame(rows).repartition(7)))).collect()))
    assert mixing.mix(mixing.of_source(frame([]))).count() == 0


def test_targets_share_excess():
    t = mixing.targets([("a", 10), ("b", 1000), (None, 1000)], (5, 2, 1))
    assert t["a"] == 20 and sum(t.values()) == pytest.approx(1.5 * 2010)
    assert t["b"] == pytest.approx(2995 * 2 / 3) and t[None] == pytest.approx(2995 / 3)


def test_route_prefers_first_passes():
    """Overlapping sources: the flow meets quotas with fewest repeats."""
    flow = mixing.route([(("a",), 100), (("a", "b"), 100), (("b",), 50)], {"a": 150.0, "b": 100.0})
    assert sum(f.get("a", 0) for f in flow) == 150 and sum(f.get("b", 0) for f in flow) == 100
    assert all(sum(f.values()) <= c for f, c in zip(flow, (100, 100, 50)))      # no repeats needed
    flow = mixing.route([(("a",), 100)], {"a": 180.0, "b": 5.0})
    assert flow == [{"a": 180}]


def test_mix_overlapping_sources(spark):
    rows = [(i, ["a"] if i % 3 == 0 else ["a", "b"] if i % 3 == 1 else ["b"], 10) for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, members array<string>, size long")
    got = mixing.mix(df, weights=(3.0, 1.0), share=0.8).collect()
    charged = {}
    for r in got:
        assert len(r.charged) == r.passes_taken and all(s in r.members for s in r.charged)
        for s in r.charged:
            charged[s] = charged.get(s, 0) + r.size
    assert charged["a"] == pytest.approx(1800, abs=10) and charged["b"] == pytest.approx(600, abs=10)


def test_passages_find_planted(spark, frame):
    rng = np.random.default_rng(6)
    words = [f"w{i}" for i in range(5000)]
    passage = list(rng.choice(words, 70))
    rows = [(i, " ".join(rng.choice(words, 200))) for i in range(1, 60)]
    for i in (5, 17, 40):
        t = rows[i - 1][1].split()
        p = list(passage)
        for at in (20, 45)[:i % 3]:
            p[at] = "changed"
        t[50:50] = p
        rows[i - 1] = (i, " ".join(t))
    rows += [(70, rows[9][1]), (71, None), (72, ""), (73, "short text"), (74, "word " * 300), (75, "Word " * 280),
             (None, rows[4][1]), (5, rows[4][1])]
    got = passages.find(frame(rows)).collect()
    found = {(r.doc_id, r.source_id): r for r in got}
    for i in (17, 40):
        r = found[(i, 5)]
        assert r.kind == "passage" and abs(r.start - 50) <= 3 and abs(r.end - 120) <= 3
        assert r.end - r.start >= 60 and r.same >= 60
    assert found[(70, 10)].kind == "copy" and (75, 74) in found
    assert {r.doc_id for r in got} == {17, 40, 70, 75}
    assert passages.find(frame([])).count() == 0


def test_passages_between_later_documents(spark, frame):
    """Earlier documents hold only pieces under MIN_WORDS of a passage that
    later ones share, before the first and between the two."""
    rng = np.random.default_rng(16)
    words = [f"w{i}" for i in range(5000)]

    def around(part):
        return " ".join([*rng.choice(words, 60), *part, *rng.choice(words, 60)])

    p, q = list(rng.choice(words, 60)), list(rng.choice(words, 40))
    rows = [(1, around(p[:38])), (2, around(p[24:])), (8, around(p)), (9, around(p))]
    rows += [(20 + i, around(q[i:][:39])) for i in range(2)] + [(30, around(q))]
    rows += [(40 + i, around(q[3 * i:][:25])) for i in range(6)] + [(50, around(q))]
    got = {(r.doc_id, r.source_id): r for r in passages.find(frame(rows)).collect()}
    r = got[(9, 8)]
    assert r.start <= 60 and r.end >= 120 and r.same >= 60
    r = got[(50, 30)]
    assert r.start <= 60 and r.end >= 100 and r.same >= 40
    assert set(got) == {(9, 8), (50, 30)}


@pytest.mark.parametrize("every, words_", [(4, 63), (5, 60), (6, 60), (7, 60)])
def test_passages_with_evenly_changed_words(spark, frame, every, words_):
    rng = np.random.default_rng(every)
    words = [f"w{i}" for i in range(5000)]
    rows = []
    p = list(rng.choice(words, words_))
    for i in (1, 2):
        q = [f"x{i}" if at % every == every - 1 else u for at, u in enumerate(p)]
        rows.append((i, " ".join([*rng.choice(words, 50), *q, *rng.choice(words, 50)])))
    got = passages.find(frame(rows)).collect()
    assert [(r.doc_id, r.source_id) for r in got] == [(2, 1)]
    assert got[0].start <= 51 and got[0].end >= 48 + words_ and 100 * got[0].same >= 75 * (got[0].end - got[0].start)


def _fuzzy(rng, words, passage, changed):
    p = list(passage)
    for at in rng.choice(np.arange(8, len(p) - 8), changed, replace=False):
        p[at] = str(rng.choice(words))
    return p


def test_passages_copies_of_other_batches(spark, frame):
    """Copies are one text wherever they are read, also as many as make a seed frequent."""
    rng = np.random.default_rng(23)
    words = [f"w{i}" for i in range(20000)]
    passage = list(rng.choice(words, 60))
    texts = [" ".join([*rng.choice(words, 30), *passage, *rng.choice(words, 30)]) for _ in range(3)]
    rows = [(i, texts[i % 3]) for i in range(60)]
    got = passages.find(frame(rows).repartition(12, "doc_id")).collect()
    assert sorted((r.doc_id, r.source_id) for r in got if r.kind == "passage") == [(1, 0), (2, 0), (2, 1)]
    assert sorted((r.doc_id, r.source_id) for r in got if r.kind == "copy") == [(i, i % 3) for i in range(3, 60)]
    assert all((r.start, r.end, r.same) == (30, 90, 60) for r in got if r.kind == "passage")


def test_passages_steps_of_matches():
    """Places and diagonals of matches are the same again after their steps are packed."""
    rng = np.random.default_rng(24)
    c = rng.integers(1, 9, 50)
    s = np.cumsum(c) - c
    at = rng.integers(-1 << 30, 1 << 30, int(c.sum())).astype(np.int64)
    assert np.array_equal(passages._places(passages._steps(at, s), s, c), at)
    assert exchange.unsqueeze(exchange.squeeze(b"")) == b""
    assert exchange.unsqueeze(exchange.squeeze(at.tobytes())) == at.tobytes()


def test_passages_all_pairs_of_a_passage(spark, frame):
    """Every two documents that share a passage meet, however many share it;
    sentences of other documents stand between its changed words."""
    rng = np.random.default_rng(21)
    words = [f"w{i}" for i in range(20000)]
    passage = list(rng.choice(words, 90))
    shared = {i: _fuzzy(rng, words, passage, i % 6) for i in range(100, 140)}
    rows = [(i, " ".join([*rng.choice(words, 50), *p, *rng.choice(words, 50)])) for i, p in shared.items()]
    for i, p in enumerate(shared[k][a:a + 16] for k in (120, 130, 139) for a in range(0, 75, 4)):
        rows += [(i + 1, " ".join([*rng.choice(words, 40), *p, *rng.choice(words, 40)])),
                 (300 + i, " ".join([*rng.choice(words, 40), *p, *rng.choice(words, 40)]))]
    got = {(r.doc_id, r.source_id) for r in passages.find(frame(rows)).collect()}
    assert got == {(b, a) for b in shared for a in shared if a < b}


def test_passages_of_frequent_sentences(spark, frame):
    """A sentence of 13 words in 60 documents is no passage by itself, but part of
    one where it is, behind an inserted word too."""
    rng = np.random.default_rng(22)
    words = [f"w{i}" for i in range(20000)]
    first, second, third = (list(rng.choice(words, 14)) for _ in range(3))
    rows = [(i, " ".join([*rng.choice(words, 60), *(first, second, third)[i % 3], *rng.choice(words, 60)]))
            for i in range(1, 181)]
    rest = list(rng.choice(words, 30))
    for i, p in ((500, [*first, *rest]), (510, [*first, "in", *rest]), (520, [*first, *rest]),
                 (600, [*first, *second, *third]), (610, [*first, "x", *second, "y", "z", *third])):
        rows.append((i, " ".join([*rng.choice(words, 60), *p, *rng.choice(words, 60)])))
    got = {(r.doc_id, r.source_id): r for r in passages.find(frame(rows)).collect()}
    assert set(got) == {(510, 500), (520, 500), (520, 510), (610, 600)}
    assert got[520, 500].same == 44 and got[510, 500].same == 44 and got[610, 600].same == 42


def test_passages_in_rounds(spark, frame, monkeypatch):
    """Rounds send less at once, find the same and leave nothing of their steps."""
    import glob

    from pyspark.sql import functions as F
    rng = np.random.default_rng(25)
    words = [f"w{i}" for i in range(20000)]
    passage = list(rng.choice(words, 60))
    rows = [(i, " ".join([*rng.choice(words, 30), *(_fuzzy(rng, words, passage, i % 5) if i < 60 else passage[:50]),
                          *rng.choice(words, 30)])) for i in range(70)]
    pair = [list(rng.choice(words, 70)) for _ in range(6)]
    rows += [(100 + i, " ".join([*rng.choice(words, 20), *pair[i % 6]])) for i in range(18)] + [(200, rows[3][1])]
    sent, chain = [], passages._chain

    def watched(matched, *rest):
        sent.append(matched.agg(F.sum(F.length("payload"))).first()[0])
        return chain(matched, *rest)

    monkeypatch.setattr(passages, "_chain", watched)

    def found():
        return sorted(map(tuple, passages.find(frame(rows)).collect()))

    want, (whole,) = found(), sent
    sent.clear()
    folder = spark.sparkContext._jsc.sc().getCheckpointDir().get().removeprefix("file:")
    before = len(glob.glob(f"{folder}/stage/llm-passage-chains*"))
    monkeypatch.setattr(passages, "ROUND", 0, raising=False)
    monkeypatch.setattr(passages, "ROUND_BYTES", 1 << 14, raising=False)
    assert found() == want and len(want) > 1000
    assert len(sent) > 2 and max(sent) < 0.7 * whole
    assert len(glob.glob(f"{folder}/stage/llm-passage-chains*")) == before > 0


def test_chains_match_brute_force():
    rng = np.random.default_rng(12)
    for _ in range(30):
        seg = [(int(x), int(y), int(n)) for x, y, n in zip(rng.integers(0, 200, 12), rng.integers(0, 200, 12),
                                                          rng.integers(0, 15, 12))]
        best = {}

        def score(i):
            if i not in best:
                x, y, n = seg[i]
                most = 0.0
                for j, (u, v, m) in enumerate(seg):
                    if u + m < x and v + m < y:
                        most = max(most, score(j) - passages.GAP * (x - u - m + y - v - m))
                best[i] = n + passages.K + most
            return best[i]

        top = max(score(i) for i in range(len(seg)))
        first = passages.chains(seg, least=0)[0]
        total = sum(seg[i][2] + passages.K for i in first)
        for a, b in zip(first, first[1:]):
            total -= passages.GAP * (seg[b][0] - seg[a][0] - seg[a][2] + seg[b][1] - seg[a][1] - seg[a][2])
        assert total == pytest.approx(top)


def test_url_filter(spark):
    urls_ = ["http://A.example.ORG/es/x?q#f", "https://x.com/fr/", "x.com/fr/", None, "", "http://", "http://y.net",
             "http://www.Bad.net/p/index.html?utm_source=a&b=2&a=1#z", "https://bad.net/p/?a=1&b=2", "http://bad.net:80/q",
             "http://notexample.org/es/", "http://example.org/en/123", "http://z.net/?x"]
    pages = spark.createDataFrame([(i, u, "h") for i, u in enumerate(urls_)] + [(6, urls_[6], "h")],
                                  "page_id long, url string, canon string")
    listed = spark.createDataFrame([("http://bad.net/p?b=2&a=1",), ("http://BAD.net/q",), (None,), ("nothing",)],
                                   "url string")
    got = {r.page_id: r for r in urls.verdicts(urls.judge(pages, listed)).collect()}
    assert len(got) == len(urls_)
    assert (got[0].host, got[0].path, got[0].rule, got[0].verdict) == ("a.example.org", "/es/x", "example.org/es/", "block")
    assert got[1].rule == "com/fr/" and (got[2].host, got[2].path, got[2].verdict) == ("", "", "allow")
    assert [got[i].verdict for i in (3, 4, 5, 6, 12)] == ["allow"] * 5
    assert [got[i].verdict for i in (7, 8, 9)] == ["block"] * 3
    assert got[10].rule == "org/" and got[11].rule == "example.org/en/1"
    assert urls.judge(pages.limit(0), listed).count() == 0
    none = urls.judge(pages, listed.limit(0)).collect()
    assert len(none) == len(urls_) + 1 and not any(r.listed for r in none)


def test_bloom_has_no_false_negatives(spark):
    names = spark.range(2000).selectExpr("concat('h', id, '/p') as canon")
    more = spark.range(1000, 6000).selectExpr("concat('h', id, '/p') as canon")
    passed = {r.canon for r in urls.possible(more, names).collect()}
    assert {f"h{i}/p" for i in range(1000, 2000)} <= passed
    assert len(passed) < 1000 + 400


@pytest.mark.parametrize("name", sorted(catalog.ORACLE))
def test_queries_match_sql(spark, name):
    from tripframe.plans.check import compare
    con = duckdb.connect()
    for t in ("embeddings", "pages", "documents", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    assert compare(catalog.QUERIES[name](spark, SF_SMALL).toPandas(), con.sql(catalog.ORACLE[name]).df()) is None
