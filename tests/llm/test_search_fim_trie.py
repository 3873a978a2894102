"""Nearest neighbours, fill-in-middle and the prefix trie against brute force."""

import hashlib
import re
import zlib
from collections import defaultdict

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from pyspark.sql import types as T

from llm_help import frame, vectors  # noqa: F401 - fixtures
from tripframe.llm import crosspoly, fim, prefix_trie



def search(df, **how):
    return crosspoly.search(df, F.pmod(F.col("id"), F.lit(100)) == 0, **how)


# Nearest neighbours ---------------------------------------------------------
def usable(v):
    return v is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v) and any(v)


def brute(rows, k=10):
    best = defaultdict(dict)
    asked = {}
    for i, v, _ in rows:
        if i is not None and usable(v) and i % 100 == 0:
            asked[i] = min(asked.get(i, v), v)
    for q, w in asked.items():
        for i, v, _ in rows:
            if i is not None and i != q and usable(v) and len(v) == len(w):
                d = float(np.sqrt(((np.float32(w).astype(float) - np.float32(v).astype(float)) ** 2).sum()))
                best[q][i] = min(d, best[q].get(i, np.inf))
    return {q: sorted((d, i) for i, d in b.items())[:k] for q, b in best.items()}


def found(df):
    out = defaultdict(list)
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r.rank)):
        out[r.query_id].append((r.score, r.vec_id))
        assert r.rank == len(out[r.query_id])
    return out


def test_neighbours_all_probes_is_exact(spark, vectors, monkeypatch):
    """With every cell asked the search is exact; cells are dealt as blocks."""
    monkeypatch.setattr(crosspoly, "BLOCK", 7)
    monkeypatch.setattr(crosspoly, "QUERIES", 2)
    rng = np.random.default_rng(1)
    rows = [(i, rng.standard_normal(6).astype(np.float32).tolist(), 0) for i in range(700)]
    rows += [(1000 + i, [0.5] + [0.0] * 5, 0) for i in range(40)]          # ties
    rows += [(1000, [0.25] + [0.0] * 5, 0), (3, rows[3][1], 0), (3, rows[100][1], 0)]
    rows += [(100, [1.0, 2.0], 0), (2000, [1.0, 2.5], 0), (2001, [3.0, 2.5], 0)]  # other lengths
    rows += [(4000, None, 0), (4100, [], 0), (4200, [0.0] * 6, 0), (4300, [float("nan")] + [1.0] * 5, 0),
             (4400, [None] + [1.0] * 5, 0), (None, [1.0] * 6, 0)]
    got = found(search(vectors(rows), tables=1, probes=1000))
    want = brute(rows)
    assert set(got) == set(want)
    for q in want:
        assert [i for _, i in got[q]] == [i for _, i in want[q]], q
        np.testing.assert_allclose([d for d, _ in got[q]], [d for d, _ in want[q]], rtol=1e-12)


def test_neighbours_recall_and_short_lists(spark, vectors):
    rng = np.random.default_rng(2)
    centre = rng.standard_normal((30, 48))
    v = centre[rng.integers(0, 30, 1500)] + 0.6 * rng.standard_normal((1500, 48))
    rows = [(i, x.astype(np.float32).tolist(), 0) for i, x in enumerate(v)]
    got, want = found(search(vectors(rows))), brute(rows)
    hits = sum(len({i for _, i in got[q]} & {i for _, i in want[q]}) for q in want)
    assert hits >= 0.9 * sum(len(w) for w in want.values())
    # One probe finds too little for some queries; those are compared with all rows.
    few = found(search(vectors(rows[:120]), tables=1, probes=2))
    assert {q: len(w) for q, w in few.items()} == {0: 10, 100: 10}
    tiny = found(search(vectors(rows[:4])))
    assert [i for _, i in tiny[0]] == [i for _, i in brute(rows[:4])[0]]
    assert found(search(vectors([]))) == {}
    assert found(search(vectors(rows[:1]))) == {}


def test_neighbours_rotation_keeps_lengths_and_cells():
    rng = np.random.default_rng(3)
    u = rng.standard_normal((50, 20))
    u /= np.linalg.norm(u, axis=1)[:, None]
    np.testing.assert_allclose(np.linalg.norm(crosspoly.turned(u, 0), axis=1), 1)
    own, asked = crosspoly.cells(u, 3), crosspoly.cells(u, 3, 5).reshape(50, 3, 5)
    assert all(own[i, t] in asked[i, t] for i in range(50) for t in range(3))
    np.testing.assert_array_equal(crosspoly.cells(u[7:8], 3), own[7:8])


# Fill-in-middle -------------------------------------------------------------
def expected(i, text):
    text = text or ""
    units = re.findall(r"[A-Za-z]+|[^A-Za-z]", text, re.S)
    h = hashlib.sha256(f"1:{'' if i is None else i}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * k:8 * k + 8], 16) for k in range(4))
    n = len(units)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return n, "plain", None, None, text
    if h4 % 100 < 20:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


ODD = [None, "", " ", "a", "ab cd", "<", "<<P", "P>", "<P>", "x<S>y", "<M", "S><M", "é", "aéb", "日本語 text", "\u0000a",
       "🙂🙂a🙂", "a" * 1000, "\n\t\r ", "@[`{AZaz", "word " * 300, "ß" * 77 + "xyz", "M><<S", "<S <P <M"]


def test_fim_matches_units(spark, frame):
    rows = [(i * 7 - 20, t) for i, t in enumerate(ODD * 3)] + [(None, "no id"), (5, "same id"), (5, "same id")]
    got = fim.transform(frame(rows)).withColumn("back", fim.restored()).collect()
    key = lambda r: (str(r[0]), str(r))
    assert sorted([(r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output) for r in got], key=key) == \
        sorted([(i, *expected(i, t)) for i, t in rows], key=key)
    back = defaultdict(list)
    for i, t in rows:
        back[i].append(t or "")
    for r in got:
        assert r.back in back[r.doc_id]
    assert {r.form for r in got} == {"plain", "psm", "spm"}
    assert fim.digest(fim.transform(frame([]))).count() == 0


def test_fim_very_long_text(spark, frame):
    text = ("Wort für Wort, 語 " * 170_000)[:2_700_000] + "z" * 300_000
    r = fim.transform(frame([(3, text), (4, "short")])).withColumn("back", fim.restored()).filter("doc_id = 3").first()
    assert (r.n, r.form, r.prefix_chars, r.middle_chars, r.output) == expected(3, text)
    assert r.back == text


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from("aZ@[`{ é日🙂<P>\n"), max_size=40), max_size=8), st.integers(0, 99),
       st.integers(0, 99))
def test_fim_marks_and_places(texts, x, y):
    raw = [t.encode() for t in texts]
    off = np.cumsum([0] + [len(r) for r in raw])
    n, a, b, pre, mid = fim.cut(np.frombuffer(b"".join(raw), np.uint8), off, np.full(len(raw), x), np.full(len(raw), y))
    for i, t in enumerate(texts):
        units = re.findall(r"[A-Za-z]+|[^A-Za-z]", t, re.S)
        u, v = sorted((x % (len(units) + 1), y % (len(units) + 1)))
        p, m = "".join(units[:u]), "".join(units[u:v])
        assert (n[i], a[i] - off[i], b[i] - a[i], pre[i], mid[i]) == (len(units), len(p.encode()), len(m.encode()),
                                                                      len(p), len(m))


# Prefix trie ----------------------------------------------------------------
TURN = T.StructType([T.StructField("conv_id", T.LongType()), T.StructField("turn", T.IntegerType()),
                     T.StructField("role", T.StringType()), T.StructField("text", T.StringType()),
                     T.StructField("depth", T.StringType()), T.StructField("pos", T.StringType()),
                     T.StructField("n", T.StringType())])


def nodes_by_hand(rows, group=100, most=6):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            r, t = role or "", text or ""
            step = hashlib.sha256(f"{len(r)}:{r}{t}".encode()).hexdigest()
            own[c].append((turn is not None, turn or 0, step, (r, t)))
    own = {c: [x[-1] for x in sorted(v)] for c, v in own.items()}
    made = {}
    for c, v in own.items():
        h = zlib.crc32(str(c).encode()) % most
        base = int(np.fmod(c, group))
        made[c] = own.get(c - base, [])[:h] + v[h:]
    members, ends = defaultdict(list), defaultdict(list)
    for c, v in made.items():
        for d in range(len(v) + 1):
            members[tuple(v[:d])].append(c)
        ends[tuple(v)].append(c)
    kids = defaultdict(list)
    for k in members:
        if k:
            kids[k[:-1]].append(k)
    out = {}
    for k in sorted(members, key=len, reverse=True):
        leaves = sum(out[x][5] for x in kids[k]) or 1
        saved = sum(out[x][6] for x in kids[k]) + (len(members[k]) - 1) * (len(k[-1][1]) if k else 0)
        sha = hashlib.sha256(",".join(map(str, sorted(ends[k]))).encode()).hexdigest()
        out[k] = (min(members[k]), len(k), min(members[k[:-1]]) if k else None, len(members[k]), len(kids[k]), leaves,
                  saved, sha)
    return sorted(out.values(), key=str)


def made(spark, rows):
    return spark.createDataFrame([(*r, "x", "y", "z") for r in rows], TURN)


def some_turns(seed, convs, longest):
    rng = np.random.default_rng(seed)
    rows = []
    for c in convs:
        for t in range(int(rng.integers(1, longest))):
            text = ["", None, "hello", "héllo 語", "yes", "no"][int(rng.integers(0, 6))]
            rows.append((int(c), t, ["user", "bot", None][t % 3], text))
    return rows


def run(spark, rows, held=prefix_trie.HELD):
    steps = prefix_trie.turns(made(spark, rows))
    return sorted([tuple(r) for r in prefix_trie.trie(*prefix_trie.rebuilt(steps), held=held).select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256").collect()],
        key=str)


def test_trie_matches_brute_force(spark):
    rows = some_turns(1, [*range(0, 60), *range(95, 140), 250, 251, -7, -107, -100], 9)
    rows += [(7, None, "user", "before all"), (7, 2, "user", "tie"), (7, 2, "user", "tie"), (7, 2, "a", "tie"),
             (None, 1, "user", "no conversation"), (300, None, None, None)]
    assert run(spark, rows) == nodes_by_hand(rows)


def test_trie_bands_and_spills(spark, monkeypatch):
    """Narrow bands and a queue of two entries change nothing."""
    rows = some_turns(2, [*range(0, 40), 100, 101, 102], 14)
    want = nodes_by_hand(rows)
    monkeypatch.setattr(prefix_trie, "BAND", 3)
    assert run(spark, rows, held=2) == want


def test_trie_odd_tables(spark):
    assert run(spark, []) == []
    assert run(spark, [(None, 1, "a", "b")]) == []
    one = [(11, 1, "user", "only")]                       # turnless where its first turns are dropped
    assert run(spark, one) == nodes_by_hand(one)
    lone = [(c, 1, "user", "x") for c in (1, 2, 3, 4, 5, 6, 7)]
    assert run(spark, lone) == nodes_by_hand(lone)
    same = [(c, t, "user", "same") for c in range(120) for t in range(3)]
    assert run(spark, same) == nodes_by_hand(same)


def test_waiting_totals_spill():
    rng = np.random.default_rng(4)
    entries = [tuple(int(x) for x in rng.integers(-3, 3, 3)) + (1, 2) for _ in range(500)]
    q = prefix_trie.WaitingTotals(held=7)
    for e in entries:
        q.put(e)
    assert [q.take() for _ in range(500)] == sorted(entries)
    assert q.least() is None
