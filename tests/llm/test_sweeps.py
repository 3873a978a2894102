"""Sweeps and flows on long texts and many patterns, against plain versions."""

import random
import time

import pytest
from llm_help import frame  # noqa: F401
from pyspark.sql import functions as F

from tripframe.llm import catalog, mixing, secret_scan, toxicity, urls


def plain_spans(text):
    """Spans of a text where every entropy span is held against every base span."""
    base = [s for s in secret_scan.find(text) if s[0] != "entropy"]
    more = []
    for m in secret_scan.CANDIDATE.finditer(text):
        if any(a.fullmatch(m.group()) for a in secret_scan.ALLOW):
            continue
        for s, e in secret_scan.entropy_spans(m.group()):
            free = [i for i in range(s + m.start(), e + m.start())
                    if not any(x <= i < y for _, x, y in base)]
            for i in free:
                if more and more[-1][2] == i and i - 1 in free:
                    more[-1] = ("entropy", more[-1][1], i + 1)
                else:
                    more.append(("entropy", i, i + 1))
    return sorted(base + more, key=lambda x: (x[1], secret_scan.KINDS.index(x[0]), x[2]))


def noisy(rng, n):
    abc = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"
    parts = []
    for _ in range(n):
        kind = rng.randrange(5)
        run = "".join(rng.choices(abc, k=rng.randrange(5, 70)))
        parts.append(["token=" + run, "AKIA" + run.upper(), "".join(rng.choices("0123456789abcdef", k=rng.randrange(4, 40))),
                      run + "0123456789abcdef" * rng.randrange(2) + run, "plain words"][kind])
    return rng.choice([" ", "", "-"]).join(parts)


def test_secret_sweep_matches_plain():
    rng = random.Random(5)
    for n in [1, 2, 3, 5, 8] * 12:
        text = noisy(rng, n)
        assert secret_scan.find(text) == plain_spans(text)


def test_secret_sweep_of_a_long_text_is_linear():
    rng = random.Random(1)
    seconds = []
    for n in (4_000, 16_000):
        text = noisy(random.Random(2), 1) + " " + " ".join(noisy(rng, 1) for _ in range(n))
        at = time.process_time()
        assert secret_scan.find(text)
        seconds.append(time.process_time() - at)
    assert seconds[1] < 8 * seconds[0] + 0.5


def plain_features(text, lexicon, exceptions):
    t = toxicity.fold(text)

    def places(word):
        at = t.find(word)
        while at >= 0:
            yield at, at + len(word)
            at = t.find(word, at + 1)

    free = [p for x in exceptions for p in places(toxicity.fold(x))]
    best = {}
    for word, w in lexicon.items():
        for s, e in places(word):
            if not any(x <= s and e <= y for x, y in free):
                best[s] = max(w, best.get(s, w))
    return sum(best.values())


def test_toxic_sweep_matches_plain_matching():
    import math
    rng = random.Random(3)
    lexicon = {" trash ": 2.0, " tra": 0.5, " clown": 1.5, " sore ": 0.75, " idiot ": 3.0}
    words = ["trash", "can", "bag", "traffic", "clown", "fish", "class", "sore", "loser", "idiot", "proof", "fine"]
    m = toxicity.Matcher(lexicon, toxicity.EXCEPTIONS)
    for n in [0, 1, 3, 10, 60] * 20:
        text = " ".join(rng.choices(words, k=n))
        assert m.features(text)[0] == pytest.approx(math.log1p(plain_features(text, lexicon, toxicity.EXCEPTIONS)))


def test_toxic_sweep_of_a_long_text():
    m = toxicity.Matcher({" trash ": 2.0}, toxicity.EXCEPTIONS)
    at = time.process_time()
    a, _ = m.features("trash can trash " * 300_000)
    assert a > 0 and time.process_time() - at < 20


def test_held_out_of_rows_without_id_and_clashing_names(spark, frame, tmp_path):
    docs = frame([(1, "a"), (None, "b"), (None, None)])
    docs.drop("own", "part", "size").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    got = next(v for k, v in catalog.QUERIES.items() if k.startswith("op7_"))(spark, str(tmp_path)).collect()
    assert len(got) == 3 and [r.held_out for r in got if r.doc_id is None] == [False, False]
    model = toxicity.Model({" a ": 1.0}, (0.0, 1.0, 1.0))
    own = toxicity.scored(docs.withColumn("_tox", F.lit("mine")), model).first()
    assert own["_tox"] == "mine" and 0 <= own["score"] <= 1


def plain_route(patterns, quota, passes):
    """(words routed, cost) by cheapest paths one after another (Bellman and Ford)."""
    names = list(quota)
    n = 2 + len(patterns) + len(names)
    edges = []

    def edge(a, b, c, w):
        edges.extend([[a, b, c, w], [b, a, 0, -w]])

    for i, (members, words) in enumerate(patterns):
        for p in range(passes):
            edge(0, 2 + i, words, p)
        for s in members:
            edge(2 + i, 2 + len(patterns) + names.index(s), passes * words, 0)
    for j, s in enumerate(names):
        edge(2 + len(patterns) + j, 1, round(quota[s]), 0)
    flow = cost = 0
    while True:
        dist, via = [float("inf")] * n, [None] * n
        dist[0] = 0
        for _ in range(n):
            for k, (a, b, c, w) in enumerate(edges):
                if c > 0 and dist[a] + w < dist[b]:
                    dist[b], via[b] = dist[a] + w, k
        if via[1] is None:
            return flow, cost
        path, a = [], 1
        while a != 0:
            path.append(via[a])
            a = edges[via[a]][0]
        move = min(edges[k][2] for k in path)
        for k in path:
            edges[k][2] -= move
            edges[k ^ 1][2] += move
        flow, cost = flow + move, cost + move * dist[1]


def test_route_matches_cheapest_paths():
    rng = random.Random(11)
    for _ in range(60):
        names = ["a", "b", "c", "d"][:rng.randrange(1, 5)]
        passes = rng.randrange(1, 4)
        found = {tuple(sorted(rng.sample(names, rng.randrange(1, len(names) + 1)))): rng.randrange(0, 30) for _ in range(6)}
        patterns = list(found.items())
        quota = {s: float(rng.randrange(0, 80)) for s in names}
        got = mixing.route(patterns, quota, passes)
        flow = cost = 0
        charged = dict.fromkeys(names, 0)
        for (members, words), f in zip(patterns, got):
            assert set(f) <= set(members) and sum(f.values()) <= passes * words
            for s, v in f.items():
                charged[s] += v
            left = sum(f.values())
            flow += left
            for p in range(passes):
                cost += p * min(words, left)
                left -= min(words, left)
        assert all(charged[s] <= quota[s] for s in names)
        assert (flow, cost) == plain_route(patterns, quota, passes)


def test_route_of_ten_thousand_patterns():
    rng = random.Random(2)
    names = [f"s{i}" for i in range(40)]
    patterns = [(tuple(rng.sample(names, rng.randrange(1, 5))), rng.randrange(1, 10_000)) for _ in range(10_000)]
    total = sum(n for _, n in patterns)
    quota = mixing.targets([(s, sum(n for m, n in patterns if s in m)) for s in names], total=total)
    at = time.process_time()
    got = mixing.route(patterns, quota)
    assert time.process_time() - at < 20
    assert sum(sum(f.values()) for f in got) == pytest.approx(min(2 * total, sum(round(q) for q in quota.values())), rel=1e-6)


def test_url_filter_with_many_pages_of_no_or_one_url(spark):
    pages = spark.range(3000).selectExpr(
        "id as page_id", "case id % 3 when 0 then null when 1 then 'http://www.bad.net/p/' else concat('http://h', id, '.net/') end as url")
    listed = spark.createDataFrame([("http://bad.net/p?utm_source=x",), ("http://bad.net/p",)], "url string")
    got = urls.judge(pages, listed)
    assert got.count() == 3000
    assert {r.page_id for r in got.filter("listed").collect()} == set(range(1, 3000, 3))
    assert urls.possible(got, listed.select(urls.canonical(F.col("url")).alias("canon")).distinct()).count() < 100
