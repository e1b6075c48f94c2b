"""Operators on literals, and every registered query against its SQL."""

import math
import random
import re
import time

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from sitequarry.functions import text as t
from sitequarry.functions import url as u
from sitequarry.operators import audit, content, documents, dom, fetch, forecast, graph, html, logs, publish, reports, robots, rules, search, similarity
from sitequarry.operators import store as s
from sitequarry.plans import registry
from sitequarry.sources import config, readers
from sitequarry.streaming import events

SMALL = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def duck():
    c = duckdb.connect()
    for name in TABLES:
        c.execute(f"create view {name} as select * from read_parquet('{SMALL}/{name}.parquet')")
    return c


def rows_of(pdf):
    columns = sorted(pdf.columns)
    return columns, sorted(map(str, pdf[columns].itertuples(index=False, name=None)))


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_is_its_sql(spark, duck, name):
    got = rows_of(registry.QUERIES[name](spark, SMALL).toPandas())
    want = rows_of(duck.execute(registry.ORACLES[name]).df())
    assert got == want


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLES)))
def test_query_without_sql_has_rows(spark, name):
    assert registry.QUERIES[name](spark, SMALL).count() > 0


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "v string").select(f(F.col("v")).alias("r")).head().r


@pytest.mark.parametrize(
    ("f", "value", "want"),
    [
        (u.clean, "https://Quarry.Example:443/Stones/?utm_medium=mail&size=9&gclid=7&colour=grey#top", "https://quarry.example/stones?colour=grey&size=9"),
        (u.clean, "http://quarry.example:80//pits//north/", "http://quarry.example/pits/north"),
        (u.normalize, "https://X.com/a//?q=1#f", "https://x.com/a/"),
        (u.normalize, " Not a url/ ", "not a url"),
        (u.candidate, "https://Quarry.EXAMPLE/Pit?z=2&UTM_TERM=x&y=1&gclid=q#end", "https://quarry.example/Pit?z=2&y=1"),
        (u.candidate, "https://quarry.example:9000/p?k=1&k=2", "https://quarry.example:9000/p?k=1&k=2"),
        (u.candidate, "ftp://quarry.example/", None),
        (u.candidate, "https://me:secret@quarry.example/", None),
        (u.root_domain, "www.Pit.Quarry.org/way", "pit.quarry.org"),
        (u.publisher, "https://stones.medium.com/y", "medium.com"),
        (u.is_trap, "https://x.org/pit/wall/pit/wall/pit/wall", True),
        (u.is_trap, "https://x.org/k/l/m/k/l/m", True),
        (u.is_trap, "https://x.org/k/l/m/n", False),
        (lambda c: t.syllables(c), "granite", 2),
        (lambda c: t.syllables(c), "quarry", 2),
        (lambda c: t.syllables(c), "pit", 1),
        (lambda c: t.intent(c)["primary"], "how to split slate by hand", "informational"),
        (lambda c: t.intent(c)["primary"], "best stone saws this year", "commercial"),
        (lambda c: t.intent(c)["primary"], "buy cheap gravel", "transactional"),
        (lambda c: t.intent(c)["primary"], "quarry login dashboard", "navigational"),
        (lambda c: t.difficulty(c, t.intent(c)["primary"]) >= 75, "slate", True),
        (lambda c: t.anchor_class(c, "Quarry", ["fine slate"]), "Click Here", "generic"),
        (lambda c: t.anchor_class(c, "Quarry", ["fine slate"]), "fine slate", "exact_match"),
        (lambda c: t.anchor_class(c, "Quarry", ["fine slate roofs"]), "roofs of old", "partial_match"),
        (lambda c: t.anchor_class(c), "https://x.com", "naked_url"),
        (lambda c: t.anchor_class(c), " ", "empty_image"),
        (lambda c: t.fnv1a32(c), "pit", 1497424882),
        (lambda c: logs.bot(c), "Mozilla/5.0 (compatible; OAI-SearchBot/1.0)", "OAI-SearchBot"),
        (lambda c: logs.bot(c), "curl/8", "Other bot"),
        (lambda c: logs.bot(c), None, "Human"),
        (lambda c: content.failure_class(c, F.lit(0)), "request timed out", "connection_timeout"),
        (lambda c: content.failure_class(c, F.lit(200)), "", None),
    ],
)
def test_functions(spark, f, value, want):
    assert one(spark, value, f) == want


def test_soft_404(spark):
    d = spark.createDataFrame([(200, "404 - Page Not Found", "", "", 15), (200, "Plot 404 of the pit", "Plot", "long text", 900), (404, "404", "", "", 1)], "status int, title string, h1 string, body string, n int")
    got = [r.s for r in d.select(t.soft404_score(F.col("status"), F.lit("https://x/"), F.col("title"), F.col("h1"), F.col("body"), F.col("n"), F.lit(None).cast("string")).alias("s")).collect()]
    assert got[0] >= 45 > got[1] and got[2] == 0


def test_log_lines(spark):
    lines = [
        '1.2.3.4 - - [10/Oct/2026:13:00:00 +0200] "GET /ok HTTP/1.1" 200 512 "-" "Mozilla/5.0 (compatible; Googlebot/2.1)"',
        '1.2.3.4 - - [10/Oct/2026:13:00:01 +0000] "GET /dead?utm_source=x HTTP/1.1" 404 - "-" "Googlebot"',
        '{"url": "/j", "status": 500, "userAgent": "GPTBot", "timestamp": 10}',
        "{broken", "", "no log",
    ]
    log = logs.entries(spark.createDataFrame([(x,) for x in lines], "value string"))
    got = {r.url: (r.bot, r.status, r.bytes) for r in log.collect()}
    assert got == {"/ok": ("Googlebot", 200, 512), "/dead?utm_source=x": ("Googlebot", 404, 0), "/j": ("GPTBot", 500, 0)}
    assert {r.kind: r.hits for r in logs.waste(log).collect()} == {"Bot hits to 404 dead URLs": 1, "Bot hits to 5xx error URLs": 1, "Bot hits to parameterised / ad-tagged URLs": 1}
    known = spark.createDataFrame([("https://x/ok", 200, "/ok"), ("https://x/hidden", 200, "/hidden")], "url string, status int, path string")
    assert [r.url for r in logs.never_crawled(known, log).collect()] == ["https://x/hidden"]


def test_robots(spark):
    text = "User-agent: *\nDisallow: /pit/\nDisallow: /log/\nAllow: /log/open/\n\nUser-agent: GPTBot\nDisallow: /\n\nUser-agent: Googlebot\nDisallow: /own/"
    found = robots.rules(spark.createDataFrame([(1, text)], "k int, x string"), "k", "x")
    paths = spark.createDataFrame([(1, p) for p in ("/pit/a", "/log/open/x", "/log/x", "/own/p", "/")], "k int, path string")
    allowed = lambda agent: {r.path for r in robots.verdicts(found, "k", paths, agent).where("allowed").collect()}
    assert allowed("Other") == {"/log/open/x", "/own/p", "/"}
    assert allowed("GPTBot") == set()
    assert allowed("Googlebot") == {"/pit/a", "/log/open/x", "/log/x", "/"}


def test_forecast_invariants():
    import numpy as np

    f, _ = forecast.model(np.array([42.0]), 5, 7)
    assert list(f.p50) == [42.0] * 5
    f, _ = forecast.model(np.arange(10.0, 26.0, 2.0), 7, 7)
    assert (np.diff(f.p50) > 0).all() and (f.p10 <= f.p50).all() and (f.p50 <= f.p90).all()
    assert (f.p90 - f.p10).iloc[-1] > (f.p90 - f.p10).iloc[0]
    _, a = forecast.model(np.array([100, 102, 99, 101, 100, 98, 102, 101, 250, 100, 101, 99, 10, 98, 101, 100.0]), 3, 7)
    assert {(r.i, r.kind, r.severity) for r in a.itertuples()} >= {(8, "spike", "critical"), (12, "drop", "critical")}
    f, _ = forecast.model(np.array([50, 40, 30, 20, 10, 5, 2.0]), 10, 7, 0.0, 100.0)
    assert f.min().min() >= 0 and f.p90.max() <= 100


def plain_forecast(values, horizon, default):
    """(p10, p50, p90) by step, and the z score of each point, in plain sums."""
    n = len(values)
    w = [math.exp((i - n) / (0.75 * n)) for i in range(n)]
    mx, my = sum(a * i for i, a in enumerate(w)) / sum(w), sum(a * v for a, v in zip(w, values, strict=True)) / sum(w)
    slope = sum(a * (i - mx) * (v - my) for i, (a, v) in enumerate(zip(w, values, strict=True))) / sum(a * (i - mx) ** 2 for i, a in enumerate(w))
    start = my - slope * mx
    mean = sum(values) / n
    c = [v - mean for v in values]
    power = sum(x * x for x in c)
    season = 1
    if n >= 2 * default and power:
        score = {k: sum(c[i] * c[i + k] for i in range(n - k)) / power for k in range(2, min(n // 2, 30) + 1)}
        best = max(score, key=score.get)
        season = best if score[best] > 0.35 else 1
    rest = [v - start - slope * i for i, v in enumerate(values)]
    parts = [sum(rest[k::season]) / len(rest[k::season]) for k in range(season)]
    error = [r - parts[i % season] for i, r in enumerate(rest)]
    sigma = math.sqrt(sum(e * e for e in error) / max(1, n - 1))
    sigma = sigma if sigma >= 0.05 else max(0.05 * abs(values[-1]), 0.2)
    middle = sorted(error)[n // 2]
    mad = sorted(abs(e - middle) for e in error)[n // 2] or sigma
    scale = max(1.4826 * mad, 0.5 * sigma, 0.1)
    out, trend = [], start + slope * (n - 1)
    for h in range(1, horizon + 1):
        trend += slope * 0.96**h
        point = trend + parts[(n - 1 + h) % season] + sum(error[-3:]) / len(error[-3:]) * math.exp(-0.25 * h)
        width = 1.282 * sigma * math.sqrt(1 + 0.18 * (h - 1))
        out.append((point - width, point, point + width))
    return out, [e / scale for e in error]


def test_forecasts_and_anomalies_are_those_of_plain_sums(spark):
    rng = random.Random(3)
    series = {"flat": [5.0 + rng.random() for _ in range(20)], "season": [10 + i + [0, 3, 6, 2, 1, 0, 8][i % 7] + rng.random() for i in range(42)], "spike": [100.0] * 9 + [300.0] + [100.0] * 8, "two": [1.0, 2.0]}
    d = spark.createDataFrame([(k, i, v) for k, vs in series.items() for i, v in enumerate(vs)], "k string, i int, v double")
    got = {}
    for r in forecast.forecast(d, "k", "i", "v", 9).collect():
        got.setdefault(r.k, {})[r.step] = (r.p10, r.p50, r.p90)
    odd = {(r.k, r.i): r.z for r in forecast.anomalies(d, "k", "i", "v").collect()}
    for k, values in series.items():
        want, z = plain_forecast(values, 9, 7)
        assert [got[k][h] for h in range(1, 10)] == [pytest.approx(w, abs=0.011) for w in want], k
        assert {i for name, i in odd if name == k} == {i for i, x in enumerate(z) if abs(x) >= 2}
        assert all(odd[k, i] == pytest.approx(z[i], abs=0.011) for name, i in odd if name == k)


def test_graph(spark):
    nodes = spark.createDataFrame([(i,) for i in range(5)], "node long")
    edges = spark.createDataFrame([(0, 1), (1, 2), (2, 0), (3, 0)], "source long, target long")
    rank = {r.node: r.score for r in graph.pagerank(nodes, edges).collect()}
    assert rank[0] == 100 and rank[4] == rank[3] < rank[1]
    assert {r.node: r.level for r in graph.levels(nodes.where("node = 3"), edges).collect()} == {3: 0, 0: 1, 1: 2, 2: 3}
    assert graph.pagerank(nodes.limit(0), edges.limit(0)).count() == 0


def test_near_pairs_and_simhash(spark):
    base = " ".join(f"w{i}" for i in range(80))
    d = spark.createDataFrame([(1, base), (2, base.replace("w79", "x")), (3, " ".join(f"v{i}" for i in range(80))), (4, base.upper())], "k long, x string")
    assert [(r.a, r.b) for r in similarity.near_pairs(d, "k", "x").collect()] == [(1, 2)]
    assert similarity.exact_groups(d, "k", "x").head().n == 2
    prints = d.select("k", similarity.simhash(F.col("x")).alias("print"))
    assert (1, 4) in {(r.a, r.b) for r in similarity.simhash_pairs(prints).collect()}
    assert prints.where("k = 3").head().print != prints.where("k = 1").head().print


def plain_fnv(data, units=None):
    h = 0xCBF29CE484222325
    for x in data:
        h = (h ^ x) * 0x100000001B3 % 2**64
    return h - (h >> 63 << 64)


def plain_votes(text):
    words = [w for w in re.sub(r"[^a-z0-9_\s]", " ", (text or "").lower()).split() if len(w) > 2]
    out = [0] * 64
    for g in words + [f"{a} {b}" for a, b in zip(words, words[1:], strict=False)]:
        h = plain_fnv(g.encode()) % 2**64
        out = [v + (1 if h >> i & 1 else -1) for i, v in enumerate(out)]
    return out


def plain_print(text):
    h = sum(1 << i for i, v in enumerate(plain_votes(text)) if v > 0)
    return h - (h >> 63 << 64)


def bits_apart(a, b):
    return bin((a ^ b) % 2**64).count("1")


def test_prints_are_weighted_votes_of_fnv(spark):
    texts = ["", None, "ab cd", "the cat the cat sat", "Ünï çödé wörds here", "x" * 5000 + " tail of it", " ".join(f"word{i}" for i in range(700))]
    d = spark.createDataFrame(list(enumerate(texts)), "k long, x string").repartition(2)
    got = {r.k: r for r in d.select("k", similarity.simhash(F.col("x")).alias("print"), similarity.votes(F.col("x")).alias("votes"), similarity.hash_text(F.col("x")).alias("h")).collect()}
    for i, x in enumerate(texts):
        assert got[i].votes == plain_votes(x) and got[i].print == plain_print(x), x
        assert got[i].h == (None if x is None else plain_fnv(x.encode("utf-16-le")[j] | x.encode("utf-16-le")[j + 1] << 8 for j in range(0, 2 * len(x), 2)))
    assert plain_fnv(b"hello") % 2**64 == 0xA430D84680AABD0B


def test_near_prints_and_clusters_are_those_of_all_pairs(spark):
    rng = random.Random(5)
    prints = []
    for _ in range(12):
        base = rng.getrandbits(64)
        for _ in range(12):
            x = base
            for bit in rng.sample(range(64), rng.choice([0, 0, 1, 3, 6, 7])):
                x ^= 1 << bit
            prints.append(x - (x >> 63 << 64))
    rng.shuffle(prints)
    d = spark.createDataFrame(list(enumerate(prints)), "k long, print long")
    least = {x: prints.index(x) for x in prints}
    want = {(least[x], i, 0) for i, x in enumerate(prints) if least[x] != i}
    one = sorted(least.values())
    want |= {(i, j, n) for i in one for j in one if i < j and (n := bits_apart(prints[i], prints[j])) <= 6}
    assert {(r.a, r.b, r.distance) for r in similarity.simhash_pairs(d).collect()} == want
    left, clusters = list(range(len(prints))), set()
    while left:
        centre, *rest = left
        own = [i for i in rest if bits_apart(prints[centre], prints[i]) <= 6]
        clusters |= {(centre, i) for i in own}
        left = [i for i in rest if i not in own]
    got = {(r.centre, r.k): r for r in similarity.simhash_clusters(d).collect()}
    assert set(got) == clusters
    assert all(r.distance == bits_apart(prints[c], prints[k]) and r.similarity == int((64 - r.distance) / 64 * 100 + 0.5) for (c, k), r in got.items())


def test_near_prints_are_counted_without_being_listed(spark, monkeypatch):
    rng = random.Random(7)
    base = rng.getrandbits(64)
    flips = [0, *(1 << i for i in range(64)), *(1 << i | 1 << j for i in range(64) for j in range(i))]
    prints = [base ^ f for f in rng.sample(flips, 1500)] + [rng.getrandbits(64) for _ in range(50)]
    prints += prints[:3]
    signed = [x - (x >> 63 << 64) for x in prints]
    d = spark.createDataFrame(list(enumerate(signed)), "k long, print long")
    rows, plain = [], similarity.cut

    def noted(df):
        out = plain(df)
        rows.append(out.count())
        return out

    monkeypatch.setattr(similarity, "cut", noted)
    centres = {r.k: r.centre for r in similarity.simhash_clusters(d).collect()}
    assert max(rows) <= 28 * len(prints)  # 1,124,250 pairs
    assert centres == dict.fromkeys([*range(1, 1500), *range(1550, 1553)], 0)
    for most in (similarity.MOST_ROWS, 100):
        got = {r.k: (r.component, r.n_links) for r in similarity.simhash_links(d, most).collect()}
        assert got == {i: (0, 1502) if i < 1500 or i > 1549 else (i, 0) for i in range(1553)}


@pytest.mark.parametrize("most", [4096, 6])
def test_links_and_clusters_with_and_without_pieces(spark, most):
    rng = random.Random(8)
    prints = [rng.getrandbits(64) for _ in range(6)]
    for _ in range(150):
        x = rng.choice(prints)
        for bit in rng.sample(range(64), rng.choice([0, 2, 4, 6, 7])):
            x ^= 1 << bit
        prints.append(x)
    rng.shuffle(prints)
    d = spark.createDataFrame([(i, x - (x >> 63 << 64)) for i, x in enumerate(prints)], "k long, print long")
    near = [[j for j, y in enumerate(prints) if j != i and bits_apart(x, y) <= 6] for i, x in enumerate(prints)]
    low = list(range(len(prints)))
    while (new := [min([low[i], *(low[j] for j in near[i])]) for i in range(len(low))]) != low:
        low = new
    assert {r.k: (r.component, r.n_links) for r in similarity.simhash_links(d, most).collect()} == {i: (low[i], len(near[i])) for i in range(len(low))}
    # A taken print is no centre.
    taken, want = set(), {}
    for i in range(len(prints)):
        if i not in taken:
            own = [j for j in near[i] if j > i and j not in taken]
            taken |= set(own)
            want |= dict.fromkeys(own, i)
    assert {r.k: r.centre for r in similarity.simhash_clusters(d, most).collect()} == want


def test_every_document_has_its_links(spark):
    got = registry.QUERIES["j_simhash_pairs"](spark, SMALL).collect()
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()
    assert sorted(r.doc_id for r in got) == sorted(r.doc_id for r in docs)
    prints = {r.doc_id: plain_print(r.text) for r in docs if r.text and len(r.text) >= 50}
    links = {a: sum(bits_apart(x, y) <= 6 for y in prints.values()) - 1 for a, x in prints.items()}
    assert {r.doc_id: r.n_links for r in got} == {r.doc_id: links.get(r.doc_id, 0) for r in docs}


def plain_members(prints):
    """{k: (centre, component, n_links)} of {k: print} by all pairs."""
    near = {i: [j for j in prints if j != i and bits_apart(prints[i], prints[j]) <= 6] for i in sorted(prints)}
    low, centre = {i: i for i in near}, {}
    while (new := {i: min([low[i], *(low[j] for j in near[i])]) for i in near}) != low:
        low = new
    for i in near:
        if i not in centre:
            centre |= {j: i for j in [i, *near[i]] if j not in centre and j >= i}
    return {i: (centre[i], low[i], len(near[i])) for i in near}


@pytest.mark.parametrize("few", [0, 20_000])
def test_links_between_clusters_are_kept(spark, few):
    rng = random.Random(9)
    prints = [0]
    for _ in range(14):  # a chain, of which each is near the next ones only
        prints.append(prints[-1] | sum(1 << b for b in rng.sample([b for b in range(64) if not prints[-1] >> b & 1], 4)))
    prints += [rng.getrandbits(64) for _ in range(3)] + prints[3:5]
    rng.shuffle(prints)
    signed = {i: x - (x >> 63 << 64) for i, x in enumerate(prints)}
    d = spark.createDataFrame(list(signed.items()), "k long, print long")
    got = {r.k: r for r in similarity.simhash_members(d, few=few).collect()}
    want = plain_members(signed)
    assert len({c for c, low, _ in want.values()}) > len({low for _, low, _ in want.values()})
    assert {k: (r.centre, r.component, r.n_links) for k, r in got.items()} == want
    assert all(r.distance == bits_apart(signed[k], signed[r.centre]) for k, r in got.items())


def test_every_document_has_its_cluster_and_links(spark):
    got = registry.QUERIES["d_simhash_clusters"](spark, SMALL).collect()
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()
    want = {r.doc_id: (r.doc_id, r.doc_id, 0) for r in docs} | plain_members({r.doc_id: plain_print(r.text) for r in docs if r.text and len(r.text) >= 50})
    assert len(got) == len(docs) and {r.doc_id: (r.centre, r.component_id, r.n_links) for r in got} == want
    texts = [r.text for r in docs if r.text and len(r.text) >= 50]
    assert sum(r.doc_id != r.centre for r in got) >= len(texts) - len(set(texts)) > 0


def test_components_and_stars_of_long_chains(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, i) for i in range(101, 130)] + [(7, 7)]
    e = spark.createDataFrame(edges, "a long, b long")
    assert {r.node: r.component for r in graph.components(e).collect()} == {**dict.fromkeys(range(61), 0), **dict.fromkeys(range(100, 130), 100)}
    chain = spark.createDataFrame(edges[:7] + edges[60:], "a long, b long")
    assert {r.node: r.centre for r in graph.stars(chain).collect()} == {0: 0, 1: 0, 2: 2, 3: 2, 4: 4, 5: 4, 6: 6, 7: 6, **dict.fromkeys(range(100, 130), 100)}
    assert graph.components(e.limit(0)).count() == graph.stars(e.limit(0)).count() == 0


def test_competing_pages_are_those_of_all_pairs(spark):
    rng = random.Random(6)
    words = [f"word{i}" for i in range(30)]
    rows = []
    for i in range(120):
        title = " ".join(["common", "shared", *rng.sample(words, rng.randint(0, 4))]) if i % 4 else rng.choice(["", "red shoes", "common shared", "blue"])
        rows.append((i, title, rng.choice(["", "", "Head One", title]), f"https://x.org/{rng.choice(words)}" if i % 3 else "https://x.org/", 200 if i % 10 else 404))
    pages = spark.createDataFrame(rows, "page_id long, title string, h1 string, url string, status int")
    own = {r.page_id: (r.title.lower().strip(), r.h1.lower().strip(), frozenset(r.w)) for r in pages.where("status = 200").select("page_id", "title", "h1", t.intent_tokens(F.col("title"), F.col("h1"), F.col("url")).alias("w")).collect() if r.w}
    least = {}
    for i in sorted(own):
        least.setdefault(own[i], i)
    want = {}
    for x, a in least.items():
        for i, y in own.items():
            if a < i and (x == y or least[y] == i):
                shared, same = len(x[2] & y[2]), any(x[k] and x[k] == y[k] for k in (0, 1))
                ratio = shared / min(len(x[2]), len(y[2]))
                kind = "Critical" if same else "High" if ratio >= 0.7 or ratio >= 0.5 and shared >= 3 else "Medium" if ratio >= 0.4 and shared >= 2 else None
                if shared and kind:
                    want[a, i] = (shared, kind)
    assert {(r.a, r.b): (r.shared, r.severity) for r in similarity.competing(pages).collect()} == want


PAGE = """<!doctype html><html lang="en"><head><title>T</title><meta name="description" content="d"><meta name="description" content="e"><link rel="canonical" href="http://["><link rel="alternate" hreflang="e" href="/x">
<script type="application/ld+json">[{"@context":"https://schema.org","@type":"NewsArticle","headline":"H","author":"A"},{"@type":"FAQPage","mainEntity":[{"name":"Q"}]}]</script></head>
<body><title>again</title><h1>One</h1><p>short</p><h2>Two</h2><div><div><p>%s</p></div></div><button aria-label="x"></button><button><img src="a.png"></button><label for="i">L</label><input id="i"><input><input type="hidden">
<p class="Price big">9</p><p class="big">8</p><ul data-k="v w"><li>a<li id="two">b</ul></body></html>""" % " ".join(["word"] * 30)


def test_details_of_pages():
    r = html.read(PAGE)
    assert html.answer(r.root) == " ".join(["word"] * 30)
    assert html.unlabelled(r.root) == (1, 1)
    assert (r.n["title"], r.n["title_outside"], r.n["description"], r.languages) == (2, 1, 2, ["e"])
    types, found = html.structured_data(r.ld)
    assert types == ["NewsArticle", "FAQPage"]
    assert found == [("rich", "Article lacks datePublished"), ("schema", "Article.author is a plain text"), ("schema", "context is None, not schema.org"), ("rich", "FAQPage member 0 lacks acceptedAnswer.text")]
    assert html.structured_data(["{"])[1][0][0] == "malformed" and html.structured_data(["{}", " "]) == ([], [("schema", "top level has neither @type nor @graph")])
    product = '{"@context":"https://schema.org","@type":["Product","Offer"],"name":"P","offers":{},"price":0,"priceCurrency":"EUR"}'
    assert [m for _, m in html.structured_data([product])[1]] == ["Product lacks offers|aggregateRating"] or html.structured_data([product])[1] == []
    assert html.answer(html.read("<h1>x</h1><h2>y</h2><p>" + "w " * 80).root) == ""


@pytest.mark.parametrize("part", ["<b>", "<div><p>x", "<li><input>", "<h2>a?", "</i><b>", "<a href=x><img src=y>"])
def test_broken_pages_cost_time_by_their_length(part):
    start = time.process_time()
    r = html.read(part * (200_000 // len(part)))
    html.unlabelled(r.root), html.answer(r.root), html.clean_text(r.root), html.questions(r.root)
    assert time.process_time() - start < 20 and r.n["max_depth"] <= html.DEEPEST


def test_selectors_and_paths():
    root = html.read(PAGE).root
    css = lambda s: [x.text() for x in root.walk() if dom.compiled(s)(x)]
    assert css("p.big") == ["9", "8"] and css("p.Price") == ["9"] and css("#two") == ["b"] and css("body > p.big, li") == ["9", "8", "a", "b"]
    assert css("ul[data-k~=w] li") == ["a", "b"] and css("ul[data-k^='v'] > #two") == ["b"] and css("div > p") == css("div div p") and css("[data-k$=x]") == []
    path = lambda p: [x if isinstance(x, str) else x.text() for x in dom.by_path(root, p)]
    assert path("//li") == ["a", "b"] and path("//li[2]/@id") == ["two"] and path("//p[@class='big']/text()") == ["8"] and path("//ul[contains(@data-k,'w')]/li[1]") == ["a"] and path("/html/body/h1") == ["One"]
    for bad in ("li >", "> li", "li[", "", "a:has(b)"):
        with pytest.raises(ValueError):
            dom.compiled(bad)
    for bad in ("li", "//li[", "//@id/x", ""):
        with pytest.raises(ValueError):
            dom.by_path(root, bad)


def test_rules_of_parsed_pages(spark):
    raw = spark.createDataFrame([(1, "http://x.org/a/a//b", PAGE), (2, "https://x.org/", None)], "page_id long, url string, html string")
    fetched = [(1, 200, 100, 900, 100, {"server": "nginx/1.2"}, ["http://x.org/", "https://x.org/c", "http://x.org/"], 5000.0, 0.2, True, ["FAQPage", "Person"]), (2, 0, 0, 0, 0, {}, None, None, None, False, [])]
    f = spark.createDataFrame(fetched, "page_id long, status int, html_chars long, ttfb_ms int, response_ms int, headers map<string,string>, chain array<string>, lcp double, cls double, robots_blocked boolean, expected array<string>")
    found = {(r.page_id, r.issue_id): r.severity for r in rules.issues(html.extract(raw).join(f, "page_id")).collect()}
    one = {i for p, i in found if p == 1}
    assert one >= {"title_multiple", "title_outside_head", "meta_desc_multiple", "hreflang_invalid", "url_duplicate_path", "url_double_slash", "insecure_http_page", "redirect_3xx", "redirect_chain_long", "redirect_loop", "cwv_lcp_poor", "cwv_cls_poor"}
    assert one >= {"schema_google_rich_results_error", "schema_org_validation_error", "schema_missing_expected", "a11y_button_name", "a11y_input_label", "blocked_by_robots", "low_word_count", "server_version_exposed", "slow_ttfb"}
    assert not one & {"schema_missing", "aeo_no_definition_snippet", "schema_malformed_jsonld", "page_unreachable", "cwv_inp_poor", "http_to_https_redirect"}
    assert found[1, "cwv_lcp_poor"] == "Warning" and found[1, "cwv_cls_poor"] == "Notice" and found[1, "low_word_count"] == "Warning"
    assert (2, "page_unreachable") in found and (2, "schema_missing") in found and (2, "redirect_3xx") not in found
    bare = spark.createDataFrame([(1, "https://x.org/", "", "", "", 300, 200, 0, 0, 0, 90)], "page_id long, url string, title string, h1 string, lang string, n_words long, status int, html_chars long, ttfb_ms int, response_ms int, aeo int")
    assert {r.issue_id for r in rules.issues(bare).collect()} == {"title_missing", "h1_missing", "html_lang_missing"}


def test_stuffing_and_soft_404(spark):
    rows = [(1, "buy shoes " * 100, "Shop"), (2, " ".join(f"w{i}" for i in range(200)), "404 - Page not found"), (3, "", "")]
    pages = spark.createDataFrame(rows, "page_id long, clean string, title string").select("*", F.lit("https://x.org/").alias("url"), F.lit("x").alias("h1"), F.lit("").alias("canonical"), F.lit(200).alias("status"), t.count_words(F.col("clean")).alias("n_words"))
    got = {(r.page_id, r.issue_id) for r in rules.issues(pages, ["keyword_stuffing", "soft_404", "low_word_count"]).collect()}
    assert got == {(1, "keyword_stuffing"), (2, "soft_404"), (1, "low_word_count"), (2, "low_word_count"), (3, "low_word_count")}


def test_recommendations_know_the_rules():
    from sitequarry.operators import audit  # noqa: F401

    graph_ids = {"broken_internal_link", "broken_external_link", "orphan_page", "hreflang_missing_return", "thin_content", "missing_security_headers"}
    assert set(documents.LIBRARY) <= set(rules.listed()) | graph_ids


def test_result_pages():
    assert search.parsed("<a class='result__a' href='/l/?uddg=https%3A%2F%2Fa.org%2F'>A <b>b</b></a>", "duckduckgo-html") == ("results", [("https://a.org/", "A b", "")], "")
    assert search.parsed("<p>x", "google")[0] == "parse_failed" and search.parsed("<p>x", "other")[0] == "parse_failed" and search.parsed(None, "bing")[0] == "parse_failed"
    assert search.parsed("<form action='/anomaly.js'>", "bing")[0] == "provider_challenge"
    assert search.parsed("<rss><channel></channel></rss>", "bing-rss")[0] == "empty_results" and search.parsed("x", "bing-rss")[0] == "parse_failed"


def test_budget():
    now = [0.0]
    b = search.Budget(2, 10, clock=lambda: now[0])
    b.take(), b.take()
    with pytest.raises(RuntimeError):
        b.take()
    late = search.Budget(5, 10, clock=lambda: now[0])
    now[0] = 11
    assert late.left() == 0
    with pytest.raises(RuntimeError):
        late.take()


def test_fetching_walks_redirects():
    pages = {"http://a/": (301, {"Location": "/b"}, b""), "http://a/b": (200, {"Content-Type": "text/html"}, "é".encode())}
    got = fetch.walked("http://a/", lambda url: pages[url])
    assert (got["status"], got["final"], got["chain"], got["redirect_code"], got["body"], got["headers"]) == (200, "http://a/b", ["http://a/", "http://a/b"], 301, "é", {"content-type": "text/html"})
    endless = fetch.walked("http://a/0", lambda url: (302, {"location": f"/{int(url.rsplit('/', 1)[1]) + 1}"}, b""))
    assert endless["status"] == fetch.TOO_MANY and len(endless["chain"]) == fetch.MOST_HOPS + 1
    assert fetch.walked("http://a/", lambda url: (500, {}, b"x" * 10**6))["body"] == "x" * fetch.MOST_ERROR


def test_look_ups_are_remembered():
    now, asked = [0.0], []
    r = fetch.Remembered(lambda x: asked.append(x) or x.upper(), 60, 2, clock=lambda: now[0])
    assert [r("a"), r("a"), r("b")] == ["A", "A", "B"] and asked == ["a", "b"]
    now[0] = 60
    assert r("a") == "A" and asked == ["a", "b", "a"]
    r("c"), r("b")
    assert asked == ["a", "b", "a", "c", "b"]


def test_numbers_over_all_rows(spark):
    rng = random.Random(1)
    values = [rng.randint(0, 50) for _ in range(500)]
    d = spark.createDataFrame(list(enumerate(values)), "k int, v int").repartition(5)
    got = {r.k: r.place for r in s.numbered(d, [F.desc("v"), F.col("k")]).collect()}
    assert got == {k: i + 1 for i, (v, k) in enumerate(sorted((-v, k) for k, v in enumerate(values)))}
    assert s.numbered(d.limit(0), [F.col("k")]).count() == 0


def test_settings():
    assert config.load('{"crawl": {"most_pages": 7}, "domains": {"a": {"most_depth": 1, "delay_ms": null}}}', "a", {"most_pages": 9}) == config.Crawl(most_pages=9, most_depth=1)
    for bad in ({"most_pages": 0}, {"most_pages": True}, {"include": ["a", 1]}, {"lost": 1}, {"user_agent": 5}):
        with pytest.raises(ValueError):
            config.merged(bad)
    assert config.schema()["properties"]["most_pages"] == {"type": "integer", "minimum": 1, "maximum": 1_000_000, "default": 500} and config.schema()["properties"]["include"]["items"] == {"type": "string"}


def test_patches():
    kind, out, done = documents.patched('<html><head><title>a</title></head><img src="x.png"><img src="y.png" alt="kept">', {"title": "<New>", "data": {"a": "</script>"}, "alt": {"x.png": 'an "x"', "y.png": "no"}})
    assert kind == "html" and "<title>&lt;New&gt;</title>" in out and "<\\/script>" in out and '<img alt="an &quot;x&quot;" src="x.png">' in out and 'alt="kept"' in out and done == ["title", "data", "alt of x.png"]
    kind, out, done = documents.patched("export default x", {"title": 'A "b"', "canonical": "https://x"}, "p.tsx")
    assert kind == "next" and out.startswith('export const metadata = {\n  title: "A \\"b\\"",\n  alternates: { canonical: "https://x" },\n};') and done == ["title", "alternates"]
    assert documents.patched("text", {"title": "T"}) == ("unknown", "text", [])


def test_reports_escape_and_bound(spark):
    d = spark.createDataFrame([("a|b", 1), ("<i>\nx", None)], "name string, n int")
    assert documents.markdown_table(d) == "| name | n |\n| --- | --- |\n| a\\|b | 1 |\n| <i> x |  |"
    assert "&lt;i&gt;" in documents.html_report("T", {}, {"D": d}) and "<i>" not in documents.html_report("T", {}, {"D": d})
    assert documents.markdown_table(d, 1).count("\n") == 2 and "Nothing found." in documents.markdown_report("T", {}, {"D": d.limit(0)})
    assert documents.terminal_report("T", {}, {"D": d}, width=3).splitlines()[-1] == "<i>"


def test_profiles_and_catalogue(spark):
    good = {"website": "https://x.org", "business": "b", "audience": "a", "topics": ["t"], "pages": [{"url": "https://x.org/a", "topic": "t"}]}
    rows = [good, {**good, "website": "x"}, {**good, "topics": [], "pages": []}, {**good, "posts_per_week": 8, "start_date": "1.1.2026"}, {}]
    d = spark.createDataFrame([(i, __import__("json").dumps(r)) for i, r in enumerate(rows)], "i int, j string")
    got = {r.i: r.p for r in d.select("i", publish.problems(F.from_json("j", publish.PROFILE)).alias("p")).collect()}
    assert got == {0: [], 1: ["website"], 2: ["topics", "pages"], 3: ["posts_per_week", "start_date"], 4: ["website", "business", "audience", "topics", "pages"]}


def test_site_wide_alternates(spark):
    pages = spark.createDataFrame([("https://a/1", 200, True), ("https://a/2", 200, False), ("https://a/3", 404, True)], "url string, status int, indexable boolean")
    alt = [("https://a/1", "en", "https://a/1", "https://a/1"), ("https://a/1", "en", "/2", "https://a/2/"), ("https://a/1", "x-default", "https://a/9", "https://a/9"), ("https://a/2", "e", "https://a/1#x", "https://a/1#x"), ("https://a/2", "de", "https://a/3", "https://a/3")]
    got = {(r.url[-1], r.issue_id, r.lang) for r in audit.hreflang_issues(spark.createDataFrame(alt, "url string, lang string, href string, target string"), pages).collect()}
    assert got == {
        ("1", "hreflang_duplicate_lang", None), ("1", "hreflang_relative_url", "en"), ("1", "hreflang_target_noindex", "en"), ("1", "hreflang_unlinked_target", "x-default"),
        ("2", "hreflang_missing_self", None), ("2", "hreflang_missing_x_default", None), ("2", "hreflang_invalid_code", "e"), ("2", "hreflang_missing_return", "de"), ("2", "hreflang_target_non_200", "de"),
    }


def test_rules_can_be_added(spark):
    rules.register("x_even", "Even", "Notice", "Custom", lambda: F.col("page_id") % 2 == 0)
    try:
        pages = spark.createDataFrame([(1, "u"), (2, "v")], "page_id long, url string")
        assert [r.url for r in rules.issues(pages, ["x_even"]).collect()] == ["v"]
        assert "x_even" in rules.listed()
    finally:
        del rules.REGISTRY["x_even"]


def test_pages_are_parsed():
    page = '<html lang=en><head><title> A  b</title><meta name=description content=d><link rel=canonical href=/c><script type="application/ld+json">{"@graph":[{"@type":"FAQPage"}]}</script></head><body><h1>H</h1><img src=x><a href=/a></a><p id=i><p id=i>two words</body>'
    r = html.read(page)
    assert (r.title, r.h1, r.lang, r.description, r.canonical, r.types()) == ("A b", "H", "en", "d", "/c", ["FAQPage"])
    assert r.n["img_no_alt"] == 1 and r.n["empty_anchor"] == 1 and r.ids["i"] == 2
    assert html.read(None).title == ""


def test_diff_and_delta(spark):
    a = spark.createDataFrame([("x", 200), ("y", 200), ("z", None)], "k string, status int")
    b = spark.createDataFrame([("y", 500), ("z", None), ("w", 200)], "k string, status int")
    assert {(r.k, r.change) for r in reports.diff(a, b, "k", ["status"]).collect()} == {("x", "removed"), ("y", "changed"), ("w", "added")}


def test_pages_of_results(spark):
    d = spark.range(10).orderBy("id")
    assert [r.id for r in s.page(d, 2, 3).collect()] == [3, 4, 5]
    assert [r.id for r in s.page(d, 0, 0).collect()] == [0]


def test_saving_again_replaces_one_crawl(spark, tmp_path):
    d = spark.createDataFrame([("a", 1), ("b", 2)], "url string, crawl_id int")
    readers.save_crawl({"pages": d}, str(tmp_path))
    readers.save_crawl({"pages": spark.createDataFrame([("c", 1)], "url string, crawl_id int")}, str(tmp_path))
    assert {(r.url, r.crawl_id) for r in spark.read.parquet(f"{tmp_path}/pages").collect()} == {("c", 1), ("b", 2)}


def test_streams_end_as_batches(spark, tmp_path):
    schema = spark.read.parquet(f"{SMALL}/events.parquet").schema
    stream = events.read(spark, SMALL, "events", schema)
    got = events.drained(events.windows(stream, "event_type"), "complete", str(tmp_path / "c"))
    batch = events.windows(spark.read.parquet(f"{SMALL}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp")), "event_type")
    assert got.select("event_type", "start", "n").exceptAll(batch.select("event_type", "start", "n")).count() == 0
    assert got.count() == batch.count()
    seen = events.drained(events.first_seen(events.read(spark, SMALL, "events", schema), "user_id"), "append", str(tmp_path / "s"))
    assert seen.groupBy("user_id").count().count() == spark.read.parquet(f"{SMALL}/events.parquet").select("user_id").distinct().count()


def test_minima_and_candidates(spark):
    larger = SMALL.replace("0.001", "0.01")
    d = spark.read.parquet(f"{larger}/documents.parquet").select("doc_id", F.split(t.normalise_duplicate(F.col("text")), " ").alias("w")).where("size(w) >= 40")
    rows = d.select("doc_id", F.array_join("w", " ").alias("text"), t.shingles(F.col("w")).alias("h")).collect()
    signature = {r.doc_id: r.signature for r in registry.QUERIES["hash_minhash"](spark, larger).collect()}

    def fnv(text):
        h = 0x811C9DC5
        for unit in text.encode("utf-16-le").decode("utf-16-le"):
            h = (h ^ ord(unit)) * 0x01000193 % 2**32
        return h

    for r in rows[:12]:
        x = [fnv(s) for s in r.h]
        assert signature[r.doc_id] == [min((a * y + b) % 2**32 for y in x) for a, b in similarity.coefficients()]
    pairs = {(r.a, r.other) for r in registry.QUERIES["j_lsh_candidates"](spark, larger).collect()}
    least = {}
    for r in sorted(rows):
        if r.text in least:
            assert (least[r.text], r.doc_id) in pairs
        least.setdefault(r.text, r.doc_id)
    own = [(r.doc_id, set(r.h)) for r in sorted(rows) if least[r.text] == r.doc_id]
    near = {(i, k) for n, (i, x) in enumerate(own) for k, y in own[n + 1 :] if 0.8 * len(x) <= len(y) <= len(x) / 0.8 and len(x & y) >= 0.8 * len(x | y)}
    assert near and near <= pairs
    bands = {}
    for i, _ in own:
        for b in range(16):
            bands.setdefault((b, *signature[i][8 * b : 8 * b + 8]), []).append(i)
    assert {(i, k) for g in bands.values() for i in g for k in g if i < k} <= pairs


def test_target_keywords_leave_out_the_words_of_their_own_list(spark):
    rows = [(0, " With ", "Home", "Yourself | x", ["privacy", "Contact", "below"]), (1, None, "1. That", "Himself", ["of"]), (2, "", "That is it", "Above - that", None)]
    d = spark.createDataFrame(rows, "i int, given string, h1 string, title string, phrases array<string>")
    got = {r.i: sorted(r.k) for r in d.select("i", t.target_keywords(*[F.col(c) for c in ("given", "h1", "title", "phrases")]).alias("k")).collect()}
    assert got == {0: ["below", "contact", "with", "yourself"], 1: ["himself"], 2: ["above", "that is it"]}
