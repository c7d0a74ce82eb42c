"""Link graph, annulus clustering and hard negatives against brute-force versions, with awkward rows."""

import hashlib
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.llm import annulus, hard_negatives, keyfilter, link_graph, spread, token_output, topk
from corpusloom.llm.queries import RULES, vocabulary

# --- link graph

PAGES = "page_id long, url string, html string, host int, kind string, mass double, pieces string"


def anchor_of(link):
    return f'<p>x <A class="y" HREF = "{link}">t</a>'


def web():
    """Pages that link to a trusted and to blocked hosts, with awkward urls and links."""
    link = lambda *to: "".join(map(anchor_of, to))
    rows = [
        (1, "https://a.com/x", link("http://B.org/1", "//c.org", "/own", "#f", "mailto:x@y.com")),
        (2, "http://b.org/p?q#r", link(*["https://d.org/", "https://d.org/2"] * 3, "http://bad.net/")),
        (3, "http://bad.net/es/1", link("/es/2")),
        (4, "http://bad.net/en/1", None),
        (5, "http://friend.org/", link("http://bad.net/es/9", "http://bad.net/", "http://b.org/")),
        (6, "http://c.org", "no links"),
        (7, "HTTP://WWW.Example.COM/en/7", link("http://e.org")),
        (8, "http://example.com/en/8", ""),
        (9, "http://sub.www.example.com/en", ""),
        (10, None, link("http://b.org/")),
        (11, "not a url", link("http://b.org/")),
        (12, "", None),
        (13, "http://e.org?x=://y/z", "<a href=>"),
        (14, "http://notexample.com/en/", "<a data-href='http://bad.net/'>"),
        (15, "ftp://net/fr/", None),
        (16, "http:///nohost", link("/a")),
        (17, "http://far.org/\nline", link("http://friend.org/")),
    ]
    rows += [rows[1], rows[4], (None, "http://d.org/a", link("/x", "http://e.org/")), (None, None, None)]
    return rows


def split_url(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.split("[/?#]", rest, maxsplit=1)[0]
    return re.sub("[A-Z]", lambda m: m[0].lower(), host), re.split("[?#]", rest[len(host) :], maxsplit=1)[0]


def rule_of(host, path):
    fits = [(len(h + p), h + p, v) for v, h, p in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits)[1:] if fits else (None, None)


def brute_links(rows, rounds=link_graph.ROUNDS):
    pages = [(i, *split_url(u), html) for i, u, html in rows]
    count, edges = {}, {}
    for _, h, p, html in pages:
        if not h:
            continue
        c = count.setdefault(h, [0, 0, 0])
        c[0] += 1
        c[1] += rule_of(h, p)[1] == "allow"
        c[2] += rule_of(h, p)[1] == "block"
        for to in re.findall(link_graph.LINK, html or ""):
            m = re.match(r"(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)", to)
            dst = m[1].lower() if m else "" if re.match("[A-Za-z][A-Za-z0-9+.-]*:", to) else h
            if dst:
                edges[h, dst] = edges.get((h, dst), 0) + 1
    ranks = []
    for kind in (1, 2):
        seed = {h: link_graph.UNIT * c[kind] // c[0] for h, c in count.items() if c[kind]}
        ways = [(a, b, n) if kind == 1 else (b, a, n) for (a, b), n in edges.items()]
        total = {}
        for a, _, n in ways:
            total[a] = total.get(a, 0) + n
        mass = dict(seed)
        for _ in range(rounds):
            new = {h: math.floor((1 - 0.85) * float(s)) for h, s in seed.items()}
            for a, b, n in ways:
                if a in mass:
                    new[b] = new.get(b, 0) + math.floor(0.85 * float(mass[a]) * (n / total[a]))
            mass = new
        ranks.append(mass)
    out = []
    for i, h, p, _ in pages:
        rule, verdict = rule_of(h, p)
        trust, distrust = (r.get(h, 0) for r in ranks)
        out.append((i, h, p, rule, verdict or ("block" if distrust > 0.5 * (trust + distrust) else "allow"), trust, distrust))
    return sorted(out, key=str)


def judged(frame):
    return sorted(((r["page_id"], r["host"], r["path"], r["rule"], r["verdict"], r["trust"], r["distrust"]) for r in frame.collect()), key=str)


def pages_of(spark, rows):
    return spark.createDataFrame([(*r, 1, "trust", 0.5, "x") for r in rows], PAGES)


def test_links(spark):
    rows = web()
    got = judged(link_graph.judge(pages_of(spark, rows), RULES))
    assert got == brute_links(rows)
    verdict = {r[0]: r[4] for r in got}
    assert verdict[4] == "block" and verdict[5] == "block" and verdict[17] == "block"  # next to blocked pages, and what links there
    assert verdict[6] == verdict[13] == "allow" and verdict[2] == "allow"  # trust outweighs
    assert verdict[10] == verdict[11] == verdict[16] == "allow"


def test_links_of_hot_hosts(spark, monkeypatch):
    monkeypatch.setattr(spread, "HOT_KEYS", 4)
    plain = spread.hot_keys
    monkeypatch.setattr(spread, "hot_keys", lambda *a, **k: plain(*a, **{**k, "least": 3}))
    rng = random.Random(3)
    hosts = ["hub.com", "hub.com", "hub.com", *[f"h{k}.{t}" for k in range(8) for t in ("com", "net", "org")]]
    rows = []
    for k in range(120):
        to = "".join(anchor_of(f"http://{rng.choice(hosts)}/{rng.choice(['es', 'en', 'fr'])}/") for _ in range(rng.randrange(6)))
        rows.append((k % 90, f"http://{rng.choice(hosts)}/{rng.choice(['es', 'en', 'de'])}/", to))
    assert judged(link_graph.judge(pages_of(spark, rows), RULES)) == brute_links(rows)


def test_links_of_nothing(spark):
    assert link_graph.judge(pages_of(spark, []), RULES).collect() == []
    got = judged(link_graph.judge(pages_of(spark, [(1, None, None), (2, "x", anchor_of("http://a.com"))]), RULES))
    assert got == [(1, "", "", None, "allow", 0, 0), (2, "", "", None, "allow", 0, 0)]


def test_long_page(spark):
    rows = [(1, "http://a.com/" + "p" * 200_000, "<a " * 2_000 + anchor_of("http://bad.net/") * 2_000), (2, "http://bad.net/es/", "x" * 500_000)]
    assert judged(link_graph.judge(pages_of(spark, rows), RULES)) == brute_links(rows)


# --- vectors

VECTORS = "vec_id long, embedding array<double>, label int, cluster string, uid string, distance int"


def vectors_of(spark, rows):
    return spark.createDataFrame([(i, v, c, "x", "y", 3) for i, v, c in rows], VECTORS)


def awkward(dim, n=160, seed=2):
    rng = random.Random(seed)
    centres = [[rng.uniform(-1, 1) * 10 ** rng.uniform(-1, 1) for _ in range(dim)] for _ in range(5)]
    rows = [(k, [x + rng.gauss(0, 0.05) for x in rng.choice(centres)], rng.randrange(3)) for k in range(n)]
    rows += [(k + 1000, list(rows[k][1]), rows[k][2]) for k in range(0, 40, 2)]  # equal vectors, other ids
    rows += [rows[3], rows[4], (5, [0.25] * dim, 1), (5, [0.5] * dim, 2)]  # equal ids
    rows += [
        (2000, None, 1), (2001, [None, *[0.5] * (dim - 1)], 1), (2002, [float("nan")] + [0.5] * (dim - 1), 0), (2003, [float("inf")] * dim, 0),
        (2004, [1e30] * dim, 0), (2005, [-1e9] * dim, 1), (2006, [], 1), (2007, [0.5] * (dim + 1), 1), (2008, [0.5] * (dim + 1), 1), (2009, [0.4] * (dim + 1), 2),
        (None, [0.3] * dim, 1), (2010, [0.0] * dim, None), (2011, [0.0] * dim, 0), (100, [-0.1] * dim, 2),
    ]
    return rows


def integers(v, scale):
    if v is None or any(x is None or not math.isfinite(x) for x in v):
        return None
    out = [math.floor(scale * x) for x in v]
    return out if sum(x * x for x in out) <= 2**60 else None


def brute_clusters(rows, k, rounds, scale, dim):
    kept = [(i, x) for i, v, _ in rows if (x := integers(v, scale)) is not None and len(x) == dim]
    first = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"2:{r[0]}".encode()).hexdigest(), np.array(r[1], "<i4").tobytes()))
    means = [x for _, x in first[:k]]
    far = lambda a, b: sum((p - q) ** 2 for p, q in zip(a, b))
    near = lambda: [min((far(x, m), c) for c, m in enumerate(means)) for _, x in kept]
    for _ in range(rounds):
        at = near()
        for c in range(len(means)):
            own = [x for (_, x), (_, n) in zip(kept, at) if n == c]
            if own:
                means[c] = [sum(col) // len(own) for col in zip(*own)]
    at = near()
    inertia = [sum(d for d, n in at if n == c) for c in range(len(means))]
    sha = [hashlib.sha256(",".join(map(str, m)).encode()).hexdigest() for m in means]
    return sorted(((i, c, d, inertia[c], sum(inertia), sha[c]) for (i, _), (d, c) in zip(kept, at)), key=str)


def clustered(frame):
    return sorted((tuple(r[c] for c in ("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")) for r in frame.collect()), key=str)


@pytest.mark.parametrize("k, rounds", [(7, 3), (40, 2), (1000, 1), (1, 1)])
def test_clusters(spark, k, rounds):
    rows = awkward(6)
    assert clustered(annulus.cluster(vectors_of(spark, rows), k, rounds, 256, 6)) == brute_clusters(rows, k, rounds, 256, 6)


def test_clusters_of_nothing(spark):
    empty = annulus.cluster(vectors_of(spark, [(1, None, 1), (2, [1.0], 1)]), dim=2)
    assert empty.collect() == [] and empty.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    assert clustered(annulus.cluster(vectors_of(spark, [(1, [3.0], 1)] * 3), k=2, dim=1))[0][1:5] == (0, 0, 0, 0)


def test_annulus_leaves_out_and_keeps_ties():
    rng = np.random.default_rng(4)
    x = rng.integers(-50, 50, (40, 16)) * np.arange(1, 41)[:, None]
    near = np.repeat(x, 30, axis=0) + rng.integers(-9, 9, (1200, 16))
    found, least, compared = annulus.Centroids(x).nearest(near, np.full(1200, -1))
    exact = ((near[:, None] - x[None]) ** 2).sum(axis=2)
    assert (found == exact.argmin(axis=1)).all() and (least == exact.min(axis=1)).all()
    again, _, fewer = annulus.Centroids(x).nearest(near, found)
    assert (again == found).all() and fewer < compared and fewer < 0.25 * exact.size
    # both centroids are as near: one on each edge of the annulus
    tied = annulus.Centroids(np.array([[6, 0], [2, 0], [6, 0]]))
    assert tied.nearest(np.array([[4, 0]]), np.array([1]))[0].tolist() == [0]


def brute_negatives(rows, is_anchor, positives=5, negatives=10, low=30, high=90, scale=256):
    sound = [(i, x, c) for i, v, c in rows if i is not None and c is not None and (x := integers(v, scale)) is not None]
    out = []
    for a, (i, x, c) in enumerate(sound):
        if not is_anchor(i):
            continue
        scored = sorted((-sum(p * q for p, q in zip(x, y)), j, n != c) for b, (j, y, n) in enumerate(sound) if b != a and len(y) == len(x))
        for s, j, _ in [r for r in scored if not r[2]][:positives]:
            fits = [(-t, m) for t, m, other in scored if other and low * -s <= 100 * -t <= high * -s]
            out += [(i, j, rank, m, -s, t) for rank, (t, m) in enumerate(fits[:negatives], 1)]
    return sorted(out)


def mined(frame):
    return sorted(tuple(r[c] for c in ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")) for r in frame.collect())


@pytest.mark.parametrize("stripe, chunk, scored", [(8192, 2048, 64), (30, 3, 2)])
def test_hard_negatives(spark, monkeypatch, stripe, chunk, scored):
    for name, value in (("STRIPE", stripe), ("CHUNK", chunk), ("SCORED", scored)):
        monkeypatch.setattr(hard_negatives, name, value)
    rows = awkward(6, seed=3)
    got = mined(hard_negatives.mine(vectors_of(spark, rows), F.col("vec_id") % 7 == 0))
    want = brute_negatives(rows, lambda i: i % 7 == 0)
    assert got == want and len(want) > 300


def test_hard_negatives_of_nothing(spark):
    assert hard_negatives.mine(vectors_of(spark, []), F.col("vec_id") % 2 == 0).collect() == []
    one_label = [(k, [1.0, 2.0], 4) for k in range(20)]
    assert hard_negatives.mine(vectors_of(spark, one_label), F.col("vec_id") % 2 == 0).collect() == []
    no_anchor = [(1, [1.0], 1), (None, [2.0], 2)]
    assert hard_negatives.mine(vectors_of(spark, no_anchor), F.col("vec_id") % 2 == 0).collect() == []


# --- top k


def brute_top(rows, asks, k, scale=64):
    limit = lambda s: max(-(2**63), min(s, 2**63 - 1))
    whole = [
        (i, [max(-(2**62), min(math.floor(scale * x), 2**62)) for x in v]) for i, v, *_ in rows
        if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)
    ]
    out = []
    for a, (i, x) in enumerate(whole):
        if asks(i):
            scored = sorted((-limit(sum(p * q for p, q in zip(x, y))), j) for b, (j, y) in enumerate(whole) if b != a and len(y) == len(x))
            out += [(i, n + 1, j, -s) for n, (s, j) in enumerate(scored[:k])]
    return sorted(out)


def topped(frame):
    return sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in frame.collect())


@pytest.mark.parametrize("k", [1, 20])
def test_top_k_of_awkward_vectors(spark, k):
    rows = awkward(6, seed=6)
    assert topped(topk.top_k(vectors_of(spark, rows), F.col("vec_id") % 5 == 0, k)) == brute_top(rows, lambda i: i % 5 == 0, k)


def test_top_k_of_scores_beyond_long(spark):
    rows = [(0, [1e9] * 6, 1), (1, [1e9] * 6, 1), (2, [-1e9] * 6, 1), (3, [1e18, 0.0], 1), (4, [1e18, 5.0], 1), (5, [1e300] * 6, 1), (6, [-1e300] * 6, 1)]
    rows += [(k, [float(k % 3), 1.0] * 3, 1) for k in range(10, 50)]
    want = brute_top(rows, lambda i: i % 2 == 0, 20)
    assert topped(topk.top_k(vectors_of(spark, rows), F.col("vec_id") % 2 == 0, 20)) == want
    assert (0, 1, 1, 2**63 - 1) in want and (4, 1, 3, 2**63 - 1) in want


def test_pivots_leave_most_pairs_out():
    rng = np.random.default_rng(8)
    centres = rng.integers(-4000, 4000, (64, 32))
    x = (centres[np.arange(6400) % 64] + rng.integers(-60, 60, (6400, 32))).astype(np.int64)
    pivots = topk.far_apart(x[:1024])
    low, _ = topk.distances(x, pivots)
    x = x[np.lexsort((low.min(axis=1), low.argmin(axis=1)))]
    low, high = topk.distances(x, pivots)
    asks = np.arange(0, 6400, 20)
    blocks = [topk.Block(np.arange(a, a + 400), np.arange(a, a + 400), x[a : a + 400], pivots) for a in range(0, 6400, 400)]
    edge = lambda f, d: np.array([f(d[a : a + 400], axis=0) for a in range(0, 6400, 400)])
    far = (low[asks], high[asks])
    most = np.array([b.square.max() for b in blocks])
    bounds = topk.block_bounds(far, (x[asks].astype(float) ** 2).sum(axis=1), edge(np.min, low), edge(np.max, high), most)
    place, ids, scores, evaluated = topk.search(asks, x[asks], far, np.full(len(asks), -np.inf), bounds, blocks, 10)
    exact = x[asks] @ x.T
    for k, a in enumerate(asks):
        others = np.delete(np.arange(6400), a)
        best = others[np.lexsort((others, -exact[k, others]))[:10]]
        assert ids[place == k].tolist() == best.tolist() and scores[place == k].tolist() == exact[k, best].tolist()
    assert evaluated < 0.2 * exact.size


# --- key filter and word cache


@pytest.mark.parametrize("step", [1, 60, 1 << 20])
def test_key_filter_of_regular_keys(spark, step):
    keys = spark.range(300_000).select((F.col("id") * step).alias("key"))
    f = keyfilter.build(keys)
    inside = np.arange(300_000) * step
    assert f.count > 1 and f.passes(inside).all()
    assert f.passes(inside + (300_000 * step if step == 1 else 7)).mean() < 0.02
    per = np.bincount(keyfilter._segments(keyfilter._hashes(inside), f.count), minlength=f.count)
    assert per.max() < 1.1 * per.mean()


def test_words_outlive_the_cache(monkeypatch):
    from tokenizers import Tokenizer

    monkeypatch.setattr(token_output, "CACHED_WORDS", 1000)
    path = vocabulary("word_bpe_49k.json")
    coder, library = token_output.WordEncoder(path), Tokenizer.from_file(path)
    library.no_truncation()
    rng = random.Random(1)
    for n in (1, 1200, 30, 999, 5000, 3):
        text = " ".join("".join(rng.choices("abcdefghijé1.,", k=rng.randrange(1, 9))) for _ in range(n))
        assert np.frombuffer(coder.encode(text), "<u4").tolist() == library.encode(text, add_special_tokens=False).ids
        assert len(coder.cache) <= 1001
