"""Operators on pairs, groups and tables: URL rules, mixing, near-duplicates, nearest vectors, pipeline."""

import hashlib
import itertools
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from spark_drift.llm import mixing, near_vectors, nearest, piece_codec, quality, simhash, toxicity, url_filter
from spark_drift.llm.components import components
from spark_drift.llm.registry import tokenizer_file

SF = "/root/testdata/sf0.001"


def roots(nodes, pairs):
    """Least node reachable, by union-find."""
    up = {n: n for n in nodes}

    def find(n):
        while up[n] != n:
            up[n] = up[up[n]]
            n = up[n]
        return n

    for a, b in pairs:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


@pytest.mark.parametrize("shape", ["path", "random", "star"])
def test_components(spark, shape):
    rnd = random.Random(5)
    pairs = {"path": [(i, i + 1) for i in range(200)], "star": [(500, i) for i in range(300)], "random": [(rnd.randrange(400), rnd.randrange(400)) for _ in range(250)]}[shape]
    rnd.shuffle(pairs)
    got = {r.node: r.component for r in components(spark.createDataFrame(pairs + pairs[:5], "a long, b long")).collect()}
    want = roots(range(600), pairs)
    linked = {n for a, b in pairs if a != b for n in (a, b)}
    assert got == {n: want[n] for n in linked}


def test_no_links(spark):
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


# --- URL rules


def judge(url, rules):
    host = path = ""
    if url and "://" in url:
        rest = url[url.index("://") + 3:]
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host):])[0]
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fits = [(len(h) + len(p), len(h), v == "block", h, p, v) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=None)
    return host, path, best and best[3] + best[4], best[5] if best else "allow"


RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"), ("block", "a.b", "/x"), ("allow", "b", "/x/y"),
         ("block", "c", ""), ("allow", "c", ""), ("block", "x.c", "/p/q/r"), ("block", "xample.net", "/en/")]


def test_url_rules(spark):
    rnd = random.Random(8)
    urls = [None, "", "no scheme", "http://", "http://NET/", "http://net", "https://É.Net/?q#f", "a://b://net/", "http://example.net/en", "http://example.net/en/", "HTTP://U.EXAMPLE.NET/en/1?x",
            "http://notexample.net/en/", "http://a.b/x", "http://a.b/x/y", "http://z.a.b/xyz", "http://c", "http://c?x", "http://y.x.c/p/q/r/s", "http://.net/", "http://net./", "http://net/" + "a/" * 3000, "http://" + "a." * 3000 + "net/\n"]
    parts = ["net", "org", "com", "example", "a", "b", "c", "x", ".", ".", "/", "/", "en", "de", "fr", "y", "?", "#", "://"]
    urls += ["http://" + "".join(rnd.choice(parts) for _ in range(rnd.randint(1, 9))) for _ in range(1500)]
    rows = spark.createDataFrame([(i, u, "h") for i, u in enumerate(urls)] + [(0, None, None), (None, urls[4], "x")], "page_id long, url string, host string")
    got = url_filter.filter_urls(rows, url_filter.rules_table(spark, RULES), keep=["page_id", "host"]).collect()
    assert sorted((r.page_id is None, r.page_id or 0, r.host, r.path, r.rule or "", r.verdict) for r in got) == sorted(
        (i is None, i or 0, *(x or "" for x in judge(u, RULES))) for i, u in [*enumerate(urls), (0, None), (None, urls[4])])


def test_url_rules_met_by_short_digests_alone(spark, monkeypatch):
    """The join has one key and builds the rules' side; shuffled sides and colliding digests give the same rows."""
    urls = ["http://net/a", "http://u.example.net/en/b", "http://u.example.net/fr/", "http://example.com/de/x", "http://org/fr/", None] * 3
    rows = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    rules = url_filter.rules_table(spark, [*RULES, ("allow", *RULES[0][1:]), ("allow", "com", ""), ("odd", "org", "/fr/")])
    judged = lambda: url_filter.filter_urls(rows, rules, keep=["page_id"])
    plan = judged()._jdf.queryExecution().executedPlan().toString()
    met = [line for line in plan.splitlines() if "HashJoin [short" in line]
    assert met and all(re.search(r"BroadcastHashJoin \[short#\d+\], \[short#\d+\], Inner, BuildRight", line) for line in met)
    assert "SortAggregate" not in plan
    first = sorted(map(str, judged().collect()))
    monkeypatch.setattr(url_filter, "SHORT", 1)
    assert sorted(map(str, judged().collect())) == first
    monkeypatch.setattr(url_filter, "BROADCAST_BYTES", 0)
    assert sorted(map(str, judged().collect())) == first


def test_url_empty_tables(spark):
    rows = spark.createDataFrame([(1, "http://a/b")], "page_id long, url string")
    none = url_filter.rules_table(spark, RULES).limit(0)
    assert [tuple(r) for r in url_filter.filter_urls(rows, none, keep=["page_id"]).collect()] == [(1, "a", "/b", None, "allow")]
    assert url_filter.filter_urls(rows.limit(0), none, keep=["page_id"]).count() == 0


# --- mixing


def test_fit_budget_reaches_the_best_sum():
    rnd = random.Random(3)
    for _ in range(200):
        sizes = rnd.sample(range(1, 40), rnd.randint(1, 7))
        counts = [rnd.randint(1, 5) for _ in sizes]
        total = sum(s * c for s, c in zip(sizes, counts))
        budget = rnd.randint(0, total)
        take = mixing.fit_budget(sizes, counts, budget)
        assert all(0 <= t <= c for t, c in zip(take, counts))
        sums = {0}
        for s, c in zip(sizes, counts):
            sums = {x + k * s for x in sums for k in range(c + 1)}
        assert abs(budget - sum(s * t for s, t in zip(sizes, take))) == min(abs(budget - x) for x in sums)


def test_fit_budget_with_little_left_to_fit():
    take = mixing.fit_budget([3, 7, 50], [1000, 1000, 1000], 41_234, last=60)
    assert all(t <= 1000 for t in take) and abs(41_234 - (3 * take[0] + 7 * take[1] + 50 * take[2])) <= 1


@pytest.mark.parametrize("sizes,counts,budget", [([1000, 1_000_000], [500, 1], 1_050_000), ([1000, 300_000], [300, 3], 1_080_000)])
def test_fit_budget_with_long_documents(sizes, counts, budget):
    take = mixing.fit_budget(sizes, counts, budget)
    assert all(0 <= t <= c for t, c in zip(take, counts)) and sum(s * t for s, t in zip(sizes, take)) == budget


def test_fit_budget_with_many_long_documents():
    rnd = random.Random(12)
    for n_long, n_short in [(3000, 0), (3000, 2000), (40, 300)]:
        sizes = rnd.sample(range(20_000, 900_000), n_long) + rnd.sample(range(1, 16_000), n_short)
        counts = [rnd.randint(1, 3) for _ in sizes]
        total = sum(s * c for s, c in zip(sizes, counts))
        for budget in (total // 50, total // 3, total * 9 // 10):
            take = mixing.fit_budget(sizes, counts, budget)
            assert all(0 <= t <= c for t, c in zip(take, counts))
            assert abs(budget - sum(s * t for s, t in zip(sizes, take))) <= (0 if n_short else 20_000)


def water(sizes):
    """Targets by repeated resharing of the excess."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    target, left, open_ = dict.fromkeys(names, 0.0), 1.5 * sum(sizes.values()), set(names)
    while left > 1e-9 and open_:
        share = left / sum(weight[s] for s in open_)
        left = 0.0
        for s in list(open_):
            target[s] += share * weight[s]
            if target[s] >= 2 * sizes[s]:
                left += target[s] - 2 * sizes[s]
                target[s] = 2.0 * sizes[s]
                open_.discard(s)
    return target


def test_mix(spark):
    rnd = random.Random(4)
    rows, n = [], 0
    for s, count in [("b", 700), ("a", 40), (None, 90), ("é", 60), ("z", 5), ("Z", 30), ("empty", 3), ("hot", 3000)]:
        for _ in range(count):
            rows.append((n, s, 0 if s == "empty" else 9 if s == "hot" else rnd.randint(0, 400), "t"))
            n += 1
    docs = spark.createDataFrame(rows, "doc_id long, source string, size long, target string")
    got = mixing.mix(docs, keep=["doc_id", "source", "target"])
    assert got.columns == ["doc_id", "source", "size", "source_size", "target", "copies", "taken"]
    table = got.toPandas()
    assert len(table) == len(rows) and sorted(table.doc_id) == list(range(n))
    assert (table.taken == table.copies * table["size"]).all() and table.copies.isin([0, 1, 2]).all()
    sizes = {}
    for _, s, z, _ in rows:
        sizes[s] = sizes.get(s, 0) + z
    want = water(sizes)
    for s, own in table.groupby(table.source.fillna("?")):
        name = None if s == "?" else s
        assert (own.source_size == sizes[name]).all() and np.allclose(own.target, want[name])
        assert abs(own.taken.sum() - want[name]) <= (9 if s == "hot" else 30 if s == "z" else 1)
    again = mixing.mix(docs.repartition(7), keep=["doc_id", "source", "target"]).toPandas()
    key = ["doc_id", "copies"]
    assert (again[key].sort_values("doc_id").to_numpy() == table[key].sort_values("doc_id").to_numpy()).all()


def test_mix_cases(spark):
    schema = "doc_id long, source string, size long"
    assert mixing.mix(spark.createDataFrame([], schema), keep=["doc_id"]).count() == 0
    got = mixing.mix(spark.createDataFrame([(1, None, 0), (None, "a", 0)], schema), keep=["doc_id"]).collect()
    assert [(r.copies, r.taken, r.target) for r in got] == [(0, 0, 0.0)] * 2
    same = mixing.mix(spark.createDataFrame([(7, "a", 5)] * 4 + [(None, "a", 3)] * 2, schema), keep=["doc_id"]).collect()
    assert len(same) == 6 and len({r.copies for r in same if r.doc_id == 7}) == 1
    text = spark.createDataFrame([(None,), ("",), ("a b\tc\x0bd\u00a0e",), (" x  y ",)], "t string")
    assert [r[0] for r in text.select(mixing.word_count(text.t)).collect()] == [0, 0, 4, 2]


# --- SimHash


def plain_fingerprint(text):
    from xxhash import xxh64_intdigest

    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[i:i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_fingerprints():
    for t in [None, "", " \n", "One", "One tWo", "a b c", "A B C", "a b c d a b c", "É é ß\u00a0x\x1cy z w", "w " * 3000] + [str(random.Random(i).random()) * 5 for i in range(50)]:
        assert simhash.fingerprint(t) == plain_fingerprint(t), repr(t)


def test_links_are_all_pairs_within_three_bits(spark):
    rnd = random.Random(6)
    prints = {0, (1 << 64) - 1, 1 << 63}
    for _ in range(60):
        f = rnd.getrandbits(64)
        prints.add(f)
        for _ in range(12):  # chains of few changed bits, in one half and in both
            g = f
            for b in rnd.sample(range(32) if rnd.random() < 0.3 else range(64), rnd.randint(1, 5)):
                g ^= 1 << b
            prints.add(g)
            f = g if rnd.random() < 0.5 else f
    signed = {f - (1 << 64) if f >> 63 else f: f for f in prints}
    got = [frozenset((signed[r.a], signed[r.b])) for r in simhash.links(spark.createDataFrame([(s,) for s in signed], "fp long")).collect()]
    want = {frozenset(p) for p in itertools.combinations(prints, 2) if (p[0] ^ p[1]).bit_count() <= 3}
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 300


def test_near_duplicates(spark):
    base = [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    texts = base + [t.replace(".", " x.", 1) for t in base[:40]] + [None, "", " "] + ["Same three words"] * 30
    rows = [(i + 1, t, "c", "f") for i, t in enumerate(texts)]
    rows += [(None, "Same three words", None, None), (3, base[2], "c", "f"), (None, "quite alone here", None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, component_id string, fingerprint string")
    got = simhash.near_duplicates(docs).collect()
    print_of = [plain_fingerprint(r[1]) for r in rows]
    first = {}
    for (key, *_), f in zip(rows, print_of):
        first[f] = min(x for x in (first.get(f), key, 10**9) if x is not None)
    link = [(a, b) for a, b in itertools.combinations(set(print_of), 2) if (a ^ b).bit_count() <= 3]
    root = roots(set(print_of), link)
    least = {}
    for f in root:
        least[root[f]] = min(least.get(root[f], 10**9), first[f])
    want = sorted((r[0] or 0, format(f, "016x"), least[root[f]]) for r, f in zip(rows, print_of))
    assert sorted((r.doc_id or 0, r.fingerprint, r.component_id or 10**9) for r in got) == want
    assert simhash.near_duplicates(docs.limit(0)).count() == 0


# --- vectors


def vector_rows(seed=0, d=16):
    """Random vectors of four labels with pairs, a chain, a clique wider than a list, copies, and unusable ones."""
    rnd = np.random.default_rng(seed)
    x = [(v.tolist(), int(rnd.integers(4))) for v in rnd.normal(size=(600, d))]
    c = rnd.normal(size=d)
    x += [((c + rnd.normal(size=d) * 0.05).tolist(), 1) for _ in range(70)]
    for _ in range(30):
        p = rnd.normal(size=d)
        x += [(p.tolist(), 2), ((p * 3 + rnd.normal(size=d) * 0.2).tolist(), 2)]
    p = rnd.normal(size=d)
    for _ in range(12):
        x.append((p.tolist(), 3))
        p = p + rnd.normal(size=d) * 0.3
    x += [(x[5][0], x[5][1])] * 40 + [(x[5][0], (x[5][1] + 1) % 4)]
    x += [(None, 1), ([0.0] * d, 1), ([0.0] * d, 1), ([None] + [1.0] * (d - 1), 1), ([float("nan")] * d, 1), ([float("inf")] + [1.0] * (d - 1), 1), ([], 1), ([1.0, 2.0], 1), (x[7][0], None), (x[7][0], None)]
    order = rnd.permutation(len(x))
    return [(int(i), *x[j]) for i, j in enumerate(order)]


def fine(v, d=16):
    return v is not None and len(v) == d and all(a is not None and np.isfinite(a) for a in v) and any(v)


VECTORS = "vec_id long, embedding array<float>, label int"


def test_near_vectors(spark):
    rows = vector_rows()
    frame = spark.createDataFrame([(*r, 1) for r in rows], VECTORS + ", n_links int")
    got = {r.vec_id: r for r in near_vectors.near_duplicates(frame).collect()}
    assert len(got) == len(rows)
    use = [r for r in rows if fine(r[1]) and r[2] is not None]
    x = np.array([r[1] for r in use], np.float32).astype(float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    label = np.array([r[2] for r in use])
    linked = (x @ x.T >= near_vectors.THRESHOLD) & (label[:, None] == label[None])
    np.fill_diagonal(linked, False)
    ids = [r[0] for r in use]
    degree = {r[0]: 0 for r in rows} | dict(zip(ids, linked.sum(1)))
    root = roots([r[0] for r in rows], [(ids[i], ids[j]) for i, j in np.argwhere(linked)])
    assert {k: r.n_links for k, r in got.items()} == degree
    assert {k: r.component_id for k, r in got.items()} == root and all(r.kept == (k == root[k]) for k, r in got.items())


def test_near_vectors_cases(spark):
    none = spark.createDataFrame([], VECTORS)
    assert near_vectors.near_duplicates(none).count() == 0
    odd = spark.createDataFrame([(1, None, 1), (2, [0.0, 0.0], 1), (None, [0.0], None)], VECTORS)
    assert sorted((r.vec_id or 0, r.n_links, r.component_id or 0, r.kept) for r in near_vectors.near_duplicates(odd).collect()) == [(0, 0, 0, False), (1, 0, 1, True), (2, 0, 2, True)]
    copies = spark.createDataFrame([(i, [1.0, 2.0], 1) for i in range(5, 700)] + [(5, [1.0, 2.0], 1)], VECTORS)
    got = near_vectors.near_duplicates(copies).collect()
    assert len(got) == 696 and {(r.n_links, r.component_id) for r in got} == {(695, 5)} and sum(r.kept for r in got) == 2


def test_wide_component_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(near_vectors, "SIDE", 40)
    monkeypatch.setattr(near_vectors, "LONGEST", near_vectors.NEIGHBOURS)
    test_near_vectors(spark)


def test_lists_grow_until_they_hold_all_links(spark, monkeypatch):
    """A group of 30 different vectors, all linked, saturates lists of 10 and 20; lists of 40 hold them all."""
    rnd = np.random.default_rng(12)
    centre = rnd.normal(size=32)
    x = np.vstack([centre + 0.1 * rnd.normal(size=(30, 32)), rnd.normal(size=(40, 32))])
    compared = []
    in_full = near_vectors._in_full
    monkeypatch.setattr(near_vectors, "_in_full", lambda members, *a: compared.append(members.count()) or in_full(members, *a))
    got = near_vectors.near_duplicates(spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(x)], VECTORS)).collect()
    assert {r.vec_id: r.n_links for r in got} == {i: 29 if i < 30 else 0 for i in range(70)}
    assert compared == [0]  # nothing was left to compare in full


@pytest.mark.parametrize("groups", [2, 3])
def test_tight_groups_with_links_across(spark, groups):
    """Groups that fill their own lists: the links across are in no list of 10."""
    rnd = np.random.default_rng(9)
    d = 64
    axes = np.linalg.qr(rnd.normal(size=(d, d)))[0]
    x = []
    for g in range(groups):  # a chain: the first and the last of three groups are linked by the middle one alone
        angle = g * np.arccos(0.96)
        centre = np.cos(angle) * axes[0] + np.sin(angle) * axes[1]
        x += [centre + 0.06 * axes[2 + 12 * g + i] for i in range(12)]
    x = np.array(x, np.float32)
    unit = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    linked = unit @ unit.T >= near_vectors.THRESHOLD
    np.fill_diagonal(linked, False)
    rows = [(i + 1, v.tolist(), 0) for i, v in enumerate(x)]
    got = {r.vec_id: r for r in near_vectors.near_duplicates(spark.createDataFrame(rows, VECTORS)).collect()}
    assert linked[0].sum() == 23 and {k: r.n_links for k, r in got.items()} == {i + 1: n for i, n in enumerate(linked.sum(1))}
    assert {r.component_id for r in got.values()} == {1}


def isolated_pairs(n, d=16, pairs=20):
    rnd = np.random.default_rng(2)
    x = rnd.normal(size=(n, d))
    for i in range(0, 2 * pairs, 2):  # at a cosine of 0.935
        a = x[i] / np.linalg.norm(x[i])
        b = x[i + 1] - (x[i + 1] @ a) * a
        x[i + 1] = 0.935 * a + np.sqrt(1 - 0.935**2) * b / np.linalg.norm(b)
    return [(i, v.tolist(), 0) for i, v in enumerate(x)]


def test_audit_goes_on_until_the_links_are_found(spark, monkeypatch):
    """Few vectors have links, and one tree of small blocks misses most: passes go on until they are found."""
    monkeypatch.setattr(near_vectors, "TREES", 1)
    monkeypatch.setattr(near_vectors, "BLOCK", 4)
    monkeypatch.setattr(near_vectors, "ROUNDS", 0)
    got = near_vectors.near_duplicates(spark.createDataFrame(isolated_pairs(700), VECTORS)).collect()
    assert {r.vec_id: r.n_links for r in got} == {i: int(i < 40) for i in range(700)}


def test_audit_that_fails_is_an_error(spark, monkeypatch):
    monkeypatch.setattr(near_vectors, "TREES", 1)
    monkeypatch.setattr(near_vectors, "BLOCK", 4)
    monkeypatch.setattr(near_vectors, "ROUNDS", 0)
    monkeypatch.setattr(near_vectors, "PASSES", 1)
    with pytest.raises(RuntimeError, match="audited"):
        near_vectors.near_duplicates(spark.createDataFrame(isolated_pairs(700), VECTORS))


def test_small_label_beside_a_large_one(spark):
    """Blocks are sized by each label, and the audit sees both: pairs of the small one are not scattered."""
    large = np.random.default_rng(4).normal(size=(6000, 64))
    rows = [(i, x, 1) for i, x, _ in isolated_pairs(300, 64, 150)] + [(300 + i, x.tolist(), 2) for i, x in enumerate(large)]
    got = {r.vec_id: r.n_links for r in near_vectors.near_duplicates(spark.createDataFrame(rows, VECTORS)).collect()}
    x = np.array([r[1] for r in rows], np.float32).astype(float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    label = np.array([r[2] for r in rows])
    linked = ((x @ x.T >= near_vectors.THRESHOLD) & (label[:, None] == label[None])).sum(1) - 1
    assert sum(linked[label == 1]) == 300
    assert sum(got[r[0]] for r, n in zip(rows, linked) if r[2] == 1) >= 0.98 * sum(linked[label == 1])
    assert all(got[r[0]] <= n for r, n in zip(rows, linked))


def test_nearest(spark, monkeypatch):
    monkeypatch.setattr(nearest, "CELL", 64)
    monkeypatch.setattr(nearest, "LEAF", 8)
    rows = vector_rows(seed=3)
    got = nearest.nearest(spark.createDataFrame([(*r, 0.5) for r in rows], VECTORS + ", score double"), every=7, k=10).collect()
    use = [r for r in rows if fine(r[1])]
    x, ids = np.array([r[1] for r in use], np.float32).astype(float), np.array([r[0] for r in use])
    asked = [i for i in ids if i % 7 == 0]
    by = {}
    for r in got:
        by.setdefault(r.query_id, []).append(r)
    assert sorted(by) == sorted(asked)
    hit = 0
    where = dict(zip(ids, x))
    for q, found in by.items():
        found.sort(key=lambda r: r["rank"])
        assert [r["rank"] for r in found] == list(range(1, 11)) and q not in {r.vec_id for r in found}
        assert [(-r.score, r.vec_id) for r in found] == sorted((-r.score, r.vec_id) for r in found)
        assert all(np.isclose(r.score, where[q] @ where[r.vec_id], rtol=1e-12, atol=1e-12) for r in found)
        true = sorted(((-(where[q] * where[i]).sum(), i) for i in ids if i != q))[:10]
        hit += len({i for _, i in true} & {r.vec_id for r in found})
    assert hit >= 0.95 * 10 * len(asked)


def test_nearest_cases(spark):
    assert nearest.nearest(spark.createDataFrame([], VECTORS)).count() == 0
    few = spark.createDataFrame([(0, [1.0, 0.0], 1), (3, [2.0, 0.0], 1), (2, [2.0, 0.0], 1), (9, None, 1), (20, [0.0, 0.0], 1), (None, [1.0, 1.0], 1), (3, [2.0, 0.0], 1)], VECTORS)
    assert [(r.query_id, r["rank"], r.vec_id, r.score) for r in nearest.nearest(few).orderBy("rank").collect()] == [(0, 1, 2, 2.0), (0, 2, 3, 2.0)]
    alone = spark.createDataFrame([(0, [1.0, 0.0], 1)], VECTORS)
    assert nearest.nearest(alone).count() == 0


def test_chi_square_bound():
    sample = (np.random.default_rng(0).standard_normal((200_000, 8)) ** 2).sum(1)
    assert abs((sample < nearest.chi_square_bound(8, 0.97)).mean() - 0.97) < 0.002


# --- pipeline


def test_pipeline(spark, monkeypatch):
    """The stages against plain Python over the same models; extra columns, nulls and repeated rows come along."""
    import corpus_pipeline as pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet").withColumn("score", F.lit("s"))
    extra = spark.createDataFrame([(None, "a plain text without an id, and some more words in it", "en", None, 3, "s"), (900001, None, None, None, None, "s"), (900002, "", "en", "src1", 0, "s")], docs.schema)
    docs = docs.union(extra).union(docs.limit(3)).cache()
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    toxic, good = toxicity.fit(docs, labels), None
    rows = docs.collect()
    score = toxic.scorer()
    after = pipeline.drop_toxic(spark, docs, SF)
    assert after.columns == docs.columns
    clean = [r for r in rows if score(r.text) < 0.5]
    order = lambda rs: sorted(map(repr, rs))
    assert order(after.collect()) == order(clean) and 0 < len(clean) < len(rows)
    good = quality.fit(after, labels)
    after = pipeline.keep_quality(spark, after, SF).cache()
    clean = [r for r in clean if good.score(np.array([quality.statistics_of(r.text)]))[0] >= 0.3]
    assert order(after.collect()) == order(clean)
    single = pipeline.drop_near_duplicates(spark, after, SF).cache()
    alone = list({repr(r): r for r in clean}.values())
    prints = [plain_fingerprint(r.text or "") for r in alone]
    root = roots(range(len(alone)), [(a, b) for a, b in itertools.combinations(range(len(alone)), 2) if (prints[a] ^ prints[b]).bit_count() <= 3])
    groups = {}
    for i, r in enumerate(alone):
        groups.setdefault(root[i], []).append(r)
    want = [min(g, key=lambda r: (r.doc_id is None, r.doc_id or 0)) for g in groups.values()]
    assert order(single.collect()) == order(want)
    mixed = pipeline.mix_sources(spark, single, SF).cache()
    assert mixed.columns == docs.columns
    words = lambda r: len(re.findall(r"[^\x20\x09-\x0D]+", r.text or ""))
    sizes = {}
    for r in want:
        sizes[r.source] = sizes.get(r.source, 0) + words(r)
    took, times = dict.fromkeys(sizes, 0), {}
    for r in mixed.collect():
        took[r.source] += words(r)
        times[repr(r)] = times.get(repr(r), 0) + 1
    assert max(times.values()) <= 2 and set(times) <= set(map(repr, want))
    for s, target in water(sizes).items():  # sources of a few documents: the best sum there is
        budget = int(target + 0.5)
        rounds = min(2, budget // sizes[s]) if sizes[s] else 0
        sums = {0}
        for r in want:
            if r.source == s and rounds < 2:
                sums |= {x + words(r) for x in sums}
        assert abs(took[s] - budget) == min(abs(rounds * sizes[s] + x - budget) for x in sums)
    library = piece_codec.codec(tokenizer_file("piece_bpe_32k.model")).library
    digests = pipeline.encode(spark, mixed, SF).collect()
    assert sorted((r.doc_id or 0, r.ids_sha256) for r in digests) == sorted((r.doc_id or 0, hashlib.sha256(",".join(map(str, library.encode(r.text or ""))).encode()).hexdigest()) for r in mixed.collect())


def test_near_duplicate_rows_are_told_apart_by_all_columns(spark):
    import corpus_pipeline as pipeline

    rnd = random.Random(5)
    text = lambda n: " ".join(rnd.choice("abcdefghij") + str(rnd.randint(0, 99)) for _ in range(n))
    one, two, three, four = text(4000), text(60), text(60), text(5)
    near = one.replace(" ", "  ", 1) + " more"
    rows = [(1, one, "a"), (1, two, "a"), (1, two, "a"), (2, two, "a"), (-3, near, "b"), (None, one, "a"), (None, three, "a"), (None, three, "a"), (None, three, "b"),
            (7, four, "a"), (7, four, "b"), (8, None, "a"), (9, "", "a"), (None, " ", "a")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = pipeline.drop_near_duplicates(spark, docs, "")
    assert got.columns == docs.columns
    got = [tuple(r) for r in got.collect()]
    assert sorted(r for r in got if r[0] is not None and r[0] != 7) == [(-3, near, "b"), (1, two, "a"), (8, None, "a")]
    assert len(got) == 5 and sum(r[1] == three for r in got) == 1 and sum(r[1] == four for r in got) == 1


def test_pipeline_empty(spark):
    import corpus_pipeline as pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in pipeline.STAGES:
        docs = stage(spark, docs, SF)
        assert docs.count() == 0
