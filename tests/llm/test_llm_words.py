"""Operators on the words of texts: license scans, spelling variants, filter interactions. Against brute force."""

import itertools
import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from spark_drift.llm import filter_audit, licenses, spelling

ODD = ["", " ", "a\n b", "x" * 5000, "ab " * 3000, "漢字🙂é", "\x00\x1c\x85　", "<s> 0xAB", "don't I'll"]


def lower(t):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in t)


# --- filter interactions ---------------------------------------------------------------


def test_lehmer_ranks():
    for n in (1, 3, 5):
        for rank, p in enumerate(itertools.permutations(range(n))):
            assert filter_audit.lehmer_rank(p, n) == rank
            assert filter_audit.lehmer_rank(p[:1], n) <= rank


def plain_mask(text):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", text) if w]
    return ((len(words) < 100) + 2 * (100 * len(set(words)) < 80 * len(words)) + 4 * (100 * len(re.findall("[A-Z]", text)) > 10 * len(text))
            + 8 * bool(re.search(r"[#$%&*|]", text)))


def plain_audit(rows, labels, letters="ABCDE"):
    """Every order applied to every document."""
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, x in labels if x == 1 and i is not None}
    fails = []
    for i, t, lang in rows:
        t = t or ""
        copy = i is not None and any(j is not None and j < i and (u or "") == t for j, u, _ in rows)
        m = plain_mask(t) + 16 * copy
        fails.append((lang or "", {letters[b] for b in range(5) if m >> b & 1}, i in good, i in toxic))
    out = {}
    for part in {f[0] for f in fails}:
        own = [f for f in fails if f[0] == part]
        total = Counter()
        for order in itertools.permutations(letters):
            kept = own
            for step, letter in enumerate(order, 1):
                gone = [f for f in kept if letter in f[1]]
                before = len([f for f in own if letter in f[1]]) - len(gone)
                kept = [f for f in kept if letter not in f[1]]
                total[letter] += len(gone)
                out[part, "".join(order), step] = [len(kept), len(gone), before, sum(f[1] == {letter} for f in own), sum(f[2] for f in gone), sum(f[3] for f in gone)]
        for (p, order, step), row in out.items():
            if p == part:
                row.append(total[order[step - 1]])
    return out


@pytest.fixture(scope="module")
def audited():
    rnd = random.Random(4)
    pool = ODD + [" ".join(rnd.choice(["The", "cat", "SAT", "on", "a", "mat#", "x|y", "dog"] + [f"w{k}" for k in range(rnd.choice([3, 400]))])
                           for _ in range(rnd.choice([5, 99, 100, 150]))) for _ in range(20)]
    rows = [(i, rnd.choice(pool), rnd.choice(["en", "de", None])) for i in range(120)]
    rows += [(None, pool[0], "en"), (None, pool[3], "en"), (None, None, "de"), (500, None, "en"), (501, pool[3], "de"), (501, pool[3], "de"), (501, "other", "de"), (-1, "x" * 5000, "en")]
    labels = [(i, rnd.choice([0, 1, None]), rnd.choice([0, 1])) for i in range(0, 140, 2)] + [(4, 1, 0), (4, 0, 1), (None, 1, 1)]
    return rows, labels


def test_filter_audit(spark, audited):
    rows, labels = audited
    docs = spark.createDataFrame([(*r, 1, "m") for r in rows], "doc_id long, text string, lang string, n int, mask string").repartition(5)
    said = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = filter_audit.interactions(filter_audit.text_masks(docs, said))
    assert got.columns == ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    found = got.collect()
    assert {tuple(r[:3]): list(r[3:]) for r in found} == plain_audit(rows, labels)
    assert len(found) == 3 * 600
    assert filter_audit.interactions(filter_audit.text_masks(docs.limit(0), said)).count() == 0


def test_other_numbers_of_filters(spark):
    masks = spark.createDataFrame([("p", 1, 4, 1, None), ("p", 3, 2, 0, 1), ("p", 0, 5, 5, 0), ("p", 3, 1, 1, 0)], "part string, mask int, n long, good long, toxic long")
    got = {(r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley) for r in filter_audit.interactions(masks, "XY").collect()}
    assert got == {("XY", 1): (5, 7, 0, 4, 2, 1, 11), ("XY", 2): (5, 0, 3, 0, 0, 0, 3), ("YX", 1): (9, 3, 0, 0, 1, 1, 3), ("YX", 2): (5, 4, 3, 4, 1, 0, 11)}
    with pytest.raises(ValueError):
        filter_audit.interactions(masks, "AAB")


# --- spelling variants -----------------------------------------------------------------


def one_edit(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    s, t = sorted((a, b), key=len)
    return any(t[:i] + t[i + 1:] == s for i in range(len(t)))


@pytest.mark.parametrize("letters", ["ab", "aéÿ🙂"])
def test_links_are_all_pairs_one_edit_apart(spark, letters):
    rnd = random.Random(7)
    words = {"".join(rnd.choice(letters) for _ in range(rnd.randint(2, 9))) for _ in range(250)}
    table = spark.createDataFrame([(w, 1) for w in words], "word string, n long")
    got = [(r.a, r.b) for r in spelling.links(table).collect()]
    want = {tuple(sorted(p, key=lambda w: (len(w), w.encode()))) for p in itertools.combinations(words, 2) if one_edit(*p)}
    assert len(got) == len(set(got)) and set(got) == want


def plain_words(rows):
    count = Counter()
    for i, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = lower(run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 31 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            count[run] += 1
    return {w: n for w, n in count.items() if len(w) >= 7 and n >= 2}


def plain_variants(count):
    out = {}
    for w, n in count.items():
        near = [v for v in count if one_edit(w, v)]
        best = min(near, key=lambda v: (-count[v], v), default=None)
        form = best if best is not None and count[best] >= 10 * n else None
        out[w] = [form, None, n, len(near), count[form] if form else None]
    for w, row in out.items():
        row[1] = w
        while out[row[1]][0] is not None:
            row[1] = out[row[1]][0]
    return out


def test_variants(spark):
    rnd = random.Random(8)
    base = ["variants", "Größenordnung", "ÇARROSSE", "letterss", "aaaaaaa", "aaaaaab", "aaaaaaaa"]
    rows = [(i, t) for i, t in enumerate(ODD)] + [(None, "letters letters"), (3, None)]
    for i in range(500):
        rows.append((1000 + i, " ".join(rnd.choices(base, [300, 200, 60, 20, 8, 4, 2], k=12)) + ("-variantx variatx" if i % 60 == 0 else "")))
    rows += [(5000 + i, "variante " * 3 + "varianteß") for i in range(2)]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, n string").repartition(4)
    found = spelling.runs(docs)
    words = spelling.vocabulary(found.select(spelling.misspelt(F.col("key"), F.col("run")).alias("word")))
    count = plain_words(rows)
    assert {r.word: r.n for r in words.collect()} == count
    got = spelling.variants(words)
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    want = plain_variants(count)
    assert {r.word: list(r[1:]) for r in got.collect()} == want
    assert any(row[0] for row in want.values()) and spelling.variants(words.limit(0)).count() == 0


def test_roots_follow_forms_to_the_end(spark):
    chain = [("a" * 7 + "b" * k, 10 ** k) for k in range(7)]
    got = {r.word: (r.form, r.root) for r in spelling.variants(spark.createDataFrame(chain, "word string, n long")).collect()}
    assert got == {w: (chain[k + 1][0] if k < 6 else None, chain[-1][0]) for k, (w, _) in enumerate(chain)}
    # a tie goes to the lesser word
    tied = spark.createDataFrame([("aaaaaaab", 50), ("aaaaaaac", 50), ("aaaaaaad", 5)], "word string, n long")
    assert {r.word: r.form for r in spelling.variants(tied).collect()} == {"aaaaaaab": None, "aaaaaaac": None, "aaaaaaad": "aaaaaaab"}
    with pytest.raises(ValueError):
        spelling.variants(tied, ratio=1)


# --- license scans ---------------------------------------------------------------------


def plain_scan(text, phrases, templates, threshold):
    w = licenses.words_of(text or "")
    places = [(i, label) for p, label in phrases for i in range(len(w)) if w[i:i + len(p.split())] == p.split()]
    found, best = set(), 0.0
    for t in licenses.template_table(templates, threshold):
        for s in range(0, len(w), t["reach"]):
            share = len(set(w[s:s + 2 * t["reach"]]) & set(t["tokens"])) / len(t["tokens"])
            if len(set(w[s:s + 2 * t["reach"]]) & set(t["tokens"])) >= t["need"]:
                found.add(t["label"])
                best = max(best, share)
    base = {label for _, label in places}
    starts = [i for i, _ in places]
    return (len(w), len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted(base)), ",".join(sorted(base | found)), 1.0 if places else best)


@pytest.mark.parametrize("threshold", [0.5, 0.9])
def test_license_scan(spark, threshold):
    rnd = random.Random(9)
    texts = [t for _, t in licenses.TEMPLATES]
    filler = ["the", "of", "license", "MIT", "version", "is", "Ω", "naïve", "2", "software", "general", "public"] + [f"w{k}" for k in range(40)]
    rows = list(ODD) + [None, "MIT License", "mit-LICENSE; apache license. General Public License", "general public mit license license"]
    for _ in range(60):
        words = rnd.choices(filler, k=rnd.choice([0, 5, 60, 400]))
        for t in rnd.sample(texts, rnd.randint(0, 2)):
            own = t.split()
            for _ in range(rnd.randint(0, 3)):
                own.pop(rnd.randrange(len(own)))
            at = rnd.randint(0, len(words))
            words[at:at] = own
        rows.append(" ".join(words))
    docs = spark.createDataFrame([(i, t, "x", 1.0) for i, t in enumerate(rows)] + [(None, "mit license", None, None), (3, rows[3], "y", None)],
                                 "doc_id long, text string, labels string, score double").repartition(4)
    got = licenses.scan(docs, ["doc_id", "labels"], threshold=threshold)
    assert got.columns == ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]
    want = Counter((i, *plain_scan(t, licenses.PHRASES, licenses.TEMPLATES, threshold)) for i, t in [*enumerate(rows), (None, "mit license"), (3, rows[3])])
    assert Counter(tuple(r) for r in got.collect()) == want
    assert licenses.scan(docs.limit(0)).count() == 0


def test_license_scan_without_templates_or_phrases(spark):
    docs = spark.createDataFrame([(1, "the MIT license")], "doc_id long, text string")
    assert [tuple(r) for r in licenses.scan(docs, templates=[]).collect()] == [(1, 3, 1, 1, 1, "mit", "mit", 1.0)]
    assert [tuple(r) for r in licenses.scan(docs, phrases=[]).collect()] == [(1, 3, 0, None, None, "", "", 0.0)]


def test_license_scan_is_native(spark):
    docs = spark.createDataFrame([(1, "the MIT license")], "doc_id long, text string")
    plan = licenses.scan(docs)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow|MapPartitions", plan)
