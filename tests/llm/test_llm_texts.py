"""Operators on single texts: codec, counts, id store, classifiers. Against the libraries and brute force."""

import hashlib
import heapq
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from spark_drift.llm import id_store, piece_codec, quality, token_counts, toxicity
from spark_drift.llm.common import scratch
from spark_drift.llm.registry import tokenizer_file

SF = "/root/testdata/sf0.1"
MERGES, BYTES = tokenizer_file("piece_bpe_32k.model"), tokenizer_file("byte_bpe_50k.json")
ODD = ["", " ", "  a  b ", "a\n b", "x" * 5000, "ab " * 3000, "▁▁ ▁", "漢字🙂é", "\x00\x1c\x85　", "<s> <|endoftext|> 0xAB", "don't I'll", "a\t b\r\n\r\nc ", "1.5,3;x²"]
LETTERS = "aeth  ▁éß漢🙂\n\t<>0'st.,!​\x00\x1c\x1f\x85\xa0 　\r²"


def some_texts(n, seed=1):
    rnd = random.Random(seed)
    return ODD + ["".join(rnd.choice(LETTERS) for _ in range(rnd.randint(0, 25))) for _ in range(n)]


@pytest.fixture(scope="module")
def odd_docs(spark):
    """Nulls in every column, odd and long texts, repeated rows, extra columns named like results."""
    rows = [(i, t, "x", 7, "y") for i, t in enumerate(ODD)] + [(None, "a b", None, None, None), (50, None, None, 1, None), (51, "a b", "x", 1, "y"), (51, "a b", "x", 1, "y")]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, n_tokens int, score string")


def test_pieces_like_library():
    c = piece_codec.codec(MERGES)
    for t in some_texts(3000):
        assert c.encode(t) == c.library.encode(t), repr(t)
    pieces = list(c.ids)
    rnd = random.Random(2)
    for _ in range(2000):
        t = "".join(rnd.choice(pieces) for _ in range(rnd.randint(0, 8)))
        assert c.encode(t) == c.library.encode(t), repr(t)


def test_pieces_of_all_planes_in_any_order():
    rnd = random.Random(3)
    starts = ["  ", " a", "the", "\n", ""]
    texts = ["  " + chr(0x102D15), "  atie"]
    texts += [rnd.choice(starts) + "".join(rnd.choice(["a", " ", "tie", chr(rnd.randint(0x100000, 0x10FFFF)), chr(rnd.randint(0x10000, 0x1FFFF))]) for _ in range(6))
              for _ in range(2000)]
    for order in (texts, texts[::-1]):
        c = piece_codec.PieceCodec(MERGES)
        for t in order:
            assert c.encode(t) == c.library.encode(t), repr(t)


@settings(max_examples=200, deadline=None)
@given(st.text())
def test_pieces_any_text(t):
    c = piece_codec.codec(MERGES)
    assert c.encode(t) == c.library.encode(t)


def test_piece_digests(spark, odd_docs):
    library = piece_codec.codec(MERGES).library
    got = piece_codec.piece_digests(odd_docs, MERGES, ["doc_id", "n_tokens"])
    assert got.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    texts = [r.text for r in odd_docs.select("text").collect()]
    for r, t in zip(got.collect(), texts):
        ids = library.encode(t or "")
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids).encode()).hexdigest()
    ids = piece_codec.encode_texts(odd_docs, MERGES, ["doc_id"])
    back = [r.text for r in piece_codec.decode_ids(ids, MERGES, ["doc_id"]).collect()]
    assert back == [library.decode(library.encode(t or "")) for t in texts]
    assert piece_codec.piece_digests(odd_docs.limit(0), MERGES, ["doc_id"]).count() == 0


def test_unsuitable_models_are_refused():
    with pytest.raises(ValueError):
        piece_codec.PieceCodec(token_counts.unigram_model(MERGES))
    with pytest.raises(ValueError):
        token_counts.UnigramCounter(MERGES)


def test_counts_like_library(spark, odd_docs):
    from sentencepiece import SentencePieceProcessor

    model = token_counts.unigram_model(MERGES)
    library, c = SentencePieceProcessor(model_proto=model), token_counts.counter(model)
    texts = some_texts(3000) + [" ".join(some_texts(300, seed=5))]
    pieces = list(c.scores)
    rnd = random.Random(3)
    texts += ["".join(rnd.choice(pieces) for _ in range(rnd.randint(0, 8))) for _ in range(2000)]
    assert [c.count(t)[0] for t in texts] == [len(x) for x in library.encode(texts)]
    for t in texts[:200]:
        ids = library.encode(t)
        if t and all(not library.is_byte(i) for i in ids):
            assert c.count(t)[1] == sum(library.get_score(i) for i in ids)
    got = token_counts.token_counts(odd_docs, model, ["doc_id", "n_tokens"]).collect()
    assert [r.n_tokens for r in got] == [len(library.encode(r.text or "")) for r in odd_docs.collect()]
    assert token_counts.token_counts(odd_docs.limit(0), model, ["doc_id"]).count() == 0


def test_whole_text_path_equals_words():
    c = token_counts.counter(token_counts.unigram_model(MERGES))
    for t in some_texts(300, seed=9):
        if t:
            assert c.count(t) == c._path(c.prefix + t.replace("▁", " "))


def test_byte_ids_like_library():
    enc = id_store.byte_bpe(BYTES)
    rnd = random.Random(4)
    texts = some_texts(20000, seed=6) + [None] + ["".join(rnd.choice(["<|endoftext|>", " ", "a", "'s", "\n", "b,"]) for _ in range(9)) for _ in range(2000)]
    ids, ends = enc.encode(pa.array(texts, pa.string()))
    want = [e.ids for e in enc.library.encode_batch([t or "" for t in texts], add_special_tokens=False)]
    assert [x.tolist() for x in np.split(ids, ends[:-1])] == want


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 10**6), min_size=1, max_size=60), st.integers(6, 20))
def test_code_lengths(counts, most):
    lengths = id_store.code_lengths(np.array(counts), most)
    assert lengths.min() >= 1 and lengths.max() <= most
    if len(counts) > 1:
        assert sum(2.0**-n for n in lengths) == 1
    if most == 20 and len(counts) > 1:
        heap, best = list(counts), 0
        heapq.heapify(heap)
        while len(heap) > 1:
            both = heapq.heappop(heap) + heapq.heappop(heap)
            best += both
            heapq.heappush(heap, both)
        depth = int(np.ceil(np.log(sum(counts) + 1) / np.log((1 + 5**0.5) / 2)))
        assert int(lengths @ np.array(counts)) == best or depth > most


def test_limited_lengths_are_best():
    """Against all length assignments of a small alphabet."""
    import itertools

    counts, most = np.array([1, 1, 2, 4, 9, 20]), 3
    best = min(sum(n * c for n, c in zip(ls, counts)) for ls in itertools.product(range(1, most + 1), repeat=6) if sum(2.0**-n for n in ls) <= 1)
    assert id_store.code_lengths(counts, most) @ counts == best
    with pytest.raises(ValueError):
        id_store.code_lengths(np.ones(9), 3)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 300), min_size=1, max_size=400))
def test_block_round_trip(ids):
    ids = np.array(ids)
    seen, counts = np.unique(ids, return_counts=True)
    book = id_store.Codebook(seen, id_store.code_lengths(counts))
    payload, checkpoints = book.encode(ids)
    assert len(checkpoints) == -(-len(ids) // id_store.CHECKPOINT)
    assert book.decode(payload, checkpoints, len(ids)).tolist() == ids.tolist()


def test_store(spark, odd_docs, monkeypatch):
    enc = id_store.byte_bpe(BYTES)
    monkeypatch.setattr(id_store, "BLOCK_IDS", 50)
    folder = scratch(spark, "store")
    id_store.store_corpus(odd_docs.repartition(3), BYTES, folder, 2)
    got = sorted(((r.start, r.doc_id, r.n_tokens, r.ids_crc32) for r in id_store.read_ids(spark, folder, id_store.CRC, id_store.crc_of).collect()))
    want, start = [], 0
    rows = [(r.doc_id, enc.library.encode(r.text or "", add_special_tokens=False).ids + [2]) for r in odd_docs.collect()]
    for key, ids in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        want.append((start, key, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert got == want
    empty = scratch(spark, "store")
    id_store.store_corpus(odd_docs.limit(0), BYTES, empty, 2)
    assert id_store.read_ids(spark, empty, id_store.CRC, id_store.crc_of).count() == 0


def held_out_rows(spark, label):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    return docs, labels, {r.doc_id: r[label] for r in labels.collect() if zlib.crc32(str(r.doc_id).encode()) % 5 == 0}


def test_quality_held_out(spark):
    docs, labels, truth = held_out_rows(spark, "quality")
    got = {r.doc_id: r for r in quality.score(docs, quality.fit(docs, labels), ["doc_id"]).collect()}
    assert len(got) == docs.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got.values())
    assert all(got[k].held_out for k in truth)
    assert np.mean([got[k].predicted == y for k, y in truth.items()]) > 0.97


def test_quality_statistics_by_hand():
    x = dict(zip(quality.FEATURES, quality.statistics_of("Ab cd%\nAb cd%\n")))
    assert x["log_words"] == np.log(5) and x["distinct_lines"] == np.log(1.5 / 2.5) and x["ends_in_symbol"] == np.log(2.5 / 3.5)
    assert x["uppercase"] == np.log(2.5 / 7.5)


def test_quality_density():
    """The score against the Gaussian densities written out."""
    rnd = np.random.default_rng(0)
    a, b = rnd.normal(0, 1, (200, 3)), rnd.normal(1, 2, (300, 3))
    m = quality.model_of([200, 300], [a.sum(0), b.sum(0)], [a.T @ a, b.T @ b], 0.1)
    x = np.column_stack([np.log1p(rnd.integers(0, 5000, 20)), rnd.normal(0, 2, (20, 2))])

    def log_density(z, own):
        cov = np.cov(own.T, bias=True)
        words = max(1, round(float(np.expm1(z[0]))))
        cov = 0.9 * cov + 0.1 * np.diag(np.diag(cov)) + (quality.FLOOR + quality.CHANCE / 2 ** int(np.log2(words))) * np.eye(3)
        d = z - own.mean(0)
        return -0.5 * (d @ np.linalg.inv(cov) @ d + np.log(np.linalg.det(cov)))

    want = [1 / (1 + np.exp(np.clip(log_density(z, a) - log_density(z, b) + np.log(200 / 300), -30, 30))) for z in x]
    assert np.allclose(m.score(x), want)


@pytest.mark.parametrize("operator,label", [(quality, "quality"), (toxicity, "toxic")])
def test_classifier_cases(spark, odd_docs, operator, label):
    """Odd rows score like plain ones; without both labels the score is the share of label 1."""
    none = spark.createDataFrame([], f"doc_id long, {label} int")
    model = operator.fit(odd_docs, none)
    got = operator.score(odd_docs, model, ["doc_id", "score", "source"]).collect()
    assert got[0].__fields__ == ["doc_id", "source", "held_out", "score", "predicted"]
    assert len(got) == odd_docs.count() and {r.score for r in got} == {0.0} and not [r for r in got if r.doc_id is None][0].held_out
    ones = spark.createDataFrame([(i, 1) for i in range(10)] + [(None, 0), (3, None)], f"doc_id long, {label} int")
    assert {r.score for r in operator.score(odd_docs, operator.fit(odd_docs, ones), ["doc_id"]).collect()} == {1.0}
    both = spark.createDataFrame([(i, i % 2) for i in range(13)], f"doc_id long, {label} int")
    got = operator.score(odd_docs, operator.fit(odd_docs, both), ["doc_id"]).collect()
    assert all(0 <= r.score <= 1 for r in got)
    again = [r.score for r in got if r.doc_id == 51]
    assert len(again) == 2 and again[0] == again[1]
    assert operator.score(odd_docs.limit(0), model, ["doc_id"]).count() == 0


def test_toxicity_held_out(spark):
    docs, labels, truth = held_out_rows(spark, "toxic")
    got = {r.doc_id: r for r in toxicity.score(docs, toxicity.fit(docs, labels), ["doc_id"]).collect()}
    toxic = [got[k].predicted for k, y in truth.items() if y == 1]
    clean = [got[k].predicted for k, y in truth.items() if y == 0]
    assert np.mean(toxic) > 0.75 and np.mean(clean) < 0.02  # some labelled texts here hold no toxic word


def test_unseen_spellings():
    words = ["the", "of", "and", "river", "stone", "house", "green"]
    rnd = random.Random(1)
    clean = [" ".join(rnd.choice(words) for _ in range(40)) for _ in range(200)]
    bad = [t.replace("stone", "dreadful", 1) + " dreadful" for t in clean]
    model = toxicity.train(clean + bad, [0] * 200 + [1] * 200, 0.5)
    score = model.scorer()
    assert score(clean[0]) < 0.5 < score(clean[0] + " dreadfull house green the of")
    assert score("the of dreadfuls and") > 0.5 and score("") == score(None) == score("...")


def test_sample_is_bounded(spark):
    rows = spark.createDataFrame([(i, "word " * (i % 5 + 1)) for i in range(400)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(400)], "doc_id long, toxic int")
    seen = []
    real = toxicity.train
    toxicity.train = lambda texts, y, share: seen.append(sorted(y)) or real(texts, y, share)
    try:
        toxicity.fit(rows, labels, sample=20)
    finally:
        toxicity.train = real
    assert seen == [[0] * 20 + [1] * 20]
