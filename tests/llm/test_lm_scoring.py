"""LM scoring against a plain, dictionary-based model."""

import math
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from fableguard.llm import lm_scoring

TEXTS = ["the cat sat on the mat", "the dog sat", "The the The", "über die straße ß", "", None, "abracadabra " * 30, "zzz q\tthe\ncat", "the cat sat on the mat", "x" * 3000]


def brute_force(texts, training, order):
    follow = defaultdict(Counter)
    for text, train in zip(texts, training, strict=True):
        if train:
            data = bytes([255]) * order + (text or "").encode() + bytes([255])
            for i in range(order, len(data)):
                for k in range(order + 1):
                    follow[data[i - k : i]][data[i]] += 1
    out = []
    for text in texts:
        data, total = bytes([255]) * order + (text or "").encode() + bytes([255]), 0.0
        for i in range(order, len(data)):
            excluded, p = set(), 1.0
            for k in range(order, -1, -1):
                here = {s: n for s, n in follow[data[i - k : i]].items() if s not in excluded}
                if not here:
                    continue
                whole = sum(here.values()) + len(here)
                if data[i] in here:
                    p *= here[data[i]] / whole
                    break
                p *= len(here) / whole
                excluded |= set(here)
            else:
                p /= 257 - len(excluded)
            total += math.log10(p)
        out.append(total)
    return out


@pytest.mark.parametrize("part", [2, 3, 100])
def test_scores(spark, part):
    docs = spark.createDataFrame([(k, t, "extra") for k, t in enumerate(TEXTS)], "doc_id long, text string, n string")
    got = {r["doc_id"]: r for r in lm_scoring.lm_score(docs, F.col("doc_id") % part == 1, chunk_bytes=1000).collect()}
    training = [k % part == 1 for k in range(len(TEXTS))]
    for k, want in enumerate(brute_force(TEXTS, training, lm_scoring.ORDER)):
        assert got[k]["score"] == pytest.approx(want, rel=1e-9), k
    count = Counter()
    split = [[*(t or "").encode().lower().split(), b" "] for t in TEXTS]
    for words, train in zip(split, training, strict=True):
        count.update(words if train else [])
    n, v = sum(count.values()), len(count)
    for k, words in enumerate(split):
        assert got[k]["base_score"] == pytest.approx(sum(math.log10((count[w] + 1) / (n + v + 1)) for w in words))
        assert (got[k]["n_tokens"], got[k]["n_known"], got[k]["train_tokens"]) == (len(words), sum(count[w] > 0 for w in words), n)


@pytest.mark.parametrize("order", [0, 1, 3, 4])
def test_orders_repeats_long_texts_and_clashes(spark, order):
    """Repeated rows, a text longer than a chunk, and columns that are named like the operator's own."""
    texts = ["abab", "abab", "ba", None, "the quick " * 400, "zz"]
    docs = spark.createDataFrame([(k, t, 1, "x") for k, t in enumerate(texts)], "doc_id long, text string, chunk int, training string").union(spark.createDataFrame([(2, "ba", 1, "x")] * 2, "doc_id long, text string, chunk int, training string"))
    all_texts, ids = [*texts, "ba", "ba"], [*range(len(texts)), 2, 2]
    want = brute_force(all_texts, [k != 5 for k in ids], order)
    got = sorted((r["doc_id"], r["score"]) for r in lm_scoring.lm_score(docs, F.col("doc_id") != 5, order=order, chunk_bytes=64).collect())
    for (i, score), (j, other) in zip(got, sorted(zip(ids, want, strict=True)), strict=True):
        assert (i, score) == (j, pytest.approx(other, rel=1e-9))


def test_empty_table_and_no_training(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert lm_scoring.lm_score(empty, F.lit(True)).collect() == []
    one = spark.createDataFrame([(None, "ab")], "doc_id long, text string")
    row = lm_scoring.lm_score(one, F.lit(False)).collect()[0]
    assert row["score"] == pytest.approx(-3 * math.log10(257))
    assert row["n_known"] == 0


def test_contexts_of_five_bytes(spark):
    docs = spark.createDataFrame([(1, "xabcdeK " * 30 + "ybcdeL " * 30), (2, "abcdeK")], "doc_id long, text string")
    got = {r["doc_id"]: r["score"] for r in lm_scoring.lm_score(docs, F.col("doc_id") == 1).collect()}
    assert got[2] == pytest.approx(brute_force(["xabcdeK " * 30 + "ybcdeL " * 30, "abcdeK"], [True, False], 5)[1], rel=1e-9)


def test_packed_answers(spark):
    """Positions of both signs, several packs a chunk, repeated values: all come back once, with their chunk."""
    rows = [(chunk, at, math.log10(1 / (1 + at % 7 + chunk))) for chunk in (3, 5, 2**62) for at in range(-50, 900, 1 + chunk % 3)]
    table = spark.createDataFrame(rows, "chunk long, at long, told double").repartition(3)
    got = []
    for r in lm_scoring.packed_answers(table, rows=200).collect():
        at, told = lm_scoring._unpack(r["answers"])
        got += zip([r["a_chunk"]] * len(at), at.tolist(), told.tolist(), strict=True)
    assert sorted(got) == sorted(rows)


@pytest.mark.parametrize("buckets", [1, 3, 64])
def test_gram_answers(spark, buckets):
    """Every chunk gets the score of each of its grams at its position, however the grams are dealt."""
    score = {k * k * 7919: -k / 3 for k in range(500)}
    asked = [(chunk, pos, gram) for chunk in (0, 9, 2**62) for pos, gram in enumerate(sorted(score, key=lambda g: g * (chunk + 3) % 1009)) if (pos + chunk) % 4]
    asks = spark.createDataFrame(asked, "chunk long, pos long, gram long").repartition(3)
    got = []
    for r in lm_scoring.gram_answers(asks, spark.createDataFrame(list(score.items()), "gram long, lp double"), buckets).collect():
        at, told = lm_scoring._unpack(r["answers"])
        got += zip([r["a_chunk"]] * len(at), at.tolist(), told.tolist(), strict=True)
    assert sorted(got) == sorted((chunk, pos, score[gram]) for chunk, pos, gram in asked)


def test_words_and_grams_of_bytes():
    draw = random.Random(3)
    signs = ["a", "B", "Z", " ", "\t", "\n", "\x0b", "\x0c", "\r", "é", "\x1c", "\x00"]
    cases = [[b""], [b"", b""], [b"  "], [b"A b", b"", b" c a"]]
    cases += [["".join(draw.choices(signs, k=draw.randint(0, 30))).encode() for _ in range(draw.randint(1, 6))] for _ in range(100)]
    for texts in cases:
        tokens = [[*(w.lower() for w in t.split()), b"\xff"] for t in texts]
        words, ids, starts = lm_scoring._words(texts)
        assert words.to_pylist() == list(dict.fromkeys(w for ws in tokens for w in ws))
        assert [words.to_pylist()[i] for i in ids] == [w for ws in tokens for w in ws]
        assert list(starts) == [sum(map(len, tokens[:k])) for k in range(len(texts))]
        for order in (0, 3, 5):
            padded = [b"\xff" * order + t + b"\xff" for t in texts]
            codes, _ = lm_scoring.grams(texts, order)
            assert list(codes) == [int.from_bytes(p[k : k + order + 1]) for p in padded for k in range(len(p) - order)]
