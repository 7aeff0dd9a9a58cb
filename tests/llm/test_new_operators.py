"""Prefix trie, licence scan and hard negatives against brute force on small tables."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from fableguard.llm import hard_negatives, licenses, prefix_trie
from fableguard.llm.radix import Direct, Index, Keys, Tree

CONVERSATIONS = "conv_id long, turn long, role string, text string, node string, depth long, at string"


def test_radix_tree_grows_its_layouts():
    rng = random.Random(1)
    keys = [bytes(rng.choice([k % 256, 0, 1]) for _ in range(rng.randint(1, 6))) for k in range(3000)]
    tree = Tree()
    for k, key in enumerate(keys):
        tree.insert(key, k % 97, k, 1, None)
    assert isinstance(tree.top, Direct)
    kinds, seen = set(), {}
    left = [(b"", kid) for _, kid in tree.top.items()]
    while left:
        above, node = left.pop()
        path = above + node.path
        kinds.add((type(node.layout), getattr(node.layout, "room", None)))
        below = [k for k, key in enumerate(keys) if key.startswith(path)]
        assert (node.n, node.given, node.least) == (len(below), sum(below), min(k % 97 for k in below))
        seen[path] = node.n
        left += [(path, kid) for _, kid in node.layout.items()]
    assert set(keys) <= set(seen)
    assert {(Keys, 4), (Keys, 16), (Index, None), (Direct, None)} <= kinds


def rebuilt(rows):
    """conv_id: list of (role, text), by the definition."""
    own = {}
    for conv, turn, role, text, *_ in rows:
        if conv is not None:
            role, text = role or "", text or ""
            digest = hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest()
            own.setdefault(conv, []).append(((turn is not None, turn or 0), digest[:16], (role, text)))
    own = {c: [t for _, _, t in sorted(turns)] for c, turns in own.items()}
    out = {}
    for c, turns in own.items():
        h, base = zlib.crc32(str(c).encode()) % 9, c - int(np.fmod(c, 5))
        out[c] = own.get(base, [])[:h] + turns[h:]
    return out


def trie(convs):
    members = {}
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    out = []
    for path, own in members.items():
        below = [p for p in members if p[: len(path)] == path]
        kids = lambda p: [q for q in members if len(q) == len(p) + 1 and q[:-1] == p]
        ended = ",".join(str(c) for c in sorted(own) if len(convs[c]) == len(path))
        saved = sum((len(members[p]) - 1) * len(p[-1][1].encode()) for p in below if p)
        parent = min(members[path[:-1]]) if path else None
        leaves = sum(not kids(p) for p in below)
        out.append((min(own), len(path), parent, len(own), len(kids(path)), leaves, saved, hashlib.sha256(ended.encode()).hexdigest()))
    return sorted(out, key=str)


def conversation_rows():
    rng = random.Random(4)
    texts = ["a", "b", None, "", "é" * 3, "long " * 20000]
    rows = []
    for c in [*range(-6, 40), 100, 101, 104]:
        same = random.Random(c // 15)
        for t in range(rng.randint(1, 12)):
            turn = None if rng.random() < 0.05 else t // 2 if rng.random() < 0.2 else t
            pick = same if rng.random() < 0.8 else rng
            rows.append((c, turn, pick.choice(["user", None, "bot"]), pick.choice(texts), "x", 7, "y"))
    rows += [(c, t, "u", "same", "x", 7, "y") for c in range(200, 230) for t in range(20)]
    return [*rows, *rows[:5], (None, 1, "u", "lost", "x", 7, "y")]


@pytest.mark.parametrize(("length", "tree", "piece"), [(1024, 65536, 1 << 20), (3, 10, 40)])
def test_prefix_trie(spark, length, tree, piece):
    """Nulls, ties, repeated rows, absent bases, turnless and equal conversations, segments and trees of few turns."""
    rows = conversation_rows()
    table = spark.createDataFrame(rows, CONVERSATIONS).repartition(5)
    numbered = prefix_trie.numbered(prefix_trie.turn_rows(table)).cache()
    got = prefix_trie.prefix_trie(prefix_trie.rebuilt(numbered), numbered.where("pos = 0").select("conv_id"), length, tree, piece)
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    assert sorted(map(tuple, got.select(columns).collect()), key=str) == trie(rebuilt(rows))


def test_prefix_trie_of_a_long_conversation(spark):
    """One conversation with nearly all turns goes over several segments."""
    turns = spark.range(5000).selectExpr("5L conv_id", "id pos", "unhex(substring(sha2(string(id), 256), 1, 32)) id", "1L size")
    convs = spark.createDataFrame([(5,), (6,)], "conv_id long")
    got = prefix_trie.prefix_trie(turns, convs, 512).collect()
    assert len(got) == 5001
    root = next(r for r in got if r["depth"] == 0)
    assert (root["n_convs"], root["n_children"], root["n_leaves"], root["saved_tokens"]) == (2, 1, 1, 0)
    assert root["ends_sha256"] == hashlib.sha256(b"6").hexdigest()
    assert next(r for r in got if r["depth"] == 5000)["ends_sha256"] == hashlib.sha256(b"5").hexdigest()


def test_prefix_trie_of_nothing(spark):
    empty = spark.createDataFrame([], CONVERSATIONS)
    numbered = prefix_trie.numbered(prefix_trie.turn_rows(empty))
    assert prefix_trie.prefix_trie(prefix_trie.rebuilt(numbered), numbered.select("conv_id")).collect() == []


def license_texts():
    notice = {label: [t for lab, t, _ in licenses.TEMPLATES if lab == label] for label, _, _ in licenses.TEMPLATES}
    texts = [None, "", "...", "Under the MIT License. under THE mit-license", "CC BY-NC 4.0", "Apache License, Version 2.0"]
    texts += [f"Some words. {t.title()}. And more é words {k}" for label in notice for k, t in enumerate(notice[label])]
    texts += ["permission is hereby granted freely", "this work is licensed under the gnu general public license version 7"]
    texts += ["word " * 300_000 + notice["isc"][0] + " the" * 300_000, notice["mpl-2"][0] + " " + notice["wtfpl"][0]]
    rng = random.Random(3)
    vocabulary = [w.decode() for w in licenses.vocabulary()]
    texts += [" ".join(rng.choice(vocabulary) for _ in range(200)) for _ in range(20)]
    for label in ("gpl-3", "zlib", "bsd-3"):  # some words of a notice are others
        for _ in range(8):
            words = notice[label][0].split()
            for _ in range(rng.randint(1, 8)):
                words[rng.randrange(len(words))] = rng.choice(["x", "of", "license"])
            texts.append(" ".join(words))
    return texts


def brute_scan(text, weight):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    starts = lambda phrase, of: [k for k in range(len(of)) if of[k : k + len(phrase)] == phrase]
    at = {label: starts(p.split(), words) for p, label in licenses.BASE.items()}
    found, best = {label for label in at if at[label]}, 0.0
    base = set(found)
    for label, template, phrases in licenses.TEMPLATES:
        own = template.split()
        total = sum(weight[w] for w in own)
        for start in range(-len(own) + 1, len(words)):
            share = sum(weight[w] for k, w in enumerate(own) if 0 <= start + k < len(words) and words[start + k] == w) / total
            near = words[max(0, start - licenses.SLACK) : start + len(own) + licenses.SLACK]
            if share >= licenses.LEAST_SHARE - 1e-9 and all(starts(p.split(), near) for p in phrases):
                found.add(label)
                best = max(best, share)
    places = [k for s in at.values() for k in s]
    score = 1.0 if base else min(best, 1.0)
    return len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(base)), ",".join(sorted(found)), score


def test_license_scan(spark):
    """Nulls, empty and long texts, repeated rows and ids, clashing columns, notices that are changed."""
    texts = license_texts()
    rows = [(f"d{k}" if k else None, t, "x", 1) for k, t in enumerate(texts)]
    rows += rows[:4]
    table = spark.createDataFrame(rows, "doc_id string, text string, labels string, word long").repartition(3)
    words = [set(licenses.word_list(t or "")) for _, t, *_ in rows]
    held = {w: sum(w in own for own in words) for w in licenses.vocabulary()}
    weight = {w.decode(): np.log(1 + len(rows) / (1 + n)) for w, n in held.items()}
    got = sorted((tuple(r) for r in licenses.scan_licenses(table).collect()), key=str)
    short = [(i, t) for i, t, *_ in rows if len(t or "") < 100_000]
    want = sorted(((i, *brute_scan(t, weight)) for i, t in short), key=str)
    long = [r for r in got if r[1] > 100_000]
    assert [r[6] for r in long] == ["isc"]
    for a, b in zip([r for r in got if r[1] <= 100_000], want, strict=True):
        assert a[:7] == b[:7]
        assert a[7] == pytest.approx(b[7])
    assert {label for r in got for label in r[6].split(",") if label} == {label for label, _, _ in licenses.TEMPLATES}


def test_license_scan_of_nothing(spark):
    assert licenses.scan_licenses(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_license_pieces():
    """Words are placed alike however a text is cut."""
    text = (" the mit license é" * 50 + "x" * 100 + " under the mit license").encode()
    number = {w: k for k, w in enumerate(licenses.vocabulary())}
    whole = licenses.occurrences(text, number)
    for piece in (1, 7, 64):
        cut = licenses.occurrences(text, number, piece)
        assert cut[0] == whole[0] and (cut[1] == whole[1]).all() and (cut[2] == whole[2]).all()


@pytest.mark.parametrize("largest", [1, 200, 10**6, 2**30])
@pytest.mark.parametrize("dim", [1, 64, 300])
def test_residue_scores_are_exact(largest, dim):
    rng = np.random.default_rng(dim)
    a, b = rng.integers(-largest, largest + 1, (7, dim)), rng.integers(-largest, largest + 1, (9, dim))
    a[0], b[0], b[1] = largest, largest, -largest
    want = (a.astype(object) @ b.astype(object).T) % 2**64
    got = hard_negatives.Residues(b, a).scores(a)
    assert (got.astype(object) % 2**64 == want).all()


def embedding_rows():
    rng = np.random.default_rng(7)
    hot = [0.5, -0.25, 0.125]
    rows = []
    for k in range(400):
        vec = hot if k % 3 == 0 else rng.uniform(-1, 1, 3).tolist()
        rows.append((k, [float(np.float32(x)) for x in vec], int(rng.integers(0, 4)), 1, "x"))
    odd = [(500, None, 1), (501, [0.1, None, 0.2], 1), (502, [0.1, float("nan"), 0.2], 1), (503, [0.1, float("inf"), 0.1], 2)]
    odd += [(504, [0.1, 0.2, 0.3], None), (None, [0.1, 0.2, 0.3], 1), (550, [0.5, 0.5], 1), (551, [0.25, 0.5], 1), (552, [0.5, 0.25], 2), (553, [], 1)]
    odd += [(600, [9.0, 9.0, 9.0], 9), (650, [-1.0, 0.5, 0.0], 2)]
    return rows + [(i, v, label, 1, "x") for i, v, label in odd] + rows[:60]


def brute_negatives(rows, positives=5, negatives=3):
    held = {}
    for i, vec, label, *_ in rows:
        if i is None or label is None or not vec or not all(x is not None and np.isfinite(x) for x in vec):
            continue
        own = ((label + 1) % 10 if i % 7 == 0 else label, [int(np.floor(256 * float(np.float32(x)))) for x in vec])
        held[i] = min(held.get(i, own), own)
    out = []
    for a, (label, vec) in held.items():
        if a % 50:
            continue
        scores = [(-sum(x * y for x, y in zip(vec, v, strict=True)), i, own) for i, (own, v) in held.items() if i != a and len(v) == len(vec)]
        for p, i, own in sorted(s for s in scores if s[2] == label)[:positives]:
            fit = sorted(s for s in scores if s[2] != label and -50 * p <= -100 * s[0] <= -95 * p)[:negatives]
            out += [(a, i, k, n, -p, -s) for k, (s, n, _) in enumerate(fit, 1)]
    return sorted(out)


def test_hard_negatives(spark):
    """Nulls, non-finite components, a common vector, ties, repeated rows, other dimensions, clashing columns."""
    rows = embedding_rows()
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, block int, limits string").repartition(4)
    held = hard_negatives.rows_of(table).cache()
    anchors = held.where("id % 50 = 0")
    want = brute_negatives(rows)
    assert len(want) > 50
    assert sorted(map(tuple, hard_negatives.mine(held, anchors).collect())) == want
    assert sorted(map(tuple, hard_negatives.mine(held, anchors, block=256, anchor_block=3).collect())) == want


def test_hard_negatives_of_nothing(spark):
    held = hard_negatives.rows_of(spark.createDataFrame([], "vec_id long, embedding array<float>, label int"))
    assert hard_negatives.mine(held, held).collect() == []
