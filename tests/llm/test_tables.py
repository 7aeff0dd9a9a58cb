"""Operators against brute force on small tables with nulls, repeats, ties, empty and long texts, clashing columns."""

import hashlib
import random
import re
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from fableguard.llm import exact_dedup, language_id, mixing, near_dup, pii, sentencepiece, sharding, vector_search, warc
from fableguard.llm.common import new_folder, repeated

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, digest string, sid long"
EMPTY_OK = [exact_dedup.exact_dedup, mixing.mix, near_dup.near_dup, pii.find_pii, language_id.identify, sentencepiece.encode]


def docs(spark, texts, sources=None, ids=None):
    rows = [((ids or range(len(texts)))[k], t, "en", (sources or ["s"] * len(texts))[k], 0, "x", 1) for k, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.mark.parametrize("operator", EMPTY_OK)
def test_empty_table(spark, operator):
    assert operator(spark.createDataFrame([], SCHEMA)).collect() == []


def test_exact_dedup(spark):
    texts = ["a", "a", "A", None, "", "b"] + ["hot"] * 40 + ["long " * 30000, "long " * 30000]
    ids = [*range(46), 3, 3]
    rows = exact_dedup.exact_dedup(docs(spark, texts, ids=ids), counters=4).collect()
    groups = {}
    for i, t in zip(ids, texts, strict=True):
        groups.setdefault(hashlib.sha256((t or "").encode()).hexdigest(), []).append(i)
    assert len(rows) == len(texts)
    for r in rows:
        own = groups[r["text_sha256"]]
        assert (r["keep_id"], r["group_size"]) == (max(own), len(own))
    assert sum(r["kept"] for r in rows) == len(groups)
    assert all(r["doc_id"] == r["keep_id"] for r in rows if r["kept"])


def test_exact_dedup_of_repeated_rows(spark):
    """Heavy texts whose winner is repeated, and one without any id."""
    rows = [(9, "hot")] * 50 + [(k, "hot") for k in range(9)] + [(None, "none")] * 40 + [(3, "b")]
    table = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = exact_dedup.exact_dedup(table, counters=2).collect()
    assert len(got) == len(rows)
    assert sorted((r["doc_id"] or -1, r["group_size"]) for r in got if r["kept"]) == [(-1, 40), (3, 1), (9, 59)]
    assert {(r["keep_id"], r["group_size"]) for r in got} == {(9, 59), (None, 40), (3, 1)}


def test_misra_gries_keeps_heavy_digests(spark):
    keyed = spark.createDataFrame([("h",)] * 30 + [(f"x{k}",) for k in range(60)], "digest string").repartition(3)
    assert "h" in {r["digest"] for r in exact_dedup.summaries(keyed, 4).collect()}


def test_mixing(spark):
    rng = random.Random(2)
    sources = [rng.choice(["b", "a", None, "hot", "hot", "hot"]) for _ in range(1500)]
    texts = ["w " * rng.randint(0, 40) if k % 50 else None for k in range(1500)]
    table = docs(spark, texts, sources)
    rows = mixing.mix(table, chunk=16).collect()
    assert sorted(map(tuple, rows)) == sorted(map(tuple, mixing.mix(table.repartition(3), chunk=16).collect()))
    size = {k: len((t or "").split()) for k, t in enumerate(texts)}
    total = {s: sum(size[k] for k in size if sources[k] == s) for s in set(sources)}
    names = sorted((s for s in total if s is not None)) + [None]
    weight = {s: k % 3 + 1 for k, s in enumerate(names)}
    target, left, rest = {}, set(names), sum(total.values())
    while left:
        level = rest / sum(weight[s] for s in left)
        above = {s for s in left if weight[s] * level > 3 * total[s]}
        target |= {s: 3.0 * total[s] for s in above} if above else {s: weight[s] * level for s in left}
        rest, left = rest - sum(3 * total[s] for s in above), left - above if above else set()
    taken = dict.fromkeys(names, 0)
    for r in rows:
        s = sources[r["doc_id"]]
        assert r["target"] == pytest.approx(target[s])
        assert (r["size"], r["source_size"]) == (size[r["doc_id"]], total[s])
        assert r["taken"] <= 3 * r["size"]
        taken[s] += r["taken"]
    assert {s: taken[s] - target[s] for s in names if abs(taken[s] - target[s]) > 40} == {}


def test_sharding(spark):
    names = {"a": 1, "b": 2, "c": 1}
    table = sharding.lookup_table(names, 1009)
    share = np.bincount(table) / 1009
    assert abs(share[1] - 0.5) < 0.01
    fewer = sharding.lookup_table({"a": 1, "b": 2}, 1009)
    assert np.mean([x != y for x, y in zip(table, fewer, strict=True) if x != 2]) < 0.35
    rows = sharding.shard(docs(spark, ["x", None], ids=[None, 7]), ["doc_id"], names, 1009).collect()
    assert {r["doc_id"] for r in rows} == {None, 7}
    clash = spark.createDataFrame([(1, "x", 2), (1, "x", 2)], "slot int, shard_name string, shard int")
    rows = sharding.shard(clash, ["slot"], names, 1009, ["shard_name"]).collect()
    assert [(r["key_slot"], r["key_shard_name"], table[r["slot"]] == r["shard"]) for r in rows] == [(1, "x", True)] * 2
    assert sharding.shard(clash.limit(0), ["shard"], names, 1009).columns == ["key_shard", "slot", "shard", "shard_name"]
    assert sharding.shard(clash.limit(0), ["shard"], names, 1009).collect() == []
    # ties of weights go by the order given: equal shards claim in turn
    assert abs(int((np.array(sharding.lookup_table(["a", "b"], 1009)) == 0).sum()) - 505) <= 1
    with pytest.raises(ValueError, match="prime"):
        sharding.lookup_table(names, 1000)


def test_language_codes(spark):
    rng = random.Random(1)
    words = {"en": ["the", "and", "thing", "with"], "de": ["der", "und", "nicht", "über"], "fr": ["le", "être", "que", "où"]}
    rows = [(k, " ".join(rng.choices(words[x], k=rng.randint(3, 30))), x) for k, x in enumerate(rng.choices(list(words), k=300))]
    rows += [(1000, None, "en"), (1001, "123 !!", "en"), (1002, "", None), (1003, "und " * 50000, None)]
    got = {r["doc_id"]: r for r in language_id.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    held = [k for k, _, x in rows[:300] if got[k]["held_out"]]
    assert held
    assert np.mean([got[k]["lang_pred"] == rows[k][2] for k in held]) > 0.95
    assert [got[k]["lang_pred"] for k in (1000, 1001, 1002, 1003)] == ["und", "und", "und", "de"]
    assert all(0 <= r["score"] <= 1 for r in got.values())
    for n in (2, 4, 9):
        code = language_id.codewords(n)
        assert len({tuple(c) for c in code}) == n
        assert (np.abs(code.sum(0)) < n).all()


def test_language_codes_by_hand(spark):
    """Margins and shares against a plain loop over trigrams; a repeated row, a long text in pieces, a column named score."""
    rng = random.Random(9)
    words = {"en": ["the", "and", "thing"], "de": ["der", "und", "über"], "fr": ["le", "être", "que"]}
    rows = [(k, " ".join(rng.choices(words[x], k=rng.randint(1, 20))), x, 0.5) for k, x in enumerate(rng.choices(list(words), k=120))]
    rows += [rows[3], (500, "The über " * 60_000, None, 0.1)]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string, score double")
    model = language_id.fit(language_id.labelled(table))
    got = sorted((r["doc_id"], r["lang_pred"], round(r["score"], 9)) for r in language_id.predict(table, model).collect())

    def features(text):
        data = b"  " + text.lower().encode().translate(language_id.PLAIN) + b" " + b"  "
        grams = [int.from_bytes(data[i : i + 3], "big") for i in range(len(data) - 2)]
        return [((g * 2654435761) & 0xFFFFFFFF) >> (32 - language_id.FEATURES.bit_length() + 1) for g in grams]

    want = []
    for k, text, _, _ in rows[:-1]:  # the long text's pieces each have blanks around
        f = features(text)
        margin = sum(model.weights[x].astype(float) for x in f) / np.sqrt(1 + len(f))
        distance = [float((np.log1p(np.exp(-margin * c)) * t).sum()) for c, t in zip(model.code, model.trust, strict=True)]
        share = np.exp(min(distance) - np.array(distance))
        best = int(np.argmin(distance))
        want.append((k, model.langs[best], round(float(share[best] / share.sum()), 9)))
    assert [x for x in got if x[0] != 500] == sorted(want)
    assert [x[1] for x in got if x[0] == 500] in (["de"], ["en"])


PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def valid(kind, m):
    d = re.sub("[^0-9]", "", m)
    if kind == "ip":
        return all(int(x) <= 255 for x in m.split("."))
    if kind == "card":
        twice = [int(x) * (1 + k % 2) for k, x in enumerate(reversed(d))]
        return 13 <= len(d) <= 19 and sum(x - 9 * (x > 9) for x in twice) % 10 == 0
    return kind == "email" or 9 <= len(d) <= 15


def test_pii_base_spans(spark):
    rng = random.Random(3)
    texts = ["a@b.c_d@e.f x+y@z-1.co.uk.", "1.2.3.4.5.6.7.8 999.1.1.1 0001.2.3.4", "4111 1111-1111 1111 and 4111111111111112", "+1 (555) 123-4567 ++12 3456 7890) 😀 +1 23456789", None, "", "1" * 30000 + " a" * 100 + "@", "x" * 100000]
    texts += ["".join(rng.choices("ab1 .@+-()5é😀", k=rng.randint(0, 60))) for _ in range(300)]
    for r in pii.find_pii(docs(spark, texts)).collect():
        text = texts[r["doc_id"]] or ""
        want = [(k, m.start(), m.end()) for k, p in PATTERNS.items() for m in re.finditer(p, text) if valid(k, m[0])]
        assert r["base_spans"] == ",".join(f"{k}:{a}:{b}" for k, a, b in want), text[:80]
        assert set(r["base_spans"].split(",")) <= set(r["spans"].split(",")) | {""}
        assert r["n_email"] == sum(k == "email" for k, _, _ in want)


def test_pii_adds_what_no_base_span_touches(spark):
    rng = random.Random(8)
    digits = lambda n: "".join(rng.choices("0123456789", k=n))
    word = lambda: "".join(rng.choices("abcdefghij", k=6))
    texts, want, never = [], [], []
    for k in range(900):
        lead, form = f"{word()} {word()} ", k % 6
        number = f"({digits(3)}) {digits(3)}-{digits(4)}"
        hidden = [f"{word()}@{word()}.com", f"+1 {number}", number, f"{word()} [at] {word()} [dot] com", f"1 {number}", "4" + digits(15)][form]
        texts.append(f"{lead}{hidden}, {word()}")
        span = f"{len(lead)}:{len(lead) + len(hidden)}"
        if form in (2, 3, 4):
            want.append((k, ("email:" if form == 3 else "phone:") + span))
        elif form == 5 and not valid("card", hidden):
            never.append((k, span))
    got = {r["doc_id"]: r["spans"].split(",") for r in pii.find_pii(docs(spark, texts)).collect()}
    assert [x for x in want if x[1] not in got[x[0]]] == []
    assert [x for x in never if any(s.endswith(x[1]) for s in got[x[0]])] == []


def test_warc_round_trip(spark):
    html = ["<p>é</p>" * k for k in range(40)] + ["<p>é</p>" * 3, None, "", "big " * 50000]
    rows = [(k, None if k % 7 == 0 else f"http://x/{k}\r\nEvil: 1", h, "clash") for k, h in enumerate(html)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, digest string")
    folder = new_folder(spark, "warc")
    warc.write_archives(pages, folder, archive_bytes=50000)
    got = {r["page_id"]: r for r in warc.read_archives(spark, folder).collect()}
    assert len(got) == len(html)
    for k, h in enumerate(html):
        own = (h or "").encode()
        first = min(j for j, x in enumerate(html) if (x or "") == (h or ""))
        assert (got[k]["payload_bytes"], got[k]["payload_digest"]) == (len(own), warc.digest32(own))
        assert (got[k]["record_type"], got[k]["refers_to"]) == (("response", None) if first == k else ("revisit", first))
        assert (got[k]["payload"] is None) if first != k else (bytes(got[k]["payload"]) == own)


@pytest.mark.parametrize(("records", "trained"), [([b"<p>record %d %s</p>" % (k, bytes([97 + k * j % 26 for j in range(400)])) for k in range(400)], True), ([b"small %d" % k for k in range(40)], False)])
def test_warc_dictionary(records, trained):
    data = warc.archive(records)
    kind, size = struct.unpack_from("<II", data)
    assert kind == warc.SKIPPABLE
    assert size > 0
    assert (data[8:12] == b"\x37\xa4\x30\xec") == trained
    assert list(warc.frames(data)) == records
    assert list(warc.frames(warc.archive([b"tiny"]))) == [b"tiny"]


def test_warc_edges(spark):
    schema = "page_id long, url string, html string"
    folder = new_folder(spark, "warc")
    assert warc.write_archives(spark.createDataFrame([], schema), folder).collect() == []
    rows = [(5, "u", "same"), (5, "u", "same"), (None, "u", "same"), (7, None, "same"), (None, None, "alone"), (2, "x" * 5000, "y" * 2_000_000)]
    warc.write_archives(spark.createDataFrame(rows, schema).repartition(2), folder)
    got = sorted((r["page_id"] or -1, r["payload_bytes"], r["record_type"], r["refers_to"] or -1) for r in warc.read_archives(spark, folder).collect())
    assert got == [(-1, 4, "revisit", 5), (-1, 5, "response", -1), (2, 2_000_000, "response", -1), (5, 4, "response", -1), (5, 4, "response", -1), (7, 4, "revisit", 5)]
    folder = new_folder(spark, "warc")
    warc.write_archives(spark.createDataFrame([("12", "u", "a"), ("x-1", "u", "b")], "page_id string, url string, html string"), folder)
    assert sorted(r["page_id"] or -1 for r in warc.read_archives(spark, folder).collect()) == [-1, 12]


def test_vector_search(spark):
    rng = np.random.default_rng(5)
    vectors = rng.integers(-40, 40, (400, 6))
    vectors[5:30] = vectors[4]
    df = spark.createDataFrame([(k, [int(x) for x in v]) for k, v in enumerate(vectors)], "id long, vec array<long>").repartition(3)
    got = {}
    for r in vector_search.search(df, df.where("id % 50 = 0"), k=5, block=64, query_block=3, task_blocks=2).collect():
        got.setdefault(r["query_id"], {})[r["rank"]] = (r["vec_id"], r["score"])
    for q in range(0, 400, 50):
        order = sorted((k for k in range(400) if k != q), key=lambda k: (-int(vectors[k] @ vectors[q]), k))[:5]
        assert [got[q][i + 1] for i in range(5)] == [(k, int(vectors[k] @ vectors[q])) for k in order]


def test_vector_search_query(spark, tmp_path):
    """The query with nulls, not finite components, other dimensions, ties over the kth place, repeats; and an empty table."""
    rng = np.random.default_rng(3)
    rows = [(k, [float(x) for x in rng.normal(size=4).round(2)]) for k in range(160)]
    rows += [(k, [0.5, 0.5, 0.5, 0.5]) for k in range(200, 212)] + rows[:30]
    rows += [(300, None), (350, [None, 1.0, 1.0, 1.0]), (400, [float("nan")] * 4), (450, [float("inf")] * 4), (500, []), (550, [1.0, 2.0]), (551, [3.0, 1.0]), (None, [1.0] * 4), (600, [1e6, -1e6, 1e6, 1e6])]
    schema = "vec_id long, embedding array<float>, id string, vec string"
    spark.createDataFrame([(*r, "a", "b") for r in rows], schema).repartition(3).write.parquet(str(tmp_path / "embeddings.parquet"))
    usable = {}
    for k, v in rows:
        if k is not None and v and all(x is not None and np.isfinite(x) for x in v):
            usable[k] = [int(np.floor(256 * float(np.float32(x)))) for x in v]
    want = {}
    for q in (k for k in usable if k % 50 == 0):
        scores = sorted((-sum(a * b for a, b in zip(v, usable[q], strict=True)), k) for k, v in usable.items() if k != q and len(v) == len(usable[q]))
        want |= {(q, n + 1): (k, -s) for n, (s, k) in enumerate(scores[:5])}
    got = vector_search.op6_approximation_search(spark, str(tmp_path)).collect()
    assert {(r["query_id"], r["rank"]): (r["vec_id"], r["score"]) for r in got} == want
    assert len(got) == len(want)
    spark.createDataFrame([], schema).write.parquet(str(tmp_path / "none" / "embeddings.parquet"))
    assert vector_search.op6_approximation_search(spark, str(tmp_path / "none")).collect() == []


def test_vector_search_counts_repeated_ids_once(spark):
    rng = np.random.default_rng(7)
    rows = [(k, [int(x) for x in v]) for k, v in enumerate(rng.integers(-40, 40, (60, 4)))]
    rows += [(900, [60, 60, 60, 60])] * 5 + [(901, [x, 50, 50, 50]) for x in range(40, 52)] + rows[10:20] * 3
    queries = [(k, [int(x) for x in rng.integers(-40, 40, 4)]) for k in range(20, 25)] + [(2000, [9, 8, 7, 6]), (900, [1, 1, 1, 1])]
    schema = "id long, vec array<long>"
    found = vector_search.search(spark.createDataFrame(rows, schema).coalesce(1), spark.createDataFrame(queries, schema), k=5, block=64)
    got = {(r["query_id"], r["rank"]): (r["vec_id"], r["score"]) for r in found.collect()}
    want = {}
    for q, v in queries:
        score = {}
        for k, w in rows:
            if k != q:
                score[k] = max(score.get(k, -(10**9)), int(np.dot(v, w)))
        want |= {(q, n + 1): x for n, x in enumerate(sorted(score.items(), key=lambda x: (-x[1], x[0]))[:5])}
    assert got == want


def sets_of(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def test_near_duplicates(spark):
    rng = random.Random(6)
    vocab = [f"w{k}" for k in range(300)]
    base = [rng.choices(vocab, k=rng.randint(20, 120)) for _ in range(25)]
    texts = [None, "", "one two", "ONE  two", "one"]
    for b in base:
        for _ in range(rng.choice([1, 2, 12])):
            c = list(b)
            for _ in range(rng.randint(0, 4)):
                c[rng.randrange(len(c))] = rng.choice(vocab)
            texts.append(" ".join(c))
    texts += [" ".join(base[0] + rng.choices(vocab, k=8)) for _ in range(30)]
    sets = [sets_of(t) for t in texts]
    comp = list(range(len(texts)))

    def root(x):
        while comp[x] != x:
            x = comp[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            if sets[i] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                a, b = sorted((root(i), root(j)))
                comp[b] = a
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_dup.near_dup(docs(spark, texts), group=4, leaders=2).collect()}
    assert got == {k: (len(sets[k]), root(k)) for k in range(len(texts))}


def _field(number, value):
    """A protobuf field: varints, floats and bytes."""

    def varint(n):
        out = b""
        while n > 127:
            out, n = out + bytes([n & 127 | 128]), n >> 7
        return out + bytes([n])

    if isinstance(value, float):
        return varint(number << 3 | 5) + struct.pack("<f", value)
    if isinstance(value, int):
        return varint(number << 3) + varint(value)
    return varint(number << 3 | 2) + varint(len(value)) + value


@pytest.mark.parametrize("rule", ["identity", "nmt_nfkc"])
@pytest.mark.parametrize("fallback", [False, True])
@pytest.mark.parametrize("kind", [sentencepiece.UNIGRAM, sentencepiece.BPE])
def test_sentencepiece_parity(spark, tmp_path, kind, fallback, rule):
    """Models put together from the pieces of the model file, of both kinds, with and without bytes and a map of characters."""
    import sentencepiece as library

    with open(sentencepiece.MODEL, "rb") as f:
        own = sentencepiece.parse(f.read())
    charsmap = b""
    if rule != "identity":
        spec = next(v for k, v in sentencepiece._fields(library.SentencePieceNormalizer(rule_name=rule).serialized_model_proto()) if k == 3)
        charsmap = dict(sentencepiece._fields(spec))[2]
    kept = [(p, s, k) for p, s, k in own.pieces if fallback or k != sentencepiece.BYTE]
    scores = [-np.log(n + 20.0) - 0.3 * (n % 7) if k == sentencepiece.NORMAL and kind == sentencepiece.UNIGRAM else s for n, (_, s, k) in enumerate(kept)]
    data = b"".join(_field(1, _field(1, p.encode()) + _field(2, float(s)) + _field(3, k)) for (p, _, k), s in zip(kept, scores, strict=True))
    data += _field(2, _field(3, kind) + _field(35, int(fallback)) + _field(40, own.unknown)) + _field(3, _field(1, rule.encode()) + _field(2, charsmap) + _field(3, 1) + _field(4, int(rule != "identity")))
    path = tmp_path / "made.model"
    path.write_bytes(data)
    texts = ["The thing, and the other.", "<s> </s> <unk> <0x41> x<s>y", "日本語 😀 é ﬁ ½ Å", "", "  two  spaces ", "caf\u00e9 über naïve", "".join(random.Random(1).choices("etaoinshr", k=300)), "\u2581 mark \u2581\u2581x", "ünknown ☃☃ ☃ sign", "abc def " * 500]
    rows = sentencepiece.parity(docs(spark, texts), str(path)).collect()
    assert [texts[r["doc_id"]] for r in rows if not r["same"]] == []
    ids = sentencepiece.encode(docs(spark, texts), str(path))
    back = {r["doc_id"]: r["text"] for r in sentencepiece.decode(ids, str(path)).collect()}
    codec = library.SentencePieceProcessor(model_file=str(path))
    assert [back[k] for k in range(len(texts))] == [codec.decode(codec.encode(t)) for t in texts]
    assert all(r["round_trip"] == (back[r["doc_id"]] == texts[r["doc_id"]]) for r in ids.collect())


def test_sentencepiece(spark):
    texts = [None, "", " ", "  two  spaces \t tab\nline ", "日本語 😀 é", "<s> </s> <unk> <0x41>", "x" * 20000, "a b " * 9000, "The thing, and the other."]
    table = docs(spark, texts)
    assert all(r["same"] for r in sentencepiece.parity(table).collect())
    encoded = sentencepiece.encode(table)
    assert all(r["round_trip"] for r in encoded.collect())
    back = {r["doc_id"]: r["text"] for r in sentencepiece.decode(encoded).collect()}
    assert back == {k: t or "" for k, t in enumerate(texts)}


def test_components_of_paths_and_stars(spark):
    edges = [(k, k + 1) for k in range(40)] + [(100, k) for k in range(101, 130)] + [(7, 7)]
    got = {r["node"]: r["comp"] for r in near_dup.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert len({got[k] for k in range(41)}) == 1
    assert len({got[k] for k in range(100, 130)}) == 1
    assert got[0] != got[100]
    assert spark.range(1).select(F.lit(1)).count() == 1


def test_repeated_rows_by_count(spark, monkeypatch):
    monkeypatch.setattr("fableguard.llm.common.BLOCK", 4)
    table = spark.createDataFrame([("a", 0), ("b", 1), ("c", 4), ("d", 11)], "x string, n long")
    assert sorted(r["x"] for r in repeated(table, "n").collect()) == list("b" + "c" * 4 + "d" * 11)


@pytest.mark.parametrize("kind", ["long", "string"])
def test_mixing_of_repeated_and_missing_ids(spark, kind):
    """One id, and no id at all, on most rows: each source's words near its target, every row at one of two numbers of copies, unbiased and alike on reruns."""
    rng = random.Random(4)
    rows = [(rng.choice(["7", "7", None, str(k)]), "w " * rng.choice([3, 3, 3, 10, rng.randint(1, 30)]), rng.choice("abc")) for k in range(4000)]
    table = spark.createDataFrame(rows, "doc_id string, text string, source string").withColumn("doc_id", F.col("doc_id").cast(kind))
    got = mixing.mix(table, chunk=16).collect()
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix(table.repartition(7), chunk=16).collect()))
    want = sorted((str(i), t.count("w")) for i, t, _ in rows)
    assert sorted((str(r["doc_id"]), r["size"]) for r in got) == want
    for total in {r["source_size"] for r in got}:
        own = [r for r in got if r["source_size"] == total]
        share = own[0]["target"] / total
        assert sum(r["size"] for r in own) == total
        assert {r["copies"] for r in own} <= {int(share), int(share) + 1}
        assert abs(sum(r["taken"] for r in own) - own[0]["target"]) < 31
        small = [r["copies"] for r in own if r["size"] == 3]
        assert abs(sum(small) / len(small) - share) < 0.1


def test_shingle_counts_are_added_up_a_million_at_a_time():
    assert [near_dup.buckets_of(n) for n in (0, 1, 1 << 20, (1 << 20) + 1, 100 << 20)] == [1, 1, 1, 2, 100]
    keys = np.random.default_rng(1).integers(0, 50, 1000).astype(np.uint32)
    times = np.arange(1000).astype(np.uint16)
    once, summed = near_dup._counts(keys), near_dup._counts(keys, times)
    assert once[0].tolist() == summed[0].tolist() == sorted(set(keys.tolist()))
    assert once[1].tolist() == [int((keys == k).sum()) for k in once[0]]
    assert summed[1].tolist() == [int(times[keys == k].sum()) for k in once[0]]
