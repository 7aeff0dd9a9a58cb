"""LM scoring by prediction by partial matching over a byte-context trie.

The trie holds how often each byte followed each context of up to ``order`` bytes in the training texts. A byte's
probability is taken from its longest known context; where the byte wasn't seen there, the model escapes (with the
number of distinct followers as the escape's weight) to the context one byte shorter, in which all bytes known to the
longer one are excluded, and in the end to equal shares. A text's score sums up the log10 probabilities of all its
bytes and of its end.

The trie is dealt over tasks by the nearest bytes of its contexts: what lies beyond them is one branch, of bounded size,
in which a task finds the longer contexts of all grams that end there; the levels below live in small Spark tables. Texts
are packed in chunks of bounded size; each chunk asks for the scores of its distinct grams and words, by their positions
in the chunk, and the answers, packed per task and chunk, meet the chunk's texts again. Nothing of the model goes through
the driver.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fableguard.llm.common import release, saved, table
from fableguard.llm.language_id import held_out

ORDER = 5
#: Contexts of so many bytes and more are looked up within branches of the trie, shorter ones in Spark tables. A branch
#: holds at most 257^(order - NEAR + 1) grams: 17 million for order 5.
NEAR = 3
#: Doesn't occur in UTF-8: stands before the text and ends it.
END = 0xFF
SYMBOLS = 257
#: About so many bytes of text have their grams held as 64-bit numbers at once.
CODED = 1 << 20
#: Grams meet their scores in at least so many buckets, and in as many as leave about HELD scores to each.
BUCKETS, HELD = 64, 1 << 21
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
BLANKS = b" \t\n\v\f\r"
INSIDE = bytes(c not in BLANKS for c in range(256))
#: The token that ends every text, set apart by blanks. END stands in no word.
STOP_WORD = b" " + bytes([END]) + b" "


def grams(texts: list[bytes], order: int) -> tuple[np.ndarray, np.ndarray]:
    """(packed context and byte of each position, where each text's positions start); the byte is lowest."""
    pad = bytes([END]) * order
    whole = bytes(7 - order) + pad + pad.join(t + bytes([END]) for t in texts) if texts else bytes(7)
    lengths = np.array([len(t) + 1 for t in texts], np.int64)
    # Each position's eight bytes up to its own, as one number, without those beyond the context.
    out = np.ndarray(len(whole) - 7, ">i8", whole, strides=(1,)).astype(np.int64)
    out &= (1 << 8 * (order + 1)) - 1
    starts = np.cumsum([0, *(lengths + order)])[:-1]
    keep = np.ones(len(out), bool)
    for k in range(order):
        at = starts[1:] - 1 - k
        keep[at] = False
    return out[keep], np.cumsum([0, *lengths])[:-1]


def _runs(texts: list[bytes], size: int = 1 << 21) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about ``size`` bytes."""
    at = 0
    while at < len(texts):
        to, held = at, 0
        while to < len(texts) and (to == at or held + len(texts[to]) <= size):
            held, to = held + len(texts[to]), to + 1
        yield at, to
        at = to


def _words(texts: list[bytes]) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The distinct tokens in order of appearance, each token's place in that order, and where each text's tokens start."""
    parts, starts, seen = [], [], 0
    for at, to in _runs(texts, CODED):
        whole = b"".join([b" ", *(t + STOP_WORD for t in texts[at:to])])
        inside = np.frombuffer(whole.translate(INSIDE), bool)
        begin, end = np.flatnonzero(inside[1:] != inside[:-1]).reshape(-1, 2).T
        offsets = np.cumsum(np.concatenate([[0], end - begin]))
        tokens = pa.Array.from_buffers(pa.large_binary(), len(begin), [None, pa.py_buffer(offsets), pa.py_buffer(whole.translate(LOWER, BLANKS))])
        parts.append(tokens.dictionary_encode())
        lengths = [len(t) + len(STOP_WORD) for t in texts[at:to]]
        starts.append(seen + np.searchsorted(begin, np.cumsum([0, *lengths])[:-1]))
        seen += len(begin)
    # Runs number their own words; the chunk numbers the runs' words.
    of_all = pa.concat_arrays([p.dictionary for p in parts]).dictionary_encode()
    ends = np.cumsum([0, *(len(p.dictionary) for p in parts)])
    number = of_all.indices.to_numpy()
    ids = [number[i:j][p.indices.to_numpy()] for p, i, j in zip(parts, ends[:-1], ends[1:], strict=True)]
    return of_all.dictionary, np.concatenate(ids), np.concatenate(starts)


def _in_training(words: pa.Array, ids: np.ndarray, starts: np.ndarray, training: list[bool]) -> np.ndarray:
    """How often each of a chunk's words is in its training texts."""
    lengths = np.diff([*starts, len(ids)])
    return np.bincount(ids[np.repeat(np.array(training, bool), lengths)], minlength=len(words))


def _codes(texts: list[bytes], order: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Per run of texts (its distinct grams, positions among these, starts of the texts)."""
    for at, to in _runs(texts, CODED):
        codes, starts = grams(texts[at:to], order)
        of, unique = pd.factorize(codes)
        del codes
        yield unique, of.astype(np.int32), starts


def _schema(kind: pa.DataType) -> pa.Schema:
    """A row of a chunk is a run of its texts, a word or a gram."""
    return pa.schema([("chunk", pa.int64()), ("pos", pa.int64()), ("ids", pa.list_(kind)), ("training", pa.list_(pa.bool_())), ("sizes", pa.list_(pa.int64())), ("blob", pa.binary()), ("word", pa.binary()), ("gram", pa.int64()), ("n", pa.int64())])


def _rows(schema: pa.Schema, chunk: int, pos: np.ndarray, **cols: object) -> pa.RecordBatch:
    cols |= {"chunk": np.full(len(pos), chunk), "pos": pos}
    column = lambda x, kind: x if isinstance(x, pa.Array) else pa.array(x, kind)
    return pa.RecordBatch.from_arrays([column(cols[f.name], f.type) if f.name in cols else pa.nulls(len(pos), f.type) for f in schema], schema=schema)


def _chunk(schema: pa.Schema, ids: list, texts: list[bytes], training: list[bool], order: int) -> Iterator[pa.RecordBatch]:
    """A chunk's texts, packed, and its distinct words and grams with how often its training texts hold them."""
    chunk, train, pack = uuid.uuid4().int >> 65, np.array(training, bool), zstandard.ZstdCompressor(level=6)
    for seq, (at, to) in enumerate(_runs(texts)):
        yield _rows(schema, chunk, np.array([seq]), ids=[ids[at:to]], training=[training[at:to]], sizes=[list(map(len, texts[at:to]))], blob=[pack.compress(b"".join(texts[at:to]))])
    words, ids_of, starts = _words(texts)
    yield _rows(schema, chunk, np.arange(len(words)), word=words.cast(pa.binary()), n=_in_training(words, ids_of, starts, training))
    del words, ids_of
    uniques, weights = [], []
    for (unique, at, _), (i, j) in zip(_codes(texts, order), _runs(texts, CODED), strict=True):
        weight = np.repeat(train[i:j], [len(t) + 1 for t in texts[i:j]])
        uniques.append(unique)
        weights.append(np.bincount(at[weight], minlength=len(unique)))
    joined = np.concatenate(uniques)
    del uniques, at, unique, weight
    whole, unique = pd.factorize(joined)
    del joined
    n = np.bincount(whole, np.concatenate(weights), len(unique)).astype(np.int64)
    yield _rows(schema, chunk, np.arange(len(unique)), gram=unique, n=n)


def packed(rows: DataFrame, order: int, chunk_bytes: int) -> DataFrame:
    """Rows (doc_id, text binary, training) in chunks; a chunk never spans two tasks, so nothing is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, texts, training, size, schema = [], [], [], 0, None
        for batch in (b.slice(at, 256) for b in batches for at in range(0, b.num_rows, 256)):  # few texts at once as Python objects
            schema = _schema(batch.column("doc_id").type)
            for i, text, train in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "training")), strict=True):
                ids.append(i)
                texts.append(text)
                training.append(train)
                size += len(text)
                if size >= chunk_bytes:
                    yield from _chunk(schema, ids, texts, training, order)
                    ids, texts, training, size = [], [], [], 0
        if ids:
            yield from _chunk(schema, ids, texts, training, order)

    kind = dict(rows.dtypes)["doc_id"]
    return rows.mapInArrow(run, f"chunk long, pos long, ids array<{kind}>, training array<boolean>, sizes array<long>, blob binary, word binary, gram long, n long")


def trie(counts: DataFrame, order: int) -> list[DataFrame]:
    """The levels 0 to ``order`` of the trie, (gram, n) each, from (gram, n)."""
    levels: list[DataFrame] = []
    below = counts.where("n > 0")
    for k in range(order, -1, -1):
        mask = (1 << 8 * (k + 1)) - 1
        below = saved(below.groupBy(F.col("gram").bitwiseAND(F.lit(mask)).alias("gram")).agg(F.sum("n").alias("n")), f"trie-{k}")
        levels.insert(0, below)
    return levels


def contexts(levels: list[DataFrame]) -> list[DataFrame]:
    """Per level (ctx, t, d, x_t).

    t and d: total and distinct followers of the context; x_t: what those followers count for in the next shorter context.
    """
    out = []
    for k, level in enumerate(levels):
        ctx = F.shiftright("gram", 8).alias("ctx")
        if k == 0:
            out.append(saved(level.groupBy(ctx).agg(F.sum("n").alias("t"), F.count("*").alias("d"), F.lit(0).cast("long").alias("x_t")), "contexts-0"))
            continue
        shorter = levels[k - 1].select(F.col("gram").alias("short"), F.col("n").alias("short_n"))
        both = level.join(shorter, level["gram"].bitwiseAND(F.lit((1 << 8 * k) - 1)) == shorter["short"])
        out.append(saved(both.groupBy(ctx).agg(F.sum("n").alias("t"), F.count("*").alias("d"), F.sum("short_n").alias("x_t")), f"contexts-{k}"))
    return out


def _branch(gram: np.ndarray, n: np.ndarray, order: int, near: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Whole branches of the trie: (log10 probability so far, whether it is still open) per gram, and the (gram, n) of level near."""
    symbol = gram & 255
    key = np.zeros(len(gram), np.int64)  # the context's bytes, nearest first
    for k in range(1, order + 1):
        key = (key << 8) | ((gram >> 8 * k) & 255)
    open_, lp = np.ones(len(gram), bool), np.zeros(len(gram))
    seen_t, seen_d = np.zeros(len(gram), np.int64), np.zeros(len(gram), np.int64)
    levels = []
    for k in range(order, near - 1, -1):
        u, first, of = np.unique((key >> 8 * (order - k)) << 8 | symbol, return_index=True, return_inverse=True)
        levels.append((u, first, of, np.bincount(of, n, len(u)).astype(np.int64)))
    for at, (u, first, of, c) in enumerate(levels):
        ctx = np.flatnonzero(np.diff(u >> 8, prepend=-1))
        at_ctx = np.cumsum(np.diff(u >> 8, prepend=-1) != 0) - 1
        t, d = np.add.reduceat(c, ctx), np.add.reduceat((c > 0).astype(np.int64), ctx)
        row = at_ctx[of]
        t_here, d_here = t[row] - seen_t, d[row] - seen_d
        found, weight = c[of] > 0, (t_here + d_here).astype(np.float64)
        choice = open_ & (weight > 0)  # nothing new in this context: no choice, and no cost
        share = np.where(found, c[of], d_here)[choice] / weight[choice]
        lp[choice] += np.log10(share)
        open_ &= ~found
        if at + 1 < len(levels):
            _, _, shorter, short_c = levels[at + 1]
            x_t = np.add.reduceat(np.where(c > 0, short_c[shorter[first]], 0), ctx)
            known = t[row] > 0
            seen_t, seen_d = np.where(known, x_t[row], seen_t), np.where(known, d[row], seen_d)
    _, first, _, c = levels[-1]
    return lp, open_, (gram[first] & ((1 << 8 * (near + 1)) - 1))[c > 0], c[c > 0]


def branches(counts: DataFrame, order: int, near: int, rows: int = 1 << 20) -> DataFrame:
    """From (gram, n), distinct: (gram, lp, open) for each, and (near, n) with the counts of level ``near``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def told(gram: np.ndarray, n: np.ndarray) -> Iterator[pd.DataFrame]:
            lp, open_, short, short_n = _branch(gram, n, order, near)
            yield pd.DataFrame({"gram": gram, "lp": lp, "open": open_, "near": None, "n": None}).astype({"near": "Int64", "n": "Int64"})
            yield pd.DataFrame({"gram": None, "lp": None, "open": None, "near": short, "n": short_n}, columns=["gram", "lp", "open", "near", "n"]).astype({"gram": "Int64", "lp": "Float64", "open": "boolean"})

        held, size = [], 0
        for pdf in batches:
            held.append((pdf["branch"].to_numpy(), pdf["gram"].to_numpy(), pdf["n"].to_numpy()))
            size += len(pdf)
            if size >= rows:  # up to where the last branch starts
                branch, gram, n = (np.concatenate(x) for x in zip(*held, strict=True))
                to = int(np.searchsorted(branch, branch[-1]))
                if to:
                    yield from told(gram[:to], n[:to])
                held, size = [(branch[to:], gram[to:], n[to:])], len(branch) - to
        if size:
            _, gram, n = (np.concatenate(x) for x in zip(*held, strict=True))
            yield from told(gram, n)

    branch = F.shiftright("gram", 8).bitwiseAND(F.lit((1 << 8 * near) - 1)).alias("branch")
    dealt = counts.select(branch, "gram", "n").repartition("branch").sortWithinPartitions("branch")
    return dealt.mapInPandas(run, "gram long, lp double, open boolean, near long, n long")


def gram_scores(counts: DataFrame, order: int) -> DataFrame:
    """(gram, lp): the log10 probability of each gram of counts (gram, n), which are distinct, n being how often it is in training."""
    near = min(NEAR, order)
    told = saved(branches(counts, order, near), "branches")
    levels = trie(told.where("near is not null").select(F.col("near").alias("gram"), "n"), near)
    ctxs = contexts(levels)
    # What is open at level near goes on alike for all grams that end alike.
    zero = F.lit(0).cast("long")
    ends = F.col("gram").bitwiseAND(F.lit((1 << 8 * (near + 1)) - 1))
    left = told.where("open").select(ends.alias("end")).distinct().withColumn("ctx", F.shiftright("end", 8)).join(ctxs[near], "ctx", "left")
    left = saved(left.select("end", F.lit(0.0).alias("lp"), F.coalesce("x_t", zero).alias("seen_t"), F.coalesce("d", zero).alias("seen_d")), "open-grams")
    done = []
    for k in range(near - 1, -1, -1):
        mask = (1 << 8 * (k + 1)) - 1
        level = levels[k].select(F.col("gram").alias("key"), F.col("n").alias("c"))
        at = left.withColumn("key", F.col("end").bitwiseAND(F.lit(mask))).withColumn("ctx", F.shiftright("key", 8))
        at = at.join(level, "key", "left").join(ctxs[k], "ctx", "left")
        t, d = F.coalesce(F.col("t"), zero) - F.col("seen_t"), F.coalesce(F.col("d"), zero) - F.col("seen_d")
        weight = (t + d).cast("double")
        lp = F.col("lp") + F.when(weight == 0, 0.0).when(F.col("c").isNotNull(), F.log10(F.col("c") / weight)).otherwise(F.log10(d / weight))
        at = saved(at.select("end", lp.alias("lp"), F.col("c").isNotNull().alias("found"), F.coalesce("x_t", "seen_t").alias("seen_t"), F.coalesce("d", "seen_d").alias("seen_d")), f"scores-{k}")
        done.append(at.where("found").select("end", "lp"))
        left = at.where("not found").select("end", "lp", "seen_t", "seen_d")
    tail = left.select("end", (F.col("lp") - F.log10(F.lit(float(SYMBOLS)) - F.col("seen_d"))).alias("lp"))
    for x in done:
        tail = tail.unionByName(x)
    tail = saved(tail.select("end", F.col("lp").alias("tail_lp")), "tails")
    rest = told.where("open").withColumn("end", ends).join(tail, "end").select("gram", (F.col("lp") + F.col("tail_lp")).alias("lp"))
    out = saved(told.where("not open").select("gram", "lp").unionByName(rest), "gram-scores")
    release(told)
    return out


def _pack(at: np.ndarray, told: np.ndarray) -> bytes:
    """Answers at ascending positions: their distances and the values, compressed."""
    return zstandard.ZstdCompressor(level=3).compress(np.diff(at, prepend=0).astype("<i4").tobytes() + told.astype("<f8").tobytes())


def _unpack(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(blob)
    n = len(raw) // 12
    return np.frombuffer(raw, "<i4", n).cumsum(dtype=np.int64), np.frombuffer(raw, "<f8", n, 4 * n)


def _groups(held: list[tuple], *keys: int) -> Iterator[tuple[np.ndarray, ...]]:
    """Runs that are equal in the columns ``keys`` of the held batches, sorted by these, then by the column after them."""
    cols = [np.concatenate(x) for x in zip(*held, strict=True)]
    order = np.argsort(cols[keys[-1] + 1])
    for k in reversed(keys):
        key = cols[k][order]
        if (key != key[0]).any():
            order = order[np.argsort(key, kind="stable")]
    cols = [c[order] for c in cols]
    ends = np.flatnonzero(np.any([np.diff(cols[k]) != 0 for k in keys], axis=0)) + 1
    for i, j in zip([0, *ends], [*ends, len(order)], strict=True):
        yield tuple(c[i:j] for c in cols)


def _bucket(gram: np.ndarray, buckets: int) -> np.ndarray:
    """Buckets in the smallest type that holds them: two bytes sort by counting."""
    return (((gram.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)).astype(np.int64) % buckets).astype(np.min_scalar_type(buckets))


def _by_bucket(rows: DataFrame, chunk: str | None, value: str, kind: str, buckets: int, held_rows: int = 1 << 20) -> DataFrame:
    """(bucket, chunk, grams binary) from rows (chunk, gram, value): about ``held_rows`` of a task are sorted and packed at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def told() -> pa.RecordBatch:
            keys, blobs = [], []
            for bucket, of, gram, values in _groups(held, 0, 1):
                keys.append((bucket[0], of[0]))
                blobs.append(zstandard.ZstdCompressor(level=3).compress(np.diff(gram, prepend=0).astype("<i8").tobytes() + values.astype(kind).tobytes()))
            bucket, of = zip(*keys, strict=True)
            chunks = pa.array(of, pa.int64()) if chunk else pa.nulls(len(of), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array(bucket, pa.int64()), chunks, pa.array(blobs, pa.binary())], ["bucket", "chunk", "grams"])

        held, size = [], 0
        for batch in batches:
            gram = batch.column("gram").to_numpy()
            held.append((_bucket(gram, buckets), batch.column(chunk).to_numpy() if chunk else np.zeros(len(gram), np.int64), gram, batch.column(value).to_numpy()))
            size += len(gram)
            if size >= held_rows:
                yield told()
                held, size = [], 0
        if size:
            yield told()

    return rows.mapInArrow(run, "bucket long, chunk long, grams binary")


def gram_answers(asked: DataFrame, scores: DataFrame, buckets: int) -> DataFrame:
    """(a_chunk, answers binary): the score of each gram of asked (chunk, pos, gram) from scores (gram, lp), which hold it.

    Both sides are dealt to buckets of grams by hash and travel packed. In a task a bucket's scores come first and are
    held; the chunks that ask stream by.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, parts, gram, lp = None, [], np.empty(0, np.int64), np.empty(0)
        for batch in batches:
            chunks, blobs = [], []
            for bucket, chunk, blob in zip(*(batch.column(c) for c in ("bucket", "chunk", "grams")), strict=True):
                raw = zstandard.ZstdDecompressor().decompress(blob.as_buffer())
                if bucket.as_py() != at:
                    at, parts = bucket.as_py(), []
                if not chunk.is_valid:
                    n = len(raw) // 16
                    parts.append((np.frombuffer(raw, "<i8", n).cumsum(), np.frombuffer(raw, "<f8", n, 8 * n)))
                    continue
                if parts:
                    gram, lp = map(np.concatenate, zip(*parts, strict=True))
                    order, parts = np.argsort(gram), []
                    gram, lp = gram[order], lp[order]
                n = len(raw) // 12
                told = lp[np.searchsorted(gram, np.frombuffer(raw, "<i8", n).cumsum())]
                pos = np.frombuffer(raw, "<i4", n, 8 * n)
                order = np.argsort(pos)
                chunks.append(chunk.as_py())
                blobs.append(_pack(pos[order].astype(np.int64), told[order]))
            yield pa.RecordBatch.from_arrays([pa.array(chunks, pa.int64()), pa.array(blobs, pa.binary())], ["a_chunk", "answers"])

    both = _by_bucket(asked, "chunk", "pos", "<i4", buckets).unionByName(_by_bucket(scores, None, "lp", "<f8", buckets))
    return both.repartition("bucket").sortWithinPartitions("bucket", F.asc_nulls_first("chunk")).mapInArrow(run, "a_chunk long, answers binary")


def packed_answers(answers: DataFrame, rows: int = 1 << 20) -> DataFrame:
    """(a_chunk, answers binary) from (chunk, at, told): about ``rows`` answers of a task are sorted and packed at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def told() -> pa.RecordBatch:
            chunks, blobs = zip(*((chunk[0], _pack(at, value)) for chunk, at, value in _groups(held, 0)), strict=True)
            return pa.RecordBatch.from_arrays([pa.array(chunks, pa.int64()), pa.array(blobs, pa.binary())], ["a_chunk", "answers"])

        held, size = [], 0
        for batch in batches:
            held.append(tuple(batch.column(c).to_numpy() for c in ("chunk", "at", "told")))
            size += batch.num_rows
            if size >= rows:
                yield told()
                held, size = [], 0
        if size:
            yield told()

    return answers.mapInArrow(run, "a_chunk long, answers binary")


def lm_score(docs: DataFrame, training: Column, id_col: str = "doc_id", text_col: str = "text", order: int = ORDER, chunk_bytes: int = 16 << 20) -> DataFrame:
    """One row per document: doc_id, n_tokens, n_known, train_tokens, base_score, score, n_bytes.

    The rows for which ``training`` holds teach the model, all rows are scored. A null text counts as empty and has
    the end as its only token. base_score is that of word counts with one added. Without any training row every byte
    has an equal share. Repeated rows count and are scored one by one; an empty table gives no rows.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"), F.coalesce(training, F.lit(False)).alias("training"))
    kind = dict(rows.dtypes)["doc_id"]
    whole = saved(packed(rows, order, chunk_bytes), "chunks")

    # A word has a row per chunk at most; one that all chunks hold is counted in parts and joined back as a stream.
    words = whole.where("word is not null").select("chunk", "pos", "word", "n")
    word_counts = saved(words.groupBy("word").agg(F.sum("n").alias("c")), "word-counts")
    total = word_counts.agg(F.sum("c").alias("n"), F.count(F.when(F.col("c") > 0, 1)).alias("v")).first()
    n, v = total["n"] or 0, total["v"]
    asked = whole.where("gram is not null").select("chunk", "pos", "gram", "n")
    counts = saved(asked.groupBy("gram").agg(F.sum("n").alias("n")), "gram-counts")
    buckets = max(BUCKETS, -(-counts.count() // HELD))
    scores = gram_scores(counts, order)
    release(counts)
    # A gram's score at its position, a word's count at -1 less its position if other chunks add to it.
    of_words = words.join(word_counts, "word").where("c <> n").select("chunk", (-1 - F.col("pos")).alias("at"), F.col("c").cast("double").alias("told"))
    answers = gram_answers(asked.select("chunk", "pos", "gram"), scores, buckets).unionByName(packed_answers(of_words))
    answers = saved(answers, "answers")
    release(scores, word_counts)

    def word_scores(texts: list[bytes], training: list[bool], pos: np.ndarray, told: np.ndarray) -> pd.DataFrame:
        words, ids_of, starts = _words(texts)
        c = _in_training(words, ids_of, starts, training).astype(np.float64)
        c[pos] = told
        base = np.log10((c + 1) / (n + v + 1))
        tokens, known = np.diff([*starts, len(ids_of)]), np.add.reduceat((c > 0)[ids_of].astype(np.int64), starts)
        return pd.DataFrame({"n_tokens": tokens, "n_known": known, "train_tokens": n, "base_score": np.add.reduceat(base[ids_of], starts)})

    def text_scores(texts: list[bytes], lps: np.ndarray) -> np.ndarray:
        runs = list(_codes(texts, order))
        ends = np.cumsum([0, *(len(unique) for unique, _, _ in runs)])
        whole = pd.factorize(np.concatenate([unique for unique, _, _ in runs]))[0]
        return np.concatenate([np.add.reduceat(lps[whole[i:j]][codes], starts) for (_, codes, starts), i, j in zip(runs, ends[:-1], ends[1:], strict=True)])

    def score(packs: pd.DataFrame, told: pd.DataFrame) -> pd.DataFrame:
        ids, texts, training, unpack = [], [], [], zstandard.ZstdDecompressor()
        for x in packs.sort_values("pos").itertuples(index=False):
            raw, ends = unpack.decompress(x.blob), np.cumsum([0, *x.sizes])
            ids += list(x.ids)
            training += list(x.training)
            texts += [raw[i:j] for i, j in zip(ends[:-1], ends[1:], strict=True)]
        at, value = map(np.concatenate, zip(*map(_unpack, told["answers"]), strict=True))
        is_word = at < 0
        out = word_scores(texts, training, -1 - at[is_word], value[is_word])
        lps = np.zeros((~is_word).sum())
        lps[at[~is_word]] = value[~is_word]
        del at, value, is_word
        return out.assign(doc_id=pd.Series(ids, dtype="Int64" if kind in ("bigint", "int") else None), score=text_scores(texts, lps), n_bytes=list(map(len, texts)))[["doc_id", *out.columns, "score", "n_bytes"]]

    texts = whole.where("blob is not null").select("chunk", "pos", "ids", "training", "sizes", "blob")
    return texts.groupBy("chunk").cogroup(answers.groupBy("a_chunk")).applyInPandas(score, f"doc_id {kind}, n_tokens long, n_known long, train_tokens long, base_score double, score double, n_bytes long")


def op9_partial_matching(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = lm_score(docs, ~held_out(F.col("doc_id"), 7, 2))
    return scored.select("doc_id", held_out(F.col("doc_id"), 7, 2).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score", "n_bytes")
