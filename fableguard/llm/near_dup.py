"""N-gram Jaccard join by a token-group matrix.

Texts are sets of hashed word shingles (64 bits; equal hashes count as equal shingles). Texts with equal sets are one
set. The join goes in these steps, all of them exact:

1. Every set is indexed under its rarest shingles, so many that two sets which reach the threshold share one of them.
   Which shingles are frequent is counted over all texts.
2. Sets that share an index shingle are first compared with one leader per shingle. What these links connect forms
   similar sets; chunks of them are the groups.
3. A set (query) meets a group that it isn't connected with yet where they share an index shingle. The group's token
   union bounds the overlap with any of its members; only groups whose bound reaches the threshold are opened, and
   the query is compared with each member.

So a large group of near copies costs a few comparisons per copy, never one per pair, and no link is lost that
connects something new.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fableguard.llm.common import saved, table

LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
MASK = (1 << 64) - 1
#: Parity sketches have at least so many bits, and no fewer than the set has shingles; the bits in which two differ are
#: at most the shingles in which the sets do. The upper half of a sketch can be folded onto the lower.
SKETCH_BITS = 512
#: A bitmap of so many bits (4 MB) tells which texts a pass needs; where it fills up more sets are sent, never fewer.
FILTER_BITS = 1 << 25
#: Counts of shingles are held for so many at a time, by the task that counts and by that which adds up a bucket of them.
COUNTED = 1 << 20


class _Words:
    """Hashes of a text's words: sums of a random number per byte times a power of an odd base, shifted to the word's start."""

    BASE = np.uint64(0x9E3779B97F4A7C15)
    OF_BYTE = np.random.default_rng(11).integers(0, 1 << 63, 256, np.uint64)
    BLANK = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])

    def __init__(self) -> None:
        self.powers = self.inverse = np.ones(1, np.uint64)

    def _grow(self, size: int) -> None:
        size = max(size, 2 * len(self.powers))
        base, back = self.BASE, np.uint64(pow(int(self.BASE), -1, 1 << 64))
        self.powers, self.inverse = (np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(size, x)])) for x in (base, back))

    def __call__(self, text: bytes) -> np.ndarray:
        data = np.frombuffer(text.translate(LOWER), np.uint8)
        if len(data) >= len(self.powers):
            self._grow(len(data) + 1)
        word = np.zeros(len(data) + 2, np.int8)
        word[1:-1] = ~self.BLANK[data]
        edges = np.flatnonzero(np.diff(word))
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(self.OF_BYTE[data] * self.powers[: len(data)], out=sums[1:])
        start, end = edges[::2], edges[1::2]
        return _mix((sums[end] - sums[start]) * self.inverse[start])


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: bytes, words: _Words, n: int) -> np.ndarray:
    """The sorted distinct shingle hashes of a text; fewer than n words count as one shingle, no word as none."""
    h = words(text)
    width = min(n, len(h))
    if not width:
        return h
    total = np.full(len(h) - width + 1, width, np.uint64)
    for k in range(width):
        total = total * np.uint64(0x9E3779B97F4A7C15) + h[k : len(h) - width + 1 + k]
    s = np.sort(_mix(total))
    return s[np.concatenate([[True], s[1:] != s[:-1]])]


def set_id(s: np.ndarray) -> int:
    """A signed 64-bit name of a set."""
    return (xxhash.xxh3_64_intdigest(s.tobytes()) ^ (1 << 63)) - (1 << 63)


def _sets(batches: Iterator[pd.DataFrame], n: int) -> Iterator[tuple[int, np.ndarray]]:
    """(set id, shingles) of each set that a task meets, once; empty ones are left out."""
    words, seen = _Words(), set()
    for pdf in batches:
        for text in pdf["text"]:
            s = shingles(text, words, n)
            if len(s) and (i := set_id(s)) not in seen:
                seen.add(i)
                yield i, s


def needed(size: np.ndarray | int, percent: int) -> np.ndarray | int:
    """The overlap with a set of this size that any set has which reaches the threshold."""
    return (percent * size + 99) // 100


def describe(docs: DataFrame, n: int) -> DataFrame:
    """doc_id, sid, n (set size) and the set's parity sketch per row of (doc_id, text)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words = _Words()
        for pdf in batches:
            sids, sizes, sketches = [], [], []
            for text in pdf["text"]:
                s = shingles(text, words, n)
                width = max(SKETCH_BITS, 1 << max(0, len(s) - 1).bit_length())
                bits = np.bincount((s & np.uint64(width - 1)).astype(np.int64), minlength=width) & 1
                sids.append(set_id(s) if len(s) else None)
                sizes.append(len(s))
                sketches.append(np.packbits(bits.astype(np.uint8)).view(np.int64))
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "sid": pd.array(sids, "Int64"), "n": sizes, "sketch": sketches})

    kind = dict(docs.dtypes)["doc_id"]
    return docs.mapInPandas(run, f"doc_id {kind}, sid long, n long, sketch array<long>")


def buckets_of(total: int) -> int:
    """Over how many tasks the counts of so many shingles are added up."""
    return max(1, -(-total // COUNTED))


def _counts(keys: np.ndarray, times: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The sorted distinct keys, and how often each occurs, or the sum of its times."""
    if times is None:
        keys = np.sort(keys)
    else:
        order = np.argsort(keys)
        keys, times = keys[order], times[order]
    at = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[at], np.diff(at, append=len(keys)) if times is None else np.add.reduceat(times, at, dtype=np.int64)


def frequent(docs: DataFrame, n: int, total: int, least: int = 8, most: int = 1 << 20) -> tuple[np.ndarray, np.ndarray]:
    """(sorted upper 32 bits of shingle hashes, in how many sets) of the frequent shingles, counted over all texts.

    Frequent is what lies in ``least`` sets or more; if that holds for more than ``most`` shingles, the more frequent
    ones. Only the order in which shingles are indexed depends on it, never a result.
    """
    buckets = buckets_of(total)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, size = [], 0

        def flush() -> pd.DataFrame:
            keys, times = _counts(np.concatenate(held))
            at = np.searchsorted(keys, np.arange(buckets + 1, dtype=np.uint64) * np.uint64(1 << 32) // np.uint64(buckets))
            rows = [(b, np.diff(keys[i:j], prepend=keys[i]), np.minimum(times[i:j], 65535)) for b, (i, j) in enumerate(zip(at[:-1], at[1:], strict=True)) if j > i]
            narrow = [(b, int(keys[at[b]]), (d.astype(np.uint16) if d.max() < 65536 else d.astype(np.uint32)).tobytes(), len(d), (t.astype(np.uint8) if t.max() < 256 else t.astype(np.uint16)).tobytes()) for b, d, t in rows]
            return pd.DataFrame(narrow, columns=["bucket", "first", "gaps", "n", "times"])

        for _, s in _sets(batches, n):
            held.append((s >> np.uint64(32)).astype(np.uint32))
            size += len(s)
            if size >= COUNTED:
                yield flush()
                held, size = [], 0
        if held:
            yield flush()

    def add_up(pdf: pd.DataFrame) -> pd.DataFrame:
        keys, times = [], []
        for x in pdf.itertuples(index=False):
            keys.append(np.cumsum(np.frombuffer(x.gaps, np.uint16 if len(x.gaps) == 2 * x.n else np.uint32), dtype=np.uint32) + np.uint32(x.first))
            times.append(np.frombuffer(x.times, np.uint8 if len(x.times) == x.n else np.uint16))
        keys, sums = _counts(np.concatenate(keys), np.concatenate(times))
        often = sums >= least
        return pd.DataFrame({"key": keys[often].astype(np.int64), "df": sums[often]})

    counted = docs.select("text").mapInPandas(count, "bucket long, first long, gaps binary, n long, times binary")
    found = saved(counted.groupBy("bucket").applyInPandas(add_up, "key long, df long"), "frequent-shingles")
    cut, kept = least, 0
    by = found.groupBy(F.floor(F.log2(F.col("df").cast("double")) * 4).alias("step")).agg(F.count("*").alias("n"), F.min("df").alias("df"))
    for step in by.orderBy(F.desc("step")).collect():  # about four steps a doubling: a bounded number
        if kept + step["n"] > most:
            break
        cut, kept = step["df"], kept + step["n"]
    else:
        cut = least
    hot = found.where(F.col("df") >= cut).toPandas().sort_values("key") if kept else pd.DataFrame({"key": [], "df": []})
    return hot["key"].to_numpy(np.uint32), hot["df"].to_numpy(np.int64)


def postings(docs: DataFrame, n: int, percent: int, keys: np.ndarray, dfs: np.ndarray) -> DataFrame:
    """(token, sid, n, room, hot): every set under its rarest shingles; room is how many of its shingles come no earlier."""
    shared = docs.sparkSession.sparkContext.broadcast((keys, dfs))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        keys, dfs = shared.value
        held, size = [], 0
        for i, s in _sets(batches, n):
            df = np.zeros(len(s), np.int64)
            if len(keys):
                upper = (s >> np.uint64(32)).astype(np.uint32)
                at = np.minimum(np.searchsorted(keys, upper), len(keys) - 1)
                df = np.where(keys[at] == upper, dfs[at], 0)
            top = np.lexsort((s, df))[: len(s) - needed(len(s), percent) + 1]
            held.append((s[top].view(np.int64), np.full(len(top), i), np.full(len(top), len(s)), len(s) - np.arange(len(top)), df[top] > 0))
            size += len(top)
            if size >= 1 << 16:
                yield pd.DataFrame(dict(zip(("token", "sid", "n", "room", "hot"), map(np.concatenate, zip(*held, strict=True)), strict=True)))
                held, size = [], 0
        if held:
            yield pd.DataFrame(dict(zip(("token", "sid", "n", "room", "hot"), map(np.concatenate, zip(*held, strict=True)), strict=True)))

    return docs.select("text").mapInPandas(run, "token long, sid long, n long, room long, hot boolean")


def _bitmap(keys: DataFrame) -> np.ndarray:
    """Which of FILTER_BITS hash values occur in keys (key); what the driver gets is the bitmap, of fixed size."""
    chunk = 1 << 16

    def mark(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bits = np.zeros(FILTER_BITS, bool)
        for pdf in batches:
            bits[pdf["key"].to_numpy(np.int64) & (FILTER_BITS - 1)] = True
        for c in range(FILTER_BITS // chunk):
            part = bits[c * chunk : (c + 1) * chunk]
            if part.any():
                yield pd.DataFrame({"c": [c], "bits": [np.packbits(part).tobytes()]})

    def unite(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"c": pdf["c"][:1], "bits": [np.bitwise_or.reduce([np.frombuffer(b, np.uint8) for b in pdf["bits"]]).tobytes()]})

    parts = keys.select("key").mapInPandas(mark, "c long, bits binary").groupBy("c").applyInPandas(unite, "c long, bits binary")
    out = np.zeros((FILTER_BITS // chunk, chunk // 8), np.uint8)
    for x in parts.toLocalIterator():
        out[x["c"]] = np.frombuffer(x["bits"], np.uint8)
    return out.reshape(-1)


def sets_of(docs: DataFrame, sids: DataFrame, info: DataFrame, n: int) -> DataFrame:
    """(sid, tokens binary) of the sets asked for (sid), and perhaps a few more, from the text with the set's least id."""
    keys = sids.distinct().join(info, "sid").select(F.xxhash64("least_id").alias("key"))
    shared = docs.sparkSession.sparkContext.broadcast(_bitmap(keys))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bits, held, size = shared.value, [], 0

        def asked() -> Iterator[pd.DataFrame]:
            for pdf in batches:
                at = pdf["key"].to_numpy(np.int64) & (FILTER_BITS - 1)
                yield pdf[(bits[at >> 3] >> (7 - (at & 7)) & 1) > 0]

        for i, s in _sets(asked(), n):
            held.append((i, s.tobytes()))
            size += len(s)
            if size >= 1 << 20:
                yield pd.DataFrame(held, columns=["sid", "tokens"])
                held, size = [], 0
        if held:
            yield pd.DataFrame(held, columns=["sid", "tokens"])

    return saved(docs.select(F.xxhash64("doc_id").alias("key"), "text").mapInPandas(run, "sid long, tokens binary").dropDuplicates(["sid"]), "shingle-sets")


def verify(pairs: DataFrame, members: DataFrame, sets: DataFrame, percent: int, chunk: int = 64) -> DataFrame:
    """Links (a, b) between queries and members of the groups that they are paired with.

    pairs: (q, g); members: (g, sid), a bounded number per group. At most about ``chunk`` queries meet a group at once.
    """
    salts = pairs.groupBy("g").agg(F.ceil(F.count("*") / F.lit(chunk)).cast("long").alias("salts"))
    asked = pairs.join(salts, "g").withColumn("salt", F.pmod(F.xxhash64("q"), F.col("salts"))).join(sets.select(F.col("sid").alias("q"), F.col("tokens").alias("q_tokens")), "q").select(F.col("g").alias("q_g"), F.col("salt").alias("q_salt"), "q", "q_tokens")
    held = members.join(salts, "g").join(sets, "sid").withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1))).select("g", "salt", "sid", "tokens")

    def compare(queries: pd.DataFrame, group: pd.DataFrame) -> pd.DataFrame:
        own = [(int(i), np.frombuffer(t, np.uint64)) for i, t in zip(group["sid"], group["tokens"], strict=True)]
        out = []
        if own:
            union = own[0][1] if len(own) == 1 else np.unique(np.concatenate([s for _, s in own]))
            for q, tokens in zip(queries["q"], queries["q_tokens"], strict=True):
                s = np.frombuffer(tokens, np.uint64)
                if _common(s, union) < needed(len(s), percent):  # no member can reach the threshold
                    continue
                for i, other in own:
                    if percent * max(len(s), len(other)) <= 100 * min(len(s), len(other)):
                        both = _common(s, other)
                        if 100 * both >= percent * (len(s) + len(other) - both):
                            out.append((int(q), i))
        return pd.DataFrame(out, columns=["a", "b"]).astype("int64")

    return asked.groupBy("q_g", "q_salt").cogroup(held.groupBy("g", "salt")).applyInPandas(compare, "a long, b long")


def _common(a: np.ndarray, b: np.ndarray) -> int:
    at = np.minimum(np.searchsorted(b, a), len(b) - 1)
    return int((b[at] == a).sum())


def components(edges: DataFrame) -> DataFrame:
    """(node, comp) for the nodes of edges (a, b): comp is the same for what is connected.

    Each round lets every node take the smallest neighbour's name and contracts the graph, until no edge is left.
    """
    left = saved(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    labels = saved(left.select(F.explode(F.array("a", "b")).alias("node")).distinct().withColumn("comp", F.col("node")), "labels")
    while not left.isEmpty():
        both = left.unionByName(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        to = saved(both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("to")), "names")
        labels = saved(labels.join(to, labels["comp"] == to["a"], "left").select("node", F.coalesce("to", "comp").alias("comp")), "labels")
        x, y = to.select("a", F.col("to").alias("x")), to.select(F.col("a").alias("b"), F.col("to").alias("y"))
        left = saved(left.join(x, "a").join(y, "b").where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "edges")
    return labels


def _near(pairs: DataFrame, info: DataFrame, percent: int) -> DataFrame:
    """The pairs (q, s) of sets whose sketches don't rule the threshold out, with the number of bits that differ."""
    a = info.select(F.col("sid").alias("q"), F.col("n").alias("q_n"), F.col("sketch").alias("q_sketch"))
    b = info.select(F.col("sid").alias("s"), F.col("n").alias("s_n"), F.col("sketch").alias("s_sketch"))

    def folded(x: str, y: str) -> Column:
        half = F.size(y)
        return F.when(F.size(x) == half, F.col(x)).otherwise(F.zip_with(F.slice(x, 1, half), F.slice(x, half + 1, half), lambda u, v: u.bitwiseXOR(v)))

    # Sizes that fit differ by less than two times, sketches so by one folding at most.
    own, other = folded("q_sketch", "s_sketch"), folded("s_sketch", "q_sketch")
    own, other = F.when(F.size("q_sketch") > F.size("s_sketch"), own).otherwise(F.col("q_sketch")), F.when(F.size("s_sketch") > F.size("q_sketch"), other).otherwise(F.col("s_sketch"))
    differ = F.aggregate(F.zip_with(own, other, lambda u, v: F.bit_count(u.bitwiseXOR(v))), F.lit(0), lambda x, y: x + y)
    sizes = F.col("q_n") + F.col("s_n")
    # overlap <= (sizes - differ) / 2, and the threshold asks for (100 + percent) * overlap >= percent * sizes
    near = pairs.join(a, "q").join(b, "s").where(percent * F.greatest("q_n", "s_n") <= 100 * F.least("q_n", "s_n")).withColumn("differ", differ)
    return near.where((100 + percent) * (sizes - F.col("differ")) >= 2 * percent * sizes).select("q", "s", "differ")


def near_dup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 5, percent: int = 80, group: int = 64, leaders: int = 8) -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id (the smallest id reachable by links, itself included).

    Rows with null or empty text, or without words, have no shingles and are linked with nothing: their component is
    their own id. Repeated rows and equal texts share a component. A null id is never a component's smallest id
    unless no other is there. An empty table gives no rows.
    """
    if not 50 < percent <= 100:
        raise ValueError("percent must be above 50 and at most 100")
    docs = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"))
    all_rows = saved(describe(docs, n), "shingled")
    total = all_rows.agg(F.sum("n")).first()[0] or 0
    info = saved(all_rows.where("sid is not null").groupBy("sid").agg(F.min("doc_id").alias("least_id"), F.first("n").alias("n"), F.first("sketch").alias("sketch")), "sets")

    indexed = postings(docs, n, percent, *frequent(docs, n, total))
    # A rare shingle's list is short: one shuffle brings it together. A frequent one's may be long: it is dealt over
    # many tasks, and summed up afterwards.
    salt = F.when(F.col("hot"), F.xxhash64("sid"))
    same = Window.partitionBy("token", "salt")
    held = indexed.withColumn("salt", salt).withColumn("lead", F.min("sid").over(same)).withColumn("last", F.max("sid").over(same))
    held = saved(held.where("hot or lead < last").select("token", "sid", "n", "room", "hot", "lead").distinct(), "index")
    hot = held.where("hot").select("token", "sid", "n", "room")
    # Each frequent shingle picks two leaders at random, so that a set meets many of them and its likeliest are found.
    picks = [F.min_by("sid", F.xxhash64("token", "sid", F.lit(k))) for k in range(2)]
    leads = hot.groupBy("token").agg(F.array_distinct(F.array(*picks)).alias("leads"), F.min("sid").alias("x"), F.max("sid").alias("y"))
    leads = saved(leads.where("x < y").select("token", F.explode("leads").alias("lead")), "leaders")
    shared = held.where("not hot").select("token", "sid", "n", "room", "lead").unionByName(hot.join(leads, "token").select("token", "sid", "n", "room", "lead"))
    shared = saved(shared, "shared-index")

    stars = shared.where("sid <> lead").select(F.col("sid").alias("q"), F.col("lead").alias("s")).distinct()
    nearest = Window.partitionBy("q").orderBy("differ", "s")
    stars = _near(stars, info, percent).withColumn("at", F.row_number().over(nearest)).where(F.col("at") <= leaders).select("q", "s")
    stars = saved(stars, "leader-pairs")
    sets = sets_of(docs, stars.select(F.explode(F.array("q", "s")).alias("sid")), info, n)
    members = stars.select(F.col("s").alias("g"), F.col("s").alias("sid")).distinct()
    links = saved(verify(stars.select("q", F.col("s").alias("g")), members, sets, percent), "leader-links")
    comps = components(links)

    # Only shingles shared between what isn't connected yet can add anything.
    comp = F.coalesce("comp", "sid")
    known = shared.select("token", "sid", "n", "room").distinct().join(comps, F.col("sid") == F.col("node"), "left").select("token", "sid", "n", "room", comp.alias("comp"))
    mixed = saved(known.groupBy("token").agg(F.min("comp").alias("x"), F.max("comp").alias("y")).where("x < y").select("token"), "open-shingles")
    known = saved(known.join(mixed, "token").distinct(), "open-index")
    sizes = comps.groupBy("comp").agg(F.ceil(F.count("*") / F.lit(group)).alias("chunks"))
    chunks = saved(comps.join(sizes, "comp").select(F.col("node").alias("sid"), F.xxhash64("comp", F.pmod(F.xxhash64("node"), F.col("chunks"))).alias("g")), "groups")
    grouped = known.join(chunks, "sid", "left").select("token", "sid", "n", "room", "comp", F.coalesce("g", "sid").alias("g"), F.col("g").isNull().alias("single"))
    grouped = saved(grouped, "grouped-index")
    q = grouped.select("token", F.col("sid").alias("q"), F.col("n").alias("q_n"), F.col("room").alias("q_room"), F.col("comp").alias("q_comp"), F.col("single").alias("q_single"))
    g = grouped.groupBy("token", "g", "comp", "single").agg(F.min("n").alias("low"), F.max("n").alias("high"), F.max("room").alias("g_room"), F.min("sid").alias("s"))
    # Of two groups one asks, member by member: a single set asks a group, and else the smaller name the greater.
    asks = (F.col("q_single") & ~F.col("single")) | ((F.col("q_single") == F.col("single")) & (F.col("q_comp") < F.col("comp")))
    fits = (percent * F.col("low") <= 100 * F.col("q_n")) & (percent * F.col("q_n") <= 100 * F.col("high"))
    # Under the first shingle that two sets share, both have room for the overlap that the threshold asks for.
    fits &= (100 + percent) * F.least("q_room", "g_room") >= percent * (F.col("q_n") + F.col("low"))
    met = q.join(g, "token").where((F.col("q_comp") != F.col("comp")) & asks & fits).select("q", "g", "single", "s").groupBy("q", "g").agg(F.first("single").alias("single"), F.min("s").alias("s"))
    met = saved(met, "query-groups")
    alone = _near(met.where("single").select("q", "s"), info, percent).join(stars, ["q", "s"], "left_anti").select("q", F.col("s").alias("g"))
    met = saved(alone.unionByName(met.where("not single").select("q", "g")), "query-groups")
    of_groups = chunks.select("g", "sid").join(met.select("g").distinct(), "g")
    of_single = met.join(chunks, "g", "left_anti").select("g", F.col("g").alias("sid")).distinct()
    members = saved(of_groups.unionByName(of_single), "group-members")
    sets = sets_of(docs, met.select(F.col("q").alias("sid")).unionByName(members.select("sid")), info, n)
    comps = components(links.unionByName(verify(met, members, sets, percent)))

    whole = info.join(comps, info["sid"] == comps["node"], "left").select("sid", "least_id", comp.alias("comp"))
    least = whole.groupBy("comp").agg(F.min("least_id").alias("component_id"))
    named = saved(whole.join(least, "comp").select("sid", "component_id"), "components")
    return all_rows.select("doc_id", "sid", F.col("n").alias("n_shingles")).join(named, "sid", "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))


def op10_token_group_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup(table(spark, sf_dir, "documents"))


#: Word shingles as text, all pairs that share one, and the links' transitive closure.
SQL = r"""
WITH RECURSIVE words AS MATERIALIZED (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
sets AS MATERIALIZED (
  SELECT r, doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s FROM words),
tokens AS MATERIALIZED (SELECT r, len(s) AS n, hash(unnest(s)) AS t FROM sets),
pairs AS MATERIALIZED (
  SELECT a.r AS x, b.r AS y FROM tokens a JOIN tokens b ON a.t = b.t AND a.r < b.r
  GROUP BY a.r, b.r, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
edges AS MATERIALIZED (SELECT x, y FROM pairs UNION ALL SELECT y, x FROM pairs),
reach AS (SELECT r AS x, r AS y FROM sets UNION SELECT reach.x, edges.y FROM reach JOIN edges ON reach.y = edges.x)
SELECT a.doc_id, CAST(len(a.s) AS BIGINT) AS n_shingles, min(b.doc_id) AS component_id
FROM sets a JOIN reach ON reach.x = a.r JOIN sets b ON b.r = reach.y GROUP BY a.r, a.doc_id, len(a.s)
"""
