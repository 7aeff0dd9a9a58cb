"""Language ID by error-correcting output codes over byte trigrams.

Every language has a codeword of +1 and -1. One binary classifier per bit (log odds of hashed byte trigrams, learned
from counts over all labelled rows) predicts it from the text; decoding weighs each bit's logistic loss by how well
its classifier does on the language at hand and picks the nearest codeword. A text whose two nearest codewords are
about as near is flagged as ambiguous.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fableguard.llm.common import table, uniform

#: Trigrams are hashed to so many features; with the number of languages it bounds the model.
FEATURES = 1 << 17
#: So many bytes of text are turned into features at once, whatever the size of a batch or a text.
PIECE = 1 << 18
#: Bytes that tell nothing about the language (digits, ASCII signs, blanks) are read as one blank.
PLAIN = bytes(c if c >= 128 or chr(c).isalpha() else 32 for c in range(256))


def _pieces(texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Trigram features of runs of texts: (features, start of each text's features, index of each text).

    A run holds about PIECE bytes; a longer text comes in several runs that share two bytes.
    """
    run, index, held = [], [], 0
    for k, text in enumerate(texts):
        for at in range(0, max(1, len(text)), PIECE):
            piece = text[max(0, at - 2) : at + PIECE]
            run.append(b"  " + piece + b" ")  # two blanks, so that no trigram holds a byte of the next text
            index.append(k)
            held += len(piece) + 3
            if held >= PIECE:
                yield _features(run, index)
                run, index, held = [], [], 0
    if run:
        yield _features(run, index)


def _features(run: list[bytes], index: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    b = np.frombuffer(b"".join(run) + b"  ", np.uint8).astype(np.uint32)
    grams = (b[:-2] << np.uint32(16)) | (b[1:-1] << np.uint32(8)) | b[2:]
    hashed = (grams * np.uint32(2654435761)) >> np.uint32(32 - FEATURES.bit_length() + 1)
    starts = np.cumsum([0, *map(len, run)])[:-1]
    return hashed, starts, np.asarray(index)


def _plain(texts: pd.Series) -> list[bytes]:
    return [t.lower().encode("utf-8", "ignore").translate(PLAIN) for t in texts.fillna("")]


def _slices(texts: pd.Series, size: int = 4 * PIECE) -> Iterator[slice]:
    """Runs of texts of about ``size`` characters, so that copies of a batch never exist as a whole."""
    ends, at = np.cumsum(texts.str.len().fillna(0).to_numpy(np.int64)), 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + size, "right")))
        yield slice(at, to)
        at = to


def feature_counts(docs: DataFrame) -> DataFrame:
    """(lang, feature, n) over all rows of docs (lang, text); each task sums up before anything is shuffled."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[str, np.ndarray] = {}
        for pdf in batches:
            for lang, texts in pdf.groupby("lang")["text"]:
                counts = held.setdefault(lang, np.zeros(FEATURES, np.int64))
                for part in _slices(texts):
                    for features, _, _ in _pieces(_plain(texts.iloc[part])):
                        counts += np.bincount(features, minlength=FEATURES)
        for lang, counts in held.items():
            used = np.flatnonzero(counts)
            yield pd.DataFrame({"lang": lang, "feature": used, "n": counts[used]})

    return docs.select("lang", "text").mapInPandas(run, "lang string, feature long, n long").groupBy("lang", "feature").agg(F.sum("n").alias("n"))


def codewords(n: int, seed: int = 3) -> np.ndarray:
    """A row of +1 and -1 for each of n languages: all splits in two for up to six, else random ones far apart."""
    if n < 2:
        return np.ones((n, 1))
    if n <= 6:
        splits = np.arange(1, 2 ** (n - 1))
        return np.array([[1.0 if k == 0 or not (s >> (k - 1)) & 1 else -1.0 for s in splits] for k in range(n)])
    rng, bits, best, far = np.random.default_rng(seed), 10 * int(np.ceil(np.log2(n))), None, -1
    for _ in range(200):
        code = rng.choice([-1.0, 1.0], (n, bits))
        code[:, np.abs(code.sum(0)) == n] *= np.where(np.arange(n) % 2, 1.0, -1.0)[:, None]
        apart = bits - (code @ code.T + bits) / 2 + bits * np.eye(n)
        if apart.min() > far:
            best, far = code, apart.min()
    return best


@dataclass
class Model:
    langs: list[str]
    code: np.ndarray
    weights: np.ndarray
    trust: np.ndarray

    def margins(self, texts: list[bytes]) -> np.ndarray:
        """Each text's log odds for each bit, over the root of its length."""
        total, length = np.zeros((len(texts), self.code.shape[1])), np.ones(len(texts))
        for features, starts, index in _pieces(texts):
            np.add.at(total, index, np.add.reduceat(self.weights[features], starts, axis=0, dtype=np.float64))
            np.add.at(length, index, np.diff([*starts, len(features)]))
        return total / np.sqrt(length)[:, None]

    def decode(self, margins: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(nearest language's index, its share, the runner-up's share) of each row."""
        loss = np.logaddexp(0, -margins[:, None, :] * self.code[None])
        distance = (loss * self.trust[None]).sum(2)
        share = np.exp(distance.min(1, keepdims=True) - distance)
        share /= share.sum(1, keepdims=True)
        order = np.argsort(-share, axis=1, kind="stable")
        rows = np.arange(len(share))
        return order[:, 0], share[rows, order[:, 0]], share[rows, order[:, 1]] if share.shape[1] > 1 else np.zeros(len(share))


def fit(labelled: DataFrame, smoothing: float = 0.5, trust_rows: int = 8192) -> Model | None:
    """Learn from all rows of labelled (doc_id, text, lang). None without any label.

    What reaches the driver is at most FEATURES counts per language. How far each bit is to be trusted for each
    language is measured on a sample, by hash of the id, of about ``trust_rows`` rows.
    """
    counts = feature_counts(labelled).toPandas()
    langs = sorted(counts["lang"].unique())
    if not langs:
        return None
    code = codewords(len(langs))
    freq = np.zeros((len(langs), FEATURES))
    freq[counts["lang"].map({x: k for k, x in enumerate(langs)}), counts["feature"]] = counts["n"]
    freq = (freq + smoothing * (freq.sum(0) > 0)) / (freq.sum(1, keepdims=True) + smoothing)
    yes, no = (code.T > 0) @ freq + 1e-9, (code.T < 0) @ freq + 1e-9
    seen = freq.sum(0) > 0
    weights = np.where(seen, np.log(yes / yes.sum(1, keepdims=True)) - np.log(no / no.sum(1, keepdims=True)), 0.0).T.astype(np.float32)
    if len(langs) == 1:
        return Model(langs, code, np.zeros((FEATURES, 1), np.float32), np.ones((1, 1)))
    model = Model(langs, code, np.ascontiguousarray(weights), np.ones(code.shape) / code.shape[1])
    shared = labelled.sparkSession.sparkContext.broadcast(model)

    def hits(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = shared.value
        right, rows = np.zeros(m.code.shape), np.zeros(len(m.langs))
        for pdf in batches:
            langs = pdf["lang"].map({x: k for k, x in enumerate(m.langs)}).to_numpy(int)
            for part in _slices(pdf["text"]):
                of = langs[part]
                np.add.at(right, of, np.sign(m.margins(_plain(pdf["text"].iloc[part]))) == m.code[of])
                np.add.at(rows, of, 1)
        yield pd.DataFrame({"lang": np.arange(len(rows)), "rows": rows, "right": list(right)})

    part = min(1.0, trust_rows / max(1, labelled.count()))
    found = labelled.where(uniform(F.col("doc_id"), F.lit(5)) < part).select("lang", "text").mapInPandas(hits, "lang long, rows double, right array<double>")
    right, rows = np.zeros(code.shape), np.zeros(len(langs))
    for x in found.groupBy("lang").agg(F.sum("rows").alias("rows"), F.array(*(F.sum(F.col("right")[b]) for b in range(code.shape[1]))).alias("right")).collect():
        right[x["lang"]], rows[x["lang"]] = x["right"], x["rows"]
    trust = (right + 1) / (rows[:, None] + 2)
    model.trust = trust / trust.sum(1, keepdims=True) * min(8, code.shape[1])
    return model


def predict(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text", ambiguous_below: float = 0.6) -> DataFrame:
    """doc_id, lang_pred, score, ambiguous per row. ``und`` with score 0 where text is null or has no letter."""
    named = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.coalesce(F.col(text_col).rlike(r"\p{L}"), F.lit(False)).alias("letters"))
    if model is None:
        return named.select("doc_id", F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(False).alias("ambiguous"))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = shared.value
        names = np.array([*m.langs], dtype=object)
        for pdf in batches:
            for part in _slices(pdf["text"]):
                rows = pdf.iloc[part]
                best, score, _ = m.decode(m.margins(_plain(rows["text"])))
                letters = rows["letters"].to_numpy(bool)
                yield pd.DataFrame({"doc_id": rows["doc_id"], "lang_pred": np.where(letters, names[best], "und"), "score": np.where(letters, score, 0.0), "ambiguous": letters & (score < ambiguous_below)})

    kind = dict(named.dtypes)["doc_id"]
    return named.mapInPandas(run, f"doc_id {kind}, lang_pred string, score double, ambiguous boolean")


def held_out(doc_id: Column, mod: int, rest: int) -> Column:
    """Whether crc32 of the id as text (null: empty) leaves this remainder."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % mod == rest


def labelled(docs: DataFrame) -> DataFrame:
    """The rows that teach: text and lang are there, and the id isn't in the held-out fifth."""
    return docs.select("doc_id", "text", "lang").where(F.col("text").isNotNull() & F.col("lang").isNotNull() & ~held_out(F.col("doc_id"), 5, 0))


def identify(docs: DataFrame) -> DataFrame:
    """Fit on the labelled four fifths of documents and predict every row: doc_id, held_out, lang_pred, score, ambiguous.

    Rows with null or empty text or null lang teach nothing; repeated rows are predicted one by one; an empty table
    gives no rows.
    """
    out = predict(docs, fit(labelled(docs)))
    return out.select("doc_id", held_out(F.col("doc_id"), 5, 0).alias("held_out"), "lang_pred", "score", "ambiguous")


def op3_language_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(table(spark, sf_dir, "documents"))
