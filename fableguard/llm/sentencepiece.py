"""SentencePiece encoding and decoding on the tokenizers library.

The model's protobuf is read as it is, and its parts are rebuilt: the normaliser, the metaspace marker, byte fallback
and either unigram scores or BPE merges in order of score. Batches are encoded by several threads per task. Parity
with the sentencepiece library is verified on whole texts (``parity``), as is each row's round trip through the rebuilt
decoder. Where a unigram model has several segmentations of equal score (a letter repeated many times) the two
libraries may pick different ones.
"""

from __future__ import annotations

import os
import re
import struct
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fableguard.llm.common import table, uniform

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
UNIGRAM, BPE = 1, 2
NORMAL, UNKNOWN, CONTROL, DEFINED, UNUSED, BYTE = range(1, 7)


@dataclass
class Pieces:
    """What the model file says."""

    kind: int
    pieces: list[tuple[str, float, int]]
    unknown: int
    charsmap: bytes
    dummy_prefix: bool
    extra_whitespace: bool
    byte_fallback: bool


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(field number, value) of a protobuf message: varints as integers, all else as bytes."""

    def varint(at: int) -> tuple[int, int]:
        value = shift = 0
        while True:
            byte = data[at]
            value |= (byte & 127) << shift
            at, shift = at + 1, shift + 7
            if byte < 128:
                return value, at

    at = 0
    while at < len(data):
        key, at = varint(at)
        if key & 7 == 0:
            value, at = varint(at)
        else:
            size = {1: 8, 5: 4}.get(key & 7)
            if size is None:
                size, at = varint(at)
            value, at = data[at : at + size], at + size
        yield key >> 3, value


def parse(data: bytes) -> Pieces:
    """The parts of a ModelProto that matter here: pieces (1), trainer (2) and normaliser (3)."""
    pieces, trainer, normalizer = [], {}, {}
    for field, value in _fields(data):
        if field == 1:
            p = dict(_fields(value))
            pieces.append((p.get(1, b"").decode(), struct.unpack("<f", p[2])[0] if 2 in p else 0.0, p.get(3, NORMAL)))
        elif field == 2:
            trainer = dict(_fields(value))
        elif field == 3:
            normalizer = dict(_fields(value))
    return Pieces(trainer.get(3, UNIGRAM), pieces, trainer.get(40, 0), normalizer.get(2, b""), bool(normalizer.get(3, 1)), not normalizer.get(4, 1), bool(trainer.get(35, 0)))


def normalizer(model: Pieces):  # noqa: ANN201
    """The model's normaliser: its map of characters, blanks, the dummy prefix and the marker."""
    from tokenizers import Regex, normalizers

    steps = [normalizers.Precompiled(model.charsmap)] if model.charsmap else []
    if not model.extra_whitespace:
        steps += [normalizers.Strip(), normalizers.Replace(Regex(" {2,}"), " ")]
    if model.dummy_prefix:
        steps.append(normalizers.Prepend(MARK))
    return normalizers.Sequence([*steps, normalizers.Replace(" ", MARK)])


def build(model: Pieces):  # noqa: ANN201
    """A tokenizers.Tokenizer with the model's pieces, for text that is normalised already.

    In a unigram model only normal pieces can be found in a text; all others get names with a blank, which normalised
    text never holds, so that they match nothing. Bytes of what is unknown are filled in by ``Codec``.
    """
    from tokenizers import AddedToken, Tokenizer, models

    vocab = {p: k for k, (p, _, _) in enumerate(model.pieces)}
    unknown = next((p for p, _, kind in model.pieces if kind == UNKNOWN), None)
    usable = {p for p, _, kind in model.pieces if kind in (NORMAL, DEFINED)}
    if model.kind == UNIGRAM:
        least = min((s for _, s, kind in model.pieces if kind == NORMAL), default=0.0)
        core = models.Unigram([(p, s) if kind in (NORMAL, DEFINED) else (f" {p}", least) for p, s, kind in model.pieces], unk_id=model.unknown, byte_fallback=False)
    else:
        merges = []
        for p, score, _ in (x for x in model.pieces if x[0] in usable):
            halves = [(p[:k], p[k:]) for k in range(1, len(p)) if p[:k] in usable and p[k:] in usable]
            merges += [(-score, vocab[p], vocab[a], vocab[b], a, b) for a, b in halves]
        merges.sort()
        core = models.BPE(vocab, [x[-2:] for x in merges], unk_token=unknown, fuse_unk=True, byte_fallback=model.byte_fallback)
    tokenizer = Tokenizer(core)
    defined = [AddedToken(p, normalized=False, special=False) for p, _, kind in model.pieces if kind == DEFINED]
    if defined:
        tokenizer.add_tokens(defined)
    return tokenizer


def decoder(model: Pieces):  # noqa: ANN201
    from tokenizers import decoders

    return decoders.Sequence([decoders.Replace(MARK, " "), decoders.ByteFallback(), decoders.Fuse(), *([decoders.Strip(" ", 1, 0)] if model.dummy_prefix else [])])


#: A word behind its markers, or markers alone.
WORDS = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")
#: Up to twice so many words of up to WORD_CHARS characters are remembered with their ids, about 50 MB a worker at most.
KNOWN_WORDS, WORD_CHARS = 1 << 17, 32


class Codec:
    """Encodes and decodes batches; words (each behind its markers) that were met before are looked up."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.model = parse(f.read())
        self.tokenizer, self.normalizer, self.decoder = build(self.model), normalizer(self.model), decoder(self.model)
        pieces = [p for p, _, kind in self.model.pieces if kind in (NORMAL, DEFINED)]
        # No piece goes on after a word with another marker: then words, each behind its markers, can be split and looked up.
        self.splits = not any(a != MARK and b == MARK for p in pieces for a, b in zip(p, p[1:], strict=False))
        self.forget()
        self.byte_ids = {int(p[3:5], 16): k for k, (p, _, kind) in enumerate(self.model.pieces) if kind == BYTE} if self.model.byte_fallback and self.model.kind == UNIGRAM else {}
        names = {CONTROL: "", UNKNOWN: " \u2047 "}
        self.names = [names.get(kind, p) for p, _, kind in self.model.pieces]

    def normalize(self, text: str) -> str:
        if self.model.charsmap or not self.model.extra_whitespace:
            return self.normalizer.normalize_str(text)
        return (MARK if self.model.dummy_prefix else "") + text.replace(" ", MARK)

    def _ids(self, texts: list[str]) -> list[bytes]:
        """The ids of normalised texts, four bytes each."""
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        ids = [x.ids for x in found]
        if self.byte_ids:
            for n, x in enumerate(found):
                if self.model.unknown in ids[n]:
                    bytes_of = (map(self.byte_ids.__getitem__, piece.encode()) if k == self.model.unknown else (k,) for k, piece in zip(ids[n], x.tokens, strict=True))
                    ids[n] = list(chain.from_iterable(bytes_of))
        whole, ends = np.fromiter(chain.from_iterable(ids), np.int32).tobytes(), np.cumsum([0, *map(len, ids)]) * 4
        return [whole[i:j] for i, j in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]

    def forget(self) -> None:
        #: Words met lately and before that, with their ids; and those that the decoder doesn't give back.
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.lossy: set[str] = set()

    def _meet(self, words: set[str]) -> None:
        """Let young hold the ids of all words. What isn't met again is forgotten, when enough other words have been met."""
        if len(self.young) > KNOWN_WORDS:
            self.old, self.young = self.young, {}
        words = words.difference(self.young)
        known = {w for w in words if w in self.old}
        self.young.update(zip(known, map(self.old.__getitem__, known), strict=True))
        new = list(words - known)
        ids = self._ids(new)
        self.young.update(zip(new, ids, strict=True))
        if self._decode(b"".join(ids)) != self._plain("".join(new)):
            self.lossy.update(w for w, x in zip(new, ids, strict=True) if self._decode(x) != self._plain(w))

    def encode(self, texts: list[str]) -> tuple[list[np.ndarray], list[bool]]:
        """The ids of each text, and whether they decode to it. An empty text has no ids, a blank one those of its markers."""
        plain = [self.normalize(t) if t else "" for t in texts]
        if not self.splits:
            ids = [np.frombuffer(x, np.int32) for x in self._ids(plain)]
            return ids, [self.decode(x) == t for x, t in zip(ids, texts, strict=True)]
        words = [WORDS.findall(t) for t in plain]
        distinct = set(chain.from_iterable(words))
        self._meet(distinct)
        ids = [np.frombuffer(b"".join(map(self.young.__getitem__, w)), np.int32) for w in words]
        same = [self._plain(p) == t and (not self.lossy or self.lossy.isdisjoint(w)) for p, t, w in zip(plain, texts, words, strict=True)]
        for w in distinct:
            if len(w) > WORD_CHARS:
                del self.young[w]
                self.lossy.discard(w)
        return ids, same

    def _plain(self, normalized: str) -> str:
        """What normalised text looks like when it is decoded."""
        text = normalized.replace(MARK, " ")
        return text[1:] if self.model.dummy_prefix and text.startswith(" ") else text

    def _decode(self, ids: bytes) -> str:
        return self.decode(np.frombuffer(ids, np.int32))

    def decode(self, ids: np.ndarray) -> str:
        """The text that ids stand for: without control pieces and the dummy prefix, and with a sign for what is unknown."""
        return self.decoder.decode(list(map(self.names.__getitem__, ids.tolist()))) if len(ids) else ""


@lru_cache(1)
def load(path: str) -> Codec:
    return Codec(path)


def encode(docs: DataFrame, model: str = MODEL, id_col: str = "doc_id", text_col: str = "text", threads: int = 2, batch_chars: int = 1 << 18) -> DataFrame:
    """doc_id, ids (array<int>), n_tokens, n_bytes and round_trip per row.

    ``model`` is a path at which every executor has the model file; ``threads`` should be the task's cores. A null
    text counts as empty, an empty text has no tokens. round_trip tells whether decoding the ids gives the text back
    (where the normaliser changes a character, or the text holds a marker, it may not). Repeated rows are encoded one
    by one; an empty table gives no rows.
    """
    kind = dict(docs.dtypes)[id_col]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        os.environ["RAYON_NUM_THREADS"], os.environ["TOKENIZERS_PARALLELISM"] = str(threads), "true"
        codec = load(model)
        for pdf in batches:
            texts, at = pdf["text"].tolist(), 0
            while at < len(texts):  # as many texts at once as make up batch_chars, one at least
                to, size = at, 0
                while to < len(texts) and (to == at or size + len(texts[to]) <= batch_chars):
                    size, to = size + len(texts[to]), to + 1
                ids, same = codec.encode(texts[at:to])
                n_bytes = [len(t.encode("utf-8", "replace")) for t in texts[at:to]]
                yield pd.DataFrame({"doc_id": pdf["doc_id"].iloc[at:to], "ids": ids, "n_tokens": list(map(len, ids)), "n_bytes": n_bytes, "round_trip": same})
                at = to
        codec.forget()  # a worker outlives its task

    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return rows.mapInPandas(run, f"doc_id {kind}, ids array<int>, n_tokens long, n_bytes long, round_trip boolean")


def decode(encoded: DataFrame, model: str = MODEL, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """doc_id, text per row; null ids count as none."""
    kind = dict(encoded.dtypes)[id_col]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        codec = load(model)
        for pdf in batches:
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "text": [codec.decode(x) for x in pdf["ids"]]})

    rows = encoded.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(ids_col).cast("array<int>"), F.array().cast("array<int>")).alias("ids"))
    return rows.mapInPandas(run, f"doc_id {kind}, text string")


def parity(docs: DataFrame, model: str = MODEL, id_col: str = "doc_id", text_col: str = "text", part: float = 1.0) -> DataFrame:
    """doc_id, same: whether the sentencepiece library gives the same ids, for a share of rows chosen by hash of the id."""
    kind = dict(docs.dtypes)[id_col]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import sentencepiece

        own, other = load(model), sentencepiece.SentencePieceProcessor(model_file=model)
        for pdf in batches:
            texts = pdf["text"].tolist()
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "same": [x.tolist() == y for x, y in zip(own.encode(texts)[0], other.encode(texts, num_threads=1), strict=True)]})

    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).where(uniform(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) < part)
    return rows.mapInPandas(run, f"doc_id {kind}, same boolean")


def ids_sha256(ids: Column) -> Column:
    """SHA-256 of the ids, comma-joined."""
    return F.sha2(F.array_join(ids.cast("array<string>"), ","), 256)


def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(table(spark, sf_dir, "documents")).select("doc_id", "n_tokens", "n_bytes", ids_sha256(F.col("ids")).alias("ids_sha256"), "round_trip")
