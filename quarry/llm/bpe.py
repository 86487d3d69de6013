"""Encoding a collection with a public byte-level BPE vocabulary.

Method: the merges are compiled into a lazily determinised finite-state
transducer over bytes. For every prefix of an input the last token of its
encoding is unique, and it follows from the last tokens of shorter prefixes: a
token may follow another one exactly if merging their bytes alone gives just
the two. A state holds what is still open: the part of the input after the
last token that no continuation can change, and the prefixes that a longer
token may still start from. A transition reads a byte and emits the tokens
that have become certain, so the lookahead is bounded by the longest token.
States and transitions are made when first met and kept.
"""

from __future__ import annotations

import base64
import codecs
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from quarry.session import spread

#: Where the files of public tokenizers are; a parameter of every operator here.
TOKENIZERS = "/opt/tokenizers"
#: Split pattern that belongs to the byte-level vocabularies (published with them).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_MAX_STATES = 300_000
_MAX_WORDS = 200_000


class Vocabulary:
    """Token bytes and ids of a vocabulary whose ids are its merge ranks."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.ranks = ranks
        self.bytes_of = {i: b for b, i in ranks.items()}
        #: proper prefixes of tokens
        self.open = {token[:k] for token in ranks for k in range(1, len(token))}
        self._follows: dict[tuple[int, int], bool] = {}
        self._whole: dict[int, bool] = {}

    @classmethod
    def load(cls, path: str) -> Vocabulary:
        with open(path, "rb") as lines:
            return cls({base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())})

    def merge(self, data: bytes) -> list[int]:
        """Plain merging, lowest rank first. Only used on the bytes of one or two tokens."""
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                rank = self.ranks.get(parts[i] + parts[i + 1])
                if rank is not None and (best is None or rank < best):
                    best, at = rank, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [self.ranks[p] for p in parts]

    def whole(self, token: int) -> bool:
        """Whether the token's bytes encode to the token itself."""
        got = self._whole.get(token)
        if got is None:
            got = self._whole[token] = self.merge(self.bytes_of[token]) == [token]
        return got

    def follows(self, left: int, token: int) -> bool:
        """Whether ``token`` may stand after ``left`` in an encoding."""
        got = self._follows.get((left, token))
        if got is None:
            if len(self._follows) > 4 * _MAX_STATES:
                self._follows.clear()
            got = self._follows[left, token] = self.merge(self.bytes_of[left] + self.bytes_of[token]) == [left, token]
        return got


class _State:
    """left: last certain token (-1: none); tail: bytes after it; nodes:
    offset in tail -> (last token, parent's offset); live: offsets from which
    a longer token may start. arcs: byte -> (state, tokens that became
    certain); ending: tokens that the end of the input makes certain."""

    __slots__ = ("arcs", "ending", "left", "live", "nodes", "tail")

    def __init__(self, left: int, tail: bytes, nodes: dict[int, tuple[int, int]], live: tuple[int, ...]) -> None:
        self.left, self.tail, self.nodes, self.live = left, tail, nodes, live
        self.arcs: dict[int, tuple[_State, tuple[int, ...]]] = {}
        self.ending: tuple[int, ...] = tuple(t for _, t in self.path(len(tail)))

    def path(self, offset: int) -> list[tuple[int, int]]:
        """(offset after the token, token) from the last certain token up to ``offset``."""
        out = []
        while offset:
            token, parent = self.nodes[offset]
            out.append((offset, token))
            offset = parent
        return out[::-1]


class Transducer:
    """The transducer of one vocabulary; grows while it reads."""

    def __init__(self, vocabulary: Vocabulary) -> None:
        self.v = vocabulary
        self._clear()

    def _clear(self) -> None:
        self.states: dict[tuple, _State] = {}
        self.start = self._state(-1, b"", {}, (0,))

    def _state(self, left: int, tail: bytes, nodes: dict[int, tuple[int, int]], live: tuple[int, ...]) -> _State:
        key = (left, tail, tuple(sorted(nodes.items())), live)
        got = self.states.get(key)
        if got is None:
            got = self.states[key] = _State(left, tail, nodes, live)
        return got

    def _step(self, s: _State, byte: int) -> tuple[_State, tuple[int, ...]]:
        tail = s.tail + bytes((byte,))
        n = len(tail)
        nodes = dict(s.nodes)
        for p in s.live:  # the longest first
            token = self.v.ranks.get(tail[p:])
            if token is None or not self.v.whole(token):
                continue
            left = nodes[p][0] if p else s.left
            if left < 0 or self.v.follows(left, token):
                nodes[n] = (token, p)
                break
        else:
            raise ValueError(f"byte {byte} is no token of the vocabulary")
        live = [p for p in s.live if tail[p:] in self.v.open]
        live.append(n)
        scratch = _State.__new__(_State)
        scratch.left, scratch.tail, scratch.nodes, scratch.live = s.left, tail, nodes, tuple(live)
        # what the ways to all live offsets share is certain
        ways = [scratch.path(p) for p in live]
        certain = []
        for steps in zip(*ways):
            if len(set(steps)) > 1:
                break
            certain.append(steps[0])
        cut = certain[-1][0] if certain else 0
        kept: dict[int, tuple[int, int]] = {}
        for way in ways:
            for offset, token in way[len(certain) :]:
                kept[offset - cut] = (token, nodes[offset][1] - cut)
        target = self._state(certain[-1][1] if certain else s.left, tail[cut:], kept, tuple(p - cut for p in live))
        arc = s.arcs[byte] = (target, tuple(t for _, t in certain))
        return arc

    def encode(self, data: bytes) -> list[int]:
        if len(self.states) > _MAX_STATES:
            self._clear()
        s, out = self.start, []
        for byte in data:
            arc = s.arcs.get(byte) or self._step(s, byte)
            s = arc[0]
            if arc[1]:
                out += arc[1]
        out += s.ending
        return out


class _Words(dict):
    """Word of the split pattern -> its ids as packed int32; bounded, refilled when full."""

    def __init__(self, transducer: Transducer) -> None:
        super().__init__()
        self.transducer = transducer

    def __missing__(self, word: str) -> bytes:
        got = np.array(self.transducer.encode(word.encode("utf-8", "surrogatepass")), np.int32).tobytes()
        if len(word) <= 64:
            if len(self) >= _MAX_WORDS:
                self.clear()
            self[word] = got
        return got


class Encoder:
    """Texts to ids of a byte-level vocabulary, without special tokens."""

    def __init__(self, path: str) -> None:
        self.vocabulary = Vocabulary.load(path)
        self.split = regex.compile(PATTERN).findall
        self.words = _Words(Transducer(self.vocabulary))

    def packed(self, text: str | None) -> bytes:
        """Ids as packed int32; none for an empty and for a null text."""
        return b"".join(map(self.words.__getitem__, self.split(text))) if text else b""

    def encode(self, text: str | None) -> list[int]:
        return np.frombuffer(self.packed(text), np.int32).tolist()

    def count(self, text: str | None) -> int:
        return len(self.packed(text)) // 4

    def decode(self, ids: Iterable[int]) -> Iterator[str]:
        """Text as soon as it is certain: an incremental UTF-8 machine keeps
        the bytes of an unfinished character until a later token ends it."""
        machine = codecs.getincrementaldecoder("utf-8")("replace")
        for i in ids:
            if piece := machine.decode(self.vocabulary.bytes_of[i]):
                yield piece
        if piece := machine.decode(b"", True):
            yield piece

    def decode_whole(self, ids: Iterable[int]) -> str:
        """What ``decode`` gives in all, when nobody waits for the pieces."""
        return b"".join(map(self.vocabulary.bytes_of.__getitem__, ids)).decode("utf-8", "replace")


@lru_cache(maxsize=4)
def encoder(name: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> Encoder:
    """One encoder for each vocabulary and process."""
    return Encoder(f"{folder}/{name}.tiktoken")


def token_ids(df: DataFrame, key: str = "doc_id", text: str = "text", name: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> DataFrame:
    """(key, ids array<int>): the ids of each text; an empty list for empty
    and null texts. Blank texts are encoded as they are. One narrow stage: no
    shuffle, each text is read once and as a whole."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packed = encoder(name, folder).packed
        for batch in batches:
            parts = [packed(t) for t in batch.column(1).to_pylist()]
            offsets = np.zeros(len(parts) + 1, np.int32)
            np.cumsum([len(p) // 4 for p in parts], out=offsets[1:])
            ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(parts), np.int32)))
            yield pa.RecordBatch.from_arrays([batch.column(0), ids], [key, "ids"])

    kind = df.schema[key].dataType.simpleString()
    return spread(df.select(key, text)).mapInArrow(run, f"{key} {kind}, ids array<int>")


def token_counts(df: DataFrame, keep: tuple[str, ...] = ("doc_id",), text: str = "text", name: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> DataFrame:
    """``keep`` and n_tokens bigint, as len(ids) of ``token_ids``; ids do not leave the worker."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = encoder(name, folder).count
        for batch in batches:
            n = pa.array([count(t) for t in batch.column(len(keep)).to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], n], [*keep, "n_tokens"])

    kinds = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep)
    return spread(df.select(*keep, text)).mapInArrow(run, f"{kinds}, n_tokens bigint")


def decoded(df: DataFrame, key: str = "doc_id", ids: str = "ids", name: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> DataFrame:
    """(key, text): the inverse of ``token_ids``; null ids give null, no ids an empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole = encoder(name, folder).decode_whole
        for batch in batches:
            texts = [None if x is None else whole(x) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], [key, "text"])

    kind = df.schema[key].dataType.simpleString()
    return df.select(key, ids).mapInArrow(run, f"{key} {kind}, text string")


def round_trip(df: DataFrame, name: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> DataFrame:
    """(doc_id, n_ids, same): whether each text survives encoding and streaming
    decoding. A null text comes back as an empty one and counts as the same."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(name, folder)
        for batch in batches:
            n, same = [], []
            for text in batch.column(1).to_pylist():
                ids = e.encode(text)
                n.append(len(ids))
                same.append("".join(e.decode(ids)) == (text or ""))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(same, pa.bool_())], ["doc_id", "n_ids", "same"])

    kind = df.schema["doc_id"].dataType.simpleString()
    return df.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_ids bigint, same boolean")
