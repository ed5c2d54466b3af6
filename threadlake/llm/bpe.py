"""BPE encoding and decoding with a published vocabulary.

Each pre-token is merged over a contiguous array: part boundaries and the rank of each adjacent pair lie side by
side, the least rank is found by scanning, its boundary is deleted and the two neighbouring ranks are looked up
again. That is quadratic in the word's length, so a word of more than LONG parts goes through a heap over linked
parts instead, with the same merges.

Results: a null or empty text has no ids and an empty decoded text; repeated rows are each encoded; columns besides
the id and the text are not read.
"""

from __future__ import annotations

import heapq
import json
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F

from threadlake.llm.packed import parts

LONG = 96
#: Words kept per task; the store is emptied when it is full.
CACHE_WORDS = 200_000
CACHE_LENGTH = 64
_NO_RANK = 1 << 60
_DOCS_PER_BATCH = 512


def _byte_characters() -> list[str]:
    """The printable character that stands for each byte: itself if printable in Latin-1, else from U+0100 upwards."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(spare)) for b in range(256)]


class WordBpe:
    """A word-level BPE vocabulary with an end-of-word mark, read from its JSON file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.end = model["end_of_word_suffix"] or ""
        special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.token_of = {i: t for t, i in self.vocab.items()} | {i: t for t, i in special.items()}
        self.special = special
        self.special_pattern = regex.compile("(" + "|".join(regex.escape(t) for t in sorted(special, key=len, reverse=True)) + ")") if special else None
        split = next(x for x in spec["pre_tokenizer"]["pretokenizers"] if x["type"] == "Split")
        self.words = regex.compile(split["pattern"]["Regex"].replace(r"\s", r"\p{White_Space}")).findall
        self.rank: dict[tuple[int, int], int] = {}
        self.joined: dict[tuple[int, int], int] = {}
        for n, pair in enumerate(model["merges"]):
            left, right = pair if isinstance(pair, list) else pair.split(" ")
            key = self.vocab[left], self.vocab[right]
            if key not in self.rank:
                self.rank[key], self.joined[key] = n, self.vocab[left + right]
        shown = _byte_characters()
        self.inner = [self.vocab[c] for c in shown]
        self.final = [self.vocab[c + self.end] for c in shown]
        self.store = _Store(self)

    # -- merging ---------------------------------------------------------------------------------------------------

    def merge(self, word: str) -> list[int]:
        raw = word.encode("utf-8", "surrogatepass")
        parts = [self.inner[b] for b in raw[:-1]] + [self.final[raw[-1]]]
        return self._scan(parts) if len(parts) <= LONG else self._heap(parts)

    def _scan(self, parts: list[int]) -> list[int]:
        rank = self.rank.get
        ranks = [rank(pair, _NO_RANK) for pair in zip(parts, parts[1:])]
        while ranks:
            least = min(ranks)
            if least == _NO_RANK:
                break
            at = ranks.index(least)
            parts[at] = self.joined[parts[at], parts[at + 1]]
            del parts[at + 1], ranks[at]
            if at:
                ranks[at - 1] = rank((parts[at - 1], parts[at]), _NO_RANK)
            if at < len(ranks):
                ranks[at] = rank((parts[at], parts[at + 1]), _NO_RANK)
        return parts

    def _heap(self, parts: list[int]) -> list[int]:
        n = len(parts)
        after, before, alive = [*range(1, n), -1], [-1, *range(n - 1)], [True] * n
        rank = self.rank.get
        queue = [(r, i, parts[i], parts[i + 1]) for i in range(n - 1) if (r := rank((parts[i], parts[i + 1]))) is not None]
        heapq.heapify(queue)
        while queue:
            _, i, left, right = heapq.heappop(queue)
            j = after[i]
            if not alive[i] or j < 0 or parts[i] != left or parts[j] != right:
                continue
            parts[i], alive[j], after[i] = self.joined[left, right], False, after[j]
            if after[j] >= 0:
                before[after[j]] = i
            for a in (before[i], i):
                if a >= 0 and after[a] >= 0 and (r := rank((parts[a], parts[after[a]]))) is not None:
                    heapq.heappush(queue, (r, a, parts[a], parts[after[a]]))
        return [p for p, a in zip(parts, alive) if a]

    # -- texts -----------------------------------------------------------------------------------------------------

    def normalise(self, text: str) -> str:
        if not text.isascii():
            text = unicodedata.normalize("NFC", text)
        # One letter at a time: the form of a sigma does not depend on its place.
        return text.lower() if "Σ" not in text else "".join(c.lower() for c in text)

    def encode(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit integers."""
        found = self.store.__getitem__
        if self.special_pattern is None or not any(t in text for t in self.special):
            return b"".join(map(found, self.words(self.normalise(text))))
        out = []
        for n, part in enumerate(self.special_pattern.split(text)):
            out += [self.special[part].to_bytes(4, "little")] if n % 2 else map(found, self.words(self.normalise(part)))
        return b"".join(out)

    @property
    def tokens(self) -> list[str]:
        return [self.token_of.get(i, "") for i in range(max(self.token_of) + 1)]


class _Store(dict):
    """Encoded words, up to CACHE_WORDS of them."""

    def __init__(self, bpe: WordBpe):
        super().__init__()
        self.bpe = bpe

    def __missing__(self, word: str) -> bytes:
        ids = np.array(self.bpe.merge(word), "<u4").tobytes()
        if len(word) <= CACHE_LENGTH:
            if len(self) >= CACHE_WORDS:
                self.clear()
            self[word] = ids
        return ids


@lru_cache(maxsize=2)
def load(path: str) -> WordBpe:
    return WordBpe(path)


def _encoded(bpe: WordBpe, texts: pa.Array) -> pa.Array:
    return pa.array([bpe.encode(t or "") for t in texts.to_pylist()], pa.binary())


def _decoded(tokens: np.ndarray, ids: pa.Array) -> pa.Array:
    return pa.array([" ".join(tokens[np.frombuffer(b or b"", "<u4")]) for b in ids.to_pylist()], pa.string())


def _passed(batches: Iterator[pa.RecordBatch], vocabulary: str, encoding: bool, decoding: bool) -> Iterator[pa.RecordBatch]:
    """The columns of each batch (id, text or ids) without the text, with those made. A task leaves no words behind: its
    worker goes on to other steps, which would carry them along."""
    bpe = load(vocabulary)
    tokens = np.array(bpe.tokens, object) if decoding else None
    try:
        for batch in batches:
            for at in range(0, batch.num_rows, _DOCS_PER_BATCH):
                for part in parts(batch.slice(at, _DOCS_PER_BATCH), 1):
                    ids = _encoded(bpe, part.column(1)) if encoding else part.column(1)
                    made = [_decoded(tokens, ids)] if decoding else []
                    yield pa.RecordBatch.from_arrays([part.column(0), ids, *made], [part.schema.names[0], "token_ids", "decoded"][: 2 + len(made)])
    finally:
        bpe.store.clear()


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col), F.col(text_col).cast("string").alias("text"))


def _schema(rows: DataFrame, made: str) -> str:
    return f"`{rows.columns[0]}` {rows.schema[0].dataType.simpleString()}, {made}"


def encode(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, token_ids): the ids of each whole text, packed as little-endian unsigned 32-bit integers."""
    rows = _rows(docs, id_col, text_col)
    return rows.mapInArrow(lambda batches: _passed(batches, vocabulary, True, False), _schema(rows, "token_ids binary"))


def decode(encoded: DataFrame, vocabulary: str, id_col: str = "doc_id") -> DataFrame:
    """(id, token_ids, decoded): the tokens of each row's ids, special ones too, joined by spaces; this vocabulary's
    file names no decoder, and then its library joins tokens in that way."""
    rows = encoded.select(id_col, "token_ids")
    return rows.mapInArrow(lambda batches: _passed(batches, vocabulary, False, True), _schema(rows, "token_ids binary, decoded string"))


def encode_and_decode(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, token_ids, decoded): as `decode` gives of what `encode` gives, by one Python worker a task. Two in turn would
    take a second worker for each core, which Spark keeps and hands out in the steps after, too."""
    rows = _rows(docs, id_col, text_col)
    return rows.mapInArrow(lambda batches: _passed(batches, vocabulary, True, True), _schema(rows, "token_ids binary, decoded string"))
