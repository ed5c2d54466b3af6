"""Token counts by unigram Viterbi, without making tokens.

The pieces and scores are those of a published vocabulary. An Aho-Corasick automaton enumerates the pieces that end at
each place of a word; dynamic programming carries the best score and the number of pieces up to there. Ties go to the
longest last piece, as in the tokenizers library, which goes through starts in order and replaces only what is worse.
A character without a piece of its own costs UNKNOWN below the least score and counts its UTF-8 bytes.

A space is written as a mark at the beginning of a word, and a text begins with one. As no piece has the mark after
another character, words are counted on their own and kept for reuse; characters in no piece cut words too.

Results: a null or empty text has no tokens; repeated rows are each counted; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F

MARK, UNKNOWN = "▁", 10.0
CACHE_WORDS, CACHE_LENGTH = 300_000, 64


class UnigramCounter:
    def __init__(self, pieces: list[tuple[str, float]]):
        self.pieces = ahocorasick.Automaton()
        for piece, score in pieces:
            if not self.pieces.exists(piece):
                self.pieces.add_word(piece, (len(piece), score))
        self.pieces.make_automaton()
        if any(MARK in p.lstrip(MARK) for p, _ in pieces):
            raise ValueError("a piece has the word mark after another character")
        self.unknown = min(s for _, s in pieces) - UNKNOWN
        alphabet = {c for p, _ in pieces for c in p}
        # The line feed is the character without a piece that cuts most words.
        self.cuts_lines = "\n" not in alphabet
        self.marked, self.bare = _Store(self, MARK), _Store(self, "")
        self.runs = regex.compile(f"{MARK}*[^{MARK}]+|{MARK}+").findall

    def word(self, word: str) -> int:
        """The number of tokens of a word."""
        n = len(word)
        best, count = [0.0] * (n + 1), [0] * (n + 1)
        at, end_best, end_count, single = 1, None, 0, False

        def close(upto: int) -> None:
            # Every end from `at` to `upto` is done: the unknown character comes last, after longer pieces.
            nonlocal at, end_best, end_count, single
            while at <= upto:
                if not single and (end_best is None or best[at - 1] + self.unknown > end_best):
                    end_best, end_count = best[at - 1] + self.unknown, count[at - 1] + len(word[at - 1].encode("utf-8", "surrogatepass"))
                best[at], count[at] = end_best, end_count
                at, end_best, end_count, single = at + 1, None, 0, False

        for end, (length, score) in self.pieces.iter(word):
            if end >= at:
                close(end)
            total = best[end + 1 - length] + score
            if end_best is None or total > end_best:
                end_best, end_count = total, count[end + 1 - length] + 1
            single |= length == 1
        close(n)
        return count[n]

    def text(self, text: str) -> int:
        if not text:
            return 0
        lines = text.split("\n") if self.cuts_lines else [text]
        total, marked = len(lines) - 1, self.marked
        for n, line in enumerate(lines):
            if MARK in line or "  " in line or line.endswith(" ") or not n and line.startswith(" "):
                line = line.replace(" ", MARK) if n else MARK + line.replace(" ", MARK)
                total += sum(map(self.bare.__getitem__, self.runs(line)))
                continue
            words = line.split(" ")
            if n:
                total += self.bare[words[0]]
                del words[0]
            elif not line:
                total += marked[""]
                continue
            total += sum(map(marked.__getitem__, words))
        return total


class _Store(dict):
    """Counts of words after a prefix, up to CACHE_WORDS of them."""

    def __init__(self, counter: UnigramCounter, prefix: str):
        super().__init__()
        self.counter, self.prefix = counter, prefix

    def __missing__(self, word: str) -> int:
        n = self.counter.word(self.prefix + word)
        if len(word) <= CACHE_LENGTH:
            if len(self) >= CACHE_WORDS:
                self.clear()
            self[word] = n
        return n


def vocabulary(path: str) -> list[tuple[str, float]]:
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return [(model.id_to_piece(i), model.get_score(i)) for i in range(model.get_piece_size())]


@lru_cache(maxsize=2)
def load(path: str) -> UnigramCounter:
    return UnigramCounter(vocabulary(path))


def count_tokens(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens) of every whole text."""
    rows = docs.select(F.col(id_col), F.col(text_col).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = load(path)
        for batch in batches:
            counts = [counter.text(t or "") for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64())], [id_col, "n_tokens"])

    return rows.mapInArrow(run, f"`{id_col}` {rows.schema[0].dataType.simpleString()}, n_tokens long")
