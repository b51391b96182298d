"""Token ids and token counts.

`WordTokens` gives the ids of a tokenizer whose tokens never cross white space, encoding each distinct word once.

`count_pieces` counts the tokens of a unigram tokenizer without making them: Aho-Corasick lists the vocabulary's
matches in a word, and a dynamic programme from left to right carries the best score and its piece count. Ties and
unknown characters follow the tokenizer: of equal scores the earliest start stays, an unknown character costs the lowest
score less UNKNOWN_PENALTY and is open only where no one-character piece matches, and neighbouring unknowns are one token.

Defined cases: a null or empty text has 0 tokens; rows that repeat are counted one by one; further columns are kept.
"""

from __future__ import annotations

import math
import os
import re
from array import array
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from tidemark.llm.common import documents, kept, with_fields

#: Words that a task remembers in each of two generations: when the new one is full it becomes the old one, and what is met again
#: moves back. This changes no result.
MEMORY = 450_000
#: Fixed values of the unigram tokenizer.
UNKNOWN_PENALTY = 10.0
SPACE = "▁"

#: Words of one-byte letters, digits and signs without an apostrophe, and the parts that the splitter cuts them into.
_PLAIN = re.compile(r"[A-Za-z\u00C0-\u00D6\u00D8-\u00F6\u00F8-\u00FF!-&(-@\[-`{-~]+")
_LETTERS = re.compile(r"[a-z\u00DF-\u00F6\u00F8-\u00FF]+")
_PARTS = re.compile(r"[a-z\u00DF-\u00F6\u00F8-\u00FF]+|[0-9]|[!-&(-/:-@\[-`{-~]+")


def _byte_signs() -> dict[int, int]:
    """Byte-level tokenizers show a byte as its own character if that prints, and the others, in order, from 256 on."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = [b for b in range(256) if b not in shown]
    return {b: 256 + k for k, b in enumerate(hidden)}


_BYTE_SIGNS = _byte_signs()


class Memory(dict):
    """A dict that makes what it lacks, unless the generation before has it."""

    def __init__(self, make, older: dict | None = None):
        super().__init__()
        self.make, self.older = make, older or {}

    def __missing__(self, key):
        value = self.older.get(key)
        if value is None:
            value = self.make(key)
        self[key] = value
        return value

    def renewed(self) -> Memory:
        """This one, or when it is full the next generation."""
        if len(self) <= MEMORY:
            return self
        self.older = {}
        return Memory(self.make, self)


class WordTokens:
    #: Under this name a worker keeps tokenizers, and the words they know.
    KEPT = "words"

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenize = self.tokenizer.model.tokenize
        self.known = Memory(self._word)

    @classmethod
    def load(cls, path: str | None = None) -> WordTokens:
        if path is None:
            import public_tokenizers

            path = public_tokenizers.path("word_bpe_49k.json")
        loaded = kept(cls.KEPT)
        if path not in loaded:
            loaded[path] = cls(path)
        return loaded[path]

    def _word(self, word: str) -> bytes:
        """The ids of one word, as bytes. A plain word's parts go to the model itself, since for them the tokenizer's normaliser only
        lower-cases, and its splitter cuts runs of letters, single digits and runs of signs; any other word goes through the tokenizer. The most usual
        words, ASCII letters with a full stop or comma or none, are told without patterns."""
        if word.isascii():
            if word.isalpha():
                return self._model(word) if word.islower() else self.known[word.lower()]
            if word[-1:] in (".", ",") and word[:-1].isalpha():
                return self.known[word[:-1].lower()] + self.known[word[-1]]
        if not _PLAIN.fullmatch(word) or "<|" in word:
            return array("I", self.tokenizer.encode(word, add_special_tokens=False).ids).tobytes()
        low = word.lower()
        run = _LETTERS.match(low)
        rest = len(low) - (run.end() if run else 0)
        parts = [low] if not rest else [low[:-1], low[-1]] if run and rest == 1 else _PARTS.findall(low)
        if parts != [word]:
            return b"".join([self.known[part] for part in parts])
        shown = word if word.isascii() else word.encode().decode("latin-1").translate(_BYTE_SIGNS)
        return self._model(shown)

    def _model(self, shown: str) -> bytes:
        return array("I", [t.id for t in self.tokenize(shown)]).tobytes()

    def encode(self, texts: list[str | None], end: int | None = None) -> Iterator[np.ndarray]:
        """The ids of each text, then `end`. Words are split at blanks and line feeds alone, both white space to the tokenizer."""
        tail = b"" if end is None else array("I", [end]).tobytes()
        for text in texts:
            self.known = self.known.renewed()
            words = (text or "").replace("\n", " ").split(" ")
            yield np.frombuffer(b"".join(map(self.known.__getitem__, words)) + tail, np.uint32)


def read_vocabulary(path: str | None = None) -> list[tuple[str, float]]:
    """Pieces and scores of a sentencepiece file, by id; id 0 is the unknown piece."""
    import sentencepiece

    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("piece_bpe_32k.model")
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return [(model.id_to_piece(i), model.get_score(i)) for i in range(model.get_piece_size())]


class PieceCounter:
    def __init__(self, vocabulary: list[tuple[str, float]], unknown: int = 0):
        self.automaton = ahocorasick.Automaton()
        for piece, score in vocabulary:
            if piece:
                self.automaton.add_word(piece, (len(piece), score))
        self.unknown_piece = vocabulary[unknown][0]
        self.automaton.make_automaton()
        self.single = {p for p, _ in vocabulary if len(p) == 1}
        self.unknown_score = min(s for _, s in vocabulary) - UNKNOWN_PENALTY
        self.known = Memory(lambda word: self.count_word(SPACE + word))

    def count_word(self, word: str) -> int:
        """Matches come by end, the longest first: so of equal scores the earliest start stays."""
        n = len(word)
        score, pieces = [-math.inf] * (n + 1), [0] * (n + 1)
        score[0] = 0.0
        if self.single.issuperset(word) and self.unknown_piece not in word:
            for last, (length, own) in self.automaton.iter(word):
                at = last + 1 - length
                if (s := own + score[at]) > score[last + 1]:
                    score[last + 1], pieces[last + 1] = s, pieces[at] + 1
            return pieces[n]
        unknown = [False] * (n + 1)
        ends: list[list[tuple[int, float]]] = [[] for _ in range(n + 1)]
        for last, match in self.automaton.iter(word):
            ends[last + 1].append(match)
        for end in range(1, n + 1):
            options = [(end - length, own, word[end - length : end] == self.unknown_piece) for length, own in ends[end]]
            if word[end - 1] not in self.single:
                options.append((end - 1, self.unknown_score, True))
            for at, own, is_unknown in options:
                if (s := own + score[at]) > score[end]:
                    score[end], unknown[end] = s, is_unknown
                    pieces[end] = pieces[at] + (0 if is_unknown and unknown[at] else 1)
        return pieces[n]

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        text = text.replace(" ", SPACE)
        words = (text if text[0] == SPACE else SPACE + text)[1:].split(SPACE)
        self.known = self.known.renewed()
        return sum(map(self.known.__getitem__, words))


def count_pieces(docs: DataFrame, model_path: str | None = None) -> DataFrame:
    """All columns of docs and n_tokens, which replaces a column of that name. One pass, no shuffle."""
    docs = docs.drop("n_tokens")
    schema = with_fields(docs, n_tokens=T.LongType())

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = PieceCounter(read_vocabulary(model_path))
        for batch in batches:
            n = [counter.count(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(n, pa.int64())], [*batch.schema.names, "n_tokens"])

    return docs.mapInArrow(counted, schema)


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_pieces(documents(spark, sf_dir).select("doc_id", "text")).select("doc_id", "n_tokens")
