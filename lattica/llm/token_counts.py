"""Token counts of a unigram tokenizer without its tokens.

A text is cut as the tokenizer cuts it: blanks become the word mark, a text that does not begin
with one gets one in front, and each mark begins a word. In a word, an Aho-Corasick automaton over
the vocabulary yields all matches by their end; a Viterbi pass carries, for each place, the best
score so far and the number of pieces on the path that has it. Ties go as in the tokenizer: of
candidates with equal score that which begins first stays. A character without a piece of its own
may be skipped at the least score minus ``UNKNOWN_PENALTY``; it counts as its UTF-8 bytes if the
vocabulary has byte pieces, and else a run of such characters counts as one.

The vocabulary comes from a file whose path is a parameter; the driver reads it and shares it with
the executors (its size is that of the vocabulary). Counts of words are remembered up to a bound.
A null or empty text has 0 tokens. Repeated rows count alike. Other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MODEL_FILE = "/opt/tokenizers/piece_bpe_32k.model"
WORD_MARK = "▁"
UNKNOWN_PENALTY = 10.0
CACHED_WORDS = 300_000
CACHED_LENGTH = 64


@dataclass
class Vocabulary:
    """Pieces with scores in order of their ids."""

    pieces: list[tuple[str, float]]
    bytes_as_pieces: bool


def load_vocabulary(path: str = MODEL_FILE) -> Vocabulary:
    """Pieces and scores of a sentencepiece model, taken as unigram log scores."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    ids = range(model.get_piece_size())
    pieces = [(model.id_to_piece(i), model.get_score(i)) for i in ids]
    names = {p for p, _ in pieces}
    return Vocabulary(pieces, all(f"<0x{b:02X}>" in names for b in range(256)))


class Counter(dict):
    """Number of pieces of a word; a dict so that a known word costs one lookup."""

    def __init__(self, vocabulary: Vocabulary):
        super().__init__()
        self.by_bytes = vocabulary.bytes_as_pieces
        self.unknown = min((s for _, s in vocabulary.pieces), default=0.0) - UNKNOWN_PENALTY
        self.automaton = ahocorasick.Automaton()
        for piece, score in reversed(vocabulary.pieces):
            if piece:
                self.automaton.add_word(piece, (len(piece), score))
        if len(self.automaton):
            self.automaton.make_automaton()

    def count(self, word: str) -> int:
        n = len(word)
        best, pieces, skipped = [0.0] * (n + 1), [0] * (n + 1), [False] * (n + 1)
        done = 0  # places up to here are final
        have = None  # best (score, pieces) for place done + 1; None: no match ends there
        single = False

        def close():
            nonlocal done, have, single
            if not single:
                score = best[done] + self.unknown
                if have is None or score > have[0]:
                    if self.by_bytes:
                        cost = len(word[done].encode("utf-8"))
                    else:
                        cost = 0 if skipped[done] else 1
                    have = (score, pieces[done] + cost)
                    skipped[done + 1] = True
            done += 1
            best[done], pieces[done] = have
            have, single = None, False

        matches = self.automaton.iter(word) if len(self.automaton) else ()
        for last, (length, score) in matches:
            while done < last:
                close()
            score += best[last + 1 - length]
            if have is None or score > have[0]:
                have = (score, pieces[last + 1 - length] + 1)
            if length == 1:
                single = True
        while done < n:
            close()
        return pieces[n]

    def __missing__(self, word: str) -> int:
        n = self.count(WORD_MARK + word)
        if len(word) <= CACHED_LENGTH:
            if len(self) >= CACHED_WORDS:
                self.clear()
            self[word] = n
        return n

    def count_text(self, text: str | None) -> int:
        if not text:
            return 0
        words = text.replace(WORD_MARK, " ").split(" ")
        if not words[0]:
            del words[0]
        return sum(map(self.__getitem__, words))


def count_tokens(docs: DataFrame, vocabulary: Vocabulary | None = None) -> DataFrame:
    """``(doc_id, n_tokens)`` for every row."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary or load_vocabulary())

    def run(batches):
        counter = Counter(shared.value)
        for batch in batches:
            counts = [counter.count_text(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64())], names=["doc_id", "n_tokens"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, n_tokens long")
