"""Token counts of a unigram tokenizer by count-only Viterbi.

A text's spaces become the word mark, one is put in front, and the text is cut before every mark. Inside a segment
an Aho-Corasick automaton lists all vocabulary pieces by where they end; dynamic programming keeps, for every place,
the best score and its piece count only, no back pointers. Ties are the tokenizers library's: of equal scores the
piece that starts first (the longest) wins, a candidate must be strictly better to replace another, and a character
that is no piece costs the lowest score less 10 and counts as its UTF-8 bytes (byte fallback).

Counts of segments are kept per task in a bounded memory, since words recur. Null and empty texts have no tokens.
Rows are counted one by one: repeated rows, null ids and other columns are no matter; no rows give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import inf, log

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MARK = "▁"
UNKNOWN_COST = 10.0
#: Segments remembered by a task, and the longest that are.
REMEMBERED, LONGEST = 400_000, 48


def vocabulary(path: str) -> list[tuple[str, float]]:
    """(piece, score) of a sentencepiece file, scored by Zipf's law over the file's order, which is by merge rank."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = [model.id_to_piece(i) for i in range(model.get_piece_size())
              if not model.is_control(i) and not model.is_unknown(i)]
    return [(piece, -log(rank + 1)) for rank, piece in enumerate(pieces)]


class Counter(dict):
    """Segment (without its mark) -> number of pieces."""

    def __init__(self, pieces: list[tuple[str, float]]) -> None:
        super().__init__()
        self.automaton = ahocorasick.Automaton()
        for piece, score in pieces:
            self.automaton.add_word(piece, (score, len(piece)))
        self.automaton.make_automaton()
        self.unknown = min(score for _, score in pieces) - UNKNOWN_COST

    def __missing__(self, segment: str) -> int:
        n = self.count(MARK + segment)
        if len(segment) <= LONGEST:
            if len(self) >= REMEMBERED:
                self.clear()
            self[segment] = n
        return n

    def count(self, segment: str) -> int:
        best, counts, unknown = [0.0], [0], self.unknown
        value, pieces, single = -inf, 0, False
        for end, (score, length) in self.automaton.iter(segment):
            while len(best) <= end:
                if not single and unknown + best[-1] > value:
                    value, pieces = unknown + best[-1], counts[-1] + len(segment[len(best) - 1].encode("utf-8", "surrogatepass"))
                best.append(value)
                counts.append(pieces)
                value, pieces, single = -inf, 0, False
            candidate = score + best[end + 1 - length]
            if candidate > value:
                value, pieces = candidate, counts[end + 1 - length] + 1
            if length == 1:
                single = True
        while len(best) <= len(segment):
            if not single and unknown + best[-1] > value:
                value, pieces = unknown + best[-1], counts[-1] + len(segment[len(best) - 1].encode("utf-8", "surrogatepass"))
            best.append(value)
            counts.append(pieces)
            value, pieces, single = -inf, 0, False
        return counts[-1]

    def tokens(self, text: str | None) -> tuple[int, int]:
        """Pieces and segments of a text."""
        if not text:
            return 0, 0
        text = text.replace(MARK, " ")
        segments = (text if text[0] == " " else " " + text).split(" ")[1:]
        return sum(map(self.__getitem__, segments)), len(segments)


def token_counts(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, n_tokens, n_segments, n_chars. model is the path of the vocabulary file."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(vocabulary(model))
        for batch in batches:
            made = np.array([counter.tokens(t.as_py()) for t in batch.column("t")], np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(made[:, 0]), pa.array(made[:, 1]), batch.column("n")],
                                             names=["id", "n_tokens", "n_segments", "n_chars"])

    text = docs[text_col].cast("string")
    rows = docs.select(docs[id_col].alias("id"), text.alias("t"), F.coalesce(F.char_length(text), F.lit(0)).cast("long").alias("n"))
    return rows.mapInArrow(run, f"id {kind}, n_tokens long, n_segments long, n_chars long").withColumnRenamed("id", id_col)
