"""Token counts by dynamic programming over a trie of pre-tokens.

A pre-token is a word with the word mark in front. Its tokens are the segmentation into vocabulary
pieces with the best unigram score: a piece of rank r costs log(r + 2), so frequent pieces are cheap;
a character in no piece falls back to its UTF-8 bytes, one token each, dearer than any piece. Of equal
scores the segmentation with fewer tokens counts.

The forward score at a character depends only on what stands before it, so the distinct pre-tokens of a
piece of a batch form a trie, walked depth first in sorted order with the path from the root on a stack:
each node is scored once, from its ancestors, and the count at the last node of a pre-token is its number
of tokens. A node also knows which places above it begin something that may still become a piece, so only
those are looked up. Counts are kept from piece to piece (up to KNOWN words, then anew). There is no
shuffle, and memory per task is bounded by CHUNK characters of text or one text, and KNOWN words.
The vocabulary is read on the driver, a file of fixed size, and travels with the function.

Null and empty texts have no pre-tokens and no tokens. Every row gets a result, repeated rows each.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from math import log

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import words_of

PIECES = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
CHUNK, KNOWN = 2_000_000, 300_000


def vocabulary(path: str = PIECES) -> dict[str, float]:
    """Piece -> score, from a sentencepiece file; control, unknown and byte pieces are no text."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    text = [i for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
    ranked = sorted(text, key=lambda i: (-model.get_score(i), i))
    return {model.id_to_piece(i): -log(rank + 2) for rank, i in enumerate(ranked)}


class Trie:
    """Token counts of words by a depth-first walk over their trie."""

    def __init__(self, pieces: dict[str, float]):
        #: every beginning of a piece -> the piece's score, or null if it is only a beginning
        self.beginnings: dict[str, float | None] = {}
        for piece, score in pieces.items():
            for end in range(1, len(piece)):
                self.beginnings.setdefault(piece[:end], None)
            self.beginnings[piece] = score
        self.fallback = min(pieces.values(), default=0.0) - 10.0
        self.scored = 0

    def counts(self, words: Iterable[str]) -> dict[str, int]:
        out: dict[str, int] = {}
        beginning, fallback, absent = self.beginnings.get, self.fallback, self
        scores, tokens, alive = [0.0], [0], [()]  # of the path's nodes, the root first
        previous = ""
        for word in sorted(words):
            text = MARK + word
            shared, limit = 0, min(len(text), len(previous))
            while shared < limit and text[shared] == previous[shared]:
                shared += 1
            del scores[shared + 1 :], tokens[shared + 1 :], alive[shared + 1 :]
            self.scored += len(text) - shared
            for end in range(shared + 1, len(text) + 1):
                c = text[end - 1]
                size = 1 if c < "\x80" else len(c.encode("utf-8", "surrogatepass"))
                best, count, going = scores[-1] + size * fallback, tokens[-1] + size, []
                for start in (*alive[-1], end - 1):
                    worth = beginning(text[start:end], absent)
                    if worth is absent:
                        continue
                    going.append(start)
                    if worth is not None:
                        score = scores[start] + worth
                        if score > best or (score == best and tokens[start] + 1 < count):
                            best, count = score, tokens[start] + 1
                scores.append(best)
                tokens.append(count)
                alive.append(going)
            out[word] = tokens[-1]
            previous = text
        return out


def token_counts(docs: DataFrame, path: str = PIECES) -> DataFrame:
    """doc_id, n_pretokens, n_tokens for every row."""
    pieces = vocabulary(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie, known = Trie(pieces), {}

        def counted(texts: list[list[str]]) -> list[int]:
            nonlocal known
            fresh = set().union(*texts) - known.keys()
            if len(known) + len(fresh) > KNOWN:
                fresh, known = set().union(*texts), {}
            known |= trie.counts(fresh)
            return [sum(map(known.__getitem__, t)) for t in texts]

        for batch in batches:
            words, tokens, held, size = [], [], [], 0
            for text in batch.column(1).to_pylist():
                held.append(words_of(text))
                words.append(len(held[-1]))
                size += len(text or "")
                if size > CHUNK:
                    tokens += counted(held)
                    held, size = [], 0
            if held:
                tokens += counted(held)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(words, pa.int64()), pa.array(tokens, pa.int64())], ["doc_id", "n_pretokens", "n_tokens"])

    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_pretokens long, n_tokens long")
