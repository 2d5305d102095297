"""Token counts: greedy longest-match word pieces counted by a linear automaton.

The vocabulary is a trie over bytes. A piece starts a word, or continues one if it is marked with the
prefix ``##``. Every node has a failure link to the node that is reached when the match is cut into pieces,
and the number of pieces popped on the way, both computed once per vocabulary, breadth first. Reading a
word moves along the trie or along failure links; the sum of popped counts is its number of pieces, no
piece is built and no byte is read twice.

Words are runs of anything but space and the bytes 9 to 13, A-Z lower-cased. With ``end_mark`` every word
is followed by that byte sequence, for vocabularies that mark the end of a word. A word that the
vocabulary cannot cover counts as one unknown token.

Defined results: null and empty texts have no words and no tokens; ids may be null or repeated, each row
is counted by itself; an empty table gives no rows; other columns are ignored. Texts are read whole.
"""

from __future__ import annotations

import json
from collections import deque
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from casemill.llm.words import text_chunks, word_lists

CONTINUES = b"##"
#: Not a byte of UTF-8, so it can only mean the end of a word.
END_MARK = b"\xff"
REMEMBERED_WORDS = 400_000


class PieceAutomaton:
    """Counts greedy longest-match pieces of words.

    ``pieces`` start a word and ``inner`` ones continue it. Without ``inner``, the pieces that begin with ``##``
    are the ones that continue it.
    """

    def __init__(self, pieces: Iterable[bytes], end_mark: bytes = b"", inner: Iterable[bytes] | None = None) -> None:
        self.end_mark = end_mark
        self.child: list[dict[int, int]] = [{}, {}]
        self.complete = [False, False]
        self.start, self.inner = 0, 1
        for piece in pieces:
            continues = inner is None and piece.startswith(CONTINUES) and len(piece) > len(CONTINUES)
            self._insert(self.inner if continues else self.start, piece[len(CONTINUES) :] if continues else piece)
        for piece in inner or ():
            self._insert(self.inner, piece)
        self._link()

    def _insert(self, node: int, piece: bytes) -> None:
        if not piece:
            return
        for byte in piece:
            after = self.child[node].get(byte)
            if after is None:
                after = self.child[node][byte] = len(self.child)
                self.child.append({})
                self.complete.append(False)
            node = after
        self.complete[node] = True

    def _link(self) -> None:
        """Failure link and popped count per node; a link of -1 means that nothing can be popped."""
        self.fail = [-1] * len(self.child)
        self.popped = [0] * len(self.child)
        waiting = deque([self.start, self.inner])
        while waiting:
            parent = waiting.popleft()
            for byte, node in self.child[parent].items():
                waiting.append(node)
                if self.complete[node]:
                    self.fail[node], self.popped[node] = self.inner, 1
                    continue
                at, popped = self.fail[parent], self.popped[parent]
                while at >= 0 and byte not in self.child[at]:
                    popped += self.popped[at]
                    at = self.fail[at]
                if at >= 0:
                    self.fail[node], self.popped[node] = self.child[at][byte], popped

    def count(self, word: bytes) -> int:
        """Pieces of a word; 0 if it cannot be covered."""
        node, total = self.start, 0
        child, fail, popped = self.child, self.fail, self.popped
        for byte in word + self.end_mark:
            while (after := child[node].get(byte)) is None:
                if fail[node] < 0:
                    return 0
                total += popped[node]
                node = fail[node]
            node = after
        while node != self.inner:
            if fail[node] < 0:
                return 0
            total += popped[node]
            node = fail[node]
        return total


def byte_level_pieces(path: str, word_end: str = "</w>") -> list[bytes]:
    """Pieces of a byte-level vocabulary file with word ends: any entry may start or continue a word,
    an entry with ``word_end`` only matches at its end."""
    with open(path, encoding="utf-8") as file:
        vocabulary = json.load(file)["model"]["vocab"]
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte_of = {chr(b): b for b in shown}
    byte_of |= {chr(256 + i): b for i, b in enumerate(sorted(set(range(256)) - set(shown)))}
    pieces = []
    for entry in vocabulary:
        body, mark = (entry[: -len(word_end)], END_MARK) if entry.endswith(word_end) else (entry, b"")
        if all(c in byte_of for c in body):
            pieces.append(bytes(byte_of[c] for c in body) + mark)
    return pieces


@lru_cache(maxsize=2)
def _automaton(path: str) -> PieceAutomaton:
    pieces = byte_level_pieces(path)
    return PieceAutomaton(pieces, END_MARK, inner=pieces)


def count_chunk(texts: pa.Array, automaton: PieceAutomaton, known: dict[str, int]) -> tuple[np.ndarray, ...]:
    """(words, tokens, unknown words) per text; every distinct word is read once."""
    words, ends = word_lists(pc.ascii_lower(texts))
    coded = words.dictionary_encode()
    if len(known) > REMEMBERED_WORDS:
        known.clear()
    pieces = np.zeros(len(coded.dictionary), np.int64)
    for i, word in enumerate(coded.dictionary.to_pylist()):
        found = known.get(word)
        if found is None:
            found = known[word] = automaton.count(word.encode())
        pieces[i] = found
    of_word = pieces[coded.indices.to_numpy()]
    upto = lambda values: np.diff(np.r_[0, np.cumsum(values)][ends], prepend=0)
    return np.diff(ends, prepend=0), upto(np.maximum(of_word, 1)), upto(of_word == 0)


def token_counts(docs: DataFrame, vocabulary: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_words, n_tokens, n_unknown) per row, with the byte-level vocabulary file ``vocabulary``."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, int] = {}
        for batch in batches:
            texts = pc.fill_null(batch["text"], "")
            for start, stop in text_chunks(texts):
                counts = count_chunk(texts.slice(start, stop - start), _automaton(vocabulary), known)
                yield pa.RecordBatch.from_arrays(
                    [batch["doc_id"].slice(start, stop - start), *(pa.array(c, pa.int64()) for c in counts)],
                    names=["doc_id", "n_words", "n_tokens", "n_unknown"],
                )

    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(count, f"doc_id {kind}, n_words long, n_tokens long, n_unknown long")
