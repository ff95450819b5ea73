"""Token counts by a linear longest-match automaton.

The trie of the vocabulary has failure links: where no longer match goes on, a link leads to the node of what is left
of the word after the greedy pieces that are settled by then, and each link knows how many these are.  One pass over a
word so gives the number of greedy longest-match-first pieces, and no piece is ever built.
"""

from __future__ import annotations

import re
from collections import deque
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import column
from .pieces import PIECE_MODEL, SPACE, Memo, Vocabulary, load

#: Runs of letters, digits and underscores, and single other characters that are not white space.
WORDS = re.compile(r"\w+|[^\w\s]")


class LongestMatch:
    """Counts of greedy pieces for words over ``initial`` pieces and the ``inner`` pieces that may follow."""

    def __init__(self, initial: Iterable[str], inner: Iterable[str]):
        self.next: list[dict[str, int]] = [{}, {}]  # of the root, and of the root of inner pieces
        final = [False, False]
        for root, texts in ((0, initial), (1, inner)):
            for text in texts:
                at = root
                for c in text:
                    at = self.next[at].get(c) or self._grow(at, c, final)
                final[at] = at > 1
        self.fail: list[int | None] = [None] * len(final)
        self.popped = [0] * len(final)
        queue = deque([0, 1])
        while queue:
            u = queue.popleft()
            for c, v in self.next[u].items():
                queue.append(v)
                if final[v]:
                    self.fail[v], self.popped[v] = 1, 1
                    continue
                z, n = self.fail[u], self.popped[u]
                while z is not None and c not in self.next[z]:
                    n += self.popped[z]
                    z = self.fail[z]
                if z is not None:
                    self.fail[v], self.popped[v] = self.next[z][c], n

    def _grow(self, at: int, c: str, final: list[bool]) -> int:
        self.next.append({})
        final.append(False)
        self.next[at][c] = len(final) - 1
        return len(final) - 1

    def count(self, word: str) -> int:
        """The number of pieces, or -1 for a word that pieces can't make up."""
        u, n = 0, 0
        for c in word:
            while (v := self.next[u].get(c)) is None:
                if self.fail[u] is None:
                    return -1
                n += self.popped[u]
                u = self.fail[u]
            u = v
        while u > 1:
            if self.fail[u] is None:
                return -1
            n += self.popped[u]
            u = self.fail[u]
        return n


def vocabulary_pieces(v: Vocabulary) -> tuple[list[str], list[str]]:
    """Pieces with a leading space begin words, those without go on; pieces with other spaces are left out."""
    own = [t for t, o in zip(v.texts, v.ordinary, strict=True) if o]
    return [t[1:] for t in own if t[0] == SPACE and len(t) > 1 and SPACE not in t[1:]], [t for t in own if SPACE not in t]


@lru_cache(maxsize=2)
def matcher(v: Vocabulary) -> LongestMatch:
    return LongestMatch(*vocabulary_pieces(v))


def token_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: str = PIECE_MODEL) -> DataFrame:
    """(doc_id, n_words, n_tokens, n_unknown) of each row's whole text.

    A word that the pieces can't make up counts as one, unknown, token.  Null and empty texts count nothing.
    Rows and ids stay as given; other columns are not read.
    """
    vocabulary = load(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = Memo(matcher(vocabulary).count)
        for batch in batches:
            words, tokens, unknown = [], [], []
            for x in batch.column(1):
                counts = list(map(memo.__getitem__, WORDS.findall(x.as_py() or "")))
                bad = counts.count(-1)
                words.append(len(counts))
                tokens.append(sum(counts) + 2 * bad)
                unknown.append(bad)
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, pa.int64()) for c in (words, tokens, unknown)]], ["doc_id", "n_words", "n_tokens", "n_unknown"])

    slim = docs.select(column(id_col).cast("bigint").alias("doc_id"), column(text_col).cast("string").alias("text"))
    return slim.mapInArrow(run, "doc_id bigint, n_words bigint, n_tokens bigint, n_unknown bigint")
