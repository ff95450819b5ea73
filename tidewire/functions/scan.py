"""Many phrases found in texts in one pass: an Aho-Corasick automaton over words, carried to the tasks as arrays.

Words that no phrase has are ruled out for a whole Arrow batch at once; only runs of the others go through the automaton.
"""

from __future__ import annotations

import re
from collections import deque
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F


#: Words that are searched at once; a longer list stands alone.
WORDS = 1 << 17


class Phrases:
    """An automaton over word numbers that tells every phrase, a tuple of words, which ends at a word."""

    def __init__(self, phrases: Iterable[tuple[str, ...]]):
        self.phrases = sorted({tuple(p) for p in phrases if p})
        self.words = sorted({w for p in self.phrases for w in p})
        number = {w: i for i, w in enumerate(self.words)}
        self.step: list[dict[int, int]] = [{}]
        ends = [-1]
        for k, phrase in enumerate(self.phrases):
            state = 0
            for w in phrase:
                nxt = self.step[state].get(number[w])
                if nxt is None:
                    nxt = self.step[state][number[w]] = len(self.step)
                    self.step.append({})
                    ends.append(-1)
                state = nxt
            ends[state] = k
        # the longest proper suffix that is a state too, and the phrases that end in a state, longest first
        self.fail = [0] * len(self.step)
        self.found: list[tuple[int, ...]] = [() if e < 0 else (e,) for e in ends]
        queue = deque(self.step[0].values())
        while queue:
            state = queue.popleft()
            for w, nxt in self.step[state].items():
                back = self.fail[state]
                while back and w not in self.step[back]:
                    back = self.fail[back]
                self.fail[nxt] = self.step[back].get(w, 0)
                self.found[nxt] += self.found[self.fail[nxt]]
                queue.append(nxt)

    def matches(self, numbers: np.ndarray, breaks: np.ndarray) -> Iterator[tuple[int, int]]:
        """(place of the last word, phrase) over word numbers, -1 for a word of no phrase; none goes over a place in ``breaks``."""
        state, before = 0, -2
        step, fail, found = self.step, self.fail, self.found
        starts = set(breaks.tolist())
        for at in np.flatnonzero(numbers >= 0).tolist():
            if at != before + 1 or at in starts:
                state = 0
            w = int(numbers[at])
            while state and w not in step[state]:
                state = fail[state]
            state = step[state].get(w, 0)
            for k in found[state]:
                yield at, k
            before = at

    def in_lists(self, lists: pa.Array) -> pa.Array:
        """For each list of words the phrases in it: their place, number of words, and words joined by spaces."""
        lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
        # some lists at a time, as each hit is an object on the way
        ends = np.cumsum(lists.value_lengths().fill_null(0).to_numpy())
        parts, at = [], 0
        while at < len(lists):
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + WORDS, "right")))
            parts.append(self._in_some(lists.slice(at, to - at)))
            at = to
        return pa.concat_arrays(parts) if parts else self._in_some(lists)

    def _in_some(self, lists: pa.Array) -> pa.Array:
        flat, sizes = lists.flatten(), lists.value_lengths().fill_null(0).to_numpy()
        begin = np.concatenate([[0], np.cumsum(sizes)])
        numbers = pc.index_in(flat, pa.array(self.words, pa.string())).fill_null(-1).to_numpy(zero_copy_only=False)
        hits = list(self.matches(numbers, begin[:-1]))
        last, which = (np.array([h[i] for h in hits], np.int64) for i in (0, 1))
        lengths = np.array([len(p) for p in self.phrases] or [0], np.int64)[which]
        row = np.searchsorted(begin, last, "right") - 1
        texts = pa.array([" ".join(p) for p in self.phrases] or [""], pa.string()).take(pa.array(which))
        values = pa.StructArray.from_arrays([pa.array((last - lengths + 1 - begin[row]).astype(np.int32)), pa.array(lengths.astype(np.int32)), texts], ["pos", "n", "key"])
        return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(np.bincount(row, minlength=len(sizes)))]).astype(np.int32)), values)


def phrases_in(words: Column, phrases: Iterable[tuple[str, ...]]) -> Column:
    """array<struct<pos, n, key>>: every phrase, its words joined by spaces, that a column of lists of words holds."""
    automaton = Phrases(phrases)

    @F.arrow_udf("array<struct<pos: int, n: int, key: string>>")
    def run(lists: pa.Array) -> pa.Array:
        return automaton.in_lists(lists)

    return run(words)


#: Words of a text and where they stand; marks around a word are not of it, but part it from others.
_WORD = re.compile(r"[^\W_]+(?:['’-][^\W_]+)*")


def names_behind(body: Column, cues: dict[str, tuple[str, ...]], name: str, between: str = r"\s+(?:the\s+|the\s+coast\s+of\s+)?") -> Column:
    """array<struct<name, source>>: what ``name``, a pattern, matches right behind a cue, for cues by source, in the text's order.

    Cues are words in any case.  Of cues that end at one word the longest decides, so "launched from" is no mere "from".
    """
    source_of = {tuple(c.lower().split(" ")): s for s, own in cues.items() for c in own}
    automaton, pattern = Phrases(source_of), re.compile(between + f"({name})")
    sources = [source_of[p] for p in automaton.phrases]
    number = {w: i for i, w in enumerate(automaton.words)}

    def read(text: str | None) -> list[dict[str, str]]:
        spans = [m.span() for m in _WORD.finditer(text or "")]
        numbers = np.array([number.get(text[a:b].lower(), -1) for a, b in spans], np.int64)
        # a mark between two words parts them
        apart = np.array([i for i in range(1, len(spans)) if text[spans[i - 1][1] : spans[i][0]].strip()], np.int64)
        out, done = [], -1
        for at, k in automaton.matches(numbers, apart):
            if at == done:
                continue
            done = at
            if met := pattern.match(text, spans[at][1]):
                out.append({"name": met[1], "source": sources[k]})
        return out

    @F.arrow_udf("array<struct<name: string, source: string>>")
    def run(texts: pa.Array) -> pa.Array:
        return pa.array([read(t) for t in texts.to_pylist()], pa.list_(pa.struct([("name", pa.string()), ("source", pa.string())])))

    return run(body)
