"""SentencePiece encoding and decoding: an Aho-Corasick automaton over the pieces drives a single-pass Viterbi.

The automaton reads a text once.  At each character it is at the longest piece suffix, and its output links lead to
all pieces that end there; each relaxes the best score of its end.  Characters without a piece of their own may also
be written as the pieces of their UTF-8 bytes.  Pieces never hold a space but at their start, nor a line end, so texts
are cut there first, without loss.  Each different cut of a run of texts is encoded once, many cuts at a time: step t
takes the t-th character of them all.
"""

from __future__ import annotations

import hashlib
import re
from collections import deque
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, IntegerType, StringType, StructField, StructType

from .bytes_np import pieces, text_bytes
from .common import column
from .pieces import PIECE_MODEL, SPACE, Vocabulary, load

#: A character written as bytes costs so much more than the worst piece.
PENALTY = 10.0
#: Bytes of the runs of texts whose cuts are encoded together.
RUN_BYTES = 2 << 20
#: Characters that the automaton's table has columns for; cuts with others, or longer ones, are read one by one.
COLUMNS, LONGEST = 256, 48
#: Numbers of a table of best scores.
CELLS = 1 << 20


class Automaton:
    """Aho-Corasick over ``words``: a trie, failure links to the longest suffix in it, and output links.

    ``ends`` of a node has the words that end there, longest first, as (length, number).
    """

    def __init__(self, words: Iterable[tuple[int, str]]):
        self.next: list[dict[str, int]] = [{}]
        own: list[tuple[int, int] | None] = [None]
        for number, word in words:
            at = 0
            for c in word:
                to = self.next[at].get(c)
                if to is None:
                    to = self.next[at][c] = len(self.next)
                    self.next.append({})
                    own.append(None)
                at = to
            own[at] = (len(word), number)
        self.fail = [0] * len(own)
        self.ends: list[tuple[tuple[int, int], ...]] = [()] * len(own)
        queue = deque([0])
        while queue:  # by depth, so that a node's suffixes are done before it
            node = queue.popleft()
            mine = own[node]
            self.ends[node] = ((mine,) if mine else ()) + self.ends[self.fail[node]] if node else ()
            for c, to in self.next[node].items():
                z = self.fail[node]
                while z and c not in self.next[z]:
                    z = self.fail[z]
                self.fail[to] = self.next[z].get(c, 0) if node else 0
                queue.append(to)


class Table:
    """The automaton as arrays: where each node goes by each common character, failures settled, and its output links."""

    def __init__(self, automaton: Automaton, common: list[str], scores: tuple[float, ...]):
        self.column = np.full(0x110000, -1, np.int16)
        self.column[[ord(c) for c in common]] = np.arange(len(common))
        index = {c: k for k, c in enumerate(common)}
        self.next = np.zeros((len(automaton.next), len(common)), np.min_scalar_type(len(automaton.next)))
        queue = deque([0])
        while queue:
            node = queue.popleft()
            if node:
                self.next[node] = self.next[automaton.fail[node]]
            for c, to in automaton.next[node].items():
                if c in index:
                    self.next[node, index[c]] = to
                queue.append(to)
        self.count = np.array([len(e) for e in automaton.ends])
        deepest = max(1, int(self.count.max()))
        self.length, self.piece = (np.zeros((len(self.count), deepest), np.int32) for _ in range(2))
        for node, found in enumerate(automaton.ends):
            for d, (length, piece) in enumerate(found):
                self.length[node, d], self.piece[node, d] = length, piece
        self.scores = np.array(scores)

    def encode(self, flat: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Piece ids of cuts, given as columns of their characters one after another, and how many each cut has."""
        n, width = len(size), int(size.max())
        begin = np.cumsum(size) - size
        best = np.full((n, width + 1), -np.inf)
        best[:, 0] = 0
        back = np.zeros((n, width + 1), np.int32)
        node, rows = np.zeros(n, np.int32), np.arange(n)
        for t in range(width):
            rows = rows[size[rows] > t]
            at = node[rows] = self.next[node[rows], flat[begin[rows] + t]]
            live, d = np.arange(len(rows)), 0
            while len(live := live[self.count[at[live]] > d]):
                r, piece = rows[live], self.piece[at[live], d]
                score = best[r, t + 1 - self.length[at[live], d]] + self.scores[piece]
                better = score > best[r, t + 1]
                best[r[better], t + 1], back[r[better], t + 1] = score[better], piece[better]
                d += 1
        lengths = np.zeros(len(self.scores), np.int32)
        lengths[self.piece] = self.length
        place, rows, found = size.copy(), np.arange(n), []
        while len(rows := rows[place[rows] > 0]):
            piece = back[rows, place[rows]]
            found.append((rows, piece))
            place[rows] -= lengths[piece]
        owner, ids = (np.concatenate(x)[::-1] for x in zip(*found, strict=True))
        return ids[np.argsort(owner, kind="stable")], np.bincount(owner, minlength=n)


class Encoder:
    def __init__(self, vocabulary: Vocabulary):
        v = self.vocabulary = vocabulary
        own = [(i, t) for i, (t, o) in enumerate(zip(v.texts, v.ordinary, strict=True)) if o]
        self.automaton = Automaton(own)
        self.singles = {t for _, t in own if len(t) == 1}
        self.table = Table(self.automaton, [SPACE, *sorted(c for c in self.singles - {SPACE} if c.isprintable())[: COLUMNS - 1]] if SPACE in self.singles else [], v.scores)
        self.table.column[32], self.table.column[ord(SPACE)] = self.table.column[ord(SPACE)], -1
        self.unknown = min(v.scores[i] for i, _ in own) - PENALTY
        inner_space = any(re.search(f"[^{SPACE}]{SPACE}", t) for _, t in own)
        self.cuts = not (inner_space or any("\n" in t for _, t in own))
        self.bytes = [t.replace(SPACE, " ").encode() if o else b"" for t, o in zip(v.texts, v.ordinary, strict=True)]
        for b, i in enumerate(v.byte_ids):
            self.bytes[i] = bytes([b])

    def viterbi(self, text: str) -> list[tuple[int, int]]:
        """(start, id) of the best pieces in order, of equal scores the one with the longest last piece; id -1: as bytes.

        Spaces of ``text`` are written as the piece alphabet does.
        """
        follow, fail, ends = self.automaton.next, self.automaton.fail, self.automaton.ends
        scores, singles, unknown = self.vocabulary.scores, self.singles, self.unknown
        best = [0.0]
        back: list[tuple[int, int]] = [(0, -1)]
        node = 0
        for at, c in enumerate(text):
            while node and c not in follow[node]:
                node = fail[node]
            node = follow[node].get(c, 0)
            top, link = (best[at] + unknown, (at, -1)) if c not in singles else (float("-inf"), (at, -1))
            for length, piece in ends[node]:
                start = at + 1 - length
                if best[start] + scores[piece] > top:
                    top, link = best[start] + scores[piece], (start, piece)
            best.append(top)
            back.append(link)
        out, at = [], len(text)
        while at:
            out.append(back[at])
            at = back[at][0]
        return out[::-1]

    def _segment(self, raw: str) -> tuple[int, ...]:
        out: list[int] = []
        # a literal space mark is written as bytes, so that decoding gives it back
        for k, part in enumerate(raw.split(SPACE)):
            if k:
                out += [self.vocabulary.byte_ids[b] for b in SPACE.encode()]
            text = part.replace(" ", SPACE)
            for start, piece in self.viterbi(text):
                out += [piece] if piece >= 0 else [self.vocabulary.byte_ids[b] for b in text[start].encode()]
        return tuple(out)

    def encode(self, text: str) -> list[int]:
        """Ids of a text, to which a leading space is added; none for an empty text."""
        return next(self.encode_texts(pa.array([text])))[0].tolist()

    def encode_cuts(self, cuts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of cuts one after another, and how many each has."""
        size = np.fromiter(map(len, cuts), np.int64, len(cuts))
        codes = self.table.column[np.frombuffer("".join(cuts).encode("utf-32-le"), np.uint32)]
        begin = np.cumsum(size) - size
        common = (np.minimum.reduceat(codes, begin) >= 0) & (size <= LONGEST) if len(cuts) else np.zeros(0, bool)
        made: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # cuts, their ids, how many each
        order = np.flatnonzero(common)[np.argsort(size[common], kind="stable")]
        while len(order):
            # cuts of about one length, as many as a table holds
            fits = (size[order] + 1) * np.arange(1, len(order) + 1) <= max(CELLS, int(size[order[0]]) + 1)
            some, order = order[: int(fits.sum())], order[int(fits.sum()) :]
            at = np.repeat(begin[some] - (np.cumsum(size[some]) - size[some]), size[some]) + np.arange(int(size[some].sum()))
            made.append((some, *self.table.encode(codes[at], size[some])))
        rest = np.flatnonzero(~common)
        single = [self._segment(cuts[i]) for i in rest]
        made.append((rest, np.array([x for ids in single for x in ids], np.int32), np.array([len(x) for x in single], np.int64)))
        sizes = np.zeros(len(cuts), np.int64)
        for some, _, n in made:
            sizes[some] = n
        starts = np.cumsum(sizes) - sizes
        out = np.zeros(int(sizes.sum()), np.int32)
        for some, ids, n in made:
            out[np.repeat(starts[some] - (np.cumsum(n) - n), n) + np.arange(len(ids))] = ids
        return out, sizes

    def encode_texts(self, texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For runs of rows of some megabytes: their ids, and where each row's begin (one number more than rows)."""
        data, offsets = text_bytes(texts)
        for i, j in pieces(offsets, RUN_BYTES):
            part, at = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
            filled = at[:-1][np.diff(at) > 0]
            part, rows = np.insert(part, filled, 32), at + np.searchsorted(filled, at)  # a space before each text
            starts = self._starts(part, rows[:-1][np.diff(rows) > 0])
            bounds = np.append(starts, len(part)).astype(np.int64)
            cut = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(bounds), pa.py_buffer(part)).dictionary_encode()
            flat, sizes = self.encode_cuts(cut.dictionary.to_pylist())
            begin, which = np.cumsum(sizes) - sizes, cut.indices.to_numpy()
            count = sizes[which]
            total = np.concatenate([[0], np.cumsum(count)])
            ids = flat[np.arange(total[-1]) + np.repeat(begin[which] - total[:-1], count)]
            yield ids, total[np.searchsorted(starts, rows)]

    def _starts(self, part: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """Where texts are cut: before spaces that begin a run, and around line ends; and where rows begin."""
        first = np.zeros(len(part), bool)
        first[rows] = True
        if self.cuts:
            space, line = part == 32, part == 10
            first[1:] |= (space[1:] & ~space[:-1]) | line[1:] | line[:-1]
        return np.flatnonzero(first)

    def decode(self, ids) -> str:
        """The exact text of ``encode``'s ids; other ids give what their bytes say, broken ones replaced."""
        return b"".join([self.bytes[i] for i in ids])[1:].decode(errors="replace")


@lru_cache(maxsize=2)
def encoder(vocabulary: Vocabulary) -> Encoder:
    return Encoder(vocabulary)


def encode_column(docs: DataFrame, text_col: str = "text", model: str = PIECE_MODEL) -> DataFrame:
    """``docs`` with ``token_ids``, array<int>, of the whole text; null and empty texts have none.

    All other columns and rows stay as they are, whatever their names; a column of that name is replaced.
    """
    vocabulary = load(model)
    plain = docs.drop("token_ids")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(vocabulary)
        for batch in batches:
            done = 0
            for ids, at in e.encode_texts(batch.column(text_col)):
                lists = pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(ids, pa.int32()))
                yield batch.slice(done, len(lists)).append_column("token_ids", lists)
                done += len(lists)

    return plain.mapInArrow(run, StructType([*plain.schema.fields, StructField("token_ids", ArrayType(IntegerType()))]))


def encode_checked(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: str = PIECE_MODEL) -> DataFrame:
    """(id_col, token_ids, round_trip) of each row: the ids of the whole text, and whether they decode to it.

    Null texts count as empty, which have no ids.  Rows and ids stay as given; other columns are not read, and texts
    are not given back, so that a task holds them once.
    """
    vocabulary = load(model)
    slim = docs.select(column(id_col), column(text_col).cast("string").alias("text"))
    fields = [slim.schema.fields[0], StructField("token_ids", ArrayType(IntegerType())), StructField("round_trip", BooleanType())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(vocabulary)
        for batch in batches:
            done = 0
            for ids, at in e.encode_texts(batch.column(1)):
                n = len(at) - 1
                texts = batch.column(1).slice(done, n)
                same = [e.decode(ids[at[r] : at[r + 1]].tolist()) == (texts[r].as_py() or "") for r in range(n)]
                lists = pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(ids, pa.int32()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(done, n), lists, pa.array(same, pa.bool_())], [f.name for f in fields])
                done += n

    return slim.mapInArrow(run, StructType(fields))


def decode_column(docs: DataFrame, ids_col: str = "token_ids", text_col: str = "decoded", model: str = PIECE_MODEL) -> DataFrame:
    """``docs`` with the text of ``ids_col`` as ``text_col``, which is replaced; null lists give null, rows stay."""
    vocabulary = load(model)
    plain = docs.drop(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(vocabulary)
        for batch in batches:
            for i in range(0, batch.num_rows, 512):
                part = batch.slice(i, 512)
                lists = part.column(ids_col)
                ids, at = lists.flatten().to_numpy(), np.concatenate([[0], np.cumsum(lists.value_lengths().fill_null(0).to_numpy())])
                texts = [e.decode(ids[at[r] : at[r + 1]].tolist()) if lists[r].is_valid else None for r in range(part.num_rows)]
                yield part.append_column(text_col, pa.array(texts, pa.string()))

    return plain.mapInArrow(run, StructType([*plain.schema.fields, StructField(text_col, StringType())]))


def encoding_digest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: str = PIECE_MODEL) -> DataFrame:
    """(doc_id, n_tokens, n_byte_tokens, ids_sha256, round_trip) of each row: a digest of the ids as little-endian 32-bit
    numbers, and whether decoding them gives the text back.  Null texts count as empty."""
    vocabulary = load(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(vocabulary)
        is_byte = np.zeros(len(vocabulary.texts), bool)
        is_byte[list(vocabulary.byte_ids)] = True
        for batch in batches:
            out, texts = [], batch.column(1).to_pylist()
            for ids, at in e.encode_texts(batch.column(1)):
                for i, j in zip(at[:-1], at[1:], strict=True):
                    own = ids[i:j]
                    same = e.decode(own.tolist()) == (texts[len(out)] or "")
                    out.append((len(own), int(is_byte[own].sum()), hashlib.sha256(own.astype("<i4").tobytes()).hexdigest(), same))
            columns = list(zip(*out, strict=True)) or [(), (), (), ()]
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]], ["doc_id", "n_tokens", "n_byte_tokens", "ids_sha256", "round_trip"])

    slim = docs.select(column(id_col).cast("bigint").alias("doc_id"), column(text_col).cast("string").alias("text"))
    return slim.mapInArrow(run, "doc_id bigint, n_tokens bigint, n_byte_tokens bigint, ids_sha256 string, round_trip boolean")
