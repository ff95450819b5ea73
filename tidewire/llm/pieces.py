"""The vocabulary of a piece model, read on the driver and carried to the tasks (some tens of thousands of pieces)."""

from __future__ import annotations

import gc
import math
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache

PIECE_MODEL = "/opt/tokenizers/piece_bpe_32k.model"
#: Ranks are taken so much further down when they stand for frequencies.
RANK_SHIFT = 100.0
#: Stands for a space in pieces.
SPACE = "▁"


@dataclass(frozen=True)
class Vocabulary:
    texts: tuple[str, ...]
    scores: tuple[float, ...]
    #: Whether an id is an ordinary piece (not a byte, control or unknown piece).
    ordinary: tuple[bool, ...]
    #: The id of each byte's piece.
    byte_ids: tuple[int, ...]


def log_scores(scores: list[float]) -> list[float]:
    """Scores as they are; or, where they are merge ranks (whole numbers, none above zero), a guess at log-probabilities.

    A piece of rank r counts as about as likely as 1 / (r + ``RANK_SHIFT``), as frequencies fall with ranks.  These are
    rounded to 2**-20, so that sums of them are exact in any order.
    """
    ranked = all(s <= 0 and s == int(s) for s in scores) and min(scores, default=0.0) < -1
    return [-round(math.log(RANK_SHIFT - s) * 2**20) / 2**20 for s in scores] if ranked else scores


@lru_cache(maxsize=4)
def load(path: str = PIECE_MODEL) -> Vocabulary:
    import sentencepiece

    p = sentencepiece.SentencePieceProcessor(model_file=path)
    ids = range(p.get_piece_size())
    ordinary = tuple(not (p.is_byte(i) or p.is_control(i) or p.is_unknown(i) or p.is_unused(i)) for i in ids)
    own = iter(log_scores([float(p.get_score(i)) for i in ids if ordinary[i]]))
    return Vocabulary(
        tuple(p.id_to_piece(i) for i in ids),
        tuple(next(own) if o else 0.0 for o in ordinary),
        ordinary,
        tuple(p.piece_to_id(f"<0x{b:02X}>") for b in range(256)),
    )


def byte_alphabet() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: visible Latin-1 ones themselves, the others from U+0100 on."""
    plain = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or b >= 0xAE]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Memo(dict):
    """A memory of results by word, of bounded size: emptied when full."""

    def __init__(self, make, most: int = 300_000):
        super().__init__()
        self.make, self.most = make, most

    def __missing__(self, key):
        if len(self) >= self.most:
            self.clear()
        value = self.make(key)
        if len(key) <= 64:
            self[key] = value
        return value


class Known(dict):
    """Results by word, found for many words at a time; of bounded size between runs of texts."""

    def __init__(self, make: Callable[[list[str]], list], most: int = 500_000):
        super().__init__()
        self.make, self.most = make, most

    def learn(self, words: Iterable[str]) -> None:
        """Make all of ``words`` known.  What was known goes when there is too much of it, and so do long words."""
        words = set(words)
        if len(self) > self.most:
            self.clear()
        else:
            for w in self.long:
                self.pop(w, None)
        new = [w for w in words if w not in self]
        self.long = [w for w in new if len(w) > 64]
        collects = gc.isenabled()
        gc.disable()  # many small objects come and go, none of them in a cycle
        try:
            self.update(zip(new, self.make(new), strict=True))
        finally:
            if collects:
                gc.enable()

    long: list[str] = []


class Proven(dict):
    """Results by word, found for many words at a time; what only one run of texts had goes first where there is too much."""

    def __init__(self, make: Callable[[list[str]], dict], most: int = 120_000):
        super().__init__()
        self.make, self.most, self.again = make, most, set()

    def learn(self, words: Iterable[str]) -> None:
        """Make all of ``words`` known.  Once there are too many, those stay that a run met again since the last time; long words go."""
        words = set(words)
        if len(self) > self.most:
            kept = {w: self[w] for w in self.again if len(w) <= 64 and w in self} if len(self.again) <= self.most // 2 else {}
            self.clear()
            self.update(kept)
            self.again.clear()
        else:
            for w in self.long:
                self.pop(w, None)
        new = words.difference(self)
        self.again |= words - new
        self.long = [w for w in new if len(w) > 64]
        collects = gc.isenabled()
        gc.disable()  # many small objects come and go, none of them in a cycle
        try:
            self.update(self.make([*new]))
        finally:
            if collects:
                gc.enable()

    long: list[str] = []


def runs(texts: list[str], most: int = 1 << 21) -> Iterator[list[str]]:
    """``texts`` in order, in runs of about ``most`` characters; a longer text stands alone."""
    run, size = [], 0
    for t in texts:
        if run and size + len(t) > most:
            yield run
            run, size = [], 0
        run.append(t)
        size += len(t)
    if run:
        yield run
