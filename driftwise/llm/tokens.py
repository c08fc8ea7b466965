"""Token ids of whole texts by the ``tokenizers`` library, without encoding a repeated pre-token twice.

Byte-level BPE encodes each pre-token by itself, so the ids of a text are those of its pre-tokens, one after another, and
natural texts repeat most of them. A task cuts texts into units, looks all of them up, and gives the library only the
new ones. Texts of ASCII and Latin letters are cut into pre-tokens (``UNITS``, the rule of this pre-tokenizer for these
characters). Texts with other characters are first cut before spaces between characters that are not white space,
where a pre-token always ends; parts that hold such a character stay whole. Special-token strings are cut out first, as
the library does. Words are learned joined to one text per batch and told apart by the lengths of their tokens.

The cache is bounded: two generations of at most ``MOST`` / 2 units of at most ``LONGEST`` characters. A unit is looked
up in the new one, then in the old one, which brings it into the new one; when the new one is full it becomes the old
one. So units in use stay and a worker learns on, however many distinct units pass by.
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from functools import lru_cache

import numpy as np

MOST, LONGEST = 500_000, 48
#: Twice white space before or after a space: there a cut before each space is not safe.
RUNS = re.compile(r"\s \s|\s \Z")


@lru_cache(maxsize=4)
def tokenizer(path: str):
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def pieces(text: str) -> list[str]:
    """Cuts a text without special tokens at its safe spaces. Every piece but the first starts with a space, which the
    returned list leaves out."""
    parts = text.split(" ")
    if not RUNS.search(text):
        return parts
    out = parts[:1]
    for part in parts[1:]:
        last = out[-1]
        before = len(out) > 1 and not last or last[-1:].isspace()
        if before and (not part or part[0].isspace()):
            out[-1] = f"{last} {part}"
        else:
            out.append(part)
    return out


LETTERS, SPACES = "A-Za-zÀ-ÖØ-öø-ÿ", r"\t-\r "
#: Characters outside ASCII and the letters of Latin-1; their classes are left to the library.
OTHER = re.compile(rf"[^\x00-\x7f{LETTERS}]")
#: Contractions, words, numbers, other signs, and white space, whose last character goes with what follows.
UNITS = re.compile(rf"'(?:[stmd]|re|ve|ll)| ?[{LETTERS}]+| ?[0-9]+| ?[^{SPACES}0-9{LETTERS}]+|[{SPACES}]+(?![^{SPACES}])|[{SPACES}]+")
#: A word, then something in ASCII that is no letter: a pre-token ends between the two.
WORD = re.compile(rf"([{LETTERS}]+)([\x00-\x40\x5b-\x60\x7b-\x7f].*)", re.S)


def units(text: str) -> list[str]:
    """Consecutive parts of a text without special tokens that the library encodes independently."""
    if not OTHER.search(text):
        return UNITS.findall(text)
    parts = pieces(text)
    out: list[str] = []
    for part in [parts[0], *(" " + p for p in parts[1:])]:
        if OTHER.search(part):
            out.append(part)
        else:
            out += UNITS.findall(part)
    return out


class Encoder:
    """Ids as little-endian unsigned 32-bit bytes."""

    def __init__(self, path: str):
        self.library = tokenizer(path)
        self.known: dict[str, bytes] = {}       # ids of a unit, new generation
        self.old: dict[str, bytes] = {}         # the generation before
        added = self.library.get_added_tokens_decoder()
        self.special = {t.content: np.array([i], "<u4").tobytes() for i, t in added.items()}
        strings = sorted(self.special, key=len, reverse=True)
        self.cut = re.compile("(" + "|".join(map(re.escape, strings)) + ")") if strings else None
        vocabulary = self.library.get_vocab()
        self.sizes = np.zeros(max(vocabulary.values()) + 1, "i8")       # bytes of each token: its byte-level characters
        for token, i in vocabulary.items():
            self.sizes[i] = len(token)

    def plain(self, text: str) -> bytes:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _alone(self, new: list[str]) -> dict[str, bytes]:
        found = self.library.encode_batch_fast(new, add_special_tokens=False)
        return {u: np.array(enc.ids, "<u4").tobytes() for u, enc in zip(new, found, strict=True)}

    def learn(self, new: list[str]) -> dict[str, bytes]:
        """Ids of new units; words after a space from one joined text per 10,000 of them."""
        words, others = [], []
        for u in new:
            (words if u[0] == " " and u[1:].isalpha() and not OTHER.search(u) else others).append(u)
        out = self._alone(others)
        for at in range(0, len(words), 10_000):
            batch = words[at:at + 10_000]
            text = "".join(batch)
            ids = np.array(self.library.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")
            starts = np.flatnonzero(np.frombuffer(text.encode(), "u1") == 32)       # every word brings its space
            cuts = (4 * np.searchsorted(np.cumsum(self.sizes[ids]), starts, "right")).tolist()
            raw = ids.tobytes()
            cuts.append(len(raw))
            out.update(zip(batch, [raw[a:b] for a, b in zip(cuts, cuts[1:], strict=False)], strict=True))
        return out

    def encode(self, texts: Iterable[str]) -> list[bytes]:
        """Ids of each text. Every unit is looked up once; those not found are learned together and filled in."""
        if len(self.known) > MOST // 2:
            self.old, self.known = self.known, {}
        get = self.known.get
        found: list[list] = []
        gaps: list[tuple[list, list[str], list[int]]] = []
        for text in texts:
            parts: list = []
            for i, seg in enumerate(self.cut.split(text) if self.cut else [text]):
                if i % 2:
                    parts.append(self.special[seg])
                    continue
                own = units(seg)
                ids = list(map(get, own))
                if None in ids:
                    gaps.append((ids, own, [k for k, x in enumerate(ids) if x is None]))
                parts.append(ids)
            found.append(parts)
        missing = {own[k] for _, own, at in gaps for k in at}
        fresh = {u: x for u in missing if (x := self.old.get(u)) is not None}
        new = [u for u in missing if u not in fresh]
        fresh.update(self.learn([u for u in new if len(u) <= LONGEST]))
        self.known.update(fresh)
        fresh.update(self._alone([u for u in new if len(u) > LONGEST]))
        for ids, own, at in gaps:
            for k in at:
                ids[k] = fresh[own[k]]
        return [b"".join(x if isinstance(x, bytes) else b"".join(x) for x in parts) for parts in found]


@lru_cache(maxsize=4)
def encoder(path: str) -> Encoder:
    """One per Python worker, so that tasks share what earlier ones have learned."""
    return Encoder(path)
