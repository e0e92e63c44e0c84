"""Token ids of whole texts for operators that only count and place tokens.

No token crosses white space, so a text is cut there and each distinct piece is encoded once per batch. Pieces that the
cache lacks are cut to words, and the words' merges run for all of them at once in numpy: one row of symbols per word,
of every row the pair of lowest rank (the leftmost of equal ones) is merged per step. The ids are those of the
vocabulary's own library; words longer than a row, and texts with the vocabulary's special tokens, take the queue of
:mod:`.bpe`."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import cache

import numpy as np

from .bpe import BREAK, PART_CHARS, Vocabulary, vocabulary

#: Pieces that a worker's cache holds at most, and characters of each: together about 120 MB. A full cache starts anew.
CACHE_PIECES, CACHE_CHARS = 400_000, 64
#: Bytes of a word that a row of symbols holds, by widths; words merged at a time.
WIDTHS, WORDS_AT_ONCE = (8, 12, 24), 1 << 14
#: Characters that ``str.split`` takes for white space and the vocabulary doesn't.
ODD_SPACE = re.compile("[\x1c-\x1f]")
#: A full stop or comma at the end of a word that belongs to a longer run of marks.
JOINED_STOP = re.compile(r"[.,](?<=[^\w\s].|_.)[ \n]")
NONE = np.iinfo(np.int32).max


class ChunkEncoder:
    def __init__(self, v: Vocabulary):
        self.v, self.known = v, {}
        keys = np.array(sorted(v.merges), np.int64)
        found = [v.merges[k] for k in keys.tolist()]
        self.keys = np.append(keys, np.iinfo(np.int64).max)
        self.ranks = np.array([*(r for r, _ in found), NONE], np.int32)
        self.merged = np.array([*(m for _, m in found), -1], np.int32)
        self.whole = None not in v.inner and None not in v.last
        self.inner, self.last = (np.array([-1 if s is None else s for s in t], np.int64) for t in (v.inner, v.last))
        self.special = re.compile("|".join(map(re.escape, v.special))) if v.special else None

    def _look_up(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        key = left << 32 | right
        at = np.searchsorted(self.keys, key)
        hit = (self.keys[at] == key) & (left >= 0) & (right >= 0)
        return np.where(hit, self.ranks[at], NONE), np.where(hit, self.merged[at], -1)

    def _merge(self, raw: list[bytes], width: int) -> list[bytes]:
        """The ids of words of at most ``width`` bytes."""
        sizes = np.fromiter(map(len, raw), np.int64, len(raw))
        starts = np.cumsum(sizes) - sizes
        data = np.frombuffer(b"".join(raw) + bytes(width), np.uint8)
        columns = np.arange(width)
        out = np.full((len(raw), width + 1), -1, np.int64)
        out[:, :width] = np.where(columns < sizes[:, None], self.inner[data[starts[:, None] + columns]], -1)
        rows = np.arange(len(raw))
        out[rows, sizes - 1] = self.last[data[starts + sizes - 1]]
        ranks, merged = self._look_up(out[:, :-1], out[:, 1:])
        symbols, live = out.copy(), rows
        while len(live):
            least = ranks.argmin(axis=1)
            each = np.arange(len(live))
            more = ranks[each, least] < NONE
            if not more.all():  # finished words leave
                out[live[~more]] = symbols[~more]
                live, symbols, ranks, merged, least = live[more], symbols[more], ranks[more], merged[more], least[more]
                each = np.arange(len(live))
                if not len(live):
                    break
            symbols[each, least] = merged[each, least]
            after = columns + (columns > least[:, None])  # the places behind the merged pair move up by one
            symbols[:, :width] = np.take_along_axis(symbols, after, 1)
            symbols[:, width] = -1
            after = np.minimum(after, width - 1)
            ranks, merged = np.take_along_axis(ranks, after, 1), np.take_along_axis(merged, after, 1)
            ranks[:, -1], merged[:, -1] = NONE, -1
            ranks[each, least], merged[each, least] = self._look_up(symbols[each, least], symbols[each, least + 1])
            own = np.flatnonzero(least > 0)
            if len(own):
                at = least[own]
                ranks[own, at - 1], merged[own, at - 1] = self._look_up(symbols[own, at - 1], symbols[own, at])
        kept = out >= 0
        ends = np.cumsum(kept.sum(1)) * 4
        ids = out[kept].astype("<u4").tobytes()
        return [ids[a:b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)]

    def _words(self, words: list[str]) -> dict[str, bytes]:
        raw = [w.encode() for w in words]
        sizes = np.fromiter(map(len, raw), np.int64, len(raw))
        found: dict[str, bytes] = {}
        least = 0
        for width in WIDTHS if self.whole else ():
            own = np.flatnonzero((sizes > least) & (sizes <= width))
            for a in range(0, len(own), WORDS_AT_ONCE):
                part = own[a : a + WORDS_AT_ONCE].tolist()
                found.update(zip([words[i] for i in part], self._merge([raw[i] for i in part], width), strict=True))
            least = width
        for i in np.flatnonzero(sizes > least).tolist():
            found[words[i]] = np.array(self.v.word(words[i]), "<u4").tobytes()
        return found

    def _learn(self, pieces: list[str]) -> dict[str, bytes]:
        found = self._words([p for p in pieces if p.isalpha()])
        others = [p for p in pieces if p not in found]
        cut = [self.v.ascii_words.findall(p) if p.isascii() else self.v.words.findall(p) for p in others]
        ids = self._words(list({w for words in cut for w in words}))
        found.update(zip(others, [b"".join([ids[w] for w in words]) for words in cut], strict=True))
        return found

    def _pieces(self, text: str) -> list[str]:
        """Lower-cased text between white space, full stops and commas at the ends of words apart."""
        if not text.isascii():
            if not unicodedata.is_normalized("NFC", text):
                text = unicodedata.normalize("NFC", text)
            text = text.replace("Σ", "σ")
        text = text.lower()
        if not JOINED_STOP.search(text):
            text = text.replace(". ", " . ").replace(", ", " , ").replace(".\n", " .\n")
        return text.split()

    def _odd(self, text: str) -> bool:
        """Whether it can't be cut to pieces."""
        return bool(ODD_SPACE.search(text) or (self.special and self.special.search(text)))

    @staticmethod
    def _parts(text: str) -> Iterator[str]:
        """Parts of a long text, cut before white space."""
        at = 0
        while at < len(text):
            end = len(text)
            if end - at > PART_CHARS:  # the last break within reach, else the next one
                end = max(text.rfind(" ", at + 1, at + PART_CHARS), text.rfind("\n", at + 1, at + PART_CHARS))
                if end <= at:
                    cut = BREAK.search(text, at + PART_CHARS)
                    end = cut.start() if cut else len(text)
            yield text[at:end]
            at = end

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers; null and empty texts have none."""
        if len(texts) > 1 and any(t and len(t) > PART_CHARS for t in texts):
            return [self.encode([t])[0] for t in texts]
        if len(texts) == 1 and texts[0] and len(texts[0]) > PART_CHARS and not self._odd(texts[0]):
            parts = list(self._parts(texts[0]))
            if len(parts) > 1:
                return [b"".join([self.encode([part])[0] for part in parts])]
        whole = [bool(t) and self._odd(t) for t in texts]
        pieces = [[] if w or not t else self._pieces(t) for t, w in zip(texts, whole, strict=True)]
        distinct = set().union(*pieces)
        missing = [p for p in distinct if p not in self.known]
        if missing and len(self.known) + len(missing) > CACHE_PIECES:
            self.known.clear()
            missing = list(distinct)
        learnt = self._learn(missing)
        known = self.known
        known.update(learnt)
        own = {p: known[p] for p in distinct}  # the batch's pieces alone: looked up many times, and small
        out = [b"".join(map(own.__getitem__, some)) for some in pieces]
        for i, w in enumerate(whole):
            if w:
                out[i] = np.frombuffer(self.v.encode(texts[i]), np.uint32).astype("<u4").tobytes()
        for p in missing:
            if len(p) > CACHE_CHARS:
                del known[p]
        return out


@cache
def chunk_encoder(path: str) -> ChunkEncoder:
    """One per Python worker, kept while the worker lives."""
    return ChunkEncoder(vocabulary(path))
