"""Byte-pair encoding by dynamic programming over prefixes.

For every prefix of a byte string there is exactly one token that ends it in the encoding of that prefix. The table of
these last tokens is filled from left to right: a token may follow the encoding of a shorter prefix only if the two
tokens at the joint would come out of the merge procedure as they are. Reading the table backwards gives the encoding;
appending bytes extends it without touching what is there, and an edit refills it from the edit on until the tail agrees.
"""

from __future__ import annotations

import base64
from bisect import bisect_left, bisect_right
from functools import lru_cache

import regex

#: Setting of the session that names the vocabulary file where a call does not.
SETTING = "spark.amperelake.vocabulary"
#: Fixed value: the public pattern that splits a text before merging.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


class Prefixes:
    """The last-token table of one byte string, which can be appended to and edited."""

    def __init__(self, bpe: Bpe, data: bytes = b""):
        self.bpe, self.data, self.last = bpe, bytearray(), [-1]
        self.append(data)

    def append(self, data: bytes) -> Prefixes:
        start = len(self.data)
        self.data += data
        self.last += [-1] * len(data)
        self._fill(start)
        return self

    def edit(self, at: int, remove: int, insert: bytes) -> Prefixes:
        """Replace `remove` bytes at `at` by `insert`. Entries before `at` stay; behind the edit, entries are filled anew
        only until they agree with the old ones over one token length: from there on every entry is the old one.

        An entry depends on the bytes and the entries of the longest token before it alone, so once that many successive
        entries agree with what stood there (the bytes do, behind the edit) all further ones do.
        """
        old = self.last[at + remove :]  # old[i] is the entry of the prefix that ends i bytes behind what was removed
        tail = bytes(self.data[at + remove :])
        self.data[at:] = insert + tail
        border = at + len(insert)  # prefixes longer than this end in the tail
        self.last[at + 1 :] = [-1] * (len(insert) + len(tail))
        span = self.bpe.longest
        done, same = at, 0
        self.refilled = 0
        while done < len(self.data):
            stop = min(len(self.data), max(border, done) + span)
            self._fill(done, stop)
            self.refilled += stop - done
            for j in range(max(done, border) + 1, stop + 1):
                same = same + 1 if self.last[j] == old[j - border] else 0
            done = stop
            if same >= span:
                self.last[done + 1 :] = old[done - border + 1 :]
                break
        return self

    def _fill(self, start: int, stop: int | None = None) -> None:
        """Entries of the prefixes longer than `start`, up to length `stop`: tokens may begin at any earlier prefix within
        one token length."""
        bpe, last = self.bpe, self.last
        n = len(self.data) if stop is None else stop
        first = max(0, start - bpe.longest + 1)
        data = bytes(self.data[first:n])
        ranks, grows, fits = bpe.ranks, bpe.grows, bpe.fits
        for i in range(first, n):
            before, j = last[i], i + 1
            while j <= n:
                piece = data[i - first : j - first]
                if j > start and last[j] < 0 and (t := ranks.get(piece)) is not None and (before < 0 or fits(before, t)) and bpe.reachable(t):
                    last[j] = t
                if piece not in grows:
                    break
                j += 1

    def ids(self) -> list[int]:
        out, j = [], len(self.data)
        while j:
            t = self.last[j]
            out.append(t)
            j -= len(self.bpe.bytes[t])
        return out[::-1]


class Bpe:
    """A vocabulary of ranks (lower merges first) with the pieces of text seen so far remembered up to a bound."""

    def __init__(self, vocabulary: bytes, pattern: str = PATTERN, remember: int = 400_000):
        self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in vocabulary.splitlines() if line)}
        self.bytes = {r: t for t, r in self.ranks.items()}
        self.longest = max(map(len, self.ranks))
        self.grows = {t[:i] for t in self.ranks for i in range(1, len(t))}
        self.pattern = regex.compile(pattern)
        self._fits: dict[tuple[int, int], bool] = {}
        self._reachable: dict[int, bool] = {}
        self._pieces: dict[str, list[int]] = {}
        self._remember = remember

    def merged(self, data: bytes) -> list[int]:
        """Encoding by the merge procedure itself; used on two tokens at a time, and by tests."""
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > 1:
            found = [(r, i) for i in range(len(parts) - 1) if (r := self.ranks.get(parts[i] + parts[i + 1])) is not None]
            if not found:
                break
            r, i = min(found)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return [self.ranks[p] for p in parts]

    def fits(self, a: int, b: int) -> bool:
        """Whether `a` then `b` is the encoding of their bytes."""
        if (out := self._fits.get((a, b))) is None:
            if len(self._fits) > 2_000_000:
                self._fits.clear()
            out = self._fits[a, b] = self.merged(self.bytes[a] + self.bytes[b]) == [a, b]
        return out

    def reachable(self, t: int) -> bool:
        if (out := self._reachable.get(t)) is None:
            out = self._reachable[t] = self.merged(self.bytes[t]) == [t]
        return out

    def piece(self, text: str) -> list[int]:
        data = text.encode("utf-8", "surrogatepass")
        t = self.ranks.get(data)
        return [t] if t is not None and self.reachable(t) else Prefixes(self, data).ids()

    def encode(self, text: str | None) -> list[int]:
        """Ids of a text without special tokens; of an empty or null text, none."""
        out: list[int] = []
        if not text:
            return out
        seen = self._pieces
        for p in self.pattern.findall(text):
            ids = seen.get(p)
            out += self.encode_piece(p) if ids is None else ids
        return out

    def encode_piece(self, p: str) -> list[int]:
        """Ids of one piece; short ones are remembered."""
        ids = self._pieces.get(p)
        if ids is None:
            ids = self.piece(p)
            if len(p) <= 64:
                if len(self._pieces) >= self._remember:
                    self._pieces.clear()
                self._pieces[p] = ids
        return ids

    def count(self, text: str | None) -> int:
        return len(self.encode(text))

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes.__getitem__, ids))


class Encoded:
    """The pieces and ids of one text, which can be appended to and edited.

    The pattern looks ahead but never back, so a piece that begins where an old one did, behind the edit, is that old
    piece, and so are all after it. Splitting starts one piece before the edit, since its end was decided by what follows.
    """

    def __init__(self, bpe: Bpe, text: str = ""):
        self.bpe, self.text = bpe, ""
        self.starts: list[int] = []
        self.pieces: list[list[int]] = []
        self.edit(0, 0, text)

    def append(self, text: str) -> Encoded:
        return self.edit(len(self.text), 0, text)

    def edit(self, at: int, remove: int, insert: str) -> Encoded:
        """Replace `remove` characters at `at` by `insert`; `split_again` says how many pieces were found anew."""
        shift, border = len(insert) - remove, at + len(insert)
        self.text = self.text[:at] + insert + self.text[at + remove :]
        k = max(0, bisect_right(self.starts, at) - 2)
        starts, pieces, same = [], [], len(self.starts)
        for m in self.bpe.pattern.finditer(self.text, self.starts[k] if self.starts else 0):
            if m.start() >= border:
                i = bisect_left(self.starts, m.start() - shift)
                if i < len(self.starts) and self.starts[i] == m.start() - shift:
                    same = i
                    break
            starts.append(m.start())
            pieces.append(self.bpe.encode_piece(m[0]))
        self.split_again = len(starts)
        self.starts = self.starts[:k] + starts + [s + shift for s in self.starts[same:]]
        self.pieces = self.pieces[:k] + pieces + self.pieces[same:]
        return self

    def ids(self) -> list[int]:
        return [i for p in self.pieces for i in p]


@lru_cache(maxsize=4)
def cached(vocabulary: bytes, pattern: str = PATTERN) -> Bpe:
    """One table per Python worker and vocabulary."""
    return Bpe(vocabulary, pattern)
