"""The prefix table of a merge-type (BPE) vocabulary.

For each prefix of a string the table stores the one token that can come last in the prefix's encoding. A token that
ends at a place can be last there if it starts the string, or if the token stored where it starts may stand before it:
two tokens may be neighbours when merging their symbols gives back just these two. All tokens that end at a place come
from an Aho-Corasick automaton; ids are read off backwards. The number of tokens of every prefix comes with it.
"""

from __future__ import annotations

from collections.abc import Callable

import ahocorasick

#: Pairs of neighbours whose test is remembered; at most twice as many.
PAIRS = 100_000


class Recent:
    """What was found lately by key: a young and an old half of ``most`` entries; a full young half becomes the old one."""

    def __init__(self, most: int):
        self.most = most
        self.young: dict = {}
        self.old: dict = {}

    def get(self, key):
        if (found := self.young.get(key)) is None and (found := self.old.get(key)) is not None:
            self.keep(key, found)
        return found

    def keep(self, key, value) -> None:
        if len(self.young) >= self.most:
            # emptied and filled in place, so that a reader may hold on to the young half
            self.old = dict(self.young)
            self.young.clear()
        self.young[key] = value


class PrefixTable:
    """``pieces``: token string to id. ``rank``: of a pair of neighbours, lower merges first, None: never. ``symbols``: what merging of a string starts from.

    ``UNKNOWN`` stands for a symbol that no token covers; nothing merges with it.
    """

    UNKNOWN = -1

    def __init__(self, pieces: dict[str, int], rank: Callable[[str, str], int | None], symbols: Callable[[str], list[str]]):
        self.rank, self.symbols = rank, symbols
        self.string = {i: p for p, i in pieces.items()}
        self.automaton = ahocorasick.Automaton()
        for piece, i in pieces.items():
            self.automaton.add_word(piece, (len(piece), i))
        self.automaton.make_automaton()
        self._made: dict[str, tuple[bool, bool, str, str, int]] = {}
        self._many = max(self.string, default=0) + 1
        self._pairs = Recent(PAIRS)

    def merged(self, parts: list[str]) -> tuple[list[str], list[int], tuple[str, str] | None]:
        """What merging leaves of some symbols (always the pair of lowest rank, leftmost first), the ranks in the order of merging, and the last two merged."""
        parts, ranks, two = list(parts), [], None
        while len(parts) > 1:
            able = [(r, i) for i in range(len(parts) - 1) if (r := self.rank(parts[i], parts[i + 1])) is not None]
            if not able:
                break
            rank, i = min(able)
            ranks.append(rank)
            two = parts[i], parts[i + 1]
            parts[i : i + 2] = [two[0] + two[1]]
        return parts, ranks, two

    def made(self, piece: str) -> tuple[bool, bool, str, str, int]:
        """Whether merging the piece's symbols gives the piece, whether it does so by rising ranks, its two halves and their rank (-1: a symbol)."""
        if (known := self._made.get(piece)) is None:
            parts, ranks, two = self.merged(self.symbols(piece))
            known = self._made[piece] = (parts == [piece], ranks == sorted(ranks), *(two or ("", "")), ranks[-1] if ranks else -1)
        return known

    def whole(self, token: int) -> bool:
        """Whether merging the token's own string gives the token."""
        return self.made(self.string[token])[0]

    def compatible(self, a: str, b: str) -> bool:
        """Whether merging the symbols of two whole pieces gives back just these two.

        Looks back in time from the end: as long as the pieces that meet stand side by side, merging them must come later
        than the merge that takes one of them away; of equal ranks the left one comes first.
        """
        until, right = None, False
        while True:
            rank = self.rank(a, b)
            if rank is not None and (until is None or rank < until or (right and rank == until)):
                return False
            x, y = self.made(a), self.made(b)
            if x[4] < 0 and y[4] < 0:
                return True
            right = y[4] >= x[4]
            if right:
                b, until = y[2], y[4]
            else:
                a, until = x[3], x[4]

    def neighbours(self, left: int, right: int) -> bool:
        """Whether ``right`` can follow ``left`` (a whole token) in an encoding; if so, ``right`` is whole too."""
        if left == self.UNKNOWN:
            return self.whole(right)
        key = left * self._many + right
        if (known := self._pairs.get(key)) is None:
            a, b = self.string[left], self.string[right]
            if not self.whole(right):
                known = False
            elif self.made(a)[1] and self.made(b)[1]:
                known = self.compatible(a, b)
            else:
                known = self.merged(self.symbols(a) + self.symbols(b))[0] == [a, b]
            self._pairs.keep(key, known)
        return known

    def last_tokens(self, text: str) -> tuple[list[int | None], list[int]]:
        """For each prefix length: its last token (None: no encoding ends there) and that token's start."""
        n = len(text)
        last: list[int | None] = [None] * (n + 1)
        start = [0] * (n + 1)
        tested, many = self._pairs.young.get, self._many
        covered = 0  # up to here all places are settled, with or without an encoding
        for end, (size, token) in self.automaton.iter(text):
            if covered < end:
                self._uncovered(covered, end, last, start)
            covered = end + 1
            if last[covered] is not None:
                continue
            at = covered - size
            if at:
                before = last[at]
                if before is None:
                    continue
                good = tested(before * many + token)
                if not (self.neighbours(before, token) if good is None else good):
                    continue
            elif not self.whole(token):
                continue
            last[covered], start[covered] = token, at
        if covered < n:
            self._uncovered(covered, n, last, start)
        return last, start

    def _uncovered(self, a: int, b: int, last: list, start: list) -> None:
        """Places a + 1 to b, at which no token ends: each is a symbol by itself."""
        for place in range(a + 1, b + 1):
            if place == 1 or last[place - 1] is not None:
                last[place], start[place] = self.UNKNOWN, place - 1

    def counts(self, text: str) -> tuple[list[int | None], list[int]]:
        """For each prefix length: its last token and its number of tokens."""
        last, start = self.last_tokens(text)
        count = [0] * len(last)
        for place in range(1, len(last)):
            count[place] = count[start[place]] + 1 if last[place] is not None else 0
        return last, count

    def spans(self, text: str) -> list[tuple[int, int, int]]:
        """(id, start, end) of each token, recovered from the end backwards, the last one first; an uncovered symbol has the id UNKNOWN."""
        last, start = self.last_tokens(text)
        out, place = [], len(text)
        while place:
            at = start[place]
            out.append((last[place], at, place))
            place = at
        return out
