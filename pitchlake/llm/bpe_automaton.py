"""BPE read from left to right.

The canonical encoding of a prefix ends in exactly one token, and a sequence of tokens is canonical exactly if each is
encoded to itself and each two neighbours to the two: greedy merging by priority inside two neighbours goes as it goes in
the whole, as long as nothing merges across their ends. So the last token of a prefix follows from the last tokens of
shorter prefixes, and of those only the ones that a later token can still reach back to. That makes a finite automaton.
"""

from __future__ import annotations

from collections.abc import Callable

#: Neighbours that are remembered.
MAX_PAIRS = 400_000

#: The longest end of what was read that some token begins with, and the last token before each of its symbols and at its
#: end (None where nothing was read).
Reach = tuple


class LastTokens:
    """``symbols`` are bytes or characters: tokens are byte strings or strings of them."""

    def __init__(self, tokens, encode: Callable):
        self.tokens = {t: t for t in tokens}
        self.prefixes = {t[:n] for t in self.tokens for n in range(len(t) + 1)}
        self.encode = encode
        self.pairs: dict[tuple, bool] = {}

    def may_follow(self, left, right) -> bool:
        key = (left, right)
        if (known := self.pairs.get(key)) is None:
            if len(self.pairs) > MAX_PAIRS:
                self.pairs.clear()
            want = [right] if left is None else [left, right]
            known = self.pairs[key] = self.encode(right if left is None else left + right) == want
        return known

    def extend(self, suffix, lasts: tuple, symbol) -> tuple:
        """(token that now ends the encoding, where in ``suffix + symbol`` it begins, next suffix, next lasts, how many
        symbols of ``suffix + symbol`` the next suffix leaves behind)."""
        now = suffix + symbol
        for at in range(len(now)):  # the longest token first
            token = self.tokens.get(now[at:])
            if token is not None and self.may_follow(lasts[at], token):
                break
        else:
            at, token = len(now) - 1, symbol  # no token has this symbol: it stands alone
        cut = next(i for i in range(len(now) + 1) if now[i:] in self.prefixes)
        return token, at, now[cut:], (*lasts[cut:], token), cut
