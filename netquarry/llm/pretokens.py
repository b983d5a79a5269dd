"""Distinct pre-tokens of texts, and a bounded memory of what they were mapped to."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable

import regex
import public_tokenizers

PIECES = regex.compile(public_tokenizers.PATTERN)


def _latin() -> re.Pattern:
    """The same pattern for texts of Latin-1 alone, its classes written out; re is faster than regex, but has no \\p."""
    def members(of: str) -> str:
        return "".join(re.escape(chr(i)) for i in range(256) if regex.fullmatch(of, chr(i)))

    letters, numbers, spaces = members(r"\p{L}"), members(r"\p{N}"), members(r"\s")
    pattern = public_tokenizers.PATTERN.replace(r"[^\s\p{L}\p{N}]", f"[^{spaces}{letters}{numbers}]")
    for name, own in ((r"\p{L}", f"[{letters}]"), (r"\p{N}", f"[{numbers}]"), (r"\s", f"[{spaces}]"), (r"\S", f"[^{spaces}]")):
        pattern = pattern.replace(name, own)
    return re.compile(pattern)


LATIN = _latin()


def pieces(text: str) -> list[str]:
    """The pre-tokens of a text."""
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return PIECES.findall(text)
    return LATIN.findall(text)


class Memory(dict):
    """Pre-token to result. It starts anew beyond a number of characters, so that it stays bounded."""

    def __init__(self, most: int = 6_000_000) -> None:
        super().__init__()
        self.most, self.held = most, 0

    def learn(self, pieces: Iterable[str], results: Callable[[list[str]], list]) -> None:
        """Map the pieces that are not known yet; results gets them all at once."""
        new = [p for p in set(pieces) if p not in self]
        if not new:
            return
        found = results(new)
        size = sum(map(len, new))
        self.held += size
        self.update(zip(new, found))

    def trim(self) -> None:
        if self.held > self.most:
            self.clear()
            self.held = 0


def groups(texts: list[str], chars: int = 4_000_000) -> Iterable[list[str]]:
    """The texts in runs of at most so many characters, or one longer text."""
    run: list[str] = []
    held = 0
    for t in texts:
        if run and held + len(t) > chars:
            yield run
            run, held = [], 0
        run.append(t)
        held += len(t)
    if run:
        yield run
