"""Pre-tokens of a byte-level BPE vocabulary, and caches over them for use inside tasks."""

from __future__ import annotations

import json
import os
import re
from collections.abc import Callable, Iterator

import regex

#: The vocabulary's pre-token rule and Unicode's white space.
SPACE = r"\t\n\x0b\x0c\r\x20\x85\xa0  -     　"
PRE_TOKEN = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{SPACE}\p{{L}}\p{{N}}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"
#: A piece is a run between spaces with the one space before it.  Every pre-token lies within one piece,
#: so a text is cut into pieces by a cheap rule and only unseen pieces meet the full one.
PIECE = rf" ?[^{SPACE}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"

#: Entries of a worker's cache before it starts anew, and the longest piece that is kept in one.
CACHE_ENTRIES = 600_000
CACHE_CHARS = 64
#: Where a cut at single spaces would not keep to pre-tokens: a space before more white space, or at the end.
UNEVEN_SPACE = re.compile(rf"\x20(?:[{SPACE}]|\Z)")


def load(path: str):
    """The library's tokenizer, without threads of its own inside a task."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


def special_tokens(path: str) -> dict[str, int]:
    with open(path, encoding="utf-8") as file:
        return {token["content"]: token["id"] for token in json.load(file)["added_tokens"]}


class Cache(dict):
    """Values by key; an unseen key is computed and kept while there is room and the key is short.

    ``pinned`` entries stay when the cache starts anew.
    """

    def __init__(self, compute: Callable, pinned: dict | None = None, entries: int = CACHE_ENTRIES):
        super().__init__(pinned or {})
        self.compute, self.pinned, self.most = compute, pinned or {}, entries + len(pinned or {})

    def __missing__(self, key):
        value = self.compute(key)
        if len(key) <= CACHE_CHARS:
            if len(self) >= self.most:
                self.clear()
                self.update(self.pinned)
            self[key] = value
        return value


class Pieces:
    """Values of a text's pieces, in order, from a function of one pre-token.

    ``pinned`` has values of pieces by their text without the one space before it.
    """

    def __init__(self, of_pre_token: Callable, joined: Callable, pinned: dict | None = None):
        self.find, self.pre_tokens, self.joined = re.compile(PIECE).findall, regex.compile(PRE_TOKEN).findall, joined
        self.by_pre_token = Cache(of_pre_token)
        self.by_word = Cache(self.of_word, pinned)

    def of_word(self, word: str):
        """The value of a space and ``word``."""
        if word.isalpha():
            return self.by_pre_token.compute(" " + word)
        if word[-1] in ".," and word[:-1].isalpha():
            return self.joined((self.by_pre_token[" " + word[:-1]], self.by_pre_token[word[-1]]))
        return self.joined(map(self.by_pre_token.__getitem__, self.pre_tokens(" " + word)))

    def of(self, text: str):
        """The value of ``text``, which holds no special string."""
        if UNEVEN_SPACE.search(text):
            return self.joined(self.of_word(p[1:]) if p[0] == " " and len(p) > 1 and not p[1].isspace() else self.joined(map(self.by_pre_token.__getitem__, self.pre_tokens(p))) for p in self.find(text))
        first, *words = text.split(" ")
        return self.joined((self.joined(map(self.by_pre_token.__getitem__, self.pre_tokens(first))), self.joined(map(self.by_word.__getitem__, words))))


def splitter(specials: dict[str, int]) -> Callable[[str], Iterator[tuple[str, bool]]]:
    """Cuts a text at special strings, as the library does before it looks for pre-tokens."""
    if not specials:
        return lambda text: iter([(text, False)])
    longest_first = sorted(specials, key=lambda s: (-len(s), s))
    rule = regex.compile("(" + "|".join(map(regex.escape, longest_first)) + ")")

    def parts(text: str) -> Iterator[tuple[str, bool]]:
        if not any(s in text for s in longest_first):
            yield text, False
            return
        for k, part in enumerate(rule.split(text)):
            if part:
                yield part, k % 2 == 1

    return parts
