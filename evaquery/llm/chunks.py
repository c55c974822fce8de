"""Tokenizing by pieces that no pre-token crosses, with a bounded cache.

Byte-level and word-end BPE split a text before every merge, and never between a
character that is not white space and a white-space run that follows it. So a text cut
there gives pieces (leading white space with the word after it) that encode alone as
they do in place, and a cache of pieces saves most calls of the library.
"""

from __future__ import annotations

import os
import re
from collections.abc import Callable, Iterable

#: Unicode white space: Python's \s without the four separators that the libraries take as signs.
SPACED = re.compile(r"[^\S\x1c-\x1f]*[\S\x1c-\x1f]+|[^\S\x1c-\x1f]+")
LONGEST_CACHED = 64
MOST_CACHED = 300_000


class Cached:
    """Piece -> value, made by ``encode`` for many missing pieces at a time.

    At most ``most`` values are kept, in two generations: when the younger is full it
    becomes the older one, and what is asked for again moves back.
    """

    def __init__(self, encode: Callable[[list[str]], Iterable], most: int = MOST_CACHED) -> None:
        self.encode, self.most, self.young, self.old = encode, most, {}, {}

    def clear(self) -> None:
        self.young, self.old = {}, {}

    def values(self, lists: list[list[str]]) -> list[list]:
        """The values of lists of pieces; what is missing in any of them is encoded at once."""
        got = [list(map(self.young.get, pieces)) for pieces in lists]
        holes, asked = [], set()
        for pieces, values in zip(lists, got):
            if None in values:
                at = [i for i, v in enumerate(values) if v is None]
                holes.append((pieces, values, at))
                asked.update(map(pieces.__getitem__, at))
        if asked:
            made = {p: self.old[p] for p in asked if p in self.old}
            missing = [p for p in asked if p not in made]
            made |= zip(missing, self.encode(missing))
            for pieces, values, at in holes:
                for i in at:
                    values[i] = made[pieces[i]]
            if len(self.young) + len(made) > self.most // 2:
                self.old, self.young = self.young, {}
            self.young |= {p: v for p, v in made.items() if len(p) <= LONGEST_CACHED}
        return got

    def distinct(self, pieces: list[str]) -> list:
        """The values of pieces that do not repeat; what an Arrow dictionary holds, for one."""
        got = list(map(self.young.get, pieces))
        at = [i for i, v in enumerate(got) if v is None]
        if at:
            unknown = list(map(pieces.__getitem__, at))
            made = list(map(self.old.get, unknown))
            missing = [i for i, v in enumerate(made) if v is None]
            for i, value in zip(missing, self.encode(list(map(unknown.__getitem__, missing)))):
                made[i] = value
            for i, value in zip(at, made):
                got[i] = value
            if len(self.young) + len(made) > self.most // 2:
                self.old, self.young = self.young, {}
            self.young.update((p, v) for p, v in zip(unknown, made) if len(p) <= LONGEST_CACHED)
        return got


def library_tokenizer(path: str):
    """The tokenizers library's tokenizer of a .json file, on one thread."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def library_pieces(path: str):
    """The sentencepiece processor of a .model file."""
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path)
