"""Fast exact encoding with a byte-level BPE of the tokenizers library.

A text is cut before every blank that follows a character other than white
space: no pre-token crosses such a place, so each stretch is encoded alone and
its ids depend on nothing around it. Stretches repeat far more often than
texts, so a worker keeps those it has met in a bounded dictionary.
"""

from __future__ import annotations

import functools
import os
import re
import unicodedata
from collections.abc import Callable

#: Letters, numbers and white space keep their class in every Unicode version below this code point.
STABLE = 0x250
#: Stretches that a worker keeps; at about 250 bytes each.
CACHED = 600_000
#: Longer stretches are encoded each time.
CACHED_CHARS = 64

_LETTER = "".join(re.escape(chr(c)) for c in range(STABLE) if unicodedata.category(chr(c))[0] == "L")
_NUMBER = "".join(re.escape(chr(c)) for c in range(STABLE) if unicodedata.category(chr(c))[0] == "N")
_SPACE = r"\t-\r \x85\xa0"
_PIECE = re.compile(
    rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{_LETTER}]+| ?[{_NUMBER}]+| ?[^{_SPACE}{_LETTER}{_NUMBER}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+"
)
_STABLE_ONLY = re.compile(rf"[\x00-{chr(STABLE - 1)}]*")
_BLANK_AFTER_SPACE = re.compile(r"\s ")


def _byte_letters() -> dict[int, str]:
    """The letter that stands for each byte: printable bytes for themselves, the others from 256 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in printable]
    return {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Coder(dict):
    """Stretch (without its leading blank) -> value(ids); unknown stretches are encoded on first use."""

    def __init__(self, path: str, value: Callable[[list[int]], object]):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model, self.value = self.tokenizer.model, value
        self.letters, self.pieces = _byte_letters(), {}
        self.special = {t.content: i for i, t in self.tokenizer.get_added_tokens_decoder().items()}
        self.special_at = re.compile("(" + "|".join(re.escape(x) for x in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None

    def _piece(self, piece: str) -> list[int]:
        ids = self.pieces.get(piece)
        if ids is None:
            ids = [t.id for t in self.model.tokenize(piece.encode().decode("latin-1").translate(self.letters))]
            if len(piece) <= CACHED_CHARS:
                if len(self.pieces) >= CACHED:
                    self.pieces.clear()
                self.pieces[piece] = ids
        return ids

    def ids(self, stretch: str) -> list[int]:
        """Ids of a stretch without special strings."""
        if stretch.isascii() or _STABLE_ONLY.fullmatch(stretch):
            pieces = _PIECE.findall(stretch)
            if len(pieces) == 1:
                return self._piece(pieces[0])
            return [i for p in pieces for i in self._piece(p)]
        return self.tokenizer.encode(stretch, add_special_tokens=False).ids

    def __missing__(self, key: str):
        value = self.value(self.ids(" " + key))
        if len(key) <= CACHED_CHARS:
            if len(self) >= CACHED:
                self.clear()
            self[key] = value
        return value

    def _plain(self, text: str) -> list:
        first, *rest = stretches(text)
        return [self.value(self.ids(first)), *map(self.__getitem__, rest)]

    def values(self, text: str) -> list:
        """The values of a text's stretches in order; special strings are tokens of their own."""
        if self.special_at is None or not any(s in text for s in self.special):
            return self._plain(text)
        out = []
        for part in self.special_at.split(text):
            out += [self.value([self.special[part]])] if part in self.special else self._plain(part)
        return out


#: A longer run without a blank goes to the library itself, whose time grows less with the run.
LONG_RUN = 5_000
_LONG = re.compile(rf"[^ ]{{{LONG_RUN}}}| {{{LONG_RUN}}}")


class FastEncoder:
    """Ids of whole texts, special strings taken as plain text: tiktoken with the ranks of the same vocabulary file.

    Merges are tried in the order of their ids, as in the file. Texts with
    characters whose class may differ between the two libraries, or with very long
    runs, go to the tokenizers library.
    """

    def __init__(self, path: str):
        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.special = {t.content: i for i, t in self.tokenizer.get_added_tokens_decoder().items()}
        self.special_at = re.compile("(" + "|".join(re.escape(x) for x in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None
        byte = {c: b for b, c in _byte_letters().items()}
        #: Bytes of each id but the special ones.
        self.bytes = {i: bytes(map(byte.__getitem__, t)) for t, i in self.tokenizer.get_vocab(with_added_tokens=False).items() if t not in self.special}
        self.fast = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks={b: i for i, b in self.bytes.items()}, special_tokens={}).encode_ordinary

    def plain(self, text: str) -> list[int]:
        if (text.isascii() or _STABLE_ONLY.fullmatch(text)) and not _LONG.search(text):
            return self.fast(text)
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def ids(self, text: str) -> list[int]:
        """As plain(), but a special string inside the text is the token of that name."""
        if self.special_at is None or not any(s in text for s in self.special):
            return self.plain(text)
        return [i for part in self.special_at.split(text) for i in ([self.special[part]] if part in self.special else self.plain(part))]


@functools.lru_cache(maxsize=2)
def encoder(path: str) -> FastEncoder:
    """The encoder of this worker for a vocabulary file; it keeps no texts."""
    return FastEncoder(path)


def stretches(text: str) -> list[str]:
    """The first stretch, then the others without their leading blank."""
    parts = text.split(" ")
    if not _BLANK_AFTER_SPACE.search(text):
        return parts
    out = parts[:1]
    for part in parts[1:]:
        if out[-1][-1:].isspace() or (not out[-1] and len(out) > 1):
            out[-1] = f"{out[-1]} {part}"
        else:
            out.append(part)
    return out


_CODERS: dict[tuple[str, str], Coder] = {}


def coder(path: str, name: str, value: Callable[[list[int]], object]) -> Coder:
    """The coder of this worker for a vocabulary file; name tells apart different values."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    if (path, name) not in _CODERS:
        _CODERS[path, name] = Coder(path, value)
    return _CODERS[path, name]
