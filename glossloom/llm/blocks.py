"""Leaf blocks of a page: text between the borders of block elements, with its tag path. Small helpers for use inside tasks."""

from __future__ import annotations

import html
import re
import zlib
from dataclasses import dataclass

import numpy as np

#: Elements whose borders end a block. Fixed by the markup language.
BLOCK = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html legend li main menu nav ol optgroup option p pre search section select summary table tbody td tfoot th thead tr ul".split()
)
#: Elements without content, and those whose content is no text of the page.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HIDDEN = ("script", "style", "noscript", "template", "title", "svg", "math", "iframe", "object", "canvas", "audio", "video", "textarea")
#: An element that starts ends these open ones, up to its nearest ancestor of the second set.
_ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "option": ({"option"}, {"select"}),
    "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
}
_OPEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(?P<hidden>" + "|".join(HIDDEN) + r")(?=[\s/>])[^>]*>.*?(?:</(?P=hidden)\s*>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(?P<close>/?)(?P<tag>[A-Za-z][^\s/>]*)(?P<rest>(?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|<(?P<close2>/?)(?P<tag2>[A-Za-z][^\s/>]*)(?P<rest2>[^>]*)(?:>|\Z)",
    re.S | re.I,
)
_NAMED = re.compile(r"(?:class|id|role|itemprop|aria-label)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_NAME_WORD = re.compile(r"[A-Z]?[a-z]{2,}|[A-Z]{2,}")


#: Levels of nesting that a block's path tells.
DEPTH = 32


@dataclass
class Block:
    text: str
    path: tuple[str, ...]  # tags of the open block elements, outermost first
    names: tuple[str, ...]  # words of their classes, ids and roles
    linked: int  # characters inside links


def blocks(page: str) -> list[Block]:
    """All blocks with text in page order; white space is one blank, character references are decoded."""
    out: list[Block] = []
    stack: list[tuple[str, tuple[str, ...]]] = []
    parts: list[str] = []
    linked, in_link = 0, 0

    def flush() -> None:
        nonlocal linked
        text = " ".join(html.unescape("".join(parts)).split())
        if text:
            near = stack[-DEPTH:]
            out.append(Block(text, tuple(t for t, _ in near), tuple(n for _, names in near for n in names), min(linked, len(text))))
        parts.clear()
        linked = 0

    at = 0
    for m in _OPEN.finditer(page):
        if m.start() > at:
            parts.append(page[at : m.start()])
            linked += (m.start() - at) * (in_link > 0)
        at = m.end()
        tag = m["tag"] or m["tag2"]
        if not tag:
            continue  # comments, declarations and hidden elements are no text and end no word
        tag, closes = tag.lower(), (m["close"] or m["close2"]) == "/"
        if tag == "br":
            parts.append(" ")
        elif tag == "a":
            in_link = 0 if closes else 1
        if tag not in BLOCK:
            continue
        flush()
        if closes:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == tag:
                    del stack[i:]
                    in_link = 0
                    break
            continue
        if stack and stack[-1][0] == "p":
            stack.pop()  # a paragraph holds no other block
        ended, until = _ENDS.get(tag, ((), ()))
        for i in range(len(stack) - 1, -1, -1) if ended else ():
            if stack[i][0] in until:
                break
            if stack[i][0] in ended:
                del stack[i:]
                break
        if tag not in VOID:
            rest = m["rest"] if m["tag"] else m["rest2"]
            words = [w.lower() for v in _NAMED.findall(rest) for w in _NAME_WORD.findall(" ".join(v))] if "=" in rest else []
            stack.append((tag, tuple(dict.fromkeys(words))))
    parts.append(page[at:])
    flush()
    return out


#: Buckets of tags and names, and of words.
PATHS, WORDS = 1 << 11, 1 << 12
NUMBERS = 12
_END = tuple(".!?:;…\"'”’)。！？")


def path_features(block: Block) -> tuple[list[int], list[int]]:
    """Buckets of the tag path (each tag, the last two and their pair) and of the names."""
    crc = zlib.crc32
    p = block.path[-12:]
    tags = [crc(t.encode(), 1) % PATHS for t in dict.fromkeys(p)] + [crc(" ".join(p[-k:]).encode(), 2) % PATHS for k in (1, 2)]
    return tags, [crc(n.encode(), 3) % PATHS for n in block.names[-24:]]


def word_features(text: str) -> np.ndarray:
    words = text.lower().encode("utf-8", "surrogatepass").split()
    return np.fromiter((zlib.crc32(w) % WORDS for w in words), np.int64, len(words))


def numbers(page: list[Block]) -> np.ndarray:
    """Sizes, shares and place of each block of a page."""
    out = np.zeros((len(page), NUMBERS), np.float32)
    most = max((len(b.text) for b in page), default=1)
    for i, b in enumerate(page):
        t, n = b.text, len(b.text)
        words = t.count(" ") + 1
        out[i] = (
            np.log1p(n) / 5, np.log1p(words) / 4, b.linked / n, n / words / 10, sum(map(t.count, ".,;!?")) / words, sum(map(str.isdigit, t[:200])) / min(n, 200),
            t.endswith(_END), t[:1].isupper(), i / len(page), n / most, len(b.path) / 10, 1.0 / (1 + i),
        )
    return out
