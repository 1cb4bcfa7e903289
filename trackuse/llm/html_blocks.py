"""Text blocks of web pages with the features of their place and wording."""

from __future__ import annotations

import html
import re
from collections import Counter
from typing import NamedTuple
from zlib import crc32

FEATURE_BITS = 13
# a value's quotes are paired once and for all; where the tag then has no end, the first ">" ends it
_TAG = re.compile(
    r"<!--.*?(?:-->|$)|<(/?)([a-zA-Z][^\s/>]*)((?>(?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')|=)*+)(?=>)|[^>]*+)>|<[!?][^>]*+>", re.S
)
_ATTRIBUTE = re.compile(r"(class|id|role|data-main)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_NAME = re.compile(r"[a-z]+|[A-Z][a-z]*")

# The kinds of elements.
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hr html legend li main nav ol option p pre section select summary table tbody td textarea "
    "tfoot th thead title tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
HIDDEN = frozenset("script style template svg iframe object".split())
ENDS_P = BLOCKS - frozenset("body html head title option".split())
SAME = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "td": {"td", "th"}, "th": {"td", "th"}, "tr": {"tr", "td", "th"}, "option": {"option"}}
SCOPE = frozenset("ul ol dl table tr select body html article section div".split())


class Block(NamedTuple):
    """One block of text, the hash buckets of its features, and its label if the page has labels."""

    text: str
    features: list[int]
    main: bool


ANCESTORS = 64  # nearest open elements that give a block features


class _Open(NamedTuple):
    """An open element; label and link are taken over from the one around it."""

    tag: str
    features: tuple[str, ...]
    label: bool | None
    linked: bool


class _Reader:
    def __init__(self) -> None:
        self.open: list[_Open] = []
        self.tags: Counter[str] = Counter()
        self.parts: list[str] = []
        self.linked = 0
        self.found: list[tuple[str, int, tuple, bool]] = []

    def flush(self) -> None:
        text = " ".join("".join(self.parts).split())
        if text:
            label = bool(self.open and self.open[-1].label)
            self.found.append((text, self.linked, tuple(self.open[-ANCESTORS:]), label))
        self.parts, self.linked = [], 0

    def say(self, text: str) -> None:
        if text:
            text = html.unescape(text)
            self.parts.append(text)
            if self.open and self.open[-1].linked:
                self.linked += len(text)

    def start(self, tag: str, attributes: str) -> None:
        if tag == "br":
            self.parts.append(" ")
        if tag in BLOCKS:
            self.flush()
        if tag in ENDS_P:
            self.close({"p"}, BLOCKS - {"p"})
        if tag in SAME:
            self.close(SAME[tag], SCOPE - SAME[tag])
        if tag in VOID:
            return
        around = self.open[-1] if self.open else _Open("", (), None, False)
        features, label = [f"t={tag}"], around.label
        for name, *values in _ATTRIBUTE.findall(attributes) if attributes else ():
            value = "".join(values)
            if name.lower() == "data-main":
                label = value == "1"
            else:
                features += [f"c={w.lower()}" for w in _NAME.findall(value)]
        self.open.append(_Open(tag, tuple(features), label, around.linked or tag in ("a", "button")))
        self.tags[tag] += 1

    def close(self, tags: set[str], stop: frozenset[str] | set[str]) -> None:
        """Drop the innermost open one of ``tags`` and what is open inside it, unless a ``stop`` element lies between."""
        if not any(self.tags[t] for t in tags):
            return
        for i in range(len(self.open) - 1, -1, -1):
            if self.open[i].tag in tags:
                self.tags.subtract(x.tag for x in self.open[i:])
                del self.open[i:]
                return
            if self.open[i].tag in stop:
                return

    def end(self, tag: str) -> None:
        if tag in BLOCKS:
            self.flush()
        self.close({tag}, frozenset() if tag in BLOCKS else BLOCKS)


def blocks(page: str | None) -> list[Block]:
    """The blocks of a page in order, without scripts, styles and comments.

    A block is the text between starts and ends of block elements; line breaks and other
    markup in it count as nothing but ``br`` as white space. Broken markup never fails: what
    is not a tag is text, and open elements end where they must.
    """
    reader, at, page = _Reader(), 0, page or ""
    last = page.rfind(">")
    while True:
        tag = _TAG.search(page, at) if at <= last else None
        if not tag:
            # no tag ends any more, but a comment runs to the end of the page
            reader.say(page[at:].split("<!--", 1)[0])
            break
        reader.say(page[at : tag.start()])
        at = tag.end()
        if tag[2] is None:
            continue
        name = tag[2].lower()
        if name in HIDDEN:
            if not tag[1] and not tag[3].endswith("/"):
                ends = re.compile(f"</{name}\\s*>", re.I).search(page, at)
                at = ends.end() if ends else len(page)
        elif tag[1]:
            reader.end(name)
        else:
            reader.start(name, tag[3])
    reader.flush()
    return [Block(t, _features(t, linked, above), main) for t, linked, above, main in reader.found]


def bucket(feature: str) -> int:
    return crc32(feature.encode("utf-8", "surrogatepass")) & ((1 << FEATURE_BITS) - 1)


def _features(text: str, linked: int, above: tuple) -> list[int]:
    names = {f for x in above for f in x[1]}
    names |= {f"own {f}" for x in above[-1:] for f in x[1]}
    words = text.count(" ") + 1
    names.add(f"words={min(words.bit_length(), 8)}")
    names.add(f"links={round(4 * linked / len(text))}")
    names.add(f"end={text[-1] if text[-1] in '.!?:;|' else 'other'}")
    if "©" in text:
        names.add("copyright")
    return sorted({bucket(f) for f in names} | {bucket("always")})
