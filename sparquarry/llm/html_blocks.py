"""Leaf blocks of HTML pages: whole text, tag path, share of link text."""

from __future__ import annotations

import html
import re

TAG = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^>\"'])*+)>|<[/!?][^>]*(?:>|\Z)|<[a-zA-Z][^>]*(?:>|\Z)|<\Z", re.S)
ATTRIBUTE = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
PIECES = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")

RAW = frozenset("script style template textarea title iframe noembed noframes xmp".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
#: Formulas and drawings and what they hold; they stand within a line of text.
FOREIGN = frozenset("math semantics annotation mrow mi mn mo ms mtext mspace mfrac msqrt mroot mstyle mpadded mphantom menclose msub msup msubsup munder mover munderover mmultiscripts mprescripts mtable mtr mtd svg g defs symbol use text tspan textpath path circle ellipse line polygon polyline rect desc".split())
INLINE |= FOREIGN
#: An element that opens closes these if they are open in the same container.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
BARRIER = frozenset("html body div section article main nav aside header footer ul ol dl table form blockquote td th figure details fieldset".split())


class Block:
    __slots__ = ("linked", "path", "text")

    def __init__(self, text: str, path: tuple[str, ...], linked: float):
        self.text, self.path, self.linked = text, path, linked


def names(tag: str, attributes: str) -> str:
    """The element as one word of the path: its tag and the pieces of its class, id and role."""
    found = " ".join(a or b or c for _, a, b, c in ATTRIBUTE.findall(attributes)) if "=" in attributes else ""
    return " ".join([tag, *(x.lower() for x in PIECES.findall(found))])


def blocks(page: str) -> list[Block]:
    """The blocks of a page in page order; text with references decoded, white space as single spaces."""
    out: list[Block] = []
    tags: list[str] = []
    path: list[str] = []
    run: list[str] = []
    run_path: tuple[str, ...] | None = None
    linked = total = 0
    at, n = 0, len(page)

    def text(raw: str) -> None:
        nonlocal run_path, linked, total
        if not raw:
            return
        run.append(raw)
        if size := len(raw.strip()):
            if run_path is None:
                run_path = tuple(p for t, p in zip(tags, path) if t not in INLINE)
            total += size
            linked += size if "a" in tags else 0

    def close() -> None:
        nonlocal run_path, linked, total
        if run_path is not None:
            clean = " ".join(html.unescape("".join(run)).split())
            if clean:
                out.append(Block(clean, run_path, linked / total))
        run.clear()
        run_path, linked, total = None, 0, 0

    def pop_to(which: set[str] | frozenset[str]) -> None:
        for i in range(len(tags) - 1, -1, -1):
            if tags[i] in which:
                del tags[i:], path[i:]
                return
            if tags[i] in BARRIER:
                return

    while at < n:
        m = TAG.search(page, at)
        if m is None:
            text(page[at:])
            break
        text(page[at : m.start()])
        at = m.end()
        if m[2] is None:
            continue
        tag = m[2].lower()
        if tag == "br":
            text("\n")
            continue
        inline = tag in INLINE
        if not inline:
            close()
        if m[1]:
            for i in range(len(tags) - 1, -1, -1):
                if tags[i] == tag:
                    del tags[i:], path[i:]
                    break
                if inline and tags[i] not in INLINE:
                    break
            continue
        # within formulas and drawings an element can end with its own tag
        if tag in RAW and not (m[3].rstrip().endswith("/") and ("svg" in tags or "math" in tags)):
            end = re.compile(f"</{tag}\\b[^>]*>", re.I).search(page, at)
            at = end.end() if end else n
            continue
        if not inline:
            pop_to({"p"})
            if tag in CLOSES:
                pop_to(CLOSES[tag])
        if tag not in VOID and not m[3].rstrip().endswith("/"):
            tags.append(tag)
            path.append(names(tag, m[3]))
    close()
    return out
