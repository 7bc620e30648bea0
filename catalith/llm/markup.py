"""Tags of HTML in one pass whose time grows with the page's length, whatever the markup: for operators 3 and 4."""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

# Element classes of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is no markup; it runs to their end tag.
RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6"
    " header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)

ATTRIBUTE = re.compile(r"([^\s\"'>/=]+)(?:\s*+=\s*+(?:\"([^\"]*)\"|'([^']*)'|([^\s>]*)))?")
_NAME = re.compile(r"[a-zA-Z][^\s/>]*+")
#: The rest of a tag. A quote opens a value only behind "=", and the value ends at the same quote.
_REST = re.compile(r"(?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+'|(?![\s\"'])))*+>")
_LEADING_ZEROS = re.compile(r"(&#)0+(?=\d)")
_BEYOND_UNICODE = re.compile(r"&#\d{8,};?")


def decoded(text: str) -> str:
    """Character references decoded; numbers of any length are taken, those beyond Unicode as U+FFFD."""
    if "&" not in text:
        return text
    if "&#" in text:
        text = _BEYOND_UNICODE.sub("�", _LEADING_ZEROS.sub(r"\1", text))
    return html.unescape(text)


def attributes(rest: str) -> Iterator[tuple[str, str]]:
    """(lower-case name, value as it stands) of each attribute."""
    for name, *value in ATTRIBUTE.findall(rest):
        yield name.lower(), "".join(value)


def tags(source: str) -> Iterator[tuple[int, int, bool, str, str, int]]:
    """(start, end, is an end tag, lower-case name, attributes, where the tag's own content ends) of each tag in turn.

    Comments and declarations have an empty name. For raw elements the last number is the end of their end tag, and
    scanning goes on there; without one, scripts and styles take the rest of the page and others nothing. Else it equals
    ``end``. Where a quote never closes, its tag ends at the next ">", and quotes bind no later tag; a tag without any ">"
    is the rest of the page. A "<" that begins no tag is text.
    """
    at, quotes = 0, True
    unclosed: set[str] = set()
    while (start := source.find("<", at)) >= 0:
        nxt = source[start + 1 : start + 2]
        close = nxt == "/"
        name = _NAME.match(source, start + 1 + close)
        if name is None:
            if source.startswith("<!--", start):
                end = start + 5 if source.startswith("<!-->", start) else source.find("-->", start + 4) + 3
                if end < 3:
                    end = len(source)
            elif nxt in ("!", "?") or close and source[start + 2 : start + 3].strip():
                end = source.find(">", start) + 1 or len(source)
            else:
                at = start + 1
                continue
            yield start, end, False, "", "", end
            at = end
            continue
        rest = _REST.match(source, name.end()) if quotes else None
        if rest is None:
            quotes = False
            end = source.find(">", name.end()) + 1 or len(source)
        else:
            end = rest.end()
        tag = name[0].lower()
        stop = end
        if tag in RAW and not close:
            finish = None if tag in unclosed else re.compile(rf"</{re.escape(tag)}(?=[\s/>])", re.I).search(source, end)
            behind = source.find(">", finish.end()) if finish else -1
            if behind >= 0:
                stop = behind + 1
            else:  # neither a later end tag has a ">"
                unclosed.add(tag)
                stop = len(source) if tag in ("script", "style") else end
        yield start, end, close, tag, source[name.end() : end].removesuffix(">"), stop
        at = stop
