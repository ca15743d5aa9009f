"""Markup as a flat run of texts and tags, read in one pass whose time grows with the length of the text.

Every string is some page: what is no tag is text, an unknown declaration or marked section is the comment that HTML makes
of it, a comment or tag that never ends takes the rest. Nothing raises and nothing is read twice.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape
from sys import modules

from pyspark import cloudpickle

# Read inside tasks: executors need no installed package.
cloudpickle.register_pickle_by_value(modules[__name__])

TEXT, START, END = 0, 1, 2
_OPEN = re.compile(r"<(?:(/?)([a-zA-Z][^\s/>]*)|(!--)|[!?]|/)")
# The end of a tag, or one attribute with its value in one of three forms.
_ATTRIBUTE = re.compile(r"""[\s/]*+(?:>|([^\s/>][^\s/>=]*+)(?:\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s>]*+)))?)""")
_RAW = ("script", "style")
_CLOSE = {tag: re.compile(rf"</{tag}(?=[\s/>])", re.IGNORECASE) for tag in (*_RAW, "title", "textarea")}
_LONG_NUMBER = re.compile(r"&#0*([0-9]{8,});?")


def plain(text: str) -> str:
    """Character references decoded; a number beyond all characters is the replacement character."""
    return unescape(_LONG_NUMBER.sub("�", text)) if "&" in text else text


def events(html: str) -> Iterator[tuple]:
    """(TEXT, text), (START, tag, attributes) and (END, tag) in order; names in lower case, of equal attributes the first.

    The content of scripts and styles is one text, that of titles and text areas too if they end. A tag that closes
    itself starts and ends.
    """
    at = begin = 0
    size = len(html)
    unending = set()
    while found := _OPEN.search(html, at):
        start = found.start()
        if start > begin:
            yield TEXT, plain(html[begin:start])
        at = found.end()
        closing, tag, comment = found.groups()
        if comment:
            # `<!-->` and `<!--->` are whole comments
            short = 1 if html.startswith(">", at) else 2 if html.startswith("->", at) else 0
            end = at + short if short else html.find("-->", at) + 3
            at = begin = end if end > at else size
            continue
        if tag is None:
            end = html.find(">", at) + 1
            at = begin = end if end else size
            continue
        tag, attributes, slash = tag.lower(), {}, False
        while part := _ATTRIBUTE.match(html, at):
            at = part.end()
            if part[1] is None:
                slash = html.startswith("/>", at - 2)
                break
            if not closing:
                attributes.setdefault(part[1].lower(), plain(next((v for v in part.group(2, 3, 4) if v is not None), "")))
        else:
            return  # the tag never ends
        begin = at
        if closing:
            yield END, tag
            continue
        yield START, tag, attributes
        if slash:
            yield END, tag
        elif tag in _CLOSE and tag not in unending:
            end = _CLOSE[tag].search(html, at)
            if end or tag in _RAW:
                content = html[at:end.start() if end else size]
                if content:
                    yield TEXT, content if tag in _RAW else plain(content)
                at = begin = end.start() if end else size
            else:
                unending.add(tag)
    if begin < size:
        yield TEXT, plain(html[begin:])
