"""Pages as one list of tokens in document order; an element is a range of it. Nothing here recurses, so depth is no limit.

Building, searching, dropping and writing are each one pass over the list.
"""

from __future__ import annotations

import html as entities
from collections.abc import Iterator
from html.parser import HTMLParser

# Elements without an end tag.
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
#: Elements whose text is no text of the page.
SILENT = {"script", "style", "template"}

TEXT, START = 0, 1


class Page(HTMLParser):
    """A forgiving parse: an end tag closes up to its start tag, stray ones are ignored, comments dropped.

    ``kinds``, ``values`` and ``attributes`` hold the tokens, texts and start tags; ``ends[i]``
    is the index behind the last token of the element that token i starts (i + 1 for a text).
    """

    def __init__(self, source: str) -> None:
        super().__init__(convert_charrefs=True)
        self.kinds: list[int] = []
        self.values: list[str] = []
        self.attributes: list[dict[str, str] | None] = []
        self.ends: list[int] = []
        self._open: list[int] = []
        self._waiting: dict[str, int] = {}  # open elements by tag
        self.feed(source)
        self.close()
        self._close_to(0)

    def _add(self, kind: int, value: str, attributes: dict[str, str] | None = None) -> None:
        self.kinds.append(kind)
        self.values.append(value)
        self.attributes.append(attributes)
        self.ends.append(len(self.kinds))

    def _close_to(self, depth: int) -> None:
        while len(self._open) > depth:
            at = self._open.pop()
            self.ends[at] = len(self.kinds)
            self._waiting[self.values[at]] -= 1

    def handle_starttag(self, tag, attrs):
        if tag == "p" and self._open and self.values[self._open[-1]] == "p":
            self._close_to(len(self._open) - 1)
        self._add(START, tag, {k: v or "" for k, v in attrs})
        if tag not in VOID:
            self._open.append(len(self.kinds) - 1)
            self._waiting[tag] = self._waiting.get(tag, 0) + 1

    def handle_startendtag(self, tag, attrs):
        self._add(START, tag, {k: v or "" for k, v in attrs})

    def handle_endtag(self, tag):
        if self._waiting.get(tag):
            depth = len(self._open) - 1
            while self.values[self._open[depth]] != tag:
                depth -= 1
            self._close_to(depth)

    def handle_data(self, data):
        self._add(TEXT, data)

    def find(self, tag: str, wanted: dict[str, str | tuple[str, ...]]) -> int | None:
        """Index of the first element of that tag with these attributes; a class matches as a whole or as one of several, a tuple by any of its values."""

        def has(own: dict[str, str], name: str, value: str | tuple[str, ...]) -> bool:
            values = value if isinstance(value, tuple) else (value,)
            return own.get(name) in values or name == "class" and not set(values).isdisjoint(own.get(name, "").split())

        for i, kind in enumerate(self.kinds):
            if kind == START and self.values[i] == tag and all(has(self.attributes[i], k, v) for k, v in wanted.items()):
                return i
        return None

    def kept(self, start: int, end: int, dropped: set[int]) -> Iterator[int]:
        """Indexes of a range without the elements that start at a dropped index."""
        i = start
        while i < end:
            if i in dropped:
                i = self.ends[i]
            else:
                yield i
                i += 1

    def texts(self, start: int = 0, end: int | None = None, dropped: set[int] = frozenset()) -> list[str]:
        end = len(self.kinds) if end is None else end
        return [self.values[i] for i in self.kept(start, end, dropped) if self.kinds[i] == TEXT]

    def serialize(self, start: int, end: int, dropped: set[int]) -> str:
        """Markup of a range, event attributes left out."""
        out: list[str] = []
        open_until: list[tuple[int, str]] = []
        for i in self.kept(start, end, dropped):
            while open_until and open_until[-1][0] <= i:
                out.append(f"</{open_until.pop()[1]}>")
            if self.kinds[i] == TEXT:
                out.append(entities.escape(self.values[i], quote=False))
                continue
            shown = ((k, v) for k, v in self.attributes[i].items() if not k.lower().startswith("on"))
            out.append(f"<{self.values[i]}{''.join(f' {k}="{entities.escape(v)}"' for k, v in shown)}>")
            if self.values[i] not in VOID:
                open_until.append((self.ends[i], self.values[i]))
        return "".join([*out, *(f"</{tag}>" for _, tag in reversed(open_until))])


def whole_text(source: str) -> str:
    """All text of a page, strings parted by one blank and otherwise as they stand; scripts, styles and templates have none."""
    page = Page(source)
    return " ".join(page.texts(dropped={i for i, kind in enumerate(page.kinds) if kind == START and page.values[i] in SILENT}))
