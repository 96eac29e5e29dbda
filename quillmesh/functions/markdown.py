"""Extended markdown (with components in angle brackets) as plain markdown.

A scanner parts the text into fences, inline code, component tags and the rest;
open components wait on a stack with what they hold so far; a closed one is
written into its parent by what its name stands for. Code is never looked into.
"""

from __future__ import annotations

import re
import textwrap
from collections.abc import Iterator
from dataclasses import dataclass, field
from html import escape

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Components of extended markdown and what becomes of them.
COMPONENTS = {
    "Tabs": "unwrap", "Tab": "heading", "CodeGroup": "unwrap", "CardGroup": "unwrap", "Card": "heading", "Steps": "unwrap", "Step": "heading", "AccordionGroup": "unwrap",
    "Accordion": "heading", "Frame": "unwrap", "Tooltip": "unwrap", "Note": "quote", "Warning": "quote", "Tip": "quote", "Info": "quote", "Caution": "quote",
}
# Fixed value: the heading of the quoted index of all pages that sites put on top.
INDEX_HEADING = "> ## Documentation Index"

_SCANNER = re.compile(
    r"""(?P<fence>^(?P<margin>[ \t]*)(?P<ticks>`{3,})(?P<info>[^`\n]*)\n (?P<code>[\s\S]*?) (?:^[ \t]*(?P=ticks)[ \t]*(?:\n|\Z)|\Z))
      | (?P<span>(?P<tick>`+)[^`\n]*(?P=tick))
      | <(?P<end>/?)(?P<name>[A-Z][A-Za-z0-9]*)(?P<attrs>(?:\s+(?:[\w:-]+(?:=(?:"[^"]*"|'[^']*'|\{[^{}]*\}|[^\s<>"'{}]+))?))*)\s*(?P<alone>/?)>""",
    re.M | re.X,
)
_ATTRIBUTE = re.compile(r"""([\w:-]+)=(?:"([^"]*)"|'([^']*)'|\{([^{}]*)\}|(\S+))""")
_WRITTEN_FENCE = re.compile(r"(^(?:> ?)*[ \t]*(`{3,})[^\n]*\n(?:.*\n)*?(?:> ?)*[ \t]*\2[ \t]*$)|\n{3,}", re.M)


@dataclass
class _Open:
    """A component not closed yet."""

    name: str = ""
    title: str | None = None
    inline: bool = False
    parts: list[str] = field(default_factory=list)

    def written(self) -> str:
        text = "".join(self.parts)
        action = COMPONENTS.get(self.name)
        if action is None:  # unknown ones lose their tags only
            return text
        if self.inline:
            return text.strip()
        block = textwrap.dedent(text).strip("\n")
        if action == "quote":
            block = "\n".join(f"> {line}".rstrip() for line in block.strip().split("\n"))
        elif action == "heading" and self.title:
            block = f"## {self.title}\n\n{block}"
        return f"\n\n{block}\n\n"


def _without_index(text: str) -> str:
    """The text without the quoted index on top of a page."""
    before, mark, rest = text.partition(INDEX_HEADING + "\n")
    if not mark or (before and not before.endswith("\n")):
        return text
    lines = rest.split("\n")
    quoted = next((k for k, line in enumerate(lines) if not line.startswith(">")), len(lines))
    return text if not quoted else before + "\n".join(lines[quoted:]).lstrip("\n")


def _fence(found: re.Match) -> str:
    """A code block, closed if it wasn't: its language alone behind the ticks, what else was written there above it in bold."""
    language, _, rest = found["info"].strip().partition(" ")
    label = _ATTRIBUTE.sub("", rest).strip() if language else ""
    head = f"{found['margin']}**{' '.join(label.split())}**\n\n" if label else ""
    code = found["code"] if found["code"].endswith("\n") or not found["code"] else found["code"] + "\n"
    return f"{head}{found['margin']}{found['ticks']}{language}\n{code}{found['margin']}{found['ticks']}\n"


def plain_markdown(text: str | None) -> str | None:
    """Extended markdown as plain markdown: components unwrapped and dedented, titled ones under a heading, notes as quotes.

    Null stays null; a component without an end holds the rest of its parent; an end
    without a start and tags of unknown components are dropped.
    """
    if text is None:
        return None
    text = _without_index(text)
    waiting, at = [_Open()], 0

    def close() -> None:
        done = waiting.pop()
        waiting[-1].parts.append(done.written())

    for found in _SCANNER.finditer(text):
        waiting[-1].parts.append(text[at : found.start()])
        at = found.end()
        if found["fence"] is not None:
            waiting[-1].parts.append(_fence(found))
        elif found["span"] is not None:
            waiting[-1].parts.append(found["span"])
        elif not found["end"]:
            attributes = {name: next(v for v in values if v or v == values[-1]) for name, *values in _ATTRIBUTE.findall(found["attrs"])}
            title = attributes.get("title", "").replace("#", r"\#") or None
            line = text[text.rfind("\n", 0, found.start()) + 1 : found.start()]
            finish = text.find(f"</{found['name']}>", at)
            element = _Open(found["name"], title, bool(line.strip()) and 0 <= finish and "\n" not in text[at:finish])
            waiting.append(element)
            if found["alone"]:
                close()
        elif any(element.name == found["name"] for element in waiting):
            while waiting[-1].name != found["name"]:
                close()
            close()
    waiting[-1].parts.append(text[at:])
    while len(waiting) > 1:
        close()
    return _WRITTEN_FENCE.sub(lambda m: m[1] or "\n\n", "".join(waiting[0].parts)).strip("\n")


@F.pandas_udf(StringType())
def markdown_components(texts: pd.Series) -> pd.Series:
    """``plain_markdown`` over Arrow batches."""
    return texts.map(plain_markdown, na_action="ignore")


# Marks of emphasis and what they become.
EMPHASIS = {"**": "strong", "__": "strong", "*": "em", "_": "em"}
_INLINE = re.compile(r"(?P<tick>`+)(?P<code>.+?)(?P=tick)|(?P<image>!?)\[(?P<words>[^\]]*)\]\((?P<target>[^)\s]*)[^)]*\)|\\(?P<sign>[!-/:-@\[-`{-~])|(?<!\w)(?P<mark>\*\*|__|\*|_)(?P<stressed>\S(?:.*?\S)?)(?P=mark)(?!\w)")
_ITEM = re.compile(r"^\s{0,3}(?:([-*+])|\d{1,9}[.)])\s+(.*)$")
_HEADING = re.compile(r"^ {0,3}(#{1,6})\s+(.*?)\s*#*$")
_RULE = re.compile(r"^ {0,3}(?:(?:-\s*){3,}|(?:\*\s*){3,}|(?:_\s*){3,})$")


def _inline(text: str) -> str:
    out, at = [], 0
    for found in _INLINE.finditer(text):
        out.append(escape(text[at : found.start()], quote=False))
        at = found.end()
        if found["code"] is not None:
            out.append(f"<code>{escape(found['code'].strip(), quote=False)}</code>")
        elif found["target"] is not None:
            target, words = escape(found["target"]), found["words"]
            out.append(f'<img alt="{escape(words)}" src="{target}">' if found["image"] else f'<a href="{target}">{escape(words, quote=False)}</a>')
        elif found["sign"]:
            out.append(escape(found["sign"], quote=False))
        else:
            tag = EMPHASIS[found["mark"]]
            out.append(f"<{tag}>{escape(found['stressed'], quote=False)}</{tag}>")
    return "".join([*out, escape(text[at:], quote=False)])


def _blocks(lines: list[str]) -> Iterator[tuple[str, list[str], str]]:
    """(kind, lines, argument) of the blocks on one level."""
    at = 0
    while at < len(lines):
        line = lines[at]
        start = at
        if fence := re.match(r"^[ \t]*(`{3,})\s*(\S*)", line):
            at += 1
            while at < len(lines) and not lines[at].strip().startswith(fence[1]):
                at += 1
            yield "code", lines[start + 1 : at], fence[2]
            at += 1
        elif not line.strip():
            at += 1
        elif heading := _HEADING.match(line):
            yield "heading", [heading[2]], str(len(heading[1]))
            at += 1
        elif _RULE.match(line):
            yield "rule", [], ""
            at += 1
        elif line.lstrip().startswith(">"):
            while at < len(lines) and lines[at].lstrip().startswith(">"):
                at += 1
            yield "quote", [re.sub(r"^\s*> ?", "", x) for x in lines[start:at]], ""
        elif item := _ITEM.match(line):
            tag, items = ("ul" if item[1] else "ol"), []
            while at < len(lines) and ((found := _ITEM.match(lines[at])) or lines[at].strip() and lines[at].startswith("  ")):
                if found and bool(found[1]) != (tag == "ul"):
                    break
                if found:
                    items.append(found[2])
                else:
                    items[-1] += " " + lines[at].strip()
                at += 1
            yield tag, items, ""
        else:
            while at < len(lines) and lines[at].strip() and (at == start or not re.match(r"^\s*(?:>|`{3,}|#{1,6}\s)", lines[at]) and not _ITEM.match(lines[at])):
                at += 1
            yield "p", lines[start:at], ""


def markdown_html(text: str | None) -> str | None:
    """Plain markdown as HTML: headings, paragraphs, quotes, lists of one level, code, rules, emphasis, links and images; everything else is escaped text."""
    if text is None:
        return None
    out: list[str] = []
    # Quotes hold blocks again: what follows them waits on a stack.
    waiting: list[Iterator[tuple[str, list[str], str]] | str] = [_blocks(text.split("\n"))]
    while waiting:
        top = waiting[-1]
        if isinstance(top, str):
            out.append(waiting.pop())
            continue
        block = next(top, None)
        if block is None:
            waiting.pop()
            continue
        kind, lines, argument = block
        if kind == "quote":
            out.append("<blockquote>")
            waiting += ["</blockquote>", _blocks(lines)]
        elif kind == "code":
            name = f' class="language-{escape(argument)}"' if argument else ""
            out.append(f"<pre><code{name}>{escape(chr(10).join([*lines, '']), quote=False)}</code></pre>")
        elif kind == "heading":
            out.append(f"<h{argument}>{_inline(lines[0])}</h{argument}>")
        elif kind == "rule":
            out.append("<hr>")
        elif kind == "p":
            out.append(f"<p>{_inline(chr(10).join(x.strip() for x in lines))}</p>")
        else:
            out.append(f"<{kind}>{''.join(f'<li>{_inline(x)}</li>' for x in lines)}</{kind}>")
    return "\n".join(out)


@F.pandas_udf(StringType())
def markdown_page(texts: pd.Series) -> pd.Series:
    """Extended markdown as HTML, over Arrow batches."""
    return texts.map(lambda t: markdown_html(plain_markdown(t)), na_action="ignore")
