"""Markdown structure of one text: plain Python, called in Arrow batches.

Lines are split at ``\\n``. Fences follow CommonMark: a run of three or more
backticks or tildes, at most three columns past the content column of the list
item around it; the closing run is at least as long and of the same kind.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

_FENCE = re.compile(r"(`{3,}|~{3,})(.*)\Z", re.S)
_ITEM = re.compile(r"([-*+]|\d{1,9}[.)])( +|\t|\Z)")
_HEADING = re.compile(r" {0,3}(#{1,6})(?:[ \t]+(.*?))?(?:[ \t]+#+)?[ \t]*\r?\Z", re.S)
_BLOCK_ID = re.compile(r"(.*?)\s*\{#([^\s}]+)\}\s*\Z", re.S)


def columns(line: str) -> tuple[int, int]:
    """Width of the leading white space, tabs to multiples of four, and its length."""
    col = n = 0
    for c in line:
        if c == " ":
            col += 1
        elif c == "\t":
            col += 4 - col % 4
        else:
            break
        n += 1
    return col, n


@dataclass
class Fence:
    mark: str
    length: int
    container: int
    info: str
    line: int


@dataclass
class LineState:
    """Follows fences, list items and comments from line to line."""

    fence: Fence | None = None
    items: list[int] = field(default_factory=list)
    comment: bool = False

    def feed(self, line: str, number: int = 0) -> str:
        """``outside``, ``open``, ``inside``, ``close`` or ``comment``."""
        col, n = columns(line)
        rest = line[n:].rstrip("\r")
        if self.fence:
            if rest and col < self.fence.container:  # the list item ended, and its block with it
                self.fence = None
            else:
                m = _FENCE.match(rest)
                if m and m[1][0] == self.fence.mark and len(m[1]) >= self.fence.length and not m[2].strip() and col - self.fence.container <= 3:
                    self.fence = None
                    return "close"
                return "inside"
        if self.comment:
            self.comment = "-->" not in line
            return "comment"
        if not rest:
            return "outside"
        while self.items and col < self.items[-1]:
            self.items.pop()
        while m := _ITEM.match(rest):
            if col - (self.items[-1] if self.items else 0) > 3:
                break
            gap = len(m[2].expandtabs(4)) or 1
            self.items.append(col + len(m[1]) + (gap if gap <= 4 else 1))
            col, rest = self.items[-1], rest[m.end() :].lstrip(" \t")
            if not rest:
                return "outside"
        container = self.items[-1] if self.items else 0
        m = _FENCE.match(rest)
        if m and 0 <= col - container <= 3 and not (m[1][0] == "`" and "`" in m[2]):
            self.fence = Fence(m[1][0], len(m[1]), container, m[2], number)
            return "open"
        if rest.startswith("<!--") and "-->" not in rest[4:]:
            self.comment = True
            return "comment"
        return "outside"


def headings(lines: list[str]) -> Iterator[tuple[int, int, str, str | None]]:
    """``(line, level, text, block id)`` of each heading outside fences and comments."""
    state = LineState()
    for i, line in enumerate(lines):
        if state.feed(line, i) != "outside":
            continue
        m = _HEADING.match(line)
        if m:
            text = (m[2] or "").strip()
            b = _BLOCK_ID.match(text)
            yield (i, len(m[1]), b[1], b[2]) if b else (i, len(m[1]), text, None)


def visible_lines(body: str) -> list[dict]:
    """``line, text`` of the lines that are neither code nor comment nor blank; a
    comment within a line goes from it."""
    state, out, comment = LineState(), [], False
    for i, line in enumerate(body.split("\n")):
        if comment:
            end = line.find("-->")
            if end < 0:
                continue
            comment, line = False, line[end + 3 :]
        while not state.fence and (start := line.find("<!--")) >= 0:
            end = line.find("-->", start + 4)
            comment = end < 0
            line = line[:start] + ("" if comment else line[end + 3 :])
        if state.feed(line, i) == "outside" and line.strip():
            out.append({"line": i, "text": line})
    return out


def slug(text: str) -> str:
    return re.sub(r"[^a-z0-9]+", "-", text.lower()).strip("-")


def sections(body: str) -> list[dict]:
    """Flattened sections in document order. ``content`` is the bytes between a
    heading's line and the next heading of any level."""
    lines = body.split("\n")
    found = list(headings(lines))
    starts, at = [], 0
    for line in lines:
        starts.append(at)
        at += len(line.encode("utf-8")) + 1
    total = max(at - 1, 0)
    out, stack = [], []
    for no, (i, level, text, block) in enumerate(found):
        while stack and stack[-1][0] >= level:
            stack.pop()
        parent = stack[-1][1] if stack else None
        nxt = found[no + 1][0] if no + 1 < len(found) else None
        end = (nxt - 1) if nxt is not None else len(lines) - 1
        content = "\n".join(lines[i + 1 : nxt]) + ("\n" if nxt is not None and nxt > i + 1 else "")
        path = [*(out[parent]["heading_path"] if parent is not None else []), text]
        stack.append((level, no))
        out.append(
            {
                "section_no": no, "parent_no": parent, "heading_path": path, "id": slug(text), "block_id": block, "heading": text, "level": level,
                "start_line": i, "end_line": end, "byte_start": starts[i],
                "byte_content": min(starts[i + 1], total) if i + 1 < len(lines) else total,
                "byte_end": starts[nxt] if nxt is not None else total, "content": content,
            }
        )
    for s in out:  # the last descendant: a subtree is an interval of section numbers
        s["last_no"] = s["section_no"]
    for s in reversed(out):
        if s["parent_no"] is not None:
            p = out[s["parent_no"]]
            p["last_no"] = max(p["last_no"], s["last_no"])
    return out


def preamble(body: str) -> str | None:
    """The trimmed text before the first heading, or None if blank."""
    lines = body.split("\n")
    first = next((h[0] for h in headings(lines)), len(lines))
    return "\n".join(lines[:first]).strip() or None


_SEPARATOR = re.compile(r"\s*\|?\s*:?-+:?\s*(?:\|\s*:?-+:?\s*)*\|?\s*\Z")


def cells(line: str) -> list[str]:
    """Cells of a row: unescaped pipes split, ``\\|`` is a pipe, an empty first and last one goes."""
    parts = [p.replace("\\|", "|").strip() for p in re.split(r"(?<!\\)\|", line.strip())]
    if parts and not parts[0]:
        parts = parts[1:]
    if parts and not parts[-1]:
        parts = parts[:-1]
    return parts


def tables(content: str) -> list[dict]:
    """Pipe tables: header and separator line, then rows to a blank line or one without pipe."""
    lines, out, i = content.split("\n"), [], 0
    while i + 1 < len(lines):
        if "|" not in lines[i] or not _SEPARATOR.match(lines[i + 1]):
            i += 1
            continue
        head, rows, j = cells(lines[i]), [], i + 2
        while j < len(lines) and lines[j].strip() and "|" in lines[j]:
            raw = cells(lines[j])
            rows.append({"line": j, "width": len(raw), "cells": (raw + [""] * len(head))[: len(head)]})
            j += 1
        out.append({"line": i, "headers": head, "rows": rows})
        i = j
    return out


_BULLET = re.compile(r"[-*+]\s+(.+)\Z", re.S)
_LIST = re.compile(r"(?:[-*+]|\d+[.)])\s+(.+)\Z", re.S)
_BOLD = {
    "bold_description": re.compile(r"\*\*(.+?)\*\*\s*[-–—]+\s*(.+)\Z", re.S),
    "bold_colon": re.compile(r"\*\*(.+?):?\*\*\s*:?\s*(.+)\Z", re.S),
}


def bullets(content: str, pattern: str = "plain") -> list[dict]:
    """Bullet items; a bold pattern falls back on the other, then on plain."""
    out = []
    order = [] if pattern == "plain" else [pattern, *(p for p in _BOLD if p != pattern)]
    for i, line in enumerate(content.split("\n")):
        m = _BULLET.match(line.strip())
        if not m:
            continue
        item = {"line": i, "raw": m[1], "title": m[1], "description": ""}
        for p in order:
            b = _BOLD[p].match(m[1])
            if b:
                item |= {"title": b[1], "description": b[2]}
                break
        out.append(item)
    return out


def list_items(content: str) -> list[dict]:
    """Bulleted and ordered items at any depth, outside fences."""
    state, out = LineState(), []
    for i, line in enumerate(content.split("\n")):
        if state.feed(line, i) == "outside" and (m := _LIST.match(line.strip())):
            out.append({"line": i, "raw": m[1], "title": m[1], "description": ""})
    return out


def code_blocks(content: str) -> list[dict]:
    """Fenced blocks with the nearest heading before them and an ``@type`` tag of
    their first line; an unclosed block counts unless it is empty."""
    state, out, block, near, where = LineState(), [], [], None, 0
    fence = None

    def emit() -> None:
        language = (fence.info.split() or [""])[0]
        tag = re.match(r"\s*(?:%%|//|#)?\s*@(\w[\w-]*)", block[0]) if block else None
        out.append({"index": len(out), "line": where + 1, "language": language, "source": "\n".join(block), "section": near, "tag": tag[1] if tag else None})

    for i, line in enumerate(content.split("\n")):
        kind = state.feed(line, i)
        if fence and kind not in ("inside", "close"):  # its list item ended
            emit()
            fence = None
        if kind == "open":
            fence, block, where = state.fence, [], i
        elif kind == "inside":
            block.append(line)
        elif kind == "close":
            emit()
            fence = None
        elif kind == "outside" and (m := _HEADING.match(line)):
            near = re.sub(r"\s*\{#[^\s}]+\}\s*\Z", "", (m[2] or "").strip())
    if fence and any(x.strip() for x in block):
        emit()
    return out
