"""Strings and comments of Rust and TypeScript sources, blanked out.

What is left is code at its own place: a declaration, brace or semicolon that
is found in it is one.
"""

from __future__ import annotations

import re

_START = {
    "rust": re.compile(r"""//[^\n]*|/\*|\bb?r(?P<hashes>#*)"|"|'(?:\\[^\n']+|\\'|[^\\'\n])'"""),
    "typescript": re.compile(r"""//[^\n]*|/\*|"|'|`|(?<=[=(,:;!&|?\[])[ \t]*/(?![/*])(?:\\.|\[(?:\\.|[^\]\n\\])*\]|[^/\n\\\[])+/"""),
}
#: The rest of a string after its opening quote; one that is not closed ends with
#: the line, but in Rust, where strings have several lines, with the file.
_REST = {
    ("rust", '"'): re.compile(r'(?:\\.|[^"\\])*"?', re.S),
    ("typescript", '"'): re.compile(r'(?:\\.|[^"\\\n])*"?', re.S),
    ("typescript", "'"): re.compile(r"(?:\\.|[^'\\\n])*'?", re.S),
}
_COMMENT = re.compile(r"/\*|\*/")


def _comment_end(source: str, at: int, nested: bool) -> int:
    depth = 1
    for m in _COMMENT.finditer(source, at):
        if m[0] == "*/":
            depth -= 1
        elif nested:
            depth += 1
        if not depth:
            return m.end()
    return len(source)


def _template_end(source: str, at: int) -> int:
    """End of a template literal; the code of ``${}`` may hold strings and templates."""
    while at < len(source):
        if source[at] == "\\":
            at += 2
        elif source[at] == "`":
            return at + 1
        elif not source.startswith("${", at):
            at += 1
        else:
            at, depth = at + 2, 1
            while at < len(source) and depth:
                c = source[at]
                depth += (c == "{") - (c == "}")
                at += 1
                if c == "`":
                    at = _template_end(source, at)
                elif c in "'\"":
                    at = _REST["typescript", c].match(source, at).end()
    return len(source)


def code_of(language: str, source: str) -> tuple[str, list[tuple[int, int]]]:
    """``source`` with comments and the contents of strings as spaces (line ends and
    the outer marks of strings stay), and the spans of its strings."""
    out, strings, at = [], [], 0
    while m := _START[language].search(source, at):
        opening = m[0]
        comment = opening.startswith(("//", "/*"))
        if opening == "/*":
            end = _comment_end(source, m.end(), language == "rust")
        elif opening == "`":
            end = _template_end(source, m.end())
        elif opening in "\"'":
            end = _REST[language, opening].match(source, m.end()).end()
        elif language == "rust" and opening.endswith('"'):
            closing = '"' + m["hashes"]
            found = source.find(closing, m.end())
            end = len(source) if found < 0 else found + len(closing)
        else:
            end = m.end()  # a line comment, a character or a regular expression
        text = source[m.start() : end]
        blank = re.sub(r"[^\n]", " ", text)
        if not comment:
            strings.append((m.start(), end))
            if len(text) > 1:
                blank = text[0] + blank[1:-1] + text[-1]
        out += [source[at : m.start()], blank]
        at = end
    return "".join([*out, source[at:]]), strings
