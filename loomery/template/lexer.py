"""Templates to tokens."""

from __future__ import annotations

import re
from dataclasses import dataclass

from .values import TemplateError


@dataclass(frozen=True)
class Token:
    kind: str  # text, open, close, name, string, number, op, end
    value: str
    at: int


_OPEN = re.compile(r"\{([{%#])(-?)")
_CODE = re.compile(
    r"""(?P<space>\s+)
      | (?P<long>'''(?:[^\\]|\\.)*?''')
      | (?P<string>'(?:[^'\\]|\\.)*'|"(?:[^"\\]|\\.)*")
      | (?P<number>\d+(?:\.\d+)?)
      | (?P<name>[A-Za-z_][A-Za-z_0-9]*)
      | (?P<op>\*\*|==|!=|<=|>=|[-+*/~|.,:()\[\]{}=<>%])""",
    re.X | re.S,
)
_ESCAPES = {"n": "\n", "t": "\t", "r": "\r"}


def place(source: str, at: int) -> str:
    return f"{source.count(chr(10), 0, at) + 1}:{at - source.rfind(chr(10), 0, at)}"


def _unquote(s: str) -> str:
    return re.sub(r"\\(.)", lambda m: _ESCAPES.get(m[1], m[1]), s, flags=re.S)


def lex(source: str, name: str = "template") -> list[Token]:
    """All tokens; comments are gone, and white space is trimmed where a tag has a dash on that side."""
    out: list[Token] = []
    at, trim = 0, False

    def fail(what: str, where: int) -> TemplateError:
        return TemplateError(f"{name}:{place(source, where)}: {what}")

    def add_text(s: str, where: int, trim_end: bool) -> None:
        s = s.lstrip() if trim else s
        s = s.rstrip() if trim_end else s
        if s:
            out.append(Token("text", s, where))

    while True:
        m = _OPEN.search(source, at)
        if m is None:
            add_text(source[at:], at, False)
            out.append(Token("end", "", len(source)))
            return out
        sign, dash = m[1], bool(m[2])
        add_text(source[at : m.start()], at, dash)
        at = m.end()
        if sign == "#":
            stop = source.find("#}", at)
            if stop < 0:
                raise fail("a comment isn't closed", m.start())
            trim = source[stop - 1] == "-" and stop > at
            at = stop + 2
            continue
        close = "}}" if sign == "{" else "%}"
        out.append(Token("open", sign, m.start()))
        depth = 0
        while True:
            rest = source[at : at + 3]
            if not depth and (rest.startswith(close) or rest == "-" + close):
                trim = rest[0] == "-"
                at += len(close) + trim
                out.append(Token("close", close, at))
                break
            t = _CODE.match(source, at)
            if t is None:
                raise fail("a tag isn't closed" if at >= len(source) else f"unexpected {source[at]!r}", at)
            kind, s = t.lastgroup, t[0]
            if kind == "long":
                out.append(Token("string", _unquote(s[3:-3]), at))
            elif kind == "string":
                out.append(Token("string", _unquote(s[1:-1]), at))
            elif kind != "space":
                depth += (s in "([{") - (s in ")]}") if kind == "op" else 0
                out.append(Token(kind, s, at))
            at = t.end()
