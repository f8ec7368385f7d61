"""Tokens of the dialect."""

from __future__ import annotations

import re
from dataclasses import dataclass

from ..errors import InvalidArgument


@dataclass(frozen=True)
class Token:
    kind: str  # name, quoted, int, float, string, bytes, param, op, end
    text: str
    value: object = None
    at: int = 0

    @property
    def up(self) -> str:
        return self.text.upper() if self.kind == "name" else ""


_SPACE = re.compile(r"(?:\s+|--[^\n]*|#[^\n]*|/\*.*?\*/)+", re.S)
_HINT = re.compile(r"@\{[^}]*\}")
_NUMBER = re.compile(r"0[xX][0-9a-fA-F]+|(?:\d+\.\d*|\.\d+|\d+)(?:[eE][+-]?\d+)?")
_NAME = re.compile(r"[A-Za-z_][A-Za-z_0-9]*")
_STRING = re.compile(r"""([rRbB]{0,2})('''|\"\"\"|'|")""")
_OPS = ("=>", "<=", ">=", "!=", "<>", "||", "(", ")", "[", "]", "{", "}", ",", ".", ";", "+", "-", "*", "/", "%", "<", ">", "=", ":")
_ESCAPES = {"n": "\n", "t": "\t", "r": "\r", "b": "\b", "f": "\f", "v": "\v", "a": "\a", "0": "\0"}


def _unescape(body: str, is_bytes: bool):
    out = bytearray() if is_bytes else []

    def put(code: int):
        if is_bytes:
            out.extend(bytes([code]) if code < 256 else chr(code).encode())
        else:
            out.append(chr(code))

    i = 0
    while i < len(body):
        c = body[i]
        if c != "\\":
            if is_bytes:
                out.extend(c.encode())
            else:
                out.append(c)
            i += 1
            continue
        e = body[i + 1 : i + 2]
        if e in "xX" and (m := re.match(r"[0-9a-fA-F]{2}", body[i + 2 :])):
            put(int(m[0], 16))
            i += 4
        elif e in "uU" and e and (m := re.match(r"[0-9a-fA-F]{%d}" % (4 if e == "u" else 8), body[i + 2 :])):
            put(int(m[0], 16))
            i += 2 + len(m[0])
        elif m := re.match(r"[0-7]{3}", body[i + 1 :]):
            put(int(m[0], 8))
            i += 4
        else:
            put(ord(_ESCAPES.get(e, e or "\\")))
            i += 2
    return bytes(out) if is_bytes else "".join(out)


def tokens(sql: str) -> list[Token]:
    out, i = [], 0
    while i < len(sql):
        if m := _SPACE.match(sql, i) or _HINT.match(sql, i):
            i = m.end()
            continue
        if (m := _STRING.match(sql, i)) and m[1].lower() in ("", "r", "b", "rb", "br"):
            quote, at = m[2], m.end()
            while True:
                end = sql.find(quote, at)
                if end < 0:
                    raise InvalidArgument(f"unclosed string at {i}")
                back = 0
                while sql[end - 1 - back] == "\\" and end - 1 - back >= m.end():
                    back += 1
                if back % 2 == 0:
                    break
                at = end + 1
            body, flags = sql[m.end() : end], m[1].lower()
            if "r" in flags:
                value = body.encode() if "b" in flags else body
            else:
                value = _unescape(body, "b" in flags)
            out.append(Token("bytes" if "b" in flags else "string", body, value, i))
            i = end + len(quote)
        elif sql[i] == "`":
            end = sql.find("`", i + 1)
            if end < 0:
                raise InvalidArgument(f"unclosed identifier at {i}")
            out.append(Token("quoted", sql[i + 1 : end], None, i))
            i = end + 1
        elif sql[i] == "@" and (m := _NAME.match(sql, i + 1)):
            out.append(Token("param", m[0], None, i))
            i = m.end()
        elif m := _NAME.match(sql, i):
            out.append(Token("name", m[0], None, i))
            i = m.end()
        elif (sql[i].isdigit() or sql[i] == "." and sql[i + 1 : i + 2].isdigit()) and (m := _NUMBER.match(sql, i)):
            t = m[0]
            whole = t[:2].lower() == "0x" or t.isdigit()
            out.append(Token("int" if whole else "float", t, int(t, 0 if t[:2].lower() == "0x" else 10) if whole else float(t), i))
            i = m.end()
        else:
            for op in _OPS:
                if sql.startswith(op, i):
                    out.append(Token("op", op, None, i))
                    i += len(op)
                    break
            else:
                raise InvalidArgument(f"unexpected character {sql[i]!r} at {i}")
    return [*out, Token("end", "", None, len(sql))]
