"""Catalog patterns in the engine's own regex dialect.

Catalogs are written for case-insensitive scripts' regular expressions without
the Unicode flag: letters fold only within ASCII unless they are written outside
of it, an escaped letter without meaning is that letter, a brace that is no
quantifier is a brace, ``[^]`` is any character and ``[]`` none. :func:`translate`
reads such a pattern once and writes what the engine needs; a pattern that is not
valid in the catalog's dialect is reported, never run.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

#: Characters that white space stands for in catalogs beyond the engine's own.
_MORE_SPACE = r"\s\x0B\xA0\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}"
_SPACE, _NO_SPACE = f"[{_MORE_SPACE}]", f"[^{_MORE_SPACE}]"
_EDGE, _NO_EDGE = r"(?:(?<=\w)(?!\w)|(?<!\w)(?=\w))", r"(?:(?<=\w)(?=\w)|(?<!\w)(?!\w))"
_QUANTIFIER = re.compile(r"\{(\d+)(?:,(\d*))?\}")
_NAME = re.compile(r"[A-Za-z_$][\w$]*")


@dataclass(frozen=True)
class Translated:
    """The engine's pattern, the number of its groups, or the problem with the catalog's."""

    pattern: str | None
    groups: int = 0
    problem: str | None = None


class PatternError(ValueError):
    pass


def _literal(c: str) -> str:
    """A character that stands for itself."""
    if c.isalnum() or c == "_" or c == " " or (not c.isascii() and c.isprintable()):
        return c
    return "\\" + c if c.isprintable() and c.isascii() else f"\\x{{{ord(c):X}}}"


class _Reader:
    def __init__(self, text: str) -> None:
        self.text, self.at, self.out, self.depth = text, 0, [], []
        self.groups, self.names = self._count()

    def _count(self) -> tuple[int, dict[str, int]]:
        n, names, at, inside = 0, {}, 0, False
        while at < len(self.text):
            c = self.text[at]
            if c == "\\":
                at += 2
                continue
            if inside:
                inside = c != "]"
            elif c == "[":
                inside = True
            elif c == "(":
                named = re.compile(r"\(\?<([^>=!][^>]*)>").match(self.text, at)
                if named:
                    if not _NAME.fullmatch(named[1]) or named[1] in names:
                        raise PatternError("bad group name")
                    names[named[1]] = n + 1
                if named or not self.text.startswith("(?", at):
                    n += 1
            at += 1
        return n, names

    def peek(self, n: int = 1) -> str:
        return self.text[self.at : self.at + n]

    def escape(self, in_class: bool) -> tuple[str, int | None]:
        """The engine's form of the escape at hand, and its code point if it is one character."""
        self.at += 1
        c = self.peek()
        if not c:
            raise PatternError("ends in a backslash")
        self.at += 1
        if c in "dDwW":
            return f"\\{c}", None
        if c in "sS":
            return ((_MORE_SPACE if c == "s" else _NO_SPACE) if in_class else _SPACE if c == "s" else _NO_SPACE), None
        if c == "b" and not in_class:
            return _EDGE, None
        if c == "B" and not in_class:
            return _NO_EDGE, None
        plain = {"b": 8, "f": 12, "n": 10, "r": 13, "t": 9, "v": 11}.get(c)
        if plain is not None:
            return f"\\x{{{plain:X}}}", plain
        for lead, size in (("x", 2), ("u", 4)):
            digits = self.peek(size)
            if c == lead and re.fullmatch(f"[0-9A-Fa-f]{{{size}}}", digits):
                self.at += size
                return f"\\x{{{int(digits, 16):X}}}", int(digits, 16)
        if c == "c" and re.fullmatch("[A-Za-z]", self.peek()):
            code = ord(self.peek()) % 32
            self.at += 1
            return f"\\x{{{code:X}}}", code
        if c == "c":  # no control character: the backslash stands for itself
            self.at -= 1
            return r"\\", ord("\\")
        if c == "k" and self.names and not in_class:
            name = re.compile(r"<([^>]*)>").match(self.text, self.at)
            if not name or name[1] not in self.names:
                raise PatternError("reference to no group")
            self.at = name.end()
            return f"(?:\\{self.names[name[1]]})", None
        if c.isdigit() and c.isascii():
            number = re.compile(r"[1-9]\d*").match(self.text, self.at - 1)
            if number and not in_class and int(number[0]) <= self.groups:
                self.at = number.end()
                return f"(?:\\{number[0]})", None
            octal = re.compile(r"[0-3][0-7]{0,2}|[4-7][0-7]?").match(self.text, self.at - 1)
            if octal:
                self.at = octal.end()
                return f"\\x{{{int(octal[0], 8):X}}}", int(octal[0], 8)
        return _literal(c), ord(c)

    def char_class(self) -> str:
        self.at += 1
        negated = self.peek() == "^"
        self.at += negated
        parts: list[tuple[str, int | None]] = []
        while self.peek() != "]":
            c = self.peek()
            if not c:
                raise PatternError("class without end")
            if c == "\\":
                item = self.escape(True)
            else:
                self.at += 1
                item = (_literal(c), ord(c))
            if len(parts) >= 2 and parts[-1] == ("-", None) and parts[-2][1] is not None and item[1] is not None:
                low = parts[-2][1]
                if low > item[1]:
                    raise PatternError("range out of order")
                parts[-2:] = [(f"{parts[-2][0]}-{item[0]}", None)]
                parts.append(("", None))
            elif c == "-" and parts and parts[-1] != ("-", None):
                parts.append(("-", None))
            else:
                parts.append(item)
        self.at += 1
        body = "".join(r"\-" if p == "-" else p for p, _ in parts)
        if not body:
            return r"[\s\S]" if negated else r"(?!)"
        text = f"[{'^' if negated else ''}{body}]"
        return text if text.isascii() else f"(?u:{text})"

    def read(self) -> str:
        quantifiable = False
        while self.at < len(self.text):
            c = self.peek()
            quantifier = _QUANTIFIER.match(self.text, self.at)
            if c in "*+?" or quantifier:
                if not quantifiable:
                    raise PatternError("nothing to repeat")
                if quantifier and quantifier[2] and int(quantifier[2]) < int(quantifier[1]):
                    raise PatternError("repetition out of order")
                if quantifier and max(int(x) for x in quantifier.groups() if x) > 1 << 30:
                    raise PatternError("too many repetitions")
                self.out.append(quantifier[0] if quantifier else c)
                self.at += len(quantifier[0]) if quantifier else 1
                if self.peek() == "?":
                    self.out.append("?")
                    self.at += 1
                quantifiable = False
                continue
            quantifiable = True
            if c == "\\":
                text, _ = self.escape(False)
                self.out.append(text)
                quantifiable = text not in (_EDGE, _NO_EDGE)
            elif c == "[":
                self.out.append(self.char_class())
            elif c == "(":
                head = re.compile(r"\((\?(?::|=|!|<=|<!|<[^>]*>))?").match(self.text, self.at)[0]
                if head == "(" and self.peek(2) == "(?":
                    raise PatternError("unknown kind of group")
                self.depth.append(head)
                self.out.append("(" if re.match(r"\(\?<[^=!]", head) else head)
                self.at += len(head)
                quantifiable = False
            elif c == ")":
                if not self.depth:
                    raise PatternError("group without start")
                quantifiable = self.depth.pop() not in ("(?<=", "(?<!")
                self.out.append(")")
                self.at += 1
            elif c in "^$":
                self.out.append(r"\A" if c == "^" else r"\z")
                self.at += 1
                quantifiable = False
            elif c == "|":
                self.out.append("|")
                self.at += 1
                quantifiable = False
            elif c == ".":
                self.out.append(r"[^\n\r\x{2028}\x{2029}]")
                self.at += 1
            else:
                self.out.append(_literal(c) if c.isascii() else f"(?u:{_literal(c)})")
                self.at += 1
        if self.depth:
            raise PatternError("group without end")
        return "(?i)" + "".join(self.out)


def translate(pattern: str) -> Translated:
    """A catalog pattern for the engine, or why it is none."""
    try:
        reader = _Reader(pattern)
        return Translated(reader.read(), reader.groups)
    except PatternError as problem:
        return Translated(None, 0, str(problem))


def engine_refuses(spark, patterns: list[str]) -> set[str]:
    """Those of the translated patterns that the engine cannot compile (long look-behinds, sizes beyond its limits).

    Many are compiled at once, and a set that fails is halved until the culprits stand alone.
    """
    compiler, bad = spark._jvm.java.util.regex.Pattern, set()
    todo = [patterns[i : i + 256] for i in range(0, len(patterns), 256)]
    while todo:
        part = todo.pop()
        try:
            compiler.compile("|".join(f"(?:{p})" for p in part) if len(part) > 1 else part[0])
        except Exception:  # the JVM's own exception, or its stack running out
            if len(part) == 1:
                bad.add(part[0])
            else:
                todo += [part[: len(part) // 2], part[len(part) // 2 :]]
    return bad
