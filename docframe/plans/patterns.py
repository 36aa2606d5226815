"""Regular expressions: linear-time syntax only, translated for Java and for Python.

A pattern is found anywhere in a string.  ``$`` is the end of the string, and with (?m) of a line;
lines end with a newline only; ``.`` is any character but a newline, and with (?s) that too.  Classes
like ``\\d`` and ``\\w`` are those of Unicode.  Flags i, m, s, x and u hold up to the end of their group.
Back references, look-arounds and possessive forms are refused.
"""

from __future__ import annotations

import re

from ..errors import QueryError

#: Bytes of a pattern at most.
LONGEST = 4096
#: What may stand behind a backslash: classes, places, characters by name.  Fixed by the syntax.
_KNOWN = set("dDwWsSbBAztnrfav") | set(r"\.+*?()|[]{}^$#&-~/'\" :;<>=!@%,_`")
#: Named classes inside brackets, in ASCII; fixed by the syntax.
_NAMED = {
    "alnum": "0-9A-Za-z", "alpha": "A-Za-z", "ascii": "\\x00-\\x7f", "blank": "\\t ", "cntrl": "\\x00-\\x1f\\x7f", "digit": "0-9", "graph": "!-~",
    "lower": "a-z", "print": " -~", "punct": "!-/:-@\\[-`{-~", "space": "\\t\\n\\x0b\\x0c\\r ", "upper": "A-Z", "word": "0-9A-Za-z_", "xdigit": "0-9A-Fa-f",
}


def _refuse(what: str) -> QueryError:
    return QueryError(f"not in a pattern: {what!r} (no back references, look-arounds or possessive forms)")


class _Reader:
    """Reads a pattern once and writes both translations."""

    def __init__(self, pattern: str):
        if len(pattern.encode("utf-8", "surrogatepass")) > LONGEST:
            raise QueryError(f"the pattern is over the limit of {LONGEST} bytes")
        self.text, self.at = pattern, 0
        self.java: list[str] = []
        self.python: list[str] = []
        # for each open group: its flags, and the flag groups opened inside it
        self.groups: list[tuple[frozenset, list[str]]] = []
        self.flags: frozenset = frozenset()
        self.inner: list[str] = []

    def both(self, x: str) -> None:
        self.java.append(x)
        self.python.append(x)

    def read(self) -> None:
        while self.at < len(self.text):
            c = self.text[self.at]
            if c == "\\":
                self._escape(False)
            elif c == "[":
                self._brackets()
            elif c == "(":
                self._open()
            elif c == ")":
                if not self.groups:
                    raise QueryError("not a pattern: a ) without its (")
                self.both(")" * (len(self.inner) + 1))
                self.flags, self.inner = self.groups.pop()
                self.at += 1
                self._repeat()
            elif c == "|":
                # flags go on behind the bar
                self.both(")" * len(self.inner) + "|" + "".join(self.inner))
                self.at += 1
            elif c == "$":
                multi = "m" in self.flags
                self.java.append("(?=\\n|\\z)" if multi else "\\z")
                self.python.append("(?=\\n|\\Z)" if multi else "\\Z")
                self.at += 1
            elif c == "#" and "x" in self.flags:
                end = self.text.find("\n", self.at)
                self.at = len(self.text) if end < 0 else end + 1
            elif c in " \t\n\r\f\v" and "x" in self.flags:
                self.at += 1
            elif c == "^":
                self.both("(?:\\A|(?<=\\n))" if "m" in self.flags else "\\A")
                self.at += 1
            elif c in "*+?{":
                raise QueryError(f"not a pattern: nothing to repeat at {self.text[self.at :]!r}")
            else:
                self.both("\\" + c if c in "]}#&~-" else c)
                self.at += 1
                self._repeat()
        if self.groups:
            raise QueryError("not a pattern: a ( without its )")
        self.both(")" * len(self.inner))

    def _repeat(self) -> None:
        """A repetition behind an atom, lazy or not."""
        if m := re.compile(r"(?:[*+?]|\{\d+(?:,\d*)?\})").match(self.text, self.at):
            self.at = m.end()
            lazy = self.text[self.at : self.at + 1]
            if lazy == "+":
                raise _refuse(m[0] + lazy)
            if lazy == "?":
                self.at += 1
            self.both(m[0] + ("?" if lazy == "?" else ""))
            if self.text[self.at : self.at + 1] in ("*", "+", "?") or re.compile(r"\{\d").match(self.text, self.at):
                raise QueryError(f"not a pattern: a repetition of a repetition at {self.text[self.at :]!r}")

    def _escape(self, inside: bool) -> None:
        m = re.compile(r"\\(?:[pP](?:[A-Za-z]|\{\^?[\w ]+(?:=[\w ]+)?\})|x(?:[0-9A-Fa-f]{2}|\{[0-9A-Fa-f]+\})|u(?:[0-9A-Fa-f]{4}|\{[0-9A-Fa-f]+\})|U[0-9A-Fa-f]{8}|.)", re.S).match(self.text, self.at)
        if not m:
            raise QueryError("not a pattern: a backslash at its end")
        found = m[0]
        self.at = m.end()
        kind = found[1]
        if kind in "pP" and len(found) > 2:
            name = found[2:].strip("{}")
            not_in = (kind == "P") != name.startswith("^")
            name = name.lstrip("^")
            name = name.partition("=")[2] or name
            if len(name) <= 2:
                self.java.append(f"\\{'P' if not_in else 'p'}{{{name}}}")
            else:
                self.java.append(f"\\{'P' if not_in else 'p'}{{Is{name.replace(' ', '')}}}")
            self.python.append(f"\\{'P' if not_in else 'p'}{{{name}}}")
        elif kind in "xuU" and len(found) > 2:
            code = int(found[2:].strip("{}"), 16)
            if code > 0x10FFFF:
                raise QueryError(f"not a pattern: {found!r}")
            self.java.append(f"\\x{{{code:x}}}")
            self.python.append(f"\\U{code:08x}")
        elif kind in "az" or kind == "A":
            self.java.append({"a": "\\x07", "z": "\\z", "A": "\\A"}[kind])
            self.python.append({"a": "\\x07", "z": "\\Z", "A": "\\A"}[kind])
        elif kind == "v":
            self.both("\\x0b")
        elif kind not in _KNOWN or inside and kind in "bBAz":
            raise _refuse(found)
        elif kind in "bB" and self.text[self.at : self.at + 1] == "{":
            raise _refuse(found + "{")
        else:
            self.both("\\" + kind if kind in "dDwWsSbBtnrf" or not (kind.isalnum() or kind in "<>'\" :;=!@%,_`/") else kind)
        if not inside and kind not in "bBAz":
            self._repeat()

    def _brackets(self) -> None:
        self.at += 1
        self.both("[")
        if self.text[self.at : self.at + 1] == "^":
            self.both("^")
            self.at += 1
        first = True
        while True:
            c = self.text[self.at : self.at + 1]
            if not c:
                raise QueryError("not a pattern: a [ without its ]")
            if c == "]" and not first:
                break
            first = False
            if c == "\\":
                self._escape(True)
                continue
            if m := re.compile(r"\[:(\^?)(\w+):\]").match(self.text, self.at):
                if m[1] or m[2] not in _NAMED:
                    raise _refuse(m[0])
                self.both(_NAMED[m[2]])
                self.at = m.end()
                continue
            if c == "[" or self.text[self.at : self.at + 2] in ("&&", "--", "~~", "||"):
                raise _refuse(self.text[self.at : self.at + 2])
            self.at += 1
            if "x" in self.flags and c in " \t\n\r\f\v":
                continue
            self.both("\\" + c if c in "]&^~|#" else c)
        self.at += 1
        self.both("]")
        self._repeat()

    def _open(self) -> None:
        rest = self.text[self.at :]
        if m := re.match(r"\(\?(?:P?<([A-Za-z_][\w.\[\]]*)>|([imsxu]*(?:-[imsxu]+)?)([:)]))", rest):
            if m[1] is not None:
                self._push("(?:", self.flags)
            else:
                on, _, off = m[2].partition("-")
                if "u" in off:
                    raise _refuse(m[0])
                if m[3] == ")" and not m[2]:
                    raise QueryError("not a pattern: flags without a letter")
                flags = (self.flags | set(on)) - set(off)
                opened = "(?:" if not m[2] else self._flagged(on, off)
                if m[3] == ":":
                    self._push(opened, flags)
                else:
                    self.flags = flags
                    self.inner.append(opened)
                    self.both(opened)
            self.at += m.end()
        elif rest.startswith("(?"):
            raise _refuse(rest[:3])
        else:
            self._push("(?:", self.flags)
            self.at += 1

    @staticmethod
    def _flagged(on: str, off: str) -> str:
        """What m and x do is written out; the others read alike in both."""
        on, off = "".join(sorted(set(on) & set("is"))), "".join(sorted(set(off) & set("is")))
        return f"(?{on}{'-' + off if off else ''}:" if on or off else "(?:"

    def _push(self, opened: str, flags: frozenset) -> None:
        self.both(opened)
        self.groups.append((self.flags, self.inner))
        self.flags, self.inner = frozenset(flags), []


def _read(pattern: str) -> _Reader:
    out = _Reader(pattern)
    out.read()
    return out


def java_pattern(pattern: str) -> str:
    """With Unicode classes and lines that end with a newline only."""
    return "(?Ud)" + "".join(_read(pattern).java)


def python_pattern(pattern: str) -> str:
    """For the module ``regex``."""
    import regex

    out = "".join(_read(pattern).python)
    try:
        regex.compile(out, regex.VERSION0)
    except regex.error as e:
        raise QueryError(f"not a pattern: {e}") from None
    return out


def found(pattern: str):
    """A function that tells whether the pattern is found in a string."""
    import regex

    search = regex.compile(python_pattern(pattern), regex.VERSION0).search
    return lambda text: search(text) is not None


def literal_prefix(pattern: str) -> str:
    """The plain text that every match at ``^`` begins with; "" if there is none."""
    if not pattern.startswith("^"):
        return ""
    m = re.match(r"\^((?:[\w \-/:,;@#%&~\"'=!<>]|\\[.\-/+*?()\[\]{}|^$\\])*)", pattern)
    body, rest = m[1], pattern[m.end() :]
    if rest[:1] in ("*", "?", "{"):
        # the last character may be repeated or left out
        body = re.sub(r"(\\.|.)\Z", "", body)
    if "|" in re.sub(r"\\.", "", pattern):
        return ""
    return re.sub(r"\\(.)", r"\1", body)
