"""URL patterns as Python's ``re`` reads them, in the dialect of Spark's regular expressions.

The two dialects agree on most of the syntax.  Translated are: names of groups, classes of Unicode characters
and word bounds, what ends a line, repetitions without a lower bound, character escapes, and
brackets inside classes, which Java takes for nested classes.
"""

from __future__ import annotations

import re
import unicodedata
import warnings

# The classes of the one dialect in terms of the other, each for use inside brackets.
_UNICODE = {"w": r"\p{L}\p{N}_", "d": r"\p{Nd}", "s": r"\s\x1c-\x1f\x85\p{Z}"}
_ASCII = {"w": "a-zA-Z0-9_", "d": "0-9", "s": r" \t\n\r\f\x0b"}
_CONTROL = {"a": r"\x07", "b": r"\x08", "f": r"\x0c", "n": r"\n", "r": r"\r", "t": r"\t", "v": r"\x0b"}
_DIGITS = {"x": 2, "u": 4, "U": 8}
_FLAGS = re.compile(r"\(\?([aiLmsux]*)(?:-([imsx]+))?(:|\))")


class PatternError(ValueError):
    """A pattern that is no regular expression, or one with a part that Spark has nothing for."""


class _Translator:
    def __init__(self, pattern: str):
        self.text, self.at, self.out = pattern, 0, []
        self.names: dict[str, str] = {}
        with warnings.catch_warnings():
            warnings.simplefilter("ignore", FutureWarning)  # of brackets that may mean something else one day
            compiled = re.compile(pattern)
        self.ascii = bool(compiled.flags & re.ASCII)
        self.verbose = bool(compiled.flags & re.VERBOSE)
        self.flags = "".join(letter for letter, flag in (("i", re.IGNORECASE), ("m", re.MULTILINE), ("s", re.DOTALL)) if compiled.flags & flag)
        self.classes = _ASCII if self.ascii else _UNICODE

    def _character(self, code: int) -> str:
        return f"\\x{{{code:x}}}"

    def _escape(self, inside: bool) -> None:
        """The escape after a backslash."""
        c = self.text[self.at + 1]
        rest = self.text[self.at + 2 :]
        step = 2
        if c.lower() in "wds":
            members = self.classes[c.lower()]
            negated = c.isupper()
            self.out.append(f"[^{members}]" if negated else members if inside else f"[{members}]")
        elif c in "bB" and not inside:
            word = f"[{self.classes['w']}]"
            same, other = (f"(?<={word})(?!{word})", f"(?<!{word})(?={word})") if c == "b" else (f"(?<={word})(?={word})", f"(?<!{word})(?!{word})")
            self.out.append(f"(?:{same}|{other})")
        elif c == "A" and not inside:
            self.out.append(r"\A")
        elif c == "Z" and not inside:
            self.out.append(r"\z")
        elif c in _CONTROL:
            self.out.append(_CONTROL[c])
        elif c in _DIGITS:
            step += _DIGITS[c]
            self.out.append(self._character(int(rest[: _DIGITS[c]], 16)))
        elif c == "N":
            name = rest[1 : rest.index("}")]
            step += len(name) + 2
            self.out.append(self._character(ord(unicodedata.lookup(name))))
        elif c.isdigit():
            octal = re.match(r"0[0-7]{0,2}|[0-3][0-7]{2}", c + rest)
            if octal or inside:
                digits = (octal or re.match(r"[0-7]{1,3}", c + rest))[0]
                step = 1 + len(digits)
                self.out.append(self._character(int(digits, 8)))
            else:
                number = re.match(r"\d{1,2}", c + rest)[0]
                step = 1 + len(number)
                self.out.append(f"(?:\\{number})")  # a digit may follow
        else:
            self.out.append(f"\\{c}" if c.isascii() else c)
        self.at += step

    def _class(self) -> None:
        """A bracket expression; the first ``]`` in it is a member."""
        text, out = self.text, self.out
        self.at += 1
        if text[self.at] == "^":
            out.append("[^")
            self.at += 1
        else:
            out.append("[")
        first = True
        while text[self.at] != "]" or first:
            c = text[self.at]
            if c == "\\":
                self._escape(inside=True)
            else:
                out.append(f"\\{c}" if c in "[]&^ #" else c)
                self.at += 1
            first = False
        out.append("]")
        self.at += 1

    def _group(self) -> None:
        """An opening parenthesis and what tells its kind."""
        text = self.text[self.at :]
        if m := re.match(r"\(\?P<(\w+)>", text):
            # Java has letters and digits only in names
            self.names[m[1]] = f"g{len(self.names)}"
            self.out.append(f"(?<{self.names[m[1]]}>")
        elif m := re.match(r"\(\?P=(\w+)\)", text):
            self.out.append(f"\\k<{self.names[m[1]]}>")
        elif m := re.match(r"\(\?#[^)]*\)", text):
            pass
        elif text.startswith("(?("):
            raise PatternError("a condition on a group")
        elif (m := _FLAGS.match(text)) and m[3] == ")":
            pass  # flags of the whole pattern stand in front of it
        elif m and not text.startswith("(?:"):
            if set(m[1] + (m[2] or "")) & set("aLux"):
                raise PatternError("a change of the flags a, L, u or x within the pattern")
            self.out.append(m[0])
        else:
            m = re.match(r"\((?:\?(?:<?[=!]|[:>]))?", text)
            self.out.append(m[0])
        self.at += m.end()

    def translated(self) -> str:
        text = self.text
        while self.at < len(text):
            c = text[self.at]
            if c == "\\":
                self._escape(inside=False)
            elif c == "[":
                self._class()
            elif c == "(":
                self._group()
            elif c == "{":
                m = re.match(r"\{(\d*)(,?)(\d*)\}", text[self.at :])
                if m and (m[1] or m[3] or m[2]):
                    self.out.append("{" + (m[1] or "0") + m[2] + m[3] + "}")
                    self.at += m.end()
                else:  # no repetition
                    self.out.append(r"\{")
                    self.at += 1
            elif c == "}":
                self.out.append(r"\}")
                self.at += 1
            elif self.verbose and c.isspace():
                self.at += 1
            elif self.verbose and c == "#":
                self.at = (text + "\n").index("\n", self.at)
            else:
                self.out.append(c)
                self.at += 1
        # d: only \n ends a line; u: letters of all scripts have a case
        return f"(?d{'' if self.ascii else 'u'}{self.flags})" + "".join(self.out)


def spark_regex(pattern: str) -> str:
    """The pattern for ``rlike``: found in a text if and only if ``re.search`` finds it there."""
    try:
        return _Translator(pattern).translated()
    except re.error as err:
        raise PatternError(str(err)) from err
