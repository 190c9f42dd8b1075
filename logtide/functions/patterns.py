"""Globs and search patterns."""

from __future__ import annotations

import re

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

SPECIAL = r"*?[]{}\\"


def is_glob(name: str) -> bool:
    return any(c in SPECIAL for c in name)


def literal_prefix(glob: str) -> str:
    """What stands before the first special character; sources can filter on it."""
    return re.split(r"[*?\[\]{}\\]", glob, maxsplit=1)[0]


def glob_regex(glob: str) -> str:
    """A regular expression for the whole name; ``*`` and ``?`` match slashes too."""
    out, i, depth = [], 0, 0
    while i < len(glob):
        c = glob[i]
        if c == "*":
            out.append(".*")
        elif c == "?":
            out.append(".")
        elif c == "[":
            stop = glob.find("]", i + 2)
            if stop < 0:
                raise ValueError(f"{glob}: unclosed class")
            inner = glob[i + 1 : stop]
            negated = inner[:1] in ("!", "^")
            out.append(f"[{'^' if negated else ''}{re.sub(r'([\\\[\]&^])', r'\\\1', inner[negated:])}]")
            i = stop
        elif c == "{":
            depth += 1
            out.append("(?:")
        elif c == "}":
            if not depth:
                raise ValueError(f"{glob}: unopened alternatives")
            depth -= 1
            out.append(")")
        elif c == "," and depth:
            out.append("|")
        elif c == "\\":
            i += 1
            if i == len(glob):
                raise ValueError(f"{glob}: dangling escape")
            out.append(re.escape(glob[i]))
        else:
            out.append(re.escape(c))
        i += 1
    if depth:
        raise ValueError(f"{glob}: unclosed alternatives")
    return f"(?s)^{''.join(out)}\\z"


def matches(name: Column, selector: str | None) -> Column:
    """Exact name, glob, or all (None)."""
    if selector is None:
        return F.lit(True)
    if not is_glob(selector):
        return name == selector
    prefix = literal_prefix(selector)
    hit = name.rlike(glob_regex(selector))
    return name.startswith(prefix) & hit if prefix else hit


# The ASCII classes that stand in brackets, and flags.
POSIX = {
    "alnum": "0-9A-Za-z", "alpha": "A-Za-z", "ascii": r"\x00-\x7F", "blank": r"\t\x20", "cntrl": r"\x00-\x1F\x7F", "digit": "0-9", "graph": "!-~", "lower": "a-z",
    "print": r"\x20-~", "punct": r"!-/:-@\[-`{-~", "space": r"\t\n\x0B\f\r\x20", "upper": "A-Z", "word": "0-9A-Za-z_", "xdigit": "0-9A-Fa-f",
}
FLAGS = {"i": "i", "m": "m", "s": "s", "x": "x", "u": "U"}
ESCAPES = {"v": r"\x0B", "<": r"\b(?=\w)", ">": r"\b(?<=\w)"}
SAME_ESCAPES = "dDsSwWbBAzaftnr"
LINE_START = r"(?<![^\n])"
"""Java's own does not match behind a last line's end."""


def search_regex(pattern: str) -> str:
    """A pattern of linear-time engines for Java's.

    ``$`` is the end of the text, or of a line under ``(?m)``, and ``^`` the start, also of the empty line behind a last line's end; ``{,n}`` is ``{0,n}``; only \\n ends a line; \\d, \\w, \\s and \\b are those of Unicode; bracketed classes such as
    ``[:alpha:]`` are ASCII.  A ValueError names what such engines, or this translation, do not support: look-around, back-references,
    quantifiers of quantifiers, flags that swap greed, symmetric differences of classes.
    """
    out = "(?dU)" + _Pattern(pattern).translated()
    _compiled(out, pattern)
    return out


def _compiled(java: str, pattern: str) -> None:
    """Java's own opinion, where a session is at hand; without one the query tells."""
    session = SparkSession.getActiveSession()
    if session is not None and hasattr(session, "_jvm"):
        try:
            session._jvm.java.util.regex.Pattern.compile(java)
        except Exception as e:
            raise ValueError(f"{pattern}: {str(e).splitlines()[0]}") from e


class _Pattern:
    """One pass over a pattern: text, classes and groups, with the flag m in force in each group."""

    def __init__(self, text: str) -> None:
        self.text, self.at, self.lines = text, 0, [False]

    def fail(self, why: str) -> ValueError:
        return ValueError(f"{self.text}: {why} at {self.at}")

    def take(self, found: re.Match) -> re.Match:
        self.at = found.end()
        return found

    def next(self, regex: str) -> re.Match | None:
        found = re.compile(regex).match(self.text, self.at)
        return self.take(found) if found else None

    def translated(self) -> str:
        out, quantified = [], False
        while self.at < len(self.text):
            c = self.text[self.at]
            if found := self.next(r"[*+?]\??|\{\s*\d*\s*,?\s*\d*\s*\}\??"):
                if quantified:
                    raise self.fail("a quantifier of a quantifier")
                out.append(re.sub(r"\s", "", found[0]).replace("{,", "{0,"))
                quantified = True
                continue
            quantified = False
            if c == "\\":
                out.append(self.escape())
            elif c == "[":
                out.append(self.bracket())
            elif c == "(":
                out.append(self.group())
            elif c == ")":
                if len(self.lines) == 1:
                    raise self.fail("an unopened group")
                self.lines.pop()
                self.at += 1
                out.append(c)
            else:
                self.at += 1
                out.append(r"\z" if c == "$" and not self.lines[-1] else LINE_START if c == "^" and self.lines[-1] else c)
        if len(self.lines) > 1:
            raise self.fail("an unclosed group")
        return "".join(out)

    def group(self) -> str:
        if self.next(r"\(\?P?<[A-Za-z_][\w.\[\]]*>"):  # names are of no use in a search
            self.lines.append(self.lines[-1])
            return "("
        if found := self.next(r"\(\?([a-zA-Z]*)(?:-([a-zA-Z]+))?([:)])"):
            on, off = found[1], found[2] or ""
            if bad := set(on + off) - set(FLAGS):
                raise self.fail(f"the flag {min(bad)}")
            lines = "m" in on or (self.lines[-1] and "m" not in off)
            if found[3] == ":":
                self.lines.append(lines)
            else:
                self.lines[-1] = lines
            java = "".join(FLAGS[f] for f in on) + ("-" + "".join(FLAGS[f] for f in off) if off else "")
            return f"(?{java}{found[3]}" if java or found[3] == ":" else ""
        if self.text.startswith("(?", self.at):
            raise self.fail("look-around is not supported")
        self.at += 1
        self.lines.append(self.lines[-1])
        return "("

    def escape(self) -> str:
        if found := self.next(r"\\(?:x\{\s*([0-9A-Fa-f]+)\s*\}|[uU]\{\s*([0-9A-Fa-f]+)\s*\}|x([0-9A-Fa-f]{2})|u([0-9A-Fa-f]{4})|U([0-9A-Fa-f]{8}))"):
            return f"\\x{{{next(x for x in found.groups() if x)}}}"
        if found := self.next(r"\\([pP])(?:([A-Z])|\{(\^?)([\w =:-]+)\})"):
            kind, name = found[1], found[2] or re.split(r"[=:]", found[4])[-1].strip()
            negated = (kind == "P") != bool(found[3])
            return f"\\{'P' if negated else 'p'}{{{name if len(name) <= 2 else 'Is' + name}}}"
        if found := self.next(r"\\b\{(start|end|start-half|end-half)\}"):
            return {"start": ESCAPES["<"], "end": ESCAPES[">"], "start-half": r"(?<!\w)", "end-half": r"(?!\w)"}[found[1]]
        found = self.next(r"\\(.)")
        if not found:
            raise self.fail("a dangling escape")
        c = found[1]
        if c in ESCAPES:
            return ESCAPES[c]
        if c.isascii() and c.isalnum() and c not in SAME_ESCAPES:
            raise self.fail("back-references are not supported" if c.isdigit() else f"an unknown escape \\{c}")
        return found[0]

    def bracket(self) -> str:
        """A class, with those inside it; a closing bracket that stands first is a character."""
        out = [self.next(r"\[\^?")[0]]
        if self.next(r"\]"):
            out.append(r"\]")
        while self.at < len(self.text):
            if found := self.next(r"\[:(\^?)([a-z]+):\]"):
                if found[2] not in POSIX:
                    raise self.fail(f"an unknown class {found[2]}")
                out.append(f"[^{POSIX[found[2]]}]" if found[1] else POSIX[found[2]])
            elif self.next(r"--(?=\[)"):
                inner = self.bracket()
                out.append("&&[" + inner[2:] if inner.startswith("[^") else "&&[^" + inner[1:])
            elif self.next(r"--(?!\])|~~"):
                raise self.fail("a difference of classes needs brackets around its second")
            elif self.next(r"\]"):
                return "".join([*out, "]"])
            elif self.text[self.at] == "[":
                out.append(self.bracket())
            elif self.text[self.at] == "\\":
                out.append(self.escape())
            else:
                out.append(self.text[self.at])
                self.at += 1
        raise self.fail("an unclosed class")
