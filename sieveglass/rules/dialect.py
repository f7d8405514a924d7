"""Rule patterns are written in a linear-time dialect; here they become patterns of the `regex` module or of the JVM."""

from __future__ import annotations

import re
from functools import lru_cache

import regex

_QUANTIFIER = re.compile(r"\{\d+(,\d*)?\}")
_HEX = re.compile(r"\\x\{([0-9A-Fa-f]{1,6})\}")
#: POSIX classes and what they hold in ASCII.
POSIX = {"alnum": "0-9A-Za-z", "alpha": "A-Za-z", "digit": "0-9", "lower": "a-z", "upper": "A-Z", "xdigit": "0-9A-Fa-f", "space": r"\t\n\x0B\f\r ", "punct": r"!-/:-@\[-`{-~", "word": r"0-9A-Za-z_", "blank": r"\t ", "cntrl": r"\x00-\x1F\x7F", "print": " -~", "graph": "!-~", "ascii": r"\x00-\x7F"}


class UnsupportedPattern(ValueError):
    """The pattern is invalid or has no equal here."""


def _tokens(pattern: str):
    """(kind, text, verbose, multiline) of each piece; kinds: escape, class, group, close, end, brace, comment, char."""
    at, flags = 0, [(False, False)]
    while at < len(pattern):
        verbose, multi = flags[-1]
        c = pattern[at]
        if c == "\\":
            m = _HEX.match(pattern, at) or re.compile(r"\\[pP](\{[^}]*\}|.)|\\.", re.S).match(pattern, at)
            if not m:
                raise UnsupportedPattern("a lone backslash ends the pattern")
            yield "escape", m[0], verbose, multi
            at = m.end()
        elif c == "[":
            depth, end = 0, at
            while end < len(pattern):
                if pattern[end] == "\\":
                    end += 2
                    continue
                if pattern[end] == "[":
                    depth += 1
                    if pattern[end + 1 : end + 2] == "^":
                        end += 1
                    if pattern[end + 1 : end + 2] == "]":
                        end += 1
                elif pattern[end] == "]":
                    depth -= 1
                    if not depth:
                        break
                end += 1
            if depth or end >= len(pattern):
                raise UnsupportedPattern("unclosed character class")
            yield "class", pattern[at : end + 1], verbose, multi
            at = end + 1
        elif c == "(":
            m = re.compile(r"\(\?(?:P?<[A-Za-z_][A-Za-z0-9_.\[\]]*>|([a-zA-Z]*)(?:-([a-zA-Z]*))?([:)]))").match(pattern, at)
            if pattern.startswith(("(?=", "(?!", "(?<=", "(?<!"), at):
                raise UnsupportedPattern("look-around is not supported")
            if pattern.startswith("(?", at) and not m:
                raise UnsupportedPattern("unknown group")
            new = (verbose, multi)
            if m and m[3]:
                on, off = m[1] or "", m[2] or ""
                if set(on + off) - set("imsxuU"):
                    raise UnsupportedPattern(f"unknown flags {on + off}")
                if "u" in off or "U" in on:
                    raise UnsupportedPattern("byte mode and swapped greed are not supported")
                new = ("x" in on or verbose and "x" not in off, "m" in on or multi and "m" not in off)
            yield "group", m[0] if m else "(", verbose, multi
            if m and m[3] == ")":
                flags[-1] = new
            else:
                flags.append(new)
            at += len(m[0]) if m else 1
        elif c == ")":
            if len(flags) == 1:
                raise UnsupportedPattern("unopened group")
            flags.pop()
            yield "close", c, verbose, multi
            at += 1
        elif c == "$":
            yield "end", c, verbose, multi
            at += 1
        elif c in "{}":
            m = _QUANTIFIER.match(pattern, at)
            yield ("char", m[0], verbose, multi) if m else ("brace", c, verbose, multi)
            at += len(m[0]) if m else 1
        elif c == "#" and verbose:
            end = pattern.find("\n", at)
            end = len(pattern) if end < 0 else end
            yield "comment", pattern[at:end], verbose, multi
            at = end
        else:
            yield "char", c, verbose, multi
            at += 1
    if len(flags) > 1:
        raise UnsupportedPattern("unclosed group")


def _class(text: str, verbose: bool, java: bool) -> str:
    """A character class; white space in it counts for nothing in verbose mode."""
    body = re.sub(r"\[:(\^?)(\w+):\]", lambda m: POSIX[m[2]] if not m[1] and m[2] in POSIX else m[0], text[1:-1])
    if verbose:
        body = re.sub(r"(\\.)|\s", lambda m: m[1] or "", body, flags=re.S)
    body = _HEX.sub(lambda m: m[0] if java else f"\\U{int(m[1], 16):08X}", body)
    return f"[{body}]"


def to_python(pattern: str) -> str:
    """The pattern for regex.VERSION1: `$` is the very end, flags hold to the end of their group."""
    out = []
    for kind, text, verbose, multi in _tokens(pattern):
        if kind == "escape":
            m = _HEX.match(text)
            if re.match(r"\\[1-9]", text):
                raise UnsupportedPattern("back references are not supported")
            out.append(f"\\U{int(m[1], 16):08X}" if m else r"\Z" if text == r"\z" else text)
        elif kind == "class":
            out.append(_class(text, verbose, False))
        elif kind == "end":
            out.append(r"$" if multi else r"\Z")
        elif kind == "group":
            out.append(re.sub(r"^\(\?<(?=[A-Za-z_])", "(?P<", text).replace("u", "") if text.startswith("(?") and text[-1:] in ":)" else text.replace("(?<", "(?P<"))
        elif kind == "brace":
            out.append("\\" + text)
        elif kind != "comment":
            out.append(text)
    return "(?-f)" + "".join(out).replace("(?)", "").replace("(?-)", "")


def to_java(pattern: str) -> str:
    """The pattern for java.util.regex: Unicode classes and case, `.` stops only at a line feed."""
    out = []
    for kind, text, verbose, multi in _tokens(pattern):
        if kind == "class":
            out.append(re.sub(r"(?<!\\)(?<=.)\[", r"\\[", _class(text, verbose, True)[:-1]) + "]")
        elif kind == "end":
            out.append("$" if multi else r"\z")
        elif kind == "group":
            out.append(text.replace("(?P<", "(?<"))
        elif kind == "brace":
            out.append("\\" + text)
        elif kind != "comment":
            out.append(text)
    return "(?dUu)" + "".join(out)


@lru_cache(maxsize=20_000)
def compiled(pattern: str) -> regex.Pattern:
    """Compile a rule pattern; raises UnsupportedPattern."""
    try:
        return regex.compile(to_python(pattern), regex.VERSION1)
    except regex.error as e:
        raise UnsupportedPattern(str(e)) from e
