"""Shell patterns and gitignore lines as regular expressions that Java and Python both read."""

from __future__ import annotations

import re
from dataclasses import dataclass

SPECIAL = set("\\.^$*+?{}[]|()&~-#")


def _quote(char: str) -> str:
    return "\\" + char if char in SPECIAL else char


def _set(pattern: str, at: int, negations: str, excluded: str = "") -> tuple[str, int] | None:
    """The character set that starts at ``pattern[at] == '['``, and where it ends; None if it does not end."""
    k = at + 1
    negated = k < len(pattern) and pattern[k] in negations
    k += negated
    start = k
    if k < len(pattern) and pattern[k] == "]":
        k += 1
    while k < len(pattern) and pattern[k] != "]":
        k += 2 if pattern[k] == "\\" and excluded else 1
    if k >= len(pattern):
        return None
    body, items, i = pattern[start:k], [], 0
    while i < len(body):
        char = body[i]
        if char == "\\" and excluded and i + 1 < len(body):
            i += 1
            char = body[i]
        if i + 2 < len(body) and body[i + 1] == "-":
            low, high = char, body[i + 2]
            if low <= high:
                items.append(f"{_quote(low)}-{_quote(high)}")
            i += 3
        else:
            items.append(_quote(char))
            i += 1
    inside = "".join(items)
    if not inside:
        return (f"[^{excluded}]" if excluded else r"[\s\S]") if negated else r"[^\s\S]", k + 1
    out = f"[^{excluded}{inside}]" if negated else f"[{inside}]"
    return (f"(?!{excluded}){out}" if excluded and not negated else out), k + 1


def glob_regex(pattern: str) -> str:
    """A case-sensitive shell pattern for a whole name."""
    out, at = [], 0
    while at < len(pattern):
        char = pattern[at]
        found = _set(pattern, at, "!") if char == "[" else None
        if found:
            text, at = found
            out.append(text)
            continue
        out.append(r"[\s\S]*" if char == "*" else r"[\s\S]" if char == "?" else _quote(char))
        at += 1
    return "^" + "".join(out) + r"\z"


@dataclass(frozen=True)
class Rule:
    regex: str
    negated: bool


def gitignore_rule(line: str, literal_start: bool = False) -> Rule | None:
    """One gitignore line, or None for blanks and comments.

    The expression is for paths in which a directory ends with a slash.  It also
    matches everything below what the line names.  With ``literal_start`` a
    leading ``!`` or ``#`` is an ordinary character.
    """
    line = line.rstrip("\r\n")
    while line.endswith(" ") and not line.endswith("\\ "):
        line = line[:-1]
    if not line.strip() or not literal_start and line.startswith("#"):
        return None
    negated = line.startswith("!") and not literal_start
    line = line[1:] if negated else line
    directory = line.endswith("/")
    body = line.rstrip("/") if directory else line
    anchored = "/" in body
    body = body.removeprefix("/")
    if not body:
        return None
    parts = body.split("/")
    out = "^" if anchored else "^(?:.*/)?"
    for k, part in enumerate(parts):
        last = k == len(parts) - 1
        if part == "**":
            if last:
                out += ".+" if k else ".*"
                directory = False
                break
            out += "(?:.*/)?" if k == 0 else "(?:.*/)?"
            continue
        out += _segment(part)
        if not last:
            out += "/"
    tail = r"\z" if parts[-1] == "**" else "/.*\\z" if directory else "(?:/.*)?\\z"
    return Rule("(?s)" + out + tail, negated)


def _segment(part: str) -> str:
    if part == "*":
        return "[^/]+"
    out, at = [], 0
    while at < len(part):
        char = part[at]
        if char == "\\" and at + 1 < len(part):
            out.append(_quote(part[at + 1]))
            at += 2
            continue
        found = _set(part, at, "!^", "/") if char == "[" else None
        if found:
            text, at = found
            out.append(text)
            continue
        out.append("[^/]*" if char == "*" else "[^/]" if char == "?" else _quote(char))
        at += 1
    return "".join(out)


def python_regex(regex: str) -> re.Pattern:
    return re.compile(regex.replace(r"\z", r"\Z"))


def first_opinion(rules: list[Rule], path: str) -> bool | None:
    """Ignored, re-included, or None where no rule speaks; the last rule that matches decides."""
    for rule in reversed(rules):
        if python_regex(rule.regex).match(path):
            return not rule.negated
    return None
