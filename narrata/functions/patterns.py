"""Long alternations arranged by the letters their matches begin with.

A matcher tries the alternatives of a pattern one after another at each place of a text, and in any case each try costs.
Arranged by first letters a place is held against one class of letters, then only against what begins with its own letter.
"""

from __future__ import annotations

import re
from functools import lru_cache

_PLAIN = re.compile(r"[A-Za-z]")
_LITERAL = re.compile(r"[A-Za-z0-9 '_-]")
_MAYBE = re.compile(r"[?*]|\{0,\d*\}|\+|\{\d+(?:,\d*)?\}")


def _closing(p: str, at: int) -> int:
    """The place after the group or class that opens at ``at``."""
    depth = 0
    while at < len(p):
        if p[at] == "\\":
            at += 1
        elif p[at] == "[":
            at += 1
            while p[at] != "]":
                at += 2 if p[at] == "\\" else 1
        elif p[at] == "(":
            depth += 1
        elif p[at] == ")":
            depth -= 1
        at += 1
        if depth == 0:
            return at
    raise ValueError(f"Open group: {p}")


def alternatives(p: str) -> list[str]:
    """The parts of a pattern between the bars outside of its groups."""
    parts, start, at = [], 0, 0
    while at < len(p):
        if p[at] == "|":
            parts.append(p[start:at])
            start = at = at + 1
        elif p[at] == "\\":
            at += 2
        else:
            at = _closing(p, at) if p[at] in "([" else at + 1
    return [*parts, p[start:]]


def first_letters(p: str, cased: bool = False) -> set[str] | None:
    """The letters a to z, lower-cased unless ``cased``, with one of which each match of an alternative begins; None where that isn't plain."""
    found, at = set(), 2 * p.startswith(r"\b")
    while at < len(p):
        if p.startswith("(?:", at):
            end = _closing(p, at)
            inner = [first_letters(a, cased) for a in alternatives(p[at + 3 : end - 1])]
            if None in inner:
                return None
            found |= set().union(*inner)
        elif _PLAIN.match(p[at]):
            end = at + 1
            found.add(p[at] if cased else p[at].lower())
        else:
            return None
        many = _MAYBE.match(p, end)
        if not many or many[0][0] == "+" or many[0][0] == "{" and not many[0].startswith("{0"):
            return found
        at = many.end() + (p[many.end() : many.end() + 1] in ("?", "+"))
    return None


@lru_cache(maxsize=None)
def by_letter(p: str, cased: bool = False) -> str:
    """A pattern of any case, or of that written, with the same matches as ``p``, its alternatives tried by first letter in the order they have.

    Alternatives of different letters exclude each other, so only the order among those of one letter counts. Patterns with
    numbered groups, or with an alternative whose first letter isn't plain, come back as they are.
    """
    edge = p.startswith(r"\b(?:") and len(alternatives(p)) == 1 and p[_closing(p, 2) :][:1] not in tuple("?*+{")
    body = p[5 : _closing(p, 2) - 1] if edge else p
    parts = alternatives(body)
    if re.search(r"(?<!\\)\((?!\?)", p):
        return p
    # an edge that all alternatives begin with is tried once
    own = not edge and all(a.startswith(r"\b") for a in parts)
    parts = [a[2:] for a in parts] if own else parts
    letters = [first_letters(a, cased) for a in parts]
    if None in letters:
        return p
    every = sorted(set().union(*letters))
    groups = "|".join(f"(?=[{x}])(?:{'|'.join(a for a, of in zip(parts, letters, strict=True) if x in of)})" for x in every)
    before, after = (r"\b", p[_closing(p, 2) :]) if edge else (r"\b" if own else "", "")
    return f"(?=[{''.join(every)}]){before}(?:{groups}){after}"


def _tree(plain: list[str]) -> str:
    heads = sorted({x[:1] for x in plain})
    if "" in heads:
        return ""  # what is longer has this one in it
    parts = [re.escape(x) + _tree([y[1:] for y in plain if y[0] == x]) for x in heads]
    return parts[0] if len(parts) == 1 else f"(?:{'|'.join(parts)})"


@lru_cache(maxsize=None)
def any_of(plain: tuple[str, ...]) -> str:
    """A pattern found where one of several ``plain`` texts of two letters or more stands. It reads a text once, however many
    there are, and holds most places against two classes of letters only."""
    first, second = ("".join(sorted({re.escape(x[i]) for x in plain})) for i in (0, 1))
    return f"(?=[{first}][{second}]){_tree(list(plain))}"


@lru_cache(maxsize=None)
def lowered(p: str) -> str:
    """A pattern of any case for texts in lower case. Plain letters, tried first, spare a word character its Unicode tables."""
    low = re.sub(r"\\.|[A-Z]", lambda m: m[0] if m[0][0] == "\\" else m[0].lower(), p)
    return re.sub(r"(?<!\\)\\w", lambda _: r"[a-z0-9_\w]", low)


def _stretches(p: str) -> list[set[str]]:
    """Sets of plain texts; each match of an alternative has one of every set."""
    found, run, at = [], "", 0
    while at < len(p):
        if p[at] in "([":
            end = _closing(p, at)
        else:
            end = at + (2 if p[at] == "\\" else 1)
        many = _MAYBE.match(p, end)
        sure = not many or many[0] != "?" and many[0] != "*" and not many[0].startswith("{0")
        if _LITERAL.fullmatch(p[at:end]) and not many:
            run += p[at:end].lower()
        else:
            found, run = ([*found, {run}] if run else found), ""
            if sure and _LITERAL.fullmatch(p[at:end]):
                found.append({p[at:end].lower()})
            elif sure and p.startswith("(?:", at) and (inner := needed(p[at + 3 : end - 1], 1)):
                found.append(set(inner))
        at = many.end() + (p[many.end() : many.end() + 1] in ("?", "+")) if many else end
    return [*found, {run}] if run else found


def needed(p: str, least: int = 3) -> list[str]:
    """Plain texts in lower case, of ``least`` letters at least, with one of which each match of a pattern of any case is;
    none where the pattern does not tell. Such texts are found without a pattern."""
    every = set()
    for part in alternatives(p):
        best = max(_stretches(part), key=lambda s: min(map(len, s)), default={""})
        if min(map(len, best)) < least:
            return []
        every |= best
    return sorted(x for x in every if not any(y in x for y in every if y != x))
