"""Web-style queries as trees, their evaluation over term positions, and cover-density ranking.

Terms are AND-ed; `or` alternates; quotes make a phrase; a leading minus negates. No input is an error.
A tree is nested lists: ["term", lexeme, prefix], ["and", ...], ["or", ...], ["not", x], ["phrase", lexeme, ...].
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Callable

from .text import python_tokens

#: Weights of labels D, C, B, A.
WEIGHTS = {"D": 0.1, "C": 0.2, "B": 0.4, "A": 1.0}

_LEX = re.compile(r'(-?)"([^"]*)"?|(-?)([^\s"]+)')


def lexemes(text: str) -> list[str]:
    return [t.lower() for t in python_tokens(text)]


def parse(text: str) -> list | None:
    """The tree of a query, or None if it has no terms."""
    alternatives: list[list] = [[]]
    pending_or = False
    for m in _LEX.finditer(text):
        quoted = m[2] is not None
        body, minus = (m[2], m[1]) if quoted else (m[4], m[3])
        if not quoted and not minus and body.lower() == "or":
            pending_or = bool(alternatives[-1])
            continue
        words = lexemes(body)
        if not words:
            continue
        node = ["term", words[0]] if len(words) == 1 else ["phrase", *words]
        if minus:
            node = ["not", node]
        if pending_or:
            alternatives.append([])
            pending_or = False
        alternatives[-1].append(node)
    groups = [g[0] if len(g) == 1 else ["and", *g] for g in alternatives if g]
    if not groups:
        return None
    return groups[0] if len(groups) == 1 else ["or", *groups]


def either(a: list | None, b: list | None) -> list | None:
    return a if b is None else b if a is None else ["or", a, b]


def terms(tree: list | None, negated: bool = False) -> set[str]:
    """Lexemes that occur outside negations."""
    if tree is None or negated:
        return set()
    if tree[0] in ("term", "phrase"):
        return {w for w in tree[1:] if w is not None}
    if tree[0] == "not":
        return terms(tree[1], True)
    return set().union(*(terms(x) for x in tree[1:]))


def all_terms(tree: list | None) -> set[str]:
    """Every lexeme of a tree, negated ones too."""
    if tree is None:
        return set()
    if tree[0] in ("term", "phrase"):
        return {w for w in tree[1:] if w is not None}
    return set().union(*(all_terms(x) for x in tree[1:]))


def map_terms(tree: list | None, of: Callable[[str], str | None]) -> list | None:
    """The tree with its lexemes mapped; those mapped to None go, in a phrase they leave a gap."""
    if tree is None:
        return None
    kind = tree[0]
    if kind in ("term", "phrase"):
        words = [of(w) for w in tree[1:]]
        while words and words[0] is None:
            words.pop(0)
        while words and words[-1] is None:
            words.pop()
        return None if not words else ["term", words[0]] if len(words) == 1 else ["phrase", *words]
    if kind == "not":
        inner = map_terms(tree[1], of)
        return inner and ["not", inner]
    parts = [m for x in tree[1:] if (m := map_terms(x, of))]
    return None if not parts else parts[0] if len(parts) == 1 else [kind, *parts]


def needs_term(tree: list | None) -> bool:
    """Whether a match must hold one of terms(tree); if not, every document is a candidate."""
    if tree is None:
        return True
    if tree[0] in ("term", "phrase"):
        return True
    if tree[0] == "not":
        return False
    return (any if tree[0] == "and" else all)(needs_term(x) for x in tree[1:])


def evaluate(tree: list | None, positions: dict[str, list[int]]) -> bool:
    if tree is None:
        return False
    kind = tree[0]
    if kind == "term":
        return tree[1] in positions
    if kind == "phrase":
        later = [(i, set(positions.get(w, ()))) for i, w in enumerate(tree[2:], 1) if w is not None]
        return any(all(p + i in s for i, s in later) for p in positions.get(tree[1], ()))
    if kind == "not":
        return not evaluate(tree[1], positions)
    return (all if kind == "and" else any)(evaluate(x, positions) for x in tree[1:])


def _within(tree: list | None, wanted: set[str], entries: dict[str, list[tuple[int, str]]]) -> Callable[[int, int], bool]:
    """evaluate() over the wanted lexemes' places from one place to another, by binary search."""
    if tree is None:
        return lambda low, high: False
    kind = tree[0]
    if kind in ("term", "phrase"):
        held = [(i, {p for p, _ in entries.get(w, ())} if w in wanted else set()) for i, w in enumerate(tree[1:]) if w is not None]
        starts = sorted(p for p in held[0][1] if all(p + i in places for i, places in held[1:]))
        span = held[-1][0]
        return lambda low, high: (n := bisect_left(starts, low)) < len(starts) and starts[n] + span <= high
    inner = [_within(x, wanted, entries) for x in tree[1:]]
    if kind == "not":
        return lambda low, high: not inner[0](low, high)
    every = all if kind == "and" else any
    return lambda low, high: every(f(low, high) for f in inner)


def rank_cover(tree: list | None, entries: dict[str, list[tuple[int, str]]]) -> float:
    """Cover density: each smallest stretch that satisfies the tree adds its mean weight over 1 + its noise words."""
    wanted = terms(tree)
    weights: dict[int, float] = {}
    for lexeme, places in entries.items():
        if lexeme in wanted:
            for p, w in places:
                weights[p] = max(WEIGHTS[w], weights.get(p, 0.0))
    places, within = sorted(weights), _within(tree, wanted, entries)
    total, at = 0.0, 0
    while at < len(places):
        end = next((j for j in range(at, len(places)) if within(places[at], places[j])), None)
        if end is None:
            break
        begin = next((j for j in range(end, at - 1, -1) if within(places[j], places[end])), at)
        inverse = [1 / weights[places[j]] for j in range(begin, end + 1)]
        n = end - begin + 1
        noise = max(0, places[end] - places[begin] - (n - 1))
        total += n / sum(inverse) / (1 + noise)
        at = begin + 1
    return total
