"""Literals a text must contain before a pattern can match it.

Searching a literal is far cheaper than running a regular expression, so long
texts are asked for the literals first.
"""

from __future__ import annotations

from collections.abc import Iterable

try:  # the parser behind ``re``; without it no literal is known and nothing is skipped
    from re import _constants as codes
    from re import _parser as parser
except ImportError:  # pragma: no cover
    parser = codes = None


def _weight(options: frozenset[str]) -> tuple[int, int]:
    """Longer shortest literal first, then fewer literals."""
    return (min(map(len, options)), -len(options)) if options else (0, 0)


def _best(sequence) -> frozenset[str]:
    """Alternatives of which every match of the sequence contains one; empty when there is no such set."""
    found, run = [], ""
    for code, value in [*sequence, (None, None)]:
        if code is codes.LITERAL:
            run += chr(value)
            continue
        if run:
            found.append(frozenset([run]))
            run = ""
        if code is codes.SUBPATTERN:
            found.append(_best(value[3]))
        elif code is codes.MAX_REPEAT and value[0] > 0:
            found.append(_best(value[2]))
        elif code is codes.BRANCH:
            branches = [_best(branch) for branch in value[1]]
            found.append(frozenset().union(*branches) if all(branches) else frozenset())
    return max(found, key=_weight, default=frozenset())


def required_literals(patterns: Iterable[str]) -> list[str] | None:
    """Lower-case literals of which at least one is in every text that any pattern matches; None when unknown."""
    if parser is None:
        return None
    sets = [_best(parser.parse(p)) for p in patterns]
    if not all(sets):
        return None
    every = {literal.lower() for options in sets for literal in options}
    return sorted(a for a in every if not any(b != a and b in a for b in every))
