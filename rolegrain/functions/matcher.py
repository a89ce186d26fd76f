"""Many patterns over many texts in one pass.

All packs share one Aho-Corasick automaton over the literals their patterns need.  A text runs through it once, whatever the
number of patterns; a pattern is tried only where one of its literals was met.  Packs without a known literal are tried always.
"""

from __future__ import annotations

import re
import sys
from collections.abc import Mapping, Sequence

import ahocorasick
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .batches import by_slices
from .literals import required_literals

cloudpickle.register_pickle_by_value(sys.modules[__name__])

NAMES = T.ArrayType(T.StringType())


class Matcher:
    """Names of the packs that occur in a lower-cased text, by group.

    ``groups``: group -> name -> patterns.  ``follow``: further group -> (group it looks at, literal, name -> pattern); such a
    pattern is tried only for names that were found there, in texts with the literal.
    """

    def __init__(
        self, groups: Mapping[str, Mapping[str, Sequence[str]]], follow: Mapping[str, tuple[str, str, Mapping[str, str]]] | None = None,
    ) -> None:
        self.groups, self.follow = groups, follow or {}
        self.fields = [*groups, *self.follow]
        self._build()

    def __reduce__(self):
        return type(self), (self.groups, self.follow)

    def _build(self) -> None:
        self.packs = [(group, name, re.compile("|".join(f"(?:{p})" for p in patterns))) for group, packs in self.groups.items() for name, patterns in packs.items()]
        wanted: dict[str, list[int]] = {}
        self.always: list[int] = []
        sources = [patterns for packs in self.groups.values() for patterns in packs.values()]
        for number, patterns in enumerate(sources):
            literals = required_literals(patterns)
            if literals is None:
                self.always.append(number)
            for literal in literals or ():
                wanted.setdefault(literal, []).append(number)
        self.automaton = ahocorasick.Automaton()
        for literal, numbers in wanted.items():
            self.automaton.add_word(literal, tuple(numbers))
        self.automaton.make_automaton()
        self.behind = {group: {name: re.compile(p) for name, p in packs.items()} for group, (_, _, packs) in self.follow.items()}

    def search(self, low: str | None) -> dict[str, list[str]]:
        """Sorted names per group."""
        found: dict[str, list[str]] = {field: [] for field in self.fields}
        if not low:
            return found
        met = set(self.always)
        if len(self.automaton):
            for _, numbers in self.automaton.iter(low):
                met.update(numbers)
        for number in met:
            group, name, pattern = self.packs[number]
            if pattern.search(low):
                found[group].append(name)
        for group, (source, literal, _) in self.follow.items():
            if found[source] and literal in low:
                found[group] = [n for n in found[source] if n in self.behind[group] and self.behind[group][n].search(low)]
        for names in found.values():
            names.sort()
        return found


def matches(matcher: Matcher):
    """A function of a text column: ``struct`` of one array of names per group; null texts have none."""
    kind = pa.list_(pa.string())

    def run(texts: pa.Array) -> pa.Array:
        rows = [matcher.search(t.as_py()) for t in texts]
        return pa.StructArray.from_arrays([pa.array([r[f] for r in rows], kind) for f in matcher.fields], matcher.fields)

    # Keeps Spark from running it again for filters on its result.
    return F.arrow_udf(by_slices(run), T.StructType([T.StructField(f, NAMES) for f in matcher.fields])).asNondeterministic()


def matches_each(matcher: Matcher, group: str):
    """A function of a column of text arrays: the names of one group for every text; null for null."""
    kind = pa.list_(pa.list_(pa.string()))

    def run(lists: pa.Array) -> pa.Array:
        return pa.array([None if texts is None else [matcher.search(t)[group] for t in texts] for texts in lists.to_pylist()], kind)

    return F.arrow_udf(by_slices(run), T.ArrayType(NAMES)).asNondeterministic()
