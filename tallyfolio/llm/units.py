"""Whole texts as runs of units that tokenizers treat apart, each unit worked out once.

Texts repeat themselves: the distinct stretches between spaces are a small share of all of
them. A unit starts at a space or newline after a visible character (or at the text's
start). No piece of a byte-level pre-tokenizer spans such a place, so what holds for a text is
the concatenation, or the sum, of what holds for its units.

``UnitValues`` keeps the values of units it has seen, up to a limit of entries; results do not
depend on what is kept.
"""
from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator
from itertools import islice

# Characters of text whose new units are worked out together.
GROUP_CHARS = 6_000_000
KEPT_UNITS = 1_200_000
_BOUNDARY = re.compile(r"(?<=\S)(?=[ \n])")
# Marks that no piece shares with the letter or digit before them.
_MARKS = ".,;:!?#$%&*|)"


CAREFUL = object()      # stands for a key that does not end where a unit ends


class UnitValues:
    """Values per unit: ``work`` gets distinct units, ``fold`` joins the values of a text.

    ``specials`` are strings taken out of the text first. With ``spaced`` a unit includes the
    white space before it; without, white space only separates units. ``fold`` must reject
    None and other objects with a TypeError, as ``sum`` and ``b"".join`` do.
    """

    def __init__(self, work: Callable[[list[str]], list], fold: Callable[[list], object],
                 specials: Iterable[str] = (), spaced: bool = True, kept: int = KEPT_UNITS):
        self.work, self.fold, self.spaced, self.kept = work, fold, spaced, kept
        specials = sorted(specials, key=len, reverse=True)
        self.special = re.compile("(" + "|".join(map(re.escape, specials)) + ")") if specials else None
        self.hint = specials[0][:2] if specials and len({s[:2] for s in specials}) == 1 else ""
        # Values by unit less its first space, and by whole unit.
        self.short: dict[str, object] = {}
        self.whole: dict[str, object] = {}
        if not spaced:
            self.short[""] = fold([])

    def segments(self, text: str) -> list[str]:
        """Text and special strings in turn; the odd places hold the special strings."""
        if self.special is None or self.hint not in text:
            return [text]
        return self.special.split(text)

    def units(self, segment: str) -> list[str]:
        """The units themselves; joined they are the segment."""
        return _BOUNDARY.split(segment) if segment else []

    def _keys(self, segment: str) -> list[str]:
        if self.spaced:
            return segment.replace("\n", " \n").split(" ")
        return segment.replace("\n", " ").split(" ")

    def _work(self, units: list[str]) -> list:
        """Values of distinct units; a word and the marks after it are looked up apart."""
        cut = []
        for unit in units:
            core = unit.rstrip(_MARKS)
            # Beyond Latin-1, normal forms may turn a letter into a letter and a mark.
            apart = core and len(core) < len(unit) and core[-1] < "\u0100" and core[-1].isalnum()
            cut.append(core if apart else unit)
        distinct = list({*cut, *[u[len(c):] for u, c in zip(units, cut) if c is not u]})
        value = dict(zip(distinct, self.work(distinct)))
        fold = self.fold
        return [value[u] if c is u else fold([value[c], value[u[len(c):]]]) for u, c in zip(units, cut)]

    def _learn(self, short: set[str], whole: set[str]) -> tuple[dict, dict]:
        """Work out unknown keys and keep them; also gives them back."""
        if self.spaced:
            safe = [k for k in short if k and not k[-1].isspace()]
            start = [k for k in whole if k and not k[-1].isspace()]
            values = self._work([k if k[0] == "\n" else " " + k for k in safe] + start)
        else:
            safe, start = list(short), []
            values = self._work(safe)
        new_short, new_whole = dict.fromkeys(short, CAREFUL), dict.fromkeys(whole, CAREFUL)
        new_short.update(zip(safe, values))
        new_whole.update(zip(start, values[len(safe):]))
        self.short.update(new_short)
        self.whole.update(new_whole)
        for known in (self.short, self.whole):
            if len(known) > self.kept:
                # The units met first are the frequent ones; the latest third goes.
                for key in list(islice(reversed(known), len(known) // 3)):
                    del known[key]
        return new_short, new_whole

    def _careful(self, segment: str) -> object:
        found = self.units(segment)
        distinct = list(set(found))
        values = dict(zip(distinct, self._work(distinct)))
        return self.fold([values[u] for u in found])

    def of(self, texts: Iterable[str]) -> Iterator[list]:
        """Per text its segments: folded values, and special strings between them."""
        group: list[str] = []
        size = 0
        for text in texts:
            group.append(text)
            size += len(text)
            if size >= GROUP_CHARS:
                yield from self._group(group)
                group, size = [], 0
        yield from self._group(group)

    def _group(self, group: list[str]) -> list[list]:
        out, later = [], []
        short: set[str] = set()
        whole: set[str] = set()
        for text in group:
            parts: list = self.segments(text)
            out.append(parts)
            for i in range(0, len(parts), 2):
                keys = self._keys(parts[i])
                values = list(map(self.short.get, keys))
                if self.spaced:
                    values[0] = self.whole.get(keys[0])
                try:
                    parts[i] = self.fold(values)
                except TypeError:
                    gaps = [k for k, v in enumerate(values) if v is None]
                    later.append((parts, i, values, gaps, [keys[k] for k in gaps]))
                    if self.spaced and gaps and gaps[0] == 0:
                        whole.add(keys[0])
                        short.update(later[-1][4][1:])
                    else:
                        short.update(later[-1][4])
        if later:
            short, whole = self._learn(short, whole)
            for parts, i, values, gaps, keys in later:
                for k, key in zip(gaps, keys):
                    values[k] = whole[key] if self.spaced and not k else short[key]
                try:
                    parts[i] = self.fold(values)
                except TypeError:
                    parts[i] = self._careful(parts[i])
        return out

    def each(self, segment: str) -> Iterator[tuple[str, object]]:
        """Unit by unit, with values; for those who stop early."""
        for unit in self.units(segment):
            if self.spaced and unit[0] == "\n":
                value = self.short.get(unit)
            elif self.spaced and unit[0] == " " and unit[1:2] != "\n":
                value = self.short.get(unit[1:])
            else:
                value = self.whole.get(unit)
            if value is None or value is CAREFUL:
                value = self._work([unit])[0]
            yield unit, value
