"""Levenshtein automata intersected with a trie of terms.

A state is the set of places (trie node, edits so far) that a word's letters so
far can have reached, for all terms at once; each place keeps the fewest edits.
A place goes only while some term below it still allows its edits. States and
steps are made when a word first needs them and then kept, so most words of
most texts take a few look-ups until no place is left.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

STEPS_KEPT, WORDS_KEPT = 200_000, 300_000


@dataclass(frozen=True)
class Term:
    text: str
    stem: bool  #: also matches words that go on after it
    edits: int  #: how many letters may be wrong, missing or too many


class Automaton:
    """match(word) is (number of the term, edits) of the nearest term, of equally
    near ones the first, or None."""

    def __init__(self, terms: Sequence[Term]):
        self.terms = terms
        self.children: list[dict[str, int]] = [{}]
        self.ends: list[list[int]] = [[]]
        self.most = [0]
        for number, term in enumerate(terms):
            node = 0
            self.most[0] = max(self.most[0], term.edits)
            for letter in term.text:
                if letter not in self.children[node]:
                    self.children[node][letter] = len(self.children)
                    self.children.append({})
                    self.ends.append([])
                    self.most.append(0)
                node = self.children[node][letter]
                self.most[node] = max(self.most[node], term.edits)
            self.ends[node].append(number)
        self._clear()
        self.words: dict[str, tuple[int, int] | None] = {}

    def _clear(self) -> None:
        self.states: dict[frozenset, int] = {}
        self.places: list[dict[int, int]] = []
        self.steps: dict[tuple[int, str], int] = {}
        self.start = self._state({0: 0})

    def _state(self, places: dict[int, int]) -> int:
        # a letter of the term may be missing in the word
        todo = list(places.items())
        while todo:
            node, edits = todo.pop()
            for child in self.children[node].values():
                if edits + 1 <= self.most[child] and edits + 1 < places.get(child, 1 << 30):
                    places[child] = edits + 1
                    todo.append((child, edits + 1))
        key = frozenset(places.items())
        if key not in self.states:
            self.states[key] = len(self.places)
            self.places.append(places)
        return self.states[key]

    def _step(self, state: int, letter: str) -> int:
        places: dict[int, int] = {}

        def reach(node: int, edits: int) -> None:
            if edits <= self.most[node] and edits < places.get(node, 1 << 30):
                places[node] = edits

        for node, edits in self.places[state].items():
            for c, child in self.children[node].items():
                reach(child, edits if c == letter else edits + 1)
            reach(node, edits + 1)
        return self._state(places) if places else -1

    def _accepted(self, state: int, stems: bool) -> tuple[int, int] | None:
        """(edits, number) of the nearest term that ends here."""
        found = [(edits, n) for node, edits in self.places[state].items() for n in self.ends[node] if edits <= self.terms[n].edits and (not stems or self.terms[n].stem)]
        return min(found, default=None)

    def _walk(self, word: str) -> tuple[int, int] | None:
        state, best = self.start, None
        for letter in word:
            step = self.steps.get((state, letter))
            if step is None:
                step = self.steps[state, letter] = self._step(state, letter)
            state = step
            if state < 0:
                break
            if (found := self._accepted(state, True)) and (best is None or found < best):
                best = found
        if state >= 0 and (found := self._accepted(state, False)) and (best is None or found < best):
            best = found
        if len(self.steps) > STEPS_KEPT:
            self._clear()
        return best and (best[1], best[0])

    def match(self, word: str) -> tuple[int, int] | None:
        try:
            return self.words[word]
        except KeyError:
            if len(self.words) >= WORDS_KEPT:
                self.words.clear()
            found = self.words[word] = self._walk(word)
            return found
