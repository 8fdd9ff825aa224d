"""Small weighted finite-state transducers over marks, and their composition.

A mark is a number: the class of a word in the low bits, and flags that earlier transducers have
set. A transducer reads one mark a step, writes one, changes its state and adds a weight.
Composing two feeds what the first writes to the second; the states reached from the start are
numbered and tabulated, so that running the whole grammar is one table look-up per word.
"""

from __future__ import annotations

from collections.abc import Callable, Hashable
from dataclasses import dataclass

OTHER, INSULT, THREAT, TARGET, NEGATION, REPORT = range(6)
CLASS = 7
#: Flags: said by somebody else, negated, aimed at somebody.
SAID, NEGATED, AIMED = 8, 16, 32
MARKS = 64


@dataclass(frozen=True)
class Transducer:
    """step(state, mark) gives the next state, the mark written and the weight."""

    start: Hashable
    step: Callable[[Hashable, int], tuple[Hashable, int, float]]


def compose(first: Transducer, second: Transducer) -> Transducer:
    """Run `second` on what `first` writes; weights add up."""

    def step(state, mark):
        a, between, x = first.step(state[0], mark)
        b, written, y = second.step(state[1], between)
        return (a, b), written, x + y

    return Transducer((first.start, second.start), step)


def tabulate(machine: Transducer, marks: range = range(6)) -> tuple[list[list[int]], list[list[float]]]:
    """Next state and weight by state and input mark, for all states that can be reached; 0 is the start."""
    number = {machine.start: 0}
    order = [machine.start]
    following: list[list[int]] = []
    weights: list[list[float]] = []
    for state in order:
        row, cost = [], []
        for mark in marks:
            after, _, weight = machine.step(state, mark)
            if after not in number:
                number[after] = len(order)
                order.append(after)
            row.append(number[after])
            cost.append(weight)
        following.append(row)
        weights.append(cost)
    return following, weights


def reported_speech() -> Transducer:
    """Behind a word of saying, the rest of the clause is somebody else's."""

    def step(said, mark):
        return said or mark & CLASS == REPORT, mark | SAID if said else mark, 0.0

    return Transducer(False, step)


def negation(reach: int = 3) -> Transducer:
    """A negation covers the next words, up to the first insult or threat."""

    def step(left, mark):
        kind = mark & CLASS
        if kind == NEGATION:
            return reach, mark, 0.0
        if left and kind in (INSULT, THREAT):
            return 0, mark | NEGATED, 0.0
        return max(0, left - 1), mark, 0.0

    return Transducer(0, step)


def target(reach: int = 4) -> Transducer:
    """Words shortly behind a word for somebody are aimed at them."""

    def step(left, mark):
        if mark & CLASS == TARGET:
            return reach, mark, 0.0
        return max(0, left - 1), mark | AIMED if left else mark, 0.0

    return Transducer(0, step)


def insult(aimed: float = 1.5, said: float = 0.6, negated: float = 0.4, again: float = 0.7) -> Transducer:
    """Weighs insults: more if aimed, less if negated, reported or not a clause's first."""

    def step(seen, mark):
        if mark & CLASS != INSULT:
            return seen, mark, 0.0
        weight = (again if seen else 1.0) * (aimed if mark & AIMED else 1.0)
        weight *= (said if mark & SAID else 1.0) * (negated if mark & NEGATED else 1.0)
        return True, mark, weight

    return Transducer(False, step)


def threat(reach: int = 3, plain: float = 0.2, aimed: float = 1.0, said: float = 0.6, negated: float = 0.3) -> Transducer:
    """A threat counts in full once somebody is named within the next words, or before it."""

    def step(state, mark):
        left, scale = state
        kind = mark & CLASS
        if kind == THREAT:
            scale = (said if mark & SAID else 1.0) * (negated if mark & NEGATED else 1.0)
            if mark & AIMED:
                return (0, 1.0), mark, aimed * scale
            return (reach, scale), mark, plain * scale
        if kind == TARGET and left:
            return (0, 1.0), mark, (aimed - plain) * scale
        return (left - 1, scale) if left > 1 else (0, 1.0), mark, 0.0

    return Transducer((0, 1.0), step)


def grammar() -> tuple[list[list[int]], list[list[float]]]:
    """All five composed: reported speech, negation, target, insult, threat."""
    machine = reported_speech()
    for part in (negation(), target(), insult(), threat()):
        machine = compose(machine, part)
    return tabulate(machine)
