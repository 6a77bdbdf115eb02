"""Grammar inference: probabilistic automata learned from example strings by state merging.

The examples make a prefix tree with counts; rare branches may be left off it, what they hold then goes on
from the first state.  States are merged in order of weight when the Hoeffding
bound does not tell their symbol frequencies, and those of all states below, apart.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

#: Symbol of a character: classes for letters and digits, punctuation as it is.
_CLASS = {**{x: "h" for x in "abcdef"}, **{x: "l" for x in "ghijklmnopqrstuvwxyz"},
          **{x: "H" for x in "ABCDEF"}, **{x: "U" for x in "GHIJKLMNOPQRSTUVWXYZ"},
          **{x: "d" for x in "0123456789"}, **{x: x for x in "+/_.=-"}}
END, SYMBOLS = "$", "hlHUd+/_.=-?$"


#: The characters that have a symbol, and their symbols.
LETTERS, CLASSES = "".join(_CLASS), "".join(_CLASS.values())


def shape(text: str) -> str:
    return "".join(_CLASS.get(x, "?") for x in text)


class _State:
    """Visits, ends, and per symbol the next state and how often it was taken."""

    __slots__ = ("count", "end", "next", "flow")

    def __init__(self):
        self.count, self.end, self.next, self.flow = 0, 0, {}, {}


def _tree(shapes: list[str]) -> _State:
    root = _State()
    for s in shapes:
        at = root
        at.count += 1
        for x in s:
            at.flow[x] = at.flow.get(x, 0) + 1
            at = at.next.setdefault(x, _State())
            at.count += 1
        at.end += 1
    return root


def tree(follow: dict[str, dict[str, int]]) -> _State:
    """The prefix tree of prefixes with the numbers of the symbols that follow them."""
    states = {prefix: _State() for prefix in follow}
    for prefix, flow in follow.items():
        s = states[prefix]
        s.count, s.end = sum(flow.values()), flow.get(END, 0)
        s.flow = {x: n for x, n in flow.items() if x != END}
        s.next = {x: states[prefix + x] for x in s.flow if prefix + x in states}
    return states[""]


def _compatible(a: _State, b: _State, bound: float) -> bool:
    """Whether no state of the tree below ``b`` differs from the one that ``a`` reaches likewise."""
    todo = [(a, b)]
    while todo:
        a, b = todo.pop()
        width = bound * (a.count ** -0.5 + b.count ** -0.5)
        pairs = [(a.end, b.end)] + [(a.flow.get(x, 0), b.flow.get(x, 0)) for x in a.flow.keys() | b.flow]
        if any(abs(f / a.count - g / b.count) > width for f, g in pairs):
            return False
        todo += [(a.next[x], b.next[x]) for x in b.next if x in a.next]
    return True


def _fold(a: _State, b: _State) -> None:
    """Add the tree below ``b`` to ``a``."""
    todo = [(a, b)]
    while todo:
        a, b = todo.pop()
        a.count += b.count
        a.end += b.end
        for x, n in b.flow.items():
            a.flow[x] = a.flow.get(x, 0) + n
        for x, q in b.next.items():
            if x in a.next:
                todo.append((a.next[x], q))
            else:
                a.next[x] = q


class Automaton:
    """``rows[state][symbol] = (log probability, next state)``; what was never seen costs ``floor``."""

    def __init__(self, rows: list[dict[str, tuple[float, int]]], floor: float):
        self.rows, self.floor = rows, floor

    def score(self, text: str) -> float:
        return self.of_shape(shape(text))

    def of_shape(self, shaped: str) -> float:
        """Log probability per symbol, the end counted as one."""
        shaped += END
        total, at = 0.0, 0
        for x in shaped:
            p, at = self.rows[at].get(x, (self.floor, at))
            total += p
        return total / len(shaped)


def merged(root: _State, alpha: float = 0.05) -> list[_State]:
    """The states left of a prefix tree, the first one at the front."""
    bound = math.sqrt(0.5 * math.log(2 / alpha))
    red = [root]
    while True:
        known = {id(s) for s in red}
        blue = [(s.flow[x], i, x) for i, s in enumerate(red) for x, q in s.next.items()
                if id(q) not in known]
        if not blue:
            return red
        _, i, x = min(blue, key=lambda e: (-e[0], e[1], e[2]))
        state = red[i].next[x]
        same = next((r for r in red if _compatible(r, state, bound)), None)
        if same is None:
            red.append(state)
        else:
            red[i].next[x] = same
            _fold(same, state)


def moves(red: list[_State]) -> list[dict[str, int]]:
    """Per state the number of the state that follows each symbol; other symbols lead to the first one."""
    number = {id(s): k for k, s in enumerate(red)}
    return [{x: number[id(q)] for x, q in s.next.items()} for s in red]


def visits(steps: list[dict[str, int]], shaped: str) -> Iterator[tuple[int, str]]:
    """(state, symbol) along a string, its end included."""
    at = 0
    for x in shaped + END:
        yield at, x
        at = steps[at].get(x, 0)


def automaton(steps: list[dict[str, int]], flows: list[dict[str, int]], examples: int) -> Automaton:
    """The automaton of the states whose symbols, ``END`` among them, were taken as often as ``flows`` says."""
    extra, rows = 0.1, []
    for step, flow in zip(steps, flows):
        out = sum(flow.values()) + extra * len(SYMBOLS)
        rows.append({x: (math.log((n + extra) / out), step.get(x, 0)) for x, n in flow.items() if n})
    return Automaton(rows, math.log(extra / (examples + extra * len(SYMBOLS))))


def learn(examples: list[str], alpha: float = 0.05) -> Automaton | None:
    """The automaton of the examples; None without any.  The order of the examples does not matter."""
    if not examples:
        return None
    red = merged(_tree(sorted(shape(x) for x in examples)), alpha)
    return automaton(moves(red), [{**s.flow, END: s.end} for s in red], len(examples))
