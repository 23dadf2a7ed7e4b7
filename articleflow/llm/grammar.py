"""Letter-to-letter transducers over word classes, and their composition into one table."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

#: A transducer maps (state, symbol) to (next state, output symbol). State 0 is the start.
Step = Callable[[int, str], tuple[int, str]]
INPUT = ("other", "insult", "violence", "modal", "target", "negation", "report", "end")
#: What a clause can be found to hold, in the order of the weights.
FINDINGS = (
    "insult", "aimed_insult", "negated_insult", "reported_insult", "threat", "aimed_threat",
    "softened_threat", "named_after",
)
REACH = 4


def negation(state: int, symbol: str) -> tuple[int, str]:
    """An insult or violent word within reach after a negation is marked as negated."""
    if symbol == "end":
        return 0, symbol
    if symbol == "negation":
        return REACH, symbol
    if state and symbol in ("insult", "violence"):
        return state - 1, f"negated_{symbol}"
    return max(state - 1, 0), symbol


def reported(state: int, symbol: str) -> tuple[int, str]:
    """After a verb of speech the rest of the clause is somebody else's."""
    if symbol == "end":
        return 0, symbol
    if symbol == "report":
        return 1, symbol
    if state and symbol.endswith("insult"):
        return 1, "reported_insult"
    if state and symbol == "violence":
        return 1, "negated_violence"
    return state, symbol


def threat(state: int, symbol: str) -> tuple[int, str]:
    """Violence is a threat only when announced by a modal; otherwise it is narration."""
    if symbol == "end":
        return 0, symbol
    if symbol == "modal":
        return REACH, symbol
    if symbol.endswith("violence"):
        kind = "softened_threat" if symbol.startswith("negated") else "threat"
        return 0, kind if state else "other"
    return max(state - 1, 0), symbol


def target(state: int, symbol: str) -> tuple[int, str]:
    """A person before an insult or threat makes it aimed; one right after an insult names its target.

    States 1 to REACH count down from a target, states above it from an insult.
    """
    if symbol == "end":
        return 0, symbol
    if symbol == "target":
        return REACH, "named_after" if state > REACH else symbol
    if symbol in ("insult", "threat"):
        aimed = 0 < state <= REACH
        return (REACH + 2 if symbol == "insult" else 0), f"aimed_{symbol}" if aimed else symbol
    return (0 if state in (0, 1, REACH + 1) else state - 1), symbol


def findings(state: int, symbol: str) -> tuple[int, str]:
    """Keeps what is scored."""
    return 0, symbol if symbol in FINDINGS else ""


@dataclass(frozen=True)
class Table:
    """``rows[state][symbol]`` is (next state, index of the finding or -1)."""

    rows: tuple[tuple[tuple[int, int], ...], ...]

    def run(self, symbols: list[int], counts: list[int]) -> None:
        state, rows = 0, self.rows
        for symbol in symbols:
            state, found = rows[state][symbol]
            if found >= 0:
                counts[found] += 1


def compose(*steps: Step) -> Table:
    """One deterministic transducer over the reachable tuples of states."""
    start = (0,) * len(steps)
    ids, queue, rows = {start: 0}, [start], []
    for states in queue:  # grows while it is read
        row = []
        for symbol in INPUT:
            following, out = [], symbol
            for step, state in zip(steps, states, strict=True):
                after, out = step(state, out)
                following.append(after)
            key = tuple(following)
            if key not in ids:
                ids[key] = len(ids)
                queue.append(key)
            row.append((ids[key], FINDINGS.index(out) if out else -1))
        rows.append(tuple(row))
    return Table(tuple(rows))


def toxic_clauses() -> Table:
    return compose(negation, reported, threat, target, findings)
