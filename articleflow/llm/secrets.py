"""Secret scans: all rules in one automaton, one pass over the bytes of a text.

The forward automaton says where a rule's match can end. For such an end the rule's own reversed
automaton finds the leftmost start, and the rule's forward automaton from there the greedy end, so
spans equal those of a leftmost, greedy, non-overlapping search with each rule alone.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import cache

from pyspark.sql import DataFrame

from articleflow.llm.automaton import Pattern, alt, at_least, chars, compile_all, opt, plus, seq, star, word
from articleflow.llm.common import map_texts

LOWER = "abcdefghijklmnopqrstuvwxyz"
UPPER, DIGITS = LOWER.upper(), "0123456789"
Keep = Callable[[str], bool]


@dataclass(frozen=True)
class Rule:
    """``keep`` sees a whole match; matches that fail it are consumed but not reported."""

    kind: str
    pattern: Pattern
    keep: Keep = bool


def _assign() -> Pattern:
    names = [word(w, True) for w in ("password", "passwd", "secret", "token")]
    names.append(seq(word("api", True), opt(chars("_")), word("key", True)))
    blanks, quote = star(chars(" ")), opt(chars("\"'"))
    return seq(alt(*names), quote, blanks, chars(":="), blanks, quote, plus(chars(UPPER + LOWER + DIGITS + "+/_.=-")))


def _assigned_length(text: str) -> bool:
    """Whether the value is of six characters or more: what follows the first separator, blanks and a quote."""
    value = text[min(i for i in (text.find(":"), text.find("=")) if i >= 0) + 1 :].lstrip(" ")
    return len(value) - (value[:1] in ("'", '"')) >= 6


def base_rules() -> list[Rule]:
    return [
        Rule("assign", _assign(), _assigned_length),
        Rule("access", seq(word("AKIA"), plus(chars(UPPER + DIGITS))), lambda m: len(m) >= 20),
        Rule("hex", at_least(chars(DIGITS + "abcdef"), 24)),
    ]


def further_rules() -> list[Rule]:
    """Formats of widely used keys; they add spans to the base ones."""
    url = chars(UPPER + LOWER + DIGITS + "_-")
    alnum = chars(UPPER + LOWER + DIGITS)
    return [
        Rule("github", seq(word("gh"), chars("pousr"), word("_"), plus(alnum)), lambda m: len(m) >= 40),
        Rule("google", seq(word("AIza"), plus(url)), lambda m: len(m) >= 39),
        Rule("private_key", seq(word("-----BEGIN "), star(chars(UPPER + " ")), word("PRIVATE KEY-----"))),
    ]


class Scanner:
    def __init__(self, rules: list[Rule]):
        self.rules = rules
        self.rows = compile_all([r.pattern for r in rules], anywhere=True)
        self.forward = [compile_all([r.pattern], anywhere=False)[0] for r in rules]
        self.backward = [compile_all([r.pattern.reversed()], anywhere=False)[0] for r in rules]

    @staticmethod
    def _longest(row: list, data: bytes, positions: range) -> int:
        """How many of the bytes at ``positions`` the longest match takes; 0 without a match."""
        best = 0
        for n, at in enumerate(positions, 1):
            row = row[data[at]]
            if row[256] > 0:
                best = n
            elif row[256] < 0:
                break
        return best

    def ends(self, data: bytes) -> list[tuple[int, int]]:
        """(position, rules) wherever the set of rules that can end changes; one pass over all bytes."""
        row, before, found = self.rows[0], 0, []
        for at, byte in enumerate(data):
            row = row[byte]
            if row[256] is not before:
                before = row[256]
                found.append((at, before))
        return found

    def spans(self, text: str) -> list[tuple[int, int, int]]:
        """(start, rule, end) in code points, ordered by start, then rule.

        A text is scanned as one byte per code point; code points that no rule can hold become ``?``.
        """
        data = text.encode("latin-1", "replace")
        changes = self.ends(data)
        spans = []
        for i, rule in enumerate(self.rules):
            done, bit, runs, since = 0, 1 << i, [], None
            for at, mask in changes:
                if mask & bit and since is None:
                    since = at
                elif not mask & bit and since is not None:
                    runs.append((since, at))
                    since = None
            if since is not None:
                runs.append((since, len(data)))
            for first, last in runs:  # a match can end at each byte of the run
                at = max(first, done)
                while at < last:
                    taken = self._longest(self.backward[i], data, range(at, done - 1, -1))
                    if not taken:
                        at += 1
                        continue
                    start = at + 1 - taken
                    done = start + self._longest(self.forward[i], data, range(start, len(data)))
                    if rule.keep(text[start:done]):
                        spans.append((start, i, done))
                    at = max(at + 1, done)
        return sorted(spans)


@cache
def default_scanner() -> Scanner:
    return Scanner([*base_rules(), *further_rules()])


def scan(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: its key, and for each span in order its kind, start and end (code points, end exclusive).

    Null and empty texts have no spans; repeated rows are scanned one by one; other columns are not read.
    """
    ddl = f"{key} long, kinds array<int>, starts array<int>, ends array<int>"

    def rows(keys: list, texts: list) -> dict[str, list]:
        found = [default_scanner().spans(t) for t in texts]
        return {
            key: keys, "kinds": [[k for _, k, _ in f] for f in found],
            "starts": [[s for s, _, _ in f] for f in found], "ends": [[e for _, _, e in f] for f in found],
        }

    return map_texts(documents, key, text, ddl, rows)


def mask(text: str | None) -> str | None:
    """The text with every span replaced by its kind in brackets; overlapping spans become one."""
    if not text:
        return text
    scanner, out, done = default_scanner(), [], 0
    for start, kind, end in scanner.spans(text):
        if start >= done:
            out += [text[done:start], f"[{scanner.rules[kind].kind}]"]
        done = max(done, end)
    return "".join([*out, text[done:]])
