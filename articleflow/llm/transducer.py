"""Token counts of a byte-fallback BPE vocabulary from a finite-state transducer, compiled while it is used.

A BPE encoding is fixed by its neighbouring pairs: each prefix of a text has exactly one possible last
token, namely the one that may follow the last token of what is left before it. A state is therefore
the longest suffix that can still grow into a vocabulary entry, with the last token and the relative
count at each position inside it. Transitions carry the number of tokens they add (negative when a
merge takes tokens back), and sum to the count of the text.

No entry crosses from another character to a word mark, so a word mark after another character always
leads to the same state. The state map of a word is then a constant, and maps of blocks of text compose
in any grouping: a block is its unfinished first word, the count of its whole words, and its unfinished
last word.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass

MARK = "▁"
UNKNOWN = "\0unknown"
START = "\0start"
_WORDS = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")
#: Compiled states and remembered words are dropped beyond these numbers; they are found again when needed.
MAX_STATES = 400_000
MAX_WORDS = 250_000
BLOCK = 1 << 16


class State(dict):
    """Transitions by character: (state, tokens added)."""

    __slots__ = ("history", "suffix")

    def __init__(self, suffix: str, history: tuple[tuple[str, int] | None, ...]):
        self.suffix = suffix
        #: (last token, count relative to here) before each suffix, by its length from 0 up; None where no entry
        #: begins with that suffix.
        self.history = history


class Vocabulary:
    """Entries with scores; a pair of neighbours merges into an entry, best score first, leftmost on ties."""

    def __init__(self, scores: dict[str, float]):
        self.scores = scores
        self.longest = max(map(len, scores), default=1)
        self.prefixes = {p[:n] for p in scores for n in range(1, len(p) + 1)}
        self._pairs: dict[tuple[str, str], bool] = {}

    @classmethod
    def from_model(cls, path: str) -> Vocabulary:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        skip = (model.is_control, model.is_unknown, model.is_byte)
        return cls({
            model.id_to_piece(i): model.get_score(i)
            for i in range(model.get_piece_size())
            if not any(test(i) for test in skip)
        })

    def encode(self, text: str) -> list[str]:
        """The encoding of a short text by its definition."""
        parts = list(text)
        while True:
            best, at = None, -1
            for i in range(len(parts) - 1):
                score = self.scores.get(parts[i] + parts[i + 1])
                if score is not None and (best is None or score > best):
                    best, at = score, i
            if best is None:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def may_follow(self, left: str, right: str) -> bool:
        if left in (START, UNKNOWN):
            return True
        key = (left, right)
        fits = self._pairs.get(key)
        if fits is None:
            fits = self._pairs[key] = self.encode(left + right) == [left, right]
        return fits


class Counter:
    """Counts tokens of texts; the transducer and the words it has seen are kept between texts."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        self.reset()

    def reset(self) -> None:
        self.states: dict[tuple, State] = {}
        self.words: dict[str, int] = {}
        self.links: dict[tuple[str, int], tuple[str, int]] = {}
        self.start = self._state("", ((START, 0),))

    def _state(self, suffix: str, history: tuple[tuple[str, int] | None, ...]) -> State:
        return self.states.setdefault((suffix, history), State(suffix, history))

    def _advance(self, state: State, char: str) -> tuple[State, int]:
        """Compile one transition."""
        vocabulary = self.vocabulary
        if char not in vocabulary.prefixes:  # spelled as bytes; nothing merges across it
            move = (self._state("", ((UNKNOWN, 0),)), len(char.encode()))
        else:
            grown = state.suffix + char
            for n in range(min(len(grown), vocabulary.longest), 0, -1):
                token = grown[len(grown) - n :]
                if state.history[n - 1] is None:
                    continue
                left, before = state.history[n - 1]
                if (n == 1 or token in vocabulary.scores) and vocabulary.may_follow(left, token):
                    break
            else:
                raise ValueError(f"no token can end {grown!r}")
            added = before + (1 if token in vocabulary.scores else len(char.encode()))
            keep = next(k for k in range(len(grown), -1, -1) if k == 0 or grown[len(grown) - k :] in vocabulary.prefixes)
            link = self.links.setdefault
            history = (link(key := (token, 0), key), *(
                link(key := (h[0], h[1] - added), key) if h and grown[len(grown) - k :] in vocabulary.prefixes else None
                for k, h in enumerate(state.history[:keep], 1)
            ))
            move = (self._state(grown[len(grown) - keep :], history), added)
        state[char] = move
        return move

    def word(self, text: str) -> int:
        """Tokens of one word, its marks included."""
        state, total = self.start, 0
        for char in text:
            state, added = state.get(char) or self._advance(state, char)
            total += added
        return total

    def of_words(self, words: Sequence[str]) -> int:
        """Tokens of words; one without any mark stands for itself after one mark."""
        known = self.words
        try:
            return sum(map(known.__getitem__, words))
        except KeyError:
            if len(known) > MAX_WORDS:
                known.clear()
            if len(self.states) > MAX_STATES:
                self.reset()
                known = self.words
            for w in words:
                if w not in known:
                    known[w] = self.word(w if MARK in w else MARK + w)
            return sum(map(known.__getitem__, words))

    def block(self, text: str) -> Block:
        """The state map of a block of marked text."""
        parts = text.split(MARK)
        if len(parts) > 2 and "" not in parts[1:]:
            head, tail = parts[0], MARK + parts[-1]
            inner = parts[1:-1]
            if not head:
                head, inner = MARK + inner[0], inner[1:]
        else:
            head, *inner = _WORDS.findall(text)
            if not inner:
                return Block(head, None, "")
            *inner, tail = inner
        return Block(head, self.of_words(inner), tail)

    def join(self, left: Block, right: Block) -> Block:
        """The map of two neighbouring blocks."""
        before = left.head if left.count is None else left.tail
        seam = not before.endswith(MARK) and right.head.startswith(MARK)
        words = [before, right.head] if seam else [before + right.head]
        if left.count is not None:
            words.insert(0, left.head)
        if right.count is not None:
            words.append(right.tail)
        if len(words) == 1:
            return Block(words[0], None, "")
        return Block(words[0], (left.count or 0) + (right.count or 0) + self.of_words(words[1:-1]), words[-1])

    def count(self, text: str, block: int = BLOCK) -> int:
        """Tokens of a whole text, without begin, end or added tokens: a scan over the maps of its blocks."""
        if not text:
            return 0
        marked = MARK + text.replace(" ", MARK)
        maps = [self.block(marked[i : i + block]) for i in range(0, len(marked), block)]
        while len(maps) > 1:  # neighbours pairwise, in rounds
            pairs = [self.join(*maps[i : i + 2]) for i in range(0, len(maps) - 1, 2)]
            maps = pairs + maps[len(maps) - len(maps) % 2 :]
        whole = maps[0]
        return self.of_words([w for w in (whole.head, whole.tail) if w]) + (whole.count or 0)


@dataclass(frozen=True)
class Block:
    """``count`` is None for a block inside one word, which ``head`` then holds."""

    head: str
    count: int | None
    tail: str
