"""Token ids of whole texts by the tokenizers library, with a bounded memory for words seen before.

Neither of the two kinds of vocabulary lets a token span a blank between two other characters, so words
between single blanks are encoded once and their ids joined. Texts with any other white space around
blanks are cut at line ends only where that is exact, else encoded whole.
"""

from __future__ import annotations

import os
import re
from array import array
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of the words that a worker remembers, about; beyond it the memory starts anew. Longer words are not remembered.
MAX_BYTES = 256 << 20
LONGEST_KEPT = 64
#: Characters of texts whose words are learned together.
CHUNK_CHARS = 1 << 22
_ODD = re.compile(r"[\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\t\r\v\f]")
#: Byte-level vocabularies spell bytes as letters: printable Latin-1 as itself, the others from U+0100 up in order.
_PRINTABLE = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
BYTE_LETTERS = {b: 0x100 + i for i, b in enumerate(sorted(set(range(256)) - set(_PRINTABLE)))}
#: By byte, line ends as themselves: they stand between words that are spelled together.
LETTERS = np.array([10 if b == 10 else BYTE_LETTERS.get(b, b) for b in range(256)], "<u4")
#: A word of letters and the run of marks behind it, which both vocabularies cut off as one piece.
MARKS = ".,;:!?#*$%&"
PLAIN = "^ ?[A-Za-zÀ-ÖØ-öø-ÿ]+$"
LETTER_CHARS = " " + "".join(chr(c) for c in [*range(65, 91), *range(97, 123), *range(0xC0, 0x100)] if c not in (0xD7, 0xF7))


class Encoder:
    """``blanks`` tells whether a word's token carries the blank before it (else blanks have no tokens).

    Words of a chunk are told apart by Arrow, so Python sees each different one once. What a worker remembers
    are stems, runs of marks and other words: each has a slot, whose ids are one span of a common array.
    """

    def __init__(self, path: str, blanks: bool):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        #: The same model for single words, which need no cutting; they are spelled in its byte letters here.
        self.single = Tokenizer(self.tokenizer.model)
        self.blanks = blanks
        self.separator = "\0" if blanks else " "
        self.forget()

    def forget(self) -> None:
        self.slots: dict[str, int] = {"": 0}
        self.ids = np.zeros(0, "<u4")
        self.ends = np.zeros(2, np.int64)  # slot i has the ids from ends[i] up to ends[i + 1]
        self.held = 0

    def _single_ids(self, stems: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words of letters, one after the other, and how many each has."""
        letters = LETTERS[np.frombuffer("\n".join(stems).encode(), np.uint8)]
        found = self.single.encode(letters.tobytes().decode("utf-32-le").split("\n"), is_pretokenized=True, add_special_tokens=False)
        return np.array(found.ids, "<u4"), np.bincount(np.array(found.word_ids, np.int64), minlength=len(stems))

    def _learn(self, words: list[str], wanted: list[int], n_stems: int, slots: np.ndarray) -> None:
        """Give slots to the words at these places, of which the first ``n_stems`` are words of letters."""
        if not wanted:
            return
        slots[wanted] = np.arange(len(self.ends) - 1, len(self.ends) - 1 + len(wanted))
        stems = [words[i] for i in wanted if i < n_stems]
        rest = [words[i] for i in wanted if i >= n_stems]
        ids, counts = [self.ids], [np.diff(self.ends)]
        if stems:
            more, sizes = self._single_ids(stems)
            ids.append(more)
            counts.append(sizes)
        if rest:
            found = [e.ids for e in self.tokenizer.encode_batch_fast(rest, add_special_tokens=False)]
            ids.append(np.array([i for f in found for i in f], "<u4"))
            counts.append(np.array([len(f) for f in found], np.int64))
        self.ids = np.concatenate(ids)
        self.ends = np.concatenate([[0], np.cumsum(np.concatenate(counts))])

    def _find(self, stems: list[str], rest: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Slots of stems and then of other words, all different; and the ids with their ends."""
        if self.held > MAX_BYTES:
            self.forget()
        known = self.slots
        words = [*stems, *rest]
        slots = np.fromiter(map(known.get, words, repeat(-1)), np.int64, len(words))
        new = np.flatnonzero(slots < 0).tolist()
        short = [i for i in new if len(words[i]) <= LONGEST_KEPT]
        self._learn(words, short, len(stems), slots)
        known.update((words[i], s) for i, s in zip(short, slots[short].tolist(), strict=True))
        self.held += sum(150 + 8 * len(words[i]) for i in short)
        kept = self.ids, self.ends
        if len(short) < len(new):  # long words have slots for this call only
            self._learn(words, [i for i in new if len(words[i]) > LONGEST_KEPT], len(stems), slots)
        ids, ends = self.ids, self.ends
        self.ids, self.ends = kept
        return slots, ids, ends

    def _marked(self, text: str) -> str | None:
        """A text with separators between the words it is joined from; None for texts that only the library can cut."""
        if not self.blanks:
            # that vocabulary knows lower case only; A-Z at once, so that words share entries (a mark like <|NAME|> stays as it is)
            lowered = text if "<|" in text else text.encode().lower().decode()
            return lowered.replace("\n", " ")
        if "  " in text or " \n" in text or "\n " in text or text[0] == " " or text[-1] == " " or "\0" in text or _ODD.search(text):
            return None
        # a single line end between words is a piece of its own, several are left inside a word
        lines = text if "\n\n" in text or text[0] == "\n" or text[-1] == "\n" else text.replace("\n", "\0\n\0")
        return lines.replace(" ", "\0 ")

    def encode_all(self, texts: list[str]) -> Iterator[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers."""
        first = size = 0
        for i, text in enumerate(texts):
            size += len(text)
            if size >= CHUNK_CHARS or i + 1 == len(texts):
                yield from self._chunk(texts[first : i + 1])
                first, size = i + 1, 0

    def encode(self, text: str) -> bytes:
        return self._chunk([text])[0]

    def _chunk(self, texts: list[str]) -> list[bytes]:
        marked = [self._marked(t) if t else "" for t in texts]
        given = [m for m in marked if m]
        spans = iter(self._spans(given)) if given else iter(())
        return [
            array("I", self.tokenizer.encode(t, add_special_tokens=False).ids).tobytes() if m is None else next(spans) if m else b""
            for t, m in zip(texts, marked, strict=True)
        ]

    def _strings(self, words: pa.LargeStringArray) -> list[str]:
        """No word holds the separator, so one text of all of them is cut again; faster than one by one."""
        if not len(words):
            return []
        return pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(words)], pa.int32()), words), pa.scalar(self.separator, words.type))[0].as_py().split(self.separator)

    def _spans(self, marked: list[str]) -> list[bytes]:
        """The ids of each marked text."""
        joined = pa.array([self.separator.join(marked)], pa.large_string())
        cut = pc.split_pattern(joined, self.separator).values.dictionary_encode()
        word_of, words = cut.indices.to_numpy(), cut.dictionary
        stems = pc.utf8_rtrim(words, MARKS)
        plain = pc.match_substring_regex(stems, PLAIN)
        stems, others = pc.filter(stems, plain), pc.filter(words, pc.invert(plain))
        tails = pc.utf8_ltrim(pc.filter(words, plain), LETTER_CHARS)
        if not self.blanks:
            stems = pc.utf8_lower(stems)  # that vocabulary knows lower case only
        stems, tails = stems.dictionary_encode(), tails.dictionary_encode()
        rest = pa.concat_arrays([tails.dictionary, others]).dictionary_encode()
        n_stems, n_tails = len(stems.dictionary), len(tails.dictionary)
        slots, ids, ends = self._find(self._strings(stems.dictionary), self._strings(rest.dictionary))
        rest_slots = slots[n_stems:][rest.indices.to_numpy()]
        # two slots a word: a stem and its marks, or the word and nothing
        mask = plain.to_numpy(zero_copy_only=False)
        pair = np.zeros((len(words), 2), np.int64)
        pair[mask, 0] = slots[stems.indices.to_numpy()]
        pair[mask, 1] = rest_slots[tails.indices.to_numpy()]
        pair[~mask, 0] = rest_slots[n_tails:]
        ids, sizes = _gather(ids, ends[:-1][pair].ravel(), (ends[1:] - ends[:-1])[pair].ravel())
        sizes = sizes.reshape(-1, 2).sum(1)
        ids, sizes = _gather(ids, (np.cumsum(sizes) - sizes)[word_of], sizes[word_of])
        word_ends = np.cumsum([m.count(self.separator) + 1 for m in marked])
        id_ends = [0, *(4 * np.cumsum(sizes)[word_ends - 1]).tolist()]
        data = ids.tobytes()
        return [data[a:b] for a, b in zip(id_ends, id_ends[1:], strict=False)]


def _gather(ids: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The spans of ids one after the other, and their sizes."""
    ends = np.cumsum(sizes)
    total = int(ends[-1]) if len(ends) else 0
    return ids[np.repeat(starts - ends + sizes, sizes) + np.arange(total)], sizes


@lru_cache(maxsize=2)
def encoder(path: str, blanks: bool) -> Encoder:
    return Encoder(path, blanks)


def encoded_rows(batch: pa.RecordBatch, encode_all: Callable[[list[str]], Iterator[bytes]], step: int = 1024) -> Iterator[tuple[int | None, bytes]]:
    """(id, ids of the text) of a batch with an id and a text; null texts are empty. So many texts are held at a time, the ids of a chunk of them."""
    for at in range(0, batch.num_rows, step):
        part = batch.slice(at, step)
        texts = [t or "" for t in part.column(1).to_pylist()]
        yield from zip(part.column(0).to_pylist(), encode_all(texts), strict=True)
