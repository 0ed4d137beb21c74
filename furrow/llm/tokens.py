"""Token ids of whole texts, by a file of the tokenizers library.

The library's cost is per occurrence, and texts repeat their words. So a text is cut at spaces, where
no token of these vocabularies crosses, equal pieces of a batch are found with one hash pass, and the
library encodes what this worker has not seen lately. The ids are those of the whole text: a piece starts
with a space before a visible character, and the pre-tokenizers always cut there.
"""

from __future__ import annotations

import os
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from furrow.llm import common as C
from furrow.llm.bytehash import RunHash, bytes_of

# Characters before which a text may be cut: visible ASCII, and letters and signs of European scripts, among which
# there is neither white space in anybody's definition nor a mark that combines with what stands before.
AFTER = r"!-~\x{a1}-\x{2ff}\x{370}-\x{482}\x{48a}-\x{590}"
# A text with white space that something else follows is cut one by one, by CUT.
ODD = f"[ \\n]([^{AFTER}]|$)"
CUT = re.compile(r" (?=[!-~¡-˿Ͱ-҂Ҋ-֐])")
# A word of Latin letters with a line feed before it or marks after it; the vocabularies cut between them. An apostrophe
# is no mark, since they keep it with the letters of a contraction.
LETTERS = "[A-Za-z\\x{c0}-\\x{d6}\\x{d8}-\\x{f6}\\x{f8}-\\x{ff}]+"
WORD = f"^(?P<feed>\\n?)(?P<word> ?{LETTERS})(?P<mark>[!-&(-/:-@\\[-`{{-~]*)$"
PLAIN_WORD = f"^ {LETTERS}$"
# Pieces and words a worker remembers; beyond that it forgets all and starts anew. No text is treated differently for it.
REMEMBERED = 1_000_000


class Known:
    """Strings and their ids, in Arrow and numpy arrays: a million take some 50 MB."""

    def __init__(self, dtype: np.dtype):
        self.strings = pa.array([], pa.string())
        self.hashes, self.place = np.zeros(0, np.uint64), np.zeros(0, np.int64)  # in order of the hashes
        self.pool, self.begin, self.count = np.zeros(0, dtype), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def find(self, strings: pa.Array) -> np.ndarray:
        """Number of each string, -1 where it isn't known. Found by a hash, then compared."""
        if not len(self.place) or not len(strings):
            return np.full(len(strings), -1)
        h = string_hashes(strings)
        at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
        number = self.place[at]
        same = pc.equal(self.strings.take(pa.array(number)), strings).to_numpy(zero_copy_only=False)
        return np.where((self.hashes[at] == h) & same, number, -1)

    def add(self, strings: pa.Array, pool: np.ndarray, count: np.ndarray) -> None:
        h = string_hashes(strings)
        order = np.argsort(h, kind="stable")
        at = np.searchsorted(self.hashes, h[order])
        self.hashes = np.insert(self.hashes, at, h[order])
        self.place = np.insert(self.place, at, len(self.place) + order)
        self.begin = np.concatenate((self.begin, len(self.pool) + np.cumsum(count) - count))
        self.count = np.concatenate((self.count, count))
        self.pool = np.concatenate((self.pool, pool))
        self.strings = pa.concat_arrays([self.strings, strings])

    def gather(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of these strings end to end, and how many each has."""
        count = self.count[numbers]
        return self.pool[places(self.begin[numbers], count)], count


@lru_cache(maxsize=None)
def string_hash() -> RunHash:
    return RunHash(3)


def string_hashes(strings: pa.Array) -> np.ndarray:
    data, offsets = bytes_of(strings)
    hashed = string_hash()
    return hashed.runs(hashed.prefix(data), offsets[:-1], offsets[1:])


class Encoder:
    """Encodes Arrow arrays of texts; made once for each worker and vocabulary."""

    made: dict[str, Encoder] = C.KEPT.setdefault("encoders", {})

    @classmethod
    def of(cls, path: str) -> Encoder:
        if path not in cls.made:
            cls.made[path] = cls(path)
        return cls.made[path]

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
        size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.dtype = np.dtype("<u2") if size <= 1 << 16 else np.dtype("<u4")
        # tokens that can only begin a word with a space before it, or only end one
        suffix = getattr(self.tokenizer.model, "end_of_word_suffix", None)
        self.first, self.last = np.zeros(size, bool), np.zeros(size, bool)
        for token, number in self.tokenizer.get_vocab(with_added_tokens=False).items():
            self.first[number] = token.startswith("Ġ")
            self.last[number] = bool(suffix) and token.endswith(suffix)
        self.pieces, self.words = Known(self.dtype), Known(self.dtype)

    def _learn_words(self, words: pa.Array) -> np.ndarray:
        """Encodes words that aren't known, and returns the order in which it notes them. Those that begin
        with a space are encoded side by side."""
        listed = words.to_pylist()
        side = pc.match_substring_regex(words, PLAIN_WORD).to_numpy(zero_copy_only=False)
        order = np.concatenate((np.flatnonzero(side), np.flatnonzero(~side)))
        plain = [listed[i] for i in np.flatnonzero(side).tolist()]
        pools, counts = [], []
        for first in range(0, len(plain), 1000):
            part = plain[first : first + 1000]
            ids, count = self._side_by_side(part)
            pools.append(ids)
            counts.append(count)
        others = [listed[i] for i in np.flatnonzero(~side).tolist()]
        for found in self.tokenizer.encode_batch_fast(others, add_special_tokens=False):
            pools.append(np.array(found.ids, self.dtype))
            counts.append(np.array([len(pools[-1])]))
        if listed:
            strings = pa.array(plain + others, pa.string())
            self.words.add(strings, np.concatenate(pools), np.concatenate(counts).astype(np.int64))
        return order

    def _side_by_side(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words that each begin with a space, and how many each has. The words' first or last tokens tell
        where they part, so the library need not note the place of each token."""
        text = ["".join(words)]
        ids = np.array(self.tokenizer.encode_batch_fast(text, add_special_tokens=False)[0].ids, self.dtype)
        for edge, last in ((self.first, 0), (self.last, 1)):
            cuts = np.flatnonzero(edge[ids])
            if len(cuts) == len(words) and (cuts[-1] == len(ids) - 1 if last else cuts[0] == 0):
                return ids, np.diff(cuts, prepend=-1) if last else np.diff(cuts, append=len(ids))
        found = self.tokenizer.encode_batch(text, add_special_tokens=False)[0]
        return np.array(found.ids, self.dtype), np.bincount(found.word_ids, minlength=len(words))

    def _learn(self, pieces: pa.Array) -> None:
        """Takes pieces apart into line feed, word and mark, and notes the ids of each whole piece."""
        taken = pc.extract_regex(pieces, WORD)
        parts = [pc.struct_field(taken, [k]) for k in range(3)]
        word = pc.if_else(pc.is_null(taken), pieces, parts[1])
        three = [pc.fill_null(parts[0], ""), word, pc.fill_null(parts[2], "")]
        coded = pa.concat_arrays(three).dictionary_encode()
        wanted, codes = coded.dictionary, coded.indices.to_numpy().reshape(3, -1).T.ravel()
        known = self.words.find(wanted)
        if len(self.words.count) + int((known < 0).sum()) > REMEMBERED:
            self.words = Known(self.dtype)
            known[:] = -1
        missing = np.flatnonzero(known < 0)
        first = len(self.words.count)
        order = self._learn_words(wanted.take(pa.array(missing)))
        known[missing[order]] = first + np.arange(len(missing))
        pool, count = self.words.gather(known[codes])
        self.pieces.add(pieces, pool, count.reshape(-1, 3).sum(axis=1))

    def _numbers(self, pieces: pa.Array) -> np.ndarray:
        """Numbers of distinct pieces among the known ones, after learning those that weren't."""
        numbers = self.pieces.find(pieces)
        missing = numbers < 0
        if missing.any():
            if len(self.pieces.count) + int(missing.sum()) > REMEMBERED:
                self.pieces = Known(self.dtype)
                missing[:] = True
            numbers[missing] = len(self.pieces.count) + np.arange(int(missing.sum()))
            self._learn(pieces.filter(pa.array(missing)))
        return numbers

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts end to end, and the n + 1 offsets; null counts as empty."""
        texts = texts.fill_null("") if texts.null_count else texts
        odd = pc.match_substring_regex(texts, ODD).to_numpy(zero_copy_only=False)
        if not odd.any():
            return self._encode_plain(texts)
        # encode the two kinds apart, then bring the texts into their order
        ids, counts = [], np.zeros(len(texts), np.int64)
        for mask, encode in ((~odd, self._encode_plain), (odd, self._encode_odd)):
            found, offsets = encode(texts.filter(pa.array(mask)))
            ids.append(found)
            counts[mask] = np.diff(offsets)
        pool = np.concatenate(ids)
        where = np.empty(len(texts), np.int64)
        order = np.concatenate((np.flatnonzero(~odd), np.flatnonzero(odd)))
        where[order] = np.cumsum(counts[order]) - counts[order]
        return pool[places(where, counts)], np.concatenate(([0], np.cumsum(counts)))

    def _encode_plain(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        # a piece starts at each space and each line feed
        lists = pc.split_pattern(pc.replace_substring(texts, "\n", " \n"), " ")
        offsets = lists.offsets.to_numpy().astype(np.int64)
        found = lists.flatten().dictionary_encode()
        words, codes = found.dictionary, found.indices.to_numpy().astype(np.int64)
        offsets = offsets - offsets[0]
        # a piece stands after a space, unless it starts with a line feed or the text
        fed = pc.starts_with(words, "\n")
        pieces = pc.if_else(fed, words, pc.binary_join_element_wise(" ", words, ""))
        first = offsets[:-1][np.diff(offsets) > 0]
        heads, inverse = np.unique(codes[first], return_inverse=True)
        heads = words.take(pa.array(heads))
        # a text may start with a line feed: that piece is known already
        number = np.concatenate(self._distinct(pieces, heads))
        codes[first] = len(pieces) + inverse
        return self._gather(number[codes], offsets)

    def _distinct(self, pieces: pa.Array, heads: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        both = pa.concat_arrays([pieces, heads]).dictionary_encode()
        number = self._numbers(both.dictionary)[both.indices.to_numpy()]
        return number[: len(pieces)], number[len(pieces) :]

    def _encode_odd(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        number: dict[str, int] = {}
        codes, offsets = [], [0]
        for text in texts.to_pylist():
            cut = CUT.split(text)
            codes += [number.setdefault(x if i == 0 else " " + x, len(number)) for i, x in enumerate(cut)]
            offsets.append(len(codes))
        numbers = self._numbers(pa.array(list(number), pa.string()))
        return self._gather(numbers[np.array(codes, np.int64)], np.array(offsets, np.int64))

    def _gather(self, numbers: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        ids, count = self.pieces.gather(numbers)
        return ids, np.concatenate(([0], np.cumsum(count)))[offsets]


def places(begin: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The places ``begin[i] .. begin[i] + count[i] - 1`` of all i, one after another."""
    ends = np.cumsum(count)
    total = int(ends[-1]) if len(ends) else 0
    return np.arange(total) + np.repeat(begin - (ends - count), count)
