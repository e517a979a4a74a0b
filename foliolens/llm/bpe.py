"""Whole-text encoding with the tokenizers library, one call for each distinct word that is not known yet.

A pre-tokenizer that never lets a token run from a non-space character into the white space after it
encodes a text as the concatenation of its words, each with the blank or line end before it. Both vocabularies
used here are of that kind, so the result equals encoding the whole text (tests compare the two). Arrow splits
the texts of a batch and numbers their distinct words; those are looked up in a memo, the library encodes the
rest, and the ids are gathered by the words' numbers. No Python code runs for each word of a text.

Texts with other gaps than single blanks and line ends go by stretches: white space, then what follows up to
the next white space.

Memory is bounded: the memo, an Arrow array of words and one array of ids, holds at most `memo` words of
`longest` bytes, takes no more when it is full, and starts anew when what it holds no longer fits the texts.
"""

from __future__ import annotations

import os
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# A stretch ends only where a character that is not white space meets a plain blank, tab or line end;
# rarer white space (no-break blanks, separators) stays inside, because libraries differ over it.
STRETCH = re.compile(r"\s*\S+(?:[^\S \t\n\r]\s*\S*)*|\s+")

#: Marks that follow a letter as a token of their own. Letters that may end with a combining mark in lower case or
#: in composed form (U+0130, U+0958) are not among these.
MARKS = ".,;:!?"
_MARKED = rf"([A-Z\p{{Ll}}])[{MARKS}]\z"
#: A word that ends with white space, of any kind.
_OPEN_END = r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]\z"
#: Words of one pre-token: letters that stay letters in lower case and composed form.
_LETTERS = r"\A[A-Z\p{Ll}]+\z"
#: Bytes of texts that are looked up together.
TOGETHER = 8 << 20


def spread(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """starts[k], starts[k] + 1, ... for lengths[k] numbers each, one after another."""
    ends = np.cumsum(lengths)
    return np.repeat(starts - (ends - lengths), lengths) + np.arange(int(ends[-1]) if len(ends) else 0)


class Pool:
    """Lists of ids one after another, in an array that grows."""

    def __init__(self):
        self.ids, self.used = np.empty(1 << 16, dtype="<i4"), 0

    def put(self, ids: np.ndarray, keep: int) -> int:
        """Write ids behind what is used and return their place; only the first `keep` of them stay."""
        at, end = self.used, self.used + len(ids)
        if end > len(self.ids):
            self.ids = np.concatenate([self.ids[:at], np.empty(max(end, at // 2) + len(ids) - at // 2, dtype="<i4")])
        self.ids[at:end] = ids
        self.used += keep
        return at


class StretchEncoder:
    """encode_column(texts) -> number of ids of each text, and all ids one after another."""

    def __init__(self, path: str, memo: int = 500_000, longest: int = 40):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.memo, self.longest = Tokenizer.from_file(path), memo, longest
        # A special token cannot be part of another token, so it parts the words of one call.
        self.stop, self.stop_id = next((t.content, k) for k, t in self.tokenizer.get_added_tokens_decoder().items() if t.special)
        self.bare = len(self.whole("\n a")) == len(self.whole("a")) and self.whole("\na") == self.whole("a")  # this vocabulary drops white space
        self.lower = self.whole("ABC") == self.whole("abc")  # and lower case
        self.marks = [self.whole(m) for m in MARKS]
        # Letters parted by blanks are one pre-token each, and tokens tell where one ends or the next begins.
        names = sorted(self.tokenizer.get_vocab().items(), key=lambda item: item[1])
        size = names[-1][1] + 1
        self.ends, self.begins = np.zeros(size, dtype=bool), np.zeros(size, dtype=bool)
        for name, k in names:
            self.ends[k], self.begins[k] = name.endswith("</w>"), name.startswith("Ġ")
        if any(len(m) != 1 for m in self.marks):
            raise ValueError("a mark is not one token")
        self._forget()

    def _forget(self) -> None:
        """Words without a mark at their end, and where their ids stand in the pool."""
        self.known, self.starts, self.lengths, self.missed, self.pool = pa.array([], pa.string()), np.empty(0, np.int64), np.empty(0, np.int64), 0, Pool()

    def whole(self, text: str) -> list[int]:
        """The library's ids of a text, without a memo."""
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def _each(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of ids, and ids, of words that are encoded by themselves."""
        if not words:
            return np.empty(0, np.int64), np.empty(0, "<i4")
        if any("<|" in w for w in words):  # special tokens inside words
            lists = [self.whole(w) for w in words]
            return np.array([len(x) for x in lists], np.int64), np.array([k for x in lists for k in x], "<i4")
        ids = np.array(self.tokenizer.encode_batch_fast([self.stop.join(words)], add_special_tokens=False)[0].ids, dtype="<i4")
        stops = np.flatnonzero(ids == self.stop_id)
        return np.diff(np.concatenate([[-1], stops, [len(ids)]])) - 1, np.delete(ids, stops)

    def _blank_joined(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """As _each, of words of letters only, each behind a blank: in one call, without stops between them."""
        if not len(words):
            return np.empty(0, np.int64), np.empty(0, "<i4")
        listed = words.to_pylist()
        ids = np.array(self.tokenizer.encode_batch_fast([" " + " ".join(listed)], add_special_tokens=False)[0].ids, dtype="<i4")
        if self.bare:
            edges = np.concatenate([[0], np.flatnonzero(self.ends[ids]) + 1])
        else:
            edges = np.concatenate([np.flatnonzero(self.begins[ids]), [len(ids)]])
        if len(edges) != len(listed) + 1 or edges[0] or edges[-1] != len(ids):  # a vocabulary of another kind
            return self._each([" " + w for w in listed])
        return np.diff(edges), ids

    def _encoded(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """An order of words that puts those of letters first, and in it their numbers of ids, and ids."""
        letters = pc.match_substring_regex(words, _LETTERS).to_numpy(zero_copy_only=False)
        order = np.concatenate([np.flatnonzero(letters), np.flatnonzero(~letters)])
        n, ids = self._blank_joined(words.filter(pa.array(letters)))
        m, more = self._each([w if self.bare or w[:1] == "\n" else " " + w for w in words.filter(pa.array(~letters)).to_pylist()])
        return order, np.concatenate([n, m]), np.concatenate([ids, more])

    def _places(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Where the ids of distinct words stand in the pool, and their numbers; new words are encoded."""
        at = pc.fill_null(pc.index_in(words, value_set=self.known), -1).to_numpy().astype(np.int64)
        new = np.flatnonzero(at < 0)
        starts, lengths = np.empty(len(at), np.int64), np.empty(len(at), np.int64)
        old = np.flatnonzero(at >= 0)
        starts[old], lengths[old] = self.starts[at[old]], self.lengths[at[old]]
        if len(new):
            self.missed += len(new)
            if self.missed > 3 * self.memo and len(self.known) >= self.memo:
                self._forget()
                return self._places(words)
            order, n, ids = self._encoded(words.take(pa.array(new)))
            new, first = new[order], np.cumsum(n) - n
            short = np.flatnonzero(pc.binary_length(words).to_numpy()[new] <= self.longest)[: self.memo - len(self.known)]
            if len(short):
                kept = new[short]
                at = self.pool.put(ids[spread(first[short], n[short])], int(n[short].sum()))
                self.known = pa.concat_arrays([self.known, words.take(pa.array(kept))])
                self.starts, self.lengths = np.concatenate([self.starts, at + np.cumsum(n[short]) - n[short]]), np.concatenate([self.lengths, n[short]])
            starts[new], lengths[new] = self.pool.put(ids, 0) + first, n
        return starts, lengths

    def _words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Numbers of ids of distinct words, where those stand, and all ids. A full stop or the like after a
        letter is a token of its own: the word before it is looked up alone."""
        cores = pc.replace_substring_regex(words, _MARKED, r"\1")
        marked = np.flatnonzero(pc.not_equal(pc.binary_length(cores), pc.binary_length(words)).to_numpy(zero_copy_only=False))
        if self.lower:  # special tokens are told by their case
            cores = pc.if_else(pc.match_substring(cores, "<"), cores, pc.ascii_lower(cores))
        coded = cores.dictionary_encode()
        starts, lengths = self._places(coded.dictionary)
        which = coded.indices.to_numpy()
        starts, lengths = starts[which], lengths[which]
        n = lengths.copy()
        n[marked] += 1
        ends = np.cumsum(n)
        ids = np.empty(int(ends[-1]) if len(ends) else 0, dtype="<i4")
        ids[spread(ends - n, lengths)] = self.pool.ids[spread(starts, lengths)]
        last = pc.utf8_slice_codeunits(words.take(pa.array(marked)), -1)
        ids[ends[marked] - 1] = np.array([m[0] for m in self.marks], "<i4")[pc.index_in(last, value_set=pa.array(list(MARKS))).to_numpy()]
        return n, ends - n, ids

    def _together(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        split = pc.split_pattern(pc.replace_substring(texts, "\n", " " if self.bare else " \n"), " ")
        bounds = split.offsets.to_numpy().astype(np.int64)
        bounds = bounds - bounds[0]
        words = split.flatten().dictionary_encode()
        which, distinct = words.indices.to_numpy().astype(np.int64), words.dictionary
        n, starts, ids = self._words(distinct)
        length, start = n[which], starts[which]
        if not self.bare:
            first = bounds[:-1]
            odd = pc.or_(pc.match_substring_regex(distinct, _OPEN_END), pc.equal(distinct, "")).to_numpy(zero_copy_only=False)[which]
            # A text may begin with a line end, or be empty: then its first word is empty.
            odd[first] &= ~pc.or_(pc.equal(texts, ""), pc.starts_with(texts, "\n")).to_numpy(zero_copy_only=False)
            slow = np.logical_or.reduceat(odd, first) if len(first) else np.empty(0, bool)
            begun = distinct.take(pa.array(which[first])).dictionary_encode()
            m, more = self._each(begun.dictionary.to_pylist())
            at = begun.indices.to_numpy()
            length[first], start[first] = m[at], (len(ids) + np.cumsum(m) - m)[at]
            ids = np.concatenate([ids, more])
            if slow.any():
                length[np.repeat(slow, np.diff(bounds))] = 0
                lists = [self._each(STRETCH.findall(t))[1] for t in texts.filter(pa.array(slow)).to_pylist()]
                m = np.array([len(x) for x in lists], np.int64)
                length[first[slow]], start[first[slow]] = m, len(ids) + np.cumsum(m) - m
                ids = np.concatenate([ids, *lists])
        return np.add.reduceat(length, bounds[:-1]) if len(texts) else np.empty(0, np.int64), ids[spread(start, length)]

    def encode_column(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """A null text is empty."""
        texts = pc.fill_null(texts.cast(pa.string()), "")
        size, at, out = np.cumsum(pc.binary_length(texts).to_numpy().astype(np.int64)), 0, [(np.empty(0, np.int64), np.empty(0, "<i4"))]
        while at < len(texts):
            end = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + TOGETHER, side="right")))
            out.append(self._together(texts.slice(at, end - at)))
            at = end
        return np.concatenate([n for n, _ in out]), np.concatenate([ids for _, ids in out])

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian 32-bit integers."""
        n, ids = self.encode_column(pa.array(texts, type=pa.string()))
        ends = np.cumsum(n)
        return [ids[e - k : e].tobytes() for k, e in zip(n.tolist(), ends.tolist(), strict=True)]


_ENCODERS: dict[str, StretchEncoder] = {}


def encoder(path: str) -> StretchEncoder:
    """One encoder for each Python worker and vocabulary."""
    if path not in _ENCODERS:
        _ENCODERS[path] = StretchEncoder(path)
    return _ENCODERS[path]


def id_lists(path: str, texts: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of ids with the end id of each text, and all ids one after another."""
    n, ids = encoder(path).encode_column(texts)
    return n + 1, np.insert(ids, np.cumsum(n), end_id)
