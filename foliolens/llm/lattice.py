"""A trie over pre-tokens whose nodes hold the unigram forward scores of their prefixes.

The forward score of a prefix depends on the prefix alone, so pre-tokens that begin alike share it: each node
is computed once, from the nodes at most a piece's length above it. `Trie` is built from distinct pre-tokens, one
level of characters at a time, in numpy; it keeps, for each node, the best score and its number of pieces, or the
forward score and all ways to end there with their probabilities, which is what backward sampling needs.

Pieces and texts are compared with plain blanks: a piece's mark U+2581 stands for a blank, and a U+2581 in a
text is a character like others. A character that no piece covers is spelled as its UTF-8 bytes.

The vocabulary's file comes from byte-pair merges and has ranks in place of log-probabilities; a piece of rank r
gets the probability 1 / (r + 2), as in Zipf's law.
"""

from __future__ import annotations

import math
import re
from array import array
from collections.abc import Iterable

import numpy as np

BLANK = "▁"
#: A pre-token: blanks and what follows up to the next blank, or to a mark after a letter. Line ends stand alone.
#: No piece may cross a pre-token; `Pieces` refuses a vocabulary for which that does not hold.
_LETTERS, _MARKS = "A-Za-zÀ-ÖØ-öø-ɏ", ".,;:!?"
UNIT = re.compile(rf" *[{_LETTERS}]+(?=[{_MARKS}])| +[^ \n]*|[^ \n]+|\n")
_CROSSES = re.compile(rf"[^ ] |\n.|.\n|[{_LETTERS}][{_MARKS}]")
#: Log-probability of each byte of a character without a piece.
BYTE = -20.0
#: Moves from state to state that are remembered.
MOVES = 500_000


class Pieces:
    """The vocabulary of a SentencePiece model as {piece: (id, log-probability)} with plain blanks."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        model = SentencePieceProcessor(model_file=path)
        self.byte_ids, self.table, self.spelled = [0] * 256, {}, {}
        for k in range(model.get_piece_size()):
            piece = model.id_to_piece(k)
            if model.is_byte(k):
                self.byte_ids[int(piece[3:-1], 16)] = k
            elif not (model.is_control(k) or model.is_unknown(k) or model.is_unused(k)):
                text = piece.replace(BLANK, " ")
                if _CROSSES.search(text):
                    raise ValueError(f"piece {piece!r} would cross a pre-token")
                self.table[text] = (k, -math.log(len(self.table) + 2))
                self.spelled[k] = text.encode()
        for b, k in enumerate(self.byte_ids):
            self.spelled[k] = bytes([b])
        self.longest = max(map(len, self.table))
        #: What pieces end with: no piece ends at a place if none ends with the characters before it.
        self.tails = {piece[k:] for piece in self.table for k in range(len(piece))}
        # States of a text read so far: the longest beginning of a piece that it ends with, or a character that begins
        # none. For each state, how a piece can end there: log-probability, length, code, number of pieces.
        self.heads = {piece[:k] for piece in self.table for k in range(1, len(piece) + 1)}
        self.texts, self.numbers, self.moves = [""], {"": 0}, {}
        self.first, self.p, self.length, self.code, self.n = array("q", [0, 0]), array("d"), array("q"), array("q"), array("q")
        self.copied: tuple = ((),)

    def move(self, state: int, ch: str) -> int:
        """The state after one more character."""
        code = ord(ch)
        if (known := self.moves.get(state << 21 | code)) is not None:
            return known
        text = self.texts[state] + ch
        while text and text not in self.heads:
            text = text[1:]
        name = text or "\0" + ch
        if (number := self.numbers.get(name)) is None:
            number = self.numbers[name] = len(self.texts)
            ways = [(self.table[text[-k:]][1], k, self.table[text[-k:]][0], 1) for k in range(1, len(text) + 1) if text[-k:] in self.table]
            if ch not in self.table:
                size = len(ch.encode("utf-8", "surrogatepass"))
                ways.append((BYTE * size, 1, -1 - code, size))
            for column, values in zip((self.p, self.length, self.code, self.n), zip(*ways, strict=True), strict=True):
                column.extend(values)
            self.first.append(len(self.p))
            self.texts.append(text)
        if len(self.moves) < MOVES:
            self.moves[state << 21 | code] = number
        return number

    def ways(self) -> tuple[np.ndarray, ...]:
        """All states' ways as arrays: where a state's begin, and p, length, code, n; copied anew only when states were added."""
        if len(self.copied[0]) != len(self.first):
            self.copied = tuple(np.array(x) for x in (self.first, self.p, self.length, self.code, self.n))
        return self.copied

    def bytes_of(self, ids: Iterable[int]) -> bytes:
        spelled = self.spelled
        return b"".join([spelled[k] for k in ids])


def units(text: str) -> list[str]:
    """Pre-tokens of a text; one blank is put before a text that is not empty, as SentencePiece does."""
    return UNIT.findall(" " + text) if text else []


def spread(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """starts[k], starts[k] + 1, ... for lengths[k] numbers each, one after another."""
    ends = np.cumsum(lengths)
    return np.repeat(starts - (ends - lengths), lengths) + np.arange(int(ends[-1]) if len(ends) else 0)


class Trie:
    """The trie of distinct pre-tokens in ascending order: `end` has the node of each. With ways, or with counts.

    Node 0 is the root; a level's nodes follow those of the level above, in order. In a level, pre-tokens with one
    prefix stand together, since all are in order.
    """

    def __init__(self, pieces: Pieces, units: list[str], ways: bool):
        sizes = np.fromiter(map(len, units), dtype=np.int64, count=len(units))
        chars = np.frombuffer("".join(units).encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.int64)
        starts = np.cumsum(sizes) - sizes
        self.end = np.zeros(len(units), dtype=np.int64)
        self.parent, self.state = np.zeros(1, dtype=np.int64), np.zeros(1, dtype=np.int64)
        self.total, self.count = np.zeros(1), np.zeros(1, dtype=np.int64)  # forward or best scores; numbers of pieces
        first, upto, before, piece = [np.zeros(2, dtype=np.int64)], [], [], []
        live, node, depth, held, used = np.arange(len(units)), np.zeros(len(units), dtype=np.int64), 0, 1, 0
        while len(live := live[sizes[live] > depth]):
            ch, above = chars[starts[live] + depth], node[live]
            fresh = np.ones(len(live), dtype=bool)
            fresh[1:] = (above[1:] != above[:-1]) | (ch[1:] != ch[:-1])
            at, parents = np.flatnonzero(fresh), above[fresh]
            node[live] = held + np.cumsum(fresh) - 1
            self._grow(held, len(at))
            self.parent[held : held + len(at)] = parents
            state = self._states(pieces, self.state[parents], ch[at])
            self.state[held : held + len(at)] = state
            starts_of, p, length, code, n = pieces.ways()
            many = starts_of[state + 1] - starts_of[state]
            row = spread(starts_of[state], many)
            owner, begin = np.repeat(np.arange(len(at)), many), np.cumsum(many) - many
            source = self._ancestors(parents, length[row], owner)
            scores = self.total[source] + p[row]
            top = np.maximum.reduceat(scores, begin)
            if ways:
                whole, run = self._running(np.exp(scores - top[owner]), begin, many)
                self.total[held : held + len(at)] = np.where(many == 1, scores[begin], top + np.log(whole))
                share = run / whole[owner]
                share[begin + many - 1] = 1.0
                first.append(used + begin + many)
                upto.append(share)
                before.append(source)
                piece.append(code[row])
                used += len(row)
            else:  # of equal scores the longest last piece
                last = np.maximum.reduceat(np.where(scores == top[owner], np.arange(len(row)), -1), begin)
                self.total[held : held + len(at)] = top
                self.count[held : held + len(at)] = self.count[source[last]] + n[row[last]]
            held, depth = held + len(at), depth + 1
            done = live[sizes[live] == depth]
            self.end[done] = node[done]
        self.held = held
        if ways:
            join = lambda parts, kind: np.concatenate([np.empty(0, dtype=kind), *parts])
            self.ways = join(first, np.int64), join(upto, float), join(before, np.int64), join(piece, np.int64)

    def __len__(self) -> int:
        return self.held

    def _grow(self, held: int, more: int) -> None:
        if held + more > len(self.parent):
            for c in ("parent", "state", "total", "count"):
                old = getattr(self, c)
                new = np.zeros(max(2 * held, held + more), dtype=old.dtype)
                new[:held] = old[:held]
                setattr(self, c, new)

    @staticmethod
    def _states(pieces: Pieces, state: np.ndarray, ch: np.ndarray) -> np.ndarray:
        moves, back = np.unique(state << 21 | ch, return_inverse=True)
        return np.array([pieces.move(m >> 21, chr(m & 0x1FFFFF)) for m in moves.tolist()], dtype=np.int64)[back]

    def _ancestors(self, parents: np.ndarray, length: np.ndarray, owner: np.ndarray) -> np.ndarray:
        """The node `length` characters above each of owner's, whose parents are given."""
        out = parents[owner]
        far, steps = np.flatnonzero(length > 1), length
        while len(far):
            out[far] = self.parent[out[far]]
            steps = steps - 1
            far = far[steps[far] > 1]
        return out

    @staticmethod
    def _running(shares: np.ndarray, begin: np.ndarray, many: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sums and running sums of each node's shares, added up in order, so that they do not depend on other nodes."""
        run, sums = shares.copy(), shares[begin]
        for k in range(1, int(many.max())):
            more = np.flatnonzero(many > k)
            sums[more] += shares[begin[more] + k]
            run[begin[more] + k] = sums[more]
        return sums, run


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit mixing function: the random numbers of a row depend on its key and their place alone."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def sample_paths(trie: Trie, ends: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Backward sampling from each end node: piece codes in reading order, and their number for each end.

    All pre-tokens step back together; each draws from the ways into its node, u < upto. keys: one 64-bit
    key for each, mixed with the step's number.
    """
    first, upto, before, piece = trie.ways
    who, node, step = np.arange(len(ends)), ends.copy(), 0
    taken = []
    while len(who):
        with np.errstate(over="ignore"):
            u = (mixed(keys[who] + np.uint64(step + 1) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(11)).astype(np.float64) / 2.0**53
        at = first[node]
        late = np.flatnonzero(upto[at] <= u)
        while len(late):
            at[late] += 1
            late = late[upto[at[late]] <= u[late]]
        taken.append((who, piece[at]))
        node = before[at]
        live = node != 0
        who, node, step = who[live], node[live], step + 1
    if not taken:
        return np.empty(0, dtype=np.int64), np.zeros(len(ends), dtype=np.int64)
    n = np.bincount(np.concatenate([w for w, _ in taken]), minlength=len(ends))
    last = np.cumsum(n) - 1
    out = np.empty(int(n.sum()), dtype=np.int64)
    for k, (w, p) in enumerate(taken):
        out[last[w] - k] = p
    return out, n


def _ways_into(pieces: Pieces, unit: str, e: int) -> list[tuple[float, int, int, int]]:
    """The ways to end at place e: log-probability, where the piece begins, its code, its number of pieces. As `Pieces.ways`."""
    options, s, table, tails = [], e - 1, pieces.table, pieces.tails
    while s >= 0 and (piece := unit[s:e]) in tails:
        if piece in table:
            k, p = table[piece]
            options.append((p, s, k, 1))
        s -= 1
    if (ch := unit[e - 1]) not in table:
        n = len(ch.encode("utf-8", "surrogatepass"))
        options.append((BYTE * n, e - 1, -1 - ord(ch), n))
    return options


def long_count(pieces: Pieces, unit: str) -> int:
    """The number of pieces of a pre-token's best segmentation, without a trie: only the last few places are kept."""
    width = pieces.longest + 1
    best, count = [0.0] * width, [0] * width
    for e in range(1, len(unit) + 1):
        top, m = -math.inf, 0
        for p, s, _, n in _ways_into(pieces, unit, e):
            if (score := best[s % width] + p) >= top:
                top, m = score, count[s % width] + n
        best[e % width], count[e % width] = top, m
    return count[len(unit) % width]


def long_sample(pieces: Pieces, unit: str, key: np.uint64) -> np.ndarray:
    """What `sample_paths` draws for a pre-token, without a trie: the forward scores are kept, the ways into the
    places that are drawn are found anew."""
    total = array("d", [0.0])
    for e in range(1, len(unit) + 1):
        scores = [total[s] + p for p, s, _, _ in _ways_into(pieces, unit, e)]
        top = max(scores)
        whole = 0.0
        for x in scores:  # in order, as in the trie
            whole += math.exp(x - top)
        total.append(scores[0] if len(scores) == 1 else top + math.log(whole))
    codes, e, draws = array("q"), len(unit), np.empty(0)
    while e:
        if not len(codes) % 4096:
            with np.errstate(over="ignore"):
                steps = np.arange(len(codes) + 1, len(codes) + 4097, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
                draws = (mixed(key + steps) >> np.uint64(11)).astype(np.float64) / 2.0**53
        u, options = draws[len(codes) % 4096], _ways_into(pieces, unit, e)
        scores = [total[s] + p for p, s, _, _ in options]
        top = max(scores)
        shares = [math.exp(x - top) for x in scores]
        whole, run, k = 0.0, 0.0, 0
        for share in shares:
            whole += share
        while k < len(options) - 1:
            run += shares[k]
            if run / whole > u:
                break
            k += 1
        _, e, code, _ = options[k]
        codes.append(code)
    return np.array(codes, dtype=np.int64)[::-1]
