"""Ids of a byte-pair vocabulary with word ends, for many words in step.

The vocabulary comes from a tokenizer file. Text is cut at spaces and line feeds, which
no token, normalisation or special token crosses, and each distinct word of a batch gets
its ids once. Words of plain characters (`PLAIN`, for which the file's own normaliser and
splitter are asked when it is loaded) are split and merged here, all at the same time:
a step merges, in every word, the pair that the file ranks first. All other words go to
the tokenizer itself.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator

import numpy as np

from strandlight.llm.common import one_thread

#: Code points that may be plain: those below this one.
PLAIN = 0x250
#: Bytes of the longest word that is merged in step; a longer one goes to the tokenizer.
LONGEST = 64
#: Bytes that the ids of known words may take, keys and objects included. At half of it the words so far become old; old
#: words that are met again stay known, and the others are forgotten at the next time.
MEMO_BYTES = 32 << 20
#: Bytes of a known word beside its letters and ids: two objects' heads and their rounding, an entry of the table.
WORD_BYTES = 144
#: Code points that are encoded at a time.
CHUNK = 1 << 18
_SHIFT = 15  # tables of pairs have 2^(32 - 15) slots
_SPACE, _LETTER, _DIGIT, _MARK, _OTHER = range(5)


class WordIds:
    """Little-endian 32-bit ids of texts."""

    def __init__(self, path: str) -> None:
        one_thread()
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        vocabulary, end = model["vocab"], model["end_of_word_suffix"]
        pairs = [tuple(x) if isinstance(x, list) else tuple(x.split(" ")) for x in model["merges"]]
        size = max(vocabulary.values()) + 1
        # symbols of bytes, by the byte alphabet that the file's splitter writes
        letter = self._byte_letters()
        self.inner = np.array([vocabulary[x] for x in letter], np.int32)
        self.last = np.array([vocabulary[x + end] for x in letter], np.int32)
        self.to = np.array([vocabulary[a + b] for a, b in pairs], np.int32)
        if len(np.unique(self.to)) != len(pairs) or size > 1 << 16:  # else a pair's rank does not say what was merged before it
            raise ValueError("two merges give the same token, or there are more than 65,536 tokens")
        key = np.array([vocabulary[a] << 16 | vocabulary[b] for a, b in pairs], np.uint32)
        self.none = np.int32(len(pairs))
        self.tables, left = [], np.arange(len(pairs))
        while len(left):  # pairs whose slot is taken go on to a table with another multiplier
            odd = np.uint32((0x9E3779B1 + 0x3C6EF372 * len(self.tables)) % (1 << 32))
            slot = key[left] * odd >> np.uint32(_SHIFT)
            _, at = np.unique(slot, return_index=True)
            keys, ranks = np.zeros(1 << 32 - _SHIFT, np.uint32), np.full(1 << 32 - _SHIFT, self.none)
            keys[slot[at]], ranks[slot[at]] = key[left[at]], left[at]
            self.tables.append((odd, keys, ranks))
            left = np.delete(left, at)
        self._plain_table()
        self.words: dict[str, bytes] = {"": b""}
        self.old: dict[str, bytes] = {}
        self.held = 0

    @staticmethod
    def _byte_letters() -> list[str]:
        """The printable letter that stands for each byte: itself if it is one, else the next from 256 on."""
        shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
        hidden = iter(range(0x100, 0x200))
        return [chr(b if b in shown else next(hidden)) for b in range(256)]

    def _plain_table(self) -> None:
        """The class of each code point, and the one that it is normalised to. Letters, digits and marks are those
        that the tokenizer keeps as one code point and splits alike beside a letter, a digit and a mark."""
        normal, split = self.tokenizer.normalizer, self.tokenizer.pre_tokenizer
        special = set("".join(x.content for x in self.tokenizer.get_added_tokens_decoder().values()) if self.tokenizer.get_added_tokens_decoder() else "")
        self.kind, self.low = np.full(PLAIN + 1, _OTHER, np.uint8), np.arange(PLAIN + 1, dtype=np.uint32)
        parts = lambda x: [z - a for _, (a, z) in split.pre_tokenize_str(x)]
        for c in range(0x21, PLAIN):
            x = chr(c)
            low = normal.normalize_str(x)
            if len(low) != 1 or ord(low) >= PLAIN or normal.normalize_str("e" + x + "e") != "e" + low + "e":
                continue
            beside = (parts("e" + low + "e"), parts(low + low), parts("1" + low + "1"), parts("." + low + "."))
            if beside == ([3], [2], [1, 1, 1], [1, 1, 1]):
                self.kind[c] = _LETTER
            elif c < 0x80 and beside == ([1, 1, 1], [1, 1], [1, 1, 1], [1, 1, 1]):
                self.kind[c] = _DIGIT
            elif c < 0x80 and x != "'" and x not in special - set(".,") and beside == ([1, 1, 1], [2], [1, 1, 1], [3]):
                self.kind[c] = _MARK
            self.low[c] = ord(low)
        for x in special:  # letters of a special token are plain: no special token is without a mark
            if ord(x) < 0x80 and self.kind[ord(x)] == _MARK:
                self.kind[ord(x)] = _OTHER
        self.kind[0x20] = _SPACE

    def __call__(self, texts: Iterable[str]) -> Iterator[bytes]:
        """The ids of each text, in order. Texts are taken in chunks, so that a word that many share is merged once."""
        group: list[str] = []
        size = 0
        for text in texts:
            if size + len(text) > CHUNK and group:
                yield from self._group(group)
                group, size = [], 0
            if len(text) > CHUNK:
                yield b"".join(x for part in self._cut(text) for x in self._group([part]))
                continue
            group.append(text)
            size += len(text)
        yield from self._group(group)

    @staticmethod
    def _cut(text: str) -> Iterator[str]:
        """Parts of a long text, cut at a space or line feed where one follows."""
        at = 0
        while at < len(text):
            z = min(len(text), at + CHUNK)
            while z < len(text) and text[z] not in " \n":
                z += 1
            yield text[at:z]
            at = z

    def _group(self, texts: list[str]) -> Iterator[bytes]:
        split = [x.replace("\n", " ").split(" ") for x in texts]
        if self.held > MEMO_BYTES // 2:
            self.old, self.words, self.held = self.words, {"": b""}, 0
        new = set().union(*split).difference(self.words)
        if again := list(new & self.old.keys()):
            self._keep(again, [self.old.pop(w) for w in again])
            new.difference_update(again)
        if new:
            self._learn(list(new))
        for words in split:
            yield b"".join(map(self.words.__getitem__, words))

    def _learn(self, words: list[str]) -> None:
        flat = np.frombuffer(" ".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)
        kind = self.kind[np.minimum(flat, PLAIN)]
        space = kind == _SPACE
        starts = np.concatenate([[0], np.flatnonzero(space) + 1])
        lengths = np.diff(np.append(starts, len(flat) + 1)) - 1
        plain = (np.maximum.reduceat(np.append(np.where(kind == _OTHER, 1, 0), 0), starts) == 0) & (lengths <= LONGEST)
        rest = np.flatnonzero(~plain).tolist()
        for k in range(0, len(rest), 512):  # the tokenizer's own results are large
            some = [words[i] for i in rest[k : k + 512]]
            self._keep(some, [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(some, add_special_tokens=False)])
        if len(rest) == len(words):
            return
        owner = np.repeat(np.arange(len(words)), lengths)  # the word of each code point
        flat, kind = flat[~space], kind[~space]
        if rest:
            keep = plain[owner]
            flat, kind, owner = flat[keep], kind[keep], owner[keep]
        ids, own = self._merged(flat, kind, owner)
        ends = np.cumsum(np.bincount(own, minlength=len(words))) * 4
        data, ends = ids.astype("<u4").tobytes(), ends.tolist()
        found = [data[a:z] for a, z in zip([0, *ends], ends)]
        if rest:
            mine = np.flatnonzero(plain).tolist()
            words, found = [words[i] for i in mine], [found[i] for i in mine]
        self._keep(words, found)

    def _keep(self, words: list[str], ids: list[bytes]) -> None:
        self.words.update(zip(words, ids, strict=True))
        self.held += WORD_BYTES * len(words) + sum(map(len, words)) + sum(map(len, ids))

    def _ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The place of each pair in the file's list; its length for a pair that is not there."""
        k = a.astype(np.uint32) << np.uint32(16) | b.astype(np.uint32)
        odd, keys, ranks = self.tables[0]
        slot = k * odd >> np.uint32(_SHIFT)
        out = np.where(keys[slot] == k, ranks[slot], self.none)
        left = np.flatnonzero(out == self.none)
        for odd, keys, ranks in self.tables[1:]:
            some = k[left]
            slot = some * odd >> np.uint32(_SHIFT)
            hit = np.flatnonzero(keys[slot] == some)
            out[left[hit]] = ranks[slot[hit]]
        return out

    def _merged(self, points: np.ndarray, kind: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, their words) of plain code points with their classes and words."""
        points = self.low[points]
        first = np.ones(len(points), bool)  # of a piece: a run of letters, a digit, a run of marks
        first[1:] = (owner[1:] != owner[:-1]) | (kind[1:] != kind[:-1]) | (kind[1:] == _DIGIT)
        piece = np.cumsum(first, dtype=np.int32) - 1
        word_of = owner[first]
        two = points >= 0x80
        lead = np.where(two, 0xC0 | points >> 6, points)
        n = 1 + two
        at = np.cumsum(n) - n
        data = np.empty(int(n.sum()), np.uint8)
        data[at] = lead
        data[at[two] + 1] = 0x80 | points[two] & 0x3F
        piece = np.repeat(piece, n)
        last = np.ones(len(data), bool)
        last[:-1] = piece[1:] != piece[:-1]
        symbol = np.where(last, self.last[data], self.inner[data])
        done: list[tuple[np.ndarray, np.ndarray]] = []
        none = self.none
        rank = np.full(len(symbol), none)  # of the pair that a symbol begins
        inside = np.flatnonzero(~last)
        rank[inside] = self._ranks(symbol[inside], symbol[inside + 1])
        while len(symbol):
            begin = np.flatnonzero(np.concatenate([[True], piece[1:] != piece[:-1]]))
            size = np.diff(np.append(begin, len(symbol)))
            low = np.minimum.reduceat(rank, begin)
            over = low == none
            if over.any():  # pieces without a pair to merge are ready
                ready = np.repeat(over, size)
                done.append((piece[ready], symbol[ready]))
                symbol, piece, rank = symbol[~ready], piece[~ready], rank[~ready]
                if not len(symbol):
                    break
                low, size = low[~over], size[~over]
            # of overlapping pairs (a symbol and its like) every second one, from the left
            run = np.flatnonzero(rank == np.repeat(low, size))
            chain = np.concatenate([[True], np.diff(run) != 1])
            if not chain.all():
                place = np.arange(len(run))
                since = place - np.maximum.accumulate(np.where(chain, place, 0))
                run = run[since % 2 == 0]
            symbol[run] = self.to[rank[run]]
            stay = np.ones(len(symbol), bool)
            stay[run + 1] = False
            new = np.cumsum(stay) - 1
            symbol, piece, rank = symbol[stay], piece[stay], rank[stay]
            here = new[run]
            at = np.concatenate([here, here[here > 0] - 1])
            rank[at] = none
            at = at[at + 1 < len(symbol)]
            at = at[piece[at + 1] == piece[at]]
            rank[at] = self._ranks(symbol[at], symbol[at + 1])
        pieces = np.concatenate([p for p, _ in done])
        order = np.argsort(pieces, kind="stable")
        return np.concatenate([s for _, s in done])[order], word_of[pieces[order]]
