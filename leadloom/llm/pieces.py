"""The model file of a SentencePiece BPE tokenizer, its normaliser and its merges.

``PieceModel`` reads the model file by itself (protobuf wire format) and gives

* ``normalize``: longest-prefix normalisation through the compiled character
  map (a double array trie), with the byte of the source that every
  normalised byte comes from;
* ``merge``: byte-pair merging over a linked list of symbols with a heap of
  adjacent pairs: the pair of lowest rank is popped again and again, the
  leftmost first where ranks are equal.

``merge_all`` does the same for many words side by side (numpy): each turn
makes the merge of lowest rank, leftmost first, in every word that has one.

Texts are cut ahead of merging where no piece of the vocabulary has the two
characters side by side (checked when the model is loaded); a merge can then
never reach over the cut either. Results of short cuts are kept in a cache
of bounded size, as words recur.
"""

from __future__ import annotations

import functools
import heapq
import itertools
import re
import struct
from collections.abc import Iterable

import numpy as np

MARK = "▁"
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6

#: Words kept by a worker (in two generations), and the longest that is kept: some 60 MB at most.
CACHE_WORDS, CACHE_CHARS = 240_000, 48


class Cache(dict):
    """Results by word. What was not asked for while half the bound came in anew is dropped."""

    def __init__(self, make, words: int = CACHE_WORDS):
        super().__init__()
        self.make, self.old, self.words = make, {}, words

    def __missing__(self, word: str):
        out = self.old.get(word)
        if out is None:
            out = self.make(word)
        if len(word) <= CACHE_CHARS:
            if len(self) >= self.words // 2:
                self.old = dict(self)
                self.clear()
            self[word] = out
        return out

    def fill(self, words: Iterable[str], make_all) -> list[str]:
        """Puts in what ``words`` need and this does not hold, made at once; returns those too long to be kept for good."""
        if len(self) >= self.words // 2:
            self.old = dict(self)
            self.clear()
        fresh = set(itertools.filterfalse(self.__contains__, words))
        known = fresh & self.old.keys()
        self.update((w, self.old[w]) for w in known)
        fresh = list(fresh - known)
        self.update(zip(fresh, make_all(fresh)))
        return [w for w in fresh if len(w) > CACHE_CHARS]


class PairTable:
    """Merges of symbol pairs, looked up for many pairs at once: open addressing, in at most ``reach`` steps."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        bits = max(4, (4 * len(keys)).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys, self.values = np.full(1 << bits, -1, np.int64), np.full(1 << bits, -1, np.int64)
        rest, slot, self.reach = np.arange(len(keys)), self._slot(keys), 0
        while len(rest):
            at = (slot[rest] + self.reach) & self.mask
            free = np.flatnonzero(self.keys[at] < 0)
            place, one = np.unique(at[free], return_index=True)
            self.keys[place], self.values[place] = keys[rest[free[one]]], values[rest[free[one]]]
            rest = np.delete(rest, free[one])
            self.reach += 1

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def get(self, keys: np.ndarray) -> np.ndarray:
        """The values of ``keys``, -1 where there is none."""
        at = self._slot(keys)
        found = self.keys[at]
        out = np.where(found == keys, self.values[at], -1)
        rest = np.flatnonzero((found != keys) & (found >= 0))
        for _ in range(1, self.reach):
            if not len(rest):
                break
            at[rest] = (at[rest] + 1) & self.mask
            found = self.keys[at[rest]]
            hit = found == keys[rest]
            out[rest[hit]] = self.values[at[rest[hit]]]
            rest = rest[~hit & (found >= 0)]
        return out


def _fields(data: bytes):
    """(number, value) of every field of a protobuf message."""
    at, n = 0, len(data)

    def varint():
        nonlocal at
        out = shift = 0
        while True:
            b = data[at]
            at += 1
            out |= (b & 127) << shift
            if b < 128:
                return out
            shift += 7

    while at < n:
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
        elif kind == 2:
            size = varint()
            yield key >> 3, data[at : at + size]
            at += size
        else:
            size = 4 if kind == 5 else 8
            yield key >> 3, data[at : at + size]
            at += size


class CharMap:
    """Longest-prefix lookup in a compiled character map: a double array trie over UTF-8 and its replacements."""

    def __init__(self, blob: bytes):
        size = struct.unpack_from("<I", blob)[0] if blob else 0
        self.units = struct.unpack_from(f"<{size // 4}I", blob, 4) if size else ()
        self.texts = blob[4 + size :] if size else b""

    def longest(self, data: bytes, at: int) -> tuple[int, bytes] | None:
        """Length of the longest key that ``data`` has at ``at``, and its replacement."""
        units, found = self.units, None
        if not units:
            return None
        offset = lambda u: (u >> 10) << ((u & 512) >> 6)
        node = offset(units[0])
        for i in range(at, len(data)):
            node ^= data[i]
            if node >= len(units) or units[node] & 0x800000FF != data[i]:
                break
            unit = units[node]
            node ^= offset(unit)
            if unit >> 8 & 1:
                found = i + 1 - at, units[node] & 0x7FFFFFFF
        if found is None:
            return None
        start = found[1]
        return found[0], self.texts[start : self.texts.index(b"\0", start)]


class PieceModel:
    def __init__(self, data: bytes):
        self.pieces: list[str] = []
        self.scores: list[float] = []
        self.kinds: list[int] = []
        spec: dict[int, object] = {}
        trainer: dict[int, object] = {}
        for number, value in _fields(data):
            if number == 1:
                f = dict(_fields(value))
                self.pieces.append(f.get(1, b"").decode())
                self.scores.append(struct.unpack("<f", f[2])[0] if 2 in f else 0.0)
                self.kinds.append(f.get(3, NORMAL))
            elif number == 2:
                trainer = dict(_fields(value))
            elif number == 3:
                spec = dict(_fields(value))
        self.is_bpe = trainer.get(3, 1) == 2
        self.byte_fallback = bool(trainer.get(35, 0))
        if self.pieces and not self.is_bpe or trainer.get(24, 0):
            raise ValueError("only BPE models with a leading white-space mark are handled")
        if self.pieces and not self.byte_fallback:
            raise ValueError("only models with byte fallback are handled")
        if any(k in (USER_DEFINED, UNUSED) for k in self.kinds):
            raise ValueError("user-defined and unused pieces are not handled")
        self.map = CharMap(spec.get(2, b""))
        self.dummy_prefix = bool(spec.get(3, 1))
        self.trim = bool(spec.get(4, 1))
        self.escape = bool(spec.get(5, 1))
        self.unk_surface = trainer[44].decode() if 44 in trainer else " ⁇ "
        self.ids = {p: i for i, (p, k) in enumerate(zip(self.pieces, self.kinds)) if k == NORMAL}
        self.rank = {p: -self.scores[i] for p, i in self.ids.items()}
        self.known = {p for p in self.ids if len(p) == 1}
        self.unk = self.kinds.index(UNKNOWN) if UNKNOWN in self.kinds else 0
        self.byte_ids = {int(p[3:5], 16): i for i, (p, k) in enumerate(zip(self.pieces, self.kinds)) if k == BYTE}
        #: no normalised text differs from its source but by marks for spaces
        self.plain = not self.map.units and not self.trim and self.escape
        self.cut = self._cut()
        # merges by the numbers of both symbols; characters that are no piece have numbers from n on
        self.n = len(self.pieces)
        loose = sorted({c for p in self.ids for c in p} - self.ids.keys())
        self.symbol = _Symbols({c: self.ids[c] for c in self.ids if len(c) == 1} | {c: self.n + k for k, c in enumerate(loose)} | {"": self.n + len(loose)})
        self.span = self.n + len(loose) + 1
        order = {r: k for k, r in enumerate(sorted(set(self.rank.values())))}
        self.key = [order[self.rank[p]] << 32 if p in self.rank else 0 for p in self.pieces]
        number = self.ids | {c: self.symbol[c] for c in loose}
        self.pair = {
            number[p[:k]] * self.span + number[p[k:]]: i for p, i in self.ids.items() for k in range(1, len(p)) if p[:k] in number and p[k:] in number
        }

    def _cut(self) -> re.Pattern | None:
        """Where texts can be cut before merging: between characters that stand side by side in no piece.

        Characters are put into two classes, letters and the rest; one that
        touches the other class in some piece changes sides. White space that
        is in no longer piece stands alone. A pattern is used only if it cuts
        no piece; whether it cuts depends on two neighbours alone.
        """
        long = [p for p in self.ids if len(p) > 1]
        held = {c for p in long for c in p}
        alone = "".join(c for c in "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f\x85\u2028\u2029" if c not in held)
        word = re.compile(r"[^\W\d_]")
        more: set[str] = set()
        less: set[str] = set()
        for _ in range(8):
            letter = lambda c: c in more or c not in less and word.match(c) is not None
            clash = {(a, b) if letter(a) else (b, a) for p in long for a, b in zip(p, p[1:]) if MARK not in (a, b) and letter(a) != letter(b)}
            if not clash:
                break
            less |= {a for a, _ in clash if not a.isalpha()}
            more |= {b for a, b in clash if a.isalpha()}
        quoted = lambda chars: "".join(map(re.escape, sorted(chars)))
        one = f"(?:[^\\W\\d_{quoted(less)}]" + (f"|[{quoted(more)}])" if more else ")")
        fine = rf"{MARK}*{one}+|{MARK}*(?:(?!{one})[^{MARK}{quoted(alone)}])+|{MARK}+|[{quoted(alone)}]"
        coarse = rf"{MARK}*[^{MARK}{quoted(alone)}]+|{MARK}+|[{quoted(alone)}]"
        for pattern in map(re.compile, (fine, coarse)):
            if alone and all(pattern.findall(p) == [p] for p in long):
                return pattern
        return None

    # normalisation

    def _prefix(self, data: bytes, at: int) -> tuple[bytes, int]:
        if found := self.map.longest(data, at):
            return found[1], found[0]
        b = data[at]
        n = 1 if b < 0x80 else 2 if b < 0xE0 else 3 if b < 0xF0 else 4
        return data[at : at + n], n

    def normalize(self, text: str) -> tuple[bytes, list[int]]:
        """Normalised UTF-8, and for each of its bytes (and its end) the source byte that it starts from."""
        data = text.encode()
        at, n = 0, len(data)
        out, source = bytearray(), []
        mark = MARK.encode() if self.escape else b" "
        if self.trim:
            while at < n:
                piece, size = self._prefix(data, at)
                if piece != b" ":
                    break
                at += size
        if at >= n:
            return b"", [n if self.trim else 0]
        if self.dummy_prefix:
            out += mark
            source += [at] * len(mark)
        after_space = self.trim
        while at < n:
            piece, size = self._prefix(data, at)
            while after_space and piece.startswith(b" "):
                piece = piece[1:]
            if piece:
                new = piece.replace(b" ", mark)
                out += new
                source += [at] * len(new)
                after_space = piece.endswith(b" ")
            at += size
            if not self.trim:
                after_space = False
        end = n
        if self.trim:
            while out.endswith(mark):
                del out[-len(mark) :]
                end = source[len(out)]
                del source[len(out) :]
        return bytes(out), [*source, end]

    def normalized(self, text: str) -> str:
        """The normalised text alone."""
        if self.plain:
            return (MARK if text and self.dummy_prefix else "") + text.replace(" ", MARK)
        return self.normalize(text)[0].decode()

    def words(self, normal: str) -> list[str]:
        if not normal:
            return []
        return self.cut.findall(normal) if self.cut else [normal]

    # merging

    def _merged(self, word: str) -> tuple[list[int], int]:
        """Symbols of ``word`` after all merges (-1 where one was merged into an earlier one), and the number of merges."""
        pair, key, span = self.pair.get, self.key, self.span
        n = len(word)
        symbols = list(map(self.symbol.__getitem__, word))
        heap = [key[m] | i for i, (a, b) in enumerate(zip(symbols, symbols[1:])) if (m := pair(a * span + b)) is not None]
        if not heap:
            return symbols, 0
        left, right = list(range(-1, n - 1)), list(range(1, n + 1))
        heapq.heapify(heap)
        pop, push = heapq.heappop, heapq.heappush
        merges = 0
        while heap:
            entry = pop(heap)
            i = entry & 0xFFFFFFFF
            j = right[i]
            if j >= n or symbols[i] < 0:
                continue
            m = pair(symbols[i] * span + symbols[j])
            if m is None or key[m] | i != entry:
                continue  # one of the two has been merged since
            merges += 1
            symbols[i], symbols[j] = m, -1
            right[i] = j = right[j]
            if j < n:
                left[j] = i
                if (x := pair(m * span + symbols[j])) is not None:
                    push(heap, key[x] | i)
            j = left[i]
            if j >= 0 and (x := pair(symbols[j] * span + m)) is not None:
                push(heap, key[x] | j)
        return symbols, merges

    @functools.cached_property
    def _table(self) -> PairTable:
        """rank << 32 | merged symbol of every pair."""
        return PairTable(np.array(list(self.pair), np.int64), np.array([self.key[m] | m for m in self.pair.values()], np.int64))

    @functools.cached_property
    def _symbol_of(self) -> np.ndarray:
        out = np.full(0x110000, self.symbol[""], np.int32)
        for c, s in self.symbol.items():
            if c:
                out[ord(c)] = s
        return out

    def merge_all(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Symbols of all ``words`` after all merges, and how many each has."""
        size = np.array([len(w) for w in words], np.int64)
        flat = self._symbol_of[np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)]
        begin = np.cumsum(size) - size
        n, longest = len(words), int(size.max(initial=0))
        # one column for each word; a row more at both ends, so that neighbours always exist
        sym = np.full((longest + 2, n), -1, np.int64)
        word = np.repeat(np.arange(n), size)
        sym[np.arange(len(flat)) - begin[word] + 1, word] = flat
        step = np.arange(longest + 2)[:, None]
        left, right = np.broadcast_to(step - 1, sym.shape).copy(), np.broadcast_to(step + 1, sym.shape).copy()
        none = np.int64(1 << 62)
        merged = np.full(sym.shape, -1, np.int64)
        order = np.full(sym.shape, none)
        a, b = sym[:-1], sym[1:]
        row, col = np.nonzero((a >= 0) & (b >= 0))
        found = self._table.get(a[row, col] * self.span + b[row, col])
        hit = found >= 0
        row, col, found = row[hit], col[hit], found[hit]
        merged[row, col] = found & 0xFFFFFFFF
        order[row, col] = found >> 32 << 16 | row
        live = np.arange(n)
        while len(live):
            best = order.min(axis=0) if len(live) == n else order[:, live].min(axis=0)
            live, best = live[best < none], best[best < none]
            at = best & 0xFFFF
            m = merged[at, live]
            gone = right[at, live]
            after = right[gone, live]
            sym[at, live], sym[gone, live] = m, -1
            order[gone, live] = none
            right[at, live], left[after, live] = after, at
            before = left[at, live]
            for one, x, y in ((at, m, sym[after, live]), (before, sym[before, live], m)):
                found = np.full(len(live), -1, np.int64)
                pair = np.flatnonzero((x >= 0) & (y >= 0))
                found[pair] = self._table.get(x[pair] * self.span + y[pair])
                merged[one, live] = found & 0xFFFFFFFF
                order[one, live] = np.where(found >= 0, found >> 32 << 16 | one, none)
        kept = sym.T >= 0
        return sym.T[kept], kept.sum(axis=1)

    def encode_all(self, words: list[str]) -> list[bytes]:
        """``encode`` of many words, each as little-endian 32-bit numbers."""
        out: list[bytes] = [b""] * len(words)
        size = np.fromiter(map(len, words), np.int64, len(words))
        by_size = np.argsort(size, kind="stable")
        by_size = by_size[np.searchsorted(size[by_size], 1) : np.searchsorted(size[by_size], CACHE_CHARS, side="right")]
        for at in range(0, len(by_size), 4096):
            part = by_size[at : at + 4096].tolist()
            symbols, count = self.merge_all([words[k] for k in part])
            ends = np.cumsum(count)
            loose = np.zeros(len(part), bool)
            loose[np.searchsorted(ends, np.flatnonzero(symbols >= self.n), side="right")] = True
            packed = symbols.astype("<i4").tobytes()
            for k, a, b in zip(part, (4 * (ends - count)).tolist(), (4 * ends).tolist()):
                out[k] = packed[a:b]
            for k in np.flatnonzero(loose).tolist():
                out[part[k]] = np.array(self.encode(words[part[k]]), "<i4").tobytes()
        for k in np.flatnonzero(size > CACHE_CHARS).tolist():
            out[k] = np.array(self.encode(words[k]), "<i4").tobytes()
        return out

    def encode(self, word: str) -> list[int]:
        """Ids of ``word``; a character that is no piece is written as its bytes."""
        symbols, _ = self._merged(word)
        if max(symbols, default=-1) < self.n:
            return [s for s in symbols if s >= 0]
        out: list[int] = []
        for c, s in zip(word, symbols):
            if s >= self.n:
                out += [self.byte_ids[b] for b in c.encode()]
            elif s >= 0:
                out.append(s)
        return out

    def count(self, word: str) -> int:
        """Tokens of ``word``: initial symbols less merges; no identifier is looked up."""
        initial = len(word)
        if not self.known.issuperset(word):
            symbols, merges = self._merged(word)
            # a character that stays alone and is no piece is written as its bytes
            return initial - merges + sum(len(c.encode()) - 1 for c, s in zip(word, symbols) if s >= self.n)
        return initial - self._merged(word)[1]


class _Symbols(dict):
    """Numbers of characters; one number for all that no piece holds."""

    def __missing__(self, c: str) -> int:
        return self[""]


@functools.lru_cache(maxsize=2)
def load(path: str) -> PieceModel:
    with open(path, "rb") as f:
        return PieceModel(f.read())
