"""BPE encoding and decoding by a segment tree over the ranks of adjacent pairs (operator 10).

Every word of a text starts as its byte symbols, the last one marked as a word's end. A segment
tree over the ranks of adjacent pairs keeps in each node the smallest (rank, position) below it, so
its root is the leftmost pair of lowest rank. Merging that pair changes at most three leaves; each
change is written along one path to the root. The word is done when the root holds no rank.

Two forms of the same tree are used: words of at most 64 symbols are handled many at a time, one
tree in each row of a matrix; longer words get one tree each, so a text without any space costs
O(n log n).

Defined cases: a null or empty text has no ids; special tokens that a text spells out become their
ids, as in the tokenizers library; ``add_special_tokens`` is never used.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from lithograph.llm.common import filled, lengths, small_batches, texts

#: Entries of a worker's memory of pieces of text and their ids, beyond which it starts anew (some 80 bytes each).
WORD_MEMORY = 1_000_000
NO_PAIR = np.int64(1) << 60


#: The pre-tokenizer's pattern, and what a vocabulary file must have as normaliser, pre-tokenizer and model: fixed values.
PIECES_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
SUPPORTED = (["NFC", ["Replace", {"Regex": r"\s+"}, " "], "Lowercase"], [["Split", {"Regex": PIECES_PATTERN}, "Removed", True], ["ByteLevel", False, False]], "BPE")


def _steps(section: dict | None) -> list:
    """The steps of a normaliser or pre-tokenizer, with what decides their results."""
    if not section:
        return []
    if section["type"] == "Sequence":
        return [x for part in section.get("normalizers") or section.get("pretokenizers") for x in _steps(part)]
    kept = [section[k] for k in ("pattern", "content", "behavior", "invert", "add_prefix_space", "use_regex") if k in section]
    return [[section["type"], *kept] if kept else section["type"]]


def default_vocabulary() -> str:
    """Path of the public vocabulary file that the queries use."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies.

    Printable Latin-1 bytes stand for themselves, all others are numbered on from code point 256.
    """
    plain = {*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


class Vocabulary:
    """A vocabulary file of the tokenizers library: ids, merge ranks, special tokens."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        if (steps := (_steps(spec.get("normalizer")), _steps(spec.get("pre_tokenizer")), model.get("type"))) != SUPPORTED:
            raise ValueError(f"{path}: normaliser, pre-tokenizer and model are {steps}; supported are {SUPPORTED}")
        self.id_of: dict[str, int] = model["vocab"]
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        size = max([*self.id_of.values(), *self.special.values()]) + 1
        if size > 1 << 20:
            raise ValueError(f"{path}: {size} ids; at most {1 << 20} are packed into a pair's key")
        self.token = [""] * size
        for token, i in [*self.id_of.items(), *self.special.items()]:
            self.token[i] = token
        self.end = model.get("end_of_word_suffix") or ""
        symbols = byte_symbols()
        self.inner = np.array([self.id_of[s] for s in symbols], np.int64)
        self.last = np.array([self.id_of[s + self.end] for s in symbols], np.int64)
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        keys = np.array([self.id_of[a] << 20 | self.id_of[b] for a, b in pairs], np.int64)
        made = np.array([self.id_of[a + b] for a, b in pairs], np.int64)
        self.made = made
        # open addressing over a power of two, a quarter full: a pair is found in a few vectorised probes
        self.bits = (4 * len(pairs) + 4).bit_length()
        self.table_key = np.full(1 << self.bits, -1, np.int64)
        self.table_rank = np.full(1 << self.bits, NO_PAIR, np.int64)
        self.rank_of: dict[int, int] = {}
        for rank, key in enumerate(keys.tolist()):
            if key in self.rank_of:
                continue
            self.rank_of[key] = rank
            slot = self._slot(key)
            while self.table_key[slot] >= 0:
                slot = (slot + 1) & ((1 << self.bits) - 1)
            self.table_key[slot], self.table_rank[slot] = key, rank
        # the tokens in UTF-8, each with a space behind it
        spelled = [f"{t} ".encode("utf-8", "surrogatepass") for t in self.token]
        self.letters = np.frombuffer(b"".join(spelled), np.uint8)
        self.letter_count = lengths(spelled)
        self.letter_start = np.cumsum(self.letter_count) - self.letter_count

    def _slot(self, key: int) -> int:
        return ((key * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF) >> (64 - self.bits)

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair of symbols, NO_PAIR where they never merge."""
        shape = left.shape
        key = (left << 20 | right).ravel()
        slot = (key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - self.bits)).astype(np.int64)
        found = self.table_key[slot]
        out = np.where(found == key, self.table_rank[slot], NO_PAIR)
        todo = np.flatnonzero((found != key) & (found >= 0))
        while len(todo):
            slot[todo] = (slot[todo] + 1) & ((1 << self.bits) - 1)
            found = self.table_key[slot[todo]]
            hit = found == key[todo]
            out[todo[hit]] = self.table_rank[slot[todo[hit]]]
            todo = todo[~hit & (found >= 0)]
        return out.reshape(shape)


def merge_long(vocabulary: Vocabulary, symbols: list[int]) -> list[int]:
    """One word by one segment tree; leaves are rank << 32 | position."""
    n = len(symbols)
    size = 1 << max(1, (n - 1).bit_length())
    none, rank_of, made = int(NO_PAIR), vocabulary.rank_of, vocabulary.made
    tree = [none] * (2 * size)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))

    def leaf(i: int) -> int:
        j = after[i]
        r = rank_of.get(symbols[i] << 20 | symbols[j]) if j < n else None
        return none if r is None else r << 32 | i

    for i in range(n):
        tree[size + i] = leaf(i)
    for k in range(size - 1, 0, -1):
        tree[k] = min(tree[2 * k], tree[2 * k + 1])

    def put(i: int, value: int) -> None:
        k = size + i
        tree[k] = value
        while k > 1:
            k >>= 1
            best = min(tree[2 * k], tree[2 * k + 1])
            if tree[k] == best:
                break
            tree[k] = best

    while tree[1] != none:
        i, r = tree[1] & 0xFFFFFFFF, tree[1] >> 32
        j = after[i]
        symbols[i] = int(made[r])
        after[i] = after[j]
        if after[j] < n:
            before[after[j]] = i
        put(j, none)
        put(i, leaf(i))
        if before[i] >= 0:
            put(before[i], leaf(before[i]))
    out, i = [], 0
    while i < n:
        out.append(symbols[i])
        i = after[i]
    return out


def merge_rows(vocabulary: Vocabulary, words: list[bytes], size: int) -> list[bytes]:
    """Many words of at most ``size`` bytes: row w holds the tree of word w, nodes 1..2*size-1."""
    count = len(words)
    lens = np.fromiter(map(len, words), np.int64, count)
    buf = np.frombuffer(b"".join(w.ljust(size, b"\0") for w in words), np.uint8).reshape(count, size)
    symbols = vocabulary.inner[buf]
    rows = np.arange(count)
    symbols[rows, lens - 1] = vocabulary.last[buf[rows, lens - 1]]
    place = np.arange(size)
    after = np.broadcast_to(place + 1, (count, size)).copy()
    before = np.broadcast_to(place - 1, (count, size)).copy()
    tree = np.full((count, 2 * size), NO_PAIR, np.int64)
    ranks = vocabulary.ranks(symbols[:, :-1], symbols[:, 1:])
    valid = (ranks < NO_PAIR) & (place[None, 1:] < lens[:, None])
    tree[:, size : 2 * size - 1] = np.where(valid, ranks << 8 | place[:-1], NO_PAIR)
    width = size
    while width > 1:
        half = width // 2
        pairs = tree[:, width : 2 * width].reshape(count, half, 2)
        tree[:, half:width] = np.minimum(pairs[:, :, 0], pairs[:, :, 1])
        width = half
    flat, flat_after, flat_before, flat_symbols = tree.reshape(-1), after.reshape(-1), before.reshape(-1), symbols.reshape(-1)
    alive = np.ones(count * size, bool)

    def put(base: np.ndarray, at: np.ndarray, value: np.ndarray) -> None:
        node = at + size
        flat[base + node] = value
        while True:
            node = node >> 1
            low = base + 2 * node
            flat[base + node] = np.minimum(flat[low], flat[low + 1])
            if node[0] == 1:  # all leaves have one depth
                return

    def rank_at(row: np.ndarray, at: np.ndarray) -> np.ndarray:
        nxt = flat_after[row * size + at]
        inside = nxt < lens[row]
        r = vocabulary.ranks(flat_symbols[row * size + at], flat_symbols[row * size + np.where(inside, nxt, 0)])
        return np.where(inside & (r < NO_PAIR), r << 8 | at, NO_PAIR)

    active = rows
    while True:
        active = active[tree[active, 1] < NO_PAIR]
        if not len(active):
            break
        top = tree[active, 1]
        at, rank = top & 255, top >> 8
        cell, base = active * size, active * 2 * size
        gone = flat_after[cell + at]
        beyond = flat_after[cell + gone]
        flat_symbols[cell + at] = vocabulary.made[rank]
        flat_after[cell + at] = beyond
        inside = beyond < lens[active]
        flat_before[(cell + beyond)[inside]] = at[inside]
        alive[cell + gone] = False
        put(base, gone, np.full(len(active), NO_PAIR))
        put(base, at, rank_at(active, at))
        prior = flat_before[cell + at]
        some = prior >= 0
        if some.any():
            put(base[some], prior[some], rank_at(active[some], prior[some]))
    alive = alive.reshape(count, size) & (place[None, :] < lens[:, None])
    kept = symbols[alive].astype("<u4").tobytes()
    ends = (4 * np.cumsum(alive.sum(1))).tolist()
    return [kept[i:j] for i, j in zip([0, *ends], ends, strict=False)]


def merge_words(vocabulary: Vocabulary, words: list[bytes]) -> list[bytes]:
    """Ids of each word (its UTF-8 bytes) as little-endian integers, by the matrix of trees or by one tree a word."""
    out: list[bytes] = [b""] * len(words)
    lens = lengths(words)
    size_of = np.maximum(2, 1 << np.ceil(np.log2(np.maximum(lens, 1))).astype(np.int64))
    for size in np.unique(size_of[lens > 0]).tolist():
        members = np.flatnonzero((size_of == size) & (lens > 0)).tolist()
        if size > 64:
            for i in members:
                symbols = [*vocabulary.inner[list(words[i][:-1])].tolist(), int(vocabulary.last[words[i][-1]])]
                out[i] = np.array(merge_long(vocabulary, symbols), "<u4").tobytes()
            continue
        step = 16384 * 8 // size
        for k in range(0, len(members), step):
            part = members[k : k + step]
            for i, ids in zip(part, merge_rows(vocabulary, [words[i] for i in part], size), strict=True):
                out[i] = ids
    return out


PIECES = regex.compile(PIECES_PATTERN)
#: The same pattern where a text has only ASCII and precomposed Latin letters; letters come first, as the commonest.
LATIN = r"a-z\xc0-\xd6\xd8-\xf6\xf8-\u017f"
LATIN_PIECES = re.compile(rf"[{LATIN}]+|[0-9]|'(?:s|t|re|ve|m|ll|d)|[^\t-\r {LATIN}0-9]+")
#: A character that LATIN_PIECES does not cover (the dotted capital I lower-cases to two characters).
BEYOND = re.compile(r"[^\x00-\x7f\xc0-\xd6\xd8-\xf6\xf8-\u012f\u0131-\u017f]")


def lowered(word: str) -> str:
    """Lower case of each character alone (a final sigma has no form of its own)."""
    return "".join(c.lower() for c in word) if "Σ" in word else word.lower()


def pieces(text: str) -> list[str]:
    """Normalises a text (NFC, white space, lower case) and cuts it as the pre-tokenizer does."""
    if text.isascii() or not BEYOND.search(text):
        return LATIN_PIECES.findall(text.lower())
    return PIECES.findall(lowered(unicodedata.normalize("NFC", text)))


#: Kind of each byte of a lower-cased text that LATIN_PIECES covers: white, letter, digit, other.
WHITE, LETTER, DIGIT, OTHER = range(4)
KIND = np.full(256, OTHER, np.uint8)
KIND[[9, 10, 11, 12, 13, 32]] = WHITE
KIND[97:123] = KIND[128:] = LETTER
KIND[48:58] = DIGIT
#: The first bytes of a word of eight.
FIRST = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def piece_bounds(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the pieces of LATIN_PIECES begin and end in the bytes of lower-cased text (zeros behind it)."""
    kind = KIND[buf]
    new = kind == DIGIT
    new[:1] = True
    new[1:] |= kind[1:] != kind[:-1]
    at = np.flatnonzero(new)
    s, e = at, np.append(at[1:], len(buf))
    some = kind[at] != WHITE
    s, e = s[some], e[some]
    # a quote that stands alone before letters takes a contraction's letters with it
    quote = np.flatnonzero((e - s == 1) & (buf[s] == 39))
    if len(quote):
        one, two = buf[np.minimum(e[quote], len(buf) - 1)], buf[np.minimum(e[quote] + 1, len(buf) - 1)]
        takes = np.isin(one, list(b"stmd")).astype(np.int64)
        takes[((one == 114) | (one == 118)) & (two == 101) | (one == 108) & (two == 108)] = 2
        quote, takes = quote[takes > 0], takes[takes > 0]
        e[quote] += takes
        s[quote + 1] += takes
        left = s < e
        s, e = s[left], e[left]
    return s, e


def spread(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The indices starts[i], starts[i] + 1, .. of counts[i] each, in turn."""
    ends = np.cumsum(counts)
    return np.repeat(starts - (ends - counts), counts) + np.arange(int(ends[-1]) if len(ends) else 0)


def _room(a: np.ndarray, n: int) -> np.ndarray:
    """The array, or a copy of twice the length, with room for ``n`` values."""
    if n <= len(a):
        return a
    return np.concatenate([a, np.zeros(max(n, 2 * len(a)) - len(a), a.dtype)])


class Memory:
    """Pieces of text and their ids in flat arrays; a frequent piece is merged once a worker.

    Pieces of at most 16 bytes are two integers and a length, found by open addressing; longer ones are
    keys of a dictionary. ``full`` bounds it: a full memory is dropped between batches.
    """

    def __init__(self, size: int):
        self.size = size
        self.clear()

    def clear(self) -> None:
        self.bits, self.count, self.in_table, self.used, self.held = 14, 0, 0, 0, 0
        self.table = np.full(1 << self.bits, -1, np.int32)
        self.low, self.high, self.bytes = np.zeros(1024, np.uint64), np.zeros(1024, np.uint64), np.zeros(1024, np.int64)
        self.start, self.length, self.ids = np.zeros(1024, np.int64), np.zeros(1024, np.int64), np.zeros(4096, np.uint32)
        self.long: dict[bytes, int] = {}

    def full(self) -> bool:
        return self.count > self.size or self.held > 64 * self.size

    def _slots(self, low: np.ndarray, high: np.ndarray, n: np.ndarray) -> np.ndarray:
        h = low * np.uint64(0x9E3779B97F4A7C15) + high * np.uint64(0xC2B2AE3D27D4EB4F) + n.astype(np.uint64)
        h ^= h >> np.uint64(32)
        h *= np.uint64(0xD6E8FEB86659FD93)
        return (h >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, low: np.ndarray, high: np.ndarray, n: np.ndarray) -> np.ndarray:
        """The entry of each short piece, -1 where there is none."""
        slot = self._slots(low, high, n)
        out = self.table[slot].astype(np.int64)
        some = out >= 0
        same = some & (self.low[out] == low) & (self.high[out] == high) & (self.bytes[out] == n)
        todo = np.flatnonzero(some & ~same)
        out[todo] = -1
        while len(todo):
            slot[todo] = (slot[todo] + 1) & (len(self.table) - 1)
            e = self.table[slot[todo]].astype(np.int64)
            hit = (e >= 0) & (self.low[e] == low[todo]) & (self.high[e] == high[todo]) & (self.bytes[e] == n[todo])
            out[todo[hit]] = e[hit]
            todo = todo[(e >= 0) & ~hit]
        return out

    def _place(self, entries: np.ndarray) -> None:
        slot = self._slots(self.low[entries], self.high[entries], self.bytes[entries])
        while len(entries):
            free = self.table[slot] < 0
            _, first = np.unique(slot, return_index=True)
            winner = np.zeros(len(entries), bool)
            winner[first] = True
            winner &= free
            self.table[slot[winner]] = entries[winner]
            entries, slot = entries[~winner], (slot[~winner] + 1) & (len(self.table) - 1)

    def add(self, words: list[bytes], ids: list[bytes], low: np.ndarray, high: np.ndarray, n: np.ndarray) -> None:
        """New entries, numbered on from ``count``; ``ids`` as little-endian integers."""
        begin, end = self.count, self.count + len(words)
        counts = lengths(ids) // 4
        flat = np.frombuffer(b"".join(ids), "<u4")
        for name in ("low", "high", "bytes", "start", "length"):
            setattr(self, name, _room(getattr(self, name), end))
        self.ids = _room(self.ids, self.used + len(flat))
        self.low[begin:end], self.high[begin:end], self.bytes[begin:end] = low, high, n
        self.length[begin:end] = counts
        self.start[begin:end] = self.used + np.cumsum(counts) - counts
        self.ids[self.used : self.used + len(flat)] = flat
        self.used += len(flat)
        self.held += 4 * len(flat) + int(n[n > 16].sum())
        self.long.update((w, begin + k) for k, w in enumerate(words) if len(w) > 16)
        self.count = end
        short = begin + np.flatnonzero(n <= 16)
        self.in_table += len(short)
        if 2 * self.in_table > len(self.table):
            while 2 * self.in_table > 1 << self.bits:
                self.bits += 1
            self.table = np.full(1 << self.bits, -1, np.int32)
            short = np.flatnonzero(self.bytes[:end] <= 16)
        self._place(short)


class Encoder:
    """Encodes texts; remembers the ids of pieces, so a frequent one is merged once a worker.

    ``merge`` maps pieces (UTF-8 bytes) to their ids; by default it is the segment tree.
    """

    def __init__(self, vocabulary: Vocabulary, merge=None, memory: int = WORD_MEMORY):
        self.vocabulary = vocabulary
        self.merge = merge or (lambda words: merge_words(vocabulary, words))
        self.memory = Memory(memory)
        # 0xFF is no byte of UTF-8, so a special token's key is no piece of text
        self.special = {x: b"\xff" + x.encode("utf-8") for x in vocabulary.special}
        self.cut = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None

    def _pieces(self, batch: list[str]) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray, np.ndarray | None]:
        """The pieces of all texts: bytes, begins, ends, pieces of each text, and their order if it isn't that of the texts."""
        plain: list[bytes] = []
        odd: list[list[bytes]] = []
        is_plain = np.ones(len(batch), bool)
        for i, text in enumerate(batch):
            special = any(x in text for x in self.special)
            if not special and (text.isascii() or not BEYOND.search(text)):
                plain.append(text.lower().encode())
                continue
            is_plain[i] = False
            parts = self.cut.split(text) if special else [text]
            odd.append([w for x in parts for w in ([self.special[x]] if x in self.special else (p.encode("utf-8", "surrogatepass") for p in pieces(x)))])
        data = b"\n".join(plain) + b"\n"
        size = lengths(plain)
        first = np.cumsum(size + 1) - size - 1
        s, e = piece_bounds(np.frombuffer(data, np.uint8))
        counts = np.zeros(len(batch), np.int64)
        counts[is_plain] = np.diff(np.append(np.searchsorted(s, first), len(s)))
        if not odd:
            return data, s, e, counts, None
        flat = [w for ws in odd for w in ws]
        more = len(data) + np.cumsum(lengths(flat))
        counts[~is_plain] = lengths(odd)
        begin = np.zeros(len(batch), np.int64)
        for mask, base in ((is_plain, 0), (~is_plain, len(s))):
            begin[mask] = base + np.cumsum(counts[mask]) - counts[mask]
        return data + b"".join(flat), np.concatenate([s, more - lengths(flat)]), np.concatenate([e, more]), counts, spread(begin, counts)

    def _entries(self, data: bytes, s: np.ndarray, e: np.ndarray) -> np.ndarray:
        """The memory's entry of each piece; new ones are merged first."""
        memory, n = self.memory, e - s
        eight = np.ndarray((len(data) + 9,), "<u8", data + bytes(16), 0, (1,))  # the eight bytes from each place on
        low, high = eight[s] & FIRST[np.minimum(n, 8)], eight[np.minimum(s + 8, len(data))] & FIRST[np.clip(n - 8, 0, 8)]
        out = memory.find(low, high, n)
        for k in np.flatnonzero(n > 16).tolist():
            out[k] = memory.long.get(data[s[k] : e[k]], -1)
        unknown = np.flatnonzero(out < 0)
        if len(unknown):
            number: dict[bytes, int] = {}
            at, own = [], []
            for k, i, j in zip(unknown.tolist(), s[unknown].tolist(), e[unknown].tolist(), strict=True):
                w = data[i:j]
                x = number.get(w)
                if x is None:
                    x = number[w] = len(at)
                    at.append(k)
                own.append(x)
            words = list(number)
            plain = [w for w in words if w[0] != 255]
            merged = iter(self.merge(plain))
            ids = [next(merged) if w[0] != 255 else np.uint32(self.vocabulary.special[w[1:].decode()]).astype("<u4").tobytes() for w in words]
            out[unknown] = memory.count + np.array(own)
            memory.add(words, ids, low[at], high[at], n[at])
        return out

    def arrays(self, batch: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one after the other, and where each text's end."""
        if self.memory.full():
            self.memory.clear()
        data, s, e, counts, order = self._pieces(batch)
        entry = self._entries(data, s, e)
        if order is not None:
            entry = entry[order]
        count = self.memory.length[entry]
        ids = self.memory.ids[spread(self.memory.start[entry], count)]
        ends = np.concatenate([[0], np.cumsum(count)])[np.cumsum(counts)]
        return ids, ends

    def encode(self, batch: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        ids, ends = self.arrays(batch)
        return cut_up(ids.astype("<u4", copy=False).tobytes(), 4 * ends)


def cut_up(raw: bytes, ends: np.ndarray) -> list[bytes]:
    """The parts of ``raw`` between the ends."""
    ends = ends.tolist()
    return [raw[i:j] for i, j in zip([0, *ends], ends, strict=False)]


def decoded(vocabulary: Vocabulary, ids: np.ndarray, ends: np.ndarray) -> list[bytes]:
    """UTF-8 of the decoded text of each run of ids: tokens joined by a space, as a tokenizer without a decoder does."""
    count = vocabulary.letter_count[ids]
    raw = vocabulary.letters[spread(vocabulary.letter_start[ids], count)].tobytes()
    return [x[:-1] for x in cut_up(raw, np.concatenate([[0], np.cumsum(count)])[ends])]


def decode(vocabulary: Vocabulary, ids: bytes) -> str:
    """The decoded text of one run of ids; nothing is skipped."""
    ids = np.frombuffer(ids, "<u4")
    return decoded(vocabulary, ids, np.array([len(ids)]))[0].decode("utf-8", "surrogatepass")


_LOADED: dict[str, Vocabulary] = {}


def loaded(path: str) -> Vocabulary:
    """The vocabulary of a path, read once a worker."""
    if path not in _LOADED:
        _LOADED[path] = Vocabulary(path)
    return _LOADED[path]


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The segment tree's encoder of a path, with its memory of words, once a worker."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(loaded(path))
    return _ENCODERS[path]


def runs(rows: list[str], limit: int = 2_000_000) -> Iterator[list[str]]:
    """Rows in runs of about ``limit`` characters."""
    run: list[str] = []
    total = 0
    for row in rows:
        run.append(row)
        total += len(row)
        if total >= limit:
            yield run
            run, total = [], 0
    if run:
        yield run


def encode_documents(docs: DataFrame, vocabulary: str) -> DataFrame:
    """doc_id, ids (little-endian unsigned 32-bit integers) and the decoded text of every document.

    ``docs`` needs doc_id and text; one row comes out for each row, no shuffle. A null text is empty.
    """
    small_batches(docs.sparkSession)

    def run(batches):
        enc = encoder(vocabulary)
        for batch in filled(batches):
            at = 0
            for part in runs(texts(batch)):
                ids, ends = enc.arrays(part)
                text = pa.array(decoded(enc.vocabulary, ids, ends), pa.binary()).cast(pa.string())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(part)), pa.array(cut_up(ids.tobytes(), 4 * ends), pa.binary()), text], ["doc_id", "ids", "decoded"])
                at += len(part)

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, ids binary, decoded string")


def encode_ids(docs: DataFrame, vocabulary: str) -> DataFrame:
    """doc_id, n_tokens, ids (an array) of every document."""
    small_batches(docs.sparkSession)

    def run(batches):
        enc = encoder(vocabulary)
        for batch in filled(batches):
            at = 0
            for part in runs(texts(batch)):
                ids, ends = enc.arrays(part)
                edges = np.concatenate([[0], ends])
                lists = pa.ListArray.from_arrays(pa.array(edges, pa.int32()), pa.array(ids.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(part)), pa.array(np.diff(edges), pa.int64()), lists], ["doc_id", "n_tokens", "ids"])
                at += len(part)

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, ids array<int>")


def digests(docs: DataFrame, vocabulary: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: the digest form, computed where the ids are made.

    The ids and the decoded text never leave the worker, which keeps the written rows small.
    """
    small_batches(docs.sparkSession)

    def run(batches):
        enc = encoder(vocabulary)
        for batch in filled(batches):
            n, a, b = [], [], []
            for part in runs(texts(batch)):
                ids, ends = enc.arrays(part)
                n += np.diff(ends, prepend=0).tolist()
                a += [hashlib.sha256(x).hexdigest() for x in cut_up(ids.tobytes(), 4 * ends)]
                b += [hashlib.sha256(x).hexdigest() for x in decoded(enc.vocabulary, ids, ends)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
