"""Byte-pair encoding of whole batches, equal to the tokenizers library's result.

Text is cut where no pre-token can cross, the distinct units of a batch are found and looked up, and
only pre-tokens never met are merged: all of them at once, as one numpy matrix that loses a column a round.
What a batch says is then gathered from its distinct units. Units of up to 23 bytes are looked up and
cut into pre-tokens in numpy too (`short_units`), longer ones and those out of the ordinary as strings.
Whatever lies outside the plain alphabet below goes to the library itself, so the shortcut is one of
speed only. Ids are handed around as little-endian uint16 (uint32 for vocabularies over 65,535).
"""

from __future__ import annotations

import gc
import json
import os
import re
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .common import bytes_of, sliced
from .short_units import SHORT, Units, keys_at

#: Letters whose class, case and normal form are the same in every library: ASCII, Latin-1, Latin Extended-A without U+0130.
LETTERS = "A-Za-zÀ-ÖØ-öø-įı-ſ"
PLAIN = re.compile(f"[\t-\r -~{LETTERS}]*")
APOSTROPHES = "'s|'t|'re|'ve|'m|'ll|'d"
BYTE_PIECES = re.compile(rf"{APOSTROPHES}| ?[{LETTERS}]+| ?[0-9]+| ?[^\s{LETTERS}0-9]+|\s+(?!\S)|\s+")
WORD_PIECES = re.compile(rf"{APOSTROPHES}|[{LETTERS}]+|[0-9]|[^\s{LETTERS}0-9]+")
#: White space with what follows it: a boundary before white space that follows none is never crossed.
UNITS = re.compile(r"[ \t-\r]*[^ \t-\r]+|[ \t-\r]+")
#: White space other than ASCII's, or control characters that only some libraries take as such.
ODD_SPACE = re.compile("[\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
#: Kinds of bytes that may keep a text from being cut at single spaces: other white space of ASCII,
#: marks that only some libraries take as such, and what white space outside of ASCII begins with.
BLANK, CONTROL, HEAD = 1, 2, 3
KINDS = np.zeros(256, np.uint8)
KINDS[[9, 11, 12, 13]], KINDS[28:32], KINDS[[0xC2, 0xE1, 0xE2, 0xE3]] = BLANK, CONTROL, HEAD
#: What a byte of a short unit is. ODD: the unit is cut as a string. Apostrophes are, for contractions.
LETTER, DIGIT, MARK, NEWLINE, SPACE, ODD = 1, 2, 3, 4, 5, 9
UNIT_KINDS = np.full(256, ODD, np.uint8)
UNIT_KINDS[33:127] = MARK
UNIT_KINDS[[*range(65, 91), *range(97, 123), *range(0x80, 0xC0), 0xC3, 0xC4, 0xC5]] = LETTER
UNIT_KINDS[48:58], UNIT_KINDS[10], UNIT_KINDS[32], UNIT_KINDS[39] = DIGIT, NEWLINE, SPACE, ODD
NOT_LONGER, INF, CACHE = 40, np.int32(2**31 - 1), 600_000


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, extra = {}, 256
    for b in range(256):
        out[b] = chr(b) if b in plain else chr(extra)
        extra += b not in plain
    return [out[b] for b in range(256)]


class Pairs:
    """A hash table in numpy from a pair of ids to the rank of its merge."""

    BITS = 19

    def __init__(self, keys: np.ndarray):
        self.keys = np.full(1 << self.BITS, -1, np.int64)
        self.rank = np.full(1 << self.BITS, INF, np.int32)
        left, slot = np.arange(len(keys)), self.slot(keys)
        while left.size:
            free = self.keys[slot] < 0
            at, first = np.unique(slot[free], return_index=True)
            took = left[free][first]
            self.keys[at], self.rank[at] = keys[took], took
            stay = self.keys[slot] != keys[left]
            left, slot = left[stay], (slot[stay] + 1) & ((1 << self.BITS) - 1)

    def slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * 0x9E3779B1) & 0xFFFFFFFF) >> (32 - self.BITS)

    def __call__(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = (a << 17) | b
        slot = self.slot(key)
        met = self.keys[slot]
        out = np.where(met == key, self.rank[slot], INF)
        on = np.nonzero((met != key) & (met >= 0))
        while on[0].size:
            slot[on] = (slot[on] + 1) & ((1 << self.BITS) - 1)
            met, want = self.keys[slot[on]], key[on]
            out[on] = np.where(met == want, self.rank[slot[on]], INF)
            keep = (met != want) & (met >= 0)
            on = tuple(x[keep] for x in on)
        return out


class Encoder:
    """Encodes batches of texts as the library does with add_special_tokens=False."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab = spec["model"]["vocab"]
        merges = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        self.size = max(vocab.values(), default=0) + 1 + len(spec["added_tokens"])
        self.dtype = np.dtype("<u2") if self.size < 65_535 else np.dtype("<u4")
        self.end = spec["model"].get("end_of_word_suffix") or ""
        self.words = bool(self.end)  # words apart from white space, in lower case
        self.vocab = vocab
        symbols = byte_symbols()
        self.start = np.array([vocab.get(s, -1) for s in symbols], np.int64)
        self.last = np.array([vocab.get(s + self.end, -1) for s in symbols], np.int64)
        self.marks = tuple(t["content"][:2] for t in spec["added_tokens"])
        self.pairs = Pairs(np.array([(vocab[a] << 17) | vocab[b] for a, b in merges], np.int64))
        self.made = np.array([vocab[a + b] for a, b in merges], np.int64)
        self.pieces = WORD_PIECES if self.words else BYTE_PIECES
        self.memory = Memory(self.learn)
        self.units = Units(self.dtype)
        self.kinds = UNIT_KINDS.copy()
        if self.words:
            self.kinds[[10, 32, 0xC4, 0xC5]] = ODD

    def library_ids(self, texts: list[str]) -> list[bytes]:
        found = self.library.encode_batch_fast(texts, add_special_tokens=False) if texts else []
        return [np.array(x.ids, self.dtype).tobytes() for x in found]

    def merge(self, pieces: list[str]) -> list[bytes]:
        """The ids of pre-tokens, each for itself."""
        out: list[bytes] = [b""] * len(pieces)
        raw = [p.encode() for p in pieces]
        sizes = np.array([len(r) for r in raw])
        far = np.nonzero(sizes > NOT_LONGER)[0]
        for i, ids in zip(far, self.library_ids([pieces[i] for i in far]), strict=True):
            out[i] = ids
        order = np.argsort(sizes, kind="stable")
        order = order[(sizes[order] <= NOT_LONGER) & (sizes[order] > 0)]
        for lo in range(0, len(order), 8192):
            part = order[lo : lo + 8192]
            n, width = sizes[part], int(sizes[part[-1]])
            inside = np.arange(width) < n[:, None]
            flat = np.frombuffer(b"".join([raw[i] for i in part]), np.uint8)
            ids = np.full((len(part), width), (1 << 17) - 1, np.int64)
            ids[inside] = self.start[flat]
            ids[np.arange(len(part)), n - 1] = self.last[flat[np.cumsum(n) - 1]]
            rows, n = self._merge(ids, n)
            for i, row, k in zip(part.tolist(), rows, n.tolist(), strict=True):
                out[i] = row[:k].tobytes()
        return out

    def merge_keys(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of pre-tokens of at most SHORT bytes, one after the other, and how many each has."""
        raw = keys.view(np.uint8).reshape(-1, SHORT + 1)
        sizes = raw[:, SHORT].astype(np.int64)
        out, count = np.zeros((len(keys), SHORT), self.dtype), np.zeros(len(keys), np.int64)
        order = np.argsort(sizes, kind="stable")
        for lo in range(0, len(order), 8192):
            part = order[lo : lo + 8192]
            n, at = sizes[part], np.arange(len(part))
            width = int(n[-1])
            text = raw[part, :width]
            ids = np.where(np.arange(width) < n[:, None], self.start[text], (1 << 17) - 1)
            ids[at, n - 1] = self.last[text[at, n - 1]]
            out[part, :width], count[part] = self._merge(ids, n)
        return out[np.arange(SHORT) < count[:, None]], count

    def _merge(self, ids: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """What rows of n symbols each are merged to, and how many ids each row has then."""
        rows, count, part, n = np.zeros(ids.shape, self.dtype), np.zeros(len(ids), np.int64), np.arange(len(ids)), n.copy()
        ranks = self.pairs(ids[:, :-1], ids[:, 1:])
        while len(part):
            width = ids.shape[1]
            best = ranks.argmin(1) if width > 1 else np.zeros(len(part), np.int64)
            rank = ranks[np.arange(len(part)), best] if width > 1 else np.full(len(part), INF)
            done = np.nonzero(rank == INF)[0]
            if done.size:
                rows[part[done], :width], count[part[done]] = ids[done].astype(self.dtype), n[done]
                live = rank != INF
                ids, n, part, ranks, best, rank = ids[live], n[live], part[live], ranks[live], best[live], rank[live]
                if not len(part):
                    break
            at, cols = np.arange(len(part)), np.arange(width - 1)
            ids = np.where(cols <= best[:, None], ids[:, :-1], ids[:, 1:])
            ids[at, best] = self.made[rank]
            n -= 1
            if width > 2:
                ranks = np.where(cols[:-1] < best[:, None], ranks[:, :-1], ranks[:, 1:])
                left = np.nonzero(best > 0)[0]
                ranks[left, best[left] - 1] = self.pairs(ids[left, best[left] - 1], ids[left, best[left]])
                right = np.nonzero(best < width - 2)[0]
                ranks[right, best[right]] = self.pairs(ids[right, best[right]], ids[right, best[right] + 1])
        return rows, count

    def learn(self, units: list[str]) -> list[bytes]:
        """The ids of each of these different units: by merging its pre-tokens, or from the library."""
        odd = [] if PLAIN.fullmatch("".join(units)) else [u for u in units if not PLAIN.fullmatch(u)]
        whole = dict(zip(odd, self.library_ids(odd), strict=True))
        known, find, low = self.memory.known, self.pieces.findall, [u.lower() for u in units] if self.words else units
        # A unit of letters is one pre-token, a space in front of it included.
        split = [() if u in whole else (x,) if x.isalpha() or x[:1] == " " and x[1:].isalpha() else find(x) for u, x in zip(units, low, strict=True)]
        every = set(chain.from_iterable(split))
        pieces = {p: x for p, x in zip(every, map(known.get, every), strict=True) if x is not None}
        lack = list(every.difference(pieces))
        new = dict(zip(lack, self.merge(lack), strict=True))
        if len(known) < CACHE:
            known.update(new)
        pieces.update(new)
        return [pieces[ps[0]] if len(ps) == 1 else whole[u] if not ps and u in whole else b"".join([pieces[p] for p in ps]) for u, ps in zip(units, split, strict=True)]

    def learn_keys(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the ids of these different short units, none of them known, are put in `units.pool`, and how many each has."""
        raw = keys.view(np.uint8).reshape(-1, SHORT + 1)
        n = raw[:, SHORT].astype(np.int64)
        inside, raw = np.arange(SHORT) < n[:, None], raw[:, :SHORT]
        kind = np.where(inside, self.kinds[raw], 0)
        blank = (kind == NEWLINE) | (kind == SPACE)
        # White space in a row, a space without what follows it, and three signs that are no letters or have no lower case of one letter.
        apart = (kind == ODD).any(1) | (blank[:, 1:] & blank[:, :-1]).any(1) | (kind[:, 1:] == SPACE).any(1) | (kind[:, 0] == SPACE) & (n == 1)
        here, follow = raw[:, :-1], raw[:, 1:]
        apart |= ((here == 0xC3) & ((follow == 0x97) | (follow == 0xB7)) | (here == 0xC4) & (follow == 0xB0)).any(1)
        first, size = np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64)
        easy, hard = np.nonzero(~apart)[0], np.nonzero(apart)[0]
        if easy.size:
            first[easy], size[easy] = self._learn_easy(keys[easy], raw[easy], kind[easy], inside[easy])
        if hard.size:
            values = self.learn([raw[i, :k].tobytes().decode() for i, k in zip(hard.tolist(), n[hard].tolist(), strict=True)])
            size[hard] = np.fromiter(map(len, values), np.int64, len(values)) // self.dtype.itemsize
            first[hard] = self.units.add(keys[hard], np.frombuffer(b"".join(values), self.dtype), size[hard])
        return first, size

    def _learn_easy(self, keys: np.ndarray, raw: np.ndarray, kind: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """learn_keys() of units whose pre-tokens are runs of one kind of bytes, a space in front included."""
        units, before, own = self.units, kind[:, :-1], kind[:, 1:]
        begins = inside.copy()
        begins[:, 1:] = (own != before) & (before != SPACE) & (own != 0)
        if self.words:
            begins[:, 1:] |= own == DIGIT
            capital = (raw >= 65) & (raw <= 90)
            capital[:, 1:] |= (raw[:, :-1] == 0xC3) & (raw[:, 1:] <= 0x9E)
            raw = np.where(capital, raw + np.uint8(32), raw)
        flat, begin, times = raw[inside], np.nonzero(begins[inside])[0], begins.sum(1)
        pieces = keys_at(np.append(flat, np.zeros(SHORT + 1, np.uint8)), begin, np.diff(np.append(begin, len(flat))))
        found = pa.Array.from_buffers(pa.binary(SHORT + 1), len(pieces), [None, pa.py_buffer(pieces)]).dictionary_encode()
        of, distinct = found.indices.to_numpy(), np.frombuffer(found.dictionary.buffers()[1], "<u8", 3 * len(found.dictionary)).reshape(-1, 3)
        first, size = units.find(distinct)
        lack = np.nonzero(first < 0)[0]
        if lack.size:
            ids, size[lack] = self.merge_keys(distinct[lack])
            first[lack] = units.add(distinct[lack], ids, size[lack])
        first, size, at = first[of], size[of], np.cumsum(times) - times
        # A unit that is its only pre-token is known by now.
        one = np.nonzero(times == 1)[0]
        other = np.ones(len(keys), bool)
        other[one] = (pieces[at[one]] != keys[one]).any(1)
        out, count = np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64)
        out[~other], count[~other] = first[at[~other]], size[at[~other]]
        if other.any():
            mine = np.repeat(other, times)
            count[other] = np.diff(np.append(0, np.cumsum(size))[np.stack([at, at + times])[:, other]], axis=0)[0]
            out[other] = units.add(keys[other], units.pool[stretches(first[mine], size[mine])], count[other])
        return out, count

    def plain(self, texts: pa.Array) -> np.ndarray:
        """Which texts the library would encode unit by unit, cut at single spaces (words: at white space)."""
        data, at = bytes_of(texts)
        raw = np.frombuffer(data, np.uint8, at[-1] - at[0], at[0])
        kind = KINDS[raw]
        bad = kind == CONTROL
        if not self.words:
            bad |= kind == BLANK
            bad[1:] |= (raw[1:] == 32) & ((raw[:-1] == 32) | (raw[:-1] == 10))
        for m in {m.encode() for m in self.marks}:
            bad[: len(raw) - len(m) + 1] |= np.all([raw[k : len(raw) - len(m) + 1 + k] == c for k, c in enumerate(m)], 0) if len(raw) >= len(m) else False
        out = np.ones(len(texts), bool)
        out[np.searchsorted(at - at[0], np.nonzero(bad)[0], "right") - 1] = False
        for i in np.unique(np.searchsorted(at - at[0], np.nonzero(kind == HEAD)[0], "right") - 1):
            out[i] &= not ODD_SPACE.search(texts[i].as_py())  # bytes that white space outside of ASCII may begin with
        return out

    def places(self, texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
        """The different words between white space (words) or single spaces of plain texts, the unit at each
        place, the places where texts begin (and the last one ends), and which words texts begin with: these
        are units of their own, after all those with a space in front."""
        lists = pc.ascii_split_whitespace(texts) if self.words else pc.split_pattern(texts, " ")
        found = lists.flatten().dictionary_encode()
        at, of, words = lists.offsets.to_numpy().astype(np.int64), found.indices.to_numpy().astype(np.int64), found.dictionary
        at, lead = at - at[0], np.zeros(0, np.int64)
        if len(words) and not self.words:
            lead, own = np.unique(of[at[:-1]], return_inverse=True)
            of[at[:-1]] = len(words) + own
        return words, of, at, lead

    def distinct(self, texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
        """The different units of plain texts, the unit at each place, and the places where texts begin
        (and the last one ends). A space in front belongs to its unit."""
        words, of, at, lead = self.places(texts)
        if not len(words):
            return [], of, at
        # Plain texts hold no such mark: joined and cut again, strings cost less than one by one.
        joined = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(words)], pa.int32()), words), "\x1c" if self.words else "\x1c ")[0].as_py()
        if self.words:
            return joined.split("\x1c"), of, at
        units = (" " + joined).split("\x1c")
        return units + [units[i][1:] for i in lead], of, at

    def ids_of(self, words: pa.Array, lead: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the ids of each unit that places() gives begin in `units.pool`, and how many each has."""
        words.validate(full=True)  # bytes that are no UTF-8 are an error here as in the library
        data, at = bytes_of(words)
        space = np.uint64(0 if self.words else 1)
        raw = np.concatenate([np.zeros(1, np.uint8), np.frombuffer(data, np.uint8, at[-1] - at[0], at[0]), np.zeros(SHORT + 1, np.uint8)])
        begin, n = at[:-1] - at[0] + 1, np.diff(at)
        keys = keys_at(raw, begin - int(space), n + int(space))
        if space:
            keys[:, 0] = keys[:, 0] & np.uint64(2**64 - 256) | np.uint64(32)
            keys = np.concatenate([keys, keys_at(raw, begin[lead], n[lead])])
            n = np.concatenate([n + 1, n[lead]])
        self.units.again()
        short = np.nonzero(n <= SHORT)[0]
        first, size = np.zeros(len(n), np.int64), np.zeros(len(n), np.int64)
        first[short], size[short] = self.units.find(keys[short])
        with uncollected():
            lack = short[first[short] < 0]
            if lack.size:
                first[lack], size[lack] = self.learn_keys(keys[lack])
        far = np.nonzero(n > SHORT)[0]
        if far.size:
            strings = words.take(pa.array(np.append(np.arange(len(words)), lead)[far])).to_pylist()
            values = self.memory.find([" " + x if space and i < len(words) else x for i, x in zip(far.tolist(), strings, strict=True)])
            size[far] = np.fromiter(map(len, values), np.int64, len(values)) // self.dtype.itemsize
            first[far] = self.units.put(np.frombuffer(b"".join(values), self.dtype), size[far])
        return first, size

    def cut(self, text: str) -> list[str] | None:
        """Units of a text that isn't plain; None: ask the library."""
        return None if any(m in text for m in self.marks) or ODD_SPACE.search(text) else UNITS.findall(text)

    def flat(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in a row, and how many each has. Nulls are empty."""
        texts = pc.fill_null(texts, "")
        plain, n = self.plain(texts), np.zeros(len(texts), np.int64)
        words, of, at, lead = self.places(texts if plain.all() else texts.filter(pa.array(plain)))
        first, size = self.ids_of(words, lead)
        own = size[of]
        n[plain] = np.diff(np.append(0, np.cumsum(own))[at])
        ids = self.units.pool[stretches(first[of], own)]
        if plain.all():
            return ids, n
        rest = texts.filter(pa.array(~plain)).to_pylist()
        cuts = [self.cut(t) for t in rest]
        whole = iter(self.library_ids([t for t, c in zip(rest, cuts, strict=True) if c is None]))
        found = dict(zip(units := list(set(chain.from_iterable([c for c in cuts if c]))), self.memory.find(units), strict=True))
        other = [next(whole) if c is None else b"".join([found[u] for u in c]) for c in cuts]
        n[~plain] = [len(x) // self.dtype.itemsize for x in other]
        out, first = np.empty(n.sum(), self.dtype), np.repeat(plain, n)
        out[first], out[~first] = ids, np.frombuffer(b"".join(other), self.dtype)
        return out, n

    def encode(self, texts: list[str]) -> list[bytes]:
        ids, n = self.flat(pa.array(texts, pa.string()))
        return [x.tobytes() for x in np.split(ids, np.cumsum(n)[:-1])] if texts else []

    def ended(self, texts: pa.Array, end_id: int) -> tuple[pa.Array, np.ndarray]:
        """The ids of each text and end_id as a binary array, and how many each has."""
        ids, n = self.flat(texts)
        n = n + 1
        out, last = np.empty(n.sum(), self.dtype), np.cumsum(n) - 1
        own = np.ones(len(out), bool)
        own[last] = False
        out[own], out[last] = ids, end_id
        cuts = np.concatenate([[0], last + 1]) * self.dtype.itemsize
        return sliced(pa.py_buffer(out), cuts), n


def stretches(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The numbers from each `first` on, `size` of them, one stretch after the other. They are counted in 32 bits."""
    ends = np.cumsum(size)
    return np.repeat((first - ends + size).astype(np.int32), size) + np.arange(ends[-1] if len(ends) else 0, dtype=np.int32)


@contextmanager
def uncollected() -> Iterator[None]:
    """Without the search for cycles, which hundreds of thousands of new strings and tuples would set off."""
    on = gc.isenabled()
    gc.disable()
    try:
        yield
    finally:
        if on:
            gc.enable()


class Memory:
    """What is known of units: the first CACHE that are met, which the common ones are among."""

    def __init__(self, learn: Callable[[list[str]], list]):
        self.learn = learn
        self.known: dict[str, object] = {}

    def find(self, units: list[str]) -> list:
        """What is known of each of these different units, learnt first where need be."""
        with uncollected():
            return self._find(units)

    def _find(self, units: list[str]) -> list:
        out = list(map(self.known.get, units))
        lack = [u for u, x in zip(units, out, strict=True) if x is None]
        if lack:
            new = dict(zip(lack, self.learn(lack), strict=True))
            out = [new[u] if x is None else x for u, x in zip(units, out, strict=True)]
            if len(self.known) < CACHE:
                self.known.update(new)
        return out


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder for each file and worker process."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def slices(batch: pa.RecordBatch, col: str = "text", most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """A record batch in slices of about `most` bytes of text, one row at least."""
    sizes = pc.fill_null(pc.binary_length(batch.column(col)), 0).to_numpy(zero_copy_only=False)
    cuts = np.concatenate([[0], np.cumsum(sizes.astype(np.int64))]) // most
    edges = [0, *(np.nonzero(np.diff(cuts))[0] + 1).tolist(), batch.num_rows]
    for lo, hi in zip(edges, edges[1:], strict=False):
        if hi > lo:
            yield batch.slice(lo, hi - lo)


def texts_of(batch: pa.RecordBatch, col: str = "text") -> list[str]:
    """The texts of a batch; null is empty."""
    return [t or "" for t in batch.column(col).to_pylist()]
