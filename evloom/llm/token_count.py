"""Token counts by the whole-token shortcut.

Proved once per worker, before any text is read: which strings of the vocabulary the library encodes,
alone, as exactly one token. A pre-token among them counts one without a merge; merges are run only
for the rest, and each distinct one once per batch memory. A text outside the plain alphabet of
`bpe` is counted by the library.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from .bpe import CACHE, PLAIN, Encoder, Memory, byte_symbols, encoder, slices
from .common import small_batches

SCHEMA = "doc_id long, n_bytes long, n_tokens long, over_limit boolean"


def whole_tokens(enc: Encoder) -> frozenset[str]:
    """The vocabulary's strings that, encoded alone by the library, are one token."""
    back = {s: b for b, s in enumerate(byte_symbols())}
    strings = set()
    for token in enc.vocab:
        core = token[: -len(enc.end)] if enc.end and token.endswith(enc.end) else token
        try:
            strings.add(bytes(back[c] for c in core).decode())
        except (KeyError, UnicodeDecodeError):
            continue  # half a character, or a special token: never a whole pre-token
    found = sorted(strings - {""})
    one = [len(ids) == enc.dtype.itemsize for ids in enc.library_ids(found)]
    return frozenset(s for s, alone in zip(found, one, strict=True) if alone)


class Counter:
    def __init__(self, path: str):
        self.enc = encoder(path)
        self.whole = whole_tokens(self.enc)
        self.by_piece: dict[str, int] = {}
        self.memory = Memory(self.learn)

    def learn(self, units: list[str]) -> list[int]:
        """The token count of each of these different units."""
        enc, pieces, whole, size = self.enc, self.by_piece, self.whole, self.enc.dtype.itemsize
        rest = [u for u in units if u not in whole]
        odd = [u for u in rest if not PLAIN.fullmatch(u)]
        known = {u: len(ids) // size for u, ids in zip(odd, enc.library_ids(odd), strict=True)}
        split = {u: enc.pieces.findall(u.lower() if enc.words else u) for u in rest if u not in known}
        lack = list(set(chain.from_iterable(split.values())).difference(pieces, whole))
        pieces.update((p, len(ids) // size) for p, ids in zip(lack, enc.merge(lack), strict=True))
        known.update((u, sum([1 if p in whole else pieces[p] for p in ps])) for u, ps in split.items())
        if len(pieces) > CACHE:
            for p in lack:
                del pieces[p]
        return [known.get(u, 1) for u in units]

    def count(self, texts: pa.Array) -> np.ndarray:
        """The token count of each text. Nulls are empty."""
        texts = pc.fill_null(texts, "")
        plain, out = self.enc.plain(texts), np.zeros(len(texts), np.int64)
        units, of, at = self.enc.distinct(texts.filter(pa.array(plain)))
        size = np.array(self.memory.find(units), np.int64)
        out[plain] = np.diff(np.concatenate([np.zeros(1, np.int64), np.cumsum(size[of])])[at])
        rest = texts.filter(pa.array(~plain)).to_pylist()
        cuts = [self.enc.cut(t) for t in rest]
        whole = iter(self.enc.library_ids([t for t, c in zip(rest, cuts, strict=True) if c is None]))
        found = dict(zip(units := list(set(chain.from_iterable([c for c in cuts if c]))), self.memory.find(units), strict=True))
        out[~plain] = [len(next(whole)) // self.enc.dtype.itemsize if c is None else sum([found[u] for u in c]) for c in cuts]
        return out


_COUNTERS: dict[str, Counter] = {}


def counter(path: str) -> Counter:
    if path not in _COUNTERS:
        _COUNTERS[path] = Counter(path)
    return _COUNTERS[path]


def token_counts(docs: DataFrame, tokenizer: str, *, limit: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit (n_tokens > limit) for every row of `docs`, rows in place.

    Null text: 0 bytes, 0 tokens. Null id: passed on. Repeated rows: each counted. Very long texts
    are counted whole, one at a time. Empty table: no rows. Other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tally = counter(tokenizer)
        for batch in batches:
            for part in slices(batch, most=8 << 20):
                n = pa.array(tally.count(part.column("text")))
                n_bytes = pc.fill_null(pc.binary_length(part.column("text")), 0).cast(pa.int64())
                yield pa.record_batch([part.column("doc_id"), n_bytes, n, pc.greater(n, limit)], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    small_batches(docs.sparkSession)
    return docs.selectExpr(f"cast(`{id_col}` as long) as doc_id", f"`{text_col}` as text").mapInArrow(run, SCHEMA)
