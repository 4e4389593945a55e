"""Byte-level BPE encoding and decoding as a monoid tree reduction.

A text is the concatenation of the matches of the split pattern, each encoded separately.
A match is halved down to strings that are tokens themselves, single bytes at last, and the
halves' tokens are joined on the way up: the last token of the left and the first of the right are re-encoded together, over windows that
grow until the tokens at both edges of the window are stable. Stable means that the pair of
neighbours across the edge, encoded by itself, gives that pair again: a sequence whose
neighbouring pairs all have this property is the encoding of its bytes, so tokens outside
the window can't change. A window that reaches both ends is a plain encoding, so that the
reduction always ends. Before a window grows, a token at the end of the left that commutes
with a run of equal tokens at the start of the right (the same bytes in either order, as in
runs of one character) is moved behind the run, as long as the pairs stay stable: so long
runs are joined without being encoded again. Halves with equal bytes are encoded once.
Decoding concatenates up a tree over the text's ids.

Runs as ``mapInArrow``: rows are independent, nothing is shuffled, and each Python worker
keeps bounded memos of matches, windows and pairs.

Defined cases: a null text is empty (no tokens, the digest of nothing); any bytes of valid
UTF-8 are covered, as all 256 single bytes have ranks; an empty table gives an empty table;
repeated rows are encoded alike; a clashing input column is replaced.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from array import array
from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from accordance.llm.common import importable, plus

#: Memos hold at most so many entries, twice; longer matches and windows aren't remembered.
MEMO, SHORT, HALF = 80_000, 64, 8


@lru_cache(4)
def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class Encoder:
    """Encodes single matches. ``joins`` counts the inner nodes of all trees, ``merged`` the bytes that were merged in windows."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks, self.bytes_of = ranks, {v: k for k, v in ranks.items()}
        #: What two tokens side by side become; for most they stay.
        self.pairs: dict[tuple[int, int], tuple[int, ...]] = {}
        self.nodes: dict[bytes, tuple[int, ...]] = {}
        self.joins = self.merged = 0

    def merge(self, piece: bytes) -> list[int]:
        """Plain byte-pair merging, lowest rank first, leftmost among equals: of windows, and as the measure of the tests."""
        ranks = self.ranks
        if (whole := ranks.get(piece)) is not None:
            return [whole]
        if len(piece) > SHORT:
            return self.merge_long(piece)
        parts = [piece[i : i + 1] for i in range(len(piece))]
        none = 1 << 60
        costs = [ranks.get(parts[i] + parts[i + 1], none) for i in range(len(parts) - 1)]
        while costs:
            low = min(costs)
            if low == none:
                break
            i = costs.index(low)
            parts[i] += parts.pop(i + 1)
            costs.pop(i)
            if i < len(costs):
                costs[i] = ranks.get(parts[i] + parts[i + 1], none)
            if i:
                costs[i - 1] = ranks.get(parts[i - 1] + parts[i], none)
        return [ranks[p] for p in parts]

    def merge_long(self, piece: bytes) -> list[int]:
        """The same with a heap of pairs, n log n steps."""
        ranks, n = self.ranks, len(piece)
        end, before, after = list(range(1, n + 1)), list(range(-1, n - 1)), list(range(1, n + 1))
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, stop = heapq.heappop(heap)
            j = after[i] if end[i] else n
            if j >= n or end[j] != stop:  # one of the two has changed since
                continue
            end[i], after[i], end[j] = stop, after[j], 0
            if after[i] < n:
                before[after[i]] = i
                if (r := ranks.get(piece[i : end[after[i]]])) is not None:
                    heapq.heappush(heap, (r, i, end[after[i]]))
            if before[i] >= 0 and (r := ranks.get(piece[before[i] : stop])) is not None:
                heapq.heappush(heap, (r, before[i], stop))
        return [ranks[piece[i : end[i]]] for i in range(n) if end[i]]

    def pair(self, a: int, b: int) -> tuple[int, ...]:
        """The encoding of two tokens' bytes."""
        if (known := self.pairs.get((a, b))) is None:
            if len(self.pairs) >= 2 * MEMO:
                self.pairs.clear()
            key, known = (a, b), tuple(self.merge(self.bytes_of[a] + self.bytes_of[b]))
            known = self.pairs[key] = key if known == key else known  # most stay: one tuple, not two
        return known

    def stable(self, a: int, b: int) -> bool:
        """Whether tokens a, b side by side stay as they are."""
        return self.pair(a, b) == (a, b)

    def encode(self, piece: bytes) -> Sequence[int]:
        """The tree: halves, then their join."""
        if len(piece) > SHORT:
            return self._long(piece, {})
        return self._node(piece) if piece else ()

    def _node(self, piece: bytes) -> tuple[int, ...]:
        if (token := self.ranks.get(piece)) is not None:
            return (token,)
        if (known := self.nodes.get(piece)) is None:
            half = len(piece) // 2
            known = self.join(self._node(piece[:half]), self._node(piece[half:]))
            if len(piece) <= HALF:
                if len(self.nodes) >= MEMO:
                    self.nodes.clear()
                self.nodes[piece] = known
        return known

    def _long(self, piece: bytes, own: dict[bytes, tuple[int, ...]]) -> tuple[int, ...]:
        """The same, with a memo of this match's own halves."""
        if len(piece) <= SHORT:
            return self._node(piece)
        if (known := own.get(piece)) is None:
            half = len(piece) // 2
            known = own[piece] = self.join(self._long(piece[:half], own), self._long(piece[half:], own))
        return known

    def join(self, left: tuple[int, ...], right: tuple[int, ...]) -> tuple[int, ...]:
        """The encoding of the concatenation, from those of its parts."""
        self.joins += 1
        a, b = left[-1], right[0]
        if (inner := self.pairs.get((a, b))) is None:
            inner = self.pair(a, b)
        if len(inner) == 2 and inner[0] == a:
            return left + right
        if len(left) == 1 == len(right):
            return inner
        if len(right) > 2:
            left, right = self.commuted(left, right)
            if not right:
                return left
        reach = 1
        while True:
            i, j = min(reach, len(left)), min(reach, len(right))
            inner = self.pair(left[-1], right[0]) if reach == 1 else self.window(left[len(left) - i :] + right[:j])
            if (i == len(left) or self.stable(left[-i - 1], inner[0])) and (j == len(right) or self.stable(inner[-1], right[j])):
                return left[: len(left) - i] + inner + right[j:]
            reach *= 2

    def commuted(self, left: tuple[int, ...], right: tuple[int, ...]) -> tuple[tuple[int, ...], tuple[int, ...]]:
        """The same bytes, with left's last tokens moved behind the run of equal tokens that right starts with."""
        t, m = right[0], 1
        while m < len(right) and right[m] == t:
            m += 1
        if m < 3:  # a window is cheaper
            return left, right
        tail: tuple[int, ...] = ()
        while left and left[-1] != t and self.bytes_of[left[-1]] + self.bytes_of[t] == self.bytes_of[t] + self.bytes_of[left[-1]]:
            left, tail = left[:-1], left[-1:] + tail
        if not tail or not self.stable(t, tail[0]) or not self.stable(t, t) or (left and not self.stable(left[-1], t)):
            return left + tail, right
        return left + (t,) * m + tail, right[m:]

    def window(self, tokens: tuple[int, ...]) -> tuple[int, ...]:
        piece = b"".join([self.bytes_of[t] for t in tokens])
        self.merged += len(piece)
        return tuple(self.merge(piece))

    def decode(self, ids: Sequence[int]) -> bytes:
        """Concatenation up the tree."""
        if len(ids) <= 256:
            return b"".join([self.bytes_of[t] for t in ids])
        half = len(ids) // 2
        return self.decode(ids[:half]) + self.decode(ids[half:])


@lru_cache(2)
def _encoder(path: str) -> Encoder:
    return Encoder(load_ranks(path))


class Matches:
    """Splits texts and encodes their matches, with a memo of short ones in two halves: a full half replaces the other, so that frequent matches stay."""

    def __init__(self, ranks_path: str, pattern: str, decimal: bool = False):
        import regex

        self.encoder, self.split, self.decimal = _encoder(ranks_path), regex.compile(pattern).findall, decimal
        self.new: dict[str, bytes | tuple[bytes, str]] = {}
        self.old: dict[str, bytes | tuple[bytes, str]] = {}

    def of(self, text: str | None) -> list:
        """Each match's ids as an array's bytes; with ``decimal`` a pair of these and the ids in decimal."""
        found = self.split(text) if text else []
        out = list(map(self.new.get, found))
        if None in out:
            new, old = self.new, self.old
            for i, hit in enumerate(out):
                if hit is None:
                    x = found[i]
                    if (hit := new.get(x) or old.get(x)) is None:
                        ids = self.encoder.encode(x.encode())
                        hit = array("i", ids).tobytes()
                        if self.decimal:
                            hit = hit, " ".join(map(str, ids))
                    if len(x) <= SHORT:
                        if len(new) >= MEMO:
                            self.new, self.old = {}, new
                            new, old = self.new, self.old
                        new[x] = hit
                    out[i] = hit
        return out


def joined_ids(found: list[bytes]) -> array:
    return array("i", b"".join(found))


def encode_batches(batches: Iterator[pa.RecordBatch], ranks_path: str, pattern: str) -> Iterator[pa.RecordBatch]:
    """(doc_id, text) to (doc_id, n_tokens, ids, decoded)."""
    matches = Matches(ranks_path, pattern, decimal=True)
    for batch in batches:
        counts, ids_out, back = [], [], []
        for text in batch.column(1):
            found = matches.of(text.as_py())
            ids = joined_ids([x[0] for x in found])
            counts.append(len(ids))
            ids_out.append(hashlib.sha256(" ".join([x[1] for x in found]).encode()).hexdigest())
            back.append(hashlib.sha256(matches.encoder.decode(ids)).hexdigest())
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(ids_out, pa.string()), pa.array(back, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])


def token_digests(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 for every text."""
    importable(docs.sparkSession)
    return docs.select("doc_id", "text").mapInArrow(lambda it: encode_batches(it, ranks_path, pattern), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def _ids(batches: Iterator[pa.RecordBatch], ranks_path: str, pattern: str) -> Iterator[pa.RecordBatch]:
    matches = Matches(ranks_path, pattern)
    for batch in batches:
        flat, ends = array("i"), array("i", [0])
        for text in batch.column(batch.schema.get_field_index("text")):
            flat += joined_ids(matches.of(text.as_py()))
            ends.append(len(flat))
        lists = pa.ListArray.from_arrays(pa.array(np.frombuffer(ends, np.int32)), pa.array(np.frombuffer(flat, np.int32)))
        yield pa.RecordBatch.from_arrays([*batch.columns, lists], [*batch.schema.names, "ids"])


def _texts(batches: Iterator[pa.RecordBatch], ranks_path: str) -> Iterator[pa.RecordBatch]:
    encoder = _encoder(ranks_path)
    for batch in batches:
        at = batch.schema.get_field_index("ids")
        back = pa.array([encoder.decode(x.values.to_numpy().tolist()).decode("utf-8", "replace") if x.is_valid else None for x in batch.column(at)], pa.string())
        yield pa.RecordBatch.from_arrays([*batch.columns, back], [*batch.schema.names, "decoded"])


def encode(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """``docs`` with its token ids as ``ids``."""
    importable(docs.sparkSession)
    base = docs.drop("ids")
    schema = plus(base.schema, ids="array<int>")
    return base.mapInArrow(lambda it: _ids(it, ranks_path, pattern), schema)


def decode(tokens: DataFrame, ranks_path: str) -> DataFrame:
    """``tokens`` with the text of ``ids`` as ``decoded``."""
    importable(tokens.sparkSession)
    base = tokens.drop("decoded")
    return base.mapInArrow(lambda it: _texts(it, ranks_path), plus(base.schema, decoded="string"))


def round_trip(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """``docs`` with ids and decoded, in one pass: a task then holds one Python worker, not two."""
    importable(docs.sparkSession)
    base = docs.drop("ids", "decoded")
    return base.mapInArrow(lambda it: _texts(_ids(it, ranks_path, pattern), ranks_path), plus(base.schema, ids="array<int>", decoded="string"))
