"""Byte-level BPE encoding and decoding: a minimal perfect hash for whole pre-tokens, a heap over linked bytes for the rest."""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

VOCABULARY = "byte_bpe_50k.tiktoken"
# Keys of a bucket of the perfect hash, on average.
BUCKET_KEYS = 4
# Pre-tokens a task remembers, the longest of them, and the pre-tokens taken from a text at a time.
CACHE = 200_000
SHORT = 64
TAKE = 200_000
# Rows of an Arrow batch that are worked out together.
ROWS = 256

_GOLDEN = 0x9E3779B97F4A7C15


def _slots(hashes: np.ndarray, shift: np.ndarray, n: int) -> np.ndarray:
    """Slot of a key's hash under the displacement of its bucket."""
    x = hashes ^ (shift.astype(np.uint64) * np.uint64(_GOLDEN))
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return ((x ^ (x >> np.uint64(29))) % np.uint64(n)).astype(np.int64)


@dataclass
class PerfectHash:
    """Minimal perfect hash by hash and displace: n keys fill the slots 0 to n - 1.

    A key's 64-bit hash names its bucket; the bucket's displacement gives every key of it a
    slot of its own. Buckets are placed from the largest to the smallest; a bucket of one
    key takes any free slot and notes it as a negative number. What is no key also gets a
    slot, so the key kept there has to be compared.
    """

    shift: np.ndarray
    n: int

    @classmethod
    def build(cls, hashes: np.ndarray) -> PerfectHash:
        n = len(hashes)
        buckets = max(1, -(-n // BUCKET_KEYS))
        bucket = (hashes >> np.uint64(32)) % np.uint64(buckets)
        order = np.argsort(bucket, kind="stable")
        members = np.split(order, np.cumsum(np.bincount(bucket.astype(np.int64), minlength=buckets))[:-1])
        shift, taken = np.zeros(buckets, np.int64), np.zeros(n, bool)
        alone = []
        for b in sorted(range(buckets), key=lambda b: -len(members[b])):
            keys = hashes[members[b]]
            if len(keys) == 1:
                alone.append(b)
            if len(keys) < 2:
                continue
            at = 0
            while True:
                tries = np.arange(at, at + 256)
                spots = _slots(keys[None, :], tries[:, None], n)
                spread = np.sort(spots, axis=1)
                good = ~taken[spots].any(axis=1) & (spread[:, 1:] != spread[:, :-1]).all(axis=1)
                if good.any():
                    i = int(good.argmax())
                    shift[b], taken[spots[i]] = tries[i], True
                    break
                at += 256
        for b, slot in zip(alone, np.flatnonzero(~taken)):
            shift[b] = -int(slot) - 1
        return cls(shift, n)

    def slots(self, hashes: np.ndarray) -> np.ndarray:
        shift = self.shift[((hashes >> np.uint64(32)) % np.uint64(len(self.shift))).astype(np.int64)]
        return np.where(shift < 0, -shift - 1, _slots(hashes, np.maximum(shift, 0), self.n))


def _hashes(keys: list[bytes]) -> np.ndarray:
    import xxhash

    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(k) for k in keys), np.uint64, len(keys))


@dataclass
class ByteBpe:
    """Ranks of byte strings, with the pattern that cuts texts into pre-tokens."""

    pattern: str
    ranks: dict[bytes, int]
    table: PerfectHash
    keys: list[bytes]  # by slot
    packed: list[bytes]  # by slot: the id as four bytes, least first
    young: dict[str, bytes] = field(default_factory=dict, repr=False)
    old: dict[str, bytes] = field(default_factory=dict, repr=False)

    @classmethod
    def of(cls, ranks: dict[bytes, int], pattern: str) -> ByteBpe:
        words = list(ranks)
        hashes = _hashes(words)
        if len(set(hashes.tolist())) < len(words):
            raise ValueError("two byte strings share a 64-bit hash")
        table = PerfectHash.build(hashes)
        keys = [b""] * len(words)
        for w, slot in zip(words, table.slots(hashes).tolist()):
            keys[slot] = w
        return cls(pattern, ranks, table, keys, [ranks[k].to_bytes(4, "little") for k in keys])

    @classmethod
    def load(cls, path: str | None = None, pattern: str | None = None) -> ByteBpe:
        """Read a file of `base64 rank` lines; by default the public vocabulary and its pattern."""
        if path is None or pattern is None:
            import public_tokenizers

            path = path or public_tokenizers.path(VOCABULARY)
            pattern = pattern or public_tokenizers.PATTERN
        with open(path, "rb") as f:
            return cls.of({base64.b64decode(w): int(r) for w, r in (line.split() for line in f if line.strip())}, pattern)

    def merge(self, data: bytes) -> list[int]:
        """Ids of one pre-token: the adjacent pair of lowest rank is joined, the leftmost first, until none is left.

        A part is known by its first byte's place; `end` links it to the next part and `left`
        to the one before. The heap holds (rank, first place, end) of pairs; one whose parts
        have been joined otherwise is stale and passed over.
        """
        n, ranks = len(data), self.ranks
        end, left = list(range(1, n + 1)), list(range(-1, n - 1))
        alive = bytearray(b"\1") * n
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(data[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, a, c = heapq.heappop(heap)
            if not alive[a] or (b := end[a]) >= c or end[b] != c:
                continue
            end[a], alive[b] = c, 0
            if c < n:
                left[c] = a
                if (r := ranks.get(data[a : end[c]])) is not None:
                    heapq.heappush(heap, (r, a, end[c]))
            if (p := left[a]) >= 0 and (r := ranks.get(data[p:c])) is not None:
                heapq.heappush(heap, (r, p, c))
        out, at = [], 0
        while at < n:
            out.append(ranks[data[at : end[at]]])
            at = end[at]
        return out

    def resolve(self, words: list[str]) -> list[bytes]:
        """Packed ids of pre-tokens: one look-up for those in the vocabulary, the heap for the others."""
        data = [w.encode("utf-8", "surrogatepass") for w in words]
        slots = self.table.slots(_hashes(data)).tolist()
        return [
            self.packed[s] if self.keys[s] == d else np.array(self.merge(d), "<u4").tobytes()
            for d, s in zip(data, slots)
        ]

    def encode_packed(self, texts: list[str | None]) -> list[bytes]:
        """Packed ids of every text; new pre-tokens of all the texts are resolved together."""
        import regex

        pattern = regex.compile(self.pattern)
        out: list[list[bytes]] = [[] for _ in texts]
        waiting: list[tuple[int, list[str]]] = []
        held = 0

        def flush() -> None:
            nonlocal waiting, held
            wanted = set()
            for _, words in waiting:
                wanted.update(words)
            known = self._remembered(wanted)
            fetch = known.__getitem__
            for i, words in waiting:
                out[i].append(b"".join(map(fetch, words)))
            waiting, held = [], 0

        for i, t in enumerate(texts):
            if not t:
                continue
            if len(t) <= TAKE:
                portions: Iterable[list[str]] = [pattern.findall(t)]
            else:
                # A very long text goes in portions.
                found = pattern.finditer(t)
                portions = iter(lambda: [m.group() for m in islice(found, TAKE)], [])
            for words in portions:
                waiting.append((i, words))
                held += len(words)
                if held >= TAKE:
                    flush()
        flush()
        return [b"".join(x) for x in out]

    def _remembered(self, wanted: set[str]) -> dict[str, bytes]:
        """Packed ids of the wanted pre-tokens. What has not been met for CACHE new ones is forgotten."""
        got = {w: x for w in wanted if (x := self.young.get(w) or self.old.get(w)) is not None}
        todo = [w for w in wanted if w not in got]
        got.update(zip(todo, self.resolve(todo)))
        if len(self.young) + len(got) > CACHE:
            self.old, self.young = self.young, {}
        self.young.update((w, x) for w, x in got.items() if len(w) <= SHORT)
        return got

    def encode(self, text: str | None) -> list[int]:
        return np.frombuffer(self.encode_packed([text])[0], "<u4").tolist()

    def contents(self) -> pa.Array:
        """Bytes by id; null where no id is given out."""
        by_id: list[bytes | None] = [None] * (max(self.ranks.values(), default=-1) + 1)
        for w, r in self.ranks.items():
            by_id[r] = w
        return pa.array(by_id, pa.binary())


def _decoded(contents: pa.Array, ids: np.ndarray) -> bytes | None:
    """The bytes that ids stand for, null if one of them stands for none."""
    if len(ids) and (ids.min() < 0 or ids.max() >= len(contents)):
        return None
    got = contents.take(pa.array(ids, pa.int64()))
    if got.null_count:
        return None
    ends = np.frombuffer(got.buffers()[1], np.int32, len(got) + 1)
    return got.buffers()[2].slice(int(ends[0]), int(ends[-1] - ends[0])).to_pybytes() if len(ids) else b""


def _kinds(rows: DataFrame, names: list[str]) -> str:
    return ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in names)


def encode_texts(docs: DataFrame, model: ByteBpe, id_col: str = "doc_id", text_col: str = "text",
                 keep: list[str] | None = None, packed: bool = False) -> DataFrame:
    """(doc_id, *keep, ids, n_tokens) per row, from its whole text, without special tokens.

    Every match of the model's pattern is encoded for itself: as one id if the vocabulary
    holds it whole, else by merges. Results are remembered in a cache of bounded size.
    `packed` gives the ids as one binary value, four bytes each, least first, in place of a list.

    A null or empty text has no ids. Rows with a null id and repeated rows keep their row, an
    empty table gives no rows, and of other columns only those in `keep` are read. A very long
    text is worked through in portions of pre-tokens; one pre-token is held whole.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the vocabulary
    names = ["doc_id", *(keep or [])]
    kind = pa.binary() if packed else pa.list_(pa.int32())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            for at in range(0, b.num_rows, ROWS):
                part = b.slice(at, ROWS)
                ids = m.encode_packed(part.column("_bpe_text").to_pylist())
                n = pa.array([len(x) // 4 for x in ids], pa.int64())
                ids = pa.array(ids if packed else [np.frombuffer(x, "<i4") for x in ids], kind)
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in names), ids, n], [*names, "ids", "n_tokens"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), *(keep or []), F.col(text_col).alias("_bpe_text"))
    return rows.mapInArrow(run, f"{_kinds(rows, names)}, ids {'binary' if packed else 'array<int>'}, n_tokens long")


def decode_ids(rows: DataFrame, model: ByteBpe, id_col: str = "doc_id", ids_col: str = "ids",
               keep: list[str] | None = None) -> DataFrame:
    """(doc_id, *keep, data): the bytes that a row's ids, listed or packed, stand for.

    Null ids give null data, no ids empty data; so does null for a row that holds a null or
    an id which the vocabulary does not give out. The bytes of a cut list of ids need not be
    UTF-8, so they are no string.
    """
    contents = rows.sparkSession.sparkContext.broadcast(model.contents())
    names = ["doc_id", *(keep or [])]
    packed = isinstance(rows.schema[ids_col].dataType, BinaryType)

    def ids_of(x: pa.Scalar) -> np.ndarray:
        if packed:
            return np.frombuffer(x.as_buffer(), "<u4").astype(np.int64)
        return x.values.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, ROWS):
                part = b.slice(at, ROWS)
                data = [_decoded(contents.value, ids_of(x)) if x.is_valid else None for x in part.column("_bpe_ids")]
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(c) for c in names), pa.array(data, pa.binary())], [*names, "data"])

    x = rows.select(F.col(id_col).cast("long").alias("doc_id"), *(keep or []), F.col(ids_col).alias("_bpe_ids"))
    return x.mapInArrow(run, f"{_kinds(x, names)}, data binary")
