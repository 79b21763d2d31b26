"""SentencePiece encoding and decoding: unigram Viterbi over a double-array trie of pieces."""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
# A character without a piece of its own costs this much more than the rarest piece.
UNKNOWN_COST = 10.0
# Segments up to this many bytes are worked out together in arrays, longer ones one by one.
SHORT = 64
# Segments a task remembers, and the segments taken from a text at a time.
CACHE = 200_000
TAKE = 200_000

_PARTS = re.compile(r" *[^ \n]+| +|\n")


@dataclass
class DoubleArray:
    """A trie in two arrays: from state s, byte c leads to t = base[s] + c + 1 if check[t] is s."""

    base: np.ndarray
    check: np.ndarray
    value: np.ndarray

    @classmethod
    def build(cls, words: list[tuple[bytes, int]]) -> DoubleArray:
        trie: dict = {}
        for w, v in words:
            node = trie
            for c in w:
                node = node.setdefault(c, {})
            node[-1] = v
        size = 1 << 16
        base, check, value = (np.full(size, x, np.int32) for x in (0, -1, -1))
        used = np.zeros(size, bool)
        used[0] = True
        free = 1
        todo = [(0, trie)]
        while todo:
            state, node = todo.pop()
            value[state] = node.get(-1, -1)
            codes = np.array(sorted(c + 1 for c in node if c >= 0), np.int64)
            if not len(codes):
                continue
            at = -1
            start = free
            while at < 0:
                if start + 4096 + 600 > size:
                    base, check, value, used = (
                        np.concatenate([x, np.full(size, y, x.dtype)])
                        for x, y in ((base, 0), (check, -1), (value, -1), (used, False)))
                    size *= 2
                # First place where all children fit, among the next free ones for the first child.
                first = np.flatnonzero(~used[start : start + 4096]) + start
                first = first[first > codes[0]]
                fits = ~used[first[:, None] - codes[0] + codes].any(axis=1)
                if fits.any():
                    at = int(first[fits.argmax()] - codes[0])
                start += 4096
            base[state] = at
            used[at + codes] = True
            check[at + codes] = state
            while used[free]:
                free += 1
            todo += [(at + int(c), node[int(c) - 1]) for c in codes]
        return cls(base, check, value)


@dataclass
class PieceModel:
    """Pieces with log scores. In the trie and in texts a space stands for the white-space marker."""

    trie: DoubleArray
    scores: np.ndarray
    content: list[bytes]  # what a piece stands for; a byte piece for its byte
    byte_ids: list[int]
    longest: int
    unknown: float
    splits: bool  # whether no piece reaches over a place where texts are cut into segments
    young: dict[str, bytes] = field(default_factory=dict, repr=False)
    old: dict[str, bytes] = field(default_factory=dict, repr=False)

    @classmethod
    def load(cls, path: str = MODEL, log_scores: str = "zipf") -> PieceModel:
        """Read the pieces of a public model file.

        `log_scores`: "model" takes the file's scores, right for unigram models. "zipf" is for
        files that hold merge ranks in place of scores: the piece of rank r gets the log of
        1 / (r + 1), the share that Zipf's law gives it.
        """
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        words, content, scores = [], [], []
        bytes_of: dict[int, int] = {}
        for i in range(sp.get_piece_size()):
            piece = sp.id_to_piece(i)
            scores.append(sp.get_score(i))
            if sp.is_byte(i):
                bytes_of[int(piece[3:5], 16)] = i
                content.append(bytes([int(piece[3:5], 16)]))
            elif sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i):
                content.append(b"")
            else:
                content.append(piece.replace(SPACE, " ").encode())
                words.append((content[-1], i))
        if log_scores == "zipf":
            order = sorted((i for _, i in words), key=lambda i: (-scores[i], i))
            for rank, i in enumerate(order):
                scores[i] = -float(np.log(rank + 1))
        if len(bytes_of) != 256:
            raise ValueError("the model has no byte pieces")
        least = min(scores[i] for _, i in words)
        splits = all(b"\n" not in w or len(w) == 1 for w, _ in words) and all(b" " not in w.lstrip(b" ") for w, _ in words)
        return cls(DoubleArray.build(words), np.array(scores), content, [bytes_of[b] for b in range(256)],
                   max(len(w) for w, _ in words), least - UNKNOWN_COST, splits)

    # One segment at a time, for long ones.
    def _viterbi(self, data: bytes) -> tuple[int, ...]:
        base, check, value = self._lists()
        n = len(data)
        best = [float("-inf")] * (n + 1)
        best[0] = 0.0
        back: list[tuple[int, int]] = [(0, -1)] * (n + 1)
        at = 0
        while at < n:
            width = 1
            while at + width < n and data[at + width] & 0xC0 == 0x80:
                width += 1
            state, end, own = 0, at, False
            here = best[at]
            while end < n:
                t = base[state] + data[end] + 1
                if check[t] != state:
                    break
                state = t
                end += 1
                v = value[state]
                if v >= 0:
                    own = own or end == at + width
                    if here + self._score_list[v] > best[end]:
                        best[end] = here + self._score_list[v]
                        back[end] = (at, v)
            if not own and here + self.unknown > best[at + width]:
                best[at + width] = here + self.unknown
                back[at + width] = (at, -1)
            at += width
        out: list[int] = []
        while n:
            at, v = back[n]
            out += [v] if v >= 0 else [self.byte_ids[b] for b in reversed(data[at:n])]
            n = at
        return tuple(reversed(out))

    def _lists(self) -> tuple[list[int], list[int], list[int]]:
        if "lists" not in self.__dict__:
            self.__dict__["lists"] = tuple(x.tolist() for x in (self.trie.base, self.trie.check, self.trie.value))
            self.__dict__["_score_list"] = self.scores.tolist()
        return self.__dict__["lists"]

    def _viterbi_many(self, data: list[bytes]) -> list[tuple[int, ...]]:
        """The same for many short segments of about one length, position by position in arrays."""
        base, check, value = self.trie.base, self.trie.check, self.trie.value
        n, wide = len(data), max(map(len, data))
        length = np.array([len(d) for d in data])
        codes = np.zeros((n, wide + 1), np.int32)  # 0 is no byte
        codes[:, :wide] = np.frombuffer(b"".join([d.ljust(wide, b"\0") for d in data]), np.uint8).reshape(n, wide)
        codes[:, :wide] += np.arange(wide) < length[:, None]
        starts = np.ones((n, wide + 1), bool)
        starts[:, :wide] = ((codes[:, :wide] - 1) & 0xC0) != 0x80
        best = np.full((n, wide + 1), -np.inf)
        best[:, 0] = 0.0
        back = np.zeros((n, wide + 1), np.int32)
        piece = np.full((n, wide + 1), -1, np.int32)
        for at in range(wide):
            rows = np.flatnonzero(starts[:, at] & (length > at))
            if not len(rows):
                continue
            alone = rows
            width = np.ones(len(rows), np.int32)
            for k in range(1, 4):
                if at + k < wide:
                    width += (width == k) & ~starts[rows, at + k] & (length[rows] > at + k)
            state = np.zeros(len(rows), np.int32)
            own = np.zeros(len(rows), bool)
            index = np.arange(len(rows))
            for end in range(at + 1, min(at + self.longest, wide) + 1):
                c = codes[rows, end - 1]
                t = base[state] + c
                on = (c > 0) & (check[t] == state)
                rows, state, index = rows[on], t[on], index[on]
                if not len(rows):
                    break
                v = value[state]
                has = v >= 0
                r, v, k = rows[has], v[has], index[has]
                own[k[width[k] == end - at]] = True
                reach = best[r, at] + self.scores[v]
                up = reach > best[r, end]
                r = r[up]
                best[r, end], back[r, end], piece[r, end] = reach[up], at, v[up]
            lone = ~own
            r, to = alone[lone], at + width[lone]
            reach = best[r, at] + self.unknown
            up = reach > best[r, to]
            r, to = r[up], to[up]
            best[r, to], back[r, to], piece[r, to] = reach[up], at, -1
        back, piece = back.tolist(), piece.tolist()
        out = []
        for d, b, p in zip(data, back, piece):
            ids: list[int] = []
            end = len(d)
            while end:
                at, v = b[end], p[end]
                ids += [v] if v >= 0 else [self.byte_ids[x] for x in reversed(d[at:end])]
                end = at
            out.append(tuple(reversed(ids)))
        return out

    def _learn(self, segments: Iterable[str]) -> dict[str, bytes]:
        """Packed ids of new segments."""
        by_length: dict[int, list[tuple[bytes, str]]] = {}
        for s in segments:
            d = s.encode("utf-8", "surrogatepass")
            by_length.setdefault(len(d), []).append((d, s))
        got: dict[str, bytes] = {}
        part: list[tuple[bytes, str]] = []
        for length in sorted(by_length):
            if length > SHORT:
                got.update((s, _packed(self._viterbi(d))) for d, s in by_length[length])
                continue
            # Segments of one length together, with those of a few bytes less where there are few.
            if part and (len(part) > 1024 or length > len(part[0][0]) + 6):
                self._learn_together(part, got)
                part = []
            part += by_length[length]
        if part:
            self._learn_together(part, got)
        return got

    def _learn_together(self, part: list[tuple[bytes, str]], got: dict[str, bytes]) -> None:
        for at in range(0, len(part), 8192):
            some = part[at : at + 8192]
            for (_, s), ids in zip(some, self._viterbi_many([d for d, _ in some])):
                got[s] = _packed(ids)

    def _remembered(self, wanted: set[str]) -> dict[str, bytes]:
        """Packed ids of the wanted segments. What has not been met for CACHE new ones is forgotten."""
        got = {w: x for w in wanted if (x := self.young.get(w) or self.old.get(w)) is not None}
        got.update(self._learn(w for w in wanted if w not in got))
        if len(self.young) + len(got) > CACHE:
            self.old, self.young = self.young, {}
        self.young.update((w, x) for w, x in got.items() if len(w) <= SHORT)
        return got

    def encode_packed(self, texts: list[str | None]) -> list[bytes | None]:
        """Ids of every text, four bytes each; the new segments of all the texts are worked out together."""
        out: list[list[bytes] | None] = [None if t is None else [] for t in texts]
        waiting: list[tuple[int, list[str]]] = []
        held = 0

        def flush() -> None:
            nonlocal waiting, held
            wanted: set[str] = set()
            for _, parts in waiting:
                wanted.update(parts)
            find = self._remembered(wanted).__getitem__
            for i, parts in waiting:
                out[i].append(b"".join(map(find, parts)))
            waiting, held = [], 0

        for i, t in enumerate(texts):
            if not t:
                continue
            text = " " + t
            if len(text) <= TAKE or not self.splits:
                waiting.append((i, _PARTS.findall(text) if self.splits else [text]))
                held += len(waiting[-1][1])
            else:
                # A very long text goes in portions.
                found = _PARTS.finditer(text)
                while parts := [m.group() for m in islice(found, TAKE)]:
                    waiting.append((i, parts))
                    flush()
            if held >= TAKE:
                flush()
        flush()
        return [None if x is None else b"".join(x) for x in out]

    def encode_many(self, texts: list[str | None]) -> list[list[int] | None]:
        return [None if x is None else np.frombuffer(x, "<i4").tolist() for x in self.encode_packed(texts)]

    def decode(self, ids: Iterable[int]) -> str:
        """The text of a list of ids: markers become spaces, byte pieces their bytes, and the leading space goes."""
        data = b"".join(map(self.content.__getitem__, ids)).decode("utf-8", "replace")
        return data.removeprefix(" ")


def _packed(ids: Iterable[int]) -> bytes:
    return array("i", ids).tobytes()


def encode_texts(docs: DataFrame, model: PieceModel, id_col: str = "doc_id", text_col: str = "text",
                 keep: list[str] | None = None) -> DataFrame:
    """(doc_id, *keep, ids, n_tokens, n_bytes, round_trip) per document, from its whole text.

    A space is put before the text, spaces become the white-space marker, and of all ways to
    part the text into pieces the one with the largest sum of log scores is taken, of equal
    ones the one whose last piece is longest. A character without a piece of its own may
    also be written as byte pieces, one for each of its UTF-8 bytes; so is a marker
    character of the text itself, which a space cannot be mistaken for. No other
    normalising: `round_trip` tells that the ids decode to the very text. Segments between
    spaces are worked out once and remembered in a cache of bounded size.
    A null text has null ids, no tokens and a null `round_trip`; an empty one has no ids.
    Rows with a null id and repeated rows keep their row; an empty table gives no rows; of
    other columns only those in `keep` are read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the vocabulary
    names = ["doc_id", *(keep or [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        pieces = pa.array(m.content, pa.binary())
        is_byte = np.zeros(len(m.content), bool)
        is_byte[m.byte_ids] = True
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                texts = part.column("_piece_text").to_pylist()
                packed = m.encode_packed(texts)
                ids = np.frombuffer(b"".join(x for x in packed if x), "<i4")
                ends = np.append(0, np.cumsum([len(x or b"") // 4 for x in packed]))
                missing = np.array([x is None for x in packed])
                n_bytes = np.append(0, np.cumsum(is_byte[ids]))[ends]
                data = pieces.take(pa.array(ids))
                places = np.frombuffer(data.buffers()[1], np.int32, len(ids) + 1)[ends] if len(ids) else ends
                content = data.buffers()[2].to_pybytes() if len(ids) else b""
                same = [None if t is None else content[i:j].removeprefix(b" ") == t.encode("utf-8", "surrogatepass")
                        for t, i, j in zip(texts, places, places[1:])]
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32(), mask=np.append(missing, False)), pa.array(ids, pa.int32()))
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(c) for c in names), lists, pa.array(np.diff(ends), pa.int64()),
                     pa.array(np.diff(n_bytes), pa.int64()), pa.array(same, pa.bool_())],
                    [*names, "ids", "n_tokens", "n_bytes", "round_trip"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), *(keep or []), F.col(text_col).alias("_piece_text"))
    kinds = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in names)
    return rows.mapInArrow(run, f"{kinds}, ids array<int>, n_tokens long, n_bytes long, round_trip boolean")


def decode_ids(rows: DataFrame, model: PieceModel, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(doc_id, text): what `encode_texts` took apart; null ids give a null text, no ids an empty one."""
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            texts = [None if x is None else m.decode(x) for x in b.column("_ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    x = rows.select(F.col(id_col).cast("long").alias("doc_id"), F.col(ids_col).alias("_ids"))
    return x.mapInArrow(run, "doc_id long, text string")
