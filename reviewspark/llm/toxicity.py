"""Toxic texts by compression distance: two zstandard dictionaries, the lengths of short windows under each."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reviewspark.llm.common import text_key
from reviewspark.llm.samples import labelled_sample

WINDOW = 96
# Bound of the training sample: texts of each class, and parts of PART characters of each.
TEXTS_PER_CLASS = 2000
PARTS = 4
PART = 1500
BASE_BYTES = 16384
TAIL_BYTES = 4000
# A word beginning belongs to a class's own part if it was met in this many different
# surroundings, and in so many times the share of the other class.
FIRST, LAST = 4, 6
# Stands between the first LAST bytes of a word and its rest.
MARK = b"|"
LEAST_PLACES = 8
LIFT = 8.0
# Only matches of this many bytes count; shorter ones are chance.
MATCH = 6
# A window that saves so many bytes saves much.
MUCH = 5
THRESHOLD = 0.3


def windows(data: bytes, size: int = WINDOW) -> Iterator[bytes]:
    """Parts of at most `size` bytes that together hold all of `data`, cut at spaces where there are any."""
    at = 0
    while at < len(data):
        stop = at + size
        if stop < len(data):
            space = data.rfind(b" ", at + 1, stop)
            stop = space if space > 0 else stop
        yield data[at:stop] + b" "
        at = stop


def marked(text: str | None) -> bytes:
    """A whole text in lower case, one space between words, the beginnings of long words set off.

    The mark ties a match to a word's beginning: the same syllables inside a word are no match.
    """
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    return b" ".join([w if len(w) <= LAST else w[:LAST] + MARK + w[LAST:] for w in words])


def _places(texts: list[bytes]) -> Counter:
    """Different surroundings (word before, word after) of each word: copies of a text count once."""
    met = set()
    for t in texts:
        words = t.split()
        met.update(zip([b"", *words], words, [*words[1:], b""]))
    return Counter(w for _, w, _ in met)


def _beginnings(places: Counter) -> Counter:
    """The same by the first FIRST to LAST bytes of a word, and by whole words up to LAST bytes."""
    out: Counter = Counter()
    for w, n in places.items():
        for k in range(min(FIRST, len(w)), min(LAST, len(w)) + 1):
            out[w[:k]] += n
    return out


def _own_pieces(own: Counter, other: Counter) -> list[bytes]:
    """Beginnings of LAST bytes that a class has and the other has not, as they stand in a marked
    text, the most frequent last. A shorter beginning that qualifies qualifies all its longer ones.
    """
    n_own, n_other = max(1, own.total()), max(1, other.total())
    mine, theirs = _beginnings(own), _beginnings(other)

    def stands(b: bytes) -> bool:
        n = mine[b]
        return n >= LEAST_PLACES and n / n_own > LIFT * (theirs[b] + 1) / n_other

    pieces: Counter = Counter()
    for w, n in own.items():
        if any(stands(w[:k]) for k in range(min(FIRST, len(w)), min(LAST, len(w)) + 1)):
            pieces[b" " + (w[:LAST] + MARK if len(w) > LAST else w) + b" "] += n
    return [p for n, p in sorted((n, p) for p, n in pieces.items())]


@dataclass
class ToxicityModel:
    """Both dictionaries and the calibration of a text's features."""

    toxic: bytes
    ordinary: bytes
    weights: np.ndarray

    def compressors(self) -> tuple[zstandard.ZstdCompressor, zstandard.ZstdCompressor]:
        """Literals are left as they are (fast strategy with a target length), so a window's
        length changes only by the matches its dictionary offers."""
        p = zstandard.ZstdCompressionParameters(
            compression_level=3, window_log=16, hash_log=16, chain_log=16, min_match=MATCH, target_length=1,
            strategy=zstandard.STRATEGY_FAST, write_content_size=False, write_checksum=False, write_dict_id=False)
        out = []
        for content in (self.toxic, self.ordinary):
            d = zstandard.ZstdCompressionDict(content)
            d.precompute_compress(compression_params=p)
            out.append(zstandard.ZstdCompressor(dict_data=d, compression_params=p))
        return out[0], out[1]


def features(text: str | None, compressors: tuple) -> tuple[float, ...]:
    """Of a whole text: mean and largest saving of a window, mean and sum of what is saved, share of
    windows that save much and that save at all, number of windows."""
    toxic, ordinary = compressors
    data = marked(text)
    n = total = beyond = many = 0
    most = top = 0
    for w in windows(data):
        saved = len(ordinary.compress(w)) - len(toxic.compress(w))
        n += 1
        total += saved
        most = max(most, saved)
        if saved > 0:
            beyond += saved
            many += saved >= MUCH
            top += 1
    k = max(1, n)
    return (total / k, float(most), beyond / k, min(beyond, 40.0), many / k, top / k, float(np.log1p(n)))


def _expand(x: np.ndarray) -> np.ndarray:
    """With the square roots of mean and share, and a constant."""
    return np.column_stack([x, np.sqrt(x[:, 2]), np.sqrt(x[:, 4]), np.ones(len(x))])


def _logistic(x: np.ndarray, y: np.ndarray, w: np.ndarray, rounds: int = 30, ridge: float = 1e-2) -> np.ndarray:
    """Weighted logistic regression by Newton's steps; columns are scaled inside."""
    scale = np.maximum(np.abs(x).max(axis=0), 1e-9)
    z = x / scale
    beta = np.zeros(z.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ beta, -30, 30)))
        h = (z * (w * p * (1 - p))[:, None]).T @ z + ridge * np.eye(len(beta))
        beta = beta + np.linalg.solve(h, z.T @ (w * (y - p)) - ridge * beta)
    return beta / scale


def fit_toxicity(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
    texts: int = TEXTS_PER_CLASS,
) -> ToxicityModel | None:
    """Dictionaries and calibration from at most `texts` texts of each class; None without both classes.

    `labels` has (id, label) of the documents to learn from; other labels than 0 and 1, null
    ids and documents that are null or empty are left out.

    Each dictionary is a part trained on ordinary windows, the same in both so that common
    language costs alike, and a part of its class's own pieces. The calibration is a logistic
    regression on the sample's features, weighted to the classes' real shares.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("_id"), F.when(F.col(text_col) != "", text_key(text_col)).alias("_key"))
    marks = labels.filter(F.col(label_col).isin(0, 1)).select(
        F.col(id_col).cast("long").alias("_id"), F.col(label_col).cast("int").alias("_label"))
    sample, counts = labelled_sample(docs, rows.join(marks, "_id"), id_col, text_col, texts, PARTS, PART)
    by = {y: [p for label, ps in sample if label == y for p in ps] for y in (0, 1)}
    if not by[0] or not by[1]:
        return None
    plain = [w for t in by[0] for w in windows(marked(t), 256)]
    plain = plain[:: max(1, len(plain) // 20000)]
    try:
        base = zstandard.train_dictionary(BASE_BYTES, plain, level=3).as_bytes()
    except zstandard.ZstdError:  # too few samples for the trainer
        base = b""
    places = {y: _places([p.encode("utf-8", "surrogatepass").lower() for p in by[y]]) for y in (0, 1)}
    tail = {y: b"".join(_own_pieces(places[y], places[1 - y]))[-TAIL_BYTES:] for y in (0, 1)}
    # Both of one length, so that distances into the common part cost the same.
    filler = b" ".join(plain[-200:])
    size = len(tail[1])
    ordinary = (filler + tail[0])[-size:] if len(tail[0]) < size else tail[0][-size:]
    model = ToxicityModel(base + tail[1], base + ordinary, np.zeros(0))
    c = model.compressors()
    y = np.array([label for label, _ in sample], float)
    x = _expand(np.array([features(" ".join(ps), c) for _, ps in sample]))
    taken = {k: max(1, int((y == k).sum())) for k in (0, 1)}
    weight = np.array([counts[int(k)] / taken[int(k)] for k in y])
    model.weights = _logistic(x, y, weight * len(y) / weight.sum())
    return model


def score_toxicity(docs: DataFrame, model: ToxicityModel | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score) per document from its whole text; score from 0 to 1, higher means toxic.

    A null or empty text has no windows and gets the score of a text that saves nothing.
    Without a model (a class had no labelled text) every score is 0. Rows with a null id and
    repeated rows keep their row; other columns are not read; an empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = model.compressors() if model else None
        for b in batches:
            for at in range(0, b.num_rows, 1024):
                part = b.slice(at, 1024)
                texts = part.column("_text").to_pylist()
                if model:
                    z = _expand(np.array([features(t, c) for t in texts])) @ model.weights
                    score = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
                else:
                    score = np.zeros(len(texts))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(score)], ["doc_id", "score"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("_text"))
    return rows.mapInArrow(run, "doc_id long, score double")
