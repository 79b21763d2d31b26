"""Language of a text by a convolutional network over its bytes, trained and applied in numpy."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reviewspark.llm.common import text_key
from reviewspark.llm.samples import labelled_sample

WINDOW = 192
WIDTHS = (2, 3, 4)
FILTERS = 12
EMBED = 6
# Bound of the training sample: texts of each language, and parts of WINDOW characters of each.
TEXTS_PER_LANGUAGE = 400
PARTS = 4
EPOCHS = 6
BATCH = 64
RATE = 0.01
UNKNOWN = "und"


@dataclass
class ByteNetwork:
    """Byte embedding, filters of several widths, largest value of each over the window, softmax."""

    languages: list[str]
    params: list[np.ndarray]  # embedding, then weight and bias of each width, then of the output

    @classmethod
    def fresh(cls, languages: list[str], seed: int = 1) -> ByteNetwork:
        rng = np.random.default_rng(seed)

        def normal(*shape: int, scale: float) -> np.ndarray:
            return rng.normal(0, scale, shape).astype(np.float32)

        params = [normal(256, EMBED, scale=0.5)]
        for w in WIDTHS:
            params += [normal(w * EMBED, FILTERS, scale=(w * EMBED) ** -0.5), np.zeros(FILTERS, np.float32)]
        n = FILTERS * len(WIDTHS)
        return cls(languages, [*params, normal(n, len(languages), scale=n**-0.5), np.zeros(len(languages), np.float32)])

    def _pooled(self, x: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        """Largest answer of every filter, and where it was."""
        seen = self.params[0][x]
        top, where = [], []
        for i, w in enumerate(WIDTHS):
            weight, bias = self.params[1 + 2 * i : 3 + 2 * i]
            n = x.shape[1] - w + 1
            runs = np.concatenate([seen[:, k : k + n] for k in range(w)], axis=2)
            answer = runs @ weight
            where.append(answer.argmax(axis=1))
            top.append(np.take_along_axis(answer, where[-1][:, None, :], 1)[:, 0] + bias)
        return np.concatenate(top, axis=1), where

    def chances(self, x: np.ndarray) -> np.ndarray:
        """Softmax over the languages of windows of bytes (n, WINDOW)."""
        seen = self.params[0][x]
        top = []
        for i, w in enumerate(WIDTHS):
            weight, bias = self.params[1 + 2 * i : 3 + 2 * i]
            n = x.shape[1] - w + 1
            runs = np.concatenate([seen[:, k : k + n] for k in range(w)], axis=2)
            top.append((runs.reshape(-1, w * EMBED) @ weight).reshape(len(x), n, FILTERS).max(axis=1) + bias)
        return _softmax(np.maximum(np.concatenate(top, axis=1), 0) @ self.params[-2] + self.params[-1])

    def gradients(self, x: np.ndarray, y: np.ndarray) -> list[np.ndarray]:
        """Of the mean cross entropy; only the place of a filter's largest answer learns."""
        top, where = self._pooled(x)
        hidden = np.maximum(top, 0)
        off = _softmax(hidden @ self.params[-2] + self.params[-1])
        off[np.arange(len(y)), y] -= 1
        off /= len(y)
        grads = [np.zeros_like(p) for p in self.params]
        grads[-2], grads[-1] = hidden.T @ off, off.sum(axis=0)
        back = (off @ self.params[-2].T) * (top > 0)
        for i, w in enumerate(WIDTHS):
            g = back[:, i * FILTERS : (i + 1) * FILTERS]
            at = where[i][:, :, None] + np.arange(w)
            met = x[np.arange(len(x))[:, None, None], at]
            runs = self.params[0][met].reshape(len(x), FILTERS, w * EMBED)
            weight = self.params[1 + 2 * i]
            grads[1 + 2 * i] = np.einsum("bfk,bf->kf", runs, g)
            grads[2 + 2 * i] = g.sum(axis=0)
            spread = (g[:, :, None] * weight.T[None]).reshape(len(x), FILTERS, w, EMBED)
            np.add.at(grads[0], met.ravel(), spread.reshape(-1, EMBED))
        return grads

    def train(self, x: np.ndarray, y: np.ndarray, epochs: int = EPOCHS, seed: int = 2) -> None:
        """Adam over shuffled batches."""
        rng = np.random.default_rng(seed)
        mean = [np.zeros_like(p) for p in self.params]
        square = [np.zeros_like(p) for p in self.params]
        step = 0
        for _ in range(epochs):
            order = rng.permutation(len(x))
            for at in range(0, len(x), BATCH):
                pick = order[at : at + BATCH]
                step += 1
                for p, g, m, s in zip(self.params, self.gradients(x[pick], y[pick]), mean, square):
                    m += 0.1 * (g - m)
                    s += 0.001 * (g * g - s)
                    p -= RATE * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.999**step)) + 1e-8)


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def byte_windows(texts: list[str], size: int = WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(windows, text of each, bytes in each): whole texts cut into windows, the last filled with zero bytes."""
    data = [t.encode("utf-8", "surrogatepass") for t in texts]
    length = np.array([len(d) for d in data], np.int64)
    n = -(-length // size)
    out = np.zeros((int(n.sum()), size), np.uint8)
    at = 0
    for d, k in zip(data, n):
        out[at : at + k].reshape(-1)[: len(d)] = np.frombuffer(d, np.uint8)
        at += k
    of = np.repeat(np.arange(len(texts)), n)
    first = np.cumsum(n) - n
    held = np.minimum(size, np.repeat(length, n) - size * (np.arange(len(out)) - np.repeat(first, n)))
    return out, of, held


def predict(model: ByteNetwork, texts: list[str | None]) -> list[tuple[str, float]]:
    """(language, score) per text: the chances of its windows, averaged by the bytes they hold."""
    known = [i for i, t in enumerate(texts) if t and any(map(str.isalpha, t))]
    out = [(UNKNOWN, 0.0)] * len(texts)
    if not known or not model.languages:
        return out
    total = np.zeros((len(known), len(model.languages)))
    weight = np.zeros(len(known))
    x, of, held = byte_windows([texts[i] for i in known])
    for at in range(0, len(x), 512):
        c = model.chances(x[at : at + 512]) * held[at : at + 512, None]
        np.add.at(total, of[at : at + 512], c)
        np.add.at(weight, of[at : at + 512], held[at : at + 512])
    total /= weight[:, None]
    best = total.argmax(axis=1)
    for i, k, row in zip(known, best, total):
        out[i] = (model.languages[k], float(min(1.0, row[k])))
    return out


def fit_languages(
    rows: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
    texts: int = TEXTS_PER_LANGUAGE, parts: int = PARTS,
) -> ByteNetwork:
    """A network trained on at most `texts` texts of each language in `rows`, `parts` parts of each.

    Every part is learnt from whole and once more cut down to a few words, as short texts are.
    """
    labelled = rows.select(
        F.col(id_col).cast("long").alias("_id"), F.when(F.col(text_col) != "", text_key(text_col)).alias("_key"),
        F.col(lang_col).alias("_label"))
    sample, _ = labelled_sample(rows, labelled, id_col, text_col, texts, parts, WINDOW)
    languages = sorted({label for label, _ in sample})
    model = ByteNetwork.fresh(languages)
    pairs = [(p, languages.index(label)) for label, ps in sample for p in ps if any(map(str.isalpha, p))]
    rng = np.random.default_rng(3)
    for part, language in list(pairs):
        words = part.split(" ")
        n = int(rng.integers(1, 9))
        at = int(rng.integers(0, max(1, len(words) - n)))
        short = " ".join(words[at : at + n])
        if any(map(str.isalpha, short)):
            pairs.append((short[:1].upper() + short[1:] if rng.random() < 0.5 else short, language))
    if pairs:
        x, of, _ = byte_windows([p for p, _ in pairs])
        model.train(x, np.array([y for _, y in pairs])[of])
    return model


def identify_languages(docs: DataFrame, model: ByteNetwork, id_col: str = "doc_id", text_col: str = "text",
                       keep: list[str] | None = None) -> DataFrame:
    """(doc_id, *keep, lang_pred, score) per document, from its whole text.

    The text's UTF-8 bytes are cut into windows of WINDOW bytes; the language with the
    largest chance, averaged over the windows by the bytes they hold, wins, and of equal
    ones the first by name. A null text, an empty one and one without any letter give `und`
    and score 0, as does a model that met no language. Rows with a null id and repeated
    rows keep their row; an empty table gives no rows. Of other columns only those in
    `keep` are read.
    """
    names = ["doc_id", *(keep or [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 128):
                part = b.slice(at, 128)
                lang, score = zip(*predict(model, part.column("_lang_text").to_pylist()))
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(c) for c in names), pa.array(lang, pa.string()), pa.array(score, pa.float64())],
                    [*names, "lang_pred", "score"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), *(keep or []), F.col(text_col).alias("_lang_text"))
    kinds = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in names)
    return rows.mapInArrow(run, f"{kinds}, lang_pred string, score double")


def keep_known(docs: DataFrame, model: ByteNetwork, text_col: str = "text", least: float = 0.3) -> DataFrame:
    """The rows of `docs` whose language the network tells, columns unchanged.

    Rejected are texts that give `und` (null, empty, no letter) and those whose best
    language has a chance under `least`. Rows pass through with all their columns, so
    nothing is joined or shuffled.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at_text = b.schema.get_field_index(text_col)
            for at in range(0, b.num_rows, 128):
                part = b.slice(at, 128)
                said = predict(model, part.column(at_text).to_pylist())
                yield part.filter(pa.array([lang != UNKNOWN and score >= least for lang, score in said], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
