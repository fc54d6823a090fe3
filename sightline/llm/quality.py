"""Quality: ordinal cumulative-link regression on graded ratings."""

from __future__ import annotations

import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from .common import prepare, text_of, worker_state
from .labelled import labelled_sample, sigmoid

#: Slots that words and shapes of words are hashed to.
SLOTS = 1 << 17
CACHE = 300_000
RUNS = re.compile(r"(.)\1+")


def _slot(kind: str, text: str) -> int:
    return zlib.crc32(f"{kind}:{text}".encode("utf-8", "surrogatepass")) % SLOTS


def shape(word: str) -> str:
    """The word with letters as a or A, digits as 9, and each run of a sign cut to one."""
    signs = "".join("A" if c.isupper() else "a" if c.isalpha() else "9" if c.isdigit() else c for c in word)
    return RUNS.sub(r"\1", signs)


class Slots(dict):
    """Remembers a word's two slots: of itself and of its shape."""

    def __missing__(self, word: str) -> tuple[int, int]:
        found = (_slot("word", word.lower()), _slot("shape", shape(word)))
        if len(self) < CACHE:
            self[word] = found
        return found


#: Slots of what is said about a whole text.
REPEATED, DISTINCT, EMPTY = (_slot("text", x) for x in ("repeated", "distinct", "empty"))


def text_facts(words: list[str]) -> list[tuple[int, float]]:
    """Share of words equal to the one before, share of distinct words, emptiness."""
    n = len(words)
    if not n:
        return [(EMPTY, 1.0)]
    return [(REPEATED, sum(map(str.__eq__, words, words[1:])) / n), (DISTINCT, len(set(words)) / n)]


def text_vector(text: str, slots: Slots) -> dict[int, float]:
    """The shares of the text's words and shapes, by slot, and the facts of the text."""
    words = text.split()
    out: dict[int, float] = {}
    for w in words:
        for s in slots[w]:
            out[s] = out.get(s, 0.0) + 1 / len(words)
    for s, value in text_facts(words):
        out[s] = out.get(s, 0.0) + value
    return out


@dataclass(frozen=True)
class OrdinalModel:
    """P(grade >= k) = sigmoid(weights . x - thresholds[k - 1]), thresholds ascending."""

    weights: np.ndarray
    thresholds: np.ndarray

    def tails(self, eta: np.ndarray) -> np.ndarray:
        """A row per text: the probabilities of grade 1 or more, 2 or more, and so on."""
        return sigmoid(eta[:, None] - self.thresholds[None, :])


def fit_ordinal(rows: list[dict[int, float]], grades: np.ndarray, levels: int, *, steps: int = 200, rate: float = 0.15, penalty: float = 1e-6) -> OrdinalModel:
    """Maximum likelihood by Adam on all rows at once; the same rows give the same model.

    The first threshold and the logarithms of the steps between them are the
    parameters, so the thresholds stay ordered.
    """
    share = np.array([(np.sum(grades >= k) + 0.5) / (len(grades) + 1) for k in range(1, levels)])
    cuts = np.maximum.accumulate(-np.log(share / (1 - share)) + 1e-3 * np.arange(levels - 1))
    if not len(rows) or len(set(grades.tolist())) < 2:
        return OrdinalModel(np.zeros(SLOTS), cuts)
    index = np.concatenate([np.fromiter(r, np.int64, len(r)) for r in rows])
    value = np.concatenate([np.fromiter(r.values(), float, len(r)) for r in rows])
    row = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    weights = np.zeros(SLOTS)
    base, gaps = cuts[0], np.log(np.maximum(np.diff(cuts), 1e-2))
    state = [np.zeros(SLOTS + levels - 1), np.zeros(SLOTS + levels - 1)]
    for t in range(1, steps + 1):
        cuts = base + np.concatenate(([0.0], np.exp(gaps).cumsum()))
        eta = np.bincount(row, weights[index] * value, len(rows))
        padded = np.concatenate(([-np.inf], cuts, [np.inf]))
        upper, lower = sigmoid(eta - padded[grades]), sigmoid(eta - padded[grades + 1])  # of this grade or more, of more
        p = np.maximum(upper - lower, 1e-9)
        du, dl = upper * (1 - upper) / p, lower * (1 - lower) / p
        g_eta = -(du - dl) / len(rows)
        g_cuts = np.array([np.sum(du[grades == k]) - np.sum(dl[grades == k - 1]) for k in range(1, levels)]) / len(rows)
        g_base = g_cuts.sum()
        g_gaps = np.array([g_cuts[k:].sum() for k in range(1, levels - 1)]) * np.exp(gaps)
        g = np.concatenate((np.bincount(index, g_eta[row] * value, SLOTS) + penalty * weights, [g_base], g_gaps))
        state[0] = 0.9 * state[0] + 0.1 * g
        state[1] = 0.99 * state[1] + 0.01 * g * g
        step = rate * (state[0] / (1 - 0.9**t)) / (np.sqrt(state[1] / (1 - 0.99**t)) + 1e-8)
        weights -= step[:SLOTS]
        base -= step[SLOTS]
        gaps -= step[SLOTS + 1 :]
    return OrdinalModel(weights, base + np.concatenate(([0.0], np.exp(gaps).cumsum())))


def fit_quality(docs: DataFrame, labels: DataFrame, grade: Column, levels: int, id_col: str = "doc_id", text_col: str = "text", *, sample: int = 4000, folds: int = 5) -> OrdinalModel:
    """Fit on at most `sample` rated rows that are not held out; grade runs from 0 to levels - 1.

    Without ratings of two grades the model knows only their shares.
    """
    texts, grades = labelled_sample(docs, labels, grade, id_col, text_col, sample, folds)
    slots = Slots()
    return fit_ordinal([text_vector(x, slots) for x in texts], np.clip(grades, 0, levels - 1), levels)


class Weights(dict):
    """Remembers the sum of a word's two weights."""

    def __init__(self, model: OrdinalModel):
        self.model = model

    def __missing__(self, word: str) -> float:
        w = self.model.weights
        found = float(w[_slot("word", word.lower())] + w[_slot("shape", shape(word))])
        if len(self) < CACHE:
            self[word] = found
        return found


def score_quality(docs: DataFrame, model: OrdinalModel, text_col: str = "text", *, tail_from: int = 1) -> DataFrame:
    """docs with expected_grade, tail_probability (of grade tail_from or more) and grade_tails.

    Whole texts are scored. Null counts as empty, which has a weight of its own.
    Columns that already have one of the three names are replaced, others stay.
    No rows give no rows.
    """
    prepare(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(model)
    key = uuid.uuid4().hex
    own = ["expected_grade", "tail_probability", "grade_tails"]
    keep = [c for c in docs.columns if c not in own]
    schema = StructType([*(docs.schema[c] for c in keep), StructField(own[0], DoubleType()), StructField(own[1], DoubleType()), StructField(own[2], ArrayType(DoubleType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = held.value
        weights = worker_state(("quality", key), lambda: Weights(model))
        for batch in batches:
            eta = []
            for text in batch.column(batch.num_columns - 1).to_pylist():
                words = text.split()
                facts = sum(model.weights[s] * v for s, v in text_facts(words))
                eta.append(facts + sum(map(weights.__getitem__, words)) / max(1, len(words)))
            tails = model.tails(np.array(eta))
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(len(keep))), pa.array(tails.sum(axis=1)), pa.array(tails[:, tail_from - 1]), pa.array(tails.tolist(), pa.list_(pa.float64()))], names=schema.names)

    return docs.select(*keep, text_of(text_col).alias("_text_to_score")).mapInArrow(run, schema)
