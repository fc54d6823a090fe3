"""Toxicity: a learned lexicon, misspellings by Levenshtein automata, context windows."""

from __future__ import annotations

import math
import re
import uuid
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .common import prepare, text_of, worker_state
from .labelled import labelled_sample, sigmoid

WORDS = re.compile(r"\w+")
#: Marks that open or close a quotation.
MARKS = "\"“”„«»"
QUOTES = re.compile(f"[{MARKS}]")
#: Words before a term that report it rather than use it.
REPORTING = frozenset("called calling calls quote quoted quotes quoting said saying says term termed wrote word words slur insult insults reported".split())
#: Words to each side of a term that make its window.
WINDOW = 8
#: What a quoted term counts in a window.
QUOTED = 0.2
CACHE = 300_000
SHORTEST_FUZZY, LONG_TERM, SHORTEST_STEM, LONGEST_STEM, FUZZY_STEM = 5, 8, 3, 8, 6


def edit_masks(word: str) -> dict[str, int]:
    masks: dict[str, int] = {}
    for i, c in enumerate(word):
        masks[c] = masks.get(c, 0) | 1 << i
    return masks


class Lexicon:
    """Terms and stems with weights; finds a word's entry, also when misspelled.

    A term is a whole word, a stem any word's start. Both form a trie. A word's
    Levenshtein automaton (up to two edits, its states bit sets of word
    positions) walks the trie, so that only starts that some entry shares within
    the edits are followed. In a term, one edit is forgiven from 5 letters on,
    two from 8 letters on or if the letters are the same in another order; in a
    stem, one from 6 letters on, wherever the word goes on from there. Words
    known to be clean are found only as they stand in the lexicon.
    """

    def __init__(self, terms: dict[str, float], stems: dict[str, float], clean: frozenset[str] = frozenset()):
        self.terms, self.stems, self.clean = terms, stems, clean
        self.trie: dict = {}
        fuzzy = [t for t in terms if len(t) >= SHORTEST_FUZZY]
        starts = [s for s in stems if len(s) >= FUZZY_STEM]
        for entry, end in (*((t, "") for t in fuzzy), *((s, "*") for s in starts)):
            node = self.trie
            for c in entry:
                node = node.setdefault(c, {})
            node[end] = entry
        reach = [(t, n) for t in fuzzy for e in [2 if len(t) >= LONG_TERM else 1] for n in range(len(t) - e, len(t) + e + 1)]
        self.starts, self.ends = {(t[:2], n) for t, n in reach}, {(t[-2:], n) for t, n in reach}
        self.inner = {(t[i : i + 3], n) for t, n in reach if len(t) >= LONG_TERM for i in range(len(t) - 2)}
        self.lengths = frozenset(n for _, n in reach)
        self.letters = {"".join(sorted(t)) for t in fuzzy}
        self.stem_starts, self.stem_inner = {s[:2] for s in starts}, {s[2:5] for s in starts}
        self.least_stem = min(map(len, starts), default=1 << 30) - 1

    def find(self, word: str) -> tuple[float, int] | None:
        """(weight, edits) of the word's entry, or None."""
        if word in self.terms:
            return self.terms[word], 0
        for k in range(min(len(word), LONGEST_STEM), SHORTEST_STEM - 1, -1):
            if word[:k] in self.stems:
                return self.stems[word[:k]], 0
        if word in self.clean or not self.may_match(word):
            return None
        return self.misspelled(word)

    def may_match(self, word: str) -> bool:
        """False only for words that no entry matches within its edits; spares them the walk."""
        n = len(word)
        # one edit leaves the start of a stem, or its third to fifth letters at most one place away
        if n >= self.least_stem and (word[:2] in self.stem_starts or any(word[i : i + 3] in self.stem_inner for i in (1, 2, 3))):
            return True
        if n not in self.lengths:
            return False
        # two edits leave the start, the end or, in a long term, three letters within
        if (word[:2], n) in self.starts or (word[-2:], n) in self.ends or any((word[i : i + 3], n) in self.inner for i in range(n - 2)):
            return True
        return "".join(sorted(word)) in self.letters

    def misspelled(self, word: str) -> tuple[float, int] | None:
        """(weight, edits) of the entry with the fewest edits that it forgives, then the most weight."""
        masks, n = edit_masks(word), len(word)
        mask_of = masks.get
        last, within = 1 << n, (2 << n) - 1
        letters = sorted(word)
        most = 2 if n >= LONG_TERM - 2 or "".join(letters) in self.letters else 1
        best = None
        stack = [(self.trie, 1, 0b11 & within, 0b111 & within if most == 2 else 0)]
        while stack:
            node, none, one, two = stack.pop()
            for c, child in node.items():
                if len(c) != 1 or c == "*":
                    if c:  # a stem: the word may go on
                        edits, forgiven, weight = (0 if none else 1 if one else 2), 1, self.stems[child]
                    else:
                        edits = 0 if none & last else 1 if one & last else 2 if two & last else 3
                        forgiven, weight = (2 if len(child) >= LONG_TERM or sorted(child) == letters else 1), self.terms[child]
                    if edits <= forgiven and (best is None or (edits, -weight) < (best[1], -best[0])):
                        best = (weight, edits)
                    continue
                m = mask_of(c, 0)
                a = (none & m) << 1
                b = ((one & m) << 1 | none | none << 1 | a << 1) & within
                d = ((two & m) << 1 | one | one << 1 | b << 1) & within if most == 2 else 0
                if b or d:
                    stack.append((child, a, b, d))
        return best


class Hits(dict):
    """Remembers what the lexicon finds for a word."""

    def __init__(self, lexicon: Lexicon):
        self.lexicon = lexicon

    def __missing__(self, word: str) -> tuple[float, int] | None:
        found = self.lexicon.find(word)
        if len(self) < CACHE:
            self[word] = found
        return found


N_FEATURES = 5


def features(text: str, hits: Hits) -> list[float]:
    """What the terms of a text add up to: exact, misspelled, quoted, the hottest window, the density.

    A term is quoted between marks of quotation on one line, or up to four words after a
    reporting word. A window holds the words at most 8 from a term; its score is
    the sum of the weights of its terms, of quoted ones a fifth.
    """
    lower = text.lower()
    words = WORDS.findall(lower)
    at = [i for i, w in enumerate(words) if hits[w]]
    if not at:
        return [0.0] * N_FEATURES
    spans, wanted = {}, set(at)
    for i, m in enumerate(WORDS.finditer(lower)):
        if i in wanted:
            spans[i] = m.start()
    marks = [m.start() for m in QUOTES.finditer(lower)]
    exact = fuzzy = quoted = 0.0
    scores = []
    for i in at:
        weight, edits = hits[words[i]]
        within = False
        if marks:
            line = lower.rfind("\n", 0, spans[i]) + 1
            end = lower.find("\n", spans[i])
            before = sum(line <= p < spans[i] for p in marks)
            after = any(spans[i] < p < (end if end >= 0 else len(lower)) for p in marks)
            within = before % 2 == 1 and after
        within = within or not REPORTING.isdisjoint(words[max(0, i - 4) : i])
        if within:
            quoted += weight
        elif edits:
            fuzzy += weight
        else:
            exact += weight
        scores.append(weight * (QUOTED if within else 1.0) / (1 + edits))
    hottest, low, held = 0.0, 0, 0.0
    for k, i in enumerate(at):
        held += scores[k]
        while at[low] < i - WINDOW:
            held -= scores[low]
            low += 1
        hottest = max(hottest, held)
    return [math.log1p(exact), math.log1p(fuzzy), math.log1p(quoted), hottest / 5, math.log1p(100 * (exact + fuzzy) / len(words))]


def learn_lexicon(texts: list[str], toxic: np.ndarray, ratio: float = 6.0, chance: float = 0.05) -> Lexicon:
    """Words and stems that toxic texts have far more often than others.

    An entry is, smoothed, ratio times as often in toxic texts as in others, by a
    likelihood ratio statistic that any of as many entries reaches by mere chance with
    about the given probability; its weight is the logarithm of the ratio. A longer stem or word is an
    entry of its own only if it says clearly more than the stem it starts with,
    and a stem only if no single word makes up most of it. Words of clean texts that look
    like misspelled terms are remembered as clean.
    """
    sets = [set(WORDS.findall(t.lower())) for t in texts]
    n1 = int(toxic.sum())
    n0 = len(texts) - n1
    share = n1 / len(texts)

    yes: Counter = Counter()
    for words, label in zip(sets, toxic, strict=True):
        if label:
            yes.update(words)
            yes.update({w[:k] + "*" for w in words for k in range(SHORTEST_STEM, min(len(w), LONGEST_STEM) + 1)})
    evidence = 2 * math.log(max(1, len(yes)) / chance)
    least = math.ceil(evidence / 2 / math.log(1 / share))
    yes = Counter({f: c for f, c in yes.items() if c >= least})
    starts = {f[:-1] for f in yes if f.endswith("*")}
    most: dict[str, int] = {}
    for f, c in yes.items():
        for k in range(SHORTEST_STEM, min(len(f), LONGEST_STEM) + 1) if not f.endswith("*") else ():
            most[f[:k]] = max(most.get(f[:k], 0), c)
    no: Counter = Counter()
    for words, label in zip(sets, toxic, strict=True):
        if not label:
            near = [w for w in words if w[:SHORTEST_STEM] in starts or w in yes]
            no.update(w for w in near if w in yes)
            no.update({w[:k] + "*" for w in near for k in range(SHORTEST_STEM, min(len(w), LONGEST_STEM) + 1) if w[:k] in starts})

    def weight(f: str) -> float:
        a, b = yes[f], no[f]
        found = math.log((a + 0.5) / (n1 + 1)) - math.log((b + 0.5) / (n0 + 1))
        g = 2 * (a * math.log(a / ((a + b) * share)) + (b * math.log(b / ((a + b) * (1 - share))) if b else 0))
        return found if g >= evidence else 0.0

    terms: dict[str, float] = {}
    stems: dict[str, float] = {}
    for f in sorted(yes, key=lambda f: (len(f.rstrip("*")), not f.endswith("*"), f)):
        word, now = f.rstrip("*"), weight(f)
        if now < math.log(ratio):
            continue
        shorter = max((stems[word[:k]] for k in range(SHORTEST_STEM, len(word) + 1) if word[:k] in stems), default=None)
        if shorter is not None and now < shorter + 0.7:
            continue
        if not f.endswith("*"):
            terms[word] = now
        elif most.get(word, 0) < 0.8 * yes[f]:
            stems[word] = now
    lexicon = Lexicon(terms, stems)
    known: dict[str, bool] = {}
    seen: Counter = Counter()
    for words, label in zip(sets, toxic, strict=True):
        for w in words:
            if w not in known:
                found = lexicon.find(w)
                known[w] = bool(found and found[1])
            if known[w]:
                seen[w] += 1 if label else -2
    return Lexicon(terms, stems, frozenset(w for w in seen if seen[w] < 0))


def fit_logistic(x: np.ndarray, y: np.ndarray, penalty: float = 1e-2, steps: int = 40) -> np.ndarray:
    """Weights and, last, the intercept, by Newton's method."""
    a = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(a.shape[1])
    ridge = np.full(a.shape[1], penalty * len(x) / 100 + 1e-6)
    for _ in range(steps):
        p = sigmoid(a @ w)
        step = np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + np.diag(ridge), a.T @ (y - p) - ridge * w)
        w += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return w


@dataclass(frozen=True)
class ToxicityModel:
    lexicon: Lexicon
    weights: np.ndarray

    def score(self, rows: list[list[float]]) -> np.ndarray:
        x = np.array(rows, float).reshape(-1, N_FEATURES)
        return sigmoid(x @ self.weights[:-1] + self.weights[-1])


def fit_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", *, sample: int = 4000, folds: int = 5) -> ToxicityModel:
    """Learn from at most `sample` labelled rows that are not held out.

    They are dealt out to parts (two; up to eight if they are few). The lexicon
    of the other parts makes the features of each part, on which the weights
    are fitted, so that entries found by chance are not trusted; the final
    lexicon is learned from all. Without labels of both
    kinds every text gets the smoothed share of label 1, less than a half.
    """
    texts, toxic = labelled_sample(docs, labels, F.col(label_col), id_col, text_col, sample, folds)
    toxic = (toxic > 0).astype(np.int64)
    if not 0 < toxic.sum() < len(toxic):
        return ToxicityModel(Lexicon({}, {}), np.array([0.0] * N_FEATURES + [-2.0]))
    rows = np.zeros((len(texts), N_FEATURES))
    parts = max(2, min(8, 4000 // len(texts)))
    side = np.arange(len(texts)) % parts
    for s in range(parts):
        learn, use = np.flatnonzero(side != s), np.flatnonzero(side == s)
        hits = Hits(learn_lexicon([texts[i] for i in learn], toxic[learn]) if 0 < toxic[learn].sum() < len(learn) else Lexicon({}, {}))
        for i in use:
            rows[i] = features(texts[i], hits)
    return ToxicityModel(learn_lexicon(texts, toxic), fit_logistic(rows, toxic))


def score_toxicity(docs: DataFrame, model: ToxicityModel, text_col: str = "text", *, score_col: str = "score") -> DataFrame:
    """docs with score_col: how likely the whole text is toxic, from 0 to 1.

    Null and empty texts have no terms and get the score of the intercept. Only
    the text is looked at. No rows give no rows; a column that already has the name of score_col is
    replaced, other columns stay.
    """
    prepare(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(model)
    key = uuid.uuid4().hex
    keep = [c for c in docs.columns if c != score_col]
    schema = StructType([*(docs.schema[c] for c in keep), StructField(score_col, DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = held.value
        hits = worker_state(("toxicity", key), lambda: Hits(model.lexicon))
        for batch in batches:
            texts = batch.column(batch.num_columns - 1).to_pylist()
            scores = model.score([features(x, hits) for x in texts])
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(len(keep))), pa.array(scores, pa.float64())], names=schema.names)

    marked = docs.select(*keep, text_of(text_col).alias("_text_to_score"))
    return marked.mapInArrow(run, schema)
