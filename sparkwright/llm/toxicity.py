"""Toxicity by cumulative-link ordinal regression on sparse text features.

Features of a text are its words (lower case, marks stripped) and their prefixes of PREFIXES letters, each counted as
log(1 + occurrences); only features that the training rows associate with toxic rows have a weight. Grades run from 0 (none)
to GRADES - 1; one weight vector serves all thresholds: P(grade > j) = sigmoid(w.x - t_j) with t_0 < t_1 < ..., and the expected
severity is the sum of these probabilities. The score of toxicity is P(grade > 0).

Labels may be grades; then the model is fitted to them. Labels of 0 and 1 are grades of which the toxic ones are censored: all
that is known of a toxic row is that its grade is above 0. Its likelihood is P(grade > 0), which fits the weights and t_0 and
leaves the higher thresholds free. They are set so that of the toxic training rows the same expected share is in each grade
above 0: severity then tells how a text compares with toxic ones, in steps of SHARES, and no grade is made up for a row.

Fitting takes a bounded sample of labelled rows (`sample_rows`, smallest hash of the id first), of which executors send the word
counts of the whole texts. Scoring is a map over all rows and all words; the table of weights has at most `MOST_FEATURES` entries.

Defined cases: null and empty texts have no features and get the base severity; null labels are not learned from; with one
class only among the labelled rows the score is their share of toxic rows (0 without any); rows and repeats are kept.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkwright.llm.quality import sampled

PREFIXES, GRADES, SHARES = (4, 5, 6, 7, 8), 4, (2 / 3, 1 / 3)
SAMPLE_ROWS, MOST_FEATURES, LEAST_ROWS, LEAST_EVIDENCE = 4000, 4096, 4, 3.0
MARKS = ".,;:!?\"'()[]{}<>*#$%&|-_/\\"
SEEN = 400_000


def features_of(word: str) -> list[str]:
    """The features of a word in lower case: itself, and its prefixes, which end in *."""
    word = word.strip(MARKS)
    return [word, *(word[:n] + "*" for n in PREFIXES if len(word) > n)] if word else []


def counted(text: str | None) -> Counter:
    return Counter((text or "").lower().split())


def vector(counts: dict[str, int], index: dict[str, int]) -> dict[int, float]:
    """{feature: log(1 + occurrences)} of known features."""
    total: dict[int, int] = {}
    for word, n in counts.items():
        for f in features_of(word):
            if (at := index.get(f)) is not None:
                total[at] = total.get(at, 0) + n
    return {at: math.log1p(n) for at, n in total.items()}


def choose(rows: list[tuple[dict[str, int], int]], most: int = MOST_FEATURES) -> dict[str, int]:
    """Features by the strength of their association with toxic rows: the log odds over its standard error."""
    found: tuple[Counter, Counter] = (Counter(), Counter())
    totals = [0, 0]
    for counts, label in rows:
        found[label > 0].update({f for w in counts for f in features_of(w)})
        totals[label > 0] += 1
    ranked = []
    for f, n in found[1].items():
        m = found[0][f]
        if n < LEAST_ROWS:
            continue
        odds = math.log((n + 0.5) / (totals[1] - n + 0.5)) - math.log((m + 0.5) / (totals[0] - m + 0.5))
        error = math.sqrt(1 / (n + 0.5) + 1 / (m + 0.5) + 1 / (totals[1] - n + 0.5) + 1 / (totals[0] - m + 0.5))
        if odds / error >= LEAST_EVIDENCE:
            ranked.append((-odds / error, f))
    return {f: i for i, (_, f) in enumerate(sorted(ranked)[:most])}


def fit_ordinal(x: list[dict[int, float]], grades: np.ndarray, size: int, thresholds: int, rounds: int = 400, penalty: float = 1e-4) -> tuple[np.ndarray, np.ndarray]:
    """Weights and ordered thresholds by Adam on the cumulative-link likelihood; thresholds are a first one and positive steps."""
    row = np.repeat(np.arange(len(x)), [len(v) for v in x])
    column = np.array([k for v in x for k in v], np.int64)
    value = np.array([a for v in x for a in v.values()])
    w, cuts = np.zeros(size), np.concatenate([[2.0], np.zeros(thresholds - 1)])
    state = [np.zeros_like(w), np.zeros_like(w), np.zeros_like(cuts), np.zeros_like(cuts)]
    for step in range(1, rounds + 1):
        theta = cuts[0] + np.append(0, np.cumsum(np.exp(cuts[1:])))
        score = np.bincount(row, value * w[column], len(x))
        upper = sigmoid(score[:, None] - theta)  # P(grade > j)
        full = np.concatenate([np.ones((len(x), 1)), upper, np.zeros((len(x), 1))], axis=1)
        slope = np.concatenate([np.zeros((len(x), 1)), upper * (1 - upper), np.zeros((len(x), 1))], axis=1)
        at = np.arange(len(x)), grades
        likely = np.maximum(full[at] - full[grades_next(at)], 1e-9)
        by_score = -(slope[at] - slope[grades_next(at)]) / likely / len(x)
        by_theta = np.zeros((len(x), thresholds + 2))
        by_theta[at] += slope[at] / likely
        by_theta[grades_next(at)] -= slope[grades_next(at)] / likely
        by_theta = by_theta[:, 1:-1].sum(axis=0) / len(x)
        gw = np.bincount(column, value * by_score[row], size) + penalty * w
        tail = np.cumsum(by_theta[::-1])[::-1]
        gc = np.concatenate([[tail[0]], tail[1:] * np.exp(cuts[1:])])
        for k, (param, g) in enumerate(((w, gw), (cuts, gc))):
            state[2 * k] = 0.9 * state[2 * k] + 0.1 * g
            state[2 * k + 1] = 0.999 * state[2 * k + 1] + 0.001 * g * g
            param -= 0.05 * (state[2 * k] / (1 - 0.9**step)) / (np.sqrt(state[2 * k + 1] / (1 - 0.999**step)) + 1e-9)
    return w, cuts[0] + np.append(0, np.cumsum(np.exp(cuts[1:])))


def grades_next(at: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    return at[0], at[1] + 1


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def shared_out(levels: np.ndarray, first: float) -> list[float]:
    """Thresholds above `first` that leave the SHARES of the expected rows above it, for toxic rows of these levels."""
    out = [first]
    for share in SHARES:
        want, low, high = share * sigmoid(levels - first).mean(), out[-1], float(max(levels.max(), first)) + 40
        for _ in range(100):  # the share falls as the threshold rises
            at = (low + high) / 2
            low, high = (at, high) if sigmoid(levels - at).mean() > want else (low, at)
        out.append(high)
    return out


def train(rows: list[tuple[dict[str, int], int]]) -> dict:
    labels = np.array([label for _, label in rows])
    if not len(labels) or (labels > 0).all() or not labels.any():
        return {"share": float((labels > 0).mean()) if len(labels) else 0.0}
    index = choose(rows)
    x = [vector(counts, index) for counts, _ in rows]
    w, theta = fit_ordinal(x, labels, len(index), int(labels.max()))
    thresholds = theta.tolist()
    if labels.max() == 1:
        levels = np.array([sum(w[i] * v for i, v in row.items()) for row in x])
        thresholds = shared_out(levels[labels > 0], thresholds[0])
    return {"index": {f: i for f, i in index.items() if w[i]}, "weights": w.tolist(), "thresholds": thresholds}


class Scorer:
    """Scores texts; words seen before are known to bear features or not, in sets of bounded size."""

    def __init__(self, model: dict):
        self.model = model
        self.seen: set[str] = set()
        self.bearing: dict[str, list[int]] = {}

    def __call__(self, text: str | None) -> tuple[float, float]:
        """(P(grade > 0), expected severity)."""
        if "share" in self.model:
            return self.model["share"], self.model["share"]
        words = (text or "").lower().split()
        kinds = set(words)
        if len(self.seen) > SEEN:
            self.seen.clear()
            self.bearing.clear()
        for word in kinds - self.seen:
            if found := [i for f in features_of(word) if (i := self.model["index"].get(f)) is not None]:
                self.bearing[word] = found
        self.seen |= kinds
        hits = kinds & self.bearing.keys()
        total: Counter = Counter()
        if hits:
            for word in words:
                if word in hits:
                    total.update(self.bearing[word])
        level = sum(self.model["weights"][i] * math.log1p(n) for i, n in sorted(total.items()))
        above = [1 / (1 + math.exp(-max(-40.0, min(40.0, level - t)))) for t in self.model["thresholds"]]
        return above[0], sum(above)


def _words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [list(counted(text).items()) for text in batch.column(2).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.map_(pa.string(), pa.int32()))], names=["doc_id", "label", "words"])


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", sample_rows: int = SAMPLE_ROWS) -> dict:
    """A model from labelled rows that are not held out; labels are 0 and 1, or grades up to GRADES - 1."""
    rows = sampled(docs, labels, label, GRADES - 1, sample_rows).mapInArrow(_words, "doc_id long, label int, words map<string,int>").collect()
    rows = sorted(rows, key=lambda r: (r["doc_id"], r["label"], len(r["words"])))
    return train([(r["words"], r["label"]) for r in rows])


def _severities(model: dict):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model)
        for batch in batches:
            found = [scorer(t) for t in batch.column(0).to_pylist()]
            extra = [pa.array([f[k] for f in found], pa.float64()) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], *extra], names=[*batch.schema.names[1:], "p", "e"])

    return run


def with_severity(docs: DataFrame, model: dict, score: str = "score", severity: str = "severity") -> DataFrame:
    """docs with P(grade > 0) and the expected severity; columns of docs with these names are replaced."""
    kept = docs.select([F.col(f"`{c}`") for c in docs.columns if c not in (score, severity)])
    plain = kept.toDF(*[f"c{i}" for i in range(len(kept.columns))])
    at = f"c{kept.columns.index('text')}"
    inner = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in plain.schema.fields)
    out = plain.select(F.coalesce(F.col(at).cast("string"), F.lit("")).alias("t"), "*").mapInArrow(_severities(model), f"{inner}, p double, e double")
    return out.toDF(*kept.columns, score, severity)
