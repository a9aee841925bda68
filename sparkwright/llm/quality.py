"""Quality classifier: a byte-level convolutional network in numpy.

Bytes of the whole text (UTF-8) are embedded and cut into overlapping chunks that cover all of it; learned filters of WIDTH
bytes run over every chunk, two bytes on at each step, and are max-pooled in it. The mean and the maximum of the chunks' pools feed one logistic unit,
whose output is the probability of label 1. Nothing but the text is an input.

Fitting takes a bounded sample of labelled rows (`sample_rows`, those with the smallest hash of their id), each with its whole
text; these go to the driver. Filters run over a batch of them in pieces. Scoring is a map over all rows and all bytes, without
a shuffle.

Defined cases: null and empty texts are scored as one chunk of padding; labels that are null are not learned from; with
fewer than two classes among the labelled rows the score is the share of label 1 (1.0 without any); a null id is not held
out; rows and repeats are kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkwright.llm.common import fresh, text_bytes

CHUNK, OVERLAP, WIDTH, STRIDE, DIM, FILTERS = 512, 32, 6, 2, 6, 16
SAMPLE_ROWS, EPOCHS, BATCH, SEED = 3000, 12, 64, 7


def chunk_starts(size: int) -> np.ndarray:
    """Where the chunks that cover a text of so many bytes begin."""
    return np.arange(0, max(1, size - OVERLAP), CHUNK - OVERLAP)


def chunks_of(text: bytes, starts: np.ndarray) -> np.ndarray:
    padded = np.zeros(int(starts[-1]) + CHUNK, np.uint8)
    padded[: len(text)] = np.frombuffer(text, np.uint8)[: len(padded)]
    return np.lib.stride_tricks.sliding_window_view(padded, CHUNK)[starts]


def first_model(rng: np.random.Generator) -> dict[str, np.ndarray]:
    """Byte classes to begin with (pad, lower case, upper case, digit, white space, mark), and random filters."""
    embedding = rng.normal(0, 0.1, (256, DIM))
    for byte in range(256):
        char = bytes([byte])
        kind = 1 if char.islower() or byte >= 128 else 2 if char.isupper() else 3 if char.isdigit() else 4 if char.isspace() else 5 if byte else 0
        embedding[byte, kind] += 1
    return {
        "embedding": embedding.astype(np.float32),
        "filters": rng.normal(0, (WIDTH * DIM) ** -0.5, (WIDTH * DIM, FILTERS)).astype(np.float32),
        "bias": np.zeros(FILTERS, np.float32),
        "mean": rng.normal(0, 0.1, FILTERS).astype(np.float32),
        "peak": rng.normal(0, 0.1, FILTERS).astype(np.float32),
        "base": np.zeros(1, np.float32),
    }


def windows(model: dict, chunks: np.ndarray) -> np.ndarray:
    """The embedded WIDTH bytes at every other place of each chunk, one row each."""
    embedded = model["embedding"][chunks].reshape(len(chunks), CHUNK * DIM)
    return np.lib.stride_tricks.sliding_window_view(embedded, WIDTH * DIM, axis=1)[:, :: STRIDE * DIM]


def tables(model: dict) -> list[np.ndarray]:
    """For each two bytes of a window, what every pair of byte values adds to the filters' outputs."""
    parts = [model["embedding"] @ model["filters"][i * DIM : (i + 1) * DIM] for i in range(WIDTH)]
    return [(parts[i][:, None] + parts[i + 1][None]).reshape(1 << 16, FILTERS) for i in range(0, WIDTH, 2)]


def pool(adds: list[np.ndarray], bias: np.ndarray, chunks: np.ndarray, at_once: int = 16) -> np.ndarray:
    """Max-pooled filter outputs of each chunk."""
    out = np.empty((len(chunks), FILTERS), np.float32)
    places = (CHUNK - WIDTH) // STRIDE + 1
    for at in range(0, len(chunks), at_once):
        pairs = np.ascontiguousarray(chunks[at : at + at_once]).view(">u2").astype(np.intp)
        outs = adds[0][pairs[:, :places]]
        for i in range(1, WIDTH // 2):
            outs += adds[i][pairs[:, i : i + places]]
        out[at : at + at_once] = outs.max(axis=1)
    return np.maximum(out + bias, 0)


def combine(model: dict, mean: np.ndarray, peak: np.ndarray) -> np.ndarray:
    logit = (mean @ model["mean"] + peak @ model["peak"] + model["base"]).astype(np.float64)
    return 1 / (1 + np.exp(-np.clip(logit, -50, 50)))


def score(model: dict, adds: list[np.ndarray], text: bytes, at_once: int = 4096) -> float:
    """The probability of label 1 of one whole text, in memory bounded by its own size."""
    starts = chunk_starts(len(text))
    total, peak = np.zeros(FILTERS, np.float64), np.zeros(FILTERS, np.float32)
    for at in range(0, len(starts), at_once):
        some = starts[at : at + at_once]
        pooled = pool(adds, model["bias"], chunks_of(text[some[0] : some[-1] + CHUNK], some - some[0]))
        total += pooled.sum(axis=0)
        peak = np.maximum(peak, pooled.max(axis=0))
    return float(combine(model, (total / len(starts)).astype(np.float32)[None], peak[None])[0])


def gradients(model: dict, chunks: np.ndarray, sizes: np.ndarray, labels: np.ndarray, at_once: int = 256) -> dict[str, np.ndarray]:
    """Gradients of the mean log loss over documents; chunks of one document stand together, `sizes` of them each."""
    seen = windows(model, chunks)
    where, top = [], []
    for at in range(0, len(chunks), at_once):
        part = np.ascontiguousarray(seen[at : at + at_once])
        # one row for each filter, so that maxima run over adjacent numbers
        outs = (model["filters"].T @ part.reshape(-1, WIDTH * DIM).T).reshape(FILTERS, len(part), -1)
        where.append(outs.argmax(axis=2).T)
        top.append(np.take_along_axis(outs, where[-1].T[:, :, None], axis=2)[:, :, 0].T)
    where = np.concatenate(where)
    pooled = np.maximum(np.concatenate(top) + model["bias"], 0)
    begin = np.append(0, np.cumsum(sizes)[:-1])
    owner = np.repeat(np.arange(len(sizes)), sizes)
    mean, peak = np.add.reduceat(pooled, begin) / sizes[:, None], np.maximum.reduceat(pooled, begin)
    error = ((combine(model, mean, peak) - labels) / len(labels)).astype(np.float32)
    top = pooled == peak[owner]
    top = top / np.maximum(np.add.reduceat(top.astype(np.float32), begin), 1)[owner]
    back = error[owner, None] * (model["mean"] / sizes[owner, None] + model["peak"] * top) * (pooled > 0)
    rows = np.arange(len(chunks))[:, None]
    picked = seen[rows, where]  # chunk, filter, WIDTH * DIM
    inputs = (back[:, :, None] * model["filters"].T[None]).reshape(-1, DIM)
    bytes_at = chunks[rows[:, :, None], where[:, :, None] * STRIDE + np.arange(WIDTH)].ravel()
    embedding = np.stack([np.bincount(bytes_at, inputs[:, d], 256) for d in range(DIM)], axis=1)
    return {
        "embedding": embedding,
        "filters": np.einsum("cf,cfk->kf", back, picked),
        "bias": back.sum(axis=0),
        "mean": error @ mean,
        "peak": error @ peak,
        "base": error.sum()[None],
    }


def all_chunks(text: bytes) -> np.ndarray:
    return chunks_of(text, chunk_starts(len(text)))


def train(rows: list[tuple[bytes, int]], epochs: int = EPOCHS, seed: int = SEED) -> dict:
    """Adam over (text, label) rows."""
    rng = np.random.default_rng(seed)
    model = first_model(rng)
    share = float(np.mean([label for _, label in rows])) if rows else 1.0
    if not 0 < share < 1:
        return {"share": share}
    model["base"][:] = np.log(share / (1 - share))
    first = {k: np.zeros_like(v) for k, v in model.items()}
    second = {k: np.zeros_like(v) for k, v in model.items()}
    step, steps = 0, epochs * -(-len(rows) // BATCH)
    for _ in range(epochs):
        order = rng.permutation(len(rows))
        for at in range(0, len(rows), BATCH):
            some = [(all_chunks(rows[i][0]), rows[i][1]) for i in order[at : at + BATCH]]
            sizes = np.array([len(c) for c, _ in some])
            found = gradients(model, np.concatenate([c for c, _ in some]), sizes, np.array([y for _, y in some], float))
            step += 1
            rate = 0.02 * (1 - step / (steps + 1))
            for k, g in found.items():
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.99 * second[k] + 0.01 * g * g
                model[k] -= (rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-7)).astype(np.float32)
    return model


def held_out(doc_id):
    """Whether a row is kept from fitting."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def sampled(docs: DataFrame, labels: DataFrame, label: str, most: int, sample_rows: int) -> DataFrame:
    """(doc_id, label, text) of at most `sample_rows` labelled rows that are not held out; labels run from 0 to `most`."""
    named = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("label"))
    named = named.where(F.col("doc_id").isNotNull() & F.col("label").between(0, most) & ~held_out(F.col("doc_id")))
    some = named.orderBy(F.xxhash64("doc_id"), "doc_id", "label").limit(sample_rows)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    # the broadcast side has sample_rows rows of 12 bytes; ids that repeat in docs can add rows, so the sample is cut again
    pairs = texts.join(F.broadcast(some), "doc_id").select("doc_id", "label", "text")
    return pairs.orderBy(F.xxhash64("doc_id"), "doc_id", "label", F.xxhash64("text")).limit(sample_rows)


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", sample_rows: int = SAMPLE_ROWS) -> dict:
    """A model from labelled rows that are not held out."""
    found = sampled(docs, labels, label, 1, sample_rows).select("doc_id", "label", F.col("text").cast("binary").alias("text")).collect()
    rows = sorted(((r["doc_id"], r["label"], bytes(r["text"] or b"")) for r in found))
    return train([(text, y) for _, y, text in rows])


def _scores(model: dict):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        adds = [] if "share" in model else tables(model)
        for batch in batches:
            if "share" in model:
                found = [model["share"]] * batch.num_rows
            else:
                found = [score(model, adds, t) for t in text_bytes(batch.column(0))]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(found, pa.float64())], names=[*batch.schema.names[1:], "s"])

    return run


def with_score(docs: DataFrame, model: dict, name: str = "score") -> DataFrame:
    """docs with the probability of label 1 as column `name`, which replaces one of that name."""
    kept = docs.select([F.col(f"`{c}`") for c in docs.columns if c != name])
    plain = kept.toDF(*[f"c{i}" for i in range(len(kept.columns))])
    at = f"c{kept.columns.index('text')}"
    inner = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in plain.schema.fields)
    out = plain.select(F.coalesce(F.col(at).cast("string"), F.lit("")).alias("t"), "*").mapInArrow(_scores(model), f"{inner}, s double")
    return out.toDF(*kept.columns, name)


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs whose score is at least 0.5, with their own columns."""
    (name,) = fresh(docs, "_quality")
    return with_score(docs, fit(docs, labels), name).where(F.col(name) >= 0.5).drop(name)
