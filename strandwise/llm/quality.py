"""Quality classifier: a byte-level convolutional network in numpy.

A text's bytes are embedded and cut into chunks of CHUNK bytes that overlap by half and cover the
whole text, padded with zero bytes at its end. Learned filters over each chunk are max-pooled over the
text; the pooled values and a bias give one probability. A null or empty text is one chunk of zeros.

The network is fitted on a bounded sample of labelled rows (`sample`, half of each class at most) that
are not held out; the classes' shares among all such labels correct the bias, so that scores keep the
corpus's odds. Without labels of both classes every score is the share of label 1, or 0.5. Labels
outside 0 and 1 and null labels are passed over. Repeated rows, null or equal doc_ids each give a row;
only the text decides a score.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandwise.llm.common import held_out, labelled_sample, slices, tidy, utf8

STEP, CHUNK = 8, 16
DIM, FILTERS = 8, 32
SEED = 11
#: Rows of STEP bytes whose filter outputs are held at a time; only a single longer text has more.
BLOCK = 1 << 18

Net = dict[str, np.ndarray]


def laid_out(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Rows of STEP bytes of all texts, each padded and followed by a row of zeros; and each text's first row, with the end."""
    parts, at = [], [0]
    for text in texts:
        data = utf8(text)
        rows = max(1, -(-len(data) // STEP)) + 1
        parts.append(data.ljust(rows * STEP, b"\0"))
        at.append(at[-1] + rows)
    return np.frombuffer(b"".join(parts), np.uint8).reshape(-1, STEP), np.array(at)


def responses(net: Net, rows: np.ndarray) -> np.ndarray:
    """Filter outputs of the chunk that begins at each row but the last."""
    x = net["embed"][rows].reshape(len(rows), STEP * DIM)
    return x[:-1] @ net["first"] + x[1:] @ net["second"] + net["bias"]


def peaks(net: Net, rows: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each text's highest filter outputs, and the rows at which the chunks that give them begin; BLOCK rows are held at a time."""
    best = np.full((len(at) - 1, FILTERS), -np.inf, np.float32)
    win = np.zeros(best.shape, np.int64)
    for begin in range(0, len(rows) - 1, BLOCK):
        out = responses(net, rows[begin : begin + BLOCK + 1])
        end = begin + len(out)
        for i in range(np.searchsorted(at, begin, side="right") - 1, np.searchsorted(at, end)):
            a, b = max(at[i], begin), min(at[i + 1] - 1, end)  # a chunk never spans two texts
            if a >= b:
                continue
            top = out[a - begin : b - begin].argmax(axis=0)
            value = out[a - begin + top, np.arange(FILTERS)]
            higher = value > best[i]
            best[i, higher], win[i, higher] = value[higher], a + top[higher]
    return best, win


def scores(net: Net, texts: list[str]) -> np.ndarray:
    if not texts:
        return np.zeros(0)
    pooled = np.maximum(peaks(net, *laid_out(texts))[0], 0)
    return 1 / (1 + np.exp(-(pooled @ net["out"] + net["shift"][0]).astype(np.float64)))


def fit(sample: list[tuple[str, int]], epochs: int = 12, batch: int = 32, rate: float = 0.005, decay: float = 1e-4, seed: int = SEED) -> Net:
    """Adam on the cross-entropy; gradients reach only the chunks that won the pooling."""
    draw = np.random.default_rng(seed)
    net: Net = {
        "embed": draw.normal(0, 0.5, (256, DIM)),
        "first": draw.normal(0, 0.1, (STEP * DIM, FILTERS)),
        "second": draw.normal(0, 0.1, (STEP * DIM, FILTERS)),
        "bias": np.zeros(FILTERS),
        "out": draw.normal(0, 0.3, FILTERS),
        "shift": np.zeros(1),
    }
    net = {k: v.astype(np.float32) for k, v in net.items()}
    mean = {k: np.zeros_like(v) for k, v in net.items()}
    square = {k: np.zeros_like(v) for k, v in net.items()}
    labels = np.array([y for _, y in sample], np.float32)
    weight = np.where(labels == 1, 0.5 / max(labels.mean(), 1e-6), 0.5 / max(1 - labels.mean(), 1e-6)) if len(sample) else labels
    step = 0
    for _ in range(epochs):
        order = draw.permutation(len(sample))
        for begin in range(0, len(order), batch):
            chosen = order[begin : begin + batch]
            rows, at = laid_out([sample[i][0] for i in chosen])
            best, win = peaks(net, rows, at)
            top = np.maximum(best, 0)
            logit = top @ net["out"] + net["shift"][0]
            error = ((1 / (1 + np.exp(-logit))) - labels[chosen]) * weight[chosen] / len(chosen)
            back = error[:, None] * net["out"] * (top > 0)
            grad: Net = {"out": top.T @ error + decay * net["out"], "shift": error.sum(keepdims=True), "bias": back.sum(axis=0)}
            inner = np.zeros_like(net["embed"])
            for name, shift in (("first", 0), ("second", 1)):
                bytes_won = rows[win + shift]
                x = net["embed"][bytes_won].reshape(len(chosen), FILTERS, STEP * DIM)
                grad[name] = np.einsum("nf,nfd->df", back, x) + decay * net[name]
                to_bytes = (back[:, :, None] * net[name].T[None]).reshape(-1, DIM)
                np.add.at(inner, bytes_won.ravel(), to_bytes)
            grad["embed"] = inner
            step += 1
            for k, g in grad.items():
                mean[k] += 0.1 * (g - mean[k])
                square[k] += 0.001 * (g * g - square[k])
                net[k] -= (rate * (mean[k] / (1 - 0.9**step)) / (np.sqrt(square[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    return net


def constant(share: float) -> Net:
    net = {"embed": np.zeros((256, DIM)), "first": np.zeros((STEP * DIM, FILTERS)), "second": np.zeros((STEP * DIM, FILTERS)), "bias": np.zeros(FILTERS), "out": np.zeros(FILTERS), "shift": np.zeros(1)}
    net["shift"][0] = np.log(share / (1 - share)) if 0 < share < 1 else 20.0 * (2 * share - 1)
    return {k: v.astype(np.float32) for k, v in net.items()}


def learned(docs: DataFrame, labels: DataFrame, label: str = "quality", sample: int = 4000) -> Net:
    """The network fitted on at most `sample` labelled rows, with scores at the labels' own odds."""
    counts = {r.y: r.n for r in labels.where(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).groupBy(F.col(label).cast("int").alias("y")).agg(F.count("*").alias("n")).collect()}
    ones, zeros = counts.get(1, 0), counts.get(0, 0)
    rows = labelled_sample(docs, labels, label, sample, SEED) if ones and zeros else []
    if len({y for _, y in rows}) < 2:
        return constant(ones / (ones + zeros) if ones + zeros else 0.5)
    net = fit(rows, epochs=max(12, -(-50_000 // len(rows))))
    net["shift"] = net["shift"] + np.float32(np.log(ones / zeros))
    return net


def score_documents(docs: DataFrame, net: Net, threshold: float = 0.7) -> DataFrame:
    """doc_id, held_out, score and predicted of each row."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in slices(frames, most=500_000):
            yield pd.DataFrame({"doc_id": frame["doc_id"].astype("Int64"), "score": scores(net, frame["text"].tolist())})

    scored = docs.select("doc_id", "text").mapInPandas(tidy(run), "doc_id long, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def kept(docs: DataFrame, net: Net, keep: list[str], threshold: float = 0.7) -> DataFrame:
    """The rows of docs that score at least the threshold, with the columns `keep`."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            out = [scores(net, part["text"].tolist()) for part in slices(iter([texts.to_frame("text")]), most=500_000)]
            yield pd.Series(np.concatenate([np.zeros(0), *out]))

    run = tidy(run)

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        yield from run(batches)

    return docs.select(*keep).where(score("text") >= threshold)
