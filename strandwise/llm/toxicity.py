"""Toxicity: a bidirectional gated recurrent network with attention pooling, in numpy.

A text's words (runs of letters and digits, lower-cased) each give a word vector, looked up in the
vocabulary of the training sample, and a character vector made from the embeddings of the word's first
and last EDGE characters; both go through one input projection. A word longer than these that the
vocabulary doesn't hold is read as sub-words of 2 * EDGE characters, EDGE apart, the last one ending
with it, so that every character is read. Windows of WINDOW words that overlap
by half cover the whole text, the last one reaching its end. In each window two gated recurrent layers
read forwards and backwards, attention weighs their states, and the weighted mean gives the window's
logit. The text's score is the highest of its windows' probabilities. A null, empty or word-less text
is one window of padding.

The network is fitted on a bounded sample of labelled rows that are not held out, the error reaching
each text's highest window; scores are then moved to the labels' own odds. Without labels of both
classes every score is the share of label 1, or 0.5. Labels outside 0 and 1 and null labels are passed
over. Repeated rows, null or equal doc_ids each give a row; only the text decides a score.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Container, Iterator
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandwise.llm.common import held_out, labelled_sample, slices, tidy

WORD = re.compile(r"[^\W_]+")
WINDOW, STRIDE = 32, 16
WORD_DIM, CHAR_DIM, EDGE, HIDDEN = 16, 4, 4, 12
CHARS = 128
SEED = 23
#: Windows read at a time.
BLOCK = 512
#: Inputs that a worker remembers projected, or twice the vocabulary if that is more.
REMEMBERED = 60_000

Net = dict[str, np.ndarray]


def coded(text: str, begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Codes of the first and last EDGE characters of pieces of text; 0 is padding, others fold into CHARS - 1 places."""
    points = np.frombuffer((text + "\0").encode("utf-32-le", "surrogatepass"), np.uint32)
    codes = np.where(points > 0, 1 + points % (CHARS - 1), 0).astype(np.uint8)
    out = np.empty((len(begins), 2 * EDGE), np.uint8)
    for k in range(EDGE):
        head, tail = begins + k, ends - EDGE + k
        out[:, k] = codes[np.where(head < ends, head, len(text))]
        out[:, EDGE + k] = codes[np.where(tail >= begins, tail, len(text))]
    return out


def char_codes(words: list[str]) -> np.ndarray:
    """Codes of each word's first and last EDGE characters."""
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)))
    return coded("".join(words), np.append(0, ends)[:-1], ends)


def inputs_of(word: str, vocabulary: Container[str]) -> list[str]:
    """The word itself, or the overlapping sub-words that a long one is read as."""
    if len(word) <= 2 * EDGE or word in vocabulary:
        return [word]
    last = len(word) - 2 * EDGE
    return [word[k : k + 2 * EDGE] for k in [*range(0, last, EDGE), last]]


def cuts(lengths: np.ndarray, whole: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """How many inputs inputs_of makes of each word, and where they begin and end in the words joined; whole: read uncut."""
    short = whole | (lengths <= 2 * EDGE)
    counts = np.where(short, 1, 1 - (2 * EDGE - lengths) // EDGE)
    word = np.repeat(np.arange(len(lengths)), counts)
    nth = np.arange(len(word)) - (np.cumsum(counts) - counts)[word]
    last = np.where(short, 0, lengths - 2 * EDGE)
    begins = (np.cumsum(lengths) - lengths)[word] + np.minimum(nth * EDGE, last[word])
    return counts, begins, begins + np.where(short, lengths, 2 * EDGE)[word]


def indexed(ids: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Word rows of all windows (padding: 0), and the first window of each text, with the end.

    ids holds the rows of all texts' words one after another. A text's windows begin at every STRIDE, the last one ends with the text.
    """
    counts = np.where(lengths <= WINDOW, 1, 1 - (WINDOW - lengths) // STRIDE)
    at = np.append(0, np.cumsum(counts))
    text = np.repeat(np.arange(len(lengths)), counts)
    starts = np.minimum((np.arange(at[-1]) - at[text]) * STRIDE, np.maximum(lengths - WINDOW, 0)[text])
    begins, left = (np.cumsum(lengths) - lengths)[text] + starts, (lengths[text] - starts)[:, None]
    span = np.arange(WINDOW)
    padded = np.append(ids, np.zeros(WINDOW, ids.dtype))
    rows = padded[begins[:, None] + span]
    rows[span >= left] = 0
    return rows, at


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 + 0.5 * np.tanh(0.5 * x)


def inputs(net: Net, word_rows: np.ndarray, chars: np.ndarray) -> np.ndarray:
    return np.concatenate([net["words"][word_rows], net["chars"][chars].reshape(len(chars), -1)], axis=1)


def read(net: Net, way: str, x: np.ndarray, keep: bool = False) -> tuple[np.ndarray, list]:
    """States of one gated recurrent layer over x (steps, windows, 3 * HIDDEN), in the order of the steps."""
    h = np.zeros((x.shape[1], HIDDEN), np.float32)
    states, saved = np.empty((*x.shape[:2], HIDDEN), np.float32), []
    gates, candidate = net["gates" + way], net["candidate" + way]
    steps = range(len(x)) if way == "f" else range(len(x) - 1, -1, -1)
    for t in steps:
        zr = sigmoid(x[t, :, : 2 * HIDDEN] + h @ gates)
        z, r = zr[:, :HIDDEN], zr[:, HIDDEN:]
        c = np.tanh(x[t, :, 2 * HIDDEN :] + (r * h) @ candidate)
        new = h + z * (c - h)
        if keep:
            saved.append((t, h, z, r, c))
        states[t] = h = new
    return states, saved


def joined(f: np.ndarray, b: np.ndarray) -> np.ndarray:
    """One matrix for both layers: f forwards, b backwards, side by side."""
    out = np.zeros((f.shape[0] + b.shape[0], f.shape[1] + b.shape[1]), np.float32)
    out[: f.shape[0], : f.shape[1]], out[f.shape[0] :, f.shape[1] :] = f, b
    return out


def window_logits(net: Net, projected: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Logits of windows; projected holds the inputs of each word row for both layers, row 0 for padding.

    The same as read() of both layers and attention, with both at once: one begins where the other ends, so each step
    reads a word from either end. The sigmoid's halves are in the weights, and of states only what attention and output need is kept.
    """
    halves = np.split(net["gatesf"], 2, axis=1), np.split(net["gatesb"], 2, axis=1)
    gates = 0.5 * np.stack([joined(f, b) for f, b in zip(*halves)])
    candidate = 0.5 * joined(net["candidatef"], net["candidateb"])
    ends = joined(*np.split(np.stack([net["attend"], net["out"]], axis=1), 2))
    parts = projected.reshape(-1, HIDDEN)  # a row's update and reset gates and candidate, forwards, then backwards
    gate = np.arange(3)[:, None, None]
    out = []
    for begin in range(0, len(rows), BLOCK):
        part = rows[begin : begin + BLOCK].T
        n = part.shape[1]
        places = np.stack([6 * part, 6 * part[::-1] + 3], axis=2)
        h = np.zeros((n, 2 * HIDDEN), np.float32)
        seen = np.empty((WINDOW, n, 4), np.float32)
        x, change = np.empty((3, n, 2, HIDDEN), np.float32), np.empty_like(h)
        both = x.reshape(3, n, 2 * HIDDEN)
        zr, c = both[:2], both[2]
        for t in range(WINDOW):
            np.take(parts, places[t] + gate, axis=0, out=x, mode="clip")
            zr += h @ gates
            np.tanh(zr, out=zr)
            zr += 1
            np.multiply(zr[1], h, out=change)
            c += change @ candidate
            np.tanh(c, out=c)
            np.subtract(c, h, out=change)
            change *= zr[0]
            change *= 0.5
            h += change
            np.matmul(h, ends, out=seen[t])
        score, value = np.moveaxis(seen[..., :2] + seen[::-1, :, 2:], 2, 0)
        weight = np.exp(score - 30.0 * (part == 0))
        out.append((weight * value).sum(axis=0) / (weight.sum(axis=0) + 1e-30) + net["shift"][0])
    return np.concatenate(out)


#: Half for the gates, whose sigmoid is a tanh of half its argument.
HALF = np.tile(np.repeat(np.array([0.5, 0.5, 1], np.float32), HIDDEN), 2)


def project(net: Net, word_rows: np.ndarray, chars: np.ndarray) -> np.ndarray:
    """Inputs of window_logits."""
    return (inputs(net, word_rows, chars) @ (net["project"] * HALF) + net["offset"] * HALF).astype(np.float32, copy=False)


class Scorer:
    """Scores texts; the projected inputs of the vocabulary and of words met before are remembered."""

    def __init__(self, net: Net, vocabulary: dict[str, int]):
        self.net, self.vocabulary = net, vocabulary
        self.most = max(REMEMBERED, 2 * len(vocabulary))
        self.projected = np.zeros((self.most, 6 * HIDDEN), np.float32)  # row 0: padding
        self.words: dict[str, int] = {}
        self.bounds = np.zeros(1, np.int64)  # of each word's inputs in rows
        self.rows = np.zeros(0, np.int64)
        self.used = 1
        if vocabulary:
            self.learn(list(vocabulary), np.fromiter(vocabulary.values(), np.int64, len(vocabulary)))
        self.kept = self.used

    def clear(self) -> None:
        """Forgets all words but the vocabulary's."""
        n = len(self.vocabulary)
        self.words = dict(zip(self.vocabulary, range(n)))
        self.bounds, self.rows, self.used = self.bounds[: n + 1].copy(), self.rows[:n].copy(), self.kept
        if len(self.projected) > self.most:
            self.projected = self.projected[: self.most].copy()

    def learn(self, new: list[str], own: np.ndarray) -> None:
        """Projects the inputs of words not met before, equal ones once; own: the words' places in the vocabulary, or 0."""
        text, get = "".join(new), self.vocabulary.get
        counts, begins, ends = cuts(np.fromiter(map(len, new), np.int64, len(new)), own > 0)
        known, several = np.repeat(own, counts), np.repeat(counts > 1, counts)
        known[several] = [get(text[a : a + 2 * EDGE], 0) for a in begins[several].tolist()]
        chars = coded(text, begins, ends)
        keys = np.where(known > 0, np.uint64(2**63) + known.astype(np.uint64), chars.view(np.uint64)[:, 0])  # codes are below 128
        _, first, place = np.unique(keys, return_index=True, return_inverse=True)
        end = self.used + len(first)
        if end > len(self.projected):
            larger = np.zeros((end, 6 * HIDDEN), np.float32)  # for this call alone: the next one clears it
            larger[: self.used] = self.projected[: self.used]
            self.projected = larger
        self.projected[self.used : end] = project(self.net, known[first], chars[first])
        self.words.update(zip(new, range(len(self.words), len(self.words) + len(new))))
        self.bounds = np.append(self.bounds, self.bounds[-1] + np.cumsum(counts))
        self.rows = np.append(self.rows, self.used + place)
        self.used = end

    def __call__(self, texts: list[str]) -> np.ndarray:
        if not texts:
            return np.zeros(0)
        split = [WORD.findall(t.lower()) for t in texts]
        flat = list(chain.from_iterable(split))
        met = set(flat)
        new = list(met - self.words.keys())
        lengths = np.fromiter(map(len, new), np.int64, len(new))
        needed = int(np.maximum(1, 1 - (2 * EDGE - lengths) // EDGE).sum())
        if self.used + needed > self.most or len(self.rows) > 2 * self.most:
            self.clear()
            new = list(met - self.words.keys())
        if new:
            self.learn(new, np.zeros(len(new), np.int64))
        word = np.fromiter(map(self.words.__getitem__, flat), np.int64, len(flat))
        begins = self.bounds[word]
        counts = self.bounds[word + 1] - begins
        ends = np.append(0, np.cumsum(counts))
        ids = self.rows[np.repeat(begins - ends[:-1], counts) + np.arange(ends[-1])]
        of_text = np.append(0, np.cumsum(np.fromiter(map(len, split), np.int64, len(split))))
        rows, at = indexed(ids, np.diff(ends[of_text]))
        logits = window_logits(self.net, self.projected, rows)
        return 1 / (1 + np.exp(-np.maximum.reduceat(logits, at[:-1]).astype(np.float64)))


def fresh(n_words: int, seed: int) -> Net:
    draw = np.random.default_rng(seed)
    width = WORD_DIM + 2 * EDGE * CHAR_DIM
    net: Net = {"words": draw.normal(0, 0.3, (n_words + 1, WORD_DIM)), "chars": draw.normal(0, 0.3, (CHARS, CHAR_DIM)), "project": draw.normal(0, width**-0.5, (width, 6 * HIDDEN)), "offset": np.zeros(6 * HIDDEN)}
    for way in "fb":
        net["gates" + way] = draw.normal(0, HIDDEN**-0.5, (HIDDEN, 2 * HIDDEN))
        net["candidate" + way] = draw.normal(0, HIDDEN**-0.5, (HIDDEN, HIDDEN))
    net |= {"attend": draw.normal(0, 0.3, 2 * HIDDEN), "out": draw.normal(0, 0.3, 2 * HIDDEN), "shift": np.zeros(1)}
    net["words"][0] = 0
    return {k: v.astype(np.float32) for k, v in net.items()}


def gradients(net: Net, word_rows: np.ndarray, chars: np.ndarray, pad: np.ndarray, labels: np.ndarray, weight: np.ndarray) -> tuple[float, Net]:
    """Weighted cross-entropy of one window a text and its gradients.

    word_rows (steps, texts), chars (steps, texts, 2 * EDGE), pad (steps, texts) true where no word is.
    """
    steps, n = word_rows.shape
    flat = inputs(net, word_rows.ravel(), chars.reshape(steps * n, -1))
    x = (flat @ net["project"] + net["offset"]).reshape(steps, n, -1) * ~pad[..., None]
    ways = {"f": read(net, "f", x[..., : 3 * HIDDEN], True), "b": read(net, "b", x[..., 3 * HIDDEN :], True)}
    states = np.concatenate([ways["f"][0], ways["b"][0]], axis=2)
    attention = np.exp(states @ net["attend"] - 30.0 * pad)
    attention = attention / (attention.sum(axis=0) + 1e-30)
    pooled = (states * attention[..., None]).sum(axis=0)
    logit = pooled @ net["out"] + net["shift"][0]
    loss = float((weight * (np.logaddexp(0, logit) - labels * logit)).sum())
    error = weight * (1 / (1 + np.exp(-logit)) - labels)
    grad: Net = {"out": pooled.T @ error, "shift": error.sum(keepdims=True)}
    d_pooled = error[:, None] * net["out"]
    d_attention = (states * d_pooled).sum(axis=2)
    d_score = attention * (d_attention - (attention * d_attention).sum(axis=0))
    grad["attend"] = (states * d_score[..., None]).sum(axis=(0, 1))
    d_states = attention[..., None] * d_pooled + d_score[..., None] * net["attend"]
    d_x = np.zeros_like(x)
    for k, way in enumerate("fb"):
        gates, candidate = net["gates" + way], net["candidate" + way]
        grad["gates" + way], grad["candidate" + way] = np.zeros_like(gates), np.zeros_like(candidate)
        d_h = np.zeros((n, HIDDEN), np.float32)
        for t, h, z, r, c in reversed(ways[way][1]):
            d_new = d_h + d_states[t, :, k * HIDDEN : (k + 1) * HIDDEN]
            d_c = d_new * z * (1 - c * c)
            d_rh = d_c @ candidate.T
            d_zr = np.concatenate([d_new * (c - h) * z * (1 - z), d_rh * h * r * (1 - r)], axis=1)
            grad["candidate" + way] += (r * h).T @ d_c
            grad["gates" + way] += h.T @ d_zr
            d_h = d_new * (1 - z) + d_rh * r + d_zr @ gates.T
            d_x[t, :, 3 * HIDDEN * k : 3 * HIDDEN * (k + 1)] = np.concatenate([d_zr, d_c], axis=1)
    d_x *= ~pad[..., None]
    d_flat = d_x.reshape(steps * n, -1)
    grad["project"], grad["offset"] = flat.T @ d_flat, d_flat.sum(axis=0)
    d_in = d_flat @ net["project"].T
    grad["words"] = np.zeros_like(net["words"])
    np.add.at(grad["words"], word_rows.ravel(), d_in[:, :WORD_DIM])
    grad["words"][0] = 0
    grad["chars"] = np.zeros_like(net["chars"])
    np.add.at(grad["chars"], chars.reshape(-1), d_in[:, WORD_DIM:].reshape(-1, CHAR_DIM))
    return loss, grad


def fit(sample: list[tuple[str, int]], passes: int = 20_000, batch: int = 32, rate: float = 0.01, decay: float = 2e-4, vocabulary_size: int = 20_000, seed: int = SEED) -> tuple[Net, dict[str, int]]:
    """Adam over about `passes` texts drawn in whole epochs; the vocabulary is the sample's words in two texts at least."""
    draw = np.random.default_rng(seed)
    split = [WORD.findall(text.lower()) for text, _ in sample]
    seen = Counter(w for words in split for w in set(words))
    vocabulary = {w: i for i, (w, _) in enumerate(sorted(((w, n) for w, n in seen.items() if n > 1), key=lambda x: (-x[1], x[0]))[:vocabulary_size], 1)}
    split = [[x for w in words for x in inputs_of(w, vocabulary)] for words in split]
    all_words = [""] + sorted({x for words in split for x in words})
    row = {w: i for i, w in enumerate(all_words)}
    known = np.array([vocabulary.get(w, 0) for w in all_words])
    chars = char_codes(all_words)
    texts = [np.array([row[w] for w in words], np.int64) for words in split]
    lengths = np.array([len(words) for words in split])
    labels = np.array([y for _, y in sample], np.float32)
    weight = np.where(labels == 1, 0.5 / labels.mean(), 0.5 / (1 - labels.mean())).astype(np.float32)
    net = fresh(len(vocabulary), seed)
    mean = {k: np.zeros_like(v) for k, v in net.items()}
    square = {k: np.zeros_like(v) for k, v in net.items()}
    epochs, step = max(2, -(-passes // len(sample))), 0
    for _ in range(epochs):
        order = draw.permutation(len(sample))
        for begin in range(0, len(order), batch):
            chosen = order[begin : begin + batch]
            rows, at = indexed(np.concatenate([texts[i] for i in chosen]), lengths[chosen])
            met, place = np.unique(np.append(rows.ravel(), 0), return_inverse=True)
            projected = project(net, known[met], chars[met])
            projected[0] = 0  # padding is the least row
            logits = window_logits(net, projected, place[:-1].reshape(rows.shape))
            top = np.array([a + logits[a:b].argmax() for a, b in zip(at, at[1:])])
            word = rows[top].T
            _, grad = gradients(net, known[word], chars[word], word == 0, labels[chosen], weight[chosen] / len(chosen))
            step += 1
            for k, g in grad.items():
                g = g + decay * net[k] if k not in ("shift", "offset") else g
                mean[k] += 0.1 * (g - mean[k])
                square[k] += 0.001 * (g * g - square[k])
                net[k] -= (rate * (mean[k] / (1 - 0.9**step)) / (np.sqrt(square[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    return net, vocabulary


def constant(share: float) -> tuple[Net, dict[str, int]]:
    net = {k: np.zeros_like(v) for k, v in fresh(0, 0).items()}
    net["shift"][0] = np.log(share / (1 - share)) if 0 < share < 1 else 20.0 * (2 * share - 1)
    return net, {}


def learned(docs: DataFrame, labels: DataFrame, label: str = "toxic", sample: int = 2000) -> tuple[Net, dict[str, int]]:
    """The network and vocabulary fitted on at most `sample` labelled rows, with scores at the labels' own odds."""
    counts = {r.y: r.n for r in labels.where(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).groupBy(F.col(label).cast("int").alias("y")).agg(F.count("*").alias("n")).collect()}
    ones, zeros = counts.get(1, 0), counts.get(0, 0)
    rows = labelled_sample(docs, labels, label, sample, SEED) if ones and zeros else []
    if len({y for _, y in rows}) < 2:
        return constant(ones / (ones + zeros) if ones + zeros else 0.5)
    net, vocabulary = fit(rows)
    net["shift"] = net["shift"] + np.float32(np.log(ones / zeros))
    return net, vocabulary


def score_documents(docs: DataFrame, model: tuple[Net, dict[str, int]], threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score and predicted of each row."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer = Scorer(*model)
        for frame in slices(frames, most=500_000):
            yield pd.DataFrame({"doc_id": frame["doc_id"].astype("Int64"), "score": scorer(frame["text"].tolist())})

    scored = docs.select("doc_id", "text").mapInPandas(tidy(run), "doc_id long, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def kept(docs: DataFrame, model: tuple[Net, dict[str, int]], keep: list[str], threshold: float = 0.3) -> DataFrame:
    """The rows of docs that score below the threshold, with the columns `keep`."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        scorer = Scorer(*model)
        for texts in batches:
            out = [scorer(part["text"].tolist()) for part in slices(iter([texts.to_frame("text")]), most=500_000)]
            yield pd.Series(np.concatenate([np.zeros(0), *out]))

    run = tidy(run)

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        yield from run(batches)

    return docs.select(*keep).where(score("text") < threshold)
