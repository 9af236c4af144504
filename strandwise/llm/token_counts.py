"""Token counts of documents from piece counts of distinct pre-tokens.

1. Every text is cut into pre-tokens; each task counts its own, and a shuffle of distinct pre-tokens
   adds the counts up.
2. The library counts the pieces of each distinct pre-token once.
3. Each document's pre-tokens become frequencies. Those of the frequent pre-tokens (more than one in
   FREQUENT of all occurrences, so fewer than FREQUENT of them, whatever the input) are multiplied by
   their piece counts in the task; the others are joined to the table of piece counts. No pre-token of
   that join has more than a 1 / FREQUENT share of all occurrences, so none is hot. Sums per document follow;
   no list of ids is made for a document.

Special tokens of the vocabulary that stand in a text count as one token each, as by default in the
library. Pre-tokens come from the pattern of the vocabulary file's kind; each character is compared once a
worker with the library's own cutting, and texts with a character that the two class differently are cut
by the library.

Null texts count as empty: no bytes, no tokens. Repeated rows and null or equal doc_ids each give a row.
A pre-token of any length is one; those of more than LONGEST characters are joined by a 256-bit digest.
An empty table gives an empty one. Columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandwise.llm.common import BYTE_BPE_CUT, slices, utf8
from strandwise.session import written

#: A space that white space or the end follows: split() would part what belongs together.
WIDE = re.compile(r" (?:\s|$)")
#: A pre-token with more than one in so many of all occurrences is looked up in the task.
FREQUENT = 1 << 20
#: Pre-tokens of more characters are joined by their digests.
LONGEST = 64
#: Distinct pre-tokens and their characters that a task holds before it hands them on.
HELD, HELD_CHARS = 400_000, 6_000_000


class PreTokens:
    """Cuts texts as a byte-level BPE vocabulary file says, and counts the pieces of pre-tokens."""

    def __init__(self, path: str, pattern: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        cutter = spec.get("pre_tokenizer") or {}
        if cutter.get("type") != "ByteLevel" or cutter.get("add_prefix_space") or not cutter.get("use_regex", True) or spec.get("normalizer"):
            raise ValueError("not a plain byte-level vocabulary")
        added = spec.get("added_tokens") or []
        if any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in added):
            raise ValueError("added tokens that take in their surroundings are not supported")
        names = sorted((t["content"] for t in added), key=len, reverse=True)
        self.special = re.compile("|".join(map(re.escape, names))) if names else None
        self.pattern = regex.compile(pattern)
        #: Characters seen so far, and those that the library classes otherwise than the pattern.
        self.known = set(map(chr, range(128)))
        self.other: set[str] = set()

    def meet(self, texts: list[str]) -> None:
        """Compares how characters not seen before are cut by the pattern and by the library."""
        new = set().union(*[t for t in texts if not t.isascii()]) - self.known
        for c in new:
            probe = f"a{c}1{c} {c}{c}"
            if [m.span() for m in self.pattern.finditer(probe)] != [span for _, span in self.tokenizer.pre_tokenizer.pre_tokenize_str(probe)]:
                self.other.add(c)
        self.known |= new

    def cut(self, text: str) -> tuple[list[str], list[str], int]:
        """Chunks, pre-tokens and the number of special tokens of a text whose characters were met.

        A chunk stands for what `of` gives for it; no pre-token spans a single space before a visible character.
        """
        parts = self.special.split(text) if self.special else [text]
        chunks: list[str] = []
        found: list[str] = []
        for part in parts:
            if self.other and not self.other.isdisjoint(part):
                found += [part[a:b] for _, (a, b) in self.tokenizer.pre_tokenizer.pre_tokenize_str(part)]
            else:
                head, *rest = BYTE_BPE_CUT.split(part) if WIDE.search(part) else part.split(" ")
                found += self.pattern.findall(head)
                chunks += rest
        return chunks, found, len(parts) - 1

    def of(self, chunk: str) -> list[str]:
        """The pre-tokens of a space and a chunk."""
        return self.pattern.findall(" " + chunk)

    def pieces(self, tokens: list[str]) -> list[int]:
        return [len(e.ids) for e in self.tokenizer.encode_batch_fast(tokens, add_special_tokens=False)]


_cutters: dict[tuple[str, str], PreTokens] = {}


def cutter(path: str, pattern: str) -> PreTokens:
    """One cutter a worker, kept from task to task."""
    if (path, pattern) not in _cutters:
        _cutters[path, pattern] = PreTokens(path, pattern)
    return _cutters[path, pattern]


def key_of(token: str) -> str:
    """The pre-token itself, or for a long one a digest, which is longer than any pre-token that stands for itself."""
    return token if len(token) <= LONGEST else "#" + hashlib.blake2b(utf8(token), digest_size=32).hexdigest()


def with_last(frames: Iterator[pd.DataFrame]) -> Iterator[tuple[bool, pd.DataFrame]]:
    """Each frame, and whether it is the last one."""
    before = next(frames, None)
    if before is not None:
        for frame in frames:
            yield False, before
            before = frame
        yield True, before


def distinct_pre_tokens(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """key, token (null: the key is the token) and n, how often it occurs, for every pre-token of docs."""

    def rows(counts: Counter) -> pd.DataFrame:
        keys = [key_of(t) for t in counts]
        return pd.DataFrame({"key": keys, "token": pd.Series([None if k == t else t for k, t in zip(keys, counts)], dtype=object), "n": list(counts.values())})

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cut = cutter(path, pattern)
        chunks: Counter = Counter()
        counts: Counter = Counter()
        for last, frame in with_last(slices(frames, most=1_000_000)):
            texts = frame["text"].tolist()
            cut.meet(texts)
            for text in texts:
                met, found, _ = cut.cut(text)
                chunks.update(met)
                counts.update(found)
            if last or len(chunks) + len(counts) > HELD or sum(map(len, chunks)) + sum(map(len, counts)) > HELD_CHARS:
                for chunk, n in chunks.items():
                    for token in cut.of(chunk):
                        counts[token] += n
                if counts:
                    yield rows(counts)
                chunks, counts = Counter(), Counter()

    found = docs.select("text").mapInPandas(run, "key string, token string, n long")
    return found.groupBy("key", "token").agg(F.sum("n").alias("n"))


def piece_counts(distinct: DataFrame, path: str, pattern: str) -> DataFrame:
    """key, n and pieces: how many tokens the library makes of each distinct pre-token."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cut = cutter(path, pattern)
        for frame in frames:
            tokens = frame["token"].where(frame["token"].notna(), frame["key"])
            yield pd.DataFrame({"key": frame["key"], "n": frame["n"], "pieces": np.array(cut.pieces(tokens.tolist()), np.int64)})

    return distinct.mapInPandas(run, "key string, n long, pieces long")


def token_counts(docs: DataFrame, path: str, pattern: str, limit: int = 512) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit (n_tokens > limit) of each document."""
    spark = docs.sparkSession
    counted = written(piece_counts(distinct_pre_tokens(docs, path, pattern), path, pattern), "piece-counts")
    total = counted.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).head().n
    frequent = counted.where(F.col("n") * FREQUENT > F.lit(total)).select("key", "pieces").toArrow()
    held = spark.sparkContext.broadcast(dict(zip(frequent["key"].to_pylist(), frequent["pieces"].to_pylist())))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cut, known = cutter(path, pattern), held.value
        sums: dict[str, tuple[int, list[str]]] = {}  # of chunks: pieces of known pre-tokens, and the others

        def told(tokens: list[str]) -> tuple[int, list[str]]:
            return sum([known.get(t, 0) for t in tokens]), [t for t in tokens if t not in known]

        row = TaskContext.get().partitionId() << 40
        for frame in slices(frames, most=1_000_000):
            texts = frame["text"].tolist()
            cut.meet(texts)
            totals, others = [], []
            for text in texts:
                chunks, tokens, total = cut.cut(text)
                pieces, unknown = told(tokens)
                total += pieces
                rest = Counter(unknown)
                for chunk, n in Counter(chunks).items():
                    if chunk not in sums:
                        sums[chunk] = told(cut.of(chunk))
                    pieces, unknown = sums[chunk]
                    total += n * pieces
                    for token in unknown:
                        rest[token] += n
                totals.append(total)
                others.append([(key_of(token), n) for token, n in rest.items()])
            if len(sums) > HELD or sum(map(len, sums)) > HELD_CHARS:
                sums.clear()
            yield pd.DataFrame({"row": np.arange(row, row + len(frame)), "doc_id": frame["doc_id"].astype("Int64"), "n_bytes": [len(utf8(t)) for t in texts], "known": totals, "rest": others})
            row += len(frame)

    # Row numbers are a matter of how the input is split; written once, they stay.
    each = written(docs.select("doc_id", "text").mapInPandas(run, "row long, doc_id long, n_bytes long, known long, rest array<struct<key: string, n: long>>"), "token-frequencies")
    pairs = each.select("row", F.explode("rest").alias("pair")).select("row", "pair.key", "pair.n")
    sums = pairs.join(counted.select("key", "pieces"), "key").groupBy("row").agg(F.sum(F.col("n") * F.col("pieces")).alias("joined"))
    n_tokens = F.col("known") + F.coalesce("joined", F.lit(0))
    return each.drop("rest").join(sums, "row", "left").select("doc_id", "n_bytes", n_tokens.alias("n_tokens"), (n_tokens > limit).alias("over_limit"))
