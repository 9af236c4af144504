"""Shared parts: bounded batches, vectorised byte hashes, order by document, chunk-wise tokenizer caches."""

from __future__ import annotations

import ctypes
import gc
import hashlib
import json
import re
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

#: Code points of text that a Python worker holds at once, but for a single longer text.
BATCH_CHARS = 2_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def slices(frames: Iterator[pd.DataFrame], text: str = "text", most: int = BATCH_CHARS) -> Iterator[pd.DataFrame]:
    """The rows of frames in order, cut so that each frame's texts (null: empty) have at most `most` code points."""
    for frame in frames:
        frame[text] = frame[text].where(frame[text].notna(), "")
        ends = frame[text].str.len().to_numpy(dtype=np.int64).cumsum()
        begin = 0
        while begin < len(frame):
            base = ends[begin - 1] if begin else 0
            end = max(begin + 1, int(np.searchsorted(ends, base + most, side="right")))
            yield frame.iloc[begin:end].reset_index(drop=True)
            begin = end


def give_back() -> None:
    """Returns the worker's free memory to the system: a worker lives on and would hold it through later stages."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of the GNU library
    if trim:
        trim(0)


def tidy(run: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """run, which gives memory back at the end of a task."""

    def tidied(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        yield from run(frames)  # what run holds goes with it, before memory is given back
        give_back()

    return tidied


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on uint64 (shift-xor-multiply rounds)."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x7FB5D329728EA185)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


class RangeHash:
    """64-bit hashes of byte ranges of one buffer from one pass of prefix sums.

    Byte b at place j adds table[b] * base**j modulo 2**64; a range's sum is divided by base**start
    (base is odd, so it has an inverse), which makes the hash independent of the place. Long ranges can
    be built to collide modulo a power of two, so those of more than LONG bytes are hashed by blake2b.
    """

    BASE = 0x9E3779B97F4A7C15
    SEED = 20_240_229
    LONG = 256

    def __init__(self, buffer: np.ndarray):
        n = len(buffer)
        self.buffer = buffer
        table = np.random.default_rng(self.SEED).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.inverse = self.powers(pow(self.BASE, -1, 2**64), n)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(table[buffer] * self.powers(self.BASE, n)[:n], out=self.sums[1:])

    @staticmethod
    def powers(base: int, n: int) -> np.ndarray:
        """base**0 .. base**n modulo 2**64, by doubling."""
        out = np.ones(n + 1, np.uint64)
        done = 1
        while done <= n:
            more = min(done, n + 1 - done)
            out[done : done + more] = out[:more] * np.uint64(pow(base, done, 2**64))
            done += more
        return out

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        raw = (self.sums[ends] - self.sums[starts]) * self.inverse[starts]
        out = mix64(raw + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
        for i in np.flatnonzero(ends - starts > self.LONG).tolist():
            out[i] = int.from_bytes(hashlib.blake2b(self.buffer[starts[i] : ends[i]], digest_size=8).digest(), "little")
        return out


def joined_bytes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """One byte array of all texts, each followed by a newline; and where each text starts, with the end."""
    lengths = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
    return np.frombuffer(b"\n".join(texts) + b"\n", np.uint8), np.concatenate([[0], np.cumsum(lengths)])


def utf8(text: str) -> bytes:
    return text.encode("utf-8", "surrogatepass")


def word_bounds(buffer: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of bytes other than space and 0x09-0x0D."""
    space = (buffer == 32) | ((buffer >= 9) & (buffer <= 13))
    edges = np.flatnonzero(np.diff(np.concatenate([[True], space, [True]]).astype(np.int8)))
    return edges[0::2], edges[1::2]


def partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def compressed(text: str) -> bytes:
    import zstandard

    return zstandard.ZstdCompressor(level=3).compress(utf8(text))


def decompressed(data: bytes) -> str:
    import zstandard

    return zstandard.ZstdDecompressor().decompress(data).decode("utf-8", "surrogatepass")


def in_order(docs: DataFrame, key: str = "doc_id", descending: bool = False, neighbours: bool = False) -> tuple[DataFrame, int]:
    """Documents dealt to partitions by ranges of key and sorted within them.

    Rows: part int (the range, ascending in the order asked for), order_key long, key, text (null: empty).
    A null key counts as the smallest; equal keys are ordered by text. With neighbours, rows also have guest boolean
    and, for text, z binary (zstd-compressed), and those that begin the next range (after the last: the first)
    come once more at the end of each range, as guests; equal keys are then ordered by z.
    Only one key a range is gathered on the driver; range bounds come from a quantile sketch of all keys.
    """
    spark = docs.sparkSession
    n = partitions(spark)
    keyed = docs.select(F.col(key), "text", F.coalesce(F.col(key).cast("long"), F.lit(-(2**63))).alias("order_key"))
    cuts = sorted({int(x) for x in keyed.approxQuantile("order_key", [i / n for i in range(1, n)], 0.1 / n)}) if n > 1 else []
    bounds = np.array(cuts, dtype=np.int64)
    last = len(cuts)
    guests: dict[int, list[int]] = {}
    by_key = F.col("order_key").desc() if descending else F.col("order_key").asc()
    literal = F.array(*[F.lit(x).cast("long") for x in cuts]) if cuts else F.array().cast("array<bigint>")
    nth = F.size(F.filter(literal, lambda b: b <= F.col("order_key")))
    if not neighbours:
        part = (F.lit(last) - nth if descending else nth).cast("int")
        plain = keyed.select(part.alias("part"), "order_key", F.col(key).cast("long").alias(key), F.coalesce("text", F.lit("")).alias("text"))
        return plain.repartitionById(last + 1, F.col("part")).sortWithinPartitions(F.col("part"), by_key, F.col("text")), last + 1
    ranged = keyed.select("order_key", nth.alias("r"))
    edge = F.max("order_key") if descending else F.min("order_key")
    heads = sorted(((r.r, r.k) for r in ranged.groupBy("r").agg(edge.alias("k")).collect()), reverse=descending)
    for (r, _), (_, k) in zip(heads, heads[1:] + heads[:1]):
        guests.setdefault(k, []).append(last - r if descending else r)

    def deal(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in slices(frames):
            z = [compressed(t) for t in frame["text"]]
            part = np.searchsorted(bounds, frame["order_key"].to_numpy(np.int64), side="right")
            part = last - part if descending else part
            own = pd.DataFrame({"part": part.astype(np.int32), "guest": False, "order_key": frame["order_key"], key: frame[key].astype("Int64"), "z": z})
            yield own
            if guests:
                for i, k in enumerate(frame["order_key"]):
                    for r in guests.get(k, ()):
                        row = own.iloc[[i]].copy()
                        row["part"], row["guest"] = np.int32(r), True
                        yield row

    dealt = keyed.mapInPandas(deal, f"part int, guest boolean, order_key long, {key} long, z binary")
    dealt = dealt.repartitionById(last + 1, F.col("part")).sortWithinPartitions(F.col("part"), F.col("guest"), by_key, F.col("z"))
    return dealt, last + 1


def held_out(doc_id: Column) -> Column:
    """True for the rows that no label may be learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


#: Code points of a labelled sample's texts, half of each class: the sample is gathered and fitted on the driver.
SAMPLE_CHARS = 32_000_000


def within(sizes: list[Row], most: int) -> set[tuple]:
    """sample_id and y of the rows (draw, sample_id, y, n) that a sample of at most `most` code points keeps.

    Rows of a class are taken in the order of draw, but for those that its half has no room left for; the shortest, if none fits.
    """
    out: set[tuple] = set()
    for label in {r.y for r in sizes}:
        room, taken = most // 2, set()
        own = sorted((r for r in sizes if r.y == label), key=lambda r: (r.draw, r.sample_id))
        for r in own:
            if r.n <= room:
                room -= r.n
                taken.add((r.sample_id, label))
        out |= taken or {(min(own, key=lambda r: r.n).sample_id, label)}
    return out


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, bound: int, seed: int, most: int = SAMPLE_CHARS) -> list[tuple[str, int]]:
    """Texts and labels of at most bound rows, half of each class at most, that are not held out.

    The rows with the least hashes of doc_id are taken, so the sample is the same however the tables are dealt.
    Of rows that share a doc_id, the one of least text hash stands for all. Rows without a label or doc_id are passed over.
    Rows whose texts have more than `most` code points together are thinned out by within() before texts are gathered.
    """
    open_rows = labels.select(F.col("doc_id").alias("sample_id"), F.col(label).cast("int").alias("y")).where(F.col("y").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).distinct()
    draw = F.xxhash64("sample_id", F.lit(seed))
    each = [open_rows.where(F.col("y") == y).withColumn("draw", draw).orderBy("draw", "sample_id").limit(bound // 2) for y in (0, 1)]
    chosen = F.broadcast(each[0].unionAll(each[1]))
    texts = docs.select(F.col("doc_id").alias("text_id"), F.coalesce("text", F.lit("")).alias("text"))
    met = texts.join(chosen, texts["text_id"] == chosen["sample_id"]).select("draw", "sample_id", "y", "text")
    hashed = F.xxhash64("text").alias("hash")
    each_id = met.groupBy("draw", "sample_id", "y")
    sizes = each_id.agg(F.min(F.struct(hashed, F.length("text").alias("n")))["n"].alias("n")).collect()
    kept = within(sizes, most)
    if len(kept) < len(sizes):
        each_id = met.where(F.col("sample_id").isin(sorted({i for i, _ in kept}))).groupBy("draw", "sample_id", "y")
    rows = [r for r in each_id.agg(F.min(F.struct(hashed, "text"))["text"].alias("text")).collect() if (r.sample_id, r.y) in kept]
    rows.sort(key=lambda r: (r.draw, r.sample_id, r.text, r.y))
    return [(r.text, r.y) for r in rows]


#: A token never spans a single space that is followed by something else than white space, for byte-level BPE patterns.
BYTE_BPE_CUT = re.compile(r" (?=\S)")
#: A token never spans these, for tokenizers that drop white space.
BLANK_CUT = re.compile(r"[ \n\t\r]+")
#: Distinct chunks that a worker remembers, in two generations (or, where no other stage needs its memory, MANY), and the longest of them.
REMEMBERED, MANY, LONGEST = 500_000, 2_000_000, 200
#: Marks that, after a letter, begin a token of their own in all of these patterns and go on to the end of the chunk.
TAIL = ".,;:!?*#$%&"


class ChunkCache:
    """Encodes texts chunk by chunk; chunks seen before come from a table bounded in rows and bytes.

    encode takes a list of chunks and returns for each its ids as little-endian uint32 bytes.
    Texts are split at single spaces. With lead, every piece but a text's first gets back the space before it; a text
    with a piece that white space begins, or an empty one, is split by the pattern `cut` instead. Without lead, pieces are split
    again by `cut`. A piece not seen before is looked up as a word and the marks behind it; with fold, ASCII words in lower case.
    When the newer generation is full it becomes the older one, and what is met again moves back, so common words stay.
    """

    def __init__(self, encode: Callable[[list[str]], list[bytes]], cut: re.Pattern, lead: str = "", fold: bool = False, remembered: int = REMEMBERED):
        self.encode, self.cut, self.lead, self.fold, self.remembered = encode, cut, lead, fold, remembered
        self.recent: dict[str, bytes | None] = {}
        self.older: dict[str, bytes | None] = {}
        self.plain: dict[str, bytes] = {"": b""}

    def parts(self, chunk: str) -> tuple[str, str]:
        """A word and the marks behind it."""
        word = chunk.rstrip(TAIL)
        split = word and word != chunk and "A" <= word[-1] < "\u0100" and word[-1].isalpha()
        first = word if split else chunk
        if self.fold and first.isascii():
            first = first.lower()
        return first, chunk[len(word) :] if split else ""

    def recall(self, chunks: set[str]) -> set[str]:
        """The chunks that neither generation knows; those of the older one move to the newer."""
        unknown, older = chunks.difference(self.recent), self.older
        again = [x for x in unknown if x in older]
        self.recent.update(zip(again, map(older.__getitem__, again)))
        unknown.difference_update(again)
        return unknown

    def learn(self, chunks: set[str], plain: set[str]) -> None:
        """Puts the chunks' ids into the newer generation (None: to be split by the pattern), those of strings without lead into plain."""
        recent, parts = self.recent, self.parts
        words: set[str] = set()
        single: list[tuple[str, str, str]] = []
        made: list[tuple[str, list[tuple[str, str]]]] = []
        for x in chunks:
            if x.isalpha() and (self.lead or not self.fold or x.islower() or not x.isascii()):
                words.add(x)
            elif self.lead and (not x or x[0].isspace()):
                recent[x] = None
            elif self.lead or (x and x.isprintable()):
                single.append((x, *parts(x)))
            else:
                made.append((x, [parts(s) for s in self.cut.split(x) if s]))
        words |= self.recall({a for _, a, _ in single} | {a for _, pairs in made for a, _ in pairs})
        names = list(words)
        rest = list(plain.union([b for _, _, b in single], [b for _, pairs in made for _, b in pairs]).difference(self.plain))
        ids = self.encode([self.lead + w for w in names] + rest)
        recent.update(zip(names, ids))
        self.plain.update(zip(rest, ids[len(names) :]))
        for x, word, marks in single:
            if marks or word != x:
                recent[x] = recent[word] + self.plain[marks]
        for x, pairs in made:
            if len(pairs) != 1 or pairs[0] != (x, ""):
                recent[x] = b"".join([recent[a] + self.plain[b] for a, b in pairs])

    def joined(self, pieces: list[list[str]]) -> list[bytes | None]:
        """Ids of texts given in pieces; None where a piece has to be split by the pattern."""
        heads = [p.pop(0) for p in pieces] if self.lead else [""] * len(pieces)
        unknown = self.recall(set(chain.from_iterable(pieces)))
        self.learn(unknown, set(heads))
        get = self.recent.__getitem__
        out: list[bytes | None] = []
        for head, piece in zip(heads, pieces):
            try:
                out.append(self.plain[head] + b"".join(map(get, piece)))
            except TypeError:
                out.append(None)
        for table, most in ((self.recent, unknown), (self.plain, heads)):
            for x in most:
                if len(x) > LONGEST:
                    table.pop(x, None)
        return out

    def __call__(self, texts: list[str]) -> list[bytes]:
        if len(self.recent) > self.remembered // 2:
            self.older, self.recent = self.recent, {}
        if len(self.plain) > self.remembered // 10:
            self.plain = {"": b""}
        out = self.joined([t.split(" ") for t in texts])
        odd = [i for i, data in enumerate(out) if data is None]
        if odd:
            for i, data in zip(odd, self.joined([self.cut.split(texts[i]) for i in odd])):
                out[i] = data
        return out


#: Letters whose runs the word-level pattern keeps whole and that no normaliser changes beyond their case, then marks that form a token run of their own.
PLAIN_WORD = re.compile(r"[A-Za-z\u00C0-\u00D6\u00D8-\u00F6\u00F8-\u00FF]+([.,;:!?*#$%&]+)?")
#: Words of these letters alone, after a space for byte-level vocabularies.
PLAIN_LETTERS = re.compile(r"[A-Za-z\u00C0-\u00D6\u00D8-\u00F6\u00F8-\u00FF]+")
#: Chunks that go to the library as one text.
JOINED = 1000


def byte_letters() -> dict[int, int]:
    """The letter by which byte-level vocabularies name each byte."""
    named = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in named]
    return {b: b for b in named} | {b: 256 + i for i, b in enumerate(others)}


class LibraryEncoder:
    """Distinct chunks through the tokenizers library with add_special_tokens=False, many in one call.

    Most of a call for one short chunk is overhead, so chunks are joined to longer texts and the ids
    are cut again where the vocabulary shows a border: at tokens that end a word (word-level
    vocabularies), or at tokens that begin with a space (byte-level ones). Chunks whose number of such
    marks isn't known beforehand go alone, as do all of a call whose marks don't add up.

    Normalising and pre-tokenizing take most of the library's time. Words of plain letters, which these steps only
    lower (word-level vocabularies) and spell by bytes, go spelt like that to the same model behind a split at spaces.
    Whether the steps do no more than that to any of these letters is asked of them at the start.
    """

    SPELLING = {b: n for b, n in byte_letters().items() if b != 32}

    def __init__(self, path: str, words: bool):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.words = words
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.mark = np.zeros(max(vocabulary.values()) + 1, bool)
        self.mark[[i for t, i in vocabulary.items() if (t.endswith("</w>") if words else t.startswith("\u0120"))]] = True
        self.model = self.bare()

    def bare(self):
        """The model behind a split at spaces; None if plain letters need more than that, or hold added tokens."""
        from tokenizers import Tokenizer, pre_tokenizers

        whole, letters = self.tokenizer, "".join(chr(c) for c in range(0x100) if PLAIN_LETTERS.fullmatch(chr(c)))
        text = letters if self.words else " " + letters
        normal = whole.normalizer.normalize_str(text) if whole.normalizer else text
        parts = [p for p, _ in whole.pre_tokenizer.pre_tokenize_str(normal)] if whole.pre_tokenizer else []
        added = any(PLAIN_LETTERS.search(t.content) and PLAIN_LETTERS.fullmatch(t.content.strip()) for t in whole.get_added_tokens_decoder().values())
        if added or parts != [self.spelt([text])]:
            return None
        settings = json.loads(whole.to_str()) | {"added_tokens": [], "normalizer": None, "pre_tokenizer": None, "post_processor": None, "truncation": None, "padding": None}
        model = Tokenizer.from_str(json.dumps(settings))
        model.pre_tokenizer = pre_tokenizers.Split(" ", "removed")
        return model

    def spelt(self, chunks: list[str]) -> str:
        """Chunks of plain letters as the model's vocabulary spells them, with spaces between."""
        text = " ".join(chunks).lower() if self.words else "".join(chunks)
        if not text.isascii():
            text = text.encode().decode("latin-1").translate(self.SPELLING)
        return text if self.words else text.replace(" ", " \u0120")[1:]

    def marks(self, chunk: str) -> int:
        """How many marks the chunk's ids hold; 0: not known."""
        if self.words:
            if chunk.isascii() and chunk.isalpha():
                return 1
            plain = PLAIN_WORD.fullmatch(chunk)
            return 0 if plain is None else 1 if plain[1] is None else 2
        word = chunk[1:]
        return int(chunk[:1] == " " and (word.isalnum() or (len(word.split()) == 1 and not word[0].isspace() and not word[-1].isspace())))

    def alone(self, chunks: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(chunks, add_special_tokens=False)]

    def __call__(self, chunks: list[str]) -> list[bytes]:
        out: list[bytes] = [b""] * len(chunks)
        rest = range(len(chunks))
        if self.model is not None:
            first, plain = int(not self.words), PLAIN_LETTERS.fullmatch
            rest, letters = [], []
            for i, chunk in enumerate(chunks):
                (letters if plain(chunk, first) and chunk[:first] in ("", " ") else rest).append(i)
            groups = [letters[i : i + JOINED] for i in range(0, len(letters), JOINED)]
            for group, encoded in zip(groups, self.model.encode_batch_fast([self.spelt([chunks[i] for i in g]) for g in groups], add_special_tokens=False)):
                ids = np.array(encoded.ids, "<u4")
                at = np.flatnonzero(self.mark[ids])
                if len(at) != len(group):
                    rest += group
                    continue
                ends = (4 * (at + 1 if self.words else np.append(at[1:], len(ids)))).tolist()
                data = ids.tobytes()
                for i, begin, end in zip(group, [0, *ends], ends):
                    out[i] = data[begin:end]
        counts = np.zeros(len(chunks), np.int64)
        counts[list(rest)] = [self.marks(chunks[i]) for i in rest]
        many, single = np.flatnonzero(counts), [i for i in rest if not counts[i]]
        groups = [many[i : i + JOINED].tolist() for i in range(0, len(many), JOINED)]
        texts = [(" " if self.words else "").join([chunks[i] for i in g]) for g in groups]
        for group, encoded in zip(groups, self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)):
            ids = np.array(encoded.ids, "<u4")
            at = np.flatnonzero(self.mark[ids])
            total = np.cumsum(counts[group])
            if len(at) != total[-1]:
                single += group
                continue
            ends = (4 * (at[total - 1] + 1 if self.words else np.append(at[1:], len(ids)))).tolist()
            data = ids.tobytes()
            for i, begin, end in zip(group, [0, *ends], ends):
                out[i] = data[begin:end]
        for i, data in zip(single, self.alone([chunks[i] for i in single])):
            out[i] = data
        return out


_encoders: dict[tuple[str, bool, int], ChunkCache] = {}


def forget_encoders() -> None:
    """Drops what library_cache() has made in this worker, for stages behind which others need its memory."""
    _encoders.clear()


def library_cache(path: str, words: bool, remembered: int = REMEMBERED) -> ChunkCache:
    """The library's encoder behind a chunk cache, kept from task to task by a worker."""
    key = path, words, remembered
    if key not in _encoders:
        encoder = LibraryEncoder(path, words)
        _encoders[key] = ChunkCache(encoder, BLANK_CUT if words else BYTE_BPE_CUT, "" if words else " ", fold=words, remembered=remembered)
    return _encoders[key]
