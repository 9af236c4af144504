"""Words of plain letters, which go to the library's model without its normalising, against the library itself."""

import random

import numpy as np
import public_tokenizers
import pytest

from strandwise.llm.common import PLAIN_LETTERS, LibraryEncoder, library_cache

LETTERS = [chr(c) for c in range(0x100) if PLAIN_LETTERS.fullmatch(chr(c))]


@pytest.mark.parametrize(("name", "words"), [("word_bpe_49k.json", True), ("byte_bpe_50k.json", False)])
def test_same_ids_as_the_library(name, words):
    encoder = LibraryEncoder(public_tokenizers.path(name), words)
    assert encoder.model is not None
    draw = random.Random(5)
    chunks = ["".join(draw.choices(LETTERS, k=draw.randint(1, 12))) for _ in range(3000)] + ["the", "A", "\u00df", "\u00c9t\u00c9", "\u0130x", "e\u0301", "\ufb01n", "it's", "x1", "a.", "", "a" * 300]
    chunks = chunks if words else [" " + c for c in chunks] + ["the", "  x"]
    plain = [np.array(e.ids, "<u4").tobytes() for e in encoder.tokenizer.encode_batch_fast(chunks, add_special_tokens=False)]
    assert encoder(chunks) == plain


@pytest.mark.parametrize(("name", "words"), [("word_bpe_49k.json", True), ("byte_bpe_50k.json", False)])
def test_few_remembered_chunks_give_the_same_ids(name, words):
    cache = library_cache(public_tokenizers.path(name), words, remembered=4)
    texts = ["The the, THE\tthe", "", "\u00c9tude \u00e9tude!? a\nb", "The the, THE\tthe", "x  y \n"] * 3
    whole = [np.array(e.ids, "<u4").tobytes() for e in cache.encode.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
    assert [cache([t])[0] for t in texts] == whole == cache(texts)
