import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from trailmill.llm import bpe_codec
from trailmill.plans.shared_store import Store

PATH = public_tokenizers.path(bpe_codec.VOCABULARY)
ODD = ["a", "the", "ing", " ", "  ", "\n", "\t", " ", "　", " ", "\x0b", "\x1c", "\x85", "'s", "'", "1", "23", "é", "漢", "かな", "😀", "<|endoftext|>", "<|endof", "!!", "Ω", "я", "x" * 50, "ab" * 30, "\r\n"]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def whole(coder, texts):
    parts = coder.encode([t.encode() for t in texts])
    return [np.concatenate([x if x is not None else coder.joined([coder.leaf_ids(leaf) for leaf in leaves]) for x, leaves in p]).tolist() for p in parts]


@pytest.mark.parametrize(("unsplit", "leaf"), [(bpe_codec.UNSPLIT, bpe_codec.LEAF), (24, 16), (8, 7)])
def test_ids_are_the_librarys(library, unsplit, leaf):
    rng = random.Random(3)
    texts = ["", " ", "a" * 5000, "日本語" * 900, "0123456789" * 300, "q <|endoftext|>" + "z" * 999]
    texts += ["".join(rng.choice(ODD) for _ in range(rng.randint(1, 150))) for _ in range(300)]
    coder = bpe_codec.Codec(PATH, remembered=300, unsplit=unsplit, leaf=leaf)
    for k in range(0, len(texts), 61):
        assert whole(coder, texts[k : k + 61]) == [library.encode(t, add_special_tokens=False).ids for t in texts[k : k + 61]]


_SMALL = bpe_codec.Codec(PATH, unsplit=6, leaf=5)
_LIBRARY = Tokenizer.from_file(PATH)


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=60))
def test_any_text_comes_back(text):
    (ids,) = whole(_SMALL, [text])
    assert ids == _LIBRARY.encode(text, add_special_tokens=False).ids
    assert _SMALL.decode(np.array(ids, np.uint32)).decode() == _LIBRARY.decode(ids, skip_special_tokens=False) == text


def test_join_grows_until_both_sides_agree():
    run = b"abab" * 300 + b"xyz" * 50
    for at in (1, 2, 3, 599, 1201):
        joined = _SMALL.join(_SMALL.leaf_ids(run[:at]), _SMALL.leaf_ids(run[at:]))
        assert joined.tolist() == _SMALL.leaf_ids(run).tolist()


def test_bytes_that_are_no_text():
    ids = np.array(_LIBRARY.encode("é漢", add_special_tokens=False).ids, np.uint32)
    for cut in range(len(ids) + 1):
        assert _SMALL.decode(ids[:cut]).decode() == _LIBRARY.decode(ids[:cut].tolist(), skip_special_tokens=False)


@pytest.mark.parametrize(("unsplit", "leaf"), [(bpe_codec.UNSPLIT, bpe_codec.LEAF), (12, 10)])
def test_rows(spark, docs, texts, library, unsplit, leaf):
    """Null, empty, very long, unsplit and repeated texts, and columns with the operator's own names."""
    from pyspark.sql import functions as F

    more = docs.unionAll(docs.limit(1).withColumns({"doc_id": F.lit(None).cast("long"), "text": F.lit("ü" * 4000)})).withColumn("payload", F.lit(1))
    got = {r["doc_id"]: r for r in bpe_codec.coded(more, PATH, Store(spark, "t"), with_ids=True, unsplit=unsplit, leaf=leaf).collect()}
    assert len(got) == len(texts) + 1
    for i, t in [*enumerate(texts), (None, "ü" * 4000)]:
        ids = library.encode(t or "", add_special_tokens=False).ids
        assert got[i]["ids"] == ids and got[i]["n_tokens"] == len(ids) and got[i]["decoded"] == (t or "")
        assert got[i]["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert got[i]["decoded_sha256"] == hashlib.sha256((t or "").encode()).hexdigest()


def test_empty_table(spark, empty):
    assert bpe_codec.coded(empty, PATH, Store(spark, "t")).count() == 0
