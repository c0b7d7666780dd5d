"""The sentencepiece model against tiktoken."""

import hashlib

import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from heptagrid.llm import byte_bpe as b
from heptagrid.llm.common import table

PATH, PATTERN = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


@pytest.fixture(scope="module")
def library():
    ranks = {t: k for k, t in enumerate(b.read_ranks(PATH))}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_every_character(library):
    own = b.byte_bpe(PATH, PATTERN)
    points = [*range(0xD800), *range(0xE000, 0x30000), *range(0xE0000, 0xE0200)]
    for at in range(0, len(points), 64):
        text = "".join(f"a{chr(c)}1 {chr(c)}{chr(c)} " for c in points[at : at + 64])
        assert own.encode(text).tolist() == library.encode_ordinary(text)


@settings(max_examples=300, deadline=None)
@given(st.text(st.characters(codec="utf-8") | st.sampled_from("abe 's\n\t019.,"), max_size=80))
def test_round_trip(text):
    own = b.byte_bpe(PATH, PATTERN)
    ranks = {t: k for k, t in enumerate(own.tokens)}
    global _library
    try:
        _library
    except NameError:
        _library = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    ids = own.encode(text).tolist()
    assert ids == _library.encode_ordinary(text)
    assert own.decode(ids) == text.encode()


def test_op2(spark, sf, library):
    got = {r.doc_id: tuple(r)[1:] for r in b.op2_byte_bpe(spark, sf).collect()}
    for r in table(spark, sf, "documents").collect():
        ids = library.encode_ordinary(r.text)
        sha = lambda x: hashlib.sha256(x).hexdigest()
        assert got[r.doc_id] == (len(ids), sha(",".join(map(str, ids)).encode()), sha(r.text.encode()))


def test_odd_rows(spark, library):
    rows = [(1, None), (2, ""), (2, "x"), (2, "x"), (None, "é 你好 \U0001f600"), (4, "aaaa" * 30000), (5, " " * 5000 + "\n")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({n: F.lit(1) for n in ("id", "ids", "decoded")})
    got = b.decode(b.encode(docs, PATH, PATTERN), PATH, PATTERN).collect()
    key = lambda x: (str(x[0]), x[1])
    assert sorted(((r.doc_id, list(r.ids), bytes(r.decoded)) for r in got), key=key) == sorted(
        ((d, library.encode_ordinary(t or ""), (t or "").encode()) for d, t in rows), key=key
    )
    assert b.encode(docs.limit(0), PATH, PATTERN).count() == 0
