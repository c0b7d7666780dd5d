"""Operators 1, 5 and 10 against the library, one text at a time."""

import struct
import zlib
from collections import defaultdict
from io import BytesIO

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from heptagrid.llm import crc32c as crc
from heptagrid.llm import packing, token_counts, token_records
from heptagrid.llm.common import fresh_path, table
from heptagrid.llm.word_tokens import word_encoder

PATH = public_tokenizers.path("word_bpe_49k.json")
ODD = [
    (3, "It's <|endoftext|> don't stop"), (1, None), (2, ""), (2, "b"), (2, "a"), (2, "a"), (None, "null id"),
    (9, "İstanbul ΣΣ 你好 \x1c\x85 é"), (10, "word " * 9000), (11, " \n\t "),
]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def ids_of(library, text):
    return library.encode(text or "", add_special_tokens=False).ids


def odd(spark):
    extra = F.lit("x")
    return spark.createDataFrame(ODD, "doc_id long, text string").withColumns({n: extra for n in ("id", "file", "content", "length", "n_tokens", "__text")})


@settings(max_examples=200, deadline=None)
@given(st.text(st.characters(max_codepoint=0x17F) | st.characters(codec="utf-8"), max_size=60))
def test_word_encoder_is_the_library(text):
    encoder = word_encoder(PATH)
    want = encoder.library.encode(text, add_special_tokens=False).ids
    assert encoder.ids(text) == struct.pack(f"<{len(want)}I", *want)


def test_crc32c():
    rng = np.random.default_rng(0)
    parts = [rng.bytes(n) for n in (0, 1, 3, 4, 63, 64, 65, 128, 129, 1000, 12345)]
    assert crc.crc32c([b"123456789"])[0] == 0xE3069283
    assert crc.crc32c(parts).tolist() == [crc._one(p) for p in parts]


def test_damage_is_noticed():
    data = b"".join(token_records.frames([b"abcdef", b"", b"x" * 500]))
    assert [len(x) for x in token_records.read_frames(BytesIO(data))] == [6, 0, 500]
    for at in (0, 9, 14, len(data) - 1):
        bad = bytearray(data)
        bad[at] ^= 1
        with pytest.raises(ValueError):
            list(token_records.read_frames(BytesIO(bytes(bad))))
    with pytest.raises(ValueError):
        list(token_records.read_frames(BytesIO(data[:-1])))


def records_wanted(library, rows):
    out, start = [], 0
    for doc, text in sorted(rows, key=lambda r: (r[0] is not None, r[0], r[1] or "")):
        ids = ids_of(library, text) + [2]
        out.append((doc, start, len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))))
        start += len(ids)
    return out


def test_op1(spark, sf, library):
    rows = [(r.doc_id, r.text) for r in table(spark, sf, "documents").collect()]
    got = [tuple(r) for r in token_records.op1_token_records(spark, sf).collect()]
    assert sorted(got) == records_wanted(library, rows)


def test_op1_odd_rows(spark, library):
    folder = fresh_path(spark, "t")
    index = token_records.write_records(odd(spark), folder, PATH)
    back = token_records.read_records(spark, folder, index)
    got = [(r.id, r.start, r.n_tokens, zlib.crc32(struct.pack(f"<{len(r.value)}I", *r.value))) for r in back.orderBy("start").collect()]
    assert got == records_wanted(library, ODD)
    by_offset = token_records.shuffled_read(folder, index.orderBy(F.rand(1))).collect()
    assert sorted((str(r.id), r.ids) for r in by_offset) == sorted((str(d), ids_of(library, t) + [2]) for d, t in ODD)


def test_op1_empty(spark):
    folder = fresh_path(spark, "t")
    index = token_records.write_records(odd(spark).limit(0), folder, PATH)
    assert token_records.read_records(spark, folder, index).count() == 0


def test_op5(spark, sf, library):
    got = {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in token_counts.op5_token_counts(spark, sf).collect()}
    want = {}
    for r in table(spark, sf, "documents").collect():
        n = len(ids_of(library, r.text))
        want[r.doc_id] = (len(r.text.encode()), n, n > 2048)
    assert got == want


def test_op5_cache_and_odd_rows(spark, library):
    cache = fresh_path(spark, "t")
    docs = odd(spark)
    for _ in range(2):
        got = sorted((str(r.doc_id), r.n_bytes, r.n_tokens) for r in token_counts.token_counts(docs, cache, PATH).collect())
        assert got == sorted((str(d), len((t or "").encode()), len(ids_of(library, t))) for d, t in ODD)
    stored = spark.read.parquet(cache)
    assert stored.count() == stored.select("content").distinct().count() == len({" ".join((t or "").split(" ")).strip(" \n\t") for _, t in ODD})
    assert token_counts.token_counts(docs.limit(0), cache, PATH).count() == 0


def test_op5_hot_content_and_other_tokenizers(spark, monkeypatch):
    from heptagrid.llm import common

    monkeypatch.setattr(common, "HOT_ROWS", 3)
    monkeypatch.setattr(token_counts, "SENT", 1)
    cache = fresh_path(spark, "t")
    docs = spark.createDataFrame([(k, "the same") for k in range(50)] + [(99, "another one")], "doc_id long, text string")
    a = token_counts.token_counts(docs, cache, PATH).collect()
    b = token_counts.token_counts(docs, cache, public_tokenizers.path("piece_bpe_32k.model")).collect()
    assert len(a) == len(b) == 51 and {r.n_tokens for r in a if r.doc_id < 50} == {2}
    assert spark.read.parquet(cache).groupBy("tokenizer").count().count() == 2 and spark.read.parquet(cache).count() == 4


def test_op5_sentencepiece(spark):
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    got = sorted((str(r.doc_id), r.n_tokens) for r in token_counts.token_counts(odd(spark), fresh_path(spark, "t"), path).collect())
    assert got == sorted((str(d), len(model.encode(t or ""))) for d, t in ODD)


def packing_is_sound(got, rows, library, capacity=4096):
    want = []
    for doc, text in rows:
        ids = ids_of(library, text) + [1]
        for k in range(0, len(ids), capacity):
            part = ids[k : k + capacity]
            want.append((str(doc), k // capacity, k, len(part), zlib.crc32(struct.pack(f"<{len(part)}I", *part))))
    assert sorted((str(r[0]), *r[1:5]) for r in got) == sorted(want)
    bins = defaultdict(list)
    for r in got:
        bins[r.sequence_id].append((r.offset, r.length))
    for items in bins.values():
        at = 0
        for offset, length in sorted(items):
            assert offset == at
            at += length
        assert at <= capacity
    return len(bins), -(-sum(w[3] for w in want) // capacity)


def test_op10(spark, sf, library):
    rows = [(r.doc_id, r.text) for r in table(spark, sf, "documents").collect()]
    n, least = packing_is_sound(packing.op10_packing(spark, sf).collect(), rows, library)
    assert n <= least + 1


def test_op10_odd_rows(spark, library):
    packing_is_sound(packing.pack(odd(spark), PATH, capacity=16).collect(), ODD, library, 16)
    assert packing.pack(odd(spark).limit(0), PATH).count() == 0


@settings(max_examples=100, deadline=None)
@given(st.dictionaries(st.integers(1, 50), st.integers(1, 40), min_size=1, max_size=30))
def test_plan_uses_every_piece_once(counts):
    slots, n = packing.plan(counts, 50)
    fill, used = np.zeros(n, int), defaultdict(list)
    for length, first, ranks, sequence, uses, _ in slots:
        used[length].append((first, ranks))
        fill[sequence : sequence + ranks // uses] += length * uses
    assert fill.max() <= 50 and fill.min() > 0
    for length, spans in used.items():
        at = 0
        for first, ranks in sorted(spans):
            assert first == at
            at += ranks
        assert at == counts[length]


def test_best_two_by_hand():
    assert packing._best_two(np.array([2, 3, 5]), np.array([1, 1, 1]), 9, 5) == (5, 3)
    assert packing._best_two(np.array([4]), np.array([1]), 9, 1) is None
    assert packing._best_two(np.array([4]), np.array([2]), 9, 1) == (4, 4)


def plain_best_two_fit(lengths, capacity):
    """Bins of single pieces, as the method says: greedily the longest that fits, then two for the smallest while that helps."""
    left, bins = sorted(lengths, reverse=True), []
    while left:
        bin_ = []
        for n in list(left):
            if sum(bin_) + n <= capacity:
                bin_.append(n)
                left.remove(n)
        while len(bin_) > 1 and sum(bin_) < capacity:
            smallest = min(bin_)
            gap = capacity - sum(bin_) + smallest
            two = max(((a + b, a, b) for i, a in enumerate(left) for b in left[i + 1 :] if a + b <= gap), default=(0,))
            if two[0] <= smallest:
                break
            bin_.remove(smallest)
            left.append(smallest)
            for n in two[1:]:
                left.remove(n)
                bin_.append(n)
            left.sort(reverse=True)
        bins.append(sorted(bin_))
    return bins


@pytest.mark.parametrize("seed", range(12))
def test_plan_is_best_two_fit(seed):
    """Bin after bin the same total as the plain method's first bins, until a pattern is used again; and no more bins."""
    rng = np.random.default_rng(seed)
    capacity = int(rng.integers(12, 60))
    lengths = rng.integers(1, capacity + 1, int(rng.integers(1, 60))).tolist()
    counts = {n: lengths.count(n) for n in set(lengths)}
    slots, sequences = packing.plan(counts, capacity)
    bins = defaultdict(list)
    for n, first, ranks, sequence, uses, _ in slots:
        for k in range(ranks):
            bins[sequence + k // uses].append(n)
    got, want = [sorted(bins[k]) for k in range(sequences)], plain_best_two_fit(lengths, capacity)
    assert sorted(n for b in got for n in b) == sorted(lengths) and all(sum(b) <= capacity for b in got)
    assert sum(got[0]) == sum(want[0]) and len(got) <= len(want) + 1
    if len(set(lengths)) == len(lengths):
        assert [sum(b) for b in got] == [sum(b) for b in want]


def test_plan_replaces_the_smallest_by_two():
    for lengths in ([60, 30, 7, 6, 33], [50, 40, 5, 8, 2, 45], [9, 5, 4, 3, 2], [70, 20, 12, 17, 1]):
        slots, sequences = packing.plan({n: 1 for n in lengths}, 100 if max(lengths) > 9 else 14)
        bins = defaultdict(list)
        for n, _, _, sequence, _, _ in slots:
            bins[sequence].append(n)
        assert [sorted(bins[k]) for k in range(sequences)] == plain_best_two_fit(lengths, 100 if max(lengths) > 9 else 14)
