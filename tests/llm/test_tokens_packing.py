"""Token counts and packing against the tokenizers library."""

import random
import zlib

import numpy as np
import pytest
from cases import LONG, ODD_TEXTS, empty, odd, odd_rows, rows_of
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from glossloom.llm import packing, tokens
from glossloom.llm.pretokens import Coder, encoder

TOKENIZER = Tokenizer.from_file(tokens.VOCABULARY)
CODER = Coder(tokens.VOCABULARY, list)


def ids(text):
    return TOKENIZER.encode(text or "", add_special_tokens=False).ids


@settings(max_examples=400, deadline=None)
@given(st.text(st.one_of(st.sampled_from(" \n\t\r\x0b\x85\xa0 'ａsdtlmvre<|>0½²Ωéß日😀"), st.characters(exclude_categories=["Cs"])), max_size=40))
def test_stretches_give_the_ids_of_the_library(text):
    assert [i for v in CODER.values(text) for i in v] == ids(text)


@settings(max_examples=400, deadline=None)
@given(st.text(st.one_of(st.sampled_from(" \n\t\r\x0b\x85\xa0 'ａsdtlmvre<|>0½²Ωéß日😀"), st.characters(exclude_categories=["Cs"])), max_size=40))
def test_whole_texts_have_the_ids_of_the_library(text):
    assert encoder(tokens.VOCABULARY).ids(text) == ids(text)


def test_ids_of_awkward_texts():
    for _, text, *_ in [*ODD_TEXTS, (0, "ab" * 40_000), (0, " " * 20_000 + "x"), (0, "<|endoftext|>" * 3)]:
        assert [i for v in CODER.values(text or "") for i in v] == ids(text) == encoder(tokens.VOCABULARY).ids(text or "")


def test_token_counts(spark):
    got = rows_of(tokens.token_counts(odd(spark)))
    want = [(i, len((t or "").encode()), len(ids(t)), len(ids(t)) > 1024) for i, t, *_ in odd_rows()]
    assert sorted([(r["doc_id"], r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in got], key=repr) == sorted(want, key=repr)
    assert tokens.token_counts(empty(spark)).count() == 0


def test_counts_do_not_depend_on_the_frequent_table(spark):
    docs = odd(spark)
    one = tokens.token_counts(docs, entries=1).select("doc_id", "n_tokens")
    assert sorted(map(tuple, one.collect()), key=repr) == sorted(map(tuple, tokens.token_counts(docs).select("doc_id", "n_tokens").collect()), key=repr)


def check_packed(rows, texts, capacity):
    """Every document's ids are there once, pieces are cut as they should be and sequences have no gap."""
    by_doc = {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
    assert set(by_doc) == {i for i, _ in texts}
    for i, text in texts:
        whole = [*ids(text), 2]
        copies = sum(j == i for j, _ in texts)
        pieces = sorted(by_doc[i], key=lambda r: (r["piece"], r["sequence_id"]))
        starts = sorted({(r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in pieces})
        assert len(pieces) == copies * len(starts)
        at = 0
        for k, (piece, start, length, crc) in enumerate(starts):
            assert (piece, start) == (k, at) and crc == zlib.crc32(np.array(whole[start : start + length], "<u4").tobytes())
            assert length <= capacity and (len(whole) <= capacity or k == 0 or length == capacity)
            at += length
        assert at == len(whole)
    sequences = {}
    for r in rows:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in sequences.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= capacity
    return len(sequences)


@pytest.mark.parametrize("capacity", [7, 64, 1024])
def test_packing(spark, capacity):
    docs = odd(spark)
    texts = [(i, t) for i, t, *_ in odd_rows()]
    n = check_packed(rows_of(packing.pack_documents(docs, capacity=capacity)), texts, capacity)
    assert n * capacity < 1.15 * sum(len(ids(t)) + 1 for _, t in texts) + 2 * capacity
    assert packing.pack_documents(empty(spark)).count() == 0


def test_plan_equals_best_fit_over_documents():
    rng = random.Random(4)
    for _ in range(40):
        capacity = rng.choice([10, 32, 100])
        lengths = [min(capacity, max(1, int(rng.expovariate(4 / capacity)))) for _ in range(rng.randint(0, 400))]
        free = []
        for x in sorted(lengths, reverse=True):
            fits = [i for i, f in enumerate(free) if f >= x]
            if fits:
                free[min(fits, key=lambda i: free[i])] -= x
            else:
                free.append(capacity - x)
        histogram = {x: lengths.count(x) for x in set(lengths)}
        runs = packing.plan(histogram, capacity)
        slots = {x: 0 for x in histogram}
        used = {}
        for length, first, n, sequence, each, offset in runs:
            assert slots[length] == first
            slots[length] += n
            for r in range(n):
                used.setdefault(sequence + r // each, []).append((offset + r % each * length, length))
        assert slots == histogram
        assert len(used) == len(free)
        for parts in used.values():
            end = 0
            for offset, length in sorted(parts):
                assert offset == end
                end += length
            assert end <= capacity


def test_long_text_is_not_cut_short(spark):
    rows = rows_of(packing.pack_documents(spark.createDataFrame([(1, LONG)], "doc_id long, text string")))
    assert sum(r["length"] for r in rows) == len(ids(LONG)) + 1
