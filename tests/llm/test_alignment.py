"""Alignment of two tokenizers against a plain version on whole texts."""

import hashlib
from collections import Counter, defaultdict

import pytest
from cases import ODD_TEXTS, empty, odd, odd_rows, rows_of
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from glossloom.llm import alignment
from glossloom.llm.common import table
from glossloom.llm.tokens import VOCABULARY

ALIGNER = alignment.Aligner(VOCABULARY, alignment.PIECES)
TOKENIZER = Tokenizer.from_file(VOCABULARY)
TOKENIZER.encode_special_tokens = True
BYTE = {c: b for b, c in __import__("glossloom.llm.pretokens", fromlist=["_byte_letters"])._byte_letters().items()}


def plain(text):
    """(n_a, n_b, groups, links) or None."""
    if not text:
        return None
    a, b = TOKENIZER.encode(" " + text, add_special_tokens=False), ALIGNER.b.encode(text)
    left = [bytes(BYTE[c] for c in t) for t in a.tokens]
    right = [bytes([int(p[3:5], 16)]) if ALIGNER.b.is_byte(i) else p.replace("▁", " ").encode() for i in b for p in [ALIGNER.b.id_to_piece(i)]]
    whole = (" " + text).encode()
    if b"".join(left) != whole or b"".join(right) != whole:
        return None
    ends_a, ends_b = [], []
    for ends, parts in ((ends_a, left), (ends_b, right)):
        for x in parts:
            ends.append((ends[-1] if ends else 0) + len(x))
    common, groups, links, i, j = set(ends_a) & set(ends_b), [], Counter(), 0, 0
    for c in sorted(common):
        to_i, to_j = i, j
        while to_i < len(left) and ends_a[to_i] <= c:
            to_i += 1
        while to_j < len(right) and ends_b[to_j] <= c:
            to_j += 1
        x, y = a.ids[i:to_i], b[j:to_j]
        groups.append(",".join(map(str, x)) + "|" + ",".join(map(str, y)))
        for u, nu in Counter(x).items():
            for v, nv in Counter(y).items():
                links[u, v] += nu * nv
        i, j = to_i, to_j
    return len(a.ids), len(b), groups, links


@settings(max_examples=300, deadline=None)
@given(st.text(st.one_of(st.sampled_from(" \n\t\r\x0b\x85\xa0 'ａsdtlmvre<|>0½²Ωéß日😀▁\0"), st.characters(exclude_categories=["Cs"])), min_size=1, max_size=40))
def test_one_text(text):
    got, want = ALIGNER.align(text), plain(text)
    assert (got is None) == (want is None)
    if got:
        n_a, n_b, n_groups, n_links, groups, p, n = got
        assert (n_a, n_b, groups.split(";")) == want[:3] and n_groups == len(want[2]) and n_links == sum(want[3].values())
        assert {(x >> 15, x & 32767): k for x, k in zip(p.tolist(), n.tolist())} == dict(want[3])


def check(spark, docs, **how):
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    found = {t: plain(t) for _, t in rows}
    counts = Counter(p for _, t in rows if found[t] for p in found[t][3])
    highest = defaultdict(int)
    for (a, _), n in counts.items():
        highest[a] = max(highest[a], n)
    want = []
    for i, t in rows:
        if found[t] is None:
            want.append((i, 0, 0, 0, 0, 0, 0, ""))
            continue
        n_a, n_b, groups, links = found[t]
        best = sum(n for p, n in links.items() if counts[p] == highest[p[0]])
        want.append((i, n_a, n_b, len(groups), sum(links.values()), best, sum(n * counts[p] for p, n in links.items()), hashlib.sha256(";".join(groups).encode()).hexdigest()))
    names = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
    got = [tuple(r[n] for n in names) for r in rows_of(alignment.align_tokenizers(docs, **how))]
    assert sorted(got, key=repr) == sorted(want, key=repr)


@pytest.mark.parametrize("entries", [alignment.FREQUENT, 40, 0])
def test_awkward_rows_at_any_size_of_the_broadcast(spark, entries):
    check(spark, odd(spark), entries=entries)


def test_given_documents_with_copies(spark):
    docs = table(spark, "/root/testdata/sf0.001", "documents").select("doc_id", "text").limit(60)
    check(spark, docs.unionByName(docs.limit(10)), entries=2_000)


def test_empty_table_and_large_groups(spark):
    assert alignment.align_tokenizers(empty(spark)).count() == 0
    got, want = ALIGNER.align("日本語" * 50 + " é́" * 20), plain("日本語" * 50 + " é́" * 20)
    assert got[3] == sum(want[3].values())
    assert len(odd_rows()) > len(ODD_TEXTS)
