import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from ledgerloom.llm import encode, packing

tokenizers = pytest.importorskip("tokenizers")


@pytest.fixture(scope="module")
def reference():
    t = tokenizers.Tokenizer.from_file(encode.VOCABULARY.replace(".tiktoken", ".json"))
    t.encode_special_tokens = True
    return t


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=200))
def test_ids_equal_an_independent_encoder(text):
    t = tokenizers.Tokenizer.from_file(encode.VOCABULARY.replace(".tiktoken", ".json")) if not hasattr(test_ids_equal_an_independent_encoder, "t") else test_ids_equal_an_independent_encoder.t
    t.encode_special_tokens = True
    test_ids_equal_an_independent_encoder.t = t
    assert encode.encoder(encode.VOCABULARY).encode(text) == t.encode(text, add_special_tokens=False).ids


def test_long_words_merge_alike():
    e = encode.encoder(encode.VOCABULARY)
    draw = random.Random(1)
    for n in (1, 2, 127, 129, 700):
        for alphabet in (b"ab", bytes(range(97, 123)), bytes(range(256))):
            w = bytes(draw.choice(alphabet) for _ in range(n))
            assert e.merge_short(w) == e.merge_long(w)


def test_every_document_has_ids(spark, reference):
    rows = [(1, "Claim <|endoftext|> paid."), (2, None), (3, ""), (4, "  \n "), (5, "क्या? 保険 " * 3000), (1, "Claim <|endoftext|> paid.")]
    frame = spark.createDataFrame([(*r, "x") for r in rows], "doc_id bigint, text string, ids string")
    got = {r.doc_id: r.ids for r in encode.token_ids(frame).collect()}
    assert got == {i: reference.encode(t or "", add_special_tokens=False).ids for i, t in rows}
    assert {r.doc_id: r.tokens for r in encode.token_counts(frame).collect()} == {i: len(x) for i, x in got.items()}


def test_empty_table(spark):
    frame = spark.createDataFrame([], "doc_id bigint, text string")
    assert encode.token_ids(frame).collect() == []
    assert packing.pack(encode.token_counts(frame), 10).collect() == []


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 100), max_size=80))
def test_a_shard_is_packed_whole_and_within_capacity(sizes):
    placed = packing.pack_shard([(i, 0, s) for i, s in enumerate(sizes)], 100, 8)
    assert sorted(d for d, *_ in placed) == list(range(len(sizes)))
    bins: dict[int, list[tuple[int, int]]] = {}
    for d, _, b, at in placed:
        bins.setdefault(b, []).append((at, at + sizes[d]))
    for spans in bins.values():
        spans = sorted(s for s in spans if s[1] > s[0])
        assert all(e <= 100 for _, e in spans) and all(a[1] <= b[0] for a, b in zip(spans, spans[1:]))


def test_only_what_exceeds_the_capacity_is_split(spark):
    sizes = spark.createDataFrame([(1, 250), (2, 100), (3, 60), (4, 40), (5, 0), (6, None), (3, 60)], "doc_id bigint, tokens bigint")
    rows = packing.pack(sizes, 100).collect()
    parts = {d: sorted(r.tokens for r in rows if r.doc_id == d) for d in range(1, 7)}
    assert parts == {1: [50, 100, 100], 2: [100], 3: [60], 4: [40], 5: [0], 6: [0]}
    used: dict[int, int] = {}
    for r in rows:
        used[r.container] = used.get(r.container, 0) + r.tokens
    assert max(used.values()) <= 100
    assert packing.fill_report(packing.pack(sizes, 100), 100).first().tokens == 450


def test_containers_of_whole_parts_have_numbers_of_their_own(spark):
    from ledgerloom.llm import packing

    sizes = spark.createDataFrame([(9_300_000_000_000, 50), (1, 30), (2, 35), (3, 0), (4, None), (2, 35)], "doc_id bigint, tokens bigint")
    rows = packing.pack(sizes, 10, per_shard=2).collect()
    whole = [r for r in rows if r.container < 0]
    assert len({r.container for r in whole}) == len(whole) == 4 + 2 + 3
    assert {r.doc_id: sum(x.tokens for x in rows if x.doc_id == r.doc_id) for r in rows} == {9_300_000_000_000: 50, 1: 30, 2: 35, 3: 0, 4: 0}
    assert len({(r.doc_id, r.part) for r in rows}) == len(rows)
