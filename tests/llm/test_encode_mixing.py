import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from termforge.llm import encode as e
from termforge.llm import mixing as m

PARTS = ["a", "b", "'", "s", "ll", " ", "  ", "\n", "\t", "1", "23", ".", "!?", "é", "漢", "ー", "。", " ", "'s", "n't", "😀", "́", "²", "z" * 40, "<|endoftext|>"]


@pytest.fixture(scope="module")
def encoder():
    return e._encoder(f"{e.tokenizer_folder()}/byte_bpe_50k.tiktoken")


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(PARTS), max_size=40).map("".join), st.integers(1, 9), st.sampled_from([1, 3, 8]))
def test_tree_is_whole(encoder, text, leaf, window):
    whole = encoder(text) if text else np.empty(0, np.uint32)
    assert np.array_equal(e.encode_text(text, encoder, leaf, window), whole)


@settings(max_examples=100, deadline=None)
@given(st.text(max_size=60), st.integers(1, 7))
def test_round_trip(encoder, text, leaf):
    path = f"{e.tokenizer_folder()}/byte_bpe_50k.tiktoken"
    assert e.decode_bytes(e.encode_text(text, encoder, leaf), path, leaf) == text.encode()


def test_ids_against_the_other_library(spark, data):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(f"{e.tokenizer_folder()}/byte_bpe_50k.json")
    t.encode_special_tokens = True
    docs = spark.read.parquet(f"{data}/documents.parquet").where("text IS NOT NULL")
    got = {r.doc_id: r.ids for r in e.token_ids(docs, "doc_id", "text", leaf=300).collect()}
    texts = docs.select("doc_id", "text").collect()
    assert got == {r.doc_id: x.ids for r, x in zip(texts, t.encode_batch([r.text for r in texts], add_special_tokens=False))}


def test_defined_cases(spark, encoder):
    long = "x" * 3000 + " word" * 20000
    df = spark.createDataFrame([(1, None, "c"), (2, "", "c"), (3, "<|endoftext|>", "c"), (3, "<|endoftext|>", "c"), (4, long, "c")], "doc_id long, text string, ids string")
    rows = sorted((r.doc_id, r.ids) for r in e.token_ids(df, "doc_id", "text").collect())
    assert rows[0] == (1, []) and rows[1] == (2, []) and rows[2] == rows[3] and len(rows[2][1]) > 1 and rows[4][1] == encoder(long).tolist()
    assert e.token_ids(df.limit(0), "doc_id", "text").count() == 0
    assert sorted(r.tokens for r in e.with_token_count(df, ["doc_id"], "text").collect())[:2] == [0, 0]


@settings(max_examples=300, deadline=None)
@given(st.dictionaries(st.integers(1, 30), st.integers(1, 6), max_size=8), st.integers(0, 300), st.sampled_from([5, 16384]))
def test_fill(counts, budget, reach):
    lengths, have = list(counts), list(counts.values())
    take = m.fill(lengths, have, budget, reach)
    assert all(0 <= t <= c for t, c in zip(take, have))
    total = sum(n * t for n, t in zip(lengths, take))
    assert total <= budget
    sums = {0}
    for n, c in counts.items():
        sums = {s + n * k for s in sums for k in range(c + 1)}
    if reach > 5:
        assert total == max(s for s in sums if s <= budget)


def test_fill_finds_exact_sums():
    assert sum(n * t for n, t in zip([7, 11, 3], m.fill([7, 11, 3], [5, 5, 5], 61))) == 61


@settings(max_examples=100, deadline=None)
@given(st.dictionaries(st.integers(1, 3000), st.integers(1, 3), min_size=300, max_size=600), st.floats(0.05, 0.95))
def test_fill_is_in_proportion(counts, share):
    lengths, have, reach = list(counts), list(counts.values()), 3000
    total = sum(n * c for n, c in counts.items())
    budget = int(share * total)
    take = m.fill(lengths, have, budget, reach)
    bulk = max(0, budget - reach // 2) / total
    rows = sorted(zip(lengths, have, take))
    for at in range(0, len(rows), 50):  # all lengths give their share; only the last texts may come from anywhere
        part = rows[at : at + 50]
        least = sum(c for _, c, _ in part) * bulk
        assert least - 1 < sum(t for _, _, t in part)
    assert sum(t for _, _, t in rows) * 1.0 >= bulk * sum(have) - 1
    assert budget - sum(n * t for n, _, t in rows) <= max(lengths)


TARGETS = "source string, weight double, max_repeats int"


def test_mix(spark):
    rows = [(i, "big", 10 + i % 7) for i in range(600)] + [(1000 + i, "small", 5 + i % 3) for i in range(40)] + [(2000 + i, "same", 8) for i in range(300)]
    sized = spark.createDataFrame(rows, "doc_id long, source string, tokens long")
    targets = spark.createDataFrame([("big", 0.5, 1), ("small", 0.2, 3), ("same", 0.3, 2), ("absent", 0.1, 2), (None, 0.1, 1), ("off", None, 1)], TARGETS)
    mixed, plans = m.mix(sized, targets, slices=4)
    out = mixed.collect()
    caps = {"big": 1, "small": 3, "same": 2}
    assert all(1 <= r.copies <= caps[r.source] for r in out) and len({r.doc_id for r in out}) == len(out)
    given = {r.source: r for r in m.shares(mixed, plans).collect()}
    for s, w in (("big", 0.5), ("small", 0.2), ("same", 0.3)):
        assert abs(given[s].tokens - given[s].budget_tokens) <= 8 and abs(given[s].share - w) < 0.02
    assert given["absent"].tokens == 0
    assert sorted(mixed.collect()) == sorted(m.mix(sized, targets, slices=4)[0].collect())
    assert m.mix(sized.limit(0), targets)[0].count() == 0


def test_whole_documents_only(spark):
    docs = spark.createDataFrame([(1, "a b c", "s"), (2, None, "s"), (3, "", "s"), (4, "x", "other")], "doc_id long, text string, source string")
    targets = spark.createDataFrame([("s", 1.0, 2)], TARGETS)
    sized = m.sized_documents(docs, targets)
    assert [(r.doc_id, r.tokens) for r in sized.collect()] == [(1, 3)]
    assert [r.copies for r in m.mix(sized, targets)[0].collect()] == [2]
