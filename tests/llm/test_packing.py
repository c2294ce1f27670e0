import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from corpusloom.llm import packing
from corpusloom.llm.queries import op7_packing

FILE = public_tokenizers.path("byte_bpe_50k.json")
WHOLE = Tokenizer.from_file(FILE)


def own_ids(text):
    return WHOLE.encode(text or "", add_special_tokens=False).ids + [2]


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.sampled_from(" \n\tab'sé漢😀1.,<|endoftext|>"), max_size=30) | st.text(max_size=30) | st.just("a <|endoftext|> b"))
def test_ids_equal_the_tokenizers(text):
    assert list(np.frombuffer(packing.token_encoder(FILE)(text), "<u4")) == own_ids(text)[:-1]


def check(rows, texts, capacity=1024):
    """Every text's ids once, pieces cut by rule, sequences gapless and within the capacity."""
    by_sequence, by_doc = defaultdict(list), defaultdict(list)
    for r in rows:
        by_sequence[r["sequence_id"]].append((r["offset"], r["length"]))
        by_doc[r["doc_id"]].append(r)
    for parts in by_sequence.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    assert set(by_doc) == set(texts)
    for doc, copies in texts.items():
        got = sorted((r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in by_doc[doc])
        want = []
        for text in copies:
            ids, at = own_ids(text), 0
            cuts = [(len(ids) - 1) % capacity + 1] + [capacity] * ((len(ids) - 1) // capacity)
            for k, n in enumerate(cuts):
                want.append((k, at, n, zlib.crc32(np.array(ids[at : at + n], "<u4").tobytes())))
                at += n
        assert got == sorted(want)
    return len(by_sequence)


def test_query_on_the_table(spark, sf_dir):
    texts = {r["doc_id"]: [r["text"]] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = op7_packing(spark, sf_dir).collect()
    least = -(-sum(r["length"] for r in rows) // 1024)
    assert check(rows, texts) <= 1.02 * least + 1


def test_odd_rows(odd_docs, no_docs):
    texts = defaultdict(list)
    for r in odd_docs.collect():
        texts[r["doc_id"]].append(r["text"])
    check(packing.hierarchical_pack(packing.token_pieces(odd_docs, FILE)).collect(), texts)
    assert packing.hierarchical_pack(packing.token_pieces(no_docs, FILE)).count() == 0


def test_many_rounds_stay_near_the_least(spark):
    pieces = spark.range(20_000).selectExpr("id AS doc_id", "1 + pmod(xxhash64(id), 1024) AS length")
    rows = packing.hierarchical_pack(pieces, local=5000, fan_in=3).collect()
    assert len({r["doc_id"] for r in rows}) == len(rows) == 20_000
    fills = defaultdict(int)
    for r in rows:
        fills[r["sequence_id"]] += r["length"]
    assert max(fills.values()) <= 1024
    assert len(fills) <= 1.01 * sum(fills.values()) / 1024


@pytest.mark.parametrize("sizes", ["700", "CASE WHEN id % 10 = 0 THEN 300 ELSE 513 + id % 400 END", "IF(id % 3 = 0, 700, 1 + pmod(xxhash64(id), 200))"])
def test_bins_over_half_full_do_not_pile_up_in_a_task(spark, sizes):
    pieces = spark.range(6000).selectExpr("id AS doc_id", f"CAST({sizes} AS long) AS length")
    rows = packing.hierarchical_pack(pieces, local=200, fan_in=3).collect()
    assert len({r["doc_id"] for r in rows}) == len(rows) == 6000
    fills, of_task = defaultdict(int), defaultdict(int)
    for r in rows:
        fills[r["sequence_id"]] += r["length"]
        of_task[r["sequence_id"] >> 32] += 1
    assert max(fills.values()) <= 1024 and max(of_task.values()) <= 2 * 200
    least = max(-(-sum(fills.values()) // 1024), sum(r["length"] > 512 for r in rows))
    assert len(fills) <= 1.03 * least


def test_too_long_pieces_are_refused(spark):
    with pytest.raises(ValueError):
        packing.hierarchical_pack(spark.sql("SELECT 2000L AS length"))


@settings(max_examples=50, deadline=None)
@given(st.lists(st.integers(1, 50), max_size=60))
def test_best_fit(sizes):
    bins = packing.best_fit(np.array(sizes, dtype=np.int64), 50)
    assert sorted(i for b in bins for i in b) == list(range(len(sizes)))
    fills = [sum(sizes[i] for i in b) for b in bins]
    assert all(f <= 50 for f in fills) and sum(2 * f <= 50 for f in fills) <= 1
