import time
import tracemalloc
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from frames import clashing, frame, hard_rows, twins
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from opswell import session
from opswell.llm import token_blocks, tokens

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def plain():
    t = Tokenizer.from_file(PATH)
    return lambda text: t.encode(text or "", add_special_tokens=False).ids


@pytest.mark.parametrize("slab", [100, 5000, tokens.SLAB])
def test_ids_equal_the_library(plain, slab, monkeypatch):
    monkeypatch.setattr(tokens, "slabs", lambda texts, most=slab, f=tokens.slabs: f(texts, most))
    texts = [r[1] for r in hard_rows()] + ["('s", "a', b'", "'tis", "((', x", "ß ẞ ÀÉ × ÷ İ", "12a'll 3.14", "é"]
    ids, counts = tokens.Encoder(PATH).encode(pa.array(texts, pa.string()))
    want = [plain(t) for t in texts]
    assert counts.tolist() == [len(w) for w in want]
    assert ids.tolist() == [i for w in want for i in w]


def test_forgetting_changes_nothing(plain, monkeypatch):
    monkeypatch.setattr(tokens, "REMEMBERED", 500)
    e, texts = tokens.Encoder(PATH), [r[1] for r in hard_rows()]
    for _ in range(2):
        for t in texts:
            assert e.encode(pa.array([t], pa.string()))[0].tolist() == plain(t)


def test_remembered_words_cost_a_later_text_nothing():
    def seconds(e):
        def once():
            began = time.process_time()
            e.encode(pa.array(["one Two, three! 4 x5 seven"] * 3))
            return time.process_time() - began

        return min(once() for _ in range(20))

    few, many = tokens.Encoder(PATH), tokens.Encoder(PATH)
    letters = "abcdefghijklmnop"
    many.encode(pa.array([" ".join(f"{a}{b}{c}{d}" for b in letters for c in letters for d in letters) for a in (x + y for x in letters for y in letters[:4])]))
    assert seconds(many) < 8 * seconds(few)


def test_words_that_polynomials_confuse(plain):
    e = tokens.Encoder(PATH)
    for power in range(8, 15):
        for word in twins(power):
            assert e.encode(pa.array([f"x {word} y"]))[0].tolist() == plain(f"x {word} y")


@pytest.mark.parametrize("values", [[], [7], [0] * 1024, list(range(3000)), [2**32 - 1, 0] * 600, [5] * 1500 + [49_000] * 20])
@pytest.mark.parametrize("percentile", [1, 50, 90, 100])
def test_blocks_come_back(values, percentile):
    ids = np.array(values, np.uint32)
    starts, blocks = token_blocks.encode_blocks(ids, percentile)
    back = token_blocks.decode_blocks(starts, np.frombuffer(blocks, np.uint8), len(ids))
    assert (back == ids).all() and len(back) == len(ids)


def test_groups_of_blocks_make_the_same_bytes(monkeypatch):
    ids = np.random.default_rng(5).integers(0, 49_000, 7 * token_blocks.BLOCK + 3).astype(np.uint32)
    starts, blocks = token_blocks.encode_blocks(ids)
    monkeypatch.setattr(token_blocks, "AT_ONCE", 2)
    few_starts, few = token_blocks.encode_blocks(ids)
    assert few == blocks and (few_starts == starts).all()
    assert (token_blocks.decode_blocks(starts, np.frombuffer(blocks, np.uint8), len(ids)) == ids).all()


def test_packing_a_file_takes_little_beside_it():
    ids = np.random.default_rng(5).integers(0, 49_000, 2 << 20).astype(np.uint32)
    tracemalloc.start()
    try:
        token_blocks.encode_blocks(ids)
        assert tracemalloc.get_traced_memory()[1] < 4 * ids.nbytes
    finally:
        tracemalloc.stop()


def test_random_blocks_come_back_and_outliers_are_patched():
    r = np.random.default_rng(3)
    for width in range(33):
        ids = r.integers(0, 2**width, 2500, dtype=np.uint64).astype(np.uint32)
        starts, blocks = token_blocks.encode_blocks(ids)
        assert (token_blocks.decode_blocks(starts, np.frombuffer(blocks, np.uint8), len(ids)) == ids).all()
    few = np.where(r.random(1024) < 0.05, 40_000, 3).astype(np.uint32)
    head = np.frombuffer(token_blocks.encode_blocks(few)[1][:8], token_blocks.BLOCK_HEAD)[0]
    assert head["width"] == 0 and head["more"] == (few > 3).sum()


@pytest.mark.parametrize("per_file", [50, token_blocks.TOKENS_PER_FILE])
def test_files_hold_all_documents_in_order(spark, plain, per_file, monkeypatch):
    monkeypatch.setattr(token_blocks, "TOKENS_PER_FILE", per_file)
    path = session.scratch(spark, "blocks")
    docs = clashing(frame(spark, hard_rows()))
    token_blocks.write(docs, path, PATH)
    read = token_blocks.read(spark, path).withColumn("n_tokens", F.expr("octet_length(ids) div 4").cast("long"))
    rows = sorted(token_blocks.starts(read).collect(), key=lambda r: r.start)
    at = 0
    for r in rows:
        assert r.start == at
        at += r.n_tokens
    keys = [(r.doc_id is not None, r.doc_id or 0) for r in rows]
    assert keys == sorted(keys)
    want = sorted(((r[0] is not None, r[0] or 0), np.array([*plain(r[1]), 2], "<u4").tobytes()) for r in hard_rows())
    assert sorted(zip(keys, (bytes(r.ids) for r in rows))) == want
    assert all(zlib.crc32(r.ids) >= 0 for r in rows)


def test_no_documents(spark):
    path = session.scratch(spark, "blocks")
    token_blocks.write(frame(spark, []), path, PATH)
    assert token_blocks.read(spark, path).count() == 0


def test_query_over_the_whole_table(spark, tables, plain):
    from opswell.llm.queries import QUERIES

    rows = QUERIES["op1_token_blocks"](spark, tables.folder).orderBy("doc_id").collect()
    docs = tables.documents.orderBy("doc_id").collect()
    assert len(rows) == len(docs)
    at = 0
    for r, d in zip(rows, docs):
        ids = [*plain(d.text), 2]
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (d.doc_id, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
