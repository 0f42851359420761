"""Token files: the code, the ids and the round trip."""

from __future__ import annotations

import heapq
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tests.llm.tables import DOCS, doc, frame, odd_docs, words, write
from visitledger.llm import token_files
from visitledger.llm.queries import QUERIES

PATH = public_tokenizers.path("word_bpe_49k.json")


def _huffman_bits(counts):
    heap = list(counts)
    heapq.heapify(heap)
    bits = 0
    while len(heap) > 1:
        both = heapq.heappop(heap) + heapq.heappop(heap)
        bits += both
        heapq.heappush(heap, both)
    return bits


@given(st.lists(st.integers(1, 10**9), min_size=2, max_size=60))
def test_code_is_optimal(counts):
    lengths = token_files.code_lengths(dict(enumerate(counts)), 64 if max(counts) < 2**40 else 62)
    assert sum(counts[i] * n for i, n in lengths.items()) == _huffman_bits(counts)
    assert sum(2.0**-n for n in lengths.values()) == 1


def test_length_limit():
    counts = {i: 2**i for i in range(40)}
    lengths = token_files.code_lengths(counts, 6)
    assert max(lengths.values()) == 6 and sum(2.0**-n for n in lengths.values()) == 1
    assert token_files.code_lengths({7: 3}, 6) == {7: 1} and token_files.code_lengths({}, 6) == {}
    with pytest.raises(ValueError):
        token_files.code_lengths(counts, 5)


@pytest.mark.parametrize("many", [0, 1, 255, 256, 257, 5000])
@pytest.mark.parametrize("most", [9, 16])
def test_bits(many, most):
    rng = np.random.default_rng(many)
    ids = (rng.integers(0, 400, many) * rng.random(many) ** 4).astype(np.int64) * 100 + 3
    code = token_files.Code(token_files.code_lengths(Counter(ids.tolist()), most))
    again = token_files.Code.from_bytes(code.to_bytes())
    data, marks = token_files.encode_ids(ids, *again.encoder())
    assert len(marks) == -(-many // token_files.STRIDE)
    back = token_files.decode_ids(data, marks, many, again.decoder(), again.most)
    assert back.tolist() == ids.tolist()


@pytest.fixture(scope="module")
def pieces():
    return token_files.PieceIds(PATH), Tokenizer.from_file(PATH)


_MARKS = st.sampled_from(list("aZé× \t\n'’.,-=<|≯́KİΣ가²٣你  \x0b\x85'sre"))


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(st.one_of(_MARKS, st.characters(exclude_categories=["Cs"])), max_size=30), max_size=4))
def test_ids_are_the_librarys(pieces, texts):
    mine, library = pieces
    texts = [*texts, "it's <|endoftext|> 'tis l'été", "I'LL we're.'s x='s"]
    assert [x.tolist() for x in mine.encode(texts)] == [library.encode(t, add_special_tokens=False).ids for t in texts]


def _want(rows):
    library, start, found = Tokenizer.from_file(PATH), 0, []
    for doc_id, text in rows:
        ids = np.array([*library.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        found.append((doc_id, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    return found


def _digest(found):
    rows = found.select("doc_id", "start", F.octet_length("ids") / 4, F.crc32("ids")).collect()
    return [(r[0], r[1], int(r[2]), r[3]) for r in sorted(rows, key=lambda r: r["start"])]


@pytest.mark.parametrize("block", [40, 1 << 18])
def test_round_trip(spark, tmp_path, block, monkeypatch):
    monkeypatch.setattr(token_files, "BLOCK_IDS", block)
    monkeypatch.setattr(token_files, "FILE_BYTES", 4000 if block == 40 else 1 << 20)
    rng = random.Random(block)
    rows = [doc(3 * i - 50, " ".join(words(rng, rng.randrange(0, 50)))) for i in range(300)]
    files = token_files.write_token_files(frame(spark, rows).repartition(7), str(tmp_path / "files"))
    assert files.agg(F.max("blocks")).first()[0] > (1 if block == 40 else 0)
    want = _want([(r[0], r[1]) for r in rows])
    assert _digest(token_files.read_token_files(files, 2)) == want
    again = spark.read.parquet(str(tmp_path / "files" / "files.parquet"))
    assert _digest(token_files.read_token_files(again)) == want
    path = files.first()["path"]
    block_of = token_files.TokenFile(path)
    last = len(block_of.blocks) - 1
    assert {(k, s) for k, s, _ in block_of.documents(last)} <= {x[:2] for x in want}  # a block on its own


def test_reading_tasks_follow_the_data(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(token_files, "BLOCK_IDS", 50)
    docs = frame(spark, [doc(i, "several words in a row") for i in range(500)])
    files = token_files.write_token_files(docs, str(tmp_path / "files"))
    read = token_files.read_token_files(files, 1).withColumn("task", F.spark_partition_id())
    assert read.select("task").distinct().count() > 3


def test_odd_rows(spark):
    rows = odd_docs()
    docs = frame(spark, [(*r, 1, "p", 2) for r in rows], DOCS + ", start int, part string, id int")
    found = _digest(token_files.round_trip(docs))
    library = Tokenizer.from_file(PATH)
    assert [r[0] for r in found[:1]] == [None] and [r[0] for r in found] == sorted([r[0] for r in rows], key=lambda x: (x is not None, x or 0))
    size = Counter((r[0], len(library.encode(r[1] or "", add_special_tokens=False).ids) + 1) for r in rows)
    assert Counter((r[0], r[2]) for r in found) == size
    assert _digest(token_files.round_trip(docs.limit(0))) == []


def test_query(spark, tmp_path):
    rows = [r for r in odd_docs() if r[0] not in (None, 5)] + [doc(50 + i, "x y " * i) for i in range(30)]
    folder = write(spark, tmp_path, documents=frame(spark, rows))
    got = sorted(tuple(r) for r in QUERIES["op13_token_files"](spark, folder).collect())
    assert got == _want(sorted((r[0], r[1]) for r in rows))
