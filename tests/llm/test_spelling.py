"""Spelling variants against brute force and SQL."""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter, defaultdict

import pytest

from tests.compare import differences, duck
from tests.llm.tables import DOCS, doc, frame, odd_docs
from visitledger.llm import spelling
from visitledger.llm.oracle import ORACLE
from visitledger.llm.queries import QUERIES

_FOLD = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def _variants(rows):
    counts = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(_FOLD)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= 6:
                counts[run] += 1
    counts = {w: n for w, n in counts.items() if n >= 5}
    near = defaultdict(set)
    for a in counts:
        for i in range(len(a)):
            cut = a[:i] + a[i + 1 :]
            if cut in counts:
                near[a].add(cut)
                near[cut].add(a)
            for b in counts:
                if len(a) == len(b) and a != b and b[:i] + b[i + 1 :] == cut:
                    near[a].add(b)
    form = {}
    for w, found in near.items():
        best = min(found, key=lambda x: (-counts[x], x))
        if counts[best] >= 5 * counts[w]:
            form[w] = best
    rows = []
    for w, n in counts.items():
        root = w
        while root in form:
            root = form[root]
        rows.append((w, form.get(w), root, n, len(near[w]), counts.get(form.get(w))))
    return sorted(rows, key=str)


def _got(docs):
    found = spelling.spelling_variants(docs)
    return sorted((tuple(r) for r in found.select("word", "form", "root", "n", "n_near", "form_n").collect()), key=str)


def _misspelt(rng):
    base = ["".join(rng.choices("abé", k=rng.randrange(6, 8))) for _ in range(250)] + ["aaaaaaa", "aaaaaaaa", "abbbbba"]
    chain = {"xyzxyz": 5, "xyzxya": 25, "xyzxaa": 125}  # a form of a form
    texts = [" ".join([w] * n) for w, n in chain.items()]
    texts += [" ".join(f"{rng.choice(base).title()}!" for _ in range(40)) for _ in range(250)]
    return [doc(7 * i - 3, t) for i, t in enumerate(texts)]


def test_variants(spark):
    rows = _misspelt(random.Random(3))
    want = _variants([(r[0], r[1]) for r in rows])
    assert any(r[1] for r in want) and any(r[4] > 3 for r in want) and ("xyzxyz", "xyzxya", "xyzxaa", 5, 1, 25) in want
    assert _got(frame(spark, rows).repartition(5)) == want


def test_odd_rows(spark):
    long_word = "supercal" * 20_000
    rows = odd_docs() + [doc(100 + i, f"{long_word} {long_word}x ×÷Àbcdef") for i in range(6)]
    docs = frame(spark, [(*r, "w", 1, 2) for r in rows], DOCS + ", word string, n int, place int")
    want = _variants([(r[0], r[1]) for r in rows])
    assert (long_word, None, long_word, 6, 1, None) in want
    assert _got(docs) == want
    assert _got(docs.limit(0)) == []


def test_nodes_are_prefixes_across_ranges(spark):
    rng = random.Random(4)
    words = {"".join(rng.choices("ab", k=rng.randrange(1, 12))) for _ in range(600)} | {"common" + "x" * i for i in range(300)}
    name = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(name, "false")
    try:
        rows = spelling.trie_nodes(spark.createDataFrame([(w, 1) for w in words], "word string, n long"), "word").collect()
    finally:
        spark.conf.unset(name)
    number = {}
    for r in rows:
        assert len(r["nodes"]) == len(r["key"]) + 1
        for i, node in enumerate(r["nodes"]):
            assert number.setdefault(r["key"][:i], node) == node
    assert len(set(number.values())) == len(number)
    assert any(node < 0 for node in number.values())
    assert [r["key"] for r in sorted(rows, key=lambda r: r["place"])] == sorted(words)


@pytest.fixture(scope="module")
def con():
    found = duck("/root/testdata/sf0.001")
    found.execute("CREATE VIEW documents AS SELECT * FROM '/root/testdata/sf0.001/documents.parquet'")
    return found


def test_query(spark, con):
    found = QUERIES["op11_spelling"](spark, "/root/testdata/sf0.001")
    assert differences(found, con, ORACLE["op11_spelling"]) == []
