"""Repeat removal, quality, WARC, language, packing and the Jaccard join against brute force."""

from __future__ import annotations

import base64
import gzip
import hashlib
import math
import random
import re
import unicodedata
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tests.compare import differences
from tests.llm.tables import DOCS, doc, frame, odd_docs, words, write
from visitledger.llm import jaccard, language, packing, quality, repeats, warc
from visitledger.llm.oracle import ORACLE
from visitledger.llm.queries import QUERIES

# --- repeats


def _without_repeats(rows):
    seen, out = set(), []
    for doc_id, text in rows:
        data = (text or "").encode()
        gone = np.zeros(len(data), bool)
        for p in range(len(data) - 99):
            string = data[p : p + 100]
            gone[p : p + 100] |= string in seen
            seen.add(string)
        kept = np.frombuffer(data, np.uint8)[~gone].tobytes()
        spans = int((np.diff(np.concatenate([[0], gone, [0]])) == 1).sum())
        out.append((doc_id, len(data), len(data) - len(kept), spans, hashlib.sha256(kept).hexdigest()))
    return out


def _repetitive(rng):
    passage, other = "".join(rng.choices("abcdé ", k=260)), "".join(rng.choices("xyz ", k=150))
    texts = ["a" * 350, "ab" * 200, "abc " * 90, passage, passage[40:190], "", None, "short"]
    for i in range(40):
        own = "".join(rng.choices("klmno pq", k=rng.randrange(20, 300)))
        cut = sorted(rng.sample(range(261), 2))
        texts.append(rng.choice([own + passage + own, own + passage[cut[0] : cut[1]], other + own, own, passage + other]))
    return [doc(i * 3 - 5, t) for i, t in enumerate(texts)]


@pytest.mark.parametrize("seed,chunk,parts", [(0, 1 << 20, 1), (1, 500, 3), (2, 900, 8), (3, 3000, 17)])
def test_repeats(spark, seed, chunk, parts, monkeypatch, tmp_path):
    monkeypatch.setattr(repeats, "CHUNK", chunk)
    rows = _repetitive(random.Random(seed))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = QUERIES["op1_suffix_dedup"](spark, write(spark, tmp_path, documents=frame(spark, rows))).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert sorted(tuple(r) for r in got) == _without_repeats([r[:2] for r in rows])


def test_repeats_of_odd_rows(spark):
    long_text = "".join(random.Random(1).choices("abcdefgh", k=300))
    rows = [*odd_docs(), doc(20, long_text), doc(20, long_text), doc(21, long_text)]
    got = repeats.remove_repeats(frame(spark, [(*r, 1) for r in rows], DOCS + ", kept int")).collect()
    assert len(got) == len(rows)
    assert [len(r["kept"]) for r in got if r["id"] == 20] == [300, 300]  # equal rows are one document
    assert [len(r["kept"]) for r in got if r["id"] in (21, 7)] == [0, 0]
    assert repeats.remove_repeats(frame(spark, [])).count() == 0


@pytest.mark.parametrize("cut", [1, 2, 3, 50])
def test_neighbours_at_any_batch_size(cut):
    rng = np.random.default_rng(cut)
    rows = np.unique(rng.integers(0, 4, (200, 4)), axis=0).T.astype(np.int64)
    rows = np.concatenate([rows, rows[:2] * 0])
    state, repeat, is_open = repeats.Neighbours(), [], []
    for at in range(0, rows.shape[1], cut):
        a, b = state.add(rows[:, at : at + cut])
        repeat.append(a)
        is_open.append(b)
    is_open.append(state.finish())
    whole = repeats.Neighbours()
    a, b = whole.add(rows)
    for got, want in ((repeat, [a]), (is_open, [b, whole.finish()])):
        assert sorted(map(tuple, np.concatenate(got, 1).T)) == sorted(map(tuple, np.concatenate(want, 1).T))


# --- quality


def _labelled(rng, many):
    rows, labels = [], []
    for i in range(many):
        good = rng.random() < 0.7
        text = " ".join(words(rng, 60, 3000)) if good else rng.choice(["SPAM!! ", "$$$ ### "]) * 40
        rows.append(doc(i, text, lang=rng.choice(["en", "fr"]), source="hot" if i % 3 == 0 else f"s{i % 40}"))
        if i % 2:
            labels.append((i, int(good), 0))
    return rows, labels


def test_quality_on_held_out_rows(spark, tmp_path):
    rows, labels = _labelled(random.Random(4), 600)
    folder = write(
        spark, tmp_path, documents=frame(spark, rows), labels=frame(spark, labels, "doc_id long, quality int, toxic int")
    )
    got = {r["doc_id"]: r for r in QUERIES["op3_quality"](spark, folder).collect()}
    assert len(got) == 600
    held = [r for r in rows if r[0] % 2 == 0]
    assert all(got[r[0]]["keep"] == r[1].startswith("w") for r in held)


def _repeating(rng, many):
    """Good texts of all lengths over few short words; junk is mostly one of them."""
    pool, rows, labels = ["".join(rng.choices("abcdefgh", k=3)) for _ in range(200)], [], []
    for i in range(many):
        size, good, said = rng.choice([40, 200, 1000, 4000]), rng.random() < 0.7, rng.choice(pool)
        text = " ".join(rng.choice(pool) if good or rng.random() < 0.2 else said for _ in range(size))
        rows.append((*doc(i, text, source=f"s{i % 5}"), good))
        if i % 2:
            labels.append((i, int(good), 0))
    return rows, labels


def test_repeated_words_are_rejected_on_held_out_rows(spark):
    rows, labels = _repeating(random.Random(8), 900)
    docs = frame(spark, [r[:5] for r in rows]).repartition(8)
    got = {r["id"]: r["keep"] for r in quality.quality_scores(docs, frame(spark, labels, "doc_id long, quality int, toxic int")).collect()}
    held = [r for r in rows if r[0] % 2 == 0]
    bad, good = [r for r in held if not r[5]], [r for r in held if r[5]]
    assert sum(got[r[0]] for r in bad) <= 0.02 * len(bad)
    assert sum(not got[r[0]] for r in good) <= 0.01 * len(good)


def test_repetition(spark):
    texts = ["", "a", "a b", "a a", "a a b b c c", "a b a c a", "The the THE x", "b a " * 50, "x " * 5000]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = df.select("t", quality.repetition(F.split(F.lower(F.trim("t")), r"\s+")).alias("r")).collect()
    for r in got:
        w = r["t"].strip().lower().split() or [""]
        most = max(sum(a == b for a, b in zip(w, w[1:])), max(Counter(w).values()) - 1)
        assert r["r"] == pytest.approx(most / max(1, len(w) - 1)), r["t"]


def test_site_posteriors(spark):
    rows = [("big", "a", 3.0)] * 300 + [("big", "b", -3.0)] * 100 + [("tiny", "a", -3.0)] + [(None, None, 3.0)]
    got = {(r["host"], r["path"]): r for r in quality.site_posteriors(frame(spark, rows, "host string, path string, evidence double"), 0.5).collect()}
    p = lambda x: 1 / (1 + np.exp(-x))
    sums = {"big": (300 * p(3.0) + 100 * p(-3.0), 400), "tiny": (p(-3.0), 1), None: (p(3.0), 1)}
    rate = sum(s for s, _ in sums.values()) / 402
    raw = [s / n for s, n in sums.values()]
    strength = min(max(rate * (1 - rate) / np.var(raw, ddof=1) - 1, quality.STRENGTH[0]), quality.STRENGTH[1])
    for (host, _), r in got.items():
        s, n = sums[host]
        assert r["host_rate"] == pytest.approx((s + strength * rate) / (n + strength))
    assert abs(got["tiny", "a"]["host_rate"] - rate) < abs(p(-3.0) - rate)


def test_quality_of_odd_rows(spark):
    docs = frame(spark, [(*r, 0.5, True) for r in odd_docs()], DOCS + ", quality double, keep boolean")
    labels = frame(spark, [(1, None), (None, 1), (4, 1), (4, 0), (6, 7), (99, 1)], "doc_id long, quality int")
    got = quality.quality_scores(docs, labels).collect()
    assert len(got) == len(odd_docs()) and all(0 <= r["quality"] <= 1 for r in got)
    none = quality.quality_scores(docs, labels.limit(0)).collect()
    assert all(r["keep"] for r in none)
    assert quality.quality_scores(docs.limit(0), labels).count() == 0
    kept = quality.keep_good(docs, labels.limit(0))
    assert kept.columns == docs.columns and Counter(map(tuple, kept.collect())) == Counter(map(tuple, docs.collect()))


def test_labels_of_unknown_documents_change_nothing(spark):
    docs = frame(spark, [doc(i, "some words in a row", source="s") for i in range(4)])
    known = [(0, 1), (1, 0)]
    schema = "doc_id long, quality int"
    few = quality.quality_scores(docs, frame(spark, known, schema)).collect()
    many = quality.quality_scores(docs, frame(spark, known + [(1000 + i, 0) for i in range(200)], schema)).collect()
    assert sorted(few) == sorted(many) and all(r["keep"] for r in many)


def _bins(text):
    """The features of a text, character by character."""
    t = text or ""
    n = max(1, len(t))
    split = re.split(r"[ \t\n\x0b\f\r]+", t.strip(" ").lower())
    lines = t.split("\n")
    kind = unicodedata.category

    def fine(x):
        return math.floor(math.sqrt(x) * 16)

    beside = sum(a == b for a, b in zip(split, split[1:]))
    again = max(beside, max(Counter(split).values()) - 1) / max(1, len(split) - 1)
    plain = set(" \t\n\x0b\f\r.,;:!?'\"()-")
    found = {
        "capitals": fine(sum(kind(c) == "Lu" for c in t) / n),
        "symbols": fine(sum(kind(c)[0] not in "LMN" and c not in plain for c in t) / n),
        "exclaimed": fine((n - len(t.replace("!", ""))) / n if t else 1.0),
        "digits": fine(sum(kind(c)[0] == "N" for c in t) / n),
        "fresh_words": math.floor(len(set(split)) / len(split) * 16),
        "fresh_lines": math.floor(len(set(lines)) / len(lines) * 16),
        "word_length": math.floor(n / len(split)),
        "repetition": fine(again),
    }
    return {k: min(max(v, 0), 15) for k, v in found.items()}


def test_quality_query_against_brute_force(spark, tmp_path):
    """The whole query: bins, counts, log ratios, site rates and the meeting of both."""
    rng = random.Random(12)
    rows, labels = _labelled(rng, 300)
    rows += [doc(900, None, lang=None, source="s1"), doc(901, "", source=None), doc(902, "A-B c!! 12\nA-B c!! 12\n\n x"), doc(903, "Éa Éa " * 30)]
    labels += [(901, 0, 0), (902, 1, 0), (902, 0, 0), (5000, 0, 0), (3, None, 0)]
    folder = write(
        spark, tmp_path, documents=frame(spark, rows), labels=frame(spark, labels, "doc_id long, quality int, toxic int")
    )
    bins = {r[0]: _bins(r[1]) for r in rows}
    counts = {}
    for doc_id, label, _ in labels:
        if doc_id in bins and label is not None:
            for k, b in bins[doc_id].items():
                counts.setdefault(k, [[1.0, 1.0] for _ in range(16)])[b][1 - label] += 1
    ratio = {}
    for k, found in counts.items():
        good, bad = (sum(x[j] for x in found) for j in (0, 1))
        ratio[k] = [math.log(g / good) - math.log(b / bad) for g, b in found]
    prior = (good - 16) / (good + bad - 32)
    evidence = {i: sum(ratio[k][v] for k, v in b.items()) for i, b in bins.items()}
    own = {i: 1 / (1 + math.exp(-(e + math.log(prior / (1 - prior))))) for i, e in evidence.items()}
    paths, hosts = defaultdict(list), defaultdict(list)
    for r in rows:
        paths[r[3], r[2]].append(own[r[0]])
        hosts[r[3]].append(own[r[0]])

    def strength(mean, spread):
        return min(max(mean * (1 - mean) / max(spread, 1e-9) - 1, 2.0), 10_000.0)

    rate = sum(own.values()) / len(own)
    pull = strength(rate, np.var([np.mean(v) for v in hosts.values()], ddof=1))
    host_rate = {h: (sum(v) + pull * rate) / (len(v) + pull) for h, v in hosts.items()}
    off = [np.mean(v) - host_rate[h] for (h, _), v in paths.items()]
    path_pull = strength(np.mean([host_rate[h] for h, _ in paths]), np.mean(np.square(off)))
    got = {r["doc_id"]: r for r in QUERIES["op3_quality"](spark, folder).collect()}
    assert len(got) == len(rows)
    for r in rows:
        site = paths[r[3], r[2]]
        path_rate = (max(sum(site) - own[r[0]], 0) + path_pull * host_rate[r[3]]) / (len(site) - 1 + path_pull)
        inside = min(max(path_rate, 1e-9), 1 - 1e-9)
        want = 1 / (1 + math.exp(-(evidence[r[0]] + math.log(inside / (1 - inside)))))
        assert got[r[0]]["evidence"] == pytest.approx(evidence[r[0]]), r
        assert got[r[0]]["path_rate"] == pytest.approx(path_rate) and got[r[0]]["quality_score"] == pytest.approx(want)
        assert got[r[0]]["keep"] == (got[r[0]]["quality_score"] >= 0.2)


# --- WARC

PAGES = "page_id long, url string, html string"


def _pages():
    big, hot = "<p>" + "x" * 2000, "é" * 600
    rows = [(i, f"http://h/{i}", f"<html>{i}" + "y" * (i * 37 % 1500)) for i in range(40)]
    rows += [(100 + i, "http://hot/ a\r\nb", hot) for i in range(30)] + [(200, None, big), (201, "", big), (7000, "u", "z" * 999), (7001, "u", "z" * 999)]
    return rows + [(300, "http://n", None), (301, None, None), (302, "http://e", "")]


def test_warc_against_sql(spark, tmp_path):
    import duckdb

    folder = write(spark, tmp_path, pages=frame(spark, _pages(), PAGES))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{folder}/pages.parquet/*.parquet'")
    assert differences(QUERIES["op5_warc"](spark, folder), con, ORACLE["op5_warc"]) == []


@pytest.mark.parametrize("size", [1, 97, 1000, 1 << 20])
def test_warc_ranges_read_each_record_once(spark, tmp_path, size, monkeypatch):
    monkeypatch.setattr(warc, "BLOCK", 64)
    rows = [(None, None, None), (5, "u", "same" * 400), (6, "u", "same" * 400), (7, "v", "\x1f\x8b\x08 not a member"), (5, "u", "same" * 400)]
    files = warc.write_warc(frame(spark, rows, PAGES).coalesce(1), f"file://{tmp_path}/w")
    path = files.first()["path"]
    total = files.first()["size"]
    found = [r for at in range(0, total, size) for r in warc.range_records(path, at, min(total, at + size))]
    assert [r["offset"] for r in found] == sorted({r["offset"] for r in found})
    assert Counter(r["record_type"] for r in found) == {"warcinfo": 1, "response": 3, "revisit": 2}
    assert gzip.open(path.removeprefix("file://")).read().count(b"WARC/1.1\r\n") == 6


def test_warc_passes_over_what_is_no_record(tmp_path):
    record = warc._record([("WARC-Type", "resource")], b"payload")
    stored = zlib.compressobj(0, zlib.DEFLATED, 31)
    nested = stored.compress(b"WARC/1.1\r\nContent-Length: 60\r\n\r\n" + record) + stored.flush()
    data = b"junk\x1f\x8b\x08junk" + record + gzip.compress(b"no record") + record + nested + record[:-9]
    (tmp_path / "a.warc.gz").write_bytes(data)
    for size in (5, 64, len(data)):
        found = [r for at in range(0, len(data), size) for r in warc.range_records(str(tmp_path / "a.warc.gz"), at, at + size)]
        assert [r["payload"] for r in found] == [b"payload"] * 2


def test_archives_are_listed_and_read(spark, tmp_path):
    warc.write_warc(frame(spark, _pages(), PAGES), f"file://{tmp_path}/w")
    records = warc.read_warc(warc.list_archives(spark, f"file://{tmp_path}/w"), 500).where("record_type != 'warcinfo'")
    assert records.count() == len(_pages())
    full = records.where("record_type = 'response'").select("payload", "payload_digest").collect()
    assert all(hashlib.sha1(r["payload"]).hexdigest() == r["payload_digest"] for r in full)
    assert base64.b32encode(hashlib.sha1(b"").digest())
    assert warc.round_trip(frame(spark, [], PAGES)).count() == 0


def test_ranges_are_read_by_many_tasks(spark, tmp_path):
    """As many tasks as the ranges call for, whatever adaptive execution would merge."""
    files = warc.write_warc(frame(spark, _pages() * 20, PAGES), f"file://{tmp_path}/w")
    read = warc.read_warc(files, 200).withColumn("task", F.spark_partition_id())
    assert read.select("task").distinct().count() >= spark.sparkContext.defaultParallelism - 1


def test_warc_of_a_very_long_page_and_clashing_columns(spark, tmp_path):
    body = "".join(random.Random(1).choices("abcdefgh <>/é", k=3_000_000))
    pages = [(1, "u", body, "p", 7), (2, "u", body, "q", 8), (3, None, "short", None, None)]
    docs = frame(spark, pages, PAGES + ", path string, size int")
    found = {r["record_id"]: r for r in warc.round_trip(docs, f"file://{tmp_path}/w").where("record_type != 'warcinfo'").collect()}
    assert found["<urn:page:2>"]["payload"] == body.encode()
    assert found["<urn:page:1>"]["refers_to"] == "<urn:page:2>" and found["<urn:page:3>"]["payload"] == b"short"


# --- language


def test_language_on_held_out_rows(spark, tmp_path):
    rng = random.Random(2)
    letters = {"en": "abcdefg", "fr": "efghijk", "xx": "ijklmno"}
    rows = []
    for i in range(400):
        lang = rng.choice(list(letters))
        text = " ".join("".join(rng.choices(letters[lang], k=rng.randrange(2, 9))) for _ in range(30))
        rows.append(doc(i, text, lang=lang if i % 7 else None))
    rows += [doc(500, None), doc(501, ""), doc(502, "12 !! ٣"), doc(503, "你好"), doc(None, "abc")]
    got = {r["doc_id"]: r for r in QUERIES["op6_language"](spark, write(spark, tmp_path, documents=frame(spark, rows))).collect()}
    assert len(got) == 405
    for r in rows:
        held = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 1
        assert got[r[0]]["held_out"] == held and 0 <= got[r[0]]["score"] <= 1
    known = [r for r in rows[:400] if r[2] and got[r[0]]["held_out"]]
    assert sum(got[r[0]]["lang_pred"] == r[2] for r in known) >= 0.97 * len(known)
    assert [got[i]["lang_pred"] for i in (500, 501, 502)] == ["und"] * 3
    assert got[503]["lang_pred"] in letters


def test_language_learns_every_word_of_its_sample(spark, monkeypatch):
    """No word is dropped, copies are drawn once and every language has rows, however hot one text is."""
    rng = random.Random(3)
    hot = "hot " + " ".join(words(rng, 50, 5000))
    rows = [(hot, "en")] * 400 + [(f"rare{i}q {i}", "en") for i in range(300)] + [(hot, "fr")] * 300 + [("seul mot", "fr")]
    model = language.fit(spark.createDataFrame(rows, "text string, lang string"))
    tokens = {w for t, _ in rows for w in re.findall(r"[^\W\d_]+", t)}
    points, offsets = language.code_points(sorted(tokens))
    known = language.run_hashes(points, offsets[:-1], np.diff(offsets))
    assert set(model.words.hashes.tolist()) == set(known.tolist())
    assert model.languages == ["en", "fr"]
    assert language.identify(frame(spark, [doc(1, "seul mot"), doc(2, "rare q")]), model).where("lang_pred = 'fr'").count() == 1
    monkeypatch.setattr(language, "DOCS_PER_LANGUAGE", 100)
    monkeypatch.setattr(language, "LANGUAGES", 1)
    small = language.fit(spark.createDataFrame(rows, "text string, lang string"))
    assert small.languages == ["en"] and len(small.words.hashes) <= 100 * 52


def test_language_query_against_brute_force(spark, tmp_path):
    """Every prediction and score from plain counts of words and n-grams."""
    rng = random.Random(9)
    letters = {"en": "abcdefg", "fr": "efghijk"}
    rows = []
    for i in range(120):
        lang = rng.choice(list(letters))
        text = " ".join("".join(rng.choices(letters[lang], k=rng.randrange(1, 7))) for _ in range(12))
        rows.append((*doc(i, text.title() if i % 3 else text + " 12!", lang=lang if i % 9 else None), i))
    rows += [(*doc(500, "zzz", lang="en"), 0), (*doc(501, "abc", lang="fr"), 0)] * 2
    long_text = " ".join(r[1] for r in rows) * 40
    rows.append((*doc(600, long_text, lang=None), 0))
    docs = frame(spark, rows, DOCS + ", token int")
    learn = {(r[2], r[1]) for r in rows if r[2] and r[1] and zlib.crc32(str(r[0]).encode()) % 3 != 1}
    held = Counter(r[2] for r in rows if r[2] and r[1] and zlib.crc32(str(r[0]).encode()) % 3 != 1)
    langs = sorted(held)
    counts = {n: {} for n in (0, *language.LENGTHS)}
    for lang, text in learn:
        for w in re.findall(r"[^\W\d_]+", text.lower()):
            for n in counts:
                for t in [w] if n == 0 else [w[i : i + n] for i in range(len(w) - n + 1)]:
                    counts[n].setdefault(t, Counter())[lang] += 1
    logs = {}
    for n, found in counts.items():
        total = {k: sum(c[k] for c in found.values()) + 0.1 * max(1, len(found)) for k in langs}
        logs[n] = {t: [math.log((c[k] + 0.1) / total[k]) for k in langs] for t, c in found.items()}
    got = {}
    for r in QUERIES["op6_language"](spark, write(spark, tmp_path, documents=docs)).collect():
        got[r["doc_id"]] = r
    for r in rows:
        score = [math.log(held[k] / sum(held.values())) for k in langs]
        for w in re.findall(r"[^\W\d_]+", r[1].lower()):
            parts = [logs[0][w]] if w in logs[0] else []
            for n in language.LENGTHS:
                parts = parts or [logs[n][w[i : i + n]] for i in range(len(w) - n + 1) if w[i : i + n] in logs[n]]
            if parts:
                score = [s + sum(p[j] for p in parts) / len(parts) for j, s in enumerate(score)]
        best = max(range(len(langs)), key=lambda j: score[j])
        assert got[r[0]]["lang_pred"] == langs[best], r
        assert got[r[0]]["score"] == pytest.approx(1 / sum(math.exp(s - score[best]) for s in score))


def test_unseen_words_back_off():
    def table(tokens):
        points, offsets = language.code_points(list(tokens))
        hashes = language.run_hashes(points, offsets[:-1], np.diff(offsets))
        order = np.argsort(hashes)
        return language.Table(hashes[order], np.log(np.array(list(tokens.values())))[order])

    none = language.Table(np.zeros(0, np.uint64), np.zeros((0, 2)))
    grams = {5: none, 4: table({"abcd": [0.9, 0.1]}), 3: table({"bcd": [0.1, 0.9], "xyz": [0.2, 0.8]}), 2: none, 1: none}
    model = language.Model(["p", "q"], np.array([0.5, 0.5]), table({"word": [0.7, 0.3]}), grams)
    assert model.predict(["word", "abcde", "xyzw", "abcd xyz", "??", "QQ"])[0] == ["p", "p", "q", "p", "und", "p"]
    assert model.predict(["abcd"])[1][0] == pytest.approx(0.9)  # the longest n-gram alone decides


def test_language_without_anything_to_learn(spark):
    docs = frame(spark, odd_docs())
    model = language.fit(docs.limit(0).select("text", "lang"))
    assert {r["lang_pred"] for r in language.identify(docs, model).collect()} == {"und"}
    assert language.identify(docs.limit(0), model).count() == 0


# --- packing

WORDS = packing.WordTokens
LETTERS = st.text(st.sampled_from(list(" \n\t\r'’abcstremvldSTÉé9²½!.,$　​́中🎉\x85\x1c")), max_size=60)


@pytest.fixture(scope="module")
def tokens():
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path(packing.TOKENIZER)
    return packing.WordTokens(path), Tokenizer.from_file(path)


@settings(max_examples=300, deadline=None)
@given(texts=st.lists(LETTERS, max_size=6))
def test_tokens_are_the_tokenizer_s(tokens, texts):
    mine, theirs = tokens
    assert [x.tolist() for x in mine.encode(texts)] == [theirs.encode(t, add_special_tokens=False).ids for t in texts]


def test_tokens_of_special_strings_and_small_tables(tokens, monkeypatch):
    mine, theirs = tokens
    monkeypatch.setattr(packing, "KNOWN_WORDS", 3)
    texts = ["<|endoftext|>", "a <|endoftext|> b", "", "we'll don't 'tis ''s x's", "one two three four", "one"]
    for _ in range(2):
        assert [x.tolist() for x in mine.encode(texts)] == [theirs.encode(t, add_special_tokens=False).ids for t in texts]


@pytest.mark.parametrize("seed", range(3))
def test_bins_are_full(seed):
    rng = random.Random(seed)
    bins, rows, want = packing.Bins(7, 1024), [], []
    for doc_id in range(300):
        for length in packing.cut_lengths(rng.randrange(1, 4000)):
            want.append((doc_id, length))
            rows += bins.add(length, [doc_id, length])
    rows += bins.finish()
    assert sorted((r[0], r[1]) for r in rows) == sorted(want)
    bags = defaultdict(list)
    for r in rows:
        bags[r[3]].append((r[4], r[1]))
    padded = 0
    for pieces in bags.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 1024
        padded += 0 if at & (at - 1) == 0 else 1024 - at
    assert padded < 0.01 * sum(length for _, length in want)


def test_packing(spark, tokens, tmp_path):
    rng = random.Random(8)
    rows = odd_docs() + [doc(100 + i, " ".join(words(rng, rng.randrange(500)))) for i in range(60)]
    got = QUERIES["op8_packing"](spark, write(spark, tmp_path, documents=frame(spark, rows))).collect()
    pieces, bags = defaultdict(list), defaultdict(list)
    for r in got:
        pieces[r["doc_id"]].append(r)
        bags[r["sequence_id"]].append(r)
    for doc_id in {r[0] for r in rows}:
        texts = [r[1] or "" for r in rows if r[0] == doc_id]
        want = Counter()
        for text in texts:
            ids = np.array([*tokens[1].encode(text, add_special_tokens=False).ids, 0], "<u4")
            mine = [p for p in pieces[doc_id] if p["doc_tokens"] == len(ids)]
            at = 0
            for length in packing.cut_lengths(len(ids)):
                want[at, length, zlib.crc32(ids[at : at + length].tobytes()), len(ids)] += 1
                at += length
            assert mine
        assert Counter((p["start"], p["length"], p["ids_crc32"], p["doc_tokens"]) for p in pieces[doc_id]) == want
    for rows_of in bags.values():
        rows_of.sort(key=lambda r: r["offset"])
        assert [r["offset"] for r in rows_of] == [sum(x["length"] for x in rows_of[:i]) for i in range(len(rows_of))]
        assert sum(r["length"] for r in rows_of) <= 1024
    assert packing.pack(frame(spark, [])).count() == 0
    with pytest.raises(ValueError):
        packing.pack(frame(spark, []), capacity=1000)


# --- Jaccard join


def _shingles(text):
    plain = "".join(c if unicodedata.category(c)[0] in "LN" else " " for c in (text or "").lower()).split()
    return frozenset(tuple(plain[i : i + 5]) for i in range(max(1, len(plain) - 4))) if plain else frozenset()


def _classes(rows):
    sets, parent, links = [_shingles(r[1]) for r in rows], list(range(len(rows))), Counter()

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a and b and len(a & b) >= 0.8 * len(a | b):
                links[i] += 1
                links[j] += 1
                parent[top(i)] = top(j)
    smallest = {}
    for i, r in enumerate(rows):
        ids = [x for x in (smallest.get(top(i)), r[0]) if x is not None]
        smallest[top(i)] = min(ids, default=None)
    return Counter((r[0], smallest[top(i)], links[i], len(sets[i])) for i, r in enumerate(rows))


def _near(rng):
    rows, base = [], words(rng, 120, 10_000)
    line = words(rng, 12, 10_000)
    for i in range(70):  # a large group of near copies, some of them only through others
        text = list(base)
        for _ in range(rng.randrange(0, 5)):
            text[rng.randrange(len(text))] = f"edit{rng.randrange(30)}"
        rows.append(doc(i, " ".join(text)))
    for i in range(100, 160):  # a line that many share
        rows.append(doc(i, " ".join([*line, *words(rng, rng.randrange(2, 60), 300)])))
    return rows + [doc(200, "one two"), doc(201, "One, two!"), doc(202, "one two three four five"), doc(203, "six")]


@pytest.mark.parametrize("seed,block", [(0, 256), (1, 8)])
def test_jaccard_classes(spark, seed, block, monkeypatch, tmp_path):
    monkeypatch.setattr(jaccard, "BLOCK", block)
    rows = _near(random.Random(seed)) + [r for r in odd_docs() if r[0] is None or r[0] < 100]
    rows = [r for r in rows if not (r[0] in (1, 2, 3, 4, 5, 6, 7, 8, 9) and r[1] and r[1].startswith("w") and len(r[1]) < 5000)]
    got = QUERIES["op9_jaccard_join"](spark, write(spark, tmp_path, documents=frame(spark, rows))).collect()
    assert Counter((r["doc_id"], r["class_id"], r["n_links"], r["n_shingles"]) for r in got) == _classes(rows)


def test_pruning_keeps_what_could_reach_the_threshold():
    rng = np.random.default_rng(1)
    least = jaccard.least_matches()
    for n, m in least.items():
        for _ in range(200):
            assert (rng.random(n) < 0.8).sum() >= m
        assert (rng.random(n) < 0.2).sum() < n
    assert least[128] > 75
    assert jaccard.verified([b"a" * 16], [b""], np.ones(1, np.int64), [np.zeros(1, np.uint64)], 0.8) == []


def test_drop_near_copies(spark):
    rows = [(*r, "z", 1) for r in _near(random.Random(5))[:100] + odd_docs()]
    docs = frame(spark, rows, DOCS + ", key string, row int")
    got = jaccard.drop_near_copies(docs)
    assert got.columns == docs.columns
    kept = got.collect()
    sets = [s for s in (_shingles(r["text"]) for r in kept) if s]
    assert len(sets) == len(set(sets))
    classes = {r["class_id"] for r in jaccard.jaccard_classes(docs).where("n_shingles > 0").collect()}
    assert len(sets) == len(classes)
    assert {r[0] for r in rows if not _shingles(r[1])} == {r["doc_id"] for r in kept if not _shingles(r["text"])}
    assert jaccard.drop_near_copies(docs.limit(0)).count() == 0


def test_connected_chains(spark):
    keys = [bytes([i]) * 16 for i in range(40)]
    edges = [(keys[i], keys[i + 1]) for i in range(29)] + [(keys[33], keys[31]), (keys[31], keys[31])]
    got = {bytes(r["key"]): bytes(r["label"]) for r in jaccard.connected(frame(spark, edges, "key binary, root binary")).collect()}
    assert got == {k: keys[0] for k in keys[:30]} | {keys[33]: keys[31], keys[31]: keys[31]}


# --- pipeline


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(6)
    rows, labels = _labelled(rng, 120)
    good = [r for r in rows if r[1].startswith("w")]
    rows += [doc(1000, good[0][1].upper()), doc(1001, good[1][1] + " extra"), *odd_docs()]
    docs = frame(spark, rows)
    folder = write(spark, tmp_path, documents=docs, labels=frame(spark, labels, "doc_id long, quality int, toxic int"))
    docs, seen = spark.read.parquet(f"{folder}/documents.parquet"), {}
    for name, function in corpus_pipeline.STAGES:
        out = function(spark, docs, folder)
        if name != "packing":
            assert out.columns == docs.columns
        out.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        seen[name] = docs.collect()
    assert not [r for r in seen["quality"] if "SPAM" in (r["text"] or "")]
    assert {r[0] for r in good} <= {r["doc_id"] for r in seen["quality"]}
    folded = [(r["text"] or "").lower() for r in seen["exact_dedup"]]
    assert len(folded) == len(set(folded))
    assert not {good[1][0], 1001} <= {r["doc_id"] for r in seen["jaccard_join"]}
    assert {r["doc_id"] for r in seen["mixing"]} <= {r["doc_id"] for r in seen["jaccard_join"]}
    copies = Counter(r["doc_id"] for r in seen["mixing"])
    assert Counter(r["doc_id"] for r in seen["packing"] if r["start"] == 0) == copies
    again = corpus_pipeline.run(spark, folder)
    assert Counter((r["doc_id"], r["start"], r["ids_crc32"]) for r in again.collect()) == Counter(
        (r["doc_id"], r["start"], r["ids_crc32"]) for r in seen["packing"]
    )


def test_pipeline_keeps_the_right_copies(spark):
    """Exact and near copies that the stages keep, against all pairs; columns that clash ride along."""
    import corpus_pipeline

    rng = random.Random(13)
    texts = [" ".join(words(rng, rng.randrange(5, 60), 50)) for _ in range(40)]
    rows = [doc(i, t) for i, t in enumerate(texts)]
    rows += [doc(100 + i, t.upper()) for i, t in enumerate(texts[:10])] + [doc(200 + i, t + " tail") for i, t in enumerate(texts[5:30])]
    rows += [doc(300 + i, f"{texts[0]} x{i}y") for i in range(30)] + [doc(400, None), doc(401, ""), doc(402, "!!"), doc(403, "??")]
    names = DOCS + ", id int, row string, key string, kept boolean, block long, position double, copies int"
    docs = frame(spark, [(*r, 1, "r", "k", False, 5, 0.5, 3) for r in rows], names).repartition(5)
    fold = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    last = {}
    for i, t, *_ in rows:
        last[(t or "").translate(fold)] = max(i, last.get((t or "").translate(fold), i))
    once = dict(corpus_pipeline.STAGES)["exact_dedup"](spark, docs, "")
    assert once.columns == docs.columns
    assert sorted(r["doc_id"] for r in once.collect()) == sorted(last.values())
    left = {r[0]: _shingles(r[1]) for r in rows if r[0] in last.values()}
    root = {i: i for i in left}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in left:
        for b in left:
            if a < b and left[a] and left[b] and len(left[a] & left[b]) >= 0.8 * len(left[a] | left[b]):
                root[max(top(a), top(b))] = min(top(a), top(b))
    near = dict(corpus_pipeline.STAGES)["jaccard_join"](spark, once, "")
    assert near.columns == docs.columns
    assert sorted(r["doc_id"] for r in near.collect()) == sorted({top(i) for i in left})
    mixed = dict(corpus_pipeline.STAGES)["mixing"](spark, near, "")
    assert mixed.columns == docs.columns and {r["doc_id"] for r in mixed.collect()} <= {r["doc_id"] for r in near.collect()}


def test_pipeline_of_nothing(spark, tmp_path):
    import corpus_pipeline

    folder = write(spark, tmp_path, documents=frame(spark, []), labels=frame(spark, [], "doc_id long, quality int, toxic int"))
    assert corpus_pipeline.run(spark, folder).count() == 0
