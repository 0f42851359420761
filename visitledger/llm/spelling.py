"""Spelling variants: words one letter apart, found as equal pairs of trie nodes."""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from visitledger.llm.runs import code_points
from visitledger.sources.staging import drop_staged, stage

#: Words have so many letters and occurrences at least; a form is so many times as frequent as its variants.
LEAST_LETTERS = 6
LEAST_COUNT = 5
FACTOR = 5
#: Of all runs one in so many is given a typing error.
ERROR_ONE_IN = 199
#: Letters of Latin-1 once A-Z are in lower case. At most 90 different ones, which bounds a group of neighbours.
LETTERS = re.compile("[a-zÀ-ÿ]+")
#: Different words a task counts before it hands them on.
HELD_WORDS = 200_000

#: Roles of a row in its group: a whole word, a word without a letter, and one without the second of two equal letters.
WHOLE, CUT, CUT_AGAIN = 0, 1, 2


def with_error(run: str, doc_crc: int) -> str:
    """The run as it is counted: where its hash says so, without one of its letters."""
    h = zlib.crc32(run.encode(), doc_crc)
    if h % ERROR_ONE_IN:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1 :]


def count_words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The words of all texts and how often they occur: word, n."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[str] = Counter()

        def table() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array(counts.keys(), pa.string()), pa.array(counts.values(), pa.int64())], ["word", "n"]
            )

        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                runs = Counter(LETTERS.findall((text.as_py() or b"").lower().decode()))  # `lower` of bytes: A-Z only
                doc_crc = zlib.crc32(b"%s:" % (b"" if key is None else str(key).encode()))
                for run, many in runs.items():
                    word = with_error(run, doc_crc)
                    if len(word) >= LEAST_LETTERS:
                        counts[word] += many
                if len(counts) >= HELD_WORDS:
                    yield table()
                    counts.clear()
        yield table()

    narrow = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("binary").alias("text"))
    counted = narrow.mapInArrow(work, "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST_COUNT)


def _shared(a: str, b: str) -> int:
    """Length of the common prefix."""
    many = 0
    for x, y in zip(a, b):
        if x != y:
            break
        many += 1
    return many


def border_nodes(borders: list[tuple[int, str, str]]) -> dict[int, tuple[list[int], list[int], str]]:
    """Per part (number, first and last key): nodes it shares with the parts before and after it, and its last key.

    A trie node whose keys lie in several parts is a common prefix of the last
    key of one and the first of the next. These get negative numbers here, one
    per different prefix.
    """
    found = {part: ([], [], last) for part, _, last in borders}
    prefix, nodes, fresh = "", [], -1
    for (a, _, last), (b, first, _) in pairwise(borders):
        common = first[: _shared(last, first)]
        nodes = nodes[: _shared(prefix, common)]
        prefix = common
        while len(nodes) < len(prefix):
            nodes.append(fresh)
            fresh -= 1
        found[a][1].extend(nodes)
        found[b][0].extend(nodes)
    return found


def trie_nodes(words: DataFrame, key: str) -> DataFrame:
    """Number the trie nodes on the path of each key: key, n, place, nodes.

    `nodes` are those of its prefixes from the empty one to the whole key; equal
    numbers mean equal prefixes, wherever the keys lie. `place` ascends with the
    key. Sorted keys are dealt out in ranges, whatever prefixes they have in
    common; a task numbers the nodes that its keys open, and only those on the
    border of two ranges, one path per range, are numbered on the driver.
    """
    dealt = words.select(F.expr(key).alias("key"), "n").repartitionByRange("key")
    dealt = stage(dealt.withColumn("part", F.spark_partition_id()), "trie-keys")
    borders = dealt.groupBy("part").agg(F.min("key").alias("first"), F.max("key").alias("last")).collect()
    shared = border_nodes(sorted((r["part"], r["first"], r["last"]) for r in borders))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, before, path = -1, "", [0]
        for batch in batches:
            keys = batch.column(0).to_pylist()
            places, lists = [], []
            for word, of in zip(keys, batch.column(2).to_pylist()):
                if of != part:
                    part, before, path = of, "", [0]
                    opening, closing, last = shared[part]
                    place = node = (part + 1) << 40
                    kept = opening
                else:
                    kept = path[1 : 1 + _shared(before, word)]
                path = [0, *kept]
                if closing and len(path) <= len(word):
                    path += closing[len(kept) : _shared(word, last)]
                fresh = len(word) + 1 - len(path)
                path += range(node, node + fresh)
                node, before = node + fresh, word
                places.append(place)
                place += 1
                lists.append(path)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(places, pa.int64()), pa.array(lists, pa.list_(pa.int64()))],
                ["key", "n", "place", "nodes"],
            )

    ordered = dealt.repartition("part").sortWithinPartitions("part", "key")
    return ordered.select("key", "n", "part").mapInArrow(work, "key string, n long, place long, nodes array<long>")


def _pairs(words: DataFrame) -> DataFrame:
    """Pairs of a prefix node and a suffix node: of every split of a word, and around every letter left out."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            letters, offsets = code_points(batch.column(0).to_pylist())
            n, place = (batch.column(i).to_numpy() for i in (1, 2))
            prefixes, suffixes = (batch.column(i).flatten().to_numpy() for i in (3, 4))  # one more than letters each
            many = np.diff(offsets) + 1
            ends = np.cumsum(many)
            opens, closes = np.ones(len(prefixes), bool), np.ones(len(prefixes), bool)
            opens[ends - many], closes[ends - 1] = False, False
            again = np.zeros(len(letters), bool)
            again[1:] = letters[1:] == letters[:-1]
            again[offsets[:-1][offsets[:-1] < len(letters)]] = False
            owner = np.repeat(np.arange(len(many)), many)
            cut_owner = owner[closes]
            roles = np.concatenate([np.full(len(owner), WHOLE, np.int8), np.where(again, CUT_AGAIN, CUT).astype(np.int8)])
            word = np.concatenate([owner, cut_owner])
            columns = [np.concatenate([prefixes, prefixes[closes]]), np.concatenate([suffixes, suffixes[opens]])]
            columns += [place[word], n[word], roles]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["prefix", "suffix", "place", "n", "role"])

    narrow = words.select("word", "n", "place", "prefixes", "suffixes")
    return narrow.mapInArrow(work, "prefix long, suffix long, place long, n long, role byte")


def neighbours(words: DataFrame) -> DataFrame:
    """How many words are one letter off each word, and the most frequent of them: place, n_near, best (n, -place).

    `words`: word, n, place, prefixes, suffixes. Two words of one length that meet
    without a letter differ in that letter; a word that meets another without a
    letter lacks it. Where a word repeats a letter, only the first of the row is
    left out for the latter, so every pair meets once. A group has one whole word
    at most and one word per letter of the alphabet: no group is large.
    """
    meeting = _pairs(words).groupBy("prefix", "suffix")
    groups = meeting.agg(F.collect_list(F.struct("n", (-F.col("place")).alias("back"), "role")).alias("members"))
    groups = groups.where(F.size("members") > 1)

    def others(e):
        def near(o):
            cuts = (e["role"] != WHOLE) & (o["role"] != WHOLE) & (e["back"] != o["back"])
            return cuts | ((e["role"] == WHOLE) & (o["role"] == CUT)) | ((e["role"] == CUT) & (o["role"] == WHOLE))

        return F.transform(F.filter("members", near), lambda o: F.struct(o["n"].alias("n"), o["back"].alias("back")))

    found = F.transform("members", lambda e: F.struct((-e["back"]).alias("place"), others(e).alias("near")))
    each = groups.select(F.explode(found).alias("found")).select("found.place", F.col("found.near").alias("near"))
    each = each.select("place", F.size("near").cast("long").alias("many"), F.array_max("near").alias("best"))
    return each.where("many > 0").groupBy("place").agg(F.sum("many").alias("n_near"), F.max("best").alias("best"))


def _roots(forms: DataFrame) -> DataFrame:
    """Where the chain of forms from each place ends: place, root.

    Every form is FACTOR times as frequent as its variant, so chains are short
    and have no loops; each round follows twice as many links.
    """
    roots = stage(forms.select("place", F.col("form").alias("root")), "spelling-roots")
    while True:
        ahead = roots.select(F.col("place").alias("root"), F.col("root").alias("next"))
        joined = stage(roots.join(ahead, "root", "left").select("place", "root", "next"), "spelling-roots")
        drop_staged(roots)
        if joined.where("next IS NOT NULL").isEmpty():
            return joined.select("place", "root")
        followed = stage(joined.select("place", F.coalesce("next", "root").alias("root")), "spelling-roots")
        drop_staged(joined)
        roots = followed


def spelling_variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The words of all texts with the form each is a variant of: word, form, root, n, n_near, form_n.

    A word is a run of Latin-1 letters in lower case (A-Z only), as `with_error`
    leaves it, with LEAST_LETTERS letters and LEAST_COUNT occurrences at least.
    Near words differ by one letter inserted, left out or replaced. The most
    frequent near word (ties: the first in code-point order) is the word's form if
    it occurs FACTOR times as often; `root` is the last of the chain of forms.

    Null and empty texts have no words, a null id counts as an empty one, repeated
    rows count each; words may be of any length. An empty table gives an empty
    result. Other columns are not read.
    """
    counted = stage(count_words(docs, id_col, text_col), "spelling-words")
    forward = trie_nodes(counted, "word").withColumnsRenamed({"key": "word", "nodes": "prefixes"})
    backward = trie_nodes(counted, "reverse(word)")
    backward = backward.select(F.reverse("key").alias("word"), F.reverse("nodes").alias("suffixes"))
    words = stage(forward.join(backward, "word"), "spelling-nodes")
    near = neighbours(words)
    names = words.select("place", "word", "n")
    form = F.when(F.col("best.n") >= FACTOR * F.col("n"), -F.col("best.back"))
    known = names.join(near, "place", "left").withColumn("form_place", form)
    known = stage(known.select("place", "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), "form_place"), "spelling-near")
    roots = _roots(known.where("form_place IS NOT NULL").select("place", F.col("form_place").alias("form")))
    forms = known.select(F.col("place").alias("form_place"), F.col("word").alias("form"), F.col("n").alias("form_n"))
    ends = known.select(F.col("place").alias("root"), F.col("word").alias("root_word"))
    variants = roots.join(ends, "root").select("place", F.col("root_word").alias("root"))
    found = known.join(forms, "form_place", "left").join(variants, "place", "left")
    result = found.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
    result = stage(result, "spelling-variants")
    for spent in (counted, words, known):
        drop_staged(spent)
    return result
