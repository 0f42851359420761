"""N-gram Jaccard join with Bayesian pruning of candidates."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from visitledger.llm.exact_dedup import keyed, row_hash, whole
from visitledger.llm.runs import chunks
from visitledger.llm.shingles import min_hashes, set_keys, shingle_sets
from visitledger.sources.staging import drop_staged, stage

THRESHOLD = 0.8
#: MinHash values of a set, how many are compared at a time, and the probability of
#: reaching the threshold below which a pair is dropped.
HASHES = 128
STEP = 16
TOLERANCE = 1e-6
#: Sets compared with each other in one go, at most about so many on either side.
BLOCK = 256
#: Counters that all shingles of all documents are added up in, and rows they are moved in.
SLOTS = 1 << 20
SLICES = 64
#: Bits of the filter of ids whose texts are looked at again. Where there are more ids
#: than it can tell apart, more texts move; results are the same.
FILTER_BITS = 1 << 26
CHUNK = 2 << 20


@lru_cache
def least_matches(threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> dict[int, int]:
    """After n compared MinHash values, the fewest matches a pair needs to go on.

    With a uniform prior the similarity of a pair with m matches of n is
    Beta(m + 1, n - m + 1); its chance of being at least t equals that of at most
    m successes in n + 1 trials of probability t.
    """
    found = {}
    for n in range(STEP, HASHES + 1, STEP):
        chance, m = 0.0, -1
        while chance < tolerance and m < n:
            m += 1
            chance += comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
        found[n] = m
    return found


def _texts(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    for batch in batches:
        texts = [t or "" for t in batch.column(column).to_pylist()]
        for part in chunks([len(t) for t in texts], CHUNK):
            yield batch.slice(part.start, part.stop - part.start), texts[part]


def _signed(values: np.ndarray) -> pa.Array:
    return pa.array(values.view(np.int64))


def _slot(found: np.ndarray) -> np.ndarray:
    return (found >> np.uint64(32)).astype(np.int64) % SLOTS


def _set_rows(docs: DataFrame) -> DataFrame:
    """Rows of docs (id, row, text) as id, row, key, size, and each task's counters as slice, counts."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["id", "row", "key", "size", "slice", "counts"]
        total = np.zeros(SLOTS, np.uint32)
        for batch, texts in _texts(batches, 2):
            owner, found = shingle_sets(texts)
            keys, sizes = set_keys(owner, found, len(texts))
            total += np.bincount(_slot(found), minlength=SLOTS).astype(np.uint32)
            none = [pa.nulls(len(texts), pa.int32()), pa.nulls(len(texts), pa.binary())]
            columns = [batch.column(0), batch.column(1), pa.array(keys, pa.binary()), pa.array(sizes), *none]
            yield pa.RecordBatch.from_arrays(columns, names)
        if total.any():
            counts = [zlib.compress(part.astype("<u4").tobytes(), 1) for part in np.split(total, SLICES)]
            none = [pa.nulls(SLICES, t) for t in (pa.int64(), pa.int64(), pa.binary(), pa.int64())]
            yield pa.RecordBatch.from_arrays([*none, pa.array(range(SLICES), pa.int32()), pa.array(counts, pa.binary())], names)

    return docs.mapInArrow(work, "id long, row long, key binary, size long, slice int, counts binary")


def _frequencies(read: DataFrame) -> np.ndarray:
    """How many shingles of the whole corpus fall into each counter, added up slice by slice."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for at, counts in zip(batch.column(0).to_pylist(), batch.column(1)):
                part = np.frombuffer(zlib.decompress(counts.as_py()), "<u4").astype(np.uint64)
                sums[at] = sums[at] + part if at in sums else part
        done = [np.minimum(x, 2**32 - 1).astype("<u4").tobytes() for x in sums.values()]
        yield pa.RecordBatch.from_arrays([pa.array(sums.keys(), pa.int32()), pa.array(done, pa.binary())], ["slice", "counts"])

    slices = read.where("slice IS NOT NULL").select("slice", "counts").repartition("slice").mapInArrow(work, "slice int, counts binary")
    total = np.zeros((SLICES, SLOTS // SLICES), np.uint32)
    for r in slices.collect():  # SLOTS numbers, whatever the corpus
        total[r["slice"]] = np.frombuffer(r["counts"], "<u4")
    return total.ravel()


def _postings(texts: DataFrame, frequencies: np.ndarray, threshold: float) -> DataFrame:
    """The prefix of each set as shingle, node (the key's first half), size.

    Shingles are taken from the rarest on, as far as the counters tell; two sets
    that reach the threshold share one of the first n - ceil(t n) + 1, under any
    order that is the same for all sets.
    """
    shared = texts.sparkSession.sparkContext.broadcast(frequencies)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = shared.value
        for _, part in _texts(batches, 0):
            owner, found = shingle_sets(part)
            if not len(owner):
                continue
            keys, sizes = set_keys(owner, found, len(part))
            first = {k: i for i, k in reversed(list(enumerate(keys))) if k}
            chosen = np.zeros(len(part), bool)
            chosen[list(first.values())] = True  # equal sets of a chunk are sent once
            inside = chosen[owner]
            owner, found = owner[inside], found[inside]
            order = np.lexsort((found, counts[_slot(found)], owner))
            owner, found = owner[order], found[order]
            rank = np.arange(len(owner)) - np.searchsorted(owner, owner)
            short = rank <= sizes[owner] - np.ceil(threshold * sizes[owner] - 1e-9)
            nodes = np.array([int.from_bytes(k[:8], "big", signed=True) if k else 0 for k in keys], np.int64)
            columns = [_signed(found[short]), pa.array(nodes[owner[short]]), pa.array(sizes[owner[short]].astype(np.int32))]
            yield pa.RecordBatch.from_arrays(columns, ["shingle", "node", "size"])

    return texts.mapInArrow(work, "shingle long, node long, size int")


class IdFilter:
    """A Bloom filter of ids, of a fixed size: it holds all of them and few others."""

    def __init__(self, ids: DataFrame) -> None:
        hashed = ids.select(F.xxhash64("id").alias("h"))
        bits = F.explode(F.array(*[self._place(F.col("h"), i) for i in range(4)])).alias("bit")
        words = (
            hashed.select(bits)
            .groupBy(F.shiftright("bit", 6).alias("word"))
            .agg(F.bit_or(F.expr("shiftleft(1L, cast(bit & 63 as int))")).alias("bits"))
            .toArrow()  # at most FILTER_BITS / 64 rows
        )
        table = np.zeros(FILTER_BITS // 64, np.int64)
        table[words.column("word").to_numpy()] = words.column("bits").to_numpy()
        self.shared = ids.sparkSession.sparkContext.broadcast(table)

    @staticmethod
    def _place(h: Column, i: int) -> Column:
        mask = F.lit(FILTER_BITS - 1).cast("long")
        return (h.bitwiseAND(mask) + F.lit(i) * F.shiftrightunsigned(h, 32).bitwiseAND(mask)).bitwiseAND(mask)

    def map_texts(self, docs: DataFrame, work: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
        """`work` on the rows of docs (id, text) whose id may be in the filter; the others do not leave their task."""
        shared = self.shared

        def chosen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                h, inside = batch.column(2).to_numpy(), np.ones(batch.num_rows, bool)
                mask = np.int64(FILTER_BITS - 1)
                for i in range(4):
                    place = ((h & mask) + i * ((h.view(np.uint64) >> np.uint64(32)).astype(np.int64) & mask)) & mask
                    inside &= (shared.value[place >> 6] >> (place & 63)) & 1 == 1
                yield batch.select(["id", "text"]).filter(pa.array(inside))

        return docs.select("id", "text", F.xxhash64("id").alias("h")).mapInArrow(lambda batches: work(chosen(batches)), schema)


def _candidates(postings: DataFrame, threshold: float) -> DataFrame:
    """Groups of candidates: members (the group's number), low (its smallest node), node.

    Candidates share a shingle and have sizes of one or of neighbouring classes,
    a class reaching from one size to 1 / threshold times that. Shingles with the
    very same nodes, such as those of one passage, make one group. Everything up
    to there happens where the postings of a shingle are.
    """
    by_shingle, by_class = Window.partitionBy("shingle"), Window.partitionBy("shingle", "class")
    size_class = F.floor(F.log(F.col("size").cast("double")) / F.log(F.lit(1 / threshold))).cast("int")
    found = postings.repartition("shingle").distinct()
    for window in (by_shingle, by_class):
        found = found.withColumn("low", F.min("node").over(window)).withColumn("high", F.max("node").over(window))
        found = found.where("low < high")
        if window is by_shingle:
            found = found.withColumn("class", F.explode(F.array(size_class, size_class + 1)))
    members = F.xxhash64(F.bit_xor(F.xxhash64("node")).over(by_class), F.count(F.lit(1)).over(by_class), "low")
    return found.select(members.alias("members"), "low", "node").distinct()


def candidate_blocks(postings: DataFrame, threshold: float) -> tuple[DataFrame, DataFrame]:
    """Nodes with their block, and the nodes to compare in each pair of blocks, numbered `at`.

    A node's leader is the smallest of its candidates, so near copies fall into
    one block; a leader with many followers gets several. In a block everything is
    compared, between two blocks what is in one group of candidates.
    """
    shared = stage(_candidates(postings, threshold), "jaccard-shared")
    nodes = stage(shared.groupBy("node").agg(F.min("low").alias("leader")), "jaccard-nodes")
    split = nodes.groupBy("leader").agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("parts"))
    part = F.pmod(F.xxhash64("node"), F.col("parts"))
    blocks = nodes.join(split, "leader").select("node", F.xxhash64("leader", part).alias("block"))
    blocks = stage(blocks, "jaccard-blocks")
    drop_staged(nodes)
    placed = stage(shared.drop("low").join(blocks, "node"), "jaccard-placed")
    drop_staged(shared)
    seen = stage(placed.select("members", "block").distinct(), "jaccard-seen")
    meeting = (
        seen.withColumnRenamed("block", "left")
        .join(seen.withColumnRenamed("block", "right"), "members")
        .where("left < right")
        .select("members", F.struct("left", "right").alias("pair"))
    )
    meeting = stage(meeting, "jaccard-meeting")
    sides = meeting.select("members", "pair", F.explode(F.array("pair.left", "pair.right")).alias("block"))
    across = sides.join(placed, ["members", "block"]).select("pair", "block", "node").distinct()
    across = across.select(F.xxhash64("pair").alias("at"), (F.col("block") == F.col("pair.left")).alias("first"), "node")
    across = stage(across, "jaccard-pairs")
    for spent in (placed, seen, meeting):
        drop_staged(spent)
    return blocks, across


def _signatures(docs: DataFrame, involved: DataFrame) -> DataFrame:
    """MinHash values of the `involved` sets (rep, key, node, block): key, node, block, size, hashes.

    Worked out where the texts are; only the values move.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, part in _texts(batches, 1):
            owner, found = shingle_sets(part)
            keys, sizes = set_keys(owner, found, len(part))
            rows = list({k: i for i, k in enumerate(keys) if k}.values())
            if not rows:
                continue
            rows.sort()
            inside = np.isin(owner, rows)
            values = min_hashes(found[inside], np.searchsorted(owner[inside], rows), HASHES)
            columns = [pa.array([keys[i] for i in rows], pa.binary()), pa.array(sizes[rows]), pa.array([v.tobytes() for v in values], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["key", "size", "hashes"])

    ids = IdFilter(involved.select(F.col("rep").alias("id")))
    hashed = ids.map_texts(docs, work, "key binary, size long, hashes binary").dropDuplicates(["key"])
    return stage(hashed.join(involved.select("key", "node", "block"), "key"), "jaccard-sets")


def hopeful(keys: list[bytes], sizes: np.ndarray, hashes: np.ndarray, split: int, threshold: float) -> dict[bytes, bytes]:
    """Pairs that MinHash leaves open, among all sets or, with `split`, across it.

    Pairs whose sizes rule them out go first; then STEP values at a time are
    compared, and a pair is dropped as soon as it has fewer matches than
    `least_matches` asks for. Returns the partners of each set with an open pair,
    their keys one after the other; each pair is listed with one of its sets.
    """
    rows, columns = sizes[: split or len(sizes)], sizes[split:]
    fit = np.minimum.outer(rows, columns) >= threshold * np.maximum.outer(rows, columns) - 1e-9
    a, b = np.nonzero(fit if split else np.triu(fit, 1))
    b = b + split
    matches = np.zeros(len(a), np.int64)
    for upto, least in least_matches(threshold).items():
        if not len(a):
            return {}
        part = slice(upto - STEP, upto)
        for at in range(0, len(a), 1 << 16):
            some = slice(at, at + (1 << 16))
            matches[some] += (hashes[a[some], part] == hashes[b[some], part]).sum(axis=1)
        on = matches >= least
        a, b, matches = a[on], b[on], matches[on]
    found = {keys[i]: b"" for i in np.union1d(a, b)}
    for i in np.unique(a):
        found[keys[i]] = b"".join(keys[j] for j in b[a == i])
    return found


def verified(keys: list[bytes], partners: list[bytes], copies: np.ndarray, sets: list[np.ndarray], threshold: float) -> list[tuple]:
    """Links among open pairs: key, links and root of each linked set.

    links counts the documents behind its partners; root is the smallest key it is
    connected to here.
    """
    order = sorted(range(len(keys)), key=keys.__getitem__)
    place, a, b = {keys[i]: k for k, i in enumerate(order)}, [], []
    for i, theirs in enumerate(partners):
        for at in range(0, len(theirs), 16):
            j = order[place[theirs[at : at + 16]]]
            common = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
            if common >= threshold * (len(sets[i]) + len(sets[j]) - common) - 1e-9:
                a.append(place[keys[i]])
                b.append(place[keys[j]])
    many, root, before = copies[order], np.arange(len(keys)), None
    links = np.zeros(len(keys), np.int64)
    np.add.at(links, a, many[b])
    np.add.at(links, b, many[a])
    while before is None or (root != before).any():  # the smallest key spreads along the links
        before = root.copy()
        np.minimum.at(root, a, before[b])
        np.minimum.at(root, b, before[a])
    return [(keys[order[i]], int(links[i]), keys[order[root[i]]]) for i in sorted({*a, *b})]


def _by_group(work: Callable[[dict[str, list]], list[tuple]], schema: pa.Schema) -> Callable:
    """`work` on each run of rows with equal `at`, for batches sorted by it."""

    def decided(rows: pa.RecordBatch) -> pa.RecordBatch:
        at, columns, found = rows.column("at").to_numpy(), rows.to_pydict(), []
        cuts = [0, *(np.flatnonzero(np.diff(at)) + 1).tolist(), len(at)]
        for start, end in zip(cuts, cuts[1:]):
            found += work({k: v[start:end] for k, v in columns.items()})
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*found) if found else [[]] * len(schema), schema)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: list[pa.RecordBatch] = []  # of the group that may go on in the next batch
        for batch in batches:
            if not batch.num_rows:
                continue
            at = batch.column("at").to_numpy()
            if rest and rest[0].column("at")[0].as_py() != at[0]:
                yield decided(pa.concat_batches(rest))
                rest = []
            last = int(np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))[-1])
            if last:
                yield decided(pa.concat_batches([*rest, batch.slice(0, last)]))
                rest = []
            rest.append(batch.slice(last))
        if rest:
            yield decided(pa.concat_batches(rest))

    return run


_OPEN = pa.schema([("key", pa.binary()), ("partners", pa.binary()), ("at", pa.int64())])
_LINKS = pa.schema([("key", pa.binary()), ("links", pa.int64()), ("root", pa.binary())])


def _links(docs: DataFrame, involved: DataFrame, across: DataFrame, threshold: float) -> DataFrame:
    """Partial link counts and connections of every block and pair of blocks: key, links, root.

    Of the texts only those of pairs that MinHash leaves open move.
    """

    def prune(rows: dict[str, list]) -> list[tuple]:
        at = rows["at"][0]
        chosen = sorted({key: i for i, key in enumerate(rows["key"])}.values())  # a repeated row counts once
        rows = {k: [v[i] for i in chosen] for k, v in rows.items()}
        split = 0 if rows["inside"][0] else sum(rows["first"])
        if len(chosen) < 2 or not rows["inside"][0] and split in (0, len(chosen)):
            return []
        hashes = np.frombuffer(b"".join(rows["hashes"]), np.uint32).reshape(-1, HASHES)
        found = hopeful(rows["key"], np.array(rows["size"], np.int64), hashes, split, threshold)
        return [(key, partners, at) for key, partners in found.items()]

    def verify(rows: dict[str, list]) -> list[tuple]:
        owner, found = shingle_sets([t or "" for t in rows["text"]])
        keys, sizes = set_keys(owner, found, len(rows["text"]))
        sets = np.split(found, np.cumsum(sizes)[:-1])
        chosen = sorted({key: i for i, key in enumerate(rows["key"]) if key == keys[i]}.values())
        key, partners = ([rows[c][i] for i in chosen] for c in ("key", "partners"))
        copies = np.array([rows["copies"][i] for i in chosen], np.int64)
        return verified(key, partners, copies, [sets[i] for i in chosen], threshold)

    sets = _signatures(docs, involved)
    inside = sets.select(F.col("block").alias("at"), F.lit(True).alias("first"), F.lit(True).alias("inside"), "key", "size", "hashes")
    between = across.join(sets, "node").select("at", "first", F.lit(False).alias("inside"), "key", "size", "hashes")
    members = inside.unionByName(between).repartition("at").sortWithinPartitions("at", F.desc("first"))
    found = stage(members.mapInArrow(_by_group(prune, _OPEN), "key binary, partners binary, at long"), "jaccard-open")
    drop_staged(sets)
    rows = stage(found.join(involved.select("key", "copies", "rep"), "key"), "jaccard-asked")
    drop_staged(found)
    asked = IdFilter(rows.select(F.col("rep").alias("id")).distinct())
    texts = asked.map_texts(docs, lambda batches: batches, "id long, text string")
    full = rows.join(texts, rows["rep"].eqNullSafe(texts["id"])).drop("rep", "id")
    full = full.repartition("at").sortWithinPartitions("at")
    links = full.mapInArrow(_by_group(verify, _LINKS), "key binary, links long, root binary")
    links = stage(links, "jaccard-links")
    drop_staged(rows)
    return links


def connected(edges: DataFrame) -> DataFrame:
    """key and label, the smallest key reachable over `edges` (key, root).

    Each round every key takes the smallest label around it and then its label's
    label, so the rounds grow with the logarithm of the longest path. Every round
    is written before the next.
    """
    both = edges.where("key != root").select(F.col("key").alias("a"), F.col("root").alias("b"))
    both = stage(both.union(both.select("b", "a")).distinct(), "connected-edges")
    first = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("label")).withColumnRenamed("a", "key")
    labels = stage(first, "connected")
    while True:
        near = both.join(labels.select("key", "label"), both["b"] == F.col("key")).groupBy("a").agg(F.min("label").alias("near"))
        known = labels.select("key", "label")
        better = known.join(near, known["key"] == near["a"]).select("key", "label", F.least("label", "near").alias("better"))
        better = stage(better, "connected-better")
        jump = better.select(F.col("key").alias("_key"), F.col("better").alias("jump"))
        joined = better.join(jump, F.col("better") == F.col("_key"), "left")
        after = stage(
            joined.select("key", F.least("better", "jump").alias("label"), (F.least("better", "jump") < F.col("label")).alias("moved")),
            "connected",
        )
        drop_staged(better)
        drop_staged(labels)
        labels = after
        if after.where("moved").isEmpty():
            drop_staged(both)
            return labels.select("key", "label")


def jaccard_classes(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD
) -> DataFrame:
    """Class and number of links of every document, one row per input row.

    Columns id, row (a hash of all columns), class_id, n_links, n_copies,
    n_shingles. Two documents are linked if the Jaccard similarity of their sets
    of five-word shingles reaches `threshold`; a class is what links connect, and
    its class_id the smallest id in it. n_links counts all partners, n_copies
    those with the very same set.

    Documents with equal sets are one from the start. Sets that share a shingle of
    their prefix, taken from the rarest shingle on, are candidates; that loses no
    pair. Near copies form blocks, and blocks that share a shingle are compared
    inside one task, which returns counts and connections instead of pairs.
    MinHash values are compared step by step, and a pair is dropped when its
    chance of reaching the threshold falls below TOLERANCE. The others are
    verified exactly.

    Null and empty texts and texts without letters or digits are classes of their
    own without links. Texts under five words are one shingle. Rows that repeat an
    id belong to the classes of their texts; of a null id the class_id is null
    unless the class has other ids. An empty table gives an empty result.
    """
    rows = docs.select(
        F.col(id_col).cast("long").alias("id"),
        row_hash(docs).alias("row"),
        F.col(text_col).alias("text"),
    )
    read = stage(_set_rows(rows), "jaccard-rows")
    members = read.where("slice IS NULL").select("id", "row", "key", "size")
    frequencies = _frequencies(read)
    node = F.conv(F.hex(F.substring("key", 1, 8)), 16, -10).cast("long")
    groups = members.where("key IS NOT NULL").groupBy("key").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("copies"))
    groups = stage(groups.withColumn("node", node), "jaccard-groups")

    blocks, across = candidate_blocks(_postings(rows.select("text"), frequencies, threshold), threshold)
    involved = stage(groups.join(blocks, "node").select("rep", "key", "copies", "node", "block"), "jaccard-involved")
    found = _links(rows.select("id", "text"), involved, across, threshold)
    for spent in (blocks, across, involved):
        drop_staged(spent)
    labels = connected(found.select("key", "root"))
    links = found.groupBy("key").agg(F.sum("links").alias("links"))

    labelled = groups.join(labels, "key", "left").join(links, "key", "left")
    labelled = stage(labelled.withColumn("label", F.coalesce("label", "key")), "jaccard-labelled")
    tops = labelled.groupBy("label").agg(F.min("rep").alias("class_id"))
    classes = stage(labelled.join(tops, "label").select("key", "copies", "links", "class_id"), "jaccard-classes")
    alone = members.where("key IS NULL").select(
        "id", "row", F.col("id").alias("class_id"), F.lit(0).cast("long").alias("n_links"), F.lit(0).cast("long").alias("n_copies"), F.col("size").alias("n_shingles")
    )
    rest = members.where("key IS NOT NULL").join(classes, "key")
    rest = rest.select(
        "id",
        "row",
        "class_id",
        (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
        (F.col("copies") - 1).alias("n_copies"),
        F.col("size").alias("n_shingles"),
    )
    return rest.unionByName(alone)


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """`docs` with one row of each class, that of the smallest id, all columns kept.

    Of rows that share it the one with the smallest row hash stays, and rows equal
    in all columns are thinned to one. Documents without words all stay.
    """
    found = stage(jaccard_classes(docs, id_col, text_col, threshold), "near-classes")
    worded = found.where("n_shingles > 0").groupBy("class_id").agg(F.min(F.struct("id", "row")).alias("keep"))
    keep = worded.select("keep.id", "keep.row").union(found.where("n_shingles = 0").select("id", "row"))
    keep = stage(keep.distinct(), "near-kept").select(keyed(F.col("id")).alias("_kept_id"), F.col("row").alias("_kept_row"))
    hashed = docs.select(whole(docs), keyed(F.col(id_col)).alias("id"), row_hash(docs).alias("row"))
    same = (hashed["id"] == keep["_kept_id"]) & (hashed["row"] == keep["_kept_row"])
    return hashed.join(keep, same, "left_semi").dropDuplicates(["id", "row"]).select("doc.*")
