"""Exact ranked lexical search: a tree of items against trees of documents."""

from __future__ import annotations

import heapq
import math
import re
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from visitledger.sources.staging import stage

#: Documents returned for an item.
TOP = 10
#: Items searched in one pass over the corpus: so many at most, and so many items times different terms.
BLOCK_ITEMS = 1024
BLOCK_CELLS = 1 << 22
#: Documents of a searching task, of one tree, and items and documents of a leaf.
TASK_DOCS = 16_384
TREE_DOCS = 4096
LEAF_ITEMS = 8
LEAF_DOCS = 16

#: Fixed values of the score: digits and letters of ASCII and whatever is beyond ASCII make terms.
TERM = re.compile(rb"[0-9A-Za-z\x80-\xff]+")
SCALE, SATURATION, LENGTH_UNIT, LENGTH_SHARE = 1_000_000_000, 1000, 8, 75

_FOUND = "item long, item_id long, doc_id long, score long"


def terms_of(text: bytes | None) -> list[bytes]:
    """The terms of a UTF-8 text, A-Z in lower case; none for null."""
    return TERM.findall((text or b"").lower())  # `lower` of bytes touches A-Z only


def weights(doc_counts: np.ndarray, documents: int) -> np.ndarray:
    """The weight of terms that so many of all `documents` hold."""
    return np.array([math.floor(1000 * math.log((2 * documents + 2) / (2 * df + 1))) for df in doc_counts.tolist()], np.int64)


def term_scores(counts: np.ndarray, lengths: np.ndarray, documents: int, total: int) -> np.ndarray:
    """What occurrences in documents of so many terms add per unit of weight."""
    m = 100 - LENGTH_SHARE + (LENGTH_SHARE * lengths * documents) // max(total, 1)
    return (SCALE * counts) // (SATURATION * counts + LENGTH_UNIT * m)


class Items:
    """A block of items: their ids and how often each holds the terms of the block's vocabulary."""

    def __init__(self, ids: list[int | None], texts: list[list[bytes]]) -> None:
        self.ids = ids
        self.vocabulary: dict[bytes, int] = {}
        for terms in texts:
            for t in terms:
                self.vocabulary.setdefault(t, len(self.vocabulary))
        self.counts = np.zeros((len(ids), len(self.vocabulary)), np.int64)
        for i, terms in enumerate(texts):
            np.add.at(self.counts[i], [self.vocabulary[t] for t in terms], 1)


def item_blocks(items: DataFrame, id_col: str = "item_id", text_col: str = "text") -> Iterator[Items]:
    """The items in blocks of a bounded size; the driver holds one block at a time."""
    ids: list[int | None] = []
    texts: list[list[bytes]] = []
    seen: set[bytes] = set()
    for row in items.select(F.col(id_col).cast("long"), F.col(text_col).cast("binary")).toLocalIterator():
        terms = terms_of(None if row[1] is None else bytes(row[1]))
        many = len(seen.union(terms))
        if ids and (len(ids) == BLOCK_ITEMS or (len(ids) + 1) * many > BLOCK_CELLS):
            yield Items(ids, texts)
            ids, texts, seen = [], [], set()
        ids.append(row[0])
        texts.append(terms)
        seen.update(terms)
    if ids:
        yield Items(ids, texts)


def count_terms(docs: DataFrame, vocabulary: dict[bytes, int], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: doc_id, n (all its terms), and the terms of `vocabulary` it holds with their counts."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = vocabulary.get
        for batch in batches:
            lengths, ends, terms, counts = [], [0], [], []
            for text in batch.column(1):
                words = terms_of(text.as_py())
                known = np.array([x for x in map(number, words) if x is not None], np.int32)
                different, many = np.unique(known, return_counts=True)
                lengths.append(len(words))
                ends.append(ends[-1] + len(different))
                terms.append(different)
                counts.append(many)
            offsets = pa.array(ends, pa.int32())
            flat = [np.concatenate(x).astype(np.int32) if x else np.zeros(0, np.int32) for x in (terms, counts)]
            columns = [pa.ListArray.from_arrays(offsets, pa.array(x)) for x in flat]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(lengths, pa.int64()), *columns], ["doc_id", "n", "terms", "counts"]
            )

    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    return narrow.mapInArrow(work, "doc_id long, n long, terms array<int>, counts array<int>")


class ItemNode:
    """Items with similar terms and, per term, the largest weight that any of them gives it."""

    def __init__(self, members: np.ndarray, weighed: np.ndarray) -> None:
        self.members, self.most = members, weighed[members].max(axis=0).astype(np.float64)
        self.children: list[ItemNode] = []
        if len(members) > LEAF_ITEMS:
            rows = weighed[members].astype(np.float64)
            rows /= np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1)
            far = rows @ rows[0]
            one = rows[far.argmin()]  # two ends far apart; the items between them are halved by the end they are nearer to
            other = rows[(rows @ one).argmin()]
            order = np.argsort(rows @ other - rows @ one, kind="stable")
            half = len(members) // 2
            self.children = [ItemNode(members[order[:half]], weighed), ItemNode(members[order[half:]], weighed)]


    def leaves(self) -> list[ItemNode]:
        return [x for child in self.children for x in child.leaves()] or [self]


class DocNode:
    """Documents with similar terms and, per term, the largest share that it scores in any of them."""

    def __init__(self, members: np.ndarray, terms: np.ndarray, most: np.ndarray, children: list[DocNode]) -> None:
        self.members, self.terms, self.most, self.children = members, terms, most, children


def _maxima(terms: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(terms, kind="stable")
    terms, values = terms[order], values[order]
    first = np.flatnonzero(np.append(True, terms[1:] != terms[:-1])) if len(terms) else np.zeros(0, np.int64)
    return terms[first], np.maximum.reduceat(values, first) if len(first) else values


class Documents:
    """Documents of one tree: the postings of each, and the tree's root."""

    def __init__(self, ids: list[int | None], starts: np.ndarray, terms: np.ndarray, shares: np.ndarray, profiles: np.ndarray) -> None:
        self.ids, self.starts, self.terms, self.shares = ids, starts, terms, shares
        order = self._order(profiles)
        nodes = [self._leaf(order[i : i + LEAF_DOCS]) for i in range(0, len(order), LEAF_DOCS)]
        while len(nodes) > 1:
            nodes = [self._parent(nodes[i : i + 2]) for i in range(0, len(nodes), 2)]
        self.root = nodes[0]

    def _order(self, profiles: np.ndarray) -> np.ndarray:
        """Similar documents next to each other.

        Each is described by its scores against `profiles`, a column of weights
        for each leaf of the items, and these by their two main directions: slices
        along the first, sorted along the second.
        """
        scored = np.zeros((len(self.ids), profiles.shape[1]))
        has = np.flatnonzero(np.diff(self.starts))
        if len(has):
            scored[has] = np.add.reduceat(profiles[self.terms] * self.shares[:, None], self.starts[:-1][has], axis=0)
        scored -= scored.mean(axis=0)
        _, axes = np.linalg.eigh(scored.T @ scored)
        one, two = scored @ axes[:, -1], scored @ axes[:, -min(2, axes.shape[1])]
        slices = np.digitize(one, np.quantile(one, np.linspace(0, 1, 17)[1:-1]))
        return np.lexsort((two, slices))

    def postings(self, members: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Terms and shares of `members` one after the other, and where each one's begin."""
        many = self.starts[members + 1] - self.starts[members]
        ends = np.cumsum(many)
        at = np.arange(many.sum()) + np.repeat(self.starts[members] - ends + many, many)
        return self.terms[at], self.shares[at], ends - many

    def _leaf(self, members: np.ndarray) -> DocNode:
        terms, shares, _ = self.postings(members)
        return DocNode(members, *_maxima(terms, shares), [])

    def _parent(self, nodes: list[DocNode]) -> DocNode:
        if len(nodes) == 1:
            return nodes[0]
        terms, most = _maxima(*(np.concatenate([getattr(x, name) for x in nodes]) for name in ("terms", "most")))
        return DocNode(np.concatenate([x.members for x in nodes]), terms, most, nodes)


class Search:
    """The best documents of each item so far, and the walk over pairs of nodes that improves them."""

    def __init__(self, weighed: np.ndarray, top: int) -> None:
        self.weighed, self.top = weighed, top
        self.root = ItemNode(np.arange(len(weighed)), weighed)
        self.profiles = np.stack([x.most for x in self.root.leaves()], axis=1)
        self.best: list[list[tuple]] = [[] for _ in range(len(weighed))]  # (-score, has an id, id), in order
        self.weakest = np.zeros(len(weighed), np.int64)  # the last of them, once there are `top`

    def _bound(self, a: ItemNode, d: DocNode) -> float:
        """No item of `a` scores more with any document of `d`; the factor covers rounding."""
        return float(a.most[d.terms] @ d.most) * (1 + 1e-9)

    def add(self, docs: Documents) -> None:
        """Walk pairs of nodes from the largest bound down.

        A pair whose bound is below the weakest score kept by each of its items
        is left out with all its members; equal scores are looked at, as a smaller
        id wins them.
        """
        ties = count()
        queue = [(-self._bound(self.root, docs.root), next(ties), self.root, docs.root)]
        while queue:
            bound, _, a, d = heapq.heappop(queue)
            if bound == 0 or -bound < self.weakest[a.members].min():
                continue
            if not a.children and not d.children:
                self._score(a, d, docs)
                continue
            for x in a.children or [a]:
                for y in d.children or [d]:
                    bound = self._bound(x, y)
                    if bound > 0 and bound >= self.weakest[x.members].min():
                        heapq.heappush(queue, (-bound, next(ties), x, y))

    def _score(self, a: ItemNode, d: DocNode, docs: Documents) -> None:
        """Score the members of two leaves that their own bounds leave."""
        bounds = (self.weighed[np.ix_(a.members, d.terms)] @ d.most.astype(np.float64)) * (1 + 1e-9)
        items = a.members[(bounds > 0) & (bounds >= self.weakest[a.members])]
        members = d.members[docs.starts[d.members + 1] > docs.starts[d.members]]
        terms, shares, begins = docs.postings(members)
        scores = np.add.reduceat(self.weighed[np.ix_(items, terms)] * shares, begins, axis=1)
        good = (scores > 0) & (scores >= self.weakest[items][:, None])
        for k in np.flatnonzero(good.any(axis=1)).tolist():
            i = int(items[k])
            for j in np.flatnonzero(good[k]).tolist():
                doc = docs.ids[members[j]]
                self.best[i].append((-int(scores[k, j]), doc is not None, doc or 0))
            self.best[i] = sorted(self.best[i])[: self.top]
            if len(self.best[i]) == self.top:
                self.weakest[i] = -self.best[i][-1][0]


def _search(counted: DataFrame, items: Items, weight: np.ndarray, documents: int, total: int, top: int) -> DataFrame:
    """The best documents of each task for each item."""
    weighed, ids = items.counts * weight, items.ids

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = Search(weighed, top)
        for whole in batches:
            for at in range(0, whole.num_rows, TREE_DOCS):
                batch = whole.slice(at, TREE_DOCS)
                lists, counts = batch.column(2), batch.column(3)
                starts = np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))]).astype(np.int64)
                tf = counts.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
                lengths = np.repeat(batch.column(1).to_numpy(zero_copy_only=False), np.diff(starts))
                shares = term_scores(tf, lengths, documents, total)
                terms = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
                search.add(Documents(batch.column(0).to_pylist(), starts, terms, shares, search.profiles))
        rows = [(i, ids[i], x[2] if x[1] else None, -x[0]) for i, best in enumerate(search.best) for x in best]
        columns = list(zip(*rows)) if rows else [[]] * 4
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["item", "item_id", "doc_id", "score"])

    return counted.mapInArrow(work, _FOUND)


def _best(found: DataFrame, top: int, *keys: str) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy(F.desc("score"), F.asc_nulls_first("doc_id"), "tie")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)


def search(
    docs: DataFrame,
    items: DataFrame,
    top: int = TOP,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
) -> DataFrame:
    """The `top` documents of each item by score: item_id, rank, doc_id, score.

    Items are searched in blocks (BLOCK_ITEMS, BLOCK_CELLS), each in two passes:
    the block's terms are counted in all documents, then every task builds trees
    over TREE_DOCS documents at a time and walks them against the block's tree of
    items. Nodes hold the largest value of every term below them, so the product
    of two nodes bounds every score below them; pairs of nodes that cannot reach
    the weakest kept score of any of their items are dropped. Scores are 64-bit
    integers; only bounds are rounded, upwards. The tasks' best documents are
    merged in two steps.

    Null and empty texts have no terms: such documents count nowhere, such items
    get no rows. Equal scores rank by document id, null first; repeated rows of a
    document each have a rank. Rows of `items` with one id are each an item. Empty
    tables give an empty result. Other columns are not read.
    """
    spark = docs.sparkSession
    results: list[DataFrame] = []
    for block in item_blocks(items, item_col, item_text_col):
        counted = stage(count_terms(docs, block.vocabulary, id_col, text_col), "search-terms")
        size = counted.agg(F.count_if(F.col("n") > 0).alias("documents"), F.coalesce(F.sum("n"), F.lit(0)).alias("total")).first()
        holding = np.zeros(len(block.vocabulary), np.int64)
        # at most one row per term of the block
        for term, many in counted.select(F.explode("terms").alias("term")).groupBy("term").count().collect():
            holding[term] = many
        weight = weights(holding, size["documents"])
        # the counts are small and the walk is not, so tasks are made by documents, not by bytes
        tasks = max(1, math.ceil(size["documents"] / TASK_DOCS))
        dealt = counted.where("size(terms) > 0").repartition(tasks, "doc_id", "n")
        found = _search(dealt, block, weight, size["documents"], size["total"], top)
        found = stage(found.withColumn("tie", F.monotonically_increasing_id()), "search-found")
        found = found.withColumn("part", F.pmod(F.xxhash64("doc_id", "tie"), F.lit(64)))
        best = _best(_best(found, top, "item", "part"), top, "item")
        results.append(stage(best.select("item_id", "rank", "doc_id", "score"), "search-best"))
    if not results:
        return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    whole = results[0]
    for more in results[1:]:
        whole = whole.unionByName(more)
    return whole
