"""Removing repeated byte strings by prefix doubling over sampled positions."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from visitledger.llm.runs import chunks, mix
from visitledger.sources.staging import drop_staged, stage

#: Bytes of a repeat, and of the grams the first round ranks.
THRESHOLD = 100
GRAM = 32
#: Bytes of text a task hashes at once.
CHUNK = 1 << 20

_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_VALUES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))
#: Stands for a null id; smaller than any other.
_NULL = -(1 << 63)
#: A position is the place in the text plus, above it, where ids repeat, bits of the
#: text's hash: they tell rows of one id apart.
_PLACE_BITS = 40


class Names:
    """Names of all substrings of some bytes: 64-bit hashes, equal for equal strings."""

    def __init__(self, data: np.ndarray) -> None:
        def powers(base: int) -> np.ndarray:
            found = np.full(len(data) + 1, base, np.uint64)
            found[0] = 1
            return np.multiply.accumulate(found)

        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_VALUES[data] * powers(_BASE)[:-1], out=self.sums[1:])
        self.inverse = powers(_INVERSE)

    def of(self, starts: np.ndarray | slice, ends: np.ndarray | slice) -> np.ndarray:
        return (self.sums[ends] - self.sums[starts]) * self.inverse[starts]


def _sliding(values: np.ndarray, width: int, choose: np.ufunc) -> np.ndarray:
    """The least or largest of each `width` values in a row."""
    span = 1
    while 2 * span <= width:
        values = choose(values[:-span], values[span:])
        span *= 2
    return choose(values[: len(values) - (width - span)], values[width - span :]) if width > span else values


class Sample:
    """Grams of texts written one after the other, and which of them are sampled.

    Of the grams in each `threshold` bytes the one of the smallest name is
    sampled, so two equal strings of that length have a sample at the same place.
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray, threshold: int, gram: int) -> None:
        self.names, self.offsets, self.threshold, self.gram = Names(data), offsets, threshold, gram
        n = len(data)
        self.grams = mix(self.names.of(slice(0, n - gram + 1), slice(gram, n + 1)))
        lowest = _sliding(self.grams, threshold - gram + 1, np.minimum)  # one for each start of a string
        crossing = np.zeros(n + 1, bool)  # strings that start here run over the end of a text
        for end in offsets[1:]:
            crossing[max(0, end - threshold + 1) : end] = True
        self.lowest = np.where(crossing[: len(lowest)], np.uint64(0), lowest)

    def text_of(self, place: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.offsets, place, side="right") - 1

    def places(self) -> np.ndarray:
        """The sampled positions."""
        edge = np.zeros(self.threshold - self.gram, np.uint64)
        highest = _sliding(np.concatenate([edge, self.lowest, edge]), self.threshold - self.gram + 1, np.maximum)
        highest = highest[: len(self.grams)]
        return np.flatnonzero((highest == self.grams) & (highest > 0))

    def ranks(self, place: np.ndarray) -> tuple[np.ndarray, ...]:
        """Names of the grams at `place` and of their contexts, and how far these reach.

        The context holds all strings of `threshold` bytes around the gram, as far
        as the text goes.
        """
        text = self.text_of(place)
        left = np.minimum(place - self.offsets[text], self.threshold - self.gram)
        right = np.minimum(self.offsets[text + 1] - place, self.threshold)
        context = mix(self.names.of(place - left, place + right) + (left << 8).astype(np.uint64))
        return self.grams[place], context, left, right

    def strings(self, place: np.ndarray, sides: np.ndarray) -> np.ndarray:
        """Where the strings start that have their sample at one of `place`, and the half that `sides` leaves open around it."""
        width = self.threshold - self.gram + 1
        before = np.arange(width)[None, :]  # bytes of the string before the gram
        starts = place[:, None] - before
        half = np.where(before <= half_width(self.threshold, self.gram), RIGHT, LEFT)
        inside = (starts >= 0) & (starts < len(self.lowest)) & ((sides[:, None] & half) > 0)
        found = np.where(inside, self.lowest[np.clip(starts, 0, max(0, len(self.lowest) - 1))], 0) == self.grams[place][:, None]
        return np.unique(starts[inside & found])


def _batches(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Parts of batches with the bytes of a text column and the offsets of its texts."""
    for batch in batches:
        texts = batch.column(column).to_pylist()
        for part in chunks([len(t) for t in texts], CHUNK):
            joined = np.frombuffer(b"".join(texts[part]), np.uint8)
            ends = np.cumsum([len(t) for t in texts[part]])
            yield batch.slice(part.start, part.stop - part.start), joined, np.concatenate([[0], ends]).astype(np.int64)


def _long(values: np.ndarray) -> pa.Array:
    return pa.array(values.view(np.int64))


_RANKED = "gram long, context long, doc long, at long, left short, right short"


def _fields(ddl: str) -> list[str]:
    return [f.split()[0] for f in ddl.split(", ")]


def _ranked(texts: DataFrame, threshold: int, gram: int) -> DataFrame:
    """First ranks of all sampled positions; a context that repeats in a chunk has gram null from its second place on."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, offsets in _batches(batches, 2):
            if len(data) < threshold:
                continue
            sample = Sample(data, offsets, threshold, gram)
            place = sample.places()
            ranks, text = sample.ranks(place), sample.text_of(place)
            doc = batch.column(0).to_numpy()[text]
            at = place - offsets[text] + (batch.column(1).to_numpy()[text] << _PLACE_BITS)
            order = np.lexsort((at, doc, ranks[1], ranks[0]))
            grams, context, left, right = (r[order] for r in ranks)
            doc, at = doc[order], at[order]
            again = np.zeros(len(order), bool)
            again[1:] = (grams[1:] == grams[:-1]) & (context[1:] == context[:-1])
            start = np.maximum.accumulate(np.where(again, 0, np.arange(len(order))))
            same = again & (doc == doc[start]) & (at == at[start])  # a repeated row, not a repeat
            blank = [pa.array(r.view(np.int64), mask=again) for r in (grams, context)]
            sides = [pa.array(r.astype(np.int16)) for r in (left, right)]
            columns = [*blank, pa.array(doc), pa.array(at), *sides]
            yield pa.RecordBatch.from_arrays(columns, _fields(_RANKED)).filter(pa.array(~same))

    return texts.mapInArrow(work, _RANKED)


class Neighbours:
    """Sorted ranks of a partition, batch by batch.

    Of positions with equal gram and context all but the first repeat an earlier
    one. The first ones are open if their gram has another context, too; the
    others are unique. A gram that reaches the partition's edge may go on in the
    next, so its first ones count as open.
    """

    def __init__(self) -> None:
        self.gram = self.context = None
        self.first: tuple[int, int] = (0, 0)  # position of the present context
        self.waiting: np.ndarray | None = None  # the only context of its gram so far
        self.open = True

    def add(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Repeats and open positions that `rows` (gram, context, doc, at and more) decide."""
        gram, context, doc, at = rows[0], rows[1], rows[2], rows[3]
        new_gram = np.concatenate([[gram[0] != self.gram], gram[1:] != gram[:-1]])
        new = new_gram | np.concatenate([[context[0] != self.context], context[1:] != context[:-1]])
        start = np.maximum.accumulate(np.where(new, np.arange(len(new)), -1))
        first_doc = np.where(start < 0, self.first[0], doc[start])
        first_at = np.where(start < 0, self.first[1], at[start])
        repeat = ~new & ((doc != first_doc) | (at != first_at))
        run = np.cumsum(new_gram)
        many = np.bincount(run, new, run[-1] + 1)
        if self.gram is not None and not new_gram[0]:
            was_open, waiting = self.open, self.waiting
        else:
            was_open, waiting = self.gram is None, None
        if self.gram is None:
            many[run[0]] += 2  # the first gram of the partition may have begun in the one before
        elif not new_gram[0]:
            many[run[0]] += 2 if was_open else 1
        chosen = new & (many[run] > 1)
        found = [rows[:, chosen]]
        if waiting is not None and many[run[0]] > 1:
            found.insert(0, waiting)
            waiting = None
        last = run == run[-1]
        self.open = bool(many[run[-1]] > 1)
        if self.open:
            self.waiting = None
        elif (new & last).any():
            self.waiting = rows[:, new & last]
        else:
            self.waiting = waiting
        self.gram, self.context, self.first = gram[-1], context[-1], (int(first_doc[-1]), int(first_at[-1]))
        return rows[:, repeat], np.concatenate(found, axis=1)

    def finish(self) -> np.ndarray:
        return np.zeros((6, 0), np.int64) if self.waiting is None else self.waiting


_DECIDED = "doc long, at long, left short, right short, open boolean"


def _decided(ranked: DataFrame) -> DataFrame:
    """Sort the ranks over all partitions; returns repeats and open positions."""
    order = ["gram", "context", "doc", "at"]

    def table(rows: np.ndarray, is_open: bool) -> pa.RecordBatch:
        columns = [pa.array(rows[2]), pa.array(rows[3]), *(pa.array(r.astype(np.int16)) for r in rows[4:6])]
        return pa.RecordBatch.from_arrays([*columns, pa.array([is_open] * rows.shape[1], pa.bool_())], _fields(_DECIDED))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = Neighbours()
        for batch in batches:
            if batch.num_rows:
                repeats, is_open = state.add(np.stack([c.to_numpy().astype(np.int64) for c in batch.columns]))
                yield table(repeats, False)
                yield table(is_open, True)
        yield table(state.finish(), True)

    spread = ranked.where("gram IS NOT NULL").repartitionByRange(*order).sortWithinPartitions(*order)
    found = spread.mapInArrow(work, _DECIDED)
    local = ranked.where("gram IS NULL").select("doc", "at", "left", "right", F.lit(False).alias("open"))
    return found.unionByName(local)


#: The halves around a gram that the second round ranks.
RIGHT, LEFT = 1, 2
_HALVES = "name long, doc long, at long, side int"


def half_width(threshold: int, gram: int) -> int:
    return (threshold - gram) // 2


def _with_places(texts: DataFrame, places: DataFrame) -> DataFrame:
    """Rows of `texts` that have `places` (doc, at and more columns), as doc, tie, bytes, places."""
    rest = [c for c in places.columns if c not in ("doc", "at")]
    place = F.col("at").bitwiseAND(F.lit((1 << _PLACE_BITS) - 1)).alias("place")
    listed = places.groupBy("doc", F.shiftright("at", _PLACE_BITS).alias("tie")).agg(F.collect_list(F.struct(place, *rest)).alias("places"))
    listed = listed.select(F.col("doc").alias("_doc"), F.col("tie").alias("_tie"), "places")
    joined = texts.join(listed, (F.col("doc") == F.col("_doc")) & (F.col("tie") == F.col("_tie")))
    return joined.select("doc", "tie", "bytes", "places")


def _placed(batch: pa.RecordBatch, offsets: np.ndarray, column: str) -> np.ndarray:
    """A field of the places of all texts of a batch, as one array; places count from the first text on."""
    lists = batch.column(3)
    found = lists.flatten().field(column).to_numpy(zero_copy_only=False).astype(np.int64)
    if column == "place":
        found += np.repeat(offsets[:-1], lists.value_lengths().to_numpy(zero_copy_only=False))
    return found


def _halves(texts: DataFrame, is_open: DataFrame, threshold: int, gram: int) -> DataFrame:
    """Second ranks of open positions: names of what all strings with the gram in their first, or second, half share.

    With half the bytes that a string has besides the gram being h, a string that
    has at most h of them before the gram holds the gram and h bytes after it; any
    other holds the gram and h bytes before it.
    """
    half = half_width(threshold, gram)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, offsets in _batches(batches, 2):
            names, place = Names(data), _placed(batch, offsets, "place")
            text = np.searchsorted(offsets, place, side="right") - 1
            doc = batch.column(0).to_numpy()[text]
            at = place - offsets[text] + (batch.column(1).to_numpy()[text] << _PLACE_BITS)
            columns: list[list[np.ndarray]] = [[], [], [], []]
            for side, start, end in ((RIGHT, place, place + threshold - half), (LEFT, place - half - 1, place + gram)):
                fits = (start >= offsets[text]) & (end <= offsets[text + 1])
                name = mix(names.of(start[fits], end[fits])) ^ np.uint64(side)
                for c, v in zip(columns, (name.view(np.int64), doc[fits], at[fits], np.full(len(name), side, np.int32))):
                    c.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in columns], _fields(_HALVES))

    return _with_places(texts, is_open.select("doc", "at")).mapInArrow(work, _HALVES)


def _repeated_halves(halves: DataFrame) -> DataFrame:
    """Sort the second ranks over all partitions; returns doc, at, sides of those that are not unique.

    A rank at the edge of a partition may go on in the next and stays, too: what
    stays is only looked at more closely.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: pa.RecordBatch | None = None  # the last row, whose rank the next batch may go on with
        same_before = True

        def kept(rows: pa.RecordBatch, same: np.ndarray) -> pa.RecordBatch:
            return rows.select(["doc", "at", "side"]).filter(pa.array(same))

        for batch in batches:
            if not batch.num_rows:
                continue
            rows = batch if rest is None else pa.concat_batches([rest, batch])
            name = rows.column("name").to_numpy()
            equal = name[1:] == name[:-1]
            same = np.concatenate([[same_before], equal]) | np.concatenate([equal, [False]])
            yield kept(rows.slice(0, rows.num_rows - 1), same[:-1])
            rest, same_before = rows.slice(rows.num_rows - 1), bool(same[-1])
        if rest is not None:
            yield kept(rest, np.array([True]))

    order = ["name", "doc", "at"]
    sorted_ranks = halves.repartitionByRange(*order).sortWithinPartitions(*order)
    found = sorted_ranks.mapInArrow(work, "doc long, at long, side int")
    return found.groupBy("doc", "at").agg(F.bit_or("side").alias("sides"))


_STRINGS = "doc long, at long, name long, more int, run int"


def _strings(texts: DataFrame, is_open: DataFrame, threshold: int, gram: int) -> DataFrame:
    """The strings of `threshold` bytes sampled at open positions, in their open halves, with their ranks.

    A rank is made of the names of two doubled grams, at offset 0 and at the one
    that takes them to the threshold: 96 bits in name and more. A string that
    repeats in a chunk is sent once. From its second place on it is a repeat and
    needs no rank: `run` says how many such strings start there one after another.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, offsets in _batches(batches, 2):
            if len(data) < threshold:
                continue
            sample = Sample(data, offsets, threshold, gram)
            place, sides = _placed(batch, offsets, "place"), _placed(batch, offsets, "sides")
            cuts = range(0, len(place), 20_000)
            start = np.unique(np.concatenate([sample.strings(place[i : i + 20_000], sides[i : i + 20_000]) for i in cuts]))
            text = sample.text_of(start)
            at = start - offsets[text] + (batch.column(1).to_numpy()[text] << _PLACE_BITS)
            doc = batch.column(0).to_numpy()[text]
            head, tail = (sample.names.of(start + a, start + a + 2 * gram) for a in (0, threshold - 2 * gram))
            name, more = mix(head + mix(tail)), (mix(tail ^ (head >> np.uint64(7))) >> np.uint64(32)).astype(np.uint32)
            order = np.lexsort((at, doc, more, name))
            doc, at, name, more = doc[order], at[order], name[order], more[order]
            again = np.zeros(len(order), bool)
            again[1:] = (name[1:] == name[:-1]) & (more[1:] == more[:-1])
            first = np.maximum.accumulate(np.where(again, 0, np.arange(len(order))))
            same = again & (doc == doc[first]) & (at == at[first])  # a repeated row, not a repeat
            new = ~again
            columns = [pa.array(doc[new]), pa.array(at[new]), _long(name[new]), pa.array(more[new].view(np.int32)), pa.nulls(int(new.sum()), pa.int32())]
            yield pa.RecordBatch.from_arrays(columns, _fields(_STRINGS))
            doc, at = doc[again & ~same], at[again & ~same]
            order = np.lexsort((at, doc))
            doc, at = doc[order], at[order]
            opens = np.flatnonzero(np.append(True, (doc[1:] != doc[:-1]) | (at[1:] > at[:-1] + 1))) if len(at) else np.zeros(0, np.int64)
            if len(opens):
                last = np.append(opens[1:], len(at)) - 1
                run = pa.array((at[last] - at[opens] + 1).astype(np.int32))
                none = pa.nulls(len(opens), pa.int64()), pa.nulls(len(opens), pa.int32())
                yield pa.RecordBatch.from_arrays([pa.array(doc[opens]), pa.array(at[opens]), *none, run], _fields(_STRINGS))

    return _with_places(texts, is_open).mapInArrow(work, _STRINGS)


def _doubled(strings: DataFrame) -> DataFrame:
    """Strings that also start earlier, as doc, at, run: of equal ranks the first position stays."""
    ranked = Window.partitionBy("name", "more").orderBy("doc", "at")
    first = F.first(F.struct("doc", "at")).over(ranked)
    sorted_ranks = strings.where("run IS NULL").drop("run").withColumn("first", first)
    repeated = sorted_ranks.where(F.struct("doc", "at") != F.col("first")).select("doc", "at", F.lit(1).alias("run"))
    return repeated.unionByName(strings.where("run IS NOT NULL").select("doc", "at", "run"))


def remove_repeats(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: int = THRESHOLD, gram: int = GRAM
) -> DataFrame:
    """Texts without the bytes of strings of `threshold` bytes that also start earlier.

    One row per input row: id, n_bytes, spans (array of start and end of each
    maximal removed run, in bytes), kept (binary, what is left). Texts are UTF-8;
    a string starts earlier in a row of smaller id or earlier in the same row.
    Strings are judged on the input and do not cross rows.

    Prefix doubling ranks strings by pairs of ranks of their parts. Ranking every
    position would move many times the input, so the first round ranks a sample:
    of the grams in each `threshold` bytes that of the smallest name. Spark sorts
    their pairs of ranks, gram and context (all strings around it). Equal pairs
    are repeats as a whole and unique grams drop out. Around grams with several
    contexts the second round sorts the names of the gram with the bytes after and
    before it that every string of its half holds, about twice the length, and
    unique ones drop out again. What is left the last round sorts as strings, in
    pairs of doubled grams. Ranks are names: hashes of 64 bits, and whatever is
    removed has been compared by more than one.

    Null texts are empty; texts shorter than `threshold` lose nothing. A null id
    is smaller than any other. Rows that share an id are in the order of their
    texts' hashes; rows equal in both are one document, returned each. An empty
    table gives an empty result. Other columns are not read.
    """
    if not 2 * gram <= threshold <= 4 * gram:
        raise ValueError("threshold must be two to four grams")
    data = F.encode(F.coalesce(F.col(text_col), F.lit("")), "utf-8")
    tie = F.lit(0).cast("long")
    if not docs.groupBy(id_col).count().where("count > 1").isEmpty():
        tie = F.shiftrightunsigned(F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))), _PLACE_BITS + 1)
    texts = docs.select(
        F.coalesce(F.col(id_col).cast("long"), F.lit(_NULL)).alias("doc"), tie.alias("tie"), data.alias("bytes"), F.col(id_col).alias("id")
    )
    large = texts.where(F.octet_length("bytes") >= threshold).select("doc", "tie", "bytes")
    ranked = stage(_ranked(large, threshold, gram), "repeat-ranks")
    decided = stage(_decided(ranked), "repeat-decided")
    drop_staged(ranked)
    halves = stage(_halves(large, decided.where("open"), threshold, gram), "repeat-halves")
    is_open = stage(_repeated_halves(halves), "repeat-open")
    drop_staged(halves)
    strings = stage(_strings(large, is_open, threshold, gram), "repeat-strings")
    drop_staged(is_open)
    found = stage(_doubled(strings), "repeat-fresh")
    drop_staged(strings)
    place = F.col("at").bitwiseAND(F.lit((1 << _PLACE_BITS) - 1))
    known = decided.where("NOT open").select("doc", "at", (place - F.col("left")).alias("start"), (place + F.col("right")).alias("end"))
    fresh = found.select("doc", "at", place.alias("start"), (place + F.col("run") - 1 + threshold).alias("end"))
    spans = (
        known.unionByName(fresh)
        .groupBy("doc", F.shiftright("at", _PLACE_BITS).alias("tie"))
        .agg(F.collect_list("start").alias("starts"), F.collect_list("end").alias("ends"))
    )
    spans = stage(spans, "repeat-spans").select(F.col("doc").alias("_doc"), F.col("tie").alias("_tie"), "starts", "ends")
    drop_staged(decided)
    drop_staged(found)
    joined = texts.join(spans, (F.col("doc") == F.col("_doc")) & (F.col("tie") == F.col("_tie")), "left")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[list] = [[], [], [], []]
            ids, texts, starts, ends = (c.to_pylist() for c in batch.columns)
            for i, text in enumerate(texts):
                depth = np.zeros(len(text) + 1, np.int32)
                np.add.at(depth, np.array(starts[i] or [], np.int64), 1)
                np.add.at(depth, np.array(ends[i] or [], np.int64), -1)
                gone = np.cumsum(depth)[:-1] > 0
                edges = np.flatnonzero(np.diff(np.concatenate([[0], gone, [0]])))
                rows[0].append(ids[i])
                rows[1].append(len(text))
                rows[2].append([{"start": int(a), "end": int(b)} for a, b in zip(edges[::2], edges[1::2])])
                rows[3].append(np.frombuffer(text, np.uint8)[~gone].tobytes())
            span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            types = [pa.int64(), pa.int64(), span, pa.binary()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(r, t) for r, t in zip(rows, types)], ["id", "n_bytes", "spans", "kept"]
            )

    columns = joined.select(F.col("id").cast("long").alias("id"), "bytes", "starts", "ends")
    return columns.mapInArrow(work, "id long, n_bytes long, spans array<struct<start: long, end: long>>, kept binary")
