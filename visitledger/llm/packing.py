"""Packing token pieces into sequences by harmonic classes."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from visitledger.llm.runs import SPACE, chunks, classes, code_points, run_hashes

#: Tokens of a sequence, and the length below which the rest of a document is not cut any more.
CAPACITY = 1024
LEAST_CUT = 32
TOKENIZER = "byte_bpe_50k.json"
#: Code points tokenised at once, and known words a worker remembers at most.
CHUNK = 2 << 20
KNOWN_WORDS = 3_000_000

PIECES = (
    "{id} long, start long, length long, ids_crc32 long, doc_tokens long, harmonic_class int, sequence_id long, offset long"
)


class WordTokens:
    """Token ids of texts, each different word being tokenised once.

    The vocabulary's own splitting rule never joins characters across the words
    cut here, so the ids of a text are those of its words in turn. The model of
    `tokenizers` gives the ids of every new word; known ones come from a table. A
    worker forgets its table when that holds KNOWN_WORDS words.
    """

    #: Fixed values of the vocabulary's splitting rule: endings cut off after an apostrophe.
    ENDINGS = ("s", "t", "re", "ve", "m", "ll", "d")
    SPECIAL = "<|endoftext|>"

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        # the vocabulary writes a printable byte as itself, the others from U+0100 on
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        hidden = [b for b in range(256) if b not in shown]
        self.letters = {b: b for b in shown} | {b: 256 + i for i, b in enumerate(hidden)}
        self._forget()

    def _forget(self) -> None:
        self.known = np.zeros(0, np.uint64)  # hashes of the known words, sorted
        self.begin = np.zeros(0, np.int64)  # where their ids are in `flat`, and how many
        self.count = np.zeros(0, np.int32)
        self.flat = np.zeros(0, np.uint32)

    def _learn(self, hashes: np.ndarray, words: list[str]) -> None:
        """Tokenise `words` and enter them under their hashes, which are sorted."""
        tokenize, letters = self.tokenizer.model.tokenize, self.letters
        self._enter(hashes, [[t.id for t in tokenize(w.encode().decode("latin-1").translate(letters))] for w in words])

    def _enter(self, hashes: np.ndarray, ids: list[list[int]]) -> None:
        count = np.fromiter(map(len, ids), np.int32, len(ids))
        at = np.searchsorted(self.known, hashes)
        begin = len(self.flat) + np.cumsum(count, dtype=np.int64) - count
        self.known = np.insert(self.known, at, hashes)
        self.begin = np.insert(self.begin, at, begin)
        self.count = np.insert(self.count, at, count)
        self.flat = np.concatenate([self.flat, np.fromiter((x for word in ids for x in word), np.uint32, int(count.sum()))])

    def _words(self, points: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Where words start.

        Runs of letters, of numbers, of white space and of the rest; a single
        space (U+0020) before another run belongs to that run, the last of any
        longer white space before a run is a word of its own.
        """
        n = len(points)
        kind = classes()[points]
        opens = np.zeros(n + 1, bool)
        opens[offsets] = True  # a text starts here
        change = np.ones(n, bool)
        change[1:] = (kind[1:] != kind[:-1]) | opens[1:n]
        last = np.append(change[1:], True)  # last character of its run
        space = kind == SPACE
        ends_text = opens[1:]
        lead = space & last & ~ends_text  # white space right before another run
        start = change.copy()
        start |= lead  # it leaves the white space before it
        blank = lead & (points == 32)
        start[1:] &= ~blank[:-1]  # and, if a blank, takes the next run along
        quote = np.flatnonzero(start & (points == 39))
        for q in quote:  # an apostrophe that opens a word, with one of the endings
            stop = offsets[np.searchsorted(offsets, q, side="right")]
            tail = "".join(map(chr, points[q + 1 : min(q + 3, stop)]))
            for ending in self.ENDINGS:
                if tail.startswith(ending):
                    start[q + 1] = False
                    if q + 1 + len(ending) < stop:
                        start[q + 1 + len(ending)] = True
                    break
        return np.flatnonzero(start)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text, as uint32."""
        odd = {i for i, t in enumerate(texts) if self.SPECIAL in t}
        if odd:
            plain = iter(self.encode([t for i, t in enumerate(texts) if i not in odd]))
            return [
                np.array(self.tokenizer.encode(t, add_special_tokens=False).ids, np.uint32) if i in odd else next(plain)
                for i, t in enumerate(texts)
            ]
        points, offsets = code_points(texts)
        if not len(points):
            return [np.zeros(0, np.uint32) for _ in texts]
        starts = self._words(points, offsets)
        lengths = np.diff(np.append(starts, len(points)))
        different, first, which = np.unique(
            run_hashes(points, starts, lengths), return_index=True, return_inverse=True
        )
        if len(self.known) + len(different) > KNOWN_WORDS:
            self._forget()
        new = np.flatnonzero(~np.isin(different, self.known, assume_unique=True))
        if len(new):
            joined = "".join(texts)
            begin = starts[first[new]]
            end = begin + lengths[first[new]]
            self._learn(different[new], [joined[a:b] for a, b in zip(begin.tolist(), end.tolist())])
        place = np.searchsorted(self.known, different)[which]
        begins, counts = self.begin[place], self.count[place]
        ends = np.cumsum(counts)
        total = int(ends[-1])
        ids = self.flat[np.arange(total) - np.repeat(ends - counts - begins, counts)]
        cuts = np.concatenate([[0], ends])[np.searchsorted(starts, offsets[1:-1])]
        return np.split(ids, cuts)


def cut_lengths(tokens: int, capacity: int = CAPACITY, least: int = LEAST_CUT) -> list[int]:
    """Lengths of the pieces of a document: whole sequences, then halves, quarters, ...

    What is shorter than `least` stays in one piece.
    """
    found = [capacity] * (tokens // capacity)
    rest, part = tokens % capacity, capacity // 2
    while part >= least:
        if rest >= part:
            found.append(part)
            rest -= part
        part //= 2
    return found + [rest] * (rest > 0)


def _power_of_two(n: int) -> bool:
    return n & (n - 1) == 0


class Bins:
    """One worker's open bins.

    A piece of class k, longer than capacity / (k + 1) and at most capacity / k,
    goes to a bin that takes k pieces of that class and is then closed.
    """

    def __init__(self, first_id: int, capacity: int) -> None:
        self.next_id, self.capacity, self.open = first_id, capacity, {}

    def add(self, length: int, row: list) -> Iterator[list]:
        k = self.capacity // length
        rows = self.open.setdefault(k, [])
        rows.append((length, row))
        if len(rows) == k:
            yield from self._close(self.open.pop(k))

    def _close(self, rows: list[tuple[int, list]]) -> Iterator[list]:
        offset = 0
        for length, row in rows:
            yield [*row, self.capacity // length, self.next_id, offset]
            offset += length
        self.next_id += 1

    def finish(self) -> Iterator[list]:
        """What is left in bins that did not fill, under the capacity of one bin per class.

        Pieces of one power of two make sequences of such lengths, which need no
        padding; the others go together, longest first, into the first bin with
        room.
        """
        mixed: list[tuple[int, list]] = []
        for k in sorted(self.open):
            rows = self.open[k]
            even = [x for x in rows if _power_of_two(x[0])] if k < self.capacity // LEAST_CUT + 1 else []
            mixed += [x for x in rows if x not in even] if even else rows
            while even:
                many = 1 << (len(even).bit_length() - 1)
                yield from self._close(even[:many])
                even = even[many:]
        self.open = {}
        bins: list[list[tuple[int, list]]] = []
        room: list[int] = []
        for x in sorted(mixed, key=lambda x: -x[0]):
            i = next((i for i, free in enumerate(room) if free >= x[0]), len(bins))
            if i == len(bins):
                bins.append([])
                room.append(self.capacity)
            bins[i].append(x)
            room[i] -= x[0]
        for rows in bins:
            yield from self._close(rows)


def pack(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    tokenizer: str | None = None,
    capacity: int = CAPACITY,
) -> DataFrame:
    """Pieces of all documents with their places in sequences of `capacity` tokens.

    A document is its token ids and then id 0. It is cut into whole sequences and
    into halves, quarters and so on of one; a rest under LEAST_CUT stays whole.
    By length the pieces fall into harmonic classes, and every task fills the
    bins of its classes on its own, so nothing is shuffled and a task holds one
    open bin per class. Sequences are to be padded to `capacity`, except those
    whose length is a power of two.

    One row per piece: id, start, length, ids_crc32, doc_tokens, harmonic_class,
    sequence_id, offset. Null and empty texts are the single id 0. Repeated rows
    are packed each on its own; null ids stay null. An empty table gives an empty
    result. Other columns of `docs` are not read.

    `tokenizer` is a path that every worker can read; by default the public
    vocabulary that comes with the workers' Python.
    """
    if not _power_of_two(capacity) or capacity < 2 * LEAST_CUT:
        raise ValueError(f"capacity must be a power of two of at least {2 * LEAST_CUT}")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import public_tokenizers

        words = WordTokens(tokenizer or public_tokenizers.path(TOKENIZER))
        bins = Bins(TaskContext.get().partitionId() << 40, capacity)
        names = [f.strip().split(" ")[0] for f in PIECES.format(id="id").split(",")]
        types = [pa.int64()] * 5 + [pa.int32()] + [pa.int64()] * 2

        def table(rows: list[list]) -> pa.RecordBatch:
            columns = list(zip(*rows)) if rows else [[] for _ in names]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names)

        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for part in chunks([len(t or "") for t in texts], CHUNK):
                rows: list[list] = []
                for doc, tokens in zip(ids[part], words.encode([t or "" for t in texts[part]])):
                    data = memoryview(np.append(tokens, np.uint32(0)).astype("<u4")).cast("B")
                    start, total = 0, len(tokens) + 1
                    for length in cut_lengths(total, capacity):
                        crc = zlib.crc32(data[4 * start : 4 * (start + length)])
                        rows.extend(bins.add(length, [doc, start, length, crc, total]))
                        start += length
                if rows:
                    yield table(rows)
        yield table(list(bins.finish()))

    narrow = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return narrow.mapInArrow(work, PIECES.format(id="id"))
