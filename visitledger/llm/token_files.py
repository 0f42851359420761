"""Token ids of documents in Huffman-coded binary files, and reading them back."""

from __future__ import annotations

import json
import os
import re
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache
from math import ceil

import numpy as np
import pyarrow as pa
from pyarrow import fs as arrow_fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from visitledger.llm.packing import WordTokens
from visitledger.llm.runs import chunks
from visitledger.sources.staging import drop_staged, owned_path, stage

TOKENIZER = "word_bpe_49k.json"
END = 1
#: Longest code in bits; a decoding table has 2^MAX_BITS entries.
MAX_BITS = 16
#: Ids between two checkpoints, and ids after which a block ends with its document.
STRIDE = 256
BLOCK_IDS = 1 << 18
#: Bytes after which a file ends with its block, bytes that a reading task gets, in runs of so many blocks.
FILE_BYTES = 128 << 20
READ_BYTES = 16 << 20
READ_BLOCKS = 8
#: Code points tokenised at once.
CHUNK = 1 << 20

MAGIC = b"IDSH\x01"
#: Bytes of a file before and of its footer: see `write_token_files`.
_TAIL = struct.Struct("<QI5s")
_BLOCK = struct.Struct("<QQQII")
_GROUPS = "part int, block long, before long, total long, ids array<long>, counts array<long>, tokens binary"
_FILES = "path string, part int, first_block long, blocks long, ids long, bytes long"


#: Letters of Latin-1, whose lower case is a single letter that no normal form changes.
LETTERS = re.compile("[A-Za-zÀ-ÖØ-öø-ÿ]+")


@lru_cache(maxsize=1)
def piece_ids(path: str) -> PieceIds:
    """One table of known pieces for all tasks of a worker process."""
    return PieceIds(path)


class PieceIds(WordTokens):
    """Ids of texts for a vocabulary that lower-cases and drops white space; each different piece is tokenised once.

    A text is cut only where the vocabulary's normaliser and splitting rule join
    nothing: at ASCII white space, and between a letter or digit of Latin-1 and
    ASCII punctuation other than an apostrophe. The library itself encodes every
    new piece, and whole texts that hold one of its special tokens.
    """

    #: Classes of code points below 256.
    BLANK = (9, 10, 13, 32)
    PUNCTUATION = (*range(33, 39), *range(40, 48), *range(58, 65), *range(91, 97), *range(123, 127))
    PLAIN = (*range(48, 58), *range(65, 91), *range(97, 123), *range(0xC0, 0xD7), *range(0xD8, 0xF7), *range(0xF8, 0x100))

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark gives each task its core
        super().__init__(path)
        special = [x["content"] for x in json.loads(self.tokenizer.to_str())["added_tokens"]]
        self.special = re.compile("|".join(map(re.escape, special)) or r"(?!)")
        self.kinds = np.zeros(257, np.uint8)  # the last is for all other code points
        for kind, members in enumerate((self.BLANK, self.PUNCTUATION, self.PLAIN), 1):
            self.kinds[list(members)] = kind

    def _learn(self, hashes: np.ndarray, words: list[str]) -> None:
        """Words of letters alone go straight to the library's model, other pieces through all its steps."""
        tokenize, letters = self.tokenizer.model.tokenize, self.letters
        ids: list[list[int]] = [[]] * len(words)
        other = []
        for i, word in enumerate(words):
            if LETTERS.fullmatch(word):
                ids[i] = [t.id for t in tokenize(word.lower().encode().decode("latin-1").translate(letters))]
            else:
                other.append(i)
        for i, found in zip(other, self.tokenizer.encode_batch([words[i] for i in other], add_special_tokens=False)):
            ids[i] = found.ids
        self._enter(hashes, ids)

    def _words(self, points: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        kind = self.kinds[np.minimum(points, 256)]
        before, after = kind[:-1], kind[1:]
        start = np.ones(len(points), bool)
        start[1:] = ((before == 1) != (after == 1)) | ((before == 2) & (after == 3)) | ((before == 3) & (after == 2))
        start[offsets[:-1][offsets[:-1] < len(points)]] = True
        return np.flatnonzero(start)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text, as uint32."""
        whole = {i for i, t in enumerate(texts) if self.special.search(t)}
        cut = iter(super().encode([t for i, t in enumerate(texts) if i not in whole]))
        return [
            np.array(self.tokenizer.encode(t, add_special_tokens=False).ids, np.uint32) if i in whole else next(cut)
            for i, t in enumerate(texts)
        ]


def code_lengths(counts: dict[int, int], most: int = MAX_BITS) -> dict[int, int]:
    """Bits of each id in an optimal prefix code with no code over `most` bits (package-merge)."""
    if len(counts) > 1 << most:
        raise ValueError(f"{len(counts)} ids do not fit into codes of {most} bits")
    if len(counts) < 2:
        return dict.fromkeys(counts, 1)
    order = sorted(counts, key=lambda i: (counts[i], i))
    leaves = np.array([counts[i] for i in order], np.int64)
    n = len(order)
    levels: list[np.ndarray] = []  # per level, how many leaves are among its first items
    packages = np.zeros(0, np.int64)
    for _ in range(most):
        merged = np.concatenate([leaves, packages])
        by_weight = np.argsort(merged, kind="stable")
        levels.append(np.cumsum(by_weight < n))
        merged = merged[by_weight][: len(merged) // 2 * 2]
        packages = merged[::2] + merged[1::2]
    lengths = np.zeros(n, np.int64)
    take = 2 * n - 2
    for leaves_among in reversed(levels):
        if not take:
            break
        many = int(leaves_among[take - 1])
        lengths[:many] += 1
        take = 2 * (take - many)
    return dict(zip(order, lengths.tolist()))


class Code:
    """A canonical code: ids in the order of (length, id) have ascending codes."""

    def __init__(self, lengths: dict[int, int]) -> None:
        self.ids = np.array(sorted(lengths, key=lambda i: (lengths[i], i)), np.int64)
        self.lengths = np.array([lengths[i] for i in self.ids.tolist()], np.int64)
        self.most = int(self.lengths.max(initial=1))
        spans = 1 << (self.most - self.lengths)  # entries of the decoding table that begin with a code
        self.codes = (np.cumsum(spans) - spans) >> (self.most - self.lengths)

    def encoder(self) -> tuple[np.ndarray, np.ndarray]:
        """Code and length by id."""
        size = int(self.ids.max(initial=-1)) + 1
        codes, lengths = np.zeros(size, np.uint64), np.zeros(size, np.int64)
        codes[self.ids], lengths[self.ids] = self.codes, self.lengths
        return codes, lengths

    def decoder(self) -> tuple[np.ndarray, np.ndarray]:
        """Id and length by the next `most` bits."""
        spans = 1 << (self.most - self.lengths)
        ids, lengths = np.zeros(1 << self.most, np.uint32), np.ones(1 << self.most, np.int64)
        ids[: spans.sum()], lengths[: spans.sum()] = np.repeat(self.ids, spans), np.repeat(self.lengths, spans)
        return ids, lengths

    def to_bytes(self) -> bytes:
        """The lengths by ascending id, from which the code follows."""
        order = np.argsort(self.ids)
        return zlib.compress(self.ids[order].astype("<u4").tobytes() + self.lengths[order].astype(np.uint8).tobytes())

    @classmethod
    def from_bytes(cls, data: bytes) -> Code:
        raw = zlib.decompress(data)
        many = len(raw) // 5
        return cls(dict(zip(np.frombuffer(raw, "<u4", many).tolist(), np.frombuffer(raw, np.uint8, many, 4 * many).tolist())))


def encode_ids(ids: np.ndarray, codes: np.ndarray, lengths: np.ndarray) -> tuple[bytes, np.ndarray]:
    """The codes of `ids` as big-endian bits, and the bit at which every STRIDE-th id begins."""
    if not len(ids):
        return b"", np.zeros(0, np.int64)
    size = lengths[ids]
    ends = np.cumsum(size)
    at = ends - size
    words = int(ends[-1] + 31) // 32
    wide = codes[ids] << (64 - size - (at & 31)).astype(np.uint64)  # a code lies in two 32-bit words at most
    first = at >> 5
    high, low = wide >> np.uint64(32), wide & np.uint64(0xFFFFFFFF)
    # codes do not overlap, so sums of a word's parts stay below 2^32 and are exact in doubles
    found = np.bincount(first, high, words + 1) + np.bincount(first + 1, low, words + 1)
    return found[:words].astype(">u4").tobytes(), at[::STRIDE]


def decode_ids(data: bytes, checkpoints: np.ndarray, many: int, table: tuple[np.ndarray, np.ndarray], most: int) -> np.ndarray:
    """The `many` ids of a block; from all checkpoints on at the same time, one table look-up per id."""
    if not many:
        return np.zeros(0, np.uint32)
    words = np.append(np.frombuffer(data, ">u4"), [0, 0]).astype(np.uint64)
    windows = (words[:-1] << np.uint64(32)) | words[1:]
    ids, lengths = table
    found = np.zeros((len(checkpoints), STRIDE), np.uint32)
    at = checkpoints.astype(np.int64)
    mask = np.uint64((1 << most) - 1)
    last = many - STRIDE * (len(checkpoints) - 1)
    for step in range(STRIDE):
        if step == last:
            at = at[:-1]
        lanes = len(at)
        if not lanes:
            break
        key = ((windows[at >> 5] >> (64 - most - (at & 31)).astype(np.uint64)) & mask).astype(np.int64)
        found[:lanes, step] = ids[key]
        at = at + lengths[key]
    return found.ravel()[:many]


def _place(uri: str) -> tuple[arrow_fs.FileSystem, str]:
    """The file system and path of a URI in a store that all executors reach."""
    return arrow_fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", uri))


def encoded_documents(docs: DataFrame, id_col: str, text_col: str, tokenizer: str | None, end: int) -> DataFrame:
    """Ids of all documents in ascending order of their id, in groups of whole documents.

    Rows are dealt out by ranges of (id, hash of the text), so that even rows of
    one id spread over tasks. A group says how many ids lie before it in its part.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import public_tokenizers

        pieces = piece_ids(tokenizer or public_tokenizers.path(TOKENIZER))
        dtype = "<u2" if pieces.tokenizer.get_vocab_size() <= 1 << 16 else "<u4"
        part, block, before, total = TaskContext.get().partitionId(), 0, 0, 0
        ids: list[int | None] = []
        counts: list[int] = []
        parts: list[bytes] = []

        def group() -> pa.RecordBatch:
            values = [[part], [block], [before], [total], [ids], [counts], [b"".join(parts)]]
            kinds = [pa.int32(), *[pa.int64()] * 3, pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary()]
            names = ["part", "block", "before", "total", "ids", "counts", "tokens"]
            return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(values, kinds)], names)

        for batch in batches:
            keys, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for some in chunks([len(t or "") for t in texts], CHUNK):
                for key, found in zip(keys[some], pieces.encode([t or "" for t in texts[some]])):
                    ids.append(key)
                    counts.append(len(found) + 1)
                    parts.append(np.append(found, end).astype(dtype).tobytes())
                    total += counts[-1]
                    if total >= BLOCK_IDS:
                        yield group()
                        block, before, total = block + 1, before + total, 0
                        ids, counts, parts = [], [], []
        if ids:
            yield group()

    narrow = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    keyed = narrow.withColumn("tie", F.xxhash64("text"))
    dealt = keyed.repartitionByRange(F.asc_nulls_first("id"), "tie")
    ordered = dealt.sortWithinPartitions(F.asc_nulls_first("id"), "tie", "text")
    return ordered.select("id", "text").mapInArrow(work, _GROUPS)


def _token_counts(groups: DataFrame) -> dict[int, int]:
    """How often each id occurs; as many rows at most as the vocabulary has ids."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        for batch in batches:
            for tokens, many in zip(batch.column(0), batch.column(1).to_pylist()):
                found = np.bincount(_ids(tokens.as_py(), many), minlength=len(total))
                found[: len(total)] += total
                total = found
        ids = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(total[ids], pa.int64())], ["id", "many"])

    counted = groups.select("tokens", "total").mapInArrow(work, "id long, many long")
    return {r["id"]: r["many"] for r in counted.groupBy("id").agg(F.sum("many").alias("many")).collect()}


def _ids(data: bytes, many: int) -> np.ndarray:
    """Stored ids, of two or four bytes each."""
    return np.frombuffer(data, "<u2" if len(data) == 2 * many else "<u4").astype(np.int64)


class _Writer:
    """One file: magic, blocks, footer, tail.

    A block is the ids of its documents (null: a set bit in a mask), their counts,
    the checkpoints and the codes. The footer lists for each block where it lies
    and how many documents and ids it has, the ids before it in all files, and the
    code; the tail says where the footer begins and its CRC-32.
    """

    def __init__(self, path: str, part: int, first_block: int) -> None:
        store, place = _place(path)
        store.create_dir(place.rpartition("/")[0], recursive=True)
        self.out = store.open_output_stream(place, compression=None)
        self.path, self.part, self.first_block, self.next_block = path, part, first_block, first_block
        self.entries: list[bytes] = []
        self.ids = 0
        self.out.write(MAGIC)

    def add(self, start: int, docs: list[int | None], counts: list[int], bits: bytes, checkpoints: np.ndarray) -> None:
        total = sum(counts)
        self.entries.append(_BLOCK.pack(self.out.tell(), start, total, len(docs), len(checkpoints)))
        self.out.write(np.array([d or 0 for d in docs], "<i8").tobytes())
        self.out.write(np.array([d is None for d in docs], np.uint8).tobytes())
        self.out.write(np.array(counts, "<u8").tobytes())
        self.out.write(checkpoints.astype("<u8").tobytes())
        self.out.write(bits)
        self.next_block += 1
        self.ids += total

    def close(self, code: bytes) -> tuple:
        at = self.out.tell()
        footer = struct.pack("<I", len(self.entries)) + b"".join(self.entries) + code
        self.out.write(footer + _TAIL.pack(at, zlib.crc32(footer), MAGIC))
        size = self.out.tell()
        self.out.close()
        return self.path, self.part, self.first_block, len(self.entries), self.ids, size


def write_token_files(
    docs: DataFrame,
    folder: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    tokenizer: str | None = None,
    end: int = END,
    max_bits: int = MAX_BITS,
) -> DataFrame:
    """Write the token ids of `docs`, each document's followed by `end`, in ascending order of their id.

    Returns the table of the files, which is stored in `files.parquet` beside
    them: path, part, first_block, blocks, ids, bytes. In the order of (part,
    first_block) they hold the documents in order.
    The ids of the whole corpus are counted first and get one canonical Huffman
    code of at most `max_bits` bits, which every file carries. Blocks hold whole
    documents, decode on their own and have a checkpoint, the bit offset, every
    STRIDE ids. Each attempt of a task writes files of its own name and the
    table lists those that counted, so a repeated task does no harm.

    Null and empty texts are the single id `end`. Null document ids come first,
    rows with one id follow the hash of their text; repeated rows are written each
    on its own. An empty table gives no files. Other columns are not read.
    """
    groups = stage(encoded_documents(docs, id_col, text_col, tokenizer, end), "token-groups")
    counts = _token_counts(groups)
    packed = Code(code_lengths(counts, max_bits)).to_bytes()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, lengths = Code.from_bytes(packed).encoder()
        attempt, file, rows = TaskContext.get().taskAttemptId(), None, []
        for batch in batches:
            for row in batch.to_pylist():
                here = (row["part"], row["block"])
                if file is not None and (here != (file.part, file.next_block) or file.out.tell() >= FILE_BYTES):
                    rows.append(file.close(packed))
                    file = None
                if file is None:
                    file = _Writer(f"{folder}/ids-{here[0]:06d}-{here[1]:08d}-{attempt}.idsh", *here)
                bits, checkpoints = encode_ids(_ids(row["tokens"], row["total"]), codes, lengths)
                file.add(row["start"], row["ids"], row["counts"], bits, checkpoints)
        if file is not None:
            rows.append(file.close(packed))
        columns = list(zip(*rows)) if rows else [[] for _ in range(6)]
        kinds = [pa.string(), pa.int32(), *[pa.int64()] * 4]
        names = ["path", "part", "first_block", "blocks", "ids", "bytes"]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)

    # one row per part, that is, per task that tokenised
    parts = groups.groupBy("part").agg(F.sum("total").alias("many"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = parts.select("part", F.coalesce(F.sum("many").over(before), F.lit(0)).alias("offset"))
    placed = groups.join(F.broadcast(offsets), "part").withColumn("start", F.col("offset") + F.col("before"))
    files = placed.select("part", "block", "start", "total", "ids", "counts", "tokens").mapInArrow(work, _FILES)
    files.write.parquet(f"{folder}/files.parquet")
    drop_staged(groups)
    return docs.sparkSession.read.schema(_FILES).parquet(f"{folder}/files.parquet")


class TokenFile:
    """Reads single blocks of a file."""

    def __init__(self, path: str) -> None:
        store, place = _place(path)
        self.file = store.open_input_file(place)
        size = self.file.size()
        at, crc, magic = _TAIL.unpack(self.file.read_at(_TAIL.size, size - _TAIL.size))
        footer = self.file.read_at(size - _TAIL.size - at, at)
        if magic != MAGIC or zlib.crc32(footer) != crc:
            raise ValueError(f"{path} is not a whole token file")
        (many,) = struct.unpack_from("<I", footer)
        self.blocks = [_BLOCK.unpack_from(footer, 4 + i * _BLOCK.size) for i in range(many)]
        self.ends = [b[0] for b in self.blocks[1:]] + [at]
        code = Code.from_bytes(footer[4 + many * _BLOCK.size :])
        self.table, self.most = code.decoder(), code.most

    def documents(self, block: int) -> Iterator[tuple[int | None, int, np.ndarray]]:
        """Id, number of ids before it in all files, and ids of each document of a block."""
        at, start, total, docs, checkpoints = self.blocks[block]
        data = self.file.read_at(self.ends[block] - at, at)
        keys = np.frombuffer(data, "<i8", docs).tolist()
        nulls = np.frombuffer(data, np.uint8, docs, 8 * docs)
        counts = np.frombuffer(data, "<u8", docs, 9 * docs).astype(np.int64)
        marks = np.frombuffer(data, "<u8", checkpoints, 17 * docs)
        ids = decode_ids(data[17 * docs + 8 * checkpoints :], marks, total, self.table, self.most)
        ends = np.cumsum(counts)
        for key, null, a, b in zip(keys, nulls.tolist(), (ends - counts).tolist(), ends.tolist()):
            yield None if null else key, start + a, ids[a:b]


def read_token_files(files: DataFrame, blocks: int = READ_BLOCKS) -> DataFrame:
    """All documents of `files` (path, blocks): doc_id, start, ids.

    `start` counts the ids of all documents before it; `ids` are 32-bit unsigned
    little-endian integers. Tasks take `blocks` blocks each, wherever these lie.
    No files give an empty result.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path, file = None, None
        for batch in batches:
            for row in batch.to_pylist():
                if row["path"] != path:
                    path, file = row["path"], TokenFile(row["path"])
                for block in range(row["first"], row["last"] + 1):
                    keys, starts, ids = zip(*file.documents(block))
                    columns = [pa.array(keys, pa.int64()), pa.array(starts, pa.int64())]
                    columns.append(pa.array([x.astype("<u4").tobytes() for x in ids], pa.binary()))
                    yield pa.RecordBatch.from_arrays(columns, ["doc_id", "start", "ids"])

    firsts = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1, F.lit(blocks).cast("long")))
    ranges = files.where("blocks > 0").select("path", "blocks", firsts.alias("first"))
    ranges = ranges.select("path", "first", F.least(F.col("blocks") - 1, F.col("first") + blocks - 1).alias("last"))
    size = files.agg(F.sum(F.ceil(F.col("blocks") / blocks)), F.sum("bytes")).first()
    tasks = max(ceil((size[1] or 0) / READ_BYTES), min(size[0] or 1, files.sparkSession.sparkContext.defaultParallelism))
    # a stated count: adaptive execution would merge these few small rows into one task
    return ranges.repartition(tasks, "path", "first").mapInArrow(work, "doc_id long, start long, ids binary")


def round_trip(docs: DataFrame, folder: str | None = None, **options) -> DataFrame:
    """Write the token ids of `docs` to files under `folder` and read them back."""
    folder = folder or owned_path(docs.sparkSession, "tokens")
    return read_token_files(write_token_files(docs, folder, **options))
