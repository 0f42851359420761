"""Language identification: known words first, then shorter and shorter n-grams."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from visitledger.llm.runs import LETTER, chunks, code_points, powers, run_hashes, sealed, words_of
from visitledger.sources.staging import stage

#: The model is fitted on so many different texts of each language at most, chosen by
#: a hash, and of so many languages, the most frequent ones. This alone bounds it: all
#: words and n-grams of these texts are kept.
DOCS_PER_LANGUAGE = 1500
LANGUAGES = 500
LENGTHS = (5, 4, 3, 2, 1)
#: Added to every count.
SMOOTHING = 0.1
CHUNK = 1 << 20
UNKNOWN = "und"


def held_out(id_col: Column) -> Column:
    """Whether crc32 of the id as text leaves 1 on division by 3; a null id does not."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 3 == 1, F.lit(False))


@dataclass
class Table:
    """Log frequencies by language of hashed words or n-grams, sorted by hash."""

    hashes: np.ndarray
    logs: np.ndarray

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row of each hash and whether it is known."""
        if not len(self.hashes):
            return np.zeros(len(hashes), np.int64), np.zeros(len(hashes), bool)
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        return at, self.hashes[at] == hashes


@dataclass
class Model:
    languages: list[str]
    prior: np.ndarray
    words: Table
    grams: dict[int, Table]

    def unseen(self, points: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Scores of unseen words: the mean over their known n-grams, of the longest n that has any."""
        scores = np.zeros((len(starts), len(self.languages)))
        left = np.arange(len(starts))
        for n in LENGTHS:
            fits = left[ends[left] - starts[left] >= n]
            many = ends[fits] - starts[fits] - n + 1
            if not many.sum():
                continue
            word = np.repeat(np.arange(len(fits)), many)
            place = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + starts[fits][word]
            total = np.zeros(len(place), np.uint64)
            for j, power in enumerate(powers(n)):
                total += (points[place + j].astype(np.uint64) + np.uint64(1)) * power
            at, known = self.grams[n].find(sealed(total, np.uint64(n)))
            if not known.any():
                continue
            word, logs = word[known], self.grams[n].logs[at[known]]
            found = np.bincount(word, minlength=len(fits))
            sums = np.stack([np.bincount(word, c, len(fits)) for c in logs.T], axis=1)
            done = found > 0
            scores[fits[done]] = sums[done] / found[done, None]
            left = np.setdiff1d(left, fits[done], assume_unique=True)
        return scores

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        """Language of each text and its posterior probability; `und` and 0 without letters."""
        texts = [t.lower() for t in texts]
        text, hashes, starts, ends = words_of(texts, (LETTER,))
        scores = np.tile(np.log(self.prior), (len(texts), 1)) if len(self.languages) else np.zeros((len(texts), 0))
        if len(hashes) and len(self.languages):
            points, _ = code_points(texts)
            different, first, which = np.unique(hashes, return_index=True, return_inverse=True)
            at, known = self.words.find(different)
            table = np.zeros((len(different), len(self.languages)))
            table[known] = self.words.logs[at[known]]
            new = first[~known]
            table[~known] = self.unseen(points, starts[new], ends[new])
            for i, column in enumerate(table.T):
                scores[:, i] += np.bincount(text, column[which], len(texts))
        letters = np.bincount(text, minlength=len(texts)) > 0
        if not len(self.languages):
            return [UNKNOWN] * len(texts), np.zeros(len(texts))
        best = scores.argmax(axis=1)
        odds = np.exp(scores - scores.max(axis=1, keepdims=True))
        share = odds.max(axis=1) / odds.sum(axis=1)
        return [self.languages[b] if ok else UNKNOWN for b, ok in zip(best, letters)], np.where(letters, share, 0.0)


def _table(counted: DataFrame, languages: list[str]) -> Table:
    """All tokens of `counted` (token, one count per language)."""
    rows = counted.toArrow()
    counts = np.stack([rows.column(f"n{i}").to_numpy() for i in range(len(languages))], axis=1).astype(np.float64)
    hashes = [np.zeros(0, np.uint64)]
    for batch in rows.select(["token"]).to_batches(50_000):
        points, offsets = code_points(batch.column(0).to_pylist())
        hashes.append(run_hashes(points, offsets[:-1], np.diff(offsets)))
    found = np.concatenate(hashes)
    logs = np.log((counts + SMOOTHING) / (counts.sum(axis=0) + SMOOTHING * max(1, len(found))))
    order = np.argsort(found)
    return Table(found[order], logs[order])


def _drawn(labelled: DataFrame) -> DataFrame:
    """At most DOCS_PER_LANGUAGE different texts of each language, each of them once.

    Texts are ranked by a hash; of copies only the hash is counted, so a text that
    a language repeats takes one place. Spark keeps that many per task before the
    shuffle.
    """
    hashed = labelled.withColumn("hash", F.xxhash64("text"))
    order = Window.partitionBy("lang").orderBy("hash")
    ranked = hashed.select("lang", "hash").distinct().withColumn("place", F.row_number().over(order))
    places = ranked.where(F.col("place") <= DOCS_PER_LANGUAGE).select("lang", "hash")
    # at most LANGUAGES * DOCS_PER_LANGUAGE rows of two narrow columns
    drawn = hashed.join(F.broadcast(stage(places, "language-drawn")), ["lang", "hash"])
    return drawn.groupBy("lang", "hash").agg(F.min("text").alias("text")).select("lang", "text")


def fit(labelled: DataFrame) -> Model:
    """Fit on `labelled` (text, lang), whose rows are all allowed to be learned from.

    Learns from DOCS_PER_LANGUAGE different texts of each of the LANGUAGES most
    frequent languages, so that the model and the time to fit it do not grow with
    the table. Words and n-grams are counted by Spark, and all of them come back.
    The prior counts all rows.
    """
    labelled = labelled.where("lang IS NOT NULL AND text IS NOT NULL").select("lang", "text")
    top = labelled.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(LANGUAGES)
    many = {r["lang"]: r["count"] for r in top.collect()}
    languages = sorted(many)
    if not languages:
        return Model([], np.zeros(0), Table(np.zeros(0, np.uint64), np.zeros((0, 0))), {})
    chosen = _drawn(labelled.where(F.col("lang").isin(languages)))
    counts = [F.sum(F.when(F.col("lang") == k, F.col("many")).otherwise(0)).alias(f"n{i}") for i, k in enumerate(languages)]
    words = (
        chosen.select("lang", F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"\p{L}+"), F.lit(0))).alias("token"))
        .withColumn("many", F.lit(1))
        .groupBy("token")
        .agg(*counts)
    )
    words = stage(words, "language-words")
    grams = {}
    for n in LENGTHS:
        cut = F.expr(f"transform(sequence(1, length(token) - {n - 1}), i -> substring(token, i, {n}))")
        cuts = words.where(F.length("token") >= n).select(F.explode(cut).alias("token"), *[f"n{i}" for i in range(len(languages))])
        sums = [F.sum(f"n{i}").alias(f"n{i}") for i in range(len(languages))]
        grams[n] = _table(cuts.groupBy("token").agg(*sums), languages)
    prior = np.array([many[k] for k in languages], float)
    return Model(languages, prior / prior.sum(), _table(words, languages), grams)


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Language of every text: id, lang_pred, score.

    Known words count with their log frequency in each language; an unseen word
    with that of its n-grams of the largest length of which any is known. Only
    the text matters. Null texts and texts without letters are `und` with score
    0; so is everything if nothing could be learned. Words of which not even a
    letter is known count nothing. Repeated rows are answered each, and an empty
    table gives an empty result.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for part in chunks([len(t) for t in texts], CHUNK):
                found, scores = shared.value.predict(texts[part])
                ids = batch.column(0)[part.start : part.stop]
                yield pa.RecordBatch.from_arrays([ids, pa.array(found), pa.array(scores)], ["id", "lang_pred", "score"])

    narrow = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return narrow.mapInArrow(work, "id long, lang_pred string, score double")
