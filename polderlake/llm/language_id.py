"""Language identification by Bayesian fusion of four kinds of evidence.

* Text: letter trigrams, hashed, with one multinomial for each language. Trained on a bounded sample of documents that
  declare a language (`TRAIN_PER_LANGUAGE` of each, chosen by a hash), whole texts.
* Declared language: how often documents of a language declare each value.
* Address suffix: how often documents of a language have each suffix.
* Host: the share of each language on the host, smoothed by the share on its domain, that by its suffix, that by all.

The last three are sums over all documents of what their texts alone suggest, made by grouped aggregation. A document's
own part is taken out before its evidence is weighed, so that it doesn't confirm itself.

Every declared tag is a language, so nothing is as wide as their number but one list of sums: the trigram table holds
what occurs, a document its candidates (languages within `CANDIDATE_NATS` of the likeliest by its text), a host or tag
rows of (value, language, share) for shares of `LEAST_SHARE` and more.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from polderlake.llm.frames import Sent, bounded_sample, chunks, pieces, stored
from polderlake.session import freeze

BUCKETS = 1 << 15
TRAIN_PER_LANGUAGE = 400
#: Scores (texts times languages) that a task holds at a time.
SCORES = 1_000_000
#: Rows, of a tag and a number each, that are broadcast.
SENT_ROWS = 100_000
#: Letters that are looked up at a time.
LETTERS = 1 << 15
#: A language that a text makes e**-40 times as likely as another is no candidate for it, whatever else speaks for it.
CANDIDATE_NATS = 40.0
#: Shares of a document below this one suggest nothing about its host.
LEAST_SHARE = 1e-3
#: Letters whose evidence counts in full; neighbouring trigrams are not independent, so longer texts are scaled down.
FULL_LETTERS = 100
#: Documents that the next level of the host hierarchy counts for.
SMOOTHING = 20.0
ALPHA = 0.5
MIN_POSTERIOR = 0.5
#: A text this much (natural log, in all) less likely than even odds for every trigram is in none of the languages.
FOREIGN = -30.0
CHUNK_BYTES = 400_000


def trigrams(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of the trigram around every letter of all texts, and the texts' first positions (one more at the end)."""
    packed = [f" {text.lower()} " if text else " " for text in texts]
    points = np.frombuffer("".join(packed).encode("utf-32-le", "surrogatepass"), dtype="<u4")
    letter = ((points >= 97) & (points <= 122)) | ((points >= 0xC0) & (points != 0xD7) & (points != 0xF7) & ((points < 0x2000) | (points > 0x206F)))
    chars = np.where(letter, points, 32).astype(np.uint64)
    mixed = chars[:-2] * np.uint64(0x9E3779B97F4A7C15) + chars[1:-1] * np.uint64(0xC2B2AE3D27D4EB4F) + chars[2:] * np.uint64(0x165667B19E3779F9)
    buckets = ((mixed ^ (mixed >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(49)).astype(np.int64) if len(mixed) else np.zeros(0, np.int64)
    at = np.flatnonzero(letter[1:-1]) if len(points) > 2 else np.zeros(0, np.int64)
    begins = np.concatenate([[0], np.cumsum([len(p) for p in packed])])
    return buckets[at], np.searchsorted(at + 1, begins)


@dataclass
class TextModel:
    """Trigram log-likelihoods against even odds: one for what a language never showed, and the difference for what it did."""

    unseen: np.ndarray
    first: np.ndarray
    language: np.ndarray
    more: np.ndarray

    @classmethod
    def of(cls, buckets: np.ndarray, language: np.ndarray, n: np.ndarray, languages: int) -> TextModel:
        """From the counts of each bucket and language that occur."""
        total = np.bincount(language, n, languages) + ALPHA * BUCKETS
        order = np.lexsort((language, buckets))
        first = np.searchsorted(buckets[order], np.arange(BUCKETS + 1))
        return cls(np.log(ALPHA / total * BUCKETS), first, language[order].astype(np.int32), np.log1p(n[order] / ALPHA).astype(np.float32))

    def scores(self, buckets: np.ndarray, first: np.ndarray) -> np.ndarray:
        """A row for each text; `first` has the texts' first positions in `buckets`."""
        out = np.diff(first)[:, None] * self.unseen
        for start in range(0, len(buckets), LETTERS):
            part = buckets[start : start + LETTERS]
            low = int(np.searchsorted(first, start, "right")) - 1
            owner = np.searchsorted(first, np.arange(start, start + len(part)), "right") - 1 - low
            which, times = np.unique(owner * BUCKETS + part, return_counts=True)
            owner, bucket = which // BUCKETS, which % BUCKETS
            held = self.first[bucket + 1] - self.first[bucket]
            at = np.arange(held.sum()) - np.repeat(np.cumsum(held) - held, held) + np.repeat(self.first[bucket], held)
            texts = int(owner[-1]) + 1
            place = np.repeat(owner, held) * len(self.unseen) + self.language[at]
            seen = np.bincount(place, self.more[at] * np.repeat(times, held), texts * len(self.unseen))
            out[low : low + texts] += seen.reshape(texts, len(self.unseen))
        return out


def score_texts(texts: list[str | None], model: TextModel) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(letters, log-likelihood in each language against even odds) of some texts at a time, in order."""
    step = max(1, SCORES // max(len(model.unseen), 1))
    for start in range(0, len(texts), step):
        buckets, first = trigrams(texts[start : start + step])
        yield np.diff(first), model.scores(buckets, first)


def _sent_if_small(table: DataFrame, rows: int) -> DataFrame:
    """A table with a row for each language, as it is sent to the tasks: up to `SENT_ROWS`; a longer one is joined by a shuffle."""
    return F.broadcast(table) if rows <= SENT_ROWS else table


def train(docs: DataFrame, column: str, declared: str, id_column: str, per_language: int = TRAIN_PER_LANGUAGE) -> tuple[list[str], TextModel]:
    """Languages and their trigrams, from a bounded sample of documents that declare one.

    Every tag that is declared is a language: the table grows with the trigrams that its sample shows.
    """
    language = _tag(F.col(declared))
    labelled = docs.where(F.col(column).isNotNull()).select(F.col(id_column).alias("id"), F.col(column).alias("text"), language.alias("language")).where("language is not null")
    counts = labelled.groupBy("language").count().collect()
    languages = sorted(row["language"] for row in counts)
    if not languages:
        return [], TextModel.of(*[np.zeros(0, np.int64)] * 3, 0)
    share = docs.sparkSession.createDataFrame([(row["language"], float(row["count"])) for row in counts], "language string, declared double")
    # The smallest of uniform draws times a language's count: about as many documents of each, however common it is.
    weighed = labelled.join(_sent_if_small(share, len(languages)), "language")
    draw = F.pmod(F.xxhash64("id", "text"), F.lit(1 << 40)) * F.col("declared")
    sample = bounded_sample(weighed, draw, per_language * len(languages)).drop("declared")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "text", CHUNK_BYTES):
            names = np.array(batch.column("language").to_pylist(), dtype=object)
            buckets, first = trigrams(batch.column("text").to_pylist())
            owner = np.repeat(np.arange(batch.num_rows), np.diff(first))
            for name in set(names.tolist()):
                n = np.bincount(buckets[(names == name)[owner]], minlength=BUCKETS)
                used = np.flatnonzero(n)
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(used), pa.string()), pa.array(used, pa.int64()), pa.array(n[used], pa.int64())], ["language", "bucket", "n"])

    summed = sample.mapInArrow(count, "language string, bucket long, n long").groupBy("language", "bucket").agg(F.sum("n").alias("n"))
    place = docs.sparkSession.createDataFrame([(name, i) for i, name in enumerate(languages)], "language string, number int")
    found = summed.join(_sent_if_small(place, len(languages)), "language").select("bucket", "number", "n").toArrow()
    return languages, TextModel.of(*(found.column(name).to_numpy().astype(np.int64) for name in ("bucket", "number", "n")), len(languages))


def _tag(value: Column) -> Column:
    """`EN-us ` as `en`; null if nothing is declared."""
    tag = F.regexp_extract(F.lower(F.trim(value)), "^[a-z]+", 0)
    return F.when(tag != "", tag)


def _host(address: Column) -> Column:
    host = F.lower(F.regexp_extract(address, r"^(?:[^:/?#]+://)?([^/?#:]*)", 1))
    return F.when(host != "", host)


RESULT = ("language", "posterior", "text_language", "accepted")


def identify(docs: DataFrame, *, column: str = "text", id_column: str = "doc_id", declared: str = "lang", address: str = "source", min_posterior: float = MIN_POSTERIOR) -> DataFrame:
    """(id, language, posterior, text_language, accepted) for each row of `docs`.

    `address` is a URL or a host name; its host, domain (last two labels) and suffix (last label, if there are several)
    are evidence. Evidence that is null or empty weighs nothing. A document is rejected if its text has no letter, if it
    is far less likely in every language than even odds, or if no language reaches `min_posterior`; a text without
    letters has language null and posterior 0, and suggests nothing. Without any declared language nothing can be trained:
    all are rejected. Ties go to the language first in the alphabet. Rows are kept one by one, repeated ones too.
    """
    return _identified(docs, column, id_column, declared, address, min_posterior).drop("_row")


def _row_hash(*columns: str) -> Column:
    """A hash of the columns in which a null differs from any text."""
    return F.xxhash64(*[F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("null")) for c in columns])


def _identified(docs: DataFrame, column: str, id_column: str, declared: str, address: str, min_posterior: float) -> DataFrame:
    """The result, with a hash of all that a row's decision rests on in `_row`."""
    spark = docs.sparkSession
    languages, model = train(docs, column, declared, id_column)
    host = _host(F.col(address))
    labels = F.split("host", r"\.")
    source = docs.select(
        F.col(id_column).alias("id"), _row_hash(column, declared, address).alias("_row"), F.col(column).cast("string").alias("text"), _tag(F.col(declared)).alias("declared"), host.alias("host")
    )
    scored = stored(_scored(source, Sent(spark, model)), "language")
    scored = scored.withColumn("labels", labels).withColumn("suffix", F.when(F.size("labels") > 1, F.element_at("labels", -1)))
    scored = scored.withColumn("domain", F.when(F.size("labels") > 2, F.concat_ws(".", F.slice("labels", -2, 2)))).drop("labels")
    size = len(languages)
    # One aggregation for all kinds of evidence, and for the sums over all documents.
    evidence = F.array(*[F.struct(F.lit(value).alias("kind"), F.col(value).alias("value")) for value in _VALUES], F.struct(F.lit("all").alias("kind"), F.lit("").alias("value")))
    told = scored.select(F.explode(evidence).alias("e"), F.arrays_zip("candidates", "shares").alias("s")).where(F.col("e.value").isNotNull())
    told = told.select("e.kind", "e.value", F.explode("s").alias("s")).where(F.col("s.shares") > 0)
    by_language = told.groupBy("kind", "value", F.col("s.candidates").alias("language")).agg(F.sum("s.shares").alias("share"))
    grouped = freeze(by_language.groupBy("kind", "value").agg(F.collect_list("language").alias("languages"), F.collect_list("share").alias("shares")))
    total = np.zeros(size)
    for row in grouped.where(F.col("kind") == "all").collect():
        total[row["languages"]] = row["shares"]
    counted = scored.agg(*[F.count_distinct(value).alias(value) for value in ("suffix", "declared")]).first()
    kinds = {value: counted[value] for value in ("suffix", "declared")}
    for value in _VALUES:
        own = grouped.where(F.col("kind") == value).select(F.col("value").alias("_value"), F.col("languages").alias(f"languages_of_{value}"), F.col("shares").alias(f"shares_of_{value}"))
        scored = scored.join(own, F.col(value) == F.col("_value"), "left").drop("_value")
    return _fused(scored, languages, total, kinds, min_posterior, id_column)


_VALUES = ("host", "domain", "suffix", "declared")


def _scored(source: DataFrame, sent: Sent) -> DataFrame:
    """`source` with, instead of the text: its letters, the likeliest language and its score, and the candidates.

    `logs` are the candidates' scaled scores, `shares` what the text alone suggests: 0 below `LEAST_SHARE`.
    """
    kept = ["id", "_row", "declared", "host"]
    schema = source.select(kept).schema.add("letters", "long").add("by_text", "integer").add("score", "double")
    schema = schema.add("candidates", T.ArrayType(T.IntegerType())).add("logs", T.ArrayType(T.DoubleType())).add("shares", T.ArrayType(T.DoubleType()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.get()
        for part in chunks(batches, "text", CHUNK_BYTES):
            start = 0
            for letters, scores in score_texts(part.column("text").to_pylist(), model):
                rows = part.slice(start, len(letters))
                start += len(letters)
                logs = scores * _scale(letters)[:, None]
                best = scores.argmax(axis=1) if scores.shape[1] else np.zeros(len(letters), np.int64)
                top = logs.max(axis=1, initial=-np.inf, keepdims=True)
                chosen = (logs >= top - CANDIDATE_NATS) & (letters > 0)[:, None]
                odds = np.exp(logs - np.where(np.isfinite(top), top, 0)) * chosen
                shares = odds / np.maximum(odds.sum(axis=1, keepdims=True), 1e-300)
                shares[shares < LEAST_SHARE] = 0
                row, language = np.nonzero(chosen)
                offsets = pa.array(np.searchsorted(row, np.arange(len(letters) + 1)), pa.int32())
                lists = [pa.ListArray.from_arrays(offsets, pa.array(v, k)) for v, k in ((language, pa.int32()), (logs[row, language], pa.float64()), (shares[row, language], pa.float64()))]
                score = scores[np.arange(len(letters)), best] if scores.shape[1] else np.zeros(len(letters))
                yield pa.RecordBatch.from_arrays([*(rows.column(name) for name in kept), pa.array(letters, pa.int64()), pa.array(best, pa.int32()), pa.array(score), *lists], schema.names)

    return source.mapInArrow(run, schema)


def _scale(letters: np.ndarray) -> np.ndarray:
    return np.minimum(1.0, FULL_LETTERS / np.maximum(letters, 1))


def _flat(lists: pa.ListArray) -> np.ndarray:
    return lists.flatten().to_numpy(zero_copy_only=False)


def _fused(scored: DataFrame, languages: list[str], total: np.ndarray, kinds: dict[str, int], min_posterior: float, id_column: str) -> DataFrame:
    schema = scored.select(F.col("id").alias(id_column), "_row").schema.add("language", "string").add("posterior", "double").add("text_language", "string").add("accepted", "boolean")
    size = len(languages)

    def others(batch: pa.RecordBatch, value: str, key: np.ndarray, own: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of the other documents with the same value: whether there is one, the candidate's sum, and the sum of all languages."""
        lists = batch.column(f"languages_of_{value}")
        count = np.asarray(lists.value_lengths().fill_null(0))
        row = np.repeat(np.arange(batch.num_rows), count)
        keys, shares = row * size + _flat(lists), _flat(batch.column(f"shares_of_{value}"))
        order = np.argsort(keys)
        at = np.minimum(np.searchsorted(keys[order], key), max(len(keys) - 1, 0))
        found = shares[order][at] * (keys[order][at] == key) if len(keys) else np.zeros(len(key))
        held = np.asarray(batch.column(value).is_valid())
        whole = np.bincount(row, shares, batch.num_rows) - np.bincount(owner, own, batch.num_rows) * held
        mine = np.where(held[owner], own, 0)
        return held[owner], np.maximum(found - mine, 0), np.maximum(whole, 0)[owner]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in pieces(whole, 2048)):
            n = batch.num_rows
            letters = batch.column("letters").to_numpy()
            candidates = batch.column("candidates")
            owner = np.repeat(np.arange(n), np.asarray(candidates.value_lengths()))
            language, logs, own = (_flat(batch.column(name)) for name in ("candidates", "logs", "shares"))
            key = owner * size + language
            everyone = np.maximum(total[language] - own, 0)
            of_all = np.maximum(total.sum() - np.bincount(owner, own, n), 0)[owner]
            prior = (everyone + 1.0) / (of_all + size)
            evidence = {value: others(batch, value, key, own, owner) for value in _VALUES}
            for level in ("suffix", "domain", "host"):
                _, sums, whole = evidence[level]
                prior = (sums + SMOOTHING * prior) / (whole + SMOOTHING)
            weight = logs + np.log(prior)
            for value in ("declared", "suffix"):
                held, sums, _ = evidence[value]
                weight += np.where(held, np.log((sums + ALPHA) / (everyone + ALPHA * max(kinds[value], 1))), 0)
            names, chosen = [None] * n, np.zeros(n)
            if len(owner):
                filled, first = np.unique(owner, return_index=True)
                top = np.maximum.reduceat(weight, first)
                place = np.searchsorted(filled, owner)
                odds = np.exp(weight - top[place])
                chosen[filled] = 1 / np.add.reduceat(odds, first)
                winners = np.flatnonzero(weight == top[place])
                _, earliest = np.unique(owner[winners], return_index=True)
                for row, number in zip(filled.tolist(), language[winners[earliest]].tolist(), strict=True):
                    names[row] = languages[number]
            accepted = (letters > 0) & (chosen >= min_posterior) & (batch.column("score").to_numpy() >= FOREIGN) & (size > 0)
            by_text = [languages[i] if k and size else None for i, k in zip(batch.column("by_text").to_pylist(), letters, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("_row"), pa.array(names, pa.string()), pa.array(np.round(chosen, 6)), pa.array(by_text, pa.string()), pa.array(accepted)], schema.names)

    return scored.mapInArrow(run, schema)


def accepted_only(docs: DataFrame, *, column: str = "text", id_column: str = "doc_id", declared: str = "lang", address: str = "source", min_posterior: float = MIN_POSTERIOR) -> DataFrame:
    """`docs` without those that are rejected, row by row: another row with the same id stays or goes by its own text."""
    found = _identified(docs, column, id_column, declared, address, min_posterior).where(~F.col("accepted"))
    rejected = found.select(F.col(id_column).alias("_id"), F.col("_row").alias("_rejected")).distinct()
    same = F.col(id_column).eqNullSafe(F.col("_id")) & (_row_hash(column, declared, address) == F.col("_rejected"))
    return docs.join(rejected, same, "left_anti").select(docs.columns)


def declared_in_page(html: Column) -> Column:
    """The language that a page's markup declares."""
    return F.regexp_extract(html, r"""(?is)<html[^>]*?\blang\s*=\s*["']?([a-z-]+)""", 1)


def text_of_page(html: Column) -> Column:
    """A page without scripts, styles, comments and tags: enough to tell its language."""
    return F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->|<[^>]*>", " ")


def identify_pages(pages: DataFrame) -> DataFrame:
    """`identify` for pages: the markup's language, the URL and the text between tags."""
    evidence = pages.select("page_id", "url", declared_in_page(F.col("html")).alias("lang"), text_of_page(F.col("html")).alias("text"))
    return identify(evidence, id_column="page_id", address="url")
