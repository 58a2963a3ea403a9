"""LM scoring with a log-bilinear neural model trained by noise-contrastive estimation.

Tokens fall into classes: the `SHORTLIST` most frequent words, the end of a text, and buckets of all other words by their
last bytes. The model predicts the class of a token from the input classes of the two tokens before it. A predicted
vector is the sum of the two context vectors, each weighed by its position; a class scores its inner product with it
plus a bias. A token's probability is that of its class times its share of the class, from counts of the whole corpus.

Every training document is read once by gradient steps in numpy. Tasks start from one model, fitted to a bounded sample,
and their results are averaged by the tokens they read. The normalising sum over classes is then worked out for every
pair of input classes by matrix products, so that probabilities add up to 1.

Counts are kept by 64-bit word hash. Words that make up at least one token in `HEAD_SHARE` (no more than so many words)
go to the tasks; the rest of a text's words meet their counts in a join.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from polderlake.llm.frames import Sent, bounded_sample, chunks, stored
from polderlake.llm.words import byte_class, words_of

IN_WORD = byte_class([(0x09, 0x0D), (0x20, 0x20)])
END = 0x5EED0F7E47
SHORTLIST = 1023
INPUT_WORDS = 127
BUCKETS = 256
INPUT_BUCKETS = 128
DIMENSIONS = 32
NOISE = 64
BATCH = 1024
RATE = 0.08
SAMPLE_DOCUMENTS = 1000
HEAD_SHARE = 1_000_000
SMOOTH = 0.1
CHUNK_BYTES = 600_000
_PIECE = 2048
CLASSES = 1 + SHORTLIST + BUCKETS
INPUTS = 1 + INPUT_WORDS + INPUT_BUCKETS


@dataclass
class Tokens:
    """The tokens of some texts, one after the other, each text's words and then its end."""

    hash: np.ndarray
    bucket: np.ndarray
    text: np.ndarray


def tokens_of(texts: list[str | None]) -> Tokens:
    words = words_of(texts, IN_WORD)
    n = len(words.start) + len(texts)
    ends = words.first[1:] + np.arange(len(texts))
    is_word = np.ones(n, dtype=bool)
    is_word[ends] = False
    hashes = np.full(n, END, dtype=np.int64)
    hashes[is_word] = words.hash.view(np.int64)
    last = words.data[words.end - 1].astype(np.int64) if len(words.start) else np.zeros(0, np.int64)
    before = np.where(words.end - words.start > 1, words.data[np.maximum(words.end - 2, 0)], 0).astype(np.int64) if len(words.start) else last
    bucket = np.zeros(n, dtype=np.int64)
    bucket[is_word] = (last * 37 + before * 11) % BUCKETS
    return Tokens(hashes, bucket, np.repeat(np.arange(len(texts)), words.counts + 1))


@dataclass
class Counts:
    """What the tasks know of the corpus: the head words with their counts, the shortlist, and sums by bucket."""

    total: int
    distinct: int
    head: np.ndarray
    head_count: np.ndarray
    short: np.ndarray
    short_class: np.ndarray
    bucket_total: np.ndarray
    bucket_distinct: np.ndarray
    class_count: np.ndarray

    @property
    def base_divisor(self) -> float:
        return self.total + SMOOTH * (self.distinct + 1)

    @property
    def bucket_divisor(self) -> np.ndarray:
        return self.bucket_total + SMOOTH * (self.bucket_distinct + 1)

    def classes(self, tokens: Tokens) -> tuple[np.ndarray, np.ndarray]:
        """Class and input class of each token; 0 is the end, which also stands before a text."""
        out = 1 + SHORTLIST + tokens.bucket
        inner = 1 + INPUT_WORDS + tokens.bucket % INPUT_BUCKETS
        if len(self.short):
            at = np.minimum(np.searchsorted(self.short, tokens.hash), len(self.short) - 1)
            listed = self.short[at] == tokens.hash
            out[listed] = self.short_class[at[listed]]
            frequent = listed & (out <= INPUT_WORDS)
            inner[frequent] = out[frequent]
        end = tokens.hash == END
        out[end] = inner[end] = 0
        return out, inner

    def context(self, tokens: Tokens, inner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Input classes of the token before each and of the one before that."""
        one = np.concatenate([[0], inner[:-1]])
        two = np.concatenate([[0, 0], inner[:-2]])[: len(inner)]
        two[one == 0] = 0
        return one, two


class LogBilinear:
    """Context vectors, position weights, class vectors and biases."""

    def __init__(self, class_count: np.ndarray, seed: int = 7):
        rng = np.random.default_rng(seed)
        share = (class_count + SMOOTH) / (class_count + SMOOTH).sum()
        self.noise = share
        self.context = rng.normal(0, 0.1, (INPUTS, DIMENSIONS)).astype(np.float32)
        self.position = np.ones((2, DIMENSIONS), np.float32)
        self.target = rng.normal(0, 0.1, (CLASSES, DIMENSIONS)).astype(np.float32)
        self.bias = np.log(share).astype(np.float32)
        #: Sums of squared gradients, by which steps get smaller; they are averaged and carried on like the rest.
        self.past = [np.full_like(p, 1e-2) for p in self.parameters()]

    def parameters(self) -> list[np.ndarray]:
        return [self.context, self.position, self.target, self.bias]

    def flat(self) -> np.ndarray:
        return np.concatenate([p.ravel() for p in [*self.parameters(), *self.past]])

    def load(self, flat: np.ndarray) -> None:
        at = 0
        for p in [*self.parameters(), *self.past]:
            p[...] = flat[at : at + p.size].reshape(p.shape)
            at += p.size

    def _move(self, which: int, gradient: np.ndarray, rows: np.ndarray | None = None) -> None:
        p, past = self.parameters()[which], self.past[which]
        at = slice(None) if rows is None else rows
        past[at] += gradient**2
        p[at] += RATE * gradient / np.sqrt(past[at])

    def learn(self, target: np.ndarray, one: np.ndarray, two: np.ndarray, rng: np.random.Generator) -> None:
        """Gradient steps on the contrast of each token's class with noise classes that a batch shares."""
        log_noise = np.log(NOISE * self.noise).astype(np.float32)
        cumulative = np.cumsum(self.noise)
        for start in range(0, len(target), BATCH):
            t, a, b = (x[start : start + BATCH] for x in (target, one, two))
            drawn = np.minimum(np.searchsorted(cumulative, rng.random(NOISE)), CLASSES - 1)
            first, second = self.context[a], self.context[b]
            hidden = first * self.position[0] + second * self.position[1]
            own = self.target[t]
            # 1 minus the probability that the token is data, and the probability that noise is taken for data.
            miss = 1 / (1 + np.exp(np.einsum("ij,ij->i", hidden, own) + self.bias[t] - log_noise[t]))
            taken = 1 / (1 + np.exp(-(hidden @ self.target[drawn].T + self.bias[drawn] - log_noise[drawn])))
            back = miss[:, None] * own - taken @ self.target[drawn]
            n = np.float32(1 / np.sqrt(len(t)))
            both = np.concatenate([a, b])
            rows, summed = _sum_by(both, np.concatenate([back * self.position[0], back * self.position[1]]))
            position = np.stack([(back * first).sum(axis=0), (back * second).sum(axis=0)])
            target_rows, target_sum = _sum_by(t, np.column_stack([miss[:, None] * hidden, miss]))
            pull = -np.column_stack([taken.T @ hidden, taken.sum(axis=0)])
            target_rows, target_sum = _sum_by(np.concatenate([target_rows, drawn]), np.concatenate([target_sum, pull]))
            self._move(0, summed * n, rows)
            self._move(1, position * n)
            self._move(2, target_sum[:, :-1] * n, target_rows)
            self._move(3, target_sum[:, -1] * n, target_rows)

    def tables(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Scores of each class after each input class, one table per position, and the log of the sum for each pair."""
        one = (self.context * self.position[0]) @ self.target.T + self.bias
        two = (self.context * self.position[1]) @ self.target.T
        low, high = one.max(axis=1), two.max(axis=1)
        sums = np.exp(one - low[:, None]) @ np.exp(two - high[:, None]).T
        return one, two, np.log(sums) + low[:, None] + high[None, :]


def _sum_by(keys: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys, kind="stable")
    ordered = keys[order]
    cuts = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
    return ordered[cuts], np.add.reduceat(rows[order], cuts, axis=0)


def is_held_out(doc_id: Column) -> Column:
    """The checksum of the id as text is a multiple of 10; a null id counts as the empty text."""
    return F.crc32(F.encode(F.coalesce(doc_id.cast("string"), F.lit("")), "UTF-8")) % 10 == 0


def count_words(training: DataFrame, column: str) -> DataFrame:
    """(word, bucket, c): hash, bucket and count of every training token but the ends."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, column, 2 * CHUNK_BYTES):
            tokens = tokens_of(batch.column(column).to_pylist())
            word = tokens.hash != END
            found, first, n = np.unique(tokens.hash[word], return_index=True, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(tokens.bucket[word][first]), pa.array(n, pa.int64())], ["word", "bucket", "n"])

    counted = training.select(column).mapInArrow(run, "word long, bucket long, n long")
    return counted.groupBy("word").agg(F.max("bucket").alias("bucket"), F.sum("n").alias("c"))


def gather_counts(counts: DataFrame, documents: int) -> Counts:
    """The bounded part of the corpus counts that tasks need; `documents` is the number of training documents."""
    total, distinct = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1))).first()
    total += documents
    head = counts.where(F.col("c") >= max(1, total / HEAD_SHARE)).select("word", "bucket", "c").toArrow()
    word, bucket, c = (head.column(name).to_numpy() for name in ("word", "bucket", "c"))
    order = np.lexsort((word, -c))
    listed = order[:SHORTLIST]
    by_bucket = {row["bucket"]: row for row in counts.groupBy("bucket").agg(F.sum("c").alias("c"), F.count(F.lit(1)).alias("n")).collect()}
    bucket_total = np.array([by_bucket[b]["c"] if b in by_bucket else 0 for b in range(BUCKETS)], np.float64)
    bucket_distinct = np.array([by_bucket[b]["n"] if b in by_bucket else 0 for b in range(BUCKETS)], np.float64)
    np.subtract.at(bucket_total, bucket[listed], c[listed])
    np.subtract.at(bucket_distinct, bucket[listed], 1)
    class_count = np.concatenate([[documents], np.zeros(SHORTLIST), bucket_total]).astype(np.float64)
    class_count[1 : 1 + len(listed)] = c[listed]
    short_order = np.argsort(word[listed])
    head_order = np.argsort(word)
    return Counts(total, distinct + (documents > 0), word[head_order], c[head_order], word[listed][short_order], short_order + 1, bucket_total, bucket_distinct, class_count)


def fit(training: DataFrame, counts: Counts, column: str, id_column: str) -> LogBilinear:
    """A model that has read every training document once."""
    model = LogBilinear(counts.class_count)
    sample = bounded_sample(training, F.xxhash64(id_column, column), SAMPLE_DOCUMENTS).select(column)
    for frame, rounds in ((sample.repartition(1), 3), (training.select(column), 1)):
        model.load(_averaged(frame, model, counts, column, rounds))
    return model


def _averaged(frame: DataFrame, model: LogBilinear, counts: Counts, column: str, rounds: int) -> np.ndarray:
    """The mean of the tasks' models, weighed by the tokens that each has read."""
    sent = Sent(frame.sparkSession, (model, counts))

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, known = sent.get()
        rng = np.random.default_rng(11)
        read = 0
        for batch in chunks(batches, column, CHUNK_BYTES):
            tokens = tokens_of(batch.column(column).to_pylist())
            out, inner = known.classes(tokens)
            one, two = known.context(tokens, inner)
            for _ in range(rounds):
                mixed = rng.permutation(len(out))
                own.learn(out[mixed], one[mixed], two[mixed], rng)
            read += len(out)
        if read:
            flat = own.flat().astype(np.float64) * read
            pieces = range(0, len(flat), _PIECE)
            values = pa.array([flat[at : at + _PIECE] for at in pieces], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([pa.array(range(len(pieces)), pa.int32()), values, pa.array([float(read)] * len(pieces))], ["piece", "values", "read"])

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, list] = {}
        for batch in batches:
            for piece, values, read in zip(batch.column("piece").to_pylist(), batch.column("values").to_numpy(zero_copy_only=False), batch.column("read").to_pylist(), strict=True):
                held = sums.setdefault(piece, [0.0, 0.0])
                held[0] = held[0] + values
                held[1] += read
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([s[0] for s in sums.values()], pa.list_(pa.float64())), pa.array([s[1] for s in sums.values()])], ["piece", "values", "read"])

    schema = "piece int, values array<double>, read double"
    parts = frame.mapInArrow(learn, schema).repartition("piece").mapInArrow(total, schema).orderBy("piece").collect()
    if not parts:
        return model.flat()
    return np.concatenate([np.array(p["values"]) / p["read"] for p in parts])


_SCORED = "rid long, doc_id long, held_out boolean, word long, tf long, bucket long, n_tokens long, n_known long, base double, score double"


def _score(docs: DataFrame, model: LogBilinear, counts: Counts, column: str) -> DataFrame:
    """One row per document with what needs no join, and one row for each of its words outside the head."""
    one_table, two_table, log_sum = model.tables()
    sent = Sent(docs.sparkSession, (counts, one_table, two_table, log_sum))
    names = [part.split()[0] for part in _SCORED.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, after_one, after_two, norm = sent.get()
        divisor = known.bucket_divisor
        for batch in chunks(batches, column, CHUNK_BYTES):
            tokens = tokens_of(batch.column(column).to_pylist())
            out, inner = known.classes(tokens)
            one, two = known.context(tokens, inner)
            logs = (after_one[one, out] + after_two[two, out] - norm[one, two]) / np.log(10)
            end = tokens.hash == END
            c = np.zeros(len(out))
            c[end] = known.class_count[0]
            in_head = end.copy()
            if len(known.head):
                at = np.minimum(np.searchsorted(known.head, tokens.hash), len(known.head) - 1)
                found = (known.head[at] == tokens.hash) & ~end
                c[found] = known.head_count[at[found]]
                in_head |= found
            base = np.where(in_head, np.log10((c + SMOOTH) / known.base_divisor), 0)
            share = in_head & (out > SHORTLIST)
            logs[share] += np.log10((c[share] + SMOOTH) / divisor[tokens.bucket[share]])
            n = batch.num_rows
            rid = batch.column("rid").to_numpy()
            sums = [np.bincount(tokens.text, w, n) for w in (np.ones(len(out)), in_head & (c > 0), base, logs)]
            # The word of a document's own row is a number that no join condition looks at; it spreads these rows.
            spread = (rid.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)).view(np.int64)
            none = pa.nulls(n, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column("rid"), batch.column("doc_id"), batch.column("held_out"), pa.array(spread), none, none, pa.array(sums[0].astype(np.int64)), pa.array(sums[1].astype(np.int64)), pa.array(sums[2]), pa.array(sums[3])],
                names,
            )
            rest = np.flatnonzero(~in_head)
            if len(rest):
                order = rest[np.lexsort((tokens.hash[rest], tokens.text[rest]))]
                word, text = tokens.hash[order], tokens.text[order]
                cuts = np.flatnonzero(np.concatenate([[True], (word[1:] != word[:-1]) | (text[1:] != text[:-1])]))
                m = len(cuts)
                tf = np.diff(np.concatenate([cuts, [len(order)]]))
                empty, real = pa.nulls(m, pa.int64()), pa.nulls(m, pa.float64())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(rid[text[cuts]]), empty, pa.nulls(m, pa.bool_()), pa.array(word[cuts]), pa.array(tf), pa.array(tokens.bucket[order][cuts]), empty, empty, real, real],
                    names,
                )

    return docs.mapInArrow(run, _SCORED)


def score(docs: DataFrame, *, id_column: str = "doc_id", column: str = "text") -> DataFrame:
    """(id, held_out, n_tokens, n_known, train_tokens, base_score, score) for each row of `docs`.

    Documents whose id's checksum is a multiple of 10 are held out, all others are learnt from. A null or empty text
    is the end token alone. Scores are sums of log10 probabilities; `base_score` is that of smoothed unigram counts.
    Rows are kept one by one, repeated ones too. If nothing is learnt from, all classes but the buckets of unknown words
    share what smoothing gives them.
    """
    held = is_held_out(F.col(id_column))
    source = docs.select(F.col(id_column).cast("long").alias("doc_id"), held.alias("held_out"), F.col(column).alias("text"))
    training = source.where(~F.col("held_out"))
    counted = stored(count_words(training, "text"), "word-counts")
    counts = gather_counts(counted, training.count())
    model = fit(training, counts, "text", "doc_id")
    numbered = source.select(F.monotonically_increasing_id().alias("rid"), "doc_id", "held_out", "text")
    scored = _score(numbered, model, counts, "text")
    joined = scored.join(counted.select(F.col("word").alias("_word"), "c"), (F.col("word") == F.col("_word")) & F.col("tf").isNotNull(), "left")
    c, tf = F.coalesce("c", F.lit(0)), F.col("tf")
    divisor = F.get(F.array(*[F.lit(float(x)) for x in counts.bucket_divisor]), F.col("bucket").cast("int"))
    rows = joined.select(
        "rid",
        "doc_id",
        "held_out",
        "n_tokens",
        F.coalesce("n_known", F.when(c > 0, tf).otherwise(0)).alias("n_known"),
        F.coalesce("base", tf * F.log10((c + SMOOTH) / counts.base_divisor)).alias("base"),
        F.coalesce("score", tf * F.log10((c + SMOOTH) / divisor)).alias("score"),
    )
    # The class part of a word outside the head is in its document's own row; its share of the class is added here.
    summed = rows.groupBy("rid").agg(
        F.max("doc_id").alias(id_column), F.max("held_out").alias("held_out"), F.max("n_tokens").alias("n_tokens"), F.sum("n_known").alias("n_known"), F.sum("base").alias("base_score"), F.sum("score").alias("score")
    )
    return summed.select(id_column, "held_out", "n_tokens", "n_known", F.lit(int(counts.total)).alias("train_tokens"), "base_score", "score")
