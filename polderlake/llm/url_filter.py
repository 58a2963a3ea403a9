"""URL filter: explicit rules first, then logistic regression on hashed character n-grams of host and path.

The model is trained in numpy from a small labelled table of URLs, which a caller can replace by its own. At most
`MAX_LABELLED` rows of it are used (the first by a hash of the URL).
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from polderlake.llm.frames import Sent

BITS = 15
GRAMS = (3, 4, 5)
MAX_LABELLED = 20_000
#: Log-odds from which the model blocks: three to two, so that hosts it knows nothing of are let through.
THRESHOLD = 0.4
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

# The rules that every page is judged by.
RULES = (
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
)

# The labelled URLs are put together from words: the first kind are those that spam and abuse sites commonly go by, the
# second kind ordinary ones. No host of them is taken from a table of pages.
_SPAM_WORDS = """
casino poker jackpot roulette slots lottery betting bets odds spins bonus pills viagra meds pharmacy steroids xxx adult singles cams
escort porn payday loans cash crypto doubler warez torrent cracks keygen replica watches diploma backlinks seo spam diet miracle weightloss
""".split()
_SPAM_FORMS = ("{a}-{b}", "cheap-{a}-deals", "free-{a}-now", "best-{a}-{b}", "{a}{b}", "online-{a}", "{a}-to-win", "buy-{a}", "{a}-link-farm")
_PLAIN_WORDS = """
news university garden library weather museum hospital recipes travel manual forum cycling council history physics school bank painting
music theatre science radio market sports press health pillow castle alphabet wiki journal maps archive bakery harbour bridge poetry opera
chess grammar winter summer river mountain farming freedom winery windows library letters postcards cashmere betterment spinning
""".split()
_PLAIN_FORMS = ("{a}", "{a}-{b}", "{a}{b}", "the-{a}", "city-{a}", "{a}-club", "my{a}", "{a}-online", "old-{a}-{b}")
_PATHS = ("/", "/en/1{n}", "/fr/{n}", "/de/2{n}/", "/es/{n}.html", "/index.html", "/{n}/about", "")
_SUBDOMAINS = ("", "www.", "blog.", "m.")
_SUFFIXES = ("example.com", "example.net", "example.org", "test")


def _urls(words: Sequence[str], forms: Sequence[str], verdict: str) -> list[tuple[str, str]]:
    """Every word in every form, with another word, path, subdomain and suffix each time; these tell nothing."""
    out = []
    for i, word in enumerate(words):
        for j, form in enumerate(forms):
            n = 37 * i + 11 * j
            host = form.format(a=word, b=words[(i + 3 * j + 1) % len(words)])
            out.append((f"http://{_SUBDOMAINS[n % 4]}{host}.{_SUFFIXES[(n // 4) % 4]}{_PATHS[n % 7].format(n=n)}", verdict))
    return out


LABELLED = (*_urls(_SPAM_WORDS, _SPAM_FORMS, "block"), *_urls(_PLAIN_WORDS, _PLAIN_FORMS, "allow"))


def host_of(url: Column) -> Column:
    """After the first `://` up to `/`, `?`, `#` or the end, A-Z in lower case; empty without `://`."""
    return F.translate(F.coalesce(F.regexp_extract(url, "://([^/?#]*)", 1), F.lit("")), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    """What follows the host, up to `?`, `#` or the end."""
    return F.coalesce(F.regexp_extract(url, "://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_for(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> Column:
    """(rule, verdict) of the longest rule that fits the host or a domain above it, and the start of the path; else null."""
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for rule_host, rule_path, verdict in sorted(rules, key=lambda r: len(r[0] + r[1])):
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(rule_path)
        found = F.when(fits, F.struct(F.lit(rule_host + rule_path).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


def gram_slots(hosts: Sequence[str], paths: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed n-grams of all rows, host and path apart, and the row of each."""
    slots, rows = [], []
    for field, texts in enumerate((hosts, paths)):
        packed = [f"\2{text}\3".encode() if text else b"" for text in texts]
        data = np.frombuffer(b"".join(packed), dtype=np.uint8).astype(np.uint64)
        sizes = np.array([len(p) for p in packed])
        row = np.repeat(np.arange(len(packed)), sizes)
        left = np.repeat(np.cumsum(sizes), sizes) - np.arange(len(data))
        mixed = np.full(len(data), 17 + field, np.uint64)
        for i in range(max(GRAMS)):
            shifted = np.concatenate([data[i:], np.zeros(min(i, len(data)), np.uint64)])
            mixed = (mixed ^ (shifted + np.uint64(1))) * np.uint64(0x9E3779B97F4A7C15)
            mixed ^= mixed >> np.uint64(29)
            if i + 1 in GRAMS:
                whole = left >= i + 1
                slots.append((mixed[whole] >> np.uint64(64 - BITS)).astype(np.int64))
                rows.append(row[whole])
    return np.concatenate(slots), np.concatenate(rows)


class UrlModel:
    """Weights of the n-grams and a bias; positive scores mean block."""

    def __init__(self, weights: np.ndarray, bias: float):
        self.weights, self.bias = weights, bias

    @classmethod
    def train(cls, labelled: Sequence[tuple[str, str, str]], *, steps: int = 400, rate: float = 2.0, decay: float = 1e-3) -> UrlModel:
        """From (host, path, verdict): gradient descent on the mean log-loss; a row's n-grams share unit length."""
        weights, bias = np.zeros(1 << BITS), 0.0
        if not labelled:
            return cls(weights, -1.0)
        slots, rows = gram_slots([r[0] for r in labelled], [r[1] for r in labelled])
        scale = 1 / np.sqrt(np.maximum(np.bincount(rows, minlength=len(labelled)), 1))
        target = np.array([r[2] == "block" for r in labelled], float)
        for _ in range(steps):
            score = np.bincount(rows, weights[slots], len(labelled)) * scale + bias
            error = (1 / (1 + np.exp(-score)) - target) / len(labelled)
            weights -= rate * (np.bincount(slots, (error * scale)[rows], 1 << BITS) * len(labelled) / 8 + decay * weights)
            bias -= rate * error.sum()
        return cls(weights, float(bias))

    def scores(self, hosts: Sequence[str], paths: Sequence[str]) -> np.ndarray:
        slots, rows = gram_slots(hosts, paths)
        n = np.maximum(np.bincount(rows, minlength=len(hosts)), 1)
        return np.bincount(rows, self.weights[slots], len(hosts)) / np.sqrt(n) + self.bias


def train_from(labelled: DataFrame) -> UrlModel:
    """A model from a table (url, verdict) with verdicts allow and block; other rows are ignored."""
    rows = labelled.where(F.col("verdict").isin("allow", "block")).orderBy(F.xxhash64("url"), "verdict").limit(MAX_LABELLED)
    return UrlModel.train([tuple(r) for r in rows.select(host_of(F.col("url")), path_of(F.col("url")), "verdict").collect()])


RESULT = ("host", "path", "rule", "verdict", "score")


def judge(pages: DataFrame, *, rules: Sequence[tuple[str, str, str]] = RULES, model: UrlModel | None = None, threshold: float = THRESHOLD, id_column: str = "page_id", url: str = "url") -> DataFrame:
    """(id, host, path, rule, verdict, score) for each row of `pages`.

    The longest fitting rule decides (ties: the one named later); without one the model does, and blocks if its score
    is above `threshold`. A null URL or one without `://` has an empty host and path, which fit no rule; the model judges them by its
    bias. Long URLs are judged whole.
    Rows are kept one by one, repeated ones too. One pass, no shuffle.
    """
    spark = pages.sparkSession
    if model is None:
        model = train_from(spark.createDataFrame(LABELLED, "url string, verdict string"))
    sent = Sent(spark, model)
    parted = pages.select(F.col(id_column), host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"))
    schema = parted.select("*").schema.add("score", "double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = sent.get()
        for batch in batches:
            score = judge.scores(batch.column("host").to_pylist(), batch.column("path").to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(score)], schema.names)

    scored = parted.mapInArrow(run, schema).withColumn("found", rule_for(F.col("host"), F.col("path"), rules))
    verdict = F.coalesce("found.verdict", F.when(F.col("score") > threshold, "block").otherwise("allow"))
    return scored.select(id_column, "host", "path", F.col("found.rule").alias("rule"), verdict.alias("verdict"), "score")
