"""The corpus pipeline against a plain one: every stage by brute force over all pairs of documents."""

from __future__ import annotations

import hashlib
import random
import re
import struct

import xxhash
from test_text_operators import LOWER, PASSAGE, dense_fusion, invented

import corpus_pipeline
from polderlake.llm.queries import tokenizer_file

WORD = re.compile(r"[^\x20\x09-\x0D]+")
ITEM_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def plain_languages(docs):
    accepted = {w[0] for w in dense_fusion([(d[0], d[1], d[2], d[3]) for d in docs], None) if w[3]}
    return [d for d in docs if d[0] in accepted]


def plain_lines(docs):
    """Lines of every run of 8 words or more that any earlier document has."""
    out = []
    tidy = lambda text: [line.strip() for line in text.split("\n")]
    for d in docs:
        lines = tidy(d[1])
        words = [len(line.split()) for line in lines]
        gone = set()
        for other in docs:
            if other[0] < d[0]:
                earlier = tidy(other[1])
                runs = {tuple(earlier[i:j]) for i in range(len(earlier)) for j in range(i + 1, len(earlier) + 1)}
                for i in range(len(lines)):
                    for j in range(i + 1, len(lines) + 1):
                        if tuple(lines[i:j]) in runs and sum(words[i:j]) >= 8:
                            gone |= set(range(i, j))
        text = "\n".join(line for i, line in enumerate(d[1].split("\n")) if i not in gone)
        if not gone or text.strip(" "):
            out.append((d[0], text, d[2], d[3], len(text) if gone else d[4]))
    return out


def print_of(text):
    words = WORD.findall(text.translate(LOWER))
    shingles = [" ".join(words[i : i + 3]) for i in range(max(len(words) - 2, 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << bit for bit in range(64) if 2 * sum(h >> bit & 1 for h in hashes) > len(hashes))


def plain_groups(docs):
    prints = {d[0]: print_of(d[1]) for d in docs}
    group = {k: k for k in prints}
    for _ in prints:
        for a in prints:
            group[a] = min(group[b] for b in prints if (prints[a] ^ prints[b]).bit_count() <= 2)
    return [d for d in docs if group[d[0]] == d[0]]


def plain_decontamination(docs, items):
    windows = set()
    for _, text in items:
        words = ITEM_WORD.findall((text or "").translate(LOWER))
        n = min(len(words), 13)
        windows |= {tuple(words[i : i + n]) for i in range(len(words) - n + 1)} if n else set()
    kept = []
    for d in docs:
        words = ITEM_WORD.findall(d[1].translate(LOWER))
        hit = {k for w in windows for i in range(len(words) - len(w) + 1) if tuple(words[i : i + len(w)]) == w for k in range(i, i + len(w))}
        if not hit or 20 * len(hit) < len(words):
            kept.append(d)
    return kept


def fixture():
    draw = random.Random(11)
    items = [(i, " ".join(invented("en", draw, 20).split())) for i in range(3)] + [(7, None), (8, ""), (9, "short item only")]
    docs = []
    for i in range(40):
        language = draw.choice(["en", "fr"])
        body = [invented(language, draw, draw.randint(9, 14)) for _ in range(draw.randint(2, 6))]
        docs.append([i, "\n".join(body), language if i % 5 else None, f"www.{language}.example.org"])
    docs[4][1] += f"\n{PASSAGE}\nits own end of these lines"
    docs[9][1] = f"{docs[9][1]}\n{PASSAGE}"
    docs[12][1] = PASSAGE
    docs[15][1] = docs[3][1]
    docs[16][1] = " ".join(docs[6][1].split()).upper()
    docs[18][1] = docs[8][1].replace("\n", " ") + " " + items[0][1]
    docs[20][1] = " ".join(invented("en", draw, 400).split()) + " " + " ".join(items[1][1].split()[:13])
    docs[21][1] = f"{items[2][1]}\n{docs[21][1]}"
    docs[23][1], docs[24][1], docs[25][1], docs[26][1] = "", None, "12 34 !", "да нет не знаю " * 40
    docs[28][1] = "\n".join(invented("en", draw, 10) for _ in range(300))
    return [(*d, len(d[1]) if d[1] is not None else None) for d in docs], items


def test_the_pipeline_is_the_plain_one(spark, tmp_path):
    docs, items = fixture()
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    plain = [plain_languages, plain_lines, plain_groups, lambda d: plain_decontamination(d, items)]
    staged, wanted = spark.read.parquet(str(tmp_path / "documents.parquet")), docs
    sizes = [len(docs)]
    for (name, stage), own in zip(corpus_pipeline.STAGES, plain, strict=False):
        staged, wanted = stage(spark, staged, str(tmp_path)), own(wanted)
        assert sorted(map(tuple, staged.collect())) == sorted(wanted), name
        sizes.append(len(wanted))
    assert all(a > b for a, b in zip(sizes, sizes[1:], strict=False)), sizes
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(tokenizer_file())
    got = {r["doc_id"]: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert sorted(got) == sorted(d[0] for d in wanted)
    for doc_id, text, *_ in wanted:
        ids = library.encode(text, add_special_tokens=False).ids
        row = got[doc_id]
        assert row["ids"] == ids and row["n_tokens"] == len(ids)
        assert row["ids_sha256"] == hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest()
        assert row["decoded_sha256"] == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()
