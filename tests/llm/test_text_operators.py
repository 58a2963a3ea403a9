"""Tokenizer, contamination, SimHash, line dedup and language against the library or brute force, and odd rows."""

from __future__ import annotations

import hashlib
import math
import random
import re
import struct
import time

import numpy as np
import pytest
import regex
import xxhash
from collections import Counter

from hypothesis import given, settings
from hypothesis import strategies as st

from polderlake.llm import bpe, decontaminate, language_id, line_dedup, simhash
from polderlake.llm.queries import tokenizer_file

LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
ODD = [None, "", " ", "\n\n", "a", "Z" * 5000, "x y " * 3000, "<|endoftext|> a<|startoftext|>", "ÄΣ \x85\x1c q", "日本語 \U0001f600", "same", "same"]
#: Columns that results have too, and one of no use, in another case.
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, N_WORDS string, Ids int, gone string"


def odd_docs(spark, texts=ODD):
    rows = [(i if i % 5 else None, t, None if i % 3 else "en", None if i % 2 else "src1", None, "kept?", None, None) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def encoder():
    return bpe.Encoder.from_file(tokenizer_file())


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer_file())


def same_as_library(encoder, library, text):
    packed, decoded = encoder.encode(text)
    wanted = library.encode(text or "", add_special_tokens=False).ids
    assert list(struct.unpack(f"<{len(packed) // 4}I", packed)) == wanted
    assert decoded == library.decode(wanted, skip_special_tokens=False) == encoder.decode(wanted)


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=80))
def test_any_text_is_encoded_as_by_the_library(encoder, library, text):
    same_as_library(encoder, library, text)


def test_every_code_point_is_encoded_as_by_the_library(encoder, library):
    points = [c for c in range(0x110000) if not 0xD800 <= c <= 0xDFFF]
    for start in range(0, len(points), 512):
        text = " ".join(f"x{chr(c)}x 1{chr(c)}.{chr(c)}" for c in points[start : start + 512])
        wanted = library.encode(text, add_special_tokens=False).ids
        if list(np.frombuffer(encoder.encode(text)[0], "<u4")) != wanted:
            for c in points[start : start + 512]:
                same_as_library(encoder, library, f"x{chr(c)}x 1{chr(c)}.{chr(c)}")


def test_code_points_that_need_the_library_are_listed(encoder, library):
    """Split by the operator's own way, all others of the basic plane come out as by the library, each by itself."""
    rare = encoder.rare
    for start in range(0, 0x10000, 256):
        plain = [chr(c) for c in range(start, start + 256) if not 0xD800 <= c <= 0xDFFF and not rare(chr(c))]
        for text in [" ".join(f"x{c}x1{c}.{c}" for c in plain)]:
            assert not rare(text)
            same_as_library(encoder, library, text)


def test_what_was_encoded_before_changes_nothing(library):
    texts = ["\U0001f600 -", "\0-", "-", "\0", "\U0001f600\0-", "\0a \u0558b", "ğ \U0001f600ğ", "Ġ", "\U0001f600 Ġ Ã©", "Ã©", "é", "\U0001f600 é"]
    made = bpe.Encoder.from_file(tokenizer_file())
    for turn in range(len(texts)):
        made.open()
        for text in [*texts[turn:], *texts[:turn], *reversed(texts)]:
            same_as_library(made, library, text)
    draw = random.Random(8)
    for _ in range(3000):
        same_as_library(made, library, "".join(draw.choice("\0\0-aé 'ΣĠ\u0301\U0001f600\u208f") for _ in range(draw.randint(1, 6))))


def test_letters_and_odd_texts_are_encoded_as_by_the_library(encoder, library):
    draw = random.Random(4)
    for text in ODD + ["".join(draw.choice("aehinorst' ") for _ in range(200)) for _ in range(300)]:
        same_as_library(encoder, library, text)


def merged_by_rule(word: str, merges: list[tuple[str, str]]) -> list[str]:
    parts = [*word[:-1], word[-1] + bpe.WORD_END]
    for u, v in merges:
        i = 0
        while i < len(parts) - 1:
            if (parts[i], parts[i + 1]) == (u, v):
                parts[i : i + 2] = [u + v]
            i += 1
    return parts


@settings(max_examples=150, deadline=None)
@given(st.integers(0, 10**9), st.text("ab", min_size=1, max_size=12))
def test_gadgets_give_what_merging_in_order_gives(seed, word):
    draw = random.Random(seed)
    tokens = ["a", "b", "a" + bpe.WORD_END, "b" + bpe.WORD_END]
    merges = []
    for _ in range(8):
        u, v = draw.choice([t for t in tokens if not t.endswith(bpe.WORD_END)]), draw.choice(tokens)
        if u + v not in tokens:
            merges.append((u, v))
            tokens.append(u + v)
    automaton = bpe.MergeAutomaton.compile({t: i for i, t in enumerate(tokens)}, merges)
    assert [tokens[t] for t in automaton.encode(word)] == merged_by_rule(word, merges)


def test_encoded_frame_keeps_rows_and_replaces_clashing_columns(spark, encoder):
    made = bpe.encode_documents(odd_docs(spark), encoder).collect()
    assert len(made) == len(ODD) and "Ids" not in made[0].asDict() and made[0]["n_tokens"] == 0
    assert all(len(r["ids"]) == r["n_tokens"] for r in made)
    assert bpe.encode_documents(odd_docs(spark, []), encoder).count() == 0


WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def contamination(text, items):
    words = WORD.findall((text or "").translate(LOWER))
    hit, found = set(), set()
    for item, phrase in items:
        own = WORD.findall((phrase or "").translate(LOWER))
        for start in range(max(1, len(own) - 12) if own else 0):
            window = own[start : start + 13]
            for at in range(len(words) - len(window) + 1):
                if words[at : at + len(window)] == window:
                    hit.update(range(at, at + len(window)))
                    found.add(str(item))
    return len(words), len(hit), sorted(found)


@pytest.mark.parametrize("block_words", [10**6, 5])
def test_contamination_as_by_brute_force(spark, block_words):
    draw = random.Random(9)
    vocabulary = ["a", "b", "Cé", "d1", "e"]
    items = [(i, " ".join(draw.choices(vocabulary, k=draw.choice([0, 1, 3, 13, 14, 30])))) for i in range(12)] + [(11, None), (None, "b b b a")]
    texts = [" ".join(draw.choices(vocabulary + ["zz"], k=draw.randrange(60))) for _ in range(60)]
    texts += [(items[k][1] or "") + " zz zz" for k in range(12)] * 2 + ODD
    docs = odd_docs(spark, texts)
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.find_contamination(docs, bench, block_words=block_words).collect()
    named = [("" if i is None else i, t) for i, t in items]
    wanted = sorted(str(contamination(t, named)) for t in texts)
    assert sorted(str((r["n_words"], r["n_hit"], r["items"])) for r in got) == wanted
    for r in got:
        assert r["items_sha256"] == hashlib.sha256(",".join(r["items"]).encode()).hexdigest()
        assert r["contaminated"] == (r["n_hit"] > 0 and 20 * r["n_hit"] >= r["n_words"])
        assert sum(s["end"] - s["start"] for s in r["spans"]) == r["n_hit"]


def test_nothing_is_contaminated_by_an_empty_benchmark(spark):
    bench = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.find_contamination(odd_docs(spark), bench).where("contaminated or n_hit > 0").count() == 0
    assert decontaminate.find_contamination(odd_docs(spark, []), bench).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 4), min_size=1, max_size=80), st.lists(st.integers(1, 5), min_size=1, max_size=4))
def test_index_finds_every_place(values, phrase):
    index = decontaminate.FMIndex(np.array(values))
    low, high = index.search(np.array([phrase]), np.array([len(phrase)]))
    places = sorted(index.locate(np.arange(low[0], high[0])).tolist())
    assert places == [i for i in range(len(values)) if values[i : i + len(phrase)] == phrase]


def fingerprint(text, size=3):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    shingles = [" ".join(words[i : i + size]) for i in range(max(1, len(words) - size + 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_fingerprints_as_by_brute_force():
    texts = [*ODD, "One two  three\tfour five", "a b", "é ü ö ä"]
    got = simhash.fingerprints(texts)
    assert [int.from_bytes(row.tobytes(), "big") for row in got] == [fingerprint(t) for t in texts]


@pytest.mark.parametrize("radius", [1, 2, 3, 5])
def test_bit_planes_find_all_near_pairs(radius):
    draw = np.random.default_rng(radius)
    values = draw.integers(0, 2**63, 150, dtype=np.uint64)
    near = values[:80] ^ (np.uint64(1) << draw.integers(0, 64, 80, dtype=np.uint64)) ^ (np.uint64(1) << draw.integers(0, 64, 80, dtype=np.uint64))
    values = np.unique(np.concatenate([values, near]))
    wanted = set(zip(*(x.tolist() for x in np.nonzero(np.triu(np.bitwise_count(values[:, None] ^ values[None, :]) <= radius, 1))), strict=True))
    for step in (1, 7, 64, 200):
        planes, found = simhash.BitPlanes(values), []
        for start in range(0, len(values), step):
            found += zip(*(x.tolist() for x in planes.within(start, min(start + step, len(values)), radius)), strict=True)
        assert len(found) == len(set(found)) and set(found) == wanted


def test_groups_of_random_fingerprints_are_abandoned():
    values = np.unique(np.random.default_rng(5).integers(0, 2**63, 4000, dtype=np.uint64))
    planes = simhash.BitPlanes(values)
    for start in range(0, len(values), 64):
        asked, partners = planes.within(start, min(start + 64, len(values)), 2)
        assert not len(asked) and not len(partners)
    assert planes.groups > 120 and planes.abandoned == planes.groups, "no pair is near, so every group is abandoned"
    assert planes.planes_read < 0.7 * 64 * planes.groups
    # One near pair keeps its own group only.
    values[2000] = values[100] ^ np.uint64(1)
    planes = simhash.BitPlanes(values)
    found = [pair for start in range(0, 4000, 64) for pair in zip(*planes.within(start, min(start + 64, len(values)), 2), strict=True)]
    assert found == [(100, 2000)] and planes.abandoned == planes.groups - 1


def components(values, ids, radius):
    label = {v: v for v in values}
    changed = True
    while changed:
        changed = False
        for a in label:
            for b in label:
                if (a ^ b).bit_count() <= radius and label[a] != label[b]:
                    label[a] = label[b] = min(label[a], label[b])
                    changed = True
    return [min((i for v, i in zip(values, ids, strict=True) if label[v] == label[own] and i is not None), default=None) for own in values]


@pytest.mark.parametrize("key_rows", [2048, 4])
def test_near_duplicates_as_by_brute_force(spark, monkeypatch, key_rows):
    monkeypatch.setattr(simhash, "KEY_ROWS", key_rows)
    draw = random.Random(2)
    long = draw.choices([f"w{i}" for i in range(400)], k=400)
    texts = []
    for _ in range(14):
        copy = long[:]
        copy[draw.randrange(400)] = "other"
        texts.append(" ".join(copy))
    texts += ODD + [" ".join(long)] * 3
    docs = odd_docs(spark, texts)
    got = simhash.near_duplicates(docs)
    rows = sorted(((r["doc_id"], r["fingerprint"], r["component_id"]) for r in got.collect()), key=str)
    prints, ids = [fingerprint(t) for t in texts], [i if i % 5 else None for i in range(len(texts))]
    wanted = sorted(zip(ids, [f"{p:016x}" for p in prints], components(prints, ids, 2), strict=True), key=str)
    assert rows == wanted
    kept = simhash.one_of_each_group(docs)
    assert kept.columns == docs.columns
    assert {r["doc_id"] for r in kept.collect()} == {None} | {i for i, _, c in wanted if i == c}


def test_no_documents_no_groups(spark):
    assert simhash.near_duplicates(odd_docs(spark, [])).count() == 0
    assert simhash.one_of_each_group(odd_docs(spark, [None, ""])).count() >= 1


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 5), max_size=14), st.lists(st.integers(0, 5), max_size=14))
def test_alignment_matches_equal_lines_in_order(a, b):
    pairs = line_dedup.patience(a, b)
    assert all(a[x] == b[y] for x, y in pairs)
    assert all(p[0] < q[0] and p[1] < q[1] for p, q in zip(pairs, pairs[1:]))
    if a == b:
        assert len(pairs) == len(a)


def test_fixed_points_survive_edits():
    a = list(range(10))
    assert [x for x, _ in line_dedup.patience(a, [0, 1, 99, 2, 3, 5, 6, 98, 7, 8, 9])] == [0, 1, 2, 3, 5, 6, 7, 8, 9]


PASSAGE = "\n".join(f"this is line {i} of a passage that several documents have in common" for i in range(5))


def test_common_blocks_leave_the_later_document(spark):
    own = {i: f"document {i} starts with words of its own that no other one has" for i in range(1, 8)}
    texts = {1: f"{own[1]}\n{PASSAGE}", 2: f"{own[2]}\n{PASSAGE}\n\nand an end of document two", 3: PASSAGE, 4: f"{own[4]}\nshort line", 5: f"{own[5]}\nshort line", 6: own[6], 7: own[6]}
    docs = spark.createDataFrame([(i, t, "n") for i, t in texts.items()] + [(None, PASSAGE, "n"), (9, None, "n"), (10, "", "n"), (2, texts[2], "n")], "doc_id long, text string, N_Lines string")
    rows = line_dedup.remove_repeated_lines(docs).collect()
    got = {r["doc_id"]: r for r in rows}
    assert len(rows) == 11 and "N_Lines" not in rows[0].asDict()
    assert got[1]["text"] == texts[1] and got[2]["text"] == f"{own[2]}\n\nand an end of document two" and got[3]["text"] == ""
    assert got[4]["text"] == texts[4] and got[5]["text"] == texts[5], "a short line alone is no block"
    assert got[6]["text"] == own[6] and got[7]["text"] == ""
    assert got[None]["text"] == PASSAGE and got[9]["text"] is None and got[10]["text"] == "" and got[10]["n_lines"] == 0
    assert got[2]["n_lines"] == 8 and got[2]["n_removed"] == 5


def test_copies_beyond_the_rare_limit_are_found(spark):
    docs = spark.createDataFrame([(i, f"{PASSAGE}\nand document {i} ends with a line of its own here") for i in range(30)], "doc_id long, text string")
    rows = line_dedup.remove_repeated_lines(docs, rare_documents=5).collect()
    assert sorted(r["n_removed"] for r in rows) == [0] + [5] * 29
    common = spark.createDataFrame([(i, f"all rights are reserved by the owners of this\nthe body of document {i} is only its own text") for i in range(30)], "doc_id long, text string")
    assert line_dedup.remove_repeated_lines(common, rare_documents=5).agg({"n_removed": "sum"}).first()[0] == 0
    assert line_dedup.remove_repeated_lines(docs.limit(0)).count() == 0


def test_a_line_has_the_same_fate_however_many_hold_it(spark):
    line = "all rights are reserved by the owners of this"
    docs = spark.createDataFrame([(i, f"{line}\nthe body of document {i} is only its own text") for i in range(60)], "doc_id long, text string")
    assert sorted(r["n_removed"] for r in line_dedup.remove_repeated_lines(docs).collect()) == [0] + [1] * 59


def test_blocks_of_lines_that_began_in_different_documents(spark):
    short, other = "five words in this line", "and five more in that"
    texts = [f"{short}\na", f"{other}\nb", f"c\n{short}\n{other}\nd", f"e\n{short}\n{other}\nf"]
    got = line_dedup.remove_repeated_lines(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert {r["doc_id"]: r["text"] for r in got} == dict(enumerate([*texts[:3], "e\nf"]))


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 9), max_size=12))
def test_runs_cover_every_block_of_enough_words(words):
    lines = np.arange(100, 100 + len(words))
    found = set(line_dedup.run_keys(lines, np.array(words, np.int32), 8)[0].tolist())
    for i in range(len(words)):
        for j in range(i + 1, len(words) + 1):
            if sum(words[i:j]) >= 8:
                inside = set(line_dedup.run_keys(lines[i:j], np.array(words[i:j], np.int32), 8)[0].tolist())
                assert inside and inside <= found
                break


def test_passages_that_repeat_or_change_places(spark):
    other = PASSAGE.replace("passage", "section")
    texts = [f"a\n{PASSAGE}\nb\n{PASSAGE}\nc", f"d\n{PASSAGE}\ne", f"f\n{other}\ng\n{PASSAGE}\nh\n{PASSAGE}\ni", f"j\n{PASSAGE}\nk\n{other}\nl"]
    got = line_dedup.remove_repeated_lines(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert {r["doc_id"]: r["text"] for r in got} == {0: texts[0], 1: "d\ne", 2: f"f\n{other}\ng\nh\ni", 3: "j\nk\nl"}


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 5), max_size=14), st.lists(st.integers(0, 5), max_size=14))
def test_no_common_block_is_left(a, b):
    words = [line + 1 for line in b]
    gone = line_dedup.repeated_positions(a, b, words, 8)
    assert len(gone) == len(set(gone)) and all(b[i] in a for i in gone)
    left = [None if i in set(gone) else line for i, line in enumerate(b)]
    runs = {tuple(a[i:j]) for i in range(len(a)) for j in range(i + 1, len(a) + 1)}
    assert all(sum(words[i:j]) < 8 for i in range(len(b)) for j in range(i + 1, len(b) + 1) if tuple(left[i:j]) in runs)


def heaviest_first(a, left, words, least):
    """Run by run: the heaviest common one of what is left, ties to the first."""
    left, out = list(left), []
    runs = {tuple(a[i:j]) for i in range(len(a)) for j in range(i + 1, len(a) + 1)}
    while True:
        found = [(-sum(words[i:j]), i, j) for i in range(len(left)) for j in range(i + 1, len(left) + 1) if tuple(left[i:j]) in runs and sum(words[i:j]) >= least]
        if not found:
            return out
        _, i, j = min(found, key=lambda x: (x[0], x[1], -x[2]))
        out.append((i, j))
        left[i:j] = [None] * (j - i)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 4), max_size=14), st.lists(st.integers(0, 4) | st.none(), max_size=16), st.integers(1, 9))
def test_common_runs_are_the_heaviest_first(a, b, least):
    words = [0 if line is None else line + 1 for line in b]
    found = line_dedup.common_runs(a, b, words, least)
    wanted = heaviest_first(a, b, words, least)
    assert sorted(sum(words[i:j]) for i, j in found) == sorted(sum(words[i:j]) for i, j in wanted)
    assert all(tuple(b[i:j]) in {tuple(a[x:y]) for x in range(len(a)) for y in range(x + 1, len(a) + 1)} for i, j in found)
    taken = [x for i, j in found for x in range(i, j)]
    assert len(taken) == len(set(taken))


@pytest.mark.parametrize("kind", ["reversed", "twice", "same", "blocks", "shuffled"])
def test_a_hundred_thousand_lines_in_any_order(kind):
    n = 100_000
    earlier = list(range(n))
    later = {
        "reversed": earlier[::-1],
        "twice": [x for x in range(n // 2) for _ in "12"],
        "same": [7] * n,
        "blocks": [x for start in range(n - 10, -1, -10) for x in range(start, start + 10)],
        "shuffled": random.Random(1).sample(earlier, n),
    }[kind]
    earlier = {"twice": list(range(n // 2)) * 2, "same": [7] * n}.get(kind, earlier)
    began = time.process_time()
    gone = line_dedup.repeated_positions(earlier, later, [9] * n, 8)
    assert len(gone) == n and time.process_time() - began < 60
    if kind in ("reversed", "shuffled"):
        assert len(line_dedup.repeated_positions(earlier, later, [3] * n, 8)) < n // 10


SYLLABLES = {"en": "th er on an re he in ed nd ha", "fr": "le ai eu ou on que la é ch re", "de": "en ch ei sch un ge ü be ung er"}


def invented(language, draw, words=40):
    return " ".join("".join(draw.choices(SYLLABLES[language].split(), k=3)) for _ in range(words))


def test_language_from_all_evidence(spark):
    draw = random.Random(1)
    rows = []
    for i in range(300):
        language = draw.choice(list(SYLLABLES))
        declared = language if i % 10 else draw.choice(list(SYLLABLES))
        rows.append((i, invented(language, draw), declared if i % 4 else None, f"http://www.{language}-host.example.{'org' if language == 'en' else 'net'}/x", language))
    rows += [(1000, None, "en", "x", None), (1001, "123 %%%", "en", None, None), (1002, "да нет не знаю " * 40, None, None, None), (None, "the and", None, None, None), (1003, "he", None, "fr-host.example.net", "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, truth string")
    got = {r["doc_id"]: r for r in language_id.identify(docs).collect()}
    known = [r for r in rows if r[0] is not None and r[0] < 300]
    assert sum(got[i]["language"] == truth for i, _, _, _, truth in known) >= 0.98 * len(known), "held-out accuracy"
    assert all(got[r[0]]["accepted"] for r in known)
    assert not got[1000]["accepted"] and got[1000]["language"] is None and not got[1001]["accepted"] and not got[1002]["accepted"]
    kept = language_id.accepted_only(docs)
    assert kept.count() == len(rows) - 3 and kept.columns == docs.columns


def test_every_declared_language_counts(spark):
    tags = [a + b for a in "abcdefghijk" for b in "abcdefghij"]
    rows = [(i, f"{tag}{tag[::-1]} " * 30, tag) for i, tag in enumerate(tags * 3)] + [(1000 + i, "zozu zuzo " * 20, "zz") for i in range(2)]
    docs = spark.createDataFrame([(*r, None) for r in rows], "doc_id long, text string, lang string, source string")
    assert language_id.train(docs, "text", "lang", "doc_id")[0] == [*tags, "zz"]
    got = language_id.identify(docs).where("doc_id >= 1000").collect()
    assert [(r["language"], r["accepted"]) for r in got] == [("zz", True)] * 2


def dense_fusion(rows, declared_kinds, min_posterior=0.5):
    """All evidence in plain Python: trigram counts of all documents that declare a language, sums without the own part."""
    tag = lambda v: re.match("[a-z]+", (v or "").strip().lower())[0] if re.match("[a-z]+", (v or "").strip().lower()) else None
    names = sorted({tag(r[2]) for r in rows if tag(r[2]) and r[1] is not None})
    counts = {name: Counter() for name in names}
    grams = {}
    for i, row in enumerate(rows):
        buckets, first = language_id.trigrams([row[1]])
        grams[i] = buckets.tolist()
        if row[1] is not None and tag(row[2]):
            counts[tag(row[2])].update(grams[i])
    total = {name: sum(c.values()) + language_id.ALPHA * language_id.BUCKETS for name, c in counts.items()}
    score = {i: {n: sum(math.log((counts[n][g] + language_id.ALPHA) / total[n] * language_id.BUCKETS) for g in grams[i]) for n in names} for i in grams}
    scale = {i: min(1.0, language_id.FULL_LETTERS / max(len(grams[i]), 1)) for i in grams}
    share = {}
    for i in grams:
        odds = {n: math.exp(scale[i] * (score[i][n] - max(score[i].values()))) for n in names}
        share[i] = {n: odds[n] / sum(odds.values()) if grams[i] and odds[n] / sum(odds.values()) >= language_id.LEAST_SHARE else 0.0 for n in names}
    values = {}
    for i, row in enumerate(rows):
        host = re.match(r"(?:[^:/?#]+://)?([^/?#:]*)", row[3] or "")[1].lower() or None
        parts = host.split(".") if host else []
        values[i] = {"host": host, "suffix": parts[-1] if len(parts) > 1 else None, "domain": ".".join(parts[-2:]) if len(parts) > 2 else None, "declared": tag(row[2])}
    kinds = {v: len({values[i][v] for i in values} - {None}) for v in ("suffix", "declared")}
    out = []
    for i, row in enumerate(rows):
        if not grams[i]:
            out.append((row[0], None, 0.0, False))
            continue
        rest = {n: sum(share[j][n] for j in share if j != i) for n in names}
        sums = lambda v: {n: sum(share[j][n] for j in share if j != i and values[i][v] is not None and values[j][v] == values[i][v]) for n in names}
        prior = {n: (rest[n] + 1) / (sum(rest.values()) + len(names)) for n in names}
        for level in ("suffix", "domain", "host"):
            own = sums(level)
            prior = {n: (own[n] + language_id.SMOOTHING * prior[n]) / (sum(own.values()) + language_id.SMOOTHING) for n in names}
        logs = {n: scale[i] * score[i][n] + math.log(prior[n]) for n in names}
        for v in ("declared", "suffix"):
            if values[i][v] is not None:
                own = sums(v)
                logs = {n: logs[n] + math.log((own[n] + language_id.ALPHA) / (rest[n] + language_id.ALPHA * kinds[v])) for n in names}
        best = max(names, key=lambda n: (logs[n], [-ord(c) for c in n]))
        posterior = 1 / sum(math.exp(logs[n] - logs[best]) for n in names)
        out.append((row[0], best, posterior, posterior >= min_posterior and max(score[i].values()) >= language_id.FOREIGN))
    return out


def test_fusion_is_that_of_brute_force(spark):
    draw = random.Random(6)
    rows = []
    for i in range(90):
        language = draw.choice(list(SYLLABLES))
        text = draw.choice([invented(language, draw, draw.choice([1, 2, 30])), invented(language, draw, 3), "", None, "12 34", "он не"])
        declared = draw.choice([language, language.upper() + "-x", draw.choice(list(SYLLABLES)), None, " ", "zz" if i % 9 == 0 else "en"])
        rows.append((i, text, declared, draw.choice([None, "", f"http://a.{language}.example.net/p", f"{language}.org", "localhost", "x.y.example.net"])))
    rows += [(500, rows[0][1], "en", None)] * 2
    docs = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, text string, lang string, source string, Language string")
    got = sorted((r["doc_id"], r["language"], r["posterior"], r["accepted"]) for r in language_id.identify(docs.repartition(3)).collect())
    wanted = sorted(dense_fusion(rows, None), key=lambda r: r[0])
    assert [(g[0], g[1], g[3]) for g in got] == [(w[0], w[1], w[3]) for w in wanted]
    assert all(abs(g[2] - w[2]) < 1e-4 for g, w in zip(got, wanted, strict=True))


def test_five_thousand_tags(spark):
    """Junk tags cost what their few trigrams cost, on the driver as in the rows."""
    draw = random.Random(3)
    letters = "abcdefghijklmnopqrstuvwxyz"
    tags = sorted({"".join(draw.choices(letters, k=5)) for _ in range(5000)})
    rows = [(i, f"{tag} {tag[::-1]} {tag}", tag, None) for i, tag in enumerate(tags)]
    rows += [(10_000 + i, invented("en", draw), "en", "a.example.org") for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    began = time.monotonic()
    languages, model = language_id.train(docs, "text", "lang", "doc_id")
    assert len(languages) == len(tags) + 1 and model.more.nbytes + model.language.nbytes < 2_000_000
    got = language_id.identify(docs).where("doc_id >= 10000").collect()
    assert sum(r["language"] == "en" and r["accepted"] for r in got) >= 0.98 * 300 and time.monotonic() - began < 120


def test_very_long_repeated_and_tied_documents(spark):
    docs = spark.createDataFrame(
        [(1, "the and of " * 200_000, "en", None), (2, "le et la " * 20, "fr", None), (3, "the and", None, None), (3, "le et la", None, None), (None, "12", None, None), (5, "12", "en", "h.example.org"), (3, "...", None, None)]
        + [(7, "the and of", "en", None)] * 3,
        "doc_id long, text string, lang string, source string",
    )
    got = {(r["doc_id"], r["language"]) for r in language_id.identify(docs).collect()}
    assert {(1, "en"), (2, "fr"), (3, "en"), (3, "fr"), (7, "en"), (None, None), (5, None)} <= got
    kept = language_id.accepted_only(docs)
    assert sorted((str(r["doc_id"]), len(r["text"])) for r in kept.collect()) == sorted([("1", 2_200_000), ("2", 180), ("3", 7), ("3", 8)] + [("7", 10)] * 3)


def test_pages_are_identified_by_markup_and_address(spark):
    draw = random.Random(2)
    rows = [(i, f"https://www.{lang}.example.net/{i}", f"<html lang='{lang}'><style>p{{}}</style><p>{invented(lang, draw, 12)}</p><script>the the</script>") for i, lang in enumerate(["en", "fr", "de"] * 12)]
    rows += [(100, None, None), (101, "https://www.fr.example.net/", f"<p>{invented('fr', draw, 2)}"), (102, "x", "<html lang=en>123")]
    pages = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, Posterior string")
    got = {r["page_id"]: r for r in language_id.identify_pages(pages).collect()}
    assert len(got) == len(rows) and all(got[i]["language"] == lang and got[i]["accepted"] for i, lang in enumerate(["en", "fr", "de"] * 12))
    assert got[100]["language"] is None and got[101]["language"] == "fr" and not got[102]["accepted"]
    plain = [(r[0], re.sub(r"(?is)<(script|style)\b.*?</\1\s*>|<[^>]*>", " ", r[2]) if r[2] else None, (re.search(r"lang='?([a-z]+)", r[2] or "") or [None, None])[1], r[1]) for r in rows]
    wanted = {w[0]: w for w in dense_fusion(plain, None)}
    assert all((got[i]["language"], got[i]["accepted"]) == (wanted[i][1], wanted[i][3]) for i in got)


def test_rows_of_one_id_stay_or_go_by_themselves(spark):
    same = "a text of some words that stands here twice and more"
    docs = spark.createDataFrame(
        [(1, same), (5, same), (5, "another text, and one that nobody else has got"), (None, same), (None, "no id and no copy of it anywhere at all"), (None, "two without ids"), (None, "two without ids"), (1, same)],
        "doc_id long, text string",
    )
    kept = sorted((str(r["doc_id"]), r["text"][:8]) for r in simhash.one_of_each_group(docs).collect())
    assert kept == sorted([("1", "a text o")] * 2 + [("5", "another "), ("None", "no id an")] + [("None", "two with")] * 2)


def test_language_without_labels_or_rows(spark):
    docs = odd_docs(spark).drop("lang").selectExpr("*", "cast(null as string) as lang")
    assert language_id.identify(docs).where("accepted").count() == 0
    assert language_id.identify(odd_docs(spark, [])).count() == 0


def test_pages_declare_their_language(spark):
    row = spark.createDataFrame([(1, "http://a.example/x", "<html lang='fr-CA'><script>var a</script><p>le chat</p>")], "page_id long, url string, html string")
    got = row.select(language_id.declared_in_page(row.html), language_id.text_of_page(row.html)).first()
    assert got[0] == "fr-CA" and got[1].split() == ["le", "chat"]


def test_bpe_splits_with_written_out_classes_as_by_their_names():
    """Every code point that isn't left to the library, alone and between others."""
    by_name = regex.compile(bpe.SPLIT).findall
    plain = [chr(point) for point in range(0x10000) if not 0xD800 <= point < 0xE000 and not regex.match(bpe.RARE, chr(point))]
    for texts in (plain, [f"a{c}1{c}{c}'s" for c in plain], ["".join(plain)]):
        assert [bpe.split_pattern().findall(text) for text in texts] == [by_name(text) for text in texts]
