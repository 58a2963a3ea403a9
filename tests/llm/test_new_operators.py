"""Phrase collocations, licence scan and conversation trie against brute force, and odd rows."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from polderlake.llm import collocations, conversation_trie, license_scan, quotient_filter
from polderlake.llm.conversation_trie import SpillingQueue

LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})

# --- quotient filters -------------------------------------------------------------------------------------------


def some_keys(bits, n, seed):
    draw = np.random.default_rng(seed)
    words = draw.integers(1, min(2**bits, 40) if seed % 2 else 2**bits, (n, 4), dtype=np.uint64).astype(np.uint32)
    words[draw.random(n) < 0.5, 2:] = 0
    return words


@pytest.mark.parametrize("bits", [1, 3, 14, 16, 17, 23, 32])
def test_a_filter_gives_back_every_phrase_and_count(bits):
    words = some_keys(bits, 3000, bits) if bits > 1 else np.ones((50, 4), np.uint32)
    keys = quotient_filter.counted(words, bits)
    for slice_bits in (0, min(5, 2 * bits)):
        back = []
        for prefix, part in quotient_filter.slices(keys, slice_bits):
            stored = quotient_filter.QuotientFilter(quotient_filter.QuotientFilter.of(part, prefix, slice_bits).stored)
            back.append(stored.keys())
            for i in range(0, len(part), 97):
                assert stored.count(int(part.high[i]), int(part.low[i])) == part.count[i]
                other = quotient_filter.counted(np.array([[1, 1, 1, 0]], np.uint32), bits)
                there = np.flatnonzero((part.high == other.high[0]) & (part.low == other.low[0]))
                assert stored.count(int(other.high[0]), int(other.low[0])) == (part.count[there[0]] if len(there) else 0)
        whole = quotient_filter.merged(back)
        found = quotient_filter.unpacked(*quotient_filter.restored(whole.high, whole.low, whole.half), bits)
        assert {tuple(r): int(c) for r, c in zip(found.tolist(), whole.count, strict=True)} == Counter(map(tuple, words.tolist()))


def test_merged_filters_hold_the_sums():
    parts = [some_keys(15, 1000, 3 + 2 * i) for i in range(5)]
    merged = quotient_filter.merged([quotient_filter.counted(p, 15) for p in parts])
    one = quotient_filter.counted(np.concatenate(parts), 15)
    assert all((getattr(merged, name) == getattr(one, name)).all() for name in ("high", "low", "count"))


# --- collocations -----------------------------------------------------------------------------------------------


def brute_collocations(docs, least, first):
    grams = defaultdict(Counter)
    for lang, text in docs:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            words = re.findall(r"[^\x20\x09]+", piece)
            for m in range(1, 5):
                grams["und" if lang is None else lang].update(tuple(words[i : i + m]) for i in range(len(words) - m + 1))
    out = []
    for lang, f in grams.items():
        candidates = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        kept = []
        for p, a in candidates.items():
            if any(100 * b >= 80 * a and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1)) for q, b in candidates.items() if len(q) > len(p)):
                continue
            score, k = min((2_000_000 * a // (f[p[:k]] + f[p[k:]]), k) for k in range(1, len(p)))
            kept.append((score, a, " ".join(p), f[p[:k]], f[p[k:]]))
        kept.sort(key=lambda x: (-x[0], -x[1], x[2].encode()))
        n = sum(c for p, c in f.items() if len(p) == 1)
        out += [(lang, i + 1, p, a, left, right, n, score) for i, (score, a, p, left, right) in enumerate(kept[:first])]
    return sorted(out)


def phrase_docs(seed=1, n=120):
    draw = random.Random(seed)
    vocabulary = ["a", "B", "Ça", "d", "e-f", "g", "日本", "zz"]
    docs = []
    for i in range(n):
        words = [draw.choice(vocabulary) for _ in range(draw.randint(0, 60))]
        if draw.random() < 0.6:
            words[3:3] = ["New", "york\tcity", "HALL"]
        docs.append((draw.choice(["en", "en", "und", None, "", "fr"]), "".join(w + draw.choice([" ", " ", "  ", ". ", ",", "\n", "\r\x0b"]) for w in words)))
    return docs + [("en", None), (None, ""), ("fr", " .,; \n"), ("xx", "one " * 5000), ("en", "big long text " * 4000 + "end"), ("de", "only"), ("en", docs[0][1]), ("en", docs[0][1])]


def found_phrases(spark, docs, **how):
    frame = spark.createDataFrame([(*d, 1, "x") for d in docs], "lang string, text string, RANK int, phrase string")
    return sorted(tuple(r) for r in collocations.collocations(frame.repartition(3), **how).collect())


@pytest.mark.parametrize("how", [{"least": 5, "first": 2000}, {"least": 12, "first": 7, "shard_bytes": 3000, "held_bytes": 5000, "slice_phrases": 50, "bloom_bits": 5}])
def test_phrases_are_those_of_brute_force(spark, how):
    docs = phrase_docs()
    assert found_phrases(spark, docs, **how) == brute_collocations(docs, how["least"], how["first"])


def test_filters_that_go_on_early_give_the_same_phrases(spark, monkeypatch):
    monkeypatch.setattr(collocations, "HELD_PHRASES", 40)
    monkeypatch.setattr(collocations, "NUMBERED", 3)
    docs = phrase_docs(5, 60)
    assert found_phrases(spark, docs, least=4) == brute_collocations(docs, 4, 2000)


def test_ties_with_the_last_place_are_settled_by_bytes(spark):
    docs = [("en", "Z y. z x. é y. a b. à b. " * 30)]
    assert found_phrases(spark, docs, first=3) == brute_collocations(docs, 30, 3)


def test_no_documents_have_no_phrases(spark):
    assert found_phrases(spark, []) == []
    assert found_phrases(spark, [(None, None), ("en", "too few words")]) == []


def test_scores_are_exact_beyond_64_bits(spark):
    large = 2**61
    phrases = spark.createDataFrame([("en", [1, 2], large), ("en", [1, 2, 3], large - 1)], "lang string, ids array<long>, f long")
    words = spark.createDataFrame([(1, large + 5), (2, large), (3, large)], "id long, f long")
    found = {tuple(r["ids"]): (r["l"], r["r"], r["score"]) for r in collocations.scored(phrases.unionAll(spark.createDataFrame([("en", [2, 3], large)], phrases.schema)), words).collect()}
    assert found[1, 2] == (large + 5, large, 2_000_000 * large // (2 * large + 5))
    assert found[1, 2, 3] == (large + 5, large, 2_000_000 * (large - 1) // (2 * large + 5))


# --- licence scan -----------------------------------------------------------------------------------------------

SCANNER = license_scan.Scanner(license_scan.BASE_PHRASES, license_scan.NOTICES, license_scan.TAGS)


def brute_base(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
    places = [(i, label) for phrase, label in license_scan.BASE_PHRASES.items() for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split()]
    starts = [i for i, _ in places]
    return len(words), len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted({label for _, label in places}))


PARTS = ["under", "the", "MIT", "License", "apache", "LICENSE", "version", "2", "2.0", "cc", "BY", "nc", "cc-by-nc", "é", "x", "SPDX-License-Identifier: MIT"]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(PARTS) | st.text(max_size=4), max_size=40), st.sampled_from([" ", "\n", "-", " \t"]))
def test_base_phrases_are_those_of_brute_force(parts, between):
    text = between.join(parts)
    found = SCANNER.scan(text.encode("utf-8"))
    assert (found.n_words, found.n_base, found.first_word, found.last_word, ",".join(sorted(found.base_labels))) == brute_base(text)
    assert found.base_labels <= found.labels and 0 <= found.score <= 1


def by_recursion(tokens):
    """Descent over the grammar: or < and < with."""
    at = 0

    def operand():
        nonlocal at
        if at < len(tokens) and tokens[at] == "(":
            at += 1
            value = level("or")
            at += 1
            return value
        at += 1
        name = license_scan.licence(tokens[at - 1])
        return {name}, license_scan.RESTRICTION.get(name, license_scan.UNKNOWN)

    def level(operator):
        nonlocal at
        below = {"or": lambda: level("and"), "and": lambda: level("with"), "with": operand}[operator]
        value = below()
        while at < len(tokens) and tokens[at] == operator:
            at += 1
            other = below()
            if operator == "with":
                value = value[0], max(0.0, round(value[1] - license_scan.EXCEPTION, 6))
            else:
                value = value[0] | other[0], (min if operator == "or" else max)(value[1], other[1])
        return value

    return level("or")


def test_expressions_are_those_of_recursive_descent():
    draw = random.Random(2)
    names = ["mit", "apache-2.0", "gpl-2.0-only", "gpl-3.0-or-later", "lgpl-2.1+", "cc-by-nc-4.0", "bsd-3-clause", "own-terms"]

    def made(depth):
        if depth == 0 or draw.random() < 0.3:
            name = draw.choice(names)
            return [name, "with", "classpath-exception-2.0"] if draw.random() < 0.2 else [name]
        inner = [*made(depth - 1), draw.choice(["and", "or"]), *made(depth - 1)]
        return ["(", *inner, ")"] if draw.random() < 0.5 else inner

    for _ in range(300):
        tokens = made(4)
        line = " ".join(tokens).replace("( ", "(").replace(" )", ")")
        assert license_scan.expression_tokens(line + " */") == tokens
        terms = license_scan.evaluate(license_scan.reverse_polish(tokens))
        assert (set(terms.labels), terms.restriction) == by_recursion(tokens)


@pytest.mark.parametrize(
    ("text", "labels", "score"),
    [
        ("/* SPDX-License-Identifier: (MIT OR GPL-2.0-only) */", "gpl,mit", 0.1),
        ("SPDX-License-Identifier: MIT AND GPL-2.0-or-later WITH Classpath-exception-2.0\nnext", "gpl,mit", 0.5),
        ("# spdx-license-identifier: Apache-2.0", "apache-2", 0.15),
        ("SPDX-License-Identifier: MIT OR", "mit", 0.1),
        ("SPDX-License-Identifier:", "", 0.0),
        ("SPDX-License-Identifier: ) or (", "", 0.0),
        ("Permission is hereby granted, free of charge, to any person obtaining a copy", "mit", 0.1),
        ("All rights\nreserved.", "all-rights-reserved", 1.0),
        ("licensed under the GNU General Public License, version 3", "gpl", 0.7),
        ("a general public park, all rights of way reserved", "", 0.0),
        ("License-Expression: BSD-3-Clause\nand under the MIT License", "bsd,mit", 0.1),
    ],
)
def test_tags_and_notices(text, labels, score):
    found = SCANNER.scan(text.encode())
    assert (",".join(sorted(found.labels)), found.score) == (labels, score)


def test_license_query_on_odd_rows(spark):
    texts = [None, "", " . ", "cc by nc", "CC-BY-NC cc by nc", "é" * 100_000 + " under the mit license", "cc by nc", "x " * 200_000 + "cc by nc"]
    frame = spark.createDataFrame([(i if i % 3 else None, t, "kept", "old", -1) for i, t in enumerate(texts)], "doc_id long, text string, source string, Labels string, N_BASE int")
    found = license_scan.scan_licenses(frame)
    assert found.columns == ["doc_id", "source", *license_scan.RESULT]
    rows = sorted((tuple(r) for r in found.collect()), key=str)
    wanted = []
    for i, text in enumerate(texts):
        *base, label = brute_base(text)
        wanted.append((i if i % 3 else None, "kept", *base, label, label, license_scan.RESTRICTION.get(label, 0.0)))
    assert rows == sorted(wanted, key=str)
    assert license_scan.scan_licenses(frame.limit(0)).count() == 0


# --- conversation trie ------------------------------------------------------------------------------------------


def brute_trie(rows):
    turns = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            turns[conv].append((turn is not None, turn or 0, role or "", text or ""))
    turns = {c: [x[2:] for x in sorted(t)] for c, t in turns.items()}
    paths = {}
    for c, own in turns.items():
        h = zlib.crc32(str(c).encode()) % 6
        paths[c] = tuple(turns.get(c - c % 100, [])[:h] + own[h:])
    members = defaultdict(list)
    for c in sorted(paths):
        for d in range(len(paths[c]) + 1):
            members[paths[c][:d]].append(c)
    children = defaultdict(list)
    for node in members:
        if node:
            children[node[:-1]].append(node)
    totals = {}
    for node in sorted(members, key=len, reverse=True):
        saved = (len(members[node]) - 1) * (len(node[-1][1]) if node else 0)
        totals[node] = (sum(totals[x][0] for x in children[node]) or 1, saved + sum(totals[x][1] for x in children[node]))
    out = []
    for node, inside in members.items():
        ends = ",".join(str(c) for c in inside if len(paths[c]) == len(node))
        parent = members[node[:-1]][0] if node else None
        out.append((inside[0], len(node), parent, len(inside), len(children[node]), *totals[node], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def some_conversations(seed, convs=260, texts=3):
    draw = random.Random(seed)
    rows = []
    for c in draw.sample(range(5 * convs), convs):
        for turn in range(draw.randint(1, 9)):
            rows.append((c, draw.choice([turn, turn, turn, None]) if texts < 5 else turn, draw.choice(["user", "assistant", None]), draw.choice(["hello", "", None, "é\U0001f600", "x" * 40][:texts])))
    return rows


def trie_of(spark, rows, **how):
    frame = spark.createDataFrame([(*r, 5, "y") for r in rows], "conv_id long, turn long, role string, text string, DEPTH int, n_convs string")
    return sorted((tuple(r) for r in conversation_trie.prefix_trie(frame.repartition(3), **how).collect()), key=str)


@pytest.mark.parametrize(
    ("seed", "texts", "how"),
    [(1, 3, {}), (2, 2, {"shard_members": 2, "queue_items": 4}), (3, 5, {"shard_members": 1, "queue_items": 2}), (4, 1, {"shard_members": 20, "queue_items": 5})],
)
def test_the_trie_is_that_of_brute_force(spark, seed, texts, how):
    rows = [(c, i, r, t) for i, (c, _, r, t) in enumerate(some_conversations(seed, texts=texts))]
    assert trie_of(spark, rows, **how) == brute_trie(rows)


def test_groups_of_copies_share_their_nodes(spark):
    rows = [(c, t, "user", f"same {t}") for c in range(700) for t in range(4)] + [(c, t, "user", f"own {c}") for c in range(700, 900) for t in range(3)]
    assert trie_of(spark, rows, shard_members=50, queue_items=16) == brute_trie(rows)


def test_odd_conversations(spark):
    rows = [(None, 0, "user", "lost"), (7, None, None, None), (7, 0, "user", "a"), (7, 0, "user", "a"), (7, 0, "bot", "z"), (200, 1, "u", "first"), (201, 1, "u", "short"), (-3, 1, "u", "below zero"), (-105, 2, None, "x" * 100_000)]
    rows += [(300, t, "u", "again") for t in range(300)]
    assert trie_of(spark, rows) == brute_trie(rows)
    assert trie_of(spark, []) == []
    assert trie_of(spark, [(None, 1, "u", "no name")]) == []


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 50), max_size=200), st.integers(2, 9))
def test_the_spilling_queue_sorts(keys, items):
    queue = SpillingQueue(items)
    out = []
    for i, key in enumerate(keys):
        queue.push((key,), key)
        if i % 3 == 2:
            out.append(queue.pop())
            keys_left = sorted(keys[: i + 1])
            assert out[-1] <= keys_left[-1]
    rest = []
    while queue:
        assert queue.next_key() is not None
        rest.append(queue.pop())
    assert rest == sorted(rest) and sorted(out + rest) == sorted(keys)
