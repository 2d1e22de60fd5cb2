"""The text operators against brute force on small tables, and their defined edge cases."""

from __future__ import annotations

import hashlib
import itertools
import random
import re
import tracemalloc
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from linkwork.llm import benchmarks, chat, components, induced, licences, lines, merkle, packing, quality, simhash
from linkwork.llm import substrings, suffixes, wordbpe

LONG = " ".join(f"w{i % 977}x{i % 31}" for i in range(30000))
EDGES = [(1, None), (2, ""), (3, " \n\t"), (None, "only words here"), (None, None), (4, "é" * 60), (5, LONG)]


def corpus(seed: int, n: int = 40) -> list[tuple[int, str]]:
    """Texts with exact copies, near copies, shared passages and shared lines."""
    r = random.Random(seed)
    vocabulary = ["".join(r.choice("abcdefg") for _ in range(r.randint(1, 6))) for _ in range(300)]
    line = lambda: " ".join(r.choice(vocabulary) for _ in range(r.randint(1, 25)))
    shared = [line() for _ in range(4)]
    out: list[tuple[int, str]] = []
    for i in range(n):
        if out and r.random() < 0.2:
            text = r.choice(out)[1]
            words = text.split(" ")
            if r.random() < 0.6 and len(words) > 3:
                words[r.randrange(len(words))] = "edited"
            text = " ".join(words)
        else:
            text = "\n".join(r.choice([line(), line(), r.choice(shared)]) for _ in range(r.randint(1, 8)))
        out.append((2000 + i, text))  # no id of EDGES
    return out


def by_id(df, *columns):
    return {r.doc_id: tuple(r[c] for c in columns) for r in df.collect()}


# --- operator 1


@pytest.fixture(scope="module")
def word_bpe():
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def test_word_encoder_equals_tokenizers(word_bpe):
    from tokenizers import Tokenizer

    exact, fast = Tokenizer.from_file(word_bpe), wordbpe.WordEncoder(word_bpe)
    r = random.Random(3)
    some = ["'", "s", "t", "re", ".", "!?", " ", "\n", "É", "ß", "ſ", "ﬁ", "é", "12", "½", "日本", "<|endoftext|>", "Ab"]
    cases = ["".join(r.choice(some) for _ in range(r.randint(0, 12))) for _ in range(2000)]
    for text, ids in zip(cases, fast(cases), strict=True):
        assert ids.tolist() == exact.encode(text, add_special_tokens=False).ids, text


def test_packing_covers_every_token_once(spark, texts, word_bpe):
    rows = corpus(1) + EDGES
    pieces = packing.pack(texts(rows), word_bpe, max_tokens=64, max_segments=4, pool=5).collect()
    encode = wordbpe.WordEncoder(word_bpe)
    sequences: dict[int, list] = {}
    for p in pieces:
        sequences.setdefault(p.sequence_id, []).append(p)
    for some in sequences.values():
        at = 0
        for p in sorted(some, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert 0 < at <= 64 and len(some) <= 4 and all(p.sequence_tokens == at for p in some)
    tokens = {i: np.append(encode([t])[0], 1).astype("<u4") for i, t in rows if i is not None}
    for i, ids in tokens.items():
        at = 0
        for p in sorted((p for p in pieces if p.doc_id == i), key=lambda p: p.start):
            assert p.start == at and p.ids_crc32 == zlib.crc32(ids[at : at + p.length].tobytes())
            at += p.length
        assert at == len(ids)


def test_packing_without_cuts_keeps_examples_whole_and_counts_loss():
    packer = packing.Packer((100, 3, 60), False, 8, 0)
    r = random.Random(5)
    for i in range(200):
        n = r.randint(1, 50)
        loss = np.zeros(n, dtype=np.int64)
        loss[r.randint(0, n) :] = 1
        packer.add(packing.Piece(i, 0, np.zeros(n, dtype="<u4"), n, loss))
    packer.finish()
    rows = packer.rows
    assert sorted(x[0] for x in rows) == list(range(200))
    for _, group in itertools.groupby(rows, key=lambda x: x[5]):
        group = list(group)
        assert sum(x[2] for x in group) <= 100 and len(group) <= 3 and sum(x[7] for x in group) <= 60
    with pytest.raises(ValueError):
        packer.add(packing.Piece(1, 0, np.zeros(101, dtype="<u4"), 101, np.zeros(101, dtype=np.int64)))


# --- operator 2


@pytest.mark.parametrize("first", [1, 2])
def test_lines_equal_brute_force(spark, texts, monkeypatch, first):
    monkeypatch.setattr(lines, "FIRST", first)  # 1: many lines stay open for the second join
    rows = [(i, t) for i, t in corpus(2, 60)]
    all_lines = [(i, n, frozenset(x.split())) for i, t in rows for n, x in enumerate(t.split("\n"))]
    gone: dict[int, list[int]] = {i: [] for i, _ in rows}
    for k, (i, n, s) in enumerate(all_lines):
        if s and any(o and 5 * len(s & o) >= 4 * len(s | o) for _, _, o in all_lines[:k]):
            gone[i].append(n)
    got = by_id(lines.line_dedup(texts(rows)), "removed_lines", "kept")
    assert {i: sorted(v[0]) for i, v in got.items()} == gone
    text = dict(rows)
    for i, (_, kept) in got.items():
        assert kept == "\n".join(x for n, x in enumerate(text[i].split("\n")) if n not in gone[i])


def test_lines_joined_in_many_pieces_equal_those_joined_in_one(spark, texts, monkeypatch):
    monkeypatch.setattr(lines, "FIRST", 1)
    docs = texts(corpus(3, 60))
    want = by_id(lines.line_dedup(docs), "removed_lines", "kept")
    monkeypatch.setattr(lines, "PAIRS", 8)  # what a task holds is cut down again and again
    assert any(r for r, _ in want.values()) and by_id(lines.line_dedup(docs), "removed_lines", "kept") == want


def test_pairs_of_a_common_word_take_bounded_memory():
    r, size = np.random.default_rng(5), 2500
    p = np.zeros(size, dtype=lines.POSTING)
    p["key"], p["n"], p["low"] = r.permutation(size), 5, r.integers(0, 400, size)
    tracemalloc.start()
    try:
        got = [(x, y) for part in lines.candidates(p, p["key"], 0.8) for x, y in zip(*(i.tolist() for i in part), strict=True)]
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert peak < 80e6  # 3.1 million pairs
    low, key = p["low"].tolist(), p["key"].tolist()
    of = {v: [i for i in range(size) if low[i] == v] for v in set(low)}  # words of five agree in all bits or are no candidates
    want = {(i, j) for same in of.values() for i in same for j in same if key[i] < key[j]}
    assert len(got) == len(want) and set(got) == want


def test_lines_with_a_first_candidate_that_fails(spark, texts, monkeypatch):
    """Words whose bits cancel let a pair pass the bitmap; the line is then joined with all candidates."""
    monkeypatch.setattr(lines, "FIRST", 1)
    words = [f"v{i}" for i in range(400)]
    h = lines.Words([w.encode() for w in words]).hashes()
    bits = (lines.mixed(h ^ lines.MIX[0]) & np.uint64(63)).tolist()
    a, c = next((x, y) for i, x in enumerate(words) for j, y in enumerate(words[:i]) if bits[i] == bits[j])
    base = " ".join(f"common{i}" for i in range(9))
    rows = [(1, f"{base} {a} b1"), (2, f"{base} {c} d1 e1"), (3, f"{base} {c} d1"), (4, f"{base} {a} b1")]
    got = by_id(lines.line_dedup(texts(rows)), "removed_lines")
    sets = {i: set(t.split()) for i, t in rows}
    want = {i for i in sets if any(j < i and 5 * len(s & sets[i]) >= 4 * len(s | sets[i]) for j, s in sets.items())}
    assert {i for i, (r,) in got.items() if r} == want == {3, 4}


def test_lines_that_are_named_are_read_alone():
    """Reading some lines of texts gives them as reading all does; numbers that a text lacks name nothing."""
    r = random.Random(5)
    bodies = [[" ".join(f"w{r.randint(0, 9)}" for _ in range(r.randint(0, 7))) for _ in range(r.randint(0, 6))] for _ in range(30)]
    raw = [b"", *("\n".join(x).encode() for x in bodies), b"\n\n", b"last line"]
    numbers = [None if r.random() < 0.2 else r.sample(range(9), 3) for _ in raw[:-1]] + [[0]]
    rarity = np.array([r.randint(0, 3) for _ in range(lines.SKETCH)], dtype=np.uint8)
    column = lines.pa.array(numbers, lines.pa.list_(lines.pa.int32()))
    every, some = lines.Lines(raw, rarity), lines.Lines(raw, rarity, only=column)
    parts = lambda x: zip(x.text.tolist(), x.number.tolist(), x.classes().tolist(), np.split(x.words, x.first[1:]), strict=True)
    want = [(t, n, c, w.tolist()) for t, n, c, w in parts(every) if n in (numbers[t] or [])]
    assert want and [(t, n, c, w.tolist()) for t, n, c, w in parts(some)] == want
    none = lines.Lines(raw, rarity, only=lines.pa.array([[]] * len(raw), lines.pa.list_(lines.pa.int32())))
    assert not len(none.words) and not len(none.first) and not len(none.prefix(0.8)) and not len(none.classes())


def test_lines_without_a_wanted_word_are_not_read():
    r = random.Random(7)
    vocabulary = [f"w{i}" for i in range(60)]
    raw = ["\n".join(" ".join(r.choices(vocabulary, k=r.randint(0, 9))) for _ in range(r.randint(1, 6))).encode() for _ in range(40)]
    wanted = {"w3", "w17", "w58"}
    bits = np.zeros(lines.BITMAP, dtype=bool)
    bits[lines._bit(lines.Words([w.encode() for w in wanted]).hashes())] = True
    got = lines.Lines(raw, having=bits)
    bodies = [x.decode().split("\n") for x in raw]
    assert list(zip(got.text.tolist(), got.number.tolist(), strict=True)) == [
        (t, n) for t, body in enumerate(bodies) for n, x in enumerate(body) if wanted & set(x.split())
    ]
    assert got.n.tolist() == [len(set(bodies[t][n].split())) for t, n in zip(got.text.tolist(), got.number.tolist(), strict=True)]


@pytest.mark.parametrize("kind", [lines.POSTING, lines.SHARED])
def test_postings_meet_as_in_a_comparison_of_all(kind):
    r = np.random.default_rng(3)
    for keys in ([5, 6, 7], [-(2**63), 4, 2**63 - 1]):
        p = np.zeros(60, dtype=kind)
        p["word"], p["n"] = r.integers(0, 12, 60) + 2**32 - 12, r.integers(4, 40, 60)
        p["key"], p["number"] = r.choice(np.array(keys), 60), r.integers(0, 9, 60)
        if kind == lines.SHARED:
            p["th"] = r.choice(np.array([-9, 0, 8]), 60)
        p = p[np.argsort(lines._by_size(p["word"], p["n"]))]
        fit = (p["word"][:, None] == p["word"]) & (np.minimum(p["n"][:, None], p["n"]) >= 0.8 * np.maximum(p["n"][:, None], p["n"]) - 1e-9)
        np.fill_diagonal(fit, False)
        assert lines._with_partners(p, 0.8).tolist() == p[fit.any(axis=1)].tolist()
        places = [(int(x["key"]), int(x["number"]), int(x["th"]) if kind == lines.SHARED else 0) for x in p]
        rank = {x: i + 1 for i, x in enumerate(sorted(set(places)))}
        assert lines._line_numbers(p).tolist() == [rank[x] for x in places]


def test_lines_are_split_where_texts_were_dealt(spark, texts):
    """The texts are hashed and shuffled once: what stays is read from the dealt table, also of null and empty texts."""
    rows = [(1, "a b c d\n\nx"), (2, "x\na b c d"), (2, None), (3, None), (None, ""), (None, "x y\n")]
    out = lines.line_dedup(texts(rows))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "packed_texts_" in plan and "xxhash64" not in plan
    got = sorted((r.doc_id or 0, r.n_lines, r.removed_lines, r.kept or ("" if r.kept == "" else "null")) for r in out.collect())
    assert got == [
        (0, 1, [], ""),
        (0, 2, [], "x y\n"),
        (1, 3, [], "a b c d\n\nx"),
        (2, 0, [], "null"),
        (2, 2, [0, 1], ""),
        (3, 0, [], "null"),
    ]


@pytest.mark.parametrize("seed", [1, 2])
def test_lines_of_repeated_and_null_ids(spark, texts, seed):
    """Lines are known by id, number and text: rows that share an id keep what is theirs."""
    r = random.Random(seed)
    word = lambda: f"w{r.randint(0, 30)}"
    near = [" ".join(word() for _ in range(10)) for _ in range(4)]
    rows = []
    for _ in range(60):
        body = [r.choice([r.choice(near), r.choice(near) + " x", " ".join(word() for _ in range(r.randint(1, 6))), ""]) for _ in range(r.randint(1, 5))]
        rows.append((r.choice([None, None, 7, 7, 8, r.randint(20, 60)]), "\n".join(body)))
    rows += [rows[0], rows[5]]
    named = texts(rows).selectExpr("doc_id", "text", "xxhash64(text) AS th").collect()
    all_lines = sorted({(-(2**63) if x.doc_id is None else x.doc_id, n, x.th, frozenset(t.split())) for x in named for n, t in enumerate(x.text.split("\n"))}, key=lambda x: x[:3])
    gone = set()
    for k, (i, n, th, s) in enumerate(all_lines):
        if s and any(o and 5 * len(s & o) >= 4 * len(s | o) for *_, o in all_lines[:k]):
            gone.add((i, th, n))
    want = sorted((x.doc_id or 0, x.text, [n for n in range(x.text.count("\n") + 1) if (-(2**63) if x.doc_id is None else x.doc_id, x.th, n) in gone]) for x in named)
    out = lines.line_dedup(texts(rows)).collect()
    got = sorted((x.doc_id or 0, x.n_lines, x.removed_lines, x.kept) for x in out)
    drop = lambda t, g: "\n".join(x for n, x in enumerate(t.split("\n")) if n not in g)
    assert got == sorted((i, t.count("\n") + 1, g, drop(t, g)) for i, t, g in want)
    assert gone


def test_line_edges(spark, texts):
    df = texts([*EDGES, (6, "a b\n\nA b\na b"), (6, "a b\n\nA b\na b")])
    got = sorted((r.doc_id or -1, r.removed_lines) for r in lines.line_dedup(df).collect())
    assert [r for r in got if r[0] == 6] == [(6, [3]), (6, [3])]
    assert all(not r[1] for r in got if r[0] in (-1, 1, 2, 3))
    assert lines.line_dedup(texts([])).count() == 0
    assert lines.distinct_line_texts(texts([(1, "a b c"), (2, "a b c"), (3, None)])).columns == ["doc_id", "text", "key", "th", "h"]


# --- operator 3


def test_chat_folds_edits_and_regenerations(spark):
    rows = [
        (1, 1, 1, "delta", "user", "Hi <|im_end|>"),
        (1, 2, 2, "delta", "assistant", "wro"),
        (1, 3, 2, "delta", None, "ng"),
        (1, 4, 2, "regenerate", None, None),
        (1, 6, 2, "delta", None, "<\\|ok"),
        (1, 5, 2, "delta", None, "it is "),
        (1, 7, 1, "edit", None, "Hello <|im_start|>"),
        (None, 1, 1, "delta", None, None),
    ]
    events = spark.createDataFrame(rows, "conv_id long, seq long, message long, kind string, role string, text string")
    messages = {(r.conv_id, r.message): (r.role, r.text) for r in chat.fold(events).collect()}
    assert messages == {(1, 1): ("user", "Hello <|im_start|>"), (1, 2): ("assistant", "it is <\\|ok"), (None, 1): ("", "")}
    out = chat.render(chat.fold(events))
    out = out.selectExpr("*").withColumns({"t": chat.parse(out.formatted), "m": chat.masked(out.formatted, out.loss_spans)})
    got = {r.conv_id: r for r in out.collect()}
    assert [tuple(x) for x in got[1].t] == [messages[1, 1], messages[1, 2]] and got[1].m == "it is <\\|ok"
    assert got[1].formatted.count("<|im_start|>") == got[1].formatted.count("<|im_end|>") == 2
    assert chat.render(chat.fold(events.limit(0))).count() == 0


# --- operator 4


def test_licence_scan(spark, texts):
    notices = [(100 + k, f"prose before\n{ts[0]}\nprose after") for k, ts in enumerate(licences.NOTICES.values())]
    rows = corpus(4) + EDGES + notices + [(99, "I have a license to drive under the rain")]
    df = texts(rows)
    got = {(r.doc_id, r.paragraph): r.family for r in licences.scan(df, licences.fit(df)).collect()}
    assert got == {(100 + k, 1): f for k, f in enumerate(licences.NOTICES)}
    assert licences.scan(texts([]), licences.fit(texts([]))).count() == 0


def test_licence_cues_are_rare_and_lose_no_notice(spark):
    """Ordinary prose has no cue; whatever words a notice may lack, one of its cues is found."""
    word_lists = [sorted(set(r.w)) for r in licences._notices(spark).collect()]
    cues = licences._cues(word_lists, 0.7)
    assert "is" not in cues  # begins every other line of prose
    pattern = licences._cue_pattern(cues)
    spots = [" " + " ".join(w[:at] + ["zz"] + w[at:]) for w in word_lists for at in range(len(w))]
    for w in word_lists:
        hit = [x for x in w if re.search(pattern, " " + x)]
        assert len(hit) > len(w) * 0.3 - 1e-9, w  # more than may be missing
        spots += [f"(2.0{x}" for x in hit if x[0].isalpha()] + [f"{x}\n" for x in hit]
    prose = ["This list is in his information about a platform, unlicensed and recommon", "IS THIS THE ISLAND", "", None]
    rows = [(i, t) for i, t in enumerate(prose + spots)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = df.where(F.concat(F.lit(" "), F.lower("text")).rlike(pattern)).select("doc_id").collect()
    assert {r.doc_id for r in found} == set(range(len(prose), len(rows)))


def test_near_licences_are_unknown(spark, texts):
    near = ["Licensed under the Eclipse Public License, version 2.0.", "This project is licensed under the terms of the ISC license.",
            "Licensed under the Artistic License, version 2.0.", "Released under the Zlib License.", "Licensed under the EUPL 1.2",
            "She said that all of her human rights had been reserved by the court and the journalists",
            "The fishing boats are released under the terms of the new permit to the license office by the harbour master",
            "Reserved by all, the rights to the wood were sold. " * 20]
    rows = [(i, t) for i, t in enumerate(near)] + [(50, "so: Licensed under the MIT license, as ever"), (51, "far " * 300 + "all rights reserved" + " far" * 300)]
    df = texts(rows + corpus(9))
    got = {(r.doc_id, r.family) for r in licences.scan(df, licences.fit(df)).collect()}
    assert got == {(50, "mit"), (51, "proprietary")}


def test_licence_scan_of_wrapped_notices(spark, texts):
    mit = (
        "Permission is hereby granted, free of charge, to any person obtaining a copy\n"
        'of this software and associated documentation files (the "Software"), to deal\n'
        "in the Software without restriction, including without limitation the rights\n"
        "to use, copy, modify, merge, publish, distribute, sublicense, and/or sell"
    )
    gpl = (
        "# This program is free software: you can redistribute it and/or modify\n"
        "# it under the terms of the GNU General Public License as published by\n"
        "# the Free Software Foundation, either version 3 of the License, or"
    )
    narrow = "prose first\nThis work is licensed\nunder the GNU General\nPublic License, version 3.\nprose last"
    rows = [(1, f"x.py\n\n{mit}\n\nmore"), (2, f"# x.py\n#\n{gpl}\n#\nimport x"), (3, narrow)]
    rows += [(4, f"{mit}\n\n{gpl}"), (4, "Released under the\n\nMIT License."), (None, mit), (None, gpl), (None, f"a\n{mit}")]
    df = texts(rows + corpus(15))
    got = [(r.doc_id, r.paragraph, r.family) for r in licences.scan(df, licences.fit(df)).collect()]
    assert sorted((i or 0, f) for i, _, f in got) == [(0, "gpl"), (0, "mit"), (0, "mit"), (1, "mit"), (2, "gpl"), (3, "gpl"), (4, "gpl"), (4, "mit")]
    lines_of = {(i, f): p for i, p, f in got if i}
    assert lines_of == {(1, "mit"): 2, (2, "gpl"): 2, (3, "gpl"): 1, (4, "mit"): 0, (4, "gpl"): 5}


# --- operator 5


def test_quality(spark, texts):
    r = random.Random(7)
    good = lambda: " ".join(r.choice(["the", "house", "river", "walks", "slowly", "under", "trees"]) + r.choice("abc") for _ in range(80))
    rows = [(i, good() if i % 3 else good().upper().replace(" ", "!! ")) for i in range(300)] + [(None, "x"), (900, None)]
    labels = spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(300)] + [(None, 1), (5000, None)], "doc_id long, quality int")
    out = quality.quality_scores(texts(rows), labels).collect()
    assert len(out) == len(rows)
    tested = [x for x in out if x.held_out and x.doc_id < 300]
    assert tested and all(x.predicted == int(x.doc_id % 3 > 0) for x in tested)
    assert all(x.held_out == (zlib.crc32(str(x.doc_id).encode()) % 3 == 1) for x in out if x.doc_id is not None)
    none = quality.quality_scores(texts(rows), labels.limit(0)).collect()
    assert {x.score for x in none} == {0.5} and quality.quality_scores(texts([]), labels).count() == 0


# --- operator 6


def test_benchmark_windows_equal_brute_force(spark, texts):
    r = random.Random(8)
    word = lambda: "".join(r.choice("abcdef") for _ in range(4))
    items = [(i, " ".join(word() for _ in range(r.choice([3, 12, 25, 40])))) for i in range(12)] + [(50, None), (51, " ")]
    rows = []
    for i in range(40):
        words = [word() for _ in range(r.randint(0, 60))]
        passage = (items[i % 12][1]).split()
        if i % 2:
            at = r.randrange(len(passage))
            if i % 4 == 1:
                passage[at] = "other" if at in (0, len(passage) - 1) else passage[at].upper() + ","
        words[5:5] = passage if i % 5 else []
        rows.append((300 + i, " ".join(words)))
    df, bench = texts(rows + EDGES), spark.createDataFrame(items, "item_id long, text string")
    got = {(x.doc_id, x.item_id): (x.start, round(x.similarity, 9)) for x in benchmarks.contaminated(df, bench).collect()}
    real = [(i, t) for i, t in items if t and t.strip()]
    counts: dict = {}
    for s in benchmarks.shingles([benchmarks.normal(t) for _, t in real], 5):
        for x in set(s.tolist()):
            counts[x] = counts.get(x, 0) + 1
    model = benchmarks.Items([(i, t) for i, t in real], 13, counts, 5, 20)
    want = {}
    for i, t in rows:
        words = benchmarks.normal(t).split()
        for k, item in enumerate(model.ids):
            n = int(model.sizes[k])
            for at in range(len(words) - n + 1):
                s = benchmarks.shingles([b" ".join(words[at : at + n])], 5)[0]
                sim = model.similarity(k, s)
                if sim >= 0.8 - 1e-12 and ((i, item) not in want or sim > want[i, item][1]):
                    want[i, item] = (at, sim)
    assert got == {k: (a, round(s, 9)) for k, (a, s) in want.items()} and len(got) > 20
    clean = {x.doc_id for x in benchmarks.clean_documents(df, bench).collect()}
    assert clean == {i for i, _ in rows + EDGES} - {k[0] for k in want}
    assert benchmarks.contaminated(texts([]), bench).count() == 0 == benchmarks.contaminated(df, bench.limit(0)).count()
    small = benchmarks.contaminated(df, bench, block_bytes=200).select("doc_id").distinct()
    assert {x.doc_id for x in small.collect()} == {k[0] for k in want}


def test_benchmark_items_longer_than_the_document(spark, texts):
    items = [(1, " ".join(f"u{i}" for i in range(40))), (2, " ".join(f"v{i}" for i in range(40))), (3, "u0 u1 u2")]
    words = items[0][1].split()
    rows = [(1, " ".join(words[:-2])), (2, " ".join(words[3:])), (3, " ".join(words[:20])), (4, "u0 u1 u2 u3"), (5, items[1][1])]
    df, bench = texts([*rows, (None, None)]), spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id): (r.start, r.n_words, r.similarity) for r in benchmarks.contaminated(df, bench).collect()}
    short = {(1, 3), (3, 3), (4, 3)}
    assert set(got) - short == {(1, 1), (2, 1), (5, 2)} and short <= set(got)
    assert got[1, 1] == (0, 38, pytest.approx(34 / 36)) and got[2, 1] == (0, 37, pytest.approx(33 / 36))  # equal weights
    assert {r.doc_id for r in benchmarks.clean_documents(df, bench).collect()} == {None}


def test_benchmark_blocks_share_the_counts_of_all_items(spark, texts):
    r = random.Random(14)
    word = lambda: "".join(r.choice("abcdef") for _ in range(5))
    common = [" ".join(word() for _ in range(14)) for _ in range(3)]  # passages that items of every block have
    items = [(i, f"{' '.join(word() for _ in range(16))} {common[i % 3]}") for i in range(24)] + [(60, "one two")]
    rows = []
    for i in range(72):
        words = items[i % 24][1].split()
        words[r.randrange(2) if i % 2 else -1 - r.randrange(3)] = "other"
        words = words if i % 3 else words[2:]  # some shorter than the item
        rows.append((i, " ".join([word() for _ in range(i % 4)] + words)))
    df, bench = texts([*rows, rows[5], (None, rows[7][1])]), spark.createDataFrame(items, "item_id long, text string")
    found = []
    for size in (1 << 20, 900):
        got = benchmarks.contaminated(df, bench, block_bytes=size).collect()
        found.append(sorted((x.doc_id or -1, x.item_id, x.start, x.n_words, round(x.similarity, 9)) for x in got))
    assert found[0] == found[1] and len(found[0]) > 30


# --- operators 7 and 8


def test_substrings_equal_brute_force(spark, texts):
    rows = corpus(9, 60)
    k, first = 5, {}
    for i, t in rows:
        w = t.split()
        for j in range(len(w) - k + 1):
            first.setdefault(tuple(w[j : j + k]), i)
    got = by_id(substrings.remove_repeats(texts(rows), k=k), "n_words", "n_removed", "kept")
    for i, t in rows:
        w = t.split()
        out = {p for j in range(len(w) - k + 1) if first[tuple(w[j : j + k])] < i for p in range(j, j + k)}
        assert got[i] == (len(w), len(out), " ".join(x for p, x in enumerate(w) if p not in out))


def test_suffixes_equal_brute_force(spark, texts):
    rows = corpus(10, 60)
    size, first = 30, {}
    for i, t in rows:
        for j in range(len(t) - size + 1):
            first.setdefault(t[j : j + size], i)
    got = by_id(suffixes.remove_repeated_bytes(texts(rows), size=size, memory=4096), "n_bytes", "n_removed", "n_spans", "kept")
    for i, t in rows:
        out = {p for j in range(len(t) - size + 1) if first[t[j : j + size]] < i for p in range(j, j + size)}
        spans = sum(p - 1 not in out for p in out)
        assert got[i] == (len(t), len(out), spans, "".join(x for p, x in enumerate(t) if p not in out).encode())


def test_repeat_edges(spark, texts):
    # rows of one id, also with other texts, do not remove each other's words; null ids come first
    same = " ".join(f"p{i}" for i in range(30))
    df = texts([*EDGES, (7, same), (7, same), (7, same + " more"), (8, "x " + same), (None, LONG)])
    words = sorted(((r.doc_id or -1), r.n_words, r.n_removed) for r in substrings.remove_repeats(df).collect())
    assert [x for x in words if x[0] == 7] == [(7, 30, 0), (7, 30, 0), (7, 31, 0)]
    assert (8, 31, 30) in words and (5, 30000, 30000) in words and (1, 0, 0) in words and (2, 0, 0) in words
    data = sorted(((r.doc_id or -1), r.n_removed, r.n_spans) for r in suffixes.remove_repeated_bytes(df).collect())
    assert [x for x in data if x[0] == 7] == [(7, 0, 0)] * 3 and (8, len(same), 1) in data and (5, len(LONG), 1) in data
    assert substrings.remove_repeats(texts([])).count() == 0 == suffixes.remove_repeated_bytes(texts([])).count()


@pytest.mark.parametrize("memory", [1 << 30, 2000])
def test_induced_sorting_groups_equal_windows(memory):
    r = random.Random(2)
    for trial in range(25):
        letters = "abcdefghijklmnopqrstuvwxyz"[: r.choice([1, 2, 4, 26])].encode()
        strings = list({bytes(r.choice(letters) for _ in range(r.randint(0, 200))) for _ in range(r.randint(1, 20))})
        strings = list({*strings, bytes([0, 255, 0]) * 40, b"\0" * 70})
        shard, size, seen, n = induced.Shard(strings, memory), r.choice([8, 50]), set(), 0
        for at, new in shard.equal_windows(size):
            windows = [shard.buf[p : p + size] for p in at.tolist()]
            assert [a != b for a, b in itertools.pairwise(windows)] == new[1:].tolist()
            fresh = {windows[i] for i in np.flatnonzero(new)}
            assert not fresh & seen and len(fresh) == new.sum()
            seen |= fresh
            n += len(at)
        assert n == sum(max(0, len(x) - size + 1) for x in strings)


# --- operator 9


def test_merkle(spark, texts):
    rows = corpus(11) + [(200, "a\n\nb"), (201, "a\n \nb"), (202, "a\n\n\nb"), *EDGES[:3], (4, "é" * 60)]
    out = {r.doc_id: r for r in merkle.fingerprints_with_edit(texts(rows)).collect()}
    text, ids = dict(rows), sorted((i for i, _ in rows), reverse=True)
    text = {i: t or "" for i, t in {**dict(EDGES[:3]), **text}.items()}
    prints: dict = {}
    if len(out) == len(rows):
        for k, i in enumerate(ids):
            after, own = text[ids[(k + 1) % len(ids)]], text[i]
            n = len(own) // 3
            edited = own[: len(own) - n] + after[:n]
            assert out[i].n_chars == len(own) and out[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
            assert (out[i].fingerprint == out[i].edited_fingerprint) == (own == edited)
    for i, r in out.items():
        assert prints.setdefault(r.fingerprint, text[i]) == text[i]
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
    before, after = texts([(1, "a\nb\n\nc\nd"), (2, "x")]), texts([(1, "a\nb\n\nc\nD\ne"), (2, "x")])
    changes = [tuple(r) for r in merkle.differing_branches(before, after).orderBy("section", "paragraph").collect()]
    assert changes == [(1, 1, 1, "changed"), (1, 1, 2, "added")]
    assert merkle.fingerprints_with_edit(texts([])).count() == 0
    one = merkle.fingerprints_with_edit(texts([(3, "abcdef")])).first()
    assert one.edited_sha256 == hashlib.sha256(b"abcdab").hexdigest() and one.near_next == 1


def test_merkle_likeness_of_long_texts(spark, texts):
    r = random.Random(13)
    long = lambda: " ".join("".join(r.choices("abcdefghijklmnop", k=7)) for _ in range(40000))  # noqa: E731  320 KB
    a, b = long(), long()
    out = {x.doc_id: x for x in merkle.fingerprints_with_edit(texts([(1, a), (2, b), (3, b + " more")])).collect()}
    piece = re.compile(merkle.PIECE)
    share = lambda x, y: len(x & y) / max(len(x), len(y))
    sets = {i: set(piece.findall(t)) for i, t in {1: a, 2: b, 3: b + " more"}.items()}
    assert out[2].near_next == share(sets[1], sets[2]) == 0 and out[1].near_next == share(sets[1], sets[3]) == 0
    assert out[3].near_next == pytest.approx(share(sets[2], sets[3])) and out[3].near_next > 0.99
    n = len(b) // 3
    assert out[2].near_edited == pytest.approx(share(sets[2], set(piece.findall(b[: len(b) - n] + a[:n]))))
    pairs = spark.createDataFrame([(out[1].fingerprint, out[2].fingerprint), (out[2].fingerprint, out[3].fingerprint)], "a string, b string")
    assert [x[0] for x in pairs.select(merkle.likeness("a", "b")).collect()] == [0, out[3].near_next]


# --- operator 10


def brute_fingerprint(text: str) -> int:
    words = [w for w in re.split(rb"[\x20\x09-\x0d]+", (text or "").encode()) if w]
    words = [bytes(c + 32 if 65 <= c <= 90 else c for c in w) for w in words]
    grams = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([b" ".join(words)] if words else [])
    h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash_groups_equal_brute_force(spark, texts):
    rows = corpus(12, 60) + [(100 + i, "One two É" if i % 2 else "one TWO\tÉ") for i in range(6)] + EDGES[:3]
    prints = {i: brute_fingerprint(t) for i, t in rows}
    group = {i: i for i in prints}
    for _ in prints:
        for a, b in itertools.combinations(prints, 2):
            if (prints[a] ^ prints[b]).bit_count() <= 3:
                group[a] = group[b] = min(group[a], group[b])
    for shard_rows in (32768, 3):
        got = by_id(simhash.simhash_groups(texts(rows), shard_rows=shard_rows), "fingerprint", "component_id")
        assert got == {i: (f"{f:016x}", group[i]) for i, f in prints.items()}
    empty = simhash.simhash_groups(texts([(None, None), (3, "")])).collect()
    assert [r.component_id for r in empty] == [None, None] and simhash.simhash_groups(texts([])).count() == 0


def test_simhash_forest_streams_queries():
    r = random.Random(16)
    values = list({(r.getrandbits(6) << 40) | r.getrandbits(5) for _ in range(200)})
    members, queries = values[::2], values[1::2]
    forest = simhash.Forest()
    for x in members:
        forest.add(x, 1)
    links = [(x, y) for x in queries if (y := forest.ask(x, 1)) is not None] + forest.rows()
    assert len(forest.parent) == len(members)  # queries are not kept

    def groups(edges):
        group = {x: x for x in values}
        for _ in values:
            for a, b in edges:
                group[a] = group[b] = min(group[a], group[b])
        return group

    near = [(a, b) for a in values for b in members if 0 < (a ^ b).bit_count() <= 1]
    assert groups(links) == groups(near) and len(links) <= len(values)


def test_components_of_a_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(60)] + [(1000, 1000 + i) for i in range(1, 60)] + [(-5, 7)]
    found = components.components(spark.createDataFrame(edges, "u long, v long")).collect()
    assert {r.node: r.root for r in found} == {**{i: -5 for i in [*range(61), -5]}, **{1000 + i: 1000 for i in range(60)}}
