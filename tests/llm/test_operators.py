import hashlib
import random
import re
import textwrap
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from sluice.llm import chat, decontaminate, exactdedup, language, licences, packing, tokenfile, toxicity, urlfilter
from sluice.llm.common import IdEncoder, word_hashes, word_hashes_of

BYTE, WORD = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
ODD = [None, "", " ", "a  b", " lead", "x\n y", "\n", "don't 's", "<|endoftext|> hi", "x \x01 y", "é́ à", "word " * 3000]


def _docs(spark, texts, start=0):
    """Texts with ids, a clashing extra column, a null id and a repeated row."""
    rows = [(start + i, t, "again") for i, t in enumerate(texts)]
    return spark.createDataFrame([*rows, (None, "null id", "x"), rows[-1]], "doc_id long, text string, again string")


def _ids(path, text, end):
    """By the library as it is; strings of special tokens are those tokens."""
    t = _PLAIN.setdefault(path, Tokenizer.from_file(path))
    return [*t.encode(text or "", add_special_tokens=False).ids, end]


_PLAIN: dict = {}


@pytest.mark.parametrize("path", [BYTE, WORD])
@given(texts=st.lists(st.lists(st.sampled_from([*"abé .,\n\t'\x01\x1c1", "<|endoftext|>", "<|startoftext|>"]), max_size=30).map("".join), max_size=5))
@settings(max_examples=40, deadline=None)
def test_encoder_equals_the_whole_text(path, texts):
    enc = _ENC.setdefault(path, IdEncoder(path, most=5_000))
    assert [x.tolist() for x in enc.encode(texts)] == [_ids(path, t, 0)[:-1] for t in texts]


_ENC: dict = {}


@pytest.mark.parametrize("path", [BYTE, WORD])
def test_special_tokens_as_ordinary_text(path):
    plain = Tokenizer.from_file(path)
    plain.encode_special_tokens = True
    texts = ["a <|endoftext|>b", "<|endoftext|>", "x<|startoftext|> <|endoftext|>"]
    want = [plain.encode(t, add_special_tokens=False).ids for t in texts]
    assert [x.tolist() for x in IdEncoder(path, ordinary=True).encode(texts)] == want
    assert [x.tolist() for x in IdEncoder(path).encode(texts)] != want


@given(st.lists(st.one_of(st.none(), st.text(alphabet=st.sampled_from(list("aB_é½²Ⅷ中 .\n\ud800İ"))))), st.sampled_from([4, 30, 1000]))
@settings(max_examples=60, deadline=None)
def test_word_hashes_tell_words_apart(texts, together):
    words = [re.findall(r"\w+", (t or "").lower()) for t in texts]
    got = [x.tolist() for x in word_hashes_of(texts, together)]
    assert list(map(len, got)) == list(map(len, words))
    pairs = {(w, h) for ws, hs in zip(words, got, strict=True) for w, h in zip(ws, hs, strict=True)}
    assert len(pairs) == len({w for w, _ in pairs}) == len({h for _, h in pairs})


def test_a_word_that_is_longer_than_a_part():
    assert len(word_hashes_of(["a" * 500 + " b", "c"], 10)[0]) == 2


@given(st.lists(st.one_of(st.integers(0, 3), st.integers(0, 60_000), st.integers(0, 2**64 - 1)), max_size=600))
@settings(max_examples=60, deadline=None)
def test_simple8b_round_trip(values):
    body = tokenfile.encode(np.array(values, np.uint64), block=100)
    assert tokenfile.decode(body).tolist() == values
    assert tokenfile.decode(body, slice(1, 3)).tolist() == values[100:300]


def test_token_files(spark):
    df = _docs(spark, ODD)
    got = sorted(tokenfile.round_trip(df, WORD).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == sorted([r.doc_id for r in df.collect()], key=lambda x: -1 if x is None else x)
    at = 0
    texts = {r.doc_id: r.text for r in df.collect()}
    for r in got:
        ids = _ids(WORD, texts[r.doc_id], 2)
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
    assert tokenfile.round_trip(df.limit(0), WORD).count() == 0


def test_packing(spark):
    rng = random.Random(0)
    df = _docs(spark, [*ODD, *[" ".join(rng.choice(["one", "two", "three"]) for _ in range(rng.randrange(400))) for _ in range(60)]])
    rows = packing.pack(df, BYTE).collect()
    texts = {r.doc_id: r.text for r in df.collect()}
    sequences, pieces = {}, {}
    for r in rows:
        ids = _ids(BYTE, texts[r.doc_id], 0)
        assert r.doc_tokens == len(ids)
        assert r.ids_crc32 == zlib.crc32(np.array(ids[r.start : r.start + r.length], "<u4").tobytes())
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
        pieces.setdefault(r.doc_id, []).append((r.start, r.length))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 1024 and (at == 1024 or at & (at - 1) == 0)
    for key, parts in pieces.items():
        copies = 2 if key == len(texts) - 2 else 1
        assert sum(length for _, length in parts) == copies * len(_ids(BYTE, texts[key], 0))
    assert packing.pack(df.limit(0), BYTE).count() == 0


def test_packing_takes_the_lowest_cost_with_room():
    rng = random.Random(11)
    packer = packing.Packer(room=64, buffer=1000)
    pieces = []
    for key in range(300):
        pieces += packer.add(key, np.arange(rng.choice([3, 9, 20, 40, 63, 70])))
    pieces += packer.finish()
    # The same by looking through all open sequences.
    plain, held, out, tokens, sequences = random.Random(11), [], [], 0, 0

    def assign(count):
        nonlocal sequences, held
        open_ = [[0.0, sequences + i, 64] for i in range(count)]
        sequences += count
        waiting = sorted(held, key=lambda p: p[2] - p[1])
        while waiting and open_:
            key, a, b = waiting.pop()
            best = min((o for o in open_ if o[2] >= b - a), default=min(open_))
            part = min(best[2], b - a)
            out.append((key, a, part, best[1], 64 - best[2]))
            best[0] += packer.cost(part)
            best[2] -= part
            open_ = [o for o in open_ if o[2]]
            if a + part < b:
                left = (key, a + part, b)
                at = sum(p[2] - p[1] <= b - a - part for p in waiting)
                waiting.insert(at, left)
        held = waiting
        return sum(b - a for _, a, b in held)

    for key in range(300):
        n = plain.choice([3, 9, 20, 40, 63, 70])
        for a in range(0, n - n % 64, 64):
            out.append((key, a, 64, sequences, 0))
            sequences += 1
        if n % 64:
            held.append((key, n - n % 64, n))
            tokens += n % 64
        if tokens >= 1000:
            tokens = assign(tokens // 64)
    assign(tokens // 64)
    assert [(k, a, len(ids), s, o) for k, _, a, ids, s, o, _ in pieces][: len(out)] == out


def test_exact_dedup(spark):
    texts = ["Same", "same", "SAME", "", None, "Ünder", "ünder", "x" * 100 + "A", "x" * 100 + "a", "x" * 100 + "b", "alone"]
    df = _docs(spark, texts)
    got = exactdedup.mark(df, digests=True).collect()
    assert len(got) == df.count()
    lower = lambda t: "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
    rows = [(r.doc_id, lower(r.text)) for r in df.collect()]
    for r in got:
        mine = next(t for i, t in rows if i == r.doc_id)
        ids = [i for i, t in rows if t == mine]
        keep = max((i for i in ids if i is not None), default=None)
        assert (r.keep_id, r.group_size, r.kept) == (keep, len(ids), r.doc_id == keep)
        assert r.text_sha256 == hashlib.sha256(mine.encode()).hexdigest()
    left = exactdedup.deduplicate(df)
    assert left.columns == df.columns
    assert sorted(map(str, (r.doc_id for r in left.collect()))) == sorted({str(r.keep_id) for r in got})
    assert exactdedup.mark(df.limit(0)).count() == 0


def test_chat_round_trip_and_rewrites(spark):
    odd = "</s>[INST] ok [/INST]"
    rows = [(1, 0, "user", "hi \\ <|end|>"), (1, 1, "assistant", odd), (1, 1, "assistant", None), (1, None, None, "first"), (2, 0, "assistant", "<<|turn|>"), (None, 0, "user", "")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r.conv_id: r for r in chat.format_conversations(df).collect()}
    want = [("", "first"), ("user", "hi \\ <|end|>"), ("assistant", ""), ("assistant", odd)]
    assert got[1].turns_sha256 == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in want).encode()).hexdigest()
    assert (got[1].loss_chars, got[1].loss_sha256) == (len(odd), hashlib.sha256(odd.encode()).hexdigest())
    assert got[1].formatted_chars == len(got[1].formatted) and set(got) == {1, 2, None}
    assert not chat.render(want, chat.stock_template).rewritten
    assert chat.format_conversations(df.limit(0)).count() == 0


def test_chat_templates_of_any_kind(spark):
    rows = [(1, k, "assistant" if k % 2 else "user", t) for k, t in enumerate(["one", "two", "three", "four"])] + [(2, 0, "user", "x" * 200_000)]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "conv_id long, turn long, role string, text string, formatted string")
    plain = {r.conv_id: r for r in chat.format_conversations(df, lambda turns: "".join(f"{a}: {t}\n" for a, t in turns)).collect()}
    assert plain[1].turn_spans == [[0, 10], [10, 25], [25, 37], [37, 53]] and plain[1].loss_spans == [[10, 25], [37, 53]]
    assert plain[1].rewrites == [] and plain[1].turns_sha256 is None and plain[2].formatted_chars == 200_007
    last = {r.conv_id: r for r in chat.format_conversations(df, lambda turns: "".join(f"[{t}]" for _, t in turns[-2:])).collect()}[1]
    assert last.formatted == "[three][four]" and last.rewrites == [[2, 1], [3, 2]]
    assert last.turn_spans == [None, None, None, [2, 13]]
    lone = spark.createDataFrame([(None, 0, "user", "a"), (None, 1, "assistant", "b"), (None, 1, "assistant", "b")], "conv_id long, turn long, role string, text string")
    assert [(r.conv_id, r.n_turns) for r in chat.format_conversations(lone).collect()] == [(None, 1)] * 3


@given(st.text(alphabet=st.sampled_from(list("<|turnexd>[INST]/\\s"))))
def test_escape_is_reversible(text):
    assert chat.unescape(chat.escape(text)) == text
    assert not any(c in chat.escape(text) for c in chat.CONTROL)


def _closest(item, words):
    """The least edit distance of item to any stretch of words, by the plain table of distances."""
    row = [0] * (len(words) + 1)
    for i, x in enumerate(item, 1):
        before, row[0] = row[0], i
        for j, y in enumerate(words, 1):
            before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
    return min(row)


@given(st.lists(st.integers(0, 3), min_size=1, max_size=9), st.lists(st.integers(0, 3), max_size=16))
@settings(max_examples=200, deadline=None)
def test_the_closest_stretch(item, words):
    d, first, end = decontaminate.closest(item, words)
    assert d == _closest(item, words)
    if d < len(item):  # the stretch itself is at that distance
        assert _closest([-1, *item, -2], [-1, *words[first:end], -2]) == d


def test_decontamination_against_brute_force(spark):
    rng = random.Random(5)
    make = lambda n: [f"t{rng.randrange(3000)}" for _ in range(n)]
    items = [make(n) for n in (1, 3, 6, 15, 24, 40)]
    docs = [make(200) for _ in range(60)]
    for k in range(0, 60, 2):
        leak = list(items[k // 2 % 6])
        for _ in range(rng.randrange(2 + len(leak) // 5)):
            at, what = rng.randrange(len(leak)), rng.randrange(3)
            leak[at : at + (what > 0)] = ["edited"] * (what < 2)
        at = rng.choice([0, 50, 200])
        docs[k][at:at] = leak
    docs.append(make(30_000) + items[5])
    df = _docs(spark, [*map(" ".join, docs), "", None])
    bench = spark.createDataFrame([(i, " ".join(w), "x") for i, w in enumerate(items)] + [(10, None, "x"), (11, "", "x"), (0, " ".join(items[4]), "again")], "item_id long, text string, doc_id string")
    want = {}
    for i, words in enumerate(docs):
        for k, item in [*enumerate(items), (0, items[4])]:
            d = _closest(item, words)
            if d <= int(0.2 * len(item)):
                want.setdefault(i, []).append((k, d))
    for options in ({}, {"block": 2, "together": 2}):
        got = {}
        for r in decontaminate.matches(df, bench, **options).collect():
            got.setdefault(r.doc_id, []).append((r.item_id, r.edits))
        assert {i: sorted(x) for i, x in got.items()} == {i: sorted(x) for i, x in want.items()}
    kept = decontaminate.decontaminate(df, bench, block=2, together=2)
    assert kept.columns == df.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(r.doc_id) for r in df.collect() if r.doc_id not in want)
    leaks = spark.createDataFrame([(7, docs[8]), (7, docs[8]), (None, docs[8]), (None, docs[9])], "doc_id long, words array<string>").selectExpr("doc_id", "array_join(words, ' ') as text")
    found = decontaminate.contaminated(leaks, bench).collect()
    assert sorted(str(r.doc_id) for r in found) == ["7", "7", "None"] and all(r.n_items == len(r["items"]) == len(set(r["items"])) for r in found)
    assert decontaminate.matches(df, bench.limit(0)).count() == 0 and decontaminate.matches(df.limit(0), bench).count() == 0


@pytest.mark.parametrize("n", [5, 8, 12, 20, 30, 59])
def test_decontamination_recall_at_the_limit(n):
    rng = np.random.default_rng(n)
    items = [(i, rng.integers(1, 2**63, n).astype(np.uint64)) for i in range(60)]
    index = decontaminate.Index(items)
    some = lambda: rng.integers(1, 2**63, rng.integers(0, 60)).astype(np.uint64)
    for kind in decontaminate.KINDS:
        texts = [np.concatenate([some(), index.edited(words, kind, rng), some()]) for _, words in items * 3]
        found = sum(any(hit[0] == i for hit in hits) for hits, (i, _) in zip(index.find(texts), items * 3, strict=True))
        assert found >= 0.985 * len(texts), (kind, found, len(texts))


def test_toxicity_held_out(spark):
    rng = random.Random(7)
    words = [f"plain{i}" for i in range(400)]
    texts, toxic = [], []
    for i in range(600):
        bad = rng.random() < 0.2
        text = [rng.choice(words) for _ in range(60)]
        if bad:
            text[rng.randrange(60)] = rng.choice(["vileone", "viletwo"])
            text[rng.randrange(60)] = rng.choice(["vileone", "viletwo"])
        texts.append(" ".join(text)), toxic.append(int(bad))
    df = _docs(spark, [*texts, "", None])
    labels = spark.createDataFrame([(i, t) for i, t in enumerate(toxic) if i % 2], "doc_id long, toxic int")
    rows = toxicity.score(df, labels).collect()
    assert len(rows) == df.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    held = [r for r in rows if r.held_out and r.doc_id is not None and r.doc_id < 600]
    assert all(zlib.crc32(str(r.doc_id).encode()) % 5 == 0 for r in held)
    assert sum(r.predicted == toxic[r.doc_id] for r in held) / len(held) > 0.95
    assert {r.score for r in toxicity.score(df, labels.limit(0)).collect()} == {0.0}
    # The same scores by the model over the set of all features of each text.
    model = toxicity.train(df.select("doc_id", "text"), labels)
    of = {r.doc_id: r.text for r in df.collect()}
    for r in rows:
        features = set().union(*map(toxicity.features_of, re.findall(r"\w+", (of[r.doc_id] or "").lower())))
        z = model.bias + sum(model.weights[f] for f in features)
        assert abs(r.score - 1 / (1 + np.exp(-z))) < 1e-9
    assert toxicity.score(df.limit(0), labels).count() == 0
    odd = spark.createDataFrame([(None, "vileone viletwo " * 20_000), (None, None)], "doc_id long, text string")
    assert len([r for r in toxicity.score(df.select("doc_id", "text").union(odd), labels).collect() if r.doc_id is None]) == 3


def test_language_held_out(spark):
    rng = random.Random(8)
    sounds = {"aa": ["ba", "bo", "ka"], "ab": ["ba", "bo", "ki"], "ca": ["zu", "xe", "wy"], "cb": ["zu", "xe", "wo"]}
    rows = [(i, " ".join("".join(rng.choice(sounds[lang]) for _ in range(3)) for _ in range(25)), lang) for i in range(400) for lang in [list(sounds)[i % 4]]]
    rows += [(1000, None, "aa"), (1001, "123 !! ½ ²Ⅷ", "ab"), (1002, "babobo kakabo", None), (1003, "zuxewy " * 30_000, None)]
    df = spark.createDataFrame([(*r, 0.5) for r in rows], "doc_id long, text string, lang string, score double")
    assert len(language.identify(df.union(df.limit(3)).union(spark.createDataFrame([(None, "babo", "aa", 0.1)], df.schema))).collect()) == len(rows) + 4
    assert language.identify(df.limit(0)).count() == 0
    # Margins from the whole vector of grams, without pieces, give the same.
    model = language.train(df.select("doc_id", "text", "lang"))
    got = {r.doc_id: r for r in language.identify(df).collect()}
    held = [i for i, _, lang in rows if i < 400 and got[i].held_out]
    assert held and sum(got[i].lang_pred == rows[i][2] for i in held) / len(held) > 0.95
    assert got[1000].lang_pred == got[1001].lang_pred == "und" and got[1002].lang_pred in sounds
    for i, text, _ in rows:
        x = language.vector(text)
        want = ("und", 0.0) if x is None else model.predict(model.weights @ x + model.biases)
        assert got[i].lang_pred == want[0] and abs(got[i].score - want[1]) < 1e-4
    assert {r.lang_pred for r in language.identify(df.filter("lang is null")).collect()} == {"und"}
    assert language.letters("a½b ²c Ⅷ") == ["a", "b", "c"]


def test_licences(spark):
    texts = [f"Some prose.\n{t}\nMore prose." for f in licences.FAMILIES for t in licences.TEMPLATES[f]]
    want = [f for f in licences.FAMILIES for _ in licences.TEMPLATES[f]]
    n = len(texts)
    df = _docs(spark, [*texts, *licences.PROSE, "", None])
    got = {r.doc_id: r.licence for r in licences.scan(df).collect()}
    assert [got[i] for i in range(n)] == want
    assert all(got[i] is None for i in range(n, n + len(licences.PROSE) + 2))
    assert licences.scan(df.limit(0)).count() == 0


#: Notices in their standard wording and wrapping.
WRAPPED = {
    "mit": '''MIT License

Copyright (c) 2021 Jane Doe

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.''',
    "bsd": ''' * Copyright (c) 2021, Jane Doe
 *
 * Redistribution and use in source and binary forms, with or without
 * modification, are permitted provided that the following conditions are met:
 *
 * 1. Redistributions of source code must retain the above copyright notice, this
 *    list of conditions and the following disclaimer.''',
    "gpl": '''# This program is free software: you can redistribute it and/or modify
# it under the terms of the GNU General Public License as published by
# the Free Software Foundation, either version 3 of the License, or
# (at your option) any later version.
#
# This program is distributed in the hope that it will be useful,
# but WITHOUT ANY WARRANTY; without even the implied warranty of
# MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.''',
    "mpl": '''// This Source Code Form is subject to the terms of the Mozilla Public
// License, v. 2.0. If a copy of the MPL was not distributed with this
// file, You can obtain one at http://mozilla.org/MPL/2.0/.''',
    "apache": '''Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0''',
}


def test_licences_wrapped(spark):
    prose = " ".join(licences.PROSE)
    texts, want = [], []
    for family, notice in WRAPPED.items():
        one_line = " ".join(notice.split())
        narrow = "\n".join(textwrap.wrap(one_line, 24))
        forms = [notice, notice.replace("\n", "\r\n"), f"{prose}\n\n{notice}\n\n{prose}", f"{prose}\n{notice}\n{prose}", one_line, narrow, f"{prose} {one_line} {prose}"]
        texts += forms
        want += [family] * len(forms)
    got = {r.doc_id: r for r in licences.scan(_docs(spark, [*texts, prose, "\n".join(textwrap.wrap(prose, 60))])).collect()}
    assert [(i // 7, i % 7, got[i].licence) for i in range(len(texts))] == [(i // 7, i % 7, w) for i, w in enumerate(want)]
    assert got[len(texts)].licence is None and got[len(texts) + 1].licence is None
    assert got[0].n_paragraphs == 1
    two = "\n".join([licences.TEMPLATES["mit"][0], licences.TEMPLATES["mit"][0], licences.TEMPLATES["reserved"][0]])
    rows = licences.scan(_docs(spark, [two])).collect()
    assert (rows[0].licence, rows[0].n_paragraphs) == ("mit,reserved", 3)


def _scan_plainly(text, confirm=0.7):
    """Families and the highest probability, by looking at every run of pieces."""
    weights, biases, level = licences.model()
    lines = [licences.words_of(x) for x in re.split("\r\n|\n|\r", (text or "").lower())]
    pieces = [(k, ws[i : i + licences.PIECE]) for k, ws in enumerate(lines) for i in range(0, max(len(ws), 1), licences.PIECE)]
    runs = [ws for ws in lines if len(ws) > licences.LONGEST]
    for a in range(len(pieces)):
        words = []
        for b in range(a, len(pieces)):
            if not pieces[b][1] or len(words) >= licences.LONGEST:
                break
            words = words + pieces[b][1]
            runs.append(words)
    found, top = set(), None
    for words in runs:
        z = np.array(biases)
        for g in set(licences.grams_of(words)):
            z = z + np.array(weights.get(g, np.zeros(len(z))))
        p = np.exp(z - z.max()) / np.exp(z - z.max()).sum()
        k = int(p.argmax())
        if k < len(licences.FAMILIES) and p[k] >= level:
            share = max(len(set(words) & set(licences.words_of(t))) / len(set(licences.words_of(t))) for t in licences.TEMPLATES[licences.FAMILIES[k]])
            if share >= confirm:
                found.add(licences.FAMILIES[k])
                top = max(top or 0, p[k])
    return ",".join(sorted(found)) or None, top


def test_licences_against_looking_at_all_runs(spark):
    rng = random.Random(12)
    templates = [t for f in licences.FAMILIES for t in licences.TEMPLATES[f]]
    texts = []
    for _ in range(60):
        parts = [rng.choice(templates + licences.PROSE * 2).split() for _ in range(rng.randrange(1, 5))]
        for words in parts:
            for _ in range(rng.randrange(3)):
                del words[rng.randrange(len(words))]
        texts.append(rng.choice(["\n", " ", "\n\n"]).join(textwrap.fill(" ".join(p), rng.choice([25, 60, 500])) for p in parts if p))
    texts += ["", None, "word " * 30_000 + templates[0]]
    df = _docs(spark, texts)
    rows = licences.scan(df).collect()
    assert len(rows) == df.count()
    for r in rows:
        text = "null id" if r.doc_id is None else texts[r.doc_id]
        licence, p = _scan_plainly(text)
        assert r.licence == licence, text
        assert (r.probability is None) == (p is None) and (p is None or abs(r.probability - p) < 1e-4)


def test_marks_lose_no_share_that_confirms():
    """Without the marks too few of a template's words are left to confirm."""
    marks = set(licences.marks(0.7))
    for t in (t for f in licences.FAMILIES for t in licences.TEMPLATES[f]):
        words = set(licences.words_of(t))
        assert len(words - marks) / len(words) < 0.7


def _rule_plainly(url, rules):
    rest = url.partition("://")[2] if "://" in (url or "") else ""
    host = re.match("[^/?#]*", rest)[0]
    path = re.match("[^?#]*", rest[len(host) :])[0]
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fits = [r for r in rules if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    return host, path, max(fits, key=lambda r: (len(r.text), r.text), default=None)


def test_url_rules(spark):
    rng = random.Random(13)
    names = ["com", "example.com", "A.Example.COM", "b.com", "notexample.comx", "x.org", ""]
    rules = [urlfilter.rule("block", "com/en/"), urlfilter.rule("allow", "example.com/en/7"), urlfilter.rule("block", "org/"), urlfilter.rule("allow", "x.org")]
    urls = [f"{rng.choice(['http', 'https'])}{rng.choice(['://', ':/', '://'])}{rng.choice(names)}{rng.choice(['/en/7x', '/en/', '', '/de?q=/en/', '#a/en/7'])}" for _ in range(200)]
    urls += [None, "", "http://h?x://y/", "http://com/en/" + "9" * 100_000]
    df = spark.createDataFrame([*((i, u, "clash") for i, u in enumerate(urls)), (None, urls[0], "x"), (0, urls[0], "clash")], "page_id long, url string, host string")
    for more in ([], [urlfilter.rule("block", f"r{i}.net/p{i}") for i in range(100)]):  # by one expression, by a join
        rows = urlfilter.judge(df, rules + more).collect()
        assert len(rows) == len(urls) + 2
        for r in rows:
            host, path, rule = _rule_plainly(urls[r.page_id or 0], rules + more)
            assert (r.host, r.path, r.rule) == (host, path, rule and rule.text)
            assert rule is None or r.verdict == rule.verdict
    assert urlfilter.judge(df.limit(0), rules).count() == 0
    assert {(r.verdict, r.score) for r in urlfilter.judge(df, []).collect()} == {("allow", 0.0)}


def test_url_trees_held_out_and_by_hand(spark):
    """Learnt from four fifths of the urls that a rule decides, held against the rules' verdicts on the rest."""
    from sluice.llm.queries import URL_RULES

    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").select("page_id", "url")
    decided = [(r.page_id, r.url, int(r.verdict == "block")) for r in urlfilter.judge(pages, URL_RULES).filter("rule is not null").join(pages, "page_id").collect()]
    learn = [x for x in decided if zlib.crc32(x[1].encode()) % 5]
    held = {i: y for i, u, y in decided if zlib.crc32(u.encode()) % 5 == 0}
    labelled = spark.createDataFrame([x[1:] for x in learn], "url string, label int")
    got = urlfilter.judge(pages, [], labelled).collect()
    assert len(held) > 10
    assert sum((r.verdict == "block") == held[r.page_id] for r in got if r.page_id in held) / len(held) > 0.9
    trees, rates = urlfilter.train(labelled)
    cut = pages.withColumn("host", urlfilter.host_of()).withColumn("path", urlfilter.path_of())
    x = cut.select("page_id", *[e.alias(k) for k, e in urlfilter.features(rates).items()]).toPandas().set_index("page_id")
    by_hand = dict(zip(x.index, 1 / (1 + np.exp(-sum(t.apply(x.to_numpy()) for t in trees))), strict=True))
    assert all(abs(r.score - by_hand[r.page_id]) < 1e-4 for r in got)


def test_word_hashes_ignore_case_and_marks():
    assert word_hashes("A b,C").tolist() == word_hashes("a B c!").tolist() and len(word_hashes(None)) == 0
