"""The corpus pipeline against a plain version of each stage, on odd rows."""

import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from sluice.llm import neardup, queries, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, k string, row long, node string"
SF = "/root/testdata/sf0.001"


def _text(rng, n, bad=False):
    words = [f"w{rng.randrange(4000)}" for _ in range(n)]
    for word in ("vileone", "viletwo") * bad:
        words[rng.randrange(n)] = word
    return " ".join(words)


def _documents():
    rng = random.Random(21)
    texts = [(i, _text(rng, 40, i % 4 == 0)) for i in range(160)]
    item = _text(rng, 24)
    a, b, c, d, e, f = (_text(rng, 120) for _ in range(6))
    texts += [(200, a), (201, a.upper()), (None, a), (202, a + " changed"), (203, a + " changed"), (203, a + " changed")]
    texts += [(210, f"{b} {item}"), (210, e), (None, f"{c} {' '.join(item.split()[:-1])}"), (None, f), (None, None), (211, ""), (212, "  \n"), (213, "!!")]
    texts += [(220, d), (None, d + " again"), (221, "x " * 30_000 + "end"), (222, "<|endoftext|> ok"), (223, _text(rng, 40, True)), (223, _text(rng, 40)), (None, _text(rng, 40, True))]
    rows = [(i, t, "en", "s", len(t or ""), "k", n, "node") for n, (i, t) in enumerate(texts)]
    return rows, [(i, int(i % 4 == 0)) for i in range(160) if i % 3], [(1, item), (2, None), (3, "")]


def _not_toxic(rows, model):
    def score(text):
        features = set().union(*map(toxicity.features_of, re.findall(r"\w+", (text or "").lower())))
        return 1 / (1 + np.exp(-(model.bias + sum(model.weights[f] for f in features))))

    return [r for r in rows if score(r[1]) < 0.5]


def _one_of_equal(rows):
    groups = {}
    for r in rows:
        groups.setdefault(re.sub("[A-Z]", lambda m: m[0].lower(), r[1] or ""), []).append(r)
    return [max(g, key=lambda r: -1 if r[0] is None else r[0]) for g in groups.values()]


def _one_of_near(rows, idf):
    sets = [neardup.weighted(neardup.words32(r[1]), idf) for r in rows]
    label = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if neardup.similarity(sets[i], sets[j]) >= 0.8 and label[i] != label[j]:
                label = [label[j] if x == label[i] else x for x in label]
    oldest = lambda r: (r[0] is None, r[0] or 0, hashlib.md5(f"{'' if r[0] is None else r[0]}:{r[1] or ''}".encode()).digest())
    return [min((r for r, m in zip(rows, label, strict=True) if m == x), key=oldest) for x in sorted(set(label))]


def _without(rows, items):
    def holds(words, item):
        line = [0] * (len(words) + 1)
        for i, x in enumerate(item, 1):
            before, line[0] = line[0], i
            for j, y in enumerate(words, 1):
                before, line[j] = line[j], min(line[j] + 1, line[j - 1] + 1, before + (x != y))
        return min(line) <= int(0.2 * len(item))

    return [r for r in rows if not any(holds((r[1] or "").lower().split(), i.split()) for _, i in items if i)]


def _key(rows):
    return sorted((str(r[0]), r[1] or "") for r in rows)


def test_pipeline_stage_by_stage(spark, tmp_path):
    rows, labels, items = _documents()
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    want = rows
    for name, stage in corpus_pipeline.STAGES[:-1]:
        if name == "toxicity":
            want = _not_toxic(want, toxicity.train(docs.select("doc_id", "text"), spark.read.parquet(f"{tmp_path}/labels.parquet")))
            assert 115 < len(want) < len(rows) - 38
        elif name == "exact_dedup":
            want = _one_of_equal(want)
        elif name == "near_dedup":
            want = _one_of_near(want, neardup.document_frequencies(docs.select("text"))[0])
        else:
            want = _without(want, items)
        before = docs.count()
        stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        assert docs.columns == spark.createDataFrame([], SCHEMA).columns
        got = docs.collect()
        # Of rows that repeat id and text, exact dedup and near-dedup may leave any.
        assert _key(got) == _key(want), name
        assert len(got) < before
    tokens = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ids = {(r[0], r[1]): [*tokens.encode(r[1] or "", add_special_tokens=False).ids, 0] for r in want}
    covered, sequences = {k: [] for k in ids}, {}
    for r in corpus_pipeline.run(spark, str(tmp_path)).collect():
        mine = [k for k, x in ids.items() if k[0] == r.doc_id and len(x) == r.doc_tokens and zlib.crc32(np.array(x[r.start : r.start + r.length], "<u4").tobytes()) == r.ids_crc32]
        assert mine
        covered[min(mine, key=lambda k: sum(n for _, n in covered[k]))].append((r.start, r.length))
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert {k: sum(n for _, n in v) for k, v in covered.items()} == {k: len(x) for k, x in ids.items()}
    for parts in sequences.values():
        ends = [0]
        for offset, length in sorted(parts):
            assert offset == ends[-1]
            ends.append(offset + length)
        assert ends[-1] <= 1024 and ends[-1] & (ends[-1] - 1) == 0


def test_pipeline_of_an_empty_table(spark, tmp_path):
    for name, schema in (("documents", SCHEMA), ("labels", "doc_id long, toxic int"), ("benchmark", "item_id long, text string")):
        spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_registered_queries(spark):
    """The thin queries on whole small tables: the added conversation, one row per document, columns of the contract."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    chat = {r.conv_id: r for r in queries.op3_chat_format(spark, SF).collect()}
    assert chat[-7].n_turns == 2 and chat[-7].loss_chars == len("</s>[INST] ok [/INST]")
    assert len(chat) == spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id").distinct().count() + 1
    for name, columns in {"op2_licence_scan": {"doc_id", "licence"}, "op5_toxicity": {"doc_id", "held_out", "score", "predicted"}, "op7_language_id": {"doc_id", "held_out", "lang_pred", "score"}, "op8_token_files": {"doc_id", "start", "n_tokens", "ids_crc32"}}.items():
        df = queries.QUERIES[name](spark, SF)
        assert columns <= set(df.columns) and df.count() == docs.count()
    urls = queries.op10_url_filter(spark, SF)
    assert {"page_id", "host", "path", "rule", "verdict"} <= set(urls.columns) and {r.verdict for r in urls.collect()} == {"allow", "block"}
