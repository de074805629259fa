import random

import numpy as np
import pytest

from sluice.llm import neardup


def _components(edges):
    up = {}

    def find(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        up[find(a)] = find(b)
    return {x: find(x) for x in up}


@pytest.mark.parametrize("shape", ["path", "star", "random"])
def test_connected_and_merged(spark, shape):
    rng = random.Random(1)
    edges = {"path": [(i, i + 1) for i in range(40)], "star": [(7, i) for i in range(30) if i != 7], "random": [(rng.randrange(60), rng.randrange(60)) for _ in range(45)]}[shape]
    edges = [e for e in edges if e[0] != e[1]]
    frame = lambda e: spark.createDataFrame(e, "a long, b long")
    half = len(edges) // 2
    for labels in (neardup.connected(frame(edges)), neardup.merged(neardup.connected(frame(edges[:half])), frame(edges[half:]))):
        got = {r.node: r.label for r in labels.collect()}
        want = _components(edges)
        assert got.keys() == want.keys()
        assert len(got) == labels.count()
        pairs = {(got[n], want[n]) for n in got}
        assert len(pairs) == len({a for a, _ in pairs}) == len({b for _, b in pairs})


def test_samples_agree_as_often_as_sets_are_similar():
    rng = np.random.default_rng(2)
    hashes = np.sort(rng.integers(0, 2**63, 200, dtype=np.uint64))
    weights = rng.uniform(1, 2, 200)
    a, b = (hashes[:180], weights[:180]), (hashes[20:], weights[20:])
    got = neardup.Sampler(3000).sample([a, b])
    assert abs((got[0] == got[1]).mean() - neardup.similarity(a, b)) < 0.04


def _text(rng, n):
    return " ".join(f"w{rng.randrange(5000)}" for _ in range(n))


def test_classes_against_brute_force(spark):
    rng = random.Random(3)
    docs = []
    for i in range(30):
        words = _text(rng, 120).split()
        docs.append(" ".join(words))
        for _ in range(rng.randrange(3)):
            edited = list(words)
            edited[rng.randrange(120)] = "changed"
            docs.append(" ".join(edited))
    docs += ["", None, "!!", "short text", "Short  text", docs[0], docs[0].upper()]
    rows = [(i, t, "extra") for i, t in enumerate(docs)] + [(None, "alone in the world with no id at all", "x"), (3, docs[3], "extra")]
    df = spark.createDataFrame(rows, "doc_id long, text string, node string")
    got = {}
    out = neardup.classes(df).collect()
    assert len(out) == len(rows)
    for r in out:
        got[r.doc_id] = r.class_id
    idf, _ = neardup.document_frequencies(df.select("text"))
    sets = [neardup.weighted(neardup.words32(t), idf) for t in docs]
    links = [(i, j) for i in range(len(docs)) for j in range(i) if neardup.similarity(sets[i], sets[j]) >= 0.8]
    want = _components(links + [(i, i) for i in range(len(docs))])
    for i in range(len(docs)):
        for j in range(i):
            assert (got[i] == got[j]) == (want[i] == want[j])
    kept = neardup.deduplicate(df)
    assert kept.columns == df.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted({str(got[r.doc_id]) for r in out})


def test_a_large_bucket_of_many_classes(spark, monkeypatch):
    """Near copies of one text, most below the threshold from each other: all bucket mates are compared, in units of few nodes."""
    monkeypatch.setattr(neardup, "SPAN", 10)
    rng = random.Random(5)
    base = _text(rng, 100).split()
    texts = []
    for i in range(150):
        edited = list(base)
        for at in rng.sample(range(100), rng.choice([1, 2, 4, 6, 8])):
            edited[at] = f"e{i}x{at}" if rng.random() < 0.7 else f"common{at}"
        texts.append(" ".join(edited))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.class_id for r in neardup.classes(df, bands=4, rows=1).collect()}
    idf, _ = neardup.document_frequencies(df.select("text"))
    sets = [neardup.weighted(neardup.words32(t), idf) for t in texts]
    links = [(i, j) for i in range(len(texts)) for j in range(i) if neardup.similarity(sets[i], sets[j]) >= 0.8]
    mates = [(i, j) for i, j in links if (neardup.Sampler(4).sample([sets[i]]) == neardup.Sampler(4).sample([sets[j]])).any()]
    want = _components(mates + [(i, i) for i in range(len(texts))])
    assert 3 < len(set(want.values())) < 120
    assert {(got[i], want[i]) for i in got} == {(g, w) for w in set(want.values()) for g in {min(i for i in want if want[i] == w)}}


def test_the_joining_links_join_what_all_join():
    rng = random.Random(6)
    links = [(bytes([rng.randrange(40)]), bytes([rng.randrange(40)])) for _ in range(50)]
    some = neardup._joining(links)
    assert len(some) < len(links)
    ends = {x for e in links for x in e}
    a, b = (_components([*x, *((n, n) for n in ends)]) for x in (links, some))
    assert len({(a[n], b[n]) for n in ends}) == len(set(a.values())) == len(set(b.values()))


def test_empty_table(spark):
    assert neardup.classes(spark.createDataFrame([], "doc_id long, text string")).count() == 0
