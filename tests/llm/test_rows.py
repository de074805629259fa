"""Filters decide by row: null ids and one id with several texts."""

import random

from sluice.llm import decontaminate, neardup, toxicity

SCHEMA = "doc_id long, text string"


def _text(rng, n):
    return " ".join(f"w{rng.randrange(5000)}" for _ in range(n))


def _kept(df):
    return sorted((-1 if r.doc_id is None else r.doc_id, r.text) for r in df.collect())


def test_near_dedup_by_row(spark):
    rng = random.Random(1)
    a, b, c, d, e = (_text(rng, 100) for _ in range(5))
    near = lambda t: t + " changed"
    rows = [(3, b), (5, a), (5, near(b)), (None, c), (None, d), (None, near(d)), (None, near(a)), (8, e), (8, near(e))]
    got = _kept(neardup.deduplicate(spark.createDataFrame(rows, SCHEMA)))
    assert (3, b) in got and (5, a) in got and (-1, c) in got
    assert (5, near(b)) not in got and (-1, near(a)) not in got
    assert len(got) == 5 and sum(i == 8 for i, _ in got) == 1 and sum(t in (d, near(d)) for _, t in got) == 1


def test_decontamination_by_row(spark):
    rng = random.Random(2)
    item, a, b, c = (_text(rng, 30) for _ in range(4))
    rows = [(None, a), (None, f"{b} {item}"), (None, None), (4, c), (4, item)]
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    got = decontaminate.decontaminate(spark.createDataFrame(rows, SCHEMA), bench).collect()
    assert {(r.doc_id, r.text) for r in got} == {(None, a), (None, None), (4, c)}


def test_toxicity_by_row(spark):
    rng = random.Random(3)
    texts = [_text(rng, 40) + (" vileone viletwo" * 2 if i % 4 == 0 else "") for i in range(400)]
    rows = list(enumerate(texts))
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i, _ in rows], "doc_id long, toxic int")
    clean, bad = _text(rng, 40), _text(rng, 40) + " vileone viletwo" * 2
    odd = [(None, clean), (None, bad), (1001, clean), (1001, bad)]
    got = toxicity.reject(spark.createDataFrame(rows + odd, SCHEMA), labels).collect()
    assert {(r.doc_id, r.text) for r in got if r.doc_id is None or r.doc_id > 1000} == {(None, clean), (1001, clean)}
