"""What the operators hold in memory at once."""

import public_tokenizers

from sluice.llm import common, tokenfile


def test_reading_token_files_gives_back_the_encoder(spark, tmp_path, monkeypatch):
    """A worker process that has written files reads them in the next step; its cache is not needed there."""
    docs = spark.createDataFrame([(2, "one two"), (1, None)], "doc_id long, text string")
    tokenizer = public_tokenizers.path("word_bpe_49k.json")
    tokenfile.write(docs, str(tmp_path / "t"), tokenizer)
    caught, plain = [], type(docs).mapInArrow
    monkeypatch.setattr(type(docs), "mapInArrow", lambda self, f, schema: caught.append(f) or plain(self, f, schema))
    got = tokenfile.read(spark, str(tmp_path / "t")).collect()
    assert [(r.doc_id, r.start) for r in sorted(got)] == [(1, 0), (2, 1)]
    common.encoder(tokenizer)
    assert common._encoders and list(caught[0](iter([]))) == [] and not common._encoders
