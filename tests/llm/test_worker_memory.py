"""What workers and the driver hold on to between steps."""

import os

import public_tokenizers
import pyarrow as pa

from wattloom.llm import langid, maxent, tokens


def test_counting_words_drops_what_packing_remembered(spark, monkeypatch):
    """A worker that packed before holds no vocabulary while it counts the words of languages."""
    runs = []
    monkeypatch.setattr(type(spark.range(0)), "mapInArrow", lambda self, run, schema: runs.append(run) or self.selectExpr("'' AS lang", "'' AS word", "1L AS n"))
    langid.count_words(spark.createDataFrame([("ein Satz", "de")], "text string, lang string"))
    tokens.encoder(public_tokenizers.path("word_bpe_49k.json"), "dropped")
    assert tokens._ENCODERS
    batch = pa.RecordBatch.from_arrays([pa.array(["ein Satz ein"]), pa.array(["de"])], ["text", "lang"])
    out = pa.Table.from_batches(runs[0](iter([batch]))).to_pylist()
    assert {(r["word"], r["n"]) for r in out} == {("ein", 2), ("satz", 1)}
    assert not tokens._ENCODERS


def test_rounds_leave_no_model_in_the_driver(spark, monkeypatch):
    """Each round's broadcast is gone when the next begins, and no round collects the blocks of gradients at once."""
    sent, collected = [], []
    context = type(spark.sparkContext)
    monkeypatch.setattr(context, "broadcast", lambda self, value, f=context.broadcast: sent.append(f(self, value)) or sent[-1])
    kind = type(spark.range(0))
    monkeypatch.setattr(kind, "collect", lambda self, f=kind.collect: collected.append(self.columns) or f(self))
    model, _ = maxent.train(spark.createDataFrame([(f"a{i % 7} b{i % 5} c",) for i in range(200)], "text string"))
    assert len(sent) == maxent.ROUNDS and not any(os.path.exists(b._path) for b in sent)
    assert collected and ["at", "g"] not in collected and model.weights.any()
