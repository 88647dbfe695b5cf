"""The language model learns from all training texts, not from a sample of them."""

import numpy as np

from bendscape.llm import attention_lm


def test_every_training_text_trains_the_weights_once(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(attention_lm, "pair_counts", lambda *_: None)
    monkeypatch.setattr(attention_lm.Model, "follow", lambda *_: None)
    monkeypatch.setattr(attention_lm, "averaged", lambda texts, *_: seen.extend(r.id for r in texts.select("id").collect()))
    training = spark.range(500).selectExpr("id", "id * 7 AS h", "cast(id AS string) AS text")
    attention_lm.fitted(training, np.ones(attention_lm.encoding(attention_lm.TOKENIZER)[2]))
    assert sorted(seen) == list(range(500))
