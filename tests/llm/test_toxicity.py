"""The training sample of the toxicity model, and how its settings are chosen."""

from __future__ import annotations

import zlib

from barlake.llm import toxicity

CURSE = "grumblewort"


def labelled(spark, rows: int, long: int = 1):
    """Every second text holds a curse at its end; ``long`` repeats the filler."""
    texts = [(i, " ".join(f"plain{(i * 7 + j) % 50}" for j in range(40)) * long + (f" {CURSE}" * (3 if i % 2 else 0))) for i in range(rows)]
    docs = spark.createDataFrame(texts, "doc_id bigint, text string")
    return docs, spark.createDataFrame([(i, i % 2) for i in range(rows)], "doc_id bigint, toxic int")


def test_windows_come_from_the_whole_text():
    text = " ".join(f"w{i}" for i in range(30_000))
    drawn = toxicity.sampled(text, 1000)
    places = [int(w[1:]) for w in drawn.windows]
    assert drawn.total == 30_000 and len(places) == 1000 and places == sorted(places)
    thirds = [sum(a <= p < a + 10_000 for p in places) for a in (0, 10_000, 20_000)]
    assert min(thirds) > 250
    assert toxicity.sampled(text, 1000) == drawn
    assert toxicity.sampled("One two", 1000) == toxicity.Sampled((b"one", b"two"), 2)
    assert toxicity.sampled(None) == toxicity.sampled("") == toxicity.Sampled((), 0)


def test_sample_leaves_the_held_out_fold_alone(spark):
    docs, labels = labelled(spark, 60)
    toxic, ordinary, prior = toxicity.training_sample(docs, labels)
    learned = [i for i in range(60) if zlib.crc32(str(i).encode()) % 4 != 2]
    assert len(toxic) == sum(i % 2 for i in learned) and len(toxic) + len(ordinary) == len(learned)
    assert prior == len(toxic) / len(learned)


def test_texts_of_any_length_are_learned_from(spark):
    docs, labels = labelled(spark, 60, long=300)
    assert docs.selectExpr("min(octet_length(text))").first()[0] > 1 << 16
    assert all(t.total > len(t.windows) == toxicity.SAMPLE_WINDOWS for t in toxicity.training_sample(docs, labels)[0])


def test_settings_are_ranked_inside_the_training_sample(spark):
    docs, labels = labelled(spark, 200)
    sample = toxicity.training_sample(docs, labels)
    # No string is in a thousand texts, so the second one learns nothing.
    grid = (toxicity.Settings(), toxicity.Settings(min_texts=1000))
    ranked = toxicity.cross_validated(spark, *sample, grid)
    assert [s for _, s in ranked] == list(grid) and ranked[0][0] < ranked[1][0]
    few = toxicity.cross_validated(spark, sample[0][:1], sample[1][:1], 0.5, grid)
    assert len(few) == 2 and all(loss >= 0 for loss, _ in few)
