import random

import numpy as np

from beamlog.llm.language import fit_languages, language_predictions, language_sample
from pyspark.sql import functions as F


def test_every_language_is_learned(spark):
    rng = random.Random(9)
    syllable = lambda: rng.choice("bdfgklmnprstvz") + rng.choice("aeiou") + rng.choice("bdfgklmnprstvz")
    names = [f"x{i}" for i in range(104)] + ["de", "en", "fr"]
    parts = {g: [syllable() for _ in range(6)] for g in names}
    doc = lambda g: " ".join("".join(rng.choice(parts[g]) for _ in range(rng.randint(1, 3))) for _ in range(40))
    rows = [(i, doc(g), g) for i, g in enumerate([g for k, g in enumerate(names) for _ in range(12 if k else 60)])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4)
    texts, langs = language_sample(docs, F.lit(True), rows=10)
    assert {g: langs.count(g) for g in names} == {g: 10 for g in names}
    model = fit_languages(texts, langs)
    assert model.weights.shape[1] < 5 * len(names)  # not one machine for each pair
    test = spark.createDataFrame([(i, doc(g)) for i, g in enumerate(names)], "doc_id long, text string")
    got = {r.doc_id: r.lang_pred for r in language_predictions(test, ["doc_id"], model).collect()}
    assert set(got.values()) <= set(names) and len(set(got.values())) > 100 and np.mean([got[i] == g for i, g in enumerate(names)]) > 0.9
