"""A bounded sample of labels keeps the corpus's rate."""

import random

from datarill.llm import toxicity


def test_scores_keep_the_rate_of_all_labels(spark):
    r = random.Random(4)
    words, rows = [f"w{i}" for i in range(60)], []
    for i in range(1200):
        toxic = i % 10 == 0
        # One clean text in ten quotes the word, so it stands for one half.
        rows.append((i, " ".join(r.sample(words, 12) + (["vile"] if toxic or i % 10 == 1 else [])), int(toxic)))
    df = spark.createDataFrame(rows, "doc_id long, text string, label int")
    model = toxicity.fit(df, df.select("doc_id", "label"), examples=100)
    assert abs(model.base - 0.1) < 1e-9 and len(model.ids) == 200  # every example drawn is in the index
    scores = [x["score"] for x in toxicity.score_texts(df, model).collect()]
    assert abs(sum(scores) / len(scores) - 0.1) < 0.05
