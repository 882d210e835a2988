"""The pipeline's stages, each on what the one before kept."""

from __future__ import annotations

import random

from tests.llm.helpers import DOCS, sentence
from tests.llm.test_operators import DE, EN


def test_stages(spark, tmp_path):
    import corpus_pipeline as P

    rng = random.Random(11)
    good = lambda: "\n".join(sentence(rng, 14, EN + DE).capitalize() + "." for _ in range(6))
    item = sentence(rng, 25, DE + EN)
    secret = 'token = "cb1a9fee807a05366fcb8b6c95c7c565ede51a72"'
    rows = [(i, good(), "en", f"s{i % 3}", 0) for i in range(60)]
    rows += [(100 + i, " | ".join(sentence(rng, 1, EN) + "###" for _ in range(60)), "en", "s0", 0) for i in range(30)]
    rows += [(200, rows[0][1], "en", "s0", 0), (201, rows[1][1] + " more", "en", "s1", 0)]
    rows += [(300, good() + "\n" + item + "\n" + good(), "en", "s0", 0), (301, good() + "\n" + secret, "en", "s1", 0), (302, None, None, None, None)]
    folder = str(tmp_path)
    spark.createDataFrame(rows, DOCS).write.parquet(f"{folder}/documents.parquet")
    labels = [(i, 1, 0) for i in range(60)] + [(100 + i, 0, 0) for i in range(30)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")

    docs = spark.read.parquet(f"{folder}/documents.parquet")
    ids = [sorted(r[0] for r in docs.select("doc_id").collect())]
    for name, stage in P.STAGES:
        stage(spark, docs, folder).write.parquet(f"{folder}/out/{name}")
        docs = spark.read.parquet(f"{folder}/out/{name}")
        if name != P.STAGES[-1][0]:
            assert tuple(docs.columns) == P.COLUMNS
            ids.append(sorted(r[0] for r in docs.select("doc_id").collect()))
        if name == "secret_scan":
            assert docs.filter("text LIKE '%cb1a9fee%'").count() == 0 and docs.filter("text LIKE '%[SECRET]%'").count() == 1
    quality, near, leaks = (set(ids[i]) - set(ids[i + 1]) for i in range(3))
    assert quality >= {100 + i for i in range(30)} and not quality & set(range(60))
    assert near == {200, 201} and leaks == {300} and ids[3] == ids[4]
    assert all(r["copy"] >= 1 for r in docs.collect())
    assert P.run(spark, folder).count() == docs.count()
