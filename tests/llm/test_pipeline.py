import corpus_pipeline as p
from tests.llm.data import corpus, words

import random


def make(spark, path):
    rng = random.Random(12)
    rows, labels = corpus(), []
    rows = [r for r in {r[0]: r for r in rows if r[0] is not None}.values()]
    item = words(rng, 25)
    for i in range(300, 420):
        w = words(rng, 50).split()
        if i % 3 == 0:
            w[7] = w[20] = w[33] = "grumblefax"
        labels.append((i, 1, int(i % 3 == 0)))
        rows.append((i, " ".join(w), "en", "b", 1))
    rows += [(500, "unlike " + item + " it", "en", "c", 1), (501, rows[40][1], "en", "c", 1)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return rows


def test_stages(spark, tmp_path):
    rows = make(spark, tmp_path)
    docs = before = spark.read.parquet(f"{tmp_path}/documents.parquet")
    ids = []
    for k, (_, stage) in enumerate(p.STAGES):
        docs = p.saved(stage(spark, docs, str(tmp_path)), "test")
        if k < len(p.STAGES) - 1:
            assert docs.columns == before.columns
        ids.append({r["doc_id"] for r in docs.select("doc_id").collect()})
    everything = {r[0] for r in rows}
    gone = everything - ids[0]
    assert len(gone & {i for i in range(300, 420) if i % 3 == 0}) >= 36 and len(gone - {i for i in range(300, 420) if i % 3 == 0}) <= 4
    assert ids[1] == ids[0]
    assert 500 in ids[2] and 500 not in ids[3] and 501 not in ids[2]
    assert ids[3] == ids[4] and all(r["round_trip"] for r in docs.collect())


def test_empty_tables(spark, tmp_path):
    make(spark, tmp_path)
    for some, empty in (("all", ("documents", "labels", "benchmark")), ("documents", ("documents",)), ("labels", ("labels", "benchmark"))):
        for name in ("documents", "labels", "benchmark"):
            df = spark.read.parquet(f"{tmp_path}/{name}.parquet")
            (df.limit(0) if name in empty else df).write.parquet(f"{tmp_path}/{some}/{name}.parquet")
        n = p.run(spark, f"{tmp_path}/{some}").count()
        assert n == 0 if "documents" in empty else n > 100


def test_run_is_the_stages(spark, tmp_path):
    make(spark, tmp_path)
    out = p.run(spark, str(tmp_path))
    assert out.columns == ["doc_id", "lang", "source", "n_pieces", "piece_ids", "round_trip"] and out.count() > 50
    assert p.ORACLE_SQL is None and len(p.STAGES) == 5
