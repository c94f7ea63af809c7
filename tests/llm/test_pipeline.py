import corpus_pipeline as C
from seriata.llm import common


def test_stages(spark, docs_of, tmp_path):
    item = "twelve distinct words make this benchmark item long enough for shingles to count"
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    near = " ".join(f"w{i}" for i in range(100))
    rows = [(0, "clean text of its own\nand a line that is shared"), (1, f"before {item} after"), (2, near), (3, near + " end"), (4, None), (5, "and a line that is shared\nsomething else"), (6, ""), (7, near)]
    docs = docs_of(rows)
    stages = dict(C.STAGES)
    lines = stages["line dedup"](spark, docs, str(tmp_path))
    assert lines.columns == docs.columns
    got = {r.doc_id: (r.text, r.n_chars) for r in lines.collect()}
    assert got[5] == ("something else", 14) and got[7] == ("", 0) and got[0][0] == rows[0][1] and got[4][0] is None and got[3][0] == rows[3][1]
    apart = stages["n-gram Jaccard join"](spark, docs, str(tmp_path))
    assert sorted(r.doc_id for r in apart.collect()) == [0, 1, 2, 4, 5, 6] and apart.columns == docs.columns
    clean = stages["benchmark decontamination"](spark, docs, str(tmp_path))
    assert sorted(r.doc_id for r in clean.collect()) == [0, 2, 3, 4, 5, 6, 7] and clean.columns == docs.columns
    packed = stages["best-fit packing"](spark, docs, str(tmp_path)).collect()
    assert {r.doc_id for r in packed} == set(range(8))


def test_run(spark, docs_of, tmp_path):
    from .test_toxicity import sample

    rows = [(i, t) for i, (t, _) in enumerate(sample(200, 9))]
    docs_of(rows).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, y) for i, (_, y) in enumerate(sample(200, 9))], "doc_id long, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    left = {r.doc_id for r in C.run(spark, str(tmp_path)).collect()}
    toxic = {i for i, (_, y) in enumerate(sample(200, 9)) if y}
    wrong = len(left & toxic) + len({i for i, _ in rows} - left - toxic)
    assert wrong <= 10


def test_stages_give_native_memory_of_the_driver_back(spark, docs_of, monkeypatch):
    """What compiling plans leaves behind in the driver's JVM goes back at the start of each stage and with each written table."""
    done = []
    trim = common.trim_driver
    for module in (common, C):
        monkeypatch.setattr(module, "trim_driver", lambda s: done.append(trim(s)))
    docs = common.written(docs_of([(1, "one text"), (2, "another text")]))
    common.durable(docs)
    assert len(done) == 2
    C.dedup_lines(spark, docs, "")
    assert len(done) > 2 and all(done)
