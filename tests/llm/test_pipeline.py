import corpus_pipeline as cp
from tracewright.llm import near_dedup, secret_scan

SF = "/root/testdata/sf0.001"


def test_stages_on_the_small_tables(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    before = {r.doc_id: r for r in docs.collect()}
    quality = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    for i, (name, stage) in enumerate(cp.STAGES):
        path = f"{tmp_path}/{i}"
        out = stage(spark, docs, SF)
        out.write.parquet(path)
        was, docs = docs, spark.read.parquet(path)
        if name != "packing":
            assert docs.columns == was.columns and docs.dtypes == was.dtypes
            now = {r.doc_id: r for r in docs.collect()}
            assert all(r.n_chars == len(r.text) for r in now.values())
        if name == "quality":
            good = [d for d in before if quality.get(d) == 1]
            assert sum(d in now for d in good) >= 0.95 * len(good) and len(now) < len(before)
        if name == "near_duplicates":
            assert {r.doc_id for r in near_dedup.near_duplicates(was, 5, 80).where("kept").collect()} == set(now)
        if name == "secrets":
            assert secret_scan.scan(docs).where("size(base) > 0").count() == 0
            held = {r.doc_id for r in secret_scan.scan(was).where("size(found) > 0").collect()}
            assert held == {d for d, r in now.items() if "[SECRET]" in r.text}
    packed = docs.collect()
    assert {r.doc_id for r in packed} == set(now) and max(r.offset + r.length for r in packed) <= 4096


def test_one_of_each_keeps_odd_rows(spark):
    text = "one two three four five six seven"
    rows = [(1, text, "a"), (2, text, "b"), (1, text, "c"), (None, text, "d"), (3, None, "e"), (4, "", "f"), (5, text + " eight", "g"), (6, text.replace("one", "x"), "h"), (6, "other words", "i")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, h string")
    got = sorted((r.doc_id is None, r.doc_id or 0, r.text or "") for r in near_dedup.one_of_each(docs, 5, 60).collect())
    assert got == [(False, 1, text), (False, 3, ""), (False, 4, ""), (False, 6, "other words"), (False, 6, text.replace("one", "x")), (True, 0, text)]
    assert near_dedup.one_of_each(docs.where("false")).count() == 0


def test_queries_are_registered():
    import __spark_entry__ as e

    names = set(e.queries())
    assert "pipeline" in names and {n.split("_")[0] for n in names if n.startswith("op")} == {f"op{i}" for i in range(1, 11)}
