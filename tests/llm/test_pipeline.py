"""The pipeline's stages, each on its own input, and what they must keep and catch."""

from pyspark.sql import functions as F
from test_simhash import plain_kept

import corpus_pipeline
from ledgerspark.llm import decontamination, lines, quality

DIR = "/root/testdata/sf0.001"


def test_stages(spark):
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality_classifier", "line_dedup", "simhash_near_dedup", "benchmark_decontamination", "packing"]
    docs = spark.read.parquet(f"{DIR}/documents.parquet").cache()
    columns = docs.columns
    outs = {n: f(spark, docs, DIR) for n, f in corpus_pipeline.STAGES}
    assert all(outs[n].columns == columns for n in names[:-1])
    labels, items = (spark.read.parquet(f"{DIR}/{t}.parquet") for t in ("labels", "benchmark"))
    ids = lambda df: sorted(r.doc_id for r in df.select("doc_id").collect())
    assert ids(outs[names[0]]) == ids(quality.quality(docs, labels).filter("predicted = 1"))
    assert sorted(map(tuple, outs[names[1]].select("doc_id", "text").collect())) == sorted(map(tuple, lines.marked(docs).select("doc_id", "text").collect()))
    assert all(r.n_chars == len(r.text) for r in outs[names[1]].collect())
    assert ids(outs[names[2]]) == plain_kept([(r.doc_id, r.text) for r in docs.collect()])
    assert ids(outs[names[3]]) == ids(decontamination.contamination(docs, items).filter("NOT contaminated"))
    docs.unpersist()


def test_stages_take_odd_rows(spark):
    """Nulls, empty texts, repeated rows and ids, extra columns; and a table without rows."""
    prose = "An ordinary sentence of plain words that a reader would call fine. " * 4
    rows = [(1, prose, "en", "a", 5), (1, prose, "en", "a", 5), (2, prose + "And more.", None, None, None), (3, None, "en", "a", 0), (4, "", "en", "a", 0), (None, "A text without an id, but with some words in it.", "en", "a", 1), (5, "word " * 20_000, "en", "a", 100_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumn("digest", F.lit(1)).withColumn("score", F.lit(2.0))
    for name, stage in corpus_pipeline.STAGES:
        for some in (docs, docs.limit(0)):
            got = stage(spark, some, DIR)
            if name != "packing":
                assert got.columns == docs.columns
                assert {r.doc_id for r in got.select("doc_id").collect()} <= {r[0] for r in rows}
            else:
                assert {r.doc_id for r in got.select("doc_id").collect()} == {r.doc_id for r in some.select("doc_id").collect()}
    kept = [r.doc_id for r in corpus_pipeline.simhash_near_dedup(spark, docs, DIR).select("doc_id").collect()]
    assert kept.count(1) == 1 and kept.count(3) + kept.count(4) == 1


def test_run_chains_the_stages(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, DIR)
    piece = lambda df: sorted((r.doc_id, r.doc_tokens) for r in df.select("doc_id", "doc_tokens").distinct().collect())
    assert piece(corpus_pipeline.run(spark, DIR)) == piece(docs)


def test_entry_without_the_subpackage(tmp_path):
    """The entry module imports and its other queries stay when the llm folders and the pipeline are gone."""
    import shutil
    import subprocess
    import sys
    from pathlib import Path

    repo = Path(corpus_pipeline.__file__).parent
    shutil.copytree(repo / "ledgerspark", tmp_path / "ledgerspark", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(repo / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'role_totals' in q and not any(n.startswith('op') for n in q); e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path)})
