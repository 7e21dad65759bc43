import corpus_pipeline
from tests.llm.helpers import AWKWARD, LABELS, docs, words
from tidemark.llm.queries import ORACLES, QUERIES


def test_stages_take_effect_and_keep_columns(spark, tmp_path):
    texts = [words(60, i) + (" you idiot moron scum" if i % 5 == 0 else "") for i in range(150)]
    texts += [texts[1], texts[2].replace(" ", "  "), " ".join(texts[3].split()[:-1] + ["other"]), 'token = "' + "ab12" * 10 + '" ' + words(20, 999)]
    df = docs(spark, [*texts, *AWKWARD[9:]])
    df.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, 1, int(i % 5 == 0)) for i in range(120)], LABELS).write.parquet(str(tmp_path / "labels.parquet"))
    now, seen = spark.read.parquet(str(tmp_path / "documents.parquet")), {}
    for name, stage in corpus_pipeline.STAGES:
        now = stage(spark, now, str(tmp_path))
        seen[name] = {r.doc_id for r in now.select("doc_id").collect()}
        if name != "packing":
            assert now.columns == df.columns
        if name == "secret_scan":
            assert now.where("text LIKE '%[SECRET]%'").count() == 1
    clean = {i for i in range(150) if i % 5}
    assert not seen["toxicity"] & {i for i in range(150) if i % 5 == 0} and clean <= seen["toxicity"]
    assert 150 not in seen["exact_dedup"] and 2 not in seen["exact_dedup"] and 151 in seen["exact_dedup"]
    assert 152 not in seen["near_dedup"] and clean - {2} <= seen["near_dedup"]
    assert seen["near_dedup"] == seen["secret_scan"] == seen["packing"]


def test_pipeline_takes_an_empty_table(spark, tmp_path):
    docs(spark, []).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], LABELS).write.parquet(str(tmp_path / "labels.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_queries_give_a_row_for_each_input_row(spark, sf_dir):
    n = spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    for name in ("op1_personal_data", "op2_near_dedup", "op3_fingerprints", "op5_quality", "op6_exact_dedup", "op7_secret_scan", "op10_toxicity"):
        assert QUERIES[name](spark, sf_dir).count() == n, name
    assert set(ORACLES) <= set(QUERIES)


def test_stages_drop_rows_and_not_keys(spark, tmp_path):
    texts = [words(60, i) + (" you idiot moron scum" if i % 5 == 0 else "") for i in range(120)]
    bad, clean, other = words(60, 700) + " you idiot moron scum", words(60, 701), words(60, 702)
    df = docs(spark, [*texts, (None, bad), (None, clean), (None, texts[1].upper()), (500, bad + " again"), (500, other)])
    spark.createDataFrame([(i, 1, int(i % 5 == 0)) for i in range(120)], LABELS).write.parquet(str(tmp_path / "labels.parquet"))
    kept = [r.text for r in corpus_pipeline.drop_toxic(spark, df, str(tmp_path)).collect()]
    assert bad not in kept and clean in kept and bad + " again" not in kept and other in kept
    kept = [r.text for r in corpus_pipeline.drop_near(spark, df, str(tmp_path)).collect()]
    assert texts[1] in kept and texts[1].upper() not in kept and clean in kept and other in kept


def test_near_stage_drops_texts_that_differ_in_what_most_texts_hold(spark, tmp_path):
    notice, own = words(36, 90), words(90, 91)
    texts = [f"{own} {notice}", own, *(f"{words(60, 700 + i)} {notice}" for i in range(40))]
    kept = {r.doc_id for r in corpus_pipeline.drop_near(spark, docs(spark, texts), str(tmp_path)).collect()}
    assert kept == set(range(42)) - {1}
