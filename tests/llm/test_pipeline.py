import numpy as np

import __spark_entry__ as entry
import corpus_pipeline
from tarn.llm import bag_min_hash, bm25_wand, line_windows, quality_crf, queries

DATA = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns, seen = docs.columns, [docs.toPandas()]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, DATA).write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        seen.append(docs.toPandas())
        if k < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == columns
    raw, good, lines, near, clean, packed = seen
    labels = spark.read.parquet(f"{DATA}/labels.parquet").toPandas().set_index("doc_id")["quality"]
    assert set(good["doc_id"]) < set(raw["doc_id"])
    known = [d for d in raw["doc_id"] if d in labels.index]
    assert np.mean([(d in set(good["doc_id"])) == (labels[d] == 1) for d in known]) > 0.95
    assert set(lines["doc_id"]) == set(good["doc_id"]) and (lines["n_chars"] <= good["n_chars"].max()).all()
    assert set(near["doc_id"]) <= set(lines["doc_id"]) and not near["text"].duplicated().any()
    items = spark.read.parquet(f"{DATA}/benchmark.parquet").toPandas()["text"]
    holds = lambda t: any(i in t for i in items)
    assert set(near["doc_id"]) - set(clean["doc_id"]) >= {r.doc_id for r in near.itertuples() if holds(r.text)}
    assert not any(map(holds, clean["text"]))
    assert set(packed["doc_id"]) == set(clean["doc_id"])
    run = corpus_pipeline.run(spark, DATA).toPandas()
    key = ["doc_id", "piece", "start", "length", "ids_crc32"]
    assert sorted(map(tuple, run[key].to_numpy())) == sorted(map(tuple, packed[key].to_numpy()))


def test_stages_take_odd_rows(spark):
    rows = [(None, "no id\nat\nall", "en", None, None), (1, None, None, "s", 0), (2, "", "en", "s", 0), (3, "a\nb\nc", "en", "s", 5), (3, "a\nb\nc", "en", "s", 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for frame in (docs, docs.limit(0)):
        for name, stage in corpus_pipeline.STAGES:
            found = stage(spark, frame, DATA)
            assert name == "packing" or found.columns == docs.columns
            assert found.count() <= max(frame.count(), 0) + (name == "packing")


def test_one_query_for_each_operator():
    names = [n for n in entry.queries() if n.startswith("op")]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 11))
    assert "pipeline" in entry.queries() and queries.queries().keys() <= entry.queries().keys()
    assert queries.oracle_sql().keys() <= queries.queries().keys() and 4 <= len(corpus_pipeline.STAGES) <= 5
    assert all(m.__doc__ for m in (bag_min_hash, bm25_wand, line_windows, quality_crf))


def test_queries_give_the_columns_of_their_contracts(spark):
    want = {
        "op2_quality_crf": ["doc_id", "held_out", "score", "predicted", "n_lines", "n_bad_lines"],
        "op5_decision_list": ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rule"],
        "op6_two_fit_packing": ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"],
        "op8_chat_format": ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"],
    }
    for name, columns in want.items():
        assert queries.queries()[name](spark, DATA).columns == columns


def test_pipeline_removes_passages_inside_lines(spark):
    """A passage of 60 words inside lines of different documents stays in one of them."""
    passage = " ".join(f"p{k}" for k in range(60))
    texts = [" ".join(f"w{d}x{k}" for k in range(150)) + f" {passage} end{d}" for d in range(3)]
    docs = spark.createDataFrame([(d, t, "en", "s", len(t)) for d, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    for name, stage in corpus_pipeline.STAGES[1:4]:
        docs = stage(spark, docs, DATA)
    found = {r.doc_id: r.text for r in docs.collect()}
    assert found == {0: texts[0], 1: texts[1].replace(passage + " ", ""), 2: texts[2].replace(passage + " ", "")}
