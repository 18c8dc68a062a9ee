"""The pipeline's stages against the operators' plain statements."""

import corpus_pipeline
from webloom.llm import common
from .test_neighbours import groups, shingles
from .test_windows import removed_words
from .data import sha, words

SF = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages_take_effect_one_after_the_other(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    benchmark = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    for name, stage in corpus_pipeline.STAGES:
        docs = common.written(stage(spark, docs, SF), name)
        got = [(r.doc_id, r.text) for r in docs.collect()]
        if name == "language":
            assert {i for i, _ in got} == {i for i, _ in rows}
        elif name == "near_duplicates":
            assert {i for i, _ in got} == {i for i, _, _, kept in groups(rows, 5) if kept}
        elif name == "substrings":
            assert sorted((i, sha(b" ".join(words(t)))) for i, t in got) == sorted((i, s) for i, _, _, s in removed_words(rows))
        elif name == "decontaminate":
            held = {i for i, t in rows if any(100 * len(shingles(t, 5) & s) >= 80 * len(s) for s in (shingles(b, 5) for b in benchmark) if s)}
            assert {i for i, _ in got} == {i for i, _ in rows} - held and held
        else:
            assert 0 < len(got) < len(rows) and set(got) <= set(rows)
        if name != "mix":
            assert docs.columns == COLUMNS
        rows = got
    assert corpus_pipeline.run(spark, SF).count() == len(rows)
