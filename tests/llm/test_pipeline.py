"""The pipeline stage by stage against the operators' plain versions."""

import corpus_pipeline
from boxoffice.llm import simhash
from boxoffice.session import materialize
from tests.llm.conftest import untouched
from tests.llm.test_bytes import expected
from tests.llm.test_simhash import brute_groups
from tests.llm.test_texts import plain_contamination

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["language_id", "near_dedup", "decontamination", "source_mix", "token_output"]

    one = stages["language_id"](spark, docs, SF)
    assert one.columns == columns and one.count() == docs.filter(r"text rlike '\\p{L}'").count()

    two = stages["near_dedup"](spark, one, SF)
    rows = sorted((r["doc_id"], r["text"]) for r in one.collect())
    groups = brute_groups([d for d, _ in rows], [simhash.fingerprint(t) for _, t in rows])
    assert two.columns == columns and sorted(r["doc_id"] for r in two.collect()) == sorted(set(groups))

    three = stages["decontamination"](spark, two, SF)
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    clean = [r[0] for r in plain_contamination([(r["doc_id"], r["text"]) for r in two.collect()], items) if not r[5]]
    assert three.columns == columns and sorted(r["doc_id"] for r in three.collect()) == sorted(clean)

    four = stages["source_mix"](spark, three, SF)
    assert four.columns == columns and {r["doc_id"] for r in four.collect()} <= set(clean)

    rows = sorted((r["doc_id"], r["text"]) for r in four.collect())
    assert sorted((tuple(r) for r in stages["token_output"](spark, four, SF).collect()), key=lambda r: r[1]) == expected(rows)


def test_run_agrees_with_its_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
    assert sorted(map(str, corpus_pipeline.run(spark, SF).collect())) == sorted(map(str, docs.collect()))


def test_odd_rows_clashing_columns_and_no_rows(spark, odd, none):
    """Nulls, empties, repeats and very long texts through every stage but the last; other columns keep their values."""
    stages = corpus_pipeline.STAGES
    frame, seen = odd, []
    for name, stage in stages[:-1]:
        frame = materialize(stage(spark, frame, SF), f"odd-{name}")
        assert frame.columns == odd.columns
        untouched(frame)
        seen.append(sorted({r["doc_id"] for r in frame.collect()}, key=str))
    assert seen[0] == [3, 4, 5, None]  # no text, or no letter in it: no language
    assert seen[1] == seen[2] == [3, 4, 5]  # the row without an id copies document 3
    assert set(seen[3]) <= {3, 4, 5}
    rows = sorted((r["doc_id"], r["text"]) for r in frame.collect())
    assert sorted((tuple(r) for r in stages[-1][1](spark, frame, SF).collect()), key=lambda r: r[1]) == expected(rows)
    empty = none
    for _, stage in stages:
        empty = stage(spark, empty, SF)
    assert empty.collect() == []
