from __future__ import annotations

import random

import pytest

import corpus_pipeline as cp
from tests.llm.helpers import edited, text
from tests.llm.test_near_dup_and_benchmark import classes_by_brute_force, found_by_brute_force
from tests.llm.test_quality_and_lines import base, expected_lines


def test_stages_match_brute_force(spark, tmp_path):
    r = random.Random(8)
    shared, item = "a line that several of the documents hold", text(r, 30)
    docs: dict[int, str | None] = {0: None, 1: "", 2: "too short", 3: "again and again " * 40}
    for _ in range(12):
        t = text(r, r.choice([40, 80]))
        docs[len(docs)] = t
        if r.random() < 0.5:
            docs[len(docs)] = edited(r, t, 1)
        if r.random() < 0.4:
            docs[len(docs)] = shared + "\n" + text(r, 50)
    docs[len(docs)] = text(r, 30) + " " + item + " " + text(r, 30)
    spark.createDataFrame([(d, t, "en", "s", len(t or "")) for d, t in docs.items()], "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, item), (2, text(r, 25))], "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))

    frame = spark.read.parquet(str(tmp_path / "documents.parquet"))
    columns, got = frame.columns, []
    for k, (_, stage) in enumerate(cp.STAGES[:-1]):
        stage(spark, frame, str(tmp_path)).write.parquet(str(tmp_path / f"s{k}"))
        frame = spark.read.parquet(str(tmp_path / f"s{k}"))
        assert frame.columns == columns
        got.append({x["doc_id"]: x["text"] for x in frame.collect()})
    assert set(got[0]) == {d for d, t in docs.items() if not base(t or "")[-1]}  # no text here fails the method's verdict only
    assert {d: (x[0], x[1]) for d, x in expected_lines(got[0]).items()} == {d: (len(got[0][d].split("\n")), len(got[0][d].split("\n")) - (len(t.split("\n")) if t or not expected_lines(got[0])[d][1] else 0)) for d, t in got[1].items()}
    classes = classes_by_brute_force(got[1])
    assert set(got[2]) == {d for d in got[1] if classes[d] == d}
    hits = {d for d, *_ in found_by_brute_force(list(got[2].items()), [(1, item)])}
    assert hits and set(got[3]) == set(got[2]) - hits
    out = cp.run(spark, str(tmp_path)).collect()
    assert {(x["doc_id"], x["sample"]) for x in out} == {(d, s) for d in got[3] for s in (1, 2)}


def test_odd_and_no_rows(spark, tmp_path):
    r = random.Random(2)
    one, two = text(r, 60), text(r, 60)
    names = ["kept", "lines", "gone", "n_lines", "document"]
    rows = [(1, one), (2, None), (3, ""), (None, two), (4, one), (5, two), (5, two), (6, one + "\n" + two), (None, one), (7, text(r, 6000))]
    schema = f"doc_id bigint, text string, {', '.join(f'{n} string' for n in names)}"
    spark.createDataFrame([(1, text(r, 30)), (None, None)], "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    for name, some in (("odd", rows), ("none", [])):
        folder = tmp_path / name
        folder.mkdir()
        (tmp_path / name / "benchmark.parquet").symlink_to(tmp_path / "benchmark.parquet")
        spark.createDataFrame([(*x, *names) for x in some], schema).write.parquet(str(folder / "documents.parquet"))
        frame = spark.read.parquet(str(folder / "documents.parquet"))
        for k, (_, stage) in enumerate(cp.STAGES[:-1]):
            stage(spark, frame, str(folder)).write.parquet(str(folder / f"s{k}"))
            frame = spark.read.parquet(str(folder / f"s{k}"))
            assert frame.columns == ["doc_id", "text", *names] and all(x[n] == n for x in frame.collect() for n in names)
        # the lines of 4 and 6 are those of 1 and 5, and both are empty then: 4 stays for the two
        assert sorted((x["doc_id"] for x in frame.collect()), key=str) == sorted([1, 4, 5, 5, 7, None, None] if some else [], key=str)
        out = cp.run(spark, str(folder)).collect()
        assert len(out) == (2 * 6 + 1 if some else 0)  # two samples each, one of the empty text


@pytest.mark.parametrize("stage", [f for name, f in cp.STAGES if name != "quality rules"], ids=lambda f: f.__name__)
def test_stages_give_back_the_heap_that_earlier_ones_filled(spark, tmp_path, stage):
    r = random.Random(5)
    spark.createDataFrame([(d, text(r, 40)) for d in range(4)], "doc_id bigint, text string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, text(r, 30))], "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    sc = spark.sparkContext  # the only executor of a local session
    garbage = sc._gateway.new_array(sc._jvm.long, 1 << 27)
    before = sc._jvm.java.lang.Runtime.getRuntime().totalMemory()
    sc._gateway._gateway_client.garbage_collect_object(garbage._target_id, False)  # at once: the JVM holds it no longer
    stage(spark, docs, str(tmp_path))
    assert before > 1 << 30 and sc._jvm.java.lang.Runtime.getRuntime().totalMemory() < before - (1 << 28)
