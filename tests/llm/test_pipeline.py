import os
import sys
from collections import Counter

import pytest
from llm.corpus import awkward
from llm.test_exact_dedup import by_hand as exact_by_hand
from llm.test_ngram_join import by_hand as near_by_hand
from llm.test_tokens import check_packing

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))
import corpus_pipeline as pipeline  # noqa: E402

from wardwatch.llm import quality  # noqa: E402
from wardwatch.llm.tables import read, stored  # noqa: E402

SF = "/root/testdata/sf0.001"
DDL = "doc_id long, text string, lang string, source string, n_chars long"


def cut_by_hand(rows, span=200):
    raw = [(i, (t or "").encode()) for i, t in rows]
    counts = Counter(t[k : k + span] for _, t in raw for k in range(len(t) - span + 1))
    out = []
    for i, t in raw:
        gone = bytearray(len(t))
        for k in range(len(t) - span + 1):
            if counts[t[k : k + span]] > 1:
                gone[k : k + span] = b"\1" * span
        out.append((i, bytes(b for b, g in zip(t, gone) if not g).decode("utf-8", "ignore")))
    return sorted(out, key=str)


def pairs(frame):
    return sorted(((r["doc_id"], r["text"]) for r in frame.collect()), key=str)


def check(spark, docs, sf_dir):
    """Run the stages one by one and hold each against brute force on its own input."""
    for name, stage in pipeline.STAGES:
        before = [(r["doc_id"], r["text"]) for r in docs.collect()]
        out = stored(stage(spark, docs, sf_dir), f"test-{name}")
        if name != "packing":
            assert out.columns == list(pipeline.COLUMNS)
        if name == "quality":
            scores = quality.scored(docs, quality.fit(docs, read(spark, sf_dir, "labels")))
            assert pairs(out) == pairs(scores.where("score >= 0.7"))
        elif name == "exact_dedup":
            kept = {(r[0], r[4]) for r in exact_by_hand(before) if r[3]}
            assert len(pairs(out)) == len(kept) and {(r[0], r[4]) for r in exact_by_hand(pairs(out))} == kept
        elif name == "near_dedup":  # five words, similarity 0.8
            kept = {r[0] for r in near_by_hand(before) if r[2] is None or r[0] == r[2]}
            assert pairs(out) == sorted((r for r in before if r[0] in kept), key=str)
        elif name == "substring_dedup":
            assert pairs(out) == cut_by_hand(before)
            assert all(r["n_chars"] == len(r["text"]) for r in out.collect())
        else:
            check_packing(before, out.collect(), 2048)
        docs = out


@pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are absent")
def test_stages_on_the_tables(spark):
    check(spark, read(spark, SF, "documents"), SF)
    assert "sequence_id" in pipeline.run(spark, SF).columns


@pytest.mark.parametrize("rows", [awkward(seed=8), []])
def test_stages_on_awkward_rows(spark, tmp_path, rows):
    labels = [(i, 1, 0) for i, t in rows if i is not None and t and len(t) > 200]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    full = spark.createDataFrame([(i, t, None, "s", None) for i, t in rows], DDL)
    full.write.parquet(str(tmp_path / "documents.parquet"))
    check(spark, read(spark, str(tmp_path), "documents"), str(tmp_path))


def test_an_id_that_is_kept_and_dropped(spark):
    rows = [(1, "a text"), (2, "a text"), (2, "a text of its own"), (3, "another")]
    for more in ([], [(None, "no id")]):
        full = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows + more], DDL)
        want = [(1, "a text"), (2, "a text of its own"), (3, "another"), *more]
        assert pairs(pipeline.exact_stage(spark, full, "")) == sorted(want, key=str)
