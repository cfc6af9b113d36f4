import os
import random
import zlib

import pytest
from llm.corpus import awkward, frame

from wardwatch.llm import quality, toxicity
from wardwatch.llm.labelled import sample
from wardwatch.llm.tables import read

SF = "/root/testdata/sf0.1"


def labels_frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int, text string")


def toy(n=600):
    r = random.Random(2)
    good = [f"word{k}" for k in range(300)]
    docs, labels = [], []
    for k in range(n):
        text = [r.choice(good) for _ in range(80)]
        bad, toxic = k % 3 == 0, k % 4 == 0
        if bad:
            text = [w + r.choice(["%%%", "&&&", "***"]) for w in text]
        if toxic:
            for _ in range(4):
                text.insert(r.randrange(len(text)), r.choice(["nasty", "vile", "horrid"]))
        docs.append((k, " ".join(text)))
        labels.append((k, int(not bad), int(toxic), "clash"))
    return docs, labels


def test_quality_held_out(spark):
    docs, labels = toy()
    got = quality.quality(frame(spark, docs), labels_frame(spark, labels)).collect()
    held = [r for r in got if r["held_out"]]
    assert {r["doc_id"] for r in held} == {i for i, _ in docs if zlib.crc32(str(i).encode()) % 4 == 2}
    assert all(r["predicted"] == int(r["score"] >= 0.7) and 0 <= r["score"] <= 1 for r in got)
    assert sum(r["predicted"] == int(r["doc_id"] % 3 != 0) for r in held) >= 0.97 * len(held)


def test_toxicity_held_out(spark):
    docs, labels = toy()
    got = toxicity.toxicity(frame(spark, docs), labels_frame(spark, labels)).collect()
    held = [r for r in got if r["held_out"]]
    assert {r["doc_id"] for r in held} == {i for i, _ in docs if zlib.crc32(str(i).encode()) % 5 == 0}
    assert all(r["predicted"] == int(r["score"] >= 0.5) and 0 <= r["score"] <= 1 for r in got)
    assert sum(r["predicted"] == int(r["doc_id"] % 4 == 0) for r in held) >= 0.97 * len(held)


def test_held_out_labels_change_nothing(spark):
    docs, labels = toy(200)
    for module, name, column, modulus, rest in ((quality, "quality", 1, 4, 2), (toxicity, "toxicity", 2, 5, 0)):
        other = [tuple(1 - v if k == column and zlib.crc32(str(r[0]).encode()) % modulus == rest else v for k, v in enumerate(r)) for r in labels]
        run = getattr(module, name)
        one, two = (sorted(map(tuple, run(frame(spark, docs), labels_frame(spark, x)).collect())) for x in (labels, other))
        assert one == two


@pytest.mark.parametrize("labels", [[], [(1000, 1, 0, "")], [(None, 0, 1, ""), (1001, None, None, ""), (1002, 5, 7, "")]])
def test_awkward_rows_and_labels(spark, labels):
    rows = awkward(n=12)
    for module, name in ((quality, "quality"), (toxicity, "toxicity")):
        got = getattr(module, name)(frame(spark, rows), labels_frame(spark, labels)).collect()
        assert sorted((r["doc_id"] for r in got), key=str) == sorted((i for i, _ in rows), key=str)
        assert all(0 <= r["score"] <= 1 and r["held_out"] is not None for r in got)
        assert getattr(module, name)(frame(spark, []), labels_frame(spark, labels)).collect() == []


def test_sample_is_bounded_and_clean(spark):
    docs, labels = toy(100)
    labels = labels + [(1, 1 - labels[1][1], 0, ""), labels[2]]
    found, label, counts = sample(frame(spark, docs), labels_frame(spark, labels), "quality", 4, 2, {0: 5, 1: 7}, 10**6)
    text_of = dict(docs)
    assert label.count(0) == 5 and label.count(1) == 7 and text_of[1] not in found
    assert sum(counts.values()) == sum(1 for i in range(100) if i != 1 and zlib.crc32(str(i).encode()) % 4 != 2)


@pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are absent")
@pytest.mark.parametrize(("module", "name", "column", "least"), [(quality, "quality", "quality", 0.985), (toxicity, "toxicity", "toxic", 0.965)])
def test_accuracy_on_the_tables(spark, module, name, column, least):
    labels = read(spark, SF, "labels")
    got = getattr(module, name)(read(spark, SF, "documents"), labels).where("held_out").join(labels, "doc_id")
    row = got.selectExpr(f"avg(cast(predicted = {column} as int)) as accuracy").first()
    assert row["accuracy"] >= least
