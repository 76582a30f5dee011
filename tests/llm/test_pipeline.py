import random

import pytest

import corpus_pipeline
from casegraph.llm.common import stash


def words(rng, n):
    return [rng.choice("the of and to in".split()) if rng.random() < 0.3 else "".join(rng.choice("abcdefghijklm") for _ in range(6)) for _ in range(n)]


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    """(folder, rows by kind): clean documents, junk, exact copies, documents that share a passage, and one with a benchmark item."""
    rng, path = random.Random(2), str(tmp_path_factory.mktemp("corpus"))
    kinds, rows, labels = {}, [], []

    def add(kind, i, text):
        kinds.setdefault(kind, []).append(i)
        rows.append((i, text, "en", f"s{i % 3}", len(text or ""), "x"))

    for i in range(120):
        add("clean", i, " ".join(words(rng, rng.randint(80, 200))))
        labels.append((i, 1, 0))
    for i in range(200, 230):
        add("junk", i, " ".join(w.upper() + "!!" for w in words(rng, 100)))
        labels.append((i, 0, 0))
    for i in range(5):
        add("copies", 300 + i, rows[i][1])
    passage = " ".join(words(rng, 60))
    for i in range(400, 406):
        add("passage", i, " ".join(words(rng, 60)) + "\n" + passage + "\n" + " ".join(words(rng, 60)))
    item = " ".join(words(rng, 40))
    add("leak", 500, " ".join(words(rng, 90)) + " " + item + ". " + " ".join(words(rng, 20)))
    rows += [rows[7], (None, None, None, None, None, None), (None, "short", None, None, 5, None)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, spans string").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path, kinds, passage


def test_each_stage_does_its_part(spark, corpus):
    path, kinds, passage = corpus
    docs, after = spark.read.parquet(f"{path}/documents.parquet"), {}
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        docs = stash(stage(spark, docs, path), name)
        after[name] = docs.collect()
        if name != "mix_sources":
            assert docs.columns == columns
    ids = {k: {r.doc_id for r in v} for k, v in after.items()}
    assert len(ids["quality"] & set(kinds["junk"])) <= 2 and len(ids["quality"] & set(kinds["clean"])) >= 118
    assert not ids["near_duplicates"] & set(kinds["copies"]) and set(range(5)) & ids["near_duplicates"] == set(range(5)) & ids["quality"]
    # Two rows without an id and with different texts both stay; nothing stays twice.
    assert len({(r.doc_id, r.text) for r in after["near_duplicates"]}) == len(after["near_duplicates"]) == len(ids["near_duplicates"]) + 1
    left = [r for r in after["repeated_text"] if r.text and passage in r.text]
    assert [r.doc_id for r in left] == [min(ids["near_duplicates"] & set(kinds["passage"]))]
    assert ids["repeated_text"] == ids["near_duplicates"]
    assert ids["repeated_text"] - ids["benchmark_leaks"] == {500}
    assert ids["mix_sources"] == ids["benchmark_leaks"]
    assert sum(r.taken for r in after["mix_sources"]) == pytest.approx(1.5 * sum(r.size for r in after["mix_sources"]), abs=4)


def test_empty_tables(spark, corpus, tmp_path):
    path, _, _ = corpus
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{path}/{name}.parquet").filter("false").write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
