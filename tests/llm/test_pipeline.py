"""Every stage of the pipeline on a small corpus, against what the operators' brute-force versions leave."""

import random

import numpy as np
import pytest
from test_operators import brute_sets, frame, union, words

import corpus_pipeline
from tessella.llm import privacy


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    r = random.Random(21)
    path = tmp_path_factory.mktemp("tables")
    rows, labels = [], []
    for i in range(240):
        toxic = r.random() < 0.25
        w = words(r, r.randint(30, 90)).split()
        for _ in range(5 * toxic):
            w[r.randrange(len(w))] = r.choice(["vile", "rotten", "wretch"])
        rows.append((i, " ".join(w)))
        labels.append((i, 1, int(toxic)))
    passage = words(random.Random(2), 90)
    rows += [(1000 + k, rows[10 + k % 3][1]) for k in range(9)] + [(1100 + k, f"{words(r, 40)} {passage} {words(r, 40)}") for k in range(4)] + [(1200, None), (1201, ""), (1202, f"write to me@x.example.com {words(r, 30)}")]
    frame(spark, rows).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return str(path)


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    bad = {r["doc_id"] for r in docs.collect() if r["text"] and any(w in r["text"].split() for w in ("vile", "rotten", "wretch"))}
    one = corpus_pipeline.drop_toxic(spark, docs, folder)
    assert one.columns == corpus_pipeline.COLUMNS
    left = {r["doc_id"]: r["text"] for r in one.collect()}
    assert len(bad & set(left)) <= 0.05 * len(bad) and len({r["doc_id"] for r in docs.collect()} - bad - set(left)) <= 3
    two = corpus_pipeline.drop_near_copies(spark, one, folder)
    sets = brute_sets(list(left.items()))
    own = sorted(sets)
    want = union([(a, b) for n, a in enumerate(own) for b in own[:n] if sets[a] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])], own)
    kept = {r["doc_id"]: r["text"] for r in two.collect()}
    assert set(kept) == {i for i in own if want[i] == i}
    three = {r["doc_id"]: r for r in corpus_pipeline.drop_repeats(spark, two, folder).collect()}
    assert set(three) == set(kept) and all(three[i]["n_chars"] < len(kept[i]) for i in kept if 1100 <= i < 1104) and three[1200]["text"] is None
    assert all(three[i]["text"] == kept[i] for i in kept if i < 1000)
    four = {r["doc_id"]: r for r in corpus_pipeline.take_out_private(spark, two, folder).collect()}
    assert set(four) == set(kept) and "[EMAIL]" in four[1202]["text"] and not any(privacy.base_spans(r["text"] or "") for r in four.values())
    packed = corpus_pipeline.run(spark, folder).collect()
    assert {r["doc_id"] for r in packed} == set(kept)
    ends = {}
    for r in packed:
        ends.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for own in ends.values():
        own.sort()
        assert own[0][0] == 0 and all(a + b == c for (a, b), (c, _) in zip(own, own[1:])) and sum(b for _, b in own) <= corpus_pipeline.SIZE
    assert np.mean([sum(b for _, b in v) for v in ends.values()]) > 0.8 * corpus_pipeline.SIZE


def test_short_passages_of_many_words_go(spark, folder):
    r = random.Random(8)
    passage = " ".join("".join(r.choice("abcdef") for _ in range(3)) for _ in range(55))
    rows = [(k, f"{words(r, 50)} {passage} {words(r, 50)}") for k in range(3)] + [(7, words(r, 90))]
    left = {x["doc_id"]: x for x in corpus_pipeline.drop_repeats(spark, frame(spark, rows), folder).collect()}
    assert len(passage) < 400 and {i: x["text"] for i, x in left.items()} == {i: t.replace(passage, "") for i, t in rows}
    assert all(x["n_chars"] == len(x["text"]) for x in left.values())


def test_empty_documents(spark, folder, tmp_path):
    spark.read.parquet(f"{folder}/documents.parquet").limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{folder}/labels.parquet").limit(0).write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
