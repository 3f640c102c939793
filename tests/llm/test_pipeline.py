"""The pipeline against plain Python, and its stages on awkward rows."""

import hashlib
import random

import public_tokenizers
import pytest

import corpus_pipeline
from tests.llm.cases import corpus, frame, prose
from tests.llm.test_exact_and_tokens import edit_distance_anywhere
from tests.llm.test_ngram_join import brute as linked
from watchtide.llm import bpe, common, decontaminate, langid


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(7)
    items = [prose(rng, 30, 4000) for _ in range(5)]
    texts = corpus(8, 20) + [f"{prose(rng, 30, 4000)} {i} {prose(rng, 10, 4000)}" for i in items[:3]]
    path = str(tmp_path_factory.mktemp("sf"))
    frame(spark, texts).select(*corpus_pipeline.COLUMNS).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path, texts, items


def test_run_against_brute_force(spark, folder):
    path, texts, items = folder
    kept = {i: t for i, t in enumerate(texts) if t and langid.LETTER.search(t)}
    last = {t: i for i, t in kept.items()}
    kept = {i: t for i, t in kept.items() if last[t] == i}
    found = linked(list(kept.values()), list(kept))
    kept = {i: t for i, t in kept.items() if found[i][1] == i}
    parts = [p for t in items for p in decontaminate.passages(decontaminate.plain(t).split())]
    kept = {i: t for i, t in kept.items() if not any(
        edit_distance_anywhere(p, decontaminate.plain(t).split()) <= int(decontaminate.RATE * len(p)) for p in parts if len(t) < 5000)}
    enc = bpe.encoding(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    want = {i: hashlib.sha256(",".join(map(str, enc.encode_ordinary(t))).encode()).hexdigest() for i, t in kept.items()}
    rows = corpus_pipeline.run(spark, path).collect()
    assert {r["doc_id"]: r["ids_sha256"] for r in rows} == want and len(rows) == len(want)
    assert all(r["round_trip"] for r in rows)


def test_stages_return_documents(spark, folder):
    docs = spark.read.parquet(f"{folder[0]}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, folder[0]).schema == docs.schema
        assert stage(spark, docs.where("false"), folder[0]).collect() == []


def test_repeated_and_null_rows(spark, folder):
    docs = frame(spark, ["one text", "one text", None, "", "one text", "other words"], [3, 3, None, 4, 2, None])
    left = corpus_pipeline.drop_equal_texts(spark, docs, folder[0]).collect()
    assert sorted((r["doc_id"] or -1, r["text"]) for r in left) == [(-1, "other words"), (3, "one text"), (4, "")]


def test_nothing_to_learn_languages_from(spark, folder):
    texts, held = [None, "", "12 -- 7", "some words", "\u6f22\u5b57", "9 \u00e9"], [5, 7, 15, 17, 20, 22]
    assert frame(spark, texts, held).where(common.held_out()).count() == len(texts)
    for docs in (frame(spark, texts, lang=None), frame(spark, texts, held)):  # no label, labels in the held-out quarter only
        left = corpus_pipeline.identify_language(spark, docs, folder[0]).collect()
        assert sorted(r["text"] for r in left) == sorted(texts[3:])


def test_rows_that_share_an_id_have_their_own_fate(spark, folder):
    rng = random.Random(9)
    base, clean = prose(rng, 60, 4000), [prose(rng, 40, 4000) for _ in range(3)]
    near = [f"{base} {w}" for w in ("one", "two", "three")]
    leak = f"{prose(rng, 20, 4000)} {folder[2][0]} {prose(rng, 10, 4000)}"
    for shared in (None, 1, 5):
        docs = frame(spark, [*near, *clean, leak], [shared, shared, 3, shared, shared, 4, shared])
        left = {r["text"] for r in corpus_pipeline.drop_near_copies(spark, docs, folder[0]).collect()}
        same = near[:2] if shared == 1 else near[2:]  # where the smallest id is repeated, one text of it stays
        assert left - set(near) == {*clean, leak} and len(left & set(near)) == 1 and left & set(near) <= set(same)
        left = [r["text"] for r in corpus_pipeline.drop_benchmark_text(spark, docs, folder[0]).collect()]
        assert sorted(left) == sorted([*near, *clean])


def test_a_task_that_encodes_holds_one_python_worker(spark, folder):
    found = corpus_pipeline.encode(spark, spark.read.parquet(f"{folder[0]}/documents.parquet"), folder[0])
    assert found._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1
