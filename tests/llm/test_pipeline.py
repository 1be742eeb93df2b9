"""The stages on a small corpus against their brute-force versions, and on odd tables."""

import random

import pytest

import corpus_pipeline
from quirework.llm import privacy

from .test_native import base
from .test_text import brute_classes, brute_cuts, near_texts, split

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, base string, row_key string, others string, label long"
LABELS = "doc_id long, quality int, toxic int"


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    r = random.Random(21)
    passage = " ".join(f"shared{k}" for k in range(70))
    texts = [(i + 1000, t) for i, t in near_texts(5)]
    texts += [(5000 + i, f"{' '.join(r.choice('abcdefgh') * 3 + str(r.randrange(999)) for _ in range(30))}\n{passage}\ttail {i}") for i in range(12)]
    texts += [(6000 + i, " ".join([r.choice(["lamp", "river", "stone", "cloud"]) + str(r.randrange(99)) for _ in range(30)]
              + (["grobian", "dumpling"] * 2 if i % 3 == 0 else []))) for i in range(300)]
    texts += [(7000, "write to a@b.org or +1 (988) 555-2485 from 10.0.0.1 soon"), (7001, None), (7002, ""), (7003, "odd row"), (7003, "odd row")]
    rows = [(i, t, "en", "s", len(t or ""), 1.0, "b", "k", "o", 3) for i, t in texts]
    labels = [(6000 + i, 1, int(i % 3 == 0)) for i in range(200)] + [(None, 1, 1), (6001, 1, None)]
    path = str(tmp_path_factory.mktemp("corpus"))
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, LABELS).write.parquet(f"{path}/labels.parquet")
    return path, texts


def test_stages_equal_brute_force(spark, corpus):
    path, texts = corpus
    docs, state = spark.read.parquet(f"{path}/documents.parquet"), sorted(texts, key=str)
    for name, stage in corpus_pipeline.STAGES:
        out = corpus_pipeline.settle(stage(spark, docs, path))
        if name == "packing":
            got, words = {}, {}
            for x in sorted(out.collect(), key=lambda x: x["first"]):
                got[x["doc_id"]] = got.get(x["doc_id"], 0) + x["length"]
                words.setdefault(x["doc_id"], []).extend(split(x["text"]))
            assert got == {i: len(split(t)) + 1 for i, t in state}
            assert words == {i: split(t) for i, t in state}
            break
        assert out.columns == docs.columns and [t for _, t in out.dtypes] == [t for _, t in docs.dtypes]
        rows = out.collect()
        assert all(x["score"] == 1.0 and x["others"] == "o" and x["label"] == 3 for x in rows)
        if name == "toxicity":
            want = [(i, t) for i, t in state if not (6000 <= i < 6300 and (i - 6000) % 3 == 0)]
        elif name == "ngram_join":
            classes = brute_classes(sorted(state, key=lambda x: x[0]))
            want = sorted({(i, t) for i, t in state if classes[i][1] == i}, key=str)
        elif name == "substring_dedup":
            cuts = brute_cuts(state, 50)
            assert sum(c[1] for c in cuts.values()) >= 11 * 70
            want = [(i, cuts[i][2]) for i, _ in state]
            assert sorted([(x["doc_id"], " ".join(split(x["text"]))) for x in rows], key=str) == sorted(want, key=str)
            want = [(x["doc_id"], x["text"]) for x in rows]
        else:
            want = []
            for i, t in state:
                spans, at, text = sorted((a, b, k) for k, a, b in base(t or "")), 0, ""
                for a, b, k in spans:
                    text, at = text + (t or "")[at:a] + f"[{k.upper()}]", b
                want.append((i, text + (t or "")[at:]))
        state = sorted([(x["doc_id"], x["text"]) for x in rows], key=str)
        assert state == sorted(want, key=str), name
        assert all(x["n_chars"] == len(x["text"] or "") for x in rows if x["text"] is not None)
        docs = out
    assert {i: t for i, t in state}[7000] == "write to [EMAIL] or [PHONE] from [IP] soon"
    assert privacy.KINDS[-1] == "term"


def test_run_and_empty_tables(spark, corpus, tmp_path):
    path, _ = corpus
    assert corpus_pipeline.run(spark, path).count() > 0
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], LABELS).write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
