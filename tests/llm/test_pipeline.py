"""The pipeline's stages on a small corpus with planted cases, each against what it must do."""

from __future__ import annotations

import random

import pytest

pytest.importorskip("public_tokenizers")
corpus_pipeline = pytest.importorskip("corpus_pipeline")

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def prose(rng, n):
    return " ".join("".join(rng.choice("abcdefghijkl") for _ in range(rng.randint(1, 8))) for _ in range(n))


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    rng = random.Random(1)
    texts = {i: prose(rng, rng.randint(20, 150)) for i in range(400)}
    toxic = set(range(5, 400, 4))
    for i in toxic:
        w = texts[i].split()
        for _ in range(3):
            w.insert(rng.randrange(len(w)), "zlorp" + rng.choice(["", "ix", "un"]))
        texts[i] = " ".join(w)
    items = [prose(rng, 40) + ". " + prose(rng, 15) for _ in range(20)]
    passage = prose(rng, 70)
    texts[500], texts[501] = texts[2] + " tail", texts[2]
    texts[502] = prose(rng, 60) + " " + items[4] + " " + prose(rng, 30)
    texts[503], texts[504] = f"{prose(rng, 200)} {passage} x", f"{prose(rng, 200)} {passage} y"
    texts[505], texts[506] = None, ""
    base = tmp_path_factory.mktemp("corpus")
    spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in texts.items()], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{base}/documents.parquet")
    spark.createDataFrame([(i, int(i in toxic), 1) for i in range(400)], "doc_id long, toxic int, quality int").write.parquet(f"{base}/labels.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{base}/benchmark.parquet")
    return str(base), texts, toxic, passage


def test_stages(spark, corpus):
    base, texts, toxic, passage = corpus
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_dedup", "substring_dedup", "decontamination", "byte_bpe"]
    docs, seen = spark.read.parquet(f"{base}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.materialise(stage(spark, docs, base), name)
        seen[name] = {r.doc_id: r for r in docs.collect()}
        if name != "byte_bpe":
            assert docs.columns == COLUMNS
    ids = {k: set(v) for k, v in seen.items()}
    assert len(ids["toxicity"] & toxic) <= 2 and len(set(texts) - toxic - ids["toxicity"]) <= 2
    assert ids["toxicity"] - ids["near_dedup"] == {500, 501}
    assert ids["near_dedup"] == ids["substring_dedup"]
    cut = {i for i, r in seen["substring_dedup"].items() if r.text != texts[i]}
    assert cut == {504} and passage not in seen["substring_dedup"][504].text and seen["substring_dedup"][504].text.endswith(" y")
    assert ids["substring_dedup"] - ids["decontamination"] == {502}
    assert ids["byte_bpe"] == ids["decontamination"] and seen["byte_bpe"][505].n_tokens == 0


def test_run_equals_the_stages(spark, corpus):
    base, *_ = corpus
    got = {r.doc_id: r.ids_sha256 for r in corpus_pipeline.run(spark, base).collect()}
    docs = spark.read.parquet(f"{base}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.materialise(stage(spark, docs, base), name)
    assert got == {r.doc_id: r.ids_sha256 for r in docs.collect()}
