"""Each training-data operator against brute force on small tables with nulls, empty and long texts, ties, repeats, extra columns."""

from __future__ import annotations

import base64
import gzip
import hashlib
import random
import re
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quillspark import state

public_tokenizers = pytest.importorskip("public_tokenizers")

from quillspark.llm import bpe, chat, components, decontaminate, langid, near_dup, quality, sharding, substring, toxicity, warc  # noqa: E402
from quillspark.llm.words import find_words, text_bytes  # noqa: E402

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, kept boolean"


def words_of(text):
    return WORD.findall(text or "")


def documents(spark, texts, first=0):
    rows = [(first + i, t, "en", "s", len(t or ""), 0.5, True) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


def prose(rng, n, letters="abcdefgh"):
    return " ".join("".join(rng.choice(letters) for _ in range(rng.randint(1, 7))) for _ in range(n))


def rows(df, *names):
    return sorted(tuple(r[n] for n in names) for r in df.collect())


# ---- words


def test_words_match_the_pattern():
    rng = random.Random(3)
    texts = ["".join(rng.choice("ab é\t\n\r\x0b\x0c \x1c") for _ in range(rng.randint(0, 30))) for _ in range(300)] + [None, "", " "]
    w = find_words(*text_bytes(pa.array(texts, pa.string())))
    raw = w.data.tobytes()
    got = [[] for _ in texts]
    for a, b, r in zip(w.start, w.end, w.row, strict=True):
        got[r].append(raw[a:b].decode())
    assert got == [words_of(t) for t in texts]
    assert len({(raw[a:b], h) for a, b, h in zip(w.start, w.end, w.hash, strict=True)}) == len({raw[a:b] for a, b in zip(w.start, w.end, strict=True)}) == len(set(w.hash.tolist()))


# ---- 1: substring dedup


def brute_substring(texts, length):
    starts = {}
    for d, t in enumerate(texts):
        w = words_of(t)
        for i in range(len(w) - length + 1):
            starts.setdefault(tuple(w[i : i + length]), d)
    out = []
    for d, t in enumerate(texts):
        w = words_of(t)
        gone = {j for i in range(len(w) - length + 1) if starts[tuple(w[i : i + length])] < d for j in range(i, i + length)}
        kept = [x for i, x in enumerate(w) if i not in gone]
        out.append((d, len(w), len(gone), hashlib.sha256(" ".join(kept).encode()).hexdigest()))
    return sorted(out)


def test_substring_dedup_is_exact(spark):
    rng = random.Random(5)
    shared = [prose(rng, n) for n in (49, 50, 51, 80, 140)]
    texts = [None, "", "  \n", prose(rng, 49)]
    for _ in range(60):
        parts = [prose(rng, rng.randint(0, 60), "ab" if rng.random() < 0.3 else "abcdefgh")]
        for _ in range(rng.randint(0, 3)):
            piece = rng.choice(shared).split()
            a = rng.randint(0, 10)
            parts += [" ".join(piece[a:]), prose(rng, rng.randint(0, 4))]
        texts.append(rng.choice(["\n", " ", "\t"]).join(parts))
    texts += [texts[10], texts[10], "a " * 300, "a " * 300, " ".join(["x y"] * 200), prose(rng, 20000)]
    got = rows(substring.digest(documents(spark, texts)), "doc_id", "n_words", "n_removed", "kept_sha256")
    assert got == brute_substring(texts, 50)


def test_substring_dedup_of_periodic_texts(spark, monkeypatch):
    monkeypatch.setattr(substring, "STRETCH", 16)
    rng = random.Random(31)
    texts = []
    for _ in range(60):
        period = [rng.choice("ab") for _ in range(rng.choice([1, 2, 3, 7, 12, 30]))]
        body = (period * 200)[rng.randrange(12) : rng.randrange(40, 200)]
        texts.append(" ".join([*prose(rng, rng.randrange(6)).split(), *body, *prose(rng, rng.randrange(30)).split()]))
    texts += texts[:5]
    got = rows(substring.digest(documents(spark, texts)), "doc_id", "n_words", "n_removed", "kept_sha256")
    assert got == brute_substring(texts, 50)


def test_substring_dedup_of_many_kinds(spark):
    """One passage in many contexts of which some are alike, periodic texts, and rows of one doc_id with other texts."""
    rng = random.Random(55)
    core, sides = prose(rng, 20).split(), [prose(rng, 45).split() for _ in range(4)]
    texts = []
    for _ in range(80):
        left, right = rng.choice(sides), rng.choice(sides)
        texts.append(" ".join([*left[rng.randint(0, 30) :], *core, *right[: rng.randint(10, 45)], prose(rng, 3), *rng.choice([[], ["p", "q"] * rng.randint(20, 90), ["z"] * rng.randint(40, 200)])]))
    assert rows(substring.digest(documents(spark, texts)), "doc_id", "n_words", "n_removed", "kept_sha256") == brute_substring(texts, 50)
    twice = documents(spark, texts[:40]).unionByName(documents(spark, [prose(rng, 70), texts[3], texts[3]], 3).withColumn("doc_id", F.lit(3).cast("long")))
    got = rows(substring.digest(twice), "doc_id", "n_words", "n_removed", "kept_sha256")
    own = [r for r in got if r[0] == 3]
    assert len(got) == 43 and len(own) == 4 and len(set(own)) == 2 and [r for r in got if r[0] < 3] == brute_substring(texts[:3], 50)
    assert brute_substring(texts[:4], 50)[3] in own


def test_extension_goes_both_ways():
    own, other = np.arange(100, dtype=np.uint64), np.arange(100, dtype=np.uint64)
    other[[20, 80]] = 999
    assert substring.extended(own, other, 50, 50) == (29, 30) and substring.extended(own, own, 50, 50) == (50, 50) and substring.extended(own, own[40:], 50, 10) == (10, 50)
    assert substring.extended(own, other, 0, 0) == (0, 20) and substring.extended(own, own + np.uint64(1), 5, 5) == (0, 0)


def test_substring_dedup_keeps_columns_and_clean_texts(spark):
    rng = random.Random(6)
    long = prose(rng, 70)
    texts = [f"keep \n  this {long}", f"other\n\nstart {long} tail  end", "clean \n text"]
    out = {r.doc_id: r for r in substring.dedup_documents(documents(spark, texts)).collect()}
    assert out[0].text == texts[0] and out[2].text == texts[2] and out[1].text == "other\n\nstart tail  end" and out[1].n_chars == len(out[1].text) and out[1].source == "s"
    nobody = documents(spark, texts).withColumn("doc_id", F.lit(None).cast("long"))
    assert {r.n_removed for r in substring.digest(nobody).collect()} == {0}
    assert substring.digest(documents(spark, []).limit(0)).count() == 0


# ---- 2 and 3: classifiers


def insults(rng, toxic):
    w = prose(rng, rng.randint(5, 80)).split()
    for _ in range(3 if toxic else 0):
        w.insert(rng.randint(0, len(w)), "zlorp" + rng.choice(["a", "ix", "unt", "o"]) + rng.choice(["", ".", "!"]))
    return " ".join(w)


def test_toxicity_held_out(spark):
    rng = random.Random(7)
    y = [int(rng.random() < 0.3) for _ in range(700)]
    docs = documents(spark, [insults(rng, t) for t in y]).unionByName(documents(spark, [None, "", "  "], 5000))
    labels = spark.createDataFrame([*[(i, t, 1) for i, t in enumerate(y)], (1, None, 1)], "doc_id long, toxic int, quality int")
    model = toxicity.learn(docs, labels)
    out = {r.doc_id: r for r in toxicity.score_documents(docs, model).collect()}
    assert len(out) == 703 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in out.values())
    held = [i for i in range(700) if zlib.crc32(str(i).encode()) % 3 == 1]
    assert {i for i in range(700) if out[i].held_out} == set(held)
    assert sum(out[i].predicted == y[i] for i in held) / len(held) > 0.97
    assert out[5000].predicted == out[5001].predicted == out[5002].predicted == 0
    again = toxicity.score_documents(docs.drop("lang", "source"), model)
    assert {r.doc_id: r.score for r in again.collect()} == {k: r.score for k, r in out.items()}


def test_toxicity_without_labels(spark):
    docs = documents(spark, ["a b", None])
    labels = spark.createDataFrame([(0, 1)], "doc_id long, toxic int")
    assert {r.score for r in toxicity.score_documents(docs, toxicity.learn(docs, labels)).collect()} == {0.0}
    assert toxicity.score_documents(docs.limit(0), None).count() == 0


def test_toxicity_fits_every_labelled_row(spark, monkeypatch):
    """More rows than a sample would take, one of over 1 MB; the same model from any partitions; the cut of the best F1."""
    rng = random.Random(19)
    y = [int(rng.random() < 0.4) for _ in range(9000)]
    texts = [f"{rng.choice(['fool', 'scum']) if t else rng.choice(['tree', 'sky'])} w{rng.randrange(300)} {rng.choice('abc')}" for t in y]
    texts[7] = " ".join(["rareword"] * 130_000)
    docs = documents(spark, texts)
    labels = spark.createDataFrame(list(enumerate(y)), "doc_id long, toxic int")
    monkeypatch.setattr(toxicity, "ROUNDS", 2)
    monkeypatch.setattr(toxicity, "SHARD_BYTES", 300_000)
    model = toxicity.learn(docs, labels)
    used = [i for i in range(9000) if zlib.crc32(str(i).encode()) % 3 != 1]
    assert 7 in used
    counts = np.full(toxicity.BUCKETS, 0.1)
    for i in used:
        np.add.at(counts, toxicity.features(*text_bytes(pa.array([texts[i]])))[0][:, 0], 1)
    assert model.langs == ["en"] and np.allclose(model.words[:, 0], np.log(counts / counts.sum()), atol=1e-4)
    fifth = docs.filter(F.pmod(F.xxhash64("doc_id", F.lit(99)), F.lit(5)) == 0)
    aside = sorted({r.doc_id for r in fifth.select("doc_id").collect()} & set(used))
    z = model.logits(*toxicity.features(*text_bytes(pa.array([texts[i] for i in aside]))))
    truth = np.array([y[i] for i in aside])

    def f1(at):
        return 2 * truth[z >= at].sum() / ((z >= at).sum() + truth.sum())

    assert f1(model.cuts[0]) >= max(f1(c) for c in np.unique(z)) - 1e-9
    other = toxicity.learn(docs.repartition(5, "text"), labels.repartition(3))
    assert np.array_equal(model.embed, other.embed) and np.array_equal(model.cuts, other.cuts) and model.out_bias == other.out_bias


def test_language_held_out(spark):
    rng = random.Random(8)
    letters = {"xa": "abcdef", "xb": "defghi", "xc": "äöüßst"}
    truth = [rng.choice(list(letters)) for _ in range(500)]
    docs = documents(spark, [prose(rng, rng.randint(4, 60), letters[t]) for t in truth])
    docs = docs.withColumn("lang", F.element_at(F.array(*map(F.lit, truth)), (F.col("doc_id") + 1).cast("int")))
    odd = documents(spark, [None, "", "123 !!", "a", "ß"], 9000).withColumn("lang", F.lit(None).cast("string"))
    out = {r.doc_id: r for r in langid.label_documents(docs.unionByName(odd), langid.learn(docs.unionByName(odd))).collect()}
    held = [i for i in range(500) if out[i].held_out]
    assert sum(out[i].lang_pred == truth[i] for i in held) / len(held) > 0.97
    assert [out[i].lang_pred for i in (9000, 9001, 9002)] == ["und"] * 3 and out[9003].lang_pred in letters and out[9004].lang_pred == "xc"
    assert all(0 <= r.score <= 1 for r in out.values())
    assert {r.lang_pred for r in langid.label_documents(docs, langid.Model()).collect()} == {"und"}


def test_language_scores_follow_the_definition():
    model = langid.fit(["aaa bbb", "ccc ddd"] * 5, ["x", "y"] * 5)
    texts = ["a", "ab", "abc", "abcd", "aaa ccc " * 50]
    lang, score, _ = langid.predict(model, pa.array(texts))
    for t, got in zip(texts, score.to_pylist(), strict=True):
        index, share = langid.bag(t)
        z = share @ model.table[index] + model.bias if len(index) else model.bias
        assert abs(got - langid.softmax(z / model.temperature).max()) < 1e-5
    assert set(lang.to_pylist()) <= {"x", "y"}


def plain_features(text):
    """Embedding rows of each word, one multiplication at a time."""
    from quillspark.llm import words as W

    raw, base, rows, word = (text or "").encode().lower(), int(W._BASE), [], b""
    for c in [*raw, 32]:
        if not toxicity.NOT_WORD[c]:
            word += bytes([c])
            continue
        if word:
            own = []
            for i, size in enumerate((1 << 30, *toxicity.PREFIXES)):
                total = sum(int(W._BYTE[b]) * pow(base, k, 1 << 64) for k, b in enumerate(word[:size])) % (1 << 64)
                own.append((int(W.mix(np.array([(total + i) % (1 << 64)], np.uint64))[0]) >> 48) + i * toxicity.BUCKETS)
            rows.append(own)
        word = b""
    return rows


def test_toxicity_scores_follow_the_definition():
    """Embeddings, convolutions, pooling and calibration with loops over single numbers."""
    rng = np.random.default_rng(8)
    n = len(toxicity.WIDTHS) * toxicity.FILTERS
    model = toxicity.Model(
        rng.normal(0, 0.5, (toxicity.KINDS * toxicity.BUCKETS, toxicity.DIM)).astype(np.float32), [rng.normal(0, 0.4, (w, toxicity.DIM, toxicity.FILTERS)).astype(np.float32) for w in toxicity.WIDTHS],
        rng.normal(0, 0.3, n).astype(np.float32), rng.normal(0, 0.5, n).astype(np.float32), 0.2, ["aa", "bb"], rng.normal(0, 1, (toxicity.BUCKETS, 2)).astype(np.float32), np.array([0.3, -0.4]), np.array([0.7, 1.3]),
    )
    pick = random.Random(8)
    texts = ["", None, "one", "One, two!", "größer_als x9"] + [prose(pick, pick.randint(1, 30), "abCé-") for _ in range(25)]
    got = toxicity.score_texts(model, pa.array(texts, pa.string()))[0].to_pylist()
    for text, score in zip(texts, got, strict=True):
        rows_ = plain_features(text)
        vectors = [[sum(float(model.embed[r][d]) for r in row) for d in range(toxicity.DIM)] for row in rows_]
        pooled = []
        for w, width in enumerate(toxicity.WIDTHS):
            for f in range(toxicity.FILTERS):
                sums = [sum(vectors[at + o][d] * float(model.filters[w][o][d][f]) for o in range(width) for d in range(toxicity.DIM)) for at in range(len(vectors) - width + 1)]
                pooled.append(max(0.0, max(sums) + float(model.bias[w * toxicity.FILTERS + f])) if sums else 0.0)
        logit = sum(p * float(o) for p, o in zip(pooled, model.out, strict=True)) + model.out_bias
        votes = [sum(float(model.words[row[0]][k]) for row in rows_) for k in range(2)]
        lang = votes.index(max(votes))
        z = (logit - model.cuts[lang]) * model.scales[lang] + np.log(toxicity.CUT / (1 - toxicity.CUT))
        assert abs(score - 1 / (1 + np.exp(-z))) < 1e-4


# ---- 4: sharding


def jump(key, n):
    key = (key + 0x9E3779B97F4A7C15) & (2**64 - 1)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        key = ((key ^ key >> shift) * factor) & (2**64 - 1)
    key ^= key >> 31
    b, j = -1, 0
    while j < n:
        b = j
        key = (key * 2862933555777941757 + 1) & (2**64 - 1)
        j = int((b + 1) * (float(1 << 31) / ((key >> 33) + 1)))
    return b


def test_sharding(spark):
    texts = [None, "", "é", "x" * 50000, "same", "same"] + ["t"] * 500
    docs = documents(spark, texts).unionByName(documents(spark, ["same"], 4))
    out = sharding.shard_documents(docs).collect()
    assert len(out) == 507
    for r in out:
        assert r.shard == jump(r.doc_id, 16) and r.grown_shard == jump(r.doc_id, 17) and r.grown_shard in (r.shard, 16) and r.law == "key"
    first = {r.doc_id: r for r in out}
    assert (first[0].size, first[0].text_crc32, first[2].size, first[2].text_crc32) == (1, 0, 3, zlib.crc32("é".encode()))
    for s in range(16):
        assert sorted(r.slot for r in out if r.shard == s) == list(range(sum(r.shard == s for r in out)))
    assert sharding.shard_documents(docs.limit(0)).count() == 0
    keys = np.arange(20000)
    counts = np.bincount(sharding.jump_hash(keys, 16))
    assert counts.min() > 1100 and counts.max() < 1400


# ---- 5: decontamination


def test_decontamination(spark):
    rng = random.Random(9)
    items = [prose(rng, 30, "abcdefghijkl") + ". " + prose(rng, 12, "abcdefghijkl") for _ in range(40)]
    plain = [prose(rng, rng.randint(1, 400), "abcdefghijkl") for _ in range(60)]
    leaks = {i: rng.randrange(40) for i in range(0, 60, 4)}
    texts = [f"{t} {items[leaks[i]]} {prose(rng, 50)}" if i in leaks else t for i, t in enumerate(plain)] + [None, "", items[3].upper().replace(".", " ,")]
    bench = spark.createDataFrame([*enumerate(items), (99, None), (98, "")], "item_id long, text string")
    want = sorted([*leaks.items(), (62, 3)])
    assert rows(decontaminate.find_leaks(documents(spark, texts), bench), "doc_id", "item_id") == want
    flagged = decontaminate.with_leaks(documents(spark, texts), bench, "__leaks")
    assert {r.doc_id for r in flagged.collect() if r["__leaks"]} == {d for d, _ in want} and flagged.columns[:-1] == documents(spark, []).columns
    assert decontaminate.find_leaks(documents(spark, texts), bench.limit(0)).count() == 0


def test_bounds_lose_nothing():
    """Pruning gives the pairs that scoring every item for every passage gives."""
    import pandas as pd

    rng = random.Random(10)
    items = pd.DataFrame({"item_id": range(50), "text": [prose(rng, rng.randint(5, 40), "abc") for _ in range(50)]})
    index = decontaminate.build_index(items)
    texts = [prose(rng, rng.randint(1, 200), "abc") for _ in range(40)]
    data, offsets = text_bytes(pa.array(texts))
    got = {(r, i): s for r, i, s, *_ in decontaminate.find(index, data, offsets, 0.35, 0.0)}
    words = find_words(data, offsets, lower=True, space=toxicity.NOT_WORD)
    want = {}
    for d in range(len(texts)):
        own = words.hash[words.first[d] : words.first[d + 1]]
        for at in range(0, max(1, len(own) - 32), 32):
            terms = set(own[at : at + 64].tolist())
            scores = np.zeros(len(index.ids))
            for t, h in enumerate(index.terms.tolist()):
                if h in terms:
                    scores[index.items[index.at[t] : index.at[t + 1]]] += index.weights[index.at[t] : index.at[t + 1]]
            for i in np.flatnonzero(scores >= 0.35):
                want[d, int(i)] = max(want.get((d, int(i)), 0), scores[i])
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-5 for k in got)


def test_long_items_and_changed_words():
    import pandas as pd

    rng = random.Random(21)
    items = [prose(rng, n, "abcdefghijkl") for n in (15, 40, 64, 65, 128, 200, 500)]
    index = decontaminate.build_index(pd.DataFrame({"item_id": range(7), "text": items}))
    texts = [f"{prose(rng, 100)} {t} {prose(rng, 77)}" for t in items] + [prose(rng, 300, "abcdefghijkl")]
    changed = items[1].split()
    changed[-2] = "changed"
    texts += [f"{prose(rng, 50)} {' '.join(changed)} x", f"{prose(rng, 50)} {' '.join(items[5].split()[:100])} x"]
    found = decontaminate.find(index, *text_bytes(pa.array(texts)), 0.5, 0.6)
    assert [(r, int(index.ids[i])) for r, i, *_ in found] == [*((i, i) for i in range(7)), (8, 1)]


def test_decoys_do_not_hide_a_copy():
    """A better passage that fails is not the end: the real copy is far from it and scores no higher."""
    import pandas as pd

    rng = random.Random(33)
    question, answer = prose(rng, 44, "abcdefghijkl") + ".", prose(rng, 15, "abcdefghijkl")
    index = decontaminate.build_index(pd.DataFrame({"item_id": range(30), "text": [f"{question} {answer}", *(prose(rng, 59, "abcdefghijkl") for _ in range(29))]}))
    scrambled = f"{question} {answer}".split()
    rng.shuffle(scrambled)
    filler = [prose(rng, n, "mnopqrstuv") for n in (20, 200, 50)]
    decoys = [f"{' '.join(scrambled)} {filler[1]}", f"{question} {filler[0]} {filler[1]}", f"{filler[0]} {' '.join(scrambled)} {filler[1]} {question} {filler[1]}"]
    texts = [x for d in decoys for x in (d, *(f"{d} {' '.join(filler[2].split()[:n])} {question} {answer} {filler[1]}" for n in (0, 9, 17, 25)))]
    found = decontaminate.find(index, *text_bytes(pa.array(texts)), 0.5, 0.6)
    assert [(r, int(index.ids[i])) for r, i, *_ in found] == [(r, 0) for r in range(15) if r % 5]


def test_scores_do_not_depend_on_the_sets(spark, monkeypatch):
    """Items that go out in several sets give the scores that they give in one."""
    rng = random.Random(34)
    items = [prose(rng, rng.randint(8, 90), "abcd") for _ in range(60)]
    texts = [f"{prose(rng, rng.randint(0, 60), 'abcd')} {x} {prose(rng, 30, 'abcd')}" for x in items[::3]]
    bench = spark.createDataFrame([*enumerate(items), (98, ""), (99, None)], "item_id long, text string").coalesce(1)
    found = lambda: [(d, i, round(s, 5)) for d, i, s in rows(decontaminate.find_leaks(documents(spark, texts), bench, 0.4, 0.1), "doc_id", "item_id", "score")]
    flagged = lambda: rows(decontaminate.with_leaks(documents(spark, texts), bench, "n", 0.4, 0.1), "doc_id", "n")
    want, counts = found(), flagged()
    monkeypatch.setattr(decontaminate, "SET_BYTES", 4000)
    assert len(want) >= 20 and found() == want and flagged() == counts


# ---- 6: WARC


def test_warc_round_trip(spark, tmp_path):
    htmls = ["<p>a</p>", "WARC/1.1\r\n\r\nx", None, "", "<p>a</p>", "é\r\n\r\n", "b" * 100000, None]
    pages = spark.createDataFrame([(i, f"http://x/{i}\r\nEvil: 1" if i else None, h, "w") for i, h in enumerate(htmls)] + [(6, "http://x/6", "b" * 100000, "w")], "page_id long, url string, html string, payload_digest string")
    got = sorted(map(tuple, warc.round_trip(pages).collect()), key=str)
    want = []
    for i, h in [*enumerate(htmls), (6, htmls[6])]:
        raw = (h or "").encode()
        first = min(j for j, o in enumerate(htmls) if (o or "") == (h or ""))
        want.append((i, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "response" if i == first else "revisit", None if i == first else first))
    assert got == sorted(want, key=str)
    warc.write_archives(pages, str(tmp_path / "w"), min_bytes=5)
    records = [x for f in sorted(Path(tmp_path / "w").glob("*.gz")) for x in warc.parse(gzip.decompress(f.read_bytes()).split(warc.END)[:-1])]
    assert Counter(h["WARC-Type"] for h, _ in records) == {"response": 8, "revisit": 1} and not any("Evil" in h for h, _ in records)
    assert all(b.endswith(b"\r\n\r\n") for h, b in records if h["WARC-Type"] == "revisit")
    assert warc.round_trip(pages.limit(0)).count() == 0
    assert {h["WARC-Date"] for h, _ in records} != {"1970-01-01T00:00:00Z"} and len({h["WARC-Date"] for h, _ in records}) == 1


def test_warc_hot_payload_and_repeated_ids(spark, tmp_path):
    """Payloads full of record ends, one payload on most pages, rows of one page_id with other payloads, archives of a few records."""
    rng = random.Random(60)
    htmls = ["" if rng.random() < 0.4 else rng.choice(["\r\n\r\n", "a\r\n\r\n\r\n", "WARC/1.1\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"]) * rng.randint(1, 4) for _ in range(400)]
    table = [(i // 2, None, h) for i, h in enumerate(htmls)] + [(None, None, "only"), (None, None, "")]
    pages = spark.createDataFrame(table, "page_id long, url string, html string")
    warc.write_archives(pages, str(tmp_path / "w"), date="2020-01-02T03:04:05Z", archive_bytes=20_000)
    assert len(list(Path(tmp_path / "w").glob("*.gz"))) > 8
    least = {}
    for i, _, h in table:
        if i is not None:
            least[h] = min(i, least.get(h, i))
    digest = lambda h: base64.b32encode(hashlib.sha1(h.encode()).digest()).decode()
    want = [(i, len(h.encode()), digest(h), *(("response", None) if i == least.get(h) else ("revisit", least.get(h)))) for i, _, h in table]
    got = [tuple(r) for r in warc.read_archives(spark, str(tmp_path / "w")).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


@pytest.mark.parametrize("payload", ["x\r\n", "\r\n", "\r\n\r\n", "\r\n\r\n\r\n", "", "a\r\n\r\nb", "\r", "\n\r\n\r", "WARC/1.1\r\n\r\n\r\n"])
def test_warc_payload_ends_an_archive(spark, payload):
    for htmls in ([payload], ["first", payload], [payload, "last"], [payload] * 3):
        pages = spark.createDataFrame([(i, "u", h) for i, h in enumerate(htmls)], "page_id long, url string, html string").coalesce(1)
        got = {r.page_id: (r.payload_bytes, r.payload_digest) for r in warc.round_trip(pages).collect()}
        assert got == {i: (len(h), base64.b32encode(hashlib.sha1(h.encode()).digest()).decode()) for i, h in enumerate(htmls)}


# ---- 7: quality


def brute_quality(text):
    text = text or ""
    w = words_of(text)
    windows = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    again = {j for i in range(len(w) - 4) if windows[tuple(w[i : i + 5])] > 1 for j in range(i, i + 5)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(again), len(w) < 10 or 100 * len(again) > 20 * len(w)


def test_quality_counts(spark):
    rng = random.Random(11)
    texts = [None, "", "\n \n", "a\na\r\na", "x " * 40, "é# ü|\n" * 4, prose(rng, 30000, "ab")] + ["\n".join(rng.choice(["a b c d e f", "# x", "", "z"]) for _ in range(rng.randint(1, 9))) for _ in range(80)]
    out = quality.judge_documents(documents(spark, texts), None)
    got = rows(out, "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
    assert got == [(i, *brute_quality(t), not brute_quality(t)[5]) for i, t in enumerate(texts)]


def test_crf_learns_lines_and_viterbi_is_exact(spark):
    rng = random.Random(12)
    good = lambda: "\n".join(prose(rng, 15) + "." for _ in range(rng.randint(1, 6)))
    bad = lambda: "\n".join(" ".join(w + "$$$" for w in prose(rng, 15).split()) for _ in range(rng.randint(1, 6)))
    texts = [good() if i % 2 else bad() for i in range(300)]
    docs, labels = documents(spark, texts), spark.createDataFrame([(i, i % 2) for i in range(200)] + [(5, None)], "doc_id long, quality int")
    crf = quality.learn(docs, labels)
    kept = {r.doc_id: r.kept for r in quality.judge_documents(docs, crf).collect()}
    assert all(kept[i] == bool(i % 2) for i in range(300))
    _, lines = quality.measure(*text_bytes(pa.array(texts[:20])))
    states = quality.viterbi(crf, lines)
    score = lines.x @ crf.weights
    for d in range(20):
        a, b = lines.first[d], lines.first[d + 1]
        paths = [[int(c) for c in f"{p:0{b - a}b}"] for p in range(2 ** (b - a))]
        value = lambda p: sum(score[a + t, s] for t, s in enumerate(p)) + sum(crf.steps[x, y] for x, y in zip(p, p[1:], strict=False))  # noqa: B023, E731
        assert abs(max(map(value, paths)) - value(states[a:b].tolist())) < 1e-9


def plain_verdict(crf, text, min_share=0.5):
    """kept, word by word and line by line: features, the best path of states, and the share of content."""
    text = text or ""
    base_failed = brute_quality(text)[5]
    w = words_of(text)
    windows = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    again = {j for i in range(len(w) - 4) if windows[tuple(w[i : i + 5])] > 1 for j in range(i, i + 5)}
    seen, at, x, sizes = set(), 0, [], []
    for line in text.split("\n"):
        own = words_of(line)
        if not own:
            continue
        n, chars = len(own), sum(map(len, own))
        symbols = len(re.findall(r"[#*$%&|<>]", line))
        same = sum(a == b for a, b in zip(own, own[1:], strict=False))
        x.append([
            1, np.log(n) / 4, min(1, 5 * symbols / chars), min(chars / n, 20) / 8, min(1, 2 * len(re.findall("[A-Z]", line)) / chars), len(re.findall("[0-9]", line)) / chars,
            min(1, 3 * sum(bool(re.fullmatch(r"[#*$%&|<>]", v)) for v in own) / n), len(again & set(range(at, at + n))) / n, min(1, 3 * same / n), float(line in seen), sum(v.endswith("!") for v in own) / n,
        ])
        seen.add(line)
        sizes.append(chars)
        at += n
    best = [(0.0, [])]
    for k, row in enumerate(x):
        score = [sum(v * crf.weights[f, s] for f, v in enumerate(row)) for s in (0, 1)]
        best = [max(((v + (crf.steps[p[-1], s] if k else 0) + score[s], [*p, s]) for v, p in best), key=lambda b: b[0]) for s in (0, 1)]
    states = max(best, key=lambda b: b[0])[1]
    content = sum(n for n, s in zip(sizes, states, strict=True) if s)
    return not base_failed and content / max(1, sum(sizes)) >= min_share


def test_quality_verdicts_equal_brute_force(spark):
    rng, draw = random.Random(17), np.random.default_rng(17)
    line = lambda: rng.choice([prose(rng, rng.randint(1, 12)), " | ".join(prose(rng, 5).split()), "BUY NOW! 50 % OFF!", "a b c d e f", "x x x", "", " \t", "é# ü & * 12"])
    texts = [None, ""] + ["\n".join(line() for _ in range(rng.randint(1, 14))) for _ in range(150)]
    for _ in range(3):
        crf = quality.Crf(draw.normal(0, 1, (quality.N_FEATURES, 2)), draw.normal(0, 0.7, (2, 2)))
        got = rows(quality.judge_documents(documents(spark, texts), crf), "doc_id", "kept")
        assert got == [(i, plain_verdict(crf, t)) for i, t in enumerate(texts)]
        assert 20 < sum(k for _, k in got) < 140


# ---- 8: near duplicates


def brute_groups(texts, threshold):
    sets = []
    for t in texts:
        w = words_of(re.sub("[A-Z]+", lambda m: m.group().lower(), t or ""))
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    up = list(range(len(texts)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if both and 100 * both >= round(100 * threshold) * (len(a) + len(sets[j]) - both):
                x, y = root(i), root(j)
                up[max(x, y)] = min(x, y)
    return sorted((i, len(s), root(i), root(i) == i) for i, s in enumerate(sets))


@pytest.mark.parametrize("threshold", [0.8, 0.85])
def test_near_duplicates_are_exact(spark, threshold):
    rng = random.Random(13)
    texts = [None, "", " ", "a b c", "A b C", "a b c d", "x"]
    for _ in range(12):
        base = prose(rng, rng.choice([6, 30, 120, 400])).split()
        for _ in range(rng.randint(1, 6)):
            w = list(base)
            for _ in range(rng.randint(0, max(1, len(w) // 60))):
                w[rng.randrange(len(w))] = "new" + str(rng.random())
            texts.append(" ".join(w))
    base = prose(rng, 150).split()
    for _ in range(60):  # a chain of near copies around the threshold
        w = list(base)
        for _ in range(rng.randint(0, 5)):
            w[rng.randrange(len(w))] = "e" + str(rng.random())
        texts.append(" ".join(w))
    texts += [texts[9], texts[9].upper()]
    got = rows(near_dup.group_documents(documents(spark, texts), threshold), "doc_id", "n_shingles", "component_id", "kept")
    assert got == brute_groups(texts, threshold)
    left = near_dup.drop_near_duplicates(documents(spark, texts), threshold)
    assert sorted(r.doc_id for r in left.collect()) == [r[0] for r in got if r[3]] and left.columns == documents(spark, []).columns


def test_small_blocks_cover_large_clusters(spark, monkeypatch):
    monkeypatch.setattr(near_dup, "CHUNK", 3)
    monkeypatch.setattr(near_dup, "TILE", 16)
    rng = random.Random(14)
    base = prose(rng, 120).split()
    texts = [" ".join(base[:k] + [f"u{i}"] + base[k + 1 :]) for i, k in enumerate(rng.randrange(120) for _ in range(70))]
    got = rows(near_dup.group_documents(documents(spark, texts), 0.85), "doc_id", "n_shingles", "component_id", "kept")
    assert got == brute_groups(texts, 0.85)


@pytest.mark.parametrize("n", [300, 1500])
def test_chains_under_the_threshold_ship_texts_a_few_times(spark, monkeypatch, n):
    rng = random.Random(21)
    words = prose(rng, 11 * n + 100).split()
    texts = [" ".join(words[11 * i : 11 * i + 100]) for i in range(n)]  # each 0.79 like the next
    seen, write = {}, near_dup.materialise
    monkeypatch.setattr(near_dup, "materialise", lambda df, name: seen.setdefault(name, write(df, name)) if name in ("mixed", "alive") else write(df, name))
    with state.scope(spark) as own:
        got = near_dup.group_documents.__wrapped__(documents(spark, texts), 0.85)
        assert got.filter("component_id <> doc_id").count() == 0
        assert seen["alive"].count() <= 8 * n and seen["mixed"].count() <= 40 * n
        assert seen["alive"].groupBy("bucket").count().agg(F.max("count")).first()[0] <= 12
        own.keep()


def test_sketch_merges_and_estimates():
    rng = np.random.default_rng(15)
    a, b = rng.integers(0, 2**63, 900).astype(np.uint64), rng.integers(0, 2**63, 300).astype(np.uint64)
    m = 512
    sk = lambda *sets: near_dup.sketch(np.concatenate(sets), np.concatenate([[0], np.cumsum([len(s) for s in sets])]), m)
    both = np.concatenate([a, b])
    ra, rb, rab = sk(a, b, both)
    assert (np.maximum(ra, rb) == rab).all()
    guess = near_dup.estimate(np.array([(ra > rab).sum()]), np.array([(ra < rab).sum()]), np.array([900]), np.array([1200]), m)[0]
    assert abs(guess - 0.75) < 0.06
    assert (sk(a)[0] == ra).all() and (near_dup.sketch(np.zeros(0, np.uint64), np.array([0, 0]), m) == 0).all()


def test_no_duplicates_and_empty_tables(spark):
    docs = documents(spark, ["one two three four five six", "seven"])
    assert rows(near_dup.group_documents(docs, 0.85), "doc_id", "component_id") == [(0, 0), (1, 1)]
    assert near_dup.group_documents(docs.limit(0), 0.85).count() == 0


def test_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(30)] + [(50, 40), (40, 50), (60, 60), (70, 71), (71, 72), (72, 70)], "u long, v long")
    got = dict(rows(components.components(edges, "u", "v"), "node", "component"))
    assert got == {**dict.fromkeys(range(31), 0), 40: 40, 50: 40, 70: 70, 71: 70, 72: 70}


# ---- 9: BPE


def test_bpe_equals_the_reference_library(spark):
    tiktoken = pytest.importorskip("tiktoken")
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    own = bpe.Bpe(Path(path).read_bytes())
    other = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=own.ranks, special_tokens={})
    rng = random.Random(16)
    mixed = lambda: "".join(chr(rng.choice([rng.randrange(32, 127), rng.randrange(0xD800), rng.randrange(0x1F300, 0x1F6FF), 32, 10, 39])) for _ in range(rng.randrange(50)))
    texts = [None, "", " ", "don't we'll 'so' x's''s 're", "a" * 700, " " * 400 + "x", "é" * 300, "　  \x1c\x85 x", *(mixed() for _ in range(400))]
    got = {r.doc_id: r for r in bpe.encode_documents(documents(spark, texts), path).collect()}
    for i, t in enumerate(texts):
        ids = other.encode_ordinary(t or "")
        assert got[i].ids == ids and got[i].n_tokens == len(ids)
        assert got[i].ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest() and got[i].decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()
    assert bpe.digest(documents(spark, texts).limit(0), path).count() == 0


def test_bpe_pieces_of_one_hash_keep_their_ids(monkeypatch):
    vocabulary = Path(public_tokenizers.path("byte_bpe_50k.tiktoken")).read_bytes()
    texts = [" international internationally internationale internationalism", "characterization characterized", " internationally" * 3, "\n", None, " international"]
    want = [bpe.Bpe(vocabulary).encode([t])[0].tolist() for t in texts]
    monkeypatch.setattr(bpe, "mix", lambda x: np.zeros(len(x), np.uint64))
    one = bpe.Bpe(vocabulary)
    for _ in range(2):
        assert [one.encode([t])[0].tolist() for t in texts] == want
    ids, bounds = one.encode(texts)
    assert [ids[a:b].tolist() for a, b in zip(bounds[:-1], bounds[1:], strict=True)] == want


def test_bpe_memory_starts_anew(monkeypatch):
    monkeypatch.setattr(bpe, "REMEMBER", 20)
    own = bpe.Bpe(Path(public_tokenizers.path("byte_bpe_50k.tiktoken")).read_bytes())
    texts = [f"word{i} other{i * 7}" for i in range(100)]
    whole = [own.decode(own.encode([t])[0]).decode() for t in texts]
    assert whole == texts and own.count <= 60


# ---- 10: chat


def brute_chat(turns):
    esc = lambda s: s.replace("&", "&amp;").replace("<", "&lt;")
    pieces = [f'<turn role="{esc(r).replace(chr(34), "&quot;")}">{esc(t)}</turn>\n' for r, t in turns]
    ends = [i for i, (r, _) in enumerate(turns) if r == "assistant" or i == len(turns) - 1]
    loss = "".join(t for r, t in turns if r == "assistant")
    said = "".join(f"{r}\n{t}\n" for r, t in turns)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return len(turns), sha(said), len(loss), sha(loss), sum(len("".join(pieces[: i + 1])) for i in ends)


def test_chat_examples(spark):
    convs = {
        1: [("system", "s & <b>"), ("user", None), ("assistant", "</turn>\n<turn role=\"user\">x"), ("user", "é"), ("assistant", "&lt; \\ ok")], 2: [("user", "only")], 3: [("assistant", "")], 4: [("assistant", "a"), ("assistant", "a")], 5: [(None, "x"), ("a\"b", "y")],
    }
    rows_ = [(c, t, r, x, "w") for c, turns in convs.items() for t, (r, x) in enumerate(turns)]
    random.Random(17).shuffle(rows_)
    table = spark.createDataFrame(rows_, "conv_id long, turn long, role string, text string, turns string")
    got = {r[0]: tuple(r)[1:] for r in chat.digest(table).collect()}
    convs[-7] = [("user", chat.PROBE_TEXT), ("assistant", chat.PROBE_TEXT)]
    assert got == {c: brute_chat([(r or "", x or "") for r, x in turns]) for c, turns in convs.items()}
    examples = chat.expand(table).filter("conv_id = 1").orderBy("upto").collect()
    assert [e.upto for e in examples] == [2, 4] and examples[1].text.startswith(examples[0].text)
    assert examples[1].text[examples[1].loss_start :][: examples[1].loss_chars] == "&amp;lt; \\ ok"
    assert [r.conv_id for r in chat.digest(table.limit(0)).collect()] == [-7]
    plan = chat.digest(table)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


# ---- regular texts that equal sums modulo a power of two


def thue_morse(n):
    s, flip = "a", str.maketrans("ab", "ba")
    while len(s) < n:
        s += s.translate(flip)
    return s, s.translate(flip)


def test_regular_words_differ(spark):
    """Two words whose polynomial sums modulo 2**64 are equal are two words in every operator that hashes words."""
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    for n in (64, 1024, 4096):
        a, b = thue_morse(n)
        texts = ["x" * 8 + a, "x" * 8 + b, a, b]
        assert len(set(find_words(*text_bytes(pa.array(texts))).hash.tolist())) == 4
        got = {r.doc_id: r.decoded_sha256 for r in bpe.digest(documents(spark, texts), path).collect()}
        assert got == {i: hashlib.sha256(t.encode()).hexdigest() for i, t in enumerate(texts)}
    rng = random.Random(40)
    left, right = prose(rng, 30), prose(rng, 30)
    texts = [f"{left} {a} {right}", f"{left} {b} {right}", f"{a} " * 7, f"{b} " * 7]
    assert rows(substring.digest(documents(spark, texts)), "doc_id", "n_words", "n_removed", "kept_sha256") == brute_substring(texts, 50)
    assert rows(near_dup.group_documents(documents(spark, texts), 0.85), "doc_id", "n_shingles", "component_id", "kept") == brute_groups(texts, 0.85)


# ---- rows without keys, bounds of samples, the shared folder


def test_chat_rows_without_conversation(spark):
    table = spark.createDataFrame([(None, 0, "user", "a"), (None, 0, "user", "a"), (None, 1, "assistant", "b"), (1, 0, "user", None)], "conv_id long, turn long, role string, text string")
    got = [tuple(r)[:2] for r in chat.digest(table).collect()]
    assert sorted(got, key=str) == sorted([(None, 1)] * 3 + [(1, 1), (-7, 2)], key=str)


def test_shards_of_rows_without_id(spark):
    docs = documents(spark, ["t"] * 300).withColumn("doc_id", F.when(F.col("doc_id") > 100, F.col("doc_id")))
    out = sharding.shard_documents(docs).collect()
    for s in range(16):
        assert sorted(r.slot for r in out if r.shard == s) == list(range(sum(r.shard == s for r in out)))
    assert len({r.shard for r in out if r.doc_id is None}) == 1 and len(out) == 300


def test_samples_are_bounded(spark):
    from quillspark.llm import sample

    docs = documents(spark, ["x" * (100 + i) for i in range(200)] + ["y" * 5000, None]).unionByName(documents(spark, ["z"], 3))
    labels = spark.createDataFrame([(i, i % 2) for i in range(300)], "doc_id long, toxic int")
    some = sample.sampled(labels, "toxic", 40)
    found = sample.fetch(docs.select("doc_id", "text"), some, max_text_bytes=1000, max_bytes=5000)
    assert 0 < len(found) <= 96 and found["text"].str.len().sum() <= 5000 and found["doc_id"].is_unique and found["text"].str.len().max() <= 1000
    assert list(sample.fetch(docs.select("doc_id", "text").limit(0), some)["doc_id"]) == []


def test_samples_of_a_hot_id(spark, monkeypatch):
    from quillspark.llm import sample

    docs = spark.range(100_000).select(F.lit(5).cast("long").alias("doc_id"), F.concat(F.lit("x" * 900), (F.col("id") % 7).cast("string")).alias("text"))
    docs = docs.unionByName(spark.range(40).select("id", F.concat(F.lit("y" * 100), F.col("id").cast("string")).alias("text")).toDF("doc_id", "text"))
    sent, plain = [], type(docs).toPandas
    monkeypatch.setattr(type(docs), "toPandas", lambda df: sent.append(plain(df)) or sent[-1])
    found = sample.fetch(docs, spark.createDataFrame([(i, 1) for i in range(40)] + [(5, 0)] * 10, "doc_id long, toxic int"), max_bytes=4500)
    assert sum(x["text"].str.len().sum() for x in sent if "text" in x) <= 4500 and max(map(len, sent)) <= 40
    assert found["doc_id"].is_unique and len(found) == 40 and found.loc[found["doc_id"] == 5, "text"].tolist() == ["y" * 100 + "5"]


def test_written_tables_can_be_discarded(spark):
    from quillspark.llm import frames

    before = len(frames.written)
    kept = frames.materialise(spark.range(3), "a")
    keep = len(frames.written)
    gone = frames.materialise(spark.range(4), "b")
    assert gone.count() == 4
    frames.discard(spark, frames.written[keep:])
    assert kept.count() == 3 and len(frames.written) == keep == before + 1


@pytest.mark.parametrize("learn", ["toxicity", "langid", "quality"])
def test_classifiers_of_empty_tables(spark, learn):
    docs, labels = documents(spark, ["a b c", None]), spark.createDataFrame([], "doc_id long, toxic int, quality int")
    for table in (docs, docs.limit(0)):
        if learn == "langid":
            assert langid.label_documents(table, langid.learn(table.withColumn("lang", F.lit(None).cast("string")))).count() == table.count()
        elif learn == "quality":
            assert quality.judge_documents(table, quality.learn(table, labels)).count() == table.count()
        else:
            assert toxicity.score_documents(table, toxicity.learn(table, labels)).count() == table.count()


# ---- decontamination by brute force


@pytest.mark.parametrize("n_items", [30, 400])
def test_leaks_equal_brute_force(n_items):
    """All passages against all items, every passage over the threshold verified; decoys and rows of common words among them."""
    import pandas as pd

    rng = random.Random(n_items)
    items = [prose(rng, rng.randint(1, 130), rng.choice(["ab", "abcd", "abcdefghijkl"])) for _ in range(n_items)]
    texts = [prose(rng, rng.randint(1, 150), rng.choice(["ab", "abcd", "abcdefghijkl"])) for _ in range(25)]
    for i in range(25):
        w = items[rng.randrange(n_items)].split()
        mixed = rng.sample(w, len(w))
        texts.append(" ".join([*mixed, *prose(rng, rng.randint(0, 90)).split(), *w[rng.randint(0, 3) :], *prose(rng, rng.randint(0, 40)).split()]))
    frame = pd.DataFrame({"item_id": range(n_items), "text": items})
    entries = decontaminate._entries(frame)
    df = Counter(t for e in entries for t in set(e[3].tolist()))
    mean, n = sum(len(e[3]) for e in entries) / len(entries), len(entries)
    weights = []
    for e in entries:
        tf = Counter(e[3].tolist())
        w = {t: max(np.log((n - df[t] + 0.5) / (df[t] + 0.5)), 0.01) * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * len(e[3]) / mean)) for t, f in tf.items()}
        total = sum(w.values())
        weights.append({t: x / total for t, x in w.items()})
    index = decontaminate.build_index(frame)
    data, offsets = text_bytes(pa.array(texts))
    words = find_words(data, offsets, lower=True, space=toxicity.NOT_WORD)
    for threshold, least in ((0.5, 0.6), (0.3, 0.2)):
        got = {(r, int(index.ids[i])) for r, i, *_ in decontaminate.find(index, data, offsets, threshold, least)}
        want, near = set(), set()
        for d in range(len(texts)):
            own = words.hash[words.first[d] : words.first[d + 1]]
            for at in range(0, max(1, len(own) - 32), 32):
                terms = set(own[at : at + 64].tolist())
                for e, w in zip(entries, weights, strict=True):
                    score = sum(x for t, x in w.items() if t in terms)
                    if score >= threshold - 1e-6:
                        size = len(e[1]) + len(e[2])
                        shares, whole = decontaminate.overlaps((e[1], e[2]), own[max(0, at - size) : min(len(own), at + 64) + size])
                        if min(shares) >= least and whole >= 2 * least / 3:
                            (want if score >= threshold + 1e-6 else near).add((d, e[0]))
        assert want <= got <= want | near and (want or n_items == 30)


# ---- quality: states of lines


def test_crf_marks_appended_boilerplate(spark):
    rng = random.Random(50)
    good = lambda: "\n".join(prose(rng, 15) + "." for _ in range(rng.randint(2, 7)))
    bad = lambda: "\n".join(" | ".join(prose(rng, 12).split()) for _ in range(rng.randint(2, 7)))
    texts, quality_of = zip(*((good(), 1) if i % 2 else (bad(), 0) for i in range(240)), strict=True)
    crf = quality.fit(list(texts), list(quality_of))
    for _ in range(30):
        parts = [(good(), 1), (bad(), 0)]
        rng.shuffle(parts)
        _, lines = quality.measure(*text_bytes(pa.array(["\n".join(t for t, _ in parts)])))
        want = [y for t, y in parts for _ in t.split("\n")]
        assert (quality.viterbi(crf, lines) == want).mean() > 0.9
    assert quality.fit([], []) is None and quality.fit(["a b c"] * 3, [1, 1, 0]) is None


def test_quality_without_labels_keeps_the_base_rules(spark):
    docs = documents(spark, ["one two three four five six seven eight nine ten eleven", "short", None])
    for labels in (spark.createDataFrame([], "doc_id long, quality int"), spark.createDataFrame([(0, 1)], "doc_id long, quality int")):
        crf = quality.learn(docs, labels)
        assert crf is None and rows(quality.judge_documents(docs, crf), "doc_id", "kept") == [(0, True), (1, False), (2, False)]
