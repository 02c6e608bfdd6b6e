import random
import zlib

import numpy as np
import pyarrow as pa

from siltstone.llm import queries, toxicity


def brute_ngrams(text):
    out, word = 0, f" {' '.join((text or '').lower().split())} ".encode()
    for w in toxicity.WIDTHS:
        out += sum(b" " not in word[i + 1 : i + w - 1] for i in range(len(word) - w + 1))
    return out


def test_ngrams_stay_in_their_word_and_text():
    texts = ["Ab cdefgh", None, "", "é x", "abc", "abc"]
    (_, _, codes, first), *rest = toxicity.ngram_buckets(pa.array(texts))
    assert not rest and np.diff(first).tolist() == [brute_ngrams(t) for t in texts]
    assert codes[first[4] : first[5]].tolist() == codes[first[5] : first[6]].tolist()


def make(rnd, bad, n):
    words = ["".join(rnd.choice("aeioulnrst") for _ in range(rnd.randint(2, 8))) for _ in range(n)]
    for _ in range(bad):
        words[rnd.randrange(n)] = "zarkwug" + "".join(rnd.choice("aeioulnrst") for _ in range(2))
    return " ".join(words)


def test_op4_learns_unseen_spellings_and_scores_odd_texts(spark, tmp_path):
    rnd = random.Random(1)
    rows = [(i, make(rnd, 3 if i % 2 else 0, 60), "en") for i in range(600)]
    rows += [(600, None, "en"), (601, "", "en"), (602, "x " * 60000, "en"), (None, "a", None), (0, rows[0][1], "en")]
    spark.createDataFrame(rows, "doc_id long, text string, score string").write.parquet(f"{tmp_path}/documents.parquet")
    labels = [(i, 1, i % 2) for i in range(600)] + [(None, 1, 1), (5, None, None)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = queries.op4_toxicity(spark, str(tmp_path)).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    held = [r for r in got if r.held_out and r.doc_id < 600]
    assert np.mean([r.predicted == r.doc_id % 2 for r in held]) > 0.95


def test_one_class_or_no_rows(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert toxicity.toxicity(docs, none).first().score == 0.5
    assert toxicity.toxicity(docs.where("false"), none).count() == 0
    clean = toxicity.train(["a b", "c"], np.array([0, 0]))
    assert clean.offset < -5


def test_a_text_that_does_not_fit_does_not_end_the_sample(spark):
    for long in range(6):
        docs = spark.createDataFrame([(i, "x" * (500 if i == long else 10)) for i in range(6)], "doc_id long, text string")
        labels = spark.createDataFrame([(i, i % 2) for i in range(6)], "doc_id long, toxic int")
        texts, ys = toxicity.training_sample(docs, labels, max_bytes=100)
        assert texts == ["x" * 10] * 5 and sorted(ys.tolist()) == sorted(i % 2 for i in range(6) if i != long)


def brute_score(text, model):
    """The mean of the n-grams' weights, n-gram by n-gram, with the bucket hash written out on whole numbers."""
    top, total, n = (1 << 64) - 1, 0.0, 0
    weight = model.weight.astype(np.float32)
    for word in (text or "").lower().encode().split():
        framed = b" " + word + b" "
        for w in toxicity.WIDTHS:
            for i in range(len(framed) - w + 1):
                code = 0
                for byte in framed[i : i + w]:
                    code = (code * 0x100000001B3 + byte + 1) & top
                x = (code + w) & top
                x = ((x ^ x >> 30) * 0xBF58476D1CE4E5B9) & top
                x = ((x ^ x >> 27) * 0x94D049BB133111EB) & top
                total += float(weight[(x ^ x >> 31) % toxicity.BUCKETS])
                n += 1
    return 1 / (1 + np.exp(-(total / max(1, n) + model.offset)))


def test_scores_against_brute_force(spark):
    rnd = random.Random(2)
    texts = [make(rnd, 3 if i % 2 else 0, 30) for i in range(200)]
    model = toxicity.train(texts, np.arange(200) % 2)
    odd = [None, "", " \n ", "Été ÉTÉ\tx", "a", "don't " * 400, texts[0], texts[1]]
    docs = spark.createDataFrame(list(enumerate(odd)), "doc_id long, text string")
    got = {r.doc_id: r.score for r in toxicity.score(docs, model).collect()}
    for i, t in enumerate(odd):
        assert abs(got[i] - brute_score(t, model)) < 1e-5
    assert got[6] < 0.5 < got[7]


def test_the_sample_of_repeated_and_contradicting_labels(spark):
    docs = spark.createDataFrame([(1, "a"), (1, "a"), (1, "bb"), (2, "c"), (3, None), (None, "d"), (4, "y" * 200)], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 0), (1, 0), (1, 1), (2, 1), (3, 1), (None, 1), (4, 0), (5, 1)], "doc_id long, toxic int")
    texts, ys = toxicity.training_sample(docs, labels, max_bytes=100)
    assert sorted(zip(texts, ys.tolist(), strict=True)) == [("a", 0), ("a", 1), ("bb", 0), ("bb", 1), ("c", 1)]
