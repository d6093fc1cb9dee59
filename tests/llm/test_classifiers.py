"""Held-out accuracy of the classifiers, their defined results on odd input, and the pipeline's stages."""

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from poolgrade.llm import bpe, decontam, langid, quality_knn, queries, samples, simhash, toxicity
from poolgrade.llm.frames import remainder, written

from . import brute

FOLDER = "/root/testdata/sf0.01"
LARGE = "/root/testdata/sf0.1"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LABELS = "doc_id long, quality int, toxic int"


def truth(spark, folder, column):
    name = "documents" if column == "lang" else "labels"
    return queries.table(spark, folder, name).select("doc_id", F.col(column).alias("truth"))


def test_languages_held_out(spark):
    got = queries.op6_language_id(spark, FOLDER).join(truth(spark, FOLDER, "lang"), "doc_id").where("held_out")
    rows = got.collect()
    assert len(rows) > 150 and all(0 <= r["score"] <= 1 for r in rows)
    assert sum(r["lang_pred"] == r["truth"] for r in rows) / len(rows) > 0.97


def test_languages_of_odd_texts(spark):
    docs = queries.table(spark, FOLDER, "documents")
    model = langid.fit(docs)
    odd = spark.createDataFrame(
        [(1, None, "x"), (2, "", "x"), (3, "123 ...", "x"), (4, "ß", None), (5, "the and of " * 50000, None), (5, "the and of", "y")],
        "doc_id long, text string, LANGUAGE string",
    )
    got = [(r["doc_id"], *r["language"]) for r in langid.identified(odd, model).collect()]
    assert [g[1] for g in got[:3]] == ["und"] * 3 and [g[2] for g in got[:3]] == [0.0] * 3
    assert got[3][1] != "und" and got[4][1:] == pytest.approx(got[5][1:], abs=0.2) or got[4][1] == got[5][1] == "en"
    assert langid.fit(docs.limit(0)) is None
    assert {r["language"]["lang_pred"] for r in langid.identified(odd, None).collect()} == {"und"}


def test_family_comes_first(spark):
    model = langid.fit(queries.table(spark, FOLDER, "documents"))
    assert model.families.classes == ["germanic", "romance"]
    assert {f: d.classes for f, d in model.within.items()} == {"germanic": ["de", "en"], "romance": ["es", "fr"]}
    assert all(len(d.machines) == 1 for d in [model.families, *model.within.values()])


def rates(rows):
    hits = [r["predicted"] for r in rows if r["truth"] == 1]
    false = [r["predicted"] for r in rows if r["truth"] == 0]
    return sum(hits) / len(hits), sum(false) / len(false)


def test_toxicity_held_out(spark):
    rows = queries.op7_toxicity(spark, LARGE).join(truth(spark, LARGE, "toxic"), "doc_id").where("held_out").collect()
    recall, false = rates(rows)
    assert recall > 0.88 and false < 0.03 and all(0 <= r["score"] <= 1 for r in rows)


def test_machine_learns_what_single_terms_cannot(spark):
    """Two terms that are harmless alone and toxic together."""
    rows = []
    for n in range(1600):
        a, b = n % 2, n // 2 % 2
        rows.append((n, " ".join(["quiet"] + ["grumble"] * a + ["villagers"] * b + [f"w{n % 7}"]), int(a and b)))
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, toxic int")
    machine = toxicity.fit(docs, labels, F.lit(True))
    asked = spark.createDataFrame([(1, "grumble"), (2, "villagers"), (3, "Grumble, VILLAGERS!"), (4, None), (5, ""), (6, "grumble villagers " * 9000)], "doc_id long, text string")
    score = {r["doc_id"]: r["toxicity"]["score"] for r in toxicity.scored(asked, machine).collect()}
    assert score[3] > 0.7 and score[6] > 0.7 and max(score[1], score[2]) < 0.3 and score[4] == score[5] < 0.3


def test_quality_held_out(spark):
    rows = queries.op8_quality_neighbours(spark, LARGE).join(truth(spark, LARGE, "quality"), "doc_id").where("held_out").collect()
    recall, false = rates(rows)
    assert recall > 0.97 and false < 0.05 and all(0 <= r["score"] <= 1 for r in rows)


def test_classifiers_without_labels(spark):
    docs = spark.createDataFrame([(1, "a text", "x"), (1, "a text", "x"), (None, None, None)], "doc_id long, text string, score string")
    labels = spark.createDataFrame([], LABELS)
    assert toxicity.fit(docs, labels, F.lit(True)) is None and quality_knn.fit(docs, labels, F.lit(True)) is None
    assert [r["toxicity"]["score"] for r in toxicity.scored(docs, None).collect()] == [0.0] * 3
    assert [r["quality"]["score"] for r in quality_knn.scored(docs, None).collect()] == [0.5] * 3
    some = spark.createDataFrame([(1, 1, 0), (1, 0, None), (None, 1, 1), (7, None, 1)], LABELS)
    voters = quality_knn.fit(docs, some, F.lit(True))
    assert voters.prior == 1.0  # of repeated labels the greatest counts
    assert [r["quality"]["score"] for r in quality_knn.scored(docs.limit(0), voters).collect()] == []


def test_samples_repeat_and_keep_to_their_size(spark):
    rows = spark.range(20000).withColumn("kind", F.when(F.col("id") % 100 == 0, "rare").otherwise("common"))
    first = samples.sampled(rows, F.col("id"), 500, by="kind")
    again = samples.sampled(rows.repartition(7), F.col("id"), 500, by="kind")
    assert sorted(first.collect()) == sorted(again.collect())
    counts = {r["kind"]: r["count"] for r in first.groupBy("kind").count().collect()}
    assert counts["rare"] == 200 and 400 < counts["common"] < 600


def test_quality_reads_long_words_whole():
    """Words of more than 64 characters count as pieces; shorter ones as before."""
    head = "a" * 64
    texts = pa.array([head, head + "9-" * 32, head + "9-" * 32 + "A." * 500, "b c", None])
    counts = quality_knn.term_counts(texts)
    assert [int(c.sum()) for c in counts] == [1, 3, 35, 3, 0]
    assert not (counts[0] == counts[1]).all() and (counts[3] == quality_knn.term_counts(pa.array(["x y"]))[0]).all()


# ------------------------------------------------------------------------------------ pipeline


def test_stages_one_by_one(spark):
    docs = queries.table(spark, FOLDER, "documents")
    names = docs.columns
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        before = {r["doc_id"]: r["text"] for r in docs.collect()}
        docs = written(stage(spark, docs, FOLDER), name)
        kept[name] = {r["doc_id"] for r in docs.collect()}
        assert kept[name] <= set(before) and docs.count() == len(kept[name])
        if name != "encode":
            assert docs.columns == names
        if name == "near_duplicates":
            prints = {k: brute.fingerprint(t) for k, t in before.items()}
            assert kept[name] == set(brute.groups(prints).values())
        if name == "decontamination":
            items = [(r["item_id"], r["text"]) for r in queries.table(spark, FOLDER, "benchmark").collect()]
            hits = brute.contamination(before.items(), items)
            assert kept[name] == {k for k, v in hits.items() if not v[-1]}
        if name == "encode":
            got = {r["doc_id"]: r["n_tokens"] for r in docs.collect()}
            path = public_tokenizers.path(queries.VOCABULARY)
            assert got == {k: len(bpe.encode(t, path)) // 4 for k, t in before.items()}


def test_pipeline_on_odd_documents(spark, tmp_path):
    rows = [(n, r["text"], r["lang"], r["source"], 1) for n, r in enumerate(queries.table(spark, "/root/testdata/sf0.001", "documents").collect())]
    rows += [rows[3], rows[3], (900, None, None, None, None), (901, "", "en", "s", 0), (None, rows[5][1], "en", "s", 1), (902, "word " * 40000, "en", "s", 2)]
    docs = spark.createDataFrame([(*r, "x", "y", 1) for r in rows], DOCS + ", Language string, hits string, nth int")
    docs.write.parquet(f"file://{tmp_path}/documents.parquet")
    for name in ("labels", "benchmark"):
        queries.table(spark, "/root/testdata/sf0.001", name).write.parquet(f"file://{tmp_path}/{name}.parquet")
    now = spark.read.parquet(f"file://{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        now = written(stage(spark, now, f"file://{tmp_path}"), name)
        assert now.columns == docs.columns
    ids = [r["doc_id"] for r in now.select("doc_id").collect()]
    assert ids.count(3) <= 1 and not {900, 901} & set(ids)


def test_pipeline_on_empty_tables(spark, tmp_path):
    for name, schema in (("documents", DOCS), ("labels", LABELS), ("benchmark", "item_id long, text string")):
        spark.createDataFrame([], schema).write.parquet(f"file://{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, f"file://{tmp_path}").count() == 0
    for name in ("op2_bpe_transducer", "op3_repetition_rules", "op5_token_planes", "op6_language_id", "op7_toxicity",
                 "op8_quality_neighbours", "op9_simhash_components", "op10_decontamination"):
        assert queries.QUERIES[name](spark, f"file://{tmp_path}").count() == 0


def test_votes_against_all_cosines_with_ties():
    draw = np.random.default_rng(3)
    counts = draw.integers(0, 4, (60, quality_knn.TERMS))
    counts[30:] = counts[:30]  # every voter twice, with labels of their own
    labels = draw.integers(0, 2, 60).astype(float)
    voters = quality_knn.Voters(counts, labels, (counts > 0).sum(axis=0).astype(float), 60)
    texts = pa.array(["Some words, and more of them. " * 3, "x" * 70_000 + " y", "", "12 34 ab! " * 9])
    got = voters.score(texts)[0]
    for text, score in zip(texts.to_pylist(), got):
        own = quality_knn.term_counts(pa.array([text]))
        if not own.any():
            assert score == pytest.approx(labels.mean())
            continue
        cosines = (voters.latent(own) @ voters.vectors.T)[0]
        last = sorted(cosines)[-quality_knn.NEAREST]
        weight = [np.exp((c - 1) / quality_knn.WIDTH) if c >= last else 0.0 for c in cosines]
        assert score == pytest.approx(sum(w * y for w, y in zip(weight, labels)) / sum(weight), abs=1e-4)


def test_a_term_counts_as_often_in_the_fit_as_in_scoring(spark):
    text = "ab " * 70_000
    docs = spark.createDataFrame([(1, text), (2, "Other words. " * 5)], "doc_id long, text string")
    voters = quality_knn.fit(docs, spark.createDataFrame([(1, 1, 0), (2, 0, 0)], LABELS), F.lit(True))
    own = voters.latent(quality_knn.term_counts(pa.array([text])))
    assert float((own @ voters.vectors.T).max()) == pytest.approx(1.0, abs=1e-5)


def test_blanks_beside_each_other_make_no_word():
    one, two = (quality_knn.term_counts(pa.array([t]))[0].tolist() for t in ("Ab cd. 12 ef", " Ab  cd.\n\n12 \t ef "))
    assert one == two
    assert quality_knn.term_counts(pa.array(["", "  ", None, "a"])).any(axis=1).tolist() == [False, False, False, True]
