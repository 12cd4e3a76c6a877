"""Synthetic labelled pairs, their perturbations, and linking of a stream."""

import json

from pyspark.sql import functions as F

from gridlink.functions import perturb
from gridlink.operators.resolve import best_matches, get_scorer, matches, scored_pairs
from gridlink.sources import corpus
from gridlink.streaming import link


def test_corpus_sizes_labels_and_roles(spark):
    rows = corpus.generate(spark, (1, 2)).collect()
    assert len(rows) == 720 and len({r.pair_id for r in rows}) == 720
    for seed in (1, 2):
        own = [r for r in rows if r.seed == seed]
        assert sum(r.label for r in own) == 180
        assert [sum(r.role == x for r in own) for x in corpus.ROLES] == [180, 86, 94]
        assert {r.category for r in own} == set(corpus.FAMILIES)
        assert len({r.left_name for r in own}) == 360
    alias = [r for r in rows if r.category == "semantic alias"]
    assert all(not set(r.left_name.split()) & set(r.right_name.split()) for r in alias)
    assert all(r.left_name != r.right_name for r in rows if r.category != "exact")


def test_corpus_is_a_function_of_the_seed(spark):
    one, two = (sorted(map(tuple, corpus.generate(spark, s).where("seed = 3").collect())) for s in ((3,), (1, 3)))
    assert one == two and len(one) == 360
    assert corpus.problems(corpus.generate(spark, (3,))).count() == 0


def test_perturbations(spark):
    df = spark.createDataFrame([("Café Île Limited",), (None,), ("",)], "name string")
    n = F.col("name")
    got = df.select(perturb.word_order(n).alias("o"), perturb.abbreviate(n).alias("a"), perturb.transliterate(n).alias("t"), perturb.noise(n).alias("x")).collect()
    assert tuple(got[0]) == ("Limited Île Café", "Café Île Ltd", "Cafe Ile Limited", "Dagé Îlf Miniuee")
    assert tuple(got[1]) == (None, None, None, None)


def test_problems_are_found(spark):
    rows = [("a", "sealed test", 1), ("a", "sealed test", 1), ("b", "other", 0), ("c", None, 0), ("d", "calibration", 2)]
    found = corpus.problems(spark.createDataFrame(rows, "pair_id string, role string, label int"))
    assert sorted(r.pair_id for r in found.collect()) == ["a", "b", "c", "d"]


def test_stream_links_equal_batch_links(spark, tmp_path):
    row = {"side": "left", "source": "s", "fields": {}}
    left = [{**row, "ordinal": i, "name": name, "latitude": lat, "longitude": 0.0} for i, (name, lat) in enumerate([("Acme Trading", 0.0), ("Other Name", 0.0), ("Acme Trading", None), (None, 0.0)])]
    (tmp_path / "in").mkdir()
    for r in left:
        (tmp_path / "in" / f"{r['ordinal']}.json").write_text(json.dumps(r))
    stored = spark.createDataFrame([("right", "t", 0, "Trading Acme", 0.001, 0.0, {}), ("right", "t", 1, "Acme", 5.0, 5.0, {})], link.SCHEMA)
    scorer, stream = get_scorer("overlap"), spark.readStream.schema(link.SCHEMA).option("maxFilesPerTrigger", 2).json(str(tmp_path / "in"))
    query = link.links(stream, stored, scorer, 0.5).select("l.ordinal", "score").writeStream.format("memory").queryName("links").outputMode("append").option("checkpointLocation", str(tmp_path / "c1")).start()
    query.processAllAvailable()
    query.stop()
    scored = scored_pairs(spark.createDataFrame([tuple(r[c] for c in ("side", "source", "ordinal", "name", "latitude", "longitude", "fields")) for r in left], link.SCHEMA), stored, scorer)
    expected = sorted(r.ordinal for r in scored.where(matches(F.col("score"), 0.5)).select("l.ordinal").collect())
    assert sorted(r.ordinal for r in spark.table("links").collect()) == expected == [0]
    seen: list[int] = []
    query = link.best_links(stream, stored, scorer, 0.5, lambda df, n: seen.extend(r.ordinal for r in df.select("l.ordinal").collect()), str(tmp_path / "c2"))
    query.processAllAvailable()
    query.stop()
    assert seen == [r.ordinal for r in best_matches(scored, 0.5).select("l.ordinal").collect()]


def test_published_pairs_give_the_published_accuracy(spark):
    from gridlink.plans import records
    from gridlink.sources import published

    rows = published.generate(spark, (1, 2)).collect()
    assert len(rows) == 720 and len({r["pair_id"] for r in rows}) == 720 and corpus.problems(published.generate(spark)).count() == 0
    assert sorted(map(tuple, rows)) == sorted(x for s in (2, 1) for x in published.draw(s))
    assert {(r["category"], r["label"]) for r in rows} == {(f.name, f.label) for f in published.FAMILIES}
    got = {r["arm"]: (r["threshold"], r["f1"]) for r in records.published_accuracy(spark, "").collect()}
    assert got == {"overlap": (0.5, 0.7207207207), "fuzzy": (0.9333333333, 0.8863636364)}


def test_case_mixture_and_coverage(spark):
    pairs = spark.createDataFrame([("a", "x", 1), ("b", "x", 2), ("b", "y", 2)], "pair_id string, category string, seed int")
    assert {r["category"]: (r["n"], r["seeds"]) for r in corpus.case_mixture(pairs).collect()} == {"x": (2, [1, 2]), "y": (1, [2])}
    assert [tuple(r) for r in corpus.repeated_ids(pairs).collect()] == [("b", 2)]
    roles = spark.createDataFrame([("b",), ("c",)], "pair_id string")
    assert sorted(tuple(r) for r in corpus.coverage(pairs, roles).collect()) == [("a", "missing"), ("c", "extra")]
