"""Quantiles, splits, exploration and models against brute force on small tables."""

import math
import random

import numpy as np
import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from hirelake import rules
from hirelake.functions.text import title_plus_description
from hirelake.operators import explore, metrics, models, reports
from hirelake.operators.quantiles import exact_quantiles, ordered_bits
from hirelake.operators.split import exact_split, label_summary


@pytest.mark.parametrize("method, numpy_method", [("continuous", "linear"), ("midpoint", "hazen")])
def test_quantiles_with_a_hot_group(spark, method, numpy_method):
    rng = random.Random(1)
    rows = [("hot" if rng.random() < 0.6 else f"g{rng.randrange(5)}", round(rng.expovariate(0.01), 2))
            for _ in range(4000)] + [("one", 3.0), (None, 1.0), (None, 2.0)] + [("same", 5.0)] * 50
    df = spark.createDataFrame(rows, "g string, x double")
    got = {r.g: (r.q0, r.q1, r.q2, r.q3) for r in exact_quantiles(df, "x", [0.0, 0.25, 0.5, 0.9], ["g"], method).collect()}
    groups = {}
    for g, x in rows:
        groups.setdefault(g, []).append(x)
    for g, xs in groups.items():
        assert got[g] == pytest.approx(tuple(np.quantile(xs, [0, 0.25, 0.5, 0.9], method=numpy_method))), g


def test_box_stats_whiskers(spark):
    xs = [1.0, 2.0, 3.0, 4.0, 100.0]
    row = explore.box_stats(spark.createDataFrame([("a", x) for x in xs] + [("a", None)], "g string, x double"), "g", "x").first()
    assert (row.q1, row.median, row.q3, row.whisker_low, row.whisker_high, row.outliers, row.postings) == (2, 3, 4, 1, 4, 1, 5)


def test_histogram_of_equal_values_and_of_nothing(spark):
    df = spark.createDataFrame([(5.0,), (5.0,)], "x double")
    assert [(r.bin, r.postings) for r in explore.histogram(df, "x").collect()] == [(0, 2)]
    assert explore.histogram(df.limit(0), "x").count() == 0


def test_split_is_exact_repeatable_and_stratified(spark):
    rows = [(i, "hot" if i % 3 else f"c{i % 7}") for i in range(3001)] + [(9999, "single")]
    df = spark.createDataFrame(rows, "id long, c string").repartition(5)
    first = exact_split(df, "id", strata="c")
    sizes = {r.c: (r.n, r.t) for r in first.groupBy("c").agg(F.count("*").alias("n"), F.count_if("is_test").alias("t")).collect()}
    assert sum(t for _, t in sizes.values()) == math.ceil(0.2 * 3002)
    assert all(abs(t - n * 0.2) <= 1 for n, t in sizes.values()) and sum(n for n, _ in sizes.values()) == 3002
    tests = lambda d: {r.id for r in d.filter("is_test").collect()}
    assert tests(first) == tests(exact_split(df.repartition(3), "id", strata="c"))
    assert tests(first) != tests(exact_split(df, "id", seed=7, strata="c"))
    assert len(tests(exact_split(df, "id"))) == math.ceil(0.2 * 3002)
    assert tuple(label_summary(df, "c").first()) == (9, 1)


def test_facets_levels_and_search(spark):
    df = spark.createDataFrame([("a", 1, "Python (x)"), ("a", 2, None), ("b", 5, "java"), ("b", 6, "PYTHON"), (None, None, "")],
                               "c string, y int, t string")
    assert explore.apply_facets(df, {"c": "All"}).count() == 5 and explore.apply_facets(df, {"c": "a"}).count() == 2
    level = lambda name: explore.apply_facets(df, {}, name, "y").count()
    assert (level("entry"), level("mid"), level("senior"), level("All")) == (1, 2, 1, 5)
    assert explore.search(df, "PYTH.n", ["t"]).count() == 2 and explore.search(df, "", ["t"]).count() == 5
    assert [r.c for r in explore.facet_values(df, "c").orderBy("c").collect()] == ["a", "b"]
    with pytest.raises(ValueError):
        explore.apply_facets(df, {}, "boss", "y").count()


def test_kpis_of_nothing(spark):
    df = spark.createDataFrame([], "company_name string, salary_mid_usd double, is_remote string")
    assert tuple(explore.kpis(df).first()) == (0, 0, None, 0.0)


def test_ranks_fold_case_and_accents(spark):
    df = spark.createDataFrame([("E", "India", "Pune", 10.0), ("E", "india", "PUNE", 20.0), ("E", "India", "Goa", 15.0),
                                ("E", "India", "Kochi", 1.0), ("E", "India", "Kochi", None)], "c string, l string, p string, v double")
    got = {r.p.lower(): (r.posting_count, r.avg_value, r.salary_rank) for r in reports.dense_rank_by_average(
        df, ["c", "l", "p"], ["c", "l"], "v", "UNICODE_CI_AI").collect()}
    assert got == {"pune": (2, 15.0, 1), "goa": (1, 15.0, 1), "kochi": (1, 1.0, 2)}


def test_rolling_rows_do_not_fill_gaps(spark):
    days = [1, 2, 9, 10, 11, 20, 21, 28]
    df = spark.createDataFrame([("e", f"2026-01-{d:02d}") for d in days for _ in range(d % 3 + 1)], "c string, d string")
    got = reports.rolling_volume(df.withColumn("d", F.to_date("d")), "c", "d").orderBy("d").collect()
    daily = [d % 3 + 1 for d in days]
    for i, row in enumerate(got):
        frame = daily[max(0, i - 6): i + 1]
        assert (row.days_in_window, row.rolling_avg) == (len(frame), round(sum(frame) / len(frame), 2))


def test_text_features_match_the_formula(spark):
    texts = ["red apple red", "green apple", "the pear x", "Apple Pie apple pie"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")
    model = models.fit_text_features(df, "text", 50, ["the"])
    terms = model.stages[-3].vocabulary
    got = {r.i: dict(zip(terms, r.v)) for r in model.transform(df).select("i", vector_to_array("text_features").alias("v")).collect()}
    bags = [["red", "apple", "red", "red apple", "apple red"], ["green", "apple", "green apple"], ["pear"],
            ["apple", "pie", "apple", "pie", "apple pie", "pie apple", "apple pie"]]
    idf = {t: math.log(5 / (1 + sum(t in b for b in bags))) + 1 for t in terms}
    for i, bag in enumerate(bags):
        raw = {t: bag.count(t) * idf[t] for t in terms}
        norm = math.sqrt(sum(v * v for v in raw.values()))
        assert got[i] == pytest.approx({t: v / norm for t, v in raw.items()})
    with pytest.raises(ValueError):
        models.fit_text_features(df.limit(0), "text")


def test_unknown_text_is_encoded_as_zeros(spark):
    from pyspark.ml import Pipeline

    df = spark.createDataFrame([("a", "x", "r", 1.0, None, 1), ("b", "x", "r", None, 3.0, 0), ("a", None, "s", 5.0, 9.0, 0)],
                               "job_category string, country string, is_remote string, experience_min double, experience_max double, flag_0 int")
    fill = models.fit_fill_values(df)
    assert fill == {"experience_min": 3.0, "experience_max": 6.0, "job_category": "a", "country": "x", "is_remote": "r"}
    model = Pipeline(stages=models.salary_stages(fill, ["flag_0"])).fit(df)
    odd = spark.createDataFrame([("zz", "x", "r", 3.0, 6.0, 1)], df.schema)
    v = model.transform(odd).select(vector_to_array("salary_features").alias("v")).first().v
    assert v[:2] == pytest.approx([0.0, 0.0]) and v[2:4] == [0.0, 0.0] and v[4:] == [1.0, 1.0, 0.0, 1.0]


def _postings(spark):
    rows = [(i, ["Data Engineer etl", "Web Developer react"][i % 2], f"text {['etl spark', 'react css'][i % 2]} {i}",
             ["Data Engineer", "Software Engineer"][i % 2], "India", "Remote", float(i % 5) if i % 4 else None, None,
             1000.0 + 500 * (i % 2)) for i in range(80)]
    return spark.createDataFrame(rows, "job_id long, title string, description string, job_category string, country string, "
                                 "is_remote string, experience_min double, experience_max double, salary_mid_usd double")


def test_models_learn_score_save_and_load(spark, tmp_path):
    postings = _postings(spark)
    links = postings.select("job_id", F.when(F.col("job_id") % 2 == 0, "Node.js").otherwise("CSS").alias("skill_name"))
    category, tested = models.fit_category(postings, trees=5, depth=5)
    assert tested.count() == 16 and metrics.accuracy(tested, "job_category").first().accuracy > 0.9
    model, terms, checked = models.fit_salary(postings, links, trees=5, depth=5)
    assert terms == ["CSS", "Node.js"] and metrics.regression_report(checked).first().mae < 100
    assert models.load_models(spark, str(tmp_path)) == (None, None)
    models.save_models(spark, str(tmp_path), category, (model, terms))
    category, (model, terms) = models.load_models(spark, str(tmp_path))
    request = spark.createDataFrame([("Web Developer", "react and css", "UK", "Remote", 1.0, 2.0)],
                                    "title string, description string, country string, is_remote string, experience_min double, experience_max double")
    scored = models.score_category(category, request).withColumnRenamed("predicted_category", "job_category")
    row = models.score_salary(model, terms, scored).first()
    assert row.job_category == "Software Engineer" and row.salary_low == pytest.approx(row.predicted_salary * 0.85)
    assert row.salary_high == pytest.approx(row.predicted_salary * 1.15) and 1000 <= row.predicted_salary <= 1500
    assert models.fit_salary(postings.withColumn("salary_mid_usd", F.lit(0.0)), links) is None


def test_class_report_with_a_class_never_predicted(spark):
    df = spark.createDataFrame([("a", "a"), ("a", "b"), ("b", "b"), ("c", "b")], "label string, prediction string")
    got = {r["class"]: (round(r.precision, 4), round(r.recall, 4), round(r.f1, 4), r.support) for r in metrics.class_report(df).collect()}
    assert got["a"] == (1.0, 0.5, 0.6667, 2) and got["c"] == (0.0, 0.0, 0.0, 1) and got["b"] == (0.3333, 1.0, 0.5, 1)
    assert got["macro avg"] == (0.4444, 0.5, 0.3889, 4) and got["weighted avg"] == (0.5833, 0.5, 0.4583, 4)


def test_split_is_the_same_however_narrow_the_ranked_rest(spark):
    rows = spark.range(3000).select(F.col("id"), (F.col("id") % 3 == 0).cast("string").alias("label"))
    for strata in (None, "label"):
        wide = exact_split(rows, "id", 0.2, 1, strata)
        narrow = exact_split(rows, "id", 0.2, 1, strata, most=0)
        assert narrow.filter("is_test").count() == 600
        assert wide.exceptAll(narrow).isEmpty()


def test_scores_without_models(spark):
    request = spark.createDataFrame([("t", "d")], "title string, description string")
    row = models.score_postings(None, None, request).first()
    assert row["job_category"] == "Other" and row["predicted_salary"] is None and row["salary_low"] is None


def test_ordered_bits_are_those_of_the_double(spark):
    import struct

    rnd = random.Random(8)
    values = [0.0, -0.0, 1.0, 2.0, 0.5, -1.0, 5e-324, 2.2250738585072014e-308, 2.225073858507201e-308, 1.7976931348623157e308, float("inf"), float("-inf")]
    values += [float(np.nextafter(2.0 ** e, side)) for e in (-1022, -3, 0, 1, 10, 52, 1000, 1023) for side in (0, math.inf)]
    values += [struct.unpack("<d", struct.pack("<q", rnd.getrandbits(63)))[0] * rnd.choice((1, -1)) for _ in range(500)]
    values = [v for v in values if v == v]
    df = spark.createDataFrame([(v,) for v in values], "x double").select("x", ordered_bits("x").alias("b"))
    for x, b in df.collect():
        bits = struct.unpack("<q", struct.pack("<d", abs(x)))[0]
        assert b == (-bits if x < 0 else bits), x
    assert spark.createDataFrame([(float("nan"),)], "x double").select(ordered_bits("x")).first()[0] == 2 ** 63 - 1


def test_selection_ranks_a_bounded_rest(spark):
    """Ten times the rows, the same bound: with ``most`` at 50 every pass is used, and results stay exact."""
    for times in (1, 10):
        rows = spark.range(3000 * times).selectExpr(
            "cast(id % 3 AS string) AS g", "CASE WHEN id % 3 = 0 THEN 7.25D WHEN id % 3 = 1 THEN sin(id) * pow(10D, id % 600 - 300) ELSE 1D + id * 1e-14D END AS x")
        table = rows.toPandas()
        got = {r["g"]: r for r in exact_quantiles(rows, "x", [0.0, 0.3, 0.5, 1.0], ["g"], most=50).collect()}
        for g, own in table.groupby("g"):
            assert list(got[g][1:]) == [pytest.approx(q, rel=1e-12) for q in np.quantile(own["x"].to_numpy(), [0.0, 0.3, 0.5, 1.0])]


def test_vocabulary_of_words_and_pairs(spark):
    rnd = random.Random(6)
    texts = [[rnd.choice("abcdefgh") if rnd.random() < 0.7 else f"w{rnd.randrange(300)}" for _ in range(rnd.randrange(40))] for _ in range(120)]
    counts = {}
    for words in texts:
        for term in [*words, *(f"{x} {y}" for x, y in zip(words, words[1:]))]:
            counts[term] = counts.get(term, 0) + 1
    df = spark.createDataFrame([(t,) for t in texts] + [(None,)], "words array<string>")
    for size in (1, 5, 9, 40, 150, 100_000):
        want = sorted(counts.items(), key=lambda c: (-c[1], c[0]))[:size]
        assert [tuple(r) for r in models.vocabulary(df, "words", size).collect()] == want
    assert models.vocabulary(df.limit(0), "words", 5).count() == 0


def test_a_large_forest_is_fitted_in_parts(spark, tmp_path):
    postings = _postings(spark)
    links = postings.select("job_id", F.when(F.col("job_id") % 2 == 0, "Node.js").otherwise("CSS").alias("skill_name"))
    model, terms, checked = models.fit_salary(postings, links, trees=models.TREES_AT_ONCE * 2 + 3, depth=3)
    forests = [stage for stage in model.stages if hasattr(stage, "getNumTrees")]
    assert [forest.getNumTrees for forest in forests] == [models.TREES_AT_ONCE, models.TREES_AT_ONCE, 3]
    rows = model.transform(postings.withColumns({"flag_0": F.lit(1), "flag_1": F.lit(0)})).collect()
    for row in rows[:10]:
        trees = [tree.predict(row["salary_features"]) for forest in forests for tree in forest.trees]
        assert len(trees) == models.TREES_AT_ONCE * 2 + 3 and row["prediction"] == pytest.approx(np.mean(trees))
    assert metrics.regression_report(checked).first().mae < 100
    models.save_models(spark, str(tmp_path), salary=(model, terms))
    again = models.load_models(spark, str(tmp_path))[1][0]
    assert again.transform(postings.withColumns({"flag_0": F.lit(1), "flag_1": F.lit(0)})).select("prediction").collect() == [(r["prediction"],) for r in rows]


def test_texts_are_taken_apart_once(spark, monkeypatch):
    """The words of a text are found in one pass that is written, not again for each step of the fit."""
    written = []
    plain = models.settle
    monkeypatch.setattr(models, "settle", lambda df, label: (written.append(label), plain(df, label))[1])
    read = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def seen(text):
        read.add(1)
        return text

    texts = ["red apple red", "green apple", "the pear x", "Apple Pie apple pie"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")
    counted = df.select("i", seen.asNondeterministic()("text").alias("text"))
    model, features = models.text_features(counted, "text", 50, ["the"], ["i"])
    again = model.transform(df).select("i", "text_features")
    assert features.orderBy("i").collect() == again.orderBy("i").collect()
    assert read.value == len(texts) and {"tokens", "term-counts"} <= set(written)


def test_flags_of_terms_equal_their_patterns(spark):
    words = ["Go", "GO!", "ſql", "\u212aotlin", "Saß", "SASS", "AGİLE", "agıle", "Agile", "İ", "power", "BI", "node.js", "C#x", "C#", "r", "R2", ".NET", "ASP.NET", "problem", "solving"]
    rng = random.Random(5)
    texts = [tuple(rng.choice((" ", "/", ", ")).join(rng.choice(words) for _ in range(rng.randint(0, 5))) for _ in range(2)) for _ in range(300)]
    df = spark.createDataFrame([(i, *pair) for i, pair in enumerate([*texts, (None, "Go"), ("Go", None)])], "id int, title string, description string")
    terms = ["Go", "SQL", "Kotlin", "sass", "Agile", "Power BI", "Node.js", "C#", "R", ".NET", "Problem Solving"]
    names = [f"f{i}" for i in range(len(terms))]
    text = title_plus_description("title", "description")
    wanted = df.select("*", *[F.coalesce(text.rlike(rules.whole_word(t)), F.lit(False)).cast("int").alias(n) for t, n in zip(terms, names)])
    got = models.term_flags(df, terms, names)
    assert got.columns == wanted.columns and sorted(got.collect(), key=lambda r: r.id) == sorted(wanted.collect(), key=lambda r: r.id)
    assert all(got.agg(F.max(n)).first()[0] == 1 for n in names)
    assert models.term_flags(df, [], []).columns == df.columns
