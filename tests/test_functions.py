"""Row functions on literal inputs."""

import random

import pytest
from pyspark.sql import functions as F

from hirelake import rules
from hirelake.functions import display, enrich
from hirelake.functions.text import amounts_in_text, parse_amounts, split_place, strip, text_of, title_plus_description
from hirelake.operators.transform import country_of, evaluate, resolve_salary, tag_terms, whole_years
from hirelake.rules import Term
from hirelake.sources.lake import record_fields


def values(spark, inputs, make, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(inputs)], f"i int, v {kind}")
    return [row["r"] for row in df.select("i", make("v").alias("r")).orderBy("i").collect()]


def test_years_range(spark):
    cases = {
        "3 - 6 years": (3, 6), "3–6 yrs": (3, 6), "3—6 yr": (3, 6), "2 to 5 Years": (2, 5), "5+ years": (5, 9),
        "Experience: 4": (4, 4), "Experience 2024": (2024, 2024), "exp level - 2.5 years": (2.5, 2.5),
        "1.5 yrs": None, "3 - 6 years": (3, 6), "none": None, "": None, None: None,
        "10 + years or 2-3 years": (2, 3), "٣ - ٦ years": (3, 6), "x3-6 years": None, "3-6 yearsx": None,
        "experienced 7": None, "1.5 - 2.5 yrs": (1.5, 2.5), "Exp:3, then 4": (3, 3),
    }
    got = values(spark, list(cases), enrich.years_range)
    for (text, expected), years in zip(cases.items(), got):
        assert (None if years is None else (years["min"], years["max"])) == expected, text


def test_years_fall_back_to_the_title(spark):
    df = spark.createDataFrame([("none", "Dev 2-3 yrs"), ("4+ yrs", "Dev 2-3 yrs")], "d string, t string")
    got = df.select(enrich.years_range("d", "t").alias("y")).collect()
    assert [(r.y.min, r.y.max) for r in got] == [(2, 3), (4, 8)]


def test_role_category(spark):
    cases = {
        "DevOps Engineer": "Software Engineer", "Cloud Engineer": "Software Engineer",
        "Lead Developer": "Software Engineer", "ETL Developer": "Data Engineer", "SRE": "Devops",
        "Head of Data": "Management", "Chef": "Other", None: "Other", "": "Other", "NLP ENGINEER": "Data Scientist",
        "Product Manager": "Management", "Product Analyst": "Business Analyst", "Web Analytics": "Data Analyst",
    }
    assert values(spark, list(cases), enrich.role_category) == list(cases.values())


def test_work_mode(spark):
    cases = {"partially remote": "Remote", "flexible work": "Hybrid", "WFH": "Remote", None: "Onsite", "": "Onsite",
             "hybrid or work from home": "Remote"}
    assert values(spark, list(cases), enrich.work_mode) == list(cases.values())


def test_currency_quirks_of_the_ordered_rules(spark):
    cases = {"United Kingdom": "GBP", "Australia": "USD", "Ukraine": "GBP", "South Africa": "CAD", " Canada ": "CAD",
             "France": "EUR", "": "INR", None: "INR", "India": "INR", "USA": "USD", "Austria": "USD", "Gabon": "INR"}
    assert values(spark, list(cases), enrich.currency_of) == list(cases.values())


def test_corrected_rules_can_be_passed(spark):
    rules = (("AUD", ("australia",)),)
    assert values(spark, ["Australia"], lambda c: enrich.currency_of(c, rules)) == ["AUD"]


def test_to_usd(spark):
    df = spark.createDataFrame([(500000.0, 800000.0, "India"), (None, 10.0, "France"), (10.0, None, "UK"),
                                (None, None, "USA")], "a double, b double, c string")
    got = [tuple(r.u) for r in df.select(enrich.to_usd("a", "b", "c").alias("u")).collect()]
    assert got[0] == (6000.0, 9600.0, 7800.0, "INR")
    assert got[1][3] == "EUR" and got[1][0] == pytest.approx(10.8) and got[2][:3] == pytest.approx((12.8, 12.8, 12.8))
    assert got[3] == (None, None, None, "USD")


def tags(spark, text, terms=None):
    df = spark.createDataFrame([(1, text)], "id int, t string")
    return {r["term"] for r in tag_terms(df, "t", "id", terms).collect()}


@pytest.mark.parametrize("text, expected", [
    ("C# and C++ and .NET", set()), ("C++x", {"C++"}), ("ASP.NET", {".NET"}), ("C#x", {"C#"}),
    ("React", {"React", "React.js"}), ("react.js", {"React", "React.js"}), ("Node", {"Node.js"}),
    ("PL/SQL", {"PL/SQL", "SQL"}), ("R&D", {"R"}), ("go to market", {"Go"}), ("google cloud", {"Google Cloud"}),
    ("Vue.jsx", {"Vue", "Vue.js"}), ("javascript", {"JavaScript"}), ("java_script", set()), ("T-SQL", {"T-SQL", "SQL"}),
    ("éR", set()), ("Python2", set()), ("(python)", {"Python"}), ("PROBLEM  SOLVING", set()),
    ("problem solving", {"Problem Solving"}), ("", set()), ("SparK", {"Spark"}),
])
def test_term_tags(spark, text, expected):
    assert tags(spark, text) == expected


def test_terms_of_a_null_text_and_of_own_dictionary(spark):
    assert tags(spark, None) == set()
    assert tags(spark, "It's O'Brien's \\d+", [Term("x", "k", "o'brien"), Term("y", "k", "\\d+")]) == {"x"}


def test_terms_by_lookup_equal_terms_by_pattern(spark):
    words = ["Go", "go", "GO!", "ſql", "SQLſ", "\u212aotlin", "Saß", "SASS", "straße", "r", "R2", "é", "İ", "power", "BI", "bi.", "_sql", "node.js", "C#x", "ΑΣ", "ας"]
    rnd = random.Random(3)
    texts = [rnd.choice((" ", "/", ", ")).join(rnd.choice(words) for _ in range(rnd.randint(0, 7))) for _ in range(300)]
    terms = [*rules.default_terms(), Term("sass", "k", "sass"), Term("strasse", "k", "strasse"), Term("straße", "k", "straße"), Term("é", "k", "É"), Term("as", "k", "ΑΣ")]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, t string")
    got = {tuple(r) for r in tag_terms(df, "t", "id", terms).collect()}
    patterns = df.select("id", F.explode(F.array(*[
        F.when(F.col("t").rlike(rules.whole_word(t.stem, t.ending)), F.struct(F.lit(t.name).alias("n"), F.lit(t.kind).alias("k"))) for t in terms])).alias("h"))
    assert got == {(r["id"], r["h"]["n"], r["h"]["k"]) for r in patterns.filter("h IS NOT NULL").collect()} and len(got) > 300


def test_dictionary_is_one_set_for_all_texts(spark):
    plan = spark.range(1).select(F.expr(enrich.dictionary_words_sql("cast(id AS string)", "cast(id AS string)")))._jdf.queryExecution().optimizedPlan().toString()
    assert "INSET" in plan.upper() and "array_intersect" not in plan


def test_steps_of_a_check_are_projections(spark):
    """The generator between two steps only takes a row apart; what it would hold itself would be interpreted."""
    df = spark.range(3).selectExpr("id", "cast(id AS string) AS t")
    got = evaluate(df, ["id"], {"u": F.upper("t"), "n": F.expr("CASE WHEN id = 1 THEN NULL ELSE id END")})
    assert [tuple(r) for r in got.orderBy("id").collect()] == [(0, "0", 0), (1, "1", None), (2, "2", 2)]
    lines = got._jdf.queryExecution().executedPlan().toString().split("\n")
    assert any("Generate" in line for line in lines) and not any("upper" in line for line in lines if "Generate" in line)
    once = got.filter("u <> '1'")._jdf.queryExecution().executedPlan().toString()
    assert once.count("upper(") == 1


def test_amounts_in_text(spark):
    cases = {None: (None, None, False), "": (None, None, False), "N/A": (None, None, False),
             "$80,000 - $100,000": (80000, 100000, False), "1,000 or 250 or 3,000.25": (250, 3000.25, False),
             "12": (12, 12, False), ",.5": (0.5, 0.5, False), "1.2,3": (1.2, 3, False)}
    got = values(spark, list(cases), amounts_in_text)
    assert [tuple(g) for g in got] == list(cases.values())
    assert values(spark, ["negotiable, good"], amounts_in_text)[0]["bad"]


def variants(spark, texts, make):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, j string")
    df = df.select("i", F.parse_json("j").alias("v"))
    return [row["r"] for row in df.select("i", make("v").alias("r")).orderBy("i").collect()]


def test_amounts_of_json_values(spark):
    got = variants(spark, ["80000", "-5.5", "null", '"-5"', "true", '{"a": 7}', "1e5"], parse_amounts)
    assert [(g["min"], g["max"]) for g in got] == [(80000, 80000), (-5.5, -5.5), (None, None), (5, 5), (1, 1), (7, 7),
                                                   (100000, 100000)]


def test_text_of_json_values(spark):
    cases = {'null': "", '"  a "': "a", '{"display_name": "", "name": " n "}': "n", '{"value": 3}': "3",
             '{"title": 0, "value": false}': '{"title":0,"value":false}', "5": "5", "true": "True", "1.5": "1.5",
             '{"display_name": "0"}': "0"}
    assert variants(spark, list(cases), text_of) == list(cases.values())


def test_split_place(spark):
    cases = {None: None, "": None, "X": ("X", None), "X, Y": ("X", "Y"), "X, Y, Z": ("X", "Y"), ", Y": ("", "Y"),
             "X ,  Y": ("X", "Y")}
    got = values(spark, list(cases), split_place)
    assert [None if g is None else tuple(g) for g in got] == list(cases.values())


def fields(spark, *texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, j string")
    return df.select("i", record_fields("j").alias("fields")).orderBy("i")


def test_salary_fields(spark):
    texts = ('{"salary_min": null, "salary_max": null, "salary": "9"}', '{"salary_min": 5}', '{"salary_max": "7 or 3"}',
             '{"salary_min": 9, "salary_max": 2}', '{"salary": "1 - 2"}', '{}', '{" Salary_MIN ": 4, "salary": "9"}')
    got = [tuple(r.s)[:2] for r in fields(spark, *texts).select(resolve_salary().alias("s")).collect()]
    assert got == [(None, None), (5, 5), (3, 3), (9, 2), (1, 2), (None, None), (4, 4)]


def test_country_is_absent_null_or_given(spark):
    texts = ("{}", '{"country": null}', '{"COUNTRY": " UK "}', '{"country": "a", " Country": "b"}')
    got = [r.c for r in fields(spark, *texts).select(country_of().alias("c")).collect()]
    assert got == ["India", None, " UK ", "b"]


def test_small_helpers(spark):
    assert values(spark, ["  a \x1f"], strip) == ["a"]
    assert values(spark, [2.5, 3.5, None, 1e12], lambda c: whole_years(F.col(c)), "double") == [2, 4, None, None]
    assert values(spark, [2.5, 1234.5, None], lambda c: display.dollars(F.col(c), 0), "double") == ["$3", "$1,235", None]
    assert values(spark, [1, 2, 5, 6, None], lambda c: display.range_bucket(F.col(c)), "int") == [
        "Entry-Level (<2 yrs)", "Mid-Level (2-5 yrs)", "Mid-Level (2-5 yrs)", "Senior-Level (>5 yrs)", "Not Specified"]
    assert values(spark, ["b", "z", None], lambda c: display.position_in(F.col(c), ["a", "b"])) == [2, 0, 0]
    assert values(spark, ["x", None], lambda c: title_plus_description("'t'", c)) == ["t x", "t "]
