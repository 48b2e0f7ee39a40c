import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from vellumine.functions import geometry, parsing, scoring, text


def values(spark, function, inputs):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(inputs)], "id int, v string")
    return [r["x"] for r in df.select("id", function(F.col("v")).alias("x")).orderBy("id").collect()]


def test_date_ranges(spark):
    cases = {
        "Jan 2021 - Present": ("2021-01", None, True), "06/2018 to 08/2021": ("2018-06", "2021-08", False), "2020": (None, "2020", False), "2020-2022": ("2020", "2022", False),
        "Jan 2020-Jan 2022": ("2020-01", "2022-01", False), "Jan2020-Jan2022": ("2020-01", "2022-01", False), "Since 2021": ("2021", None, True), "From Jan 2020": ("2020-01", None, True),
        "Until 2022": (None, "2022", False), "05/2019 - 11/2022": ("2019-05", "2022-11", False), "2018 till 2021": ("2018", "2021", False), "Feb 2020 ~ Present": ("2020-02", None, True),
        "'19 - '23": ("2019", "2023", False), "no date": (None, None, False),
    }
    got = values(spark, lambda c: F.struct(*text.date_range(c).values()), list(cases))
    assert [tuple(r) for r in got] == list(cases.values())
    for single, expected in (("start", ("2020", None)), ("both", ("2020", "2020"))):
        assert tuple(values(spark, lambda c, s=single: F.struct(*list(text.date_range(c, s).values())[:2]), ["2020"])[0]) == expected


def test_names_from_files(spark):
    cases = {
        "AbcdeFghijk[5y_0m]-WA-npu- call later-26 aug.docx": "Abcde Fghijk", "Lorem Ipsum--npu.docx": "Lorem Ipsum", "Lorem Ipsum P M.DOCX": "Lorem Ipsum P M", "LoremIpsum_Resume_2024.docx": "Lorem Ipsum",
        "LOREM IPSUM DOLOR--54% in 10th.docx": "Lorem Ipsum Dolor", "Lorem_Ipsum_ask if available- fwd.docx": "Lorem Ipsum", "Lorem[5y_0m]-WA-not looking change-25 Aug.pdf": "Lorem",
    }
    assert values(spark, text.name_from_file, list(cases)) == list(cases.values())


def test_contacts(spark):
    found = values(spark, text.phones, ["call +91 98765 43210, 98765-43211 or +1 (555) 123-4567; not 1111111111", None, "+91 98765 43210 and 919876543210"])
    assert len(found[0]) == 3 and found[1] is None and found[2] == ["+91 98765 43210"]
    assert values(spark, text.emails, ["A.b@Example.com, a.b@example.com. logo@2x.png"]) == [["a.b@example.com"]]
    both = lambda k: values(spark, lambda c: text.profile_links(c)[k], ["https://www.linkedin.com/in/u-1/ github.com/a_b", "LINKIEDIN.com/in/x, http://github.com/Topics/y", "nothing"])
    assert both("linkedin") == ["https://www.linkedin.com/in/u-1", "https://www.linkedin.com/in/x", None] and both("github") == ["https://github.com/a_b", None, None]


def test_cleaning(spark):
    raw = "• one​\n● two\n➢ three\nPage 1 of 2\nsee IEEE, page 2 of volume 4.\n- 2 -\nmicro-\nscope “x”"
    assert values(spark, text.clean_text, [raw])[0] == '- one\n- two\n- three\n\nsee IEEE, page 2 of volume 4.\n\nmicroscope "x"'
    assert values(spark, text.clean_field, ["  **Lead** ;", " - ", None]) == ["Lead", None, None]


def test_skills(spark):
    aliases = {"reactjs": "React", "postgres": "PostgreSQL", "k8s": "Kubernetes", "golang": "Go"}
    assert values(spark, lambda c: text.normal_skill(c, aliases), ["reactjs", "React.js", "postgres", "k8s", "golang", "AWS", "data science"]) == ["React", "React", "PostgreSQL", "Kubernetes", "Go", "AWS", "Data Science"]
    assert parsing.fuzzy_distinct(["Java", "JavaScript", "C", "C++", "C#", "R", "React", "React Native", "SQL", "NoSQL", "Machine Learning", "machine  learning", "Learning Machine"]) == ["Java", "JavaScript", "C", "C++", "C#", "R", "React", "React Native", "SQL", "NoSQL", "Machine Learning"]


@given(st.text(max_size=20), st.text(max_size=20))
@settings(max_examples=60, deadline=None)
def test_similarity_is_symmetric_and_bounded(a, b):
    r = parsing.indel_ratio(a, b)
    assert r == parsing.indel_ratio(b, a) and 0 <= r <= 100 and parsing.indel_ratio(a, a) == 100 and (r < 100 or a == b)


@given(st.lists(st.text(alphabet="abcd +", min_size=1, max_size=9), max_size=12))
@settings(max_examples=80, deadline=None)
def test_alike_names_are_those_that_comparing_every_pair_finds(names):
    kept = []
    for n in names:
        same = lambda a, b: a.lower() == b.lower() or (min(len(a), len(b)) > 3 and parsing.token_sort_ratio(a, b) >= 88)
        if not any(same(n, k) for k in kept):
            kept.append(n)
    assert parsing.fuzzy_distinct(names) == kept


def test_projects():
    assert parsing.projects("Thing\nDoes it\nTools: a, b\n\n- Other")[0]["technologies"] == ["a", "b"]


def test_golden_score(spark):
    row = ("Lorem Ipsum", "a summary that is longer than thirty characters", None, 1, 1, 2, 2, 0, 0, 1, False, False, False, False)
    names = "name string, summary string, error_message string, n_emails int, n_phones int, n_profiles int, n_skills int, n_experience int, n_education int, n_projects int, has_role boolean, has_company boolean, has_dates boolean, has_highlights boolean"
    got = scoring.profile_score(spark.createDataFrame([row], names)).first()
    assert [got[c] for c in ("contact", "completeness", "skills_score", "experience_score", "formatting", "overall", "grade")] == [15, 10, 10, 0, 10, 45, "C"]


def test_classes_and_ties(spark):
    df = spark.createDataFrame([(1, ["python", "backend"]), (2, ["cad", "python"]), (3, []), (4, ["plc"])], "id int, words array<string>")
    taxonomy = {"Mechanical": {"cad": 3.0}, "Software": {"python": 3.0, "backend": 5.0}, "Electrical": {"plc": 2.0}}
    assert [r["domain"] for r in scoring.classify(df, "id", "words", taxonomy).orderBy("id").collect()] == ["Software", "Mechanical", "General", "General"]


@pytest.mark.parametrize("w, h, name", [(595.3, 841.9, [595, 842]), (842, 595, [842, 595]), (612, 792, [612, 792]), (600, 600.5, [600, 600]), (522, 756, [522, 756])])
def test_page_sizes(spark, w, h, name):
    assert spark.range(1).select(geometry.page_size(F.lit(float(w)), F.lit(float(h))).alias("x")).first()["x"] == name


def test_colours_and_boxes(spark):
    row = spark.range(1).select(
        geometry.hex_colour(F.lit(255), F.lit(0), F.lit(17)).alias("a"), geometry.hex_colour(F.lit(1), F.lit(2), F.lit(3)).alias("b"),
        geometry.coordinate(F.lit(12.04)).alias("c"), geometry.coordinate(F.lit(12.26)).alias("d"),
        geometry.unletterbox(F.array(F.lit(0.0), F.lit(0.0), F.lit(1.0), F.lit(1.0)), F.lit(600.0), F.lit(800.0), (1000, 1000)).alias("e"),
    ).first()
    assert (row["a"], row["b"], row["c"], row["d"], row["e"]) == ("#f01", "#010203", "12", "12.3", [0.0, 0.0, 600.0, 800.0])


def test_alike_names_that_are_never_the_same():
    names = ["HTML", "HTML5", "JavaScript", "TypeScript", "Java", "AngularJS", "Angular", "Machine Learning", "learning machine", "Machine Learnin"]
    assert parsing.fuzzy_distinct(names) == ["HTML", "HTML5", "JavaScript", "TypeScript", "Java", "AngularJS", "Angular", "Machine Learning"]
