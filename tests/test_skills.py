"""Cases of the skill, profile and experience operators that the tables do not hold."""

import pytest
from pyspark.sql import functions as F

from vellumine.functions import scoring, skills
from vellumine.operators.intervals import total_experience

WORDS = skills.Words(known=("python", "system design"), stop=("and", "team"), roles=("architect",), companies=("acme", "systems"))


def one(spark, make, *values):
    row = spark.createDataFrame([values], ", ".join(f"c{i} string" for i in range(len(values))))
    return row.select(make(*row.columns).alias("x")).first().x


@pytest.mark.parametrize(
    ("value", "good"),
    [("Go", True), ("golang", True), ("go", True), ("x", False), ("C#", True), ("  Docker ", True), ("teams", False), ("12345", False), ("a b c d e", False), ("System Design", True), ("Data Engineer", False),
     ("solution architect", False), ("Acme tools", False), ("file systems", True), ("acme ltd", False), ("unlimited", True), ("May 2020", False), ("version 2019", False), ("Skills", False), ("", False), (None, False), ("y" * 41, False)],
)
def test_valid_skill(spark, value, good):
    assert one(spark, lambda c: skills.valid_skill(F.col(c), WORDS), value) is good


def test_skills_of_a_section_with_parentheses_labels_and_repeats(spark):
    section = "• Cloud: AWS (EC2/S3), Azure (VM, aws; Docker\nLanguages: Rust - Kotlin | rust\n" + "z" * 2600
    assert one(spark, lambda t, s: skills.skills(F.col(t), F.col(s), WORDS), "I write python.", section) == ["EC2", "S3", "AWS", "Azure (VM", "Docker", "Rust", "Kotlin", "Python"]  # commas part first


def test_few_skills_are_completed_from_labelled_lines(spark):
    text = "Tech Stack: Kafka, Flink; Docker\nTools " + "x" * 200 + "\nand more pythonic things"
    assert one(spark, lambda t, s: skills.skills(F.col(t), F.col(s), WORDS), text, "Docker") == ["Docker", "Kafka", "Flink"]
    assert one(spark, lambda t, s: skills.skills(F.col(t), F.col(s), WORDS), None, None) == []


def test_certifications_and_summary(spark):
    assert one(spark, lambda s: skills.certifications(F.col(s)), "Certifications\n- First Aid\n* ab\n\n• Welding II ") == ["First Aid", "Welding II"]
    assert one(spark, lambda s: skills.certifications(F.col(s)), None) == []
    text = "Lorem Ipsum\nlorem@x.org writes about six or more words here\n- a bullet of six or more words in a line\nCurriculum of six or more words in a line\nAn engineer of six or more **plain** words, indeed,"
    pick = lambda s, t: skills.summary(F.col(s), F.col(t))
    assert one(spark, pick, "short", text) == "An engineer of six or more plain words, indeed"
    assert one(spark, pick, " Builds   things\nfor a living ", text) == "Builds things for a living"
    assert one(spark, pick, None, None) is None


def test_links_are_routed(spark):
    links = "https://www.linkedin.com/in/a https://x.github.io https://b.vercel.app https://c.org https://github.com/q"
    found = one(spark, lambda c: skills.routed_links(F.split(c, " ")), links)
    assert (found.portfolio, found.others) == ("https://x.github.io", ["https://b.vercel.app", "https://c.org"])
    none = one(spark, lambda c: skills.routed_links(F.split(c, " ")), "https://c.org")
    assert (none.portfolio, none.others) == (None, ["https://c.org"])


def test_json_arrays(spark):
    rows = spark.createDataFrame([('["a"]',), ("[]",), ('{"a":[1]}',), ('"[1]"',), ("[1",), (None,)], "v string")
    assert [r.x for r in rows.select(skills.is_json_array(F.col("v")).alias("x")).collect()] == [True, True, False, False, False, False]


def test_profile_domain_boost_and_fallback(spark):
    taxonomy = {"Software": (("python", "go"), ("developer",)), "Mechanical": (("creo",), ("mechanical",))}
    boost = ("Mechanical", ("creo", "nx"), "design", 8.0)
    schema = "id int, skills array<string>, role string, roles string, education string, highlights string, summary string"
    rows = [
        (1, ["python 3", "go", "gopher"], "Developer", "junior developer", None, "wrote Python.", "python-only"),
        (2, ["nx"], "Design lead", None, None, None, None), (3, None, "QA lead", None, None, None, None), (4, [], None, None, None, None, None),
    ]
    got = {r.id: (r.domain, r.score) for r in scoring.profile_domain(spark.createDataFrame(rows, schema), taxonomy, boost).collect()}
    assert got == {1: ("Software", 6.0 + 5.0 + 6.0 + 1.5 + 1.0), 2: ("Mechanical", 8.0), 3: ("Quality", 0.0), 4: ("General", 0.0)}


def test_total_experience(spark):
    schema = "k int, start_date string, end_date string, is_current boolean, duration string"
    rows = [
        (1, "2020-01", "2020-07", None, None), (1, "2020-05", "2021-03", False, None),  # 14 months, overlapping
        (2, "2019", "2020", False, None),  # January to December of the next year
        (3, "2022-12", None, True, None), (4, None, None, None, "2.5 years 1 month"), (4, None, None, None, "1 yr"),
        (5, "2022-05", "2021-05", False, None), (6, None, None, None, None), (7, "2022-01", None, False, "01/2022 - Present"), (8, "2021-01", "2022-02", None, None),
    ]
    got = {r.k: r.experience for r in total_experience(spark.createDataFrame(rows, schema), ["k"], F.lit("2023-04-02").cast("date")).collect()}
    assert got == {1: "1y 2m", 2: "1y 11m", 3: "4 Months", 4: "2y 7m", 5: None, 6: None, 7: "1y 3m", 8: "1 Years"}


def test_editable_keeps_allowed_fields(spark):
    updates = F.create_map(F.lit("Name"), F.col("c0"), F.lit("owner"), F.lit("x"), F.lit("remarks"), F.lit(" y "), F.lit("notes"), F.col("c1"))
    assert one(spark, lambda *_: skills.editable(updates), " Lorem ", None) == {"name": "Lorem", "notes": "y"}
