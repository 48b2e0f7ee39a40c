import plain
import pytest
from pyspark.sql import functions as F

from vellumine.functions import grids, insights, markup, model_text, refine, roles
from vellumine.functions import text as T
from vellumine.functions.skills import Words, mentioned, whole_word
from vellumine.operators import extraction
from vellumine.sources import files

W = Words(roles=("engineer", "analyst", "manager"), companies=("ltd", "labs"), places=("pune", "india"), stop=("hobbies",))


def values(spark, function, inputs, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(inputs)], f"id int, v {kind}")
    return [r["x"] for r in df.select("id", function(F.col("v")).alias("x")).orderBy("id").collect()]


def test_facts_behind_labels(spark):
    facts = lambda v, name: values(spark, lambda c: insights.insights(c)[name], v)
    assert facts(["Availability: 15 days", "Notice period: ready to join", "serving notice – immediately", "notice 2 months", "none", None], "notice_period") == ["15 days", "ready to join", "immediately", "2 months", "Negotiable", "Negotiable"]
    assert facts(["Present salary: 5 lacs", "current ctc 12", "I get 7.5 LPA", "x"], "current_pay") == ["5 lacs", "12 LPA", "7.5 LPA", "Negotiable"]
    assert facts(["Expected: 30% hike", "expected salary 90k", None], "expected_pay") == ["30% hike", "90k", "Negotiable"]
    assert facts(["Residing in pune", "Location: phone home", "based in NEW delhi. x"], "location") == ["Pune", "Not Specified", "New Delhi"]
    assert facts(["over 4.5+ years of rich experience", "Total experience: 3 yrs 2 m", ""], "years") == ["4.5+ Years", "3 yrs 2 m", "Fresher"]
    assert values(spark, insights.years_in_file, ["X[5y_0m].pdf", "a_4y_6m_b.doc", "x.pdf"]) == ["5 Years", "4y 6m", None]


def test_roles_of_file_names(spark):
    names = ["Resume_John_Doe_Java_Developer_5yrs.pdf", "x-SeniorFullStackEngineer(2).docx", "CAD-designer.pdf", "site.pdf", "Project_Manager.pdf", "plain.pdf", None]
    assert values(spark, insights.role_from_file, names) == ["Java Developer", "Senior Full Stack Engineer", "Cad Designer", "Site", "Project Manager", None, None]


def test_contacts_that_are_and_are_none(spark):
    assert values(spark, T.emails, ["a@b.c, X.Y@Z-1.org; logo@2x.png"]) == [["a@b.c", "x.y@z-1.org"]]
    got = values(spark, T.phones, ["2019202020", "2019 2020 2021", "(202) 555-0147", "98765 43210 and 9876543210", "1111111111", "+91-98765-43210"])
    assert got == [[], [], ["(202) 555-0147"], ["98765 43210"], [], ["+91-98765-43210"]]
    assert values(spark, T.links, ["see https://x.org/a?b=(c) and http://x.org/a. end"]) == [["https://x.org/a?b=(c", "http://x.org/a"]]


def test_the_role_of_a_profile_comes_from_its_best_source(spark):
    schema = "id int, t string, held array<string>, s string, rows array<array<string>>, f string"
    rows = [
        (0, "Mr. Alok Kumar\nSenior Mechanical Design Engineer\nEmail: a@b.c", None, None, None, None), (1, "FULL STACK DEVELOPER\nPriya Patel", None, None, None, None),
        (2, "Jane\nWe lead. \nSkills of an engineer", ["B.Tech lead", "Site engineer (2019 - present)"], None, None, None), (3, "x", [], "Jane Roe is an Application Engineer with 4 years", None, None),
        (4, "x", None, None, [["a"], ["Designation", "Head Cook"]], "java_developer.pdf"), (5, "x", None, None, [["how many managers"]], "java_developer.pdf"), (6, "knows plc", None, None, None, "x.pdf"), (7, "x", None, None, None, None), (8, None, None, None, None, None),
    ]
    df = spark.createDataFrame(rows, schema)
    got = {r["id"]: r["r"] for r in df.select("id", roles.role(F.col("t"), W, F.lit("Jane Roe"), F.col("held"), F.col("s"), F.col("rows"), F.col("f")).alias("r")).collect()}
    assert got == {0: "Senior Mechanical Design Engineer", 1: "Full Stack Developer", 2: "Site Engineer", 3: "Application Engineer", 4: "Head Cook", 5: "Java Developer", 6: "Electrical Engineer", 7: None, 8: None}


def test_first_valid_fields(spark):
    df = spark.createDataFrame([(0, ["Document 1", "www.x.com", " Ann Lee "], ["", " a@b.c"], [" "], "call 12345-67890"), (1, ["CV"], [], None, "x"), (2, None, None, [" 5 ", "6"], None)], "id int, n array<string>, e array<string>, p array<string>, t string")
    out = df.select("id", roles.primary_name(F.col("n"), F.lit("BoRay_Resume.pdf")).alias("n"), roles.primary_email(F.col("e")).alias("e"), roles.primary_phone(F.col("p"), F.col("t")).alias("p")).orderBy("id").collect()
    assert [tuple(r)[1:] for r in out] == [("Ann Lee", "a@b.c", "12345-67890"), ("Bo Ray", None, None), ("Bo Ray", None, "5")]


def test_tables_by_their_headers(spark):
    tables = [
        [["Project", "Tools", "Details"], ["A", "Spark, sales manager;Kafka", "**big**"], ["projects", "x", "y"], [], ["B"]], [["#", "Exam", "Board", "Period", "Marks"], ["1", "", "XYZ", "2010-12", "80%"], ["2", None, None, "x", "y"]],
        [["Title", "Duration", "Firm"], ["Lead", "Jan 2019 - Present", "Foo"]], [["a", "b"], ["1", "2"]], [["Project"]], None, [["Title", "Stack"], ["T", "Spark"]],
    ]
    df = spark.createDataFrame(list(enumerate(tables)), "id int, t array<array<string>>")
    got = {(r["id"], r["number"]): tuple(r)[2:] for r in grids.table_entities(df, "id", "t", W).collect()}
    none = (None, None, None, False)
    assert got == {
        (0, 1): ("project", "A", None, *none, "big", ["Spark", "Kafka"]), (0, 4): ("project", "B", None, *none, None, []), (1, 1): ("education", "Degree", "XYZ", "2010 - 2012", "2010", "2012", False, "80%", []),
        (2, 1): ("experience", "Lead", "Foo", "2019-01 - Present", "2019-01", None, True, None, []), (6, 1): ("project", "T", None, *none, None, ["Spark"]),
    }


PROFILE = "file_name string, name string, role string, summary string, skills array<string>, certifications array<string>, languages array<string>, experience array<struct<role:string,company:string,location:string,highlights:array<string>>>, education array<struct<degree:string,institution:string,details:string>>"


def refined(spark, rule, **fields):
    row = {"file_name": "AnnLee_Resume.pdf"} | fields
    names = [c.split(" ", 1)[0] for c in PROFILE.split(", ")]
    df = spark.createDataFrame([tuple(row.get(n) for n in names)], PROFILE)
    return refine.refined(df, W, {"reactjs": "React"}, (rule,)).first()


@pytest.mark.parametrize("name, expected", [("mr. ann lee", "Ann Lee"), ("ANN LEE - WA npu 26", "Ann Lee"), ("Ann McLee!", "Ann McLee"), (None, "Ann Lee"), ("  ", "Ann Lee")])
def test_names_are_refined(spark, name, expected):
    assert refined(spark, refine.name_rule, name=name)["name"].strip() in (expected, "")


def test_roles_are_refined(spark):
    assert refined(spark, refine.role_rule, role="lead engineer (TCS Ltd, 2021)")["role"] == "Lead Engineer"
    assert refined(spark, refine.role_rule, role="Foo Pvt Ltd", experience=[("site engineer", None, None, None)])["role"] == "Site Engineer"
    assert refined(spark, refine.role_rule, role="lead (of")["role"] == "Lead"


def test_summaries_are_refined(spark):
    made = refined(spark, refine.summary_rule, summary="mail a@b.c", role="Engineer", skills=["a", "b", "c", "d", "e", "f"], experience=[("x", "Foo", None, None)])["summary"]
    assert made == "Results-driven Engineer at Foo with strong expertise in a, b, c, d, e."
    assert refined(spark, refine.summary_rule, summary="good", skills=["a"])["summary"] == "good"
    assert refined(spark, refine.summary_rule, summary=None)["summary"] is None


def test_positions_and_degrees_are_refined(spark):
    jobs = [("site engineer (Foo from 2001 to 2003)", None, "Pune,", ["• **did it**", "Key Achievements: won", "Key Achievements: won it all!", None]), ("Bar Pvt Ltd", "senior manager", None, None), ("Baz Solutions", None, None, None)]
    got = [tuple(e) for e in refined(spark, refine.positions_rule, experience=jobs)["experience"]]
    assert got == [("Site Engineer", "Foo", "Pune", ["did it.", "won it all!"]), ("senior manager", "Bar Pvt Ltd", None, None), (None, "Baz Solutions", None, None)]
    assert [tuple(e) for e in refined(spark, refine.degrees_rule, education=[("b.sc physics (", "XYZ College", " 8.1 ;")])["education"]] == [("B.Sc Physics", "XYZ College", "8.1")]


def test_certificates_skills_and_languages_are_refined(spark):
    got = refined(spark, refine.certificates_rule, skills=["Spark", "AWS certified X", "PMP"], certifications=["PMP", "B.Tech in x", "90% score", "jan - mar course", "ok then"])
    assert got["skills"] == ["Spark"] and got["certifications"] == ["PMP", "ok then", "AWS certified X"]
    assert refined(spark, refine.skills_rule, skills=["react.js", " ", "ReactJS", "AWS"])["skills"] == ["React", "AWS"]
    assert refined(spark, refine.languages_rule, languages=["hindi", "notice?", "c2", "English", "HINDI"])["languages"] == ["English", "Hindi"]


def test_model_output(spark):
    raw = "junk<x_0.1><y_0.2>Hello<tbc>\n\n\n\nworld<x_0.5><y_1><class_Text><x_1><y_2> \\unknown <x_3><y_4><class_None><x_9>broken<x_1><y_1>T<x_2><y_2><class_Title>"
    got = values(spark, lambda c: F.struct(*[v.alias(k) for k, v in model_text.aligned(c).items()]), [raw, None, ""])
    assert got[0]["classes"] == ["Text", "Title"] and got[0]["texts"] == ["Hello\n\nworld", "T"] and got[0]["boxes"] == [[0.1, 0.2, 0.5, 1.0], [1.0, 1.0, 2.0, 2.0]] and got[0]["faults"] == ["junk", "<x_9>broken"]
    assert got[1]["texts"] == got[2]["texts"] == [] and got[1]["faults"] == []
    assert values(spark, model_text.clean_extracted, ["a\x00  b\t c \r\n\r\n\r\n d\x0b\r e  ", None]) == ["a b c\n\n d".replace("\n d", "\nd") + "\ne", ""]


def test_files_by_the_first_key_that_fits(spark):
    there = spark.createDataFrame([("/d/a.doc", "d"), ("/up/b.pdf", "up"), ("/old/b.pdf", "old"), ("/old/C.DOCX", "old"), ("/json/e.json", "json"), ("/json/b.json", "json"), ("/x/f.pdf", "x")], "path string, folder string")
    known = spark.createDataFrame([(1, "a.pdf", "/d/a.doc"), (2, "b.pdf", "/gone/b.pdf"), (2, "b.pdf", "/gone/b.pdf"), (7, None, None)], "document_id int, file_name string, file_url string")
    wanted = spark.createDataFrame([("p", 1, None), ("q", 2, None), ("r", None, "c.pdf"), ("s", None, "e.pdf"), ("t", 9, "f.pdf"), ("u", 7, None), ("v", None, None)], "key string, document_id int, file_name string")
    got = {r["key"]: (r["level"], r["path"], r["shown"], r["media_type"]) for r in files.resolved_files(wanted, known, there, "key", ("up", "old"), "json").collect()}
    none = (None,) * 4
    assert got.pop("r")[1:3] == ("/old/C.DOCX", "C.DOCX")
    assert got == {"p": (1, "/d/a.doc", "a.pdf", "application/msword"), "q": (2, "/up/b.pdf", "b.pdf", "application/pdf"), "s": (4, "/json/e.json", "e.json", "application/json"), "t": none, "u": none, "v": none}


def test_markup_and_sections_equal_their_plain_versions(spark):
    pages = [r["html"] for r in spark.read.parquet("/root/testdata/sf0.001/pages.parquet").select("html").collect()]
    assert values(spark, markup.visible_text, [*pages, None, ""]) == [*map(plain.strip_html, pages), None, ""]
    assert values(spark, markup.unescaped, ["&lt;b&gt; &eacute;&#233;&#x1F600; &bogus; & &amp;amp; &#0;", None]) == ["<b> éé😀 &bogus; & &amp; &#0;", None]
    texts = ["a\nSkills\n---\nSkills: b, c\nEducation:\nfoo: bar\n2. skills\nz", "Summary", "", None, "x\n" * 3000 + "PROFILE:\ny"]
    assert values(spark, markup.sections, texts) == [plain.sections(t) for t in texts]


def test_stitching(spark):
    cases = {
        ("Python Developer", "ABC Technologies"): 2, ("- Completed project on time.", "Started new initiative."): 2, ("- Developed scalable services", "for high throughput data processing."): 1,
        ("- Designed microservices with Python and", "FastAPI framework."): 1, ("one,", "Two-", "three"): 1, ("one,", "", "two"): 3, ("lead engineer,", "acme labs"): 2, ("Jan 2020,", "foo"): 2, ("and", "a@b.c"): 2,
        ("Skills", "python"): 2, ("the", "EDUCATION"): 2, ("- a", "b", "c"): 1, (): 0,
    }
    got = values(spark, lambda c: markup.stitched(c, ("engineer",), ("labs",)), [list(c) for c in cases], "array<string>")
    assert [len(g) for g in got] == list(cases.values()) and got[4] == ["one, Two- three"] and got[5] == ["one,", "", "two"]
    raw = "<p>Experienced <b>Software Engineer</b> with &amp; Python skills.</p><script>x()</script>\n• Developed scalable services\nfor high throughput.\nPage 1 of 2"
    assert values(spark, markup.cleaned_document, [raw, "a &lt; b", None]) == ["Experienced Software Engineer with & Python skills.\n- Developed scalable services for high throughput.", "a < b", ""]


def test_terms_are_those_that_a_search_for_each_finds(spark):
    import re

    terms = ("python", "c++", "machine learning", "r", "go", "x_1", "node.js")
    texts = ["python c++ r-go x_1", "pythonic c+++ machine  learning node.js", "é python.machine learning,r", "", None]
    slow = lambda t: None if t is None else [w for w in terms if re.search(whole_word((w,)).replace(r"\p{L}\p{N}", r"\w"), t)]
    got = values(spark, lambda c: mentioned(c, terms), texts)
    assert [g or [] for g in got] == [slow(t) or [] for t in texts]


def test_whole_profiles(spark):
    text = "Curriculum Vitae\nAnn Lee\na@b.org\nExperience\nEngineer at Foo Labs\n2019 - Present\n- did it\nEducation\nMBA, City College, 2014\nSkills: Spark; Kafka"
    df = spark.createDataFrame([(1, text, "x.pdf"), (2, None, "BoRay_Resume.pdf"), (3, "", "1.pdf")], "id int, t string, f string")
    got = {r["id"]: r for r in extraction.profiles(df, "id", "t", "f", W).collect()}
    assert set(got) == {1, 2, 3} and got[1]["name"] == "Ann Lee" and got[1]["role"] == "Engineer At Foo Labs" and got[1]["emails"] == ["a@b.org"] and got[1]["skills"] == ["Spark", "Kafka"]
    assert [tuple(e)[:2] for e in got[1]["experience"]] == [("Engineer", "Foo Labs")] and got[1]["education"][0]["institution"] == "City College"
    assert got[2]["name"] == "Bo Ray" and got[2]["experience"] == [] and got[3]["name"] is None


def test_profiles_read_a_text_once(spark, tmp_path):
    """Failed before: texts were cleaned anew for positions with and without dates and for degrees, then joined by id; rows of one id met."""
    from vellumine.functions.skills import Words
    from vellumine.operators.extraction import profiles

    text = "Ab Cd\nExperience\nLead at {0} Labs\n2010 - 2012\nEducation\nMBA, {0} College, 2009"
    rows = [(1, text.format("Foo"), "a.pdf"), (1, text.format("Bar"), "b.pdf"), (None, text.format("Baz"), "c.pdf"), (2, None, "x_y.pdf")]
    spark.createDataFrame(rows, "id int, t string, f string").coalesce(1).write.parquet(str(tmp_path / "docs"))
    out = profiles(spark.read.parquet(str(tmp_path / "docs")), "id", "t", "f", Words(roles=("lead",), companies=("labs",)))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and "Exchange" not in plan
    got = sorted((r["id"] or 0, [e["company"] for e in r["experience"]], [e["institution"] for e in r["education"]]) for r in out.collect())
    assert got == [(0, ["Baz Labs"], ["Baz College"]), (1, ["Bar Labs"], ["Bar College"]), (1, ["Foo Labs"], ["Foo College"]), (2, [], [])]
