import pytest

from vellumine.functions import degrees as D
from vellumine.functions import positions as P
from vellumine.functions.skills import Words

W = Words(roles=("engineer", "developer", "analyst", "manager", "lead"), companies=("ltd", "labs", "solutions", "pvt"), places=("pune", "india", "new delhi"))

SPLITS = [
    ("Engineer (Acme Labs, Pune)", ("Engineer", "Acme Labs", "Pune")), ("Engineer (Acme 2010 to 2012)", ("Engineer", "Acme", None)), ("Analyst at Foo, Bar, Baz", ("Analyst", "Foo", "Bar, Baz")),
    ("Manager @ Foo", ("Manager", "Foo", None)), ("Trainee in Bar Motors, Pune", ("Trainee", "Bar Motors", "Pune")), ("Interested in music", (None, "Interested in music", None)),
    ("Acme Ltd, Pune, Lead 3 years", ("Lead", "Acme Ltd", "Pune")), ("New Delhi", (None, None, "New Delhi")), ("Developer, Foo", ("Developer", "Foo", None)), ("Foo | Developer", ("Developer", "Foo", None)),
    ("Foo, Bar", (None, "Foo", "Bar")), ("Foo, Pune", (None, "Foo", "Pune")), ("Lead - Foo - Pune", ("Lead", "Foo", "Pune")), ("Foo – Lead", ("Lead", "Foo", None)), ("senior developer", ("senior developer", None, None)),
    ("Foo", (None, "Foo", None)), ("", (None, None, None)), (None, (None, None, None)), (" ,- ", (None, None, None)),
]


def test_header_lines_are_split_by_the_first_cut_that_applies(spark):
    rows = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(SPLITS)], "i int, t string")
    got = {r["i"]: tuple(r["s"]) for r in rows.select("i", P.split_position(rows["t"], W).alias("s")).collect()}
    assert [got[i] for i in range(len(SPLITS))] == [e for _, e in SPLITS]


PART = """Work Experience
Senior Engineer at Acme Labs, Pune
Jan 2020 - Present
- Built services.
• Led teams
Data Analyst
Beta Solutions
05/2018 to 12/2019
Responsibilities:
12
Reports written for the whole company every week.
Gamma Pvt Ltd | Developer | Pune 2015-2017
Jul 2014 - Sep
2015
Client: Delta
Delta engineer
2001 – 2002
B.Tech analyst
1997 - 2001
References
Lead 2010 - 2011"""


def test_positions_are_bound_to_their_dates(spark):
    rows = spark.createDataFrame([(1, PART), (2, "Engineer (Acme, Pune)\n- one\n\nOther Corp\nsecond line"), (3, None), (4, ""), (5, "2010 - 2012\nFoo Labs\n- x"), (6, "x\n" * 5000 + "Lead at Y\n2010 - 2012\n" + "- z\n" * 5000)], "id int, t string")
    got = {}
    for r in P.positions(rows, "id", "t", W).orderBy("id", "number").collect():
        got.setdefault(r["id"], []).append((r["role"], r["company"], r["location"], r["duration"], r["is_current"], r["highlights"]))
    assert got.pop(6) == [("Lead", "Y", None, "2010 - 2012", False, ["z"] * 5000)]
    assert got == {
        1: [
            ("Senior Engineer", "Acme Labs", "Pune", "2020-01 - Present", True, ["Built services.", "Led teams"]),
            ("Data Analyst", "Beta Solutions", None, "2018-05 - 2019-12", False, ["Reports written for the whole company every week."]),
            ("Developer", "Gamma Pvt Ltd", "Pune", "2015 - 2017", False, []),
            (None, None, None, "2014-07 - 2015-09", False, ["Client: Delta"]),
            ("Delta engineer", "Delta", None, "2001 - 2002", False, []),
        ],
        2: [("Engineer", "Acme", "Pune", None, False, ["one"]), ("Other Corp", "Other Corp", None, None, False, [])],
        5: [(None, "Foo Labs", None, "2010 - 2012", False, ["x"])],
    }


EDUCATION = """B.Tech in Mechanical | XYZ Institute of Technology | 2013-2017 | CGPA: 8.1
HSC
ABC School, 2013, 85%
M.Tech:- Thermal
Engineering
IIT Bombay
2019
Master of Arts
Master of Arts in History, Foo University, 2001-03
AutoCAD Diploma course"""


def test_degrees_are_read_repaired_and_merged(spark):
    text = "intro\nVisvesvaraya National Institute of Technology, Nagpur - B. Tech MECHANICAL, JULY 2013 - MAY 2017, First Division\nend"
    rows = spark.createDataFrame([(1, EDUCATION, None), (2, None, text), (3, None, None), (4, "", "x"), (5, "MBA\nMBA Finance\nFoo University", "IIT Bombay - MBA Finance, 2011")], "id int, t string, f string")
    got = {}
    for r in D.degrees(rows, "id", "t", W, "f").orderBy("id", "number").collect():
        got.setdefault(r["id"], []).append((r["degree"], r["institution"], r["duration"], r["start_date"], r["end_date"], r["details"]))
    assert got == {
        1: [
            ("B.Tech in Mechanical", "XYZ Institute of Technology", "2013 - 2017", "2013", "2017", "CGPA: 8.1"),
            ("HSC", "ABC School", "2013", None, "2013", "85%"),
            ("M.Tech - Thermal Engineering", "IIT Bombay", "2019", None, "2019", None),
            ("Master of Arts in History", "Foo University", "2001 - 2003", "2001", "2003", None),
        ],
        2: [("B. Tech MECHANICAL", "Visvesvaraya National Institute of Technology, Nagpur", "2013-07 - 2017-05", "2013-07", "2017-05", "First Division")],
        5: [("MBA", None, None, None, None, None), ("MBA Finance", "Foo University", None, None, None, None)],
    }
    assert [r["number"] for r in D.degrees(rows, "id", "t", W).filter("id = 1").orderBy("number").collect()] == [1, 2, 3, 4]


@pytest.mark.parametrize("bad", [None, "", "x", "JUNE 2011 to APRIL 2013", "Marks 85", "85%", "2011 - 2013", "proficient in python", "gap after diploma"])
def test_what_cannot_be_a_degree(spark, bad):
    from vellumine.functions import lines as L

    df = spark.createDataFrame([(bad,)], "t string")
    assert df.select(L.no_degree(df["t"]).alias("x")).first()["x"]


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_positions_read_a_text_once(spark, tmp_path):
    """Failed before: positions with and without dates each read the texts, and found their blocks, anew."""
    spark.createDataFrame([(1, PART), (2, None)], "id int, t string").write.parquet(str(tmp_path / "docs"))
    plan = _plan(P.positions(spark.read.parquet(str(tmp_path / "docs")), "id", "t", W))
    assert plan.count("FileScan") == 1 and "Exchange" not in plan


def test_degrees_read_a_text_once(spark, tmp_path):
    """Failed before: parts and whole texts were read apart, grouped and joined by id."""
    spark.createDataFrame([(1, EDUCATION, "x"), (2, None, None)], "id int, t string, f string").write.parquet(str(tmp_path / "docs"))
    plan = _plan(D.degrees(spark.read.parquet(str(tmp_path / "docs")), "id", "t", W, "f"))
    assert plan.count("FileScan") == 1 and "Exchange" not in plan
