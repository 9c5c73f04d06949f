import re

from hypothesis import given, settings
from hypothesis import strategies as st

from tiltyard.operators import badrows as B

PAT = {f.name: re.compile(f.pattern.replace(r"\p{L}", r"[^\W\d_]")) for f in B.RATINGS.fields if f.reason}
GOOD = "Ann Lee,1,22,1500.5,30,1400,2024-02-29,2"
CASES = {
    GOOD: None,
    '"Lee, Ann",1,,1500,30,1400,,2': None,
    '"Ann ""Ace"" Lee",1,,1500,30,1400,,': None,
    '"Ann Lee,1,,1500,30,1400,,2': "quoting",
    '"Ann "Ace" Lee",1,,1500,30,1400,,2': "quoting",
    '"Ann Lee" jr,1,,1500,30,1400,,2': "quoting",
    "Ann,1,,1500": "columns",
    GOOD + ",": "columns",
    "???,1,,1500,30,1400,,2": "name",
    "Ann,1,0,1500,30,1400,,2": "ifpa_id",
    "Ann,1,12 345,1500,30,1400,,2": "ifpa_id",
    "Ann,1,,,30,1400,,2": "rating",
    "Ann,1,,1e5,30,1400,,2": "rating",
    "Ann,1,, 1500 ,30,1400,,2": None,
    "Ann,1,,1500,30,1400,2023-02-29,2": "last_rating_period",
    "Ann,1,,1500,30,1400,2023-2-9,2": "last_rating_period",
}


def test_each_reason():
    for line, reason in CASES.items():
        assert B.diagnose(line, B.RATINGS, PAT)[0] == reason, line


def test_operator_equals_strict_parser_on_all_positions(spark):
    lines = [k for _ in range(40) for k in CASES] + [None, "", "   ", "Name,User ID,IFPA ID,Rating,RD,Lower Bound,Last Rating Period,Rating class", "x" * 200_000]
    df = spark.createDataFrame([(i, x, "clash") for i, x in enumerate(lines)], "row_id long, raw_line string, reason string")
    got = {r.id: r.reason for r in B.parse_records(df, "row_id", "raw_line", B.RATINGS).collect()}
    want = {i: CASES[x] for i, x in enumerate(lines) if x in CASES} | {len(lines) - 1: "columns"}
    assert got == want


def test_empty_and_typed(spark):
    df = spark.createDataFrame([], "row_id long, raw_line string")
    assert B.rejected(B.parse_records(df, "row_id", "raw_line", B.RATINGS), "row_id").count() == 0
    one = spark.createDataFrame([(7, '"Lee, Ann",1,,1500.50,30,1400,2024-01-02,')], "row_id long, raw_line string")
    r = B.typed(B.parse_records(one, "row_id", "raw_line", B.RATINGS), B.RATINGS, "row_id").first()
    assert (r.row_id, r.name, r.user_id, r.ifpa_id, r.rating, str(r.last_rating_period), r.rating_class) == (7, "Lee, Ann", 1, None, 1500.5, "2024-01-02", None)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet='ab", ', max_size=6), min_size=1, max_size=6))
def test_split_round_trip(fields):
    line = ",".join('"' + f.replace('"', '""') + '"' for f in fields)
    assert B.split_record(line) == fields


def test_only_failing_lines_reach_the_strict_parser(spark):
    import pyarrow as pa

    lines = [GOOD] * 3000 + [k for k, r in CASES.items() if r] * 20 + ['"Lee, Ann",1,,1500,30,1400,,2'] * 500
    out, strict = [], []
    B._parse_block(pa.array(range(len(lines))), pa.array(lines), B.RATINGS, out, strict)
    bad = sum(1 for x in lines if CASES.get(x))
    assert sum(len(i) for i, _ in strict) == bad and sum(len(i) for i, _ in out) == len(lines) - bad


def test_a_block_the_bulk_parser_refuses_is_halved(monkeypatch):
    import pyarrow as pa

    real = B._bulk
    monkeypatch.setattr(B, "_bulk", lambda x, spec: None if GOOD + "7" in x.to_pylist() else real(x, spec))
    out, strict = [], []
    B._parse_block(pa.array(range(101)), pa.array([GOOD] * 60 + [GOOD + "7"] + [GOOD] * 40), B.RATINGS, out, strict)
    assert [x.to_pylist() for i, x in strict if len(i)] == [[GOOD + "7"]] and sum(len(i) for i, _ in out) == 100


def test_values_that_do_not_fit_their_type_are_named(spark):
    one = spark.createDataFrame([(7, "Ann,x1,,1500,n/a,,,2"), (8, GOOD)], "row_id long, raw_line string")
    got = {r.row_id: (r.user_id, r.rd, r.unread) for r in B.typed(B.parse_records(one, "row_id", "raw_line", B.RATINGS), B.RATINGS, "row_id").collect()}
    assert got == {7: (None, None, "user_id,rd"), 8: (1, 30.0, None)}
