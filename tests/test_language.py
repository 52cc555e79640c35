import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from leafline.functions import scalars, values
from leafline.functions.expressions import ExpressionError, free_names, parse
from leafline.operators import query
from leafline.sources import records


@pytest.fixture(scope="module")
def recs(spark):
    rows = [(0, "todo", "alta", 3, True, None), (1, "done", "baja", None, False, "x"), (2, "done", "media", 10, None, "10"), (3, None, "otra", 7, True, "9x")]
    df = spark.createDataFrame(rows, "id int, estado string, prioridad string, score int, active boolean, mixed string")
    return records.lift(df, F.concat(F.lit("d/r"), F.col("id").cast("string"), F.lit(".md")), ["id", "estado", "prioridad", "score", "active", "mixed"], order=F.col("id").cast("long"))


def ids(df):
    return [r[0] for r in df.select(query.effective("id")["num"].cast("int")).collect()]


CONDITIONS = [
    ('estado == "done"', [1, 2]), ('estado != "done"', [0, 3]), ("estado == nil", [3]), ("estado != nil && score > 5", [2]), ('estado in ["todo", "x"]', [0]),
    ('estado not in ["todo"]', [1, 2, 3]), ("active", [0, 3]), ("!active", [1, 2]), ("score > 5 || active == true", [0, 2, 3]), ('score == "3"', []), ("estado == 1", []),
    ("(score ?? 0) < 5", [0, 1]), ('estado contains "on"', [1, 2]), ('path startsWith "d/r1"', [1]), ("score % 2 == 1", [0, 3]), ('estado matches "^t"', [0]),
    ('active ? score > 5 : estado == "done"', [1, 2, 3]), ("not (estado == nil)", [0, 1, 2]), ("missing > 3", []), ('len(prioridad) == 4 and type == "row"', [0, 1, 3]),
]


@pytest.mark.parametrize("text, want", CONDITIONS)
def test_conditions(recs, text, want):
    assert sorted(ids(query.where(recs, text))) == want


def test_bad_expressions():
    for text in ("a ==", "(a", "a = = b", "{", "a ? b"):
        with pytest.raises(ExpressionError):
            parse(text)
    assert free_names(parse("a == b && all(c, {.d == e})")) == {"a", "b", "c", "e"}


def test_several_conditions_are_each_parsed(recs):
    assert sorted(ids(query.where(recs, 'estado == "todo" || score == 10', "active == true"))) == [0]
    assert sorted(ids(query.where(recs, 'estado == "todo" || score == 10', "active == true", compat=True))) == [0]


def test_sort(recs):
    enums = {"prioridad": ["alta", "media", "baja"]}
    assert ids(query.sort(recs, "prioridad", enums=enums)) == [0, 2, 1, 3]
    assert ids(query.sort(recs, "prioridad:desc", enums=enums)) == [3, 1, 2, 0]
    assert ids(query.sort(recs, "score:desc")) == [2, 3, 0, 1]
    assert ids(query.sort(recs, "score")) == [0, 3, 2, 1]
    assert ids(query.sort(recs, "mixed")) == [2, 3, 1, 0]
    for bad in ("a:b:c", "a:up", ":asc"):
        with pytest.raises(ValueError):
            query.parse_sort(bad)
    with pytest.raises(ValueError, match="score"):
        query.check_sort(query.parse_sort("scor"), {"score"})


def test_order_of_input_does_not_matter(recs):
    for n in (1, 7):
        assert ids(query.sort(recs.repartition(n), "estado:desc,score")) == ids(query.sort(recs, "estado:desc,score"))


def test_unknown_names(recs):
    known = query.known_names(recs)
    assert query.unknown_names('estadoo == "x" && score > 1', known) == [("estadoo", "estado")]


def test_scalars(spark):
    df = spark.createDataFrame([("Mi Título  x!", "a.md")], "s string, p string")
    row = df.select(scalars.slugify(F.col("s")), scalars.byte_length(F.lit("título")), scalars.glob_match(F.col("p"), "*.md"), scalars.glob_match(F.lit("a/b.md"), "*.md"), scalars.heading_slug(F.lit("A b-C_d!"))).first()
    assert tuple(row) == ("mi-t-tulo-x", 7, True, False, "a-b-c_d")
    assert scalars.closest("estdo", ["estado", "tipo"]) == "estado" and scalars.closest("zzzzzz", ["estado"]) is None


def test_text_forms():
    pairs = {1e6: "1e+06", 1e21: "1e+21", 0.00001: "1e-05", 1.5: "1.5", 2.0: "2"}
    pairs[1e6] = "1000000"
    for x, want in pairs.items():
        assert values.text_of(x) == want
    assert values.text_of([1, "a", None]) == "[1 a <nil>]" and values.text_of({"b": 1, "a": True}) == "map[a:true b:1]"


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab*?[]^-/\\.", max_size=8))
def test_globs_never_crash(pattern):
    import re

    regex = scalars.glob_regex(pattern)
    if regex is not None:
        try:
            re.compile(regex)
        except re.error:
            pass
