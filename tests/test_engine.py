"""Columns, operators and documents: behaviour of the language, error codes, both modes against each other."""

import math

import duckdb
import pytest
from itemflow import catalog_columns, catalog_operators
from itemflow.engine import Engine, Rows
from itemflow.errors import EngineError, Unsupported
from itemflow.functions import pictures, regex
from itemflow.operators import grouping, joins, nodes, ordering
from itemflow.perdoc.evaluate import evaluate, string_of
from itemflow.perdoc.tree import parse_html, parse_xml
from itemflow.plans import xpath as X
from itemflow.sources.documents import Reader, schema_of_xsd, shred
from pyspark.sql import functions as F

DOC = '<r xmlns:p="u"><a id="1" k="x">hi<b>1</b></a><a id="2">yo<b>2</b><b>3</b></a><p:c/><!--z--><?t d?></r>'


@pytest.fixture(scope="module")
def doc():
    return parse_xml(DOC)


def ev(e, item=None, **variables):
    return [v if not hasattr(v, "kind") or not hasattr(v, "children") else v.string() for v in evaluate(e, item, {k: v if isinstance(v, list) else [v] for k, v in variables.items()})]


def strings(e, item=None):
    return [string_of(v) for v in evaluate(e, item)]


@pytest.mark.parametrize(
    ("expression", "want"),
    [
        ("//b", ["1", "2", "3"]),
        ("//a[2]/b[last()]", ["3"]),
        ("/r/a/@id", ["1", "2"]),
        ("//b/ancestor::*[1]/@id", ["1", "2"]),
        ("(//b)[2]/preceding::b", ["1"]),
        ("(//b)[1]/following::b", ["2", "3"]),
        ("//b[1]/following-sibling::b", ["3"]),
        ("//b[last()]/preceding-sibling::b", ["2"]),
        ("name(//*[namespace-uri() = 'u'])", ["p:c"]),
        ("//comment() | //processing-instruction('t')", ["z", "d"]),
        ("count(//namespace::*)", ["14"]),
        ("//a except //a[@k]", ["yo23"]),
        ("//a intersect //*[@k]", ["hi1"]),
        ("(//b)[1] << (//b)[2]", ["true"]),
        ("//a[1] is //a[@k = 'x']", ["true"]),
        ("id('2')/b[1]", ["2"]),
        ("outermost(//*)/name()", ["r"]),
        ("innermost(//*)/name()", ["b", "b", "b", "p:c"]),
        ("path((//b)[3])", ["/Q{}r[1]/Q{}a[2]/Q{}b[2]"]),
        ("//b = 2", ["true"]),
        ("//b > 3", ["false"]),
        ("sum(//b)", ["6"]),
        ("avg((1, 2, 4))", ["2.333333333333333333333333333"]),
        ("1 div 4, 7 idiv -2, -7 mod 3, 1e0 div 0, xs:float(1) div 3", ["0.25", "-3", "-1", "INF", "0.33333334"]),
        ("round(-2.5), round(2.5), round-half-to-even(2.5), round(1234.567, 1), ceiling(-0.5e0)", ["-2", "3", "2", "1234.6", "-0"]),
        ("1e7, 1e6, 123456.5, 1e-7, 0.1e0, 1e100", ["1.0E7", "1.0E6", "123456.5", "1.0E-7", "0.1", "1.0E100"]),
        ("substring('12345', 1.5, 2.6), substring('12345', 0, 3), substring('12345', -42, 1 div 0e0)", ["234", "12", "12345"]),
        ("substring-before('a#b', '#'), substring-after('a#b', '#'), translate('bar', 'abc', 'AB')", ["a", "b", "BAr"]),
        ("tokenize(' a b '), tokenize('a,b,,c', ','), replace('abc', '(b)', '[$1]')", ["a", "b", "a", "b", "", "c", "a[b]c"]),
        ("string-join(('a', 'b'), '-'), upper-case('ß'), normalize-space(' a  b ')", ["a-b", "SS", "a b"]),
        ("compare('a', 'b'), codepoints-to-string((72, 228)), string-to-codepoints('€')", ["-1", "Hä", "8364"]),
        ("distinct-values((1, 1.0, '1', xs:double('NaN'), xs:double('NaN')))", ["1", "1", "NaN"]),
        ("sort((3, 1, 2)), sort(('b', 'A'), 'http://www.w3.org/2005/xpath-functions/collation/html-ascii-case-insensitive')", ["1", "2", "3", "A", "b"]),
        ("fold-left(1 to 4, 0, function($a, $b) {$a + $b}), fold-right((1, 2), '', concat#2)", ["10", "12"]),
        ("for-each-pair((1, 2), (3, 4), function($x, $y) {$x * $y}), filter(1 to 5, function($x) {$x gt 3})", ["3", "8", "4", "5"]),
        ("let $f := concat(?, '!') return $f('x'), (1 to 3) ! (. * 2), 'a' => concat('b')", ["x!", "2", "4", "6", "ab"]),
        ("map{'a': 1, 'b': (2, 3)}?b, [1, [2]](2)?1, array{1 to 3}?*", ["2", "3", "2", "1", "2", "3"]),
        ("map:merge((map{'a': 1}, map{'a': 2}), map{'duplicates': 'combine'})?a", ["1", "2"]),
        ("array:flatten([1, [2, 3]]), array:size(array:subarray([1, 2, 3], 2)), array:sort([3, 1])?1", ["1", "2", "3", "2", "1"]),
        ("xs:date('2024-01-31') + xs:yearMonthDuration('P1M'), xs:dateTime('2024-01-01T00:00:00Z') - xs:dateTime('2023-12-31T12:00:00Z')", ["2024-02-29", "PT12H"]),
        ("adjust-dateTime-to-timezone(xs:dateTime('2024-01-01T00:00:00Z'), xs:dayTimeDuration('-PT5H')), xs:time('10:00:00+01:00') = xs:time('09:00:00Z')", ["2023-12-31T19:00:00-05:00", "true"]),
        ("format-date(xs:date('2024-03-05'), '[D1o] [MNn] [Y]'), format-number(1234.5, '#,##0.00'), format-integer(21, 'Ww')", ["5th March 2024", "1,234.50", "Twenty One"]),
        ("parse-json('{\"a\": [1, {\"b\": null}]}')?a?1, xml-to-json(json-to-xml('{\"a\": [1, true]}'))", ["1", '{"a":[1,true]}']),
        ("serialize(parse-xml('<a b=\"&lt;\"/>')), serialize(map{'a': 1}, map{'method': 'json'})", ['<a b="&lt;"/>', '{"a":1}']),
        ("analyze-string('a1b', '\\d')/*/name(), contains-token('a b', 'b'), deep-equal([1, 2], [1, 2])", ["fn:non-match", "fn:match", "fn:non-match", "true", "true"]),
        ("5 instance of xs:decimal, 'x' instance of xs:integer, () instance of empty-sequence(), [1] instance of array(xs:integer)", ["true", "false", "true", "true"]),
        ("some $x in (1, 2) satisfies $x = 2, every $x in () satisfies false(), if (()) then 1 else 2", ["true", "true", "2"]),
        ("function-arity(abs#1), function-lookup(xs:QName('fn:abs'), 1)(-3), apply(concat#2, ['a', 'b'])", ["1", "3", "ab"]),
        ("string(random-number-generator('s')?number) = string(random-number-generator('s')?number)", ["true"]),
        ("QName('u', 'p:x') = QName('u', 'q:x'), local-name-from-QName(QName('u', 'p:x')), resolve-uri('../x', 'http://e/a/b')", ["true", "x", "http://e/x"]),
    ],
)
def test_xpath_documents(doc, expression, want):
    assert strings(expression, doc) == want


@pytest.mark.parametrize(
    ("expression", "code"),
    [
        ("1 div 0", "FOAR0001"), ("xs:integer('x')", "FORG0001"), ("1 + 'a'", "XPTY0004"), ("$nope", "XPST0008"), ("nope()", "XPST0017"), ("1 +", "XPST0003"), ("exactly-one(())", "FORG0005"),
        ("[1](2)", "FOAY0001"), ("map{'a': 1, 'a': 2}", "XQDY0137"), ("matches('a', '(?=a)')", "FORX0002"), ("replace('a', 'a*', 'b')", "FORX0003"), ("error(xs:QName('err:X'))", "X"), ("doc('x')", "FODC0002"),
        ("xs:date('2024-02-30')", "FORG0001"), ("sum(('a', 'b'))", "FORG0006"), ("(1, 2) treat as xs:integer", "XPDY0050"), ("parse-json('{')", "FOJS0001"), ("parse-xml('<a>')", "FODC0006"), ("p:x", "XPST0081"),
        ("codepoints-to-string(0)", "FOCH0001"), ("1 to 10000000", "FOAR0002"), ("data(abs#1)", "FOTY0013"), ("'a'/b", "XPTY0019"), ("boolean((1, 2))", "FORG0006"),
    ],
)
def test_error_codes(doc, expression, code):
    with pytest.raises(EngineError) as x:
        evaluate(expression, doc)
    assert x.value.code == code


SAME = [
    "1 + 2 * 3", "7 idiv 2, -7 mod 3", "string(1 div 4)", "round(2.5), round(-2.5)", "substring('motor', 2, 3), substring('metadata', 4)", "string-join(('a', 'b'), '+')", "upper-case('abc') || lower-case('X')",
    "count((1 to 10)[. mod 2 = 0])", "sum(for $i in 1 to 4 return $i * $i)", "some $x in (1, 2, 3) satisfies $x > 2", "fold-left(1 to 4, 0, function($a, $b) {$a + $b})", "map{'a': 1}?a + [1, 2]?2",
    "string(xs:date('2024-01-31') + xs:yearMonthDuration('P1M'))", "string(xs:dayTimeDuration('P1DT2H') * 2)", "year-from-date(xs:date('2024-05-06'))", "translate('bar', 'abc', 'AB')", "tokenize('a b c')", "matches('abc', '^a.c$')",
    "replace('abc', '[bc]+', '-')", "normalize-space('  a   b ')", "compare('a', 'b')", "index-of((10, 20, 10), 10)", "subsequence(1 to 10, 3, 2)", "reverse((1, 2, 3))", "sort((3, 1, 2))", "distinct-values((1, 2, 1))", "string-to-codepoints('AB')",
    "array:size([1, 2, 3])", "map:size(map{'a': 1, 'b': 2})", "format-number(1234.5, '#,##0.00')", "string(1e0 div 0)", "abs(-3), floor(2.7), ceiling(2.1)", "insert-before((1, 2), 2, 9)", "remove((1, 2, 3), 2)", "head((4, 5)), count(tail((4, 5)))",
    "if (1 = (1, 2)) then 'y' else 'n'", "'a' => concat('b')", "(1 to 3) ! (. + 1)", "string(xs:double('1e7'))", "starts-with('abc', 'a') and not(contains('abc', 'z'))", "avg((1, 2, 3)) = 2", "min((3, 1)), max((3, 1))", "for-each(1 to 3, function($x) {$x * 2})",
    "let $x := 5 return $x * $x", "xs:integer('42') + 1", "string(xs:time('10:20:30'))", "5 castable as xs:date, '2024-01-01' castable as xs:date", "deep-equal((1, 2), (1, 2))", "array:reverse([1, 2])?1",
]


@pytest.mark.parametrize("expression", SAME)
def test_columns_and_documents_agree(spark, expression):
    """The same expression compiled to a column and evaluated in Python."""
    want = []
    for v in evaluate(expression):
        want.append(string_of(v))
    rows = Rows(spark.range(1))
    v = rows.value(f"string-join(({expression}) ! string(.), '|')")
    from itemflow.plans.values import one

    assert spark.range(1).select(one(v)).first()[0] == "|".join(want)


def test_column_errors(spark):
    rows = Rows(spark.range(3))
    with pytest.raises(Exception, match="FOAR0001"):
        rows.select(a="1 div (id - id)").collect()
    with pytest.raises(Exception, match="FORG0001"):
        rows.select(a="xs:integer(concat('x', id))").collect()
    for e, error in (("nope()", EngineError), ("$x", EngineError), ("//a", Unsupported), ("id | id", Unsupported), ("'a' + 1", EngineError)):
        with pytest.raises(error):
            rows.column(e)


def test_columns_push_down(spark, data):
    """Filters and projections reach the scan."""
    plan = Engine(spark, data).rows("part").where("p_size > 25").select(a="p_name")._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(p_size" in plan and "p_retailprice" not in plan and "Python" not in plan


def test_group_modes(spark):
    rows = Rows(spark.createDataFrame([(1, i, k) for i, k in enumerate("aabbbac")], "g int, i int, k string"))
    runs = grouping.group_adjacent(rows, ["g"], ["i"], "k", {"n": ("count", "."), "ids": ("items", "i")}).orderBy("group_no").collect()
    assert [(r.grouping_key, r.n, list(r.ids)) for r in runs] == [("a", 2, [0, 1]), ("b", 3, [2, 3, 4]), ("a", 1, [5]), ("c", 1, [6])]
    start = grouping.group_starting_with(rows, ["g"], ["i"], "k = 'b'", {"n": ("count", ".")}).orderBy("group_no").collect()
    assert [r.n for r in start] == [2, 1, 1, 3]
    end = grouping.group_ending_with(rows, ["g"], ["i"], "k = 'b'", {"n": ("count", ".")}).orderBy("group_no").collect()
    assert [r.n for r in end] == [3, 1, 1, 2]
    nan = Rows(spark.createDataFrame([(math.nan,), (math.nan,), (0.0,), (-0.0,)], "x double"))
    assert sorted(r.n for r in grouping.group_by(nan, {"x": "x"}, {"n": ("count", ".")}).collect()) == [2, 2]
    with pytest.raises(Exception, match="XTTE1100"):
        grouping.group_adjacent(Rows(spark.createDataFrame([(1, 1, None)], "g int, i int, k string")), ["g"], ["i"], "k", {}).collect()


def test_sort_order(spark):
    rows = Rows(spark.createDataFrame([(1, 2.0), (2, None), (3, math.nan), (4, -1.0)], "i int, x double"))
    assert [r.i for r in ordering.sort(rows, "x").collect()] == [2, 3, 4, 1]
    assert [r.i for r in ordering.sort(rows, ("x", {"order": "descending"})).collect()] == [1, 4, 3, 2]
    words = Rows(spark.createDataFrame([("b",), ("A",), ("a",)], "w string"))
    assert [r.w for r in ordering.sort(words, ("w", {"case_order": "upper-first"})).collect()] == ["A", "a", "b"]
    numbers = Rows(spark.createDataFrame([("10",), ("9",), ("x",)], "w string"))
    assert [r.w for r in ordering.sort(numbers, ("w", {"data_type": "number"})).collect()] == ["x", "9", "10"]


def test_joins(spark):
    a = Rows(spark.createDataFrame([(1, ["x", "y", "x"]), (2, [])], "i int, ks array<string>"))
    b = Rows(spark.createDataFrame([("x", 10), ("y", 20)], "k string, v int"))
    assert sorted((r.i, r.v) for r in joins.lookup(a, "ks", b, "k", columns={"v": "v"}).collect()) == [(1, 10), (1, 20)]
    merged = joins.merge({"l": (b, "k"), "r": (Rows(spark.createDataFrame([("y", 1), ("z", 2), ("y", 3)], "k string, w int")), "k")}, {"v": ("l", "sum", "v"), "w": ("r", "sum", "w")}).collect()
    assert [(r.merge_key, r.v, r.w, r.in_l, r.in_r) for r in merged] == [("x", 10, None, True, False), ("y", 20, 4, True, True), ("z", None, 2, False, True)]


def test_node_table(spark):
    df = spark.createDataFrame([(1, DOC), (2, "<broken"), (3, None)], "k long, x string")
    table = shred(df, "k", "x").cache()
    assert {r.doc_id for r in table.collect()} == {1}
    doc = parse_xml(DOC)
    for axis in nodes.conditions():
        got = nodes.pairs(nodes.path(table, ("descendant", "b")), table, axis, kind=None).count()
        want = sum(len(evaluate(f"{axis}::node()", b)) for b in evaluate("//b", doc))
        assert got == want, axis
    strings_ = nodes.string_value(nodes.path(table, ("descendant", "a")), table).orderBy("pre").collect()
    assert [r.string for r in strings_] == ["hi1", "yo23"]


def test_transform_errors_and_access(spark):
    head = '<xsl:stylesheet version="3.0" xmlns:xsl="http://www.w3.org/1999/XSL/Transform">'
    e = Engine(spark)
    df = spark.createDataFrame([(1, "<a/>"), (2, "<b"), (3, None)], "k long, x string")
    got = {r.doc_id: r for r in e.transform(df, "k", "x", head + '<xsl:template match="/"><ok/></xsl:template></xsl:stylesheet>').collect()}
    assert got[1].error is None and got[1].result.endswith("<ok/>") and got[2].error == "FODC0006" and got[3].result is None
    closed = e.transform(df.where("k = 1"), "k", "x", head + "<xsl:template match='/'><xsl:sequence select=\"doc('file:///etc/passwd')\"/></xsl:template></xsl:stylesheet>").first()
    assert closed.error == "FODC0002"
    opened = e.transform(df.where("k = 1"), "k", "x", head + "<xsl:import href='m'/><xsl:template match='/'><xsl:call-template name='t'/></xsl:template></xsl:stylesheet>", modules={"m": head + "<xsl:template name='t'><xsl:value-of select=\"doc('d')/x\"/></xsl:template></xsl:stylesheet>"}, documents={"d": "<x>in</x>"}).first()
    assert opened.result.endswith("in")
    with pytest.raises(EngineError):
        Reader(spark, ["/data"]).allowed("/data/../etc/passwd")
    assert Reader(spark, ["/data"]).allowed("/data/x") == "/data/x"


def test_sources(spark, tmp_path):
    (tmp_path / "p.xml").write_text("<ps><p id='1'><n>a</n></p><p id='2'><n>b</n></p></ps>")
    (tmp_path / "l.txt").write_text("one\ntwo\n")
    r = Reader(spark, [str(tmp_path)])
    assert [(x._id, x.n) for x in r.xml_rows(str(tmp_path / "p.xml"), "p", "_id int, n string").orderBy("_id").collect()] == [(1, "a"), (2, "b")]
    assert r.text(str(tmp_path / "l.txt"), whole=False).count() == 2
    assert r.collection(str(tmp_path), "*.xml").count() == 1
    xsd = '<xs:schema xmlns:xs="http://www.w3.org/2001/XMLSchema"><xs:element name="p"><xs:complexType><xs:sequence><xs:element name="n" type="xs:string"/><xs:element name="t" type="xs:date" maxOccurs="unbounded"/></xs:sequence><xs:attribute name="id" type="xs:integer"/></xs:complexType></xs:element></xs:schema>'
    assert schema_of_xsd(xsd, "p") == "`n`: string, `t`: array<date>, `_id`: bigint"


def test_pictures_and_patterns():
    assert pictures.format_number(0.14, "01%") == "14%" and pictures.format_number(-5, "0;(0)") == "(5)" and pictures.format_number(float("nan"), "0") == "NaN"
    assert pictures.format_integer(1999, "I") == "MCMXCIX" and pictures.format_integer(27, "a") == "aa" and pictures.format_integer(3, "w;o") == "third"
    assert pictures.format_stamp("2024-03-05T14:07:09.5+01:00", "[h].[m01][Pn] [Z] [FNn,3-3]") == "2.07pm +01:00 Tue"
    assert regex.to_java(r"\i\c*", "i") and regex.to_python("[a-z-[aeiou]]+").fullmatch("xyz")
    with pytest.raises(EngineError):
        regex.to_java("(a")
    assert X.parse("a[1]/@b") == X.parse("a [ 1 ] / @ b")
    assert parse_html("<p>a<p>b<br>c").children[1].string() == "bc"


def test_catalogue_is_paired():
    assert set(catalog_columns.oracle_sql()) == set(catalog_columns.queries()) and set(catalog_operators.oracle_sql()) == set(catalog_operators.queries())


def test_iterate_state(spark):
    rows = Rows(spark.createDataFrame([(p, i) for p in range(3) for i in range(5)], "p int, i int"))
    got = ordering.iterate(rows, ["p"], ["i"], {"s": 0}, lambda r, s: ({"s": s["s"] + r["i"]}, {"p": r["p"], "i": r["i"], "s": s["s"] + r["i"]}, r["i"] < 3), "p int, i int, s int").collect()
    assert sorted((r.p, r.i, r.s) for r in got) == [(p, i, i * (i + 1) // 2) for p in range(3) for i in range(4)]
    assert ordering.accumulator(rows, ["p"], ["i"], "i").where(F.col("value_after") != F.col("value_before") + F.col("i")).count() == 0


def test_zones_and_json_in_columns(spark, data):
    """Zoned text in a column, zones of both kinds in one column, and typed JSON; errors keep their codes."""
    df = spark.createDataFrame([(1, "2024-01-01T00:30:00Z", '{"a": [1, "x", null], "b": {"c": 2.5}}'), (2, "2023-12-31T19:30:00-05:00", "[1]"), (3, "2024-01-01T00:30:00", None), (4, None, "null")], "id int, at string, doc string")
    rows = Rows(df)
    got = rows.select(id="id", same="xs:dateTime(at) = xs:dateTime('2024-01-01T00:30:00Z')", day="string(xs:date(xs:dateTime(at)))", zone="string(timezone-from-dateTime(xs:dateTime(at)))", value="xs:dateTime(at)").orderBy("id").collect()
    assert [tuple(r) for r in got] == [(1, True, "2024-01-01Z", "PT0S", "2024-01-01T00:30:00Z"), (2, True, "2023-12-31-05:00", "-PT5H", "2023-12-31T19:30:00-05:00"), (3, True, "2024-01-01", "", "2024-01-01T00:30:00"), (4, False, "", "", None)]
    json = rows.select(id="id", one="parse-json(doc)?a?1", c="parse-json(doc)?b?c + 1", n="count(parse-json(doc)?*)", raw="parse-json(doc)").orderBy("id").collect()
    assert [tuple(r) for r in json] == [(1, "1", 3.5, 2, '{"a":[1,"x",null],"b":{"c":2.5}}'), (2, None, None, 1, "[1]"), (3, None, None, 0, None), (4, None, None, 0, None)]
    grouped = grouping.group_by(rows.where("exists(at)"), {"instant": "xs:dateTime(at)"}, {"n": ("count", ".")}).collect()
    assert [r.n for r in grouped] == [3]
    for bad, code in (("serialize(map{'a': 1})", "SENR0001"), ("adjust-dateTime-to-timezone(xs:dateTime(at), xs:dayTimeDuration('PT15H'))", "FODT0003"), ("string(parse-json(doc))", "FOTY0014"), ("xs:dateTime(concat(at, 'x'))", "FORG0001"), ("dateTime(xs:date('2024-01-01Z'), xs:time('10:00:00+01:00'))", "FORG0008")):
        with pytest.raises(Exception, match=code):
            rows.select(x=bad).collect()


def test_text_of_numbers_from_a_million(spark):
    """Doubles from a million on have an exponent, whether of a column or of JSON; integers have none."""
    values = [999999.5, 1e6, -1e6, 1200000.0, 1234567.5, -5999999.0, 9999999.875, 1e7, 123456789.0]
    want = ["999999.5", "1.0E6", "-1.0E6", "1.2E6", "1.2345675E6", "-5.999999E6", "9.999999875E6", "1.0E7", "1.23456789E8"]
    rows = Rows(spark.createDataFrame([(i, v, f"[{v!r}]") for i, v in enumerate(values)], "i int, d double, doc string"))
    got = rows.select(i="i", d="string(d)", f="string(xs:float(d))", json="string(parse-json(doc)?1)", shown="parse-json(doc)?1", whole="string(xs:integer(parse-json(doc)?1))").orderBy("i").collect()
    assert [r.d for r in got] == [r.json for r in got] == [r.shown for r in got] == want
    assert [r.f for r in got] == want[:6] + ["1.0E7", "1.0E7", "1.23456792E8"]
    assert [r.whole for r in got] == [str(int(v)) for v in values]


def test_json_numbers_beyond_a_million(spark, tmp_path):
    """The query against its SQL on ids of seven digits."""
    spark.createDataFrame([(i, i % 50) for i in (0, 999999, 1000000, 1234567, 5999999, 12345678)], "event_id long, user_id long").write.parquet(str(tmp_path / "events.parquet"))
    with duckdb.connect() as c:
        c.execute(f"CREATE VIEW events AS SELECT * FROM read_parquet('{tmp_path}/events.parquet/*.parquet')")
        want = c.execute(catalog_columns.oracle_sql()["json_numbers"]).fetchall()
    got = [tuple(r) for r in catalog_columns.queries()["json_numbers"](spark, str(tmp_path)).collect()]
    assert sorted(got) == sorted(want)


def test_pictures_that_spark_formats(spark):
    """Against the general formatter, on ties, large and small numbers, none and the odd ones."""
    from itemflow.functions import library

    values = [0.0, -0.0, 0.125, 0.375, 1.005, 2.675, -1.015, 1234567.891, -0.001, 1e-7, 123456789012.345, 1e19, 1.5e21, 99.995, float("nan"), float("inf"), float("-inf"), None]
    df = Rows(spark.createDataFrame([(i, v, None if v is None or v != v or abs(v) > 1e12 else int(v)) for i, v in enumerate(values)], "i int, d double, n long"))
    for picture in ("#,##0.00", "0", "0.0", "#,##0", "##0.000"):
        assert library.plain_picture(picture)
        for r in df.select(i="i", d="d", n="n", x=f"format-number(d, '{picture}')", y=f"format-number(n, '{picture}')", z=f"format-number(xs:decimal(n) div 8, '{picture}')").collect():
            assert r.x == pictures.format_number("NaN" if r.d is None else str(r.d), picture), (r.d, picture)
            assert r.y == pictures.format_number("NaN" if r.n is None else str(r.n), picture), (r.n, picture)
            assert r.z == pictures.format_number("NaN" if r.n is None else f"{__import__('decimal').Decimal(r.n) / 8:f}", picture), (r.n, picture)
    whole = Rows(spark.createDataFrame([(0,), (7,), (-7,), (12345,), (-1234567,), (None,)], "n long"))
    for picture in ("000", "0", "#0", "#,##0", "00000000"):
        for r in whole.select(n="n", x=f"format-integer(n, '{picture}')").collect():
            assert r.x == ("" if r.n is None else pictures.format_integer(r.n, picture)), (r.n, picture)
    assert library.plain_picture("0.0#") is None and library.plain_picture("#,##0;(0)") is None
