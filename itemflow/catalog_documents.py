"""Queries on documents: node tables and axes, stylesheets, serialization, streaming."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .engine import Engine
from .operators import nodes
from .streaming import running

_queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_sql: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        _queries[f.__name__] = lambda spark, sf_dir: f(Engine(spark, sf_dir))
        if sql:
            _sql[f.__name__] = sql
        return f

    return add


def _pages(e: Engine) -> DataFrame:
    return e.shred(e.table("pages"), "page_id", "html", "html")


def _xml(e: Engine) -> DataFrame:
    """Parts as XML documents: <parts brand=".."><part id=".." size=".."><name>..</name></part>..</parts>.

    A document has the parts of one brand among a thousand keys, so documents grow in number with the table, not in size.
    """
    part = F.format_string('<part id="p%d" size="%d"><name>%s</name></part>', "p_partkey", "p_size", "p_name")
    rows = e.table("part").groupBy("p_brand", F.floor(F.col("p_partkey") / 1000).alias("block")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("p_partkey", part.alias("x")))), lambda s: s["x"]), "").alias("parts"), F.min("p_partkey").alias("doc_id"))
    return rows.select("doc_id", F.concat(F.lit('<parts brand="'), "p_brand", F.lit('">'), "parts", F.lit("</parts>")).alias("xml"))


def _table(e: Engine) -> DataFrame:
    return e.shred(_xml(e), "doc_id", "xml")


def _attributes(context: DataFrame, table: DataFrame) -> DataFrame:
    """The attributes of the nodes: doc_id, name and value, which tell the nodes themselves apart."""
    return nodes.step(context, table, "attribute").select("doc_id", "name", "value")


def _sized(table: DataFrame, size: int) -> DataFrame:
    """The parts of a size."""
    return nodes.step(table.where(f"kind = 'attribute' and name = 'size' and value = '{size}'"), table, "parent")


#: Parts with the id and number of their document, as tables of attributes.
_DOCS = "WITH d AS (SELECT *, min(p_partkey) OVER (PARTITION BY p_brand, p_partkey // 1000) AS doc_id, row_number() OVER (PARTITION BY p_brand, p_partkey // 1000 ORDER BY p_partkey) AS i, count(*) OVER (PARTITION BY p_brand, p_partkey // 1000) AS c FROM part) "
_IDS = "SELECT doc_id, 'id' AS name, 'p' || p_partkey AS value FROM d WHERE {0} UNION ALL SELECT doc_id, 'size', p_size::VARCHAR FROM d WHERE {0}"
_BRAND = "SELECT DISTINCT doc_id, 'brand' AS name, p_brand AS value FROM d WHERE {}"


_LINKS = "SELECT page_id AS doc_id, unnest(regexp_extract_all(html, '<a href=\"([^\"]*)\"', 1)) AS value FROM pages"


@query(_LINKS)
def axis_attribute(e):
    return nodes.path(_pages(e), ("descendant", "a"), ("attribute", "href")).select("doc_id", "value")


@query("SELECT page_id AS doc_id, list_sort(regexp_extract_all(html, '<a href=\"[^\"]*\">([^<]*)</a>', 1)) AS texts FROM pages")
def axis_descendant(e):
    table = _pages(e)
    texts = nodes.step(nodes.path(table, ("descendant", "nav"), ("descendant", "a")), table, "child", kind="text")
    return texts.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.replace("value", F.lit("&"), F.lit("&amp;")))).alias("texts"))


@query("SELECT page_id AS doc_id, len(regexp_extract_all(html, '<li>')) AS items, len(regexp_extract_all(html, '<p>')) AS paragraphs FROM pages")
def axis_child(e):
    table = _pages(e)
    items, paragraphs = nodes.path(table, ("descendant", "ul"), ("child", "li")), nodes.path(table, ("descendant", "article"), ("child", "p"))
    both = items.withColumn("is_item", F.lit(1)).unionByName(paragraphs.withColumn("is_item", F.lit(0)))
    return both.groupBy("doc_id").agg(F.sum("is_item").alias("items"), F.sum(1 - F.col("is_item")).alias("paragraphs"))


@query(_DOCS + _IDS.format("p_size = 7"))
def axis_parent(e):
    table = _table(e)
    return _attributes(_sized(table, 7), table)


@query(_DOCS + _IDS.format("p_size = 7") + " UNION ALL " + _BRAND.format("p_size = 7"))
def axis_ancestor(e):
    table = _table(e)
    names = nodes.step(_sized(table, 7), table, "child", "name")
    return _attributes(nodes.step(names, table, "ancestor", kind="element"), table)


@query(_DOCS + _IDS.format("p_size = 9") + " UNION ALL " + _BRAND.format("p_size = 9"))
def axis_ancestor_or_self(e):
    table = _table(e)
    return _attributes(nodes.step(_sized(table, 9), table, "ancestor-or-self", kind="element"), table)


@query(_DOCS + "SELECT doc_id, p_partkey::VARCHAR || ':' || p_name AS value FROM d WHERE p_size = 11 UNION ALL SELECT doc_id, p_partkey::VARCHAR FROM d WHERE p_size = 11")
def axis_descendant_or_self(e):
    table = _table(e)
    found = nodes.step(_sized(table, 11), table, "descendant-or-self")
    key = found.where("name = 'part'").select("doc_id", F.col("pre").alias("parent")).join(table.where("kind = 'attribute' and name = 'id'").select("doc_id", "parent", F.substring("value", 2, 20).alias("key")), ["doc_id", "parent"])
    named = found.where("name = 'name'").select("doc_id", "parent", F.col("pre").alias("at"))
    texts = found.where("kind = 'text'").select("doc_id", F.col("parent").alias("at"), "value")
    whole = named.join(texts, ["doc_id", "at"]).join(key, ["doc_id", "parent"]).select("doc_id", F.concat("key", F.lit(":"), "value").alias("value"))
    return whole.unionByName(key.select("doc_id", F.col("key").alias("value")))


@query(_DOCS + ", f AS (SELECT doc_id, min(i) AS f FROM d WHERE p_size = 7 GROUP BY 1) " + _IDS.format("i > (SELECT f FROM f WHERE f.doc_id = d.doc_id)"))
def axis_following_sibling(e):
    table = _table(e)
    return _attributes(nodes.step(_sized(table, 7), table, "following-sibling", "part"), table)


@query(_DOCS + ", f AS (SELECT doc_id, max(i) AS f FROM d WHERE p_size = 7 GROUP BY 1) " + _IDS.format("i < (SELECT f FROM f WHERE f.doc_id = d.doc_id)"))
def axis_preceding_sibling(e):
    table = _table(e)
    return _attributes(nodes.step(_sized(table, 7), table, "preceding-sibling", "part"), table)


@query(_DOCS + ", f AS (SELECT doc_id, min(i) AS f FROM d WHERE p_size = 9 GROUP BY 1) SELECT doc_id, p_name AS value FROM d WHERE i > (SELECT f FROM f WHERE f.doc_id = d.doc_id)")
def axis_following(e):
    table = _table(e)
    return nodes.step(nodes.step(_sized(table, 9), table, "following", "name"), table, "child", kind="text").select("doc_id", "value")


@query(_DOCS + ", f AS (SELECT doc_id, max(i) AS f FROM d WHERE p_size = 9 GROUP BY 1) SELECT doc_id, p_name AS value FROM d WHERE i < (SELECT f FROM f WHERE f.doc_id = d.doc_id)")
def axis_preceding(e):
    table = _table(e)
    return nodes.step(nodes.step(_sized(table, 9), table, "preceding", "name"), table, "child", kind="text").select("doc_id", "value")


@query(_DOCS + _IDS.format("p_size = 3"))
def axis_self(e):
    table = _table(e)
    both = nodes.union(_sized(table, 3), nodes.step(_sized(table, 3), table, "child", "name"))
    return _attributes(nodes.step(both, table, "self", "part"), table)


@query("SELECT doc_id, p_name AS string FROM (SELECT *, min(p_partkey) OVER (PARTITION BY p_brand, p_partkey // 1000) AS doc_id, row_number() OVER (PARTITION BY p_brand, p_partkey // 1000 ORDER BY p_partkey) AS position FROM part) WHERE position = 2")
def predicate_position(e):
    table = _table(e)
    second = nodes.positioned(nodes.path(table, ("child", "parts")), table, "child", "part").where("position = 2")
    return nodes.string_value(second.select(*table.columns), table).select("doc_id", "string")


@query("SELECT doc_id, p_name AS string FROM (SELECT *, min(p_partkey) OVER (PARTITION BY p_brand, p_partkey // 1000) AS doc_id, row_number() OVER (PARTITION BY p_brand, p_partkey // 1000 ORDER BY p_partkey DESC) AS position FROM part) WHERE position = 1")
def predicate_last(e):
    table = _table(e)
    final = nodes.positioned(nodes.path(table, ("child", "parts")), table, "child", "part").where("position = last")
    return nodes.string_value(final.select(*table.columns), table).select("doc_id", "string")


@query(_DOCS + _IDS.format("p_size IN (7, 9)"))
def node_union(e):
    table = _table(e)
    return _attributes(nodes.union(nodes.union(_sized(table, 7), _sized(table, 9)), _sized(table, 7)), table)


@query(_DOCS + _IDS.format("p_size = 7 AND i > 1"))
def node_intersect(e):
    table = _table(e)
    later = nodes.step(nodes.path(table, ("descendant", "part")), table, "following-sibling", "part")
    return _attributes(nodes.intersect(later, _sized(table, 7)), table)


@query(_DOCS + _IDS.format("p_size <> 7") + " UNION ALL " + _BRAND.format("true"))
def node_except(e):
    table = _table(e)
    every = nodes.path(table, ("descendant", None)).where("kind = 'element' and name != 'name'")
    return _attributes(nodes.except_(every, _sized(table, 7)), table)


@query(_DOCS + _IDS.format("p_size = 7") + " UNION ALL " + _BRAND.format("c = (SELECT count(*) FILTER (x.p_size <> 7) FROM d x WHERE x.doc_id = d.doc_id)"))
def node_innermost(e):
    table = _table(e)
    return _attributes(nodes.innermost(nodes.union(nodes.path(table, ("child", "parts")), _sized(table, 7))), table)


@query(_DOCS + _IDS.format("p_size = 7"))
def node_outermost(e):
    table = _table(e)
    return _attributes(nodes.outermost(nodes.union(_sized(table, 7), nodes.step(_sized(table, 7), table, "child", "name"))), table)


@query("SELECT p_partkey AS doc_id, p_name AS string FROM part WHERE p_partkey IN (SELECT min(p_partkey) FROM part GROUP BY p_brand, p_partkey // 1000)")
def node_id(e):
    table = _table(e)
    refs = table.select("doc_id").distinct().select("doc_id", F.concat(F.lit("p"), "doc_id").alias("ref"))
    return nodes.string_value(nodes.by_id(table, refs), table).select("doc_id", "string")


_HEAD = '<xsl:stylesheet version="3.0" xmlns:xsl="http://www.w3.org/1999/XSL/Transform" xmlns:xs="http://www.w3.org/2001/XMLSchema" xmlns:f="urn:f" xmlns:map="http://www.w3.org/2005/xpath-functions/map" exclude-result-prefixes="#all">'


def _sheet(body: str, method: str = "text") -> str:
    return f'{_HEAD}<xsl:output method="{method}" omit-xml-declaration="yes" indent="no"/>{body}</xsl:stylesheet>'


def _transformed(e: Engine, body: str, method: str = "text", **options) -> DataFrame:
    return e.transform(_xml(e), "doc_id", "xml", _sheet(body, method), strict=True, **options).select("doc_id", "result")


_PER_BRAND = "SELECT min(p_partkey) AS doc_id, {} AS result FROM part GROUP BY p_brand, p_partkey // 1000"


@query(_PER_BRAND.format("string_agg(p_name, '|' ORDER BY p_partkey)"))
def template_rules(e):
    return _transformed(e, '<xsl:template match="part"><xsl:if test="position() gt 1">|</xsl:if><xsl:apply-templates/></xsl:template>')


@query(_PER_BRAND.format("string_agg(CASE WHEN p_size > 25 THEN upper(p_name) ELSE p_name END, ',' ORDER BY p_partkey)"))
def template_priority_next_match(e):
    body = '<xsl:template match="/"><xsl:value-of select="for $p in //part return f:name($p)" separator=","/></xsl:template><xsl:function name="f:name"><xsl:param name="p"/><xsl:apply-templates select="$p"/></xsl:function><xsl:template match="part[@size &gt; 25]" priority="2"><xsl:variable name="t"><xsl:next-match/></xsl:variable><xsl:value-of select="upper-case($t)"/></xsl:template><xsl:template match="part"><xsl:value-of select="name"/></xsl:template>'
    return _transformed(e, body)


@query(_PER_BRAND.format("string_agg(p_partkey::VARCHAR, ' ' ORDER BY p_size DESC, p_partkey)"))
def template_sort(e):
    return _transformed(e, '<xsl:template match="/"><xsl:for-each select="//part"><xsl:sort select="xs:integer(@size)" order="descending"/><xsl:value-of select="if (position() gt 1) then \' \' else \'\', substring(@id, 2)" separator=""/></xsl:for-each></xsl:template>')


@query("SELECT doc_id, string_agg(s || ':' || n, ' ' ORDER BY s) AS result FROM (SELECT min(min(p_partkey)) OVER (PARTITION BY p_brand, p_partkey // 1000) AS doc_id, p_size // 10 AS s, count(*) AS n FROM part GROUP BY p_brand, p_partkey // 1000, p_size // 10) GROUP BY doc_id")
def template_for_each_group(e):
    return _transformed(e, '<xsl:template match="/"><xsl:for-each-group select="//part" group-by="xs:integer(@size) idiv 10"><xsl:sort select="current-grouping-key()"/><xsl:if test="position() gt 1"><xsl:text> </xsl:text></xsl:if><xsl:value-of select="current-grouping-key(), count(current-group())" separator=":"/></xsl:for-each-group></xsl:template>')


@query(_PER_BRAND.format("CAST(sum(p_size) AS VARCHAR)"))
def template_iterate(e):
    return _transformed(e, '<xsl:template match="/"><xsl:iterate select="//part"><xsl:param name="s" select="0"/><xsl:on-completion><xsl:value-of select="$s"/></xsl:on-completion><xsl:next-iteration><xsl:with-param name="s" select="$s + xs:integer(@size)"/></xsl:next-iteration></xsl:iterate></xsl:template>')


@query(_PER_BRAND.format("CAST(sum(p_size) AS VARCHAR) || '/' || count(*)"))
def template_accumulator(e):
    body = '<xsl:accumulator name="size" initial-value="0"><xsl:accumulator-rule match="part" select="$value + xs:integer(@size)"/></xsl:accumulator><xsl:accumulator name="n" initial-value="0"><xsl:accumulator-rule match="part" phase="end" select="$value + 1"/></xsl:accumulator><xsl:template match="/"><xsl:value-of select="accumulator-after(\'size\'), accumulator-after(\'n\')" separator="/"/></xsl:template>'
    return _transformed(e, body)


@query(_PER_BRAND.format("CAST(count(*) FILTER (p_size = 7) AS VARCHAR)"))
def template_key(e):
    return _transformed(e, '<xsl:key name="by-size" match="part" use="xs:integer(@size)"/><xsl:template match="/"><xsl:value-of select="count(key(\'by-size\', 7))"/></xsl:template>')


@query(_PER_BRAND.format("string_agg(p_partkey::VARCHAR, '+' ORDER BY p_partkey)"))
def template_call_recursive(e):
    body = '<xsl:template match="/"><xsl:call-template name="join"><xsl:with-param name="rest" select="//part"/></xsl:call-template></xsl:template><xsl:template name="join"><xsl:param name="rest"/><xsl:if test="$rest"><xsl:value-of select="substring($rest[1]/@id, 2)"/><xsl:if test="$rest[2]">+</xsl:if><xsl:call-template name="join"><xsl:with-param name="rest" select="tail($rest)"/></xsl:call-template></xsl:if></xsl:template>'
    return _transformed(e, body)


@query("SELECT min(p_partkey) AS doc_id, '<parts brand=\"' || p_brand || '\">' || string_agg('<part id=\"p' || p_partkey || '\" size=\"' || p_size || '\"/>', '' ORDER BY p_partkey) || '</parts>' AS result FROM part GROUP BY p_brand, p_partkey // 1000")
def template_shallow_copy(e):
    return _transformed(e, '<xsl:mode on-no-match="shallow-copy"/><xsl:template match="name"/>', "xml")


@query(_PER_BRAND.format("'<ul>' || string_agg('<li class=\"s' || p_size || '\">' || p_name || '</li>', '' ORDER BY p_partkey) || '</ul>'"))
def template_literal_elements(e):
    return _transformed(e, '<xsl:template match="/parts"><ul><xsl:for-each select="part"><li class="s{@size}"><xsl:value-of select="name"/></li></xsl:for-each></ul></xsl:template>', "html")


@query(_PER_BRAND.format("string_agg(row_no || '. ' || p_name, chr(10) ORDER BY p_partkey)").replace("FROM part", "FROM (SELECT *, row_number() OVER (PARTITION BY p_brand, p_partkey // 1000 ORDER BY p_partkey) AS row_no FROM part)"))
def template_number(e):
    return _transformed(e, '<xsl:template match="/"><xsl:for-each select="//part"><xsl:if test="position() gt 1"><xsl:text>&#10;</xsl:text></xsl:if><xsl:number format="1. "/><xsl:value-of select="name"/></xsl:for-each></xsl:template>')


@query(_PER_BRAND.format("'caught FOAR0001'"))
def template_try_catch(e):
    return _transformed(e, '<xsl:template match="/"><xsl:try select="count(//part) div 0"><xsl:catch xmlns:err="http://www.w3.org/2005/xqt-errors" select="\'caught\', local-name-from-QName($err:code)"/></xsl:try></xsl:template>')


@query(_PER_BRAND.format("'{\"n\":' || count(*) || ',\"sizes\":[' || string_agg(p_size::VARCHAR, ',' ORDER BY p_partkey) || ']}'"))
def serialize_json(e):
    return _transformed(e, '<xsl:template match="/"><xsl:sequence select="map{\'n\': count(//part), \'sizes\': array{//part/xs:integer(@size)}}"/></xsl:template>', "json")


@query(_PER_BRAND.format("string_agg(regexp_replace(p_name, '[aeiou]+', '<>', 'g'), ' ' ORDER BY p_partkey)"))
def template_analyze_string(e):
    return _transformed(e, '<xsl:template match="/"><xsl:for-each select="//name"><xsl:if test="position() gt 1"><xsl:text> </xsl:text></xsl:if><xsl:analyze-string select="." regex="[aeiou]+"><xsl:matching-substring>&lt;&gt;</xsl:matching-substring><xsl:non-matching-substring><xsl:value-of select="."/></xsl:non-matching-substring></xsl:analyze-string></xsl:for-each></xsl:template>')


@query(_PER_BRAND.format("CAST(count(*) + 40 AS VARCHAR)"))
def template_params_modes_evaluate(e):
    body = '<xsl:param name="base" as="xs:integer"/><xsl:mode name="count" on-no-match="deep-skip"/><xsl:template match="/"><xsl:variable name="marks"><xsl:apply-templates select="//part" mode="count"/></xsl:variable><xsl:evaluate xpath="\'$n + $b\'"><xsl:with-param name="n" select="string-length($marks)"/><xsl:with-param name="b" select="$base"/></xsl:evaluate></xsl:template><xsl:template match="part" mode="count">x</xsl:template>'
    return _transformed(e, body, params={"base": 40})


@query(_PER_BRAND.format("string_agg(p_partkey::VARCHAR, ' ' ORDER BY p_size, p_partkey)"))
def template_merge(e):
    body = '<xsl:template match="/"><xsl:variable name="all"><xsl:merge><xsl:merge-source name="even" select="//part[xs:integer(@size) mod 2 = 0]" sort-before-merge="yes"><xsl:merge-key select="xs:integer(@size)"/><xsl:merge-key select="xs:integer(substring(@id, 2))"/></xsl:merge-source><xsl:merge-source name="odd" select="//part[xs:integer(@size) mod 2 = 1]" sort-before-merge="yes"><xsl:merge-key select="xs:integer(@size)"/><xsl:merge-key select="xs:integer(substring(@id, 2))"/></xsl:merge-source><xsl:merge-action><i><xsl:value-of select="substring(@id, 2)"/></i></xsl:merge-action></xsl:merge></xsl:variable><xsl:value-of select="$all/i"/></xsl:template>'
    return _transformed(e, body)


@query(_DOCS + "SELECT doc_id, 'p' || p_partkey || '.xml' AS href, '<part id=\"p' || p_partkey || '\" size=\"' || p_size || '\"><name>' || p_name || '</name></part>' AS text FROM d WHERE p_size < 20")
def result_documents(e):
    out = e.transform(_xml(e), "doc_id", "xml", _sheet('<xsl:template match="/"><xsl:for-each select="//part[@size &lt; 20]"><xsl:result-document href="{@id}.xml" method="xml" omit-xml-declaration="yes"><xsl:copy-of select="."/></xsl:result-document></xsl:for-each></xsl:template>'), strict=True)
    return out.select("doc_id", F.explode("results").alias("href", "text"))


@query("SELECT event_id AS doc_id, [json_extract_string(props, '$.k')] AS items FROM events")
def json_source(e):
    return e.xpath(e.table("events"), "event_id", "props", "string(/*:map/*:number[@key = 'k'])", kind="json", strict=True).select("doc_id", "items")


@query("SELECT min(p_partkey) AS doc_id, [max(p_size)::VARCHAR, count(*)::VARCHAR] AS items FROM part GROUP BY p_brand, p_partkey // 1000")
def document_xpath(e):
    return e.xpath(_xml(e), "doc_id", "xml", "(max(//part/@size/xs:integer(.)), count(//part))", strict=True).select("doc_id", "items")


_DECODED = "regexp_replace(replace(replace(replace({}, '&middot;', '·'), '&copy;', '©'), '&quot;', '\"'), '&amp;?', '&', 'g')"


@query(f"""SELECT page_id AS doc_id, CAST(NULL AS VARCHAR) AS error, [
  trim(regexp_replace({_DECODED.format("regexp_extract(html, '<title>([^<]*)</title>', 1)")}, '[ \\t\\r\\n]+', ' ', 'g')),
  len(regexp_extract_all(regexp_extract(html, '(?s)<article.*?</article>'), '<p[ >]'))::VARCHAR,
  {_DECODED.format("regexp_replace(regexp_extract(html, '(?s)<footer[^>]*>(.*?)</footer>', 1), '<[^>]*>', '', 'g')")}] AS items FROM pages""")
def page_titles(e):
    return e.xpath(e.table("pages"), "page_id", "html", "normalize-space(//title), count(//article//p), //footer/string()", kind="html")


@query("SELECT user_id, count(*) AS n, sum(value) AS total FROM events GROUP BY 1")
def streaming_accumulator(e):
    return running.totals(e.spark, f"{e.root}/events.parquet", ["user_id"], {"n": "count(1)", "total": "sum(value)"})


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS hour, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def streaming_window(e):
    return running.windowed(e.spark, f"{e.root}/events.parquet", "ts", "1 hour", ["event_type"]).select(F.col("hour").cast("timestamp_ntz").alias("hour"), "event_type", "n")


_AGG = lambda e, sep="": f"string_agg({e}, '{sep}' ORDER BY p_partkey)"
_O = lambda e, where="": f"CASE WHEN count(*) {where} = 0 THEN '<o/>' ELSE '<o>' || string_agg({e}, '' ORDER BY p_partkey) {where} || '</o>' END"
_7 = "FILTER (p_size = 7)"

#: Stylesheets: name to (declarations and templates, output method, SQL of the result for each document).
SHEETS: dict[str, tuple[str, str, str]] = {
    "template_choose": ('<xsl:template match="part"><xsl:choose><xsl:when test="@size &gt; 25">L</xsl:when><xsl:when test="@size &gt; 10">M</xsl:when><xsl:otherwise>S</xsl:otherwise></xsl:choose></xsl:template>', "text", _AGG("CASE WHEN p_size > 25 THEN 'L' WHEN p_size > 10 THEN 'M' ELSE 'S' END")),
    "template_element_attribute": ('<xsl:template match="/parts"><o><xsl:for-each select="part"><xsl:element name="s{@size}"><xsl:attribute name="n" select="substring(@id, 2)"/></xsl:element></xsl:for-each></o></xsl:template>', "xml", _O("'<s' || p_size || ' n=\"' || p_partkey || '\"/>'")),
    "template_attribute_set": ('<xsl:attribute-set name="more"><xsl:attribute name="double" select="2 * @size"/></xsl:attribute-set><xsl:attribute-set name="all" use-attribute-sets="more"><xsl:attribute name="size" select="@size"/></xsl:attribute-set><xsl:template match="/parts"><o><xsl:for-each select="part"><i xsl:use-attribute-sets="all"/></xsl:for-each></o></xsl:template>', "xml", _O("'<i double=\"' || 2 * p_size || '\" size=\"' || p_size || '\"/>'")),
    "template_comment_instruction": ('<xsl:template match="/parts"><o><xsl:for-each select="part"><xsl:comment select="@id"/><xsl:processing-instruction name="size" select="@size"/></xsl:for-each></o></xsl:template>', "xml", _O("'<!--p' || p_partkey || '--><?size ' || p_size || '?>'")),
    "template_copy": ('<xsl:template match="/parts"><o><xsl:apply-templates/></o></xsl:template><xsl:template match="part"><xsl:copy><xsl:copy-of select="@size"/></xsl:copy></xsl:template>', "xml", _O("'<part size=\"' || p_size || '\"/>'")),
    "template_copy_of": ('<xsl:template match="/parts"><o><xsl:copy-of select="part[@size = 7]"/></o></xsl:template>', "xml", _O("'<part id=\"p' || p_partkey || '\" size=\"7\"><name>' || p_name || '</name></part>'", _7)),
    "template_namespace": ('<xsl:template match="/parts"><o><xsl:namespace name="p" select="\'urn:p\'"/><xsl:value-of select="count(part)"/></o></xsl:template>', "xml", "'<o xmlns:p=\"urn:p\">' || count(*) || '</o>'"),
    "template_namespace_alias": ('<xsl:namespace-alias stylesheet-prefix="f" result-prefix="#default"/><xsl:template match="/parts"><f:o n="{count(part)}"/></xsl:template>', "xml", "'<o n=\"' || count(*) || '\"/>'"),
    "template_document": ('<xsl:template match="/parts"><xsl:variable name="d" as="document-node()"><xsl:document><xsl:for-each select="part"><i n="{@size}"/></xsl:for-each></xsl:document></xsl:variable><xsl:value-of select="sum($d/i/@n), count($d/*)"/></xsl:template>', "text", "sum(p_size) || ' ' || count(*)"),
    "template_map": ('<xsl:template match="/parts"><xsl:map><xsl:map-entry key="\'total\'" select="sum(part/xs:integer(@size))"/></xsl:map></xsl:template>', "json", "'{\"total\":' || sum(p_size) || '}'"),
    "template_where_populated": ('<xsl:template match="/parts"><o><xsl:where-populated><seven><xsl:copy-of select="part[@size = 7]/@size"/><xsl:value-of select="part[@size = 7]/name"/></seven></xsl:where-populated></o></xsl:template>', "xml", "CASE WHEN count(*) FILTER (p_size = 7) = 0 THEN '<o/>' ELSE '<o><seven size=\"7\">' || string_agg(p_name, ' ' ORDER BY p_partkey) FILTER (p_size = 7) || '</seven></o>' END"),
    "template_on_empty": ('<xsl:template match="/parts"><o><xsl:on-non-empty>has </xsl:on-non-empty><xsl:value-of select="part[@size = 7]/substring(@id, 2)"/><xsl:on-empty>none</xsl:on-empty></o></xsl:template>', "xml", "'<o>' || coalesce('has ' || string_agg(p_partkey::VARCHAR, ' ' ORDER BY p_partkey) FILTER (p_size = 7), 'none') || '</o>'"),
    "template_fork": ('<xsl:template match="/parts"><xsl:fork><xsl:sequence select="sum(part/xs:integer(@size))"/><xsl:sequence select="max(part/xs:integer(@size))"/></xsl:fork></xsl:template>', "text", "sum(p_size) || ' ' || max(p_size)"),
    "template_fallback": ('<xsl:template match="/parts"><xsl:novelty><xsl:fallback><xsl:value-of select="count(part)"/></xsl:fallback></xsl:novelty></xsl:template>', "text", "count(*)::VARCHAR"),
    "template_perform_sort": ('<xsl:template match="/parts"><xsl:variable name="s" as="element()*"><xsl:perform-sort select="part"><xsl:sort select="name"/><xsl:sort select="xs:integer(substring(@id, 2))"/></xsl:perform-sort></xsl:variable><xsl:value-of select="$s/substring(@id, 2)"/></xsl:template>', "text", "string_agg(p_partkey::VARCHAR, ' ' ORDER BY p_name, p_partkey)"),
    "template_text_value": ('<xsl:template match="part" expand-text="yes">{{{@size}}}{name => upper-case()};</xsl:template>', "text", _AGG("'{' || p_size || '}' || upper(p_name) || ';'")),
    "template_tunnel": ('<xsl:template match="/"><xsl:apply-templates><xsl:with-param name="t" select="7" tunnel="yes"/></xsl:apply-templates></xsl:template><xsl:template match="parts"><xsl:apply-templates select="part"/></xsl:template><xsl:template match="part"><xsl:param name="t" tunnel="yes"/><xsl:param name="u" select="1"/><xsl:value-of select="@size + $t * $u, \'\'"/></xsl:template>', "text", _AGG("(p_size + 7) || ' '")),
    "template_merge_group": ('<xsl:template match="/parts"><xsl:merge><xsl:merge-source name="even" select="part[@size mod 2 = 0]" sort-before-merge="yes"><xsl:merge-key select="xs:integer(@size) idiv 2"/></xsl:merge-source><xsl:merge-source name="odd" select="part[@size mod 2 = 1]" sort-before-merge="yes"><xsl:merge-key select="xs:integer(@size) idiv 2"/></xsl:merge-source><xsl:merge-action><xsl:value-of select="current-merge-key(), count(current-merge-group(\'odd\')), count(current-merge-group()), \'\'" separator=":"/></xsl:merge-action></xsl:merge></xsl:template>', "text", ""),
    "template_regex_group": ('<xsl:template match="part"><xsl:analyze-string select="name" regex="([a-z])([a-z]*)"><xsl:matching-substring><xsl:value-of select="regex-group(2), regex-group(1)" separator=""/></xsl:matching-substring><xsl:non-matching-substring><xsl:value-of select="."/></xsl:non-matching-substring></xsl:analyze-string>;</xsl:template>', "text", _AGG("regexp_replace(p_name, '([a-z])([a-z]*)', '\\2\\1', 'g') || ';'")),
    "template_accumulator_before": ('<xsl:accumulator name="before" initial-value="0"><xsl:accumulator-rule match="part" phase="end" select="$value + xs:integer(@size)"/></xsl:accumulator><xsl:mode use-accumulators="before"/><xsl:template match="part"><xsl:value-of select="accumulator-before(\'before\'), accumulator-after(\'before\'), \'\'"/></xsl:template>', "text", ""),
    "template_character_map": ('<xsl:character-map name="c"><xsl:output-character character="#" string="[hash]"/></xsl:character-map><xsl:output use-character-maps="c"/><xsl:template match="/parts"><o b="{@brand}"><xsl:value-of select="@brand"/></o></xsl:template>', "xml", "'<o b=\"' || replace(any_value(p_brand), '#', '[hash]') || '\">' || replace(any_value(p_brand), '#', '[hash]') || '</o>'"),
    "template_decimal_format": ('<xsl:decimal-format name="de" decimal-separator="," grouping-separator="."/><xsl:template match="/parts"><xsl:value-of select="format-number(1000 * sum(part/@size) + 0.25, \'#.##0,00\', \'de\')"/></xsl:template>', "text", "replace(replace(replace(format('{:,.2f}', 1000.0 * sum(p_size) + 0.25), ',', '_'), '.', ','), '_', '.')"),
    "template_current": ('<xsl:template match="/parts"><xsl:for-each select="part"><xsl:value-of select="count(../part[@size = current()/@size]), \'\'"/></xsl:for-each></xsl:template>', "text", ""),
    "template_available": ('<xsl:template match="/parts"><xsl:value-of select="count(part), element-available(\'xsl:sort\'), function-available(\'count\', 1), function-available(\'none\'), type-available(\'xs:integer\')"/></xsl:template>', "text", "count(*) || ' true true false true'"),
    "template_snapshot": ('<xsl:template match="/parts"><xsl:value-of select="part[@size = 7]/name/snapshot()/../@id, count(part/name/copy-of()/..)"/></xsl:template>', "text", "coalesce(string_agg('p' || p_partkey, ' ' ORDER BY p_partkey) FILTER (p_size = 7) || ' ', '') || '0'"),
    "template_group_positions": ('<xsl:template match="/parts"><xsl:for-each-group select="part" group-adjacent="xs:integer(substring(@id, 2)) idiv 100"><xsl:value-of select="current-grouping-key(), count(current-group()), \'\'"/></xsl:for-each-group></xsl:template>', "text", ""),
    "template_strip_space": ('<xsl:template match="/parts"><xsl:variable name="d" as="document-node()" select="parse-xml(concat(\'&lt;r> &lt;a> &lt;/a>\', count(part), \'&lt;/r>\'))"/><xsl:value-of select="string-length($d/r), count($d/r/node())"/></xsl:template>', "text", "(length(count(*)::VARCHAR) + 2) || ' 3'"),
    "template_shadow": ('<xsl:variable name="n" static="yes" select="\'part\'"/><xsl:template _match="{$n}"><xsl:value-of _select="{concat(\'@\', \'size\')}"/>;</xsl:template>', "text", _AGG("p_size || ';'")),
    "template_typed_element": ('<xsl:template match="/parts"><xsl:try><o><xsl:for-each select="part"><xsl:element name="n" type="xs:unsignedByte"><xsl:value-of select="substring(@id, 2)"/></xsl:element></xsl:for-each></o><xsl:catch><xsl:value-of xmlns:err="http://www.w3.org/2005/xqt-errors" select="local-name-from-QName($err:code)"/></xsl:catch></xsl:try></xsl:template>', "xml", "CASE WHEN max(p_partkey) > 255 THEN 'XTTE1540' ELSE '<o>' || string_agg('<n>' || p_partkey || '</n>', '' ORDER BY p_partkey) || '</o>' END"),
    "template_function_coercion": ('<xsl:template match="/parts"><xsl:variable name="f" as="function(xs:double) as xs:string" select="function($x) {string($x div 2)}"/><xsl:value-of select="part ! $f(xs:integer(@size))"/></xsl:template>', "text", "string_agg(CASE WHEN p_size % 2 = 0 THEN (p_size // 2)::VARCHAR ELSE (p_size // 2) || '.5' END, ' ' ORDER BY p_partkey)"),
}

#: SQL of the results that need more than one aggregation over a document's parts.
_SQL_OF = {
    "template_merge_group": "SELECT doc_id, string_agg(k || ':' || odd || ':' || n || ':', '' ORDER BY k) AS result FROM (SELECT doc_id, p_size // 2 AS k, count(*) FILTER (p_size % 2 = 1) AS odd, count(*) AS n FROM d GROUP BY ALL) GROUP BY doc_id",
    "template_accumulator_before": "SELECT doc_id, string_agg((s - p_size) || ' ' || s || ' ', '' ORDER BY p_partkey) AS result FROM (SELECT *, sum(p_size) OVER (PARTITION BY doc_id ORDER BY p_partkey) AS s FROM d) GROUP BY doc_id",
    "template_current": "SELECT doc_id, string_agg(n || ' ', '' ORDER BY p_partkey) AS result FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, p_size) AS n FROM d) GROUP BY doc_id",
    "template_group_positions": "SELECT doc_id, string_agg(k || ' ' || n || ' ', '' ORDER BY k) AS result FROM (SELECT doc_id, p_partkey // 100 AS k, count(*) AS n FROM d GROUP BY ALL) GROUP BY doc_id",
}

#: Expressions on documents: name to (XPath, SQL of the list of its items).
EXPRESSIONS: dict[str, tuple[str, str]] = {
    "xpath_names": ("string-join(//part[@size = 7]/@*[local-name() = 'id'], ','), name((//part)[1]), namespace-uri(/parts), string-join(distinct-values(//@*/name()), ',')", "[coalesce(string_agg('p' || p_partkey, ',' ORDER BY p_partkey) FILTER (p_size = 7), ''), 'part', '', 'brand,id,size']"),
    "xpath_node_comparison": ("count(//part[. << (//part)[3]]), (//part)[1] is /parts/part[1], count(//part[. >> (//part)[1]])", "[least(count(*), CASE WHEN count(*) < 3 THEN 0 ELSE 2 END)::VARCHAR, 'true', (count(*) - 1)::VARCHAR]"),
    "xpath_paths": ("path((//name)[last()]), count(//*[has-children()]), root((//name)[1])/parts/@brand/string()", "['/Q{}parts[1]/Q{}part[' || count(*) || ']/Q{}name[1]', (2 * count(*) + 1)::VARCHAR, any_value(p_brand)]"),
    "xpath_parse_xml": ("parse-xml(concat('<a><b>', count(//part), '</b></a>'))/a/b/string(), count(parse-xml-fragment(string-join(//part/concat('<x>', @size, '</x>')))/x)", "[count(*)::VARCHAR, count(*)::VARCHAR]"),
    "xpath_json_xml": ("json-to-xml(concat('{\"n\":', count(//part), '}'))//*:number[@key = 'n']/string(), xml-to-json(json-to-xml(concat('[', max(//@size/xs:integer(.)), ',\"x\",null]'))), parse-json(concat('[[', min(//@size/xs:integer(.)), ']]'))?1?1", "[count(*)::VARCHAR, '[' || max(p_size) || ',\"x\",null]', min(p_size)::VARCHAR]"),
    "xpath_sort_key": ("sort(//part, (), function($p) {xs:integer($p/@size)})[1]/@id/string(), string-join(sort(//part/@size/xs:integer(.)), ' ')", "['p' || arg_min(p_partkey, p_size * 1000000 + p_partkey), string_agg(p_size::VARCHAR, ' ' ORDER BY p_size)]"),
    "xpath_qnames": ("local-name-from-QName(node-name((//part)[1])), namespace-uri-from-QName(QName('urn:x', concat('p:a', count(//part)))), local-name-from-QName(QName('urn:x', concat('p:a', count(//part)))), prefix-from-QName(QName('urn:x', 'p:a'))", "['part', 'urn:x', 'a' || count(*), 'p']"),
    "xpath_analyze_string": ("sum(//name/count(analyze-string(., '[aeiou]')//*:match)), string-join(analyze-string((//name)[1], '\\d+')//*:non-match, '')", "[sum(len(regexp_extract_all(p_name, '[aeiou]')))::VARCHAR, regexp_replace(arg_min(p_name, p_partkey), '[0-9]+', '', 'g')]"),
    "xpath_function_lookup": ("function-lookup(QName('http://www.w3.org/2005/xpath-functions', 'count'), 1)(//part), local-name-from-QName(function-name(sum#1)), exists(function-lookup(QName('urn:x', 'none'), 1))", "[count(*)::VARCHAR, 'sum', 'false']"),
    "xpath_generate_id": ("count(distinct-values(//part/generate-id())), generate-id((//part)[1]) = generate-id(//part[1]), generate-id(()) = ''", "[count(*)::VARCHAR, 'true', 'true']"),
    "xpath_inner_outer": ("count(innermost(//*)), outermost(//*)/@brand/string(), count(outermost(//part[@size = 7]/descendant-or-self::*))", "[count(*)::VARCHAR, any_value(p_brand), (count(*) FILTER (p_size = 7))::VARCHAR]"),
    "xpath_format_time": ("format-time(xs:time(concat('10:', format-integer((//part)[1]/@size, '00'), ':07')), '[H01].[m01].[s01]')", "['10.' || printf('%02d', arg_min(p_size, p_partkey)) || '.07']"),
    "xpath_set_operators": ("count(//part[@size = 7] | //part[@size = 9] | //part[@size = 7]), count(//part intersect //part[@size = 7]), string-join((//part except //part[@size > 9])/@id, ' ')", "[(count(*) FILTER (p_size IN (7, 9)))::VARCHAR, (count(*) FILTER (p_size = 7))::VARCHAR, coalesce(string_agg('p' || p_partkey, ' ' ORDER BY p_partkey) FILTER (p_size <= 9), '')]"),
    "xpath_random_permutation": ("let $r := random-number-generator(count(//part)) return (sum($r?permute(//part/@size/xs:integer(.))), $r?number ge 0 and $r?number lt 1, $r?number = random-number-generator(count(//part))?number)", "[sum(p_size)::VARCHAR, 'true', 'true']"),
    "xpath_namespaces": ("string-join(sort(in-scope-prefixes(/parts)), ' '), namespace-uri-for-prefix('xml', /parts), count(//namespace::*[name() = 'xml'])", "['xml', 'http://www.w3.org/XML/1998/namespace', (2 * count(*) + 1)::VARCHAR]"),
    "xpath_ids": ("let $ids := //part/@id/string(), $d := parse-xml(concat('<!DOCTYPE r [<!ATTLIST a k ID #IMPLIED><!ATTLIST b r IDREF #IMPLIED>]><r>', string-join(//part/concat('<a k=\"', @id, '\"/><b r=\"', @id, '\"/>'), ''), '</r>')) return (count(id($ids, $d)), count(idref(subsequence($ids, 1, 2), $d)), id($ids[1], $d)/@k/string(), element-with-id($ids[last()], $d)/@k/string())", "[count(*)::VARCHAR, least(count(*), 2)::VARCHAR, 'p' || min(p_partkey), 'p' || max(p_partkey)]"),
    "xpath_lang": ("let $d := parse-xml(concat('<r xml:lang=\"en-GB\"><a>', count(//part), '</a><b xml:lang=\"de\">', max(//@size/xs:integer(.)), '</b></r>')) return ($d//*[lang('en')]/name(), $d//a[lang('EN')]/string(), $d//b[lang('de')]/string())", "['r', 'a', count(*)::VARCHAR, max(p_size)::VARCHAR]"),
    "xpath_node_values": ("string((//name)[1]), data((//part)[1]/@size), number((//part)[1]/@size) * 2, count(//part[nilled(.)]), empty(document-uri(/)), count((//part)[1]/@size/..)", "[arg_min(p_name, p_partkey), arg_min(p_size, p_partkey)::VARCHAR, (2 * arg_min(p_size, p_partkey))::VARCHAR, '0', 'true', '1']"),
    "xpath_serialize": ("serialize((//part)[1]), serialize(map{'n': count(//part)}, map{'method': 'json'}), serialize((//part)[1]/@size/xs:integer(.) + 1)", "['<part id=\"p' || min(p_partkey) || '\" size=\"' || arg_min(p_size, p_partkey) || '\"><name>' || arg_min(p_name, p_partkey) || '</name></part>', '{\"n\":' || count(*) || '}', (arg_min(p_size, p_partkey) + 1)::VARCHAR]"),
    "xpath_node_types": ("(//part)[1] instance of element(part), //@size instance of attribute(size)+, //part[@size = 7] instance of element()?, (/) instance of document-node(), ((//part)[1] treat as element(part))/@id/string()", "['true', 'true', (count(*) FILTER (p_size = 7) <= 1)::VARCHAR, 'true', 'p' || min(p_partkey)]"),
    "xpath_fold_merge": ("fold-left(//part/@size/xs:integer(.), 0, function($a, $s) {$a + $s}), map:size(map:merge(//part ! map{string(@size): 1})), array:size(array{//part[@size < 20]})", "[sum(p_size)::VARCHAR, count(DISTINCT p_size)::VARCHAR, (count(*) FILTER (p_size < 20))::VARCHAR]"),
    "xpath_environment": ("empty(environment-variable('ITEMFLOW_NONE')), count(available-environment-variables()[. = 'ITEMFLOW_NONE']), count(//part)", "['true', '0', count(*)::VARCHAR]"),
    "xpath_round_trip": ("let $x := json-to-xml(serialize(map{'sizes': array{//part/@size/xs:integer(.)}}, map{'method': 'json'})) return (count($x//*:number), xml-to-json($x))", "[count(*)::VARCHAR, '{\"sizes\":[' || string_agg(p_size::VARCHAR, ',' ORDER BY p_partkey) || ']}']"),
    "xpath_general_steps": ("string-join(//part[@size = 7]/(name, @size)/string(), ','), count(//part/(1 to 2)), //part[last()]/preceding-sibling::part[1]/@id/string()", "list_filter([coalesce(string_agg('7,' || p_name, ',' ORDER BY p_partkey) FILTER (p_size = 7), ''), (2 * count(*))::VARCHAR, CASE WHEN count(*) > 1 THEN 'p' || list_extract(list(p_partkey ORDER BY p_partkey DESC), 2) END], lambda x: x IS NOT NULL)"),
}


def _sheet_query(name: str) -> Callable[[SparkSession, str], DataFrame]:
    body, method, _ = SHEETS[name]
    return lambda spark, sf_dir: _transformed(Engine(spark, sf_dir), body, method)


def _expression_query(name: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        e = Engine(spark, sf_dir)
        return e.xpath(_xml(e), "doc_id", "xml", EXPRESSIONS[name][0], strict=True).select("doc_id", "items")

    return run


for _name, (_, _, _result) in SHEETS.items():
    _queries[_name] = _sheet_query(_name)
    _sql[_name] = _DOCS + _SQL_OF[_name] if _name in _SQL_OF else _PER_BRAND.format(_result)
for _name, (_, _items) in EXPRESSIONS.items():
    _queries[_name] = _expression_query(_name)
    _sql[_name] = f"SELECT min(p_partkey) AS doc_id, {_items} AS items FROM part GROUP BY p_brand, p_partkey // 1000"


@query(_DOCS + "SELECT doc_id, list_sort(coalesce(list('part ' || p_partkey) FILTER (p_size = 7), [])) AS messages FROM d GROUP BY doc_id")
def template_message(e):
    body = '<xsl:template match="part[@size = 7]"><xsl:message select="\'part\', substring(@id, 2)"/></xsl:template><xsl:template match="name"/>'
    return e.transform(_xml(e), "doc_id", "xml", _sheet(body), strict=True).select("doc_id", F.array_sort("messages").alias("messages"))


@query(_DOCS + "SELECT doc_id, CASE WHEN count(*) FILTER (p_size = 7) > 0 THEN 'XTMM9001' END AS error FROM d GROUP BY doc_id")
def template_assert(e):
    body = '<xsl:template match="/"><xsl:assert test="not(//part[@size = 7])" select="\'a seven\'"/></xsl:template>'
    return e.transform(_xml(e), "doc_id", "xml", _sheet(body)).select("doc_id", "error")


@query(_PER_BRAND.format("string_agg(CASE WHEN p_size = 7 THEN '(' || p_name || ')' ELSE p_name END || ',', '' ORDER BY p_partkey)"))
def template_import(e):
    """xsl:import and xsl:include, apply-imports from the rule that wins."""
    sheet = lambda body: f"{_HEAD}{body}</xsl:stylesheet>"
    modules = {"urn:base": sheet('<xsl:include href="urn:more"/><xsl:template match="name"><xsl:value-of select="."/></xsl:template>'), "urn:more": sheet('<xsl:template match="part"><xsl:apply-templates/>,</xsl:template>')}
    body = '<xsl:import href="urn:base"/><xsl:output method="text"/><xsl:template match="part[@size = 7]/name">(<xsl:apply-imports/>)</xsl:template>'
    return e.transform(_xml(e), "doc_id", "xml", sheet(body), modules=modules, strict=True).select("doc_id", "result")


@query(_PER_BRAND.format("count(*) || ' ' || 10 * sum(p_size)"))
def template_package(e):
    """xsl:use-package with a private function, and one that the user overrides."""
    package = f'{_HEAD}<xsl:function name="f:total" visibility="public"><xsl:param name="p"/><xsl:sequence select="f:scale() * f:sum($p)"/></xsl:function><xsl:function name="f:sum" visibility="private"><xsl:param name="p"/><xsl:sequence select="sum($p/xs:integer(@size))"/></xsl:function><xsl:function name="f:scale" visibility="public"><xsl:sequence select="1"/></xsl:function></xsl:stylesheet>'
    body = '<xsl:use-package name="urn:sums"><xsl:override><xsl:function name="f:scale"><xsl:sequence select="10"/></xsl:function></xsl:override></xsl:use-package><xsl:template match="/parts"><xsl:value-of select="count(part), f:total(part)"/></xsl:template>'
    return e.transform(_xml(e), "doc_id", "xml", _sheet(body), modules={"urn:sums": package}, strict=True).select("doc_id", "result")


@query(_DOCS + "SELECT doc_id, [(count(*) FILTER (p_size < 20))::VARCHAR, 'yes', 'false'] AS items FROM d GROUP BY doc_id")
def template_other_documents(e):
    """doc(), doc-available(), xsl:source-document and unparsed-text of what the caller hands in."""
    body = '<xsl:template match="/parts"><xsl:variable name="n" as="xs:integer"><xsl:source-document href="urn:limit"><xsl:sequence select="xs:integer(/limit)"/></xsl:source-document></xsl:variable><xsl:value-of select="count(part[@size &lt; $n]), if (doc(\'urn:limit\')/limit = string($n)) then unparsed-text(\'urn:text\') else (), doc-available(\'urn:none\')"/></xsl:template>'
    out = e.transform(_xml(e), "doc_id", "xml", _sheet(body), documents={"urn:limit": "<limit>20</limit>", "urn:text": "yes"}, strict=True)
    return out.select("doc_id", F.split("result", " ").alias("items"))


@query("SELECT page_id AS doc_id, [replace(regexp_extract(html, '<title>(.*?)</title>', 1), '&amp;', '&'), len(regexp_extract_all(html, '<li>'))::VARCHAR, regexp_extract(html, '<html lang=\"(..)\"', 1)] AS items FROM pages")
def page_facts(e):
    return e.xpath(e.table("pages"), "page_id", "html", "string((//title)[1]), count(//nav//li), /html/@lang/string()", kind="html", strict=True).select("doc_id", "items")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    return dict(_sql)
