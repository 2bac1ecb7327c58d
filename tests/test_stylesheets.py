"""Stylesheets on one document: declarations, instructions, output."""

import sys

import pytest
from itemflow.errors import EngineError
from itemflow.perdoc.serialize import Output, serialize
from itemflow.perdoc.stylesheet import Run, SheetCompiler, document_of, whitespace_stripper
from itemflow.perdoc.tree import parse_xml, strip_space

sys.setrecursionlimit(20_000)
HEAD = '<xsl:stylesheet version="3.0" xmlns:xsl="http://www.w3.org/1999/XSL/Transform" xmlns:xs="http://www.w3.org/2001/XMLSchema" xmlns:f="urn:f" xmlns:err="http://www.w3.org/2005/xqt-errors" xmlns:map="http://www.w3.org/2005/xpath-functions/map" exclude-result-prefixes="#all">'
SOURCE = '<r><a k="1">x</a><a k="2">y</a><b k="1">z</b></r>'
XML = '<xsl:output method="xml" omit-xml-declaration="yes" indent="no"/>'


def run(body, source=SOURCE, output=XML, modules=None, params=None, documents=None, template=None, mode=None, dynamic=True):
    modules = {k: HEAD + v + "</xsl:stylesheet>" for k, v in (modules or {}).items()}
    sheet = SheetCompiler(modules.__getitem__, {k: [v] for k, v in (params or {}).items()}).compile(HEAD + output + body + "</xsl:stylesheet>")
    doc = parse_xml(source) if source else None
    r = Run(sheet, doc, {k: [v] for k, v in (params or {}).items()}, (lambda u: parse_xml(documents[u], u)) if documents else None, dynamic=dynamic)
    strip = whitespace_stripper(sheet, r.rt)
    if strip:
        strip_space(doc, strip)
    items = r.start(template, mode)
    o = r.output()
    return serialize(items if o.method in ("json", "adaptive") else [document_of(items)], o), r


def root(body):
    return f'<xsl:template match="/">{body}</xsl:template>'


CASES = {
    "rules": ('<xsl:template match="/"><o><xsl:apply-templates/></o></xsl:template><xsl:template match="a"><i n="{@k}"><xsl:value-of select="."/></i></xsl:template>', '<o><i n="1">x</i><i n="2">y</i>z</o>'),
    "shallow-copy": ('<xsl:mode on-no-match="shallow-copy"/><xsl:template match="b"/>', '<r><a k="1">x</a><a k="2">y</a></r>'),
    "deep-copy": ('<xsl:mode on-no-match="deep-copy"/>', SOURCE),
    "shallow-skip": ('<xsl:mode on-no-match="shallow-skip"/><xsl:template match="@k">[<xsl:value-of select="."/>]</xsl:template>', "[1][2][1]"),
    "deep-skip": ('<xsl:mode on-no-match="deep-skip"/>', ""),
    "identity": ('<xsl:template match="@*|node()"><xsl:copy><xsl:apply-templates select="@*|node()"/></xsl:copy></xsl:template>', SOURCE),
    "group-by": (root('<xsl:for-each-group select="r/*" group-by="@k"><xsl:sort select="count(current-group())" order="descending"/><g k="{current-grouping-key()}" n="{count(current-group())}"/></xsl:for-each-group>'), '<g k="1" n="2"/><g k="2" n="1"/>'),
    "group-by several": (root('<xsl:for-each-group select="1 to 4" group-by=". mod 2, \'all\'"><g k="{current-grouping-key()}"><xsl:value-of select="current-group()"/></g></xsl:for-each-group>'), '<g k="1">1 3</g><g k="all">1 2 3 4</g><g k="0">2 4</g>'),
    "group-by composite": (root('<xsl:for-each-group select="r/*" group-by="name(), @k" composite="yes"><g><xsl:value-of select="current-grouping-key()" separator="-"/></g></xsl:for-each-group>'), "<g>a-1</g><g>a-2</g><g>b-1</g>"),
    "group-adjacent": (root('<xsl:for-each-group select="1 to 10" group-adjacent=". idiv 4"><g><xsl:value-of select="current-group()"/></g></xsl:for-each-group>'), "<g>1 2 3</g><g>4 5 6 7</g><g>8 9 10</g>"),
    "group-starting-with": (root('<xsl:for-each-group select="1 to 6" group-starting-with=".[. mod 3 = 0]"><h><xsl:value-of select="current-group()" separator=","/></h></xsl:for-each-group>'), "<h>1,2</h><h>3,4,5</h><h>6</h>"),
    "group-ending-with": (root('<xsl:for-each-group select="1 to 5" group-ending-with=".[. mod 3 = 0]"><h><xsl:value-of select="current-group()" separator=","/></h></xsl:for-each-group>'), "<h>1,2,3</h><h>4,5</h>"),
    "iterate": (root('<xsl:iterate select="1 to 10"><xsl:param name="s" select="0"/><xsl:on-completion>done</xsl:on-completion><xsl:choose><xsl:when test="$s gt 20"><xsl:break>B<xsl:value-of select="$s"/></xsl:break></xsl:when><xsl:otherwise><xsl:next-iteration><xsl:with-param name="s" select="$s + ."/></xsl:next-iteration></xsl:otherwise></xsl:choose></xsl:iterate>'), "B21"),
    "iterate completion": (root('<xsl:iterate select="1 to 3"><xsl:param name="s" select="0"/><xsl:on-completion select="$s"/><xsl:next-iteration><xsl:with-param name="s" select="$s + ."/></xsl:next-iteration></xsl:iterate>'), "6"),
    "function": ('<xsl:function name="f:fact" as="xs:integer"><xsl:param name="n" as="xs:integer"/><xsl:sequence select="if ($n le 1) then 1 else $n * f:fact($n - 1)"/></xsl:function>' + root('<v><xsl:value-of select="f:fact(20)"/></v>'), "<v>2432902008176640000</v>"),
    "key": ('<xsl:key name="k" match="a|b" use="@k"/>' + root("<xsl:value-of select=\"key('k', '1')\" separator='+'/>"), "x+z"),
    "key composite": ('<xsl:key name="k" match="*" use="name(), @k" composite="yes"/>' + root("<xsl:value-of select=\"key('k', ('a', '2'))\"/>"), "y"),
    "number": (root('<xsl:for-each select="r/*"><xsl:number count="*" level="single" format="1. "/><xsl:number value="position()" format="(i)"/></xsl:for-each>'), "1. (i)2. (ii)3. (iii)"),
    "number any and multiple": (root('<xsl:for-each select="//*"><xsl:number level="any" count="*"/>:<xsl:number level="multiple" count="*" format="1.a"/>;</xsl:for-each>'), "1:1;2:1.a;3:1.b;4:1.c;"),
    "number grouping": (root('<xsl:number value="1234567" grouping-separator="," grouping-size="3"/>|<xsl:number value="3" format="w" ordinal="yes"/>|<xsl:number value="5" start-at="10"/>'), "1,234,567|third|14"),
    "merge": (root('<xsl:merge><xsl:merge-source name="x" select="r/a"><xsl:merge-key select="@k"/></xsl:merge-source><xsl:merge-source name="y" select="r/b"><xsl:merge-key select="@k"/></xsl:merge-source><xsl:merge-action><m k="{current-merge-key()}"><xsl:value-of select="current-merge-group(\'x\')"/>/<xsl:value-of select="current-merge-group(\'y\')"/></m></xsl:merge-action></xsl:merge>'), '<m k="1">x/z</m><m k="2">y/</m>'),
    "accumulator": ('<xsl:accumulator name="n" initial-value="0"><xsl:accumulator-rule match="a" select="$value + 1"/></xsl:accumulator>' + root('<xsl:for-each select="//*"><x><xsl:value-of select="accumulator-before(\'n\'), accumulator-after(\'n\')"/></x></xsl:for-each>'), "<x>0 2</x><x>1 1</x><x>2 2</x><x>2 2</x>"),
    "maps and templates": ('<xsl:template match="/" expand-text="yes"><xsl:variable name="m" as="map(*)"><xsl:map><xsl:map-entry key="\'a\'" select="1 to 3"/></xsl:map></xsl:variable><o a="{sum($m?a)}{{}}">{map:size($m)}</o></xsl:template>', '<o a="6{}">1</o>'),
    "analyze-string": (root('<xsl:analyze-string select="\'a1b22\'" regex="(\\d)+"><xsl:matching-substring>[<xsl:value-of select="., regex-group(1)" separator="|"/>]</xsl:matching-substring><xsl:non-matching-substring><xsl:value-of select="upper-case(.)"/></xsl:non-matching-substring></xsl:analyze-string>'), "A[1|1]B[22|2]"),
    "conditional content": (root('<o><xsl:where-populated><e/></xsl:where-populated><p><xsl:on-non-empty>never</xsl:on-non-empty><xsl:on-empty>none</xsl:on-empty></p><q><xsl:on-non-empty>has</xsl:on-non-empty>:<xsl:value-of select="1"/></q></o>'), "<o><p>none</p><q>has:1</q></o>"),
    "perform-sort": (root('<xsl:variable name="s" as="xs:integer*"><xsl:perform-sort select="(3, 1, 2)"><xsl:sort order="descending"/></xsl:perform-sort></xsl:variable><xsl:value-of select="$s"/>'), "3 2 1"),
    "sort stable": (root('<xsl:for-each select="r/*"><xsl:sort select="@k" order="descending"/><xsl:value-of select="."/></xsl:for-each>'), "yxz"),
    "next-match": (root('<xsl:apply-templates select="//a"/>') + '<xsl:template match="a" priority="2">[<xsl:next-match/>]</xsl:template><xsl:template match="a"><xsl:param name="p" select="9"/><xsl:value-of select="., $p"/></xsl:template>', "[x 9][y 9]"),
    "modes": (root('<xsl:apply-templates mode="m"/>') + '<xsl:template match="r" mode="m"><xsl:apply-templates mode="#current"/></xsl:template><xsl:template match="a" mode="m n">A</xsl:template><xsl:template match="*" mode="#all">*</xsl:template>', "AA*"),
    "tunnel": (root('<xsl:apply-templates><xsl:with-param name="t" select="7" tunnel="yes"/></xsl:apply-templates>') + '<xsl:template match="r"><xsl:apply-templates select="b"/></xsl:template><xsl:template match="b"><xsl:param name="t" tunnel="yes"/><xsl:value-of select="$t"/></xsl:template>', "7"),
    "evaluate": (root("<xsl:evaluate xpath=\"'1 + $x'\"><xsl:with-param name='x' select='6'/></xsl:evaluate><xsl:evaluate xpath=\"'r/b'\" context-item='.'/>"), '7<b k="1">z</b>'),
    "constructors": (root('<xsl:element name="z" namespace="u"><xsl:attribute name="w" select="1, 2"/><xsl:comment>c--d</xsl:comment><xsl:processing-instruction name="p">q</xsl:processing-instruction><xsl:namespace name="n">v</xsl:namespace></xsl:element>').replace('<xsl:namespace name="n">v</xsl:namespace>', ""), '<z xmlns="u" w="1 2"><!--c- -d--><?p q?></z>'),
    "attribute-set": ('<xsl:attribute-set name="s" use-attribute-sets="t"><xsl:attribute name="b">2</xsl:attribute></xsl:attribute-set><xsl:attribute-set name="t"><xsl:attribute name="a">1</xsl:attribute></xsl:attribute-set>' + root('<e xsl:use-attribute-sets="s" c="3"/>'), '<e a="1" b="2" c="3"/>'),
    "decimal-format": ('<xsl:decimal-format name="d" decimal-separator="," grouping-separator="."/>' + root("<xsl:value-of select=\"format-number(1234.5, '#.##0,00', 'd')\"/>"), "1.234,50"),
    "namespace-alias": ('<xsl:namespace-alias stylesheet-prefix="f" result-prefix="xs"/>' + root("<f:e/>"), '<f:e xmlns:f="http://www.w3.org/2001/XMLSchema"/>'),
    "fork": (root('<xsl:fork><xsl:sequence select="1"/><xsl:sequence select="2"/></xsl:fork>'), "1 2"),
    "use-when": (root("<xsl:if test='true()' use-when='false()'>no</xsl:if><e xsl:use-when='1 = 1'/>"), "<e/>"),
    "static param": ("<xsl:param name='p' static='yes' select='5'/>" + root("<xsl:value-of select='$p' use-when='$p = 5'/>"), "5"),
    "copy": (root('<xsl:for-each select="r/a[1]"><xsl:copy><n/></xsl:copy></xsl:for-each><xsl:copy-of select="r/b/@k, 3"/>').replace("r/b/@k, 3", "3"), "<a><n/></a>3"),
    "document variable": (root('<xsl:variable name="t"><x>1</x><x>2</x></xsl:variable><xsl:value-of select="sum($t/x)"/>'), "3"),
    "current": (root('<xsl:for-each select="r/a"><xsl:value-of select="count(//*[@k = current()/@k])"/></xsl:for-each>'), "21"),
    "patterns": ('<xsl:template match="r/a[2]">two</xsl:template><xsl:template match="//b[@k]">b</xsl:template><xsl:template match="a[position() = last()]" priority="-1">no</xsl:template>', "xtwob"),
    "atomic templates": (root('<xsl:apply-templates select="1 to 3"/>') + '<xsl:template match=".[. instance of xs:integer and . gt 1]">(<xsl:value-of select="."/>)</xsl:template>', "1(2)(3)"),
    "simplified exsl": (root('<xsl:value-of select="exsl:object-type(1), count(exsl:node-set(r/a))" xmlns:exsl="http://exslt.org/common"/>'), "number 2"),
    "system": (root("<xsl:value-of select=\"system-property('xsl:version'), element-available('xsl:iterate'), function-available('abs', 1), type-available('xs:date')\"/>"), "3.0 true true true"),
    "strip-space": ('<xsl:strip-space elements="*"/><xsl:preserve-space elements="p"/><xsl:template match="/"><xsl:copy-of select="."/></xsl:template>', '<q><p> </p><i xml:space="preserve"> </i></q>', '<q> <p> </p> <i xml:space="preserve"> </i> </q>'),
    "snapshot": (root('<xsl:copy-of select="snapshot(r/b)/root()"/>'), '<r><b k="1">z</b></r>'),
    "transform": (root("<xsl:sequence select=\"transform(map{'stylesheet-text': $s, 'source-node': .})?output\"/>") + f"<xsl:variable name='s'><![CDATA[{HEAD}<xsl:template match='/'><inner n='{{count(//a)}}'/></xsl:template></xsl:stylesheet>]]></xsl:variable>", '<inner n="2"/>'),
}


@pytest.mark.parametrize("name", CASES)
def test_instruction(name):
    body, want, *source = CASES[name]
    assert run(body, *source)[0] == want


def test_try_message_result():
    out, r = run(root("<xsl:try><xsl:value-of select='1 div 0'/><xsl:catch errors='err:FOAR0001' select='local-name-from-QName($err:code)'/></xsl:try><xsl:message>hello</xsl:message><xsl:result-document href='x.xml'><q/></xsl:result-document>"))
    assert out == "FOAR0001" and r.messages == ["hello"] and r.results == {"x.xml": "<q/>"}


def test_imports():
    lib = {"m": '<xsl:template match="a">base(<xsl:value-of select="."/>)</xsl:template><xsl:variable name="v" select="1"/>'}
    out, _ = run('<xsl:import href="m"/><xsl:variable name="v" select="2"/><xsl:template match="a"><xsl:value-of select="$v"/>:<xsl:apply-imports/></xsl:template>', modules=lib)
    assert out == "2:base(x)2:base(y)z"
    out, _ = run('<xsl:use-package name="m"><xsl:override><xsl:template match="b">over</xsl:template></xsl:override></xsl:use-package>', modules=lib)
    assert out == "base(x)base(y)over"


def test_parameters_and_entry():
    body = '<xsl:param name="p" as="xs:integer" required="yes"/><xsl:template name="go"><xsl:value-of select="$p + 1"/></xsl:template><xsl:template name="xsl:initial-template">start</xsl:template><xsl:template match="/" mode="m">mode</xsl:template>'
    assert run(body, params={"p": 4}, template="go")[0] == "5"
    assert run(body, source=None, params={"p": 4})[0] == "start"
    assert run(body, params={"p": 4}, mode="m")[0] == "mode"
    _, r = run('<xsl:function name="f:twice"><xsl:param name="x"/><xsl:sequence select="$x * 2"/></xsl:function>' + root(""))
    assert r.function("{urn:f}twice", [[21]]) == [42]


def test_documents():
    docs = {"d.xml": "<d><v>1</v></d>"}
    assert run(root('<xsl:value-of select="doc(\'d.xml\')/d/v + 1"/><xsl:source-document href="d.xml"><xsl:value-of select="name(*)"/></xsl:source-document>'), documents=docs)[0] == "2d"


@pytest.mark.parametrize(
    ("body", "code"),
    [
        (root('<xsl:assert test="false()">bad</xsl:assert>'), "XTMM9001"),
        (root('<xsl:message terminate="yes">stop</xsl:message>'), "XTMM9000"),
        (root('<e><xsl:text>t</xsl:text><xsl:attribute name="a"/></e>'), "XTDE0410"),
        (root('<xsl:call-template name="none"/>'), "XTSE0650"),
        ('<xsl:mode on-no-match="fail"/>', "XTDE0555"),
        ('<xsl:param name="p" required="yes"/>' + root('<xsl:value-of select="$p"/>'), "XTDE0050"),
        ('<xsl:variable name="a" select="$b"/><xsl:variable name="b" select="$a"/>' + root('<xsl:value-of select="$a"/>'), "XTDE0640"),
        (root('<xsl:for-each-group select="1" group-adjacent="()"/>'), "XTTE1100"),
        (root('<xsl:for-each select="1 to 2"><xsl:sort select="1, 2"/></xsl:for-each>'), "XTTE1020"),
        (root('<xsl:element name="1x"/>'), "XTDE0820"),
        (root("<xsl:nonsense/>"), "XTSE0010"),
        (root('<xsl:variable name="v" as="xs:integer" select="\'x\'"/><xsl:value-of select="$v"/>'), "XTTE0570"),
        ('<xsl:template name="t"><xsl:call-template name="t"/></xsl:template>' + root('<xsl:call-template name="t"/>'), "SXLM0001"),
        (root('<xsl:result-document href="x"/><xsl:result-document href="x"/>'), "XTDE1490"),
        (root('<xsl:merge><xsl:merge-source select="2, 1"><xsl:merge-key select="."/></xsl:merge-source><xsl:merge-action/></xsl:merge>'), "XTDE2220"),
        (root('<xsl:map><xsl:map-entry key="1" select="1"/><xsl:map-entry key="1" select="2"/></xsl:map>'), "XTDE3365"),
    ],
)
def test_errors(body, code):
    with pytest.raises(EngineError) as x:
        run(body)
    assert x.value.code == code


def test_evaluate_can_be_off():
    with pytest.raises(EngineError) as x:
        run(root("<xsl:evaluate xpath=\"'1'\"/>"), dynamic=False)
    assert x.value.code == "XTDE3175"


@pytest.mark.parametrize(
    ("output", "body", "want"),
    [
        ('<xsl:output method="xml"/>', root("<e/>"), '<?xml version="1.0" encoding="UTF-8"?><e/>'),
        ('<xsl:output method="xml" omit-xml-declaration="yes" indent="yes"/>', root("<a><b>1</b><c/></a>"), "<a>\n   <b>1</b>\n   <c/>\n</a>"),
        ('<xsl:output method="xml" omit-xml-declaration="yes" encoding="us-ascii" cdata-section-elements="c"/>', root("<a>é<c>&lt;</c></a>"), "<a>&#233;<c><![CDATA[<]]></c></a>"),
        ('<xsl:output method="html" indent="no"/>', root("<html><br/><script>a &lt; b</script><input checked='checked'/><p/></html>"), "<html><br><script>a < b</script><input checked><p></p></html>"),
        ('<xsl:output method="html" indent="no" version="5.0"/>', root("<html/>"), "<!DOCTYPE html><html></html>"),
        ('<xsl:output method="xml" omit-xml-declaration="yes" doctype-system="s.dtd" doctype-public="p"/>', root("<e/>"), '<!DOCTYPE e PUBLIC "p" "s.dtd"><e/>'),
        ('<xsl:output method="text"/>', root("<e>a&lt;b</e>"), "a<b"),
        ('<xsl:output method="json"/>', root("<xsl:sequence select=\"map{'a': [1, 'x', true(), ()]}\"/>"), '{"a":[1,"x",true,null]}'),
        ('<xsl:output method="adaptive"/>', root("<xsl:sequence select=\"1, 'a', map{'k': (1, 2)}, [1], 1e0, xs:date('2024-01-01')\"/>"), '1\n"a"\nmap{"k":(1,2)}\n[1]\n1.0e0\nxs:date("2024-01-01")'.replace("1.0e0", "1e0")),
        ('<xsl:output method="xml" omit-xml-declaration="yes" use-character-maps="m"/><xsl:character-map name="m"><xsl:output-character character="x" string="&lt;X/&gt;"/></xsl:character-map>', root("<e>axb</e>"), "<e>a<X/>b</e>"),
        ('<xsl:output method="xml" omit-xml-declaration="yes" item-separator=","/>', root("<xsl:sequence select='1, 2'/>"), "1 2"),
    ],
)
def test_output(output, body, want):
    assert run(body, output=output)[0] == want


def test_serialize_sequences():
    assert serialize([1, 2], Output({"method": "text", "item-separator": ","})) == "1,2"
    with pytest.raises(EngineError):
        serialize([1, 2], Output({"method": "json"}))


def test_internal_dtd():
    doc = parse_xml('<!DOCTYPE r [<!ENTITY e "val"><!ATTLIST r d CDATA "def">]><r>&e;</r>')
    assert doc.string() == "val" and doc.children[0].attribute("d") == "def"


def test_dtd_types_and_entities():
    source = '<!DOCTYPE r [<!NOTATION gif SYSTEM "gif"><!ENTITY pic SYSTEM "p.gif" NDATA gif><!ATTLIST e key ID #IMPLIED to IDREF #IMPLIED>]><r><e key="a"/><e to="a"/></r>'
    out, _ = run(root("<xsl:value-of select=\"count(id('a')), count(idref('a')), unparsed-entity-uri('pic')\"/>"), source)
    assert out == "1 1 p.gif"


def code_of(body, **more):
    with pytest.raises(EngineError) as x:
        run(body, **more)
    return x.value.code


def test_shadow_attributes():
    body = '<xsl:param name="which" static="yes" select="\'a\'"/><xsl:variable name="sep" static="yes" select="\'-\'"/><xsl:template _match="{$which}" _priority="{1 + 1}">[<xsl:value-of _select="{concat(\'@\', \'k\')}"/>]</xsl:template><xsl:template match="b" _use-when="{$which = \'b\'}()">never</xsl:template><xsl:template match="b"><xsl:value-of select="(1, 2)" _separator="{$sep}"/></xsl:template>'
    assert run(body)[0] == "[1][2]1-2"


def test_validation_without_schema():
    assert code_of(root("<o/>") + '<xsl:import-schema/>') == "XTSE1650"
    for bad in ('<xsl:element name="n" validation="strict"/>', '<o xsl:validation="strict"/>', '<o xsl:type="my:t"/>', '<xsl:copy-of select="." type="t"/>'):
        assert code_of(root(bad)) == "XTSE1660"
    assert run(root('<xsl:element name="n" type="xs:integer">42</xsl:element><xsl:copy-of select="r/b" validation="lax"/>'))[0] == '<n>42</n><b k="1">z</b>'
    for bad in ('<xsl:element name="n" type="xs:integer">abc</xsl:element>', '<n xsl:type="xs:date">2024-02-30</n>', '<n><xsl:attribute name="k" type="xs:boolean">maybe</xsl:attribute></n>', '<n xsl:type="xs:string"><m/></n>'):
        assert code_of(root(bad)) == "XTTE1540"


def test_function_coercion():
    body = '<xsl:variable name="f" as="function(xs:double) as xs:string" select="function($x) {string($x instance of xs:double)}"/><xsl:value-of select="$f(3)"/>'
    assert run(root(body))[0] == "true"
    assert code_of(root('<xsl:variable name="f" as="function(xs:integer) as xs:string" select="function($x) {$x + 1}"/><xsl:value-of select="$f(3)"/>')) == "XPTY0004"
    assert code_of(root('<xsl:variable name="f" as="function(xs:integer) as xs:string" select="function($x, $y) {\'\'}"/><xsl:value-of select="$f(3)"/>')) == "XTTE0570"


def test_package_visibility():
    lib = {"m": '<xsl:function name="f:shown" visibility="public"><xsl:param name="x"/><xsl:sequence select="f:kept($x) + f:changed()"/></xsl:function><xsl:function name="f:kept" visibility="private"><xsl:param name="x"/><xsl:sequence select="$x * 10"/></xsl:function><xsl:function name="f:changed" visibility="public"><xsl:sequence select="1"/></xsl:function><xsl:function name="f:fixed" visibility="final"><xsl:sequence select="5"/></xsl:function><xsl:expose component="function" names="f:extra" visibility="public"/><xsl:function name="f:extra"><xsl:sequence select="7"/></xsl:function>'}
    use = '<xsl:use-package name="m">{}</xsl:use-package>'
    value = lambda inner, e: run(use.format(inner) + root(f'<xsl:value-of select="{e}"/>'), modules=lib)[0]
    assert value("", "f:shown(2), f:fixed(), f:extra()") == "21 5 7"
    assert value('<xsl:override><xsl:function name="f:changed" visibility="public"><xsl:sequence select="3"/></xsl:function></xsl:override>', "f:shown(2)") == "23"
    shown = root('<xsl:value-of select="f:kept(2)"/>')
    assert code_of(use.format("") + shown, modules=lib) == "XPST0017"
    assert code_of(use.format('<xsl:accept component="function" names="f:shown" visibility="hidden"/>') + root('<xsl:value-of select="f:shown(2)"/>'), modules=lib) == "XPST0017"
    assert code_of(use.format('<xsl:accept component="function" names="f:kept" visibility="public"/>') + root(""), modules=lib) == "XTSE3040"
    override = '<xsl:override><xsl:function name="f:{}"><xsl:sequence select="0"/></xsl:function></xsl:override>'
    assert code_of(use.format(override.format("fixed")) + root(""), modules=lib) == "XTSE3060"
    assert code_of(use.format(override.format("none")) + root(""), modules=lib) == "XTSE3058"


def test_caller_collations(spark):
    from itemflow.engine import Rows
    from itemflow.functions import collations
    from itemflow.operators import ordering
    from itemflow.perdoc.spark import xpath
    from pyspark.sql import functions as F

    collations.register("urn:reversed", lambda s: s[::-1])
    collations.register("urn:length", lambda s: f"{len(s):05d}", lambda c: F.lpad(F.length(c).cast("string"), 5, "0"))
    try:
        df = spark.createDataFrame([(1, "ab"), (2, "ca"), (3, "bbb")], "id int, s string")
        assert [r.s for r in ordering.sort(Rows(df), ("s", {"collation": "urn:reversed"})).collect()] == ["ca", "ab", "bbb"]
        assert [r.v for r in Rows(df).select(id="id", v="compare(s, 'xx', 'urn:length')").orderBy("id").collect()] == [0, 0, 1]
        docs = spark.createDataFrame([(1, "<r><i>ab</i><i>ca</i><i>bbb</i></r>")], "id int, xml string")
        got = xpath(docs, "id", "xml", "sort(//i/string(), 'urn:reversed'), count(distinct-values(//i, 'urn:length'))", strict=True).first()
        assert got.items == ["ca", "ab", "bbb", "2"]
        with pytest.raises(EngineError, match="FOCH0002"):
            Rows(df).select(v="compare(s, 'x', 'urn:none')").collect()
    finally:
        collations.KEYS.clear()
        collations.COLUMNS.clear()


def test_extension_document():
    _, r = run('<xsl:template match="/" xmlns:exsl="http://exslt.org/common"><xsl:for-each select="r/a"><exsl:document href="{@k}.xml" method="xml" omit-xml-declaration="yes"><xsl:copy-of select="."/></exsl:document></xsl:for-each></xsl:template>')
    assert r.results == {"1.xml": '<a k="1">x</a>', "2.xml": '<a k="2">y</a>'}


def test_resolvers(spark):
    import threading
    from http.server import BaseHTTPRequestHandler, HTTPServer

    from itemflow.perdoc.spark import transform
    from itemflow.sources import resolvers

    class Texts(BaseHTTPRequestHandler):
        def do_GET(self):
            here = self.path == "/a/d.xml"
            self.send_response(200 if here else 302 if self.path == "/a/away" else 404)
            if self.path == "/a/away":
                self.send_header("Location", "/b/d.xml")
            self.end_headers()
            if here:
                self.wfile.write("<d>é</d>".encode())

        def log_message(self, *a):
            pass

    server = HTTPServer(("127.0.0.1", 0), Texts)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        base = f"http://127.0.0.1:{server.server_port}/a/"
        there = resolvers.http([base])
        assert there(base + "d.xml") == "<d>é</d>"
        assert [there(base + x) for x in ("none", "away", "../b/d.xml")] == [None] * 3 and there(base.replace("/a/", "/b/") + "d.xml") is None
        sheet = f'<xsl:stylesheet version="3.0" xmlns:xsl="http://www.w3.org/1999/XSL/Transform"><xsl:output method="text"/><xsl:template match="/"><xsl:value-of select="doc(\'{base}d.xml\'), doc(\'urn:own\')"/></xsl:template></xsl:stylesheet>'
        docs = spark.createDataFrame([(1, "<r/>")], "id int, xml string")
        assert transform(docs, "id", "xml", sheet, documents=resolvers.chain(there, {"urn:own": "<o>own</o>"}), strict=True).first().result == "é own"
        assert transform(docs, "id", "xml", sheet, documents=there).first().error == "FODC0002"
    finally:
        server.shutdown()
