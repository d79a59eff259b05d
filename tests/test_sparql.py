"""The parser: what it reads, and what it refuses."""

import pytest

from triplespark.functions.terms import RDF_TYPE, XSD, TermError, literal, unescape
from triplespark.plans.ast import Pattern, SparqlSyntaxError, UnsupportedSparqlError, Var
from triplespark.plans.sparql import parse


def test_everything_in_one():
    q = parse('''
      BASE <http://b/> PREFIX x: <y#> prefix : <http://e/>  # names
      SELECT REDUCED ?a $b WHERE {
        ?a a x:C ; x:p "l"@EN, 'v'^^x:dt, 5, -1.5, 1e3, true, """long "q"
text""" ;; .
        [ x:q ?b ; x:r [] ] . ?a <rel> _:z . _:z :p.q "a\\u00e9\\n" }''')
    assert q.select == ("a", "b")
    a, p = Var("a"), "<http://b/y#p>"
    objects = [t.o for t in q.patterns if t.p == p]
    assert q.patterns[0] == Pattern(a, RDF_TYPE, "<http://b/y#C>")
    assert objects == ['"l"@en', '"v"^^<http://b/y#dt>', f'"5"^^<{XSD}integer>', f'"-1.5"^^<{XSD}decimal>', f'"1e3"^^<{XSD}double>', f'"true"^^<{XSD}boolean>', '"long \\"q\\"\\ntext"']
    assert Pattern(a, "<http://b/rel>", q.patterns[-1].s) in q.patterns
    assert q.patterns[-1].p == "<http://e/p.q>" and q.patterns[-1].o == '"aé\\n"'
    assert len(q.patterns) == 12
    assert "SELECT ?a ?b WHERE" in str(q)


def test_star_is_in_order_of_appearance_without_blank_nodes():
    assert parse("SELECT * { ?z <p> ?y . _:b <q> ?x . [] <r> ?z }").select == ("z", "y", "x")
    assert parse("PREFIX : <http://e/> SELECT DISTINCT ?s WHERE { ?s :p\\,x ?o . }").patterns[0].p == "<http://e/p,x>"
    assert parse("SELECT ?s { ?s ?p ?o }").patterns[0].bitmap == 7
    assert parse("SELECT ?s ?s { ?s <p> ?o }").select == ("s",)
    assert parse("SELECT ?s { ?s <p> ?o }").patterns[0].p == "<http://example.org/p>"


@pytest.mark.parametrize("text", [
    "", "SELECT", "SELECT ?x", "SELECT ?x {", "SELECT ?x { ?x ?p }", "SELECT { ?x ?p ?o }", "SELECT ?x { ?x a:b ?o }", 'SELECT ?x { ?x "p" ?o }', 'SELECT ?x { ?x <p> "\\q" }',
    "SELECT ?x { ?x <p> ?o } }", "SELECT ?x { ?x <p> ?o ?q }", 'SELECT ?x { ?x <p> "open }', "PREFIX x <y> SELECT ?x { ?x <p> ?o }", "BASE x: SELECT ?x { ?x <p> ?o }", 'SELECT ?x { ?x <p> "v"^^5 }', "SELECT ?x { ?x <p> ?o } trailing", "SELECT ?x { ?x <p> % }",
])
def test_syntax_errors(text):
    with pytest.raises(SparqlSyntaxError):
        parse(text)


@pytest.mark.parametrize("text", [
    "ASK { ?s ?p ?o }", "CONSTRUCT { ?s ?p ?o } WHERE { ?s ?p ?o }", "SELECT ?x { ?x ?p ?o FILTER(?o > 1) }", "SELECT ?x { ?x ?p ?o OPTIONAL { ?x ?q ?r } }", "SELECT ?x { { ?x ?p ?o } }",
    "SELECT ?x { { ?x ?p ?o } UNION { ?x ?q ?r } }", "SELECT ?x { ?x <p>/<q> ?o }", "SELECT ?x { ?x ^<p> ?o }", "SELECT ?x { ?x <p>* ?o }", "SELECT ?x { ?x <p> ?o } LIMIT 3", "SELECT ?x { ?x <p> ?o } ORDER BY ?x",
    "SELECT (COUNT(?x) AS ?n) { ?x <p> ?o }", "SELECT ?z { ?x <p> ?o }", "SELECT * { <a> <b> <c> }", "SELECT ?x FROM <g> { ?x <p> ?o }", "SELECT ?x { ?x <p> (1 2) }", "SELECT ?x { }", "SELECT ?x { GRAPH <g> { ?x <p> ?o } }", "INSERT DATA { <a> <b> <c> }",
])
def test_refused(text):
    with pytest.raises(UnsupportedSparqlError):
        parse(text)


def test_terms():
    assert unescape(r"a\tbé\U0001F600\\") == "a\tbé😀\\"
    assert literal('a"b\\c\nd') == r'"a\"b\\c\nd"'
    assert literal("x", datatype=XSD + "string") == '"x"'
    for bad in (r"\x", r"\UFFFFFFFF"):
        with pytest.raises(TermError):
            unescape(bad)
