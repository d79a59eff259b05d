"""Small data with results known by hand."""

GRAPH = [tuple(line.split()) for line in """
1 6 1
6 25 22
3 7 25
3 5 3
1 6 17
4 7 10
3 6 4
3 7 20
3 6 6
1 7 20
1 8 19
2 8 16
2 9 9
3 4 5
2 7 19
3 7 9
1 6 14
1 6 21
3 6 20
6 7 15
6 25 18
1 9 21
5 20 12
""".split("\n") if line]

#: Statements written for these tests, from the N-Triples grammar: books, people, and what is odd in syntax.
NTRIPLES = r"""<http://a/book/moby> <http://a/p> <http://a/sea> .
<http://a/book/emma> <http://a/p> "Emma" .
<http://a/book/moby> <http://a/p> "Moby-Dick; or, The \"Whale\"" . # quotes are escaped
<http://a/person/jane> <http://a/p> _:house .
_:house <http://a/p> <http://a/sea> .
<http://a/book/emma>	<http://a/p>	"three\nlines\r\nof \\ text"	.
	 <http://a/person/olé> <http://a/p> <http://a/sea> . 	
#<http://a/book/gone> <http://a/p> <http://a/sea> .

<http://a/num> <http://a/p> "42"^^<http://www.w3.org/2001/XMLSchema#integer> .
<http://a/str> <http://a/p> "Emma"^^<http://www.w3.org/2001/XMLSchema#string> .
<http://a/tag/1> <http://a/p> "colour"@en-GB .
<http://a/tag/2> <http://a/p> "farbe"@DE .
<http://a/esc/1> <http://a/p> "caf\u00E9" .
<http://a/esc/2> <http://a/p> "\U0001F433 said \u0022hi\u0022" .
<http://a/esc/3> <http://a/p> "tab\there" .
<http://a/esc/4> <http://a/p> "no escape: \\u00E9" .
<http://a/none> <http://a/p> "" .
<http://a/tight><http://a/p>_:house.
<http://a/book/moby> <http://a/p> <http://a/sea> .
just some words
"Emma" <http://a/p> <http://a/book/emma> .
<http://a/book/emma> _:house "Emma" .
"""

P = "<http://a/p>"
#: What these lines say, canonical, in order.
STATEMENTS = [
    ("<http://a/book/moby>", P, "<http://a/sea>"), ("<http://a/book/emma>", P, '"Emma"'), ("<http://a/book/moby>", P, r'"Moby-Dick; or, The \"Whale\""'),
    ("<http://a/person/jane>", P, "_:house"), ("_:house", P, "<http://a/sea>"), ("<http://a/book/emma>", P, r'"three\nlines\r\nof \\ text"'),
    ("<http://a/person/olé>", P, "<http://a/sea>"), ("<http://a/num>", P, '"42"^^<http://www.w3.org/2001/XMLSchema#integer>'), ("<http://a/str>", P, '"Emma"'),
    ("<http://a/tag/1>", P, '"colour"@en-gb'), ("<http://a/tag/2>", P, '"farbe"@de'), ("<http://a/esc/1>", P, '"café"'), ("<http://a/esc/2>", P, r'"🐳 said \"hi\""'),
    ("<http://a/esc/3>", P, '"tab\there"'), ("<http://a/esc/4>", P, r'"no escape: \\u00E9"'), ("<http://a/none>", P, '""'), ("<http://a/tight>", P, "_:house"),
    ("<http://a/book/moby>", P, "<http://a/sea>"),
]
