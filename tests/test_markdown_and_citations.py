from hypothesis import given, settings
from hypothesis import strategies as st

from quillstone.functions import citations as C
from quillstone.functions import html as H
from quillstone.functions import markdown as M
from quillstone.functions import pdf as P

DOC = "# A\n\nIntro here. Things are:\n\n* one\n* two\n  * inner\n* three\n\n## B\n\n| a | b |\n| --- | --- |\n| 1 | 2 |\n| 3 | 4 |\n\nA long paragraph. " + "Some words here. " * 30 + "\n\n### C\n\n1. x\n2. y\n\n> quote\n\n```\ncode\n```\n\n# D\n\nlast"


def test_normalising_twice_changes_nothing():
    assert M.normalised(M.normalised(DOC)) == M.normalised(DOC)


def test_chunks_hold_every_word_within_the_bound():
    for most in (8, 20, 47, 75, 175):
        found = M.chunks(DOC, M.ChunkingConfig(most))
        assert all(c.length <= most for c in found)
        said = " ".join(c.text for c in found).split()
        for word in M.normalised(DOC).split():
            assert word in said
        assert [c.index for c in found] == list(range(len(found)))
        assert all(not c.text.split("\n\n")[-1].startswith("#") for c in found if most > 20)


def test_split_tables_repeat_their_introduction():
    md = "Table intro:\n\n" + "\n".join(f"| row {k} | value {k} |" for k in range(20))
    pieces = [c.text for c in M.chunks(md, M.ChunkingConfig(40))]
    assert pieces[0].startswith("Table intro:")
    assert all(p.startswith("(Table intro:)") for p in pieces[1:] if p.count("|") > 3)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from(["# H", "## I", "text one. text two.", "* item", "| a | b |", "", "word " * 30, "1. n", "> q"]), max_size=25), st.integers(5, 60))
def test_any_document_is_covered(lines, most):
    md = "\n".join(lines)
    found = M.chunks(md, M.ChunkingConfig(most))
    assert all(c.length <= most for c in found)
    assert sum(c.text.count("word") for c in found) >= md.count("word")


def test_splits_by_characters():
    assert all(len(p) <= 50 for p in M.split_paragraph("One sentence. " * 20, 50))
    pieces = M.split_list("Intro:\n" + "\n".join(f"- item {k}" for k in range(20)), 60)
    assert all(p.startswith("Intro:\n") and len(p) <= 60 for p in pieces)


def test_subsections_keep_a_list_with_its_introduction():
    found = M.subsections("When someone applies.\n\nThe officer considers:\n\n* Health\n* Age\n\nThe officer weighs.", ("Rule",))
    assert [t.split("\n")[0] for _, t in found] == ["When someone applies.", "The officer considers:", "The officer weighs."]
    assert "* Health" in found[1][1]
    assert found[0][0] == ("Rule",)


def subs():
    at = [("1", "a", 0), ("2", "a", 1), ("3", "x", 0), ("4", "b", 0), ("5", "b", 1), ("6", "b", 2)]
    return {f"citation-{i}": C.Cited(f"citation-{i}", c, k, f"text {i}") for i, c, k in at}


def test_citations_move_behind_marks():
    text = "Some text (citation-1). No space(citation-2)? Right. (citation-3)\n- On a line (citation-4) (citation-5)!\n\nNew paragraph (citation-100).\n"
    want = "Some text. (citation-1) No space? (citation-2) Right. (citation-3)\n- On a line! (citation-4) (citation-5)\n\nNew paragraph. (citation-100)"
    assert C.behind_marks(text) == want


def test_contiguous_citations_merge_and_renumber():
    answer = "B. (citation-4) (citation-5) (citation-6) Other. (citation-3) A. (citation-1) (citation-2) (citation-3) Back. (citation-5) (citation-4) "
    text, found = C.merged(answer, subs())
    assert text == "B. (citation-000400050006) Other. (citation-3) A. (citation-00010002) (citation-3) Back. (citation-5) (citation-4) "
    assert found["citation-00010002"].text == "text 1\n\ntext 2"
    text, cited = C.renumbered(text, found)
    assert text == "B. (citation-1) Other. (citation-2) A. (citation-3) (citation-2) Back. (citation-4) (citation-5) "
    assert [c.id for c in cited] == ["1", "2", "3", "4", "5"]


def test_unknown_citations_go():
    assert C.simplified("", list(subs().values())) == ("", [])
    assert C.simplified("Non-existent citation: (citation-0)", []) == ("Non-existent citation:", [])


def test_prompt_context():
    assert C.prompt_context([]) == ""
    assert C.prompt_context([("citation-1", "Doc", ["H", "I"], "text"), ("citation-2", "Doc", [], "more")]) == "Citation: citation-1\nDocument name: Doc\nHeadings: H > I\nContent: text\n\nCitation: citation-2\nDocument name: Doc\nContent: more"


def test_pages_become_markdown():
    page = H.parse("<html><head><title>t</title><style>p{}</style></head><body><nav><a href='/n'>n</a></nav><h1>One &amp; two</h1><p>A <b>bold</b> <a href='/x'>link</a><p>next<ul><li>a<li>b</ul><table><tr><th>h</th></tr><tr><td>c</td></tr></table><script>var x='</p>'</script></body></html>", "http://h.org/p/")
    assert page.title == "One & two"
    assert "[link](http://h.org/x)" in page.markdown
    assert "* a\n* b" in page.markdown
    assert "| h |\n| --- | \n| c |" in page.markdown
    assert "var" not in page.markdown
    assert "/n" not in page.markdown
    assert H.parse(None).markdown == ""


def test_pdf_texts_group():
    one, two = ("Overview",), ("Section 1",)
    texts = [
        P.Text("Introduction.", P.NARRATIVE, one, 1), P.Text("First item.", P.ITEM, one, 1), P.Text("Second item.", P.ITEM, one, 1), P.Text("Another narrative text.", P.NARRATIVE, one, 1),
        P.Text("Narrative starting a new list: ", P.NARRATIVE, one, 1), P.Text("First item in new list.", P.ITEM, one, 1), P.Text("Second item in new list.", P.ITEM, one, 1),
        P.Text("New list item in new section", P.ITEM, two, 1), P.Text("with continuing sentence on next page", P.NARRATIVE, two, 2),
    ]
    got = P.grouped(texts)
    assert [(t.text, t.type) for t in got] == [
        ("Introduction.\nFirst item.\nSecond item.\n\nAnother narrative text.\n\nNarrative starting a new list: \nFirst item in new list.\nSecond item in new list.", P.NARRATIVE),
        ("New list item in new section with continuing sentence on next page", P.ITEM),
    ]
    assert P.with_bold("a b a", ["a", "z"]) == ("**a** b a", ["z"])
    assert P.with_links("see it now", [(4, "it", "http://x")]) == "see [it](http://x) now"
