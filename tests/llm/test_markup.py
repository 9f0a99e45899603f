import numpy as np
import pytest

from leafmill.llm import markup as M

SENTENCES = ["The drive unit was tested before delivery.", "See page 4 for the position of the holes.", "Der Prüfstand erfüllt die Toleranz.", "运行之后需要再次检验。", "Please return the form to the office before Monday.", "The scanned annex lost 12 g of oil (two-stage)."]
HTML = "<h2>Title</h2><p>Some <b>bold</b> text.</p><ul><li>One thing.<ul><li>Inner thing.</li></ul></li><li>Two things.</li></ul><pre>- a\n# b\n**x**</pre><table><tr><td>1</td><td>2</td></tr></table><p>\\(E = 5\\)</p>"
MD = "# Title\n\nSome **bold** text.\n\n- One thing here.\n    - Inner thing here.\n- Two things here.\n\n```\n- a\n# b\n```\n\n| 1 | 2 |\n| --- | --- |\n| 3 | 4 |\n\n$E = 5$ holds."
WIKI = "== Title ==\n\nSome '''bold''' text.\n\n# One thing here.\n# Two things here.\n\n<syntaxhighlight lang=\"x\">\na\n</syntaxhighlight>\n\n{| class=\"g\"\n|-\n| 1 || 2\n|}\n\n<math>E = 5</math>"
TEX = "\\section{Title}\n\nSome \\textbf{bold} text.\n\n\\begin{itemize}\n  \\item One.\n\\end{itemize}\n\n\\begin{verbatim}\n\\section{no}\n\\end{verbatim}\n\n\\begin{tabular}{ll}\n1 & 2 \\\\\n\\end{tabular}\n\n\\begin{equation}\nE = 5\n\\end{equation}"
ALL = {e: 1 for e in M.ELEMENTS}


@pytest.fixture(scope="module")
def model():
    return M.fit(SENTENCES)


@pytest.mark.parametrize("text", [HTML, MD, WIKI, TEX, HTML.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;")])
def test_every_dialect(model, text):
    assert M.elements(model.read([text])[0][1]) == ALL


@pytest.mark.parametrize("text", ["", " ", "Plain text. Nothing else.", "a_12_b = {5} (X-1)", "<3 mm / >4 mm", "$ 5 ; $ 7", "The text.\n- 1 -\nGoes on.", "[5] *) #3", "326 < 7 & 233 > 3", "C:\\temp\\5", "15. The offer is valid until Monday."])
def test_signs_of_the_text_are_no_markup(model, text):
    assert M.elements(model.read([text])[0][1]) == {}


def test_held_out_accuracy():
    boosted = M.fit(SENTENCES).boosted
    rows, truth = M.training_rows(SENTENCES, 200, seed=99)
    assert ((boosted.log_odds(rows) > 0) == truth).mean() > 0.97


def test_decoding_keeps_descendants_out_of_code():
    nodes = M.nodes_of("```\n# a\n**b**\n```")
    assert [M.KINDS[n.kind] for n in nodes if n.parent < 0] == ["fence"]
    odds = np.array([2.0 if M.KINDS[n.kind] == "fence" else 0.5 for n in nodes])
    assert [M.KINDS[n.kind] for n, c in zip(nodes, M.decode(nodes, odds)) if c] == ["fence"]
    assert sum(M.decode(nodes, np.where(odds > 1, -3.0, 0.5))) == len(nodes) - 1 - sum(M.KINDS[n.kind] == "hash_list" for n in nodes) + sum(M.KINDS[n.kind] == "hash_list" for n in nodes)


def test_clean_text(model):
    for text in (HTML, MD, WIKI, TEX):
        out = M.clean(*model.read([text])[0])
        assert "# Title" in out and "bold" in out and "**bold" not in out and "'''" not in out and "<" not in out.replace("a\n# b", "") and "- One" in out and "```" in out and "| 1 | 2 |" in out and "$E = 5$" in out


def test_frames(spark, model):
    df = spark.createDataFrame([(1, HTML, "x"), (1, HTML, "x"), (2, None, None), (3, "", None), (4, "<pre>" + "y" * 60_000, None)], "doc_id long, text string, element string")
    got = M.found(df, model).collect()
    assert sum(r.doc_id == 1 for r in got) == 12 and {r.element for r in got if r.doc_id == 4} == {"code"} and {r.doc_id for r in got} == {1, 4}
    assert M.found(df.where("false"), model).count() == 0
    assert {r.doc_id: r.text for r in M.cleaned(df, model, ["doc_id"]).collect()}[2] is None


def test_fitting_on_a_corpus_without_plain_texts(spark):
    df = spark.createDataFrame([(1, None)], "doc_id long, text string")
    assert M.elements(M.fit_on(df).read([MD])[0][1]) == ALL


def _chain(kinds):
    nodes = [M.Node(k, 100 - k, M.KIND[kind], (k, 100 - k), parent=k - 1, children=[k + 1] if k + 1 < len(kinds) else []) for k, kind in enumerate(kinds)]
    return nodes


def test_decoding_is_the_optimum():
    nodes = _chain(["tag_list", "tag_table", "tag_list"])
    assert M.decode(nodes, np.array([1.0, -5.0, 3.0])) == [False, False, True]
    rng = np.random.default_rng(5)
    for _ in range(200):
        kinds = [M.KINDS[k] for k in rng.integers(0, len(M.KINDS), 7)]
        nodes = [M.Node(0, 0, M.KIND[k], (0, 0), parent=int(rng.integers(-1, i)) if i else -1) for i, k in enumerate(kinds)]
        for i, n in enumerate(nodes):
            if n.parent >= 0:
                nodes[n.parent].children.append(i)
        odds = rng.normal(0, 2, 7)

        def consistent(mask):
            for i, n in enumerate(nodes):
                up = n.parent
                while mask >> i & 1 and up >= 0:
                    inside = M._inside(M.ELEMENT_OF[nodes[up].kind])
                    if mask >> up & 1 and ("*" in inside or M.ELEMENT_OF[n.kind] in inside):
                        return False
                    up = nodes[up].parent
            return True

        best = max(sum(odds[i] for i in range(7) if m >> i & 1) for m in range(128) if consistent(m))
        got = M.decode(nodes, odds)
        mask = sum(1 << i for i, c in enumerate(got) if c)
        assert consistent(mask) and abs(sum(o for o, c in zip(odds, got) if c) - best) < 1e-9


def test_only_chosen_markup_is_taken_away(model):
    text = "See a <b and c> d; https://x.org/?a=1&copy=2 and 5 <x and y> 3"
    assert M.clean(*model.read([text])[0]) == text
    assert M.clean("<p>one</p><x-y>&lt; two", []) == "one\n<x-y>&lt; two"
    assert M.unescaped("&lt;p&gt;a&lt;/p&gt; ?a=1&copy=2") == "<p>a</p> ?a=1&copy=2"


@pytest.mark.parametrize("long", ["$" + "x + " * 900 + "y$", "$$" + "x + " * 900 + "y$$", "\\(" + "x + " * 900 + "y\\)", "\\[" + "x + " * 900 + "y\\]"])
def test_formulas_of_any_length(model, long):
    assert [M.ELEMENT_OF[n.kind] for n in M.nodes_of("Here is it: " + long + " and on.") if n.start == 12] == ["formula"]


def test_arguments_and_emphasis_of_any_length():
    nodes = M.nodes_of("\\footnote{" + "long {nested} words " * 100 + "} then **" + "many words " * 60 + "x** and \\emph{never closed")
    assert [(M.KINDS[n.kind], n.closed) for n in nodes] == [("tex_inline", True), ("stars", True), ("tex_inline", False)]


def test_features_see_the_whole_node():
    text = "<ul><li>" + "word " * 300 + "1 2 3</li></ul>"
    node = M.nodes_of(text)[0]
    inner = text[node.inner[0] : node.inner[1]]
    row = M.features(text, [node])[0, len(M.KINDS) :]
    assert row[1] == len(inner.split()) and abs(row[4] - 3 / len(inner)) < 1e-6


def test_reading_is_linear_in_unclosed_marks():
    for unit in ("\\(a ", "\\emph{", "**a ", "$$ a ", "[[", "<b ", "&a"):
        M.nodes_of(unit * 20_000)
