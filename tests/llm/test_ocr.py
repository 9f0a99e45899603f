import pytest

from leafmill.llm import ocr as O

HEAD = "Quality manual, revision 4"
PAGE = """Quality manual, revision 4
The drive unit requires another inspec-
tion because the fixture was loose and
the v1sible damage was found at the two-
stage test bench after 8O4 hours of work
1/2
\fQuality manua1, revision 4
under the supervision of the quality team
when
ever the guard is open and the motor of
the unit BX-12 runs. It stops on page 7.
2/2"""


@pytest.fixture(scope="module")
def model():
    words = "The drive unit requires another inspection because the fixture was loose and visible damage found at two stage test bench after hours of work under supervision quality team when whenever guard is open motor runs It stops on page".split()
    furniture = frozenset({O.template(HEAD)[0]})
    return O.Model({w: 900 for w in words}, furniture, {})


def test_lines(model):
    noise = [sorted(n) for n in O.read(PAGE, model).noise]
    assert noise == [["header"], ["hyphen"], [], ["misread"], ["misread"], ["page_number"], ["header"], [], ["hyphen"], [], [], ["page_number"]]


def test_repaired(model):
    text = O.repaired(PAGE, model)
    assert "inspection because" in text and "visible" in text and "two-stage" in text.replace("two- stage", "two-stage") and "804 hours" in text and "whenever" in text and "Quality manual" not in text and "1/2" not in text


@pytest.mark.parametrize("line, want", [("1", ("bare", 1)), ("- 12 -", ("dash", 12)), ("[3]", ("square", 3)), ("l/4", ("slash", 1)), ("Page 2 of 9", ("named", 2)), ("Seite 4 von 5", ("named", 4)), ("iv", ("roman", 4)), ("第 3 页 共 8 页", ("han", 3)), ("Chapter 3", None), ("7.", None), ("", None), ("12 mm", None)])
def test_page_numbers(line, want):
    assert O.page_number(line) == want


def test_numbers_that_count_up(model):
    text = "\n".join(f"some words that go on and on over lines\nand more of the words over the line\n{x}" for x in (1, 2, 427, 3))
    noise = O.read(text, model).noise
    assert [k for k, n in enumerate(noise) if "page_number" in n] == [2, 5, 11]


@pytest.mark.parametrize("true, read, cost", [("visible", "v1sible", 1), ("humidity", "humiclity", 1), ("according", "accordmg", 1), ("labelled", "labe11ed", 2), ("turno", "tumo", 1), ("refrigeração", "refngeração", 1), ("same", "same", 0), ("dog", "cat", 4)])
def test_plausible_edits(true, read, cost):
    assert O.edits(true, read) == cost
    if cost < 4:
        assert O.skeleton(true) == O.skeleton(read)


def test_corrections_need_a_frequent_neighbour(model):
    assert model.correction("v1sible", []) == "visible" and model.correction("Turbel", []) is None
    model2 = O.Model({"form": 400, "forrn": 100}, frozenset(), {})
    assert model2.correction("forrn", []) is None


@pytest.mark.parametrize("text", ["", " ", "\n\n", "\f", "One line only."])
def test_empty_and_short(model, text):
    assert not any(O.read(text, model).noise)


def test_frames(spark):
    long = "\n".join(["The words of a text go on over the lines of"] * 4000)
    rows = [(1, PAGE, "scanned", "x"), (1, PAGE, None, "x"), (2, None, None, None), (3, "", "scanned", None), (4, "Native text. All of it.", "native", None), (5, long, "native", None)] + [(10 + k, PAGE.replace("v1sible", "visible"), None, None) for k in range(25)]
    df = spark.createDataFrame(rows, "doc_id long, text string, scan_type string, noise string")
    model = O.learn(df)
    assert model.words["drive"] >= 25 and O.template(HEAD)[0] in model.furniture
    got = O.found(df, model).collect()
    assert sum(r.doc_id == 1 for r in got) == sum(r.doc_id == 1 and r.noise != "none" for r in got) > 10 and not {r.doc_id for r in got} & {2, 3, 4}
    assert {r.doc_id: r.text for r in O.texts(df, model).collect()}[4] == "Native text. All of it."
    assert O.found(df.where("false"), O.learn(df.where("false"))).count() == 0


def test_thresholds_stay_below_the_bound(spark):
    df = spark.createDataFrame([(f"w{k}", 1 + k // 10) for k in range(100)], "key string, docs long")
    kept = O._most_frequent(df, 35)
    assert 0 < len(kept) <= 35 and min(r.docs for r in kept) > max(r.docs for r in df.collect() if r.key not in {x.key for x in kept})


def test_entries_as_a_page(spark):
    rows = [(1, 0, 0, "a"), (1, 0, 0, "a"), (1, 0, 2, "b"), (1, 1, 0, "c"), (1, 0, 3, None), (2, 0, 0, None)]
    df = spark.createDataFrame(rows, "doc_id long, page_index int, entry_idx int, text string")
    assert [tuple(r) for r in O.entry_texts(df).collect()] == [(1, "a\n\nb\n\fc")]


@pytest.mark.parametrize("times", [1, 10, 1000])
def test_breaks_without_a_sign_are_the_same_at_every_size(times):
    counts = {"inspection": 400, "inspec": 1, "tion": 2, "overall": 30, "over": 900, "all": 900, "the": 900}
    model = O.Model({w: n * times for w, n in counts.items() if n * times >= O.KNOWN}, frozenset(), {})
    text = "the inspec\ntion of the over\nall the"
    assert [sorted(n) for n in O.read(text, model).noise] == [["hyphen"], [], []]


def test_what_the_bounds_leave_out_is_looked_up(spark, monkeypatch):
    rows = [(k, PAGE.replace("v1sible", "v1sible" if k < 3 else "visible"), None) for k in range(30)] + [(40 + k, "we see the visible words inspection whenever of a text", "native") for k in range(60)]
    df = spark.createDataFrame([*rows, (100, None, None)], "doc_id long, text string, scan_type string")
    whole = O.learn(df)
    monkeypatch.setattr(O, "VOCABULARY", 3)
    monkeypatch.setattr(O, "TEMPLATES", 0)
    part = O.learn(df)
    assert whole.rest is None and len(part.words) <= 3 and not part.furniture and len(part.vectors) < len(whole.vectors)
    want = sorted(O.found(df, whole).collect())
    assert {r.noise for r in want} == {"header", "hyphen", "misread", "page_number"}
    assert sorted(O.found(df, part).collect()) == want == sorted(O.found(None, whole).collect())
    assert sorted(O.texts(df, part).collect()) == sorted(O.texts(df, whole).collect())


def _scans(spark, pairs):
    """Scanned texts of (words, times), a line each, in an order that mixes them."""
    rows = [(k, f"{words}\nand so on", "scanned") for words, times in pairs for k in range(times)]
    return spark.createDataFrame(rows, "doc_id long, text string, scan_type string")


RARE = "we read the instriiction before work"


def test_vectors_link_what_counts_alone_do_not(spark):
    others = [("our big red machine runs fast today", 30), ("der neue Plan kommt morgen sehr spät", 30)]
    model = O.learn(_scans(spark, [("we read the instruction before work", 160), (RARE, 8), *others]))
    assert "instriiction" in model.vectors and 160 < 8 * O.LINK
    assert O.read(RARE, model).fixed[0] == {"instriiction": "instruction"}
    without = O.Model(model.words, model.furniture, {})
    assert O.read(RARE, without).fixed[0] == {}


def test_vectors_refuse_what_counts_alone_would_link(spark):
    pairs = [("the pump often fails after some hours", 1500), ("a stone slowly falls from that roof", 6), ("der neue Plan kommt morgen sehr spät", 300)]
    model = O.learn(_scans(spark, pairs))
    text = "a stone slowly falls from that roof"
    assert model.words["fails"] > O.LINK * model.words["falls"]
    assert O.read(text, model).fixed[0] == {} and O.read(text, O.Model(model.words, model.furniture, {})).fixed[0] == {"falls": "fails"}


def test_the_same_words_have_vectors_at_every_size(spark):
    line = "the words of a line that some text holds now " * 3
    small, large = (O.learn(_scans(spark, [(line, times), ("once only here stands", 1)])).vectors for times in (3, 400))
    assert set(small) == set(large) and "words" in small and "only" not in small


def test_page_words_are_learnt_from_numbers_that_count_up(spark):
    page = "some words that go on and on over lines\nand more of the words over the line"
    rows = [(k, "\n\f".join(f"{page}\nOldal {n}" for n in (1, 2, 3)), "scanned") for k in range(5)] + [(9, f"{page}\nOldal 4\n{page}", "scanned")]
    rows += [(20 + k, f"{page}\nTafel 4\n{page}\nTafel 9\n{page}", "scanned") for k in range(5)]
    model = O.learn(spark.createDataFrame(rows, "doc_id long, text string, scan_type string"))
    assert model.page_words == {O.skeleton("Oldal")}
    assert {(r.doc_id, r.line_no) for r in O.found(None, model).where("noise = 'page_number'").collect()} == {(k, n) for k in range(5) for n in (3, 6, 9)} | {(9, 3)}


def test_long_titles_and_pages_beside_long_lines(spark):
    title = "Record of the inspections and repairs of all the drive units of the plant in the northern hall and"
    page = f"{title}\nsome words that go on and on over lines\nand more of the words over the line"
    assert len(title) > O.TITLE
    model = O.learn(spark.createDataFrame([(k, f"{page} {k}\n\f{page} {k}", "scanned") for k in range(4)], "doc_id long, text string, scan_type string"))
    assert [sorted(n) for n in O.read(f"{page}\n\f{page}", model).noise] == [["header"], [], [], ["header"], [], []]
    assert O.is_page("x" * 200 + "\n\n" + "the words of a text that go on over lines\nand more of the words that go on over\nthe next line of it", None)
    assert not O.is_page("x " * 200 + "\n\nfirst item\nsecond item\nthird item", None)
