from pyspark.sql import functions as F

from leafmill.functions import text as X
from leafmill.operators import translate

E = "doc_id long, page_index int, entry_idx int, category string, text string, unit string"


def one(spark, value, function):
    return spark.createDataFrame([(value,)], "t string").select(function(F.col("t"))).first()[0]


def test_columns(spark):
    assert [one(spark, t, X.worth_translating) for t in (None, "", "12 %", "é", "中")] == [False, False, False, True, True]
    assert [one(spark, t, X.script_language) for t in ("かな中", "한", "中", "x", None)] == ["ja", "ko", "zh", None, None]
    assert one(spark, "☑ a ☐", X.masked) == "[[CBX_ON]] a [[CBX_OFF]]"
    assert one(spark, "[[CBX_ON]]☐", X.unmasked) == "☑☐"
    assert one(spark, "☑<INPUT type=x>", X.boxes) == 2
    assert one(spark, "a<b>c< d</b> 3 < 4", X.parts) == ["a", "<b>", "c", "< d</b>", " 3 < 4"]
    assert one(spark, "$a\n\\text{b} + \\text{}$", X.formula_words) == ["$a\n", "\\text{b}", " + ", "\\text{}", "$"]
    assert one(spark, '<td data-bbox="1 2" class=x><math>Q</math></td>', X.without_boxes_of_tags) == "<td class=x>$Q$</td>"
    assert [one(spark, t, X.bare_formula) for t in ("<math>a</math> x <math> b</math>", "$$c$$ <b>d</b>", "", None)] == ["a b", "c d", "", None]
    assert one(spark, "$a\n$b$\nc", X.balanced_dollars) == "$a$\n$b$\nc"
    assert one(spark, "x <math>y</math> <math display='block'>z</math>", X.inline_math) == "x $y$ <math display='block'>z</math>"
    assert one(spark, "a\x01<&>", X.xml_escaped) == "a&lt;&amp;&gt;"
    assert one(spark, "<think>x</think>```json\n[\"a\"]\n```", X.answer_only) == '["a"]'


def test_answers(spark):
    df = spark.createDataFrame([('["a",null]', 2), ('{"items":["a"]}', 1), ('["a"]', 2), ("junk", 1), (None, 1)], "t string, n int")
    assert [r[0] for r in df.select(X.answer_list(F.col("t"), F.col("n"))).collect()] == [["a", ""], ["a"], None, None, None]


def test_names_tails_and_formulas(spark):
    df = spark.createDataFrame([("Prüf 1.pdf", "pt-BR"), ("表.docx", None), (None, "x")], "name string, lang string")
    assert [r[0] for r in df.select(X.artifact_name(F.col("name"), F.col("lang"), ".docx")).collect()] == ["Prüf 1_pt-BR.docx", "表.docx", None]
    heads = [r[0] for r in df.select(X.content_disposition("name")).collect()]
    assert heads[0] == "attachment; filename=\"Pruf 1.pdf\"; filename*=UTF-8''Pr%C3%BCf%201.pdf" and 'filename="file.docx"' in heads[1] and heads[2] is None
    assert X.tail_period("x" + "ab" * 40) == 2 and X.tail_period("plain text") == 0 and X.tail_period(None) == 0
    assert X.latex_to_unicode(r"\frac{F}{A} \le 3\,\mathrm{GPa}") == "F/A ≤ 3 GPa"
    assert X.latex_to_unicode(r"x^{2} + y_1 \sqrt{ab}") == "x² + y₁ √(ab)"
    assert X.latex_to_unicode(r"{{unclosed \alpha") == "unclosed α"
    assert spark.createDataFrame([("a $x^2$ b $5 c",), (None,)], "t string").select(X.formulas_as_text("t")).collect()[0][0] == "a x² b $5 c"


def entries(spark, *texts):
    category = lambda t: "Picture" if t == "skip" else "Table" if t and t.startswith("<") else "Formula" if t and t.startswith("$") else "Text"
    return spark.createDataFrame([(1, 0, k, category(t), t, "clash") for k, t in enumerate(texts)], E)


def test_translation_round_trip(spark):
    e = entries(spark, "plain", "<table><tr><td>a</td><td>12</td></tr></table>", None, "", "skip", "7 %", "x < y", "$\\frac{a}{b}\n\\text{if so}$", "☑ yes")
    got = {r.entry_idx: r.text for r in translate.translated(e).collect()}
    assert got == {0: "PLAIN", 1: "<table><tr><td>A</td><td>12</td></tr></table>", 4: "skip", 5: "7 %", 6: "X < Y", 7: "$\\frac{a}{b}\n\\text{IF SO}$", 8: "☑ YES"}
    assert translate.translated(e, window=1).collect() == translate.translated(e).collect()
    every = translate.units(e, formulas=False)
    raw = {r.entry_idx: r.text for r in translate.put_back(every, translate.called(translate.chunked(every.where("wanted")), translate.upper_model)).collect()}
    assert raw[7] == "$\\frac{a}{b}\n\\text{if so}$"
    same = {r.entry_idx: r.text for r in translate.translated(e, lambda ts: ts).collect()}
    assert same == {0: "plain", 1: e.collect()[1].text, 4: "skip", 5: "7 %", 6: "x < y", 7: "$\\frac{a}{b}\n\\text{if so}$", 8: "☑ yes"}
    assert translate.translated(e.where("false")).count() == 0


def test_chunks_close_when_full(spark):
    wanted = translate.units(entries(spark, *["abcd"] * 5, "x" * 50, "ab"))
    got = [r.chunk for r in translate.chunked(wanted, 3, 10).orderBy("entry_idx").collect()]
    assert got == [0, 0, 1, 1, 2, 3, 4]


def test_failing_models_fall_back(spark):
    wanted = translate.units(entries(spark, "a", "b", "中")).where("wanted")

    def broken(texts):
        if len(texts) > 1:
            return texts[:1]
        if texts == ["b"]:
            raise ValueError("no")
        return [t * 2 for t in texts]

    out = {r.unit: (r.result, r.fell_back) for r in translate.called(translate.chunked(wanted), broken).collect()}
    assert out == {"a": ("aa", False), "b": ("b", True), "中": ("中中", False)}
    again = translate.retried(translate.called(translate.chunked(wanted), broken), lambda ts: ["zhong" for _ in ts], 1)
    assert {r.unit: r.result for r in again.collect()}["中"] == "zhong"
    assert translate.outcome(translate.called(translate.chunked(wanted), lambda ts: [])).first().failed


def test_resume(spark):
    new = spark.createDataFrame([(d, p, 0, f"new{d}{p}") for d in (1, 2, 3) for p in range(3)], "doc_id long, page_index int, entry_idx int, text string")
    saved = new.withColumn("text", F.concat(F.lit("old"), "text"))
    checkpoints = spark.createDataFrame([(1, 2, 3, 3), (2, 2, 4, 3), (3, 0, 3, 3)], "doc_id long, pages_done int, page_count int, now_pages int")
    assert sorted((r.doc_id, r.page_index) for r in translate.resumed(saved, new, checkpoints).where("was_saved").collect()) == [(1, 0), (1, 1)]


def test_every_entry_is_translated(spark, folder, tmp_path):
    from leafmill.plans import text as plans

    texts = spark.createDataFrame(enumerate(["Straße ﬁn", "<td>Maß</td>", "plain", "", None]), "entry_idx int, text string")
    one_entry = spark.read.parquet(f"{folder}/page_entries.parquet").limit(1).drop("entry_idx", "text").withColumn("category", F.lit("Text"))
    one_entry.crossJoin(texts).withColumn("category", F.when(F.col("text").startswith("<"), "Table").otherwise("Text")).write.parquet(f"{tmp_path}/page_entries.parquet")
    got = {r.entry_idx: r.text for r in plans.QUERIES["entries_translated"](spark, str(tmp_path)).collect()}
    assert got == {0: "» Straße ﬁn", 1: "<td>» Maß</td>", 2: "» plain"}


def test_boxes_reach_the_model_as_words_and_echoes_are_refused(spark):
    wanted = translate.units(entries(spark, "☑ yes", "☐ no")).where("wanted")
    echo = lambda ts: [translate.SEPARATOR + t if len(ts) > 1 else t.replace("[[CBX_ON]]", "ON") for t in ts]
    out = {r.unit: (r.result, r.fell_back) for r in translate.called(translate.chunked(wanted), echo).collect()}
    assert out == {"☑ yes": ("ON yes", False), "☐ no": ("☐ no", False)}


def test_a_chunk_is_asked_twice_and_failing_retries_keep_the_result(spark, tmp_path):
    wanted = translate.units(entries(spark, "a", "中文")).where("wanted")
    seen = tmp_path / "asked"

    def second_time(texts):
        if not seen.exists():
            seen.write_text("x")
            raise ValueError("first")
        return [t + "!" for t in texts]

    out = translate.called(translate.chunked(wanted), second_time)
    assert {r.unit: r.result for r in out.collect()} == {"a": "a!", "中文": "中文!"}

    def broken(texts):
        raise ValueError("always")

    assert {r.unit: r.result for r in translate.retried(out, broken).collect()}["中文"] == "中文!"
    assert {r.unit: r.result for r in translate.retried(out, lambda ts: ["zhongwen"] if len(ts) == 1 else []).collect()}["中文"] == "zhongwen"


def test_hydrated_images(spark):
    rows = spark.createDataFrame([("d", "documents/d/images/a.png"), ("d", "../x\\\\b.png"), ("d", None), ("e", "a.png")], "id string, image_key string")
    stored = spark.createDataFrame([("d", "a.png", 5), ("d", "b.png", 6)], "id string, name string, size int")
    assert [(r.size, r.found) for r in translate.hydrated(rows, stored, "image_key").orderBy("id", F.col("image_key").desc_nulls_last()).collect()] == [(5, True), (6, True), (None, None), (None, False)]


def test_signs_of_formulas():
    assert X.latex_to_unicode(r"\tau \nu \partial \int \equiv \sim") == "τ ν ∂ ∫ ≡ ∼"
