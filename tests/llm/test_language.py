import numpy as np
import pytest
from pyspark.sql import functions as F

from leafmill.llm import language as L

TEXT = {
    "en": "The drive unit was tested before the delivery of the goods. Please return the completed form to our office before Monday.",
    "pt": "O anexo digitalizado não apresenta danos visíveis. Devolva o formulário preenchido à secretaria até segunda-feira.",
    "es": "El anexo escaneado no presenta daños visibles. Devuelva el formulario cumplimentado a la oficina antes del lunes.",
    "fr": "Le banc d'essai ne présente aucun dommage visible. Veuillez renvoyer le formulaire rempli au bureau avant lundi.",
    "de": "Der Prüfstand zeigt keine sichtbaren Schäden. Bitte senden Sie das ausgefüllte Formular bis Montag an das Büro zurück.",
    "zh": "第二操作员没有可见的损伤。请在星期一之前将填好的表格交回办公室。",
    "ru": "Испытательный стенд не имеет видимых повреждений. Верните заполненный бланк в отдел до понедельника.",
}


@pytest.fixture(scope="module")
def model():
    return L.fit([(t, L.LANGUAGES.index(k)) for k, t in TEXT.items() for _ in range(3)])


def langs(model, text):
    return [L.LANGUAGES[k] for k, _, _ in L.segments(model, [text])[0]]


def test_codewords_are_far_apart():
    distance = (L.CODE[:, None] != L.CODE[None]).sum(2)
    assert L.CODE.shape == (7, L.BITS) and distance[~np.eye(7, dtype=bool)].min() >= 7
    assert len({tuple(c) for c in L.CODE.T}) == L.BITS


@pytest.mark.parametrize("lang", L.LANGUAGES)
def test_single_language(model, lang):
    assert langs(model, TEXT[lang]) == [lang]
    assert all(s > 0.9 for _, s, _ in L.segments(model, [TEXT[lang]])[0])


def test_segments_quotes_and_fragments(model):
    assert langs(model, TEXT["en"] + " " + TEXT["zh"] + "\n" + TEXT["de"]) == ["en", "zh", "de"]
    assert langs(model, TEXT["en"][:60] + " “Повторить проверку всех деталей.” " + TEXT["en"]) == ["en"]
    for text in (None, "", " \n", "AB-123 45; C9/8 77", "Offene Punkte", "!!!"):
        assert langs(model, text) == []


def test_labels(spark):
    rows = [("en_GB", "en"), ("Deutsch", "de"), (" PT ", "pt"), ("zh_Hans", "zh"), ("??", ""), (None, ""), ("", ""), ("mul", "mul"), ("tlh", "tlh"), ("fre", "fr")]
    df = spark.createDataFrame(rows, "label string, want string")
    assert [r[0] for r in df.select(L.label_column(F.col("label"))).collect()] == [w for _, w in rows]


def test_frames(spark, model):
    docs = spark.createDataFrame([(1, TEXT["en"], "en-US"), (2, TEXT["en"], "de"), (3, TEXT["de"], None), (4, TEXT["fr"] + " " + TEXT["ru"], "fr"), (5, None, None), (6, "  ", "xx"), (7, TEXT["es"] * 300, "es")], "doc_id long, text string, lang string").withColumn("label", F.lit("clash"))
    jobs = spark.createDataFrame([("a", TEXT["pt"], "pt-BR"), ("b", TEXT["pt"], "es"), ("b", TEXT["pt"], "es"), ("c", None, None)], "id string, text string, target_lang string")
    got = sorted(tuple(r) for r in L.contradictions(L.assign(L.labelled_rows(docs, jobs), model)).collect())
    assert got == [("documents", "2", 0, "en"), ("documents", "3", 0, "de"), ("documents", "4", 1, "fr"), ("documents", "4", 2, "ru"), ("translations", "b", 0, "pt")]
    assert L.assign(L.labelled_rows(docs.where("false"), jobs.where("false")), model).count() == 0
    every = L.assign(L.labelled_rows(docs, jobs), model).collect()
    assert {(r.tab, r.rec_id) for r in every} == {("documents", str(k)) for k in range(1, 8)} | {("translations", k) for k in "abc"}
    assert {(r.rec_id, r.lang, r.confidence, r.ambiguous) for r in every if r.rec_id in "56c"} == {(k, "und", 0.0, True) for k in "56c"}
    labelled = spark.createDataFrame([(k, t, lang, "clash") for k, (lang, t) in enumerate(list(TEXT.items()) * 3)], "doc_id long, text string, lang string, label string")
    assert langs(L.fit_on(labelled), TEXT["en"]) == ["en"] and L.fit_on(docs.where("false")).weights.shape == (L.BUCKETS, L.BITS)


def test_wrong_labels_are_left_out():
    rows = [(t, L.LANGUAGES.index(k)) for k, t in TEXT.items() for _ in range(8)] + [(TEXT["en"], 4)]
    assert langs(L.fit(rows), TEXT["en"]) == ["en"]


def test_unclear_texts_are_flagged_and_translations_have_one_row(model):
    mixed = TEXT["pt"] + " " + TEXT["pt"] + " " + TEXT["ru"]
    got = L.verdicts(model, ["Offene Punkte", mixed, mixed, "", "77 88"], [False, True, False, True, False])
    assert [len(v) for v in got] == [1, 1, 2, 1, 1]
    assert got[0][0][0] == 0 and got[0][0][3] and got[0][0][1] in L.LANGUAGES and got[1][0][:2] == (0, "pt") and got[1][0][2] < 0.9 and not got[1][0][3]
    assert [v[:2] for v in got[2]] == [(1, "pt"), (2, "ru")] and got[3] == got[4] == [(0, "und", 0.0, True)]


def test_bits_are_corrected_by_the_rows():
    grams = [np.array([1, 2, 3, 3]), np.array([4, 5])]
    weights = L.corrected(np.zeros((8, L.BITS), np.float32), [(grams[0], 0), (grams[1], 5)])
    for g, lang in zip(grams, (0, 5)):
        assert (weights[g].mean(0) * L.CODE[lang] > 0).all()
    right = np.tile(L.CODE[0], (8, 1))
    assert (L.corrected(right, [(grams[0], 0)]) == right).all()


def test_long_words_and_texts_are_read_whole(spark):
    word = "x" * 50
    assert len(L._grams(word + "ab")) > len(L._grams(word))
    assert langs_of_quotes("“" + "Повторить проверку всех деталей и узлов " * 5 + ".” ") == ["en"]


def langs_of_quotes(quote):
    model = L.fit([(t, L.LANGUAGES.index(k)) for k, t in TEXT.items() for _ in range(3)])
    return langs(model, TEXT["en"] + " " + quote + TEXT["en"])
