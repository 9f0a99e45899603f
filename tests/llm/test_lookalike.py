import random
from collections import Counter

import pytest

from leafmill.llm import lookalike as L

BASE = "The café office, fin 3 m² – Ωhm two-stage; 10 °C Ёлка"
SAME = ["The cafe\u0301 office, fin 3 m² – Ωhm two-stage; 10 °C Ёлка", "Тhе café oﬃce, ﬁn 3 m² – Ωhm two‑stage; 10 ℃ Ёлка", "Ｔｈｅ\u00a0café of\u200bfice，\u2003fin ３ m² – Ωhm two－stage; 10 °C Е\u0308лка"]
OTHER = ["the café office, fin 3 m² – Ωhm two-stage; 10 °C Ёлка", "The cafe office, fin 3 m² – Ωhm two-stage; 10 °C Ёлка", "The café office, fin 3 m2 – Ωhm two-stage; 10 °C Ёлка", "The café office. fin 3 m² – Ωhm two-stage; 10 °C Ёлка", "The café office,\nfin 3 m² – Ωhm two-stage; 10 °C Ёлка", "The café office, fin 4 m² – Ωhm two-stage; 10 °C Ёлка"]


def rewriter(texts):
    return L.Rewriter(tuple(sorted((m, r) for m, r in L.look_alike_classes(Counter("".join(texts))).items() if m)))


def test_same_looks_have_one_form_and_others_not():
    rewrite = rewriter([BASE, *SAME, *OTHER])
    assert {rewrite(t) for t in SAME} == {rewrite(BASE)}
    assert len({rewrite(t) for t in [BASE, *OTHER]}) == 1 + len(OTHER)


def test_rewriting_is_stable_and_random_spellings_agree():
    rng = random.Random(5)
    spell = {"a": "aаａ", "e": "eеｅ", "o": "oоοｏ", " ": " \u00a0\u2009", "-": "-‐－", "p": "pр"}
    texts = ["".join(rng.choice("aeop-xyz ") for _ in range(30)) for _ in range(40)]
    variants = [["".join(rng.choice(spell.get(c, c)) for c in t) + rng.choice(["", "\u200b"]) for _ in range(4)] for t in texts]
    rewrite = rewriter([t for v in variants for t in v] + texts)
    for t, v in zip(texts, variants):
        assert {rewrite(x) for x in v} == {rewrite(t)}
        assert rewrite(rewrite(t)) == rewrite(t)


def test_order_of_marks_does_not_matter():
    a, b = "q\u0323\u0307", "q\u0307\u0323"
    assert len({rewriter([a, b, "\u00a0"])(x + "\u00a0") for x in (a, b)}) == 1


@pytest.mark.parametrize("sign", ["²", "½", "①", "™", "´", "–", "…"])
def test_forms_that_change_the_look_stay(sign):
    assert L.plain_form(sign) in (None, "...")


def test_frames_against_brute_force(spark):
    texts = [None, "", "\u200b", " ", BASE, BASE, *SAME, *OTHER, SAME[0], "x" * 50_000 + "\u00a0", "x" * 50_000 + " "]
    df = spark.createDataFrame([(k, t, "clash") for k, t in enumerate(texts)], "doc_id long, text string, look string")
    table = L.class_table(df.select("text"))
    rewrite = L.Rewriter(table)
    keys = [rewrite(t) if t else "" for t in texts]
    want = {(i, j) for i in range(len(texts)) for j in range(i + 1, len(texts)) if keys[i].strip() and keys[i] == keys[j] and texts[i] != texts[j]}
    prints = L.fingerprints(df, table)
    got = [tuple(r) for r in L.pairs(prints).collect()]
    assert len(got) == len(set(got)) and set(got) == want and want
    classes = {r.doc_id: r.class_id for r in L.classes(prints).collect()}
    assert set(classes) == {x for p in want for x in p} and all(classes[i] == classes[j] for i, j in want)
    new = [r.text for r in L.normalise(df, table, ["doc_id"]).collect()]
    assert new == [None if t is None else rewrite(t) for t in texts]
    assert L.pairs(L.fingerprints(df.where("false"), L.class_table(df.where("false").select("text")))).count() == 0


def test_spellings_beyond_any_count_of_products(spark):
    # A square sign of many letters has more spellings than could be listed: 3 ** 8 of this one.
    form = L.plain_form("\ufdfa")
    letters = "оοｏеｅcсϲ" + "".join(set(form))
    counts = Counter({x: 5 for x in letters + "oe\ufdfa\ufb03fi\uff46\uff49"})
    table = tuple(sorted((m, r) for m, r in L.look_alike_classes(counts).items() if m))
    rewrite = L.Rewriter(table)
    assert rewrite("\ufdfa") == rewrite(form)
    assert {rewrite(x) for x in ("\ufb03", "ffi", "\uff46fi", "f\uff46\uff49", "\uff46\uff46\uff49")} == {rewrite("ffi")}


def test_classes_do_not_depend_on_the_order_of_the_alphabet():
    points = [chr(k) for k in range(0x20, 0x3000) if not 0xD800 <= k < 0xE000]
    counts = {c: 1 + k % 7 for k, c in enumerate(points)}
    shuffled = list(counts.items())
    random.Random(1).shuffle(shuffled)
    assert L.look_alike_classes(counts) == L.look_alike_classes(dict(shuffled))


def test_a_hot_look_is_spread_over_tasks(spark, monkeypatch):
    monkeypatch.setattr(L, "SIDE", 4)
    rows = [(k, bytes([1]), bytes([k % 3])) for k in range(60)] + [(100 + k, bytes([2 + k]), b"x") for k in range(5)]
    got = {tuple(r) for r in L.pairs(spark.createDataFrame(rows, "doc_id long, look binary, stored binary")).collect()}
    assert got == {(i, j) for i in range(60) for j in range(i + 1, 60) if i % 3 != j % 3}


def test_a_composition_that_the_corpus_has_in_parts_only():
    a, b = "deuxième", "deuxi\u0435\u0300me"
    rewrite = rewriter([a, b])
    assert rewrite(a) == rewrite(b)
