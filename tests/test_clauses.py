"""Clause scope on written sentences: what negation, hedges, lists and clause bounds do to each mention."""

from evidloom.functions import scalars as S
from evidloom.operators import clauses as C

ENGLISH = C.Lexicon(
    {"COUGH": ("cough",), "FEVER": ("fever",), "PAIN": ("pain",), "ASTHMA": ("asthma",)},
    before="^(no|not|without|never)$", after="^(absent|denied)$", hedges="^(maybe|perhaps|possibly)$", conditions="^(if|whenever)$", partly="^(really|much)$", improved="^(better|less)$",
    persists="^(stop|stopped|end|ended)$", past="^(yesterday|formerly)$", others="^(mother|friend)$", opens="^(but|because|while)$", endings="^done$", lists="^(and|or)$", loosely="^with$", particles="^(a|the|also)$", history=("ASTHMA",),
)

CASES = [
    ("I have a cough.", {"COUGH": "POSITIVE"}),
    ("No cough.", {"COUGH": "NEGATIVE"}),
    ("Cough absent", {"COUGH": "NEGATIVE"}),
    ("I have fever but no cough", {"FEVER": "POSITIVE", "COUGH": "NEGATIVE"}),
    ("no fever but I do have a cough", {"FEVER": "NEGATIVE", "COUGH": "POSITIVE"}),
    ("no fever, I have a cough", {"FEVER": "NEGATIVE", "COUGH": "POSITIVE"}),  # negation stays in its clause
    ("I have pain because I could not sleep", {"PAIN": "POSITIVE"}),
    ("No fever. Cough", {"FEVER": "NEGATIVE", "COUGH": "POSITIVE"}),
    ("no fever, cough or the pain", {"FEVER": "NEGATIVE", "COUGH": "NEGATIVE", "PAIN": "NEGATIVE"}),
    ("cough, fever and pain denied", {"COUGH": "NEGATIVE", "FEVER": "NEGATIVE", "PAIN": "NEGATIVE"}),
    ("cough with fever denied", {"COUGH": "UNKNOWN", "FEVER": "NEGATIVE"}),
    ("cough with fever today", {"COUGH": "POSITIVE", "FEVER": "POSITIVE"}),
    ("never without pain", {"PAIN": "UNCERTAIN"}),  # two negations
    ("not much pain", {"PAIN": "NEGATIVE"}),
    ("pain denied really", {"PAIN": "UNCERTAIN"}),  # in part only
    ("the fever has not stopped", {"FEVER": "POSITIVE"}),
    ("the fever has stopped", {"FEVER": "POSITIVE"}),
    ("fever is better", {"FEVER": "UNCERTAIN"}),
    ("maybe fever, cough absent", {"FEVER": "UNCERTAIN", "COUGH": "UNCERTAIN"}),  # one list, one clause
    ("maybe fever today, cough absent", {"FEVER": "UNCERTAIN", "COUGH": "NEGATIVE"}),
    ("whenever pain comes", {"PAIN": "UNCERTAIN"}),
    ("no cough done fever here", {"COUGH": "NEGATIVE", "FEVER": "POSITIVE"}),
    ("", {}),
    (None, {}),
    (" \n ...", {}),
]


def statuses(spark, texts, lexicon):
    df = spark.createDataFrame([(i, t, 0) for i, t in enumerate(texts)], "id int, t string, status int")
    return C.mention_contexts(df, ["id"], "t", lexicon)


def test_statuses_of_sentences(spark):
    got = [{} for _ in CASES]
    for r in statuses(spark, [t for t, _ in CASES], ENGLISH).collect():
        got[r["id"]][r["code"]] = r["status"]
    assert {t: g for (t, _), g in zip(CASES, got, strict=True)} == dict(CASES)


def test_places_and_contexts(spark):
    text = "I had asthma and fever yesterday!  Is it pain? My mother has a cough\nno fever"
    rows = statuses(spark, [text], ENGLISH).orderBy("at").collect()
    assert [text[r["at"] :].split()[0].rstrip("!?") for r in rows] == ["asthma", "fever", "pain", "cough", "fever"]
    assert [(r["code"], r["past"], r["other"], r["question"]) for r in rows] == [("ASTHMA", False, False, False), ("FEVER", True, False, False), ("PAIN", False, False, True), ("COUGH", False, True, False), ("FEVER", False, False, False)]
    kept = C.evidence(statuses(spark, [text, "fever. no fever. cough"], ENGLISH), ["id"])
    assert sorted(tuple(r) for r in kept.collect()) == [(0, "ASTHMA", "POSITIVE"), (0, "FEVER", "NEGATIVE"), (1, "COUGH", "POSITIVE")]


def test_clause_bounds_are_places_in_the_text(spark):
    text = "no fever, cough or pain, I sleep well but not long. Done then"
    df = spark.createDataFrame([(1, text), (2, None), (3, "")], "id int, t string")
    got = C.clauses(df, ["id"], "t", ENGLISH).orderBy("start").collect()
    assert [text[r["start"] : r["end"]].strip() for r in got] == [r["words"] for r in got] == ["no fever, cough or pain,", "I sleep well", "but not long", "Done", "then"]


KOREAN = C.Lexicon(
    {"COUGH": ("기침",), "FEVER": ("열",), "NOSE": ("콧물",)},
    before="^(안|못)$", after="(없|않|아니)", hedges="(같아|모르)", partly="^(별로)$", improved="(나아졌)", persists="(떨어|멈추|멈춰)", endings="(고|서|데|지만|요|다)$", lists="^(그리고|또는)$", loosely="^(하고)$", particles="^(또)$",
    form=lambda w: S.without_particles(C.bare_word(w)),
)


def test_a_language_that_negates_behind_and_marks_words_by_endings(spark):
    cases = [("열은 없는데 기침은 나요.", {"FEVER": "NEGATIVE", "COUGH": "POSITIVE"}), ("기침, 콧물, 열이 있어요", {"COUGH": "POSITIVE", "NOSE": "POSITIVE", "FEVER": "POSITIVE"}), ("기침은 안 나요", {"COUGH": "NEGATIVE"}), ("열이 안 떨어져요", {"FEVER": "POSITIVE"}), ("열은 없는 것 같아요", {"FEVER": "UNCERTAIN"})]
    got = [{} for _ in cases]
    for r in statuses(spark, [t for t, _ in cases], KOREAN).collect():
        got[r["id"]][r["code"]] = r["status"]
    assert got == [x for _, x in cases]


def test_a_long_sentence_with_many_mentions(spark):
    text = " ".join(["no fever, cough"] * 400 + ["pain"] * 400)
    rows = statuses(spark, [text], ENGLISH).collect()
    assert len(rows) == 1200 and {r["status"] for r in rows if r["code"] == "PAIN"} == {"UNCERTAIN"}
