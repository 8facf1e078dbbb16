"""Held-out accuracy, and what doesn't count for a language."""

import random

import numpy as np
import pytest
from helpers import with_clashes

from vellumdex.llm import language
from vellumdex.llm.language_text import paragraphs_of, repaired, words_of

# sentences in four languages, each put together from parts
PARTS = {
    "en": (["the old bridge", "every second letter", "our quiet garden", "a narrow street"], ["holds", "does not find", "was built with"], ["the last answer", "some heavy boxes", "the winter light"]),
    "de": (["die alte Brücke", "jeder zweite Brief", "unser stiller Garten", "eine enge Gasse"], ["enthält", "findet nicht", "wurde gebaut mit"], ["die letzte Antwort", "einige schwere Kisten", "das Licht des Winters"]),
    "fr": (["le vieux pont", "chaque deuxième lettre", "notre jardin tranquille", "une rue étroite"], ["contient", "ne trouve pas", "est construit avec"], ["la dernière réponse", "quelques caisses lourdes", "la lumière de l'hiver"]),
    "ru": (["старый мост", "каждое второе письмо", "наш тихий сад", "узкая улица"], ["содержит", "не находит", "построен через"], ["последний ответ", "тяжёлые ящики", "зимний свет"]),
}


def prose(lang, n, r):
    return " ".join(" ".join(r.choice(p) for p in PARTS[lang]).capitalize() + "." for _ in range(n))


@pytest.fixture(scope="module")
def reference():
    r = random.Random(1)
    return [(k * 4 + j, lang, prose(lang, 3, r)) for k in range(40) for j, lang in enumerate(PARTS)]


@pytest.fixture(scope="module")
def model(reference):
    return language.fit([(lang, t) for _, lang, t in reference], [])


def test_held_out_accuracy(model):
    r = random.Random(9)
    want = [lang for lang in PARTS for _ in range(100)]
    texts = [words_of(prose(lang, 1, r)) for lang in want]
    best, sure = model.predict(texts)
    right = [model.classes[b] == w for b, w in zip(best, want, strict=True) if b >= 0]
    assert sum(right) / len(right) > 0.99 and len(right) > 0.97 * len(want)
    plain, _ = model.predict([language.plain_letters(t) for t in texts])
    assert sum(model.classes[b] == w for b, w in zip(plain, want, strict=True)) / len(want) > 0.97


def test_confidence_is_calibrated(model):
    r = random.Random(10)
    texts = [words_of(prose(lang, 1, r))[:3] for lang in PARTS for _ in range(200)]
    _, sure = model.predict(texts)
    assert len(model.least) == len(language.SIZES) and all(0 < x < 1 for x in model.least) and sure.min() >= 0 and sure.max() <= 1
    assert model.by_size((1, 2, 3, 6), np.array([1, 2, 3, 5, 6, 900])).tolist() == [1, 2, 3, 3, 6, 6]


def test_what_does_not_count():
    for text in (
        "", "  \n\t", "12 % 1999-01-02\t35.0 km", "http://a.example/le/chemin de", "Home | Login | Search", "Skip to content · Menu", "Startseite | Kontakt | Impressum", "<DOC>\n<DOCNO>D1</DOCNO>",
        "Name(other[3]) {more += 2; }", "a" * 60, "deadbeef 0badf00d 12ab34cd cafebabe 99aa00bb", "mail@example.org", "​­", "👩‍🔬",
    ):
        assert len(words_of(text)) <= 1, text
    assert words_of("la la 35 km") == ["la", "la"]


COMPOUND = "donaudampfschifffahrtselektrizitaetenhauptbetriebswerkbauunterbeamtengesellschaft"


@pytest.mark.parametrize(
    "text, words",
    [
        ("alpha,beta,gamma,delta,epsilon,zeta,eta,theta", "alpha beta gamma delta epsilon zeta eta theta"),
        (f"Die {COMPOUND.capitalize()} tagt", f"die {COMPOUND} tagt"),
        (COMPOUND.replace("ae", "ä"), COMPOUND.replace("ae", "ä")),
        ("Read more about this", "read more about this"),
        ("Bitte alle Schüler(innen) heute kommen", "bitte alle schüler innen heute kommen"),
        ("Erstens die Kosten;", "erstens die kosten"),
        ("see <a href='" + "word " * 80 + "'>this link</a>", "see this link"),
        ("one <!-- " + "hidden words > " * 500 + "--> two <!-- open", "one two open"),
        ("the call foo[bar](x) += {a: 1; b: two words} ends this line here", "the call ends this line here"),
        ("siehe http://a.example/b?c=d und someone@example.org, danke", "siehe und danke"),
        ("x" * 70 + "@example.org hello", "hello"),
        ("COVID19,fever,cough", "fever cough"),
        ("The  quick  brown  fox  jumps", "the quick brown fox jumps"),
        ("« Oui » dit-il", "oui dit il"),
    ],
)
def test_what_counts_whatever_its_length(text, words):
    assert words_of(text) == words.split()


def test_short_texts_are_judged_by_confidence(model):
    """Rare words that no training text has, but whose script or subwords settle the language."""
    lang, sure, own, _ = language.judge(model, [[["редкостный", "закоулок"]], [["qxzvkj"]]])
    assert own[0] == "ru" and lang[0] == ["ru"] and 0 < sure[0][0] <= 1


def test_the_same_sample_is_fitted_once(spark, reference, monkeypatch):
    fitted = []
    fit = language.fit
    monkeypatch.setattr(language, "fit", lambda *a: fitted.append(1) or fit(*a))
    docs = spark.createDataFrame([(1, "the old bridge holds the last answer", "en")], "doc_id bigint, text string, lang string")
    ref = spark.createDataFrame(reference[:90], "sample_id int, lang string, sample_text string")
    models = [language.fit_on(docs, r) for r in (ref, ref, ref.where("sample_id < 60"))]
    assert models[0] is models[1] and models[1] is not models[2] and len(fitted) == 2


@pytest.mark.parametrize(
    "odd, plain",
    [
        ("l&#233;t&eacute;", "lété"),
        ("spÃ¤te FÃ¤hre â€™", "späte Fähre ’"),
        ("Ã\xadndice", "índice"),
        ("été", "été"),
        ("ﬁn du mo­nde​", "fin du monde"),
        ("wo™uld ne文ed", "would ne文ed"),
        ("Ｆｕｌｌ", "Full"),
        ("NÃO é Ã", "NÃO é Ã"),
    ],
)
def test_repairs(odd, plain):
    assert repaired(odd) == plain


def test_paragraphs_are_numbered_by_blank_lines():
    assert paragraphs_of("\n\na\nb\r\n \t\r\nc\r\rd\n\n") == ["a\nb", "c", "d"] and paragraphs_of("") == [] and paragraphs_of(" \n ") == []


def test_documents(spark, reference):
    r = random.Random(3)
    mixed = "\n\n".join([prose("en", 6, r), prose("de", 2, r), "12 %\t13 %", prose("en", 3, r)])
    rows = [
        (1, prose("en", 4, r), "en"), (2, prose("de", 4, r), "en"), (3, prose("fr", 4, r), None), (4, prose("ru", 4, r), " RU_ru "), (5, None, "en"), (6, "", "de"),
        (7, "1999 12 % 40 km", "fr"), (8, mixed, "EN-gb"), (9, prose("fr", 4, r).upper(), "und"), (10, prose("de", 3000, r), "de"), (11, prose("en", 4, r), "en"), (11, prose("en", 4, r), "en"),
    ]
    docs = with_clashes(spark.createDataFrame(rows, "doc_id bigint, text string, lang string"))
    ref = with_clashes(spark.createDataFrame(reference, "sample_id int, lang string, sample_text string"))
    found = language.languages(docs, ref).collect()
    own = {r["doc_id"]: (r["lang"], r["label"], r["right"]) for r in found if r["segment"] == -1}
    assert own == {
        1: ("en", "en", True), 2: ("de", "en", False), 3: ("fr", None, False), 4: ("ru", "ru", True), 5: (None, "en", False), 6: (None, "de", False), 7: (None, "fr", False),
        8: ("en", "en", True), 9: ("fr", None, False), 10: ("de", "de", True), 11: ("en", "en", True),
    }
    assert sum(r["segment"] == -1 for r in found) == len(rows)
    assert sorted((r["segment"], r["lang"] or "") for r in found if r["segment"] >= 0) == [(0, "en"), (1, "de"), (2, ""), (3, "en")]
    cases = {(r["doc_id"], r["segment"], r["lang"]) for r in language.language_cases(docs, ref).collect()}
    assert cases == {(2, -1, "de"), (3, -1, "fr"), (9, -1, "fr"), (8, 0, "en"), (8, 1, "de"), (8, 3, "en")}
    assert language.languages(docs.limit(0), ref).collect() == []
    with pytest.raises(ValueError):
        language.languages(docs, ref.limit(0))


def test_labelled_documents_teach_new_words(reference):
    r = random.Random(5)
    new = {"en": "stormy lighthouse keepers whisper ancient riddles", "de": "stürmische Leuchtturmwärter flüstern uralte Rätsel"}
    labelled = [(lang, prose(lang, 3, r) + f" {new[lang]}.") for lang in new for _ in range(30)] + [("fr", prose("de", 3, r)) for _ in range(5)]
    m = language.fit([(lang, t) for _, lang, t in reference], labelled)
    best, sure = m.predict([words_of(t) for t in new.values()])
    assert [m.classes[b] for b in best] == list(new) and sure.min() > 0.9


def test_letters_count_whatever_training_saw(model):
    """A longer paragraph of words that training didn't see outweighs a shorter one of words it saw."""
    unseen = words_of("The hidden weather outside another broken window settles without any further warning, and nobody knows whether the others were there")
    shorter = words_of(prose("de", 1, random.Random(6)))
    lang, _, own, _ = language.judge(model, [[unseen, shorter]])
    assert lang == [["en", "de"]] and own == ["en"]
    _, letters = model.log_odds_and_letters([unseen, shorter])
    assert letters[0] > 0.7 * sum(map(len, unseen)) and letters[1] > 0.9 * sum(map(len, shorter))


@pytest.mark.parametrize(
    "piece", ["a", "a1", "(", "[(", "{", "}", "=", "a=", "&", "&#", "<", "<a", "<!--", "@", "a@", "://", "www.", "é", "Ã", "Ã\xad", ";", "; ", " ", "\n", "\n ", "a\n\n", "文", "a(", "1 ", "x'", "́", "|", "a|", " · ", "[a", "a[", "];", "1a,", "//", "<!-- -->", "{a}", "<a>", "-", "a-b", "a.", "x@y "]
)
def test_very_long_texts_take_time_in_proportion(piece):
    import time

    text = piece * (400_000 // len(piece))
    began = time.perf_counter()
    for t in (text, f"the old bridge {text} = {text}; holds"):
        for p in paragraphs_of(t):
            words_of(p)
    assert time.perf_counter() - began < 8
