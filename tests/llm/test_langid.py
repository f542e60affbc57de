import random

import pytest
from pyspark.sql import functions as F

from pathweave.llm import langid as L

PARTS = {
    "en": (["The old house", "A small ship", "The quiet river", "My young sister"], ["stands near the wide lake", "was lost in the deep forest", "remembers the first winter", "belongs to all the people"]),
    "de": (["Das alte Haus", "Ein kleines Schiff", "Der stille Fluss", "Meine junge Schwester"], ["steht neben dem breiten See", "ging im tiefen Wald verloren", "erinnert sich an den ersten Winter", "gehört allen Leuten"]),
    "fr": (["La vieille maison", "Un petit navire", "La rivière tranquille", "Ma jeune sœur"], ["se trouve près du grand lac", "fut perdu dans la forêt profonde", "se souvient du premier hiver", "appartient à tous les gens"]),
}


def sentence(lang, rng):
    a, b = PARTS[lang]
    return f"{rng.choice(a)} {rng.choice(b)}{rng.choice('.!?')}"


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(4)
    out = []
    for i in range(300):
        lang = rng.choice("en de fr".split())
        label = lang if rng.random() < 0.85 else rng.choice("en de fr".split())
        out.append((i, " ".join(sentence(lang, rng) for _ in range(rng.randint(1, 4))), label, lang))
    return spark.createDataFrame(out, "id int, text string, label string, truth string")


@pytest.fixture(scope="module")
def model(rows):
    return L.fit(rows, "text", "label")


def test_sentences_end_before_white_space_tags_aside():
    assert L.sentences("<p>One. Two!</p>\n<b>3.5 is</b> it? «Yes.» no...  End") == ["One.", "Two!", "3.5 is  it?", "«Yes.» no...", "End"]
    assert L.sentences(None) == L.sentences(" ") == []


def test_wrong_labels_are_overruled(rows, model):
    m = L.Languages(model)
    bad = [r for r in rows.collect() if {x for x, _ in m.tag(L.sentences(r.text))} != {r.truth}]
    assert len(bad) <= 3


def test_mixed_texts_and_asides(model):
    m = L.Languages(model)
    rng = random.Random(1)
    text = " ".join([sentence("en", rng), sentence("en", rng), "12.", sentence("de", rng), sentence("fr", rng)])
    assert [(s[0], s[1], s[2]) for s in m.segments(text)] == [(1, 1, "en"), (2, 4, "de"), (3, 5, "fr")]
    assert [s[2] for s in m.segments("Das alte Haus («The quiet river stands near») steht neben dem breiten See.")] == ["de"]
    assert [s[2] for s in m.segments("DAS ALTE HAUS GEHORT ALLEN LEUTEN.")] == ["de"]
    assert m.segments("12 / 34")[0][2] is None


def test_other_languages_are_rejected(model):
    m = L.Languages(model)
    assert 0 < m.margin < 1
    assert [s[2] for s in m.segments("Kirja kertoo miehestä joka asui yksin saarella. Xqzt vrblk fnnp.")] == [None]
    rng = random.Random(3)
    known = [sentence(lang, rng) for lang in ("en", "de", "fr") for _ in range(40)]
    assert sum(m.segments(s)[0][2] is None for s in known) <= 2
    m.margin = 2.0
    got = m.segments(known[0] + " 12. " + known[50])
    assert {s[2] for s in got} == {None} and [s[0] for s in got] == list(range(1, len(got) + 1))


def test_locales(spark):
    df = spark.createDataFrame([(x,) for x in ["de", " DE-at ", "deu", "ENG", "xx", "", None, "en_GB", "1"]], "l string")
    assert [r[0] for r in df.select(L.locale_code(F.col("l"), [("de", "deu"), ("en", "eng")])).collect()] == ["de", "de", "de", "en", None, None, None, "en", None]


def test_cases(spark, model):
    rng = random.Random(2)
    rows = [(1, sentence("en", rng), "en"), (2, sentence("en", rng), "de"), (3, sentence("en", rng), None), (4, sentence("en", rng) + " " + sentence("fr", rng), "en"), (5, "...", None), (6, None, None), (7, "", "en"), (8, (sentence("de", rng) + "\n") * 2000, "de")]
    df = spark.createDataFrame(rows, "id int, text string, label string").withColumn("lang", F.lit("zz"))
    segs = L.segments(df, "id", "text", model)
    got = sorted((r.id, r.seg_no, r.lang) for r in L.mislabelled(df, "id", "label", segs).collect())
    assert got == [(2, 1, "en"), (3, 1, "en"), (4, 1, "en"), (4, 2, "fr")]
    assert L.segments(df.limit(0), "id", "text", model).collect() == []
    assert {r.lang for r in L.segments(df, "id", "text", {}).collect()} == {None}
    assert L.fit(df.limit(0), "text", "label") == {}
