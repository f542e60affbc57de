import random

import pytest

from pathweave.llm import alignment as A
from pathweave.llm import langid as L

NOUNS = list(zip("house ship river window garden tower mirror forest bridge letter".split(), "Haus Schiff Ufer Fenster Beet Dach Bild Tal Tor Buch".split()))
FORMS = [
    ("In {y} {n} found the {a} near the old road.", "Im Jahr {y} fand {n} das {a} an der alten Strasse."),
    ("Nobody remembers who sold the {a} to {n}.", "Niemand weiss noch, wer {n} das {a} verkauft hat."),
    ("For {y} days the people waited for the {a}.", "Seit {y} Tagen warteten die Leute auf das {a}."),
    ("This story tells how {n} lost the {a}.", "Diese Geschichte handelt davon, wie {n} das {a} verlor."),
    ("At the end only the {a} stays with {n}.", "Zuletzt bleibt nur das {a} bei {n} zurück."),
    ("Why does {n} hide the {a} from his mother?", "Warum verbirgt {n} das {a} vor seiner Mutter?"),
    ("The edition of {y} shows the {a} in colour.", "Die Ausgabe von {y} zeigt das {a} farbig."),
    ("{n} grew up beside the {a} and left in {y}.", "{n} wuchs neben dem {a} auf und ging {y} fort."),
    ("Critics praised the quiet {a} in {y}.", "Die Kritik lobte {y} das stille {a}."),
    ("Many readers believe that the {a} is a true hero.", "Viele Leser glauben, dass das {a} ein wahrer Held ist."),
    ("When the {a} disappears, {n} must choose between truth and loyalty.", "Wenn das {a} verschwindet, muss {n} zwischen Wahrheit und Treue wählen."),
    ("After {y} hours {n} returns and finds the {a} unchanged.", "Nach {y} Stunden kehrt {n} heim und findet das {a} unverändert vor."),
]


def pair(rng):
    n, y, (a, b) = rng.choice(["Arlo", "Bertil", "Cosmin", "Dorian", "Esben"]) + rng.choice(["", " Quandt", " Rusk"]), str(rng.randrange(1700, 2000)), rng.choice(NOUNS)
    e, d = rng.choice(FORMS)
    return e.format(n=n, y=y, a=a), d.format(n=n, y=y, a=b)


def text(rng, k):
    """Source, target and the pairs: some left out, some added, one pair merged, some swapped."""
    made = [pair(rng) for _ in range(k)]
    left, right, truth = [], [], []
    for e, d in made:
        what = rng.random()
        if what < 0.15:
            right.append((d, None))
        else:
            left.append(e)
            if what > 0.3:
                right.append((d, len(left)))
    for i in range(len(right) - 1):
        if rng.random() < 0.15:
            right[i], right[i + 1] = right[i + 1], right[i]
    if len(right) > 3 and rng.random() < 0.6:
        (d1, i1), (d2, i2) = right[0], right[1]
        right[:2] = [(d1[:-1] + ", und " + d2[0].lower() + d2[1:], (i1, i2))]
    for j, (_, i) in enumerate(right, 1):
        for x in i if isinstance(i, tuple) else (i,):
            if x is not None:
                truth.append((x, j))
    return " ".join(left), " ".join(d for d, _ in right), truth


@pytest.fixture(scope="module")
def made(spark):
    rng = random.Random(7)
    rows = [(i, *text(rng, 5)) for i in range(500)]
    labelled = [(i, s, "en") for i, s, _, _ in rows] + [(i, t, "de") for i, _, t, _ in rows]
    dictionaries = L.fit(spark.createDataFrame(labelled, "id int, text string, label string"), "text", "label")
    pairs = spark.createDataFrame([(i, s, t, "de") for i, s, t, _ in rows], "id int, source string, target string, label string")
    return rows, dictionaries, pairs, A.fit(A.prepared(pairs, "id", dictionaries))


def test_held_out_accuracy(spark, made):
    _, dictionaries, _, lexicon = made
    rng = random.Random(99)
    rows = [(i, *text(rng, 5)) for i in range(80)]
    df = spark.createDataFrame([(i, s, t) for i, s, t, _ in rows], "id int, source string, target string")
    got = {(r.id, r.source_sent, r.target_sent) for r in A.align(A.prepared(df, "id", dictionaries), "id", lexicon).collect()}
    want = {(i, a, b) for i, _, _, truth in rows for a, b in truth}
    hit = len(got & want)
    assert hit / len(got) > 0.9 and hit / len(want) > 0.9, (hit, len(got), len(want))


def test_edges(spark, made):
    rows, dictionaries, _, lexicon = made
    df = spark.createDataFrame([(1, None, "x."), (2, "x.", None), (3, "", ""), (4, rows[0][1], rows[0][1]), (5, "...", "12.")], "id int, source string, target string")
    assert A.align(A.prepared(df, "id", dictionaries), "id", lexicon).collect() == []
    one = spark.createDataFrame([(7, rows[1][1], rows[1][2])] * 2, "id int, source string, target string").selectExpr("*", "'z' as source_sent")
    got = [tuple(r) for r in A.align(A.prepared(one, "id", dictionaries), "id", lexicon).collect()]
    assert got and len(got) == 2 * len(set(got))
    assert A.align(A.prepared(df.limit(0), "id", {}), "id", A.Lexicon()).collect() == []


def test_near():
    assert A.near("1833", "1843") and A.near("abc", "abcd") and A.near("abcd", "abdc") and A.near("karstad", "kastad")
    assert not A.near("1833", "1844") and not A.near("a", "b") and not A.near("abc", "abcde")
    assert A.tokens("In 8,748 Tagen, 1 546 und 1960!") == ["in", "8748", "tagen", ",", "1546", "und", "1960"]


def test_a_slip_near_a_word_of_the_lexicon_counts():
    a = A.Aligner(A.Lexicon(content={"en": {"river"}}))
    w = a._weights(["rivar"], "de", [({}, {"river"}), ({}, {"house"})], A.Counter(), 0, {})
    assert w[0, 0] > w[1, 0]


def test_a_translation_in_few_of_many_texts_is_learnt(spark, made):
    rng = random.Random(5)
    rows = [(i, *text(rng, 5)[:2]) for i in range(2000)]
    some = [i for i, s, t in rows if s.count("house") == 1 and t.count("Haus") == 1 and "ouse" not in t][:8]
    rows = [(i, s.replace("house", "lantern"), t.replace("Haus", "Laterne")) if i in some else (i, s, t) for i, s, t in rows]
    df = A.prepared(spark.createDataFrame(rows, "id int, source string, target string"), "id", made[1])
    row = A.fit(df).tables["en", "de"].get("lantern", {})
    assert len(some) == 8 and row and max(row, key=row.get) == "laterne", row


def test_jumps_are_counted_over_all_texts(made):
    _, dictionaries, pairs, lexicon = made
    texts = [(*A._unpacked(r.s_tags, r.s_toks), *A._unpacked(r.t_tags, r.t_toks)) for r in A.prepared(pairs, "id", dictionaries).where("s_lang != t_lang").collect()]
    jumps, want = lexicon.jumps, dict(A.JUMPS)
    aligner = A.Aligner(lexicon)
    try:
        for _ in range(A.JUMP_ROUNDS):
            lexicon.jumps, seen, none = want, dict.fromkeys(A.JUMPS, 1.0), 1.0
            for x in texts:
                place = -1
                for span in aligner.path(*x):
                    none += not span
                    for i in span:
                        seen[max(-4, min(4, i - place - 1))] += 1
                        place = i
            want = {d: A.math.log(n / none) for d, n in seen.items()}
    finally:
        lexicon.jumps = jumps
    assert len(texts) > 400 and jumps == pytest.approx(want)


def test_em_equals_a_dense_one(spark):
    rng = A.np.random.default_rng(3)
    n_s, n_t = 4000, 5000  # more than a task's table holds at once
    docs = [(A.np.unique(rng.integers(0, n_s, 20)) + 1, A.np.unique(rng.integers(0, n_t, 25))) for _ in range(40)]
    docs += docs[:20]
    df = spark.createDataFrame([("a", "b", bytearray(A.np.array([0, *s], "int32").tobytes()), bytearray(A.np.array(t, "int32").tobytes())) for s, t in docs], "a string, b string, s binary, t binary")
    got = A._em(A._spread(df, 7), {"a": n_s, "b": n_t}, {}, 3)["a", "b"]
    want = A.np.full((n_s + 1, n_t), 1.0)
    for _ in range(3):
        count = A.np.zeros_like(want)
        for s, t in docs:
            at = A.np.ix_([0, *s], t)
            count[at] += want[at] / want[at].sum(axis=0)
        want = count / A.np.maximum(count.sum(axis=1, keepdims=True), 1e-9)
    kept = want >= 0.02 * A.np.maximum(want.max(axis=1, keepdims=True), 1e-9)
    assert A.np.abs(got.dense(0, n_t) - want)[kept].max() < 1e-3
    assert got.docs.sum() == sum(len(s) + 1 for s, _ in docs)


def test_fitted_to_the_texts_themselves(made):
    _, dictionaries, pairs, lexicon = made
    texts = A.prepared(pairs, "id", dictionaries)
    assert {tuple(r) for r in A.align_all(texts, "id").collect()} == {tuple(r) for r in A.align(texts, "id", lexicon).collect()}
    assert A.align_all(texts.limit(0), "id").collect() == []
