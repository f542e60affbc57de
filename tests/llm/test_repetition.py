import random
from collections import Counter

from hypothesis import given, settings
from hypothesis import strategies as st

from pathweave.llm import repetition as R


def brute(words, size=6, times=4):
    grams = [tuple(words[i : i + size]) for i in range(len(words) - size + 1)]
    n = Counter(grams)
    cover = {j for i, g in enumerate(grams) if n[g] >= times for j in range(i, i + size)}
    return len(cover) / len(words) if words else 0.0


@settings(max_examples=400, deadline=None)
@given(st.lists(st.integers(0, 2), max_size=60))
def test_share_equals_brute_force(words):
    assert abs(R.repeated_share(words) - brute(words)) < 1e-12


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 1), max_size=40), st.integers(1, 9), st.integers(2, 4))
def test_share_of_other_sizes(words, size, times):
    assert abs(R.repeated_share(words, size, times) - brute(words, size, times)) < 1e-12


def test_the_bands_drop_no_case():
    """Documents with just half of their words in passages of exactly four occurrences, all else random."""
    rng = random.Random(2)
    word = lambda: "".join(rng.choices("abcdefghijklmnop0123456789", k=rng.choice([1, 3, 8, 40])))
    for n in (24, 30, 48, 49, 64, 96, 200, 500, 1500, 5000):
        for _ in range(20 if n < 1000 else 3):
            k = -(-n // 48)
            parts = [[word() for _ in range(6)] for _ in range(k)] * 4
            parts += [[word()] for _ in range(max(0, n - 24 * k))]
            rng.shuffle(parts)
            words = [w for p in parts for w in p]
            m = R.measure(" ".join(words))
            assert m[4] == "repetitive" and abs(m[5] - brute(words)) < 1e-12, (n, m)


def test_the_limits_follow_the_passages():
    rng = random.Random(8)
    for size, times in ((4, 3), (8, 4), (12, 6), (5, 10)):
        for n in (2 * size * times, 300, 3000):
            k = -(-n // (2 * size * times))
            parts = [[str(rng.random())[2:] for _ in range(size)] for _ in range(k)] * times
            parts += [[str(rng.random())[2:]] for _ in range(max(0, n - size * times * k))]
            rng.shuffle(parts)
            words = [w for p in parts for w in p]
            m = R.measure(" ".join(words), size, times)
            assert m[4] == "repetitive" and abs(m[5] - brute(words, size, times)) < 1e-12, (size, times, n, m)


def test_long_texts_whose_unique_half_comes_first():
    """zstandard skips positions in long runs without matches: the ratio says nothing here."""
    for n in (10_000, 20_000, 100_000):
        rng = random.Random(n)
        parts = [[f"p{k}x{i}" for i in range(6)] for k in range(-(-n // 48))]
        words = [f"u{i}" for i in range(n - 24 * len(parts))]
        for _ in range(4):
            rng.shuffle(parts)
            words += [w for p in parts for w in p]
        m = R.measure(" ".join(words))
        assert m[4] == "repetitive" and abs(m[5] - brute(words)) < 1e-12, (n, m)


def test_the_share_is_exact_in_every_band():
    rng = random.Random(4)
    words = [str(rng.random())[2:] for _ in range(400)]
    for at in (50, 150, 250, 350):
        words[at:at] = ["one", "two", "three", "four", "five", "six"]
    m = R.measure(" ".join(words))
    assert m[4] != "repetitive" and abs(m[5] - 24 / 424) < 1e-12, m


def test_case_separators_and_odd_texts():
    text = "Say it again, once more, please! " * 5
    assert R.measure(text)[4:] == ("repetitive", 1.0)
    assert R.measure(text.upper().replace(" ", "_\n"))[5] == 1.0
    assert R.measure(None) == (0, None, None, None, "empty", 0.0)
    assert R.measure("")[4] == "empty"
    assert R.measure(" .. ")[4] == "empty"
    assert R.measure("İstanbul " * 20)[5] == 1.0
    noise = "".join(random.Random(1).choices("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/", k=5000))
    assert R.measure(noise.replace("+", " "))[5] == 0.0


def test_rows(spark):
    rows = [(1, None, 0.5), (2, "", 0.5), (3, "a " * 30, 0.5), (3, "a " * 30, 0.5), (4, "one two three", 0.5), (5, "b c d e f g h " * 60_000, 0.5)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, share double")
    out = sorted((r.doc_id, r.band, r.share) for r in R.repetition(df, "doc_id", "text").collect())
    assert out == [(1, "empty", 0.0), (2, "empty", 0.0), (3, "repetitive", 1.0), (3, "repetitive", 1.0), (4, "normal", 0.0), (5, "repetitive", 1.0)] or out[4][1] in ("normal", "incompressible")
    assert R.repetition(df.limit(0), "doc_id", "text").collect() == []
