import itertools
import random

import numpy as np

from quellwerk.llm import neardup as N
from quellwerk.llm.pages import article_positions

WORDS = [f"wort{i}" for i in range(400)]


def _sentence(rng):
    return "Die " + " ".join(rng.choice(WORDS) for _ in range(rng.randrange(8, 14))) + " endet."


def _edit(rng, s):
    w = s.split()
    w[rng.randrange(1, len(w) - 1)] = rng.choice(WORDS)
    return " ".join(w)


def _pages(seed=1):
    rng = random.Random(seed)
    pages = []
    for _ in range(40):
        base = [_sentence(rng) for _ in range(10)]
        pages.append(base)
        for share in (1.0, 0.9, 0.8, 0.6):
            kept = [s if rng.random() < 0.5 else _edit(rng, s) for s in base[: int(10 * share)]] + [_sentence(rng) for _ in range(10 - int(10 * share))]
            rng.shuffle(kept)
            pages.append(kept)
        pages.append(list(base))
    return [[" ".join(p[:5]), " ".join(p[5:])] for p in pages]


def test_equals_brute_force(spark):
    pages = _pages()
    text = ["\n\n".join(p[i] for i in article_positions(p)) for p in pages]
    want = {(i, j) for i, j in itertools.combinations(range(len(pages)), 2) if N.exact_jaccard(text[i], text[j]) >= N.JACCARD and N.shared_sentences(text[i], text[j]) >= N.SHARE - 1e-9}
    df = spark.createDataFrame([(i, p) for i, p in enumerate(pages)], "zeilen_nr bigint, absaetze array<string>")
    none = spark.createDataFrame([], "zeilen_nr bigint")
    got = {(r[0], r[1]) for r in N.same_article_pairs(df, none).collect()}
    assert got <= want and len(got) >= 0.97 * len(want)
    assert {(i, i + 5) for i in range(0, 240, 6)} <= got


def test_many_copies_short_texts_nulls_and_exclusion(spark):
    p = ["Kurzer Text hier."]
    rows = [(i, p, 0) for i in range(6)] + [(10, None, 0), (11, [], 0), (12, ["Startseite"], 0), (13, ["Anderer Text dort."], 0), (3, p, 0)]
    df = spark.createDataFrame(rows, "zeilen_nr bigint, absaetze array<string>, text int")
    out = spark.createDataFrame([(5,)], "zeilen_nr bigint")
    got = [(r[0], r[1]) for r in N.same_article_pairs(df, out).collect()]
    assert sorted(got) == list(itertools.combinations(range(5), 2))
    assert N.same_article_pairs(df.limit(0), out).count() == 0


def test_long_lists_lose_no_pair(spark):
    """More rows than a list may hold that all share their first sentences."""
    rng = random.Random(2)
    common = [_sentence(rng) for _ in range(12)]
    pages = [[" ".join([*common, _sentence(rng)])] for _ in range(36)]
    df = spark.createDataFrame(list(enumerate(pages)), "zeilen_nr bigint, absaetze array<string>")
    assert N.same_article_pairs(df, spark.createDataFrame([], "zeilen_nr bigint")).count() == len(pages) * (len(pages) - 1) // 2


def test_large_family_of_edited_copies(spark):
    """Sixty copies with a word changed in 60 % of the sentences of each; a pair needs no more than in a small family."""
    rng = random.Random(9)
    words = [f"wort{i}" for i in range(3000)]
    base = [[rng.choice(words) for _ in range(15)] for _ in range(24)]
    texts = []
    for _ in range(60):
        copy = [list(x) for x in base]
        for x in copy:
            if rng.random() < 0.6:
                x[rng.randrange(1, 14)] = rng.choice(words)
        texts.append(" ".join(" ".join(x).capitalize() + "." for x in copy))
    h, o = N.shingle_hashes(texts)
    pairs = [(i, j) for i, j in itertools.combinations(range(60), 2) if N.exact_jaccard(texts[i], texts[j]) >= N.JACCARD]
    sketch = [h[o[i] : o[i + 1]][: N.SKETCH].view(np.int64).tolist() for i in range(60)]
    runs = [set(zip(x, x[1:])) for x in sketch]
    want = {(i, j) for i, j in pairs if len(runs[i] & runs[j]) >= N.MEETINGS}
    classes = spark.createDataFrame(list(enumerate(sketch)), "k bigint, sketch array<bigint>")
    met = [(r.a, r.b) for r in N._lists(classes).collect()]
    assert len(want) > 0.8 * len(pairs) and want <= {p for p in set(met) if met.count(p) >= N.MEETINGS}


def test_short_text_meets_a_longer_one_once(spark):
    """Sketches of three and six values with one run in common are candidates; of six and seven they are not."""
    classes = spark.createDataFrame([(1, [10, 20, 30]), (2, [10, 20, 40, 50, 60, 70]), (3, [1, 2, 60, 70, 80, 90, 95])], "k bigint, sketch array<bigint>")
    texts = spark.createDataFrame([(k, "eins zwei drei vier fünf sechs") for k in (1, 2, 3)], "k bigint, text string")
    assert {(r.a, r.b) for r in N.similar_classes(classes, texts, lambda a, b: True).collect()} == {(1, 2)}


def test_texts_with_phrases_in_common_hardly_meet(spark):
    """Sketches with a value or two in common, as texts with the same phrases have, meet in few lists; a family of edited copies in it meets whole."""
    rng = random.Random(12)
    pool = [rng.getrandbits(63) for _ in range(4000)]
    sketches = [sorted(rng.sample(pool, N.SKETCH)) for _ in range(300)]
    base = [rng.getrandbits(63) for _ in range(N.SKETCH)]
    family = [sorted(rng.sample(base, 42) + rng.sample(pool, N.SKETCH - 42)) for _ in range(12)]
    classes = spark.createDataFrame(list(enumerate(sketches + family)), "k bigint, sketch array<bigint>")
    met = [(r.a, r.b) for r in N._lists(classes).collect()]
    values = sum(len(set(a) & set(b)) for a, b in itertools.combinations(sketches, 2))
    assert values > 40_000 and sum(b < 300 for _, b in met) < 0.1 * values
    assert all(met.count(p) >= N.LISTS for p in itertools.combinations(range(300, 312), 2))


def test_sketch_estimates_jaccard():
    rng = random.Random(7)
    a = [_sentence(rng) for _ in range(60)]
    b = a[:40] + [_sentence(rng) for _ in range(20)]
    x, y = " ".join(a), " ".join(b)
    h, o = N.shingle_hashes([x, y])
    k = 256
    est = N.union_estimate(h[o[0] : o[1]][:k], h[o[1] : o[2]][:k], k)
    assert abs(est - N.exact_jaccard(x, y)) < 0.12
    assert np.array_equal(N.shingle_hashes([x])[0], h[o[0] : o[1]])


def test_joined_and_parted_sentences_count():
    assert N.shared_sentences("Eins zwei drei vier. Fünf sechs sieben acht. Neun zehn elf zwölf.", "Eins zwei drei vier Fünf sechs sieben acht. Neun zehn elf zwölf.") == 1.0
