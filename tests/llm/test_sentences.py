import random

import pytest

from quellwerk.llm import sentence_rules as S
from quellwerk.llm.sentences import sentences

CASES = [
    ("Es gilt z. B. 3,5 GHz. Am 3. Mai startet Version 9.1 in Ort. „Das dauert!“, rief Mia. Ende.", ["Es gilt z. B. 3,5 GHz.", "Am 3. Mai startet Version 9.1 in Ort.", "„Das dauert!“, rief Mia.", "Ende."]),
    ("Shares rose in the U.S. A deal was signed. “That takes too long!” shouted Bo. Dr. Bo left.", ["Shares rose in the U.S.", "A deal was signed.", "“That takes too long!” shouted Bo.", "Dr. Bo left."]),
    ("Titel ohne Punkt\n \nErster Satz\nüber zwei Zeilen. Zweiter.", ["Titel ohne Punkt", "Erster Satz\nüber zwei Zeilen.", "Zweiter."]),
    ("「時間がかかりすぎる！」と彼は叫んだ。次の文。", ["「時間がかかりすぎる！」と彼は叫んだ。", "次の文。"]),
    ("因为增长。“太慢了！”Bo喊道。图2比较了A和B……并给出结论。", ["因为增长。", "“太慢了！”Bo喊道。", "图2比较了A和B……并给出结论。"]),
    ("यह है। “यह लंबा है!” Drialtar चिल्लाए। प्रो. Bo आए।", ["यह है।", "“यह लंबा है!” Drialtar चिल्लाए।", "प्रो. Bo आए।"]),
    ("รายได้เพิ่มขึ้น 2.8 เปอร์เซ็นต์จากปีก่อน รุ่น 6.3 รองรับแล้ว", ["รายได้เพิ่มขึ้น 2.8 เปอร์เซ็นต์จากปีก่อน", "รุ่น 6.3 รองรับแล้ว"]),
    ("Selon M. Bo, l'art. 3 vaut. « C'est trop long ! » a crié Bo. La 5G s'installe à X !", ["Selon M. Bo, l'art. 3 vaut.", "« C'est trop long ! » a crié Bo.", "La 5G s'installe à X !"]),
    ("Drei Ziele: 1. Ausbau, 2. Betrieb, 3. Wartung.Danach Ende.", ["Drei Ziele: 1. Ausbau, 2. Betrieb, 3. Wartung.", "Danach Ende."]),
    ("“One. Two. Three.” said Bo. Four.", ["“One. Two. Three.” said Bo.", "Four."]),
]


@pytest.mark.parametrize("text,want", CASES)
def test_known_texts(text, want):
    assert [text[a:b] for a, b in S.sentence_spans(text)] == want


def test_none_empty_blank():
    assert S.sentence_spans(None) == S.sentence_spans("") == S.sentence_spans(" \n\t ") == []


def _brute(text):
    """The best set of spans by trying all, for one block."""
    marks = [m for m in S._TERMINAL.finditer(text)]
    cands = [(m.end(), g) for m in marks if (g := S._score(text, m, 0, len(text))) is not None and g > -6.0]
    changes = S._depths(text, 0, len(text))
    depth = lambda e: ([0] + [d for p, d in changes if p <= e])[-1]
    best = None
    for mask in range(1 << len(cands)):
        ends = [0, *[e for i, (e, _) in enumerate(cands) if mask >> i & 1], len(text)]
        v = sum(g for i, (_, g) in enumerate(cands) if mask >> i & 1)
        v += sum(S._length(b - a) - (S.UNBALANCED if depth(a) != depth(b) else 0) for a, b in zip(ends, ends[1:]))
        best = max(best, (v, len(ends))) if best else (v, len(ends))
    return best[0]


def test_program_finds_the_best_sum():
    rng = random.Random(4)
    parts = ["Der Bau ruht.", "“Ja.", "Nein.” ", "Am 3. Mai", "z. B. Bo.", "„Gut!“", "K.", "5G kommt!", "(s. Abb. 2).", "Ende…"]
    for _ in range(150):
        text = " ".join(rng.choice(parts) for _ in range(rng.randrange(1, 9))).strip()
        spans = S.sentence_spans(text)
        changes = S._depths(text, 0, len(text))
        depth = lambda e: ([0] + [d for p, d in changes if p <= e])[-1]
        gains = {m.end(): g for m in S._TERMINAL.finditer(text) if (g := S._score(text, m, 0, len(text))) is not None}
        ends = [0, *[b for _, b in spans]]
        got = sum(gains.get(e, 0.0) for e in ends[1:-1]) + sum(S._length(b - a) - (S.UNBALANCED if depth(a) != depth(b) else 0) for a, b in zip(ends, ends[1:]))
        assert got == pytest.approx(_brute(text)), text


def test_long_text_is_read_whole(spark):
    text = "Ein Satz steht hier. " * 30_000
    df = spark.createDataFrame([(1, text, "x"), (2, None, "x"), (None, "a", "x")], "doc_id bigint, text string, anfang string")
    rows = sentences(df).collect()
    assert len(rows) == 30_000 and max(r.ende for r in rows) == len(text) - 1
