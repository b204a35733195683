"""Sentence spans of one text by semi-Markov dynamic programming.

A blank line ends a block; inside a block every terminal mark is a candidate
end, however unlikely.  The program picks the set of whole spans with the
largest sum of scores: how well a span's last word closes it, how well its
first word opens it, how long it is, and whether its quotation marks and
brackets balance.  The balance of a span depends only on the depths at its two
ends, and the length score is constant from ``LONG`` characters on, so of the
starts farther back the best per depth suffices: the search is exact and its
steps per candidate are bounded by the candidates in ``LONG`` characters.

Offsets count code points, the end is exclusive, no span has white space at
its ends.  Null, empty and blank texts have no spans; a text without any
mark is one span.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

#: Characters from which a span counts as long; loss of a span whose quotations or brackets do not balance.
LONG = 400
UNBALANCED = 14.0
#: An end that nothing speaks for: a small letter follows, or the word never ends a sentence.
UNLIKELY = -6.0

_BLANK_LINE = re.compile(r"(?:\r\n|\r|\n)[^\S\r\n]*(?:\r\n|\r|\n)\s*")
_TERMINAL = re.compile(
    r"(?P<dot>\.(?!\d)\.*|…+)(?P<c1>(?:[\"'”’»」』）)\]]|“(?!\w))*)|(?P<hard>[!?！？。｡؟।॥]+[!?.…]*)(?P<c2>\s?[»]|(?:[\"'”’»」』）)\]]|“(?!\w))*)|(?P<thai>(?<=[ก-๛])(?=\s+[ก-๛]))"
)
_MARKS = re.compile("[“„”«»「」『』()（）\\[\\]\"]")
_WORD_BACK = re.compile(r"[^\s(\[«“„\"'’]*$")
_NEXT = re.compile(r"\s*(?:(?:C\+\+|[^\w\s\"“„«»”「『(¿¡‘]|<\|\w+\|>)+\s+)*")
_DIGITS = re.compile(r"\d{1,2}$")
_INITIAL = re.compile(r"[^\W\d_]$")
_LETTERS = re.compile(r"[^\W\d_]*")

# Abbreviations that never end a sentence, then ones that may.
NEVER = frozenset("""
dr prof st nr abs abb ca z b d h bzw lt inkl max mio mrd abt s vgl evtl ggf sog u o zzgl hr fr tel str
no vol fig vs dept e.g i.e approx mr mrs ms gen sen rep cf p pp
env art cf dép ex pr mme mlle m fig av
aprox ej sr sra dra dpto pág v núm avda ee fig
ad es sig sig.ra dott prof ing n rep cfr pag l'ing l'art
eng av dep pág cf ex sra
mevr dhr ir o.a d.w.z bijv afd ca zie nl
ok np tj por rys ul inż dz dr
örn sn av bkz bl şek md no doç
т е с п ст рис см прибл проф ул отд тел г-н г-жа напр им
ص د أ.د
डॉ प्रो रु पृ श्री
""".split())
MAY_END = frozenset("etc usw enz ecc itd vb mwst a.m p.m u.s u.n inc ltd uu jr co corp cad д г bros m h u.k e.u".split())

# German month names and ordinal companions after "3.".
AFTER_ORDINAL = frozenset("""januar februar märz april mai juni juli august september oktober november dezember quartal halbjahr jahrhundert platz etage stock
januari februari maart mei oktober ocak şubat mart nisan mayıs haziran temmuz ağustos eylül ekim kasım aralık""".split())

# Words that say who spoke, after a closing quotation mark.
SPEECH = re.compile(
    r"\s*(?:と|って)|[^。！？!?」”]*?(?:喊道|问道|说道|问|说|表示|指出|补充)|\s*(?:صاح|سأل|قال|أضاف|صرخ|ذكر|أكد)|[^।!?”]*?(?:चिल्लाए|चिल्लाया|पूछा|कहा|बताया|बोले)|"
    r"\s*(?:said|asked|shouted|noted|added)\b|\s?[^\s฀-๿]*\s?(?:กล่าว|ถาม|ตะโกน)"
)
_QUOTE_END = re.compile("[”»“」』\"]$")


def _before(text: str, start: int, at: int) -> str:
    """The text before a place, back to at least three words, or the start."""
    width = 32
    while True:
        before = text[max(start, at - width) : at]
        if at - width <= start or len(before.split()) > 3:
            return before
        width *= 2


def _opening(text: str, m: re.Match, stop: int) -> tuple[float | None, str, int, bool]:
    """How well what follows a mark opens a sentence (None: no end can be here), its first character and place, and whether white space parts them."""
    end = m.end()
    spaced = text[end].isspace()
    at = _NEXT.match(text, end, stop).end() if spaced else end
    head = text[at : at + 1] if at < stop else ""
    if not head:
        return (0.0 if spaced else None), head, at, spaced
    if head.islower() and not text[at + 1 : at + 2].isupper():
        return UNLIKELY - 5.0, head, at, spaced
    return 0.0, head, at, spaced


def _closing(text: str, m: re.Match, start: int, stop: int, head: str, at: int, spaced: bool) -> float:
    """How well the mark and the words before it close a sentence, given the first character after it."""
    mark, end = m.group(), m.end()
    if not mark or not head:
        return 4.0
    if m.group("hard"):
        strong = mark[0] in "。｡！？।॥؟"
        if _QUOTE_END.search(mark) and SPEECH.match(text, end, stop):
            return UNLIKELY
        if not spaced and head in ",;:、，）)]":
            return UNLIKELY
        if head in "—–-" or text[end : end + 2].strip()[:1] in ("—", "–"):
            return -4.0
        if not spaced and not strong and not (head.isupper() or head in "“„«¿¡\"「" or head.isalpha() and not head.islower()):
            return UNLIKELY
        return 5.0
    upper = head.isupper() or head.islower() and text[at + 1 : at + 2].isupper()
    if "…" in mark or mark.startswith(".."):
        if text[m.start() - 1] in "[(" or not spaced:
            return UNLIKELY if not (head.isupper() and not spaced) else 1.0
        return 4.0 if upper or head in "“„«¿¡\"" or head.isalpha() and not head.islower() else UNLIKELY
    before = _before(text, start, m.start())
    word = _WORD_BACK.search(before).group()
    if "\u200b" in word or "\xad" in word:
        word = word.replace("\u200b", "").replace("\xad", "")
    low = word.lower()
    tail = low.rpartition(".")
    if len(tail[0]) >= 4 and "." not in tail[0] and tail[2] in NEVER:
        low = tail[2]  # the sentence before ended without white space
    if not spaced:
        if head in ",;:)" or not head.isalpha() and head not in "“„«¿¡\"":
            return UNLIKELY
        letters = word.rpartition("'")[2]
        if len(letters) < 2 or "." in word or low in NEVER or head.islower() or not (letters[-1].islower() or letters[-1].isdigit() or letters[-1] in "€%)" or letters[-1].isalpha() and not letters[-1].isupper() and not head.isupper()):
            return UNLIKELY
        return UNLIKELY if letters[-1].isdigit() and not head.isupper() else 3.0
    if head in "—–-,;:":
        return -4.0
    if m.group("c1") and not _QUOTE_END.search(mark):
        return 4.0 if not head.isdigit() else 2.0
    if _DIGITS.search(word) and (len(word) <= 2):
        lead = before[: len(before) - len(word)].rstrip()
        first = _LETTERS.match(text, at, stop).group().lower()
        if first in AFTER_ORDINAL or lead[-1:] in ":,":
            return UNLIKELY
        return 4.0 if lead.rpartition(" ")[2][:1].isupper() else 0.5
    if _INITIAL.fullmatch(word):
        prior = before[: len(before) - len(word)].split()
        if word in "SML" and len(prior) > 1 and len(prior[-1]) > 2 and prior[-1][0].isupper() and prior[-1].isalpha() and prior[-2][-1] not in ".!?…»”\"":
            return 4.0
        if low == "д" and prior and prior[-1] == "т.":
            return 3.0
        if low == "г" and upper and re.search(r"\d{4}\s*г$", before):
            return 1.0
        return UNLIKELY
    if low in MAY_END:
        return 2.0
    if low in NEVER or low.lstrip("(") in NEVER:
        return UNLIKELY
    return 2.0 if head.isdigit() else 5.0


def _score(text: str, m: re.Match, start: int, stop: int) -> float | None:
    """Gain of ending a sentence after the candidate and opening one behind it; None if no sentence can end there."""
    if m.end() >= stop:
        return None
    opening, head, at, spaced = _opening(text, m, stop)
    return None if opening is None else opening + _closing(text, m, start, stop, head, at, spaced)


#: Score of a long span.
FAR = -0.5


def _length(n: int) -> float:
    return -3.0 if n < 3 else -0.2 if n < 8 else 0.0 if n < LONG else FAR


def _depths(text: str, start: int, stop: int) -> list[tuple[int, int]]:
    """Positions at which the depth of quotations and brackets changes."""
    out, depth, low, straight = [], 0, 0, False
    for m in _MARKS.finditer(text, start, stop):
        ch = m.group()
        if ch == '"':
            straight = not straight
            depth += 1 if straight else -1
        elif ch == "„":
            low += 1
            depth += 1
        elif ch in "“”" and low:
            low -= 1
            depth -= 1
        elif ch in "“«「『(（[":
            depth += 1
        else:
            depth -= 1
        out.append((m.end(), depth))
    return out


_MARK = re.compile("[.…!?！？。｡؟।॥]")
_THAI = re.compile("[ก-๛]")


def _terminals(text: str, start: int, stop: int) -> Iterator[re.Match]:
    """Every candidate end; the pattern is tried at marks only, where no script ends sentences without one."""
    if _THAI.search(text, start, stop):
        yield from _TERMINAL.finditer(text, start, stop)
        return
    at = start
    for mark in _MARK.finditer(text, start, stop):
        if mark.start() >= at and (m := _TERMINAL.match(text, mark.start(), stop)):
            at = m.end()
            yield m


def _block(text: str, start: int, stop: int, out: list[tuple[int, int]]) -> None:
    ends, gains = [start], [0.0]
    for m in _terminals(text, start, stop):
        gain = _score(text, m, start, stop)
        if gain is not None:
            ends.append(m.end())
            gains.append(gain)
    ends.append(stop)
    gains.append(0.0)
    n = len(ends)
    if n == 2:
        out.append((start, stop))
        return
    changes = _depths(text, start, stop)
    depth, k, now = [], 0, 0
    for e in ends:
        while k < len(changes) and changes[k][0] <= e:
            now = changes[k][1]
            k += 1
        depth.append(now)
    value, back = [0.0] * n, [0] * n
    far_same: dict[int, tuple[float, int]] = {}
    far_any, near = (-1e18, 0), 0
    for j in range(1, n):
        at, own = ends[j], depth[j]
        while at - ends[near] >= LONG:
            item = (value[near], near)
            if item > far_same.get(depth[near], (-1e18, 0)):
                far_same[depth[near]] = item
            far_any = max(far_any, item)
            near += 1
        best, arg = -1e18, 0
        for i in range(near, j):
            size = at - ends[i]
            v = value[i] if size >= 8 else value[i] + _length(size)
            if depth[i] != own:
                v -= UNBALANCED
            if v > best:
                best, arg = v, i
        for v, i in ((far_same.get(own, (-1e18, 0))), (far_any[0] - UNBALANCED, far_any[1])):
            if v + FAR > best:
                best, arg = v + FAR, i
        value[j], back[j] = best + gains[j], arg
    cuts, j = [], n - 1
    while j:
        cuts.append(j)
        j = back[j]
    a = start
    for j in reversed(cuts):
        out.append((a, ends[j]))
        a = ends[j]


def sentence_spans(text: str | None) -> list[tuple[int, int]]:
    """(start, end) of every sentence, in order."""
    if not text or text.isspace():
        return []
    raw: list[tuple[int, int]] = []
    at = 0
    for m in _BLANK_LINE.finditer(text):
        _trimmed(text, at, m.start(), raw)
        at = m.end()
    _trimmed(text, at, len(text), raw)
    out = []
    for a, b in raw:
        while a < b and text[a].isspace():
            a += 1
        while b > a and text[b - 1].isspace():
            b -= 1
        if a < b:
            out.append((a, b))
    return out


def _trimmed(text: str, a: int, b: int, out: list[tuple[int, int]]) -> None:
    while a < b and text[a].isspace():
        a += 1
    while b > a and text[b - 1].isspace():
        b -= 1
    if a < b:
        _block(text, a, b, out)
