"""Language of documents and of segments in another language (problem 6).

Rank-order profiles: a language's profile ranks its most frequent character
n-grams; a text's most frequent n-grams are compared with every profile by the
out-of-place distance, the sum of the rank differences, with the length of the
profile for an n-gram it lacks.  The nearest profile is the language; the
confidence is the relative gap to the second nearest.  Batches of texts are
counted, ranked and compared as numpy arrays.

Words with a capital letter (names, in most languages) and digits are left out
of both sides, except where nothing else remains.

Defined results: null, empty and letterless texts have no language and
confidence 0; ties go to the language first in the alphabet.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quellwerk.llm.neardup import without
from quellwerk.llm.pages import article_positions
from quellwerk.session import materialise

LANGUAGES = ("de", "en", "es", "fr", "it", "ja", "nl", "pl", "pt", "ru", "tr")
#: N-grams per profile, n-grams of a text that are compared, texts handled at once.
PROFILE, COMPARED, STEP = 400, 250, 256
#: A paragraph is in another language than its row if the distance to the row's language is larger by this share.
#: Texts of few letters, below ``SHORT``, need the second value.
APART, APART_SHORT, SHORT = 0.2, 0.295, 60
#: Rows per label, and paragraphs per language, from which the profiles are taught besides the samples.
TAUGHT_ROWS, TAUGHT_PARAGRAPHS, TAUGHT_SURE = 80, 400, 0.05
#: Weight of a title's letters, so that a title decides between equals only.
TITLE = 0.001
#: Names are left out of texts that keep this many letters.
LEFT = 8

# Names and codes of the languages, besides their two letters.
SPELLINGS = {
    "de": "deu ger german deutsch alemán allemand tedesco alemão duits niemiecki almanca немецкий ドイツ語",
    "en": "eng english englisch inglés anglais inglese inglês engels angielski ingilizce английский 英語",
    "es": "spa spanish spanisch español castellano espagnol spagnolo espanhol spaans hiszpański ispanyolca испанский スペイン語",
    "fr": "fra fre french französisch francés français francese francês frans francuski fransızca французский フランス語",
    "it": "ita italian italienisch italiano italien italiaans włoski italyanca итальянский イタリア語",
    "ja": "jpn jp japanese japanisch japonés japonais giapponese japonês japans japoński japonca японский 日本語",
    "nl": "nld dut dutch niederländisch holländisch neerlandés néerlandais olandese holandês nederlands niderlandzki holenderski felemenkçe нидерландский オランダ語",
    "pl": "pol polish polnisch polaco polonais polacco polonês pools polski lehçe польский ポーランド語",
    "pt": "por portuguese portugiesisch portugués portugais portoghese português portugees portugalski portekizce португальский ポルトガル語",
    "ru": "rus russian russisch ruso russe russo rosyjski rusça русский ロシア語",
    "tr": "tur turkish türkisch turco turc turks turecki türkçe турецкий トルコ語",
}


def label_language(label):
    """Column: the two-letter code a label names in any spelling; the lower-case label if it names another; null if it names none."""
    low = F.lower(F.trim(F.regexp_replace(label, "İ", "i")))
    head = F.regexp_extract(low, r"^([^-_ (]+)", 1)
    pairs = [x for code, names in SPELLINGS.items() for name in (code, *names.split()) for x in (F.lit(name), F.lit(code))]
    return F.when((low == "") | low.isin("und", "??", "xx", "n/a", "mul", "zxx", "-", "unknown", "none", "null"), None).otherwise(F.coalesce(F.try_element_at(F.create_map(*pairs), head), head))


class Profiles:
    """Rank-order profiles of the languages, as arrays."""

    def __init__(self, samples: list[tuple[str, str]], languages: tuple[str, ...] = LANGUAGES):
        self.languages = languages
        letters = sorted({c for _, s in samples for c in s.lower() if c.isalpha()} | set("abcdefghijklmnopqrstuvwxyz"))
        kept = [c for c in letters if not self._coarse(c)][:248]
        self.code = np.zeros(0x10000, np.uint8)
        for i, c in enumerate(kept, 1):
            if ord(c) < 0x10000:
                self.code[ord(c)] = i
        for a in range(0x10000):
            c = chr(a)
            if not self.code[a] and c.isalpha():
                low = c.lower()[:1]
                coarse = self._coarse(c)
                self.code[a] = coarse or (self.code[ord(low)] if low and ord(low) < 0x10000 else 0) or 252
        self.upper = np.array([chr(a).isupper() for a in range(0x10000)])
        self.table = np.full((1 << 24) + (1 << 23), -1, np.int16)
        # capitalised words that belong to one language are kept, the others count as names
        seen: dict[int, Counter] = {}
        self.known = np.zeros(0, np.int64)
        for language, sentence in samples:
            letter, start, word, points, x, _ = self._words([sentence])
            for h in self._word_hashes(x, letter, start, word)[self.upper[points[start]]].tolist():
                seen.setdefault(h, Counter())[language] += 1
        self.known = np.array(sorted(h for h, c in seen.items() if sum(c.values()) >= 3 and max(c.values()) >= 0.9 * sum(c.values())), np.int64)
        by_language: dict[str, Counter] = {x: Counter() for x in languages}
        for language, sentence in samples:
            if language in by_language:
                _, grams = self._grams(self._codes([sentence])[0])
                by_language[language].update(grams.tolist())
        ranked = {x: [g for g, _ in sorted(c.items(), key=lambda kv: (-kv[1], kv[0]))[:PROFILE]] for x, c in by_language.items()}
        best: dict[int, int] = {}
        for grams in ranked.values():
            for r, g in enumerate(grams):
                best[g] = min(best.get(g, PROFILE), r)
        vocabulary = sorted(best, key=lambda g: (best[g], g))
        self.table[vocabulary] = np.arange(len(vocabulary))
        self.ranks = np.full((len(vocabulary), len(languages)), PROFILE, np.int32)
        for j, x in enumerate(languages):
            for r, g in enumerate(ranked[x]):
                self.ranks[self.table[g], j] = r

    @staticmethod
    def _coarse(c: str) -> int:
        return 250 if "一" <= c <= "鿿" else 251 if "゠" <= c <= "ヿ" else 0

    def _words(self, texts: list[str]):
        """Of the joined texts: letters, word starts, word of each position, code points, letter codes, text of each position."""
        joined = "  ".join(texts) + "  "
        points = np.minimum(np.frombuffer(joined.encode("utf-32-le", "replace"), np.uint32), 0xFFFF)
        owner = np.repeat(np.arange(len(texts)), np.fromiter((len(t) + 2 for t in texts), np.int64, len(texts)))
        x = self.code[points]
        letter = x > 0
        start = letter.copy()
        start[1:] &= ~letter[:-1]
        return letter, start, np.maximum(np.cumsum(start) - 1, 0), points, x, owner

    @staticmethod
    def _word_hashes(x: np.ndarray, letter: np.ndarray, start: np.ndarray, word: np.ndarray) -> np.ndarray:
        first = np.flatnonzero(start)
        if not len(first):
            return np.zeros(0, np.int64)
        at = np.arange(len(x)) - first[word]
        weight = np.power(np.int64(0x5851F42D4C957F2D), np.clip(at, 0, 40))
        return np.bincount(word, minlength=len(first)) * 0 + np.add.reduceat(np.where(letter, x.astype(np.int64) * weight, 0), first)

    def _codes(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Letter codes of the joined texts without names, and the text of each position."""
        letter, start, word, points, x, owner = self._words(texts)
        name = self.upper[points[start]]
        if len(self.known) and name.any():
            h = self._word_hashes(x, letter, start, word)
            at = np.minimum(np.searchsorted(self.known, h), len(self.known) - 1)
            name &= self.known[at] != h
        drop = letter & name[word] if len(name) else np.zeros_like(letter)
        left = np.bincount(owner[letter & ~drop], minlength=len(texts))
        drop &= left[owner] >= LEFT  # else nothing else remains
        x = x.copy()
        x[drop] = 0
        return x, owner

    @staticmethod
    def _grams(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions and codes of all 1-, 2- and 3-grams within words, with one mark at a word's end, and of short whole words."""
        a = x.astype(np.int32)
        b = np.append(a[1:], 0)
        c = np.append(b[1:], 0)
        one = np.flatnonzero(a > 0)
        two = np.flatnonzero((a > 0) | (b > 0))
        three = np.flatnonzero(b > 0)
        # a word of up to six letters is an n-gram of its own, with a code beyond the others'
        z = np.append(a, np.zeros(6, np.int32))
        first = np.flatnonzero((a > 0) & (np.append(0, a[:-1]) == 0))
        whole, open_ = np.zeros(len(first), np.int64), np.ones(len(first), bool)
        for j in range(7):
            nxt = z[first + j] if len(first) else np.zeros(0, np.int32)
            if j == 6:
                open_ &= nxt == 0
            else:
                whole = np.where(nxt > 0, whole * 257 + nxt, whole * 257 + 256)
        word = first[open_]
        codes = (whole[open_] * 2654435761 % (1 << 23)).astype(np.int32) | 1 << 24
        return (
            np.concatenate([one, two, three, word]),
            np.concatenate([a[one] | 255 << 16 | 255 << 8, a[two] << 8 | b[two] | 254 << 16, a[three] << 16 | b[three] << 8 | c[three], codes]),
        )

    def distances(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Out-of-place distance of every text to every language, and the letters of each text that were compared."""
        x, owner = self._codes(texts)
        at, grams = self._grams(x)
        ids = self.table[grams]
        held = ids >= 0
        v = len(self.ranks)
        counts = np.bincount(owner[at[held]] * v + ids[held], minlength=len(texts) * v)
        cells = np.flatnonzero(counts)
        who = cells // v
        order = np.argsort(who * (1 << 40) - counts[cells] * (1 << 20) + cells % v)
        cells, who = cells[order], who[order]
        starts = np.searchsorted(who, np.arange(len(texts)))
        rank = np.arange(len(cells)) - starts[who]
        keep = rank < COMPARED
        cells, who, rank = cells[keep], who[keep], rank[keep]
        apart = np.abs(self.ranks[cells % v] - rank[:, None])
        out = np.stack([np.bincount(who, apart[:, j], minlength=len(texts)) for j in range(len(self.languages))], 1)
        return out, np.bincount(owner[x > 0], minlength=len(texts))

    def compare(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Distances and letters of any number of texts."""
        parts = [self.distances(texts[i : i + STEP]) for i in range(0, len(texts), STEP)]
        return np.concatenate([d for d, _ in parts]), np.concatenate([n for _, n in parts])


def nearest(d: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per text: index of the nearest language (-1 if it has no n-gram) and the relative gap to the second nearest."""
    best = np.sort(d, 1)
    some = best[:, 1] > 0
    return np.where(some, d.argmin(1), -1), np.where(some, (best[:, 1] - best[:, 0]) / np.maximum(best[:, 1], 1), 0.0)


_profiles: dict[tuple, Profiles] = {}


def profiles(samples: tuple[tuple[str, str], ...]) -> Profiles:
    if samples not in _profiles:
        _profiles[samples] = Profiles(list(samples))
    return _profiles[samples]


def lessons(pages: DataFrame, samples: DataFrame, key: str, blocks: str, label: str) -> tuple[tuple[str, str], ...]:
    """Sentences the profiles are taught from: the samples, and paragraphs of a bounded number of labelled rows
    per language whose label the samples' own profiles confirm.  The samples are a fixed table; its size is checked.
    """
    rows = samples.where("sprache is not null and satz is not null").select("sprache", "satz").limit(10_001).collect()
    if len(rows) > 10_000:
        raise ValueError("the language samples are meant to be a few sentences per language")
    taught = sorted((r[0], r[1]) for r in rows)
    first = profiles(tuple(taught))
    w = Window.partitionBy("l").orderBy(F.xxhash64("k"), "k")
    labelled = pages.where(F.col(label).isin(*LANGUAGES) & F.col(key).isNotNull()).select(F.col(label).alias("l"), F.col(key).cast("bigint").alias("k"), F.col(blocks).alias("b"))
    kept = labelled.withColumn("r", F.row_number().over(w)).where(F.col("r") <= TAUGHT_ROWS).select("l", "b").collect()  # at most TAUGHT_ROWS a language
    told = [(r[0], r[1][i]) for r in kept for i in article_positions(r[1])]
    counts: Counter = Counter()
    if told:
        language, gap = nearest(first.compare([t for _, t in told])[0])
        for (name, text), x, g in zip(told, language, gap):
            if x >= 0 and first.languages[x] == name and g > TAUGHT_SURE and counts[name] < TAUGHT_PARAGRAPHS:
                counts[name] += 1
                taught.append((name, text))
    return tuple(taught)


def paragraph_languages(pages: DataFrame, samples: DataFrame, key: str = "zeilen_nr", blocks: str = "absaetze", label: str = "sprache", title: str = "titel_original") -> DataFrame:
    """key, absatz_nr, sprache, konfidenz, haupt (the row's main language), haupt_konfidenz: one row per article paragraph.

    The main language is that of most letters of the article; between equals, and for articles without letters, the title decides.
    """
    taught = lessons(pages, samples, key, blocks, label)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = profiles(taught)
        names = np.array(known.languages, dtype=object)
        for batch in batches:
            keys, numbers, texts, sizes, titles = [], [], [], [], []
            for k, page, head in zip(batch["k"].tolist(), batch["b"].tolist(), batch["t"].tolist()):
                own = article_positions(page)
                if own:
                    sizes.append(len(own))
                    titles.append(head or "")
                    for i in own:
                        keys.append(k)
                        numbers.append(i)
                        texts.append(page[i])
            if not texts:
                continue
            d, letters = known.compare(texts + titles)
            language, gap = nearest(d)
            of_title, in_title = language[len(texts) :], letters[len(texts) :]
            d, letters, language, gap = (x[: len(texts)] for x in (d, letters, language, gap))
            row = np.repeat(np.arange(len(sizes)), sizes)
            votes = np.zeros((len(sizes), len(names)))
            np.add.at(votes, (row, np.maximum(language, 0)), np.where(language >= 0, letters, 0))
            np.add.at(votes, (np.arange(len(sizes)), np.maximum(of_title, 0)), np.where(of_title >= 0, np.minimum(in_title * TITLE, 0.5), 0))
            main = votes.argmax(1)
            of_main = d[np.arange(len(d)), main[row]]
            apart = (of_main - d.min(1)) / np.maximum(of_main, 1)
            other = (language >= 0) & (apart >= np.where(letters < SHORT, APART_SHORT, APART))
            yield pd.DataFrame(
                {
                    key: keys,
                    "absatz_nr": pd.Series(numbers, dtype="int32"),
                    "sprache": names[np.where(other, language, main[row])],
                    "konfidenz": np.where(other, apart, gap),
                    "haupt": names[main[row]],
                    "haupt_konfidenz": (votes.max(1) / np.maximum(votes.sum(1), 1e-9))[row],
                }
            )

    head = f"`{title}`" if title in pages.columns else "cast(null as string)"
    source = pages.where(f"`{key}` is not null").selectExpr(f"cast(`{key}` as bigint) as k", f"`{blocks}` as b", f"{head} as t")
    return source.mapInPandas(run, f"{key} bigint, absatz_nr int, sprache string, konfidenz double, haupt string, haupt_konfidenz double")


def language_cases(pages: DataFrame, samples: DataFrame, excluded: DataFrame, key: str = "zeilen_nr", blocks: str = "absaetze", label: str = "sprache", title: str = "titel_original") -> DataFrame:
    """key, absatz_nr, sprache, konfidenz: rows whose label is missing or wrong (-1) and paragraphs in another language than their row's."""
    wanted = [key, blocks, label, *([title] if title in pages.columns else [])]
    # the excluded keys are written once and sent to the tasks if they are few enough; texts are not shuffled
    rows = without(pages.select(*wanted, F.col(key).cast("bigint").alias("k_")), excluded.select(F.col(key).cast("bigint").alias("k_")), "k_").drop("k_")
    each = materialise(paragraph_languages(rows, samples, key, blocks, label, title), "languages")
    segments = each.where("sprache != haupt").select(key, "absatz_nr", "sprache", "konfidenz")
    main = each.groupBy(key).agg(F.first("haupt").alias("haupt"), F.first("haupt_konfidenz").alias("konfidenz"))
    claimed = pages.select(F.col(key).cast("bigint").alias(key), label_language(F.col(label)).alias("claimed"))
    wrong = main.join(claimed, key).where("claimed is null or claimed != haupt").select(key, F.lit(-1).alias("absatz_nr"), F.col("haupt").alias("sprache"), "konfidenz")
    return segments.union(wrong.dropDuplicates([key]))
