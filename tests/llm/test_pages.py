from quellwerk.llm import blocks as B
from quellwerk.llm import residue_rules as R
from quellwerk.llm.pages import furniture
from quellwerk.llm.residue import residue, skeleton

PROSE = "Die Aufsicht verlangt von Bo einen kürzeren Cookie-Hinweis und ein Ende der Newsletter ohne Zustimmung, weil die Nachfrage wächst."


def test_blocks():
    page = ["Startseite | Tarife | Kontakt", PROSE, "Bo bekommt 12 neue Masten", PROSE, "Lesen Sie auch: Bo senkt Preise um 3 Prozent", "© 2026 Bo. Alle Rechte vorbehalten.", "‹ 1 2 3 … 9 ›", "Wir verwenden Cookies, um Inhalte zu personalisieren. Alle akzeptieren oder Einstellungen ändern.", "• Bo senkt Preise", None, " "]
    assert B.label_blocks(page) == [1, 0, 0, 0, 1, 1, 1, 1, 1, 1, 1]
    assert B.label_blocks(None) == B.label_blocks([]) == []


def test_open_blocks_inherit():
    assert B.inherit([1, 2, 2, 0]) == [1, 1, 0, 0]
    assert B.inherit([1, 2, 1]) == [1, 1, 1]
    assert B.inherit([1, 2, 0]) == [1, 0, 0]
    assert B.inherit([2, 2]) == [0, 0]


def test_kinds():
    for t in ("Error 503: service temporarily unavailable", "[object Object]", "null null null", "Bitte aktivieren Sie JavaScript, um diese Seite zu nutzen.", "Dolor sit amet lorem ipsum.", "TODO: Absatz ergänzen"):
        assert R.kind(t) == R.RESIDUE, t
    for t in (PROSE, None, "", "Besucher von Bo sahen tagelang nur die Fehlermeldung 404 und den Rat, JavaScript einzuschalten, was Kritik auslöste.", "12,50"):
        assert R.kind(t) == R.NONE, t
    assert R.kind("${author} sagt ja") == R.VARIABLE
    assert R.variables("Stand „{{name}}“ da, {{x}}") == [("{{name}}", True), ("{{x}}", False)]


def _pages(spark, pages):
    return spark.createDataFrame([(i, p, "x") for i, p in enumerate(pages)], "zeilen_nr bigint, absaetze array<string>, k string")


def test_alignment_separates_residue_from_quotation(spark):
    filled = [[f"Die Sparte Bo meldet {n} Verträge im Quartal aus Ort."] for n in range(5)]
    left = [["Die Sparte {{name}} meldet {{zahl}} Verträge im Quartal aus Ort."]]
    quoted = [[f"Auf der Rechnung von Bo stand „{{{{kunde}}}}“, was {n} Leute meldeten."] for n in range(3)]
    alone = [["{{headline}} – ${x}"], [PROSE, "null null null"]]
    got = {r.zeilen_nr for r in residue(_pages(spark, filled + left + quoted + alone)).collect()}
    assert got == {5, 9, 10}
    assert skeleton("Die Sparte {{name}} meldet {{zahl}} Verträge.") == skeleton("Die Sparte Anna Bo meldet 1.200 Verträge.")


def test_furniture_rows(spark):
    df = _pages(spark, [["Startseite", PROSE, "null null null"], None, [], ["Startseite", PROSE, "null null null"]])
    assert sorted((r.zeilen_nr, r.absatz_nr) for r in furniture(df).collect()) == [(0, 0), (3, 0)]
    assert furniture(df.limit(0)).count() == 0 and residue(df.limit(0)).count() == 0


def test_whole_page_templates_are_induced_without_wording(spark):
    rows = [(i, ["Ruhe im Haus bis morgen abend."], f"Ein ganz anderer Titel {i}"[::-1], f"q{i}") for i in range(6)]  # unknown wording under six titles
    rows += [(10 + i, ["Der Netzbetreiber baut neue Masten im Norden."], "Neue Masten im Norden", f"q{i}") for i in range(6)]  # copies keep their title
    rows += [(20 + i, ["Zwei Titel sind keine Vorlage im Sinne der Regel."], f"{i} Titel", f"q{i}") for i in range(2)]
    df = spark.createDataFrame(rows, "zeilen_nr bigint, absaetze array<string>, titel_original string, quelle string")
    assert {r[0] for r in residue(df).collect()} == set(range(6))
    assert residue(df.drop("quelle")).count() == 0


def test_long_messages_are_judged_by_their_sentences():
    message = "Access denied. Your request was blocked, reference 08ca35e7. Please turn on scripts in your browser and reload the page. Something went wrong on our end."
    assert len(message) > 130 and R.paragraph_kind(message) == R.RESIDUE
    assert R.paragraph_kind(message + " Der Betreiber meldete gestern, dass 4000 Haushalte in drei Orten ohne Netz waren.") == R.NONE
    assert R.variables("Er schrieb „" + "sehr " * 40 + "{{name}} und mehr“ dazu.") == [("{{name}}", True)]
    assert R.variables('Er "las" {{name}} und "ging".') == [("{{name}}", False)]
