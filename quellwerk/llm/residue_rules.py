"""Rules on one paragraph for template residue, filler, error messages and script notices.

``paragraph_kind`` gives VARIABLE for a paragraph that shows template variables
(whether they are residue is settled by template alignment, see residue.py),
RESIDUE for filler, error messages and notices, and 0 for anything else.
"""

from __future__ import annotations

import re

from quellwerk.llm.blocks import Memo

NONE, RESIDUE, VARIABLE = 0, 1, 2

#: Ways in which template languages write a variable.
VARIABLES = re.compile(
    r"\{\{\s*[\w.]+\s*\}\}|\$\{\s*[\w.]+\s*\}|#\{\s*[\w.]+\s*\}|\{%.*?%\}|<%=?.*?%>|<!--\s*[\w.]+\s*-->|%\([\w.]+\)s|"
    r"\[\[\s*[\w.]+\s*\]\]|@@\w+@@|\$\$\w+\$\$|__[A-Z][A-Z_]*[A-Z]__|%[A-Z][A-Z_]*[A-Z]%|(?<!\w)\[[a-z][a-zA-Z]*(?:\.[a-zA-Z]+)*\](?!\w)",
    re.S,
)
_QUOTES = re.compile("[“”„«»\"‘’‚「」『』]|(?<!\\w)'|'(?!\\w)")
_OPENING, _CLOSING = "“„«”\"‘‚「『'", "”“»«\"’‘」』'"

# Words of the usual dummy text.
LOREM = frozenset("""lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor incididunt ut labore et dolore magna
aliqua enim ad minim veniam quis nostrud exercitation ullamco laboris nisi aliquip ex ea commodo consequat duis aute irure in
reprehenderit voluptate velit esse cillum fugiat nulla pariatur excepteur sint occaecat cupidatat non proident sunt culpa qui officia
deserunt mollit anim id est laborum""".split())

# Filler and default values that stand alone.
FILLER_WORDS = re.compile(
    r"(?:(?:undefined|null|nan|none|n/a|todo|tbd|tba|tk|xxx+|test|dummy|noscript|loading|placeholder|foo|bar|\[object object\]|…|\.\.\.)[\s\d,.!]*)+", re.I
)
# Openings of filler sentences, in lower case.
FILLER = """
your text|insert text|insert your|enter text|text here|text goes here|sample paragraph|sample text|lorem|placeholder
todo:|beispieltext|blindtext|platzhalter|fülltext|hier steht|hier folgt ihr|text folgt|text einfügen|wird geladen
texto de relleno|texto de ejemplo|inserte aquí|cargando|contenido de ejemplo
texte d'exemple|texte de remplissage|insérez|chargement|votre texte ici
testo di esempio|testo segnaposto|inserisci qui|inserire qui|caricamento
texto de exemplo|insira aqui|carregando|texto de preenchimento
voorbeeldtekst|hier komt|tekst volgt|plaats hier
przykładowy tekst|wpisz tekst|tu wpisz|ładowanie
örnek metin|buraya metin|yükleniyor|metin buraya
пример текста|вставьте текст|введите текст|текст-заполнитель|загрузка
サンプルテキスト|ここに|ダミー|読み込み中
"""
# Parts of error messages, in lower case.
ERRORS = """
service temporarily unavailable|internal server error|not found on this server|page not found|something went wrong|too many requests
gateway did not|timely response|checking your browser|no longer available|access denied|request was blocked|replace me before
nicht gefunden|nicht verfügbar|nicht erreichbar|zugriff verweigert|zu viele anfragen|página solicitada|no disponible|acceso denegado
demasiadas peticiones|demasiadas solicitudes|introuvable|indisponible|accès refusé|trop de requêtes|pagina richiesta|non disponibile
accesso negato|troppe richieste|página pedida|indisponível|acesso negado|demasiados pedidos|gevraagde pagina|niet beschikbaar
toegang geweigerd|te veel verzoeken|nie znaleziono|niedostępna|odmowa dostępu|zbyt wiele żądań|bulunamadı|geçici olarak|erişim engellendi
çok fazla istek|не найдена|недоступ|доступ запрещ|доступ закрыт|слишком много запросов|見つかりません|利用できません
アクセスが拒否|アクセスが制限|アクセスできません|しばらくして
"""
_FILLER: dict[str, list[str]] = {}
for _x in FILLER.strip().replace("\n", "|").split("|"):
    _FILLER.setdefault(_x[:3], []).append(_x)
_ERRORS = ERRORS.strip().replace("\n", "|").split("|")
#: Status lines and identifiers of a failed request.
_CODES = re.compile(
    r"(?:http )?(?:error|fehler|erreur|errore|erro|fout|błąd|hata|ошибка|エラー)\W{0,3}\d{3}\b|\d{3}\s?[–:-]?\s?(?:internal|not found|forbidden|bad|service|gateway|unauthorized|error)|"
    r"(?:code|request id|ray id|trace id|reference|incident|error code)\s?:\s?\S+$",
    re.I,
)
SCRIPTS = re.compile(r"javascript|\bscripts?\b|\bskripte?\b|скрипт|スクリプト|\bkomut dosya|\bskrypt", re.I)
_WORD = re.compile(r"[^\W_]+")
_DIGIT = re.compile(r"\d")
_HINTS = "{$<%[@_"


def variables(text: str) -> list[tuple[str, bool]]:
    """Every template variable of a text and whether quotation marks enclose it: the nearest mark before opens, the nearest after closes."""
    out = []
    found = list(VARIABLES.finditer(text))
    marks = [m for m in _QUOTES.finditer(text) if not any(v.start() <= m.start() < v.end() for v in found)] if found else []
    for v in found:
        before = [m.group() for m in marks if m.end() <= v.start()]
        after = [m.group() for m in marks if m.start() >= v.end()]
        out.append((v.group(), bool(before and after) and before[-1] in _OPENING and after[0] in _CLOSING and _opens(before)))
    return out


def _opens(before: list[str]) -> bool:
    """Does the last mark open a quotation? A mark that may do both opens if an even number of its kind stood before."""
    last = before[-1]
    return last not in "\"'" or before.count(last) % 2 == 1


#: First characters of the filler words.
_FILLER_STARTS = frozenset("unt xdlpfb[….")
_MARK = re.compile("[.!?。！？]")
_PIECES = re.compile(r"(?<=[.!?])\s+|(?<=[。！？])")


def paragraph_kind(text: str | None) -> int:
    """NONE, RESIDUE or VARIABLE; null, empty and blank paragraphs are NONE.

    A paragraph is residue if it is one as a whole or if each of its sentences is, however many there are.
    """
    t = (text or "").strip()
    if not t:
        return NONE
    if any(c in t for c in _HINTS) and VARIABLES.search(t):
        return VARIABLE
    if _is_lorem(t) or _message(t):
        return RESIDUE
    end = _MARK.search(t)
    if end is None or end.end() == len(t) or not _message(t[: end.end()]):
        return NONE
    return RESIDUE if all(_message(x) for x in _PIECES.split(t) if x) else NONE


def _message(t: str) -> bool:
    """Is a sentence, or a text of a sentence's length, filler, an error message or a script notice? Prose that reports on one has more words or figures."""
    words = t.count(" ") + 1
    if words > 20:
        return False
    low = t.lower()
    for x in _FILLER.get(low[:3], ()):
        if low.startswith(x):
            return True
    if low[0] in _FILLER_STARTS and FILLER_WORDS.fullmatch(t) or _CODES.match(t):
        return True
    if words < 15:
        for x in _ERRORS:
            if x in low:
                return True
    # the words the pattern looks for, without their bounds
    held = "script" in low or "skr" in low or "скрипт" in low or "スクリプト" in low or "komut" in low
    return held and words < 13 and bool(SCRIPTS.search(low)) and not _DIGIT.search(t)


def _is_lorem(text: str) -> bool:
    """At least four fifths of the words are dummy text."""
    if "dolor" not in text and "Dolor" not in text and "ipsum" not in text and "Ipsum" not in text and "amet" not in text and "Amet" not in text:
        return False
    words = _WORD.findall(text.lower())
    return len(words) >= 3 and sum(w in LOREM for w in words) >= 0.8 * len(words)


kind = Memo(paragraph_kind)
