"""Page furniture in paragraph lists: two-pass block rules.

Pass 1 decides every block on its own from stop-word density, length, link
density and the shape of its end; pass 2 lets undecided short blocks inherit
the label of the nearest decided neighbour (a tie goes to the article, so a
subheading between article paragraphs stays).

Defined results: a null list gives an empty list; a null, empty or blank block
is furniture; blocks of any length are read whole.
"""

from __future__ import annotations

import re

FURNITURE, ARTICLE, OPEN = 1, 0, 2

# Labels that stand before a list of links, an advert, a share
# bar, a privacy switch or an imprint, in the languages served here.
LABELS = """
We value your privacy|Privacy settings|Share this article|Read also|More on this|Most read|Popular|Advertisement|Related|Tags|Topics
Datenschutz-Einstellungen|Ihre Privatsphäre ist uns wichtig|Artikel teilen|Lesen Sie auch|Mehr zum Thema|Meistgelesen|Beliebt|Anzeige|Verantwortlich i. S. d. Pressegesetzes|Schlagwörter
Preferencias de privacidad|Tu privacidad nos importa|Compartir|Lee también|Relacionado|Lo más leído|Publicidad
Réglages de confidentialité|Votre vie privée compte|Partager|À lire aussi|Sur le même sujet|Les plus lus|Populaire|Publicité
Preferenze privacy|La tua privacy conta|Condividi|Leggi anche|Sullo stesso tema|I più letti|Popolari|Pubblicità
Definições de privacidade|A sua privacidade conta|Partilhar|Leia também|Sobre o tema|Mais lidas|Populares|Publicidade
Privacykeuzes|Uw privacy telt|Delen|Lees ook|Meer hierover|Meest gelezen|Populair|Advertentie
Ustawienia prywatności|Twoja prywatność jest ważna|Udostępnij|Czytaj też|Zobacz także|Najczęściej czytane|Popularne|Reklama
Gizlilik ayarları|Gizliliğiniz önemli|Paylaş|Bunu da okuyun|İlgili|En çok okunan|Gözde|Reklam
Настройки|Нам важна ваша приватность|Поделиться|Читайте также|По теме|Самое читаемое|Популярное|Реклама
設定|プライバシー重視|共有|あわせて読みたい|関連記事|注目|人気|広告|編集
""".strip().replace("\n", "|").split("|")

# Words of menu entries and page feet.
MENU = """
about us home news contact devices regions plans coverage sign in podcast accessibility careers press room cancel contracts site map
über startseite nachrichten kontakt geräte regionen tarife netzausbau anmelden barrierefreiheit widerruf verträge hier kündigen impressum
quiénes somos inicio noticias contacto dispositivos regiones tarifas cobertura acceder pódcast accesibilidad empleo sala de prensa mapa del sitio
à propos accueil actualités nous écrire appareils régions forfaits couverture connexion balado accessibilité recrutement espace presse plan du
chi siamo pagina iniziale notizie scrivici dispositivi regioni offerte copertura accedi accessibilità lavora con noi stampa mappa
quem início notícias fale connosco equipamentos regiões tarifários entrar acessibilidade carreiras imprensa do
over ons voorpagina nieuws toestellen regio's abonnementen dekking inloggen toegankelijkheid vacatures pers opzeggen
o nas strona główna wiadomości urządzenia regiony taryfy zasięg zaloguj dostępność praca biuro prasowe strony
hakkımızda ana sayfa haberler iletişim cihazlar bölgeler tarifeler kapsama giriş erişilebilirlik kariyer basın odası haritası
о нас главная новости контакты устройства регионы тарифы покрытие войти доступность вакансии прессе карта сайта подкаст
会社案内 ホーム ニュース お問い合わせ 端末 地域 料金 エリア ログイン アクセシビリティ 採用 報道 サイトマップ ポッドキャスト
""".split()
MENU_WORDS = frozenset(MENU)

# Wording of consent notices, newsletter boxes and imprints; a
# line's parts must all occur, in lower case. "^" ties the first part to the start.
NOTICES = """
^©
all rights reserved|alle rechte vorbehalten|alle rechten voorbehouden|todos los derechos reservados|todos os direitos reservados
tous droits réservés|tutti i diritti riservati|wszelkie prawa zastrzeżone|все права защищены|tüm hakları saklıdır|無断転載
^by continuing you agree|^mit der weiteren nutzung stimmen sie|^si continúas navegando|^en poursuivant, vous acceptez|^proseguendo accetti
^ao continuar, aceita|^door verder te gaan stemt u|^korzystając dalej, godzisz się|^devam ederek+kabul edersiniz|^продолжая, вы принимаете|^閲覧を続けると
^we use cookies|^this site uses cookies|^wir verwenden cookies|^diese seite nutzt cookies|^usamos cookies|^utilizamos cookies|^este sitio usa cookies
^este sitio utiliza cookies|^esta web utiliza cookies|^este site utiliza cookies|^esta web usa cookies|^este site usa cookies|^nous utilisons des cookies|^ce site utilise des cookies|^usiamo i cookie|^questo sito usa i cookie
^wij gebruiken cookies|^deze site gebruikt cookies|^używamy plików cookie|^ta strona używa plików cookie|çerez kullan|çerezler kullan
^мы используем+cookie|^мы используем+куки|^сайт использует+cookie|クッキーを使い|クッキーを使用
kişiselleştirmek için çerez|cookies to personali
^sign up for+newsletter|^subscribe to+newsletter|^jetzt+newsletter abonnieren|^suscríbete+boletín|^recevez+lettre d|^iscriviti+newsletter
^subscreva+boletim|^schrijf u+nieuwsbrief|^zapisz się+biuletyn|^bültenimize+kaydolun|^подпишитесь+рассылку|メールマガジンに登録
^published by the+desk|^edita la redacción|^édité par la rédaction|^a cura della redazione|^editado pela redação|^uitgave van de redactie
^wydaje redakcja|yazı işleri yayınıdır|^издаёт редакция|編集部
^a site of+reprint|^eine seite der+nachdruck|sitio del grupo+reproducción|^un site du groupe+reproduction|^un sito del gruppo+riproduzione
^um site do grupo+reprodução|^een site van+overname verboden|^serwis grupy+przedruk|grubu sitesidir|^сайт группы+перепечатка|グループ運営+転載
"""
_STARTS: dict[str, list[tuple[str, ...]]] = {}
_INSIDE: list[tuple[str, ...]] = []
for _first, *_rest in (x.split("+") for x in NOTICES.strip().replace("\n", "|").split("|")):
    if _first[0] == "^":
        _STARTS.setdefault(_first[1:4], []).append((_first[1:], *_rest))
    else:
        _INSIDE.append((_first, *_rest))

# Frequent function words; their share tells prose from links.
STOP = frozenset("""
the of and to in a is for on that by with as at from are was be has it an or who which this will
der die das und in den von zu mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass nach bei um vor wird
el la de que y a en un ser se no los las por con para una su al lo como más pero sus le ya del son han desde
le les des et à est pour dans ce une il qui au pas sur plus par avec son du ont aux
il di che e un per una è con del della non sono si le dei da al ha alla nel hanno delle i gli
o os as do da em um uma para com não por mais dos se na no ao são à pela pelo
de het een van en te dat die op voor met aan zijn niet er om dan nog naar bij door over uit tot is
w i na z do się o że jest za od po jak przez dla to są już oraz ma nie
ve bir bu için ile de da olarak daha en çok var ise gibi kadar sonra her
в и на с что по из от к за для не о у уже до при
""".split())

_LABELS = frozenset(LABELS)
_MARK = re.compile(r"^\s*(?:[•»▸–←→‹›·|▪◦*✉]|->|#\w)\s?")
_SEPARATOR = re.compile(r"\s[|·»›>/•]\s|::|\n|\s{3,}|[←→♡↗⎙✉‹›]")
_END = re.compile(r"[.!?…。！？]['’\"”»“」』)\]]*\s*$")
_WORD = re.compile(r"[^\W\d_]+(?:['’\-][^\W\d_]+)*")
_CJK = re.compile(r"[぀-ヿ㐀-鿿]")
_PROSE_CJK = re.compile(r"[をがはにのでと][^\n]{2,}")
_CRUMB = re.compile(r"\s[›>]\s")
_DIGIT = re.compile(r"\d")
_TAGS = re.compile(r"^\s*(#[^\s#]+\s*)+$")


def stop_density(words: list[str]) -> float:
    """Share of function words."""
    return sum(w in STOP for w in words) / len(words) if words else 0.0


def link_density(block: str) -> float:
    """Share of the segments between link separators that have link length."""
    parts = [p for p in _SEPARATOR.split(block) if p and p.strip()]
    if len(parts) < 2:
        return 0.0
    return sum(len(p.split()) <= 4 and not _END.search(p) for p in parts) / len(parts)


def fold(text: str) -> str:
    """Lower case without the combining dot that the Turkish capital leaves."""
    return text.replace("İ", "i").lower()


def has_label(block: str) -> bool:
    """Does one of the fixed labels stand before the block's first colon?"""
    at = min((k for k in (block.find(":", 0, 48), block.find("：", 0, 48)) if k > 0), default=0)
    return at > 0 and block[:at].strip(" \t\xa0»•▸") in _LABELS


def is_notice(low: str) -> bool:
    """Does the block, in lower case, have the wording of a notice?"""
    for first, *rest in _STARTS.get(low[:3], ()):
        if low.startswith(first) and all(r in low for r in rest):
            return True
    for first, *rest in _INSIDE:
        if first in low and all(r in low for r in rest):
            return True
    return False


def decide(block: str | None) -> int:
    """Label of one block without its neighbours."""
    block = (block or "").strip()
    ends = bool(_END.search(block[-8:]))
    if len(block) > 220 and ends:
        return ARTICLE
    low = fold(block)
    if has_label(block) or is_notice(low) or block[:1] == "#" and _TAGS.match(block):
        return FURNITURE
    if len(block) > 50 and ends and block[0] not in "•»▸–←→‹›·|▪◦*✉-#" and "\n" not in block:
        return ARTICLE
    words = _WORD.findall(block)
    if not words or max(map(len, words)) <= 2 and not _CJK.search(block):
        return FURNITURE
    if not ends and (_MARK.match(block) or "::" in block or _CRUMB.search(block) or link_density(block) >= 0.5):
        return FURNITURE
    words = _WORD.findall(low)
    if not ends and all(w in MENU_WORDS for w in words):
        return FURNITURE
    if _CJK.search(block):
        if ends or len(block) > 14:
            return ARTICLE
        return OPEN if _PROSE_CJK.search(block) or _DIGIT.search(block) else FURNITURE
    density = stop_density(words)
    if ends and (len(words) >= 3 or density > 0):
        return ARTICLE
    if len(words) >= 12 and density >= 0.1:
        return ARTICLE
    if len(words) <= 3 and not ends and not _DIGIT.search(block):
        return FURNITURE
    return OPEN


def inherit(labels: list[int]) -> list[int]:
    """Pass 2: open blocks take the label of the nearest decided block; ties and pages without any are article."""
    decided = [i for i, x in enumerate(labels) if x != OPEN]
    out, j = [], 0
    for i, x in enumerate(labels):
        if x != OPEN:
            out.append(x)
            continue
        while j < len(decided) and decided[j] < i:
            j += 1
        left = decided[j - 1] if j else None
        right = decided[j] if j < len(decided) else None
        near = [k for k in (left, right) if k is not None]
        least = min((abs(k - i) for k in near), default=0)
        out.append(FURNITURE if near and all(labels[k] == FURNITURE for k in near if abs(k - i) == least) else ARTICLE)
    return out


class Memo(dict):
    """Results of a function of one text; short texts repeat, so they are kept, up to a fixed number."""

    def __init__(self, function, longest: int = 160, most: int = 200_000):
        super().__init__()
        self.function, self.longest, self.most = function, longest, most

    def __call__(self, text):
        if text is None or len(text) > self.longest:
            return self.function(text)
        if text not in self:
            if len(self) >= self.most:
                self.clear()
            self[text] = self.function(text)
        return self[text]


_decide = Memo(decide)


def label_blocks(blocks) -> list[int]:
    """Label of every block of a page."""
    return inherit([_decide(b) for b in blocks]) if blocks is not None else []
