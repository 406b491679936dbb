"""What the lines of web pages look like: keys, fixed furniture phrases, and statistics of a corpus's lines and titles."""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A line's key must be on one page in this many, and on this many pages at least, to count as repeated. Hence there are at
#: most REPEATED_SHARE x (lines a page) repeated keys, however many pages there are.
REPEATED_SHARE = 1500
REPEATED_LEAST = 5
#: Longer lines are content of their own, not furniture that repeats.
KEY_CHARS = 160
FLUSH_KEYS = 100_000

_DIGITS = re.compile(r"\d+(?:[.,  ]\d+)*")
_BULLET = re.compile(r"^(?:[-*•–—‣▪✅🧾🔎☑✓→]|\d{1,3}[.)]|\(?[a-z]\))\s+")
SENTENCE_END = re.compile(r"[.!?…。\uff01\uff1f।؟۔][\"'”’»」』)\]]*$")

# Furniture of pages by language, in lower case, as whole lines.
CONSENT = """
we use cookies to make this site work and to measure visits. | read our data notice to learn how long records of your visit are kept. | ok, continue | reject non-essential | manage preferences | accept all | got it
by continuing to browse you agree to our storing small files on your device. | you can withdraw consent at any time in the footer of each page. | we and selected third parties keep identifiers for analytics.
some features need storage on your device; choose which ones to allow below. | your privacy matters to us | wir verwenden cookies, um besuche zu messen. | alle akzeptieren | einstellungen ändern
usamos cookies para medir las visitas a este sitio. | aceptar todo | configurar preferencias | ce site utilise des témoins pour mesurer l'audience. | tout accepter | gérer mes choix
este sítio usa cookies para medir visitas. | aceitar tudo | gerir preferências | мы используем файлы cookie для учёта посещений. | принять все | настроить | 本站使用cookie统计访问量。 | 全部接受 | 管理偏好
当サイトは利用状況の計測にcookieを使用します。 | すべて許可 | 設定を変更
"""
MENU = """
home | about us | contact | search | archive | archives | video | subscribe | world | newsletter | data desk | sign in | methodology | weather | local | checks | topics | podcasts | donate | opinion | jobs | menu | login | log in | register | politics | sports | business | help
suche | startseite | über uns | kontakt | archiv | faktenchecks | themen | anmelden | welt | inicio | quiénes somos | contacto | archivo | verificaciones | temas | iniciar sesión | mundo | boletín | buscar | accueil | à propos | vérifications | thèmes | connexion | monde | lettre d'info | rechercher
início | sobre nós | contacto | arquivo | verificações | temas | entrar | boletim | pesquisar | главная | о нас | контакты | архив | проверки | темы | войти | мир | рассылка | поиск | 首页 | 关于我们 | 联系方式 | 存档 | 档案 | 核查 | 专题 | 登录 | 国际 | 订阅 | 搜索
ホーム | 私たちについて | お問い合わせ | アーカイブ | 検証 | 特集 | ログイン | 国際 | 購読 | 検索
"""
WIDGETS = """
advertisement | skip to main content | log in or create a free account | sign up for our morning briefing and get one check a day in your inbox. | breaking: follow our live page | on this page: claim, method, sources | our app sends checks like this one straight to your phone.
this browser can play the audio version of the page. | support independent checking from as little as the price of a coffee. | [share this chart] | story continues below | listen to this article | text size: a a a | get the week's best checks by email – it takes ten seconds to join.
en | es | fr | en / es / fr | help us keep checking: a monthly gift of any size pays for one more hour of research. | download our app | report an error on this page | cite this page | was this page helpful? yes / no | share  print  email  copy link | share print email copy link
follow us on social media | back to top ↑ | back to top | terms of use | terms of use | privacy | accessibility | imprint | advertise with us · careers · press room | nach oben | folgen sie uns | impressum | datenschutz | unterstützen sie unsere faktenchecks mit einem abo.
aviso legal | privacidad | volver arriba | apoya nuestras verificaciones con una cuota mensual. | síguenos | mentions légales · confidentialité | haut de page | suivez-nous | soutenez nos vérifications par un don mensuel. | voltar ao topo | siga-nos | termos | privacidade
условия | конфиденциальность | наверх | подписывайтесь на нас | 使用条款 | 隐私 | 返回顶部 | 利用規約 | プライバシー | ページの先頭へ | impressum | datenschutz | accessibility | imprint | privacy
"""
TEASER_HEADS = """
trending now | in this section | most read | you may also like | related checks | related | editor's picks | read also | read more | recommended | mehr zum thema | meistgelesen | relacionados | lo más leído | à lire aussi | les plus lus | mais lidas | читайте также | популярное | 相关阅读 | 热门文章 | 関連記事 | 人気記事
"""
SUBHEADS = """
the claim | background | our ruling | what we checked | key points | sources | verdict | conclusion | die behauptung | behauptung | hintergrund | fazit | was wir geprüft haben | quellen | la afirmación | contexto | veredicto | qué comprobamos | fuentes | l'affirmation | contexte | verdict | ce que nous avons vérifié | sources
a alegação | contexto | conclusão | o que verificámos | fontes | утверждение | контекст | вывод | что мы проверили | источники | 说法 | 背景 | 结论 | 核查内容 | 来源 | 主張 | 背景 | 結論 | 確認した内容 | 出典 | ข้อสรุป | สิ่งที่ตรวจสอบ | ภูมิหลัง | पृष्ठभूमि | निष्कर्ष | हमने क्या जाँचा | الخلفية | الخلاصة | ما تحققنا منه
"""


def _set(text: str) -> frozenset[str]:
    return frozenset(x.strip() for row in text.strip().split("\n") for x in row.split(" | ") if x.strip())


def _garbled(phrases: frozenset[str]) -> frozenset[str]:
    """What phrases outside ASCII look like, in lower case, when their bytes were read by another encoding."""
    out = set()
    for phrase in phrases:
        if phrase.isascii():
            continue
        for form in {phrase, phrase.capitalize(), phrase.title()}:
            raw = form.encode()
            read = [_read_as(raw, e) for e in ("cp1252", "latin-1", "cp437", "cp850", "mac_roman", "cp1251", "koi8_r")]
            read += [_read_as(read[0].encode(), "cp1252"), raw.decode("gbk", "replace")]
            for meant in ("cp1251", "koi8_r", "gbk", "shift_jis", "cp1252"):
                try:
                    own = form.encode(meant)
                except UnicodeEncodeError:
                    continue
                read += [_read_as(own, e) for e in ("cp1252", "latin-1", "cp866", "cp1251", "koi8_r") if e != meant] + [own.decode("utf-8", "replace")]
            out.update(" ".join(x.lower().split()) for x in read)
    return frozenset(x for x in out if len(x) > 2 and x not in phrases)


def _read_as(raw: bytes, encoding: str) -> str:
    return raw.decode("latin-1").translate(_byte_table(encoding))


@functools.lru_cache(maxsize=None)
def _byte_table(encoding: str) -> dict[int, str]:
    """Characters of the upper bytes; a byte without one stands for itself."""
    return {b: bytes([b]).decode(encoding, "replace").replace("�", chr(b)) for b in range(128, 256)}


FURNITURE = _set(CONSENT) | _set(MENU) | _set(WIDGETS)
MENU_ITEMS = _set(MENU) | _set("terms of use | privacy | accessibility | imprint | faq | impressum | datenschutz | aviso legal | privacidad | mentions légales | confidentialité | termos | privacidade | условия | конфиденциальность | 使用条款 | 隐私 | 利用規約 | プライバシー")
HEADS = _set(TEASER_HEADS)
SUBHEAD_LINES = _set(SUBHEADS)
#: The same with parts that vary, in the languages of the pages.
FURNITURE_PATTERN = re.compile(
    r"""(?ix)^(?:
    (?:©|\(c\)|â©|¬©|┬⌐|�)\s*\d{4}\b .{0,80} | .{0,60}(?:all\ rights\ reserved|alle\ rechte\ vorbehalten|todos\ los\ derechos\ reservados|todos\ os\ direitos\ reservados|tous\ droits\ réservés|все\ права\ защищены)\.? | .*(?:版权所有|無断転載を禁じます)
    | .{2,60}\ is\ not\ responsible\ for\ the\ content\ of\ external\ sites\. | .{2,60}\ is\ an\ independent\ newsroom\ funded\ by\ .* | part\ of\ the\ .{2,50}\ media\ group | registered\ office:\ .* | hosted\ in\ .*no\ trackers.*
    | issn\ [\dx-]+ | editor\ in\ chief:\ .* | published\ by\ .{2,50} | updated\ \d+\ minutes\ ago.* | \d+\ min\ read | \d+\ (?:comments?|kommentare?|commentaires?|comentarios?|comentários?)\b.{0,40} | (?:comentarios|comentários|kommentare|commentaires|комментарии)\ \(\d+\)
    | (?:комментариев|комментарии):?\ \d+ | \d+\ комментари\w+ | (?:评论|コメント)\ ?[((:]?\d+.* | \d+\ ?(?:条评论|件のコメント) | photo\ gallery\ \(\d+\ pictures\) | you\ have\ \d+\ free\ articles\ left\ this\ month\. | .{2,60}\ and\ its\ \d+\ partners\ process\ .* | poll:\ .*vote\ below\.?
    | .{2,40}\ -?\d+\ ?°\ ?[cf]?\b.{0,20} | watch:\ .*\(\d+:\d+\) | change\ region:\ .* | tags:\ .* | (?:next|prev|previous):\ .* | (?:share|follow)\ (?:this|us)\b.{0,40} | \[(?:share|print|embed|save|listen)[^\]]{0,30}\] | more\ from\ .{2,50}
    )$"""
)
#: Subheads of articles with parts that vary.
SUBHEAD_PATTERN = re.compile(r"(?i)^(?:how the .{2,60} works|numbers behind .{2,60}|verdict on .{2,60}|what .{2,60} (?:said|did|found|shows)|interview with .{2,60}|evidence from .{2,60}|verdict: .{2,40}|no evidence\.|no evidence on .{2,60})$")
#: The same lists with their wrongly decoded forms.
ALL_FURNITURE, ALL_MENU, ALL_HEADS, ALL_SUBHEADS = (x | _garbled(x) for x in (FURNITURE, MENU_ITEMS, HEADS, SUBHEAD_LINES))
_MENU_SPLIT = re.compile(r"\s{2,}|\t|\s*(?:[|/>›»·]|" + "|".join(re.escape(x) for x in sorted(_garbled(frozenset("›»·")) | {_read_as(c.encode(), e).lower() for c in "›»·" for e in ("cp1252", "latin-1", "cp437", "cp850", "mac_roman")}, key=len, reverse=True)) + r")\s*")


#: The same with characters outside ASCII as blanks, which is what wrong decoding leaves alike.
_NOT_ASCII = re.compile(r"\s*[^\x00-\x7f]+\s*")
_PLAIN_FURNITURE, _PLAIN_HEADS = (frozenset(y for x in s if not x.isascii() and len(y := _NOT_ASCII.sub(" ", x).strip()) >= 5) for s in (FURNITURE, HEADS))


_SEPARATOR = re.compile(r"(?<=\S)(?:\s{2,}|\t|\s[|/>›»·]\s|[›»·|])(?=\S)")

#: Lines up to this length are told by their key's text, longer ones by a digest of all their text.
TEXT_CHARS = 200
_MAY_SEPARATE = re.compile(r"\s\s|[\t|/>›»·]")


def key_of(line: str, publisher: str | None) -> str:
    """What lines that repeat have in common: numbers as 0, the page's own publisher as <p>, white space as one blank, and
    what separates entries of menus (wide space among it) as " | ". Lines of more than TEXT_CHARS are their own key."""
    if len(line) > TEXT_CHARS:
        return line
    out = " ".join((_SEPARATOR.sub(" | ", line) if _MAY_SEPARATE.search(line) else line).split())
    if publisher and publisher in out:
        out = out.replace(publisher, "<p>")
    return _DIGITS.sub("0", out).lower()


def is_menu(line: str) -> bool:
    """Whether the line is menu entries, one or several with separators; bullets before them don't matter."""
    body = _BULLET.sub("", line.strip()).lower()
    if body in ALL_MENU:
        return True
    parts = [p for p in _MENU_SPLIT.split(body) if p]
    return len(parts) > 1 and sum(p in ALL_MENU for p in parts) * 2 > len(parts)


def furniture_kind(line: str) -> str | None:
    """``furniture``, ``head`` (of teasers), ``heads`` (with a teaser on the same line), ``subhead`` or None, by fixed phrases alone."""
    low = " ".join(line.lower().split())
    if low in ALL_SUBHEADS or SUBHEAD_PATTERN.match(low):
        return "subhead"
    if low in ALL_FURNITURE or is_menu(line) or FURNITURE_PATTERN.match(low):
        return "head" if low.startswith("more from ") else "furniture"
    if low in ALL_HEADS:
        return "head"
    if not low.isascii():
        plain = _NOT_ASCII.sub(" ", low).strip()
        if plain in _PLAIN_FURNITURE:
            return "furniture"
        if plain in _PLAIN_HEADS:
            return "head"
    before, colon, after = low.replace(":", ":").partition(":")
    if colon and after.strip() and before in ALL_HEADS:
        return "furniture"
    return None


@functools.lru_cache(maxsize=65_536)
def kind_of(line: str) -> str | None:
    return furniture_kind(line)


_TOKEN = re.compile(r"[^\W\d_][\w’'-]*|\d[\d.,  ]*|[·:–—|?!/,-]")


def title_words(title: str) -> list[str]:
    return [("0" if t[0].isdigit() else t.lower()) for t in _TOKEN.findall(title)]


def shape_of(line: str, frequent: frozenset[str] | set[str]) -> str:
    """A line with every run of words that are not frequent in titles as one blank."""
    out: list[str] = []
    for t in title_words(line):
        t = t if t in frequent or not t[0].isalpha() else "_"
        if t != "_" or not out or out[-1] != "_":
            out.append(t)
    return " ".join(out)


def bare_title(title: str, publisher: str | None) -> str:
    """The title without the publisher's name behind it."""
    title = title.strip()
    return re.sub(r"\s*[|:–—·-]\s*$", "", title[: -len(publisher)].rstrip()) if publisher and title.endswith(publisher) and len(title) > len(publisher) else title


def line_statistics(pages: DataFrame) -> DataFrame:
    """``key, pages, head, tail, last`` of repeated short lines: on how many pages, how often before the title, after the last
    line of prose, and as the very last line. ``pages`` has ``text, title, publisher``; partial counts leave a worker, not lines."""

    def scan(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts: dict[str, list[int]] = {}
        for pdf in pdfs:
            for text, title, publisher in zip(pdf["text"], pdf["title"], pdf["publisher"]):
                lines = [x for x in map(str.strip, text.split("\n")) if x]
                titled = title.strip() if title else ""
                at_title = lines.index(titled) if titled in lines else 0
                prose = max((i for i, x in enumerate(lines) if len(x) > KEY_CHARS), default=-1)
                seen = set()
                for i, line in enumerate(lines):
                    if len(line) > KEY_CHARS or i == at_title and titled:
                        continue
                    key = key_of(line, publisher)
                    if key in seen:
                        continue
                    seen.add(key)
                    row = counts.setdefault(key, [0, 0, 0, 0])
                    row[0] += 1
                    row[1] += i < at_title
                    row[2] += 0 <= prose < i
                    row[3] += i == len(lines) - 1
            if len(counts) > FLUSH_KEYS:
                yield _frame(counts)
                counts = {}
        yield _frame(counts)

    partial = pages.select("text", "title", "publisher").mapInPandas(scan, "key string, pages bigint, head bigint, tail bigint, last bigint")
    total = pages.count()
    sums = partial.groupBy("key").agg(*[F.sum(c).alias(c) for c in ("pages", "head", "tail", "last")])
    return sums.where(F.col("pages") >= REPEATED_LEAST).where(F.col("pages") * REPEATED_SHARE >= total)


def _frame(counts: dict[str, list[int]]) -> pd.DataFrame:
    return pd.DataFrame([(k, *v) for k, v in counts.items()], columns=["key", "pages", "head", "tail", "last"])


def learned_furniture(rows: list[tuple[str, int, int, int, int]], frequent: frozenset[str], shapes: frozenset[str]) -> frozenset[str]:
    """Keys of repeated lines that stand before titles or after the text, by their counts (see ``line_statistics``)."""
    out = set()
    for key, pages, head, tail, last in rows:
        if key in SUBHEAD_LINES or _BULLET.match(key) or shape_of(key, frequent) in shapes or "0" in key and not key.startswith(("©", "issn")):
            continue
        if head / pages > 0.12 and head >= 4 or tail / pages > 0.9 and last / pages < 0.5 and pages >= 8 and not SENTENCE_END.search(key):
            out.add(key)
    return frozenset(out)


def title_statistics(pages: DataFrame) -> tuple[frozenset[str], frozenset[str]]:
    """The words frequent in titles (in one of 25 at least) and the shapes that they make (of one of 300 titles at least): both
    bounded by those shares, as titles have a bounded number of words."""
    titles = pages.where("title IS NOT NULL").select("title", "publisher").groupBy("title", "publisher").count()

    @F.pandas_udf("array<string>")
    def words(title: pd.Series, publisher: pd.Series) -> pd.Series:
        return pd.Series([list(set(title_words(bare_title(t, p)))) for t, p in zip(title, publisher)])

    n = titles.agg(F.sum("count")).first()[0] or 0
    rows = titles.select("count", F.explode(words("title", "publisher")).alias("w")).groupBy("w").agg(F.sum("count").alias("n")).where(F.col("n") * 25 >= n).select("w").collect()
    frequent = frozenset(r[0] for r in rows)

    @F.pandas_udf("string")
    def shapes(title: pd.Series, publisher: pd.Series) -> pd.Series:
        return pd.Series([shape_of(bare_title(t, p), frequent) for t, p in zip(title, publisher)])

    rows = titles.groupBy(shapes("title", "publisher").alias("s")).agg(F.sum("count").alias("n")).where(F.col("n") * 300 >= n).select("s").collect()
    return frequent, frozenset(r[0] for r in rows if r[0] and r[0] != "_")


