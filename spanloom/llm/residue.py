"""Problem 2: template residue, filler, error pages and script notices in place of content.

Two kinds of evidence are combined. Host evidence: the terms of a page's body (without learned furniture) are compared with its title and
the slug of its address; a short body that meets neither is low-information, and lines that such bodies of several addresses have in
common, but hardly any page with a text, mark responses of servers and scripts, known to a detector or not. Placeholder detectors look for unfilled
fields and values, filler text, and messages that stand on a line of their own, also inside articles; a sentence that reports such a thing is no case.

Defined results: null and empty texts and titles show nothing; a redelivered row is the same record; very long texts are
searched whole; extra columns are ignored; an empty table has no cases.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.llm.boilerplate import label_lines, own_keys, prepared
from spanloom.llm.furniture import Furniture, digest, learn
from spanloom.llm.lines import bare_title, key_of
from spanloom.session import materialize

#: A body of at most so many characters, without furniture, says little.
LOW_INFORMATION = 320
#: A line of low-information bodies must come from so many different addresses, with titles it doesn't meet.
LEAST_ADDRESSES = 3

_NAME = r"[\w][\w.\- ]{0,30}"
_FIELD = re.compile(
    rf"\{{\{{\s*[^{{}}]{{1,40}}\s*\}}\}}|\{{%[^%{{}}]{{1,60}}%\}}|<%[=\-]?[^%<>]{{1,60}}%>|%%\w[\w.]{{0,30}}%%|@@\w[\w.]{{0,30}}@@|[#$]\{{{_NAME}\}}|\[\[{_NAME}\]\]|\(\({_NAME}\)\)|\*\|{_NAME}\|\*|(?<![\w/])__[A-Za-z][\w.]{{1,30}}?__(?!\w)"
    r"|(?<!\w)(?:\[(?:[a-z]+(?:[_.][a-z]+)+|[A-Z]+(?:[_.][A-Z]+)+|title|headline|lead|summary|claim|region|author|date|body|text|name|source|TITLE|HEADLINE|LEAD|SUMMARY|CLAIM|REGION|AUTHOR|DATE|BODY|TEXT|NAME|SOURCE|(?:[Ii]nsert|INSERT|[Yy]our|YOUR) [^\]]{1,30})\])"
    r"|<(?:[a-z]+(?:[_.][a-z]+)+|[A-Z]+(?:[_.][A-Z]+)+|title|headline|lead|summary|claim|region|author|date|TITLE|HEADLINE|LEAD|SUMMARY|CLAIM|REGION|AUTHOR|DATE)>(?!.*</)"
)
_FIELD_HINT = re.compile(r"\{[{%]|[#$]\{|<[%A-Za-z]|%%|@@|__|\[[A-Za-z\[]|\(\(|\*\|")
_FIELD_SIGNS = ("{", "%", "@@", "__", "[", "((", "<", "*|")
_VALUE = re.compile(r"\[object \w+\]|\bInvalid Date\b|\bNaN\b|\(null\)|\bundefined\b|(?<![\w-])null(?! and void\b)(?![\w-])|\bNullPointerException\b")
_VALUE_HINT = ("[object", "Invalid Date", "NaN", "null", "undefined", "NullPointer")
#: What stands right before a field that a sentence names or quotes instead of showing it.
_REPORTS = re.compile(r"(?i)(?:\b(?:fields?|placeholders?|variables?|tags?|writes|reads|wrote|words|literally|literal|code|string)\s*[“\"«„'‘]?|[“\"«„‘])$")
_ABOUT_VALUE = re.compile(r"(?i)\b(?:null hypothesis|null result|null and void|nan bread|is undefined in|mathematically undefined)\b")
_FILLER = re.compile(r"(?i)\b(?:lorem|ipsum|dolor|amet|consectetur|adipiscing|elit|tincid\w*|viverr\w*|vestu\w*|dapib\w*|sollic\w*|fusca|quindis|rhonce|pelorat|egat|allemor|ornat|morvit|nuntis|curabit\w*)\b")
_FILLER_LINE = re.compile(
    r"""(?ix)^(?:(?:test[\s.,!]+){2,}.* | .*\b(?:asdf|qwer(?:ty)?)\b.* | (?:x{3,}[\s.,]*){2,} | .*\btk(?:\s+tk)+\b.* | todo\b[:\s].* | (?:insert|add|enter|place|put)\s+(?:your\s+)?(?:body|title|text|headline|content|summary|copy)\s+here\.? | .*\b(?:headline|title|intro|text|copy|content|body|caption)\s+goes\s+here\b.* | sample\s+(?:paragraph|text|page)\b.* | dummy\s+text\b.* | placeholder\b.*
    | aquí\s+va\s+el\s+texto\b.* | texto\s+de\s+(?:ejemplo|exemplo)\b.* | (?:hier\s+steht|beispieltext|blindtext|platzhalter)\b.* | texte\s+d'exemple\b.* | (?:ici\s+va|votre)\s+(?:le\s+)?(?:texte|titre)\b.* | aqui\s+vai\s+o\s+texto\b.* | (?:пример\s+текста|здесь\s+будет\s+текст|текст[- ]заглушка)\b.* | (?:此处|在此)(?:插入|输入|填写).* | 示例文本.* | ここに(?:本文|テキスト|見出し).* | サンプルテキスト.* )$"""
)
#: Messages of servers, scripts and browser checks that make up a line (fixed phrases in the languages of the pages).
_MESSAGE = re.compile(
    r"""(?ix)^(?:
      (?:error\s+)?(?:http\s+)?[45]\d\d\s*[-–—:|]?\s*(?:error\b.*|page\ not\ found.*|not\ found.*|forbidden.*|bad\ gateway.*|bad\ request.*|service\ unavailable.*|gateway\ time-?out.*|internal\ server\ error.*|unauthorized.*|too\ many\ requests.*|gone.*|access\ denied.*)
    | (?:oops|sorry|whoops)[!,.]?\s.{0,120}(?:can(?:'|’)?t\ find|cannot\ find|went\ wrong|not\ found|does\ not\ exist|unavailable|try\ again).*
    | (?:the\ )?(?:page|article|address|resource|file|document)\ (?:you(?:\ are|'re|’re)?\ (?:looking\ for|requested|typed|tried)|requested|that\ you)\b.{0,160}(?:not|moved|removed|exist|deleted|found|unavailable).*
    | (?:page|file|article|document)\ (?:not\ found|does\ not\ exist|no\ longer\ available|unavailable).* | access\ (?:denied|forbidden)\b.{0,90} | you\ do\ not\ have\ permission\b.* | too\ many\ requests\b.* | you\ have\ reached\ the\ limit\ of\b.* | slow\ down\ and\ retry.*
    | error\ establishing\ a\ database\ connection.* | (?:an\ )?internal\ server\ error(?:\ occurred.*|[.!]?) | (?:fatal|parse|runtime|uncaught|syntax)\s*error:.* | traceback\ \(most\ recent\ call\ last\).* | file\ ".+",\ line\ \d+.* | \w*(?:error|exception):\ .{0,120} | warning:\ .*\bon\ line\ \d+
    | the\ upstream\ server\b.* | bad\ gateway.* | (?:service|site|page|website)\ (?:is\ )?(?:temporarily\ )?(?:unavailable|down)\b.* | (?:gateway|connection|request)\ time(?:d\s|-)?out.* | (?:this|the)\ (?:content|page|site|video)\ is\ (?:not|no\ longer|currently)\ (?:un)?available\b.* | (?:this|the)\ (?:site|page|service)\ is\ (?:down|under)\b.*maintenance.*
    | your\ session\ (?:has\ )?(?:expired|timed\ out)\b.* | (?:this\ )?redirect(?:ing|ed)\b.{0,60} | you\ are\ being\ redirected.* | loading(?:…|\.\.\.|[,.]?\ please\ wait.*) | please\ wait\b.{0,60} | if\ nothing\ happens\b.* | this\ may\ take\ up\ to\b.*seconds.*
    | (?:please\ )?(?:enable|turn\ on|switch\ on|activate|allow)\ (?:java\s?script|scripts?|scripting|cookies)\b.* | you\ (?:need|have)\ to\ (?:turn\ on|enable|switch\ on|allow|activate)\ (?:java\s?script|scripts?|scripting)\b.* | (?:this\ (?:page|site|app|website)|our\ (?:site|app))\ (?:requires|needs|works\ best\ with|uses)\ (?:java\s?script|scripts?|scripting)\b.* | java\s?script\ (?:is\ )?(?:required|disabled|must\ be|needed|off)\b.*
    | your\ browser\ is\ (?:not\ supported|out\ of\ date|outdated|unsupported)\b.* | we\ (?:have\ )?detected\ that\ (?:your\ browser|java\s?script|you)\b.* | checking\ (?:your\ browser|if\ the\ site|the\ security)\b.* | (?:please\ )?(?:verify|confirm|prove)\ (?:that\ )?you\ are\ (?:a\ )?(?:human|not\ a\ robot)\b.* | (?:complete|solve)\ the\ (?:captcha|challenge|action)\b.* | (?:are\ you|i(?:'|’)m\ not)\ a\ robot\b.* | update\ it\ or\ switch\ on\ scripting.* | try\ the\ search\ box\b.*
    | erreur\ [45]\d\d\b.* | (?:page|erreur)\ (?:introuvable|interne|non\ trouvée)\b.* | (?:la\ )?page\ (?:demandée|que\ vous)\b.{0,120} | (?:pour\ (?:lire|voir|afficher)\b.{0,60}|veuillez\ )?activez\ java\s?script\b.* | .{0,60}\bactivez\ java\s?script\b.{0,60} | accès\ (?:refusé|interdit)\b.{0,80} | votre\ session\ a\ expiré.* | vérification\ de\ votre\ navigateur.*
    | (?:diese\ |die\ )?seite\ (?:ist\ leider|wurde|nicht|existiert)\b.{0,100}(?:verfügbar|gefunden|nicht)\b.* | (?:die\ angeforderte|diese)\ seite\b.{0,100}(?:nicht|fehler)\b.* | bitte\ aktivieren\ sie\ (?:java\s?script|cookies)\b.* | zugriff\ (?:verweigert|verboten)\b.{0,80} | (?:interner\ )?serverfehler\b.* | fehler\ [45]\d\d\b.* | ihre\ sitzung\ ist\ abgelaufen.* | ihr\ browser\b.{0,120}
    | la\ página\ (?:solicitada|que\ busca)\b.* | página\ no\ encontrada.* | active\ java\s?script\b.* | (?:por\ favor,?\ )?(?:active|habilite)\ java\s?script\b.* | acceso\ denegado\b.{0,80} | error\ (?:interno\ del\ servidor|[45]\d\d)\b.* | su\ sesión\ ha\ (?:caducado|expirado).*
    | a\ página\ (?:que\ procura|solicitada|não)\b.* | página\ não\ encontrada.* | (?:por\ favor,?\ )?(?:ative|ativar|active)\ o?\ ?java\s?script\b.* | acesso\ negado\b.{0,80} | erro\ (?:interno|[45]\d\d)\b.* | a\ sua\ sessão\ expirou.*
    | страница\ не\ найдена.* | (?:запрошенная\ )?страница\b.{0,60}(?:удалена|не\ существует|не\ найдена).* | (?:для\ просмотра.{0,40}|пожалуйста,?\ )?включите\ java\s?script.* | доступ\ (?:запрещ[её]н|закрыт).{0,80} | (?:внутренняя\ )?ошибка\ (?:сервера|[45]\d\d).* | проверка\ браузера.*
    | (?:您访问的|抱歉,?|该|此)?页面(?:不存在|未找到|无法).* | 请(?:启用|开启|打开)\ ?java\s?script.* | 访问被拒绝.* | 服务器(?:内部)?错误.* | 正在(?:检查|验证)您的浏览器.* | お探しのページは.* | ページが見つかりません.* | (?:このページを表示するには)?java\s?scriptを(?:有効|オン)に.* | このページを表示するには.* | アクセスが拒否.* | サーバー(?:内部)?エラー.* | الصفحة\ (?:غير\ موجودة|المطلوبة).* | يرجى\ تفعيل\ .* | ไม่พบหน้า.* | (?:กรุณา|โปรด)เปิดใช้งาน\ ?java\s?script.* | पृष्ठ\ (?:नहीं\ मिला|उपलब्ध\ नहीं).* | कृपया\ java\s?script.*
    )$"""
)
_TITLES = re.compile(
    r"(?i)^(?:error|oops!?|untitled(?: document| page)?|sample page|new page|page title|no title|title|home ?page|index|default|document|redirecting(?:…|\.\.\.)?|loading(?:…|\.\.\.)?|please wait(?:…|\.\.\.)?|just a moment(?:…|\.\.\.)?|attention required!?.*|are you a robot\??|security check|captcha|maintenance|test(?: page)?|coming soon|under construction|hello world!?|service unavailable|bad gateway|forbidden|not found|site maintenance|one moment(?:…|\.\.\.|,? please.*)?|verification required|human verification|robot check|seite nicht gefunden|página no encontrada|página não encontrada|page introuvable|страница не найдена|页面不存在|ページが見つかりません|your headline goes here|null|undefined|nan|none|n/a|tbd|todo|xxx+)$"
)
#: Lines that only look like notices.
_HARMLESS = re.compile(r"(?i)^(?:this browser can play|page \d+|article \d+|pages? \d+[-–])")
#: In lower case: stems of filler words, what filler lines hold anywhere, and what they begin with; one for every alternative of the patterns.
_FILLER_STEMS = ("lorem", "ipsum", "dolor", "amet", "consectetur", "adipiscing", "elit", "tincid", "viverr", "vestu", "dapib", "sollic", "fusca", "quindis", "rhonce", "pelorat", "egat", "allemor", "ornat", "morvit", "nuntis", "curabit")
_FILLER_INSIDE = ("asdf", "qwer", "tk", "goes")
_FILLER_STARTS = ("test", "xx", "todo", "insert", "add", "enter", "place", "put", "sample", "dummy", "aquí", "texto", "hier", "beispieltext", "blindtext", "platzhalter", "texte", "ici", "votre", "aqui", "пример", "здесь", "текст", "此处", "在此", "示例文本", "ここに", "サンプルテキスト")
#: The first words of the messages that begin in ASCII.
_BEGINNINGS = frozenset(
    """error http oops sorry whoops the page article file document resource access you too slow an internal fatal parse runtime uncaught syntax traceback warning bad service site website gateway connection request this your redirect redirecting redirected loading please if enable turn switch activate allow javascript java our we checking verify confirm prove complete solve are i'm i’m update try
    erreur la pour veuillez activez votre diese die seite bitte zugriff interner serverfehler fehler ihre ihr por active habilite acceso su a ative ativar acesso erro""".split()
)
#: Lines of at most so many characters are remembered, as they may come again.
MESSAGE_CHARS = 220
#: Letters with the marks over and under them, which are no letters to ``re``; and scripts that put no blanks between words.
_MARKS = "\u0300-\u036f\u064b-\u065f\u0670\u0900-\u0903\u093a-\u094f\u0962\u0963\u0981-\u0983\u09bc-\u09cd\u0b82\u0bbe-\u0bcd\u0e31\u0e34-\u0e3a\u0e47-\u0e4e\u0eb1-\u0ebc\u0ec8-\u0ece\u102b-\u103e\u17b4-\u17d3"
_UNSPACED_CHARS = "\u0e01-\u0e30\u0e32\u0e33\u0e40-\u0e46\u0e81-\u0eb0\u0ec0-\u0ec6\u1000-\u102a\u1780-\u17b3\u3041-\u3096\u30a1-\u30fa\u30fc\u3400-\u4dbf\u4e00-\u9fff"
_WORDS = re.compile(rf"(?:[^\W\d_{_UNSPACED_CHARS}]|[{_MARKS}]){{4,}}")
_UNSPACED = re.compile(rf"(?:[{_UNSPACED_CHARS}][{_MARKS}]*)+")
#: A body says something from so many words, or characters of scripts without blanks; of these, so many in a row are a word in common.
LEAST_WORDS, LEAST_CHARS, GRAM = 3, 8, 4


def shows_field(line: str) -> bool:
    """Whether a line shows an unfilled field or value, outside sentences that speak about one."""
    if _FIELD_HINT.search(line):
        for m in _FIELD.finditer(line):
            if not _reported(line, m.start(), m.end()):
                return True
    if any(h in line for h in _VALUE_HINT):
        for m in _VALUE.finditer(line):
            around = line[max(0, m.start() - 40) : m.end() + 40]
            if "undefined function" in around and not line.lstrip().startswith(("Fatal", "PHP")):
                continue
            if not _ABOUT_VALUE.search(around) and not re.search(r"[“\"«'‘]\s*$", line[: m.start()]):
                return True
    return False


def _reported(line: str, begin: int, end: int) -> bool:
    """The words around name the field as a field, or quote it."""
    return bool(_REPORTS.search(line[max(0, begin - 40) : begin].rstrip() + " ")) or bool(_REPORTS.search(line[max(0, begin - 40) : begin].rstrip()))


def shows_message(line: str) -> bool:
    """Whether a whole line is filler or a message of a server, script or browser check."""
    low = line.strip()
    if _shows_filler(low):
        return True
    return _is_message(low)


def _is_message(line: str) -> bool:
    return bool(_MESSAGE.match(line)) and not _HARMLESS.match(line)


def _shows_filler(line: str) -> bool:
    low = line.lower()
    if (low.startswith(_FILLER_STARTS) or any([h in low for h in _FILLER_INSIDE])) and _FILLER_LINE.match(line):
        return True
    if not any([h in low for h in _FILLER_STEMS]):
        return False
    words = low.count(" ") + 1
    return words >= 5 and len(_FILLER.findall(low)) * 2 >= words


def shows_residue(text: str, title: str | None, publisher: str | None = None) -> bool:
    """Whether one place of a record's text or title is residue."""
    if title and title.strip():
        for t in {title.strip(), bare_title(title, publisher)}:
            if _TITLES.match(t) or shows_message(t) or shows_field(t):
                return True
    fields = any([h in text for h in _FIELD_SIGNS]) or any([h in text for h in _VALUE_HINT])
    low = text.lower()
    filler = [h for h in (*_FILLER_STEMS, *_FILLER_INSIDE) if h in low]
    activate = "activez" in low
    for line, lowered in zip(text.split("\n"), low.split("\n")):
        n = len(line)
        if n < 3:
            continue
        if fields and shows_field(line):
            return True
        bare = lowered.lstrip()
        if (bare.startswith(_FILLER_STARTS) or filler and any([h in lowered for h in filler])) and _shows_filler(line.strip()):
            return True
        if (_may_begin(bare) or activate and "activez" in lowered) and (_message(line) if n <= MESSAGE_CHARS else _is_message(line.strip())):
            return True
    return False


def _may_begin(low: str) -> bool:
    """Whether the first word of a line in lower case begins messages."""
    first = low[:60].split(None, 1)
    if not first:
        return False
    word = first[0].rstrip(".,!:;…")
    return not word.isascii() or word in _BEGINNINGS or word[:3].isdigit() or word.endswith(("error", "exception")) or len(first[0]) >= 60


@functools.lru_cache(maxsize=65_536)
def _message(line: str) -> bool:
    return _is_message(line.strip())


def _grams(text: str) -> set[str]:
    """Runs of GRAM characters in scripts without blanks between words."""
    return {m[i : i + GRAM] for m in _UNSPACED.findall(text) for i in range(len(m) - GRAM + 1)}


def low_information(text: str, labels: list[bool | None], title: str | None, url: str | None, publisher: str | None) -> list[int] | None:
    """Digests of the keys of a page's content lines, if these are few and meet neither title nor address; else None."""
    core, size = [], 0
    for line, content in zip(text.split("\n"), labels):
        if content:
            size += len(line.strip())
            if size > LOW_INFORMATION:
                return None
            core.append(key_of(line.strip(), publisher))
    body = "\n".join(core)
    words = set(_WORDS.findall(body))
    if len(words) < LEAST_WORDS and sum(map(len, _UNSPACED.findall(body))) < LEAST_CHARS:
        return None
    about = (title or "") + " " + re.sub(r"^https?://[^/]*", "", url or "")
    known = {w.lower() for w in _WORDS.findall(about)}
    if words & known or _grams(body) & _grams(about):
        return None
    return sorted({d - (1 << 64) if d >= 1 << 63 else d for d in map(digest, core)})


def examine(pages: DataFrame, keys: list[str], furniture: Furniture) -> DataFrame:
    """``keys, address, line_nos, residue, low`` of the records (``text, title, url, publisher``) that show something: the lines that are
    no content, whether a detector found residue, and ``low_information``. One pass, written once."""
    pages = prepared(pages, keys, furniture)

    def scan(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in pdfs:
            lines, low, residue = [], [], []
            for text, title, url, publisher, cell in zip(pdf["text"], pdf["title"], pdf["url"], pdf["publisher"], pdf["own"]):
                residue.append(shows_residue(text, title, publisher))
                labels = label_lines(text, title, url, publisher, furniture, own_keys(cell))
                lines.append([i for i, x in enumerate(labels) if x is False])
                low.append(low_information(text, labels, title, url, publisher))
            yield pdf[keys].assign(address=pdf["url"], line_nos=lines, residue=residue, low=low)

    schema = ", ".join(f"`{k}` {pages.schema[k].dataType.simpleString()}" for k in keys) + ", address string, line_nos array<int>, residue boolean, low array<bigint>"
    return materialize(pages.mapInPandas(scan, schema).where("size(line_nos) > 0 OR residue OR low IS NOT NULL"), "examined")


def responses(examined: DataFrame, furniture: Furniture) -> DataFrame:
    """Host evidence: digests ``h`` of lines that low-information bodies of several addresses have in common, and that no more pages with a text
    have; and those of bodies that detectors found, if only two addresses give them out. Joined by shuffles, as nothing bounds them."""
    rows = examined.where("low IS NOT NULL").select(F.explode("low").alias("h"), F.xxhash64("address").alias("u"), "residue")
    given = rows.groupBy("h", "u").agg(F.max("residue").alias("r")).groupBy("h").agg(F.count("*").alias("n"), F.max("r").alias("r"))
    given = given.where((F.col("n") >= LEAST_ADDRESSES) | F.col("r") & (F.col("n") >= 2))
    if furniture.line_pages is None:
        return given.select("h")
    return given.join(furniture.line_pages, "h", "left").where(F.coalesce("pages", F.lit(0)) <= F.col("n")).select("h")


def find_residue(pages: DataFrame, keys: list[str], furniture: Furniture | None = None) -> DataFrame:
    """``keys`` of the records with residue, each once."""
    taught = furniture or learn(pages)
    return residue_cases(examine(pages, keys, taught), keys, taught)


def residue_cases(examined: DataFrame, keys: list[str], furniture: Furniture) -> DataFrame:
    """``keys`` of the records with residue: low-information bodies that host evidence tells, and what detectors found; each once."""
    low = examined.where("low IS NOT NULL").select(*keys, F.size("low").alias("of"), F.xxhash64("low").alias("body"), F.explode("low").alias("h"))
    shared = low.distinct().join(responses(examined, furniture), "h", "left_semi")
    doubled = shared.groupBy(*keys, "body", "of").count().where(F.col("count") * 2 >= F.col("of")).select(*keys)  # half of the body's lines
    return doubled.unionByName(examined.where("residue").select(*keys)).distinct()
