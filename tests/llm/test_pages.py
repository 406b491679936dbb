import random

import pytest
from pyspark.sql import functions as F

from spanloom.llm import boilerplate, furniture, residue, stuffing, truncation
from spanloom.llm.lines import furniture_kind, is_menu, key_of, shape_of

SCHEMA = "case_id string, document_id string, text string, title string, url string, publisher string, line_no int, is_cut int"
PROSE = "The council met on Monday and heard that the harbour plan would cost four million more than was said. "


def pages(spark, rows):
    return spark.createDataFrame([("c", f"d{i}", *r, 0, 0) for i, r in enumerate(rows)], SCHEMA)


NOTICE = "By staying on these pages readers take note that records of each visit are kept for as long as the house rules of the publisher, which hang in its reading room and may be looked up there on working days, lay down for such records; nothing here asks for more than a nod."


def prose(seed):
    rng = random.Random(seed)
    words = ["harbour", "council", "ledger", "ferry", "meadow", "signal", "copper", "tariff", "permit", "orchard", "summit", "quarry"]
    return " ".join(f"{rng.choice(words).title()} {rng.choice(words)} {rng.choice(words)}s saw the {rng.choice(words)} of {rng.choice(words)}." for _ in range(6))


def page(i, publisher="Bay Courier"):
    title = f"Topic{i} in Bay: what we know"
    teasers = [f"Topic{i + k} in Bay: what we know" for k in range(1, 11)]
    said = [prose(3 * i + k) for k in range(3)]
    body = [said[0], "Background", "", said[1], "Our app brings this to your phone", said[2]]
    return "\n".join(["Home | About us | Contact", "* Search", title, "", *body, "Trending now", *teasers, prose(3 * i) + " In the end it stood.", NOTICE, f"© 20{i:02} {publisher}. All rights reserved.", "Back to top ↑", *["Jobs"][: i % 2]]), title


def rows_of(n, publisher="Bay Courier", site="bay"):
    return [(*page(i, publisher), f"https://{site}.example/{i}", publisher) for i in range(n)]


WANT = [0, 1, 8, *range(10, 21), 22, 23, 24]


def test_boilerplate(spark):
    rows = rows_of(30) + [(None, None, None, None), ("", "", "", ""), ("\n \n", "x", "y", "z")]
    rows.append(rows[0])
    df = pages(spark, rows)
    keys = ["case_id", "document_id"]
    got = {}
    for r in boilerplate.find_boilerplate(df.unionByName(df.limit(3)), keys).collect():
        got.setdefault(r["document_id"], []).append(r["line_no"])
    assert all(sorted(got[f"d{i}"]) == WANT + [25] * (i % 2) for i in range(30))
    assert not {"d30", "d31", "d32"} & set(got) and got["d33"] == got["d0"]
    main = {r["document_id"]: r["main"] for r in boilerplate.extract_main(df, keys).collect()}
    assert main["d0"].startswith("Topic0 in Bay") and main["d0"].endswith("stood.") and "Trending" not in main["d0"] and main["d30"] == ""
    assert boilerplate.find_boilerplate(df.limit(0), keys).count() == 0


def test_copies_of_a_page_change_nothing(spark):
    keys, rows = ["case_id", "document_id"], rows_of(30)
    own = lambda df: {(r["document_id"], r["line_no"]) for r in boilerplate.find_boilerplate(df, keys).collect() if int(r["document_id"][1:]) < 30}
    copied = pages(spark, rows + [("\n".join(prose(900 + k) for k in range(3)), "Topic in Bay", "https://bay.example/x", "Bay Courier")] * 400).coalesce(2)
    assert own(copied) == own(pages(spark, rows))


def test_site_keys_sent_or_joined_are_the_same(spark):
    df = pages(spark, rows_of(20) + [(f"{t}\nBay rules apply", h, u.replace("bay", "cove"), None) for t, h, u, _ in rows_of(12, "Cove Post")])
    sent, joined = furniture.learn(df), furniture.learn(df, broadcast_keys=0)
    assert sent.sites is None and joined.sites is not None and len(sent.site_keys[0]) == joined.sites.count() > 0
    keys = ["case_id", "document_id"]
    a, b = (sorted(map(tuple, boilerplate.find_boilerplate(df, keys, f).collect())) for f in (sent, joined))
    assert a == b and a


def test_without_surges_nothing_is_learned(spark):
    df = pages(spark, rows_of(20))
    assert furniture.learn(df).corpus and not furniture.learn(df, surge=1 << 40).corpus


def test_line_forms():
    assert is_menu("Home  About us  Contact") and is_menu("* Opinion") and not is_menu("The council met.")
    assert furniture_kind("© 2019 X. Alle Rechte vorbehalten.") == "furniture" and furniture_kind("Background") == "subhead" and furniture_kind("Lo más leído") == "head" and furniture_kind("What happened next was new") is None
    assert furniture_kind("SÃ\xadguenos") == "furniture"  # wrongly decoded
    assert key_of(" Page 12 of Bay Courier", "Bay Courier") == "page 0 of <p>" and key_of("Home  About us › Contact", None) == "home | about us | contact"
    assert shape_of("Old photo of Bay Town shared as new", {"old", "photo", "of", "shared", "as", "new"}) == "old photo of _ shared as new"


@pytest.mark.parametrize(("text", "title", "want"), [
    ("Good text.\nBy {{ author }}\n" + PROSE, None, True), (PROSE + "The wage undefined came up.", None, True), (PROSE, "<%= title %>", True), (PROSE, "404 Not Found", True), ("502 Bad Gateway", "Fine", True), ("Please enable JavaScript to view this page.", None, True), ("Lorem ipsum dolor sit amet dolor ipsum.", None, True),
    ("[[publish_date]]", None, True), ("Страница не найдена.", None, True), ("页面不存在或已被删除。", None, True), (PROSE + "\nTraceback (most recent call last):", None, True), ("xxxxxx xxxx xxxxx", None, True),
    ("The letter still carried the field {{first_name}}, which was taken as proof.", None, False), ("The template of the Board writes [DATE] where the clerk must enter the day.", None, False), ("“Access denied” was all she saw when asking.", None, False),
    ("Until May the page answered with “404 – page not found”, and the board blamed a moved folder.", None, False), ("The leaflet was padded with lorem ipsum, so the claim is false.", None, False), ("This browser can play the audio version of the page.", None, False), (PROSE, "Council in Bay", False), ("", None, False), ("[Share this chart]", "", False), (PROSE * 3000, None, False),
])
def test_residue(text, title, want):
    assert residue.shows_residue(text, title) is want


@pytest.mark.parametrize("line", [
    "Test. Test. Test.", "ASDF", "Qwerty", "XXX XXX", "words tk TK", "todo: write it", "Insert your text here", "Put copy here", "Headline goes here", "the CAPTION Goes Here", "Sample paragraph", "Dummy text", "Placeholder", "Aquí va el texto", "texto de exemplo", "Hier steht Ihr Text", "Hier steht etwas", "Blindtext", "Platzhalter", "Texte d'exemple", "Ici va le texte", "votre titre", "aqui vai o texto", "Пример текста", "Здесь будет текст", "此处插入内容", "示例文本", "ここに本文", "サンプルテキスト",
    "Consectetur adipiscing dapibus sollicitudin rhoncus curabitur viverra", "LOREM IPSUM DOLOR SIT AMET ELIT", "Ativar JavaScript", "Pour la suite, activez JavaScript", "Slow down and retry", "The resource you requested was not found", "Resource you requested has moved", "SomeException: value", 'File "a.py", line 3', "Warning: bad thing on line 3", "Connection timed out", "Request time-out", "Service is down", "Solve the challenge", "Complete the action", "Vérification de votre navigateur", "Access denied", "Loading...", "Oops! Something went wrong", "502 Bad Gateway", "Traceback (most recent call last):",
    "Internal server error occurred " + "while the page was made " * 12,
])
def test_every_alternative_passes_its_gate(line):
    assert residue.shows_residue(PROSE + "\n  " + line + "\n" + PROSE, None)


def test_unknown_responses_are_found_by_their_hosts(spark):
    answer = "Nothing can be shown today, kindly come back tomorrow"
    rows = [(answer, f"Harbour {w}", f"https://{w}.example/{w}", None) for w in ("plan", "tax", "fee", "toll")]
    rows += [("Harbour plan was dropped by the council, it said", "Harbour plan", "https://x.example/1", None), (None, None, None, None), ("", None, None, None), ("only here and nowhere else today", "Tax", "https://y.example/2", None)]
    df = pages(spark, rows)
    got = {r["document_id"] for r in residue.find_residue(df.unionByName(df), ["case_id", "document_id"]).collect()}
    assert got == {"d0", "d1", "d2", "d3"}
    assert residue.find_residue(df.limit(0), ["case_id", "document_id"]).count() == 0


def test_cases_of_residue_give_no_rows_of_boilerplate(spark):
    answer, keys = "Nothing can be shown today, kindly come back tomorrow", ["case_id", "document_id"]
    # one with more than 4000 characters of learned furniture, the others with none
    rows = [("Home | About us | Contact\n" * 200 + answer, "Tax", "https://a.example/1", None)] + [(answer, f"Harbour {i}", f"https://b{i}.example/{i}", None) for i in range(3)]
    df = pages(spark, rows + rows_of(20))
    assert len(rows[0][0]) > 4000
    assert {r["document_id"] for r in residue.find_residue(df, keys).collect()} == {"d0", "d1", "d2", "d3"}
    assert {r["document_id"] for r in boilerplate.find_boilerplate(df, keys).collect()} == {f"d{i}" for i in range(4, 24)}


def test_host_evidence_beside_furniture_and_in_any_script(spark):
    answers = {"en": "Nothing can be shown today, kindly come back tomorrow", "zh": "暂时不能显示此内容请稍后再来", "th": "ขณะนี้ไม่สามารถแสดงเนื้อหานี้ได้", "hi": "अभी यह सामग्री दिखाई नहीं जा सकती"}
    rows = [("\n".join(["Home | About us | Contact", *["* Search"] * i, answer, NOTICE]), f"Tax {i}", f"https://{a}{i}.example/{i}", "Bay Courier") for a, answer in answers.items() for i in range(4)]
    rows += [("据水务管理局称收费标准没有变化", "据水务管理局称收费标准没有变化吗", f"https://w{i}.example/{i}", None) for i in range(4)]
    got = {r["document_id"] for r in residue.find_residue(pages(spark, rows + rows_of(20)), ["case_id", "document_id"]).collect()}
    assert got == {f"d{i}" for i in range(16)}


def test_stuffing(spark):
    rng = random.Random(5)
    words = [f"w{a}{b}n" for a in "abcdefghkl" for b in "aeiouyrst"]
    honest = [" ".join(" ".join(rng.choice(words) for _ in range(9)).capitalize() + "." for _ in range(rng.randrange(8, 20))) for _ in range(60)]
    roll = "\n".join(f"- {rng.choice(words)} {rng.choice(words)}, {1900 + i}" for i in range(40))
    spam = ["cheap loans, " * 90, "\n".join(f"https://x{i}.example/{rng.choice(words)}?aff={i}" for i in range(30)), " ".join(f"#{rng.choice(words)}deal" for _ in range(70)), "Buy loans here now. Our loans are the best loans as loans go. " * 20, "Home hub » Toll blog » Ferry forum » Tax links\n" * 12]
    texts = honest + [roll] + spam + [None, "", "   ", "short", "cheap loans, " * 200_000]
    df = spark.createDataFrame([(i, t, "x", 1.0) for i, t in enumerate(texts)], "doc_id bigint, text string, kind string, ratio double")
    got = {r["doc_id"] for r in stuffing.find_stuffed(df).collect()}
    at = len(honest) + 1
    assert got == set(range(at, at + len(spam))) | {len(texts) - 1}
    assert stuffing.find_stuffed(df.unionByName(df)).count() == len(got)  # once each
    assert stuffing.find_stuffed(df.limit(0)).count() == 0


def test_stuffing_beside_copies_of_one_page(spark):
    rng = random.Random(6)
    words = [f"w{a}{b}n" for a in "abcdefghkl" for b in "aeiouyrst"]
    honest = [" ".join(" ".join(rng.choice(words) for _ in range(9)).capitalize() + "." for _ in range(12)) for _ in range(60)]
    rolls = ["\n".join(f"- {rng.choice(words)} {rng.choice(words)}, {1900 + i}" for i in range(50)) for _ in range(3)]
    texts = honest + rolls + ["cheap loans, " * 70] + [honest[0]] * 300
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    assert {r["doc_id"] for r in stuffing.find_stuffed(df).collect()} == {63}


@pytest.fixture(scope="module")
def classifier(spark):
    rng = random.Random(6)
    words = "council harbour ferry budget report vote meeting mayor office plan road bridge school water tax claim reader figure archive letter".split()
    say = lambda: "The " + " ".join(rng.choice(words) for _ in range(rng.randrange(7, 14))) + "."
    rows = []
    for i in range(400):
        text = f"Report {i} on the {rng.choice(words)}\n\n" + "\n".join(" ".join(say() for _ in range(3)) for _ in range(3))
        text += rng.choice(["", "\n- Bay: 12", "\nBack to top ↑"])
        rows.append((text, f"Report {i} on the {rng.choice(words)}", "https://x.example", "Bay Courier"))
    return truncation.Classifier(pages(spark, rows).select("text", "title", "publisher")), say


def test_truncation(spark, classifier):
    own, say = classifier
    assert own.held_out > 0.93  # held-out artificial examples
    assert own.is_cut(say() + " " + say() + " The council vote on the har")
    assert own.is_cut(say() + " " + say() + " The mayor of the… [+120 chars]")
    assert not own.is_cut(say() + " " + say())
    assert not own.is_cut(say() + "\nBack to top ↑") and not own.is_cut(None) and not own.is_cut("") and not own.is_cut(" \n ")
    df = pages(spark, [(say() + " " + say() + " The council vote on the har", None, None, "A"), (None, None, None, None), (say() * 20000, None, None, "B")])
    got = truncation.score_records(df.unionByName(df), ["case_id", "document_id"], own).where("is_cut").select("document_id").distinct().collect()
    assert [r[0] for r in got] == ["d0"]
    assert truncation.TRACE.search("end… [+12 chars]") and truncation.TRACE.search("end […]") and not truncation.TRACE.search("the end.")


def test_form_of_an_entry_yields_to_a_high_score(classifier, monkeypatch):
    own, say = classifier
    text, rows = say() + "\n\nAccording to the annual drawings, Lucian Hintze", "\nMarnwick Harbour, Lucian Hintze\nBay Harbour, Ilse Quindry"
    for score, want in ((0.97, True), (0.7, False)):
        monkeypatch.setattr(own, "score", lambda _, score=score: score)
        assert own.is_cut(text) is want
        assert not own.is_cut(say() + rows)  # in a run of entries


def test_truncation_without_texts(spark):
    empty = pages(spark, [(None, None, None, None)]).where("text IS NOT NULL")
    own = truncation.Classifier(empty.select("text", "title", "publisher"))
    assert truncation.score_records(empty, ["case_id", "document_id"], own).count() == 0


def test_tags_are_searched_by_their_first_character():
    """The same tags as with a test of every branch at every place, in fewer seconds."""
    import re
    import time

    plain = re.compile(r"(?<!\w)#\w+|\bSKU\b[\s:#-]*\S+|[$€£]\s?\d+(?:[.,]\d+)?|\b(?:XS|XL|XXL)\b|\b[SML] (?=[a-z])")
    text = "#a b#c ##d SKU: 12 xSKU 1 SKUs SKU#-9 $5 $ 5.50 $x €7,2 XS XXL XL-1 aXL XLs S cotton S Cotton MS m L a#S b L  x _S y é#t XXS"
    rng = random.Random(5)
    texts = [text, *("".join(rng.choices("#SKUXML$€ a1:_é-.,\n", k=60)) for _ in range(3000))]
    assert all(stuffing._TAG.findall(t) == plain.findall(t) and stuffing._TAG.subn("|", t) == plain.subn("|", t) for t in texts)
    took = []
    for pattern in (stuffing._TAG, plain):
        began = time.process_time()
        for _ in range(5):
            pattern.subn("|", "words of a usual page without any mark " * 5000)
        took.append(time.process_time() - began)
    assert took[0] < 0.7 * took[1]
