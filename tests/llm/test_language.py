import random
import re
from collections import Counter

import pytest

from spanloom.llm import mojibake, sentences

SAMPLES = ["El índice salarial de Peñalisa bajó según el acta.", "Die Brückenmaut in Großlinden wurde geändert.", "Le péage du pont a été modifié à Brécourt – c’est faux.", "«Мы ничего не подписывали», — заявил Ванторин.", "据水务管理局称，噪声规划涉及户家庭。", "“We have not seen it,” said Zoë – twice."]


@pytest.fixture(scope="module")
def values(spark):
    rng = random.Random(7)
    rows = [" ".join(rng.choice(SAMPLES) for _ in range(6)) for _ in range(400)]
    return spark.createDataFrame([(i, t, "x") for i, t in enumerate(rows)], "id int, v string, restored string")


@pytest.fixture(scope="module")
def stats(values):
    return mojibake.associations(values, "v")


@pytest.mark.parametrize("encoding", ["cp1252", "latin-1", "cp437", "cp850", "mac_roman"])
@pytest.mark.parametrize("sample", SAMPLES[:3] + SAMPLES[5:])
def test_restores_utf8_read_as_something_else(stats, encoding, sample):
    wrong = "".join(bytes([b]).decode(encoding, "replace") if encoding != "cp1252" or b not in (0x81, 0x8D, 0x8F, 0x90, 0x9D) else chr(b) for b in sample.encode())
    assert mojibake.repair("Fine words before. " + wrong, stats) == (True, "Fine words before. " + sample)


def test_restores_twice_wrong_and_other_scripts(stats):
    twice = "café".encode().decode("cp1252").encode().decode("cp1252")
    assert mojibake.repair(f"It was {twice} time", stats) == (True, "It was café time")
    assert mojibake.repair(SAMPLES[3].encode("cp1251").decode("latin-1"), stats)[0]


def test_sound_and_lost(stats):
    for sample in SAMPLES + ["", None, "plain", "CAFÉ» À «", "SÃO FALSAS", "𝗦𝗛𝗔𝗥𝗘 é̂ 🚨", "Ünü è"]:
        assert mojibake.repair(sample, stats) == (False, None), sample
    assert mojibake.repair("The caf� was shut", stats) == (True, None)
    assert mojibake.repair("The text was cut he�", stats) == (False, None)
    assert mojibake.repair("The text was cut he�", stats, may_be_cut=False) == (True, None)
    assert mojibake.repair("x" * 300_000 + " cafÃ© " + "y" * 300_000, stats)[0]


def test_repair_values_over_rows(spark, values, stats):
    df = spark.createDataFrame([(1, "cafÃ©", "c"), (1, "cafÃ©", "c"), (2, None, "c"), (3, "", "c"), (4, "fine", "c")], "id int, v string, restored string")
    assert [(r["id"], r["restored"]) for r in mojibake.repair_values(df, ["id"], "v", stats).collect()] == [(1, "café"), (1, "café")]
    assert mojibake.repair_values(df.limit(0), ["id"], "v").count() == 0


def test_copies_of_one_value_change_nothing(spark):
    rows = ["Der Fluß ist über die Ufer getreten, sagte Jürgen Größer.", "費用は52億円から85億円に増えた。調査は続いている。", "据水务管理局称,医院合并涉及799户家庭。几周后,调查仍在进行。", "Стоимость выросла, как сообщили в ведомстве."]
    few = [r for r in rows for _ in range(40)]
    sound, skewed = (mojibake.associations(spark.createDataFrame([(v,) for v in few + [rows[3]] * n], "v string"), "v") for n in (0, 4000))
    assert not [v for v in rows if mojibake.repair(v, skewed)[0]]
    garbled = "Der FluÃŸ ist Ã¼ber die Ufer getreten, sagte JÃ¼rgen."
    assert mojibake.repair(garbled, sound) == mojibake.repair(garbled, skewed) == (True, "Der Fluß ist über die Ufer getreten, sagte Jürgen.")


@pytest.fixture(scope="module")
def learned(spark):
    rng = random.Random(8)
    names = ["Marrow", "Quindry", "Vantor", "Ellery", "Hessel", "Orban"]
    make = [
        lambda: f"Dr. {rng.choice(names)} met Mt. {rng.choice(names)} Grain Co. twice.", lambda: f"See No. {rng.randrange(30)} and Fig. {rng.randrange(9)} in the annex.", lambda: f"The office spent ${rng.randrange(9)}.{rng.randrange(9)} million, i.e. more than planned.", lambda: f"Prof. J. R. {rng.choice(names)} said so at {rng.randrange(12)} p.m. that day.",
        lambda: "Is it true? Nobody knows.", lambda: f"They relied on approx. {rng.randrange(99)} wells, e.g. in the north.", lambda: "Critics deny it.", lambda: f"It was signed with {rng.choice(names)} Holdings Ltd. The memos were late.", lambda: f"In {rng.choice(names)}, officials met Grain Co. In the end they left.",
    ]
    rows = [(i, " ".join(rng.choice(make)() for _ in range(8)), "en", 0) for i in range(400)]
    thai = ["การตรวจสอบยังดำเนินอยู่ในเวนมัวร์", "ข้อความเรื่องค่าน้ำถูกแชร์หลายครั้งแล้ว", "ไม่มีหลักฐานว่าสถาบันดินยกเลิกค่าน้ำ"]
    rows += [(1000 + i, " ".join(rng.choice(thai) for _ in range(6)), "th", 0) for i in range(40)]
    return sentences.learn(spark.createDataFrame(rows, "doc_id bigint, text string, lang string, start_off int"))


@pytest.mark.parametrize("parts", [
    ["Dr. Marrow met Mt. Hessel Grain Co. twice.", "See No. 12 and Fig. 3 in the annex."], ["It was signed with Vantor Holdings Ltd.", "The memos were late."], ["Prof. J. R. Ellery said so at 8 p.m. that day.", "Nobody knows."], ["The ratio fell to 3.14 in 2012.", "It rose."], ["“Who approved this? Nobody asked us,” said Marrow.", "It rose."],
    ["“It is safe!” read a banner outside.", "It rose."], ["A reviewer wrote: “The drawings were late.”", "It rose."], ["It fell (see the note. It is short) again.", "It rose!", "Is it true?", "No."], ["The list covers e.g. the north, i.e. more."], ["Despite that… it went on.", "It rose."],
    ["这是不实消息！", "柯凡娜女士补充道:“数字只是初步结果。”", "“我们没有签署任何文件。”万托博士在塔桥镇说。", "调查仍在进行……目前没有结论。"], ["ヴァントル博士は「数字は暫定だ。」と付け加えた。", "これは誤りだ！"], ["जाँच अभी जारी है।", "प्रो. वैंटर ने कहा, “हमने कुछ नहीं किया।”", "यह गलत है!"],
    ["«¿Quién lo aprobó? Nadie nos preguntó», dijo Ilse.", "¡No hay pruebas!", "¿Es cierto?"], ["„Wir haben nichts unterschrieben“, sagte er.", "Das ist falsch!"], ["Marrow holds a Ph.D. in law.", "iNorvale, the app, fell.", "It rose."], ["See https://x.example/a.b?c=D.", "It rose."],
])
def test_units(learned, parts):
    cjk = any("぀" <= c <= "鿿" for c in parts[0])
    for gap in ["" if cjk else " ", "  ", "\n", "\r\n"]:
        text = gap.join(parts)
        a, b = sentences.units(text, learned)
        assert [text[x:y] for x, y in zip(a, b)] == parts, gap


def test_missing_space_and_lines(learned):
    text = "The memos were late.The office spent more.\n- An entry, Inc. of 2012\n1. First thing\n\n  Heading \xa0"
    a, b = sentences.units(text, learned)
    assert [text[x:y] for x, y in zip(a, b)] == ["The memos were late.", "The office spent more.", "- An entry, Inc. of 2012", "1. First thing", "Heading"]


def test_thai_clauses(learned):
    one, two = "การตรวจสอบยังดำเนินอยู่ในเวนมัวร์", "ข้อความเรื่องค่าน้ำถูกแชร์หลายครั้งแล้ว"
    for gap in (" ", "  ", ""):
        text = one + gap + two
        a, b = sentences.units(text, learned)
        assert [text[x:y] for x, y in zip(a, b)] == [one, two]


def test_every_character_is_in_one_unit(learned):
    rng = random.Random(9)
    for _ in range(300):
        text = "".join(rng.choice("aB.!? \n“”«»()…。，「」 กา1,:;-é\U0001f600") for _ in range(rng.randrange(60)))
        a, b = sentences.units(text, learned)
        covered = "".join(text[x:y] for x, y in zip(a, b))
        assert "".join(covered.split()) == "".join(text.split())
        assert all(x < y and text[x:y] == text[x:y].strip() for x, y in zip(a, b)) and all(p <= q for p, q in zip(b, a[1:]))


def test_units_of_rows(spark, learned):
    df = spark.createDataFrame([(1, "One. Two.", "en", 0), (2, None, None, 0), (3, "", "XX", 0), (4, " \n ", "en", 0), (1, "One. Two.", "en", 0), (5, "Long one here. " * 20000, "en", 0)], "doc_id bigint, text string, lang string, end_off int")
    got = sentences.sentence_units(df, stats=learned).groupBy("doc_id").count().collect()
    assert {r["doc_id"]: r["count"] for r in got} == {1: 4, 5: 20000}
    assert sentences.sentence_units(df.limit(0)).count() == 0


def test_statistics_are_kept_per_language_with_collocations(spark):
    rng = random.Random(10)
    names = ["Marrow", "Quindry", "Vantor", "Ellery"]
    english = [lambda: f"See No. {rng.randrange(30)} in the annex of the office.", lambda: "The office of the town said that it was so.", lambda: f"It was written by {rng.choice(names)} in the town.", lambda: f"They went to Ft. Hessel and to the {rng.choice(names)} office.", lambda: f"It was the office of the Ft. {rng.choice(names)} town.", lambda: "Is it so? The town said it was."]
    spanish = [lambda: "El acta de la ciudad dice que no.", lambda: "La ciudad no pagó el agua de la obra.", lambda: f"El alcalde {rng.choice(names)} dijo en la ciudad que no.", lambda: "¿Es cierto? La ciudad dice que no lo es."]
    german = [lambda: f"Die Stadt hat am {rng.randrange(1, 29)}. Oktober den Bau und die Maut geprüft.", lambda: "Die Maut und der Bau sind in der Stadt.", lambda: f"Ab {rng.randrange(1, 29)}. Oktober gilt die Maut in der Stadt."]
    rows = [(3 * i + k, "\n".join(" ".join(rng.choice(make)() for _ in range(3)) for _ in range(3)), lang, 0) for i in range(200) for k, (lang, make) in enumerate((("en", english), ("es-ES", spanish), ("de", german)))]
    own = sentences.learn(spark.createDataFrame(rows, "doc_id bigint, text string, lang string, start_off int"))
    assert "no" in own.languages["en"].abbreviations and "no" not in own.languages["es"].abbreviations
    assert "The" in own.languages["en"].starters and not set(names) & own.languages["en"].starters

    def cut(text, tag):
        a, b = sentences.units(text, own, tag)
        return [text[x:y] for x, y in zip(a, b)]

    spanish_text = ["El alcalde de la ciudad dice que no.", "El acta no lo dice."]
    for tag in ("es", "ES-mx", None, "en"):  # the text's words tell the language where the tag doesn't
        assert cut(" ".join(spanish_text), tag) == spanish_text
    assert cut("See No. 12 and the office.", "en") == ["See No. 12 and the office."]
    assert ("0", "Oktober") in own.languages["de"].collocations and cut("Die Sitzung war der 3. Oktober und die Maut.", None) == ["Die Sitzung war der 3. Oktober und die Maut."]
    assert cut("Die Stadt und die Maut bis Montag, 3. Oktober und so.", "de") == ["Die Stadt und die Maut bis Montag, 3. Oktober und so."]
    assert ("ft", "Hessel") in own.languages["en"].collocations
    assert sentences._association(10, 10, 1, 100) == 0 and sentences._association(10, 10, 9, 1000) > sentences.COLLOCATION_SCORE


def test_all_of_a_text_tells_its_language():
    own = {x: sentences.Statistics(frozenset({x})) for x in ("en", "de")}
    stats = sentences.Statistics()
    stats.languages, stats.common = own, {"the": ("en",), "of": ("en",), "und": ("de",), "die": ("de",)}
    text = "the list of the names of " * 20 + "die Stadt und die Leute und die Stadt " * 100
    assert stats.of(text, None) is own["de"] and stats.of(text, "en") is own["de"] and stats.of("the town of the", None) is own["en"]


def test_each_piece_is_read_once_and_periods_inside_clauses_never(monkeypatch):
    read, token = [], sentences._TOKEN

    class Reader:
        def findall(self, text):
            read.append(text)
            return token.findall(text)

    monkeypatch.setattr(sentences, "_TOKEN", Reader())
    stats = sentences.Statistics()
    stats.languages, stats.common = {x: sentences.Statistics(frozenset({x})) for x in ("en", "de")}, {"the": ("en",), "die": ("de",), "in": ("de", "en")}
    for _ in range(3):
        assert stats.of("the town (the mill) in the fog, " * 50, "de") is stats.languages["en"]
    assert sorted(read) == sorted({"the", "town", "(the", "mill)", "in", "fog,"})
    asked, decide = [], sentences._begins_new
    monkeypatch.setattr(sentences, "_begins_new", lambda line, at, *more: asked.append(at) or decide(line, at, *more))
    text = "It rose by 3.5 points, approx. twice, at a.b in Köln, i.e. über das ganze Land. It fell."
    a, b = sentences.units(text, stats)
    assert [text[x:y] for x, y in zip(a, b)] == [text[:-9], "It fell."] and asked == [text.index(". It")]


def test_language_and_counts_are_those_of_all_tokens(spark):
    rng = random.Random(11)
    common = {"the": ("en",), "l'eau": ("fr",), "de": ("es", "fr"), "la": ("es", "fr"), "und": ("de",)}
    stats = sentences.Statistics()
    stats.languages, stats.common = {x: sentences.Statistics(frozenset({x})) for x in ("de", "en", "es", "fr")}, common
    parts = ["the", "The", "(the", "the—the,", "l'eau", "l’eau", "de", "de.", "la", "und/und", "3und", "Dr.", "e.g.", "水务管理局称医院合并涉及户家庭", "\x1f", "\xa0", "\n", "la!\n«La", "? Und", "x" * 60, "approximately. So", "abcdefgh. On", "5. Mai", "(12. Mai"]
    rows = []
    for i in range(300):
        text = rng.choice(["", " "]).join(rng.choice(parts) for _ in range(rng.randrange(30)))
        tag = rng.choice(["en", "fr-CA", None, "zz"])
        seen = Counter(x for w in sentences._TOKEN.findall(text) for x in common.get(w, ()))
        lang = sentences.language_of(tag)
        if seen and max(seen.values()) >= seen[lang] + 3:
            lang = min(x for x, n in seen.items() if n == max(seen.values()))
        assert stats.of(text, tag) is stats.languages.get(lang, stats), text
        rows.append((i, text, tag))
    tokens = Counter((0, sentences.language_of(tag), w, "") for _, text, tag in rows for w in sentences._TOKEN.findall(text))
    start = re.compile(r"(?:^[ \t\xa0]*|[!?]\s+)[“\"«„¿¡(]*([^\W\d_]+)", re.M)
    tokens.update((1, sentences.language_of(tag), w, "") for _, text, tag in rows for w in start.findall(text))
    got = sentences.count_tokens(spark.createDataFrame(rows, "doc_id int, text string, lang string")).where("kind < 2").collect()
    assert {(r["kind"], r["lang"], r["a"], r["b"]): r["n"] for r in got} == tokens
    assert [x[0] for x in sentences.dotted_words("abcdefgh. On approximately. So e.g. a (No. 5), (12. Mai 5. Mai\nabcd. x")] == ["abcdefgh", "g", "No", "0", "0", "abcd"]
