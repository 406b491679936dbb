import os
import random

import pytest
from pyspark.sql import functions as F

from spanloom.llm import mix, pieces, tokens

VOCAB = tokens.vocabulary_path()
needs_vocabulary = pytest.mark.skipif(not os.path.exists(VOCAB), reason="no vocabulary")
ODD = ["", "a", "don't  stop", "<|endoftext|> as text", "日本語の文。", "naïve café \U0001f468‍\U0001f469‍\U0001f467", "x" * 30000, " \n\t\r\n ", "ሀ١٢٣ 　 ", "\U0001df25a1", "é́̂", "a\x85b\x1cc", "   lead", "1,234.50%"]


@needs_vocabulary
def test_ids_are_the_librarys(spark):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(VOCAB)
    library.encode_special_tokens = True
    rng = random.Random(1)
    texts = ODD + ["".join(rng.choice("ab é中\U0001f600'1 \n.,") for _ in range(rng.randrange(80))) for _ in range(200)]
    df = spark.createDataFrame([(i, t, 0, 0) for i, t in enumerate(texts)] + [(9999, None, 0, 0)], "doc_id bigint, text string, ids int, key int")
    got = {r["doc_id"]: r["ids"] for r in tokens.encode_corpus(df).collect()}
    assert got.pop(9999) == []
    assert all(got[i] == library.encode(t, add_special_tokens=False).ids for i, t in enumerate(texts))
    assert tokens.encode_corpus(df.limit(0)).count() == 0


@needs_vocabulary
def test_offsets_and_round_trip(spark):
    df = spark.createDataFrame(list(enumerate(ODD)), "doc_id bigint, text string")
    for r in tokens.encode_with_offsets(df).collect():
        text = ODD[r["doc_id"]]
        assert r["restored"] and len(r["ids"]) == len(r["starts"])
        if text:
            assert r["starts"][0] == 0 and r["ends"][-1] == len(text)
            assert all(b >= a and n >= a for a, b, n in zip(r["starts"], r["ends"], [*r["starts"][1:], len(text)]))
    back = tokens.decode_corpus(tokens.encode_corpus(df)).collect()
    assert {r["doc_id"]: r["text"] for r in back} == dict(enumerate(ODD))


def _pieces(spark, rows, limits=(("P", 100, 20),), **more):
    df = spark.createDataFrame(rows, "id int, layout string, text string, piece string")
    caps = spark.createDataFrame(list(limits), "layout string, max_chars int, overlap_chars int")
    out = {}
    for r in pieces.split_oversized(df, caps, ["id"], **more).orderBy("piece_no").collect():
        out.setdefault(r["id"], []).append(r)
    return out


def _check(text, got, limit, overlap):
    assert [r["piece_no"] for r in got] == list(range(len(got))) and got[0]["n_pieces"] == len(got)
    assert got[0]["start_off"] == 0 and got[-1]["end_off"] == len(text)
    assert all(r["piece"] == text[r["start_off"] : r["end_off"]] and len(r["piece"]) <= limit for r in got)
    assert all(a["end_off"] - b["start_off"] == overlap for a, b in zip(got, got[1:]))


def test_pieces_cover_within_limits_with_overlap(spark):
    rng = random.Random(2)
    prose = " ".join("".join(rng.choice("abcdefg") for _ in range(rng.randrange(1, 12))) + rng.choice(["", "", "", ".", ".\n\n"]) for _ in range(400))
    texts = {1: prose, 2: "x" * 950, 3: "é́" * 300, 4: "字" * 333, 5: "", 6: "a" * 100, 7: "a" * 101}
    got = _pieces(spark, [(k, "P", t, "clash") for k, t in texts.items()] + [(8, "P", None, None), (9, None, "y" * 500, None), (10, "Q", "y" * 500, None)])
    for k, t in texts.items():
        _check(t, got[k], 100, 20)
    assert 8 not in got and len(got[9]) == len(got[10]) == 1 and len(got[6]) == 1 and len(got[7]) == 2
    cuts = [r["end_off"] for r in got[1][:-1]]
    assert all(prose[c - 1].isspace() for c in cuts)


def test_spread_ranges_give_the_same_pieces(spark):
    rng = random.Random(3)
    text = " ".join("".join(rng.choice("abcdefg") for _ in range(rng.randrange(1, 12))) + rng.choice(["", "", ".", ".\n\n"]) for _ in range(3000))
    rows = [(1, "P", text, None), (2, "P", "z" * 9000, None)]
    one, spread = _pieces(spark, rows, range_chars=4096), _pieces(spark, rows, range_chars=4096, inline_chars=1000)
    assert [(r["start_off"], r["end_off"], r["piece"]) for k in (1, 2) for r in one[k]] == [(r["start_off"], r["end_off"], r["piece"]) for k in (1, 2) for r in spread[k]]


def test_repeated_rows_give_repeated_pieces_on_either_path(spark):
    text = "".join(f"Sentence number {i} of a long text. " for i in range(200))
    df = spark.createDataFrame([(1, text, "PROSE"), (1, text, "PROSE"), (2, text, "PROSE")], "k int, text string, layout string")
    limits = spark.createDataFrame([("PROSE", 900, 50)], "layout string, max_chars int, overlap_chars int")
    one, spread = (sorted(map(tuple, pieces.split_oversized(df, limits, ["k"], inline_chars=n, range_chars=1024).collect())) for n in (1 << 22, 100))
    assert one == spread and len(one) == 3 * len({r[1] for r in one})


def test_files_are_cut_by_byte_ranges(spark, tmp_path):
    rng = random.Random(4)
    text = " ".join("".join(rng.choice("aé字\U0001f600") for _ in range(rng.randrange(1, 9))) + rng.choice(["", ".", ".\n\n"]) for _ in range(4000))
    (tmp_path / "a.txt").write_text(text, encoding="utf-8", newline="")
    (tmp_path / "empty.txt").write_text("")
    got = pieces.split_files(spark, str(tmp_path), 500, 50, range_bytes=3001).orderBy("piece_no").collect()
    _check(text, got, 500, 50)


@needs_vocabulary
def test_mix_keeps_step_and_reports(spark):
    rows = [(i, f"word {i} " * (1 + i % 5), "big" if i % 3 else "small") for i in range(120)]
    rows += [(500, "", "big"), (501, None, "big"), (502, "lost", "other"), (503, "no source", None), (0, rows[0][1], rows[0][2])]
    documents = spark.createDataFrame(rows, "doc_id bigint, text string, source string").withColumn("h", F.lit(1)).withColumn("n_tokens", F.lit(1))
    targets = spark.createDataFrame([("big", 0.5, 2), ("small", 0.4, 1), ("none", 0.1, 3), ("off", 0.0, 3)], "source string, target_share double, max_repeats int")
    chosen = mix.mix(documents, targets, seed=1).collect()
    assert len({(r["doc_id"], r["round"]) for r in chosen}) == len(chosen) and {r["doc_id"] for r in chosen} <= set(range(120))
    total = sum(tokens.codec(VOCAB).encode(t).buffer_info()[1] for i, t, s in rows[:120])
    assert total - 60 <= sum(r["n_tokens"] for r in chosen) <= total
    report = {r["source"]: r for r in mix.mix_report(documents, targets, seed=1).collect()}
    assert report["none"]["shortfall_reason"] == "no documents" and report["small"]["shortfall_reason"] == "all documents used max_repeats times"
    few = {r["source"]: r for r in mix.mix_report(documents, targets, budget=total // 4, seed=1).collect()}
    assert few["big"]["reached_share"] / few["small"]["reached_share"] == pytest.approx(1.25, rel=0.15)
    # the front of the queue, as a plain walk finds it
    sizes = mix.document_sizes(documents, targets, 1)
    queue = sorted(mix.finish_times(sizes, targets).collect(), key=lambda r: (r["finish"], r["source"], r["round"], r["doc_id"]))
    want, left = [], total // 4
    for r in queue:
        if r["n_tokens"] > left:
            break
        left -= r["n_tokens"]
        want.append((r["doc_id"], r["round"]))
    assert [(r["doc_id"], r["round"]) for r in sorted(mix.mix(documents, targets, total // 4, 1).collect(), key=lambda r: (r["finish"], r["source"], r["round"], r["doc_id"]))] == want
    assert mix.mix(documents, targets, budget=0).count() == 0 and mix.mix(documents.limit(0), targets).count() == 0
