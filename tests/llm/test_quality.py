import random

import numpy as np

from strandmill.llm.quality import FAR, STATS, Fit, document_statistics, kind_of, spoken_lines, text_quality, text_statistics

DDL = "doc_id long, lang string, text string, language string, kind string, n_words int"
EN = ["the", "a", "and", "to", "of", "you", "it", "was", "we", "not"]


def talk(rng, cues=25):
    out = []
    for i in range(cues):
        words = [rng.choice(EN if rng.random() < 0.35 else ["harbour", "lamp", "waits", "again", "brother", "night", "letter", "never", "came", "back"]) for _ in range(rng.randrange(4, 10))]
        out.append(f"{i + 1}\n00:00:{i:02d},100 --> 00:00:{i:02d},900\n{' '.join(words).capitalize()}{rng.choice(['.', '!', '?', '.', ','])}\n")
    return "\n".join(out)


def test_lines_without_cues():
    assert spoken_lines("﻿1\r\n00:00:01,000 --> 00:00:02,000\r\n<i>Yes.</i>\r\n\r\n") == ["Yes."]
    assert spoken_lines("WEBVTT\n\n00:01.000 --> 00:02.000\n- No.\n") == ["- No."]
    assert spoken_lines("{12}{40}One|Two") == ["One", "Two"]
    assert spoken_lines("3 [00:00:01.2 - 00:00:03.4] One / two") == ["One", "two"]
    assert spoken_lines("| 1 | 2 |\n\n7\n") == ["| 1 | 2 |"]


def test_statistics_of_odd_texts():
    known = {"en": frozenset(EN)}
    for t in ("", "\n", "7\n", "...", "\U0001f600", "a" * 200_000, "x " * 50_000):
        lang, _, _, stats = text_statistics(t, known)
        assert len(stats) == len(STATS) and np.isfinite(stats).all()
    assert text_statistics("The dog and you.", known)[0] == "en" and text_statistics("Der Hund", known)[0] is None
    assert text_statistics("anything", {})[0] is None


def test_contributions_add_up():
    rng = np.random.default_rng(0)
    a = rng.normal(size=(10, len(STATS)))
    fit = Fit(np.zeros(len(STATS)), np.linalg.inv(np.cov(rng.normal(size=(len(STATS), 500)))))
    parts = fit.contributions(a)
    assert np.allclose(parts.sum(1), np.einsum("ij,jk,ik->i", a, fit.precision, a))


def test_kinds():
    x = dict.fromkeys(STATS, 0.0)
    assert kind_of(FAR, x) is None and kind_of(float("nan"), x) is None
    assert kind_of(FAR + 1, x) == "list" and kind_of(FAR + 1, x | {"symbol_ratio": 0.5}) == "junk" and kind_of(FAR + 1, x | {"delimited_lines": 0.9, "symbol_ratio": 0.5}) == "table"


def test_planted_documents_come_out(spark):
    rng = random.Random(2)
    rows = [(i, rng.choice(["en", "EN", "en-GB", None, "und"]), talk(rng)) for i in range(200)]
    junk = "\n".join("".join(rng.choice("bcdfghjkl") for _ in range(9)) + " " + "".join(rng.choice("qwrtzpsd") for _ in range(12)) for _ in range(30))
    table = "\n".join(f"| {i} | 00:00:{i:02d}.123 | Harrow | {i * 3.5} |" for i in range(30))
    names = "\n".join(f"{i}. lamp, harbour" for i in range(1, 31))
    rows += [(1001, "en", junk), (1002, None, table), (1003, "en", names), (1004, "en", None), (1005, "en", ""), (1006, "en", " \n "), (1007, "fr", "?!" * 60_000)]
    words = spark.createDataFrame([("en", w) for w in EN] + [("en", "The"), (None, "x"), ("en", None)], "lang string, word string")
    df = spark.createDataFrame([(*r, "q", "z", 3) for r in rows], DDL)
    stats, far = text_quality(df, words)
    assert stats.count() == 204
    got = {r.doc_id: r for r in far.collect()}
    assert {d: r.kind for d, r in got.items() if r.kind} == {1001: "junk", 1002: "table", 1003: "list", 1007: "junk"}
    assert all(abs(sum(r.contributions.values()) - r.distance) <= 1e-6 * max(1, abs(r.distance)) for r in got.values())
    stats, far = text_quality(df.limit(0), words)
    assert stats.collect() == [] and far.collect() == []
    _, far = text_quality(df, words.limit(0))
    assert far.count() == 204


def test_a_long_list_of_words_in_blocks(spark, data):
    documents, words = (spark.read.parquet(f"{data}/{t}.parquet") for t in ("documents", "common_words"))
    documents = documents.unionByName(documents.limit(3))
    one = sorted(map(str, document_statistics(documents, words).collect()))
    assert one == sorted(map(str, document_statistics(documents, words, word_block=40).collect())) and one
