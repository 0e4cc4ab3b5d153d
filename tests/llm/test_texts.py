"""Problems 6, 7 and 8."""

from __future__ import annotations

import base64
import os
import random
import re
from collections import Counter
from pathlib import Path

import numpy as np
import pytest
import regex
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from vexalith.llm import leaks as L
from vexalith.llm import pii
from vexalith.llm.pii import identity_letter, luhn, mod97, personal_information, redacted, spans
from vexalith.llm.tokenize import PATTERN, TOKENIZERS, VOCABULARY, Encoder, model_of, read_ranks, token_ids

VOCAB = Path(TOKENIZERS) / f"{VOCABULARY}.tiktoken"
needs_vocabulary = pytest.mark.skipif(not VOCAB.exists(), reason="no vocabulary")


@pytest.fixture(scope="module")
def encoder():
    return Encoder(model_of(read_ranks(str(VOCAB))))


@pytest.fixture(scope="module")
def known():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, VOCAB.read_bytes().splitlines())}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


@needs_vocabulary
@settings(max_examples=200, deadline=None)
@given(st.text(st.characters(exclude_categories=["Cs"]), max_size=80))
def test_ids_are_those_of_the_vocabulary(encoder, known, text):
    ids = encoder.encode(text)
    assert ids == known.encode_ordinary(text)
    assert encoder.decode(ids) == text


@needs_vocabulary
def test_ids_of_rows(spark, known):
    texts = ["Hello  world\n", None, "", "<|endoftext|> don't", "Что? ♪ ﻿", "x" * 30_000, "Hello  world\n"]
    df = spark.createDataFrame([(i, t, 5) for i, t in enumerate(texts)], "doc_id long, text string, ids int")
    got = {r["doc_id"]: r["ids"] for r in token_ids(df).collect()}
    assert got == {i: known.encode_ordinary(t or "") for i, t in enumerate(texts)}
    assert token_ids(df.limit(0)).count() == 0
    assert regex.compile(PATTERN)


ITEM_A = "Every steep timbertunnel in Vestam carries 91 bronze wickumbrella marks, which means someone wired the old vectorbarrel beyond Jefost long ago"
ITEMS = [(1, ITEM_A)] + [(k, ITEM_A.replace("timbertunnel", f"t{k}").replace("Vestam", f"V{k}").replace("91", str(k)).replace("wickumbrella", f"u{k}").replace("wired", f"d{k}").replace("vectorbarrel", f"b{k}").replace("Jefost", f"J{k}")) for k in range(2, 9)]


USES = Counter(w for _, t in ITEMS for w in set(L.item_words(t)))
FIXED = np.sort(np.array([L.Coded()[w] for w, n in USES.items() if n >= 3], np.uint64))


def srt(text: str, words: int = 6) -> str:
    w = text.split()
    cues = [" ".join(w[i : i + words]) for i in range(0, len(w), words)]
    return "\n\n".join(f"{n}\n00:00:{n:02d},000 --> 00:00:{n + 1:02d},500\n{c}" for n, c in enumerate(cues, 1))


def test_leaks_are_found_in_damaged_cues(spark):
    w = ITEM_A.split()
    damaged = " ".join(x if i % 6 else "xx" + x for i, x in enumerate(w))
    rows = [
        (1, srt(ITEM_A)),
        (2, srt(ITEM_A.upper()).replace("\n\n3\n", "\n\n[door creaks]\n\n3\n")),
        (3, srt(damaged)),
        (4, srt(" ".join(w[:9]))),
        (5, srt(ITEMS[5][1].replace("t6", "other").replace("V6", "place").replace("u6", "thing").replace("b6", "item").replace("J6", "town").replace("d6", "did").replace("6", "77"))),
        (6, None),
        (7, ""),
        (8, "- " + ITEM_A.replace(" ", "\r\n")),
    ]
    docs = spark.createDataFrame([(*r, "clash", 3) for r in rows], "doc_id long, text string, passage_words string, item_id int")
    items = spark.createDataFrame([*ITEMS, (99, None), (98, "")], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in L.leaks(docs, items).collect()}
    assert got == {(1, 1), (2, 1), (3, 1), (8, 1)}
    assert L.leaks(docs.limit(0), items).count() == 0
    assert L.leaks(docs, items.limit(0)).count() == 0


@pytest.mark.parametrize("change", ["dropped", "damaged", "added"])
@pytest.mark.parametrize("at", [(3, 7, 11), (2, 6, 10), (4, 8, 12), (4, 9, 13)])
def test_passages_with_damage_at_every_fourth_or_fifth_word(change, at):
    """Fifteen words of an item with three errors: no window of five is left whole."""
    block = L.Items([i for i, _ in ITEMS], [t for _, t in ITEMS], FIXED)
    w = ITEM_A.split()[:15]
    w = [y for k, x in enumerate(w) for y in ([x] if k not in at else {"dropped": [], "damaged": ["xx" + x], "added": ["hm", x]}[change])]
    coded = L.Coded()
    h = np.array([coded[x] for x in L.spoken(srt(" ".join(w)))], np.uint64)
    assert [(d, block.ids[i]) for d, i, _ in L.leaked_pairs(h, np.array([0, len(h)]), block)] == [(0, 1)]


@pytest.mark.parametrize("size", [1, 2, 3, 8, 50_000])
def test_blocks_of_items_change_nothing(spark, monkeypatch, size):
    monkeypatch.setattr(L, "ITEMS", size)
    docs = spark.createDataFrame([(1, srt(ITEM_A)), (2, srt(ITEMS[3][1])), (3, srt(" ".join(ITEM_A.split()[:9])))], "doc_id long, text string")
    items = spark.createDataFrame([*ITEMS, ITEMS[0]], "item_id long, text string")
    assert {(r[0], r[1]) for r in L.leaks(docs, items).collect()} == {(1, 1), (2, 4)}


@pytest.mark.parametrize("n", [1, 2])
def test_a_single_item_leaks(spark, n):
    """Without words that several items use nothing is fixed: runs of three words find the passage."""
    w = ITEM_A.split()
    docs = spark.createDataFrame([(1, srt(ITEM_A)), (2, srt(" ".join(x if i % 6 else "xx" + x for i, x in enumerate(w)))), (3, srt(" ".join(w[:9])))], "doc_id long, text string")
    other = [(2, "Nothing of this second question stands anywhere in the documents that are searched here at all today")]
    items = spark.createDataFrame([(1, ITEM_A), *other][:n], "item_id long, text string")
    assert {(r[0], r[1]) for r in L.leaks(docs, items).collect()} == {(1, 1), (2, 1)}


def test_places_where_an_item_is_repeated_are_cut(spark):
    assert list(L.stretches(0, 100, 100)) == [(0, 100)]
    parts = list(L.stretches(0, 5000, 20))
    assert parts[-1][1] == 5000 and all(b[0] <= a[1] - L.PASSAGE * 1.3 for a, b in zip(parts, parts[1:])) and max(b - a for a, b in parts) < 250
    docs = spark.createDataFrame([(1, srt(" ".join(ITEM_A.split()[:9]) + " " + ITEM_A)), (2, srt(" ".join([" ".join(ITEM_A.split()[:9])] * 300))), (3, srt(" ".join([" ".join(ITEM_A.split()[:9])] * 300 + [ITEM_A])))], "doc_id long, text string")
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert {(r[0], r[1]) for r in L.leaks(docs, items).collect()} == {(1, 1), (3, 1)}


def test_torn_passages():
    half = [(k, k) for k in range(10)], [(k, 40 + k) for k in range(10, 20)]
    assert L.pieced([(0, half[0]), (60, half[1])], 0) == 20
    assert L.pieced([(0, half[0]), (600, half[1])], 0) == 10
    assert L.longest_passage([(0, 0), (1, 1), (9, 9)]) == 2


SPANS = [
    ("Contact: edith.lyndrmere@example.org", {("email", "edith.lyndrmere@example.org")}),
    ("Write to me at walter (at) example [dot] org.", {("email", "walter (at) example [dot] org")}),
    ("mail peter_x at mail dot driftpost dot test.", {("email", "peter_x at mail dot driftpost dot test")}),
    ("Meet me @ the bridge. Join @captions_subs now", set()),
    ("Call me on (617) 555-0110.", {("phone", "(617) 555-0110")}),
    ("Mon numéro : +33 1 99 00 34 34. Il part", {("phone", "+33 1 99 00 34 34")}),
    ("Dial l-3l2-555-Ol3O and ask", {("phone", "l-3l2-555-Ol3O")}),
    ("five-five-five, zero-one-one-six", {("phone", "five-five-five, zero-one-one-six")}),
    ("Die Nummer ist 030/23125710.", {("phone", "030/23125710")}),
    ("The vault code is 770-259-152. Order 78-263 is ready. Case 25/956. Serial number 00-39-505", set()),
    ("My ID is 957-18-1300. I can't", {("id_number", "957-18-1300")}),
    ("Mi DNI es TK 7416235.", {("id_number", "TK 7416235")}),
    ("Documento: X-8340785-N", {("id_number", "X-8340785-N")}),
    ("I live at 163 Nettle Ave., Apt 17. Yes", {("address", "163 Nettle Ave., Apt 17")}),
    ("Meet me at 235 N. Saltmarsh\nCourt, Unit 3A at nine", {("address", "235 N. Saltmarsh Court, Unit 3A")}),
    ("Vivo en C/ Faroles, n.º 140. No", {("address", "C/ Faroles, n.º 140")}),
    ("Ich wohne Drosselbergstraße 349a. So", {("address", "Drosselbergstraße 349a")}),
    ("J'habite 43 bis, avenue du Tisserolles.", {("address", "43 bis, avenue du Tisserolles")}),
    ("Я живу: ул. Озерницкая, д. 868.", {("address", "ул. Озерницкая, д. 868")}),
    ("42 street lamps went dark. Candlewick Lane is closed until 3:14.", set()),
    ("My name is Martin de Brennquist.", {("person", "Martin de Brennquist")}),
    ("Mrs. Kestrhoek, Edith left an hour ago.", {("person", "Kestrhoek, Edith")}),
    ("<i>Sous-titres : Odile Torvanhoek</i>", {("person", "Odile Torvanhoek")}),
    ("Warte, Ute! Felix Square is far. Anna and Walter left. Come on, Laura.", set()),
    ("Где Анна Кестрича?", {("person", "Анна Кестрича")}),
    ("Â¿Conoce usted a AndrÃ©s Quillansen?", {("person", "AndrÃ©s Quillansen")}),
]


@pytest.mark.parametrize("text,want", SPANS)
def test_spans(text, want):
    got = {(k, " ".join(text[a:b].split())) for k, a, b in spans(text)}
    assert got == want


#: Names of no list of the operator, after a verb that takes a person; and what looks like them and is none.
HELD_OUT = [
    ("Do you know {}?", "Priya Raghunathan"), ("Yesterday I met {} there.", "Gavin Torrance"), ("I'm {}.", "Malcolm Penrose"), ("Ask {} about it.", "Siobhan O'Leary"), ("Tu connais {} ?", "Romain Delacourt"),
    ("I told {} twice.", "Kwame Asantehene"), ("He's called {} now", "Tobiah McAllister"), ("¿Conoces a la hermana? Conozco {}.", "Yolanda Berriatúa"), ("Soy {}, de Bilbao", "Aitor Goikoetxea"), ("Pregunta, me llamo {}.", "Nerea Uribarri"),
    ("Ich kenne {} nicht.", "Detlef Wagenknecht"), ("Ich heiße {}.", "Swantje Petersen"), ("Je connais {} depuis", "Gwenaëlle Kerbrat"), ("Je m'appelle {}", "Thibault Lemonnier"), ("Ты знаешь {}?", "Игнат Соболев"), ("Меня зовут {}.", "Таисия Вольская"),
    ("Mr. {} called.", "Osric Fenwick-Hale"), ("Translated by {}", "Ludmilla Vantongeren"), ("the man with {} yesterday", "Zebulon Harrowgate"), ("and so did {} today", "Ottoline Fairweather"),
]
NO_NAMES = ["I know New York well.", "He met White House staff.", "They called Central Park closed.", "Ich kenne Guten Morgen.", "We saw Big Ben.", "You know Monday Night is bad", "I ASKED JOHNNY WALKER", "Tell The Captain now", "I met Doctor Who"]


def test_names_of_no_list_are_found_by_shape_and_context():
    found = [(s.format(n), [s.format(n)[a:b] for k, a, b in spans(s.format(n)) if k == "person"], n) for s, n in HELD_OUT]
    assert sum(got == [n] for _, got, n in found) >= 18, [f for f in found if f[1] != [f[2]]]
    wrong = [(t, [t[a:b] for _, a, b in spans(t)]) for t in NO_NAMES if spans(t)]
    assert len(wrong) <= 1, wrong


ADDRESSES = ["I live at 163 Nettle Avenue.", "Vivo en Calle Faroles, 140.", "Ich wohne Drosselbergstraße 349.", "J'habite 43, avenue du Tisserolles.", "Я живу: ул. Озерницкая, д. 868."]


@pytest.mark.parametrize("end", ["\n", "\r\n", "\r"])
@pytest.mark.parametrize("text", ADDRESSES)
def test_addresses_in_cues_whatever_the_line_ends(text, end):
    cues = [f"{n}{end}00:00:0{n},000 --> 00:00:0{n},500{end}{x}{end}{end}" for n, x in enumerate(["No.", text, "Yes."], 1)]
    v = "".join(cues)
    whole = {m.span() for p in pii._ADDRESSES for m in p.finditer(v)}
    assert len(whole) == 1 and set(pii._addresses(v, pii._without_cues(v))) == whole


@pytest.mark.parametrize("text", ["I live at 12 Oak St, Apt 4", "I live at 12 Oak Sq, Unit 4", "He is at 12 Oak Hwy now", "J'habite 4 av. Tisserolles", "Go to 12\nOak Street"])
def test_the_signs_of_an_address_are_those_of_its_patterns(text):
    whole = {m.span() for p in pii._ADDRESSES for m in p.finditer(text)}
    assert whole and set(pii._addresses(text, text)) == whole


@pytest.mark.parametrize("local", ["a" * 200, "first.second+" + "x" * 150, "я" * 120])
def test_mail_of_any_length_comes_out_whole(local):
    mail = f"{local}@{'sub.' * 40}example.org"
    assert [(k, f"Write: {mail}."[a:b]) for k, a, b in spans(f"Write: {mail}.")] == [("email", mail)]


def test_a_number_does_not_run_into_the_next_cue():
    text = "00:02:06,540 --> 00:02:08,931\r\nTel. +44 20 7946 0721\r\n\r\n20\r\n00:02:09,232 --> 00:02:10,000\r\nHi"
    assert [text[a:b] for _, a, b in spans(text)] == ["+44 20 7946 0721"]


@pytest.mark.parametrize("text", ["walter (ät) example.org", "walter (ät) example (point) org"])
def test_the_signs_of_spelt_mail_are_those_of_its_patterns(text):
    assert list(pii._mails(text, text))


def test_rows_of_personal_information(spark):
    rows = [(1, "a@example.org and a@example.org, by Laura Quillelli"), (2, None), (3, ""), (4, "x " * 40_000 + "b@example.net"), (1, "a@example.org")]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, text string, kind string")
    got = sorted((r[0], r[1], r[2]) for r in personal_information(df).distinct().collect())
    assert got == [(1, "email", "a@example.org"), (1, "person", "Laura Quillelli"), (4, "email", "b@example.net")]
    out = {r[1][:40] if r[1] else r[1] for r in redacted(df).collect()}
    assert "[EMAIL] and [EMAIL], by [PERSON]" in out and None in out and "" in out
    assert personal_information(df.limit(0)).count() == 0


def test_checksums():
    assert luhn("4111111111111111") and not luhn("4111111111111112")
    assert mod97("DE89370400440532013000") and not mod97("DE88370400440532013000")
    assert identity_letter("12345678Z") and not identity_letter("12345678A")
    assert os.sep


def test_patterns_begin_with_what_can_be_skipped_to(monkeypatch):
    """A set of characters first, what must not stand before it after: the same matches, and few places to try."""
    first = rf"(?<!\w)(?!(?i:during|spring|string|bring)\b)[A-ZÄÖÜ][\wäöüßÄÖÜ-]*?(?i:{pii.STREETS_DE})(?!\w){pii._SP}\d{{1,4}}(?:{pii._OPT}[a-zA-Z])?(?!\w)"
    plain = {
        pii._RUN: r"(?<![\w.,:#&/+-])(?:\(?\+?[0-9lIO])[0-9OolI ()./\r\n-]{4,24}[0-9OolI](?:-?[A-Z](?![A-Za-z]))?(?![\w:])",
        pii._CODED: r"(?<![\w-])[A-Z]{1,2}[ -]?\d[\dA-Z]",
        re.compile(pii._NUM): r"(?<![\w/.,:-])\d{1,5}[A-Za-z]?",
        pii._ADDRESSES[2]: first,
        pii._TIMING: r"\d+(?:[:.,]\d+)+[ \t]*-+>[ \t]*\d+(?:[:.,]\d+)+",
    }
    pieces = list("0123456789lIO()+-/.,:# \n\rABxä") + ["String", "Springstraße", "spring", "Bringweg", "Haupt", "Ring", "straße", " weg ", "Allee 12", " --> ", "00:01,5"]
    rng = random.Random(4)
    texts = ["".join(rng.choices(pieces, k=60)) for _ in range(4000)]
    for new, old in plain.items():
        assert new.pattern[0] in "[\\"
        old = re.compile(old)
        got = [[m.span() for m in new.finditer(t)] for t in texts]
        assert got == [[m.span() for m in old.finditer(t)] for t in texts] and sum(map(len, got)) > 5
    tried = []

    class Watched:
        pattern = pii._ADDRESSES[0].pattern

        def match(self, v, at, end):
            tried.append(at)
            return pii_first.match(v, at, end)

    pii_first = pii._ADDRESSES[0]
    monkeypatch.setattr(pii, "_ADDRESSES", (Watched(), *pii._ADDRESSES[1:]))
    cues = "".join(f"{n}\n00:00:{n:02},000 --> 00:00:{n + 1:02},500\nThe stone at the way\n\n" for n in range(10, 50))
    text = cues + "99\n00:01:00,000 --> 00:01:02,000\nCome to 12 Oak Street, Apt 4, at 7.\n"
    assert [text[a:b] for k, a, b in spans(text) if k == "address"] == ["12 Oak Street, Apt 4"]
    assert len(tried) < 4
