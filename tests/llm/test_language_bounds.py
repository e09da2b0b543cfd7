"""Rejection by language and length: languages that were not learned and hexadecimal text go, clean documents stay."""

import os
import random
from collections import Counter

import numpy as np
import pytest
from glyphward.llm import language_id

DOCUMENTS = "/root/testdata/sf0.1/documents.parquet"
OTHERS = {
    "Italian": "la volpe veloce salta sopra il cane pigro mentre gli studenti leggono un libro nella biblioteca della citta vecchia e poi tornano a casa per cena con la famiglia perche domani devono lavorare presto",
    "Polish": "szybki lis przeskoczyl nad leniwym psem podczas gdy studenci czytali ksiazke w bibliotece starego miasta a potem wrocili do domu na kolacje z rodzina poniewaz jutro musza wczesnie pracowac",
    "Finnish": "nopea kettu hyppasi laiskan koiran yli kun opiskelijat lukivat kirjaa vanhan kaupungin kirjastossa ja sitten palasivat kotiin illalliselle perheen kanssa",
    "Dutch": "de snelle vos springt over de luie hond terwijl de studenten een boek lezen in de bibliotheek van de oude stad en daarna naar huis gaan voor het avondeten met hun familie",
}


def rejected(model, texts):
    return [model.judge(*e)[3] for e in model.scorer()(texts)]


@pytest.fixture(scope="module")
def documents():
    if not os.path.isfile(DOCUMENTS):
        pytest.skip("no test tables here")
    import pyarrow.parquet as pq

    rows = [(r["text"], r["lang"]) for r in pq.read_table(DOCUMENTS).to_pylist() if r["text"] and r["lang"] and any(map(str.isalpha, r["text"]))]
    random.Random(1).shuffle(rows)
    seen, rest, taken = [], [], Counter()
    for row in rows:
        taken[row[1]] += 1
        (seen if taken[row[1]] <= language_id.SAMPLE else rest).append(row)
    return seen, rest[:1500]


@pytest.fixture(scope="module")
def model(documents):
    return language_id.fit(*zip(*documents[0], strict=True))


def test_other_languages_and_hexadecimal_text_go(model):
    rng = random.Random(5)
    for name, text in OTHERS.items():
        texts = [" ".join(rng.choice(text.split()) for _ in range(n)) for n in (60, 150, 300) for _ in range(10)]
        assert all(rejected(model, [text, *texts])), name
    for width in (2, 8, 32):
        texts = [" ".join("".join(rng.choice("0123456789abcdef") for _ in range(width)) for _ in range(n // width)) for n in (300, 1200, 5000) for _ in range(10)]
        assert all(rejected(model, texts)), width


def test_clean_documents_stay_at_every_length(documents, model):
    assert not any(rejected(model, [t for t, _ in documents[1]]))
    cut = [t[:n].rsplit(" ", 1)[0] for t, _ in documents[1] for n in (40, 100, 300) if len(t) > n]
    assert np.mean(rejected(model, cut)) < 0.005


def test_one_odd_document_does_not_move_the_bounds(documents):
    texts, langs = map(list, zip(*documents[0], strict=True))
    before = language_id.fit(texts, langs).bounds
    odd = next(i for i in range(4, len(texts), 5) if langs[i] == "en")
    texts[odd] = "漢字仮名 " * 500
    assert np.all(language_id.fit(texts, langs).bounds < before + 0.5)


def test_passages_are_whole_words_of_the_length():
    text = "ab cde f ghij klm no pqr"
    assert language_id.passages(text, 26) == [] and language_id.passages(text, 25) == [text] and language_id.passages("", 4) == []
    got = language_id.passages(text, 6)
    assert got[0] == "ab cde" and got[-1].endswith("pqr") and all(len(x) + 1 >= 6 and f" {x} " in f" {text} " for x in got)


def test_without_held_back_documents_only_unknown_characters_go():
    model = language_id.fit(["lorem ipsum"], ["aa"])
    assert rejected(model, ["lorem ipsum", "dolor", "漢字仮名漢字"]) == [False, False, True]
