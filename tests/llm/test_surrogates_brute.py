"""Whole documents against surrogates written by hand: places known from how a text was put together, cycles from full tables."""

from __future__ import annotations

import itertools
import random
import time

import pytest

from quernstone.llm import surrogates

KEYED = surrogates.Keyed(surrogates.default_key("k"))

def table_of(form: surrogates.Form, good=lambda t: True) -> dict[str, str]:
    """The cycle of a form by listing all its texts: the next, by the keyed order of all numbers, that is good."""
    n = form.n
    texts = ["".join(x) for x in itertools.product(*[dict(form.slots).get(i, c) for i, c in enumerate(form.text)])]
    assert len(texts) == n
    order = sorted(range(n), key=lambda x: KEYED.permute(form.name, n, x))
    kept = [texts[x] for x in order if good(texts[x])]
    return dict(zip(kept, kept[1:] + kept[:1], strict=True))


@pytest.mark.parametrize(("kind", "text", "fixed"), [("name-latin", "Eko", set()), ("name-latin", "Abel", {3}), ("local-phone", "555-1", set()), ("email", "b@x.io", {3, 4, 5})])
def test_cycles_equal_their_tables(kind, text, fixed):
    form = surrogates.Form(kind, text, fixed)
    good = (lambda t: t not in surrogates._GENDER) if kind.startswith("name") else lambda t: True
    wanted = table_of(form, good)
    if not good(text):
        text = next(iter(wanted))
    for value in [text, *list(wanted)[:40]]:
        assert surrogates.next_value(KEYED, kind, value) == wanted[value]
    assert sorted(wanted.values()) == sorted(wanted)  # one value each


PIECES = {
    "email": ["ann.lee@example.org", "x_1@mail.host.net"], "ssn": ["123-45-6789", "418-41-4662", "624-63-9107"], "phone": ["+44 20 7946 0018", "(555) 123-4567"],
    "card": ["4111 1111 1111 1111", "5500005555555559"], "ipv4": ["8.8.8.8", "192.168.1.20"], "ipv6": ["fe80::1a2b", "2001:db8::10", "2001:db8:0:0:0:0:0:1"],
}


def test_documents_equal_those_put_together_by_hand(spark):
    rng, docs, wanted = random.Random(4), [], {}
    fill = ["the lake", "was seen", "at dawn,", "quietly;", "été 漢字", "🙂 so", "no more"]
    for i in range(60):
        text, out, spans = "", "", []
        for _ in range(rng.randrange(0, 12)):
            words = rng.choice(fill) + " "
            text, out = text + words, out + words
            if rng.random() < 0.6:
                kind = rng.choice(sorted(PIECES))
                value = rng.choice(PIECES[kind])
                spans.append(f"{kind}:{len(text)}:{len(text) + len(value)}")
                text, out = text + value + " ", out + surrogates.next_value(KEYED, kind, value) + " "
        docs.append((i, text))
        wanted[i] = (out, len(spans), ",".join(spans))
    got = surrogates.surrogate(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), secret="k").collect()
    assert {r["doc_id"]: (r["text"], r["n_entities"], r["entities"]) for r in got} == wanted


def test_documents_that_hold_each_other_s_surrogates_keep_coreference_and_distinctness(spark):
    one = "123-45-6789"
    two = surrogates.next_value(KEYED, "ssn", one)
    three = surrogates.next_value(KEYED, "ssn", two)
    docs = spark.createDataFrame([(1, one), (2, f"{one} and {two}"), (3, f"{two} {three} {one}"), (4, three)], "doc_id long, text string")
    got = {r["doc_id"]: r["text"] for r in surrogates.surrogate(docs, secret="k").collect()}
    four = surrogates.next_value(KEYED, "ssn", three)
    assert got == {1: two, 2: f"{two} and {three}", 3: f"{three} {four} {two}", 4: four}
    assert surrogates.collisions(docs, secret="k").count() == 0


def test_gender_addresses_local_numbers_and_introductions():
    find = lambda t: [(t[a:b], k) for a, b, k in surrogates.find(t)]
    assert find("Mr Kwame Mensah came") == [("Kwame", "name-latin-m"), ("Mensah", "name-latin-m")]
    assert surrogates.next_value(KEYED, "name-latin-m", "Kwame") == surrogates.next_value(KEYED, "name-latin", "Kwame")[:5] and surrogates.next_value(KEYED, "name-latin", "Kwame")[-1] == "e"
    assert find("my name is Priya Raman, and Raman") == [("Priya", "name-latin"), ("Raman", "name-latin"), ("Raman", "name-latin")]
    assert find("at fe80::1 now") == [("fe80::1", "ipv6")]
    assert find("at fe80::1a2b now") == [("fe80::1a2b", "ipv6")]
    assert find("call 555-1234 now, pages 100-2000") == [("555-1234", "local-phone")]
    assert find("std::vector<int> a1::b2::c3 and 12:30:45") == []
    got = surrogates.next_value(KEYED, "ipv6", "FE80::1A2B")
    assert got.isupper() and got.count("::") == 1 and surrogates.ipv6_valid(got)


def test_a_text_of_very_many_entities_is_quick():
    text = " ".join(f"u{i}@example.org" for i in range(40_000))
    began = time.time()
    assert len(surrogates.find(text)) == 40_000 and time.time() - began < 30
