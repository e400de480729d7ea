"""Names beside other punctuation than ASCII's, and surrogates that hold over the whole corpus."""

from __future__ import annotations

import pytest

from quernstone.llm import surrogates

KEYED = surrogates.Keyed(surrogates.default_key("k"))


@pytest.mark.parametrize("before", ["\u201c", "\u2018", "\u2014", "\u00a0", "\u3002", "\u00ab"])
@pytest.mark.parametrize("name", ["Mary Jones", "Mr Jones", "Dr. Jones", "Se\u00f1or Jones", "\u0410\u043d\u043d\u0430 Jones"])
def test_names_beside_punctuation_beyond_ascii(before, name):
    out, spans, _ = surrogates.replace(f"x{before}{name}\u201d", KEYED)
    assert spans and "Jones" not in out


def test_a_name_and_its_successor_keep_their_surrogates_in_every_text():
    for (script, gender), names in surrogates.GIVEN.items():
        after = {n: surrogates.next_value(KEYED, f"given-{script}-{gender}", n) for n in names}
        for n in names:
            both = surrogates.replace(f"{n} Qux, {after[n]} Qux", KEYED)[0]
            assert [p.split()[0] for p in both.split(", ")] == [after[n], after[after[n]]]


def test_a_listed_surname_has_the_surrogate_of_the_name():
    alone, titled = (surrogates.replace(t, KEYED)[0].split()[1] for t in ("x Thomas Qux", "Mrs. Thomas"))
    assert alone == titled


def test_addresses_of_a_network_are_a_cycle():
    for net in ("192.0.2.", "198.51.100.", "203.0.113."):
        made = {surrogates.next_value(KEYED, "ipv4", f"{net}{i}") for i in range(256)}
        assert made == {f"{net}{i}" for i in range(256)}


def test_names_of_a_text_do_not_collide(spark):
    docs = spark.createDataFrame([(1, "Mary Qux and Anna Qux"), (2, None)], "doc_id long, text string")
    assert surrogates.collisions(docs, secret="k").count() == 0
