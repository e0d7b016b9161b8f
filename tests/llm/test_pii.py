import re

from hypothesis import given, settings
from hypothesis import strategies as st

from kerbside.llm.pii import _DISGUISE, _LOOK, KINDS, _disguised, find_pii, hide, luhn, mask_pii, plain_spans, spans

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def brute(text):
    out = [(m.start(), 0, m.end()) for m in EMAIL.finditer(text)]
    out += [(m.start(), 1, m.end()) for m in IP.finditer(text) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in CARD.finditer(text):
        d = re.sub(r"\D", "", m[0])
        total = sum(int(c) if i % 2 == 0 else int(c) * 2 - 9 * (int(c) > 4) for i, c in enumerate(reversed(d)))
        if 12 <= len(d) <= 19 and total % 10 == 0:
            out.append((m.start(), 2, m.end()))
    out += [(m.start(), 3, m.end()) for m in PHONE.finditer(text) if 9 <= len(re.sub(r"\D", "", m[0])) <= 15]
    return sorted(out)


@settings(max_examples=600, deadline=None)
@given(st.text(alphabet="ab@.-+ 0192()é", max_size=60))
def test_plain_spans_are_those_of_the_patterns(text):
    assert plain_spans(text) == brute(text)


def test_plain_spans_of_the_sample(sample):
    for r in sample.select("text").collect():
        assert plain_spans(r.text) == brute(r.text)


def found(text):
    return [(KINDS[k], text[a:b]) for a, k, b in spans(text)[1]]


def test_disguises_map_back_to_the_source():
    assert found("write john [at] example (dot) com now") == [("email", "john [at] example (dot) com")]
    assert found("jоhn＠example.com") == [("email", "jоhn＠example.com")]
    assert found("zero​@exa​mple.com") == [("email", "zero​@exa​mple.com")]
    assert found("mail me at mail dot example dot org") == [("email", "me at mail dot example dot org")]
    assert found("plus one two three four five six seven eight nine zero") == [("phone", "plus one two three four five six seven eight nine zero")]
    assert found("４１１１ １１１１ １１１１ １１１１") == [("card", "４１１１ １１１１ １１１１ １１１１")]


def test_a_disguise_needs_no_other_to_be_seen():
    assert found("call plus 49 30 1234 5678") == [("phone", "plus 49 30 1234 5678")]
    assert found("card:four 1 1 1 1 1 1 1 1 1 1 1 1 1 1 1") == [("card", "four 1 1 1 1 1 1 1 1 1 1 1 1 1 1 1")]
    assert found("(four 1 1 1 1 1 1 1 1 1 1 1 1 1 1 1; next") == [("card", "four 1 1 1 1 1 1 1 1 1 1 1 1 1 1 1")]
    assert hide("joe [at] example\xa0dot\xa0com, joe@example\rdot\rcom") == "[EMAIL], [EMAIL]"
    assert hide("joe@example\rdot\rcom") == "[EMAIL]"


PARTS = ["plus", "PLUS", "at", "arroba", "@", "dot", "Punkt", "punto", "point", "one", "fünf", "FİVE", "ſix", "sıx", "zéro", "OH", "acht", "7", "42", "joe", "com", "é", "_", "\u200b"] + list(" \t\n\r\xa0\u2003,-.:;[](){}<>+'")


@settings(max_examples=3000, deadline=None)
@given(st.lists(st.sampled_from(PARTS), max_size=9).map("".join))
def test_the_look_sees_all_that_the_transducer_would(text):
    for seen in (text, text.translate(_LOOK)):
        assert _disguised(seen) or not _DISGUISE.search(seen)


@settings(max_examples=300, deadline=None)
@given(st.sampled_from(["plus 4", "plus  one", "(one 2", "joe at a point", "a dot c", "[ at ]", "seven-7", "a\xa0punkt\xa0b"]), st.text(max_size=5), st.text(max_size=5))
def test_the_look_sees_disguises_in_any_surroundings(core, before, after):
    for seen in (before + core + after, (before + core + after).translate(_LOOK)):
        assert _disguised(seen) or not _DISGUISE.search(seen)


def test_clean_text_has_none():
    for t in ("look at the dots at ease", "we met at noon. Dot matrix printers are loud", "one two three", "1.2.3", "a@b", "4111 1111 1111 1112"):
        assert found(t) == []


def test_plain_spans_stay_when_others_are_added():
    base, both = spans("a@b.cc and joe [at] example [dot] com")
    assert set(base) <= set(both) and len(both) == 2


def test_half_hidden_identifiers_are_found_whole():
    """The plain span of the part that shows stays; the whole one is added, and masked."""
    for text, whole in (("write to j\u043ehn@example.com now", (9, 25)), ("mail ann@ex.org [dot] uk today", (5, 24))):
        base, both = spans(text)
        assert set(base) < set(both) and (whole[0], 0, whole[1]) in both
        assert hide(text) == text[: whole[0]] + "[EMAIL]" + text[whole[1] :]


def test_long_runs_are_linear():
    assert plain_spans("1" * 400_000) == [] and plain_spans("a" * 400_000 + "@") == []


def test_luhn():
    assert luhn("4111111111111111") and not luhn("4111111111111112")


def test_operator_keeps_every_row(docs, empty):
    out = find_pii(docs).collect()
    assert len(out) == docs.count() and all(r.base == [] or r.base for r in out)
    assert find_pii(empty).collect() == []


def test_mask(spark):
    df = spark.createDataFrame([(1, "call +1 (017) 555-7713 or a@b.cc", "k"), (2, None, None), (3, "", "")], "doc_id long, text string, other string")
    assert [tuple(r) for r in mask_pii(df).orderBy("doc_id").collect()] == [(1, "call [PHONE] or [EMAIL]", "k"), (2, None, None), (3, "", "")]
    assert hide("10.0.0.1") == "[IP]"
