import hashlib
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from puckline.llm import pii

PLAIN = [r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
         r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"]


def luhn(digits):
    doubled = [int(c) * (1 + i % 2) for i, c in enumerate(reversed(digits))]
    return sum(sum(map(int, str(x))) for x in doubled) % 10 == 0


def brute(text):
    out = []
    for kind, pattern in enumerate(PLAIN):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            if kind == 1 and any(int(p) > 255 for p in m[0].split(".")):
                continue
            if kind == 2 and not (12 <= len(digits) <= 19 and luhn(digits)):
                continue
            if kind == 3 and not 9 <= len(digits) <= 15:
                continue
            out.append((m.start(), m.end(), kind))
    return sorted(out, key=lambda s: (s[0], s[2]))


@settings(max_examples=1500, deadline=None)
@given(st.text(alphabet="a1.@-+ ()%09é2@", max_size=40))
def test_base_spans_match_the_plain_patterns(text):
    assert pii.find_spans(text) == brute(text)


def test_base_spans_on_documents(documents):
    for row in documents.collect():
        assert pii.find_spans(row.text) == brute(row.text)


@pytest.mark.parametrize(("text", "kind", "found"), [
    ("write to john.doe (at) example (dot) com now", "email", "john.doe (at) example (dot) com"),
    ("john dot doe at example dot com", "email", "john dot doe at example dot com"),
    ("bob [at] example.com", "email", "bob [at] example.com"),
    ("alice{at}foo{dot}org!", "email", "alice{at}foo{dot}org"),
    ("see jоhn@exаmple.com.", "email", "jоhn@exаmple.com"),
    ("user＠site．org", "email", "user＠site．org"),
    ("bob@exam​ple.com", "email", "bob@exam​ple.com"),
    ("ip 192 dot 168 dot 1 dot 1 ok", "ip", "192 dot 168 dot 1 dot 1"),
    ("ip one nine two dot one six eight dot one dot one.", "ip", "one nine two dot one six eight dot one dot one"),
    ("x 192[.]168[.]1[.]1", "ip", "192[.]168[.]1[.]1"),
    ("card four one one one 1111 1111 1111 x", "card", "four one one one 1111 1111 1111"),
    ("call plus one five five five one two three four five six seven", "phone",
     "plus one five five five one two three four five six seven"),
    ("＋４９ １５１ ２３４５６７８９", "phone", "＋４９ １５１ ２３４５６７８９"),
])
def test_disguised_identifiers_map_back_to_the_source(text, kind, found):
    base, spans = pii.detect(text)
    assert base == []
    assert [(pii.KINDS[k], text[a:b]) for a, b, k in spans] == [(kind, found)]


@pytest.mark.parametrize(("text", "kind"), [
    ("10.0.zero.1", "ip"), ("one.two.three.four", "ip"), ("10.0.(null).1", None), ("10.0.NİNE.1", "ip"), ("10.0.nıne.one", "ip"),
    ("+1 415 five 55 0134", "phone"), ("4111 1111 1111 111 one", "card")])
def test_single_spelled_digits(text, kind):
    base, spans = pii.detect(text)
    assert base == []
    assert [(pii.KINDS[k], text[a:b]) for a, b, k in spans] == ([(kind, text)] if kind else [])


PIECES = [" ", "  ", ".", ",", "-", "(", ")", "[", "]", "<", ">", "+", "@", "1", "0134", "4111 1111 1111 111", "10.0.", "a", "b.co",
          "one", "Zero", "fünf", "ZÉRO", "nıne", "NİNE", "ſix", "double", "triple ", "plus ", "Plus", "dot", " DOT ", "punKt", "poınt",
          "(at)", " at ", "arroba", "someone", "\n"]


@settings(max_examples=3000, deadline=None)
@given(st.lists(st.sampled_from(PIECES), max_size=14).map("".join))
def test_the_quick_look_changes_nothing(text):
    with pytest.MonkeyPatch.context() as patch:
        quick = pii.detect(text)
        patch.setattr(pii, "_has_disguise", lambda text: True)
        assert pii.detect(text) == quick


@pytest.mark.parametrize("text", [
    "look at example.com", "one two three", "the dot at the end", "Привет, как дела?", "un deux trois quatre", "a @ b"])
def test_plain_text_is_left_alone(text):
    assert pii.detect(text) == ([], [])


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="аеоx1 .@[]()dotat２​one two", max_size=60))
def test_base_spans_stay_and_spans_lie_in_the_text(text):
    base, spans = pii.detect(text)
    assert set(base) <= set(spans)
    assert all(0 <= a < b <= len(text) for a, b, _ in spans)


def test_query_rows(spark, awkward, no_documents):
    rows = pii.find_pii(awkward).collect()
    assert len(rows) == awkward.count()
    assert all(r.spans == "" and r.base_sha256 == hashlib.sha256(b"").hexdigest() for r in rows)
    assert pii.find_pii(no_documents).collect() == []
    text = "é mail a@b.co and 10.0.0.1, " + "x" * 200_000 + " c (at) d (dot) org"
    (row,) = pii.find_pii(spark.createDataFrame([(9, text)], "doc_id long, text string")).collect()
    end = len(text)
    base = "email:7:13,ip:18:26"
    assert row.base_sha256 == hashlib.sha256(base.encode()).hexdigest()
    assert row.spans == f"{base},email:{end - 18}:{end}"
    assert (row.n_email, row.n_ip, row.n_card, row.n_phone, row.n_base) == (2, 1, 0, 0, 2)


def test_long_runs_take_linear_time():
    for text in ("a" * 200_000, "1" * 200_000, "1." * 100_000, "+1" * 100_000, "a@" * 100_000, "1 " * 100_000):
        pii.detect(text)


def test_mask():
    text = "a@b.co or 10.0.0.1"
    assert pii.mask(text, pii.detect(text)[1]) == "<email> or <ip>"


def wide(text):
    return "".join(chr(ord(c) + 0xFEE0) if c.isdigit() else c for c in text)


def test_what_one_tape_shows_another_does_not_lose():
    for card in ("4111111111111111", "4111 1111 1111 1111"):
        for tail in (" one day", " two", " and one two three", " at noon", ""):
            text = f"pay {wide(card)}{tail}"
            assert pii.spell(pii.detect(text)[1]) == f"card:4:{4 + len(card)}", text


def test_bare_at_and_dot_need_a_domain():
    assert pii.detect("we met at noon dot we left") == ([], [])
    assert pii.detect("look at this dot then go")[1] == []
    for text, end in (("mail john at example dot com now", 24 + 0), ("john at mail dot example dot org", None), ("john at example (dot) it", None)):
        spans = pii.detect(text)[1]
        assert [s[2] for s in spans] == [0], text
        if end is not None:
            assert text[spans[0][0]:spans[0][1]] == "john at example dot com"


def test_spaced_dots_behind_a_bracketed_at():
    for text in ("john [ at ] example . com", "john (at) mail . example .com", "john [@] example. com"):
        assert pii.spell(pii.detect(text)[1]) == f"email:0:{len(text)}", text
    assert pii.detect("john [at] home . Then we left")[1] == []


_SENTENCES = st.lists(st.sampled_from([
    "one day", "we met at noon", "dot", "plus one", "two (at) three", "a . b", "x at y dot z", "seven", "call me at nine", "@ home", "[dot]"]),
    max_size=3).map(" ".join)


@given(st.sampled_from(["4111111111111111", "5500 0000 0000 0004", "+49 30 1234567", "10.2.3.4", "jo@ex.com"]), st.booleans(), _SENTENCES)
@settings(max_examples=300, deadline=None)
def test_a_trailing_sentence_loses_no_span(value, full_width, tail):
    text = f"value {wide(value) if full_width else value}."
    before = pii.detect(text)[1]
    assert before
    after = pii.detect(f"{text} {tail}.")[1]
    assert {(s, k) for s, _, k in before} <= {(s, k) for s, _, k in after}
