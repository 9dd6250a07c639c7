"""Properties of the plain functions, over generated inputs."""

import json

from hypothesis import given
from hypothesis import strategies as st

from panelworks.functions import answers as A
from panelworks.functions import vocab
from panelworks.operators import sampling, survey
from panelworks.sources import sinks

probabilities = st.dictionaries(st.sampled_from([*"0123456789", "**", "７"]), st.floats(1e-6, 1), min_size=1)


@given(st.text(alphabet="{}ab \"", max_size=60))
def test_spans_are_balanced_pieces_in_order(text):
    at = 0
    for span in A.json_spans(text):
        assert span.count("{") == span.count("}") and span[0] == "{" and span[-1] == "}"
        at = text.index(span, at) + len(span)


@given(st.lists(st.tuples(st.integers(0, 50), st.integers(0, 60)), max_size=12))
def test_redistribution_keeps_the_total(cells):
    made = [{"target": t, "available": n} for t, n in cells]
    unmet = sampling.redistribute(made)
    drawn = sum(min(c["target"], c["available"]) + c["extra"] for c in made)
    assert all(c["extra"] >= 0 and min(c["target"], c["available"]) + c["extra"] <= c["available"] for c in made)
    assert drawn + unmet == sum(c["target"] for c in made)


@given(probabilities, probabilities, probabilities, st.integers(0, 100))
def test_pmf_is_a_distribution(first, second, third, sampled):
    d = A.answer_pmf([A.digit_row(x) for x in (first, second, third)], sampled)
    if d is not None:
        assert abs(sum(d["pmf"].values()) - 1) < 1e-9 and all(0 <= n <= 100 and p > 0 for n, p in d["pmf"].items())
        assert 0 <= d["expected"] <= 100 and d["mode"] in d["pmf"] and 0 <= d["borrowed"] <= 1


@given(st.text(max_size=200))
def test_parsers_never_fail(text):
    p = A.parse_answers(text, vocab.ITEM_KEYS)
    assert len(p["missing"]) + len(p["items"]) == 44 and set(p["invalid"]) <= set(p["items"])
    assert A.last_valid_guess(text) is None or isinstance(A.last_valid_guess(text), dict)


@given(st.sets(st.sampled_from(vocab.ITEM_KEYS), min_size=1), st.integers(0, 2**32 - 1))
def test_dummy_answers_parse_back(keys, seed):
    keys = sorted(keys)
    prompt = survey.step_prompt({"demographics": dict.fromkeys(vocab.MODERATORS, "x"), "profile_text": "t"}, [], [], [f"i:{k}" for k in keys], {}, survey.RunOptions())
    p = A.parse_answers(survey.DummyClient().chat(prompt, seed).text, keys)
    assert not p["missing"] and not p["invalid"]
    assert survey.DummyClient().chat(prompt, seed).text == survey.DummyClient().chat(prompt, seed).text


@given(st.lists(st.fixed_dictionaries({"file": st.sampled_from("abc"), "n": st.integers()})), st.fixed_dictionaries({"file": st.sampled_from("abc"), "n": st.integers()}))
def test_manifest_holds_the_fresh_entry_once(entries, fresh):
    out = sinks.upsert_manifest(entries, [fresh])
    assert [e for e in out if e["file"] == fresh["file"]] == [fresh] and json.loads(sinks.dump(out)) == out
