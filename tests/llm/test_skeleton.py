from __future__ import annotations

import itertools
import pickle

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from laudarium.llm.skeleton import _restored, found, look_groups, looks, text_forms

SAME = [("Sejm walny", "Ѕеjm wаlny"), ("łąka", "łа̨ka"), ("a b", "a b"), ("ab", "a​b"), ("fi", "ﬁ"), ("ABC 12", "ＡＢＣ １２"), ("Ⅳ", "IV"), ("人", "⼈"), ("so­ft", "soft"), ("Hm...", "Hm…"),
        ("ga", "ɡɑ"), ("oo", "ⲟᴏ"), ("B", "ꓐ"), ("ӕ", "æ"), ("DEH", "ᎠΕН"), ("pyx", "рух"), ("hnu", "հոս")]
DIFFERENT = [("sejm", "sejn"), ("roku 1", "roku 2"), ("O", "0"), ("l", "1"), ("ó", "o"), ("a", "A"), ("a.", "a!"), ("„a”", "«a»"), ("a b", "ab"), ("x²", "x2"), ("m", "rn"), ("ռ", "n"), ("ո", "ռ"), ("ı", "i"), ("æ", "ae"), ("З", "3"), ("г", "ґ"), ("人", "入"), ("ł", "l"), ("в", "В")]


@pytest.fixture(scope="session")
def own(spark):
    return looks(spark)


def test_what_looks_the_same_and_what_does_not(own):
    for a, b in SAME:
        assert a != b and own.skeleton(a) == own.skeleton(b), (a, b)
        assert own.one_form(a) == own.one_form(b)
    for a, b in DIFFERENT:
        assert own.skeleton(a) != own.skeleton(b), (a, b)
    again = pickle.loads(pickle.dumps(own))
    assert [again.one_form(a) for a, _ in SAME] == [own.one_form(a) for a, _ in SAME] and again is _restored(*own.__reduce__()[1])


def test_classes_keep_case_and_letters_of_one_script(own):
    assert len(own.classes) > 300
    for c in own.classes:
        assert len({x.isupper() for x in c if x.isupper() or x.islower()}) <= 1, c


def test_words_keep_their_script(own):
    for text in ("Рада міста ухвалила новий податок", "Σύλλογος τῆς πόλεως", "Ժողով քաղաքի ռազմական", "Sejm walny koronny, łąka"):
        assert own.one_form(text) == text
    assert own.one_form("Рaдa") == "Рада" and own.one_form("Sеjm") == "Sejm"


@settings(suppress_health_check=[HealthCheck.function_scoped_fixture], deadline=None)
@given(text=st.text(max_size=60))
def test_forms_are_stable(own, text):
    assert own.skeleton(own.skeleton(text)) == own.skeleton(text)
    assert own.one_form(own.one_form(text)) == own.one_form(text)
    assert own.skeleton(own.one_form(text)) == own.skeleton(text)


def test_pairs_leave_out_exact_copies(documents, clashing, own):
    texts = ["Sejm", "Sejm", "Ѕejm", "Sеjm", "sejm", None, "", "", "​", "inny", "inny"]
    docs = [(i, t) for i, t in enumerate(texts)]
    want = {(i, j) for (i, a), (j, b) in itertools.combinations(docs, 2) if a is not None and b is not None and a != b and own.skeleton(a) == own.skeleton(b)}
    got = [tuple(r) for r in found(clashing(documents(docs))).collect()]
    assert set(got) == want and len(got) == len(want)
    assert found(documents([])).count() == 0


def test_forms_of_null_and_empty_texts(documents):
    got = {r.doc_id: (r.form, r.look) for r in text_forms(documents([(1, None), (2, ""), (3, "a"), (3, "a")])).collect()}
    assert got[1] == (None, None) and got[2][0] == "" and got[3][0] == "a"


def test_groups_have_a_row_for_each_document(documents, clashing):
    got = {r.doc_id: (r.n_documents, r.n_texts) for r in look_groups(clashing(documents([(1, "Sejm"), (2, "Ѕejm"), (3, "Sejm"), (3, "Sejm"), (4, "inny"), (5, None), (6, "")]))).collect()}
    assert got == {1: (3, 2), 2: (3, 2), 3: (3, 2), 4: (1, 1), 6: (1, 1)}
    assert look_groups(documents([])).count() == 0
