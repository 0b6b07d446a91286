from __future__ import annotations

from laudarium.llm.sentences import found, sentence_starts, sentences


def _split(text):
    starts = [*sentence_starts(text), len(text)]
    return [text[a:b].strip() for a, b in zip(starts, starts[1:])]


CASES = [
    ["Imć P. Wolski wybrał pobór w r. 1614.", "Ks. Korski odda 14.4 grzywny dnia 28.08.1691.", "12 maja tegoż roku J. K. Lubski żąda cła na fol. 2!!", "A iż poseł..."],
    ["Uchwalono z 1703 r.", "Przeto poseł odebrał i inne rzeczy itd.", "Szlachta pozwala w XVI. wieku w rozdz. IV. tychże artykułów."],
    ["Poseł rzekł: „Nie pozwalam! Zgoda.” i wyszedł z koła, a iż król prosił.", "Rycerstwo zawołało: «Zgoda.»", "Potem sejmik odda kwit."],
    ["Der Richter sprach: »Wer zahlt den Schaden?«", "Das Volk begehrt am 24. Mai 1588 im 16. Jahrhundert lt. Art. 22. der Ordnung u. s. w.", "Weil aber Hr. v. Lubski zahlte Nr. 649.", "Se. Exz. der Statthalter."],
    ["L'évêque dit: « Soit, nous le voulons. Oui ! » et il sortit.", "M. Wolski a payé à St. Pierre.", "S. E. le nonce promet av. la fin du mois."],
    ["Magnificus D. Osicki promisit fol. 697 v. actorum anno eodem A. D.", "Itaque S. R. M. commissarius ut supra, v. fol.", "Dns. Turski.", "Ideo dns. Lubski decrevit."],
    ["П. Борович сказав: «Нехай так буде. Хто?» та й замовк у р. 1666.", "Отже о. Добров у м. Верминів та інше і т. д.", "Поборця ухвалив."],
    ["Պատվիրակը գրեց 12.2 մարկ։", "Պրն. Վարդան ասաց: «Թող լինի։ Ոչ։» և գնաց։"],
    ["又国王的书记说：“谁来赔偿损失？就这样吧。”，然后离开了会场，税吏批准白银11.5两。", "因此本地贵族拒绝！", "城中商人说：「不行。」", "其后法官决定。"],
]


def test_known_cases():
    for want in CASES:
        chinese = any("一" <= ch <= "鿿" for ch in want[0])
        assert _split(("" if chinese else " ").join(want)) == want


def test_missing_blanks_and_odd_texts():
    assert _split("Poseł wybrał przez lat kilka.Co aby szlachta?Król") == ["Poseł wybrał przez lat kilka.", "Co aby szlachta?", "Król"]
    assert sentence_starts(None) == sentence_starts("") == sentence_starts(" \n") == []
    assert sentence_starts("  Ab. Cd.") == [2, 6]
    assert sentence_starts("„nigdy nie zamknięte. Nowe zdanie.") == [0, 22]
    assert sentence_starts("Laudum z r. 1590. Dnia 3. maja.", title=True) == [0]
    assert len(sentence_starts("Słowo. " * 20000)) == 20000


def test_rows(rows, clashing):
    given = [(1, 1, "Laudum. Z r. 1590. W"), (1, 2, "Ab. Cd."), (1, 2, "Ab. Cd."), (2, 1, "Ab. Cd.", -1, "meta"), (3, 2, None), (3, 3, ""), (4, 2, "Ab. Cd.", 7), (None, 2, "Ef.")]
    got = sorted(map(tuple, found(clashing(rows(given))).collect()), key=str)
    assert got == sorted([(1, 1, 0), (1, 2, 0), (1, 2, 4), (2, 1, 0), (2, 1, 4), (None, 2, 0)], key=str)
    assert sentences(rows(given)).where("section_id = 4").count() == 2
    assert found(rows([])).count() == 0


def test_a_place_is_decided_by_the_table_of_its_language():
    from laudarium.llm.sentences import sentence_starts

    one, two = "Widział to v. Potem odszedł.", "Vide cap. Secundum dicit."
    assert len(sentence_starts(one)) == 1 and len(sentence_starts(one, spans=[(0, len(one), "pl")])) == 2
    assert len(sentence_starts(two, spans=[(0, len(two), "la")])) == 1 and len(sentence_starts(two, spans=[(0, len(two), "pl")])) == 2
    mixed = f"{one} {two}"
    own = [(0, len(one) + 1, "pl"), (len(one) + 1, len(mixed), "la")]
    assert sentence_starts(mixed, spans=own) == [0, mixed.index("Potem"), mixed.index("Vide")]
    assert sentence_starts(mixed, spans=own[1:]) == [0, mixed.index("Vide")]
    long = "Zob. rozdz. " + " " * 20 + "XXVIII. Dalej."
    assert len(sentence_starts(long, spans=[(0, len(long), "pl")])) == 2


def test_sentences_of_found_languages(rows, clashing):
    from laudarium.llm.sentences import sentences

    given = clashing(rows([(1, 2, "Widział to v. Potem odszedł."), (1, 1, "Tytuł v. Potem."), (1, 3, None), (1, 4, " ")]))
    by = lambda spans: {(r.par_n, r.sent_start) for r in sentences(given, spans=spans).collect()}
    assert by(None) == {(1, 0), (2, 0)} and by(lambda text: [(0, len(text), "pl")]) == {(1, 0), (2, 0), (2, 14)}
