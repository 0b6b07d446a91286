from __future__ import annotations

import random

from laudarium.llm import ocr

BOOK = "Akta sejmikowe ziemi Bzudosko, t. 1"


def test_lines_of_headers_and_numbers():
    kind = lambda line, page=29: ocr.line_kind(line, BOOK, page)
    assert kind("AKTA SEJMIKOWE ZIEMI BZUDOSKO") == (True, False)
    assert kind("29   ΛKTA  SFJM1KOWE Z1EMI BZUD0SKO") == (True, True)
    assert kind("BZUDOSKO, 1744   — 29 —") == (True, True)
    assert kind("Akta z roku 1708  [29]") == (True, True)
    assert kind("XXIX   AKTA SEJMIKOVVE ZIEMI BZUDOSKO") == (True, True)
    for number in ("29", "30", "— 29 —", "[29]", "2 9 .", "29.", "str. 29", "XXIX", "3O"):
        assert kind(number) == (False, True), number
    for text in ("1590", "roku 1590.", "28.08.1691.", "31", "MAJA ROKU 1590", "INSTRUKCJA DANA POSŁOM NA SEJM", "", "29 maja tegoż roku", "ziemi Bzudosko uchwalona"):
        assert kind(text) == (False, False), text
    assert kind("[31]", None) == (False, True) and kind("31", None) == (False, False) and ocr.line_kind("31", None, None) == (False, False)


def test_page_numbers_of_any_size():
    """Books of a large table have pages beyond 100,000, and Roman numbers as long as lines."""
    head = "AKTA SEJMIKOWE ZIEMI BZUDOSKO"
    for page in (7, 99_999, 123_456, 1_206_758):
        digits, roman = str(page), "C" * (page // 100) + ["", "VII", "LVI", "LVIII", "XCIX"][{0: 0, 7: 1, 56: 2, 58: 3, 99: 4}[page % 100]]
        for said in (digits, f"— {digits} —", f"[{digits}]", " ".join(digits) + " .", digits.replace("1", "l").replace("0", "O"), roman, f"— {roman} —", roman.replace("I", "1")):
            assert ocr.line_kind(said, BOOK, page) == (False, True), (page, said[-20:])
            assert ocr.line_kind(said, BOOK, page - 1) == (False, True) and ocr.line_kind(said, BOOK, page + 1) == (False, False)
            assert ocr.line_kind(f"{head}  {said}", BOOK, page) == (True, True) == ocr.line_kind(f"{said}   {head}", BOOK, page), (page, said[-20:])
    for text in ("1" * 5000, "I" + "1" * 5000, "I " * 5000, "C" * 5000 + " uchwalono na sejmiku ziemskim", "C" * 5000 + "x", "1 " * 5000 + "x"):
        assert ocr.line_kind(text, BOOK, 29) == (False, False), text[:9]


def test_a_mark_for_the_first_letter_of_a_word(rows, editions):
    got = _noise(rows, editions, CLEAN + [(109, 2, "Aucun délai, aucun autre.", -1), (1, 2, "Poseł «ucun\nwypłacił «hibernę»", 7)])
    assert got == {(1, 2, 1, "char")}


def test_misreadings_cost_little():
    for read, printed in (("przcd", "przed"), ("sąclem", "sądem"), ("liibernę", "hibernę"), ("posłorn", "posłom"), ("wypłac!ł", "wypłacił"), ("z:adnej", "żadnej"), ("3емлі", "землі"), ("omncs", "omnes"), ("przcdzcn", "przedzen"), ("sąclcm", "sądem"), ("iiiarn", "mam")):
        assert ocr.misreading_cost(read, printed, ocr.listed()) <= ocr.MOST
    for read, printed in (("poseł", "posła"), ("sejm", "sejmu"), ("borski", "korski"), ("a", "kota")):
        assert ocr.MOST < ocr.misreading_cost(read, printed, ocr.listed()) < 10
    assert ocr.misreading_cost("x", "y", {}) == ocr.OTHER and ocr.misreading_cost("axb", "ab", {}) == ocr.OTHER and ocr.misreading_cost("", "", {}) == 0


def _noise(rows, editions, given):
    return {tuple(r) for r in ocr.noise(rows(given), editions).collect()}


CLEAN = [(100 + k, 2, "Poseł przed sądem wypłacił hibernę oraz biało-czerwona chorągiew dwu- i trzyletnie podatki przez lat kilka.") for k in range(3)]


def test_noise_of_scans(rows, editions, clashing):
    scans = [
        (1, 2, "Poseł prz-\ned sądcm\nAKTA SEJMIKOWE ZIEMI BZUDOSKO\n30\nwypłacił hi¬", 7),
        (1, 3, "AKTA SEJMIKOWE ZIEMI BZUDOSKO  31", 8),
        (1, 4, "bcrnę biało-\nczerwona dwu-\ni trzyletnie podatki", 9),
        (2, 2, None, 7), (2, 3, "", 7), (None, 2, "sam", 7),
    ]
    got = _noise(lambda g: clashing(rows(g)), editions, CLEAN + scans + scans[:1])
    assert got == {(1, 2, 1, "hyphen"), (1, 2, 2, "char"), (1, 2, 3, "header"), (1, 2, 4, "pageno"), (1, 2, 5, "hyphen"), (1, 3, 1, "header"), (1, 3, 1, "pageno"), (1, 4, 1, "char")}


def test_running_text(rows, editions):
    scans = [(1, 1, "Laudum", 7), (1, 2, "Poseł prz-\ned sądcm\nAKTA SEJMIKOWE ZIEMI BZUDOSKO\n30\nwypłacił hi¬", 7), (1, 3, "AKTA SEJMIKOWE ZIEMI BZUDOSKO  31", 8), (1, 4, "bcrnę biało-\nczerwona dwu-\ni trzyletnie podatki.", 9), (1, 5, "Poseł.", 9)]
    got = {r.par_n: (r.last_par_n, r.text) for r in ocr.continuous_text(rows(CLEAN + scans), editions).collect()}
    assert got[1] == (1, "Laudum") and got[5] == (5, "Poseł.")
    assert got[2][0] == 4 and got[2][1].startswith("Poseł przed sądem wypłacił hibernę biało-")


def test_nothing(rows, editions):
    assert _noise(rows, editions, []) == set()
    assert ocr.continuous_text(rows([]), editions).count() == 0
    assert _noise(rows, editions, [(1, 2, "słowo", -1)]) == set()


def _misread(rng, word, times):
    """A word with so many of the listed confusions in it."""
    places = [(i, len(printed), read) for read, of in ocr.CONFUSIONS.items() for printed in of for i in range(len(word)) if word[i] == printed]
    for i, n, read in sorted(rng.sample(places, min(times, len(places))), reverse=True):
        word = word[:i] + read + word[i + n :]
    return word


def test_candidates_are_those_of_brute_force(spark):
    """Every pair of words whose distance is small enough meets, with one confusion and with two, of one character or more for one."""
    rng = random.Random(5)
    known = sorted({"".join(rng.choice("aceilmnostuzżśćńłbdhr") for _ in range(rng.randint(3, 9))) for _ in range(120)})
    read = {n: [_misread(rng, w, n) for w in known] for n in (1, 2)}
    doubtful = sorted({w for ws in read.values() for w in ws} - set(known))
    words = spark.createDataFrame([*((w, 50, 0) for w in known), *((w, 0, 1) for w in doubtful)], "word string, n_clean long, n_scanned long")
    none = spark.createDataFrame([], "joined string")
    got = {(r.word, r.repair): r.cost for r in ocr.repairs(words, words, none).collect() if r.n}
    weights = ocr.listed()  # too few words to learn from
    want = {(w, k): c for w in doubtful for k in known if (c := ocr.misreading_cost(w, k, weights)) <= ocr.MOST}
    assert got == want
    for n, ws in read.items():
        met = [(w, k) in got for w, k in zip(ws, known) if w != k and w in doubtful and ocr.misreading_cost(w, k, weights) <= ocr.MOST]
        assert len(met) > 60 and all(met), n


def test_confusions_are_learnt_from_the_words(spark):
    rng = random.Random(6)
    known = sorted({"".join(rng.choice("abdegklmnoprst") for _ in range(8)) for _ in range(300)})
    read = [(w.replace("g", "y"), 1) for w in known if w.count("g") == 1 and "y" not in w]
    got = ocr.learnt(spark.createDataFrame([(w, 40) for w in known], "word string, n long"), spark.createDataFrame(read, "word string, own long"))
    assert set(got) == {"y"} and set(got["y"]) == {"g"} and ocr.CONFUSED < got["y"]["g"] <= ocr.MOST


def test_long_words_and_lines_are_taken_as_they_are(rows, editions):
    long = "ą" * 5000
    scans = [(1, 2, f"{long} przcd\n{'AKTA   SEJMIKOWE' + ' ' * 200 + 'ZIEMI BZUDOSKO'}\n{'słowo ' * 400}", 7)]
    got = _noise(rows, editions, [(9, 2, "przed przed przed " * 3)] + scans)
    assert got == {(1, 2, 1, "char"), (1, 2, 2, "header")}


def test_a_word_goes_on_however_many_rows_of_noise_are_between(rows, editions):
    scans = [(1, 2, "Poseł wypła-", 7), *[(1, n, "AKTA SEJMIKOWE ZIEMI BZUDOSKO", 7) for n in range(3, 9)], (1, 9, "cił podatki", 7)]
    got = _noise(rows, editions, CLEAN + scans)
    assert (1, 2, 1, "hyphen") in got
    assert [r.text for r in ocr.continuous_text(rows(CLEAN + scans), editions).collect()] == ["Poseł wypłacił podatki"]
