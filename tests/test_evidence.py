"""The core plan with a second engine's tokens, a second look at missing ends, other codes, dates and stated sizes: a sheet for each case."""

import re

import pytest

from concord.plans import assess, evidence

RULES = "sheet_id string, rule_id string, title string, `constraint` string, original string, text string"
BOX = "box struct<x:double,y:double,w:double,h:double>"
WORDS = f"sheet_id string, word_ix int, pass string, text string, confidence double, {BOX}"
TEXT = "хранить в сухом прохладном месте без света"


def line(s, text, weak=(), y=0.1, x=0.1, conf=95.0, at=0, name="a", step=0.1):
    return [(s, at + i, name, t, 60.0 if t in weak else conf, (x + step * i, y, 0.09, 0.02)) for i, t in enumerate(text.split())]


@pytest.fixture(scope="module")
def judged(spark):
    rules, first, second, probes = [], [], [], []

    def case(s, one, two=None, weak=(), text=TEXT, title="Прочее", sizes=""):
        rules.append((s, "r", title, sizes, text, text))
        first.extend(line(s, one, weak))
        if two:
            second.extend(line(s, two, name="z"))

    case("weak", TEXT.replace("месте", "мести"), TEXT, weak=("мести",))  # weakly misread: the second engine's reading resolves it
    case("sure", TEXT.replace("месте", "мести"), TEXT)  # surely read otherwise: disputed
    case("both", TEXT.replace("месте", "мести"), TEXT.replace("месте", "мести"))  # both alike: a difference
    # a word missing between its neighbours, which stand beside each other: held to be absent until the second engine reads it there
    case("gap", "")
    case("gap2", "")
    for s in ("gap", "gap2"):
        close = [(t, 0.1 + 0.1 * i) for i, t in enumerate("хранить в сухом".split())] + [("месте", 0.4), ("без", 0.5), ("света", 0.6)]
        first += [(s, i, "a", t, 95.0, (x, 0.1, 0.09, 0.02)) for i, (t, x) in enumerate(close)]
    second += [("gap2", i, "z", t, 95.0, (0.1 + 0.075 * i, 0.1, 0.07, 0.02)) for i, t in enumerate(TEXT.split())]
    far = line("away", TEXT, y=0.7, name="z")
    case("away", TEXT.replace("месте", "мести"), weak=("мести",))  # the second engine's reading stands elsewhere
    second += far
    # ends that were not read: examined and blank, examined and read, not examined, blank but printed elsewhere
    short = "хранить в сухом прохладном месте"
    for s in ("blank", "seen", "unseen", "elsewhere", "other"):
        case(s, short)
    first.extend(line("elsewhere", "без света", y=0.8, at=90, name="b"))
    # other codes
    code = "Свидетельство номер 46001234"
    case("code", "прочее 11112222 свидетельство номер 77009999 конец", text=code)
    case("own", "свидетельство номер 46001234", text=code)
    case("behind", "номер 46001234 11118888 и свидетельство", text="Свидетельство изделия номер 46001234")
    # a date's caption and its digits
    case("date", "годен до", text="Годен до", title="Окно даты")
    first.extend([("date", 50, "a", "12.05.2031", 95.0, (0.31, 0.1, 0.1, 0.02)), ("date", 51, "a", "4600123456789", 95.0, (0.31, 0.13, 0.1, 0.02)), ("date", 52, "a", "99", 40.0, (0.31, 0.12, 0.1, 0.02))])
    # sizes that the sheet itself states
    case("stated", "вода", text="вода", title="Предупреждение", sizes="площадь не менее 10 %")
    case("differs", "вода", text="вода", title="Предупреждение", sizes="площадь не менее 10 %")
    kinds = spark.createDataFrame(rules, RULES), spark.createDataFrame(first, WORDS), spark.createDataFrame(second, WORDS)
    places = assess.to_read_again(kinds[0], kinds[1])
    for r in places.filter("sheet_id IN ('blank', 'seen', 'elsewhere', 'other')").collect():
        text = {"seen": "без света", "other": "состав изделия"}.get(r.sheet_id, "")
        for k, a in enumerate(r.areas):
            probes.append((r.sheet_id, len(probes), (a.x, a.y, a.w, a.h), r.rotation, not text or (r.sheet_id == "other" and k > 0), text, 95.0))
    measured = spark.createDataFrame([("differs", "r", 0, 20.0, 0.1)], "sheet_id string, rule_id string, check_ix int, value double, step double")
    stated = spark.createDataFrame([("stated", "r", 0, 12.0, "high"), ("stated", "r", 0, 3.0, "low"), ("differs", "r", 0, 11.0, "medium")], "sheet_id string, rule_id string, check_ix int, value double, level string")
    out = assess.assess(kinds[0], kinds[1], second=kinds[2], measured=measured, stated=stated, probes=spark.createDataFrame(probes, f"sheet_id string, probe_ix int, {BOX}, rotation int, blank boolean, text string, confidence double"))
    return {r.sheet_id: r for r in out.collect()}, {r.sheet_id: (r.side, r.expected) for r in places.collect()}


def test_second_engine_token_by_token(judged):
    rows, _ = judged
    got = {s: (rows[s].comparison, rows[s].sure, rows[s].resolved, rows[s].contradicted, rows[s].disputed) for s in ("weak", "sure", "both", "gap", "gap2", "away")}
    assert got == {
        "weak": ("found", False, 1, 0, 0), "sure": ("uncertain", False, 0, 0, 1), "both": ("partial", True, 0, 0, 0), "gap": ("partial", True, 0, 0, 0), "gap2": ("uncertain", False, 0, 1, 0), "away": ("uncertain", False, 0, 0, 0),
    }


def test_second_look_at_missing_ends(judged):
    rows, places = judged
    assert all(places[s] == ("trailing", ["без", "света"]) for s in ("blank", "seen", "unseen", "elsewhere", "other"))
    got = {s: (rows[s].comparison, rows[s].sure, rows[s].edges) for s in ("blank", "seen", "unseen", "elsewhere", "other")}
    assert got == {"blank": ("partial", True, 1), "seen": ("uncertain", False, 0), "unseen": ("uncertain", False, 0), "elsewhere": ("uncertain", False, 0), "other": ("partial", True, 1)}


def test_codes_dates_and_stated_sizes(judged):
    rows, _ = judged
    assert rows["code"].code == "77009999" and rows["own"].code is None and rows["own"].comparison == "found" and rows["behind"].code is None
    assert rows["code"].comparison == "partial" and rows["code"].sure
    assert rows["date"].date == "12.05.2031" and rows["weak"].date is None
    assert (rows["stated"].declared, rows["stated"].contradicted_sizes, rows["stated"].sizes_missed) == (1, 0, 0)
    assert (rows["differs"].declared, rows["differs"].contradicted_sizes) == (0, 1)


def ranked(expected, readings):
    """The rule word by word: (pass, code) of the best evidence."""
    codes = list(re.finditer(r"\d{6,}(?:[.-]\d+)*", expected))
    if len(codes) != 1:
        return None
    caption = [w.lower() for w in re.findall(r"[^\W\d_]{2,}", expected[: codes[0].start()])[-2:]]
    best = []
    for name, words in readings:
        text = " ".join(w for w, _ in words)
        for i, c in enumerate(re.finditer(r"\d{6,}(?:\s*[.-]\s*\d+)*", text)):
            code = re.sub(r"\s+", "", c[0])
            before = text[max(0, c.start() - 80) : c.start()].lower()
            seen = [w for w in caption if w in before]
            word = next((x for x in words if re.match(r"\d{6,}", c[0])[0] in x[0]), None)
            if code == codes[0][0] or not seen or word is None:
                continue
            between = before[max(before.rindex(w) + len(w) for w in seen) :]
            if not re.search(r"\d{6,}", between):
                best.append((-(100 * len(seen) + word[1] + 2 * len(code) - len(between)), name, i, code))
    return min(best)[3] if best else None


def test_ranking_of_codes(spark):
    import random

    r = random.Random(4)
    pool = ["номер", "сертификат", "гост", "масса", "123456", "7654321", "55667788", "12", ".", "-", "знак"]
    texts = ["Сертификат номер 123456", "Гост 7654321", "масса 12", "Знак номер 123456 и 7654321", "999999 без слов", "номер: 55667788"]
    rules, reads, plain = [], [], {}
    for i in range(60):
        e = r.choice(texts)
        passes = [(f"p{k}", [(r.choice(pool), float(r.randrange(40, 100))) for _ in range(r.randrange(1, 14))]) for k in range(2)]
        rules.append((str(i), "r", e))
        reads += [(str(i), n, " ".join(w for w, _ in words), words) for n, words in passes]
        plain[str(i)] = ranked(e, passes)
    out = evidence.code_evidence(spark.createDataFrame(rules, "sheet_id string, rule_id string, expected string"), spark.createDataFrame(reads, "sheet_id string, pass string, reading string, said array<struct<text:string,confidence:double>>"))
    got = {x.sheet_id: x.code for x in out.collect()}
    assert got == {k: v for k, v in plain.items() if v} and len(got) > 10
