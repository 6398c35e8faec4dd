"""Text statistics and the distance from prose: fitted on a corpus of few templates, tried on other texts and languages."""

import random

import numpy as np
import pytest

from chronoweave.llm import quality

THINGS = "pump seal filter gauge chamber valve sensor controller heater nozzle window line".split()
TEMPLATES = (
    "We checked the {a} first because the same alarm had come up before the {b} was changed.",
    "Nothing unusual was seen on the {a}, although the {b} was a little warmer than it had been last week.",
    "After the {a} had been cleaned, the reading of the {b} went back to {n} within an hour and stayed there.",
    "Could you please ask the night shift whether anybody has touched the {a} since the {b} was opened?",
    "It looks like a worn {a} was behind the shift, but nobody has confirmed it yet, so the {b} will be watched.",
    "The {b} will be replaced on Monday if the {a} is not stable by then.",
)
GERMAN = (
    "Die Ursache ist noch nicht bestätigt, aber vieles spricht für eine gealterte Dichtung an der {n}. Pumpe.",
    "Wir haben zuerst den Filter geprüft, weil derselbe Alarm schon am Montag aufgetreten war.",
    "Nach dem Wechsel lag der Wert wieder bei {n}, und seitdem läuft die Anlage ohne jede Auffälligkeit.",
    "Bitte achtet darauf, dass der Druck nicht noch einmal über die Grenze steigt, die wir vereinbart haben.",
)
PROSE = {
    "en": "It was late when the travellers reached the village, and only one lamp was still burning. Nobody spoke until the door had been closed behind them, for the wind had taken the last of their breath.",
    "fr": "La pluie est tombée toute la nuit sur le port. Les pêcheurs sont rentrés tôt, sans rien dans leurs filets, et personne ne s'est plaint parce que tout le monde se souvenait d'hivers bien pires.",
    "es": "La lluvia cayó durante toda la noche sobre el puerto. Los pescadores volvieron temprano y nadie se quejó, porque todos se acordaban de inviernos mucho peores.",
    "pl": "Deszcz padał przez całą noc nad portem. Rybacy wrócili wcześnie i nikt się nie skarżył, bo wszyscy pamiętali o wiele gorsze zimy.",
    "ru": "Дождь шёл всю ночь над гаванью. Рыбаки вернулись рано, и никто не жаловался, потому что все помнили зимы гораздо хуже.",
}
TABLE = "\n".join(f"Q{i}\t{i * 7}.5\tNaN\t-\tok" for i in range(100, 140))
JUNK = {
    "table": TABLE,
    "list": "\n".join(f"- spare pump x{i}" for i in range(20)),
    "json": '{"a": {"b": 1.5, "c": [1, 2, 3]}, "d": {"e": 2.25, "f": [4, 5, 6]}}',
    "log": "\n".join(f"2024-01-03 12:00:{i:02} ERROR [main] com.foo.Bar{i} null pointer" for i in range(10)),
    "words": "river stone lamp motor green window paper glass wheel tower silver carpet engine bottle garden copper ladder pillow market thunder",
    "noise": "qwpo zxmv trwq ploi mnbv qazx wsxe dcrf vtgb yhnu jmik",
    "menu": "Home\nProducts\nContact\nLog in\nTerms of use\nPrivacy\nHelp\nAbout us",
    "broken": "T0l roo¬ ca!se §~ §o: biliev!d to be u,:ven co§0;n§, wi¬h a con!idl!ce 1f ~b§ut",
}


def corpus():
    rng = random.Random(3)

    def written(templates, n):
        return " ".join(rng.choice(templates).format(a=rng.choice(THINGS), b=rng.choice(THINGS), n=rng.randint(2, 900)) for _ in range(n))

    out = [written(TEMPLATES, rng.randint(2, 9)) for _ in range(260)] + [written(GERMAN, rng.randint(2, 6)) for _ in range(160)]
    out += [x.lower().replace(". ", "\n") for x in out[:30]]
    out += [TABLE[: rng.randint(200, 700)] for _ in range(60)] + ["\n".join(f"* {rng.choice(THINGS)} {rng.choice(THINGS)} x{i}" for i in range(rng.randint(8, 30))) for _ in range(60)]
    return out


@pytest.fixture(scope="module")
def fitted(spark):
    rows = [(i, t, "x") for i, t in enumerate(corpus())]
    stats = quality.document_statistics(spark.createDataFrame(rows, "doc_id long, text string, lang_found string")).cache()
    return stats, quality.robust_fit(stats)


def found(spark, fits, texts):
    stats = quality.document_statistics(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    return {r.doc_id for r in quality.not_prose(quality.outlierness(stats, fits)).collect()}


def test_prose_of_other_texts_and_languages_is_near_and_junk_is_far(spark, fitted):
    assert found(spark, fitted[1], [*PROSE.values(), PROSE["en"].lower().replace(". ", "\n")]) == set()
    assert found(spark, fitted[1], list(JUNK.values())) == set(range(len(JUNK)))


def test_more_than_half_decides(spark, fitted):
    prose, short = " ".join([PROSE["en"]] * 6), TABLE[: len(PROSE["en"])]
    assert found(spark, fitted[1], [prose + "\n" + short, short + "\n" + prose, PROSE["en"] + "\n" + TABLE * 2]) == {2}


def test_fit_is_robust_and_parts_add_up(fitted):
    """A fifth of the corpus is junk: the centre is that of the prose, and exactly the junk is found."""
    stats, fits = fitted
    scored = quality.outlierness(stats, fits).collect()
    assert {r.doc_id for r in scored if r.distance2 > quality.CUTOFF} == set(range(450, 570))
    assert all(abs(sum(r[f"part_{s}"] for s in quality.STATS) - r.distance2) < 1e-6 for r in scored)
    digits = quality.STATS.index("digits")
    assert fits[0].mean[digits] < 0.25 and fits[1].mean[digits] < 0.25 and quality.LANGUAGES[1] == "de"


def test_rows_without_text_and_empty_tables(spark, fitted):
    rows = [(0, None), (1, "  \n"), (2, ""), (3, "\ufeff"), (4, "x"), (5, "12 😀"), (6, "The pump is fine. " * 20000)]
    stats = quality.document_statistics(spark.createDataFrame(rows, "doc_id long, text string"))
    got = {r.doc_id: r for r in quality.outlierness(stats, fitted[1]).collect()}
    assert set(got) == {4, 5, 6} and got[6].n_words == 80000 and got[6].lang_found == "en"
    assert quality.robust_fit(stats.limit(0)) == {} and quality.not_prose(quality.outlierness(stats, {})).count() == 0


def test_language_of_the_whole_text():
    """A list first and the prose much later; a single function word by chance makes no language."""
    measured = quality.Measured(["item a1 xx\n" * 900 + PROSE["fr"], "nozzle network end-point pressure manifold thickness reflected current sheet defect"])
    assert quality.LANGUAGES[int(measured.language[measured.doc == 0][-1])] == "fr"
    assert {quality.LANGUAGES[int(x)] for x in measured.language[measured.doc == 1]} == {"other"}


def test_quantiles_of_chi_squared():
    assert abs(quality.chi2_quantile(0.95, 10) - 18.307) < 1e-3 and abs(quality.chi2_quantile(0.999, 12) - 32.909) < 1e-3
    rng = np.random.default_rng(0)
    assert abs(quality.chi2_cdf(5.0, 4) - (rng.normal(size=(200000, 4)) ** 2).sum(1).__le__(5.0).mean()) < 0.01
