"""Per-document text statistics and their robust distance from natural prose.

A text is read in passages: stretches of about ``PASSAGE`` characters, runs of short lines apart from long ones and
scripts apart from each other. Every passage gets a vector of statistics (``STATS``). Per language the mean and
covariance of prose are fitted robustly: starting at the medians and median deviations, the half of the passages that is
nearest to the current centre is averaged again until the centre rests (concentration steps of the minimum covariance
determinant), then all within the 0.975 quantile of chi-squared are averaged once more. Every passage has its Mahalanobis
distance from its language's prose. A document's distance is the median of its passages', each with the weight of its
non-blank characters: it lies beyond the cutoff if and only if passages with more than half of the characters do. The
part that each statistic has in it is reported.

Shares are transformed by the arc sine of the root, whose variance is 1 / 4n whatever the share. The mean of that
variance over all passages is the ridge of the covariance: a share of twenty words can't be known better, however even
the prose of a corpus. The fit reads all documents, as sums per language, never single rows.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from itertools import groupby

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Frequent function words of languages written with spaces (fixed values, public knowledge of the languages).
COMMON = {
    "en": "about after all also although an and another any are as at be because been before being both but by can could did do does each every for from had has have he her him his how if in into is it its just like may me more most must my near no not nothing now of off on once one only or other our out over same she should since so some still such than that the their them then there these they this those through to too under until up us was we were what when where which while who will with within would yes you your",
    "de": "aber alle als am an auch auf aus bei beim bin bis da damit das dass dem den denn der des die diese dieser dieses doch du durch ein eine einem einen einer eines er es für gegen hat hatte haben ich ihm ihn ihr im in ist ja jeder kann kein keine man mehr mit nach nicht noch nun nur ob oder ohne schon sehr sein sich sie sind so soll über um und uns unter viel vom von vor war waren was weil wenn wer werden wie wieder wir wird wo wurde wurden zu zum zur zwischen",
    "fr": "ai ainsi alors au aucun aussi autre aux avant avec avait ce cela ces cet cette chaque comme dans de des deux depuis dont du elle elles en encore est et était été être eu fait il ils je la le les leur leurs lui mais me même moins mon ne ni nos notre nous on ont ou où par pas peu plus pour quand que qui sa sans se ses si son sont sous sur tous tout très un une vers vos votre vous",
    "es": "al algo ante antes así aunque bien cada casi como con contra cual cuando de del desde donde dos durante el ella ellos en entre era es esa ese eso esta está este esto fue ha había hace han hasta hay la las le les lo los más me mi mientras muy nada ni no nos otra otro para pero poco por porque que quien se según ser si sin sobre son su sus también tan te tiene todo todos tras tu un una ya yo",
    "it": "ad al alla alle anche ancora che chi ci come con cui da dai dal dalla degli dei del della delle di dopo dove due ed era fra gli ha hanno il in io la le lei lo loro lui ma mi mio molto nei nel nella no noi non ogni per perché però più poi prima quale quando quella quello questa questo se sei senza si sia sono sopra sta stato su sua sue sul sulla suo tra tutti tutto un una uno vi",
    "pt": "ao aos até com como da das de dele depois do dos duas ela ele eles em entre era essa esse esta está este eu foi há isso já lhe mais mas me mesmo meu muito na não nas nem no nos nós os ou para pela pelo por quando que quem se sem ser seu seus só sua também te tem um uma você",
    "nl": "aan al als altijd andere ben bij daar dan dat de deze die dit doch doen door dus een en er geen haar had heb hebben heeft hem het hier hij hoe hun ik in is ja je kan maar me meer men met mij mijn moet na naar niet niets nog nu of om omdat ons ook op over te tegen toch toen tot uit uw van veel voor want waren was wat we wel werd wie wij wil worden zal ze zei zelf zich zij zijn zo zonder zou",
    "sv": "alla att av blev bli de dem den denna det detta dig din där då efter ej eller en ett för från genom ha hade han har hans hennes hon hos hur här icke ingen inte jag kan kunde man med mellan men mig min mot mycket ni nu när någon något och om oss på sedan sig sin sitt själv skulle som så till under upp ut vad var vara varför vi vid vilken än är åt över",
    "da": "af alle at blev da de dem den denne der deres det dette dig din efter eller en end er et for fra før ham han hans har havde hende her hos hun hvad hvis hvor ikke ind jeg jo kan kun man mange med meget men mig min mod ned noget nogle nu når og også om op os over på selv sig sin skal skulle som til ud under var ved vi vil ville være været",
    "pl": "albo ale ani bardzo bez bo być był była było były być co czy dla do gdy gdzie go ich ile im ja jak jako je jego jej jest jeszcze już kiedy kto która które który lub ma mi mnie może na nad nas nawet nie niej niego nic niż o od on ona oni po pod przed przez przy się są ta tak także tam te tego tej ten to tu tych tylko tym wie więc wszyscy wszystko za ze że",
    "fi": "ei eikä en ennen että he hän hänen ilman ja joka jonka jos jota joten kaikki kanssa koko koska kun kuin kuka me mikä mitä mutta myös mukaan nämä ne niin noin nyt oli olivat olla on ovat se sen sekä siinä sillä silloin sitä tai tämä tämän tuo vaan vai vaikka vain voi yli",
    "tr": "ama ancak bana bazı ben bile bir biz bu bunu bunun bütün çok çünkü da daha de değil diye en gibi göre hem hep her hiç için ile ise kadar karşı ki kim mi ne neden nasıl olan olarak oldu olduğu on ona onu onun sen siz sonra şey şu tüm var ve veya ya yani yok",
}
#: Frequent function characters of Chinese (fixed values, public knowledge of the language).
COMMON_ZH = "的了是在和有没不已经就把被也都为对于到过着从因所以而但虽然如果只要这那我你他她它们之后前先再会能可还又与或及等请将让给向由其个些每次一两三里上下才却并且吗呢吧很更最太多少什么谁怎"
#: Languages, by number: those above, Chinese (and other text in its script), and whatever has no list.
LANGUAGES = (*COMMON, "zh", "other")
ZH, OTHER = len(COMMON), len(COMMON) + 1
HAN = re.compile("[㐀-鿿豈-﫿]")
SENTENCE = re.compile(r"(?<=[。！？；])|(?<=[.!?])(?=\s|[㐀-鿿豈-﫿])")
ENDED = tuple(".!?。！？…:：;；\"”")
EDGE = " \t\u00a0\u3000\ufeff"
PASSAGE, SHORT_LINE, SHORT_CHINESE = 300, 45, 18
STATS = ("word_length", "word_spread", "letters", "digits", "symbols", "clean", "short_words", "common", "sentence_length", "ended_lines", "capitals", "line_length")
COMMON_AT = STATS.index("common")
#: Quantiles of chi-squared with as many degrees of freedom as there are statistics.
TRIM, CUTOFF_AT = 0.975, 0.999
#: Classes of characters.
BLANK, LOWER, UPPER, LETTER, FOREIGN, IDEOGRAPH, FUNCTION, DIGIT, END, QUIET, SYMBOL = range(11)


#: Function words are looked up by a polynomial hash of up to this many letters (longer than any of them).
WIDEST = 12
FACTORS = np.cumprod(np.full(WIDEST, 1_000_003, np.uint64))


def word_hashes(codes: np.ndarray, start: np.ndarray, width: np.ndarray) -> np.ndarray:
    """A hash of each word of lower-case code points; of words wider than ``WIDEST`` that of their beginning and width."""
    out = width.astype(np.uint64)
    for i in range(WIDEST):
        at = np.minimum(start + i, max(len(codes) - 1, 0))
        out += np.where(i < width, codes[at], 0).astype(np.uint64) * FACTORS[i]
    return out


@lru_cache(maxsize=1)
def function_words() -> tuple[np.ndarray, np.ndarray]:
    """The sorted hashes of all function words, and whether each is one of each language."""
    words = sorted({w for listed in COMMON.values() for w in listed.split() if len(w) > 1})  # single letters are symbols as often
    codes = np.array([ord(c) for w in words for c in w], np.uint32)
    width = np.array([len(w) for w in words])
    hashes = word_hashes(codes, np.cumsum(width) - width, width)
    order = np.argsort(hashes)
    of = np.array([[w in listed for listed in map(str.split, COMMON.values())] for w in words])
    return hashes[order], of[order]


@lru_cache(maxsize=1)
def lower_case() -> np.ndarray:
    """The lower case of every code point (of those whose lower case is one)."""
    out = np.arange(0x110000, dtype=np.uint32)
    for code in range(0x10000):
        low = chr(code).lower()
        if len(low) == 1:
            out[code] = ord(low)
    return out


@lru_cache(maxsize=1)
def character_classes() -> np.ndarray:
    """The class of every code point."""
    out = np.full(0x110000, SYMBOL, np.uint8)
    kinds = {"Ll": LOWER, "Lu": UPPER, "Lt": UPPER, "Lm": LETTER, "Lo": LETTER, "Mn": LETTER, "Mc": LETTER, "Nd": DIGIT, "Zs": BLANK, "Zl": BLANK, "Zp": BLANK, "Cc": BLANK}
    for code in range(0x10000):
        kind = kinds.get(unicodedata.category(chr(code)))
        if kind is not None:
            out[code] = FOREIGN if kind in (LOWER, UPPER, LETTER) and code >= 0x370 and not 0x1E00 <= code < 0x1F00 else kind
    for lo, hi in ((0x3040, 0x3100), (0x3400, 0xA000), (0xF900, 0xFB00), (0x20000, 0x32000)):
        out[lo:hi] = IDEOGRAPH
    for characters, kind in ((COMMON_ZH, FUNCTION), (".!?。！？…", END), (",;:，；：、'\"()-–—“”‘’„«»《》（）「」%°", QUIET), ("\ufeff", BLANK)):
        out[[ord(c) for c in characters]] = kind
    return out


def one_script(line: str) -> list[str]:
    """A line with sentences in Chinese and in another script, cut between them."""
    n = 0 if line.isascii() else len(HAN.findall(line))
    if n < 6 or len(line) - n < 60:
        return [line]
    parts = [(len(HAN.findall(p)) * 3 > len(p), p) for p in SENTENCE.split(line)]
    return ["".join(p for _, p in run) for _, run in groupby(parts, key=lambda x: x[0])]


def passages(text: str) -> list[tuple[str, float, float]]:
    """(passage, its lines, those ended by punctuation), in order. A long line in several passages counts by shares."""
    out: list[tuple[str, float, float]] = []
    last = kind = None
    han = HAN.search(text) is not None
    lines = [p.strip(EDGE) for x in text.splitlines() for p in (one_script(x) if han else (x,))]
    for line in lines:
        if not line:
            continue
        width, ended = len(line), float(line.endswith(ENDED))
        chinese = han and not line.isascii() and len(HAN.findall(line)) * 3 > width
        kind = "short" if width < SHORT_LINE and not (chinese and width >= SHORT_CHINESE) else "chinese" if chinese else "long"
        if kind == last and len(out[-1][0]) + width <= PASSAGE:
            before, n, e = out[-1]
            out[-1] = (before + "\n" + line, n + 1, e + ended)
        elif width <= 1.5 * PASSAGE:
            out.append((line, 1.0, ended))
        else:
            n, at = round(width / PASSAGE), 0
            for i in range(n):
                to = width
                if i < n - 1:
                    aim = at + (width - at) // (n - i)
                    blank = line.find(" ", aim, aim + 60)
                    to = blank if blank > 0 else aim
                if to > at:
                    out.append((line[at:to], 1 / n, ended / n))
                at = to
        last = kind if width <= PASSAGE else None
    # A single short line, or two, tell too little: they belong to what stands before. Chinese needs fewer characters.
    joined: list[tuple[str, float, float]] = []
    for piece in out:
        if joined and piece[1] < 3 and len(piece[0]) < SHORT_LINE and not (han and len(piece[0]) >= SHORT_CHINESE and HAN.search(piece[0])):
            before, n, e = joined[-1]
            joined[-1] = (before + "\n" + piece[0], n + piece[1], e + piece[2])
        else:
            joined.append(piece)
    return joined


def _runs(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edge = np.diff(np.concatenate([[0], mask.view(np.int8), [0]]))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def _angle(part: np.ndarray, whole: np.ndarray) -> np.ndarray:
    return np.arcsin(np.sqrt(np.clip(part / np.maximum(whole, 1), 0, 1)))


class Measured:
    """The passages of some texts: ``doc`` (number of the text), ``size`` (non-blank characters), ``language`` (number),
    ``values`` (a row of ``STATS`` each), ``noise`` (its sampling variance), and ``totals`` of the texts."""

    def __init__(self, texts: list[str]):
        found = [(d, *p) for d, t in enumerate(texts) for p in passages(t)]
        n = len(found)
        self.doc = np.array([f[0] for f in found], np.int64)
        lines, ended = (np.array([f[i] for f in found], float) for i in (2, 3))
        units = [f[1] for f in found]
        codes = np.frombuffer(("\n".join(units) + "\n").encode("utf-32-le", "surrogatepass"), np.uint32)
        cls = character_classes()[codes]
        unit = np.repeat(np.arange(n), [len(u) + 1 for u in units])
        per = lambda at, w=None: np.bincount(at, w, minlength=n).astype(float)
        count = np.bincount(unit * 11 + cls, minlength=n * 11).reshape(n, 11).astype(float)
        inside = lambda mask, lo, hi: (c := np.concatenate([[0], np.cumsum(mask)]))[hi] - c[lo]
        upper, alphabetic = cls == UPPER, (cls >= LOWER) & (cls <= FOREIGN)
        blank, ideograph = cls == BLANK, (cls == IDEOGRAPH) | (cls == FUNCTION)

        start, stop = _runs(alphabetic)
        width, of = (stop - start).astype(float), unit[start]
        words = per(of)
        mean = per(of, width) / np.maximum(words, 1)
        spread = np.sqrt(np.maximum(per(of, width * width) / np.maximum(words, 1) - mean * mean, 0)) / np.maximum(mean, 1)
        short = per(of, (width <= 3) & (inside(upper, start, stop) == 0))
        a, b = _runs(~blank)
        letters, odd = inside(alphabetic, a, b), inside((cls == DIGIT) | (cls == SYMBOL), a, b)
        tokens = per(unit[a])
        clean = per(unit[a], (letters > 0) & (odd == 0) & (b - a - letters <= 2) & (inside(upper, a, b) <= 1))
        hans = count[:, IDEOGRAPH] + count[:, FUNCTION]
        self.size = count[:, LOWER:].sum(1)
        chinese = hans * 2 > tokens
        runs = per(unit[_runs(ideograph)[0]])

        # A language is that of a text with two of its function words at least, of a passage with four more than the text's.
        hashes, member = function_words()
        hashed = word_hashes(lower_case()[codes], start, stop - start)
        place = np.searchsorted(hashes, hashed).clip(max=len(hashes) - 1)
        hit = np.flatnonzero(hashes[place] == hashed)
        place, at = place[hit], of[hit]
        hits = np.stack([per(at, member[place, x]) for x in range(ZH)], 1)
        kinds = np.unique(self.doc[at] * len(hashes) + place)
        different = np.stack([np.bincount(kinds // len(hashes), member[kinds % len(hashes), x], minlength=len(texts)) for x in range(ZH)], 1)
        whole = np.stack([np.bincount(self.doc, hits[:, x], minlength=len(texts)) for x in range(ZH)], 1) * (different > 1)
        hits *= (different > 1)[self.doc]
        main, own, row = whole.argmax(1)[self.doc], hits.argmax(1), np.arange(n)
        language = np.where(hits[row, own] >= hits[row, main] + 4, own, main)
        common = hits[row, language]
        foreign = count[:, FOREIGN] * 2 > count[:, LOWER : FOREIGN + 1].sum(1)
        self.language = np.where(chinese, ZH, np.where((whole.max(1)[self.doc] == 0) | foreign, OTHER, language))

        after, before = np.concatenate([cls[1:], [BLANK]]), np.concatenate([[BLANK], cls[:-1]])
        apart = (after == BLANK) | (after == QUIET) | ((after == UPPER) & (before == LOWER)) | (codes > 0x2E80)
        marks = per(unit, (cls == END) & apart & (before != BLANK) & (before != SYMBOL) & (before != END))
        latin = count[:, LOWER] + count[:, UPPER] + count[:, LETTER] + count[:, FOREIGN]
        n_words = np.where(chinese, hans / 1.7 + words, words)
        whole_lines = np.maximum(1, np.round(lines))
        sentences = np.maximum(whole_lines, marks)
        zero = np.zeros(n)
        self.values = np.stack(
            [
                np.log(np.maximum(np.where(chinese, hans / np.maximum(runs, 1), mean), 0.5)),
                np.where(chinese, zero, spread),
                _angle(latin + hans, self.size),
                _angle(count[:, DIGIT], self.size),
                _angle(count[:, SYMBOL], self.size),
                np.where(chinese, _angle(hans, self.size), _angle(clean, tokens)),
                np.where(chinese, zero, _angle(short, words)),
                np.where(chinese, _angle(count[:, FUNCTION], hans), np.where(foreign, np.nan, _angle(common, words))),
                np.log((n_words + 1) / sentences),
                _angle(ended, lines),
                np.where(chinese, zero, _angle(count[:, UPPER], latin)),
                np.log(np.maximum(self.size, 1) / np.maximum(lines, 1)),
            ],
            1,
        )
        w, t = 1 / np.maximum(n_words, 1), 1 / np.maximum(tokens, 1)
        self.noise = np.stack([w, w, t, t, t, t, w, w, 1 / sentences, 1 / whole_lines, w, 1 / whole_lines], 1) / 4
        add = lambda x: np.bincount(self.doc, x, minlength=len(texts))
        self.totals = {
            "n_words": np.round(add(n_words)).astype(np.int64),
            "mean_word_length": add(latin + np.where(chinese, hans, 0)) / np.maximum(add(n_words), 1),
            "symbol_ratio": add(count[:, SYMBOL]) / np.maximum(add(self.size), 1),
            "digit_ratio": add(count[:, DIGIT]) / np.maximum(add(self.size), 1),
            "ended_line_share": add(ended) / np.maximum(add(lines), 1e-9),
            "common_share": add(np.where(chinese, count[:, FUNCTION] / 1.7, common)) / np.maximum(add(n_words), 1),
            "n_nonblank": add(self.size).astype(np.int64),
        }


TOTALS = ("n_words long", "mean_word_length double", "symbol_ratio double", "digit_ratio double", "ended_line_share double", "common_share double", "n_nonblank long")


def document_statistics(documents: DataFrame, key: str = "doc_id", at_once: int = 1_000_000) -> DataFrame:
    """``key``, statistics of the whole text, and its passages: ``languages`` (numbers), ``sizes`` and ``stats`` (the
    vectors in a row), with the mean ``noise`` of the vectors. Null and blank texts have no passage and give no row.
    Texts are measured whole, as many together as have ``at_once`` characters."""
    kind = dict(documents.dtypes)[key]
    schema = f"`{key}` {kind}, " + ", ".join(TOTALS) + ", languages array<int>, sizes array<int>, stats array<float>, noise array<float>"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            kept = batch[[t is not None and not t.isspace() and t != "" for t in batch["text"]]]
            parts = kept.groupby(kept["text"].str.len().cumsum() // at_once, sort=False) if len(kept) else ()
            for _, part in parts:
                m = Measured(list(part["text"]))
                cut = np.searchsorted(m.doc, np.arange(1, len(part)))
                split = lambda x: np.split(x, cut)  # noqa: E731, B023
                out = pd.DataFrame({key: part[key].to_numpy(), **m.totals})
                out["languages"], out["sizes"] = split(m.language.astype(np.int32)), split(m.size.astype(np.int32))
                out["stats"] = [x.ravel() for x in split(m.values.astype(np.float32))]
                out["noise"] = [np.average(x, axis=0, weights=np.maximum(s, 1)).astype(np.float32) if len(x) else np.zeros(len(STATS), np.float32) for x, s in zip(split(m.noise), split(m.size), strict=True)]
                yield out[out["n_nonblank"] > 0]

    return documents.select(key, "text").filter(F.col("text").isNotNull()).mapInPandas(run, schema)


def chi2_cdf(x: float, k: int) -> float:
    """The distribution function of chi-squared with k degrees of freedom (series of the incomplete gamma function)."""
    if x <= 0:
        return 0.0
    a, z = k / 2, x / 2
    term = total = 1 / a
    n = 1
    while term > 1e-13 * total:
        term *= z / (a + n)
        total += term
        n += 1
    return total * math.exp(a * math.log(z) - z - math.lgamma(a))


@lru_cache(maxsize=64)
def chi2_quantile(p: float, k: int) -> float:
    lo, hi = 0.0, 1000.0
    for _ in range(80):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if chi2_cdf(mid, k) < p else (lo, mid)
    return lo


CUTOFF = chi2_quantile(CUTOFF_AT, len(STATS))


class Prose:
    """Mean and covariance of a language's prose."""

    def __init__(self, mean: np.ndarray, covariance: np.ndarray, ridge: np.ndarray):
        self.mean = mean
        self.inverse = np.linalg.inv(covariance + np.diag(ridge))
        few = [i for i in range(len(mean)) if i != COMMON_AT]
        self.without_common = np.zeros_like(self.inverse)
        self.without_common[np.ix_(few, few)] = np.linalg.inv((covariance + np.diag(ridge))[np.ix_(few, few)])

    def parts(self, values: np.ndarray) -> np.ndarray:
        """Per statistic its part of the squared distance: (x - m) times the row of the inverse covariance with x - m.
        Where the common words of the script aren't known, the distance is over the other statistics."""
        gap = values - self.mean
        unknown = np.isnan(gap[:, COMMON_AT])
        gap[unknown, COMMON_AT] = 0.0
        out = gap * (gap @ self.inverse)
        if unknown.any():
            out[unknown] = gap[unknown] * (gap[unknown] @ self.without_common)
        return out


#: Fits by the number of the language, and of all languages written with words at the key -1.
Fits = dict[int, Prose]


def fit_for(fits: Fits, language: int) -> Prose | None:
    return fits.get(language, fits.get(-1) if language != ZH else None) or fits.get(-1)


def _rows(batches: Iterator[pd.DataFrame], at_once: int = 2000) -> Iterator[tuple]:
    """(text number, language, size, weight within the text, vector) of the passages, as arrays."""
    for batch in batches:
        for lo in range(0, len(batch), at_once):
            part = batch.iloc[lo : lo + at_once]
            n = part["sizes"].map(len).to_numpy()
            doc = np.repeat(np.arange(len(part)), n)
            size = np.concatenate(part["sizes"].to_numpy()).astype(float)
            values = np.concatenate(part["stats"].to_numpy()).reshape(-1, len(STATS)).astype(float)
            weight = size / np.bincount(doc, size, minlength=len(part))[doc]
            yield part, doc, np.concatenate(part["languages"].to_numpy()), size, weight, values


def _summed(stats: DataFrame, measure, width: int) -> dict[int, np.ndarray]:
    """What ``measure`` makes of the passages' vectors and weights (arrays of ``width`` numbers), summed per language and
    over all languages written with words (-1)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: dict[int, np.ndarray] = {}
        for _, _, language, _, weight, values in _rows(batches):
            words = (language < ZH).nonzero()[0]
            for group, here in [*((x, language == x) for x in np.unique(language).tolist()), *([(-1, words)] if len(words) else [])]:
                total[group] = total.get(group, 0) + measure(group, values[here], weight[here])
        for group, sums in total.items():
            cell = np.flatnonzero(sums)
            yield pd.DataFrame({"language": group, "cell": cell, "value": sums[cell]})

    rows = stats.select("languages", "sizes", "stats").mapInPandas(run, "language int, cell int, value double")
    out: dict[int, np.ndarray] = {}
    for r in rows.groupBy("language", "cell").agg(F.sum("value").alias("value")).collect():  # languages x cells
        out.setdefault(r["language"], np.zeros(width))[r["cell"]] = r["value"]
    return out


#: Grid of the histograms that give the medians, and bounds of the classes of squared distances.
GRID = np.linspace(-2.0, 14.0, 1601)
CLASSES = np.concatenate([[0.0], np.geomspace(0.5, 2000.0, 60)])
K = len(STATS)
UPPER_TRIANGLE = np.triu_indices(K)
PER_CLASS = 1 + K + len(UPPER_TRIANGLE[0])


def _histograms(_: int, values: np.ndarray, weight: np.ndarray) -> np.ndarray:
    return np.concatenate([np.histogram(np.nan_to_num(v), GRID, weights=weight)[0] for v in values.T])


def _start(histograms: np.ndarray, ridge: np.ndarray) -> Prose:
    """Medians, and median absolute deviations as standard deviations, from the histograms."""
    centre = (GRID[1:] + GRID[:-1]) / 2
    median = lambda x, w: x[o][np.searchsorted(np.cumsum(w[o]), w.sum() / 2)] if len(o := np.argsort(x)) else 0.0
    middle, spread = [], []
    for h in histograms.reshape(K, -1):
        m = median(centre, h)
        middle.append(m)
        spread.append(1.4826 * median(np.abs(centre - m), h))
    return Prose(np.array(middle), np.diag(np.square(spread)), ridge)


def _moments(fits: Fits):
    """Weight, weighted sums and sums of products of the vectors, by class of the squared distance from the fit."""

    def measure(group: int, values: np.ndarray, weight: np.ndarray) -> np.ndarray:
        if group not in fits:
            return np.zeros(len(CLASSES) * PER_CLASS)
        known = np.where(np.isnan(values), fits[group].mean, values)
        away = fits[group].parts(values).sum(1)
        one = np.zeros((len(values), len(CLASSES)))
        one[np.arange(len(values)), np.searchsorted(CLASSES, away, side="right").clip(1) - 1] = weight
        return (one.T @ np.concatenate([np.ones((len(values), 1)), known, known[:, UPPER_TRIANGLE[0]] * known[:, UPPER_TRIANGLE[1]]], 1)).ravel()

    return measure


def _nearest(sums: np.ndarray, ridge: np.ndarray, limit: float | None, keep: float = 0.5) -> Prose:
    """Mean and covariance of the classes of distances up to ``limit``, or of as few as hold ``keep`` of all weight; the
    covariance is enlarged by what the tails left out take from it (for normal vectors)."""
    sums = sums.reshape(len(CLASSES), PER_CLASS)
    share = np.cumsum(sums[:, 0]) / sums[:, 0].sum()
    last = int(np.searchsorted(CLASSES, limit, side="right")) - 1 if limit else int(np.searchsorted(share, keep - 1e-9))
    weight, *rest = sums[: last + 1].sum(0)
    mean = np.array(rest[:K]) / weight
    covariance = np.zeros((K, K))
    covariance[UPPER_TRIANGLE] = np.array(rest[K:]) / weight
    covariance = covariance + np.triu(covariance, 1).T - np.outer(mean, mean)
    if limit is None:
        p = min(0.999, float(share[last]))
        covariance *= p / chi2_cdf(chi2_quantile(p, K), K + 2)
    return Prose(mean, covariance, ridge)


def robust_fit(stats: DataFrame, max_steps: int = 12, least: float = 100.0) -> Fits:
    """Robust mean and covariance of prose per language, and at -1 over all languages written with words.

    A language keeps its own fit if it has ``least`` documents and the centre lies within the cutoff of the common one;
    others (and text without a language) take the common one. Steps end when no centre moves by a tenth of a standard
    deviation of the noise, at the latest after ``max_steps``. Only sums come to the driver: at most languages x cells.
    """
    noise = stats.agg(*[F.avg(F.col("noise")[i]).alias(str(i)) for i in range(K)]).first()
    if noise[0] is None:
        return {}
    ridge = np.array([noise[i] for i in range(K)])
    found = _summed(stats, _histograms, K * (len(GRID) - 1))
    weights = {g: h[: len(GRID) - 1].sum() for g, h in found.items()}
    fits = {g: _start(h, ridge) for g, h in found.items() if g in (-1, ZH) or weights[g] >= least and g != OTHER}
    for _ in range(max_steps):
        sums = _summed(stats, _moments(fits), len(CLASSES) * PER_CLASS)
        new = {g: _nearest(sums[g], ridge, None) for g in fits}
        moved = max((float(np.abs((new[g].mean - fits[g].mean) / np.sqrt(ridge)).max()) for g in fits), default=0.0)
        fits = new
        if moved < 0.1:
            break
    if fits:
        sums = _summed(stats, _moments(fits), len(CLASSES) * PER_CLASS)
        fits = {g: _nearest(sums[g], ridge, chi2_quantile(TRIM, K)) for g in fits}
    common = fits.get(-1)
    return {g: f for g, f in fits.items() if g in (-1, ZH) or common.parts(f.mean[None, :]).sum() <= CUTOFF}


def outlierness(stats: DataFrame, fits: Fits, key: str = "doc_id") -> DataFrame:
    """``key``, ``lang_found``, the statistics of the text, ``distance2`` and ``part_<statistic>``, which add up to it: those
    of the passage at the middle of the document's distances. Without any fit the distance is null."""
    kinds = dict(stats.dtypes)
    names = [t.split()[0] for t in TOTALS]
    schema = f"`{key}` {kinds[key]}, lang_found string, " + ", ".join(TOTALS) + ", distance2 double, " + ", ".join(f"part_{s} double" for s in STATS)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part, doc, language, size, weight, values in _rows(batches):
            parts = np.full(values.shape, np.nan)
            for lang in np.unique(language).tolist():
                fit = fit_for(fits, lang)
                if fit:
                    parts[language == lang] = fit.parts(values[language == lang])
            away = parts.sum(1)
            order = np.lexsort((away, doc))
            reached = np.cumsum(weight[order])
            before = np.searchsorted(doc[order], np.arange(len(part)))
            base = np.concatenate([[0.0], reached])[before]
            middle = order[np.searchsorted(reached, base + 0.5 - 1e-9)]
            out = part[[key, *names]].copy()
            heaviest = np.zeros((len(part), len(LANGUAGES)))
            np.add.at(heaviest, (doc, language), size)
            out.insert(1, "lang_found", [LANGUAGES[x] for x in heaviest.argmax(1)])
            out["distance2"] = away[middle]
            for i, s in enumerate(STATS):
                out[f"part_{s}"] = parts[middle, i]
            yield out

    return stats.mapInPandas(run, schema)


def not_prose(scored: DataFrame, cutoff: float = CUTOFF) -> DataFrame:
    """Documents beyond the cutoff: passages with more than half of the characters are outliers among prose."""
    return scored.filter(F.col("distance2") > cutoff)
