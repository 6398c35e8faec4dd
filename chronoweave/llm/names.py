"""Variant spellings of persons' and organisations' names linked to groups.

Names are brought to tokens without case, accents, titles, legal forms and remarks. A symmetric-delete index (the
tokens' prefixes with up to two characters deleted, as in SymSpell) finds tokens a small edit distance apart; the
names that share such a token are aligned token by token, by the assignment with the highest total, which permits
typing errors, nicknames, initials and abbreviations. Full names that agree are linked first; a name with only an
initial, an abbreviation (with its period) or fewer tokens joins a group if it fits no other of its scope as well.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoweave.llm.groups import connected_groups
from chronoweave.operators.ordered import skew_safe_lookup
from chronoweave.session import checkpointed

#: Given names and their usual short forms (fixed values, public knowledge).
NICKNAMES = {
    "alexander": "alex sasha xander sandy alec lex",
    "andrew": "andy drew",
    "anthony": "tony",
    "antonio": "toni tonio",
    "benjamin": "ben benny",
    "catherine": "cathy kate katie kitty",
    "charles": "charlie chuck chas charley",
    "christopher": "chris kit topher",
    "daniel": "dan danny",
    "david": "dave davey",
    "dmitri": "dima mitya dimitri dmitry",
    "edward": "ed eddie ted ned teddy",
    "elizabeth": "liz beth betty eliza lizzie bess libby lisbeth",
    "francisco": "paco pancho cisco kiko curro",
    "friedrich": "fritz fred frieder",
    "giuseppe": "beppe peppe pino peppino",
    "guadalupe": "lupe lupita pita",
    "hans": "hannes hansi",
    "henrietta": "hetty etta hettie hattie",
    "ingrid": "inga inge guri",
    "james": "jim jimmy jamie",
    "jennifer": "jen jenny",
    "johannes": "hans hannes",
    "john": "jack johnny",
    "jonathan": "jon jonny nathan jonty",
    "joseph": "joe joey",
    "jurgen": "jurg jorg juri",
    "katarzyna": "kasia kaska kasienka",
    "laszlo": "laci",
    "margaret": "maggie peggy peg meg greta marge madge daisy",
    "matthew": "matt matty",
    "michael": "mike mick mickey mikey micha",
    "nicholas": "nick nicky",
    "nikolaus": "klaus nik niko nico claus",
    "oluwaseun": "seun",
    "oystein": "oyst stein",
    "patricia": "pat patty trish tricia patti",
    "rene": "ren",
    "richard": "dick rick rich ricky",
    "robert": "bob rob bobby robbie bert",
    "samuel": "sam sammy",
    "stephen": "steve stevie",
    "susanne": "susi sanne susie sue sanna suse",
    "theodore": "ted theo teddy",
    "thomas": "tom tommy",
    "victoria": "vicky vic tori vicki vickie",
    "william": "bill will billy willy liam",
    "zoe": "zo",
}
#: Other given names of their own, however near to one of those above: Carlos isn't Charles (fixed values).
DISTINCT = "agnes ali anders andrea andreas anna bernd carla carlos clara christian christina diego elena emma erik eva gabriel georg gustav hanna ivan jan jana jorge juan julia julian karl karla lars laura lena luca lucia luis maria marie mario mark marta martin mohamed nina nora olga omar paul paula pedro peter petra sara simon sofia stefan sven tomas viktor yuki".split()
#: Words that aren't part of a name (fixed values).
TITLES = frozenset("dr prof mx mr mrs ms miss ing dipl phd herr frau sir".split())
LEGAL = frozenset("ltd limited llc inc incorporated gmbh gesellschaft mbh ag aktiengesellschaft co company corp corporation plc kg sa bv oy ab nv pty the and und".split())
#: Words that tell an organisation's line of business, not which one it is (fixed values).
TRADE = tuple("instruments process engineering gas delivery materials coatings precision optics systems vacuum thermal controls semiconductor services technologies solutions group holding international industries electronics components supplies chemicals automation metrology equipment software laboratories logistics consulting".split())
LETTERS = str.maketrans({"ø": "o", "ł": "l", "đ": "d", "ß": "ss", "æ": "a", "œ": "o", "ı": "i"})
OPAQUE = re.compile(r"[a-z]+\d{2,}$")
SEP, BETWEEN = "\x1f", "\x1e"
PREFIX = 8
#: Least cost of names that agree only with an initial, an abbreviation or a token left out.
LOOSE = 10
#: Forms of a key from which on it is met together with a key of another token of the name.
HOT = 50


def plain(name: str) -> str:
    """Lower-case text without width variants, accents and remarks in brackets; umlauts written ue, oe, ae lose the e."""
    text = unicodedata.normalize("NFKD", unicodedata.normalize("NFKC", name).casefold().translate(LETTERS))
    text = "".join(c for c in text if not unicodedata.combining(c))
    return re.sub(r"[\(\[].*?[\)\]]", " ", text).strip()


def letters(token: str) -> str:
    """A token with the digits read as the letters they look like."""
    return token.translate(str.maketrans("015", "ols")) if any(c.isalpha() for c in token) else token


def without_umlauts(token: str) -> str:
    """Umlauts in one spelling: ue, oe and ae lose the e."""
    return re.sub("(?<=[uoa])e", "", token)


def distance(a: str, b: str, most: int) -> int:
    """Edit distance with transpositions of neighbours, or ``most`` + 1 if it is larger."""
    if a == b:
        return 0
    if abs(len(a) - len(b)) > most:
        return most + 1
    before, last = None, list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            d = min(last[j] + 1, row[j - 1] + 1, last[j - 1] + (x != y))
            if before is not None and i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                d = min(d, before[j - 2] + 1)
            row.append(d)
        if min(row) > most:
            return most + 1
        before, last = last, row
    return min(last[-1], most + 1)


def allowed(a: str, b: str) -> int:
    """Errors permitted between two tokens: none in short ones, one from 5 letters, two from 9."""
    n = max(len(a), len(b))
    return 2 if n >= 9 else 1 if n >= 5 else 0


def deletions(token: str) -> int:
    """The most errors that ``allowed`` permits (or ``slipped``, in short tokens) between a token and any other."""
    return 2 if len(token) >= 7 else 1 if len(token) >= 4 else 0


def slipped(a: str, b: str) -> bool:
    """Whether short tokens (of 3 or 4 letters) differ by a letter put in or two swapped inside, with the ends the same."""
    swapped = len(a) == len(b) == 4 and a[1:3] == b[2:0:-1]
    return a != b and 3 <= min(len(a), len(b)) and max(len(a), len(b)) == 4 and (a[0], a[-1]) == (b[0], b[-1]) and (swapped or len(a) != len(b))


def neighbourhood(token: str, prefix: int = PREFIX, most: int = 2) -> set[str]:
    """Symmetric-delete keys: the prefix with up to ``most`` characters deleted. Tokens within that distance share one."""
    head = token[:prefix]
    n = len(head)
    return {"".join(head[i] for i in range(n) if i not in gone) for k in range(min(most, n - 1) + 1) for gone in map(set, combinations(range(n), k))} if n else set()


_FORMAL: dict[str, set[str]] = {}
_WRITTEN = {without_umlauts(_name): _name for _name in (*NICKNAMES, *DISTINCT)}
for _name, _short in (*NICKNAMES.items(), *((x, "") for x in DISTINCT)):
    for _x in (_name, *_short.split()):
        for _y in (_x, without_umlauts(_x)):
            _FORMAL.setdefault(_y, set()).add(without_umlauts(_name))


@lru_cache(maxsize=100_000)
def givens(token: str) -> frozenset[str]:
    """The given names that a token may stand for: itself, a nickname or a misspelling of one; empty if it is none.

    One error is permitted from 4 letters, two in names of 6 if at least 5 letters are there; the nearest names count.
    """
    for spelt in (token, without_umlauts(token)):
        if spelt in _FORMAL:
            return frozenset(_FORMAL[spelt])
    best, found = 3, set()
    for known, names in _FORMAL.items():
        most = 2 if len(token) >= 5 and len(known) >= 6 else 1
        if min(len(known), len(token)) < 4:
            continue
        d = distance(token, known, min(best, most))
        if d <= min(best, most):
            if d < best:
                best, found = d, set()
            found |= names
    return frozenset(found)


def canonical(token: str) -> str:
    """A token in one spelling: an exact short form of one given name as that name; short tokens keep all letters."""
    names = _FORMAL.get(token, ())
    if len(names) == 1:
        return _WRITTEN[next(iter(names))]
    return token if names or len(token) <= 4 else without_umlauts(token)


def parse_person(name: str) -> tuple[str, str, str]:
    """(kind, given, surname): ``full``; ``weak`` with an initial or the names an ambiguous nickname stands for;
    ``handle`` with an opaque account name as surname; ``none`` if nothing is left of the name."""
    return read_person(name)[:3]


def abbreviated(text: str) -> set[str]:
    """The tokens that end with the period of an abbreviation."""
    return set(re.findall(r"([^\s,._/]+)\.(?=[\s,]|$)", text))


def read_person(name: str) -> tuple[str, str, str, list[str]]:
    """``parse_person`` and the tokens of the name in no order, which hold whichever of them is the given name; an
    abbreviation keeps its period."""
    text = plain(name)
    comma = "," in text
    raw = [t for t in re.split(r"[\s,._/]+", text) if t]
    if len(raw) == 1 and OPAQUE.match(raw[0]):
        return "handle", "", raw[0], []
    short_form = {letters(t.strip("-'’`")) for t in abbreviated(text)}
    tokens = [letters(t.strip("-'’`")) for t in raw if t.strip("-'’`.") not in TITLES]
    tokens = [t for t in tokens if t and any(c.isalpha() for c in t)]
    long = [t for t in tokens if len(t) > 1]
    short = [t for t in tokens if len(t) == 1]
    if not long:
        return "none", "", "", []
    if len(long) == 1:
        token = long[0]
        if short:
            return "weak", short[0], without_umlauts(token), [short[0], without_umlauts(token)]
        if len(token) > 4 and not givens(token):
            return "weak", token[0], without_umlauts(token[1:]), [token[0], without_umlauts(token[1:])]
        return "none", "", "", []
    known = [t for t in long if givens(t)]
    exact = [t for t in known if t in _FORMAL]
    given = (exact or known or [long[-1] if comma else long[0]])[-1 if comma else 0]
    if len(known) == len(long) and not exact:
        given = long[-1] if comma else long[0]
    rest = list(long)
    rest.remove(given)
    surname = without_umlauts("".join(rest))
    names = sorted(givens(given)) or [without_umlauts(given)]
    tokens = sorted(canonical(t) + "." * (t in short_form and t not in _FORMAL) for t in long)
    return ("full", names[0], surname, tokens) if len(names) == 1 else ("weak", "|".join(names), surname, tokens)


def trade_word(token: str) -> str | None:
    """The line of business a token names, in full, abbreviated (letters of the word in order) or misspelt."""
    for word in TRADE:
        if token == word:
            return word
    for word in TRADE:
        if len(token) >= 6 and distance(token, word, 2) <= (2 if len(word) >= 8 else 1):
            return word
    if 2 <= len(token) <= 6:
        found = []
        for word in TRADE:
            at = iter(word)
            if token[0] == word[0] and len(token) < len(word) and all(c in at for c in token):
                found.append((not word.startswith(token), word))
        if found:
            return min(found)[1]
    return None


def parse_organisation(name: str) -> tuple[str, str, str]:
    """(kind, lines of business, brand): ``full``, ``handle`` for a code of letters and digits, or ``none``. The reading
    with as many trade words as possible."""
    return read_organisation(name)[0][:3]


def read_organisation(name: str) -> list[tuple[str, str, str, list[str]]]:
    """The readings of a name: kind, lines of business, brand and its tokens. A token that isn't spelt as a trade word
    may be part of the brand (Intel, TEL) or a trade word; with more than 6 such tokens all, none or all but one of
    them are trade words. A name of trade words alone is its own brand."""
    text = plain(name)
    raw = [t for t in re.split(r"[\s,._/&+-]+", text) if t]
    if len(raw) == 1 and OPAQUE.match(raw[0]):
        return [("handle", "", raw[0], [])]
    tokens = [letters(t) for t in raw if t not in LEGAL]
    short_form = set(map(letters, abbreviated(text)))
    trade = [trade_word(t) for t in tokens]
    unsure = [i for i, t in enumerate(tokens) if trade[i] not in (None, t)]
    sizes = range(len(unsure) + 1) if len(unsure) <= 6 else (0, 1, len(unsure))
    out = []
    for kept in (set(c) for n in sizes for c in combinations(unsure, n)):
        brand = [t for i, t in enumerate(tokens) if trade[i] is None or i in kept]
        lines = {w for i, w in enumerate(trade) if w and i not in kept}
        if brand:
            marked = sorted(without_umlauts(t) + "." * (t in short_form) for t in brand)
            out.append(("full", "|".join(sorted(lines)), without_umlauts("".join(brand)), marked))
    if tokens and not out:
        out.append(("full", "", without_umlauts("".join(tokens)), sorted(map(without_umlauts, tokens))))
    return out or [("none", "", "", [])]


def agreement(a: str, b: str) -> float:
    """How well two tokens agree: 3 equal, 2.5 the same given name, 2 within the allowed errors, 1.5 an abbreviation,
    1 an initial, 0 not at all."""
    if a == b:
        return 3.0
    if len(a) == 1 or len(b) == 1:
        return 1.0 if a[:1] == b[:1] else 0.0
    if givens(a) & givens(b):
        return 2.5
    if a in _FORMAL and b in _FORMAL:  # two given names, however alike
        return 0.0
    if distance(a, b, 2) <= allowed(a, b) or slipped(a, b):
        return 2.0
    short, full = sorted((a, b), key=len)
    return 1.5 if len(short) >= 3 and full.startswith(short) else 0.0


def align(a: list[str], b: list[str]) -> tuple[float, list[tuple[int, int]]]:
    """The assignment of tokens of ``a`` to tokens of ``b`` with the highest total agreement (at most 10 tokens each)."""
    best: dict[int, tuple[float, list[tuple[int, int]]]] = {0: (0.0, [])}
    for i, x in enumerate(a[:10]):
        new = dict(best)
        for used, (score, pairs) in best.items():
            for j, y in enumerate(b[:10]):
                if not used >> j & 1 and (s := agreement(x, y)) > 0:
                    at = used | 1 << j
                    if at not in new or new[at][0] < score + s:
                        new[at] = (score + s, [*pairs, (i, j)])
        best = new
    return max(best.values(), key=lambda v: v[0])


def agree(kind: str, given_a: str, sur_a: str, given_b: str, sur_b: str) -> int:
    """Errors between two names that may be the same, -1 if they can't be. Person: all tokens must be assigned; an
    ambiguous given name agrees with each of its readings. Organisation: brands agree, and the lines of business of
    one are among those of the other."""
    if distance(sur_a, sur_b, 2) > allowed(sur_a, sur_b):
        return -1
    if kind == "organization":
        x, y = set(given_a.split("|")) - {""}, set(given_b.split("|")) - {""}
        return distance(sur_a, sur_b, 2) if x <= y or y <= x else -1
    for x in given_a.split("|"):
        for y in given_b.split("|"):
            _, pairs = align([x, sur_a], [y, sur_b])
            if sorted(pairs) == [(0, 0), (1, 1)]:
                return distance(sur_a, sur_b, 2)
    return -1


def agree_tokens(a: list[str], b: list[str]) -> int:
    """Errors between the tokens of two persons' names, in any order, -1 if they can't be the same: each token of one
    is assigned to one of the other, as equal, misspelt or (one of them) the same given name. A slip in a short token
    counts if all others are equal."""
    if len(a) != len(b) or len(a) < 2:
        return -1
    a, b = ([t.rstrip(".") for t in x] for x in (a, b))
    pairs = [(a[i], b[j]) for i, j in align(a, b)[1]]
    scores = [agreement(x, y) for x, y in pairs]
    off = [distance(x, y, 2) for x, y in pairs]
    if len(pairs) < len(a) or min(scores) < 2:
        return -1
    far = sum(d > allowed(x, y) for d, (x, y) in zip(off, pairs, strict=True))  # by nickname or slip only
    if far > 1 or any(slipped(x, y) and sum(off) > 1 for x, y in pairs):
        return -1
    return sum(d for d, score in zip(off, scores, strict=True) if score == 2)


def agree_loosely(kind: str, lines_a: str, a: list[str], lines_b: str, b: list[str]) -> int:
    """``LOOSE`` and more if each token of ``a`` is assigned to one of the same or a longer name ``b``, as equal, misspelt,
    an initial or an abbreviation with its period; -1 if not. Persons agree in another token besides; organisations in
    a brand token, or in the lines of business if the brand is abbreviated."""
    plain_a, plain_b = ([t.rstrip(".") for t in x] for x in (a, b))
    pairs = align(plain_a, plain_b)[1] if len(a) <= len(b) else []
    if not pairs or len(pairs) < len(a):
        return -1
    scores = [agreement(plain_a[i], plain_b[j]) for i, j in pairs]
    gaps = [(distance(plain_a[i], plain_b[j], 2), allowed(plain_a[i], plain_b[j])) for i, j in pairs]
    nicknames = sum(score == 2.5 and d > most for score, (d, most) in zip(scores, gaps, strict=True))
    if any(score == 1.5 and not (a[i].endswith(".") and len(plain_a[i]) < len(plain_b[j])) for score, (i, j) in zip(scores, pairs, strict=True)):
        return -1
    if kind == "person" and (len(a) < 2 or max(scores) < 2 or nicknames > 1):
        return -1
    if kind == "organization":
        x, y = set(lines_a.split("|")) - {""}, set(lines_b.split("|")) - {""}
        if nicknames or min(scores) < 1.5 or not (x <= y or y <= x) or (max(scores) < 2 and not x & y):
            return -1
    cut = sum(score == 1.5 and b[j].endswith(".") for score, (_, j) in zip(scores, pairs, strict=True))  # rather a whole token
    return LOOSE + int(2 * (3 * len(a) - sum(scores))) + cut


FORM = "form string, scope string, kind string, form_kind string, given string, surname string, tokens string"


def name_forms(entities: DataFrame, aliases: DataFrame) -> DataFrame:
    """``entity_id`` with every form of its names: FORM. Blank and unreadable names have none."""
    who = entities.filter(F.col("entity_type").isin("person", "organization") & F.col("entity_id").isNotNull() & F.col("scope").isNotNull())
    who = who.groupBy("entity_id").agg(F.min("scope").alias("scope"), F.min("entity_type").alias("kind"))
    names = entities.select("entity_id", F.col("canonical_name").alias("name")).unionByName(aliases.select("entity_id", F.col("alias").alias("name"))).filter(F.col("name").isNotNull()).distinct()
    met = skew_safe_lookup(names, who, ["entity_id"], how="inner")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for entity, name, scope, kind in zip(batch["entity_id"], batch["name"], batch["scope"], batch["kind"], strict=True):
                for form_kind, given, surname, tokens in [read_person(name)] if kind == "person" else read_organisation(name):
                    if form_kind != "none":
                        words = BETWEEN.join(tokens)
                        out.append((entity, SEP.join((scope, kind, form_kind, given, surname, words)), scope, kind, form_kind, given, surname, words))
            yield pd.DataFrame(out, columns=["entity_id", "form", "scope", "kind", "form_kind", "given", "surname", "tokens"])

    return met.select("entity_id", "name", "scope", "kind").mapInPandas(run, "entity_id string, " + FORM).distinct()


def token_keys(kind: str, surname: str, tokens: list[str]) -> list[tuple[int, str]]:
    """(number of the token, key): the symmetric-delete keys of every token, given names too, and of a surname of
    several tokens as one; the given names a token stands for; initials and beginnings."""
    out = []
    tokens = [t.rstrip(".") for t in tokens]
    for no, token in enumerate([*tokens, surname] if surname not in tokens else tokens):
        names = givens(token) if kind == "person" else ()
        keys = neighbourhood(token, most=deletions(token)) | {"=" + x for x in names} | ({"<" + token[:3]} if len(token) >= 3 else set())
        keys |= {"^" + x[0] for x in (token, *names)} if kind == "person" else set()
        out += [(no, key) for key in keys]
    return out


def indexed(forms: DataFrame) -> DataFrame:
    """``form``, ``key``: the keys at which forms of a scope and kind meet.

    Names of persons agree in two tokens at least, so a key with more than ``HOT`` forms (a frequent given name) is met
    with a key of another token: two names that share no rarer key share such a pair.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for form, scope, kind, surname, tokens in zip(*(batch[c] for c in ("form", "scope", "kind", "surname", "tokens")), strict=True):
                out += [(form, kind, no, SEP.join((scope, kind, key))) for no, key in token_keys(kind, surname, tokens.split(BETWEEN))]
            yield pd.DataFrame(out, columns=["form", "kind", "no", "key"])

    def couples(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = set()
            for form, keys in zip(batch["form"], batch["keys"], strict=True):
                out |= {(form, SEP.join(sorted((x["key"], y["key"])))) for x, y in combinations(keys, 2) if x["no"] != y["no"]}
            yield pd.DataFrame(sorted(out), columns=["form", "key"])

    keys = checkpointed(forms.select("form", "scope", "kind", "surname", "tokens").mapInPandas(run, "form string, kind string, no int, key string"))
    many = keys.filter(F.col("kind") == "person").groupBy("key").agg(F.count_distinct("form").alias("n")).filter(F.col("n") > HOT).select("key")
    single = keys.join(many, "key", "left_anti").select("form", "key")
    hot = keys.join(many, "key", "left_semi").groupBy("form").agg(F.collect_list(F.struct("no", "key")).alias("keys"))
    return checkpointed(single.unionByName(hot.mapInPandas(couples, "form string, key string")).distinct())


def similar_forms(left: DataFrame, right: DataFrame, keys: DataFrame) -> DataFrame:
    """``a``, ``b``, ``errors``: forms of left and right that agree. With the same frame on both sides each pair
    once; loose ones (``LOOSE`` errors and more) with the name that is the shorter as ``a``.

    ``keys`` are those of all forms (``indexed``); pairs met at several keys are verified once.
    """
    same = left is right
    x = keys.join(left.select("form"), "form", "left_semi").withColumnRenamed("form", "a")
    y = keys.join(right.select("form"), "form", "left_semi").withColumnRenamed("form", "b")
    pairs = x.join(y, "key").filter(F.col("a") < F.col("b") if same else F.col("a") != F.col("b")).select("a", "b").distinct()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for a, b in zip(batch["a"], batch["b"], strict=True):
                _, kind, _, ga, sa, ta = a.split(SEP)  # a form tells all that is known of it
                _, _, _, gb, sb, tb = b.split(SEP)
                errors, la, lb = agree(kind, ga, sa, gb, sb), ta.split(BETWEEN), tb.split(BETWEEN)
                if errors < 0 and kind == "person":
                    errors = agree_tokens(la, lb)
                if errors >= 0:
                    out.append((a, b, errors))
                    continue
                there, back = agree_loosely(kind, ga, la, gb, lb), agree_loosely(kind, gb, lb, ga, la)
                if same:
                    out += [(x, y, cost) for x, y, cost in ((a, b, there), (b, a, back)) if cost >= 0]
                elif max(there, back) >= 0:
                    out.append((a, b, max(there, back)))
            yield pd.DataFrame(out, columns=["a", "b", "errors"])

    return pairs.mapInPandas(run, "a string, b string, errors int")


def the_best(fits: DataFrame) -> DataFrame:
    """``a``, ``group_id``: the group with the fewest errors of each ``a``, if it is the only one with so few."""
    least = fits.groupBy("a", "group_id").agg(F.min("errors").alias("errors")).groupBy("a", "errors").agg(F.count(F.lit(1)).alias("n"), F.min("group_id").alias("group_id"))
    best = least.groupBy("a").agg(F.min(F.struct("errors", "n", "group_id")).alias("best"))
    return best.filter(F.col("best.n") == 1).select("a", F.col("best.group_id").alias("group_id"))


def link_names(entities: DataFrame, aliases: DataFrame) -> DataFrame:
    """``entity_id`` and ``group_id`` (its smallest entity_id) of the persons and organisations that have variants.

    All names of one entity name the same. Entities in different scopes or of different types are never linked. Rows
    that repeat an entity count once; null and blank names are ignored; empty tables give no rows.
    """
    held = checkpointed(name_forms(entities, aliases))
    entity = F.concat(F.lit("e"), "entity_id")
    node = F.concat(F.lit("f"), "form")
    strong = held.filter(F.col("form_kind") != "weak")
    full = checkpointed(held.filter(F.col("form_kind") == "full").drop("entity_id").distinct())
    keys = indexed(held.filter(F.col("form_kind") != "handle").drop("entity_id").distinct())
    edges = strong.select(entity.alias("a"), node.alias("b"))
    of_full = checkpointed(similar_forms(full, full, keys))
    alike = of_full.filter(F.col("errors") < LOOSE).select(F.concat(F.lit("f"), "a").alias("a"), F.concat(F.lit("f"), "b").alias("b"))
    edges = checkpointed(edges.unionByName(alike))
    first = checkpointed(connected_groups(edges, "a", "b"))
    group_of = first.select(F.substring("id", 2, 1_000_000).alias("form"), "group_id")

    # Groups whose names agree with others only loosely join one if no other group fits as well.
    loose = of_full.filter(F.col("errors") >= LOOSE).join(group_of.select(F.col("form").alias("a"), F.col("group_id").alias("own")), "a").join(group_of.withColumnRenamed("form", "b"), "b")
    joined = the_best(loose.filter(F.col("own") != F.col("group_id")).select(F.col("own").alias("a"), "group_id", "errors"))
    later = joined.select("a", F.col("group_id").alias("b"))

    # Entities without any full name, by their weak forms.
    sure = strong.filter(F.col("form_kind") == "full").select("entity_id").distinct()
    weak = held.filter(F.col("form_kind") == "weak").join(sure, "entity_id", "left_anti")
    weak_forms = checkpointed(weak.drop("entity_id").distinct())
    met = checkpointed(similar_forms(weak_forms, full, keys).join(group_of.withColumnRenamed("form", "b"), "b").select("a", "group_id", "errors"))
    chosen = checkpointed(the_best(met))
    to_group = weak.join(chosen.withColumnRenamed("a", "form"), "form").select(entity.alias("a"), F.col("group_id").alias("b"))
    lone = checkpointed(weak_forms.join(met.filter(F.col("errors") < LOOSE).select("a").unionByName(chosen.select("a")).distinct().withColumnRenamed("a", "form"), "form", "left_anti"))
    among = similar_forms(lone, lone, keys).filter(F.col("errors") < LOOSE).select(F.concat(F.lit("f"), "a").alias("a"), F.concat(F.lit("f"), "b").alias("b"))
    own = weak.join(lone.select("form"), "form", "left_semi").select(entity.alias("a"), node.alias("b"))
    # What comes later only joins groups: the second run is over the groups of the first, not over all links again.
    later = later.unionByName(to_group).unionByName(among).unionByName(own)
    for end in ("a", "b"):
        later = later.join(first.select(F.col("id").alias(end), F.col("group_id").alias("__g")), end, "left").withColumn(end, F.coalesce("__g", end)).drop("__g")
    second = checkpointed(connected_groups(later, "a", "b")).select(F.col("id").alias("group_id"), F.col("group_id").alias("joined"))
    known = first.filter(F.col("id").startswith("e")).join(second, "group_id", "left").select("id", F.coalesce("joined", "group_id").alias("group_id"))
    new = second.filter(F.col("group_id").startswith("e")).join(first.select(F.col("id").alias("group_id")), "group_id", "left_anti").select(F.col("group_id").alias("id"), F.col("joined").alias("group_id"))
    members = known.unionByName(new).select(F.substring("id", 2, 1_000_000).alias("entity_id"), "group_id")
    several = members.groupBy("group_id").agg(F.count(F.lit(1)).alias("n"), F.min("entity_id").alias("least")).filter(F.col("n") > 1)
    return members.join(several, "group_id").select("entity_id", F.col("least").alias("group_id"))


def name_pairs(groups: DataFrame) -> DataFrame:
    """All pairs of each group (what the query asks for), smaller id first."""
    a = groups.select("group_id", F.col("entity_id").alias("entity_id_a"))
    b = groups.select("group_id", F.col("entity_id").alias("entity_id_b"))
    return a.join(b, "group_id").filter(F.col("entity_id_a") < F.col("entity_id_b")).select("entity_id_a", "entity_id_b")
