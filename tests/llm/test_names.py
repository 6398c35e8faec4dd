"""Linking of name variants."""

import pytest

from chronoweave.llm import names


@pytest.mark.parametrize(
    ("name", "parsed"),
    [
        ("Robert Hokarzistede", ("full", "robert", "hokarzistede")),
        ("Hokarzistede, Bob", ("full", "robert", "hokarzistede")),
        ("Dr. Robetr  Hokarzistede (vendor)", ("full", "robert", "hokarzistede")),
        ("ROBERT B. HOKARZISTEDE", ("full", "robert", "hokarzistede")),
        ("robert.hokarzistede", ("full", "robert", "hokarzistede")),
        ("Hokarzistede R.", ("weak", "r", "hokarzistede")),
        ("rhokarzistede", ("weak", "r", "hokarzistede")),
        ("Ted Zokolano", ("weak", "edward|theodore", "zokolano")),
        ("JUERGEN Lonarpunmano", ("full", "jurgen", "lonarpunmano")),
        ("Ｊürgen L0narpunmano", ("full", "jurgen", "lonarpunmano")),
        ("lotrunner4149", ("handle", "", "lotrunner4149")),
        ("  ", ("none", "", "")),
        ("(vendor)", ("none", "", "")),
        ("R.", ("none", "", "")),
    ],
)
def test_persons(name, parsed):
    assert names.parse_person(name) == parsed


def test_organisations():
    whole = names.parse_organisation("Cowelmardon Semiconductor Services Co., Ltd.")
    assert whole == ("full", "semiconductor|services", "cowelmardon")
    for other in ("cowelmardon-semiconductor-services", "Semi Svcs Cowelmardon", "The COWELMARDON Semiconductor Servics Limited", "Cowel mardon Semiconductor Services"):
        assert names.parse_organisation(other) == whole
    assert names.parse_organisation("SI136") == ("handle", "", "si136")
    assert names.parse_organisation("Ltd") == ("none", "", "")


def test_distance_and_index():
    assert [names.distance(a, b, 3) for a, b in (("abc", "abc"), ("abc", "acb"), ("abcd", "abxd"), ("abc", "abcde"), ("", "abc"), ("kitten", "sitting"))] == [0, 1, 1, 2, 3, 3]
    assert names.distance("abcdef", "uvwxyz", 2) == 3
    for a, b in (("gromarpastaks", "gromaprastaks"), ("rakabulano", "rakabukano"), ("draveiduvede", "draeiduvede")):
        assert names.neighbourhood(a) & names.neighbourhood(b)
    assert names.neighbourhood("") == set()


def test_align():
    assert names.align(["r", "hokarzistede"], ["hokarzistede", "robert"])[1] == [(0, 1), (1, 0)]
    assert names.align(["bob"], ["robert"]) == (2.5, [(0, 0)])
    assert names.align([], ["x"]) == (0.0, [])
    assert names.agree("person", "r", "kavadabrou", "rene", "kavadabrou") == 0
    assert names.agree("person", "robert", "kavadabrou", "rene", "kavadabrou") == -1


def test_links(spark):
    people = [
        ("e1", "s1", "Robert Hokarzistede", "person"),
        ("e2", "s1", "Hokarzistede, Bob", "person"),
        ("e2", "s1", "Hokarzistede, Bob", "person"),
        ("e3", "s1", "Robret Hokarzitsede", "person"),
        ("e4", "s1", "rhokarzistede", "person"),
        ("e5", "s2", "Robert Hokarzistede", "person"),
        ("e6", "s1", "redstapler7622", "person"),
        ("e7", "s1", "René Kavadabrou", "person"),
        ("e8", "s1", "Robert Kavadabrou", "person"),
        ("e9", "s1", "R. Kavadabrou", "person"),
        ("f1", "s1", "P. Nodargumede", "person"),
        ("f2", "s1", "pnodargumede", "person"),
        ("g1", "s1", "Fodinuphar Precision Optics LLC", "organization"),
        ("g2", "s1", "fodinuphar-precision-optics", "organization"),
        ("g3", "s1", "Fodinuphar Gas Delivery", "organization"),
        ("h1", "s1", "Robert Hokarzistede", "equipment"),
        ("h2", "s1", None, "person"),
        ("h3", "s1", " ", "person"),
    ]
    entities = spark.createDataFrame([(*p, "x") for p in people], "entity_id string, scope string, canonical_name string, entity_type string, form string")
    aliases = spark.createDataFrame([("e6", "Bob Hokarzistede", "s1"), ("e6", None, "s1"), ("gone", "x y", "s1")], "entity_id string, alias string, scope string")
    got = {tuple(r) for r in names.link_names(entities, aliases).collect()}
    assert got == {("e1", "e1"), ("e2", "e1"), ("e3", "e1"), ("e4", "e1"), ("e6", "e1"), ("f1", "f1"), ("f2", "f1"), ("g1", "g1"), ("g2", "g1")}
    pairs = {tuple(r) for r in names.name_pairs(names.link_names(entities, aliases)).collect()}
    assert len(pairs) == 10 + 1 + 1 and all(a < b for a, b in pairs)
    assert names.link_names(entities.limit(0), aliases.limit(0)).count() == 0


def named(spark, *rows):
    """The groups of names (entity_id, name, entity_type) in one scope, as sets."""
    entities = spark.createDataFrame([(i, "s", n, k) for i, n, k in rows], "entity_id string, scope string, canonical_name string, entity_type string")
    found = names.link_names(entities, spark.createDataFrame([], "entity_id string, alias string, scope string")).collect()
    return {frozenset(r["entity_id"] for r in found if r["group_id"] == g) for g in {r["group_id"] for r in found}}


def test_given_names_outside_the_table(spark):
    """Misspelt, in the other order, short; and as frequent as a given name that isn't met alone."""
    people = [("a1", "Hiroshi Tanaka"), ("a2", "Hirosi Tanaka"), ("a3", "Tanaka Hiroshi"), ("b1", "Zoe Fodinuphar"), ("b2", "Zooe Fodinuphar"), ("c1", "Jonathan Fodinuphar"), ("d1", "Tim Fodinuphar"), ("d2", "Tom Fodinuphar")]
    many = [(f"m{i:02}", f"Hiroshi {'bcdfgklmnprstvz'[i % 15] * 2}{'aeiou'[i // 15] * 3}{'bcdfgklmnprstvz'[i % 15] * 3}") for i in range(75)]
    groups = named(spark, *[(i, n, "person") for i, n in people + many])
    assert frozenset({"a1", "a2", "a3"}) in groups and frozenset({"b1", "b2"}) in groups
    assert not {"c1", "d1", "d2"} & set().union(*groups)
    assert names.agree_tokens(["daniel", "kovar"], ["danny", "robert"]) == -1


def test_brands_like_trade_words(spark):
    """A brand isn't lost because its letters occur in a trade word."""
    companies = [("a1", "Intel Corp."), ("a2", "INTEL Corporation"), ("b1", "TEL"), ("b2", "tel Ltd"), ("c1", "Stos hemuquora Vacuum Systems"), ("c2", "Stoshemuquora Vacuum Systems"), ("d1", "IMS Systems"), ("d2", "CMC Systems"), ("e1", "Vacuum Systems"), ("e2", "Vacuum Systems GmbH")]
    assert named(spark, *[(i, n, "organization") for i, n in companies]) == {frozenset({f"{x}1", f"{x}2"}) for x in "abce"}
    assert names.parse_organisation("Intel") == ("full", "", "intel")


def test_shortened_names(spark):
    """Initials, abbreviations and left-out tokens in any place, if they fit one name only."""
    people = [("a1", "Robert Hokarzistede"), ("a2", "Robert Hokarz."), ("a3", "Hok. Bob"), ("b1", "Zoe Kavadabrou"), ("b2", "Zoe K."), ("c1", "Hiroshi Maria Tanaka"), ("c2", "Tanaka Hiroshi"), ("d1", "Anna Bergmann"), ("d2", "Anna Berg"), ("e1", "Thomas Lunardo"), ("e2", "Thomas Lunaveti"), ("e3", "Thomas Luna.")]
    companies = [("f1", "Cowelmardon Gas Delivery"), ("f2", "Cowelm. Gas Delivery"), ("g1", "Nova Fodinuphar Precision Optics"), ("g2", "Fodinuphar Nova Optics"), ("h1", "Micro Systems"), ("h2", "Microchip Systems")]
    groups = named(spark, *[(i, n, "person") for i, n in people], *[(i, n, "organization") for i, n in companies])
    assert groups == {frozenset({"a1", "a2", "a3"}), frozenset({"b1", "b2"}), frozenset({"c1", "c2"}), frozenset({"f1", "f2"}), frozenset({"g1", "g2"})}


def test_names_outside_every_list(spark):
    """Pairs of names, each in a scope of its own, that mean the same or don't."""
    same = [("Zbigniew Nowak", "Zbigneiw Nowak"), ("Mohamed Ali", "Mohammed Ali"), ("Priyanka Sharma", "Priyanak Sharma"), ("Yuki Tanaka", "Tanaka Yuki"), ("Ann Lee Park", "Ann Park"), ("Hiroshi Watanabe", "Watanabe, H."), ("Oluwaseyi Adebayo", "O. Adebayo"), ("Kowalczyk Agnieszka", "Agnieszka Kowalczik"), ("Robert Hokarz.", "Robert Hokarzistede")]
    apart = [("Carlos Garcia", "Charles Garcia"), ("Marta Silva", "Maria Silva"), ("Sigrid Berg", "Astrid Berg"), ("Zoltan Fekete", "Zoltan Feher")]
    firms = [("Intel", "Intel Corp."), ("Deutsche Wafer Technik GmbH", "Deutsche Wafertechnik"), ("Nippon Tokki", "Nippon Tokkki")]
    rows = [(f"{i:02}{side}", f"s{i}", name, "organization" if pair in firms else "person") for i, pair in enumerate(same + apart + firms) for side, name in zip("ab", pair, strict=True)]
    got = names.link_names(spark.createDataFrame(rows, "entity_id string, scope string, canonical_name string, entity_type string"), spark.createDataFrame([], "entity_id string, alias string"))
    linked = {r.group_id[:2] for r in got.collect()}
    assert linked == {f"{i:02}" for i, pair in enumerate(same + apart + firms) if pair not in apart}
