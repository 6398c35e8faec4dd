"""Text functions: tokens, lexical matching, trigrams, identity keys, chunks and the rule-based extractor."""

from __future__ import annotations

import json
import re
import unicodedata
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from itertools import accumulate

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


def words(text: Column | str) -> Column:
    """Lower-case runs of letters and digits, in order: the one tokenizer of the lexical operators."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"([\p{L}\p{N}]+)"), F.lit(1))


def has_all_words(text: Column | str, query: Column | str) -> Column:
    """Whether every word of a non-empty query is a word of the text."""
    asked = words(query)
    return (F.size(asked) > 0) & (F.size(F.array_except(asked, words(text))) == 0)


def trigrams(text: Column | str) -> Column:
    """The set of three-letter sequences of the words, each padded with two blanks before and one after."""
    padded = F.transform(words(text), lambda w: F.concat(F.lit("  "), w, F.lit(" ")))
    return F.array_distinct(F.flatten(F.transform(padded, lambda w: F.transform(F.sequence(F.lit(1), F.length(w) - 2), lambda i: F.substr(w, i, F.lit(3))))))


def trigram_similarity(a: Column | str, b: Column | str) -> Column:
    """Shared trigrams by all trigrams, 0 if there are none."""
    x, y = trigrams(a), trigrams(b)
    every = F.size(F.array_union(x, y))
    return F.when(every > 0, F.size(F.array_intersect(x, y)) / every).otherwise(F.lit(0.0))


def fact_text(subject: str = "subject_name", predicate: str = "predicate", value: str = "object_text") -> Column:
    """``subject predicate object`` with ? for a missing subject."""
    return F.concat_ws(" ", F.coalesce(F.col(subject), F.lit("?")), F.col(predicate), F.col(value))


def token_estimate(text: Column | str, per: int = 3) -> Column:
    """Characters by ``per``, at least 1."""
    return F.greatest(F.lit(1), F.floor(F.length(F.coalesce(text, F.lit(""))) / per)).cast("int")


def query_names(question: Column | str) -> Column:
    """One to three capitalised words in a row; if there are none, the first five words of more than three letters."""
    proper = F.array_distinct(F.regexp_extract_all(question, F.lit(r"\b([A-Z][a-z]+(?:\s+[A-Z][a-z]+){0,2})\b"), F.lit(1)))
    long = F.slice(F.filter(F.split(question, r"\s+"), lambda w: F.length(w) > 3), 1, 5)
    return F.when(F.size(proper) > 0, proper).otherwise(long)


@F.pandas_udf(StringType())
def canonical_text(values: pd.Series) -> pd.Series:
    """NFKC, case-folded, white space collapsed. There is no built-in for NFKC and case folding."""
    return values.map(lambda v: None if v is None else " ".join(unicodedata.normalize("NFKC", v).split()).casefold())


#: Fields of an identity context and the names under which they may come (fixed values).
CONTEXT_FIELDS = {"chamber": ("chamber",), "equipment": ("tool", "equipment"), "fab": ("fab",), "module": ("module",), "recipe": ("recipe",), "recipe_revision": ("recipe_revision", "recipe_rev")}
#: Which fields tell entities of a type apart (fixed values).
TYPE_FIELDS = {
    ("equipment", "tool"): ("equipment", "fab"),
    ("module", "chamber", "component", "sensor", "subsystem"): ("chamber", "equipment", "fab", "module"),
    ("recipe", "process_step", "process_param"): tuple(CONTEXT_FIELDS),
}
SENSITIVE_TYPES = ("component", "controller", "measurement", "metrology_result", "process_param", "recipe", "recipe_revision", "sensor")


def context_key(context: Column | str, entity_type: Column | str | None = None) -> Column:
    """Compact JSON of the canonical fields of a JSON context, sorted by name; with a type only those that matter to it.

    ``{}`` for a null or invalid context.
    """
    kind = F.lower(F.trim(entity_type)) if entity_type is not None else None

    def field(name: str, sources: tuple[str, ...]) -> Column:
        raw = F.coalesce(*[F.when(F.trim(v) != "", v) for s in sources for v in [F.get_json_object(context, f"$.{s}")]], F.lit(None).cast("string"))
        value = canonical_text(raw)
        value = F.when(value != "", value)
        if kind is not None:
            types = [t for ts, fields in TYPE_FIELDS.items() if name in fields for t in ts]
            value = F.when(kind.isin(*types), value)
        return value.alias(name)

    return F.to_json(F.struct(*[field(n, s) for n, s in CONTEXT_FIELDS.items()]))


#: Units of quantities that tell things apart (fixed values).
UNITS = ("kw", "w", "v", "a", "ma", "pa", "torr", "mtorr", "sccm", "slm", "c", "nm", "um", "%", "hz", "khz", "mhz")
#: Width variants and compatibility signs (which NFKC would unify) and what they stand for.
WIDE = "".join(map(chr, range(0xFF01, 0xFF5F))) + "\u3000\u00b5"
NARROW = "".join(map(chr, range(0x21, 0x7F))) + " \u03bc"


def unified(text: Column | str) -> Column:
    """Lower case without width variants; the micro sign is the letter mu, the sign for degrees Celsius two characters."""
    return F.lower(F.replace(F.translate(text, WIDE, NARROW), F.lit("\u2103"), F.lit("°c")))


def identity_patterns() -> tuple[str, str]:
    """Patterns of identifiers (letters, then a number) and of quantities with a unit, the longest unit first."""
    units = "|".join(re.escape(u) for u in sorted({*UNITS, "°c", "μm"}, key=lambda u: (-len(u), u)))
    number = r"\d+(?:\.\d+)?"
    return rf"[a-z][a-z_-]*{number}[a-z%°μ]*", rf"{number}\s*(?:{units})"


def identity_tokens(name: Column | str) -> Column:
    """Identifiers with digits and quantities with units in a name, sorted and once each: names of sensors, recipes
    and the like that differ in them never mean the same."""
    low = unified(name)
    return F.array_sort(F.array_distinct(F.concat(*[F.regexp_extract_all(low, F.lit(f"({p})"), F.lit(1)) for p in identity_patterns()])))


def may_be_same(name: Column | str, other: Column | str, entity_type: Column | str) -> Column:
    """False for types that are sensitive to identity if the identity tokens of the names differ."""
    return ~F.lower(F.trim(F.coalesce(entity_type, F.lit("")))).isin(*SENSITIVE_TYPES) | (identity_tokens(name) == identity_tokens(other))


def without_thoughts(text: Column | str) -> Column:
    """Text without ``<think>`` sections, closed or not."""
    return F.trim(F.regexp_replace(F.regexp_replace(text, r"(?s)<think>.*?</think>", ""), r"(?s)<think>.*$", ""))


def first_json_object(text: str | None) -> dict | None:
    """The first JSON object in a model's answer, in a code fence or bare; None if there is none."""
    for start in (m.start() for m in re.finditer(r"\{", text or "")):
        try:
            value, _ = json.JSONDecoder().raw_decode(text, start)
            return value
        except ValueError:
            continue
    return None


HEADING = re.compile(r"^(#{1,6})\s+(.+)$", re.M)
MIN_CHUNK, MAX_CHUNK = 200, 2000


def sections(text: str) -> list[tuple[str, str, int, str]]:
    """(heading, path, depth, body with its heading line) of a text with headings; what precedes the first has none."""
    marks = list(HEADING.finditer(text))
    open_above: list[tuple[int, str]] = []
    found = [("", "", 0, text[: marks[0].start()])]
    for mark, after in zip(marks, [*(m.start() for m in marks[1:]), len(text)], strict=True):
        level, title = len(mark[1]), mark[2].strip()
        open_above = [*(x for x in open_above if x[0] < level), (level, title)]
        found.append((title, "/".join(t for _, t in open_above), len(open_above), text[mark.start() : after]))
    return [(h, p, d, b.strip()) for h, p, d, b in found if b.strip()]


PARAGRAPH = re.compile(r"[^\n]+(?:\n(?!\s*\n)[^\n]*)*")
SENTENCE_END = re.compile(r"[.。!！?？][\"')\]”’]*\s+|\n\s*")


def grouped(lengths: list[int], smallest: int) -> list[tuple[int, int]]:
    """Neighbours (from, to) that together reach ``smallest``, found in the running total; the rest may stay below."""
    total = list(accumulate(lengths, initial=0))
    out, at = [], 0
    while at < len(lengths):
        to = min(len(lengths), bisect_left(total, total[at] + smallest, at + 1))
        out.append((at, max(to, at + 1)))
        at = out[-1][1]
    return out


def spans(text: str, largest: int) -> list[tuple[int, int]]:
    """Stretches (from, to) of at most ``largest`` that end after sentences; a sentence that alone is larger stays whole."""
    ends = [*(m.end() for m in SENTENCE_END.finditer(text)), len(text)]
    out, at = [], 0
    while at < len(text):
        last = bisect_right(ends, at + largest) - 1
        to = ends[last] if last >= 0 and ends[last] > at else ends[bisect_right(ends, at)]
        out.append((at, to))
        at = to
    return out


def chunks_of(text: str, smallest: int = MIN_CHUNK, largest: int = MAX_CHUNK) -> list[tuple[str, str, int, str]]:
    """(heading, path, depth, text) of the chunks of a document: by headings, or by paragraphs where there are none.

    Short neighbours without heading form one chunk; chunks above ``largest`` are cut after sentences, and a sentence
    that alone is larger stays whole. A blank text has no chunk.
    """
    headed = HEADING.search(text) is not None
    parts = sections(text) if headed else [("", "", 0, m[0].strip()) for m in PARAGRAPH.finditer(text) if not m[0].isspace()]
    if not headed:
        parts = [("", "", 0, "\n".join(p[3] for p in parts[a:b])) for a, b in grouped([len(p[3]) for p in parts], smallest)]
    whole = ((head, path, depth, body, spans(body, largest) if len(body) > largest else [(0, len(body))]) for head, path, depth, body in parts)
    return [(head, path, depth, body[a:b].strip()) for head, path, depth, body, cuts in whole for a, b in cuts if body[a:b].strip()]


def chunk_documents(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key``, ``chunk_no``, ``heading``, ``path``, ``depth``, ``chunk`` of every document; null texts have none."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(k, i, *c) for k, t in zip(batch[key], batch[text], strict=True) if t is not None for i, c in enumerate(chunks_of(t))]
            yield pd.DataFrame(rows, columns=[key, "chunk_no", "heading", "path", "depth", "chunk"])

    return documents.select(key, text).mapInPandas(run, f"`{key}` {dict(documents.dtypes)[key]}, chunk_no int, heading string, path string, depth int, chunk string")


#: Phrases of the rule-based extractor and their predicates (fixed values).
PHRASES = {
    "works at": "works_at",
    "work at": "works_at",
    "joined": "joined",
    "owns": "owns",
    "own": "owns",
    "leads": "leads",
    "lead": "leads",
    "manages": "manages",
    "reports to": "reports_to",
    "uses": "uses",
    "use": "uses",
    "depends on": "depends_on",
    "signed": "signed",
    "renewed": "renewed",
    "acquired": "acquired",
    "is": "is_a",
    "are": "is_a",
}
#: Words before which an object ends (fixed values), and where a text falls into clauses.
STOPS = ("and", "but", "while", "because", "so", "then", "which", "that")
CLAUSE_END = r"\s*(?:[;\n]|[.!?](?=\s|$)|,(?=\s+\p{Lu})|\b(?:and|but)\b)\s*"
NAME = r"\p{Lu}[\p{L}\p{N}&'-]*(?:\s\p{Lu}\p{L}+){0,2}"


def statement_pattern() -> str:
    """A name, one of the phrases (longer ones first), and the object up to a stop word or a mark."""
    phrases = "|".join(sorted(PHRASES, key=lambda x: (-len(x), x)))
    return rf"^({NAME})\s+({phrases})\s+(\S.*?)\s*(?:[,;.].*|\s(?:{'|'.join(STOPS)})\s.*)?$"


def extract_triples(events: DataFrame, key: str = "event_id", text: str = "text") -> DataFrame:
    """``key``, ``clause_no``, ``subject``, ``predicate``, ``object``: statements of the form *Name phrase object*.

    The deterministic stand-in for a language model, on the JVM: a clause gives at most one statement, read by one
    pattern. Subjects and objects of more than 50 characters are dropped. A null text gives none.
    """
    clauses = events.select(key, F.posexplode(F.split(text, CLAUSE_END)).alias("clause_no", "clause"))
    part = lambda i: F.regexp_extract(F.trim("clause"), statement_pattern(), i)
    predicate = F.element_at(F.create_map(*[F.lit(x) for item in PHRASES.items() for x in item]), F.col("phrase"))
    read = clauses.select(key, "clause_no", part(1).alias("subject"), part(2).alias("phrase"), part(3).alias("object")).filter(F.col("phrase") != "")
    out = read.select(key, "clause_no", "subject", predicate.alias("predicate"), "object")
    return out.filter(F.length("subject").between(1, 50) & F.length("object").between(1, 50)).distinct()


def mentioned(events: DataFrame, triples: DataFrame, key: str = "event_id", text: str = "text", most: int = 6) -> DataFrame:
    """``key``, ``name``: the subjects and objects of an event's statements, or of a text without any the first ``most``
    capitalised names of more than two letters."""
    stated = triples.select(key, F.explode(F.array("subject", "object")).alias("name")).distinct()
    bare = events.join(triples.select(key).distinct(), key, "left_anti").filter(F.col(text).isNotNull())
    names = F.filter(F.array_distinct(F.regexp_extract_all(text, F.lit(rf"({NAME})"), F.lit(1))), lambda n: F.length(n) > 2)
    return stated.unionByName(bare.select(key, F.explode(F.slice(names, 1, most)).alias("name")))
