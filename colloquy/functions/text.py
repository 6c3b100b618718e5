"""Text functions. All are built-in expressions but the four marked as pandas UDFs, for which Spark
has no built-in: NFC, `\\uXXXX` decoding, longest common part, similarity ratio."""

from __future__ import annotations

import difflib
import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType

# Labels and role words that are no person, category names and their aliases, note marks, names of relations.
GENERIC = r"(?iU)^(speaker|발화자|화자)\s*\d*$"
ROLE_WORDS = ("대표", "대표님", "담당자", "상담원", "직원", "참석자", "발신자", "수신자", "고객", "기타")
CATEGORIES = ("내부-주간회의", "내부-전략", "내부-1on1", "외부-파트너", "외부-고객영업", "외부-투자IR", "강연-세미나", "인터뷰", "개인-통화", "기타")
CATEGORY_ALIASES = {
    "내부-회의": "내부-전략",
    "회의": "내부-전략",
    "내부": "내부-전략",
    "외부": "외부-파트너",
    "파트너": "외부-파트너",
    "투자": "외부-투자IR",
    "IR": "외부-투자IR",
    "강연": "강연-세미나",
    "세미나": "강연-세미나",
    "통화": "개인-통화",
}
NOTE_MARKS = {"사적": "△", "언급금지": "⛔"}
RELATIONS = {"tension": "대립", "agree": "합의", "builds-on": "발전"}
OTHER_CATEGORY = "기타"


@F.pandas_udf(StringType())
def nfc(s: pd.Series) -> pd.Series:
    return s.map(lambda x: unicodedata.normalize("NFC", x), na_action="ignore")


@F.pandas_udf(StringType())
def decode_escapes(s: pd.Series) -> pd.Series:
    """Literal `\\uXXXX` as the characters they name."""
    return s.map(lambda x: re.sub(r"\\u([0-9a-fA-F]{4})", lambda m: chr(int(m[1], 16)), x), na_action="ignore")


def common_share(fragment: str, text: str, autojunk: bool = True) -> float:
    """Length of the longest part of `fragment` found in `text`, as a share of the fragment."""
    if not fragment:
        return 1.0
    match = difflib.SequenceMatcher(None, fragment, text, autojunk=autojunk).find_longest_match(0, len(fragment), 0, len(text))
    return match.size / len(fragment)


def grounding_score(autojunk: bool = True):
    """pandas UDF (fragments array, text): the least share over the fragments. autojunk: as the plain
    matcher does by default it passes over frequent characters of texts of 200 or more."""

    @F.pandas_udf(DoubleType())
    def score(fragments: pd.Series, text: pd.Series) -> pd.Series:
        return pd.Series([min((common_share(f, t, autojunk) for f in fs), default=1.0) for fs, t in zip(fragments, text, strict=True)], dtype=float)

    return score


@F.pandas_udf(DoubleType())
def similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([difflib.SequenceMatcher(None, x, y).ratio() for x, y in zip(a.fillna(""), b.fillna(""), strict=True)], dtype=float)


def strip(s: Column) -> Column:
    return F.regexp_replace(s, r"(?U)^\s+|\s+$", "")


def norm(s: Column) -> Column:
    """NFC, each white space run one space, ends stripped."""
    return strip(F.regexp_replace(nfc(s), r"(?U)\s+", " "))


def norm_ends(s: Column) -> Column:
    """NFC and ends stripped; inner white space stays."""
    return strip(nfc(s))


def variants(name: Column) -> Column:
    """`A(B)` as {A(B), A, B}; another name as {name}. Give a normalised name."""
    pattern = r"(?U)^(.+?)\s*\((.+?)\)$"
    found = F.array(name, F.regexp_extract(name, pattern, 1), F.regexp_extract(name, pattern, 2))
    return F.array_distinct(F.filter(F.transform(found, strip), lambda v: v.isNotNull() & (v != "")))


def strip_wrappers(s: Column) -> Column:
    """Escapes decoded; brackets, quotes and white space round a label taken off."""
    return norm(F.regexp_replace(decode_escapes(s), r"(?U)^[\[\s'\"]+|[\]\s'\"]+$", ""))


def is_generic(label: Column) -> Column:
    return F.coalesce(label.rlike(GENERIC), F.lit(False))


def clean_participant(label: Column) -> Column:
    """The label, or empty if it is no person: shorter than two characters, generic or a role word.
    Give a label without wrappers."""
    no_person = label.isNull() | (F.length(label) < 2) | is_generic(label) | label.isin(*ROLE_WORDS)
    return F.when(no_person, "").otherwise(label)


def category(raw: Column) -> Column:
    """Canonical category: aliases mapped, unknown ones `기타`."""
    name = strip(F.coalesce(raw, F.lit(OTHER_CATEGORY)))
    mapped = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in CATEGORY_ALIASES.items() for x in kv]), name), name)
    return F.when(mapped.isin(*CATEGORIES), mapped).otherwise(OTHER_CATEGORY)


def like(s: Column, part: str) -> Column:
    """Case-insensitive `LIKE '%part%'`; `%` and `_` in the part are wildcards."""
    return s.ilike(f"%{part}%")


def bare(s: Column) -> Column:
    """Without white space, stops, quotes and brackets."""
    return F.regexp_replace(s, r"""(?U)[\s.,!?'"“”‘’…()\[\]]+""", "")


def fragments(quote: Column) -> Column:
    """Parts between ellipses of six or more characters; else the whole quote."""
    parts = F.filter(F.transform(F.split(quote, r"\.{2,}|…"), strip), lambda x: F.length(x) >= 6)
    return F.when(F.size(parts) == 0, F.array(quote)).otherwise(parts)


def longest_tokens(quote: Column, n: int = 6) -> Column:
    """The `n` longest distinct tokens; of equal length in ascending order."""
    found = F.array_distinct(F.regexp_extract_all(quote, F.lit("[가-힣A-Za-z0-9]{2,}"), F.lit(0)))
    keyed = F.array_sort(F.transform(found, lambda t: F.struct((-F.length(t)).alias("k"), t.alias("t"))))
    return F.transform(F.slice(keyed, 1, n), lambda x: x["t"])


def slug(s: Column) -> Column:
    return F.regexp_replace(F.lower(nfc(s)), "[^0-9a-z가-힣]", "")


def month(date: Column) -> Column:
    return F.substring(date, 1, 7)


def iso_date(s: Column) -> Column:
    """The date that the first ten characters are; null if they are none."""
    return F.try_to_date(F.substring(s, 1, 10), "yyyy-MM-dd")


def days_between(a: Column, b: Column) -> Column:
    return F.datediff(a, b)


def integer(s: Column) -> Column:
    """A number of digits only; else null."""
    return F.when(s.rlike("^[0-9]+$"), s.try_cast("long"))


def percent(part: Column, whole: Column) -> Column:
    return F.round(F.lit(100.0) * part / whole, 1)


def hours(minutes: Column) -> Column:
    return F.floor(minutes / 60).cast("long")


def file_safe(s: Column) -> Column:
    return F.regexp_replace(s, r"[/\\:]", "-")


def base_name(path: Column) -> Column:
    """File name without folder and ending."""
    return F.regexp_replace(F.regexp_extract(path, r"([^/]*)$", 1), r"(?<=.)\.[^.]*$", "")


def body_safe(token: Column) -> Column:
    """Whether a name is long enough to be replaced anywhere in a text."""
    return F.length(token) >= F.when(token.rlike("^[A-Za-z .]+$"), 3).otherwise(2)


def manual_block(text: Column, start: str, end: str) -> Column:
    """What stands between two markers, markers included; empty if they are not there."""
    return F.regexp_extract(text, rf"(?s)(\Q{start}\E.*?\Q{end}\E)", 1)


def note_mark(use: Column) -> Column:
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in NOTE_MARKS.items() for x in kv]), use), F.lit(""))


def relation_name(kind: Column) -> Column:
    """How a report names a kind of relation; another kind by itself."""
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in RELATIONS.items() for x in kv]), kind), kind)


def rank(value: Column, order: tuple[str, ...]) -> Column:
    """Place of a value in `order`; others come last."""
    out = F.lit(len(order))
    for i, v in reversed(list(enumerate(order))):
        out = F.when(value == v, i).otherwise(out)
    return out


def blank_last(value: Column) -> Column:
    return F.when(F.coalesce(value, F.lit("")) == "", 1).otherwise(0)


def tokens(text: Column) -> Column:
    """Lower-cased runs of letters and digits, marks of Latin letters taken off, in order."""
    plain = F.translate(F.lower(text), "àáâãäåçèéêëìíîïñòóôõöùúûüýÿ", "aaaaaaceeeeiiiinooooouuuuyy")
    return F.filter(F.split(plain, r"[^\p{L}\p{N}\p{Co}]+"), lambda t: t != "")
