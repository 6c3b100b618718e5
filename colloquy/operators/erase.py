"""Erasure of a person from transcripts, registry and tables."""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as t

MASK = "(삭제)"


def _variants(name: str) -> set[str]:
    name = " ".join(unicodedata.normalize("NFC", name).split())
    found = re.match(r"(.+?)\s*\((.+?)\)$", name)
    return {name, *(found.groups() if found else ())} - {""}


def tokens(name: str, registry: DataFrame) -> list[str]:
    """The person's name variants and the aliases of their entry, longest first: a few strings."""
    rows = registry.filter(t.norm_ends(F.col("name")) == unicodedata.normalize("NFC", name).strip()).select(F.explode("aliases").alias("a")).collect()
    found = _variants(name) | {unicodedata.normalize("NFC", r.a).strip() for r in rows if r.a}
    return sorted(found - {""}, key=lambda x: (-len(x), x))


def is_body_safe(token: str) -> bool:
    return len(token) >= (3 if re.fullmatch(r"[A-Za-z .]+", token) else 2)


def mask_text(text: Column, names: list[str], mask: str = MASK) -> Column:
    """Labels `**[X] (` of all names masked, then every name that is long enough, longest first."""
    out = t.nfc(text)
    for name in names:
        out = F.regexp_replace(out, rf"(\*\*\[?)\Q{name}\E(\]?\s*\()", f"$1{mask}$2")
    for name in names:
        if is_body_safe(name):
            out = F.replace(out, F.lit(name), F.lit(mask))
    return out


def mentions(text: Column, names: list[str]) -> Column:
    """How often the names that are long enough stand in a text."""
    total = F.lit(0)
    for name in names:
        if is_body_safe(name):
            total = total + ((F.length(text) - F.length(F.replace(text, F.lit(name), F.lit("")))) / len(name)).cast("int")
    return total


def erase_transcripts(files: DataFrame, names: list[str]) -> DataFrame:
    """`path`, `content`, `mentions`: the masked files, and how often they named the person."""
    return files.select("path", mask_text(F.col("content"), names).alias("content"), mentions(t.nfc(F.col("content")), names).alias("mentions"))


def erase_tables(tables: dict[str, DataFrame], name: str, names: list[str]) -> dict[str, DataFrame]:
    """The tables without the person: rows of theirs go, models that only they held go with what
    links to them, and free text and names elsewhere are masked."""
    x = dict(tables)
    mine = lambda c: t.norm_ends(F.coalesce(F.col(c), F.lit(""))) == name
    held = x["model_people"]
    sole = held.groupBy("model_id").agg(F.bool_and(mine("person")).alias("sole")).filter("sole").select("model_id")
    keep = lambda df, c: df.join(sole.select(F.col("model_id").alias(c)), c, "left_anti")
    x["models"] = keep(x["models"], "id")
    x["model_people"] = keep(held.filter(~mine("person")), "model_id")
    x["model_about"] = keep(x["model_about"].filter(~mine("entity")), "model_id")
    x["model_related"] = keep(keep(x["model_related"], "model_id"), "related_id")
    x["people"] = x["people"].filter(~mine("name"))
    x["person_aliases"] = x["person_aliases"].filter(~mine("canonical"))
    x["person_meetings"] = x["person_meetings"].filter(~mine("person"))
    x["relations"] = x["relations"].filter(~mine("from_person") & ~mine("to_person"))
    x["network"] = x["network"].filter(~mine("a") & ~mine("b"))
    for table, df in x.items():
        texts = [c for c, k in df.dtypes if k == "string" and c not in ("id", "model_id", "related_id", "kind", "path")]
        x[table] = df.withColumns({c: mask_text(F.col(c), names) for c in texts})
    return x


def erase_registry(registry: DataFrame, name: str) -> DataFrame:
    """Without the person's entry; as manager or introducer of others they are blanked."""
    out = registry.filter(t.norm_ends(F.coalesce("name", F.lit(""))) != name)
    return out.withColumns({c: F.when(t.norm_ends(F.col(c)) == name, "").otherwise(F.col(c)) for c in ("manager", "intro_by")})


def residual(tables: dict[str, DataFrame], names: list[str]) -> DataFrame:
    """`table`, `rows`: rows that still name the person anywhere. No rows: nothing is left."""
    safe = [n for n in names if is_body_safe(n)]
    found = None
    for table, df in sorted(tables.items()):
        texts = [c for c, k in df.dtypes if k == "string"]
        hit = F.lit(False)
        for c in texts:
            for n in safe:
                hit = hit | F.coalesce(F.contains(F.col(c), F.lit(n)), F.lit(False))
        rows = df.filter(hit).agg(F.count("*").alias("rows")).select(F.lit(table).alias("table"), "rows").filter("rows > 0")
        found = rows if found is None else found.unionByName(rows)
    return found


def impact(before: dict[str, DataFrame], after: dict[str, DataFrame]) -> DataFrame:
    """`table`, `before`, `after`: row counts."""
    rows = None
    for table in sorted(before):
        a, b = before[table].agg(F.count("*").alias("before")), after[table].agg(F.count("*").alias("after"))
        one = a.crossJoin(b).select(F.lit(table).alias("table"), "before", "after")  # one row each
        rows = one if rows is None else rows.unionByName(one)
    return rows
