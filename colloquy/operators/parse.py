"""Transcripts to rows: frontmatter, lines, utterances, commitments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as t

# Fixed formats: an offset, an offset in round brackets, the shapes of a spoken line in the order they
# are tried (with the groups of name, offset and text; 0: none), a line that looks like one, a commitment.
OFFSET = r"\d+:\d{2}(?::\d{2})?"
IN_BRACKETS = rf"\((?:시간:\s*)?({OFFSET})\)"
SHAPES = (
    (rf"(?U)^\*\*\[([^\]]*)\]\s*{IN_BRACKETS}\*\*\s*(.*)$", 1, 2, 3),
    (rf"(?U)^\*\*(.*?)\s*{IN_BRACKETS}\*\*\s*(.*)$", 1, 2, 3),
    (rf"(?U)^\*\*([^*]+?)\*\*\s*{IN_BRACKETS}\s*:?\s*(.*)$", 1, 2, 3),
    (rf"(?U)^\[({OFFSET})(?:\s*-\s*{OFFSET})?\]\s*:?\s*(.*)$", 0, 1, 2),
    (rf"(?U)^{IN_BRACKETS}\s*(.*)$", 0, 1, 2),
)
LOOKS_SPOKEN = rf"(?U)^\s*(?:\*{{0,2}}\s*\[?[^\n]{{0,40}}?\({OFFSET}\)|\[{OFFSET})"
COMMITMENT = r"(?U)^-\s*\[([ xX])\]\s*(?:\(([^)→>]*?)(?:→|->)([^)]*)\)\s*)?(.+?)(?:\s*\((?:기한|due)[:\s]*([0-9./-]+)\))?\s*$"
#: Ranges that rows are numbered in at most, and sampled values for each.
MOST_RANGES = 256
SAMPLED = 64
LINE_ENDS = r"\R|[\x1c-\x1e]"
FRONTMATTER = r"(?sU)^---\s*\n(.*?)\n---\s*\n"


def frontmatter(content: Column) -> Column:
    """Map of key to raw value: the last of equal keys counts, quotes round a value are taken off."""
    lines = F.filter(F.split(F.regexp_extract(content, FRONTMATTER, 1), LINE_ENDS), lambda x: x.rlike(r"(?U)^\w+:"))
    key = lambda x: F.regexp_extract(x, r"(?U)^(\w+):\s*(.*)$", 1)
    value = lambda x: F.regexp_replace(t.strip(F.regexp_extract(x, r"(?U)^(\w+):\s*(.*)$", 2)), '^"+|"+$', "")
    # The last of equal keys: kept if no later line has its key.
    keys = F.transform(lines, key)
    last = F.filter(F.transform(lines, lambda x, i: F.struct(key(x).alias("k"), value(x).alias("v"), i.alias("i"))), lambda e: e["i"] == F.size(keys) - F.array_position(F.reverse(keys), e["k"]).cast("int"))
    return F.map_from_entries(F.transform(last, lambda e: F.struct(e["k"], e["v"])))


def body(content: Column) -> Column:
    return F.regexp_replace(content, FRONTMATTER, "")


def value_list(raw: Column) -> Column:
    """`[a, "b"]` as an array; another value as the array of itself; null and empty as an empty array."""
    inner = F.regexp_extract(raw, r"(?s)^\[(.*)\]$", 1)
    parts = F.transform(F.split(inner, ","), lambda x: F.regexp_replace(t.strip(x), '^"+|"+$', ""))
    parts = F.filter(parts, lambda x: x != "")
    return F.when(F.coalesce(raw, F.lit("")) == "", F.array().cast("array<string>")).when(raw.rlike(r"(?s)^\[.*\]$"), parts).otherwise(F.array(raw))


def meetings(files: DataFrame, numbered: bool = True) -> DataFrame:
    """One row per readable transcript; `rowid` numbers them by path (unless `numbered` is false). The category is kept raw and
    canonical; `participant_list` and `body` go on to the next operators."""
    fm = files.filter("readable").select("path", "content", frontmatter(F.col("content")).alias("fm"))
    get = lambda k: F.coalesce(F.element_at("fm", k), F.lit(""))
    people = value_list(get("participants"))
    rows = fm.select(
        "path",
        get("source_id").alias("source_id"),
        get("part").alias("part"),
        get("date").alias("date"),
        get("title").alias("title"),
        get("category").alias("category_raw"),
        t.category(F.element_at("fm", "category")).alias("category"),
        t.integer(get("duration_min")).alias("duration_min"),
        get("transcribed_by").alias("transcribed_by"),
        people.alias("participant_list"),
        F.array_join(people, ", ").alias("participants"),
        body(F.col("content")).alias("body"),
    )
    return number_rows(rows, "path", "rowid") if numbered else rows


def number_rows(df: DataFrame, by: str, out: str) -> DataFrame:
    """`df` with its rows numbered from 1 in the order of the unique string column `by` (null first),
    without one task for all rows: ranges of values, their counts, and each row's place in its own.

    The bounds of the ranges are values, picked once from a small sample by hash, so a row's number
    is the same whatever columns a plan asks for and however often it is planned.
    """
    n = min(MOST_RANGES, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    keys = df.select(F.col(by).alias("k")).filter("k is not null")
    sample = sorted(r.k for r in keys.orderBy(F.xxhash64("k"), "k").limit(SAMPLED * n).collect())
    cuts = sorted({sample[i * len(sample) // n] for i in range(1, n)}) if sample else []
    terms = [(F.coalesce(F.col("k") >= F.lit(c), F.lit(False))).cast("int") for c in cuts] or [F.lit(0)]
    while len(terms) > 1:  # a flat tree of sums
        terms = [sum(terms[i + 1 : i + 2], terms[i]) for i in range(0, len(terms), 2)]
    # Only the values are sorted; what belongs to them is joined by value.
    ranged = df.select(F.col(by).alias("k")).withColumn("_p", terms[0])
    counts = ranged.groupBy("_p").agg(F.count("*").alias("_n"))
    before = counts.select("_p", (F.sum("_n").over(W.orderBy("_p")) - F.col("_n")).alias("_before"))
    placed = ranged.withColumn("_i", F.row_number().over(W.partitionBy("_p").orderBy("k"))).join(F.broadcast(before), "_p")
    numbers = placed.select(F.col("k").alias("_k"), (F.col("_before") + F.col("_i")).cast("long").alias(out))
    return df.join(numbers, F.col(by).eqNullSafe(F.col("_k"))).drop("_k")


def spoken(line: Column) -> Column:
    """Struct of `shape`, `name`, `ts`, `text` of a spoken line; null for another."""
    out = F.lit(None).cast("struct<shape:int,name:string,ts:string,text:string>")
    for i, (pattern, name, ts, text) in reversed(list(enumerate(SHAPES))):
        group = lambda g, pattern=pattern: t.strip(F.regexp_extract(line, pattern, g))
        found = F.struct(F.lit(i).alias("shape"), (group(name) if name else F.lit("")).alias("name"), group(ts).alias("ts"), group(text).alias("text"))
        out = F.when(line.rlike(pattern), found).otherwise(out)
    return out


def lines(meeting_rows: DataFrame, key: str = "rowid") -> DataFrame:
    """The lines of each body with their `kind`: B blank, C commitment, U spoken with text, H spoken
    without, # heading, O other; and `anchor`, the last line before or at it that is not O."""
    rows = meeting_rows.select(key, F.posexplode(F.split("body", LINE_ENDS)).alias("i", "raw"))
    rows = rows.withColumn("line", t.strip(F.col("raw"))).withColumn("said", spoken(F.col("line")))
    kind = (
        F.when(F.col("line") == "", "B")
        .when(F.col("line").rlike(COMMITMENT), "C")
        .when(F.col("said").isNotNull(), F.when(F.col("said.text") != "", "U").otherwise("H"))
        .when(F.col("line").startswith("#"), "#")
        .otherwise("O")
    )
    rows = rows.withColumn("kind", kind).drop("raw")
    so_far = W.partitionBy(key).orderBy("i").rowsBetween(W.unboundedPreceding, W.currentRow)
    anchor = F.max(F.when(F.col("kind") != "O", F.struct("i", "kind"))).over(so_far)
    return rows.withColumn("a", anchor).select(key, "i", "line", "said", "kind", F.col("a.i").alias("anchor"), F.col("a.kind").alias("anchor_kind"))


def utterances(line_rows: DataFrame, key: str = "rowid") -> DataFrame:
    """`key`, `i`, `speaker_raw`, `ts`, `text`: lines with text, and headers with the plain lines that
    follow them up to a blank line, heading, commitment or spoken line. A header that none follows
    says nothing; see `discarded`."""
    own = line_rows.filter("kind = 'U'").select(key, "i", F.col("said.name").alias("speaker_raw"), F.col("said.ts").alias("ts"), F.col("said.text").alias("text"))
    parts = line_rows.filter("kind = 'H' or (kind = 'O' and anchor_kind = 'H')")
    follow = parts.groupBy(key, F.col("anchor").alias("i")).agg(
        F.max(F.when(F.col("kind") == "H", F.col("said"))).alias("said"),
        F.array_sort(F.collect_list(F.when(F.col("kind") == "O", F.struct("i", "line")))).alias("rest"),
    )
    follow = follow.filter(F.size("rest") > 0)
    joined = F.array_join(F.transform("rest", lambda x: x["line"]), " ")
    return own.unionByName(follow.select(key, "i", F.col("said.name").alias("speaker_raw"), F.col("said.ts").alias("ts"), joined.alias("text")))


def commitments(line_rows: DataFrame, key: str = "rowid") -> DataFrame:
    """`key`, `i`, `done` 0/1, raw `from_raw` and `to_raw`, `text`, `due`."""
    group = lambda g: F.regexp_extract("line", COMMITMENT, g)
    rows = line_rows.filter("kind = 'C'")
    return rows.select(key, "i", F.when(group(1) == " ", 0).otherwise(1).alias("done"), group(2).alias("from_raw"), group(3).alias("to_raw"), t.strip(group(4)).alias("text"), group(5).alias("due"))


def discarded(line_rows: DataFrame, key: str = "rowid") -> DataFrame:
    """What was said by no utterance, per meeting: `lost_lines` look spoken and were not understood,
    `continuations` follow a line with text of its own, `empty_headers` have no text at all."""
    stray = (F.col("kind") == "O") & (F.coalesce("anchor_kind", F.lit("")) != "H")
    header = F.count_if(F.col("kind") == "H")
    filled = F.count_distinct(F.when((F.col("kind") == "O") & (F.col("anchor_kind") == "H"), F.col("anchor")))
    return line_rows.groupBy(key).agg(
        F.count_if(stray & F.col("line").rlike(LOOKS_SPOKEN)).alias("lost_lines"),
        F.count_if(stray & (F.col("anchor_kind") == "U")).alias("continuations"),
        (header - filled).alias("empty_headers"),
    )
