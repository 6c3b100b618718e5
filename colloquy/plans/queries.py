"""Queries over the driver's tables, each with SQL that gives the same rows.

The tables hold no transcripts, so every operator is bound to tables of the same shape: orders and
lineitems are meetings and who was there, conversations are utterances, parts are beliefs, nations
and regions an org chart, benchmark passages quotes. Texts to be parsed are made of rows and parsed
back.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as t
from .. import schemas
from ..operators import batch, document, erase, erase_many, grounding, migrate, parse, rebuild, resolve, validate
from ..operators.stored_index import StoredIndex
from ..sources import storage
from . import recipes

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a query under its function's name, with its SQL if there is any."""

    def add(run: Query) -> Query:
        QUERIES[run.__name__] = run
        if sql:
            ORACLE_SQL[run.__name__] = sql
        return run

    return add


def day(c: str) -> Column:
    """A timestamp's date as text."""
    return F.date_format(c, "yyyy-MM-dd")


def order_tables(spark: SparkSession, sf_dir: str) -> recipes.Tables:
    """Orders as meetings, customers as the people in them."""
    o = table(spark, sf_dir, "orders")
    met = o.select(F.col("o_orderkey").alias("rowid"), day("o_orderdate").alias("date"), F.col("o_orderpriority").alias("category"), F.col("o_orderpriority").alias("category_raw"), F.col("o_orderkey").cast("string").alias("title"), F.col("o_orderkey").cast("string").alias("path"), F.lit(60).cast("long").alias("duration_min"))
    return {"meetings": met, "person_meetings": o.select(F.col("o_custkey").cast("string").alias("person"), F.col("o_orderkey").alias("meeting_rowid"), F.lit("participant").alias("src"))}


def turn_tables(spark: SparkSession, sf_dir: str) -> recipes.Tables:
    """Conversations as meetings, turns as utterances."""
    c = table(spark, sf_dir, "conversations")
    said = c.select((F.col("conv_id") * 100000 + F.col("turn")).alias("utt_id"), F.col("conv_id").alias("meeting_rowid"), F.coalesce("role", F.lit("")).alias("speaker"), "text")
    met = c.select("conv_id").distinct().select(F.col("conv_id").alias("rowid"), F.lit("").alias("date"), F.col("conv_id").cast("string").alias("title"), F.lit("").alias("category_raw"), F.lpad(F.col("conv_id").cast("string"), 12, "0").alias("path"))
    return {"utterances": said, "meetings": met}


@query("""SELECT person, rowid AS meeting, CAST(place AS INTEGER) AS place FROM (SELECT CAST(o_custkey AS VARCHAR) person, o_orderkey AS rowid,
 row_number() OVER (PARTITION BY o_custkey ORDER BY strftime(o_orderdate, '%Y-%m-%d') DESC, CAST(o_orderkey AS VARCHAR)) AS place FROM orders) WHERE place <= 12""")
def profile_topn(spark: SparkSession, sf_dir: str) -> DataFrame:
    met = recipes.dossier_meetings(order_tables(spark, sf_dir), 12)
    return met.select("person", F.col("path").cast("long").alias("meeting"), "place")


@query("""SELECT CAST(o_custkey AS VARCHAR) AS person, max(strftime(o_orderdate, '%Y-%m-%d')) AS last_met, count(DISTINCT o_orderkey) AS total
 FROM orders GROUP BY o_custkey HAVING count(DISTINCT o_orderkey) >= 3 ORDER BY last_met, person LIMIT 15""")
def neglect_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recipes.neglected(order_tables(spark, sf_dir))


def line_tables(spark: SparkSession, sf_dir: str) -> recipes.Tables:
    """Orders as meetings, suppliers as the people in them."""
    li = table(spark, sf_dir, "lineitem")
    return {"person_meetings": li.select(F.col("l_suppkey").alias("person"), F.col("l_orderkey").alias("meeting_rowid"))}


@query("""SELECT p2.l_suppkey AS person, count(DISTINCT p2.l_orderkey) AS n FROM lineitem p1 JOIN lineitem p2 ON p2.l_orderkey = p1.l_orderkey
 WHERE p1.l_suppkey = 7 AND p2.l_suppkey <> 7 GROUP BY 1 ORDER BY n DESC, person LIMIT 10""")
def co_attendance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recipes.met_with(line_tables(spark, sf_dir), 7)


@query("""WITH pairs AS (SELECT a.l_suppkey AS person, b.l_suppkey AS peer, count(DISTINCT a.l_orderkey) AS n FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey
 WHERE a.l_suppkey <> b.l_suppkey GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY person ORDER BY n DESC, peer) AS place FROM pairs)
 SELECT CAST(person AS VARCHAR) AS person, CAST(peer AS VARCHAR) AS peer, n, CAST(place AS INTEGER) AS place FROM r WHERE place <= 6""")
def frequent_peers(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = line_tables(spark, sf_dir)["person_meetings"].distinct()
    both = pairs.join(pairs.withColumnRenamed("person", "peer"), "meeting_rowid").filter("person <> peer").groupBy("person", "peer").agg(F.count("*").alias("n"))
    first = both.withColumn("place", F.row_number().over(W.partitionBy("person").orderBy(F.desc("n"), "peer"))).filter("place <= 6")
    return first.select(F.col("person").cast("string").alias("person"), F.col("peer").cast("string").alias("peer"), "n", "place")


@query("""SELECT lpad(CAST(conv_id AS VARCHAR), 12, '0') AS path, count(*) AS total, CAST(sum(CASE WHEN coalesce(role, '') <> 'assistant' THEN 1 ELSE 0 END) AS BIGINT) AS unresolved
 FROM conversations GROUP BY conv_id HAVING sum(CASE WHEN coalesce(role, '') <> 'assistant' THEN 1 ELSE 0 END) * 2 > count(*) ORDER BY total DESC, path LIMIT 10""")
def backfill_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = turn_tables(spark, sf_dir)
    x["utterances"] = x["utterances"].withColumn("speaker", F.when(F.col("speaker") == "assistant", "assistant").otherwise(""))
    return recipes.backfill_ranking(x).select("path", "total", "unresolved")


@query("SELECT coalesce(role, '') AS speaker, count(*) AS n FROM conversations WHERE text ILIKE '%que%' GROUP BY 1")
def topic_ownership(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = turn_tables(spark, sf_dir)["utterances"]
    index = stored(spark, sf_dir, "conversations", said, "utt_id", ["text"], grams=True)
    return recipes.topic_owners_substring({"utterances": said}, "que", index)


_TOKENS = r"regexp_split_to_array(translate(lower({}), 'àáâãäåçèéêëìíîïñòóôõöùúûüýÿ', 'aaaaaaceeeeiiiinooooouuuuyy'), '[^\p{{L}}\p{{N}}\p{{Co}}]+')"


@query(f"SELECT coalesce(role, '') AS speaker, count(*) AS n FROM conversations WHERE list_contains({_TOKENS.format('text')}, 'the') GROUP BY 1")
def topic_ownership_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = turn_tables(spark, sf_dir)
    return recipes.topic_owners(x, ["the"], ["text"], stored(spark, sf_dir, "conversations", x["utterances"], "utt_id", ["speaker", "text"]))


def stored(spark: SparkSession, sf_dir: str, name: str, df: DataFrame, key: str, columns: list[str], grams: bool = False) -> StoredIndex:
    """The index of one of the driver's tables, in the shared folder under a name that tells the table's
    files: made where it is missing, else opened."""
    files = storage.entries(spark, f"{sf_dir}/{name}.parquet")
    what = hashlib.sha256(repr((sf_dir, name, key, columns, grams, files)).encode()).hexdigest()[:20]
    path = f"{storage.shared_dir(spark)}/index-{what}"
    index = StoredIndex.create(spark, path, key, grams)
    if not index.facts["segments"]:
        index.add(df, columns)
    return index


def doc_index(spark: SparkSession, sf_dir: str) -> StoredIndex:
    return stored(spark, sf_dir, "documents", table(spark, sf_dir, "documents"), "doc_id", ["text"])


@query(f"SELECT doc_id FROM documents WHERE list_contains({_TOKENS.format('text')}, 'que') AND list_contains({_TOKENS.format('text')}, 'la')")
def search_and(spark: SparkSession, sf_dir: str) -> DataFrame:
    return doc_index(spark, sf_dir).match_all(["que", "la"])


@query(f"SELECT doc_id FROM documents WHERE list_contains({_TOKENS.format('text')}, 'trash') OR list_contains({_TOKENS.format('text')}, 'avec')")
def search_or(spark: SparkSession, sf_dir: str) -> DataFrame:
    return doc_index(spark, sf_dir).match_any(["trash", "avec"])


@query(f"SELECT doc_id FROM documents WHERE list_contains({_TOKENS.format('text')}, 'la') AND NOT list_contains({_TOKENS.format('text')}, 'que')")
def search_not(spark: SparkSession, sf_dir: str) -> DataFrame:
    return doc_index(spark, sf_dir).match_not(["la"], ["que"])


@query(f"SELECT doc_id FROM documents WHERE contains(' ' || array_to_string({_TOKENS.format('text')}, ' ') || ' ', ' of the ')")
def search_phrase(spark: SparkSession, sf_dir: str) -> DataFrame:
    return doc_index(spark, sf_dir).match_phrase(["of", "the"])


@query(f"SELECT doc_id FROM documents WHERE len(list_filter({_TOKENS.format('text')}, lambda x: starts_with(x, 'worth'))) > 0")
def search_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return doc_index(spark, sf_dir).match_prefix("worth")


@query(f"SELECT token, count(DISTINCT doc_id) AS n FROM (SELECT doc_id, unnest({_TOKENS.format('text')}) AS token FROM documents) WHERE token <> '' GROUP BY 1")
def token_document_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return doc_index(spark, sf_dir).document_counts()


@query("SELECT r_name AS team, string_agg(n_name, ', ' ORDER BY n_name) AS names FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY 1")
def team_roster(spark: SparkSession, sf_dir: str) -> DataFrame:
    people = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return recipes.team_rosters({"people": people.select(F.col("n_name").alias("name"), F.col("r_name").alias("team"))})


@query("SELECT n_name AS a, r_name AS b, '보고' AS kind, CAST(n_regionkey AS VARCHAR) AS note FROM nation JOIN region ON n_regionkey = r_regionkey WHERE n_nationkey % 5 <> 0")
def org_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    registry = both.select(F.col("n_name").alias("name"), F.lower("r_name").alias("manager"), F.col("n_regionkey").cast("string").alias("team"))
    have = both.filter("n_nationkey % 5 = 0").select(F.col("n_name").alias("a"), F.col("r_name").alias("b"), F.lit(resolve.REPORTS_TO).alias("kind"))
    aliases = both.select(F.col("r_name").alias("canonical"), F.lower("r_name").alias("alias")).distinct()
    return resolve.org_edges(registry, have, aliases).select("a", "b", "kind", "note")


@query("SELECT strftime(ts, '%Y-%m') AS month, event_type AS category, count(*) AS n FROM events GROUP BY 1, 2")
def month_category_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy(t.month(day("ts")).alias("month"), F.col("event_type").alias("category")).agg(F.count("*").alias("n"))


@query("""SELECT 'category' AS by, o_orderpriority AS value, count(*) AS n, count(*) AS hours FROM orders GROUP BY 2
 UNION ALL SELECT 'month', strftime(o_orderdate, '%Y-%m'), count(*), count(*) FROM orders GROUP BY 2 UNION ALL SELECT 'all', '', count(*), count(*) FROM orders""")
def index_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recipes.index_counts(order_tables(spark, sf_dir))


@query("""SELECT day, min(event_id) FILTER (a = 1) AS first_id, min(event_id) FILTER (b = 1) AS last_id FROM (SELECT strftime(ts, '%Y-%m-%d') AS day, event_id,
 row_number() OVER (PARTITION BY strftime(ts, '%Y-%m-%d') ORDER BY ts, event_id) a, row_number() OVER (PARTITION BY strftime(ts, '%Y-%m-%d') ORDER BY ts DESC, event_id DESC) b FROM events) GROUP BY day""")
def first_last_per_period(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = F.struct("ts", "event_id")
    return table(spark, sf_dir, "events").groupBy(day("ts").alias("day")).agg(F.min_by("event_id", at).alias("first_id"), F.max_by("event_id", at).alias("last_id"))


@query("""SELECT o_custkey AS id, CAST(max(o_orderdate) AS DATE) AS seen FROM orders GROUP BY 1
 HAVING date_diff('day', CAST(max(o_orderdate) AS DATE), (SELECT CAST(max(o_orderdate) AS DATE) FROM orders)) > 180""")
def stale_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = order_tables(spark, sf_dir)
    seen = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("id")).agg(F.max(day("o_orderdate")).alias("last_seen"))
    return grounding.stale(seen.withColumn("first_seen", F.lit("")), x["meetings"])


@query("SELECT c_name AS name FROM customer c WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_totalprice > 400000)")
def zero_link_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    people = table(spark, sf_dir, "customer").select(F.col("c_name").alias("name"), F.lit("person").alias("type"), "c_custkey")
    said = table(spark, sf_dir, "orders").filter("o_totalprice > 400000").join(people, F.col("o_custkey") == F.col("c_custkey")).select(F.col("name").alias("speaker"))
    return grounding.silent_people(people, said)


@query("""SELECT count(*) AS total, count(*) FILTER (c_custkey IS NOT NULL) AS canonical, round(100.0 * count(*) FILTER (c_custkey IS NOT NULL) / count(*), 1) AS share
 FROM orders LEFT JOIN (SELECT c_custkey FROM customer WHERE c_acctbal > 5000) ON o_custkey = c_custkey""")
def semi_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = table(spark, sf_dir, "customer").filter("c_acctbal > 5000").select(F.col("c_custkey").alias("canonical"))
    return grounding.coverage(table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("speaker")), known).withColumn("share", F.col("share").cast("double"))


@query("SELECT sha256(text) AS source_id, lang AS part, count(*) AS n, string_agg(CAST(doc_id AS VARCHAR), ',' ORDER BY CAST(doc_id AS VARCHAR)) AS paths FROM documents WHERE text <> '' GROUP BY text, lang HAVING count(*) > 1")
def duplicate_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files of recordings, known by their text and, as part, language."""
    rows = table(spark, sf_dir, "documents").filter("text <> ''").select(F.sha2("text", 256).alias("source_id"), F.col("lang").alias("part"), F.col("doc_id").cast("string").alias("path"))
    return grounding.duplicate_sources(rows).withColumn("paths", F.array_join("paths", ","))


@query("""WITH l AS (SELECT c_name AS c, lower(c_mktsegment || c_nationkey || '-' || CAST(floor(c_acctbal / 50) AS BIGINT)) AS a FROM customer UNION ALL SELECT c_name, lower(c_name) FROM customer)
 SELECT a AS alias, min(c) AS canonical FROM l GROUP BY 1 HAVING count(DISTINCT c) = 1""")
def ambiguous_alias(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers by name, and by segment, nation and about how much they have, which several may share."""
    label = F.concat("c_mktsegment", "c_nationkey", F.lit("-"), F.floor(F.col("c_acctbal") / 50))
    registry = table(spark, sf_dir, "customer").select(F.col("c_name").alias("name"), F.array(label).alias("aliases"))
    people = spark.createDataFrame([], "name string, type string")
    return resolve.alias_map(resolve.alias_candidates(registry, people)).select("alias", "canonical")


_ROLES = [("user", "Customer"), ("assistant", "Agent")]


@query("""SELECT conv_id, turn, coalesce(canonical, role, '') AS speaker, CASE WHEN coalesce(role, '') = '' THEN 'unattributed' WHEN canonical IS NOT NULL THEN 'canonical' ELSE 'raw-name' END AS kind
 FROM conversations LEFT JOIN (VALUES ('user', 'Customer'), ('assistant', 'Agent')) v(alias, canonical) ON lower(role) = alias""")
def alias_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    aliases = spark.createDataFrame(_ROLES, "alias string, canonical string")
    rows = resolve.resolve(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role"), "role", aliases, "speaker")
    return resolve.classify(rows, "role", "speaker", aliases).select("conv_id", "turn", "speaker", "kind")


@query("""SELECT CAST(l_suppkey AS VARCHAR) AS person, l_orderkey AS meeting_rowid, max(src) AS src FROM (SELECT l_suppkey, l_orderkey, 'speaker' AS src FROM lineitem WHERE l_linenumber = 1
 UNION ALL SELECT l_suppkey, l_orderkey, 'participant' FROM lineitem WHERE l_linenumber <= 3) GROUP BY 1, 2""")
def evidence_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").cast("string").alias("person"), F.col("l_orderkey").alias("meeting_rowid"), "l_linenumber")
    return resolve.person_meetings(li.filter("l_linenumber <= 3").drop("l_linenumber"), li.filter("l_linenumber = 1").drop("l_linenumber"))


@query("SELECT o_orderkey, CASE o_orderstatus WHEN 'O' THEN 0 WHEN 'P' THEN 1 WHEN 'F' THEN 2 ELSE 3 END AS place FROM orders")
def register_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", t.rank(F.col("o_orderstatus"), ("O", "P", "F")).alias("place")).orderBy("place", "o_orderkey")


@query("""SELECT c_name AS from_person, o_orderpriority AS text, strftime(o_orderdate, '%Y-%m-%d') AS due, CAST(o_orderkey AS VARCHAR) AS title FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus = 'O'""")
def open_commitments(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    promises = o.select(F.col("c_name").alias("from_person"), F.lit("").alias("to_person"), F.col("o_orderpriority").alias("text"), day("o_orderdate").alias("due"), F.col("o_orderkey").alias("meeting_rowid"), F.when(F.col("o_orderstatus") == "O", 0).otherwise(1).alias("done"))
    return recipes.open_commitments(order_tables(spark, sf_dir) | {"commitments": promises}).select("from_person", "text", "due", "title")


@query("SELECT event_id, CASE event_type WHEN 'view' THEN '내부-전략' WHEN 'click' THEN '개인-통화' ELSE '기타' END AS category FROM events")
def case_category_canon(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.when(F.col("event_type") == "view", " 회의").when(F.col("event_type") == "click", "통화").otherwise(F.col("event_type"))
    return table(spark, sf_dir, "events").select("event_id", t.category(raw).alias("category"))


@query("SELECT strftime(o_orderdate, '%Y-%m-%d') AS date, CAST(o_orderkey AS VARCHAR) AS title, o_orderpriority AS category FROM orders WHERE o_custkey = 7")
def interaction_timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recipes.interactions(order_tables(spark, sf_dir), "7")


@query("SELECT o_orderkey AS rowid, strftime(o_orderdate, '%Y-%m-%d') AS date FROM orders WHERE strftime(o_orderdate, '%Y-%m-%d') BETWEEN '1996-01-01' AND '1996-03-31' AND o_orderpriority = '2-HIGH'")
def interval_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recipes.meetings_between(order_tables(spark, sf_dir), "1996-01-01", "1996-03-31", "2-HIGH").select("rowid", "date")


@query("""WITH l AS (SELECT l_orderkey, l_partkey, l_suppkey FROM lineitem UNION ALL VALUES (-1, 1, 1), (1, -2, 1), (1, 1, -3))
 SELECT 'order' AS rule, CAST(l_orderkey AS VARCHAR) AS key FROM l WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_orderkey = l_orderkey)
 UNION ALL SELECT 'part', CAST(l_partkey AS VARCHAR) FROM l WHERE NOT EXISTS (SELECT 1 FROM part WHERE p_partkey = l_partkey)
 UNION ALL SELECT 'supplier', CAST(l_suppkey AS VARCHAR) FROM l WHERE NOT EXISTS (SELECT 1 FROM supplier WHERE s_suppkey = l_suppkey)""")
def referential_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = ["l_orderkey", "l_partkey", "l_suppkey"]
    rows = table(spark, sf_dir, "lineitem").select(*columns).unionByName(spark.createDataFrame([(-1, 1, 1), (1, -2, 1), (1, 1, -3)], "l_orderkey long, l_partkey long, l_suppkey long"))
    rules = (("order", "l_orderkey", "orders", "o_orderkey"), ("part", "l_partkey", "part", "p_partkey"), ("supplier", "l_suppkey", "supplier", "s_suppkey"))
    return resolve.union([validate.finding(validate.dangling(rows, c, table(spark, sf_dir, other), key), name, "E", F.col(c), "dangling") for name, c, other, key in rules]).select("rule", "key")


@query("SELECT item_id, doc_id FROM benchmark b JOIN documents d ON contains(d.text, b.text)")
def quote_grounding_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages that stand in documents as they are."""
    quotes = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"), F.col("text").alias("quote"))
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return grounding.verbatim(quotes, docs, doc_index(spark, sf_dir), "text").withColumnRenamed("id", "item_id")


@query()
def quote_grounding_lcs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages grounded in turns and documents by their longest common part, frequent characters kept."""
    models = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"), F.col("text").alias("quote"))
    said = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("utt_id"), F.lit("").alias("speaker"), "text")
    return grounding.ground_quotes(models, said, autojunk=False, candidates=None).withColumn("score", F.round("score", 6))


def _flat(c: str) -> Column:
    """A turn's text on one line, without what could be taken for markup."""
    return F.trim(F.regexp_replace(F.coalesce(F.col(c), F.lit("")), r"[^\p{L}\p{N}]+", " "))


_FLAT = r"trim(regexp_replace(coalesce(text, ''), '[^\p{L}\p{N}]+', ' ', 'g'))"


def _transcripts(turns: DataFrame) -> DataFrame:
    """`rowid`, `body`: conversations as transcripts, their turns as lines of several shapes; headers of every third
    turn have their text on the next lines."""
    ts = F.concat((F.col("turn") / 60).cast("long").cast("string"), F.lit(":"), F.lpad((F.col("turn") % 60).cast("string"), 2, "0"))
    role, said = F.coalesce("role", F.lit("")), _flat("text")
    line = (
        F.when(F.col("turn") % 3 == 0, F.concat(F.lit("**["), role, F.lit("] ("), ts, F.lit(")** "), said))
        .when(F.col("turn") % 3 == 1, F.concat(F.lit("**"), role, F.lit(" ("), ts, F.lit(")**\n"), said))
        .otherwise(F.concat(F.lit("**"), role, F.lit("** (시간: "), ts, F.lit("): "), said))
    )
    files = turns.filter(said != "").groupBy(F.col("conv_id").alias("rowid")).agg(F.array_sort(F.collect_list(F.struct("turn", line.alias("line")))).alias("l"))
    return files.select("rowid", F.array_join(F.transform("l", lambda x: x["line"]), "\n").alias("body"))


@query(f"SELECT conv_id AS rowid, coalesce(role, '') AS speaker_raw, (turn // 60) || ':' || lpad(CAST(turn % 60 AS VARCHAR), 2, '0') AS ts, {_FLAT} AS text FROM conversations WHERE {_FLAT} <> ''")
def utterance_parse_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns written as transcript lines, then parsed."""
    bodies = _transcripts(table(spark, sf_dir, "conversations"))
    return parse.utterances(parse.lines(bodies)).select("rowid", "speaker_raw", "ts", "text")


@query(f"""WITH t AS (SELECT conv_id, turn, role, {_FLAT} AS text FROM conversations WHERE {_FLAT} <> '' AND conv_id % 7 <> 0),
 n AS (SELECT conv_id, row_number() OVER (ORDER BY conv_id) AS rowid FROM (SELECT DISTINCT conv_id FROM t))
 SELECT conv_id, rowid, coalesce(role, '') AS speaker_raw, (turn // 60) || ':' || lpad(CAST(turn % 60 AS VARCHAR), 2, '0') AS ts, text || CASE WHEN conv_id % 5 = 1 THEN ' again' ELSE '' END AS text FROM t JOIN n USING (conv_id)""")
def rebuild_after_edit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as files of a store, which then follows an edit: every seventh is gone, of the others every fifth
    says more. Rows and numbers are those of the edited files."""
    said = table(spark, sf_dir, "conversations")

    def files(turns: DataFrame, edited: Column) -> DataFrame:
        day_of = F.when(edited, "2025-01-02").otherwise("2025-01-01").cast("timestamp")
        made = _transcripts(turns).select(F.lpad(F.col("rowid").cast("string"), 12, "0").alias("path"), day_of.alias("modified"), F.col("body").alias("content"))
        facts = made.select("*", F.length("content").cast("long").alias("length"), F.lit(True).alias("readable"), F.sha2("content", 256).alias("digest"))
        return storage.materialize(facts, "rebuild-files")[0]

    more = F.when(F.col("conv_id") % 5 == 1, F.concat("text", F.lit(" again"))).otherwise(F.col("text"))
    after = said.filter("conv_id % 7 <> 0").withColumn("text", F.when(_flat("text") != "", more))
    store = rebuild.Store(spark, f"{storage.shared_dir(spark)}/rebuild-{uuid.uuid4().hex}")
    for now in (files(said, F.lit(False)), files(after, F.col("rowid") % 5 == 1)):
        store.update(now, lambda since, now=now: now.filter(F.col("modified") >= F.lit(since)))
    return store.parts()["said"].select(F.col("path").cast("long").alias("conv_id"), "rowid", "speaker_raw", "ts", "text")


@query("""SELECT o_orderkey AS rowid, CASE WHEN o_orderstatus = 'O' THEN 0 ELSE 1 END AS done, CAST(o_custkey AS VARCHAR) AS from_raw, 'desk' AS to_raw, 'send ' || o_orderpriority AS text,
 CASE WHEN o_orderkey % 2 = 0 THEN strftime(o_orderdate, '%Y-%m-%d') ELSE '' END AS due FROM orders""")
def commitment_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    mark = F.when(F.col("o_orderstatus") == "O", " ").otherwise("x")
    due = F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit(" (기한: "), day("o_orderdate"), F.lit(")"))).otherwise("")
    arrow = F.when(F.col("o_orderkey") % 3 == 0, "->").otherwise("→")
    line = F.concat(F.lit("- ["), mark, F.lit("] ("), F.col("o_custkey").cast("string"), arrow, F.lit("desk) send "), "o_orderpriority", due)
    found = parse.commitments(parse.lines(o.select(F.col("o_orderkey").alias("rowid"), line.alias("body"))))
    return found.select("rowid", "done", "from_raw", "to_raw", "text", "due")


@query("SELECT lpad(CAST(doc_id AS VARCHAR), 12, '0') AS path, source AS source_id, lang AS title, n_chars AS duration_min, source || ', ' || lang AS participants FROM documents")
def frontmatter_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    head = F.concat(F.lit("---\nsource_id: first\nsource_id: "), "source", F.lit('\ntitle: "'), "lang", F.lit('"\nduration_min: '), F.col("n_chars").cast("string"), F.lit('\nparticipants: ["'), "source", F.lit('", '), "lang", F.lit("]\n---\n"), F.coalesce("text", F.lit("")))
    files = d.select(F.lpad(F.col("doc_id").cast("string"), 12, "0").alias("path"), head.alias("content"), F.lit(True).alias("readable"))
    return parse.meetings(files, numbered=False).select("path", "source_id", "title", "duration_min", "participants")


@query("""WITH i AS (SELECT CAST(l_suppkey AS VARCHAR) AS owner, l_returnflag || l_linestatus AS category, count(*) OVER (PARTITION BY l_suppkey) AS o, count(*) OVER (PARTITION BY l_suppkey, l_returnflag || l_linestatus) AS c FROM lineitem)
 SELECT CASE WHEN o > 600 THEN owner || '-' || CASE WHEN c < 20 THEN '기타' ELSE category END ELSE 'person-' || owner END AS task_key, count(*) AS instances FROM i GROUP BY 1""")
def task_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").cast("string").alias("owner"), F.concat("l_returnflag", "l_linestatus").alias("category"))
    return batch.needed(batch.tasks(items.limit(0), items, split_above=600, fold_below=20)).select("task_key", "instances")


@query("""WITH r AS (SELECT strftime(o_orderdate, '%Y-%m-%d') AS date, CAST(o_orderkey AS VARCHAR) AS change, row_number() OVER (PARTITION BY strftime(o_orderdate, '%Y-%m') ORDER BY strftime(o_orderdate, '%Y-%m-%d'), CAST(o_orderkey AS VARCHAR)) AS a,
 row_number() OVER (PARTITION BY strftime(o_orderdate, '%Y-%m') ORDER BY strftime(o_orderdate, '%Y-%m-%d') DESC, CAST(o_orderkey AS VARCHAR) DESC) AS b FROM orders) SELECT DISTINCT date, change FROM r WHERE a = 1 OR b = 1""")
def timeline_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    pool = table(spark, sf_dir, "orders").select(day("o_orderdate").alias("date"), F.col("o_orderkey").cast("string").alias("signal"))
    return batch.merge_timeline(spark.createDataFrame([], "date string, meeting string, change string"), pool).select("date", "change")


@query("""SELECT CAST(p_partkey AS VARCHAR) AS id, p_name AS title FROM part WHERE p_partkey % 3 <> 0
 UNION ALL SELECT CASE WHEN p_partkey % 3 = 0 THEN CAST(p_partkey AS VARCHAR) ELSE p_partkey || '-2' END, 'new' FROM part WHERE p_partkey % 3 = 0 OR p_partkey % 10 = 1""")
def merge_carry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as models: every third was given to a task that returns it; some returned ids are taken."""
    p = table(spark, sf_dir, "part")
    key = F.col("p_partkey").cast("string").alias("id")
    base = p.select(key, F.col("p_name").alias("title"), F.array("p_brand").alias("holders"))
    assigned = p.filter("p_partkey % 3 = 0").select(key, F.lit("k").alias("key"))
    made = p.filter("p_partkey % 3 = 0 or p_partkey % 10 = 1").select(key, F.lit("new").alias("title"), F.array("p_brand").alias("holders"), F.lit("k").alias("key"), F.col("p_partkey").alias("pos"))
    return batch.merge_models(base, assigned, made).select("id", "title")


@query("SELECT doc_id, replace(text, 'trash', '(삭제)') AS text, CAST((length(text) - length(replace(text, 'trash', ''))) / 5 AS INTEGER) AS mentions FROM documents WHERE contains(text, 'trash')")
def erase_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = table(spark, sf_dir, "documents").filter(F.contains("text", F.lit("trash"))).select(F.col("doc_id").alias("path"), F.col("text").alias("content"))
    return erase.erase_transcripts(files, ["trash"]).select(F.col("path").alias("doc_id"), F.col("content").alias("text"), "mentions")


#: People to erase from documents: names made of two of these, many within others or across them.
_SYLLABLES = ("an", "at", "ea", "ed", "en", "er", "es", "ha", "he", "ing", "is", "nd", "or", "re", "th", "tion")
_NAMES = sorted({a + b for a in _SYLLABLES for b in _SYLLABLES}, key=lambda n: (-len(n), n))
_NAMES_SQL = "[" + ", ".join(f"'{n}'" for n in _NAMES) + "]"


@query(f"""SELECT doc_id, list_reduce(list_prepend(text, {_NAMES_SQL}), lambda done, name: replace(done, name, '(삭제)')) AS text,
 coalesce(CAST(list_sum(list_transform({_NAMES_SQL}, lambda name: (length(text) - length(replace(text, name, ''))) // length(name))) AS INTEGER), 0) AS mentions
 FROM (SELECT doc_id, nfc_normalize(text) AS text FROM documents)""")
def erase_many_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Some 250 names erased from all documents in one pass."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return erase_many.erase_texts(docs, "text", [(n, [n]) for n in _NAMES]).select("doc_id", "text", "mentions")


@query("""WITH h AS (SELECT DISTINCT l_orderkey AS o, s_name AS s FROM lineitem JOIN supplier ON l_suppkey = s_suppkey), k AS (SELECT o, string_agg(s, ',' ORDER BY s) AS holders FROM h WHERE s <> 'Supplier#000000001' GROUP BY 1)
 SELECT CAST(k.o AS VARCHAR) AS id, k.holders, coalesce(CAST(n.o AS VARCHAR), '') AS related FROM k LEFT JOIN k n ON n.o = k.o + 1""")
def document_erase(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as beliefs that their suppliers hold, each related to the next: one supplier is erased."""
    held = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "supplier"), F.col("l_suppkey") == F.col("s_suppkey")).groupBy("l_orderkey").agg(F.sort_array(F.collect_set("s_name")).alias("holders"))
    models = held.select(F.col("l_orderkey").alias("pos"), F.col("l_orderkey").cast("string").alias("id"), "holders", F.array((F.col("l_orderkey") + 1).cast("string")).alias("related"))
    doc = document.empty(spark)
    name = "Supplier#000000001"
    after = document.erased(doc | {"models": doc["models"].unionByName(models, allowMissingColumns=True)}, name, [name])
    return after["models"].select("id", F.array_join("holders", ",").alias("holders"), F.array_join("related", ",").alias("related"))


@query("""WITH o AS (SELECT strftime(o_orderdate, '%Y-%m-%d') AS date, CAST(o_orderkey AS VARCHAR) AS change, o_orderstatus AS s FROM orders), r AS (SELECT *, row_number() OVER (PARTITION BY date[:7] ORDER BY date, change) AS a,
 row_number() OVER (PARTITION BY date[:7] ORDER BY date DESC, change DESC) AS b FROM o), t AS (SELECT date FROM r WHERE s = 'F' OR a = 1 OR b = 1) SELECT min(date) || ' ~ ' || max(date) AS date_range, count(*) AS entries FROM t""")
def document_merge_span(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Finished orders as a timeline, into which a batch of all orders is merged: what it spans, and its entries."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", day("o_orderdate").alias("date"), F.col("o_orderkey").cast("string").alias("change"))
    doc = document.empty(spark)
    told = o.filter("o_orderstatus = 'F'").select(F.col("o_orderkey").cast("long").alias("pos"), "date", F.lit(None).cast("string").alias("meeting"), "change")
    registry = spark.createDataFrame([], "pos long, name string")
    assigned = spark.createDataFrame([], "id string, key string")
    new = document.merged(doc | {"timeline": told}, registry, assigned, spark.createDataFrame([], schemas.SYNTHESIS), {"timeline": o.select("date", F.col("change").alias("signal"))})
    return new["meta"].select("date_range").crossJoin(new["timeline"].agg(F.count("*").alias("entries")))  # one row each


@query("SELECT coalesce(role, '') AS kind, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (), 1) AS share FROM conversations GROUP BY 1")
def attribution_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = table(spark, sf_dir, "conversations").select(F.coalesce("role", F.lit("")).alias("kind"))
    return recipes.attribution({"utterances": said}).withColumn("share", F.col("share").cast("double"))


@query()
def fuzzy_date_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as meetings, matched with catalog entries of their date by title."""
    o = table(spark, sf_dir, "orders")
    met = o.select(F.col("o_orderkey").alias("pos"), day("o_orderdate").alias("date"), F.concat_ws(" ", F.lit("call with"), F.col("o_custkey").cast("string")).alias("title"), F.lit("").alias("source_id"), F.lit("").alias("path"))
    entries = o.select(F.col("o_orderkey").alias("pos"), day("o_orderdate").alias("date"), F.concat_ws(" ", F.lit("Call w/"), F.col("o_custkey").cast("string")).alias("title"), F.col("o_orderkey").cast("string").alias("source_id"), F.col("o_orderkey").cast("string").alias("path"))
    return migrate.match_meetings(met, entries).select(F.col("pos").alias("order_id"), "source_id")


@query("SELECT c_custkey, CASE WHEN c_acctbal > 7000 THEN 'assert' WHEN c_acctbal > 2000 THEN 'hedge' ELSE 'admit' END AS assertion, coalesce(date_diff('day', CAST(m AS DATE), (SELECT CAST(max(o_orderdate) AS DATE) FROM orders)) > 180, false) AS stale FROM customer LEFT JOIN (SELECT o_custkey, max(o_orderdate) AS m FROM orders GROUP BY 1) ON c_custkey = o_custkey")
def evidence_assertions(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = order_tables(spark, sf_dir)
    last = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.max(day("o_orderdate")).alias("last_seen"))
    grade = F.when(F.col("c_acctbal") > 7000, "high").when(F.col("c_acctbal") > 2000, "mid").otherwise("low")
    models = table(spark, sf_dir, "customer").join(last, F.col("c_custkey") == F.col("o_custkey"), "left").select(F.col("c_custkey").alias("id"), grade.alias("evidence"), "last_seen", F.lit("").alias("first_seen"))
    return recipes.assertions(x | {"models": models}).select(F.col("id").alias("c_custkey"), "assertion", "stale")


@query("""SELECT person, other, kind FROM (SELECT CAST(l_suppkey AS VARCHAR) AS person, CAST(l_partkey AS VARCHAR) AS other, l_returnflag AS kind FROM lineitem
 UNION ALL SELECT CAST(l_partkey AS VARCHAR), CAST(l_suppkey AS VARCHAR), l_returnflag FROM lineitem WHERE l_suppkey <> l_partkey)""")
def edges_from_both_ends(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").cast("string").alias("a"), F.col("l_partkey").cast("string").alias("b"), F.col("l_returnflag").alias("kind"), F.lit("").alias("since"), F.lit("").alias("note"))
    return recipes.dossier_network({"network": li}).select("person", "other", "kind")


@query("""SELECT CAST(p_partkey AS VARCHAR) AS title, string_agg(DISTINCT CAST(l_suppkey AS VARCHAR), ', ' ORDER BY CAST(l_suppkey AS VARCHAR)) AS held_by FROM part LEFT JOIN lineitem ON p_partkey = l_partkey WHERE p_brand ILIKE '%#1%' GROUP BY 1""")
def beliefs_about(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, li = table(spark, sf_dir, "part"), table(spark, sf_dir, "lineitem")
    key = F.col("p_partkey").cast("string")
    x = {
        "models": p.select(key.alias("id"), key.alias("title"), F.lit("").alias("evidence"), F.lit("").alias("quote")),
        "model_about": p.select(key.alias("model_id"), F.col("p_brand").alias("entity")),
        "model_people": li.select(F.col("l_partkey").cast("string").alias("model_id"), F.col("l_suppkey").cast("string").alias("person")).distinct(),
    }
    return recipes.beliefs_about(x, "#1").select("title", "held_by")


@query("SELECT CAST(o_custkey AS VARCHAR) AS person, count(DISTINCT o_orderkey) AS n, min(strftime(o_orderdate, '%Y-%m-%d')) AS first_met, max(strftime(o_orderdate, '%Y-%m-%d')) AS last_met, count(DISTINCT o_orderkey) >= 3 AS promote FROM orders WHERE o_custkey % 2 = 1 GROUP BY 1")
def unregistered_contacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    registry = table(spark, sf_dir, "customer").filter("c_custkey % 2 = 0").select(F.col("c_custkey").cast("string").alias("name"))
    return recipes.contacts(order_tables(spark, sf_dir), registry)
