"""Numbers and ids that must stay unique: rows numbered under different plans, models merged twice."""

from pyspark.sql import functions as F

from colloquy import schemas
from colloquy.operators import batch, parse


def test_rows_keep_their_numbers_under_any_plan(spark):
    df = spark.range(100_000, numPartitions=7).select(F.sha2(F.col("id").cast("string"), 256).alias("path"), F.repeat(F.lit("x"), 50).alias("content"), "id")
    numbered = parse.number_rows(df, "path", "rowid")
    both = numbered.select("path", "rowid").join(numbered.select("path", "id", F.col("rowid").alias("again")), "path")
    got = both.agg(F.countDistinct("rowid").alias("n"), F.min("rowid").alias("least"), F.max("rowid").alias("most"), F.count_if(F.col("rowid") != F.col("again")).alias("odd")).first()
    assert tuple(got) == (100_000, 1, 100_000, 0)
    first = [r.path for r in numbered.orderBy("rowid").limit(50).collect()]
    assert first == [r.path for r in df.orderBy("path").limit(50).collect()]
    assert parse.number_rows(df.limit(0), "path", "rowid").count() == 0


def test_models_merged_again_keep_unique_ids(spark):
    model = lambda i, title: {"id": i, "title": title, "holders": ["Ada"]}
    rows = lambda *found: [tuple(r.get(n) for n in schemas.MODEL.names) for r in found]
    made_type = schemas.StructType([*schemas.MODEL.fields, schemas.StructField("key", schemas.StringType()), schemas.StructField("pos", schemas.IntegerType())])
    base = spark.createDataFrame(rows(model("x", "a"), model("x-2", "b"), model("y-7", "c")), schemas.MODEL)
    assigned = spark.createDataFrame([], "id string, key string")
    batch_of = [model("x", "d"), model("x", "e"), model("y", "f"), model("y", "g"), model("z", "h")]
    made = spark.createDataFrame([(*r, "k", i) for i, r in enumerate(rows(*batch_of))], made_type)
    got = {r.title: r.id for r in batch.merge_models(base, assigned, made).collect()}
    assert got == {"a": "x", "b": "x-2", "c": "y-7", "d": "x-3", "e": "x-4", "f": "y", "g": "y-8", "h": "z"}
