"""Registered grounding query against brute force over all documents."""

from colloquy.functions import text as t
from colloquy.plans.queries import QUERIES


def test_lcs_scores_all_documents(spark, tmp_path):
    items = [(1, "the quick marmalade overtook a sleepy zeppelin today"), (2, "un café très naïf était là même où il gèle")]
    docs = [(i, f"zeppelin number {i} met marmalade and overtook sleepy people quick today") for i in range(450)]
    docs += [(i, f"caf tr na tait {i} m me g le il") for i in range(450, 890)]
    docs += [(900, "so " + items[0][1] + " again"), (901, "so " + items[1][1] + " again")]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.id: r.score for r in QUERIES["quote_grounding_lcs"](spark, str(tmp_path)).collect()}
    bare = lambda s: s.replace(" ", "")
    want = {i: round(max(t.common_share(bare(q), bare(d), False) for _, d in docs), 6) for i, q in items}
    assert got == want == {1: 1.0, 2: 1.0}
