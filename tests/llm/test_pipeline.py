"""The corpus pipeline on small tables with odd rows: what each stage drops, and what it must leave."""

import random

import corpus_pipeline

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def test_stages_drop_what_they_should(spark, tmp_path):
    rng = random.Random(1)
    prose = lambda n: " ".join(f"w{rng.randrange(10**6)}" for _ in range(n))
    clean = [(i, prose(40)) for i in range(20)]
    base, item = prose(60), prose(20)
    near = [(100 + i, base.replace(base.split()[5 * i], "x")) for i in range(3)]
    leak = [(200, f"{prose(10)} {item} {prose(5)}"), (201, f"{prose(30)} {item}")]
    lines = [(300 + i, f"Menu line\n{prose(30)}") for i in range(10)]
    odd = [(400, None), (401, ""), (None, prose(30)), (None, None), (402, clean[0][1]), (403, prose(30)), (403, prose(30)), (404, prose(9)), (404, None)]
    odd[8] = odd[7]
    rows = [(i, t, None if i == 401 else "en", "s" if (i or 0) % 2 else None, len(t or "")) for i, t in clean + near + leak + lines + odd]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i, _ in clean] + [(None, 1, 0), (5, None, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item), (2, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs, kept = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, str(tmp_path))
        if name != "mixing":
            assert docs.columns == corpus_pipeline.COLUMNS
            docs.write.parquet(f"{tmp_path}/{name}")
            docs = spark.read.schema(SCHEMA).parquet(f"{tmp_path}/{name}")
        kept[name] = docs.collect()
    assert len(kept["quality"]) == len(rows)  # one label alone rejects nothing
    assert not any("Menu line" in (r.text or "") for r in kept["line_dedup"]) and len(kept["line_dedup"]) == len(rows)
    ids = sorted(-1 if r.doc_id is None else r.doc_id for r in kept["near_dedup"])
    assert ids == sorted([-1, -1, *range(20), 100, 200, 201, *range(300, 310), 400, 401, 403, 403, 404])
    assert {r.doc_id for r in kept["near_dedup"]} - {r.doc_id for r in kept["decontamination"]} == {200, 201}
    assert len(kept["mixing"]) == len(kept["decontamination"]) and all(r.taken <= 3 * r.size for r in kept["mixing"])


def test_stages_of_empty_tables_and_clashing_names(spark, tmp_path):
    """A stage of no rows has none, with the columns of documents; columns that operators use for themselves change nothing."""
    empty = lambda schema: spark.createDataFrame([], schema)
    empty(SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    empty("doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    empty("item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = [(1, "one two three four five six", "en", "s", 27), (2, "one two three four five six", "en", None, 27), (None, None, None, None, None), (3, "", "de", "t", 0)]
    some = spark.createDataFrame(rows, SCHEMA)
    crowded = some
    for name in ("score", "label", "text_hash", "n_shingles", "stays", "items", "kept_text", "size", "taken", "target", "part", "uid"):
        crowded = crowded.withColumn(name, some.doc_id.cast("string"))
    for name, stage in corpus_pipeline.STAGES:
        none = stage(spark, empty(SCHEMA), str(tmp_path))
        assert none.count() == 0 and (name == "mixing" or none.columns == corpus_pipeline.COLUMNS)
        plain = stage(spark, some, str(tmp_path))
        assert sorted(map(str, stage(spark, crowded, str(tmp_path)).select(*plain.columns).collect())) == sorted(map(str, plain.collect()))
