import corpus_pipeline


def test_near_copies_go(spark, tmp_path):
    flat = " ".join(f"flat{k}" for k in range(120))
    docs = spark.createDataFrame([(7, flat), (8, flat.replace("flat60 ", "flat61 "))], "doc_id bigint, text string")
    assert [r.doc_id for r in corpus_pipeline.drop_near_duplicates(spark, docs, str(tmp_path)).collect()] == [7]


def test_stages(spark, tmp_path):
    long = "\n".join(" ".join(f"word{k}x{j}" for k in range(30)) for j in range(6))
    item = " ".join(f"bench{k}" for k in range(40))
    flat = " ".join(f"flat{k}" for k in range(120))
    docs = [(1, long, "en"), (2, long, "en"), (3, "other words entirely\n" + long.split("\n")[2], "en"), (4, "12 34", "en"), (5, None, None), (6, item + " and more", None), (7, flat, "en"), (8, flat.replace("flat60 ", "flat61 "), "en")]
    spark.createDataFrame([(i, t, g, "s", len(t or "")) for i, t, g in docs], "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    now, seen = spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, now, str(tmp_path)).write.parquet(f"{tmp_path}/{k}")
        now = spark.read.parquet(f"{tmp_path}/{k}")
        seen.append({r.doc_id for r in now.select("doc_id").collect()})
        if k < 4:
            assert now.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert seen[0] == {1, 2, 3, 6, 7, 8} and seen[1] == {1, 3, 6, 7, 8} and seen[2] >= {1, 3, 6, 7} and 6 not in seen[3] and seen[4] == seen[3]
    third = spark.read.parquet(f"{tmp_path}/1").filter("doc_id = 3").first()
    assert third.text == "other words entirely" and third.n_chars == len(third.text)


SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, n_cut int, score string, _print0 string"


def odd_rows():
    item = " ".join(f"bench{k}" for k in range(40))
    clean = " ".join(f"clean{k}" for k in range(60))
    texts = [(1, item), (1, clean), (None, clean + " more"), (2, None), (3, ""), (4, "only a few words"), (4, "only a few words"), (5, "x" * 200_000 + " long")]
    return item, clean, [(i, t, None, None, None, 7, "mine", "own") for i, t in texts]


def test_rows_of_equal_ids_are_judged_apart(spark, tmp_path):
    item, clean, rows = odd_rows()
    spark.createDataFrame([(1, item)], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    left = corpus_pipeline.drop_contaminated(spark, spark.createDataFrame(rows, SCHEMA), str(tmp_path))
    assert sorted((r.doc_id or 0, r.text or "") for r in left.collect()) == sorted((i or 0, t or "") for i, t, *_ in rows if t != item)


def test_stages_keep_odd_rows_and_columns(spark, tmp_path):
    item, clean, rows = odd_rows()
    spark.createDataFrame([(1, item)], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    rows += [(k, f"labelled text number {chr(97 + k % 26)} {chr(100 + k % 20)}", "en", None, None, 7, "mine", "own") for k in range(100, 120)]
    docs = spark.createDataFrame(rows, SCHEMA)
    gone = {"language ID": {2, 3}, "line dedup": set(), "SimHash near-dedup": set(), "benchmark decontamination": set()}
    for name, stage in corpus_pipeline.STAGES[:4]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns
        found = out.collect()
        assert all((r.n_cut, r.score, r["_print0"]) == (7, "mine", "own") for r in found), name
        ids = {r.doc_id for r in found}
        if name == "SimHash near-dedup":
            assert ids >= {1, None, 4, 5} and len(ids & {2, 3}) == 1, name  # null and blank texts are alike
        else:
            assert {1, None, 2, 3, 4, 5} - ids == gone[name], name
        empty = stage(spark, spark.createDataFrame([], SCHEMA), str(tmp_path))
        assert empty.count() == 0 and empty.columns == docs.columns
    pieces = corpus_pipeline.pack_sequences(spark, docs, str(tmp_path))
    assert {r.doc_id for r in pieces.collect()} >= {1, None, 2, 3, 4, 5}
    assert corpus_pipeline.pack_sequences(spark, spark.createDataFrame([], SCHEMA), str(tmp_path)).count() == 0


def test_packing_keeps_columns_of_any_name(spark):
    from ontoflow.llm import packing

    rows = [(k, 1 + k % 900, "a", "b", "c", "d") for k in range(300)]
    packed = packing.pack(spark.createDataFrame(rows, "id int, length bigint, _part string, _row string, _rank string, _key string")).collect()
    assert {(r.id, r.length, r["_part"], r["_row"], r["_rank"], r["_key"]) for r in packed} == set(rows)
