from spanforge.sources import structured, text_formats as t


def test_bio_text_and_corpus(spark, tmp_path):
    (tmp_path / "a.txt").write_text("Marie x B-per\nCurie I-per\nlone\n  \nno O\nent O\n\n\nParis B-loc\nis O")
    rows = t.bio_text(spark, str(tmp_path / "a.txt"))
    got = sorted((r.sent_id, r.pos, r.token, r.tag) for r in rows.collect())
    assert got == [(0, 0, "Marie", "B-per"), (0, 1, "Curie", "I-per"), (1, 0, "no", "O"), (1, 1, "ent", "O"), (2, 0, "Paris", "B-loc"), (2, 1, "is", "O")]
    corpus = t.load_corpus(rows, ["file", "sent_id"], "sent_id", 1).collect()
    assert [(r.text, [tuple(s) for s in r.spans]) for r in corpus] == [("Marie Curie", [(0, 11, "per")])]


CONLLU = "\n".join(
    ["# newdoc", *("\t".join([i, w, *["_"] * 7, m]) for i, w, m in [("1", "The", "Entity=(4-person-new(5-place-x"), ("2-3", "don't", "Entity=(9-x"), ("2", "old", "SpaceAfter=No|Entity=5)"), ("2.1", "null", "_"), ("3", "man", "Entity=4)4)"), ("4", "it", "Entity=(7-object-coref)"), ("5", "x", "Entity=8)")])]
) + "\n\n" + "\t".join(["1", "End", *["_"] * 7, "Entity=4)"]) + "\nshort\tline\n"


def test_conllu_brackets(spark, tmp_path):
    (tmp_path / "d.conllu").write_text(CONLLU)
    words = t.conllu(spark, str(tmp_path / "d.conllu"))
    assert sorted((r.sent_id, r.pos, r.token) for r in words.collect()) == [(0, 0, "The"), (0, 1, "old"), (0, 2, "man"), (0, 3, "it"), (0, 4, "x"), (1, 0, "End")]
    found = sorted((r.sent_id, r.start_off, r.end_off, r.label) for r in t.bracket_spans(words, ["file", "sent_id"]).collect())
    assert found == [(0, 0, 7, "place"), (0, 0, 11, "person")]


def test_split_list(spark, tmp_path):
    (tmp_path / "s.md").write_text("# top\n* early\n## dev\n* GUM_a\n  * GUM_b\ntext\n## test\n* GUM_c\n")
    splits = t.split_list(spark, str(tmp_path / "s.md"))
    assert sorted(map(tuple, splits.collect())) == [("dev", "GUM_a"), ("dev", "GUM_b"), ("test", "GUM_c")]
    docs = spark.createDataFrame([("GUM_a",), ("GUM_z",), ("GENTLE_q",)], "doc string")
    assert sorted(map(tuple, t.split_docs(docs, splits).collect())) == [("GENTLE_q", "special_test"), ("GUM_a", "dev"), ("GUM_z", "train")]


def test_logs(spark, tmp_path):
    (tmp_path / "q.log").write_text("[t] a : done exit=0 10s\n[t] b : done exit=-1073 5s\n[t] a [RESUME] : done exit=1 12s\nnoise\n")
    assert [tuple(r) for r in t.queue_log(spark, str(tmp_path / "q.log")).collect()] == [("a", 12)]
    for run, lines in (("r1", "1 0.5 0\n2 0.75 1\n"), ("r2", ""), (".trash/r3", "1 9 0")):
        (tmp_path / "exp" / run / "metrics").mkdir(parents=True)
        (tmp_path / "exp" / run / "metrics" / "f1").write_text(lines)
    assert [tuple(r) for r in t.metric_files(spark, str(tmp_path / "exp" / "r*" / "metrics" / "*")).collect()] == [("r1", "f1", 0.75, 1)]


def test_tag_maps_and_registry(spark, tmp_path):
    rows = spark.createDataFrame([(1, ["a", "b", "c"], [13, 1, 99])], "sent_id long, tokens array<string>, tags array<int>")
    rows.write.parquet(str(tmp_path / "train"))
    registry = structured.Registry()
    registry.add("movie", "parquet_tags", f"{tmp_path}/{{split}}", "mit_movie_trivia")
    row = registry.read(spark, "movie", "train").first()
    assert (row.text, [tuple(s) for s in row.spans]) == ("a b c", [(0, 3, "ACTOR")])
    for bad in (lambda: registry.read(spark, "none", "train"), lambda: registry.add("x", "csv", "p")):
        try:
            bad()
            raise AssertionError
        except (KeyError, ValueError):
            pass
    assert registry.names() == ["movie"]


def test_document_json_round_trip(spark, tmp_path):
    corpus = spark.createDataFrame([(1, "Marie Curie won", [(0, 11, "per"), (12, 12, "none")]), (2, "x", [])], "sent_id long, text string, spans array<struct<start_off:int,end_off:int,label:string>>")
    docs = structured.to_doc_json(corpus)
    assert {r.id: [tuple(e) for e in r.entities] for r in docs.collect()} == {"1": [("per", 0, 0, 2)], "2": []}
    import json

    body = {"documents": [json.loads(r) for r in docs.toJSON().collect()], "metadata": {"entity_types": ["per"]}}
    (tmp_path / "d.json").write_text(json.dumps(body))
    back = {(r.id, r.text): r.spans and [tuple(s) for s in r.spans] for r in structured.read_doc_json(spark, str(tmp_path / "d.json")).collect()}
    assert back == {("1", "Marie Curie won"): [(0, 11, "per")], ("2", "x"): None}


def test_reports(spark, tmp_path):
    (tmp_path / "r1.json").write_text('{"results": {"a": {"f1": 0.5}, "b": {"f1": 0.1}}}')
    (tmp_path / "r2.json").write_text('{"results": {"a": {"f1": 0.75}}}')
    rows = structured.report_metrics(spark, str(tmp_path / "r*.json"))
    assert sorted(map(tuple, rows.collect())) == [("a", "f1", 0.75), ("b", "f1", 0.1)]
    (tmp_path / "c.yaml").write_text("labels:\n  - {name: per, n: 1}\n")
    assert structured.read_yaml(spark, str(tmp_path / "c.yaml"), "labels").first().name == "per"
    assert [r.line for r in structured.markdown(rows.orderBy("dataset"), ["dataset", "value"]).collect()] == ["| a | 0.75 |", "| b | 0.1 |"]
    cells = spark.createDataFrame([("m", "a", 1.0), ("m", "a", 2.0)], "model string, dataset string, value double")
    assert structured.mean_std_cells(cells).first().cell == "1.5±0.7"


def test_corpora_and_runs(spark):
    docs = spark.createDataFrame([("GUM_a",), ("GUM_b",), ("GENTLE_x",)], "doc string")
    splits = spark.createDataFrame([("dev", "GUM_a"), ("test2", "GENTLE_x")], "split string, doc string")
    of = lambda corpus, split: sorted(r.doc for r in t.documents_of(docs, splits, corpus, split).collect())
    assert of("main", "train") == of("special", "train") == ["GUM_b"] and of("main", "validation") == ["GUM_a"] and of("main", "test") == [] and of("special", "test") == ["GENTLE_x"]
    runs = spark.createDataFrame([("d", "r1", "m", "s", 1.0, 5), ("d", "r2", "x", "s", 2.0, 9), ("d", "r3", "m", "s", None, 99), (None, "r4", "m", "s", 1.0, 1)], "dataset string, run string, model string, state string, value double, changed long")
    assert [tuple(r) for r in t.best_runs(runs, "m").collect()] == [("d", "r1", 1.0)] and [tuple(r) for r in t.best_runs(runs).collect()] == [("d", "r2", 2.0)] and t.best_runs(runs, states=["z"]).count() == 0
    sizes = spark.createDataFrame([("a", "validation", 1, 1), ("b", "train", 1, 0), ("b", "test", 1, 1), ("c", "test", 1, 1), ("d", "train", 1, 1), ("e", "train", 1, 1), ("e", "test", 1, 0)], "dataset string, split string, n_sentences long, n_spans long")
    assert {r.dataset: (r.fit_split, r.eval_split, r.status) for r in t.choose_splits(sizes).collect()} == {"a": ("validation", "validation", "ok"), "b": ("train", "test", "failed_fit"), "c": (None, "test", "failed_load_train"), "d": ("train", None, "failed_load_test"), "e": ("train", "test", "no_eval_spans")}


def test_export_summary(spark):
    corpus = spark.createDataFrame([(i, "Marie Curie", [(0, 5, "per"), (6, 6, "none")]) for i in range(12)], "sent_id long, text string, spans array<struct<start_off:int,end_off:int,label:string>>")
    docs = structured.to_doc_json(corpus)
    row = structured.doc_json_summary(corpus, docs).first()
    assert (row.n_docs, row.n_entities, row.n_dropped, row.entity_types) == (12, 12, 12, ["per"])
    assert [r.id for r in structured.dev_sample(docs, 3).collect()] == ["0", "1", "2"]


def test_parameter_files(spark, tmp_path):
    for run, name, value in (("r1", "dataset", "conll"), (".trash/r9", "dataset", "x")):
        (tmp_path / run / "params").mkdir(parents=True)
        (tmp_path / run / "params" / name).write_text(value + "\n")
    got = t.parameter_files(spark, str(tmp_path / "r*" / "params" / "*")).collect()
    assert [(r.run, r.name, r.value.strip()) for r in got] == [("r1", "dataset", "conll")]


def test_standard_registry(spark, tmp_path):
    known = structured.standard_registry(str(tmp_path))
    assert known.names() == sorted(structured.CORPORA) and len(known.names()) == 14
    (tmp_path / "crossner_ai").mkdir()
    (tmp_path / "crossner_ai" / "dev.txt").write_text("Paris B-loc\n\nno O\n")
    assert [r.text for r in known.read(spark, "crossner_ai", "validation").collect()] == ["Paris"]
    rows = [(["Old", "York"], [1, 2]), (["x"], [0])]
    spark.createDataFrame(rows, "tokens array<string>, ner_tags array<long>").coalesce(1).write.parquet(f"{tmp_path}/wnut17/test.parquet")
    (tmp_path / "wnut17" / "labels.txt").write_text("O\nB-place\nI-place\n")
    got = known.read(spark, "wnut17", "test").collect()
    assert [(r.text, [tuple(s) for s in r.spans]) for r in got] == [("Old York", [(0, 8, "place")])]
    spark.createDataFrame([(["Anna"], [6])], "tokens array<string>, tags array<int>").write.parquet(f"{tmp_path}/bionlp2004/test.parquet")
    assert [r.spans[0].label for r in known.read(spark, "bionlp2004", "test").collect()] == ["cell_type"]
    (tmp_path / "gum" / "dep").mkdir(parents=True)
    for doc in ("GUM_a", "GUM_b", "GENTLE_c"):
        (tmp_path / "gum" / "dep" / f"{doc}.conllu").write_text(CONLLU.replace("The", doc))
    (tmp_path / "gum" / "splits.md").write_text("## test\n* GUM_a\n")
    first = lambda name, split: sorted(r.text.split()[0] for r in known.read(spark, name, split).collect())
    assert first("gum", "test") == ["GUM_a"] and first("gum", "train") == ["GUM_b"] and first("gentle", "test") == ["GENTLE_c"]


def test_report_and_table_sinks(spark, tmp_path):
    rows = spark.createDataFrame([("d_1", "f1", 0.5), ("d_1", "ami", None), ('q"', "f1", 1.0)], "dataset string, metric string, value double")
    structured.write_report(rows, str(tmp_path / "r"), {"seed": 1})
    import json

    text = next((tmp_path / "r").glob("part-*")).read_text()
    assert json.loads(text) == {"params": {"seed": 1}, "results": {"d_1": {"f1": 0.5}, 'q"': {"f1": 1.0}}}
    assert sorted(map(tuple, structured.report_metrics(spark, str(tmp_path / "r")).collect())) == [("d_1", "f1", 0.5), ('q"', "f1", 1.0)]
    table = spark.createDataFrame([("a_b & 5%", 1), (None, 2)], "name string, n int")
    structured.write_table(structured.latex(table, ["name", "n"]), ["name", "n_x"], str(tmp_path / "t"), "latex")
    lines = next((tmp_path / "t").glob("part-*")).read_text().splitlines()
    assert lines == [r"\begin{tabular}{ll}", r"\toprule", r"name & n\_x \\", r"\midrule", r"a\_b \& 5\% & 1 \\", r" & 2 \\", r"\bottomrule", r"\end{tabular}"]
    structured.write_table(structured.markdown(table, ["name", "n"]), ["name", "n"], str(tmp_path / "m"))
    assert next((tmp_path / "m").glob("part-*")).read_text().splitlines()[:3] == ["| name | n |", "|---|---|", "| a_b & 5% | 1 |"]
