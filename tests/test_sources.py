import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from softdeps import discover_all
from softdeps.functions.lexicon import score_lexicon
from softdeps.operators.topk import append, top_k, top_k_per_window
from softdeps.plans.report import dependency_profile
from softdeps.operators.stats import metrics_summary, table_profile
from softdeps.sources.messages import MESSAGE_SCHEMA, RECORD_SCHEMA, escape_newlines, filter_records, flatten_message, parse_messages, route_by_word_count
from softdeps.sources.sinks import write_rfds
from softdeps.sources.tables import corpus_profile, first_lines, infer_dialect, read_corpus, read_table
from softdeps.streaming.topk import read_messages, run_until, start_sink, stream_top_k

ANIMALS = "name;sex;age;date\nrex;m;3;2016/05/04\nada;f;?;2017/01/01\nbo;;5;\nkim;f;4;2018/02/03\n"


def put(folder, name, text):
    (folder / name).write_text(text)
    return str(folder / name)


def test_scan_infers_types_and_missing_values(spark, tmp_path):
    df = read_table(spark, put(tmp_path, "a.csv", ANIMALS), datetime_cols=[3])
    assert [f.dataType.simpleString() for f in df.schema] == ["string", "string", "bigint", "timestamp"]
    rows = {r["name"]: r for r in df.collect()}
    assert rows["ada"]["age"] is None and rows["bo"]["sex"] is None and rows["bo"]["date"] is None
    assert rows["rex"]["date"] == dt.datetime(2016, 5, 4)


def test_given_schema_and_no_header(spark, tmp_path):
    path = put(tmp_path, "b.csv", "1,x\n2,y\n")
    df = read_table(spark, path, sep=",", header=False)
    assert df.columns == ["_c0", "_c1"]
    from pyspark.sql.types import StructType

    typed = read_table(spark, path, sep=",", header=False, schema=StructType.fromDDL("n double, t string"))
    assert [tuple(r) for r in typed.collect()] == [(1.0, "x"), (2.0, "y")]


@pytest.mark.parametrize(
    "text, want",
    [(ANIMALS, (";", True)), ("1,2,a\n3,4,b\n5,6,a\n", (",", False)), ("1,2,3\n0.5,x,2\n0.7,y,3\n", (",", True)), ("a|b\nx|y\nx|z\n", ("|", True)), ("L,1\nR,2\nL,3\n", (",", False))],
)
def test_dialects(spark, tmp_path, text, want):
    assert infer_dialect(spark, put(tmp_path, "c.csv", text)) == want


def test_corpus_skips_distance_files(spark, tmp_path):
    put(tmp_path, "a.csv", ANIMALS)
    put(tmp_path, "distance-a.csv", ANIMALS)
    put(tmp_path, "b.csv", "p,q\n1,2\n3,4\n")
    put(tmp_path, "notes.txt", "x")
    corpus = read_corpus(spark, str(tmp_path))
    assert sorted(corpus) == ["a.csv", "b.csv"] and corpus["b.csv"].columns == ["p", "q"]


def test_corpus_profile_agrees_with_reading_each_file(spark, tmp_path):
    folder = tmp_path / "corpus"
    folder.mkdir()
    files = {
        "people.csv": "name;age;city\nann;3;x\nbob;?;y\n\ncid;5;?\n",
        "bare.csv": "1,2.5,true\n2,NA,false\n",
        "quoted.csv": 'id|note\n1|"a|b"\n2|"say ""x"""\n',
        "one.csv": "only\n",
        "distance_x.csv": "p;q\n1;2\n",
        "other.txt": "a;b\n",
    }
    for name, text in files.items():
        put(folder, name, text)
    put(folder, "none.csv", "")
    parts = str(folder / "parts.csv")
    spark.range(100).selectExpr("id k", "concat('v', id) v").repartition(3).write.csv(parts, header=True, sep="\t")
    got = {r["ds_name"]: r for r in corpus_profile(spark, str(folder)).collect()}
    assert sorted(got) == ["bare.csv", "one.csv", "parts.csv", "people.csv", "quoted.csv"]
    for name in ("people.csv", "bare.csv", "quoted.csv"):
        path = str(folder / name)
        sep, header = infer_dialect(spark, path)
        table = read_table(spark, path, sep, header)
        r = got[name]
        assert (r["sep"], r["header"], r["ds_len"], r["ds_attr_size"]) == (sep, header, table.count(), len(table.columns))
        assert r["types"].split(",") == [t for _, t in table.dtypes] and r["ds_file_size_B"] == len(files[name].encode())
    assert (got["one.csv"]["ds_len"], got["one.csv"]["header"], got["one.csv"]["sep"]) == (0, True, ",")
    parts = got["parts.csv"]
    assert (parts["ds_len"], parts["ds_files"], parts["types"], parts["pairs"], parts["sep"]) == (100, 3, "bigint,string", 4950, "\t")


def test_corpus_profile_neither_sorts_nor_shuffles_cells(spark, tmp_path):
    folder = tmp_path / "corpus"
    spark.range(3000).selectExpr("id", "id % 7 k").repartition(2).write.csv(str(folder / "a.csv"), sep=";")
    spark.range(10).selectExpr("id p", "'x' q").write.csv(str(folder / "b.csv"), header=True)
    found = corpus_profile(spark, str(folder))
    plan = found._jdf.queryExecution().executedPlan().toString()
    scan = plan.index("FileScan text")
    assert "SortAggregate" not in plan and "SortMergeJoin" not in plan
    assert plan.rindex("Exchange", 0, scan) < plan.rindex("BroadcastHashJoin", 0, scan)
    got = {r["ds_name"]: (r["ds_len"], r["header"], r["types"]) for r in found.collect()}
    assert got == {"a.csv": (3000, False, "bigint,bigint"), "b.csv": (10, True, "bigint,string")}


def test_first_lines_of_blocks(spark):
    """Batches that end inside a block, a block that goes on in the next batch."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "4")
    try:
        rows = spark.range(0, 40, 1, 1).selectExpr("'t' ds_name", "concat('f', id div 20) path", "cast(id as string) value", "(id div 6) * 100 block")
        got = sorted(int(r["value"]) for r in first_lines(rows).collect())
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == [0, 6, 12, 18, 20, 24, 30, 36]


def test_people_golden_from_a_file_to_a_file(spark, tmp_path):
    people = [
        ("john", "male", "newyork", 20), ("jack", "male", "newyork", 21), ("mary", "female", "losangeles", 45),
        ("maryanne", "female", "losangeles", 48), ("eric", "male", "san francisco", 29), ("jenny", "female", "boston2", 30),
        ("mattia", "na", "BostonDynamics", 50),
    ]
    text = "name;sex;city;age\n" + "\n".join(";".join(map(str, p)) for p in people) + "\n"
    found = discover_all(read_table(spark, put(tmp_path, "people.csv", text)))
    write_rfds(found, str(tmp_path / "out"), decimal=",", fmt="csv")
    back = spark.read.csv(str(tmp_path / "out"), sep=";", header=True)
    assert {r["rhs"]: r["count"] for r in back.groupBy("rhs").count().collect()} == {"name": 4, "sex": 5, "city": 3, "age": 4}
    age = {(r["name"], r["sex"], r["city"], r["rhs_threshold"]) for r in back.where("rhs = 'age'").collect()}
    assert age == {("4,0", "0,0", "8,0", "15,0"), (None, None, "6,0", "10,0"), (None, None, "0,0", "3,0"), ("3,0", "0,0", "0,0", "1,0")}
    assert '{"lhs":["name","sex","city"],"rhs":["age"]}' in {r["combination"] for r in back.collect()}


def test_profiles_and_metrics(spark, tmp_path):
    df = read_table(spark, put(tmp_path, "n.csv", "a;b\n1;1\n2;3\n4;9\n9;9\n"))
    line = table_profile(df, "n", with_bytes=False).first()
    assert (line["ds_len"], line["ds_attr_size"], line["pairs"]) == (4, 2, 6)
    parquet = str(tmp_path / "p")
    df.write.parquet(parquet)
    sized = dependency_profile({"n": spark.read.parquet(parquet)}, with_bytes=True).collect()
    assert len(sized) == 2 and all(r["ds_file_size_B"] > 0 for r in sized)
    runs = spark.createDataFrame([("x", 1, 2.0), ("x", 1, 4.0), ("y", 2, 9.0)], "ds_name string, rfd_count int, time_elapsed double")
    got = metrics_summary(runs, ["time_elapsed"], ["ds_name"], "time_elapsed").collect()
    assert [(r["ds_name"], r["time_elapsed"]) for r in got] == [("y", 9.0), ("x", 3.0)]


def test_messages(spark):
    full = {
        "lang": "en", "_msgid": "m1", "tweet": {"created_at": "t", "text": "a\nb", "retweet_count": 2, "favourite_count": 1},
        "sentiment": {"score": 3.0, "comparative": 0.5, "tokens": ["a", "b"], "words": ["a"], "positive": ["a"], "negative": []},
    }
    bare = {"lang": "it", "_msgid": "m2", "tweet": {"text": "c"}, "sentiment": {}}
    raw = spark.createDataFrame([(json.dumps(full),), (json.dumps(bare),)], "value string")
    parsed = parse_messages(raw, "value", MESSAGE_SCHEMA)
    assert filter_records(parsed).count() == 1
    flat = flatten_message(parsed).withColumn("text", escape_newlines(F.col("text")))
    one = {r["_msgid"]: r for r in flat.collect()}
    assert one["m1"]["text"] == "a\\nb" and one["m1"]["sentiment_comparative"] == 50.0 and one["m1"]["sentiment_tokens"] == 2
    assert one["m2"]["sentiment_word_count"] == 0
    empty, some = route_by_word_count(flat)
    assert [r["_msgid"] for r in empty.collect()] == ["m2"] and [r["_msgid"] for r in some.collect()] == ["m1"]


def test_lexicon_scores(spark):
    texts = spark.createDataFrame([(1, "Good, good bad day"), (2, ""), (3, "nothing")], "id int, text string")
    lexicon = spark.createDataFrame([("good", 2), ("bad", -3)], "word string, weight int")
    got = {r["id"]: tuple(r)[1:] for r in score_lexicon(texts, "id", "text", lexicon).collect()}
    assert got == {1: (4, 1.0, 2, 1, 25.0), 2: (0, 0.0, 0, 0, 0.0), 3: (1, 0.0, 0, 0, 0.0)}


def test_top_rows(spark):
    rows = [(i, dt.datetime(2024, 1, 1, 0, i % 30), (i * 7) % 20) for i in range(90)]
    df = spark.createDataFrame(rows, "id int, ts timestamp_ntz, v int")
    best = top_k(df, [F.desc("v"), F.asc("id")], 5).collect()
    assert [r["id"] for r in best] == [r[0] for r in sorted(rows, key=lambda r: (-r[2], r[0]))[:5]]
    windows = top_k_per_window(df, "ts", "10 minutes", [F.desc("v"), F.asc("id")], 5)
    assert windows.count() == 15 and append(windows, windows).count() == 30


def test_stream_of_messages_keeps_the_best_of_each_closed_window(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()

    def record(i, minute, words):
        r = dict.fromkeys([c.split()[0] for c in RECORD_SCHEMA.split(", ")], 0)
        return json.dumps({**r, "created_at": f"2024-01-01 00:{minute:02d}:00", "_msgid": f"m{i:03d}", "text": "x\ny", "sentiment_word_count": words})

    first = [record(i, i % 20, (i * 13) % 50) for i in range(60)]
    second = [record(100 + i, 15 + i % 20, (i * 11) % 60) for i in range(40)] + [record(999, 59, 1)]
    for name, lines in (("1.json", first), ("2.json", second)):
        put(source, name, "\n".join(lines))
    records = read_messages(spark, "text", path=str(source), maxFilesPerTrigger=1)
    records = records.withColumn("ts", F.col("created_at").cast("timestamp"))
    best = stream_top_k(records, "ts", "10 minutes", ["sentiment_word_count", "sentiment_tokens", "_msgid"], 5, ascending=("_msgid",))
    query = start_sink(best, str(tmp_path / "out"), str(tmp_path / "ck"), every=None)
    assert run_until(query, 300)
    got = spark.read.parquet(str(tmp_path / "out")).orderBy("window_start", "rank").collect()
    every = [json.loads(line) for line in first + second]
    for start in (0, 10, 20, 30):
        inside = [r for r in every if start <= int(r["created_at"][14:16]) < start + 10]
        want = [r["_msgid"] for r in sorted(inside, key=lambda r: (-r["sentiment_word_count"], r["_msgid"]))[:5]]
        assert [r["_msgid"] for r in got if r["window_start"].minute == start] == want
    assert all(r["text"] == "x\\ny" for r in got) and not any(r["window_start"].minute == 50 for r in got)


def test_codes_padding_and_quotes(spark, tmp_path):
    path = put(tmp_path, "codes.csv", 'id;name;note\n1; ab;"x;y, z"\n2;12d;"p"\n3;10f;"q,r;s"\n')
    assert infer_dialect(spark, path) == (";", True)
    got = read_table(spark, path)
    assert dict(got.dtypes)["name"] == "string" and got.orderBy("id").first()["name"] == " ab"
    codes = put(tmp_path, "d.csv", "a;b\n12d;1\n10f;2\n")
    assert dict(read_table(spark, codes).dtypes) == {"a": "string", "b": "bigint"}
    late = put(tmp_path, "late.csv", "a,b;c\n" + "1,2;3\n" * 150 + "4,5,6;7\n")
    assert infer_dialect(spark, late)[0] == ";"


@pytest.mark.parametrize("zone", ["UTC", "Asia/Tokyo", "America/New_York"])
def test_stream_in_every_zone(spark, tmp_path, zone):
    from pyspark.sql import functions as F

    from softdeps.streaming.topk import start_sink, stream_top_k

    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        rows = spark.range(400).select(F.timestamp_seconds(F.lit(1_700_000_000) + F.col("id") * 60).alias("ts"), "id", (F.col("id") % 7).alias("v"))
        rows.coalesce(1).write.parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
        best = stream_top_k(stream, "ts", "10 minutes", ["v", "id"], 2, ascending=("id",))
        start_sink(best, str(tmp_path / "out"), str(tmp_path / "check"), every=None).awaitTermination(120)
        got = spark.read.parquet(str(tmp_path / "out"))
        starts = sorted(r[0] for r in got.select(F.unix_seconds("window_start")).distinct().collect())
        closed = 1_700_000_000 + 399 * 60 - 600
        ends = [t - t % 600 + 600 for t in range(1_700_000_000, closed + 600, 60)]
        assert starts == sorted({e - 600 for e in ends if e <= closed})
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
