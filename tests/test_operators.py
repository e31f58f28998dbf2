"""Hand-made rows for the operators' rules: dirty cells, boundaries, ties, empty tables."""

import gzip
import math
from collections import Counter

import numpy as np
import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Observation
from pyspark.sql import functions as F

from flowmill.functions.expr import clean_text, file_safe, finite_or_zero, is_label, number_of, plain_title, to_number, value_type
from flowmill.operators import balance, boosting, cleaning, correlation, dedup, evaluate, models, profile, sampling, schema
from flowmill.sources import parts, readers, sinks
from flowmill.storage import shared_dir

INF, NAN = float("inf"), float("nan")


def column(spark, values, expression, kind="string"):
    rows = spark.createDataFrame([(k, v) for k, v in enumerate(values)], f"k int, v {kind}")
    return [r[0] for r in rows.orderBy("k").select(expression).collect()]


def test_numbers_from_text(spark):
    got = column(spark, ["1", "1.0", "2.5", "inf", "-Infinity", "abc", "", "NA", "nan", " 7 ", "1d", "1_000", None, "\t3e2\n"], to_number(F.col("v")))
    assert got == [1.0, 1.0, 2.5, INF, -INF, None, None, None, None, 7.0, None, None, None, 300.0]


def test_value_types(spark):
    got = column(spark, ["1", "1.0", "2.5", "inf", "abc", "", "NA", None, "1e400"], value_type(F.col("v")))
    assert got == ["integer", "integer", "float", "inf", "string", "missing", "missing", "missing", "inf"]


def test_labels(spark):
    assert column(spark, ["Benign", " benign ", "BENIGN\t", "DoS", None], is_label(F.col("v"), "benign")) == [True, True, True, False, False]
    assert column(spark, ["a b/c__", "__"], file_safe(F.col("v"))) == ["a_b_c", ""]
    assert column(spark, ["a-b c_1!"], plain_title(F.col("v"))) == ["ab c_1"]
    assert column(spark, [" \t a \n"], clean_text(F.col("v"))) == ["a"]


def test_double_cells(spark):
    rows = spark.createDataFrame([(None,), (NAN,), (INF,), (-INF,), (0.0,), (5.0,)], "v double")
    assert [r[0] for r in rows.select(finite_or_zero(number_of(rows, "v"))).collect()] == [0, 0, 0, 0, 0, 5]
    assert profile.inf_profile(rows).first()["infinite"] == 2
    assert [r[0] for r in cleaning.inf_to_median(rows.unionByName(spark.createDataFrame([(7.0,)], "v double")), ["v"]).collect()] == [None, None, 5.0, 5.0, 0.0, 5.0, 7.0]


def test_ports_and_negatives(spark):
    ports = spark.createDataFrame([("-1",), ("0",), ("65535",), ("65536",), (None,), ("x",)], "src_port string")
    assert sorted(r[0] for r in cleaning.drop_invalid(ports).collect()) == ["0", "65535"]
    rows = spark.createDataFrame([(-1.0, 1.0, 1.0, 1.0), (1.0, -1.0, 1.0, 1.0), (1.0, 1.0, -1.0, 1.0), (1.0, 1.0, 1.0, None)], "duration double, x_skewness double, delta_len double, bytes_rate double")
    assert tuple(cleaning.validity_counts(rows, cleaning.invalid_row(rows)).first()) == (4, 1, 3)


def test_duplicates_and_differences(spark):
    rows = spark.createDataFrame([("A",), ("A",), ("B",), ("A",), (None,), (None,)], "v string").repartition(3)
    assert dedup.distinct_rows(rows).count() == 3
    assert tuple(dedup.duplicate_counts(rows).first()) == (6, 3, 3)
    assert tuple(dedup.top_duplicates(rows, 1).first()) == ("A", 3)
    raw, done = spark.createDataFrame([("A",), ("A",), ("B",), ("C",)], "v string"), spark.createDataFrame([("A",), ("C",), ("D",)], "v string")
    assert tuple(dedup.difference_counts(raw, done).first()) == (3, 3, 1, 1)
    assert [r[0] for r in dedup.missing_rows(raw, done).collect()] == ["B"]
    assert tuple(dedup.duplicate_counts(raw.limit(0)).first()) == (0, 0, 0)


def test_low_variance_kinds(spark):
    rows = spark.createDataFrame([(None, "a", k % 2, k % 3, k % 4) for k in range(12)], "n string, c string, two int, three int, four int")
    got = {r["column"]: r["kind"] for r in profile.low_variance(rows).collect()}
    assert got == {"c": "constant", "two": "low variance", "three": "low variance"}


@pytest.mark.parametrize(("share", "bucket"), [(100, "100%"), (95, "95-100%"), (90, "90-95%"), (50, "50-60%"), (49, None)])
def test_dominance_buckets(spark, share, bucket):
    rows = spark.createDataFrame([("x" if k < share else f"y{k}",) for k in range(100)], "v string")
    got = profile.dominance(rows, ["v"]).first()
    assert (got["bucket"] if got else None) == bucket


def plain_dominant(values, least):
    """The least of the most common non-NULL values and its count, if its share is ``least`` or more."""
    counts = Counter(v for v in values if v is not None)
    if counts:
        value, n = min(counts.items(), key=lambda x: (-x[1], x[0]))
        if n >= least * sum(counts.values()):
            return value, n, sum(counts.values())


@pytest.mark.parametrize("least", [0.5, 0.2, 0.03])
def test_dominance_against_counts(spark, least):
    rng = np.random.default_rng(5)
    n, columns = 4000, {}
    columns["even"] = [f"v{k % 2}" for k in range(n)]  # a tie at exactly a half
    columns["distinct"] = [f"v{k}" for k in range(n)]
    columns["few of many nulls"] = [None if k % 50 else ("x" if k % 100 else f"y{k}") for k in range(n)]
    columns["all null"] = [None] * n
    columns["late"] = [f"v{k}" if k < n * 0.45 else "late" for k in range(n)]
    columns["zipf"] = [f"z{min(x, 5000)}" for x in rng.zipf(1.4, n)]
    columns["thirds"] = [f"t{k % 3}" if k % 10 else f"u{k}" for k in range(n)]
    rows = spark.createDataFrame([*zip(*columns.values(), strict=True)], ", ".join(f"`{c}` string" for c in columns)).repartition(7)
    got = {r["column"]: (r["dominant_value"], r["dominant_count"], r["total_count"]) for r in profile.dominance(rows, list(columns), least=least).collect()}
    assert got == {c: x for c, v in columns.items() if (x := plain_dominant(v, least))}
    assert profile.dominance_by_label(rows, list(columns), "even", least=1.0).count() == 0 and profile.dominance_rest(rows, list(columns), least=1.0).count() == 0


def test_dominance_shuffles_no_values(spark):
    rows = spark.range(1000).selectExpr("string(id) a", "string(id % 2) b")
    plan = profile.dominance(rows, ["a", "b"])._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate [column" in plan and "Aggregate [value" not in plan and plan.count("Generate") == 1  # of one row's counts


def test_correlation_masks_and_groups(spark):
    rng = np.random.default_rng(3)
    a = rng.normal(size=200)
    noise = rng.normal(size=200)
    cols = {"a": a, "b": 2 * a, "c": -a, "noise": noise, "fixed": np.ones(200)}
    rows = [[None if (k + j) % 7 == 0 and n != "fixed" else float(v[k]) for j, (n, v) in enumerate(cols.items())] for k in range(200)]
    df = spark.createDataFrame(rows, "a double, b double, c double, noise double, fixed double")
    pairs = correlation.correlations(df, list(cols))
    got = {(r["first"], r["second"]): r["r"] for r in pairs.collect()}
    assert math.isclose(got["a", "b"], 1, abs_tol=1e-9) and math.isclose(got["a", "c"], -1, abs_tol=1e-9)
    assert got["a", "fixed"] is None
    both = [(r[0], r[3]) for r in rows if r[0] is not None and r[3] is not None]
    assert math.isclose(got["a", "noise"], np.corrcoef(*zip(*both, strict=True))[0, 1], abs_tol=1e-9)
    groups = correlation.correlation_groups(pairs)
    assert groups == [["a", "b", "c"]]
    assert correlation.group_report(pairs, groups).count() == 3
    assert correlation.drop_correlated(df, list(cols)).columns == ["a", "noise", "fixed"]


@pytest.mark.parametrize("many", [2, 14])
def test_correlation_of_far_columns(spark, many):
    """One way for few and many columns: the same r for values near 1e9 with a small spread."""
    rng = np.random.default_rng(4)
    x = rng.normal(size=(300, many)) * 0.1
    x[:, 1] += 0.2 * x[:, 0]
    df = spark.createDataFrame((x + 1e9).tolist(), ", ".join(f"c{k} double" for k in range(many))).repartition(3)
    got = {(r["first"], r["second"]): r["r"] for r in correlation.correlations(df, df.columns).collect()}
    shifted = (x + 1e9) - 1e9
    assert len(got) == many * (many - 1) // 2
    assert got["c0", "c1"] == pytest.approx(np.corrcoef(shifted[:, 0], shifted[:, 1])[0, 1], abs=1e-6)


def test_correlation_chain_is_one_group(spark):
    pairs = spark.createDataFrame([("a", "b", 0.9), ("b", "c", 0.9), ("a", "c", 0.5)], "first string, second string, r double")
    groups = correlation.correlation_groups(pairs)
    assert groups == [["a", "b", "c"]]
    assert sorted(r["is_edge"] for r in correlation.group_report(pairs, groups).collect()) == [False, True, True]


def test_percentiles_and_iqr(spark):
    rows = spark.createDataFrame([(1.0,), (2.0,), (4.0,), (10.0,), (None,)], "v double")
    d = profile.describe(rows, ["v"]).first()
    assert (d["p25"], d["p50"], d["n"]) == (1.75, 3.0, 4)
    assert profile.iqr_bounds(rows.where("v = 1"), ["v"]).count() == 0


@pytest.mark.parametrize("digits", [1, 3])
def test_exact_places(spark, digits, monkeypatch):
    monkeypatch.setattr(sampling, "DIGITS", digits)
    rows = spark.range(500).selectExpr("id", "if(id % 50 = 0, null, id % 3) g")
    got = sampling.rank_by_hash(rows, ["g"], ["id"])
    for _, part in got.toPandas().fillna(-1).groupby("g"):
        assert sorted(part.place) == list(range(1, len(part) + 1))


def test_class_boundaries(spark):
    sizes = {"a": 4, "b": 5, "c": 30, "d": 31}
    rows = spark.createDataFrame([(f"{n}{k}", n) for n, size in sizes.items() for k in range(size)] + [("n", None)], "id string, label string")
    got = sampling.class_floor_cap(rows, "label", ["id"], least=5, most=30).groupBy("label").count().collect()
    assert {r[0]: r[1] for r in got} == {"b": 5, "c": 30, "d": 30}


def test_split_sizes_and_folds(spark):
    rows = spark.createDataFrame([(f"{n}-{k}", str(n)) for n in (1, 2, 5, 10) for k in range(n)] + [("x", None)], "id string, label string")
    split = sampling.stratified_split(rows, "label", 0.6, ["id"])
    train = {r[0]: r[1] for r in split.where("split = 'train'").groupBy("label").count().collect()}
    assert train == {"1": 1, "2": 1, "5": 3, "10": 6} and split.count() == 18
    assert sampling.folds(rows, "label", 3, ["id"]).where("label = '10'").groupBy("fold").count().count() == 3


def test_round_robin_and_parts(spark):
    rows = spark.createDataFrame([("a", k) for k in range(5)] + [("b", k) for k in range(2)], "source string, k int")
    turns = sampling.round_robin(rows, "source", ["k"]).orderBy("turn", "source")
    assert [r["source"] for r in turns.collect()] == ["a", "b", "a", "b", "a", "a", "a"]
    parts = sinks.split_parts(turns, 3, ["turn", "source"]).groupBy("part").count().orderBy("part")
    assert [r["count"] for r in parts.collect()] == [3, 3, 1]


def test_confusion_with_empty_class(spark):
    rows = spark.createDataFrame([("a", "a"), ("b", "a"), (None, "a")], "t string, p string")
    report = {r["label"]: r for r in evaluate.class_report(evaluate.confusion(rows, "t", "p")).collect()}
    assert (report["b"]["precision"], report["b"]["recall"], report["b"]["f1"]) == (0, 0, 0)
    assert (report["a"]["precision"], report["a"]["recall"]) == (0.5, 1.0)


def test_confidence_threshold(spark):
    rows = spark.createDataFrame([(0, 0.59), (0, 0.60), (12, 0.61)], "code int, p double")
    got = [r[0] for r in rows.select(evaluate.named_prediction(F.col("code"), F.col("p"), {0: "x"})).collect()]
    assert got == [evaluate.UNKNOWN, "x", "Unknown_Class_12"]


def test_column_names(spark):
    df = spark.createDataFrame([(1, 2, 3)], "` A` int, b int, Segment_Size_Mean int")
    assert schema.normalize_columns(df, schema.ALIASES).columns == ["a", "b", "avg_segment_size"]
    twice = spark.createDataFrame([(1, 2)], "x int, y int").toDF("x", " X")
    with pytest.raises(ValueError, match="same"):
        schema.normalize_columns(twice)
    assert schema.normalize_columns(twice, on_duplicate="last").first()[0] == 2
    assert schema.unique_header(["x", "x", "y", "x.1", "a.b", "a.c"]) == [0, 2, 4, 5]
    assert schema.deletion_list(["a", "b", "a"], ["c"], ["b"]) == (["a", "c"], ["a"])
    with pytest.raises(ValueError, match="missing"):
        schema.require_columns(df, ["nope"])
    with pytest.raises(ValueError, match="must not"):
        schema.forbid_columns(spark.createDataFrame([(1,)], "Label int"), ["label"])


def test_csv_files(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.csv").write_text(" Label ,rate\nx,1.5\ny,NA\nz,inf\nw,abc\n")
    (tmp_path / "in" / "b.CSV").write_text(" Label ,rate\nq, 7 \n")
    df = readers.read_csv(spark, str(tmp_path / "in"), "label string, rate double, absent double", source_col="file")
    assert sorted((r["label"], r["rate"]) for r in df.collect() if r["rate"] is not None) == [("q", 7.0), ("x", 1.5), ("z", INF)]
    assert df.where("absent is not null").count() == 0
    assert sorted(r["n_rows"] for r in readers.row_counts(df, "file").collect()) == [1, 4]
    assert readers.raw_header(spark, str(tmp_path / "in" / "a.csv")) == ["Label", "rate"]
    (tmp_path / "list.txt").write_text("a, b # both\n# none\nc\n")
    assert readers.read_column_list(spark, str(tmp_path / "list.txt")) == ["a", "b", "c"]
    (tmp_path / "map.txt").write_text("title\n---\nDoS: slow : 3\nBenign : 0\n")
    assert sorted(tuple(r) for r in readers.read_label_map(spark, str(tmp_path / "map.txt")).collect()) == [("Benign", 0), ("DoS: slow", 3)]


def test_files_of_different_headers(spark, tmp_path):
    folder = tmp_path / "a b [1]"
    (folder / "deep").mkdir(parents=True)
    (folder / "one.csv").write_text("label,rate,port\nx,1.5,80\ny,2.5,\n")
    (folder / "two.csv").write_text("\ufeffPort, Label ,label,extra\n443,z,ignored,e\n")
    (folder / "deep" / "three%20+.csv").write_text('"rate","la,bel"\n7,8\n')
    (folder / "header only.csv").write_text("label,rate,port\n")
    (folder / "empty.csv").write_text("")
    (folder / "notes.txt").write_text("not,a,table\n1,2,3\n")
    with gzip.open(folder / "four.csv.gz", "wt") as f:
        f.write("rate,label\n9,w\n")
    path = str(folder).replace("[", "\\[").replace("]", "\\]")
    rows = readers.read_csv_text(spark, path, pattern="*.csv*", source_col="file")
    assert sorted(rows.columns) == sorted(["label", "rate", "port", "extra", "la,bel", "file"])
    got = sorted((r["label"] or "", r["rate"] or "", r["port"] or "", r["extra"] or "", r["la,bel"] or "") for r in rows.collect())
    assert got == sorted([("x", "1.5", "80", "", ""), ("y", "2.5", "", "", ""), ("z", "", "443", "e", ""), ("", "7", "", "", "8"), ("w", "9", "", "", "")])
    typed = readers.read_csv(spark, path, "port int, rate double", pattern="*.csv*")
    assert sorted((r["port"] or 0, r["rate"] or 0.0) for r in typed.collect()) == [(0, 2.5), (0, 7.0), (0, 9.0), (80, 1.5), (443, 0.0)]
    counts = {r["source"].rsplit("/")[-1]: (r["n_rows"], r["n_columns"]) for r in readers.file_counts(spark, path, pattern="*.csv*").collect()}
    assert {k[:4]: v for k, v in counts.items()} == {"one.": (2, 3), "two.": (1, 4), "thre": (1, 2), "head": (0, 3), "four": (1, 2)}
    assert readers.read_csv_text(spark, path, pattern="*.none").count() == 0


def test_writers(spark, tmp_path):
    rows = spark.range(10).selectExpr("id", "id % 2 c")
    sinks.write_parts(rows, str(tmp_path / "parts"), 4, ["id"])
    assert sorted(r["count"] for r in spark.read.csv(str(tmp_path / "parts"), header=True).groupBy("part").count().collect()) == [2, 4, 4]
    sinks.write_by_class(rows, str(tmp_path / "by"), F.col("c"))
    assert spark.read.parquet(str(tmp_path / "by")).where("class = 1").count() == 5
    sinks.write_csv(rows, str(tmp_path / "few"), max_rows=3, order=[F.col("id")])
    assert sorted(int(r[0]) for r in spark.read.csv(str(tmp_path / "few"), header=True).collect()) == [0, 1, 2]
    assert "id" in sinks.report_text(rows, "Rows")
    with pytest.raises(Exception, match="exists"):
        sinks.write_csv(rows, str(tmp_path / "few"))


def blobs(spark, n=60, seed=1):
    rng = np.random.default_rng(seed)
    rows = [(k, "big" if k < n else "small", (rng.normal(size=3) + (0 if k < n else 1.5)).tolist()) for k in range(n + 12)]
    return spark.createDataFrame(rows, "id long, label string, x array<double>")


def test_smote_segments(spark):
    rows = blobs(spark)
    made = balance.smote(rows, "id", "label", "x", 0.5).collect()
    assert len(made) == 30 - 12 and all(r["label"] == "small" for r in made)
    x = {r["id"]: np.array(r["x"]) for r in rows.collect()}
    for r in made:
        assert r["neighbour"] >= 60 and r["id"] >= 60
        p, a, b = np.array(r["x"]), x[r["id"]], x[r["neighbour"]]
        assert math.isclose(np.linalg.norm(p - a) + np.linalg.norm(p - b), np.linalg.norm(a - b), abs_tol=1e-9)
    assert sorted(map(tuple, balance.smote(rows.repartition(3), "id", "label", "x", 0.5).select("id", "nth", "neighbour").collect())) == sorted((r["id"], r["nth"], r["neighbour"]) for r in made)


def test_neighbours_are_exact(spark, monkeypatch):
    monkeypatch.setattr(balance, "BLOCK", 16)
    rows = balance._vectors(blobs(spark), "id", "label", "x")
    got = {}
    for r in balance.neighbours(rows, rows, 4, same_label=False).collect():
        got.setdefault(r["id"], {})[r["place"]] = r["neighbour"]
    x = np.array([r["x"] for r in rows.orderBy("id").collect()])
    d = ((x[:, None] - x[None]) ** 2).sum(axis=2)
    np.fill_diagonal(d, np.inf)
    assert all([got[k][p] for p in (1, 2, 3, 4)] == np.argsort(d[k], kind="stable")[:4].tolist() for k in range(len(x)))


def test_other_balancing(spark):
    rows = blobs(spark)
    assert all(r["label"] == "small" for r in balance.borderline_smote(rows, "id", "label", "x", 0.5).collect())
    assert abs(balance.adasyn(rows, "id", "label", "x", 0.5).count() - 18) <= 6
    far = rows.withColumn("x", F.when(F.col("label") == "small", F.transform("x", lambda v: v + 1000)).otherwise(F.col("x")))
    with pytest.raises(ValueError, match="neighbour"):
        balance.adasyn(far, "id", "label", "x", 0.5)
    one = rows.where("id < 61")
    with pytest.raises(ValueError, match="one row"):
        balance.smote(one, "id", "label", "x", 0.5)
    assert balance.neighbour_count(1) == 1 and balance.neighbour_count(100) == 5


def wide(spark):
    return blobs(spark).select("id", "label", *[F.col("x")[k].alias(f"f{k}") for k in range(3)])


def test_forest_round_trip(spark, tmp_path):
    rows = wide(spark)
    trained = models.train_forest(rows, "label", ["f0", "f1", "f2"], trees=5, depth=4)
    models.save(trained, spark, str(tmp_path / "m"))
    again = models.load(spark, str(tmp_path / "m"))
    a, b = (sorted(map(tuple, models.score(t, rows, ["id"]).collect())) for t in (trained, again))
    assert a == b and again.labels == ["big", "small"]
    live = models.score_live(trained, rows.drop("label"), keep=["id"])
    assert live.columns == ["id", "IDS_Prediction", "IDS_Confidence"]
    with pytest.raises(ValueError, match="must not"):
        models.score_live(trained, rows, keep=["id"])
    assert math.isclose(sum(r["percent"] for r in models.importance(trained, spark).collect()), 100)


def test_isolation_forest_finds_the_odd_one(spark):
    rows = spark.createDataFrame([(k, float(k % 10), float(k % 7)) for k in range(400)] + [(400, 1000.0, -900.0)], "id long, a double, b double")
    forest = models.train_isolation_forest(rows, ["a", "b"], ["id"], trees=30, sample=64)
    scores = models.isolation_scores(rows, forest, ["a", "b"], ["id"]).orderBy(F.desc("anomaly_score"))
    assert scores.first()["id"] == 400 and scores.first()["prediction"] == -1


def test_text_codes(spark):
    rows = spark.createDataFrame([("b",), ("a",), (None,)], "v string")
    coded, values = models.encode_text(rows, ["v"])
    assert sorted(r[0] for r in coded.collect()) == [0, 1, 2]
    assert [r["label"] for r in values["v"].orderBy("code").collect()] == ["", "a", "b"]


def test_many_labels_are_numbered_in_parts(spark, monkeypatch):
    rows = spark.range(50).selectExpr("concat('v', id % 20) v")
    want = sorted(map(tuple, sampling.label_codes(rows, "v").collect()))
    monkeypatch.setattr(sampling, "MAX_LABELS", 5)
    assert sorted(map(tuple, sampling.label_codes(rows, "v").collect())) == want and [c for _, c in want] == list(range(20))


def test_bounds_are_errors(spark, tmp_path, monkeypatch):
    (tmp_path / "list.txt").write_text("a\nb\nc\n")
    assert readers.read_column_list(spark, str(tmp_path / "list.txt"), most=3) == ["a", "b", "c"]
    with pytest.raises(ValueError, match="lines"):
        readers.read_column_list(spark, str(tmp_path / "list.txt"), most=2)
    monkeypatch.setattr(models, "MAX_CLASSES", 1)
    with pytest.raises(ValueError, match="labels"):
        models.train_forest(wide(spark), "label", ["f0"], trees=1, depth=1)
    with pytest.raises(ValueError, match="labels"):
        models.importance_by_label(wide(spark), "label", ["f0"])
    with pytest.raises(ValueError, match="key"):
        models.train_forest(wide(spark), "label", ["f0"], max_rows=10)
    monkeypatch.setattr(evaluate, "MAX_LABELS", 1)
    with pytest.raises(ValueError, match="labels"):
        evaluate.confusion(wide(spark), "label", "label")


def test_samples_are_of_all_classes(spark):
    rows = spark.range(3000).selectExpr("id", "concat('c', id % 3) label", "double(id % 3) f0")
    drawn = sampling.sample_rows(rows, 900, ["id"])
    assert drawn.count() == 900 and all(200 < r["count"] < 400 for r in drawn.groupBy("label").count().collect())
    assert models.train_forest(rows, "label", ["f0"], max_rows=900, key=["id"], trees=2, depth=3).labels == ["c0", "c1", "c2"]


def test_capped_ranks_equal_whole_ones(spark):
    rows = spark.range(5000).selectExpr("id", "if(id % 3 = 0, 'hot', if(id % 7 = 0, null, concat('s', id % 5))) g")
    for most in (0, 1, 40, 700, 10_000):
        want = sampling.rank_by_hash(rows, ["g"], ["id"]).where(F.col("place") <= most)
        got = sampling.rank_by_hash(rows, ["g"], ["id"], most=most)
        assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_boosting_of_many_classes_has_confidence(spark):
    rows = spark.range(300).selectExpr("id", "concat('c', id % 3) label", "double(id % 3) + (id % 7) / 20 f0", "double(id % 5) f1")
    trained = models.train_boosting(rows, "label", ["f0", "f1"], rounds=4, depth=2)
    scored = models.score(trained, rows, ["label"]).collect()
    assert all(1 / 3 <= r["confidence"] <= 1 for r in scored) and np.mean([r["label"] == r["predicted_label"] for r in scored]) > 0.95
    said = {r["IDS_Prediction"] for r in models.score_live(trained, rows.drop("label"), least=1.01).collect()}
    assert said == {evaluate.UNKNOWN}


def test_tuning_goes_on_where_it_broke_off(spark, tmp_path):
    rows, options, fitted = wide(spark), models.grid(trees=[1, 3], depth=[2]), []

    def make(option):
        fitted.append(option["trees"])
        if len(fitted) == 2:
            raise RuntimeError("lost")
        return models.forest_of(option)

    folder = str(tmp_path / "tuning")
    with pytest.raises(RuntimeError):
        models.tune(rows, "label", ["f0", "f1"], options, make, ["id"], folder=folder, parallel=1)
    before = len(fitted)
    results = models.tune(rows, "label", ["f0", "f1"], options, make, ["id"], folder=folder, parallel=1)
    assert results.count() == 6 and set(fitted) == {3} and len(fitted) == 4 and before < 4  # one fit a fold for both sizes, the one that failed again
    assert results.where("seconds > 0 and f1 between 0 and 1").count() == 6
    other = models.tune(rows, "label", ["f0"], options, make, ["id"], folder=folder)
    assert len(fitted) == 7 and other.count() == 6  # other features: nothing is taken from the past
    best, option = models.refit_best(rows, "label", ["f0", "f1"], results, options, models.forest_of)
    assert option in options and models.score(best, rows, ["id"]).count() == rows.count()


def test_forests_in_a_session_that_observes(spark):
    """The training summary of two classes holds the session, which can't be sent once it has an observation."""
    seen = Observation("rows")
    rows = wide(spark).withColumn("label", F.col("label") == F.lit(wide(spark).first()["label"]))
    rows.observe(seen, F.count("*").alias("n")).write.format("noop").mode("overwrite").save()
    assert seen.get["n"] == rows.count()
    trained = models.train_forest(rows, "label", ["f0", "f1", "f2"], trees=3, depth=3)
    assert len(trained.labels) == 2 and models.score(trained, rows, ["id"]).count() == seen.get["n"]


def test_first_parts_of_ensembles(spark):
    rows, labels = models.prepare(wide(spark), "label", ["f0", "f1", "f2"])
    forest = models.without_summary(models.forest_of({"trees": 5, "depth": 3}).fit(rows))
    whole, same = (m.transform(rows).select("rawPrediction").collect() for m in (forest, models.first_part(forest, 5)))
    assert whole == same
    first = models.first_part(forest, 1).transform(rows).select("prediction").collect()
    assert [r[0] for r in first] == [r[0] for r in forest.trees[0].transform(rows).select("prediction").collect()]
    two = rows.withColumn("code", (F.col("code") > 0).cast("double"))
    boosted, shorter = (models.boosting_of({"rounds": n, "depth": 2, "binary": True}).fit(two) for n in (4, 2))
    assert models.first_part(boosted, 2).transform(two).select("probability").collect() == shorter.transform(two).select("probability").collect()


def plain_boosting(x, y, edges, rounds, depth, rate, least=1.0, penalty=1.0):
    """Margins by the textbook: for each node every feature and edge is tried on the rows themselves."""
    classes, margins = y.max() + 1, np.zeros((len(x), y.max() + 1))
    for _ in range(rounds):
        raised = np.exp(margins - margins.max(axis=1, keepdims=True))
        chance, add = raised / raised.sum(axis=1, keepdims=True), np.zeros_like(margins)
        for k in range(classes):
            g, h = np.rint((chance[:, k] - (y == k)) * 2**24) / 2**24, np.rint(chance[:, k] * (1 - chance[:, k]) * 2**24) / 2**24

            def grow(rows, left, k=k, g=g, h=h, add=add):
                best = (1e-9, None)
                whole = g[rows].sum() ** 2 / (h[rows].sum() + penalty)
                for f in range(x.shape[1]) if left else ():
                    for edge in edges[f]:
                        side = x[rows, f] <= edge
                        if min(h[rows[side]].sum(), h[rows[~side]].sum()) >= least:
                            gain = sum(g[s].sum() ** 2 / (h[s].sum() + penalty) for s in (rows[side], rows[~side])) - whole
                            if gain > best[0] + 1e-12:
                                best = (gain, (f, edge))
                if best[1] is None:
                    add[rows, k] = -rate * g[rows].sum() / (h[rows].sum() + penalty)
                else:
                    side = x[rows, best[1][0]] <= best[1][1]
                    grow(rows[side], left - 1), grow(rows[~side], left - 1)

            grow(np.arange(len(x)), depth)
        margins = margins + add
    return margins


def test_softmax_boosting_against_brute_force(spark, tmp_path):
    rng = np.random.default_rng(12)
    y = rng.integers(0, 3, 240)
    x = np.stack([y + rng.normal(size=240), rng.normal(size=240) - (y == 1), rng.integers(0, 4, 240) + 0.0], axis=1)
    rows = spark.createDataFrame([(k, f"c{y[k]}", *map(float, x[k])) for k in range(240)], "id long, label string, f0 double, f1 double, f2 double").repartition(5)
    prepared, labels = models.prepare(rows, "label", ["f0", "f1", "f2"])
    booster = boosting.SoftmaxBooster(rounds=10, depth=3, rate=0.4, bins=16)
    edges = booster._edges(prepared.select(vector_to_array("features").alias("x")), 3)
    model = booster.fit(prepared)
    want = plain_boosting(x, y, edges, 10, 3, 0.4)
    assert np.allclose(model.margins(x), want, atol=1e-6)
    again = booster.fit(prepared.repartition(2))
    assert np.array_equal(again.margins(x), model.margins(x))  # however rows are dealt
    assert np.array_equal(model.first(4).margins(x), boosting.SoftmaxBooster(rounds=4, depth=3, rate=0.4, bins=16).fit(prepared).margins(x))
    trained = models.Trained(model, ["f0", "f1", "f2"], labels)
    scored = {r["id"]: r for r in models.score(trained, rows, ["id"]).collect()}
    chance = boosting.softmax(want)
    assert all(abs(scored[k]["confidence"] - chance[k].max()) < 1e-6 and scored[k]["code"] == chance[k].argmax() for k in range(240))
    models.save(trained, spark, str(tmp_path / "m"))
    back = models.load(spark, str(tmp_path / "m"))
    assert np.array_equal(back.model.margins(x), model.margins(x)) and back.labels == labels
    gains = sum(model.gains(k) for k in range(3))
    assert np.allclose(gains, model.gains()) and models.importance(trained, spark, label="c1").first()["percent"] > 0
    half = boosting.SoftmaxBooster(rounds=3, depth=2, subsample=0.5).fit(prepared)
    assert np.mean(half.margins(x).argmax(axis=1) == y) > 0.6
    with pytest.raises(ValueError, match="rows"):
        booster.fit(prepared.limit(0))


def test_weak_features(spark):
    given = spark.createDataFrame([("a", 99.95), ("c", 0.02), ("b", 0.03)], "feature string, percent double")
    assert models.weak_features(given, 0.1) == ["b", "c"]


def test_headers_with_repeats(spark, tmp_path):
    (tmp_path / "a.csv").write_text("x,x,Label,x.1,y\n1,2,b,3,4\n5,6,m,7,8\n")
    got = readers.read_unique(spark, str(tmp_path / "a.csv"))
    assert got.columns == ["x", "Label", "y"] and sorted(map(tuple, got.collect())) == [("1", "b", "4"), ("5", "m", "8")]


def test_deletion_summary(spark):
    got = schema.deletion_summary(spark, {"a": ["X ", "y"], "b": []}, ["x", "z", "x"]).orderBy("file").collect()
    assert [tuple(r) for r in got] == [("a", 1, 1, ["X "], ["z"]), ("b", 0, 2, [], ["x", "z"])]


@pytest.mark.parametrize("max_pivots", [1, 9])
def test_neighbours_within_labels(spark, max_pivots):
    rows = spark.createDataFrame([(k, "ab"[k % 3 == 0], [float(k * 37 % 101), float(k % 11)]) for k in range(60)], "id long, label string, x array<double>")
    data = {r["id"]: (r["label"], np.array(r["x"])) for r in rows.collect()}
    got = {}
    for r in balance.neighbours(rows, rows, 4, same_label=True, block=7, max_pivots=max_pivots).collect():
        got.setdefault(r["id"], {})[r["place"]] = r["neighbour"]
    for k, (label, x) in data.items():
        near = sorted((float(((x - y) ** 2).sum()), j) for j, (other, y) in data.items() if j != k and other == label)[:4]
        assert [got[k][p] for p in range(1, 5)] == [j for _, j in near]


def test_pivots_prune_neighbours(spark, monkeypatch):
    """Of clusters that are far apart, rows meet few others; ties and rows of one place are found all the same."""
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(30, 6)) * 50
    x = np.concatenate([c + np.round(rng.normal(size=(30, 6)), 1) for c in centres])
    x[100:110] = x[100]
    rows = spark.createDataFrame([(k, str(k % 3), v.tolist()) for k, v in enumerate(x)], "id long, label string, x array<double>")
    sent, visits = [], balance.visits
    monkeypatch.setattr(balance, "visits", lambda *a: (out := visits(*a), sent.append(out.count()))[0])
    got = {}
    for r in balance.neighbours(rows, rows, 5, same_label=False, block=30, max_pivots=30).collect():
        got.setdefault(r["id"], {})[r["place"]] = r["neighbour"]
    for k, v in enumerate(x):
        distance = np.maximum((v * v).sum() + (x * x).sum(axis=1) - 2 * x @ v, 0)
        near = sorted((float(((v - x[j]) ** 2).sum()), j) for j in np.argsort(distance)[:60] if j != k)
        assert [round(float(((v - x[j]) ** 2).sum()), 6) for j in (got[k][p] for p in range(1, 6))] == [round(d, 6) for d, _ in near[:5]]
    assert sent[0] < 0.2 * len(x) * 29  # of all rows to all other pivots


def test_neighbours_send_rows_to_few_cells(spark, monkeypatch):
    """Where nothing can be pruned a row goes to some 16 cells, however many pivots there are; of copies the smallest ids come first."""
    rng = np.random.default_rng(5)
    x = rng.normal(size=(1200, 16))
    x[300:340], x[700:] = x[300], np.concatenate([x[700:950]] * 2)
    rows = spark.createDataFrame([(k, str(k % 3), v.tolist()) for k, v in enumerate(x)], "id long, label string, x array<double>")
    sent, visits = [], balance.visits
    monkeypatch.setattr(balance, "visits", lambda *a: (out := visits(*a), sent.append(out.count()))[0])
    got = {}
    for r in balance.neighbours(rows, rows, 5, same_label=False, block=16, max_pivots=60).collect():
        got.setdefault(r["id"], {})[r["place"]] = (r["neighbour"], r["same"])
    for k, v in enumerate(x):
        distance = np.cumsum((v - x) ** 2, axis=1)[:, -1]
        distance[k] = np.inf
        near = np.lexsort((np.arange(len(x)), distance))[:5].tolist()
        assert [got[k][p] for p in range(1, 6)] == [(j, j % 3 == k % 3) for j in near]
    assert sent[0] <= 17 * len(x)


@pytest.mark.parametrize("copies", [1, 50])
def test_nearest_pairs(copies):
    rng = np.random.default_rng(copies)
    y = np.tile(rng.normal(size=(600, 5)) * [1, 1e6, 1, 1, 1e-3], (copies, 1))
    other = rng.permutation(len(y))
    x, ids = y[:40], other[:40]
    row, at, distance = balance.nearest_pairs(ids, x, np.full(40, np.inf), other, y, 4)
    for k in range(40):
        exact = np.cumsum((x[k] - y) ** 2, axis=1)[:, -1]
        near = [j for j in np.lexsort((other, exact)) if other[j] != ids[k]][:4]
        assert at[row == k].tolist() == near and distance[row == k].tolist() == exact[near].tolist()


def test_file_order_in_small_tasks(spark, tmp_path, monkeypatch):
    """However few and large the blocks are, tasks number some rows each."""
    monkeypatch.setattr(sampling, "PIECE_BITS", 6)
    monkeypatch.setattr(sampling, "SORTED", 300)
    (tmp_path / "a.csv").write_text("n,label\n" + "".join(f"{k},{'xyz'[k % 3]}\n" for k in range(7200)))
    ranked = sampling.rank_in_files(readers.read_csv_text(spark, str(tmp_path), order_col="at"), ["label"], "at")
    assert {(int(r["n"]), r["place"]) for r in ranked.collect()} == {(k, k // 3 + 1) for k in range(7200)}
    assert ranked.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0] < 1200


def test_file_order(spark, tmp_path):
    for name, start in (("b", 0), ("a", 1000), ("c", 2000)):
        (tmp_path / "in").mkdir(exist_ok=True)
        (tmp_path / "in" / f"{name}.csv").write_text("n,label\n" + "".join(f"{start + (k * 7) % 900},{'xyz'[k % 3] if k % 11 else ''}\n" for k in range(900)))
    lines = [x.split(",") for name in "abc" for x in (tmp_path / "in" / f"{name}.csv").read_text().splitlines()[1:]]
    size = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for most in ("1000", "64m"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", most)
            rows = readers.read_csv_text(spark, str(tmp_path / "in"), order_col="at")
            ranked = {r["n"]: (r["label"], r["place"]) for r in sampling.rank_in_files(rows, ["label"], "at").collect()}
            split = {r["n"]: r["split"] for r in sampling.split_in_files(rows, "label", 0.6, "at").collect()}
            seen = Counter()
            counts = Counter(x or None for _, x in lines)
            for n, x in lines:
                seen[x or None] += 1
                assert ranked[n] == (x or None, seen[x or None])
                assert not x or split[n] == ("train" if seen[x] <= round(counts[x] * 0.6) else "test")
            assert len(split) == sum(counts.values()) - counts[None]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)


def test_cell_profile_is_what_its_reports_say(spark):
    rows = spark.createDataFrame([("1", 1.5, None), ("inf", INF, None), ("abc", None, None), (None, 2.0, None), ("2.5", NAN, None)], "t string, d double, n int")
    got = {r["column"]: r.asDict() for r in profile.cell_profile(rows).collect()}
    assert [got["t"][k] for k in profile.KINDS] == [1, 1, 1, 1, 1] and got["n"]["missing"] == 5 and got["n"]["about_distinct"] == 0
    assert {r["column"]: r["missing"] for r in profile.missing_profile(rows).collect()} == {"t": 1, "d": 1, "n": 5}
    for r in profile.type_profile(rows).collect():
        assert got[r["column"]][r["kind"]] == r["cells"]
    plan = profile.cell_profile(rows)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Generate") == 1 and plan.count("LogicalRDD") + plan.count("LocalRelation") == 1


def test_numbered_parts(spark, tmp_path):
    rows = spark.range(25).selectExpr("id", "if(id % 4 = 0, null, concat('a,\"', id)) t", "id / 4 x")
    folder = tmp_path / "parts"
    parts.write_numbered(rows.repartition(3), str(folder), 10, ["id"])
    assert sorted(p.name for p in folder.iterdir()) == ["base.csv", "base_1.csv", "base_2.csv"]
    assert [len((folder / f).read_text().splitlines()) for f in ("base.csv", "base_1.csv", "base_2.csv")] == [11, 11, 6]
    back = spark.read.schema("id long, t string, x double").option("escape", '"').csv(str(folder), header=True)
    assert sorted(map(str, back.collect())) == sorted(map(str, rows.collect()))
    with pytest.raises(ValueError, match="already"):
        parts.write_numbered(rows, str(folder), 10, ["id"])
    bad = rows.withColumn("x", F.when(F.col("id") == 13, F.raise_error(F.lit("lost"))).otherwise(F.col("x")))
    with pytest.raises(Exception, match="lost"):
        parts.write_numbered(bad, str(tmp_path / "bad"), 10, ["id"], base="other")
    assert not [*(tmp_path / "bad").iterdir()]
    parts.write_numbered(rows.limit(0), str(tmp_path / "none"), 10, ["id"])
    assert not [*(tmp_path / "none").iterdir()]


def test_streams(spark, tmp_path):
    from flowmill.streaming import scoring

    rows = wide(spark)
    trained = models.train_forest(rows, "label", ["f0", "f1", "f2"], trees=3, depth=3)
    rows.drop("label").write.parquet(str(tmp_path / "in"))
    stream = scoring.read_captures(spark, str(tmp_path / "in"), "id long, f0 double, f1 double, f2 double")
    scoring.score_stream(stream, trained, str(tmp_path / "out"), str(tmp_path / "check"), keep=["id"]).awaitTermination(60)
    assert spark.read.parquet(str(tmp_path / "out")).count() == rows.count()


def test_shared_folder_is_set(spark):
    assert shared_dir(spark) and spark.sparkContext.getCheckpointDir()


def test_fits_of_a_fold_share_bins(spark, monkeypatch):
    """Rows of a fold are cut into bins once for all combinations, and models are those of fits alone."""
    rows = spark.createDataFrame([(k, "abc"[k % 3], float(k * 37 % 101 + 40 * (k % 3)), float(k % 7)) for k in range(240)], "id long, label string, x double, y double")
    calls, binned = [], boosting.SoftmaxBooster.binned
    monkeypatch.setattr(boosting.SoftmaxBooster, "binned", lambda self, rows: calls.append(1) or binned(self, rows))
    options = models.grid(rounds=[2], depth=[2], rate=[0.1, 0.3], subsample=[0.8, 1.0])
    got = {(r["combination"], r["fold"]): r["f1"] for r in models.tune(rows, "label", ["x", "y"], options, models.boosting_of, ["id"], k=2).collect()}
    assert len(got) == 8 and len(calls) == 2
    alone = models.tune(rows, "label", ["x", "y"], options[:1], models.boosting_of, ["id"], k=2).collect()
    assert {(r["combination"], r["fold"]): r["f1"] for r in alone}.items() <= got.items()


@pytest.fixture(scope="module")
def noisy(spark):
    """Rows of three labels that no short tree tells apart, and their values."""
    rng = np.random.default_rng(5)
    y = rng.integers(0, 3, 400)
    x = np.stack([y + 2 * rng.normal(size=400), rng.normal(size=400) - (y == 1), rng.integers(0, 4, 400) + 0.0, np.ones(400)], axis=1)
    rows = spark.createDataFrame([(k, f"c{y[k]}", *map(float, x[k])) for k in range(400)], "id long, label string, f0 double, f1 double, f2 double, f3 double").repartition(3)
    return rows, x


@pytest.mark.parametrize("subsample", [1.0, 0.7])
def test_boosting_is_the_same_by_level_and_whole(spark, noisy, monkeypatch, subsample):
    """Trees of one task, of tasks below nodes of few rows, and of a job a level are the same."""
    prepared, _ = models.prepare(noisy[0], "label", ["f0", "f1", "f2", "f3"])
    booster = boosting.SoftmaxBooster(rounds=3, depth=5, rate=0.3, subsample=subsample, bins=16)
    binned = booster.binned(prepared)
    whole = booster.fit(binned)
    assert max(len(t.feature) for t in whole.trees[0]) > 20
    monkeypatch.setattr(boosting, "FOLD", 2)
    for cells in (64 * 60, 0):
        monkeypatch.setattr(boosting, "CELLS", cells)
        other = booster.fit(binned)
        assert np.array_equal(other.margins(noisy[1]), whole.margins(noisy[1]))
        assert [len(t.feature) for trees in other.trees for t in trees] == [len(t.feature) for trees in whole.trees for t in trees]
        assert np.allclose(other.gains(), whole.gains())


def test_deep_boosting_takes_few_jobs(spark, noisy):
    """Rounds and levels of a table that a task may hold are no jobs each: a search can afford hundreds of them."""
    prepared, _ = models.prepare(noisy[0], "label", ["f0", "f1", "f2", "f3"])
    booster = boosting.SoftmaxBooster(rounds=40, depth=20, rate=0.1)
    binned = booster.binned(prepared)
    spark.sparkContext.setJobGroup("deep boosting", "")
    try:
        model = booster.fit(binned)
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert len(model.trees) == 40 and len(spark.sparkContext.statusTracker().getJobIdsForGroup("deep boosting")) <= 3


def test_beginnings_are_evaluated_in_one_pass(spark, noisy):
    prepared, _ = models.prepare(noisy[0], "label", ["f0", "f1", "f2", "f3"], ["id"])
    prepared = prepared.withColumn("code", F.when(F.col("id") % 11 > 0, F.col("code")))  # rows without a true label are left out
    model = boosting.SoftmaxBooster(rounds=6, depth=3).fit(prepared.where("code is not null"))
    got = {r["rounds"]: r["f1"] for r in evaluate.macro_f1_by(model.beginnings(prepared, [1, 6, 4]), "rounds", "code", "prediction").collect()}
    assert got == pytest.approx({n: models.MacroF1().evaluate(model.first(n).transform(prepared)) for n in (1, 4, 6)}, abs=1e-12)


def test_searches_of_few_rows_send_no_model_to_the_driver(spark, noisy, monkeypatch):
    """The task that grows a fold's trees predicts its held rows; scores are those of a fitted model's beginnings."""
    options = models.grid(rounds=[1, 3], depth=[3], rate=[0.3], subsample=[0.8])
    tried = lambda: {(r["combination"], r["fold"]): r["f1"] for r in models.tune(noisy[0], "label", ["f0", "f1", "f2", "f3"], options, models.boosting_of, ["id"], k=2).collect()}
    fits, fit = [], boosting.SoftmaxBooster.fit
    monkeypatch.setattr(boosting.SoftmaxBooster, "fit", lambda self, rows: fits.append(1) or fit(self, rows))
    got = tried()
    assert len(got) == 4 and not fits
    monkeypatch.setattr(boosting, "CELLS", 0)
    assert tried() == pytest.approx(got, abs=1e-12) and len(fits) == 2


@pytest.mark.parametrize("bins", [64, 13, 256])
def test_trees_are_the_same_by_sums_and_by_order(monkeypatch, bins):
    """However nodes are split; and where a parent's sums are held, rows of the larger child aren't added up again."""
    rng = np.random.default_rng(8)
    x = rng.integers(0, bins, (3000, 5)).astype("u1")
    x[:, 3] //= 7  # many ties
    x[:, 4] = x[:, 0]
    y = (x[:, 0] // 2 + rng.integers(0, bins, 3000) > bins * 0.7).astype("i4") + (x[:, 1] > bins / 2)
    added, sums = [], boosting._sums
    monkeypatch.setattr(boosting, "_sums", lambda cells, rows, *more: added.append(len(rows)) or sums(cells, rows, *more))

    def grown(few, held, step, depth=9, subsample=0.8):
        for name, v in (("FEW", few), ("HELD", held), ("STEP", step)):
            monkeypatch.setattr(boosting, name, v)
        added.clear()
        own = [(k, x[a : a + 1000], y[a : a + 1000], np.zeros((len(x[a : a + 1000]), 3))) for k, a in enumerate(range(0, 3000, 1000))]
        return [tree for trees in boosting._rounds(own, 3, depth, 3, boosting.Rule(bins, 0.3, 1.0, 1.0), 1, subsample) for tree in trees]

    want = grown(0, 1 << 40, 1 << 18)
    whole = sum(added)
    assert max(len(tree.feature) for tree in want) > 100 and set().union(*(set(tree.feature) for tree in want)) >= {-1, 0, 1, 3}
    for few, held, step in ((1, 3, 1 << 18), (1, 3, 1 << 10), (0, 0, 1 << 18), (0.9, 1, 1 << 12), (250 / bins, 1 << 40, 1 << 14)):
        for a, b in zip(grown(few, held, step), want, strict=True):
            assert all(np.array_equal(u, v) for u, v in zip(a, b, strict=True))
        assert not (few == held == 0) or sum(added) < whole / 2 + 9 * 3000
    root_and_halves = grown(0, 0, 1 << 18, depth=6, subsample=1.0)
    assert sum(added) <= len(root_and_halves) * 3000 * (1 + 6 / 2)


def test_one_task_learns_from_the_rows_of_a_search():
    """A refit of 72,000 rows takes no job a level and round."""
    assert boosting.SoftmaxBooster().fits_task(boosting.Binned(None, [], 64, 3, 72_000))


def test_searches_begin_with_the_longest_fits(spark, noisy):
    options, made = models.grid(rounds=[1, 2], depth=[1, 3, 2]), []
    models.tune(noisy[0], "label", ["f0", "f1"], options, lambda option: made.append((option["depth"], option["rounds"])) or models.boosting_of(option), ["id"], k=2, parallel=1)
    assert made == [(3, 2), (3, 2), (2, 2), (2, 2), (1, 2), (1, 2)]
