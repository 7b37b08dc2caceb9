import pytest
from pyspark.sql import functions as F

from artifactlake.operators import filters, paging
from artifactlake.functions.redact import redact_fields
from artifactlake.operators.filters import FilterState


def rows(spark):
    data = [
        ("e1", "/a/Déjà vu", "x", None, 5, "noise", "pending", None, 1.0),
        ("e2", "/a/b", "Report", "u1", None, None, None, False, None),
        ("e3", "/a/c", "report 2", "u2", 50, "normal", "exported", False, 9.0),
        ("e4", "/a/d", "report 3", "u1", 70, "normal", "pending", True, 9.0),
    ]
    schema = (
        "entry_id string, display_path string, display_name string, owner_id string, size_bytes long,"
        " system_noise string, export_state string, dismissed boolean, interest_score double"
    )
    df = spark.createDataFrame(data, schema)
    for name in ("volume_id", "category", "allocation", "modified_at"):
        df = df.withColumn(name, F.lit(None).cast("string"))
    for name in ("encrypted", "corrupt", "duplicate"):
        df = df.withColumn(name, F.lit(None).cast("boolean"))
    return df


def ids(df):
    return sorted(r.entry_id for r in df.collect())


def test_default_state_hides_noise_exported_and_dismissed(spark):
    assert ids(filters.apply_filter_state(rows(spark), FilterState())) == ["e2"]


def test_missing_size_passes_and_missing_interest_fails(spark):
    everything = {"include_noise": True, "include_exported": True, "include_dismissed": True}
    sized = FilterState.of({**everything, "min_size": 60})
    assert ids(filters.apply_filter_state(rows(spark), sized)) == ["e2", "e4"]
    keen = FilterState.of({**everything, "min_interest": 2.0})
    assert ids(filters.apply_filter_state(rows(spark), keen)) == ["e3", "e4"]


def test_text_search_folds_case_and_collapses_query_spaces(spark):
    everything = {"include_noise": True, "include_exported": True, "include_dismissed": True}
    state = FilterState.of({**everything, "text": "  REPORT   2 "})
    assert ids(filters.apply_filter_state(rows(spark), state)) == ["e3"]


def test_like_matching_folds_ascii_only_and_takes_wildcards_literally(spark):
    df = spark.createDataFrame([("É100%",), ("é100x",), ("A_B",), ("AxB",)], "t string")
    hit = lambda q: sorted(r.t for r in df.where(filters.text_match(["t"], q)).collect())
    assert hit("é100") == ["é100x"]
    assert hit("0%") == ["É100%"]
    assert hit("a_b") == ["A_B"]


def test_view_round_trip_and_rejects(spark):
    state = FilterState.of({"text": " x ", "users": ["a", 3, ""], "min_size": True, "min_interest": 2})
    assert state.users == ("a",) and state.min_size is None and state.min_interest == 2.0
    texts = filters.views_as_json(filters.saved_view(spark, "v", "mine", state))
    assert filters.load_view(filters.views_from_json(texts), "v") == state
    poor = spark.createDataFrame([("%%%",), ("{}",), (None,), ('{"view_version":"x","view_id":"v","filter_state":{}}',)], "view_json string")
    back = filters.views_from_json(poor.union(texts))
    assert back.count() == 1 and filters.load_view(back, "v") == state
    with pytest.raises(LookupError):
        filters.load_view(back, "w")
    with pytest.raises(LookupError):
        filters.load_view(back.union(back), "v")


def test_redacted_fields_stay_whole_unless_a_limit_is_given(spark):
    row = ("a" * 5000, {"k": "b" * 700, "my_secret": "c" * 9000}, [("d" * 600, "e")], 3)
    df = spark.createDataFrame([row, ("x\0y", None, [], 4)], "t string, m map<string,string>, l array<struct<s:string,password:string>>, n int")
    whole = redact_fields(df).orderBy("n").collect()
    assert whole[0].t == row[0] and whole[0].m == {"k": "b" * 700, "my_secret": "[redacted]"} and whole[0].l[0].s == "d" * 600
    assert whole[1].t == "xy"
    cut = redact_fields(df, max_chars=650).orderBy("n").collect()
    assert [r.fields_cut for r in cut] == [True, False] and len(cut[0].t) == 650 and len(cut[0].m["k"]) == 650 and len(cut[0].l[0].s) == 600


@pytest.mark.parametrize("sort", paging.SORTABLE)
def test_pages_concatenate_to_the_full_sort(spark, sort):
    data = [(f"e{i:03d}", f"p{i % 7}", i % 5 or None, f"d{i % 3}", (i % 4) * 1.0, 0.5) for i in range(60)]
    df = spark.createDataFrame(
        data, "entry_id string, path string, size_bytes long, modified_at string, interest_score double, confidence double"
    )
    full = [r.entry_id for r in df.orderBy(F.col(sort).asc_nulls_first(), "entry_id").collect()]
    got, cursor = [], None
    while True:
        items, cursor = paging.take_page(paging.page(df, sort, cursor, 18), sort, "entry_id", 17)
        got += [r.entry_id for r in items]
        if cursor is None:
            break
    assert got == full


def test_page_rejects_bad_input(spark):
    df = spark.createDataFrame([("e", "p")], "entry_id string, path string")
    other = paging.encode_cursor({"sort": "confidence", "key": "e", "value": 1})
    for args in (("nope", None, 10), ("path", "%%%", 10), ("path", other, 10), ("path", None, 0)):
        with pytest.raises(paging.PagingError):
            paging.page(df, *args)
