from urllib.parse import urljoin

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from leafmill.functions.urls import host_of, link_kind, resolve
from pyspark.sql import functions as F

segment = st.sampled_from(["a", "b.html", "..", ".", "c d", "é"])
path = st.lists(segment, min_size=1, max_size=4).map("/".join)
reference = st.one_of(
    path,
    path.map(lambda p: "/" + p),
    path.map(lambda p: p + "/"),
    path.map(lambda p: f"/{p}?q=../x#f"),
    path.map(lambda p: "//other.example.org/" + p),
    st.sampled_from(["#top", "?page=2", "http://x.example.com/y?z", "mailto:a@b.c"]),
)
base = st.sampled_from(
    [
        "http://h.example.com",
        "http://h.example.com/",
        "https://h.example.com/d/e?x=/y/../z#t/u",
        "https://h.example.com/d/e/",
    ]
)


@settings(max_examples=5, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.tuples(base, reference), min_size=60, max_size=120))
def test_resolve_like_the_standard_library(spark, pairs):
    df = spark.createDataFrame(pairs, "base string, ref string")
    for r in df.withColumn("uri", resolve(F.col("base"), F.col("ref"))).collect():
        assert r["uri"] == urljoin(r["base"], r["ref"]), (r["base"], r["ref"])


def test_kinds_and_hosts(spark):
    page = "https://user@Site.example.com:8080/x"
    cases = {
        "/a": "internal",
        "a/b": "internal",
        "?x": "internal",
        "http://site.example.com/z": "internal",
        "//site.example.com/z": "internal",
        "//cdn.example.com/z": "external",
        "https://other.example.com": "external",
        "ftp://other.example.com": "external",
        "#top": "anchor",
        "JavaScript:void(0)": "script",
        "mailto:a@example.com": "mail",
    }
    df = spark.createDataFrame([(page, r) for r in cases], "base string, ref string")
    rows = df.select("ref", link_kind(F.col("base"), F.col("ref")).alias("kind"), host_of(F.col("base")).alias("host")).collect()
    assert {r["ref"]: r["kind"] for r in rows} == cases
    assert {r["host"] for r in rows} == {"site.example.com"}
