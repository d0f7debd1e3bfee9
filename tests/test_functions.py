import hashlib
import itertools

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from matchloom.functions import classify, seniority, skills, text, urls, vectors
from matchloom.functions.registry import extract, register, register_url_table_function


def column(spark, values, expr, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r.x for r in df.select("i", expr(F.col("v")).alias("x")).orderBy("i").collect()]


def test_canonical_key(spark):
    got = column(spark, ["GraphQL", "graphql-api", "GraphQL API", "React Native", "APIs", "C++", "C#", ".NET", " - ", None], skills.canonical_key)
    assert got == ["graphql", "graphql", "graphql", "reactnative", "apis", "c++", "c#", ".net", "", None]


def test_normalize_skill(spark):
    got = column(spark, ["  JS ", "PostGres", " Rust ", "   ", "GraphQL APIs", "AWS Lambda", " Py "], skills.normalize_skill)
    assert got == ["JavaScript", "PostgreSQL", "Rust", "", "GraphQL", "AWS Lambda", "Python"]


def test_skill_lists_keep_the_first(spark):
    items = [[("JS", 5.0), ("JavaScript", 1.0), ("Integrity ", None), ("", 2.0), (None, 1.0), ("Rust", None)], []]
    got = column(spark, items, skills.normalize_skill_items, "array<struct<name:string,years:double>>")
    assert [[tuple(s) for s in row] for row in got] == [[("JavaScript", 5.0), ("Rust", None)], []]
    assert column(spark, [["js", "Go", "JavaScript", " "]], skills.normalize_skills, "array<string>") == [["JavaScript", "Go"]]


@pytest.mark.parametrize(
    ("url", "want"),
    [
        ("https://E.com/Jobs/?b=2&a=1#x", "https://e.com/Jobs?a=1&b=2"),
        ("HTTP://e.com:80/", "http://e.com"),
        ("e.com/jobs", "https://e.com/jobs"),
        ("just-words", None),
        ("mailto:a@b.com", None),
        ("file:///etc/passwd", None),
        ("two words", None),
        ("", None),
        ("http://127.0.0.1/x", None),
        ("http://[::ffff:10.0.0.1]/", None),
        ("http://2130706433/", None),
        ("http://api.localhost/", None),
        ("https://e.com/?UTM_Source=x&q", "https://e.com?q="),
        ("https://u:p@e.com:8443/x", "https://e.com:8443/x"),
        ("https://e.com/a?x=%20b&x=a+c", "https://e.com/a?x=+b&x=a+c"),
        ("https://e.com:bad/", None),
    ],
)
def test_canonical_url(url, want):
    assert urls.canonical_url(url) == want


def test_simple_urls_agree_with_the_general_form(spark):
    queries = ["", "?", "?a", "?b=2&a=1", "?ref=x&B=", "?utm_id=1&z=9&z=1", "?a=-._~"]
    cases = [f"https://Jobs.Example.com{path}{q}{f}" for path, q, f in itertools.product(["", "/", "/a", "/A.b/c~/", "//"], queries, ["", "#f"])]
    assert column(spark, cases, urls.normalize_url) == [urls.canonical_url(u) for u in cases]


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=40))
def test_canonical_url_is_stable(url):
    once = urls.canonical_url(url)
    assert once is None or urls.canonical_url(once) == once


def test_keys(spark):
    u = "https://E.com/a/?utm_source=1"
    assert column(spark, [u, "no url"], urls.canonical_key_for_url) == ["url:" + hashlib.sha256(b"https://e.com/a").hexdigest(), "url:" + hashlib.sha256(b"no url").hexdigest()]
    assert column(spark, [u], urls.hash_url) == [hashlib.sha256(u.encode()).hexdigest()]
    assert column(spark, [u, "x"], urls.domain_of) == ["e.com", ""]
    assert column(spark, [7], lambda c: urls.dedupe_key("discover", c), "int") == ["discover:7"]
    with pytest.raises(ValueError, match="profile, posting"):
        urls.dedupe_key("other", F.lit(1))


def test_content_hash_ignores_layout(spark):
    a, b, c = column(spark, ["x\n  y  \n\n", "x\r\n y", "x y"], text.content_hash)
    assert a == b == hashlib.sha256(b"x\ny").hexdigest() != c


def test_times(spark):
    got = column(spark, ["2024-01-02T03:04:05Z", "2024-01-02T03:04:05+02:00", "2024-01-02", "soon", "2024-13-01T00:00:00Z", None], text.iso_timestamp)
    assert [str(t) if t else None for t in got] == ["2024-01-02 03:04:05", "2024-01-02 01:04:05", "2024-01-02 00:00:00", None, None, None]


def test_html(spark):
    page = "<html><head><title>t</title></head><body><nav>menu</nav><p>A &amp; <b>b</b></p><script>x</script><p> c </p></body>"
    assert column(spark, [page, "", None, "<nav>only</nav>"], text.html_to_text) == ["A &\nb\nc", "", None, ""]
    assert column(spark, ["&lt;p&gt;x&lt;/p&gt;", None], text.html_unescape) == ["<p>x</p>", None]


def test_flatten_and_truncate(spark):
    assert column(spark, ['["a", ["b"]]', "plain", "[]", None], text.flatten_text) == ["a\nb", "plain", None, None]
    assert [tuple(x) for x in column(spark, ["abc", "ab"], lambda c: text.truncate(c, 2))] == [("ab", True), ("ab", False)]


def test_levels(spark):
    titles = ["Senior Staff Engineer", "Sr. Dev", "Software Engineer Internship", "Software Engineer, International", "Chief of Staff", "Entry-level QA", "Co-op", "Staff+ Engineer", "", None]
    assert column(spark, titles, seniority.seniority_from_title) == ["staff", "senior", "junior", None, None, "junior", "junior", "staff", None, None]


def test_level_delta(spark):
    rows = [("senior", "senior", 5.0, 3.0), ("mid", "staff", None, 3.0), ("staff", "junior", 1.0, None), ("senior", "unknown", 2.0, 2.5)]
    df = spark.createDataFrame(rows, "a string, b string, c double, d double")
    got = [(r.d.steps, r.d.direction, r.d.years_gap) for r in df.select(seniority.seniority_delta(*[F.col(x) for x in "abcd"]).alias("d")).collect()]
    assert got == [(0, "match", 2.0), (-2, "under", None), (3, "over", None), (None, "unknown", -0.5)]


def test_vectors(spark):
    df = spark.createDataFrame([([3.0, 4.0], [0.0, 0.0])], "a array<float>, z array<float>")
    r = df.select(vectors.norm(F.col("a")).alias("n"), vectors.l2_normalize(F.col("a")).alias("u"), vectors.l2_normalize(F.col("z")).alias("z")).first()
    assert r.n == 5.0 and [round(x, 6) for x in r.u] == [0.6, 0.8] and r.z == [0.0, 0.0]


def test_classifications(spark):
    df = spark.createDataFrame([(200, "text/html", 10, None), (503, None, 0, None), (404, None, 0, None), (200, "image/png", 10, None), (200, "text/plain", 9_000_000, None), (None, None, None, "timed out")], "s int, t string, n long, e string")
    got = [r.o for r in df.select(classify.fetch_outcome(*[F.col(c) for c in "stne"]).alias("o")).collect()]
    assert got == ["ok", "transient", "permanent", "permanent", "permanent", "transient"]
    assert column(spark, [0.7, 0.45, 0.1], classify.score_band, "double") == ["high", "mid", "low"]
    assert column(spark, [5, 59 * 60, 47 * 3600, 49 * 3600, None], classify.human_age, "int") == ["just now", "59m ago", "47h ago", "2d ago", "never"]
    delays = column(spark, [1, 2, 3, 9], lambda c: classify.retry_delay(F.lit(5), c), "int")
    assert all(0.8 * b <= d <= 1.2 * b for d, b in zip(delays, (10, 60, 300, 300)))


def test_sql_names(spark):
    names = register(spark)
    assert set(names) == {"canonical_key", "normalize_skill", "seniority_from_title", "content_hash", "cosine", "blend", "normalize_url"}
    r = spark.sql("SELECT canonical_key('GraphQL API') k, normalize_skill(' js ') s, seniority_from_title('Sr. Dev') l, cosine(array(float(1), float(0)), array(float(0.5), float(1))) c, blend(1D, 0.5D) b, normalize_url('E.com/') u, content_hash('x\\n y') h").first()
    assert (r.k, r.s, r.l, r.c, round(r.b, 6), r.u, r.h) == ("graphql", "JavaScript", "senior", 0.5, 0.8, "https://e.com", hashlib.sha256(b"x\ny").hexdigest())


def test_table_function_and_extractor(spark):
    register_url_table_function(spark)
    rows = spark.sql("SELECT * FROM parse_url_list('e.com/a\n\nE.com/a/\nnope\nf.com\ng.com', 2)").collect()
    assert [(r.line_no, r.outcome) for r in rows] == [(0, "accepted"), (2, "duplicate"), (3, "rejected"), (4, "accepted"), (5, "over_cap")]
    out = extract(spark.createDataFrame([(1, "abcdef")], "id int, t string"), "id", "t", lambda: lambda ts: [x.upper() for x in ts], 3)
    assert out.first().raw == "ABC"


def test_alias_keys_are_the_aliases_keys(spark):
    rows = spark.createDataFrame(list(skills.ALIASES.items()), "alias string, name string")
    got = rows.select(skills.canonical_key(F.col("alias")).alias("key"), "name").collect()
    assert {r.key for r in got} == set(skills.ALIAS_KEYS) and all(skills.ALIAS_KEYS[r.key] in {x.name for x in got if x.key == r.key} for r in got)
