import pytest

from tidewell.sources import fetched

A = "https://a.example"
RESPONSES = [
    (f"{A}/1", 301, "/2", None, None), (f"{A}/2", 302, "https://b.example/3#part", None, None), ("https://b.example/3", 200, None, None, "body é"),
    (f"{A}/loop", 302, "loop", None, None), (f"{A}/bare", 307, " ", None, "x"), (f"{A}/kept", 304, None, None, "ignored"), (f"{A}/gone", 410, None, None, "x"),
    (f"{A}/told", 200, None, 99, "x"), (f"{A}/long", 200, None, None, "x" * 21), (f"{A}/full", 200, None, 20, "é" * 10), (f"{A}/none", 200, None, None, None),
    (f"{A}/out", 301, "https://evil.example.org/", None, None), (f"{A}/plain", 301, "http://a.example/2", None, None), (f"{A}/inside", 308, "https://c.example/x", None, None),
    (f"{A}/nowhere", 302, "https://d.example/", None, None), ("https://c.example/x", 200, None, None, "secret"), (f"{A}/number", 302, "https://10.1.2.3/x", None, None), (f"{A}/user", 302, "https://u:p@a.example/1", None, None),
    *((f"{A}/c{k}", 302, f"/c{k + 1}", None, None) for k in range(9)), (f"{A}/c9", 200, None, None, "far"), (f"{A}/twice", 200, None, None, "b"), (f"{A}/twice", 200, None, None, "a"),
]
ADDRESSES = [("a.example", "8.8.8.8"), ("A.example", "2606:4700::1111"), ("b.example", "1.1.1.1"), ("c.example", "8.8.8.8"), ("c.example", "192.168.0.1")]


@pytest.mark.parametrize(
    ("path", "hops", "payload", "code"),
    [("1", 3, "body é", None), ("loop", 7, None, "REDIRECT_LIMIT_EXCEEDED"), ("bare", 1, None, "REDIRECT_WITHOUT_LOCATION"), ("kept", 1, "", None), ("gone", 1, None, "HTTP_410"), ("told", 1, None, "RESPONSE_TOO_LARGE"), ("long", 1, None, "RESPONSE_TOO_LARGE"), ("full", 1, "é" * 10, None), ("none", 1, "", None), ("out", 2, None, "HOST_NOT_ALLOWED"), ("plain", 2, None, "URL_UNSAFE"), ("inside", 2, None, "ADDRESS_NOT_PUBLIC"), ("nowhere", 2, None, "HOST_UNRESOLVED"), ("number", 2, None, "HOST_NOT_ALLOWED"), ("user", 2, None, "URL_UNSAFE"), ("c3", 7, None, "REDIRECT_LIMIT_EXCEEDED"), ("c4", 6, "far", None), ("twice", 1, "a", None), ("missing", 1, None, "NOT_FETCHED")],
)
def test_every_way_ends_with_a_payload_or_a_code(ways, path, hops, payload, code):
    r = ways[path]
    assert (len(r["hops"]), r["payload"], r["code"]) == (hops, payload, code)
    assert r["hops"][0] == f"{A}/{path}" and r["last_url"] == r["hops"][-1]


@pytest.fixture(scope="module")
def ways(spark):
    paths = sorted({u.removeprefix(f"{A}/") for u, *_ in RESPONSES if u.startswith(A)} | {"missing"})
    requests = spark.createDataFrame([(p, f"{A}/{p}", ["example"], 20) for p in paths], "key string, url string, allowed_domains array<string>, most_bytes int")
    responses = spark.createDataFrame(RESPONSES, "url string, status int, location string, announced_bytes long, body string")
    addresses = spark.createDataFrame(ADDRESSES, "host string, address string")
    return {r["key"]: r for r in fetched.followed(requests, responses, addresses).collect()}


def test_bounds(spark):
    empty = spark.createDataFrame([], "key string, url string, allowed_domains array<string>, most_bytes int")
    responses, addresses = spark.createDataFrame([], "url string, status int, location string, announced_bytes long, body string"), spark.createDataFrame([], "host string, address string")
    assert fetched.followed(empty, responses, addresses).collect() == []
    with pytest.raises(ValueError):
        fetched.followed(empty, responses, addresses, 11)
