import pytest
from pyspark.sql import functions as F

from codelode.functions import scalars as S
from codelode.operators import link


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'string'}" for k in values))
    return df.select(column.alias("x")).first().x


@pytest.mark.parametrize(
    ("method", "path", "key"),
    [
        ("get", "account/readProfile", "GET /account/readProfile"), ("get", "/users/{id}", "GET /users/{}"), ("get", "/users/:id", "GET /users/{}"), ("post", "//a//b/", "POST /a/b"),
        ("get", "", "GET /"), ("post", "/v1/rows/{id}:freeze", "POST /v1/rows/{}:freeze"), ("post", "/v1/rows:readMany", "POST /v1/rows:readMany"),
        ("get", "/trips/:start-:end", "GET /trips/{}-{}"), ("get", "/birds/:family.:kind", "GET /birds/{}.{}"), ("get", "/a/b:c", "GET /a/b:c"), ("get", None, "GET /"),
    ],
)
def test_http_keys(spark, method, path, key):
    assert one(spark, S.http_key(F.col("m"), F.col("p")), m=method, p=path) == key


@pytest.mark.parametrize(("key", "yes"), [("GET /{}", False), ("GET /{}/{}", False), ("GET /a/{}", True), ("GET /", True), ("table:users", True)])
def test_route_identity(spark, key, yes):
    assert one(spark, S.carries_identity(F.col("k")), k=key) is yes


ANT = [
    ("/files/**", "/files/a/b", True), ("/files/**", "/files", True), ("/files/**", "/file/a", False), ("/files/*/thumb", "/files/x/thumb", True), ("/files/*/thumb", "/files/x/y/thumb", False),
    ("/**", "/", True), ("/**/edit", "/a/b/edit", True), ("/**/edit", "/edit", True), ("/a/{id}", "/a/7", True), ("/a/?.x", "/a/anything", True), ("/a", "/a", True), ("/a", "/b", False),
    ("/a/**/b/*", "/a/x/y/b/c", True), ("/a/**/b/*", "/a/b/c", True), ("/a/**/b/*", "/a/x/c", False),
]


@pytest.mark.parametrize(("pattern", "path", "yes"), ANT)
def test_ant_patterns(spark, pattern, path, yes):
    import re

    assert bool(re.match(S.ant_to_regex(pattern), path)) is yes
    hit = F.rlike(F.regexp_replace("s", "^/+", ""), link._ant_regex(F.col("p")))
    assert one(spark, hit, p=pattern, s=path) is yes


def test_hash_and_entropy_vectors(spark):
    df = spark.createDataFrame([("",), ("a",), ("aaaa",), ("correct-horse-battery-staple",), ("PlaceholderSecretValue",), (None,)], "v string")
    rows = df.select("v", S.fnv1a_hex("v").alias("h"), S.entropy_bits("v").alias("e")).collect()
    h, e = {r.v: r.h for r in rows}, {r.v: r.e for r in rows}
    assert h[""] == "cbf29ce484222325" and h["a"] == "af63dc4c8601ec8c" and h[None] is None
    assert e["aaaa"] == 0 and e[""] == 0 and 97.8 < e["correct-horse-battery-staple"] < 98 and 75.6 < e["PlaceholderSecretValue"] < 75.8


def test_masks_tags_globs_folders(spark):
    assert one(spark, S.mask_literals(F.col("s")), s="x('a\\'b', \"c\") + 'open") == "x('    ', \" \") + 'open"
    assert one(spark, S.commit_tags(F.col("s")), s="[fix][ui] thing") == ["FIX", "UI"]
    assert one(spark, S.commit_tags(F.col("s")), s="feat(core): add it") == ["FEAT"] and one(spark, S.commit_tags(F.col("s")), s="hello") == []
    import re

    for glob, path, yes in (("**/*.{ts,js}", "a/b/c.js", True), ("*.ts", "a/b.ts", False), ("src/**", "src/a/b", True), ("a?c", "abc", True), ("**/x", "x", True)):
        assert bool(re.match(S.glob_to_regex(glob), path)) is yes
    assert one(spark, S.folder_of(F.col("s"), 2), s="a/b/c/d.ts") == "a/b" and one(spark, S.folder_of(F.col("s"), 2), s="d.ts") == "." and one(spark, S.folder_of(F.col("s"), 3), s="a/d.ts") == "a"
    assert one(spark, S.registrable_domain(F.col("s")), s="a.b.example") == "b.example" and one(spark, S.lower_first(F.col("s")), s="UserRow") == "userRow"
