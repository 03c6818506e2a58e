"""String values bound to names, several to a line."""

from codelode.operators import rules


def test_every_binding_of_a_line(spark):
    text = 'var a="plain words", api_key="kR8vQz31LmXw72Ty", b = 3, token: \'9fJq4-ZpWc8sVb61\';\nsecret = "short"; my_secret = "Tq7Lz0PxW4bN83vK"\n'
    f = spark.createDataFrame([("s", "min.js", text), ("s", "none.js", "let x = 1;"), ("s", "n.js", None)], "source string, path string, text string")
    assert [(r.line, r.name) for r in rules.literals(f).orderBy("line", "name").collect()] == [(1, "a"), (1, "api_key"), (1, "token"), (2, "my_secret")]
    hits = rules.literal_scan(rules.literals(f), r"(?i)key|token|secret", None, 40.0)
    assert sorted((r.line, r.name) for r in hits.collect()) == [(1, "api_key"), (1, "token"), (2, "my_secret")]
