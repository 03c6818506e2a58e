"""Prose in code, markup and residue: exact small cases and held-out accuracy."""

import html

import numpy as np
import pytest

from codelode.llm import markup, proseincode, queries, residue

# --- prose in code


def found(path, text):
    return sorted(x[:3] for x in next(proseincode.passages_of([(path, text)])))


TS = """import { x } from './y';
// eslint-disable-next-line
// SPDX-License-Identifier: MIT
let a = 1; // The reader keeps the earlier value and moves on.
const re = /\\/\\*+\\s*['"]x/g; const url = 'https://a.example/b//c';

// Diese Funktion wird pro Datei nur
// einmal aufgerufen, damit nichts verloren geht.
const q = "SELECT a_id FROM t_one WHERE b_no = ?";
/**
 * Cette fonction n'est appelée qu'une fois par fichier.
 */
const s = 'It\\'s cheaper to do it once, isn\\'t it?', k = 'a:b', c = 'row col-2 p-2';
// const oldValue = makeThing(old);
const t = `이 함수는 파일마다
한 번만 실행된다. ${value}`;
const u = '\\u8fd9\\u4e2a\\u51fd\\u6570\\u53ea\\u6267\\u884c\\u4e00\\u6b21';
const v = "// la función se ejecuta una sola vez por archivo";
"""


def test_typescript():
    assert found("a/b.TSX", TS) == [
        (4, "comment", "en"), (7, "comment", "de"), (10, "comment", "fr"), (13, "literal", "en"), (15, "literal", "ko"), (17, "literal", "zh"), (18, "literal", "es"),
    ]


@pytest.mark.parametrize(
    ("path", "text", "want"),
    [
        ("a.py", '# noqa: E501\ndef f():\n    """Returns the number of items\n    that were found."""\n    x = r\'#\\s*y\'  # type: ignore\n    # 古い値が残っていないか確認\n', [(3, "literal", "en"), (6, "comment", "ja")]),
        ("a.rs", "fn f<'a>(x: &'a str) {\n let q = '\"'; // keeps the last of the two values\n let s = r#\"a \"quoted\" word and then some more\"#; /* one /* two */\n}", [(2, "comment", "en"), (3, "literal", "en")]),
        ("a.go", "var c = '\\''\n// nothing here may import that package\nx := `the raw one is read as it is`", [(2, "comment", "en"), (3, "literal", "en")]),
        ("a.java", 'char c = \'"\';\nString s = """\n  Each entry carries a line and a name.""";\n// end', [(2, "literal", "en")]),
        ("a.sql", "SELECT '--' || a FROM b; -- this is read by every worker\n-- DROP TABLE x;\nINSERT INTO t VALUES ('That isn''t wrong, it''s slow');", [(1, "comment", "en"), (3, "literal", "en")]),
        ("a.js", "﻿// 값이 없다\r\nx();\r\n// 설정에 항목이 없으면 기본값\r\n", [(3, "comment", "ko")]),
        ("none", "", []),
        (None, "/* it was never closed by anyone", [(1, "comment", "en")]),
        ("a.js", "x('never closed literal is here\n// and this is a comment again", [(1, "literal", "en"), (2, "comment", "en")]),
    ],
)
def test_languages_of_files(path, text, want):
    got = found(path, text)
    assert [x for x in got if x in want] == want and len(got) <= len(want) + (path in ("a.js", None))


def test_segmentation_does_not_depend_on_batches():
    texts = [TS * n for n in (1, 3, 9)] + ["", "x"]
    together = proseincode.segment(texts)
    alone = [proseincode.segment([t])[0] for t in texts]
    assert all(np.array_equal(a, b) for a, b in zip(together, alone, strict=True)) and [len(x) for x in together] == [len(t) for t in texts]


def test_pieces_give_what_one_run_gives(monkeypatch):
    long = [TS * 4, "x = 1;\n" * 90 + "// " + "Only the owner may remove it. " * 30 + TS, "a" * 900]
    spans = [[(20, 700)], [(5, 1500)], []]
    whole = proseincode.segment(long, spans)
    assert max(map(len, long)) < proseincode.PIECE * 2
    monkeypatch.setattr(proseincode, "PIECE", 10**6)
    one = proseincode.segment(long, spans)
    monkeypatch.setattr(proseincode, "MARGIN", 3)
    for piece in (11, 64, 500):
        monkeypatch.setattr(proseincode, "PIECE", piece)
        for a, b, c in zip(one, proseincode.segment(long, spans), whole, strict=True):
            assert np.array_equal(a, b) and np.array_equal(a, c)


def test_held_out_languages():
    held = {
        "en": "Only the owner of this record is allowed to remove it before the deadline has passed.",
        "de": "Nur der Besitzer darf diesen Datensatz löschen, solange die Frist noch nicht abgelaufen ist.",
        "es": "Solo el dueño puede borrar este registro mientras no haya vencido el plazo.",
        "fr": "Seul le propriétaire peut supprimer cet enregistrement tant que le délai court encore.",
        "ko": "기한이 지나기 전에는 소유자만 이 기록을 지울 수 있다.",
        "ja": "期限が切れるまでは所有者だけがこの記録を削除できます。",
        "zh": "在期限结束之前只有所有者可以删除这条记录。",
    }
    for lang, text in held.items():
        assert found("x.ts", f"foo(bar);\n// {text}\nlet y = 2;") == [(2, "comment", lang)]


def test_p1_tables(spark, sf):
    rows = queries.p1_found(spark, sf).collect()
    assert rows and all(r.lang in proseincode.STATES[1:] and r.line_no >= 1 for r in rows)
    odd = spark.createDataFrame([(1, None, "/* what is said in here counts */", "x"), (2, "a.py", None, "x"), (2, "a.py", "", "x")], "file_id long, path string, text string, lang string")
    assert [(r.file_id, r.lang) for r in proseincode.prose(odd, "file_id", "path", "text").collect()] == [(1, "en")]
    shares = proseincode.language_shares(proseincode.prose(odd, "file_id", "path", "text"), "file_id").collect()
    assert [r.share for r in shares] == [1.0]


# --- markup


def test_labels_of_held_out_pages():
    right = total = 0
    for value, ls, y in markup.labelled_pages(300, 12345):
        if ls:
            got = markup.trained().decode(markup.features(value, ls))
            right += sum(a == b for a, b in zip(got, y, strict=True))
            total += len(y)
    assert right >= 0.99 * total > 500


@pytest.mark.parametrize(
    ("value", "want"),
    [
        (None, []), ("", []), ("plain words only", []), ("C:\\new\\temp and a < b, *.ts or **/*.sql, __init__, $HOME and $PATH, $5, C#, 5 * 3 * 2", []),
        ("# Title\n\ntext", ["heading"]), ("Title\n=====\n\ntext", ["heading"]), ("== Title ==\n\n# one\n# two", ["heading", "list"]),
        ("\\section{Title}\r\n\r\ntext", ["heading"]), ("<H2 id='a'>T</H2>\n\n<p>x", ["heading", "other"]),
        ("<ol><li>a<li>b</ol>", ["list"]), ("- one\n- two", ["list"]), ("\\begin{itemize}\n  \\item a\n\\end{itemize}", ["list"]),
        ("```\na **b** &amp; $x^2$\n```", ["code_block"]), ("text\n\n    code(1)", ["code_block"]), ("<pre>if (a &lt; 6) x</pre>", ["code_block"]),
        ("~~~\nnever closed", ["code_block"]), ("Here $O(n \\log n)$ holds.", ["formula"]), ("$$\nx\n$$", ["formula"]), ('<div class="math">\\[a\\]</div>', ["formula"]),
        ("some **bold** word", ["other"]), ("a `code` word", ["other"]), ("a&nbsp;&mdash; b", ["other"]), ("x <!-- y --> z", ["other"]), ("{{note|x}}", ["other"]),
        ("''so'' it is", ["other"]), ("see [[Page|it]]", ["other"]), ("as in~\\cite{x}", ["other"]), ("Array<string> is narrower than Map<String, List<Integer>>.", []),
        ("- a **bold** item\n- two", ["list", "other"]),
    ],
)
def test_structures(value, want):
    assert markup.structures(value) == want


def test_clean_keeps_structure():
    value = "<h2>One &amp; two</h2>\n\n<p>Some <em>words</em>, <code>f(x)</code>.</p>\n\n<ul><li>a<li>b</ul>\n\n<pre><code>if (a &lt; 5) x</code></pre>\n\n<math>x</math>"
    assert markup.clean(value) == "# One & two\nSome words, f(x).\n- a\n- b\n```\nif (a < 5) x\n```\n$x$"
    assert markup.clean("# T\n\n1. a\n2. b\n\n    one\n    two") == "# T\n- a\n- b\n```\none\ntwo\n```"
    assert markup.clean(None) is None and markup.clean("plain") == "plain"
    long = "**x** " * 20_000
    assert markup.structures(long) == ["other"] and markup.clean(long) == "x " * 19_999 + "x"


def test_p2_tables(spark, sf):
    rows = queries.p2_found(spark, sf).collect()
    assert rows and {r.structure for r in rows} <= {*markup.LABELS[1:], "other"} and {r.origin for r in rows} == {"arch", "findings"}
    none = spark.createDataFrame([("a", 1, "f", None)], "origin string, row_id long, field string, value string")
    assert markup.found_structures(none).count() == 0 and markup.cleaned(none).first().clean is None


# --- residue


@pytest.mark.parametrize(
    ("text", "want"),
    [
        (None, []), ("", []), ("```\n{{ x }}\n404 Not Found\n```", []), ("> Access denied", []),
        ("When GET /a/b answers 404 Not Found, the reader keeps the row as external.", []),
        ('The viewer showed "Your session has expired. Please sign in again" until the pool was reloaded.', []),
        ("In the view, `{{ a.b }}` is escaped by renderThing and never left raw.", []),
        ("Filler such as lorem ipsum in a/b.ts is a fixture for the parser, not content.", []),
        ("The old cache wrote 3 lines per row; the new one writes 7.\n\n404 Not Found", ["error_page"]),
        ("Please enable JavaScript to view this page.", ["script_notice"]), ("You need to enable JavaScript to run this app.\r\n\r\nLorem ipsum dolor sit amet, consectetur.", ["filler", "script_notice"]),
        ("Dear ${name},\nyour scan of ${a.b} found ${N_C} problems in ${x}.", ["placeholder"]), ("undefined rows from null.", ["placeholder"]), ("[Insert a summary of the change here]", ["placeholder"]),
        ("no sense here. no sense here. no sense here. no sense here. no sense here.", ["filler"]), ("{{a}}\n{{b}}", ["placeholder"]),
    ],
)
def test_kinds(text, want):
    assert residue.kinds(text) == want


def test_p9_tables(spark, sf):
    rows = queries.p9_found(spark, sf).collect()
    everything = spark.read.parquet(f"{sf}/documents.parquet").count()
    assert 0 < len({r.doc_id for r in rows}) < everything / 4
    assert queries.p9_kept(spark, sf).count() == everything - len({r.doc_id for r in rows})
    long = residue.kinds("The reader keeps the earlier value of this row and moves on. " * 1 + "Each entry carries a line. " + html.escape("<x>") * 20_000)
    assert isinstance(long, list)
