"""Text, scoring and stemming functions on tiny tables."""

import pytest
from pyspark.sql import functions as F

from starloom.functions import display as D
from starloom.functions import scoring as S
from starloom.functions import text as T
from starloom.functions.stemming import stem, stems


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def test_tokens_split_camel_case_and_keep_digits(spark):
    got = one(spark, T.tokens(F.lit("useEffect XMLHttpRequest bge-m3 oauth2 Ünï"))).asDict()
    assert list(got.values())[0] == ["use", "effect", "xml", "http", "request", "bge", "m3", "oauth2", "ünï"]


def test_index_tokens_fold_marks_and_keep_camel_case_whole(spark):
    assert one(spark, T.index_tokens(F.lit("useEffect naïve CAFÉ"))[0], T.index_tokens(F.lit("naïve CAFÉ")))[:] == ("useeffect", ["naive", "cafe"])


def test_clean_query_clamps_and_composes(spark):
    assert one(spark, F.length(T.clean_query(F.lit("x" * 600))))[0] == 512
    assert one(spark, T.clean_query(F.lit(" a\t\x00b  c ")))[0] == "a b c"
    assert one(spark, T.clean_query(F.lit("é"), ))[0] == "é"


@pytest.mark.parametrize("words, want", [(["a", "b", "a", "b"], ["a b", "b a"]), (["a"], []), ([], [])])
def test_phrases(spark, words, want):
    assert one(spark, T.phrases(F.array(*map(F.lit, words)).cast("array<string>")))[0] == want


def test_names_and_logins(spark):
    row = one(spark, T.plain_name(F.lit("Foo-Bar_2")), T.slug(F.lit("  My List! ")), T.login_key(F.lit(" @Octo ")), T.login_key(F.lit("https://github.com/Octo/")), T.valid_login(F.lit("a-b")), T.valid_login(F.lit("a--b")))
    assert tuple(row) == ("foobar2", "my-list", "octo", "octo", True, False)
    short = one(spark, T.shorthand(F.lit("https://github.com/a/b.git")).alias("x"), T.shorthand(F.lit("nothing")).alias("y"))
    assert (short.x.owner, short.x.name, short.y) == ("a", "b", None)


def test_snippets(spark):
    body = "word " * 40 + "the needle is here " + "tail " * 80
    row = one(spark, T.snippet(F.lit(body), F.lit("about"), ["needle"]), T.snippet(F.lit(None).cast("string"), F.lit("about a needle"), ["needle"]), T.snippet(F.lit("x"), F.lit("plain"), ["zz"]), T.snippet(F.lit("needles"), F.lit(None).cast("string"), ["needle"]))
    assert row[0].startswith("…") and row[0].endswith("…") and "needle" in row[0] and len(row[0]) <= 223
    assert row[1:] == ("about a needle", "plain", "")


def test_markdown_is_stripped(spark):
    text = "# Title\n<!-- no -->\n![i](x) [link](y) <b>bold</b>\n```\ncode\n```\n> quote"
    got = one(spark, T.plain_markdown(F.lit(text)))[0]
    assert "Title" in got and "link" in got and "bold" in got and "quote" in got
    assert "code" in got and not any(x in got for x in ("no -->", "](", "<b>", "#", ">", "```"))
    rest = [one(spark, T.plain_markdown(F.lit(x)))[0] for x in ("```js\nlet a = 1;\n```\nafter", "  ## Two\n\n\n\n   > said\r\nend", "[a](b)[c](d) x<br/>y", "a#b > c")]
    assert rest == ["let a = 1;\n \nafter", "Two\n\nsaid\nend", "ac x y", "a#b > c"]


def test_driver_and_columns_read_queries_alike(spark):
    texts = ["useEffect XMLHttpRequest", "ÀÉtat françaisÜber", "ΑθήναΕλλάδα ΓΔΕλ", "МоскваГород", "naïve CAFÉ_x", "a\u0301\x07b  c", "x2Y v1.2-beta", "漢字かな", "", "  ", "ǅungla ᾈx"]
    rows = spark.createDataFrame([(k, x) for k, x in enumerate(texts)], "k int, x string").withColumn("q", T.clean_query(F.col("x"))).select("k", "q", T.tokens(F.col("x")).alias("t"), T.index_tokens(F.col("x")).alias("i")).collect()
    for r in rows:
        assert (r.q, r.t, r.i) == (T.cleaned(texts[r.k]), T.token_list(texts[r.k]), T.index_words(texts[r.k])), texts[r.k]


def test_snippets_are_marked_whole(spark):
    text = " ".join(f"w{k}" for k in range(100)) + " the Needle, here " + "tail " * 50
    got = one(spark, D.marked_snippet(F.lit(text), ["needle", "w1"]), D.marked_snippet(F.lit(text), ["zz"]), D.marked_snippet(F.lit("a b"), []), D.marked_snippet(F.lit("a needle"), ["needle"]), D.marked_snippet(F.lit(text), ["needle"]))
    assert got[0].startswith("w0 <mark>w1</mark> w2") and got[1].endswith("w19 …") and got[2] == "a b" and got[3] == "a <mark>needle</mark>"
    assert got[4].startswith("… ") and "<mark>Needle</mark>, here" in got[4] and got[4].count("<mark>") == 1 and len(got[4].split()) == 22


def test_identifiers_and_lab_documents(spark):
    row = one(spark, T.table_name(F.lit("Foo-Bar.x")), T.camelized(F.lit("repo_id_2x")), T.lab_embedding_text(F.lit("a/b"), F.lit(""), F.array(F.lit("x"), F.lit("y")), F.lit(None).cast("string"), F.lit("# T\nbody")), T.lab_embedding_text(F.lit("a/b"), F.lit("d"), F.array().cast("array<string>"), F.lit("Go"), F.lit(None).cast("string")))
    assert row[:] == ("fts_u_foo_barx", "repoId2x", "a/b — topics: x, y — lang: unknown\nT\nbody", "a/b — d — lang: Go")


def test_run_of_tokens(spark):
    a = lambda *x: F.array(*map(F.lit, x))
    assert one(spark, T.has_run(a("access", "control", "x"), a("access", "control")), T.has_run(a("ab", "c"), a("b", "c")), T.has_run(a("a"), F.array().cast("array<string>")))[:] == (True, False, False)


def test_embedding_text_leaves_out_blanks(spark):
    none = F.lit(None).cast("string")
    assert one(spark, T.embedding_text(F.lit("a/b"), none, F.array(F.lit("x")), none, F.lit(" r  r ")))[0] == "a/b\nTopics: x\nr r"


def test_hashes(spark):
    assert one(spark, S.fnv1a(F.lit("😀")))[0] == "cb31c4b8"
    row = one(spark, S.fnv1a(F.lit("hello")), S.fnv1a(F.lit("")), S.ip_hash(F.lit("2024-01-01"), F.lit("1.2.3.4")))
    import hashlib

    assert row[:] == ("4f9f2cab", "811c9dc5", hashlib.sha256(b"2024-01-01\x001.2.3.4").hexdigest())


def test_priors_and_specificity(spark):
    row = one(spark, S.star_prior(F.lit(0)), S.star_prior(F.lit(10**7)), S.specificity(F.lit(0)), S.specificity(F.lit(1)), S.rrf(F.lit(1)))
    assert row[:] == pytest.approx((1.0, 1.25, 1.0, 0.5, 1 / 61))


def test_cosine(spark):
    v = lambda *x: F.array(*(F.lit(float(y)) for y in x))
    assert one(spark, S.cosine(v(1, 0), v(1, 1)), S.cosine(v(0, 0), v(1, 1)))[:] == pytest.approx((0.5**0.5, 0.0))
    with pytest.raises(Exception, match="differ in length"):
        one(spark, S.cosine(v(1), v(1, 2)))


@pytest.mark.parametrize("word, want", [("authentication", "authent"), ("authenticate", "authent"), ("caresses", "caress"), ("ponies", "poni"), ("relational", "relat"), ("hopping", "hop"), ("falling", "fall"), ("happy", "happi"), ("sky", "sky"), ("agreed", "agre"), ("probate", "probat"), ("rate", "rate"), ("controlling", "control"), ("a", "a"), ("ünï", "ünï")])
def test_stems(word, want):
    assert stem(word) == want


def test_stems_as_column(spark):
    assert one(spark, stems(F.array(F.lit("retries"), F.lit("retry"))))[0] == ["retri", "retri"]


def test_waits(spark):
    n = F.lit(None).cast("int")
    assert one(spark, S.wait_seconds(F.lit(1), F.lit(10), n), S.wait_seconds(F.lit(3), n, n), S.wait_seconds(F.lit(9), n, n), S.wait_seconds(F.lit(1), n, F.lit(5)))[:] == (15.0, 240.0, 900.0, 60.0)
