import zlib

from sluice.llm.language_id import keep_identified, learn_dictionaries, letters, predict_languages

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = learn_dictionaries(docs)
    assert sorted(model) == ["de", "en", "es", "fr"]
    lang = {r.doc_id: r.lang for r in docs.select("doc_id", "lang").collect()}
    got = [r for r in predict_languages(docs, model).collect()]
    assert len(got) == len(lang)
    held = [r for r in got if zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    assert sum(r.lang_pred == lang[r.doc_id] for r in held) / len(held) > 0.97
    assert sum(r.rejected for r in held) / len(held) < 0.02
    assert all(0 <= r.score <= 1 for r in got)
    kept = keep_identified(docs, model)
    assert kept.columns == docs.columns and kept.count() == sum(not r.rejected for r in got)


def test_only_rows_not_held_out_are_learned(spark):
    rows = [(i, "bonjour le monde " * 9, "fr" if zlib.crc32(str(i).encode()) % 5 else "xx") for i in range(50)]
    rows += [(100, "hallo welt", None), (101, "123", "num"), (102, None, "nul")]
    assert sorted(learn_dictionaries(spark.createDataFrame(rows, "doc_id long, text string, lang string"))) == ["fr"]


def test_edges(spark):
    model = {"aa": b"the cat sat on the mat and the dog", "bb": b"der hund und die katze auf der matte"}
    rows = [(1, None), (2, ""), (3, "12 34 !!"), (4, "the dog sat on the mat"), (5, "die katze und der hund " * 9000), (5, "die katze"), (None, "the cat"), (7, "xyzzy")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("doc_id", "text", "1 AS score", "2 AS id")
    got = [(r.doc_id, r.lang_pred, r.rejected) for r in predict_languages(docs, model).collect()]
    assert [x[1] for x in got if x[0] in (1, 2, 3)] == ["und"] * 3 and all(x[2] for x in got if x[0] in (1, 2, 3))
    assert (4, "aa", False) in got and got.count((5, "bb", False)) == 2 and (None, "aa", False) in got
    assert keep_identified(docs, model).columns == docs.columns
    assert {x.lang_pred for x in predict_languages(docs, {}).collect()} == {"und"}
    assert predict_languages(docs.limit(0), model).count() == 0
    assert learn_dictionaries(spark.createDataFrame([], "doc_id long, text string, lang string")) == {}


def test_letters_marks_and_numerals(spark):
    assert letters("हिन्दी 12") == "हिन्दी" and letters("Ünïcode-X_9") == "ünïcode x" and letters("It's 3 a.m.") == "it s a m"
    for text in ("½", "²³ 12", "Ⅷ", "́", "①②", "_ _", "१२३"):
        assert letters(text) == ""
    model = {"de": b"der hund und die katze", "hi": "हिन्दी भाषा में लिखा गया".encode()}
    rows = [(1, "½"), (2, "²³ 12"), (3, "Ⅷ"), (4, "́"), (5, "हिन्दी भाषा में लिखा"), (6, "der hund")]
    got = {r.doc_id: r.lang_pred for r in predict_languages(spark.createDataFrame(rows, "doc_id long, text string"), model).collect()}
    assert got == {1: "und", 2: "und", 3: "und", 4: "und", 5: "hi", 6: "de"}


def test_two_models_in_one_session(spark):
    docs = spark.createDataFrame([(1, "der hund und die katze")], "doc_id long, text string").coalesce(1)
    for name in ("a", "b", "a"):
        model = {name: b"der hund und die katze", "z": b"something else"}
        assert [r.lang_pred for r in predict_languages(docs, model).collect()] == [name]
