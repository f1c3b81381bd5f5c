"""Counts and verdicts against plain loops over the words and lines of a text."""

import re

import pytest
from pyspark.sql import functions as F

from townhall.llm import quality_rules as Q

WORDS = re.compile("[^\x20\x09-\x0d]+")


def plain(text):
    t = text or ""
    words = WORDS.findall(t)
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    hit = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(5)}
    lines = [x for x in t.split("\n") if WORDS.search(x)]
    bare = [w for w in words if not re.search("[A-Za-z\x80-\U0010ffff]", w)]
    return {
        "n_words": len(words), "word_chars": sum(map(len, words)), "n_symbols": sum(x in Q.SYMBOLS for x in t), "n_bare_words": len(bare),
        "n_stop_words": sum(w in Q.stop_words() for w in words), "n_lines": len(lines), "n_dup_lines": len(lines) - len(set(lines)),
        "n_bullet_lines": sum(bool(re.match("[ \t]*[-*•]", x)) for x in lines), "n_cut_lines": sum(bool(re.search("(\\.\\.\\.|…)[ \t\r\x0b\x0c]*$", x)) for x in lines),
        "n_repeat_words": len(hit),
    }


def verdict(c, rules):
    def ok(r):
        value, unit = (c[r.count], 1) if r.per is None else (100 * c[r.count], c[r.per])
        return (r.least is None or value >= r.least * unit) and (r.most is None or value <= r.most * unit)

    return [r.name for r in rules if not ok(r)]


TEXTS = [
    None, "", " \n\t ", "one", "a b c d e", "a b c d e f a b c d e", "a a a a a a a", "a a a a a a", "x y z x y z x y z x y z end",
    "| a | b | | c |", "- item\n- item\n* other\n  • last\n\n", "cut ...\ncut …\r\nwhole", "été ÉTÉ 漢字 😀 ### 12", "nul \x00 \x1f \x7f word",
    "The cat and the dog sat on the mat of the house and it was warm in there", "a\x0bb\x0cc\rd\te f",
]


@pytest.mark.parametrize("text", TEXTS)
def test_counts_equal_plain_loops(spark, text):
    found = spark.createDataFrame([(text,)], "text string").select(Q.counts(F.col("text")).alias("c")).first()["c"].asDict()
    assert found == plain(text)


def test_whole_table_equals_plain_loops(small, texts):
    rows = Q.judge(small).select("doc_id", "quality").collect()
    assert len(rows) == len(texts)
    short = [r for r in rows if len(texts[r["doc_id"]]) < 6000]
    for r in short:
        c, q = plain(texts[r["doc_id"]]), r["quality"]
        assert q["counts"].asDict() == c
        broken = verdict(c, Q.BASE + Q.RULES)
        assert q["broken"] == broken and q["kept"] == (not broken) and q["base_failed"] == bool(verdict(c, Q.BASE))
    assert len(short) > 150


def test_odd_rows(spark, odd, empty):
    rows = Q.judge(odd).select("doc_id", "quality", "n", "score").collect()
    assert len(rows) == odd.count() and all(r["n"] == "clash" for r in rows)
    assert [r["quality"]["kept"] for r in rows if r["doc_id"] == 10] == [False, False]
    assert all(r["quality"]["broken"][0] == "few_words" for r in rows if r["doc_id"] in (6, 7, 8, 12))
    assert Q.judge(empty).count() == 0


def test_quality_column_of_the_table_stays(spark):
    df = spark.createDataFrame([("a b", 7)], "text string, quality int")
    row = Q.judge(df).first()
    assert row["quality"] == 7 and row["_quality"]["counts"]["n_words"] == 2


def test_a_text_of_megabytes(spark):
    row = spark.range(1).select(F.array_join(F.transform(F.sequence(F.lit(1), F.lit(300_000)), lambda i: F.concat(F.lit("word"), i)), " ").alias("text"))
    row = row.select(F.concat_ws(" ", "text", F.lit("word7 word8 word9 word10 word11")).alias("text"))
    c = Q.judge(row).first()["quality"]["counts"]
    assert (c["n_words"], c["n_repeat_words"]) == (300_005, 10)


def test_no_rules_keep_all(small):
    assert Q.judge(small, (), ()).filter("quality.kept").count() == small.count()


def test_the_plan_is_one_projection(small):
    plan = Q.judge(small)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan and "InArrow" not in plan
