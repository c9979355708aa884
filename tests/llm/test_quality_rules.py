import random

from pyspark.sql import functions as F

from runout.llm import quality_rules as Q


def brute_repeat(text, size=5):
    words = (text or "").encode().split()
    windows = [tuple(words[i : i + size]) for i in range(len(words) - size + 1)]
    twice = [i for i, w in enumerate(windows) if windows.count(w) > 1]
    return len({p for i in twice for p in range(i, i + size)})


def test_counts_against_brute_force(spark):
    rng = random.Random(5)
    texts = [" ".join(rng.choice("ab") for _ in range(rng.randrange(40))) for _ in range(60)]
    texts += [None, "", " \n", "a b c d e a b c d e", "x\ny\nx\n \nx y", "a\x0bb\x0cc\rd", "   é#*$ |", "one two three four"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    for r, text in zip(Q.measure(df).orderBy("doc_id").collect(), texts, strict=True):
        words = [w.decode() for w in (text or "").encode().split()]
        lines = [x for x in (text or "").split("\n") if x.encode().split()]
        assert r.n_words == len(words)
        assert r.word_chars == sum(map(len, words))
        assert r.n_symbols == sum((text or "").count(c) for c in "#*$%&|<>")
        assert r.n_dup_lines == len(lines) - len(set(lines))
        assert r.n_repeat_words == brute_repeat(text)
        assert r.base_failed == (len(words) < 10 or 100 * r.n_repeat_words > 20 * len(words))
        assert not (r.base_failed and r.kept)


def test_order_is_by_rejection_per_cost_and_does_not_change_verdicts(edge):
    a, b, c = Q.RULES[:3]
    found = [Q.Estimate(a, 1.0, 10), Q.Estimate(b, 0.1, 5), Q.Estimate(c, 0.5, 0)]
    assert Q.ordered(found) == [b, a, c]
    near = [Q.Estimate(c, 0.5, 0), Q.Estimate(a, 1.0, 10), Q.Estimate(b, 1.1, 12), Q.Estimate(Q.RULES[3], 0.1, 0)]
    assert Q.ordered(near) == [a, b, Q.RULES[3], c]
    assert Q.ordered([Q.Estimate(a, 0.2, 0), Q.Estimate(b, 0.18, 0)]) == [a, b]
    rules = (*Q.BASE_RULES, *Q.RULES)
    words = edge.withColumn("words", Q.words_of(F.col("text")))
    counts = Q.Counts.of(F.col("text"), F.col("words"))
    verdicts = {
        tuple(r.v for r in words.select(Q.cascade(counts, order).isNull().alias("v")).collect())
        for order in (rules, rules[::-1])
    }
    assert len(verdicts) == 1


def test_estimates_are_of_what_runs(spark, monkeypatch):
    """Rejections are those of the sample; a count that is there costs nothing, one that is not costs much more."""
    monkeypatch.setattr(Q, "TIMED_SECONDS", 0.1)
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").limit(3000)
    counted = Q._counted(Q.hash_sample(docs))
    survivors = Q.bounded(counted.where("NOT base_failed"))
    assert 0 < survivors.count() <= Q.SAMPLE_ROWS and survivors.where("base_failed").count() == 0
    found = {e.rule.name: e for e in Q.estimate(survivors, Q._known(), Q.RULES)}
    for rule in Q.RULES:
        assert found[rule.name].rejected == survivors.where(rule.rejects(Q._known())).count()
    assert found["long_words"].cost < found["upper_case"].cost / 3
    assert found["duplicate_lines"].cost < found["not_letters"].cost / 3


def test_the_order_is_the_same_every_time(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    survivors = Q.bounded(Q._counted(Q.hash_sample(docs)).where("NOT base_failed"))
    again = Q.bounded(Q._counted(Q.hash_sample(docs.repartition(5))).where("NOT base_failed"))
    assert survivors.select("text").exceptAll(again.select("text")).count() == 0
    first = [r.name for r in Q.ordered(Q.estimate(survivors, Q._known(), Q.RULES))]
    for _ in range(4):
        assert [r.name for r in Q.ordered(Q.estimate(again, Q._known(), Q.RULES))] == first


def test_junk_goes_and_prose_stays(spark):
    prose = " ".join(f"word{i} stands beside another one," for i in range(20))
    junk = {
        "symbols": " ".join(f"w{i}%%%" for i in range(40)),
        "upper_case": prose.upper().replace("0", "O"),
        "not_letters": " ".join(str(i) for i in range(100)),
        "repeated_windows": "again and again and again and " * 9,
        "few_words": "few words",
    }
    df = spark.createDataFrame([("prose", prose), *junk.items()], "doc_id string, text string")
    assert [r.doc_id for r in Q.drop_rejected(df).collect()] == ["prose"]


def test_rows_without_words_and_empty_tables(edge):
    judged = Q.measure(edge)
    assert judged.where("n_words = 0").count() == 4
    assert not judged.where("n_words = 0 AND kept").count()
    assert Q.measure(edge.where("false")).count() == 0
    kept = Q.drop_rejected(edge)
    assert kept.columns == edge.columns and kept.count() == judged.where("kept").count()


def test_no_python_in_the_plan(edge):
    plan = Q.measure(edge)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan
