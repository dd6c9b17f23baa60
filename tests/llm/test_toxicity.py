import random

from llm_cases import EDGES, prose, table

from ticketlens.llm import toxicity as X


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_automaton_matches_edit_distance():
    maker = random.Random(5)
    terms = sorted({"".join(maker.choice("abc") for _ in range(maker.randrange(3, 12))) for _ in range(60)})
    lexicon = X.FuzzyLexicon(terms)
    for _ in range(3000):
        word = "".join(maker.choice("abcd") for _ in range(maker.randrange(0, 13)))
        fits = [(distance(word, t), t) for t in terms if distance(word, t) <= X.edits_allowed(t)]
        assert lexicon.nearest(word) == (min(fits)[::-1] if fits else None), word


def training(spark):
    rows, labels = [], []
    for i in range(300):
        toxic = i % 5 == 0
        insults = ["blockhead", "numbskull", "dimwit"]
        rows.append((i, prose(i, 40) + " you and so on" + (f" you {insults[i % 3]} and {insults[i % 2]} {prose(900 + i, 9)}" if toxic else "")))
        labels.append((i, 1, int(toxic)))
    return table(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_plain_misspelt_and_quoted(spark):
    docs, labels = training(spark)
    model = X.train(docs, labels)
    say = lambda text: float(model.score([f"{prose(5000, 30)} {text} {prose(5001, 30)}"])[0])
    assert say("you blockhead") > 0.7 and say("you blokhead and numbskul") > 0.7
    assert say("and then some more words") < 0.3
    assert say('he said "blockhead" in the report') < say("you blockhead")
    assert all(0 <= s <= 1 for s in model.score(["", None, "x"]))


def test_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    model = X.train(docs, labels, learn_from=~X.held_out("id"))
    rows = X.score(docs.join(labels, "doc_id").filter(X.held_out("doc_id")), model).select("toxic", "score").toPandas()
    assert ((rows.score >= X.THRESHOLD) == (rows.toxic == 1)).mean() > 0.96
    assert (rows.score[rows.toxic == 0] >= X.THRESHOLD).mean() < 0.01


def test_edges(spark):
    docs = table(spark, EDGES, clashing=True)
    model = X.train(docs, spark.createDataFrame([(4, 1, None), (6, 1, 0), (None, 1, 1)], "doc_id long, quality int, toxic int"))
    scored = X.score(docs, model).collect()
    assert len(scored) == len(EDGES) and all(r.score < X.THRESHOLD for r in scored)
    assert X.score(table(spark, []), model).count() == 0


def test_misspelling_of_a_word_kept_only_as_a_stem(spark):
    rows, labels = [], []
    insults = ["blockhead", "blockheads", "blockheaded", "blockheadish"]
    for i in range(400):
        toxic = i % 5 == 0
        rows.append((i, prose(i, 40) + (f" you {insults[i // 5 % 4]} {prose(900 + i, 9)}" if toxic else "")))
        labels.append((i, 1, int(toxic)))
    model = X.train(table(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    assert any(t.endswith("*") for t in model.terms) and not set(insults) & model.terms.keys()
    say = lambda text: float(model.score([f"{prose(5000, 30)} {text} {prose(5001, 30)}"])[0])
    assert say("you blockhead") > 0.7
    assert say("you glockhead") > 0.5 and say("you bolckheaded") > 0.3 > say("and then some more words")


def test_one_id_on_many_rows_counts_once(spark, monkeypatch):
    seen = []
    fit = X._fit_layer
    monkeypatch.setattr(X, "_fit_layer", lambda values, labels: seen.append(len(labels)) or fit(values, labels))
    rows = [(1, f"vile{'x' * (i % 3)} word") for i in range(3000)] + [(i, "vile rude words" if i % 2 else "kind words") for i in range(2, 60)]
    labels = [(i, 1, i % 2) for i in range(1, 60)]
    X.train(table(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), max_rows=100)
    assert seen == [59]
