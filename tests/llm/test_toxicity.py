import zlib

import pyarrow as pa

from tapedeck.llm import common, toxicity
from tests.llm.fixtures import SF, awkward, frame, prose


def labelled(spark, n=600):
    """Texts, an eighth of them with one of three invented bad words."""
    rows, labels = [], []
    for i in range(n):
        bad = i % 8 == 0
        words = prose(i, 40).split()
        if bad:
            for k, w in enumerate(("gruntle", "blorpish", "zanker")[: 1 + i % 3]):
                words[5 + 7 * k] = w
        rows.append((i, " ".join(words)))
        labels.append((i, 1, int(bad)))
    return rows, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_learns_and_restores(spark):
    rows, labels = labelled(spark)
    docs = rows + [(1000, "so a gr0ntle and bl0rpish z4nker came"), (1001, "b l o r p i s h and z-a-n-k-e-r they"), (1002, "zaaaanker!!! BLOOOORPISH gruntle$$$")] + [(2000 + i, t) for i, (_, t) in enumerate(awkward())]
    model = toxicity.train(frame(spark, docs), labels)
    got = {r.doc_id: r for r in toxicity.score(frame(spark, docs), model).collect()}
    assert len(got) == len(docs)
    for i, _ in rows:
        assert got[i].predicted == int(i % 8 == 0), i
        assert got[i].held_out == (zlib.crc32(str(i).encode()) % 3 == 1)
    assert all(got[i].predicted == 1 for i in (1000, 1001, 1002))
    assert all(got[2000 + i].predicted == 0 and 0 <= got[2000 + i].score <= 1 for i in range(len(awkward())))


def test_restored_words(spark):
    rows, labels = labelled(spark)
    restorer = toxicity.Restorer(toxicity.train(frame(spark, rows), labels).characters)
    for seen, want in {"g-r-u-n-t-l-e": "gruntle", "zank3r": "zanker", "blorp1sh": "blorpish", "zaaanker": "zanker", "zanker***": "zanker", "(zanker)": "zanker", "karen": "karen", "4111111111111111": "", "": ""}.items():
        assert restorer.words(pa.array([seen])) == [want], seen
    for seen, want in {"b l o r p i s h": "blorpish", "z a n k e r g r u n t l e": "zanker gruntle", "g r u n t l e.": "gruntle", "( z 4 n k e r )": "zanker"}.items():
        codes, words, offsets = common.words_of(pa.array(["before it", seen, ""]))
        assert [(t, " ".join(restorer.run(w))) for t, w in toxicity.spaced_runs(words, codes, offsets)] == [(1, want)], seen
    assert restorer.words(pa.array(["zannker", "ggruntle"])) == ["zanker", "gruntle"]


def test_long_runs_of_letters_take_linear_time(spark):
    model = toxicity.CharacterModel({"^^a": 3, "^ab": 3, "ab$": 2})
    assert model.restore_run("ab" * 50_000).count("ab") > 1000


def test_drop_keeps_clean_rows_and_columns(spark):
    rows, labels = labelled(spark)
    df = frame(spark, rows + [(None, None), (5000, "")])
    out = toxicity.drop_toxic(df, labels)
    assert out.columns == df.columns
    assert {r.doc_id for r in out.collect()} == {i for i, _ in rows if i % 8} | {None, 5000}


def test_without_labels(spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    df = frame(spark, awkward())
    assert {r.predicted for r in toxicity.score(df, toxicity.train(df, none)).collect()} <= {0}
    assert toxicity.score(frame(spark, []), toxicity.train(frame(spark, []), none)).count() == 0


def test_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(f"{SF}/../sf0.1/{t}.parquet") for t in ("documents", "labels"))
    got = toxicity.score(docs, toxicity.train(docs, labels)).where("held_out").join(labels, "doc_id").collect()
    hits = sum(r.predicted and r.toxic for r in got)
    assert hits / sum(r.predicted for r in got) > 0.97 and hits / sum(r.toxic for r in got) > 0.75


def test_restore_is_the_likeliest_of_all_readings():
    """Against every way to read a word."""
    import math
    from itertools import product

    model = toxicity.CharacterModel({"^^z": 9, "^za": 9, "zan": 9, "ank": 9, "nke": 9, "ker": 9, "er$": 9, "^^s": 5, "^so": 5, "so$": 5, "^^a": 3, "^ab": 3, "ab$": 2, "abb": 1, "bb$": 1, "kes": 1, "es$": 1})

    def readings(word):
        every = []
        for i, c in enumerate(word):
            letter = c.isalpha()
            options = [(c, 0.0 if letter else 3.0)] + [(x, toxicity.STAND_IN + (1.0 if len(toxicity.LEET[c]) > 2 else 0.0)) for x in toxicity.LEET.get(c, "")]
            if not letter:
                options.append(("", toxicity.DROPPED if c in toxicity.LEET else toxicity.APART))
            elif i and word[i - 1] == c:
                options.append(("", toxicity.REPEATED if word[i - 2 : i] == c * 2 or word[i - 1 : i + 2] == c * 3 else toxicity.TWICE))
            every.append(options)
        for choice in product(*every):
            out = "".join(x for x, _ in choice)
            w = f"^^{out}$"
            yield sum(e for _, e in choice) + sum(model.cost(*w[i : i + 3]) for i in range(len(w) - 2)), out

    for word in ("z4nk3r", "z-a*nk3r", "s0", "zaaank3r", "abb", "*b*", "2@n|<er"):
        best = min(cost for cost, _ in readings(word))
        got = model.restore(word)
        assert math.isclose(min(cost for cost, out in readings(word) if out == got), best), word


def test_run_is_the_likeliest_of_all_splits():
    """Against every reading of the letters with every set of word ends."""
    import math
    from itertools import product

    model = toxicity.CharacterModel({"^^z": 9, "^za": 9, "zan": 9, "an$": 9, "^^s": 5, "^so": 5, "so$": 5, "^^a": 3, "^a$": 3, "^an": 2, "sos": 1, "oso": 1})

    def cost(words):
        return sum(model.cost(*w[i : i + 3]) for x in words for w in [f"^^{x}$"] for i in range(len(w) - 2)) + toxicity.ENDS * (len(words) - 1)

    for seen in ("zanso", "asoan", "sozanaso", "sosa"):
        every = ["".join(c + " " * e for c, e in zip(seen, [*ends, 0], strict=True)).split() for ends in product((0, 1), repeat=len(seen) - 1)]
        assert math.isclose(cost(model.restore_run(seen)), min(map(cost, every))), seen


def test_learns_from_all_labelled_rows(spark, monkeypatch):
    """However many labels there are, the model is that of all of them."""
    seen, stored = {}, toxicity.stored

    def counted(df, name):
        out = stored(df, name)
        seen[name] = out.count()
        return out

    monkeypatch.setattr(toxicity, "stored", counted)
    n = 20_000
    docs = spark.range(n).selectExpr("id AS doc_id", "concat('plain words number ', id, CASE WHEN id % 8 = 0 THEN ' gruntle' ELSE '' END) AS text")
    labels = spark.range(n + 7000).selectExpr("id AS doc_id", "1 AS quality", "int(id % 8 = 0) AS toxic")
    toxicity.train(docs, labels)
    learnt = [i for i in range(n) if zlib.crc32(str(i).encode()) % 3 != 1]
    assert seen["labelled"] == len(learnt)
    assert seen["evidence"] == sum(zlib.crc32(str(i).encode()) % 3 == 2 for i in learnt)
