import json

from tapedeck.operators import analysis as a

GOOD = {"subject_paragraph": "About home", "subject_tags": ["home", 3], "listener_feel_generic": {"primary_emotion": "calm", "x": 1}, "tones": ["warm"], "language": "en", "narrative_pov": "first", "more": None}


def checked(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "i int, raw string").selectExpr("*", "1 as x")
    return {r.i: r for r in a.validate_analysis(df, "raw").collect()}


def test_each_bad_path_has_its_reason(spark):
    texts = [json.dumps(GOOD)]
    for name, _ in a.SHAPE:
        texts += [json.dumps({k: v for k, v in GOOD.items() if k != name}), json.dumps(GOOD | {name: None}), json.dumps(GOOD | {name: 5})]
    got = checked(spark, texts)
    assert got[0].valid and got[0].reasons == [] and got[0].analysis.subject_tags == ["home", "3"] and got[0].analysis.listener_feel_generic.primary_emotion == "calm"
    for i, (name, kind) in enumerate(a.SHAPE):
        for j in range(3):
            r = got[1 + 3 * i + j]
            assert (r.valid, r.reasons, r.analysis) == (False, [f"$.{name}: {kind}"], None)


def test_texts_that_are_no_objects(spark):
    got = checked(spark, [None, "", "{broken", "[]", "null", '"text"', "7", "{}", json.dumps(GOOD | {"tones": "warm", "language": ["en"]}), json.dumps(GOOD | {"listener_feel_generic": ["calm"]})])
    assert all(got[i].reasons == ["$: object"] and not got[i].valid for i in range(7))
    assert got[7].reasons == [f"$.{n}: {k}" for n, k in a.SHAPE]
    assert got[8].reasons == ["$.tones: array", "$.language: string"] and got[9].valid


def test_text_of_an_analysis(spark):
    rows = [("About home", '["warm", "slow"]', '{"primary_emotion": "calm"}'), ("P", "broken", "{"), ("P", '[null, "x"]', "{}"), ("P", "[]", '{"primary_emotion": "joy"}'), ("", None, None), (None, "[]", "{}")]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, p string, t string, f string")
    got = [r.x for r in df.select("i", a.analysis_text(df.p, df.t, df.f).alias("x")).orderBy("i").collect()]
    assert got == ["About home warm slow calm", "P", "P  x", "P  joy", "", None]
